"""Small numeric column helpers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio_if_positive(numerator: Column, denominator: Column) -> Column:
    """``numerator / denominator`` when the denominator is positive, else null."""
    return F.when(denominator > 0, F.try_divide(numerator, denominator))


def at_least_zero(value: Column) -> Column:
    return F.greatest(F.lit(0.0), value)


def rounded(frame: DataFrame, places: dict[str, int]) -> DataFrame:
    """Round the named double columns; used only where results leave the engine."""
    return frame.withColumns({c: F.round(F.col(c), n) for c, n in places.items()})


#: Lanczos' coefficients for g = 7.
LANCZOS_G = 7.0
LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)
FRACTION_TERMS = 300
_TINY = 1e-300


def log_gamma(z: Column) -> Column:
    """ln of the gamma function for ``z`` of 0.5 or more."""
    series = F.lit(LANCZOS[0])
    for k, c in enumerate(LANCZOS[1:]):
        series = series + c / (z + k)
    at = z + (LANCZOS_G - 0.5)
    return 0.5 * math.log(2 * math.pi) + (z - 0.5) * F.log(at) - at + F.log(series)


def student_two_sided(frame: DataFrame, t: str, freedom: str, column: str) -> DataFrame:
    """Adds the chance that Student's t with ``freedom`` degrees is at least as far from zero as ``t``.

    It is the regularised incomplete beta function at ``freedom / (freedom + t^2)``, by its
    continued fraction (modified Lentz), folded over a fixed number of terms.
    """
    square, f = F.col(t) * F.col(t), F.col(freedom)
    x, rest = f / (f + square), square / (f + square)
    swap = x >= (f / 2 + 1) / (f / 2 + 2.5)  # the fraction converges fast on the other side
    half = F.lit(0.5)
    staged = frame.withColumns(
        {
            "_swap": swap, "_x": F.when(swap, rest).otherwise(x), "_rest": F.when(swap, x).otherwise(rest),
            "_a": F.when(swap, half).otherwise(f / 2), "_b": F.when(swap, f / 2).otherwise(half),
        }
    )
    a, b, at = F.col("_a"), F.col("_b"), F.col("_x")
    away = lambda v: F.when(F.abs(v) < _TINY, F.lit(_TINY)).otherwise(v)

    def term(state: Column, by: Column) -> Column:
        d = 1 / away(1 + by * state["d"])
        c = away(1 + by / state["c"])
        return F.struct(c.alias("c"), d.alias("d"), (state["h"] * d * c).alias("h"))

    def two_terms(state: Column, k: Column) -> Column:
        m = k.cast("double")
        even = m * (b - m) * at / ((a - 1 + 2 * m) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * at / ((a + 2 * m) * (a + 1 + 2 * m))
        return term(term(state, even), odd)

    first = 1 / away(1 - (a + b) * at / (a + 1))
    start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h"))
    fraction = F.aggregate(F.sequence(F.lit(1), F.lit(FRACTION_TERMS)), start, two_terms, lambda state: state["h"])
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log("_x") + b * F.log("_rest"))
    share = F.when(at > 0, front * fraction / a).when(at == 0, F.lit(0.0))
    tail = F.when(F.col("_swap"), 1 - share).otherwise(share)
    return staged.withColumn(column, F.when(F.col(t) == 0, F.lit(1.0)).otherwise(tail)).drop("_swap", "_x", "_rest", "_a", "_b")
