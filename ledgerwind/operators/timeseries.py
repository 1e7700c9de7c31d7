"""Calendar, frame and interval helpers shared by every feature table.

All of them work on frames already reduced to one row per entity and day, so a
window partition holds at most one row per calendar day (plus grid points) no
matter how many facts an entity has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def by_day(keys: Sequence[str], day: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(day)


def densify(daily: DataFrame, keys: Sequence[str], day: str, zero: Sequence[str]) -> DataFrame:
    """Fill every missing day between an entity's first and last day with zeros.

    Each row is stretched up to the day before the entity's next row, so the
    calendar needs neither a second aggregate nor a join.
    """
    following = F.lead(day).over(by_day(keys, day))
    covered = daily.withColumns({"_own": F.col(day), "_until": F.coalesce(F.date_sub(following, 1), F.col(day))})
    stretched = covered.withColumn(day, F.explode(F.sequence(F.col(day), F.col("_until")))).drop("_until")
    filled = {c: F.when(F.col(day) == F.col("_own"), F.col(c)).otherwise(F.lit(0).cast(daily.schema[c].dataType)) for c in zero}
    return stretched.withColumns(filled).drop("_own")


def rolling_sum(value: str, keys: Sequence[str], day: str, days: int) -> Column:
    """Trailing sum over a dense series; shorter at the start of the series."""
    return F.sum(value).over(by_day(keys, day).rowsBetween(-(days - 1), 0))


def _running(value: str, spec: WindowSpec) -> Column:
    return F.coalesce(F.sum(value).over(spec), F.lit(0))


def rolling_count(value: str, keys: Sequence[str], day: str, days: int) -> Column:
    """:func:`rolling_sum` for whole numbers, as a difference of running sums.

    A running sum costs one addition per row whatever the width of the frame;
    for whole numbers the difference is exact.
    """
    upto = lambda end: by_day(keys, day).rowsBetween(Window.unboundedPreceding, end)
    return _running(value, upto(0)) - _running(value, upto(-days))


def trailing_count(value: str, keys: Sequence[str], day: str, oldest: int | None, newest: int = 0) -> Column:
    """Sum of a whole-number column over rows dated ``day - oldest`` to ``day - newest``."""
    spec = Window.partitionBy(*keys).orderBy(F.unix_date(F.col(day)))
    upto = lambda end: spec.rangeBetween(Window.unboundedPreceding, end)
    total = _running(value, upto(-newest))
    return total if oldest is None else total - _running(value, upto(-oldest - 1))


def on_weekly_grid(
    daily: DataFrame, keys: Sequence[str], day: str, first: Column, last: Column, zero: Sequence[str], step: int = 7
) -> DataFrame:
    """Add one zero row per entity and grid date, flagged ``on_grid``.

    The grid hangs off each entity's first row, which avoids a second pass over
    the facts to list the entities.
    """
    opens = F.row_number().over(by_day(keys, day)) == 1
    no_dates = F.array().cast("array<date>")
    flagged = daily.withColumn("_opens", opens)
    grid = F.when(F.col("_opens"), F.sequence(first, last, F.expr(f"interval {step} days"))).otherwise(no_dates)
    others = [c for c in daily.columns if c != day]
    points = flagged.select(*others, F.posexplode(F.concat(F.array(day), grid)).alias("_pos", day))
    zeros = {c: F.when(F.col("_pos") > 0, F.lit(0).cast(daily.schema[c].dataType)).otherwise(F.col(c)) for c in zero}
    return points.withColumns({**zeros, "on_grid": F.col("_pos") > 0}).drop("_pos")


def trailing(aggregate: Column, keys: Sequence[str], day: str, oldest: int | None, newest: int = 0) -> Column:
    """Aggregate over rows dated ``day - oldest`` to ``day - newest``, inclusive.

    Meant for sums of amounts, which must not be formed by subtraction.
    """
    spec = Window.partitionBy(*keys).orderBy(F.unix_date(F.col(day)))
    start = Window.unboundedPreceding if oldest is None else -oldest
    return aggregate.over(spec.rangeBetween(start, -newest))


def month_index(day: str) -> Column:
    return F.year(day) * 12 + F.month(day)


def grid_points_covering(day: str, first: Column, last: Column, reach: int, step: int = 7) -> Column:
    """Grid dates ``d`` with ``day <= d < day + reach``; null when there are none."""
    to_grid = F.pmod(F.datediff(first, F.col(day)), F.lit(step))
    start = F.date_add(F.col(day), to_grid)
    end = F.least(F.date_add(F.col(day), reach - 1), last)
    return F.when(start <= end, F.sequence(start, end, F.expr(f"interval {step} days")))
