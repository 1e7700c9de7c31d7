"""Declared row contracts of the five business entities."""

from __future__ import annotations

from dataclasses import dataclass

# --- fixed values: fields, kinds and whether a row may lack them ---------------
CONTRACTS = {
    "visits": {
        "visit_id": "str", "facility_id": "str", "case_type": "str", "visit_date": "str", "billing_status": "str",
        "billed_amount": "float", "paid_amount": "float", "provider_id": "str",
        "patient_name": "str?", "patient_dob": "str?", "patient_ssn_last4": "str?", "patient_address": "str?",
    },
    "collections": {
        "collection_id": "str", "facility_id": "str", "attorney_id": "str", "case_type": "str",
        "collection_date": "str", "amount_collected": "float", "days_outstanding": "int",
    },
    "attorney_aging": {
        "attorney_id": "str", "facility_id": "str", "bucket_0_30": "float", "bucket_31_60": "float",
        "bucket_61_90": "float", "bucket_91_180": "float", "bucket_180_plus": "float", "report_date": "str",
    },
    "settlements": {
        "settlement_id": "str", "attorney_id": "str", "case_type": "str", "open_date": "str", "close_date": "str?",
        "settlement_amount": "float", "settlement_status": "str", "plaintiff_name": "str?", "plaintiff_dob": "str?",
    },
    "lop": {
        "lop_id": "str", "facility_id": "str", "case_type": "str", "issued_date": "str", "returned_date": "str?",
        "status": "str", "rejection_reason": "str?", "patient_name": "str?", "patient_dob": "str?",
    },
}
PRIMARY_KEYS = {
    "visits": ["visit_id"],
    "collections": ["collection_id"],
    "attorney_aging": ["attorney_id", "facility_id", "report_date"],
    "settlements": ["settlement_id"],
    "lop": ["lop_id"],
}
MISSING = "Field required"
BAD_NUMBER = "Input should be a valid number, unable to parse string as a number"
BAD_INTEGER = "Input should be a valid integer, unable to parse string as an integer"
SQL_TYPES = {"str": "string", "float": "double", "int": "bigint"}


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    required: bool

    @property
    def sql_type(self) -> str:
        return SQL_TYPES[self.kind]


def fields(entity: str) -> list[Field]:
    return [Field(n, k.rstrip("?"), not k.endswith("?")) for n, k in CONTRACTS[entity].items()]


def personal_columns(entity: str) -> list[str]:
    from ledgerwind.fixed_values import PHI_COLUMNS

    return PHI_COLUMNS.get(entity, [])


def curated_columns(entity: str) -> list[str]:
    hidden = set(personal_columns(entity))
    return [f.name for f in fields(entity) if f.name not in hidden]
