"""Fixed values.

Every literal below must equal the published behaviour for results to agree
(word lists, patterns, thresholds, formats).  They are stated once, as plain
text, and everything else in the package refers to them by name.
"""

# --- fixed values: entities and their columns -------------------------------
ENTITY_DIMENSIONS = {
    "facility": "facility_id",
    "attorney": "attorney_id",
    "case_type": "case_type",
}

AGING_BUCKETS = [
    "bucket_0_30",
    "bucket_31_60",
    "bucket_61_90",
    "bucket_91_180",
    "bucket_180_plus",
]
AGING_BUCKET_MIDPOINT_DAYS = [15, 45, 75, 135, 270]

PHI_COLUMNS = {
    "visits": ["patient_name", "patient_dob", "patient_ssn_last4", "patient_address"],
    "settlements": ["plaintiff_name", "plaintiff_dob"],
    "lop": ["patient_name", "patient_dob"],
}

# --- fixed values: feature groups -------------------------------------------
FEATURE_NAMES = {
    "facility_collections": [
        "collections_1d",
        "collections_7d_rolling",
        "collections_30d_rolling",
        "collections_mom_growth",
        "collections_yoy_growth",
        "day_of_week",
        "month",
        "is_month_end",
    ],
    "attorney_aging": [
        "bucket_0_30_balance",
        "bucket_31_60_balance",
        "bucket_61_90_balance",
        "bucket_91_180_balance",
        "bucket_180_plus_balance",
        "total_outstanding",
        "pct_180_plus",
        "avg_days_outstanding",
        "aging_migration_rate_30d",
    ],
    "visit_velocity": [
        "new_visits_7d",
        "new_visits_30d",
        "visit_cancellation_rate_7d",
        "new_case_open_rate_7d",
        "visit_billing_conversion_rate",
    ],
    "settlement_pipeline": [
        "open_settlements_count",
        "settlements_closed_30d",
        "avg_days_to_settlement_90d",
        "settlement_velocity_change_30d",
        "high_value_open_count",
    ],
    "lop_metrics": [
        "lop_issued_7d",
        "lop_returned_7d",
        "lop_rejection_rate_30d",
        "lop_turnaround_days_p50",
        "lop_turnaround_days_p90",
        "lop_backlog_count",
    ],
}
FEATURE_KEYS = {
    "facility_collections": ["facility_id"],
    "attorney_aging": ["attorney_id"],
    "visit_velocity": ["facility_id", "case_type"],
    "settlement_pipeline": ["attorney_id", "case_type"],
    "lop_metrics": ["facility_id"],
}
HIGH_VALUE_SETTLEMENT = 50000.0
MONTH_END_FROM_DAY = 28

# --- fixed values: data quality ----------------------------------------------
NOT_NULL_RULES = {
    "collections": ["facility_id", "collection_date", "amount_collected"],
    "visits": ["facility_id", "visit_date", "billing_status"],
    "attorney_aging": ["attorney_id", "report_date"],
    "settlements": ["settlement_id", "open_date"],
    "lop": ["lop_id", "issued_date", "status"],
}
NOT_NEGATIVE_RULES = {
    "collections": ["amount_collected"],
    "visits": ["billed_amount", "paid_amount"],
    "attorney_aging": ["bucket_0_30", "bucket_180_plus"],
    "settlements": ["settlement_amount"],
    "lop": [],
}
MAX_NULL_RATE = 0.02
MAX_RECORD_DROP = 0.20
ERROR_SAMPLES_PER_ENTITY = 5
SEVERITIES = ["P1", "P2", "P3"]
ALERT_STATUSES = ["open", "acknowledged"]
MODEL_STAGES = ["Staging", "Production", "Archived"]

# --- fixed values: forecasting -----------------------------------------------
Z80 = 1.2816
Z95 = 1.96
HORIZONS = [30, 60, 90]
MIN_HISTORY_DAYS = 30
BACKTEST_FOLDS = 4
PROMOTE_WITHIN_PP = 1.0
BLOCK_BEYOND_PP = 3.0

# --- fixed values: anomaly thresholds ----------------------------------------
DEFAULT_THRESHOLDS = {
    "forecast_deviation": {"p2_pct": -0.15, "p1_pct": -0.25},
    "cusum": {"k": 0.5, "p2_sigma": 4.0, "p1_sigma": 6.0, "window": 90},
    "isolation_forest": {"contamination": 0.03, "p2_score": -0.10, "p1_score": -0.30},
}
SEVERITY_RANK = {"P1": 3, "P2": 2, "P3": 1}
SEVERITY_LABEL = {"P1": "P1 Critical", "P2": "P2 Warning", "P3": "P3 Info"}
VELOCITY_SIGNAL_BELOW = -0.15
TURNAROUND_SIGNAL_ABOVE_DAYS = 45
NO_DRIVER_TEXT = "No single dominant driver identified in current feature signals."

# --- fixed values: personal-data patterns ------------------------------------
# Order matters: the first label that matches is the one reported.  The names
# are written with explicit ASCII classes so both regex dialects agree.
PHI_PATTERNS = [
    ("SSN", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("DOB_REF", r"(?i)\b(DOB|date of birth|born on)\b"),
    ("PATIENT_NAME_REQUEST", r"(?i)\bpatient name\b"),
    ("PATIENT_FIELD_REQUEST", r"(?i)\bpatient(?:'s)?\s+(name|dob|ssn|address|identity)\b"),
]
PROPER_NAME_PATTERN = r"\b[A-Z][a-z]{2,}\s+[A-Z][a-z]{2,}\b"
PERSON_LABEL = "PERSON_ENTITY_DETECTED"
REDACTED = "[REDACTED]"
ALLOWED_NAME_WORDS = [
    "attorney", "attorneys", "provider", "providers", "facility", "facilities",
    "dr", "doctor", "firm", "office", "report", "summary", "collections",
    "round", "rock", "cedar", "park", "new", "braunfels", "san", "antonio",
    "johnson", "smith", "garcia", "lee", "patel",
    "personal", "injury", "letter", "protection", "commercial", "athena",
]

# --- fixed values: query screening -------------------------------------------
MUTATION_PATTERNS = [
    r"\bdrop\s+table\b",
    r"\bdelete\s+from\b",
    r"\bupdate\s+\w+\s+set\b",
    r"\binsert\s+into\b",
    r"\balter\s+table\b",
    r"\bcreate\s+table\b",
    r"\btruncate\s+table\b",
]
ROW_CAP = 10_000
PREVIEW_ROW_CAP = 200

# --- fixed values: retrieval --------------------------------------------------
DOMAIN_TERMS = [
    "aging", "alert", "anomaly", "attorney", "balance", "billing", "case",
    "cash", "collection", "collections", "collect", "collected", "facility",
    "forecast", "insurance", "lop", "outstanding", "payment", "payments",
    "performance", "revenue", "settlement", "visit", "visits",
]
EMBEDDING_DIM = 256
TOP_K = 8
CONTEXT_K = 4
SIMILARITY_THRESHOLD = 0.15
ALERT_DOCUMENTS = 100
RECORD_FIELDS = ["source_doc_id", "entity_type", "entity_id", "date", "text"]

# --- fixed values: audit ------------------------------------------------------
AUDIT_FIELDS = [
    "event_id", "ts", "user_id", "user_role", "service", "action", "query_hash",
    "input_phi_scan", "output_phi_scan", "llm_model", "retrieved_sources",
    "generated_sql", "response_latency_ms", "session_id", "detail_json",
]

# --- fixed values: request limits ---------------------------------------------
RATE_LIMIT_REQUESTS = 120
RATE_LIMIT_SECONDS = 60

# --- fixed values: answers that refuse ------------------------------------------
INSUFFICIENT = "I don't have enough information to answer this reliably. Please check with the DA team."
BLOCKED = (
    "This request appears to ask for individual patient information, "
    "which I can't provide. Please ask about aggregated financial metrics."
)

# --- fixed values: characters that part words ------------------------------------
BLANKS = r"\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
