"""Fixed values that must equal the behaviour being reproduced.

Everything in this module is a FIXED VALUE: pattern texts, type sets,
reward weights, parameter bounds and token markers.  They are listed
plainly and in their natural order; the logic that uses them lives in
``cloakline.operators`` and ``cloakline.functions``.
"""

from __future__ import annotations

# --- FIXED VALUES: seed pattern table (label, regex, type, cached role) ---
SEED_PATTERNS: list[tuple[str, str, str, str | None]] = [
    ("SSN_standard", r"\b\d{3}-\d{2}-\d{4}\b", "SSN", None),
    ("PHONE_us_dashes", r"\b\d{3}-\d{3}-\d{4}\b", "PHONE", None),
    ("PHONE_us_dots", r"\b\d{3}\.\d{3}\.\d{4}\b", "PHONE", None),
    ("PHONE_us_parens", r"\(\d{3}\)\s*\d{3}-\d{4}", "PHONE", None),
    ("EMAIL_standard", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", "EMAIL", None),
    ("DATE_mdy_slash", r"\b\d{1,2}/\d{1,2}/\d{2,4}\b", "DATE", None),
    ("DATE_mdy_dash", r"\b\d{1,2}-\d{1,2}-\d{2,4}\b", "DATE", None),
    (
        "DATE_month_name",
        r"\b(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|"
        r"Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|"
        r"Nov(?:ember)?|Dec(?:ember)?)\s+\d{1,2}(?:st|nd|rd|th)?,?\s+\d{4}\b",
        "DATE",
        None,
    ),
    ("AGE_year_old", r"\b\d{1,3}[-\s]year[-\s]old\b", "AGE", "a middle-aged adult"),
    ("AGE_years_of_age", r"\b\d{1,3}\s+years?\s+of\s+age\b", "AGE", "a middle-aged adult"),
    ("LOCATION_zip", r"\b\d{5}(?:-\d{4})?\b", "LOCATION", "a local area"),
    ("CREDIT_CARD_visa", r"\b4\d{3}[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{4}\b", "CREDIT_CARD", None),
    ("CREDIT_CARD_generic", r"\b\d{4}[\s\-]\d{4}[\s\-]\d{4}[\s\-]\d{4}\b", "CREDIT_CARD", None),
    ("ID_NUMBER_mrn", r"\bMRN\s*[:#]?\s*\d{5,10}\b", "ID_NUMBER", None),
    ("ID_NUMBER_patient", r"\bPatient\s+ID\s*[:#]?\s*\d{4,10}\b", "ID_NUMBER", None),
    ("RELATIONSHIP_spouse", r"\b(?:wife|husband|spouse|partner)\b", "RELATIONSHIP", "a family member"),
    ("RELATIONSHIP_child", r"\b(?:son|daughter|child|children)\b", "RELATIONSHIP", "a family member"),
]

# --- FIXED VALUES: a character every match of a seed must contain ---
# (a mandatory \d, or the mandatory '@' of the e-mail seed); used only as an
# exact prefilter, and only when a pattern's regex is exactly the seed text.
SEED_REQUIRES = {
    "SSN_standard": "digit",
    "PHONE_us_dashes": "digit",
    "PHONE_us_dots": "digit",
    "PHONE_us_parens": "digit",
    "EMAIL_standard": "at",
    "DATE_mdy_slash": "digit",
    "DATE_mdy_dash": "digit",
    "DATE_month_name": "digit",
    "AGE_year_old": "digit",
    "AGE_years_of_age": "digit",
    "LOCATION_zip": "digit",
    "CREDIT_CARD_visa": "digit",
    "CREDIT_CARD_generic": "digit",
    "ID_NUMBER_mrn": "digit",
    "ID_NUMBER_patient": "digit",
}

# --- FIXED VALUES: seed row counters ---
SEED_HITS = 48
SEED_MISSES = 2
SEED_CONFIDENCE = 0.96
SEED_PROMOTED = True
SEED_DATE = "2026-04-02"

# --- FIXED VALUES: routing ---
ENCRYPT_TYPES = ["SSN", "DOB", "PHONE", "EMAIL", "ID_NUMBER", "CREDIT_CARD", "DATE"]
UNKNOWN_TYPE = "UNKNOWN"
REDACTED = "[REDACTED]"
ENCRYPT_MARKER = "<<ENC:"
ENCRYPT_END = ":ENC>>"

# --- FIXED VALUES: pattern memory life cycle ---
HIT_PROMOTE_THRESHOLD = 20
PROMOTE_CONFIDENCE_ABOVE = 0.75
CONFIDENCE_PRUNE_BELOW = 0.40
PRUNE_MIN_OBSERVATIONS = 10
MAX_MEMORY_ENTRIES = 200
NEW_PATTERN_CONFIDENCE = 0.5

# --- FIXED VALUES: rewards ---
REWARD_CORRECT_REDACTION = 1.0
REWARD_MISSED_PHI = -1.0
REWARD_OVER_ENCRYPTION = -0.5
REWARD_CACHE_HIT = 0.3
REWARD_UTILITY_PRESERVED = 0.5

# --- FIXED VALUES: control parameters (defaults, bounds, steps) ---
SENSITIVITY_DEFAULT = 0.7
SENSITIVITY_MIN = 0.3
SENSITIVITY_MAX = 1.0
SENSITIVITY_STEP = 0.05
MIN_CONFIDENCE_DEFAULT = 0.75
MIN_CONFIDENCE_MIN = 0.50
MIN_CONFIDENCE_MAX = 0.95
MIN_CONFIDENCE_UP = 0.02
MIN_CONFIDENCE_DOWN = 0.01
DETECTOR_DEFAULT_CONFIDENCE = 0.5

# --- FIXED VALUES: critic defaults ---
DEFAULT_LEAKAGE_CONFIDENCE = 0.5
DEFAULT_FLUENCY_SCORE = 0.5
DEFAULT_FLUENCY_REASON = "unknown"

# --- FIXED VALUES: entity label map of the recogniser baseline ---
ENTITY_LABEL_MAP = [
    ("PERSON", "PERSON"),
    ("ORG", "ORG"),
    ("GPE", "LOCATION"),
    ("LOC", "LOCATION"),
    ("DATE", "DATE"),
    ("TIME", "DATE"),
    ("CARDINAL", "AGE"),
    ("MONEY", "CREDIT_CARD"),
]

# --- FIXED VALUES: evaluation ---
SNAPSHOT_EVERY = 50
WINDOW_SIZE = 100
ABSTRACT_PHRASE_MAX_WORDS = 6
LEARNED_LABEL_PREFIX_CHARS = 8

# --- our own: the seed that the feedback fixture of the queries puts below the threshold ---
DOUBTED_SEED = "LOCATION_zip"
