"""Fixed values. They are data, not logic: results depend on their exact text."""

# Study codes (ICD-10), in the order of the study's list.
STUDY_CODES = (
    "J100", "J101", "J108",
    "J110", "J111", "J118",
    "J120", "J121", "J122", "J123", "J128", "J129",
    "J13X", "J14X",
    "J150", "J151", "J152", "J153", "J154", "J155", "J156", "J157", "J158", "J159",
    "J160", "J168",
    "J170", "J171", "J172", "J173", "J178",
    "J180", "J181", "J182", "J188", "J189", "J09X",
    "J200", "J201", "J202", "J203", "J204", "J205", "J206", "J207", "J208", "J209",
    "J210", "J211", "J218", "J219",
    "J22X",
)

# The characters Unicode calls white space.
WHITE_SPACE = (
    "\t\n\v\f\r \u0085\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Subgroup prefixes kept by the normaliser. A prefix test, so "Grupo 10" is "Grupo 1".
SUBGROUPS = ("Grupo 1", "Grupo 2", "Grupo 3")

# Event duration classes: upper bound in months of 30 days (None = open) and label.
DURATION_CLASSES = (
    (1, "≤ 1 mes"),
    (2, "1 a 2 meses"),
    (3, "2 a 3 meses"),
    (None, "> 3 meses"),
)

# Long-stay ranges: right-closed upper bound in days (None = open) and label.
LONG_STAY_FLOOR_DAYS = 60
LONG_STAY_RANGES = (
    (90, "61-90d"),
    (120, "91-120d"),
    (180, "121-180d"),
    (365, "181-365d"),
    (None, ">365d"),
)

# Presence of a code in the two snapshots.
ABSENT_IN_BOTH = "Ausente en ambas"
ONLY_IN_OLD = "Solo en old"
ONLY_IN_NEW = "Solo en new"
PRESENT_IN_BOTH = "Presente en ambas"

# Care levels in rising order of severity: flag column and label.
CARE_LEVELS = (
    ("emergency", "Urgencias"),
    ("general_ward", "Hospitalización general"),
    ("intermediate", "Cuidados intermedios"),
    ("icu", "UCI"),
)

# Status of an error type.
NEEDS_REVIEW = "Requiere revisión"
NO_ERRORS = "Sin errores"

# Ages in months that belong to the study.
AGE_MONTHS_MIN = 0
AGE_MONTHS_MAX = 59

# Weekly compliance below this percentage is flagged.
COMPLIANCE_THRESHOLD = 80.0

# Rows shown of a duplicates listing.
TOP_DUPLICATES = 20

TOTAL = "TOTAL"
