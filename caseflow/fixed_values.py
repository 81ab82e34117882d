"""Texts, codes and numbers the results depend on.

All of them are defaults of the functions that use them, so another site can
pass its own.
"""

# Note headings, in the letter cases that are searched for.
CHIEF_COMPLAINT = ("Chief Complaint", "CHIEF COMPLAINT")
PHYSICAL_EXAM = ("Physical Exam", "PHYSICAL EXAM")
INITIAL_ASSESSMENT = ("Initial Assessment", "INITIAL ASSESSMENT")
ED_COURSE = ("ED Course", "ED course", "ED COURSE")

# Texts that stand for "nothing there".
NO_ADMISSION = "-1"
NO_SECTION = "unable_to_extract"
NO_RESPONSE = "response_error"

# Cohort filters.
ADULT_AGE = 18
DAYS_PER_YEAR = 365.25
NOTE_TYPE = "ED Provider Notes"
SPECIALTIES = ("Emergency Medicine",)  # a site adds its own codes
IMAGING_PREFIXES = ("XR", "US ", "POC US ", "CT ", "IR CT ", "MR ")
MEDICATION_CLASS = "ANTIBIOTICS"

# Fixed value: timestamp format of the source tables. Order dates and times are held
# apart as yyyy-MM-dd and HH:mm.
TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"

# Code lists of the human labels.
YES_NO = {"Y": 1, "N": 0}
MODALITY = {"N": 0, "XR": 1, "CT": 1, "US": 1, "MRI": 1}

# Sizes, seed, limits and price.
SEED = 7
BALANCED_PER_CLASS = 5000
UNBALANCED_ROWS = 1000
LABELLING_ROWS = 200
TOKEN_LIMIT = 4000
CHARS_PER_TOKEN = 4
PRICE_PER_1000_TOKENS = 0.002

# Column suffixes of the four prompt variants.
VARIANTS = (1, 2, 3, 4)
SUFFIX = "_history_examination"
PROMPT_COLUMNS = tuple(f"prompt{SUFFIX}{v}" for v in VARIANTS)
LABEL_COLUMNS = tuple(f"label{SUFFIX}{v}" for v in VARIANTS)
CONTENT_COLUMNS = tuple(f"response_content{SUFFIX}{v}" for v in VARIANTS)

# Task names and the outcome column of each.
OUTCOMES = {
    "admitted": "admitted",
    "imaging_orders_binary": "imaging_orders_binary",
    "abx_ordered_ed": "abx_ordered_ed",
}
