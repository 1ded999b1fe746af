"""Fixed values. They decide the results, so they are stated here in one place."""

# Weights of skills, experience and location per role; each row sums to 100.
ROLE_WEIGHTS = {
    "datascience": (60, 25, 15),
    "developer": (50, 30, 20),
    "testing": (40, 40, 20),
    "data_engineer": (60, 30, 10),
    "cloud_engineer": (70, 20, 10),
    "hr": (30, 40, 30),
}
DEFAULT_WEIGHTS = (50, 30, 20)

# Role names that mean another role.
ROLE_ALIASES = {"qa": "testing"}

# Experience texts that mean zero years.
NO_EXPERIENCE = ("", "nan", "none", "fresher", "freshers", "n/a", "-")

# A raw similarity (0-100) below this scores zero.
RAW_SIMILARITY_CUT = 15.0

# Rows in a shortlist.
SHORTLIST_SIZE = 5

# Role shown when none is chosen.
DEFAULT_ROLE = "developer"

# File name endings per format; matching is case-sensitive.
FORMAT_SUFFIXES = {
    ".pdf": "pdf",
    ".docx": "docx",
    ".png": "image",
    ".jpg": "image",
    ".jpeg": "image",
    ".txt": "txt",
    ".odt": "odt",
}

# An error with one of these is a used-up quota.
QUOTA_WORDS = ("quota", "429")
