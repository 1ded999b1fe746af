"""Text cleaning: strip, role names, email keys, skill lists, title case."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from screenforge.constants import FORMAT_SUFFIXES, ROLE_ALIASES

# The characters Python's str.strip() removes (fixed values).
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column) -> Column:
    """Remove white space of every kind from both ends."""
    return F.btrim(c, F.lit(WHITESPACE))


def is_blank(c: Column) -> Column:
    """True for null, empty and white-space-only text."""
    return F.coalesce(strip(c) == "", F.lit(True))


def resolve_role(c: Column) -> Column:
    """Lower-case a role and follow its alias. Not trimmed."""
    role = F.lower(c)
    out = role
    for alias, target in ROLE_ALIASES.items():
        out = F.when(role == alias, F.lit(target)).otherwise(out)
    return out


def email_key(c: Column) -> Column:
    """Trimmed lower-case email; null when there is none, so that it never equals another."""
    return F.nullif(F.lower(strip(c)), F.lit(""))


def split_skills(c: Column) -> Column:
    """Comma list to trimmed lower-case items. Blank text gives ``[]``; empty items are kept."""
    items = F.transform(F.split(c, ","), lambda x: F.lower(strip(x)))
    return F.when(is_blank(c), F.array().cast("array<string>")).otherwise(items)


def present_skills(arr: Column) -> Column:
    """Lower-case skills without nulls and blanks, as the scorer compares them."""
    lowered = F.transform(arr, lambda x: F.lower(strip(x)))
    return F.coalesce(F.filter(lowered, lambda x: x != ""), F.array().cast("array<string>"))


def skill_count(arr: Column) -> Column:
    """Number of skills; 0 for null."""
    return F.coalesce(F.cardinality(arr), F.lit(0))


def title_case(c: Column) -> Column:
    """Upper-case the first letter of every run of letters, lower-case the rest of it."""
    runs = F.regexp_extract_all(c, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    titled = F.transform(runs, lambda r: F.concat(F.upper(F.left(r, F.lit(1))), F.lower(F.substr(r, F.lit(2)))))
    return F.array_join(titled, "")


def valid_email(c: Column) -> Column:
    """Not empty and with an ``@``; null counts as invalid."""
    return F.coalesce(F.contains(c, F.lit("@")), F.lit(False))


def file_format(path: Column) -> Column:
    """Format by file name ending, case-sensitive; ``unknown`` for the rest."""
    out = F.lit("unknown")
    for suffix, fmt in FORMAT_SUFFIXES.items():
        out = F.when(path.endswith(suffix), F.lit(fmt)).otherwise(out)
    return out


def escape_html(c: Column) -> Column:
    """Make text safe inside an HTML element."""
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c
