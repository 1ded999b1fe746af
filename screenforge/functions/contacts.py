"""Contact fields and skills read from resume text by rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from screenforge.functions.experience import OTHER_HEADINGS, WORK_HEADINGS, section
from screenforge.functions.text import strip

# Patterns without look-around, so that other regex engines read them the same way.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
PHONE = r"\+?\(?[0-9][0-9() .-]{7,17}[0-9]"
PHONE_LABEL = rf"(?im)^[ \t]*(?:phone|mobile|telephone|tel|cell)[^:\n]*:[ \t]*({PHONE})"
LOCATION = r"(?im)^[ \t]*(?:location|address|city)[ \t]*:[ \t]*([^\r\n]+)"
FIRST_LINE = r"\S[^\r\n]*"

SKILL_HEADINGS = ("skills", "technical skills", "key skills")


def _found(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(strip(F.regexp_extract(text, pattern, group)), F.lit(""))


def contact_email(text: Column) -> Column:
    """First email address, or null."""
    return _found(text, EMAIL, 0)


def contact_phone(text: Column) -> Column:
    """Number after the first phone label, else the first phone-like number, else null."""
    return F.coalesce(_found(text, PHONE_LABEL, 1), _found(text, PHONE, 0))


def contact_location(text: Column) -> Column:
    """Value of the first location label, or null."""
    return _found(text, LOCATION, 1)


def contact_name(text: Column) -> Column:
    """First line with text, or null."""
    return _found(text, FIRST_LINE, 0)


def listed_skills(text: Column) -> Column:
    """Flat distinct list from the skills sections: split at commas, semicolons, bars, bullets, lines."""
    body = section(text, SKILL_HEADINGS, SKILL_HEADINGS + WORK_HEADINGS + OTHER_HEADINGS)
    items = F.transform(F.split(body, r"[,;|•\n]"), lambda x: strip(F.regexp_replace(x, r"\A\s*[-*]\s+", "")))
    return F.array_distinct(F.filter(items, lambda x: x != ""))
