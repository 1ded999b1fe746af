"""Years of experience: from a free-form value, and from a work history."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from screenforge.constants import NO_EXPERIENCE
from screenforge.functions.text import strip


def parse_experience(c: Column) -> Column:
    """Years from text. The first number is years; with the word "month" in the text a second
    number is months, whatever the order. No number, null and the empty words give 0.0."""
    s = F.lower(strip(c))
    numbers = F.regexp_extract_all(s, F.lit(r"\d+\.?\d*"), F.lit(0))
    years = F.get(numbers, F.lit(0)).try_cast("double")
    months = F.get(numbers, F.lit(1)).try_cast("double")
    total = F.when(F.contains(s, F.lit("month")) & months.isNotNull(), years + months / 12).otherwise(years)
    parsed = F.when(s.isin(*NO_EXPERIENCE), F.lit(0.0)).otherwise(F.round(total, 2))
    return F.coalesce(parsed, F.lit(0.0))


def numeric_experience(c: Column) -> Column:
    """A number as it is, unrounded and signed; null and NaN give 0.0."""
    return F.coalesce(F.nanvl(c.cast("double"), F.lit(0.0)), F.lit(0.0))


def clean_experience(df: DataFrame, source: str = "experience", target: str = "experience") -> DataFrame:
    """Set ``target`` to years as a double, by the type of ``source``."""
    kind = df.schema[source].dataType
    if isinstance(kind, T.NumericType):
        value = numeric_experience(F.col(source))
    elif isinstance(kind, T.ArrayType):
        # A list is read as its literal text: ['4', '2'] is 4 years.
        value = parse_experience(F.array_join(F.col(source).cast("array<string>"), ", "))
    else:
        value = parse_experience(F.col(source).cast("string"))
    return df.withColumn(target, value)


# --- Work history -------------------------------------------------------------------------------

# Headings that open and close the section of jobs (fixed values).
WORK_HEADINGS = (
    "work experience",
    "employment history",
    "professional experience",
    "work history",
    "experience",
)
OTHER_HEADINGS = (
    "education",
    "skills",
    "technical skills",
    "projects",
    "certifications",
    "summary",
    "objective",
    "profile",
    "languages",
    "interests",
    "references",
    "achievements",
    "awards",
    "contact",
)
OPEN_ENDS = ("till present", "till date", "present", "current", "ongoing", "now", "today", "date")
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

# A month and year: June 2019, Mar '19, 06/2019, 2019-06, or the year alone. Groups: name, number before, year, number after.
_POINT = rf"(?:(?:({'|'.join(MONTHS)})[a-z]*\.?,?\s+)|(0?[1-9]|1[0-2])[/.])?((?:19|20)\d{{2}}|['’]\d{{2}})(?:-(0[1-9]|1[0-2])(?!\d))?"
_RANGE = rf"(?i)(?<![\w/.]){_POINT}\s*(?:to|until|[-–—])\s*(?:({'|'.join(OPEN_ENDS)})\b|{_POINT})"
# Every range has a year of four digits or two behind an apostrophe.
_MAY_BE_RANGE = r"(?:19|20)\d\d|['’]\d\d"
_LENGTH = r"(?i)\b(\d+(?:\.\d+)?)\s*\+?\s*years?\b(?:\s*(?:and\s+)?(\d+)\s*months?\b)?"
_ONLY_MONTHS = r"(?i)\b(\d+)\s*\+?\s*months?\b"
_ITEM = r"^\s*[-*•·–]\s"
_AT_END = r"(?i)(?:years?|months?)\s*[).]?\s*$"
_HEADED = rf"(?i)^\s*(?:{'|'.join(WORK_HEADINGS)})\s*\("


def section(text: Column, headings: tuple[str, ...], closing: tuple[str, ...]) -> Column:
    """Lines under any of ``headings`` up to the next heading of ``closing``; every such part."""
    opening = rf"^[ \t]*(?:{'|'.join(headings)})[ \t]*:?[ \t]*\r?$"
    stop = rf"^[ \t]*(?:{'|'.join(closing)})[ \t]*:?[ \t]*\r?$"
    parts = F.regexp_extract_all(text, F.lit(rf"(?im){opening}((?s:.*?))(?={stop}|\z)"), F.lit(1))
    return F.array_join(parts, "\n")


def _groups(line: Column, pattern: str, count: int) -> Column:
    """All matches in a line, each as the array of its groups; an absent group is ``""``."""
    row = "|".join(f"${i}" for i in range(1, count + 1))
    return F.transform(
        F.regexp_extract_all(line, F.lit(pattern), F.lit(0)),
        lambda match: F.split(F.regexp_replace(match, pattern, row), r"\|", -1),
    )


def _month_number(name: Column) -> Column:
    """1 to 12 by the first three letters; 0 without a name."""
    at = F.position(F.lower(F.left(name, F.lit(3))), F.lit("".join(MONTHS)))
    return F.when(name == "", F.lit(0)).otherwise(((at + 2) / 3).cast("int"))


def _number(group: Column, kind: str = "int") -> Column:
    """An absent group is null without a cast: one that fails costs as much as the whole search."""
    return F.when(group != "", group.try_cast(kind))


def _point(name: Column, before: Column, year: Column, after: Column, as_of: dt.date) -> tuple[Column, Column]:
    """Month (0 without one) and year. Two digits are a year of the last hundred."""
    number = F.coalesce(_number(before), _number(after), F.lit(0))
    month = F.when(name != "", _month_number(name)).otherwise(number)
    short = F.right(year, F.lit(2)).try_cast("int")
    century = as_of.year // 100 * 100
    of_two = F.when(short > as_of.year % 100, short + century - 100).otherwise(short + century)
    return month, F.when(F.length(year) == 3, of_two).otherwise(_number(year))


def _range_points(groups: Column, as_of: dt.date) -> Column:
    """The two points of a range, and whether the second is open."""
    month1, year1 = _point(groups[0], groups[1], groups[2], groups[3], as_of)
    month2, year2 = _point(groups[5], groups[6], groups[7], groups[8], as_of)
    columns = {"month1": month1, "year1": year1, "month2": month2, "year2": year2, "open": groups[4] != ""}
    return F.struct(*[c.alias(name) for name, c in columns.items()])


def _range_months(p: Column, as_of: dt.date) -> Column:
    """Months between the two points of a range."""
    months = (
        F.when(p["open"] & (p["month1"] > 0), (as_of.year - p["year1"]) * 12 + (as_of.month - p["month1"]))
        .when(p["open"], (as_of.year - p["year1"]) * 12)
        .when((p["month1"] > 0) & (p["month2"] > 0), (p["year2"] - p["year1"]) * 12 + (p["month2"] - p["month1"]) + 1)
        .otherwise((p["year2"] - p["year1"]) * 12)
    )
    return F.greatest(months, F.lit(0)).cast("double")


def _length_months(groups: Column) -> Column:
    """Months of (years, months)."""
    return groups[0].try_cast("double") * 12 + F.coalesce(_number(groups[1], "double"), F.lit(0.0))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def work_history_years(text: Column, as_of: dt.date) -> Column:
    """Total years over all jobs of the work sections; 0.0 without such a section.

    A job line counts by its date range, else by its stated length. Inside a listed item, and not at its
    end, a length counts only where no line has a range: under a dated job it tells of something else. One
    in brackets after a heading never counts. Overlapping jobs add up. Claims outside the work sections are ignored.
    """
    body = section(text, WORK_HEADINGS, WORK_HEADINGS + OTHER_HEADINGS)

    # Each step is an array of its own, so that nothing is searched or reckoned twice, and what a range decides is not
    # searched any further. Without a digit a line has neither range nor length.
    lines = F.filter(F.split(body, "\n"), lambda line: F.rlike(line, F.lit("[0-9]")))
    none = F.array().cast("array<array<string>>")

    def says(line: Column, word: str) -> Column:
        return F.contains(F.lower(line), F.lit(word))

    found = F.transform(
        lines,
        lambda line: F.struct(
            line.alias("line"), F.when(F.rlike(line, F.lit(_MAY_BE_RANGE)), _groups(line, _RANGE, 9)).otherwise(none).alias("ranges")
        ),
    )

    def told(x: Column) -> Column:
        ranged, line = F.cardinality(x["ranges"]) > 0, x["line"]
        counts = ~ranged & ~F.rlike(line, F.lit(_HEADED))
        return F.struct(
            ranged.alias("ranged"),
            F.transform(x["ranges"], lambda g: _range_points(g, as_of)).alias("points"),
            F.when(counts & says(line, "year"), _groups(line, _LENGTH, 2)).otherwise(none).alias("lengths"),
            F.when(counts & says(line, "month"), F.regexp_extract_all(line, F.lit(_ONLY_MONTHS), F.lit(1)))
            .otherwise(F.array().cast("array<string>"))
            .alias("months"),
            (~ranged & F.rlike(line, F.lit(_ITEM)) & ~F.rlike(line, F.lit(_AT_END))).alias("aside"),
        )

    per_line = F.transform(
        F.transform(found, told),
        lambda x: F.struct(
            x["ranged"].alias("ranged"),
            x["aside"].alias("aside"),
            F.when(x["ranged"], _sum(F.transform(x["points"], lambda p: _range_months(p, as_of))))
            .when(F.cardinality(x["lengths"]) > 0, _sum(F.transform(x["lengths"], _length_months)))
            .otherwise(_sum(F.transform(x["months"], lambda m: m.try_cast("double"))))
            .alias("months"),
        ),
    )
    # Lengths aside count only where no line has a range, which is known after the last line.
    months = F.aggregate(
        per_line,
        F.struct(F.lit(0.0).alias("every"), F.lit(0.0).alias("main"), F.lit(False).alias("dated")),
        lambda total, x: F.struct(
            (total["every"] + x["months"]).alias("every"),
            F.when(x["aside"], total["main"]).otherwise(total["main"] + x["months"]).alias("main"),
            (total["dated"] | x["ranged"]).alias("dated"),
        ),
        lambda total: F.when(total["dated"], total["main"]).otherwise(total["every"]),
    )
    return F.coalesce(F.round(months / 12, 2), F.lit(0.0))
