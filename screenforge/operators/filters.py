"""Row filters of intake and matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenforge.constants import RAW_SIMILARITY_CUT
from screenforge.functions.text import is_blank


def has_name(name: Column) -> Column:
    """An extraction counts only with a name; error rows have none."""
    return F.coalesce(name != "", F.lit(False))


def valid_extractions(df: DataFrame) -> DataFrame:
    return df.where(has_name(F.col("name")))


def rejected_extractions(df: DataFrame) -> DataFrame:
    return df.where(~has_name(F.col("name")))


def drop_nameless(df: DataFrame) -> DataFrame:
    """Drop null names and the text ``nan``."""
    return df.where(F.col("name").isNotNull() & (F.col("name") != "nan"))


def meets_experience(experience: Column, minimum: Column) -> Column:
    """A minimum above zero must be reached; otherwise every row passes."""
    return (minimum <= 0) | (experience >= minimum)


def location_matches(location: Column, wanted: Column, regex: bool = False) -> Column:
    """Case-insensitive: ``wanted`` occurs in ``location``. A null location never matches."""
    place = F.lower(location)
    found = F.regexp_like(place, F.lower(wanted)) if regex else F.contains(place, F.lower(wanted))
    return F.coalesce(found, F.lit(False))


def meets_location(location: Column, wanted: Column, regex: bool = False) -> Column:
    """An empty ``wanted`` lets every row pass."""
    return (wanted == "") | location_matches(location, wanted, regex)


def cut_similarity(raw: Column, cut: float = RAW_SIMILARITY_CUT) -> Column:
    """Raw similarity, or 0.0 where it lies below ``cut``."""
    return F.when(raw < cut, F.lit(0.0)).otherwise(raw)


def any_filter(skills: Column, experience: Column, location: Column) -> Column:
    """True when a request restricts anything. Skills of blanks and commas only do not count."""
    return (
        ~is_blank(F.replace(skills, F.lit(","), F.lit("")))
        | (F.coalesce(experience, F.lit(0.0)) != 0)
        | (F.coalesce(location, F.lit("")) != "")
    )


def has_experience(df: DataFrame) -> DataFrame:
    return df.where(F.col("experience") > 0)


def positive_score(df: DataFrame) -> DataFrame:
    """Keep scores above zero where the request filters; rows of other requests all stay."""
    return df.where(~F.col("any_filter") | (F.col("score") > 0))
