"""Requests, their weights, and the weighted score of a candidate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenforge.constants import DEFAULT_WEIGHTS, RAW_SIMILARITY_CUT, ROLE_WEIGHTS
from screenforge.functions.text import present_skills, resolve_role, split_skills
from screenforge.functions.vectors import set_cosine100, unit_dot100
from screenforge.operators.filters import any_filter, location_matches, meets_experience, meets_location
from screenforge.operators.joins import lookup_join, spread_join

WEIGHT_COLUMNS = ("w_skills", "w_experience", "w_location")


def add_weights(df: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """Add the three weights of ``role``.

    Without ``table`` (``role`` and the three weight columns) the built-in weights are used, as
    an expression. A role that is not listed gets the default weights.
    """
    if table is not None:
        joined = lookup_join(df, table.select("role", *WEIGHT_COLUMNS), "role", "left")
        return joined.withColumns(
            {c: F.coalesce(F.col(c), F.lit(d)) for c, d in zip(WEIGHT_COLUMNS, DEFAULT_WEIGHTS, strict=True)}
        )
    out = {}
    for position, name in enumerate(WEIGHT_COLUMNS):
        value = F.lit(DEFAULT_WEIGHTS[position])
        for role, weights in ROLE_WEIGHTS.items():
            value = F.when(F.col("role") == role, F.lit(weights[position])).otherwise(value)
        out[name] = value
    return df.withColumns(out)


def prepare_requests(requests: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Form fields to the columns the matcher uses. Missing fields mean no restriction."""
    skills = F.coalesce(F.col("skills"), F.lit(""))
    experience = F.coalesce(F.col("experience"), F.lit(0.0))
    location = F.coalesce(F.col("location"), F.lit(""))
    prepared = requests.select(
        "request_id",
        resolve_role(F.col("role")).alias("role"),
        present_skills(split_skills(skills)).alias("job_skills"),
        experience.alias("min_experience"),
        F.lower(location).alias("wanted_location"),
        any_filter(skills, experience, location).alias("any_filter"),
    )
    return add_weights(prepared, weights)


def match(candidates: DataFrame, requests: DataFrame, max_broadcast: int = 10_000, regex: bool = False) -> DataFrame:
    """Pairs of a prepared request and a candidate of its role that pass both pre-filters.

    With ``regex`` the wanted location is a regular expression. Pairs become rows: meant for few requests.
    """
    pairs = spread_join(candidates, requests, "role", "application_id", max_broadcast)
    return pairs.where(
        meets_experience(F.col("experience"), F.col("min_experience"))
        & meets_location(F.col("location"), F.col("wanted_location"), regex)
    )


def word_similarity() -> Column:
    """Raw similarity of the two skill lists by the words they share."""
    return set_cosine100(F.array_distinct(present_skills(F.col("skills"))), F.array_distinct(F.col("job_skills")))


def vector_similarity() -> Column:
    """Raw similarity of the two unit vectors; 0 where a list is empty or unknown."""
    return unit_dot100(F.col("vector"), F.col("job_vector"))


def add_score(pairs: DataFrame, raw: Column, cut: float = RAW_SIMILARITY_CUT, regex: bool = False) -> DataFrame:
    """Add ``raw_similarity`` and ``score`` (0-100, two decimals)."""
    wants_skills = F.cardinality("job_skills") > 0
    raw_similarity = F.when(wants_skills, F.coalesce(raw, F.lit(0.0))).otherwise(F.lit(0.0))
    similar = F.col("raw_similarity")
    points = (
        similar * F.col("w_skills") / 100
        + F.when(F.col("experience") >= F.col("min_experience"), F.col("w_experience")).otherwise(F.lit(0))
        + F.when(
            (F.col("wanted_location") != "") & location_matches(F.col("location"), F.col("wanted_location"), regex),
            F.col("w_location"),
        ).otherwise(F.lit(0))
    )
    score = (
        F.when(wants_skills & (similar < cut), F.lit(0.0))
        .when(~wants_skills & (points == 0), F.lit(1.0))
        .otherwise(F.floor(points * 100 + 0.5) / 100)  # as in the blocks of ranking.shortlists, ties included
    )
    return pairs.withColumn("raw_similarity", raw_similarity).withColumn("score", score)
