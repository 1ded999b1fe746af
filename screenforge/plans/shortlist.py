"""Candidates and job requests to ranked lists."""

from __future__ import annotations

from math import ceil
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from screenforge.constants import DEFAULT_ROLE, RAW_SIMILARITY_CUT, SHORTLIST_SIZE
from screenforge.functions.experience import clean_experience
from screenforge.operators.filters import meets_experience, meets_location, positive_score
from screenforge.operators.joins import shuffle_width, spread_join
from screenforge.operators.pruning import ROWS_PER_CLUSTER, PrunedSearch, known_skills, pruned_shortlists
from screenforge.operators.ranking import by_experience, finalists, most_experienced, rank_matches, role_grid, shortlists, top_matches
from screenforge.operators.scoring import add_score, match, prepare_requests, vector_similarity
from screenforge.operators.similarity import add_skill_vector
from screenforge.session import materialize
from screenforge.sources.candidates import read_candidates, with_score_column

# Candidates, or requests, of one block, which one task holds in memory with their vectors.
ROWS_PER_BLOCK = 50_000
LEAST_ROWS_PER_BLOCK = 2_000
# More requests of one search are joined by shuffle.
MOST_REQUESTS = 10_000


def with_job_vectors(requests: DataFrame, skill_vectors: DataFrame) -> DataFrame:
    """One vector per request, computed once and not once per candidate."""
    return add_skill_vector(requests, skill_vectors, "request_id", "job_skills", "job_vector")


def score_matches(
    candidates: DataFrame, requests: DataFrame, raw: Column | None = None, cut: float = RAW_SIMILARITY_CUT, regex: bool = False
) -> DataFrame:
    """Every match of every prepared request with its score, unordered."""
    raw = vector_similarity() if raw is None else raw
    return positive_score(add_score(match(candidates, requests, regex=regex), raw, cut, regex))


def list_matches(
    candidates: DataFrame, requests: DataFrame, raw: Column | None = None, cut: float = RAW_SIMILARITY_CUT, regex: bool = False
) -> DataFrame:
    """Every match of every prepared request, in order. For many requests use :func:`shortlist_many`."""
    return rank_matches(score_matches(candidates, requests, raw, cut, regex))


def shortlist_many(
    candidates: DataFrame,
    requests: DataFrame,
    skill_vectors: DataFrame,
    k: int = SHORTLIST_SIZE,
    cut: float = RAW_SIMILARITY_CUT,
    weights: DataFrame | None = None,
) -> DataFrame:
    """First ``k`` candidates of each raw job request; ``weights`` as in :func:`prepare_requests`.

    Candidates no request can list are cut before vectors are looked up for the rest, unless
    ``candidates`` already carry ``vector``. The rest is written to the scratch folder: the lookup
    reads it twice, and the row counts per role set the numbers of blocks.
    """
    spark = candidates.sparkSession
    able = materialize(finalists(candidates, k), "finalists")
    jobs = prepare_requests(requests, weights)
    # All tasks get work where there is enough, and no block is larger than a task can hold.
    rows = min(ROWS_PER_BLOCK, max(LEAST_ROWS_PER_BLOCK, ceil(able.count() / shuffle_width(spark))))
    grid = materialize(role_grid(able, jobs, rows, ROWS_PER_BLOCK), "grid")
    if "vector" not in able.columns:
        able = add_skill_vector(able, skill_vectors, "application_id")
    return shortlists(able, with_job_vectors(jobs, skill_vectors), k, cut, grid=grid)


def shortlist_pruned(
    candidates: DataFrame,
    requests: DataFrame,
    skill_vectors: DataFrame,
    k: int = SHORTLIST_SIZE,
    cut: float = RAW_SIMILARITY_CUT,
    weights: DataFrame | None = None,
    rows_per_cluster: int = ROWS_PER_CLUSTER,
) -> PrunedSearch:
    """The same rows as :func:`shortlist_many`, opening only the clusters of candidates that can hold one of them.

    Worth it where vectors of a role differ much and requests name skills; beside the rows it tells how many clusters each
    request has opened. Where candidates carry no ``vector`` and the skill vectors are few enough for every task to hold them, no
    vector is written or shuffled.
    """
    able = materialize(finalists(candidates, k), "finalists")
    skills = None if "vector" in able.columns else known_skills(skill_vectors)
    if "vector" not in able.columns and skills is None:
        able = add_skill_vector(able, skill_vectors, "application_id")
    jobs = with_job_vectors(prepare_requests(requests, weights), skill_vectors)
    return pruned_shortlists(able, jobs, k, cut, rows_per_cluster, ROWS_PER_BLOCK, skills)


class Search(NamedTuple):
    """What one search shows: matches in order, the whole role by experience, the first matches, and counts of rows."""

    ranked: DataFrame
    listing: DataFrame
    top: DataFrame
    counts: dict[str, int]


def search(
    candidates: DataFrame, requests: DataFrame, raw: Column | None = None, k: int = SHORTLIST_SIZE, cut: float = RAW_SIMILARITY_CUT, regex: bool = False
) -> Search:
    """Everything a recruiter sees for a few prepared requests, from one scan of the candidates.

    Every candidate of a request's role is scored once and stored with a mark whether it matches; ``ranked`` (K1, K2),
    ``listing`` (K3, per request) and ``top`` (K5) read that table. ``counts``: rows scored, and matches, counted while writing.
    """
    raw = vector_similarity() if raw is None else raw
    pairs = spread_join(candidates, requests, "role", "application_id", MOST_REQUESTS)
    passes = meets_experience(F.col("experience"), F.col("min_experience")) & meets_location(F.col("location"), F.col("wanted_location"), regex)
    scored = add_score(pairs, raw, cut, regex)
    scored = scored.withColumn("matches", F.coalesce(passes & (~F.col("any_filter") | (F.col("score") > 0)), F.lit(False)))
    seen = Observation()
    stored = materialize(scored.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if("matches").alias("matches")), "search")
    matches = stored.where("matches").drop("matches")
    listing = stored.drop("matches").orderBy("request_id", F.col("experience").desc_nulls_last(), "application_id")
    return Search(rank_matches(matches), listing, top_matches(matches, k), seen.get)


def role_overview(spark: SparkSession, path: str, role: str = DEFAULT_ROLE) -> tuple[DataFrame, DataFrame]:
    """Stored candidates of a role without any request: all of them by experience, and the first few."""
    rows = clean_experience(with_score_column(read_candidates(spark, path, role)))
    return by_experience(rows), most_experienced(rows)
