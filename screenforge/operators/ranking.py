"""Ordering of candidates, for one list and for many requests."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from screenforge.constants import RAW_SIMILARITY_CUT, SHORTLIST_SIZE
from screenforge.functions.text import present_skills, skill_count
from screenforge.operators.filters import has_experience
from screenforge.operators.joins import lookup_join, shuffle_width


def _rank_order() -> list[Column]:
    # A request without any filter ignores the score.
    score = F.when(F.col("any_filter"), F.col("score")).otherwise(F.lit(0.0))
    return [
        score.desc_nulls_last(),
        F.col("experience").desc_nulls_last(),
        skill_count(F.col("skills")).desc(),
        F.col("application_id").asc(),
    ]


def rank_matches(scored: DataFrame) -> DataFrame:
    """All matches in order per request: score, experience, number of skills.

    A range-partitioned sort on the whole order, so a request with very many matches is cut into
    several partitions.
    """
    return scored.orderBy("request_id", *_rank_order())


def top_matches(scored: DataFrame, k: int = SHORTLIST_SIZE) -> DataFrame:
    """First ``k`` matches of every request with their place."""
    place = F.row_number().over(Window.partitionBy("request_id").orderBy(*_rank_order()))
    return scored.withColumn("place", place).where(F.col("place") <= k)


def by_experience(candidates: DataFrame) -> DataFrame:
    """All candidates, most experience first."""
    return candidates.orderBy(F.col("experience").desc_nulls_last(), F.col("application_id"))


def most_experienced(candidates: DataFrame, k: int = SHORTLIST_SIZE) -> DataFrame:
    """First ``k`` of those with any experience."""
    return by_experience(has_experience(candidates)).limit(k)


def finalists(candidates: DataFrame, k: int = SHORTLIST_SIZE) -> DataFrame:
    """Candidates that can reach any request's first ``k``.

    Candidates of one role with equal skills, stored vector and location differ only in experience,
    and with weights of zero or more no request scores less experience higher. So only the first
    ``k`` of such a group can be listed. The cut runs in every input partition before the shuffle.
    """
    stored = ["vector"] if "vector" in candidates.columns else []
    alike = Window.partitionBy("role", "_skills", "_size", "_place", *stored).orderBy(
        F.col("experience").desc_nulls_last(), F.col("application_id")
    )
    return (
        candidates.withColumns(
            {
                "_skills": F.sort_array(present_skills(F.col("skills"))),
                "_size": skill_count(F.col("skills")),
                "_place": F.lower("location"),
            }
        )
        .withColumn("_row", F.row_number().over(alike))
        .where(F.col("_row") <= k)
        .drop("_skills", "_size", "_place", "_row")
    )


_CARRIED = ("name", "email", "phone", "location", "skills")
_SHORTLIST = {
    "request_id": "bigint",
    "application_id": "bigint",
    "any_filter": "boolean",
    "score": "double",
    "experience": "double",
    "skill_count": "bigint",
    "name": "string",
    "email": "string",
    "phone": "string",
    "location": "string",
    "skills": "array<string>",
}
# Scores held at a time; more requests are taken in several steps.
_CELLS = 1_000_000


def _vectors(column: pd.Series, dims: int) -> np.ndarray:
    """Matrix of the vectors; a missing one is a row of zeros."""
    out = np.zeros((len(column), dims))
    for row, vector in enumerate(column):
        if vector is not None:
            out[row] = vector
    return out


def first_of(
    raw: np.ndarray, years: np.ndarray, k: int, cut: float, wants: bool, filtering: bool, minimum: float, weights: np.ndarray, wanted: str
) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and scores of one request's first ``k`` people, who stand in the order of ties and are in the wanted place."""
    enough = years >= minimum
    points = np.where(enough, weights[1], 0.0)
    if wants:
        points = raw * weights[0] / 100 + points
    points = points + (weights[2] if wanted else 0.0)
    score = np.floor(points * 100 + 0.5) / 100
    score = np.where(raw < cut, 0.0, score) if wants else np.where(points == 0, 1.0, score)
    keep = (score > 0) if filtering else np.ones(len(years), dtype=bool)
    rows = np.flatnonzero(keep if minimum <= 0 else keep & enough)
    if not filtering:  # the score is ignored
        rows = rows[:k]
    elif len(rows) > k:
        values = score[rows]
        limit = np.partition(values, len(values) - k)[len(values) - k]
        rows = rows[values >= limit]
    if filtering:
        rows = rows[np.argsort(-score[rows], kind="stable")[:k]]
    return rows, score[rows]


def _block_shortlist(k: int, cut: float):
    """Function for one block: candidates of a role against the requests of that role."""

    def run(people: pd.DataFrame, jobs: pd.DataFrame) -> pd.DataFrame:
        # Ties on the score keep this order.
        people = in_tie_order(people)
        dims = max((len(v) for column in (people["vector"], jobs["job_vector"]) for v in column if v is not None), default=0)
        vectors = _vectors(people["vector"], dims)
        all_years = people["experience"].to_numpy(dtype=float)
        place_code, places = pd.factorize(people["location"].str.lower())
        known_places = pa.array(places, pa.string())
        # Row numbers of the people picked, and for each the request, its kind and the score.
        chosen, request, kind, points_of = ([np.empty(0, t)] for t in (np.int64, np.int64, bool, float))
        # Requests of one wanted text meet only the people it lets through; the last row of ``near`` is "no location".
        for wanted, rows_of in jobs.groupby("wanted_location", sort=False).indices.items():
            near = np.append(pc.match_substring(known_places, wanted).to_numpy(zero_copy_only=False).astype(bool), False)
            there = np.flatnonzero(near[place_code]) if wanted else np.arange(len(people))
            years, vectors_there = all_years[there], vectors[there] if wanted else vectors
            # No minimum, then rising ones: people are in falling order of years, so those who have it stand in front.
            group = jobs.iloc[rows_of].sort_values("min_experience", kind="stable")
            start, able = 0, len(there)
            while start < len(group):
                least = group["min_experience"].iat[start]
                if not least <= 0:
                    able = int((years >= least).sum())
                if able == 0:
                    break
                part = group.iloc[start : start + max(1, _CELLS // able)]
                start += len(part)
                here, have = there[:able], years[:able]
                wants = part["wants_skills"].to_numpy(dtype=bool)
                filtering = part["any_filter"].to_numpy(dtype=bool)
                minimum = part["min_experience"].to_numpy(dtype=float)
                weights = part[["w_skills", "w_experience", "w_location"]].to_numpy(dtype=float)
                request_ids = part["request_id"].to_numpy()
                raw = np.zeros((len(part), able))
                if wants.any():
                    raw[wants] = _vectors(part["job_vector"][wants], dims) @ vectors_there[:able].T * 100
                for j in range(len(part)):
                    rows, score = first_of(raw[j], have, k, cut, wants[j], filtering[j], minimum[j], weights[j], wanted)
                    chosen.append(here[rows])
                    request.append(np.full(len(rows), request_ids[j]))
                    kind.append(np.full(len(rows), filtering[j]))
                    points_of.append(score)
        best = people.take(np.concatenate(chosen)).assign(
            request_id=np.concatenate(request), any_filter=np.concatenate(kind), score=np.concatenate(points_of)
        )
        return best[list(_SHORTLIST)]

    return run


def in_tie_order(people: pd.DataFrame) -> pd.DataFrame:
    """People in the order in which equal scores are listed."""
    by = ["experience", "skill_count", "application_id"]
    return people.sort_values(by, ascending=[False, False, True], kind="stable").reset_index(drop=True)


def block_shape() -> str:
    """Schema of the rows a block hands on."""
    return ", ".join(f"{n} {t}" for n, t in _SHORTLIST.items())


def people_of(candidates: DataFrame) -> DataFrame:
    """What a block needs of candidates."""
    return candidates.where("role IS NOT NULL").select(
        "role",
        "application_id",
        "experience",
        skill_count(F.col("skills")).cast("long").alias("skill_count"),
        "vector",
        *[c if c in candidates.columns else F.lit(None).cast(_SHORTLIST[c]).alias(c) for c in _CARRIED],
    )


def jobs_of(requests: DataFrame) -> DataFrame:
    """What a block needs of prepared requests."""
    return requests.where("role IS NOT NULL").select(
        "role",
        "request_id",
        (F.cardinality("job_skills") > 0).alias("wants_skills"),
        "min_experience",
        "wanted_location",
        "any_filter",
        "w_skills",
        "w_experience",
        "w_location",
        "job_vector",
    )


def part_of(column: str, parts: Column) -> Column:
    return F.pmod(F.xxhash64(column), parts).cast("int")


def every_part(parts: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), (parts - 1).cast("int")))


def place_of_block_row() -> Column:
    """The place of a block's row among all rows of its request."""
    order = [
        F.when(F.col("any_filter"), F.col("score")).otherwise(F.lit(0.0)).desc(),
        F.col("experience").desc(),
        F.col("skill_count").desc(),
        F.col("application_id"),
    ]
    return F.row_number().over(Window.partitionBy("request_id").orderBy(*order))


def role_grid(candidates: DataFrame, requests: DataFrame, rows: int, request_rows: int) -> DataFrame:
    """(role, blocks, request_blocks) of the roles that have both: parts of about so many rows.

    A role with few candidates is one block, and no request of it is copied.
    """
    people = candidates.groupBy("role").agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("blocks"))
    jobs = requests.groupBy("role").agg(F.ceil(F.count(F.lit(1)) / request_rows).cast("int").alias("request_blocks"))
    return people.join(jobs, "role")


def shortlists(
    candidates: DataFrame,
    requests: DataFrame,
    k: int = SHORTLIST_SIZE,
    cut: float = RAW_SIMILARITY_CUT,
    blocks: int | None = None,
    request_blocks: int = 1,
    grid: DataFrame | None = None,
) -> DataFrame:
    """First ``k`` candidates for each of many prepared requests, by vector similarity; exact.

    ``candidates`` carry ``vector`` and ``requests`` ``job_vector`` (unit vectors or null). The
    candidates of a role are dealt over ``blocks`` parts by their id and its requests over
    ``request_blocks``, or over as many as ``grid`` (:func:`role_grid`) has for the role, so a role with a third of
    all rows is spread and a small one is not. A task holds
    one part of each, scores them as matrix products and hands on ``k`` rows per request; pairs
    never become rows. A part should have some ten thousand rows at most.
    """
    return block_shortlists(candidates, requests, k, cut, blocks, request_blocks, grid).drop("any_filter")


def block_shortlists(
    candidates: DataFrame, requests: DataFrame, k: int, cut: float, blocks: int | None = None, request_blocks: int = 1, grid: DataFrame | None = None
) -> DataFrame:
    """:func:`shortlists`, with ``any_filter`` beside each row."""
    people, jobs = people_of(candidates), jobs_of(requests)
    if grid is None:
        blocks = blocks or shuffle_width(candidates.sparkSession)
        people, jobs = (df.withColumns({"blocks": F.lit(blocks), "request_blocks": F.lit(request_blocks)}) for df in (people, jobs))
    else:
        people, jobs = (lookup_join(df, grid, "role", "inner") for df in (people, jobs))
    cell = ("role", "block", "request_block")
    people = people.withColumn("block", part_of("application_id", F.col("blocks"))).withColumn("request_block", every_part(F.col("request_blocks")))
    jobs = jobs.withColumn("request_block", part_of("request_id", F.col("request_blocks"))).withColumn("block", every_part(F.col("blocks")))
    partial = (
        people.drop("blocks", "request_blocks")
        .groupBy(*cell)
        .cogroup(jobs.drop("blocks", "request_blocks").groupBy(*cell))
        .applyInPandas(_block_shortlist(k, cut), block_shape())
    )
    return partial.withColumn("place", place_of_block_row()).where(F.col("place") <= k)
