"""Shortlists by vector similarity that skip clusters of candidates no request can list; exact."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from screenforge.constants import RAW_SIMILARITY_CUT, SHORTLIST_SIZE
from screenforge.functions.text import present_skills
from screenforge.operators.joins import is_small, lookup_join
from screenforge.operators.ranking import (
    _CELLS, _vectors, block_shape, block_shortlists, every_part, first_of, in_tie_order, jobs_of, part_of, people_of, place_of_block_row, role_grid, shortlists,
)
from screenforge.session import materialize

# Candidates of a cluster, on average.
ROWS_PER_CLUSTER = 2_000
# The cell or cluster of candidates without a vector; their similarity is 0 to any request.
NO_VECTOR = -1
# Bounds are widened by so much (of 100 points), for rounding in the products.
SLACK = 1e-6
# Skill vectors within these bounds are handed to the tasks.
MOST_SKILLS, MOST_SKILL_BYTES = 20_000, 8 << 20


class PrunedSearch(NamedTuple):
    """Rows as of ``shortlists``; and per request the clusters of its role and how many of them were opened."""

    rows: DataFrame
    opened: DataFrame


class Skills(NamedTuple):
    """Known skills by name, and the vector of each."""

    place: dict[str, int]
    matrix: np.ndarray

    def codes(self, words) -> np.ndarray | None:
        """The places of the known words; null where there is none, or where their sum has no direction."""
        found = [self.place[w] for w in (() if words is None else words) if w in self.place]
        return np.array(found, np.int32) if found and self.matrix[found].sum(axis=0).any() else None

    def vectors(self, column: pd.Series) -> np.ndarray:
        """Matrix of the unit vectors of lists of codes; a missing one is a row of zeros."""
        out, known = np.zeros((len(column), self.matrix.shape[1])), np.flatnonzero(column.notna())
        for start in range(0, len(known), 4096):
            rows = known[start : start + 4096]
            lists = [column.iat[row] for row in rows]
            begins = np.cumsum([0, *map(len, lists)])[:-1]
            total = np.add.reduceat(self.matrix[np.concatenate(lists)], begins)
            out[rows] = total / np.sqrt((total * total).sum(axis=1))[:, None]
        return out


def known_skills(skill_vectors: DataFrame) -> Skills | None:
    """The table of skill vectors in memory; None where it is larger than the tasks should hold."""
    known = skill_vectors.select("skill", F.col("embedding").cast("array<double>").alias("embedding")).where("skill IS NOT NULL AND embedding IS NOT NULL")
    if not is_small(known, MOST_SKILLS, MOST_SKILL_BYTES):
        return None
    place, rows = {}, []
    for row in known.collect():  # a skill that is listed twice counts twice
        if row.skill in place:
            rows[place[row.skill]] = rows[place[row.skill]] + np.array(row.embedding, float)
        else:
            place[row.skill] = len(rows)
            rows.append(np.array(row.embedding, float))
    return Skills(place, np.array(rows) if rows else np.zeros((0, 0)))


def _matrix(frame: pd.DataFrame, vector: str, skills: Skills | None) -> np.ndarray:
    return _vectors(frame[vector], max((len(v) for v in frame[vector] if v is not None), default=0)) if skills is None else skills.vectors(frame["codes"])


def _widened(matrix: np.ndarray, dims: int) -> np.ndarray:
    return np.pad(matrix, ((0, 0), (0, dims - matrix.shape[1])))


def _nearest(vectors: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row the nearest centre and the cosine to it."""
    if not len(centres):
        return np.zeros(len(vectors), np.int64), np.full(len(vectors), -1.0)  # one cluster, as wide as can be
    nearest, cosine = np.zeros(len(vectors), np.int64), np.zeros(len(vectors))
    step = max(1, _CELLS // len(centres))
    for start in range(0, len(vectors), step):
        products = vectors[start : start + step] @ centres.T
        nearest[start : start + step] = best = products.argmax(axis=1)
        cosine[start : start + step] = products[np.arange(len(best)), best]
    return nearest, cosine


def _placing(pivots: dict[str, np.ndarray], skills: Skills | None):
    """Function of (role, vector or words): the cell of the role's nearest pivot and the cosine to it, and codes of the words."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for role, given in batches:
            frame = pd.DataFrame({"role": role, "vector": given})
            if skills is not None:
                frame["codes"] = pd.Series([skills.codes(words) for words in given], dtype=object)
            known = (frame["vector" if skills is None else "codes"].notna()).to_numpy()
            cell, cosine = np.full(len(frame), NO_VECTOR, np.int64), np.zeros(len(frame))
            for name, rows in frame.groupby("role", sort=False).indices.items():
                rows = rows[known[rows]]
                vectors, centres = _matrix(frame.iloc[rows], "vector", skills), pivots.get(name, np.zeros((0, 0)))
                dims = max(vectors.shape[1], centres.shape[1])
                cell[rows], cosine[rows] = _nearest(_widened(vectors, dims), _widened(centres, dims))
            out = pd.DataFrame({"cell": cell, "cosine": cosine})
            yield out if skills is None else out.assign(codes=frame["codes"])

    return run


def upper_bounds(jobs: pd.DataFrame, clusters: pd.DataFrame, cut: float, to_centre: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Per request and cluster: no member is ranked by a higher score, or has more experience; -inf where none can be listed.

    The angle between request and member is at least the one to the centre, less the widest angle in the cluster.
    ``to_centre``: the cosines of requests to centres, if known.
    """
    if to_centre is None:
        dims = max((len(v) for column in (jobs["job_vector"], clusters["centre"]) for v in column if v is not None), default=0)
        to_centre = _vectors(jobs["job_vector"], dims) @ _vectors(clusters["centre"], dims).T
    wants = jobs["wants_skills"].to_numpy(bool)[:, None]
    minimum = jobs["min_experience"].to_numpy(float)[:, None]
    filtering = jobs["any_filter"].to_numpy(bool)[:, None]
    years = clusters["most_experience"].to_numpy(float)[None, :]
    to_centre = np.clip(to_centre, -1, 1)
    wide = np.arccos(np.clip(clusters["cosine"].to_numpy(float), -1, 1))[None, :]
    raw = np.cos(np.maximum(0.0, np.arccos(to_centre) - wide)) * 100
    raw = np.where(clusters["centre"].isna().to_numpy()[None, :], 100.0, raw)  # no pivot was drawn
    raw = np.where((clusters["cluster"].to_numpy() == NO_VECTOR)[None, :] | _unknown(jobs)[:, None], 0.0, raw) + SLACK
    points = (
        np.where(wants, raw * jobs["w_skills"].to_numpy(float)[:, None] / 100, 0.0)
        + np.where(years >= minimum, jobs["w_experience"].to_numpy(float)[:, None], 0.0)
        + np.where(jobs["wanted_location"].to_numpy()[:, None] != "", jobs["w_location"].to_numpy(float)[:, None], 0.0)
    )
    score = np.floor(points * 100 + 0.5) / 100
    score = np.where(~wants, np.maximum(score, 1.0), score)
    none = ((minimum > 0) & ~(years >= minimum)) | (wants & (raw < cut))
    return np.where(none, -np.inf, np.where(filtering, score, 0.0)), np.broadcast_to(np.nan_to_num(years, nan=-np.inf), score.shape)


def _code_lists(skills: Skills):
    def run(words: pd.Series) -> pd.Series:
        return pd.Series([skills.codes(w) for w in words], dtype=object)

    return run


def _vector_lists(skills: Skills):
    def run(codes: pd.Series) -> pd.Series:
        return pd.Series([None if c is None else v for c, v in zip(codes, skills.vectors(codes), strict=True)], dtype=object)

    return run


def _unknown(jobs: pd.DataFrame) -> np.ndarray:
    return jobs["codes" if "codes" in jobs.columns else "job_vector"].isna().to_numpy()


def _bounded(jobs: pd.DataFrame, wanted: np.ndarray, clusters: pd.DataFrame, centres: np.ndarray, cut: float, width: int = 1):
    """Steps of requests: their row numbers, and per request and cluster the bounds, and whether they reach its ``least`` row.

    A step has ``_CELLS`` numbers at most for as many clusters, or ``width`` numbers a request.
    """
    dims = max(wanted.shape[1], centres.shape[1])
    wanted, centres = _widened(wanted, dims), _widened(centres, dims).T
    step = max(1, _CELLS // max(width, len(clusters)))
    for start in range(0, len(jobs), step):
        part = jobs.iloc[start : start + step]
        score, years = upper_bounds(part, clusters, cut, wanted[start : start + step] @ centres)
        least, tie = (part[c].to_numpy(float)[:, None] for c in ("least_score", "least_experience"))
        yield start + np.arange(len(part)), score, years, np.isfinite(score) & _reaches(score, years, least, tie)


def _reaches(score, years, least, tie):
    """Whether a row of that score and experience may stand before one of ``least`` and ``tie``; always where there is none."""
    return np.isnan(least) | (score > least) | ((score == least) & (years >= tie))


def _sending(parts: pd.DataFrame, pivots: dict[str, np.ndarray], skills: Skills | None, cut: float):
    """Function that sends each request to every part of its role whose bound reaches its least row."""
    roles = {name: part.reset_index(drop=True) for name, part in parts.groupby("role", sort=False)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, jobs in batch.groupby("role", sort=False):
                if name not in roles:
                    continue
                known, held = roles[name], pivots.get(name, np.zeros((0, 0)))
                centred = (known["cluster"] != NO_VECTOR).to_numpy() & (len(held) > 0)
                centres = np.zeros((len(known), held.shape[1]))
                centres[centred] = held[known["cluster"].to_numpy()[centred]]
                known = known.assign(centre=np.where(centred, 0.0, np.nan))
                for rows, _, _, reach in _bounded(jobs, _matrix(jobs, "job_vector", skills), known, centres, cut):
                    job, part = np.nonzero(reach)
                    for start in range(0, len(job), 10_000):
                        some = part[start : start + 10_000]
                        yield jobs.iloc[rows[job[start : start + 10_000]]].assign(cell=known["cluster"].to_numpy()[some], cut=known["cut"].to_numpy()[some])

    return run


def _block_search(k: int, cut: float, skills: Skills | None):
    """Function for one block: people of a part against the requests that were sent to it.

    The people drawn are the centres of the block's clusters and no members: they were compared before. A request opens the
    clusters of the highest bounds that have ``k`` members, and then those that reach its ``k``-th row. Besides the rows there
    is one per request with the number of clusters it opened.
    """

    def run(people: pd.DataFrame, jobs: pd.DataFrame) -> pd.DataFrame:
        columns = [part.split(" ")[0].strip("`") for part in block_shape().split(", ")] + ["role", "opened"]
        drawn = people["drawn"].to_numpy(bool) & (people["cell"] != NO_VECTOR).to_numpy()
        centres = _matrix(people[drawn], "vector", skills)
        members = in_tie_order(people[~people["drawn"].to_numpy(bool)])
        if not len(members) or not len(jobs):
            return pd.DataFrame(columns=columns)
        vectors, wanted_vectors = _matrix(members, "vector", skills), _matrix(jobs, "job_vector", skills)
        dims = max(m.shape[1] for m in (centres, vectors, wanted_vectors))
        centres, vectors, wanted_vectors = (_widened(m, dims) for m in (centres, vectors, wanted_vectors))
        lost = members["cell"].iloc[0] == NO_VECTOR
        label, cosine = _nearest(vectors, np.zeros((0, dims)) if lost else centres)
        years = members["experience"].to_numpy(float)
        names, label = np.unique(label, return_inverse=True)
        clusters = pd.DataFrame({"label": label, "cosine": cosine, "years": years}).groupby("label").agg(n=("label", "size"), cosine=("cosine", "min"), most_experience=("years", "max"))
        single = lost or not len(centres)
        clusters = clusters.assign(cluster=NO_VECTOR if lost else names, centre=np.nan if single else 0.0)
        centres = np.zeros((1, dims)) if single else centres[names]
        place_code, places = pd.factorize(members["location"].str.lower())
        known_places, everyone, by_place = pa.array(places, pa.string()), np.arange(len(members)), {}

        def within(wanted, minimum):
            """Rows in the wanted place with enough experience, which stand in front."""
            if wanted not in by_place:
                near = np.append(pc.match_substring(known_places, wanted).to_numpy(zero_copy_only=False).astype(bool), False)
                by_place[wanted] = np.flatnonzero(near[place_code]) if wanted else everyone
            there = by_place[wanted]
            return there if minimum <= 0 else there[: int((years[there] >= minimum).sum())]

        size = clusters["n"].to_numpy()
        get = {c: jobs[c].to_numpy() for c in ("request_id", "wants_skills", "any_filter", "min_experience", "wanted_location", "least_score", "least_experience")}
        weights = jobs[["w_skills", "w_experience", "w_location"]].to_numpy(float)

        def listed(rows, j, products):
            if not get["wants_skills"][j]:
                raw = np.zeros(len(rows))
            else:
                raw = (vectors[rows] @ wanted_vectors[j] if products is None else products[rows]) * 100
            found, score = first_of(raw, years[rows], k, cut, get["wants_skills"][j], get["any_filter"][j], get["min_experience"][j], weights[j], get["wanted_location"][j])
            return rows[found], score

        out, opened = [], []
        for group, bound, most, reach in _bounded(jobs, wanted_vectors, clusters, centres, cut, len(members)):
            there = {at: within(get["wanted_location"][group[at]], get["min_experience"][group[at]]) for at in np.flatnonzero(reach.any(axis=1))}
            # Where many members may be looked at, one product of all is faster than taking them out.
            many = [at for at, rows in there.items() if get["wants_skills"][group[at]] and (size @ reach[at]) * len(rows) * 10 > len(members) ** 2]
            product_of = dict(zip(many, wanted_vectors[group[many]] @ vectors.T, strict=True)) if many else {}
            for at, here in there.items():
                j, open_to, products = group[at], reach[at], product_of.get(at)
                labels = label[here]
                best = np.flatnonzero(open_to)
                best = best[np.lexsort((-most[at, best], -bound[at, best]))]
                first = np.zeros(len(size), bool)
                first[best[: int(np.searchsorted(np.cumsum(size[best]), k)) + 1]] = True
                rows, score = listed(here[first[labels]], j, products)
                rest = open_to & ~first
                if len(rows) >= k:
                    least = score[-1] if get["any_filter"][j] else 0.0
                    rest &= _reaches(bound[at], most[at], least, np.nan_to_num(years[rows[-1]], nan=-np.inf))
                if rest.any():
                    more, their = listed(here[rest[labels]], j, products)
                    rows, score = np.append(rows, more), np.append(score, their)
                    by = np.lexsort((rows, -score if get["any_filter"][j] else np.zeros(len(rows))))[:k]
                    rows, score = rows[by], score[by]
                by = score if get["any_filter"][j] else np.zeros(len(rows))
                keep = _reaches(by, np.nan_to_num(years[rows], nan=-np.inf), get["least_score"][j], get["least_experience"][j])
                out.append((np.full(keep.sum(), j), rows[keep], score[keep]))
                opened.append((j, int((first | rest).sum())))
        if not opened:
            return pd.DataFrame(columns=columns)
        j, rows, score = (np.concatenate(part) for part in zip(*out, strict=True))
        found = members.take(rows).assign(request_id=get["request_id"][j], any_filter=get["any_filter"][j], score=score, opened=None)
        j, number = (np.array(part) for part in zip(*opened, strict=True))
        counts = pd.DataFrame({c: None for c in columns}, index=range(len(j)), dtype=object)
        counts = counts.assign(request_id=get["request_id"][j], role=jobs["role"].to_numpy()[j], opened=number)
        return pd.concat([found[columns].astype(object), counts.astype(object)])

    return run


def _blind_to_skills() -> Column:
    """Prepared requests whose score knows experience and place alone, and never falls with more experience."""
    no_skills = (F.cardinality("job_skills") == 0) | F.col("job_vector").isNull()
    # A base score of 1 replaces no points, so fewer than 1 for experience would lower it.
    return no_skills & ((F.col("w_experience") == 0) | (F.col("w_experience") >= 1)) & (F.col("w_location") >= 0)


def _best_by_place(members: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each role and location by experience, number of skills and id: all that such requests can list."""
    order = [F.nanvl("experience", F.lit(None).cast("double")).desc_nulls_last(), F.desc("skill_count"), F.asc("application_id")]
    place = F.row_number().over(Window.partitionBy("role", "location").orderBy(*order))
    return members.withColumn("_row", place).where(F.col("_row") <= k).drop("_row", "skill_count")


def _least(first: DataFrame, k: int) -> DataFrame:
    """Score and experience of the ``k``-th row of each request that has so many."""
    place = F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("_by"), F.desc("experience")))
    by = F.when(F.col("any_filter"), F.col("score")).otherwise(F.lit(0.0))
    least = first.withColumn("_by", by).withColumn("_place", place).where(F.col("_place") == k)
    return least.select("request_id", F.col("_by").alias("least_score"), F.coalesce("experience", F.lit(float("-inf"))).alias("least_experience"))


def pruned_shortlists(
    candidates: DataFrame,
    requests: DataFrame,
    k: int = SHORTLIST_SIZE,
    cut: float = RAW_SIMILARITY_CUT,
    rows_per_cluster: int = ROWS_PER_CLUSTER,
    rows_per_block: int = 50_000,
    skills: Skills | None = None,
) -> PrunedSearch:
    """First ``k`` candidates of each prepared request, as ``ranking.shortlists`` finds them.

    One in ``rows_per_cluster`` candidates is drawn by the hash of its id; every request is compared with those, and its
    ``k``-th row there is the least one worth looking for. One in ``rows_per_block`` is the pivot of a cell, which every
    candidate of the role joins whose nearest pivot it is; a cell of more rows is cut by their ids. A cell, and within a
    block a cluster, has an upper bound of its members' scores for a request: the cosine bound, with the best
    experience in it and the wanted place. A request is sent to the blocks whose bound reaches its least row, and opens the
    clusters there whose bound does. Candidates and requests are shuffled once to that, and pairs of a request and a cluster are
    never rows. With ``skills`` neither side brings its vector along: both have the places of their skills, and vectors are made
    in the block. A request whose scores don't depend on vectors would open
    every cluster with enough experience; it opens none, and looks at the best of each place instead.
    """
    id_hash = lambda label, one_in: F.pmod(F.xxhash64("application_id", F.lit(label)), F.lit(one_in)) == 0
    is_drawn, is_pivot = id_hash("pivot", rows_per_cluster), id_hash("cell", max(1, ceil(rows_per_block / rows_per_cluster)))
    if skills is None:
        given, people = "vector", people_of(candidates)
    else:
        # As in add_skill_vector, a row without id has no vector.
        given = "_words"
        words = F.when(F.col("application_id").isNotNull(), present_skills(F.col("skills")))
        people = people_of(candidates.withColumn("vector", words)).withColumnRenamed("vector", "_words")
    pivots: dict[str, list] = {}
    for row in people.where(is_drawn & is_pivot & F.col(given).isNotNull()).select("role", given).collect():
        value = row[given] if skills is None else skills.codes(row[given])
        if value is not None:
            pivots.setdefault(row.role, []).append(value)
    one = skills.vectors if skills is not None else lambda column: _vectors(column, max(map(len, column)))
    pivots = {role: one(pd.Series(rows, dtype=object)) for role, rows in pivots.items()}
    shape = T.StructType.fromDDL("cell bigint, cosine double" + ("" if skills is None else ", codes array<int>"))
    place = F.pandas_udf(_placing(pivots, skills), shape)
    people = people.withColumn("_at", place("role", given)).withColumn("drawn", is_drawn)
    people = materialize(people.select("*", "_at.*").drop("_at", "_words"), "people")

    requests = materialize(requests, "requests")
    alike = F.coalesce(_blind_to_skills(), F.lit(False)) & F.col("request_id").isNotNull()
    seen = requests.where(~alike).select("request_id").distinct()
    blind = materialize(requests.where(alike).join(seen, "request_id", "left_anti"), "blind")
    sighted = requests.join(blind.select("request_id").distinct(), "request_id", "left_anti")
    # Rows of requests that share id and role are listed once for each pair of them.
    paired = lambda df: df.join(df.select("request_id", "role"), ["request_id", "role"])
    few = _best_by_place(people.drop("cell", "cosine", "codes", "drawn"), k)
    if skills is not None:
        few = few.withColumn("vector", F.lit(None).cast("array<double>"))
    grid = materialize(role_grid(few, blind.where("role IS NOT NULL"), rows_per_block, rows_per_block), "grid")
    of_blind = shortlists(few, paired(blind), k, cut, grid=grid)

    asked = materialize(paired(sighted), "paired")
    sample = people.where("drawn")
    if skills is not None:
        sample = sample.withColumn("vector", F.pandas_udf(_vector_lists(skills), "array<double>")("codes"))
    sample = materialize(sample, "sample")
    grid = materialize(role_grid(sample, asked.where("role IS NOT NULL"), rows_per_block, rows_per_block), "sample-grid")
    first = materialize(block_shortlists(sample, asked, k, cut, grid=grid).drop("place"), "first-rows")
    jobs = jobs_of(asked)
    if skills is not None:
        # As in add_skill_vector, by id.
        words = requests.select("request_id", "job_skills").groupBy("request_id").agg(F.flatten(F.collect_list("job_skills")).alias("_words"))
        codes = F.pandas_udf(_code_lists(skills), "array<int>")
        jobs = jobs.drop("job_vector").join(words, "request_id", "left").withColumn("codes", codes("_words")).drop("_words")
    jobs = materialize(jobs.join(_least(first, k), "request_id", "left"), "jobs")

    sizes = people.groupBy("role", "cell").agg(F.ceil(F.count(F.lit(1)) / rows_per_block).cast("int").alias("cuts"))
    sizes = materialize(sizes, "cells")
    request_blocks = jobs.groupBy("role").agg(F.ceil(F.count(F.lit(1)) / rows_per_block).cast("int").alias("request_blocks"))
    request_blocks = materialize(request_blocks, "request-blocks")
    # There are about as many cells as blocks.
    people = people.join(F.broadcast(sizes) if is_small(sizes, 100_000) else sizes, ["role", "cell"])
    people = people.withColumn("cut", part_of("application_id", F.col("cuts"))).drop("cuts")
    key = ("role", "cell", "cut")
    years = F.nanvl("experience", F.lit(None).cast("double"))
    parts = people.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("cosine").alias("cosine"), F.max(years).alias("most_experience"), F.count_if("drawn").alias("drawn"))
    parts = materialize(parts, "parts")
    bounds = parts.select("role", F.col("cell").alias("cluster"), "cut", "cosine", "most_experience").toPandas()
    send = _sending(bounds, pivots, skills, cut)
    sent = jobs.mapInPandas(send, T.StructType(jobs.schema.fields + T.StructType.fromDDL("cell bigint, cut int").fields))
    sent = lookup_join(sent, request_blocks, "role", "inner").withColumn("request_block", part_of("request_id", F.col("request_blocks")))
    people = lookup_join(people, request_blocks, "role", "inner").withColumn("request_block", every_part(F.col("request_blocks")))
    key += ("request_block",)
    blocks = people.drop("request_blocks", "cosine").groupBy(*key).cogroup(sent.drop("request_blocks").groupBy(*key))
    found = materialize(blocks.applyInPandas(_block_search(k, cut, skills), f"{block_shape()}, role string, opened long"), "found")

    rows = first.unionByName(found.where("opened IS NULL").drop("role", "opened"))
    rows = rows.withColumn("place", place_of_block_row()).where(F.col("place") <= k).drop("any_filter")
    clusters = F.when(F.col("cell") == NO_VECTOR, 1).otherwise(F.greatest("drawn", F.lit(1)))
    per_role = parts.groupBy("role").agg(F.sum(clusters).alias("clusters"))
    opened = found.where("opened IS NOT NULL").groupBy("request_id", "role").agg(F.sum("opened").alias("opened"))
    everyone = sighted.select("request_id", "role").join(opened, ["request_id", "role"], "left").unionByName(blind.select("request_id", "role", F.lit(0).cast("long").alias("opened")))
    counted = lookup_join(everyone.where("role IS NOT NULL"), per_role, "role")
    zero = F.lit(0).cast("long")
    return PrunedSearch(rows.unionByName(of_blind), counted.select("request_id", F.coalesce("clusters", zero).alias("clusters"), F.coalesce("opened", zero).alias("opened")))
