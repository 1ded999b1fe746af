"""Skill vectors learned from the lists skills occur in together: counts, PPMI, randomised block factorisation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenforge.functions.text import present_skills
from screenforge.operators.joins import lookup_join
from screenforge.session import materialize

# More directions than wanted are followed, so that the wanted ones are sharp.
SPARE_DIMS = 8
# Directions whose share of the largest is below this are rounding.
LEAST_SHARE = 1e-10


def cooccurrence(df: DataFrame, skills: str = "skills") -> DataFrame:
    """(skill, other, n): in how many lists two different skills stand together; both orders are there.

    Repeats within a list count once. Pairs come from within a list, so a list of n skills gives n² of them.
    """
    lists = df.select(F.array_distinct(present_skills(F.col(skills))).alias("_s")).where(F.cardinality("_s") > 1)
    pairs = lists.select("_s", F.explode("_s").alias("skill")).select("skill", F.explode("_s").alias("other"))
    return pairs.where(F.col("skill") != F.col("other")).groupBy("skill", "other").agg(F.count(F.lit(1)).alias("n"))


def ppmi(counts: DataFrame) -> DataFrame:
    """(skill, other, n, weight): positive pointwise mutual information, ln(n N / (n_skill n_other)); pairs at or below 0 are left out."""
    margins = materialize(counts.groupBy("skill").agg(F.sum("n").alias("total")), "margins")
    total = margins.agg(F.sum("total")).first()[0] or 1
    joined = lookup_join(counts, margins, "skill", "inner")
    joined = lookup_join(joined, margins.select(F.col("skill").alias("other"), F.col("total").alias("other_total")), "other", "inner")
    weight = F.log(F.col("n") * F.lit(float(total)) / (F.col("total").cast("double") * F.col("other_total")))
    return joined.withColumn("weight", weight).where("weight > 0").select("skill", "other", "n", "weight")


def _times(weights: DataFrame, vectors: DataFrame) -> DataFrame:
    """The symmetric sparse matrix (skill, other, weight) times a vector per skill."""
    known = vectors.select(F.col("skill").alias("other"), array_to_vector("v").alias("_v"))
    joined = lookup_join(weights.select("skill", "other", "weight"), known, "other", "inner")
    return joined.groupBy("skill").agg(vector_to_array(Summarizer.sum(F.col("_v"), F.col("weight"))).alias("v"))


def _product(left: DataFrame, right: DataFrame | None, dims: int) -> np.ndarray:
    """The small matrix of all products of two directions, summed over skills: ``dims`` x ``dims`` numbers reach the driver."""
    other = "v" if right is None else "w"
    pairs = left if right is None else left.join(right.withColumnRenamed("v", "w"), "skill")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((dims, dims))
        for rows in batches:
            if len(rows):
                total += np.stack(rows["v"].to_numpy()).T @ np.stack(rows[other].to_numpy())
        yield pd.DataFrame({"at": np.arange(dims * dims), "x": total.ravel()})

    parts = pairs.mapInPandas(run, "at int, x double").groupBy("at").agg(F.sum("x").alias("x"))
    out = np.zeros(dims * dims)
    for row in parts.collect():
        out[row.at] = row.x
    return out.reshape(dims, dims)


def _turned(vectors: DataFrame, matrix: np.ndarray, kind: str = "double") -> DataFrame:
    """Every vector times a small matrix."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                rows = rows.assign(v=list(np.stack(rows["v"].to_numpy()) @ matrix))
            yield rows

    return vectors.select("skill", "v").mapInPandas(run, f"skill string, v array<{kind}>")


def _orthonormal(vectors: DataFrame, dims: int) -> DataFrame:
    """The same directions, orthonormal over all skills; those that are sums of others become zeros."""
    value, basis = np.linalg.eigh(_product(vectors, None, dims))
    scale = np.where(value > LEAST_SHARE * max(value.max(), 1e-300), 1 / np.sqrt(np.maximum(value, 1e-300)), 0.0)
    return materialize(_turned(vectors, basis * scale), "directions")


def factorise(weights: DataFrame, dims: int, seed: int = 7, rounds: int = 3) -> DataFrame:
    """(skill, embedding): the ``dims`` strongest positive directions of the matrix, each scaled by the root of its eigenvalue.

    Block power iteration from random directions, which come from the hash of each skill. Vectors stay in tables;
    only matrices of a few dozen rows and columns reach the driver.
    """
    wide = dims + SPARE_DIMS
    weights = materialize(weights.select("skill", "other", "weight"), "weights")
    start = F.transform(F.sequence(F.lit(0), F.lit(wide - 1)), lambda i: F.xxhash64(F.lit(seed), F.col("skill"), i) / F.lit(2.0**63))
    found = _orthonormal(materialize(weights.select("skill").distinct().withColumn("v", start), "start"), wide)
    for _ in range(rounds):
        found = _orthonormal(materialize(_times(weights, found), "multiplied"), wide)
    inner = _product(found, materialize(_times(weights, found), "multiplied"), wide)
    value, basis = np.linalg.eigh((inner + inner.T) / 2)
    strongest = np.argsort(-value)[:dims]
    scaled = basis[:, strongest] * np.sqrt(np.maximum(value[strongest], 0.0))
    return _turned(found, scaled, "float").select("skill", F.col("v").alias("embedding"))


def learned_skill_vectors(df: DataFrame, skills: str = "skills", dims: int = 64, seed: int = 7, rounds: int = 3) -> DataFrame:
    """One vector per skill that occurs with another, from all lists; the vocabulary is never in the driver.

    Skills that occur in the same company get similar vectors, also where they never meet themselves. Signs
    of directions, and rotations among equally strong ones, carry no meaning. An empty table gives no rows.
    """
    counts = materialize(cooccurrence(df, skills), "cooccurrence")
    return factorise(ppmi(counts), dims, seed, rounds)
