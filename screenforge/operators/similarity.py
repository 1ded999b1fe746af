"""Skill vectors: lookup, training, and a hook for a model of the user's own."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml.feature import Normalizer, Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from screenforge.functions.text import present_skills
from screenforge.operators.joins import lookup_join


def add_skill_vector(df: DataFrame, skill_vectors: DataFrame, row_id: str, skills: str = "skills", target: str = "vector") -> DataFrame:
    """Add the unit vector of a skill list: the sum of its skills' vectors, scaled to length 1.

    ``skill_vectors`` has ``skill`` (lower case, unique) and ``embedding``. Null where no skill is
    known. Rows are placed by their id first; words, sums and the join back all stay in that
    place, so the vectors themselves are not shuffled.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartition(partitions, row_id)
    known = skill_vectors.select("skill", array_to_vector(F.col("embedding").cast("array<double>")).alias("_v"))
    words = placed.select(row_id, F.explode(present_skills(F.col(skills))).alias("skill"))
    sums = lookup_join(words, known, "skill", "inner").groupBy(row_id).agg(Summarizer.sum(F.col("_v")).alias("_sum"))
    scaled = Normalizer(p=2.0, inputCol="_sum", outputCol="_unit").transform(sums)
    vectors = scaled.where(~F.forall(vector_to_array("_sum"), lambda x: x == 0))
    return placed.join(vectors.select(row_id, vector_to_array("_unit").alias(target)), row_id, "left")


def train_skill_vectors(df: DataFrame, skills: str = "skills", dims: int = 64, seed: int = 7, partitions: int = 8, iterations: int = 1) -> DataFrame:
    """Learn one vector per skill from the lists they occur in together."""
    lists = df.select(present_skills(F.col(skills)).alias("words")).where(F.cardinality("words") > 0)
    model = Word2Vec(
        vectorSize=dims, minCount=1, seed=seed, numPartitions=partitions, maxIter=iterations, inputCol="words", outputCol="unused"
    ).fit(lists)
    return model.getVectors().select(
        F.col("word").alias("skill"), vector_to_array("vector", "float32").alias("embedding")
    )


def embed(df: DataFrame, text: str, load_model: Callable[[], Callable[[list[str]], list]], target: str = "vector") -> DataFrame:
    """Add a vector per text from a model of the user's.

    ``load_model`` runs once per Python worker and returns a function from texts to vectors. Each
    distinct text is sent to it once.
    """

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load_model()
        for texts in batches:
            yield pd.Series([[float(x) for x in v] for v in model(texts.tolist())])

    # Non-deterministic: no filter is pushed below it with a second call of the model.
    encode = encode.asNondeterministic()
    # Texts are compared by digest and hash; a frequent text is spread over salts on its way back.
    salts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.withColumn("_digest", F.sha2(text, 256)).withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
    distinct = keyed.where(F.col(text).isNotNull()).groupBy("_digest").agg(F.first(text).alias("_text"))
    vectors = distinct.select("_digest", encode(F.col("_text")).alias(target))
    runs = keyed.select("_digest", "_salt").distinct().join(vectors, "_digest")
    return keyed.join(runs, ["_digest", "_salt"], "left").drop("_digest", "_salt")
