"""The keys of accepted applications, in runs that are merged by size and published by a manifest."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from screenforge.functions.text import email_key
from screenforge.schemas import CANDIDATE

# Fixed for the life of a table: its key folders are numbered by the last bits of a key's hash.
KEY_BUCKETS = 64
# Every run has a bitmap of 1 MB, each bucket's part of it in one piece.
BITS_A_BUCKET = 1 << 17
BITS_A_ROW = 32768
# A run of fewer keys is one file; a larger one has a folder per bucket.
FLAT_KEYS = 200_000
# So many runs of one level are merged into one of the next.
FAN = 8

KEYS = T.StructType([T.StructField("role", T.StringType()), T.StructField("email", T.StringType()), T.StructField("bucket", T.IntegerType())])
_RUN = T.StructType(
    [T.StructField("run", T.StringType()), T.StructField("level", T.IntegerType()), T.StructField("keys", T.LongType()), T.StructField("place", T.IntegerType())]
)
_MAP = T.StructType([T.StructField("part", T.LongType()), T.StructField("bits", T.BinaryType())])


@dataclass(frozen=True)
class Run:
    """Some batches' keys, and how often they have been rewritten."""

    name: str
    level: int
    keys: int


def bucket_of(role: Column, email: Column) -> Column:
    """The key folder of a role and an email key."""
    return F.pmod(F.xxhash64(role, email), F.lit(KEY_BUCKETS)).cast("int")


def place_of(role: Column, email: Column) -> Column:
    """A key's place in the bitmap: its bucket, and in it the next bits of the hash."""
    rest = F.shiftrightunsigned(F.xxhash64(role, email), int(KEY_BUCKETS).bit_length() - 1).bitwiseAND(F.lit(BITS_A_BUCKET - 1))
    return bucket_of(role, email).cast("long") * BITS_A_BUCKET + rest


def keyed(rows: DataFrame) -> DataFrame:
    """(role, email, bucket) of the rows with an email."""
    keys = rows.select("role", email_key(F.col("email")).alias("email")).where(F.col("email").isNotNull())
    return keys.withColumn("bucket", bucket_of(F.col("role"), F.col("email")))


def key_map(keys: DataFrame) -> DataFrame:
    """The bitmap of a table of keys, in rows of 4 kB: 256 rows at most."""
    at = keys.select((place_of(F.col("role"), F.col("email")) + 1).alias("at"))
    return at.groupBy(F.bitmap_bucket_number("at").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))


def _bytes(maps: list) -> np.ndarray:
    data = np.zeros(KEY_BUCKETS * BITS_A_BUCKET // 8, np.uint8)
    for row in maps:
        low = (row.part - 1) * BITS_A_ROW // 8
        data[low : low + len(row.bits)] |= np.frombuffer(bytes(row.bits), np.uint8)
    return data


def shared_buckets(mine: np.ndarray, other: np.ndarray) -> list[int]:
    """The buckets in which two bitmaps have a bit in common. No other bucket can hold a key of both."""
    return np.flatnonzero((mine & other).reshape(KEY_BUCKETS, -1).any(axis=1)).tolist()


def merge_plan(runs: list[Run], fan: int = FAN) -> list[list[Run]]:
    """Which runs to merge now: the oldest ``fan`` of a level as soon as it has so many, from the lowest level up."""
    plan, runs = [], list(runs)
    for level in range(max((r.level for r in runs), default=0) + 1):
        same = [r for r in runs if r.level == level]
        if len(same) >= fan:
            plan.append(same[:fan])
    return plan


class KeyStore:
    """The (role, email) keys of a table's batches.

    A batch writes its keys as a run of level 0, a large one in folders by bucket; ``fan`` runs of a level are merged into one of the
    next, so after n batches there are at most (fan - 1) log n of them. A manifest per batch lists the runs that hold
    all keys up to that batch. It is written last, and a batch reads the manifest of the one before it:
    what a batch left behind half-way is not seen, and a batch that is run again finds what it found first and replaces its
    own folders. A run's bitmap tells which of its buckets can hold a key of a batch; only those are opened.
    Runs that were merged stay where they are for batches that are run again; drop them once the
    stream's checkpoint has passed.
    """

    def __init__(self, spark: SparkSession, table: str, fan: int = FAN):
        self.spark, self.table, self.fan = spark, table, fan
        # Runs of level 0 lie by batch, merged ones in a folder of their own.
        self.keys, self.merged, self.maps, self.manifests = (f"{table}_{part}" for part in ("keys", "merged_keys", "key_maps", "key_manifests"))

    def _folder(self, run: Run) -> str:
        return f"{self.merged}/run={run.name}" if run.level else f"{self.keys}/batch_id={run.name}"

    def runs_before(self, batch_id: int) -> list[Run] | None:
        """The runs that the manifest of the batch before lists, None if there is no such manifest."""
        if batch_id == 0:
            return []
        try:
            rows = self.spark.read.schema(_RUN).parquet(f"{self.manifests}/batch_id={batch_id - 1}").collect()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        return [Run(r.run, r.level, r.keys) for r in sorted(rows, key=lambda r: r.place)]

    def adopt(self, batch_ids: list[int]) -> list[Run]:
        """Write the keys of batches that are there without a manifest, from their rows; returns the runs."""
        runs = []
        for batch_id in sorted(batch_ids):
            runs = self.add(keyed(self.spark.read.schema(CANDIDATE).parquet(f"{self.table}/batch_id={batch_id}")), batch_id, runs)
        return runs

    def _read(self, folders: list[str]) -> DataFrame:
        frames = [self.spark.read.schema(KEYS).parquet(folder) for folder in folders]
        out = frames[0]
        for frame in frames[1:]:
            out = out.unionByName(frame)
        return out

    def _write_map(self, keys: DataFrame, run: Run) -> None:
        key_map(keys).coalesce(1).write.mode("overwrite").parquet(f"{self.maps}/run={run.level}-{run.name}")

    def known(self, keys: DataFrame, runs: list[Run]) -> DataFrame:
        """The stored (role, email) of ``runs`` that may be among ``keys``; opens the folders their bitmaps name."""
        folders = self.folders(keys, runs)
        if not folders:
            return self.spark.createDataFrame([], "role string, email string")
        return self.spark.read.schema(T.StructType(KEYS.fields[:2])).parquet(*folders)

    def folders(self, keys: DataFrame, runs: list[Run]) -> list[str]:
        """The folders of ``runs`` that may hold one of ``keys``."""
        if not runs:
            return []
        mine = _bytes(key_map(keys).collect())  # 1 MB at most
        paths = [f"{self.maps}/run={r.level}-{r.name}" for r in runs]
        schema = T.StructType([*_MAP.fields, T.StructField("run", T.StringType())])
        rows = self.spark.read.schema(schema).option("basePath", self.maps).parquet(*paths)
        parts = [int(p) + 1 for p in np.flatnonzero(mine.reshape(-1, BITS_A_ROW // 8).any(axis=1))]
        found = {}
        for row in rows.where(F.col("part").isin(parts)).toLocalIterator():  # 1 MB a run at most
            found.setdefault(row.run, []).append(row)
        opened = []
        for run in runs:
            shared = shared_buckets(mine, _bytes(found.get(f"{run.level}-{run.name}", [])))
            if run.keys < FLAT_KEYS:
                opened += [self._folder(run)] if shared else []
            else:
                opened += [f"{self._folder(run)}/bucket={bucket}" for bucket in shared]
        return opened

    def _write(self, keys: DataFrame, run: Run) -> None:
        if run.keys < FLAT_KEYS:
            keys.coalesce(1).write.mode("overwrite").parquet(self._folder(run))
        else:  # a large bucket is dealt over several files
            files = max(1, min(4096, run.keys // 5_000_000))
            dealt = keys.repartition(KEY_BUCKETS * files, "bucket", F.pmod(F.xxhash64("email"), F.lit(files)))
            dealt.write.mode("overwrite").partitionBy("bucket").parquet(self._folder(run))
        self._write_map(keys, run)

    def add(self, keys: DataFrame, batch_id: int, runs: list[Run]) -> list[Run]:
        """Store a batch's keys beside ``runs``, merge where a level is full, publish the manifest; returns the new runs."""
        run = Run(str(batch_id), 0, keys.count())
        self._write(keys, run)
        runs = [*runs, run] if run.keys else runs
        while plan := merge_plan(runs, self.fan):
            group = plan[0]
            into = Run(f"{group[0].level + 1}-{batch_id}", group[0].level + 1, sum(r.keys for r in group))
            self._write(self._read([self._folder(r) for r in group]), into)
            place = runs.index(group[0])
            runs = [*runs[:place], into, *[r for r in runs[place:] if r not in group]]
        listed = [(r.name, r.level, r.keys, i) for i, r in enumerate(runs)]
        self.spark.createDataFrame(listed, _RUN).coalesce(1).write.mode("overwrite").parquet(f"{self.manifests}/batch_id={batch_id}")
        return runs
