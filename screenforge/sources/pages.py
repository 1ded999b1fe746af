"""A listing at rest: sorted files of about equal size, a zone map, and pages that open only their files."""

from __future__ import annotations

from math import ceil
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Rows of a file; a page should be smaller.
ROWS_PER_FILE = 100_000


class Cursor(NamedTuple):
    """The last row of a page: experience (may be None) and application id."""

    experience: float | None
    application_id: int


def _order() -> list[Column]:
    return [F.col("experience").desc_nulls_last(), F.col("application_id").asc()]


def _after(cursor: Cursor, experience: Column, application_id: Column) -> Column:
    """Rows behind the cursor in the order of experience, then id; rows without experience come last."""
    behind = application_id > cursor.application_id
    if cursor.experience is None:
        return experience.isNull() & behind
    return F.coalesce((experience < cursor.experience) | ((experience == cursor.experience) & behind), F.lit(True))


def write_listing(rows: DataFrame, path: str, rows_per_file: int = ROWS_PER_FILE) -> None:
    """Write rows in the order of :func:`ranking.by_experience`, in one folder per range, and the zone map of the ranges.

    ``experience`` and ``application_id`` are the order; ids are unique and not null. The zone map has for every range its number of rows, how
    many come before it, and its last row. It is written last, so a listing that was cut off has none.
    """
    spark = rows.sparkSession
    files = max(1, ceil(rows.count() / rows_per_file))
    ranged = rows.repartitionByRange(files, *_order()).sortWithinPartitions(*_order())
    ranged.withColumn("range", F.spark_partition_id()).write.mode("overwrite").partitionBy("range").parquet(f"{path}/rows")
    rows.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{path}/columns")
    stored = spark.read.schema(ranged.withColumn("range", F.lit(0)).schema).parquet(f"{path}/rows")
    last = F.max(F.struct(F.col("experience").isNull(), -F.col("experience"), "application_id", "experience"))
    zones = stored.groupBy("range").agg(F.count(F.lit(1)).alias("n"), last.alias("_last"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per range
    zones = zones.select("range", "n", before.alias("before"), F.col("_last.experience").alias("experience"), F.col("_last.application_id").alias("application_id"))
    zones.coalesce(1).write.mode("overwrite").parquet(f"{path}/zones")


def _none(spark: SparkSession, path: str) -> DataFrame:
    """The listing's columns without rows."""
    return spark.read.parquet(f"{path}/columns")


def _ranges(spark: SparkSession, path: str, wanted: Column) -> list:
    return spark.read.parquet(f"{path}/zones").where(wanted).orderBy("range").collect()


def _open(spark: SparkSession, path: str, ranges: list) -> DataFrame:
    schema = _none(spark, path).schema.add("range", "integer")
    return spark.read.schema(schema).option("basePath", f"{path}/rows").parquet(*[f"{path}/rows/range={r.range}" for r in ranges])


def read_page(spark: SparkSession, path: str, number: int, size: int) -> DataFrame:
    """Page ``number`` (from 0) of ``size`` rows, in order; opens the ranges it overlaps. Behind the last page there are no rows."""
    low, high = number * size, (number + 1) * size
    ranges = _ranges(spark, path, (F.col("before") < high) & (F.col("before") + F.col("n") > low))
    if not ranges:
        return _none(spark, path)
    first = ranges[0].before
    place = F.row_number().over(Window.orderBy(*_order())) + first - 1  # over the few ranges of a page
    rows = _open(spark, path, ranges).withColumn("_place", place)
    return rows.where(F.col("_place").between(low, high - 1)).drop("range", "_place").orderBy(*_order())


def read_after(spark: SparkSession, path: str, cursor: Cursor | None, size: int) -> DataFrame:
    """The ``size`` rows behind a cursor, in order, from the start without one; opens ranges until they have so many."""
    wanted = F.lit(True) if cursor is None else _after(cursor, F.col("experience"), F.col("application_id"))
    # Ranges that end behind the cursor; the first of them may begin before it.
    ranges = _ranges(spark, path, wanted)
    enough, rows = [], 0
    for r in ranges:
        enough.append(r)
        rows += r.n if len(enough) > 1 or cursor is None else 0
        if rows >= size:
            break
    if not enough:
        return _none(spark, path)
    found = _open(spark, path, enough).drop("range")
    return found.where(wanted).orderBy(*_order()).limit(size)
