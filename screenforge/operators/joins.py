"""Joins against tables whose size is checked first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Besides its row bound, what is broadcast may have so many bytes, by the sizes below.
MOST_BYTES = 256 << 20


def _bytes_of(value: Column, kind: T.DataType) -> Column:
    """About the bytes of a value: texts by length, lists by their items, 1 kB where the type hides its size."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        size = F.octet_length(value) + 16
    elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StringType, T.BinaryType)):
        size = F.aggregate(value, F.lit(16), lambda total, x: total + F.coalesce(F.octet_length(x), F.lit(0)) + 16)
    elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.NumericType, T.BooleanType)):
        size = F.size(value) * 8 + 16
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.UserDefinedType, T.VariantType)):
        size = F.lit(1024)
    else:
        size = F.lit(8)
    return F.coalesce(size, F.lit(8)).cast("long")


def is_small(df: DataFrame, max_rows: int, max_bytes: int = MOST_BYTES) -> bool:
    """True when ``df`` has at most ``max_rows`` rows and ``max_bytes`` bytes. Looks no further than one row beyond."""
    size = F.lit(0).cast("long")
    for field in df.schema.fields:
        size = size + _bytes_of(df[f"`{field.name}`"], field.dataType)
    rows, total = df.select(size.alias("_size")).limit(max_rows + 1).agg(F.count(F.lit(1)), F.sum("_size")).first()
    return rows <= max_rows and (total or 0) <= max_bytes


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def attach(rows: DataFrame, values: DataFrame, keys: list[str], salt: Column) -> DataFrame:
    """Left join of ``values`` onto ``rows``, of which any share may have one key.

    The keys of ``rows`` are first reduced to one row per key and salt; the value goes to those few,
    and then to the rows by key and salt. A hot key is spread over all salts, and no value is repeated
    for a salt that has no row.
    """
    salted = rows.withColumn("_salt", salt)
    runs = salted.select(*keys, "_salt").distinct()
    return salted.join(runs.join(values, keys), [*keys, "_salt"], "left").drop("_salt")


def may_match(rows: DataFrame, values: DataFrame, key: str, bits: int = 22) -> DataFrame:
    """The ``rows`` whose ``key`` may be among those of ``values``: a filter of one probe, applied where the rows lie.

    The places of the keys are broadcast, 2 ** bits numbers at most, however many there are. A key that is among them
    always passes; of the others as many as the filter is full.
    """
    place = F.shiftrightunsigned(F.xxhash64(key), 64 - bits)
    places = values.select(place.alias("_place")).distinct()
    return rows.withColumn("_place", place).join(F.broadcast(places), "_place", "left_semi").drop("_place")


def lookup_join(
    df: DataFrame, table: DataFrame, on: str, how: str = "left", max_rows: int = 100_000, salts: int | None = None
) -> DataFrame:
    """Inner or left join of ``table``, which has unique keys, onto a large ``df``.

    A table within ``max_rows`` is broadcast. A larger one is joined by shuffle: rows of ``df`` with
    one key are dealt over ``salts`` parts (the shuffle width if not given) by their other values, and
    a key's value goes to the parts that have it, so a key with a third of all rows does not end in one task.
    """
    if is_small(table, max_rows):
        return df.join(F.broadcast(table), on, how)
    salts = salts or shuffle_width(df.sparkSession)
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(salts)).cast("int")
    if how == "left":
        return attach(df, table, [on], salt)
    return attach(df, table.withColumn("_there", F.lit(True)), [on], salt).where("_there").drop("_there")


def spread_join(df: DataFrame, table: DataFrame, key: str, row_id: str, max_rows: int, salts: int | None = None) -> DataFrame:
    """Inner join on a key with few values, each of which may hold a large share of ``df``.

    Within ``max_rows`` the table is broadcast. Otherwise the rows of a key are dealt over
    ``salts`` parts by their id, and the table's rows go to those parts of their key that have any.
    """
    if is_small(table, max_rows):
        return df.join(F.broadcast(table), key)
    salts = salts or shuffle_width(df.sparkSession)
    salt = F.pmod(F.xxhash64(row_id), F.lit(salts)).cast("int")
    return attach(df, table.withColumn("_there", F.lit(True)), [key], salt).where("_there").drop("_there")
