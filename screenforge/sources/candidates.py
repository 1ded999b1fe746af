"""The candidate table: one folder per role, Parquet or CSV."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from screenforge.constants import ROLE_ALIASES
from screenforge.functions.literals import format_list_literal, parse_list_literal
from screenforge.schemas import CANDIDATE, CANDIDATE_CSV, CANDIDATE_WITH_VECTOR
from screenforge.sources.batches import BatchTable

# Keep blanks at the ends of fields, and line ends inside them.
_CSV = {
    "header": "true",
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}
# An absent field is read as null and a quoted empty one as "". Both would be null with the default
# mark, so the mark is a character no text holds.
_CSV_READ = {**_CSV, "multiLine": "true", "nullValue": "\x00"}
# A CSV file with line ends inside fields is read by one task; keep files small.
_CSV_ROWS_PER_FILE = 1_000_000


def write_candidates(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "append") -> None:
    """Add rows to the table, in one folder per role.

    Rows are gathered by role into files of the advised size; a hot role is split over tasks. A
    ``vector`` is stored with its row (Parquet only). Roles are folder names: gather free-text roles
    that are not in use under one name before writing very many of them.
    """
    fields = CANDIDATE.fieldNames() + (["vector"] if fmt == "parquet" and "vector" in df.columns else [])
    rows = df.select(*fields).hint("rebalance", "role")
    writer = rows.write
    if fmt == "csv":
        rows = rows.withColumn("skills", format_list_literal(F.col("skills")))
        writer = rows.write.options(**_CSV).option("maxRecordsPerFile", _CSV_ROWS_PER_FILE)
    writer.partitionBy("role").mode(mode).format(fmt).save(path)


def candidate_batches(spark: SparkSession, path: str) -> BatchTable:
    """The candidate table in batches, for writers that may repeat a write; vectors are stored with the rows."""
    return BatchTable(spark, path, CANDIDATE_WITH_VECTOR, ("role",))


def write_candidate_batch(df: DataFrame, path: str, batch: str) -> bool:
    """Add a named batch of candidates, once: False, and nothing written, if it is there already."""
    if "vector" not in df.columns:
        df = df.withColumn("vector", F.lit(None).cast("array<double>"))
    return candidate_batches(df.sparkSession, path).write(df, batch)


def read_candidate_batches(spark: SparkSession, path: str, role: str | None = None, vectors: bool = False) -> DataFrame:
    """The rows of all complete batches, or one role of them."""
    df = candidate_batches(spark, path).read()
    if role is not None:
        df = df.where(F.col("role") == ROLE_ALIASES.get(role.lower(), role.lower()))
    return df.select(*(CANDIDATE_WITH_VECTOR if vectors else CANDIDATE).fieldNames())


def _named_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV files by the names in their header: a missing column is null, others are left out.

    All files must have the header of the first; another one is an error and not a wrong column. Without
    ``role=`` folders and without a role column the role is the file's name.
    """
    first = spark.read.options(**_CSV_READ).csv(path)
    df = spark.read.options(**_CSV_READ, enforceSchema="false").schema(_as_text(first.schema)).csv(path)
    if "role" not in df.columns:
        df = df.withColumn("role", F.lower(F.regexp_extract(F.input_file_name(), r"([^/]*)\.csv$", 1)))
    fields = [
        F.col(f.name).try_cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name)
        for f in CANDIDATE_CSV.fields
    ]
    return df.select(*fields).withColumn("skills", parse_list_literal(F.col("skills")))


def _as_text(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])


def read_candidates(
    spark: SparkSession, path: str, role: str | None = None, fmt: str = "parquet", vectors: bool = False
) -> DataFrame:
    """The table, or one role of it; with ``vectors`` also the stored vector, null where there is none.

    A missing table is an empty one.
    """
    schema = CANDIDATE_WITH_VECTOR if vectors else CANDIDATE
    try:
        df = _named_csv(spark, path) if fmt == "csv" else spark.read.schema(schema).format(fmt).load(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], schema)
    if fmt == "csv" and vectors:
        df = df.withColumn("vector", F.lit(None).cast("array<double>"))
    if role is not None:
        df = df.where(F.col("role") == ROLE_ALIASES.get(role.lower(), role.lower()))
    return df.select(*schema.fieldNames())


def with_score_column(df: DataFrame) -> DataFrame:
    """Add ``score`` 0 where the table has none."""
    return df if "score" in df.columns else df.withColumn("score", F.lit(0.0))


def to_records(df: DataFrame) -> DataFrame:
    """Each row as a JSON record with all its fields, nulls included."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("record"))
