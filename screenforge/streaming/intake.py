"""Continuous intake: every arriving batch goes through the same steps as a batch job."""

from __future__ import annotations

import datetime as dt
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from screenforge.operators.dedup import new_applications
from screenforge.plans.intake import read_applications, register
from screenforge.schemas import CANDIDATE
from screenforge.session import materialize
from screenforge.streaming.keys import KeyStore, keyed

_KEYS = T.StructType(
    [T.StructField("role", T.StringType()), T.StructField("email", T.StringType()), T.StructField("batch_id", T.LongType()), T.StructField("bucket", T.IntegerType())]
)
_STORED = T.StructType([*CANDIDATE.fields, T.StructField("batch_id", T.LongType())])


def read_intake(spark: SparkSession, table: str) -> DataFrame:
    """Rows stored so far with the number of their batch."""
    try:
        return spark.read.schema(_STORED).parquet(table)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _STORED)


def _read_keys(spark: SparkSession, table: str) -> DataFrame:
    try:
        return spark.read.schema(_KEYS).parquet(f"{table}_keys")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _KEYS)


def store_batch(applications: DataFrame, batch_id: int, table: str) -> None:
    """Register one batch against all earlier ones.

    Accepted (role, email) keys lie beside the candidates in a :class:`KeyStore`: merged runs, of which a batch opens
    only the folders that can hold its keys. A batch is computed once and replaces only its own folders,
    so a replay after a failure gives the same tables. A table without a manifest of the batch before, as
    from before there were any, gets its keys from its rows first.
    """
    spark = applications.sparkSession
    store = KeyStore(spark, table)
    accepted = materialize(register(applications), "batch")
    runs = store.runs_before(batch_id)
    if runs is None:
        rows = read_intake(spark, table).where(F.col("batch_id") < batch_id).select("batch_id").distinct()
        runs = store.adopt([r.batch_id for r in rows.collect()])
    new = new_applications(accepted, store.known(keyed(accepted), runs))
    new.select(*CANDIDATE.fieldNames()).write.mode("overwrite").parquet(f"{table}/batch_id={batch_id}")
    store.add(keyed(spark.read.schema(CANDIDATE).parquet(f"{table}/batch_id={batch_id}")), batch_id, runs)


def start_intake(stream: DataFrame, table: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Run :func:`store_batch` on a stream of applications.

    No watermark: an email blocks a second application however old the first one is.
    """
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda df, batch_id: store_batch(df, batch_id, table)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def start_file_intake(
    files: DataFrame, table: str, checkpoint: str, as_of: dt.date, available_now: bool = False, **reading: Any
) -> StreamingQuery:
    """The same from a stream of resume files with ``application_id``, ``applied_at`` and ``role_raw``.

    ``reading`` goes to :func:`read_applications`: models, decoders and fallbacks, which run inside each batch.
    """
    writer = files.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda df, batch_id: store_batch(read_applications(df, as_of, **reading), batch_id, table)
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()
