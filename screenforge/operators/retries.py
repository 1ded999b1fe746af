"""Prompts that no model could take yet: asked again later, without a task that waits."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from screenforge.operators.extraction import EXHAUSTED, Model, fallback_chain
from screenforge.sources.batches import BatchTable

FIRST_WAIT = dt.timedelta(minutes=1)

_OUTCOME = T.StructType(
    [
        T.StructField("request_id", T.LongType()),
        T.StructField("prompt", T.StringType()),
        T.StructField("attempt", T.IntegerType()),
        T.StructField("done", T.BooleanType()),
        T.StructField("not_before", T.TimestampNTZType()),
        T.StructField("model", T.StringType()),
        T.StructField("reply", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)


class AnswerQueue:
    """Prompts and what became of them, as a table that is only added to.

    A prompt is put in with a time before which it isn't asked. Every drain asks the due ones along the chain of models and adds
    one batch with an outcome for each: done, with a reply or an error, or over every quota, with a later time. What counts
    is the outcome of the latest attempt, so a drain that was cut off is simply run again, and a prompt
    is answered once. The wait doubles from attempt to attempt.
    """

    def __init__(self, spark: SparkSession, path: str, first_wait: dt.timedelta = FIRST_WAIT):
        self.spark, self.first_wait = spark, first_wait
        self.outcomes = BatchTable(spark, path, _OUTCOME)

    def put(self, prompts: DataFrame, batch: str, not_before: dt.datetime | None = None) -> bool:
        """Add prompts (request_id, prompt), due at once or from a time on."""
        none = F.lit(None).cast("string")
        rows = prompts.select("request_id", "prompt").withColumns(
            {
                "attempt": F.lit(0), "done": F.lit(False), "not_before": F.lit(not_before).cast("timestamp_ntz"),
                "model": none, "reply": none, "error": none,
            }
        )
        return self.outcomes.write(rows, batch)

    def latest(self) -> DataFrame:
        """The present state of every prompt."""
        rest = [f.name for f in _OUTCOME.fields if f.name != "request_id"]
        rows = self.outcomes.read().groupBy("request_id").agg(F.max_by(F.struct(*rest), F.struct("attempt", "done", "batch")).alias("_s"))
        return rows.select("request_id", "_s.*")

    def answers(self) -> DataFrame:
        """request_id, model, reply, error of what is done."""
        return self.latest().where("done").select("request_id", "model", "reply", "error")

    def due(self, now: dt.datetime) -> DataFrame:
        """Prompts to ask now."""
        return self.latest().where(~F.col("done") & (F.col("not_before").isNull() | (F.col("not_before") <= F.lit(now).cast("timestamp_ntz"))))

    def drain(self, models: list[tuple[str, Model]], batch: str, now: dt.datetime) -> bool:
        """Ask what is due and add the outcomes under the batch's name; False if that batch is there."""
        if self.outcomes.holds(batch):
            return False
        asked = fallback_chain(self.due(now).select("request_id", "prompt", "attempt"), models)
        again = F.col("error").eqNullSafe(EXHAUSTED)
        wait = F.make_dt_interval(secs=F.lit(self.first_wait.total_seconds()) * F.pow(F.lit(2.0), F.least("attempt", F.lit(20))))
        rows = asked.select(
            "request_id",
            "prompt",
            (F.col("attempt") + 1).alias("attempt"),
            (~again).alias("done"),
            F.when(again, F.lit(now).cast("timestamp_ntz") + wait).alias("not_before"),
            *[F.when(~again, F.col(c)).alias(c) for c in ("model", "reply", "error")],
        )
        return self.outcomes.write(rows, batch)


def start_draining(
    queue: AnswerQueue, models: list[tuple[str, Model]], checkpoint: str, every: str = "1 minute", clock: Callable[[], dt.datetime] = dt.datetime.now
) -> StreamingQuery:
    """Drain the queue at every trigger of a stream; between triggers nothing runs."""
    ticks = queue.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    writer = ticks.writeStream.option("checkpointLocation", checkpoint).trigger(processingTime=every)
    return writer.foreachBatch(lambda _, number: queue.drain(models, f"drain-{number}", clock())).start()
