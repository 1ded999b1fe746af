"""Tables of batch folders that a manifest makes visible."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MANIFEST = T.StructType([T.StructField("rows", T.LongType()), T.StructField("batch", T.StringType())])
_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9_.-]*")


class BatchTable:
    """Rows in one folder per batch; a batch is there once its manifest entry, which is written last, is there.

    A write that is repeated under the same name finds its entry and changes nothing; one that was cut off left no entry, its
    files are not read, and the repetition replaces them. Writers of different batches do not meet.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, by: tuple[str, ...] = ()):
        self.spark, self.schema, self.by = spark, schema, by
        self.data, self.manifest = f"{path}/data", f"{path}/manifest"

    def batches(self) -> list[str]:
        """Names of the batches that are there."""
        try:
            rows = self.spark.read.schema(_MANIFEST).parquet(self.manifest).select("batch").distinct().collect()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        return sorted(r.batch for r in rows)

    def holds(self, batch: str) -> bool:
        """Whether a batch is there; looks at its own entry alone."""
        try:
            return not self.spark.read.schema(_MANIFEST).parquet(f"{self.manifest}/batch={batch}").isEmpty()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return False

    def write(self, df: DataFrame, batch: str) -> bool:
        """Add a batch; False if it is there already. Names are letters, digits and ``_ . -``, with a letter or digit first."""
        if not _NAME.fullmatch(batch):
            raise ValueError(f"no name for a batch: {batch!r}")
        if self.holds(batch):
            return False
        self.add_rows(df, batch)
        rows = self.spark.read.schema(self.schema).parquet(f"{self.data}/batch={batch}").count()
        entry = self.spark.createDataFrame([(rows,)], "rows long").coalesce(1)
        entry.write.mode("overwrite").parquet(f"{self.manifest}/batch={batch}")
        return True

    def add_rows(self, df: DataFrame, batch: str) -> None:
        """The first half of :meth:`write`: the batch's files, which nobody reads yet."""
        rows = df.select(*self.schema.fieldNames())
        if self.by:
            rows = rows.hint("rebalance", *self.by)
        rows.write.mode("overwrite").partitionBy(*self.by).parquet(f"{self.data}/batch={batch}")

    def read(self) -> DataFrame:
        """All rows of all batches that are there, with ``batch``."""
        schema = T.StructType([*self.schema.fields, T.StructField("batch", T.StringType())])
        folders = [f"{self.data}/batch={b}" for b in self.batches()]
        if not folders:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).option("basePath", self.data).parquet(*folders)
        return rows.select(*schema.fieldNames()) if self.by else rows.select(*[F.col(n) for n in schema.fieldNames()])
