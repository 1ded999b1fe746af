"""Resume files."""

from __future__ import annotations

import datetime as dt
import os
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from screenforge.functions.text import file_format
from screenforge.operators.joins import shuffle_width
from screenforge.session import BATCH_BYTES, give_memory_back, materialize

_LISTED = "path string, modificationTime timestamp, length long"
# Files of one Arrow batch, at most.
BATCH_FILES = 1_000


def read_resume_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """All files under ``path``: path, modificationTime, length, content and their ``format``.

    A folder of the file system is listed and read by tasks, and its listing is written to the scratch folder, so the driver
    holds nothing per file. Any other store, and a path with wildcards, goes by Spark's file scan, whose listing the driver holds.
    As there, files of zero bytes, which hold no resume, and hidden ones are left out.
    """
    folder = _folder(spark, path)
    if folder is None:
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        if pattern:
            reader = reader.option("pathGlobFilter", pattern)
        files = reader.load(path)
    else:
        parts = max(shuffle_width(spark), spark.sparkContext.defaultParallelism)
        most = int(spark.conf.get("spark.sql.sources.binaryFile.maxLength", str(2**31 - 1)))
        listed = _listing(spark, folder, pattern, parts).repartition(parts, "path")
        files = listed.mapInArrow(_reading(most), f"{_LISTED}, content binary")
    return files.withColumn("format", file_format(F.col("path")))


def _folder(spark: SparkSession, path: str) -> str | None:
    """The folder of the file system that ``path`` names as it stands; None if it is something else."""
    local = re.fullmatch(r"file:(?://)?(/.*)", path, re.DOTALL)
    default = spark.conf.get("spark.hadoop.fs.defaultFS", "file:///")
    plain = local[1] if local else path if path.startswith("/") and default.startswith("file:") else ""
    return os.path.normpath(plain) if plain and not re.search(r"[*?\[\]{}\\]", plain) and os.path.isdir(plain) else None


def _hidden(entry: os.DirEntry) -> bool:
    """Whether Spark's file scan leaves the file or folder out, by its name."""
    name = entry.name
    if name.startswith(("_metadata", "_common_metadata")) and entry.is_dir():
        return False
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _name_rule(pattern: str) -> re.Pattern:
    """The regular expression of a file name pattern, as ``pathGlobFilter`` reads it."""
    out, braces, in_set, escaped = "", 0, False, False
    for at, char in enumerate(pattern):
        if escaped:
            out, escaped = out + re.escape(char), False
        elif char == "\\":
            escaped = True
        elif in_set:
            out += "^" if char == "!" and pattern[at - 1] == "[" else char
            in_set = char != "]"
        elif char in "*?":
            out += ".*" if char == "*" else "."
        elif char == "[":
            out, in_set = out + char, True
        elif char == "{":
            out, braces = out + "(?:", braces + 1
        elif char == "}" and braces:
            out, braces = out + ")", braces - 1
        else:
            out += "|" if char == "," and braces else re.escape(char)
    return re.compile(out, re.DOTALL)


def _listing(spark: SparkSession, folder: str, pattern: str | None, parts: int) -> DataFrame:
    """Path, time and length of every file below ``folder``; level by level, a task lists whole folders."""
    level, found = spark.createDataFrame([(folder,)], "path string").coalesce(1), []
    while True:
        listed = materialize(level.mapInArrow(_listing_of(pattern), _LISTED), "listing")
        found.append(listed.where("length > 0"))
        level = listed.where("length IS NULL").select("path")
        if level.isEmpty():
            return reduce(DataFrame.unionAll, found)
        level = level.repartition(parts, "path")


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.timestamp("us", tz="UTC"), pa.int64())
    columns = [pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, ["path", "modificationTime", "length"])


def _listing_of(pattern: str | None):
    """Function of folders: the files in them, and their folders, without a length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule, rows = pattern and _name_rule(pattern), []
        for batch in batches:
            for folder in batch.column("path").to_pylist():
                with os.scandir(folder) as entries:
                    for entry in entries:
                        if _hidden(entry):
                            continue
                        if entry.is_dir():
                            rows.append((entry.path, None, None))
                        elif not rule or rule.fullmatch(entry.name):
                            try:
                                stat = entry.stat()
                            except FileNotFoundError:  # gone since, or a link to nothing
                                continue
                            changed = dt.datetime.fromtimestamp(stat.st_mtime_ns // 10**9, dt.UTC).replace(microsecond=stat.st_mtime_ns // 10**6 % 1000 * 1000)
                            rows.append((f"file:{entry.path}", changed, stat.st_size))
                        if len(rows) == 10_000:
                            yield _table(rows)
                            rows = []
        if rows:
            yield _table(rows)

    return run


def _reading(most: int):
    """Function of listed files: the same rows with the files' bytes, in batches of about ``BATCH_BYTES``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, held, contents = 0, 0, []
            for at, (path, length) in enumerate(zip(batch.column("path").to_pylist(), batch.column("length").to_pylist(), strict=True)):
                if length > most:
                    raise ValueError(f"{path} has {length} bytes, more than spark.sql.sources.binaryFile.maxLength ({most})")
                with open(path.removeprefix("file:"), "rb") as file:
                    contents.append(file.read())
                held += len(contents[-1])
                if held >= BATCH_BYTES or len(contents) == BATCH_FILES or at == batch.num_rows - 1:
                    rows = batch.slice(start, len(contents))
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(contents, pa.binary())], [*rows.schema.names, "content"])
                    start, held, contents = at + 1, 0, []
        give_memory_back()

    return run


def plain_text(content: Column) -> Column:
    """Bytes of a text file as one string, with ``\\n`` line ends.

    Bytes that are no UTF-8 become the replacement character, so one bad file does not fail a job.
    """
    text = F.make_valid_utf8(content.cast("string"))
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
