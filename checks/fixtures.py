"""Screening tables derived from the test tables, in Spark.

The expressions in capitals are plain SQL that Spark and DuckDB read alike; ``oracles`` uses them too.
"""

from __future__ import annotations

import io
import os
import zipfile
from collections.abc import Iterator
from urllib.parse import urlsplit
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from screenforge.schemas import APPLICATION
from screenforge.session import give_memory_back

ROLE_RAW = """CASE o_orderkey % 7 WHEN 0 THEN 'datascience' WHEN 1 THEN 'Developer' WHEN 2 THEN 'QA'
    WHEN 3 THEN 'data_engineer' WHEN 4 THEN 'cloud_engineer' WHEN 5 THEN 'hr' ELSE 'designer' END"""
NAME = """CASE WHEN o_orderkey % 97 = 0 THEN NULL WHEN o_orderkey % 89 = 0 THEN 'nan'
    WHEN o_orderkey % 83 = 0 THEN '' ELSE c_name END"""
EMAIL = """CASE WHEN o_orderkey % 101 = 0 THEN NULL
    WHEN o_orderkey % 5 = 0 THEN concat('  ', upper(replace(c_name, '#', '.')), '@MAIL.EXAMPLE ')
    ELSE concat(replace(c_name, '#', '.'), '@mail.example') END"""
EXPERIENCE_RAW = """CASE o_orderkey % 8 WHEN 0 THEN '3+'
    WHEN 1 THEN concat(o_orderkey % 23, ' years ', o_orderkey % 11 + 1, ' months')
    WHEN 2 THEN 'Fresher' WHEN 3 THEN concat(o_orderkey % 23, '') WHEN 4 THEN NULL WHEN 5 THEN 'N/A'
    WHEN 6 THEN concat(o_orderkey % 23, '.5') ELSE concat(o_orderkey % 11 + 1, ' months') END"""
LOCATION = "CASE WHEN o_orderkey % 53 = 0 THEN NULL ELSE n_name END"

REQUEST_ROLE = """CASE s_suppkey % 8 WHEN 0 THEN 'developer' WHEN 1 THEN 'datascience' WHEN 2 THEN 'QA'
    WHEN 3 THEN 'data_engineer' WHEN 4 THEN 'Cloud_Engineer' WHEN 5 THEN 'hr' WHEN 6 THEN 'designer'
    ELSE 'Developer' END"""
REQUEST_SKILLS = """CASE s_suppkey % 5 WHEN 0 THEN '' WHEN 1 THEN ' , ' WHEN 2 THEN 'Red,,gear'
    WHEN 3 THEN replace(p_name, ' ', ', ') ELSE upper(replace(p_name, ' ', ',')) END"""
REQUEST_EXPERIENCE = """CAST(CASE s_suppkey % 7 WHEN 0 THEN 0 WHEN 1 THEN 3 WHEN 2 THEN 5.5 WHEN 3 THEN 0
    WHEN 4 THEN 10 ELSE 1 END AS DOUBLE)"""
REQUEST_LOCATION = "CASE s_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN n_name ELSE 'nation_1' END"

# The words in order, dealt over all embeddings.
SKILL_VECTOR_ID = "(number * 7919) % (SELECT count(*) FROM embeddings)"

MAIL_ROLE = """CASE o_orderkey % 4 WHEN 0 THEN 'data_engineer' WHEN 1 THEN 'Developer' WHEN 2 THEN 'qa <lead>'
    ELSE 'hr' END"""
MAIL_TIME = """CASE WHEN o_orderkey % 49 = 0 THEN 'noon' WHEN o_orderkey % 47 = 0 THEN '25:00'
    ELSE concat(o_orderkey % 24, ':', lpad(concat(o_orderkey % 60, ''), 2, '0')) END"""
MAIL_VENUE = """CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat('Hall ', o_orderkey % 10) END"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal out a table that is small enough to be one or few input splits, where the work per row
    is heavy. A large table has splits enough and stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def orders_with_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "orders")
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    )


def applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One application per order; its skills are the words of the parts ordered."""
    # Names are gathered whole and cut into words per order, so that rows follow parts and not words.
    names = (
        table(spark, sf_dir, "lineitem")
        .join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .where("p_name IS NOT NULL")
        .select("l_orderkey", "p_name")
    )
    words = F.flatten(F.transform("_names", lambda name: F.split(name, " ")))
    skills = (
        names.groupBy("l_orderkey")
        .agg(F.collect_set("p_name").alias("_names"))
        .select("l_orderkey", F.sort_array(F.array_distinct(words)).alias("skills"))
    )
    return (
        orders_with_customers(spark, sf_dir)
        .join(skills, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .select(
            F.col("o_orderkey").alias("application_id"),
            F.col("o_orderdate").alias("applied_at"),
            F.expr(ROLE_RAW).alias("role_raw"),
            F.expr(NAME).alias("name"),
            F.expr(EMAIL).alias("email"),
            F.lit(None).cast("string").alias("phone"),
            F.expr(LOCATION).alias("location"),
            "skills",
            F.expr(EXPERIENCE_RAW).alias("experience_raw"),
        )
        .select(*APPLICATION.fieldNames())
    )


def job_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One job request per supplier."""
    return (
        table(spark, sf_dir, "supplier")
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "part"), F.col("s_suppkey") == F.col("p_partkey"))
        .select(
            F.col("s_suppkey").alias("request_id"),
            F.expr(REQUEST_ROLE).alias("role"),
            F.expr(REQUEST_SKILLS).alias("skills"),
            F.expr(REQUEST_EXPERIENCE).alias("experience"),
            F.expr(REQUEST_LOCATION).alias("location"),
        )
    )


# Requests a recruiter might make; the first is the single request of the flagship query.
FORM_REQUESTS = [
    (1, "developer", "red, gear, small", 3.0, "nation_1"),
    (2, "datascience", "red,gear", 0.0, ""),
    (3, "hr", "", 4.5, ""),
    (4, "QA", "", 0.0, "NATION_2"),
    (5, "data_engineer", "", 0.0, ""),
    (6, "designer", "blue, widget", 1.0, ""),
    (7, "Cloud_Engineer", " , ", 0.0, ""),
    (8, "developer", "red,,gear", 0.0, "nation_1"),
]


def form_requests(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        FORM_REQUESTS, "request_id bigint, role string, skills string, experience double, location string"
    )


def skill_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector for each word of the part names."""
    words = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("skill")).distinct()
    vectors = table(spark, sf_dir, "embeddings")
    # The part names are made of a few fixed words.
    number = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("skill")) - 1
    return (
        words.withColumn("vec_id", number.cast("long") * 7919 % F.lit(vectors.count()))
        .join(vectors, "vec_id")
        .select("skill", "embedding")
    )


def mail_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One mail request per order to one to six people; some requests name one person less."""
    k = F.col("o_orderkey")
    numbers = F.transform(F.sequence(F.lit(0), (k % 6).cast("int")), lambda i: (k * 7 + i * 13) % 1000)
    email = lambda n: (
        F.when(n % 9 == 0, F.concat(F.lit("no-address-"), n))
        .when(n % 31 == 0, F.lit(None))
        .otherwise(F.concat(F.lit("contact"), n, F.lit("@mail.example")))
    )
    names = F.transform(numbers, lambda n: F.concat(F.lit("Contact & "), n))
    return spread(table(spark, sf_dir, "orders")).select(
        k.alias("request_id"),
        F.transform(numbers, email).alias("emails"),
        F.when(k % 3 == 0, F.slice(names, F.lit(1), F.cardinality(names) - 1)).otherwise(names).alias("names"),
        F.expr(MAIL_ROLE).alias("role"),
        F.when(k % 50 == 0, F.lit("2025-13-45")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date"),
        F.expr(MAIL_TIME).alias("time"),
        F.expr(MAIL_VENUE).alias("venue"),
    )


def work_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One resume text per order with up to four jobs, and years elsewhere that must not count."""
    k = F.col("o_orderkey")

    def month(column):
        return F.when(k % 2 == 0, F.date_format(column, "MMM yyyy")).otherwise(F.date_format(column, "MMMM yyyy"))

    end = F.add_months(F.col("o_orderdate").cast("date"), (k % 60).cast("int"))
    jobs = [
        (2, F.concat(month("o_orderdate"), F.lit(" to "), month(end))),
        (3, F.concat(month("o_orderdate"), F.when(k % 8 < 4, F.lit(" to Present")).otherwise(F.lit(" - Ongoing")))),
        (5, F.concat(F.date_format("o_orderdate", "yyyy"), F.lit(" - Till Present"))),
        (7, F.concat(k % 11, F.lit(" years "), k % 12, F.lit(" months"))),
    ]
    lines = [
        F.when(k % part != 0, F.concat(F.lit(f"- Employer no. {part}"), k, F.lit(", "), period, F.lit("\n"))).otherwise(F.lit(""))
        for part, period in jobs
    ]
    return spread(orders_with_customers(spark, sf_dir)).select(
        k.alias("doc_id"),
        F.concat(
            F.col("c_name"), F.lit("\nMail: "), F.lit("resume"), k, F.lit("@mail.example"),
            F.lit("\nPhone: +49 30 "), (k + 1000000).cast("string"),
            F.lit("\nLocation: "), F.col("n_name"),
            F.lit("\n\nSummary\n25 years of experience, 1980 to Present\n\nSkills:\n"),
            F.col("c_mktsegment"), F.lit(", Planning; spark\n- Team work\n\n"),
            F.when(k % 2 == 0, F.lit("WORK EXPERIENCE\n")).otherwise(F.lit("Employment History:\n")),
            *lines,
            F.lit("\nEducation\nMay 1985 to Jun 1990\n"),
        ).alias("text"),
    )


def model_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of a model about each application, in good and bad forms."""
    record = F.to_json(
        F.struct("name", "email", "location", "skills", F.col("experience_raw").alias("experience")),
        {"ignoreNullFields": "false"},
    )
    k = F.col("application_id") % 6
    reply = (
        F.when(k == 0, record)
        .when(k == 1, F.concat(F.lit("```json\n"), record, F.lit("\n```")))
        .when(k == 2, F.concat(F.lit("Here it is: "), record, F.lit(" That is all.")))
        .when(k == 3, F.expr("left(_record, length(_record) - 5)"))
        .when(k == 4, F.concat(record, F.lit(" and "), record))
        .otherwise(F.lit("I cannot read this resume."))
    )
    return (
        applications(spark, sf_dir)
        .withColumn("_record", record)
        .select("application_id", reply.alias("reply"))
    )


def docx_bytes(text: str) -> bytes:
    """A DOCX file with one paragraph per line, split into two runs, and a table that must not count."""
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"

    def run(part: str) -> str:
        if "\t" not in part:
            return f'<w:r><w:t xml:space="preserve">{escape(part)}</w:t></w:r>'
        return "<w:r>" + "<w:tab/>".join(f'<w:t xml:space="preserve">{escape(t)}</w:t>' for t in part.split("\t")) + "</w:r>"

    lines = []
    for line in text.split("\n"):
        half = len(line) // 2
        lines.append(f"<w:p>{run(line[:half])}<w:hyperlink>{run(line[half:])}</w:hyperlink></w:p>")
    cells = "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    body = f'<?xml version="1.0"?><w:document xmlns:w="{w}"><w:body>{"".join(lines)}{cells}</w:body></w:document>'
    return _zipped("word/document.xml", body)


def odt_bytes(text: str) -> bytes:
    """An ODT file with one paragraph per line and a heading that must not count."""
    office, ns = "urn:oasis:names:tc:opendocument:xmlns:office:1.0", "urn:oasis:names:tc:opendocument:xmlns:text:1.0"
    lines = "".join(
        f"<text:p><text:span>{escape(line)}</text:span></text:p>".replace("\t", "<text:tab/>").replace("  ", '<text:s text:c="2"/>')
        for line in text.split("\n")
    )
    body = (
        f'<?xml version="1.0"?><office:document-content xmlns:office="{office}" xmlns:text="{ns}">'
        f"<office:body><office:text><text:h>Heading</text:h>{lines}</office:text></office:body></office:document-content>"
    )
    return _zipped("content.xml", body)


def _zipped(name: str, body: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr(name, body)
    return out.getvalue()


@F.pandas_udf(T.BinaryType())
def file_bytes(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    makers = {"docx": docx_bytes, "odt": odt_bytes}
    for text, kind in batches:
        yield pd.Series([makers.get(k, lambda t: t.encode())(t) for t, k in zip(text, kind, strict=True)], dtype=object)
    give_memory_back()


def document_files(spark: SparkSession, sf_dir: str, suffix) -> DataFrame:
    """The documents as files in the shape of a file scan: doc_id, path, content."""
    docs = documents(spark, sf_dir).select("doc_id", "text", suffix.alias("suffix"))
    return docs.select(
        "doc_id",
        F.concat(F.lit("/uploads/resume-"), F.col("doc_id"), F.lit("."), F.col("suffix")).alias("path"),
        file_bytes("text", F.lower("suffix")).alias("content"),
    )


def write_text_files(values: DataFrame, path: str) -> None:
    """Every ``value`` as a text file of its own below ``path``, with a line end behind it.

    In a folder of the file system the tasks write the files themselves: Hadoop's local file system starts two processes
    for each. A repeated task writes the same names again, and a file is there whole or not at all. Any other store gets
    them from Spark's writer.
    """
    default = values.sparkSession.conf.get("spark.hadoop.fs.defaultFS", "file:///")
    if (urlsplit(path).scheme or urlsplit(default).scheme) != "file":
        values.write.option("maxRecordsPerFile", 1).text(path)
        return
    base = urlsplit(path).path

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, count = TaskContext.get(), 0
        folder = f"{base}/part-{task.partitionId():05d}"
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            for value in batch.column("value"):
                name = f"{folder}/{count:08d}.txt"
                started = f"{name}.{task.taskAttemptId()}"
                with open(started, "wb") as file:
                    file.write(value.as_py().encode() + b"\n")
                os.replace(started, name)
                count += 1
        yield pa.RecordBatch.from_arrays([pa.array([count], pa.int64())], ["files"])

    os.makedirs(base, exist_ok=True)
    values.mapInArrow(write, "files long").agg(F.sum("files")).collect()


PAGE_CHARS = 500


def resume_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents cut into pages; every seventh page of a document could not be read."""
    pages = F.greatest(F.ceil(F.length("text") / PAGE_CHARS).cast("int"), F.lit(1))
    cut = documents(spark, sf_dir).select("doc_id", "text", F.explode(F.sequence(pages, F.lit(1))).alias("page_no"))
    part = F.substring("text", (F.col("page_no") - 1) * PAGE_CHARS + 1, F.lit(PAGE_CHARS))
    return cut.select("doc_id", "page_no", F.when(F.col("page_no") % 7 != 0, part).alias("text"))
