"""Whole flows: continuous intake, resume files to candidates, shortlist to messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import fixtures as fx
from checks import oracles as o
from checks.cleaning import candidates
from checks.documents import AS_OF
from checks.oracles import using
from screenforge.plans.intake import read_applications, register
from screenforge.plans.invitation import invite
from screenforge.plans.shortlist import shortlist_many
from screenforge.schemas import APPLICATION
from screenforge.session import scratch_path
from screenforge.streaming.intake import read_intake, start_file_intake, start_intake
from screenforge.streaming.state import start_state_intake


def _yearly(spark, sf, start):
    """Applications arrive in yearly files; the stored table must equal one batch job over all."""
    base = scratch_path(spark, "intake")
    apps = fx.applications(spark, sf)
    apps.withColumn("year", F.year("applied_at")).write.partitionBy("year").parquet(f"{base}/history")
    first, last = spark.read.parquet(f"{base}/history").agg(F.min("year"), F.max("year")).first()
    for year in range(first, last + 1):
        part = spark.read.parquet(f"{base}/history").where(F.col("year") == year)
        part.select(*APPLICATION.fieldNames()).write.mode("append").parquet(f"{base}/incoming")
        stream = spark.readStream.schema(APPLICATION).parquet(f"{base}/incoming")
        start(stream, f"{base}/table", f"{base}/checkpoint", available_now=True).awaitTermination()
    return read_intake(spark, f"{base}/table").select("application_id", "role", "email", "experience")


def w1_continuous_intake(spark, sf):
    """Keys in merged runs beside the table; every year is a stream of its own from the same checkpoint."""
    return _yearly(spark, sf, start_intake)


def w1_state_intake(spark, sf):
    """Keys in the stream's state, which every restart finds again."""
    return _yearly(spark, sf, start_state_intake)


def _history_files(spark, sf):
    """Work histories as DOCX, ODT and text files."""
    kind = F.element_at(F.array(F.lit("txt"), F.lit("docx"), F.lit("odt")), (F.col("doc_id") % 3 + 1).cast("int"))
    return fx.work_histories(spark, sf).select(
        F.col("doc_id").alias("application_id"),
        F.lit("2026-04-01").cast("timestamp_ntz").alias("applied_at"),
        F.when(F.col("doc_id") % 2 == 0, F.lit("QA")).otherwise(F.lit("Developer")).alias("role_raw"),
        F.concat(F.lit("/uploads/"), F.col("doc_id"), F.lit("."), kind).alias("path"),
        fx.file_bytes("text", kind).alias("content"),
    )


def w1_file_intake(spark, sf):
    """The same files as a stream in two deliveries, the second of which repeats every third file under a later id."""
    base = scratch_path(spark, "file-intake")
    files = _history_files(spark, sf)
    again = files.where("application_id % 3 = 0").withColumn("application_id", F.col("application_id") + 100_000_000)
    for part in (files, again):
        part.write.mode("append").parquet(f"{base}/incoming")
        stream = spark.readStream.schema(files.schema).parquet(f"{base}/incoming")
        start_file_intake(stream, f"{base}/table", f"{base}/checkpoint", AS_OF, available_now=True).awaitTermination()
    return read_intake(spark, f"{base}/table").select("application_id", "role", "email", "experience")


def flow_resumes_to_candidates(spark, sf):
    """Resume files read by rule and registered."""
    rows = register(read_applications(_history_files(spark, sf), AS_OF))
    return rows.select(
        "application_id", "role", "name", "email", "location", F.array_join("skills", "|").alias("skills"), "experience"
    )


def flow_shortlist_to_messages(spark, sf):
    """Each request's first five are invited, one mail request per job request."""
    requests = fx.job_requests(spark, sf)
    top = shortlist_many(candidates(spark, sf), requests, fx.skill_vectors(spark, sf))
    schedule = requests.select("request_id", "role").withColumns(
        {"date": F.lit("2025-05-05"), "time": F.lit("10:30"), "venue": F.lit("")}
    )
    messages = invite(top, schedule)
    return messages.select("request_id", F.col("position").cast("long").alias("position"), "email", "subject", "status")


QUERIES = {f.__name__: f for f in (w1_continuous_intake, w1_state_intake, w1_file_intake, flow_resumes_to_candidates, flow_shortlist_to_messages)}

_TITLED = o.title("j.role")

ORACLES = {
    "w1_continuous_intake": using("candidates", body="SELECT application_id, role, email, experience FROM candidates"),
    "w1_state_intake": using("candidates", body="SELECT application_id, role, email, experience FROM candidates"),
    "w1_file_intake": using("histories", body="""SELECT o_orderkey AS application_id,
      CASE WHEN o_orderkey % 2 = 0 THEN 'testing' ELSE 'developer' END AS role, 'resume' || o_orderkey || '@mail.example' AS email,
      years AS experience FROM histories"""),
    "flow_resumes_to_candidates": using("histories", body="""SELECT o_orderkey AS application_id,
        CASE WHEN o_orderkey % 2 = 0 THEN 'testing' ELSE 'developer' END AS role, c_name AS name,
        'resume' || o_orderkey || '@mail.example' AS email, n_name AS location,
        c_mktsegment || '|Planning|spark|Team work' AS skills, years AS experience FROM histories"""),
    "flow_shortlist_to_messages": using("scored", body=f"""SELECT t.request_id, place - 1 AS position, email,
      CASE WHEN coalesce(contains(email, '@'), false) THEN 'Interview invitation: ' || {_TITLED} || ' at Example Company' END AS subject,
      CASE WHEN coalesce(contains(email, '@'), false) THEN 'ready' ELSE 'failed' END AS status
      FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY CASE WHEN any_filter THEN score ELSE 0 END DESC,
        experience DESC, coalesce(len(skills), 0) DESC, application_id) AS place
        FROM scored WHERE NOT any_filter OR score > 0) t JOIN job_requests j USING (request_id) WHERE place <= 5"""),
}
