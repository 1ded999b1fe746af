"""What the physical plans must and must not contain."""

import re

import pytest
from pyspark.sql import functions as F

from checks import fixtures as fx
from checks import matching
from screenforge.operators import dedup, ranking
from screenforge.operators.documents import assemble_pages
from screenforge.operators.scoring import match, prepare_requests
from screenforge.plans import intake, shortlist
from screenforge.schemas import CANDIDATE


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, sf_dir):
    return matching._stored_candidates(spark, sf_dir)


def test_dedup_cuts_before_its_only_shuffle(stored):
    text = plan(dedup.dedup_first(stored))
    assert text.count("WindowGroupLimit") == 2 and text.count("Exchange hashpartitioning") == 1


def test_single_request_prunes_role_and_columns(spark, stored):
    request = prepare_requests(fx.form_requests(spark).where("request_id = 1"))
    text = plan(match(stored.where(F.col("role") == "developer"), request).select("request_id", "application_id"))
    assert re.search(r"PartitionFilters: \[.*role", text)
    schema = re.search(r"ReadSchema: struct<(.*?)>", text).group(1)
    assert "name" not in schema and "email" not in schema and "skills" not in schema
    assert "BroadcastHashJoin" in text and "Exchange hashpartitioning" not in text


def test_no_pair_join_in_shortlists(spark, sf_dir, stored):
    df = shortlist.shortlist_many(stored, fx.job_requests(spark, sf_dir), fx.skill_vectors(spark, sf_dir))
    text = plan(df)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert text.count("FlatMapCoGroupsInPandas") == 1 and text.count("WindowGroupLimit") == 2
    # The vectors meet the requests after one shuffle, by role and block.
    assert len(re.findall(r"Exchange hashpartitioning\(role#\d+, block#\d+, request_block#\d+", text)) == 2


def test_default_list_takes_the_head_without_a_full_sort(stored):
    text = plan(ranking.most_experienced(stored))
    assert "TakeOrderedAndProject" in text and "Exchange" not in text
    assert "PushedFilters: [IsNotNull(experience), GreaterThan(experience,0.0)]" in text


def test_intake_keeps_to_the_jvm(spark, sf_dir):
    text = plan(intake.register(fx.applications(spark, sf_dir)))
    assert "Python" not in text and "Pandas" not in text and "Cartesian" not in text


def test_pages_are_joined_in_one_shuffle(spark, sf_dir):
    pages = spark.createDataFrame([(1, 1, "a")], "doc_id long, page_no int, text string")
    assert plan(assemble_pages(pages)).count("Exchange hashpartitioning") == 1


def test_empty_candidates(spark, sf_dir):
    nobody = spark.createDataFrame([], CANDIDATE)
    df = shortlist.shortlist_many(nobody, fx.job_requests(spark, sf_dir), fx.skill_vectors(spark, sf_dir))
    assert df.count() == 0


def test_each_file_is_decoded_once(spark):
    import datetime as dt

    files = spark.createDataFrame(
        [(1, "qa", "/u/a.docx", bytearray(b""))], "application_id long, role_raw string, path string, content binary"
    ).withColumn("applied_at", F.expr("timestamp_ntz'2020-01-01 00:00:00'"))
    rows = intake.register(intake.read_applications(files, dt.date(2026, 4, 1)))
    assert plan(rows).count("ArrowEvalPython") == 1
    again = intake.read_applications(files, dt.date(2026, 4, 1), fallbacks={"pdf": bytes.decode})
    assert plan(intake.register(again)).count("ArrowEvalPython") == 2
