"""Stored vectors, single decoding, scratch folders, keyed tables."""

import datetime as dt
import glob

import pytest
from pyspark.sql import functions as F

from screenforge import session
from screenforge.operators.outbox import build_outbox, write_outbox
from screenforge.operators.scoring import prepare_requests
from screenforge.plans import intake, shortlist
from screenforge.sources import candidates as store
from screenforge.streaming import intake as streaming

PERSON = "application_id long, applied_at timestamp_ntz, role string, name string, email string, phone string, location string, skills array<string>, experience double, vector array<double>"
REQUEST = "request_id long, role string, skills string, experience double, location string"


def _person(i, skills, vector, role="hr"):
    return (i, dt.datetime(2024, 1, 1), role, f"n{i}", f"{i}@x", "1", "Bonn", skills, 3.0, vector)


def test_cut_keeps_candidates_that_differ_in_the_stored_vector_only(spark, tmp_path):
    rows = [_person(i, ["a", "b"], [0.0, 1.0]) for i in range(6)] + [_person(99, ["b", "a"], [1.0, 0.0]), _person(7, ["a"], [1.0, 0.0], role=None)]
    store.write_candidates(spark.createDataFrame(rows, PERSON), str(tmp_path / "c"))
    stored = store.read_candidates(spark, str(tmp_path / "c"), vectors=True)
    requests = spark.createDataFrame([(1, "hr", "a", 0.0, ""), (2, None, "a", 0.0, "")], REQUEST)
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "skill string, embedding array<double>")
    top = shortlist.shortlist_many(stored, requests, vectors).orderBy("place").collect()
    listed = shortlist.list_matches(stored, shortlist.with_job_vectors(prepare_requests(requests), vectors)).collect()
    assert [r.application_id for r in listed] == [99] and [(r.request_id, r.application_id, r.phone, r.skills) for r in top] == [(1, 99, "1", ["b", "a"])]
    assert store.read_candidates(spark, str(tmp_path / "c")).columns[-1] == "experience"


def test_search_over_stored_vectors_has_no_shuffle_before_the_score(spark, tmp_path):
    store.write_candidates(spark.createDataFrame([_person(1, ["a"], [1.0, 0.0])], PERSON), str(tmp_path / "c"))
    stored = store.read_candidates(spark, str(tmp_path / "c"), vectors=True)
    ready = prepare_requests(spark.createDataFrame([(1, "hr", "a", 0.0, "")], REQUEST)).withColumn("job_vector", F.array(F.lit(1.0), F.lit(0.0)))
    plan = shortlist.score_matches(stored, ready)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange hash" not in plan


def test_csv_of_another_writer(spark, tmp_path):
    (tmp_path / "hr.csv").write_text("name,email,phone,location,skills,experience\nAnn,a@x,123,Oslo,\"['a', 'b']\",2.5\n")
    row = store.read_candidates(spark, str(tmp_path), fmt="csv").first()
    assert (row.application_id, row.role, row.name, row.email, row.phone, row.location, row.skills, row.experience) == (None, "hr", "Ann", "a@x", "123", "Oslo", ["a", "b"], 2.5)


def test_files_are_decoded_once_against_a_stored_table(spark, tmp_path):
    seen = str(tmp_path)

    def decode(content: bytes) -> str:
        import uuid

        open(f"{seen}/{uuid.uuid4().hex}.call", "w").close()
        return "Ann\nann@x.org\n"

    files = spark.createDataFrame([(i, "hr", f"/u/{i}.pdf", bytearray(b"x")) for i in range(10)], "application_id long, role_raw string, path string, content binary")
    files = files.withColumn("applied_at", F.expr("timestamp_ntz'2020-01-01 00:00:00'"))
    stored = spark.createDataFrame([_person(1, [], None)], PERSON).drop("vector")
    rows = intake.register(intake.read_applications(files, dt.date(2026, 4, 1), decoders={"pdf": decode}), stored).collect()
    assert len(rows) == 1 and len(glob.glob(f"{seen}/*.call")) == 10


def test_scratch_folder_on_a_cluster_must_be_set(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return self.folder

        folder = None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(ValueError):
        session.scratch_path(Session, "x")
    Session.sparkContext.folder = "hdfs://shared/"
    assert session.scratch_path(Session, "x").startswith("hdfs://shared/x-")


def test_batch_opens_its_own_key_folders_and_may_be_replayed(spark, tmp_path):
    schema = "application_id long, applied_at timestamp_ntz, role_raw string, name string, email string, phone string, location string, skills array<string>, experience_raw string"

    def batch(*ids):
        return spark.createDataFrame([(i, dt.datetime(2024, 1, 1), "hr", "n", f"{i % 3}@x", None, None, [], "1") for i in ids], schema)

    table = str(tmp_path / "t")
    for n, ids in ((0, (0, 1)), (1, (3, 4, 5)), (1, (3, 4, 5)), (0, (0, 1))):
        streaming.store_batch(batch(*ids), n, table)
    assert sorted(r.application_id for r in streaming.read_intake(spark, table).collect()) == [0, 1, 5]
    keys = streaming._read_keys(spark, table).where("batch_id < 5 AND bucket IN (1, 2)")
    assert "PartitionFilters: [isnotnull" in keys._jdf.queryExecution().executedPlan().toString()


def test_messages_are_never_null_and_never_doubled(spark, tmp_path):
    requests = spark.createDataFrame(
        [(1, ["a@x", "b@x"], ["Ann", None], "hr", "2025-05-05", "10:30", None), (2, ["c@x"], ["Cy"], None, "2025-05-05", "10:30", None)],
        "request_id long, emails array<string>, names array<string>, role string, date string, time string, venue string",
    )
    outbox = build_outbox(requests)
    for _ in range(2):
        write_outbox(outbox, str(tmp_path / "o"))
    rows = sorted(spark.read.parquet(str(tmp_path / "o")).collect(), key=lambda r: r.email)
    assert [(r.status, r.plain is None, r.error) for r in rows] == [("ready", False, None), ("failed", True, "name or role is missing"), ("failed", True, "name or role is missing")]


def test_batches_without_key_folders_still_block(spark, tmp_path):
    table = str(tmp_path / "t")
    people = spark.createDataFrame([_person(i, [], None) for i in (1, 2)] + [(*_person(3, [], None)[:4], None, *_person(3, [], None)[5:])], PERSON).drop("vector")
    for batch, ids in ((0, (1,)), (1, (3,))):
        people.where(F.col("application_id").isin(*ids)).write.parquet(f"{table}/batch_id={batch}")
    applications = people.withColumn("role_raw", F.col("role")).withColumn("experience_raw", F.lit("3"))
    for _ in range(2):
        streaming.store_batch(applications, 2, table)
        stored = streaming.read_intake(spark, table).where("batch_id = 2")
        assert sorted(r.application_id for r in stored.collect()) == [2, 3]
    assert {p.split("=")[-1] for p in glob.glob(f"{table}_keys/batch_id=*")} == {"0", "1", "2"}
