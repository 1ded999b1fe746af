"""Key store, keyed state, manifest tables, delivery log, delivery filter."""

import datetime as dt
import glob
import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from screenforge.operators import dedup
from screenforge.operators.outbox import DeliveryLog, build_outbox
from screenforge.plans.intake import register
from screenforge.schemas import APPLICATION
from screenforge.sources import candidates as store
from screenforge.sources.batches import BatchTable
from screenforge.streaming import intake, keys, state
from screenforge.streaming.keys import KeyStore, Run, keyed, merge_plan
from screenforge.streaming.state import start_state_intake


def application(i, email, minute=0, role="hr", name="n"):
    return (i, dt.datetime(2024, 1, 1, 0, minute % 60), role, name, email, None, None, [], "1")


def applications(spark, rows):
    return spark.createDataFrame(rows, APPLICATION)


def deliveries(n, seed=3):
    """Batches of applications in which emails come back, also under other roles, in one batch and later."""
    rng = random.Random(seed)
    return [
        [application(100 * b + i, rng.choice([None, "", f"{rng.randint(0, 60)}@x", f" {rng.randint(0, 60)}@X "]), rng.randint(0, 59), rng.choice(["hr", "QA"])) for i in range(20)]
        for b in range(n)
    ]


def first_ones(batches):
    """Plain version: the first of each batch by time and id, if its key has never been there."""
    seen, out = set(), set()
    for rows in batches:
        for row in sorted(rows, key=lambda r: (r[1], r[0])):
            email = (row[4] or "").strip().lower()
            key = ({"qa": "testing"}.get(row[2].lower(), row[2].lower()), email)
            if not email or key not in seen:
                out.add(row[0])
                seen.add(key)
    return out


def stored(spark, table):
    rows = intake.read_intake(spark, table).collect()
    assert len({r.application_id for r in rows}) == len(rows)
    return {r.application_id for r in rows}


# --- key store --------------------------------------------------------------------------------------


def test_runs_stay_few():
    runs, most = [], 0
    for batch in range(1000):
        runs.append(Run(str(batch), 0, 1))
        while plan := merge_plan(runs, 8):
            group = plan[0]
            runs = [r for r in runs if r not in group] + [Run(f"m{batch}", group[0].level + 1, sum(r.keys for r in group))]
        most = max(most, len(runs))
        assert sum(r.keys for r in runs) == batch + 1
    assert most <= 7 * 4


def test_many_batches_equal_a_plain_run_and_open_few_folders(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(KeyStore.__init__, "__defaults__", (3,))
    opened = []
    inner = KeyStore.folders

    def folders(self, rows, runs):
        found = inner(self, rows, runs)
        opened.append((len(runs), len(found)))
        return found

    monkeypatch.setattr(KeyStore, "folders", folders)
    table, batches = str(tmp_path / "t"), deliveries(14)
    for n, rows in enumerate(batches):
        intake.store_batch(applications(spark, rows), n, table)
    assert stored(spark, table) == first_ones(batches)
    assert max(runs for runs, _ in opened) <= 2 * 3
    assert glob.glob(f"{table}_merged_keys/run=2-*")
    # An older batch and the last one again: the same rows, the same manifest.
    before = sorted(os.listdir(f"{table}_key_manifests"))
    for n in (5, 13):
        intake.store_batch(applications(spark, batches[n]), n, table)
        assert stored(spark, table) == first_ones(batches)
    assert sorted(os.listdir(f"{table}_key_manifests")) == before


def test_new_keys_open_no_folder_and_known_ones_their_own(spark, tmp_path):
    table = str(tmp_path / "t")
    intake.store_batch(applications(spark, [application(i, f"{i}@x") for i in range(300)]), 0, table)
    store_ = KeyStore(spark, table)
    runs = store_.runs_before(1)
    assert [(r.name, r.level, r.keys) for r in runs] == [("0", 0, 300)]
    known = keyed(applications(spark, [application(1, "7@x")]).withColumn("role", F.col("role_raw")))
    assert len(store_.folders(known, runs)) == 1
    fresh = keyed(applications(spark, [application(1, f"new{i}@x") for i in range(5)]).withColumn("role", F.col("role_raw")))
    assert len(store_.folders(fresh, runs)) <= 1
    assert {(r.role, r.email) for r in store_.known(known, runs).collect()} >= {("hr", "7@x")}


def test_batch_cut_off_before_its_manifest_is_not_seen(spark, tmp_path, monkeypatch):
    table, batches = str(tmp_path / "t"), deliveries(3)
    intake.store_batch(applications(spark, batches[0]), 0, table)

    def fail(self, frame, run):
        raise RuntimeError("cut off")

    with monkeypatch.context() as patch:
        patch.setattr(KeyStore, "_write_map", fail)
        with pytest.raises(RuntimeError):
            intake.store_batch(applications(spark, batches[1]), 1, table)
    for n in (1, 2):
        intake.store_batch(applications(spark, batches[n]), n, table)
    assert stored(spark, table) == first_ones(batches)


def test_large_runs_open_their_own_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keys, "FLAT_KEYS", 25)
    table, batches = str(tmp_path / "t"), [[application(100 * b + i, f"{(13 * b + i) % 160}@x") for i in range(40)] for b in range(9)]
    for n, rows in enumerate(batches):
        intake.store_batch(applications(spark, rows), n, table)
    assert stored(spark, table) == first_ones(batches)
    store_ = KeyStore(spark, table)
    known = keyed(applications(spark, [application(1, "7@x")]).withColumn("role", F.col("role_raw")))
    opened = store_.folders(known, store_.runs_before(9))
    assert len(opened) == 1 and "/bucket=" in opened[0]


def test_bitmaps_name_every_shared_bucket():
    mine, other = keys._bytes([]), keys._bytes([])
    mine[5], other[5] = 0b110, 0b011
    mine[-1], other[-1] = 1, 2
    assert keys.shared_buckets(mine, other) == [0]


# --- keyed state ------------------------------------------------------------------------------------


def test_state_intake_equals_batches_over_restarts(spark, tmp_path):
    batches = deliveries(4)
    hot = [application(9000 + i, "hot@x", i) for i in range(200)]
    batches[2] = batches[2] + hot
    for rows in batches:
        applications(spark, rows).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(APPLICATION).parquet(str(tmp_path / "in"))
        start_state_intake(stream, str(tmp_path / "t"), str(tmp_path / "c"), available_now=True).awaitTermination()
    assert stored(spark, str(tmp_path / "t")) == first_ones(batches)
    assert glob.glob(str(tmp_path / "c" / "state" / "0" / "*" / "*.zip")) or glob.glob(str(tmp_path / "c" / "state" / "0" / "*" / "*.changelog"))
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_state_holds_keys_in_spark_and_first_rows_win(spark, tmp_path):
    """Keys are kept by Spark's own deduplication, without a call per key; absent times and roles are the first of their key."""
    odd = [(5, None, "hr", "n", "a@x", None, None, [], "1"), (2**53 + 1, dt.datetime(2024, 1, 1), "hr", "n", "A@x ", None, None, [], "1"),
           (2**53 + 3, dt.datetime(2024, 1, 2), None, "n", "a@x", None, None, [], "1"), (2**53 + 2, dt.datetime(2024, 1, 2), None, "n", "a@x", None, None, [], "1")]
    applications(spark, odd).repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(APPLICATION).parquet(str(tmp_path / "in"))
    query = start_state_intake(stream, str(tmp_path / "t"), str(tmp_path / "c"), available_now=True)
    query.awaitTermination()
    assert stored(spark, str(tmp_path / "t")) == {5, 2**53 + 2}
    assert [o["operatorName"] for o in query.lastProgress["stateOperators"]] == ["dedupe"]


def test_first_rows_of_a_task_are_held_in_bounds(monkeypatch):
    monkeypatch.setattr(state, "HELD_ROWS", 7)
    rng = random.Random(5)
    rows = [{"role": rng.choice(["a", None]), "_slot": str(rng.randint(0, 9)), "applied_at": rng.choice([None, 1, 2]), "application_id": i} for i in range(200)]
    shape = pa.schema({"role": pa.string(), "_slot": pa.string(), "applied_at": pa.int64(), "application_id": pa.int64()})
    batches = [pa.RecordBatch.from_pylist(rows[i : i + 6], shape) for i in range(0, 200, 6)]
    got = {r["application_id"] for b in state._first_of_part(iter(batches)) for r in b.to_pylist()}
    best = {}
    for r in sorted(rows, key=lambda r: (r["applied_at"] is not None, r["applied_at"] or 0, r["application_id"])):
        best.setdefault((r["role"], r["_slot"]), r["application_id"])
    assert got == set(best.values())
    assert list(state._first_of_part(iter([]))) == []


# --- manifest tables --------------------------------------------------------------------------------


def test_batches_are_seen_once_and_whole(spark, tmp_path):
    people = register(applications(spark, [application(i, f"{i}@x", role=r) for i, r in enumerate(["hr", "QA", "hr"])]))
    path = str(tmp_path / "c")
    assert store.read_candidate_batches(spark, path).count() == 0
    assert store.write_candidate_batch(people, path, "007")
    assert not store.write_candidate_batch(people.limit(1), path, "007")
    table = store.candidate_batches(spark, path)
    table.add_rows(people.withColumn("vector", F.lit(None).cast("array<double>")), "half")  # killed before its entry
    assert table.batches() == ["007"] and store.read_candidate_batches(spark, path).count() == 3
    assert store.write_candidate_batch(people.where("role = 'hr'"), path, "half")
    assert sorted(r.application_id for r in store.read_candidate_batches(spark, path).collect()) == [0, 0, 1, 2, 2]
    assert [r.application_id for r in store.read_candidate_batches(spark, path, "QA").collect()] == [1]
    plan = store.read_candidate_batches(spark, path, "QA")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(role" in plan
    assert {r.batch for r in table.read().collect()} == {"007", "half"}


def test_empty_batch_and_bad_names(spark, tmp_path):
    table = BatchTable(spark, str(tmp_path / "b"), APPLICATION)
    assert table.write(applications(spark, []), "none") and not table.write(applications(spark, []), "none")
    assert table.read().count() == 0
    for name in ("", "../x", "a/b", ".hidden", "_x"):
        with pytest.raises(ValueError):
            table.write(applications(spark, []), name)


# --- delivery log -----------------------------------------------------------------------------------


def test_writers_and_reports_in_any_order_give_one_row_per_message(spark, tmp_path):
    requests = spark.createDataFrame(
        [(r, [f"{r}{i}@x" for i in range(3)], ["a", "b", None], "hr", "2025-05-05", "10:30", None) for r in (1, 2)],
        "request_id long, emails array<string>, names array<string>, role string, date string, time string, venue string",
    )
    outbox, day = build_outbox(requests), dt.datetime(2025, 1, 1)
    report = "request_id long, position int, attempt int, status string, error string, reported_at timestamp_ntz"
    reports = {
        "r3": [(1, 0, 3, "sent", None, day), (9, 9, 1, "sent", None, day)],
        "r1": [(1, 0, 1, "failed", "busy", day), (1, 1, 1, "failed", "busy", day)],
        "r2": [(1, 0, 2, "failed", "busy", day), (1, 1, 1, "sent", None, day + dt.timedelta(hours=1)), (1, 0, 2, "failed", "busy", day)],
    }
    expected = None
    for n, order in enumerate((["r3", "r1", "r2"], ["r1", "r2", "r3"], ["r2", "r2", "r3", "r1"])):
        log = DeliveryLog(spark, str(tmp_path / str(n)))
        assert log.outbox().count() == 0
        for writer in ("one", "two", "one"):
            log.add_messages(outbox.where("request_id = 1" if writer == "two" else "true"), writer, day + dt.timedelta(hours=len(writer)))
        assert log.pending().count() == 4
        for name in order:
            log.add_reports(spark.createDataFrame(reports[name], report), name)
        rows = sorted((r.request_id, r.position, r.email, r.status, r.error, r.attempt) for r in log.outbox().collect())
        expected = expected or rows
        assert rows == expected and len(rows) == 6
        assert log.pending().count() == 2
    assert expected[0] == (1, 0, "10@x", "sent", None, 3) and expected[1] == (1, 1, "11@x", "sent", None, 1)
    assert expected[2][3:] == ("failed", "name or role is missing", 0)


# --- large deliveries -------------------------------------------------------------------------------


def test_history_is_cut_to_possible_keys_before_its_shuffle(spark, monkeypatch):
    monkeypatch.setattr(dedup, "FILTER_BITS", 12)
    old = spark.range(4000).select(F.lit("hr").alias("role"), F.concat("id", F.lit("@x")).alias("email"))
    new = spark.range(100, 140).select(F.col("id").alias("application_id"), F.lit("hr").alias("role"), F.concat(F.col("id") * 100, F.lit("@x")).alias("email"))
    fresh = dedup.new_applications(new, old, max_rows=0)
    assert fresh.count() == 40 - len({i for i in range(100, 140) if i * 100 < 4000})
    same = dedup.registered_applications(spark.range(50).select(F.col("id").alias("application_id"), F.lit("hr").alias("role"), F.concat("id", F.lit("@x")).alias("email")), old, max_rows=0)
    assert same.count() == 50
    stored_keys = old.select("role", F.col("email").alias("_slot"))
    slots = stored_keys.limit(40)
    assert 40 <= dedup._possible(stored_keys, slots).count() < 200


def test_the_merge_of_a_log_carries_no_text_that_is_not_asked_for(spark, tmp_path):
    log = DeliveryLog(spark, str(tmp_path / "log"))
    rows = [(1, 0, "a@x.example", "A", "subject", "plain", "html", "ready", None)]
    messages = spark.createDataFrame(rows, "request_id long, position int, email string, name string, subject string, plain string, html string, status string, error string")
    log.add_messages(messages, "first", dt.datetime(2025, 5, 1))
    few = log.outbox().select("request_id", "email", "status")
    plan = few._jdf.queryExecution().optimizedPlan().toString()
    assert "min_by" in plan and not any(f"{name} " in plan or f"{name}#" in plan.split("Relation")[0] for name in ("html", "plain", "subject"))
    assert [tuple(r) for r in few.collect()] == [(1, "a@x.example", "ready")]
    assert [(r.html, r.attempt) for r in log.outbox().collect()] == [("html", 0)]
