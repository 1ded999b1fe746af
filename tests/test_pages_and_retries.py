"""Listings at rest and prompts that wait for a quota."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from screenforge.operators.ranking import by_experience
from screenforge.operators.retries import AnswerQueue, start_draining
from screenforge.sources import pages


def people(spark, n=500):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, 0.0, 1.5, 2.0, float(i % 7)]), f"n{i}") for i in range(n)]
    return spark.createDataFrame(rows, "application_id long, experience double, name string").repartition(5)


@pytest.mark.parametrize("size, per_file", [(7, 60), (60, 60), (130, 25), (1, 1000)])
def test_pages_together_are_the_listing(spark, tmp_path, size, per_file):
    rows = people(spark, 500 if size > 1 else 12)
    path = str(tmp_path / "l")
    pages.write_listing(rows, path, per_file)
    want = [tuple(r) for r in by_experience(rows).select("application_id", "experience", "name").collect()]
    ids = lambda df: [tuple(r) for r in df.select("application_id", "experience", "name").collect()]
    for number in (0, 1, 2, len(want) // size):
        assert ids(pages.read_page(spark, path, number, size)) == want[number * size : (number + 1) * size]
    got, cursor = [], None
    while part := ids(pages.read_after(spark, path, cursor, size)):
        got += part
        cursor = pages.Cursor(part[-1][1], part[-1][0])
        if len(got) > 6 * size and size < 60:
            break
    assert got == want[: len(got)] and (len(got) == len(want) or len(got) > 6 * size)
    assert ids(pages.read_page(spark, path, 10_000, size)) == []


def test_a_page_opens_its_own_files(spark, tmp_path):
    path = str(tmp_path / "l")
    pages.write_listing(people(spark), path, 50)
    every = len(spark.read.parquet(f"{path}/rows").inputFiles())
    assert every >= 8
    assert len(pages.read_page(spark, path, 11, 20).inputFiles()) <= 2
    row = pages.read_page(spark, path, 11, 20).collect()[-1]
    assert len(pages.read_after(spark, path, pages.Cursor(row.experience, row.application_id), 20).inputFiles()) <= 3
    pages.write_listing(people(spark).limit(0), str(tmp_path / "none"))
    assert pages.read_page(spark, str(tmp_path / "none"), 0, 5).count() == 0 == pages.read_after(spark, str(tmp_path / "none"), None, 5).count()


def model(name, free):
    return name, lambda prompt: F.struct(
        F.when(free, F.concat(F.lit(f"{name} "), prompt)).alias("reply"), F.when(~free, F.lit("429")).alias("error")
    )


def test_quota_errors_are_answered_once_when_the_quota_is_back(spark, tmp_path):
    queue, day = AnswerQueue(spark, str(tmp_path / "q")), dt.datetime(2026, 1, 1)
    prompts = spark.createDataFrame([(i, f"p{i}") for i in range(20)] + [(50, None)], "request_id long, prompt string")
    queue.put(prompts, "a")
    queue.put(prompts.where("request_id = 3"), "again")  # the same request from another writer
    closed, half, free = [model("m", F.lit(False))], [model("m", F.col("prompt").endswith("5"))], [model("m", F.lit(True))]
    assert queue.drain(closed, "d1", day) and not queue.drain(free, "d1", day)
    assert queue.answers().count() == 0 and queue.due(day).count() == 0
    assert {r.not_before for r in queue.latest().collect()} == {day + dt.timedelta(minutes=1)}
    queue.drain(half, "d2", day + dt.timedelta(minutes=1))
    assert sorted(r.request_id for r in queue.answers().collect()) == [5, 15, 50]  # a null prompt has a null reply
    assert queue.due(day + dt.timedelta(minutes=2)).count() == 0  # the second wait is twice as long
    broken = queue.outcomes
    broken.add_rows(queue.latest().withColumn("done", F.lit(True)).withColumn("attempt", F.lit(9)), "d3")  # cut off before its entry
    queue.drain(free, "d3", day + dt.timedelta(minutes=3))
    answers = queue.answers().collect()
    assert sorted(r.request_id for r in answers) == [*range(20), 50]
    assert {r.reply for r in answers if r.request_id < 20} == {f"m p{i}" for i in range(20)} and all(r.error is None for r in answers)
    assert queue.due(day + dt.timedelta(days=9)).count() == 0


def test_a_stream_drains_what_is_due(spark, tmp_path):
    queue = AnswerQueue(spark, str(tmp_path / "q"), dt.timedelta(0))
    queue.put(spark.createDataFrame([(1, "p")], "request_id long, prompt string"), "a")
    stream = start_draining(queue, [model("m", F.lit(True))], str(tmp_path / "c"), "1 second", lambda: dt.datetime(2026, 1, 1))
    try:
        until = time.time() + 60
        while not queue.answers().count() and time.time() < until and stream.exception() is None:
            time.sleep(1)
    finally:
        stream.stop()
    assert [r.reply for r in queue.answers().collect()] == ["m p"]
