"""Dedup, matching and ranking on small fixtures against plain Python, also where one key is hot."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from checks import fixtures as fx
from checks import matching as query_checks
from screenforge.operators import dedup, joins, ranking, scoring
from screenforge.operators.similarity import add_skill_vector, embed
from screenforge.plans import intake, shortlist
from screenforge.schemas import CANDIDATE as CANDIDATE_TABLE

CANDIDATE = "application_id long, role string, name string, email string, location string, skills array<string>, experience double"
SKILLS = ["sql", "java", "python", "excel", "spark", "law"]
PLACES = ["Berlin", "berlin mitte", "Köln", None, "Bonn"]
ROLES = ["developer", "hr", "pilot"]
WEIGHTS = {"developer": (50, 30, 20), "hr": (30, 40, 30), "pilot": (50, 30, 20)}


def people(n, seed=1):
    rnd = random.Random(seed)
    return [
        (
            i,
            # One role holds more than a third of all rows.
            "developer" if i % 5 < 2 else rnd.choice(ROLES),
            f"n{i}",
            f"{i}@x",
            rnd.choice(PLACES),
            rnd.choice([None, [], *[rnd.sample(SKILLS, rnd.randint(1, 4)) for _ in range(6)]]),
            rnd.choice([0.0, 1.5, 3.0, 3.0, 7.0]),
        )
        for i in range(n)
    ]


def jobs(n, seed=2):
    rnd = random.Random(seed)
    return [
        (
            i,
            rnd.choice(["Developer", "hr", "pilot", "unknown"]),
            rnd.choice(["", " , ", ",".join(rnd.sample(SKILLS, 2)), rnd.choice(SKILLS).upper()]),
            rnd.choice([0.0, 0.0, 2.0, 9.0]),
            rnd.choice(["", "BERLIN", "köln", "b"]),
        )
        for i in range(n)
    ]


def vectors(dims=8, seed=3):
    rnd = random.Random(seed)
    return {s: [rnd.uniform(-1, 1) for _ in range(dims)] for s in SKILLS[:-1]}


def expected_ranking(candidates, requests, vecs):
    """Plain Python over all pairs."""

    def total(skills):
        known = [vecs[s] for s in skills if s in vecs]
        return [sum(x) for x in zip(*known, strict=True)] if known else None

    def cosine(a, b):
        if a is None or b is None:
            return 0.0
        norm = sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5
        return sum(x * y for x, y in zip(a, b, strict=True)) / norm * 100

    out = {}
    for rid, role, wanted_skills, minimum, place in requests:
        wanted = [s.strip().lower() for s in wanted_skills.split(",") if s.strip()]
        w = WEIGHTS.get(role.lower())
        rows = []
        for aid, arole, _, _, location, skills, years in candidates:
            if arole != role.lower():
                continue
            near = location is not None and place.lower() in location.lower()
            if (minimum > 0 and years < minimum) or (place and not near):
                continue
            raw = cosine(total(skills or []), total(wanted)) if wanted else 0.0
            if wanted and raw < 15:
                score = 0.0
            else:
                score = raw * w[0] / 100 + (w[1] if years >= minimum else 0) + (w[2] if place and near else 0)
                score = round(score if wanted or score else 1.0, 2)
            filtering = bool(wanted) or minimum != 0 or place != ""
            if not filtering or score > 0:
                rows.append(((-score if filtering else 0, -years, -len(skills or []), aid), score))
        out[rid] = [(key[3], score) for key, score in sorted(rows)]
    return out


@pytest.fixture(scope="module")
def world(spark):
    candidates, requests, vecs = people(300), jobs(40), vectors()
    frames = (
        spark.createDataFrame(candidates, CANDIDATE).repartition(4),
        spark.createDataFrame(requests, "request_id long, role string, skills string, experience double, location string"),
        spark.createDataFrame(list(vecs.items()), "skill string, embedding array<double>"),
    )
    return frames, expected_ranking(candidates, requests, vecs)


def by_request(rows):
    out = {}
    for r in rows:
        out.setdefault(r.request_id, []).append((r.application_id, round(r.score, 2)))
    return out


def test_full_listing(world):
    (candidates, requests, vecs), expected = world
    ready = shortlist.with_job_vectors(scoring.prepare_requests(requests), vecs)
    listed = shortlist.list_matches(add_skill_vector(candidates, vecs, "application_id"), ready).collect()
    assert by_request(listed) == {k: v for k, v in expected.items() if v}


@pytest.mark.parametrize("k", [1, 5, 1000])
def test_shortlists_equal_the_head_of_the_full_listing(world, k):
    (candidates, requests, vecs), expected = world
    rows = shortlist.shortlist_many(candidates, requests, vecs, k).orderBy("request_id", "place").collect()
    assert by_request(rows) == {key: v[:k] for key, v in expected.items() if v}


@pytest.mark.parametrize("request_blocks", [1, 3])
def test_shortlists_with_stored_vectors_and_few_blocks(world, monkeypatch, request_blocks):
    (candidates, requests, vecs), expected = world
    stored = add_skill_vector(candidates, vecs, "application_id")
    monkeypatch.setattr(ranking, "_CELLS", 50)
    ready = shortlist.with_job_vectors(scoring.prepare_requests(requests), vecs)
    rows = ranking.shortlists(stored, ready, blocks=2, request_blocks=request_blocks).orderBy("request_id", "place").collect()
    assert by_request(rows) == {key: v[:5] for key, v in expected.items() if v}


def test_a_block_scores_only_people_a_request_lets_through():
    """People elsewhere, or with too few years, meet no matrix product: their vectors here would make it fail."""
    odd, fine = np.array([np.inf, -np.inf]), np.array([1.0, 0.0])
    people = pd.DataFrame(
        [("a", 5.0, 1, 1, "Here", fine), ("b", 4.0, 1, 2, "here too", fine), ("c", 9.0, 1, 3, "away", odd), ("d", 1.0, 1, 4, "here", odd), ("e", 9.0, 1, 5, None, odd), ("f", None, 1, 6, "here", odd)],
        columns=["name", "experience", "skill_count", "application_id", "location", "vector"],
    ).assign(email=None, phone=None, skills=None)
    columns = ["request_id", "wants_skills", "min_experience", "wanted_location", "any_filter", "w_skills", "w_experience", "w_location", "job_vector"]
    jobs = pd.DataFrame([(1, True, 2.0, "here", True, 50, 30, 20, fine), (2, True, 4.5, "here", True, 50, 30, 20, fine), (3, False, 0.0, "", False, 50, 30, 20, None), (4, True, np.nan, "here", True, 50, 30, 20, fine)], columns=columns)
    with np.errstate(all="raise"):
        best = ranking._block_shortlist(2, 15.0)(people, jobs)
    found = sorted(zip(best["request_id"], best["application_id"], best["score"], strict=True))
    assert found == [(1, 1, 100.0), (1, 2, 100.0), (2, 1, 100.0), (3, 3, 30.0), (3, 5, 30.0)]


def test_top_matches(world):
    (candidates, requests, vecs), expected = world
    ready = shortlist.with_job_vectors(scoring.prepare_requests(requests), vecs)
    scored = shortlist.score_matches(add_skill_vector(candidates, vecs, "application_id"), ready)
    rows = ranking.top_matches(scored).orderBy("request_id", "place").collect()
    assert by_request(rows) == {key: v[:5] for key, v in expected.items() if v}


def test_scores_stay_in_range(world):
    (candidates, requests, vecs), _ = world
    ready = shortlist.with_job_vectors(scoring.prepare_requests(requests), vecs)
    scored = shortlist.score_matches(add_skill_vector(candidates, vecs, "application_id"), ready)
    low, high = scored.agg(F.min("score"), F.max("score")).first()
    assert low > 0 and high <= 100


def test_salted_join_equals_broadcast_join(world):
    (candidates, requests, _), _ = world
    ready = scoring.prepare_requests(requests)
    small = scoring.match(candidates, ready).select("request_id", "application_id").collect()
    large = scoring.match(candidates, ready, max_broadcast=0)
    assert sorted(large.select("request_id", "application_id").collect()) == sorted(small)
    assert "_salt" in large._jdf.queryExecution().optimizedPlan().toString()


def test_lookup_join_beyond_the_bound(spark, world):
    (candidates, _, vecs), _ = world
    words = candidates.select("application_id", F.explode("skills").alias("skill"))
    one = joins.lookup_join(words, vecs, "skill", "inner").collect()
    two = joins.lookup_join(words, vecs, "skill", "inner", max_rows=0).collect()
    assert sorted(one) == sorted(two)


def test_is_small(spark):
    assert joins.is_small(spark.range(10), 10)
    assert not joins.is_small(spark.range(11), 10)
    wide = spark.createDataFrame([("x" * 100, ["y" * 50, None], [1.0] * 20, None)], "a string, b array<string>, c array<double>, d binary")
    assert joins.is_small(wide, 10, 1_000) and not joins.is_small(wide, 10, 300)
    assert joins.is_small(wide.limit(0), 0)


APPLICATION = "application_id long, applied_at timestamp_ntz, role string, email string"


def applications(spark, n=600):
    """A third of all rows share one email, a third have none."""
    rows = []
    for i in range(n):
        email = "hot@x" if i % 3 == 0 else None if i % 3 == 1 else f"{i % 50}@x"
        rows.append((i, (n - i) % 97, ["a", "b"][i % 2], f" {email.upper()} " if email and i % 2 else email))
    df = spark.createDataFrame(rows, "application_id long, day int, role string, email string")
    at = F.expr("timestamp_ntz'2020-01-01 00:00:00' + make_interval(0, 0, 0, day)")
    return df.select("application_id", at.alias("applied_at"), "role", "email"), rows


def first_ids(rows):
    seen, kept = set(), set()
    for i, _, role, email in sorted(rows, key=lambda r: (r[1], r[0])):
        key = (role, email.strip().lower()) if email else i
        if key not in seen:
            seen.add(key)
            kept.add(i)
    return kept


def test_dedup_with_hot_keys(spark):
    df, rows = applications(spark)
    once = dedup.dedup_first(df)
    assert {r.application_id for r in once.collect()} == first_ids(rows)
    assert once.count() == dedup.dedup_first(once).count() == len(first_ids(rows))


@pytest.mark.parametrize("max_rows", [0, 1_000_000])
def test_new_applications(spark, max_rows):
    df, rows = applications(spark)
    old, new = df.where("application_id < 100"), df.where("application_id >= 100")
    stored = {(r[2], r[3].strip().lower()) for r in rows[:100] if r[3]}
    fresh = {r[0] for r in rows[100:] if not r[3] or (r[2], r[3].strip().lower()) not in stored}
    assert {r.application_id for r in dedup.new_applications(new, old, max_rows).collect()} == fresh
    rejected = {r.application_id for r in dedup.registered_applications(new, old, max_rows).collect()}
    assert rejected == {r[0] for r in rows[100:]} - fresh


def test_append_rows(spark):
    out = dedup.append_rows(spark.range(2).withColumn("a", F.lit(1)), spark.range(1).withColumn("b", F.lit(2)))
    assert out.columns == ["id", "a", "b"] and out.where("a is null").count() == 1 and out.count() == 3


def test_register_against_stored(spark):
    rows = [
        (1, "qa", "A", "a@x", "3+"), (2, "QA", "B", "A@x ", "1"), (3, "testing", None, "c@x", None),
        (4, "qa", "nan", "d@x", "2"), (5, "qa", "D", "d@x", "Fresher"), (6, "hr", "A", "a@x", "2 years 5 months"),
    ]
    df = spark.createDataFrame(rows, "application_id long, role_raw string, name string, email string, experience_raw string")
    df = df.withColumns({
        "applied_at": F.expr("timestamp_ntz'2020-01-01 00:00:00'"), "phone": F.lit(None).cast("string"),
        "location": F.lit(None).cast("string"), "skills": F.lit(None).cast("array<string>"),
    })
    got = {(r.application_id, r.role, r.experience) for r in intake.register(df).collect()}
    # The row named "nan" does not hold the slot of d@x.
    assert got == {(1, "testing", 3.0), (5, "testing", 0.0), (6, "hr", 2.42)}
    stored = intake.register(df.where("application_id = 1"))
    assert {r.application_id for r in intake.register(df, stored).collect()} == {5, 6}


def test_finalists_keep_k_of_each_kind(spark):
    rows = [(i, "hr", "n", "e", "Bonn", ["Sql", "java"] if i % 2 else ["java", "sql"], float(i % 10)) for i in range(200)]
    kept = ranking.finalists(spark.createDataFrame(rows, CANDIDATE), 3).collect()
    assert sorted(r.application_id for r in kept) == [9, 19, 29]


def test_embed_sends_each_text_once(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None), (4, "c")], "id long, text string")

    def load():
        return lambda texts: [[len(t), len(texts)] for t in texts]

    rows = {r.id: r.vector for r in embed(df.coalesce(1), "text", load).collect()}
    assert rows[1] == rows[2] and rows[1][0] == 3.0 and rows[3] is None and rows[4][0] == 1.0


def test_candidates_of_batches_are_derived_once(spark, monkeypatch):
    """Three writes read the same candidates."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    rows = [(i, "hr", "n", f"{i}@x", None, ["sql"], 1.0) for i in range(5)]
    derived = spark.createDataFrame(rows, CANDIDATE)
    derived = derived.withColumns({n: F.lit(None).cast(CANDIDATE_TABLE[n].dataType) for n in CANDIDATE_TABLE.fieldNames() if n not in derived.columns})
    derived = derived.mapInPandas(count, derived.schema)
    monkeypatch.setattr(query_checks, "candidates", lambda *_: derived)
    assert query_checks.s5_candidate_batches(spark, "").count() == 5
    assert seen.value == 5


def test_skills_of_an_application_are_not_shuffled_word_by_word(spark, tmp_path):
    when = dt.datetime(2024, 1, 1)
    tables = {
        "nation": ([(1, "N")], "n_nationkey int, n_name string"),
        "customer": ([(1, "C#1", 1)], "c_custkey long, c_name string, c_nationkey int"),
        "orders": ([(1, 1, when), (2, 1, when), (3, 1, when)], "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz"),
        "part": ([(1, "red gear"), (2, "gear  blue"), (3, None)], "p_partkey long, p_name string"),
        "lineitem": ([(1, 1), (1, 2), (1, 1), (1, 3), (2, 3), (None, 1)], "l_orderkey long, l_partkey long"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    rows = fx.applications(spark, str(tmp_path))
    assert {r.application_id: r.skills for r in rows.collect()} == {1: ["", "blue", "gear", "red"], 2: None, 3: None}
    assert "Generate" not in rows._jdf.queryExecution().optimizedPlan().toString()
