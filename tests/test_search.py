"""Dictionary search by anchors, pruned shortlists, one-scan search, learned vectors."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from screenforge.operators import extraction, pruning, ranking
from screenforge.operators.cooccurrence import cooccurrence, learned_skill_vectors, ppmi
from screenforge.operators.scoring import prepare_requests
from screenforge.plans import shortlist
from screenforge.session import materialize

PERSON = "application_id long, role string, name string, email string, phone string, location string, skills array<string>, experience double, vector array<double>"
REQUEST = "request_id long, role string, skills string, experience double, location string"

# --- dictionary -------------------------------------------------------------------------------------


def hits_of(texts, entries):
    found = []
    for doc, text in texts:
        words = text.lower().split()
        for entry in entries:
            parts = entry.lower().split()
            found += [(doc, " ".join(parts)) for i in range(len(words) - len(parts) + 1) if parts and words[i : i + len(parts)] == parts]
    return sorted(found)


@pytest.mark.parametrize("bound", [100_000, 0])
def test_hits_equal_brute_force(spark, bound):
    rng = random.Random(5)
    words = ["a", "b", "c", "data", "c++", "node.js", "ü"]
    texts = [(i, " ".join(rng.choices(words, k=rng.randint(0, 40)))) for i in range(60)]
    entries = {" ".join(rng.choices(words, k=rng.randint(1, 6))) for _ in range(80)} | {"a a", "a a a", "", "C++ Data"}
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    dictionary = spark.createDataFrame([(e,) for e in entries] * 2, "skill string")
    got = sorted((r.doc_id, r.skill) for r in extraction.skill_hits(docs, dictionary, bound).collect())
    assert got == hits_of(texts, {e.lower() for e in entries if e})


def test_rows_follow_hits_and_not_the_longest_entry(spark):
    long = " ".join(f"common{i}" for i in range(19)) + " rare"
    entries = spark.range(300_000).select(F.concat(F.lit("entry "), "id").alias("skill")).union(spark.createDataFrame([(long,), ("common3 common4",)], "skill string"))
    anchors = extraction.anchored(entries)
    assert anchors.count() == 300_002
    assert anchors.where("anchor = 'entry'").count() == 0  # the word that all have is nobody's anchor
    text = "entry 77 and entry x " + " ".join(f"common{i}" for i in range(19)) + " " + long
    docs = spark.createDataFrame([(1, text), (2, "nothing " * 2000), (3, None)], "doc_id long, text string")
    places = docs.select("doc_id", F.posexplode(extraction._words(F.col("text"))).alias("_at", "anchor"))
    assert places.join(anchors, "anchor").count() < 50
    rows = {r.doc_id: r.skills for r in extraction.extract_skills(docs, entries).collect()}
    assert rows == {1: sorted(["entry 77", long, "common3 common4"]), 2: [], 3: []}


# --- pruned shortlists ------------------------------------------------------------------------------


def world(spark, n=600, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 6))
    people = []
    for i in range(n):
        v = centres[i % 12] + 0.2 * rng.normal(size=6)
        vector = None if i % 17 == 0 else (v / np.linalg.norm(v)).tolist()
        people.append((i, ["hr", "hr", "hr", "testing", None][i % 5] if i < n - 5 else "rare", f"n{i}", "e", None, ["Bonn", "Oslo", None][i % 3], [f"s{i}"], float(rng.integers(0, 9)), vector))
    jobs = []
    for j in range(40):
        v = centres[j % 12] + 0.3 * rng.normal(size=6)
        jobs.append((j, ["hr", "testing", "rare", "none"][j % 4], "x" if j % 5 else "", float(rng.integers(0, 8)) * (j % 3 != 0), ["", "bonn"][j % 2], None if j % 11 == 0 else (v / np.linalg.norm(v)).tolist()))
    candidates = spark.createDataFrame(people, PERSON)
    ready = prepare_requests(spark.createDataFrame([j[:5] for j in jobs], REQUEST))
    return candidates, ready.join(spark.createDataFrame([(j[0], j[5]) for j in jobs], "request_id long, job_vector array<double>"), "request_id")


def rows_of(df):
    return sorted((r.request_id, r.place, r.application_id, round(r.score, 2), r.experience) for r in df.collect())


@pytest.mark.parametrize("k, per_cluster, per_block", [(5, 20, 50_000), (1, 40, 30), (700, 25, 100), (5, 10**9, 50)])
def test_pruned_equals_full_search(spark, k, per_cluster, per_block):
    candidates, ready = world(spark)
    full = rows_of(ranking.shortlists(candidates, ready, k, blocks=2))
    found = pruning.pruned_shortlists(candidates, ready, k, 15, per_cluster, per_block)
    assert rows_of(found.rows) == full and full


def test_most_clusters_are_skipped(spark):
    candidates, ready = world(spark, 4000)
    found = pruning.pruned_shortlists(candidates, ready.where("cardinality(job_skills) > 0"), 5, 15, 40)
    opened = found.opened.agg(F.sum("clusters").alias("all"), F.sum("opened").alias("opened"), F.max("opened").alias("most")).first()
    assert opened.opened < 0.5 * opened.all
    assert found.opened.where("opened > clusters").count() == 0


def test_requests_without_skills_open_no_cluster(spark):
    candidates, ready = world(spark)
    blind = ready.where("cardinality(job_skills) = 0 OR job_vector IS NULL")
    found = pruning.pruned_shortlists(candidates, blind, 5, 15, 40)
    assert rows_of(found.rows) == rows_of(ranking.shortlists(candidates, blind, 5, blocks=2))
    opened = found.opened.collect()
    assert len(opened) == blind.count() and all(r.opened == 0 for r in opened) and any(r.clusters > 1 for r in opened)


def test_bounds_hold_for_every_member():
    import pandas as pd

    rng = np.random.default_rng(4)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    members, jobs = unit(rng.normal(size=(50, 4))), unit(rng.normal(size=(30, 4)))
    centre = members[0]
    cluster = pd.DataFrame({"cluster": [7], "centre": [centre.tolist()], "cosine": [(members @ centre).min()], "most_experience": [3.0], "n": [50]})
    asked = pd.DataFrame({"job_vector": jobs.tolist(), "wants_skills": True, "min_experience": 0.0, "any_filter": True, "wanted_location": "", "w_skills": 60, "w_experience": 25, "w_location": 15})
    score, _ = pruning.upper_bounds(asked, cluster, 15)
    raw = jobs @ members.T * 100
    true = np.where(raw < 15, -np.inf, np.floor((raw * 60 / 100 + 25) * 100 + 0.5) / 100)
    assert (score[:, :1] >= true).all()


@pytest.mark.parametrize("most_skills", [20_000, 0])
def test_pruned_search_writes_neither_pairs_nor_vectors(spark, monkeypatch, most_skills):
    rng = np.random.default_rng(3)
    known = spark.createDataFrame([(f"s{i}", rng.normal(size=6).tolist()) for i in range(30)] + [("null", [0.0] * 6)], "skill string, embedding array<double>")
    pick = lambda n: [f"s{j}" for j in rng.choice(32, n)]  # two of them are unknown
    people = [(i, "hr", f"n{i}", "e", None, ["Bonn", "Oslo", None][i % 3], [None, ["null"], [" S1 ", "s1"]][i % 3] if i % 50 == 0 else pick(1 + i % 5), float(i % 9)) for i in range(1500)]
    candidates = spark.createDataFrame(people, PERSON.rsplit(",", 1)[0])
    jobs = [(j, "hr", ", ".join(pick(1 + j % 3)) if j % 7 else "", float(j % 3 * 3), ["", "bonn"][j % 2]) for j in range(60)]
    requests = spark.createDataFrame(jobs, REQUEST)
    written = []

    def recorded(df, label, **options):
        table = materialize(df, label, **options)
        written.append((label, table.columns, table.count()))
        return table

    monkeypatch.setattr(pruning, "materialize", recorded)
    monkeypatch.setattr(pruning, "MOST_SKILLS", most_skills, raising=False)
    found = shortlist.shortlist_pruned(candidates, requests, known, rows_per_cluster=20)
    assert rows_of(found.rows) == rows_of(shortlist.shortlist_many(candidates, requests, known))
    assert found.opened.where("opened > 0 AND opened < clusters").count() > 0
    assert max(n for _, _, n in written) <= len(people)
    wide = [label for label, columns, n in written if "vector" in columns and n > len(people) / 2]
    assert wide == ([] if most_skills else ["people"])


def test_small_role_copies_no_request(spark):
    candidates, ready = world(spark)
    grid = {r.role: (r.blocks, r.request_blocks) for r in ranking.role_grid(candidates, ready, 50, 1000).collect()}
    assert grid["rare"] == (1, 1) and grid["hr"][0] == 8 and "none" not in grid
    assert rows_of(ranking.shortlists(candidates, ready, 5, grid=ranking.role_grid(candidates, ready, 50, 7))) == rows_of(ranking.shortlists(candidates, ready, 5))


# --- one scan ---------------------------------------------------------------------------------------


def test_search_gives_three_outputs_from_one_scan(spark, tmp_path):
    candidates, ready = world(spark)
    candidates.write.parquet(str(tmp_path / "c"))
    stored = spark.read.schema(candidates.schema).parquet(str(tmp_path / "c"))
    few = ready.where("request_id < 6")
    found = shortlist.search(stored, few)
    ids = lambda df: [(r.request_id, r.application_id) for r in df.collect()]
    separate = shortlist.list_matches(stored, few)
    assert ids(found.ranked) == ids(separate)
    assert sorted(ids(found.top)) == sorted(ids(ranking.top_matches(separate)))
    role = {r.request_id: r.role for r in few.collect()}
    listing = ids(found.listing)
    for request, name in role.items():
        want = [r.application_id for r in ranking.by_experience(stored.where(F.col("role") == name)).collect()]
        assert [a for q, a in listing if q == request] == want
    assert found.counts == {"rows": len(listing), "matches": len(ids(found.ranked))}
    for df in found[:3]:
        assert str(tmp_path / "c") not in "".join(df.inputFiles())


# --- learned vectors --------------------------------------------------------------------------------


def test_counts_and_weights(spark):
    df = spark.createDataFrame([(["a", "b", "B ", "c"],), (["a", "b"],), (["c"],), ([],), (None,)], "skills array<string>")
    counts = {(r.skill, r.other): r.n for r in cooccurrence(df).collect()}
    assert counts == {("a", "b"): 2, ("b", "a"): 2, ("a", "c"): 1, ("c", "a"): 1, ("b", "c"): 1, ("c", "b"): 1}
    weights = {(r.skill, r.other): r.weight for r in ppmi(cooccurrence(df)).collect()}
    assert weights[("a", "b")] == pytest.approx(np.log(2 * 8 / 9)) and weights[("a", "c")] == pytest.approx(np.log(8 / 6))


def test_related_skills_are_nearer_than_others(spark):
    rng = random.Random(2)
    groups = [[f"g{g}s{i}" for i in range(8)] for g in range(5)]
    lists = [(rng.sample(groups[i % 5], 4) + rng.sample(sum(groups, []), 1),) for i in range(600)]
    learned = {r.skill: np.array(r.embedding) for r in learned_skill_vectors(spark.createDataFrame(lists, "skills array<string>"), dims=6).collect()}
    assert len(learned) == 40 and all(len(v) == 6 for v in learned.values())

    def cosine(a, b):
        return learned[a] @ learned[b] / np.linalg.norm(learned[a]) / np.linalg.norm(learned[b])

    right = 0
    for group in groups:
        for skill in group:
            best = sorted((s for s in learned if s != skill), key=lambda s: -cosine(skill, s))[:5]
            right += sum(s in group for s in best)
    assert right >= 0.95 * 5 * 40


def test_factorisation_equals_numpy(spark):
    rng = np.random.default_rng(6)
    m = np.abs(rng.normal(size=(30, 30)))
    m = (m + m.T) / 2
    weights = spark.createDataFrame([(f"{i:02}", f"{j:02}", float(m[i, j])) for i in range(30) for j in range(30)], "skill string, other string, weight double")
    from screenforge.operators.cooccurrence import factorise

    found = {r.skill: r.embedding for r in factorise(weights, 3, rounds=30).collect()}
    got = np.array([found[f"{i:02}"] for i in range(30)], float)
    value, basis = np.linalg.eigh(m)
    top = np.argsort(-value)[:3]
    want = (basis[:, top] * value[top]) @ basis[:, top].T
    assert np.abs(got @ got.T - want).max() < 0.05 * np.abs(want).max()


def test_no_lists_no_vectors(spark):
    assert learned_skill_vectors(spark.createDataFrame([(["a"],), (None,)], "skills array<string>"), dims=4).count() == 0
