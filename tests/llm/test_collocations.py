"""Collocations against a brute-force count."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyspark.sql.functions as F
import pytest
import xxhash

from screenforge.llm import collocations as module
from screenforge.llm.collocations import PairFilter, collocations, pair_filter, ranked, score_of

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n int, score string, first int, _salt int")


def _brute(rows, least=10, share=50, most=2000):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in (1, 2, 3):
                f[lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    found = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        lost = {
            p[i : i + 2] for p, longer in candidates.items() if len(p) == 3 for i in (0, 1) if 100 * longer >= share * candidates[p[i : i + 2]]
        }
        rows_of = []
        for p, a in candidates.items():
            cuts = [(10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p))]
            if p not in lost:
                score, _, left, right = min(cuts)
                rows_of.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows_of)[:most], 1):
            found.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(found)


def _rows(seed, words, texts):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "New", "YORK", "city", "a.", "é", "É", "x!", "日本", "it's", "b,", "ö\x0b", "tab\t", " ", "q\n"][:words]
    rows = []
    for i in range(texts):
        text = "".join(rng.choices(vocabulary, k=rng.randint(0, 60), weights=range(words, 0, -1)) and rng.choice([" ", "  ", "\t"]).join(rng.choices(vocabulary, k=rng.randint(0, 60))))
        rows.append((i, text, rng.choice(["en", "de", None, "und"]), 1, "x", 2, 3))
    phrase = "in the long run we know"
    return rows + [(1000 + i, phrase + ("" if i % 3 else " well"), "en", 1, "x", 2, 3) for i in range(40)] + [(5, None, "en", 1, "x", 2, 3), (5, "", "fr", 1, "x", 2, 3)]


@pytest.mark.parametrize("seed, words", [(1, 5), (2, 16), (3, 9)])
def test_equal_to_brute_force(spark, monkeypatch, seed, words):
    monkeypatch.setattr(module, "PIECE_BYTES", 2000)
    rows = _rows(seed, words, 150)
    expected = _brute(rows)
    assert len(expected) > 10 and any(len(p.split(" ")) == 3 for _, _, p, *_ in expected)
    assert sorted(map(tuple, collocations(_docs(spark, rows).repartition(5)).collect())) == expected


def test_first_rows_of_each_language_and_ties(spark):
    rows = _rows(2, 16, 150)
    for most in (1, 7):
        assert sorted(map(tuple, collocations(_docs(spark, rows), most=most).collect())) == _brute(rows, most=most)


def test_counters_that_are_handed_on_early(spark, monkeypatch):
    monkeypatch.setattr(module, "PIECE_BYTES", 500)
    monkeypatch.setattr(module, "MOST_ENTRIES", 40)
    monkeypatch.setattr(module, "STRIPES_A_BATCH", 7)
    from screenforge.llm.collocations import Stripes

    import pyarrow as pa
    from screenforge.llm.common import chunks

    rows = _rows(4, 9, 100)
    hot, strips = {("en", "the"), ("de", "of"), ("en", "never")}, set()
    counters, found = Stripes(3, hot=frozenset(hot)), Counter()
    texts, langs = [r[1] or "" for r in rows], [r[2] or "und" for r in rows]
    batches = []
    for low, high, data, offsets in chunks(pa.array(texts), 500):
        counters.add(langs[low:high], data, offsets)
        batches += counters.taken()
    batches += counters.taken(last=True)
    for batch in batches:
        for row in batch.to_pylist():
            words = row["stripe"].split(" ")
            counts = row["counts"].split(" ") if row["counts"] else ["1"] * len(words)
            found[row["lang"], row["first"]] += sum(map(int, counts))
            assert len(words) == len(counts) and (row["strip"] == 0 or (row["lang"], row["first"]) in hot)
            strips.add(row["strip"])
    expected = Counter()
    for text, lang in zip(texts, langs):
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text.translate(LOWER)):
            expected.update((lang, w) for w in re.findall(r"[^\x20\x09]+", piece))
    assert found == expected and len(batches) > 10 and strips == {0, 1, 2}


def test_hot_prefixes(spark, monkeypatch):
    rows = [(i, "the cat, the dog of cats", "en", 1, "x", 2, 3) for i in range(300)] + [(i, f"one{i} two{i}", None, 1, "x", 2, 3) for i in range(200)]
    for sample in (2_000, 20):
        monkeypatch.setattr(module, "SAMPLE_TEXTS", sample)
        words, pairs = module.hot_prefixes(_docs(spark, rows))
        assert {("en", "the"), ("en", "of")} <= words and ("en", "the", "dog") in pairs and not any(lang == "und" for lang, *_ in words)


def test_filter_lets_all_frequent_pairs_through(spark):
    pairs = [("en", f"w{i}", f"é{i * 7}") for i in range(3000)]
    made = pair_filter(spark.createDataFrame(pairs, "lang string, first string, second string"))

    def hashes(values):
        return np.array([xxhash.xxh64_intdigest(v.encode(), 42) for v in values], np.uint64).view(np.int64)

    assert made.may_hold(*(hashes(column) for column in zip(*pairs))).all()
    others = [("en", f"w{i}", f"é{i * 7 + 1}") for i in range(3000)]
    assert made.may_hold(*(hashes(column) for column in zip(*others))).mean() < 0.1
    assert isinstance(made, PairFilter)


def test_score_is_exact(spark):
    values = [(3 * 10**14 + 7, 9 * 10**14 + 1, 5 * 10**14 + 3), (10**14, 10**14, 10**14), (1, 3, 7), (999_999_999_999_999, 999_999_999_999_999, 999_999_999_999_999)]
    df = spark.createDataFrame(values, "a long, l long, r long").select("*", score_of(F.col("a"), F.col("l"), F.col("r")).alias("score"))
    for row in df.collect():
        assert row.score == 10**6 * row.a * row.a // (row.l * row.r)


def test_rank_in_parts(spark):
    rng = random.Random(9)
    rows = [(rng.choice("xy"), f"p{i}", rng.randint(1, 5), rng.randint(1, 9)) for i in range(2000)]
    got = ranked(spark.createDataFrame(rows, "lang string, phrase string, a long, score long"), 50, 20).collect()
    for lang in "xy":
        want = sorted((r for r in rows if r[0] == lang), key=lambda r: (-r[3], -r[2], r[1].encode()))[:50]
        assert [(r.lang, r.phrase, r.a, r.score) for r in sorted(got, key=lambda r: r.rank) if r.lang == lang] == want


def test_no_rows(spark):
    assert collocations(_docs(spark, [])).count() == 0
    assert collocations(_docs(spark, [(1, "one two three", "en", 1, "x", 2, 3), (2, " \t..", None, 1, "x", 2, 3)])).count() == 0
