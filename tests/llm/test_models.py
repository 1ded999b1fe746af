import zlib

import numpy as np
import pyarrow as pa
import pytest

from screenforge.llm import language_id, quality, toxicity
from screenforge.llm.common import chunks

ODD = [(900, None), (901, ""), (902, " \n"), (903, "123 !!! ..."), (None, "the and"), (905, "long " * 40_000), (900, None), (906, "x")]


def _held_out(doc_id):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 5 == 0


def _tables(spark, sf_dir):
    medium = sf_dir.replace("sf0.001", "sf0.01")
    return [spark.read.parquet(f"{medium}/{name}.parquet") for name in ("documents", "labels")]


def _with_odd(spark, docs):
    odd = spark.createDataFrame([(i, t, None, "s", 0) for i, t in ODD], docs.schema)
    return docs.filter("doc_id < 900 OR doc_id > 906").union(odd).selectExpr("*", "1 AS score", "'x' AS held_out", "0 AS y", "'v' AS vector")


def _accuracy(rows, truth):
    held = [(r, truth[r[0]]) for r in rows if r[0] in truth and _held_out(r[0])]
    return sum(got == want for (_, got), want in held) / len(held), len(held)


def test_toxicity(spark, sf_dir):
    docs, labels = _tables(spark, sf_dir)
    frame = _with_odd(spark, docs)
    rows = toxicity.toxicity(frame, labels).collect()
    assert len(rows) == frame.count()
    assert all(r.held_out == _held_out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    accuracy, n = _accuracy([(r.doc_id, r.predicted) for r in rows], {r.doc_id: r.toxic for r in labels.collect()})
    assert n > 50 and accuracy > 0.9
    same = {r.score for r in rows if r.doc_id in (900, 901, 902)}
    assert len(same) == 1 and same.pop() < 0.5
    left = toxicity.drop_toxic(frame, labels)
    assert left.columns == frame.columns and left.count() == sum(r.predicted == 0 for r in rows)


def test_toxicity_without_labels_rejects_nothing(spark, sf_dir):
    docs, labels = _tables(spark, sf_dir)
    assert toxicity.toxicity(docs, labels.limit(0)).filter("predicted = 1").count() == 0
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_unseen_misspellings_share_subwords():
    rng = np.random.default_rng(1)
    words = ["alpha", "bravo", "delta", "gamma", "house", "river", "stone", "light"]
    texts = [" ".join(rng.choice(words, 60)) for _ in range(80)]
    toxic = np.arange(80) % 2
    texts = [t + " idiotic fools" * 2 + " " + t if y else t for t, y in zip(texts, toxic)]
    model = toxicity.train(texts, toxic.astype(float))

    def score(text):
        return np.concatenate([model.scores(d, o) for _, _, d, o in chunks(pa.array([text]))])[0]

    assert score("stone light idiotik foolz house river alpha bravo") > 20 * score("stone light windmill tables house river alpha bravo")


def test_bags_cover_every_word():
    number = np.array([0, 1, 12, 13, 100, 7])
    first, size, each = toxicity.bags(number)
    covered = np.zeros(number.sum(), bool)
    for a, n in zip(first, size):
        covered[a : a + n] = True
    assert covered.all() and size.min() > 0 and each.tolist() == [0, 1, 1, 2, 16, 1]


def test_quality(spark, sf_dir):
    docs, labels = _tables(spark, sf_dir)
    frame = _with_odd(spark, docs)
    rows = quality.quality(frame, labels).collect()
    assert len(rows) == frame.count()
    assert all(r.held_out == _held_out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    accuracy, n = _accuracy([(r.doc_id, r.predicted) for r in rows], {r.doc_id: r.quality for r in labels.collect()})
    assert n > 50 and accuracy > 0.9
    assert len({r.score for r in rows if r.doc_id in (900, 901, 902)}) == 1
    assert {r.score for r in quality.quality(docs, labels.limit(0)).collect()} == {0.0}
    assert quality.quality(docs.limit(0), labels).count() == 0


def test_risk_of_positives_and_unlabelled():
    rng = np.random.default_rng(3)
    positive, negative = rng.normal(1.5, 1, (3_000, 3)), rng.normal(-1.5, 1, (3_000, 3))
    mixed = np.vstack([positive[1_000:2_400], negative[:600]])
    model = quality.train(positive[:1_000], mixed, prior=0.7)
    assert (model.scores(positive[2_400:]) > 0.5).mean() > 0.95 and (model.scores(negative[600:]) < 0.5).mean() > 0.9


@pytest.mark.parametrize("prior", [0.2, 0.5, 0.85])
def test_prior_is_estimated_from_positives_and_unlabelled(prior):
    rng = np.random.default_rng(8)
    positive, n = rng.normal(2, 1, (4_000, 2)), int(6_000 * prior)
    unlabelled = np.vstack([rng.normal(2, 1, (n, 2)), rng.normal(-2, 1, (6_000 - n, 2))])
    model = quality.train(positive, unlabelled, 0.5)
    assert abs(quality.estimated_prior(model.scores(positive), model.scores(unlabelled)) - prior) < 0.06


def test_sample_is_the_lowest_hashes_whatever_the_partitions(spark):
    rows = spark.range(3_000).selectExpr("id AS doc_id", "false AS held_out", "array_repeat(cast(id AS float), 16) AS features")
    rows = rows.select("doc_id", "held_out", "features").unionByName(rows.limit(1).crossJoin(spark.range(5_000)).select("doc_id", "held_out", "features"))
    few = [sorted(quality._sampled(rows.repartition(n), 200)[:, 0].tolist()) for n in (1, 7)]
    assert few[0] == few[1] and len(set(few[0])) == 200
    assert len(quality._sampled(rows, 5_000)) == 3_000


def test_languages(spark, sf_dir):
    docs, _ = _tables(spark, sf_dir)
    frame = _with_odd(spark, docs)
    rows = language_id.identify(frame).collect()
    assert len(rows) == frame.count()
    accuracy, n = _accuracy([(r.doc_id, r.lang_pred) for r in rows], {r.doc_id: r.lang for r in docs.filter("doc_id < 900").collect()})
    assert n > 100 and accuracy > 0.95
    odd = {r.doc_id: r for r in rows}
    assert all(odd[i].lang_pred == "und" and odd[i].score == 0 for i in (900, 901, 902, 903))
    assert odd[None].lang_pred == "en" and all(0 <= r.score <= 1 for r in rows)
    assert {r.lang_pred for r in language_id.identify(docs.withColumn("lang", docs.lang.substr(9, 1).try_cast("int").cast("string"))).collect()} == {"und"}
    assert language_id.identify(docs.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["Abc, dé! x", "a", "  ß--Σ  日本 ", "12"])
def test_trigrams_and_vectors(text):
    letters = "".join(c.lower() if c.isalpha() else " " for c in text)
    words = letters.split()
    want = {}
    line = " " + " ".join(words) + " "
    for i in range(len(line) - 2):
        if words and line[i + 1] != " ":
            want[line[i : i + 3]] = want.get(line[i : i + 3], 0) + 1
    owner, grams, count = language_id.trigrams(["", text, "q"])
    mine = owner == 1
    numbers = language_id._letter_numbers()
    keys = {(int(numbers[ord(a)]) << 20) | (int(numbers[ord(b)]) << 10) | int(numbers[ord(c)]): n for (a, b, c), n in want.items()}
    assert dict(zip(grams[mine].tolist(), count[mine].tolist())) == keys
    vectors = language_id._letter_vectors().astype(int)
    bundle = sum((n * np.roll(vectors[k >> 20], 2) * np.roll(vectors[k >> 10 & 1023], 1) * vectors[k & 1023] for k, n in keys.items()), np.zeros(language_id.DIMENSIONS))
    assert (language_id.document_vectors([text])[0] == bundle).all()
