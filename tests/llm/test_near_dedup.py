import random
import re

import numpy as np
import pyarrow as pa
import pytest

from screenforge.llm import near_dedup
from screenforge.llm.common import chunks
from screenforge.llm.components import components
from screenforge.llm.near_dedup import drop_near_duplicates, fine_signatures, least_matches, may_be_similar, near_groups, shingles

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _set(text):
    words = WORD.findall((text or "").translate(LOW))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def _expected(docs):
    """Components by comparing all pairs; the same id twice stands for one document per text."""
    sets = [_set(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(docs)):
        groups.setdefault(find(i), []).append(docs[i][0])
    least = {r: min((i for i in ids if i is not None), default=None) for r, ids in groups.items()}
    return sorted((str(docs[i][0]), len(sets[i]), str(least[find(i)]), least[find(i)] == docs[i][0]) for i in range(len(docs)))


def _docs():
    rng = random.Random(4)
    vocabulary = [f"word{i}" for i in range(400)]
    docs = []
    passage = " ".join(rng.choice(vocabulary) for _ in range(55))
    for i in range(8):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([6, 30, 120, 200]))]
        for _ in range(25):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 12))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            docs.append(" ".join(words).title() if rng.random() < 0.2 else "  ".join(words))
    docs += [passage + " " + " ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 60))) for _ in range(60)]
    docs += ["", None, " \n", "a b", "A  B", "a b c", "a b c d e", "same same same same same same same", "\x00 \x0b x"] + ["copy of one text that is there often"] * 30
    docs += [" ".join(rng.choice(vocabulary) for _ in range(20_000))] * 2
    ids = list(range(len(docs)))
    rng.shuffle(ids)
    return list(zip(ids, docs))


@pytest.mark.parametrize("block", [1024, 7])
def test_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    docs = _docs()
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, band int, node string")
    rows = near_groups(frame).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in rows) == _expected(docs)


def test_drop_and_rows_that_repeat(spark):
    text = "one two three four five six seven"
    docs = [(3, text), (3, text), (5, text), (None, text), (None, "other words in this text here now"), (1, "other words in this text here"), (3, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    rows = near_groups(frame).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in rows) == _expected(docs)
    assert sorted(map(str, drop_near_duplicates(frame).collect())) == sorted(str(r) for r in frame.collect() if r.doc_id in (1, 3) or r.text.startswith("other words in this text here now"))
    assert near_groups(frame.limit(0)).count() == 0
    assert drop_near_duplicates(frame.limit(0)).count() == 0


def test_shingle_counts():
    texts = [t or "" for _, t in _docs()]
    got = np.concatenate([shingles(data, offsets)[1] for _, _, data, offsets in chunks(pa.array(texts), 5_000)])
    assert got.tolist() == [len(_set(t)) for t in texts]


def test_pairs_at_the_threshold_are_not_given_up():
    rng = np.random.default_rng(0)
    common = rng.integers(0, 1 << 63, (40, 300), dtype=np.int64).astype(np.uint64)
    own = rng.integers(0, 1 << 63, (40, 100), dtype=np.int64).astype(np.uint64)
    left = fine_signatures(np.hstack([common, own[:, :50]]).ravel(), np.full(40, 350))
    right = fine_signatures(np.hstack([common, own[:, 50:]]).ravel(), np.full(40, 350))
    assert may_be_similar(left, right).all()  # 300 of 400
    far = fine_signatures(np.hstack([common[:, :200], own]).ravel(), np.full(40, 300))
    assert not may_be_similar(left, far).any()  # 200 of 450
    assert least_matches() == sorted(least_matches())


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 300), (200, 300), (5, 5), (None, 7), (500, 400)] + [(1000, 1000 + i) for i in range(1, 60)]
    rows = components(spark.createDataFrame(links, "a long, b long")).collect()
    roots = {r.node: r.root for r in rows}
    assert len(roots) == len(rows)
    assert {roots[i] for i in range(41)} == {0} and roots[300] == roots[200] == 100 and roots[500] == 400 and roots[1059] == 1000
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
