import random
import re

from screenforge.llm.common import text_key
from screenforge.llm.decontamination import build_index, contamination, drop_contaminated, phrases, proximity_matches

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _words(text):
    return WORD.findall((text or "").translate(LOW))


def _expected(docs, items):
    windows = {}
    for item_id, text in items:
        words = _words(text)
        size = min(10, len(words))
        for i in range(len(words) - size + 1 if words else 0):
            windows.setdefault(tuple(words[i : i + size]), set()).add(item_id)
    out = {}
    for doc_id, text in docs:
        words, hit, found = _words(text), set(), set()
        for i in range(len(words)):
            for size in range(1, 11):
                ids = windows.get(tuple(words[i : i + size])) if i + size <= len(words) else None
                if ids:
                    hit.update(range(i, i + size))
                    found |= ids
        out[doc_id] = (len(words), len(hit), len(found - {None}), bool(hit))
    return out


def _fixture():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(30)] + ["Émile", "über", "don't"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 9, 10, 11, 25])))) for i in range(30)]
    items += [(40, "a b a b a b a b a b a b"), (41, ""), (42, None), (3, "other text of the same item that is longer than ten words"), (None, "nobody owns this passage of more than ten words in all tests")]
    docs = []
    for i in range(120):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 80))]
        for _ in range(rng.randint(0, 3)):
            part = (rng.choice(items)[1] or "").split()
            cut = rng.randint(0, len(part))
            at = rng.randint(0, len(words))
            words[at:at] = part[cut // 3 :] if rng.random() < 0.5 else part
        docs.append((i, ", ".join(words).upper() if i % 7 == 0 else " ".join(words)))
    docs += [(200, None), (201, ""), (202, "..."), (203, "a b " * 30), (204, " ".join(["w1"] * 5_000)), (205, items[-1][1])]
    return docs, items


def test_against_brute_force(spark):
    docs, items = _fixture()
    frame = spark.createDataFrame([(i, t, 1, 2, "z") for i, t in docs], "doc_id long, text string, term int, pos int, item_id string")
    rows = contamination(frame, spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, term int")).collect()
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated) for r in rows}
    assert got == _expected(docs, items)
    left = drop_contaminated(frame, spark.createDataFrame(items, "item_id long, text string"))
    assert left.columns == frame.columns
    assert {r.doc_id for r in left.collect()} == {i for i, (*_, hit) in got.items() if not hit}


def test_repeated_null_and_missing_rows(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, item), (1, item), (None, item), (1, "clean")], "doc_id long, text string")
    rows = contamination(docs, spark.createDataFrame([(1, item), (1, item)], "item_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_hit, r.n_items) for r in rows) == [("1", 0, 0), ("1", 11, 1), ("1", 11, 1), ("None", 11, 1)]
    none = contamination(docs, spark.createDataFrame([], "item_id long, text string")).collect()
    assert len(none) == 4 and not any(r.contaminated for r in none)
    assert contamination(docs.limit(0), spark.createDataFrame([(1, item)], "item_id long, text string")).count() == 0


def test_proximity_against_brute_force(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choice("abcdefgh") for _ in range(60))) for i in range(20)]
    items = [(1, "a b c d"), (2, "h g g"), (3, "e missing")]
    span = 6
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    grams = phrases(spark.createDataFrame(items, "item_id long, text string"))
    index = build_index(frame, grams.select("word", "term").distinct())
    got = {(r.doc_id, int(r.item_id), r.begin) for r in proximity_matches(index, grams, span).collect()}
    want = set()
    for doc_id, text in docs:
        words = text.split()
        for item_id, phrase in items:
            asked = set(phrase.split())
            want |= {(doc_id, item_id, i) for i in range(len(words)) if words[i] in asked and asked <= set(words[i : i + span])}
    assert got == want


def test_main_path_runs_no_python(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    plan = contamination(docs, spark.createDataFrame([(1, "a b")], "item_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert docs.select(text_key()).count() == 1
