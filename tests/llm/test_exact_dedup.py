from collections import defaultdict
from hashlib import sha256

from screenforge.llm.exact_dedup import drop_exact_duplicates, exact_groups


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, _salt int, n int")


ROWS = [
    (5, "same", "x", 1, 1),
    (9, "same", "x", 1, 1),
    (9, "same", "y", 2, 2),
    (7, "Same", "x", 1, 1),
    (1, None, "x", 1, 1),
    (2, "", "x", 1, 1),
    (3, " ", None, None, None),
    (None, "same", "x", 1, 1),
    (None, "alone", "x", 1, 1),
    (None, "two", "x", 1, 1),
    (None, "two", "x", 1, 1),
    (20, "ä" * 300_000, "x", 1, 1),
    (21, "ä" * 300_000, "x", 1, 1),
] + [(100 + i, "hot", "x", 1, 1) for i in range(200)]


def test_groups(spark):
    groups = defaultdict(list)
    for doc_id, text, *_ in ROWS:
        groups[text or ""].append(doc_id)
    rows = exact_groups(_docs(spark, ROWS), partitions=20).collect()
    assert len(rows) == len(ROWS)
    kept = defaultdict(int)
    for row in rows:
        text = next(t for t in groups if sha256(t.encode()).hexdigest() == row.text_sha256 and row.doc_id in groups[t])
        ids = [i for i in groups[text] if i is not None]
        assert row.keep_id == (max(ids) if ids else None)
        assert row.group_size == len(groups[text])
        assert not row.kept or row.doc_id == row.keep_id
        kept[text] += row.kept
    assert set(kept.values()) == {1}


def test_drop_keeps_one_row_of_each_text_with_all_columns(spark):
    docs = _docs(spark, ROWS)
    left = drop_exact_duplicates(docs)
    assert left.columns == docs.columns
    texts = sorted((r.text or "") for r in left.collect())
    assert texts == sorted({t or "" for _, t, *_ in ROWS})


def test_empty_table(spark):
    docs = _docs(spark, [])
    assert exact_groups(docs).count() == 0
    assert drop_exact_duplicates(docs).count() == 0


def test_main_path_runs_no_python(spark):
    plan = exact_groups(_docs(spark, ROWS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "SortAggregate" in plan
