import hashlib
import random
import re
import struct

import public_tokenizers
import sentencepiece

import corpus_pipeline
from screenforge.llm import queries

import __spark_entry__ as entry


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and set(queries.QUERIES) <= set(names)
    assert sorted({int(n[2:].split("_")[0]) for n in queries.QUERIES}) == list(range(1, 14))
    assert set(queries.ORACLES) <= set(queries.QUERIES)


def test_stages_keep_the_columns_and_what_they_should(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    clean = "Clean words of a text that nobody else has written, number "
    planted = [
        (100_001, clean + "one and so on", "en", "s", 1),
        (100_002, clean + "one and so on", "en", "s", 1),
        (100_003, "quite another tale " + " ".join(f"tale{i}" for i in range(60)), "en", "s", 1),
        (100_004, "quite another tale " + " ".join(f"tale{i}" for i in range(58)) + " differs here", "en", "s", 1),
        (100_005, spark.read.parquet(f"{sf_dir}/benchmark.parquet").first().text + " and more", "en", "s", 1),
        (100_006, None, None, None, None),
    ]
    docs = docs.union(spark.createDataFrame(planted, docs.schema))
    ids = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        docs = corpus_pipeline.materialize(out, name)
        ids.append({r.doc_id for r in docs.select("doc_id").collect()})
    toxic, exact, near, contaminated = ids
    assert 100_001 in toxic and 100_001 not in exact and 100_002 in exact
    assert {100_003, 100_004} <= exact and 100_003 in near and 100_004 not in near
    assert 100_005 in near and 100_005 not in contaminated
    assert {100_002, 100_003, 100_006} <= contaminated
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r.doc_id for r in last.collect()} == contaminated


def test_run(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert 0 < len(rows) < 200 and all(r.n_tokens >= 2 for r in rows)


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _near(a, b):
    return bool(a) and bool(b) and 100 * len(a & b) >= 75 * len(a | b)


def _plain_stages(rows, items, toxic):
    """The stages after toxicity in plain Python, on (doc_id, text) and given what is toxic: ids left after each."""
    rows = {i: t or "" for i, t in rows if i not in toxic}
    left = [set(rows)]
    keep = {}
    for i, text in rows.items():
        keep[text] = max(i, keep.get(text, i))
    rows = {i: rows[i] for i in keep.values()}
    left.append(set(rows))
    sets = {}
    for i, text in rows.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER))
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    root = {i: i for i in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in rows:
        for b in rows:
            if a < b and _near(sets[a], sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    rows = {i: t for i, t in rows.items() if find(i) == i}
    left.append(set(rows))

    def words_of(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))

    windows = set()
    for text in items:
        words = words_of(text)
        size = min(10, len(words))
        windows |= {tuple(words[k : k + size]) for k in range(len(words) - size + 1)} if words else set()
    sizes = {len(w) for w in windows}

    def hit(text):
        words = words_of(text)
        return any(tuple(words[k : k + n]) in windows for n in sizes for k in range(len(words) - n + 1))

    rows = {i: t for i, t in rows.items() if not hit(t)}
    return [*left, set(rows)], rows


def test_all_stages_against_plain_python(spark, sf_dir, tmp_path):
    """The whole table with copies, near copies and passages added; toxicity is taken as the stage decides."""
    rng = random.Random(21)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    own = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    more = []
    for n in range(60):
        _, text = rng.choice(own)
        words = (text or "").split(" ")[:400]
        if n % 3 == 1:
            for _ in range(max(1, len(words) // 60)):
                words[rng.randrange(len(words))] = f"changed{n}"
        if n % 3 == 2:
            at = rng.randrange(len(words))
            words[at:at] = rng.choice(items).split(" ")[:20]
        more.append((500_000 + n, " ".join(words) if n % 3 else text, "en", "s", 1))
    more += [(600_000, None, None, None, None), (600_001, "", "en", "s", 1), (600_002, " \n", "en", "s", 1)]
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    docs.union(spark.createDataFrame(more, docs.schema)).write.parquet(f"{tmp_path}/documents.parquet")
    folder = str(tmp_path)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    every = [(r.doc_id, r.text) for r in docs.collect()]
    kept = {r.doc_id for r in corpus_pipeline.STAGES[0][1](spark, docs, folder).collect()}
    left, rows = _plain_stages(every, items, {i for i, _ in every} - kept)
    assert len(left[0]) > len(left[1]) > len(left[2]) > len(left[3]) > 50
    for (name, stage), want in zip(corpus_pipeline.STAGES[:-1], left):
        docs = corpus_pipeline.materialize(stage(spark, docs, folder), name)
        assert {r.doc_id for r in docs.select("doc_id").collect()} == want, name
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    found = corpus_pipeline.run(spark, folder).collect()
    assert len(found) == len(rows)
    for r in found:
        ids = library.encode(rows[r.doc_id], add_bos=True, add_eos=True)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest() and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_empty_table(spark, sf_dir, tmp_path):
    for name in ("labels", "benchmark", "documents"):
        rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        (rows.limit(0) if name == "documents" else rows).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
