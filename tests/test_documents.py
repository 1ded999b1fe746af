"""File formats, extraction, model chain, tables and streams."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from checks import fixtures as fx
from screenforge.functions import experience
from screenforge.operators import documents, extraction, outbox
from screenforge.plans.shortlist import role_overview
from screenforge.session import scratch_path
from screenforge.sources import candidates as store
from screenforge.sources import resumes
from screenforge.sources.resumes import plain_text, read_resume_files
from screenforge.streaming import intake

TEXT = "Ann & Bob <x>\n\n  two  spaces\tand tab \nÜnïcode 你好\nend"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    base = tmp_path_factory.mktemp("uploads")
    (base / "sub").mkdir()
    files = {
        "a.docx": fx.docx_bytes(TEXT), "b.odt": fx.odt_bytes(TEXT), "sub/c.txt": TEXT.replace("\n", "\r\n").encode(),
        "d.TXT": b"upper", "e.xyz": b"other", "broken.docx": b"no zip", "bad.txt": b"ok \xff\xfe", "empty.txt": b"",
        "scan.pdf": b"%scan", "page.pdf": b"page", "photo.jpeg": b"photo",
    }
    for name, content in files.items():
        (base / name).write_bytes(content)
    return str(base)


def texts(df):
    return {os.path.basename(r.path): r.text for r in df.select("path", "text").collect()}


def test_extract_text(spark, folder):
    got = texts(documents.extract_text(read_resume_files(spark, folder)))
    assert got == {
        "a.docx": TEXT, "b.odt": TEXT, "c.txt": TEXT, "d.TXT": "", "e.xyz": "", "broken.docx": "",
        "bad.txt": "ok ��", "scan.pdf": "", "page.pdf": "", "photo.jpeg": "",
    }


def test_extract_text_with_own_decoders(spark, folder):
    def read_pdf(data):
        return " \n" if data == b"%scan" else data.decode()

    files = read_resume_files(spark, folder, "*.{pdf,jpeg}")
    got = texts(documents.extract_text(files, {"pdf": read_pdf, "image": bytes.decode}, {"pdf": lambda d: "recognised"}))
    assert got == {"scan.pdf": " \nrecognised", "page.pdf": "page", "photo.jpeg": "photo"}


def test_plain_text_line_ends(spark):
    df = spark.createDataFrame([(bytearray(b"a\rb\r\nc\n"),)], "content binary")
    assert df.select(plain_text(F.col("content"))).first()[0] == "a\nb\nc\n"


def test_assemble_pages(spark):
    rows = [(1, 10, "c"), (1, 2, "b"), (1, 1, "a"), (1, 3, None), (2, 1, None)]
    out = documents.assemble_pages(spark.createDataFrame(rows, "doc_id long, page_no int, text string"))
    assert {r.doc_id: r.text for r in out.collect()} == {1: "abc", 2: ""}


def _answer(*rules):
    """A model of literal rules: (prompt part, reply, error)."""

    def ask(prompt):
        out = F.struct(F.lit(None).cast("string").alias("reply"), F.lit("boom").alias("error"))
        for part, reply, error in rules:
            hit = F.struct(F.lit(reply).cast("string").alias("reply"), F.lit(error).cast("string").alias("error"))
            out = F.when(F.contains(prompt, F.lit(part)), hit).otherwise(out)
        return out

    return ask


def test_fallback_chain(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z"), (4, "none")], "id long, prompt string")
    first = _answer(("x", "one", None), ("y", None, "Quota reached"), ("z", None, "HTTP 429"))
    second = _answer(("y", "two", None), ("z", None, "429"))
    rows = {r.id: (r.model, r.reply, r.error) for r in extraction.fallback_chain(df, [("m1", first), ("m2", second)]).collect()}
    assert rows == {
        1: ("m1", "one", None), 2: ("m2", "two", None), 3: (None, None, extraction.EXHAUSTED), 4: ("m1", None, "boom"),
    }


def test_applications_by_model_and_by_rule(spark):
    import datetime as dt

    from screenforge.plans.intake import read_applications, register

    texts = ["Ann\nann@x.org\nLocation: Bonn\nSkills\nsql, java\n\nWork Experience\n2019 to Present\n", "broken", "limit", ""]
    files = spark.createDataFrame(
        [(i, "QA", f"/u/{i}.txt", bytearray(t.encode())) for i, t in enumerate(texts)],
        "application_id long, role_raw string, path string, content binary",
    ).withColumn("applied_at", F.expr("timestamp_ntz'2020-01-01 00:00:00'"))
    good = 'Sure: {"name": "Ann", "email": "ann@x.org", "skills": ["sql"], "experience": "3+ years"}.'
    first = _answer(("Ann", good, None), ("broken", "no json", None), ("limit", None, "quota"))
    second = _answer(("limit", '{"name": "Lim", "email": null, "skills": "sql", "experience": 2.345}', None))
    day = dt.date(2026, 4, 1)
    by_model = register(read_applications(files, day, [("m1", first), ("m2", second)])).orderBy("application_id").collect()
    assert [(r.application_id, r.role, r.name, r.email, r.skills, r.experience) for r in by_model] == [
        (0, "testing", "Ann", "ann@x.org", ["sql"], 3.0), (2, "testing", "Lim", None, [], 2.345),
    ]
    by_rule = register(read_applications(files, day)).where("application_id = 0").first()
    assert (by_rule.name, by_rule.location, by_rule.skills, by_rule.experience) == ("Ann", "Bonn", ["sql", "java"], 7.0)


def test_prompt_rules():
    import datetime as dt

    rules = extraction.prompt_rules(dt.date(2026, 4, 1))
    for part in ("April 2026", "begun in September 2022 and still held has 3.58", "4.25", "7+"):
        assert part in rules


def test_extract_skills_beyond_the_bound(spark):
    docs = spark.createDataFrame(
        [(1, "Node.js, C++ and the SQL. the end"), (2, "nothing"), (3, None), (4, "Machine\n learning; Übersetzung, machine")],
        "doc_id long, text string",
    )
    words = spark.createDataFrame([("node.js",), ("c++",), ("SQL",), ("sql",), ("machine  learning",), ("übersetzung",), (None,)], "skill string")
    for bound in (0, 100):
        rows = {r.doc_id: r.skills for r in extraction.extract_skills(docs, words, bound).collect()}
        assert rows == {1: ["c++", "node.js", "sql"], 2: [], 3: [], 4: ["machine learning", "übersetzung"]}


# --- candidate table ----------------------------------------------------------------------------


def some_candidates(spark):
    rows = [
        (1, "testing", 'A "b", c', " a@x ", None, "Bonn\nMitte", ["it's", 'q"', "x,y"], 2.5),
        (2, "hr", "", None, "", None, [], 0.0),
        (3, "testing", "C", "c@x", "1", "B", ["a"], 7.0),
    ]
    df = spark.createDataFrame(
        rows, "application_id long, role string, name string, email string, phone string, location string, skills array<string>, experience double"
    )
    return df.withColumn("applied_at", F.expr("timestamp_ntz'2020-01-02 03:04:05'")).select(*store.CANDIDATE.fieldNames())


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_candidate_table_round_trip(spark, tmp_path, fmt):
    rows, path = some_candidates(spark), str(tmp_path / "t")
    store.write_candidates(rows, path, fmt)
    key = lambda r: r.application_id
    assert sorted(store.read_candidates(spark, path, fmt=fmt).collect(), key=key) == sorted(rows.collect(), key=key)
    qa = store.read_candidates(spark, path, "QA", fmt)
    assert {r.application_id for r in qa.collect()} == {1, 3}
    assert "PartitionFilters: [isnotnull(role" in qa._jdf.queryExecution().toString()


def test_missing_table_is_empty(spark, tmp_path):
    assert store.read_candidates(spark, str(tmp_path / "none"), "qa").count() == 0
    listing, top = role_overview(spark, str(tmp_path / "none"))
    assert listing.count() == 0 and top.count() == 0


def test_records(spark):
    record = store.to_records(some_candidates(spark).where("application_id = 2").select("role", "email", "skills")).first()[0]
    assert record == '{"role":"hr","email":null,"skills":[]}'


# --- outbox -------------------------------------------------------------------------------------


def test_outbox_and_report(spark):
    requests = spark.createDataFrame(
        [
            (1, ["a@x", "bad", None, "d@x"], ["A", "B", "C"], "data_engineer", "2025-05-05", "10:30", ""),
            (2, ["a@x"], ["A"], "hr", "tomorrow", "10:30", "Hall"),
            (3, [], [], "hr", "2025-05-05", "10:30", "Hall"),
        ],
        "request_id long, emails array<string>, names array<string>, role string, date string, time string, venue string",
    )
    sender = outbox.Sender("Acme", "Main St 1")
    rows = outbox.build_outbox(requests, sender).orderBy("position").collect()
    assert [(r.email, r.status) for r in rows] == [("a@x", "ready"), ("bad", "failed"), (None, "failed")]
    assert rows[0].subject == "Interview invitation: Data_Engineer at Acme"
    assert "application as data_engineer and" in rows[0].plain and "Venue: Main St 1" in rows[0].plain
    assert "Monday, 05 May 2025" in rows[0].plain and "<b>Data_Engineer</b>" in rows[0].html
    sent = outbox.build_outbox(requests, sender).withColumns(
        {"error": F.when(F.col("status") == "ready", F.lit("full")), "status": F.lit("failed")}
    )
    report = {r.request_id: (r.success, r.error, r.sent, r.failed, r.errors) for r in outbox.request_report(requests, sent).collect()}
    assert report == {
        1: (True, None, 0, 3, ["a@x: full"]), 2: (False, outbox.INVALID_SCHEDULE, None, None, None), 3: (True, None, 0, 0, []),
    }


# --- stream -------------------------------------------------------------------------------------


def _batches(spark, sf_dir):
    apps = fx.applications(spark, sf_dir)
    cuts = ["1995-01-01", "1996-06-01", "1999-01-01", "2005-01-01"]
    return [apps.where((F.col("applied_at") >= a) & (F.col("applied_at") < b)) for a, b in zip(cuts, cuts[1:], strict=False)]


def test_replayed_batch_changes_nothing(spark, sf_dir):
    from screenforge.plans.intake import register

    table = scratch_path(spark, "replay")
    batches = _batches(spark, sf_dir)
    for number, batch in enumerate(batches):
        intake.store_batch(batch, number, table)
    before = sorted(r.application_id for r in intake.read_intake(spark, table).collect())
    intake.store_batch(batches[1], 1, table)
    intake.store_batch(batches[2], 2, table)
    after = sorted(r.application_id for r in intake.read_intake(spark, table).collect())
    expected = sorted(r.application_id for r in register(fx.applications(spark, sf_dir)).collect())
    assert before == after == expected


def test_text_files_are_written_one_per_row_and_nothing_beside_them(spark):
    rows = [(1, "a\r\nb"), (1, "a\r\nb"), (None, "ü"), (4, "")]
    values = spark.createDataFrame(rows, "doc_id long, value string").repartition(3)
    path = scratch_path(spark, "files")
    fx.write_text_files(values.select("value"), path)
    names = [name for _, _, files in os.walk(path) for name in files]
    assert len(names) == len(rows) and all(name.endswith(".txt") for name in names)
    found = sorted(r.text for r in read_resume_files(spark, path, "*.txt").selectExpr("cast(content AS string) AS text").collect())
    assert found == sorted(value + "\n" for _, value in rows)
    fx.write_text_files(values.where("false").select("value"), scratch_path(spark, "files"))


@pytest.mark.parametrize("pattern", [None, "*.{txt,TXT}", "[!a]?[0-4]*", "a\\*[b,]*"])
def test_tasks_list_and_read_what_a_file_scan_does(spark, tmp_path, monkeypatch, pattern):
    monkeypatch.setattr(resumes, "BATCH_FILES", 7)
    for i in range(200):
        folder = tmp_path / ["", "deep/er", "_hidden", "a=1", "_k=2", ".git", "_metadata.d"][i % 11 % 7] / f"n{i % 5}"
        folder.mkdir(parents=True, exist_ok=True)
        name = [f"b{i}.txt", f"a*b{i}.TXT", f"_x{i}.txt", f".y{i}", f"ü {i}%20#.docx", f"_metadata{i}", f"_m=q{i}", f"_metadata=m{i}", f"q{i}.txt._COPYING_"][i % 9]
        (folder / name).write_bytes(b"" if i % 10 == 0 else bytes([i]) * i)
    scan = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    expected = (scan.option("pathGlobFilter", pattern) if pattern else scan).load(str(tmp_path))
    for path in (str(tmp_path), f"file://{tmp_path}/"):
        found = read_resume_files(spark, path, pattern)
        assert found.drop("format").schema.simpleString() == expected.schema.simpleString()
        rows = lambda df: sorted((r.path, r.modificationTime, r.length, bytes(r.content)) for r in df.collect())
        assert rows(found) == rows(expected) and rows(found)


def test_the_driver_holds_nothing_per_file(spark, tmp_path):
    for i in range(600):
        (tmp_path / f"{i}.txt").write_text("text")
    found = read_resume_files(spark, str(tmp_path))
    assert found.count() == 600
    assert len(found.inputFiles()) < 20 and found.rdd.getNumPartitions() <= 8


def test_files_reach_decoders_in_small_batches(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    files = spark.createDataFrame([(i, "/x/a.odt", bytearray(fx.odt_bytes(TEXT))) for i in range(3)], "doc_id long, path string, content binary")
    try:
        for extract in (documents.extract_docx, documents.extract_odt, documents.extract_text):
            spark.conf.set(key, str(64 << 20))
            assert [r.text for r in extract(files).collect()] == ([""] if extract is documents.extract_docx else [TEXT]) * 3
            assert int(spark.conf.get(key)) <= 4 << 20
    finally:
        spark.conf.set(key, before)


def test_words_that_are_no_anchor_are_not_shuffled(spark):
    """A dictionary joined by shuffle: before its join, words no entry has are dropped where they lie."""
    docs = spark.createDataFrame([(1, "red big gear and red"), (2, "other words only"), (3, None)], "doc_id long, text string")
    dictionary = spark.createDataFrame([("red",), ("big gear",), ("Gear and red",), (None,)], "skill string")
    hits = extraction.skill_hits(docs, dictionary, max_broadcast=0)
    assert sorted((r.doc_id, r.skill) for r in hits.collect()) == [(1, "big gear"), (1, "gear and red"), (1, "red"), (1, "red")]
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftSemi") >= 2


def test_absent_numbers_are_null_without_a_cast(spark):
    """A cast that fails costs as much as a search, and most groups of a date are absent."""
    rows = spark.createDataFrame([("", 1), ("07", 2), (None, 3)], "group string, n int")
    got = rows.select(experience._number(F.col("group")).alias("i"), experience._number(F.col("group"), "double").alias("d")).collect()
    assert [tuple(r) for r in got] == [(None, None), (7, 7.0), (None, None)]
    aside = "Experience\n- Lead, 6 years of it abroad\n- built in 2 years a team\n- A, 2001 to 2003, 4 months\n- B, 5 years"
    text = spark.createDataFrame([(aside,), (aside.replace("2001 to 2003", "some time"),)], "text string")
    years = text.select(experience.work_history_years(F.col("text"), dt.date(2026, 4, 1)).alias("y")).collect()
    assert [r.y for r in years] == [7.0, 13.33]


def test_docx_and_odt_marks_and_nested_runs():
    text = "a\tb  c\n\n  <d> & é"
    assert documents.docx_text(fx.docx_bytes(text)) == text
    assert documents.odt_text(fx.odt_bytes(text)) == text
