"""Resume files, their text, and the fields read from it."""

from __future__ import annotations

import datetime as dt

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks import fixtures as fx
from checks.oracles import using
from screenforge.functions.contacts import listed_skills
from screenforge.functions.experience import work_history_years
from screenforge.functions.replies import clean_json
from screenforge.functions.text import file_format
from screenforge.operators import documents as d
from screenforge.operators import extraction as e
from screenforge.operators.retries import AnswerQueue
from screenforge.plans.intake import clean_applications
from screenforge.session import scratch_path
from screenforge.sources.resumes import plain_text, read_resume_files

AS_OF = dt.date(2026, 4, 1)


def _resume_folder(spark, sf):
    """The documents written as one text file each, after a first line with the document's id;
    every other one with Windows line ends."""
    path = scratch_path(spark, "resume-files")
    docs = fx.documents(spark, sf)
    body = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit("\r\n"))).otherwise(F.col("text"))
    fx.write_text_files(docs.select(F.concat_ws("\n", F.col("doc_id").cast("string"), body).alias("value")), path)
    return path


def _scanned(spark, sf):
    files = read_resume_files(spark, _resume_folder(spark, sf), "*.txt")
    doc_id = F.regexp_extract(F.col("content").cast("string"), r"\A\d+", 0)
    # The writer ends every file with one line end of its own.
    length = F.col("length") - F.length(doc_id) - 2
    content = F.substring("content", F.length(doc_id) + 2, length.cast("int"))
    return files.withColumns({"doc_id": doc_id.cast("long"), "length": length, "content": content})


def s1_read_resume_files(spark, sf):
    return _scanned(spark, sf).select("doc_id", "format", "length")


def s2_file_format(spark, sf):
    suffix = F.element_at(
        F.array(*[F.lit(s) for s in (".pdf", ".PDF", ".docx", ".png", ".jpg", ".jpeg", ".txt", ".odt", ".xyz", "")]),
        (F.col("page_id") % 10 + 1).cast("int"),
    )
    return fx.table(spark, sf, "pages").select("page_id", file_format(F.concat("url", suffix)).alias("format"))


def s3_plain_text(spark, sf):
    return _scanned(spark, sf).select("doc_id", plain_text(F.col("content")).alias("text"))


def t1_extract_docx(spark, sf):
    return d.extract_docx(fx.document_files(spark, sf, F.lit("docx"))).select("doc_id", "text")


def t2_extract_odt(spark, sf):
    return d.extract_odt(fx.document_files(spark, sf, F.lit("odt"))).select("doc_id", "text")


def t3_assemble_pages(spark, sf):
    return d.assemble_pages(fx.resume_pages(spark, sf))


def t4_with_fallback(spark, sf):
    k = F.col("doc_id")
    primary = (
        F.when(k % 9 == 0, F.lit("")).when(k % 9 == 3, F.lit(" \t")).when(k % 9 == 6, F.lit("\n"))
        .when(k % 10 == 1, F.lit(None)).otherwise(F.col("text"))
    )
    docs = fx.documents(spark, sf)
    return docs.select(
        "doc_id", d.with_fallback(primary, F.col("text"), lambda c: F.when(k % 4 != 0, F.concat(F.lit("read: "), c))).alias("text")
    )


def t5_extract_text(spark, sf):
    kinds = F.array(*[F.lit(s) for s in ("txt", "docx", "odt", "TXT", "xyz", "pdf", "png")])
    files = fx.document_files(spark, sf, F.element_at(kinds, (F.col("doc_id") % 7 + 1).cast("int")))
    # The user's own decoders: this PDF reader fails on every other file, which the second one reads.
    return d.extract_text(
        files, decoders={"pdf": _every_other_pdf}, fallbacks={"pdf": lambda data: data.decode()}
    ).select("doc_id", "text")


def _every_other_pdf(data: bytes) -> str:
    if len(data) % 2:
        raise ValueError("scanned")
    return data.decode()


# --- structured fields --------------------------------------------------------------------------


def e1_build_prompts(spark, sf):
    return e.build_prompts(fx.documents(spark, sf), AS_OF).select("doc_id", "prompt")


def e2_clean_json(spark, sf):
    k = F.col("event_id") % 4
    reply = (
        F.when(k == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```")))
        .when(k == 1, F.concat(F.lit("Sure:\n"), "props", F.lit("\nand "), "props", F.lit(".")))
        .when(k == 2, F.concat(F.lit(" \n no object "), "event_type", F.lit("\n")))
        .otherwise(F.col("props"))
    )
    return fx.table(spark, sf, "events").select("event_id", clean_json(reply).alias("cleaned"))


def e3_parse_reply(spark, sf):
    return e.parse_replies(fx.model_replies(spark, sf)).select(
        "application_id", "name", "email", "phone", "location",
        F.array_join("skills", "|").alias("skills"), "experience", "error",
    )


def _model(reply: str, quota: int, failure: int):
    """A model that depends on the length of its prompt alone."""

    @F.pandas_udf(T.StructType([T.StructField("reply", T.StringType()), T.StructField("error", T.StringType())]))
    def ask(prompts: pd.Series) -> pd.DataFrame:
        out = []
        for prompt in prompts:
            if len(prompt) % quota == 0:
                out.append((None, "429 Quota exceeded" if len(prompt) % 2 else "Your QUOTA is used up"))
            elif len(prompt) % failure == 0:
                out.append((None, "connection reset"))
            else:
                out.append((f"{reply} {len(prompt)}", None))
        return pd.DataFrame(out, columns=["reply", "error"], dtype=object)

    return ask


def e4_fallback_chain(spark, sf):
    docs = fx.documents(spark, sf).select("doc_id", F.col("text").alias("prompt"))
    models = [("first", _model("one", 2, 5)), ("second", _model("two", 3, 7)), ("third", _model("three", 4, 11))]
    return e.fallback_chain(docs, models).select("doc_id", "model", "reply", "error")


def e4_retries(spark, sf):
    """Models whose quota ends later: three drains, the second of them twice, and one that comes too early."""
    queue = AnswerQueue(spark, scratch_path(spark, "answers"), dt.timedelta(minutes=10))
    docs = fx.documents(spark, sf).select(F.col("doc_id").alias("request_id"), F.length("text").cast("string").alias("prompt"))
    queue.put(docs, "asked")
    day, n = dt.datetime(2026, 4, 1), lambda prompt: prompt.cast("long")

    def model(name, free):
        return name, lambda prompt: F.struct(
            F.when(free(n(prompt)), F.concat(F.lit(f"{name} "), prompt)).alias("reply"), F.when(~free(n(prompt)), F.lit("429 quota")).alias("error")
        )

    first = [model("one", lambda x: x % 2 != 0)]
    later = [model("two", lambda x: x % 3 != 0), model("three", lambda x: x % 5 != 0)]
    last = [model("four", lambda x: x >= 0)]
    queue.drain(first, "d1", day)
    queue.drain(last, "early", day + dt.timedelta(minutes=9))
    for _ in range(2):
        queue.drain(later, "d2", day + dt.timedelta(minutes=10))
    queue.drain(last, "d3", day + dt.timedelta(minutes=40))
    return queue.latest().select("request_id", F.col("attempt").cast("long").alias("attempt"), "done", "model", "reply", "error")


def e5_extract_contacts(spark, sf):
    return e.extract_contacts(fx.documents(spark, sf)).select("doc_id", "name", "email", "phone", "location")


def e5_resume_contacts(spark, sf):
    return e.extract_contacts(fx.work_histories(spark, sf)).select("doc_id", "name", "email", "phone", "location")


def e6_extract_skills(spark, sf):
    words = F.filter(F.split("text", r"[^\p{L}\p{N}]+"), lambda w: w != "")
    pairs = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat_ws(" ", F.get("w", i - 1), F.get("w", i)))
    listed = fx.table(spark, sf, "benchmark").select(words.alias("w")).where("size(w) > 0")
    pairs = F.when(F.size("w") > 1, pairs).otherwise(F.array().cast("array<string>"))
    dictionary = listed.select(F.explode(F.concat("w", pairs)).alias("skill"))
    found = e.extract_skills(fx.documents(spark, sf), dictionary)
    return found.select("doc_id", F.array_join("skills", "|").alias("skills"))


def e6_long_entries(spark, sf):
    """Entries of one to twenty words, joined by salted anchors instead of a broadcast."""
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    items = fx.table(spark, sf, "benchmark").select("item_id", words.alias("w")).where("size(w) > 0")
    entry = F.array_join(F.slice("w", F.lit(1), (F.col("item_id") % 20 + 1).cast("int")), " ")
    hits = e.skill_hits(fx.documents(spark, sf), items.select(entry.alias("skill")), max_broadcast=0)
    return hits.groupBy("doc_id", "skill").agg(F.count(F.lit(1)).alias("places"))


def e6_listed_skills(spark, sf):
    return fx.work_histories(spark, sf).select(
        "doc_id", F.array_join(listed_skills(F.col("text")), "|").alias("skills")
    )


def e7_work_history_years(spark, sf):
    return fx.work_histories(spark, sf).select("doc_id", work_history_years(F.col("text"), AS_OF).alias("years"))


def e3_numeric_experience(spark, sf):
    """Replies whose experience is a number, kept as it is, or text, which is parsed."""
    k = F.col("o_orderkey")
    years = (k % 17 * F.lit(1.001)).cast("decimal(9,3)").cast("string")
    value = (
        F.when(k % 4 == 0, years)
        .when(k % 4 == 1, F.concat(F.lit('"'), years, F.lit(' years"')))
        .when(k % 4 == 2, F.concat(F.lit("-"), k % 17))
        .otherwise(F.concat(F.lit('"-'), k % 17, F.lit('"')))
    )
    reply = F.concat(F.lit('{"name": "N", "email": "e@x.example", "skills": ["\\"experience\\": 7,"], "experience": '), value, F.lit("}"))
    replies = fx.table(spark, sf, "orders").select(
        k.alias("application_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("applied_at"), F.lit("hr").alias("role_raw"), reply.alias("reply")
    )
    rows = e.parse_replies(replies).withColumn("experience_raw", F.col("experience"))
    return clean_applications(rows).select("application_id", "experience")


def e7_date_forms(spark, sf):
    """Jobs of two years and a month, or up to now, in several forms, with lengths beside them that don't count."""
    k, start = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    end = F.add_months(start, 24)

    def both(pattern, between):
        return F.concat(F.date_format(start, pattern), F.lit(between), F.date_format(end, pattern))

    job = (
        F.when(k % 5 == 0, both("MM/yyyy", " - "))
        .when(k % 5 == 1, both("yyyy-MM", " to "))
        .when(k % 5 == 2, both("MMM ''yy", " – "))
        .when(k % 5 == 3, F.concat(F.date_format(start, "MM/yyyy"), F.when(k % 2 == 0, F.lit(" to date")).otherwise(F.lit(" - now"))))
        .otherwise(both("MMMM yyyy", " until "))
    )
    text = F.concat(F.lit("Name\n\nWork Experience\nWORK EXPERIENCE (5 YEARS)\nAcme, "), job, F.lit("\n- cut 10 years of backlog\n\nEducation\n01/1980 - 01/1990\n"))
    return fx.table(spark, sf, "orders").select(k.alias("doc_id"), work_history_years(text, AS_OF).alias("years"))


QUERIES = {
    f.__name__: f
    for f in (
        s1_read_resume_files, s2_file_format, s3_plain_text, t1_extract_docx, t2_extract_odt, t3_assemble_pages,
        t4_with_fallback, t5_extract_text, e1_build_prompts, e2_clean_json, e3_parse_reply, e4_fallback_chain, e4_retries,
        e5_extract_contacts, e5_resume_contacts, e6_extract_skills, e6_long_entries, e6_listed_skills, e7_work_history_years,
        e3_numeric_experience, e7_date_forms,
    )
}

_RULES = e.prompt_rules(AS_OF).replace("'", "''")
_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
_PHONE = r"\+?\(?[0-9][0-9() .-]{7,17}[0-9]"
_PHONE_LABEL = r"(?im)^[ \t]*(?:phone|mobile|telephone|tel|cell)[^:\n]*:[ \t]*(\+?\(?[0-9][0-9() .-]{7,17}[0-9])"
_LOCATION = r"(?im)^[ \t]*(?:location|address|city)[ \t]*:[ \t]*([^\r\n]+)"


ORACLES = {
    "s1_read_resume_files": """SELECT doc_id, 'txt' AS format, strlen(text)::BIGINT + CASE WHEN doc_id % 2 = 0
      THEN length(text) - length(replace(text, chr(10), '')) ELSE 0 END AS length FROM documents""",
    "s2_file_format": """SELECT page_id, CASE page_id % 10 WHEN 0 THEN 'pdf' WHEN 2 THEN 'docx' WHEN 3 THEN 'image'
      WHEN 4 THEN 'image' WHEN 5 THEN 'image' WHEN 6 THEN 'txt' WHEN 7 THEN 'odt' ELSE 'unknown' END AS format FROM pages""",
    "s3_plain_text": "SELECT doc_id, text FROM documents",
    "t1_extract_docx": "SELECT doc_id, text FROM documents",
    "t2_extract_odt": "SELECT doc_id, text FROM documents",
    "t3_assemble_pages": f"""SELECT doc_id, coalesce(string_agg(part, '' ORDER BY page_no), '') AS text FROM (
      SELECT doc_id, page_no, CASE WHEN page_no % 7 <> 0
        THEN substring(text, (page_no - 1) * {fx.PAGE_CHARS} + 1, {fx.PAGE_CHARS}) END AS part
      FROM (SELECT doc_id, text, unnest(range(1, greatest((length(text) + {fx.PAGE_CHARS} - 1) // {fx.PAGE_CHARS}, 1) + 1)) AS page_no
        FROM documents)) GROUP BY doc_id""",
    "t4_with_fallback": """SELECT doc_id, CASE WHEN doc_id % 3 = 0 OR doc_id % 10 = 1 THEN
        CASE WHEN doc_id % 9 = 3 THEN ' ' || chr(9) WHEN doc_id % 9 = 6 THEN chr(10) ELSE '' END
        || CASE WHEN doc_id % 4 <> 0 THEN 'read: ' || text ELSE '' END
      ELSE text END AS text FROM documents""",
    "t5_extract_text": "SELECT doc_id, CASE WHEN doc_id % 7 IN (3, 4, 6) THEN '' ELSE text END AS text FROM documents",
    "e1_build_prompts": f"SELECT doc_id, '{_RULES}' || text AS prompt FROM documents",
    "e2_clean_json": """SELECT event_id, CASE event_id % 4 WHEN 1 THEN props || chr(10) || 'and ' || props
      WHEN 2 THEN 'no object ' || event_type ELSE props END AS cleaned FROM events""",
    "e3_parse_reply": using("applications", body="""SELECT application_id,
        CASE WHEN ok THEN name END AS name, CASE WHEN ok THEN email END AS email, NULL::VARCHAR AS phone,
        CASE WHEN ok THEN location END AS location,
        CASE WHEN ok THEN coalesce(array_to_string(skills, '|'), '') ELSE '' END AS skills,
        CASE WHEN ok THEN experience_raw END AS experience,
        CASE WHEN NOT ok THEN 'reply is not one JSON object' END AS error
      FROM (SELECT *, application_id % 6 < 3 AS ok FROM applications)"""),
    "e4_fallback_chain": """SELECT doc_id, CASE WHEN n % 2 <> 0 THEN 'first' WHEN n % 3 <> 0 THEN 'second'
        WHEN n % 4 <> 0 THEN 'third' END AS model,
      CASE WHEN n % 2 <> 0 THEN CASE WHEN n % 5 <> 0 THEN 'one ' || n END
        WHEN n % 3 <> 0 THEN CASE WHEN n % 7 <> 0 THEN 'two ' || n END
        WHEN n % 4 <> 0 THEN CASE WHEN n % 11 <> 0 THEN 'three ' || n END END AS reply,
      CASE WHEN n % 2 <> 0 THEN CASE WHEN n % 5 = 0 THEN 'connection reset' END
        WHEN n % 3 <> 0 THEN CASE WHEN n % 7 = 0 THEN 'connection reset' END
        WHEN n % 4 <> 0 THEN CASE WHEN n % 11 = 0 THEN 'connection reset' END
        ELSE 'every model is over its quota' END AS error
      FROM (SELECT doc_id, length(text) AS n FROM documents)""",
    "e4_retries": """SELECT doc_id AS request_id, CASE WHEN n % 2 <> 0 THEN 1 WHEN n % 15 <> 0 THEN 2 ELSE 3 END::BIGINT AS attempt, true AS done,
      m AS model, m || ' ' || n AS reply, NULL::VARCHAR AS error FROM (SELECT *, CASE WHEN n % 2 <> 0 THEN 'one' WHEN n % 3 <> 0 THEN 'two'
        WHEN n % 5 <> 0 THEN 'three' ELSE 'four' END AS m FROM (SELECT doc_id, length(text) AS n FROM documents))""",
    "e5_extract_contacts": f"""SELECT doc_id, nullif(trim(regexp_extract(text, '[^\\s][^\\r\\n]*')), '') AS name,
      nullif(regexp_extract(text, '{_EMAIL}'), '') AS email, coalesce(nullif(regexp_extract(text, '{_PHONE_LABEL}', 1), ''), nullif(regexp_extract(text, '{_PHONE}'), '')) AS phone,
      nullif(trim(regexp_extract(text, '{_LOCATION}', 1)), '') AS location FROM documents""",
    "e5_resume_contacts": using("histories", body="""SELECT o_orderkey AS doc_id, c_name AS name,
      'resume' || o_orderkey || '@mail.example' AS email, '+49 30 ' || (o_orderkey + 1000000) AS phone,
      n_name AS location FROM histories"""),
    "e6_extract_skills": r"""WITH items AS (SELECT list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM benchmark),
      dictionary AS (SELECT DISTINCT unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS skill
        FROM items WHERE len(w) > 0),
      words AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(lower(text), '\.+([^\p{L}\p{N}]|\z)', ' ', 'g'),
        '[^\p{L}\p{N}+#.]+'), lambda w: w <> '') AS w FROM documents),
      tokens AS (SELECT doc_id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS skill FROM words),
      found AS (SELECT doc_id, list_sort(list(DISTINCT skill)) AS skills FROM tokens
        JOIN dictionary USING (skill) GROUP BY doc_id)
      SELECT doc_id, coalesce(array_to_string(skills, '|'), '') AS skills FROM documents LEFT JOIN found USING (doc_id)""",
    "e6_long_entries": r"""WITH items AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM benchmark),
      dictionary AS (SELECT DISTINCT w[1 : item_id % 20 + 1] AS entry FROM items WHERE len(w) > 0),
      words AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(lower(text), '\.+([^\p{L}\p{N}]|\z)', ' ', 'g'),
        '[^\p{L}\p{N}+#.]+'), lambda w: w <> '') AS w FROM documents),
      places AS (SELECT doc_id, i, word, lead(word) OVER (PARTITION BY doc_id ORDER BY i) AS following
        FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM words)),
      begun AS (SELECT doc_id, i, entry FROM places JOIN (SELECT entry, entry[1] AS word, entry[2] AS following FROM dictionary) d
        ON places.word = d.word AND (d.following IS NULL OR places.following = d.following))
      SELECT doc_id, array_to_string(entry, ' ') AS skill, count(*) AS places FROM begun JOIN words USING (doc_id)
      WHERE w[i : i + len(entry) - 1] = entry GROUP BY ALL""",
    "e3_numeric_experience": """SELECT o_orderkey AS application_id, CASE o_orderkey % 4 WHEN 0 THEN o_orderkey % 17 * 1.001::DOUBLE
      WHEN 1 THEN round(o_orderkey % 17 * 1.001, 2)::DOUBLE WHEN 2 THEN -(o_orderkey % 17)::DOUBLE ELSE (o_orderkey % 17)::DOUBLE END AS experience FROM orders""",
    "e7_date_forms": """SELECT o_orderkey AS doc_id, round(CASE o_orderkey % 5 WHEN 3 THEN
        (2026 - year(o_orderdate)) * 12 + 4 - month(o_orderdate) ELSE 25 END::DOUBLE / 12, 2) AS years FROM orders""",
    "e6_listed_skills": using("histories", body="""SELECT o_orderkey AS doc_id,
      c_mktsegment || '|Planning|spark|Team work' AS skills FROM histories"""),
    "e7_work_history_years": using("histories", body="SELECT o_orderkey AS doc_id, years FROM histories"),
}
