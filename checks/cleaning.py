"""Scalar functions, filters, duplicates and appends."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import fixtures as fx
from checks import oracles as o
from checks.oracles import using
from screenforge.functions.dates import format_interview_date, format_interview_time
from screenforge.functions.experience import clean_experience, parse_experience
from screenforge.functions.literals import format_list_literal, parse_list_literal
from screenforge.functions.text import email_key, resolve_role, skill_count, split_skills, title_case, valid_email
from screenforge.functions.vectors import cosine100
from screenforge.operators import dedup, filters
from screenforge.operators.outbox import expand_recipients
from screenforge.operators.scoring import prepare_requests
from screenforge.plans.intake import clean_applications, register


def joined(c: str, alias: str | None = None):
    """Arrays are compared as text."""
    return F.array_join(F.col(c), "|", "NULL").alias(alias or c)


# --- experience ---------------------------------------------------------------------------------


def x1_parse_experience(spark, sf):
    return fx.applications(spark, sf).select(
        "application_id",
        parse_experience(F.col("experience_raw")).alias("experience"),
        parse_experience(F.concat(F.lit(" About "), F.coalesce("experience_raw", F.lit("")), F.lit("\t"))).alias("padded"),
    )


def x1_numeric_experience(spark, sf):
    values = fx.table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_id") % 7 == 0, F.lit(None)).otherwise(F.col("value") - 10).alias("experience")
    )
    return clean_experience(values).select("event_id", "experience")


# --- lists as text ------------------------------------------------------------------------------

_LITERAL = """CASE p_partkey % 10
  WHEN 0 THEN concat('[''', a, ''', ''', b, ''']') WHEN 1 THEN concat('["', a, '", ''', b, ''']')
  WHEN 2 THEN concat('''', p_name, '''') WHEN 3 THEN concat('(''', a, ''', ''', b, ''')')
  WHEN 4 THEN concat('[None, ''', b, ''', True]') WHEN 5 THEN concat('', p_partkey)
  WHEN 6 THEN concat(a, ' and ', b) WHEN 7 THEN NULL
  WHEN 8 THEN concat(' [''', a, ''', 2, 3.5,] ') ELSE concat('[''', a, '''] ', b) END"""


def x2_parse_list_literal(spark, sf):
    parts = fx.table(spark, sf, "part").withColumns(
        {"a": F.split_part("p_name", F.lit(" "), F.lit(1)), "b": F.split_part("p_name", F.lit(" "), F.lit(2))}
    )
    items = parts.select("p_partkey", parse_list_literal(F.expr(_LITERAL)).alias("items"))
    return items.select("p_partkey", F.cardinality("items").cast("long").alias("n"), joined("items"))


def x3_list_literal_round_trip(spark, sf):
    docs = fx.documents(spark, sf).select("doc_id", F.split("text", " ").alias("words"))
    back = docs.select("doc_id", parse_list_literal(format_list_literal(F.col("words"))).alias("words"))
    return back.select("doc_id", F.array_join("words", " ").alias("text"))


def x3_format_list_literal(spark, sf):
    parts = fx.table(spark, sf, "part").select(
        "p_partkey", F.array_append(F.split("p_name", " "), F.concat(F.lit("it's "), F.col("p_brand"))).alias("items")
    )
    return parts.select("p_partkey", format_list_literal(F.col("items")).alias("literal"))


# --- text ---------------------------------------------------------------------------------------


def x4_resolve_role(spark, sf):
    return fx.applications(spark, sf).select("application_id", resolve_role(F.col("role_raw")).alias("role"))


def x5_email_key(spark, sf):
    return fx.applications(spark, sf).select("application_id", email_key(F.col("email")).alias("email_key"))


def x6_split_skills(spark, sf):
    split = fx.job_requests(spark, sf).select("request_id", split_skills(F.col("skills")).alias("items"))
    return split.select("request_id", F.cardinality("items").cast("long").alias("n"), joined("items"))


def x7_skill_count(spark, sf):
    return fx.applications(spark, sf).select(
        "application_id", skill_count(F.col("skills")).cast("long").alias("skill_count")
    )


def x8_title_case(spark, sf):
    text = F.concat_ws("_", F.lower("role_raw"), F.upper("location"), F.coalesce("email", F.lit("")))
    return fx.applications(spark, sf).select("application_id", title_case(text).alias("titled"))


def x9_format_interview_date(spark, sf):
    return fx.mail_requests(spark, sf).select("request_id", format_interview_date(F.col("date")).alias("long_date"))


def x10_format_interview_time(spark, sf):
    return fx.mail_requests(spark, sf).select("request_id", format_interview_time(F.col("time")).alias("long_time"))


def x11_valid_email(spark, sf):
    return expand_recipients(fx.mail_requests(spark, sf)).select(
        "request_id", F.col("position").cast("long").alias("position"), valid_email(F.col("email")).alias("valid")
    )


# --- filters ------------------------------------------------------------------------------------


def candidates(spark, sf):
    return register(fx.applications(spark, sf))


def cleaned(spark, sf):
    return clean_applications(fx.applications(spark, sf))


def e8_valid_extractions(spark, sf):
    apps = fx.applications(spark, sf)
    valid = filters.valid_extractions(apps).select("application_id", F.lit("valid").alias("part"))
    return valid.union(filters.rejected_extractions(apps).select("application_id", F.lit("rejected")))


def f1_minimum_experience(spark, sf):
    rows = cleaned(spark, sf)
    some = rows.where(filters.meets_experience(F.col("experience"), F.lit(5.5)))
    every = rows.where(filters.meets_experience(F.col("experience"), F.lit(0.0)))
    return some.select("application_id", F.lit(5.5).alias("minimum")).union(every.select("application_id", F.lit(0.0)))


def f2_location(spark, sf):
    rows = cleaned(spark, sf)
    out = None
    for mode, wanted, regex in (("text", "Nation_1", False), ("regex", "nation_1[0-4]$", True), ("any", "", False)):
        kept = rows.where(filters.meets_location(F.col("location"), F.lit(wanted), regex))
        part = kept.select("application_id", F.lit(mode).alias("mode"))
        out = part if out is None else out.union(part)
    return out


def neighbours(spark, sf):
    """Each vector with the next one."""
    e = fx.table(spark, sf, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return e.join(nxt, "vec_id").select("vec_id", cosine100(F.col("embedding"), F.col("next")).alias("raw"))


def f3_similarity_cut(spark, sf):
    return neighbours(spark, sf).select(
        "vec_id", F.round(filters.cut_similarity(F.col("raw")), 4).alias("similarity")
    )


def f5_any_filter(spark, sf):
    return fx.job_requests(spark, sf).select(
        "request_id", filters.any_filter(F.col("skills"), F.col("experience"), F.col("location")).alias("any_filter")
    )


def f6_drop_nameless(spark, sf):
    return filters.drop_nameless(fx.applications(spark, sf)).select("application_id", "name")


def f7_has_experience(spark, sf):
    return filters.has_experience(cleaned(spark, sf)).select("application_id", "experience")


# --- duplicates and appends ---------------------------------------------------------------------


def d1_dedup_first(spark, sf):
    return dedup.dedup_first(cleaned(spark, sf)).select("application_id", "role", "email")


def _old_and_new(spark, sf):
    rows = cleaned(spark, sf)
    turn = F.lit("1998-01-01").cast("timestamp_ntz")
    return rows.where(F.col("applied_at") < turn), rows.where(F.col("applied_at") >= turn)


def j1_new_applications(spark, sf):
    old, new = _old_and_new(spark, sf)
    fresh = dedup.new_applications(new, old).select("application_id", F.lit("new").alias("part"))
    return fresh.union(dedup.registered_applications(new, old).select("application_id", F.lit("registered")))


def j1_large_delivery(spark, sf):
    """The same against a delivery too large to be broadcast."""
    old, new = _old_and_new(spark, sf)
    fresh = dedup.new_applications(new, old, max_rows=0).select("application_id", F.lit("new").alias("part"))
    return fresh.union(dedup.registered_applications(new, old, max_rows=0).select("application_id", F.lit("registered")))


def u1_append_rows(spark, sf):
    old, new = _old_and_new(spark, sf)
    narrow = old.select("application_id", "role", "name")
    return dedup.append_rows(narrow, new.select("role", "application_id", "experience", "name"))


def j2_weights(spark, sf):
    return prepare_requests(fx.job_requests(spark, sf)).select(
        "request_id", "role", *[F.col(c).cast("long").alias(c) for c in ("w_skills", "w_experience", "w_location")]
    )


def j2_weights_from_table(spark, sf):
    table = spark.createDataFrame(
        [("developer", 10, 20, 70), ("designer", 1, 2, 97)], "role string, w_skills int, w_experience int, w_location int"
    )
    return prepare_requests(fx.job_requests(spark, sf), table).select(
        "request_id", "role", *[F.col(c).cast("long").alias(c) for c in ("w_skills", "w_experience", "w_location")]
    )


QUERIES = {
    f.__name__: f
    for f in (
        x1_parse_experience, x1_numeric_experience, x2_parse_list_literal, x3_list_literal_round_trip,
        x3_format_list_literal, x4_resolve_role, x5_email_key, x6_split_skills, x7_skill_count, x8_title_case,
        x9_format_interview_date, x10_format_interview_time, x11_valid_email, e8_valid_extractions,
        f1_minimum_experience, f2_location, f3_similarity_cut, f5_any_filter, f6_drop_nameless, f7_has_experience,
        d1_dedup_first, j1_new_applications, j1_large_delivery, u1_append_rows, j2_weights, j2_weights_from_table,
    )
}

ORACLES = {
    "x1_parse_experience": using("applications", body=f"""
      SELECT application_id, {o.experience('experience_raw')} AS experience,
        {o.experience("' About ' || coalesce(experience_raw, '') || chr(9)")} AS padded FROM applications"""),
    "x1_numeric_experience": """SELECT event_id, CASE WHEN event_id % 7 = 0 OR value IS NULL THEN 0.0
      ELSE value - 10 END AS experience FROM events""",
    "x2_parse_list_literal": """SELECT p_partkey, len(items) AS n, coalesce(array_to_string(items, '|'), '') AS items FROM (
      SELECT p_partkey, CASE p_partkey % 10 WHEN 0 THEN [a, b] WHEN 1 THEN [a, b] WHEN 2 THEN [p_name]
        WHEN 3 THEN ['(''' || a || ''', ''' || b || ''')'] WHEN 4 THEN ['NULL', b, 'True']
        WHEN 5 THEN [p_partkey::VARCHAR] WHEN 8 THEN [a, '2', '3.5'] ELSE []::VARCHAR[] END AS items
      FROM (SELECT *, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part))""",
    "x3_list_literal_round_trip": "SELECT doc_id, text FROM documents",
    "x3_format_list_literal": """SELECT p_partkey, '[''' || replace(p_name, ' ', ''', ''') || ''', "it''s ' || p_brand
      || '"]' AS literal FROM part""",
    "x4_resolve_role": using("applications", body=f"SELECT application_id, {o.role('role_raw')} AS role FROM applications"),
    "x5_email_key": using("applications", body=f"SELECT application_id, {o.email_key('email')} AS email_key FROM applications"),
    "x6_split_skills": using("job_requests", body=f"""SELECT request_id, len(items) AS n,
      coalesce(array_to_string(items, '|'), '') AS items
      FROM (SELECT request_id, {o.split_skills('skills')} AS items FROM job_requests)"""),
    "x7_skill_count": using("applications", body="SELECT application_id, coalesce(len(skills), 0) AS skill_count FROM applications"),
    "x8_title_case": using("applications", body=f"""SELECT application_id, {o.title("text")} AS titled FROM (
      SELECT application_id, concat_ws('_', lower(role_raw), upper(location), coalesce(email, '')) AS text FROM applications)"""),
    "x9_format_interview_date": using("mail_checked", body="SELECT request_id, long_date FROM mail_checked"),
    "x10_format_interview_time": using("mail_checked", body="SELECT request_id, long_time FROM mail_checked"),
    "x11_valid_email": using("recipients", body="""SELECT request_id, position::BIGINT AS position,
      coalesce(contains(email, '@'), false) AS valid FROM recipients"""),
    "e8_valid_extractions": using("applications", body="""SELECT application_id,
      CASE WHEN name IS NULL OR name = '' THEN 'rejected' ELSE 'valid' END AS part FROM applications"""),
    "f1_minimum_experience": using("cleaned", body="""SELECT application_id, 5.5::DOUBLE AS minimum FROM cleaned
      WHERE experience >= 5.5 UNION ALL SELECT application_id, 0::DOUBLE FROM cleaned"""),
    "f2_location": using("cleaned", body="""SELECT application_id, 'text' AS mode FROM cleaned WHERE location ILIKE '%nation\\_1%' ESCAPE '\\'
      UNION ALL SELECT application_id, 'regex' FROM cleaned
        WHERE location IN ('NATION_10', 'NATION_11', 'NATION_12', 'NATION_13', 'NATION_14')
      UNION ALL SELECT application_id, 'any' FROM cleaned"""),
    "f3_similarity_cut": """SELECT vec_id, CASE WHEN raw < 15 THEN 0.0 ELSE round(raw, 4) END AS similarity FROM (
      SELECT a.vec_id, 100 * list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS raw
      FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)""",
    "f5_any_filter": using("prepared", body="SELECT request_id, any_filter FROM prepared"),
    "f6_drop_nameless": using("applications", body="""SELECT application_id, name FROM applications
      WHERE name IS NOT NULL AND name <> 'nan'"""),
    "f7_has_experience": using("cleaned", body="SELECT application_id, experience FROM cleaned WHERE experience > 0"),
    "d1_dedup_first": using("cleaned", body="""SELECT application_id, role, email FROM cleaned c WHERE NOT EXISTS (
      SELECT 1 FROM cleaned e WHERE e.role = c.role AND e.email_key = c.email_key
        AND (e.applied_at, e.application_id) < (c.applied_at, c.application_id))"""),
    "j1_new_applications": using("cleaned", body="""SELECT application_id,
        CASE WHEN min(applied_at) OVER (PARTITION BY role || '/' || coalesce(email_key, ' ' || application_id))
          < TIMESTAMP '1998-01-01' THEN 'registered' ELSE 'new' END AS part
      FROM cleaned QUALIFY applied_at >= TIMESTAMP '1998-01-01'"""),
    "u1_append_rows": using("cleaned", body="""SELECT application_id, role, name,
      CASE WHEN applied_at >= TIMESTAMP '1998-01-01' THEN experience END AS experience FROM cleaned"""),
    "j2_weights": using("prepared", body="""SELECT request_id, role, w_skills::BIGINT AS w_skills,
      w_experience::BIGINT AS w_experience, w_location::BIGINT AS w_location FROM prepared"""),
    "j2_weights_from_table": using("prepared", body="""SELECT request_id, role,
      (CASE role WHEN 'developer' THEN 10 WHEN 'designer' THEN 1 ELSE 50 END)::BIGINT AS w_skills,
      (CASE role WHEN 'developer' THEN 20 WHEN 'designer' THEN 2 ELSE 30 END)::BIGINT AS w_experience,
      (CASE role WHEN 'developer' THEN 70 WHEN 'designer' THEN 97 ELSE 20 END)::BIGINT AS w_location FROM prepared"""),
}
ORACLES["j1_large_delivery"] = ORACLES["j1_new_applications"]
