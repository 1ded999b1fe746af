"""Candidate tables, similarity, scores, ranked lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.cleaning import candidates, neighbours
from checks.oracles import using
from screenforge.functions.text import skill_count
from screenforge.functions.vectors import cosine100, set_cosine100
from screenforge.operators import ranking
from screenforge.operators.cooccurrence import cooccurrence, learned_skill_vectors, ppmi
from screenforge.operators.joins import lookup_join
from screenforge.operators.scoring import add_score, match, prepare_requests, word_similarity
from screenforge.operators.similarity import add_skill_vector, embed, train_skill_vectors
from screenforge.plans import shortlist
from screenforge.session import materialize, scratch_path
from screenforge.sources import candidates as store
from screenforge.sources import pages

# --- candidate table ----------------------------------------------------------------------------


def _stored(spark, sf, fmt):
    path = scratch_path(spark, "candidates")
    store.write_candidates(candidates(spark, sf), path, fmt)
    return path


def _listed(df):
    return df.select("application_id", "role", "name", "email", "location", F.coalesce(F.array_join("skills", "|"), F.lit("")).alias("skills"), "experience")


def s4_read_candidates(spark, sf):
    return _listed(store.read_candidates(spark, _stored(spark, sf, "parquet"), "QA"))


def s5_write_candidates(spark, sf):
    return _listed(store.read_candidates(spark, _stored(spark, sf, "csv"), fmt="csv"))


def s6_score_column(spark, sf):
    return store.with_score_column(candidates(spark, sf)).select("application_id", "score")


def s7_to_records(spark, sf):
    rows = candidates(spark, sf).select("application_id", "role", "name", "email", "location", "skills", "experience")
    return store.to_records(rows)


# --- similarity ---------------------------------------------------------------------------------


def v1_cosine(spark, sf):
    return neighbours(spark, sf).select("vec_id", F.round("raw", 4).alias("raw"))


def _stored_candidates(spark, sf):
    """The candidates as a search finds them: registered and written before."""
    return store.read_candidates(spark, _stored(spark, sf, "parquet"))


def _with_vectors(spark, sf):
    return add_skill_vector(_stored_candidates(spark, sf), fx.skill_vectors(spark, sf), "application_id")


def v2_skill_vector(spark, sf):
    """Similarity of each candidate's vector to that of its first skill alone; 0 without skills."""
    rows = _with_vectors(spark, sf).select("application_id", "vector", F.get("skills", F.lit(0)).alias("skill"))
    pairs = lookup_join(rows, fx.skill_vectors(spark, sf), "skill")
    raw = F.coalesce(cosine100(F.col("vector"), F.col("embedding")), F.lit(0.0))
    return pairs.select("application_id", F.round(raw, 4).alias("raw"))


def v3_train_skill_vectors(spark, sf):
    trained = train_skill_vectors(fx.applications(spark, sf), dims=16)
    return trained.select("skill", F.cardinality("embedding").cast("long").alias("dims"))


def _letter_counter():
    return lambda texts: [[len(t), t.count(" "), t.count("e")] for t in texts]


def v3_cooccurrence(spark, sf):
    """Counts and weights from which skill vectors are learned, over the candidates' skills and their roles."""
    rows = candidates(spark, sf).select(F.concat(F.coalesce("skills", F.array().cast("array<string>")), F.array("role")).alias("skills"))
    weights = ppmi(cooccurrence(rows))
    return weights.select("skill", "other", "n", F.round("weight", 6).alias("weight"))


def v3_learned_vectors(spark, sf):
    """A vector of 8 numbers for every skill that occurs with another, none of them zero alone."""
    learned = learned_skill_vectors(candidates(spark, sf), dims=8)
    return learned.select("skill", F.cardinality("embedding").cast("long").alias("dims"))


def v4_embed(spark, sf):
    rows = embed(fx.documents(spark, sf).select("doc_id", "text"), "text", _letter_counter)
    return rows.select(
        "doc_id", F.array_join(F.transform("vector", lambda x: x.cast("long").cast("string")), ",").alias("vector")
    )


def v5_word_similarity(spark, sf):
    lists = candidates(spark, sf).select("application_id", F.coalesce("skills", F.array().cast("array<string>")).alias("skills"))
    wanted = F.array(F.lit("red"), F.lit("gear"), F.lit("small"))
    return lists.select("application_id", F.round(set_cosine100(F.col("skills"), wanted), 4).alias("raw"))


def v6_empty_side(spark, sf):
    """Requests of a role against candidates without skills score no similarity."""
    pairs = match(candidates(spark, sf), _forms(spark))
    scored = add_score(pairs.where(skill_count(F.col("skills")) == 0), word_similarity())
    return scored.select("request_id", "application_id", "raw_similarity")


# --- matching and scores ------------------------------------------------------------------------


def _forms(spark):
    return prepare_requests(fx.form_requests(spark))


def _form_scores(spark, sf):
    """Scores of the form requests by vectors, before the filter on positive scores."""
    jobs = shortlist.with_job_vectors(_forms(spark), fx.skill_vectors(spark, sf))
    return add_score(match(_with_vectors(spark, sf), jobs), shortlist.vector_similarity())


def j3_match(spark, sf):
    pairs = match(candidates(spark, sf), _forms(spark))
    return pairs.select("request_id", "application_id")


def v7_score(spark, sf):
    return _form_scores(spark, sf).select("request_id", "application_id", "score")


def v7_score_negative_experience(spark, sf):
    """A request without restrictions over years that may be negative: the base score of 1."""
    rows = candidates(spark, sf).withColumn("experience", F.col("experience") - 5)
    jobs = _forms(spark).where(~F.col("any_filter"))
    return add_score(match(rows, jobs), word_similarity()).select("request_id", "application_id", "score")


def f4_positive_score(spark, sf):
    return shortlist.positive_score(_form_scores(spark, sf)).select("request_id", "application_id", "score")


def _matches(spark, sf):
    return shortlist.positive_score(_form_scores(spark, sf))


def k1_rank_filtered(spark, sf):
    ranked = ranking.rank_matches(_matches(spark, sf).where("any_filter"))
    return ranked.select("request_id", "application_id", "score", "experience")


def k1_word_similarity(spark, sf):
    """One request by shared words."""
    jobs = _forms(spark).where(F.col("request_id") == 1)
    ranked = shortlist.list_matches(_stored_candidates(spark, sf), jobs, word_similarity())
    return ranked.select("application_id", "name", "score", "experience")


def k2_rank_unfiltered(spark, sf):
    ranked = ranking.rank_matches(_matches(spark, sf).where(~F.col("any_filter")))
    return ranked.select("request_id", "application_id", "experience")


def k3_by_experience(spark, sf):
    rows = candidates(spark, sf).where(F.col("role") == "developer")
    return ranking.by_experience(rows).select("application_id", "name", "experience")


def k3_pages(spark, sf):
    """The listing read back page by page: the first four by number, the rest behind the last row of each."""
    path = scratch_path(spark, "listing")
    rows = candidates(spark, sf).where(F.col("role") == "developer").select("application_id", "name", "experience")
    total = rows.count()
    size = max(1, total // 9)
    pages.write_listing(rows, path, rows_per_file=max(1, total // 5))
    parts = [pages.read_page(spark, path, number, size).withColumn("page", F.lit(number)) for number in range(4)]
    for number in range(4, -(-total // size)):
        last = parts[-1].orderBy(F.col("experience").asc_nulls_first(), F.desc("application_id")).first()
        behind = pages.read_after(spark, path, pages.Cursor(last.experience, last.application_id), size)
        parts.append(behind.withColumn("page", F.lit(number)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select(F.col("page").cast("long").alias("page"), "application_id", "name", "experience")


def k4_most_experienced(spark, sf):
    rows = candidates(spark, sf).where(F.col("role") == "developer")
    return ranking.most_experienced(rows).select("application_id", "name", "experience")


def k4_role_overview(spark, sf):
    """The listing and the first five of a stored role."""
    every, first = shortlist.role_overview(spark, _stored(spark, sf, "parquet"), "QA")
    columns = ["application_id", "experience", "score"]
    return every.select(F.lit("all").alias("part"), *columns).union(first.select(F.lit("first"), *columns))


def k5_top_matches(spark, sf):
    """First five of the form requests, from scored rows."""
    top = ranking.top_matches(_matches(spark, sf))
    return top.select("request_id", F.col("place").cast("long").alias("place"), "application_id", "score")


def k5_shortlists(spark, sf):
    """First five of one request per supplier, from blocks of candidates and requests."""
    top = shortlist.shortlist_many(_stored_candidates(spark, sf), fx.job_requests(spark, sf), fx.skill_vectors(spark, sf))
    return top.select("request_id", F.col("place").cast("long").alias("place"), "application_id", "name", "score", "experience")


def k5_stored_vectors(spark, sf):
    """Vectors that are stored with the candidates and depend on the order of their skills."""
    path = scratch_path(spark, "candidates")
    rows = candidates(spark, sf)
    odd = F.col("application_id") % 2 == 1
    rows = rows.withColumn("skills", F.when(odd, F.reverse("skills")).otherwise(F.col("skills")))
    first = rows.select("application_id", F.get("skills", F.lit(0)).alias("skill"))
    unit = F.sqrt(F.aggregate(F.transform("_e", lambda x: x * x), F.lit(0.0), lambda a, b: a + b))
    # Scaled once per skill and not once per candidate.
    units = fx.skill_vectors(spark, sf).withColumn("_e", F.col("embedding").cast("array<double>")).withColumn("_n", unit)
    units = units.select("skill", F.transform("_e", lambda x: x / F.col("_n")).alias("vector"))
    vectors = lookup_join(first, units, "skill", "inner").select("application_id", "vector")
    store.write_candidates(rows.join(vectors, "application_id", "left"), path)
    stored = store.read_candidates(spark, path, vectors=True)
    top = shortlist.shortlist_many(stored, fx.job_requests(spark, sf), fx.skill_vectors(spark, sf))
    return top.select("request_id", F.col("place").cast("long").alias("place"), "application_id", "name", "score", F.coalesce(F.array_join("skills", "|"), F.lit("")).alias("skills"))


def k5_pruned_shortlists(spark, sf):
    """The same first five, from the clusters of candidates that can hold them."""
    search = shortlist.shortlist_pruned(_stored_candidates(spark, sf), fx.job_requests(spark, sf), fx.skill_vectors(spark, sf), rows_per_cluster=100)
    return search.rows.select("request_id", F.col("place").cast("long").alias("place"), "application_id", "name", "score", "experience")


def k1_to_k5_search(spark, sf):
    """Ranked list, whole listing and first five of the form requests, from one scan."""
    jobs = shortlist.with_job_vectors(_forms(spark), fx.skill_vectors(spark, sf))
    found = shortlist.search(_with_vectors(spark, sf), jobs)
    columns = ["request_id", "application_id", "experience"]
    parts = [
        found.ranked.select(F.lit("ranked").alias("part"), *columns, "score", F.lit(0).cast("long").alias("place")),
        found.listing.select(F.lit("listing"), *columns, F.lit(0.0), F.lit(0).cast("long")),
        found.top.select(F.lit("top"), *columns, "score", F.col("place").cast("long")),
    ]
    return parts[0].union(parts[1]).union(parts[2])


def s5_candidate_batches(spark, sf):
    """Two batches; the first is written twice, and of a third only the rows are there."""
    path = scratch_path(spark, "candidate-batches")
    rows = materialize(candidates(spark, sf), "candidates")  # three writes read them
    odd, even = rows.where("application_id % 2 = 1"), rows.where("application_id % 2 = 0")
    for part, name in ((odd, "odd"), (odd, "odd"), (even, "even")):
        store.write_candidate_batch(part, path, name)
    store.candidate_batches(spark, path).add_rows(rows.withColumn("vector", F.lit(None).cast("array<double>")), "cut-off")
    return _listed(store.read_candidate_batches(spark, path))


def s4_read_csv_by_name(spark, sf):
    """A table of another writer: one file per role, other columns in another order."""
    path = scratch_path(spark, "foreign")
    rows = candidates(spark, sf)
    skills = store.format_list_literal(F.col("skills")).alias("skills")
    rows = rows.select("role", "name", "email", F.lit("n/a").alias("note"), "location", skills, "experience", "application_id")
    rows.write.partitionBy("role").options(**store._CSV).csv(path)
    return _listed(store.read_candidates(spark, path, fmt="csv"))


QUERIES = {
    f.__name__: f
    for f in (
        s4_read_candidates, s5_write_candidates, s6_score_column, s7_to_records, v1_cosine, v2_skill_vector,
        v3_train_skill_vectors, v4_embed, v5_word_similarity, v6_empty_side, j3_match, v7_score,
        v7_score_negative_experience, f4_positive_score, k1_rank_filtered, k1_word_similarity, k2_rank_unfiltered,
        k3_by_experience, k4_most_experienced, k4_role_overview, k5_top_matches, k5_shortlists,
        k5_stored_vectors, s4_read_csv_by_name, v3_cooccurrence, v3_learned_vectors, k5_pruned_shortlists,
        k1_to_k5_search, s5_candidate_batches, k3_pages,
    )
}

_LISTED = """SELECT application_id, role, name, email, location, coalesce(array_to_string(skills, '|'), '') AS skills,
  experience FROM candidates"""
_PLACE = """row_number() OVER (PARTITION BY request_id ORDER BY CASE WHEN any_filter THEN score ELSE 0 END DESC,
  experience DESC, coalesce(len(skills), 0) DESC, application_id)"""

ORACLES = {
    # A CSV file does not tell an absent list from an empty one, and neither does the joined text.
    "s4_read_candidates": using("candidates", body=_LISTED + " WHERE role = 'testing'"),
    "s5_write_candidates": using("candidates", body=_LISTED),
    "s6_score_column": using("candidates", body="SELECT application_id, 0::DOUBLE AS score FROM candidates"),
    "s7_to_records": using("candidates", body="""SELECT to_json({application_id: application_id, role: role, name: name,
      email: email, location: location, skills: skills, experience: experience})::VARCHAR AS record FROM candidates"""),
    "v1_cosine": """SELECT a.vec_id, round(100 * list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS raw
      FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
    "v2_skill_vector": using("candidate_vectors", body="""SELECT application_id, round(coalesce(100 * list_cosine_similarity(v,
        embedding::DOUBLE[]), 0), 4) AS raw FROM candidates LEFT JOIN candidate_vectors USING (application_id)
      LEFT JOIN skill_vectors ON skill = skills[1]"""),
    "v3_train_skill_vectors": "SELECT DISTINCT unnest(string_split(p_name, ' ')) AS skill, 16::BIGINT AS dims FROM part",
    "v4_embed": """SELECT doc_id, length(text) || ',' || (length(text) - length(replace(text, ' ', ''))) || ','
      || (length(text) - length(replace(text, 'e', ''))) AS vector FROM documents""",
    "v5_word_similarity": using("candidates", body="""SELECT application_id, round(CASE WHEN coalesce(len(skills), 0) = 0 THEN 0.0
      ELSE 100 * len(list_intersect(skills, ['red', 'gear', 'small'])) / sqrt(3 * len(skills)) END, 4) AS raw FROM candidates"""),
    "v6_empty_side": using("word_scored_forms", body="""SELECT request_id, application_id, 0::DOUBLE AS raw_similarity
      FROM word_scored_forms WHERE coalesce(len(skills), 0) = 0"""),
    "j3_match": using("candidates", "prepared_forms", body="""SELECT request_id, application_id
      FROM candidates c JOIN prepared_forms r ON c.role = r.role WHERE (min_experience <= 0 OR experience >= min_experience)
        AND (wanted_location = '' OR contains(lower(location), wanted_location))"""),
    "v7_score": using("scored_forms", body="SELECT request_id, application_id, score FROM scored_forms"),
    "v7_score_negative_experience": using("candidates", "prepared_forms", body="""SELECT request_id, application_id,
      CASE WHEN experience >= 5 THEN w_experience::DOUBLE ELSE 1.0 END AS score
      FROM candidates c JOIN prepared_forms r ON c.role = r.role WHERE NOT any_filter"""),
    "f4_positive_score": using("scored_forms", body="""SELECT request_id, application_id, score FROM scored_forms
      WHERE NOT any_filter OR score > 0"""),
    "k1_rank_filtered": using("scored_forms", body="""SELECT request_id, application_id, score, experience
      FROM scored_forms WHERE any_filter AND score > 0 ORDER BY ALL"""),
    "k1_word_similarity": using("word_scored_forms", body="""SELECT application_id, name, score, experience
      FROM word_scored_forms WHERE request_id = 1 AND score > 0"""),
    "k2_rank_unfiltered": using("scored_forms", body="SELECT request_id, application_id, experience FROM scored_forms WHERE NOT any_filter"),
    "k3_by_experience": using("candidates", body="SELECT application_id, name, experience FROM candidates WHERE role = 'developer'"),
    "k4_most_experienced": using("candidates", body="""SELECT application_id, name, experience FROM candidates
      WHERE role = 'developer' AND experience > 0 ORDER BY experience DESC, application_id LIMIT 5"""),
    "k4_role_overview": using("candidates", body="""SELECT 'all' AS part, application_id, experience, 0::DOUBLE AS score
      FROM candidates WHERE role = 'testing' UNION ALL (SELECT 'first', application_id, experience, 0 FROM candidates
      WHERE role = 'testing' AND experience > 0 ORDER BY experience DESC, application_id LIMIT 5)"""),
    "k5_top_matches": using("scored_forms", body=f"""SELECT request_id, place, application_id, score FROM (
      SELECT *, {_PLACE} AS place FROM scored_forms WHERE NOT any_filter OR score > 0) WHERE place <= 5"""),
    "s4_read_csv_by_name": using("candidates", body=_LISTED),
    "k5_stored_vectors": using("stored_scored", body=f"""SELECT request_id, place, application_id, name, score,
      coalesce(array_to_string(CASE WHEN application_id % 2 = 1 THEN list_reverse(skills) ELSE skills END, '|'), '') AS skills
      FROM (SELECT *, {_PLACE} AS place FROM stored_scored WHERE NOT any_filter OR score > 0) WHERE place <= 5"""),
    "k5_shortlists": using("scored", body=f"""SELECT request_id, place, application_id, name, score, experience FROM (
      SELECT *, {_PLACE} AS place FROM scored WHERE NOT any_filter OR score > 0) WHERE place <= 5"""),
}
ORACLES["s5_candidate_batches"] = ORACLES["s5_write_candidates"]
ORACLES["k5_pruned_shortlists"] = ORACLES["k5_shortlists"]
ORACLES["v3_cooccurrence"] = using("candidates", body="").rstrip() + """, listed AS (
    SELECT DISTINCT application_id, unnest(list_append(coalesce(skills, []), role)) AS skill FROM candidates),
  counted AS (SELECT a.skill, b.skill AS other, count(*) AS n FROM listed a JOIN listed b
    ON a.application_id = b.application_id AND a.skill <> b.skill GROUP BY ALL)
  SELECT skill, other, n, round(weight, 6) AS weight FROM (SELECT skill, other, n, ln(n * sum(n) OVER ()::DOUBLE
    / (sum(n) OVER (PARTITION BY skill)::DOUBLE * sum(n) OVER (PARTITION BY other))) AS weight FROM counted) WHERE weight > 0"""
ORACLES["v3_learned_vectors"] = using("candidates", body="""SELECT DISTINCT unnest(skills) AS skill, 8::BIGINT AS dims
  FROM candidates WHERE len(skills) > 1""")
ORACLES["k1_to_k5_search"] = using("scored_forms", "candidates", "prepared_forms", body=f"""SELECT 'ranked' AS part, request_id, application_id, experience, score, 0::BIGINT AS place
      FROM scored_forms WHERE NOT any_filter OR score > 0
    UNION ALL SELECT 'listing', request_id, application_id, c.experience, 0, 0 FROM candidates c JOIN prepared_forms r ON c.role = r.role
    UNION ALL SELECT 'top', request_id, application_id, experience, score, place FROM (SELECT *, {_PLACE} AS place
      FROM scored_forms WHERE NOT any_filter OR score > 0) WHERE place <= 5""")
ORACLES["k3_pages"] = using("candidates", body="""SELECT (row_number() OVER (ORDER BY experience DESC NULLS LAST, application_id) - 1) // greatest(1, count(*) OVER () // 9) AS page,
  application_id, name, experience FROM candidates WHERE role = 'developer'""")
