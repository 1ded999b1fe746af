"""The derived tables of ``fixtures`` in DuckDB's SQL, as named parts of a WITH clause."""

from __future__ import annotations

from checks import fixtures as fx

_WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip(c: str) -> str:
    return rf"regexp_replace({c}, '\A{_WS}+|{_WS}+\z', '', 'g')"


def experience(c: str) -> str:
    s = f"lower({strip(c)})"
    numbers = rf"regexp_extract_all({s}, '\d+\.?\d*')"
    return f"""CASE WHEN {c} IS NULL OR {s} IN ('', 'nan', 'none', 'fresher', 'freshers', 'n/a', '-')
        OR len({numbers}) = 0 THEN 0.0
      WHEN contains({s}, 'month') AND len({numbers}) >= 2
        THEN round({numbers}[1]::DOUBLE + {numbers}[2]::DOUBLE / 12, 2)
      ELSE round({numbers}[1]::DOUBLE, 2) END"""


def role(c: str) -> str:
    return f"CASE WHEN lower({c}) = 'qa' THEN 'testing' ELSE lower({c}) END"


def email_key(c: str) -> str:
    return f"nullif(lower({strip(c)}), '')"


def present(c: str) -> str:
    return f"list_filter(list_transform(coalesce({c}, []), lambda x: lower({strip('x')})), lambda x: x <> '')"


def split_skills(c: str) -> str:
    return f"""CASE WHEN {strip(c)} = '' THEN []::VARCHAR[]
      ELSE list_transform(string_split({c}, ','), lambda x: lower({strip('x')})) END"""


def title(c: str) -> str:
    return rf"""array_to_string(list_transform(regexp_extract_all({c}, '\p{{L}}+|[^\p{{L}}]+'),
      lambda r: upper(r[1:1]) || lower(r[2:])), '')"""


# The weights of the roles.
_WEIGHTS = {
    "w_skills": {"datascience": 60, "developer": 50, "testing": 40, "data_engineer": 60, "cloud_engineer": 70, "hr": 30},
    "w_experience": {"datascience": 25, "developer": 30, "testing": 40, "data_engineer": 30, "cloud_engineer": 20, "hr": 40},
    "w_location": {"datascience": 15, "developer": 20, "testing": 20, "data_engineer": 10, "cloud_engineer": 10, "hr": 30},
}
_DEFAULTS = {"w_skills": 50, "w_experience": 30, "w_location": 20}


def weights() -> str:
    return ", ".join(
        "CASE role " + " ".join(f"WHEN '{r}' THEN {w}" for r, w in by_role.items()) + f" ELSE {_DEFAULTS[c]} END AS {c}"
        for c, by_role in _WEIGHTS.items()
    )


def _prepared(source: str) -> str:
    return f"""SELECT *, {weights()} FROM (
      SELECT request_id, {role('role')} AS role, {present(split_skills('skills'))} AS job_skills,
        experience AS min_experience, lower(location) AS wanted_location,
        (len({present(split_skills('skills'))}) > 0 OR experience <> 0 OR location <> '') AS any_filter
      FROM {source})"""


def _scored(requests: str, raw: str) -> str:
    return f"""SELECT *, CASE WHEN len(job_skills) > 0 AND raw < 15 THEN 0.0
        WHEN len(job_skills) = 0 AND points = 0 THEN 1.0 ELSE round(points, 2) END AS score
      FROM (SELECT *, raw * w_skills / 100
          + CASE WHEN experience >= min_experience THEN w_experience ELSE 0 END
          + CASE WHEN wanted_location <> '' AND coalesce(contains(lower(location), wanted_location), false)
              THEN w_location ELSE 0 END AS points
        FROM (SELECT c.*, r.* EXCLUDE (role),
            CASE WHEN len(job_skills) > 0 THEN coalesce({raw}, 0.0) ELSE 0.0 END AS raw
          FROM candidates c JOIN {requests} r ON c.role = r.role
          WHERE (min_experience <= 0 OR experience >= min_experience)
            AND (wanted_location = '' OR contains(lower(location), wanted_location))))"""


def _summed(ids: str, skills: str, source: str) -> str:
    return f"""SELECT {ids}, list(total ORDER BY pos) AS v FROM (
      SELECT {ids}, pos, sum(x) AS total FROM (
        SELECT {ids}, generate_subscripts(embedding, 1) AS pos, unnest(embedding)::DOUBLE AS x
        FROM (SELECT {ids}, unnest({skills}) AS skill FROM {source}) JOIN skill_vectors USING (skill))
      GROUP BY {ids}, pos) GROUP BY {ids}"""


WORD_RAW = """CASE WHEN len(list_distinct(skills)) = 0 OR len(list_distinct(job_skills)) = 0 THEN 0.0
  ELSE 100 * len(list_intersect(skills, job_skills))
    / sqrt(len(list_distinct(skills)) * len(list_distinct(job_skills))) END"""
VECTOR_RAW = """(SELECT 100 * list_cosine_similarity(cv.v, jv.v) FROM candidate_vectors cv, {jobs} jv
  WHERE cv.application_id = c.application_id AND jv.request_id = r.request_id)"""

PARTS = {
    "applications": f"""SELECT o_orderkey AS application_id, o_orderdate AS applied_at, {fx.ROLE_RAW} AS role_raw,
        {fx.NAME} AS name, {fx.EMAIL} AS email, NULL::VARCHAR AS phone, {fx.LOCATION} AS location, skills,
        {fx.EXPERIENCE_RAW} AS experience_raw
      FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
      LEFT JOIN (SELECT l_orderkey, list_sort(list(DISTINCT word)) AS skills
        FROM (SELECT l_orderkey, unnest(string_split(p_name, ' ')) AS word
          FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY l_orderkey) ON o_orderkey = l_orderkey""",
    "cleaned": f"""SELECT application_id, applied_at, {role('role_raw')} AS role, name, email, phone, location, skills,
        {experience('experience_raw')} AS experience, {email_key('email')} AS email_key
      FROM applications WHERE name IS NOT NULL AND name NOT IN ('', 'nan')""",
    "candidates": """SELECT * EXCLUDE (place) FROM (SELECT *, row_number() OVER (
        PARTITION BY role, coalesce(email_key, ' ' || application_id) ORDER BY applied_at, application_id) AS place
      FROM cleaned) WHERE place = 1""",
    "job_requests": f"""SELECT s_suppkey AS request_id, {fx.REQUEST_ROLE} AS role, {fx.REQUEST_SKILLS} AS skills,
        {fx.REQUEST_EXPERIENCE} AS experience, {fx.REQUEST_LOCATION} AS location
      FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN part ON s_suppkey = p_partkey""",
    "form_requests": "SELECT * FROM (VALUES "
    + ", ".join(f"({i}::BIGINT, '{r}', '{s}', {e}::DOUBLE, '{p}')" for i, r, s, e, p in fx.FORM_REQUESTS)
    + ") AS t(request_id, role, skills, experience, location)",
    "prepared": _prepared("job_requests"),
    "prepared_forms": _prepared("form_requests"),
    "skill_vectors": f"""SELECT skill, embedding FROM (SELECT skill, row_number() OVER (ORDER BY skill) - 1 AS number
        FROM (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS skill FROM part))
      JOIN embeddings ON vec_id = {fx.SKILL_VECTOR_ID}""",
    # Stored vectors that depend on the order of the skills: that of the first one, for odd ids of the last one.
    "stored_vectors": """SELECT application_id, embedding::DOUBLE[] AS v FROM candidates
      JOIN skill_vectors ON skill = skills[CASE WHEN application_id % 2 = 1 THEN len(skills) ELSE 1 END]""",
    "candidate_vectors": _summed("application_id", "skills", "candidates"),
    "job_vectors": _summed("request_id", "job_skills", "prepared"),
    "form_vectors": _summed("request_id", "job_skills", "prepared_forms"),
    "word_scored_forms": _scored("prepared_forms", WORD_RAW),
    "scored_forms": _scored("prepared_forms", VECTOR_RAW.format(jobs="form_vectors")),
    "scored": _scored("prepared", VECTOR_RAW.format(jobs="job_vectors")),
    "stored_scored": _scored("prepared", VECTOR_RAW.format(jobs="job_vectors").replace("candidate_vectors", "stored_vectors")),
    "mail_requests": f"""SELECT o_orderkey AS request_id,
        list_transform(numbers, lambda n: CASE WHEN n % 9 = 0 THEN 'no-address-' || n WHEN n % 31 = 0 THEN NULL
          ELSE 'contact' || n || '@mail.example' END) AS emails,
        CASE WHEN o_orderkey % 3 = 0 THEN names[1:len(names) - 1] ELSE names END AS names, {fx.MAIL_ROLE} AS role,
        CASE WHEN o_orderkey % 50 = 0 THEN '2025-13-45' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date,
        {fx.MAIL_TIME} AS time, {fx.MAIL_VENUE} AS venue
      FROM (SELECT *, list_transform(numbers, lambda n: 'Contact & ' || n) AS names
        FROM (SELECT *, list_transform(range(0, o_orderkey % 6 + 1), lambda i: (o_orderkey * 7 + i * 13) % 1000) AS numbers
          FROM orders))""",
    # Months of the jobs a work history lists, from the dates it was made of.
    "histories": """SELECT o_orderkey, c_name, c_mktsegment, n_name, round((
        CASE WHEN o_orderkey % 2 <> 0 THEN o_orderkey % 60 + 1 ELSE 0 END
        + CASE WHEN o_orderkey % 3 <> 0 THEN (2026 - year(o_orderdate)) * 12 + 4 - month(o_orderdate) ELSE 0 END
        + CASE WHEN o_orderkey % 5 <> 0 THEN (2026 - year(o_orderdate)) * 12 ELSE 0 END
        + CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 11 * 12 + o_orderkey % 12 ELSE 0 END)::DOUBLE / 12, 2) AS years
      FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "mail_checked": r"""SELECT *, strftime(try_strptime(date, '%Y-%m-%d'), '%A, %d %B %Y') AS long_date,
        strftime(try_strptime('2000-01-01 ' || time, '%Y-%m-%d %H:%M'), '%I:%M %p') AS long_time
      FROM mail_requests""",
    "recipients": """SELECT request_id, role, date, time, venue, long_date, long_time, i - 1 AS position,
        emails[i] AS email, names[i] AS name
      FROM (SELECT *, unnest(range(1, least(len(emails), len(names)) + 1)) AS i FROM mail_checked)""",
    "outbox": f"""SELECT *, CASE WHEN coalesce(contains(email, '@'), false) THEN 'ready' ELSE 'failed' END AS status,
        coalesce(nullif(venue, ''), '1 Example Street, Exampletown') AS place, {title('role')} AS titled
      FROM recipients WHERE long_date IS NOT NULL AND long_time IS NOT NULL""",
}

_NEEDS = {
    "cleaned": ["applications"],
    "candidates": ["cleaned"],
    "prepared": ["job_requests"],
    "prepared_forms": ["form_requests"],
    "candidate_vectors": ["candidates", "skill_vectors"],
    "job_vectors": ["prepared", "skill_vectors"],
    "form_vectors": ["prepared_forms", "skill_vectors"],
    "word_scored_forms": ["candidates", "prepared_forms"],
    "scored_forms": ["candidates", "prepared_forms", "candidate_vectors", "form_vectors"],
    "scored": ["candidates", "prepared", "candidate_vectors", "job_vectors"],
    "stored_vectors": ["candidates", "skill_vectors"],
    "stored_scored": ["candidates", "prepared", "stored_vectors", "job_vectors"],
    "mail_checked": ["mail_requests"],
    "recipients": ["mail_checked"],
    "outbox": ["recipients"],
}


def using(*parts: str, body: str) -> str:
    """``body`` after a WITH clause of ``parts`` and all they need."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, []):
            add(need)
        if name not in ordered:
            ordered.append(name)

    for part in parts:
        add(part)
    named = ",\n".join(f"{name} AS MATERIALIZED ({PARTS[name]})" for name in ordered)
    return f"WITH {named}\n{body}"
