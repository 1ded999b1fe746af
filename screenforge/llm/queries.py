"""The registered queries of the operators, over whole tables, and SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from screenforge.llm.collocations import collocations
from screenforge.llm.decontamination import contamination
from screenforge.llm.exact_dedup import exact_groups
from screenforge.llm.html_extraction import extract
from screenforge.llm.language_id import identify
from screenforge.llm.mixing import mixed_sources
from screenforge.llm.near_dedup import near_groups
from screenforge.llm.quality import quality
from screenforge.llm.secret_scan import scan
from screenforge.llm.sentencepiece_bpe import encode_and_decode
from screenforge.llm.token_alignment import alignment
from screenforge.llm.toxicity import toxicity
from screenforge.llm import url_filter
from screenforge.llm.url_filter import judge


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("text_key")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(_table(spark, sf_dir, "documents")).drop("found")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(_table(spark, sf_dir, "pages"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_table(spark, sf_dir, "pages"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(_table(spark, sf_dir, "documents")).drop("text_key")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(_table(spark, sf_dir, "documents")).drop("text_key")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_decode(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).drop("text_key")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_sources(_table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_secret_scan": op2_secret_scan,
    "op3_url_filter": op3_url_filter,
    "op4_html_extraction": op4_html_extraction,
    "op5_near_dedup": op5_near_dedup,
    "op6_quality": op6_quality,
    "op7_language_id": op7_language_id,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_toxicity": op10_toxicity,
    "op11_collocations": op11_collocations,
    "op12_mixing": op12_mixing,
    "op13_token_alignment": op13_token_alignment,
}

ORACLES = {
    "op1_decontamination": r"""
WITH item_words AS (
    SELECT DISTINCT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM benchmark
),
windows AS (
    SELECT DISTINCT item_id, words[i : i + least(10, len(words)) - 1] AS gram
    FROM (SELECT *, unnest(range(1, len(words) - least(10, len(words)) + 2)) AS i FROM item_words WHERE len(words) > 0)
),
doc_words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM documents
),
sizes AS (SELECT DISTINCT len(gram) AS size FROM windows),
found AS (
    SELECT g.doc_id, w.item_id, g.i, g.size
    FROM (
        SELECT doc_id, i, size, words[i : i + size - 1] AS gram
        FROM (SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS i FROM doc_words CROSS JOIN sizes WHERE len(words) >= size)
    ) g JOIN windows w ON g.gram = w.gram
),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM found) GROUP BY doc_id),
listed AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hits USING (doc_id) LEFT JOIN listed USING (doc_id)
""",
    "op3_url_filter": r"""
WITH rests AS (
    SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
),
parts AS (
    SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM rests
),
ruled AS (
    SELECT *, CASE
        WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
        WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/'
    END AS rule
    FROM parts
)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
    WHEN (path = '' OR starts_with(path, '/')) AND len(list_filter([HOST_WORDS], lambda w: contains(host, w))) > 0 THEN 'block'
    WHEN len(list_filter([SEGMENTS], lambda w: contains(path || '/', '/' || w || '/'))) > 0 THEN 'block'
    WHEN len(list_filter([FILES], lambda w: ends_with(path, '/' || w))) > 0 THEN 'block'
    WHEN starts_with(path, '/') AND len(list_filter([ENDINGS], lambda w: ends_with(path, '.' || w))) > 0 THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
""",
    "op8_exact_dedup": """
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256
FROM (
    SELECT doc_id, body, max(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size
    FROM (SELECT doc_id, coalesce(text, '') AS body FROM documents)
)
""",
    "op11_collocations": r"""
WITH pieces AS (
    SELECT lang, string_split_regex(body, '[.,;:!?\x0A-\x0D]') AS pieces
    FROM (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents)
),
word_lists AS (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM (SELECT lang, unnest(pieces) AS piece FROM pieces)
),
grams AS (
    SELECT lang, words[i : i + size - 1] AS phrase
    FROM (SELECT *, unnest(range(1, len(words) - size + 2)) AS i FROM (SELECT *, unnest([1, 2, 3]) AS size FROM word_lists) WHERE len(words) >= size)
),
counts AS (SELECT lang, phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f) AS n FROM counts WHERE len(phrase) = 1 GROUP BY lang),
candidates AS (SELECT lang, phrase, f AS a FROM counts WHERE len(phrase) > 1 AND f >= 10),
cuts AS (
    SELECT c.lang, c.phrase, c.a, k, x.f AS l, y.f AS r,
           (1000000 * CAST(c.a AS HUGEINT) * c.a) // (CAST(x.f AS HUGEINT) * y.f) AS score
    FROM (SELECT *, unnest(range(1, len(phrase))) AS k FROM candidates) c
    JOIN counts x ON x.lang = c.lang AND x.phrase = c.phrase[1 : k]
    JOIN counts y ON y.lang = c.lang AND y.phrase = c.phrase[k + 1 : len(c.phrase)]
),
weakest AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM cuts) WHERE place = 1
),
around AS (
    SELECT lang, phrase, max(a) AS longer
    FROM (SELECT lang, unnest([phrase[1:2], phrase[2:3]]) AS phrase, a FROM candidates WHERE len(phrase) = 3) GROUP BY ALL
),
ranked AS (
    SELECT w.lang, array_to_string(w.phrase, ' ') AS phrase, w.a, l, r, score,
           row_number() OVER (PARTITION BY w.lang ORDER BY score DESC, w.a DESC, encode(array_to_string(w.phrase, ' '))) AS place
    FROM weakest w LEFT JOIN around b ON b.lang = w.lang AND b.phrase = w.phrase
    WHERE longer IS NULL OR 100 * longer < 50 * w.a
)
SELECT lang, CAST(place AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
       CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked JOIN totals USING (lang) WHERE place <= 2000
""",
    "op12_mixing": r"""
WITH sized AS (
    SELECT doc_id, source, CAST(len(regexp_extract_all(body, '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
           md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(body)) AS place
    FROM (SELECT doc_id, source, coalesce(text, '') AS body FROM documents)
),
sources AS (
    SELECT source, source_size, [3, 1, 2][1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3] AS w, sum(source_size) OVER () AS total
    FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source)
),
filled AS (
    SELECT *, (3 * total - 2 * coalesce(sum(2 * source_size) OVER (ORDER BY source_size * 6 / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * w
              >= 4 * source_size * sum(w) OVER (ORDER BY source_size * 6 / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS full_
    FROM sources
),
stopped AS (SELECT *, bool_and(full_) OVER (ORDER BY source_size * 6 / w, source ROWS UNBOUNDED PRECEDING) AS at_limit FROM filled),
shares AS (
    SELECT source, source_size, at_limit,
           CASE WHEN at_limit THEN 2 * source_size ELSE (3 * total - 4 * coalesce(sum(source_size) FILTER (at_limit) OVER (), 0)) * w END AS above,
           CASE WHEN at_limit THEN 1 ELSE 2 * sum(w) FILTER (NOT at_limit) OVER () END AS below
    FROM stopped
),
targets AS (
    SELECT source, source_size, CAST(above AS DOUBLE) / CAST(below AS DOUBLE) AS target,
           CASE WHEN source_size > 0 THEN (above // below) // source_size ELSE 0 END AS whole,
           CASE WHEN source_size > 0 THEN (above // below) % source_size ELSE 0 END AS rest
    FROM shares
),
placed AS (
    SELECT doc_id, size, source_size, target, whole, rest, sum(size) OVER (PARTITION BY s.source ORDER BY place) AS upto,
           sum(size) OVER (PARTITION BY s.source, place) AS here, count(*) OVER (PARTITION BY s.source, place) AS n
    FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(whole * size + CASE WHEN rest >= upto THEN size WHEN rest <= upto - here THEN 0 ELSE (rest - (upto - here)) // n END AS BIGINT) AS taken
FROM placed
""",
}
for _name in ("HOST_WORDS", "SEGMENTS", "FILES", "ENDINGS"):
    ORACLES["op3_url_filter"] = ORACLES["op3_url_filter"].replace(f"[{_name}]", str(list(getattr(url_filter, _name))))
