"""Resume text to structured fields: prompts, model calls in order, parsed replies, rules."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenforge.constants import QUOTA_WORDS
from screenforge.functions.contacts import (
    contact_email,
    contact_location,
    contact_name,
    contact_phone,
    listed_skills,
)
from screenforge.functions.experience import work_history_years
from screenforge.functions.literals import parse_list_literal
from screenforge.functions.replies import clean_json, number_in_reply, parse_reply
from screenforge.operators.joins import attach, is_small, may_match, shuffle_width
from screenforge.session import materialize

EXHAUSTED = "every model is over its quota"

# A model is a function from the prompt column to a struct (reply, error). It runs as an Arrow
# batch function; null prompts give null.
Model = Callable[[Column], Column]


def _span(years: float) -> str:
    return f"{years:g}"


def prompt_rules(as_of: dt.date) -> str:
    """What a model is asked to do with the resume that follows. Examples count from ``as_of``."""
    start = dt.date(as_of.year - 4, 9, 1)
    running = round((as_of.year - start.year) + (as_of.month - start.month) / 12, 2)
    return "\n".join(
        [
            "You turn an applicant's resume into one JSON object and write nothing besides it.",
            "",
            "experience: a number, the years worked. Take every position of the employment section, work out its length, and add all lengths.",
            f"  Reckon with {as_of:%B %Y} as the present month; a position begun in {start:%B %Y} and still held has {_span(running)}.",
            "  From Feb 2015 to Jan 2017 is 2; a position described as '4 years 3 months' has 4.25; '7+ years' has 7.",
            "  What the applicant says about total experience elsewhere is no position. Without an employment section write 0.",
            "skills: a list of strings, one skill in each, not nested.",
            "location: the town or region where the applicant lives; null if the resume has none.",
            "name, phone, email: strings, as the applicant writes them at the top.",
            "",
            "The resume:",
            "",
        ]
    )


def build_prompts(docs: DataFrame, as_of: dt.date) -> DataFrame:
    """Add ``prompt``, one per resume text."""
    return docs.withColumn("prompt", F.concat(F.lit(prompt_rules(as_of)), F.coalesce(F.col("text"), F.lit(""))))


def is_quota_error(error: Column) -> Column:
    """Errors after which the next model is tried."""
    message = F.lower(error)
    return F.coalesce(F.contains(message, F.lit(QUOTA_WORDS[0])) | F.contains(message, F.lit(QUOTA_WORDS[1])), F.lit(False))


def fallback_chain(df: DataFrame, models: list[tuple[str, Model]], prompt: str = "prompt") -> DataFrame:
    """Ask the models in order; add ``model``, ``reply`` and ``error``.

    Only rows that met a quota error go on to the next model; any other error ends a row's chain.
    Rows that met one at every model end with :data:`EXHAUSTED`. Each stage is written to the
    shared scratch folder, so that no call is repeated when an executor is lost.
    """
    pending, finished = df, []
    for name, model in models:
        asked = pending.withColumn("_answer", model(F.col(prompt))).select(
            *df.columns, F.lit(name).alias("model"), F.col("_answer.reply").alias("reply"), F.col("_answer.error").alias("error")
        )
        stage = materialize(asked, "model-replies")
        over = is_quota_error(F.col("error"))
        finished.append(stage.where(~over))
        pending = stage.where(over).select(*df.columns)
        if pending.isEmpty():
            break
    left = pending.select(
        *df.columns,
        F.lit(None).cast("string").alias("model"),
        F.lit(None).cast("string").alias("reply"),
        F.lit(EXHAUSTED).alias("error"),
    )
    out = left
    for stage in finished:
        out = out.unionByName(stage)
    return out


def parse_replies(replies: DataFrame) -> DataFrame:
    """Add name, email, phone, location, skills (array), experience (text) and error of ``reply``, and
    experience_number where the experience is a number and not text."""
    cleaned = clean_json(F.col("reply"))
    parsed = replies.withColumn("_r", parse_reply(cleaned))
    fields = {f: F.col(f"_r.{f}") for f in ("name", "email", "phone", "location", "experience")}
    error = F.col("_r.error")
    if "error" in replies.columns:
        error = F.coalesce(F.col("error"), error)
    return parsed.withColumns(
        {
            **fields,
            "skills": parse_list_literal(F.col("_r.skills")),
            "error": error,
            "experience_number": F.when(F.col("_r.experience").isNotNull(), number_in_reply(cleaned, "experience")),
        }
    ).drop("_r")


def extract_contacts(docs: DataFrame) -> DataFrame:
    """Add name, email, phone and location read by rule."""
    text = F.col("text")
    return docs.withColumns(
        {
            "name": contact_name(text),
            "email": contact_email(text),
            "phone": contact_phone(text),
            "location": contact_location(text),
        }
    )


def _words(text: Column) -> Column:
    """Words in lower case, in order. Letters and digits of every language, plus and number signs belong to a
    word, and full stops inside it (node.js)."""
    bare = F.regexp_replace(F.lower(text), r"\.+([^\p{L}\p{N}]|\z)", " ")
    return F.filter(F.split(bare, r"[^\p{L}\p{N}+#.]+"), lambda w: w != "")


def anchored(dictionary: DataFrame) -> DataFrame:
    """(anchor, entries): the dictionary's entries (``skill``, ``words``, ``before``) under the rarest word of each.

    Rarest is the word that stands in the fewest entries, of equals the longest; ``before`` is the number of words
    in front of it. Equal entries are one.
    """
    listed = dictionary.select(_words(F.col("skill")).alias("words")).where(F.cardinality("words") > 0).distinct()
    placed = listed.select(F.array_join("words", " ").alias("skill"), "words", F.posexplode("words").alias("before", "anchor"))
    spread = F.pmod(F.xxhash64("skill", "before"), F.lit(shuffle_width(dictionary.sparkSession)))
    placed = attach(placed, placed.groupBy("anchor").agg(F.count(F.lit(1)).alias("_often")), ["anchor"], spread)
    best = F.min(F.struct("_often", -F.length("anchor"), "before", "anchor")).alias("_best")
    return placed.groupBy("skill", "words").agg(best).select(F.col("_best.anchor").alias("anchor"), "skill", "words", F.col("_best.before").alias("before"))


def skill_hits(docs: DataFrame, dictionary: DataFrame, max_broadcast: int = 100_000) -> DataFrame:
    """(doc_id, skill): an entry of the dictionary per place where it stands in the text.

    Every entry is looked for at its rarest word alone, and its other words are compared at that place; so rows
    follow the places of anchors, whatever the length of entries. Within ``max_broadcast`` entries the comparison
    happens where the text lies. A larger dictionary is joined by salted anchors: words that cannot be one are left where
    they lie, and only what needs a comparison is brought to the words of its document.
    """
    anchors = anchored(dictionary)
    tokens = docs.select("doc_id", _words(F.col("text")).alias("_words"))
    first = F.col("_at") - F.col("before")
    same = (first >= 0) & (F.slice("_words", F.greatest(first, F.lit(0)) + 1, F.size("words")) == F.col("words"))
    if is_small(anchors, max_broadcast):
        places = tokens.select("doc_id", "_words", F.posexplode("_words").alias("_at", "anchor"))
        return places.join(F.broadcast(anchors), "anchor").where((F.size("words") == 1) | same).select("doc_id", "skill")
    tokens = materialize(tokens, "words")
    anchors = materialize(anchors, "anchors")
    places = may_match(tokens.select("doc_id", F.posexplode("_words").alias("_at", "anchor")), anchors, "anchor")
    single = anchors.where("size(words) = 1").select("anchor", "skill")
    longer = anchors.where("size(words) > 1").select("anchor", "skill", "words", "before")
    salt = F.pmod(F.xxhash64("doc_id", "_at"), F.lit(shuffle_width(docs.sparkSession)))
    hits = attach(places.select("doc_id", F.col("anchor"), "_at"), single, ["anchor"], salt).where("skill IS NOT NULL").select("doc_id", "skill")
    open_ = attach(places, longer, ["anchor"], salt).where("skill IS NOT NULL")
    compared = open_.join(tokens, "doc_id").where(same).select("doc_id", "skill")
    return hits.unionByName(compared)


def extract_skills(docs: DataFrame, dictionary: DataFrame, max_broadcast: int = 100_000) -> DataFrame:
    """``doc_id`` and ``skills``: the sorted distinct entries of the dictionary (``skill``) that stand in the text.

    An entry of several words is found where its words follow each other. Only hits are shuffled, and the text
    is not carried along; documents without any hit are brought back by their id.
    """
    found = skill_hits(docs, dictionary, max_broadcast)
    hits = found.groupBy("doc_id").agg(F.sort_array(F.collect_set("skill")).alias("skills"))
    every = docs.select("doc_id").distinct().join(hits, "doc_id", "left")
    return every.select("doc_id", F.coalesce("skills", F.array().cast("array<string>")).alias("skills"))


def extract_fields(docs: DataFrame, as_of: dt.date) -> DataFrame:
    """Structured fields by rule alone, for texts no model is asked about."""
    return extract_contacts(docs).withColumns(
        {
            "skills": listed_skills(F.col("text")),
            "experience": work_history_years(F.col("text"), as_of),
        }
    )
