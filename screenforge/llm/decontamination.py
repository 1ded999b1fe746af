"""Benchmark decontamination by a positional inverted index, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from screenforge.llm.common import filled, text_key, without
from screenforge.llm.url_filter import LOWER, UPPER
from screenforge.operators.joins import is_small, lookup_join, spread_join
from screenforge.session import materialize

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
# Rows of a test-side table (terms or anchors, about 50 bytes each) that may be broadcast.
MOST_BROADCAST = 200_000
DOC = ["doc_id", "text_key"]


def words(text: Column) -> Column:
    """Words of a text: A-Z in lower case, then runs of letters a-z, digits and characters above 7F."""
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))


def phrases(items: DataFrame) -> DataFrame:
    """Every word of every different item: item_id, item, n, offset, word, term."""
    rows = items.select(F.col("item_id").cast("string").alias("item_id"), filled("text").alias("text")).distinct()
    rows = rows.select("item_id", F.xxhash64("item_id", "text").alias("item"), words(F.col("text")).alias("words"))
    rows = rows.select("item_id", "item", F.size("words").alias("n"), F.posexplode("words").alias("offset", "word"))
    return rows.withColumn("term", F.xxhash64("word"))


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Stored postings (term, pos, doc_id, text_key) of the words in ``terms`` (word, term) in all documents.

    Words that no test text has are never looked up and not stored. Every document has one more
    posting, of the term of the empty word at the position after its last word: its length.
    """
    end = docs.sparkSession.range(1).select(F.lit("").alias("word"), F.xxhash64(F.lit("")).alias("term"))
    tokens = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        text_key().alias("text_key"),
        F.posexplode(F.concat(words(filled("text")), F.array(F.lit("")))).alias("pos", "word"),
    )
    found = lookup_join(tokens, terms.union(end).distinct(), "word", "inner", MOST_BROADCAST)
    return materialize(found.select("term", "pos", *DOC), "postings")


def document_lengths(index: DataFrame) -> DataFrame:
    """(doc_id, text_key, n_words) of every row that was indexed."""
    return index.filter(F.col("term") == F.xxhash64(F.lit(""))).select(*DOC, F.col("pos").cast("long").alias("n_words"))


def posting_counts(index: DataFrame) -> DataFrame:
    """How many postings each term has in the corpus."""
    return index.groupBy("term").agg(F.count(F.lit(1)).alias("postings"))


def rarest(grams: DataFrame, counts: DataFrame, window: int, ranks: int = 2) -> DataFrame:
    """The ``ranks`` rarest terms of each window of each item: item, need, offset, term.

    ``need`` is the length of the item's windows. Windows with a term without postings are left out.
    """
    need = F.least(F.lit(window), F.col("n"))
    ranked = grams.join(counts, "term", "left").withColumn("need", need)
    ranked = ranked.withColumn("first", F.explode(F.sequence(F.greatest(F.lit(0), F.col("offset") - F.col("need") + 1), F.least("offset", F.col("n") - F.col("need")))))
    own = W.partitionBy("item", "first")
    ranked = ranked.withColumn("absent", F.max(F.col("postings").isNull()).over(own)).withColumn("rank", F.row_number().over(own.orderBy("postings", "offset")))
    return ranked.filter(~F.col("absent") & (F.col("rank") <= ranks)).select("item", "need", "offset", "term").distinct()


def intersected(index: DataFrame, anchors: DataFrame) -> DataFrame:
    """Where two of the rarest terms stand as in the item: (doc_id, text_key, item, diagonal).

    The diagonal is the position minus the term's offset in the item: the offset-adjusted list. A
    window can only occur on a diagonal that has the two rarest of its terms (or its only one).
    """
    lists = spread_join(index, anchors, "term", "doc_id", MOST_BROADCAST)
    lists = lists.groupBy(*DOC, "item", "need", (F.col("pos") - F.col("offset")).alias("diagonal"))
    lists = lists.agg(F.min("offset").alias("low"), F.max("offset").alias("high"))
    return lists.filter((F.col("low") < F.col("high")) | (F.col("need") == 1)).select(*DOC, "item", "need", "diagonal")


def phrase_matches(index: DataFrame, grams: DataFrame, window: int = WINDOW) -> DataFrame:
    """Maximal exact runs of item words that hold a window: doc_id, text_key, item_id, begin, end (inclusive).

    After the rarest terms, the postings of all other terms on the surviving diagonals are
    intersected, and runs of ``window`` neighbouring offsets (or of the whole item) are kept.
    """
    anchors = rarest(grams, posting_counts(index), window)
    survivors = materialize(intersected(index, anchors), "diagonals")
    asked = lookup_join_many(survivors, grams.select("item", "item_id", "offset", "term"))
    asked = asked.withColumn("pos", F.col("diagonal") + F.col("offset")).filter("pos >= 0")
    held = survivors.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_text")).distinct()
    own = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_text"))
    own_postings = index.join(F.broadcast(held) if is_small(held, MOST_BROADCAST) else held, own, "left_semi")
    own_postings = own_postings.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_text"), F.col("pos").alias("_pos"), F.col("term").alias("_term"))
    met = asked.join(own_postings, own & (F.col("pos") == F.col("_pos")) & (F.col("term") == F.col("_term")), "left_semi")
    line = W.partitionBy(*DOC, "item", "item_id", "diagonal")
    runs = met.withColumn("run", F.col("offset") - F.dense_rank().over(line.orderBy("offset")))
    runs = runs.groupBy(*DOC, "item", "item_id", "diagonal", "run").agg(F.min("pos").alias("begin"), F.max("pos").alias("end"), F.max("need").alias("need"))
    return runs.filter(F.col("end") - F.col("begin") + 1 >= F.col("need")).select(*DOC, "item_id", "begin", "end")


def lookup_join_many(survivors: DataFrame, grams: DataFrame) -> DataFrame:
    """All words of the item of each surviving diagonal."""
    return spread_join(survivors, grams, "item", "doc_id", MOST_BROADCAST)


def proximity_matches(index: DataFrame, grams: DataFrame, span: int) -> DataFrame:
    """Stretches of ``span`` words that hold every word of an item in any order: doc_id, text_key, item_id, begin.

    Starts from the postings of the item's rarest term. Postings of its other terms meet them by
    document and by blocks of ``span`` positions, so only neighbours are compared. ``begin`` is the
    first position of each such stretch that starts at a word of the item.
    """
    wanted = grams.groupBy("item", "item_id").agg(F.count_distinct("term").alias("n_terms"))
    ranked = grams.select("item", "item_id", "term").distinct().join(posting_counts(index), "term", "left")
    own = W.partitionBy("item", "item_id").orderBy(F.col("postings").asc_nulls_first(), "term")
    first = ranked.withColumn("rank", F.row_number().over(own)).filter("rank = 1").select("item", "item_id", "term").join(wanted, ["item", "item_id"])
    anchors = spread_join(index, first, "term", "doc_id", MOST_BROADCAST).select(*DOC, "item", "item_id", "n_terms", F.col("pos").alias("at"))
    anchors = anchors.withColumn("block", F.explode(F.sequence(F.floor((F.col("at") - span + 1) / span), F.floor((F.col("at") + span - 1) / span))))
    others = spread_join(index, grams.select("item", "item_id", "term").distinct(), "term", "doc_id", MOST_BROADCAST)
    others = others.withColumn("block", F.floor(F.col("pos") / span)).withColumnRenamed("doc_id", "_id")
    pairs = anchors.join(others, ["text_key", "item", "item_id", "block"]).filter(F.col("doc_id").eqNullSafe(F.col("_id")) & (F.abs(F.col("pos") - F.col("at")) < span))
    frame = W.partitionBy(*DOC, "item", "item_id", "at").orderBy("pos").rangeBetween(0, span - 1)
    full = pairs.withColumn("n", F.size(F.collect_set("term").over(frame)))
    full = full.filter((F.col("n") == F.col("n_terms")) & (F.col("pos") <= F.col("at")))
    return full.select(*DOC, "item_id", F.col("pos").alias("begin")).distinct()


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, text_key of every row.

    An item's windows are ``window`` neighbouring words, or all of its words if it has fewer; a
    word of a document inside any occurrence of a window is hit. Null and empty texts have no words
    and are not contaminated; an item without words has no window. Items that repeat count once per
    item_id; an item without an id hits words but is neither counted nor listed. Repeated documents
    get equal rows; a null doc_id stays null; other columns are not looked at. Without items nothing is
    hit; an empty table of documents gives no rows.
    """
    grams = materialize(phrases(items), "grams")
    index = build_index(docs, grams.select("word", "term").distinct())
    runs = phrase_matches(index, grams, window).distinct()
    before = F.max("end").over(W.partitionBy(*DOC).orderBy("begin", "end").rowsBetween(W.unboundedPreceding, -1))
    new = F.col("end") - F.greatest(F.col("begin"), F.coalesce(before + 1, F.col("begin"))) + 1
    hits = runs.withColumn("new", F.greatest(F.lit(0), new)).groupBy(*DOC).agg(F.sum("new").alias("n_hit"), F.collect_set("item_id").alias("items"))
    hits = hits.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_text"), "n_hit", "items")
    rows = document_lengths(index).join(hits, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_text")), "left")
    items_found = F.coalesce("items", F.array().cast("array<string>"))
    return rows.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(items_found).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(items_found), ","), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
        "text_key",
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` in which no window of an item occurs, with all columns."""
    return without(docs, materialize(contamination(docs, items, window).filter("contaminated").select(*DOC), "contaminated"))
