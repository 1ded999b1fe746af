"""Toxicity by subword-bag embeddings that are averaged into a linear softmax, trained in numpy."""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenforge.llm.common import bound_batches, chunks, filled, freeing, is_held_out, mixed, ragged, text_key, without
from screenforge.llm.word_hashing import prefix_sums, word_spans
from screenforge.session import materialize

BUCKETS, DIMENSIONS = 1 << 18, 8
# Lengths in bytes of the n-grams of a word, with a mark before and after it.
GRAMS = (3, 4, 5, 6)
# A bag: so many neighbouring words, a new one every STRIDE words.
BAG, STRIDE = 12, 6
THRESHOLD = 0.5
# The classifier is fitted on a sample of labelled rows: at most so many of each class, and so many bytes of text.
SAMPLE_ROWS, SAMPLE_BYTES = 2_000, 8 << 20
# Texts are scored so many bytes at a time: a spelling's subwords take some hundred bytes each.
SCORED_BYTES = 1 << 18
# Subwords of fewer documents of the sample tell nothing.
MIN_DOCUMENTS = 8
# Of the text a bag may be made of: letters, digits, characters above 7F.
BETWEEN = ~np.array([chr(b).isalnum() or b > 127 for b in range(256)])


def subwords(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of several texts in lower case: the number of each word's spelling, how many words each text has,
    the buckets of all spellings' subwords one after the other, how many each spelling has, and its hash."""
    begin, end, number = word_spans(data, offsets, BETWEEN)
    sums, down = prefix_sums(data)
    spelling, at, which = np.unique((sums[end] - sums[begin]) * down[begin], return_index=True, return_inverse=True)
    size = end[at] - begin[at]
    marked = np.full(int((size + 2).sum()), 60, np.uint8)
    last = np.cumsum(size + 2)
    first = last - size - 2
    marked[last - 1] = 62
    marked[ragged(first + 1, size)] = data[ragged(begin[at], size)]
    sums, down = prefix_sums(marked)
    parts, owners = [], []
    for n in (*GRAMS, 0):  # 0: the whole word
        count = np.maximum(size + 2 - n + 1, 0) if n else np.ones(len(size), np.int64)
        start = ragged(first, count)
        stop = start + n if n else last
        parts.append(mixed((sums[stop] - sums[start]) * down[start] + mixed(np.full(1, n))) % np.uint64(BUCKETS))
        owners.append(np.repeat(np.arange(len(size)), count))
    owner = np.concatenate(owners)
    by = np.argsort(owner, kind="stable")
    return which, number, np.concatenate(parts)[by].astype(np.int32), np.bincount(owner, minlength=len(size)), spelling


def sampled_subwords(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The first four results of :func:`subwords` for a whole sample, hashed a piece at a time."""
    column = pa.array([t.lower() for t in texts], pa.large_string())
    pieces = [subwords(data, offsets) for _, _, data, offsets in chunks(column, SCORED_BYTES)]
    spelling = np.concatenate([p[4] for p in pieces])
    _, at, place = np.unique(spelling, return_index=True, return_inverse=True)
    base = np.cumsum([0, *(len(p[4]) for p in pieces)])
    which = np.concatenate([place[low + p[0]] for low, p in zip(base, pieces)])
    count = np.concatenate([p[3] for p in pieces])
    start = np.cumsum(count) - count
    buckets = np.concatenate([p[2] for p in pieces])[ragged(start[at], count[at])]
    return which, np.concatenate([p[1] for p in pieces]), buckets, count[at]


def bags(number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word and number of words of each bag, and how many bags each text has (none without words)."""
    count = np.where(number > 0, 1 + np.maximum(0, -(-(number - BAG) // STRIDE)), 0)
    text = np.repeat(np.arange(len(number)), count)
    first = STRIDE * (np.arange(len(text)) - (np.cumsum(count) - count)[text])
    return first + (np.cumsum(number) - number)[text], np.minimum(BAG, number[text] - first), count


@dataclasses.dataclass
class Toxicity:
    """``weights`` holds each bucket's embedding times the difference of the softmax rows: averages of
    averages are linear, so this one number per bucket gives the same result as the whole embedding."""

    weights: np.ndarray
    bias: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Each text's probability: that of its most toxic bag. Without words, that of an empty bag."""
        which, number, buckets, count, _ = subwords(data, offsets)
        logit = np.full(len(number), self.bias)
        if len(which):
            spelling = np.add.reduceat(self.weights[buckets], np.cumsum(count) - count) / count
            upto = np.r_[0.0, np.cumsum(spelling[which], dtype=np.float64)]
            first, size, each = bags(number)
            bag = (upto[first + size] - upto[first]) / size + self.bias
            logit[each > 0] = np.maximum.reduceat(bag, (np.cumsum(each) - each)[each > 0])
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def train(texts: list[str], toxic: np.ndarray, steps: int = 80, rate: float = 0.1, decay: float = 1e-5, seed: int = 7) -> Toxicity:
    """Fit embeddings and softmax together by Adam on the whole sample.

    Both classes count the same, whatever their shares. A document's loss is the cross-entropy of its bags, each counted by how toxic it looks now: at
    first almost evenly, at the end almost only the most toxic one, as in scoring.
    """
    which, number, buckets, count = sampled_subwords(texts)
    first, size, each = bags(number)
    text = np.repeat(np.arange(len(number)), each)
    starts, full = (np.cumsum(each) - each)[each > 0], each > 0
    random = np.random.default_rng(seed)
    embedding = random.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    softmax = random.normal(0, 0.5, (DIMENSIONS, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    parameters = [embedding, softmax, bias]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in parameters]
    weight = np.where(toxic == 1, 1 / max(1, (toxic == 1).sum()), 1 / max(1, (toxic == 0).sum())) / 2
    first_gram = np.cumsum(count) - count
    # Buckets of few documents are left at zero, as are those no document has.
    documents = np.zeros(BUCKETS, np.int64)
    for own in np.split(which, np.cumsum(number)[:-1]):
        own = np.unique(own)
        documents[np.unique(buckets[ragged(first_gram[own], count[own])])] += 1
    used = np.flatnonzero(documents >= MIN_DOCUMENTS)
    embedding[np.setdiff1d(np.arange(BUCKETS), used)] = 0
    for step in range(1, steps + 1):
        sharp = 8.0 * step / steps
        difference = softmax[:, 1] - softmax[:, 0]
        scalar = embedding @ difference
        spelling = np.add.reduceat(scalar[buckets], first_gram) / count
        upto = np.r_[0.0, np.cumsum(spelling[which], dtype=np.float64)]
        logit = (upto[first + size] - upto[first]) / size + float(bias[1] - bias[0])
        top = np.maximum.reduceat(logit, starts)
        share = np.exp(np.minimum(sharp, 4) * (logit - np.repeat(top, each[full])))
        share /= np.repeat(np.add.reduceat(share, starts), each[full])
        wrong = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - toxic[text]) * share * weight[text]
        # Back through both averages to the number of each bucket.
        per_word = np.zeros(len(which) + 1)
        np.add.at(per_word, first, wrong / size)
        np.add.at(per_word, first + size, -wrong / size)
        per_spelling = np.bincount(which, np.cumsum(per_word)[:-1], len(count)) / count
        per_bucket = np.bincount(buckets, np.repeat(per_spelling, count), BUCKETS).astype(np.float32)
        slope = embedding.T @ per_bucket
        gradients = [np.outer(per_bucket[used], difference), np.stack([-slope, slope], axis=1), np.array([-wrong.sum(), wrong.sum()])]
        for p, (m, v), g in zip(parameters, moments, gradients):
            rows = used if p is embedding else slice(None)
            g = g + decay * p[rows] if p is embedding else g
            m[rows] = 0.9 * m[rows] + 0.1 * g
            v[rows] = 0.99 * v[rows] + 0.01 * g * g
            p[rows] -= rate * (1 - step / (steps + 1)) * (m[rows] / (1 - 0.9**step)) / (np.sqrt(v[rows] / (1 - 0.99**step)) + 1e-8)
    return Toxicity((embedding @ (softmax[:, 1] - softmax[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, y, text) of at most SAMPLE_ROWS labelled rows per class that aren't held out, by hash of the id, and SAMPLE_BYTES of text.

    An id counts once, with one of its texts. What reaches the driver is an id, a hash and a length for each of these rows.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).filter(F.col("y").isin(0, 1) & ~is_held_out())
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    order = F.xxhash64("doc_id", F.lit("sample"))
    chosen = None
    for y in (0, 1):
        part = known.filter(F.col("y") == y).orderBy(order, "doc_id").limit(SAMPLE_ROWS)
        chosen = part if chosen is None else chosen.union(part)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), filled("text").alias("text")).join(F.broadcast(chosen), "doc_id")
    one = rows.groupBy("doc_id").agg(F.min(F.struct("text_key", F.octet_length("text").alias("n"))).alias("one"), F.min(order).alias("o"))
    measured = sorted(one.select("doc_id", "one.*", "o").collect(), key=lambda r: (r.o, r.doc_id))  # 2 * SAMPLE_ROWS at most
    total, kept = 0, []
    for r in measured:
        if total + r.n <= SAMPLE_BYTES:
            total += r.n
            kept.append((r.doc_id, r.text_key))
    within = docs.sparkSession.createDataFrame(kept, "doc_id long, text_key long")
    return rows.join(F.broadcast(within), ["doc_id", "text_key"]).dropDuplicates(["doc_id", "text_key"]).select("doc_id", "y", "text")


def fit(docs: DataFrame, labels: DataFrame) -> Toxicity:
    """A model from the labelled rows; one that rejects nothing if these don't hold both classes.

    The sample, SAMPLE_BYTES at most, goes to one task, which returns the weights (1 MB).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r["doc_id"], r["y"], r["text"]) for batch in batches for r in batch.to_pylist())
        texts, toxic = [r[2] for r in rows], np.array([r[1] for r in rows], np.float64)
        if len(set(toxic.tolist())) == 2 and any(texts):
            model = train(texts, toxic)
            yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()]), pa.array([model.bias])], names=["weights", "bias"])

    found = labelled_sample(docs, labels, "toxic").repartition(1).mapInArrow(freeing(run), "weights binary, bias double").collect()
    if not found:
        return Toxicity(np.zeros(BUCKETS, np.float32), -30.0)
    return Toxicity(np.frombuffer(bytes(found[0].weights), np.float32), found[0].bias)


def score(docs: DataFrame, model: Toxicity) -> DataFrame:
    """doc_id, held_out, score, predicted, text_key of every row.

    A text without words (null, empty, signs only) gets the score of an empty bag. Whole texts are read;
    repeated rows get equal scores; a null doc_id stays null and counts as held out; other columns
    are not looked at; an empty table gives no rows.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in chunks(batch.column("text"), SCORED_BYTES):
                columns = [batch.column(c).slice(low, high - low) for c in ("doc_id", "held_out", "text_key")]
                columns.append(pa.array(shared.value.scores(data, offsets), pa.float64()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "text_key", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), is_held_out().alias("held_out"), text_key().alias("text_key"), F.lower(filled("text")).alias("text"))
    scored = rows.mapInArrow(freeing(run), "doc_id long, held_out boolean, text_key long, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """:func:`score` of every row by a model fitted on the labels."""
    return score(docs, fit(docs, labels))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, with all columns."""
    return without(docs, materialize(toxicity(docs, labels).filter("predicted = 1").select("doc_id", "text_key"), "toxic"))
