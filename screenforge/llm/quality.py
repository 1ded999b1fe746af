"""Text quality by learning from positives and unlabelled texts."""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenforge.llm.common import bound_batches, chunks, filled, is_held_out, mixed
from screenforge.llm.word_hashing import word_hashes
from screenforge.session import materialize

THRESHOLD = 0.3
# The classifier is fitted on a sample: at most so many trusted positives and so many unlabelled rows.
SAMPLE_POSITIVE, SAMPLE_UNLABELLED = 20_000, 40_000

_BYTE = np.arange(256)
_CHARACTER = (_BYTE & 0xC0) != 0x80  # the first byte of each character
_UPPER = (_BYTE >= 65) & (_BYTE <= 90)
_LETTER = _UPPER | ((_BYTE >= 97) & (_BYTE <= 122)) | (_BYTE >= 0xC2)
CLASSES = {
    "letters": _LETTER,
    "digits": (_BYTE >= 48) & (_BYTE <= 57),
    "spaces": np.isin(_BYTE, [32, *range(9, 14)]),
    "lines": _BYTE == 10,
    "points": np.isin(_BYTE, [ord(c) for c in ".,;:?'\"()-"]),
    "shouts": _BYTE == ord("!"),
    "bars": _BYTE == ord("|"),
    "signs": np.isin(_BYTE, [ord(c) for c in "#$%&*~^<>{}[]\\@_+=/"]),
}
FEATURES = [*CLASSES, "upper", "word_length", "distinct", "again", "pairs_again", "runs_again", "size", "has_words"]


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of shares and rates for each text; zeros for a text without words."""

    def within(mask: np.ndarray) -> np.ndarray:
        sums = np.r_[0, np.cumsum(mask)]
        return (sums[offsets[1:]] - sums[offsets[:-1]]).astype(np.float64)

    size = np.maximum(within(_CHARACTER[data]), 1)
    shares = [within(mask[data]) / size for mask in CLASSES.values()]
    accented = np.zeros(len(data), bool)  # capitals from A with grave to thorn
    accented[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    upper = within(_UPPER[data] | accented) / np.maximum(shares[0] * size, 1)
    words, number = word_hashes(data, offsets)
    count = np.maximum(number, 1).astype(np.float64)
    owner = np.repeat(np.arange(len(number)), number)

    def distinct(width: int) -> np.ndarray:
        """Share of different runs of ``width`` words."""
        hashes = np.zeros(max(len(words) - width + 1, 0), np.uint64)
        for k in range(width):
            hashes = mixed(hashes + words[k : len(words) - width + 1 + k]) if len(hashes) else hashes
        own = owner[: len(hashes)]
        inside = own == owner[width - 1 :] if len(hashes) else np.zeros(0, bool)
        hashes, own = hashes[inside], own[inside]
        all_of = np.bincount(own, minlength=len(number))
        by = np.lexsort((hashes, own))
        hashes, own = hashes[by], own[by]
        new = np.r_[True, (hashes[1:] != hashes[:-1]) | (own[1:] != own[:-1])] if len(hashes) else np.zeros(0, bool)
        return np.where(all_of > 0, np.bincount(own[new], minlength=len(number)) / np.maximum(all_of, 1), 1)

    same = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1]) if len(words) else np.zeros(0, bool)
    again = np.bincount(owner[1:][same], minlength=len(number)) / count if len(words) else np.zeros(len(number))
    columns = [*shares, upper, np.log1p(shares[0] * size / count), distinct(1), again, 1 - distinct(2), 1 - distinct(5), np.log1p(number) / 5, number > 0]
    return np.column_stack(columns) * (number > 0)[:, None]


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, features of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in chunks(batch.column("text")):
                rows = features(data, offsets)
                columns = [batch.column(c).slice(low, high - low) for c in ("doc_id", "held_out")]
                values = pa.ListArray.from_arrays(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32), rows.astype(np.float32).ravel())
                yield pa.RecordBatch.from_arrays([*columns, values], names=["doc_id", "held_out", "features"])

    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), is_held_out().alias("held_out"), filled("text").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, features array<float>")


@dataclasses.dataclass
class Quality:
    """A logistic model of standardised features and their squares."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def inputs(self, rows: np.ndarray) -> np.ndarray:
        x = np.clip((rows - self.mean) / self.scale, -6, 6)
        return np.hstack([x, x * x - 1])

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.inputs(rows) @ self.weights + self.bias, -30, 30)))


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 600, rate: float = 0.03, decay: float = 1e-3) -> Quality:
    """Minimise the non-negative unbiased risk with the logistic loss.

    The risk is prior * E_p[loss(+)] + max(0, E_u[loss(-)] - prior * E_p[loss(-)]): what unlabelled
    texts lose as negatives, less the positives' part of it. Where that difference becomes
    negative the model fits noise, and the step goes the other way (Kiryo et al., 2017).
    """
    both = np.vstack([positive, unlabelled])
    model = Quality(unlabelled.mean(axis=0), np.maximum(unlabelled.std(axis=0), 1e-3), np.zeros(2 * both.shape[1]), 0.0)
    p, u = model.inputs(positive), model.inputs(unlabelled)
    value = np.zeros(p.shape[1] + 1)
    first, second = np.zeros_like(value), np.zeros_like(value)

    def sigmoid(x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))

    for step in range(1, steps + 1):
        at_p, at_u = p @ value[:-1] + value[-1], u @ value[:-1] + value[-1]
        negative = np.logaddexp(0, at_u).mean() - prior * np.logaddexp(0, at_p).mean()
        of_p, of_u = sigmoid(at_p), sigmoid(at_u)
        down = np.r_[of_u @ u / len(u), of_u.mean()] - prior * np.r_[of_p @ p / len(p), of_p.mean()]
        up = prior * np.r_[(of_p - 1) @ p / len(p), (of_p - 1).mean()]
        slope = up + down if negative >= 0 else -down
        slope[:-1] += decay * value[:-1]
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope * slope
        value -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    model.weights, model.bias = value[:-1], float(value[-1])
    return model


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, least: int = 100) -> float:
    """The share of positives among unlabelled texts, from the scores of both under any model that ranks positives higher.

    Above any score there is at least prior times the positives' share among the unlabelled, so the lowest quotient of
    the two shares is an upper bound, which is sharp where a score is reached by positives only (Blanchard et
    al., 2010). Quotients are taken at the positives' scores with ``least`` of them above, and a tenth of them at least.
    """
    cuts = np.sort(positive)[::-1]
    above = np.arange(1, len(cuts) + 1)
    share = (len(unlabelled) - np.searchsorted(np.sort(unlabelled), cuts, side="left")) / max(1, len(unlabelled))
    steady = above >= min(len(cuts), max(least, len(cuts) // 10))
    return float(np.clip(np.min((share / (above / len(cuts)))[steady]), 0.01, 0.99))


def _sampled(rows: DataFrame, most: int) -> np.ndarray:
    """The features of ``most`` different rows (or all), those of the lowest hashes.

    Hashes above a threshold stay where they are, so about as many rows reach the driver as are wanted, whatever
    the number of partitions.
    """
    order = F.xxhash64("doc_id", "features", F.lit("quality"))
    total = rows.count()
    margin = 1.2
    while True:
        share = margin * (most + 100) / max(1, total)
        within = rows if share >= 1 else rows.filter(order < int(-(2**63) + share * 2**64))
        found = within.dropDuplicates(["doc_id", "features"]).orderBy(order, "doc_id").limit(most).select("features").toArrow()
        if found.num_rows == most or share >= 1:
            return found.column("features").combine_chunks().flatten().to_numpy().reshape(found.num_rows, len(FEATURES)).astype(np.float64)
        margin *= 2  # many rows repeat, or the hashes fell badly


def fit(rows: DataFrame, labels: DataFrame) -> Quality | None:
    """A model from :func:`measured` rows: trusted positives are learnable rows labelled 1, all learnable rows are
    the unlabelled ones. The prior is estimated by a first model, which takes it to be a half. None without positives."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("y")).filter(F.col("y").isin(0, 1) & ~is_held_out())
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    learnable = rows.filter("NOT held_out")
    positive = _sampled(learnable.join(known.filter("y = 1"), "doc_id", "left_semi"), SAMPLE_POSITIVE)
    if not len(positive):
        return None
    unlabelled = _sampled(learnable, SAMPLE_UNLABELLED)
    first = train(positive, unlabelled, 0.5)
    return train(positive, unlabelled, estimated_prior(first.scores(positive), first.scores(unlabelled)))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    Null and empty texts, and texts of white space, have zeros for features and get the score that the
    model gives these. Without any positive label every score is 0. Whole texts are read; repeated
    rows get equal scores; a null doc_id stays null and counts as held out; other columns are not
    looked at; an empty table gives no rows.
    """
    rows = materialize(measured(docs), "quality-features")
    shared = docs.sparkSession.sparkContext.broadcast(fit(rows, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("features").flatten().to_numpy().reshape(batch.num_rows, len(FEATURES)).astype(np.float64)
            score = shared.value.scores(values) if shared.value else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score, pa.float64())], names=["doc_id", "held_out", "score"])

    scored = rows.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
