"""Language of a text by hyperdimensional profiles."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenforge.llm.common import bound_batches, chunks, filled, is_held_out, mixed
from screenforge.session import materialize

DIMENSIONS = 512
# Letters with a vector of their own: 1 up to DIRECT by code point, others share the rest by hash. 0 is the gap.
DIRECT, LETTERS = 0x250, 1024
UNKNOWN = "und"


@functools.lru_cache(maxsize=1)
def _letter_numbers() -> np.ndarray:
    """By code point: the number of the letter in lower case, 0 for all that is no letter."""
    numbers = np.zeros(0x110000, np.int64)
    points = np.array([p for p in range(0x110000) if not 0xD800 <= p < 0xE000 and chr(p).isalpha()], np.int64)
    lower = np.array([ord(chr(p).lower()[0]) for p in points], np.int64)
    rest = DIRECT + (mixed(lower) % np.uint64(LETTERS - DIRECT)).astype(np.int64)
    numbers[points] = np.where(lower < DIRECT, lower, rest)
    return numbers


@functools.lru_cache(maxsize=1)
def _letter_vectors() -> np.ndarray:
    """A random vector of 1 and -1 for each letter number; the gap between words has one too."""
    return np.random.default_rng(20).choice(np.array([-1, 1], np.int8), (LETTERS, DIMENSIONS))


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, trigram, count) of the distinct trigrams of each text. Runs of other characters are one gap;
    every text begins and ends with a gap. A text without letters has none."""
    joined = " ".join(texts) + " "
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    letters = _letter_numbers()[points]
    keep = (letters > 0) | np.r_[True, letters[:-1] > 0] & np.r_[False, owner[1:] == owner[:-1]]
    letters, owner = letters[keep], owner[keep]
    # Each text now is letters with single gaps, the last one at its end; put one before it.
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, np.int64)
    letters, owner = np.insert(letters, first, 0), np.insert(owner, first, owner[first] if len(first) else owner)
    if len(letters) < 3:
        return (np.zeros(0, np.int64),) * 3
    inside = (owner[2:] == owner[:-2]) & (letters[1:-1] > 0)
    key = ((owner[:-2] << 30) | (letters[:-2] << 20) | (letters[1:-1] << 10) | letters[2:])[inside]
    key = np.sort(key)
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return key[start] >> 30, key[start] & ((1 << 30) - 1), np.diff(np.r_[start, len(key)])


def document_vectors(texts: list[str]) -> np.ndarray:
    """The bundle of each text's trigram vectors as a row; zeros for a text without letters.

    A trigram's vector binds (multiplies) those of its letters, the first moved on by two places
    and the second by one, so that order counts. Bundling adds them, as often as they occur.
    """
    text, trigram, count = trigrams(texts)
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    kinds, which = np.unique(trigram, return_inverse=True)
    vectors = _letter_vectors()
    for low in range(0, len(kinds), 4096):
        some = kinds[low : low + 4096]
        bound = np.roll(vectors, 2, axis=1)[some >> 20] * np.roll(vectors, 1, axis=1)[some >> 10 & 1023] * vectors[some & 1023]
        mine = (which >= low) & (which < low + 4096)
        counts = np.zeros((len(texts), len(some)), np.float32)
        counts[text[mine], which[mine] - low] = count[mine]
        out += counts @ bound.astype(np.float32)
    return out


def encoded(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang, vector of every row. The vector is scaled to 16-bit numbers, null without letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, _, _ in chunks(batch.column("text")):
                rows = document_vectors(batch.column("text").slice(low, high - low).to_pylist())
                most = np.abs(rows).max(axis=1, keepdims=True)
                scaled = np.rint(rows / np.maximum(most, 1) * 32767).astype("<i2")
                vectors = [v.tobytes() if m else None for v, m in zip(scaled, most[:, 0])]
                columns = [batch.column(c).slice(low, high - low) for c in ("doc_id", "held_out", "lang")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(vectors, pa.binary())], names=["doc_id", "held_out", "lang", "vector"])

    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), is_held_out().alias("held_out"), F.col("lang").cast("string").alias("lang"), filled("text").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang string, vector binary")


def _unit(vectors: list[bytes]) -> np.ndarray:
    rows = np.frombuffer(b"".join(vectors), "<i2").reshape(len(vectors), DIMENSIONS).astype(np.float32)
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


def prototypes(rows: DataFrame) -> DataFrame:
    """(lang, profile): the sum of the unit vectors of all learnable rows of each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            lang = np.array(batch.column("lang").to_pylist(), object)
            unit = _unit(batch.column("vector").to_pylist())
            for name in set(lang.tolist()):
                sums[name] = sums.get(name, 0) + unit[lang == name].sum(axis=0, dtype=np.float64)
        names = list(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([sums[n].tolist() for n in names], pa.list_(pa.float64()))], names=["lang", "profile"]
        )

    learnable = rows.filter("NOT held_out AND lang IS NOT NULL AND vector IS NOT NULL").select("lang", "vector")
    parts = learnable.mapInArrow(run, "lang string, profile array<double>").select("lang", F.posexplode("profile").alias("at", "value"))
    sums = parts.groupBy("lang", "at").agg(F.sum("value").alias("value"))
    return sums.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda s: s["value"]).alias("profile"))


def identify(docs: DataFrame, most_languages: int = 2_000) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row.

    The language whose prototype has the largest cosine with the text's vector, each less the mean of all
    prototypes; of equal ones the first in order of name. ``score`` is the softmax of the cosines at
    this language. A null text or one without letters is ``und`` with score 0, as is every text if there is
    nothing to learn from. Repeated rows get equal results; a null doc_id stays null and counts as held
    out; other columns are not looked at; an empty table gives no rows. More than ``most_languages``
    values of lang are an error, as the prototypes (4 kB each) go to every task.
    """
    rows = materialize(encoded(docs), "language-vectors")
    found = sorted(prototypes(rows).limit(most_languages + 1).collect())
    if len(found) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    names = [r.lang for r in found]
    profile = np.array([r.profile for r in found], np.float64).reshape(len(found), DIMENSIONS)
    profile /= np.maximum(np.linalg.norm(profile, axis=1, keepdims=True), 1e-9)
    mean = profile.mean(axis=0) if len(names) > 1 else np.zeros(DIMENSIONS)
    centred = profile - mean
    centred /= np.maximum(np.linalg.norm(centred, axis=1, keepdims=True), 1e-9)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector").to_pylist()
            known = np.array([v is not None for v in vectors], bool)
            predicted, score = np.full(len(vectors), UNKNOWN, object), np.zeros(len(vectors))
            if known.any() and names:
                unit = _unit([v for v in vectors if v is not None]) - mean
                unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-9)
                cosine = unit @ centred.T
                best = cosine.argmax(axis=1)
                predicted[known] = np.array(names, object)[best]
                share = np.exp(8 * cosine)
                score[known] = share[np.arange(len(best)), best] / share.sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(predicted.tolist(), pa.string()), pa.array(score, pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    return rows.drop("lang").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
