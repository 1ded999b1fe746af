"""Near duplicates: banded MinHash candidates, pruned batch by batch, and exact links."""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from screenforge.llm.common import attach, bound_batches, chunks, filled, freeing, mixed, ragged, shuffle_width, text_key, without
from screenforge.llm.word_hashing import BASE, LOWER, word_hashes
from screenforge.llm.components import components
from screenforge.operators.joins import is_small
from screenforge.session import materialize

WORDS = 5
PERCENT = 75
# 32 bands of 4 values: two sets with similarity 0.75 share no band with probability 5e-6.
BANDS, ROWS = 32, 4
# Candidates are compared by so many further MinHash values of four bits, in batches; a pair is given up once
# its similarity reaches the threshold with less than this probability (uniform prior).
VALUES, BATCH, MISS = 2048, 128, 1e-7
# Members of a bucket that are compared with each other in one task.
BLOCK = 1024

def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of several texts, one text after the other, and the number of each.

    Words are runs of bytes other than space and 09-0D, with A-Z in lower case. Every five neighbouring
    words are a shingle; fewer words are one shingle, none are none.
    """
    words, number = word_hashes(data, offsets)
    upto = np.cumsum(number) - number
    width = np.minimum(number, WORDS)
    count = number - width + (number > 0)
    start = ragged(upto, count)
    sizes = np.repeat(width, count)
    hashes = mixed(sizes.astype(np.uint64))
    for k in range(WORDS):
        inside = sizes > k
        at = np.minimum(start + k, max(len(words) - 1, 0))
        hashes = np.where(inside, mixed(hashes * np.uint64(BASE) + words[at]), hashes) if len(words) else hashes
    owner = np.repeat(np.arange(len(number)), count)
    by = np.lexsort((hashes, owner))
    hashes, owner = hashes[by], owner[by]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], np.bincount(owner[new], minlength=len(number))


def signatures(hashes: np.ndarray, count: np.ndarray, values: int = BANDS * ROWS, first: int = 0) -> np.ndarray:
    """MinHash values of each set as a row of 32-bit numbers; zeros for an empty set. ``first`` chooses the functions."""
    out = np.zeros((len(count), values), np.uint32)
    full = count > 0
    if not full.any():
        return out
    starts = (np.cumsum(count) - count)[full]
    factors = mixed(np.arange(first + 1, first + values + 1, dtype=np.uint64) * np.uint64(BASE)) | np.uint64(1)
    plus = mixed(factors)
    rows = np.empty((int(full.sum()), values), np.uint32)
    for k in range(values):
        rows[:, k] = np.minimum.reduceat(hashes * factors[k] + plus[k], starts) >> np.uint64(32)
    out[full] = rows
    return out


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, node, n_shingles, signature of every row.

    ``node`` is a digest of the words: rows with the same words in the same order are one node, null
    for rows without words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in chunks(batch.column("text")):
                hashes, count = shingles(data, offsets)
                rows = signatures(hashes, count)
                body = data.tobytes().translate(LOWER)
                texts = [b" ".join(body[a:b].split()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                nodes = [hashlib.blake2b(t, digest_size=16).digest() if t else None for t in texts]
                columns = [batch.column(c).slice(low, high - low) for c in ("doc_id", "text_key")]
                columns += [pa.array(nodes, pa.binary()), pa.array(count, pa.int64()), pa.array([r.tobytes() for r in rows], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "node", "n_shingles", "signature"])

    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), filled("text").alias("text"))
    return rows.mapInArrow(freeing(run), "doc_id long, text_key long, node binary, n_shingles long, signature binary")


def fine_signatures(hashes: np.ndarray, count: np.ndarray) -> np.ndarray:
    """VALUES further MinHash values of each set, four bits of each, two in a byte."""
    low = mixed(signatures(hashes, count, VALUES, BANDS * ROWS).ravel()).reshape(len(count), VALUES).astype(np.uint8) & 15
    return low[:, ::2] | low[:, 1::2] << 4


@functools.lru_cache(maxsize=1)
def least_matches() -> list[int]:
    """After each batch: the least number of equal values with which a pair goes on.

    Four-bit values of sets with similarity s agree with probability t = s + (1 - s) / 16. With m of n
    equal and a uniform prior that probability is Beta(m + 1, n - m + 1), and it reaches t with
    the probability that a Binomial(n + 1, t) is at most m.
    """
    t = PERCENT / 100 + (1 - PERCENT / 100) / 16
    least = []
    for n in range(BATCH, VALUES + 1, BATCH):
        logs = [math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m) + m * math.log(t) + (n + 1 - m) * math.log(1 - t) for m in range(n + 2)]
        least.append(int(np.searchsorted(np.cumsum(np.exp(logs)), MISS)))
    return least


def may_be_similar(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which pairs of fine signature rows are not given up in any batch."""
    alive = np.arange(len(left))
    equal = np.zeros(len(left), np.int64)
    for k, least in enumerate(least_matches()):
        part = slice(k * BATCH // 2, (k + 1) * BATCH // 2)
        differ = left[alive, part] ^ right[alive, part]
        equal[alive] += ((differ & 15) == 0).sum(axis=1) + ((differ >> 4) == 0).sum(axis=1)
        alive = alive[equal[alive] >= least]
        if not len(alive):
            break
    out = np.zeros(len(left), bool)
    out[alive] = True
    return out


def bands(nodes: DataFrame) -> DataFrame:
    """(place, band, node): one row per node and band; ``band`` is a hash of the band's place and values."""
    size = 4 * ROWS
    keys = [F.xxhash64(F.lit(k), F.substring("signature", k * size + 1, size)) for k in range(BANDS)]
    return nodes.select("node", F.posexplode(F.array(*keys)).alias("place", "band"))


def band_marks(coarse: np.ndarray) -> np.ndarray:
    """32 bits of each band of signature rows: equal where two rows share the band."""
    values = coarse.reshape(len(coarse), BANDS, ROWS).astype(np.uint64)
    marks = np.zeros((len(coarse), BANDS), np.uint64)
    for k in range(ROWS):
        marks = mixed(marks * np.uint64(BASE) + values[:, :, k])
    return marks.astype(np.uint32)


def _by(column: str, spark: SparkSession) -> Column:
    """Salt for rows that share one key and differ in ``column``."""
    return F.pmod(F.xxhash64(column), F.lit(shuffle_width(spark)))


def with_both(pairs: DataFrame, table: DataFrame, value: str) -> DataFrame:
    """``value`` of both sides of each pair, as value_a and value_b; a node may be in any share of the pairs."""
    spark = pairs.sparkSession
    own, other = (table.select(F.col("node").alias(c), F.col(value).alias(f"{value}_{c}")) for c in "ab")
    return attach(attach(pairs, own, ["a"], _by("b", spark)), other, ["b"], _by("a", spark))


def pruned(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures, compared batch by batch, may belong to similar sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (_rows(batch.column(f"fine_{c}").to_pylist()) for c in "ab")
            yield batch.select(["a", "b"]).filter(pa.array(may_be_similar(left, right), pa.bool_()))

    return with_both(pairs, signed, "fine").select("a", "b", "fine_a", "fine_b").mapInArrow(freeing(run), "a binary, b binary")


def _rows(signatures: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(signatures), np.uint8).reshape(len(signatures), VALUES // 2)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("shingles_a"), batch.column("shingles_b")):
                left, right = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                common = len(np.intersect1d(left, right, assume_unique=True))
                keep.append(100 * common >= PERCENT * (len(left) + len(right) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return with_both(pairs, sets, "shingles").select("a", "b", "shingles_a", "shingles_b").mapInArrow(freeing(run), "a binary, b binary")


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, shingles, fine, marks) of the rows (node, doc_id, text_key) in ``wanted``: their full sets as 64-bit
    hashes, their fine signatures, and their bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in chunks(batch.column("text"), rows=1024):
                hashes, count = shingles(data, offsets)
                edge = np.r_[0, np.cumsum(count)].tolist()
                sets = [hashes[x:y].tobytes() for x, y in zip(edge[:-1], edge[1:])]
                columns = [sets, *([r.tobytes() for r in rows] for rows in (fine_signatures(hashes, count), band_marks(signatures(hashes, count))))]
                columns = [batch.column("node").slice(low, high - low), *(pa.array(c, pa.binary()) for c in columns)]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "shingles", "fine", "marks"])

    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), text_key().alias("_key"), filled("text").alias("text"))
    if is_small(wanted, 200_000):  # 40 bytes each
        wanted = F.broadcast(wanted)
    rows = rows.join(wanted, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_key") == F.col("text_key")))
    return rows.select("node", "text").mapInArrow(freeing(run), "node binary, shingles binary, fine binary, marks binary").dropDuplicates(["node"])


def star_pairs(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One comparison per member of each bucket, with the bucket's pivot, and the members that are left after it.

    ``members``: place, band, node, degree, root. The pivot is the member that shares buckets with most others,
    so of a group of near copies the one in their middle. Members that are linked with it already aren't
    compared. Buckets whose members are all linked have nothing left to decide; in the others only the
    pivot is done with.
    """
    order = F.struct(-F.col("degree"), F.xxhash64("node"), "node", "root")
    buckets = members.groupBy("band").agg(F.min(order).alias("pivot"), F.min("root").alias("low"), F.max("root").alias("high"))
    buckets = buckets.filter("low < high").select("band", "pivot.node", "pivot.root").toDF("band", "pivot", "pivot_root")
    # A hot bucket is one side of a sort-merge join, which adaptive execution splits.
    open_members = materialize(members.join(buckets, "band").filter("node <> pivot"), "members")
    pairs = open_members.filter("root <> pivot_root").select(F.col("pivot").alias("a"), F.col("node").alias("b"))
    return pairs.distinct(), open_members.select("place", "band", "node", "degree")


def block_pairs(members: DataFrame, signed: DataFrame) -> DataFrame:
    """(a, b) of all pairs in a bucket that are not linked yet and may be similar.

    ``members``: place, band, node, root. A bucket is cut into blocks of about ``BLOCK`` members; every two of its
    blocks meet in one task, which compares signatures batch by batch and gives out survivors only. A
    pair that shares several bands is compared in the first of these.
    """
    counts = members.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high"))
    counts = counts.filter("low < high").select("band", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    rows = members.join(counts, "band").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = attach(rows, signed, ["node"], _by("band", members.sparkSession))

    def run(table: pa.Table) -> pa.Table:
        node, root = (np.array(table.column(c).to_pylist(), object) for c in ("node", "root"))
        block = table.column("block").to_numpy()
        fine = _rows(table.column("fine").to_pylist())
        marks = np.frombuffer(b"".join(table.column("marks").to_pylist()), np.uint32).reshape(len(node), BANDS)
        marks = marks[:, : table.column("place")[0].as_py()]
        _, root = np.unique(root, return_inverse=True)
        a, b = [], []
        cross = block.min() < block.max()
        for i in range(len(node)):
            later = np.flatnonzero((block > block[i]) if cross else (np.arange(len(node)) > i))
            later = later[root[later] != root[i]]
            later = later[~(marks[later] == marks[i]).any(axis=1)]
            near = later[may_be_similar(np.broadcast_to(fine[i], (len(later), fine.shape[1])), fine[later])]
            a += [min(node[i], node[j]) for j in near]  # whatever the order of the rows
            b += [max(node[i], node[j]) for j in near]
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    rows = rows.select("band", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "place", "node", "root", "block", "fine", "marks")
    return rows.groupBy("band", "low", "high").applyInArrow(run, "a binary, b binary")


def node_components(docs: DataFrame, nodes: DataFrame, stars: int = 1) -> DataFrame:
    """(node, root) of every node that is linked with another.

    ``nodes``: node, rep (doc_id, text_key, signature). Nodes that share a bucket are candidates. In each
    of ``stars`` rounds every bucket compares its members with one pivot, so a group of near copies
    is connected by as many comparisons as it has members. Pairs that no round has decided are
    compared block by block, and the components follow from all links.
    """
    banded = bands(nodes.select("node", "rep.signature"))
    shared = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = materialize(banded.join(shared, "band"), "members")
    degrees = members.groupBy("node").agg(F.sum("n").alias("degree"))
    wanted = nodes.join(degrees, "node").select("node", "rep.doc_id", "rep.text_key")
    sets = materialize(shingle_sets(docs, materialize(wanted, "candidates")), "shingles")
    signed = sets.select("node", "fine", "marks")
    members = members.join(degrees, "node").select("place", "band", "node", "degree")
    links: list[DataFrame] = []
    for step in range(stars + 1):
        if members.isEmpty():
            break
        rooted = members.withColumn("root", F.col("node"))
        if links:
            roots = components(functools.reduce(DataFrame.union, links))
            rooted = members.join(roots, "node", "left").select("place", "band", "node", "degree", F.coalesce("root", "node").alias("root"))
        if step < stars:
            pairs, members = star_pairs(rooted)
            pairs = pruned(pairs, signed)
        else:
            pairs = block_pairs(rooted, signed)
        # Written, as what follows reads the pairs more than once.
        links.append(materialize(verified(materialize(pairs, "pairs"), sets), "similar"))
    none = sets.limit(0).select(F.col("node").alias("a"), F.col("node").alias("b"))
    return components(functools.reduce(DataFrame.union, links, none))


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_key of every row.

    Two rows are linked if at least 75 % of their distinct five-word shingles are shared; component_id
    is the smallest doc_id that can be reached over links, and a row is kept if it is its own.
    Null and empty texts and texts of white space have no shingles and are linked with nothing; texts of
    fewer than five words are linked with equal word sequences. Rows that repeat doc_id and text get equal
    results (and are both kept if one is). A null doc_id is left out of the smallest, so such a
    row is kept only where no row of its component has an id. Texts are read whole; other columns are not
    looked at; an empty table gives no rows.
    """
    table = materialize(sketches(docs), "sketches")
    nodes = table.filter("node IS NOT NULL").groupBy("node").agg(
        F.min(F.struct("doc_id", "text_key", "signature")).alias("rep"), F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")
    )
    nodes = materialize(nodes, "nodes")
    roots = node_components(docs, nodes.select("node", "rep"))
    named = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"), F.sum("copies").alias("n")).filter("n > 1")
    values = named.select("node", "root").join(least, "root").select("node", "component_id")
    rows = attach(table.drop("signature"), values.withColumn("grouped", F.lit(True)), ["node"], _by("doc_id", docs.sparkSession))
    component = F.when(F.col("grouped"), F.col("component_id")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"), "text_key")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each component of :func:`near_groups`, with all columns; rows that repeat a kept row stay with it."""
    return without(docs, materialize(near_groups(docs).filter("NOT kept").select("doc_id", "text_key"), "near-duplicates"))
