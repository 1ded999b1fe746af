"""A mix of documents near target weights of overlapping sources, routed by min-cost flow over membership patterns."""

from __future__ import annotations

from collections import deque
from fractions import Fraction
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from screenforge.llm.common import attach, filled, shuffle_width
from screenforge.operators.joins import is_small
from screenforge.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
# The network in the driver has so many edges from patterns to sources at most; more is an error.
MOST_EDGES = 200_000
BROADCAST_PATTERNS = 100_000
# Boundaries are found by so many hexadecimal digits of a document's place at a time.
DIGITS = 3


def water_level(sizes: list[int], weights: list[int], total: Fraction, most: int) -> list[Fraction]:
    """Targets in proportion to weights that add up to ``total``, where none is above ``most`` times its size.

    What is above goes to the others by weight, until none is above. With a total above all limits
    together every target is at its limit.
    """
    targets, open_ = [Fraction(most * s) for s in sizes], list(range(len(sizes)))
    while open_:
        rest = total - sum(targets) + sum(targets[i] for i in open_)
        level = rest / sum(weights[i] for i in open_)
        above = [i for i in open_ if level * weights[i] >= most * sizes[i]]
        if not above:
            for i in open_:
                targets[i] = level * weights[i]
            break
        gone = set(above)
        open_ = [i for i in open_ if i not in gone]
    return targets


def route(capacity: list[int], members: list[list[int]], quotas: list[int], repeats: int) -> tuple[list[int], list[int]]:
    """Tokens to take of each pattern, and for each source: as much of the sources' quotas as can be met, at the least cost of repetition.

    The network has a node per pattern and per source. From the start to a pattern leads an arc for
    each repetition, of the pattern's capacity, and its cost grows by one each time (convex); from a pattern arcs of
    no cost lead to its sources, and from a source an arc of its quota to the end. Successive
    shortest paths use all arcs of one cost before those of the next, so the flow is widened repetition by
    repetition, by blocking flows along shortest residual paths; an arc from the start is never given back.
    """
    patterns, end = len(capacity), len(capacity) + len(quotas) + 1
    start = end - 1
    to, left, arcs = [], [], [[] for _ in range(end + 1)]

    def arc(a: int, b: int, room: int) -> int:
        for x, y, r in ((a, b, room), (b, a, 0)):
            arcs[x].append(len(to))
            to.append(y)
            left.append(r)
        return len(to) - 2

    from_start = [arc(start, p, 0) for p in range(patterns)]
    for p, sources in enumerate(members):
        for s in sources:
            arc(p, patterns + s, capacity[p] * repeats)
    to_end = [arc(patterns + s, end, quota) for s, quota in enumerate(quotas)]
    for _ in range(repeats):
        for p in range(patterns):
            left[from_start[p]] += capacity[p]
        while True:
            depth, queue = {start: 0}, deque([start])
            while queue:
                x = queue.popleft()
                for e in arcs[x]:
                    if left[e] and to[e] not in depth:
                        depth[to[e]] = depth[x] + 1
                        queue.append(to[e])
            if end not in depth:
                break
            # A blocking flow along the levels, by an own stack.
            at, path, x = [0] * (end + 1), [], start
            while True:
                if x == end:
                    room = min(left[e] for e in path)
                    for e in path:
                        left[e] -= room
                        left[e ^ 1] += room
                    path, x = [], start
                elif at[x] < len(arcs[x]):
                    e = arcs[x][at[x]]
                    if left[e] and depth.get(to[e]) == depth[x] + 1:
                        path.append(e)
                        x = to[e]
                    else:
                        at[x] += 1
                elif path:
                    x = to[path.pop() ^ 1]
                    at[x] += 1
                else:
                    break
    return [left[e ^ 1] for e in from_start], [left[e ^ 1] for e in to_end]


def pattern_key(members: Column) -> Column:
    """A sorted list of members as text, one text per list; null is a member too."""
    return F.array_join(F.transform(members, lambda m: F.coalesce(F.concat(F.length(m).cast("string"), F.lit(":"), m), F.lit("-"))), ",")


def _onto(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Left join of a table with one row per pattern; a pattern may hold any share of ``rows``."""
    if is_small(table, BROADCAST_PATTERNS):
        return rows.join(F.broadcast(table), "pattern", "left")
    return attach(rows, table, ["pattern"], F.pmod(F.xxhash64("place"), F.lit(shuffle_width(rows.sparkSession))))


def boundaries(rows: DataFrame, rest: DataFrame) -> DataFrame:
    """(pattern, at, part): the place up to which a pattern's documents fill its rest, and what each document there gives.

    ``rows``: pattern, place, size; ``rest``: pattern, rest. In the order of places the documents before ``at``
    are taken whole, those at it with ``part`` words each (equal rows share a place). Sums by the
    leading digits of the places lead to the boundary's digits, twice; only the documents that share these are
    summed place by place, so no task sorts a pattern's documents.
    """
    known = rest.filter("rest > 0").withColumn("at", F.lit(""))
    for digits in (DIGITS, 2 * DIGITS, 32):
        inside = _onto(rows, known).filter(F.col("place").startswith(F.col("at")))
        groups = inside.groupBy("pattern", "rest", F.substring("place", 1, digits).alias("at")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
        before = F.coalesce(F.sum("size").over(W.partitionBy("pattern").orderBy("at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        groups = groups.withColumn("rest", F.col("rest") - before).filter(F.col("rest").between(1, F.col("size")))
        known = materialize(groups.select("pattern", "at", "rest", "n"), "boundaries")
    return known.select("pattern", "at", F.floor(F.col("rest") / F.col("n")).cast("long").alias("part"))


class Mix(NamedTuple):
    """What :func:`mix` makes: a row per document, and one per source."""

    documents: DataFrame
    sources: DataFrame


def mix(
    docs: DataFrame, members: Column, repeats: int = 2, share: Fraction = Fraction(3, 2), weights: tuple[int, ...] = (3, 1, 2), seed: int = 0
) -> Mix:
    """Take words of documents so that every source comes to its target, with as little repetition as that needs.

    ``members``: an array with the sources of a document, which may be several; null is a source too. Size: the words of
    the text, 0 for null. The sources by code point, null last, weigh ``weights`` in turn and share ``share``
    times all sizes; a target stops at ``repeats`` times its source's size and the others share the excess.
    A document's words count for one of its sources each.

    ``documents``: doc_id, pattern (its sources as text), size, taken: whole repetitions, and up to one more for
    the first documents of the pattern in seeded order, where the last one is taken in part. ``taken``
    is never above ``repeats`` times the size. The order follows the seed, doc_id and text alone, so reruns agree; rows that
    repeat both get equal shares. ``sources``: pattern (of this source alone), source, source_size, target, routed.
    Documents without sources or words give nothing; a null doc_id stays null; other columns are not looked at;
    an empty table gives no rows. More than MOST_EDGES pairs of pattern and source are an error.
    """
    spark = docs.sparkSession
    sorted_ = F.array_sort(F.array_distinct(F.coalesce(members, F.array().cast("array<string>"))))
    body = filled("text")
    place = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(body)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), sorted_.alias("members"), F.regexp_count(body, F.lit(WORD)).cast("long").alias("size"), place.alias("place"))
    rows = materialize(rows.withColumn("pattern", pattern_key(F.col("members"))), "sizes")
    patterns = rows.groupBy("pattern", "members").agg(F.sum("size").alias("size")).limit(MOST_EDGES + 1).collect()
    if sum(len(p.members) for p in patterns) > MOST_EDGES or len(patterns) > MOST_EDGES:
        raise ValueError(f"more than {MOST_EDGES:,} pairs of a membership pattern and a source")
    patterns.sort(key=lambda p: p.pattern)
    names = sorted({m for p in patterns for m in p.members}, key=lambda m: (m is None, m or ""))
    number = {m: i for i, m in enumerate(names)}
    sizes = [0] * len(names)
    for p in patterns:
        for m in p.members:
            sizes[number[m]] += p.size
    total = share * sum(p.size for p in patterns if p.members)
    targets = water_level(sizes, [weights[i % len(weights)] for i in range(len(names))], total, repeats)
    taken, routed = route([p.size for p in patterns], [[number[m] for m in p.members] for p in patterns], [int(t) for t in targets], repeats)
    shares = [(p.pattern, *(divmod(x, p.size) if p.size else (0, 0))) for p, x in zip(patterns, taken)]
    shares = spark.createDataFrame(shares, "pattern string, whole long, rest long")
    ends = boundaries(rows.select("pattern", "place", "size"), shares.select("pattern", "rest"))
    rows = _onto(rows, shares.select("pattern", "whole").join(ends, "pattern", "left"))
    more = F.when(F.col("place") < F.col("at"), F.col("size")).when(F.col("place") == F.col("at"), F.col("part")).otherwise(0)
    documents = rows.select("doc_id", "pattern", "size", (F.col("whole") * F.col("size") + more).alias("taken"))
    listed = [(m, s, float(t), r) for m, s, t, r in zip(names, sizes, targets, routed)]
    sources = spark.createDataFrame(listed, "source string, source_size long, target double, routed long")
    return Mix(documents, sources.select(pattern_key(F.array("source")).alias("pattern"), "*"))


def mixed_sources(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document; its one source is the column ``source``."""
    documents, sources = mix(docs, F.array(F.col("source").cast("string")))
    placed = documents.withColumn("place", F.xxhash64("doc_id", "taken"))
    return _onto(placed, sources.select("pattern", "source_size", "target")).select("doc_id", "size", "source_size", "target", "taken")
