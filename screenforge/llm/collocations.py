"""Phrase collocations by the stripes pattern: counters of next words give extensions, prefix totals and subsumption."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from screenforge.llm.common import attach, bound_batches, chunks, filled, shuffle_width
from screenforge.session import materialize

# Texts are counted about so many bytes at a time; a task adds up its counters until they have so many entries.
PIECE_BYTES = 8 << 20
MOST_ENTRIES = 2 << 20
STRIPES_A_BATCH = 1 << 16
# A number of a word in one task has so many bits, one of a language the rest.
WORD_BITS = 22
# The filter of frequent pairs has 16 bits a pair, and 2 ** 29 (64 MB) at most; beyond that it lets more pairs through.
MOST_FILTER_BITS = 29
BITS_A_BUCKET = 32768
# Prefixes with more than 1 / (HOT * number of partitions) of a sample of so many texts (and two for each partition) are cut into strips.
HOT, SAMPLE_TEXTS = 8, 2_000
NO_LANG = "und"
# As a next word: the end of a piece. No word has this sign.
END = "."
WORD, BLANK, BREAK = 0, 1, 2


def byte_classes() -> np.ndarray:
    """The class of each byte: part of a word, blank between words, or break between pieces."""
    classes = np.full(256, WORD, np.uint8)
    classes[[0x20, 0x09]] = BLANK
    classes[[*b".,;:!?", *range(0x0A, 0x0E)]] = BREAK
    return classes


CLASSES = byte_classes()
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """The lower-cased words of some texts (their bytes, and where each begins): words, number of the text of each, number of its piece."""
    data = LOWER[data]
    kind = CLASSES[data]
    inside = kind == WORD
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edge = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[edge] = inside[edge]
    starts = np.flatnonzero(begins)
    # The bytes of the words alone, one after the other, and where each word begins there.
    letters = data[inside]
    ends = np.r_[(np.cumsum(inside)[starts] - 1), len(letters)].astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(letters)).dictionary_encode()
    text = np.searchsorted(offsets, starts, side="right") - 1
    piece = np.cumsum(kind == BREAK)[starts] + text  # grows with every break and every text
    return words, text, piece


def summed(prefix: np.ndarray, following: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries (prefix, next word) in order, each once."""
    by = np.lexsort((following, prefix))
    prefix, following, often = prefix[by], following[by], often[by]
    first = np.flatnonzero(np.r_[True, (prefix[1:] != prefix[:-1]) | (following[1:] != following[:-1])])
    return prefix[first], following[first], np.add.reduceat(often, first)


def spun(x: np.ndarray, by: int) -> np.ndarray:
    x = x.view(np.uint64)
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


class PairFilter:
    """A Bloom filter of (language, word, word) with two probes, from the bitmaps that Spark made."""

    def __init__(self, bits: int, buckets: dict[int, bytes]):
        self.bits = bits
        self.data = np.zeros(max(1, (1 << bits) // 8), np.uint8)
        for bucket, bitmap in buckets.items():
            low = (bucket - 1) * BITS_A_BUCKET // 8
            self.data[low : low + len(bitmap)] = np.frombuffer(bitmap, np.uint8)[: len(self.data) - low]

    def may_hold(self, lang: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """For hashes of languages and words: False where the pair is surely not in the filter."""
        mixed = spun(lang, 42) ^ first.view(np.uint64) ^ spun(second, 21)
        found = np.ones(len(mixed), bool)
        for probe in (mixed, mixed >> np.uint64(32)):
            at = (probe & np.uint64((1 << self.bits) - 1)).astype(np.int64)
            found &= (self.data[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return found

    @staticmethod
    def probes(bits: int) -> Column:
        """The two places of each row (lang, first, second) of a DataFrame, as the filter counts them."""

        def turned(value: Column, by: int) -> Column:
            return F.shiftleft(value, by).bitwiseOR(F.shiftrightunsigned(value, 64 - by))

        mixed = turned(F.xxhash64("lang"), 42).bitwiseXOR(F.xxhash64("first")).bitwiseXOR(turned(F.xxhash64("second"), 21))
        mask = F.lit((1 << bits) - 1)
        return F.array(mixed.bitwiseAND(mask), F.shiftrightunsigned(mixed, 32).bitwiseAND(mask))


def pair_filter(pairs: DataFrame) -> PairFilter:
    """The filter of the rows (lang, first, second) of ``pairs``; what comes to the driver is its bitmap, 64 MB at most."""
    bits = min(MOST_FILTER_BITS, max(15, math.ceil(math.log2(16 * pairs.count() + 1))))
    at = pairs.select(F.explode(PairFilter.probes(bits)).alias("at")).select((F.col("at") + 1).alias("at"))
    bitmaps = at.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    return PairFilter(bits, {row.bucket: bytes(row.bits) for row in bitmaps.toLocalIterator()})


class Stripes:
    """The counters of one task: how often each word follows a prefix of one word, or of two, per language.

    Words have numbers of the task's own, from 1; as a next word, 0 is the end of a piece (prefixes of one word only).
    With a filter, the prefixes have two words, and only what it lets through is counted.
    """

    def __init__(self, strips: int, pairs: PairFilter | None = None, hot: frozenset[tuple[str, ...]] = frozenset()):
        self.strips, self.pairs, self.hot = strips, pairs, hot
        self.clear()

    def _cut(self) -> np.ndarray:
        """The hot prefixes among those counted here."""
        found = []
        for lang, *words in self.hot:
            number = self.langs.get(lang)
            for word in words:
                number = None if number is None or word not in self.words else number << WORD_BITS | self.words[word]
            found.append(-1 if number is None else number)
        return np.array(found, np.int64)

    def clear(self) -> None:
        self.langs: dict[str, int] = {}
        self.words: dict[str, int] = {}
        self.hashes = [np.zeros(1, np.int64)]
        self.pending: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, langs: list[str], data: np.ndarray, offsets: np.ndarray) -> None:
        """Count some texts: their languages, their bytes, and where each begins."""
        import xxhash

        words, text, piece = words_of(data, offsets)
        if not len(words):
            return
        before = len(self.words)
        names = words.dictionary.to_pylist()
        number = np.array([self.words.setdefault(w, len(self.words) + 1) for w in names], np.int64)
        fresh = [names[i] for i in np.flatnonzero(number > before)]
        self.hashes.append(np.array([xxhash.xxh64_intdigest(w.encode(), 42) for w in fresh], np.uint64).view(np.int64))
        word = number[words.indices.to_numpy()]
        lang = np.array([self.langs.setdefault(x, len(self.langs)) for x in langs], np.int64)[text]
        near = piece[1:] == piece[:-1]
        if self.pairs is None:
            prefix, following = lang << WORD_BITS | word, np.r_[np.where(near, word[1:], 0), 0]
        else:
            hashes = np.concatenate(self.hashes)
            self.hashes = [hashes]
            of_lang = np.array([xxhash.xxh64_intdigest(x.encode(), 42) for x in self.langs], np.uint64).view(np.int64)[lang]
            hashed = hashes[word]
            near &= self.pairs.may_hold(of_lang[:-1], hashed[:-1], hashed[1:])
            at = np.flatnonzero(near[:-1] & near[1:])
            prefix, following = (lang[at] << WORD_BITS | word[at]) << WORD_BITS | word[at + 1], word[at + 2]
        if len(prefix):
            self.pending.append(summed(prefix, following, np.ones(len(prefix), np.int64)))
            self.size += len(self.pending[-1][0])

    def taken(self, last: bool = False) -> Iterator[pa.RecordBatch]:
        """Stripes to hand on: at the end, or when there are too many entries or words."""
        full = len(self.words) >= 1 << WORD_BITS - 1 or len(self.langs) >= 1 << 62 - 2 * WORD_BITS
        if self.pending and (last or full or self.size > MOST_ENTRIES):
            self.pending = [summed(*map(np.concatenate, zip(*self.pending)))]
            self.size = len(self.pending[0][0])
            if last or full or self.size > MOST_ENTRIES // 2:
                yield from self._batches(*self.pending[0])
                self.clear()

    def _batches(self, prefix: np.ndarray, following: np.ndarray, often: np.ndarray) -> Iterator[pa.RecordBatch]:
        strip = (np.concatenate(self.hashes)[following].view(np.uint64) % np.uint64(self.strips)).astype(np.int32)
        strip[~np.isin(prefix, self._cut())] = 0
        by = np.lexsort((strip, prefix))
        prefix, following, often, strip = prefix[by], following[by], often[by], strip[by]
        edge = np.r_[np.flatnonzero(np.r_[True, (prefix[1:] != prefix[:-1]) | (strip[1:] != strip[:-1])]), len(prefix)]
        names, langs = pa.array([END, *self.words], pa.string()), pa.array([*self.langs], pa.string())
        mask = (1 << WORD_BITS) - 1
        for low in range(0, len(edge) - 1, STRIPES_A_BATCH):
            cut = edge[low : low + STRIPES_A_BATCH + 1]
            head, body = prefix[cut[:-1]], slice(cut[0], cut[-1])
            if self.pairs is None:
                lang, first, second = head >> WORD_BITS, head & mask, np.zeros(len(head), np.int64)
            else:
                lang, first, second = head >> 2 * WORD_BITS, head >> WORD_BITS & mask, head & mask
            # Words hold no space, so a stripe travels as two texts: the next words, and their counts unless all are 1.
            places = pa.array((cut - cut[0]).astype(np.int32))
            following_words = pc.binary_join(pa.ListArray.from_arrays(places, names.take(pa.array(following[body]))), " ")
            counts = pc.binary_join(pa.ListArray.from_arrays(places, pa.array(often[body]).cast(pa.string())), " ")
            counts = pc.if_else(pa.array(np.maximum.reduceat(often[body], cut[:-1] - cut[0]) == 1), "", counts)
            columns = [langs.take(pa.array(lang)), names.take(pa.array(first)), pc.if_else(pa.array(second == 0), "", names.take(pa.array(second)))]
            columns += [pa.array(strip[cut[:-1]]), following_words, counts]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "first", "second", "strip", "stripe", "counts"])


PREFIX = ["lang", "first", "second", "strip"]


def _language(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"), filled("text").alias("text"))


def merged_stripes(docs: DataFrame, pairs: PairFilter | None = None, hot: frozenset[tuple[str, ...]] = frozenset()) -> DataFrame:
    """(lang, first, second, strip, next, n): the stripes of all tasks, merged element by element.

    Without ``pairs`` the prefixes have one word (``second`` is empty), and a null ``next`` is the end of a
    piece, so the counts of a prefix add up to its occurrences. With ``pairs`` they have two, and an entry is
    counted where both its first two and its last two words are let through. The stripe of a ``hot`` prefix is cut
    into strips by the hash of the next word, as many as there are shuffle partitions, so that it is merged in all of
    them; what is hot moves work only, and changes no count.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    strips = shuffle_width(spark)
    shared = spark.sparkContext.broadcast((pairs, hot))
    schema = "lang string, first string, second string, strip int, stripe string, counts string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = Stripes(strips, *shared.value)
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for low, high, data, offsets in chunks(batch.column("text"), PIECE_BYTES):
                counters.add(langs[low:high], data, offsets)
                yield from counters.taken()
        yield from counters.taken(last=True)

    rows = _language(docs).mapInArrow(run, schema).repartition(strips, *PREFIX)
    counts = F.when(F.col("counts") != "", F.split("counts", " ")).otherwise(F.array().cast("array<string>"))
    entries = rows.select(*PREFIX, F.inline(F.arrays_zip(F.split("stripe", " ").alias("next"), counts.alias("n"))))
    entries = entries.select(*PREFIX, F.nullif("next", F.lit(END)).alias("next"), F.coalesce(F.col("n").cast("long"), F.lit(1)).alias("n"))
    return entries.groupBy(*PREFIX, "next").agg(F.sum("n").alias("n"))


def hot_prefixes(docs: DataFrame) -> tuple[frozenset[tuple[str, ...]], frozenset[tuple[str, ...]]]:
    """(lang, word) and (lang, word, word) that a good share of a sample begins with: HOT times the number of partitions of each at most."""
    width = shuffle_width(docs.sparkSession)
    total = docs.count()
    wanted = SAMPLE_TEXTS + 2 * width
    sample = docs if total <= wanted else docs.sample(wanted / total, seed=7)
    entries = materialize(merged_stripes(sample), "sample")
    least = (entries.agg(F.sum("n")).first()[0] or 0) / (HOT * width)
    words = entries.groupBy("lang", "first").agg(F.sum("n").alias("n")).filter(F.col("n") > least).collect()
    pairs = entries.filter((F.col("n") > least) & F.col("next").isNotNull()).collect()
    return frozenset((r.lang, r.first) for r in words), frozenset((r.lang, r["first"], r["next"]) for r in pairs)


def counted_phrases(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lang, first, n) of every word that occurs ``least`` times, (lang, words, n) of such phrases of two or three, and (lang, n) of all words.

    Three words can only be as frequent as the two pairs in them, so the second
    reading counts only where the filter of the frequent pairs lets both through; its mistakes are cut
    by the exact count.
    """
    hot_words, hot_pairs = hot_prefixes(docs)
    merged = merged_stripes(docs, hot=hot_words).withColumn("next", F.when(F.col("n") >= least, F.col("next")))
    # The rare next words of a strip become one entry: it is still part of the prefix's total.
    ones = materialize(merged.groupBy(*PREFIX, "next").agg(F.sum("n").alias("n")).drop("second"), "stripes")
    pairs = ones.filter("next IS NOT NULL").select("lang", "first", F.col("next").alias("second"), "n")
    totals = materialize(ones.groupBy("lang", "first").agg(F.sum("n").alias("n")), "word-counts")
    threes = materialize(merged_stripes(docs, pair_filter(pairs), hot_pairs).filter(F.col("n") >= least), "extensions")
    phrases = pairs.select("lang", F.array("first", "second").alias("words"), "n")
    phrases = phrases.unionByName(threes.select("lang", F.array("first", "second", "next").alias("words"), "n"))
    return totals.filter(F.col("n") >= least), phrases, totals.groupBy("lang").agg(F.sum("n").alias("n"))


def score_of(a: Column, left: Column, right: Column) -> Column:
    """floor(1,000,000 a a / (left right)). Exact: counts have up to 15 digits, products up to 38, and the quotient is at most 1,000,000."""
    a, left, right = (x.cast("decimal(15,0)") for x in (a, left, right))
    return F.call_function("div", a * a * F.lit(1_000_000).cast("decimal(7,0)"), left * right)


def ranked(rows: DataFrame, most: int, width: int) -> DataFrame:
    """The first ``most`` rows of each language by score, count and phrase, with their rank.

    They are found in ``width`` parts of each language first, then in an eighth of so many, and so on, so that
    no task sorts more than eight times ``most`` rows that another one has sorted before.
    """
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(width)))
    while True:
        place = F.row_number().over(W.partitionBy("lang", "_part").orderBy(*order))
        rows = rows.withColumn("rank", place.cast("long")).filter(F.col("rank") <= most)
        if width == 1:
            return rows.drop("_part")
        width = -(-width // 8)
        rows = rows.withColumn("_part", F.pmod("_part", F.lit(width)))


def collocations(docs: DataFrame, least: int = 10, share: int = 50, most: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of two or three words of every language.

    Words and pieces: A-Z are lower-cased; breaks ``. , ; : ! ?`` and line ends part pieces, spaces and tabs
    part words. Candidates occur ``least`` times; each is scored at its weakest cut, the first one of equals; one goes
    when a longer candidate around it has ``share`` percent of its occurrences. A null lang counts as ``und``, a
    null or empty text has no words, rows that repeat count each, other columns are not looked at, an empty
    table (or a language without candidates) gives no rows. Words may have any length.
    """
    salt = F.pmod(F.xxhash64("phrase"), F.lit(shuffle_width(docs.sparkSession)))
    singles, counted, totals = counted_phrases(docs, least)
    counted = counted.select("lang", F.array_join("words", " ").alias("phrase"), "words", F.col("n").alias("a"))
    inner = F.array(F.slice("words", 1, 2), F.slice("words", 2, 2))
    around = counted.filter(F.size("words") == 3).select("lang", F.explode(inner).alias("words"), "a")
    around = around.groupBy("lang", F.array_join("words", " ").alias("phrase")).agg(F.max("a").alias("around"))
    kept = counted.join(around, ["lang", "phrase"], "left").filter(F.coalesce(F.col("around") * 100 < F.col("a") * share, F.lit(True)))
    kept = materialize(kept.select("lang", "phrase", "words", "a"), "candidates")
    # Counts of single words, and of the pairs in threes, come from tables of their own.
    ones = singles.select("lang", F.col("first").alias("part"), "n")
    twos = counted.filter(F.size("words") == 2).select("lang", F.col("phrase").alias("part"), F.col("a").alias("n"))
    cuts = kept.select("lang", "phrase", "words", "a", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    left, right = F.slice("words", F.lit(1), F.col("k")), F.slice("words", F.col("k") + 1, F.size("words"))
    sides = cuts.select("lang", "phrase", "a", "k", F.posexplode(F.array(F.array_join(left, " "), F.array_join(right, " "))).alias("side", "part"))
    single = ~F.col("part").contains(" ")
    sides = attach(sides.filter(single), ones, ["lang", "part"], salt).unionByName(attach(sides.filter(~single), twos, ["lang", "part"], salt))
    sides = sides.groupBy("lang", "phrase", "k").agg(
        F.max("a").alias("a"), F.max(F.when(F.col("side") == 0, F.col("n"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("n"))).alias("r")
    )
    weakest = F.min(F.struct(score_of(F.col("a"), F.col("l"), F.col("r")).alias("score"), "k", "l", "r")).alias("cut")
    scored = sides.groupBy("lang", "phrase").agg(F.max("a").alias("a"), weakest)
    best = ranked(scored.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"), most, shuffle_width(docs.sparkSession))
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
