"""Alignment of two tokenizers' tokens by byte offsets, with corpus-wide counts of linked id pairs."""

from __future__ import annotations

import functools
import hashlib
import itertools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenforge.llm.common import attach, bound_batches, chunks, filled, freeing, ragged, shuffle_width
from screenforge.operators.joins import is_small
from screenforge.session import materialize

# Texts are tokenised and aligned about so many bytes at a time.
PIECE_BYTES = 1 << 20
# Before a space between two of these characters both tokenizers begin a token, whatever stands around them.
SAFE_CUT = re.compile("(?<=[!-~]) (?=[!-~])")
# The stores of words and of aligned windows begin anew beyond so many, or eight times as many ids or pairs.
KNOWN_WINDOWS = 200_000
WORDS_A_CALL = 256
# A group with more links is counted by its distinct ids.
MANY_LINKS = 1 << 10
# So many id pairs (17 bytes each) may be broadcast.
BROADCAST_PAIRS = 1_000_000


def byte_of_character() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the others from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Surface:
    """The bytes of every token of a vocabulary, looked up for arrays of ids."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.marked = np.array([t.startswith(b" ") for t in tokens], bool)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.data[ragged(self.at[ids], self.size[ids])]


# Two ids in one number: half of its bits each, and for sorting by an owner as well so few that the owner fits in above.
HALF = 32
ID_BITS = 20


def counted_pairs(owner: np.ndarray, pairs: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs of each owner in order, and how often each is there."""
    if not len(pairs):
        return owner, pairs, often
    key = (owner << 2 * ID_BITS) | (pairs >> HALF) << ID_BITS | (pairs & (1 << ID_BITS) - 1)
    by = np.argsort(key)
    key = key[by]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    by_first = by[first]
    return owner[by_first], pairs[by_first], np.add.reduceat(often[by], first)


class Numbered(dict):
    """Numbers for keys, in the order in which they are first looked up."""

    def __missing__(self, key) -> int:
        number = self[key] = len(self)
        return number


class Aligner:
    """Tokenises texts twice, and splits their tokens into groups at the byte offsets where both end."""

    def __init__(self, byte_level: str, pieces: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(byte_level)
        self.a.encode_special_tokens = True
        byte = byte_of_character()
        names = {i: token for token, i in self.a.get_vocab().items()}
        special = {i for i, token in self.a.get_added_tokens_decoder().items()}
        self.a_bytes = Surface(
            [b"" if i in special or i not in names else bytes(byte[c] for c in names[i]) for i in range(max(names) + 1)]
        )
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        surface = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            if self.b.is_byte(i):
                surface.append(bytes([int(piece[3:5], 16)]))
            elif self.b.is_control(i) or self.b.is_unknown(i):
                surface.append(b"")
            else:
                surface.append(piece.replace("▁", " ").encode())
        self.b_bytes = Surface(surface)
        self.decimals = Surface([b"%d," % i for i in range(max(len(surface), max(names) + 1))])
        self.forget_words()
        self.forget()

    def forget_words(self) -> None:
        self.words = Numbered()
        self.word_good = np.zeros(0, bool)
        self.word_ids = [np.zeros(0, np.int32), np.zeros(0, np.int32)]
        self.word_at = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.word_size = [np.zeros(0, np.int64), np.zeros(0, np.int64)]

    def forget(self) -> None:
        self.known = Numbered()
        self.shown: list[bytes] = []
        self.n_groups, self.n_links, self.n_pairs, self.linked, self.often = (np.zeros(0, np.int64) for _ in range(5))

    def tokenised(self, texts: list[str]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Whether both tokenizers spell space + text, and flat ids and number of ids of each text by both of them.

        Texts are cut where no token of either can reach across, and words met before are looked up. A cut-off space
        comes back in front of the word: of itself in the second vocabulary, and put there for the first one. Tokens
        never spell more than their word, so a text is spelled right if all its words are.
        """
        parts = [SAFE_CUT.split(text) for text in texts]
        if len(self.words) > KNOWN_WINDOWS or len(self.word_ids[0]) > 8 * KNOWN_WINDOWS:
            self.forget_words()
        before, known = len(self.words), self.words
        place = np.array(list(map(known.__getitem__, itertools.chain.from_iterable(parts))), np.int64)
        if len(known) > before:
            new = list(itertools.islice(known, before, None))
            ids = self.b.encode(new, num_threads=1)
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            by_b = np.fromiter(itertools.chain.from_iterable(ids), np.int32, int(size.sum())), size
            by_a = self._spaced(new)
            self.word_good = np.r_[self.word_good, self.spelled(new, (self.a_bytes, *by_a), (self.b_bytes, *by_b))]
            for side, (flat, size) in enumerate((by_a, by_b)):
                self.word_at[side] = np.r_[self.word_at[side], len(self.word_ids[side]) + np.cumsum(size) - size]
                self.word_ids[side] = np.r_[self.word_ids[side], flat]
                self.word_size[side] = np.r_[self.word_size[side], size]
        first = np.cumsum([0, *(len(words) for words in parts[:-1])])
        found = []
        for ids, at, size in zip(self.word_ids, self.word_at, self.word_size):
            found.append((ids[ragged(at[place], size[place])], np.add.reduceat(size[place], first)))
        return np.logical_and.reduceat(self.word_good[place], first), found

    @staticmethod
    def spelled(words: list[str], *sides: tuple[Surface, np.ndarray, np.ndarray]) -> np.ndarray:
        """Whether the tokens of each word spell space + word, on all sides."""
        spaced = [b" " + w.encode() for w in words]
        length = np.array(list(map(len, spaced)), np.int64)
        want, at = np.frombuffer(b"".join(spaced), np.uint8), np.cumsum(length) - length
        good = np.ones(len(words), bool)
        for surface, ids, count in sides:
            owner = np.repeat(np.arange(len(words)), count)
            good &= np.bincount(owner, surface.size[ids], len(words)).astype(np.int64) == length
            body = surface.joined(ids[good[owner]])
            different = np.flatnonzero(body != want[ragged(at[good], length[good])])
            if len(different):
                good[np.flatnonzero(good)[np.searchsorted(np.cumsum(length[good]), different, side="right")]] = False
        return good

    def _spaced(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of space + word in the first vocabulary, and their number. Words that are safe to put together are, as calls cost more than words."""
        safe = [bool(w) and "!" <= w[0] <= "~" and "!" <= w[-1] <= "~" for w in words]
        joined = [w for w, ok in zip(words, safe) if ok]
        lines = [" " + " ".join(joined[i : i + WORDS_A_CALL]) for i in range(0, len(joined), WORDS_A_CALL)]
        lines += [" " + w for w, ok in zip(words, safe) if not ok]
        ids = [e.ids for e in self.a.encode_batch_fast(lines, add_special_tokens=False)]
        flat = np.fromiter(itertools.chain.from_iterable(ids), np.int32, sum(map(len, ids)))
        order = np.argsort(~np.array(safe), kind="stable")  # as in the lines
        ends = np.cumsum(np.array([len(w.encode()) + 1 for w in words], np.int64)[order])
        edge = np.r_[0, np.searchsorted(np.cumsum(self.a_bytes.size[flat]), ends, side="right")]
        size, at = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        size[order], at[order] = np.diff(edge), edge[:-1]
        return flat[ragged(at, size)], size

    def keep(self, a_ids: np.ndarray, a_size: np.ndarray, b_ids: np.ndarray, b_size: np.ndarray) -> None:
        """Align new windows, all at once, and store the results. ``a_size``, ``b_size``: number of ids of each window."""
        a_end, b_end = np.cumsum(self.a_bytes.size[a_ids]), np.cumsum(self.b_bytes.size[b_ids])
        ends = np.intersect1d(a_end, b_end, assume_unique=True)
        a_group, b_group = np.searchsorted(ends, a_end), np.searchsorted(ends, b_end)
        a_in, b_in = np.bincount(a_group, minlength=len(ends)), np.bincount(b_group, minlength=len(ends))
        window = np.searchsorted(a_end[np.cumsum(a_size) - 1], ends)
        n_groups = np.bincount(window, minlength=len(a_size))
        links = a_in * b_in
        n_links = np.zeros(len(a_size), np.int64)
        np.add.at(n_links, window, links)
        # As text: the ids of the first side of a group, those of the second, the next group; each with the sign that follows.
        a_place, b_place = np.arange(len(a_ids)) + (np.cumsum(b_in) - b_in)[a_group], np.arange(len(b_ids)) + np.cumsum(a_in)[b_group]
        ids = np.empty(len(a_ids) + len(b_ids), np.int64)
        ids[a_place], ids[b_place] = a_ids, b_ids
        upto = np.cumsum(self.decimals.size[ids])
        text = self.decimals.joined(ids)
        text[upto[a_place[np.cumsum(a_in) - 1]] - 1] = ord("|")
        text[upto[b_place[np.cumsum(b_in) - 1]] - 1] = ord(";")
        text, last = text.tobytes(), upto[np.cumsum(a_size + b_size) - 1].tolist()
        # All pairs within small groups; large ones by their distinct ids, each counted.
        few = links <= MANY_LINKS
        mine = np.flatnonzero(few[a_group])
        other = b_in[a_group[mine]]
        pairs = np.repeat(a_ids[mine].astype(np.int64) << HALF, other) | b_ids[ragged((np.cumsum(b_in) - b_in)[a_group[mine]], other)]
        owner, often = np.repeat(window[a_group[mine]], other), np.ones(len(pairs), np.int64)
        for g in np.flatnonzero(~few):
            left, times = np.unique(a_ids[a_group == g].astype(np.int64), return_counts=True)
            right, more = np.unique(b_ids[b_group == g].astype(np.int64), return_counts=True)
            pairs = np.r_[pairs, (left[:, None] << HALF | right[None, :]).ravel()]
            often = np.r_[often, (times[:, None] * more[None, :]).ravel()]
            owner = np.r_[owner, np.full(len(left) * len(right), window[g])]
        owner, pairs, often = counted_pairs(owner, pairs, often)
        self.shown += [text[x:y] for x, y in zip([0, *last], last)]
        new = (n_groups, n_links, np.bincount(owner, minlength=len(a_size)), pairs, often)
        old = (self.n_groups, self.n_links, self.n_pairs, self.linked, self.often)
        self.n_groups, self.n_links, self.n_pairs, self.linked, self.often = (np.r_[x, y] for x, y in zip(old, new))

    def windows(self, a_ids: np.ndarray, a_at: np.ndarray, b_ids: np.ndarray, b_at: np.ndarray) -> np.ndarray:
        """The store's number of every window: ids from one place of ``a_at`` and ``b_at`` to the next. New id tuples are aligned."""
        known, before = self.known, len(self.known)
        # The ids of a window one after the other, those of the second vocabulary marked by a bit, are its key.
        a_size, b_size = np.diff(a_at), np.diff(b_at)
        both = np.empty(len(a_ids) + len(b_ids), "<i4")
        both[np.arange(len(a_ids)) + np.repeat(b_at[:-1], a_size)] = a_ids
        both[np.arange(len(b_ids)) + np.repeat(a_at[1:], b_size)] = b_ids | 1 << ID_BITS
        raw, edge = both.tobytes(), (4 * (a_at + b_at)).tolist()
        found = np.array(list(map(known.__getitem__, [raw[x:y] for x, y in zip(edge, edge[1:])])), np.int64)
        if len(known) > before:
            new = np.flatnonzero(found >= before)
            _, first = np.unique(found[new], return_index=True)
            new = new[first]
            a_size, b_size = a_at[new + 1] - a_at[new], b_at[new + 1] - b_at[new]
            self.keep(a_ids[ragged(a_at[new], a_size)], a_size, b_ids[ragged(b_at[new], b_size)], b_size)
        return found

    def rows(self, column: pa.Array) -> Iterator[tuple[int, int, list]]:
        """Per piece of a column without nulls: first row, last row + 1, and the values of n_a to often as lists."""
        for low, high, _, offsets in chunks(column, PIECE_BYTES):
            if len(self.shown) > KNOWN_WINDOWS or len(self.linked) > 8 * KNOWN_WINDOWS:
                self.forget()
            yield low, high, self._piece(column.slice(low, high - low).to_pylist(), offsets)

    def _piece(self, texts: list[str], offsets: np.ndarray) -> list:
        n = len(texts)
        good, ((a, a_count), (b, b_count)) = self.tokenised(texts)
        good &= np.diff(offsets) > 0
        owner_a, owner_b = np.repeat(np.arange(n), a_count), np.repeat(np.arange(n), b_count)
        if not good.all():
            a, b, owner_a, owner_b = a[good[owner_a]], b[good[owner_b]], owner_a[good[owner_a]], owner_b[good[owner_b]]
        a_size, b_size = self.a_bytes.size[a], self.b_bytes.size[b]
        a_start, b_start = np.cumsum(a_size) - a_size, np.cumsum(b_size) - b_size
        # Both tokenizers begin a token with a space at these offsets; the first token of each text is among them.
        anchors = np.intersect1d(a_start[self.a_bytes.marked[a]], b_start[self.b_bytes.marked[b]], assume_unique=True)
        a_at, b_at = np.searchsorted(a_start, anchors), np.searchsorted(b_start, anchors)
        which = self.windows(a, np.r_[a_at, len(a)], b, np.r_[b_at, len(b)]) if len(anchors) else np.zeros(0, np.int64)
        document = owner_a[a_at]
        groups = np.bincount(document, self.n_groups[which], n).astype(np.int64)
        links = np.zeros(n, np.int64)
        np.add.at(links, document, self.n_links[which])
        edge = np.searchsorted(document, np.arange(n + 1)).tolist()
        shown = self.shown
        texts = [b"".join([shown[w] for w in which[x:y].tolist()])[:-1] for x, y in zip(edge, edge[1:])]
        # Distinct pairs of each text, and how often they are linked in it.
        size = self.n_pairs[which]
        at = ragged((np.cumsum(self.n_pairs) - self.n_pairs)[which], size)
        owner, pairs, often = counted_pairs(np.repeat(document, size), self.linked[at], self.often[at])
        lists = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
        counts = [np.bincount(owner_a, minlength=n), np.bincount(owner_b, minlength=n), groups, links]
        columns = [pa.array(c.astype(np.int64)) for c in counts]
        digests = [hashlib.sha256(t).hexdigest() if ok else "" for t, ok in zip(texts, good.tolist())]
        columns += [pa.array(texts, pa.binary()), pa.array(digests, pa.string())]
        return columns + [pa.ListArray.from_arrays(pa.array(lists), pa.array(v)) for v in (pairs, often)]


@functools.lru_cache(maxsize=2)
def _aligner(byte_level: str, pieces: bytes) -> Aligner:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return Aligner(byte_level, pieces)


def aligned(docs: DataFrame, byte_level_path: str, piece_path: str, with_groups: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, often of every row, and with ``with_groups`` groups.

    ``pairs``: the distinct linked id pairs, as first id * 2**32 + second id; ``often``: the links of each.
    The files are fixed vocabularies; the driver reads them and they travel with the code.
    """
    bound_batches(docs.sparkSession)
    with open(byte_level_path, encoding="utf-8") as one, open(piece_path, "rb") as two:
        shared = docs.sparkSession.sparkContext.broadcast((one.read(), two.read()))
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, often array<long>"
    schema += ", groups string" if with_groups else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(*shared.value)
        for batch in batches:
            for low, high, (*counts, groups, digests, pairs, often) in aligner.rows(batch.column("text")):
                columns = [batch.column("doc_id").slice(low, high - low), *counts, digests, pairs, often, *([groups.cast(pa.string())] if with_groups else [])]
                names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "often", "groups"]
                yield pa.RecordBatch.from_arrays(columns, names=names[: len(columns)])
        aligner.forget()
        aligner.forget_words()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), filled("text").alias("text")).mapInArrow(freeing(run), schema)


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n, is_best): how many rows of :func:`aligned` hold a pair, and whether no pair of its first id has more."""
    counts = rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    counts = materialize(counts.withColumn("a", F.shiftright("pair", 32)), "pair-counts")
    most = counts.groupBy("a").agg(F.max("n").alias("most"))  # at most one row per id of the first vocabulary
    return counts.join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("is_best"))


def alignment(docs: DataFrame, byte_level_path: str, piece_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of ``docs``.

    A null or empty text, or one whose tokens do not spell space + text in both vocabularies, has
    zeros and an empty digest. Every row counts as a document of its own, also where rows repeat; a
    null doc_id stays null; other columns are not looked at; an empty table gives no rows. Texts are
    tokenised whole, by words whose tokens are the same apart. A group without a shared offset inside links all its tokens, so a text of many different ids in
    one group has as many distinct pairs as their product.
    """
    rows = aligned(docs, byte_level_path, piece_path).withColumn("row", F.monotonically_increasing_id())
    rows = materialize(rows, "aligned")
    counts = materialize(pair_counts(rows), "pairs")
    links = rows.select("row", F.explode(F.arrays_zip("pairs", "often")).alias("link")).select("row", F.col("link.pairs").alias("pair"), "link.often")
    if is_small(counts, BROADCAST_PAIRS):
        links = links.join(F.broadcast(counts), "pair")
    else:
        links = attach(links, counts, ["pair"], F.pmod(F.xxhash64("row"), F.lit(shuffle_width(docs.sparkSession))))
    sums = links.groupBy("row").agg(
        F.sum(F.when(F.col("is_best"), F.col("often")).otherwise(0)).alias("n_best"), F.sum(F.col("often") * F.col("n")).alias("count_sum")
    )
    none = F.lit(0).cast("long")
    return rows.join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", none).alias("n_best"), F.coalesce("count_sum", none).alias("count_sum"), "groups_sha256"
    )
