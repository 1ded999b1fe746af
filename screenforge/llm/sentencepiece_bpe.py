"""SentencePiece BPE encoding and decoding by vectorised merge rounds."""

from __future__ import annotations

import codecs
import functools
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenforge.llm.common import bound_batches, chunks, filled, freeing, ragged

SPACE = "▁"
# Words of more symbols are merged pair by pair from a heap, as rounds over them would take time with the square of their length.
LONG_WORD = 64
# Words whose ids a worker keeps at a time.
KNOWN_WORDS = 200_000
NONE = np.int64(1 << 40)
codecs.register_error("one-per-byte", lambda e: ("�" * (e.end - e.start), e.end))


class PairTable:
    """A fixed set of 64-bit keys that arrays of keys are looked up in, by open addressing."""

    def __init__(self, keys: np.ndarray):
        self.bits = np.uint64(64 - max(12, int(len(keys)).bit_length() + 3))
        self.keys = np.full(1 << 64 - int(self.bits), -1, np.int64)
        self.at = np.full(len(self.keys), -1, np.int64)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = np.flatnonzero(self.keys[slot[left]] == -1)
            _, first = np.unique(slot[left[free]], return_index=True)
            put = left[free[first]]
            self.keys[slot[put]], self.at[slot[put]] = keys[put], put
            left = np.setdiff1d(left, put)
            slot[left] = (slot[left] + 1) % len(self.keys)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.bits).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Number of each key in the set, -1 if it isn't there."""
        slot = self._slot(keys)
        there = self.keys[slot]
        at = np.where(there == keys, self.at[slot], -1)
        left = np.flatnonzero((there != keys) & (there != -1))
        while len(left):
            slot[left] = (slot[left] + 1) % len(self.keys)
            there = self.keys[slot[left]]
            at[left] = np.where(there == keys[left], self.at[slot[left]], -1)
            left = left[(there != keys[left]) & (there != -1)]
        return at


class PieceModel:
    """The tables of a BPE model with byte fallback, no normalisation and a leading space.

    ``model``: the bytes of a sentencepiece model file. Symbols are numbered as pieces; characters
    that occur in pieces without being one get numbers above these, and fall back to bytes.
    """

    def __init__(self, model: bytes):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = library.get_piece_size()
        pieces = [library.id_to_piece(i) for i in range(n)]
        special = [library.is_control(i) or library.is_unknown(i) or library.is_byte(i) or library.is_unused(i) for i in range(n)]
        self.begin, self.end = library.bos_id(), library.eos_id()
        symbols = {p: i for i, p in enumerate(pieces) if not special[i]}
        pairs = {a + b for p in symbols for a, b in zip(p, p[1:])}
        if any(a != SPACE and b == SPACE for a, b in pairs):
            raise ValueError("pieces with an inner space are not supported")
        for c in sorted({c for p in symbols for c in p} - set(symbols)):
            symbols[c] = n + len(symbols)
        order = {s: r for r, s in enumerate(sorted({-library.get_score(i) for i in range(n) if not special[i]}))}
        rank_of = {p: order[-library.get_score(i)] for p, i in symbols.items() if i < n}
        shared = {r for r, c in zip(*np.unique(list(rank_of.values()), return_counts=True)) if c > 1}
        keys, ranks, made = [], [], []
        early = set()  # pieces that may be part of a piece which is merged before them
        for p, i in symbols.items():
            if i >= n:
                continue
            for cut in range(1, len(p)):
                left, right = p[:cut], p[cut:]
                if left in symbols and right in symbols:
                    keys.append(symbols[left] << 32 | symbols[right])
                    ranks.append(rank_of[p])
                    made.append(i)
                    for part in (left, right):
                        if len(part) > 1 and rank_of[part] >= rank_of[p]:
                            early.add(rank_of[part])
        self.pairs = PairTable(np.array(keys, np.int64))
        self.ranks, self.made = np.array([*ranks, NONE], np.int64), np.array([*made, -1], np.int64)  # last: no such pair
        # A rank of which all pairs in a word may be merged at once, without changing what comes next.
        self.at_once = np.ones(len(order) + 1, bool)
        self.at_once[list(early | shared)] = False
        self.symbol = np.full(0x110000, -1, np.int64)  # by code point
        for p, i in symbols.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        self.joined = PairTable(np.array([ord(p[0]) << 32 | ord(p[1]) for p in pairs], np.int64))
        self.bytes = np.array([library.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        surface = [p.replace(SPACE, " ").encode() for p in pieces]
        for i in range(n):
            if library.is_byte(i):
                surface[i] = bytes([int(pieces[i][3:5], 16)])
            elif library.is_control(i):
                surface[i] = b""
            elif library.is_unknown(i):
                surface[i] = " ⁇ ".encode()
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.surface_size = np.array([len(s) for s in surface], np.int64)
        self.surface_at = np.cumsum(self.surface_size) - self.surface_size
        self.size = n
        self.by_pair: dict[int, tuple[int, int]] | None = None  # made when a long word is met
        self.forget()

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair; NONE where there is no such piece."""
        at = self.pairs.find(left << 32 | right)
        return self.ranks[at], self.made[at]

    def merged(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge the symbols of many words at once. ``word``: the ascending number of each symbol's word.

        Every round looks for the lowest pair rank of each word and merges the leftmost pair with it,
        or, where this can't change the outcome, all of them from the left; then it closes the gaps.
        Words that have no pair left are set aside.
        """
        done_symbols, done_words = [], []
        while len(symbols):
            rank, made = np.full(len(symbols), NONE), np.full(len(symbols), -1)
            inner = np.flatnonzero(word[1:] == word[:-1])
            rank[inner], made[inner] = self._pairs(symbols[inner], symbols[inner + 1])
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            size = np.diff(np.r_[first, len(word)])
            lowest = np.minimum.reduceat(rank, first)
            over = lowest == NONE
            if over.any():
                out = np.repeat(over, size)
                done_symbols.append(symbols[out])
                done_words.append(word[out])
                symbols, word, rank, made = symbols[~out], word[~out], rank[~out], made[~out]
                size, lowest = size[~over], lowest[~over]
                if not len(symbols):
                    break
            hit = np.flatnonzero(rank == np.repeat(lowest, size))
            mine = word[hit]
            new_word = np.r_[True, mine[1:] != mine[:-1]]
            at_once = self.at_once[rank[hit]]
            # In a row of overlapping pairs (a a a a) every second is merged, counted from the left.
            start = new_word | np.r_[True, np.diff(hit) > 1]
            place = np.arange(len(hit)) - np.maximum.accumulate(np.where(start, np.arange(len(hit)), 0))
            hit = hit[new_word | at_once & (place % 2 == 0)]
            symbols = symbols.copy()
            symbols[hit] = made[hit]
            stay = np.ones(len(symbols), bool)
            stay[hit + 1] = False
            symbols, word = symbols[stay], word[stay]
        if not done_symbols:
            return symbols, word
        symbols, word = np.concatenate(done_symbols), np.concatenate(done_words)
        by = np.argsort(word, kind="stable")
        return symbols[by], word[by]

    def merged_long(self, symbols: list[int]) -> list[int]:
        """Merge the symbols of one long word: always the leftmost pair of the lowest rank, from a heap."""
        if self.by_pair is None:
            there = self.pairs.keys != -1
            at = self.pairs.at[there]
            self.by_pair = dict(zip(self.pairs.keys[there].tolist(), zip(self.ranks[at].tolist(), self.made[at].tolist())))
        get = self.by_pair.get
        after, before = [*range(1, len(symbols)), -1], [*range(-1, len(symbols) - 1)]
        heap = []
        for i, (a, b) in enumerate(zip(symbols, symbols[1:])):
            if found := get(a << 32 | b):
                heap.append((found[0], i, a, b, found[1]))
        heapq.heapify(heap)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j < 0 or symbols[j] != b:
                continue  # one of them has been merged since
            symbols[i], symbols[j] = made, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (found := get(symbols[x] << 32 | symbols[y])):
                    heapq.heappush(heap, (found[0], x, symbols[x], symbols[y], found[1]))
        return [x for x in symbols if x >= 0]

    def merged_all(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`merged`, long words apart."""
        long = np.bincount(word)[word] > LONG_WORD if len(word) else np.zeros(0, bool)
        if not long.any():
            return self.merged(symbols, word)
        done = [self.merged(symbols[~long], word[~long])]
        edge = np.flatnonzero(np.r_[True, np.diff(word[long]) != 0, True])
        for low, high in zip(edge[:-1], edge[1:]):
            ids = np.array(self.merged_long(symbols[long][low:high].tolist()), np.int64)
            done.append((ids, np.full(len(ids), word[long][low])))
        symbols, word = (np.concatenate(x) for x in zip(*done))
        by = np.argsort(word, kind="stable")
        return symbols[by], word[by]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each word one after the other, and how many each has."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        if not len(points):
            return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
        points = np.where(points == 32, ord(SPACE), points)
        owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
        # Two characters that stand side by side in no piece are never merged: part words there.
        joined = self.joined.find(points[:-1] << 32 | points[1:]) >= 0
        part = np.cumsum(np.r_[True, ~joined | (owner[1:] != owner[:-1])]) - 1
        owner_of_part = owner[np.flatnonzero(np.r_[True, part[1:] != part[:-1]])]
        symbols = self.symbol[points]
        symbols = np.where(symbols < 0, -1 - points, symbols)  # unknown characters keep their code point
        known = symbols >= 0
        if known.all():
            ids, part = self.merged_all(symbols, part)
        else:
            ids, parts = self.merged_all(symbols[known], part[known])
            ids, part = np.r_[ids, symbols[~known]], np.r_[parts, part[~known]]
            by = np.argsort(part, kind="stable")
            ids, part = ids[by], part[by]
        odd = (ids < 0) | (ids >= self.size)
        owner = owner_of_part[part]
        if odd.any():  # byte fallback
            names = {v: k for k, v in enumerate(self.symbol.tolist()) if v >= self.size} if (ids >= self.size).any() else {}
            spelled = [list(chr(-1 - i if i < 0 else names[i]).encode()) for i in ids[odd].tolist()]
            count = np.ones(len(ids), np.int64)
            count[odd] = [len(s) for s in spelled]
            filled_in = np.repeat(odd, count)
            ids, owner = np.repeat(ids, count), np.repeat(owner, count)
            ids[filled_in] = self.bytes[[b for s in spelled for b in s]]
        return ids, np.bincount(owner, minlength=len(words))

    def forget(self) -> None:
        """Empty the store, so that a worker that is kept between tasks holds only the model's tables."""
        self.known, self.ids, self.at, self.count = {}, *(np.zeros(0, np.int64) for _ in range(3))

    def looked_up(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A store of ids, and start and length of each word's ids in it.

        The store keeps the words of earlier pieces. It begins anew before it gets too large.
        """
        if len(self.known) + len(words) > KNOWN_WORDS or len(self.ids) > 8 * KNOWN_WORDS:
            self.forget()
        before = len(self.known)
        place = np.array([self.known.setdefault(w, len(self.known)) for w in words], np.int64)
        if len(self.known) > before:
            ids, count = self.encode_words([words[i] for i in np.flatnonzero(place >= before)])
            self.at = np.r_[self.at, len(self.ids) + np.cumsum(count) - count]
            self.ids, self.count = np.r_[self.ids, ids], np.r_[self.count, count]
        return self.ids, self.at[place], self.count[place]

    def encode(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids with begin and end of a column of texts, piece by piece: flat ids, number of ids of each text."""
        column = pc.replace_substring(column, SPACE, " ")  # the model makes no difference between them
        column = pc.if_else(pc.equal(pc.binary_length(column), 0), "", pc.binary_join_element_wise(" ", column, ""))
        for _, _, data, offsets in chunks(column):
            ends = offsets[1:]
            space = data == 32
            begins = np.zeros(len(data), bool)
            begins[1:] = space[1:] & ~space[:-1]
            begins[offsets[:-1][offsets[:-1] < ends]] = True
            starts = np.flatnonzero(begins)
            edges = np.r_[starts, len(data)].astype(np.int32)
            words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(edges), pa.py_buffer(data)).dictionary_encode()
            ids, at, count = self.looked_up(words.dictionary.to_numpy(zero_copy_only=False).tolist())
            which = words.indices.to_numpy()
            flat = ids[ragged(at[which], count[which])]
            upto = np.r_[0, np.cumsum(count[which])]
            edge = upto[np.searchsorted(starts, np.r_[0, ends])]
            number = np.diff(edge)
            out = np.empty(len(flat) + 2 * len(number), np.int64)
            first = edge[:-1] + 2 * np.arange(len(number))
            out[first], out[first + number + 1] = self.begin, self.end
            out[np.arange(len(flat)) + np.repeat(2 * np.arange(len(number)) + 1, number)] = flat
            yield out, number + 2

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: begin and end are nothing, the leading space of the first piece goes."""
        body = self.surface[ragged(self.surface_at[ids], self.surface_size[ids])].tobytes()
        shown = ids[self.surface_size[ids] > 0]
        if len(shown) and shown[0] not in self.bytes and shown[0] != 0 and body.startswith(b" "):
            body = body[1:]
        return body.decode("utf-8", "one-per-byte")


@functools.lru_cache(maxsize=2)
def _model(content: bytes) -> PieceModel:
    return PieceModel(content)


def encode_and_decode(docs: DataFrame, model_path: str, with_values: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row, and with ``with_values`` ids and decoded.

    A null text counts as empty: its ids are begin and end, its decoded text is empty. Rows that
    repeat are encoded each for itself; a null doc_id stays null; other columns are not looked at;
    an empty table gives no rows. Texts are encoded whole, whatever their length.
    The model file (a fixed vocabulary) is read by the driver and travels with the code.
    """
    bound_batches(docs.sparkSession)
    with open(model_path, "rb") as file:
        content = file.read()
    shared = docs.sparkSession.sparkContext.broadcast(content)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>, decoded string" if with_values else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared.value)
        names = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
        if with_values:
            names = names.append(pa.field("ids", pa.list_(pa.int32()))).append(pa.field("decoded", pa.string()))
        for batch in batches:
            row = 0
            for flat, number in model.encode(batch.column("text")):
                columns = [[] for _ in names]
                edge = np.r_[0, np.cumsum(number)]
                for low, high in zip(edge[:-1].tolist(), edge[1:].tolist()):
                    ids = flat[low:high]
                    decoded = model.decode(ids)
                    values = [high - low, hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()]
                    for column, value in zip(columns[1:], [*values, ids.astype(np.int32), decoded] if with_values else values):
                        column.append(value)
                columns[0] = batch.column("doc_id").slice(row, len(number))
                row += len(number)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if isinstance(c, list) else c for c, f in zip(columns, names)], schema=names)
        model.forget()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), filled("text").alias("text")).mapInArrow(freeing(run), schema)
