"""Secrets in texts: fixed patterns, and values in a credential's place that would take many guesses."""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenforge.llm.common import bound_batches, filled

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)|pwd|secret|token|credentials?|(?:api|access|private|auth)[_-]?key)["']?[\x20\t]*(?:=>|:=|[:=])[\x20\t]*["']?([^\s"'<>,;]{6,})""",
    re.ASCII | re.IGNORECASE,
)
# Every match of ASSIGN and CONTEXT has one of these, in lower case.
KEYWORDS = ("pass", "pwd", "secret", "token", "credential", "key")
KINDS = ("assign", "access", "hex", "guess")

# Frequent passwords and their parts, most frequent first. The words that scan() counts come after them.
WORDS = (
    "password pass 123456 qwerty admin letmein welcome monkey dragon master login abc123 iloveyou secret sunshine princess football "
    "baseball shadow superman batman trustno1 hunter killer michael jordan test user guest root default changeme example sample demo "
    "none null true false your here the and for with from this that token key value access server database mysql oracle system "
    "summer winter spring autumn monday friday january june july hello love money freedom ginger cookie pepper computer internet"
).split()
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
LEET = str.maketrans("4@310$5!7", "aaeiossit")
YEAR = re.compile(r"(?:19|20)\d\d", re.ASCII)
DATES = (
    re.compile(r"(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])", re.ASCII),
    re.compile(r"(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\1(?:19|20)\d\d", re.ASCII),
)
# Words of the documents that count as guessable: the most frequent ones, with so many occurrences at least, of so many letters.
MOST_WORDS, LEAST_TIMES, WORD_LETTERS = 20_000, 10, (3, 20)
# What repeats within a value has so many characters at most, in values of any length: a longer unit takes over 200 bits by itself.
REPEAT_UNIT = 64


def _neighbours() -> dict[str, set[str]]:
    """Keys that touch: side by side, or above and below with each row half a key further right."""
    at = {c: (2 * x + y, y) for y, row in enumerate(ROWS) for x, c in enumerate(row)}
    return {a: {b for b, (u, v) in at.items() if (abs(u - x), abs(v - y)) in ((2, 0), (1, 1))} for a, (x, y) in at.items()}


class GuessCost:
    """How many guesses a value takes if it is guessed part by part, in bits."""

    def __init__(self, words: Sequence[str] = WORDS, longest_unit: int = REPEAT_UNIT):
        self.longest_unit = longest_unit
        self.rank = {}
        for i, word in enumerate(words):
            self.rank.setdefault(word.lower(), i + 2)
        self.longest = max(map(len, self.rank), default=0)
        self.keys = _neighbours()

    def _single(self, c: str) -> float:
        return math.log2(10 if c.isdigit() else 26 if c.isalpha() else 33)

    def _step(self, a: str, b: str):
        """The way from a key to one that touches it."""
        return (ord(b) - ord(a)) if a.isdigit() and b.isdigit() else [(r, row.find(b) - row.find(a)) for r, row in enumerate(ROWS) if b in row]

    def _walk_ends(self, value: str, start: int) -> Iterator[tuple[int, float]]:
        """Ends of keyboard walks of three keys or more from ``start``, and their bits."""
        turns, last = 0, None
        for i in range(start + 1, len(value)):
            a, b = value[i - 1].lower(), value[i].lower()
            if b not in self.keys.get(a, ()):
                return
            step = self._step(a, b)
            turns += step != last
            last = step
            if i - start >= 2:
                yield i + 1, math.log2(len(self.keys)) + turns * math.log2(4.6) + math.log2(i + 1 - start)

    def _walk_steps(self, value: str) -> tuple[list[int], list[int]]:
        """For every character where the keyboard walk through it began, and how often that walk has turned up to it."""
        begun, turned, last = list(range(len(value))), [0] * len(value), None
        for i in range(1, len(value)):
            a, b = value[i - 1].lower(), value[i].lower()
            if b in self.keys.get(a, ()):
                step = self._step(a, b)
                begun[i], turned[i] = begun[i - 1], turned[i - 1] + (begun[i - 1] < i - 1 and step != last)
                last = step
        return begun, turned

    def _repeats(self, value: str) -> list[tuple[int, int, int]]:
        """(first end, last end, unit) of the longest stretches that repeat a unit, which itself is no repeat, by first end."""
        codes, found = np.frombuffer(value.encode("utf-32-le", "surrogatepass"), np.uint32), []
        for unit in range(1, min(self.longest_unit, len(value) // 2) + 1):
            same = codes[:-unit] == codes[unit:]
            if not same.any():
                continue
            turns = np.flatnonzero(np.diff(same.astype(np.int8), prepend=0, append=0))
            for start, end in zip(turns[::2].tolist(), turns[1::2].tolist()):
                part = value[start : start + unit]
                if end - start >= max(unit, 2) and (part + part).find(part, 1) == unit:
                    found.append((start + max(2 * unit, 3), end + unit, unit))
        return sorted(found)

    def _word_ends(self, value: str, start: int, forms: tuple[tuple[str, int], ...]) -> Iterator[tuple[int, float]]:
        for size in range(2, min(self.longest, len(value) - start) + 1):
            for form, extra in forms:
                rank = self.rank.get(form[start : start + size])
                if rank:
                    yield start + size, math.log2(rank) + extra + (value[start : start + size] != forms[0][0][start : start + size])

    def _date_ends(self, value: str, start: int) -> Iterator[tuple[int, float]]:
        if YEAR.match(value, start):
            yield start + 4, math.log2(60)
        for pattern in DATES:
            if m := pattern.match(value, start):
                yield m.end(), math.log2(365 * 60)

    def bits(self, value: str) -> float:
        """The least sum of bits over all ways to cut ``value`` into parts and brute-force spans; each costs one more bit.

        Best costs are kept per prefix, apart for those that end in a brute-force span, which goes on without another extra bit.
        Of the starts of a walk or repeat only those are kept that are best for some end, so long ones take time in proportion.
        """
        plain, lower = value.lower().translate(LEET), value.lower()
        if len(lower) != len(value):  # a letter whose lower case has two
            plain = lower = value
        forms = ((lower, 0), (plain, 1))
        single = [self._single(c) for c in value]
        sums = [0.0, *itertools.accumulate(single)]
        begun, turned = self._walk_steps(value)
        turn, walks, walk_from = math.log2(4.6), _Starts(), -1
        repeats, active = self._repeats(value)[::-1], []
        best = [math.inf] * (len(value) + 1)  # the prefix ends with a part
        brute = [math.inf] * (len(value) + 1)  # it ends inside a brute-force span
        at = [0.0] * (len(value) + 1)
        best[0] = 0.0
        for i in range(len(value) + 1):
            if i >= 3 and begun[i - 1] <= i - 3:
                if walk_from != begun[i - 1]:
                    walks, walk_from = _Starts(), begun[i - 1]
                walks.add(i - 3, at[i - 3] + 1 + math.log2(len(self.keys)) + (1 - turned[i - 2]) * turn)
                best[i] = min(best[i], walks.least(i) + turned[i - 1] * turn)
            while repeats and repeats[-1][0] == i:
                _, last, unit = repeats.pop()
                active.append((last, unit, [_Starts() for _ in range(unit)]))
            active = [run for run in active if run[0] >= i]
            for _, unit, starts in active:
                start = i - max(2 * unit, 3)
                starts[i % unit].add(start, at[start] + 1 + sums[start + unit] - sums[start] - math.log2(unit))
                best[i] = min(best[i], starts[i % unit].least(i))
            at[i] = min(best[i], brute[i])
            if i < len(value):
                brute[i + 1] = min(best[i] + 1, brute[i]) + single[i]
                for end, cost in (*self._word_ends(value, i, forms), *self._date_ends(value, i)):
                    best[end] = min(best[end], at[i] + 1 + cost)
        return at[-1]


class _Starts:
    """Starts of parts whose bits grow with log2 of their length; those that are the best for some end to come."""

    def __init__(self):
        self.kept: list[tuple[int, float]] = []  # start and the bits without that of the length, both ascending

    def add(self, start: int, bits: float) -> None:
        """A later start. An earlier one is longer, so it is worth keeping only with fewer bits."""
        while self.kept and self.kept[-1][1] >= bits:
            self.kept.pop()
        self.kept.append((start, bits))

    def least(self, end: int) -> float:
        """The least bits of a part up to ``end``. A start that an earlier one has caught up with stays behind it."""
        low, kept = math.inf, []
        for start, bits in self.kept:
            total = bits + math.log2(end - start)
            if total < low:
                low = total
                kept.append((start, bits))
        self.kept = kept
        return low


def frequent_words(docs: DataFrame, most: int = MOST_WORDS) -> list[str]:
    """The ``most`` words of letters a to z that occur most often in the texts, and LEAST_TIMES at least, most frequent first; ties by the word."""
    low, high = WORD_LETTERS
    words = docs.select(F.explode(F.split(F.lower(filled("text")), "[^a-z]+")).alias("word")).filter(F.length("word").between(low, high))
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_TIMES)
    return [r.word for r in counted.orderBy(F.desc("n"), "word").limit(most).collect()]


def spans_of(text: str, cost: GuessCost, min_bits: float) -> list[tuple[int, int, str, float | None]]:
    """(start, end, kind, bits) in order. ``guess`` spans are values that lie in no other span."""
    found: list[tuple[int, int, int, float | None]] = []
    low = text.lower()
    if any(word in low for word in KEYWORDS):
        found += [(m.start(), 0, m.end(), None) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), None) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end(), None) for m in HEX.finditer(text)]
    if any(word in low for word in KEYWORDS):
        fixed = sorted((start, end) for start, _, end, _ in found)
        starts, reach = [s for s, _ in fixed], list(itertools.accumulate((e for _, e in fixed), max))
        for m in CONTEXT.finditer(text):
            before = bisect.bisect_left(starts, m.end(1))
            if not before or reach[before - 1] <= m.start(1):
                bits = cost.bits(m[1])
                if bits >= min_bits:
                    found.append((m.start(1), 3, m.end(1), bits))
    return [(start, end, KINDS[kind], bits) for start, kind, end, bits in sorted(found, key=lambda s: s[:3])]


def scan(docs: DataFrame, words: Sequence[str] | None = None, min_bits: float = 30.0) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_guess, base_sha256, spans, found of every row.

    ``spans`` lists kind:start:end (code points, end exclusive) by start, then kind; base_sha256 is of the
    same list without ``guess``, the kind the guess cost adds. ``found`` has start, end, kind and bits.
    A null text counts as empty and has no spans. Whole texts are read, whatever their length; repeated
    rows are scanned each for itself; a null doc_id stays null; other columns are not looked at; an
    empty table gives no rows. ``min_bits``: the least guess cost of an added value. ``words``: what is guessed first; if not
    given, WORDS and then the MOST_WORDS most frequent words of all texts, 20 letters each at most, which go to every task.
    """
    words = [*WORDS, *frequent_words(docs)] if words is None else words
    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string, found array<struct<start: int, end: int, kind: string, bits: double>>"
    cell = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("bits", pa.float64())])
    fields = pa.schema(
        [("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("found", pa.list_(cell))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A unit of more characters has min_bits or more, so it cannot bring a value below them.
        cost = GuessCost(words, max(REPEAT_UNIT, math.ceil(min_bits / math.log2(10))))
        for batch in batches:
            columns: list[list] = [[] for _ in range(7)]
            for text in batch.column("text"):
                spans = spans_of(text.as_py(), cost, min_bits)
                kinds = [s[2] for s in spans]
                base = ",".join(f"{k}:{a}:{b}" for a, b, k, _ in spans if k != "guess")
                row = [*(kinds.count(k) for k in KINDS), hashlib.sha256(base.encode()).hexdigest(), ",".join(f"{k}:{a}:{b}" for a, b, k, _ in spans)]
                for column, value in zip(columns, [*row, [dict(zip(("start", "end", "kind", "bits"), s)) for s in spans]]):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, f.type) for c, f in zip(columns, list(fields)[1:]))], schema=fields)

    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), filled("text").alias("text")).mapInArrow(run, schema)
