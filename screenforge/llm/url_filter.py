"""URL verdicts by a bit-parallel wildcard automaton."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenforge.llm.common import bound_batches, chunks

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# (rule, verdict): host and start of the path; a rule fits the host and its subdomains.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
# For urls without a rule. What is blocked: hosts that contain one of these words,
HOST_WORDS = (
    "cheap-pills casino poker jackpot slots gambling betting sportsbet viagra cialis pharmacy-online payday-loan quick-loan free-money "
    "crypto-giveaway bitcoin-doubler porn xxx escort hookup warez keygen torrent-download replica-watches fake-rolex adserver doubleclick "
    "popunder clicktrack malware phishing spyware"
).split()
# paths with one of these segments, under any host,
SEGMENTS = (
    "cgi-bin wp-admin wp-includes xmlrpc phpmyadmin administrator adserver ads advert banners sponsored affiliate click redirect track tracking "
    "pixel login logout signin signup register password-reset checkout cart basket wishlist print share email-friend unsubscribe"
).split()
# and files with one of these names or endings.
FILES = "wp-login.php xmlrpc.php login.php login.aspx register.php cart.php checkout.php robots.txt sitemap.xml ads.txt favicon.ico".split()
ENDINGS = (
    "jpg jpeg png gif webp svg ico bmp mp3 mp4 avi mov webm wav zip gz tar rar 7z exe dmg apk iso css js json xml rss woff woff2 ttf pdf doc docx xls xlsx ppt pptx"
).split()


def blocked_globs() -> list[str]:
    """The lists above as globs over host and path."""
    globs = [form.format(word) for word in HOST_WORDS for form in ("*{}*", "*{}*/**")]
    globs += [form.format(segment) for segment in SEGMENTS for form in ("**/{}", "**/{}/**")]
    return globs + [f"**/{name}" for name in FILES] + [f"*/**.{ending}" for ending in ENDINGS]


BLOCKED = tuple(blocked_globs())
# Longer urls are stepped over alone.
LONG_URL = 4_096


class GlobSet:
    """All globs in one automaton, whose states are bits of 64-bit words.

    ``*`` stands for any bytes but ``/``, ``**`` for any bytes, ``?`` for one byte but ``/``; a backslash
    takes the meaning from the next character. A glob must match the whole string, in UTF-8.
    State i of a glob says that its first i characters are matched. A byte moves each state one
    bit up where the glob has that byte (``forward``), and keeps it where a wildcard stands (``stay``).
    """

    def __init__(self, globs: Sequence[str]):
        steps: list[tuple[int, list[int]]] = []  # of each state: the bytes that lead to it
        loops: list[tuple[int, list[int]]] = []
        starts, accepts = [], []
        state = 0
        for glob in globs:
            starts.append(state)
            text, i = glob.encode(), 0
            while i < len(text):
                if text[i] == 42:
                    both = text[i + 1 : i + 2] == b"*"
                    loops.append((state, [b for b in range(256) if both or b != 47]))
                    i += 1 + both
                    continue
                escaped = text[i] == 92 and i + 1 < len(text)
                i += escaped
                state += 1
                steps.append((state, [b for b in range(256) if b != 47] if text[i] == 63 and not escaped else [text[i]]))
                i += 1
            accepts.append(state)
            state += 1
        self.words = max(1, -(-state // 64))
        self.forward, self.stay = (np.zeros((256, self.words), np.uint64) for _ in range(2))
        for table, entries in ((self.forward, steps), (self.stay, loops)):
            for at, some in entries:
                table[some, at // 64] |= np.uint64(1 << at % 64)
        self.start = np.zeros(self.words, np.uint64)
        for at in starts:
            self.start[at // 64] |= np.uint64(1 << at % 64)
        self.accept = np.array(accepts, np.int64)
        # The same masks as whole numbers, for strings that are longer than all others of their batch.
        self.whole_forward, self.whole_stay = ([int.from_bytes(row.tobytes(), "little") for row in t] for t in (self.forward, self.stay))
        self.whole_start = int.from_bytes(self.start.tobytes(), "little")

    def matches_one(self, text: bytes) -> np.ndarray:
        """Which glob matches one string, byte by byte."""
        state, forward, stay = self.whole_start, self.whole_forward, self.whole_stay
        for byte in text:
            state = (state << 1 & forward[byte]) | (state & stay[byte])
        return np.array([state >> int(at) & 1 for at in self.accept], bool)

    def matches(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which string (row) is matched by which glob (column)."""
        size = np.diff(offsets)
        long = np.flatnonzero(size > LONG_URL)
        size = np.where(size > LONG_URL, 0, size)
        by = np.argsort(-size, kind="stable")
        begin, left = offsets[:-1][by], size[by]
        states = np.tile(self.start, (len(by), 1))
        one, top = np.uint64(1), np.uint64(63)
        for at in range(int(left[0]) if len(left) else 0):
            active = int(np.searchsorted(-left, -at, side="left"))
            byte = data[begin[:active] + at]
            now = states[:active]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            states[:active] = (moved & self.forward[byte]) | (now & self.stay[byte])
        found = np.zeros((len(by), len(self.accept)), bool)
        bits = states[:, self.accept // 64] >> (self.accept % 64).astype(np.uint64) & one
        found[by] = bits.astype(bool)
        for row in long:
            found[row] = self.matches_one(data[offsets[row] : offsets[row + 1]].tobytes())
        return found


def _plain(text: str) -> str:
    return "".join("\\" + c if c in "*?\\" else c for c in text)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case. Path: from there
    up to ``?``, ``#`` or the end. Both are empty for null and without ``://``."""
    start = F.locate("://", url)
    rest = F.coalesce(F.when(start > 0, F.substring(url, start + 3, F.length(url))), F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, blocked: Sequence[str] = BLOCKED) -> DataFrame:
    """page_id, host, path, rule, verdict of every row.

    The longest rule that fits decides (of equally long ones the first given). Without a rule a url is
    blocked if one of ``blocked`` matches its host and path, else allowed; so a null or empty url is
    allowed. Repeated rows are judged each for itself; a null page_id stays null; other columns are
    not looked at; an empty table gives no rows. Urls of any length are read whole.
    """
    ranked = sorted(rules, key=lambda rule: -len(rule[0]))
    globs = [g for rule, _ in ranked for g in (f"{_plain(rule)}**", f"*.{_plain(rule)}**")] + list(blocked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = GlobSet(globs)
        names = np.array([rule for rule, _ in ranked] + [None], object)
        said = np.array([verdict for _, verdict in ranked] + [None], object)
        for batch in batches:
            found = [automaton.matches(data, offsets) for _, _, data, offsets in chunks(batch.column("canonical"))]
            hit = np.concatenate(found) if found else np.zeros((0, len(globs)), bool)
            fits = hit[:, : 2 * len(ranked)].reshape(len(hit), -1, 2).any(axis=2)
            first = np.where(fits.any(axis=1), fits.argmax(axis=1) if len(ranked) else 0, len(ranked))
            other = np.where(hit[:, 2 * len(ranked) :].any(axis=1), "block", "allow")
            verdict = np.where(first < len(ranked), said[first], other)
            columns = [batch.column(c) for c in ("page_id", "host", "path")]
            columns += [pa.array(names[first].tolist(), pa.string()), pa.array(verdict.tolist(), pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "host", "path", "rule", "verdict"])

    bound_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    host, path = host_and_path(F.col("url"))
    rows = rows.select("page_id", host.alias("host"), path.alias("path")).withColumn("canonical", F.concat("host", "path"))
    return rows.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")
