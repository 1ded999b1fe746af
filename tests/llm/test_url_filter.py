import random
import re

import numpy as np
import pyarrow as pa

from screenforge.llm.common import chunks
from screenforge.llm import url_filter
from screenforge.llm.url_filter import BLOCKED, GlobSet, judge


def _regex(glob):
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**", i):
            out, i = out + "(?s:.*)", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        elif glob[i] == "\\" and i + 1 < len(glob):
            out, i = out + re.escape(glob[i + 1]), i + 2
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return re.compile(out)


def test_automaton_against_regular_expressions():
    rng = random.Random(8)
    globs = ["", "*", "**", "a?c", "\\*a", "a*b*c", "**/x/**", "*.net/**", "b\\"] + ["".join(rng.choice(["a", "b", "/", "*", "**", "?", "."]) for _ in range(rng.randint(1, 40))) for _ in range(60)]
    texts = ["", "*a", "b\\", "x.net/", "a/x/b"] + ["".join(rng.choice("ab/.c") for _ in range(rng.randint(0, 50))) for _ in range(400)]
    automaton = GlobSet(globs)
    assert automaton.words > 4
    found = np.concatenate([automaton.matches(d, o) for _, _, d, o in chunks(pa.array(texts), 300)])
    for j, glob in enumerate(globs):
        pattern = _regex(glob)
        assert found[:, j].tolist() == [bool(pattern.fullmatch(t)) for t in texts], glob


def test_the_whole_list_against_regular_expressions(monkeypatch):
    """Some hundred globs over many words of masks, on urls made of their parts; long ones alone."""
    rng = random.Random(9)
    parts = ["casino", "slots", "x", "/", "/", ".", "ads", "wp-login.php", "robots.txt", "jpg", "pdf", "cgi-bin", "a.b", "é", "login", "7z"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 9))) for _ in range(600)]
    automaton = GlobSet(BLOCKED)
    assert len(BLOCKED) > 150 and automaton.words > 20
    patterns = [_regex(glob) for glob in BLOCKED]
    expected = [[bool(p.fullmatch(t)) for p in patterns] for t in texts]
    assert sum(map(sum, expected)) > 200
    for most in (4_096, 5):
        monkeypatch.setattr(url_filter, "LONG_URL", most)
        found = np.concatenate([automaton.matches(d, o) for _, _, d, o in chunks(pa.array(texts), 900)])
        assert found.tolist() == expected


CASES = [
    (1, "http://a.net/x", "a.net", "/x", "net/", "block"),
    (2, "https://NET/", "net", "/", "net/", "block"),
    (3, "https://x.example.net/en/1", "x.example.net", "/en/1", "example.net/en/", "allow"),
    (4, "https://x.example.net/EN/1", "x.example.net", "/EN/1", "net/", "block"),
    (5, "https://xexample.com/de/1", "xexample.com", "/de/1", None, "allow"),
    (6, "https://example.com/de/1?x#y", "example.com", "/de/1", "example.com/de/", "block"),
    (7, "https://a.b.org/fr/", "a.b.org", "/fr/", "org/fr/", "allow"),
    (8, "https://a.net", "a.net", "", None, "allow"),
    (9, "https://a.net?q=/", "a.net", "", None, "allow"),
    (10, "https://evil.com/x.net/y", "evil.com", "/x.net/y", None, "allow"),
    (11, "https://www.cheap-pills.example.com#a", "www.cheap-pills.example.com", "", None, "block"),
    (12, None, "", "", None, "allow"),
    (13, "", "", "", None, "allow"),
    (14, "net/x", "", "", None, "allow"),
    (15, "://ÄB.Net:80/p", "Äb.net:80", "/p", None, "allow"),
    (None, "http://a.net/x", "a.net", "/x", "net/", "block"),
    (1, "http://a.net/x", "a.net", "/x", "net/", "block"),
    (16, "a://b://c/d", "b:", "//c/d", None, "allow"),
    (17, "http://long.net/" + "y" * 200_000, "long.net", "/" + "y" * 200_000, "net/", "block"),
]


def test_verdicts(spark):
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u, *_ in CASES], "page_id long, url string, host string, rule string")
    got = [tuple(r) for r in judge(pages).collect()]
    assert sorted(map(str, got)) == sorted(str((i, h, p, r, v)) for i, _, h, p, r, v in CASES)
    assert judge(pages.limit(0)).count() == 0
