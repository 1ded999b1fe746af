import hashlib
import random
import re

from screenforge.llm.secret_scan import GuessCost, frequent_words, scan


def _expected(text):
    text = text or ""
    kinds = {
        "assign": (r"((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 12),
        "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
        "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 16),
    }
    spans = sorted((m.start(), k, m.end(), name) for k, (name, (p, ok)) in enumerate(kinds.items()) for m in re.finditer(p, text) if ok(m))
    listed = ",".join(f"{n}:{a}:{b}" for a, _, b, n in spans)
    return [sum(s[3] == n for s in spans) for n in kinds], hashlib.sha256(listed.encode()).hexdigest()


def _texts():
    rng = random.Random(6)
    parts = ['password', 'PASSWD', '"', "'", ' ', ' = ', ': ', 'token', 'ſecret', 'to\u212aen', 'api_key', 'ApiKey=', 'AKIA', 'AKIAABCDEFGHIJKLMN', '0123456789abcdef', 'deadbeef', 'x', 'Ä', '😀', 'abc+/_.=-', 'longvalue12345', '\n', '=']
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(400)]


def test_base_spans_against_the_patterns(spark):
    texts = _texts() + [None, "", "f" * 100_000, "token=" + "a" * 50_000]
    frame = spark.createDataFrame([(i, t, 1, "s") for i, t in enumerate(texts)], "doc_id long, text string, n_hex int, spans string")
    rows = scan(frame).collect()
    assert len(rows) == len(texts)
    for row in rows:
        counts, digest = _expected(texts[row.doc_id])
        assert [row.n_assign, row.n_access, row.n_hex] == counts
        assert row.base_sha256 == digest
        assert row.spans == ",".join(f"{s.kind}:{s.start}:{s.end}" for s in row.found)
        fixed = [s for s in row.found if s.kind != "guess"]
        for span in row.found:
            if span.kind == "guess":
                assert span.bits >= 30 and all(span.end <= s.start or s.end <= span.start for s in fixed)


def test_added_values(spark):
    docs = [(1, "pwd: G7#kq!2Zx"), (2, "password = letmein1"), (3, "passphrase: qwertyuiop"), (None, "secret=aaaaaaaaaaa"), (5, "The token is here. key: value"), (1, "pwd: G7#kq!2Zx")]
    rows = scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_guess, r.spans) for r in rows) == [("1", 1, "guess:5:14"), ("1", 1, "guess:5:14"), ("2", 0, ""), ("3", 0, ""), ("5", 0, ""), ("None", 0, "")]
    assert scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_guess_costs():
    bits = GuessCost().bits
    assert bits("password") < bits("P@ssword") < bits("xkqvbzjw")
    assert bits("1987-06-05") < bits("1987-96-75")
    assert bits("aaaaaaaaaaaaaaaa") < bits("ahgtwqplmznxbcvy")
    assert bits("abcabcabcabc") < bits("abcxyzqrsmno")
    assert bits("asdfghjkl") < bits("adgjlsfhk")
    assert bits("passwordletmein") <= bits("password") + bits("letmein") + 1e-9
    assert bits("") == 0 and bits("x" * 20_000) < 100 and bits("İstanbul1") > 0


def test_costs_are_the_least_over_all_segmentations():
    """Against all ways to cut short strings, with the cost of each part said anew from its text alone."""
    import functools
    import math

    words = ["master", "ab", "password", "1a", "qwe"]
    cost = GuessCost(words)
    rank = {w: i + 2 for i, w in enumerate(words)}
    leet = str.maketrans("4@310$5!7", "aaeiossit")
    single = lambda c: math.log2(10 if c.isdigit() else 26 if c.isalpha() else 33)

    def part(p):
        """The least bits of one part, without its extra bit."""
        low, found = p.lower(), [sum(map(single, p))]
        for form, extra in ((low, 0), (low.translate(leet), 1)):
            if len(p) > 1 and form in rank:
                found.append(math.log2(rank[form]) + extra + (p != low))
        if re.fullmatch(r"(19|20)[0-9]{2}", p):
            found.append(math.log2(60))
        for day in (r"(?:19|20)[0-9]{2}([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12][0-9]|3[01])", r"(?:0[1-9]|[12][0-9]|3[01])([-/._]?)(?:0[1-9]|1[0-2])\1(?:19|20)[0-9]{2}"):
            if re.fullmatch(day, p):
                found.append(math.log2(365 * 60))
        for unit in range(1, len(p) // 2 + 1):
            if len(p) >= 3 and len(p) % unit == 0 and p == p[:unit] * (len(p) // unit):
                found.append(sum(map(single, p[:unit])) + math.log2(len(p) // unit))
        found += [bits for end, bits in cost._walk_ends(p, 0) if end == len(p)]
        return min(found)

    def least(value):
        @functools.cache
        def go(i):
            return 0.0 if i == len(value) else min(1 + part(value[i:j]) + go(j) for j in range(i + 1, len(value) + 1))

        return go(0)

    rng = random.Random(4)
    values = ["mastertyuiop", "P@ssword1999", "abababqwe", "2001-02-03x", "xx20012001", "asasas1a1a", "abcdeabcdeabcde"]
    values += ["".join(rng.choice(["a", "b", "1", "9", "q", "w", "e", "ab", "20", "02", "@", "A", "master", "-"]) for _ in range(rng.randint(1, 6))) for _ in range(400)]
    for value in values:
        assert abs(cost.bits(value) - least(value)) < 1e-9, value


def test_costs_of_long_values_follow_the_same_rule():
    """A value of 300 characters costs little more than the same repeated 200 characters, whatever it is made of."""
    bits = GuessCost().bits
    for part in ("12985", "password1", "qwerfdsa", "abcdefghij"):
        short, long = part * (200 // len(part)), part * (300 // len(part))
        assert bits(short) <= bits(long) < bits(short) + 1
        assert bits("#" + long + "#") < bits("#" + short + "#") + 1
    assert bits("12985" * 60) < 30 and bits("12985" * 4_000) < 31 and bits("as" * 10_000) < 30


def test_words_of_the_texts_are_guessable(spark):
    texts = [(i, "Patience is brilliant, together we wait") for i in range(30)] + [(99, "secret: patience"), (98, "secret: brilliant"), (97, "secret: kwxvzqjphd")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert frequent_words(docs, 3) == ["brilliant", "patience", "together"]
    found = {r.doc_id: r.n_guess for r in scan(docs).collect() if r.doc_id > 90}
    assert found == {99: 0, 98: 0, 97: 1}
    assert {r.doc_id: r.n_guess for r in scan(docs, words=()).collect()}[98] == 1
