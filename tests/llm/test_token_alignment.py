"""Token alignment against a brute-force version that knows only both libraries and the byte offsets."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from screenforge.llm import token_alignment
from screenforge.llm.token_alignment import Aligner, aligned, alignment, byte_of_character

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "  ", "▁", "a▁b", "<|endoftext|> and <s></s><0x41>", "\x00", "naïve café 日本語 😀😀", "a" * 400, " " * 100, "\n\n\t x", "trail ", "Tab\tx\r\ny"]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def _texts():
    rng = random.Random(11)
    words = ["the", "cat", "strange", "idiot's", "x1", "2024", "naïve", "日本", "don't", "...", "Zürich", "\n", "", "😀"]
    plain = [" ".join(rng.choices(words, k=rng.randint(1, 40))) for _ in range(150)]
    return ODD + plain + ["".join(chr(rng.choice([rng.randint(1, 126), rng.randint(160, 0x24F), 0x3042])) for _ in range(60)) for _ in range(80)]


def _brute(libraries, texts):
    """Per text: n_a, n_b, links (Counter of pairs), groups as text."""
    a_lib, b_lib = libraries
    byte = byte_of_character()
    found = []
    for text in texts:
        a = a_lib.encode(" " + (text or ""), add_special_tokens=False).ids
        b = b_lib.encode(text or "")
        a_bytes = [bytes(byte[c] for c in a_lib.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(b_lib.id_to_piece(i)[3:5], 16)]) if b_lib.is_byte(i) else b_lib.id_to_piece(i).replace("▁", " ").encode() for i in b]
        want = b" " + (text or "").encode()
        if not text or b"".join(a_bytes) != want or b"".join(b_bytes) != want:
            found.append((0, 0, Counter(), []))
            continue
        ends = [[sum(map(len, part[: i + 1])) for i in range(len(part))] for part in (a_bytes, b_bytes)]
        groups, at = [], 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            groups.append(([i for i, e in zip(a, ends[0]) if at < e <= end], [i for i, e in zip(b, ends[1]) if at < e <= end]))
            at = end
        found.append((len(a), len(b), Counter((x, y) for left, right in groups for x in left for y in right), groups))
    return found


def _shown(groups):
    return ";".join(",".join(map(str, left)) + "|" + ",".join(map(str, right)) for left, right in groups)


def _expected(libraries, texts):
    brute = _brute(libraries, texts)
    corpus = Counter(pair for _, _, links, _ in brute for pair in links)
    most = {}
    for (x, _), n in corpus.items():
        most[x] = max(most.get(x, 0), n)
    rows = []
    for n_a, n_b, links, groups in brute:
        best = sum(n for (x, y), n in links.items() if corpus[x, y] == most[x])
        total = sum(n * corpus[pair] for pair, n in links.items())
        digest = hashlib.sha256(_shown(groups).encode()).hexdigest() if n_a else ""
        rows.append((n_a, n_b, len(groups), sum(links.values()), best, total, digest))
    return rows


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, row int, pair string, n_a int, often int")


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_equal_to_brute_force(spark, libraries, monkeypatch, most):
    monkeypatch.setattr(token_alignment, "BROADCAST_PAIRS", most)
    texts = _texts()
    expected = _expected(libraries, texts)
    rows = alignment(_docs(spark, [(i, t, 1, "x", 2, 3) for i, t in enumerate(texts)]), A, B).collect()
    assert len(rows) == len(texts)
    for row in rows:
        assert tuple(row[c] for c in COLUMNS) == expected[row.doc_id], repr(texts[row.doc_id])
    assert sum(row.n_a == 0 for row in rows) >= 4


def test_rows_that_repeat_count_each(spark, libraries):
    texts = ["the cat", "the cat", "the cat sat", "dog"]
    expected = _expected(libraries, texts)
    rows = alignment(_docs(spark, [(7, texts[0], 1, "x", 2, 3), (7, texts[1], 1, "x", 2, 3), (None, texts[2], 1, "x", 2, 3), (None, texts[3], 1, "x", 2, 3)]), A, B).collect()
    assert sorted(tuple(r[c] for c in COLUMNS) for r in rows) == sorted(expected)


def test_groups_and_links_are_shown(spark, libraries):
    text = "strange naïve words"
    row = aligned(_docs(spark, [(1, text, 1, "x", 2, 3)]), A, B, with_groups=True).first()
    _, _, links, groups = _brute(libraries, [text])[0]
    assert row.groups == _shown(groups)
    assert dict(zip(row.pairs, row.often)) == {x << 32 | y: n for (x, y), n in links.items()}


def test_stores_that_begin_anew_and_large_groups(libraries, monkeypatch):
    monkeypatch.setattr(token_alignment, "PIECE_BYTES", 4000)
    monkeypatch.setattr(token_alignment, "KNOWN_WINDOWS", 20)
    monkeypatch.setattr(token_alignment, "MANY_LINKS", 2)
    with open(A, encoding="utf-8") as one, open(B, "rb") as two:
        aligner = Aligner(one.read(), two.read())
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["alpha", "beta2", "γ", "it's", "  ", "Omega."]) for _ in range(n)) for n in (3, 2000, 40, 5000)] + ["ab" * 3000]
    found = [row for _, _, values in aligner.rows(pa.array(texts)) for row in zip(*(v.to_pylist() for v in values))]
    for (*_, shown, _, pairs, often), (_, _, links, groups) in zip(found, _brute(libraries, texts), strict=True):
        assert shown.decode() == _shown(groups)
        assert dict(zip(pairs, often)) == {x << 32 | y: n for (x, y), n in links.items()}


def test_words_apart_have_the_same_tokens(libraries):
    """Around every safe cut, for many characters on the far side of its neighbours."""
    a_lib, b_lib = libraries
    rng = random.Random(8)
    far = "é 日😀\n\t \u00a0\u2003▁'.1aA\u0301\u200d<|"
    for _ in range(3000):
        text = "".join(rng.choice(far + "xyZ09!~ ") for _ in range(rng.randint(1, 30)))
        words = token_alignment.SAFE_CUT.split(text)
        assert [i for w in words for i in a_lib.encode(" " + w, add_special_tokens=False).ids] == a_lib.encode(" " + text, add_special_tokens=False).ids, repr(text)
        assert [i for w in words for i in b_lib.encode(w)] == b_lib.encode(text), repr(text)


def test_empty_table(spark):
    assert alignment(_docs(spark, []), A, B).count() == 0
