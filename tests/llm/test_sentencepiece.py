import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from screenforge.llm import sentencepiece_bpe
from screenforge.llm.sentencepiece_bpe import PairTable, PieceModel, encode_and_decode

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  ", "a", "▁", "▁▁ x", "b▁ \n", "\n\n", "日本語のテキスト", "a" * 700, "é　", "\x00a", "😀😀", "<s></s><0x0A>", "  lead", "trail  ", "a\tb\r\nc"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    with open(PATH, "rb") as file:
        return PieceModel(file.read())


def _texts():
    rng = random.Random(3)
    mixed = ["".join(rng.choice("abinge t▁ h日é😀\n") for _ in range(rng.randint(0, 300))) for _ in range(300)]
    plain = ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(160, 0x24F), rng.randint(0x4E00, 0x4F00)])) for _ in range(80)) for _ in range(200)]
    return ODD + mixed + plain + ["the quick brown fox " * 20_000]


def test_equal_to_the_library(model, library):
    texts, i = _texts(), 0
    for flat, number in model.encode(pa.array(texts)):
        for ids in np.split(flat, np.cumsum(number)[:-1]):
            assert ids.tolist() == library.encode(texts[i], add_bos=True, add_eos=True), texts[i][:50]
            assert model.decode(ids) == library.decode(ids.tolist())
            i += 1
    assert i == len(texts)


def test_store_that_begins_anew(model, library, monkeypatch):
    monkeypatch.setattr(sentencepiece_bpe, "KNOWN_WORDS", 50)
    texts = ["word%d and other%d words" % (i, i) for i in range(400)]
    for _ in range(2):
        flat = np.concatenate([f for f, _ in model.encode(pa.array(texts))])
        assert flat.tolist() == [x for t in texts for x in library.encode(t, add_bos=True, add_eos=True)]


def test_decode_of_any_ids(model, library):
    rng = random.Random(5)
    for _ in range(200):
        ids = [rng.randint(3, 258) if rng.random() < 0.2 else rng.randint(259, model.size - 1) for _ in range(20)]
        assert model.decode(np.array(ids)) == library.decode(ids)


def test_pair_table():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 50, 5_000))
    table = PairTable(keys)
    assert (table.find(keys) == np.arange(len(keys))).all()
    assert (table.find(keys + 1)[~np.isin(keys + 1, keys)] == -1).all()


def test_rows(spark, library):
    rows = [(1, None, 7), (2, "", 7), (3, "two words", None), (3, "two words", 1), (None, "x", 1)]
    out = encode_and_decode(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int"), PATH, with_values=True).collect()
    assert len(out) == len(rows)
    for (doc_id, text, _), row in zip(rows, sorted(out, key=lambda r: [x[0] for x in rows].index(r.doc_id))):
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        assert (row.doc_id, row.n_tokens, row.ids, row.decoded) == (doc_id, len(ids), ids, text or "")
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert encode_and_decode(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


LONG = [" " * 5_000, "x " + " " * 3_000 + "y", "=" * 4_000, "ab" * 3_000, "the" * 2_000, "abcdefghij" * 500, "日本語" * 1_000, "a▁" * 2_000, "é" * 2_000, "\u0800" * 1_000]


def test_long_words_equal_the_library(model, library):
    rng = random.Random(12)
    texts = LONG + ["".join(rng.choices("abcdeinrst", k=rng.randint(60, 2_000))) for _ in range(60)] + ["".join(rng.choices(" =-_", k=900)) for _ in range(10)]
    i = 0
    for flat, number in model.encode(pa.array(texts)):
        for ids in np.split(flat, np.cumsum(number)[:-1]):
            assert ids.tolist() == library.encode(texts[i], add_bos=True, add_eos=True), texts[i][:30]
            i += 1
    assert i == len(texts)


@pytest.mark.parametrize("part", [" ", "abcdefghij", "thequickbrownfox", "=", "xyzzy1"])
def test_time_grows_with_the_text(model, part):
    import time

    def seconds(n):
        model.forget()
        start = time.perf_counter()
        list(model.encode(pa.array([(part * (n // len(part) + 1))[:n]])))
        return time.perf_counter() - start

    seconds(20_000)
    once, thrice = (min(seconds(n) for _ in range(2)) for n in (100_000, 300_000))
    assert thrice < 6 * once + 0.5
