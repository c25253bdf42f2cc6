"""The transducer against the public library, round trips and the corner cases."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import tokens
from sparkloom.llm.bpe import Decoder, Encoder, Transducer, parse_ranks


@pytest.fixture(scope="module")
def both():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    blob, pattern = tokens.vocabulary()
    return Encoder(parse_ranks(blob), pattern), lambda s: t.encode(s, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_any_text(both, text):
    enc, ref = both
    ids = enc.encode(text)
    assert ids == ref(text)
    d = Decoder(enc.fst.ranks)
    assert d.feed(ids) + d.finish() == text


@pytest.mark.parametrize("text", ["<|endoftext|>", "a" * 5000, "=-" * 3000, "\n\n \t " * 500, "é漢😀" * 700, "don't I'll", ""])
def test_awkward_texts(both, text):
    enc, ref = both
    assert enc.encode(text) == (ref(text) if text else [])


def test_long_random_words(both):
    enc, ref = both
    rnd = random.Random(3)
    for alphabet in ("ab", "abcdefghij", "thequickbrown"):
        word = "".join(rnd.choice(alphabet) for _ in range(20_000))
        assert enc.encode(word) == ref(word)


def test_table_begins_afresh(both, monkeypatch):
    import sparkloom.llm.bpe as bpe

    monkeypatch.setattr(bpe, "MAX_STATES", 50)
    enc, ref = both
    small = Encoder(enc.fst.ranks, tokens.vocabulary()[1])
    text = "Several ordinary words, rediscovered repeatedly; unbelievably long-winded internationalisation."
    assert small.encode(text * 3) == ref(text * 3)


def test_decoder_waits_for_whole_characters(both):
    enc, _ = both
    d = Decoder(enc.fst.ranks)
    out = [d.feed([i]) for i in enc.encode("漢😀")]
    assert "".join(out) + d.finish() == "漢😀" and "" in out


def test_decoder_marks_wrong_bytes():
    d = Decoder({bytes([i]): i for i in range(256)})
    assert d.feed([0xC3]) + d.feed([0x41, 0xFF, 0xE6]) + d.finish() == "�A��"


def test_small_vocabulary():
    ranks = {b"a": 0, b"b": 1, b"ab": 2, b"ba": 3, b"aba": 4}
    t = Transducer(ranks)
    for n in range(1, 9):
        for k in range(2**n):
            piece = bytes(b"ab"[(k >> i) & 1] for i in range(n))
            assert t.encode_piece(piece) == t.merged(piece)


def test_table(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "hello world", "z"), (3, "hello world", "z"), (4, "w " * 50_000, "k")], "doc_id long, text string, key string")
    got = sorted((r["doc_id"], len(r["ids"])) for r in tokens.encode_texts(df).collect())
    assert got[:4] == [(1, 0), (2, 0), (3, 2), (3, 2)] and got[4][1] >= 50_000
    assert tokens.encode_texts(df.limit(0)).count() == 0
    back = {r["doc_id"]: r["text"] for r in tokens.decode_ids(tokens.encode_texts(df)).collect()}
    assert back[3] == "hello world" and back[1] == "" and back[4] == "w " * 50_000
