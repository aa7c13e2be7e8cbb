"""Byte-level BPE against the tiktoken library, and exact round trips."""

from __future__ import annotations

import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from voltframe.llm import bpe

PATTERN = public_tokenizers.PATTERN
VOCABULARY = bpe.read_vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"))
TEXTS = [
    None, "", " ", "   ", "\n\n x\r\n\ty  ", "Hello world, it's 2024!", "x   y \n z\n  w ", "日本語🙂é", "a" * 3000, "ab" * 700 + "c",
    " " * 2000, "ababababaaaa" * 90, "don't we'll I'M", "tab\there nbsp em", "\x1c \x1d\x85 ​", "0123456789" * 20,
]


def reference(raw=VOCABULARY, pattern=PATTERN):
    return tiktoken.Encoding("reference", pat_str=pattern, mergeable_ranks=bpe.load_ranks(raw), special_tokens={}).encode_ordinary


def rank_file(tokens):
    return b"\n".join(base64.b64encode(t) + b" " + str(i).encode() for i, t in enumerate(tokens))


def test_codec_equals_library():
    codec, encode = bpe.Codec(VOCABULARY, PATTERN), reference()
    ids = codec.encode_batch(TEXTS)
    assert [x.tolist() for x in ids] == [encode(t or "") for t in TEXTS]
    assert codec.decode_batch(ids) == [(t or "").encode() for t in TEXTS]


@pytest.mark.parametrize("seed", range(4))
def test_any_rank_order_short_and_long_pieces(seed, monkeypatch):
    """Random vocabularies, also such in which a longer entry outranks its halves."""
    rng = random.Random(seed)
    extra = {bytes(rng.choice(b"ab c") for _ in range(rng.randint(2, 6))) for _ in range(60)}
    tokens = [bytes([b]) for b in range(256)] + rng.sample(sorted(extra), len(extra))
    raw, pattern = rank_file(tokens), r"[abc]+| +|[^abc ]+"
    texts = ["".join(rng.choice("aab c") for _ in range(rng.randint(0, 400))) for _ in range(60)]
    want = [reference(raw, pattern)(t) for t in texts]
    for long_piece in (0, 1000):  # all pieces in rounds of runs; all by single contractions
        monkeypatch.setattr(bpe, "LONG_PIECE", long_piece)
        assert [x.tolist() for x in bpe.Codec(raw, pattern).encode_batch(texts)] == want


def test_small_memory_bounds_change_nothing(monkeypatch):
    for name, value in (("MEMO_STRINGS", 3), ("ROWS_PER_QUERY", 10), ("WORDS_PER_QUERY", 2), ("BYTES_PER_STEP", 10)):
        monkeypatch.setattr(bpe, name, value)
    codec, encode = bpe.Codec(VOCABULARY, PATTERN), reference()
    for _ in range(2):
        assert [x.tolist() for x in codec.encode_batch(TEXTS[:8])] == [encode(t or "") for t in TEXTS[:8]]


def test_long_strings_are_not_remembered():
    codec, encode = bpe.Codec(VOCABULARY, PATTERN), reference()
    texts = ["x" * 500 + " tail  two blanks " + "y" * 400, "z" * 300 + "," + "é" * 200, "a b " * 100]
    assert [x.tolist() for x in codec.encode_batch(texts)] == [encode(t) for t in texts]
    assert max(map(len, [*codec.led, *codec.bare])) <= bpe.LONG_PIECE


def test_operators(spark):
    rows = [(i, t, "kept", 5) for i, t in enumerate(TEXTS)] + [(1, "again", None, 1), (1, "again", None, 1), (None, "x", None, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")
    encode = reference()
    coded = bpe.encode(df, VOCABULARY, PATTERN)
    assert coded.columns == ["doc_id", "text", "ids", "n_tokens"]
    for r in coded.collect():
        assert r.ids == encode(r.text or "") and r.n_tokens == len(r.ids)
    for r in bpe.decode(coded, VOCABULARY, PATTERN).collect():
        assert bytes(r.decoded) == (r.text or "").encode()
    digests = {r.doc_id: r for r in bpe.round_trip(df, VOCABULARY, PATTERN).collect()}
    for i, t in enumerate(TEXTS):
        if i != 1:
            ids = encode(t or "")
            assert digests[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
            assert digests[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.round_trip(df.limit(0), VOCABULARY, PATTERN).count() == 0
    assert len(bpe.encode(df.limit(0), VOCABULARY, PATTERN).collect()) == 0


def test_unknown_ids_are_an_error():
    with pytest.raises(ValueError, match="not in the vocabulary"):
        bpe.Codec(VOCABULARY, PATTERN).decode_batch([bpe.np.array([999_999], dtype="int32")])
