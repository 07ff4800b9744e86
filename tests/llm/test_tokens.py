import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
from helpers import documents
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from blockloom.llm import bpe_stream, token_counts
from blockloom.llm.bpe import Merges, resolve

VOCAB = "byte_bpe_50k.json"
LIBRARY = Tokenizer.from_file(public_tokenizers.path(VOCAB))
ODD = [
    None, "", " ", "   \n\n  x", "<|endoftext|>", "a<|endoftext|><|endoftext|>b", "<|endoftext", "don't  I'LL we've 'S", "été 中文字 한국어", "\U0001f600\U0001f468‍\U0001f469‍\U0001f467", "\x00\x01\x7f\x80", "a" * 50_000, "ab" * 30_000,
    " " * 20_000, "\n" * 9_999 + "x", "1234567890" * 900, "́" * 4000, "x y z　w", " \u0085 ", "\U0001d7d8٣½Ⅷ", "zq" * 4097 + " zq", "=" * 70_000, "'s's'rest 're've 'll\n's", "\x1c\x1d a\x1fb",
]


@pytest.fixture(scope="module")
def encoder():
    return bpe_stream.Encoder(VOCAB)


@pytest.fixture(scope="module")
def counter():
    return token_counts.Counter(VOCAB)


def library(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def ids_of(encoder, texts):
    out = [b""] * len(texts)
    for k, body in encoder.encode(texts):
        out[k] += body
    return [np.frombuffer(x, "<u4").tolist() for x in out]


def test_counts(spark):
    rows = [*enumerate(ODD), (3, ODD[7]), (None, "null id")]
    out = token_counts.token_counts(documents(spark, rows)).collect()
    want = sorted((i is None, i or 0, len((t or "").encode()), len(library(t)), len(library(t)) > 512) for i, t in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in out) == want


def test_empty_tables(spark):
    assert token_counts.token_counts(documents(spark, [])).collect() == [] and bpe_stream.encode(documents(spark, [])).collect() == []


def test_encoding_and_decoding(spark):
    rows = list(enumerate(ODD))
    out = bpe_stream.encode(documents(spark, rows), keep=("lang", "spans"))
    assert out.columns == ["doc_id", "lang", "spans", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]
    for r in out.collect():
        ids = library(ODD[r.doc_id])
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    back = {r.doc_id: r.text for r in bpe_stream.decode(out, part=7).collect()}
    assert back == {i: t or "" for i, t in rows}


def test_decoding_broken_sequences_and_nulls(spark):
    ids = library("\U0001f600 中")
    cut = [ids[:1], ids[1:], ids[::-1], [50256, *ids[:1], 50256], []]
    df = spark.createDataFrame([*enumerate(cut), (9, None)], "doc_id long, ids array<int>")
    back = {r.doc_id: r.text for r in bpe_stream.decode(df).collect()}
    assert back == {**{i: LIBRARY.decode(c, skip_special_tokens=False) for i, c in enumerate(cut)}, 9: None}


@pytest.mark.parametrize("window", [0, 1])
def test_windows_of_any_size_give_the_same_ids(window):
    table, r = Merges(resolve(VOCAB)), random.Random(5)
    pieces = [bytes(r.choice(b"abehrst nio") for _ in range(r.randrange(1, 4000))) for _ in range(20)] + [b"\xff\xfe" * 900, b"e" * 5000]
    whole, at = table.lockstep(pieces)
    for k, got in enumerate(table.windows(pieces, window)):
        assert np.array_equal(got, whole[at[k] : at[k + 1]])


def test_every_byte_goes_through_the_transducer(encoder):
    """All ids but those of added tokens are its own, whatever the size of a pre-token."""
    encoder.transducer.read = 0
    texts = [t or "" for t in ODD]
    assert ids_of(encoder, texts) == [library(t) for t in texts]
    assert encoder.transducer.read == sum(len(t.replace("<|endoftext|>", "").encode()) for t in texts)


@pytest.mark.parametrize("block", [5, 17, 64, 700])
def test_blocks_of_any_size_give_the_same_ids(encoder, monkeypatch, block):
    monkeypatch.setattr(bpe_stream, "BLOCK", block)
    r = random.Random(block)
    texts = ["".join(r.choice(r.choice(["ab 'st\né中́", "aeinrst", "'sdmtlre v \n\t1", "a", "e ", "=-"])) for _ in range(r.randrange(2000))) for _ in range(20)]
    texts += ["".join(r.choice("aeinrst") for _ in range(3000)), "e" * 3000]
    assert ids_of(encoder, texts) == [library(t) for t in texts]


def test_what_is_held_between_blocks_does_not_grow(encoder, monkeypatch):
    monkeypatch.setattr(bpe_stream, "BLOCK", 1000)
    held, t = [], encoder.transducer
    plain = t.encode
    monkeypatch.setattr(t, "encode", lambda data, *rest: held.append(len(data)) or plain(data, *rest))
    r = random.Random(2)
    for text in ("a" * 40_000, "".join(r.choice("etaoinshr") for _ in range(40_000)), " " * 40_000):
        assert ids_of(encoder, [text]) == [library(text)]
    assert max(held) <= 1000 + t.lookahead + int(t.sizes.max()) + bpe_stream.CONTEXT


def test_kinds_of_all_code_points():
    """The tokenizers library makes one pre-token of code points of one kind, but of white space."""
    from tokenizers.pre_tokenizers import ByteLevel

    split, kinds = ByteLevel(add_prefix_space=False, use_regex=True), bpe_stream.kinds()
    edges = np.flatnonzero(np.diff(kinds)) + 1
    for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(kinds)], strict=True):
        points = [chr(c) for c in range(lo, hi) if not 0xD800 <= c < 0xE000]
        if kinds[lo] < 3:
            own = "a1."[kinds[lo]]
            for k in range(0, len(points), 20_000):
                assert len(split.pre_tokenize_str(own + "".join(points[k : k + 20_000]) + own)) == 1, hex(lo)
        for c in points if kinds[lo] == 3 else []:
            assert all(len(split.pre_tokenize_str(own + c + own)) > 1 for own in "a1."), hex(ord(c))


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="ab 'st\né中́<|endoftext>", max_size=200))
def test_any_text(encoder, counter, text):
    ids = library(text)
    assert counter.counts([text]) == [len(ids)]
    assert ids_of(encoder, [text]) == [ids]
    decoder = bpe_stream.Decoder(encoder.merges)
    parts = [decoder.feed(np.array(ids[k : k + 3], np.int64)) for k in range(0, len(ids), 3)]
    assert "".join(parts) + decoder.feed(np.zeros(0, np.int64), True) == text


def test_tokens_that_stand(encoder):
    """Two tokens stand if the library gives back both for their bytes."""
    r, t = random.Random(3), encoder.transducer
    words = [i for i, b in encoder.merges.token_bytes.items() if re.fullmatch(rb"[a-z]+", b)]
    for _ in range(1000):
        a, b = r.choice(words), r.choice(words)
        text = (encoder.merges.token_bytes[a] + encoder.merges.token_bytes[b]).decode()
        assert t.stands(a, b) == (library(text) == [a, b])
