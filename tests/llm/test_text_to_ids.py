"""Byte-level BPE and token shards against the libraries themselves."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from pactum.llm import byte_bpe, token_shards

from .conftest import dicts

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
MODEL = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def packed(ids):
    return np.array(ids, "<u4").tobytes()


def encoded(df):
    return byte_bpe.encode(df, RANKS, public_tokenizers.PATTERN)


def test_ids_are_those_of_the_library(docs, rows, library):
    texts = {r[0]: r[1] or "" for r in rows}
    found = dicts(encoded(docs))
    assert len(found) == len(rows)
    for r in found:
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert bytes(r["ids"]) == packed(ids)
        assert r["ids_sha256"] == hashlib.sha256(packed(ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_decoding_is_an_exact_round_trip(docs, rows):
    back = byte_bpe.decode(encoded(docs), RANKS, public_tokenizers.PATTERN)
    assert {r["doc_id"]: bytes(r["bytes"]) for r in back.collect()} == {r[0]: (r[1] or "").encode() for r in rows}


def test_hard_texts(library):
    own = byte_bpe.encoder_of(byte_bpe.read_ranks(RANKS), public_tokenizers.PATTERN)
    rng = random.Random(5)
    parts = ["a", "th", "ing", " ", "  ", "\n", "'s", "'", "12", "é", "ß", "日", "\x1c", "\t", "!!", "😀", "ſ", "\U0001dffd", "x" * 30, "\r\n", "́"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) if rng.random() < 0.8 else chr(rng.choice([rng.randrange(1, 0xD800), rng.randrange(0xE000, 0x20000)])) for _ in range(rng.randrange(1, 40)))
        assert own.packed(text) == packed(library.encode_ordinary(text)), repr(text)
    joined = [t for t in own.vocabulary.tokens if len(t) > 1]
    for _ in range(3000):
        try:
            text = b"".join(rng.choice(joined) for _ in range(3)).decode()
        except UnicodeDecodeError:
            continue
        assert own.packed(text) == packed(library.encode_ordinary(text)), repr(text)


def test_one_long_piece_takes_linear_time(library):
    own = byte_bpe.encoder_of(byte_bpe.read_ranks(RANKS), public_tokenizers.PATTERN)
    for text in ("a" * 20_000, "thing" * 4_000, "éa" * 5_000):
        assert own.packed(text) == packed(library.encode_ordinary(text))


def test_edges(clashing, empty, nameless):
    assert encoded(empty).count() == 0
    assert encoded(clashing).count() == clashing.count()
    assert encoded(nameless).count() == 6


# Shards ---------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    return Tokenizer.from_file(MODEL)


def expected(rows, model):
    out, start = {}, 0
    for key, text, *_ in sorted(rows):
        ids = [*model.encode(text or "", add_special_tokens=False).ids, 0]
        out[key] = (start, len(ids), zlib.crc32(packed(ids)))
        start += len(ids)
    return out


def test_shards_read_back(docs, rows, model):
    shards = token_shards.token_shards(docs, MODEL, shard_ids=500)
    assert shards.count() > 5
    found = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_shards.read_report(shards).collect()}
    assert found == expected(rows, model)


def test_keyed_access(docs, rows, model):
    shards = token_shards.token_shards(docs, MODEL, shard_ids=500)
    found = {r["doc_id"]: r["ids"] for r in token_shards.fetch(shards, [3, 40, 70, 10_000]).collect()}
    assert found == {k: [*model.encode(rows[k][1] or "", add_special_tokens=False).ids, 0] for k in (3, 40, 70)}


@pytest.mark.parametrize("n", [0, 1, 2, 100, 5000])
def test_hash_is_minimal_and_perfect(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(-(2**62), 2**62, n))
    order = np.arange(len(keys))
    index = token_shards.PerfectHash.from_bytes(token_shards.PerfectHash.build(keys, order, order * 0 + 1).to_bytes())
    assert sorted(index.slots(keys).tolist()) == order.tolist()
    assert index.find(keys)[0].tolist() == order.tolist()
    foreign = rng.integers(-(2**62), 2**62, 1000)
    assert (index.find(foreign)[0] >= 0).sum() == np.isin(foreign, keys).sum()


def test_shard_edges(clashing, empty, nameless):
    assert token_shards.read_report(token_shards.token_shards(empty, MODEL)).count() == 0
    assert token_shards.read_report(token_shards.token_shards(clashing, MODEL)).count() == clashing.count()
    found = dicts(token_shards.read_report(token_shards.token_shards(nameless, MODEL)))
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in found) == [(False, 0)] * 2 + [(True, 7)] * 3 + [(True, 9)]
    ends = sorted((r["start"], r["n_tokens"]) for r in found)
    assert all(a + n == b for (a, n), (b, _) in zip(ends, ends[1:], strict=False))


def test_a_piece_is_worked_out_once_whatever_stands_beside_it(library, monkeypatch):
    own = byte_bpe.TextEncoder(byte_bpe.encoder_of(byte_bpe.read_ranks(RANKS), public_tokenizers.PATTERN).vocabulary)
    asked, walk = [], own.vocabulary.piece_ids
    monkeypatch.setattr(own.vocabulary, "piece_ids", lambda piece: asked.append(piece) or walk(piece))
    words = ["thandouhe", "reoushing", "ciónmente", "\U0001dffdx"]
    text = " ".join(a + mark + b for a in words for b in words for mark in (".\n", ", ", "; ", " ", "\n\n", "-"))
    assert own.packed(text) == packed(library.encode_ordinary(text))
    assert len(asked) == len(set(asked))
