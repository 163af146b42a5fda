"""Byte-level BPE against the tiktoken library, the scan against the state machine and the pattern read one match at a time."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken

from revscope.llm import byte_bpe as B

from . import fixtures

ALPHABET = list("abstrevmld'' \t\n\r   é漢ß1²٣!?-_́😀\x1c\x1f​\u0085 ")


@pytest.fixture(scope="module")
def bpe():
    return B.RankBpe(B.rank_vocabulary())


@pytest.fixture(scope="module")
def library(bpe):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})


def encoded(bpe, texts):
    raw = [t.encode() for t in texts]
    return [np.frombuffer(b, "<u4") for b in bpe.encode(b"".join(raw), np.cumsum([0, *map(len, raw)]))]


def random_texts(n, seed=5):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 50))) for _ in range(n)]


def test_ids_and_bytes_equal_the_library(bpe, library):
    texts = [*random_texts(5000), "", "a" * 5000, " " * 3000 + "x", "'" * 500, "abc" * 3000, "<|endoftext|>", "don't I'll we've they're 'sit 'tis"]
    for text, ids in zip(texts, encoded(bpe, texts), strict=True):
        assert ids.tolist() == library.encode_ordinary(text)
        assert bpe.decode(ids) == text.encode()


def test_every_code_point(bpe, library):
    everything = "".join(chr(c) + ("x" if c % 3 else " ") for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for at in range(0, len(everything), 1 << 18):
        text = everything[at : at + (1 << 18)]
        assert encoded(bpe, [text])[0].tolist() == library.encode_ordinary(text)


def test_boundaries_are_the_patterns_matches(bpe):
    pattern = regex.compile(public_tokenizers.PATTERN)
    texts = [t for t in random_texts(800, seed=9) if t]
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    wanted = [o + len(t[: m.start()].encode()) for o, t in zip(offsets.tolist(), texts, strict=False) for m in pattern.finditer(t)]
    assert bpe.cuts(b"".join(raw), offsets).tolist() == wanted


@pytest.mark.parametrize("n", [0, 1, B.BLOCK, B.BLOCK + 1, 5000])
def test_scan_in_blocks_equals_one_reading(n):
    symbols = np.random.default_rng(n).integers(0, 16, n).astype(np.uint8)
    state, wanted = B.FRESH, []
    for s in symbols.tolist():
        wanted.append(state)
        state = int(B.AFTER[s * 8 + state])
    assert B.scan(symbols).tolist() == wanted


def test_merges_by_heap_and_by_rows_agree(bpe):
    rng = random.Random(2)
    for _ in range(200):
        piece = bytes(rng.choice(b"abcdef ") for _ in range(rng.randint(2, 90)))
        rows = np.frombuffer(bpe.merge([piece])[0], "<u4").tolist()
        assert rows == ([bpe.ranks[piece]] if piece in bpe.ranks else bpe._merge_long([bpe.single[b] for b in piece]))


def test_full_caches_change_nothing(monkeypatch, library):
    monkeypatch.setattr(B, "MEMO", 5)
    monkeypatch.setattr(B, "PAIRS", 5)
    small = B.RankBpe(B.rank_vocabulary())
    texts = [*random_texts(50), "ab" * 300]
    for _ in range(2):
        for text, ids in zip(texts, encoded(small, texts), strict=True):
            assert ids.tolist() == library.encode_ordinary(text)


def test_digests_of_all_rows(spark, library):
    rows = fixtures.rows()
    got = {r.doc_id: r for r in B.digests(fixtures.documents(spark)).collect()}
    assert len(got) == len(rows)
    for doc_id, text, *_ in rows:
        ids = library.encode_ordinary(text or "")
        r = got[doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())


def test_offsets_and_round_trip(spark):
    docs = fixtures.documents(spark)
    tokens = B.encode(docs)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    bpe = B.rank_bpe(B.rank_vocabulary())
    for r in tokens.collect():
        raw = texts[r.doc_id].encode()
        assert [raw[a:b] for a, b in zip(r.offsets[:-1], r.offsets[1:], strict=True)] == [bpe.tokens[i] for i in r.ids] and r.offsets[-1] == len(raw)
    assert {r.doc_id: r.decoded.decode() for r in B.decode(tokens).collect()} == texts


def test_null_and_repeated_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "x y"), (None, "x y"), (1, None), (1, "a" * 100_000)], "doc_id long, text string")
    assert sorted((r.doc_id is None, r.n_tokens) for r in B.digests(docs).collect()) == sorted([(True, 2), (True, 2), (False, 0), (False, len(B.rank_bpe(B.rank_vocabulary()).merge([b"a" * 100_000])[0]) // 4)])
    assert B.digests(fixtures.empty(spark)).collect() == [] and B.encode(fixtures.empty(spark)).collect() == []
