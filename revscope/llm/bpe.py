"""BPE encoding by a segment tree over the ranks of adjacent pairs, and decoding.

The leaves of a word's tree hold (rank, place) of its adjacent symbol pairs, so
the root is the leftmost pair of lowest rank. A merge changes three leaves (the
pair itself, and those on its left and right) and repairs their paths to the
root, a logarithmic number of nodes; it ends when the root holds no pair. The
trees of all new words of a batch, grouped by size, are worked on at once as the
rows of a numpy array; a word of thousands of letters has a tree of its own. Long
words are first cut between bytes that no merge of the vocabulary ever joins.
Words that repeat are remembered in a bounded memo.

Defined results: a null text is empty; an empty text has no ids and decodes to
an empty text; strings of special tokens in a text become their ids, as in the
library. Rows are independent, so ties, repeated rows and empty tables need no
rule. Extra columns are dropped.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from revscope.llm._common import arrow_map, documents, keyed, slices

SLICE = 2 << 20
MEMO = 250_000
CHUNK_ROWS = 1 << 15
NO_PAIR = np.int64(1) << 62
#: Bytes from which on a word is cut where no merge can join, and from which on it has a tree of its own.
LONG_WORD = 64
LONE_TREE = 2048
#: Characters that all Unicode tables in use agree on; chunks with others are cut by the tokenizers library.
_NOT_LATIN = re.compile("[^\x00-ɏ]")


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where printable, else the next free one from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b if b in plain else spare))
        spare += b not in plain
    return out


class SegmentTreeBpe:
    """Merges of a vocabulary, applied to many words at once."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        self.size = max(vocab.values()) + 1
        symbols = byte_symbols()
        self.inner = np.array([vocab[c] for c in symbols], dtype=np.int64)
        self.final = np.array([vocab[c + suffix] for c in symbols], dtype=np.int64)
        codes = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], dtype=np.int64)
        order = np.argsort(codes)
        self.codes, self.ranks = codes[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        self.rank_of = dict(zip(codes.tolist(), range(len(codes)), strict=True))
        # joins[x, y]: some merge has a left part that ends with byte x and a right part that begins with byte y
        byte_of = {c: b for b, c in enumerate(symbols)}
        self.joins = np.zeros((256, 256), bool)
        for a, b in merges:
            self.joins[byte_of[a[-1]], byte_of[b[0]]] = True

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        code = a * self.size + b
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.ranks[at], NO_PAIR)

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word, words being not empty."""
        parts: list[tuple[bytes, bool]] = []
        counts = []
        for word in words:
            own = self._cut(word) if len(word) >= LONG_WORD else [word]
            counts.append(len(own))
            parts += [(p, k == len(own) - 1) for k, p in enumerate(own)]
        ids = self._encode_parts([p for p, _ in parts], np.array([last for _, last in parts], dtype=bool))
        ends = np.cumsum(counts)
        return [ids[e - 1] if n == 1 else np.concatenate(ids[e - n : e]) for e, n in zip(ends.tolist(), counts, strict=True)]

    def _cut(self, word: bytes) -> list[bytes]:
        raw = np.frombuffer(word, np.uint8)
        cuts = [0, *(np.flatnonzero(~self.joins[raw[:-1], raw[1:]]) + 1).tolist(), len(word)]
        return [word[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def _encode_parts(self, words: list[bytes], last: np.ndarray) -> list[np.ndarray]:
        """The ids of each part; ``last`` tells which of them end a word."""
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(words)
        width = np.left_shift(1, np.ceil(np.log2(np.maximum(lengths, 2))).astype(np.int64))
        for w in np.unique(width).tolist():
            rows = np.flatnonzero(width == w)
            if w >= LONE_TREE:
                for k in rows.tolist():
                    out[k] = self._encode_lone(words[k], bool(last[k]), w)
                continue
            step = max(1, CHUNK_ROWS * 16 // w)
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                for k, ids in zip(part.tolist(), self._encode_equal([words[k] for k in part.tolist()], lengths[part], last[part], w), strict=True):
                    out[k] = ids
        return out

    def _encode_lone(self, word: bytes, last: bool, width: int) -> np.ndarray:
        """One long word; its tree is a flat array, and repairs stop at the first node that keeps its value."""
        n, none, size, ranks = len(word), int(NO_PAIR), self.size, self.rank_of
        symbols = self.inner[np.frombuffer(word, np.uint8)]
        if last:
            symbols[-1] = self.final[word[-1]]
        tree = np.full(2 * width, NO_PAIR)
        found = self._rank(symbols[:-1], symbols[1:])
        tree[width : width + n - 1] = np.where(found < NO_PAIR, found * width + np.arange(n - 1), NO_PAIR)
        level = width >> 1
        while level:
            tree[level : 2 * level] = np.minimum(tree[2 * level : 4 * level : 2], tree[2 * level + 1 : 4 * level : 2])
            level >>= 1
        nodes, symbol = array("q", tree.tobytes()), array("q", symbols.tobytes())
        after, before = array("q", range(1, n + 1)), array("q", range(-1, n - 1))

        def put(place: int, value: int) -> None:
            node = place + width
            nodes[node] = value
            while node > 1:
                value = min(value, nodes[node ^ 1])
                node >>= 1
                if nodes[node] == value:
                    break
                nodes[node] = value

        while (root := nodes[1]) < none:
            left = root % width
            right = after[left]
            new = int(self.merged[root // width])
            symbol[left], symbol[right] = new, -1
            nxt = after[left] = after[right]
            put(right, none)
            rank = none
            if nxt < n:
                before[nxt] = left
                rank = ranks.get(new * size + symbol[nxt], none)
            put(left, rank * width + left if rank < none else none)
            prior = before[left]
            if prior >= 0:
                rank = ranks.get(symbol[prior] * size + new, none)
                put(prior, rank * width + prior if rank < none else none)
        out = np.frombuffer(symbol, np.int64)
        return out[out >= 0]

    def _encode_equal(self, words: list[bytes], n: np.ndarray, last: np.ndarray, width: int) -> list[np.ndarray]:
        count = len(words)
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(count, width)
        places = np.arange(width)
        inside = places < n[:, None]
        symbols = np.where(inside, self.inner[raw], -1)
        every = np.arange(count)
        ends = raw[every, n - 1]
        symbols[every, n - 1] = np.where(last, self.final[ends], self.inner[ends])
        after = np.where(places + 1 < n[:, None], places + 1, width)
        before = np.broadcast_to(places - 1, (count, width)).copy()
        tree = np.full((count, 2 * width), NO_PAIR)
        pair = np.flatnonzero((places + 1 < n[:, None]).ravel())
        flat = symbols.ravel()
        rank = self._rank(flat[pair], flat[pair + 1])
        tree[:, width:].reshape(-1)[:] = NO_PAIR
        leaves = np.full(count * width, NO_PAIR)
        leaves[pair] = np.where(rank < NO_PAIR, rank * width + pair % width, NO_PAIR)
        tree[:, width:] = leaves.reshape(count, width)
        level = width >> 1
        while level:
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
            level >>= 1

        def update(rows: np.ndarray, place: np.ndarray, value: np.ndarray | np.int64) -> None:
            node = place + width
            tree[rows, node] = value
            while width > 1 and len(node) and node[0] > 1:
                node = node >> 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

        rows = every
        while len(rows := rows[tree[rows, 1] < NO_PAIR]):
            root = tree[rows, 1]
            left = root % width
            right = after[rows, left]
            new = self.merged[root // width]
            symbols[rows, left] = new
            symbols[rows, right] = -1
            nxt = after[rows, right]
            after[rows, left] = nxt
            update(rows, right, NO_PAIR)
            has = nxt < width
            value = np.full(len(rows), NO_PAIR)
            r, p = rows[has], nxt[has]
            before[r, p] = left[has]
            found = self._rank(new[has], symbols[r, p])
            value[has] = np.where(found < NO_PAIR, found * width + left[has], NO_PAIR)
            update(rows, left, value)
            prior = before[rows, left]
            has = prior >= 0
            r, p = rows[has], prior[has]
            found = self._rank(symbols[r, p], new[has])
            update(r, p, np.where(found < NO_PAIR, found * width + p, NO_PAIR))
        alive = symbols >= 0
        return np.split(symbols[alive], np.cumsum(alive.sum(1))[:-1])


class WordBpe:
    """A lower-casing BPE with word ends, read from a file of the tokenizers library.

    The file's normalizer (NFC, white space to one space, lower case), its
    pattern and its special tokens are applied as the library does; for chunks with
    letters beyond Latin ones the library's own normalizer and pre-tokenizer are
    called, so that its Unicode tables hold. The merges are always the tree's.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        self.normalize, self.pre_tokenize = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.byte_of = {c: b for b, c in enumerate(byte_symbols())}
        spec = json.loads(Path(path).read_text())
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.tree = SegmentTreeBpe(model["vocab"], [tuple(m) for m in model["merges"]], self.suffix)
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = {s: np.array([i], "<u4").tobytes() for s, i in special.items()}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        names = model["vocab"] | special
        self.names = [""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.names[i] = name
        self.memo: dict[str, bytes] = {}

    def _pieces(self, chunk: str) -> list[bytes]:
        if _NOT_LATIN.search(chunk):
            return [bytes([self.byte_of[c] for c in piece]) for piece, _ in self.pre_tokenize(self.normalize(chunk))]
        # the library lowers each character by itself, so a final sigma has no form of its own
        text = unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()
        return [p.encode() for p in self.pattern.findall(text)]

    def _learn(self, chunks: set[str]) -> None:
        cut = {c: self._pieces(c) for c in chunks}
        words = list({p for ps in cut.values() for p in ps})
        ids = {w: i.astype("<u4").tobytes() for w, i in zip(words, self.tree.encode_words(words), strict=True)}
        for c, ps in cut.items():
            self.memo[c] = b"".join([ids[p] for p in ps])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Per text its ids as little-endian unsigned 32-bit integers."""
        cut: list[list[str]] = []
        for text in texts:
            parts = self.split.split(text) if self.split and any(s in text for s in self.special) else [text]
            chunks: list[str] = []
            for k, part in enumerate(parts):
                chunks += [part] if k % 2 else part.replace("\n", " ").split(" ")
            cut.append(chunks)
        known = self.memo
        if new := set().union(*cut).difference(known):
            if len(known) + len(new) > MEMO:
                known.clear()
                new = set().union(*cut)
            self._learn(new - self.special.keys())
            known.update(self.special)
        return [b"".join([known[c] for c in chunks]) for chunks in cut]

    def decode(self, ids: np.ndarray) -> str:
        """The file names no decoder: its tokens are joined by spaces as they are."""
        names = self.names
        return " ".join([names[i] for i in ids.tolist()])


_encoders: dict[str, WordBpe] = {}


def _bpe(path: str) -> WordBpe:
    if path not in _encoders:
        _encoders[path] = WordBpe(path)
    return _encoders[path]


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """doc_id and the ids of every whole text; ``decoded`` adds the text that they decode to."""
    path = vocabulary or word_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(path)
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                ids = [np.frombuffer(b, "<u4").astype(np.int32) for b in bpe.encode([t or "" for t in batch.column(1).to_pylist()])]
                columns = [batch.column(0), pa.array(ids, pa.list_(pa.int32()))]
                if decoded:
                    columns.append(pa.array([bpe.decode(i) for i in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "decoded"][: len(columns)])

    return arrow_map(keyed(docs, id_col, text_col), run, "doc_id long, ids array<int>" + (", decoded string" if decoded else ""))


def decode(tokens: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the text of every row of ids (null: null)."""
    path = vocabulary or word_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(path)
        for batch in batches:
            texts = [None if i.as_py() is None else bpe.decode(np.array(i.as_py(), np.int64)) for i in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "decoded"])

    return arrow_map(tokens.selectExpr(f"`{id_col}` as doc_id", f"`{ids_col}` as ids"), run, "doc_id long, decoded string")


def digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Per document the number of ids and the checksums of the ids and of their decoded text."""
    path = vocabulary or word_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(path)
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                encoded = bpe.encode([t or "" for t in batch.column(1).to_pylist()])
                sums = [hashlib.sha256(b).hexdigest() for b in encoded]
                texts = [hashlib.sha256(bpe.decode(np.frombuffer(b, "<u4")).encode()).hexdigest() for b in encoded]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(b) // 4 for b in encoded], pa.int64()), pa.array(sums), pa.array(texts)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return arrow_map(keyed(docs), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded."""
    return digests(documents(spark, sf_dir))


QUERIES = {"op2_bpe": op2_bpe}
ORACLES: dict[str, str] = {}
