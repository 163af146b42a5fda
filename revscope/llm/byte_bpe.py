"""Byte-level BPE by a vocabulary of ranks, with a pre-tokeniser that scans arrays instead of matching a pattern.

Every code point has a class: letter, number, space, other white space, apostrophe
or other. A look at the next two code points tells which apostrophes could open a
contraction and which white space is the last before something else. What is left
is a machine of eight states that reads classes and says where a match begins. A
class is then a function from states to states, and functions compose: the code
points of many texts are laid out in equal blocks, all blocks compose their
functions at once, the composed functions are scanned to give each block the
state that it begins in, and a second reading of all blocks marks the boundaries.
A text's first code point is a constant function, so texts need no block of their own.

The slices between boundaries go to pair merging: the adjacent pair whose joined
bytes have the lowest rank is merged first, the leftmost of equals. Pairs and
slices that were seen before come from bounded caches; long slices keep their pairs
in a heap. Each token's offset in the text's UTF-8 bytes is kept beside its id, and
decoding writes every token's bytes at its offset.

Defined results: a null text is empty, an empty text has no ids, no offsets and
decodes to nothing; a very long text is read whole; strings that look like special
tokens are ordinary text. Rows are independent, so ties, repeated or null ids and
empty tables need no rule. Extra columns are dropped.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from revscope.llm._common import arrow_map, documents, keyed, slices, table_bytes

SLICE = 2 << 20
#: Slices and pairs that a worker remembers; a full cache is emptied.
MEMO = 400_000
PAIRS = 1_000_000
#: Code points of a block of the scan, and bytes from which on a slice's pairs stand in a heap.
BLOCK = 128
LONG_SLICE = 96
#: Two token ids side by side in one number; the rank of a pair that no merge joins.
SHIFT = 24
NO_PAIR = 1 << 40

# Classes of code points, as the pattern's parts name them.
OTHER, LETTER, NUMBER, SPACE, WHITE, APOSTROPHE = range(6)
# Symbols that the machine reads: classes after a look at what follows.
S_OTHER, S_LETTER, S_NUMBER, S_JOINING, S_LAST_WHITE, S_WHITE, S_SHORT, S_LONG = range(8)
# States, each named by what the code point before belongs to.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_SPACE, IN_WHITE, ONE_LEFT, TWO_LEFT = range(8)


def machine() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether a match begins), for each symbol times 8 plus state; from symbol 8 on: the same as a text's first."""
    after, begins = np.zeros((16, 8), np.uint8), np.ones((16, 8), bool)
    for symbol, state, joined in ((S_LETTER, IN_LETTERS, [IN_LETTERS, AFTER_SPACE]), (S_NUMBER, IN_NUMBERS, [IN_NUMBERS, AFTER_SPACE]), (S_OTHER, IN_OTHERS, [IN_OTHERS, AFTER_SPACE]), (S_WHITE, IN_WHITE, [IN_WHITE])):
        after[symbol] = state
        begins[symbol, joined] = False
    after[S_JOINING], after[S_LAST_WHITE] = AFTER_SPACE, FRESH
    for symbol, state in ((S_SHORT, ONE_LEFT), (S_LONG, TWO_LEFT)):
        # an apostrophe opens a contraction only where no run of others takes it
        after[symbol] = state
        after[symbol, [IN_OTHERS, AFTER_SPACE]] = IN_OTHERS
        begins[symbol, [IN_OTHERS, AFTER_SPACE]] = False
    for state, to in ((TWO_LEFT, ONE_LEFT), (ONE_LEFT, FRESH)):
        after[S_LETTER, state] = to
        begins[S_LETTER, state] = False
    after[8:] = after[:8, FRESH][:, None]
    begins[8:] = True
    return after.ravel(), begins.ravel()


AFTER, BEGINS = machine()


def code_point_classes() -> np.ndarray:
    """The class of every code point, by the Unicode tables of the library that the ids must equal.

    The library is given a pattern of one class and every code point there is; it keeps those that match.
    """
    import tiktoken

    points = np.array([*range(0xD800), *range(0xE000, 0x110000)], np.uint32)
    everything = points.tobytes().decode("utf-32-le")
    classes = np.full(0x110000, OTHER, np.uint8)
    for name, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", WHITE)):
        one = tiktoken.Encoding(name, pat_str=name, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        found = bytes(one.encode_ordinary(everything)).decode().encode("utf-32-le")
        classes[np.frombuffer(found, np.uint32)] = kind
    classes[ord(" ")], classes[ord("'")] = SPACE, APOSTROPHE
    return classes


def symbols_of(points: np.ndarray, firsts: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The symbol of each code point of texts that stand one after the other; ``firsts``: where texts begin."""
    n = len(points)
    kinds = classes[points]
    first = np.zeros(n + 2, bool)
    first[firsts] = True
    first[n:] = True
    out = np.array([S_OTHER, S_LETTER, S_NUMBER, S_WHITE, S_WHITE, S_OTHER], np.uint8)[kinds]
    white = np.zeros(n + 1, bool)
    white[:n] = (kinds == SPACE) | (kinds == WHITE)
    # the last white space of a run, where something follows in the same text
    last = np.flatnonzero(white[:n] & ~white[1:] & ~first[1 : n + 1])
    out[last] = np.where(kinds[last] == SPACE, S_JOINING, S_LAST_WHITE)
    at = np.flatnonzero(kinds == APOSTROPHE)
    at = at[~first[at + 1]]
    one = points[at + 1]
    out[at[np.isin(one, [ord(c) for c in "stmd"])]] = S_SHORT
    at = at[~first[at + 2]]
    one, two = points[at + 1], points[at + 2]
    e, l = ord("e"), ord("l")
    out[at[(((one == ord("r")) | (one == ord("v"))) & (two == e)) | ((one == l) & (two == l))]] = S_LONG
    out[firsts] += 8
    return out


def scan(symbols: np.ndarray, state: int = FRESH) -> np.ndarray:
    """The state before each symbol: blocks compose their functions, the compositions are scanned, blocks are read again."""
    n = len(symbols)
    if n <= BLOCK:
        out = np.empty(n, np.uint8)
        for i, s in enumerate(symbols.tolist()):
            out[i] = state
            state = int(AFTER[s * 8 + state])
        return out
    blocks = -(-n // BLOCK)
    grid = np.zeros((BLOCK, blocks), np.uint16)
    padded = np.zeros(blocks * BLOCK, np.uint16)
    padded[:n] = symbols
    grid[:] = padded.reshape(blocks, BLOCK).T
    grid *= 8
    function = np.broadcast_to(np.arange(8, dtype=np.uint8), (blocks, 8))
    for row in grid:
        function = AFTER[row[:, None] + function]
    begin = np.empty(blocks, np.uint8)
    begin[:] = _compose(function, state)
    states = np.empty((BLOCK, blocks), np.uint8)
    for j, row in enumerate(grid):
        states[j] = begin
        begin = AFTER[row + begin]
    return states.T.reshape(-1)[:n]


def _compose(functions: np.ndarray, state: int) -> np.ndarray:
    """The state before each of a run of functions: the exclusive scan of their composition, applied to ``state``."""
    total, step = functions.copy(), 1
    while step < len(total):
        # total[k] is the composition of the functions k - step + 1 to k; first the earlier part, then the later
        total[step:] = np.take_along_axis(total[step:], total[:-step], axis=1)
        step *= 2
    return np.concatenate([[state], total[:-1, state]]).astype(np.uint8)


class Pairs(dict):
    """The rank of two tokens joined (NO_PAIR: none), looked up in the file's ranks when first asked for."""

    def __init__(self, ranks: dict[bytes, int], tokens: list[bytes]):
        self.ranks, self.tokens = ranks, tokens

    def __missing__(self, key: int) -> int:
        if len(self) >= PAIRS:
            self.clear()
        found = self[key] = self.ranks.get(self.tokens[key >> SHIFT] + self.tokens[key & (1 << SHIFT) - 1], NO_PAIR)
        return found


class RankBpe:
    """The merges of a file of ranks (base64 bytes and rank a line)."""

    def __init__(self, path: str):
        lines = (line.split() for line in Path(path).read_bytes().splitlines() if line)
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
        self.classes = code_point_classes()
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.blob = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.places = np.cumsum(self.lengths) - self.lengths
        self.single = [self.ranks[bytes([b])] for b in range(256)]
        self.bytes = np.array(self.single, np.int64)
        # every pair of tokens whose joined bytes are a token
        splits = [(a, b, rank) for token, rank in self.ranks.items() for k in range(1, len(token)) if (a := self.ranks.get(token[:k])) is not None and (b := self.ranks.get(token[k:])) is not None]
        a, b, rank = np.array(sorted(splits), np.int64).reshape(-1, 3).T
        self.codes, self.joined = a << SHIFT | b, rank
        self.memo: dict[bytes, bytes] = {}
        self.pairs = Pairs(self.ranks, self.tokens)

    def cuts(self, raw: bytes, offsets: np.ndarray) -> np.ndarray:
        """The byte offsets at which the matches of all texts begin; ``offsets``: where texts begin, and the end."""
        points = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
        places = np.zeros(len(points) + 1, np.int64)
        np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000), out=places[1:])
        begins = np.unique(offsets[:-1][offsets[:-1] < offsets[1:]])
        symbols = symbols_of(points, np.searchsorted(places, begins), self.classes)
        states = scan(symbols)
        return places[:-1][BEGINS[symbols.astype(np.int64) * 8 + states]]

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each slice as little-endian unsigned 32-bit integers, slices being not empty."""
        out = [b""] * len(pieces)
        sizes = np.array([len(p) for p in pieces], np.int64)
        widths = np.where(sizes >= LONG_SLICE, 0, np.maximum(8, np.left_shift(1, np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))))
        for width in np.unique(widths).tolist():
            rows = np.flatnonzero(widths == width).tolist()
            own = [pieces[k] for k in rows]
            if width:
                lone = [self.ranks.get(p, -1) for p in own]
                for k, whole in zip(rows, lone, strict=True):
                    if whole >= 0:
                        out[k] = whole.to_bytes(4, "little")
                left = [i for i, whole in enumerate(lone) if whole < 0]
                merged = self._merge_equal([own[i] for i in left], sizes[[rows[i] for i in left]], width) if left else []
                rows = [rows[i] for i in left]
            else:
                merged = [np.array([self.ranks[p]] if p in self.ranks else self._merge_long([self.single[b] for b in p]), "<u4").tobytes() for p in own]
            for k, ids in zip(rows, merged, strict=True):
                out[k] = ids
        return out

    def _ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        code = a << SHIFT | b
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where((self.codes[at] == code) & (a >= 0) & (b >= 0), self.joined[at], NO_PAIR)

    def _merge_equal(self, pieces: list[bytes], sizes: np.ndarray, width: int) -> list[bytes]:
        """Slices of up to ``width`` bytes as rows of one array; each round merges one pair of every row that has one."""
        count, columns = len(pieces), np.arange(width)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(count, width)
        done = np.where(columns < sizes[:, None], self.bytes[raw], -1)
        rows, ids = np.arange(count), done.copy()
        ranks = np.full((count, width), NO_PAIR)
        ranks[:, :-1] = self._ranks_of(ids[:, :-1], ids[:, 1:])
        while len(rows):
            at = ranks.argmin(axis=1)
            every = np.arange(len(rows))
            best = ranks[every, at]
            if not (live := best < NO_PAIR).all():
                done[rows[~live]] = ids[~live]
                rows, ids, ranks, at, best = rows[live], ids[live], ranks[live], at[live], best[live]
                every = np.arange(len(rows))
            # what stands behind the pair moves up by one place
            behind = columns[:-1] > at[:, None]
            ids[:, :-1] = np.where(behind, ids[:, 1:], ids[:, :-1])
            ranks[:, :-1] = np.where(behind, ranks[:, 1:], ranks[:, :-1])
            ids[:, -1], ranks[:, -1] = -1, NO_PAIR
            ids[every, at] = best
            ranks[every, at] = self._ranks_of(best, ids[every, at + 1])
            prior = np.flatnonzero(at > 0)
            ranks[prior, at[prior] - 1] = self._ranks_of(ids[prior, at[prior] - 1], best[prior])
        kept = done >= 0
        flat, ends = done[kept].astype("<u4").tobytes(), (4 * np.cumsum(kept.sum(1))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same merges with the pairs in a heap; entries whose tokens have changed are passed over."""
        n, pairs = len(ids), self.pairs
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := pairs[ids[i] << SHIFT | ids[i + 1]]) < NO_PAIR]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = rank, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := pairs[rank << SHIFT | ids[k]]) < NO_PAIR:
                    heapq.heappush(heap, (r, i, rank, ids[k]))
            h = before[i]
            if h >= 0 and (r := pairs[ids[h] << SHIFT | rank]) < NO_PAIR:
                heapq.heappush(heap, (r, h, ids[h], rank))
        return [x for x in ids if x >= 0]

    def encode(self, raw: bytes, offsets: np.ndarray) -> list[bytes]:
        """Per text its ids as little-endian unsigned 32-bit integers."""
        if not len(raw):
            return [b""] * (len(offsets) - 1)
        cuts = self.cuts(raw, offsets)
        bounds = [*cuts.tolist(), len(raw)]
        pieces = [raw[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        known = self.memo
        if len(known) > MEMO:
            known.clear()
        new = list(set(pieces).difference(known))
        known.update(zip(new, self.merge(new), strict=True))
        coded = [known[p] for p in pieces]
        ends = np.searchsorted(cuts, offsets).tolist()
        return [b"".join(coded[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def offsets_of(self, ids: np.ndarray) -> np.ndarray:
        """Where each token begins in the text's bytes, and where the last one ends."""
        return np.concatenate([[0], np.cumsum(self.lengths[ids])])

    def decode(self, ids: np.ndarray, offsets: np.ndarray | None = None) -> bytes:
        """Every token's bytes at its offset."""
        offsets = self.offsets_of(ids) if offsets is None else offsets
        sizes = np.diff(offsets)
        return self.blob[np.repeat(self.places[ids] - offsets[:-1], sizes) + np.arange(offsets[-1])].tobytes()


_encoders: dict[str, RankBpe] = {}


def rank_bpe(path: str) -> RankBpe:
    """One encoder for each file and worker process."""
    if path not in _encoders:
        _encoders[path] = RankBpe(path)
    return _encoders[path]


def rank_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _encoded(batches: Iterator[pa.RecordBatch], bpe: RankBpe) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for whole in batches:
        for batch in slices(whole, "text", SLICE):
            raw, offsets = table_bytes(batch.column(1))
            yield batch, bpe.encode(raw.tobytes(), offsets)


def encode(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the ids of every whole text, and ``offsets``: where each token begins in its UTF-8 bytes, and the end."""
    path = vocabulary or rank_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = rank_bpe(path)
        for batch, encoded in _encoded(batches, bpe):
            ids = [np.frombuffer(b, "<u4").astype(np.int32) for b in encoded]
            offsets = [bpe.offsets_of(i).astype(np.int64) for i in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(offsets, pa.list_(pa.int64()))], names=["doc_id", "ids", "offsets"])

    return arrow_map(keyed(docs, id_col, text_col), run, "doc_id long, ids array<int>, offsets array<long>")


def decode(tokens: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", ids_col: str = "ids", offsets_col: str = "offsets") -> DataFrame:
    """doc_id and the bytes that ids and their offsets stand for (null ids: null)."""
    path = vocabulary or rank_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = rank_bpe(path)
        for batch in batches:
            rows = [None if i is None else bpe.decode(np.array(i, np.int64), None if o is None else np.array(o, np.int64)) for i, o in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["doc_id", "decoded"])

    return arrow_map(tokens.selectExpr(f"`{id_col}` as doc_id", f"`{ids_col}` as ids", f"`{offsets_col}` as offsets"), run, "doc_id long, decoded binary")


def digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Per document the number of ids and the checksums of the ids and of the bytes that they decode to."""
    path = vocabulary or rank_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = rank_bpe(path)
        for batch, encoded in _encoded(batches, bpe):
            sums = [hashlib.sha256(b).hexdigest() for b in encoded]
            texts = [hashlib.sha256(bpe.decode(np.frombuffer(b, "<u4"))).hexdigest() for b in encoded]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(b) // 4 for b in encoded], pa.int64()), pa.array(sums, pa.string()), pa.array(texts, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return arrow_map(keyed(docs), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded."""
    return digests(documents(spark, sf_dir))


QUERIES = {"op11_byte_bpe": op11_byte_bpe}
ORACLES: dict[str, str] = {}
