"""Packing into sequences of bounded length: best fit, then a swap-based local search.

Only documents longer than a sequence are cut, into full pieces behind a shorter
first one. Every piece gets a number, pieces are dealt to groups by its hash and each group is packed by best
fit over decreasing sizes; then moves, one-for-one and two-for-one exchanges
between underfull bins raise the sum of squared fills, which empties bins. The
bins that stay underfull in their groups are opened again and their pieces meet
in fewer groups, until one group holds them all or three groupings in a row free
hardly any bin (``LEAST_FREED``). A sequence is named by the smallest number of its pieces.
No group or task holds more than about ``group_rows`` pieces, whatever the input.

Defined results: a null text is empty and holds the end id alone; repeated rows
are packed each, whether their ids repeat or are null; an empty table gives no rows; null ids are kept as they are.
Extra columns are dropped.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revscope.cluster import ship_package
from revscope.llm._common import arrow_map, documents, keyed, released, slices, staged
from revscope.llm._tokens import byte_vocabulary, encoder

LENGTH = 2048
END_ID = 0
SLICE = 2 << 20
GROUP_ROWS = 20_000
#: Free parts of a bin's length below which it is left closed between rounds: first nearly full ones, so that the others meet in few groups, then none.
SLACKS = (1 / 64, 0.0)
#: A grouping stalls if it frees no more than this part of the bins that it opened; so many stalls in a row end a series.
LEAST_FREED = 1e-4
STALLS = 3
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = ["row", "doc_id", "piece", "start", "length", "ids_crc32"]


def cut_points(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens."""
    first = n % length or min(n, length)
    return [(0, first), *((at, length) for at in range(first, n, length))]


def pieces(docs: DataFrame, length: int = LENGTH, end_id: int = END_ID, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """The pieces of every whole text, its end id included; ``with_ids`` adds their ids as bytes."""
    vocabulary = vocabulary or byte_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        end = np.array([end_id], "<u4").tobytes()
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                out: list[tuple] = []
                for doc, ids in zip(batch.column(0).to_pylist(), encode([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                    ids += end
                    for k, (at, n) in enumerate(cut_points(len(ids) // 4, length)):
                        part = ids[4 * at : 4 * (at + n)]
                        out.append((doc, k, at, n, zlib.crc32(part), part if with_ids else None))
                columns = list(zip(*out, strict=True)) if out else [()] * 6
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][: 5 + with_ids]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=False)], names=names)

    return arrow_map(keyed(docs, id_col, text_col), run, PIECES + (", ids binary" if with_ids else ""))


def best_fit(sizes: np.ndarray, length: int) -> list[list[int]]:
    """Bins of indices: each size, the largest first, goes to the bin that it fills most."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = defaultdict(list)
    open_rooms = 0  # bit r is set while some bin has r free
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = open_rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                open_rooms ^= 1 << room
            bins[at].append(i)
        else:
            room, at = length, len(bins)
            bins.append([i])
        if room > size:
            by_room[room - size].append(at)
            open_rooms |= 1 << (room - size)
    return bins


class _Partners:
    """Underfull bins, found by the sums that they can take.

    A bin with ``room`` takes a sum t and gives back a piece b, or nothing (b = 0),
    if b < t <= b + room. The squared fills grow if what it gains is more than its
    giver is fuller, that is if b + room < t + the giver's room. For each reach
    b + room the index keeps the bins of that reach, those that give back least on
    top; a minimum over a range of reaches finds the partner that gains most.
    """

    def __init__(self, length: int):
        self.none = length + 1
        self.heaps: list[list[tuple[int, int, int]]] = [[] for _ in range(length + 1)]
        self.least = np.full(length + 1, self.none)  # by reach: the smallest b
        self.version: dict[int, int] = defaultdict(int)
        self.held: dict[int, list[int]] = {}
        self.levels: list[np.ndarray] = []  # minima over 1, 2, 4 ... reaches; none when out of date

    def put(self, at: int, sizes: set[int], room: int) -> None:
        self.held[at] = [b + room for b in (0, *sizes)]
        for reach in self.held[at]:
            heappush(self.heaps[reach], (reach - room, at, self.version[at]))
            if reach - room < self.least[reach]:
                self.least[reach] = reach - room
                self.levels = []

    def drop(self, at: int) -> None:
        self.version[at] += 1
        for reach in self.held.pop(at):
            heap = self.heaps[reach]
            while heap and heap[0][2] != self.version[heap[0][1]]:
                heappop(heap)
            least = heap[0][0] if heap else self.none
            if least != self.least[reach]:
                self.least[reach] = least
                self.levels = []

    def best(self, sums: np.ndarray, room: int) -> tuple[int, int, int]:
        """The place of the sum that adds most to a bin, the size that this bin gives back, and the bin (-1: none); ``room`` is the giver's."""
        n = len(self.least)
        if not self.levels:
            self.levels = [self.least]
            while 2 << len(self.levels) <= 2 * n:
                step = 1 << (len(self.levels) - 1)
                self.levels.append(np.minimum(self.levels[-1][:-step], self.levels[-1][step:]))
        fits = np.flatnonzero(sums < n)
        first = sums[fits]
        last = np.minimum(first + room, n)
        level = np.frexp(last - first)[1] - 1
        back = np.full(len(fits), self.none)
        for k in np.unique(level).tolist():
            own = level == k
            back[own] = np.minimum(self.levels[k][first[own]], self.levels[k][last[own] - (1 << k)])
        gain = first - back
        k = int(gain.argmax()) if len(gain) else -1
        if k < 0 or gain[k] <= 0:
            return 0, 0, -1
        reach = int(first[k]) + int(self.least[first[k] : last[k]].argmin())
        return int(fits[k]), int(back[k]), self.heaps[reach][0][1]


def local_search(bins: list[list[int]], sizes: np.ndarray, length: int) -> list[list[int]]:
    """Exchange between underfull bins until no exchange raises the sum of squared fills; empty bins go.

    Every underfull bin is a giver in turn, the least filled first, and all others
    are its partners. A giver gives one piece or two and takes back none or one; of
    all such exchanges that raise the squared fills the one is made that adds most
    to its partner. The search ends with a pass without a change.
    """
    bins = [list(b) for b in bins]
    fill = [int(sizes[b].sum()) for b in bins]
    partners = _Partners(length)

    def put(k: int) -> None:
        if 0 < fill[k] < length:
            partners.put(k, {int(sizes[i]) for i in bins[k]}, length - fill[k])

    for k in range(len(bins)):
        put(k)
    changed = True
    while changed:
        changed = False
        for giver in sorted(partners.held, key=fill.__getitem__):
            if giver not in partners.held:
                continue
            partners.drop(giver)
            while fill[giver]:
                sums, parts = _sums(bins[giver], sizes)
                k, back, other = partners.best(sums, length - fill[giver])
                if other < 0:
                    break
                take = parts[k]
                give = [i for i in bins[other] if sizes[i] == back][:1] if back else []
                partners.drop(other)
                bins[giver] = [i for i in bins[giver] if i not in take] + give
                bins[other] = [i for i in bins[other] if i not in give] + take
                fill[giver] -= int(sums[k]) - back
                fill[other] += int(sums[k]) - back
                put(other)
                changed = True
            put(giver)
    return [b for b in bins if b]


def _sums(mine: list[int], sizes: np.ndarray) -> tuple[np.ndarray, list[list[int]]]:
    """The sums of one piece or two of a bin, each of different sizes, and the pieces that make them."""
    by_size: dict[int, list[int]] = defaultdict(list)
    for i in mine:
        by_size[int(sizes[i])].append(i)
    parts = [[same[0]] for same in by_size.values()]
    parts += [same[:2] for same in by_size.values() if len(same) > 1]
    parts += [[a[0], b[0]] for a, b in combinations(by_size.values(), 2)]
    return np.array([sum(int(sizes[i]) for i in p) for p in parts]), parts


def _pack_groups(rows: DataFrame, length: int, n_groups: int, round_no: int) -> DataFrame:
    """Pack the pieces of each group; adds sequence_id, offset and fill."""
    ship_package(rows.sparkSession)

    def run(table: pa.Table) -> pa.Table:
        sizes = table.column("length").to_numpy()
        numbers = table.column("row").to_numpy()
        order = np.lexsort(tuple(table.column(c).fill_null(-1).to_numpy() for c in ("row", "ids_crc32", "start", "piece", "doc_id")))
        bins = local_search(best_fit(sizes[order], length), sizes[order], length)
        sequence, offset, fill = (np.zeros(len(sizes), np.int64) for _ in range(3))
        for members in bins:
            at = order[members]
            ends = np.cumsum(sizes[at])
            sequence[at], offset[at], fill[at] = numbers[at].min(), ends - sizes[at], ends[-1]
        return table.drop_columns(["part"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset)).append_column("fill", pa.array(fill))

    keys = F.xxhash64("row", F.lit(round_no))
    return rows.withColumn("part", F.pmod(keys, F.lit(n_groups))).groupBy("part").applyInArrow(released(run), f"row long, {PIECES}, sequence_id long, offset long, fill long")


def pack(rows: DataFrame, length: int = LENGTH, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Place pieces (columns of ``pieces``, none longer than ``length``) in sequences: adds sequence_id and offset.

    The pieces are staged with a number of their own, so that rows which repeat in
    every column stay apart; a column ``ids`` is brought back by that number.
    """
    # numbered in the staged table: whatever attempt of a task wrote it, the numbers stay
    whole = staged(rows.withColumn("row", F.monotonically_increasing_id()), "pieces")
    placed = _placed(whole.select(PLACED), length, group_rows)
    if "ids" in rows.columns:
        placed = placed.join(whole.select("row", "ids"), "row")
    return placed.drop("row")


def _placed(pieces_: DataFrame, length: int, group_rows: int) -> DataFrame:
    closed, kept, before, todo, round_no = [], None, None, pieces_, 0
    for slack in SLACKS:
        open_bins = F.col("fill") < length * (1 - slack)
        if kept is not None:
            # bins that stayed closed are opened as well, and the bins as they stand are the ones to beat
            every = _union([*closed, kept])
            closed, kept = [every.where(~open_bins)], every.where(open_bins)
            before, todo = kept.select("sequence_id").distinct().count(), kept.select(PLACED)
        stalls = 0
        while before is None or before:
            round_no += 1
            n_groups = max(1, -(-todo.count() // group_rows))
            packed = staged(_pack_groups(todo, length, n_groups, round_no), "packed")
            n_bins = packed.select("sequence_id").distinct().count()
            stalls = stalls + 1 if kept is not None and before - n_bins <= LEAST_FREED * before else 0
            if kept is None or n_bins < before:
                closed.append(packed.where(~open_bins))
                kept = packed.where(open_bins)
                before, todo = kept.select("sequence_id").distinct().count(), kept.select(PLACED)
            # a grouping that frees no bin leaves the bins as they were
            if n_groups == 1 or stalls == STALLS:
                break
    return _union([*closed, kept]).drop("fill")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def sequences(docs: DataFrame, length: int = LENGTH, **options) -> DataFrame:
    """The packed sequences themselves: sequence_id and its ids, pieces in the order of their offsets."""
    placed = pack(pieces(docs, length, with_ids=True, **options), length)
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.aggregate(parts, F.lit(b""), lambda acc, x: F.concat(acc, x["ids"])).alias("ids"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return pack(pieces(documents(spark, sf_dir)))


QUERIES = {"op10_packing": op10_packing}
ORACLES: dict[str, str] = {}
