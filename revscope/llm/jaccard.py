"""Similarity join of documents by their word shingles: groups of texts that overlap by three quarters.

Method, with no link lost:

1. Every text becomes its set of distinct 5-word shingle hashes. Texts with equal
   sets (the same size and the same two 64-bit fingerprints) are copies of one
   another and go on as one representative, known by a number of its own.
2. Sets that overlap enough share a hash of their prefixes, a quarter of each set
   under any one order of hashes. The order puts shingles last that repeat often,
   so that passages common to many texts rarely stand in a prefix. Sets that meet
   under a prefix hash form a block; blocks with the same members count once.
3. In a block the sets are points: shingles are hashed into groups and a point
   counts them per group. An R-tree packs points of like size by their coordinates
   and keeps the coordinate maxima of each node; the summed minima of a query and a
   node bound the overlap with every set below it, so most of the tree is never
   opened. Only a spanning forest of the surviving pairs is kept.
4. Sets that the forests connect are brought together whole, and pairs that
   survive the same bound are verified by exact overlap. A set that is already
   connected is not compared again, so a group of thousands of copies costs about
   one comparison for each.
5. Verified links are closed to components.

Blocks and candidate groups beyond a size are dealt to tiles, each row to one tile,
and a few pivots of the group to all of them. A group of near copies is connected
by its pivots then, and nothing is left to compare between tiles. What is not
connected to the group's largest component meets all tiles in a second pass; only
these rows and the tiles they meet are repeated. None is capped, and none is held
whole by one task.

Defined results: a null text, or one without words, has the empty set and is
linked with nothing; a text of one to four words has one shingle, the whole
sequence; ties cannot occur, as components carry their smallest doc_id (null only
if all ids in it are null); rows that repeat a doc_id are nodes of their own.
Extra columns are dropped by ``components_of`` and kept by ``one_of_each``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revscope.llm._common import arrow_map, bitmap_split, documents, grouped, hash_words, keyed, mix64, slices, small_batches, staged, table_bytes
from revscope.llm.suffix_dedup import run_hashes

WORDS = 5
#: Bytes of text hashed at a time; numpy holds about 60 bytes for each.
SLICE = 1 << 18
#: Points of a tile of a block, and shingles of a tile of a candidate group.
TILE_POINTS = 512
TILE_SHINGLES = 100_000
#: Rows of a large block or group, about, that all of its tiles get.
PIVOTS = 8
#: Children of a node of the tree, and points of like size that are packed by their coordinates.
FANOUT = 16
BAND = FANOUT * FANOUT
#: Places of the bitmap that frequent shingles are marked in. Its size is fixed, and any marking gives a valid order.
PLACES = 1 << 25
#: The most frequent shingles are marked, as many as leave this part of the bitmap or more unmarked.
UNMARKED = 7 / 8
#: Shingles gathered before repeats among them are counted.
GATHER = 4 << 20
LOWEST = -(2**63)

def linked(overlap: np.ndarray, a: int, b: np.ndarray) -> np.ndarray:
    """100 * intersection >= 75 * union, for set sizes a and b."""
    return 7 * overlap >= 3 * (a + b)


def shingle_sets(batch: pa.RecordBatch, size: int = WORDS) -> list[np.ndarray]:
    """Per text its sorted distinct shingle hashes."""
    words, _, _, firsts = hash_words(*table_bytes(batch.column(batch.schema.get_field_index("text"))), lower=True)
    lengths = np.diff(firsts)
    if len(words) >= size:
        runs = run_hashes(words, size)
    out = []
    for first, n in zip(firsts[:-1].tolist(), lengths.tolist(), strict=True):
        if n >= size:
            out.append(np.unique(runs[first : first + n - size + 1]))
        elif n:
            out.append(mix64(run_hashes(words[first : first + n], n) + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def width_of(n: int) -> int:
    """Groups that a set of n shingles is counted in: a power of two, about one for every four to eight shingles."""
    return 1 << max(4, int(n // 8).bit_length())


def count_vector(hashes: np.ndarray) -> np.ndarray:
    width = width_of(len(hashes))
    # the low bits choose the group, so that halves of a wide vector add up to a narrow one
    return np.bincount((hashes & np.uint64(width - 1)).astype(np.int64), minlength=width).astype("<u2")


def packed(vector: np.ndarray) -> bytes:
    """A vector in one byte for each group where its counts allow, else in two."""
    return (vector.astype("u1") if vector.max(initial=0) < 256 else vector).tobytes()


def unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, "u1" if len(data) == width_of(n) else "<u2").astype("<u2")


def fold(vectors: np.ndarray, width: int) -> np.ndarray:
    while vectors.shape[-1] > width:
        half = vectors.shape[-1] // 2
        vectors = vectors[..., :half] + vectors[..., half:]
    return vectors


def _packed_order(points: np.ndarray) -> np.ndarray:
    """An order that puts like points side by side: slabs along the coordinate that varies most, each sorted by the next one."""
    spread = points.var(axis=0)
    by = np.argsort(-spread, kind="stable")
    order = np.argsort(points[:, by[0]], kind="stable")
    slab = FANOUT * max(1, int(np.sqrt(len(points) / FANOUT)))
    cuts = range(0, len(points), slab)
    return np.concatenate([part[np.argsort(points[part, by[1]], kind="stable")] for k in cuts for part in [order[k : k + slab]]])


class CountTree:
    """An R-tree over the count vectors of sets, one for each width of vectors."""

    def __init__(self, sizes: np.ndarray, vectors: list[np.ndarray]):
        self.sizes, self.vectors = sizes, vectors
        widths = np.array([len(v) for v in vectors])
        self.rows: dict[int, np.ndarray] = {}
        self.trees: dict[tuple[int, int], tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]] = {}
        #: Points that queries might have met, and points whose vectors they did meet.
        self.met, self.opened = 0, 0
        for width in np.unique(widths).tolist():
            own = np.flatnonzero(widths == width)
            own = own[np.argsort(sizes[own], kind="stable")]
            if len(own) > 4 * FANOUT:
                bands = [own[k : k + BAND] for k in range(0, len(own), BAND)]
                own = np.concatenate([band[_packed_order(np.stack([vectors[i] for i in band.tolist()]))] for band in bands])
            self.rows[width] = own
        self.reach = {width: (int(sizes[own].min()), int(sizes[own].max())) for width, own in self.rows.items()}

    def _tree(self, own: int, width: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        """The points of one width folded to another, and level by level from the leaves the coordinate maxima and the least and largest sizes of nodes."""
        if (own, width) not in self.trees:
            rows = self.rows[own]
            points = np.stack([fold(self.vectors[i], width) for i in rows.tolist()])
            level, low, high, out = points, self.sizes[rows], self.sizes[rows], []
            while len(level) > 4 * FANOUT:
                at = np.arange(0, len(level), FANOUT)
                level, low, high = np.maximum.reduceat(level, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
                out.append((level, low, high))
            self.trees[own, width] = points, out
        return self.trees[own, width]

    def near(self, i: int, free: np.ndarray) -> np.ndarray:
        """Places of the free sets that may be linked with set i, by the bound on the overlap."""
        n = int(self.sizes[i])
        lo, hi = -(-3 * n // 4), 4 * n // 3
        found = []
        for own, rows in self.rows.items():
            least, most = self.reach[own]
            if most < lo or least > hi:
                continue
            width = min(own, len(self.vectors[i]))
            query = fold(self.vectors[i], width)
            points, levels = self._tree(own, width)
            at = np.arange(len(levels[-1][0]) if levels else len(points))
            for depth in range(len(levels) - 1, -1, -1):
                maxima, low, high = levels[depth]
                at = at[(low[at] <= hi) & (high[at] >= lo)]
                bound = np.minimum(maxima[at], query).sum(1, dtype=np.int64)
                at = at[linked(bound, n, np.maximum(low[at], lo))]
                at = (at[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                at = at[at < (len(levels[depth - 1][0]) if depth else len(points))]
            self.met, self.opened = self.met + len(points), self.opened + len(at)
            size = self.sizes[rows[at]]
            at = at[(size >= lo) & (size <= hi) & free[rows[at]]]
            bound = np.minimum(points[at], query).sum(1, dtype=np.int64)
            found.append(rows[at[linked(bound, n, self.sizes[rows[at]])]])
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def spanning_forest(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """(root, member) pairs that connect what ``near(i, free)`` connects, searched breadth first."""
    free, edges = np.ones(n, bool), []
    for root in range(n):
        if not free[root]:
            continue
        free[root] = False
        queue = [root]
        while queue:
            hits = near(queue.pop(), free)
            free[hits] = False
            edges += [(root, j) for j in hits.tolist()]
            queue += hits.tolist()
    return edges


def repeats(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values that stand more than once, and how often. Sorts ``values`` in place, so that next to them only a byte for each is held."""
    values.sort()
    edge = np.zeros(len(values) + 1, np.int8)
    edge[1:-1] = values[1:] == values[:-1]
    steps = np.diff(edge)
    first, last = np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)
    return values[first], last - first + 1


def _frequent(docs: DataFrame) -> np.ndarray:
    """A bitmap over the places of the shingles that repeat most, ``PLACES`` bits whatever the input.

    Repeats are counted inside tasks and summed. Shingles are marked from a count
    on that is the least power of two whose shingles fit the bitmap.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        room, filled = np.empty(GATHER, np.uint64), 0

        def repeated() -> pa.RecordBatch:
            keys, counts = repeats(room[:filled])
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["key", "n"])

        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                for s in shingle_sets(batch):
                    if filled and filled + len(s) > len(room):
                        yield repeated()
                        filled = 0
                    if len(s) > len(room):
                        room = np.empty(len(s), np.uint64)
                    room[filled : filled + len(s)] = s
                    filled += len(s)
        if filled:
            yield repeated()

    counts = staged(arrow_map(docs.select("doc_id", "text"), run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "shingle-counts")
    powers = {r.power: r.keys for r in counts.groupBy(F.floor(F.log2("n")).alias("power")).agg(F.count("*").alias("keys")).collect()}
    least = next(p for p in range(1, 65) if sum(keys for power, keys in powers.items() if power >= p) <= (1 - UNMARKED) * PLACES)
    counts = counts.where(F.floor(F.log2("n")) >= least)
    place = F.pmod("key", F.lit(PLACES))
    words = counts.select(place.alias("p")).groupBy(F.floor(F.col("p") / 64).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias("bits")).toPandas()
    bitmap = np.zeros(PLACES // 64, np.uint64)
    bitmap[words["word"].to_numpy(dtype=np.int64)] = words["bits"].to_numpy(dtype=np.int64).view(np.uint64)
    return bitmap


def prefix(hashes: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    """The first hashes of a set in the common order: those not marked as frequent by value, then the marked ones."""
    n = len(hashes)
    if not n:
        return hashes
    place = hashes & np.uint64(PLACES - 1)
    marked = (bitmap[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1)
    return np.concatenate([hashes[marked == 0], hashes[marked == 1]])[: n - -(-3 * n // 4) + 1]


def across(fresh: np.ndarray, labels: np.ndarray, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Pairs that connect each fresh set with every component that it is near to; ``labels`` tells which sets are connected already."""
    edges = []
    for i in np.flatnonzero(fresh).tolist():
        hits = near(i, labels != labels[i])
        edges += [(i, j) for j in hits[np.unique(labels[hits], return_index=True)[1]].tolist()]
    return edges


def _describe(docs: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """Per row (doc_id, text_key, text): set size, two fingerprints of the set, its count vector and its prefix."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                sets = shingle_sets(batch)
                sizes = [len(s) for s in sets]
                marks = [fingerprint(s) for s in sets]
                prefixes = [prefix(s, shared.value).view(np.int64) for s in sets]
                columns = [
                    batch.column(0),
                    batch.column(1),
                    pa.array(sizes, pa.int64()),
                    pa.array([m[0] for m in marks], pa.int64()),
                    pa.array([m[1] for m in marks], pa.int64()),
                    pa.array([packed(count_vector(s)) if len(s) else b"" for s in sets], pa.binary()),
                    pa.array(prefixes, pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "n", "mark", "mark2", "vector", "prefix"])

    return arrow_map(docs.select("doc_id", "text_key", "text"), run, "doc_id long, text_key long, n long, mark long, mark2 long, vector binary, prefix array<long>")


def fingerprint(hashes: np.ndarray) -> tuple[int, int]:
    a = mix64(hashes + np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)
    b = np.bitwise_xor.reduce(mix64(hashes ^ np.uint64(0xD6E8FEB86659FD93))) if len(hashes) else np.uint64(0)
    return int(np.uint64(a).astype(np.int64)), int(np.uint64(b).astype(np.int64))


Forest = Callable[[pa.Table, np.ndarray | None], list[tuple[int, int]]]


def _edges(rows: DataFrame, keys: list[str], forest: Forest) -> DataFrame:
    """(a, b): what ``forest`` connects among the rows of each value of ``keys``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, keys):
            fresh = table.column("fresh").to_numpy() if "fresh" in table.column_names else None
            if table.num_rows > 1 and (edges := forest(table, fresh)):
                node = table.column("node").to_numpy()
                a, b = np.array(edges).T
                yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], names=["a", "b"])

    return arrow_map(rows.repartition(*keys).sortWithinPartitions(*keys, "n", "node"), run, "a long, b long").distinct()


def _connected_in(groups: Callable[[Column], DataFrame], sized: DataFrame, forest: Forest) -> DataFrame:
    """(node, label): components of the pairs that ``forest`` finds inside groups.

    ``sized`` has a row (group, node, tiles, pivot_of) for each member, ``groups``
    adds what the forest needs to the rows that meet a condition on ``tiles``.
    """
    edges = _edges(groups(F.col("tiles") == 1), ["group"], forest)
    if sized.where("tiles > 1").isEmpty():
        return connected(edges)
    tile = F.pmod(F.xxhash64("node", "group"), F.col("tiles")).cast("int")
    large = staged(groups(F.col("tiles") > 1).withColumn("tile", tile), "large-groups")
    pivot = F.pmod(F.xxhash64("node", "group", F.lit(7)), F.col("pivot_of")) == 0
    every = F.sequence(F.lit(0), (F.col("tiles") - 1).cast("int"))
    tiles = large.withColumn("tile", F.explode(F.when(pivot, every).otherwise(F.array("tile"))))
    known = staged(connected(edges.unionByName(_edges(tiles, ["group", "tile"], forest))), "tile-labels")
    # what its group's largest component does not hold meets all tiles of the group
    marked = staged(large.join(known, "node", "left").withColumn("label", F.coalesce("label", "node")), "large-labels")
    main = staged(marked.groupBy("group", "label").count().groupBy("group").agg(F.max_by("label", F.struct("count", "label")).alias("main")), "main-components")
    marked = marked.join(main, "group")
    fresh = marked.where("label <> main")
    if fresh.isEmpty():
        return known
    meeting = staged(fresh.groupBy("group").agg(F.ceil(F.count("*") * F.max("tiles") / F.max("members")).cast("int").alias("meeting")), "meeting")
    marked = marked.join(meeting, "group")
    turn = F.explode(F.sequence(F.lit(0), F.col("meeting") - 1))
    old = marked.withColumns({"turn": turn, "fresh": F.lit(False)})
    new = marked.where("label <> main").withColumn("turn", F.pmod(F.xxhash64("node", F.lit(3)), F.col("meeting")).cast("int")).withColumns({"tile": F.explode(every), "fresh": F.lit(True)})
    more = _edges(old.unionByName(new), ["group", "tile", "turn"], forest)
    return connected(more.unionByName(known.select(F.col("node").alias("a"), F.col("label").alias("b"))))


def _candidates(nodes: DataFrame) -> DataFrame:
    """(node, label): components of the pairs of sets that survive the bound in some block."""
    keys = nodes.select("node", F.explode("prefix").alias("key")).where("key is not null")
    blocks = keys.groupBy("key").agg(F.count("*").alias("members"), F.bit_xor(F.xxhash64("node")).alias("block")).where("members > 1")
    members = keys.join(staged(blocks, "blocks"), "key").groupBy("block", "node").agg(F.max("members").alias("members"))
    tiles = F.ceil(F.col("members") / TILE_POINTS).cast("int")
    sized = staged(members.select(F.col("block").alias("group"), "node", "members", tiles.alias("tiles"), F.ceil(F.col("members") / PIVOTS).alias("pivot_of")), "block-members")

    def forest(table: pa.Table, fresh: np.ndarray | None) -> list[tuple[int, int]]:
        sizes = table.column("n").to_numpy()
        vectors = [unpacked(v.as_py(), n) for v, n in zip(table.column("vector"), sizes.tolist(), strict=True)]
        if len(sizes) == 2:
            width = min(map(len, vectors))
            bound = np.minimum(fold(vectors[0], width), fold(vectors[1], width)).sum(dtype=np.int64)
            return [(0, 1)] if linked(bound, int(sizes[0]), int(sizes[1])) else []
        near = CountTree(sizes, vectors).near
        return spanning_forest(len(sizes), near) if fresh is None else across(fresh, table.column("label").to_numpy(), near)

    vectors = nodes.select("node", "n", "vector")
    return _connected_in(lambda which: sized.where(which).join(vectors, "node"), sized, forest)


def connected(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of the component of every node that has an edge.

    Alternating large-star and small-star steps, each written to the shared
    folder, until every node has one edge, to a node that has none. The smallest
    neighbours are written first, so that Spark can split the edges of a hub.
    """
    e = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        roots = e.select(F.col("b").alias("a")).distinct().withColumn("root", F.lit(1))
        open_nodes = e.groupBy("a").agg(F.count("*").alias("n")).join(roots, "a", "left").where("n > 1 or root = 1")
        if open_nodes.isEmpty():
            return e.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = staged(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least-neighbours")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_least, "a")
        e = staged(small.select("a", F.col("m").alias("b")).unionByName(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct(), "edges")


def _verified(docs: DataFrame, nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """(node, label): components of the links inside each candidate group."""
    wanted = staged(groups.select(F.col("label").alias("group"), "node").join(nodes.select("node", "doc_order", "text_key", "mark", "mark2", "n"), "node"), "wanted-nodes")
    tiles = wanted.groupBy("group").agg(F.ceil(F.sum("n") / TILE_SHINGLES).cast("int").alias("tiles"), F.count("*").alias("members"))
    # the tiles are known before the texts move, so that sets are shuffled once
    wanted = staged(wanted.join(staged(tiles, "group-tiles"), "group").withColumn("pivot_of", F.ceil(F.col("members") / PIVOTS)), "wanted")
    names = ["node", "group", "tiles", "members", "pivot_of", "mark", "mark2"]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                sets = shingle_sets(batch)
                mark, mark2 = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("mark", "mark2"))
                own = [k for k, s in enumerate(sets) if fingerprint(s) == (mark[k], mark2[k])]
                kept = [batch.column(batch.schema.get_field_index(c)).take(pa.array(own, pa.int64())) for c in names[:5]]
                yield pa.RecordBatch.from_arrays([*kept, pa.array([len(sets[k]) for k in own], pa.int64()), pa.array([sets[k].tobytes() for k in own], pa.binary())], names=[*names[:5], "n", "hashes"])

    def forest(table: pa.Table, fresh: np.ndarray | None) -> list[tuple[int, int]]:
        sizes = table.column("n").to_numpy()
        sets = [np.frombuffer(h.as_py(), np.uint64) for h in table.column("hashes")]
        tree = CountTree(sizes, [count_vector(s) for s in sets])

        def near(i: int, free: np.ndarray) -> np.ndarray:
            at = tree.near(i, free)
            if not len(at):
                return at
            own, others = sets[i], np.concatenate([sets[j] for j in at.tolist()])
            place = np.minimum(np.searchsorted(own, others), len(own) - 1)
            starts = np.cumsum(sizes[at]) - sizes[at]
            overlap = np.add.reduceat((own[place] == others).astype(np.int64), starts)
            return at[linked(overlap, int(sizes[i]), sizes[at])]

        return spanning_forest(len(sizes), near) if fresh is None else across(fresh, table.column("label").to_numpy(), near)

    def sets_of(which: Column) -> DataFrame:
        some = wanted.where(which)
        near, _ = bitmap_split(docs, some, "doc_order")
        texts = near.join(some.select("doc_order", "text_key", *names), ["doc_order", "text_key"]).select("text", *names)
        return arrow_map(texts, gather, "node long, group long, tiles int, members long, pivot_of long, n long, hashes binary")

    return _connected_in(sets_of, wanted, forest)


def _components(docs: DataFrame) -> DataFrame:
    """``_components_in_batches`` with little memory beside the heap. All that runs Python is staged, so nothing of it is left to run later."""
    with small_batches(docs.sparkSession):
        return _components_in_batches(docs)


def _components_in_batches(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, doc_order, text_key, text): doc_id, text_key, row (its number), n, group, component (the smallest doc_id of the group), known (it has a copy or a link)."""
    sets = staged(_describe(docs, _frequent(docs)).withColumns({"doc_order": F.coalesce("doc_id", F.lit(LOWEST)), "row": F.monotonically_increasing_id()}), "shingle-sets")
    filled = sets.where("n > 0")
    same = ["mark", "mark2", "n"]
    first = F.min(F.struct("doc_order", "row"))["row"]
    copied = staged(filled.groupBy(*same).agg(first.alias("node"), F.min("doc_id").alias("first"), F.count("*").alias("rows")).where("rows > 1").drop("rows"), "copied-sets")
    copies = staged(filled.select(*same, "row").join(copied, same).select("row", "node", "first"), "set-copies")
    # only sets that may be copies are shuffled to find out
    near, far = bitmap_split(filled, copies, "row")
    own = near.join(copies.where("row <> node").select("row"), "row", "left_anti").select(far.columns).unionByName(far)
    nodes = own.withColumnRenamed("row", "node")
    groups = staged(_candidates(nodes), "candidate-groups")
    labels = staged(_verified(docs, nodes, groups), "labels")
    # the smallest doc_id of each set, of each component, of each set in a component, of each copy
    firsts = nodes.select("node", F.col("doc_id").alias("own")).join(labels, "node").join(copied.select("node", "first"), "node", "left").withColumn("own", F.coalesce("first", "own"))
    firsts = staged(firsts.select("node", "label", "own"), "linked-sets")
    smallest = staged(firsts.groupBy("label").agg(F.min("own").alias("component")), "smallest")
    linked_sets = staged(firsts.join(smallest, "label").select("node", "label", "component"), "set-components")
    by_copy = copies.join(linked_sets, "node", "left").select("row", F.coalesce("label", "node").alias("group"), F.coalesce("component", "first").alias("component"))
    others = linked_sets.join(copied.select("node"), "node", "left_anti").select(F.col("node").alias("row"), F.col("label").alias("group"), "component")
    known = staged(by_copy.unionByName(others).withColumn("known", F.lit(True)), "known-components")
    near, far = bitmap_split(sets.select("doc_id", "text_key", "row", "n"), known, "row")
    own = {"group": F.col("row"), "component": F.col("doc_id"), "known": F.lit(False)}
    joined = near.join(known, "row", "left").select(*near.columns, *(F.when(F.col("known"), F.col(c)).otherwise(v).alias(c) for c, v in own.items()))
    return joined.unionByName(far.withColumns(own))


def _with_keys(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("doc_id", F.lit(LOWEST)).alias("doc_order"), F.xxhash64("text").alias("text_key"), "text")


def components_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    return _components(_with_keys(keyed(docs, id_col, text_col))).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """Of each component the row with the smallest doc_id, with all its columns; rows without words all stay.

    A null id comes after all others. Of rows that repeat that doc_id one stays.
    Only rows that may have a copy or a link are shuffled.
    """
    names = docs.columns
    found = staged(_components(_with_keys(keyed(docs))).where("n > 0"), "groups")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key", "row"))
    chosen = staged(found.groupBy("group").agg(best.alias("best")).select(F.coalesce("best.doc_id", F.lit(LOWEST)).alias("__order"), F.col("best.text_key").alias("__text")).distinct(), "chosen-rows")
    keyed_docs = docs.withColumns({"__order": F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)), "__text": F.xxhash64("text")})
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    near, far = bitmap_split(keyed_docs, found.where("known").select(F.col("text_key").alias("__text")), "__text")
    once = near.where(worded).join(chosen, ["__order", "__text"], "left_semi").groupBy("__order", "__text").agg(F.first(F.struct(*names)).alias("doc")).select("doc.*")
    return far.select(names).unionByName(near.where(~worded).select(names)).unionByName(once)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents."""
    return components_of(documents(spark, sf_dir))


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
starts AS (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM words WHERE len(w) > 0),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM starts),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * i >= 75 * (x.n + y.n - i)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM sizes
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, coalesce(r.c, d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes s ON d.doc_id = s.doc_id LEFT JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON d.doc_id = r.a
"""

QUERIES = {"op5_jaccard_join": op5_jaccard_join}
ORACLES = {"op5_jaccard_join": ORACLE}
