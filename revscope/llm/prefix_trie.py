"""The trie of all conversations' prefixes, read off preorder intervals.

A node is a distinct sequence of turns. Its name is the exclusive or of a 128-bit
hash of each turn at its place, so the names of all prefixes are a running aggregate
whose parts combine: a conversation is cut wherever a range of rows ends, and the
pieces' totals are added to those behind. Rows that share a name are checked for the
same last turn (by SHA-256) and the same parent; a collision stops the job.

Runs of nodes with one child each are chains; their tops are found by pointer
doubling, in which no node is asked for twice. A chain's key is the list of the
chains' tops above it and its own, so the order of keys is the lexicographic order of
sequences, where turns compare by hash. Chains are range partitioned by key, and
sums of partitions give each chain and each node its place in the preorder. All
nodes of a chain share the end of their subtree, the last place of the chains whose
keys hold the chain. With running sums of leaves and savings over places, kept in
equal ranges with an offset each, a subtree's leaves and savings are the
difference of the sums at its end and just before its top.

Defined results: turns are ordered by turn, null first, rows of one turn by the
SHA-256 of role and text; repeated rows all count. Rows without a conv_id belong to no
conversation and are left out. Null role or text is empty. A conversation of any
number of rows is spread over tasks. The list of a node's ends is hashed as a stream.
An empty table gives no rows, not even a root. Extra columns are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from revscope.llm._common import arrow_map, staged

#: A conversation's first turns come from the one whose id is the next multiple of FAMILY down; at most HEADS - 1 of them.
FAMILY, HEADS = 20, 4
#: Keys that more than this share of the rows ask for are joined by broadcast: there are at most as many of them.
HOT = 1000
#: Ranges of places that running sums are kept in.
RANGES = 2048
WORD = r"[^\x20\x09-\x0D]+"


def _ordered(conversations: DataFrame) -> DataFrame:
    """(piece, conv, at, sha, words): every turn, its piece (a range of rows) and its place in its conversation's part of that."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("sha"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"), F.monotonically_increasing_id().alias("row"),
    )
    dealt = rows.repartitionByRange(_parts(conversations), "conv", "turn", "sha", "row").withColumn("piece", F.spark_partition_id())
    return staged(dealt, "trie-turns")


def _parts(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _pieces(turns: DataFrame) -> DataFrame:
    """Per piece and conversation: how many turns stand before it, and h, the number of turns that come from the family's first conversation, with those turns."""
    conv = F.col("conv")
    order = Window.partitionBy("conv").orderBy("piece")
    counted = turns.groupBy("piece", "conv").count().withColumn("before", F.coalesce(F.sum("count").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    heads = turns.where((conv % FAMILY == 0) & (F.col("at") < HEADS)).groupBy("conv").agg(F.slice(F.sort_array(F.collect_list(F.struct("piece", "at", "sha", "words"))), 1, HEADS - 1).alias("heads"))
    h = (F.crc32(conv.cast("string")) % HEADS).cast("int")
    joined = counted.withColumn("family", conv - conv % FAMILY).join(heads.withColumnRenamed("conv", "family"), "family", "left")
    taken = F.when(F.col("heads").isNull() | (F.col("h") == 0), F.array().cast("array<struct<piece:int,at:int,sha:binary,words:bigint>>")).otherwise(F.slice("heads", 1, F.greatest(F.col("h"), F.lit(1))))
    return joined.withColumn("h", h).withColumn("heads", taken).select("piece", "conv", "before", "h", "heads")


def _paths(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every rebuilt turn as (conv, depth, a, b, pa, pb, sha, words), named by (a, b) with its parent's name; and every conversation's end."""
    turns = turns.withColumn("at", F.row_number().over(Window.partitionBy("piece", "conv").orderBy(F.asc_nulls_first("turn"), "sha")))
    pieces = staged(_pieces(turns), "trie-pieces")
    own = turns.join(pieces, ["piece", "conv"]).withColumn("rank", F.col("before") + F.col("at")).where(F.col("rank") > F.col("h"))
    own = own.select("piece", "conv", (F.size("heads") + F.col("rank") - F.col("h")).alias("depth"), "sha", "words")
    lent = pieces.where("before = 0").select("conv", F.posexplode("heads").alias("place", "head"))
    lent = lent.select(F.lit(-1).alias("piece"), "conv", (F.col("place") + 1).cast("long").alias("depth"), F.col("head.sha").alias("sha"), F.col("head.words").alias("words"))
    rows = own.unionByName(lent).withColumn("za", F.xxhash64(F.lit(1), "depth", "sha")).withColumn("zb", F.xxhash64(F.lit(2), "sha", "depth"))
    inside = Window.partitionBy("piece", "conv").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    named = staged(rows.withColumn("xa", F.bit_xor("za").over(inside)).withColumn("xb", F.bit_xor("zb").over(inside)), "trie-paths")
    earlier = Window.partitionBy("conv").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    totals = named.groupBy("piece", "conv").agg(F.bit_xor("za").alias("ta"), F.bit_xor("zb").alias("tb"))
    offsets = totals.select("piece", "conv", *(F.coalesce(F.bit_xor(t).over(earlier), F.lit(0)).alias(o) for t, o in (("ta", "oa"), ("tb", "ob"))))
    a, b = F.col("xa").bitwiseXOR(F.col("oa")), F.col("xb").bitwiseXOR(F.col("ob"))
    paths = named.join(offsets, ["piece", "conv"]).select("conv", "depth", a.alias("a"), b.alias("b"), a.bitwiseXOR(F.col("za")).alias("pa"), b.bitwiseXOR(F.col("zb")).alias("pb"), "sha", "words")
    everyone = pieces.where("before = 0").select("conv")
    ends = everyone.join(totals.groupBy("conv").agg(F.bit_xor("ta").alias("a"), F.bit_xor("tb").alias("b")), "conv", "left").select("conv", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))
    return paths, staged(ends, "trie-ends")


def _lookup(rows: DataFrame, keys: list[str], table: DataFrame, total: int) -> DataFrame:
    """``rows`` (``total`` at most) joined to ``table`` on ``keys``, which are unique there.

    Keys that over a thousandth of ``total`` ask for are at most a thousand, whatever the
    input: those are broadcast. No other key has more than that share in the shuffle.
    """
    hot = staged(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("asked")).where(F.col("asked") * HOT > total).select(*keys), "trie-hot")
    few = table.join(F.broadcast(hot), keys)
    rest = rows.join(F.broadcast(hot), keys, "left_anti").join(table, keys)
    return rows.join(F.broadcast(few), keys).unionByName(rest)


def _running(rows: DataFrame, part: str, order: str, sums: list[str]) -> DataFrame:
    """``rows`` with running sums up to and with each row: inside its part, and of all parts before, which are few."""
    inside = Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(part).agg(*(F.sum(s).alias(s) for s in sums))
    offsets = totals.select(part, *(F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"{s}_before") for s in sums))
    counted = rows.withColumns({f"{s}_sum": F.sum(s).over(inside) for s in sums})
    return counted.join(F.broadcast(offsets), part).withColumns({f"{s}_sum": F.col(f"{s}_sum") + F.col(f"{s}_before") for s in sums}).drop(*(f"{s}_before" for s in sums))


def _nodes(paths: DataFrame, ends: DataFrame) -> DataFrame:
    """All nodes with their parents' names and numbers of children; the root's name is of no turns."""
    same = [F.min(c) == F.max(c) for c in ("depth", "sha", "pa", "pb")]
    grouped = paths.groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("n_convs"), F.min("conv").alias("conv_id"), F.min("depth").alias("depth"), F.min("pa").alias("pa"), F.min("pb").alias("pb"), F.min("words").alias("words"), (same[0] & same[1] & same[2] & same[3]).alias("same"),
    )
    below = staged(grouped.withColumn("n_convs", F.when(F.col("same"), F.col("n_convs")).otherwise(F.raise_error(F.lit("two sequences of turns share a name")).cast("long"))).drop("same"), "trie-nodes")
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = ends.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv").alias("conv_id")).where("n_convs > 0").select(zero.alias("a"), zero.alias("b"), "n_convs", "conv_id", zero.alias("depth"), none.alias("pa"), none.alias("pb"), zero.alias("words"))
    children = below.groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count(F.lit(1)).alias("n_children"))
    return staged(below.unionByName(root).join(children, ["a", "b"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie-nodes")


def _with_parents(nodes: DataFrame, total: int) -> DataFrame:
    """Nodes with their parent's conv_id, and whether a chain begins at them: at the root, and below every node of more than one child."""
    parents = nodes.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("siblings"))
    below = _lookup(nodes.where("depth > 0"), ["pa", "pb"], parents, total).withColumn("top", F.col("siblings") > 1).drop("siblings")
    return staged(below.unionByName(nodes.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")).withColumn("top", F.lit(True))), "trie-linked")


def _tops(nodes: DataFrame) -> DataFrame:
    """(a, b, ta, tb): the top of each node's chain.

    A top points to itself, each other node to its parent; it takes over the pointer of
    what it points to until that is a top. Nodes that still ask stand equally far below what
    they ask for, in one run of only children: no node is asked for twice in a round, and
    the rounds are the logarithm of the longest run.
    """
    top = F.col("top")
    links = staged(nodes.select("a", "b", F.when(top, F.col("a")).otherwise(F.col("pa")).alias("ta"), F.when(top, F.col("b")).otherwise(F.col("pb")).alias("tb"), top.alias("arrived")), "trie-links")
    while not links.where("not arrived").isEmpty():
        known = links.select(F.col("a").alias("ta"), F.col("b").alias("tb"), F.col("ta").alias("na"), F.col("tb").alias("nb"), "arrived")
        moved = links.where("not arrived").drop("arrived").join(known, ["ta", "tb"]).select("a", "b", F.col("na").alias("ta"), F.col("nb").alias("tb"), "arrived")
        links = staged(links.where("arrived").unionByName(moved), "trie-links")
    return links.drop("arrived")


def _chains(nodes: DataFrame, total: int) -> DataFrame:
    """(ta, tb, key, length, first): chains by their tops; the key lists the tops from the root's chain down."""
    lengths = nodes.groupBy("ta", "tb").agg(F.count(F.lit(1)).alias("length"), F.min("depth").alias("first"))
    places = nodes.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("ta").alias("ua"), F.col("tb").alias("ub"))
    tops = nodes.where("top and depth > 0").select("ta", "tb", "pa", "pb")
    own = F.array(F.struct(F.col("ta").alias("a"), F.col("tb").alias("b"))).alias("key")
    above = _lookup(tops, ["pa", "pb"], places, total).select("ta", "tb", "ua", "ub", own)
    none = F.lit(None).cast("long")
    keys = staged(above.unionByName(nodes.where("depth = 0").select("ta", "tb", none.alias("ua"), none.alias("ub"), own)), "trie-keys")
    while not (asking := keys.where("ua is not null")).isEmpty():
        known = keys.select(F.col("ta").alias("ua"), F.col("tb").alias("ub"), F.col("key").alias("head"), F.col("ua").alias("va"), F.col("ub").alias("vb"))
        moved = _lookup(asking, ["ua", "ub"], known, total).select("ta", "tb", F.col("va").alias("ua"), F.col("vb").alias("ub"), F.concat("head", "key").alias("key"))
        keys = staged(keys.where("ua is null").unionByName(moved), "trie-keys")
    return keys.select("ta", "tb", "key").join(lengths, ["ta", "tb"])


def _intervals(chains: DataFrame) -> DataFrame:
    """(ta, tb, start, first, end): where a chain's top stands in the preorder, its depth, and the last place below it."""
    dealt = staged(chains.repartitionByRange(_parts(chains), "key").withColumn("piece", F.spark_partition_id()), "trie-chains")
    placed = staged(_running(dealt, "piece", "key", ["length"]).select("ta", "tb", "key", "first", (F.col("length_sum") - F.col("length")).alias("start"), (F.col("length_sum") - 1).alias("last")), "trie-placed")
    ends = placed.select(F.explode("key").alias("top"), "last").groupBy(F.col("top.a").alias("ta"), F.col("top.b").alias("tb")).agg(F.max("last").alias("end"))
    return staged(placed.drop("key", "last").join(ends, ["ta", "tb"]), "trie-intervals")


def _end_digests(ends: DataFrame) -> DataFrame:
    """(a, b, ends_sha256): the conversations that end at a node, joined in ranges and hashed range after range."""
    dealt = staged(ends.repartitionByRange(_parts(ends), "a", "b", "conv").withColumn("piece", F.spark_partition_id()), "trie-dealt")
    joined = dealt.groupBy("piece", "a", "b").agg(F.array_join(F.sort_array(F.collect_list("conv")).cast("array<string>"), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, hashlib.sha256()
        for batch in batches:
            out: list[tuple[int, int, str]] = []
            for _, a, b, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != (a, b):
                    if key is not None:
                        out.append((*key, digest.hexdigest()))
                    key, digest = (a, b), hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids.encode())
            yield _digest_rows(out)
        if key is not None:
            yield _digest_rows([(*key, digest.hexdigest())])

    return arrow_map(joined.repartition("a", "b").sortWithinPartitions("a", "b", "piece"), run, "a long, b long, ends_sha256 string")


def _digest_rows(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], names=["a", "b", "ends_sha256"])


def trie(conversations: DataFrame) -> DataFrame:
    """One row for each node, with its place in the preorder (``place``) and the last place of its subtree (``end``)."""
    paths, ends = _paths(_ordered(conversations))
    nodes = _nodes(paths, ends)
    total = nodes.count()
    linked = _with_parents(nodes, total)
    linked = staged(linked.join(_tops(linked), ["a", "b"]), "trie-linked")
    intervals = _intervals(_chains(linked, total))
    placed = _lookup(linked.drop("pa", "pb", "top"), ["ta", "tb"], intervals, total)
    placed = placed.withColumn("place", F.col("start") + F.col("depth") - F.col("first")).drop("start", "first")
    placed = placed.withColumn("part", F.floor(F.col("place") / max(1, -(-total // RANGES)))).withColumn("leaf", (F.col("n_children") == 0).cast("long")).withColumn("saved", (F.col("n_convs") - 1) * F.col("words"))
    summed = staged(_running(staged(placed, "trie-places"), "part", "place", ["leaf", "saved"]), "trie-sums")
    at_end = summed.select(F.col("place").alias("end"), F.col("leaf_sum").alias("leaf_end"), F.col("saved_sum").alias("saved_end"))
    whole = _lookup(summed, ["end"], at_end, total).join(_end_digests(ends), ["a", "b"], "left")
    return whole.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        (F.col("leaf_end") - F.col("leaf_sum") + F.col("leaf")).alias("n_leaves"), (F.col("saved_end") - F.col("saved_sum") + F.col("saved")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"), "place", "end",
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes of the trie of all conversations."""
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet")).drop("place", "end")


SQL = """
WITH ids AS (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT c, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
   lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END)))) % 4 AS h FROM ids),
t AS (SELECT conv_id AS c, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS turns
   FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
r AS (SELECT t.c, list_concat(CASE WHEN f.c IS NULL THEN [] ELSE f.turns[1:h.h] END, t.turns[h.h + 1:]) AS p FROM t JOIN h ON h.c = t.c LEFT JOIN t f ON f.c = t.c - t.c % 20),
n AS (SELECT c, d, p[1:d] AS node, len(p) = d AS ends FROM r, LATERAL (SELECT unnest(range(0, len(p) + 1)) AS d)),
g AS (SELECT node, d, min(c) AS conv_id, count(*) AS n_convs, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '') AS ids,
   CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * len(regexp_extract_all(node[d].text, '[^\x20\x09-\x0D]+')) END AS saved FROM n GROUP BY node, d),
k AS (SELECT node[1:d - 1] AS node, count(*) AS n FROM g WHERE d > 0 GROUP BY 1),
e AS (SELECT g.*, coalesce(k.n, 0) AS n_children FROM g LEFT JOIN k ON k.node = g.node),
s AS (SELECT DISTINCT a.node AS node, b.node AS below FROM n a JOIN n b ON a.c = b.c AND b.d >= a.d),
u AS (SELECT s.node, sum((e.n_children = 0)::INT)::BIGINT AS n_leaves, sum(e.saved)::BIGINT AS saved_tokens FROM s JOIN e ON e.node = s.below GROUP BY s.node)
SELECT e.conv_id, e.d::BIGINT AS depth, up.conv_id AS parent_conv_id, e.n_convs, e.n_children, u.n_leaves, u.saved_tokens, sha256(e.ids) AS ends_sha256
FROM e JOIN u ON u.node = e.node LEFT JOIN e up ON e.d > 0 AND up.node = e.node[1:e.d - 1]
"""

QUERIES = {"op12_prefix_trie": op12_prefix_trie}
ORACLES = {"op12_prefix_trie": SQL}
