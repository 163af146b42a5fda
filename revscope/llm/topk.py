"""Exact top-k by inner product with the threshold algorithm over sorted per-dimension lists.

Vectors are ordered by their leading component, so that like ones are neighbours,
and stay where they are stored. Queries are a stated set held against all rows in
batches of a bounded size, which are broadcast; each task reads its vectors in
blocks. A block keeps one list per dimension, sorted by that component. Reading
the lists from the ends that a query's components favour, every vector met is
scored whole, and the sum of the products at the places reached bounds the score
of all vectors not met yet. Reading stops at the first place where that bound is
below the query's k-th score so far; a block whose first places already bound it
below that is passed over unread. Where the places before the stop are so many that
their vectors are most of the block, the block is scored in one product.

A first pass over one block of sampled vectors gives each query a k-th score to
beat, and tasks raise it as they go. Only what reaches it is shuffled: at most k
rows of a query for each task, whatever the number of vectors.

Defined results: vectors that are null, or hold a null or a component that is not
finite, take no part; vectors of another length than the table's most common
one's take no part either; ties go to the smaller vec_id; repeated ids count as
candidates each, but never for a query of the same id, and are asked once for each
row; rows without an id take no part; with fewer than k candidates all are
returned; scores from 2^53 on are rounded as doubles are, and cut to the range of a
long. Extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from revscope.llm._common import arrow_map, share, staged

K = 20
SCALE = 64
#: Rows of a block of vectors, and queries scored against it at a time.
BLOCK = 4096
QUERIES_AT_ONCE = 1024
#: Bytes of the components of a batch of queries: the bound of what is broadcast.
BATCH_BYTES = 32 << 20
FOUND = "query int, vec_id long, score double"


def prepared(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): components floor(64 x) as doubles, unfit vectors left out."""
    x = F.col(vector_col)
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) == float("inf")))
    fit = vectors.where(F.col(id_col).isNotNull() & x.isNotNull() & (F.size(x) > 0) & ~F.coalesce(bad, F.lit(True)))
    return fit.select(F.col(id_col).cast("long").alias("vec_id"), x.cast("array<double>").alias("v"))


def _matrix(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.floor(SCALE * np.array(flat.flatten().to_numpy(zero_copy_only=False))).reshape(rows, -1)


class Lists:
    """A block's vectors and their sorted lists."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[by_id], rows[by_id]
        self.order = np.argsort(self.rows, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.rows, self.order, axis=0)
        self.depths = [0, *(1 << k for k in range(len(ids).bit_length()) if 1 << k < len(ids))]
        #: Pairs of a query and a vector, and those of them that were scored.
        self.pairs, self.scored = 0, 0

    def stops(self, queries: np.ndarray, floors: np.ndarray) -> np.ndarray:
        """Per query the places of each list that must be read before the bound is below its floor."""
        n = len(self.ids)
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        out = np.full(len(queries), n)
        for depth in reversed(self.depths):
            bound = up @ self.sorted[n - 1 - depth] + down @ self.sorted[depth]
            # sums of products may be rounded: a bound must not be too small
            out[bound + np.abs(bound) * 1e-9 < floors] = depth
        return out

    def met(self, query: np.ndarray, depth: int) -> np.ndarray:
        """The vectors that stand in the first places of the lists."""
        up, down = query > 0, query < 0
        return np.unique(np.concatenate([self.order[len(self.ids) - depth :, up].ravel(), self.order[:depth, down].ravel()]))

    def best(self, query_ids: np.ndarray, queries: np.ndarray, k: int, floors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score) of the k best vectors of each query, of those that reach its floor."""
        n = len(self.ids)
        stop = self.stops(queries, floors)
        whole = np.flatnonzero(stop * queries.shape[1] >= n / 2)
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        self.pairs += n * len(queries)
        self.scored += n * len(whole)
        for at in range(0, len(whole), QUERIES_AT_ONCE):
            part = whole[at : at + QUERIES_AT_ONCE]
            scores = queries[part] @ self.rows.T
            least = floors[part]
            if n > k:
                least = np.maximum(least, np.partition(scores, n - k - 1, axis=1)[:, n - k - 1])
            q, v = np.nonzero(scores >= least[:, None])
            q, v, score = part[q], v, scores[q, v]
            own = query_ids[q] != self.ids[v]
            out.append(top_of(q[own], self.ids[v[own]], score[own], k))
        for i in np.flatnonzero((stop > 0) & (stop * queries.shape[1] < n / 2)).tolist():
            v = self.met(queries[i], int(stop[i]))
            self.scored += len(v)
            score = self.rows[v] @ queries[i]
            keep = (score >= floors[i]) & (self.ids[v] != query_ids[i])
            out.append(top_of(np.full(int(keep.sum()), i), self.ids[v[keep]], score[keep], k))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def top_of(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query, ties to the smaller id; sorted."""
    order = np.lexsort((ids, -scores, query))
    query, ids, scores = query[order], ids[order], scores[order]
    heads = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])) if len(query) else np.zeros(0, np.int64)
    nth = np.arange(len(query)) - np.repeat(heads, np.diff(np.append(heads, len(query))))
    return query[nth < k], ids[nth < k], scores[nth < k]


def _blocks(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[Lists]:
    held: list[pa.RecordBatch] = []
    rows = 0

    def lists() -> Lists:
        table = pa.Table.from_batches(held)
        return Lists(table.column("vec_id").to_numpy(), _matrix(table.column("v"), table.num_rows))

    for batch in batches:
        for at in range(0, batch.num_rows, block):
            piece = batch.slice(at, block)
            if rows + piece.num_rows > block and held:
                yield lists()
                held, rows = [], 0
            held, rows = [*held, piece], rows + piece.num_rows
    if rows:
        yield lists()


def _search(vectors: DataFrame, query_ids: np.ndarray, queries: np.ndarray, floors: np.ndarray, k: int, block: int) -> DataFrame:
    """The best k of each query in each task; ``query`` is the place of the query in its batch."""
    shared = vectors.sparkSession.sparkContext.broadcast((query_ids, queries, floors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, values, least = shared.value
        least = least.copy()
        found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        for lists in _blocks(batches, block):
            new = lists.best(asked, values, k, least)
            found = top_of(*(np.concatenate(x) for x in zip(found, new, strict=True)), k)
            heads = np.flatnonzero(np.concatenate([[True], found[0][1:] != found[0][:-1]])) if len(found[0]) else np.zeros(0, np.int64)
            ends = np.append(heads[1:], len(found[0])) if len(heads) else heads
            full = ends - heads == k
            least[found[0][heads[full]]] = np.maximum(least[found[0][heads[full]]], found[2][ends[full] - 1])
        for at in range(0, len(found[0]), 1 << 16):
            q, v, score = (x[at : at + (1 << 16)] for x in found)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(v), pa.array(score)], names=["query", "vec_id", "score"])

    return arrow_map(vectors, run, FOUND)


def top_k(vectors: DataFrame, queries: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """For every row that ``queries`` selects (a condition on ``vec_id``): query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    rows = prepared(vectors, id_col, vector_col)
    width = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    width = width.n if width else 1
    largest = F.array_max(F.transform("v", lambda e: F.abs(e)))
    lead = F.array_position(F.transform("v", lambda e: F.abs(e)), largest)
    signed = F.when(F.element_at("v", lead.cast("int")) < 0, -lead).otherwise(lead)
    rows = staged(rows.where(F.size("v") == width).withColumn("lead", signed).repartitionByRange("lead", "vec_id").sortWithinPartitions("lead", "vec_id").drop("lead"), "vectors")
    n_rows, n_asked = rows.count(), rows.where(queries).count()
    n_batches = max(1, -(-n_asked * width * 8 // batch_bytes))
    asked = staged(rows.where(queries).withColumn("batch", F.pmod(F.xxhash64("vec_id", "v"), F.lit(n_batches)).cast("int")), "queries")
    # about a block of rows, drawn where they stand and then read by one task for every batch
    some = staged(rows.where(share(F.struct("vec_id", "v"), 9) < block / max(1, n_rows)), "sampled-vectors").coalesce(1)
    found = []
    for b in range(n_batches):
        table = asked.where(F.col("batch") == b).select("vec_id", "v").toArrow()
        if not table.num_rows:
            continue
        ids, values = table.column("vec_id").to_numpy(), _matrix(table.column("v"), table.num_rows)
        floors = np.full(len(ids), -np.inf)
        if n_rows > block:
            first = _search(some, ids, values, floors, k, block).groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("floor")).where(F.col("n") >= k).toPandas()
            floors[first["query"].to_numpy()] = first["floor"].to_numpy()
        names = spark.createDataFrame(pa.table({"query": pa.array(np.arange(len(ids)), pa.int32()), "query_id": ids}))
        order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
        ranked = _search(rows, ids, values, floors, k, block).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        limit = 2.0**63
        score = F.when(F.col("score") >= limit, F.lit(2**63 - 1)).when(F.col("score") < -limit, F.lit(-(2**63))).otherwise(F.col("score").cast("long"))
        found.append(staged(ranked.join(names, "query").select("query_id", "rank", "vec_id", score.alias("score")), "found"))
    out = found[0] if found else spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best candidates of every vector whose id is divisible by 20."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


ORACLE = """
WITH fit AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM fit q JOIN fit c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""

QUERIES = {"op3_top_k": op3_top_k}
ORACLES = {"op3_top_k": ORACLE}
