"""Whitening of embeddings by a covariance that is summed tile by tile.

Components become whole numbers x = floor(1024 c) + 100000, so sums and deviations
are exact and the mean is known as a whole part and a rest. Vectors are centred
where they are read, cut into row-blocks, and each row-block into column blocks of
``TILE`` dimensions. The column blocks are shuffled by row-block; a task multiplies
all pairs of column blocks of a row-block, keyed by the tile (i, j) of the dimension
pairs that they cover, and adds up what it has of each tile; the tiles of all tasks
are shuffled by (i, j) and summed. What reaches the driver is the tiles' D x D sums,
bounded by the vectors' length whatever their number: they are assembled and
decomposed there. A last pass projects every vector.

Defined results: vectors that are null, empty, or hold a null or a component that is
not finite take no part, nor do those of another length than the most common one
(ties: the shorter), nor those with a component of 2^30 or more, whose deviations no
long can hold. A deviation beyond the range of a long is null. Rows with null or repeated ids are
rows like others; equal eigenvalues may turn their components in any way; a component
without variance (below 1e-12 of the trace) has whitened values of 0 and is left out
of the identity error; with fewer than eight dimensions there are as many components.
An empty table gives no rows. Extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revscope.llm._common import arrow_map, grouped, staged

SCALE, OFFSET = 1024, 100_000
COMPONENTS = 8
#: Dimensions of a tile, rows of a row-block, and bytes of tiles that a task holds before it gives them away.
TILE = 32
ROWS = 1024
HELD = 64 << 20
LARGEST = 2.0**30
NO_VARIANCE = 1e-12
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass(frozen=True)
class Whitening:
    """What was learnt: the number of vectors, sums per dimension, the covariance's trace, its largest eigenvalues and their unit eigenvectors (columns)."""

    n: int
    sums: list[int]
    trace: float
    eigenvalues: np.ndarray
    components: np.ndarray

    @property
    def scales(self) -> np.ndarray:
        """1 / sqrt(e), or 0 where there is no variance."""
        varied = self.eigenvalues > NO_VARIANCE * self.trace
        return np.where(varied, 1 / np.sqrt(np.where(varied, self.eigenvalues, 1.0)), 0.0)


def prepared(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v) of the vectors that take part, but for their length."""
    x = F.col(vector_col)
    fit = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < LARGEST))
    return vectors.where(x.isNotNull() & (F.size(x) > 0) & F.coalesce(fit, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), x.cast("array<double>").alias("v"))


def _whole(column: pa.Array, dimensions: int) -> np.ndarray:
    return np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False)).astype(np.int64).reshape(-1, dimensions) + OFFSET


def _sums(fit: DataFrame) -> tuple[int, list[int]]:
    """The most common length's number of vectors and sums per dimension, exact; tasks add up before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            sizes = np.diff(batch.column(1).offsets.to_numpy())
            for size in np.unique(sizes).tolist():
                rows = batch.filter(pa.array(sizes == size)) if (sizes != size).any() else batch
                n, total = held.get(size, (0, np.zeros(size, object)))
                held[size] = n + rows.num_rows, total + _whole(rows.column(1), size).sum(axis=0).astype(object)
        for size, (n, total) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([size] * size, pa.int32()), pa.array(range(size), pa.int32()), pa.array([n] * size, pa.int64()), pa.array([Decimal(int(t)) for t in total], pa.decimal128(38, 0))], names=["size", "dimension", "n", "total"])

    parts = staged(arrow_map(fit, run, "size int, dimension int, n long, total decimal(38,0)").groupBy("size", "dimension").agg(F.sum("n").alias("n"), F.sum("total").cast("decimal(38,0)").alias("total")), "whitening-sums")
    common = parts.where("dimension = 0").orderBy(F.desc("n"), "size").first()
    if common is None:
        return 0, []
    rows = parts.where(F.col("size") == common["size"]).orderBy("dimension").collect()
    return common["n"], [int(r["total"]) for r in rows]


def _centred(whole: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S/n: the mean's whole part is taken off before anything is rounded."""
    parts = [divmod(s, n) for s in sums]
    return (whole - np.array([q for q, _ in parts], np.int64)).astype(np.float64) - np.array([r / n for _, r in parts])


def _column_blocks(fit: DataFrame, n: int, sums: list[int]) -> DataFrame:
    """The centred vectors as (row_block, column_block, data)."""
    dimensions = len(sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                x = _centred(_whole(batch.column(1).slice(at, ROWS), dimensions), n, sums)
                columns = [np.ascontiguousarray(x[:, d : d + TILE]).tobytes() for d in range(0, dimensions, TILE)]
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(columns), pa.int64()), pa.array(range(len(columns)), pa.int32()), pa.array(columns, pa.binary())], names=["row_block", "column_block", "data"])
                block += 1

    return arrow_map(fit, run, "row_block long, column_block int, data binary")


def covariance(fit: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """The covariance of x, divisor n, by tiles."""
    dimensions = len(sums)
    widths = [min(TILE, dimensions - d) for d in range(0, dimensions, TILE)]
    names, schema = ["i", "j", "data"], "i int, j int, data binary"

    def rows(tiles: dict[tuple[int, int], np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([i for i, _ in tiles], pa.int32()), pa.array([j for _, j in tiles], pa.int32()), pa.array([t.tobytes() for t in tiles.values()], pa.binary())], names=names)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles: dict[tuple[int, int], np.ndarray] = {}
        for block in grouped(batches, ["row_block"]):
            own = {c: np.frombuffer(d, np.float64).reshape(-1, widths[c]) for c, d in zip(block["column_block"].to_pylist(), block["data"].to_pylist(), strict=True)}
            for i, x in own.items():
                for j, y in own.items():
                    if i <= j:
                        product = x.T @ y
                        tiles[i, j] = tiles[i, j] + product if (i, j) in tiles else product
            if len(tiles) * TILE * TILE * 8 > HELD:
                yield rows(tiles)
                tiles = {}
        if tiles:
            yield rows(tiles)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None
        for batch in batches:
            for i, j, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tile = np.frombuffer(data, np.float64)
                if key == (i, j):
                    total = total + tile
                else:
                    if key is not None:
                        yield rows({key: total})
                    key, total = (i, j), tile
        if key is not None:
            yield rows({key: total})

    blocks = _column_blocks(fit, n, sums).repartition("row_block").sortWithinPartitions("row_block")
    parts = arrow_map(blocks, multiply, schema).repartition("i", "j").sortWithinPartitions("i", "j")
    out = np.zeros((dimensions, dimensions))
    for i, j, data in arrow_map(parts, add, schema).collect():
        tile = np.frombuffer(data, np.float64).reshape(widths[i], widths[j]) / n
        out[i * TILE : i * TILE + widths[i], j * TILE : j * TILE + widths[j]] = tile
        out[j * TILE : j * TILE + widths[j], i * TILE : i * TILE + widths[i]] = tile.T
    return out


def fit(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> Whitening:
    """Learn from all vectors that take part."""
    rows = prepared(vectors, id_col, vector_col)
    n, sums = _sums(rows)
    if not n:
        return Whitening(0, [], 0.0, np.zeros(0), np.zeros((0, 0)))
    v = covariance(rows.where(F.size("v") == len(sums)), n, sums)
    values, vectors_ = np.linalg.eigh(v)
    largest = np.argsort(-values, kind="stable")[:components]
    return Whitening(n, sums, float(np.trace(v)), values[largest], vectors_[:, largest])


def transform(vectors: DataFrame, model: Whitening, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, deviation, whitened array<double>) of every vector that takes part."""
    n, dimensions = model.n, len(model.sums)
    whole_mean = np.array([s // n for s in model.sums], np.int64) if n else np.zeros(0, np.int64)
    rest = np.array([s % n for s in model.sums], np.int64) if n else whole_mean

    def deviations(x: np.ndarray) -> list[int | None]:
        away = x - whole_mean
        if (int(np.abs(away).max(initial=0)) + 1) ** 2 * n * n * dimensions < 1 << 63:
            return ((n * away - rest) ** 2).sum(axis=1).tolist()
        exact = ((n * away.astype(object) - rest) ** 2).sum(axis=1)
        return [d if d < 1 << 63 else None for d in exact.tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _whole(batch.column(1), dimensions)
            y = _centred(x, n, model.sums) @ model.components * model.scales
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(deviations(x), pa.int64()), pa.array(list(y), pa.list_(pa.float64()))], names=["vec_id", "deviation", "whitened"])

    return arrow_map(prepared(vectors, id_col, vector_col).where(F.size("v") == dimensions), run, "vec_id long, deviation long, whitened array<double>")


def identity_error(whitened: DataFrame, varied: list[int]) -> float:
    """The largest entry by which the covariance of the whitened values, centred first, differs from the identity."""
    if not varied:
        return 0.0
    means = whitened.agg(*(F.avg(F.col("whitened")[c]).alias(f"m{c}") for c in varied)).first()
    away = {c: F.col("whitened")[c] - means[f"m{c}"] for c in varied}
    found = whitened.agg(*(F.abs(F.avg(away[a] * away[b]) - float(a == b)).alias(f"e{a}_{b}") for a in varied for b in varied if a <= b)).first()
    return max(found)


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row for each vector that takes part and each component."""
    model = fit(vectors, components, id_col, vector_col)
    if not model.n:
        return vectors.sparkSession.createDataFrame([], RESULT)
    rows = staged(transform(vectors, model, id_col, vector_col), "whitened")
    error = identity_error(rows, np.flatnonzero(model.scales).tolist())
    explained = F.array(*(F.lit(float(e / model.trace) if model.trace else 0.0) for e in model.eigenvalues))
    long = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("component", "value"))
    return long.select(
        "vec_id", (F.col("component") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
        F.col("value").alias("whitened"), explained[F.col("component")].alias("explained"), F.lit(error).alias("identity_error"),
    )


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings whitened."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op13_whitening": op13_whitening}
ORACLES: dict[str, str] = {}
