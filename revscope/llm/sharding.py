"""Sharding by sampled splitters: near-equal bytes per shard over one global key order.

Records are ordered by (hash of the text, doc_id), so copies of a text are
neighbours. A size-weighted sample of keys gives quantile boundaries of many
small ranges; ranges that turn out overfull are sampled again and subdivided, and
since doc_id is part of the key even one text that fills a third of the table is
split. Exact byte totals of the ranges then place every record: a record belongs
to the shard in which the middle of its bytes falls.

The sample is sorted and thinned to boundaries in tasks. Only ranges, never keys of
all rows or of the sample, reach the driver: their number is about
``n_rows / rows_per_range`` plus the subdivisions.

Defined results: a null text has size 1 and the checksum of nothing; null ids
come first among equal texts; repeated rows count each; an empty table gives no
rows; rows of one text and one doc_id cannot be told apart and stay in one range.
Extra columns are dropped by ``shard_plan`` and kept by ``write_shards``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from revscope.llm._common import arrow_map, documents, keyed, share, staged

#: Sampled keys for each range.
OVERSAMPLE = 24
#: A range is overfull beyond so many times its fair size.
OVERFULL = 3.0
LOWEST = -(2**63)


def splitters(keys: DataFrame, n: int, seed: int = 21) -> np.ndarray:
    """About n - 1 boundaries (h, d), as the array's fields, that cut rows (h, d, size) into ranges of near-equal size.

    The size-weighted sample is sorted by Spark and thinned inside its tasks; only the boundaries reach the driver.
    """
    if n < 2:
        return np.zeros(0, dtype=[("h", "i8"), ("d", "i8")])
    total = keys.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    weight = F.col("size") * F.lit(OVERSAMPLE * n / max(total, 1))
    drawn = keys.where(share(F.struct("h", "d", "size"), seed) < weight).select("h", "d", F.greatest(weight, F.lit(1.0)).alias("w"))

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0.0
        for batch in batches:
            ends = done + np.cumsum(batch.column(2).to_numpy())
            steps = np.floor(np.concatenate([[done], ends]) / OVERSAMPLE)
            yield batch.filter(pa.array(steps[1:] > steps[:-1])).select(["h", "d"])
            done = float(ends[-1]) if len(ends) else done

    found = arrow_map(drawn.repartitionByRange("h", "d").sortWithinPartitions("h", "d"), thin, "h long, d long").toPandas()
    points = np.array(list(zip(found["h"], found["d"], strict=True)), dtype=[("h", "i8"), ("d", "i8")])
    return np.unique(points)


def range_of(boundaries: np.ndarray, h: np.ndarray, d: np.ndarray) -> np.ndarray:
    """How many boundaries are at most the key (h, d)."""
    lo = np.searchsorted(boundaries["h"], h, "left")
    hi = np.searchsorted(boundaries["h"], h, "right")
    out = lo.copy()
    for i in np.flatnonzero(hi > lo):
        out[i] = lo[i] + np.searchsorted(boundaries["d"][lo[i] : hi[i]], d[i], "right")
    return out


def _ranged(keys: DataFrame, boundaries: np.ndarray) -> DataFrame:
    shared = keys.sparkSession.sparkContext.broadcast(boundaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, d = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("h", "doc_order"))
            part = pa.array(range_of(shared.value, h, d), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, part], names=[*batch.schema.names, "part"])

    return arrow_map(keys, run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keys.schema) + ", part long")


def shard_plan(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text", rows_per_range: int = 100_000, min_ranges: int = 256) -> DataFrame:
    """One row per record: doc_id, size, text_crc32, shard and slot (its place in the shard, gapless from 0)."""
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    text = F.coalesce("text", F.lit(""))
    keys = keyed(docs, id_col, text_col).select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h"), F.coalesce("doc_id", F.lit(LOWEST)).alias("doc_order")
    )
    keys = staged(keys, "shard-keys")
    total, rows = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    n_ranges = max(min_ranges, -(-rows // rows_per_range))
    by_key = ["h", F.col("doc_order").alias("d"), "size"]
    boundaries = splitters(keys.select(by_key), n_ranges, 11)
    ranged = _ranged(keys, boundaries)
    fair = total / n_ranges
    full = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).where((F.col("bytes") > OVERFULL * fair) & (F.col("n") > 1))
    too_many = full.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    if too_many:
        # sample the overfull ranges again and cut them into parts of half a fair size
        wide = ranged.join(full.select("part"), "part", "left_semi").select(by_key)
        boundaries = np.unique(np.concatenate([boundaries, splitters(wide, int(np.ceil(2 * too_many / fair)), 12)]))
        ranged = _ranged(keys, boundaries)
    sums = ranged.groupBy("part").agg(F.sum("size").alias("bytes")).toPandas().sort_values("part")
    before = dict(zip(sums["part"].tolist(), (sums["bytes"].cumsum() - sums["bytes"]).tolist(), strict=True))
    spark = docs.sparkSession
    starts = spark.createDataFrame(list(before.items()) or [(0, 0)], "part long, bytes_before long")
    order = Window.partitionBy("part").orderBy("h", F.col("doc_id").asc_nulls_first(), "size", "text_crc32")
    placed = (
        ranged.join(starts, "part")
        .withColumn("middle", F.col("bytes_before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size") / 2)
        .withColumn("nth", F.row_number().over(order))
        .withColumn("shard", F.least(F.floor(F.col("middle") * n_shards / F.lit(float(max(total, 1)))), F.lit(n_shards - 1)).cast("int"))
        .select("doc_id", "size", "text_crc32", "shard", "part", "nth")
    )
    placed = staged(placed, "shard-places")
    # a range that straddles a boundary holds rows of two shards: the slot counts from the first row of each
    heads = placed.groupBy("shard", "part").agg(F.min("nth").alias("first"), F.count("*").alias("n")).toPandas().sort_values(["shard", "part"])
    heads["slots_before"] = heads.groupby("shard")["n"].cumsum() - heads["n"]
    offsets = spark.createDataFrame([tuple(map(int, r)) for r in heads[["shard", "part", "first", "slots_before"]].itertuples(index=False)] or [(0, 0, 1, 0)], "shard int, part long, first int, slots_before long")
    slot = F.col("slots_before") + F.col("nth") - F.col("first")
    return placed.join(offsets, ["shard", "part"]).select("doc_id", "size", "text_crc32", "shard", slot.cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write whole records, all their columns, one folder per shard. Ids must be unique and not null."""
    plan = shard_plan(docs, n_shards, id_col, text_col).select(F.col("doc_id").alias("_shard_doc"), F.col("shard").alias("_shard"))
    docs.join(plan, F.col(id_col) == F.col("_shard_doc")).drop("_shard_doc").write.partitionBy("_shard").parquet(path)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near-equal bytes."""
    plan = shard_plan(documents(spark, sf_dir), 16)
    return plan.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op1_sharding": op1_sharding}
ORACLES: dict[str, str] = {}
