"""Telemetry as a stream: gears confirmed with state for each log, knock runs as session windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from revscope.cluster import ship_package
from revscope.functions import scalars as S
from revscope.operators import folds

START = "2000-01-01 00:00:00"


def replay(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """Log rows from a folder of Parquet files, oldest first, with an event time made of the log's seconds."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return rows.withColumn("at", F.timestamp_seconds(F.unix_timestamp(F.lit(START)) + F.col("time_s")))


def knock_sessions(stream: DataFrame, gap: str = "1 seconds", late: str = "10 seconds") -> DataFrame:
    """Runs of knock, closed by a second without any; rows later than the watermark are dropped."""
    hits = stream.where("kr > 0.5").withWatermark("at", late)
    runs = hits.groupBy("log_id", F.session_window("at", gap).alias("w")).agg(F.count("*").alias("samples"), F.max("kr").alias("peak"))
    return runs.select("log_id", F.col("w.start").alias("start"), "samples", "peak")


def load_windows(stream: DataFrame, length: str = "10 seconds", step: str = "5 seconds", late: str = "10 seconds") -> DataFrame:
    """Mean load and speed over sliding windows."""
    means = stream.withWatermark("at", late).groupBy("log_id", F.window("at", length, step).alias("w")).agg(F.count("*").alias("samples"), F.avg("map").alias("map"), F.avg("rpm").alias("rpm"))
    return means.select("log_id", F.col("w.start").alias("start"), "samples", "map", "rpm")


def gear_stream(stream: DataFrame, to_mph: float = 1.0, late: str = "10 seconds", silence_s: float = 60.0) -> DataFrame:
    """The confirmed gear of each row; the state of each log's automaton outlives the micro-batch, and ends when the log has been silent for ``silence_s`` of event time."""
    ship_package(stream.sparkSession)
    mph = F.col("vss") * to_mph
    ratio = S.gear_ratio(F.col("rpm"), mph, F.col("vss"))
    rows = stream.withWatermark("at", late).select("log_id", "row_idx", "at", F.coalesce(S.nearest_gear(ratio), F.lit(0)).alias("near"), ratio.isNotNull().alias("valid"))

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        machine = state.get if state.exists else folds.GEAR_START
        log = pd.concat(list(frames)).sort_values("row_idx")
        valid, near = log["valid"].to_numpy(), log["near"].to_numpy()
        gears = folds.debounced_gears(valid, near, machine)
        for begin, end, gear in zip(*folds.gear_runs(valid, near), strict=True):
            machine = folds.gear_step(machine, gear, end - begin)[0]
        state.update(tuple(map(int, machine)))
        end = int(log["at"].max().timestamp() * 1000) + int(silence_s * 1000)
        state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"log_id": key[0], "row_idx": log["row_idx"], "gear": gears})

    return rows.groupBy("log_id").applyInPandasWithState(step, "log_id long, row_idx long, gear int", "current int, pending int, seen int", "append", GroupStateTimeout.EventTimeTimeout)
