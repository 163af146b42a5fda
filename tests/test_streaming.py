"""Events of live telemetry against the same events of whole logs, and state that ends with its log."""

import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from revscope.operators import events as E
from revscope.operators import features as X
from revscope.operators import folds
from revscope.sources.telemetry import telemetry
from revscope.streaming import events as V
from revscope.streaming import replay

SF = "/root/testdata/sf0.001"
FIELDS = ["log_id", "row_idx", "dtps", "tps_from", "tps_to", "min_o2", "lean"]


@pytest.fixture(scope="module")
def log(spark):
    """Two logs, and one row an hour later that lets all timers run out."""
    t = telemetry(spark, SF).select("log_id", "row_idx", "time_s", "tps", "o2_b1", "rpm", "vss")
    second = t.where("row_idx < 700").withColumn("log_id", F.lit(5).cast("long"))
    return t.unionByName(second).cache()


def files(df, path, parts):
    """The rows as a folder of files, one for each stretch of rows, written in order."""
    rows = df.toPandas().sort_values("row_idx")
    size = -(-len(rows["row_idx"].unique()) // parts)
    for k, (_, part) in enumerate(rows.groupby(rows["row_idx"] // size)):
        part.to_parquet(f"{path}/part-{k:03}.parquet")
    late = rows.iloc[:1].assign(log_id=99, row_idx=0, time_s=3600.0)
    late.to_parquet(f"{path}/part-998.parquet")
    late.assign(time_s=3601.0, row_idx=1).to_parquet(f"{path}/part-999.parquet")


def run(df, name, tmp_path):
    query = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"checkpoint-{name}")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert query.exception() is None
    return query


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    held = spark.conf.get(key, None)
    V.use_rocksdb(spark)
    yield
    spark.conf.set(key, held) if held else spark.conf.unset(key)


def test_stabs_equal_those_of_whole_logs(spark, log, tmp_path, rocksdb):
    pytest.importorskip("google.protobuf")
    source = tmp_path / "rows"
    source.mkdir()
    files(log, source, 9)
    stream = replay.replay(spark, str(source), "log_id long, row_idx long, time_s double, tps double, o2_b1 double, rpm double, vss double")
    query = run(V.tip_in_stream(stream), "stabs", tmp_path)
    got = sorted(map(tuple, spark.table("stabs").select(*FIELDS).collect()))
    whole = X.with_features(log.withColumns({"map": F.lit(None).cast("double"), "ect": F.lit(None).cast("double")}))
    wanted = sorted(map(tuple, E.tip_ins(whole).select(*FIELDS).collect()))
    assert got == wanted and len(got) > 5
    # the two logs have ended; what is left in the store is the row that came last
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 8


def test_finder_by_any_cut():
    rng = random.Random(2)
    for _ in range(80):
        rows = [(i, None if rng.random() < 0.05 else rng.choice([5.0, 8.0, 20.0, 30.0, 45.0]), None if rng.random() < 0.1 else rng.uniform(100, 800)) for i in range(rng.randint(1, 120))]
        whole = V.StabFinder([], 0, None).add(rows, ended=True)
        finder, found, at = V.StabFinder([], 0, None), [], 0
        while at < len(rows):
            n = rng.randint(1, 9)
            found += finder.add(rows[at : at + n])
            finder = V.StabFinder(finder.rows, finder.judged, finder.last)
            assert len(finder.rows) <= V.WATCHED + 1
            at += n
        assert found + finder.add([], ended=True) == whole
        starts = [r for r, *_ in whole]
        assert all(folds.spaced(pd.Series(starts).to_numpy(), V.GAP)) if starts else True


def test_kickdowns_by_interval_join(spark, log, tmp_path):
    f = X.with_features(log.withColumns({"map": F.lit(None).cast("double"), "ect": F.lit(None).cast("double")}))
    s = E.shifts(E.gears(f)).cache()
    stabs = f.where((F.col("tps") - F.col("prev_tps") >= 20) & (F.col("tps") >= 40)).select("log_id", "row_idx", "time_s")
    down = s.select("log_id", F.col("row_idx").alias("down_row"), "from_gear", "to_gear", (F.col("row_idx") * 0.145).alias("time_s"))
    for name, df, column in (("a", stabs, "row_idx"), ("b", down, "down_row")):
        (tmp_path / name).mkdir()
        files(df.withColumnRenamed(column, "row_idx"), tmp_path / name, 4)
    read = lambda name, schema: replay.replay(spark, str(tmp_path / name), schema)
    a = read("a", "log_id long, row_idx long, time_s double")
    b = read("b", "log_id long, row_idx long, from_gear int, to_gear int, time_s double").withColumnRenamed("row_idx", "down_row")
    run(V.kickdown_stream(a, b), "kicks", tmp_path)
    first = spark.table("kicks").where("log_id <> 99").groupBy("log_id", "row_idx").agg(F.min("down_row").alias("down_row"))
    got = sorted(map(tuple, first.collect()), key=str)
    wanted = sorted(map(tuple, E.kickdowns(f, s).select("log_id", "row_idx", "down_row").collect()), key=str)
    assert got == wanted and any(d is None for *_, d in got) + any(d is not None for *_, d in got) >= 1


def test_gear_stream_forgets_logs_that_ended(spark, log, tmp_path):
    source = tmp_path / "gears"
    source.mkdir()
    files(log, source, 5)
    stream = replay.replay(spark, str(source), "log_id long, row_idx long, time_s double, tps double, o2_b1 double, rpm double, vss double")
    query = run(replay.gear_stream(stream, silence_s=30.0), "gears", tmp_path)
    g = E.gears(X.with_mph(X.with_features(log.withColumns({"map": F.lit(None).cast("double"), "ect": F.lit(None).cast("double")}))).withColumns({"to_mph": F.lit(1.0), "mph": F.col("vss")}))
    got = sorted(map(tuple, spark.table("gears").where("log_id <> 99").select("log_id", "row_idx", "gear").collect()))
    assert got == sorted(map(tuple, g.select("log_id", "row_idx", "gear").collect()))
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 1, json.dumps(query.lastProgress["stateOperators"])
