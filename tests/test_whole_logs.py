"""Folds over batches of whole logs, and how many windows a session's rows go through."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from revscope.operators import events as E
from revscope.operators import folds
from revscope.operators import session as Z

#: Logs of no, one and many batches of seven rows, some that end where a batch ends; one without an id.
SIZES = {None: 9, 0: 7, 1: 7, 2: 1, 3: 40, 4: 14, 5: 3, 6: 21, 7: 2}


def sized(spark):
    return spark.createDataFrame([(log, i * (3 + (log or 0) % 4)) for log, n in SIZES.items() for i in range(n)], "log_id long, row_idx long").repartition(5)


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_call_of_a_fold_takes_many_logs(spark):
    rows = spark.range(3000).select((F.col("id") % 600).alias("log_id"), (F.col("id") / 600).cast("long").alias("row_idx"))
    calls = folds.per_log(rows, lambda logs: pd.DataFrame({"logs": [logs["log_id"].nunique()], "n": [len(logs)]}), "logs long, n long").collect()
    assert sum(c.logs for c in calls) == 600 and sum(c.n for c in calls) == 3000
    assert len(calls) <= 2 * spark.sparkContext.defaultParallelism


def test_logs_stay_whole_and_apart_in_any_batches(spark, small_batches):
    def told(logs):
        spans = list(folds.log_spans(logs))
        assert all(logs["row_idx"].iloc[b:e].is_monotonic_increasing for b, e in spans)
        return pd.DataFrame({"log_id": [logs["log_id"].iat[b] for b, _ in spans], "n": [e - b for b, e in spans]})

    assert {r.log_id: r.n for r in folds.per_log(sized(spark), told, "log_id long, n long").collect()} == SIZES
    kept = folds.keep_spaced(sized(spark), 10).groupBy("log_id").agg(F.array_sort(F.collect_list("row_idx")).alias("at")).collect()
    for log_id, n in SIZES.items():
        at = pd.Series([i * (3 + (log_id or 0) % 4) for i in range(n)]).to_numpy()
        assert [r.at for r in kept if r.log_id == log_id] == [at[folds.spaced(at, 10)].tolist()]


def test_whole_logs_holds_no_more_than_a_log_and_a_batch():
    one = lambda log, n=4: pd.DataFrame({"log_id": [log] * n, "row_idx": range(n)})
    got = list(folds.whole_logs(iter([one(0), one(1), one(1), one(1).head(0), pd.concat([one(1), one(2), one(3)]), one(3), one(4)])))
    assert [(f["log_id"].unique().tolist(), len(f)) for f in got] == [([0], 4), ([1, 2], 16), ([3], 8), ([4], 4)]
    assert list(folds.whole_logs(iter([]))) == []


def test_a_log_in_gear_is_not_mixed_with_its_neighbours(spark, small_batches):
    rows = [(log, i, 2000.0, 20.0, v, v, 2000.0 / v) for log, v in enumerate((45.0, 28.0, 65.0) * 20) for i in range(5)]
    f = spark.createDataFrame(rows, "log_id long, row_idx long, rpm double, tps double, vss double, mph double, ratio double").withColumns({"to_mph": F.lit(1.0)})
    got = E.gears(f).groupBy("log_id").agg(F.array_sort(F.collect_list(F.struct("row_idx", "gear"))).alias("g")).collect()
    assert len(got) == 60
    for r in got:
        gear = (3, 2, 4)[r.log_id % 3]
        assert [x.gear for x in r.g] == [0, 0, gear, gear, gear]


def test_rows_of_a_session_go_through_three_windows(spark):
    rows = spark.range(100).select((F.col("id") % 5).alias("log_id"), F.col("id").alias("row_idx"), *(F.col("id").cast("double").alias(c) for c in Z.CHANNELS))
    plan = Z.prepared(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("- Window [") == 3 and plan.count("- Sort [") == 1 and plan.count("Exchange hashpartitioning") == 1


def test_logs_with_a_converter_channel_are_left_out_before_the_windows(spark):
    g = spark.createDataFrame([(0, 0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 3)], E.GEAR_ROWS + ", tcc double, gear int")
    plan = E.best_converter_events(g)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = lambda word: next(i for i, line in enumerate(plan) if word in line)
    assert depth("Window") < depth("LeftAnti")
