"""Chunked sessions against the same rules over whole logs, with chunks so short that everything crosses their borders."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from revscope.operators import events as E
from revscope.operators import features as X
from revscope.operators import folds, order
from revscope.operators import long_sessions as L
from revscope.operators import reports as R
from revscope.sources import merge
from revscope.sources.telemetry import telemetry

SF = "/root/testdata/sf0.001"
SIZE = 300


@pytest.fixture(scope="module")
def session(spark):
    """The log of the smallest tables cut in three, the parts merged again, and the log itself behind them."""
    log = telemetry(spark, SF)
    parts = [log.where(f"row_idx between {a} and {b}").withColumn("log_id", F.lit(k).cast("long")) for k, (a, b) in enumerate([(0, 399), (400, 811), (812, 2499)])]
    return merge.merged([parts[0].unionByName(parts[1]), parts[2]]).drop(merge.SOURCE).cache()


@pytest.fixture(scope="module")
def whole(session):
    return X.with_features(session).cache()


@pytest.fixture(scope="module")
def parted(session):
    return L.with_features(L.chunked(session, SIZE), SIZE).cache()


def rows(df, *columns):
    columns = columns or tuple(sorted(df.columns))
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def test_split_and_merged_is_the_whole(spark, session):
    log = telemetry(spark, SF)
    assert rows(session, "row_idx", "rpm", "time_s") == rows(log, "row_idx", "rpm", "time_s")


def test_features(whole, parted):
    columns = ("row_idx", "prev_tps", "prev_map", "warm_at", "region", "segment", "is_idle", "is_warm", "engine_on")
    assert rows(parted, *columns) == rows(whole, *columns)


def test_knock_runs(whole, parted):
    wanted = R.knock_events(whole).drop("peak", "total")
    got = L.knock_events(parted)
    assert rows(got) == rows(wanted) and got.count() > 5


@pytest.fixture(scope="module")
def geared(parted):
    return L.chunked(L.gears(parted, SIZE), SIZE).cache()


def test_gears_and_what_follows_from_them(whole, geared):
    g = E.gears(whole)
    assert rows(geared, "row_idx", "ratio", "gear") == rows(g, "row_idx", "ratio", "gear")
    s, shifted = E.shifts(g), L.shifts(geared, SIZE)
    assert rows(shifted) == rows(s) and s.count() > 5
    assert rows(L.converter_events(geared, SIZE)) == rows(E.converter_events(g))
    assert rows(L.hunting(L.chunked(shifted, SIZE), SIZE)) == rows(E.hunting(s))


def test_tip_ins(whole, parted):
    assert rows(L.tip_ins(parted, SIZE).drop("o2_before")) == rows(E.tip_ins(whole).drop("o2_before"))


def test_filled_time(spark, session):
    holes = session.withColumn("time_s", F.when(F.col("row_idx") % 400 < 390, F.col("time_s")))
    assert rows(L.filled_time(holes, 8)) == rows(E.filled_time(holes))
    few = session.withColumn("time_s", F.when(F.col("row_idx") % 2 == 0, F.col("time_s")))
    assert rows(L.filled_time(few, 100)) == rows(E.filled_time(few))


def _chunks(rows_, size):
    for begin in range(0, max(rows_["row_idx"].max() + 1, 1) if len(rows_) else 0, size):
        yield begin, rows_[(rows_["row_idx"] >= begin) & (rows_["row_idx"] < begin + size)]


def _by_chunks(machine, frame, size):
    """Both passes in plain Python: functions first, then their application."""
    state, out = machine.start, []
    for begin, chunk in _chunks(frame, size):
        if len(chunk):
            out.append(machine.run(chunk, begin, size, state))
            state = machine.ends(chunk, begin, size)[machine.states.index(state)]
        else:
            state = machine.idle(state, size)
    return pd.concat(out) if out else frame


def test_machines_over_random_rows():
    rng = random.Random(3)
    for _ in range(60):
        n, size = rng.randint(1, 200), rng.randint(1, 40)
        frame = pd.DataFrame({"row_idx": range(n), "valid": [rng.random() < 0.9 for _ in range(n)], "gear": [rng.choice([0, 1, 2, 2, 2, 3]) for _ in range(n)]})
        got = _by_chunks(L.GearMachine(), frame, size)["gear"].to_numpy()
        assert (got == folds.debounced_gears(frame["valid"].to_numpy(), frame["gear"].to_numpy())).all()
        at = sorted(rng.sample(range(400), rng.randint(1, 80)))
        events = pd.DataFrame({"row_idx": at, "type": [rng.choice(["apply", "release"]) for _ in at]})
        assert _by_chunks(L.SpacedMachine(20), events, size)["row_idx"].tolist() == np.array(at)[folds.spaced(np.array(at), 20)].tolist()
        wanted = folds.alternating(np.array(at), events["type"].to_numpy(), 20)
        assert _by_chunks(L.AlternatingMachine(20, ["apply", "release"]), events, size)["row_idx"].tolist() == np.array(at)[wanted].tolist()


def test_no_task_holds_a_session(parted):
    sizes = [r["count"] for r in parted.groupBy(*L.KEY).count().collect()]
    assert max(sizes) <= SIZE and len(sizes) == 4
    with pytest.raises(ValueError):
        L.with_halo(parted, 400, size=300)


def test_global_order(spark):
    rng = random.Random(6)
    data = [(rng.randrange(30), rng.randrange(10**6), rng.randrange(5)) for _ in range(500)]
    df = spark.createDataFrame(data, "a long, b long, n long")
    ordered = sorted(data)
    sums = {(r.a, r.b): r.before for r in order.with_running_sums(df, ["a", "b"], {"before": "n"}).collect()}
    total = 0
    for a, b, n in ordered:
        assert sums[a, b] == total
        total += n
    previous = {(r.a, r.b): (r.pa, r.pn) for r in order.with_previous(df, ["a", "b"], {"pa": "a", "pn": "n"}).collect()}
    assert [previous[a, b] for a, b, _ in ordered] == [(None, None), *((a, n) for a, _, n in ordered[:-1])]
    assert order.with_running_sums(df.limit(0), ["a"], {"before": "n"}).count() == 0 and order.with_previous(df.limit(0), ["a"], {"p": "n"}).count() == 0


def test_orders_have_no_global_window(spark, session):
    logs = spark.range(50).select(F.col("id").alias("log_id"))
    for df in (order.with_previous(logs, ["log_id"], {"earlier": "log_id"}), R.with_earlier(logs, logs), merge.merged([logs.withColumn("row_idx", F.col("log_id"))])):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "SinglePartition" not in df._jdf.queryExecution().executedPlan().toString() and plan.count("windowspecdefinition(") == plan.count("windowspecdefinition(_part")
