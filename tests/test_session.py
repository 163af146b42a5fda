"""Whole-session reports on rows made for them, and the progress that a caller sees."""

import pytest
from pyspark.sql import functions as F

from revscope.operators import session as Z

COLUMNS = ["rpm", "map", "tps", "vss", "ect", "kr", "stft_b1", "ltft_b1", "stft_b2", "ltft_b2", "o2_b1", "o2_b2", "cmd_afr", "wb_afr", "baro", "time_s"]
BASE = {"rpm": 2000.0, "map": 50.0, "tps": 20.0, "vss": 45.0, "ect": 190.0, "kr": 0.0, "stft_b1": 128.0, "ltft_b1": 128.0, "stft_b2": 128.0, "ltft_b2": 128.0, "o2_b1": 450.0, "o2_b2": 450.0, "cmd_afr": 14.7, "wb_afr": 14.7, "baro": 98.0}


def table(spark, rows, columns=COLUMNS, log_id=0):
    data = [(log_id, i, *[{**BASE, "time_s": i * 0.145, **r}[c] for c in columns]) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "log_id long, row_idx long, " + ", ".join(f"{c} double" for c in columns))


@pytest.fixture(scope="module")
def log(spark):
    rows = [dict() for _ in range(300)]
    for start in range(30, 270, 30):
        for k in range(6):
            rows[start + k] = {"tps": 40.0, "o2_b1": 200.0 if k == 2 else 450.0}
    rows[100] = {"kr": 4.0}
    rows[101] = {"kr": 3.0}
    for i in range(275, 290):
        rows[i] = {"ltft_b1": 160.0, "rpm": 3300.0, "stft_b2": None, "ltft_b2": None}
    return rows


def test_sub_reports_and_lists(spark, log):
    r = Z.session_report(table(spark, log), 900.0).first().report
    assert r.row_count == 300 and r.missing == [] and r.knock.events == 1 and r.knock.samples == 2 and r.knock.max_kr == round(4 * 0.175781, 2)
    assert r.tip_in.events == len(r.tip_in.detail) == 8 and all(d.lean for d in r.tip_in.detail) and [d.row_idx for d in r.tip_in.detail] == list(range(30, 270, 30))
    ranks = [abs(c.avg_trim) for c in r.fuel.cells]
    assert ranks == sorted(ranks, reverse=True) and r.fuel.cell_count == len(ranks)
    assert r.transmission.tcc_source == "inferred" and r.transmission.pcm_s_12 is None and r.transmission.shift_time_detail == []


def test_lists_end_at_their_limit(spark):
    rows = [dict() for _ in range(1000)]
    for start in range(20, 980, 25):
        for k in range(6):
            rows[start + k] = {"tps": 40.0}
    reports = Z.session_report(table(spark, rows))
    r = reports.first().report
    assert r.tip_in.events == 39 and len(r.tip_in.detail) == Z.LIMITS["tip_in"]
    listed = Z.details(reports).where("list = 'tip_in'").orderBy("nth").collect()
    assert [x.nth for x in listed] == list(range(1, 26)) and listed[0].row_idx == 20


def test_the_limit_is_taken_before_the_shuffle(spark):
    rows = spark.range(1000).select((F.col("id") % 5).alias("log_id"), F.col("id").alias("row_idx"))
    plan = Z.first_of(rows, "flared", ["row_idx"], ["row_idx"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan


def test_tables_without_channels(spark):
    few = Z.session_report(table(spark, [{}] * 50, ["rpm", "time_s"])).first().report
    assert few.missing == ["map", "tps"] and few.row_count == 50
    assert few.fuel is None and few.knock is None and few["lambda"] is None and few.tip_in is None and few.transmission is None and few.bank_imbalance is None
    assert Z.session_report(table(spark, [])).count() == 0


def test_two_logs_do_not_mix(spark, log):
    both = table(spark, log).unionByName(table(spark, [{}] * 40, log_id=7))
    got = {r.log_id: r.report for r in Z.session_report(both, 900.0).collect()}
    assert got[7].row_count == 40 and got[7].knock.events == 0 and got[7].tip_in.events == 0
    assert got[0] == Z.session_report(table(spark, log), 900.0).first().report


def test_progress_is_told_once_for_each_stage(spark, log):
    seen = []

    def listen(name, percent, rows):
        seen.append((name, percent, rows))
        raise RuntimeError("a listener's trouble is its own")

    watched = Z.session_report(table(spark, log), 900.0, on_stage=listen)
    assert [(n, p) for n, p, _ in seen] == list(Z.STAGES.items())
    assert dict((n, k) for n, _, k in seen)["features"] == 300 and seen[-1][2] == 1
    assert watched.first().report == Z.session_report(table(spark, log), 900.0).first().report


def test_coverage_gaps_and_steps(spark):
    short = Z.coverage(Z.coverage_figures(Z.prepared(table(spark, [{}] * 100)))).first()
    assert [(g.area, g.severity) for g in short.gaps] == [("idle", "warn"), ("cruise", "warn"), ("wot", "critical"), ("cells", "warn")]
    assert short.steps == [Z.STEPS["idle"], Z.STEPS["cruise"], Z.STEPS["wot"]]
    bare = Z.coverage(Z.coverage_figures(Z.prepared(table(spark, [{}] * 100, ["rpm", "map", "time_s"])))).first()
    assert [g.area for g in bare.gaps] == ["idle", "cruise", "wot", "cells", "tps", "kr", "o2", "ect"] and bare.steps[-2:] == [Z.STEPS["kr"], Z.STEPS["o2"]]
    good = [{"rpm": 900.0, "tps": 1.0, "map": 35.0, "vss": 0.0}] * 150 + [{"rpm": 1500.0 + 500 * (i // 60)} for i in range(600)] + [{"tps": 90.0, "map": 97.0, "rpm": 1500.0 + 500 * (i // 30)} for i in range(240)]
    fine = Z.coverage(Z.coverage_figures(Z.prepared(table(spark, good)))).first()
    assert fine.verdict == "excellent" and fine.steps == [] and fine.score >= 85


def test_details_make_a_report_once(spark, log):
    reports = Z.session_report(table(spark, log), 900.0)
    rows = Z.details(reports)
    assert [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema] == ["log_id bigint", "list string", "nth bigint", "row_idx bigint", "label string", "value double"]
    scans = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")
    assert 0 < scans(rows) <= scans(reports)
    assert {r.list for r in rows.select("list").distinct().collect()} >= {"tip_in", "fuel", "o2"}
