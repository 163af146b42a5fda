"""Rules of the log operators on rows made for them, and the registered queries against SQL."""

import pathlib

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from revscope.operators import events as E
from revscope.operators import features as X
from revscope.operators import images as I
from revscope.operators import reports as R
from revscope.operators import rules as U
from revscope.plans import catalog
from revscope.sources import merge
from revscope.sources.telemetry import telemetry
from revscope.streaming import replay

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
COLUMNS = ["rpm", "map", "tps", "vss", "ect", "kr", "stft_b1", "ltft_b1", "stft_b2", "ltft_b2", "o2_b1", "o2_b2", "cmd_afr", "wb_afr", "baro", "iac", "inj_dc", "time_s"]


def log(spark, rows, log_id=0):
    base = {"rpm": 2000.0, "map": 50.0, "tps": 20.0, "vss": 45.0, "ect": 190.0, "kr": 0.0, "stft_b1": 128.0, "ltft_b1": 128.0, "stft_b2": 128.0, "ltft_b2": 128.0, "o2_b1": 450.0, "o2_b2": 450.0, "cmd_afr": 14.7, "wb_afr": 14.7, "baro": 98.0, "iac": 30.0, "inj_dc": 20.0}
    data = [(log_id, i, *[{**base, "time_s": i * 0.145, **r}[c] for c in COLUMNS]) for i, r in enumerate(rows)]
    return X.with_features(spark.createDataFrame(data, "log_id long, row_idx long, " + ", ".join(f"{c} double" for c in COLUMNS)))


def test_quality_gate_counts_transients_first(spark):
    rows = [{"ect": 100.0}] * 50 + [{}] * 150
    rows[10] = {"ect": 100.0, "tps": 40.0}
    got = R.F.broadcast(X.gate_counts(log(spark, rows))).first()
    assert (got.transient_rows, got.cold_rows, got.kept_rows) == (2, 48, 150)


def test_imbalance_names_the_lean_bank(spark):
    rows = [{"ltft_b1": 128 + 15.36, "ltft_b2": 128 + 1.28}] * 40
    got = R.bank_imbalance(log(spark, rows)).collect()
    assert [(r.bank1_avg, r.bank2_avg, r.lean_bank) for r in got] == [(12.0, 1.0, 1)]


def test_generic_trims_stand_in_for_missing_banks(spark):
    f = log(spark, [{"ltft_b1": 128 + 12.8, "stft_b1": 128.0}] * 30)
    bare = f.drop("stft_b1", "ltft_b1", "stft_b2", "ltft_b2")
    generic = bare.withColumns({"stft": F.lit(128.0), "ltft": F.lit(128 + 25.6)})
    assert [(r.samples, r.avg_trim) for r in R.fuel_trim_cells(generic).collect()] == [(30, 20.0)]
    # the short trim of the bank that reports comes from the generic channel
    half = bare.withColumns({"ltft_b2": F.lit(128 + 12.8), "stft": F.lit(128 + 6.4), "ltft": F.lit(200.0)})
    assert [r.avg_trim for r in R.fuel_trim_cells(half).collect()] == [15.0]
    assert [r.avg_trim for r in R.fuel_trim_cells(bare).collect()] == [0.0]
    assert [r.avg_trim for r in R.fuel_trim_cells(f).collect()] == [5.0]


def test_knock_runs_break_at_missing_values(spark):
    rows = [{}] * 5 + [{"kr": 3.5, "rpm": 3000.0}, {"kr": 4.5, "rpm": 3100.0}, {"kr": None}, {"kr": 2.5}] + [{}] * 5
    got = R.knock_events(log(spark, rows)).orderBy("start_row").collect()
    assert [(r.start_row, r.samples, r.peak_kr, r.rpm, r.suspect_noise) for r in got] == [(5, 2, 4.5, 3100.0, False), (8, 1, 2.5, 2000.0, True)]


def test_raw_counts_are_scaled(spark):
    got = X.kr_scales(log(spark, [{"kr": 10.0}, {"kr": 20.0}])).first()
    assert got.raw_counts and got.scale == pytest.approx(0.175781)


def test_single_sample_spike_is_no_tip_in(spark):
    rows = [{"tps": 10.0}] * 30 + [{"tps": 30.0}] + [{"tps": 10.0}] * 30 + [{"tps": 30.0, "o2_b1": 100.0}] * 10
    got = E.tip_ins(log(spark, rows)).collect()
    assert [(r.row_idx, r.lean, r.min_o2) for r in got] == [(61, True, 100)]


def test_cranking(spark):
    rows = [{"rpm": 0.0, "ect": 60.0}] * 3 + [{"rpm": 250.0, "ect": 60.0}] * 30 + [{"rpm": 1500.0, "ect": 60.0}] * 20 + [{"rpm": 900.0, "ect": 60.0}] * 250 + [{"ect": 200.0}] * 5
    got = E.cranks(log(spark, rows)).collect()
    assert [(r.start_row, r.samples, r.duration_s, r.rpm_flare, r.started) for r in got] == [(3, 30, 4.21, 600, True)]
    assert E.crank_verdict(log(spark, rows)).first().verdict == "long-crank"


def test_coverage_without_full_load_is_capped(spark):
    rows = [{"rpm": 800.0, "tps": 1.0, "map": 40.0, "vss": 0.0}] * 200 + [{"rpm": 1000.0 + 500 * (k // 50), "map": 40.0 + 10 * (k // 50 % 2)} for k in range(900)]
    got = R.coverage_score(log(spark, rows)).first()
    assert got.wot == 0 and got.score <= 59


def test_split_and_merged_log_equals_the_whole(spark):
    whole = telemetry(spark, SF).where("log_id = 0")
    again = merge.merged([whole.where("row_idx < 300"), whole.where("row_idx >= 300").withColumn("row_idx", F.col("row_idx") - 300)])
    for report in (R.fuel_trim_cells, R.knock_summary, R.o2_cross_counts, lambda f: E.shifts(E.gears(f))):
        a, b = (report(X.with_features(t)).toPandas() for t in (whole, again))
        pd.testing.assert_frame_equal(*(d.sort_values(list(d.columns)).reset_index(drop=True) for d in (a, b)), check_dtype=False)


def test_results_do_not_depend_on_partitions(spark):
    t = telemetry(spark, SF)
    a, b = (R.o2_health(X.with_features(x)).toPandas() for x in (t.coalesce(1), t.repartition(7, "row_idx")))
    pd.testing.assert_frame_equal(*(d.sort_values(["log_id", "bank"]).reset_index(drop=True) for d in (a, b)))


def test_fuel_gates(spark):
    cells = spark.createDataFrame([(0, 1000, 40, n, t, 1.0, i, 0) for n, t, i in ((9, 9.0, 0.0), (25, 10.0, 0.6), (70, -2.5, 0.0), (70, 1.0, 0.0))], "log_id long, rpm_lo long, map_lo long, samples long, avg_trim double, stddev double, idle_fraction double, first_row long")
    none = spark.createDataFrame([], "log_id long, rpm_lo long, map_lo long, samples long, bias string, lean_bank int")
    got = {(r.mode, r.samples, r.avg_trim): (r.table_name, r.action, r.delta_pct, r.confidence) for r in U.fuel_suggestions(cells, none, none).collect()}
    assert got[("balanced", 25, 10.0)] == ("Idle VE", "add fuel", 8.0, "medium")
    assert got[("conservative", 25, 10.0)] == ("Idle VE", "none", 0.0, "low")
    assert got[("aggressive", 25, 10.0)] == ("Idle VE", "add fuel", 10.0, "high")
    assert got[("aggressive", 70, -2.5)] == ("Main VE", "remove fuel", -2.5, "high") and ("balanced", 70, -2.5) not in got
    assert ("aggressive", 70, 1.0) not in got


def test_ledger_compounds_fuel_and_adds_spark(spark):
    p = spark.createDataFrame([("fuel", "a", 0, 10.0), ("fuel", "a", 1, 5.0), ("spark", "b", 0, -3.0), ("spark", "b", 1, -3.0)], "kind string, cell string, pass_no int, delta double")
    got = {r.kind: (r.cumulative, r.blocked) for r in U.ledger_cumulative(p).collect()}
    assert got == {"fuel": (15.5, True), "spark": (-6.0, True)}


def test_knock_learning_keeps_to_the_ledger(spark):
    event = "log_id long, rpm double, map double, region string, suspect_noise boolean, tip_out boolean"
    events = spark.createDataFrame([(k, rpm, 50.0, "cruise", False, False) for k in (0, 1) for rpm in (2000.0, 2400.0)], event)
    ledger = spark.createDataFrame([("spark", "5/6", 0, -3.0), ("spark", "5/6", 1, -3.0), ("spark", "6/6", 0, -5.0), ("fuel", "6/6", 0, 9.0)], "kind string, cell string, pass_no int, delta double")
    assert sorted((r.row, r.col) for r in U.knock_learning(events).collect()) == [(5, 6), (6, 6)]
    assert [(r.row, r.col) for r in U.knock_learning(events, ledger).collect()] == [(6, 6)]


def test_convergence_verdicts(spark):
    # sessions 2 and 5 follow one another, whatever lies between their numbers
    before = [(2, k, 0, 8.0, 50) for k in range(5)]
    after = [(5, k, 0, t, n) for k, t, n in ((0, -1.0, 50), (1, -5.0, 50), (2, 4.0, 50), (3, 7.0, 50), (4, 1.0, 5))]
    cells = spark.createDataFrame(before + after, "log_id long, rpm_lo long, map_lo long, avg_trim double, samples long")
    rows = [(2, "fuel", "Main VE", k, 0, 4.0) for k in range(6)] + [(2, "spark", "Spark Advance", 0, 0, -1.0)]
    patches = spark.createDataFrame(rows, "log_id long, kind string, table_name string, rpm_lo long, map_lo long, delta double")
    follows = R.with_earlier(cells.select("log_id").distinct(), cells)
    found = R.convergence(cells, patches, follows).collect()
    assert [(r.detail, r.verdict) for r in found if r.kind == "spark"] == [("not-judged-by-trims", "inconclusive")]
    got = {(r.log_id, r.rpm_lo): r.detail for r in found if r.kind == "fuel"}
    assert got == {(5, k): d for k, d in enumerate(["crossed", "overshot", "closer", "unmoved", "inconclusive", "inconclusive"])}


def test_sessions_follow_one_another_across_gaps(spark):
    logs = telemetry(spark, "/root/testdata/sf0.01").where("log_id in (0, 2, 3)")
    got = {r.log_id: r for r in R.session_metrics(X.with_features(logs)).collect()}
    assert got[0].prev_coverage is None and got[2].prev_coverage == got[0].coverage and got[3].prev_abs_trim == got[2].abs_trim


SESSION = "image_id string, log_id long, mode string"


def test_smoothing_rings(spark):
    rows = [("a", 0, "m", 2, 2, 8.0), ("a", 1, "m", 0, 0, 4.0)]
    got = {(r.log_id, r.row, r.col): r.delta for r in I.smoothed(spark.createDataFrame(rows, SESSION + ", row int, col int, delta double"), 5, 5).collect()}
    assert got[(0, 2, 2)] == 8.0 and got[(0, 1, 1)] == 4.0 and got[(0, 0, 0)] == 2.0 and got[(1, 1, 1)] == 2.0 and len(got) == 25 + 9


def test_stages_patch_what_the_stage_before_left(spark):
    tables = I.catalog(spark).where("title = 'Power Enrichment'")
    image = I.formula_image(spark, "a")
    sessions = spark.createDataFrame([("a", 0, "x"), ("a", 1, "x")], SESSION)
    change = lambda percent: sessions.where("log_id = 0").withColumn("percent", F.lit(percent))
    steps = [(n, lambda now, p=p: I.apply_scale(now, tables, ["Power Enrichment"], change(p))) for n, p in (("first", -20.0), ("second", 10.0))]
    out = I.chained(image, tables, sessions, steps).collect()
    first, second = ({r.address: r for r in out if r.stage == n} for n in ("first", "second"))
    assert {r.log_id for r in out} == {0} and len(first) > 10
    assert all(second[k].old_value == first[k].new_value for k in first.keys() & second.keys())


def test_null_percentages_patch_nothing(spark):
    row = ("a", 0, "x", None, 40.0, None, 60.0, None, 18.0, "3-4")
    changes = spark.createDataFrame([row], SESSION + ", " + ", ".join(f"{c} {'string' if c == 'hunt_pair' else 'double'}" for c in I.TRANS_CHANGES))
    assert I.apply_transmission(I.formula_image(spark, "a"), I.catalog(spark), changes).count() == 0


def test_converter_channel_in_words_and_as_a_duty(spark):
    duty = [0.0, None, 80.0, 80.0, 10.0] * 4
    words = ["", "OFF", None, "Locked", "on", "released"] * 4
    for kind, values in (("double", duty), ("string", words)):
        g = spark.createDataFrame([(0, k, 3, v) for k, v in enumerate(values)], f"log_id long, row_idx long, gear int, tcc {kind}")
        got = E.channel_converter_events(g).orderBy("row_idx").collect()
        assert [r.type for r in got] == ["apply", "release"] * 4
        assert E.channel_converter_events(g.where("row_idx < 8")).count() == 0


def test_image_gate_sees_changes_between_the_sampled_bytes(spark):
    known = I.formula_image(spark, "k1").unionByName(I.formula_image(spark, "k2", F.when(F.col("offset") % 4099 == 5, 1).otherwise(0)))
    windows = spark.createDataFrame([(0x8000, 16), (0x8000, 32)], "address int, length int")  # known images differ in the second
    # the change at 0x8001 is in a window, but at no place that the stride of 97 or the dense step of 7 samples
    touched = I.formula_image(spark, "touched", F.when(F.col("offset") == 0x8001, 1).otherwise(0))
    short = I.formula_image(spark, "short").where("offset < 60000")
    images = known.where("image_id = 'k2'").unionByName(touched).unionByName(short)
    got = {r.image_id: (r.level, r.closest, r.confidence) for r in I.image_gate(images, known, I.catalog(spark), windows).collect()}
    assert got == {"k2": ("ok", "k2", "high"), "touched": ("warn", "k1", "high"), "short": ("block", "k1", "high")}


def test_identical_images(spark):
    images = I.formula_image(spark, "a").unionByName(I.formula_image(spark, "b")).unionByName(I.formula_image(spark, "c", F.lit(1)))
    assert [(r.image_id, r.other_id) for r in I.same_image(images).collect()] == [("a", "b")]


def test_streamed_gears_equal_the_batch(spark, tmp_path):
    t = telemetry(spark, SF).where("log_id = 0").select("log_id", "row_idx", "rpm", "map", "vss", "kr", "time_s")
    for k in range(4):
        t.where((F.col("row_idx") >= 250 * k) & (F.col("row_idx") < 250 * (k + 1))).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    schema = "log_id long, row_idx long, rpm double, map double, vss double, kr double, time_s double"
    flat = tmp_path / "flat"
    flat.mkdir()
    for k in range(4):
        part = next(pathlib.Path(tmp_path / f"in/{k}").glob("*.parquet"))
        part.rename(flat / f"{k}.parquet")
    stream = replay.replay(spark, str(flat), schema)
    q = replay.gear_stream(stream).writeStream.format("memory").queryName("gears").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).start()
    w = replay.load_windows(stream).writeStream.format("memory").queryName("loads").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).start()
    k = replay.knock_sessions(stream).writeStream.format("memory").queryName("knocks").outputMode("append").option("checkpointLocation", str(tmp_path / "c3")).start()
    for s in (q, w, k):
        s.processAllAvailable()
        s.stop()
    whole = X.with_features(telemetry(spark, SF).where("log_id = 0"))
    batch = {r.row_idx: r.gear for r in E.gears(whole).collect()}
    got = {r.row_idx: r.gear for r in spark.table("gears").collect()}
    assert len(got) == len(batch) == 1000 and got == batch
    assert spark.table("loads").count() > 10
    retarded = {round(r.time_s, 3): r.kr for r in t.where("kr > 0.5").collect()}
    runs = spark.table("knocks").collect()
    # the runs that the watermark has closed, each with the values of its rows
    assert runs and all(retarded[round((r.start - r.start.replace(hour=0, minute=0, second=0, microsecond=0)).total_seconds(), 3)] <= r.peak and r.peak in retarded.values() for r in runs)


QUICK = ["transmission_report", "tcc_channel_events", "crank_events", "warmup_advice", "verify_patches", "merge_logs", "fuel_trim_cells", "knock_events", "o2_health", "log_health", "gear_inference", "shift_events", "tipin_events", "fuel_suggestions", "apply_pe", "entropy_windows", "parsed_log", "playback_events"]


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want, got = con.sql(catalog.oracle_sql()[name]).df(), catalog.queries()[name](spark, SF).toPandas()
    assert sorted(want.columns) == sorted(got.columns) and len(want) == len(got)
    names = sorted(want.columns)

    def flat(d):
        return sorted(tuple("" if pd.isna(v) else f"{float(v):.9g}" if isinstance(v, (int, float)) else str(v) for v in r) for r in d[names].astype(object).itertuples(index=False))

    assert flat(want) == flat(got)


def test_every_query_has_sql_and_every_sql_a_query():
    assert catalog.queries().keys() == catalog.oracle_sql().keys()


def test_stages_keep_patches_and_no_images_of_sessions(spark, monkeypatch):
    tables = I.catalog(spark).where("title = 'Main VE'")
    sessions = spark.createDataFrame([("a", k, "x") for k in range(20)], SESSION)
    change = sessions.where("log_id = 0").withColumn("percent", F.lit(10.0))
    rows, staged = [], I.staged
    monkeypatch.setattr(I, "staged", lambda df, name: rows.append((out := staged(df, name)).count()) or out)
    steps = [(n, lambda now: I.apply_scale(now, tables, ["Main VE"], change)) for n in ("first", "second")]
    out = I.chained(I.formula_image(spark, "a"), tables, sessions, steps).collect()
    first, second = ({r.address: r for r in out if r.stage == n} for n in ("first", "second"))
    # words of two bytes are read as the stage before left them
    assert len(first) > 100 and all(second[k].old_value == first[k].new_value for k in first.keys() & second.keys())
    assert max(rows) <= 17 * 13
