"""The report of a whole session: everything that is known of a log, nested in one row.

The log's rows are prepared once: one shuffle by log, and every value that depends on
other rows (features, trim styles, knock scale, runs, crossings, gears before
debouncing) is a window of it. That table is staged; the sub-reports are a few
aggregates of it, each covering several of them, and come together in one union and
one aggregate. A channel that a table lacks counts as one without values.

A caller may watch: ``on_stage`` gets each stage's name, percentage and number of rows
once, in order, from metrics that Spark observes while the stage is written.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from revscope.cluster import staged
from revscope.functions import scalars as S
from revscope.operators import events as E
from revscope.operators import features as X
from revscope.operators import folds
from revscope.operators.features import LOG, ORDER

CHANNELS = ["rpm", "map", "tps", "vss", "ect", "kr", "stft_b1", "ltft_b1", "stft_b2", "ltft_b2", "o2_b1", "o2_b2", "cmd_afr", "wb_afr", "baro", "time_s", "tcc", "shift_t12", "shift_t23"]
NEEDED = ["rpm", "map", "tps"]
#: The stages of an analysis and how far it is after each, in percent.
STAGES = {"segments": 5, "features": 12, "fuel": 22, "knock": 32, "lambda": 40, "narrowband": 50, "tip_in": 58, "pe_entry": 66, "transmission": 76, "bank_imbalance": 84, "baro": 92, "report": 100}
#: How many rows of each list a report keeps.
LIMITS = {"tip_in": 25, "shift": 30, "flared": 10, "converter": 20, "kickdown": 15, "hunting": 5, "shift_time": 10}
BANKS = (1, 2)
#: The rows after a throttle stab among which three must hold it.
AHEAD = range(1, 6)


def _valid_baro() -> Column:
    return F.when((F.col("baro") > 20) & (F.col("baro") < 120), F.col("baro"))


def prepared(rows: DataFrame) -> DataFrame:
    """All row-level values that the sub-reports need; one shuffle by log.

    What rows take from others of their log comes in three windows, as each window moves every row:
    from the channels, from the features made of these, and medians of a whole log.
    """
    rows = X.with_generic_trims(rows)
    banks = [b for b in BANKS if any(f"{k}_b{b}" in rows.columns for k in ("stft", "ltft"))]
    rows = rows.withColumns({c: F.lit(None).cast("double") for c in CHANNELS if c not in rows.columns})
    rows = rows.withColumn("open", F.coalesce(F.col("tps") >= 60, F.lit(False)))
    f = rows.withColumns(
        {
            **X.feature_windows(rows), "_kr_n": X.kr_counter(), "_opens": F.sum(F.col("open").cast("long")).over(ORDER()), "min_o2": F.min("o2_b1").over(ORDER().rowsBetween(0, 7)),
            **{f"_prev_{c}": F.lag(c).over(ORDER()) for c in ("vss", "shift_t12", "shift_t23")}, **{f"_ahead_{k}": F.lead("tps", k).over(ORDER()) for k in AHEAD},
        }
    )
    f = X.with_row_features(f).withColumn("_first", X.kr_head())
    f = f.withColumn("gated", (F.col("region") != "transient") & F.col("is_warm"))
    steady = F.col("gated") & F.col("region").isin("cruise", "idle")
    f = f.withColumns({f"steady_mv_b{b}": F.when(steady, F.col(f"o2_b{b}")) for b in BANKS})
    # the scale of knock is not known before the window that counts it, so both are counted
    knocks = {name: F.coalesce(F.col("kr") * scale > 0.5, F.lit(False)) for name, scale in (("raw", S.KR_RAW_TO_DEG), ("deg", 1.0))}
    before = ORDER().rowsBetween(Window.unboundedPreceding, -1)
    high = {b: F.col(f"steady_mv_b{b}") > 450 for b in BANKS}
    f = f.withColumns(
        {
            **X.trim_counters(f, F.col("gated")), "raw_counts": X.kr_whole(), **{f"_knocks_{name}": F.sum(k.cast("long")).over(ORDER()) for name, k in knocks.items()},
            **{f"cross_b{b}": F.coalesce(high[b] != F.last(high[b], ignorenulls=True).over(before), F.lit(False)) for b in BANKS},
        }
    )
    f = X.with_upper_medians(f, {**X.trim_heads(f, F.col("gated")), "cruise_ratio": X.steady_ratio(f, F.col("_prev_vss")), "baro_mid": _valid_baro()})
    f = X.with_percents(X.with_told_styles(f)).withColumn("trim", sum((F.col(f"trim_b{b}") for b in banks), F.lit(0.0)) / max(1, len(banks)))
    f = X.with_gears(X.with_speed(f)).withColumn("deg", F.col("kr") * F.when(F.col("raw_counts"), S.KR_RAW_TO_DEG).otherwise(1.0))
    held = sum((F.coalesce((F.col(f"_ahead_{k}") >= F.col("prev_tps") + 5).cast("int"), F.lit(0)) for k in AHEAD), F.lit(0)) >= 3
    times = {f"changed_{p}": F.when((F.col(c) > 0) & (F.abs(F.col(c) - F.col(f"_prev_{c}")) > 0.005), S.half_up(F.col(c), 3)) for p, c in (("12", "shift_t12"), ("23", "shift_t23"))}
    f = f.withColumns(
        {
            "knocks": F.coalesce(F.col("deg") > 0.5, F.lit(False)), "knock_run": F.col("row_idx") - F.when(F.col("raw_counts"), F.col("_knocks_raw")).otherwise(F.col("_knocks_deg")), "open_run": F.col("row_idx") - F.col("_opens"),
            "stab": F.coalesce((F.col("tps") - F.col("prev_tps") >= 10) & held, F.lit(False)), **times,
        }
    )
    kept = ["log_id", "row_idx", *CHANNELS, "prev_tps", "region", "is_idle", "is_warm", "warm_at", "gated", "raw_counts", "trim", "trim_b1", "trim_b2", "cruise_ratio", "to_mph", "mph", "ratio", "near_gear", "deg", "knocks", "knock_run", "open", "open_run", "min_o2", "stab", "baro_mid"]
    return f.select(*kept, *(f"{x}_b{b}" for b in BANKS for x in ("steady_mv", "cross")), *times)


def _share(part: Column, whole: Column, places: int = 2) -> Column:
    return S.half_up(F.coalesce(F.try_divide(part, whole), F.lit(0.0)), places)


def _totals(f: DataFrame, altitude_ft: float) -> DataFrame:
    """What needs no key but the log: sizes, regions, lambda error, sensor crossings, full-load richness, barometer. One aggregate."""
    err = S.as_lambda(F.col("wb_afr")) - S.as_lambda(F.col("cmd_afr"))
    f = f.withColumns({"err": err, "_baro": _valid_baro()})
    full = (F.col("tps") >= 78) & F.col("map").isNotNull()
    moving, warm = F.col("region") == "transient", F.col("is_warm")
    in_region = {r: F.col("region") == r for r in X.REGIONS}
    wot = [F.when(F.col("gated") & in_region["wot"], F.col(f"o2_b{b}")) for b in BANKS]
    wot_n = sum((F.count(v) for v in wot), F.lit(0))
    wot_sum = sum((F.coalesce(F.sum(v), F.lit(0.0)) for v in wot), F.lit(0.0))
    wot_rich = sum((F.count_if(v > 700) for v in wot), F.lit(0))
    sums = f.groupBy("log_id").agg(
        F.count("*").alias("n"), *(F.count(c).alias(f"has_{c}") for c in CHANNELS), *(F.count_if(c).alias(f"n_{r}") for r, c in in_region.items()),
        F.count_if(moving).alias("moving"), F.count_if(~moving & ~warm).alias("cold"), F.first("raw_counts").alias("raw_counts"), F.first("cruise_ratio").alias("cruise_ratio"), F.first("to_mph").alias("to_mph"),
        F.count("err").alias("err_n"), F.avg(F.abs("err")).alias("err"), F.count_if(F.abs("err") <= 0.03).alias("err_3"), *(F.count(F.when(c, F.col("err"))).alias(f"err_n_{r}") for r, c in in_region.items()), *(F.avg(F.when(c, F.abs("err"))).alias(f"err_{r}") for r, c in in_region.items()),
        *(x for b in BANKS for x in (F.count(f"steady_mv_b{b}").alias(f"mv_n_{b}"), F.count_if(f"cross_b{b}").alias(f"cross_{b}"), *(g(F.when(F.col(f"steady_mv_b{b}").isNotNull(), F.col("time_s"))).alias(f"t{k}_{b}") for k, g in ((0, F.min), (1, F.max))))),
        wot_n.alias("wot_n"), wot_sum.alias("wot_sum"), wot_rich.alias("wot_rich"),
        F.count("_baro").alias("baro_n"), F.first("baro_mid").alias("mid"), F.min("_baro").alias("low"), F.max("_baro").alias("high"), F.count_if(full).alias("full_n"), F.max(F.when(full, F.col("map"))).alias("full_peak"),
    )
    region = lambda r: F.struct(F.lit(r).alias("region"), F.col(f"err_n_{r}").alias("samples"), S.half_up(F.col(f"err_{r}"), 3).alias("avg_abs_error"))

    def sensor(b: int) -> Column:
        span = F.col(f"t1_{b}") - F.col(f"t0_{b}")
        minutes = F.when(span > 0, span / 60).otherwise(F.col(f"mv_n_{b}") / 600)
        rate = F.when(F.col(f"mv_n_{b}") > 30, S.half_up(F.col(f"cross_{b}") / minutes))
        health = F.when(rate >= 30, "healthy").when(rate >= 10, "lazy").when(rate.isNotNull(), "dead/slow").otherwise("unknown")
        return F.struct(F.lit(f"bank{b}").alias("bank"), F.col(f"mv_n_{b}").alias("samples"), F.col(f"cross_{b}").alias("crossings"), rate.alias("per_min"), health.alias("health"))

    enough, wot_mv = F.col("wot_n") >= 10, F.try_divide("wot_sum", "wot_n")
    wot_status = F.when(~enough, "no wot data").when(wot_mv > 700, "rich").when(wot_mv > 550, "marginal").otherwise("lean")
    expected, measured = S.baro_for_altitude(F.lit(altitude_ft)), F.col("baro_n") >= 10
    off = F.abs(F.col("mid") - expected)
    above = F.coalesce((F.col("full_n") >= 10) & (F.col("full_peak") > F.col("mid") + 5), F.lit(False))
    missing = F.array_compact(F.array(*(F.when(F.col(f"has_{c}") == 0, F.lit(c)) for c in NEEDED)))
    return sums.select(
        "log_id",
        F.struct(F.col("n").alias("row_count"), F.struct(*(F.col(f"n_{r}").alias(r) for r in X.REGIONS)).alias("regions"), missing.alias("missing"), F.lit(float(altitude_ft)).alias("altitude_ft"), F.array(*(F.when(F.col(f"has_{c}") > 0, F.lit(c)) for c in CHANNELS)).alias("channels")).alias("session"),
        F.struct(F.col("cold").alias("gated_warmup"), F.col("moving").alias("gated_transient"), (F.col("has_ect") > 0).alias("ect_available")).alias("gating"),
        F.when(F.col("err_n") > 0, F.struct(F.col("err_n").alias("samples"), S.half_up(F.col("err"), 3).alias("mean_abs_error"), S.half_up(100 * F.col("err_3") / F.col("err_n")).alias("pct_within_3"), F.array(*map(region, X.REGIONS)).alias("by_region"))).alias("lambda"),
        F.struct(*(sensor(b).alias(f"bank{b}") for b in BANKS), F.struct(F.col("wot_n").alias("samples"), F.when(enough, S.half_up_int(wot_mv)).alias("avg_mv"), F.when(enough, S.half_up(100 * F.col("wot_rich") / F.col("wot_n"))).alias("pct_rich"), wot_status.alias("status")).alias("wot")).alias("narrowband"),
        F.struct(F.col("baro_n").alias("samples"), S.half_up(expected, 1).alias("expected_kpa"), F.when(measured, S.half_up(F.col("mid"), 1)).alias("median_kpa"), F.when(measured, S.half_up(F.col("mid") - expected, 1)).alias("delta_kpa"), F.when(measured, F.col("high") - F.col("low") >= 8).alias("drifted"), F.when(measured, F.when(off >= 5, "fault").when((off >= 3) | above, "warn").otherwise("ok")).alias("status")).alias("baro"),
        F.struct(F.when(F.col("cruise_ratio") < 25, "kph->mph").otherwise("mph").alias("vss_unit"), S.half_up(F.col("cruise_ratio")).alias("cruise_ratio")).alias("speed"),
        F.col("raw_counts"),
    )


def _cells(f: DataFrame) -> DataFrame:
    """Trims, bank imbalance and sensor bias cell by cell: one aggregate by cell, one by log that gathers the cells in order."""
    rows = X.with_cell(f.where("gated"))
    told = {b: F.when(F.coalesce(f"stft_b{b}", f"ltft_b{b}").isNotNull(), F.col(f"trim_b{b}")) for b in BANKS}
    sensors = F.filter(F.array("o2_b1", "o2_b2"), lambda v: v.isNotNull())
    rows = rows.withColumn("mv", F.try_divide(F.aggregate(sensors, F.lit(0.0), lambda a, v: a + v), F.size(sensors)))
    mean, trim = F.avg("trim"), F.col("trim")
    sums = rows.groupBy("log_id", "rpm_lo", "map_lo").agg(
        F.count("*").alias("samples"), S.half_up(mean).alias("avg_trim"), S.half_up(F.sqrt(F.greatest(F.lit(0.0), F.avg(trim * trim) - mean * mean))).alias("stddev"), S.half_up(F.avg(F.col("is_idle").cast("double"))).alias("idle_fraction"), F.sum(F.abs(trim)).alias("abs_sum"),
        F.min("row_idx").alias("first_row"), *(x for b, c in told.items() for x in (F.count(c).alias(f"n{b}"), F.avg(c).alias(f"m{b}"))),
        F.count("mv").alias("mv_n"), F.avg("mv").alias("mv"), (100 * F.avg((F.col("mv") > 600).cast("double"))).alias("rich"), (100 * F.avg((F.col("mv") < 300).cast("double"))).alias("lean"),
    )
    delta = F.col("m1") - F.col("m2")
    split = (F.col("n1") >= 15) & (F.col("n2") >= 15) & (F.abs(delta) >= 5)
    bias = F.when((F.col("mv") > 600) & (F.col("rich") > 60), "rich").when((F.col("mv") < 350) & (F.col("lean") > 60), "lean").otherwise("switching")
    fuel = F.struct((-F.abs("avg_trim")).alias("rank"), "first_row", "rpm_lo", "map_lo", "samples", "avg_trim", "stddev", "idle_fraction")
    finding = F.struct((-F.abs(S.half_up(delta))).alias("rank"), "first_row", "rpm_lo", "map_lo", S.half_up(F.col("m1")).alias("bank1_avg"), S.half_up(F.col("m2")).alias("bank2_avg"), S.half_up(delta).alias("delta"), F.when(delta > 0, 1).otherwise(2).alias("lean_bank"), F.col("n1").alias("samples1"), F.col("n2").alias("samples2"))
    sensor = F.struct((-F.col("mv_n")).alias("rank"), "first_row", "rpm_lo", "map_lo", F.col("mv_n").alias("samples"), S.half_up_int(F.col("mv")).alias("avg_mv"), S.half_up(F.col("rich")).alias("pct_rich"), S.half_up(F.col("lean")).alias("pct_lean"), bias.alias("bias"))
    listed = lambda x: F.array_sort(F.collect_list(x))  # noqa: E731 - collect_list leaves nulls out
    by_log = sums.groupBy("log_id").agg(F.sum("samples").alias("n"), F.sum("abs_sum").alias("abs_sum"), listed(fuel).alias("fuel"), listed(F.when(split, finding)).alias("split"), listed(F.when(F.col("mv_n") > 0, sensor)).alias("o2"))
    return by_log.select(
        "log_id",
        F.struct(F.size("fuel").cast("long").alias("cell_count"), _share(F.col("abs_sum"), F.col("n")).alias("overall_abs_trim"), F.col("n").alias("total_samples"), F.col("fuel").alias("cells")).alias("fuel"),
        F.struct(F.size("split").cast("long").alias("finding_count"), F.col("split").alias("findings")).alias("bank_imbalance"),
        F.struct(F.size("o2").cast("long").alias("cell_count"), F.col("o2").alias("cells")).alias("o2"),
    )


def _knock(f: DataFrame) -> DataFrame:
    rows = f.where("knocks")
    votes = [F.struct(F.count_if(F.col("region") == r).alias("n"), (-F.min(F.when(F.col("region") == r, F.col("row_idx")))).alias("first"), F.lit(r).alias("region")) for r in X.REGIONS]
    events = rows.groupBy("log_id", "knock_run").agg(F.count("*").alias("samples"), F.max("deg").alias("peak"), F.sum("deg").alias("total"), F.array_max(F.array(*votes)).getField("region").alias("region"))
    in_region = {r: F.col("region") == r for r in X.REGIONS}
    by_region = F.array(*(F.struct(F.lit(r).alias("region"), F.coalesce(F.sum(F.when(c, F.col("samples"))), F.lit(0)).alias("samples"), F.count_if(c).alias("events"), S.half_up(F.coalesce(F.max(F.when(c, F.col("peak"))), F.lit(0.0))).alias("max_kr")) for r, c in in_region.items()))
    return events.groupBy("log_id").agg(
        F.struct(F.sum("samples").alias("samples"), F.count("*").alias("events"), S.half_up(F.max("peak")).alias("max_kr"), S.half_up(F.sum("total") / F.sum("samples")).alias("avg_kr"), by_region.alias("by_region")).alias("knock")
    )


def first_of(rows: DataFrame, name: str, order: list[str], keep: list[str]) -> DataFrame:
    """(log_id, name): each log's first rows in an order, as many as a report keeps of the list. The limit is taken before anything is shuffled."""
    nth = F.row_number().over(Window.partitionBy("log_id").orderBy(*order))
    cut = rows.withColumn("nth", nth).where(F.col("nth") <= LIMITS[name])
    return cut.groupBy("log_id").agg(F.array_sort(F.collect_list(F.struct("nth", *keep))).alias(name))


def _tip_in(f: DataFrame) -> tuple[DataFrame, DataFrame]:
    stabs = f.where("stab").select(
        "log_id", "row_idx", S.half_up(F.col("tps") - F.col("prev_tps")).alias("dtps"), S.half_up(F.col("prev_tps")).alias("tps_from"), S.half_up(F.col("tps")).alias("tps_to"), "rpm",
        S.half_up_int(F.col("min_o2")).alias("min_o2"), F.coalesce(F.col("min_o2") < 250, F.lit(False)).alias("lean"), F.coalesce(F.col("ect") < F.col("warm_at"), F.lit(False)).alias("cold"),
    )
    tips = staged(folds.keep_spaced(stabs, 20), "tip-ins")
    lean, warm = F.col("lean"), ~F.col("cold")
    return tips, tips.groupBy("log_id").agg(
        F.struct(
            F.count("*").alias("events"), F.count_if(warm).alias("warm_events"), F.count_if(lean).alias("lean_events"), _share(F.count_if(lean), F.count("*")).alias("lean_fraction"), _share(F.count_if(lean & warm), F.count_if(warm)).alias("warm_lean_fraction"),
            S.half_up_int(F.avg(F.when(lean, F.col("min_o2")))).alias("avg_min_o2"), S.half_up_int(S.mean_from_last(F.col("dtps"), F.col("row_idx"))).alias("avg_dtps"),
        ).alias("tip_in")
    )


def _pe_entry(f: DataFrame) -> DataFrame:
    engaged = F.when(S.as_lambda(F.col("cmd_afr")) < 0.95, F.col("row_idx"))
    episodes = f.where("open").groupBy("log_id", "open_run").agg(F.min("row_idx").alias("start_row"), F.count("*").alias("n"), F.min(engaged).alias("pe_row")).where("n >= 7")
    delay = F.avg(F.col("pe_row") - F.col("start_row"))
    return episodes.groupBy("log_id").agg(F.struct(F.count("*").alias("episodes"), F.count("pe_row").alias("engaged"), _share(F.count("pe_row"), F.count("*")).alias("engage_fraction"), S.half_up(delay).alias("avg_delay_rows"), S.half_up(delay * E.SAMPLE_S).alias("avg_delay_s")).alias("pe_entry"))


def _transmission(f: DataFrame) -> list[DataFrame]:
    """(log_id, one or two structs) of what the transmission did; gears are folded once."""
    g = staged(E.gears(f), "gears")
    s = staged(E.shifts(g), "shifts")
    up = F.col("to_gear") > F.col("from_gear")
    pair = F.concat_ws("-", "from_gear", "to_gear")
    means = [S.half_up_int(F.avg(F.when((F.col("from_gear") == k) & (F.col("to_gear") == k + 1), F.col("rpm_at")))).alias(f"shift_rpm_{k}{k + 1}") for k in (1, 2, 3)]
    shifted = s.groupBy("log_id").agg(F.struct(F.count("*").alias("shifts"), F.count_if(up).alias("upshifts"), F.count_if(F.col("to_gear") < F.col("from_gear")).alias("downshifts"), F.count_if("flared").alias("flared"), *means).alias("shifting"))
    kicks = staged(E.kickdowns(f, s), "kickdowns")
    kicked = kicks.groupBy("log_id").agg(F.struct(F.count("*").alias("kickdowns"), F.count_if(F.col("down_row").isNull()).alias("no_shift"), S.half_up(F.avg("delay_s")).alias("avg_delay_s")).alias("kickdown_counts"))
    locks = staged(E.best_converter_events(g), "converter")
    locked = E.converter_cycles(locks).join(locks.groupBy("log_id").agg(F.first("source").alias("source")), "log_id").select("log_id", F.struct("source", F.col("tcc_applies").alias("applies"), F.col("tcc_releases").alias("releases"), F.col("tcc_cycles").alias("cycles")).alias("converter_counts"))
    hunts = staged(E.hunting(s), "hunting")
    hunted = hunts.groupBy("log_id").agg(F.struct(F.count("*").alias("episodes")).alias("hunting_counts"))
    gears = g.groupBy("log_id").agg(F.struct(*(F.count_if(F.col("gear") == k).alias(f"gear{k}") for k in (1, 2, 3, 4))).alias("gear_rows"))
    changes = f.select("log_id", "row_idx", F.explode(F.array_compact(F.array(*(F.when(F.col(c).isNotNull(), F.struct(F.lit(p).alias("pair"), F.col(c).alias("time_s"))) for p, c in (("1-2", "changed_12"), ("2-3", "changed_23")))))).alias("x")).select("log_id", "row_idx", "x.*")
    typical = lambda p: S.upper_median(F.collect_list(F.when(F.col("pair") == p, F.col("time_s"))))
    timed = changes.groupBy("log_id").agg(F.struct(*(x for p in ("1-2", "2-3") for x in (F.count_if(F.col("pair") == p).alias(f"count_{p[0]}{p[2]}"), typical(p).alias(f"typical_{p[0]}{p[2]}")))).alias("shift_times"))
    lists = [
        first_of(s.withColumn("pair", pair), "shift", ["row_idx"], ["row_idx", "pair", "rpm_at", "mph", "tps", "flare_rpm", "flared"]),
        first_of(s.withColumn("pair", pair).where("flared"), "flared", ["row_idx"], ["row_idx", "pair", "rpm_at", "mph", "flare_rpm"]),
        first_of(locks, "converter", ["row_idx"], ["row_idx", "type", "gear"]),
        first_of(kicks, "kickdown", ["row_idx"], ["row_idx", "tps_from", "tps_to", "mph", "delay_s"]),
        first_of(hunts.withColumn("pair", F.concat_ws("-", F.least("from_gear", "to_gear"), F.greatest("from_gear", "to_gear"))), "hunting", ["row_idx"], ["row_idx", "pair", "mph", "tps", "reversals"]),
        first_of(changes, "shift_time", ["pair", "row_idx"], ["row_idx", "pair", "time_s"]),
    ]
    return [shifted, kicked, locked, hunted, gears, timed, *lists]


def _together(parts: list[DataFrame]) -> DataFrame:
    """Rows of the same log from all parts as one row: a union and one aggregate, however many parts there are."""
    kinds = {c: t for part in parts for c, t in part.dtypes if c != "log_id"}
    rows = None
    for part in parts:
        wide = part.select("log_id", *(F.col(c) if c in part.columns else F.lit(None).cast(t).alias(c) for c, t in kinds.items()))
        rows = wide if rows is None else rows.unionByName(wide)
    return rows.groupBy("log_id").agg(*(F.first(c, ignorenulls=True).alias(c) for c in kinds))


class _Watch:
    """Writes a stage's table while Spark counts its rows, and tells the listener; what a listener raises is its own affair."""

    def __init__(self, on_stage: Callable[[str, int, int], None] | None):
        self.on_stage = on_stage

    def write(self, df: DataFrame, name: str, *stages: str) -> DataFrame:
        if not self.on_stage:
            return df if name != "features" else staged(df, f"session-{name}")
        seen = Observation(f"session-{name}")
        out = staged(df.observe(seen, F.count(F.lit(1)).alias("rows")), f"session-{name}")
        for stage in stages:
            self.tell(stage, seen.get["rows"])
        return out

    def tell(self, stage: str, rows: int) -> None:
        if self.on_stage:
            with contextlib.suppress(Exception):
                self.on_stage(stage, STAGES[stage], rows)


def session_report(rows: DataFrame, altitude_ft: float = 2840.0, on_stage: Callable[[str, int, int], None] | None = None) -> DataFrame:
    """One row for each log: log_id and ``report``, a struct of all sub-reports.

    ``on_stage(name, percent, rows)`` is called once for each of STAGES, in their order.
    """
    watch = _Watch(on_stage)
    f = watch.write(prepared(rows), "features", "segments", "features")
    cells = watch.write(_cells(f), "cells", "fuel")
    knock = watch.write(_knock(f), "knock", "knock")
    totals = watch.write(_totals(f, altitude_ft), "totals", "lambda", "narrowband")
    tips, tip_in = _tip_in(f)
    tip_in = watch.write(tip_in, "tip-in", "tip_in")
    pe = watch.write(_pe_entry(f), "pe", "pe_entry")
    transmission = _transmission(f)
    transmission[0] = watch.write(transmission[0], "shifting", "transmission")
    if on_stage:
        watch.tell("bank_imbalance", cells.count())
        watch.tell("baro", totals.count())
    listed = first_of(tips, "tip_in", ["row_idx"], ["row_idx", "dtps", "tps_from", "tps_to", "rpm", "min_o2", "lean", "cold"]).withColumnRenamed("tip_in", "tip_in_list")
    out = _nested(_together([totals, cells, knock, tip_in, pe, listed, *transmission]))
    return watch.write(out, "report", "report")


def _nested(all_: DataFrame) -> DataFrame:
    """The structs of one log as the report that callers read; what did not happen counts 0, what could not be seen is null."""
    has = lambda *names: F.forall(F.array(*map(F.lit, names)), lambda c: F.array_contains(F.array_compact("session.channels"), c))
    none = lambda name: F.coalesce(F.col(name), F.lit(0))
    either = lambda *names: F.exists(F.array(*map(F.lit, names)), lambda c: F.array_contains(F.array_compact("session.channels"), c))
    trims = either(*X.TRIMS) & has("rpm", "map")
    n = F.col("session.row_count")
    empty = F.array()
    rows = lambda name: F.coalesce(F.col(name), empty.cast(all_.schema[name].dataType))
    fields = {
        "fuel": F.when(trims, F.struct(none("fuel.cell_count").alias("cell_count"), F.coalesce("fuel.overall_abs_trim", F.lit(0.0)).alias("overall_abs_trim"), none("fuel.total_samples").alias("total_samples"), "gating", F.col("fuel.cells").alias("cells"))),
        "knock": F.when(
            has("kr"),
            F.struct(none("knock.samples").alias("samples"), none("knock.events").alias("events"), _share(100 * none("knock.samples"), n).alias("knock_pct"), F.coalesce("knock.max_kr", F.lit(0.0)).alias("max_kr"), F.coalesce("knock.avg_kr", F.lit(0.0)).alias("avg_kr"), "raw_counts", F.col("knock.by_region").alias("by_region")),
        ),
        "lambda": F.col("lambda"),
        "narrowband": F.when(either("o2_b1", "o2_b2") & has("rpm", "map"), F.struct(none("o2.cell_count").alias("cell_count"), F.col("narrowband.bank1").alias("bank1"), F.col("narrowband.bank2").alias("bank2"), F.col("narrowband.wot").alias("wot"), F.col("o2.cells").alias("cells"))),
        "tip_in": F.when(
            has("tps", "o2_b1"),
            F.struct(*(none(f"tip_in.{c}").alias(c) for c in ("events", "warm_events", "lean_events")), *(F.coalesce(f"tip_in.{c}", F.lit(0.0)).alias(c) for c in ("lean_fraction", "warm_lean_fraction")), "tip_in.avg_min_o2", "tip_in.avg_dtps", rows("tip_in_list").alias("detail")),
        ),
        "pe_entry": F.when(has("tps", "cmd_afr"), F.struct(none("pe_entry.episodes").alias("episodes"), none("pe_entry.engaged").alias("engaged"), F.coalesce("pe_entry.engage_fraction", F.lit(0.0)).alias("engage_fraction"), "pe_entry.avg_delay_rows", "pe_entry.avg_delay_s")),
        "transmission": F.when(
            has("rpm", "vss"),
            F.struct(
                "speed.vss_unit", "speed.cruise_ratio", F.coalesce("converter_counts.source", F.lit("inferred")).alias("tcc_source"), *(none(f"shifting.{c}").alias(c) for c in ("shifts", "upshifts", "downshifts", "flared")), *(F.col(f"shifting.shift_rpm_{k}{k + 1}") for k in (1, 2, 3)),
                *(none(f"converter_counts.{c}").alias(f"tcc_{c}") for c in ("applies", "releases", "cycles")), none("kickdown_counts.kickdowns").alias("kickdowns"), none("kickdown_counts.no_shift").alias("no_kickdown"), F.col("kickdown_counts.avg_delay_s").alias("avg_kickdown_s"), none("hunting_counts.episodes").alias("hunting"),
                "gear_rows", *(none(f"shift_times.count_{p}").alias(f"pcm_count_{p}") for p in ("12", "23")), *(F.col(f"shift_times.typical_{p}").alias(f"pcm_s_{p}") for p in ("12", "23")), *(rows(c).alias(f"{c}_detail") for c in ("shift", "flared", "converter", "kickdown", "hunting", "shift_time")),
            ),
        ),
        "bank_imbalance": F.when(either("stft_b1", "ltft_b1") & either("stft_b2", "ltft_b2") & has("rpm", "map"), F.struct(none("bank_imbalance.finding_count").alias("finding_count"), F.col("bank_imbalance.findings").alias("findings"))),
        "baro": F.col("baro"),
    }
    head = [F.col(f"session.{c}").alias(c) for c in ("row_count", "regions", "missing", "altitude_ft")]
    return all_.select("log_id", F.struct(*head, *(c.alias(name) for name, c in fields.items())).alias("report"))


#: What a value of a list is to an entry of it.
Item = Callable[[Column], Column]
#: What a list is as rows.
ENTRIES = "array<struct<list:string,nth:bigint,row_idx:bigint,label:string,value:double>>"


def details(reports: DataFrame) -> DataFrame:
    """The lists of reports as rows: log_id, the list's name, the place in it, the log's row, a label and a value."""
    t, k = "report.transmission", "report"
    word = lambda c: lambda x: x[c]
    cell = lambda x: F.concat_ws("|", x["rpm_lo"], x["map_lo"])
    lists = {
        "tip_in": (f"{k}.tip_in.detail", word("row_idx"), lambda x: F.when(x["lean"], "lean").otherwise("ok"), word("dtps")),
        "shift": (f"{t}.shift_detail", word("row_idx"), word("pair"), word("flare_rpm")),
        "flared": (f"{t}.flared_detail", word("row_idx"), word("pair"), word("flare_rpm")),
        "converter": (f"{t}.converter_detail", word("row_idx"), word("type"), word("gear")),
        "kickdown": (f"{t}.kickdown_detail", word("row_idx"), lambda x: F.when(x["delay_s"].isNull(), "none").otherwise("shift"), word("delay_s")),
        "hunting": (f"{t}.hunting_detail", word("row_idx"), word("pair"), word("reversals")),
        "shift_time": (f"{t}.shift_time_detail", word("row_idx"), word("pair"), word("time_s")),
        "fuel": (f"{k}.fuel.cells", word("first_row"), cell, word("avg_trim")),
        "o2": (f"{k}.narrowband.cells", word("first_row"), cell, word("samples")),
        "imbalance": (f"{k}.bank_imbalance.findings", word("first_row"), cell, word("delta")),
    }
    # all lists of a report in one array, so that reports are made once and not once for each list
    def entries(name: str, path: str, row: Item, label: Item, value: Item) -> Column:
        made = lambda x, at: F.struct(F.lit(name).alias("list"), (at + 1).cast("long").alias("nth"), row(x).alias("row_idx"), label(x).alias("label"), value(x).cast("double").alias("value"))
        return F.coalesce(F.transform(path, made), F.array().cast(ENTRIES))

    return reports.select("log_id", F.inline(F.concat(*(entries(name, *parts) for name, parts in lists.items()))))


#: What a log must hold (rows of a region, well-sampled cells), and the weight of each channel in the score.
ENOUGH_ROWS = {"idle": 120, "cruise": 500, "wot": 30}
REGION_WEIGHTS = {"idle": 8, "cruise": 12, "wot": 20}
GOOD_CELL, ENOUGH_CELLS, CELL_WEIGHT = 20, 12, 30
CHANNEL_WEIGHTS = {"rpm": 6, "map": 6, "tps": 6, "kr": 6, "o2": 4, "ect": 2}
CHANNEL_GAPS = {"rpm": "critical", "map": "warn", "tps": "warn", "kr": "warn", "o2": "warn", "ect": "info"}
#: What to do on the next drive about a gap; gaps without a step need none of their own.
STEPS = {
    "idle": "log three minutes of warm idle with accessories off",
    "cruise": "drive twenty minutes of steady road and town traffic without hard pulls",
    "wot": "log two or three full-throttle pulls through the rev range",
    "kr": "add the knock retard channel before the next log",
    "o2": "add the voltage of at least the first oxygen sensor",
}


def coverage_figures(f: DataFrame) -> DataFrame:
    """(log_id, session, fuel) of prepared rows: all that coverage is judged by."""
    return _together([_totals(f, 0.0).select("log_id", "session"), _cells(f).select("log_id", "fuel")])


def coverage(figures: DataFrame) -> DataFrame:
    """Score, verdict, gaps and prescribed steps of each log; gaps stand in the order in which they are looked for, a step in the place where it is first called for."""
    has = lambda c: F.exists("session.channels", lambda x: F.coalesce(x.isin("o2_b1", "o2_b2") if c == "o2" else x == c, F.lit(False)))
    rows = {r: F.col(f"session.regions.{r}") for r in ENOUGH_ROWS}
    cells = F.coalesce("fuel.cells", F.array().cast(figures.schema["fuel"].dataType["cells"].dataType))
    good = F.size(F.filter(cells, lambda c: c.samples >= GOOD_CELL))
    gap = lambda when, area, severity, n: F.when(when, F.struct(F.lit(area).alias("area"), severity.alias("severity"), n.cast("long").alias("found")))
    none = F.lit(None)
    gaps = [gap(rows[r] < n, r, F.when(rows[r] == 0, F.lit({"idle": "warn", "cruise": "warn", "wot": "critical"}[r])).otherwise(F.lit({"idle": "info", "cruise": "warn", "wot": "warn"}[r])), rows[r]) for r, n in ENOUGH_ROWS.items()]
    gaps.append(gap(F.col("fuel").isNull(), "cells", F.lit("warn"), none))
    gaps.append(gap(F.col("fuel").isNotNull() & (good < ENOUGH_CELLS), "cells", F.when(good < 4, "warn").otherwise("info"), good))
    gaps += [gap(~has(c), c, F.lit(severity), none) for c, severity in CHANNEL_GAPS.items()]
    listed = figures.withColumn("gaps", F.array_compact(F.array(*gaps)))
    steps = F.array_compact(F.transform("gaps", lambda g: F.element_at(F.create_map(*(F.lit(x) for kv in STEPS.items() for x in kv)), g.area)))
    raw = sum((F.when(rows[r] >= n, REGION_WEIGHTS[r]).otherwise(0) for r, n in ENOUGH_ROWS.items()), F.lit(0)) + S.half_up_int(CELL_WEIGHT * F.least(F.lit(1.0), good / ENOUGH_CELLS)) + sum((F.when(has(c), w).otherwise(0) for c, w in CHANNEL_WEIGHTS.items()), F.lit(0))
    verdict = F.when(F.col("raw") >= 85, "excellent").when(F.col("raw") >= 60, "good").when(F.col("raw") >= 35, "thin").otherwise("poor")
    capped = F.exists("gaps", lambda g: g.severity == "critical") & (F.col("raw") >= 60)
    scored = listed.withColumn("raw", raw).withColumn("steps", F.array_distinct(steps))
    return scored.select("log_id", F.when(capped, 59).otherwise(F.col("raw")).alias("score"), F.when(capped, "thin").otherwise(verdict).alias("verdict"), "gaps", "steps")
