"""Time-series events: shifts, converter lock-up, kickdown, tip-in, cranking, and what is built on them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revscope.cluster import staged
from revscope.functions import scalars as S
from revscope.operators import features as X
from revscope.operators import folds
from revscope.operators import reports as R
from revscope.operators.features import ORDER

SAMPLE_S = 0.145
GEAR_ROWS = "log_id long, row_idx long, rpm double, tps double, vss double, mph double, ratio double"


def gears(f: DataFrame) -> DataFrame:
    """The confirmed gear of every row (0: none)."""
    extra = ["tcc"] if "tcc" in f.columns else []
    rows = X.with_gears(f).select("log_id", "row_idx", "rpm", "tps", "vss", "mph", "ratio", *extra, F.coalesce("near_gear", F.lit(0)).alias("gear"), F.col("ratio").isNotNull().alias("valid"))

    def fold(logs: pd.DataFrame) -> pd.DataFrame:
        return logs.assign(gear=folds.each_log(logs, folds.debounced_gears, "valid", "gear")).drop(columns="valid")

    schema = ", ".join([GEAR_ROWS, *(f"{c} {f.schema[c].dataType.simpleString()}" for c in extra), "gear int"])
    return folds.per_log(rows, fold, schema)


def shifts(g: DataFrame) -> DataFrame:
    """Gear changes against four rows before, at most one in 15 rows, with their flare."""
    rows = g.withColumn("from_gear", F.lag("gear", 4).over(ORDER())).withColumn("rpm_at", F.max("rpm").over(ORDER().rowsBetween(-12, -6))).withColumn("rpm_peak", F.max("rpm").over(ORDER().rowsBetween(-4, 0)))
    hits = rows.where((F.col("row_idx") >= 5) & (F.col("from_gear") > 0) & (F.col("gear") > 0) & (F.col("gear") != F.col("from_gear")))
    flare = F.coalesce(F.greatest(F.col("rpm_peak") - F.col("rpm_at"), F.lit(0.0)), F.lit(0.0))
    named = hits.select(
        "log_id", "row_idx", F.col("from_gear").cast("int").alias("from_gear"), F.col("gear").alias("to_gear"), "rpm_at", S.half_up(F.col("mph")).alias("mph"), "tps", S.half_up_int(flare).alias("flare_rpm"), ((F.col("gear") > F.col("from_gear")) & (flare >= 150)).alias("flared")
    )
    return folds.keep_spaced(named, 15)


def _frame(first: int, last: int) -> Column:
    """The ratios of a span of rows back from each, as an array; by offsets, as lists that slide are filled anew for every row."""
    return F.array(*(F.lag("ratio", back).over(ORDER()) if back else F.col("ratio") for back in range(first, last - 1, -1)))


def converter_events(g: DataFrame) -> DataFrame:
    """Lock and unlock of the converter: a step of the ratio inside a constant high gear."""
    rows = g.withColumns({"before": _frame(16, 9), "after": _frame(8, 0), "gear_before": F.lag("gear", 16).over(ORDER())})
    rows = rows.withColumns({f"n_{side}": F.size(F.array_compact(side)) for side in ("before", "after")})
    before, after = (S.upper_median(F.array_compact(side)) for side in ("before", "after"))
    step = (before - after) / before
    kind = F.when(step > 0.06, "apply").when(step < -0.06, "release")
    hits = rows.where(
        (F.col("gear") >= 3) & (F.col("gear") == F.col("gear_before")) & (F.col("tps").isNull() | (F.col("tps") <= 45)) & (F.col("mph") >= 30) & (F.col("n_before") >= 5) & (F.col("n_after") >= 5)
    ).select("log_id", "row_idx", kind.alias("type"), "gear")

    def fold(logs: pd.DataFrame) -> pd.DataFrame:
        return logs[folds.each_log(logs, lambda at, kinds: folds.alternating(at, kinds, 40), "row_idx", "type")]

    return folds.per_log(hits.where("type is not null"), fold, "log_id long, row_idx long, type string, gear int")


def channel_locked(f: DataFrame, name: str = "tcc") -> Column:
    """Whether the converter channel says that it is locked: a duty of over 50, or a state in words. NULL where it says nothing."""
    c = F.col(name)
    if f.schema[name].dataType.simpleString() == "string":
        return F.when(F.trim(c) != "", c.rlike("(?i)on|lock|engag"))
    return F.when(c.isNotNull() & ~F.isnan(c.cast("double")), c > 50)


#: Rows with a value from which on a log's converter channel is believed.
CHANNEL_ROWS = 11


def channel_converter_events(g: DataFrame, name: str = "tcc") -> DataFrame:
    """Lock and unlock as the converter channel states them, with the gear of the row; logs with few values have none."""
    rows = g.withColumn("locked", channel_locked(g, name)).where("locked is not null")
    rows = rows.withColumn("before", F.lag("locked").over(ORDER())).withColumn("seen", F.count("*").over(X.LOG()))
    hits = rows.where((F.col("seen") >= CHANNEL_ROWS) & (F.col("locked") != F.col("before")))
    return hits.select("log_id", "row_idx", F.when(F.col("locked"), "apply").otherwise("release").alias("type"), F.when(F.col("gear") > 0, F.col("gear")).alias("gear"))


def best_converter_events(g: DataFrame, name: str = "tcc") -> DataFrame:
    """The channel's events of logs that carry it, the inferred ones of all others; ``source`` says which."""
    if name not in g.columns:
        return converter_events(g).withColumn("source", F.lit("inferred"))
    stated = channel_locked(g, name)
    believed = g.groupBy("log_id").agg(F.count(stated).alias("seen")).where(F.col("seen") >= CHANNEL_ROWS).select("log_id")
    inferred = converter_events(g.join(believed, "log_id", "left_anti")).withColumn("source", F.lit("inferred"))
    return inferred.unionByName(channel_converter_events(g, name).withColumn("source", F.lit("channel")))


def converter_cycles(events: DataFrame) -> DataFrame:
    """How often a lock follows an unlock, or the other way, within 300 rows."""
    near = events.withColumn("cycle", F.coalesce((F.col("row_idx") - F.lag("row_idx").over(ORDER()) < 300) & (F.col("type") != F.lag("type").over(ORDER())), F.lit(False)))
    return near.groupBy("log_id").agg(F.count_if(F.col("type") == "apply").alias("tcc_applies"), F.count_if(F.col("type") == "release").alias("tcc_releases"), F.count_if("cycle").alias("tcc_cycles"))


def kickdowns(f: DataFrame, s: DataFrame) -> DataFrame:
    """Throttle stabs and the first downshift within 20 rows of each."""
    stabs = X.with_mph(f).where((F.col("tps") - F.col("prev_tps") >= 20) & (F.col("tps") >= 40))
    down = s.where("to_gear < from_gear").select("log_id", F.col("row_idx").alias("down_row"))
    # the window spans two neighbouring blocks of 20 rows, so the range becomes an equality
    block = F.floor(F.col("row_idx") / 20)
    keyed = stabs.withColumn("block", F.explode(F.array(block, block + 1)))
    hits = keyed.join(down.withColumn("block", F.floor(F.col("down_row") / 20)), ["log_id", "block"]).where(F.col("down_row").between(F.col("row_idx"), F.col("row_idx") + 20))
    first = hits.groupBy("log_id", "row_idx").agg(F.min("down_row").alias("down_row"))
    return stabs.join(first, ["log_id", "row_idx"], "left").select(
        "log_id", "row_idx", S.half_up(F.col("prev_tps")).alias("tps_from"), S.half_up(F.col("tps")).alias("tps_to"), S.half_up(F.col("vss") * F.col("to_mph")).alias("mph"), "down_row", S.half_up((F.col("down_row") - F.col("row_idx")) * SAMPLE_S).alias("delay_s")
    )


def hunting(s: DataFrame) -> DataFrame:
    """Episodes of shuffling between one pair of gears."""

    def fold(logs: pd.DataFrame) -> pd.DataFrame:
        a, b = logs["from_gear"].to_numpy(), logs["to_gear"].to_numpy()
        arrays = (logs["row_idx"].to_numpy(), np.minimum(a, b), np.maximum(a, b), b > a, logs["tps"].to_numpy(dtype=float, na_value=np.nan))
        found = [(begin + i, n) for begin, end in folds.log_spans(logs) for i, n in folds.hunting_episodes(*(x[begin:end] for x in arrays))]
        at = [i for i, _ in found]
        return logs.iloc[at][["log_id", "row_idx", "from_gear", "to_gear", "mph", "tps"]].assign(reversals=[n + 1 for _, n in found])

    return folds.per_log(s, fold, "log_id long, row_idx long, from_gear int, to_gear int, mph double, tps double, reversals int")


def shift_times(f: DataFrame) -> DataFrame:
    """Changes of the shift times that the controller measured; the first reading is no change."""
    out = None
    for pair, name in (("1-2", "shift_t12"), ("2-3", "shift_t23")):
        if name not in f.columns:
            continue
        prev = F.lag(name).over(ORDER())
        rows = f.select("log_id", "row_idx", F.lit(pair).alias("pair"), F.col(name).alias("v"), prev.alias("prev")).where((F.col("v") > 0) & (F.abs(F.col("v") - F.col("prev")) > 0.005))
        rows = rows.select("log_id", "row_idx", "pair", S.half_up(F.col("v"), 3).alias("time_s"))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return f.sparkSession.createDataFrame([], "log_id long, row_idx long, pair string, time_s double")
    return out


#: The median time from which a shift counts as slow.
SLOW_S = {"1-2": 0.90, "2-3": 0.60, "3-4": 0.90}


def shift_histograms(times: DataFrame, s: DataFrame) -> DataFrame:
    """Per pair the spread of measured times, and how many lie within 40 rows of a flared shift."""
    flared = s.where("flared").select("log_id", F.concat_ws("-", "from_gear", "to_gear").alias("pair"), F.col("row_idx").alias("flare_row"))
    block = F.floor(F.col("row_idx") / 40)
    keyed = times.withColumn("block", F.explode(F.array(block - 1, block, block + 1)))
    near = keyed.join(flared.withColumn("block", F.floor(F.col("flare_row") / 40)), ["log_id", "pair", "block"]).where(F.abs(F.col("row_idx") - F.col("flare_row")) <= 40).select("log_id", "pair", "row_idx").distinct()
    marked = times.join(near.withColumn("linked", F.lit(1)), ["log_id", "pair", "row_idx"], "left")
    sums = marked.groupBy("log_id", "pair").agg(F.count("*").alias("count"), S.half_up(S.true_median(F.collect_list("time_s")), 4).alias("median_s"), F.min("time_s").alias("min_s"), F.max("time_s").alias("max_s"), F.count("linked").alias("near_flare"))
    flares = flared.groupBy("log_id", "pair").agg(F.count("*").alias("flares"))
    slow = F.lit(None).cast("double")
    for pair, limit in SLOW_S.items():
        slow = F.when(F.col("pair") == pair, limit).otherwise(slow)
    return sums.join(flares, ["log_id", "pair"], "left").fillna(0, ["flares"]).withColumn("slow", F.coalesce(F.col("median_s") > slow, F.lit(False)))


def shift_time_bins(times: DataFrame, bins: int = 8) -> DataFrame:
    """A histogram of fixed bins between the shortest and longest time of each pair."""
    w = Window.partitionBy("log_id", "pair")
    ranged = times.withColumn("lo", F.min("time_s").over(w)).withColumn("hi", F.max("time_s").over(w))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(width == 0, 0).otherwise(F.least(F.floor((F.col("time_s") - F.col("lo")) / width), F.lit(bins - 1)))
    return ranged.groupBy("log_id", "pair", at.cast("int").alias("bin")).agg(F.count("*").alias("count"))


def gear_histogram(g: DataFrame) -> DataFrame:
    return g.where("gear > 0").groupBy("log_id", "gear").agg(F.count("*").alias("n_rows"))


def transmission(f: DataFrame) -> DataFrame:
    """Counts of everything the transmission did, mean shift speeds, and where the worst of it happened.

    Gears are folded once and written to the shared folder, as five reports read them.
    """
    g = staged(gears(f), "gears")
    s = staged(shifts(g), "shifts")
    up = F.col("to_gear") > F.col("from_gear")
    means = [S.half_up_int(F.avg(F.when((F.col("from_gear") == k) & (F.col("to_gear") == k + 1), F.col("rpm_at")))).alias(f"shift_rpm_{k}{k + 1}") for k in (1, 2, 3)]
    worst = F.max_by("mph", F.when(F.col("flared"), F.struct("flare_rpm", -F.col("row_idx")))).alias("worst_flare_mph")
    counts = s.groupBy("log_id").agg(F.count("*").alias("shifts"), F.count_if(up).alias("upshifts"), F.count_if(F.col("to_gear") < F.col("from_gear")).alias("downshifts"), F.count_if("flared").alias("flared"), *means, worst)
    kicks = kickdowns(f, s).groupBy("log_id").agg(F.count("*").alias("kickdowns"), F.count_if(F.col("down_row").isNull()).alias("no_kickdown"), S.half_up(F.avg("delay_s")).alias("avg_kickdown_s"), S.upper_median(F.collect_list("mph")).alias("kickdown_mph"))
    pair = F.concat_ws("-", F.least("from_gear", "to_gear"), F.greatest("from_gear", "to_gear"))
    hunts = hunting(s).groupBy("log_id").agg(F.count("*").alias("hunting"), F.min_by("tps", "row_idx").alias("hunting_tps"), F.min_by(pair, "row_idx").alias("hunting_pair"))
    times = shift_times(f).groupBy("log_id").agg(*(S.upper_median(F.collect_list(F.when(F.col("pair") == p, F.col("time_s")))).alias(f"pcm_s_{p[0]}{p[2]}") for p in ("1-2", "2-3")))
    out = f.select("log_id").distinct()
    for part in (counts, kicks, converter_cycles(best_converter_events(g)), hunts, times):
        out = out.join(part, "log_id", "left")
    return out.fillna(0, ["shifts", "upshifts", "downshifts", "flared", "kickdowns", "no_kickdown", "tcc_applies", "tcc_releases", "tcc_cycles", "hunting"])


def tip_ins(f: DataFrame) -> DataFrame:
    """Throttle stabs that hold, at most one in 20 rows, and how lean the sensor went after each."""
    ahead = F.collect_list("tps").over(ORDER().rowsBetween(1, 5))
    rows = f.withColumn("ahead", ahead).withColumn("min_o2", F.min("o2_b1").over(ORDER().rowsBetween(0, 7))).withColumn("o2_before", F.avg("o2_b1").over(ORDER().rowsBetween(-5, -1)))
    held = F.size(F.filter("ahead", lambda t: t >= F.col("prev_tps") + 5)) >= 3
    hits = rows.where((F.col("tps") - F.col("prev_tps") >= 10) & held)
    named = hits.select(
        "log_id", "row_idx", S.half_up(F.col("tps") - F.col("prev_tps")).alias("dtps"), S.half_up(F.col("prev_tps")).alias("tps_from"), S.half_up(F.col("tps")).alias("tps_to"), "rpm",
        S.half_up_int(F.col("min_o2")).alias("min_o2"), F.coalesce(F.col("min_o2") < 250, F.lit(False)).alias("lean"), F.coalesce(F.col("ect") < F.col("warm_at"), F.lit(False)).alias("cold"), "o2_before",
    )
    return folds.keep_spaced(named, 20)


def tip_in_summary(f: DataFrame, events: DataFrame) -> DataFrame:
    share = lambda a, b: S.half_up(F.coalesce(F.try_divide(a, b), F.lit(0.0)))
    sums = events.groupBy("log_id").agg(F.count("*").alias("events"), F.count_if(~F.col("cold")).alias("warm_events"), F.count_if("lean").alias("lean_events"), F.count_if(F.col("lean") & ~F.col("cold")).alias("warm_lean"), S.half_up_int(F.avg(F.when(F.col("lean"), F.col("min_o2")))).alias("avg_min_o2"), S.half_up_int(S.mean_from_last(F.col("dtps"), F.col("row_idx"))).alias("avg_dtps"))
    full = f.select("log_id").distinct().join(sums, "log_id", "left").fillna(0, ["events", "warm_events", "lean_events", "warm_lean"])
    return full.withColumn("lean_fraction", share(F.col("lean_events"), F.col("events"))).withColumn("warm_lean_fraction", share(F.col("warm_lean"), F.col("warm_events"))).drop("warm_lean")


def ae_scatter(events: DataFrame) -> DataFrame:
    """How fast the throttle opened against how deep the sensor dipped below its mean before."""
    depth = F.greatest(F.lit(0), S.half_up_int(F.col("o2_before") - F.col("min_o2")))
    rows = events.where("o2_before is not null and min_o2 is not null")
    return rows.select("log_id", "row_idx", S.half_up(F.col("dtps") / SAMPLE_S, 1).alias("tps_per_s"), depth.alias("lean_depth_mv"), "lean")


def ae_trend(points: DataFrame) -> DataFrame:
    r = F.corr("tps_per_s", "lean_depth_mv")
    sums = points.groupBy("log_id").agg(F.count("*").alias("points"), F.count_if("lean").alias("lean_points"), S.half_up(r, 4).alias("r"))
    return sums.withColumn("trend", F.when(F.col("r") >= 0.3, "deeper").when(F.col("r") <= -0.3, "shallower").otherwise("none"))


def cranks(f: DataFrame) -> DataFrame:
    """Starter runs over consecutive cold rows, with the flare and the trim after the start."""
    cold = f.where(~F.col("is_warm") & (F.col("region") != "transient"))
    runs = R.islands(cold, (F.col("rpm") > 0) & (F.col("rpm") <= 450)).groupBy("log_id", "run").agg(F.min("row_idx").alias("start_row"), F.max("row_idx").alias("end_row"), F.count("*").alias("samples"), F.min_by("time_s", "row_idx").alias("t0"), F.max_by("time_s", "row_idx").alias("t1"))
    caught = f.where("rpm > 400").select("log_id", F.col("row_idx").alias("go_row"), F.col("time_s").alias("go_s"))
    block = F.floor(F.col("end_row") / 200)
    near = runs.withColumn("block", F.explode(F.array(block, block + 1))).join(caught.withColumn("block", F.floor(F.col("go_row") / 200)), ["log_id", "block"])
    first = near.where(F.col("go_row").between(F.col("end_row") + 1, F.col("end_row") + 200)).groupBy("log_id", "run").agg(F.min_by("go_row", "go_row").alias("go_row"), F.min_by("go_s", "go_row").alias("go_s"))
    trims = X.with_bank_trims(f).select("log_id", F.col("row_idx").alias("row"), F.col("rpm").alias("rpm"), F.col("time_s").alias("at_s"), "trim")
    # half a minute is at most so many blocks of time: the range becomes an equality
    blocks = F.floor(F.col("go_s") / 30)
    after = first.withColumn("block", F.explode(F.array(blocks, blocks + 1))).join(trims.withColumn("block", F.floor(F.col("at_s") / 30)), ["log_id", "block"])
    after = after.where((F.col("row") >= F.col("go_row")) & (F.col("at_s") >= F.col("go_s")) & (F.col("at_s") - F.col("go_s") <= 30)).withColumn("dt", F.col("at_s") - F.col("go_s"))
    sums = after.groupBy("log_id", "run").agg(F.max(F.when(F.col("dt") <= 3, F.col("rpm"))).alias("top"), S.true_median(F.collect_list(F.when(F.col("dt") >= 10, F.col("rpm")))).alias("settled"), S.half_up(F.avg(F.when(F.col("dt") <= 20, F.col("trim")))).alias("trim_after"))
    out = runs.join(sums, ["log_id", "run"], "left")
    return out.select("log_id", "start_row", "samples", S.half_up(F.greatest(F.col("t1") - F.col("t0"), F.lit(0.0))).alias("duration_s"), S.half_up_int(F.col("top") - F.col("settled")).alias("rpm_flare"), "trim_after", F.col("top").isNotNull().alias("started"))


def crank_verdict(f: DataFrame) -> DataFrame:
    sums = cranks(f).groupBy("log_id").agg(F.count("*").alias("cranks"), F.bool_or(F.col("started") & (F.col("duration_s") > 3)).alias("long"), F.bool_or(F.col("started") & (F.col("rpm_flare") < 200)).alias("weak"))
    verdict = F.when(F.col("cranks") == 0, "no-crank-detected").when(F.col("long"), "long-crank").when(F.col("weak"), "weak-flare").otherwise("healthy")
    return f.select("log_id").distinct().join(sums, "log_id", "left").fillna(0, ["cranks"]).select("log_id", "cranks", verdict.alias("verdict"))


def playback_ticks(f: DataFrame) -> DataFrame:
    """Knock, tip-in and enrichment events on one line, in the order of their rows."""
    parts = [
        R.knock_events(f).select("log_id", F.col("start_row").alias("row_idx"), F.lit(0).alias("rank"), F.lit("knock").alias("type"), F.col("samples").alias("samples")),
        tip_ins(f).select("log_id", "row_idx", F.lit(1).alias("rank"), F.lit("tipin").alias("type"), F.lit(1).cast("long").alias("samples")),
        R.pe_episodes(f).select("log_id", F.col("start_row").alias("row_idx"), F.lit(2).alias("rank"), F.lit("pe").alias("type"), "samples"),
    ]
    ticks = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return ticks.withColumn("nth", F.row_number().over(Window.partitionBy("log_id").orderBy("row_idx", "rank"))).drop("rank")


def trailing(f: DataFrame, name: str, rows: int = 50) -> DataFrame:
    """Minimum, maximum and last valid value of a channel over the trailing rows."""
    w = ORDER().rowsBetween(-rows + 1, 0)
    return f.select("log_id", "row_idx", F.min(name).over(w).alias("low"), F.max(name).over(w).alias("high"), F.last(name, ignorenulls=True).over(w).alias("latest"))


def around_events(f: DataFrame, events: DataFrame, half: int = 50) -> DataFrame:
    """The rows around each event (log_id, start_row), joined by blocks of rows instead of a bare range."""
    width = 2 * half
    block = F.floor(F.col("start_row") / width)
    keyed = events.select("log_id", "start_row").withColumn("block", F.explode(F.array(block - 1, block, block + 1)))
    rows = f.withColumn("block", F.floor(F.col("row_idx") / width))
    near = keyed.join(rows, ["log_id", "block"]).where(F.abs(F.col("row_idx") - F.col("start_row")) <= half)
    return near.select("log_id", "start_row", "row_idx", (F.col("row_idx") - F.col("start_row")).alias("at"), "rpm", "map", "tps", "kr")


def filled_time(f: DataFrame) -> DataFrame:
    """Time with gaps filled forward; the row number where under nine tenths of the log are timed."""
    w = Window.partitionBy("log_id")
    timed = F.count("time_s").over(w) >= 0.9 * F.count("*").over(w)
    return f.select("log_id", "row_idx", F.when(timed, F.last("time_s", ignorenulls=True).over(ORDER().rowsBetween(Window.unboundedPreceding, 0))).otherwise(F.col("row_idx").cast("double")).alias("play_s"))


def spike_downsample(f: DataFrame, name: str, points: int = 200) -> DataFrame:
    """The lowest and highest row of each bucket, so that no spike is lost."""
    w = Window.partitionBy("log_id")
    size = F.ceil(F.count("*").over(w) / max(1, points // 2))
    rows = f.select("log_id", "row_idx", F.col(name).alias("v"), F.floor(F.col("row_idx") / size).alias("bucket")).where("v is not null")
    low, high = F.min(F.struct("v", "row_idx")), F.min(F.struct((-F.col("v")).alias("v"), "row_idx"))
    ends = rows.groupBy("log_id", "bucket").agg(low.alias("low"), high.alias("high"))
    both = ends.select("log_id", "bucket", F.explode(F.array_distinct(F.array(F.struct(F.col("low.row_idx").alias("i"), F.col("low.v").alias("v")), F.struct(F.col("high.row_idx").alias("i"), (-F.col("high.v")).alias("v"))))).alias("x"))
    return both.select("log_id", F.col("x.i").alias("row_idx"), F.col("x.v").alias("v"))


def stride_sample(f: DataFrame, name: str, points: int = 120) -> DataFrame:
    """Every k-th row, k chosen so that about ``points`` rows of each log stay."""
    step = F.greatest(F.lit(1), F.ceil(F.count("*").over(Window.partitionBy("log_id")) / points))
    return f.withColumn("step", step).where(F.col("row_idx") % F.col("step") == 0).select("log_id", "row_idx", F.col(name).alias("v"))


def as_of(f: DataFrame, probes: DataFrame) -> DataFrame:
    """Backward as-of: for each (log_id, at_s) the last row with time_s <= at_s. One union, one window, no range join."""
    rows = f.select("log_id", F.col("time_s").alias("at_s"), F.lit(0).alias("side"), F.struct("row_idx", "rpm").alias("hit"))
    asked = probes.select("log_id", "at_s", F.lit(1).alias("side"), F.lit(None).cast(rows.schema["hit"].dataType).alias("hit"))
    w = Window.partitionBy("log_id").orderBy("at_s", "side").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.unionByName(asked).withColumn("hit", F.last("hit", ignorenulls=True).over(w))
    return found.where("side = 1").select("log_id", "at_s", "hit.row_idx", "hit.rpm")


def commanded_afr(f: DataFrame, table: list[tuple[float, float]], tolerance: float = 0.3) -> DataFrame:
    """Each enrichment episode's mean commanded AFR against the nearest cell (rpm, afr) of the enrichment table."""
    engaged = (F.col("tps") >= 60) & (S.as_lambda(F.col("cmd_afr")) < 0.95)
    rows = R.islands(f, F.col("tps") >= 60).where(engaged)
    afr = F.when(F.col("cmd_afr") > 5, F.col("cmd_afr")).otherwise(F.col("cmd_afr") * S.STOICH_AFR)
    means = rows.groupBy("log_id", "run").agg(F.min("row_idx").alias("start_row"), F.count("*").alias("samples"), F.avg(afr).alias("afr"), F.avg("rpm").alias("rpm"), F.avg("tps").alias("tps"), F.avg("map").alias("map"))
    axis = F.array(*(F.lit(float(r)) for r, _ in table))
    wanted = F.try_element_at(F.array(*(F.lit(float(a)) for _, a in table)), (S.nearest_place(axis, F.col("rpm")) + 1).cast("int"))
    return means.select("log_id", "start_row", "samples", S.half_up(F.col("afr")).alias("afr"), S.half_up_int(F.col("rpm")).alias("rpm"), wanted.alias("table_afr"), S.half_up(F.col("afr") - wanted).alias("error"), (F.abs(F.col("afr") - wanted) <= tolerance).alias("matches"))
