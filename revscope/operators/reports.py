"""Reports over features (see ``features.with_features``): one or a few rows for each log."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from revscope.functions import scalars as S
from revscope.operators import features as X
from revscope.operators import order
from revscope.operators.features import LOG, ORDER

def domain(df: DataFrame, name: str, values: list[str]) -> DataFrame:
    """Every log with every value of a fixed domain."""
    return df.select("log_id").distinct().withColumn(name, F.explode(F.array(*map(F.lit, values))))


def islands(df: DataFrame, inside: Column) -> DataFrame:
    """Rows inside a predicate, numbered by the run that they belong to; a NULL ends a run."""
    hit = F.coalesce(inside, F.lit(False))
    marked = df.withColumn("_in", hit).withColumn("run", F.col("row_idx") - F.sum(hit.cast("long")).over(ORDER()))
    return marked.where("_in").drop("_in")


def scan_log(df: DataFrame) -> DataFrame:
    missing = [F.count_if(F.col(c).isNull()).alias(f"{c}_missing") for c in ("rpm", "tps", "ect")]
    return df.groupBy("log_id").agg(F.count("*").alias("n_rows"), *missing, F.min("time_s").alias("first_s"), F.max("time_s").alias("last_s"))


def region_distribution(f: DataFrame) -> DataFrame:
    counts = f.groupBy("log_id", "region").agg(F.count("*").alias("n_rows"))
    return domain(f, "region", X.REGIONS).join(counts, ["log_id", "region"], "left").fillna(0, ["n_rows"])


def segment_breakdown(f: DataFrame) -> DataFrame:
    """Share of each segment and the mean combined trim of each bank where both its channels report."""
    styled = X.with_trim_styles(f)
    bank = {b: S.trim_counts(F.col(f"stft_b{b}"), F.col(f"stft_b{b}_style")) + S.trim_counts(F.col(f"ltft_b{b}"), F.col(f"ltft_b{b}_style")) - 128 for b in (1, 2)}
    sums = styled.groupBy("log_id", "segment").agg(F.count("*").alias("n_rows"), *(S.half_up(F.avg(c), 1).alias(f"trim_b{b}") for b, c in bank.items()))
    full = domain(f, "segment", X.SEGMENTS).join(sums, ["log_id", "segment"], "left").fillna(0, ["n_rows"])
    return full.withColumn("share_pct", S.half_up(100 * F.col("n_rows") / F.sum("n_rows").over(LOG()), 1))


def _cells(f: DataFrame) -> DataFrame:
    return X.with_cell(X.with_bank_trims(X.gated(f)))


def fuel_trim_cells(f: DataFrame) -> DataFrame:
    mean = F.avg("trim")
    spread = F.sqrt(F.greatest(F.lit(0.0), F.avg(F.col("trim") * F.col("trim")) - mean * mean))
    return _cells(f).groupBy("log_id", "rpm_lo", "map_lo").agg(
        F.count("*").alias("samples"), S.half_up(mean).alias("avg_trim"), S.half_up(spread).alias("stddev"), S.half_up(F.avg(F.col("is_idle").cast("double"))).alias("idle_fraction"), F.min("row_idx").alias("first_row")
    )


def trim_heatmap(f: DataFrame) -> DataFrame:
    """A dense grid of the long and short trims of each cell; cells of under 25 samples are thin."""
    rows = _cells(f)
    long, short = ((F.col(f"{k}_b1") + F.col(f"{k}_b2")) / 2 for k in ("ltft", "stft"))
    cells = rows.groupBy("log_id", "rpm_lo", "map_lo").agg(F.count("*").alias("samples"), S.half_up(F.avg(long)).alias("long_trim"), S.half_up(F.avg(short)).alias("short_trim"))
    span = rows.groupBy("log_id").agg(*(g(c).alias(f"{g.__name__}_{c}") for g in (F.min, F.max) for c in ("rpm_lo", "map_lo")))
    grid = span.select("log_id", F.explode(F.sequence("min_rpm_lo", "max_rpm_lo", F.lit(500))).alias("rpm_lo"), "min_map_lo", "max_map_lo")
    grid = grid.select("log_id", "rpm_lo", F.explode(F.sequence("min_map_lo", "max_map_lo", F.lit(10))).alias("map_lo"))
    return grid.join(cells, ["log_id", "rpm_lo", "map_lo"], "left").fillna(0, ["samples"]).withColumn("thin", F.col("samples") < 25)


def knock_events(f: DataFrame) -> DataFrame:
    """Runs of knock retard above half a degree, with the values at the peak and the region most rows are in."""
    scaled = X.with_kr_scale(f).withColumn("deg", F.col("kr") * F.col("scale"))
    rows = islands(scaled, F.col("deg") > 0.5)
    per_region = rows.groupBy("log_id", "run", "region").agg(F.count("*").alias("n"), F.min("row_idx").alias("first"))
    major = per_region.groupBy("log_id", "run").agg(F.max_by("region", F.struct("n", -F.col("first"))).alias("region"))
    peak = F.struct("deg", -F.col("row_idx"))
    events = rows.groupBy("log_id", "run").agg(
        F.min("row_idx").alias("start_row"),
        F.count("*").alias("samples"),
        F.max("deg").alias("peak"),
        F.sum("deg").alias("total"),
        F.max_by("rpm", peak).alias("rpm"),
        F.max_by("map", peak).alias("map"),
        (F.min_by("tps", F.when(F.col("tps").isNotNull(), F.col("row_idx"))) - F.max_by("tps", F.when(F.col("tps").isNotNull(), F.col("row_idx")))).alias("drop"),
    )
    drop = F.coalesce("drop", F.lit(0.0))
    return events.join(major, ["log_id", "run"]).select(
        "log_id", "start_row", "samples", "region", S.half_up(F.col("peak")).alias("peak_kr"), S.half_up(F.col("total") / F.col("samples")).alias("avg_kr"), "rpm", S.half_up(F.col("map")).alias("map"),
        S.half_up(drop).alias("tps_drop"), (drop > 10).alias("tip_out"), (F.col("samples") <= 1).alias("suspect_noise"), "peak", "total",
    )


def knock_by_region(f: DataFrame) -> DataFrame:
    counts = knock_events(f).groupBy("log_id", "region").agg(F.sum("samples").alias("samples"), F.count("*").alias("events"), S.half_up(F.max("peak")).alias("max_kr"))
    return domain(f, "region", X.REGIONS).join(counts, ["log_id", "region"], "left").fillna(0, ["samples", "events", "max_kr"])


def knock_summary(f: DataFrame) -> DataFrame:
    size = f.groupBy("log_id").agg(F.count("*").alias("n_rows"))
    sums = knock_events(f).groupBy("log_id").agg(F.sum("samples").alias("active"), F.count("*").alias("events"), F.max("peak").alias("top"), F.sum("total").alias("total"))
    joined = size.join(sums, "log_id", "left").fillna(0, ["active", "events", "top", "total"])
    return joined.select("log_id", "n_rows", "active", "events", S.half_up(100 * F.col("active") / F.col("n_rows")).alias("knock_pct"), S.half_up(F.col("top")).alias("max_kr"), S.half_up(F.coalesce(F.try_divide("total", "active"), F.lit(0.0))).alias("avg_kr"))


def _lambda_pairs(f: DataFrame) -> DataFrame:
    return f.withColumn("err", S.as_lambda(F.col("wb_afr")) - S.as_lambda(F.col("cmd_afr"))).where("err is not null")


def lambda_error(f: DataFrame) -> DataFrame:
    return _lambda_pairs(f).groupBy("log_id").agg(F.count("*").alias("samples"), S.half_up(F.avg(F.abs("err")), 3).alias("mean_abs_error"), S.half_up(100 * F.avg((F.abs("err") <= 0.03).cast("double"))).alias("pct_within_3"))


def lambda_by_region(f: DataFrame) -> DataFrame:
    sums = _lambda_pairs(f).groupBy("log_id", "region").agg(F.count("*").alias("samples"), S.half_up(F.avg(F.abs("err")), 3).alias("avg_abs_error"))
    return domain(f, "region", X.REGIONS).join(sums, ["log_id", "region"], "left").fillna(0, ["samples"])


def o2_cells(f: DataFrame) -> DataFrame:
    """Rich or lean bias of each cell from the mean of the banks that report."""
    banks = F.filter(F.array("o2_b1", "o2_b2"), lambda v: v.isNotNull())
    mv = F.try_divide(F.aggregate(banks, F.lit(0.0), lambda a, v: a + v), F.size(banks))
    cells = X.with_cell(X.gated(f)).withColumn("mv", mv).where("mv is not null").groupBy("log_id", "rpm_lo", "map_lo")
    sums = cells.agg(F.count("*").alias("samples"), F.avg("mv").alias("mv"), (100 * F.avg((F.col("mv") > 600).cast("double"))).alias("rich"), (100 * F.avg((F.col("mv") < 300).cast("double"))).alias("lean"))
    bias = F.when((F.col("mv") > 600) & (F.col("rich") > 60), "rich").when((F.col("mv") < 350) & (F.col("lean") > 60), "lean").otherwise("switching")
    return sums.select("log_id", "rpm_lo", "map_lo", "samples", S.half_up_int(F.col("mv")).alias("avg_mv"), S.half_up(F.col("rich")).alias("pct_rich"), S.half_up(F.col("lean")).alias("pct_lean"), bias.alias("bias"))


def _banks(f: DataFrame, keep: list[str]) -> DataFrame:
    """One row for each bank's valid sample."""
    long = f.select("log_id", "row_idx", *keep, F.explode(F.array(*(F.struct(F.lit(f"bank{b}").alias("bank"), F.col(f"o2_b{b}").alias("mv")) for b in (1, 2)))).alias("x"))
    return long.select("log_id", "row_idx", *keep, "x.bank", "x.mv").where("mv is not null")


def BANK_ORDER() -> WindowSpec:  # noqa: N802
    return Window.partitionBy("log_id", "bank").orderBy("row_idx")


def o2_cross_counts(f: DataFrame) -> DataFrame:
    rows = _banks(X.gated(f).where(F.col("region").isin("cruise", "idle")), ["time_s"]).withColumn("above", F.col("mv") > 450)
    rows = rows.withColumn("cross", F.coalesce(F.col("above") != F.lag("above").over(BANK_ORDER()), F.lit(False)))
    sums = rows.groupBy("log_id", "bank").agg(F.count("*").alias("samples"), F.count_if("cross").alias("crossings"), F.min_by("time_s", "row_idx").alias("t0"), F.max_by("time_s", "row_idx").alias("t1"))
    minutes = F.when(F.col("t1") > F.col("t0"), (F.col("t1") - F.col("t0")) / 60).otherwise(F.col("samples") / 600)
    rate = F.when(F.col("samples") > 30, S.half_up(F.col("crossings") / minutes))
    health = F.when(rate >= 30, "healthy").when(rate >= 10, "lazy").when(rate.isNotNull(), "dead/slow").otherwise("unknown")
    return sums.select("log_id", "bank", "samples", "crossings", rate.alias("per_min"), health.alias("health"))


def wot_richness(f: DataFrame) -> DataFrame:
    rows = _banks(X.gated(f).where(F.col("region") == "wot"), [])
    sums = rows.groupBy("log_id").agg(F.count("*").alias("samples"), F.avg("mv").alias("mv"), F.avg((F.col("mv") > 700).cast("double")).alias("rich"))
    enough = F.col("samples") >= 10
    status = F.when(~enough, "no wot data").when(F.col("mv") > 700, "rich").when(F.col("mv") > 550, "marginal").otherwise("lean")
    return f.select("log_id").distinct().join(sums, "log_id", "left").fillna(0, ["samples"]).select("log_id", "samples", F.when(enough, S.half_up_int(F.col("mv"))).alias("avg_mv"), F.when(enough, S.half_up(100 * F.col("rich"))).alias("pct_rich"), status.alias("status"))


def pe_episodes(f: DataFrame) -> DataFrame:
    """Runs of at least seven rows of high throttle, and where enrichment first shows in them."""
    rows = islands(f, F.col("tps") >= 60).groupBy("log_id", "run")
    engaged = S.as_lambda(F.col("cmd_afr")) < 0.95
    return rows.agg(F.min("row_idx").alias("start_row"), F.count("*").alias("samples"), F.min(F.when(engaged, F.col("row_idx"))).alias("pe_row")).where("samples >= 7").drop("run")


def pe_entry(f: DataFrame) -> DataFrame:
    delay = F.avg(F.col("pe_row") - F.col("start_row"))
    sums = pe_episodes(f).groupBy("log_id").agg(F.count("*").alias("episodes"), F.count("pe_row").alias("engaged"), delay.alias("delay"))
    full = f.select("log_id").distinct().join(sums, "log_id", "left").fillna(0, ["episodes", "engaged"])
    return full.select("log_id", "episodes", "engaged", S.half_up(F.coalesce(F.try_divide("engaged", "episodes"), F.lit(0.0))).alias("engage_fraction"), S.half_up(F.col("delay")).alias("avg_delay_rows"), S.half_up(F.col("delay") * 0.145).alias("avg_delay_s"))


def bank_imbalance(f: DataFrame) -> DataFrame:
    """Cells whose banks differ by 5 % and more; a bank's row counts unless both its channels are missing."""
    rows = X.with_cell(X.with_bank_trims(X.gated(f)))
    bank = {b: F.when(F.coalesce(f"stft_b{b}", f"ltft_b{b}").isNotNull(), F.col(f"trim_b{b}")) for b in (1, 2)}
    sums = rows.groupBy("log_id", "rpm_lo", "map_lo").agg(*(F.count(c).alias(f"n{b}") for b, c in bank.items()), *(F.avg(c).alias(f"m{b}") for b, c in bank.items()))
    delta = F.col("m1") - F.col("m2")
    return sums.where((F.col("n1") >= 15) & (F.col("n2") >= 15) & (F.abs(delta) >= 5)).select(
        "log_id", "rpm_lo", "map_lo", F.col("n1").alias("samples1"), F.col("n2").alias("samples2"), S.half_up(F.col("m1")).alias("bank1_avg"), S.half_up(F.col("m2")).alias("bank2_avg"), S.half_up(delta).alias("delta"), F.when(delta > 0, 1).otherwise(2).alias("lean_bank")
    )


def baro_check(f: DataFrame, altitude_ft: float = 900.0) -> DataFrame:
    """Is the barometer plausible for an altitude, and is any full-load manifold pressure above it?"""
    valid = F.when((F.col("baro") > 20) & (F.col("baro") < 120), F.col("baro"))
    full = (F.col("tps") >= 78) & F.col("map").isNotNull()
    sums = f.groupBy("log_id").agg(F.count(valid).alias("samples"), S.upper_median(F.collect_list(valid)).alias("mid"), F.min(valid).alias("low"), F.max(valid).alias("high"), F.count_if(full).alias("full_n"), F.max(F.when(full, F.col("map"))).alias("full_peak"))
    expected = S.baro_for_altitude(F.lit(altitude_ft))
    off = F.abs(F.col("mid") - expected)
    flag = F.coalesce((F.col("full_n") >= 10) & (F.col("full_peak") > F.col("mid") + 5), F.lit(False))
    status = F.when(off >= 5, "fault").when((off >= 3) | flag, "warn").otherwise("ok")
    enough = F.col("samples") >= 10
    return sums.select(
        "log_id", "samples", S.half_up(expected, 1).alias("expected_kpa"), F.when(enough, S.half_up(F.col("mid"), 1)).alias("median_kpa"), F.when(enough, S.half_up(F.col("mid") - expected, 1)).alias("delta_kpa"),
        F.when(enough, F.col("high") - F.col("low") >= 8).alias("drifted"), F.when(enough, flag).alias("wot_flag"), F.when(enough, status).alias("status"),
    )


def o2_health(f: DataFrame) -> DataFrame:
    """Switching rate and amplitude of each sensor, with a latch between 400 and 500 mV."""
    rows = _banks(f.where(F.col("ect").isNull() | (F.col("ect") > 160)), ["time_s"])
    side = F.when(F.col("mv") > 500, F.lit(True)).when(F.col("mv") < 400, F.lit(False))
    held = rows.withColumn("side", side).withColumn("latch", F.last("side", ignorenulls=True).over(BANK_ORDER()))
    held = held.withColumn("switch", F.coalesce(F.col("latch") != F.lag("latch").over(BANK_ORDER()), F.lit(False)))
    sums = held.groupBy("log_id", "bank").agg(
        F.count("*").alias("samples"), F.count_if("switch").alias("switches"), F.avg(F.when(F.col("mv") > 500, F.col("mv"))).alias("hi"), F.avg(F.when(F.col("mv") < 400, F.col("mv"))).alias("lo"), F.min_by("time_s", "row_idx").alias("t0"), F.max_by("time_s", "row_idx").alias("t1")
    )
    minutes = F.when(F.col("t1") > F.col("t0"), (F.col("t1") - F.col("t0")) / 60).otherwise(F.col("samples") * 0.145 / 60)
    enough = F.col("samples") >= 30
    amplitude, rate = F.coalesce(F.col("hi") - F.col("lo"), F.lit(0.0)), F.col("switches") / minutes
    return sums.select(
        "log_id", "bank", "samples", "switches", F.when(enough, S.half_up(rate)).alias("per_min"), F.when(enough, S.half_up_int(F.col("hi"))).alias("avg_high_mv"), F.when(enough, S.half_up_int(F.col("lo"))).alias("avg_low_mv"),
        F.when(enough, S.half_up_int(amplitude)).alias("amplitude_mv"), F.when(enough, (rate < 15) | (amplitude < 600)).alias("lazy"),
    )


def _cold(f: DataFrame) -> DataFrame:
    rows = f.where(~F.col("is_warm") & (F.col("region") != "transient"))
    return X.with_bank_trims(rows)


def warmup_bins(f: DataFrame) -> DataFrame:
    rows = _cold(f).where("ect is not null").withColumn("ect_lo", S.binned(F.col("ect"), 10))
    return rows.groupBy("log_id", "ect_lo").agg(F.count("*").alias("samples"), S.half_up(F.avg("trim")).alias("avg_trim"))


def warmup_slope(f: DataFrame) -> DataFrame:
    """How the cold trim moves with the coolant: slope for 10 degrees, early and late means, verdict."""
    bins = warmup_bins(f).where("samples >= 3")
    order = Window.partitionBy("log_id").orderBy("ect_lo")
    bins = bins.withColumn("nth", F.row_number().over(order)).withColumn("bins", F.count("*").over(Window.partitionBy("log_id")))
    third = F.greatest(F.lit(1), F.floor(F.col("bins") / 3))
    sums = bins.groupBy("log_id", "bins").agg(
        F.regr_slope("avg_trim", F.col("ect_lo") + 5.0).alias("slope"), F.avg(F.when(F.col("nth") <= third, F.col("avg_trim"))).alias("early"), F.max_by("avg_trim", "nth").alias("late_trim")
    )
    verdict = F.when(F.col("late_trim") > 8, "stuck-lean").when(F.col("late_trim") < -8, "stuck-rich").otherwise("decaying-sensibly")
    return sums.where("bins >= 2").select("log_id", "bins", S.half_up(F.col("slope") * 10).alias("slope_per_10"), S.half_up(F.col("early")).alias("early_trim"), "late_trim", verdict.alias("verdict"))


def overfueling(f: DataFrame) -> DataFrame:
    sums = _cold(f).groupBy("log_id").agg(F.count("*").alias("samples"), S.half_up(F.avg("trim")).alias("avg_trim"), S.half_up(F.min("trim")).alias("peak_rich"), F.avg((F.col("trim") < -8).cast("double")).alias("rich"), S.half_up(F.avg((F.abs("trim") < 0.5).cast("double"))).alias("frozen_fraction"))
    enough = F.col("samples") >= 10
    return sums.select("log_id", "samples", "avg_trim", "peak_rich", "frozen_fraction", F.when(enough, S.half_up(F.col("rich"))).alias("sustained"), (enough & (F.col("avg_trim") < -10)).alias("flagged"))


def idle_stability(f: DataFrame) -> DataFrame:
    """Is the warm idle steady, and does the air valve hold it without strain?"""
    rows = f.where(F.col("is_idle") & F.col("is_warm") & F.col("iac").isNotNull() & F.col("rpm").isNotNull())
    wish = F.when(X.channel(f, "desired_idle") > 0, X.channel(f, "desired_idle"))
    sums = rows.groupBy("log_id").agg(
        F.count("*").alias("samples"), F.avg("iac").alias("iac"), F.avg("rpm").alias("rpm"), F.sqrt(F.greatest(F.lit(0.0), F.avg(F.col("rpm") * F.col("rpm")) - F.avg("rpm") * F.avg("rpm"))).alias("sd"), F.coalesce(S.half_up_int(F.avg(wish)), F.lit(700)).alias("target_rpm")
    )
    verdict = (
        F.when(F.col("samples") < 20, "ok").when(F.col("sd") > 60, "unstable-idle").when((F.col("iac") > 70) & (F.col("rpm") < F.col("target_rpm") - 75), "throttle-misadjusted-suspect").when(F.col("iac") > 70, "vacuum-leak-suspect").otherwise("ok")
    )
    return sums.select("log_id", "samples", S.half_up(F.col("iac"), 1).alias("avg_iac"), S.half_up_int(F.col("rpm")).alias("avg_rpm"), S.half_up(F.col("sd"), 1).alias("rpm_stddev"), "target_rpm", verdict.alias("verdict"))


def _duty(f: DataFrame) -> DataFrame:
    pulse = X.channel(f, "inj_pw") * F.col("rpm") / 1200
    rows = f.withColumn("duty", F.col("inj_dc") if "inj_dc" in f.columns else pulse).where("duty >= 0")
    return rows.withColumn("duty", F.when(F.max("duty").over(LOG()) <= 1.5, F.col("duty") * 100).otherwise(F.col("duty")))


def injector_cells(f: DataFrame) -> DataFrame:
    """Cells of 400 rpm by 10 kPa where the injectors are open 80 % of the time and more."""
    rows = _duty(f).where("rpm is not null and map is not null").withColumn("rpm_lo", S.binned(F.col("rpm"), 400)).withColumn("map_lo", S.binned(F.col("map"), 10))
    return rows.groupBy("log_id", "rpm_lo", "map_lo").agg(F.count("*").alias("samples"), F.max("duty").alias("top")).where("samples >= 5 and top >= 80").select("log_id", "rpm_lo", "map_lo", "samples", S.half_up(F.col("top"), 1).alias("duty"))


def injector_headroom(f: DataFrame) -> DataFrame:
    first = F.struct("duty", -F.col("row_idx"))
    peak = _duty(f).groupBy("log_id").agg(F.count("*").alias("samples"), S.half_up(F.max("duty"), 1).alias("peak_duty"), S.half_up_int(F.max_by("rpm", first)).alias("peak_rpm"), S.half_up_int(F.max_by("map", first)).alias("peak_map"))
    over = injector_cells(f).groupBy("log_id").agg(F.count("*").alias("over_cells"), F.max("duty").alias("worst"))
    verdict = F.when(F.col("worst") >= 90, "critical").when(F.col("over_cells") > 0, "watch").otherwise("ok")
    return peak.join(over, "log_id", "left").fillna(0, ["over_cells"]).withColumn("verdict", verdict).drop("worst")


#: The range that a live channel must exceed, and the grade of a flat one.
SHOULD_MOVE = {"rpm": (5, "block"), "map": (2, "warn"), "tps": (1, "info"), "o2_b1": (30, "info"), "o2_b2": (30, "info")}
KEY_CHANNELS = ["rpm", "map", "tps", "o2_b1", "o2_b2", "ect", "spark_adv", "vss", "stft_b1", "stft_b2", "ltft_b1", "ltft_b2", "cmd_afr", "iac", "inj_dc"]


def health_issues(f: DataFrame) -> DataFrame:
    """(log_id, severity, code, channel): dropouts, flat channels, time gaps and odd sample rates. One scan."""
    channels = [c for c in KEY_CHANNELS if c in f.columns]
    spans = [x for c in channels for x in (F.count(c).alias(f"{c}_n"), (F.max(F.col(c).cast("double")) - F.min(F.col(c).cast("double"))).alias(f"{c}_range"))]
    sums = f.groupBy("log_id").agg(F.count("*").alias("n"), *spans)
    sums = sums.select("log_id", "n", F.explode(F.array(*(F.struct(F.lit(c).alias("channel"), F.col(f"{c}_n").alias("usable"), F.col(f"{c}_range").alias("range")) for c in channels))).alias("x")).select("log_id", "n", "x.*")
    # only missing values are looked at one by one, for their longest run
    gaps = f.select("log_id", "row_idx", F.explode(F.array_compact(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in channels)))).alias("channel"))
    gaps = gaps.withColumn("run", F.col("row_idx") - F.row_number().over(Window.partitionBy("log_id", "channel").orderBy("row_idx")))
    longest = gaps.groupBy("log_id", "channel", "run").agg(F.count("*").alias("length")).groupBy("log_id", "channel").agg(F.max("length").alias("longest"))
    stats = sums.join(longest, ["log_id", "channel"], "left")
    missing, key = 1 - F.col("usable") / F.col("n"), F.col("channel").isin("rpm", "map", "tps")
    dropout = (
        F.when((F.col("usable") == 0) & key, "block").when(F.col("usable") == 0, "warn").when((missing >= 0.5) & key, "block").when(missing >= 0.05, "warn").when((missing >= 0.01) | (F.col("longest") >= 10), "info")
    )
    flat = reduce(lambda e, kv: F.when((F.col("channel") == kv[0]) & (F.col("usable") >= 30) & (F.col("range") <= kv[1][0]), kv[1][1]).otherwise(e), SHOULD_MOVE.items(), F.lit(None).cast("string"))
    named = stats.select("log_id", "channel", F.explode(F.array(F.struct(F.lit("dropout").alias("code"), dropout.alias("severity")), F.struct(F.lit("flatline").alias("code"), flat.alias("severity")))).alias("x"))
    timed = f.where("time_s is not null").withColumn("step", F.col("time_s") - F.lag("time_s").over(ORDER()))
    ahead = F.collect_list(F.when(F.col("step") > 0, F.col("step")))
    steps = timed.groupBy("log_id").agg(F.count("*").alias("n"), F.count_if(F.col("step") <= 0).alias("backward"), ahead.alias("ahead"), S.upper_median(ahead).alias("mid"), (F.max_by("time_s", "row_idx") - F.min_by("time_s", "row_idx")).alias("span"))
    wide = F.filter("ahead", lambda x: (x > 3 * F.col("mid")) & (x > 0.5))
    steps = steps.withColumns({"gaps": F.nullif(F.size(wide), F.lit(0)), "widest": F.array_max(wide)}).drop("ahead")
    rate = F.col("span") / (F.col("n") - 1)
    clock = steps.select(
        "log_id",
        F.lit("time_s").alias("channel"),
        F.explode(
            F.array(
                F.struct(F.lit("clock").alias("code"), F.when(F.col("backward") > 0, "warn").alias("severity")),
                F.struct(F.lit("gap").alias("code"), F.when((F.col("gaps") >= 3) | (F.col("widest") >= 2), "warn").when(F.col("gaps") > 0, "info").alias("severity")),
                F.struct(F.lit("sample-rate").alias("code"), F.when(F.col("n") < 2, "info").when(~(F.col("span") > 0) | (rate > 0.5) | (rate < 0.05), "warn").alias("severity")),
            )
        ).alias("x"),
    )
    return named.unionByName(clock).select("log_id", "channel", "x.code", "x.severity").where("severity is not null")


def log_health(f: DataFrame) -> DataFrame:
    counts = health_issues(f).groupBy("log_id").agg(*(F.count_if(F.col("severity") == s).alias(s) for s in ("block", "warn", "info")))
    full = f.select("log_id").distinct().join(counts, "log_id", "left").fillna(0)
    score = F.greatest(F.lit(0), 100 - 40 * F.col("block") - 12 * F.col("warn") - 3 * F.col("info"))
    return full.withColumn("score", score).withColumn("blocked", F.col("block") > 0)


def coverage_score(f: DataFrame) -> DataFrame:
    """How much of what a tune needs a log covers, and how far its verdict may go."""
    regions = f.groupBy("log_id").agg(*(F.count_if(F.col("region") == r).alias(r) for r in ("idle", "cruise", "wot")))
    cells = fuel_trim_cells(f).groupBy("log_id").agg(F.count_if(F.col("samples") >= 20).alias("good_cells"), F.count("*").alias("cells"))
    has = {c: c in f.columns for c in ("rpm", "map", "tps", "kr", "ect")} | {"o2": "o2_b1" in f.columns or "o2_b2" in f.columns}
    channels = sum(w for c, w in {"rpm": 6, "map": 6, "tps": 6, "kr": 6, "o2": 4, "ect": 2}.items() if has[c])
    joined = regions.join(cells, "log_id", "left").fillna(0)
    region_score = F.when(F.col("idle") >= 120, 8).otherwise(0) + F.when(F.col("cruise") >= 500, 12).otherwise(0) + F.when(F.col("wot") >= 30, 20).otherwise(0)
    cell_score = S.half_up_int(30 * F.least(F.lit(1.0), F.col("good_cells") / 12))
    scored = joined.withColumn("raw", region_score + cell_score + channels).withColumn("critical", (F.col("wot") == 0) | F.lit(not has["rpm"]))
    verdict = F.when(F.col("raw") >= 85, "excellent").when(F.col("raw") >= 60, "good").when(F.col("raw") >= 35, "thin").otherwise("poor")
    capped = F.col("critical") & (F.col("raw") >= 60)
    return scored.select("log_id", "idle", "cruise", "wot", "good_cells", "cells", F.when(capped, 59).otherwise(F.col("raw")).alias("score"), F.when(capped, "thin").otherwise(verdict).alias("verdict"))


def with_earlier(rows: DataFrame, f: DataFrame) -> DataFrame:
    """Add to rows of logs the number of the log before, whatever gaps the numbers have."""
    return rows.join(order.with_previous(f.select("log_id").distinct(), ["log_id"], {"earlier": "log_id"}), "log_id")


def compare_cells(f: DataFrame) -> DataFrame:
    """Each session with the one before, cell by cell, on the scale where 128 is neutral: which cells came closer to it?"""
    cells = _cells(f).groupBy("log_id", "rpm_lo", "map_lo").agg(F.count("*").alias("samples"), S.half_up(128 + F.avg("trim") * 1.28).alias("trim"))
    side = lambda df, n: df.select("log_id", "rpm_lo", "map_lo", F.col("samples").alias(f"samples_{n}"), F.col("trim").alias(f"trim_{n}"))
    # the cells of a log are "a" of the log behind it and "b" of its own
    follows = with_earlier(f.select("log_id").distinct(), f).where("earlier is not null")
    old = side(cells.withColumnRenamed("log_id", "earlier").join(follows, "earlier"), "a")
    both = old.join(side(cells.join(follows.select("log_id"), "log_id"), "b"), ["log_id", "rpm_lo", "map_lo"], "full_outer")
    delta = F.col("trim_b") - F.col("trim_a")
    verdict = (
        F.when(delta.isNull(), "single").when(F.abs(delta) < 1, "unchanged").when(F.abs(F.col("trim_b") - 128) < F.abs(F.col("trim_a") - 128), "improved").otherwise("worse")
    )
    return both.withColumn("delta", S.half_up(delta)).withColumn("verdict", verdict)


def session_metrics(f: DataFrame) -> DataFrame:
    """A few figures of each session next to those of the session before."""
    fuel = _cells(f).groupBy("log_id").agg(S.half_up(F.avg(F.abs("trim"))).alias("abs_trim"))
    figures = knock_summary(f).select("log_id", "knock_pct", "max_kr").join(fuel, "log_id", "left").join(lambda_error(f).select("log_id", "mean_abs_error"), "log_id", "left").join(coverage_score(f).select("log_id", F.col("score").alias("coverage")), "log_id")
    names = ["knock_pct", "max_kr", "abs_trim", "mean_abs_error", "coverage"]
    return order.with_previous(figures, ["log_id"], {f"prev_{c}": c for c in names})


def report_card(f: DataFrame) -> DataFrame:
    trims = _cells(f).groupBy("log_id").agg(S.half_up(F.avg("trim")).alias("mean_trim"))
    o2 = f.groupBy("log_id").agg(S.half_up(F.max("time_s") - F.min("time_s"), 1).alias("duration_s"), S.half_up_int(F.avg("o2_b1")).alias("o2_b1_mv"), S.half_up_int(F.avg("o2_b2")).alias("o2_b2_mv"))
    return o2.join(trims, "log_id", "left").join(knock_summary(f).select("log_id", "events", "max_kr"), "log_id")


def convergence(cells: DataFrame, patches: DataFrame, follows: DataFrame) -> DataFrame:
    """Did patched cells come closer to zero trim in the log behind?

    Patches are (log_id, kind, table_name, rpm_lo, map_lo, delta), one or more for
    a cell; only those of kind fuel can be judged by trims, others are named as
    such. Needs the cells of all sessions and, for each session, the one before it
    (log_id, earlier). Rows carry the number of the later session.
    """
    key = ["log_id", "rpm_lo", "map_lo"]
    sums = patches.groupBy("kind", "table_name", *key).agg(F.count("*").alias("patches"), F.sum("delta").alias("delta"))
    side = lambda df, n: df.select(*key, F.col("avg_trim").alias(f"trim_{n}"), F.col("samples").alias(f"samples_{n}"))
    behind = follows.where("earlier is not null").select("earlier", F.col("log_id").alias("later"))
    joined = sums.join(side(cells, "before"), key, "left").join(behind.withColumnRenamed("earlier", "log_id"), "log_id").drop("log_id").withColumnRenamed("later", "log_id")
    joined = joined.join(side(cells, "after"), key, "left")
    fuel = F.col("kind") == "fuel"
    b, a = F.col("trim_before"), F.col("trim_after")
    gain = F.abs(b) - F.abs(a)
    flipped = (b * a) < 0
    detail = (
        F.when(~fuel, "not-judged-by-trims").when(b.isNull() | a.isNull() | (F.col("samples_after") < 20), "inconclusive").when(flipped & (F.abs(a) < 3), "crossed").when(flipped, "overshot").when(gain >= 3, "closer").when(gain <= -3, "further").otherwise("unmoved")
    )
    verdict = F.when(detail.isin("inconclusive", "not-judged-by-trims"), "inconclusive").when(detail.isin("crossed", "closer"), "converged").otherwise("not-converged")
    return joined.withColumn("improvement", F.when(fuel, S.half_up(gain))).withColumn("detail", detail).withColumn("verdict", verdict)
