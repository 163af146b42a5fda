"""Per-row features of drive logs: region, segment, idle, warm, gear ratio."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from revscope.functions import scalars as S


def LOG() -> WindowSpec:  # noqa: N802 - windows need a session, so they are made when asked for
    return Window.partitionBy("log_id")


def ORDER() -> WindowSpec:  # noqa: N802
    return LOG().orderBy("row_idx")


def WHOLE() -> WindowSpec:  # noqa: N802
    """A log as LOG says it, in the window that ORDER needs anyway."""
    return ORDER().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def HEAD() -> WindowSpec:  # noqa: N802
    return ORDER().rowsBetween(Window.unboundedPreceding, 0)


REGIONS = ["cruise", "transient", "wot", "idle"]
SEGMENTS = ["idle", "cruise", "wot", "decel", "other"]
TRIMS = ["stft_b1", "ltft_b1", "stft_b2", "ltft_b2"]
#: How many of a log's first values tell a trim channel's encoding.
STYLE_SAMPLE = 500
KR_SAMPLE = 2000


def channel(df: DataFrame, name: str) -> Column:
    """A channel, or NULL where the log has none."""
    return F.col(name) if name in df.columns else F.lit(None).cast("double")


def with_upper_medians(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Add to every row the upper median of each value over the row's log; a window, so nothing is joined."""
    marked = df.withColumns({f"_of_{name}": v for name, v in values.items()})
    middles = {name: F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY _of_{name} DESC) OVER (PARTITION BY log_id)") for name in values}
    return marked.withColumns(middles).drop(*(f"_of_{name}" for name in values))


def steady_ratio(df: DataFrame, prev_vss: Column | None = None) -> Column:
    """Engine speed over road speed in steady cruise; ``prev_vss`` where the speed before is known."""
    rpm, vss, tps = F.col("rpm"), F.col("vss"), channel(df, "tps")
    prev_vss = F.lag("vss").over(ORDER()) if prev_vss is None else prev_vss
    step = F.coalesce(F.abs(vss - prev_vss), F.lit(99.0))
    steady = (vss >= 5) & (tps.isNull() | tps.between(8, 35)) & (step < 1.5) & (rpm > 1200) & (rpm < 2800)
    return F.when(steady, rpm / vss)


def with_mph(df: DataFrame) -> DataFrame:
    """Add cruise_ratio, to_mph and mph; a log's road speed is in km/h where its cruise ratio says so."""
    if "to_mph" in df.columns:
        return df
    middle = with_upper_medians(df.withColumn("_steady", steady_ratio(df)), {"cruise_ratio": F.col("_steady")}).drop("_steady")
    return with_speed(middle)


def with_speed(df: DataFrame) -> DataFrame:
    """Add to_mph and mph to rows that know their log's cruise_ratio."""
    scaled = df.withColumn("to_mph", F.when(F.col("cruise_ratio") < 25, S.KPH_TO_MPH).otherwise(1.0))
    return scaled.withColumn("mph", F.col("vss") * F.col("to_mph"))


def vss_units(df: DataFrame) -> DataFrame:
    """Per log the upper median of RPM over road speed in steady cruise, and the factor that makes the speed mph."""
    rows = df.select("log_id", steady_ratio(df).alias("ratio"))
    return (
        rows.groupBy("log_id")
        .agg(S.upper_median(F.collect_list("ratio")).alias("cruise_ratio"))
        .withColumn("to_mph", F.when(F.col("cruise_ratio") < 25, S.KPH_TO_MPH).otherwise(1.0))
        .withColumn("unit", F.when(F.col("cruise_ratio") < 25, "kph->mph").otherwise("mph"))
    )


def feature_windows(df: DataFrame) -> dict[str, Column]:
    """What the features of a row take from other rows of its log."""
    return {"prev_tps": F.lag(channel(df, "tps")).over(ORDER()), "prev_map": F.lag(channel(df, "map")).over(ORDER()), "top_ect": F.max(channel(df, "ect")).over(WHOLE())}


def with_features(df: DataFrame) -> DataFrame:
    """Add prev_tps, prev_map, region, segment, is_idle, warm_at, is_warm and engine_on. One window, one shuffle."""
    return with_row_features(df.withColumns(feature_windows(df)))


def with_row_features(df: DataFrame) -> DataFrame:
    """The features of rows that have their ``feature_windows``."""
    rpm, tps, map_, vss, ect = (channel(df, c) for c in ("rpm", "tps", "map", "vss", "ect"))
    out = df.withColumn("warm_at", S.warm_threshold(F.col("top_ect"))).drop("top_ect")
    return (
        out.withColumn("region", S.region(rpm, tps, map_, F.col("prev_tps"), F.col("prev_map")))
        .withColumn("segment", S.segment(rpm, tps, vss))
        .withColumn("is_idle", S.is_idle(rpm, tps, vss))
        .withColumn("is_warm", F.coalesce(ect >= F.col("warm_at"), F.lit(True)))
        .withColumn("engine_on", F.coalesce(rpm > 400, F.lit(False)))
    )


def gated(features: DataFrame) -> DataFrame:
    """Rows that tell about the fuel table: neither transient nor cold."""
    return features.where((F.col("region") != "transient") & F.col("is_warm"))


def gate_counts(features: DataFrame) -> DataFrame:
    """Per log how many rows the gate drops; a row both transient and cold counts as transient."""
    moving = F.col("region") == "transient"
    return features.groupBy("log_id").agg(F.count_if(moving).alias("transient_rows"), F.count_if(~moving & ~F.col("is_warm")).alias("cold_rows"), F.count_if(~moving & F.col("is_warm")).alias("kept_rows"))


def trim_styles(rows: DataFrame, trims: Iterable[str] = TRIMS) -> DataFrame:
    """Per log the encoding of each trim channel, from the upper median of its first values."""
    trims = [t for t in trims if t in rows.columns]
    if not trims:
        return rows.select("log_id").distinct()
    head = ORDER().rowsBetween(Window.unboundedPreceding, 0)
    counted = rows.select("log_id", *trims, *(F.count(t).over(head).alias(f"{t}_n") for t in trims))
    first = [S.upper_median(F.collect_list(F.when(F.col(f"{t}_n") <= STYLE_SAMPLE, F.col(t)))).alias(t) for t in trims]
    return counted.groupBy("log_id").agg(*first).select("log_id", *(S.trim_style(F.col(t)).alias(f"{t}_style") for t in trims))


def with_trim_styles(rows: DataFrame, inside: Column | None = None) -> DataFrame:
    """Add the encoding of each trim channel to every row; only rows that are ``inside`` tell it."""
    counted = rows.withColumns(trim_counters(rows, inside))
    return with_told_styles(with_upper_medians(counted, trim_heads(rows, inside)))


def _told(rows: DataFrame, inside: Column | None) -> dict[str, Column]:
    return {t: F.col(t) if inside is None else F.when(inside, F.col(t)) for t in TRIMS if t in rows.columns}


def trim_counters(rows: DataFrame, inside: Column | None) -> dict[str, Column]:
    """How many values of each trim channel a log has up to a row."""
    return {f"_{t}_n": F.count(v).over(HEAD()) for t, v in _told(rows, inside).items()}


def trim_heads(rows: DataFrame, inside: Column | None) -> dict[str, Column]:
    """The first values of each trim channel, whose medians tell its encoding."""
    return {f"_{t}_mid": F.when(F.col(f"_{t}_n") <= STYLE_SAMPLE, v) for t, v in _told(rows, inside).items()}


def with_told_styles(rows: DataFrame) -> DataFrame:
    """The encodings of trims whose medians are known."""
    trims = [t for t in TRIMS if f"_{t}_mid" in rows.columns]
    return rows.withColumns({f"{t}_style": S.trim_style(F.col(f"_{t}_mid")) for t in trims}).drop(*(f"_{t}_{x}" for t in trims for x in ("n", "mid")))


def with_generic_trims(rows: DataFrame) -> DataFrame:
    """Unbanked channels stft and ltft stand in for what banks lack: for missing sides of banks that report, or for bank 1 where none does."""
    generic = [k for k in ("stft", "ltft") if k in rows.columns]
    banks = [b for b in (1, 2) if any(f"{k}_b{b}" in rows.columns for k in ("stft", "ltft"))] or [1]
    return rows.withColumns({f"{k}_b{b}": F.col(k) for k in generic for b in banks if f"{k}_b{b}" not in rows.columns})


def with_bank_trims(rows: DataFrame, inside: Column | None = None) -> DataFrame:
    """Add trim_b1, trim_b2 and trim, the mean of the banks that the table carries, in percent; a missing channel or value counts as 0."""
    rows = with_generic_trims(rows)
    return with_percents(with_trim_styles(rows, inside))


def with_percents(rows: DataFrame) -> DataFrame:
    """Add trim_b1, trim_b2 and trim to rows that know the encodings of their trims."""
    pct = {t: S.trim_percent(F.col(t), F.col(f"{t}_style")) if t in rows.columns else F.lit(0.0) for t in TRIMS}
    banks = [b for b in (1, 2) if any(f"{k}_b{b}" in rows.columns for k in ("stft", "ltft"))]
    out = rows.withColumn("trim_b1", pct["stft_b1"] + pct["ltft_b1"]).withColumn("trim_b2", pct["stft_b2"] + pct["ltft_b2"])
    return out.withColumn("trim", sum((F.col(f"trim_b{b}") for b in banks), F.lit(0.0)) / max(1, len(banks)))


def with_cell(rows: DataFrame) -> DataFrame:
    """Add the 500 rpm by 10 kPa cell; rows without either value go."""
    return rows.where(F.col("rpm").isNotNull() & F.col("map").isNotNull()).withColumn("rpm_lo", S.binned(F.col("rpm"), 500)).withColumn("map_lo", S.binned(F.col("map"), 10))


def with_kr_scale(df: DataFrame) -> DataFrame:
    """Add raw_counts (a log's first positive knock values are all whole) and the scale that follows; windows of the log, no join."""
    first = df.withColumn("_kr_n", kr_counter()).withColumn("_first", kr_head())
    return first.withColumn("raw_counts", kr_whole()).drop("_kr_n", "_first").withColumn("scale", F.when(F.col("raw_counts"), S.KR_RAW_TO_DEG).otherwise(1.0))


def kr_counter() -> Column:
    """How many positive knock values a log has up to a row."""
    return F.count(F.when(F.col("kr") > 0, F.col("kr"))).over(HEAD())


def kr_head() -> Column:
    """Whether one of the first positive knock values is whole; _kr_n counts them."""
    positive = F.when(F.col("kr") > 0, F.col("kr"))
    return F.when(F.col("_kr_n") <= KR_SAMPLE, positive == F.floor(positive))


def kr_whole() -> Column:
    """Whether all of a log's first positive knock values, _first, are whole."""
    return F.coalesce(F.bool_and("_first").over(WHOLE()), F.lit(False))


def kr_scales(df: DataFrame) -> DataFrame:
    """Per log whether knock retard is in raw counts and its scale."""
    return with_kr_scale(df).groupBy("log_id").agg(F.first("raw_counts").alias("raw_counts"), F.first("scale").alias("scale"))


def with_gears(features: DataFrame) -> DataFrame:
    """Add mph, ratio and the nearest gear of each row (no debouncing)."""
    if "near_gear" in features.columns:
        return features
    scaled = with_mph(features)
    ratio = S.gear_ratio(F.col("rpm"), F.col("mph"), F.col("vss"))
    return scaled.withColumn("ratio", S.half_up(ratio)).withColumn("near_gear", S.nearest_gear(ratio))
