"""From reports to gated suggestions. All modes are evaluated in one plan: every row is exploded into the three modes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revscope.functions import scalars as S

#: Caps and gates of each mode - fuel cap %, spark cap degrees, transmission cap %, cell samples, knock samples, trim %, lambda error.
MODES = {
    "conservative": (5.0, 2.0, 5.0, 30, 10, 4.0, 0.04),
    "balanced": (8.0, 3.0, 8.0, 20, 6, 3.0, 0.03),
    "aggressive": (12.0, 4.0, 10.0, 10, 4, 2.0, 0.02),
}
GATES = ["fuel_cap", "spark_cap", "trans_cap", "cell_samples", "knock_samples", "trim_limit", "lambda_limit"]
#: Breakpoints of the spark table: rpm, then kPa.
SPARK_RPM = [float(400 * k) for k in range(17)]
SPARK_MAP = [float(20 + 5 * k) for k in range(17)]


def in_modes(df: DataFrame) -> DataFrame:
    rows = [F.struct(F.lit(m).alias("mode"), *(F.lit(v).alias(n) for n, v in zip(GATES, gates, strict=True))) for m, gates in MODES.items()]
    return df.withColumn("_m", F.explode(F.array(*rows))).select("*", "_m.*").drop("_m")


def clamp(x: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, x))


def axis(values: list[float]) -> Column:
    return F.array(*(F.lit(v) for v in values))


def fuel_suggestions(cells: DataFrame, o2: DataFrame, imbalance: DataFrame) -> DataFrame:
    """Trim cells into fuel changes; the sensors may raise or lower the confidence, a bank split lowers it."""
    keys = ["log_id", "rpm_lo", "map_lo"]
    joined = cells.join(o2.select(*keys, F.col("samples").alias("o2_samples"), "bias"), keys, "left").join(imbalance.select(*keys, "lean_bank"), keys, "left")
    rows = in_modes(joined)
    thin = F.col("samples") < F.col("cell_samples")
    trim, seen = F.col("avg_trim"), F.coalesce(F.col("o2_samples") >= 10, F.lit(False))
    agrees = seen & (((trim > 0) & (F.col("bias") == "lean")) | (~(trim > 0) & (F.col("bias") == "rich")))
    differs = seen & ~agrees & (F.col("bias") != "switching")
    high = (F.col("samples") >= 2 * F.col("cell_samples")) & ~differs
    confidence = F.when(thin, "low").when((high | agrees) & F.col("lean_bank").isNull(), "high").otherwise("medium")
    delta = S.half_up(clamp(trim, -F.col("fuel_cap"), F.col("fuel_cap")))
    return rows.where(thin | (F.abs(trim) >= F.col("trim_limit"))).select(
        "mode", *keys, F.when(F.col("idle_fraction") >= 0.5, "Idle VE").otherwise("Main VE").alias("table_name"),
        F.when(thin, "none").when(delta > 0, "add fuel").otherwise("remove fuel").alias("action"), F.when(thin, 0.0).otherwise(delta).alias("delta_pct"), confidence.alias("confidence"), "samples", "avg_trim", "first_row",
    )


def spark_suggestions(events: DataFrame, summary: DataFrame) -> DataFrame:
    """Repeated clean knock in one cell of the worst steady region asks for less timing; single events are only watched."""
    clean = events.where(~F.col("suspect_noise") & ~F.col("tip_out") & (F.col("region") != "transient"))
    regions = clean.groupBy("log_id", "region").agg(F.sum("samples").alias("n"), F.min("start_row").alias("first"))
    target = regions.groupBy("log_id").agg(F.max_by("region", F.struct("n", -F.col("first"))).alias("region"))
    placed = clean.join(target, ["log_id", "region"]).where("rpm is not null and map is not null")
    placed = placed.withColumn("row", S.nearest_place(axis(SPARK_RPM), F.col("rpm"))).withColumn("col", S.nearest_place(axis(SPARK_MAP), F.col("map")))
    cells = placed.groupBy("log_id", "region", "row", "col").agg(F.count("*").alias("events"), S.upper_median(F.collect_list("peak_kr")).alias("median_peak"))
    rows = in_modes(cells.join(summary.select("log_id", F.col("active").alias("samples")), "log_id")).where(F.col("samples") >= F.col("knock_samples"))
    again = F.col("events") >= 2
    pull = S.half_up(clamp(F.col("median_peak"), F.lit(0.5), F.col("spark_cap")))
    return rows.select(
        "mode", "log_id", "region", "row", "col", "events", F.when(again, "retard timing").otherwise("none").alias("action"), F.when(again, -pull).otherwise(0.0).alias("delta_deg"), F.when(F.col("events") >= 3, "high").when(again, "medium").otherwise("low").alias("confidence"), "samples"
    )


def knock_learning(events: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """One degree out of every spark cell that knocked cleanly in the latest session and in an earlier one.

    With a ledger (kind, cell as 'row/col', pass_no, delta) cells go that the degree would take beyond the ledger's limit.
    """
    clean = events.where(~F.col("suspect_noise") & ~F.col("tip_out") & (F.col("region") != "transient") & F.col("rpm").isNotNull() & F.col("map").isNotNull())
    placed = clean.select("log_id", S.nearest_place(axis(SPARK_RPM), F.col("rpm")).alias("row"), S.nearest_place(axis(SPARK_MAP), F.col("map")).alias("col"))
    latest = events.agg(F.max("log_id").alias("latest"))
    per_cell = placed.join(F.broadcast(latest), F.lit(True)).groupBy("row", "col", "latest").agg(F.max("log_id").alias("last_seen"), F.countDistinct("log_id").alias("sessions"), F.count("*").alias("events"))
    learned = per_cell.where("last_seen = latest and sessions >= 2").select("row", "col", "sessions", "events", F.lit(-1.0).alias("delta_deg"))
    if ledger is None:
        return learned
    spent = ledger.where("kind = 'spark'").groupBy("cell").agg(F.sum("delta").alias("spent"))
    joined = learned.withColumn("cell", F.concat_ws("/", "row", "col")).join(spent, "cell", "left")
    return joined.where(F.abs(F.coalesce("spent", F.lit(0.0)) + F.col("delta_deg")) <= LEDGER_LIMITS["spark"]).drop("cell", "spent")


def pe_suggestions(by_region: DataFrame) -> DataFrame:
    """Full-load lambda error into enrichment. The error is absolute, so a rich log asks for fuel as well."""
    rows = in_modes(by_region.where("region = 'wot' and samples > 0"))
    thin = F.col("samples") < F.col("cell_samples")
    delta = S.half_up(clamp(F.col("avg_abs_error") * 100, F.lit(0.0), F.col("fuel_cap")))
    return rows.where(thin | (F.col("avg_abs_error") >= F.col("lambda_limit"))).select("mode", "log_id", F.when(thin, "none").otherwise("enrich").alias("action"), F.when(thin, 0.0).otherwise(delta).alias("delta_pct"), F.when(thin, "low").otherwise("medium").alias("confidence"), "samples")


MIN_STABS = 5


def ae_suggestions(tip_in: DataFrame, crossings: DataFrame) -> DataFrame:
    """Lean stabs ask for more acceleration fuel, unless every sensor is dead or lazy."""
    health = crossings.groupBy("log_id").agg(F.bool_and(F.col("health").isin("dead/slow", "lazy")).alias("sensors_bad"))
    rows = in_modes(tip_in.where("events > 0").join(health, "log_id", "left"))
    few, bad = F.col("events") < MIN_STABS, F.coalesce("sensors_bad", F.lit(False))
    warm = F.col("warm_events") >= MIN_STABS
    share = F.when(warm, F.col("warm_lean_fraction")).otherwise(F.col("lean_fraction"))
    n = F.when(warm, F.col("warm_events")).otherwise(F.col("events"))
    idle = few | bad
    return rows.where(idle | (share >= 0.5)).select(
        "mode", "log_id", F.when(idle, "none").otherwise("increase").alias("action"), F.when(idle, 0.0).otherwise(F.least(F.lit(20.0), 2 * F.col("fuel_cap"))).alias("delta_pct"), F.when(idle, "low").when((share >= 0.75) & (n >= 10), "high").otherwise("medium").alias("confidence"), F.col("events").alias("samples")
    )


def pe_entry_suggestions(entry: DataFrame) -> DataFrame:
    rows = in_modes(entry.where("episodes >= 3"))
    late = (F.col("engage_fraction") < 0.5) | F.coalesce(F.col("avg_delay_s") > 2, F.lit(False))
    return rows.where(late).select("mode", "log_id", F.lit("lower").alias("action"), (-F.least(F.lit(10.0), 2 * F.col("fuel_cap"))).alias("delta_pct"), F.when(F.col("episodes") >= 6, "high").otherwise("medium").alias("confidence"), F.col("episodes").alias("samples"))


def trans_suggestions(report: DataFrame) -> DataFrame:
    """Firmness, kickdown, hunting and converter rows of each log."""
    zero, ten = F.lit(0.0), F.least(F.lit(10.0), F.col("trans_cap"))
    act = F.col("flared") >= 3
    slow = F.coalesce(F.col("avg_kickdown_s") > 1.5, F.lit(False)) | (F.col("no_kickdown") > 0)
    row = lambda kind, action, delta, confidence, samples: F.struct(F.lit(kind).alias("kind"), action.alias("action"), delta.alias("delta_pct"), confidence.alias("confidence"), samples.alias("samples"))
    medium = F.lit("medium")
    rows = [
        F.when((F.col("upshifts") >= 3) & (F.col("flared") > 0), row("trans-firmness", F.when(act, "increase").otherwise("none"), F.when(act, ten).otherwise(zero), F.when(~act, "low").when(F.col("flared") >= 5, "high").otherwise("medium"), F.col("upshifts"))),
        F.when((F.col("kickdowns") >= 3) & slow, row("trans-kickdown", F.lit("raise"), ten, F.when(F.col("kickdowns") >= 6, "high").otherwise("medium"), F.col("kickdowns"))),
        F.when(F.col("hunting") >= 1, row("trans-hunting", F.lit("widen"), F.least(F.lit(5.0), F.col("trans_cap")), medium, F.col("shifts"))),
        F.when(F.col("tcc_cycles") >= 2, row("trans-tcc", F.lit("none"), zero, medium, F.col("tcc_applies") + F.col("tcc_releases"))),
    ]
    return in_modes(report).select("mode", "log_id", F.explode(F.array_compact(F.array(*rows))).alias("r")).select("mode", "log_id", "r.*")


def trans_changes(suggested: DataFrame, report: DataFrame) -> DataFrame:
    """What the transmission suggestions change, and where: (mode, log_id, firm_pct, firm_mph, kick_pct, kick_mph, hunt_pct, hunt_tps, hunt_pair)."""
    acting = suggested.where("action <> 'none'").groupBy("mode", "log_id")
    of = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("delta_pct")))
    wide = acting.agg(of("trans-firmness").alias("firm_pct"), of("trans-kickdown").alias("kick_pct"), of("trans-hunting").alias("hunt_pct"))
    where = report.select("log_id", F.col("worst_flare_mph").alias("firm_mph"), F.col("kickdown_mph").alias("kick_mph"), F.col("hunting_tps").alias("hunt_tps"), F.col("hunting_pair").alias("hunt_pair"))
    return wide.join(where, "log_id").select("mode", "log_id", "firm_pct", "firm_mph", "kick_pct", "kick_mph", "hunt_pct", "hunt_tps", "hunt_pair")


def warmup_advice(slope: DataFrame, rich: DataFrame, crank: DataFrame) -> DataFrame:
    """One row for each thing that the warm-up says about cold fuel."""
    parts = [
        slope.where("verdict = 'stuck-lean'").select("log_id", F.lit("choke").alias("topic"), F.lit("richer").alias("advice")),
        slope.where("verdict = 'stuck-rich'").select("log_id", F.lit("choke").alias("topic"), F.lit("leaner").alias("advice")),
        rich.where("flagged").select("log_id", F.lit("cold enrichment").alias("topic"), F.lit("leaner").alias("advice")),
        crank.where("verdict = 'long-crank'").select("log_id", F.lit("crank fuel").alias("topic"), F.lit("richer").alias("advice")),
        crank.where("verdict = 'weak-flare'").select("log_id", F.lit("afterstart fuel").alias("topic"), F.lit("richer").alias("advice")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def assembled(*parts: tuple[str, DataFrame, str]) -> DataFrame:
    """All suggestions on one schema; those without an action are blocked. Parts: kind, rows, name of the delta."""
    out = None
    for kind, df, delta in parts:
        rows = df.select("mode", "log_id", (F.col("kind") if "kind" in df.columns else F.lit(kind)).alias("kind"), "action", F.col(delta).cast("double").alias("delta"), "confidence", "samples")
        out = rows if out is None else out.unionByName(rows)
    return out.withColumn("actionable", F.col("action") != "none")


def suggestion_counts(suggestions: DataFrame) -> DataFrame:
    return suggestions.groupBy("mode", "log_id").agg(F.count_if("actionable").alias("actionable"), F.count_if(~F.col("actionable")).alias("blocked"))


def mode_compare(suggestions: DataFrame) -> DataFrame:
    """How many changes of each kind a mode makes, and its largest one, sign and all."""
    sums = suggestions.where("actionable").groupBy("log_id", "kind", "mode").agg(F.count("*").alias("changes"), F.max_by("delta", F.struct(F.abs("delta"), F.col("delta"))).alias("largest"))
    spread = Window.partitionBy("log_id", "kind")
    return sums.withColumn("differs", (F.min("changes").over(spread) != F.max("changes").over(spread)) | (F.min("largest").over(spread) != F.max("largest").over(spread)) | (F.count("*").over(spread) < len(MODES)))


def summary_lines(suggestions: DataFrame) -> DataFrame:
    """A plain sentence for each kind of change."""
    sums = suggestions.where("actionable").groupBy("mode", "log_id", "kind").agg(F.count("*").alias("n"), F.max(F.abs("delta")).alias("most"))
    return sums.select("mode", "log_id", "kind", F.format_string("%d %s change(s), at most %.2f", "n", "kind", "most").alias("line"))


#: The limits of cumulative change, percent or degrees.
LEDGER_LIMITS = {"fuel": 15.0, "spark": 6.0, "pe": 15.0, "trans": 20.0}


def ledger_cumulative(patches: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Changes of a cell add up over passes: percents compound, degrees add. Rows: kind, cell, pass_no, delta, and what ledgers are kept ``by``."""
    ordered = F.array_sort(F.collect_list(F.struct("pass_no", "delta")))
    product = F.aggregate(ordered, F.lit(1.0), lambda acc, x: acc * (1 + x["delta"] / 100))
    sums = patches.groupBy(*by, "kind", "cell").agg(F.count("*").alias("passes"), F.sum("delta").alias("added"), product.alias("product"))
    total = F.when(F.col("kind") == "spark", F.col("added")).otherwise((F.col("product") - 1) * 100)
    limit = F.lit(LEDGER_LIMITS["fuel"])
    for kind, value in LEDGER_LIMITS.items():
        limit = F.when(F.col("kind") == kind, value).otherwise(limit)
    out = sums.select(*by, "kind", "cell", "passes", S.half_up(total).alias("cumulative"), limit.alias("max_change"))
    return out.withColumn("blocked", F.abs("cumulative") >= F.col("max_change"))


def patch_impact(patches: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """What a set of changes does to each kind's ledger: the largest change, the worst total, and its grade."""
    sums = ledger_cumulative(patches, by)
    latest = patches.groupBy(*by, "kind").agg(F.max(F.abs("delta")).alias("max_delta"), F.count("*").alias("patches"))
    worst = sums.groupBy(*by, "kind").agg(F.max(F.abs("cumulative")).alias("worst"), F.max("max_change").alias("max_change"), F.min_by("cell", F.struct(-F.abs("cumulative"), F.col("cell"))).alias("worst_cell"))
    share = F.col("worst") / F.col("max_change")
    return latest.join(worst, [*by, "kind"]).withColumn("grade", F.when(share >= 1, "blocked").when(share >= 0.8, "warn").otherwise("ok"))


def cell_provenance(suggested: DataFrame, rpm_axis: list[float], map_axis: list[float], full: float = 100.0) -> DataFrame:
    """Where each cell of a table has its value from: its own samples, or how far the nearest measured cell is.

    A bin gives its samples to every breakpoint that it touches, edges included.
    Needs rows (log_id, rpm_lo, map_lo, samples); a grid is at most a few hundred cells.
    """
    logs = suggested.select("log_id").distinct()
    grid = logs.select("log_id", F.posexplode(axis(rpm_axis)).alias("row", "rpm")).select("*", F.posexplode(axis(map_axis)).alias("col", "map"))
    rows = F.filter(F.transform(axis(rpm_axis), lambda b, i: F.struct(i.alias("i"), b.alias("b"))), lambda x: (x["b"] >= F.col("rpm_lo")) & (x["b"] <= F.col("rpm_lo") + 500))
    cols = F.filter(F.transform(axis(map_axis), lambda b, i: F.struct(i.alias("i"), b.alias("b"))), lambda x: (x["b"] >= F.col("map_lo")) & (x["b"] <= F.col("map_lo") + 10))
    hits = suggested.select("log_id", "samples", F.explode(rows).alias("r"), cols.alias("c")).select("log_id", "samples", F.col("r.i").alias("row"), F.explode("c").alias("c")).groupBy("log_id", "row", F.col("c.i").alias("col")).agg(F.sum("samples").alias("samples"))
    measured = hits.groupBy("log_id").agg(F.collect_list(F.struct("row", "col")).alias("measured"))
    cells = grid.join(hits, ["log_id", "row", "col"], "left").join(measured, "log_id", "left")
    distance = F.array_min(F.transform("measured", lambda m: F.greatest(F.abs(m["row"] - F.col("row")), F.abs(m["col"] - F.col("col")))))
    confidence = F.when(F.col("samples") > 0, F.least(F.lit(1.0), F.col("samples") / full)).otherwise(F.coalesce(1 / (1 + distance), F.lit(0.0)))
    out = cells.select("log_id", "row", "col", "rpm", "map", F.coalesce("samples", F.lit(0)).alias("samples"), F.when(F.col("samples") > 0, "measured").otherwise("interpolated").alias("kind"), S.half_up(confidence, 3).alias("confidence"))
    c = F.col("confidence")
    measured = F.when(c >= 0.67, "high").when(c >= 0.34, "medium").otherwise("low")
    return out.withColumn("tier", F.when(F.col("kind") == "measured", measured).otherwise(F.when(c >= 0.5, "near").when(c >= 0.25, "mid").otherwise("far")))
