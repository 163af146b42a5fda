"""What a reader sees first: the report card, knock over the spark table, a tune in plain words, and why a change is or is not judged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revscope.functions import scalars as S
from revscope.operators import features as X
from revscope.operators import reports as R
from revscope.operators import rules as U

#: Fixed value: rows of a log that tell a trim channel's encoding on the card.
CARD_SAMPLE = 2000


def report_card(f: DataFrame) -> DataFrame:
    """Size, duration, mean trims of each bank on the scale where 128 is neutral, knock and sensor health of each log."""
    trims = [t for t in X.TRIMS if t in f.columns]
    head = {t: F.when(F.row_number().over(X.ORDER()) <= CARD_SAMPLE, F.col(t)) for t in trims}
    styled = X.with_upper_medians(f.withColumns({f"_{t}": v for t, v in head.items()}), {f"_{t}_mid": F.col(f"_{t}") for t in trims})

    def mean(b: int) -> Column:
        own = [f"{k}_b{b}" for k in ("stft", "ltft") if f"{k}_b{b}" in trims]
        if not own:
            return F.lit(None).cast("double")
        counts = sum((F.coalesce(S.trim_counts(F.col(t), S.trim_style(F.col(f"_{t}_mid"))), F.lit(128.0)) for t in own), F.lit(128.0 * (1 - len(own))))
        return S.half_up(F.avg(F.when(F.coalesce(*own).isNotNull(), counts)), 1)

    span = F.max("time_s") - F.min("time_s")
    sizes = styled.groupBy("log_id").agg(F.count("*").alias("n_rows"), F.when(span > 0, S.half_up(span, 1)).alias("duration_s"), mean(1).alias("mean_b1"), mean(2).alias("mean_b2"))
    knock = R.knock_summary(f).select("log_id", F.col("events").alias("knock_events"), "max_kr")
    sensors = R.o2_health(f).groupBy("log_id").agg(*(F.max(F.when(F.col("bank") == f"bank{b}", F.col(c))).alias(f"o2_b{b}_{n}") for b in (1, 2) for c, n in (("per_min", "per_min"), ("amplitude_mv", "mv"), ("lazy", "lazy"))))
    return sizes.join(knock, "log_id").join(sensors, "log_id", "left")


def knock_overlay(f: DataFrame, rpm_axis: list[float], map_axis: list[float]) -> DataFrame:
    """Knock events laid over a table: for each log and cell how many had their peak nearest to it, and the worst."""
    events = R.knock_events(f).where("rpm is not null and map is not null")
    placed = events.select("log_id", S.nearest_place(U.axis(rpm_axis), F.col("rpm")).alias("row"), S.nearest_place(U.axis(map_axis), F.col("map")).alias("col"), "peak_kr")
    return placed.groupBy("log_id", "row", "col").agg(F.count("*").alias("events"), F.max("peak_kr").alias("peak_kr"))


def spark_grid(f: DataFrame, suggested: DataFrame, rpm_axis: list[float], map_axis: list[float]) -> DataFrame:
    """The spark table's cells that a session touches: the change suggested in each mode, and the knock over it; cells that only knocked have no change."""
    over = knock_overlay(f, rpm_axis, map_axis)
    modes = U.in_modes(over.select("log_id", "row", "col", "events", "peak_kr")).select("mode", "log_id", "row", "col", "events", "peak_kr")
    moved = suggested.where("action <> 'none'").select("mode", "log_id", "row", "col", F.col("delta_deg"))
    return modes.join(moved, ["mode", "log_id", "row", "col"], "full_outer")


def load_zone(kpa: Column) -> Column:
    """Zone words of a table's load axis."""
    return F.when(kpa < 50, "light load").when(kpa < 80, "part load").otherwise("heavy load")


def rpm_zone(rpm: Column) -> Column:
    return F.when(rpm < 2000, "low rpm").when(rpm < 3500, "mid rpm").otherwise("high rpm")


def region_words(table: Column, rpm_lo: Column, map_lo: Column) -> Column:
    """A patched cell in words: table, engine speed and load."""
    name = F.regexp_replace(F.lower(table), " ve$", " VE")
    return F.concat_ws(", ", name, rpm_zone(rpm_lo), load_zone(map_lo))


#: What tells whether a change of a kind worked, where fuel trims cannot.
JUDGED_BY = {"fuel": "fuel trims", "spark": "knock report", "pe": "full-throttle lambda", "ae": "tip-in lean spikes", "pe-entry": "enrichment entries"}


def judged_by(kind: Column) -> Column:
    out = F.when(kind.startswith("trans"), "transmission report").otherwise("no report")
    for name, what in JUDGED_BY.items():
        out = F.when(kind == name, what).otherwise(out)
    return out


def explained_convergence(judged: DataFrame) -> DataFrame:
    """Convergence rows with the region in words and the report that can judge the change."""
    return judged.select("log_id", "kind", "table_name", "rpm_lo", "map_lo", "verdict", region_words(F.col("table_name"), F.col("rpm_lo"), F.col("map_lo")).alias("region"), judged_by(F.col("kind")).alias("judged_by"))


def driving_words(rpm_lo: Column, map_lo: Column) -> Column:
    """Where in driving a trim cell lies."""
    mid = map_lo + 5
    load = F.when(mid < 40, "light load").when(mid < 75, "cruising load").otherwise("heavy load")
    return F.concat(F.format_string("%d-%d rpm at ", rpm_lo, rpm_lo + 500), load)


#: The plain name of each kind of change that is not fuel, and its unit.
KIND_WORDS = {"spark": ("timing", "degrees"), "pe": ("full throttle", "%"), "ae": ("throttle response", "%"), "pe-entry": ("full-throttle entry", "%"), "trans-firmness": ("shift feel", "%"), "trans-kickdown": ("kickdown", "%"), "trans-hunting": ("shift busyness", "%")}


def tune_summary(fuel: DataFrame, others: DataFrame) -> DataFrame:
    """(mode, log_id, kind, line): a sentence for fuel added, one for fuel taken, and one for each other change.

    ``fuel`` are fuel suggestions with their cells, ``others`` all suggestions (mode, log_id, kind, delta, actionable).
    """
    rows = fuel.where("action <> 'none'").withColumn("kind", F.when(F.col("delta_pct") > 0, "fuel added").otherwise("fuel taken"))
    biggest = F.max_by(F.struct("rpm_lo", "map_lo", "delta_pct"), F.struct(F.abs("delta_pct"), -F.col("first_row")))
    sums = rows.groupBy("mode", "log_id", "kind").agg(F.count("*").alias("n"), biggest.alias("b"), F.array_join(F.array_sort(F.collect_set("table_name")), " + ").alias("tables"))
    more = F.when(F.col("n") > 1, F.format_string(" and %d similar cells", F.col("n") - 1)).otherwise("")
    fuel_lines = sums.select("mode", "log_id", "kind", F.concat(F.col("kind"), F.format_string(": about %.2f %% for ", F.abs("b.delta_pct")), driving_words(F.col("b.rpm_lo"), F.col("b.map_lo")), more, F.lit(" ("), F.col("tables"), F.lit(")")).alias("line"))
    rest = others.where("actionable and kind <> 'fuel'").groupBy("mode", "log_id", "kind").agg(F.count("*").alias("n"), F.max(F.abs("delta")).alias("most"))
    name, unit = F.col("kind"), F.lit("%")
    for kind, (word, of) in KIND_WORDS.items():
        name, unit = F.when(F.col("kind") == kind, word).otherwise(name), F.when(F.col("kind") == kind, of).otherwise(unit)
    lines = rest.select("mode", "log_id", "kind", F.concat(name, F.format_string(": %d changes of at most %.2f ", "n", "most"), unit).alias("line"))
    return fuel_lines.unionByName(lines)


def headlines(lines: DataFrame, logs: DataFrame) -> DataFrame:
    """How many kinds of change a mode makes to a log; logs without any are told so."""
    counted = lines.groupBy("mode", "log_id").agg(F.count("*").alias("kinds"))
    everyone = U.in_modes(logs.select("log_id").distinct()).select("mode", "log_id")
    text = F.when(F.col("kinds") == 0, "no changes: the log looks healthy").otherwise(F.format_string("%d kinds of change", "kinds"))
    return everyone.join(counted, ["mode", "log_id"], "left").fillna(0, ["kinds"]).withColumn("headline", text)
