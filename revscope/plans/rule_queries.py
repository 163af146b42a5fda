"""Queries for the rules, each with its comparison SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revscope.cluster import staged
from revscope.operators import events as E
from revscope.operators import features as X
from revscope.operators import reports as R
from revscope.operators import rules as U
from revscope.plans import base_sql as B
from revscope.plans.base_sql import half_up as hu
from revscope.plans.event_queries import CRANK, TIPIN, TIPSUM, TRANS, recursive
from revscope.plans.report_queries import ORACLES as REPORTS
from revscope.plans.report_queries import with_
from revscope.sources.telemetry import telemetry

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, query: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: query(X.with_features(telemetry(spark, sf_dir)))
    if sql:
        ORACLES[name] = sql


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else f"{v}e0" if isinstance(v, float) else str(v) for v in r) + ")" for r in rows)


MODES = f"md AS (SELECT * FROM (VALUES {_values([(m, *g) for m, g in U.MODES.items()])}) AS m(mode, {', '.join(U.GATES)}))"


def sub(name: str) -> str:
    """A report's comparison SQL as a subquery."""
    return "(" + REPORTS[name] + ")"


FUEL = f"""fs AS (SELECT mode, f.log_id, f.rpm_lo, f.map_lo, f.samples, f.avg_trim, f.idle_fraction, f.first_row, fuel_cap, f.samples < cell_samples AS thin,
  coalesce(o.samples >= 10, false) AS seen, o.bias, i.lean_bank, f.samples >= 2 * cell_samples AS twice, {hu("greatest(-fuel_cap, least(fuel_cap, f.avg_trim))")} AS d
  FROM {sub("fuel_trim_cells")} f LEFT JOIN {sub("o2_cells")} o USING (log_id, rpm_lo, map_lo) LEFT JOIN {sub("bank_imbalance")} i USING (log_id, rpm_lo, map_lo), md WHERE f.samples < cell_samples OR abs(f.avg_trim) >= trim_limit),
fs2 AS (SELECT *, seen AND ((avg_trim > 0 AND bias = 'lean') OR (NOT avg_trim > 0 AND bias = 'rich')) AS agrees FROM fs),
fsg AS (SELECT mode, log_id, rpm_lo, map_lo, CASE WHEN idle_fraction >= 0.5 THEN 'Idle VE' ELSE 'Main VE' END AS table_name, CASE WHEN thin THEN 'none' WHEN d > 0 THEN 'add fuel' ELSE 'remove fuel' END AS action, CASE WHEN thin THEN 0e0 ELSE d END AS delta_pct,
  CASE WHEN thin THEN 'low' WHEN ((twice AND NOT (seen AND NOT agrees AND bias <> 'switching')) OR agrees) AND lean_bank IS NULL THEN 'high' ELSE 'medium' END AS confidence, samples, avg_trim, first_row FROM fs2)"""


def fuel(f: DataFrame) -> DataFrame:
    return U.fuel_suggestions(R.fuel_trim_cells(f), R.o2_cells(f), R.bank_imbalance(f))


register("fuel_suggestions", fuel, with_(MODES, FUEL, "SELECT * FROM fsg"))
NEAREST = f"""ar AS (SELECT unnest({U.SPARK_RPM}) AS v, unnest(generate_series(0, 16)) AS i), am AS (SELECT unnest({U.SPARK_MAP}) AS v, unnest(generate_series(0, 16)) AS i),
ev AS (SELECT * FROM {sub("knock_events")}),
cl AS (SELECT *, (SELECT first(i ORDER BY abs(v - ev.rpm), i) FROM ar) AS "row", (SELECT first(i ORDER BY abs(v - ev.map), i) FROM am) AS col FROM ev WHERE NOT suspect_noise AND NOT tip_out AND region <> 'transient')"""
SPARK = f"""rg AS (SELECT log_id, region, sum(samples) AS n, min(start_row) AS first FROM cl GROUP BY log_id, region),
tg AS (SELECT log_id, first(region ORDER BY n DESC, first) AS region FROM rg GROUP BY log_id),
ce AS (SELECT log_id, region, "row", col, count(*) AS events, list_sort(list(peak_kr))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS mp FROM cl JOIN tg USING (log_id, region) WHERE rpm IS NOT NULL AND map IS NOT NULL GROUP BY ALL),
ssg AS (SELECT mode, log_id, region, CAST("row" AS INTEGER) AS "row", CAST(col AS INTEGER) AS col, ce.events, CASE WHEN ce.events >= 2 THEN 'retard timing' ELSE 'none' END AS action, CASE WHEN ce.events >= 2 THEN -({hu("greatest(0.5e0, least(spark_cap, mp))")}) ELSE 0e0 END AS delta_deg,
  CASE WHEN ce.events >= 3 THEN 'high' WHEN ce.events = 2 THEN 'medium' ELSE 'low' END AS confidence, s.active AS samples FROM ce JOIN {sub("knock_summary")} s USING (log_id), md WHERE s.active >= knock_samples)"""


def spark_rows(f: DataFrame) -> DataFrame:
    return U.spark_suggestions(R.knock_events(f), R.knock_summary(f))


register("spark_suggestions", spark_rows, with_(MODES, NEAREST, SPARK, "SELECT * FROM ssg"))
register(
    "knock_learning",
    lambda f: U.knock_learning(R.knock_events(f)),
    with_(NEAREST, 'c AS (SELECT "row", col, max(log_id) AS last_seen, count(DISTINCT log_id) AS sessions, count(*) AS events FROM cl WHERE rpm IS NOT NULL AND map IS NOT NULL GROUP BY "row", col)', 'SELECT CAST("row" AS INTEGER) AS "row", CAST(col AS INTEGER) AS col, sessions, events, -1e0 AS delta_deg FROM c WHERE sessions >= 2 AND last_seen = (SELECT max(log_id) FROM ev)'),
)
register(
    "nearest_cell",
    lambda f: f.where("rpm is not null").select("log_id", "row_idx", U.S.nearest_place(U.axis(U.SPARK_RPM), F.col("rpm")).alias("row"), U.S.nearest_place(U.axis(U.SPARK_MAP), F.col("map")).alias("col")),
    with_(B.T, 'SELECT log_id, row_idx, CAST(greatest(0, least(16, ceil(rpm / 400 - 0.5))) AS INTEGER) AS "row", CAST(greatest(0, least(16, ceil((map - 20) / 5 - 0.5))) AS INTEGER) AS col FROM t WHERE rpm IS NOT NULL'),
)
register(
    "range_cell",
    lambda f: U.cell_provenance(R.fuel_trim_cells(f), U.SPARK_RPM, U.SPARK_MAP).where("samples > 0").select("log_id", "row", "col", "samples"),
    with_(
        f"ar AS (SELECT unnest({U.SPARK_RPM}) AS v, unnest(generate_series(0, 16)) AS i), am AS (SELECT unnest({U.SPARK_MAP}) AS v, unnest(generate_series(0, 16)) AS i)",
        f'SELECT log_id, CAST(ar.i AS INTEGER) AS "row", CAST(am.i AS INTEGER) AS col, CAST(sum(samples) AS BIGINT) AS samples FROM {sub("fuel_trim_cells")} c JOIN ar ON ar.v BETWEEN rpm_lo AND rpm_lo + 500 JOIN am ON am.v BETWEEN map_lo AND map_lo + 10 GROUP BY ALL',
    ),
)
register(
    "cell_provenance",
    lambda f: U.cell_provenance(R.fuel_trim_cells(f), U.SPARK_RPM, U.SPARK_MAP),
    with_(
        f"ar AS (SELECT unnest({U.SPARK_RPM}) AS v, unnest(generate_series(0, 16)) AS i), am AS (SELECT unnest({U.SPARK_MAP}) AS v, unnest(generate_series(0, 16)) AS i)",
        f"fc AS (SELECT * FROM {sub('fuel_trim_cells')})",
        "h AS (SELECT log_id, ar.i AS r, am.i AS c, CAST(sum(samples) AS BIGINT) AS samples FROM fc JOIN ar ON ar.v BETWEEN rpm_lo AND rpm_lo + 500 JOIN am ON am.v BETWEEN map_lo AND map_lo + 10 GROUP BY ALL)",
        "g AS (SELECT log_id, ar.i AS r, am.i AS c, ar.v AS rpm, am.v AS map FROM (SELECT DISTINCT log_id FROM fc), ar, am)",
        "d AS (SELECT g.log_id, g.r, g.c, min(greatest(abs(g.r - h.r), abs(g.c - h.c))) AS d FROM g JOIN h ON h.log_id = g.log_id GROUP BY ALL)",
        f"pv AS (SELECT g.log_id, CAST(g.r AS INTEGER) AS \"row\", CAST(g.c AS INTEGER) AS col, g.rpm, g.map, coalesce(h.samples, 0) AS samples, CASE WHEN h.samples > 0 THEN 'measured' ELSE 'interpolated' END AS kind, {hu('CASE WHEN h.samples > 0 THEN least(1, h.samples / 100e0) ELSE coalesce(1 / (1e0 + d), 0) END', 3)} AS confidence FROM g LEFT JOIN h USING (log_id, r, c) LEFT JOIN d USING (log_id, r, c))",
        "SELECT *, CASE WHEN kind = 'measured' THEN CASE WHEN confidence >= 0.67 THEN 'high' WHEN confidence >= 0.34 THEN 'medium' ELSE 'low' END WHEN confidence >= 0.5 THEN 'near' WHEN confidence >= 0.25 THEN 'mid' ELSE 'far' END AS tier FROM pv",
    ),
)
PESG = f"pg AS (SELECT mode, log_id, CASE WHEN samples < cell_samples THEN 'none' ELSE 'enrich' END AS action, CASE WHEN samples < cell_samples THEN 0e0 ELSE {hu('greatest(0, least(fuel_cap, avg_abs_error * 100))')} END AS delta_pct, CASE WHEN samples < cell_samples THEN 'low' ELSE 'medium' END AS confidence, samples FROM {sub('lambda_by_region')}, md WHERE region = 'wot' AND samples > 0 AND (samples < cell_samples OR avg_abs_error >= lambda_limit))"
register("pe_suggestions", lambda f: U.pe_suggestions(R.lambda_by_region(f)), with_(MODES, PESG, "SELECT * FROM pg"))
AESG = f"""oh AS (SELECT log_id, bool_and(health IN ('dead/slow', 'lazy')) AS bad FROM {sub("o2_cross_counts")} GROUP BY log_id),
a0 AS (SELECT *, events < 5 OR coalesce(bad, false) AS idle, CASE WHEN warm_events >= 5 THEN warm_lean_fraction ELSE lean_fraction END AS sh, CASE WHEN warm_events >= 5 THEN warm_events ELSE events END AS n FROM tsum LEFT JOIN oh USING (log_id), md WHERE events > 0),
ag AS (SELECT mode, log_id, CASE WHEN idle THEN 'none' ELSE 'increase' END AS action, CASE WHEN idle THEN 0e0 ELSE least(20, 2 * fuel_cap) END AS delta_pct, CASE WHEN idle THEN 'low' WHEN sh >= 0.75 AND n >= 10 THEN 'high' ELSE 'medium' END AS confidence, events AS samples FROM a0 WHERE idle OR sh >= 0.5)"""
register("ae_suggestions", lambda f: U.ae_suggestions(E.tip_in_summary(f, E.tip_ins(f)), R.o2_cross_counts(f)), recursive(with_(TIPIN, TIPSUM, MODES, AESG, "SELECT * FROM ag")))
PEEG = f"eg AS (SELECT mode, log_id, 'lower' AS action, -least(10e0, 2 * fuel_cap) AS delta_pct, CASE WHEN episodes >= 6 THEN 'high' ELSE 'medium' END AS confidence, episodes AS samples FROM {sub('pe_entry')}, md WHERE episodes >= 3 AND (engage_fraction < 0.5 OR coalesce(avg_delay_s > 2, false)))"
register("pe_entry_suggestions", lambda f: U.pe_entry_suggestions(R.pe_entry(f)), with_(MODES, PEEG, "SELECT * FROM eg"))
TRSG = """trg AS (SELECT mode, log_id, 'trans-firmness' AS kind, CASE WHEN flared >= 3 THEN 'increase' ELSE 'none' END AS action, CASE WHEN flared >= 3 THEN least(10e0, trans_cap) ELSE 0e0 END AS delta_pct, CASE WHEN flared < 3 THEN 'low' WHEN flared >= 5 THEN 'high' ELSE 'medium' END AS confidence, upshifts AS samples FROM trn, md WHERE upshifts >= 3 AND flared > 0
 UNION ALL SELECT mode, log_id, 'trans-kickdown', 'raise', least(10e0, trans_cap), CASE WHEN kickdowns >= 6 THEN 'high' ELSE 'medium' END, kickdowns FROM trn, md WHERE kickdowns >= 3 AND (coalesce(avg_kickdown_s > 1.5, false) OR no_kickdown > 0)
 UNION ALL SELECT mode, log_id, 'trans-hunting', 'widen', least(5e0, trans_cap), 'medium', shifts FROM trn, md WHERE hunting >= 1
 UNION ALL SELECT mode, log_id, 'trans-tcc', 'none', 0e0, 'medium', tcc_applies + tcc_releases FROM trn, md WHERE tcc_cycles >= 2)"""
register("trans_suggestions", lambda f: U.trans_suggestions(E.transmission(f)), recursive(with_(TRANS, MODES, TRSG, "SELECT * FROM trg")))
register(
    "warmup_advice",
    lambda f: U.warmup_advice(R.warmup_slope(f), R.overfueling(f), E.crank_verdict(f)),
    f"WITH {CRANK} SELECT log_id, 'choke' AS topic, CASE verdict WHEN 'stuck-lean' THEN 'richer' ELSE 'leaner' END AS advice FROM {sub('warmup_slope')} WHERE verdict <> 'decaying-sensibly' UNION ALL SELECT log_id, 'cold enrichment', 'leaner' FROM {sub('overfueling')} WHERE flagged UNION ALL SELECT log_id, 'crank fuel', 'richer' FROM crv WHERE verdict = 'long-crank' UNION ALL SELECT log_id, 'afterstart fuel', 'richer' FROM crv WHERE verdict = 'weak-flare'",
)


def suggestions(f: DataFrame) -> DataFrame:
    """Everything that the rules suggest."""
    return U.assembled(
        ("fuel", fuel(f), "delta_pct"), ("spark", spark_rows(f), "delta_deg"), ("pe", U.pe_suggestions(R.lambda_by_region(f)), "delta_pct"), ("ae", U.ae_suggestions(E.tip_in_summary(f, E.tip_ins(f)), R.o2_cross_counts(f)), "delta_pct"),
        ("pe-entry", U.pe_entry_suggestions(R.pe_entry(f)), "delta_pct"), ("trans", U.trans_suggestions(staged(E.transmission(f), "transmission")), "delta_pct"),
    )


ALL = (
    f"al AS (SELECT *, action <> 'none' AS actionable FROM (SELECT mode, log_id, 'fuel' AS kind, action, delta_pct AS delta, confidence, samples FROM fsg UNION ALL SELECT mode, log_id, 'spark', action, delta_deg, confidence, samples FROM ssg "
    "UNION ALL SELECT mode, log_id, 'pe', action, delta_pct, confidence, samples FROM pg UNION ALL SELECT mode, log_id, 'ae', action, delta_pct, confidence, samples FROM ag UNION ALL SELECT mode, log_id, 'pe-entry', action, delta_pct, confidence, samples FROM eg "
    "UNION ALL SELECT mode, log_id, kind, action, delta_pct, confidence, samples FROM trg))"
)
_beyond = lambda sql: sql.removeprefix(B.FEATURES).lstrip(",\n ")
_all = (TRANS, _beyond(TIPIN), TIPSUM, MODES, FUEL, NEAREST, SPARK, PESG, AESG, PEEG, TRSG, ALL)
register("suggestion_counts", lambda f: U.suggestion_counts(suggestions(f)), recursive(with_(*_all, "SELECT mode, log_id, count(*) FILTER (WHERE actionable) AS actionable, count(*) FILTER (WHERE NOT actionable) AS blocked FROM al GROUP BY mode, log_id")))
register(
    "mode_compare",
    lambda f: U.mode_compare(suggestions(f)),
    recursive(with_(
        *_all,
        "s AS (SELECT log_id, kind, mode, count(*) AS changes, first(delta ORDER BY abs(delta) DESC, delta DESC) AS largest FROM al WHERE actionable GROUP BY ALL)",
        "SELECT *, min(changes) OVER w <> max(changes) OVER w OR min(largest) OVER w <> max(largest) OVER w OR count(*) OVER w < 3 AS differs FROM s WINDOW w AS (PARTITION BY log_id, kind)",
    )),
)
register("summary_lines", lambda f: U.summary_lines(suggestions(f)), recursive(with_(*_all, "SELECT mode, log_id, kind, printf('%d %s change(s), at most %.2f', count(*), kind, max(abs(delta))) AS line FROM al WHERE actionable GROUP BY mode, log_id, kind")))


def _passes(f: DataFrame) -> DataFrame:
    """Each log is a pass: its balanced fuel and spark changes, by cell."""
    fuel_rows = fuel(f).where("mode = 'balanced' and action <> 'none'").select(F.lit("fuel").alias("kind"), F.concat_ws("/", "rpm_lo", "map_lo").alias("cell"), F.col("log_id").alias("pass_no"), F.col("delta_pct").alias("delta"))
    spark_part = spark_rows(f).where("mode = 'balanced' and action <> 'none'").select(F.lit("spark").alias("kind"), F.concat_ws("/", "row", "col").alias("cell"), F.col("log_id").alias("pass_no"), F.col("delta_deg").alias("delta"))
    return fuel_rows.unionByName(spark_part)


LEDGER = f"""ps AS (SELECT 'fuel' AS kind, rpm_lo || '/' || map_lo AS cell, log_id AS pass_no, delta_pct AS delta FROM fsg WHERE mode = 'balanced' AND action <> 'none' UNION ALL SELECT 'spark', "row" || '/' || col, log_id, delta_deg FROM ssg WHERE mode = 'balanced' AND action <> 'none'),
lc AS (SELECT kind, cell, count(*) AS passes, CASE WHEN kind = 'spark' THEN {hu("sum(delta)")} ELSE {hu("(list_reduce(list_prepend(1e0, list(1 + delta / 100 ORDER BY pass_no)), lambda a, b: a * b) - 1) * 100")} END AS cumulative, CASE kind WHEN 'spark' THEN 6e0 ELSE 15e0 END AS max_change FROM ps GROUP BY kind, cell)"""
register("ledger_cumulative", lambda f: U.ledger_cumulative(_passes(f)), with_(MODES, FUEL, NEAREST, SPARK, LEDGER, "SELECT *, abs(cumulative) >= max_change AS blocked FROM lc"))
register(
    "patch_impact",
    lambda f: U.patch_impact(_passes(f)),
    with_(
        MODES, FUEL, NEAREST, SPARK, LEDGER,
        "a AS (SELECT kind, max(abs(delta)) AS max_delta, count(*) AS patches FROM ps GROUP BY kind)",
        "b AS (SELECT kind, max(abs(cumulative)) AS worst, any_value(max_change) AS max_change, first(cell ORDER BY abs(cumulative) DESC, cell) AS worst_cell FROM lc GROUP BY kind)",
        "SELECT *, CASE WHEN worst / max_change >= 1 THEN 'blocked' WHEN worst / max_change >= 0.8 THEN 'warn' ELSE 'ok' END AS grade FROM a JOIN b USING (kind)",
    ),
)
