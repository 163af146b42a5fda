"""Queries for whole-session reports, each with its comparison SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revscope.operators import session as Z
from revscope.plans import base_sql as B
from revscope.plans.base_sql import half_up as hu
from revscope.plans.base_sql import half_up_int as hi
from revscope.plans.base_sql import with_
from revscope.plans.event_queries import TIPIN, TRANS, recursive
from revscope.plans.report_queries import PE
from revscope.sources.telemetry import telemetry

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Column of the flat query: where it stands in the nested report.
FLAT = {
    "n_rows": "row_count", "cruise": "regions.cruise", "transient": "regions.transient", "wot": "regions.wot", "idle": "regions.idle",
    "fuel_cells": "fuel.cell_count", "fuel_abs_trim": "fuel.overall_abs_trim", "fuel_samples": "fuel.total_samples", "gated_warmup": "fuel.gating.gated_warmup", "gated_transient": "fuel.gating.gated_transient",
    "knock_samples": "knock.samples", "knock_events": "knock.events", "knock_pct": "knock.knock_pct", "max_kr": "knock.max_kr", "avg_kr": "knock.avg_kr", "raw_counts": "knock.raw_counts",
    "lambda_samples": "lambda.samples", "lambda_error": "lambda.mean_abs_error", "lambda_within_3": "lambda.pct_within_3",
    "o2_cells": "narrowband.cell_count", "crossings_b1": "narrowband.bank1.crossings", "per_min_b1": "narrowband.bank1.per_min", "health_b1": "narrowband.bank1.health", "crossings_b2": "narrowband.bank2.crossings", "per_min_b2": "narrowband.bank2.per_min", "health_b2": "narrowband.bank2.health",
    "wot_samples": "narrowband.wot.samples", "wot_mv": "narrowband.wot.avg_mv", "wot_status": "narrowband.wot.status",
    "tip_ins": "tip_in.events", "tip_ins_warm": "tip_in.warm_events", "tip_ins_lean": "tip_in.lean_events", "tip_ins_lean_fraction": "tip_in.lean_fraction", "tip_ins_min_o2": "tip_in.avg_min_o2",
    "pe_episodes": "pe_entry.episodes", "pe_engaged": "pe_entry.engaged", "pe_delay_s": "pe_entry.avg_delay_s",
    **{c: f"transmission.{c}" for c in ("shifts", "upshifts", "downshifts", "flared", "shift_rpm_12", "shift_rpm_23", "shift_rpm_34", "tcc_applies", "tcc_releases", "tcc_cycles", "kickdowns", "no_kickdown", "avg_kickdown_s", "hunting", "pcm_s_12", "pcm_s_23")},
    "imbalances": "bank_imbalance.finding_count", "baro_kpa": "baro.median_kpa", "baro_delta": "baro.delta_kpa", "baro_status": "baro.status",
}


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Z.session_report(telemetry(spark, sf_dir), 900.0)


def session_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reports(spark, sf_dir).select("log_id", *(F.col(f"report.{path}").alias(name) for name, path in FLAT.items()))


def session_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Z.details(_reports(spark, sf_dir))


def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = Z.coverage(Z.coverage_figures(Z.prepared(telemetry(spark, sf_dir))))
    gaps = judged.select("log_id", "score", "verdict", F.posexplode("gaps").alias("at", "x")).select("log_id", "score", "verdict", F.lit("gap").alias("kind"), "at", F.col("x.area").alias("what"), F.col("x.severity").alias("severity"), F.col("x.found").alias("found"))
    steps = judged.select("log_id", "score", "verdict", F.posexplode("steps").alias("at", "what")).select("log_id", "score", "verdict", F.lit("step").alias("kind"), "at", "what", F.lit(None).cast("string").alias("severity"), F.lit(None).cast("long").alias("found"))
    return gaps.unionByName(steps).withColumn("nth", (F.col("at") + 1).cast("long")).drop("at")


def behind(sql: str, first: str) -> str:
    """Common table expressions without those that another block already has."""
    return sql.removeprefix(first).lstrip(",\n ")


_cells = behind(B.CELLS, B.FEATURES)
_knock = behind(B.KR, B.FEATURES)
_lam = "CASE WHEN {0} > 5 THEN {0} / 14.7e0 WHEN {0} > 0.3 AND {0} < 2.5 THEN {0} END"
O2CELLS = """oc0 AS (SELECT log_id, row_idx, CAST(floor(rpm / 500) * 500 AS BIGINT) AS rpm_lo, CAST(floor(map / 10) * 10 AS BIGINT) AS map_lo, CASE WHEN o2_b1 IS NULL THEN o2_b2 WHEN o2_b2 IS NULL THEN o2_b1 ELSE (o2_b1 + o2_b2) / 2 END AS mv FROM g WHERE rpm IS NOT NULL AND map IS NOT NULL),
oc AS (SELECT log_id, rpm_lo, map_lo, count(mv) AS samples, min(row_idx) AS first_row FROM oc0 GROUP BY ALL HAVING count(mv) > 0)"""
SPLIT = f"""bi0 AS (SELECT log_id, rpm_lo, map_lo, min(row_idx) AS first_row, count(*) FILTER (WHERE coalesce(stft_b1, ltft_b1) IS NOT NULL) AS n1, count(*) FILTER (WHERE coalesce(stft_b2, ltft_b2) IS NOT NULL) AS n2,
 avg(trim_b1) FILTER (WHERE coalesce(stft_b1, ltft_b1) IS NOT NULL) AS m1, avg(trim_b2) FILTER (WHERE coalesce(stft_b2, ltft_b2) IS NOT NULL) AS m2 FROM c GROUP BY ALL),
bi AS (SELECT *, {hu("m1 - m2")} AS delta FROM bi0 WHERE n1 >= 15 AND n2 >= 15 AND abs(m1 - m2) >= 5)"""


def _sensor(b: int) -> str:
    return f"""xs{b} AS (SELECT log_id, time_s, coalesce((o2_b{b} > 450) <> lag(o2_b{b} > 450) OVER (PARTITION BY log_id ORDER BY row_idx), false) AS x FROM g WHERE region IN ('cruise', 'idle') AND o2_b{b} IS NOT NULL),
xr{b} AS (SELECT log_id, count(*) FILTER (WHERE x) AS crossings, CASE WHEN count(*) > 30 THEN {hu("count(*) FILTER (WHERE x) / CASE WHEN max(time_s) > min(time_s) THEN (max(time_s) - min(time_s)) / 60 ELSE count(*) / 600e0 END")} END AS per_min FROM xs{b} GROUP BY log_id)"""


def _health(b: int) -> str:
    return f"CASE WHEN xr{b}.per_min >= 30 THEN 'healthy' WHEN xr{b}.per_min >= 10 THEN 'lazy' WHEN xr{b}.per_min IS NOT NULL THEN 'dead/slow' ELSE 'unknown' END AS health_b{b}"


REPORT = with_(
    TRANS,
    _cells,
    _knock,
    behind(TIPIN, B.FEATURES),
    behind(PE, B.FEATURES),
    O2CELLS,
    SPLIT,
    _sensor(1),
    _sensor(2),
    "ses AS (SELECT log_id, count(*) AS n_rows, count(*) FILTER (WHERE region = 'cruise') AS cruise, count(*) FILTER (WHERE region = 'transient') AS transient, count(*) FILTER (WHERE region = 'wot') AS wot, count(*) FILTER (WHERE region = 'idle') AS idle, count(*) FILTER (WHERE region <> 'transient' AND NOT is_warm) AS gated_warmup FROM f GROUP BY log_id)",
    f"fs AS (SELECT log_id, {hu('avg(abs(trim))')} AS fuel_abs_trim, count(*) AS fuel_samples FROM c GROUP BY log_id)",
    "fc AS (SELECT log_id, count(*) AS fuel_cells FROM fuel GROUP BY log_id)",
    "kq AS (SELECT log_id, CAST(sum(samples) AS BIGINT) AS active, count(*) AS events, max(peak) AS top, sum(total) AS total FROM ke GROUP BY log_id)",
    f"lq AS (SELECT log_id, count(*) AS lambda_samples, {hu('avg(abs(err))', 3)} AS lambda_error, {hu('100e0 * count(*) FILTER (WHERE abs(err) <= 0.03e0) / count(*)')} AS lambda_within_3 FROM (SELECT log_id, {_lam.format('wb_afr')} - {_lam.format('cmd_afr')} AS err FROM f) WHERE err IS NOT NULL GROUP BY log_id)",
    "ocn AS (SELECT log_id, count(*) AS o2_cells FROM oc GROUP BY log_id)",
    "wq AS (SELECT log_id, count(*) AS n, avg(mv) AS mv FROM (SELECT log_id, o2_b1 AS mv FROM g WHERE region = 'wot' UNION ALL SELECT log_id, o2_b2 FROM g WHERE region = 'wot') WHERE mv IS NOT NULL GROUP BY log_id)",
    f"tq AS (SELECT log_id, count(*) AS tip_ins, count(*) FILTER (WHERE NOT cold) AS tip_ins_warm, count(*) FILTER (WHERE lean) AS tip_ins_lean, {hu('count(*) FILTER (WHERE lean) / count(*)')} AS tip_ins_lean_fraction, {hi('avg(min_o2) FILTER (WHERE lean)')} AS tip_ins_min_o2 FROM tip GROUP BY log_id)",
    f"pq AS (SELECT log_id, count(*) AS pe_episodes, count(pe_row) AS pe_engaged, {hu('avg(pe_row - start_row) * 0.145e0')} AS pe_delay_s FROM pe GROUP BY log_id)",
    "bq AS (SELECT log_id, count(*) AS imbalances FROM bi GROUP BY log_id)",
    "ba AS (SELECT log_id, count(*) FILTER (WHERE baro > 20 AND baro < 120) AS n, list_sort(list(baro) FILTER (WHERE baro > 20 AND baro < 120)) AS l, coalesce(count(*) FILTER (WHERE tps >= 78 AND map IS NOT NULL) >= 10 AND max(map) FILTER (WHERE tps >= 78) > list_sort(list(baro) FILTER (WHERE baro > 20 AND baro < 120))[CAST(floor(count(*) FILTER (WHERE baro > 20 AND baro < 120) / 2) AS BIGINT) + 1] + 5, false) AS above FROM f GROUP BY log_id)",
    "bb AS (SELECT log_id, above, l[CAST(floor(n / 2) AS BIGINT) + 1] AS mid, l[CAST(floor(n / 2) AS BIGINT) + 1] - 101.325e0 * pow(1 - 2.25577e-5 * (900 * 0.3048e0), 5.25588e0) AS off FROM ba WHERE n >= 10)",
    f"""SELECT ses.log_id, n_rows, cruise, transient, wot, idle, coalesce(fuel_cells, 0) AS fuel_cells, coalesce(fuel_abs_trim, 0e0) AS fuel_abs_trim, coalesce(fuel_samples, 0) AS fuel_samples, gated_warmup, transient AS gated_transient,
 coalesce(kq.active, 0) AS knock_samples, coalesce(kq.events, 0) AS knock_events, {hu("100e0 * coalesce(kq.active, 0) / n_rows")} AS knock_pct, {hu("coalesce(kq.top, 0)")} AS max_kr, {hu("coalesce(kq.total / kq.active, 0)")} AS avg_kr, raw_counts,
 lambda_samples, lambda_error, lambda_within_3, coalesce(o2_cells, 0) AS o2_cells, xr1.crossings AS crossings_b1, xr1.per_min AS per_min_b1, {_health(1)}, xr2.crossings AS crossings_b2, xr2.per_min AS per_min_b2, {_health(2)},
 coalesce(wq.n, 0) AS wot_samples, CASE WHEN wq.n >= 10 THEN {hi("wq.mv")} END AS wot_mv, CASE WHEN coalesce(wq.n, 0) < 10 THEN 'no wot data' WHEN wq.mv > 700 THEN 'rich' WHEN wq.mv > 550 THEN 'marginal' ELSE 'lean' END AS wot_status,
 coalesce(tip_ins, 0) AS tip_ins, coalesce(tip_ins_warm, 0) AS tip_ins_warm, coalesce(tip_ins_lean, 0) AS tip_ins_lean, coalesce(tip_ins_lean_fraction, 0e0) AS tip_ins_lean_fraction, tip_ins_min_o2,
 coalesce(pe_episodes, 0) AS pe_episodes, coalesce(pe_engaged, 0) AS pe_engaged, pe_delay_s,
 shifts, upshifts, downshifts, flared, shift_rpm_12, shift_rpm_23, shift_rpm_34, tcc_applies, tcc_releases, tcc_cycles, kickdowns, no_kickdown, avg_kickdown_s, hunting, pcm_s_12, pcm_s_23,
 coalesce(imbalances, 0) AS imbalances, {hu("bb.mid", 1)} AS baro_kpa, {hu("bb.off", 1)} AS baro_delta, CASE WHEN bb.mid IS NOT NULL THEN CASE WHEN abs(bb.off) >= 5 THEN 'fault' WHEN abs(bb.off) >= 3 OR bb.above THEN 'warn' ELSE 'ok' END END AS baro_status
FROM ses JOIN trn USING (log_id) LEFT JOIN fs USING (log_id) LEFT JOIN fc USING (log_id) LEFT JOIN kq USING (log_id) LEFT JOIN krs USING (log_id) LEFT JOIN lq USING (log_id) LEFT JOIN ocn USING (log_id) LEFT JOIN xr1 USING (log_id) LEFT JOIN xr2 USING (log_id)
 LEFT JOIN wq USING (log_id) LEFT JOIN tq USING (log_id) LEFT JOIN pq USING (log_id) LEFT JOIN bq USING (log_id) LEFT JOIN bb USING (log_id)""",
)
_place = "row_number() OVER (PARTITION BY log_id ORDER BY {0}) AS nth"
_lists = [
    ("tip_in", "tip", "row_idx", "row_idx", "CASE WHEN lean THEN 'lean' ELSE 'ok' END", "dtps", 25),
    ("shift", "sh", "row_idx", "row_idx", "from_gear || '-' || to_gear", "flare_rpm", 30),
    ("flared", "(SELECT * FROM sh WHERE flared)", "row_idx", "row_idx", "from_gear || '-' || to_gear", "flare_rpm", 10),
    ("converter", "tbest", "row_idx", "row_idx", "type", "gear", 20),
    ("kickdown", "kick", "row_idx", "row_idx", "CASE WHEN delay_s IS NULL THEN 'none' ELSE 'shift' END", "delay_s", 15),
    ("hunting", "hunt", "row_idx", "row_idx", "least(from_gear, to_gear) || '-' || greatest(from_gear, to_gear)", "reversals", 5),
    ("shift_time", "pt", "pair, row_idx", "row_idx", "pair", "time_s", 10),
    ("fuel", "fuel", "abs(avg_trim) DESC, first_row", "first_row", "rpm_lo || '|' || map_lo", "avg_trim", None),
    ("o2", "oc", "samples DESC, first_row", "first_row", "rpm_lo || '|' || map_lo", "samples", None),
    ("imbalance", "bi", "abs(delta) DESC, first_row", "first_row", "rpm_lo || '|' || map_lo", "delta", None),
]
DETAILS = with_(
    TRANS,
    _cells,
    behind(TIPIN, B.FEATURES),
    O2CELLS,
    SPLIT,
    " UNION ALL ".join(
        f"SELECT * FROM (SELECT log_id, '{name}' AS list, {_place.format(order)}, {row} AS row_idx, {label} AS label, CAST({value} AS DOUBLE) AS value FROM {source})" + (f" WHERE nth <= {limit}" if limit else "") for name, source, order, row, label, value, limit in _lists
    ),
)
_areas = [
    *((r, n, f"{r} < {n}", f"CASE WHEN {r} = 0 THEN '{zero}' ELSE '{some}' END", r) for (r, n), zero, some in zip(Z.ENOUGH_ROWS.items(), ("warn", "warn", "critical"), ("info", "warn", "warn"), strict=True)),
    ("cells", 4, "good_cells IS NOT NULL AND good_cells < 12", "CASE WHEN good_cells < 4 THEN 'warn' ELSE 'info' END", "good_cells"),
]
COVERAGE = with_(
    B.CELLS,
    "rg AS (SELECT log_id, count(*) FILTER (WHERE region = 'idle') AS idle, count(*) FILTER (WHERE region = 'cruise') AS cruise, count(*) FILTER (WHERE region = 'wot') AS wot FROM f GROUP BY log_id)",
    "gc AS (SELECT log_id, count(*) FILTER (WHERE samples >= 20) AS good_cells FROM fuel GROUP BY log_id)",
    "cv AS (SELECT *, CAST(CASE WHEN idle >= 120 THEN 8 ELSE 0 END + CASE WHEN cruise >= 500 THEN 12 ELSE 0 END + CASE WHEN wot >= 30 THEN 20 ELSE 0 END + floor(30 * least(1, coalesce(good_cells, 0) / 12e0) + 0.5) + 30 AS BIGINT) AS raw FROM rg LEFT JOIN gc USING (log_id))",
    "sc AS (SELECT *, CASE WHEN wot = 0 AND raw >= 60 THEN 59 ELSE raw END AS score, CASE WHEN wot = 0 AND raw >= 60 THEN 'thin' WHEN raw >= 85 THEN 'excellent' WHEN raw >= 60 THEN 'good' WHEN raw >= 35 THEN 'thin' ELSE 'poor' END AS verdict FROM cv)",
    "gp AS (" + " UNION ALL ".join(f"SELECT log_id, score, verdict, {k} AS pos, '{area}' AS what, {severity} AS severity, {found} AS found FROM sc WHERE {when}" for k, (area, _, when, severity, found) in enumerate(_areas)) + ")",
    f"st(area, step) AS (VALUES {', '.join(f'''('{area}', '{step}')''' for area, step in Z.STEPS.items())})",
    "SELECT log_id, score, verdict, 'gap' AS kind, what, severity, found, row_number() OVER (PARTITION BY log_id ORDER BY pos) AS nth FROM gp"
    " UNION ALL SELECT log_id, score, verdict, 'step', step, NULL, NULL, row_number() OVER (PARTITION BY log_id ORDER BY pos) FROM gp JOIN st ON st.area = gp.what",
)

for _name, _query, _sql in (("session_report", session_report, recursive(REPORT)), ("session_details", session_details, recursive(DETAILS)), ("coverage_gaps", coverage_gaps, COVERAGE)):
    QUERIES[_name], ORACLES[_name] = _query, _sql
