"""Queries for the reports, each with its comparison SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revscope.operators import features as X
from revscope.operators import reports as R
from revscope.plans import base_sql as B
from revscope.plans.base_sql import half_up as hu
from revscope.plans.base_sql import half_up_int as hi
from revscope.plans.base_sql import with_
from revscope.sources.telemetry import telemetry

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def on_features(report: Callable[[DataFrame], DataFrame], *drop: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: report(X.with_features(telemetry(spark, sf_dir))).drop(*drop)


def register(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


register(
    "scan_log",
    lambda spark, sf_dir: R.scan_log(telemetry(spark, sf_dir)),
    with_(B.T, "SELECT log_id, count(*) AS n_rows, count(*) FILTER (WHERE rpm IS NULL) AS rpm_missing, count(*) FILTER (WHERE tps IS NULL) AS tps_missing, count(*) FILTER (WHERE ect IS NULL) AS ect_missing, min(time_s) AS first_s, max(time_s) AS last_s FROM t GROUP BY log_id"),
)
register(
    "region_distribution",
    on_features(R.region_distribution),
    with_(B.FEATURES, B.LOGS, B.REGIONS, "SELECT dom.log_id, dom.region, count(f.log_id) AS n_rows FROM dom LEFT JOIN f ON dom.log_id = f.log_id AND dom.region = f.region GROUP BY ALL"),
)
_counts = {b: f"(CASE s_stft_b{b} WHEN 'multiplier' THEN stft_b{b} * 128 WHEN 'percent' THEN 128 + stft_b{b} * 1.28e0 ELSE stft_b{b} END + CASE s_ltft_b{b} WHEN 'multiplier' THEN ltft_b{b} * 128 WHEN 'percent' THEN 128 + ltft_b{b} * 1.28e0 ELSE ltft_b{b} END - 128)" for b in (1, 2)}
register(
    "segment_breakdown",
    on_features(R.segment_breakdown),
    with_(
        B.FEATURES,
        B.styled("f", "ft"),
        B.LOGS,
        "dom AS (SELECT log_id, segment FROM logs, (VALUES ('idle'), ('cruise'), ('wot'), ('decel'), ('other')) AS r(segment))",
        f"sums AS (SELECT log_id, segment, count(*) AS n, {hu('avg(' + _counts[1] + ')', 1)} AS trim_b1, {hu('avg(' + _counts[2] + ')', 1)} AS trim_b2 FROM ft GROUP BY log_id, segment)",
        f"SELECT log_id, segment, coalesce(n, 0) AS n_rows, trim_b1, trim_b2, {hu('100e0 * coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY log_id)', 1)} AS share_pct FROM dom LEFT JOIN sums USING (log_id, segment)",
    ),
)
register("fuel_trim_cells", on_features(R.fuel_trim_cells), with_(B.CELLS, "SELECT * FROM fuel"))
register(
    "trim_heatmap",
    on_features(R.trim_heatmap),
    with_(
        B.CELLS,
        f"h AS (SELECT log_id, rpm_lo, map_lo, count(*) AS samples, {hu('avg((ltft_b1 + ltft_b2) / 2)')} AS long_trim, {hu('avg((stft_b1 + stft_b2) / 2)')} AS short_trim FROM c GROUP BY ALL)",
        "span AS (SELECT log_id, min(rpm_lo) AS r0, max(rpm_lo) AS r1, min(map_lo) AS m0, max(map_lo) AS m1 FROM c GROUP BY log_id)",
        "g1 AS (SELECT log_id, unnest(generate_series(r0, r1, 500)) AS rpm_lo, m0, m1 FROM span)",
        "grid AS (SELECT log_id, rpm_lo, unnest(generate_series(m0, m1, 10)) AS map_lo FROM g1)",
        "SELECT log_id, rpm_lo, map_lo, coalesce(samples, 0) AS samples, long_trim, short_trim, coalesce(samples, 0) < 25 AS thin FROM grid LEFT JOIN h USING (log_id, rpm_lo, map_lo)",
    ),
)
register(
    "knock_events",
    on_features(R.knock_events, "peak", "total"),
    with_(B.KR, f"SELECT log_id, start_row, samples, region, {hu('peak')} AS peak_kr, {hu('total / samples')} AS avg_kr, rpm, {hu('map')} AS map, {hu('dropped')} AS tps_drop, dropped > 10 AS tip_out, samples <= 1 AS suspect_noise FROM ke"),
)
register(
    "knock_by_region",
    on_features(R.knock_by_region),
    with_(
        B.KR,
        B.LOGS,
        B.REGIONS,
        f"s AS (SELECT log_id, region, CAST(sum(samples) AS BIGINT) AS n, count(*) AS e, {hu('max(peak)')} AS m FROM ke GROUP BY log_id, region)",
        "SELECT log_id, region, coalesce(n, 0) AS samples, coalesce(e, 0) AS events, coalesce(m, 0e0) AS max_kr FROM dom LEFT JOIN s USING (log_id, region)",
    ),
)
register(
    "knock_summary",
    on_features(R.knock_summary),
    with_(
        B.KR,
        "z AS (SELECT log_id, count(*) AS n_rows FROM f GROUP BY log_id)",
        "s AS (SELECT log_id, CAST(sum(samples) AS BIGINT) AS a, count(*) AS e, max(peak) AS m, sum(total) AS tot FROM ke GROUP BY log_id)",
        f"SELECT log_id, n_rows, coalesce(a, 0) AS active, coalesce(e, 0) AS events, {hu('100e0 * coalesce(a, 0) / n_rows')} AS knock_pct, {hu('coalesce(m, 0)')} AS max_kr, {hu('coalesce(tot / a, 0)')} AS avg_kr FROM z LEFT JOIN s USING (log_id)",
    ),
)
_lam = "CASE WHEN {0} > 5 THEN {0} / 14.7e0 WHEN {0} > 0.3 AND {0} < 2.5 THEN {0} END"
_pairs = f"l AS (SELECT * FROM (SELECT *, {_lam.format('wb_afr')} - {_lam.format('cmd_afr')} AS err FROM f) WHERE err IS NOT NULL)"
register("lambda_error", on_features(R.lambda_error), with_(B.FEATURES, _pairs, f"SELECT log_id, count(*) AS samples, {hu('avg(abs(err))', 3)} AS mean_abs_error, {hu('100 * avg(CASE WHEN abs(err) <= 0.03e0 THEN 1e0 ELSE 0e0 END)')} AS pct_within_3 FROM l GROUP BY log_id"))
register(
    "lambda_by_region",
    on_features(R.lambda_by_region),
    with_(B.FEATURES, _pairs, B.LOGS, B.REGIONS, f"s AS (SELECT log_id, region, count(*) AS n, {hu('avg(abs(err))', 3)} AS avg_abs_error FROM l GROUP BY log_id, region)", "SELECT log_id, region, coalesce(n, 0) AS samples, avg_abs_error FROM dom LEFT JOIN s USING (log_id, region)"),
)
register(
    "o2_cells",
    on_features(R.o2_cells),
    with_(
        B.GATED,
        "m AS (SELECT log_id, CAST(floor(rpm / 500) * 500 AS BIGINT) AS rpm_lo, CAST(floor(map / 10) * 10 AS BIGINT) AS map_lo, CASE WHEN o2_b1 IS NULL THEN o2_b2 WHEN o2_b2 IS NULL THEN o2_b1 ELSE (o2_b1 + o2_b2) / 2 END AS mv FROM g WHERE rpm IS NOT NULL AND map IS NOT NULL)",
        "s AS (SELECT log_id, rpm_lo, map_lo, count(*) AS samples, avg(mv) AS mv, 100 * avg(CASE WHEN mv > 600 THEN 1e0 ELSE 0e0 END) AS rich, 100 * avg(CASE WHEN mv < 300 THEN 1e0 ELSE 0e0 END) AS lean FROM m WHERE mv IS NOT NULL GROUP BY ALL)",
        f"SELECT log_id, rpm_lo, map_lo, samples, {hi('mv')} AS avg_mv, {hu('rich')} AS pct_rich, {hu('lean')} AS pct_lean, CASE WHEN mv > 600 AND rich > 60 THEN 'rich' WHEN mv < 350 AND lean > 60 THEN 'lean' ELSE 'switching' END AS bias FROM s",
    ),
)
register(
    "o2_cross_counts",
    on_features(R.o2_cross_counts),
    with_(
        B.GATED,
        "gg AS (SELECT * FROM g WHERE region IN ('cruise', 'idle'))",
        f"bk AS ({B.BANKS.format('gg')})",
        "x AS (SELECT *, coalesce((mv > 450) <> lag(mv > 450) OVER (PARTITION BY log_id, bank ORDER BY row_idx), false) AS crossed FROM bk)",
        "s AS (SELECT log_id, bank, count(*) AS samples, count(*) FILTER (WHERE crossed) AS crossings, arg_min(time_s, row_idx) AS t0, arg_max(time_s, row_idx) AS t1 FROM x GROUP BY log_id, bank)",
        f"r AS (SELECT *, CASE WHEN samples > 30 THEN {hu('crossings / CASE WHEN t1 > t0 THEN (t1 - t0) / 60 ELSE samples / 600e0 END')} END AS per_min FROM s)",
        "SELECT log_id, bank, samples, crossings, per_min, CASE WHEN per_min >= 30 THEN 'healthy' WHEN per_min >= 10 THEN 'lazy' WHEN per_min IS NOT NULL THEN 'dead/slow' ELSE 'unknown' END AS health FROM r",
    ),
)
register(
    "wot_richness",
    on_features(R.wot_richness),
    with_(
        B.GATED,
        B.LOGS,
        "gg AS (SELECT * FROM g WHERE region = 'wot')",
        f"bk AS ({B.BANKS.format('gg')})",
        "s AS (SELECT log_id, count(*) AS n, avg(mv) AS mv, avg(CASE WHEN mv > 700 THEN 1e0 ELSE 0e0 END) AS rich FROM bk GROUP BY log_id)",
        f"SELECT log_id, coalesce(n, 0) AS samples, CASE WHEN n >= 10 THEN {hi('mv')} END AS avg_mv, CASE WHEN n >= 10 THEN {hu('100 * rich')} END AS pct_rich, CASE WHEN coalesce(n, 0) < 10 THEN 'no wot data' WHEN mv > 700 THEN 'rich' WHEN mv > 550 THEN 'marginal' ELSE 'lean' END AS status FROM logs LEFT JOIN s USING (log_id)",
    ),
)
PE = (
    B.FEATURES
    + f""", p0 AS (SELECT *, {_lam.format("cmd_afr")} AS lam, row_idx - row_number() OVER (PARTITION BY log_id ORDER BY row_idx) AS run FROM f WHERE tps >= 60),
pe AS (SELECT log_id, min(row_idx) AS start_row, count(*) AS samples, min(row_idx) FILTER (WHERE lam < 0.95) AS pe_row FROM p0 GROUP BY log_id, run HAVING count(*) >= 7)"""
)
register("pe_episodes", on_features(R.pe_episodes), with_(PE, "SELECT * FROM pe"))
register(
    "pe_entry",
    on_features(R.pe_entry),
    with_(
        PE,
        B.LOGS,
        "s AS (SELECT log_id, count(*) AS n, count(pe_row) AS e, avg(pe_row - start_row) AS d FROM pe GROUP BY log_id)",
        f"SELECT log_id, coalesce(n, 0) AS episodes, coalesce(e, 0) AS engaged, {hu('coalesce(e / n, 0)')} AS engage_fraction, {hu('d')} AS avg_delay_rows, {hu('d * 0.145e0')} AS avg_delay_s FROM logs LEFT JOIN s USING (log_id)",
    ),
)
register(
    "bank_imbalance",
    on_features(R.bank_imbalance),
    with_(
        B.CELLS,
        "s AS (SELECT log_id, rpm_lo, map_lo, count(*) FILTER (WHERE coalesce(stft_b1, ltft_b1) IS NOT NULL) AS samples1, count(*) FILTER (WHERE coalesce(stft_b2, ltft_b2) IS NOT NULL) AS samples2, avg(trim_b1) FILTER (WHERE coalesce(stft_b1, ltft_b1) IS NOT NULL) AS m1, avg(trim_b2) FILTER (WHERE coalesce(stft_b2, ltft_b2) IS NOT NULL) AS m2 FROM c GROUP BY ALL)",
        f"SELECT log_id, rpm_lo, map_lo, samples1, samples2, {hu('m1')} AS bank1_avg, {hu('m2')} AS bank2_avg, {hu('m1 - m2')} AS delta, CASE WHEN m1 > m2 THEN 1 ELSE 2 END AS lean_bank FROM s WHERE samples1 >= 15 AND samples2 >= 15 AND abs(m1 - m2) >= 5",
    ),
)
register(
    "baro_check",
    on_features(R.baro_check),
    with_(
        B.FEATURES,
        "s AS (SELECT log_id, count(*) FILTER (WHERE baro > 20 AND baro < 120) AS samples, list_sort(list(baro) FILTER (WHERE baro > 20 AND baro < 120)) AS l, count(*) FILTER (WHERE tps >= 78 AND map IS NOT NULL) AS fn, max(map) FILTER (WHERE tps >= 78) AS fp FROM f GROUP BY log_id)",
        "m AS (SELECT *, l[CAST(floor(len(l) / 2) AS BIGINT) + 1] AS mid, l[len(l)] - l[1] AS span, 101.325e0 * pow(1 - 2.25577e-5 * (900 * 0.3048e0), 5.25588e0) AS e FROM s)",
        f"SELECT log_id, samples, {hu('e', 1)} AS expected_kpa, CASE WHEN samples >= 10 THEN {hu('mid', 1)} END AS median_kpa, CASE WHEN samples >= 10 THEN {hu('mid - e', 1)} END AS delta_kpa, CASE WHEN samples >= 10 THEN span >= 8 END AS drifted, CASE WHEN samples >= 10 THEN coalesce(fn >= 10 AND fp > mid + 5, false) END AS wot_flag, CASE WHEN samples >= 10 THEN CASE WHEN abs(mid - e) >= 5 THEN 'fault' WHEN abs(mid - e) >= 3 OR coalesce(fn >= 10 AND fp > mid + 5, false) THEN 'warn' ELSE 'ok' END END AS status FROM m",
    ),
)
register(
    "o2_health",
    on_features(R.o2_health),
    with_(
        B.FEATURES,
        "hot AS (SELECT * FROM f WHERE ect IS NULL OR ect > 160)",
        f"bk AS ({B.BANKS.format('hot')})",
        "x AS (SELECT *, last_value(CASE WHEN mv > 500 THEN true WHEN mv < 400 THEN false END IGNORE NULLS) OVER (PARTITION BY log_id, bank ORDER BY row_idx ROWS UNBOUNDED PRECEDING) AS latch FROM bk)",
        "y AS (SELECT *, coalesce(latch <> lag(latch) OVER (PARTITION BY log_id, bank ORDER BY row_idx), false) AS sw FROM x)",
        "s AS (SELECT log_id, bank, count(*) AS samples, count(*) FILTER (WHERE sw) AS switches, avg(mv) FILTER (WHERE mv > 500) AS hi, avg(mv) FILTER (WHERE mv < 400) AS lo, arg_min(time_s, row_idx) AS t0, arg_max(time_s, row_idx) AS t1 FROM y GROUP BY log_id, bank)",
        "z AS (SELECT *, switches / CASE WHEN t1 > t0 THEN (t1 - t0) / 60 ELSE samples * 0.145e0 / 60 END AS rate, coalesce(hi - lo, 0) AS amp FROM s)",
        f"SELECT log_id, bank, samples, switches, CASE WHEN samples >= 30 THEN {hu('rate')} END AS per_min, CASE WHEN samples >= 30 THEN {hi('hi')} END AS avg_high_mv, CASE WHEN samples >= 30 THEN {hi('lo')} END AS avg_low_mv, CASE WHEN samples >= 30 THEN {hi('amp')} END AS amplitude_mv, CASE WHEN samples >= 30 THEN rate < 15 OR amp < 600 END AS lazy FROM z",
    ),
)
_wbins = f"wb AS (SELECT log_id, CAST(floor(ect / 10) * 10 AS BIGINT) AS ect_lo, count(*) AS samples, {hu('avg(trim)')} AS avg_trim FROM ctr WHERE ect IS NOT NULL GROUP BY ALL)"
register("warmup_bins", on_features(R.warmup_bins), with_(B.COLD, _wbins, "SELECT * FROM wb"))
register(
    "warmup_slope",
    on_features(R.warmup_slope),
    with_(
        B.COLD,
        _wbins,
        "n AS (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY ect_lo) AS nth, count(*) OVER (PARTITION BY log_id) AS bins FROM wb WHERE samples >= 3)",
        "s AS (SELECT log_id, bins, regr_slope(avg_trim, ect_lo + 5e0) AS slope, avg(avg_trim) FILTER (WHERE nth <= greatest(1, floor(bins / 3))) AS early, arg_max(avg_trim, nth) AS late_trim FROM n GROUP BY log_id, bins)",
        f"SELECT log_id, bins, {hu('slope * 10')} AS slope_per_10, {hu('early')} AS early_trim, late_trim, CASE WHEN late_trim > 8 THEN 'stuck-lean' WHEN late_trim < -8 THEN 'stuck-rich' ELSE 'decaying-sensibly' END AS verdict FROM s WHERE bins >= 2",
    ),
)
register(
    "overfueling",
    on_features(R.overfueling),
    with_(
        B.COLD,
        f"s AS (SELECT log_id, count(*) AS samples, {hu('avg(trim)')} AS avg_trim, {hu('min(trim)')} AS peak_rich, avg(CASE WHEN trim < -8 THEN 1e0 ELSE 0e0 END) AS rich, {hu('avg(CASE WHEN abs(trim) < 0.5 THEN 1e0 ELSE 0e0 END)')} AS frozen_fraction FROM ctr GROUP BY log_id)",
        f"SELECT log_id, samples, avg_trim, peak_rich, frozen_fraction, CASE WHEN samples >= 10 THEN {hu('rich')} END AS sustained, samples >= 10 AND avg_trim < -10 AS flagged FROM s",
    ),
)
register(
    "idle_stability",
    on_features(R.idle_stability),
    with_(
        B.FEATURES,
        "s AS (SELECT log_id, count(*) AS samples, avg(iac) AS i, avg(rpm) AS r, sqrt(greatest(0, avg(rpm * rpm) - avg(rpm) * avg(rpm))) AS sd FROM f WHERE is_idle AND is_warm AND iac IS NOT NULL AND rpm IS NOT NULL GROUP BY log_id)",
        f"SELECT log_id, samples, {hu('i', 1)} AS avg_iac, {hi('r')} AS avg_rpm, {hu('sd', 1)} AS rpm_stddev, CAST(700 AS BIGINT) AS target_rpm, CASE WHEN samples < 20 THEN 'ok' WHEN sd > 60 THEN 'unstable-idle' WHEN i > 70 AND r < 625 THEN 'throttle-misadjusted-suspect' WHEN i > 70 THEN 'vacuum-leak-suspect' ELSE 'ok' END AS verdict FROM s",
    ),
)
DUTY = (
    B.FEATURES
    + """, d AS (SELECT *, CASE WHEN max(inj_dc) OVER (PARTITION BY log_id) <= 1.5 THEN inj_dc * 100 ELSE inj_dc END AS duty FROM f WHERE inj_dc >= 0),
oc AS (SELECT log_id, CAST(floor(rpm / 400) * 400 AS BIGINT) AS rpm_lo, CAST(floor(map / 10) * 10 AS BIGINT) AS map_lo, count(*) AS samples, floor(max(duty) * 10 + 0.5) / 10 AS duty FROM d WHERE rpm IS NOT NULL AND map IS NOT NULL GROUP BY ALL HAVING count(*) >= 5 AND max(duty) >= 80)"""
)
register("injector_cells", on_features(R.injector_cells), with_(DUTY, "SELECT * FROM oc"))
register(
    "injector_headroom",
    on_features(R.injector_headroom),
    with_(
        DUTY,
        f"p AS (SELECT log_id, count(*) AS samples, {hu('max(duty)', 1)} AS peak_duty, {hi('first(rpm ORDER BY duty DESC, row_idx)')} AS peak_rpm, {hi('first(map ORDER BY duty DESC, row_idx)')} AS peak_map FROM d GROUP BY log_id)",
        "o AS (SELECT log_id, count(*) AS n, max(duty) AS worst FROM oc GROUP BY log_id)",
        "SELECT log_id, samples, peak_duty, peak_rpm, peak_map, coalesce(n, 0) AS over_cells, CASE WHEN worst >= 90 THEN 'critical' WHEN n > 0 THEN 'watch' ELSE 'ok' END AS verdict FROM p LEFT JOIN o USING (log_id)",
    ),
)
_key = ["rpm", "map", "tps", "o2_b1", "o2_b2", "ect", "vss", "stft_b1", "stft_b2", "ltft_b1", "ltft_b2", "cmd_afr", "iac", "inj_dc"]
HEALTH = with_(
    B.T,
    "u AS (" + " UNION ALL ".join(f"SELECT log_id, row_idx, '{c}' AS channel, {c} AS v FROM t" for c in _key) + ")",
    "u1 AS (SELECT *, CASE WHEN v IS NULL THEN row_idx - row_number() OVER (PARTITION BY log_id, channel, v IS NULL ORDER BY row_idx) END AS run FROM u)",
    "u2 AS (SELECT *, CASE WHEN v IS NULL THEN count(*) OVER (PARTITION BY log_id, channel, run) END AS len FROM u1)",
    "st AS (SELECT log_id, channel, count(*) AS n, count(v) AS usable, max(len) AS longest, max(v) - min(v) AS rng, 1 - count(v) / count(*) AS missing, channel IN ('rpm', 'map', 'tps') AS key FROM u2 GROUP BY log_id, channel)",
    "dr AS (SELECT log_id, channel, 'dropout' AS code, CASE WHEN usable = 0 AND key THEN 'block' WHEN usable = 0 THEN 'warn' WHEN missing >= 0.5 AND key THEN 'block' WHEN missing >= 0.05 THEN 'warn' WHEN missing >= 0.01 OR longest >= 10 THEN 'info' END AS severity FROM st)",
    "fl AS (SELECT log_id, channel, 'flatline' AS code, CASE WHEN usable < 30 THEN NULL WHEN channel = 'rpm' AND rng <= 5 THEN 'block' WHEN channel = 'map' AND rng <= 2 THEN 'warn' WHEN channel = 'tps' AND rng <= 1 THEN 'info' WHEN channel IN ('o2_b1', 'o2_b2') AND rng <= 30 THEN 'info' END AS severity FROM st)",
    "ti AS (SELECT *, time_s - lag(time_s) OVER (PARTITION BY log_id ORDER BY row_idx) AS step FROM t)",
    "tm AS (SELECT log_id, count(*) AS n, count(*) FILTER (WHERE step <= 0) AS backward, list_sort(list(step) FILTER (WHERE step > 0)) AS l, max(time_s) - min(time_s) AS span FROM ti GROUP BY log_id)",
    "tg AS (SELECT ti.log_id, count(*) AS gaps, max(step) AS widest FROM ti JOIN tm USING (log_id) WHERE step > 3 * l[CAST(floor(len(l) / 2) AS BIGINT) + 1] AND step > 0.5 GROUP BY ti.log_id)",
    """ck AS (SELECT log_id, 'time_s' AS channel, 'clock' AS code, CASE WHEN backward > 0 THEN 'warn' END AS severity FROM tm
 UNION ALL SELECT log_id, 'time_s', 'gap', CASE WHEN gaps >= 3 OR widest >= 2 THEN 'warn' WHEN gaps > 0 THEN 'info' END FROM tg
 UNION ALL SELECT log_id, 'time_s', 'sample-rate', CASE WHEN n < 2 THEN 'info' WHEN NOT span > 0 OR span / (n - 1) > 0.5 OR span / (n - 1) < 0.05 THEN 'warn' END FROM tm)""",
    "iss AS (SELECT * FROM (SELECT * FROM dr UNION ALL SELECT * FROM fl UNION ALL SELECT * FROM ck) WHERE severity IS NOT NULL)",
    "{0}",
)
register("health_issues", lambda spark, sf_dir: R.health_issues(telemetry(spark, sf_dir)), HEALTH.replace("{0}", "SELECT * FROM iss"))
register(
    "log_health",
    lambda spark, sf_dir: R.log_health(telemetry(spark, sf_dir)),
    HEALTH.replace(
        "{0}",
        "SELECT l.log_id, count(*) FILTER (WHERE severity = 'block') AS block, count(*) FILTER (WHERE severity = 'warn') AS warn, count(*) FILTER (WHERE severity = 'info') AS info, greatest(0, 100 - 40 * count(*) FILTER (WHERE severity = 'block') - 12 * count(*) FILTER (WHERE severity = 'warn') - 3 * count(*) FILTER (WHERE severity = 'info')) AS score, count(*) FILTER (WHERE severity = 'block') > 0 AS blocked FROM (SELECT DISTINCT log_id FROM t) l LEFT JOIN iss ON iss.log_id = l.log_id GROUP BY l.log_id",
    ),
)
COVERAGE = (
    B.CELLS
    + """, rg AS (SELECT log_id, count(*) FILTER (WHERE region = 'idle') AS idle, count(*) FILTER (WHERE region = 'cruise') AS cruise, count(*) FILTER (WHERE region = 'wot') AS wot FROM f GROUP BY log_id),
gc AS (SELECT log_id, count(*) FILTER (WHERE samples >= 20) AS good_cells, count(*) AS cells FROM fuel GROUP BY log_id),
cv AS (SELECT log_id, idle, cruise, wot, coalesce(good_cells, 0) AS good_cells, coalesce(cells, 0) AS cells,
  CASE WHEN idle >= 120 THEN 8 ELSE 0 END + CASE WHEN cruise >= 500 THEN 12 ELSE 0 END + CASE WHEN wot >= 30 THEN 20 ELSE 0 END + CAST(floor(30 * least(1, coalesce(good_cells, 0) / 12e0) + 0.5) AS BIGINT) + 30 AS raw
  FROM rg LEFT JOIN gc USING (log_id)),
cov AS (SELECT log_id, idle, cruise, wot, good_cells, cells, CASE WHEN wot = 0 AND raw >= 60 THEN 59 ELSE raw END AS score, CASE WHEN wot = 0 AND raw >= 60 THEN 'thin' WHEN raw >= 85 THEN 'excellent' WHEN raw >= 60 THEN 'good' WHEN raw >= 35 THEN 'thin' ELSE 'poor' END AS verdict FROM cv)"""
)
register("coverage_score", on_features(R.coverage_score), with_(COVERAGE, "SELECT * FROM cov"))


EARLIER = "ea AS (SELECT log_id, lag(log_id) OVER (ORDER BY log_id) AS earlier FROM (SELECT DISTINCT log_id FROM t))"
register(
    "compare_logs",
    on_features(R.compare_cells),
    with_(
        B.CELLS,
        EARLIER,
        f"s AS (SELECT log_id, rpm_lo, map_lo, count(*) AS n, {hu('128 + avg(trim) * 1.28e0')} AS tr FROM c GROUP BY ALL)",
        "a AS (SELECT ea.log_id, rpm_lo, map_lo, n AS samples_a, tr AS trim_a FROM ea JOIN s ON s.log_id = ea.earlier)",
        "b AS (SELECT log_id, rpm_lo, map_lo, n AS samples_b, tr AS trim_b FROM ea JOIN s USING (log_id) WHERE earlier IS NOT NULL)",
        f"SELECT log_id, rpm_lo, map_lo, samples_a, trim_a, samples_b, trim_b, {hu('trim_b - trim_a')} AS delta, CASE WHEN trim_b - trim_a IS NULL THEN 'single' WHEN abs(trim_b - trim_a) < 1 THEN 'unchanged' WHEN abs(trim_b - 128) < abs(trim_a - 128) THEN 'improved' ELSE 'worse' END AS verdict FROM a FULL JOIN b USING (log_id, rpm_lo, map_lo)",
    ),
)


def _convergence(f: DataFrame) -> DataFrame:
    """Patches that take back half of each log's trims, and one of a kind that trims cannot judge, against the log behind it."""
    cells = R.fuel_trim_cells(f)
    fuel = cells.where("samples >= 20").select("log_id", F.lit("fuel").alias("kind"), F.lit("Main VE").alias("table_name"), "rpm_lo", "map_lo", (F.col("avg_trim") / 2).alias("delta"))
    spark = f.select("log_id").distinct().select("log_id", F.lit("spark").alias("kind"), F.lit("Spark Advance").alias("table_name"), F.lit(2000).cast("long").alias("rpm_lo"), F.lit(50).cast("long").alias("map_lo"), F.lit(-1.0).alias("delta"))
    return R.convergence(cells, fuel.unionByName(spark), R.with_earlier(f.select("log_id").distinct(), f))


register(
    "convergence",
    on_features(_convergence),
    with_(
        B.CELLS,
        EARLIER,
        "p AS (SELECT log_id AS old, 'fuel' AS kind, 'Main VE' AS table_name, rpm_lo, map_lo, avg_trim / 2 AS delta FROM fuel WHERE samples >= 20 UNION ALL SELECT log_id, 'spark', 'Spark Advance', 2000, 50, -1e0 FROM ea)",
        "j AS (SELECT p.kind, p.table_name, ea.log_id, p.rpm_lo, p.map_lo, CAST(1 AS BIGINT) AS patches, p.delta, b.avg_trim AS trim_before, b.samples AS samples_before, a.avg_trim AS trim_after, a.samples AS samples_after FROM p JOIN ea ON ea.earlier = p.old LEFT JOIN fuel b ON b.log_id = p.old AND b.rpm_lo = p.rpm_lo AND b.map_lo = p.map_lo LEFT JOIN fuel a ON a.log_id = ea.log_id AND a.rpm_lo = p.rpm_lo AND a.map_lo = p.map_lo)",
        f"k AS (SELECT *, CASE WHEN kind = 'fuel' THEN {hu('abs(trim_before) - abs(trim_after)')} END AS improvement, CASE WHEN kind <> 'fuel' THEN 'not-judged-by-trims' WHEN trim_before IS NULL OR trim_after IS NULL OR samples_after < 20 THEN 'inconclusive' WHEN trim_before * trim_after < 0 AND abs(trim_after) < 3 THEN 'crossed' WHEN trim_before * trim_after < 0 THEN 'overshot' WHEN abs(trim_before) - abs(trim_after) >= 3 THEN 'closer' WHEN abs(trim_before) - abs(trim_after) <= -3 THEN 'further' ELSE 'unmoved' END AS detail FROM j)",
        "SELECT *, CASE WHEN detail IN ('inconclusive', 'not-judged-by-trims') THEN 'inconclusive' WHEN detail IN ('crossed', 'closer') THEN 'converged' ELSE 'not-converged' END AS verdict FROM k",
    ),
)
KNOCK_SUMMARY = f"ks AS (SELECT log_id, count(*) AS n_rows, coalesce(any_value(a), 0) AS active, coalesce(any_value(e), 0) AS events, {hu('100e0 * coalesce(any_value(a), 0) / count(*)')} AS knock_pct, {hu('coalesce(any_value(m), 0)')} AS max_kr FROM k1 LEFT JOIN (SELECT log_id, sum(samples) AS a, count(*) AS e, max(peak) AS m FROM ke GROUP BY log_id) USING (log_id) GROUP BY log_id)"
_KR_ONLY = B.KR.removeprefix(B.FEATURES).lstrip(",\n ")
register(
    "session_metrics",
    on_features(R.session_metrics),
    with_(
        COVERAGE,
        _KR_ONLY,
        KNOCK_SUMMARY,
        _pairs,
        f"fu AS (SELECT log_id, {hu('avg(abs(trim))')} AS abs_trim FROM c GROUP BY log_id)",
        f"la AS (SELECT log_id, {hu('avg(abs(err))', 3)} AS mean_abs_error FROM l GROUP BY log_id)",
        "m AS (SELECT log_id, knock_pct, max_kr, abs_trim, mean_abs_error, score AS coverage FROM ks LEFT JOIN fu USING (log_id) LEFT JOIN la USING (log_id) JOIN cov USING (log_id))",
        "SELECT *, " + ", ".join(f"lag({c}) OVER (ORDER BY log_id) AS prev_{c}" for c in ("knock_pct", "max_kr", "abs_trim", "mean_abs_error", "coverage")) + " FROM m",
    ),
)
register(
    "report_card",
    on_features(R.report_card),
    with_(
        B.CELLS,
        _KR_ONLY,
        KNOCK_SUMMARY,
        f"tr AS (SELECT log_id, {hu('avg(trim)')} AS mean_trim FROM c GROUP BY log_id)",
        f"o AS (SELECT log_id, {hu('max(time_s) - min(time_s)', 1)} AS duration_s, {hi('avg(o2_b1)')} AS o2_b1_mv, {hi('avg(o2_b2)')} AS o2_b2_mv FROM f GROUP BY log_id)",
        "SELECT log_id, duration_s, o2_b1_mv, o2_b2_mv, mean_trim, events, max_kr FROM o LEFT JOIN tr USING (log_id) JOIN ks USING (log_id)",
    ),
)
register(
    "vss_unit",
    lambda spark, sf_dir: X.vss_units(telemetry(spark, sf_dir)),
    with_(
        B.T,
        "s AS (SELECT *, coalesce(abs(vss - lag(vss) OVER (PARTITION BY log_id ORDER BY row_idx)), 99e0) AS step FROM t)",
        "l AS (SELECT log_id, list_sort(list(rpm / vss) FILTER (WHERE vss >= 5 AND (tps IS NULL OR tps BETWEEN 8 AND 35) AND step < 1.5 AND rpm > 1200 AND rpm < 2800)) AS l FROM s GROUP BY log_id)",
        "m AS (SELECT log_id, l[CAST(floor(len(l) / 2) AS BIGINT) + 1] AS cruise_ratio FROM l)",
        "SELECT *, CASE WHEN cruise_ratio < 25 THEN 0.621371e0 ELSE 1e0 END AS to_mph, CASE WHEN cruise_ratio < 25 THEN 'kph->mph' ELSE 'mph' END AS unit FROM m",
    ),
)
register("kr_scale", lambda spark, sf_dir: X.kr_scales(telemetry(spark, sf_dir)), with_(B.KR, "SELECT log_id, raw_counts, CASE WHEN raw_counts THEN 0.175781e0 ELSE 1e0 END AS scale FROM krs"))
register("trim_style", lambda spark, sf_dir: X.trim_styles(telemetry(spark, sf_dir)), with_(B.T, B.styled("t", "ts"), "SELECT log_id, " + ", ".join(f"s_{c} AS {c}_style" for c in X.TRIMS) + " FROM ts_d"))
register(
    "gate_counts",
    on_features(X.gate_counts),
    with_(B.FEATURES, "SELECT log_id, count(*) FILTER (WHERE region = 'transient') AS transient_rows, count(*) FILTER (WHERE region <> 'transient' AND NOT is_warm) AS cold_rows, count(*) FILTER (WHERE region <> 'transient' AND is_warm) AS kept_rows FROM f GROUP BY log_id"),
)
