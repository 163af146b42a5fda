"""Queries for events and row-level views, each with its comparison SQL.

The state machines are compared with recursive SQL that walks the rows or the
accepted events one by one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revscope.operators import events as E
from revscope.operators import features as X
from revscope.operators import reports as R
from revscope.plans import base_sql as B
from revscope.plans.base_sql import half_up as hu
from revscope.plans.base_sql import half_up_int as hi
from revscope.plans.report_queries import PE, with_
from revscope.sources.telemetry import telemetry

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, query: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    """``query`` takes the features of all logs."""
    QUERIES[name] = lambda spark, sf_dir: query(X.with_features(telemetry(spark, sf_dir)))
    if sql:
        ORACLES[name] = sql


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


UNITS = """vs0 AS (SELECT *, coalesce(abs(vss - lag(vss) OVER (PARTITION BY log_id ORDER BY row_idx)), 99e0) AS vstep FROM t),
vs1 AS (SELECT log_id, list_sort(list(rpm / vss) FILTER (WHERE vss >= 5 AND (tps IS NULL OR tps BETWEEN 8 AND 35) AND vstep < 1.5 AND rpm > 1200 AND rpm < 2800)) AS l FROM vs0 GROUP BY log_id),
vu AS (SELECT log_id, CASE WHEN l[CAST(floor(len(l) / 2) AS BIGINT) + 1] < 25 THEN 0.621371e0 ELSE 1e0 END AS to_mph FROM vs1)"""
GEAR = (
    B.FEATURES
    + ", "
    + UNITS
    + """,
g0 AS (SELECT f.*, vss * to_mph AS mph, CASE WHEN vss >= 2 AND rpm >= 400 THEN rpm / (vss * to_mph) END AS raw FROM f JOIN vu USING (log_id)),
g1 AS (SELECT *, floor(raw * 100 + 0.5) / 100 AS ratio, raw IS NOT NULL AS ok,
  list_min([{'d': abs(raw - 136), 'g': 1, 'c': 136e0}, {'d': abs(raw - 72), 'g': 2, 'c': 72e0}, {'d': abs(raw - 44.5e0), 'g': 3, 'c': 44.5e0}, {'d': abs(raw - 31), 'g': 4, 'c': 31e0}]) AS b FROM g0),
gin AS (SELECT log_id, row_idx, ok, CASE WHEN raw BETWEEN 12 AND 220 AND b.d <= b.c * 0.28e0 THEN b.g ELSE -1 END AS g FROM g1),
gm AS (
  SELECT log_id, row_idx, CASE WHEN NOT ok THEN 0 ELSE 0 END AS cur, CASE WHEN NOT ok OR g = 0 THEN -1 ELSE g END AS cand, CASE WHEN NOT ok THEN 0 WHEN g = -1 THEN 1 ELSE 1 END AS n FROM gin WHERE row_idx = 0
  UNION ALL
  SELECT x.log_id, x.row_idx,
    CASE WHEN x.ok AND x.g <> m.cur AND x.g = m.cand AND m.n + 1 >= 3 THEN x.g ELSE m.cur END,
    CASE WHEN NOT x.ok OR x.g = m.cur THEN -1 WHEN x.g = m.cand AND m.n + 1 >= 3 THEN -1 ELSE x.g END,
    CASE WHEN NOT x.ok OR x.g = m.cur THEN 0 WHEN x.g = m.cand AND m.n + 1 >= 3 THEN 0 WHEN x.g = m.cand THEN m.n + 1 WHEN x.g = -1 THEN 0 ELSE 1 END
  FROM gm m JOIN gin x ON x.log_id = m.log_id AND x.row_idx = m.row_idx + 1),
gr AS (SELECT g1.*, greatest(gm.cur, 0) AS gear FROM g1 JOIN gm USING (log_id, row_idx))"""
)
SHIFT = (
    GEAR
    + """,
sc0 AS (SELECT *, lag(gear, 4) OVER w AS from_gear, max(rpm) OVER (PARTITION BY log_id ORDER BY row_idx ROWS BETWEEN 12 PRECEDING AND 6 PRECEDING) AS rpm_at,
  max(rpm) OVER (PARTITION BY log_id ORDER BY row_idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS rpm_peak FROM gr WINDOW w AS (PARTITION BY log_id ORDER BY row_idx)),
sc AS (SELECT *, coalesce(greatest(rpm_peak - rpm_at, 0), 0) AS fl FROM sc0 WHERE row_idx >= 5 AND from_gear > 0 AND gear > 0 AND gear <> from_gear),
sacc AS (SELECT log_id, min(row_idx) AS row_idx FROM sc GROUP BY log_id
  UNION ALL SELECT a.log_id, min(c.row_idx) FROM sacc a JOIN sc c ON c.log_id = a.log_id AND c.row_idx - a.row_idx >= 15 GROUP BY a.log_id, a.row_idx),
sh AS (SELECT sc.log_id, sc.row_idx, CAST(from_gear AS INTEGER) AS from_gear, gear AS to_gear, rpm_at, floor(mph * 100 + 0.5) / 100 AS mph, tps, CAST(floor(fl + 0.5) AS BIGINT) AS flare_rpm, gear > from_gear AND fl >= 150 AS flared
  FROM sc JOIN sacc USING (log_id, row_idx))"""
)
TCC = (
    GEAR
    + """,
tc0 AS (SELECT *, list_sort(list(ratio) FILTER (WHERE ratio IS NOT NULL) OVER (PARTITION BY log_id ORDER BY row_idx ROWS BETWEEN 16 PRECEDING AND 9 PRECEDING)) AS la,
  list_sort(list(ratio) FILTER (WHERE ratio IS NOT NULL) OVER (PARTITION BY log_id ORDER BY row_idx ROWS BETWEEN 8 PRECEDING AND CURRENT ROW)) AS lb,
  lag(gear, 16) OVER (PARTITION BY log_id ORDER BY row_idx) AS gear_before FROM gr),
tc1 AS (SELECT *, la[CAST(floor(len(la) / 2) AS BIGINT) + 1] AS ma, lb[CAST(floor(len(lb) / 2) AS BIGINT) + 1] AS mb FROM tc0
  WHERE gear >= 3 AND gear = gear_before AND (tps IS NULL OR tps <= 45) AND mph >= 30 AND len(la) >= 5 AND len(lb) >= 5),
tc AS (SELECT log_id, row_idx, gear, CASE WHEN (ma - mb) / ma > 0.06 THEN 'apply' ELSE 'release' END AS type FROM tc1 WHERE abs((ma - mb) / ma) > 0.06),
tacc AS (SELECT log_id, row_idx, type FROM tc WHERE (log_id, row_idx) IN (SELECT (log_id, min(row_idx)) FROM tc GROUP BY log_id)
  UNION ALL SELECT log_id, m.row_idx, m.type FROM (SELECT a.log_id, min({'row_idx': c.row_idx, 'type': c.type}) AS m FROM tacc a JOIN tc c ON c.log_id = a.log_id AND c.row_idx - a.row_idx >= 40 AND c.type <> a.type GROUP BY a.log_id, a.row_idx) q),
tcc AS (SELECT tacc.*, tc.gear FROM tacc JOIN tc USING (log_id, row_idx))"""
)
STATED = """cs AS (SELECT log_id, row_idx, tcc > 50 AS locked, lag(tcc > 50) OVER (PARTITION BY log_id ORDER BY row_idx) AS before, count(*) OVER (PARTITION BY log_id) AS seen, gear FROM gr WHERE tcc IS NOT NULL),
cev AS (SELECT log_id, row_idx, CASE WHEN locked THEN 'apply' ELSE 'release' END AS type, CASE WHEN gear > 0 THEN gear END AS gear FROM cs WHERE seen > 10 AND locked <> before),
tbest AS (SELECT log_id, row_idx, type, gear, 'inferred' AS source FROM tcc WHERE log_id NOT IN (SELECT log_id FROM cs WHERE seen > 10) UNION ALL SELECT *, 'channel' FROM cev)"""
TIPIN = (
    B.FEATURES
    + """,
ti0 AS (SELECT *, list(tps) FILTER (WHERE tps IS NOT NULL) OVER (PARTITION BY log_id ORDER BY row_idx ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS ahead,
  min(o2_b1) OVER (PARTITION BY log_id ORDER BY row_idx ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS mo, avg(o2_b1) OVER (PARTITION BY log_id ORDER BY row_idx ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS o2_before FROM f),
tic AS (SELECT * FROM ti0 WHERE tps - prev_tps >= 10 AND len(list_filter(ahead, lambda x: x >= prev_tps + 5)) >= 3),
tia AS (SELECT log_id, min(row_idx) AS row_idx FROM tic GROUP BY log_id
  UNION ALL SELECT a.log_id, min(c.row_idx) FROM tia a JOIN tic c ON c.log_id = a.log_id AND c.row_idx - a.row_idx >= 20 GROUP BY a.log_id, a.row_idx),
tip AS (SELECT tic.log_id, tic.row_idx, floor((tps - prev_tps) * 100 + 0.5) / 100 AS dtps, floor(prev_tps * 100 + 0.5) / 100 AS tps_from, floor(tps * 100 + 0.5) / 100 AS tps_to, rpm,
  CAST(floor(mo + 0.5) AS BIGINT) AS min_o2, coalesce(mo < 250, false) AS lean, coalesce(ect < warm_at, false) AS cold, o2_before FROM tic JOIN tia USING (log_id, row_idx))"""
)
KICK = (
    SHIFT
    + """,
stab AS (SELECT f.*, to_mph FROM f JOIN vu USING (log_id) WHERE tps - prev_tps >= 20 AND tps >= 40),
kd AS (SELECT s.log_id, s.row_idx, floor(any_value(s.prev_tps) * 100 + 0.5) / 100 AS tps_from, floor(any_value(s.tps) * 100 + 0.5) / 100 AS tps_to, floor(any_value(s.vss * s.to_mph) * 100 + 0.5) / 100 AS mph, min(d.row_idx) AS down_row
  FROM stab s LEFT JOIN sh d ON d.log_id = s.log_id AND d.to_gear < d.from_gear AND d.row_idx BETWEEN s.row_idx AND s.row_idx + 20 GROUP BY s.log_id, s.row_idx),
kick AS (SELECT *, floor((down_row - row_idx) * 0.145e0 * 100 + 0.5) / 100 AS delay_s FROM kd)"""
)
#: Reversals are counted for every shift as a start; the skip over an episode follows the accepted starts.
HUNT = (
    SHIFT
    + """,
hs AS (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY row_idx) AS i, least(from_gear, to_gear) AS lo, greatest(from_gear, to_gear) AS hi, to_gear > from_gear AS up, lag(to_gear > from_gear) OVER (PARTITION BY log_id ORDER BY row_idx) AS up_before FROM sh),
hr AS (SELECT a.log_id, a.i, any_value(a.row_idx) AS row_idx, any_value(a.from_gear) AS from_gear, any_value(a.to_gear) AS to_gear, any_value(a.mph) AS mph, any_value(a.tps) AS tps, count(b.i) AS rev
  FROM hs a LEFT JOIN hs b ON b.log_id = a.log_id AND b.i > a.i AND b.row_idx - a.row_idx < 300 AND b.lo = a.lo AND b.hi = a.hi AND b.up <> b.up_before GROUP BY a.log_id, a.i),
hq AS (SELECT * FROM hr WHERE rev >= 3 AND (tps IS NULL OR tps < 40)),
ha AS (SELECT log_id, min({'i': i, 'rev': rev}) AS m FROM hq GROUP BY log_id
  UNION ALL SELECT a.log_id, min({'i': c.i, 'rev': c.rev}) FROM ha a JOIN hq c ON c.log_id = a.log_id AND c.i > a.m.i + a.m.rev GROUP BY a.log_id, a.m),
hunt AS (SELECT hq.log_id, row_idx, from_gear, to_gear, mph, tps, CAST(rev + 1 AS INTEGER) AS reversals FROM hq JOIN ha ON ha.log_id = hq.log_id AND ha.m.i = hq.i)"""
)

register("gear_inference", lambda f: E.gears(f).select("log_id", "row_idx", "ratio", "gear"), recursive(with_(GEAR, "SELECT log_id, row_idx, ratio, gear FROM gr")))
register("gear_histogram", lambda f: E.gear_histogram(E.gears(f)), recursive(with_(GEAR, "SELECT log_id, gear, count(*) AS n_rows FROM gr WHERE gear > 0 GROUP BY log_id, gear")))
register("shift_events", lambda f: E.shifts(E.gears(f)), recursive(with_(SHIFT, "SELECT * FROM sh")))
register("tcc_events", lambda f: E.converter_events(E.gears(f)), recursive(with_(TCC, "SELECT log_id, row_idx, type, gear FROM tcc")))
register("tcc_channel_events", lambda f: E.best_converter_events(E.gears(f)), recursive(with_(TCC, STATED, "SELECT log_id, row_idx, type, gear, source FROM tbest")))
register("kickdown_events", lambda f: E.kickdowns(f, E.shifts(E.gears(f))), recursive(with_(KICK, "SELECT * FROM kick")))
register("shift_hunting", lambda f: E.hunting(E.shifts(E.gears(f))), recursive(with_(HUNT, "SELECT * FROM hunt")))
register("tipin_events", lambda f: E.tip_ins(f).drop("o2_before"), recursive(with_(TIPIN, "SELECT * EXCLUDE (o2_before) FROM tip")))
TIPSUM = f"tsum AS (SELECT l.log_id, count(tip.log_id) AS events, count(*) FILTER (WHERE NOT cold) AS warm_events, count(*) FILTER (WHERE lean) AS lean_events, {hi('avg(min_o2) FILTER (WHERE lean)')} AS avg_min_o2, {hi('avg(dtps)')} AS avg_dtps, {hu('coalesce(count(*) FILTER (WHERE lean) / nullif(count(tip.log_id), 0), 0)')} AS lean_fraction, {hu('coalesce(count(*) FILTER (WHERE lean AND NOT cold) / nullif(count(*) FILTER (WHERE NOT cold), 0), 0)')} AS warm_lean_fraction FROM (SELECT DISTINCT log_id FROM t) l LEFT JOIN tip ON tip.log_id = l.log_id GROUP BY l.log_id)"
register("tipin_summary", lambda f: E.tip_in_summary(f, E.tip_ins(f)), recursive(with_(TIPIN, TIPSUM, "SELECT * FROM tsum")))
AE = f"ae AS (SELECT log_id, row_idx, {hu('dtps / 0.145e0', 1)} AS tps_per_s, greatest(0, {hi('o2_before - min_o2')}) AS lean_depth_mv, lean FROM tip WHERE o2_before IS NOT NULL AND min_o2 IS NOT NULL)"
register("ae_scatter", lambda f: E.ae_scatter(E.tip_ins(f)), recursive(with_(TIPIN, AE, "SELECT * FROM ae")))
register(
    "ae_trend",
    lambda f: E.ae_trend(E.ae_scatter(E.tip_ins(f))),
    recursive(with_(TIPIN, AE, f"s AS (SELECT log_id, count(*) AS points, count(*) FILTER (WHERE lean) AS lean_points, {hu('corr(tps_per_s, lean_depth_mv)', 4)} AS r FROM ae GROUP BY log_id)", "SELECT *, CASE WHEN r >= 0.3 THEN 'deeper' WHEN r <= -0.3 THEN 'shallower' ELSE 'none' END AS trend FROM s")),
)
_times = "pt AS (" + " UNION ALL ".join(f"SELECT log_id, row_idx, '{p}' AS pair, floor({c} * 1000 + 0.5) / 1000 AS time_s FROM (SELECT *, lag({c}) OVER (PARTITION BY log_id ORDER BY row_idx) AS pv FROM f) WHERE {c} > 0 AND abs({c} - pv) > 0.005" for p, c in (("1-2", "shift_t12"), ("2-3", "shift_t23"))) + ")"
register("pcm_shift_times", E.shift_times, with_(B.FEATURES, _times, "SELECT * FROM pt"))
register(
    "shift_histograms",
    lambda f: E.shift_histograms(E.shift_times(f), E.shifts(E.gears(f))),
    recursive(
        with_(
            SHIFT,
            _times,
            "fl AS (SELECT log_id, from_gear || '-' || to_gear AS pair, row_idx AS r FROM sh WHERE flared)",
            "pl AS (SELECT *, EXISTS (SELECT 1 FROM fl WHERE fl.log_id = pt.log_id AND fl.pair = pt.pair AND abs(fl.r - pt.row_idx) <= 40) AS linked FROM pt)",
            f"s AS (SELECT log_id, pair, count(*) AS count, {hu('median(time_s)', 4)} AS median_s, min(time_s) AS min_s, max(time_s) AS max_s, count(*) FILTER (WHERE linked) AS near_flare FROM pl GROUP BY log_id, pair)",
            "n AS (SELECT log_id, pair, count(*) AS c FROM fl GROUP BY log_id, pair)",
            "SELECT s.*, coalesce(c, 0) AS flares, median_s > CASE pair WHEN '1-2' THEN 0.9 WHEN '2-3' THEN 0.6 ELSE 0.9 END AS slow FROM s LEFT JOIN n USING (log_id, pair)",
        )
    ),
)
register(
    "shift_time_bins",
    lambda f: E.shift_time_bins(E.shift_times(f)),
    with_(B.FEATURES, _times, "r AS (SELECT *, min(time_s) OVER (PARTITION BY log_id, pair) AS lo, (max(time_s) OVER (PARTITION BY log_id, pair) - min(time_s) OVER (PARTITION BY log_id, pair)) / 8 AS w FROM pt)", "SELECT log_id, pair, CAST(CASE WHEN w = 0 THEN 0 ELSE least(floor((time_s - lo) / w), 7) END AS INTEGER) AS bin, count(*) AS count FROM r GROUP BY ALL"),
)
TRANS = (
    KICK
    + ", "
    + HUNT.removeprefix(SHIFT).lstrip(",\n ")
    + ", "
    + TCC.removeprefix(GEAR).lstrip(",\n ")
    + ", "
    + STATED
    + f""",
tn AS (SELECT log_id, count(*) FILTER (WHERE type = 'apply') AS tcc_applies, count(*) FILTER (WHERE type = 'release') AS tcc_releases, count(*) FILTER (WHERE c) AS tcc_cycles FROM (SELECT *, row_idx - lag(row_idx) OVER w < 300 AND type <> lag(type) OVER w AS c FROM tbest WINDOW w AS (PARTITION BY log_id ORDER BY row_idx)) GROUP BY log_id),
sn AS (SELECT log_id, count(*) AS shifts, count(*) FILTER (WHERE to_gear > from_gear) AS upshifts, count(*) FILTER (WHERE to_gear < from_gear) AS downshifts, count(*) FILTER (WHERE flared) AS flared,
  {", ".join(f"{hi(f'avg(rpm_at) FILTER (WHERE from_gear = {k} AND to_gear = {k + 1})')} AS shift_rpm_{k}{k + 1}" for k in (1, 2, 3))}, first(mph ORDER BY flare_rpm DESC, row_idx) FILTER (WHERE flared) AS worst_flare_mph FROM sh GROUP BY log_id),
kn AS (SELECT log_id, count(*) AS kickdowns, count(*) FILTER (WHERE down_row IS NULL) AS no_kickdown, {hu("avg(delay_s)")} AS avg_kickdown_s, list_sort(list(mph))[CAST(floor(count(mph) / 2) AS BIGINT) + 1] AS kickdown_mph FROM kick GROUP BY log_id),
hn AS (SELECT log_id, count(*) AS hunting, first(tps ORDER BY row_idx) AS hunting_tps, first(least(from_gear, to_gear) || '-' || greatest(from_gear, to_gear) ORDER BY row_idx) AS hunting_pair FROM hunt GROUP BY log_id),
{_times},
pn AS (SELECT log_id, {", ".join(f"list_sort(list(time_s) FILTER (WHERE pair = '{q}'))[CAST(floor(count(*) FILTER (WHERE pair = '{q}') / 2) AS BIGINT) + 1] AS pcm_s_{q[0]}{q[2]}" for q in ("1-2", "2-3"))} FROM pt GROUP BY log_id),
trn AS (SELECT log_id, coalesce(shifts, 0) AS shifts, coalesce(upshifts, 0) AS upshifts, coalesce(downshifts, 0) AS downshifts, coalesce(flared, 0) AS flared, shift_rpm_12, shift_rpm_23, shift_rpm_34, worst_flare_mph, coalesce(kickdowns, 0) AS kickdowns, coalesce(no_kickdown, 0) AS no_kickdown, avg_kickdown_s, kickdown_mph,
  coalesce(tcc_applies, 0) AS tcc_applies, coalesce(tcc_releases, 0) AS tcc_releases, coalesce(tcc_cycles, 0) AS tcc_cycles, coalesce(hunting, 0) AS hunting, hunting_tps, hunting_pair, pcm_s_12, pcm_s_23
  FROM (SELECT DISTINCT log_id FROM t) LEFT JOIN sn USING (log_id) LEFT JOIN kn USING (log_id) LEFT JOIN tn USING (log_id) LEFT JOIN hn USING (log_id) LEFT JOIN pn USING (log_id))"""
)
register("transmission_report", E.transmission, recursive(with_(TRANS, "SELECT * FROM trn")))
CRANK = (
    B.FEATURES
    + ","
    + B.styled("f", "ft")
    + f""",
cr0 AS (SELECT *, row_idx - row_number() OVER (PARTITION BY log_id ORDER BY row_idx) AS run FROM f WHERE NOT is_warm AND region <> 'transient' AND rpm > 0 AND rpm <= 450),
cr AS (SELECT log_id, run, min(row_idx) AS start_row, max(row_idx) AS end_row, count(*) AS samples, max(time_s) - min(time_s) AS took FROM cr0 GROUP BY log_id, run),
go AS (SELECT cr.log_id, cr.run, min(f.row_idx) AS go_row FROM cr JOIN f ON f.log_id = cr.log_id AND f.rpm > 400 AND f.row_idx BETWEEN end_row + 1 AND end_row + 200 GROUP BY cr.log_id, cr.run),
aft AS (SELECT go.log_id, go.run, ft.rpm, (trim_b1 + trim_b2) / 2 AS trim, ft.time_s - g.time_s AS dt FROM go JOIN f g ON g.log_id = go.log_id AND g.row_idx = go_row JOIN ft ON ft.log_id = go.log_id AND ft.row_idx >= go_row AND ft.time_s - g.time_s <= 30),
cs2 AS (SELECT log_id, run, max(rpm) FILTER (WHERE dt <= 3) AS top, median(rpm) FILTER (WHERE dt >= 10) AS settled, {hu("avg(trim) FILTER (WHERE dt <= 20)")} AS trim_after FROM aft GROUP BY log_id, run),
crk AS (SELECT cr.log_id, start_row, samples, {hu("took")} AS duration_s, {hi("top - settled")} AS rpm_flare, trim_after, top IS NOT NULL AS started FROM cr LEFT JOIN cs2 USING (log_id, run)),
cv2 AS (SELECT l.log_id, count(start_row) AS cranks, bool_or(started AND duration_s > 3) AS long, bool_or(started AND rpm_flare < 200) AS weak FROM (SELECT DISTINCT log_id FROM t) l LEFT JOIN crk ON crk.log_id = l.log_id GROUP BY l.log_id),
crv AS (SELECT log_id, cranks, CASE WHEN cranks = 0 THEN 'no-crank-detected' WHEN long THEN 'long-crank' WHEN weak THEN 'weak-flare' ELSE 'healthy' END AS verdict FROM cv2)"""
)
register("crank_events", E.cranks, with_(CRANK, "SELECT * FROM crk"))
register("crank_verdict", E.crank_verdict, with_(CRANK, "SELECT * FROM crv"))
_KR = B.KR.removeprefix(B.FEATURES).lstrip(",\n ")
register(
    "playback_events",
    E.playback_ticks,
    recursive(
        with_(
            TIPIN,
            _KR,
            PE.removeprefix(B.FEATURES).lstrip(",\n "),
            "u AS (SELECT log_id, start_row AS row_idx, 0 AS rank, 'knock' AS type, samples FROM ke UNION ALL SELECT log_id, row_idx, 1, 'tipin', 1 FROM tip UNION ALL SELECT log_id, start_row, 2, 'pe', samples FROM pe)",
            "SELECT log_id, row_idx, type, samples, CAST(row_number() OVER (PARTITION BY log_id ORDER BY row_idx, rank) AS INTEGER) AS nth FROM u",
        )
    ),
)
_frame = "OVER (PARTITION BY log_id ORDER BY row_idx ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)"
register("trailing_window", lambda f: E.trailing(f, "rpm"), with_(B.T, f"SELECT log_id, row_idx, min(rpm) {_frame} AS low, max(rpm) {_frame} AS high, last_value(rpm IGNORE NULLS) {_frame} AS latest FROM t"))
register(
    "knock_drilldown",
    lambda f: E.around_events(f, R.knock_events(f)),
    with_(B.KR, 'SELECT e.log_id, e.start_row, f.row_idx, f.row_idx - e.start_row AS "at", f.rpm, f.map, f.tps, f.kr FROM ke e JOIN f ON f.log_id = e.log_id AND abs(f.row_idx - e.start_row) <= 50'),
)
register(
    "forward_fill_time",
    lambda f: E.filled_time(f.withColumn("time_s", F.when(F.col("row_idx") % 13 != 0, F.col("time_s")))),
    with_(B.T, "x AS (SELECT log_id, row_idx, CASE WHEN row_idx % 13 <> 0 THEN time_s END AS v FROM t)", "SELECT log_id, row_idx, CASE WHEN count(v) OVER (PARTITION BY log_id) >= 0.9 * count(*) OVER (PARTITION BY log_id) THEN last_value(v IGNORE NULLS) OVER (PARTITION BY log_id ORDER BY row_idx ROWS UNBOUNDED PRECEDING) ELSE CAST(row_idx AS DOUBLE) END AS play_s FROM x"),
)
register(
    "bucket_downsample",
    lambda f: E.spike_downsample(f, "rpm"),
    with_(
        B.T,
        "s AS (SELECT *, CAST(floor(row_idx / ceil(count(*) OVER (PARTITION BY log_id) / 100)) AS BIGINT) AS bucket FROM t)",
        "e AS (SELECT log_id, bucket, first(row_idx ORDER BY rpm, row_idx) AS a, first(row_idx ORDER BY rpm DESC, row_idx) AS b FROM s WHERE rpm IS NOT NULL GROUP BY log_id, bucket)",
        "k AS (SELECT log_id, a AS row_idx FROM e UNION SELECT log_id, b FROM e)",
        "SELECT log_id, row_idx, rpm AS v FROM k JOIN t USING (log_id, row_idx)",
    ),
)
register("stride_sample", lambda f: E.stride_sample(f, "map"), with_(B.T, "s AS (SELECT *, greatest(1, CAST(ceil(count(*) OVER (PARTITION BY log_id) / 120) AS BIGINT)) AS step FROM t)", "SELECT log_id, row_idx, map AS v FROM s WHERE row_idx % step = 0"))


def _probes(f: DataFrame) -> DataFrame:
    return E.as_of(f, f.select("log_id", (F.col("time_s") + 0.07).alias("at_s")))


register("asof_lookup", _probes, with_(B.T, "p AS (SELECT log_id, time_s + 0.07e0 AS at_s FROM t)", "SELECT p.log_id, p.at_s, t.row_idx, t.rpm FROM p ASOF JOIN t ON p.log_id = t.log_id AND p.at_s >= t.time_s"))
PE_TABLE = [(800.0 + 400 * k, 12.5 + 0.1 * (k % 3)) for k in range(17)]
register(
    "wot_verify",
    lambda f: E.commanded_afr(f, PE_TABLE),
    with_(
        B.FEATURES,
        "w0 AS (SELECT *, row_idx - row_number() OVER (PARTITION BY log_id ORDER BY row_idx) AS run FROM f WHERE tps >= 60)",
        "w1 AS (SELECT log_id, min(row_idx) AS start_row, count(*) AS samples, avg(cmd_afr) AS afr, avg(rpm) AS rpm FROM w0 WHERE cmd_afr / 14.7e0 < 0.95 GROUP BY log_id, run)",
        f"ax AS (SELECT unnest({[r for r, _ in PE_TABLE]}) AS r, unnest({[a for _, a in PE_TABLE]}) AS a)",
        "w2 AS (SELECT w1.*, (SELECT first(a ORDER BY abs(r - w1.rpm), r) FROM ax) AS want FROM w1)",
        f"SELECT log_id, start_row, samples, {hu('afr')} AS afr, {hi('rpm')} AS rpm, want AS table_afr, {hu('afr - want')} AS error, abs(afr - want) <= 0.3 AS matches FROM w2",
    ),
)
