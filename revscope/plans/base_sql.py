"""Common table expressions that the comparison SQL of several queries starts from."""

from __future__ import annotations

from revscope.sources.telemetry import PROJECTION

T = "t AS (" + PROJECTION.replace("{events}", "events") + ")"

FEATURES = (
    T
    + """,
f0 AS (SELECT *, lag(tps) OVER w AS prev_tps, lag(map) OVER w AS prev_map, max(ect) OVER (PARTITION BY log_id) AS max_ect
  FROM t WINDOW w AS (PARTITION BY log_id ORDER BY row_idx)),
f1 AS (SELECT *, CASE WHEN max_ect > 140 THEN 160e0 ELSE max_ect - 10 END AS warm_at,
  CASE WHEN rpm IS NULL THEN 'cruise'
       WHEN coalesce(abs(tps - prev_tps) >= 8, false) OR coalesce(abs(map - prev_map) >= 8, false) THEN 'transient'
       WHEN tps >= 78 THEN 'wot'
       WHEN rpm < 1100 AND (tps IS NULL OR tps < 5) AND (map IS NULL OR map < 50) THEN 'idle' ELSE 'cruise' END AS region,
  CASE WHEN rpm IS NULL OR tps IS NULL OR vss IS NULL THEN 'other'
       WHEN rpm < 1450 AND tps < 2 AND vss < 3 THEN 'idle' WHEN tps > 70 THEN 'wot'
       WHEN tps < 2 AND rpm > 1500 AND vss > 10 THEN 'decel' WHEN vss > 3 AND tps BETWEEN 2 AND 70 THEN 'cruise' ELSE 'other' END AS segment,
  coalesce(rpm < 1450 AND (tps IS NULL OR tps < 2) AND (vss IS NULL OR vss < 3), false) AS is_idle
  FROM f0),
f AS (SELECT *, coalesce(ect >= warm_at, true) AS is_warm FROM f1)"""
)


def styled(source: str, name: str) -> str:
    """CTEs that add bank trims in percent to ``source`` under ``name``."""
    trims = ["stft_b1", "ltft_b1", "stft_b2", "ltft_b2"]
    counts = ", ".join(f"count({t}) OVER w AS n_{t}" for t in trims)
    mids = ", ".join(f"list_sort(list({t}) FILTER (WHERE {t} IS NOT NULL AND n_{t} <= 500)) AS l_{t}" for t in trims)
    picks = ", ".join(f"l_{t}[CAST(floor(len(l_{t}) / 2) AS BIGINT) + 1] AS m_{t}" for t in trims)
    style = ", ".join(f"CASE WHEN m_{t} > 0.5 AND m_{t} < 1.5 THEN 'multiplier' WHEN m_{t} BETWEEN 90 AND 170 THEN 'count128' ELSE 'percent' END AS s_{t}" for t in trims)
    pct = {t: f"coalesce(CASE s_{t} WHEN 'multiplier' THEN ({t} - 1) * 100 WHEN 'count128' THEN ({t} - 128) / 128 * 100 ELSE {t} END, 0)" for t in trims}
    return f"""
{name}_a AS (SELECT log_id, {", ".join(trims)}, {counts} FROM {source} WINDOW w AS (PARTITION BY log_id ORDER BY row_idx ROWS UNBOUNDED PRECEDING)),
{name}_b AS (SELECT log_id, {mids} FROM {name}_a GROUP BY log_id),
{name}_c AS (SELECT log_id, {picks} FROM {name}_b),
{name}_d AS (SELECT log_id, {style} FROM {name}_c),
{name} AS (SELECT *, {pct["stft_b1"]} + {pct["ltft_b1"]} AS trim_b1, {pct["stft_b2"]} + {pct["ltft_b2"]} AS trim_b2 FROM {source} JOIN {name}_d USING (log_id))"""


GATED = FEATURES + ", g AS (SELECT * FROM f WHERE region <> 'transient' AND is_warm)"
CELLS = (
    GATED
    + ","
    + styled("g", "gt")
    + """,
c AS (SELECT *, CAST(floor(rpm / 500) * 500 AS BIGINT) AS rpm_lo, CAST(floor(map / 10) * 10 AS BIGINT) AS map_lo, (trim_b1 + trim_b2) / 2 AS trim
  FROM gt WHERE rpm IS NOT NULL AND map IS NOT NULL),
fuel AS (SELECT log_id, rpm_lo, map_lo, count(*) AS samples, floor(avg(trim) * 100 + 0.5) / 100 AS avg_trim,
  floor(sqrt(greatest(0, avg(trim * trim) - avg(trim) * avg(trim))) * 100 + 0.5) / 100 AS stddev,
  floor(avg(CASE WHEN is_idle THEN 1e0 ELSE 0e0 END) * 100 + 0.5) / 100 AS idle_fraction, min(row_idx) AS first_row
  FROM c GROUP BY log_id, rpm_lo, map_lo)"""
)
COLD = FEATURES + ", cold AS (SELECT * FROM f WHERE NOT is_warm AND region <> 'transient')," + styled("cold", "ct") + ", ctr AS (SELECT *, (trim_b1 + trim_b2) / 2 AS trim FROM ct)"
LOGS = "logs AS (SELECT DISTINCT log_id FROM t)"
REGIONS = "dom AS (SELECT log_id, region FROM logs, (VALUES ('cruise'), ('transient'), ('wot'), ('idle')) AS r(region))"
KR = (
    FEATURES
    + """,
k0 AS (SELECT *, count(CASE WHEN kr > 0 THEN 1 END) OVER (PARTITION BY log_id ORDER BY row_idx ROWS UNBOUNDED PRECEDING) AS nth FROM f),
krs AS (SELECT log_id, coalesce(bool_and(kr = floor(kr)) FILTER (WHERE kr > 0 AND nth <= 2000), false) AS raw_counts FROM k0 GROUP BY log_id),
k1 AS (SELECT f.*, kr * CASE WHEN raw_counts THEN 0.175781e0 ELSE 1e0 END AS deg FROM f JOIN krs USING (log_id)),
k2 AS (SELECT *, row_idx - row_number() OVER (PARTITION BY log_id ORDER BY row_idx) AS run FROM k1 WHERE deg > 0.5),
kreg AS (SELECT log_id, run, arg_max(region, n * 1000000 - first) AS region FROM (
  SELECT log_id, run, region, count(*) AS n, min(row_idx) AS first FROM k2 GROUP BY ALL) GROUP BY log_id, run),
kev AS (SELECT log_id, run, min(row_idx) AS start_row, count(*) AS samples, max(deg) AS peak, sum(deg) AS total,
  first(rpm ORDER BY deg DESC, row_idx) AS rpm, first(map ORDER BY deg DESC, row_idx) AS map,
  coalesce(first(tps ORDER BY row_idx) FILTER (WHERE tps IS NOT NULL) - last(tps ORDER BY row_idx) FILTER (WHERE tps IS NOT NULL), 0) AS dropped
  FROM k2 GROUP BY log_id, run),
ke AS (SELECT * FROM kev JOIN kreg USING (log_id, run))"""
)
BANKS = "SELECT *, 'bank1' AS bank, o2_b1 AS mv FROM {0} WHERE o2_b1 IS NOT NULL UNION ALL SELECT *, 'bank2' AS bank, o2_b2 AS mv FROM {0} WHERE o2_b2 IS NOT NULL"


def with_(*parts: str) -> str:
    return "WITH " + ", ".join(p.strip().strip(",") for p in parts[:-1]) + "\n" + parts[-1]


def half_up(x: str, places: int = 2) -> str:
    scale = 10**places
    return f"floor(({x}) * {scale}e0 + 0.5e0) / {scale}e0"


def half_up_int(x: str) -> str:
    return f"CAST(floor(({x}) + 0.5e0) AS BIGINT)"
