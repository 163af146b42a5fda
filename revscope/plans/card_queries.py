"""Queries for cards, words and ledgers of all modes, each with its comparison SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revscope.operators import cards as K
from revscope.operators import features as X
from revscope.operators import rules as U
from revscope.plans import base_sql as B
from revscope.plans.base_sql import half_up as hu
from revscope.plans.base_sql import with_
from revscope.plans.event_queries import TIPIN, TIPSUM, TRANS, recursive
from revscope.plans.report_queries import ORACLES as REPORTS
from revscope.plans.report_queries import _convergence
from revscope.plans.rule_queries import AESG, ALL, FUEL, MODES, NEAREST, PEEG, PESG, SPARK, TRSG, fuel, spark_rows, suggestions
from revscope.sources.telemetry import telemetry

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, query: Callable[[DataFrame], DataFrame], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: query(X.with_features(telemetry(spark, sf_dir)))
    ORACLES[name] = sql


def _bank(b: int) -> str:
    count = lambda t: f"coalesce(CASE s_{t} WHEN 'multiplier' THEN {t} * 128 WHEN 'percent' THEN 128 + {t} * 1.28e0 ELSE {t} END, 128)"
    return f"{hu(f'avg({count(f"stft_b{b}")} + {count(f"ltft_b{b}")} - 128) FILTER (WHERE stft_b{b} IS NOT NULL OR ltft_b{b} IS NOT NULL)', 1)} AS mean_b{b}"


_mid = lambda t: f"list_sort(list({t}) FILTER (WHERE {t} IS NOT NULL AND row_idx < 2000))[CAST(floor(count({t}) FILTER (WHERE row_idx < 2000) / 2) AS BIGINT) + 1]"
register(
    "full_report_card",
    K.report_card,
    with_(
        B.T,
        "m AS (SELECT log_id, " + ", ".join(f"{_mid(t)} AS m_{t}" for t in X.TRIMS) + " FROM t GROUP BY log_id)",
        "s AS (SELECT log_id, " + ", ".join(f"CASE WHEN m_{t} > 0.5 AND m_{t} < 1.5 THEN 'multiplier' WHEN m_{t} BETWEEN 90 AND 170 THEN 'count128' ELSE 'percent' END AS s_{t}" for t in X.TRIMS) + " FROM m)",
        f"z AS (SELECT log_id, count(*) AS n_rows, CASE WHEN max(time_s) > min(time_s) THEN {hu('max(time_s) - min(time_s)', 1)} END AS duration_s, {_bank(1)}, {_bank(2)} FROM t JOIN s USING (log_id) GROUP BY log_id)",
        f"h AS (SELECT log_id, {', '.join(f'''any_value({c}) FILTER (WHERE bank = 'bank{b}') AS o2_b{b}_{n}''' for b in (1, 2) for c, n in (('per_min', 'per_min'), ('amplitude_mv', 'mv'), ('lazy', 'lazy')))} FROM ({REPORTS['o2_health']}) GROUP BY log_id)",
        f"SELECT z.*, k.events AS knock_events, k.max_kr, h.* EXCLUDE (log_id) FROM z JOIN ({REPORTS['knock_summary']}) k USING (log_id) LEFT JOIN h USING (log_id)",
    ),
)
_OVERLAY = 'ov AS (SELECT log_id, CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS col, count(*) AS events, max(peak_kr) AS peak_kr FROM (SELECT *, (SELECT first(i ORDER BY abs(v - ev.rpm), i) FROM ar) AS r, (SELECT first(i ORDER BY abs(v - ev.map), i) FROM am) AS c FROM ev WHERE rpm IS NOT NULL AND map IS NOT NULL) GROUP BY ALL)'
register("knock_overlay", lambda f: K.knock_overlay(f, U.SPARK_RPM, U.SPARK_MAP), with_(NEAREST, _OVERLAY, "SELECT * FROM ov"))
register(
    "spark_grid",
    lambda f: K.spark_grid(f, spark_rows(f), U.SPARK_RPM, U.SPARK_MAP),
    with_(MODES, NEAREST, SPARK, _OVERLAY, "om AS (SELECT mode, ov.* FROM ov, md)", "mv AS (SELECT mode, log_id, \"row\", col, delta_deg FROM ssg WHERE action <> 'none')", 'SELECT * FROM om FULL JOIN mv USING (mode, log_id, "row", col)'),
)
_words = ", ".join(f"('{kind}', '{what}')" for kind, what in K.JUDGED_BY.items())
register(
    "convergence_words",
    lambda f: K.explained_convergence(_convergence(f)),
    f"""SELECT log_id, kind, table_name, rpm_lo, map_lo, verdict, regexp_replace(lower(table_name), ' ve$', ' VE') || ', ' || CASE WHEN rpm_lo < 2000 THEN 'low rpm' WHEN rpm_lo < 3500 THEN 'mid rpm' ELSE 'high rpm' END || ', ' || CASE WHEN map_lo < 50 THEN 'light load' WHEN map_lo < 80 THEN 'part load' ELSE 'heavy load' END AS region,
 coalesce((SELECT what FROM (VALUES {_words}) AS w(k, what) WHERE k = kind), CASE WHEN kind LIKE 'trans%' THEN 'transmission report' ELSE 'no report' END) AS judged_by FROM ({REPORTS["convergence"]})""",
)
_beyond = lambda sql: sql.removeprefix(B.FEATURES).lstrip(",\n ")
_all = (TRANS, _beyond(TIPIN), TIPSUM, MODES, FUEL, NEAREST, SPARK, PESG, AESG, PEEG, TRSG, ALL)
_names = ", ".join(f"('{kind}', '{word}', '{unit}')" for kind, (word, unit) in K.KIND_WORDS.items())
LINES = f"""fl0 AS (SELECT *, CASE WHEN delta_pct > 0 THEN 'fuel added' ELSE 'fuel taken' END AS kind FROM fsg WHERE action <> 'none'),
fl AS (SELECT mode, log_id, kind, count(*) AS n, first({{'r': rpm_lo, 'm': map_lo, 'd': delta_pct}} ORDER BY abs(delta_pct) DESC, first_row) AS b, array_to_string(list_sort(list(DISTINCT table_name)), ' + ') AS tables FROM fl0 GROUP BY mode, log_id, kind),
li AS (SELECT mode, log_id, kind, kind || printf(': about %.2f %% for ', abs(b.d)) || printf('%d-%d rpm at ', b.r, b.r + 500) || CASE WHEN b.m + 5 < 40 THEN 'light load' WHEN b.m + 5 < 75 THEN 'cruising load' ELSE 'heavy load' END || CASE WHEN n > 1 THEN printf(' and %d similar cells', n - 1) ELSE '' END || ' (' || tables || ')' AS line FROM fl
 UNION ALL SELECT mode, log_id, kind, coalesce(any_value(word), kind) || printf(': %d changes of at most %.2f ', count(*), max(abs(delta))) || coalesce(any_value(unit), '%') FROM al LEFT JOIN (VALUES {_names}) AS w(k, word, unit) ON k = kind WHERE actionable AND kind <> 'fuel' GROUP BY mode, log_id, kind)"""


def _lines(f: DataFrame) -> DataFrame:
    return K.tune_summary(fuel(f), suggestions(f))


register("tune_summary", _lines, recursive(with_(*_all, LINES, "SELECT * FROM li")))
register(
    "tune_headlines",
    lambda f: K.headlines(_lines(f), f),
    recursive(with_(*_all, LINES, "n AS (SELECT mode, log_id, count(*) AS kinds FROM li GROUP BY mode, log_id)", "SELECT mode, l.log_id, coalesce(kinds, 0) AS kinds, CASE WHEN coalesce(kinds, 0) = 0 THEN 'no changes: the log looks healthy' ELSE printf('%d kinds of change', kinds) END AS headline FROM (SELECT DISTINCT log_id FROM t) l CROSS JOIN md LEFT JOIN n USING (mode, log_id)")),
)


def _passes(f: DataFrame) -> DataFrame:
    """Each log is a pass: its fuel and spark changes in every mode, by cell."""
    rows = fuel(f).where("action <> 'none'").select("mode", F.lit("fuel").alias("kind"), F.concat_ws("/", "rpm_lo", "map_lo").alias("cell"), F.col("log_id").alias("pass_no"), F.col("delta_pct").alias("delta"))
    degrees = spark_rows(f).where("action <> 'none'").select("mode", F.lit("spark").alias("kind"), F.concat_ws("/", "row", "col").alias("cell"), F.col("log_id").alias("pass_no"), F.col("delta_deg").alias("delta"))
    return rows.unionByName(degrees)


LEDGER = f"""ps AS (SELECT mode, 'fuel' AS kind, rpm_lo || '/' || map_lo AS cell, log_id AS pass_no, delta_pct AS delta FROM fsg WHERE action <> 'none' UNION ALL SELECT mode, 'spark', "row" || '/' || col, log_id, delta_deg FROM ssg WHERE action <> 'none'),
lc AS (SELECT mode, kind, cell, count(*) AS passes, CASE WHEN kind = 'spark' THEN {hu("sum(delta)")} ELSE {hu("(list_reduce(list_prepend(1e0, list(1 + delta / 100 ORDER BY pass_no)), lambda a, b: a * b) - 1) * 100")} END AS cumulative, CASE kind WHEN 'spark' THEN 6e0 ELSE 15e0 END AS max_change FROM ps GROUP BY mode, kind, cell)"""
register("ledger_by_mode", lambda f: U.ledger_cumulative(_passes(f), ("mode",)), with_(MODES, FUEL, NEAREST, SPARK, LEDGER, "SELECT *, abs(cumulative) >= max_change AS blocked FROM lc"))
register(
    "impact_by_mode",
    lambda f: U.patch_impact(_passes(f), ("mode",)),
    with_(
        MODES, FUEL, NEAREST, SPARK, LEDGER,
        "a AS (SELECT mode, kind, max(abs(delta)) AS max_delta, count(*) AS patches FROM ps GROUP BY mode, kind)",
        "b AS (SELECT mode, kind, max(abs(cumulative)) AS worst, any_value(max_change) AS max_change, first(cell ORDER BY abs(cumulative) DESC, cell) AS worst_cell FROM lc GROUP BY mode, kind)",
        "SELECT *, CASE WHEN worst / max_change >= 1 THEN 'blocked' WHEN worst / max_change >= 0.8 THEN 'warn' ELSE 'ok' END AS grade FROM a JOIN b USING (mode, kind)",
    ),
)
