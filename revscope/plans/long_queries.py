"""Queries over all logs merged into one session and worked on in chunks, each with its comparison SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from revscope.operators import long_sessions as L
from revscope.plans import base_sql as B
from revscope.plans.base_sql import half_up as hu
from revscope.plans.base_sql import with_
from revscope.plans.event_queries import HUNT, SHIFT, TIPIN, recursive
from revscope.sources import merge
from revscope.sources.telemetry import telemetry

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_MERGED = B.T.replace("t AS (", "t0 AS (", 1) + ", t AS (SELECT * REPLACE (CAST(0 AS BIGINT) AS log_id, row_number() OVER (ORDER BY log_id, row_idx) - 1 AS row_idx) FROM t0)"


def of_session(sql: str) -> str:
    """The same statement with all logs as one."""
    return sql.replace(B.T, _MERGED, 1)


def register(name: str, query: Callable[[DataFrame], DataFrame], sql: str) -> None:
    """``query`` takes the features of the merged session."""
    QUERIES[name] = lambda spark, sf_dir: query(L.with_features(L.chunked(merge.merged([telemetry(spark, sf_dir)]).drop(merge.SOURCE))))
    ORACLES[name] = of_session(sql)


def _shifts(f: DataFrame) -> DataFrame:
    return L.shifts(L.chunked(L.gears(f)))


register(
    "merged_knock_events",
    L.knock_events,
    with_(B.KR, f"SELECT log_id, start_row, samples, region, {hu('peak')} AS peak_kr, {hu('total / samples')} AS avg_kr, rpm, {hu('map')} AS map, {hu('dropped')} AS tps_drop, dropped > 10 AS tip_out, samples <= 1 AS suspect_noise FROM ke"),
)
register("merged_shifts", _shifts, recursive(with_(SHIFT, "SELECT * FROM sh")))
register("merged_hunting", lambda f: L.hunting(L.chunked(_shifts(f))), recursive(with_(HUNT, "SELECT * FROM hunt")))
register("merged_tip_ins", lambda f: L.tip_ins(f).drop("o2_before"), recursive(with_(TIPIN, "SELECT * EXCLUDE (o2_before) FROM tip")))
register(
    "merged_time",
    lambda f: L.filled_time(f.drop("chunk")),
    with_(B.T, "SELECT log_id, row_idx, CASE WHEN count(time_s) OVER () >= 0.9 * count(*) OVER () THEN last_value(time_s IGNORE NULLS) OVER (ORDER BY row_idx ROWS UNBOUNDED PRECEDING) ELSE CAST(row_idx AS DOUBLE) END AS play_s FROM t"),
)
