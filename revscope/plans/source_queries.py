"""Queries for parsing, mapping and merging logs, each with its comparison SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revscope.cluster import scratch_dir
from revscope.operators import rules as U
from revscope.plans import base_sql as B
from revscope.plans.report_queries import with_
from revscope.sources import channels as C
from revscope.sources import delimited as D
from revscope.sources import merge as M
from revscope.sources.telemetry import telemetry

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

HEADERS = ["Time (s)", "Engine RPM", "MAP (kPa)", "TPS %", "ECT (F)", "Note"]
PICKED = dict(zip(["time_s", "rpm", "map", "tps", "ect"], HEADERS, strict=False))


def log_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each log as the text of a delimited file: a title, a comment, the header, a units row, the data."""
    cell = lambda c: F.when(F.col(c).isNotNull(), F.format_string("%.4f", F.col(c))).otherwise("")
    sep = F.when(F.col("log_id") % 2 == 0, ",").otherwise(";")
    quoted = F.concat(F.lit('"a'), sep, F.lit('b"'))
    fields = [cell("time_s"), cell("rpm"), cell("map"), cell("tps"), cell("ect"), quoted]
    joined = lambda parts: F.array_join(F.array(*parts), "\x01")
    rows = telemetry(spark, sf_dir).select("log_id", "row_idx", sep.alias("sep"), F.replace(joined(fields), F.lit("\x01"), sep).alias("line"))
    body = rows.groupBy("log_id", "sep").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", "line"))), lambda x: x["line"]), "\n").alias("body"))
    head = F.replace(joined([F.lit(h) for h in HEADERS]), F.lit("\x01"), F.col("sep"))
    units = F.replace(joined([F.lit(u) for u in ("s", "rpm", "kPa", "%", "F", "-")]), F.lit("\x01"), F.col("sep"))
    return body.select("log_id", F.concat_ws("\n", F.lit("a drive"), F.lit("# comment"), head, units, F.lit(""), "body").alias("text"))


def parsed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.data_rows(D.parse_texts(log_texts(spark, sf_dir)))
    return D.channels(rows, PICKED, ["Note"])


def split_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The logs written as text files, a folder for each, and read back in byte ranges."""
    path = f"{scratch_dir(spark)}/revscope/log-files-{uuid.uuid4().hex}"
    log_texts(spark, sf_dir).select("log_id", F.col("text").alias("value")).repartition("log_id").write.partitionBy("log_id").text(path)
    rows = D.numbered_rows(D.parse_lines(D.read_lines(spark, path)))
    number = F.regexp_extract("log_id", r"log_id=(\d+)", 1).cast("long")
    return D.channels(rows, PICKED, ["Note"]).withColumn("log_id", number)


_f = lambda c: f"CAST(CAST(printf('%.4f', {c}) AS FLOAT) AS DOUBLE)"
QUERIES["parsed_log"] = parsed_log
ORACLES["parsed_log"] = with_(B.T, f"SELECT log_id, row_idx, {_f('time_s')} AS time_s, {_f('rpm')} AS rpm, {_f('map')} AS map, {_f('tps')} AS tps, {_f('ect')} AS ect, CASE WHEN log_id % 2 = 0 THEN 'a,b' ELSE 'a;b' END AS \"Note\" FROM t")
QUERIES["split_files"] = split_files
ORACLES["split_files"] = ORACLES["parsed_log"]
QUERIES["parse_warnings"] = lambda spark, sf_dir: D.warnings(D.parse_texts(log_texts(spark, sf_dir)))
ORACLES["parse_warnings"] = with_(B.T, "SELECT log_id, CAST(0 AS BIGINT) AS long_rows, CAST(1 AS BIGINT) AS unit_rows, count(*) AS data_rows FROM t GROUP BY log_id")
QUERIES["channel_types"] = lambda spark, sf_dir: D.channel_types(D.data_rows(D.parse_texts(log_texts(spark, sf_dir))))
ORACLES["channel_types"] = with_(B.T, "c AS (SELECT log_id, unnest(['Time (s)', 'Engine RPM', 'MAP (kPa)', 'TPS %', 'ECT (F)', 'Note']) AS channel, unnest([count(time_s), count(rpm), count(map), count(tps), count(ect), count(*)]) AS used FROM t GROUP BY log_id)", "SELECT log_id, channel, channel <> 'Note' AS is_numeric, used FROM c")
QUERIES["channel_map"] = lambda spark, sf_dir: C.mapped(C.headers_of(D.file_heads(log_texts(spark, sf_dir))))
ORACLES["channel_map"] = with_(
    B.T,
    "m AS (SELECT * FROM (VALUES ('RPM', 'Engine RPM', 101, 'high'), ('MAP', 'MAP (kPa)', 100, 'high'), ('TPS', 'TPS %', 100, 'high'), ('ECT', 'ECT (F)', 100, 'high')) AS v(signal, header, score, confidence))",
    "SELECT l.log_id, m.* FROM (SELECT DISTINCT log_id FROM t) l, m",
)


def merge_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The logs of even number without their sensor columns, then those of odd number with them: one session."""
    t = telemetry(spark, sf_dir)
    a = t.where("log_id % 2 = 0").select("log_id", "row_idx", "rpm", "map", "tps")
    b = t.where("log_id % 2 = 1").select("log_id", "row_idx", "rpm", "map", F.col("kr").cast("string").alias("kr"))
    return M.merged([a, b])


QUERIES["merge_logs"] = merge_logs
ORACLES["merge_logs"] = with_(
    B.T,
    "u AS (SELECT log_id % 2 AS s, log_id AS l, row_idx AS r, rpm, map, CASE WHEN log_id % 2 = 0 THEN tps END AS tps, CASE WHEN log_id % 2 = 1 THEN CAST(kr AS VARCHAR) END AS kr FROM t)",
    "SELECT CAST(0 AS BIGINT) AS log_id, row_number() OVER (ORDER BY s, l, r) - 1 AS row_idx, rpm, map, tps, kr, CAST(s AS INTEGER) AS _srclog FROM u",
)
QUERIES["axis_coordinate"] = lambda spark, sf_dir: telemetry(spark, sf_dir).where("rpm is not null").select("log_id", "row_idx", U.S.half_up(U.S.axis_coordinate(U.axis(U.SPARK_RPM), F.col("rpm")), 4).alias("x"), U.S.half_up(U.S.axis_coordinate(U.axis(U.SPARK_MAP), F.col("map")), 4).alias("y"))
ORACLES["axis_coordinate"] = with_(B.T, f"SELECT log_id, row_idx, {B.half_up('greatest(0, least(16, rpm / 400))', 4)} AS x, {B.half_up('greatest(0, least(16, (map - 20) / 5))', 4)} AS y FROM t WHERE rpm IS NOT NULL")
