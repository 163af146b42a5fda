"""Delimited text logs of any number of files: delimiter, header, rows and channel types, found per file in one plan.

A table of texts holds a file as one row until it is split into lines; files under a
path are read line by line in byte ranges, so that one file may be longer than any
task could take. From there on everything is per line. Nothing is probed on the driver and files may differ in
delimiter, header and columns: a row's cells stay in a map until channels are
picked by name.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from revscope.cluster import ship_package
from revscope.functions import scalars as S
from revscope.operators import order

DELIMITERS = [",", "\t", ";", "|"]
_OUTSIDE_QUOTES = '(?=(?:[^"]*"[^"]*")*[^"]*$)'


def _fields(line: Column, delimiter: Column) -> Column:
    """Fields of a line: quoted ones may hold the delimiter, doubled quotes are quotes, blanks around are cut."""
    quoted, plain = F.lit(None).cast("array<string>"), F.lit(None).cast("array<string>")
    for d in DELIMITERS:
        quoted = F.when(delimiter == d, F.split(line, ("\\|" if d == "|" else d) + _OUTSIDE_QUOTES, -1)).otherwise(quoted)
        plain = F.when(delimiter == d, F.split(line, "\\|" if d == "|" else d, -1)).otherwise(plain)
    unquoted = lambda f: F.replace(F.replace(F.replace(f, F.lit('""'), F.lit("\x00")), F.lit('"'), F.lit("")), F.lit("\x00"), F.lit('"'))
    return F.when(F.contains(line, F.lit('"')), F.transform(quoted, lambda f: F.trim(unquoted(F.trim(f))))).otherwise(F.transform(plain, lambda f: F.trim(f)))


def split_fields(line: str, delimiter: str) -> list[str]:
    """The same cut as ``_fields`` makes, for the few lines that a header is looked for in."""
    out, held = [], ""
    for part in line.split(delimiter):
        held = held + delimiter + part if held else part
        if held.count('"') % 2 == 0:
            out.append(held.strip().replace('""', "\x00").replace('"', "").replace("\x00", '"').strip())
            held = ""
    return [*out, held.strip()] if held else out


def detected_delimiter(lines: list[str]) -> str:
    """The delimiter that cuts the first five lines most evenly into most fields; the first one on ties."""

    def score(d: str) -> float:
        counts = [line.count(d) + 1 for line in lines[:5]]
        mean = sum(counts) / len(counts)
        return mean / (1 + sum((c - mean) ** 2 for c in counts) / len(counts)) if mean > 1 else -1.0

    return max(DELIMITERS, key=score) if lines and max(map(score, DELIMITERS)) > -1 else DELIMITERS[0]


def deduplicated(headers: list[str]) -> list[str]:
    """Empty names become col_i, repeated ones name_1, name_2 and so on."""
    seen: dict[str, int] = {}
    out = []
    for i, h in enumerate(headers):
        name = h or f"col_{i}"
        n = seen.get(name, -1) + 1
        seen[name] = n
        out.append(f"{name}_{n}" if n else name)
    return out


def file_heads(texts: DataFrame) -> DataFrame:
    """(log_id, lines, delimiter, header_at, headers) of each file; only its first ten lines are looked at."""
    lines = F.filter(F.split(F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n", "\n"), "\n", -1), lambda line: ~F.trim(line).rlike("^([#;]|$)"))
    files = texts.select("log_id", lines.alias("lines")).where(F.size("lines") > 0)
    return _heads(files, F.slice("lines", 1, HEAD_LINES))


def _heads(files: DataFrame, first: Column) -> DataFrame:
    """Add delimiter, header_at and headers, from each file's first lines."""
    ship_package(files.sparkSession)

    @F.pandas_udf("delimiter string, header_at int, headers array<string>")
    def head(first: pd.Series) -> pd.DataFrame:
        rows = []
        for some in first:
            some = list(some)
            d = detected_delimiter(some)
            widths = [len(split_fields(line, d)) for line in some]
            at = widths.index(max(widths)) if widths else 0
            rows.append((d, at, deduplicated(split_fields(some[at], d)) if some else []))
        return pd.DataFrame(rows, columns=["delimiter", "header_at", "headers"])

    return files.withColumn("head", head(first)).select(*files.columns, "head.*")


def parse_texts(texts: DataFrame) -> DataFrame:
    """Rows (log_id, text) into one row for each line behind the header: status is data, long or units.

    Columns: log_id, line_no, status, headers, cells (name to text). Comment and
    blank lines are dropped, title lines stand before the header: the first line
    with most fields among the first ten. Short rows are padded; long rows and
    rows whose cells are mostly text are kept out by their status, to be counted.
    """
    files = file_heads(texts)
    # dealt out by log: what was found per file is computed once, before its lines become rows
    files = files.select("log_id", "headers", "delimiter", "header_at", "lines").repartition("log_id")
    rows = files.select("log_id", "headers", "delimiter", "header_at", F.posexplode("lines").alias("line_no", "line"))
    return _judged(rows.where(F.col("line_no") > F.col("header_at"))).select("log_id", "line_no", "status", "headers", "cells")


def _judged(rows: DataFrame) -> DataFrame:
    """Lines behind the header with their status and cells."""
    rows = rows.withColumn("fields", _fields(F.col("line"), F.col("delimiter")))
    missing = F.greatest(F.size("headers") - F.size("fields"), F.lit(0))
    filled = F.filter("fields", lambda f: f != "")
    numeric = F.filter(filled, lambda f: S.number(f).isNotNull())
    status = F.when(F.size("fields") > F.size("headers"), "long").when((F.size(filled) > 0) & (F.size(numeric) < F.size(filled) / 2), "units").otherwise("data")
    cells = F.when(status == "data", F.map_from_arrays("headers", F.concat("fields", F.array_repeat(F.lit(""), missing))))
    return rows.withColumns({"status": status, "cells": cells}).drop("fields")


#: Lines of a file that a header is looked for in.
HEAD_LINES = 10
PLACE = ["block", "at"]


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(log_id, block, at, line): the lines of all files under a path, read in byte ranges by as many tasks as there are.

    ``block`` is where a range begins in its file and ``at`` rises inside it, so that the two
    together put the lines of a file in order. Comments and blank lines are left out.
    """
    raw = spark.read.option("lineSep", "\n").text(path)
    lines = raw.select(F.col("_metadata.file_path").alias("log_id"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", "\r$", "").alias("line"))
    return lines.where(~F.trim("line").rlike("^([#;]|$)"))


def parse_lines(lines: DataFrame) -> DataFrame:
    """What ``parse_texts`` makes of whole texts, from lines that many tasks read: (log_id, block, at, status, headers, cells).

    A file's header is looked for once, in its first lines, which are all that is gathered of
    it. What is found goes to the file's byte ranges and from there to their lines, so that no
    join or group holds more of a file than a range.
    """
    nth = F.row_number().over(Window.partitionBy("log_id").orderBy(*PLACE))
    first = lines.withColumn("nth", nth).where(F.col("nth") <= HEAD_LINES)
    listed = first.groupBy("log_id").agg(F.array_sort(F.collect_list(F.struct("nth", *PLACE, "line"))).alias("first"))
    heads = _heads(listed, F.col("first.line")).select("log_id", "headers", "delimiter", F.struct(*(F.col("first")[F.col("header_at")].getField(c).alias(c) for c in PLACE)).alias("header"))
    ranges = lines.select("log_id", "block").distinct().join(heads, "log_id")
    rows = lines.join(ranges, ["log_id", "block"]).where(F.struct(*PLACE) > F.col("header"))
    return _judged(rows).select("log_id", *PLACE, "status", "headers", "cells")


def numbered_rows(parsed: DataFrame) -> DataFrame:
    """Admitted rows of ``parse_lines``, numbered from 0 in each file, however long it is."""
    rows = parsed.where("status = 'data'").select("log_id", *PLACE, "cells").withColumn("one", F.lit(1).cast("long"))
    counted = order.with_running_sums(rows, ["log_id", *PLACE], {"nth": "one"})
    begins = counted.groupBy("log_id", "block").agg(F.min("nth").alias("nth"))
    firsts = begins.select("log_id", "block", F.min("nth").over(Window.partitionBy("log_id")).alias("first"))
    return counted.join(firsts, ["log_id", "block"]).select("log_id", (F.col("nth") - F.col("first")).alias("row_idx"), "cells")


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """All log files under a path, each read whole; the file's path is the log's id. For files of any length see ``read_lines``."""
    return parse_texts(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("log_id"), F.col("value").alias("text")))


def warnings(parsed: DataFrame) -> DataFrame:
    return parsed.groupBy("log_id").agg(F.count_if(F.col("status") == "long").alias("long_rows"), F.count_if(F.col("status") == "units").alias("unit_rows"), F.count_if(F.col("status") == "data").alias("data_rows"))


def data_rows(parsed: DataFrame) -> DataFrame:
    """Admitted rows, numbered from 0 in each log."""
    order = Window.partitionBy("log_id").orderBy("line_no")
    return parsed.where("status = 'data'").select("log_id", (F.row_number().over(order) - 1).cast("long").alias("row_idx"), "cells")


def channel_types(rows: DataFrame) -> DataFrame:
    """A channel is numeric when every filled cell of it is a finite number; ``used`` counts the filled cells."""
    cells = rows.select("log_id", F.explode("cells").alias("channel", "cell"))
    return cells.groupBy("log_id", "channel").agg(F.bool_and((F.col("cell") == "") | S.number(F.col("cell")).isNotNull()).alias("is_numeric"), F.count_if(F.col("cell") != "").alias("used"))


def channels(rows: DataFrame, names: dict[str, str], texts: list[str] | None = None) -> DataFrame:
    """Pick channels by header: {canonical name: header}. Numbers are narrowed to float as they are logged; ``texts`` are kept as they are, under their headers."""
    cell = lambda h: F.try_element_at("cells", F.lit(h))
    return rows.select("log_id", "row_idx", *(S.number(cell(h)).cast("float").cast("double").alias(n) for n, h in names.items()), *(F.when(cell(h) != "", cell(h)).alias(h) for h in texts or []))


def text_channel(rows: DataFrame, header: str) -> DataFrame:
    cell = F.try_element_at("cells", F.lit(header))
    return rows.select("log_id", "row_idx", F.when(cell != "", cell).alias(header))


def from_dicts(spark: SparkSession, log_id: str, rows: list[dict]) -> DataFrame:
    """Row dictionaries as a parsed log: keys in the order first seen; infinities and NaN are missing."""
    names = list(dict.fromkeys(k for row in rows for k in row))
    text = lambda v: "" if v is None or v != v or v in (float("inf"), float("-inf")) else str(v)
    data = [(log_id, i, {n: text(row.get(n)) for n in names}) for i, row in enumerate(rows)]
    return spark.createDataFrame(data, "log_id string, row_idx long, cells map<string,string>")
