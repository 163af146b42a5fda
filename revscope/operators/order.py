"""Global order without a global window.

Rows are range partitioned by their order and staged, so that each range is a part of
the order and ranges follow one another. What a row needs of the rows before it comes
from a window inside its range and from one row for each earlier range. Those rows,
as many as there are ranges, are all that the driver sees.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revscope.cluster import staged

PART = "_part"


def ranges(df: DataFrame, order: list[str]) -> DataFrame:
    """Staged rows with the number of their range. Rows that are equal in the order stand in one range."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return staged(df.repartitionByRange(n, *order).withColumn(PART, F.spark_partition_id()), "ranges")


def _carried(parts: DataFrame, of: list[str], step: Callable[[dict, dict], dict], start: dict[str, Any]) -> DataFrame:
    """Per range what the ranges before it leave behind: ``step`` takes what was left so far and a range's own row."""
    rows, held = [], dict(start)
    for row in parts.orderBy(PART).collect():
        rows.append((row[PART], *(held[c] for c in of)))
        held = step(held, row.asDict())
    kinds = dict(parts.dtypes)
    return parts.sparkSession.createDataFrame(rows, f"{PART} int, " + ", ".join(f"{c} {kinds[c]}" for c in of))


def with_running_sums(df: DataFrame, order: list[str], sums: dict[str, str]) -> DataFrame:
    """Add under each name the sum of a column over all rows before the row (0 before the first)."""
    parts = ranges(df, order)
    own = parts.groupBy(PART).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(name) for name, c in sums.items()))
    offsets = _carried(own, list(sums), lambda held, row: {name: held[name] + row[name] for name in sums}, dict.fromkeys(sums, 0))
    before = Window.partitionBy(PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = parts.withColumns({f"_in_{name}": F.coalesce(F.sum(c).over(before), F.lit(0)) for name, c in sums.items()})
    joined = inside.join(F.broadcast(offsets), PART)
    return joined.withColumns({name: F.col(f"_in_{name}") + F.col(name) for name in sums}).drop(PART, *(f"_in_{name}" for name in sums))


def with_previous(df: DataFrame, order: list[str], values: dict[str, str]) -> DataFrame:
    """Add under each name the value of a column in the row before (null before the first); ties in the order are not told apart."""
    parts = ranges(df, order)
    last = parts.groupBy(PART).agg(F.max_by(F.struct(*(F.col(c).alias(name) for name, c in values.items())), F.struct(*order)).alias("x")).select(PART, "x.*")
    offsets = _carried(last, list(values), lambda _, row: row, dict.fromkeys(values))
    w = Window.partitionBy(PART).orderBy(*order)
    inside = parts.withColumns({f"_in_{name}": F.lag(c).over(w) for name, c in values.items()}).withColumn("_head", F.row_number().over(w) == 1)
    joined = inside.join(F.broadcast(offsets), PART)
    return joined.withColumns({name: F.when(F.col("_head"), F.col(name)).otherwise(F.col(f"_in_{name}")) for name in values}).drop(PART, "_head", *(f"_in_{name}" for name in values))
