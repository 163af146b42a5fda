"""Several logs as one: all columns, in the order first seen, with the number of the source log."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revscope.operators import order

SOURCE = "_srclog"


def plain_text(v: Column) -> Column:
    """A float as text the way loggers print it: whole numbers without a fraction."""
    d = v.cast("double")
    return F.when(d == F.floor(d), F.floor(d).cast("string")).otherwise(d.cast("string"))


def clashes(tables: list[DataFrame]) -> list[str]:
    """What to warn of before a merge."""
    if not tables:
        return ["no logs"]
    kinds: dict[str, set[bool]] = {}
    for t in tables:
        for f in t.schema:
            kinds.setdefault(f.name, set()).add(f.dataType.simpleString() == "string")
    out = [f"channel {n} is a number in one log and text in another" for n, k in kinds.items() if len(k) > 1]
    shared = set.intersection(*(set(t.columns) for t in tables)) - {"log_id", "row_idx", SOURCE}
    return out if shared or len(tables) == 1 else ["no common channels", *out]


def merged(tables: list[DataFrame], partition_by_log: bool = False) -> DataFrame:
    """Union with provenance: one continuous session, unless each log is to stay its own.

    Missing channels are NULL, a channel that is text in any log is text in all,
    and a column that already has the reserved name is kept under another. A table
    may hold many logs, which follow one another in the order of log_id; one without
    a log_id is one log.
    """
    parts = []
    text = {f.name for t in tables for f in t.schema if f.dataType.simpleString() == "string" and f.name != "log_id"}
    for k, t in enumerate(tables):
        if SOURCE in t.columns:
            name, n = f"{SOURCE}_orig", 1
            while name in t.columns:
                name, n = f"{SOURCE}_orig_{n}", n + 1
            t = t.withColumnRenamed(SOURCE, name)
        t = t.select(*(plain_text(F.col(f.name)).alias(f.name) if f.name in text and f.dataType.simpleString() != "string" else F.col(f.name) for f in t.schema))
        t = t if "log_id" in t.columns else t.withColumn("log_id", F.lit(0).cast("long"))
        parts.append(t.withColumn(SOURCE, F.lit(k)))
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    if partition_by_log:
        return out
    # every row gets the number of rows before it; ranges of rows are counted, so neither a log nor all of them is one task
    numbered = order.with_running_sums(out.withColumn("_one", F.lit(1).cast("long")), [SOURCE, "log_id", "row_idx"], {"_nth": "_one"})
    return numbered.withColumns({"row_idx": F.col("_nth"), "log_id": F.lit(0).cast("long")}).drop("_nth", "_one")


def repicked(logs: DataFrame, picked: DataFrame, name: str = "log_name") -> DataFrame:
    """Logs picked again replace those of the same name, rows and all; others stay beside them."""
    again = picked.select(name).distinct()
    return logs.join(again, name, "left_anti").unionByName(picked, allowMissingColumns=True)
