"""Sinks and append-only stores: reports, change reports, the ledger and the journal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_report(reports: dict[str, DataFrame], path: str) -> None:
    """One folder of JSON for each part of a session report."""
    for name, df in reports.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def change_lines(patches: DataFrame) -> DataFrame:
    """A text line for each patch: table, address, old and new value."""
    return patches.select(F.format_string("%s 0x%04X: %d -> %d", "title", "address", "old_value", "new_value").alias("value"))


def write_change_report(patches: DataFrame, path: str, before: str | None = None, after: str | None = None) -> None:
    """The lines of all patches; digests of the images before and after, where given, stand in a file of their own."""
    change_lines(patches).write.mode("overwrite").text(path)
    if before or after:
        lines = [(f"sha256 before {before or 'unknown'}",), (f"sha256 after {after or 'unknown'}",)]
        patches.sparkSession.createDataFrame(lines, "value string").coalesce(1).write.mode("overwrite").text(f"{path}-digests")


def append_ledger(patches: DataFrame, path: str, at: str, minutes: int = 10) -> bool:
    """Record a downloaded patch set (kind, cell, delta). The same set within ten minutes is the same download.

    Returns whether it was recorded.
    """
    spark = patches.sparkSession
    signature = patches.agg(F.coalesce(F.bit_xor(F.xxhash64("kind", "cell", "delta")), F.lit(0).cast("long")).alias("s"), F.count("*").alias("n")).first()
    try:
        known = spark.read.parquet(path)
    except Exception as error:  # noqa: BLE001 - a ledger that does not exist yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        known = None
    moment = F.to_timestamp(F.lit(at))
    if known is not None and known.where((F.col("signature") == signature.s) & (F.col("n") == signature.n) & (F.abs(F.unix_timestamp("at") - F.unix_timestamp(moment)) <= 60 * minutes)).head(1):
        return False
    patches.select("kind", "cell", "delta").withColumns({"at": moment, "signature": F.lit(signature.s), "n": F.lit(signature.n)}).write.mode("append").parquet(path)
    return True


def read_ledger(spark: SparkSession, path: str, last: int = 20) -> DataFrame:
    """The changes of the last downloads, with their pass number from 0."""
    rows = spark.read.parquet(path)
    moments = rows.select("at").distinct().orderBy(F.desc("at")).limit(last)
    ranked = moments.withColumn("pass_no", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("at")) - 1)
    return rows.join(ranked, "at").select("kind", "cell", "pass_no", "delta", "at")


def ledger_history(spark: SparkSession, path: str) -> DataFrame:
    """One row for each download, the newest first: when, how many changes of which kinds, the largest of them."""
    rows = spark.read.parquet(path)
    return rows.groupBy("at").agg(F.count("*").alias("changes"), F.array_sort(F.collect_set("kind")).alias("kinds"), F.max_by("delta", F.abs("delta")).alias("largest")).orderBy(F.desc("at"))


def append_note(spark: SparkSession, path: str, at: str, note: str) -> None:
    """A journal entry; empty notes are refused."""
    if not note.strip():
        raise ValueError("empty note")
    spark.createDataFrame([(at, note.strip())], "at string, note string").write.mode("append").parquet(path)


def remove_note(spark: SparkSession, path: str, kept_path: str, at: str) -> int:
    """Write the journal without the entries of a moment to another folder; returns how many went. The first stays until it is replaced by the caller."""
    entries = spark.read.parquet(path)
    entries.where(F.col("at") != at).write.parquet(kept_path)
    return entries.where(F.col("at") == at).count()


def journal_text(entries: DataFrame, width: int = 100) -> DataFrame:
    """Entries as wrapped lines for a forum, the newest first."""
    words = F.split("note", r"\s+")
    folded = F.aggregate(words, F.array(F.lit("")), lambda acc, w: F.when(F.length(F.element_at(acc, -1)) + 1 + F.length(w) <= width, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.trim(F.concat_ws(" ", F.element_at(acc, -1), w))))).otherwise(F.concat(acc, F.array(w))))
    return entries.orderBy(F.desc("at")).select("at", F.concat_ws("\n", folded).alias("text"))
