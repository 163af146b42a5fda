"""Packets derived from ``events``, decoded by a data-stream definition, with the comparison SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revscope.plans.base_sql import with_
from revscope.sources import packets as P

#: A definition: command, title, offset, first bit, bits, equation. Bits cross bytes, and the last value lies beyond its packets.
DEFINITION = [
    ("0x01", "RPM", 2, 0, 16, "X*0.125"), ("0x01", "MAP", 4, 0, 8, "X*0.5+10"), ("0x01", "Status", 5, 0, 8, "X"), ("0x01", "Locked", 5, 3, 1, "X"), ("0x01", "Mode", 5, 4, 4, "X"), ("0x01", "Wide", 4, 4, 12, "X/4-40"), ("0x01", "Sum", 2, 0, 32, "x"),
    ("0x02", "Speed", 1, 0, 8, "X*1.0"), ("0x02", "Knock", 2, 0, 8, "X * 0.175781"), ("0x02", "Odd", 1, 0, 8, "X*Y"), ("0x02", "Beyond", 20, 0, 8, "X"),
]
CHANNELS = {"rpm": "RPM", "map": "MAP", "locked": "Locked", "wide": "Wide", "mph": "Speed", "kr": "Knock"}


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two packets for each event: the answers to two commands. The bytes come from the event's user, number and value."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    byte = lambda c: F.lpad(F.hex(F.pmod(c.cast("long"), F.lit(256))), 2, "0")
    user, number, value = F.col("user_id"), F.col("event_id"), F.floor(F.col("value") * 100)
    word = user * 37 + number
    first = F.concat(F.lit("F453"), byte(F.floor(word / 256)), byte(word), byte(value), byte(number))
    second = F.concat(F.lit("F4"), byte(user), byte(F.floor(value / 7)), byte(number))
    both = F.array(F.struct(F.lit("0x01").alias("command"), F.unhex(first).alias("payload")), F.struct(F.lit("0x02").alias("command"), F.unhex(second).alias("payload")))
    return e.select(F.floor(F.col("event_id") / 2500).alias("log_id"), F.pmod("event_id", F.lit(2500)).alias("row_idx"), F.explode(both).alias("x")).select("log_id", "row_idx", "x.*")


def definition(spark: SparkSession) -> DataFrame:
    rows = [(f"v{k}", title, command, None, offset, bit, bits, equation, 0, True) for k, (command, title, offset, bit, bits, equation) in enumerate(DEFINITION)]
    return spark.createDataFrame(rows, "id string, title string, command string, units string, offset int, bit int, bits int, equation string, output_type int, raw boolean")


def decoded_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.decoded(packets(spark, sf_dir), definition(spark)).select("log_id", "row_idx", "command", "title", "raw", "value")


def packet_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.as_channels(P.decoded(packets(spark, sf_dir), definition(spark)), CHANNELS)


_bytes = """b AS (SELECT CAST(floor(event_id / 2500) AS BIGINT) AS log_id, event_id % 2500 AS row_idx, user_id * 37 + event_id AS w, CAST(floor(value * 100) AS BIGINT) % 256 AS m, event_id % 256 AS s, user_id % 256 AS u, CAST(floor(floor(value * 100) / 7) AS BIGINT) % 256 AS k FROM events)"""
_long = "l AS (" + " UNION ALL ".join(
    f"SELECT log_id, row_idx, '{command}' AS command, '{title}' AS title, CAST({raw} AS BIGINT) AS raw, CAST({value} AS DOUBLE) AS value FROM (SELECT *, {raw} AS x FROM b)"
    for command, title, raw, value in [
        ("0x01", "RPM", "w % 65536", "x * 0.125e0"), ("0x01", "MAP", "m", "x * 0.5e0 + 10"), ("0x01", "Status", "s", "x"), ("0x01", "Locked", "(s // 16) % 2", "x"), ("0x01", "Mode", "s % 16", "x"), ("0x01", "Wide", "(m % 16) * 256 + s", "x / 4e0 - 40"), ("0x01", "Sum", "(w % 65536) * 65536 + m * 256 + s", "x"),
        ("0x02", "Speed", "u", "x"), ("0x02", "Knock", "k", "x * 0.175781e0"), ("0x02", "Odd", "u", "NULL"), ("0x02", "Beyond", "NULL", "NULL"),
    ]
) + ")"
QUERIES = {"decoded_packets": decoded_packets, "packet_channels": packet_channels}
ORACLES = {
    "decoded_packets": with_(_bytes, _long, "SELECT * FROM l"),
    "packet_channels": with_(_bytes, _long, "SELECT log_id, row_idx, " + ", ".join(f"max(value) FILTER (WHERE title = '{title}') AS {name}" for name, title in CHANNELS.items()) + " FROM l GROUP BY log_id, row_idx"),
}
