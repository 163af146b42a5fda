"""Data-stream definitions and the packets that they describe: commands joined to values, bits to numbers.

A definition names the commands that a tool can send, and values: where in the answer
to which command a channel's bits stand, and the equation that makes a number of
them. A captured packet is (log_id, row_idx, command, payload); decoding joins it with
its command's values and cuts every value out of the payload, whatever number of bits
it has and wherever they begin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revscope.functions import scalars as S

COMMAND = "_id string, _idhash string, _title string, bytestring struct<_VALUE:string,_size:string>"
VALUE = "_id string, _idhash string, _title string, parentcmdidhash string, units string, packetoffset string, sizeinbits string, bitoffset string, outputtype string, MATH struct<_equation:string>"
HEADER = "guid string, author string, desc string, baud string, objectcount string"
#: The most values that a definition may have: what is broadcast to all packets.
MOST_VALUES = 20_000


def _number(text: Column) -> Column:
    """A decimal or 0x number as text."""
    t = F.lower(F.trim(text))
    return F.when(t.startswith("0x"), F.conv(F.substring(t, 3, 16), 16, 10)).otherwise(t).try_cast("int")


def _blank(text: Column) -> Column:
    return F.when(F.trim(text) != "", F.trim(text))


def read_header(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.format("xml").schema(HEADER).option("rowTag", "ADXHEADER").load(path)
    return rows.select("guid", "author", F.col("desc").alias("description"), _number(F.col("baud")).alias("baud"), _number(F.col("objectcount")).alias("objects"))


def read_commands(spark: SparkSession, path: str) -> DataFrame:
    """The request frames that a tool can send."""
    rows = spark.read.format("xml").schema(COMMAND).option("rowTag", "ADXCSENDCOMMAND").load(path)
    return rows.select(F.col("_id").alias("id"), F.col("_idhash").alias("command"), F.col("_title").alias("title"), _number(F.col("bytestring._size")).alias("size"), F.unhex(F.trim("bytestring._VALUE")).alias("frame"))


def read_values(spark: SparkSession, path: str) -> DataFrame:
    """All values; ``raw`` ones stand in the packet of a command, the others are computed from several."""
    rows = spark.read.format("xml").schema(VALUE).option("rowTag", "ADXVALUE").load(path)
    offset = F.coalesce(_number(F.col("packetoffset")), F.lit(0))
    parent = _blank(F.col("parentcmdidhash"))
    return rows.select(
        F.col("_id").alias("id"), _blank(F.col("_title")).alias("title"), parent.alias("command"), _blank(F.col("units")).alias("units"), offset.alias("offset"), F.coalesce(_number(F.col("bitoffset")), F.lit(0)).alias("bit"),
        F.coalesce(_number(F.col("sizeinbits")), F.lit(8)).alias("bits"), F.col("MATH._equation").alias("equation"), _number(F.col("outputtype")).alias("output_type"), (parent.isNotNull() & (offset != 0)).alias("raw"),
    )


def affine(equation: Column) -> tuple[Column, Column]:
    """Factor and shift of ``X``, ``X*a``, ``X/a``, each with or without ``+b`` or ``-b``; null for any other equation."""
    e = F.regexp_replace(F.upper(equation), r"\s+", "")
    number = r"([+-]?(?:\d+\.?\d*|\.\d+))"
    form = rf"^X(?:([*/]){number})?(?:([+-]){number})?$"
    part = lambda k: F.regexp_extract(e, form, k)
    times, plus = S.number(part(2)), F.coalesce(S.number(part(4)), F.lit(0.0))
    factor = F.when(part(1) == "*", times).when(part(1) == "/", F.try_divide(F.lit(1.0), times)).otherwise(1.0)
    fits = e.rlike(form)
    return F.when(fits, factor), F.when(fits, F.when(part(3) == "-", -plus).otherwise(plus))


def bits_of(payload: Column, begin: Column, bits: Column) -> Column:
    """``bits`` bits from bit ``begin`` on (the first byte's highest is 0) as a whole number, up to 48 of them; null where the payload is shorter."""
    first = F.floor(begin / 8)
    n_bytes = F.floor((begin + bits + 7) / 8) - first
    cut = F.hex(F.substring(payload, (first + 1).cast("int"), n_bytes.cast("int")))
    whole = F.conv(cut, 16, 10).cast("long")
    behind = n_bytes * 8 - (begin - first * 8) - bits
    value = F.call_function("shiftright", whole, behind.cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bits.cast("int")) - 1)
    return F.when((bits >= 1) & (bits <= 48) & (begin >= 0) & (begin + bits <= F.length(payload) * 8), value)


def decoded(packets: DataFrame, values: DataFrame) -> DataFrame:
    """(…, value_id, title, units, raw, value): each packet's values, long. Packets of a command without values give none.

    ``packets`` need the columns command and payload; all but the payload stay. ``values`` is what
    ``read_values`` makes; a definition of more than ``MOST_VALUES`` is refused, as it is broadcast.
    """
    factor, shift = affine(F.col("equation"))
    catalog = values.where("raw").select("command", F.col("id").alias("value_id"), "title", "units", (F.col("offset") * 8 + F.col("bit")).alias("_begin"), F.col("bits").alias("_bits"), factor.alias("_factor"), shift.alias("_shift"))
    if catalog.limit(MOST_VALUES + 1).count() > MOST_VALUES:
        raise ValueError(f"a definition has at most {MOST_VALUES} values")
    rows = packets.join(F.broadcast(catalog), "command").withColumn("raw", bits_of(F.col("payload"), F.col("_begin"), F.col("_bits")))
    return rows.withColumn("value", F.col("raw") * F.col("_factor") + F.col("_shift")).drop("payload", "_begin", "_bits", "_factor", "_shift")


def as_channels(long: DataFrame, names: dict[str, str]) -> DataFrame:
    """One row for each packet row with a column for each channel: {canonical name: title}. Commands that answer in turn share a row."""
    picked = [F.max(F.when(F.col("title") == title, F.col("value"))).alias(name) for name, title in names.items()]
    return long.groupBy("log_id", "row_idx").agg(*picked)
