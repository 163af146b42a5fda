"""Images, and definitions of tables from XML; data streams are in ``packets``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revscope.functions import scalars as S


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Binary files as (image_id, offset, byte)."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("image_id"), F.hex("content").alias("hex"))
    pairs = F.transform(F.sequence(F.lit(0), (F.length("hex") / 2 - 1).cast("int")), lambda i: F.conv(F.col("hex").substr((i * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int"))
    return files.where(F.length("hex") > 0).select("image_id", F.posexplode(pairs).alias("offset", "byte"))


def image_content(images: DataFrame) -> DataFrame:
    """(image_id, content): the bytes of each image as one value, ready to be written."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", "byte"))), lambda x: F.lpad(F.hex(x["byte"].cast("long")), 2, "0")), "")
    return images.groupBy("image_id").agg(F.unhex(text).alias("content"))


def _address(c):  # noqa: ANN001, ANN202
    return F.conv(F.regexp_replace(F.lower(c), "^0x", ""), 16, 10).cast("int")


AXIS = "struct<_id:string,EMBEDDEDDATA:struct<_mmedaddress:string,_mmedrowcount:int,_mmedcolcount:int,_mmedelementsizebits:int>,units:string,LABEL:array<struct<_index:int,_value:string>>,MATH:struct<_equation:string>>"
TABLE = f"_uniqueid string, title string, XDFAXIS array<{AXIS}>"
ITEM = "_uniqueid string, title string, EMBEDDEDDATA struct<_mmedaddress:string,_mmedelementsizebits:int>, units string, MATH struct<_equation:string>"


def read_tables(spark: SparkSession, path: str) -> DataFrame:
    """Tables of a definition file on the catalog's schema."""
    rows = spark.read.format("xml").schema(TABLE).option("rowTag", "XDFTABLE").load(path)
    axis = lambda name: F.element_at(F.filter("XDFAXIS", lambda a: a["_id"] == name), 1)
    labels = lambda a: F.transform(F.array_sort(a["LABEL"]), lambda x: x["_value"])
    x, y, z = axis("x"), axis("y"), axis("z")
    data = z["EMBEDDEDDATA"]
    return rows.select(
        F.regexp_replace(F.trim("title"), r"\s+", " ").alias("title"), _address(data["_mmedaddress"]).alias("address"), F.coalesce(data["_mmedrowcount"], F.lit(1)).alias("n_rows"), F.coalesce(data["_mmedcolcount"], F.lit(1)).alias("n_cols"),
        F.coalesce(data["_mmedelementsizebits"], F.lit(8)).alias("bits"), labels(x).alias("x_labels"), labels(y).alias("y_labels"), z["MATH"]["_equation"].alias("equation"), x["units"].alias("x_units"), y["units"].alias("y_units"), z["units"].alias("z_units"),
    )


def read_items(spark: SparkSession, path: str, tag: str = "XDFCONSTANT") -> DataFrame:
    """Constants or flags (``XDFFLAG``) of a definition file."""
    rows = spark.read.format("xml").schema(ITEM).option("rowTag", tag).load(path)
    return rows.select(F.col("_uniqueid").alias("id"), F.regexp_replace(F.trim("title"), r"\s+", " ").alias("title"), _address(F.col("EMBEDDEDDATA._mmedaddress")).alias("address"), F.coalesce("EMBEDDEDDATA._mmedelementsizebits", F.lit(8)).alias("bits"), "units", F.col("MATH._equation").alias("equation"))


def linear_only(tables: DataFrame) -> DataFrame:
    """Tables whose equation can be turned round; the others are never patched."""
    return tables.where(S.raw_per_unit(F.col("equation")).isNotNull())
