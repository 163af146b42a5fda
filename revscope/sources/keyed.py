"""Small stores by key, kept as tables: definition library, stock image, altitude, last patch set.

Every write goes to a folder of its own. It counts from the moment a row of the manifest
names that folder, and that row is written last and by itself: a write that fails before
leaves a folder that nobody reads. The newest row of a key wins; a removal is a row
without a value. Compacting writes the newest rows to a folder that takes the place of
all before it; what was read from the old ones stays readable until they are cleaned.
There may be many readers, and one writer at a time.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROWS = "key string, value binary, nth int"
MANIFEST = "folder string, version long, replaces boolean"


class KeyStore:
    """Keys and their newest values under a path that the cluster shares."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _manifest(self) -> DataFrame:
        try:
            return self.spark.read.schema(MANIFEST).json(f"{self.path}/manifest")
        except Exception as error:  # noqa: BLE001 - a store that nothing was written to yet
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], MANIFEST)

    def _write(self, rows: DataFrame, replaces: bool, seen: int) -> int:
        folder = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/rows/{folder}")
        version = seen + 1
        self.spark.createDataFrame([(folder, version, replaces)], MANIFEST).coalesce(1).write.mode("append").json(f"{self.path}/manifest")
        return version

    def _live(self) -> tuple[int, list[tuple[int, str]]]:
        """The last version and the folders that count: the last one that replaces, and those behind it. One row for each write since the last compaction."""
        named = self._manifest()
        last = named.agg(F.coalesce(F.max("version"), F.lit(0)).alias("v"), F.coalesce(F.max(F.when(F.col("replaces"), F.col("version"))), F.lit(0)).alias("r")).first()
        return last.v, [(r.version, r.folder) for r in named.where(F.col("version") >= last.r).orderBy("version", "folder").collect()]

    def put(self, rows: DataFrame) -> int:
        """Write (key, value) rows; of equal keys in one write the largest value wins, a null value removes. Returns the version."""
        table = rows.select(F.col("key").cast("string").alias("key"), F.col("value").cast("binary").alias("value"), F.lit(0).alias("nth"))
        return self._write(table, False, self._live()[0])

    def set(self, key: str, value: bytes | None) -> int:
        return self.put(self.spark.createDataFrame([(key, value)], "key string, value binary"))

    def latest(self) -> DataFrame:
        """(key, value) of every key that has a value."""
        _, folders = self._live()
        if not folders:
            return self.spark.createDataFrame([], "key string, value binary")
        parts = None
        for k, (version, folder) in enumerate(folders):
            part = self.spark.read.schema(ROWS).parquet(f"{self.path}/rows/{folder}").select("key", "value", F.lit(version).alias("version"), F.lit(k).alias("place"))
            parts = part if parts is None else parts.unionByName(part)
        newest = Window.partitionBy("key").orderBy(F.desc("version"), F.desc("place"), F.desc_nulls_last("value"))
        return parts.withColumn("n", F.row_number().over(newest)).where((F.col("n") == 1) & F.col("value").isNotNull()).select("key", "value")

    def get(self, key: str) -> bytes | None:
        row = self.latest().where(F.col("key") == key).first()
        return None if row is None else bytes(row.value)

    def compact(self) -> int:
        """Put the newest rows of all keys in one folder, which stands for all that were written before."""
        version, _ = self._live()
        return self._write(self.latest().withColumn("nth", F.lit(0)), True, version)


#: The altitude that is taken for granted, and the range of those that are believed, in feet.
DEFAULT_ALTITUDE_FT, LOWEST_FT, HIGHEST_FT = 2840, -1000, 15000


def set_altitude(store: KeyStore, feet: float | str) -> bool:
    """Keep an altitude; refused where it is no number or out of range."""
    value = _altitude(feet)
    if value is None:
        return False
    store.set("altitude_ft", str(value).encode())
    return True


def altitude(store: KeyStore) -> int:
    kept = store.get("altitude_ft")
    value = None if kept is None else _altitude(kept.decode())
    return DEFAULT_ALTITUDE_FT if value is None else value


def _altitude(feet: float | str) -> int | None:
    try:
        value = float(feet)
    except ValueError:
        return None
    return math.floor(value + 0.5) if LOWEST_FT <= value <= HIGHEST_FT else None


def set_stock_image(store: KeyStore, name: str, content: bytes) -> None:
    """Keep the reference image and its name in one write, so that neither is ever seen without the other."""
    spark = store.spark
    store.put(spark.createDataFrame([("stock_image", content), ("stock_image_name", name.encode())], "key string, value binary"))


def stock_image(store: KeyStore) -> tuple[str, bytes] | None:
    found = {r.key: bytes(r.value) for r in store.latest().where(F.col("key").isin("stock_image", "stock_image_name")).collect()}
    return (found["stock_image_name"].decode(), found["stock_image"]) if len(found) == 2 else None


def clear_stock_image(store: KeyStore) -> None:
    spark = store.spark
    store.put(spark.createDataFrame([("stock_image", None), ("stock_image_name", None)], "key string, value binary"))


PATCH = "kind string, table_name string, rpm_lo long, map_lo long, delta double"


def set_last_patches(store: KeyStore, patches: DataFrame) -> int:
    """Keep a patch set in place of the one before: a row for each patch, and their number as the set's head.

    Patches of an earlier set stay under its own prefix and are not read any more.
    """
    prefix = f"patches/{uuid.uuid4().hex}/"
    fields = [f.split()[0] for f in PATCH.split(", ")]
    # ids rise in a partition and need no order between partitions: they only keep equal patches apart
    rows = patches.select(F.concat(F.lit(prefix), F.monotonically_increasing_id().cast("string")).alias("key"), F.to_json(F.struct(*fields)).cast("binary").alias("value"))
    store.put(rows)
    return store.set("last_patches", prefix.encode())


def last_patches(store: KeyStore) -> DataFrame:
    prefix = store.get("last_patches")
    rows = store.latest().where(F.lit(False) if prefix is None else F.col("key").startswith(prefix.decode()))
    return rows.select(F.from_json(F.col("value").cast("string"), PATCH).alias("x")).select("x.*")


def add_to_library(store: KeyStore, tables: DataFrame, title: str = "title") -> int:
    """Keep definitions under their titles; a title that was there is replaced."""
    body = F.to_json(F.struct(*(c for c in tables.columns if c != title)))
    return store.put(tables.select(F.concat(F.lit("definition/"), F.col(title)).alias("key"), body.cast("binary").alias("value")))


def library(store: KeyStore, schema: str) -> DataFrame:
    """All definitions, with the fields that ``schema`` names."""
    rows = store.latest().where(F.col("key").startswith("definition/"))
    return rows.select(F.substring_index("key", "definition/", -1).alias("title"), F.from_json(F.col("value").cast("string"), schema).alias("x")).select("title", "x.*")


def remove_from_library(store: KeyStore, titles: list[str]) -> int:
    spark = store.spark
    return store.put(spark.createDataFrame([(f"definition/{t}", None) for t in titles], "key string, value binary"))
