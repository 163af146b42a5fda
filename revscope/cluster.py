"""What a job needs from the cluster it runs on: shared scratch tables and the package on its executors."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``.

    Where that is unset a local master gets a fresh folder of its own (tests);
    on a cluster an unset folder is an error, because executors share no disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="revscope-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def staged(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage: a lost executor makes Spark reread the table instead
    of recomputing what stands before it. Nothing is kept in executor memory.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/revscope/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python workers can import it."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    here = Path(__file__).resolve().parent
    blob = io.BytesIO()
    with zipfile.ZipFile(blob, "w") as out:
        for file in sorted(here.rglob("*.py")):
            out.write(file, str(file.relative_to(here.parent)))
    folder = os.path.realpath(tempfile.mkdtemp(prefix="revscope-"))
    target = os.path.join(folder, "revscope_package.zip")
    Path(target).write_bytes(blob.getvalue())
    context.addPyFile(target)
    _shipped[context.applicationId] = target
