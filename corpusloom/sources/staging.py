"""Tables in the folder all executors share: the way to cut a plan's lineage without local checkpoints."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_paths: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset a fresh local one is made in local mode, and an error raised anywhere else,
    since executors on other machines could not read what is written there."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table into the shared folder and read it again.

    Cuts the lineage and survives the loss of any executor. release deletes what was written, at the latest when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _paths:
        atexit.register(release, spark)
    _paths.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """How many tables were written so far; release(spark, keep=mark()) later deletes the newer ones."""
    return len(_paths)


def release(spark: SparkSession, keep: int = 0) -> None:
    """Delete the tables of materialize but for the first `keep`. Results that read them must have been written or collected before."""
    while len(_paths) > keep:
        path = _paths.pop()
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session may be gone already
            pass
