"""Tables that cut lineage: intermediate results that several steps read."""

from __future__ import annotations

import atexit
import os
import uuid

from pyspark.sql import DataFrame, SparkSession

_stored: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir; a local session may have none."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if place:
        return place.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file:///tmp/checkpoints/quillstone-{os.getpid()}"


def stored(df: DataFrame) -> DataFrame:
    """df, written in the shared folder and read back. The table stays until the process ends or clear() is called."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _stored.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def kept(spark: SparkSession, path: str) -> str:
    """path, which is deleted with the tables."""
    _stored.append((spark, path))
    return path


def clear() -> None:
    while _stored:
        spark, path = _stored.pop()
        if spark.sparkContext._jsc is None:  # the session has ended, its folder goes with it
            continue
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _at_exit() -> None:
    try:
        clear()
    except Exception:  # the JVM may be gone already
        pass


atexit.register(_at_exit)
