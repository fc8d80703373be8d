"""Tables that several jobs of one operator read again.

They are written to the folder that the cluster names in ``spark.checkpoint.dir``, which all executors and the driver
share, so losing an executor loses nothing.  A folder of the machine is used only by a local session without that setting.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path for one table under the shared folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="lexigrid-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a written table: later jobs read it instead of computing it again."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written within are removed when it is written, not when the driver happens to collect garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def database(spark: SparkSession, label: str) -> str:
    """A new database under the shared folder: tables dropped from it free their place."""
    name = f"lexigrid_{label}_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{shared_path(spark, label)}'")
    return name


def written_buckets(df: DataFrame, label: str, key: str, buckets: int, home: str | None = None) -> DataFrame:
    """``df`` as a table bucketed by ``key``: joins on ``key`` then move only the other side.  With ``home``: that database's table ``label``."""
    spark = df.sparkSession
    if home:
        with freed_shuffles(spark):
            df.write.bucketBy(buckets, key).option("compression", "zstd").saveAsTable(f"{home}.{label}")
        return spark.table(f"{home}.{label}")
    path = shared_path(spark, label)
    name = f"lexigrid_{label}_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).option("compression", "zstd").option("path", path).saveAsTable(name)
    return spark.table(name)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
