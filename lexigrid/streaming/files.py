"""Streams over tables that grow by files, run to the end of what is there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.sources.files import scratch


def follow(spark: SparkSession, path: str, name: str, step: Callable[[DataFrame], DataFrame], mode: str = "complete", keys: tuple[str, ...] = ()) -> DataFrame:
    """``step`` applied to the stream of ``path``/``name``.parquet: the result of the last complete batch, all appended rows, or with
    ``update`` the last row of each of ``keys`` (state then holds only what the step's watermark keeps open)."""
    schema = spark.read.parquet(f"{path}/{name}.parquet").schema
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 64).parquet(f"{path}/{name}.parque[t]")  # a pattern may name a single file
    out, marks = scratch(spark, f"{name}-stream"), scratch(spark, f"{name}-marks")

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={number}")

    step(stream).writeStream.outputMode(mode).option("checkpointLocation", marks).foreachBatch(save).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(out)
    if mode == "update":
        columns = [c for c in got.columns if c != "batch"]
        return got.groupBy(*keys).agg(F.max_by(F.struct(*columns), "batch").alias("row")).select("row.*")
    return got if mode == "complete" else got.drop("batch")
