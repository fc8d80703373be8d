"""Streams with a state of their own: retries held back after a failure, snapshots swapped in batches, results replayed."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lexigrid.sources.files import scratch

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class RetryGate(StatefulProcessor):
    """Attempts of a key (id, at in microseconds, failed) in order of time: after a failed one, attempts within ``wait`` microseconds are held and
    change nothing; a later one runs.  Kept: when a key failed last.  A timer drops it once the watermark has passed the wait, so a key
    without a fresh failure has no state."""

    def __init__(self, wait: int):
        self.wait = wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.failed = handle, handle.getValueState("failed_at", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        some = pd.concat(rows).sort_values(["at", "id"])
        before = self.failed.get()[0] if self.failed.exists() else None
        failed, said = before, []
        for at, bad in zip(some["at"], some["failed"], strict=True):
            if failed is not None and at - failed < self.wait:
                said.append("held")
                continue
            failed = int(at) if bad else None
            said.append("failed" if bad else "done")
        if failed != before:
            if before is not None:
                self.handle.deleteTimer((before + self.wait) // 1000 + 1)
            if failed is None:
                self.failed.clear()
            else:
                self.failed.update((failed,))
                self.handle.registerTimer((failed + self.wait) // 1000 + 1)
        yield pd.DataFrame({"key": key[0], "id": some["id"], "said": said})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.failed.clear()
        yield pd.DataFrame({"key": pd.Series([], dtype="int64"), "id": pd.Series([], dtype="int64"), "said": pd.Series([], dtype="str")})


def gated(stream: DataFrame, wait: int) -> DataFrame:
    """A stream (key, id, at, failed, and a column with a watermark) -> (key, id, said): done, failed or held.  Needs RocksDB's state store."""
    return stream.groupBy("key").transformWithStateInPandas(RetryGate(wait), outputStructType="key long, id long, said string", outputMode="append", timeMode="EventTime")


class Snapshots:
    """A table in versions under a folder: readers get the last one that was written whole.

    A version's rows are written first, then its line in ``log``; a failure gets a line too.  So whatever stops a run, the log never names
    a version that isn't there, and the last good version stays."""

    def __init__(self, spark: SparkSession, path: str, ttl: float = 1800, retry: float = 60, now: Callable[[], float] = time.time):
        self.spark, self.path, self.ttl, self.retry, self.now = spark, path, ttl, retry, now
        self._say(0, "begun")

    def _say(self, version: int, what: str) -> None:
        self.spark.range(1).select(F.lit(version).alias("version"), F.lit(what).alias("what"), F.lit(float(self.now())).alias("at")).coalesce(1).write.mode("append").json(f"{self.path}/log")

    def log(self) -> DataFrame:
        return self.spark.read.schema("version int, what string, at double").json(f"{self.path}/log")

    def _last(self) -> tuple[int, float | None, float | None]:
        at = lambda what: F.max(F.when(F.col("what") == what, F.col("at")))
        good = F.coalesce(F.max(F.when(F.col("what") == "good", F.col("version"))), F.lit(0))
        return tuple(self.log().agg(good, at("good"), at("failed")).first())

    def current(self) -> DataFrame | None:
        version = self._last()[0]
        return self.spark.read.parquet(f"{self.path}/version-{version}") if version else None

    def due(self) -> bool:
        """Never loaded, or loaded ``ttl`` seconds ago or more; but not within ``retry`` seconds of a failure."""
        version, loaded, failed = self._last()
        if failed is not None and (loaded is None or failed >= loaded) and self.now() - failed < self.retry:
            return False
        return not version or self.now() - loaded >= self.ttl

    def swap(self, make: Callable[[DataFrame | None], DataFrame]) -> bool:
        """``make`` of the current version as the next one; if reading or making it fails, the current one stays."""
        version = self._last()[0] + 1
        try:
            make(self.current()).write.mode("overwrite").parquet(f"{self.path}/version-{version}")
        except PySparkException as e:
            self._say(version, "failed")
            self.why = e
            return False
        self._say(version, "good")
        return True

    def reload(self, make: Callable[[DataFrame | None], DataFrame]) -> bool:
        return self.due() and self.swap(make)


def follow_snapshots(spark: SparkSession, path: str, name: str, merge: Callable[[DataFrame | None, DataFrame], DataFrame], to: Snapshots | None = None, marks: str | None = None) -> Snapshots:
    """The stream of ``path``/``name``.parquet, each batch merged into the next snapshot."""
    to, marks = to or Snapshots(spark, scratch(spark, f"{name}-snapshots")), marks or scratch(spark, f"{name}-marks")
    schema = spark.read.parquet(f"{path}/{name}.parquet").schema
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 64).parquet(f"{path}/{name}.parque[t]")

    def save(batch: DataFrame, number: int) -> None:
        if not to.swap(lambda old: merge(old, batch)):
            raise to.why  # the batch isn't marked as done: the next run takes it again

    stream.writeStream.foreachBatch(save).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    return to


def replayed(inputs: DataFrame, cache: DataFrame, version: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """inputs (key, content), cache (key, version, stamp, result) -> (key, version, stamp, result, cached), which is the next cache.

    A cached result stands only if its version and the stamp of its content are the same; only the other keys go through ``compute``
    (key, content) -> (key, result).  Of several equal entries of the cache one is taken; null content has a stamp of its own."""
    stamp = F.coalesce(F.sha2(F.col("content"), 256), F.lit("none"))
    stamped = inputs.withColumn("stamp", stamp)
    saved = cache.where(F.col("version") == version).groupBy("key", "stamp").agg(F.min("result").alias("result"))
    hits = stamped.select("key", "stamp").join(saved, ["key", "stamp"]).select("key", "stamp", "result", F.lit(True).alias("cached"))
    todo = stamped.join(saved, ["key", "stamp"], "left_anti")
    fresh = compute(todo.select("key", "content")).join(todo.select("key", "stamp"), "key").select("key", "stamp", "result", F.lit(False).alias("cached"))
    return hits.union(fresh).select("key", F.lit(version).alias("version"), "stamp", "result", "cached")
