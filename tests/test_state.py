"""State across restarts, snapshots that outlive failures, replays."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lexigrid.plans.state import PROVIDER
from lexigrid.sources.files import scratch
from lexigrid.streaming.state import ROCKS, Snapshots, follow_snapshots, gated, replayed

HOUR = 3_600_000_000


def plain_gate(rows, wait):
    failed, out = {}, {}
    for key, i, at, bad in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        if key in failed and at - failed[key] < wait:
            out[i] = "held"
            continue
        failed.pop(key, None)
        if bad:
            failed[key] = at
        out[i] = "failed" if bad else "done"
    return out


def test_gate_across_a_restart(spark):
    """Two runs over one checkpoint give what one run over all rows would; old failures leave the state."""
    rng = random.Random(1)
    rows = [(rng.randrange(8), i, i * HOUR // 4 + rng.randrange(100), rng.random() < 0.4) for i in range(400)]
    top = scratch(spark, "gate")
    to_rows = lambda some: spark.createDataFrame([(k, i, a, dt.datetime.fromtimestamp(a / 1e6, dt.UTC), b) for k, i, a, b in some], "key long, id long, at long, seen timestamp, failed boolean")
    before, seen = spark.conf.get(PROVIDER), []
    spark.conf.set(PROVIDER, ROCKS)
    try:
        for part in (rows[:200], rows[200:]):
            to_rows(part).coalesce(1).write.mode("append").parquet(f"{top}/in")
            stream = spark.readStream.schema("key long, id long, at long, seen timestamp, failed boolean").parquet(f"{top}/in").withWatermark("seen", "1 hour")
            q = gated(stream, 3 * HOUR).writeStream.format("parquet").option("path", f"{top}/out").option("checkpointLocation", f"{top}/marks").trigger(availableNow=True).start()
            q.awaitTermination()
            seen += [p["stateOperators"][0] for p in q.recentProgress if p["stateOperators"]]
    finally:
        spark.conf.set(PROVIDER, before)
    got = {r.id: r.said for r in spark.read.parquet(f"{top}/out").collect()}
    assert got == plain_gate(rows, 3 * HOUR) and set(got.values()) == {"done", "failed", "held"}
    assert sum(s["numRowsRemoved"] for s in seen) > 0  # state expires


def test_snapshot_outlives_a_failure(spark):
    clock = [1000.0]
    s = Snapshots(spark, scratch(spark, "snap"), ttl=1800, retry=60, now=lambda: clock[0])
    good = lambda n: lambda old: spark.range(n)
    bad = lambda old: spark.range(3).select(F.raise_error(F.lit("offline")).cast("long").alias("id"))
    assert s.current() is None and s.due()
    assert not s.reload(bad) and s.current() is None
    clock[0] += 59
    assert not s.due()  # too soon after the failure
    clock[0] += 1
    assert s.reload(good(5)) and s.current().count() == 5
    clock[0] += 1799
    assert not s.reload(good(7))
    clock[0] += 1
    assert not s.reload(bad) and s.current().count() == 5  # the old rows stay
    clock[0] += 30
    assert not s.reload(good(7))
    clock[0] += 30
    assert s.reload(good(7)) and s.current().count() == 7
    assert [r.what for r in s.log().orderBy("at", "version").collect()] == ["begun", "failed", "good", "failed", "good"]


def test_stream_takes_a_failed_batch_again(spark):
    top = scratch(spark, "snap-stream")
    to, marks = Snapshots(spark, f"{top}/to"), f"{top}/marks"
    merge = lambda old, new: new if old is None else old.union(new)
    spark.range(4).coalesce(1).write.mode("append").parquet(f"{top}/t.parquet")
    follow_snapshots(spark, top, "t", merge, to, marks)
    spark.range(4, 6).coalesce(1).write.mode("append").parquet(f"{top}/t.parquet")
    with pytest.raises(Exception, match="offline"):
        follow_snapshots(spark, top, "t", lambda old, new: new.select(F.raise_error(F.lit("offline")).cast("long").alias("id")), to, marks)
    assert to.current().count() == 4
    follow_snapshots(spark, top, "t", merge, to, marks)
    assert sorted(r.id for r in to.current().collect()) == [0, 1, 2, 3, 4, 5]


def test_only_changed_keys_are_computed(spark):
    asked = spark.sparkContext.accumulator(0)

    def compute(rows):
        def count(key):
            asked.add(1)
            return key

        return rows.select("key", F.concat(F.lit("r"), F.udf(count, "string")("content")).alias("result"))

    make = lambda d: spark.createDataFrame([*d.items()], "key long, content string")
    none = spark.createDataFrame([], "key long, version string, stamp string, result string")
    one = replayed(make({1: "a", 2: "b", 3: None}), none, "v1", compute)
    cache = spark.createDataFrame(one.collect(), one.schema).drop("cached")
    seen = asked.value
    two = {r.key: (r.result, r.cached) for r in replayed(make({1: "a", 2: "B", 4: "d"}), cache, "v1", compute).collect()}
    assert two == {1: ("ra", True), 2: ("rB", False), 4: ("rd", False)} and asked.value - seen == 2
    assert not any(r.cached for r in replayed(make({1: "a"}), cache, "v2", compute).collect())
