"""Event streams by Structured Streaming, held against the same result over the whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexigrid.registry import query
from lexigrid.streaming.files import follow


#: Events may come this much later than the latest one; what is older is closed and leaves the state.
LATE = "1 day"


def _timed(stream):
    """The table's time without a zone as a time of the stream."""
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01', ts)")
    return stream.withColumn("at", F.timestamp_micros(micros)).withWatermark("at", LATE)


def _hour():
    return F.floor(F.unix_timestamp("window.start") / 3600).alias("hour")


@query("x_tumble", "SELECT event_type, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL")
def x_tumble(spark, sf):
    """Events per kind and hour."""
    got = follow(spark, sf, "events", lambda s: _timed(s).groupBy("event_type", F.window("at", "1 hour")).agg(F.count("*").alias("n")), "update", ("event_type", "window"))
    return got.select("event_type", _hour(), "n")


@query("x_slide", "SELECT CAST(h AS BIGINT) AS hour, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest([floor(epoch(ts) / 3600), floor(epoch(ts) / 3600) - 1]) AS h FROM events) GROUP BY h")
def x_slide(spark, sf):
    """Events in windows of two hours that start every hour."""
    got = follow(spark, sf, "events", lambda s: _timed(s).groupBy(F.window("at", "2 hours", "1 hour")).agg(F.count("*").alias("n")), "update", ("window",))
    return got.select(_hour(), "n")


@query("x_session", "WITH a AS (SELECT user_id, ts, CASE WHEN epoch(ts) - lag(epoch(ts)) OVER w <= 21600 THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, CAST(sum(s) AS BIGINT) AS sessions FROM a GROUP BY user_id")
def x_session(spark, sf):
    """Sessions of each user, closed by six hours without an event."""
    got = follow(spark, sf, "events", lambda s: _timed(s).groupBy("user_id", F.session_window("at", "6 hours")).agg(F.count("*").alias("n")))
    return got.groupBy("user_id").agg(F.count("*").alias("sessions"))


@query("x_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def x_dedup(spark, sf):
    """Each pair of user and kind once, as it is first met."""
    return follow(spark, sf, "events", lambda s: s.select("user_id", "event_type").dropDuplicates(), "append")
