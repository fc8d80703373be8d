"""Streams with arbitrary state, snapshots and replays."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexigrid.functions import text as T
from lexigrid.plans.streams import _timed
from lexigrid.registry import query, table
from lexigrid.sources.files import written
from lexigrid.streaming.files import follow
from lexigrid.streaming.state import ROCKS, follow_snapshots, gated, replayed

WAIT = 12 * 3600 * 1_000_000
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def _attempts(stream):
    return _timed(stream).select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.unix_micros("at").alias("at"), "at", (F.col("event_type") == "error").alias("failed")).toDF("key", "id", "at", "seen", "failed")


@query("x_retry_state", f"""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
x AS (SELECT a.user_id, a.i, CASE WHEN a.bad THEN (SELECT min(b.i) FROM e b WHERE b.user_id = a.user_id AND b.t >= a.t + {WAIT}) ELSE a.i + 1 END AS after FROM e a),
r AS (SELECT user_id, i, after FROM x WHERE i = 1 UNION ALL SELECT x.user_id, x.i, x.after FROM r JOIN x ON x.user_id = r.user_id AND x.i = r.after)
SELECT e.user_id AS key, e.event_id AS id, CASE WHEN r.i IS NULL THEN 'held' WHEN bad THEN 'failed' ELSE 'done' END AS said FROM e LEFT JOIN r ON r.user_id = e.user_id AND r.i = e.i""")
def x_retry_state(spark, sf):
    """Events as attempts of their user: errors fail, and hold back what comes within twelve hours."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        return follow(spark, sf, "events", lambda s: gated(_attempts(s), WAIT), "append")
    finally:
        spark.conf.set(PROVIDER, before)


def _hosts(old, batch):
    """Pages and the last page of each host, with those of the batch."""
    new = batch.where(F.col("url").isNotNull()).select(F.lower(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1)).alias("host"), F.lit(1).cast("long").alias("pages"), F.col("page_id").alias("last_page"))
    every = new if old is None else old.unionByName(new)
    return every.groupBy("host").agg(F.sum("pages").alias("pages"), F.max("last_page").alias("last_page"))


@query("x_reload_ttl", "SELECT lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host, count(*) AS pages, max(page_id) AS last_page FROM pages WHERE url IS NOT NULL GROUP BY 1")
def x_reload_ttl(spark, sf):
    """An index of hosts over a growing table, swapped in batch by batch; the last good version."""
    return follow_snapshots(spark, sf, "pages", _hosts).current()


def _sizes(rows):
    return rows.select("key", F.concat_ws("/", F.size(T.words(F.col("content"))), F.size(F.array_distinct(T.words(F.col("content"))))).alias("result"))


_COUNTS = "concat_ws('/', len(regexp_extract_all(lower(text), '[a-z]+')), len(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))))"


@query("x_replay_cache", f"SELECT doc_id AS key, {_COUNTS} AS result, lang <> 'de' AND doc_id % 10 <> 3 AS cached FROM documents")
def x_replay_cache(spark, sf):
    """A second run over the documents: those that the first run had with the same text and version are replayed."""
    docs = table(spark, sf, "documents")
    content = F.when(F.col("doc_id") % 10 == 3, F.concat("text", F.lit(" old"))).otherwise(F.col("text"))
    none = spark.createDataFrame([], "key long, version string, stamp string, result string")
    first = written(replayed(docs.where("lang <> 'de'").select(F.col("doc_id").alias("key"), content.alias("content")), none, "2", _sizes), "answers")
    return replayed(docs.select(F.col("doc_id").alias("key"), F.col("text").alias("content")), first.drop("cached"), "2", _sizes).select("key", "result", "cached")
