"""Operators on arrays: sequence scores, vector transforms, distances."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexigrid.functions import text as T
from lexigrid.operators import sequences as Q
from lexigrid.registry import query, table

WORDS = "regexp_extract_all(lower(text), '[a-z]+')"
TURNS = f"SELECT conv_id, turn, {WORDS} AS hyp, lag({WORDS}) OVER (PARTITION BY conv_id ORDER BY turn) AS ref FROM conversations"


def _turns(spark, sf):
    """Each turn's words with those of the turn before, which stand for the reference."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", T.words(F.col("text")).alias("hyp"))
    return c.withColumn("ref", F.lag("hyp").over(Window.partitionBy("conv_id").orderBy("turn"))).where("ref IS NOT NULL")


@query("v_wer")
def v_wer(spark, sf):
    """Edits over the reference's length; an empty reference scores 0 against nothing, else 1."""
    t = _turns(spark, sf).withColumn("edits", Q.edit_distance("ref", "hyp"))
    empty = F.when(F.size("hyp") == 0, 0.0).otherwise(1.0)
    return t.select("conv_id", "turn", "edits", F.when(F.size("ref") == 0, empty).otherwise(F.col("edits") / F.size("ref")).alias("wer"))


@query("v_lcs")
def v_lcs(spark, sf):
    t = _turns(spark, sf).withColumn("lcs", Q.common_length("ref", "hyp"))
    n = F.size("ref") + F.size("hyp")
    return t.select("conv_id", "turn", "lcs", F.when(n > 0, 2 * F.col("lcs") / n).otherwise(0.0).alias("f1"))


@query("v_rouge", f"WITH t AS ({TURNS}), r AS (SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, unnest(ref) AS w FROM t) GROUP BY ALL), h AS (SELECT conv_id, turn, w, count(*) AS m FROM (SELECT conv_id, turn, unnest(hyp) AS w FROM t WHERE ref IS NOT NULL) GROUP BY ALL), s AS (SELECT conv_id, turn, sum(least(n, m)) AS same FROM r JOIN h USING (conv_id, turn, w) GROUP BY ALL) SELECT conv_id, turn, round(2.0::DOUBLE * same / (len(ref) + len(hyp)), 6) AS f1 FROM t JOIN s USING (conv_id, turn)")
def v_rouge(spark, sf):
    """F1 of the words' multisets; turns without a common word give no row."""
    t = _turns(spark, sf)
    bag = lambda c, n: t.select("conv_id", "turn", F.explode(c).alias("w")).groupBy("conv_id", "turn", "w").agg(F.count("*").alias(n))
    same = bag("ref", "n").join(bag("hyp", "m"), ["conv_id", "turn", "w"]).groupBy("conv_id", "turn").agg(F.sum(F.least("n", "m")).alias("same"))
    return t.join(same, ["conv_id", "turn"]).select("conv_id", "turn", F.round(2 * F.col("same") / (F.size("ref") + F.size("hyp")), 6).alias("f1"))


@query("v_gloss_acc", f"SELECT conv_id, turn, CASE WHEN len(ref) > 0 THEN round(len(list_filter(range(1, least(len(ref), len(hyp)) + 1), lambda i: ref[i] = hyp[i]))::DOUBLE / len(ref), 6) END AS acc FROM ({TURNS}) WHERE ref IS NOT NULL")
def v_gloss_acc(spark, sf):
    """Words that stand at the reference's place, over its length."""
    hits = F.size(F.filter(F.arrays_zip("ref", "hyp"), lambda x: x["ref"] == x["hyp"]))
    return _turns(spark, sf).select("conv_id", "turn", F.when(F.size("ref") > 0, F.round(hits / F.size("ref"), 6)).alias("acc"))


VEC = "list_transform(embedding, lambda x: x::DOUBLE)"


@query("v_mirror", f"SELECT vec_id, round(list_sum(list_transform(range(1, len(e) + 1), lambda i: CASE WHEN i % 2 = 1 THEN -e[i] ELSE e[i] END * i)), 4) AS digest FROM (SELECT vec_id, {VEC} AS e FROM embeddings)")
def v_mirror(spark, sf):
    """Every second component, as the x of points, changes sign; a weighted sum stands for the vector."""
    flipped = F.transform("embedding", lambda x, i: F.when(i % 2 == 0, -x.cast("double")).otherwise(x.cast("double")) * (i + 1))
    return table(spark, sf, "embeddings").select("vec_id", F.round(F.aggregate(flipped, F.lit(0.0), lambda s, x: s + x), 4).alias("digest"))


@query("v_segvec", "SELECT vec_id, list_transform(range(0, 16), lambda i: embedding[CAST(floor(i * (len(embedding) - 1) / 15.0::DOUBLE + 0.5) AS INT) + 1]) AS picked FROM embeddings")
def v_segvec(spark, sf):
    """Sixteen components at even steps, the nearest index of each."""
    at = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.floor(i * (F.size("embedding") - 1) / 15 + 0.5).cast("int"))
    return table(spark, sf, "embeddings").select("vec_id", F.transform(at, lambda i: F.element_at("embedding", i + 1)).alias("picked"))


@query("v_hand", "SELECT vec_id, CASE WHEN list_max(embedding[1:32]) >= list_max(embedding[33:64]) THEN 'left' ELSE 'right' END AS hand FROM embeddings")
def v_hand(spark, sf):
    """The half that reaches higher."""
    half = lambda s: F.array_max(F.slice("embedding", s, 32))
    return table(spark, sf, "embeddings").select("vec_id", F.when(half(1) >= half(33), "left").otherwise("right").alias("hand"))


@query("v_zscore_vel", "WITH v AS (SELECT event_id, user_id, ts, value FROM events), m AS (SELECT user_id, avg(value) AS a, stddev_pop(value) AS s FROM v WHERE value <> 0 GROUP BY user_id), z AS (SELECT event_id, user_id, ts, CASE WHEN value = 0 OR coalesce(s, 0) < 1e-9 THEN 0 ELSE (value - a) / s END AS z FROM v LEFT JOIN m USING (user_id)) SELECT event_id, round(z, 5) AS z, round(z - lag(z, 1, z) OVER (PARTITION BY user_id ORDER BY ts, event_id), 5) AS step FROM z")
def v_zscore_vel(spark, sf):
    """Values in standard deviations from the mean of the series' non-zero ones, and steps between them."""
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    m = e.where("value <> 0").groupBy("user_id").agg(F.avg("value").alias("a"), F.stddev_pop("value").alias("s"))
    flat = (F.col("value") == 0) | (F.coalesce("s", F.lit(0.0)) < 1e-9)
    z = e.join(m, "user_id", "left").withColumn("z", F.when(flat, 0.0).otherwise((F.col("value") - F.col("a")) / F.col("s")))
    before = F.coalesce(F.lag("z").over(Window.partitionBy("user_id").orderBy("ts", "event_id")), F.col("z"))
    return z.select("event_id", F.round("z", 5).alias("z"), F.round(F.col("z") - before, 5).alias("step"))


@query("v_tau_min", "SELECT label, min(list_min(embedding)) AS low FROM embeddings GROUP BY label")
def v_tau_min(spark, sf):
    return table(spark, sf, "embeddings").groupBy("label").agg(F.min(F.array_min("embedding")).alias("low"))


@query("v_assign_check", "SELECT vec_id, abs(embedding[1] - embedding[3]) + abs(embedding[2] - embedding[4]) < abs(embedding[1] - embedding[4]) + abs(embedding[2] - embedding[3]) AS straight FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS embedding FROM embeddings)")
def v_assign_check(spark, sf):
    """Whether two points are nearer to their own partners than crosswise."""
    at = lambda i: F.element_at("embedding", i).cast("double")
    d = lambda i, j: F.abs(at(i) - at(j))
    return table(spark, sf, "embeddings").select("vec_id", (d(1, 3) + d(2, 4) < d(1, 4) + d(2, 3)).alias("straight"))
