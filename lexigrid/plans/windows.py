"""Window operators over whole tables; the series are each user's events in order of time."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexigrid.operators import lexicon as L
from lexigrid.operators import series as S
from lexigrid.registry import query, table

SER = "WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"
NUM = "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS f FROM events"


def _w():
    return Window.partitionBy("user_id").orderBy("ts", "event_id")


def _seconds():
    """Seconds of ts, which holds no time zone."""
    return F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01', ts)") / 1e6


def _events(spark, sf):
    return table(spark, sf, "events")


def _numbered(spark, sf):
    return _events(spark, sf).withColumn("f", F.row_number().over(_w()) - 1)


@query("w_first_wins", "SELECT c_mktsegment, c_custkey, c_name FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey, c_custkey) AS rn FROM customer) WHERE rn = 1")
def w_first_wins(spark, sf):
    return L.first_wins(table(spark, sf, "customer"), "c_mktsegment", "c_nationkey", "c_custkey").select("c_mktsegment", "c_custkey", "c_name")


@query("w_rrf_rank", "SELECT user_id, event_id, round(1::DOUBLE / (60 + row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id)), 6) AS part FROM events")
def w_rrf_rank(spark, sf):
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id"))
    return _events(spark, sf).select("user_id", "event_id", F.round(1 / (60 + rank), 6).alias("part"))


@query("w_per_signer", "WITH a AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events), b AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY k, user_id) AS rn FROM a) SELECT event_type, user_id, event_id FROM b WHERE rn <= 12")
def w_per_signer(spark, sf):
    """Round after round over the signers, each giving its next row, until there are twelve rows."""
    own = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    turns = _events(spark, sf).withColumn("k", F.row_number().over(own)).where("k <= 12")
    return turns.withColumn("rn", F.row_number().over(Window.partitionBy("event_type").orderBy("k", "user_id"))).where("rn <= 12").select("event_type", "user_id", "event_id")


@query("w_diff", f"SELECT event_id, round(value - lag(value, 1, value) OVER w, 6) AS diff FROM events {SER}")
def w_diff(spark, sf):
    return _events(spark, sf).select("event_id", F.round(F.col("value") - F.coalesce(F.lag("value").over(_w()), F.col("value")), 6).alias("diff"))


@query("w_runs", f"WITH a AS (SELECT *, value > 50 AS up, CASE WHEN value > 50 AND NOT coalesce(lag(value > 50) OVER w, false) THEN 1 ELSE 0 END AS s FROM events {SER}), b AS (SELECT *, sum(s) OVER w AS run FROM a {SER}) SELECT user_id, CAST(run AS BIGINT) AS run, CAST(count(*) AS BIGINT) AS n, min(event_id) AS low FROM b WHERE up GROUP BY user_id, run")
def w_runs(spark, sf):
    r = S.runs(_events(spark, sf), F.col("value") > 50, "user_id", "ts", "event_id")
    return r.groupBy("user_id", "run").agg(F.count("*").alias("n"), F.min("event_id").alias("low"))


SESSION = f"WITH a AS (SELECT *, CASE WHEN epoch(ts) - lag(epoch(ts)) OVER w <= 21600 THEN 0 ELSE 1 END AS s FROM events {SER}), b AS (SELECT *, sum(s) OVER w AS session FROM a {SER}) "


def _sessions(spark, sf):
    return S.sessions(_events(spark, sf), _seconds(), 21600, "user_id", "ts", "event_id")


@query("w_runs_gap", SESSION + "SELECT user_id, CAST(session AS BIGINT) AS session, CAST(count(*) AS BIGINT) AS n FROM b GROUP BY user_id, session HAVING count(*) >= 2")
def w_runs_gap(spark, sf):
    """Runs that bridge gaps of up to six hours, of two events or more."""
    return _sessions(spark, sf).groupBy("user_id", "session").agg(F.count("*").alias("n")).where("n >= 2")


BIO = f"WITH a AS (SELECT *, CASE event_type WHEN 'signup' THEN 'B' WHEN 'purchase' THEN 'B' WHEN 'error' THEN 'O' ELSE 'I' END AS tag FROM events), b AS (SELECT *, CASE WHEN tag = 'B' OR (tag = 'I' AND coalesce(lag(tag) OVER w, 'O') = 'O') THEN 1 ELSE 0 END AS s FROM a {SER}), c AS (SELECT *, sum(s) OVER w AS seg FROM b {SER}) "


def _bio(spark, sf):
    tag = F.when(F.col("event_type").isin("signup", "purchase"), "B").when(F.col("event_type") == "error", "O").otherwise("I")
    e = _events(spark, sf).withColumn("tag", tag)
    opens = (F.col("tag") == "B") | ((F.col("tag") == "I") & (F.coalesce(F.lag("tag").over(_w()), F.lit("O")) == "O"))
    return e.withColumn("s", F.when(opens, 1).otherwise(0)).withColumn("seg", F.sum("s").over(_w())).where("tag <> 'O'")


@query("w_bio", BIO + "SELECT user_id, CAST(seg AS BIGINT) AS seg, CAST(count(*) AS BIGINT) AS n FROM c WHERE tag <> 'O' GROUP BY user_id, seg")
def w_bio(spark, sf):
    """B opens a segment, I continues or opens one, O closes."""
    return _bio(spark, sf).groupBy("user_id", "seg").agg(F.count("*").alias("n"))


@query("w_merge_gap", SESSION + ", g AS (SELECT user_id, session, min(epoch(ts)) AS s, max(epoch(ts)) AS e FROM b GROUP BY ALL), m AS (SELECT *, CASE WHEN s - lag(e) OVER (PARTITION BY user_id ORDER BY s) <= 86400 THEN 0 ELSE 1 END AS x FROM g), n AS (SELECT *, sum(x) OVER (PARTITION BY user_id ORDER BY s) AS k FROM m) SELECT user_id, CAST(k AS BIGINT) AS k, CAST(count(*) AS BIGINT) AS merged FROM n GROUP BY user_id, k HAVING max(e) - min(s) >= 3600")
def w_merge_gap(spark, sf):
    """Segments no more than a day apart are merged, then those shorter than an hour dropped."""
    g = _sessions(spark, sf).withColumn("t", _seconds()).groupBy("user_id", "session").agg(F.min("t").alias("s"), F.max("t").alias("e"))
    w = Window.partitionBy("user_id").orderBy("s")
    n = g.withColumn("x", F.when(F.col("s") - F.lag("e").over(w) <= 86400, 0).otherwise(1)).withColumn("k", F.sum("x").over(w))
    return n.groupBy("user_id", "k").agg(F.count("*").alias("merged"), (F.max("e") - F.min("s")).alias("long")).where("long >= 3600").drop("long")


@query("w_median_filter", "SELECT event_id, round(quantile_cont(value, 0.5) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS smooth FROM events")
def w_median_filter(spark, sf):
    around = F.sort_array(F.collect_list("value").over(_w().rowsBetween(-1, 1)))
    n = F.size(around)
    middle = (F.get(around, ((n - 1) / 2).cast("int")) + F.get(around, (n / 2).cast("int"))) / 2
    return _events(spark, sf).select("event_id", F.round(middle, 6).alias("smooth"))


#: Five taps of a Hann window: sin^2(pi * k / 6) for k = 1 to 5, over their sum.
HANN = (1 / 12, 3 / 12, 4 / 12, 3 / 12, 1 / 12)


@query("w_hann", f"""WITH n AS ({NUM}), c AS (SELECT user_id, max(f) AS last FROM n GROUP BY user_id), t AS (SELECT unnest([-2, -1, 0, 1, 2]) AS o, unnest([1, 3, 4, 3, 1]) AS h)
SELECT n.event_id, round(sum(h * m.value) / 12::DOUBLE, 6) AS smooth FROM n JOIN c USING (user_id), t JOIN n m ON m.user_id = n.user_id AND m.f = greatest(0, least(last, n.f + o)) GROUP BY n.event_id""")
def w_hann(spark, sf):
    """Five taps; beyond an edge the edge's value stands."""
    first, last = F.min_by("value", F.struct("ts", "event_id")), F.max_by("value", F.struct("ts", "event_id"))
    by = Window.partitionBy("user_id")
    tap = {-2: F.lag("value", 2), -1: F.lag("value"), 1: F.lead("value"), 2: F.lead("value", 2)}
    value = lambda k: F.col("value") if k == 0 else F.coalesce(tap[k].over(_w()), (first if k < 0 else last).over(by))
    return _events(spark, sf).select("event_id", F.round(sum(h * value(k) for k, h in zip(range(-2, 3), HANN, strict=True)), 6).alias("smooth"))


@query("w_boxcar", f"SELECT event_id, round((coalesce(lag(value) OVER w, 0) + value + coalesce(lead(value) OVER w, 0)) / 3, 6) AS smooth FROM events {SER}")
def w_boxcar(spark, sf):
    """Zero beyond the edges."""
    side = lambda x: F.coalesce(x.over(_w()), F.lit(0.0))
    return _events(spark, sf).select("event_id", F.round((side(F.lag("value")) + F.col("value") + side(F.lead("value"))) / 3, 6).alias("smooth"))


@query("w_fill_linear", f"""WITH n AS ({NUM}), k AS (SELECT *, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v FROM n), b AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN f END IGNORE NULLS) OVER p AS x0, first_value(CASE WHEN v IS NOT NULL THEN f END IGNORE NULLS) OVER q AS x1, last_value(v IGNORE NULLS) OVER p AS y0, first_value(v IGNORE NULLS) OVER q AS y1 FROM k
 WINDOW p AS (PARTITION BY user_id ORDER BY f ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), q AS (PARTITION BY user_id ORDER BY f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_id, round(coalesce(CASE WHEN x0 = x1 THEN y0 ELSE y0 + (y1 - y0) * (f - x0) / (x1 - x0) END, y0, y1, 0), 6) AS filled FROM b""")
def w_fill_linear(spark, sf):
    """Values of every seventh event are taken away first."""
    e = _numbered(spark, sf).withColumn("v", F.when(F.col("event_id") % 7 != 0, F.col("value")))
    return S.fill_linear(e, "v", "f", "user_id").select("event_id", F.round("filled", 6).alias("filled"))


@query("w_resample_idx", f"WITH n AS ({NUM}), c AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id), g AS (SELECT user_id, k, CAST(round(k * (n - 1) / 7.0::DOUBLE) AS BIGINT) AS f FROM c, (SELECT unnest(range(8)) AS k)) SELECT g.user_id, CAST(k AS INT) AS k, n.value FROM g JOIN n ON g.user_id = n.user_id AND g.f = n.f")
def w_resample_idx(spark, sf):
    """Eight rows of each series at rounded even steps."""
    n = _numbered(spark, sf)
    counts = _events(spark, sf).groupBy("user_id").agg(F.count("*").alias("n"))
    g = counts.select("user_id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k"), "n").withColumn("f", F.round(F.col("k") * (F.col("n") - 1) / 7.0).cast("int"))
    return g.join(n, ["user_id", "f"]).select("user_id", "k", "value")


@query("w_resample_lin", f"WITH n AS ({NUM}), c AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id), g AS (SELECT user_id, k, k * (n - 1) / 4.0::DOUBLE AS x FROM c, (SELECT unnest(range(5)) AS k)) SELECT g.user_id, CAST(k AS INT) AS k, round(a.value + (b.value - a.value) * (x - floor(x)), 6) AS value FROM g JOIN n a ON g.user_id = a.user_id AND a.f = floor(x) JOIN n b ON g.user_id = b.user_id AND b.f = ceil(x)")
def w_resample_lin(spark, sf):
    """Five points of each series by linear interpolation."""
    n = _numbered(spark, sf).select("user_id", "f", "value", F.lead("value", 1).over(_w()).alias("after"))
    counts = _events(spark, sf).groupBy("user_id").agg(F.count("*").alias("n"))
    g = counts.select("user_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k"), "n").withColumn("x", F.col("k") * (F.col("n") - 1) / 4.0).withColumn("f", F.floor("x").cast("int"))
    part = F.col("x") - F.floor("x")
    return g.join(n, ["user_id", "f"]).select("user_id", "k", F.round(F.col("value") + (F.coalesce("after", "value") - F.col("value")) * part, 6).alias("value"))


@query("w_resample_time", """WITH s AS (SELECT user_id, epoch_us(ts) AS t, arg_max(value, event_id) AS v FROM events GROUP BY ALL), b AS (SELECT user_id, min(t) AS t0, max(t) AS t1 FROM s GROUP BY user_id),
g AS (SELECT user_id, unnest(range(t0, t1 + 1, 21600000000)) AS t FROM b), p AS (SELECT g.user_id, g.t, s.t AS x0, s.v AS y0 FROM g ASOF JOIN s ON g.user_id = s.user_id AND g.t >= s.t),
q AS (SELECT p.*, s.t AS x1, s.v AS y1 FROM p ASOF LEFT JOIN s ON p.user_id = s.user_id AND p.t <= s.t)
SELECT user_id, t, round(CASE WHEN x1 = x0 THEN y0 ELSE y0 + (y1 - y0) * ((t - x0)::DOUBLE / (x1 - x0)) END, 5) AS value FROM q""")
def w_resample_time(spark, sf):
    """A point every six hours from each series' first event to its last, on the line between the events around it."""
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01', ts)")
    known = _events(spark, sf).groupBy("user_id", micros.alias("t")).agg(F.max_by("value", "event_id").alias("v"))
    return S.resample_time(known, "t", "v", "user_id", 21_600_000_000).select("user_id", "t", F.round("value", 5).alias("value"))


@query("w_norm_clip", "WITH m AS (SELECT *, median(value) OVER (PARTITION BY user_id) AS mid FROM events) SELECT event_id, round(value / mid, 6) AS norm FROM m WHERE mid <> 0")
def w_norm_clip(spark, sf):
    mid = _events(spark, sf).groupBy("user_id").agg(F.median("value").alias("mid")).where("mid <> 0")
    return _events(spark, sf).join(mid, "user_id").select("event_id", F.round(F.col("value") / F.col("mid"), 6).alias("norm"))


@query("w_proportion", "WITH m AS (SELECT *, median(value) OVER (PARTITION BY user_id) AS mid, avg(value) OVER (PARTITION BY user_id) AS a FROM events) SELECT event_id, round((value - a) * 0.5::DOUBLE / mid, 5) AS scaled FROM m WHERE mid > 0")
def w_proportion(spark, sf):
    m = _events(spark, sf).groupBy("user_id").agg(F.median("value").alias("mid"), F.avg("value").alias("a")).where("mid > 0")
    return _events(spark, sf).join(m, "user_id").select("event_id", F.round((F.col("value") - F.col("a")) * 0.5 / F.col("mid"), 5).alias("scaled"))


@query("w_offsets", "SELECT l_orderkey, l_linenumber, CAST(coalesce(sum(CAST(l_quantity AS BIGINT) + 5) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM lineitem")
def w_offsets(spark, sf):
    """Starts of clips joined with transitions of five frames."""
    before = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").rowsBetween(Window.unboundedPreceding, -1)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.coalesce(F.sum(F.col("l_quantity").cast("long") + 5).over(before), F.lit(0)).alias("start"))


@query("w_transition", f"WITH p AS (SELECT event_id, value, lead(value) OVER w AS after FROM events {SER}) SELECT event_id, CAST(k AS INT) AS k, round(value + (after - value) * (3 * (k / 4.0::DOUBLE) ** 2 - 2 * (k / 4.0::DOUBLE) ** 3), 9) AS value FROM p, (SELECT unnest([1, 2, 3]) AS k) WHERE after IS NOT NULL")
def w_transition(spark, sf):
    p = _events(spark, sf).select("event_id", "value", F.lead("value").over(_w()).alias("after")).where("after IS NOT NULL")
    s = F.col("k") / 4.0
    return p.withColumn("k", F.explode(F.array(*map(F.lit, (1, 2, 3))))).select("event_id", "k", F.round(F.col("value") + (F.col("after") - F.col("value")) * (3 * s * s - 2 * s * s * s), 9).alias("value"))


@query("w_velocity_seg", f"""WITH n AS ({NUM}), d AS (SELECT *, abs(value - lag(value, 1, value) OVER w) AS v FROM n WINDOW w AS (PARTITION BY user_id ORDER BY f)), m AS (SELECT *, v < 0.15 * max(v) OVER (PARTITION BY user_id) AS slow FROM d),
r AS (SELECT *, f - row_number() OVER (PARTITION BY user_id, slow ORDER BY f) AS run FROM m), p AS (SELECT *, slow AND count(*) OVER (PARTITION BY user_id, slow, run) >= 8 AS pause FROM r),
s AS (SELECT *, f - row_number() OVER (PARTITION BY user_id, pause ORDER BY f) AS seg FROM p)
SELECT user_id, CAST(min(f) AS INT) AS start, CAST(max(f) + 1 AS INT) AS "end" FROM s WHERE NOT pause GROUP BY user_id, seg""")
def w_velocity_seg(spark, sf):
    """Pauses are 8 rows or more in a row that move less than 0.15 times as fast as the series' fastest; what lies between are segments."""
    d = _numbered(spark, sf).withColumn("v", F.abs(F.col("value") - F.coalesce(F.lag("value").over(_w()), F.col("value"))))
    m = d.withColumn("slow", F.col("v") < F.lit(0.15) * F.max("v").over(Window.partitionBy("user_id")))
    runs = m.withColumn("run", F.col("f") - F.row_number().over(Window.partitionBy("user_id", "slow").orderBy("f")))
    pause = F.col("slow") & (F.count("*").over(Window.partitionBy("user_id", "slow", "run")) >= 8)
    segments = S.runs(runs.withColumn("pause", pause).drop("run"), ~F.col("pause"), "user_id", "f")
    return segments.groupBy("user_id", "run").agg(F.min("f").alias("start"), (F.max("f") + 1).alias("end")).drop("run")


@query("w_uniform_seg", f"SELECT user_id, CAST(f // 35 AS BIGINT) AS seg, CAST(count(*) AS BIGINT) AS n FROM ({NUM}) GROUP BY ALL HAVING count(*) >= 4")
def w_uniform_seg(spark, sf):
    return _numbered(spark, sf).groupBy("user_id", F.floor(F.col("f") / 35).alias("seg")).agg(F.count("*").alias("n")).where("n >= 4")


@query("w_sliding", " UNION ALL ".join(f"SELECT user_id, CAST(f AS INT) AS f, {n} AS length FROM (SELECT user_id, f, count(*) OVER x AS n, count(*) FILTER (WHERE value > 20) OVER x AS a FROM ({NUM}) WINDOW x AS (PARTITION BY user_id ORDER BY f ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING)) WHERE n = {n} AND f % 4 = 0 AND 5 * a >= 3 * {n}" for n in (16, 24, 32, 44)))
def w_sliding(spark, sf):
    """Windows of 16, 24, 32 and 44 rows, step 4, with at least 60 % active rows: differences of running counts."""
    active = F.sum(F.when(F.col("value") > 20, 1).otherwise(0)).over(Window.partitionBy("user_id").orderBy("f"))
    n = _numbered(spark, sf).withColumn("on", F.when(F.col("value") > 20, 1).otherwise(0)).withColumn("upto", active)
    ends = F.array(*(F.struct(F.lit(k).alias("length"), F.lead("upto", k - 1).over(Window.partitionBy("user_id").orderBy("f")).alias("upto")) for k in (16, 24, 32, 44)))
    each = n.withColumn("ends", ends).where("f % 4 = 0").select("user_id", "f", (F.col("upto") - F.col("on")).alias("before"), F.explode("ends").alias("e"))
    return each.where("5 * (e.upto - before) >= 3 * e.length").select("user_id", "f", "e.length")


@query("w_hold", f"""WITH d AS (SELECT *, abs(value - lag(value, 1, value) OVER (PARTITION BY user_id ORDER BY f)) AS v, count(*) OVER (PARTITION BY user_id) AS rows FROM ({NUM})), s AS (SELECT user_id, f, rows, sum(v) OVER x AS s, count(*) OVER x AS n FROM d WINDOW x AS (PARTITION BY user_id ORDER BY f ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING))
SELECT user_id, CAST(arg_min(f, (round(s, 6), f)) AS INT) AS start FROM s WHERE n = 4 AND 10 * f >= rows AND 10 * (f + 4) <= 9 * rows GROUP BY user_id""")
def w_hold(spark, sf):
    """Start of the window of four rows with the least movement, in the middle 80 % of the series."""
    d = _numbered(spark, sf).withColumns({"v": F.abs(F.col("value") - F.coalesce(F.lag("value").over(_w()), F.col("value"))), "rows": F.count("*").over(Window.partitionBy("user_id"))})
    ahead = Window.partitionBy("user_id").orderBy("f").rowsBetween(0, 3)
    s = d.withColumns({"s": F.sum("v").over(ahead), "n": F.count("*").over(ahead)}).where("n = 4 AND 10 * f >= rows AND 10 * (f + 4) <= 9 * rows")
    return s.groupBy("user_id").agg(F.min(F.struct(F.round("s", 6).alias("s"), "f"))["f"].alias("start"))


@query("w_partition_mid", f"SELECT event_id, round((value + lead(value) OVER w) / 2, 6) AS cut FROM events {SER}")
def w_partition_mid(spark, sf):
    return _events(spark, sf).select("event_id", F.round((F.col("value") + F.lead("value").over(_w())) / 2, 6).alias("cut"))


@query("w_cumshare", "WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source) SELECT source, round(sum(n) OVER (ORDER BY n DESC, source)::DOUBLE / (SELECT sum(n) FROM n), 6) AS share FROM n")
def w_cumshare(spark, sf):
    n = table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"))
    w = Window.orderBy(F.desc("n"), "source")  # a row for each source
    return n.select("source", F.round(F.sum("n").over(w) / F.sum("n").over(Window.partitionBy()), 6).alias("share"))


@query("w_choice", "SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS choice, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS tier FROM part")
def w_choice(spark, sf):
    by = Window.partitionBy("p_brand")
    return table(spark, sf, "part").select("p_brand", "p_partkey", F.row_number().over(by.orderBy(F.desc("p_retailprice"), "p_partkey")).alias("choice"), F.dense_rank().over(by.orderBy("p_size")).alias("tier"))


@query("w_caption_change", f"WITH d AS (SELECT *, abs(value - lag(value) OVER w) AS v FROM events {SER}), m AS (SELECT user_id, avg(v) + 2 * stddev_pop(v) AS cut FROM d GROUP BY user_id) SELECT event_id FROM d JOIN m USING (user_id) WHERE v > cut + 1e-9")
def w_caption_change(spark, sf):
    """Steps of more than mean + two standard deviations of their series."""
    d = _events(spark, sf).withColumn("v", F.abs(F.col("value") - F.lag("value").over(_w())))
    m = d.groupBy("user_id").agg((F.avg("v") + 2 * F.stddev_pop("v")).alias("cut"))
    return d.join(m, "user_id").where("v > cut + 1e-9").select("event_id")


@query("w_segment_fill", f"""WITH n AS ({NUM}), k AS (SELECT *, CASE WHEN event_type <> 'error' THEN value END AS v, CASE WHEN event_type <> 'error' THEN f END AS x FROM n), b AS (SELECT event_id, f, max(x) OVER (PARTITION BY user_id ORDER BY f ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS x0, min(x) OVER (PARTITION BY user_id ORDER BY f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS x1, user_id FROM k)
SELECT b.event_id, round(CASE WHEN x0 IS NULL OR x1 IS NULL THEN coalesce(p.v, q.v, 0) WHEN x0 = x1 THEN p.v ELSE p.v + (q.v - p.v) * ((b.f - x0)::DOUBLE / (x1 - x0)) END, 5) AS filled FROM b LEFT JOIN k p ON p.user_id = b.user_id AND p.f = x0 LEFT JOIN k q ON q.user_id = b.user_id AND q.f = x1""")
def w_segment_fill(spark, sf):
    """Rows to fill lie on the line between the rows around them; at the ends the nearest holds, 0 where there is none."""
    e = _numbered(spark, sf).withColumn("v", F.when(F.col("event_type") != "error", F.col("value")))
    return S.fill_linear(e, "v", "f", "user_id").select("event_id", F.round("filled", 5).alias("filled"))
