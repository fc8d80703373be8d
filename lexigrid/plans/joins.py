"""Joins over whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexigrid.functions import text as T
from lexigrid.operators import lexicon as L
from lexigrid.operators import retrieval as R
from lexigrid.plans.text import CANDIDATES, VOCAB
from lexigrid.registry import query, table
from lexigrid.sources.files import written

WORDS = "regexp_extract_all(lower(text), '[a-z]+')"
LEX = f"SELECT DISTINCT unnest({WORDS}) AS key FROM benchmark"


def _vocab(spark, sf):
    return table(spark, sf, "documents").select(F.explode(T.words(F.col("text"))).alias("word")).distinct()


def _lex(spark, sf, name="benchmark"):
    return table(spark, sf, name).select(F.explode(T.words(F.col("text"))).alias("key")).distinct()


@query("j_lookup", f"SELECT v.word, l.key IS NOT NULL AS found FROM ({VOCAB}) v LEFT JOIN ({LEX}) l ON v.word = l.key")
def j_lookup(spark, sf):
    lex = _lex(spark, sf)
    return _vocab(spark, sf).join(lex, F.col("word") == F.col("key"), "left").select("word", F.col("key").isNotNull().alias("found"))


@query("j_first_match", f"SELECT v.word, arg_min(c.cand, c.pos) AS entry FROM ({VOCAB}) v LEFT JOIN (SELECT word, cand, pos FROM ({CANDIDATES}) JOIN ({LEX}) ON cand = key) c ON v.word = c.word GROUP BY v.word")
def j_first_match(spark, sf):
    return L.first_match(_vocab(spark, sf), T.candidates_en(F.col("word")), _lex(spark, sf), "word").select("word", "entry")


GRAMS = "SELECT doc_id, i AS start, concat(w[i + 1], ' ', w[i + 2]) AS key FROM (SELECT doc_id, w, unnest(range(len(w) - 1)) AS i FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents))"
PHRASES = GRAMS.replace("doc_id", "item_id").replace("documents", "benchmark")


def _words(spark, sf, name, key):
    return table(spark, sf, name).select(key, T.words(F.col("text")).alias("words"))


@query("j_phrase_any", f"WITH p AS (SELECT key FROM ({PHRASES}) GROUP BY key HAVING count(*) >= 3) SELECT doc_id, CAST(count(DISTINCT pos) AS BIGINT) AS covered FROM (SELECT doc_id, unnest([start, start + 1]) AS pos FROM ({GRAMS}) JOIN p USING (key)) GROUP BY doc_id")
def j_phrase_any(spark, sf):
    """Positions of each document that lie in some phrase; phrases are word pairs that the benchmark uses three times or more."""
    phrases = L.ngrams(_words(spark, sf, "benchmark", "item_id"), 2, "item_id").groupBy("key").count().where("count >= 3").select("key")
    hits = L.ngrams(_words(spark, sf, "documents", "doc_id"), 2, "doc_id").join(phrases, "key")
    return hits.select("doc_id", F.explode(F.array(F.col("start"), F.col("start") + 1)).alias("pos")).groupBy("doc_id").agg(F.count_distinct("pos").alias("covered"))


@query("j_phrase_greedy")
def j_phrase_greedy(spark, sf):
    """Longest first, left to right, without overlap: phrases of three and two words."""
    bench, docs = _words(spark, sf, "benchmark", "item_id"), _words(spark, sf, "documents", "doc_id")
    hits = None
    for n in (3, 2):
        phrases = L.ngrams(bench, n, "item_id").groupBy("key").count().where("count >= 2").select("key")
        one = L.ngrams(docs, n, "doc_id").join(phrases, "key").withColumn("n", F.lit(n))
        hits = one if hits is None else hits.unionByName(one)
    ordered = hits.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", (-F.col("n")).alias("size"), "key"))).alias("hits"))  # the hits of one document
    step = lambda s, h: F.when(h["start"] >= s["end"], F.struct((h["start"] - h["size"]).cast("long").alias("end"), F.concat(s["keys"], F.array(h["key"])).alias("keys"))).otherwise(s)
    start = F.struct(F.lit(0).cast("long").alias("end"), F.array().cast("array<string>").alias("keys"))
    return ordered.select("doc_id", F.array_join(F.aggregate("hits", start, step)["keys"], "|").alias("phrases"))


@query("j_prefix", f"SELECT word, any_value(key) AS entry FROM ({VOCAB}) JOIN ({LEX}) ON left(word, 6) = left(key, 6) AND starts_with(word, key) AND length(key) >= 6 AND word <> key GROUP BY word HAVING count(*) = 1")
def j_prefix(spark, sf):
    lex = _lex(spark, sf).where("length(key) >= 6").withColumn("six", F.substring("key", 1, 6))
    hit = _vocab(spark, sf).withColumn("six", F.substring("word", 1, 6)).join(lex, "six").where(F.col("word").startswith(F.col("key")) & (F.col("word") != F.col("key")))
    return hit.groupBy("word").agg(F.count("*").alias("n"), F.first("key").alias("entry")).where("n = 1").select("word", "entry")


BM25 = f"""WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents), s AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM d),
p AS (SELECT doc_id, len(w) AS dl, term, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS term FROM d) GROUP BY doc_id, w, term),
i AS (SELECT term, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM p, s GROUP BY term),
q AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({WORDS}) AS term FROM benchmark) GROUP BY item_id, term),
scored AS (SELECT item_id, doc_id, sum(qtf * idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25 + 0.75::DOUBLE * dl / avgdl))) AS score FROM q JOIN p USING (term) JOIN i USING (term), s GROUP BY item_id, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id DESC) - 1 AS rank FROM scored)"""


def _bm25(spark, sf):
    scored = R.bm25(_words(spark, sf, "documents", "doc_id"), _words(spark, sf, "benchmark", "item_id"))
    return R.top(scored, 10, "item_id", F.round("score", 6).desc(), F.desc("doc_id"))


@query("j_bm25", BM25 + " SELECT item_id, doc_id, round(score, 6) AS score FROM ranked WHERE rank < 10")
def j_bm25(spark, sf):
    return _bm25(spark, sf).select("item_id", "doc_id", F.round("score", 6).alias("score"))


@query("t_bm25", BM25 + " SELECT doc_id, CAST(rank AS INT) AS rank, round(score, 6) AS score FROM ranked WHERE rank < 10 AND item_id = 0")
def t_bm25(spark, sf):
    """The ten best documents for the first benchmark text; of equals the larger id."""
    return _bm25(spark, sf).where("item_id = 0").select("doc_id", "rank", F.round("score", 6).alias("score"))


DENSE = """WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 100 = 0),
scored AS (SELECT query_id, vec_id, list_dot_product(e::DOUBLE[], embedding::DOUBLE[]) AS score FROM q, embeddings WHERE vec_id <> query_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, vec_id) - 1 AS rank FROM scored)"""


def _dense(spark, sf):
    vectors = table(spark, sf, "embeddings")
    return R.top(R.nearest(vectors, vectors.where("vec_id % 100 = 0"), 10), 10, "query_id", F.round("score", 6).desc(), "vec_id")


@query("j_dense", DENSE + " SELECT query_id, vec_id, round(score, 6) AS score FROM ranked WHERE rank < 10")
def j_dense(spark, sf):
    return _dense(spark, sf).select("query_id", "vec_id", F.round("score", 6).alias("score"))


@query("t_dense", DENSE + " SELECT query_id, vec_id, CAST(rank AS INT) AS rank FROM ranked WHERE rank < 5")
def t_dense(spark, sf):
    return _dense(spark, sf).where("rank < 5").select("query_id", "vec_id", "rank")


NEAREST = DENSE.replace("list_dot_product(e::DOUBLE[], embedding::DOUBLE[])", "list_distance(e::DOUBLE[], embedding::DOUBLE[])").replace("DESC, vec_id", ", vec_id")


@query("j_nearest_vec", NEAREST + " SELECT query_id, vec_id, round(score, 4) AS distance FROM ranked WHERE rank = 0")
def j_nearest_vec(spark, sf):
    """The vector at the least Euclidean distance from each of the query set."""
    vectors = table(spark, sf, "embeddings")
    near = R.nearest(vectors, vectors.where("vec_id % 100 = 0"), 1, far=True).groupBy("query_id").agg(F.min(F.struct(F.round("score", 6), "vec_id", F.col("score").alias("raw"))).alias("best"))
    return near.select("query_id", "best.vec_id", F.round("best.raw", 4).alias("distance"))


FUSED = BM25 + """, lists AS (SELECT item_id, doc_id, rank FROM ranked WHERE rank < 10
  UNION ALL SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY hits DESC, doc_id) - 1 FROM (SELECT item_id, doc_id, count(*) AS hits FROM q JOIN p USING (term) GROUP BY item_id, doc_id) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY hits DESC, doc_id) <= 10)
SELECT item_id, doc_id, round(sum(1::DOUBLE / (60 + rank + 1)), 6) AS score FROM lists GROUP BY item_id, doc_id"""


def _fused(spark, sf):
    scored = R.scores(_words(spark, sf, "documents", "doc_id"), _words(spark, sf, "benchmark", "item_id"))
    return R.fuse([R.top(scored, 10, "item_id", F.round("score", 6).desc(), F.desc("doc_id")), R.top(scored, 10, "item_id", F.desc("hits"), "doc_id")], "item_id", "doc_id")


@query("j_fuse", FUSED)
def j_fuse(spark, sf):
    """Two rank lists (BM25, number of distinct query words held) fused by id."""
    return _fused(spark, sf).select("item_id", "doc_id", F.round("score", 6).alias("score"))


@query("t_fused", f"SELECT item_id, doc_id FROM ({FUSED}) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 5")
def t_fused(spark, sf):
    return R.top(_fused(spark, sf), 5, "item_id", F.round("score", 6).desc(), "doc_id").select("item_id", "doc_id")


TURNS = "WITH a AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before, role FROM conversations), "


@query("j_support", TURNS + f"""f AS (SELECT conv_id, turn, list_distinct({WORDS}) AS w, regexp_extract_all(lower(coalesce(before, '')), '[a-z]+') AS b FROM a WHERE role = 'assistant')
SELECT conv_id, turn, CASE WHEN len(w) = 0 THEN 1.0::DOUBLE ELSE round(len(list_filter(w, lambda x: list_contains(b, x)))::DOUBLE / len(w), 6) END AS support FROM f""")
def j_support(spark, sf):
    """Share of an answer's words that the turn before it holds; 1 for an answer without words."""
    turn = Window.partitionBy("conv_id").orderBy("turn")
    a = table(spark, sf, "conversations").withColumn("before", F.lag("text").over(turn)).where("role = 'assistant'")
    w = F.array_distinct(T.words(F.col("text")))
    share = F.size(F.array_intersect(w, T.words(F.col("before")))) / F.size(w)
    return a.select("conv_id", "turn", F.when(F.size(w) == 0, 1.0).otherwise(F.round(share, 6)).alias("support"))


@query("j_quote", f"""WITH d AS (SELECT doc_id, concat(' ', array_to_string({WORDS}, ' '), ' ') AS d FROM documents), b AS (SELECT item_id, concat(' ', array_to_string({WORDS}, ' '), ' ') AS q FROM benchmark)
SELECT doc_id, item_id FROM d JOIN b ON contains(d, q) AND length(q) > 2""")
def j_quote(spark, sf):
    """Documents that hold a whole benchmark passage word for word.  A passage's rarest four-word run leads to its documents."""
    docs, bench = _words(spark, sf, "documents", "doc_id"), _words(spark, sf, "benchmark", "item_id")
    runs = L.ngrams(bench, 4, "item_id").groupBy("item_id", "key").agg(F.min("start").alias("start"))
    found = L.ngrams(docs, 4, "doc_id").select("doc_id", "key").join(L.small(runs), "key").distinct()
    counts = found.groupBy("item_id", "key", "start").agg(F.count("*").alias("n"))
    rarest = counts.groupBy("item_id").agg(F.min(F.struct("n", "start", "key"))["key"].alias("key"))
    long = found.join(rarest, ["item_id", "key"]).select("doc_id", "item_id")
    short = bench.where((F.size("words") < 4) & (F.size("words") > 0)).select("item_id")
    pairs = long.union(docs.select("doc_id").join(F.broadcast(short)).select("doc_id", "item_id")) if not short.isEmpty() else long
    joined = lambda c: F.concat(F.lit(" "), F.array_join(c, " "), F.lit(" "))
    both = pairs.join(docs, "doc_id").withColumn("d", joined("words")).drop("words").join(bench, "item_id").withColumn("q", joined("words"))
    return both.where(F.contains("d", "q")).select("doc_id", "item_id")


@query("j_anti_uncovered", f"SELECT word, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest({WORDS}) AS word FROM documents) WHERE word NOT IN (SELECT key FROM ({LEX})) GROUP BY word")
def j_anti_uncovered(spark, sf):
    counts = table(spark, sf, "documents").select(F.explode(T.words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counts.join(_lex(spark, sf).withColumnRenamed("key", "word"), "word", "left_anti")


@query("j_semi_pids", "SELECT source, CAST(count(*) AS BIGINT) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY source")
def j_semi_pids(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left_semi").groupBy("source").agg(F.count("*").alias("n"))


@query("j_distinct_across", "SELECT CAST(count(DISTINCT id) AS BIGINT) AS n FROM (SELECT doc_id AS id FROM documents UNION ALL SELECT doc_id FROM labels UNION ALL SELECT item_id FROM benchmark UNION ALL SELECT page_id FROM pages)")
def j_distinct_across(spark, sf):
    ids = [table(spark, sf, t).select(F.col(c).alias("id")) for t, c in (("documents", "doc_id"), ("labels", "doc_id"), ("benchmark", "item_id"), ("pages", "page_id"))]
    every = ids[0].union(ids[1]).union(ids[2]).union(ids[3]).distinct()
    return every.agg(F.count("*").alias("n"))


@query("j_root_align", f"SELECT item_id, arg_min(word, pos) AS word FROM (SELECT item_id, unnest({WORDS}) AS word, generate_subscripts({WORDS}, 1) AS pos FROM benchmark) WHERE left(word, 2) IN (SELECT left(lower(c_mktsegment), 2) FROM customer) GROUP BY item_id")
def j_root_align(spark, sf):
    """The first word of each text that shares a root (two letters here) with a gold list."""
    roots = table(spark, sf, "customer").select(F.substring(F.lower("c_mktsegment"), 1, 2).alias("root")).distinct()
    each = table(spark, sf, "benchmark").select("item_id", F.posexplode(T.words(F.col("text"))).alias("pos", "word")).withColumn("root", F.substring("word", 1, 2))
    return each.join(roots, "root").groupBy("item_id").agg(F.min_by("word", "pos").alias("word"))


@query("j_alias", "WITH c AS (SELECT md5(text) AS h, min(doc_id) AS first FROM documents GROUP BY md5(text)) SELECT doc_id, first AS canonical FROM documents JOIN c ON md5(text) = h")
def j_alias(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("h"))
    return docs.join(docs.groupBy("h").agg(F.min("doc_id").alias("canonical")), "h").select("doc_id", "canonical")


@query("j_unnest_ayah", "SELECT o_orderkey, CAST(unnest(range(1, 1 + CAST(o_orderkey % 4 AS BIGINT))) AS BIGINT) AS part FROM orders")
def j_unnest_ayah(spark, sf):
    parts = F.when(F.col("o_orderkey") % 4 > 0, F.sequence(F.lit(1).cast("long"), F.col("o_orderkey") % 4))
    return table(spark, sf, "orders").select("o_orderkey", F.explode(parts).alias("part"))


@query("j_grid_left", "SELECT n_name, seg AS segment, CAST(count(c_custkey) AS BIGINT) AS customers FROM nation CROSS JOIN (SELECT DISTINCT c_mktsegment AS seg FROM customer) LEFT JOIN customer ON c_nationkey = n_nationkey AND c_mktsegment = seg GROUP BY n_name, seg")
def j_grid_left(spark, sf):
    customer = table(spark, sf, "customer")
    segments = F.broadcast(customer.select("c_mktsegment").distinct())  # a handful by their meaning
    counts = customer.groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    grid = table(spark, sf, "nation").join(segments)
    joined = grid.join(counts, (F.col("n_nationkey") == F.col("c_nationkey")) & (grid["c_mktsegment"] == counts["c_mktsegment"]), "left")
    return joined.select("n_name", grid["c_mktsegment"].alias("segment"), F.coalesce("n", F.lit(0)).alias("customers"))


@query("j_nearest_key", """SELECT e.event_id, coalesce((SELECT min(p.event_id) FROM events p WHERE p.event_type = 'purchase' AND p.event_id >= e.event_id), (SELECT max(event_id) FROM events WHERE event_type = 'purchase')) AS nearest FROM events e""")
def j_nearest_key(spark, sf):
    """The next purchase at or after each event by id, else the last one: a running minimum from the far end of each range of ids.

    Ranges of ids are worked on side by side; what comes after a range is carried by one row for each range.
    """
    e = table(spark, sf, "events").select("event_id", "event_type")
    low, high = e.agg(F.min("event_id"), F.max("event_id")).first()
    width = max(10_000, ((high or 0) - (low or 0)) // 1000)  # a thousand ranges at most
    e = e.withColumn("range", F.floor(F.col("event_id") / width))
    key = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    after = Window.partitionBy("range").orderBy(F.desc("event_id")).rowsBetween(Window.unboundedPreceding, 0)
    firsts = e.groupBy("range").agg(F.min(key).alias("first"), F.max(key).alias("last"))
    later = Window.orderBy("range").rowsBetween(1, Window.unboundedFollowing)  # a row for each range
    carried = firsts.select("range", F.min("first").over(later).alias("next"), F.max("last").over(Window.partitionBy()).alias("last"))
    return e.withColumn("own", F.min(key).over(after)).join(carried, "range").select("event_id", F.coalesce("own", "next", "last").alias("nearest"))


@query("j_interval_contains", "SELECT s.event_id AS cue, CAST(count(*) AS BIGINT) AS inside FROM events s JOIN events e ON e.user_id = s.user_id AND e.ts >= s.ts AND e.ts < s.ts + INTERVAL 6 HOUR WHERE s.event_type = 'signup' GROUP BY s.event_id")
def j_interval_contains(spark, sf):
    """Events in [start, start + 6 h) of each signup of the same user; both sides are cut into 6 h buckets, so the join is by key."""
    e = table(spark, sf, "events")
    hours = F.floor(F.unix_timestamp("ts") / 21600)
    cues = e.where("event_type = 'signup'").select(F.col("event_id").alias("cue"), F.col("ts").alias("start"), "user_id", F.explode(F.array(hours, hours + 1)).alias("bucket"))
    hit = e.select("user_id", "ts", hours.alias("bucket")).join(cues, ["user_id", "bucket"]).where("ts >= start AND ts < start + INTERVAL 6 HOURS")
    return hit.groupBy("cue").agg(F.count("*").alias("inside"))


@query("j_caption_window", "SELECT a.event_id AS click, CAST(count(b.event_id) AS BIGINT) AS near FROM events a LEFT JOIN events b ON a.user_id = b.user_id AND b.event_type = 'view' AND b.ts BETWEEN a.ts - INTERVAL 30 MINUTE AND a.ts + INTERVAL 60 MINUTE WHERE a.event_type = 'click' GROUP BY a.event_id")
def j_caption_window(spark, sf):
    e = table(spark, sf, "events").withColumn("hour", F.floor(F.unix_timestamp("ts") / 3600))
    views = e.where("event_type = 'view'").select("user_id", F.col("ts").alias("seen"), F.explode(F.array(F.col("hour") - 1, F.col("hour"), F.col("hour") + 1)).alias("hour"))
    clicks = e.where("event_type = 'click'")
    near = clicks.join(views, ["user_id", "hour"]).where("seen BETWEEN ts - INTERVAL 30 MINUTES AND ts + INTERVAL 60 MINUTES").groupBy("event_id").agg(F.count("*").alias("n"))
    return clicks.join(near, "event_id", "left").select(F.col("event_id").alias("click"), F.coalesce("n", F.lit(0)).alias("near"))


@query("j_phrase_window", f"WITH t AS (SELECT doc_id, unnest({WORDS}) AS w, generate_subscripts({WORDS}, 1) AS p FROM documents) SELECT a.doc_id, CAST(count(DISTINCT a.p) AS BIGINT) AS hits FROM t a JOIN t b ON a.doc_id = b.doc_id AND a.w = 'the' AND b.w = 'of' AND abs(a.p - b.p) <= 8 GROUP BY a.doc_id")
def j_phrase_window(spark, sf):
    """Occurrences of one phrase word with the other at most 8 words away: a window over each document's hits, no self-join."""
    hits = table(spark, sf, "documents").select("doc_id", F.posexplode(T.words(F.col("text"))).alias("p", "w")).where("w IN ('the', 'of')")
    near = Window.partitionBy("doc_id").orderBy("p").rangeBetween(-8, 8)
    other = F.max(F.col("w") == "of").over(near)
    return hits.withColumn("near", other).where("w = 'the' AND near").groupBy("doc_id").agg(F.count("*").alias("hits"))


PAIRED = 64


@query("j_twins", """WITH s AS (SELECT o_custkey AS k, CAST(o_orderdate AS DATE) AS m FROM orders UNION SELECT o_custkey + 1000000000, CAST(o_orderdate AS DATE) FROM orders WHERE o_orderkey % 9 <> 0), n AS (SELECT k, count(*) AS n FROM s GROUP BY k), i AS (SELECT a.k AS a, b.k AS b, count(*) AS shared FROM s a JOIN s b ON a.m = b.m AND a.k < b.k GROUP BY a.k, b.k)
SELECT a, b, round(shared::DOUBLE / (x.n + y.n - shared), 6) AS jaccard FROM i JOIN n x ON x.k = a JOIN n y ON y.k = b WHERE 10 * shared >= 7 * (x.n + y.n - shared)""")
def j_twins(spark, sf):
    """Customers whose sets of order days are alike (Jaccard 0.7 or more).  Each customer has a twin that lacks one order in nine.

    Equal sets are compared once and their customers paired at the end.  Different sets of up to ``PAIRED`` days share two of the rarest days of each, so pairs of
    days lead them to each other; of larger ones at least one day does, where sizes and places in the order of all sets leave room for that."""
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.to_date("o_orderdate").alias("m"), "o_orderkey")
    s = orders.select("k", "m").union(orders.where("o_orderkey % 9 <> 0").select(F.col("k") + 1_000_000_000, "m")).where("k IS NOT NULL AND m IS NOT NULL").distinct()
    members = written(s.groupBy("k").agg(F.array_sort(F.collect_set("m")).alias("ms")), "members")
    sets = written(members.groupBy("ms").agg(F.min("k").alias("set")), "sets")
    members = written(members.join(sets, "ms").select("k", "set"), "sets-of-members")
    days = sets.select("set", F.explode("ms").alias("m"))
    rare = days.join(days.groupBy("m").agg(F.count("*").alias("n")), "m").groupBy("set").agg(F.sort_array(F.collect_list(F.struct("n", "m")))["m"].alias("ms"))
    size = F.size("ms")
    least = F.ceil(size * 7 / 10).cast("int")  # any set that is alike shares as many days
    rare = written(rare.withColumn("n", size).withColumn("least", least), "rare")
    begin = lambda more: F.slice("ms", F.lit(1), F.col("n") - F.col("least") + more)
    head = rare.where((F.col("n") >= 2) & (F.col("n") <= PAIRED)).withColumn("head", begin(2))
    pairs = F.flatten(F.transform("head", lambda x, i: F.transform(F.slice("head", i + 2, F.size("head")), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    by_two = head.select("set", "ms", F.explode(pairs).alias("key"))
    large = rare.where(F.col("n") > PAIRED * 7 // 10).select("set", "ms", F.posexplode(begin(1)).alias("i", "key"))

    def alike(keys, *room):
        x, y = (keys.select(F.col("set").alias(k), F.col("ms").alias(m), "key", *((F.size("ms") - F.col("i")).alias(f"room_{k}") for _ in room)) for k, m in (("a", "p"), ("b", "q")))
        n, m = F.size("p"), F.size("q")
        met = x.join(y, "key").where((F.col("a") < F.col("b")) & (10 * n >= 7 * m) & (10 * m >= 7 * n))
        for f in room:
            met = met.where(f(n, m))
        met = met.withColumn("n", F.size(F.array_intersect("p", "q"))).withColumn("all", F.size("p") + F.size("q") - F.col("n"))
        return met.where("10 * n >= 7 * all").select("a", "b", F.round(F.col("n") / F.col("all"), 6).alias("jaccard"))

    both = alike(by_two).union(alike(large, lambda n, m: ((n > PAIRED) | (m > PAIRED)) & (17 * F.least("room_a", "room_b") >= 7 * (n + m)))).distinct()
    both = both.union(sets.select(F.col("set").alias("a"), F.col("set").alias("b"), F.lit(1.0).alias("jaccard")))
    of = lambda k, name: members.select(F.col("set").alias(k), F.col("k").alias(name))
    every = both.join(of("a", "x"), "a").join(of("b", "y"), "b").where("a <> b OR x < y")
    return every.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "jaccard")


@query("j_override", """WITH base AS (SELECT p_partkey, p_brand FROM part), fix AS (SELECT p_partkey, 'fixed' AS p_brand FROM part WHERE p_size > 40), gone AS (SELECT p_partkey FROM part WHERE p_size < 5)
SELECT p_partkey, coalesce(fix.p_brand, base.p_brand) AS p_brand FROM base LEFT JOIN fix USING (p_partkey) WHERE p_partkey NOT IN (SELECT p_partkey FROM gone)
UNION ALL SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey NOT IN (SELECT p_partkey FROM base) AND s_suppkey NOT IN (SELECT p_partkey FROM gone)""")
def j_override(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_brand", "p_size")
    fix = part.where("p_size > 40").select("p_partkey", F.lit("fixed").alias("p_brand"))
    fills = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("p_partkey"), F.col("s_name").alias("p_brand"))
    return L.upsert(part.drop("p_size"), fix, part.where("p_size < 5"), fills, "p_partkey")


@query("j_known_sign", f"WITH c AS (SELECT DISTINCT unnest({WORDS}) AS key FROM conversations), b AS ({LEX}) SELECT word, CASE WHEN word IN (SELECT key FROM b) THEN 'benchmark' WHEN word IN (SELECT key FROM c) THEN 'conversations' END AS source FROM ({VOCAB})")
def j_known_sign(spark, sf):
    routes = L.priority_routes(*[_lex(spark, sf, t).select(F.col("key").alias("word"), F.lit(t).alias("entry")) for t in ("benchmark", "conversations")])
    return _vocab(spark, sf).join(routes, "word", "left").select("word", F.col("entry").alias("source"))


@query("j_caption_clips", "SELECT user_id, CAST(count(*) AS BIGINT) AS clips FROM events JOIN customer ON user_id = c_custkey WHERE value > 10 AND event_type IN ('view', 'click') GROUP BY user_id")
def j_caption_clips(spark, sf):
    e = table(spark, sf, "events").where("value > 10 AND event_type IN ('view', 'click')")
    return e.join(table(spark, sf, "customer"), F.col("user_id") == F.col("c_custkey")).groupBy("user_id").agg(F.count("*").alias("clips"))


@query("j_eval_outputs", "SELECT d.doc_id, coalesce(CAST(l.quality AS VARCHAR), '') AS output FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def j_eval_outputs(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").select("doc_id", F.coalesce(F.col("quality").cast("string"), F.lit("")).alias("output"))
