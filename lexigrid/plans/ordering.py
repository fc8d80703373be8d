"""Orders, pages and multiset operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexigrid.functions import text as T
from lexigrid.registry import query, table

WORDS = "regexp_extract_all(lower(text), '[a-z]+')"
TOK = f"SELECT lang, unnest({WORDS}) AS word FROM documents"
BEST = "SELECT *, first_value(c_custkey) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS best FROM customer"


def _words(spark, sf, name, *by):
    return table(spark, sf, name).select(*by, F.explode(T.words(F.col("text"))).alias("word"))


def _placed(rows, ranges, *order):
    """Every row with its place in the whole order, from 1: rows are numbered in their range and shifted by the ranges before.

    ``ranges`` rise with the order and hold few rows each; only their counts meet in one task.
    """
    rows = rows.withColumn("range", F.struct(*[c.alias(f"r{i}") for i, c in enumerate(ranges)]))
    sizes = rows.groupBy("range").agg(F.count("*").alias("size"))
    before = sizes.select("range", F.coalesce(F.sum("size").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    return rows.withColumn("own", own).join(before, "range").withColumn("place", F.col("before") + F.col("own"))


@query("t_best_first", f"SELECT c_custkey, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY CASE WHEN c_custkey = best THEN 0 ELSE 1 END, c_custkey) AS INT) AS place FROM ({BEST})")
def t_best_first(spark, sf):
    """Each group's best row moves to the front, the others keep their order."""
    c = table(spark, sf, "customer")
    best = c.groupBy("c_mktsegment").agg(F.max_by(F.col("c_custkey"), F.struct("c_acctbal", -F.col("c_custkey"))).alias("best"))
    w = Window.partitionBy("c_mktsegment").orderBy(F.when(F.col("c_custkey") == F.col("best"), 0).otherwise(1), "c_custkey")
    return c.join(best, "c_mktsegment").select("c_custkey", F.row_number().over(w).alias("place"))


@query("t_common", f"WITH c AS (SELECT lang, word, count(*) AS n FROM ({TOK}) GROUP BY lang, word) SELECT lang, word, CAST(n AS BIGINT) AS n FROM c QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) <= 20")
def t_common(spark, sf):
    counts = _words(spark, sf, "documents", "lang").groupBy("lang", "word").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    return counts.withColumn("rank", rank).where("rank <= 20").drop("rank")


@query("t_case_order", "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderkey LIMIT 50 OFFSET 10")
def t_case_order(spark, sf):
    order = F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return table(spark, sf, "orders").orderBy(order, "o_orderkey").offset(10).limit(50).select("o_orderkey", "o_orderstatus")


@query("t_collection", "SELECT p_partkey, p_brand FROM part ORDER BY CASE WHEN p_brand = 'Brand#3' THEN 0 ELSE 1 END, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS BIGINT), p_partkey LIMIT 100")
def t_collection(spark, sf):
    number = F.regexp_extract("p_brand", "([0-9]+)", 1).cast("long")
    return table(spark, sf, "part").orderBy(F.when(F.col("p_brand") == "Brand#3", 0).otherwise(1), number, "p_partkey").limit(100).select("p_partkey", "p_brand")


@query("t_collection_all", "SELECT p_partkey, p_brand, row_number() OVER (ORDER BY CASE WHEN p_brand = 'Brand#3' THEN 0 ELSE 1 END, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS BIGINT), p_partkey) AS place FROM part")
def t_collection_all(spark, sf):
    """Every part with its place in the order of ``t_collection``."""
    other, number = F.when(F.col("p_brand") == "Brand#3", 0).otherwise(1), F.regexp_extract("p_brand", "([0-9]+)", 1).cast("long")
    return _placed(table(spark, sf, "part"), [other, number, F.floor(F.col("p_partkey") / 4096)], "p_partkey").select("p_partkey", "p_brand", "place")


@query("t_sample_order", "SELECT doc_id, source FROM documents ORDER BY CASE WHEN lang = 'fr' THEN 0 ELSE 1 END, source NULLS FIRST, doc_id LIMIT 100")
def t_sample_order(spark, sf):
    return table(spark, sf, "documents").orderBy(F.when(F.col("lang") == "fr", 0).otherwise(1), "source", "doc_id").limit(100).select("doc_id", "source")


@query("t_sample_order_all", "SELECT doc_id, source, row_number() OVER (ORDER BY CASE WHEN lang = 'fr' THEN 0 ELSE 1 END, source NULLS FIRST, doc_id) AS place FROM documents")
def t_sample_order_all(spark, sf):
    """Every document with its place in the order of ``t_sample_order``."""
    other = F.when(F.col("lang") == "fr", 0).otherwise(1)
    ranges = [other, F.col("source").isNotNull(), F.coalesce("source", F.lit("")), F.floor(F.col("doc_id") / 4096)]
    return _placed(table(spark, sf, "documents").select("doc_id", "source", "lang"), ranges, "doc_id").select("doc_id", "source", "place")


@query("t_type_order", "SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'signup' THEN 0 WHEN 'purchase' THEN 1 ELSE 2 END, event_id) AS INT) AS place FROM events")
def t_type_order(spark, sf):
    kind = F.when(F.col("event_type") == "signup", 0).when(F.col("event_type") == "purchase", 1).otherwise(2)
    return table(spark, sf, "events").select("event_id", F.row_number().over(Window.partitionBy("user_id").orderBy(kind, "event_id")).alias("place"))


@query("t_gloss_len", f"SELECT item_id, CAST(len({WORDS}) AS INT) AS n FROM benchmark ORDER BY n DESC, length(text) DESC, item_id LIMIT 20")
def t_gloss_len(spark, sf):
    b = table(spark, sf, "benchmark").withColumn("n", F.size(T.words(F.col("text"))))
    return b.orderBy(F.desc("n"), F.desc(F.length("text")), "item_id").limit(20).select("item_id", "n")


@query("t_gloss_len_all", f"SELECT item_id, CAST(len({WORDS}) AS INT) AS n, row_number() OVER (ORDER BY len({WORDS}) DESC, length(text) DESC, item_id) AS place FROM benchmark")
def t_gloss_len_all(spark, sf):
    """Every benchmark text with its place in the order of ``t_gloss_len``."""
    b = table(spark, sf, "benchmark").select("item_id", F.size(T.words(F.col("text"))).alias("n"), F.length("text").alias("chars"))
    return _placed(b, [-F.col("n"), -F.col("chars"), F.floor(F.col("item_id") / 4096)], "item_id").select("item_id", "n", "place")


@query("t_priority", f"SELECT word, CAST(count(*) AS BIGINT) AS n FROM ({TOK}) GROUP BY word ORDER BY n DESC, word LIMIT 100")
def t_priority(spark, sf):
    return _words(spark, sf, "documents").groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(100)


@query("t_priority_all", f"SELECT word, CAST(count(*) AS BIGINT) AS n, row_number() OVER (ORDER BY count(*) DESC, word) AS place FROM ({TOK}) GROUP BY word")
def t_priority_all(spark, sf):
    """Every word with its place in the order of ``t_priority``."""
    counts = _words(spark, sf, "documents").groupBy("word").agg(F.count("*").alias("n"))
    return _placed(counts, [-F.col("n"), F.substring("word", 1, 3)], "word").select("word", "n", "place")


@query("t_len_batch", "SELECT doc_id, CAST(floor((row_number() OVER (PARTITION BY lang, source ORDER BY n_chars, doc_id) - 1) / 32) AS BIGINT) AS batch FROM documents")
def t_len_batch(spark, sf):
    """Batches of 32 documents of like length within each language and source."""
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy("n_chars", "doc_id"))
    return table(spark, sf, "documents").select("doc_id", F.floor((rank - 1) / 32).alias("batch"))


@query("t_page", "SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) BETWEEN 11 AND 20")
def t_page(spark, sf):
    rank = F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("ts"), "event_id"))
    return table(spark, sf, "events").withColumn("rank", rank).where("rank BETWEEN 11 AND 20").select("event_type", "event_id")


@query("u_union_all", "SELECT doc_id AS id, text, 0 AS origin FROM documents UNION ALL SELECT item_id, text, 1 FROM benchmark")
def u_union_all(spark, sf):
    d, b = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    return d.select(F.col("doc_id").alias("id"), "text", F.lit(0).alias("origin")).union(b.select("item_id", "text", F.lit(1)))


BAGS = f"d AS (SELECT word, count(*) AS n FROM ({TOK}) GROUP BY word), b AS (SELECT word, count(*) AS m FROM (SELECT unnest({WORDS}) AS word FROM benchmark) GROUP BY word)"


def _bags(spark, sf):
    return (_words(spark, sf, t).groupBy("word").agg(F.count("*").alias(n)) for t, n in (("documents", "n"), ("benchmark", "m")))


@query("u_counter_add", f"WITH {BAGS} SELECT word, CAST(coalesce(n, 0) + coalesce(m, 0) AS BIGINT) AS n FROM d FULL JOIN b USING (word)")
def u_counter_add(spark, sf):
    d, b = _bags(spark, sf)
    return d.union(b).groupBy("word").agg(F.sum("n").alias("n"))


@query("u_bag_intersect", f"WITH {BAGS} SELECT word, CAST(least(n, m) AS BIGINT) AS n FROM d JOIN b USING (word)")
def u_bag_intersect(spark, sf):
    d, b = _bags(spark, sf)
    return d.join(b, "word").select("word", F.least("n", "m").alias("n"))


@query("u_set_diff", f"WITH {BAGS} SELECT word FROM d WHERE word NOT IN (SELECT word FROM b)")
def u_set_diff(spark, sf):
    d, b = _bags(spark, sf)
    return d.join(b, "word", "left_anti").select("word")


@query("u_dedupe_order", f"SELECT item_id, array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda i: list_position(w, w[i]) = i), lambda i: w[i]), ' ') AS kept FROM (SELECT item_id, {WORDS} AS w FROM benchmark)")
def u_dedupe_order(spark, sf):
    """Repeated words go, the first of each stays in place."""
    return table(spark, sf, "benchmark").select("item_id", F.array_join(F.array_distinct(T.words(F.col("text"))), " ").alias("kept"))


@query("u_overlap", f"SELECT item_id, list_has_any(w, ['the', 'and']) AS any_of, list_has_all(w, ['the', 'and']) AS all_of FROM (SELECT item_id, {WORDS} AS w FROM benchmark)")
def u_overlap(spark, sf):
    w, asked = T.words(F.col("text")), F.array(F.lit("the"), F.lit("and"))
    return table(spark, sf, "benchmark").select("item_id", F.arrays_overlap(w, asked).alias("any_of"), (F.size(F.array_except(asked, w)) == 0).alias("all_of"))
