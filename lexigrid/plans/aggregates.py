"""Aggregations over whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexigrid.functions import text as T
from lexigrid.registry import query, table

WORDS = "regexp_extract_all(lower(text), '[a-z]+')"
TOK = f"SELECT doc_id, lang, source, unnest({WORDS}) AS word FROM documents"
LEX = f"SELECT DISTINCT unnest({WORDS}) AS key FROM benchmark"


def _tokens(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "lang", "source", F.explode(T.words(F.col("text"))).alias("word"))


def _counts(spark, sf, *by):
    """Counts of distinct words first: what follows works on the vocabulary."""
    return _tokens(spark, sf).groupBy(*by, "word").agg(F.count("*").alias("n"))


def _covered(spark, sf, *by):
    lex = table(spark, sf, "benchmark").select(F.explode(T.words(F.col("text"))).alias("word")).distinct().withColumn("hit", F.lit(True))
    return _counts(spark, sf, *by).join(lex, "word", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


@query("a_wordcount", f"SELECT lang, word, CAST(count(*) AS BIGINT) AS n FROM ({TOK}) GROUP BY GROUPING SETS ((lang, word), (word))")
def a_wordcount(spark, sf):
    counts = _counts(spark, sf, "lang")
    return counts.groupingSets([["lang", "word"], ["word"]], "lang", "word").agg(F.sum("n").alias("n")).select("lang", "word", "n")


COV = f"WITH c AS (SELECT lang, word, count(*) AS n FROM ({TOK}) GROUP BY lang, word), h AS (SELECT c.*, word IN (SELECT key FROM ({LEX})) AS hit FROM c) "


@query("a_coverage", COV + "SELECT lang, CAST(count(*) AS BIGINT) AS types, CAST(count(*) FILTER (WHERE hit) AS BIGINT) AS types_covered, CAST(sum(n) AS BIGINT) AS tokens, CAST(coalesce(sum(n) FILTER (WHERE hit), 0) AS BIGINT) AS tokens_covered, round(coalesce(sum(n) FILTER (WHERE hit), 0)::DOUBLE / sum(n), 4) AS ratio FROM h GROUP BY lang")
def a_coverage(spark, sf):
    hit = F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0))
    return _covered(spark, sf, "lang").groupBy("lang").agg(F.count("*").alias("types"), F.count_if("hit").alias("types_covered"), F.sum("n").alias("tokens"), hit.alias("tokens_covered"), F.round(hit / F.sum("n"), 4).alias("ratio"))


@query("a_cov_context", COV + "SELECT word, CAST(least(sum(n), sum(CASE WHEN hit OR length(word) > 8 THEN n ELSE 0 END)) AS BIGINT) AS covered FROM h GROUP BY word")
def a_cov_context(spark, sf):
    covered = F.sum(F.when(F.col("hit") | (F.length("word") > 8), F.col("n")).otherwise(0))
    return _covered(spark, sf, "lang").groupBy("word").agg(F.least(F.sum("n"), covered).alias("covered"))


@query("a_cov_names", COV + "SELECT lang, CAST(sum(CASE WHEN starts_with(word, 'th') THEN n WHEN hit THEN n ELSE 0 END) AS BIGINT) AS covered FROM h GROUP BY lang")
def a_cov_names(spark, sf):
    return _covered(spark, sf, "lang").groupBy("lang").agg(F.sum(F.when(F.col("word").startswith("th") | F.col("hit"), F.col("n")).otherwise(0)).alias("covered"))


@query("a_attrib", f"SELECT source, CAST(count(*) AS BIGINT) AS tokens, CAST(count(DISTINCT word) AS BIGINT) AS types, round(count(*)::DOUBLE / (SELECT count(*) FROM ({TOK})), 6) AS share FROM ({TOK}) GROUP BY source")
def a_attrib(spark, sf):
    s = _counts(spark, sf, "source").groupBy("source").agg(F.sum("n").alias("tokens"), F.count("*").alias("types"))
    return s.withColumn("share", F.round(F.col("tokens") / F.sum("tokens").over(Window.partitionBy()), 6))


@query("a_routes", COV + "SELECT CASE WHEN hit THEN 'exact' WHEN left(word, 5) IN (SELECT left(key, 5) FROM (" + LEX + ") WHERE length(key) >= 5) AND length(word) > 5 THEN 'stem' ELSE 'none' END AS route, CAST(sum(n) AS BIGINT) AS tokens, CAST(count(DISTINCT word) AS BIGINT) AS types FROM h GROUP BY 1")
def a_routes(spark, sf):
    stems = table(spark, sf, "benchmark").select(F.explode(T.words(F.col("text"))).alias("key")).where("length(key) >= 5").select(F.substring("key", 1, 5).alias("stem"), F.lit(True).alias("stemmed")).distinct()
    v = _covered(spark, sf).withColumn("stem", F.substring("word", 1, 5)).join(stems, "stem", "left")
    route = F.when(F.col("hit"), "exact").when(F.col("stemmed") & (F.length("word") > 5), "stem").otherwise("none")
    return v.groupBy(route.alias("route")).agg(F.sum("n").alias("tokens"), F.count("*").alias("types"))


@query("a_df_idf", f"WITH n AS (SELECT count(*) AS n FROM documents) SELECT word, CAST(count(DISTINCT doc_id) AS BIGINT) AS df, round(ln(1 + (any_value(n) - count(DISTINCT doc_id) + 0.5) / (count(DISTINCT doc_id) + 0.5)), 6) AS idf FROM ({TOK}), n GROUP BY word")
def a_df_idf(spark, sf):
    docs = table(spark, sf, "documents")
    df = docs.select(F.explode(F.array_distinct(T.words(F.col("text")))).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    n = F.broadcast(docs.agg(F.count("*").alias("n")))
    return df.crossJoin(n).select("word", "df", F.round(F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), 6).alias("idf"))


@query("a_avgdl", f"SELECT round(avg(len({WORDS})), 6) AS avgdl FROM documents")
def a_avgdl(spark, sf):
    return table(spark, sf, "documents").agg(F.round(F.avg(F.size(T.words(F.col("text")))), 6).alias("avgdl"))


@query("a_bm25", f"""WITH d AS (SELECT doc_id, source, {WORDS} AS w FROM documents), s AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM d), p AS (SELECT doc_id, source, len(w) AS dl, count(*) AS tf FROM (SELECT doc_id, source, w, unnest(w) AS term FROM d) WHERE term = 'the' GROUP BY ALL)
SELECT doc_id, round(CASE WHEN source = 'src0' THEN 1.3::DOUBLE ELSE 1.0 END * ln(1 + (n - (SELECT count(*) FROM p) + 0.5) / ((SELECT count(*) FROM p) + 0.5)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25 + 0.75::DOUBLE * dl / avgdl)), 6) AS score FROM p, s""")
def a_bm25(spark, sf):
    """One term's scores, with a boost for one source."""
    d = table(spark, sf, "documents").select("doc_id", "source", T.words(F.col("text")).alias("w"))
    s = F.broadcast(d.agg(F.count("*").alias("n"), F.avg(F.size("w")).alias("avgdl"), F.count_if(F.array_contains("w", "the")).alias("df")))
    tf = F.size(F.filter("w", lambda x: x == "the"))
    score = F.when(F.col("source") == "src0", 1.3).otherwise(1.0) * F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * F.size("w") / F.col("avgdl")))
    return d.crossJoin(s).where(F.array_contains("w", "the")).select("doc_id", F.round(score, 6).alias("score"))


@query("a_glosscount", "SELECT CAST(count(DISTINCT lower(regexp_replace(p_brand, '[0-9]+$', ''))) AS BIGINT) AS glosses FROM part")
def a_glosscount(spark, sf):
    return table(spark, sf, "part").agg(F.count_distinct(F.lower(F.regexp_replace("p_brand", "[0-9]+$", ""))).alias("glosses"))


ROLL = "CAST(count(*) AS BIGINT) AS samples, CAST(count(DISTINCT o_custkey) AS BIGINT) AS refs, round(sum(greatest(0, o_totalprice)) / 3600, 2) AS hours"


@query("a_hadith_cov", f"SELECT o_orderstatus, o_orderpriority, {ROLL} FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def a_hadith_cov(spark, sf):
    aggs = (F.count("*").alias("samples"), F.count_distinct("o_custkey").alias("refs"), F.round(F.sum(F.greatest(F.lit(0.0), "o_totalprice")) / 3600, 2).alias("hours"))
    return table(spark, sf, "orders").groupingSets([["o_orderstatus"], ["o_orderpriority"], []], "o_orderstatus", "o_orderpriority").agg(*aggs)


@query("a_hadith_cov_cube", "SELECT o_orderstatus, o_orderpriority, CAST(count(*) AS BIGINT) AS samples FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def a_hadith_cov_cube(spark, sf):
    return table(spark, sf, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("samples"))


@query("a_hadith_cov_rollup", "SELECT o_orderstatus, o_orderpriority, CAST(count(*) AS BIGINT) AS samples FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def a_hadith_cov_rollup(spark, sf):
    return table(spark, sf, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("samples"))


@query("a_quran_cov", "SELECT event_type, round(sum(value) / 3600, 2) AS hours FROM events GROUP BY event_type")
def a_quran_cov(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.round(F.sum("value") / 3600, 2).alias("hours"))


@query("a_surah", "SELECT l_suppkey, CAST(count(*) AS BIGINT) AS segments, CAST(count(DISTINCT l_partkey) AS BIGINT) AS parts, CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS BIGINT) AS returned, round(sum(l_quantity), 1) AS seconds FROM lineitem GROUP BY l_suppkey")
def a_surah(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("segments"), F.count_distinct("l_partkey").alias("parts"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.round(F.sum("l_quantity"), 1).alias("seconds"))


@query("a_filter_count", "SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE o_orderstatus = 'P') AS BIGINT) AS pending FROM orders")
def a_filter_count(spark, sf):
    return table(spark, sf, "orders").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "P").alias("pending"))


@query("a_list_item", "SELECT source, CAST(count(*) AS BIGINT) AS n, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs, min(doc_id) AS first FROM documents GROUP BY source")
def a_list_item(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("lang")), ",").alias("langs"), F.min("doc_id").alias("first"))


@query("a_mean_detect", "SELECT event_type, round(avg(len(props)), 6) AS mean FROM events GROUP BY event_type")
def a_mean_detect(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.round(F.avg(F.length("props")), 6).alias("mean"))


DIST = "sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE))))"


@query("a_medoid", f"""WITH e AS (SELECT vec_id, embedding, vec_id // 50 AS g FROM embeddings), d AS (SELECT a.g, a.vec_id, sum({DIST}) AS total FROM e a JOIN e b ON a.g = b.g GROUP BY a.g, a.vec_id)
SELECT g, vec_id AS medoid FROM d QUALIFY row_number() OVER (PARTITION BY g ORDER BY round(total, 6), vec_id) = 1""")
def a_medoid(spark, sf):
    """The member of each group (50 neighbours by id) with the least summed distance to all others; of equals the first."""
    e = table(spark, sf, "embeddings").select("vec_id", "embedding", F.floor(F.col("vec_id") / 50).alias("g"))
    square = lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))
    pairs = e.join(e.select("g", F.col("embedding").alias("other")), "g")
    total = pairs.groupBy("g", "vec_id").agg(F.sum(F.sqrt(F.aggregate(F.zip_with("embedding", "other", square), F.lit(0.0), lambda s, x: s + x))).alias("total"))
    return total.groupBy("g").agg(F.min(F.struct(F.round("total", 6).alias("t"), "vec_id"))["vec_id"].alias("medoid"))


@query("a_majority", "SELECT user_id, event_type AS majority FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS rn FROM events GROUP BY user_id, event_type) WHERE rn = 1")
def a_majority(spark, sf):
    n = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return n.groupBy("user_id").agg(F.min(F.struct((-F.col("n")).alias("k"), "event_type"))["event_type"].alias("majority"))


@query("a_median_q", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.9), 6) AS p90 FROM events WHERE NOT isnan(value) GROUP BY event_type")
def a_median_q(spark, sf):
    return table(spark, sf, "events").where(~F.isnan("value")).groupBy("event_type").agg(F.round(F.percentile("value", 0.5), 6).alias("median"), F.round(F.percentile("value", 0.9), 6).alias("p90"))


@query("a_micro_prf", "WITH c AS (SELECT sum(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END)::DOUBLE AS tp, sum(CASE WHEN quality = 1 AND toxic = 1 THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN quality = 0 AND toxic = 0 THEN 1 ELSE 0 END) AS fn FROM labels) SELECT round(tp / (tp + fp), 6) AS p, round(tp / (tp + fn), 6) AS r, round(2 * tp / (2 * tp + fp + fn), 6) AS f FROM c")
def a_micro_prf(spark, sf):
    """Precision, recall and F1 of the prediction quality = 1 for not toxic."""
    n = lambda q, t: F.count_if((F.col("quality") == q) & (F.col("toxic") == t))
    c = table(spark, sf, "labels").agg(n(1, 0).alias("tp"), n(1, 1).alias("fp"), n(0, 0).alias("fn"))
    return c.selectExpr("round(tp / (tp + fp), 6) AS p", "round(tp / (tp + fn), 6) AS r", "round(2 * tp / (2 * tp + fp + fn), 6) AS f")


@query("a_bootstrap")
def a_bootstrap(spark, sf):
    """95 % interval of the mean quality over 1000 resamples: each row's weight in a resample is a Poisson(1) draw from a hash."""
    draws = F.transform(F.sequence(F.lit(0), F.lit(999)), lambda k: F.pmod(F.xxhash64("doc_id", k), F.lit(1_000_000)) / 1_000_000)
    weight = lambda u: sum((F.when(u > p, 1).otherwise(0) for p in (0.735759, 0.919699, 0.981012, 0.99634)), F.when(u > 0.367879, 1).otherwise(0))
    rows = table(spark, sf, "labels").select("quality", F.posexplode(draws).alias("k", "u")).withColumn("w", weight(F.col("u")))
    means = rows.groupBy("k").agg((F.sum(F.col("quality") * F.col("w")) / F.sum("w")).alias("mean"))
    return means.agg(F.round(F.percentile("mean", 0.025), 6).alias("low"), F.round(F.percentile("mean", 0.975), 6).alias("high"))


RANKED = "WITH s AS (SELECT label, vec_id, embedding[1] AS score, row_number() OVER (ORDER BY embedding[1] DESC, vec_id) AS rk FROM embeddings), "


@query("a_mean_ap", RANKED + "h AS (SELECT label, rk, row_number() OVER (PARTITION BY label ORDER BY rk) AS hits FROM s) SELECT label, round(avg(hits::DOUBLE / rk), 6) AS ap FROM h GROUP BY label")
def a_mean_ap(spark, sf):
    """Average precision of each label when all vectors are ranked by their first component.

    The global rank comes from counts by sorted range: rows are numbered in their range and shifted by the ranges before.
    """
    e = table(spark, sf, "embeddings").select("label", "vec_id", F.element_at("embedding", 1).alias("score"))
    e = e.withColumn("range", F.floor(-F.col("score") * 64))
    sizes = e.groupBy("range").agg(F.count("*").alias("n"))
    before = sizes.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("range").orderBy(F.desc("score"), "vec_id"))
    ranked = e.withColumn("own", rank).join(before, "range").withColumn("rk", F.col("before") + F.col("own"))
    hits = F.row_number().over(Window.partitionBy("label").orderBy("rk"))
    return ranked.withColumn("hits", hits).groupBy("label").agg(F.round(F.avg(F.col("hits") / F.col("rk")), 6).alias("ap"))


@query("a_chance", "SELECT label, round(count(*)::DOUBLE / (SELECT count(*) FROM embeddings), 6) AS chance FROM embeddings GROUP BY label")
def a_chance(spark, sf):
    n = table(spark, sf, "embeddings").groupBy("label").agg(F.count("*").alias("n"))
    return n.select("label", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("chance"))


@query("a_rank_topk", "SELECT CAST(sum(CASE WHEN turn <= 1 THEN 1 ELSE 0 END) AS BIGINT) AS top1, CAST(sum(CASE WHEN turn <= 3 THEN 1 ELSE 0 END) AS BIGINT) AS top3, median(turn) AS median_rank FROM conversations WHERE role = 'assistant'")
def a_rank_topk(spark, sf):
    return table(spark, sf, "conversations").where("role = 'assistant'").agg(F.count_if(F.col("turn") <= 1).alias("top1"), F.count_if(F.col("turn") <= 3).alias("top3"), F.percentile("turn", 0.5).alias("median_rank"))


@query("a_spearman", "WITH r AS (SELECT rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) AS a, rank() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS b, c_nationkey FROM customer) SELECT c_nationkey, round(corr(a, b), 6) AS rho FROM r GROUP BY c_nationkey HAVING count(*) > 2")
def a_spearman(spark, sf):
    rank = lambda c: F.rank().over(Window.partitionBy("c_nationkey").orderBy(c))
    r = table(spark, sf, "customer").select("c_nationkey", rank("c_acctbal").alias("a"), rank("c_custkey").alias("b"))
    return r.groupBy("c_nationkey").agg(F.round(F.corr("a", "b"), 6).alias("rho"), F.count("*").alias("n")).where("n > 2").drop("n")


@query("a_lag_select", "WITH k AS (SELECT unnest([1, 2, 3]) AS k), m AS (SELECT k, round(avg(d), 6) AS mean FROM (SELECT k, abs(value - CASE k WHEN 1 THEN l1 WHEN 2 THEN l2 ELSE l3 END) AS d FROM k, (SELECT value, lag(value, 1) OVER w AS l1, lag(value, 2) OVER w AS l2, lag(value, 3) OVER w AS l3 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))) GROUP BY k) SELECT k, mean, k = (SELECT arg_min(k, (mean, k)) FROM m) AS picked FROM m")
def a_lag_select(spark, sf):
    """Mean difference at each lag, and which lag has the least."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    lags = F.array(*[F.struct(F.lit(k).alias("k"), F.abs(F.col("value") - F.lag("value", k).over(w)).alias("d")) for k in (1, 2, 3)])
    means = table(spark, sf, "events").select(lags.alias("lags")).select(F.explode("lags").alias("x")).groupBy("x.k").agg(F.round(F.avg("x.d"), 6).alias("mean"))
    best = F.min(F.struct("mean", "k")).over(Window.partitionBy())  # a row for each lag
    return means.select("k", "mean", (F.col("k") == best["k"]).alias("picked"))


_PLAN = "CASE event_type WHEN 'purchase' THEN 20 WHEN 'error' THEN n + 15 ELSE 10 END"


@query("a_sample_strat", f"""WITH c AS (SELECT event_type, n, least(n, {_PLAN}) AS own, greatest(0, {_PLAN} - n) AS short FROM (SELECT event_type, count(*) AS n FROM events GROUP BY event_type)),
p AS (SELECT event_type, own + greatest(0, least(n - own, sum(short) OVER () - coalesce(sum(n - own) OVER (ORDER BY event_type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS take FROM c)
SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY md5(CAST(event_id AS VARCHAR)), event_id) AS rn FROM events) JOIN p USING (event_type) WHERE rn <= take""")
def a_sample_strat(spark, sf):
    """A planned number of each stratum, picked by a hash; what a stratum lacks is taken from the others in order of name.  Errors
    are planned to lack fifteen."""
    events = table(spark, sf, "events")
    counts = events.groupBy("event_type").agg(F.count("*").alias("n")).withColumn("plan", F.expr(_PLAN))
    own, every = F.least("n", "plan"), Window.partitionBy()  # a row for each stratum
    before = F.coalesce(F.sum("left").over(Window.orderBy("event_type").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    dealt = counts.withColumns({"left": F.col("n") - own, "short": F.sum(F.greatest(F.lit(0), F.col("plan") - F.col("n"))).over(every)})
    takes = dealt.select("event_type", (own + F.greatest(F.lit(0), F.least(F.col("left"), F.col("short") - before))).alias("take"))
    rn = F.row_number().over(Window.partitionBy("event_type").orderBy(F.md5(F.col("event_id").cast("string")), "event_id"))
    return events.withColumn("rn", rn).join(takes, "event_type").where("rn <= take").select("event_type", "event_id")


@query("a_cap_ratio", "SELECT lower(w) AS word, round(avg(CASE WHEN regexp_matches(w, '^[A-Z]') THEN 1.0::DOUBLE ELSE 0 END), 6) AS ratio FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM documents) GROUP BY 1")
def a_cap_ratio(spark, sf):
    w = table(spark, sf, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("w"))
    return w.groupBy(F.lower("w").alias("word")).agg(F.round(F.avg(F.when(F.col("w").rlike("^[A-Z]"), 1.0).otherwise(0.0)), 6).alias("ratio"))


@query("a_concept", "SELECT l_returnflag, round(sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END), 2) AS open, round(sum(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END), 2) AS closed FROM lineitem GROUP BY l_returnflag")
def a_concept(spark, sf):
    part = lambda s: F.round(F.sum(F.when(F.col("l_linestatus") == s, F.col("l_quantity")).otherwise(0)), 2)
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(part("O").alias("open"), part("F").alias("closed"))


@query("a_inverted", "SELECT c_mktsegment, c_nationkey, string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY c_custkey) AS customers FROM customer GROUP BY ALL")
def a_inverted(spark, sf):
    ids = F.transform(F.sort_array(F.collect_list("c_custkey")), lambda x: x.cast("string"))
    return table(spark, sf, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.array_join(ids, ",").alias("customers"))


@query("a_lexicon_group", f"SELECT left(word, 4) AS lemma, CAST(sum(n) AS BIGINT) AS total, CAST(count(*) AS BIGINT) AS forms, arg_max(word, n * 1000000 - length(word)) AS example FROM (SELECT word, count(*) AS n FROM ({TOK}) GROUP BY word) GROUP BY 1 HAVING count(*) = 1")
def a_lexicon_group(spark, sf):
    c = _counts(spark, sf).groupBy(F.substring("word", 1, 4).alias("lemma"))
    return c.agg(F.sum("n").alias("total"), F.count("*").alias("forms"), F.max_by("word", F.col("n") * 1_000_000 - F.length("word")).alias("example")).where("forms = 1")


@query("a_eda_sources", "WITH u AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) SELECT CAST(n AS BIGINT) AS events, CAST(count(*) AS BIGINT) AS users FROM u GROUP BY n")
def a_eda_sources(spark, sf):
    n = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("events"))
    return n.groupBy("events").agg(F.count("*").alias("users"))


@query("a_pos_hist", "SELECT CASE WHEN l_linenumber = 1 THEN 'first' WHEN l_linenumber >= 5 THEN '#5+' ELSE concat('#', l_linenumber) END AS bucket, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY 1")
def a_pos_hist(spark, sf):
    n = F.col("l_linenumber")
    bucket = F.when(n == 1, "first").when(n >= 5, "#5+").otherwise(F.concat(F.lit("#"), n.cast("string")))
    return table(spark, sf, "lineitem").groupBy(bucket.alias("bucket")).agg(F.round(F.avg("l_quantity"), 6).alias("mean"))


@query("a_qa_flags", "SELECT flag, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(list_filter([CASE WHEN l_discount > 0.05 THEN 'discount' END, CASE WHEN l_tax > 0.05 THEN 'tax' END, CASE WHEN l_quantity > 40 THEN 'bulk' END], lambda x: x IS NOT NULL)) AS flag FROM lineitem) GROUP BY flag")
def a_qa_flags(spark, sf):
    flags = F.array_compact(F.array(F.when(F.col("l_discount") > 0.05, "discount"), F.when(F.col("l_tax") > 0.05, "tax"), F.when(F.col("l_quantity") > 40, "bulk")))
    return table(spark, sf, "lineitem").select(F.explode(flags).alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


@query("a_avg_backtr", "SELECT event_type, round(avg(value), 6) AS mean, round(stddev_samp(value), 4) AS sd FROM events GROUP BY event_type")
def a_avg_backtr(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev("value"), 4).alias("sd"))
