"""Choosing sources, grouping runs, accepting words against chance."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexigrid.functions import text as T
from lexigrid.operators import cover as C
from lexigrid.operators import linkage as K
from lexigrid.operators import series as S
from lexigrid.operators import support as P
from lexigrid.plans.windows import _numbered
from lexigrid.registry import query, table
from lexigrid.sources.files import written

WORDS = "regexp_extract_all(lower(text), '[a-z]+')"


@query("j_gap_cover", f"""WITH RECURSIVE h AS (SELECT DISTINCT doc_id AS source, n_chars AS p, unnest({WORDS}) AS word FROM documents),
g AS (SELECT word, count(*) AS n FROM (SELECT unnest({WORDS}) AS word FROM documents) WHERE word NOT IN (SELECT unnest({WORDS}) FROM benchmark) GROUP BY word),
k AS (SELECT word, n, row_number() OVER (ORDER BY n DESC, word) AS rank FROM g),
b AS (SELECT word, n, rank, source, row_number() OVER (PARTITION BY word ORDER BY p, source) AS choice FROM k JOIN h USING (word)),
hold AS (SELECT source, word FROM h WHERE source IN (SELECT source FROM b WHERE choice = 1) AND word IN (SELECT word FROM k)),
r AS (SELECT word, rank, source, 'open' AS state FROM b WHERE choice = 1
  UNION ALL
  (WITH o AS (SELECT * FROM r WHERE state = 'open'), w AS (SELECT source, min(rank) AS first FROM o GROUP BY source),
   l AS (SELECT hold.word, min(first) AS least FROM hold JOIN w USING (source) GROUP BY hold.word), t AS (SELECT o.* FROM o JOIN l USING (word) WHERE least = rank),
   c AS (SELECT DISTINCT hold.word FROM hold JOIN t USING (source) JOIN o ON o.word = hold.word WHERE t.rank < o.rank)
   SELECT word, rank, source, CASE WHEN word IN (SELECT word FROM t) THEN 'taken' WHEN word IN (SELECT word FROM c) THEN 'covered' ELSE 'open' END FROM o)),
taken AS (SELECT word, rank, source FROM r WHERE state = 'taken'),
once AS (SELECT b.*, row_number() OVER (PARTITION BY b.source ORDER BY b.rank, choice) AS turn FROM b JOIN taken USING (word) WHERE choice <= 2),
cov AS (SELECT source, count(*) AS covers, sum(n) AS covers_count FROM (SELECT hold.word, arg_min(taken.source, taken.rank) AS source FROM hold JOIN taken USING (source) GROUP BY hold.word) JOIN k USING (word) GROUP BY source)
SELECT source, word AS gap_word, n AS gap_count, choice::INTEGER AS choice, coalesce(covers, 0) AS covers, coalesce(covers_count, 0)::BIGINT AS covers_count FROM once LEFT JOIN cov USING (source) WHERE turn = 1""")
def j_gap_cover(spark, sf):
    """Words that the benchmark doesn't hold, and documents chosen for them: the shortest that holds a word first."""
    known = table(spark, sf, "benchmark").select(F.explode(T.words(F.col("text"))).alias("word")).distinct()
    each = lambda words: table(spark, sf, "documents").select(F.col("doc_id").alias("source"), "n_chars", F.explode(words).alias("word")).join(F.broadcast(known), "word", "left_anti")
    words = T.words(F.col("text"))
    gaps = written(each(words).groupBy("word").agg(F.count("*").alias("n")), "gaps")
    return C.gap_cover(gaps, each(F.array_distinct(words)), [F.col("n_chars")])


def value_runs(spark, sf):
    """Each user's runs of values above 20: (item, id, mean, length); id is the first row's place."""
    n = _numbered(spark, sf).select(F.col("user_id").alias("item"), "f", "value")
    return S.runs(n, F.col("value") > 20, "item", "f").groupBy("item", "run").agg(F.min("f").cast("long").alias("id"), F.round(F.avg("value"), 3).alias("mean"), F.count("*").alias("length")).drop("run")


@query("v_cluster")
def v_cluster(spark, sf):
    """Each user's runs of values above 20, grouped by mean and length."""
    nodes = value_runs(spark, sf)
    apart = F.abs(F.col("a.mean") - F.col("b.mean")) + F.abs(F.col("a.length") - F.col("b.length"))
    return K.complete_linkage(nodes.select("item", "id"), K.near_pairs(nodes, apart, "mean", 6.0), hard=6.0, ratio=2.0, base=1.0)


_VEC = "SELECT label AS word, vec_id % 13 AS grp, vec_id // 2 AS win, vec_id AS seg, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL"
_D = "sqrt(list_sum(list_transform(list_zip({a}, {b}), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) / len({a}))"


def _best_sql(src: str, neg: str) -> str:
    """``src`` (key, grp, win, seg, vec) and ``neg`` (key, win, vec) as a query of each key's best segment."""
    return f"""SELECT key, arg_max(seg, (support - 0.01 * rel, -seg)) AS seg, arg_max(support, (support - 0.01 * rel, -seg)) AS support, arg_max(tau, (support - 0.01 * rel, -seg)) AS tau,
  arg_max(rel, (support - 0.01 * rel, -seg)) AS rel, any_value(n_groups) AS n_groups, any_value(n_windows) AS n_windows FROM (
  SELECT x.key, x.seg, x.tau, x.pos_median / greatest(x.neg_median, 1e-6) AS rel, x.hits::DOUBLE / greatest(1, c.n_groups - CASE WHEN a.in_group = 1 THEN 1 ELSE 0 END) AS support, c.n_groups, c.n_windows
  FROM (SELECT key, seg, any_value(grp) AS grp, tau, neg_median, count(DISTINCT CASE WHEN d <= tau THEN grp2 END) AS hits, quantile_cont(d, 0.5) AS pos_median
    FROM (SELECT a.key, a.seg, a.grp, b.grp AS grp2, b.win AS win2, min({_D.format(a='a.vec', b='b.vec')}) AS d FROM {src} a JOIN {src} b ON a.key = b.key AND a.win <> b.win GROUP BY ALL)
    JOIN (SELECT key, seg, quantile_cont(d, 0.1) AS tau, quantile_cont(d, 0.5) AS neg_median FROM (SELECT a.key, a.seg, b.win AS win2, min({_D.format(a='a.vec', b='b.vec')}) AS d FROM {src} a JOIN {neg} b ON a.key = b.key GROUP BY ALL) GROUP BY key, seg) USING (key, seg)
    GROUP BY key, seg, tau, neg_median) x
  JOIN (SELECT key, count(DISTINCT grp) AS n_groups, count(DISTINCT win) AS n_windows FROM {src} GROUP BY key) c USING (key)
  JOIN (SELECT key, grp, count(DISTINCT win) AS in_group FROM {src} GROUP BY key, grp) a ON a.key = x.key AND a.grp = x.grp) GROUP BY key"""


def _neg_sql(src: str) -> str:
    return f"""SELECT t.key, p.win, p.vec FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY md5(concat_ws('|', 'negative', key, win)), win) AS turn FROM (
    SELECT *, sum(1 - same) OVER (PARTITION BY key) AS clear FROM (
      SELECT k.key, w.win, CASE WHEN EXISTS (SELECT 1 FROM {src} s WHERE s.key = k.key AND s.word = w.word) THEN 1 ELSE 0 END AS same FROM (SELECT DISTINCT key FROM {src}) k, (SELECT DISTINCT win, word FROM pool) w
      WHERE NOT EXISTS (SELECT 1 FROM {src} s WHERE s.key = k.key AND s.win = w.win))) WHERE same = 0 OR clear < 20) t JOIN pool p USING (win) WHERE turn <= 60"""


@query("a_support_null", f"""WITH s AS ({_VEC}), enough AS (SELECT word FROM s GROUP BY word HAVING count(DISTINCT win) >= 5 AND count(DISTINCT grp) >= 3),
w AS (SELECT word, win FROM (SELECT word, win, row_number() OVER (PARTITION BY word ORDER BY md5(concat_ws('|', 'own', word, win)), win) AS turn FROM (SELECT DISTINCT word, win FROM s JOIN enough USING (word))) WHERE turn <= 60),
keyed AS MATERIALIZED (SELECT s.*, word::VARCHAR AS key FROM s JOIN w USING (word, win)),
pool AS MATERIALIZED (SELECT * FROM s WHERE win IN (SELECT win FROM (SELECT DISTINCT win FROM s) ORDER BY md5(concat_ws('|', 'pool', win)), win LIMIT 600)),
neg AS MATERIALIZED ({_neg_sql('keyed')}), got AS MATERIALIZED ({_best_sql('keyed', 'neg')}),
sized AS (SELECT *, list_min(list_filter([2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 16, 24, 32, 60], lambda z: z >= least(n_groups, 60))) AS size FROM got),
grps AS (SELECT grp FROM (SELECT DISTINCT grp FROM s) ORDER BY md5(concat_ws('|', 'group', grp)), grp LIMIT 600),
som AS (SELECT grp, win FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY md5(concat_ws('|', 'window', win)), win) AS turn FROM (SELECT DISTINCT grp, win FROM s JOIN grps USING (grp))) WHERE turn <= 8),
picked AS (SELECT size, trial, grp FROM (SELECT size, trial, grp, row_number() OVER (PARTITION BY size, trial ORDER BY md5(concat_ws('|', size, trial, grp)), grp) AS turn FROM (SELECT DISTINCT size FROM sized), (SELECT unnest(range(30)) AS trial), grps) WHERE turn <= size),
one AS (SELECT size, trial, grp, arg_min(win, (md5(concat_ws('|', size, trial, win)), win)) AS win FROM picked JOIN som USING (grp) GROUP BY ALL),
pseudo AS MATERIALIZED (SELECT one.*, s.word, s.seg, s.vec, concat_ws('|', 'pseudo', size, trial) AS key FROM one JOIN s USING (win)),
neg2 AS MATERIALIZED ({_neg_sql('pseudo')}), chance AS ({_best_sql('pseudo', 'neg2')}),
nul AS (SELECT size, quantile_cont(support, 0.95) AS null95 FROM chance JOIN (SELECT DISTINCT key, size FROM pseudo) USING (key) GROUP BY size)
SELECT key, seg, support, round(tau, 9) AS tau, round(rel, 9) AS rel, n_groups, n_windows, null95, coalesce(support >= 0.6 AND support > null95, false) AS accepted FROM sized LEFT JOIN nul USING (size)""")
def a_support_null(spark, sf):
    """Labels as words, two vectors in turn as a window, windows dealt to 13 groups."""
    v = table(spark, sf, "embeddings")
    segments = v.select(F.col("label").alias("word"), (F.col("vec_id") % 13).alias("grp"), F.expr("vec_id div 2").alias("win"), F.col("vec_id").alias("seg"), F.col("embedding").cast("array<double>").alias("vec"))
    got = P.supported_words(segments)
    return got.select("key", "seg", "support", F.round("tau", 9).alias("tau"), F.round("rel", 9).alias("rel"), "n_groups", "n_windows", "null95", "accepted")
