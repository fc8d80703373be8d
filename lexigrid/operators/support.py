"""Support of a word's occurrences by other groups, against what pseudo-words reach by chance.  DataFrame functions only.

A word has windows, each of one group and of one or more segments (vectors).  A segment is supported by another group where a
window of the same word comes as near as ``near`` of the negatives' windows do; the word's support is its best segment's share of
other groups.  Pseudo-words are windows of different groups drawn at random: the quantile of their best support is what chance
reaches with as many groups.

Draws are orders by hash (md5), so that reruns agree.  As many windows as stated are drawn for a word, for the negatives and for
the pseudo-words: that is the method, whatever the table's size.  Negatives come from a pool of ``POOL`` windows, pseudo-words from ``POOL`` groups, the
first ones by hash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrid.sources.files import written

POOL = 600
#: Groups up to twelve have a null of their own; beyond, the next of these sizes stands for them.
SIZES = (*range(2, 13), 16, 24, 32, 60)


@dataclass(frozen=True)
class Plan:
    windows: int = 60  # drawn of a word
    negatives: int = 60
    few: int = 20  # with fewer negatives of other words, any windows but its own are taken
    trials: int = 30
    near: float = 0.1
    chance: float = 0.95
    least: float = 0.6
    occurrences: int = 5
    groups: int = 3


def _drawn(df: DataFrame, by: list[str], seed: Column, n: int) -> DataFrame:
    return df.withColumn("turn", F.row_number().over(Window.partitionBy(*by).orderBy(F.md5(seed), "win"))).where(F.col("turn") <= n).drop("turn")


def _text(*parts: Column | str) -> Column:
    return F.concat_ws("|", *[F.col(p).cast("string") if isinstance(p, str) else p for p in parts])


def _distance(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x) / F.size(a))


def best_support(segments: DataFrame, negatives: DataFrame, near: float) -> DataFrame:
    """segments (key, grp, win, seg, vec) and negatives (key, win, vec) -> a row for each key: its best segment and that one's figures."""
    a = segments.select("key", "grp", "win", "seg", "vec")
    b = segments.select("key", F.col("grp").alias("grp2"), F.col("win").alias("win2"), F.col("vec").alias("vec2"))
    apart = lambda left, right: _distance(F.col(left), F.col(right))
    least = a.join(b, "key").where("win <> win2").groupBy("key", "seg", "grp", "grp2", "win2").agg(F.min(apart("vec", "vec2")).alias("d"))
    far = a.join(negatives.select("key", F.col("win").alias("win2"), F.col("vec").alias("vec2")), "key").groupBy("key", "seg", "win2").agg(F.min(apart("vec", "vec2")).alias("d"))
    bound = far.groupBy("key", "seg").agg(F.percentile("d", near).alias("tau"), F.percentile("d", 0.5).alias("neg_median"))
    hits = least.join(bound, ["key", "seg"]).groupBy("key", "seg", "tau", "neg_median").agg(F.count_distinct(F.when(F.col("d") <= F.col("tau"), F.col("grp2"))).alias("hits"), F.percentile("d", 0.5).alias("pos_median"))
    counts = segments.groupBy("key").agg(F.count_distinct("grp").alias("n_groups"), F.count_distinct("win").alias("n_windows"))
    alone = segments.groupBy("key", "grp").agg(F.count_distinct("win").alias("in_group"))
    one = segments.select("key", "grp", "seg").join(counts, "key").join(alone, ["key", "grp"]).join(hits, ["key", "seg"])
    others = F.greatest(F.lit(1), F.col("n_groups") - F.when(F.col("in_group") == 1, 1).otherwise(0))
    scored = one.withColumn("support", F.col("hits") / others).withColumn("rel", F.col("pos_median") / F.greatest(F.col("neg_median"), F.lit(1e-6)))
    best = F.max(F.struct((F.col("support") - 0.01 * F.col("rel")).alias("score"), (-F.col("seg")).alias("first"), "seg", "support", "tau", "rel", "n_groups", "n_windows")).alias("best")
    return scored.groupBy("key").agg(best).select("key", "best.seg", "best.support", "best.tau", "best.rel", "best.n_groups", "best.n_windows")


def _negatives(keyed: DataFrame, pool: DataFrame, plan: Plan) -> DataFrame:
    """(key, win, vec): the first windows of the pool by hash that have no word in common with the key's; with too few such, any but the key's own.
    keyed: (key, word, win)."""
    words, wins = keyed.select("key", "word").distinct(), keyed.select("key", "win").distinct()
    windows = pool.select("win", "word").distinct()
    each = keyed.select("key").distinct().crossJoin(F.broadcast(windows))  # the pool is of a stated size
    free = each.join(wins, ["key", "win"], "left_anti")
    marked = free.join(words.withColumn("same", F.lit(1)), ["key", "word"], "left").select("key", "win", F.coalesce("same", F.lit(0)).alias("same"))
    marked = marked.withColumn("clear", F.sum(1 - F.col("same")).over(Window.partitionBy("key"))).where((F.col("same") == 0) | (F.col("clear") < plan.few))
    taken = _drawn(marked, ["key"], _text(F.lit("negative"), "key", "win"), plan.negatives)
    return taken.select("key", "win").join(F.broadcast(pool.select("win", "vec")), "win")


def null_support(segments: DataFrame, pool: DataFrame, sizes: DataFrame, plan: Plan) -> DataFrame:
    """(size, null95, null_median) for each of ``sizes``: the best support of pseudo-words of so many windows, each of another group."""
    groups = segments.select("grp").distinct().orderBy(F.md5(_text(F.lit("group"), "grp")), "grp").limit(POOL)
    some = _drawn(segments.join(F.broadcast(groups), "grp", "left_semi").select("grp", "win").distinct(), ["grp"], _text(F.lit("window"), "win"), 8)
    trials = sizes.select("size", F.explode(F.sequence(F.lit(0), F.lit(plan.trials - 1))).alias("trial"))
    picked = trials.crossJoin(F.broadcast(groups)).withColumn("turn", F.row_number().over(Window.partitionBy("size", "trial").orderBy(F.md5(_text("size", "trial", "grp")), "grp"))).where("turn <= size").drop("turn")
    one = picked.join(some, "grp").groupBy("size", "trial", "grp").agg(F.min_by("win", F.struct(F.md5(_text("size", "trial", "win")), "win")).alias("win"))
    keyed = written(one.join(segments.select("win", "word", "seg", "vec"), "win").withColumn("key", _text(F.lit("pseudo"), "size", "trial")), "pseudo")
    got = best_support(keyed, _negatives(keyed, pool, plan), plan.near)
    supports = keyed.select("key", "size").distinct().join(got, "key")
    return supports.groupBy("size").agg(F.percentile("support", plan.chance).alias("null95"), F.percentile("support", 0.5).alias("null_median"))


def supported_words(segments: DataFrame, plan: Plan | None = None) -> DataFrame:
    """segments (word, grp, win, seg, vec), seg a number -> (key, seg, support, tau, rel, n_groups, n_windows, null95, accepted) of every word with
    enough windows and groups."""
    plan = plan or Plan()
    segments = segments.where("word is not null and grp is not null and win is not null and vec is not null")
    enough = segments.groupBy("word").agg(F.count_distinct("win").alias("wins"), F.count_distinct("grp").alias("grps")).where((F.col("wins") >= plan.occurrences) & (F.col("grps") >= plan.groups))
    windows = _drawn(segments.join(enough, "word", "left_semi").select("word", "win").distinct(), ["word"], _text(F.lit("own"), "word", "win"), plan.windows)
    keyed = written(segments.join(windows, ["word", "win"]).withColumn("key", F.col("word").cast("string")), "support-words")
    first = segments.select("win").distinct().orderBy(F.md5(_text(F.lit("pool"), "win")), "win").limit(POOL)
    pool = written(segments.join(F.broadcast(first), "win", "left_semi"), "support-pool")
    got = written(best_support(keyed, _negatives(keyed, pool, plan), plan.near), "support")
    size = F.array_min(F.filter(F.array(*map(F.lit, SIZES)), lambda s: s >= F.least(F.col("n_groups"), F.lit(SIZES[-1]))))
    sized = got.withColumn("size", size)
    null = null_support(segments, pool, sized.select("size").distinct(), plan)
    fine = (F.col("support") >= plan.least) & (F.col("support") > F.col("null95"))
    return sized.join(null, "size", "left").select("key", "seg", "support", "tau", "rel", "n_groups", "n_windows", "null95", F.coalesce(fine, F.lit(False)).alias("accepted"))
