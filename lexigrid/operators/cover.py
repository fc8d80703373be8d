"""Choosing sources for words that no source covers yet, the most frequent word first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrid.sources.files import written


def gap_cover(gaps: DataFrame, holdings: DataFrame, prefer: list[Column]) -> DataFrame:
    """gaps (word, n) and holdings (source, word, and what ``prefer`` orders by) -> (source, gap_word, gap_count, choice, covers, covers_count).

    Words are taken by falling n, then by word.  A word that no chosen source holds takes the source that comes first by ``prefer``,
    then by source; all words that this one holds are covered.  The second source is kept as a fallback (choice 2), which covers
    nothing.  A source stands once, for the first word that named it.  covers: how many words this choice was the first to cover,
    covers_count: the sum of their n.

    The word-by-word order is kept without going word by word: each word's first source is known from the start, so an open word is
    sure to take it as soon as no open word before it has a source that holds it.  Each round asks that of all open words at
    once, by the first word that waits for each source; the first open word always passes, and rounds are no more than the longest chain
    of words each of which waits for the one before.  Only open words and their holdings go to the next round.  Words that no source holds
    don't appear; nulls hold nothing; repeated rows change nothing.
    """
    rank = F.struct((-F.col("n")).alias("falling"), "word")
    first_two = holdings.join(gaps.select("word", "n", rank.alias("rank")), "word").groupBy("word", "source").agg(F.first("n").alias("n"), F.first("rank").alias("rank"), *[F.min(p).alias(f"p{i}") for i, p in enumerate(prefer)])
    order = Window.partitionBy("word").orderBy(*[f"p{i}" for i in range(len(prefer))], "source")
    best = written(first_two.withColumn("choice", F.row_number().over(order)).where("choice <= 2").select("word", "source", "choice", "n", "rank"), "best")
    still = best.where("choice = 1").select("word", "source", "n", "rank")
    # Words that are no gaps may stay in ``hold``: what is joined with it has gaps only, so that holdings move once by word and once by source.
    hold = written(holdings.select("source", "word").where("word IS NOT NULL").join(still.select("source").distinct(), "source", "left_semi"), "holds")
    every, taken, rounds = hold, None, 0
    while not still.isEmpty():
        waits = still.groupBy("source").agg(F.min("rank").alias("first"))
        least = hold.join(waits, "source").groupBy("word").agg(F.min("first").alias("least"))
        step = written(still.join(least, "word").withColumn("takes", F.col("least") == F.col("rank")).drop("least"), f"cover-{rounds}")
        now = step.where("takes").drop("takes")
        taken = now if taken is None else taken.union(now)
        by = hold.join(now.groupBy("source").agg(F.min("rank").alias("by")), "source").groupBy("word").agg(F.min("by").alias("by"))
        wait = step.where("not takes").drop("takes").join(by, "word", "left").where(F.col("by").isNull() | (F.col("by") > F.col("rank")))  # a later word covers no earlier one
        still = written(wait.drop("by"), f"open-{rounds}")
        hold = written(hold.join(still.select("word"), "word", "left_semi"), f"holds-{rounds}")
        rounds += 1
    taken = best.where("false").select("word", "source", "n", "rank") if taken is None else taken
    named = best.join(taken.select("word"), "word", "left_semi")
    once = named.withColumn("turn", F.row_number().over(Window.partitionBy("source").orderBy("rank", "choice"))).where("turn = 1")
    by = every.join(taken.select("source", "rank"), "source").groupBy("word").agg(F.min(F.struct("rank", "source")).alias("by"))
    covers = by.join(gaps.select("word", "n"), "word").groupBy(F.col("by.source").alias("source")).agg(F.count("*").alias("covers"), F.sum("n").alias("covers_count"))
    none = F.lit(0).cast("long")
    return once.join(covers, "source", "left").select("source", F.col("word").alias("gap_word"), F.col("n").alias("gap_count"), "choice", F.coalesce("covers", none).alias("covers"), F.coalesce("covers_count", none).alias("covers_count"))
