"""Dictionary joins: candidates against a lexicon, phrases against token sequences, merges by priority.

Lexicon tables have a column ``key`` and, where phrases are meant, keys of several words separated by one space.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(df: DataFrame, key: str, *order: str | Column) -> DataFrame:
    """The first row of each key in the given order."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def small(df: DataFrame, most: int = 200_000) -> DataFrame:
    """``df``, sent to all tasks in a join if it has no more than ``most`` rows, so that the other side isn't shuffled; a larger one is joined as usual."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def first_match(tokens: DataFrame, candidates: Column, lexicon: DataFrame, *by: str) -> DataFrame:
    """For each token (columns ``by``) the first of its candidates that is in the lexicon; null where none is.

    Candidates are looked up for distinct tokens only, so the join works on the vocabulary, not the corpus.
    """
    each = tokens.select(*by, F.posexplode(candidates).alias("pos", "key"))
    hit = each.join(lexicon.select("key"), "key").groupBy(*by).agg(F.min_by("key", "pos").alias("entry"), F.min("pos").alias("route"))
    return tokens.join(hit, list(by), "left")


def priority_routes(*routes: DataFrame) -> DataFrame:
    """(word, entry) tables in order of priority -> word, entry, route (0 is the first)."""
    named = [r.select("word", "entry", F.lit(k).alias("route")) for k, r in enumerate(routes)]
    every = named[0]
    for r in named[1:]:
        every = every.unionByName(r)
    best = every.groupBy("word").agg(F.min(F.struct("route", "entry")).alias("best"))
    return best.select("word", "best.entry", "best.route")


def ngrams(tokens: DataFrame, n: int, *by: str) -> DataFrame:
    """Contiguous runs of n words of each sequence (``by``), from the column ``words``: start and phrase."""
    starts = F.sequence(F.lit(0), F.size("words") - n)
    grams = F.when(F.size("words") >= n, F.transform(starts, lambda i: F.struct(i.alias("start"), F.array_join(F.slice("words", i + 1, n), " ").alias("key"))))
    return tokens.select(*by, F.explode(grams).alias("g")).select(*by, "g.start", "g.key")


def upsert(base: DataFrame, corrections: DataFrame, withdrawn: DataFrame, fills: DataFrame, key: str) -> DataFrame:
    """Corrections replace rows of their key, withdrawn keys go, fills never replace."""
    kept = base.join(corrections.select(key), key, "left_anti").unionByName(corrections).join(withdrawn.select(key), key, "left_anti")
    return kept.unionByName(fills.join(kept.select(key), key, "left_anti").join(withdrawn.select(key), key, "left_anti"))
