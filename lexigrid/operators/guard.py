"""Texts that hold given words or pairs of words, by any of a word's forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_level(tokens: DataFrame, forms: Callable[[Column], Column], levels: list[tuple[str, list[str]]], by: str) -> DataFrame:
    """(by, level): for each text the first level of which a word or an adjacent pair of words stands in it; null where none does.

    tokens: (by, pos, word), a row for each word.  levels: names with phrases of one or two words.  A text's word counts as any
    of its ``forms``, found once for each distinct word; a pair is met by looking at the word before.
    """
    singles = {w for _, phrases in levels for p in phrases for w in p.split()}
    held = F.array_intersect(forms(F.col("word")), F.array(*map(F.lit, sorted(singles))))
    each = tokens.select("word").distinct().select("word", F.explode_outer(held).alias("one"))  # outer: a filter on the forms themselves would be moved to every token
    known = each.where("one IS NOT NULL").groupBy("word").agg(F.collect_set("one").alias("held"))
    marked = tokens.join(known, "word", "left")
    before = F.when(F.lag("pos").over(Window.partitionBy(by).orderBy("pos")) == F.col("pos") - 1, F.lag("held").over(Window.partitionBy(by).orderBy("pos")))
    marked = marked.withColumn("before", before).where("held IS NOT NULL")

    def here(phrase: str) -> Column:
        *first, last = phrase.split()
        found = F.array_contains("held", last)
        return found & F.coalesce(F.array_contains("before", first[0]), F.lit(False)) if first else found

    rank = F.coalesce(*(F.when(F.greatest(*map(here, phrases), F.lit(False)), k) for k, (_, phrases) in enumerate(levels)))
    best = marked.groupBy(by).agg(F.min(rank).alias("rank"))
    names = F.array(*(F.lit(n) for n, _ in levels))
    return tokens.select(by).distinct().join(best, by, "left").select(by, F.get(names, F.col("rank")).alias("level"))
