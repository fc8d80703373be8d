"""Scores of predicted intervals and texts against gold ones, as joins and aggregates over all streams or pairs at once."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlap_matches(gold: DataFrame, found: DataFrame, by: str, least: float = 0.5, width: int = 32) -> DataFrame:
    """(by, gold_start, found_start, iou): intervals matched one to one, the best overlaps first.

    Both sides: (by, start, end), ends included, disjoint within their side and stream.  Intervals meet where they lie in the same
    stretch of ``width`` places, so the join is by key; each pair is kept in the stretch where its common part begins.  Disjoint
    intervals that overlap by half or more can only meet as one against two, so pairs that are best for both sides are all.
    """
    if least < 0.5:
        raise ValueError("below one half, best pairs of both sides aren't all matches")
    cells = lambda: F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width)))
    g = gold.select(by, F.col("start").alias("a"), F.col("end").alias("b"), cells().alias("cell"))
    p = found.select(by, F.col("start").alias("c"), F.col("end").alias("d"), cells().alias("cell"))
    common = F.least("b", "d") - F.greatest("a", "c") + 1
    pairs = g.join(p, [by, "cell"]).where((common > 0) & (F.floor(F.greatest("a", "c") / width) == F.col("cell")))
    pairs = pairs.withColumn("iou", common / (F.col("b") - F.col("a") + F.col("d") - F.col("c") + 2 - common)).where(F.col("iou") >= least)
    place = lambda side, *order: F.row_number().over(Window.partitionBy(by, side).orderBy(F.desc("iou"), *order))
    best = pairs.withColumns({"i": place("a", F.desc("c")), "j": place("c", F.desc("a"))}).where("i = 1 AND j = 1")
    return best.select(by, F.col("a").alias("gold_start"), F.col("c").alias("found_start"), "iou")


def run_counts(hyp: Sequence, ref: Sequence, most: int) -> list[tuple[int, int, int]]:
    """For each n up to ``most``: runs of n elements in hyp, in ref, and common to both, each as often as both have it.  Runs are numbered by the run one shorter
    and the element after it, so their length costs nothing."""
    code: dict = {}
    out, sides = [], [[code.setdefault(x, len(code)) for x in side] for side in (hyp, ref)]
    first = sides
    for n in range(1, most + 1):
        if n > 1:
            code = {}
            sides = [[code.setdefault(x, len(code)) for x in zip(runs, one[n - 1 :], strict=False)] for runs, one in zip(sides, first, strict=True)]
        a, b = map(Counter, sides)
        out.append((len(sides[0]), len(sides[1]), sum(min(k, b[x]) for x, k in a.items() if x in b)))
    return out


def clipped_counts(pairs: DataFrame, hyp: Column, ref: Column, most: int) -> DataFrame:
    """A row for each n up to ``most``: runs of n elements in the hypotheses, in the references, and common to both, each counted
    at most as often as either has it in its pair.  Sides are arrays, or strings that are taken letter by letter.

    A pair is counted where it lies; only its ``most`` sums leave the row."""

    @F.pandas_udf("array<struct<n:int,h:bigint,r:bigint,both:bigint>>")
    def of(hyps: pd.Series, refs: pd.Series) -> pd.Series:
        return pd.Series([[{"n": n, "h": h, "r": r, "both": both} for n, (h, r, both) in enumerate(run_counts(x, y, most), 1)] for x, y in zip(hyps, refs, strict=True)])

    sums = pairs.select(F.explode(of(hyp, ref)).alias("x")).groupBy("x.n").agg(F.sum("x.h").alias("hyp"), F.sum("x.r").alias("ref"), F.sum("x.both").alias("same"))
    return sums.where("hyp > 0 OR ref > 0")


def bleu(counts: DataFrame, sizes: DataFrame, most: int = 4) -> DataFrame:
    """BLEU in percent from counts up to ``most``; sizes: one row (hyp, ref) of total lengths.  An n without a match counts as half
    a match, the next such n as a quarter, and so on."""
    grid = sizes.sparkSession.range(1, most + 1).select(F.col("id").cast("int").alias("n")).join(counts, "n", "left").fillna(0)
    missed = F.sum(F.when(F.col("same") == 0, 1).otherwise(0)).over(Window.orderBy("n"))  # a row for each n
    p = F.when(F.col("same") > 0, F.col("same") / F.col("hyp")).otherwise(1 / (F.pow(F.lit(2.0), missed) * F.greatest("hyp", F.lit(1))))
    mean = grid.select(F.log(p).alias("p")).agg(F.avg("p").alias("p"))
    short = F.when(sizes["hyp"] < sizes["ref"], F.exp(1 - sizes["ref"] / sizes["hyp"])).otherwise(1.0)
    return mean.crossJoin(sizes).select((100 * short * F.exp("p")).alias("bleu"))


def chrf(counts: DataFrame, beta: float = 2.0) -> DataFrame:
    """chrF in percent: means over n of the share of the hypotheses' and of the references' runs that are common, as an F score."""
    some = counts.where("hyp > 0 AND ref > 0").agg(F.avg(F.col("same") / F.col("hyp")).alias("p"), F.avg(F.col("same") / F.col("ref")).alias("r"))
    return some.select(F.coalesce(100 * (1 + beta**2) * F.col("p") * F.col("r") / F.nullif(beta**2 * F.col("p") + F.col("r"), F.lit(0.0)), F.lit(0.0)).alias("chrf"))


def peak_windows(series: DataFrame, by: str, at: str, value: str, share: float = 0.5, least: int = 6, most: int = 24) -> DataFrame:
    """(by, start, end): around each series' first peak, as far as values exceed ``share`` of it, to the left first and over no more
    than ``most`` rows; shorter ones are widened at both sides to ``least`` rows, as far as there are rows.  at: 0, 1, 2, ..."""
    whole = Window.partitionBy(by)
    top = F.max(F.struct(F.col(value).alias("v"), (-F.col(at)).alias("t"))).over(whole)
    rows = series.select(by, at, value, top.alias("top")).withColumn("off", F.col(at) + F.col("top.t"))
    low = ~(F.col(value) > share * F.col("top.v"))
    ends = rows.groupBy(by).agg(F.first("top.t").alias("t"), F.max(F.when(low & (F.col("off") < 0), F.col(at))).alias("left"), F.min(F.when(low & (F.col("off") > 0), F.col(at))).alias("right"), F.max(at).alias("last"))
    t = -F.col("t")
    lo = F.greatest(F.coalesce(F.col("left") + 1, F.lit(0)), t - (most - 1))
    hi = F.least(F.coalesce(F.col("right") - 1, F.col("last")), lo + most - 1)
    wide = lambda k: F.struct(F.greatest(F.lit(0), F.col("lo") - k).alias("start"), F.least("last", F.col("hi") + k).alias("end"))
    tries = F.array(*map(wide, range(least)))
    enough = F.filter(tries, lambda w: w["end"] - w["start"] + 1 >= least)
    return ends.withColumns({"lo": lo, "hi": hi}).withColumn("w", F.coalesce(F.get(enough, F.lit(0)), F.get(tries, F.lit(least - 1)))).select(by, "w.start", "w.end")
