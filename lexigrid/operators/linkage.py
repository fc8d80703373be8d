"""Groups of items by complete linkage, with a hard stop and a ratio stop."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrid.sources.files import written

MOST = 5000


def near_pairs(nodes: DataFrame, distance: Column, cell: str, width: float) -> DataFrame:
    """(item, a, b, distance) of the nodes of an item that are at most ``width`` apart; ``distance`` is of structs a and b and is never less
    than the difference of ``cell``, so that only nodes of the same or the next cell of that width meet."""
    at = F.floor(F.col(cell) / width)
    left = nodes.select("item", F.struct(*[c for c in nodes.columns if c != "item"]).alias("a"), at.alias("at"))
    right = nodes.select("item", F.struct(*[c for c in nodes.columns if c != "item"]).alias("b"), F.explode(F.array(at - 1, at, at + 1)).alias("at"))
    return left.join(right, ["item", "at"]).where(F.col("a.id") < F.col("b.id")).select("item", F.col("a.id").alias("a"), F.col("b.id").alias("b"), distance.alias("distance")).where(F.col("distance") <= width)


def _components(pairs: DataFrame) -> DataFrame:
    """(item, id, component) of every node that a pair names: smallest neighbours are hooked to until no pair is left."""
    links = written(pairs.select("item", "a", "b"), "links")
    label = links.select("item", F.col("a").alias("id")).union(links.select("item", "b")).distinct().withColumn("component", F.col("id"))
    while not links.isEmpty():
        both = links.union(links.select("item", F.col("b"), F.col("a")))
        hook = written(both.groupBy("item", F.col("a").alias("x")).agg(F.least("x", F.min("b")).alias("to")).where("x <> to"), "hooks")
        label = written(label.join(hook, (label.item == hook.item) & (label.component == hook.x), "left").select(label.item, "id", F.coalesce("to", "component").alias("component")), "labels")
        one = links.join(hook.withColumnRenamed("x", "a"), ["item", "a"], "left").select("item", F.coalesce("to", "a").alias("a"), "b")
        two = one.join(hook.withColumnRenamed("x", "b"), ["item", "b"], "left").select("item", "a", F.coalesce("to", "b").alias("b"))
        links = written(two.where("a <> b").distinct(), "links")
    return label


def merges(a: list, b: list, distance: list, ratio: float, base: float) -> list[tuple]:
    """The merges of one component in order: (height, smaller first member, larger first member, allowed by the ratio); the first that
    isn't is the last.  Of equal heights the pair with the smallest first members comes first."""
    apart, spread, heap = {}, {}, []
    for x, y, d in zip(a, b, distance, strict=True):
        apart.setdefault(x, {})[y] = apart.setdefault(y, {})[x] = d
        spread[x] = spread[y] = 0.0
        heap.append((d, min(x, y), max(x, y)))
    heapq.heapify(heap)
    out = []
    while heap:
        d, x, y = heapq.heappop(heap)
        if apart.get(x, {}).get(y) != d:
            continue  # one of them has grown since
        out.append((d, x, y, d <= ratio * max(spread[x], spread[y], base)))
        if not out[-1][3]:
            break
        mine, other = apart.pop(x), apart.pop(y)
        for z in mine.keys() | other.keys():
            if z not in (x, y):
                apart[z].pop(x, None), apart[z].pop(y, None)
        apart[x] = {}
        for z in (mine.keys() & other.keys()) - {x, y}:  # a pair that isn't there is beyond the hard stop
            h = max(mine[z], other[z])
            apart[x][z] = apart[z][x] = h
            heapq.heappush(heap, (h, min(x, z), max(x, z)))
        spread[x] = d
    return out


def complete_linkage(nodes: DataFrame, pairs: DataFrame, hard: float, ratio: float, base: float, most: int = MOST) -> DataFrame:
    """nodes (item, id) and pairs (item, a, b, distance) -> (item, id, cluster, size, spread); cluster is its smallest id.

    Two clusters are as far apart as their farthest members.  The nearest two of an item merge until these are farther than ``hard``, or
    farther than ``ratio`` times the larger spread of both (``base`` at least); this ends the item.  Pairs farther than ``hard`` may
    be left out.  Of equal distances the pair with the smallest ids merges first.

    No cluster crosses components of the pairs within ``hard``, so a task holds one component; one of more than ``most`` nodes is refused
    with an error.  A component's merges are found up to its own first stop, and the item's stop is the earliest of these: merges come in the
    order of the largest height so far, as merging nearest pairs over all components would take them.  Nodes without pairs stay
    alone; pairs with nulls and repeated rows change nothing.
    """
    kept = written(pairs.where(F.col("distance") <= hard).groupBy("item", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("distance").alias("distance")).where("a <> b"), "pairs")
    label = written(_components(kept), "components")
    large = label.groupBy("item", "component").count().where(F.col("count") > most).first()
    if large:
        raise ValueError(f"a component of {large['count']} nodes, more than {most}")
    of = kept.join(label.withColumnRenamed("id", "a"), ["item", "a"])
    item = dict(nodes.dtypes)["item"]

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        out, latest = [], ()
        for n, (h, x, y, fine) in enumerate(merges(rows["a"].tolist(), rows["b"].tolist(), rows["distance"].tolist(), ratio, base)):
            latest = max(latest, (h, x, y))
            out.append((rows["item"].iloc[0], rows["component"].iloc[0], n, h, x, y, fine, *latest))
        return pd.DataFrame(out, columns=["item", "component", "n", "h", "x", "y", "fine", "lh", "lx", "ly"])

    steps = written(of.groupBy("item", "component").applyInPandas(one, f"item {item}, component long, n int, h double, x long, y long, fine boolean, lh double, lx long, ly long"), "merges")
    when = F.struct("lh", "lx", "ly")
    stop = steps.where("not fine").groupBy("item").agg(F.min(when).alias("stop"))
    done = steps.join(stop, "item", "left").where(F.col("fine") & (F.col("stop").isNull() | (when < F.col("stop"))))

    def clusters(rows: pd.DataFrame) -> pd.DataFrame:
        into, spread = {}, {}
        for x, y, h in rows.sort_values("n")[["x", "y", "h"]].itertuples(index=False):
            into[y], spread[x] = x, h
        out = []
        for v in {*into, *into.values()}:
            c = v
            while c in into:
                c = into[c]
            out.append((rows["item"].iloc[0], v, c, spread[c]))
        return pd.DataFrame(out, columns=["item", "id", "cluster", "spread"])

    found = written(done.groupBy("item", "component").applyInPandas(clusters, f"item {item}, id long, cluster long, spread double"), "clusters")
    size = found.groupBy("item", "cluster").agg(F.count("*").alias("size"))
    every = nodes.select("item", F.col("id").cast("long").alias("id")).distinct().join(found.join(size, ["item", "cluster"]), ["item", "id"], "left")
    return every.select("item", "id", F.coalesce("cluster", "id").alias("cluster"), F.coalesce("size", F.lit(1).cast("long")).alias("size"), F.coalesce("spread", F.lit(0.0)).alias("spread"))
