"""Connected components of links, by contraction.

In each round every vertex hooks to its smallest neighbour, links are rewritten to the hooks and equal ones merged; the
smallest vertex of a component hooks to none, so when no link is left every vertex has come to it.  A vertex with very many
links is met in an aggregate with map-side partial minima and in joins that adaptive execution can split, never in one group.
The tables of each round are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.llm.shared import written


def connected_components(links: DataFrame) -> DataFrame:
    """(a, b) -> (id, component): the smallest id that each linked id reaches.  Nulls and loops are ignored."""
    links = written(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    label = links.select(F.col("a").alias("id")).union(links.select("b")).distinct().select("id", F.col("id").alias("component"))
    while not links.isEmpty():
        both = links.select("a", "b").union(links.select("b", "a"))
        hook = written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("to")).where("a <> to"), "hooks")
        label = written(label.join(hook, label.component == hook.a, "left").select("id", F.coalesce("to", "component").alias("component")), "labels")
        left = links.join(hook, "a", "left").select(F.coalesce("to", "a").alias("x"), "b")
        moved = left.join(hook, left.b == hook.a, "left").select("x", F.coalesce("to", "b").alias("y")).where("x <> y")
        links = written(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
    return label
