"""Mixing sources to target weights, in DataFrame operations only.

Sizes are summed per source, a target is set for each source, and target / size is its repetition rate.  A document is then
emitted floor(rate) times, and once more if a hash of its id, read as a number in [0, 1), is below the rate's fraction; so
reruns agree, and the mix needs no shuffle of texts and no knowledge of other documents.

Targets: the sources in code-point order, null last, weigh ``weights`` in turn and share ``share`` times all words.  A target
stops at ``limit`` times its source's size; the excess is shared among the rest by weight until none is above.  That is a
water level, found in one pass over the sources in order of limit * size / weight: where the level that would hold if all
sources before were stopped does not reach a source's own limit, it is the level of that source and all after it.

Nulls: a null text has size 0, a null source is a source of its own, a null id is hashed as a text of its own.  A source of
size 0 has target 0 and emits nothing.  Equal ids draw equally, so repeated rows are taken equally often.  An empty table gives
an empty result; other columns pass through ``mix`` whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrid.llm.shared import written

WORD = r"[^\x20\x09-\x0D]+"
#: Sources up to this number are broadcast (about 100 bytes each); more are joined by a shuffle.
BROADCAST_SOURCES = 100_000


def words(text: Column) -> Column:
    """Number of words, runs of anything but space, tab, line feed, vertical tab, form feed and carriage return."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(key: Column, seed: int) -> Column:
    """A number in [0, 1) from the first 52 bits of a hash."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """source, source_size, target; one row per source of ``sizes`` (source, size)."""
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))  # a row per source, not per document
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(turn - 1, F.lit(len(weights))) + 1).cast("double")
    cap = F.col("source_size") * F.lit(limit)
    ranked = sums.select("source", "source_size", turn.alias("turn"), weight.alias("weight"), cap.alias("cap"), (cap / weight).alias("ratio"))
    order = Window.orderBy("ratio", "turn")
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    budget = F.sum("source_size").over(Window.partitionBy()) * F.lit(share)
    level = ranked.withColumn("level", (budget - before) / left).withColumn("place", F.row_number().over(order))
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("place", "level"))).over(Window.partitionBy())
    target = F.least(F.col("cap"), F.coalesce(first["level"] * F.col("weight"), F.col("cap")))
    return level.select("source", "source_size", target.alias("target"))


def with_copies(sizes: DataFrame, seed: int = 5, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, limit: float = 2.0, id_col: str = "doc_id") -> DataFrame:
    """``sizes`` (with source, size and an id) with source_size, target and copies."""
    targets = written(source_targets(sizes, weights, share, limit), "mix_targets").withColumnRenamed("source", "__source")
    targets = F.broadcast(targets) if targets.count() <= BROADCAST_SOURCES else targets
    joined = sizes.join(targets, F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    return joined.withColumn("copies", (whole + (draw(F.col(id_col), seed) < rate - whole).cast("long")).cast("long"))


def mix_report(docs: DataFrame, seed: int = 5, weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """doc_id, size, source_size, target, taken (size times copies)."""
    sizes = written(docs.select("doc_id", "source", words(F.col("text")).alias("size")), "mix_sizes")
    return with_copies(sizes, seed, weights).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, seed: int = 5, weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """The mixed corpus: ``docs`` with each row as often as it is taken; all columns stay."""
    sums = written(docs.groupBy("source").agg(F.sum(words(F.col("text"))).alias("size")), "mix_sums")
    targets = written(source_targets(sums, weights), "mix_targets")
    targets = F.broadcast(targets) if targets.count() <= BROADCAST_SOURCES else targets
    rows = docs.select(F.col("source").alias("own"), draw(F.col("doc_id"), seed).alias("draw"), F.struct("*").alias("row"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    copies = (whole + (F.col("draw") < rate - whole).cast("long")).cast("int")
    joined = rows.join(targets, F.col("own").eqNullSafe(F.col("source")), "left")
    return joined.select("row", F.explode(F.array_repeat(F.lit(1), copies))).select("row.*")


MIX_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS turn,
    CAST(CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight,
    source_size * CAST(2 AS DOUBLE) AS cap
  FROM sums
), levels AS (
  SELECT *, cap / weight AS ratio,
    (sum(source_size) OVER () * CAST(1.5 AS DOUBLE)
     - coalesce(sum(cap) OVER (ORDER BY cap / weight, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
    row_number() OVER (ORDER BY cap / weight, turn) AS place
  FROM ranked
), targets AS (
  SELECT source, source_size,
    least(cap, coalesce((SELECT arg_min(level, place) FROM levels WHERE level <= ratio) * weight, cap)) AS target
  FROM levels
), rates AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    CAST(CAST('0x' || substr(md5('5:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496 AS draw
  FROM sizes d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM rates
"""
