"""BM25, dense search and rank fusion as DataFrame operators; many queries at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
BLOCK = 4096


def postings(docs: DataFrame, terms: str = "words", doc: str = "doc_id") -> DataFrame:
    """(doc, term, tf)"""
    return docs.select(doc, F.explode(terms).alias("term")).groupBy(doc, "term").agg(F.count("*").alias("tf"))


def idf(post: DataFrame, n: int, doc: str = "doc_id") -> DataFrame:
    """ln(1 + (n - df + 0.5) / (df + 0.5)); postings hold a row per document and term."""
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    return df.withColumn("idf", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)))


def scores(docs: DataFrame, queries: DataFrame, doc: str = "doc_id", query: str = "item_id") -> DataFrame:
    """(query, doc, score, hits) for all pairs that share a term: BM25 and the number of distinct query terms held.

    ``words`` are the terms of either side; repeated query terms count.  Where the queries' terms are few they go to the documents, which are dealt by id once:
    words are counted, weighed and summed where their document lies.
    """
    asked = queries.select(query, F.explode("words").alias("term")).groupBy(query, "term").agg(F.count("*").alias("qtf"))
    few = asked.limit(200_001).count() <= 200_000
    small = F.broadcast if few else lambda df: df
    sizes = docs.agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("avgdl"))
    dealt = docs.select(doc, F.size("words").alias("dl"), "words")
    found = (dealt.repartition(doc) if few else dealt).select(doc, "dl", F.explode("words").alias("term")).join(small(asked.select("term").distinct()), "term", "left_semi")
    post = found.groupBy(doc, "dl", "term").agg(F.count("*").alias("tf"))
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    weighted = df.crossJoin(F.broadcast(sizes))  # one row
    weighted = small(weighted.withColumn("idf", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))))
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return post.join(weighted, "term").join(small(asked), "term").groupBy(query, doc).agg(F.sum(part).alias("score"), F.count("*").alias("hits"))


def bm25(docs: DataFrame, queries: DataFrame, doc: str = "doc_id", query: str = "item_id") -> DataFrame:
    """(query, doc, score) of ``scores``."""
    return scores(docs, queries, doc, query).select(query, doc, "score")


def top(scored: DataFrame, k: int, by: str, *order) -> DataFrame:
    """The first k rows of each ``by``, with a rank from 0."""
    placed = scored.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)
    return placed.withColumn("rank", F.col("rank") - 1)  # the filter on the plain number lets each task keep k rows a group


def dot(x: Column | str, y: Column | str) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, b: a + b)


def distance(x: Column | str, y: Column | str) -> Column:
    """Euclidean."""
    return F.sqrt(F.aggregate(F.zip_with(x, y, lambda a, b: F.pow(a.cast("double") - b.cast("double"), F.lit(2))), F.lit(0.0), lambda a, b: a + b))


def dense(vectors: DataFrame, queries: DataFrame, measure: Callable[[str, str], Column] = dot, vec: str = "vec_id", query: str = "query_id") -> DataFrame:
    """The measure of every query with every other vector.  The query set is stated by the caller; it is broadcast in blocks of
    about ``BLOCK`` queries each, so no broadcast grows with it."""
    blocks = max(1, -(-queries.count() // BLOCK))
    asked = queries.select(F.col(vec).alias(query), F.col("embedding").alias("q"), F.pmod(F.xxhash64(vec), F.lit(blocks)).alias("block"))
    parts = [vectors.join(F.broadcast(asked.where(F.col("block") == k)), F.col(vec) != F.col(query)).select(query, vec, measure("embedding", "q").alias("score")) for k in range(blocks)]
    return reduce(DataFrame.union, parts)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, far: bool = False, vec: str = "vec_id", query: str = "query_id", block: int = 8192) -> DataFrame:
    """(query, vec, score): at least the first k other vectors of each query by score rounded to six digits, then by id; score: the dot product, the largest
    first, or with ``far`` the Euclidean distance, the least first.  ids are numbers; ``top`` puts what is returned in order.

    Vectors and queries are packed ``block`` and a quarter of it to a row.  A pair of blocks is one product of matrices, and only pairs that can be among a
    query's first k of their block are then summed one component after the other, as ``dot`` and ``distance`` do, and shuffled.  Vectors that are null, of another size than
    most queries or hold what is no finite number are measured one by one."""
    whole = lambda c: F.coalesce(F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    size = queries.agg(F.mode(F.size("embedding"))).first()[0]
    plain = whole(F.col("embedding")) & (F.size("embedding") == F.lit(size if size is not None else -1))
    v, q = (df.select(F.col(vec).alias("id"), F.col("embedding").alias("x"), plain.alias("plain")) for df in (vectors, queries))

    def packed(df: DataFrame, name: str, most: int) -> DataFrame:
        some = df.where("plain")
        n = max(1, -(-some.count() // most))
        return some.groupBy(F.pmod(F.xxhash64("id"), F.lit(n)).alias("block")).agg(F.collect_list("id").alias(f"{name}_ids"), F.flatten(F.collect_list("x")).alias(name)).drop("block").repartition(min(n, 2000))

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for ids, x, names, y in zip(frame["v_ids"], frame["v"], frame["q_ids"], frame["q"], strict=True):
                ids, names = np.asarray(ids), np.asarray(names)
                x, y = (np.asarray(a, float).reshape(len(i), -1) for a, i in ((x, ids), (y, names)))
                for s in range(0, len(names), 256):  # a table of 256 queries and a block of vectors
                    yield _block_top(ids, x, names[s : s + 256], y[s : s + 256], k, far)

    found = packed(v, "v", block).crossJoin(packed(q, "q", block // 4)).mapInPandas(work, "q long, v long, score double").select(F.col("q").alias(query), F.col("v").alias(vec), "score")
    odd = lambda df, flag: df.where("plain" if flag else "not plain").select(F.col("id").alias(vec), F.col("x").alias("embedding"))
    rest = [(odd(v, False), queries), (odd(v, True), odd(q, False))]
    return reduce(DataFrame.union, [found, *(dense(some, asked, distance if far else dot, vec, query) for some, asked in rest)])


def _block_top(ids: np.ndarray, x: np.ndarray, names: np.ndarray, y: np.ndarray, k: int, far: bool) -> pd.DataFrame:
    near = y @ x.T  # to rounding, which is allowed for below
    if far:
        near = -np.sqrt(np.maximum((y * y).sum(axis=1)[:, None] + (x * x).sum(axis=1) - 2 * near, 0))
    room = 1e-6 + 1e-9 * max(1.0, float(np.abs(near).max(initial=0))) + (2e-6 * max(1.0, float(np.abs(x).max(initial=0)) * x.shape[1] ** 0.5) if far else 0)
    near[names[:, None] == ids] = -np.inf
    kth = np.partition(near, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(names), -np.inf)
    r, c = np.nonzero((near >= kth[:, None] - room) & (near > -np.inf))
    score = np.zeros(len(r))
    for d in range(x.shape[1]):
        score += (x[c, d] - y[r, d]) ** 2 if far else x[c, d] * y[r, d]
    score = np.sqrt(score) if far else score
    order = np.lexsort((ids[c], score if far else -score, r))
    r, c, score = r[order], c[order], score[order]
    same = np.flatnonzero((np.diff(r, prepend=-1) != 0) | (np.diff(score, prepend=np.nan) != 0))  # where rows of one score begin
    first = np.zeros(len(r), np.int64)
    first[same] = same
    begin = np.searchsorted(r, r)
    last = score[np.minimum(begin + k - 1, np.searchsorted(r, r, side="right") - 1)]
    keep = score <= last + 1.1e-6 if far else score >= last - 1.1e-6  # all that may be equal to the last one when rounded
    keep &= np.arange(len(r)) - np.maximum.accumulate(first) < k  # of equal scores the first ids
    return pd.DataFrame({"q": names[r[keep]], "v": ids[c[keep]], "score": score[keep]})


def fuse(lists: list[DataFrame], query: str, item: str, k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of lists with ranks from 0."""
    every = lists[0].select(query, item, "rank")
    for x in lists[1:]:
        every = every.unionByName(x.select(query, item, "rank"))
    return every.groupBy(query, item).agg(F.sum(1 / (k + F.col("rank") + 1)).alias("score"))
