"""Embedding near-dedup by spherical-cap filters.

Filters are caps around directions of a structured random product code: after a random rotation the coordinates fall into
``blocks`` blocks, each with its own random unit codewords, and a direction is one codeword of each.  A vector belongs to all
filters whose direction it meets with more than a threshold; these are list-decoded block by block, dropping every partial sum
that the best remaining codewords can't lift over the threshold; a vector that exceeds few goes to its ``spread`` best.  Vectors that share a filter are compared in double precision.

The number of filters grows with the number of vectors so that a filter holds about ``load`` of them while each vector is in
about ``spread`` filters.  Filters that get narrower are shared by fewer of the pairs at the least cosine, so both numbers are chosen for
the dimension and the number of vectors by ``calibrated``: of pairs at exactly the least cosine, drawn at random, all but one in a
thousand must share a filter (closer pairs share more).  Because the code's rotation is random, what holds for random pairs holds for any
pair of the data.  Where no choice reaches that, the vectors of that dimension are one filter, compared in parts, exactly.  Equal vectors are one class from the start and weigh as many
links as they have rows, so large groups of copies aren't compared; a filter of more than ``most`` vectors is dealt into parts
of about ``most``, and a task compares one part with another or with itself.  A pair is counted in the first filter that both
share.  Each task gives back the components of its links, so chains over vectors in any order stay together.

Vectors that are null, zero, or hold null or non-finite components link with nothing.  Those of each dimension are a set of
their own; below ``SMALL`` dimensions a set is one filter, as there a cap of 0.95 holds a large share of all directions.  Rows
that repeat a vec_id are vectors of their own, with their own links; a link's other end is a row, so equal rows are linked.  A
row with a null vec_id counts as a link of others but names no component.  An empty table gives an empty result, and columns
other than id and vector aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.llm.components import connected_components
from lexigrid.llm.shared import written


SMALL = 12
SPREADS, LOADS = (20, 40, 80, 160, 320), (200, 400, 800, 1600, 3200, 6400)
SALTS = 8


class ProductCode:
    def __init__(self, dim: int, vectors: int, blocks: int = 2, spread: float = 20.0, load: float = 200.0, seed: int = 7):
        rng = np.random.default_rng(seed)
        share = min(0.2, load / max(1, vectors))  # of all vectors in a filter
        self.words = max(4, round((spread / share) ** (1 / blocks)))
        self.least = min(round(spread), self.words**blocks)
        self.rotation = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
        self.cuts = [np.arange(dim)[k::blocks] for k in range(blocks)]
        self.codes = []
        for cut in self.cuts:
            c = rng.normal(size=(self.words, len(cut)))
            self.codes.append(c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12) * np.sqrt(len(cut) / dim))
        # a unit vector's sum over blocks of <x, c> is about normal with variance 1/dim
        self.threshold = NormalDist().inv_cdf(1 - spread / self.words**blocks) / np.sqrt(dim)

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of all filters that unit vectors exceed; each row's ``spread`` best too, whether exceeded or not."""
        y = x @ self.rotation
        scores = [y[:, cut] @ code.T for cut, code in zip(self.cuts, self.codes, strict=True)]
        best = [s.max(axis=1) for s in scores]
        row, total, name = np.arange(len(x)), np.zeros(len(x)), np.zeros(len(x), np.int64)
        # the best filters among combinations of each block's best words, for vectors that exceed few
        some = min(self.words, int(2.5 * self.least ** (1 / len(self.cuts))) + 2)
        high, top = np.zeros((len(x), 1)), np.zeros((len(x), 1), np.int64)
        for s in scores:
            words = np.argsort(-s, axis=1)[:, :some]
            high = (high[:, :, None] + np.take_along_axis(s, words, axis=1)[:, None, :]).reshape(len(x), -1)
            top = (top[:, :, None] * self.words + words[:, None, :]).reshape(len(x), -1)
        top = np.take_along_axis(top, np.argsort(-high, axis=1)[:, : self.least], axis=1)
        for k, s in enumerate(scores):
            rest = sum(best[k + 1 :], np.zeros(len(x)))
            lists = np.argsort(-s, axis=1)
            ranked = np.take_along_axis(s, lists, axis=1)
            need = self.threshold - total - rest[row]
            count = (ranked[row] >= need[:, None]).sum(axis=1) if len(row) else np.zeros(0, np.int64)
            at = np.repeat(np.arange(len(row)), count)
            turn = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
            word = lists[row[at], turn]
            total, name, row = total[at] + ranked[row[at], turn], name[at] * self.words + word, row[at]
        pairs = np.unique(np.stack([np.append(row, np.repeat(np.arange(len(x)), top.shape[1])), np.append(name, top.ravel())], axis=1), axis=0)
        return pairs[:, 0], pairs[:, 1]


def shared_by(code: ProductCode, dim: int, cosine: float, pairs: int, seed: int = 11) -> float:
    """The share of random pairs of unit vectors at that cosine which meet in a filter."""
    rng, met = np.random.default_rng(seed), 0
    for s in range(0, pairs, 500):
        x, z = rng.normal(size=(2, min(500, pairs - s), dim))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        z -= (z * x).sum(axis=1, keepdims=True) * x
        y = cosine * x + np.sqrt(1 - cosine**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
        (i, f), (j, g) = code.decode(x), code.decode(y)
        filters = code.words ** len(code.cuts)
        both = np.isin(i * filters + f, j * filters + g)
        met += len(np.unique(i[both]))
    return met / pairs


@lru_cache(64)
def calibrated(dim: int, vectors: int, cosine: float, recall: float = 0.999, pairs: int = 3000) -> tuple[float, float] | None:
    """(spread, load) of the least work, spread times load, at which ``recall`` of the pairs at ``cosine`` share a filter; None where none tried does, or
    where comparing all pairs is less work than that."""
    for spread, load in sorted(((s, n) for s in SPREADS for n in LOADS), key=lambda t: (t[0] * t[1], t[0])):
        if spread * load > max(vectors, SPREADS[0] * LOADS[0]):
            return None
        code = ProductCode(dim, vectors, spread=spread, load=load)
        if shared_by(code, dim, cosine, 300) >= 0.99 and shared_by(code, dim, cosine, pairs) >= recall:
            return float(spread), float(load)
    return None


def _unit(vectors: list) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _assign(vectors: dict[int, int], chosen: dict[int, tuple[float, float] | None]):
    """Each vector with its filters; ``vectors``: how many there are of each dimension, ``chosen``: its spread and load, None for one filter."""

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes: dict[int, ProductCode] = {}
        for f in frames:
            for dim, same in f.groupby("dim"):
                if chosen[dim] and dim not in codes:
                    codes[dim] = ProductCode(dim, vectors[dim], spread=chosen[dim][0], load=chosen[dim][1])
                for s in range(0, len(same), 512):
                    part = same.iloc[s : s + 512]
                    row, name = codes[dim].decode(_unit(list(part["v"]))) if chosen[dim] else (np.arange(len(part)), np.zeros(len(part), np.int64))
                    lists = np.split(name, np.flatnonzero(np.diff(row)) + 1)
                    yield pd.DataFrame({"dim": dim, "filter": name, "rep": part["rep"].to_numpy()[row], "weight": part["weight"].to_numpy()[row], "v": part["v"].to_numpy()[row], "filters": [lists[r] for r in row]})

    return assign


def _earlier(filters: np.ndarray, name: int) -> np.ndarray:
    """For each vector of a filter the earlier filters that it shares with any other there, as bits."""
    owner = np.repeat(np.arange(len(filters)), [len(x) for x in filters])
    flat = np.concatenate(list(filters))
    before = flat < name
    owner, flat = owner[before], flat[before]
    _, at, count = np.unique(flat, return_inverse=True, return_counts=True)
    owner, at = owner[count[at] > 1], (np.cumsum(count > 1) - 1)[at[count[at] > 1]]
    bits = np.zeros((len(filters), int((count > 1).sum()) // 64 + 1), np.uint64)
    np.bitwise_or.at(bits, (owner, at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
    return bits


def _merge(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the components of each i and j; ``root`` names each member's smallest, before and after."""
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root[:] = root[root]


def _compare(cosine: float):
    def compare(f: pd.DataFrame) -> pd.DataFrame:
        """Links between the group's two parts, or within its one: per vector the weight linked, and a tie to its component's smallest."""
        f = f.sort_values("rep", kind="stable")
        rep, weight, x = f["rep"].to_numpy(), f["weight"].to_numpy(), _unit(list(f["v"]))
        part, low, high = f["part"].to_numpy(), f["low"].iloc[0], f["high"].iloc[0]
        left, right = np.flatnonzero(part == low), np.flatnonzero(part == high)
        shared = _earlier(f["filters"].to_numpy(), int(f["filter"].iloc[0]))
        count, root, columns = np.zeros(len(f), np.int64), np.arange(len(f)), x[right].T
        for s in range(0, len(left), 256):
            a = left[s : s + 256]
            i, j = np.nonzero(x[a] @ columns >= cosine - 1e-9)
            i, j = a[i], right[j]
            if low == high:
                i, j = i[i < j], j[i < j]
            exact = np.concatenate([(x[i[k : k + 65536]] * x[j[k : k + 65536]]).sum(axis=1) >= cosine for k in range(0, len(i), 65536)] or [np.empty(0, bool)])
            i, j = i[exact], j[exact]
            _merge(root, i, j)
            first = ~np.concatenate([(shared[i[k : k + 65536]] & shared[j[k : k + 65536]]).any(axis=1) for k in range(0, len(i), 65536)] or [np.empty(0, bool)])
            i, j = i[first], j[first]
            np.add.at(count, i, weight[j])
            np.add.at(count, j, weight[i])
        some = np.flatnonzero((count > 0) | (root < np.arange(len(f))))
        return pd.DataFrame({"rep": rep[some], "links": count[some], "to": rep[root[some]]})

    return compare


def near_duplicates(embeddings: DataFrame, cosine: float = 0.95, most: int = 3000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept."""
    vector = F.col(vector_col).cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = embeddings.select(F.col(id_col).alias("vec_id"), vector.alias("v")).withColumn("fine", F.coalesce(fine, F.lit(False)))
    alone = F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")
    rows = rows.withColumn("hash", F.xxhash64("v"))
    # distinct vectors, numbered as they are written: several may share a vec_id
    classes = rows.where("fine").groupBy("hash", "v").agg(F.min("vec_id").alias("first"), F.count("*").alias("weight"))
    classes = written(classes.withColumn("rep", F.monotonically_increasing_id()), "vector_classes")
    vectors = {r.dim: r["count"] for r in classes.groupBy(F.size("v").alias("dim")).count().collect()}
    if not vectors:
        return rows.select("vec_id", *alone)
    chosen = {d: calibrated(d, n, cosine) if d >= SMALL else None for d, n in vectors.items()}
    stored = dict(embeddings.dtypes)[vector_col]
    members = classes.select(F.size("v").alias("dim"), "rep", "weight", F.col("v").cast("array<float>").alias("v") if stored == "array<float>" else "v")
    members = written(members.mapInPandas(_assign(vectors, chosen), f"dim int, filter long, rep long, weight long, v {stored}, filters array<long>"), "cap_filters")
    sizes = members.groupBy("dim", "filter").agg(F.count("*").alias("n")).where("n > 1").select("dim", "filter", F.ceil(F.col("n") / most).cast("int").alias("parts"))
    dealt = members.join(sizes, ["dim", "filter"]).withColumn("part", F.pmod(F.xxhash64("rep", "filter"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("low", F.least("part", "other")).withColumn("high", F.greatest("part", "other"))
    found = written(dealt.drop("parts", "other").groupBy("dim", "filter", "low", "high").applyInPandas(_compare(cosine), "rep long, links long, to long"), "vector_links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    label = connected_components(found.select(F.col("rep").alias("a"), F.col("to").alias("b"))).withColumnRenamed("id", "rep")
    # a component's smallest vec_id, copied for a join in which one component may have a third of all classes
    least = label.join(classes.select("rep", "first"), "rep").groupBy("component").agg(F.min("first").alias("component_id"))
    copied = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    placed = label.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int")).join(copied, ["component", "salt"]).select("rep", "component_id")
    named = classes.join(links, "rep", "left").join(placed, "rep", "left")
    named = named.select(F.col("hash").alias("h"), F.col("v").alias("w"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component_id", "first").alias("component_id"))
    out = rows.where("fine").join(named, (F.col("hash") == F.col("h")) & (F.col("v") == F.col("w")))
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    return out.select("vec_id", F.col("n_links").cast("long"), "component_id", kept.alias("kept")).union(rows.where("NOT fine").select("vec_id", *alone))
