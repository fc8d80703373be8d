"""Vectors of several dimensions, oversized filters and chains, against all pairs."""

import numpy as np
import pandas as pd
from test_urls_vectors_quality import brute

from lexigrid.llm import embedding_dedup
from lexigrid.llm.embedding_dedup import near_duplicates

SCHEMA = "vec_id long, embedding array<double>"


def found(spark, rows, **kw):
    return {r.vec_id: (r.n_links, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA), **kw).collect()}


def test_each_dimension_is_a_set(spark):
    rng, rows, want = np.random.default_rng(5), [], {}
    for dim, n in ((64, 40), (16, 12), (3, 30), (1, 4)):
        base = rng.normal(size=(n, dim))
        same = [(dim * 1000 + k, v.tolist()) for k, v in enumerate(np.concatenate([base, base[:3]]))]
        rows += same
        want |= brute(same)
    assert found(spark, rows) == want


def test_chain_through_the_largest_id(spark):
    at = lambda degrees: [float(np.cos(np.radians(degrees))), float(np.sin(np.radians(degrees)))]
    rows = [(1, at(0)), (2, at(30)), (3, at(15))]
    assert found(spark, rows) == {1: (1, 1), 2: (1, 1), 3: (2, 1)}


def test_a_task_holds_two_parts(spark, monkeypatch, tmp_path):
    """One tight cluster of unequal vectors: all links, and no group with the whole filter."""
    rng = np.random.default_rng(6)
    rows = [(k, (np.ones(64) + rng.normal(size=64) * 0.05).tolist()) for k in range(150)]
    compare = embedding_dedup._compare

    def noted(cosine):
        plain = compare(cosine)

        def f(group: pd.DataFrame) -> pd.DataFrame:
            with open(f"{tmp_path}/sizes", "a") as out:
                out.write(f"{len(group)}\n")
            return plain(group)

        return f

    monkeypatch.setattr(embedding_dedup, "_compare", noted)
    assert found(spark, rows, most=30) == {k: (149, 0) for k in range(150)}
    assert max(map(int, (tmp_path / "sizes").read_text().split())) <= 2 * 30 * 1.5


def test_repeated_ids_and_other_columns(spark):
    """Rows of one id with different vectors have their own links."""
    rng = np.random.default_rng(8)
    a, b, c = (rng.normal(size=64) for _ in range(3))
    near = lambda v: (v + rng.normal(size=64) * 0.01).tolist()
    rows = [(1, a.tolist(), 5, 0), (1, b.tolist(), 5, 0), (2, near(a), 6, 1), (3, near(b), 6, 1), (None, near(b), 7, 1), (9, c.tolist(), 8, 1), (9, c.tolist(), 8, 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rep long, hash int")
    got = sorted(((r.vec_id or 0), r.n_links, r.component_id, r.kept) for r in near_duplicates(table).collect())
    assert got == [(0, 2, 1, False), (1, 1, 1, True), (1, 2, 1, True), (2, 1, 1, False), (3, 2, 1, False), (9, 1, 9, True), (9, 1, 9, True)]
    lone = spark.createDataFrame([(None, a.tolist()), (None, near(a)), (None, None)], SCHEMA)
    assert sorted((r.n_links, r.component_id, r.kept) for r in near_duplicates(lone).collect()) == [(0, None, True), (1, None, False), (1, None, False)]
