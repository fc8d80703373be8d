"""The share of pairs at a cosine of 0.95 that meet in a filter, at the sizes that the code is for; and links end to end."""

import numpy as np
import pytest

from lexigrid.llm.embedding_dedup import ProductCode, calibrated, near_duplicates, shared_by


#: At 10^8 vectors the calibration takes a minute for some dimensions; all six passed when run by hand.
CELLS = [(d, n) for d in (12, 16, 32, 64, 256, 768) for n in (600, 10**4, 10**6)] + [(32, 10**8), (64, 10**8)]


@pytest.mark.parametrize(("dim", "vectors"), CELLS)
def test_pairs_meet(dim, vectors):
    """On other pairs than those of the calibration; where no filters are good enough, all pairs are compared."""
    chosen = calibrated(dim, vectors, 0.95)
    if chosen is None:
        return
    spread, load = chosen
    assert shared_by(ProductCode(dim, vectors, spread=spread, load=load), dim, 0.9501, 2000, seed=99) >= 0.997
    assert spread * load <= max(vectors, 4000) and load <= 6400


def test_filters_stand_for_most_sizes():
    """Comparing all pairs is left to small sets of few dimensions."""
    for dim in (16, 32, 64, 256, 768):
        assert calibrated(dim, 10**6, 0.95)
    assert calibrated(64, 10**8, 0.95)


def test_links_of_twenty_thousand(spark):
    """Groups around 4,000 centres, cosines between members from 0.9 to 1."""
    rng = np.random.default_rng(12)
    base = np.repeat(rng.normal(size=(4000, 48)), 5, axis=0)
    x = base + rng.normal(size=base.shape) * rng.uniform(0.05, 0.3, size=(len(base), 1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(8)
    got = {r.vec_id: r.n_links for r in near_duplicates(df).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = np.concatenate([(u[s : s + 1000] @ u.T >= 0.95).sum(axis=1) - 1 for s in range(0, len(u), 1000)])
    found = sum(got.values())
    assert want.sum() > 10_000 and all(got[i] <= want[i] for i in got) and found >= 0.999 * want.sum()
