import numpy as np

from lexigrid.llm.media import thumbnail_hash
from lexigrid.llm.queries import op6_media_columns


def test_hash_averages_whole_cells():
    rng = np.random.default_rng(2)
    thumb = rng.integers(0, 256, (800, 900), np.uint8)
    other = thumb.copy()
    keep = np.zeros(thumb.shape, bool)
    keep[np.ix_(np.arange(8) * 100, np.arange(9) * 100)] = True
    other[~keep] = rng.integers(0, 256, int((~keep).sum()), np.uint8)
    assert thumbnail_hash(thumb) != thumbnail_hash(other)
    means = thumb.reshape(8, 100, 9, 100).mean(axis=(1, 3))
    assert thumbnail_hash(thumb) == np.packbits(means[:, 1:] > means[:, :-1]).tobytes().hex()
    for shape in ((1, 1), (3, 4), (8, 9), (9, 64)):
        assert len(thumbnail_hash(np.zeros(shape, np.uint8))) == 16


def test_media_are_stored_before_they_are_read(spark, sf):
    plan = op6_media_columns(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "/media-" in plan
