"""Orders without a cap: every row has its own place."""

import pytest

from lexigrid import catalog


@pytest.mark.parametrize(("name", "whole"), [("t_priority_all", None), ("t_sample_order_all", "documents"), ("t_collection_all", "part"), ("t_gloss_len_all", "benchmark")])
def test_every_row_has_a_place(spark, sf, name, whole):
    got = catalog.queries()[name](spark, sf).collect()
    n = spark.read.parquet(f"{sf}/{whole}.parquet").count() if whole else catalog.queries()["u_counter_add"](spark, sf).count()
    assert sorted(r.place for r in got) == list(range(1, len(got) + 1))
    assert len(got) == n if whole else 100 < len(got) <= n
