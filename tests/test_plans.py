"""What the optimizer makes of some plans."""

import contextlib
import io

from lexigrid import catalog


def shown(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_stems_are_found_for_distinct_words(spark, sf):
    """The forms of f_level are computed above the aggregate that makes words distinct, in no filter below it."""
    df = catalog.queries()["f_level"](spark, sf)
    tree = df._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in tree.splitlines() if "Filter" in line and len(line) > 5000]
