"""Operators against plain versions on small inputs."""

import random

import pytest
from pyspark.sql import functions as F

from lexigrid.operators import sequences as Q
from lexigrid.operators import series as S
from lexigrid.sources import files


def plain_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def plain_common(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_edits_and_common():
    rng = random.Random(5)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 9))] for _ in range(2))
        assert Q.edits(a, b) == plain_edits(a, b)
        assert Q.common(a, b) == plain_common(a, b)


def test_warped():
    assert Q.warped([1, 2, 3], [1, 2, 3]) == 0
    assert Q.warped([1, 1, 2, 3], [1, 2, 3, 3]) == 0
    assert Q.warped([0, 0], [1, 1]) == pytest.approx(0.5)
    assert Q.warped(range(100), range(100)) == 0


def test_fill_linear_and_runs(spark):
    df = spark.createDataFrame([(1, 0, None), (1, 1, 2.0), (1, 2, None), (1, 3, 6.0), (1, 4, None), (2, 0, None)], "s int, t int, v double")
    got = {(r.s, r.t): r.filled for r in S.fill_linear(df, "v", "t", "s").collect()}
    assert got == {(1, 0): 2.0, (1, 1): 2.0, (1, 2): 4.0, (1, 3): 6.0, (1, 4): 6.0, (2, 0): 0.0}
    runs = S.runs(df, F.col("v").isNotNull(), "s", "t").groupBy("s", "run").count().collect()
    assert sorted((r.s, r.run, r["count"]) for r in runs) == [(1, 1, 1), (1, 2, 1)]


def test_cues(spark):
    text = "WEBVTT\n\n00:01.500 --> 00:02.000\nfirst\n\n01:00:00.000 --> 01:00:01.250\nlast one\n"
    (row,) = spark.createDataFrame([(text,)], "t string").select(files.cues(F.col("t")).alias("c")).collect()
    assert [tuple(x) for x in row.c] == [(1.5, 2.0, "first"), (3600.0, 3601.25, "last one")]


def test_strict_reader_refuses(spark):
    path = files.scratch(spark, "bad")
    spark.createDataFrame([('{"a": 1}',), ("{oops",)], "value string").write.text(path)
    assert files.read_jsonl(spark, path, "a int", strict=False).collect()[0].a == 1
    with pytest.raises(Exception):  # noqa: B017
        files.read_jsonl(spark, path, "a int").collect()
