"""Gap cover, complete linkage and support against plain versions."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from lexigrid.operators.cover import gap_cover
from lexigrid.operators.linkage import complete_linkage, merges, near_pairs
from lexigrid.operators.support import Plan, supported_words


def plain_cover(gaps, holds):
    """Word by word, as one would by hand."""
    by_word, chosen, covered, rows = {}, set(), {}, []
    for source, word, p in holds:
        if word in gaps:
            by_word.setdefault(word, {})
            by_word[word][source] = min(p, by_word[word].get(source, p))
    of = {}
    for source, word, _ in holds:
        of.setdefault(source, set()).add(word)
    for word in sorted(by_word, key=lambda w: (-gaps[w], w)):
        if word in covered:
            continue
        best = sorted(by_word[word].items(), key=lambda x: (x[1], x[0]))[:2]
        for choice, (source, _) in enumerate(best, 1):
            if source not in chosen:
                chosen.add(source)
                rows.append([source, word, gaps[word], choice])
        for w in of[best[0][0]] & gaps.keys() - covered.keys():
            covered[w] = best[0][0]
    return sorted((*r, sum(s == r[0] for s in covered.values()), sum(gaps[w] for w, s in covered.items() if s == r[0])) for r in rows)


@pytest.mark.parametrize("seed", range(4))
def test_gap_cover(spark, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    gaps = {w: rng.randrange(1, 6) for w in rng.sample(words, 30)}
    holds = [(s, w, rng.randrange(4)) for s in range(25) for w in rng.sample(words, rng.randrange(7))]
    g = spark.createDataFrame([*gaps.items()], "word string, n long")
    h = spark.createDataFrame([*holds, *holds[:5], (None, None, None)], "source long, word string, p int")
    assert sorted(map(tuple, gap_cover(g, h, [F.col("p")]).collect())) == plain_cover(gaps, holds)


def test_gap_cover_chain(spark):
    """Each word waits for the one before: as many rounds as half the words."""
    gaps = {f"w{i:02}": 100 - i for i in range(12)}
    holds = [(i, f"w{j:02}", 0 if j == i else 1) for i in range(12) for j in (i, i + 1) if j < 12]
    g, h = spark.createDataFrame([*gaps.items()], "word string, n long"), spark.createDataFrame(holds, "source long, word string, p int")
    got = sorted(map(tuple, gap_cover(g, h, [F.col("p")]).collect()))
    assert got == plain_cover(gaps, holds) and sum(r[3] == 1 for r in got) == 6


def test_gap_cover_of_nothing(spark):
    none = spark.createDataFrame([], "word string, n long")
    assert gap_cover(none, spark.createDataFrame([(1, "a", 1)], "source long, word string, p int"), [F.col("p")]).collect() == []


def plain_linkage(ids, d, hard, ratio, base):
    """Over all pairs of clusters, again and again."""
    groups = {i: ([i], 0.0) for i in ids}
    while len(groups) > 1:
        h, x, y = min((max(d[min(i, j), max(i, j)] for i in groups[x][0] for j in groups[y][0]), x, y) for x, y in itertools.combinations(sorted(groups), 2))
        if h > hard or h > ratio * max(groups[x][1], groups[y][1], base):
            break
        groups[x] = (groups[x][0] + groups.pop(y)[0], h)
    return sorted((i, c, len(m), float(s)) for c, (m, s) in groups.items() for i in m)


@pytest.mark.parametrize("whole", [True, False])
def test_linkage(spark, whole):
    """Whole distances make ties."""
    rng, nodes, pairs, want = random.Random(whole), [], [], []
    for item in range(30):
        at = {i: (rng.randrange(20), rng.randrange(4)) if whole else (rng.random() * 20, rng.random() * 4) for i in range(rng.randrange(1, 14))}
        d = {(i, j): float(abs(at[i][0] - at[j][0]) + abs(at[i][1] - at[j][1])) for i, j in itertools.combinations(sorted(at), 2)}
        nodes += [(item, i) for i in at]
        pairs += [(item, j, i, x) for (i, j), x in d.items()]
        want += [(item, *r) for r in plain_linkage(sorted(at), d, 6.0, 1.5, 1.0)]
    got = complete_linkage(spark.createDataFrame(nodes, "item long, id long"), spark.createDataFrame([*pairs, *pairs[:3], (None, None, None, None)], "item long, a long, b long, distance double"), 6.0, 1.5, 1.0)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_linkage_refuses_a_large_component(spark):
    nodes, pairs = spark.createDataFrame([(0, 1), (0, 2), (0, 3)], "item long, id long"), spark.createDataFrame([(0, 1, 2, 1.0), (0, 2, 3, 1.0)], "item long, a long, b long, distance double")
    with pytest.raises(ValueError, match="more than 2"):
        complete_linkage(nodes, pairs, 2.0, 2.0, 1.0, most=2)


def test_merges_stop_at_the_ratio():
    assert merges([1, 3], [2, 4], [1.0, 5.0], 2.0, 1.0) == [(1.0, 1, 2, True), (5.0, 3, 4, False)]


def test_near_pairs(spark):
    rng = random.Random(5)
    rows = [(i % 3, i, round(rng.random() * 30, 2)) for i in range(60)]
    nodes = spark.createDataFrame(rows, "item long, id long, x double")
    got = near_pairs(nodes, F.abs(F.col("a.x") - F.col("b.x")), "x", 2.5)
    want = sorted((p, a, b) for (p, a, x), (q, b, y) in itertools.combinations(rows, 2) if p == q and abs(x - y) <= 2.5)
    assert sorted((r.item, r.a, r.b) for r in got.collect()) == want


def test_planted_word_is_supported(spark):
    """A word whose windows share a vector is accepted, words of noise aren't."""
    rng = random.Random(1)
    noise = lambda: [rng.gauss(0, 1) for _ in range(8)]
    rows, seg = [], 0
    for win in range(300):
        word = win % 6
        for k in range(2):
            vec = [x * 0.01 for x in noise()] if word == 0 and k else noise()
            rows.append((word, win % 17, win, seg, vec))
            seg += 1
    df = spark.createDataFrame([*rows, (None, 1, 1, 999, None)], "word long, grp long, win long, seg long, vec array<double>")
    got = {r.key: r for r in supported_words(df, Plan(trials=10)).collect()}
    assert got["0"].accepted and got["0"].support == 1.0
    assert len(got) == 6 and all(r.support < 0.9 for k, r in got.items() if k != "0")


def test_gap_cover_moves_holdings_once_by_word_and_once_by_source(spark, monkeypatch):
    from lexigrid.operators import cover

    plans, write = {}, cover.written
    monkeypatch.setattr(cover, "written", lambda df, label: (plans.update({label: df._jdf.queryExecution().executedPlan().toString()}), write(df, label))[1])
    g = spark.createDataFrame([("a", 2), ("b", 1)], "word string, n long")
    h = spark.createDataFrame([(1, "a", 1), (1, "c", 1), (2, "b", 1), (None, None, None)], "source long, word string, p int")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = sorted(map(tuple, gap_cover(g, h, [F.col("p")]).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert got == [(1, "a", 2, 1, 1, 2), (2, "b", 1, 1, 1, 1)]
    assert plans["best"].count("Exchange hashpartitioning") == plans["holds"].count("Exchange hashpartitioning") == 2
