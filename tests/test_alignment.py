"""Alignments against all possibilities on small inputs, and the queries that have no SQL."""

import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrid import catalog
from lexigrid.functions import arabic as AR
from lexigrid.functions import text as T
from lexigrid.operators import alignment as A
from lexigrid.operators import evaluation as E
from lexigrid.operators import morphology as M
from lexigrid.operators import sequences as Q
from lexigrid.plans import alignment as plans


def test_label_path_against_all_paths():
    rnd = np.random.default_rng(1)
    for _ in range(60):
        steps, labels = int(rnd.integers(1, 6)), rnd.integers(1, 3, int(rnd.integers(1, 4))).tolist()
        logs = np.log(rnd.dirichlet(np.ones(3), steps))
        best = None
        for path in itertools.product(range(3), repeat=steps):
            said = [k for k, _ in itertools.groupby(path) if k]
            if said == labels:
                best = max(best or -1e9, sum(logs[t, k] for t, k in enumerate(path)))
        got = A.label_path(logs, labels)
        if steps < len(labels):
            assert got is None
        elif best is not None:
            spans, score = got
            assert math.isclose(score, best / steps, rel_tol=1e-9)
            assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:])) and all(s for s in spans)


def test_in_order_against_all_choices():
    rnd = np.random.default_rng(2)
    for _ in range(80):
        terms, runs = int(rnd.integers(1, 4)), int(rnd.integers(1, 6))
        scores = rnd.integers(0, 4, (terms, runs)).astype(float)
        every = [sum(scores[i, j] for i, j in enumerate(c)) for c in itertools.combinations(range(runs), terms)]
        got = A.in_order(scores)
        assert (not every and not got) or (sum(scores[i, j] for i, j in enumerate(got)) == max(every) and got == sorted(set(got)))


def test_warped_against_recursion():
    rnd = random.Random(3)

    def plain(x, y):
        table = {}
        for i, a in enumerate(x):
            for j, b in enumerate(y):
                before = [table[p] for p in ((i - 1, j - 1), (i - 1, j), (i, j - 1)) if p in table]
                table[i, j] = abs(a - b) + (min(before) if before else 0)
        return table[len(x) - 1, len(y) - 1] / (len(x) + len(y))

    for _ in range(40):
        x, y = ([rnd.uniform(-5, 5) for _ in range(rnd.randint(1, 12))] for _ in "xy")
        assert math.isclose(Q.warped(np.array(x), np.array(y)), plain(x, y), rel_tol=1e-9)


def test_overlap_matches(spark):
    rnd = random.Random(4)
    rows = {"g": [], "p": []}
    for side in rows:
        for s in range(6):
            at = 0
            while at < 300:
                at += rnd.randint(1, 9)
                end = at + rnd.choice([0, 1, 3, 40])
                rows[side].append((s, at, end))
                at = end + 1
    want = []
    for s in range(6):
        pairs = []
        for _, a, b in (r for r in rows["g"] if r[0] == s):
            for _, c, d in (r for r in rows["p"] if r[0] == s):
                common = min(b, d) - max(a, c) + 1
                iou = common / (b - a + d - c + 2 - common)
                if iou >= 0.5:
                    pairs.append((iou, a, c))
        used = set()
        for iou, a, c in sorted(pairs, reverse=True):
            if ("a", a) not in used and ("c", c) not in used:
                used |= {("a", a), ("c", c)}
                want.append((s, a, c, round(iou, 9)))
    g, p = (spark.createDataFrame(rows[k], "k long, start long, end long") for k in "gp")
    got = [(r.k, r.gold_start, r.found_start, round(r.iou, 9)) for r in E.overlap_matches(g, p, "k").collect()]
    assert sorted(got) == sorted(want) and len(want) > 20
    with pytest.raises(ValueError):
        E.overlap_matches(g, p, "k", least=0.3)


def test_endings_and_words(spark):
    words = ["ler", "", "lerinden", "xyz", "mişti", "k" * 3000, "e" * 2001, "yorum"]
    some = M.endings()

    def splits(rest):
        ok = [True] + [False] * len(rest)
        for j in range(1, len(rest) + 1):
            ok[j] = any(ok[j - n] and rest[j - n : j] in some for n in range(1, min(7, j) + 1))
        return ok[-1]

    got = {r.w: r.x for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", M.is_inflection(F.col("w")).alias("x")).collect()}
    assert got == {w: splits(w) for w in words}
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(AR.light_stems(F.lit("الوالدين")))[0] == "الوالدين" and "دين" not in one(AR.light_stems(F.lit("الوالدين")))
    assert one(AR.norm(F.lit("أَهْلًا ٣ بِكُم، ok"))) == "اهلا 3 بكم" and one(AR.norm(F.lit(None).cast("string"))) == ""
    assert one(AR.singulars(F.lit("صلوات"))) == ["صلاه", "صلوه", "صلو"] and one(AR.number(F.lit("خمسه"))) == "5"
    assert one(T.candidates_en(F.lit("getting"))) == ["getting", "gett", "gette", "get"]
    assert one(T.candidates_en(F.lit("children"))) == ["children", "child"] and one(T.candidates_en(F.lit("wolves")))[:2] == ["wolves", "wolf"]


def test_cues_in_order(spark):
    docs = spark.createDataFrame([("a b cd a b e",), ("",), ("e cd b a",)], "text string").select(F.filter(F.split("text", " "), lambda x: x != "").alias("w"))
    got = [r.p for r in docs.select(A.found_in_order(F.col("w"), [["a", "b"], ["d"], ["zz"], ["a", "b"], ["b"]]).alias("p")).collect()]
    assert got == [[0, 2, None, 3, None], [None] * 5, [None, 1, None, None, 2]]


def test_nearest_template_query(spark, sf):
    queries = catalog.queries()
    series = {r.user_id: np.array(r.series) for r in plans._series(spark, sf).collect()}
    got = {r.user_id: (r.template, r.distance) for r in queries["j_dtw_nn"](spark, sf).collect()}
    assert got.keys() == series.keys()
    for u, x in series.items():
        d, t = min((Q.warped(x, y), t) for t, y in series.items() if t % 10 == 0)
        assert got[u][0] == t and math.isclose(got[u][1], d, rel_tol=1e-9)


def test_nearest_of_values_that_all_series_have():
    """Ranges say nothing here; bounds in whole numbers part nearly all pairs, whatever the values' size, and the nearest is the first of equals."""
    rnd, warped = np.random.default_rng(3), []
    n, m = rnd.integers(1, 33, 12), rnd.integers(20, 33, 400)
    x, y = (np.where(np.arange(32) < k[:, None], rnd.exponential(30, (len(k), 32)).round(2), 0) for k in (n, m))
    x[3, : n[3]], x[5], n[5] = 4.0, y[7], m[7]
    y[200], m[200] = y[7], m[7]
    count = A.warped_pairs
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(A, "warped_pairs", lambda a, *rest: (warped.append(len(a)), count(a, *rest))[1])
        for move, scale in ((0.0, 1.0), (1e12, 1e-3), (-5e3, 1e6)):
            p, q = (np.where(np.arange(32) < k[:, None], s * scale + move, 0) for s, k in ((x, n), (y, m)))
            best, which = A.least_warped(p, n, q, m)
            for i in range(12):
                d = count(np.repeat(p[i : i + 1], 400, 0), np.repeat(n[i], 400), q, m)
                assert (best[i], which[i]) == (d.min(), d.argmin())
            assert move == 1e12 or sum(warped) < 0.5 * 12 * 400
            warped.clear()
    assert which[5] == 7


def test_warped_pairs_are_the_same_to_the_last_bit():
    rnd = np.random.default_rng(9)
    n, m = rnd.integers(1, 33, 200), rnd.integers(1, 33, 200)
    x, y = rnd.exponential(30, (200, 32)), rnd.exponential(30, (200, 32))
    assert Q.warped_pairs(x, n, y, m).tolist() == [Q.warped(x[k, : n[k]], y[k, : m[k]]) for k in range(200)]


def test_nearest_template_of_copies_and_odd_series(spark):
    rnd = random.Random(5)
    some = [[float(rnd.randrange(5)) for _ in range(rnd.choice([1, 2, 5, 40]))] for _ in range(30)] + [[], [float("nan"), 1.0]]
    series, templates = [(i, some[i % 32]) for i in range(96)], [(200 - i, some[(7 * i) % 32]) for i in range(40)]
    s, t = spark.createDataFrame(series, "u long, series array<double>"), spark.createDataFrame(templates, "t long, series array<double>")
    got = {r.u: (r.t, r.distance) for r in A.nearest_template(s, t, "u", "t", block=8).collect()}
    key = lambda d, name: (True, 0, name) if d is None or math.isnan(d) else (False, d, name)
    want = {u: min(key(Q.warped(np.array(x), np.array(y)), name) for name, y in templates) for u, x in series}
    assert {u: key(d, t) for u, (t, d) in got.items()} == want


def test_equal_series_are_warped_once(spark):
    """A thousand copies of a few series cost what the few cost: the pairs that reach a task are those of distinct ones."""
    rows = spark.range(2000).select(F.col("id").alias("u"), F.array(*[(F.col("id") % 4 + k).cast("double") for k in range(8)]).alias("points"))
    assert A.distinct_points(rows, "u", "points").count() == 4
    got = A.nearest_template(rows.withColumnRenamed("points", "series"), rows.select(F.col("u").alias("t"), F.col("points").alias("series")), "u", "t").collect()
    assert len(got) == 2000 and all(r.t == r.u % 4 and r.distance == 0 for r in got)


def test_run_counts_against_slices():
    rnd = random.Random(6)
    for _ in range(60):
        x, y = ([rnd.choice("abc") for _ in range(rnd.randrange(12))] for _ in "xy")
        for of in (list, "".join):
            want = []
            for n in range(1, 7):
                a, b = ([tuple(s[i : i + n]) for i in range(len(s) - n + 1)] for s in (x, y))
                want.append((len(a), len(b), sum(min(a.count(r), b.count(r)) for r in set(a))))
            assert E.run_counts(of(x), of(y), 6) == want


def test_clipped_counts_send_no_runs(spark):
    pairs = spark.createDataFrame([(["a", "b", "a"], ["a", "b"]), ([], ["c"])], "h array<string>, r array<string>")
    df = E.clipped_counts(pairs, F.col("h"), F.col("r"), 3)
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1  # of the sums by n
    assert sorted(map(tuple, df.collect())) == [(1, 3, 3, 2), (2, 2, 1, 1), (3, 1, 0, 0)]


def test_split_by_crc(spark, sf):
    got = {r.doc_id: r.split for r in catalog.queries()["s_crc_split"](spark, sf).collect()}
    assert got == {d: {0: "test", 1: "val"}.get(zlib.crc32(str(d).encode()) % 10, "train") for d in got} and len(got) == 200


def test_bootstrap_interval(spark):
    sf = "/root/testdata/sf0.01"
    (r,) = catalog.queries()["a_bootstrap"](spark, sf).collect()
    y = np.array([x.quality for x in spark.read.parquet(f"{sf}/labels.parquet").collect()])
    half = 1.96 * y.std() / np.sqrt(len(y))
    assert abs(r.low - (y.mean() - half)) < 0.2 * half and abs(r.high - (y.mean() + half)) < 0.2 * half
    assert [r] == catalog.queries()["a_bootstrap"](spark, sf).collect()


def test_greedy_phrases_against_a_scan(spark, sf):
    from collections import Counter

    import re

    words = lambda t: re.findall("[a-z]+", (t or "").lower())
    runs = lambda w, n: [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)]
    bench = [words(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    phrases = {n: {p for p, c in Counter(x for w in bench for x in runs(w, n)).items() if c >= 2} for n in (3, 2)}
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        w, i, found = words(r.text), 0, []
        while i < len(w):
            n = next((n for n in (3, 2) if i + n <= len(w) and " ".join(w[i : i + n]) in phrases[n]), 0)
            if n:
                found.append(" ".join(w[i : i + n]))
            i += n or 1
        if found:
            want[r.doc_id] = "|".join(found)
    assert {r.doc_id: r.phrases for r in catalog.queries()["j_phrase_greedy"](spark, sf).collect()} == want
