"""The co-trained classifier against the same steps over dense matrices, and its edges."""

import random

import numpy as np
import pytest

from lexigrid.llm import quality as q


def test_gaps():
    rows = [np.array(x, np.int64) for x in ([], [0], [65534, 65535, 65536], [5, 2**20 - 1], [0, 65535, 131071, 131072])]
    flat, row = q.from_gaps([q.to_gaps(x) for x in rows])
    assert [flat[row == k].tolist() for k in range(len(rows))] == [x.tolist() for x in rows]
    assert [len(x) for x in q.from_gaps([])] == [0, 0]


def table():
    rnd, out = random.Random(4), []
    for d in range(900):
        good = rnd.random() < 0.6
        words = rnd.choices([f"fine{chr(97 + k)}" for k in range(25)] if good else [f"spam{chr(97 + k)}" for k in range(25)], k=6) + rnd.choices([f"both{chr(97 + k)}" for k in range(25)], k=10)
        out.append((d, " ".join(words), rnd.choice("aab" if good else "bbc"), "en", good))
    out += [(1000 + k, out[0][1], out[0][2], "en", True) for k in range(50)]  # copies
    return out


def plain(rows, labels):
    """Scores by dense matrices: every view a row of ones and zeros."""
    found, keys, ids = [], [], [r[0] for r in rows]
    for _, text, source, lang, *_ in rows:
        t, m = q.text_features(text.encode()), q.meta_features(source, lang, len(text))
        found.append({"text": set(t.tolist()), "meta": set(m.tolist())})
        keys.append((q.to_gaps(t), q.to_gaps(m)))
    dense = {}
    for v in q.VIEWS:
        every = sorted(set().union(*(f[v] for f in found)))
        dense[v] = np.array([[x in f[v] for x in every] for f in found], int)
    first = [k for k in range(len(rows)) if keys.index(keys[k]) == k]
    has = {k: min(labels[ids[j]] for j in range(len(rows)) if keys[j] == keys[k] and ids[j] in labels) for k in first if any(keys[j] == keys[k] and ids[j] in labels for j in range(len(rows)))}
    return dense, keys, first, has


def fit(dense, y, least):
    """Batch steps on the features that tell the classes apart."""
    share, n = y.mean(), len(y)
    on = dense.sum(axis=0)
    up = dense[y == 1].sum(axis=0)
    use = []
    for f in np.flatnonzero(on):
        g = sum(2 * c * np.log(c / (on[f] * s)) for c, s in ((up[f], share), (on[f] - up[f], 1 - share)) if c > 0)
        if g >= least:
            use.append(f)
    x, w, b = dense[:, use].astype(float), np.zeros(len(use)), np.log(share / (1 - share))
    sw, sb = np.full(len(use), 1e-8), 1e-8
    for _ in range(200):
        r = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - y
        grad = x.T @ r + 1e-3 * n * w
        sw, sb = sw + grad**2, sb + r.sum() ** 2
        w, b = w - 0.5 * grad / np.sqrt(sw), b - 0.5 * r.sum() / np.sqrt(sb)
    return use, w, b


@pytest.mark.parametrize("rounds", [0, 2])
def test_against_dense_matrices(spark, rounds):
    rows = table()
    labels = {d: float(good) for d, *_, good in rows if d % 3 == 0 and d < 900}
    docs = spark.createDataFrame([r[:4] for r in rows], "doc_id long, text string, source string, lang string")
    marks = spark.createDataFrame([(d, int(y), 0) for d, y in labels.items()], "doc_id long, quality int, toxic int")
    features = q.found_features(docs)
    model = q.train(features, marks, rounds=rounds, each=20, sure=0.9)
    spark_key = {r.doc_id: r.key for r in features.select("doc_id", "key").collect()}

    dense, keys, first, has = plain(rows, labels)
    order = sorted(has, key=lambda k: spark_key[rows[k][0]])
    held = {k for i, k in enumerate(order) if i % 5 == 4}
    given = {"text": {}, "meta": {}}
    for turn in range(rounds + 1):
        fits = {}
        for view, least in (("text", 12.0), ("meta", 6.0)):
            at = [k for k in order if k not in held] + list(given[view])
            fits[view] = fit(dense[view][at], np.array([has[k] for k in order if k not in held] + list(given[view].values())), least)
        z = {v: dense[v][:, use] @ w + b for v, (use, w, b) in fits.items()}
        if turn < rounds:
            for view, other in (("text", "meta"), ("meta", "text")):
                new = {}
                for label, sign in ((0.0, -1), (1.0, 1)):
                    rest = [k for k in first if k not in has and k not in given[other] and sign * z[view][k] >= np.log(9)]
                    rest.sort(key=lambda k, s=sign, v=view: (-round(s * z[v][k], 9), spark_key[rows[k][0]]))
                    new |= dict.fromkeys(rest[:20], label)
                given[other] |= new
    got = model.logits([k[0] for k in keys], [k[1] for k in keys])
    if rounds == 0:  # ties at the edge of a list may fall either way in later rounds
        assert all(np.allclose(g, z[v], atol=1e-3) for g, v in zip(got, q.VIEWS, strict=True))
    for g, v in zip(got, q.VIEWS, strict=True):
        assert np.corrcoef(g, z[v])[0, 1] > 0.98, (v, g[:9], z[v][:9])
    truth = np.array([r[4] for r in rows])
    assert ((model.scores([k[0] for k in keys], [k[1] for k in keys])["both"] >= 0.5) == truth).mean() > 0.97


def test_clashing_columns_repeats_and_ties(spark):
    docs = spark.createDataFrame([(1, "a b c", "s", "en", 1.0, 2, "k"), (1, "a b c", "s", "en", 1.0, 2, "k"), (2, "d e f", "t", "en", 0.0, 3, "l"), (3, None, None, None, None, None, None)], "doc_id long, text string, source string, lang string, y double, score long, key string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 1, 0), (9, None, 0)], "doc_id long, quality int, toxic int")
    kept = q.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} <= {1, 2, 3}
    scores = q.quality_scores(docs, labels).collect()
    assert sorted(r.doc_id for r in scores) == [1, 1, 2, 3] and len({r.score for r in scores if r.doc_id == 1}) == 1
    assert q.quality_scores(docs.limit(0), labels).count() == 0
