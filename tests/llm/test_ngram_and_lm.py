import random

import numpy as np
import pytest
from reference import language_model, ngram_groups

from lexigrid.llm import language_model as lm
from lexigrid.llm import ngram_join
from lexigrid.llm.components import connected_components


def groups(spark, texts, **kw):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    return {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_groups(docs, **kw).collect()}


def test_components(spark):
    rnd = random.Random(1)
    links = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(220)] + [(1000, 1000 + i) for i in range(1, 50)] + [(2000 + i, 2001 + i) for i in range(40)]
    parent = {x: x for p in links for x in p}
    from reference import find

    for a, b in links:
        x, y = sorted((find(parent, a), find(parent, b)))
        parent[y] = x
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(parent, x) for p in links if p[0] != p[1] for x in p}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_ngram_on_table(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert groups(spark, texts) == ngram_groups(texts)


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_random_edits(spark, seed, monkeypatch):
    rnd, texts = random.Random(seed), {}
    for g in range(12):
        base = [f"w{rnd.randint(0, 400)}" for _ in range(rnd.choice([5, 9, 12, 30, 60, 150, 400]))]
        for i in range(rnd.choice([2, 5, 25])):
            w = list(base)
            for _ in range(rnd.randint(0, max(1, len(w) // 30))):
                w[rnd.randrange(len(w))] = f"n{rnd.randint(0, 10**6)}"
            texts[g * 100 + i] = " ".join(w)
    texts |= {5000: None, 5001: "", 5002: " \n", 5003: "one", 5004: "ONE ", 5005: "a b c", 5006: "a b c d"}
    if seed == 2:
        monkeypatch.setattr(ngram_join, "_boundary", lambda starts: 64)
    assert groups(spark, texts, block_bytes=1500) == ngram_groups(texts)  # some texts are longer than a block


def near_copies(size, seed):
    """Copies of one text with edits around the threshold, most of which no other is linked with, and lines that all share."""
    rnd, texts = random.Random(seed), {}
    base, line = [f"w{rnd.randint(0, 10**6)}" for _ in range(300)], " ".join(f"v{k}" for k in range(40))
    for i in range(size):
        w = list(base)
        for _ in range(rnd.randint(0, 14)):
            w[rnd.randrange(len(w))] = f"n{rnd.randint(0, 10**9)}"
        texts[i] = " ".join(w)
        texts[10_000 + i] = line + " " + " ".join(f"u{rnd.randint(0, 10**9)}" for _ in range(60))
    return texts


def test_ngram_pairs_of_near_copies(spark, monkeypatch):
    """Components as by brute force at two sizes, from few of the group's pairs."""
    made, linked = [], ngram_join._linked

    def noted(pairs, sets, percent):
        made.append(pairs.count())
        return linked(pairs, sets, percent)

    monkeypatch.setattr(ngram_join, "_linked", noted)
    for size in (60, 240):
        texts = near_copies(size, size)
        made.clear()
        assert groups(spark, texts, percent=80) == ngram_groups(texts, percent=80)
        assert sum(made) <= 0.05 * size * (size - 1) / 2


def test_ngram_repeated_and_null_ids(spark):
    rows = [(5, "a b c d e f g", 1), (5, "a b c d e f g", 2), (None, "a b c d e f g", 3), (None, "q", 4), (2, "A B C D E F G", 5), (None, None, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sid int")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in ngram_join.ngram_groups(docs).collect())
    assert got == [(0, 0, 0), (0, 1, 0), (0, 4, 2), (2, 4, 2), (5, 4, 2), (5, 4, 2)]


def test_ngram_empty(spark):
    assert ngram_join.ngram_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def close(got, want):
    assert got.keys() == want.keys()
    for d, w in want.items():
        assert got[d][:4] == w[:4]
        assert abs(got[d][4] - w[4]) < 1e-6 * max(1, -w[4]) and abs(got[d][5] - w[5]) < 1e-6 * max(1, -w[5])


def scores(docs, **kw):
    return {r.doc_id: (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in lm.score_texts(docs, **kw).collect()}


def test_lm_against_dictionaries(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(10**6, None), (10**6 + 1, "")], "doc_id long, text string"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for min_count, depth in ((12, 5), (3, 2), (3, 7)):
        got = scores(docs, min_count=min_count, depth=depth, block_bytes=100_000)
        close(got, language_model(texts, min_count, 4.0, depth))
    held = [g for g in got.values() if g[0]]
    assert sum(g[5] for g in held) > sum(g[4] for g in held)
    assert scores(docs.limit(0)) == {}


def test_lm_on_markov_text(spark):
    rnd, texts = random.Random(3), {}
    follow = {(a, b): rnd.choices("abcdef", k=2) for a in "abcdef" for b in "abcdef"}
    for d in range(60):
        w = ["a", "b"]
        for _ in range(rnd.randint(0, 300)):
            w.append(rnd.choice(follow[w[-2], w[-1]]))
        texts[d] = " ".join(w)
    got = scores(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    close(got, language_model(texts, 12, 4.0))
    held = [g for g in got.values() if g[0]]
    assert sum(g[5] for g in held) > 0.6 * sum(g[4] for g in held)


def test_lm_learns_a_long_passage(spark):
    """In a passage that 40 documents share, words that a short context leaves open are known by a longer one."""
    rnd = random.Random(4)
    passage = " ".join(rnd.choice("abc") for _ in range(60))
    texts = {d: f"{' '.join(rnd.choice('abc') for _ in range(200))} {passage}" for d in range(40)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    by_depth = {depth: scores(docs, depth=depth) for depth in (1, 4, 8)}
    for depth, got in by_depth.items():
        close(got, language_model(texts, 12, 4.0, depth))
    least, some, most = (sum(g[5] for g in by_depth[d].values()) for d in (1, 4, 8))
    assert least < some < most


def test_lm_edges(spark):
    rows = [(1, "a b a b", "x"), (1, "a b a b", "y"), (None, "a b", "z"), (2, None, None), (3, "a b " * 4000, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block string")
    got = lm.score_texts(docs, block_bytes=1000).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == [(0, 3), (1, 5), (1, 5), (2, 1), (3, 8001)]
    assert len({r.score for r in got if r.doc_id == 1}) == 1


def test_lm_counts_of_any_size():
    for x in ([], [0, 255], [0, 256], [2**32 - 1, 1], [2**32, 1]):
        data = lm._narrow(np.array(x, np.int64))
        assert lm._wide(data, len(x)).tolist() == x


def test_blocks_give_back_their_memory(monkeypatch):
    """Rows come one at a time, and what one took is freed before the next."""
    import pyarrow as pa

    from lexigrid.llm import language_model

    seen = []
    monkeypatch.setattr(language_model, "_release", lambda: seen.append("freed"))
    batch = pa.RecordBatch.from_pydict({"block": [1, 2, 3]})
    list(language_model._over(lambda row: seen.append(row["block"]))(iter([batch])))
    assert seen == [1, "freed", 2, "freed", 3, "freed"]
    assert [x.num_rows for x in language_model._few(iter([batch]), 2)] == [2, 1]


def test_lm_asks_in_few_bytes():
    """Sorted keys shrink, contexts before no word told apart carry no sums, and both are read back as they were."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    keys = np.sort(rng.integers(0, 2**64, 50_000, np.uint64))
    counts = rng.integers(0, 3, len(keys)) * (rng.random(len(keys)) < 0.2)
    sums = np.stack([rng.random(len(keys)), counts + 1, counts + 12])
    rows = list(lm._Sent(keys, 16).rows(lm._states(2), 7, counts, sums))
    sent = sum(len(pa.compress(v, "lz4_raw", asbytes=True)) for r in rows for v in r.values() if isinstance(v, bytes))
    assert sent < 9 * len(keys)
    assert np.array_equal(np.concatenate([lm._keys(r["keys"], r["many"]) for r in rows]), keys)
    assert np.array_equal(np.concatenate([lm._wide(r["values"], r["many"]) for r in rows]), counts)
    assert np.array_equal(np.frombuffer(b"".join(r["fit"] for r in rows), "<f8"), sums[0][counts > 0])


def test_lm_run_keys_are_small():
    """Keys of runs are read back as they were, and take less than half of a hash's bytes."""
    rng, bits = np.random.default_rng(6), np.uint64(22)
    context, last = (np.minimum(rng.zipf(1.3, 300_000), 2_000_000).astype(np.uint64) for _ in range(2))
    keys = np.unique(context << bits | last)
    for some in (keys, keys[:1], keys[:0]):
        assert np.array_equal(lm._run_keys(*lm._run_gaps(some, bits), len(some), bits), some)
    assert sum(map(len, lm._run_gaps(keys, bits))) < 3 * len(keys)


class _OneTask:
    get = staticmethod(lambda: _OneTask)
    partitionId = staticmethod(lambda: 0)


@pytest.mark.parametrize("min_count", [1, 3])
def test_lm_saves_what_later_rounds_need(monkeypatch, min_count):
    """Rounds that start from a saved row ask and score as those that start from the words, and the row is smaller."""
    import pandas as pd
    import pyarrow as pa

    monkeypatch.setattr(lm, "TaskContext", _OneTask)
    rnd = random.Random(8)
    texts = [" ".join(rnd.choice("abcdefgh") if rnd.random() < 0.5 else f"w{rnd.randint(0, 5000)}" for _ in range(rnd.randint(0, 80))).encode() for _ in range(600)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.binary())], ["id", "data"])
    rows = [x.to_pylist()[0] for x in lm._pack(20_000)(iter([batch]))]
    tree, answers, penalty, saved = lm.SuffixTree(4, min_count, 4.0, 7, 2, 4), {r["block"]: {} for r in rows}, 0.0, []
    for rounds in range(6):
        asked = [x for r in rows for x in tree(dict(r), answers[r["block"]], rounds)]
        if saved:
            assert [x for r in saved for x in tree(dict(r), answers[r["block"]], rounds)] == asked
        sent = pa.RecordBatch.from_pylist(asked, schema=lm.ASKED).to_pandas()
        got = pd.concat([lm._sum(tree, penalty)(g) for _, g in sent.groupby(["kind", "bucket"])])
        for a in got.to_dict("records"):
            answers[a["block"]].setdefault(a["kind"], {})[a["bucket"]] = a
        if not rounds:
            tree.n, tree.v, tree.bits = int(got.n.sum()), int(got.v.sum()), np.uint64(int(got.numbers.max()).bit_length())
            penalty = float(np.log(tree.n) / 2)
        if rounds == lm.SAVED:
            saved = [tree(dict(r), answers[r["block"]], rounds + 1, save=True) for r in rows]
    for r, s in zip(rows, saved, strict=True):
        assert s["many"] < len(r["tokens"]) / 4
        want, have = tree(dict(r), answers[r["block"]], 6), tree(dict(s), answers[r["block"]], 6)
        assert all(np.allclose(want[k], have[k], rtol=1e-12) for k in want)


def test_lm_drops_what_it_no_longer_reads(spark):
    from lexigrid.llm.shared import database, written_buckets

    def names():
        return {t.name for d in spark.catalog.listDatabases() if d.name.startswith("lexigrid_lm_") and d.name not in before for t in spark.catalog.listTables(d.name)}

    before = {d.name for d in spark.catalog.listDatabases()}
    docs = spark.createDataFrame([(d, "a b c d e " * 20) for d in range(40)], "doc_id long, text string")
    scores(docs)
    assert "state" in names() and not names() & {"blocks", "round0", "round1"}
    home = database(spark, "lm")
    table = written_buckets(docs, "t", "doc_id", 2, home)
    path = table.inputFiles()[0].removeprefix("file://").removeprefix("file:")
    from pathlib import Path

    assert Path(path).exists()
    spark.sql(f"DROP TABLE {home}.t")
    assert not Path(path).exists()
