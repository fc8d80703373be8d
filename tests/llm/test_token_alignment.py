"""Aligned tokens against whole texts and nested loops."""

import itertools
import random

import numpy as np
import pytest
from plain_alignment import align

from lexigrid.llm.token_alignment import NONE, Aligned, Fragment, align_tokens, byte_ranges, differs, pair

SCHEMA = "doc_id long, text string, block long, pairs string, row string"
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = [
    None, "", " ", "  ", "a", "a  b", " x y", "x▁y", "tab\tand\nline\r\n end ", "<|endoftext|> is plain, <s> too </s> <unk> <0x41>", "café à la carte — “quoted”", "nul\x00byte",
    " no break  wide", "你好 世界。", "\U0001f600\U0001f680 rockets", "ﬁne ＡＢ", "é combining", "don't we'll I'm 1234567 3.14", "a" * 300, "السلام عليكم",
]


def made(seed, words):
    rng = random.Random(seed)
    stock = "the of and straße coopération naïve Schlüssel niño über 42 3.5 don't (see) x*** ###y émigré привет κόσμε 你好 ▁ token-ids https://a.b/c?d=e".split()
    stock.remove("▁")
    return "".join(rng.choice(stock) + rng.choice([" ", " ", " ", "\n", "  ", " ", ""]) for _ in range(words))


def got(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


@pytest.mark.parametrize("chunk", [1 << 16, 90, 33])
def test_against_nested_loops(spark, chunk):
    texts = [*ODD, *(made(i, n) for i, n in enumerate([3, 40, 200, 900]))]
    texts += [made(1, 40), texts[-1], made(9, 300) + " x▁y " + made(8, 300)]  # copies, and a long one that the second tokenizer changes
    docs = [(i, t) for i, t in enumerate(texts)] + [(3, "a row of the same id"), (3, "a row of the same id")]
    df = spark.createDataFrame([(i, t, 0, "", "") for i, t in docs], SCHEMA).repartition(3)
    assert got(align_tokens(df, chunk_bytes=chunk)) == align(docs)


def test_empty_table(spark):
    assert got(align_tokens(spark.createDataFrame([], SCHEMA))) == []


def test_documents(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    docs = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect() if len(r.text) < 3000]
    mine = spark.createDataFrame(docs, "doc_id long, text string")
    assert got(align_tokens(mine, chunk_bytes=700)) == align(docs)


def test_ranges_cover_each_text():
    for text in (b" " + made(5, 400).encode(), b" " + b"x" * 5000, b" "):
        ranges = byte_ranges(text, 64)
        assert ranges[0][0] == 0 and ranges[-1][1] == len(text)
        assert all(x[1] == y[0] for x, y in itertools.pairwise(ranges))
        assert all(left <= s and e <= right for s, e, left, right in ranges)


def test_composition_is_associative():
    """Any bracketing gives the same open ends and the same set of closed groups."""
    rng = random.Random(3)

    def some(at):
        part = lambda: np.array([rng.randrange(99) for _ in range(rng.randrange(3))], np.uint16)
        closed = rng.random() < 0.6
        return Fragment(part(), part(), closed, part() if closed else NONE, part() if closed else NONE, at)

    def value(f, groups):
        return [x.tolist() for x in (f.pa, f.pb, f.sa, f.sb)], f.closed, f.at if f.closed else None, sorted((g[0], g[1].tolist(), g[2].tolist()) for g in groups if g)

    for _ in range(200):
        x, y, z = (some(i) for i in range(3))
        xy, g1 = x.then(y)
        left, g2 = xy.then(z)
        yz, g3 = y.then(z)
        right, g4 = x.then(yz)
        assert value(left, [g1, g2]) == value(right, [g3, g4])


def test_vocabulary_is_kept_within_bounds(monkeypatch):
    p = pair("byte_bpe_50k.json", "piece_bpe_32k.model")
    monkeypatch.setattr("lexigrid.llm.token_alignment.MOST_PIECES", 5)
    texts = [b" " + made(i, 30).encode() for i in range(4)]
    one = [p.encode([t]) for t in texts]
    assert all(np.array_equal(x[0][0], y[0][0]) and np.array_equal(x[0][1], y[0][1]) for x, y in zip(one, [p.encode([t]) for t in texts], strict=True))


def test_pieces_that_differ_are_found_at_once():
    rng = random.Random(7)
    pieces, parts, sizes = [], [], []
    for _ in range(500):
        own = [rng.choice([b"a", b"bc", b"\xc3\xa9", b" "]) for _ in range(rng.randrange(4))]
        pieces.append(rng.choice([b"".join(own), b"".join(own)[::-1], b"".join(own) + b"x", b"".join(own)[1:]]))
        parts += own
        sizes.append(len(own))
    joined = [b"".join(parts[e - n : e]) for n, e in zip(sizes, itertools.accumulate(sizes), strict=True)]
    assert differs(pieces, parts, np.array(sizes)).tolist() == [p != j for p, j in zip(pieces, joined, strict=True)]
    assert differs([], [], np.array([], np.int64)).tolist() == []


def test_ends_are_merged_without_hashing(monkeypatch):
    """Stops are the sorted union of both tokenizers' ends; ``np.union1d`` took a third of a second a block."""
    monkeypatch.setattr(np, "union1d", None)
    p = pair("byte_bpe_50k.json", "piece_bpe_32k.model")
    for texts in ([made(i, 60) for i in range(5)], []):
        a, b = ([x for t in p.encode([b" " + t.encode() for t in texts]) for x in [t[k]]] for k in (0, 1)) if texts else ([NONE], [NONE])
        na, nb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
        one = Aligned(p, np.concatenate(a), np.concatenate(b), na, nb)
        assert len(one.links()) == len(one.stops) and one.stops.tolist() == sorted({*one.end_a.tolist(), *one.end_b.tolist()})
