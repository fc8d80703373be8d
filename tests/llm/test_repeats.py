import random

from reference import repeats

from lexigrid.llm.repeats import difference_cover, remove_repeats, repeat_digest


def check(spark, texts, block_bytes):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeat_digest(docs, block_bytes=block_bytes).collect()}
    assert got == repeats(texts)


def test_cover_has_every_difference():
    v, cover = difference_cover(133)
    assert v == 133 and {(a - b) % v for a in cover for b in cover} == set(range(v))


def test_against_brute_force_on_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeat_digest(docs).collect()}
    assert got == repeats(texts)


def test_against_brute_force_random(spark):
    rnd, texts = random.Random(5), {}
    parts = ["".join(rnd.choice("ab cé") for _ in range(n)) for n in (150, 199, 200, 201, 260, 333, 334, 700, 1500)]
    for i in range(120):
        pick = [rnd.choice(parts) for _ in range(rnd.randint(0, 4))]
        noise = ["".join(rnd.choice("xyz ü") for _ in range(rnd.randint(0, 90))) for _ in pick]
        text = "".join(a + b for a, b in zip(noise, pick))
        cut = rnd.randint(0, 80)
        texts[i] = text[cut:]
    texts |= {1000: None, 1001: "", 1002: "q" * 500, 1003: "q" * 200, 1004: "w" * 201, 1005: "é" * 99 + "x"}
    check(spark, texts, 1000)  # some texts are longer than a block


def test_empty_table_and_pipeline_form(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert repeat_digest(empty).count() == 0
    shared = "".join(random.Random(1).choice("abcdefé ") for _ in range(400))
    docs = spark.createDataFrame([(1, "one " + shared, "x"), (2, "two " + shared + " end", "y"), (2, "two " + shared + " end", "y"), (3, None, "z"), (None, "short", None)], "doc_id long, text string, kept string")
    got = {(r.doc_id, r.text, r.kept) for r in remove_repeats(docs).collect()}
    assert (3, None, "z") in got and (None, "short", None) in got
    assert remove_repeats(docs).count() == 5 and all(len(t or "") < 20 for _, t, _ in got)
