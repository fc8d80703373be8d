import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrid.llm import url_filter
from lexigrid.llm.embedding_dedup import near_duplicates
from lexigrid.llm.quality import keep_good, quality_scores
from lexigrid.llm.url_filter import URL_SQL, judge_urls

URLS = ["http://Example.COM/en/a", "https://www.example.com/en/x?q#f", "x://a.b.net/es/", "net/es/", None, "http://net/fr/q", "http://com", "http://com?/en/", "http://notexample.com/en/", "://a.com/", "http://A.net/ES/", "http://u:p@x.org/y", "http://www.example.com/e", "a://b://c.com/", "", "http://.com/x", "http://net/fr"]


def plain(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        n = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, tail = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:n]), rest[n:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fits = [(len(h + p), h + p, a) for a, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else "allow")


def test_urls(spark, sf, monkeypatch):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").union(spark.read.parquet(f"{sf}/pages.parquet").selectExpr("page_id + 1000", "url"))
    want = {r.page_id: plain(r.url) for r in pages.collect()}
    assert {r.page_id: tuple(r)[1:] for r in judge_urls(pages).collect()} == want
    with pytest.raises(ValueError, match="most_bytes"):
        judge_urls(pages, most_bytes=1)
    twice = pages.withColumn("key", F.lit(1)).union(pages.withColumn("key", F.lit(2)))
    assert judge_urls(twice).count() == 2 * len(want)
    assert judge_urls(pages.limit(0)).count() == 0
    con = duckdb.connect()
    con.register("pages", pages.toPandas())
    assert {r[0]: tuple(r[1:]) for r in con.execute(URL_SQL).fetchall()} == want


def test_cascade_is_exact_when_first_level_is_coarse(spark, monkeypatch):
    built = []
    level = url_filter.Level
    monkeypatch.setattr(url_filter, "Level", lambda n, rate, number: built.append(1) or level(n, 0.5, number))
    keys = spark.range(3000).selectExpr("xxhash64(id) AS h1", "xxhash64(id, 1) AS h2", "id % 3 = 0 AS listed")
    cascade = url_filter.build_cascade(keys, 1 << 20)
    f = keys.toPandas()
    assert len(built) > 3
    assert (cascade.holds(f.h1.to_numpy().astype(np.uint64), f.h2.to_numpy().astype(np.uint64)) == f.listed.to_numpy()).all()


def brute(rows, cosine=0.95):
    """vec_id -> (n_links, component) for rows with distinct ids."""
    fine = [(i, np.array(v, float)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {i: (0, i) for i, _ in rows}
    ids, x = [i for i, _ in fine], np.array([v / np.sqrt(v @ v) for _, v in fine])
    near = x @ x.T >= cosine
    part = np.arange(len(ids))
    order = np.array(ids)
    while True:
        low = np.array([order[part[near[k]]].min() for k in range(len(ids))])
        new = np.array([ids.index(v) for v in low])
        if (new == part).all():
            break
        part = new
    for k, i in enumerate(ids):
        out[i] = (int(near[k].sum()) - 1, int(order[part[k]]))
    return out


@pytest.mark.parametrize("most", [3000, 7])
def test_vectors_against_brute_force(spark, most):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding")
    rows = [(r.vec_id, list(r.embedding)) for r in table.collect()]
    rng = np.random.default_rng(1)
    for k in range(60):
        v = np.array(rows[k][1])
        rows.append((10_000 + k, (v + rng.normal(size=64) * 0.3 * np.linalg.norm(v) / 8 * rng.uniform(0, 1.3)).astype(np.float32).tolist()))
    rows += [(20_000 + k, rows[3][1]) for k in range(40)]
    rows += [(30_000, None), (30_001, [0.0] * 64), (30_002, [float("nan")] + [1.0] * 63), (30_003, [None] + [1.0] * 63), (30_004, [float("inf")] + [1.0] * 63)]
    got = near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), most=most).collect()
    want = brute(rows)
    found = sum(r.n_links for r in got)
    total = sum(w[0] for w in want.values())
    assert total > 1000 and 0.99 * total <= found <= total
    wrong = [r for r in got if (r.n_links, r.component_id) != want[r.vec_id]]
    assert len(wrong) <= 2 and all(r.kept == (r.vec_id == r.component_id) for r in got) and len(got) == len(rows)


def test_vectors_empty(spark):
    assert near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert near_duplicates(spark.createDataFrame([(1, None), (2, [0.0])], "vec_id long, embedding array<float>")).count() == 2


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    train, test = labels.where("doc_id % 3 <> 0"), labels.where("doc_id % 3 = 0")
    f = quality_scores(docs, train).join(test, "doc_id").toPandas()
    good = (f.quality == 1) & (f.toxic == 0)
    print("kept good", f.kept[good].mean(), "kept toxic", f.kept[f.toxic == 1].mean(), "kept low", f.kept[f.quality == 0].mean())
    assert f.kept[good].mean() > 0.97 and f.kept[f.toxic == 1].mean() < 0.25 and f.kept[f.quality == 0].mean() < 0.1


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, None, None, "x"), (2, "", "s", "en", "y"), (None, "a b", "s", "en", "z")], "doc_id long, text string, source string, lang string, score string")
    labels = spark.createDataFrame([(1, 1, None)], "doc_id long, quality int, toxic int")
    assert keep_good(docs, labels).count() == 3 and keep_good(docs, labels).columns == docs.columns
    assert {r.score for r in quality_scores(docs, labels).collect()} == {0.5}
    assert keep_good(docs.limit(0), labels).count() == 0
