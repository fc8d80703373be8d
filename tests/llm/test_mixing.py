import re

import duckdb

from lexigrid.llm.mixing import MIX_SQL, mix, mix_report


def targets(sizes, weights=(5, 2, 1), share=1.5, limit=2.0):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    budget, out = share * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in out]
        left = budget - sum(out.values())
        over = [s for s in free if left * weight[s] / sum(weight[f] for f in free) > limit * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        out |= {s: limit * sizes[s] for s in over}


def test_against_plain_python(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source")
    docs = docs.union(spark.createDataFrame([(10**6, None, "src3"), (10**6 + 1, "one two", None), (None, "x y z", "Ω"), (7, "", "empty")], docs.schema))
    size = {r: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs.collect()}
    by = {}
    for r, n in size.items():
        by[r.source] = by.get(r.source, 0) + n
    want = targets(by)
    rows = mix_report(docs).collect()
    assert len(rows) == len(size)
    ids = {r.doc_id: r for r in size}
    for r in rows:
        source = ids[r.doc_id].source
        if r.doc_id != 7:
            assert r.size == size[ids[r.doc_id]] and r.source_size == by[source]
            assert abs(r.target - want[source]) < 1e-6 * max(1, want[source])
        assert r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
    again = sorted(map(tuple, mix_report(docs.repartition(3)).collect()), key=str)
    assert sorted(map(tuple, rows), key=str) == again
    total = mix(docs).count()
    copies = sum(r.taken // r.size for r in rows if r.size)
    assert copies <= total <= copies + 4 and mix(docs).columns == docs.columns
    assert mix_report(docs.limit(0)).count() == 0 and mix(docs.limit(0)).count() == 0


def test_sql_twin(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(con.execute(MIX_SQL).fetchall())
    got = sorted(tuple(r) for r in mix_report(spark.read.parquet(f"{sf}/documents.parquet")).collect())
    assert got == want
