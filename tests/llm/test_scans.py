"""Licence scan and source divergence: their SQL, plain versions on odd rows, bounds."""

import re
from collections import Counter

import duckdb
import pytest

from lexigrid.llm.divergence import DIVERGENCE_SQL, divergence
from lexigrid.llm.licenses import NOTICES, license_spans, license_sql, scan_licenses

SCHEMA = "doc_id long, text string, lang string, source string, row string, part string, t int, rank int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1, 2) for r in rows], SCHEMA).repartition(3)


def by_sql(sql, rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    if rows:
        con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", rows)
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    return sorted((tuple(r[names.index(n)] for n in sorted(names)) for r in got.fetchall()), key=repr)


def mine(df):
    return sorted((tuple(r[n] for n in sorted(df.columns)) for r in df.collect()), key=repr)


MIT = NOTICES[1][0]
LICENSED = [
    "Released under the MIT License.", "the MIT\n\nlicense; mit-license MIT LICENSES", "GNU  General Public License, gnu general public license", "CC BY-NC 4.0 and cc by", "CC-BY", "ccby", "",
    None, " . ", "MIT Lićense", "apache", "apache license", MIT, MIT.upper() + "!", MIT.replace("software", "program", 1), "x " + MIT.replace("without restriction", "without any such restriction at all") + " y",
    " ".join(MIT.split()[::2]), " ".join(MIT.split()[:30]), MIT + " " + MIT, "mit license " * 500, "ﬁ license 许可 mit license",
]


def test_licenses(spark):
    rows = [(i, t, "en", "s") for i, t in enumerate(LICENSED)] + [(3, LICENSED[3], "en", "s"), (None, "mit license", None, None)]
    got = mine(scan_licenses(frame(spark, rows)))
    assert got == by_sql(license_sql(), rows)
    by_id = {r.doc_id: r for r in scan_licenses(frame(spark, rows)).collect()}
    assert by_id[1].n_base == 2 and (by_id[1].first_word, by_id[1].last_word) == (1, 3)
    assert by_id[19].n_base == 500 and by_id[19].last_word == 998
    assert [by_id[k].labels for k in (12, 13, 14, 15)] == ["mit"] * 4 and by_id[12].score == 1.0 and 0.6 < by_id[15].score < 1.0
    assert by_id[16].labels == by_id[17].labels == "" and by_id[18].labels == "mit"
    for r in by_id.values():  # places of base phrases by a plain search
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), (dict(enumerate(LICENSED)) | {None: "mit license"})[r.doc_id] or ""))
        places = [i for p in ("gnu general public license", "apache license", "cc by", "mit license") for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(places), min(places, default=None), max(places, default=None))


def test_spans_of_two_copies(spark):
    spans = [r for r in license_spans(frame(spark, [(1, MIT + " and then " + MIT, "", "")])).collect() if r.label == "mit"]
    n = len(MIT.split())
    assert sorted((r.first, r.last) for r in spans) == [(0, n - 1), (n + 2, 2 * n + 1)]


def test_licenses_of_no_documents(spark):
    assert scan_licenses(frame(spark, [])).collect() == []


def texts():
    rows = []
    for i in range(40):
        rows.append((i, f"The Common word{'s' if i % 2 else ''} ÄÖ äö common x{i} 9 don't " + "Rare " * (i % 3), "en", f"s{i % 3}"))
        rows.append((100 + i, "der DIE das" + " nur" * (i > 9), "de", None if i % 2 else "é"))
        rows.append((200 + i, "few " * 50, ["fr", None][i % 2], "one"))  # often, but in too few documents each
    return rows + [(900, None, "en", "empty"), (901, "", None, None), (902, "solo", "it", "a"), (903, "solo", "it", "b"), (0, rows[0][1], "en", "s0")]


@pytest.mark.parametrize("size", [1 << 20, 150])
def test_divergence(spark, size):
    got = mine(divergence(frame(spark, texts()), vocabulary_bytes=size))
    assert got == by_sql(DIVERGENCE_SQL, texts()) and {r[2] for r in got} == {"pair", "term"}


def test_divergence_by_hand(spark):
    """Dense dictionaries instead of sparse sums."""
    rows, want = texts(), []
    words = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    for lang in {r[2] or "" for r in rows}:
        own = [(r[3] or "", words(r[1])) for r in rows if (r[2] or "") == lang]
        df = Counter(w for _, t in own for w in set(t))
        kept = {w for w in df if df[w] >= 30}
        count = {s: Counter(w for z, t in own if z == s for w in t if w in kept) for s in {s for s, _ in own}}
        p = {s: {w: 1 + 10**9 * (c[w] + 5) // (sum(c.values()) + 5 * len(kept)) for w in kept} for s, c in count.items()}
        total = sum(count.values(), Counter())
        q = {w: 1 + 10**9 * (total[w] + 5) // (sum(total.values()) + 5 * len(kept)) for w in kept}
        for s in count:
            pairs = sorted((-sum(abs(p[s][w] - p[z][w]) for w in kept), z.encode(), z) for z in count if z != s)
            terms = sorted((q[w] - p[s][w], w.encode(), w) for w in kept if count[s][w] and p[s][w] > q[w])[:50]
            want += [(x[2], lang, part, i, s, -x[0]) for part, some in (("pair", pairs), ("term", terms)) for i, x in enumerate(some, 1)]
    assert mine(divergence(frame(spark, rows))) == sorted(want, key=repr)


def test_divergence_of_little(spark):
    assert divergence(frame(spark, [])).collect() == []
    assert mine(divergence(frame(spark, [(1, "a", "x", "s"), (2, "b", "x", "t")]))) == [("s", "x", "pair", 1, "t", 0), ("t", "x", "pair", 1, "s", 0)]
    with pytest.raises(ValueError, match="more than 2 languages"):
        divergence(frame(spark, [(i, "a", f"l{i}", "s") for i in range(3)]), most_langs=2)


def test_divergence_writes_no_vectors_of_documents(spark):
    """What the vectorizers give is summed by group before it is written, so copies of documents add no rows."""
    from lexigrid.llm import divergence as d

    rows = [(i, " ".join(["aa", "bb", "aa"][: i % 4]), "x", f"s{i % 2}") for i in range(400)]
    terms, _ = d._term_table(frame(spark, rows), 10)
    summed, vocabulary = d.group_vectors(spark, terms, {0: 2}, 30)
    names = {(r.slice, r.place): r.term for r in vocabulary.collect()}
    got = sorted((r.source, names[r.slice, r.place], r.n_term) for r in summed.collect())
    assert got == [("s0", "aa", 100), ("s0", "bb", 100), ("s1", "aa", 300), ("s1", "bb", 100)]


def test_divergence_counts_documents_once(spark):
    """Kept terms are found once for all vectorizers, which learn from them alone: a term that occurs often in few documents is none."""
    from lexigrid.llm import divergence as d

    terms, langs = d._term_table(frame(spark, texts()), 10)
    kept, slices = d.kept_terms(terms, 30, 100)
    got = sorted((langs[r.lang_no], r.term) for r in kept.collect())
    assert got == sorted([("de", x) for x in ("das", "der", "die", "nur")] + [("en", x) for x in ("common", "don", "t", "the", "x", "\u00c4\u00d6", "\u00e4\u00f6")])
    assert set(slices) == {langs.index("de"), langs.index("en")} and min(slices.values()) > 1
    _, vocabulary = d.group_vectors(spark, terms, slices, 30, kept)
    assert sorted((langs[r.lang_no], r.term) for r in vocabulary.collect()) == got
