"""Turkish words and phrases, on small tables of entries, synonyms and readings."""

import pytest

from lexigrid.operators.turkish_lookup import found_signs, signs_of_sequences

ENTRIES = ["kitap", "gelmek", "namaz", "namaz kılmak", "peygamber", "renk", "ağız", "iman", "insan", "kul", "inanmak", "mescid", "oruç", "zekât", "gör", "hoş geldin", "ay", "selam", "selamet"]
SYNONYMS = [("resul", "peygamber"), ("mescit", "mescid"), ("kitap", "iman"), ("fitre", "sadaka"), ("sallallahu aleyhi", "selam"), (None, "ay"), ("nebi", None)]
#: word, lemma, part of speech, morphemes
READINGS = [
    ("kitabı", "kitap", "Noun", "Noun+A3sg+Acc"), ("rengi", "renk", "Noun", "Noun+A3sg+Acc"), ("ağzı", "ağız", "Noun", "Noun+A3sg+P3sg"), ("namazı", "namaz", "Noun", "Noun+Acc"), ("kıldı", "kıl", "Verb", "Noun+Zero+Verb+Past"),
    ("kıldı", "kılmak", "Verb", "Verb+Past"), ("kılmak", "kılmak", "Verb", "Verb+Inf1"), ("geldi", "gelmek", "Verb", "Verb+Past"), ("inanmadı", "inanmak", "Verb", "Verb+Neg+Past"), ("imansız", "iman", "Adj", "Noun+Without+Adj"),
    ("kulluk", "kul", "Noun", "Noun+Ness+Noun"), ("resulü", "resul", "Noun", "Noun+Acc"), ("mescitte", "mescit", "Noun", "Noun+Loc"), ("insanlık", "insan", "Noun", "Noun+Ness"), ("insanlar", "insan", "Noun", "Noun+A3pl"),
    ("gör", "görmek", "Verb", "Verb+Imp"), ("gördü", "görmek", "Verb", "Verb+Past"), ("dile", "dil", "Noun", "Noun+Dat"), ("dile", "resul", "Noun", "Noun+Dat+Zero"), ("selametler", "selam", "Noun", "Noun+Ness"),
]
WANT = {
    "kitap": ("kitap", "exact"), "kitabı": ("kitap", "lemma"), "rengi": ("renk", "lemma"), "ağzı": ("ağız", "lemma"), "geldi": ("gelmek", "lemma"), "inanmadı": None, "imansız": None, "kulluk": None, "resulü": ("peygamber", "synonym"),
    "mescitte": ("mescid", "synonym"), "fitre": None, "zekat": ("zekât", "exact"), "ZEKÂT": ("zekât", "exact"), "oruc": ("oruç", "exact"), "namazkılmak": ("namaz kılmak", "compound"), "hoşgeldin": ("hoş geldin", "compound"),
    "insanlık": None, "insanlar": ("insan", "lemma"), "gördü": ("gör", "lemma"), "namaz kılmak": ("namaz kılmak", "exact"), "namazı  kıldı": ("namaz kılmak", "lemma"), "namazı gördü": None, "dile": None,
    "peygamberimizinkiler": ("peygamber", "prefix"), "kitaplıktan": None, "sallallahu aleyhi": ("selam", "exact"), "sallallahualeyhi": ("selam", "compound"), "selametler": None, "resul geldi": None,
}


@pytest.fixture
def tables(spark):
    entries = spark.createDataFrame([(g, True) for g in ENTRIES] + [("kitap", None), ("", True), (None, True)], "key string, stem boolean")
    readings = spark.createDataFrame([(w, i, *r, False) for i, (w, *r) in enumerate(READINGS)], "word string, n int, lemma string, pos string, morphs string, proper boolean")
    return entries, spark.createDataFrame(SYNONYMS, "word string, entry string"), readings


def test_words_and_phrases(spark, tables):
    tokens = spark.createDataFrame([(t, 1) for t in [*WANT, None, "", " ", "kitap", "kitap"]], "token string, entry int")
    rows = found_signs(tokens, *tables).collect()
    got = {r.token: (r.entry, r.route) for r in rows}
    assert {t: got.get(t) for t in WANT} == WANT and len(rows) == len(got) == sum(v is not None for v in WANT.values())


def test_stem_is_taken_only_where_one_fits(spark, tables):
    _, synonyms, readings = tables
    entries = spark.createDataFrame([("selamet", True), ("selametli", True), ("peygamber", False), ("mescid", True), ("zekâtı", True)], "key string, stem boolean")
    tokens = spark.createDataFrame([("selametlik",), ("selametliğe",), ("peygamberler",), ("mescidde",), ("selamet",), ("zekatıyla",)], "token string")
    got = {r.token: (r.entry, r.route) for r in found_signs(tokens, entries, synonyms, readings).collect()}
    assert got == {"mescidde": ("mescid", "prefix"), "selamet": ("selamet", "exact"), "zekatıyla": ("zekâtı", "prefix")}


def test_words_between_the_ends_of_a_phrase(spark, tables):
    _, synonyms, readings = tables
    entries = spark.createDataFrame([("kul namaz kitap selam", True), ("kul insan kitap selam", True), ("kul selam", True)], "key string, stem boolean")
    tokens = spark.createDataFrame([("kul namazı kitabı selam",), ("kul geldi kitabı selam",), ("kul namazı kitabı selam kul",), ("kul insanlar kitap selam",), ("kul kitap selam",)], "token string")
    got = {r.token: (r.entry, r.route) for r in found_signs(tokens, entries, synonyms, readings).collect()}
    assert got == {"kul namazı kitabı selam": ("kul namaz kitap selam", "lemma"), "kul insanlar kitap selam": ("kul insan kitap selam", "lemma")}


def test_tokens_are_not_dealt_anew_for_each_small_index(spark, tables):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = found_signs(spark.createDataFrame([("kitap",)], "token string"), *tables)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("SortMergeJoin") <= 2  # the few tokens that begin with a stem against words with a reading; words between the ends of phrases that were met


def test_sequences_take_phrases_first(spark, tables):
    sequences = spark.createDataFrame([(1, "namazı kıldı ve kitabı".split()), (2, "hoş geldin insanlar".split()), (3, []), (4, None), (5, ["namaz"] * 3), (6, ["namaz", "namaz", "kılmak", None])], "id int, words array<string>")
    got = sorted(tuple(r) for r in signs_of_sequences(sequences, *tables).collect())
    assert got == [
        (1, 0, 2, "namaz kılmak", "lemma"), (1, 3, 1, "kitap", "lemma"), (2, 0, 2, "hoş geldin", "exact"), (2, 2, 1, "insan", "lemma"),
        (5, 0, 1, "namaz", "exact"), (5, 1, 1, "namaz", "exact"), (5, 2, 1, "namaz", "exact"), (6, 0, 1, "namaz", "exact"), (6, 1, 2, "namaz kılmak", "exact"),
    ]


def test_empty_tables(spark, tables):
    none = [t.limit(0) for t in tables]
    tokens = spark.createDataFrame([("kitap",)], "token string")
    assert found_signs(tokens, *none).count() == found_signs(tokens.limit(0), *tables).count() == 0
