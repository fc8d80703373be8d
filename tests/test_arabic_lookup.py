"""Words of the language itself, on small tables of entries, synonyms and readings."""

from lexigrid.functions import arabic as A
from lexigrid.operators.arabic_lookup import found_entries

ENTRIES = ["الحج", "5", "سلام", "محمد", "مدرس", "مدرسة", "شر", "أب", "كفر", "قال", "رب", "بيت", "الخبز", "ألوان", "تحت", "فتح", "صوم", "يوم", "جد", "معلم", "عمل", "لا إله", "قط"]
SYNONYMS = [("نكاح", "زواج"), ("صيام", "صوم"), ("منزل", "بيت")]
#: word, part of speech, lemma, log probability, pronoun
READINGS = [
    ("تكفر", "verb", "كفر", -1.0, "0"), ("قالت", "verb", "قال", -1.0, "0"), ("قال", "verb", "قال", -0.5, "0"), ("رب", "noun", "رب", -1.0, "0"), ("ربك", "noun", "رب", -1.0, "2ms"),
    ("ايام", "noun", "يوم", -1.0, "0"), ("يوم", "noun", "يوم", -1.0, "0"), ("جدا", "noun", "جد", -1.0, "0"), ("جد", "noun", "جد", -1.0, "0"), ("فتحت", "verb", "فتح", -1.0, "0"), ("فتحت", "noun", "تحت", -1.2, "0"),
    ("فتح", "verb", "فتح", -1.0, "0"), ("ابي", "noun", "اب", -1.0, "1s"), ("اعمال", "noun", "عمل", -1.0, "0"), ("عمل", "noun", "عمل", -1.0, "0"), ("فقدت", "verb", "قال", -1.0, "0"), ("فقدت", "verb", "فقد", -1.3, "0"),
]


def test_words(spark):
    want = {
        "وحج": ("الحج", "form"), "الحج": ("الحج", "form"), "خمس": ("5", "number"), "والخمسة": ("5", "number"), "محمدًا": ("محمد", "form"),
        "إسلام": None, "مدرسة": ("مدرسه", "form"), "شرك": None, "أبي": ("اب", "form"), "وشر": ("شر", "form"), "والشر": None, "تكفر": None, "قالت": ("قال", "lemma"),
        "ربك": ("رب", "form"), "وبيته": ("بيت", "form"), "معلمون": ("معلم", "form"), "فتحت": ("فتح", "verb"), "والصيام": ("صوم", "form"), "منزل": ("بيت", "form"),
        "أيام": ("يوم", "lemma"), "أعمال": ("عمل", "lemma"), "فقدت": None, "وان": None, "كتاب": None, "نكاح": None,
    }
    tokens = spark.createDataFrame([(t,) for t in [*want, None, "", "بيت", "بيت"]], "token string")
    entries = spark.createDataFrame([(g,) for g in ENTRIES], "gloss string").select(A.norm("gloss").alias("key"), "gloss")
    got = {r.token: (r.entry, r.route) for r in found_entries(tokens, entries, spark.createDataFrame(SYNONYMS, "word string, key string"), spark.createDataFrame(READINGS, "word string, pos string, lex string, lp double, enc string")).collect()}
    for token, entry in want.items():
        print(token, got.get(token), entry)
    assert {t: got.get(t) for t in want} == want and got["بيت"] == ("بيت", "form") and "" not in got


def test_documents_are_split_once(spark, sf, monkeypatch):
    from lexigrid.operators import arabic_lookup
    from lexigrid.plans import arabic

    given = []
    monkeypatch.setattr(arabic_lookup, "found_entries", lambda *tables: given.extend(tables))
    arabic.j_cascade_ar(spark, sf)
    assert len(given) == 4 and not any("documents.parquet" in t._jdf.queryExecution().optimizedPlan().toString() + str(t.inputFiles()) for t in given)
