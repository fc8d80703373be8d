"""Salvaged items and the pre-check of rulings."""

import json
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from lexigrid.functions import text as T

GOOD = [{"text": "a\"b", "oov": True}, {"text": "çay \\ n", "oov": False}]
WHOLE = json.dumps({"glosses": GOOD}, ensure_ascii=False)


@pytest.mark.parametrize(("raw", "want"), [
    (WHOLE, GOOD), ("Sure!\n" + WHOLE + "\nbye", GOOD), (WHOLE[:-2], GOOD), (WHOLE[:-20], GOOD[:1]), (WHOLE.replace("}, {", "} {"), GOOD), ('{"text":"x","oov":false} {"text": "y"}', [{"text": "x", "oov": False}]),
    ('{"glosses": []}', []), ('{"other": 1}', []), ("", []), (None, []), ("no json", []),
])
def test_salvaged(spark, raw, want):
    got = spark.createDataFrame([(raw,)], "raw string").select(T.salvaged_items(F.col("raw")).alias("x")).first().x
    assert [(r.text, r.oov) for r in got] == [(w["text"], w["oov"]) for w in want]


def test_rulings(spark):
    texts = ["Is it a sin?", "Can we fast", "canine", "May I", "mayi", "HALAL food", "halalness", "is it  ok", "", None, "what is forbidden"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(T.asks_ruling(F.col("t"))).collect()]
    assert got == [bool(re.search(T.RULING, t or "", re.I)) for t in texts] and sum(got) == 5


def plain_norm(text):
    t = "".join(ch for ch in unicodedata.normalize("NFKD", text or "") if not unicodedata.combining(ch))
    t = re.sub(r"(?<=\w)[‘’ʿʾ`](?=\w)|(?<!\w)[‘ʿʾ`](?=\w)", "", t).lower().replace("’", "'")
    t = re.sub(r"(?<=[a-z])'(?=[a-z])", "", re.sub(r"'s\b", "", t))
    return " ".join(re.sub(r"[^a-z0-9\s]", " ", t).split())


def test_norm_en(spark):
    texts = ["Qur’ān", "‘Ā’ishah's Ḥadīth", "ʿUmar ibn al-Khaṭṭāb", "don't", "the Prophet’s a’b’c", "`quoted` ‘x’", "é é ÅÆ ß straße", "ﬀ Ａｂ９", "naïve\tcafé\n ", "", None, "Ṣaḥīḥ al-Bukhārī 1:2", "ʾʿ x", "O'Neil's 'tis"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(T.norm_en(F.col("t"))).collect()]
    want = [plain_norm(t.replace("ﬀ", "") if t else t) for t in texts]  # ligatures of several letters aren't taken apart
    assert got == want
