"""Readings of words and endings, over whole tables.  Readings are made of order lines: the part stands for the word."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexigrid.functions import text as T
from lexigrid.operators import morphology as M
from lexigrid.plans.arabic import LATIN
from lexigrid.plans.text import VOCAB
from lexigrid.registry import query, table

POS = ["noun", "verb", "adj", "prep", "noun_num", "noun_quant", "verb"]
_READ = f"SELECT l_partkey // 4 AS word, ({POS})[1 + (l_partkey + CAST(l_quantity AS BIGINT) // 25) % {len(POS)}] AS pos, CASE WHEN l_suppkey % 17 = 0 THEN '' ELSE 'lex' || CAST(l_suppkey % 8 AS VARCHAR) END AS lex, CASE WHEN l_partkey % 9 = 0 THEN -99 ELSE -CAST(round(l_discount * 100) AS BIGINT) END AS lp FROM lineitem"


def _readings(spark, sf):
    line = table(spark, sf, "lineitem")
    pos = F.get(F.array(*map(F.lit, POS)), ((F.col("l_partkey") + F.floor(F.col("l_quantity") / 25)) % len(POS)).cast("int"))
    lex = F.when(F.col("l_suppkey") % 17 == 0, "").otherwise(F.concat(F.lit("lex"), (F.col("l_suppkey") % 8).cast("string")))
    lp = F.when(F.col("l_partkey") % 9 == 0, -99).otherwise(-F.round(F.col("l_discount") * 100).cast("long"))
    return line.select(F.floor(F.col("l_partkey") / 4).alias("word"), pos.alias("pos"), lex.alias("lex"), lp.alias("lp"))


def _in(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


@query("s_lemma_rank", f"""WITH r AS ({_READ}), k AS (SELECT word, bool_or(pos = 'verb') AND NOT bool_or(pos IN ({_in(M.NOMINAL)})) AS gone FROM r GROUP BY word),
b AS (SELECT word, lex, max(lp) AS lp FROM r JOIN k USING (word) WHERE NOT gone AND pos IN ({_in(M.SINGULAR)}) AND lex <> '' GROUP BY word, lex)
SELECT word, lex, CAST(place AS INT) AS place FROM (SELECT word, lex, row_number() OVER (PARTITION BY word ORDER BY lp DESC, lex) AS place FROM b) WHERE place <= 5""")
def s_lemma_rank(spark, sf):
    return M.ranked_lemmas(_readings(spark, sf))


@query("s_morph_lookup", f"""WITH r AS ({_READ}), b AS (SELECT word, max(lp) AS best FROM r GROUP BY word HAVING max(lp) > -99), w AS (SELECT DISTINCT CAST(p_partkey // 2 AS BIGINT) AS word FROM part)
SELECT w.word, coalesce(string_agg(DISTINCT lex, ' ' ORDER BY lex), '') AS lexes, coalesce(bool_or(pos = 'verb'), false) AS verb FROM w LEFT JOIN (SELECT r.* FROM r JOIN b ON r.word = b.word AND lp = best) USING (word) GROUP BY w.word""")
def s_morph_lookup(spark, sf):
    """Every word with the lemmas of its likeliest readings, and whether one of these is a verb."""
    words = table(spark, sf, "part").select(F.floor(F.col("p_partkey") / 2).alias("word")).distinct()
    top = M.likeliest(_readings(spark, sf)).groupBy("word").agg(F.sort_array(F.collect_set("lex")).alias("lexes"), F.max(F.col("pos") == "verb").alias("verb"))  # a word's few readings
    return words.join(top, "word", "left").select("word", F.coalesce(F.array_join("lexes", " "), F.lit("")).alias("lexes"), F.coalesce("verb", F.lit(False)).alias("verb"))


TR_POS = ["Noun", "Verb", "Adj", "Adv", "Conj", "Interj", "Noun", "Noun"]
MORPHS = ["Noun+A3sg", "Verb+Neg+Past", "Noun+Zero+Verb+Pres", "Adj", "Verb+Past+A3sg", "Noun+Without+Adj", "Noun+Zero+Zero+Verb", "Noun+P3sg+Acc", "Verb+Caus"]
_TR = f"SELECT l_partkey // 4 AS word, l_orderkey * 10 + l_linenumber AS n, 'lemma' || CAST(l_suppkey % 6 AS VARCHAR) AS lemma, ({TR_POS})[1 + (l_suppkey * 7 + l_linenumber) % {len(TR_POS)}] AS pos, ({MORPHS})[1 + (l_orderkey + l_linenumber * 3) % {len(MORPHS)}] AS morphs, l_linenumber % 3 = 0 AS proper FROM lineitem"


@query("s_lemma_tr", f"""WITH r AS ({_TR}), m AS (SELECT *, string_split(morphs, '+') AS ms FROM r), k AS (SELECT *, len(list_filter(ms, lambda x: x = 'Zero')) AS zero, pos IN ({_in(M.CLOSED)}) AS closed FROM m WHERE NOT list_has_any(ms, [{_in(M.BLOCKING)}])),
z AS (SELECT * FROM k QUALIFY zero = min(zero) OVER (PARTITION BY word)), c AS (SELECT * FROM z QUALIFY closed OR NOT bool_or(closed) OVER (PARTITION BY word)),
o AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY zero, proper, coalesce(list_position([{_in(M.PLAIN)}], pos), 9), len(ms), n) AS i FROM c),
f AS (SELECT word, lemma, min(i) AS i FROM o GROUP BY word, lemma) SELECT word, lemma, CAST(row_number() OVER (PARTITION BY word ORDER BY i) AS INT) AS place FROM f""")
def s_lemma_tr(spark, sf):
    line = table(spark, sf, "lineitem")
    pick = lambda values, k: F.get(F.array(*map(F.lit, values)), (k % len(values)).cast("int"))
    number = F.col("l_linenumber")
    readings = line.select(
        F.floor(F.col("l_partkey") / 4).alias("word"), (F.col("l_orderkey") * 10 + number).alias("n"), F.concat(F.lit("lemma"), (F.col("l_suppkey") % 6).cast("string")).alias("lemma"),
        pick(TR_POS, F.col("l_suppkey") * 7 + number).alias("pos"), pick(MORPHS, F.col("l_orderkey") + number * 3).alias("morphs"), (number % 3 == 0).alias("proper"),
    )
    return M.usable_lemmas(readings)


_CLASSES = {"A": "[ae]", "I": "[ıiuü]", "D": "[dt]", "C": "[cç]"}
_ENDINGS = "|".join("".join(_CLASSES.get(c, c) for c in e) for e in M.ENDINGS)


@query("s_infl_tr", f"SELECT word, regexp_full_match(substr(word, 4), '({_ENDINGS})*') AS inflected FROM ({VOCAB}) WHERE length(word) >= 3")
def s_infl_tr(spark, sf):
    """Whether what follows a word's first three letters splits into endings."""
    words = table(spark, sf, "documents").select(F.explode(T.words(F.col("text"))).alias("word")).distinct().where("length(word) >= 3")
    return words.select("word", M.is_inflection(F.substring("word", 4, 1_000_000)).alias("inflected"))


URDU = "ابکدےفغہیجکلمںونقرستوےوخیز0123456789"
_UR = f"SELECT DISTINCT translate(word, '{LATIN}', '{URDU}') AS word FROM ({VOCAB})"
_UR_FORMS = ", ".join(f"CASE WHEN ends_with(word, '{s}') AND length(word) - {len(s)} >= 2 THEN left(word, length(word) - {len(s)}) END" for s in T.URDU_ENDINGS)


@query("s_forms_ur", f"SELECT word, array_to_string(list_filter([word, {_UR_FORMS}], lambda x: x IS NOT NULL), ' ') AS forms FROM ({_UR})")
def s_forms_ur(spark, sf):
    """Words of all documents, written with Urdu letters, with what is left without an ending."""
    words = table(spark, sf, "documents").select(F.explode(T.words(F.col("text"))).alias("word")).distinct()
    return words.select(F.translate("word", LATIN, URDU).alias("word")).distinct().select("word", F.array_join(T.forms_ur(F.col("word")), " ").alias("forms"))
