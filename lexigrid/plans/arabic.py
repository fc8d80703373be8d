"""Arabic text functions and guards over whole tables.

The tables hold no Arabic letters, so query and SQL alike first write each Latin letter and digit as a fixed Arabic one: ``SPELLED``
uses marks, lengthening, forms of alef and Arabic digits; ``PLAIN`` letters that clitics and endings are made of.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lexigrid.functions import arabic as A
from lexigrid.functions import text as T
from lexigrid.operators import arabic_lookup as K
from lexigrid.operators import guard as G
from lexigrid.operators import morphology as M
from lexigrid.plans.text import VOCAB
from lexigrid.registry import query, table
from lexigrid.sources.files import written

LATIN = "abcdefghijklmnopqrstuvwxyz0123456789"
SPELLED = "أبةدَفئهِجكلمنُؤٱرستـإوآىٰ٠١٢٣٤٥٦٧٨٩"
PLAIN = "ابكديفغهيجكلمنوقصرستوعوخيز0123456789"

_SPELL = f"translate(lower(coalesce(text, '')), '{LATIN}', '{SPELLED}')"
_SPACE = r"[ \t\n\r\f\x0b]+"
_STRIP = f"trim(regexp_replace(regexp_replace({_SPELL}, '[{A.MARKS}]', '', 'g'), '{_SPACE}', ' ', 'g'))"


def _spelled(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.translate(F.lower("text"), LATIN, SPELLED).alias("text"))


@query("s_strip_ar", f"SELECT doc_id, md5({_STRIP}) AS stripped FROM documents")
def s_strip_ar(spark, sf):
    return _spelled(spark, sf).select("doc_id", F.md5(A.strip_marks(F.col("text"))).alias("stripped"))


@query("s_norm_ar", f"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(translate({_STRIP}, '{A.LETTERS}', '{A.FOLDED}'), '[^ء-ي0-9 ]', ' ', 'g'), '{_SPACE}', ' ', 'g'))) AS norm FROM documents")
def s_norm_ar(spark, sf):
    return _spelled(spark, sf).select("doc_id", F.md5(A.norm(F.col("text"))).alias("norm"))


@query("s_spell_ar", f"SELECT doc_id, md5(trim(regexp_replace(replace({_STRIP}, 'ٱ', 'ا'), '[^ء-ي ]', '', 'g'))) AS spelling FROM documents")
def s_spell_ar(spark, sf):
    return _spelled(spark, sf).select("doc_id", F.md5(A.spelling(F.col("text"))).alias("spelling"))


AR_VOCAB = f"SELECT DISTINCT translate(word, '{LATIN}', '{PLAIN}') AS word FROM ({VOCAB})"
_PX = ", ".join(f"('{p}', {k})" for k, p in enumerate(A.PREFIXES))
_SX = ", ".join(f"('{s}', {k})" for k, s in enumerate(A.SUFFIXES))
_VERB = ", ".join(f"'{v}'" for v in A.VERB_PREFIXES)


def stems_sql(words: str) -> str:
    """(word, v, n): the light stems of ``words`` but the word itself, n in the order in which they are found; one step a table."""
    def step(src: str, out: str) -> str:
        return f"""{out} AS (SELECT word, substr(w, length(p) + 1) AS v, true AS pre, n * 100 + o AS n FROM {src}, px WHERE NOT pre AND starts_with(w, p) AND length(w) - length(p) >= 2
 UNION ALL SELECT word, substr(w, 2), true, n * 100 + 20 FROM {src} WHERE NOT pre AND length(w) >= 4 AND left(w, 1) IN ({_VERB})
 UNION ALL SELECT word, left(w, length(w) - length(s)), pre, n * 100 + 30 + o FROM {src}, sx WHERE ends_with(w, s) AND length(w) - length(s) >= 2)"""

    return f"""(WITH px(p, o) AS (VALUES {_PX}), sx(s, o) AS (VALUES {_SX}), s0 AS (SELECT word, word AS w, false AS pre, 0 AS n FROM ({words})),
{step('s0', 'r1')}, d1 AS (SELECT word, v AS w, arg_min(pre, n) AS pre, min(n) AS n FROM r1 GROUP BY word, v), {step('d1', 'r2')}
SELECT word, v, min(n) AS n FROM (SELECT word, w AS v, n FROM d1 UNION ALL SELECT word, v, 1000000 + n FROM r2) GROUP BY word, v)"""


def _vocab(spark, sf):
    return table(spark, sf, "documents").select(F.explode(T.words(F.col("text"))).alias("word")).distinct().select(F.translate("word", LATIN, PLAIN).alias("word")).distinct()


@query("s_cand_ar", f"SELECT w.word, concat_ws(' ', w.word, s.stems) AS candidates FROM ({AR_VOCAB}) w LEFT JOIN (SELECT word, string_agg(v, ' ' ORDER BY length(v) DESC, n) AS stems FROM {stems_sql(AR_VOCAB)} GROUP BY word) s USING (word)")
def s_cand_ar(spark, sf):
    return _vocab(spark, sf).select("word", F.concat_ws(" ", A.light_stems(F.col("word"))).alias("candidates"))


def singulars_sql(forms: str) -> str:
    """(word, f, k): the singulars of the forms (word, f)."""
    return f"""(SELECT word, concat(left(f, length(f) - 3), 'اه') AS s, 1 AS k FROM {forms} WHERE length(f) >= 5 AND ends_with(f, 'وات')
 UNION ALL SELECT word, concat(left(f, length(f) - 2), 'ه'), 2 FROM {forms} WHERE length(f) >= 5 AND ends_with(f, 'ات')
 UNION ALL SELECT word, left(f, length(f) - 2), 3 FROM {forms} WHERE length(f) >= 5 AND (ends_with(f, 'ات') OR ends_with(f, 'ون') OR ends_with(f, 'ين'))
 UNION ALL SELECT word, left(f, length(f) - 1), 4 FROM {forms} WHERE length(f) >= 4 AND ends_with(f, 'ه'))"""


@query("s_sing_ar", f"WITH w AS (SELECT word, word AS f FROM ({AR_VOCAB})) SELECT w.word, coalesce(string_agg(s, ' ' ORDER BY k), '') AS singulars FROM w LEFT JOIN {singulars_sql('w')} x USING (word) GROUP BY w.word")
def s_sing_ar(spark, sf):
    return _vocab(spark, sf).select("word", F.concat_ws(" ", A.singulars(F.col("word"))).alias("singulars"))


@query("s_strict_ar", f"""WITH v AS ({AR_VOCAB}), forms AS (SELECT word, word AS f FROM v UNION ALL SELECT word, v FROM {stems_sql('SELECT * FROM v')} WHERE length(v) >= 3
 UNION ALL SELECT word, left(word, length(word) - 1) FROM v WHERE length(word) >= 4 AND ends_with(word, 'ا')), every AS (SELECT * FROM forms UNION SELECT word, s FROM {singulars_sql('forms')} WHERE length(s) >= 3)
SELECT word, string_agg(f, ' ' ORDER BY f) AS forms FROM every GROUP BY word""")
def s_strict_ar(spark, sf):
    return _vocab(spark, sf).select("word", F.concat_ws(" ", A.strict_forms(F.col("word"))).alias("forms"))


_FOLD = f"list_filter(string_split(trim(regexp_replace(regexp_replace(translate({_STRIP.replace('coalesce(text, ' + chr(39) * 2 + ')', 'replace(coalesce(text, ' + chr(39) * 2 + '), chr(95), chr(32))')}, '{A.LETTERS}', '{A.FOLDED}'), '[^ء-ي0-9 ]', ' ', 'g'), '{_SPACE}', ' ', 'g')), ' '), lambda w: w <> '')"


@query("s_fold_eval", f"SELECT doc_id, CAST(len(w) AS BIGINT) AS n, md5(array_to_string(list_transform(w, lambda x: CASE WHEN length(x) > 3 AND starts_with(x, 'ال') AND x <> 'الله' THEN substr(x, 3) ELSE x END), ' ')) AS folded FROM (SELECT doc_id, {_FOLD} AS w FROM documents)")
def s_fold_eval(spark, sf):
    words = A.fold_words(F.col("text"))
    return _spelled(spark, sf).select("doc_id", F.size(words).cast("long").alias("n"), F.md5(F.array_join(words, " ")).alias("folded"))


_NUMBER_WORDS = [w for words in A.NUMBERS.values() for w in words] + ["كتاب", "واحدون"]


@query("s_num_ar", f"WITH n(word, digits) AS (VALUES {', '.join(f'({chr(39)}{w}{chr(39)}, {chr(39)}{n}{chr(39)})' for n, ws in A.NUMBERS.items() for w in ws)}) SELECT p_partkey, a.word, n.digits FROM (SELECT p_partkey, ({_NUMBER_WORDS})[1 + p_partkey % {len(_NUMBER_WORDS)}] AS word FROM part) a LEFT JOIN n USING (word)")
def s_num_ar(spark, sf):
    """Each part is given one of the number words, or a word that is none."""
    word = F.element_at(F.array(*map(F.lit, _NUMBER_WORDS)), (1 + F.col("p_partkey") % len(_NUMBER_WORDS)).cast("int"))
    return table(spark, sf, "part").select("p_partkey", word.alias("word")).select("p_partkey", "word", A.number(F.col("word")).alias("digits"))


# Words and pairs, as keys, that mark a request for a ruling (D) and a disputed matter (C).
D_WORDS = ("حرام", "حلال", "يحرم", "يجوز", "تجوز", "يحل", "يصح", "افتوني", "افتني", "فتوي", "يفتي")
D_PAIRS = ("ما حكم", "هل علي", "يجب علي", "حكم شرع")
C_WORDS = ("خلاف", "اختلاف", "راجح")
C_PAIRS = ("اختلف علماء", "قول راجح")
#: Words that the turns' words are written as, by their letters; all but the first twelve mean nothing here.
_SAID = ("والحرام", "بالخلاف", "ما", "الحكم", "هل", "علي", "يجب", "اختلف", "العلماء", "القول", "ويجوز", "شرع", "كتاب", "بيت", "الكتاب", "مدرسه", "طالب", "قلم", "الباب", "سماء", "ارض", "والقمر", "شمس", "نهر", "جبل", "بحر", "طريق")
_PICK = f"(ascii(w) * 31 + ascii(right(w, 1)) * 17 + length(w) * 7) % {4 * len(_SAID)}"
_TURNS = f"(SELECT conv_id * 1000 + turn AS id, p, CASE WHEN k < {len(_SAID)} THEN ({list(_SAID)})[1 + k] ELSE 'كتاب' END AS word FROM (SELECT conv_id, turn, p, {_PICK} AS k FROM (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w, generate_subscripts(regexp_extract_all(lower(text), '[a-z]+'), 1) AS p FROM conversations)))"


def _level(phrases: tuple[str, ...]) -> str:
    one = ", ".join(f"('{p}')" for p in phrases if " " not in p)
    two = ", ".join("('{}', '{}')".format(*p.split()) for p in phrases if " " in p)
    return f"SELECT id FROM s WHERE v IN (SELECT * FROM (VALUES {one})) UNION SELECT a.id FROM s a JOIN s b ON a.id = b.id AND b.p = a.p + 1 WHERE (a.v, b.v) IN (SELECT (x, y) FROM (VALUES {two}) t(x, y))"


@query("f_level", f"""WITH t AS {_TURNS}, forms AS (SELECT word, v FROM {stems_sql('SELECT DISTINCT word FROM t')} UNION SELECT word, word FROM t), s AS (SELECT id, p, v FROM t JOIN forms USING (word)), d AS ({_level(D_WORDS + D_PAIRS)}), c AS ({_level(C_WORDS + C_PAIRS)})
SELECT DISTINCT id, CASE WHEN id IN (SELECT id FROM d) THEN 'D' WHEN id IN (SELECT id FROM c) THEN 'C' ELSE 'B' END AS level FROM t""")
def f_level(spark, sf):
    """Each turn's level, by the light stems of its words: D before C, else B."""
    w, said = F.col("w"), F.array(*map(F.lit, _SAID))
    k = (F.ascii(w) * 31 + F.ascii(F.right(w, F.lit(1))) * 17 + F.length(w) * 7) % (4 * len(_SAID))
    each = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.posexplode(T.words(F.col("text"))).alias("pos", "w"))
    tokens = each.select("id", "pos", F.coalesce(F.get(said, k), F.lit("كتاب")).alias("word"))
    levels = G.first_level(tokens, A.light_stems, [("D", [*D_WORDS, *D_PAIRS]), ("C", [*C_WORDS, *C_PAIRS])], "id")
    return levels.select("id", F.coalesce("level", F.lit("B")).alias("level"))


# The lookup's tables: each Latin word stands for a token with final ta (h) and its key; entries are the benchmark's words, every third with the
# article; readings and synonyms are derived from the words' letters.
TOKEN = PLAIN.replace("ه", "ة")
POS = ("noun", "verb", "adj", "prep", "verb", "noun_quant", "verb")
_COUNTED = ["و" + w for ws in A.NUMBERS.values() for w in ws] + ["بال" + A.NUMBERS[5][0], A.NUMBERS[7][1]]
_H = "(ascii(w) * 31 + length(w) * 7 + ascii(right(w, 1)) * 17)"


def _bare_sql(x: str, prefixes: tuple[str, ...], left: int) -> str:
    return "CASE " + " ".join(f"WHEN starts_with({x}, '{p}') AND length({x}) - {len(p)} >= {left} THEN substr({x}, {len(p) + 1})" for p in prefixes) + f" ELSE {x} END"


def _article_sql(x: str) -> str:
    return f"CASE WHEN starts_with({x}, 'ال') THEN substr({x}, 3) ELSE {x} END"


def _key_sql(x: str) -> str:
    return f"translate({x}, 'ةآأإ', 'هااا')"


_NUMBER_ROWS = ", ".join(f"('{w}', '{n}')" for n, ws in A.NUMBERS.items() for w in (*ws, str(n)))
_NUMBER_CASE = " ".join(f"WHEN starts_with(word, '{p}') AND substr(word, {len(p) + 1}) IN (SELECT w FROM num) THEN (SELECT d FROM num WHERE w = substr(word, {len(p) + 1}))" for p in K.NUMBER_PREFIXES)
_ALIAS_ROWS = " UNION ALL ".join(f"SELECT token, word, {i} AS place, substr(word, {len(p) + 1}) AS form FROM lft WHERE starts_with(word, '{p}') AND length(word) - {len(p)} >= 2" for i, p in enumerate(K.ALIAS_PREFIXES, 1))


@query("j_cascade_ar", f"""WITH vw AS (SELECT DISTINCT word AS w FROM ({VOCAB})), bw AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark), num(w, d) AS (VALUES {_NUMBER_ROWS}),
tok AS (SELECT DISTINCT translate(w, '{LATIN}', '{TOKEN}') AS token, translate(w, '{LATIN}', '{PLAIN}') AS word FROM vw UNION SELECT unnest({_COUNTED}), unnest({_COUNTED})),
ent AS (SELECT DISTINCT CASE WHEN length(w) % 3 = 0 THEN 'ال' ELSE '' END || translate(w, '{LATIN}', '{PLAIN}') AS key, CASE WHEN length(w) % 3 = 0 THEN 'ال' ELSE '' END || translate(w, '{LATIN}', '{TOKEN}') AS gloss FROM bw UNION SELECT n::VARCHAR, n::VARCHAR FROM range(1, 10) t(n)),
gl AS (SELECT key, min(gloss) AS gloss FROM ent GROUP BY key),
rd AS (SELECT DISTINCT translate(w, '{LATIN}', '{PLAIN}') AS word, ({list(POS)})[1 + ({_H} + k * 3) % {len(POS)}] AS pos, left(translate(w, '{LATIN}', '{PLAIN}'), greatest(2, length(w) - ({_H} + k) % 3)) AS lex,
  CASE WHEN {_H} % 11 = 0 THEN -99.0 ELSE -(({_H} * (k + 1)) % 7) / 4.0 END AS lp, CASE WHEN ({_H} + k) % 3 = 0 THEN '3ms' ELSE '0' END AS enc FROM (SELECT w FROM vw UNION SELECT w FROM bw), (SELECT unnest([0, 1, 2]) AS k) WHERE k < {_H} % 4),
syn AS (SELECT translate(v.w, '{LATIN}', '{PLAIN}') AS word, min(CASE WHEN length(b.w) % 3 = 0 THEN 'ال' ELSE '' END || translate(b.w, '{LATIN}', '{PLAIN}')) AS key FROM (SELECT w FROM vw WHERE {_H} % 5 = 0) v JOIN bw b ON left(v.w, 3) = left(b.w, 3) AND length(b.w) > 3 GROUP BY 1),
named AS (SELECT word AS form, min(key) AS key FROM syn GROUP BY word), tab AS (SELECT t.form, t.key, gl.gloss FROM (SELECT key AS form, key FROM gl UNION ALL SELECT form, key FROM named WHERE form NOT IN (SELECT key FROM gl)) t JOIN gl USING (key)),
kinds AS (SELECT word, bool_or(pos = 'verb') AS verb, bool_or(pos IN ({', '.join(f"'{p}'" for p in M.NOMINAL)})) AS nominal FROM rd GROUP BY word), verbs AS (SELECT word FROM kinds WHERE verb AND NOT nominal),
lem AS (SELECT word, lex, place FROM (SELECT word, lex, row_number() OVER (PARTITION BY word ORDER BY max(lp) DESC, lex) AS place FROM rd WHERE word NOT IN (SELECT word FROM verbs) AND pos IN ({', '.join(f"'{p}'" for p in M.SINGULAR)}) AND lex <> '' GROUP BY word, lex) WHERE place <= 5),
words AS (SELECT DISTINCT word FROM tok), tan AS (SELECT word, left(word, length(word) - 1) AS t FROM words WHERE length(word) >= 4 AND ends_with(word, 'ا')),
st AS (SELECT word, v, row_number() OVER (PARTITION BY word ORDER BY length(v) DESC, n) AS i FROM {stems_sql('SELECT word FROM words UNION SELECT t FROM tan')}),
stems AS (SELECT word, f, min((g, i)) AS o FROM (SELECT word, word AS f, 0 AS g, 0 AS i FROM words UNION ALL SELECT word, v, 0, i FROM st JOIN words USING (word) UNION ALL SELECT word, t, 1, 0 FROM tan UNION ALL SELECT tan.word, v, 1, i FROM tan JOIN st ON st.word = tan.t) GROUP BY word, f),
own AS (SELECT word, f AS form, o[1] AS g, o[2] AS i, 0 AS k FROM stems WHERE word NOT IN (SELECT word FROM verbs)
  UNION ALL SELECT x.word.w, s, 2, x.word.o[1] * 1000 + x.word.o[2], k FROM {singulars_sql("(SELECT {'w': word, 'o': o} AS word, f FROM stems WHERE word NOT IN (SELECT word FROM verbs))")} x
  UNION ALL SELECT word, lex, 3, place, 0 FROM lem WHERE word IN (SELECT word FROM words)),
forms AS (SELECT word, word AS form, 0 AS g, 0 AS i, 0 AS k, 0 AS art, true AS verb FROM words WHERE word IN (SELECT word FROM verbs) UNION ALL SELECT word, substr(word, 2), 0, 1, 0, 0, true FROM words WHERE word IN (SELECT word FROM verbs) AND starts_with(word, 'و') AND length(word) > 3
  UNION ALL SELECT word, form, g, i, k, 0, false FROM own WHERE form <> '' UNION ALL SELECT word, 'ال' || form, g, i, k, 1, false FROM own WHERE form <> ''
  UNION ALL SELECT word, d, -1, 0, 0, 0, false FROM (SELECT word, CASE {_NUMBER_CASE} ELSE (SELECT d FROM num WHERE w = word) END AS d FROM words) WHERE d IS NOT NULL),
hit AS (SELECT token, word, tab.key, gloss, g, i, k, art, verb, {_article_sql(_key_sql('gloss'))} AS short, {_bare_sql('word', K.GUARD_PREFIXES, 2)} AS rest FROM forms JOIN tok USING (word) JOIN tab USING (form) WHERE art = 0 OR starts_with(gloss, 'ال')),
inside AS (SELECT DISTINCT {_article_sql('key')} AS w FROM gl),
fine AS (SELECT * FROM hit WHERE g = -1 OR verb OR ((length(short) >= 3 OR rest = short OR (rest NOT IN (SELECT w FROM inside) AND (EXISTS (SELECT 1 FROM lem WHERE lem.word = hit.word AND lem.lex = short) OR EXISTS (SELECT 1 FROM lem WHERE lem.word = rest AND lem.lex = short))))
  AND NOT (starts_with({_bare_sql('word', K.GUARD_PREFIXES, 3)}, 'ا') AND NOT starts_with({_bare_sql(_key_sql('gloss'), K.GUARD_PREFIXES, 3)}, 'ا')) AND NOT (ends_with(token, 'ة') AND NOT ends_with({_key_sql('gloss')}, 'ه')))),
fst AS (SELECT token, word, arg_min(key, (g, i, k, art)) AS key, arg_min(gloss, (g, i, k, art)) AS gloss, CASE WHEN min(g) = -1 THEN 0 ELSE 1 END AS route FROM fine GROUP BY token, word),
lik AS (SELECT *, max(lp) OVER (PARTITION BY word) AS best FROM rd), top AS (SELECT word, lex, enc, pos, lp, CASE WHEN pos = 'verb' THEN 'verb' WHEN pos IN ({', '.join(f"'{p}'" for p in M.NOMINAL)}) THEN 'nom' END AS kind FROM lik WHERE lp = best AND best > -99),
agreed AS (SELECT word, min(kind) AS kind, min(lex) AS lex FROM top GROUP BY word HAVING count(DISTINCT (kind, lex)) = 1 AND NOT bool_or(kind IS NULL)),
idx AS (SELECT kind, lex, arg_min(key, (length(key), key)) AS key FROM agreed JOIN gl ON key = word WHERE lex = key GROUP BY kind, lex),
vb AS (SELECT word, min(key) AS vkey FROM lik JOIN idx ON idx.kind = 'verb' AND idx.lex = lik.lex WHERE pos = 'verb' AND best - lp < {K.MARGIN} GROUP BY word HAVING count(DISTINCT key) = 1),
one AS (SELECT token, word, CASE WHEN took AND vkey IS NOT NULL THEN vkey ELSE key END AS entry, CASE WHEN took AND vkey IS NOT NULL THEN 2 ELSE route END AS route FROM (SELECT fst.*, vkey, {_article_sql(_key_sql('gloss'))} <> {_article_sql('fst.word')} AND left(fst.word, 1) IN ('ف', 'و', 'ب', 'ل') AND NOT starts_with({_key_sql('gloss')}, left(fst.word, 1)) AS took FROM fst LEFT JOIN vb ON vb.word = fst.word)),
lft AS (SELECT token, word FROM tok WHERE token NOT IN (SELECT token FROM one)),
ali AS (SELECT token, word, arg_min(key, (place, key)) AS entry FROM (SELECT token, word, 0 AS place, word AS form FROM lft UNION ALL {_ALIAS_ROWS}) JOIN named USING (form) GROUP BY token, word),
ag AS (SELECT top.word, min(key) AS key, list(DISTINCT top.lex) AS lexes, max(lp) AS lp, bool_and(pos <> 'verb' AND enc = '0') AS plain, bool_or(enc <> '0') AS pronoun FROM top LEFT JOIN idx ON idx.kind = top.kind AND idx.lex = top.lex GROUP BY top.word HAVING count(DISTINCT key) = 1 AND NOT bool_or(key IS NULL)),
sure AS (SELECT * FROM ag WHERE NOT EXISTS (SELECT 1 FROM rd WHERE rd.word = ag.word AND rd.lp > -99 AND ((NOT list_contains(ag.lexes, rd.lex) AND ag.lp - rd.lp < {K.MARGIN}) OR (ag.pronoun AND ends_with(ag.word, 'ه') AND rd.enc = '0' AND ends_with(rd.lex, 'ه'))))),
lma AS (SELECT token, lft.word, sure.key AS entry FROM lft JOIN sure USING (word) JOIN gl ON gl.key = sure.key WHERE token NOT IN (SELECT token FROM ali) AND NOT (ends_with(lft.word, 'ا') AND NOT ends_with({_key_sql('gloss')}, 'ا') AND plain) AND NOT (ends_with(token, 'ة') AND NOT ends_with({_key_sql('gloss')}, 'ه')))
SELECT token, entry, ({list(K.ROUTES)})[1 + route] AS route FROM (SELECT token, entry, route FROM one UNION ALL SELECT token, entry, 3 FROM ali UNION ALL SELECT token, entry, 4 FROM lma)""")
def j_cascade_ar(spark, sf):
    """Every word of the documents against entries of the benchmark's words."""
    vw = written(table(spark, sf, "documents").select(F.explode(F.array_distinct(T.words(F.col("text")))).alias("w")).distinct(), "vocabulary")  # read three times
    bw = table(spark, sf, "benchmark").select(F.explode(T.words(F.col("text"))).alias("w")).distinct()
    plain, token, w = F.translate("w", LATIN, PLAIN), F.translate("w", LATIN, TOKEN), F.col("w")
    h = F.ascii(w) * 31 + F.length(w) * 7 + F.ascii(F.right(w, F.lit(1))) * 17
    tokens = vw.select(token.alias("token")).union(spark.range(1).select(F.explode(F.array(*map(F.lit, _COUNTED))).alias("token")))
    article = F.when(F.length(w) % 3 == 0, "ال").otherwise("")
    digits = spark.range(1, 10).select(F.col("id").cast("string").alias("key"), F.col("id").cast("string").alias("gloss"))
    entries = bw.select(F.concat(article, plain).alias("key"), F.concat(article, token).alias("gloss")).distinct().union(digits)
    k = F.col("k")
    some = vw.union(bw).distinct().select("w", F.explode(F.array(*map(F.lit, range(3)))).alias("k")).where(k < h % 4)
    readings = some.select(
        plain.alias("word"), F.get(F.array(*map(F.lit, POS)), (h + k * 3) % len(POS)).alias("pos"), F.substring(plain, F.lit(1), F.greatest(F.lit(2), F.length(w) - (h + k) % 3)).alias("lex"),
        F.when(h % 11 == 0, -99.0).otherwise(-((h * (k + 1)) % 7) / 4.0).alias("lp"), F.when((h + k) % 3 == 0, "3ms").otherwise("0").alias("enc"),
    ).distinct()
    start = lambda d: d.withColumn("start", F.substring("w", 1, 3))
    meant = start(bw.where(F.length(w) > 3)).select("start", F.concat(article, plain).alias("key")).groupBy("start").agg(F.min("key").alias("key"))
    synonyms = start(vw.where(h % 5 == 0)).join(meant, "start").select(plain.alias("word"), "key").distinct()
    return K.found_entries(tokens, entries, synonyms, readings)
