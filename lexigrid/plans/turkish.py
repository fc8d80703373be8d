"""Turkish lookups over whole tables.

Words of the tables are spelled with Turkish letters by a rule, in queries and SQL alike, so that each kind of spelling occurs; readings are made of a word's own
letters.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lexigrid.functions import text as T
from lexigrid.operators import morphology as M
from lexigrid.operators import turkish_lookup as K
from lexigrid.plans.morphology import MORPHS, TR_POS
from lexigrid.plans.text import VOCAB
from lexigrid.registry import query, table
from lexigrid.sources.files import written

_H = "(ascii(w) * 31 + length(w) * 7 + ascii(right(w, 1)) * 17)"
_IN = lambda values: ", ".join(f"'{v}'" for v in values)


def _entry(w: str) -> str:
    return f"CASE WHEN length({w}) % 3 = 0 THEN translate({w}, 'cgisou', 'çğışöü') ELSE {w} END"


def _token(w: str) -> str:
    return f"CASE WHEN length({w}) % 5 = 0 THEN translate({w}, 'a', 'â') ELSE {w} END"


def _fold(w: str) -> str:
    return f"translate({w}, 'âîû', 'aiu')"


def _pairs(name: str) -> str:
    return f"SELECT DISTINCT x[i + 1] AS a, x[i + 2] AS b FROM (SELECT x, unnest(range(len(x) - 1)) AS i FROM (SELECT regexp_extract_all(lower(text), '[a-z]+') AS x FROM {name}))"


TABLES = f"""vw AS (SELECT word AS w FROM ({VOCAB})), bw AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark), dp AS ({_pairs('documents')}), bp AS ({_pairs('benchmark')}),
tok AS (SELECT {_token('w')} AS n FROM vw UNION SELECT {_token('a')} || ' ' || {_token('b')} FROM dp UNION SELECT a || b FROM dp WHERE length(a) % 3 = 0),
ent AS (SELECT {_entry('w')} AS key, length(w) % 4 <> 1 AS stem FROM bw UNION SELECT {_entry('a')} || ' ' || {_entry('b')}, false FROM bp WHERE length(b) % 2 = 0),
syn AS (SELECT {_token('v.w')} AS word, min({_entry('b.w')}) AS entry FROM vw v JOIN bw b ON left(v.w, 3) = left(b.w, 3) AND length(b.w) > 3 WHERE (ascii(v.w) * 31 + length(v.w) * 7 + ascii(right(v.w, 1)) * 17) % 5 = 0 GROUP BY ALL
  UNION SELECT {_entry('a')} || ' ' || {_entry('b')}, {_entry('a')} FROM bp WHERE length(b) % 2 = 1 AND length(a) % 5 = 0),
sp AS (SELECT w, {_token('w')} AS s FROM vw UNION SELECT w, {_entry('w')} FROM bw), rk AS (SELECT w, s, k, {_H} AS h, left(w, greatest(2, length(w) - ({_H} + k) % 3)) AS l FROM sp, (SELECT unnest([0, 1, 2]) AS k) WHERE k < {_H} % 4),
rd AS (SELECT s AS word, k AS n, {_entry('l')} AS lemma, ({TR_POS})[1 + (h + k * 3) % {len(TR_POS)}] AS pos, string_split(({MORPHS})[1 + (h + k * 2) % {len(MORPHS)}], '+') AS ms, (h + k) % 3 = 0 AS proper FROM rk),
r1 AS (SELECT *, len(list_filter(ms, lambda x: x = 'Zero')) AS zero, pos IN ({_IN(M.CLOSED)}) AS closed FROM rd WHERE NOT list_has_any(ms, [{_IN(M.BLOCKING)}])), r2 AS (SELECT * FROM r1 QUALIFY zero = min(zero) OVER (PARTITION BY word)), r3 AS (SELECT * FROM r2 QUALIFY closed OR NOT bool_or(closed) OVER (PARTITION BY word)),
r4 AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY zero, proper, coalesce(list_position([{_IN(M.PLAIN)}], pos), 9), len(ms), n) AS i FROM r3),
lem AS (SELECT word, lemma, row_number() OVER (PARTITION BY word ORDER BY i) AS place FROM (SELECT word, {_fold('lemma')} AS lemma, min(i) AS i FROM r4 GROUP BY ALL)),
keys AS (SELECT key, key AS entry, bool_or(stem) AS stem, {_fold('key')} AS f FROM ent GROUP BY key UNION ALL SELECT word, min(entry), false, {_fold('word')} FROM syn WHERE contains(word, ' ') AND entry IN (SELECT key FROM ent) AND word NOT IN (SELECT key FROM ent) GROUP BY word),
single AS (SELECT * FROM keys WHERE NOT contains(key, ' '))"""

ROUTES = f"""typed AS (SELECT translate(key, '{K.TURKISH}', '{K.TYPED}') AS form, any_value(entry) AS entry FROM single WHERE translate(key, '{K.TURKISH}', '{K.TYPED}') <> key GROUP BY ALL HAVING count(*) = 1),
onely AS (SELECT word, any_value(lemma) AS lemma FROM lem GROUP BY word HAVING count(*) = 1), word AS (SELECT f AS form, arg_min(entry, key) AS entry FROM single GROUP BY f),
ix AS (SELECT 0 AS kind, key AS form, entry FROM keys UNION ALL SELECT 1, form, entry FROM word UNION ALL SELECT 2, form, entry FROM typed WHERE form NOT IN (SELECT key FROM keys)
  UNION ALL SELECT 3, replace(f, ' ', ''), arg_min(entry, key) FROM keys WHERE contains(key, ' ') GROUP BY 2 UNION ALL SELECT 4, form, entry FROM word
  UNION ALL SELECT 4, lemma, arg_min(entry, key) FROM single JOIN onely ON key = word WHERE lemma NOT IN (SELECT form FROM word) GROUP BY lemma
  UNION ALL SELECT 5, {_fold('word')}, arg_min(keys.entry, key) FROM syn JOIN keys ON syn.entry = key WHERE NOT contains(word, ' ') GROUP BY 2),
one AS (SELECT * FROM tok WHERE NOT contains(n, ' ')), two AS (SELECT n, split_part(n, ' ', 1) AS x, split_part(n, ' ', 2) AS y FROM tok WHERE contains(n, ' ')),
fm AS (SELECT n, 0 AS kind, 0 AS place, n AS form FROM tok UNION ALL SELECT n, 1, 0, {_fold('n')} FROM one UNION ALL SELECT n, 2, 0, n FROM one WHERE regexp_full_match(n, '[a-z0-9]+') UNION ALL SELECT n, 3, 0, {_fold('n')} FROM one
  UNION ALL SELECT n, 4, place, lemma FROM one JOIN lem ON n = word UNION ALL SELECT n, 5, 0, {_fold('n')} FROM one UNION ALL SELECT n, 5, 1, lemma FROM one JOIN lem ON n = word WHERE place = 1),
wf AS (SELECT word, {_fold('word')} AS form, 0 AS place FROM (SELECT x AS word FROM two UNION SELECT y FROM two) UNION ALL SELECT word, lemma, place FROM lem),
ph AS (SELECT n, p.place, key, entry FROM two JOIN wf p ON p.word = x JOIN keys ON split_part(f, ' ', 1) = p.form AND contains(key, ' ') WHERE EXISTS (SELECT 1 FROM wf q WHERE q.word = y AND q.form = split_part(keys.f, ' ', 2))),
st AS (SELECT n, min(entry) AS entry FROM one JOIN single ON left({_fold('n')}, 6) = left(f, 6) AND starts_with({_fold('n')}, f) AND length(n) > length(f) AND length(f) >= {K.PREFIX_MIN} AND stem WHERE n NOT IN (SELECT word FROM rd) GROUP BY n HAVING count(DISTINCT entry) = 1),
hit AS (SELECT n, kind, place, '' AS key, entry FROM fm JOIN ix USING (kind, form) UNION ALL SELECT n, 4, place, key, entry FROM ph UNION ALL SELECT n, 6, 0, '', entry FROM st)"""


def _pair_table(spark, sf, name):
    words = T.words(F.col("text"))
    pairs = F.filter(F.arrays_zip(words.alias("a"), F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1))).alias("b")), lambda p: p["b"].isNotNull())
    return table(spark, sf, name).select(F.explode(pairs).alias("p")).select("p.a", "p.b").distinct()


def turkish_tables(spark, sf):
    """(tokens, entries, synonyms, readings) made of the words and word pairs of documents and benchmark."""
    words = lambda name: table(spark, sf, name).select(F.explode(T.words(F.col("text"))).alias("w")).distinct()
    vw, bw, bp = written(words("documents"), "words"), words("benchmark"), _pair_table(spark, sf, "benchmark")
    w, a, b, k = F.col("w"), F.col("a"), F.col("b"), F.col("k")
    h = F.ascii(w) * 31 + F.length(w) * 7 + F.ascii(F.right(w, F.lit(1))) * 17
    entry = lambda x: F.when(F.length(x) % 3 == 0, F.translate(x, "cgisou", "çğışöü")).otherwise(x)
    token = lambda x: F.when(F.length(x) % 5 == 0, F.translate(x, "a", "â")).otherwise(x)
    both = lambda f: F.concat(f(a), F.lit(" "), f(b))
    said = table(spark, sf, "documents").select(T.words(F.col("text")).alias("x"))
    said = said.select(F.explode(F.arrays_zip(F.col("x").alias("a"), F.slice("x", F.lit(2), F.greatest(F.size("x"), F.lit(1))).alias("b"))).alias("p")).select("p.*")  # b is null after the last word
    tokens = said.select(F.explode(F.array(token(a), both(token), F.when(F.length(a) % 3 == 0, F.concat(a, b)))).alias("token")).where("token IS NOT NULL").distinct()
    entries = bw.select(entry(w).alias("key"), (F.length(w) % 4 != 1).alias("stem")).union(bp.where(F.length(b) % 2 == 0).select(both(entry), F.lit(False)))
    meant = bw.where(F.length(w) > 3).groupBy(F.substring(w, 1, 3).alias("start")).agg(F.min(entry(w)).alias("entry"))
    listed = vw.where(h % 5 == 0).withColumn("start", F.substring(w, 1, 3)).join(meant, "start").select(token(w).alias("word"), "entry")
    synonyms = listed.union(bp.where((F.length(b) % 2 == 1) & (F.length(a) % 5 == 0)).select(both(entry), entry(a)))
    spelled = vw.select(w, token(w).alias("s")).union(bw.select(w, entry(w))).distinct()
    some = spelled.select("w", "s", F.explode(F.array(*map(F.lit, range(3)))).alias("k")).where(k < h % 4)
    pick = lambda values, i: F.get(F.array(*map(F.lit, values)), i % len(values))
    lemma = F.substring(w, F.lit(1), F.greatest(F.lit(2), F.length(w) - (h + k) % 3))
    readings = some.select(F.col("s").alias("word"), k.alias("n"), entry(lemma).alias("lemma"), pick(TR_POS, h + k * 3).alias("pos"), pick(MORPHS, h + k * 2).alias("morphs"), ((h + k) % 3 == 0).alias("proper"))
    return tokens, entries, synonyms, readings


@query("j_cascade_tr", f"WITH {TABLES}, {ROUTES} SELECT n AS token, arg_min(entry, (kind, place, key, entry)) AS entry, ({list(K.ROUTES)})[1 + min(kind)] AS route FROM hit GROUP BY n")
def j_cascade_tr(spark, sf):
    """Every word of the documents, every pair of words and pairs written together, against entries of the benchmark's words and pairs."""
    return K.found_signs(*turkish_tables(spark, sf))


@query("j_lemma_index", f"WITH {TABLES}, f AS (SELECT f AS form FROM single), o AS (SELECT word, any_value(lemma) AS lemma FROM lem GROUP BY word HAVING count(*) = 1) SELECT lemma, min(key) AS entry FROM (SELECT f AS lemma, key FROM single UNION ALL SELECT lemma, key FROM single JOIN o ON key = word WHERE lemma NOT IN (SELECT form FROM f)) GROUP BY lemma")
def j_lemma_index(spark, sf):
    """What a lemma stands for: the entry spelled as it, else the entry whose only usable lemma it is."""
    _, entries, synonyms, readings = turkish_tables(spark, sf)
    keys = K.all_keys(entries, synonyms)
    return K.form_index(keys, synonyms, K.folded_lemmas(readings)).where(F.col("kind") == K.LEMMA).select(F.col("form").alias("lemma"), "entry")


@query("j_unique_key", f"WITH {TABLES} SELECT translate(key, '{K.TURKISH}', '{K.TYPED}') AS folded, any_value(entry) AS entry FROM single WHERE translate(key, '{K.TURKISH}', '{K.TYPED}') <> key AND translate(key, '{K.TURKISH}', '{K.TYPED}') NOT IN (SELECT key FROM keys) GROUP BY ALL HAVING count(*) = 1")
def j_unique_key(spark, sf):
    """Entries by what is typed for them without Turkish letters, where that is no entry itself and one entry only is typed so."""
    _, entries, synonyms, readings = turkish_tables(spark, sf)
    keys = K.all_keys(entries, synonyms)
    return K.form_index(keys, synonyms, K.folded_lemmas(readings)).where(F.col("kind") == K.TYPED_KEY).select(F.col("form").alias("folded"), "entry")
