"""Scalar text functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexigrid.functions import text as T
from lexigrid.registry import query, table

VOCAB = "SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents"


def _vocab(spark, sf):
    return table(spark, sf, "documents").select(F.explode(T.words(F.col("text"))).alias("word")).distinct()


def _docs(spark, sf):
    return table(spark, sf, "documents")


def _twice(x: str, pattern: str) -> str:
    # without looking around, matches next to each other take two passes
    return f"regexp_replace(regexp_replace({x}, '{pattern}', '\\1\\2', 'g'), '{pattern}', '\\1\\2', 'g')"


_HAMZA = _twice("strip_accents(coalesce(text, ''))", f"({T.LETTER}){T.INSIDE}({T.LETTER})")
_FRONT = f"replace(lower(regexp_replace({_HAMZA}, '(^|[^\\p{{L}}\\p{{N}}_]){T.BEFORE}({T.LETTER})', '\\1\\2', 'g')), '’', chr(39))"
_OWN = f"regexp_replace({_FRONT}, '''s([^\\p{{L}}\\p{{N}}_]|$)', '\\1', 'g')"
_JOINED = _twice(_OWN, "([a-z])''([a-z])")
NORM = f"trim(regexp_replace({_JOINED}, '[^a-z0-9]+', ' ', 'g'))"


@query("s_norm_en", f"SELECT doc_id, md5({NORM}) AS norm_md5, CAST(length({NORM}) AS BIGINT) AS norm_length FROM documents")
def s_norm_en(spark, sf):
    n = T.norm_en(F.col("text"))
    return _docs(spark, sf).select("doc_id", F.md5(n).alias("norm_md5"), F.length(n).cast("long").alias("norm_length"))


@query("s_tok_en", """SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[^A-Za-z0-9''’]+'), lambda x: x <> '')) AS BIGINT) AS n_tokens FROM documents""")
def s_tok_en(spark, sf):
    return _docs(spark, sf).select("doc_id", F.size(T.tok_en(F.col("text"))).cast("long").alias("n_tokens"))


_RULES = [f"CASE WHEN ends_with(word, '{s}') AND length(word) - {len(s)} >= 3 THEN concat(left(word, length(word) - {len(s)}), '{r}') END" for s, r in T.SUFFIXES]
_SINGLE = [f"CASE WHEN ends_with(word, '{s}') AND length(word) > {len(s) + 3} AND word[-{len(s) + 1}] = word[-{len(s) + 2}] THEN left(word, length(word) - {len(s) + 1}) END" for s in ("ing", "ed")]
_IRREGULAR = f"CASE word {' '.join(f'WHEN {chr(39)}{a}{chr(39)} THEN {chr(39)}{b}{chr(39)}' for a, b in T.IRREGULAR.items())} END"
CANDIDATES = f"""SELECT word, pos, cand FROM (
  SELECT word, cand, pos, row_number() OVER (PARTITION BY word, cand ORDER BY pos) AS rn FROM (
    SELECT word, unnest(range({len(T.SUFFIXES) + 4})) AS pos, unnest([word, {_IRREGULAR}, {', '.join(_RULES + _SINGLE)}]) AS cand FROM ({VOCAB}))
  WHERE cand IS NOT NULL) WHERE rn = 1"""


@query("s_irreg", f"SELECT word, {_IRREGULAR} AS base FROM ({VOCAB}) WHERE {_IRREGULAR} IS NOT NULL UNION ALL SELECT concat(word, ' ', CAST(p_size AS VARCHAR)), {_IRREGULAR} FROM (SELECT ({list(T.IRREGULAR)})[1 + p_partkey % {len(T.IRREGULAR)}] AS word, p_size FROM part)")
def s_irreg(spark, sf):
    """Irregular forms among the words of all documents; and of each part, which is given one of the forms."""
    base = T.irregular_en(F.col("word"))
    given = F.element_at(F.array(*map(F.lit, T.IRREGULAR)), (1 + F.col("p_partkey") % len(T.IRREGULAR)).cast("int"))
    parts = table(spark, sf, "part").select(given.alias("word"), "p_size").select(F.concat_ws(" ", "word", F.col("p_size").cast("string")).alias("word"), base.alias("base"))
    return _vocab(spark, sf).select("word", base.alias("base")).where("base IS NOT NULL").unionAll(parts)


@query("s_cand_en", f"SELECT word, string_agg(cand, ' ' ORDER BY pos) AS candidates FROM ({CANDIDATES}) GROUP BY word")
def s_cand_en(spark, sf):
    return _vocab(spark, sf).select("word", F.concat_ws(" ", T.candidates_en(F.col("word"))).alias("candidates"))


@query("s_term_en", f"SELECT word, arg_max(cand, pos) AS term FROM ({CANDIDATES}) WHERE length(word) > 2 AND word NOT IN {T.STOPWORDS} GROUP BY word")
def s_term_en(spark, sf):
    kept = _vocab(spark, sf).where((F.length("word") > 2) & ~F.col("word").isin(*T.STOPWORDS))
    return kept.select("word", T.term_en(F.col("word")).alias("term"))


@query("s_term_min", f"SELECT word, arg_min(cand, (length(cand), cand)) AS term FROM ({CANDIDATES}) GROUP BY word")
def s_term_min(spark, sf):
    return _vocab(spark, sf).select("word", T.least_form(T.candidates_en(F.col("word"))).alias("term"))


@query("s_forms_en", f"""SELECT d.doc_id, CAST(count(DISTINCT c.cand) AS BIGINT) AS n_forms
  FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents) d JOIN ({CANDIDATES}) c USING (word) GROUP BY d.doc_id""")
def s_forms_en(spark, sf):
    forms = F.array_distinct(F.flatten(F.transform(F.array_distinct(T.words(F.col("text"))), T.candidates_en)))
    return _docs(spark, sf).select("doc_id", F.size(forms).cast("long").alias("n_forms")).where("n_forms > 0")


@query("s_stop", f"SELECT word, word IN {T.STOPWORDS} AS is_stop FROM ({VOCAB})")
def s_stop(spark, sf):
    return _vocab(spark, sf).select("word", F.col("word").isin(*T.STOPWORDS).alias("is_stop"))


#: Texts with Turkish letters for some Latin ones.
LATIN_TR, TURKISH = "QWXqwxIJVjv", "İĞŞığşIâîûç"
TR = f"regexp_replace(lower(translate(translate(text, '{LATIN_TR}', '{TURKISH}'), 'Iİ', 'ıi')), '[^a-z0-9çğıöşüâîû ]', '', 'g')"


@query("s_norm_tr", f"SELECT doc_id, md5({TR}) AS norm FROM documents")
def s_norm_tr(spark, sf):
    return _docs(spark, sf).select("doc_id", F.md5(T.norm_tr(F.translate("text", LATIN_TR, TURKISH))).alias("norm"))


@query("s_fold_tr", f"SELECT doc_id, md5(translate({TR}, 'âîû', 'aiu')) AS folded FROM documents")
def s_fold_tr(spark, sf):
    return _docs(spark, sf).select("doc_id", F.md5(T.fold_tr(F.translate("text", LATIN_TR, TURKISH))).alias("folded"))


@query("s_forms_tr", f"SELECT word, CASE WHEN length(word) > 5 THEN concat(word, ' ', left(word, 5)) ELSE word END AS forms FROM ({VOCAB})")
def s_forms_tr(spark, sf):
    return _vocab(spark, sf).select("word", F.concat_ws(" ", T.forms_tr(F.col("word"))).alias("forms"))


@query("s_norm_ur", "SELECT doc_id, md5(translate(translate(lower(text), 'abcdefghijklmnopqrstuvwxyz', 'أبةديفغهيجكلمنوقإرستآوعخيز'), 'يكةأإآ', 'یکہااا')) AS norm FROM documents")
def s_norm_ur(spark, sf):
    """Texts written with Arabic letters first."""
    written = F.translate(F.lower("text"), "abcdefghijklmnopqrstuvwxyz", "أبةديفغهيجكلمنوقإرستآوعخيز")
    return _docs(spark, sf).select("doc_id", written.alias("text")).select("doc_id", F.md5(T.norm_ur(F.col("text"))).alias("norm"))


@query("s_gloss_key", f"SELECT p_partkey, {NORM.replace('text', chr(112) + '_gloss')} AS gloss_key FROM (SELECT p_partkey, regexp_replace(regexp_replace(p_name, '[_-]', ' ', 'g'), '[0-9]', '', 'g') AS p_gloss FROM part)")
def s_gloss_key(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.gloss_key(F.col("p_name")).alias("gloss_key"))


@query("s_short_text", r"""SELECT item_id, CASE WHEN length(x) > 120 THEN concat(rtrim(left(x, 119)), '…') ELSE x END AS short FROM (
  SELECT item_id, trim(regexp_replace(CASE WHEN regexp_extract(text, '"([^"]{8,})"', 1) <> '' THEN regexp_extract(text, '"([^"]{8,})"', 1) ELSE text END, '[ \n\t]+', ' ', 'g')) AS x FROM benchmark)""")
def s_short_text(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", T.short_text(F.col("text")).alias("short"))


@query("s_footnote", r"SELECT item_id, regexp_replace(concat(text, ' [', item_id, '] end'), '\[[0-9]+\]', '', 'g') AS plain FROM benchmark")
def s_footnote(spark, sf):
    marked = F.concat("text", F.lit(" ["), F.col("item_id").cast("string"), F.lit("] end"))
    return table(spark, sf, "benchmark").select("item_id", T.footnotes_removed(marked).alias("plain"))


@query("s_concat_passage", "SELECT conv_id, turn, trim(concat_ws('. ', role, text, concat('Turn: ', turn)), ' .') AS passage FROM conversations")
def s_concat_passage(spark, sf):
    joined = F.concat_ws(". ", "role", "text", F.concat(F.lit("Turn: "), F.col("turn").cast("string")))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.trim(joined, F.lit(" .")).alias("passage"))


@query("s_natkey", "SELECT c_custkey, CAST(coalesce(nullif(regexp_extract(k, '^([0-9]{1,9})', 1), ''), '1000000000') AS BIGINT) AS number, regexp_replace(k, '^[0-9]{1,9}', '') AS rest FROM (SELECT c_custkey, concat(c_custkey % 97, c_mktsegment) AS k FROM customer)")
def s_natkey(spark, sf):
    k = T.natural_key(F.concat((F.col("c_custkey") % 97).cast("string"), "c_mktsegment"))
    return table(spark, sf, "customer").select("c_custkey", k["number"].alias("number"), k["rest"].alias("rest"))


@query("s_sha_id", "SELECT doc_id, left(sha1(replace(text, chr(13) || chr(10), chr(10))), 8) AS text_id FROM documents")
def s_sha_id(spark, sf):
    return _docs(spark, sf).select("doc_id", T.sha_id(F.col("text")).alias("text_id"))


@query("s_crc_split")
def s_crc_split(spark, sf):
    return _docs(spark, sf).select("doc_id", T.split_name(F.crc32(F.col("doc_id").cast("string")) % 10).alias("split"))


@query("s_sha_split", "SELECT doc_id, CASE CAST(CAST('0x' || left(sha1(CAST(doc_id AS VARCHAR)), 8) AS BIGINT) % 10 AS INT) WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS split FROM documents")
def s_sha_split(spark, sf):
    bucket = F.conv(F.substring(F.sha1(F.col("doc_id").cast("string")), 1, 8), 16, 10).cast("long") % 10
    return _docs(spark, sf).select("doc_id", T.split_name(bucket).alias("split"))


@query("s_cited_split", r"""WITH t AS (SELECT conv_id, turn, concat(text, ' [', turn, '] and so it ends here') AS x FROM conversations WHERE text IS NOT NULL),
p AS (SELECT conv_id, turn, unnest(regexp_extract_all(x, '([^\[\]]+)\[([0-9, ]+)\]', 1)) AS s, unnest(regexp_extract_all(x, '([^\[\]]+)\[([0-9, ]+)\]', 2)) AS refs FROM t
  UNION ALL SELECT conv_id, turn, regexp_replace(x, '([^\[\]]+)\[([0-9, ]+)\]', '', 'g'), '' FROM t),
q AS (SELECT conv_id, turn, trim(regexp_replace(s, '^[ .]+', '')) AS sentence, replace(refs, ' ', '') AS refs FROM p)
SELECT conv_id, turn, md5(sentence) AS sentence, refs FROM q WHERE len(regexp_extract_all(sentence, '[A-Za-z]{2,}')) >= 3""")
def s_cited_split(spark, sf):
    marked = F.concat("text", F.lit(" ["), F.col("turn").cast("string"), F.lit("] and so it ends here"))
    rows = table(spark, sf, "conversations").where("text IS NOT NULL").select("conv_id", "turn", F.explode(T.cited_sentences(marked)).alias("s"))
    return rows.select("conv_id", "turn", F.md5("s.sentence").alias("sentence"), F.col("s.refs").alias("refs"))


_ANSWER = r"""(SELECT conv_id, turn, CASE (conv_id + turn) % 5 WHEN 0 THEN left(raw, length(raw) - 9) WHEN 1 THEN replace(raw, '}, {', '} {') WHEN 2 THEN '' ELSE raw END AS raw FROM (
  SELECT conv_id, turn, 'Here: {"glosses": [' || array_to_string(list_transform(regexp_extract_all(lower(text), '[a-z]+'), lambda w: '{"text": "' || CASE WHEN length(w) % 4 = 0 THEN w || '\"' || w ELSE w END || '", "oov": ' || CASE WHEN length(w) > 5 THEN 'true' ELSE 'false' END || '}'), ', ') || ']} - done' AS raw FROM conversations WHERE text IS NOT NULL))"""


@query("s_json_salvage", f"""WITH r AS (SELECT conv_id, turn, raw, regexp_extract_all(raw, '{T.ITEM}', 1) AS t, regexp_extract_all(raw, '{T.ITEM}', 2) AS o, regexp_extract(raw, '\\{{.*\\}}', 0, 's') AS whole FROM {_ANSWER}),
i AS (SELECT conv_id, turn, CASE WHEN whole <> '' AND json_valid(whole) THEN CAST(json_extract_string(whole, '$.glosses[*].text') AS VARCHAR[]) ELSE list_transform(t, lambda x: replace(x, '\\"', '"')) END AS texts, o FROM r)
SELECT conv_id, turn, CAST(len(texts) AS INT) AS items, CAST(len(list_filter(o, lambda x: x = 'true')) AS INT) AS oov, md5(array_to_string(texts, '|')) AS texts FROM i""")
def s_json_salvage(spark, sf):
    """Words of turns as a model's answer: some cut off, some without commas, some empty."""
    w = T.words(F.col("text"))
    item = lambda x: F.concat(F.lit('{"text": "'), F.when(F.length(x) % 4 == 0, F.concat(x, F.lit('\\"'), x)).otherwise(x), F.lit('", "oov": '), F.when(F.length(x) > 5, "true").otherwise("false"), F.lit("}"))
    raw = F.concat(F.lit('Here: {"glosses": ['), F.array_join(F.transform(w, item), ", "), F.lit("]} - done"))
    kind = (F.col("conv_id") + F.col("turn")) % 5
    broken = F.when(kind == 0, F.substring("raw", F.lit(1), F.length("raw") - 9)).when(kind == 1, F.replace("raw", F.lit("}, {"), F.lit("} {"))).when(kind == 2, "").otherwise(F.col("raw"))
    rows = table(spark, sf, "conversations").where("text IS NOT NULL").select("conv_id", "turn", raw.alias("raw")).select("conv_id", "turn", T.salvaged_items(broken).alias("items"))
    return rows.select("conv_id", "turn", F.size("items").alias("items"), F.size(F.filter("items", lambda x: x["oov"])).alias("oov"), F.md5(F.array_join("items.text", "|")).alias("texts"))


@query("s_urls", "SELECT event_id, CASE WHEN user_id % 5 > 0 THEN concat('https://example.org/watch?v=', user_id, '&start=', CAST(floor(value) AS BIGINT), '&end=', CAST(ceil(value) AS BIGINT)) END AS url FROM events")
def s_urls(spark, sf):
    url = F.concat(F.lit("https://example.org/watch?v="), F.col("user_id"), F.lit("&start="), F.floor("value"), F.lit("&end="), F.ceil("value"))
    return table(spark, sf, "events").select("event_id", F.when(F.col("user_id") % 5 > 0, url).alias("url"))


@query("s_refhash", "SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+/([a-z]+)/', 1) AS section, regexp_extract(url, '([0-9]+)[^0-9]*$', 1) AS ref FROM pages")
def s_refhash(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://[^/]+/([a-z]+)/", 1).alias("section"), F.regexp_extract("url", "([0-9]+)[^0-9]*$", 1).alias("ref"))


@query("s_labelkind", "SELECT DISTINCT concat(lang, '+', source) AS label, split_part(concat(lang, '+', source), '+', 1) AS kind FROM documents")
def s_labelkind(spark, sf):
    label = F.concat_ws("+", "lang", "source")
    return _docs(spark, sf).select(label.alias("label")).distinct().withColumn("kind", F.split_part("label", F.lit("+"), F.lit(1)))


@query("s_null_json", "SELECT event_id, CASE WHEN isnan(v) THEN NULL ELSE round(v, 2) END AS value FROM (SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 'nan'::DOUBLE WHEN event_id % 17 <> 0 THEN value END AS v FROM events)")
def s_null_json(spark, sf):
    """Every thirteenth value is made no number and every seventeenth null first."""
    v = F.when(F.col("event_id") % 13 == 0, float("nan")).when(F.col("event_id") % 17 != 0, F.col("value"))
    return table(spark, sf, "events").select("event_id", v.alias("v")).select("event_id", F.when(~F.isnan("v"), F.round("v", 2)).alias("value"))


@query("s_frames_sec", "SELECT event_id, CAST(round(value * 25) AS BIGINT) AS frame, round(round(value * 25) / 25, 3) AS second, CAST(round(value * 25) + 1 AS BIGINT) AS end_exclusive FROM events")
def s_frames_sec(spark, sf):
    frame = F.round(F.col("value") * 25)
    return table(spark, sf, "events").select("event_id", frame.cast("long").alias("frame"), F.round(frame / 25, 3).alias("second"), (frame + 1).cast("long").alias("end_exclusive"))


@query("s_title_gloss", r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(html, '<title>([^<]*)</title>', 1)), '\([^)]*\)|#[a-z0-9_]+', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'), ' +', ' ', 'g')) AS gloss FROM pages""")
def s_title_gloss(spark, sf):
    title = F.lower(F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    clean = F.regexp_replace(F.regexp_replace(title, r"\([^)]*\)|#[a-z0-9_]+", " "), "[^a-z0-9]+", " ")
    return table(spark, sf, "pages").select("page_id", F.trim(F.regexp_replace(clean, " +", " ")).alias("gloss"))


@query("s_ascii_restore", f"""WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z{T.MARKED}]+')) AS word FROM documents), n AS (SELECT word, count(*) AS n, translate(word, '{T.MARKED}', '{T.PLAIN}') AS folded FROM w GROUP BY word),
r AS (SELECT *, row_number() OVER (PARTITION BY folded ORDER BY n DESC, (word <> folded) DESC, length(word), word) AS rn FROM n) SELECT folded, word AS restored, CAST(n AS BIGINT) AS n FROM r WHERE rn = 1""")
def s_ascii_restore(spark, sf):
    """The commonest spelling of each folded word; of equals one with marks, then the shorter, then the first."""
    word = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(f"[a-z{T.MARKED}]+"), F.lit(0)))
    n = _docs(spark, sf).select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    n = n.withColumn("folded", F.translate("word", T.MARKED, T.PLAIN))
    best = F.min(F.struct((-F.col("n")).alias("a"), (F.col("word") == F.col("folded")).alias("b"), F.length("word").alias("c"), F.col("word").alias("word")))
    return n.groupBy("folded").agg(best.alias("best")).select("folded", F.col("best.word").alias("restored"), (-F.col("best.a")).alias("n"))
