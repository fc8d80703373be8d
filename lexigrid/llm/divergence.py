"""Source divergence audit: how far the word use of each source of a language lies from that of the language's other sources.

The terms in enough documents of their language are found once, by one grouping of the documents' distinct terms.  For each language
a ``CountVectorizer`` learns them and turns every document into an exact sparse count vector.  Summing these by (language, source, term),
in the job that makes them, gives sparse group vectors, which are written.  Pairs of sources are then valued from what the sparse vectors hold:
with p0 the value of an absent term,

    sum |p - q| = V |p0 - q0| + sum over p's terms (|p - q0| - |p0 - q0|) + the same for q's terms
                  + sum over common terms (|p - q| - |p - q0| - |p0 - q| + |p0 - q0|)

The second and third sums come from a histogram of p's values (few are distinct), the last from a join on terms.

Bounds: CountVectorizer keeps its vocabulary on the driver and in every executor.  Its bytes are known first, and a
language with more than ``vocabulary_bytes`` of them is taken in slices by hash of the term, each with a vectorizer of its own.
Languages are listed on the driver; more than ``most_langs`` are refused with an error.

Null text, lang and source count as ''.  Documents without terms form groups like others.  A language without kept terms has
value 0 for each pair.  Repeated rows count as often as they stand.  Equal values are ranked by the item's UTF-8 bytes.  A very
long text is one row of terms in one task.  An empty table gives no row.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import string
from collections.abc import Callable

import pandas as pd
from pyspark.errors import IllegalArgumentException
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigrid.llm.shared import shared_path, written

MIN_DOCS, SMOOTHING, TOP, UNIT = 30, 5, 50, 1_000_000_000
SEPARATORS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
SALTS = 16


def terms_of(text: Column) -> Column:
    """The terms of a text in their order: runs of Latin letters and of characters beyond ASCII, only A-Z lower-cased."""
    lower = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.array_remove(F.split(lower, SEPARATORS), "")


def _term_table(docs: DataFrame, most_langs: int) -> tuple[DataFrame, list[str]]:
    """(source, terms, lang_no) written by language, and the languages by number."""
    spark, lang = docs.sparkSession, F.coalesce("lang", F.lit(""))
    langs = sorted(r[0] for r in docs.select(lang.alias("lang")).distinct().limit(most_langs + 1).collect())
    if len(langs) > most_langs:
        raise ValueError(f"more than {most_langs} languages")
    number = F.array_position(F.array(*map(F.lit, langs)).cast("array<string>"), lang) - 1
    rows = docs.select(F.coalesce("source", F.lit("")).alias("source"), terms_of(F.coalesce("text", F.lit(""))).alias("terms"), number.cast("int").alias("lang_no"))
    path = shared_path(spark, "terms")
    rows.write.partitionBy("lang_no").option("compression", "snappy").option("parquet.enable.dictionary", "false").parquet(path)  # read twice and for its sources, then done
    return spark.read.schema("source string, terms array<string>, lang_no int").parquet(path), langs


def kept_terms(terms: DataFrame, min_docs: int, vocabulary_bytes: int) -> tuple[DataFrame, dict[int, int]]:
    """(lang_no, term) written, the terms in enough documents of their language; and in how many slices each language's are to be taken."""
    each = terms.select("lang_no", F.explode(F.array_distinct("terms")).alias("term")).groupBy("lang_no", "term")
    kept = written(each.count().where(F.col("count") >= min_docs).select("lang_no", "term"), "kept_terms")
    size = kept.groupBy("lang_no").agg(F.sum(F.octet_length("term") + 64).alias("bytes"))
    return kept, {r.lang_no: -(-r.bytes // vocabulary_bytes) for r in size.collect()}


def _in_slice(k: int, many: int) -> Callable[[Column], Column]:
    return lambda t: F.pmod(F.xxhash64(t), F.lit(many)) == k


def group_vectors(spark: SparkSession, terms: DataFrame, slices: dict[int, int], min_docs: int, kept: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Written tables: the sums of each group's count vectors (lang_no, slice, source, place, n_term), and vocabularies (lang_no, slice, place, term).
    With ``kept``, the terms in enough documents, vectorizers learn from it instead of counting documents in ``terms`` once more."""
    at, words, found = shared_path(spark, "vectors"), shared_path(spark, "vocabulary"), False
    for no, many in sorted(slices.items()):
        for k in range(many):
            mine = terms.where(F.col("lang_no") == no).select("source", "terms")
            if many > 1:
                mine = mine.withColumn("terms", F.filter("terms", _in_slice(k, many)))
            try:
                learnt = mine if kept is None else kept.where(F.col("lang_no") == no).select(F.array("term").alias("terms")).where(_in_slice(k, many)(F.col("terms")[0]))
                model = CountVectorizer(inputCol="terms", outputCol="vector", minDF=1.0 if kept is not None else float(min_docs), vocabSize=2**31 - 1).fit(learnt)
            except IllegalArgumentException as e:
                if "vocabulary size should be > 0" in str(e):  # no term is in enough documents
                    continue
                raise
            place, found = f"lang_no={no}/slice={k}", True
            each = model.transform(mine).select("source", F.unwrap_udt("vector").alias("vector"))
            entries = each.select("source", F.explode(F.arrays_zip("vector.indices", "vector.values")).alias("e"))
            sums = entries.groupBy("source", F.col("e.indices").alias("place")).agg(F.sum(F.col("e.values").cast("long")).alias("n_term"))
            sums.write.option("compression", "zstd").parquet(f"{at}/{place}")
            names = pd.DataFrame({"place": range(len(model.vocabulary)), "term": model.vocabulary})
            spark.createDataFrame(names, "place int, term string").write.parquet(f"{words}/{place}")
    keys = "lang_no int, slice int"
    if not found:
        return spark.createDataFrame([], f"source string, place int, n_term long, {keys}"), spark.createDataFrame([], f"place int, term string, {keys}")
    return spark.read.schema(f"source string, place int, n_term long, {keys}").parquet(at), spark.read.schema(f"place int, term string, {keys}").parquet(words)


def _p(count: str, n: str, v: str) -> Column:
    """1 + floor(10^9 (count + 5) / (n + 5 v)) in whole numbers of any size; null without kept terms."""
    whole = f"cast({n} + {SMOOTHING} * {v} as decimal(20, 0))"
    return F.expr(f"case when {v} > 0 then 1 + (cast({UNIT} as decimal(10, 0)) * cast({count} + {SMOOTHING} as decimal(20, 0))) div {whole} end")


def _pairs(groups: DataFrame, counts: DataFrame) -> DataFrame:
    """(lang_no, source, item, value) for every ordered pair of a language's sources."""
    g = groups.select("lang_no", F.col("source").alias("a"), F.col("p0").alias("a0"), "v")
    h = groups.select("lang_no", F.col("source").alias("b"), F.col("p0").alias("b0"))
    base = g.join(h, "lang_no").where("a <> b").select("lang_no", "a", "b", F.expr("case when v > 0 then v * abs(a0 - b0) else 0 end").alias("x"))
    hist = counts.groupBy("lang_no", F.col("source").alias("a"), "p0", "p").count()
    one = hist.join(h, "lang_no").where("a <> b").select("lang_no", "a", "b", F.expr("count * (abs(p - b0) - abs(p0 - b0))").alias("x"))
    left = counts.select("lang_no", "slice", "place", F.col("source").alias("a"), F.col("p").alias("pa"), F.col("p0").alias("a0"))
    right = counts.select("lang_no", "slice", "place", F.col("source").alias("b"), F.col("p").alias("pb"), F.col("p0").alias("b0"))
    common = left.join(right, ["lang_no", "slice", "place"]).where("a < b")
    both = common.groupBy("lang_no", "a", "b").agg(F.sum(F.expr("abs(pa - pb) - abs(pa - b0) - abs(a0 - pb) + abs(a0 - b0)")).alias("x"))
    mirrored = lambda d: d.union(d.select("lang_no", F.col("b").alias("a"), F.col("a").alias("b"), "x"))
    every = base.union(mirrored(one)).union(mirrored(both))
    return every.groupBy("lang_no", F.col("a").alias("source"), F.col("b").alias("item")).agg(F.sum("x").cast("long").alias("value"))


def _terms(counts: DataFrame, totals: DataFrame, top: int) -> DataFrame:
    """The ``top`` terms that each group uses more than its language does; groups are ranked in salted parts first."""
    more = counts.join(totals, ["lang_no", "slice", "place"]).where("p > q").select("lang_no", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    order = (F.desc("value"), "item")
    part = Window.partitionBy("lang_no", "source", F.pmod(F.xxhash64("item"), F.lit(SALTS))).orderBy(*order)
    best = more.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("lang_no", "source").orderBy(*order))).where(F.col("rank") <= top)


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, vocabulary_bytes: int = 64 << 20, most_langs: int = 1000) -> DataFrame:
    """(lang, source, part, item, value, rank): ``pair`` rows for each other source, ``term`` rows for each overused term."""
    spark = docs.sparkSession
    terms, langs = _term_table(docs, most_langs)
    kept, slices = kept_terms(terms, min_docs, vocabulary_bytes)
    summed, vocabulary = group_vectors(spark, terms, slices, min_docs, kept)
    summed = written(summed.join(vocabulary, ["lang_no", "slice", "place"]), "group_counts")
    size = vocabulary.groupBy("lang_no").agg(F.count("*").alias("v"))
    n = summed.groupBy("lang_no", "source").agg(F.sum("n_term").alias("n"))
    groups = terms.select("lang_no", "source").distinct().join(size, "lang_no", "left").join(n, ["lang_no", "source"], "left").fillna(0, ["v", "n"])
    groups = written(groups.select("lang_no", "source", "v", "n", _p("0", "n", "v").alias("p0")), "groups")
    counts = written(summed.join(groups, ["lang_no", "source"]).select("lang_no", "slice", "place", "term", "source", "p0", _p("n_term", "n", "v").alias("p")), "group_values")
    whole = summed.groupBy("lang_no").agg(F.sum("n_term").alias("n")).join(size, "lang_no")
    totals = summed.groupBy("lang_no", "slice", "place").agg(F.sum("n_term").alias("n_term")).join(F.broadcast(whole), "lang_no").select("lang_no", "slice", "place", _p("n_term", "n", "v").alias("q"))
    pairs = _pairs(groups, counts).withColumn("rank", F.row_number().over(Window.partitionBy("lang_no", "source").orderBy(F.desc("value"), "item")))
    name = F.element_at(F.array(*map(F.lit, langs)).cast("array<string>"), F.col("lang_no") + 1).alias("lang")
    out = lambda d, part: d.select(name, "source", F.lit(part).alias("part"), "item", "value", "rank")
    return out(pairs, "pair").union(out(_terms(counts, totals, top), "term"))


DIVERGENCE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
n AS (SELECT *, row_number() OVER () AS r FROM d),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM n),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
c AS (SELECT lang, source, term, count(*) AS c FROM w JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
gn AS (SELECT g.lang, g.source, coalesce(sum(c), 0)::HUGEINT AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 5)) // (gn.n + 5 * v.v) AS p
  FROM g JOIN kept k USING (lang) JOIN v USING (lang) JOIN gn USING (lang, source) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
l AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(c) + 5)::HUGEINT) // (any_value(tot)::HUGEINT + 5 * any_value(v.v)) AS q
  FROM p JOIN v USING (lang) JOIN (SELECT lang, sum(n) AS tot FROM gn GROUP BY lang) USING (lang) GROUP BY lang, term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT s.lang, s.source AS one, t.source AS two, sum(abs(s.p - t.p)) AS value FROM p s JOIN p t ON s.lang = t.lang AND s.term = t.term AND s.source <> t.source GROUP BY ALL) x
    ON x.lang = a.lang AND x.one = a.source AND x.two = b.source),
terms AS (SELECT p.lang, p.source, p.term AS item, (p.p - l.q)::BIGINT AS value FROM p JOIN l USING (lang, term) WHERE p.c > 0 AND p.p > l.q)
SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pairs
UNION ALL
SELECT lang, source, 'term' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM terms
QUALIFY rank <= 50
"""
