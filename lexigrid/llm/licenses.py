"""Licence scan: phrases and notices of licences found by diagonal voting, with DataFrame functions only.

Every text's rolling word pairs and word fours are hashed and joined with the positions of the templates' pairs and fours (the
templates are fixed and small: at most ``MOST_GRAMS`` rows, checked, are broadcast).  A hit counts only where the words
themselves are equal.  Hits vote for the diagonal "place in the text minus place in the template", on which the whole template
would stand without edits.  Neighbouring diagonals of a template are merged, so that words put in or left out don't part a copy,
and a merged span is verified: it must hold the template's share of distinct grams on no more than twice the template's words.

A phrase merges nothing and needs all its pairs on one diagonal: that is the phrase, word for word.  A notice needs 60 % of its
fours.  ``score`` is the largest share of a verified span, halved for phrases: 0.5 says that a licence is named, 1 that a notice
stands whole.

Words: A-Z lower-cased, runs of digits, Latin letters and characters beyond ASCII.  Null texts are empty and have no words.
Repeated rows, same id included, each give a row.  Labels are distinct and sorted, so ties need no rule.  A very long text is
one row, held by one task; what it votes for is spread by text, template and diagonal.  An empty table gives no row.  Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Phrases whose places are counted, and their labels.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Further phrases of licences.
PHRASES = (
    ("gnu affero general public license", "agpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu free documentation license", "gfdl"),
    ("mozilla public license", "mpl"),
    ("eclipse public license", "epl"),
    ("bsd license", "bsd"),
    ("isc license", "isc"),
    ("cc by sa", "cc-by-sa"),
    ("cc by nc", "cc-by-nc"),
    ("cc by nd", "cc-by-nd"),
    ("cc0 1 0", "cc0"),
    ("public domain dedication", "public-domain"),
)
#: Notices as the licences ask to be given, as words.
NOTICES = (
    (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
        "http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
        "without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
        "apache",
    ),
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished "
        "to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "mit",
    ),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 "
        "of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of "
        "merchantability or fitness for a particular purpose see the gnu general public license for more details",
        "gpl",
    ),
    (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain "
        "the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and "
        "the following disclaimer in the documentation and or other materials provided with the distribution",
        "bsd",
    ),
    (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice "
        "appear in all copies",
        "isc",
    ),
    (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
        "mpl",
    ),
    ("this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", "public-domain"),
    ("this work is licensed under a creative commons attribution 4 0 international license to view a copy of this license visit http creativecommons org licenses by 4 0", "cc-by"),
)
PAIR, FOUR, SLACK, SHARE, MOST_GRAMS = 2, 4, 8, 0.6, 100_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: (number, words, label, words a gram, most words between merged diagonals, least share, is a base phrase); 0 matches once in every text.
Template = tuple[int, list[str], str, int, int, float, bool]


def templates() -> list[Template]:
    phrases = [(text, label, PAIR, 0, 1.0, base) for source, base in ((BASE, True), (PHRASES, False)) for text, label in source]
    notices = [(text, label, FOUR, SLACK, SHARE, False) for text, label in NOTICES]
    return [(i, text.split(), *rest) for i, (text, *rest) in enumerate(phrases + notices, 1)]


def words_of(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    lower = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.array_remove(F.split(lower, SEPARATORS), "")


def _rolled(hashes: str, step: int, n: Column) -> Column:
    """Hashes of twice as many words each: element i of ``hashes``, which has ``n``, with element i + ``step``."""
    n = F.greatest(n - step, F.lit(0))
    return F.zip_with(F.slice(hashes, F.lit(1), n), F.slice(hashes, F.lit(step + 1), n), lambda a, b: F.xxhash64(a, b))


def _grams(rows: DataFrame) -> DataFrame:
    """``rows`` with (pairs, fours): the hashes of word pairs and word fours at each place of ``words``."""
    n = F.size("words")
    single = rows.withColumn("singles", F.transform("words", lambda w: F.xxhash64(w)))
    return single.withColumn("pairs", _rolled("singles", 1, n)).withColumn("fours", _rolled("pairs", 2, n - 1)).drop("singles")


def _positions(spark: SparkSession, every: list[Template]) -> DataFrame:
    """(t, size, place, hash, gram) of every gram of every template, and one row (0, 0, 0, 0, []) for the text itself."""
    rows = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(i).alias("t"), F.split(F.lit(" ".join(w)), " ").alias("words"), F.lit(k).alias("size")) for i, w, _, k, *_ in every])))
    at = _grams(rows).select("t", "size", "words", F.posexplode(F.when(F.col("size") == PAIR, F.col("pairs")).otherwise(F.col("fours"))).alias("place", "hash"))
    at = at.select("t", "size", "place", "hash", F.slice("words", F.col("place") + 1, F.col("size")).alias("gram"))
    return at.union(spark.range(1).select(F.lit(0), F.lit(0), F.lit(0), F.lit(0).cast("long"), F.array().cast("array<string>")))


def license_spans(docs: DataFrame, every: list[Template] | None = None) -> DataFrame:
    """(row, doc_id, n_words, t, label, base, first, last, share): every verified span; and one row without label for each text."""
    spark, every = docs.sparkSession, every or templates()
    if sum(len(w) for _, w, *_ in every) > MOST_GRAMS:
        raise ValueError(f"templates of more than {MOST_GRAMS} words aren't broadcast")
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), words_of(F.col("text")).alias("words"))
    rolled = _grams(texts).select("row", "doc_id", "words", F.size("pairs").alias("n_pairs"), F.size("fours").alias("n_fours"), F.concat("pairs", "fours", F.array(F.lit(0).cast("long"))).alias("hashes"))
    each = rolled.select("row", "doc_id", "words", "n_pairs", "n_fours", F.posexplode_outer("hashes").alias("i", "hash"))  # outer: else a filter on the size computes it all twice
    width = F.when(F.col("i") < F.col("n_pairs"), PAIR).when(F.col("i") < F.col("n_pairs") + F.col("n_fours"), FOUR).otherwise(0)
    at = F.when(width == PAIR, F.col("i")).when(width == FOUR, F.col("i") - F.col("n_pairs")).otherwise(0)
    hits = each.join(F.broadcast(_positions(spark, every)), "hash").where((F.col("size") == width) & (F.slice("words", at + 1, F.col("size")) == F.col("gram")))
    hits = hits.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), "t", at.alias("at"), "place", (at - F.col("place")).alias("diagonal"))
    votes = hits.groupBy("row", "doc_id", "n_words", "t", "diagonal").agg(F.collect_set("place").alias("places"), F.min("at").alias("first"), F.max("at").alias("last"))
    facts = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(label).alias("label"), F.lit(len(w)).alias("length"), F.lit(len(w) - k + 1).alias("grams"), F.lit(k).alias("size"), F.lit(slack).alias("slack"), F.lit(share).alias("least"), F.lit(base).alias("base")) for t, w, label, k, slack, share, base in every])
    votes = votes.withColumn("of", F.get(facts, F.col("t") - 1))
    along = Window.partitionBy("row", "t").orderBy("diagonal")
    parted = votes.withColumn("new", (F.col("diagonal") - F.lag("diagonal").over(along) > F.col("of.slack")).cast("int")).withColumn("span", F.sum(F.coalesce("new", F.lit(0))).over(along))
    spans = parted.groupBy("row", "doc_id", "n_words", "t", "span").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("held"), F.min("diagonal").alias("start"), F.first("of").alias("of")
    )
    share = F.col("held") / F.col("of.grams")
    sound = (share >= F.col("of.least")) & (F.col("last") + F.col("of.size") - F.col("first") <= 2 * F.col("of.length"))
    return spans.where((F.col("t") == 0) | sound).select("row", "doc_id", "n_words", "t", "of.label", "of.base", "start", "first", (F.col("last") + F.col("of.size") - 1).alias("last"), share.alias("share"), "of.slack")


def scan_licenses(docs: DataFrame, every: list[Template] | None = None) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row of ``docs``."""
    base, spans = F.col("base"), license_spans(docs, every)
    joined = lambda labels: F.array_join(F.array_sort(labels), ",")
    found = spans.groupBy("row", "doc_id", "n_words").agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("start").cast("long"))).alias("first_word"),
        F.max(F.when(base, F.col("start").cast("long"))).alias("last_word"),
        joined(F.collect_set(F.when(base, F.col("label")))).alias("base_labels"),
        joined(F.collect_set("label")).alias("labels"),
        F.coalesce(F.max(F.when(F.col("slack") > 0, F.col("share")).otherwise(F.col("share") / 2)), F.lit(0.0)).alias("score"),
    )
    return found.drop("row")


def license_sql() -> str:
    """The same in DuckDB's SQL, by equality of the grams' words instead of hashes."""
    quoted = ", ".join(f"({t}, '{' '.join(w)}', '{label}', {k}, {slack}, {share}::DOUBLE, {base})" for t, w, label, k, slack, share, base in templates())
    return rf"""
WITH template(t, text, label, k, slack, least, base) AS (VALUES {quoted}),
tw AS (SELECT *, string_split(text, ' ') AS w FROM template),
grams AS (SELECT t, k, i AS place, w[i + 1 : i + k] AS gram FROM (SELECT t, k, w, unnest(range(len(w) - k + 1)) AS i FROM tw)),
d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
places AS (SELECT r, i, w FROM (SELECT r, w, unnest(w) AS word, unnest(range(len(w))) AS i FROM d) WHERE word IN (SELECT gram[1] FROM grams)),
hits AS (
  SELECT r, t, i, place, i - place AS diagonal, g.k FROM (SELECT r, i, k, w[i + 1 : i + k] AS gram FROM places, (VALUES (2), (4)) x(k)) a JOIN grams g ON a.k = g.k AND a.gram = g.gram),
votes AS (SELECT r, t, diagonal, list(place) AS places, min(i) AS first, max(i) AS last FROM hits GROUP BY ALL),
marked AS (SELECT v.*, tw.slack, diagonal - lag(diagonal) OVER (PARTITION BY r, v.t ORDER BY diagonal) > slack AS new FROM votes v JOIN tw USING (t)),
parted AS (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY r, t ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS span FROM marked),
spans AS (SELECT r, t, span, min(first) AS first, max(last) AS last, len(list_distinct(flatten(list(places)))) AS held, min(diagonal) AS start FROM parted GROUP BY ALL),
sound AS (
  SELECT r, label, base, slack, start, held / (len(w) - k + 1) AS share FROM spans JOIN tw USING (t)
  WHERE held / (len(w) - k + 1) >= least AND last + k - first <= 2 * len(w))
SELECT any_value(doc_id) AS doc_id, any_value(len(w))::BIGINT AS n_words, count(*) FILTER (base) AS n_base,
       min(start) FILTER (base)::BIGINT AS first_word, max(start) FILTER (base)::BIGINT AS last_word,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels,
       coalesce(max(CASE WHEN slack > 0 THEN share ELSE share / 2 END), 0.0)::DOUBLE AS score
FROM d LEFT JOIN sound USING (r) GROUP BY r
"""
