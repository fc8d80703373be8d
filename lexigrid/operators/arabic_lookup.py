"""Finding a dictionary's entry for Arabic words: forms in order with guards, numbers, synonyms, then an analyser's readings.

All words are looked up at once: a table of (word, place, form) meets the entries' keys in one join, and a word takes its first form that passes
the guards.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrid.functions import arabic as A
from lexigrid.operators import morphology as M
from lexigrid.sources.files import written

# Clitics before number words, before a word that a guard looks at, and before a synonym; the lead that a reading needs.
NUMBER_PREFIXES = ("وبال", "وال", "بال", "ال", "وب", "و", "ب")
GUARD_PREFIXES = ("وال", "فال", "بال", "كال", "لل", "ال", "و", "ف", "ب", "ل")
ALIAS_PREFIXES = ("وال", "فال", "بال", "ال", "و", "ف", "ب", "ل")
FRONT_LETTERS = ("ف", "و", "ب", "ل")
MARGIN = 0.5
ROUTES = ("number", "form", "verb", "synonym", "lemma")


def _after(word: Column, prefix: str) -> Column:
    return F.substring(word, F.lit(len(prefix) + 1), F.length(word))


def _bare(word: Column, prefixes: tuple[str, ...], left: int) -> Column:
    """The word without the first of the prefixes that leaves ``left`` letters."""
    return F.coalesce(*[F.when(word.startswith(p) & (F.length(word) - len(p) >= left), _after(word, p)) for p in prefixes], word)


def without_article(word: Column) -> Column:
    return F.when(word.startswith("ال"), _after(word, "ال")).otherwise(word)


def _forms(words: DataFrame, lemmas: DataFrame, verbs: DataFrame) -> DataFrame:
    """(word, place, form, kind, verb): what is looked up for each word, in order of place."""
    w, f = F.col("word"), F.col("form")
    number = F.coalesce(*[F.when(w.startswith(p), A.number(_after(w, p))) for p in NUMBER_PREFIXES], A.number(w))
    place = lambda g, i, k: F.struct(*[F.lit(x).cast("int").alias(n) if isinstance(x, int) else x.cast("int").alias(n) for n, x in (("g", g), ("i", i), ("k", k))]).alias("place")
    distinct = words.select("word").distinct().join(verbs.withColumn("verb", F.lit(True)), "word", "left").withColumn("verb", F.coalesce("verb", F.lit(False)))
    digits = distinct.select("word", place(-1, 0, 0), number.alias("form"), F.lit("number").alias("kind"), F.lit(False).alias("verb"))
    exact = distinct.where("verb").select("word", F.posexplode(F.when(w.startswith("و") & (F.length(w) > 3), F.array(w, _after(w, "و"))).otherwise(F.array(w))).alias("i", "form")).select("word", place(0, F.col("i"), 0), "form", F.lit("form").alias("kind"), F.lit(True).alias("verb"))
    nouns = distinct.where("NOT verb").select("word")
    bases = nouns.select("word", w.alias("base"), F.lit(0).alias("g")).union(nouns.where((F.length(w) >= 4) & w.endswith("ا")).select("word", F.substring(w, F.lit(1), F.length(w) - 1), F.lit(1)))
    stems = bases.select("word", "g", F.posexplode_outer(A.light_stems(F.col("base"))).alias("i", "form")).where("form IS NOT NULL").groupBy("word", "form").agg(F.min(F.struct("g", "i")).alias("o"))
    stems = written(stems.select("word", "form", F.col("o.g").alias("g"), F.col("o.i").alias("i")), "stems")
    singular = stems.select("word", (F.col("g") * 1000 + F.col("i")).alias("i"), F.posexplode_outer(A.singulars(f)).alias("k", "form")).where("form IS NOT NULL")
    by_lemma = lemmas.join(nouns, "word", "left_semi")
    own = stems.select("word", place(F.col("g"), F.col("i"), 0), "form").union(singular.select("word", place(2, F.col("i"), F.col("k")), "form")).union(by_lemma.select("word", place(3, F.col("place"), 0), "lex")).where("form <> ''")
    both = own.select("word", "place", F.explode(F.array(F.struct(f.alias("form"), F.lit("form").alias("kind")), F.struct(F.concat(F.lit("ال"), f).alias("form"), F.lit("from_article").alias("kind")))).alias("x"))
    return digits.where("form IS NOT NULL").union(exact).union(both.select("word", "place", "x.form", "x.kind", F.lit(False).alias("verb")))


def entry_index(entries: DataFrame, readings: DataFrame) -> DataFrame:
    """(kind, lex, key): one-word entries, without marks, whose likeliest readings agree on a kind and a lemma that is spelled as the entry."""
    single = entries.where(~F.contains("key", F.lit(" ")) & (F.col("bare") == F.trim("gloss"))).select("key")
    top = M.likeliest(readings).withColumn("kind", kind_of(F.col("pos")))
    agreed = top.groupBy("word").agg(F.min("kind").alias("kind"), F.min("lex").alias("lex"), F.count_distinct("kind", "lex").alias("n"), F.max(F.col("kind").isNull()).alias("other"))
    fit = single.join(agreed.where("n = 1 AND NOT other"), F.col("key") == F.col("word")).where(lemma_key(F.col("lex")) == F.col("key"))
    return fit.groupBy("kind", "lex").agg(F.min(F.struct(F.length("key"), "key")).alias("k")).select("kind", "lex", F.col("k.key").alias("key"))


def kind_of(pos: Column) -> Column:
    return F.when(pos == "verb", "verb").when(pos.isin(*M.NOMINAL), "nom")


def lemma_key(lex: Column) -> Column:
    return A.norm(F.regexp_replace(lex, r"[_\d].*$", ""))


def found_entries(tokens: DataFrame, entries: DataFrame, synonyms: DataFrame, readings: DataFrame) -> DataFrame:
    """tokens (token), entries (key, gloss), synonyms (word, key), readings (word, pos, lex, lp, enc) of words as keys -> (token, entry, route) of each token
    that has an entry.

    In order: a number word; the word, its light stems, these without a last alef's ending, their singulars, the analyser's lemmas, each also with the article
    (only where the entry has it), through guards; a listed synonym, also after a clitic; the likeliest readings, if they agree on an entry and no other lemma is
    close.  A word that can only be a verb is looked up as it stands.  A match that took off a first letter yields to a verb about as likely.
    Null and empty tokens have no entry, repeated ones one row.
    """
    readings, entries = written(readings, "readings"), written(entries.select("key", "gloss", A.norm(F.col("gloss")).alias("gnorm"), A.strip_marks(F.col("gloss")).alias("bare")), "entries")
    words = tokens.select("token").where("token IS NOT NULL").distinct().select("token", A.norm(F.col("token")).alias("word"), A.strip_marks(F.col("token")).endswith("ة").alias("ta")).where("word <> ''")
    words = written(words, "words")
    kinds = readings.groupBy("word").agg(F.max(F.col("pos") == "verb").alias("verb"), F.max(F.col("pos").isin(*M.NOMINAL)).alias("nominal"))
    verbs, lemmas = kinds.where("verb AND NOT nominal").select("word"), written(M.ranked_lemmas(readings), "lemmas")
    gloss = entries.groupBy("key").agg(F.min(F.struct("gloss", "gnorm", "bare")).alias("m")).select("key", "m.gnorm", "m.bare")
    named = synonyms.join(entries.select("key").distinct(), "key").groupBy(F.col("word").alias("form")).agg(F.min("key").alias("key"))
    keys = gloss.select(F.col("key").alias("form"), "key")
    bare = _bare(F.col("gnorm"), GUARD_PREFIXES, 3)
    table = keys.union(named.join(keys, "form", "left_anti")).join(gloss, "key").select("form", "key", "gnorm", F.col("bare").startswith("ال").alias("article"), without_article(F.col("gnorm")).alias("short"), bare.startswith("ا").alias("alef"))
    hits = _forms(words, lemmas, verbs).join(table, "form").where("kind <> 'from_article' OR article")
    looked = words.select("token", "word", "ta", _bare(F.col("word"), GUARD_PREFIXES, 2).alias("rest"), _bare(F.col("word"), GUARD_PREFIXES, 3).startswith("ا").alias("from_alef"))
    hits = looked.join(hits, "word")
    in_gloss = entries.select(F.explode(F.split("key", " ")).alias("w")).select(without_article(F.col("w")).alias("rest")).distinct().withColumn("listed", F.lit(True))
    lemma_of = lemmas.select("word", F.col("lex").alias("short")).distinct()
    two = hits.join(in_gloss, "rest", "left").join(lemma_of.withColumn("one", F.lit(True)), ["word", "short"], "left").join(lemma_of.select(F.col("word").alias("rest"), "short", F.lit(True).alias("other")), ["rest", "short"], "left")
    none = lambda c: F.coalesce(c, F.lit(False))
    long_enough = (F.length("short") >= 3) | (F.col("rest") == F.col("short")) | (~none("listed") & (none("one") | none("other")))
    keeps = ~(F.col("from_alef") & ~F.col("alef")) & ~(F.col("ta") & ~F.col("gnorm").endswith("ه"))  # an alef at the front, a ta at the end are part of the word
    guarded = two.where((F.col("kind") == "number") | F.col("verb") | (long_enough & keeps))
    first = guarded.groupBy("token", "word").agg(F.min(F.struct("place", F.col("kind") == "from_article", "key", "gnorm", "kind")).alias("m")).select("token", "word", "m.key", "m.gnorm", F.when(F.col("m.kind") == "number", 0).otherwise(1).alias("route"))
    first = written(first, "first")

    index = entry_index(entries, readings)
    best = F.max("lp").over(Window.partitionBy("word"))
    likely = readings.withColumn("best", best)
    verb = likely.where((F.col("pos") == "verb") & (F.col("best") - F.col("lp") < MARGIN)).join(index.where("kind = 'verb'").select("lex", "key"), "lex").groupBy("word").agg(F.min("key").alias("verb_key"), F.count_distinct("key").alias("n")).where("n = 1").select("word", "verb_key")
    front = F.substring("word", 1, 1)
    took = (without_article(F.col("gnorm")) != without_article(F.col("word"))) & front.isin(*FRONT_LETTERS) & ~F.col("gnorm").startswith(front)
    first = first.join(verb, "word", "left").select("token", "word", F.when(took, F.coalesce("verb_key", "key")).otherwise(F.col("key")).alias("key"), F.when(took & F.col("verb_key").isNotNull(), 2).otherwise(F.col("route")).alias("route"))

    w = F.col("word")
    tried = F.array_distinct(F.concat(F.array(w), F.filter(F.array(*[F.when(w.startswith(p) & (F.length(w) - len(p) >= 2), _after(w, p)) for p in ALIAS_PREFIXES]), lambda x: x.isNotNull())))
    left = written(words.join(first.select("token"), "token", "left_anti"), "left")
    alias = left.select("token", "word", F.posexplode(tried).alias("place", "form")).join(named, "form").groupBy("token", "word").agg(F.min(F.struct("place", "key")).alias("m")).select("token", "word", "m.key", F.lit(3).alias("route"))

    top = M.likeliest(readings).withColumn("kind", kind_of(F.col("pos"))).join(index, ["kind", "lex"], "left")
    agreed = top.groupBy("word").agg(F.min("key").alias("key"), F.count_distinct("key").alias("n"), F.max(F.col("key").isNull()).alias("open"), F.collect_set(lemma_key(F.col("lex"))).alias("lemmas"), F.max("lp").alias("lp"), F.min((F.col("pos") != "verb") & (F.col("enc") == "0")).alias("plain"), F.max(F.col("enc") != "0").alias("pronoun"))
    known = readings.where(F.col("lp") > M.UNKNOWN).select("word", lemma_key(F.col("lex")).alias("other"), F.col("lp").alias("other_lp"), F.col("enc").alias("other_enc"))
    near = agreed.where("n = 1 AND NOT open").join(known, "word", "left")
    close = ~F.array_contains("lemmas", F.col("other")) & (F.col("lp") - F.col("other_lp") < MARGIN)
    feminine = F.col("pronoun") & F.col("word").endswith("ه") & (F.col("other_enc") == "0") & F.col("other").endswith("ه")
    sure = near.groupBy("word", "key", "plain").agg(F.max(F.coalesce(close | feminine, F.lit(False))).alias("doubt")).where("NOT doubt")
    g = F.col("gnorm")
    adverb = F.col("word").endswith("ا") & ~g.endswith("ا") & F.col("plain")
    ta = F.col("ta") & ~g.endswith("ه")
    lemma = left.join(alias.select("token"), "token", "left_anti").join(sure.select("word", "key", "plain"), "word").join(gloss, "key").where(~adverb & ~ta).select("token", "word", "key", F.lit(4).alias("route"))
    every = reduce(DataFrame.union, [first, alias, lemma])
    return every.select("token", F.col("key").alias("entry"), F.get(F.array(*map(F.lit, ROUTES)), F.col("route")).alias("route"))
