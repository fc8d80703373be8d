"""Finding a dictionary's entry for Turkish words and phrases: spellings, compounds, an analyser's lemmas, synonyms, then stems.

All tokens are looked up at once: each meets one row of an index by its spelling and one by its spelling without circumflexes, and takes its first hit.  The
indexes have one row for a form and go to the tokens where they are small, so tokens without a hit are neither repeated nor dealt anew.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrid.functions import text as T
from lexigrid.operators import lexicon as L
from lexigrid.operators import morphology as M
from lexigrid.sources.files import written

# What a hit is called, by route; Turkish letters and what stands for them where they can't be typed; the least length of a stem.
ROUTES = ("exact", "exact", "exact", "compound", "lemma", "synonym", "prefix")
TURKISH, TYPED = "çğışöüâîû", "cgisouaiu"
PREFIX_MIN = 6
KEY, FOLD, TYPED_KEY, COMPOUND, LEMMA, SYNONYM, STEM = range(7)


def spelled(text: Column) -> Column:
    """The normal spelling, with single spaces."""
    return F.when(text.rlike("^[a-z0-9çğıöşüâîû]+( [a-z0-9çğıöşüâîû]+)*$"), text).otherwise(F.trim(F.regexp_replace(T.norm_tr(text), " +", " ")))  # most tokens are spelled so


def folded_lemmas(readings: DataFrame) -> DataFrame:
    """(word, lemma, place) of the usable readings, without circumflexes; of lemmas that are then equal the better place stays."""
    return M.usable_lemmas(readings).groupBy("word", T.fold_tr(F.col("lemma")).alias("lemma")).agg(F.min("place").alias("place"))


def all_keys(entries: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(key, entry, stem): entries under their own keys, then under phrases that are listed as meaning one of them."""
    own = entries.select(spelled(F.col("key")).alias("key"), F.coalesce("stem", F.lit(False)).alias("stem")).where("key <> ''").groupBy("key").agg(F.max("stem").alias("stem"))
    phrases = synonyms.select(spelled(F.col("word")).alias("phrase"), spelled(F.col("entry")).alias("key")).where(F.contains("phrase", F.lit(" ")))
    meant = phrases.join(own.select("key"), "key").groupBy("phrase").agg(F.min("key").alias("entry")).join(own.select(F.col("key").alias("phrase")), "phrase", "left_anti")
    return own.select("key", F.col("key").alias("entry"), "stem").union(meant.select("phrase", "entry", F.lit(False)))


def form_index(keys: DataFrame, synonyms: DataFrame, lemmas: DataFrame) -> DataFrame:
    """(kind, form, entry), one row for each kind and form; of several entries the smaller key's."""
    several = F.contains("key", F.lit(" "))
    single, phrases = keys.where(~several).withColumn("form", T.fold_tr(F.col("key"))), keys.where(several)
    least = lambda df: df.groupBy("form").agg(F.min(F.struct("key", "entry")).alias("m")).select("form", "m.entry")
    word = least(single)
    typed = single.select(F.translate("key", TURKISH, TYPED).alias("form"), "key", "entry").where("form <> key")
    typed = typed.groupBy("form").agg(F.count("*").alias("n"), F.min("entry").alias("entry")).where("n = 1").join(keys.select(F.col("key").alias("form")), "form", "left_anti").select("form", "entry")
    compound = least(phrases.withColumn("form", F.replace(T.fold_tr(F.col("key")), F.lit(" "), F.lit(""))))
    only = lemmas.groupBy("word").agg(F.count("*").alias("n"), F.min("lemma").alias("form")).where("n = 1")
    inflected = least(single.select("key", "entry").join(only, F.col("key") == F.col("word"))).join(word.select("form"), "form", "left_anti")
    listed = synonyms.select(T.fold_tr(spelled(F.col("word"))).alias("form"), spelled(F.col("entry")).alias("key")).where(~F.contains("form", F.lit(" ")))
    alias = least(listed.join(keys, "key").select("form", "key", "entry"))
    kinds = ((KEY, keys.select(F.col("key").alias("form"), "entry")), (FOLD, word), (TYPED_KEY, typed), (COMPOUND, compound), (LEMMA, word.union(inflected)), (SYNONYM, alias))
    return reduce(DataFrame.union, [df.select(F.lit(k).alias("kind"), "form", "entry") for k, df in kinds])


def best_by_form(index: DataFrame, lemmas: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two tables (form, hit) with one row for each form, its first hit (kind, place, key, entry): of tokens as they stand, as keys, typed or by a lemma of
    theirs; and of tokens without circumflexes, as words, compounds or synonyms.  Lemmas are resolved here once a word, not once a token."""
    hit = lambda kind, place: F.struct(kind.alias("kind"), place.cast("int").alias("place"), F.lit("").alias("key"), "entry").alias("hit")
    kind, word = F.col("kind"), lemmas.where(~F.contains("word", F.lit(" ")))
    as_is = index.where(kind.isin(KEY, TYPED_KEY)).select("form", hit(kind, F.lit(0)))
    read = word.join(index.where(kind.isin(LEMMA, SYNONYM)), F.col("lemma") == F.col("form")).where((kind == LEMMA) | (F.col("place") == 1))
    read = read.select("word", hit(kind, F.when(kind == LEMMA, F.col("place")).otherwise(1)))
    least = lambda df: df.groupBy("form").agg(F.min("hit").alias("hit"))
    return least(as_is.union(read)), least(index.where(kind.isin(FOLD, COMPOUND, SYNONYM)).select("form", hit(kind, F.lit(0))))


def phrase_hits(phrases: DataFrame, keys: DataFrame, lemmas: DataFrame) -> DataFrame:
    """(token, place, key, entry): tokens (token, n, f) of several words, whose words are each an entry's as written or by a lemma; place: of the first word's
    lemma, 0 as written.  Entries are looked for by their number of words, first word and last word; words between are then compared.

    A token keeps only forms that some entry begins with, then ends with, so few tokens reach the entries."""
    gloss = keys.where(F.contains("key", F.lit(" "))).select("key", "entry", F.split(T.fold_tr(F.col("key")), " ").alias("gloss"))
    gloss = written(gloss.select("*", F.size("gloss").alias("size"), F.col("gloss")[0].alias("first"), F.element_at("gloss", -1).alias("last")), "phrases")

    def forms(end: str, known: DataFrame) -> DataFrame:
        """(word, forms): of each word those lemmas that stand at this end of an entry."""
        some = lemmas.join(known.select(F.col(end).alias("lemma")).distinct(), "lemma", "left_semi")
        return some.groupBy(F.col("word").alias(f"{end}_word")).agg(F.collect_list(F.struct(F.col("lemma").alias("form"), "place")).alias(f"{end}_forms"))  # a word's few lemmas

    def at(df: DataFrame, end: str, i: int, *more: str) -> DataFrame:
        own = F.struct(F.element_at("folded", i).alias("form"), F.lit(0).alias("place"))
        met = df.join(L.small(written(forms(end, gloss), end)), F.element_at("words", i) == F.col(f"{end}_word"), "left")
        every = F.concat(F.array(own), F.coalesce(F.filter(f"{end}_forms", lambda x: x["form"] != own["form"]), F.array().cast("array<struct<form:string,place:int>>")))
        return met.select("token", "words", "folded", "size", *more, F.explode(every).alias("x")).select("token", "words", "folded", "size", *more, F.col("x.form").alias(end), F.col("x.place").alias(f"{end}_place"))

    split = phrases.select("token", F.split("n", " ").alias("words"), F.split("f", " ").alias("folded")).withColumn("size", F.size("words"))
    begun = at(split, "first", 1).join(L.small(gloss.select("size", "first").distinct()), ["size", "first"])
    met = at(begun, "last", -1, "first", "first_place").join(L.small(gloss), ["size", "first", "last"]).withColumnRenamed("first_place", "place")
    whole = met.where("size = 2").select("token", "place", "key", "entry")
    between = lambda c: F.slice(c, F.lit(2), F.greatest(F.col("size") - 2, F.lit(0)))
    inner = met.where("size > 2").select("token", "place", "key", "entry", F.explode(F.arrays_zip(between("words").alias("word"), between("folded").alias("own"), between("gloss").alias("lemma"))).alias("x")).select("token", "place", "key", "entry", "x.*")
    same = inner.join(lemmas.select("word", "lemma", F.lit(True).alias("read")), ["word", "lemma"], "left").groupBy("token", "place", "key", "entry")
    return whole.union(same.agg(F.min((F.col("own") == F.col("lemma")) | F.coalesce("read", F.lit(False))).alias("same")).where("same").drop("same"))


def found_signs(tokens: DataFrame, entries: DataFrame, synonyms: DataFrame, readings: DataFrame) -> DataFrame:
    """tokens (token), entries (key, stem), synonyms (word, entry), readings (word, n, lemma, pos, morphs, proper) -> (token, entry, route) of each token that has
    an entry.

    A word is looked up as it stands, without circumflexes, and, typed without Turkish letters, as the one key that is typed so; then as a phrase written
    together; by its usable lemmas, the best first, where an entry that is itself an inflected form stands for its only lemma; as a listed synonym, the word
    first and then its best lemma.  A word without any reading takes the one entry of ``PREFIX_MIN`` letters or more (``stem``) that it starts with; it has none
    if several compete.  A token of several words is looked up as it stands, then word by word as written or by lemma.  A synonym of several words is one more
    key of its entry; synonyms of what isn't an entry do nothing.  Null and empty tokens have no entry, repeated ones one row.
    """
    readings = written(readings.select("word", "n", "lemma", "pos", "morphs", "proper"), "readings")
    lemmas = written(folded_lemmas(readings), "lemmas")
    keys = written(all_keys(entries, synonyms), "keys")
    looked = tokens.where("token IS NOT NULL").select("token").distinct().select("token", spelled(F.col("token")).alias("n")).where("n <> ''").withColumn("f", F.translate("n", "âîû", "aiu"))
    looked = written(looked, "tokens")
    several = F.contains("n", F.lit(" "))
    words, phrases = looked.where(~several), looked.where(several)
    index = written(form_index(keys, synonyms, lemmas), "index")
    as_is, folded = (L.small(written(df.select(F.col("form").alias(by), F.col("hit").alias(f"{by}_hit")), "forms")) for df, by in zip(best_by_form(index, lemmas), "nf", strict=True))
    hits = looked.join(as_is, "n", "left").join(folded, "f", "left").select("token", F.array_min(F.array("n_hit", "f_hit")).alias("m")).where("m IS NOT NULL").select("token", "m.*")
    by_lemma = phrase_hits(phrases, keys, lemmas).select("token", F.lit(LEMMA), "place", "key", "entry")
    stems = keys.where("stem").select(T.fold_tr(F.col("key")).alias("stem"), "entry").where(F.length("stem") >= PREFIX_MIN).withColumn("start", F.substring("stem", 1, PREFIX_MIN))
    long = words.where(F.length("f") > PREFIX_MIN).withColumn("start", F.substring("f", 1, PREFIX_MIN)).join(L.small(stems), "start")
    begun = long.where(F.startswith("f", "stem") & (F.length("f") > F.length("stem"))).join(readings.select(F.col("word").alias("n")).distinct(), "n", "left_anti")
    begun = begun.groupBy("token").agg(F.min("entry").alias("entry"), F.max("entry").alias("other")).where("entry = other").select("token", F.lit(STEM), F.lit(0), F.lit(""), "entry")
    first = hits.union(by_lemma).union(begun).groupBy("token").agg(F.min(F.struct("kind", "place", "key", "entry")).alias("m"))
    return first.select("token", "m.entry", F.get(F.array(*map(F.lit, ROUTES)), F.col("m.kind")).alias("route"))


def signs_of_sequences(sequences: DataFrame, entries: DataFrame, synonyms: DataFrame, readings: DataFrame, by: str = "id", most: int = 5) -> DataFrame:
    """sequences (``by``, words array) -> (``by``, start, size, entry, route): entries along each sequence from left to right, phrases of up to ``most`` words
    before their words, the longest first, without overlap.

    Runs of 1 to ``most`` words are looked up once for each distinct run.  A run that begins inside a longer one already taken is passed over, in one step along
    a sequence's own hits.  Null and empty sequences have no rows.
    """
    def runs(k: int) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size("words")), lambda i: i + k <= F.size("words"))
        return F.transform(starts, lambda i: F.struct(i.alias("start"), F.lit(k).alias("size"), F.array_join(F.transform(F.slice("words", i + 1, k), spelled), " ").alias("token")))

    every = sequences.where("words IS NOT NULL").select(by, F.explode(F.concat(*map(runs, range(1, most + 1)))).alias("r")).select(by, "r.*")
    every = every.where("size = 1 OR size(split(token, ' +')) = size")  # a null or empty word is in no phrase
    found = found_signs(every.select("token"), entries, synonyms, readings)
    hits = every.join(found, "token").withColumn("place", F.row_number().over(Window.partitionBy(by, "start").orderBy(F.desc("size")))).where("place = 1")
    ordered = hits.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("start", "size", "entry", "route"))).alias("hits"))  # of one sequence
    step = lambda s, h: F.when(h["start"] >= s["end"], F.struct((h["start"] + h["size"]).alias("end"), F.concat(s["taken"], F.array(h)).alias("taken"))).otherwise(s)
    begin = F.struct(F.lit(0).alias("end"), F.filter("hits", lambda h: F.lit(False)).alias("taken"))
    return ordered.select(by, F.explode(F.aggregate("hits", begin, step)["taken"]).alias("h")).select(by, "h.*")
