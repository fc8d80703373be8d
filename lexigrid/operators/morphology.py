"""Readings of words, as an analyser gives them, ranked and picked for all words at once.

Readings are tables with a row for each reading of a word; what is picked depends on a word's readings alone, so everything is a
window over one word.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Morphemes after which a word doesn't mean its lemma; parts of speech that win outright, and the order of others.
BLOCKING = (
    "Neg", "Unable", "WithoutHavingDoneSo", "WithoutBeingAbleToHaveDoneSo", "NotState", "Caus", "Without", "With", "Ness", "Agt", "Dim",
    "Related", "JustLike", "Ly", "FitFor", "Rel", "Become", "Acquire", "Ord", "Dist", "Recip", "Reflex", "InTermsOf", "Hastily",
    "EverSince", "Almost", "Stay", "Start", "Repeat", "Since", "ActOf", "Inf3",
)
CLOSED = ("Conj", "Pron", "Postp", "Det", "Ques", "Num")
PLAIN = ("Noun", "Verb", "Adj", "Adv")
NOMINAL, SINGULAR = ("noun", "adj", "noun_quant", "adj_comp", "noun_num"), ("noun", "adj", "noun_quant", "adj_comp")
UNKNOWN = -99.0
# Endings of Turkish words; A is a or e, I any of ı i u ü, D d or t, C c or ç.
ENDINGS = """lAr I yI nI A yA nA DA nDA DAn nDAn In nIn Im m Iz ImIz mIz InIz nIz sI lArI ylA lA DIr ki ken yken DI mIş yDI ymIş Ir Ar r
AcAk yAcAk AcAğ yAcAğ Iyor yor mAlI sA ysA mA mAk mAsI DIk DIğ An yAn Ip yIp IncA yIncA ArAk yArAk sIn sInlAr lIm yIm yIz k Il n Iş
Abil yAbil mAz AmAz yAmAz lIk lI sIz cI CA dAş sAl y Iniz nIzI mAyA mAdAn mAklA AlIm AsI""".split()
LETTERS = {"A": "ae", "I": "ıiuü", "D": "dt", "C": "cç"}


def ranked_lemmas(readings: DataFrame, most: int = 5) -> DataFrame:
    """(word, lex, place): of each word's noun and adjective readings (word, pos, lex, lp) the best ``most`` lemmas by their best log
    probability, then by text.  A word that can be read as a verb and as no nominal has none."""
    by = Window.partitionBy("word")
    verb, nominal = F.max(F.col("pos") == "verb").over(by), F.max(F.col("pos").isin(*NOMINAL)).over(by)
    some = readings.withColumn("verb_only", verb & ~nominal).where(~F.col("verb_only") & F.col("pos").isin(*SINGULAR) & (F.col("lex") != ""))
    best = some.groupBy("word", "lex").agg(F.max("lp").alias("lp"))
    place = F.row_number().over(by.orderBy(F.desc("lp"), "lex"))
    return best.withColumn("place", place).where(F.col("place") <= most).select("word", "lex", "place")


def likeliest(readings: DataFrame) -> DataFrame:
    """The readings that share a word's best log probability; none where the analyser knows no frequency of the word."""
    best = F.max("lp").over(Window.partitionBy("word"))
    return readings.withColumn("best", best).where((F.col("lp") == F.col("best")) & (F.col("best") > UNKNOWN)).drop("best")


def usable_lemmas(readings: DataFrame) -> DataFrame:
    """(word, lemma, place): the lemmas of readings (word, n, lemma, pos, morphs, proper) that keep their lemma's meaning and need
    the fewest zero derivations; if one is of a closed class, of closed classes only.  Plain readings come first: by derivations,
    names last, by part of speech, by number of morphemes, as given (n)."""
    morphs = F.split("morphs", r"\+")
    zero = F.size(F.filter(morphs, lambda m: m == "Zero"))
    kept = readings.where(~F.arrays_overlap(morphs, F.array(*map(F.lit, BLOCKING)))).withColumns({"zero": zero, "long": F.size(morphs), "closed": F.col("pos").isin(*CLOSED)})
    by = Window.partitionBy("word")
    kept = kept.withColumn("least", F.min("zero").over(by)).where("zero = least")
    kept = kept.withColumn("any_closed", F.max("closed").over(by)).where("closed OR NOT any_closed")
    kind = F.coalesce(*(F.when(F.col("pos") == p, k) for k, p in enumerate(PLAIN)), F.lit(len(PLAIN)))
    first = kept.groupBy("word", "lemma").agg(F.min(F.struct("zero", F.col("proper").cast("int"), kind.alias("kind"), "long", "n")).alias("rank"))
    return first.select("word", "lemma", F.row_number().over(by.orderBy("rank")).alias("place"))


def endings() -> set[str]:
    return {"".join(x) for e in ENDINGS for x in product(*(LETTERS.get(c, c) for c in e))}


def is_inflection(rest: Column) -> Column:
    """Whether what follows a stem splits wholly into endings: for each place in turn whether it can be reached, the last few
    places as bits."""
    by_size: dict[int, list[str]] = {}
    for e in sorted(endings()):
        by_size.setdefault(len(e), []).append(e)

    def step(state: Column, end: Column) -> Column:
        reached = [F.substring(rest, end - n + 1, F.lit(n)).isin(*some) & (end >= n) & (F.shiftright(state, n - 1).bitwiseAND(1) == 1) for n, some in by_size.items()]
        here = reached[0]
        for r in reached[1:]:
            here = here | r
        return F.shiftleft(state.bitwiseAND(0xFFFFFF), 1).bitwiseOR(F.when(here, 1).otherwise(0))

    places = F.when(F.length(rest) > 0, F.sequence(F.lit(1), F.length(rest))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, F.lit(1), step).bitwiseAND(1) == 1
