"""Column functions on Arabic text: keys, light stems, singulars, numbers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks over and under letters with the lengthening stroke; letters and digits and what they are folded to; clitics,
# endings and verb beginnings that a light stem loses; number words as keys.
MARKS = "ؐ-ًؚ-ٰٟۖ-ۭـ"
LETTERS, FOLDED = "آأإٱىةؤئ٠١٢٣٤٥٦٧٨٩", "اااايهوي0123456789"
PREFIXES = ("وال", "بال", "فال", "كال", "لل", "ال", "و", "ب", "ف", "ل")
SUFFIXES = ("كم", "هم", "ها", "نا", "ين", "ون", "ات", "ان", "ك", "ه", "ي")
VERB_PREFIXES = ("ا", "ي", "ت", "ن")
NUMBERS = {
    1: ("واحد", "واحده"), 2: ("اثنان", "اثنين", "اثنتان", "اثنتين"), 3: ("ثلاث", "ثلاثه"), 4: ("اربع", "اربعه"), 5: ("خمس", "خمسه"),
    6: ("ست", "سته"), 7: ("سبع", "سبعه"), 8: ("ثمان", "ثماني", "ثمانيه"), 9: ("تسع", "تسعه"), 10: ("عشر", "عشره"),
}


def _spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "[ \\t\\n\\r\\f\\x0b]+", " "))


def strip_marks(text: Column) -> Column:
    """Without marks and lengthening; letters stay as they are; null is empty."""
    return _spaced(F.regexp_replace(F.coalesce(text, F.lit("")), f"[{MARKS}]", ""))


def norm(text: Column) -> Column:
    """The key of a word or text: marks off, forms of alef, ya, ta and hamza seats folded, plain digits, all else a space."""
    return _spaced(F.regexp_replace(F.translate(strip_marks(text), LETTERS, FOLDED), "[^ء-ي0-9 ]", " "))


def spelling(text: Column) -> Column:
    """As a dictionary spells it: marks off, joining alef as alef, everything but letters and spaces dropped."""
    return F.trim(F.regexp_replace(F.translate(strip_marks(text), "ٱ", "ا"), "[^ء-ي ]", ""))


def _cut(word: Column, n: int, front: bool) -> Column:
    return F.substring(word, F.lit(n + 1), F.length(word) - n) if front else F.substring(word, F.lit(1), F.length(word) - n)


def _some(*columns: Column) -> Column:
    return F.filter(F.array(*columns), lambda x: x.isNotNull())


def _without_prefix(word: Column) -> Column:
    clitics = [F.when(word.startswith(p) & (F.length(word) - len(p) >= 2), _cut(word, len(p), True)) for p in PREFIXES]
    return _some(*clitics, F.when((F.length(word) >= 4) & F.substring(word, 1, 1).isin(*VERB_PREFIXES), _cut(word, 1, True)))


def _without_suffix(word: Column) -> Column:
    return _some(*[F.when(word.endswith(s) & (F.length(word) - len(s) >= 2), _cut(word, len(s), False)) for s in SUFFIXES])


def light_stems(word: Column) -> Column:
    """A normalised word, then what is left of it after two rounds that take off an ending or, once at most, a clitic or the letter
    that a verb begins with; the longest first, of equals the one found first.  An empty word has none."""
    fronts = F.array_distinct(_without_prefix(word))
    ends = F.array_except(_without_suffix(word), fronts)
    again = lambda found, rest: F.flatten(F.transform(found, rest))
    both = lambda w: F.concat(_without_prefix(w), _without_suffix(w))
    found = F.array_distinct(F.concat(fronts, ends, again(fronts, _without_suffix), again(ends, both)))
    ordered = F.array_sort(F.transform(found, lambda x, i: F.struct((-F.length(x)).alias("n"), i.alias("i"), x.alias("x"))))
    return F.when(word == "", F.array().cast("array<string>")).otherwise(F.concat(F.array(word), ordered["x"]))


def singulars(word: Column) -> Column:
    """What a regular ending stands for, of a normalised word."""
    n = F.length(word)
    return _some(
        F.when((n >= 5) & word.endswith("وات"), F.concat(_cut(word, 3, False), F.lit("اه"))),
        F.when((n >= 5) & word.endswith("ات"), F.concat(_cut(word, 2, False), F.lit("ه"))),
        F.when((n >= 5) & word.endswith("ات"), _cut(word, 2, False)),
        F.when((n >= 5) & (word.endswith("ون") | word.endswith("ين")), _cut(word, 2, False)),
        F.when((n >= 4) & word.endswith("ه"), _cut(word, 1, False)),
    )


def strict_forms(word: Column) -> Column:
    """Sorted forms by which two normalised words are compared: the word, its light stems of three letters or more, it without a
    last alef, and the singulars of all of these."""
    tanween = _some(F.when((F.length(word) >= 4) & word.endswith("ا"), _cut(word, 1, False)))
    long = lambda x: F.length(x) >= 3
    forms = F.concat(F.array(word), F.filter(light_stems(word), long), tanween)
    return F.sort_array(F.array_distinct(F.concat(forms, F.filter(F.flatten(F.transform(forms, singulars)), long))))


def number(word: Column) -> Column:
    """The digits of a number word from one to ten; null for any other word."""
    table = [F.lit(x) for n, words in NUMBERS.items() for w in words for x in (w, str(n))]
    return F.try_element_at(F.create_map(*table), word)


def fold_words(text: Column) -> Column:
    """A text's words for an evaluation: keys without the article where more than three letters stand, but for the divine name."""
    words = F.filter(F.split(norm(F.translate(text, "_", " ")), " "), lambda w: w != "")
    article = lambda w: (F.length(w) > 3) & w.startswith("ال") & (w != "الله")
    return F.transform(words, lambda w: F.when(article(w), _cut(w, 2, True)).otherwise(w))
