"""Column functions on text: normalisation, tokens, candidate forms, ids."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters that are one of A-Z, a-z or 0-9 with marks, or a form of one, with what they are folded to.
_DECOMPOSED = {c: "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)) for c in map(chr, [*range(0xAA, 0x250), *range(0x1E00, 0x1F00), *range(0xFF10, 0xFF5B)])}
LETTERS = {c: x for c, x in _DECOMPOSED.items() if x != c and len(x) == 1 and x.isascii() and x.isalnum()}
INSIDE, BEFORE, LETTER = "[‘’ʿʾ`]", "[‘ʿʾ`]", r"[\p{L}\p{N}_]"  # marks of ayn and hamza within a word and at its front
#: Latin letters with marks and what is left without them.
MARKED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"
# Endings with what stands for them, in the order in which they are tried; irregular forms; words without a sign.
SUFFIXES = (("ies", "y"), ("ied", "y"), ("ves", "f"), ("sses", "ss"), ("es", ""), ("s", ""), ("ing", ""), ("ing", "e"), ("ed", ""), ("ed", "e"), ("ly", ""))
IRREGULAR = {
    "is": "be", "are": "be", "was": "be", "were": "be", "been": "be", "am": "be", "has": "have", "had": "have", "did": "do", "does": "do",
    "done": "do", "went": "go", "gone": "go", "made": "make", "said": "say", "gave": "give", "given": "give", "came": "come", "knew": "know",
    "known": "know", "taught": "teach", "believed": "believe", "children": "child", "people": "person", "men": "man", "women": "woman",
    "better": "good", "best": "good", "prayed": "pray", "fasted": "fast",
}
STOPWORDS = tuple(
    """a an the is are am was were be been being to of and or but so that this these those it its there their they them he him his
    she her we us our you your i me my do does did done has have had having will would shall should can could may might must as at
    by for from in into on onto with about than then also very just which who whom whose what when where why how if""".split()
)


def words(text: Column) -> Column:
    """Lower-case words of a-z."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]+"), F.lit(0))


def norm_en(text: Column) -> Column:
    """Without marks on letters, marks of ayn and hamza within or before a word dropped, lower-case, possessives dropped, apostrophes within a word
    dropped, anything else than a-z, 0-9 a single space; null becomes empty."""
    x = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), "".join(LETTERS), "".join(LETTERS.values())), r"\p{Mn}", "")
    x = F.lower(F.regexp_replace(x, f"(?<={LETTER}){INSIDE}(?={LETTER})|(?<!{LETTER}){BEFORE}(?={LETTER})", ""))
    x = F.regexp_replace(F.regexp_replace(F.replace(x, F.lit("’"), F.lit("'")), f"'s(?!{LETTER})", ""), "(?<=[a-z])'(?=[a-z])", "")
    return F.trim(F.regexp_replace(x, "[^a-z0-9]+", " "))


def tok_en(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[^A-Za-z0-9'’]+"), lambda x: x != "")


def irregular_en(word: Column) -> Column:
    """What an irregular form is a form of; null for any other word."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in IRREGULAR.items() for x in pair)), word)


def candidates_en(word: Column) -> Column:
    """The word, what it is an irregular form of, each ending's form where at least three letters stay, then the word with a
    doubled consonant before -ing and -ed made single; in that order."""
    n = F.length(word)
    cut = lambda k: F.substring(word, F.lit(1), n - k)
    ruled = [F.when(word.endswith(s) & (n - len(s) >= 3), F.concat(cut(len(s)), F.lit(r))) for s, r in SUFFIXES]
    letter = lambda k: F.substring(word, n - k, F.lit(1))
    single = [F.when(word.endswith(s) & (n > len(s) + 3) & (letter(len(s)) == letter(len(s) + 1)), cut(len(s) + 1)) for s in ("ing", "ed")]
    return F.array_distinct(F.filter(F.array(word, irregular_en(word), *ruled, *single), lambda x: x.isNotNull()))


def term_en(word: Column) -> Column:
    """The word's index term: its last candidate."""
    return F.element_at(candidates_en(word), -1)


def least_form(forms: Column) -> Column:
    """The shortest form, of equals the first by text."""
    return F.array_min(F.transform(forms, lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"]


def norm_tr(text: Column) -> Column:
    """Dotted and dotless i are told apart before lower-casing."""
    return F.regexp_replace(F.lower(F.translate(text, "Iİ", "ıi")), "[^a-z0-9çğıöşüâîû ]", "")


def fold_tr(text: Column) -> Column:
    return F.translate(norm_tr(text), "âîû", "aiu")


def forms_tr(word: Column) -> Column:
    return F.array_distinct(F.array(word, F.substring(word, 1, 5)))


def norm_ur(text: Column) -> Column:
    return F.translate(text, "يكةأإآ", "یکہااا")


#: Plural and oblique endings.
URDU_ENDINGS = ("وں", "یں", "ات", "ے")


def forms_ur(word: Column) -> Column:
    """The word and it without one plural or oblique ending, where two letters stay."""
    cut = [F.when(word.endswith(s) & (F.length(word) - len(s) >= 2), F.substring(word, F.lit(1), F.length(word) - len(s))) for s in URDU_ENDINGS]
    return F.array_distinct(F.filter(F.array(word, *cut), lambda x: x.isNotNull()))


def gloss_key(gloss: Column) -> Column:
    return norm_en(F.regexp_replace(F.regexp_replace(gloss, "[_-]", " "), "[0-9]", ""))


def short_text(text: Column, most: int = 120) -> Column:
    """The first quoted span of 8 characters or more, else the text; spaces collapsed, cut with an ellipsis."""
    quoted = F.regexp_extract(text, '"([^"]{8,})"', 1)
    x = F.trim(F.regexp_replace(F.when(quoted != "", quoted).otherwise(text), "[ \n\t]+", " "))
    return F.when(F.length(x) > most, F.concat(F.rtrim(F.substring(x, 1, most - 1)), F.lit("…"))).otherwise(x)


def footnotes_removed(text: Column) -> Column:
    return F.regexp_replace(text, r"\[[0-9]+\]", "")


def natural_key(text: Column) -> Column:
    """(leading number or 10^9, rest)."""
    n = F.regexp_extract(text, "^([0-9]{1,9})", 1)
    return F.struct(F.when(n != "", n.cast("long")).otherwise(F.lit(10**9)).alias("number"), F.regexp_replace(text, "^[0-9]{1,9}", "").alias("rest"))


def sha_id(text: Column, digits: int = 8) -> Column:
    return F.substring(F.sha1(F.regexp_replace(text, "\r\n", "\n")), 1, digits)


def split_name(bucket: Column) -> Column:
    """0 is test, 1 is validation, the others train."""
    return F.when(bucket == 0, "test").when(bucket == 1, "val").otherwise("train")


def cited_sentences(text: Column) -> Column:
    """Pieces before [1,2] markers as array of (sentence, refs); what follows the last marker comes first, uncited."""
    parts = F.regexp_extract_all(text, F.lit(r"([^\[\]]+)\[([0-9, ]+)\]"), F.lit(1))
    refs = F.regexp_extract_all(text, F.lit(r"([^\[\]]+)\[([0-9, ]+)\]"), F.lit(2))
    cited = F.zip_with(parts, refs, lambda p, r: F.struct(F.trim(F.regexp_replace(p, r"^[ .]+", "")).alias("sentence"), F.regexp_replace(r, " ", "").alias("refs")))
    rest = F.trim(F.regexp_replace(F.regexp_replace(text, r"([^\[\]]+)\[([0-9, ]+)\]", ""), r"^[ .]+", ""))
    uncited = F.when(rest != "", F.array(F.struct(rest.alias("sentence"), F.lit("").alias("refs")))).otherwise(F.filter(cited, lambda x: F.lit(False)))
    proper = lambda x: F.size(F.regexp_extract_all(x["sentence"], F.lit("[A-Za-z]{2,}"), F.lit(0))) >= 3
    return F.filter(F.concat(uncited, cited), proper)


# An item of a model's answer; words that ask for a ruling.
ITEM = r'\{\s*"text"\s*:\s*"((?:[^"\\]|\\.)*)"\s*,\s*"oov"\s*:\s*(true|false)\s*\}'
RULING = (
    r"\b(halal|haram|makruh|fatwa|permissible|permitted|forbidden|prohibited|allowed|sinful|"
    r"is it (?:ok|okay|wrong|a sin)|can (?:i|muslims|a muslim|we)|may (?:i|muslims|a muslim))\b"
)


def salvaged_items(raw: Column) -> Column:
    """The items (text, oov) of an answer that holds {"glosses": [...]}; where that isn't well-formed (a comma is missing, the end is cut off), the
    well-formed items one by one, in order.  Null has none."""
    raw = F.coalesce(raw, F.lit(""))
    whole = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    parsed = F.from_json(whole, "glosses array<struct<text: string, oov: boolean>>", {"mode": "PERMISSIVE"})["glosses"]
    texts = F.transform(F.regexp_extract_all(raw, F.lit(ITEM), F.lit(1)), lambda t: F.get(F.from_json(F.concat(F.lit('["'), t, F.lit('"]')), "array<string>"), F.lit(0)))
    flags = F.transform(F.regexp_extract_all(raw, F.lit(ITEM), F.lit(2)), lambda o: o == "true")
    return F.coalesce(parsed, F.arrays_zip(texts.alias("text"), flags.alias("oov")))


def asks_ruling(text: Column) -> Column:
    """Whether a question asks for a ruling; null doesn't."""
    return F.coalesce(text, F.lit("")).rlike("(?i)" + RULING)
