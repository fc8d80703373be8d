"""Quality classifier by co-training of two views of a page.

The text view sees which words, beginnings of words and mark runs occur and a few shape buckets; the metadata view sees source, language and length.
Both are logistic regressions.  They start from a bounded sample of labelled documents (``labelled`` different texts, picked by a
hash of the id).  In each round both score every document without a label, and the ``each`` documents of either class that one
view is surest of become pseudo-labelled examples of the *other* view.  At the end each view is calibrated on labelled documents
held out from training, and the calibrated views are combined by their log-odds (less the prior, which both contain) into one
score for every document.

Features are found once and written as 16-bit gaps (two bytes each); a round is a map over that table, an aggregate by text
(equal texts count once, so a large group of copies is picked once) and four top lists.  A view is fitted in one task, on the
bounded sample and the picks; its weights other than zero come to the driver, some 10,000 numbers.

A document is good if its quality is 1 and it isn't toxic; it is kept if its score is ``keep`` or more.

Nulls: a null or empty text has no text features and scores by its metadata and the prior; null metadata are values of their own.
Labels with a null count as unlabelled, of repeated labels of an id the worse holds.  Without labels of both kinds every score is
0.5 and everything is kept.  Equal rows have equal scores, each its own row; ties among the surest go by a hash of the text.  An
empty table gives an empty result.  Only the columns named are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrid.llm.shared import written

BITS = 20
META_BITS = 10
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
MARKS = bytes(32 if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 or c < 33 else c for c in range(256))
UPPER = bytes(range(65, 91))
#: Bytes of the beginnings of words that are features as well.
STEMS = (6, 7, 8)


def _hash(x: bytes | str, bits: int) -> int:
    return xxhash.xxh3_64_intdigest(x) >> (64 - bits)


def text_features(text: bytes) -> np.ndarray:
    """Sorted distinct hashed features of a whole text."""
    words, marks = text.translate(LETTERS).split(), text.translate(MARKS).split()
    kinds = set(words)
    n = max(1, len(text))
    upper = n - len(text.translate(None, UPPER))
    shape = (f"#upper{round(8 * upper / n)}", f"#mark{round(16 * sum(map(len, marks)) / n)}", f"#kinds{round(8 * len(kinds) / max(1, len(words)))}", f"#size{len(words).bit_length()}") if text else ()
    stems = {b"^" + w[:k] for w in kinds for k in STEMS if len(w) > k}  # compounds and endings share them
    return np.unique(np.fromiter((_hash(x, BITS) for x in (*kinds, *stems, *set(marks), *shape)), np.int64))


def meta_features(source: str | None, lang: str | None, chars: int | None) -> np.ndarray:
    size = -1 if chars is None or chars != chars else int(chars).bit_length()
    return np.unique([_hash(x, META_BITS) for x in (f"s{source}", f"l{lang}", f"n{size}", f"l{lang}n{size}")])


def to_gaps(features: np.ndarray) -> bytes:
    """Sorted distinct features as 16-bit gaps less one; 65535 stands for as much without an end."""
    more, rest = np.divmod(np.diff(features, prepend=-1) - 1, 65535)
    out = np.full(len(rest) + int(more.sum()), 65535, "<u2")
    out[np.cumsum(more + 1) - 1] = rest
    return out.tobytes()


def from_gaps(rows: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(feature, row) of all rows."""
    rows = list(rows)
    raw = np.frombuffer(b"".join(rows), "<u2").astype(np.int64)
    size = np.fromiter(map(len, rows), np.int64, len(rows)) // 2
    row, end = np.repeat(np.arange(len(rows), dtype=np.int32), size), raw != 65535
    at = np.cumsum(raw + end)
    first = np.cumsum(size) - size
    before = np.where(size > 0, np.append(0, at)[first], 0)
    return (at - before[row] - 1)[end].astype(np.int32), row[end]


class Logistic:
    """Logistic regression over sets of features, full-batch with per-feature step sizes; features that don't tell the classes
    apart (G statistic below ``least``) get no weight."""

    def __init__(self, size: int, least: float = 12.0, decay: float = 1e-3, steps: int = 200):
        self.size, self.least, self.decay, self.steps = size, least, decay, steps
        self.weight, self.bias = np.zeros(size, np.float32), 0.0

    def fit(self, flat: np.ndarray, row: np.ndarray, y: np.ndarray) -> Logistic:
        good, all_ = np.bincount(flat, y[row], self.size), np.bincount(flat, minlength=self.size)
        share = y.mean()
        bad = all_ - good
        with np.errstate(divide="ignore", invalid="ignore"):
            g = 2 * (np.where(good > 0, good * np.log(good / (all_ * share)), 0) + np.where(bad > 0, bad * np.log(bad / (all_ * (1 - share))), 0))
        use = np.flatnonzero(np.nan_to_num(g) >= self.least)
        place = np.full(self.size, -1, np.int32)
        place[use] = np.arange(len(use))
        flat = place[flat]
        flat, row = flat[flat >= 0], row[flat >= 0]
        w, b = np.zeros(len(use)), float(np.log(share / (1 - share)))
        step_w, step_b = np.full(len(use), 1e-8), 1e-8
        for _ in range(self.steps):
            z = b + np.bincount(row, w[flat], len(y))
            r = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
            grad = np.bincount(flat, r[row], len(use)) + self.decay * len(y) * w
            step_w += grad**2
            step_b += r.sum() ** 2
            w -= 0.5 * grad / np.sqrt(step_w)
            b -= 0.5 * r.sum() / np.sqrt(step_b)
        self.weight[use], self.bias = w, b
        return self

    def logit(self, flat: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        return self.bias + np.bincount(row, self.weight[flat], rows)


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a, b of the calibrated log-odds a*z+b, by Newton steps with a weak prior towards a = 1, b = 0."""
    ab, x = np.array([1.0, 0.0]), np.stack([np.clip(z, -30, 30), np.ones(len(z))], axis=1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -30, 30)))
        grad = x.T @ (p - y) + (ab - [1.0, 0.0])
        ab -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(2), grad)
    return float(ab[0]), float(ab[1])


#: Of each view: the number of features and the least G statistic of one with a weight.
VIEWS = {"text": (1 << BITS, 12.0), "meta": (1 << META_BITS, 6.0)}
FITTED = "view string, bias double, feature array<int>, weight array<float>, slope double, shift double, prior double"


def held_out(labelled: int) -> np.ndarray:
    """Which labelled rows, in the order of their keys, are kept from training for the calibration."""
    return np.arange(labelled) % 5 == 4


def fit_view(rows: pd.DataFrame) -> pd.DataFrame:
    """One view's model from all its examples (view, key, y, pseudo, features); no row if the labels are of one class."""
    rows = rows.sort_values(["pseudo", "key"], ignore_index=True)  # labelled ones first
    y, pseudo = rows["y"].to_numpy(float), rows["pseudo"].to_numpy(bool)
    known = y[~pseudo]
    if not 0 < known.sum() < len(known):
        return pd.DataFrame([], columns=["view", "bias", "feature", "weight", "slope", "shift", "prior"])
    held = held_out(len(known))
    if len(set(known[held])) < 2 or len(set(known[~held])) < 2:
        held[:] = False
    size, least = VIEWS[rows["view"].iloc[0]]
    flat, row = from_gaps(rows["features"])
    use = np.append(~held, np.ones(int(pseudo.sum()), bool))
    turn = (np.cumsum(use) - 1).astype(np.int32)
    mine = use[row]
    model = Logistic(size, least).fit(flat[mine], turn[row[mine]], y[use])
    judge = np.append(held if held.any() else ~held, np.zeros(int(pseudo.sum()), bool))
    slope, shift = _platt(model.logit(flat, row, len(rows))[judge], y[judge])
    some = np.flatnonzero(model.weight)
    return pd.DataFrame([{"view": rows["view"].iloc[0], "bias": model.bias, "feature": some.astype(np.int32), "weight": model.weight[some], "slope": slope, "shift": shift, "prior": float(np.log(known.mean() / (1 - known.mean())))}])


class CoTrained:
    """Both views, calibrated; ``models``: the rows of ``fit_view``."""

    def __init__(self, models: list):
        self.models = {m["view"]: m for m in models}
        self.known = len(self.models) == len(VIEWS)

    def logits(self, text: list[bytes], meta: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Uncalibrated log-odds of both views; rows of gaps."""
        out = []
        for name, rows in (("text", text), ("meta", meta)):
            weight = np.zeros(VIEWS[name][0], np.float32)
            weight[self.models[name]["feature"]] = self.models[name]["weight"]
            flat, row = from_gaps(rows)
            out.append(self.models[name]["bias"] + np.bincount(row, weight[flat], len(rows)))
        return out[0], out[1]

    def scores(self, text: list[bytes], meta: list[bytes]) -> pd.DataFrame:
        """Calibrated probabilities of text view, metadata view and both."""
        if not self.known:
            return pd.DataFrame({n: np.full(len(text), 0.5) for n in ("text", "meta", "both")})
        zt, zm = (self.models[n]["slope"] * z + self.models[n]["shift"] for n, z in zip(("text", "meta"), self.logits(text, meta), strict=True))
        z = {"text": zt, "meta": zm, "both": zt + zm - self.models["text"]["prior"]}
        return pd.DataFrame({n: 1 / (1 + np.exp(-np.clip(x, -60, 60))) for n, x in z.items()})


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in batches:
        yield pd.DataFrame({
            "doc_id": f["doc_id"], "text": [to_gaps(text_features(x)) for x in f["text"]],
            "meta": [to_gaps(meta_features(*x)) for x in zip(f["source"], f["lang"], f["chars"], strict=True)],
        })


def _seen() -> tuple[Column, ...]:
    return F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"), F.col("source"), F.col("lang"), F.length("text").alias("chars")


def found_features(docs: DataFrame) -> DataFrame:
    """doc_id, text, meta: both views' features as gaps; key: of both; written."""
    rows = docs.select(F.col("doc_id").cast("long"), *_seen()).mapInPandas(_features, "doc_id long, text binary, meta binary")
    return written(rows.withColumn("key", F.xxhash64("text", "meta")), "quality_features")


def train(features: DataFrame, labels: DataFrame, labelled: int = 12_000, rounds: int = 3, each: int = 300, sure: float = 0.97) -> CoTrained:
    """Fit both views on at most ``labelled`` labelled texts and ``rounds`` times ``each`` pseudo-labelled ones of a class."""
    spark = features.sparkSession
    good = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.min((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("double").alias("y"))
    marked = written(features.select("doc_id", "key").join(good, "doc_id").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.min("y").alias("y")), "quality_marked")
    picked = marked.orderBy(F.xxhash64("doc_id"), "doc_id", "key").limit(labelled).select("key", "y")

    def examples(keys: DataFrame) -> DataFrame:  # keys: at most ``labelled`` rows of 16 bytes
        return features.join(F.broadcast(keys), "key").groupBy("key", "y").agg(F.min("text").alias("text"), F.min("meta").alias("meta"))

    def of(view: str, rows: DataFrame, pseudo: bool) -> DataFrame:
        return rows.select(F.lit(view).alias("view"), "key", "y", F.lit(pseudo).alias("pseudo"), F.col(view).alias("features"))

    sample = written(examples(picked), "quality_sample")
    given: dict[str, dict[int, float]] = {v: {} for v in VIEWS}  # key -> pseudo-label from the other view
    fed = of("text", sample, False).union(of("meta", sample, False))
    for turn in range(rounds + 1):
        model = CoTrained(fed.groupBy("view").applyInPandas(fit_view, FITTED).collect())
        if turn == rounds or not model.known:
            return model

        def score(batches: Iterator[pd.DataFrame], model: CoTrained = model) -> Iterator[pd.DataFrame]:
            for f in batches:
                yield pd.DataFrame({"key": f["key"], **dict(zip(VIEWS, model.logits(list(f["text"]), list(f["meta"])), strict=True))})

        scored = features.select("key", "text", "meta").mapInPandas(score, "key long, text double, meta double")
        pool = scored.groupBy("key").agg(*(F.min(v).alias(v) for v in VIEWS))
        pool = written(pool.join(marked.select("key"), "key", "left_anti"), "quality_pool")
        edge = float(np.log(sure / (1 - sure)))
        for view, other in (("text", "meta"), ("meta", "text")):
            rest, new = pool.where(~F.col("key").isin(list(given[other]))), {}
            for label, side in ((0.0, -F.col(view)), (1.0, F.col(view))):
                top = rest.where(side >= edge).orderBy(side.desc(), "key").limit(each)
                new |= {r.key: label for r in top.select("key").collect()}
            given[other] |= new
            if new:
                keys = spark.createDataFrame(list(new.items()), "key long, y double")
                fed = fed.union(of(other, written(examples(keys), "quality_given"), True))


def score_column(model: CoTrained) -> Column:
    """struct(text, meta, both) for each row of a table with text, source, lang."""

    @F.pandas_udf("text double, meta double, both double")
    def score(text: pd.Series, source: pd.Series, lang: pd.Series, chars: pd.Series) -> pd.DataFrame:
        return model.scores([to_gaps(text_features(x)) for x in text], [to_gaps(meta_features(*x)) for x in zip(source, lang, chars, strict=True)])

    return score(*_seen())


def quality_scores(docs: DataFrame, labels: DataFrame, keep: float = 0.5) -> DataFrame:
    """Per document: doc_id, text_score, meta_score, score, kept."""
    features = found_features(docs)
    model = train(features, labels)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            s = model.scores(list(f["text"]), list(f["meta"]))
            yield pd.DataFrame({"doc_id": f["doc_id"], "text_score": s["text"], "meta_score": s["meta"], "score": s["both"], "kept": s["both"] >= keep})

    return features.select("doc_id", "text", "meta").mapInPandas(score, "doc_id long, text_score double, meta_score double, score double, kept boolean")


def keep_good(docs: DataFrame, labels: DataFrame, keep: float = 0.5) -> DataFrame:
    """``docs`` without those that score below ``keep``; all columns stay."""
    model = train(found_features(docs), labels)
    return docs.select(F.struct("*").alias("row"), score_column(model).alias("score")).where(F.col("score.both") >= keep).select("row.*")
