"""Finding a short series in long ones, pauses and repetitions of a series, and fixed formulas in texts."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from lexigrid.operators import alignment as A


def stretches(query: np.ndarray, many: list[np.ndarray]) -> list[tuple[int, int, float]]:
    """(start, end, cost for each point of the query) of the best stretch of each series: time warping that may begin and end anywhere."""
    begin, end, cost = warped_open(query[:, None], _columns(many))
    return [(int(b), int(e), float(c)) for b, e, c in zip(begin, end, cost, strict=True)]


def _columns(many: list[np.ndarray]) -> np.ndarray:
    """Series as columns, filled up with inf."""
    out = np.full((max(map(len, many)), len(many)), np.inf)
    for k, s in enumerate(many):
        out[: len(s), k] = s
    return out


def warped_open(query: np.ndarray, series: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, cost for each point of the query) of the best stretch of each pair of columns; one side may have one column for all pairs.

    All pairs go through the table together, one diagonal at a time, of which the last three are held.  Of equal ways the one over both comes before
    the one over the query, and this before the one over the series; of equal ends the first."""
    (m, width), pairs = (len(query), len(series)), max(query.shape[1], series.shape[1])
    best, begin = np.full((3, m + 1, pairs), np.inf), np.zeros((3, m + 1, pairs), np.int64)  # by row of the table
    best[:, 0] = 0
    back = series[::-1]  # so that a diagonal is a slice
    least, first, end = np.full(pairs, np.inf), np.zeros(pairs, np.int64), np.ones(pairs, np.int64)
    for t in range(1, m + width + 1):  # row i, column t - i
        now, one, two = t % 3, (t - 1) % 3, (t - 2) % 3
        lo, hi = max(1, t - width), min(m, t - 1)
        best[now, 1:lo], best[now, max(lo, hi + 1) :], begin[now, 0] = np.inf, np.inf, t
        if lo <= hi:
            way, src = best[two, lo - 1 : hi], begin[two, lo - 1 : hi]
            for other, came in ((best[one, lo - 1 : hi], begin[one, lo - 1 : hi]), (best[one, lo : hi + 1], begin[one, lo : hi + 1])):
                less = other < way
                way, src = np.where(less, other, way), np.where(less, came, src)
            best[now, lo : hi + 1], begin[now, lo : hi + 1] = way + np.abs(query[lo - 1 : hi] - back[width - t + lo : width - t + hi + 1]), src
        if t > m:
            less = best[now, m] < least
            least[less], first[less], end[less] = best[now, m][less], begin[now, m][less], t - m
    return first, end, least / m


class Rounded:
    """Series as columns, the longest first, which bound what a query's best stretch costs: the same table in whole numbers of 16 bits, or of 32 where these are
    too coarse."""

    def __init__(self, columns: np.ndarray):
        self.back = np.ascontiguousarray(columns[::-1])
        self.least, self.top = columns.min(axis=0), np.where(np.isfinite(columns), columns, -np.inf).max(axis=0)
        self.size_of = np.isfinite(columns).sum(axis=0)
        self.low, self.size = float(self.least.min()), float(self.top.max() - self.least.min())
        self.short = (self.back - self.low).astype(np.float32)

    def bounds(self, query: np.ndarray, most: float) -> np.ndarray:
        """At least so much does each column's best stretch cost in all.  Columns whose values lie too far from the query's to cost ``most`` or less aren't warped."""
        outside = np.maximum(0, np.maximum(self.least - query[:, None], query[:, None] - self.top)).sum(axis=0)
        near = np.flatnonzero(outside <= most * (1 + 1e-9) + 1e-12)
        if len(near) > 0.8 * len(outside):
            return self._warped(query, most, slice(None))
        outside[near] = self._warped(query, most, near) if len(near) else 0
        return outside

    def _warped(self, query: np.ndarray, most: float, which: np.ndarray | slice) -> np.ndarray:
        m, width = len(query), len(self.back)
        cap = 1.5 * max(most, 1e-6 * max(1.0, float(np.abs(query).max())))  # further away is as good as there
        lo, hi = float(query.min()) - cap, float(query.max()) + cap
        unit = lambda top: m * (hi - lo) / top  # noqa: E731  # sums are at most m times the largest difference
        steps = m + width  # cells of a path at most, each wrong by less than one
        small = m <= 500 and steps * unit(32_000) <= 0.2 * most
        kind, u = (np.int16, unit(32_000)) if small else (np.int32, unit(2_000_000_000))
        if small and self.size * 1e-4 < u:
            x = np.clip(self.short[:, which], np.float32(lo - self.low), np.float32(hi - self.low))
            x -= np.float32(lo - self.low)
        else:
            x = np.clip(self.back[:, which], lo, hi) - lo
        x *= x.dtype.type(1 / u)
        total = _rounded_open(((query - lo) / u).astype(kind), np.maximum(x, 0, out=x).astype(kind), self.size_of[which])
        return (total - (1.05 * steps + 1.0)) * u


def _rounded_open(query: np.ndarray, back: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The best stretch's cost of each column, in whole numbers; columns run backwards and are left as soon as they end."""
    (m, width), n = (len(query), len(back)), back.shape[1]
    none = np.iinfo(back.dtype).max
    two, one, now = (np.full((m + 1, n), none, back.dtype) for _ in range(3))
    two[0] = one[0] = now[0] = 0
    cost, least, query = np.empty((m, n), back.dtype), np.full(n, none, back.dtype), np.repeat(query[:, None], n, axis=1)
    going = n - np.searchsorted(size[::-1], np.arange(width), side="right")  # columns with more points than so many
    for t in range(m + width - 1):
        lo, hi = max(0, t - width + 1), min(m, t + 1)
        k = going[t - hi + 1]
        c, here, before = cost[: hi - lo, :k], now[lo + 1 : hi + 1, :k], one[lo : hi + 1, :k]
        np.subtract(query[lo:hi, :k], back[width - 1 - t + lo : width - 1 - t + hi, :k], out=c)
        np.abs(c, out=c)
        np.minimum(two[lo:hi, :k], before[:-1], out=here)  # the way over the query is always there, so ``none`` is never added to
        np.minimum(here, before[1:], out=here)
        np.add(here, c, out=here)
        if hi == m:
            np.minimum(least[:k], now[m, :k], out=least[:k])
        two, one, now = one, now, two
    return least


LONG = 4096


class _Best:
    """The best stretch of each query so far, (cost, series, start, end), and how many series it was warped with."""

    def __init__(self, queries: list[np.ndarray]):
        self.queries, n = queries, len(queries)
        self.cost, self.place, self.warped = np.full(n, np.inf), np.zeros((n, 3), np.int64), np.zeros(n, np.int64)
        self.alike = {m: np.flatnonzero([len(q) == m for q in queries]) for m in {len(q) for q in queries}}
        self.columns, self.column = {}, np.zeros(n, np.int64)
        for m, at in self.alike.items():
            self.columns[m], self.column[at] = np.stack([queries[i] for i in at], axis=1), np.arange(len(at))

    def warp(self, asked: np.ndarray, met: np.ndarray, ids: np.ndarray, columns: np.ndarray) -> None:
        """Pairs of a query and a column of series, some at a time."""
        size = np.fromiter((len(self.queries[i]) for i in asked), np.int64, len(asked))
        for m in np.unique(size):
            which, step = np.flatnonzero(size == m), max(1, 1_000_000 // (len(columns) + 8 * int(m)))
            for s in range(0, len(which), step):
                i, k = asked[which[s : s + step]], met[which[s : s + step]]
                one = columns.shape[1] == 1
                self.take(i, ids[k], *warped_open(self.columns[m][:, self.column[i]], columns if one else columns[:, k]))

    def take(self, i: np.ndarray, ids: np.ndarray, begin: np.ndarray, end: np.ndarray, cost: np.ndarray) -> None:
        self.warped += np.bincount(i, minlength=len(self.warped))
        order = np.lexsort((end, begin, ids, cost, i))
        for k in order[np.flatnonzero(np.diff(i[order], prepend=-1))]:
            if (cost[k], ids[k], begin[k], end[k]) < (self.cost[i[k]], *self.place[i[k]]):
                self.cost[i[k]], self.place[i[k]] = cost[k], (ids[k], begin[k], end[k])

    def search(self, ids: np.ndarray, series: list[np.ndarray], rows: int = 128) -> None:
        """All queries in all series."""
        every = np.arange(len(self.queries))
        order = sorted(range(len(series)), key=lambda k: len(series[k]))
        while order and len(series[order[-1]]) > LONG:  # one by one, with all queries at once
            k = order.pop()
            self.warp(every, np.zeros(len(every), np.int64), ids[k : k + 1], series[k][:, None])
        while order:
            n = max(1, min(len(order), 1_000_000 // len(series[order[-1]]), 4096))
            part, order = order[-n:][::-1], order[:-n]
            names, columns = ids[part], _columns([series[k] for k in part])
            first = np.unique(np.linspace(0, n - 1, min(16, 1 + n // 64)).astype(np.int64))  # some that lie apart, for a cost to begin with
            self.warp(np.repeat(every, len(first)), np.tile(first, len(every)), names, columns)
            if len(first) == n:
                continue
            rounded = Rounded(columns)
            for s in range(0, len(every), rows):
                at = every[s : s + rows]
                total = lambda: np.array([self.cost[i] * len(self.queries[i]) for i in at]) * (1 + 1e-9) + 1e-12  # noqa: B023, E731
                bound = np.stack([rounded.bounds(self.queries[i], most) for i, most in zip(at, total(), strict=True)])
                bound[:, first] = np.inf
                lowest, row = bound.argmin(axis=1), np.arange(len(at))
                go = bound[row, lowest] <= total()
                self.warp(at[go], lowest[go], names, columns)
                bound[row, lowest] = np.inf
                i, k = np.nonzero(bound <= total()[:, None])
                self.warp(at[i], k, names, columns)


def best_stretches(queries: DataFrame, series: DataFrame, block: int = 8192) -> DataFrame:
    """queries (query, points) and series (series, points), ids numbers -> (query, series, start, end, cost, pairs, warped) of each query's best
    stretch; of equal costs the smallest series, then the first end.

    Equal series stand once, by their smallest id, and equal queries are looked up once.  The queries are a stated set, held in blocks of some hundreds and met
    by blocks of some ``block`` series, fewer if they are long.  A block's pairs are bounded below by envelopes of values and by the table of their warping in small whole
    numbers, all series at once; those within the best cost so far are warped with their numbers, ``warped`` of ``pairs``.  Series of more than 4096 points are
    warped with all queries at once, unbounded.
    Only a block's best of each query is shuffled.  Points that are empty, null or not all finite find nothing and are found by none.
    """
    some = lambda df: df.where((F.size("points") > 0) & F.forall("points", lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False))))
    asked = A.distinct_points(some(queries), "query", "points")
    held = A.packed_points(A.distinct_points(some(series), "series", "points"), "series", block, dealt=True, points=block * 128)
    met = held.crossJoin(A.packed_points(asked, "query", 128, dealt=True).hint("shuffle_replicate_nl"))  # a task for each pair of blocks

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for some, asked in zip(frame["series"], frame["query"], strict=True):
                best = _Best([np.asarray(q["points"], float) for q in asked])
                best.search(np.array([r["id"] for r in some], np.int64), [np.asarray(r["points"], float) for r in some])
                out = pd.DataFrame({"rep": [q["id"] for q in asked], "series": best.place[:, 0], "start": best.place[:, 1], "end": best.place[:, 2], "cost": best.cost})
                yield out.assign(pairs=sum(r["n"] for r in some), warped=best.warped)

    found = met.mapInPandas(work, "rep long, series long, start int, end int, cost double, pairs long, warped long")
    best = F.min(F.struct("cost", "series", "start", "end")).alias("b")
    found = found.groupBy("rep").agg(best, F.sum("pairs").alias("pairs"), F.sum("warped").alias("warped"))
    members = some(queries).select("query", "points").join(asked, "points").select("query", F.col("id").alias("rep"))
    return members.join(found, "rep").select("query", "b.series", "b.start", "b.end", "b.cost", "pairs", "warped")


def located(frames: DataFrame, clips: DataFrame, length: int, parts: int = 4, most: int = 20) -> DataFrame:
    """frames (item, f, value), f from 0 without gaps, and clips (item, k, value) of ``length`` points -> (item, start, distance, scored).

    Where an item's clip best fits its frames, each window on a scale of its own (less its mean, by its deviation): first every offset by the means of
    ``parts`` parts of the window, all from running sums; then the best ``most`` point by point.  Of equal scores the first offset.  Items
    shorter than the clip have none."""
    by, width = Window.partitionBy("item").orderBy("f"), length // parts
    deviation = lambda c: F.greatest(F.stddev_pop(c), F.lit(1e-9))
    clip = clips.groupBy("item").agg(F.avg("value").alias("cm"), deviation("value").alias("cs"))
    normal = clips.join(clip, "item").select("item", "k", ((F.col("value") - F.col("cm")) / F.col("cs")).alias("c"))
    means = normal.groupBy("item").agg(*[F.avg(F.when(F.floor(F.col("k") / width) == p, F.col("c"))).alias(f"c{p}") for p in range(parts)])
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    sums = frames.select("item", "f", "value", F.sum("value").over(upto).alias("s"), F.sum(F.col("value") * F.col("value")).over(upto).alias("q"))

    def over(column: str, of: Column, a: int, b: int) -> Column:
        """The sum of ``of`` from a to before b rows on, of which ``column`` is the running sum."""
        return F.lead(column, b - 1).over(by) - (F.col(column) - of if a == 0 else F.lead(column, a - 1).over(by))

    v = F.col("value")
    marks = sums.select("item", "f", *[(over("s", v, p * width, (p + 1) * width) / width).alias(f"m{p}") for p in range(parts)], (over("s", v, 0, length) / length).alias("m"), (over("q", v * v, 0, length) / length).alias("q"))
    scaled = marks.where("m is not null").withColumn("d", F.greatest(F.sqrt(F.greatest(F.col("q") - F.col("m") * F.col("m"), F.lit(0.0))), F.lit(1e-9)))
    gaps = [F.abs((F.col(f"m{p}") - F.col("m")) / F.col("d") - F.col(f"c{p}")) for p in range(parts)]
    coarse = scaled.join(means, "item").select("item", F.col("f").alias("start"), F.round(sum(gaps[1:], gaps[0]), 6).alias("coarse"))
    best = coarse.withColumn("turn", F.row_number().over(Window.partitionBy("item").orderBy("coarse", "start"))).where(F.col("turn") <= most)
    each = best.select("item", "start", F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("k")).withColumn("f", F.col("start") + F.col("k")).join(frames, ["item", "f"])
    window = each.groupBy("item", "start").agg(F.avg("value").alias("wm"), deviation("value").alias("ws"))
    exact = each.join(window, ["item", "start"]).join(normal, ["item", "k"]).groupBy("item", "start").agg(F.round(F.avg(F.abs((F.col("value") - F.col("wm")) / F.col("ws") - F.col("c"))), 9).alias("distance"))
    return exact.groupBy("item").agg(F.min(F.struct("distance", "start")).alias("b"), F.count("*").alias("scored")).select("item", "b.start", "b.distance", "scored")


def pause_cuts(speed: Column, parts: Column) -> Column:
    """Where a series of speeds is cut into ``parts``: bounds [begin, cut, ..., end], null where it is too short.

    Rest at both ends (a fifth of the largest speed or less) goes first.  Cuts are the lowest local minima, the deepest first, of equals the
    earliest, no nearer to each other or to the ends than a third of a part (2 at least); with too few of them, equal parts."""
    given = F.array(F.struct(speed.alias("speed"), parts.alias("parts"), F.array_max(speed).alias("top")))
    return F.get(F.transform(given, _cut), F.lit(0))


def _once(x: Column, keep: tuple[str, ...], **more: Column) -> Column:
    """An array of one struct, x's fields ``keep`` and some more: a function that ``transform`` gives it to has them worked out once."""
    return F.array(F.struct(*(x[k].alias(k) for k in keep), *(c.alias(k) for k, c in more.items())))


def _cut(x: Column) -> Column:
    none = F.array().cast("array<int>")

    def ends(x: Column) -> Column:
        a, b = F.coalesce(F.get(x["moving"], F.lit(0)), F.lit(0)), F.coalesce(F.try_element_at(x["moving"], F.lit(-1)) + 1, F.size(x["speed"]))
        return F.get(F.transform(_once(x, keep=("speed", "parts"), a=a, b=b), gaps), F.lit(0))

    def gaps(x: Column) -> Column:
        n = x["b"] - x["a"]
        return F.get(F.transform(_once(x, keep=("speed", "parts", "a", "b"), n=n, gap=F.greatest(F.lit(2), F.floor(n / (3 * x["parts"])).cast("int"))), lowest), F.lit(0))

    def lowest(x: Column) -> Column:
        n, gap, at = x["n"], x["gap"], lambda i: F.get(x["speed"], x["a"] + i)
        inner = F.when(n > 2, F.sequence(F.lit(1), n - 2)).otherwise(none)
        minima = F.filter(inner, lambda i: (i >= gap) & (i <= n - gap) & (at(i) <= at(i - 1)) & (at(i) <= at(i + 1)))
        deepest = F.transform(F.array_sort(F.transform(minima, lambda i: F.struct(at(i).alias("v"), i.alias("i")))), lambda m: m["i"])
        take = lambda cuts, i: F.when((F.size(cuts) < x["parts"] - 1) & F.forall(cuts, lambda c: F.abs(i - c) >= gap), F.concat(cuts, F.array(i))).otherwise(cuts)
        return F.get(F.transform(_once(x, keep=("parts", "a", "b", "n"), cuts=F.aggregate(deepest, none, take)), bounds), F.lit(0))

    def bounds(x: Column) -> Column:
        n, parts, a = x["n"], x["parts"], x["a"]
        equal = F.when(parts > 1, F.transform(F.sequence(F.lit(1), parts - 1), lambda k: F.round(n * k / parts).cast("int"))).otherwise(none)
        chosen = F.array_sort(F.when(F.size(x["cuts"]) < parts - 1, equal).otherwise(x["cuts"]))
        return F.when(n >= 2 * parts, F.concat(F.array(a), F.transform(chosen, lambda c: a + c), F.array(x["b"])))

    moving = F.filter(F.sequence(F.lit(0), F.size(x["speed"]) - 1), lambda i: F.get(x["speed"], i) > 0.2 * x["top"])
    return F.get(F.transform(_once(x, keep=("speed", "parts"), moving=moving), ends), F.lit(0))


def repetition(x: np.ndarray, least: int, near: float, moved: float, step: int = 32) -> int | None:
    """The smallest lag from ``least`` to half the series at which its opening, which must move, comes back: mean difference below ``near``."""
    path = np.append(0, np.cumsum(np.abs(np.diff(x))))
    for p in range(least, len(x) // 2 + 1):
        if path[p - 1] < moved:
            continue
        total = 0.0
        for s in range(0, p, step):  # ends as soon as the sum so far is too large for a whole lag
            total += float(np.abs(x[s : min(s + step, p)] - x[p + s : p + min(s + step, p)]).sum())
            if total >= near * p:
                break
        else:
            return p
    return None


def first_repetition(points: Column, least: int, near: float, moved: float) -> Column:
    """``repetition`` of each array of numbers; null where nothing comes back."""

    @F.pandas_udf(IntegerType())
    def of(series: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else repetition(np.asarray(x, float), least, near, moved) for x in series], dtype="Int32")

    return of(points)


class Formulas:
    """Formulas of two words or more, each with its replacement, as a trie in sorted arrays: from (state, word) to the next state.

    All places of a batch of texts step through it together, one word further each time, so a batch takes as many steps as the longest formula
    has words, however many formulas there are.  It goes to every task: more than ``most`` words in all are refused."""

    def __init__(self, formulas: Iterable[tuple[str, str]], most: int = 200_000):
        self.code: dict[str, int] = {}
        self.whole: dict[str, str] = {}
        step: dict[tuple[int, int], int] = {}
        self.ends, self.longest, total = {}, 0, 0
        for words, out in formulas:
            state, parts, spaced = 0, words.split(), words.replace("-", " ").split()
            if len(spaced) < 2:
                continue
            total += len(spaced)
            if total > most:
                raise ValueError(f"formulas of more than {most} words")
            self.whole.setdefault(" ".join(spaced), out)  # of equal formulas the first
            if len(parts) < 2:
                continue
            for w in parts:
                state = step.setdefault((state, self.code.setdefault(w, len(self.code) + 1)), len(step) + 1)
            self.ends.setdefault(state, out)
            self.longest = max(self.longest, len(parts))
        keys = np.array([s << 32 | w for s, w in step], np.int64)
        order = np.argsort(keys)
        self.keys, self.next = keys[order], np.array([*step.values()], np.int64)[order]
        self.final = np.zeros(len(step) + 1, bool)
        self.final[list(self.ends)] = True

    def spans(self, words: list[str], bounds: np.ndarray) -> list[tuple[int, int, str]]:
        """(first, end, replacement) in a run of words, none over one of ``bounds`` (where texts end): from the left, the longest at each place."""
        codes = np.fromiter((self.code.get(w, 0) for w in words), np.int64, len(words))
        if not len(codes) or not len(self.keys):
            return []
        room = bounds[np.searchsorted(bounds, np.arange(len(codes)), side="right")] - np.arange(len(codes))
        place, state = np.arange(len(codes)), np.zeros(len(codes), np.int64)
        size, end = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64)
        for k in range(self.longest):
            fits = room[place] > k
            place, state = place[fits], state[fits]
            key = state << 32 | codes[place + k]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            on = self.keys[at] == key
            place, state = place[on], self.next[at[on]]
            done = self.final[state]
            size[place[done]], end[place[done]] = k + 1, state[done]
        out, free = [], 0
        for i in np.flatnonzero(size).tolist():
            if i >= free:
                free = i + int(size[i])
                out.append((i, free, self.ends[int(end[i])]))
        return out


WORD = re.compile(r"[^\W\d_]+")


def formulas_replaced(text: Column, formulas: Formulas, fold: Callable[[str], str] = str.lower, letters: int = 500_000) -> Column:
    """Each text with its formulas replaced; words are compared folded, all else is kept as it stands.  Places of words are held for ``letters`` letters of a batch
    at a time."""

    def some(texts: list[str | None]) -> list[str | None]:
        found = [[] if t is None else list(WORD.finditer(t)) for t in texts]
        bounds = np.cumsum([len(x) for x in found])
        base, rows = 0, []
        spans = iter([*formulas.spans([fold(m.group()) for x in found for m in x], bounds), (int(bounds[-1]) + 1, 0, "")])
        now = next(spans)
        for t, x, end in zip(texts, found, bounds.tolist(), strict=True):
            parts, last = [], 0
            while now[0] < end:
                parts += [t[last : x[now[0] - base].start()], now[2]]
                last, now = x[now[1] - base - 1].end(), next(spans)
            rows.append(t if t is None else "".join(parts) + t[last:])
            base = end
        return rows

    @F.pandas_udf(StringType())
    def of(batch: pd.Series) -> pd.Series:
        return pd.Series([x for texts in parts_of(batch.tolist(), letters) for x in some(texts)], dtype=object)

    return of(text)


def parts_of(texts: list[str | None], letters: int) -> Iterator[list[str | None]]:
    """Runs of texts of some ``letters`` letters, or one longer text."""
    part, size = [], 0
    for t in texts:
        if part and size + len(t or "") > letters:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t or "")
    if part:
        yield part


def items_merged(items: Column, glosses: Formulas, longest: int = 4) -> Column:
    """Arrays of items with neighbours joined that together are one gloss of several words: up to ``longest`` items, the longest first.

    Hyphens part words as spaces do.  Items without a word neither part neighbours nor count; those between joined ones go."""
    firsts = {w.split(" ", 1)[0] for w in glosses.whole}

    def merged(row: list[str | None]) -> list[str | None]:
        got, i = [], 0
        while i < len(row):
            words = _item_words(row[i])
            if words and words[0] in firsts:
                ends, j = [(i + 1, words)], i + 1  # of each number of items where they end, and their words
                while j < len(row) and len(ends) < longest:
                    j += 1
                    more = _item_words(row[j - 1])
                    if more:
                        ends.append((j, ends[-1][1] + more))
                hit = next(((end, glosses.whole[key]) for end, w in ends[:0:-1] if (key := " ".join(w)) in glosses.whole), None)
                if hit:
                    got.append(hit[1])
                    i = hit[0]
                    continue
            got.append(row[i])
            i += 1
        return got

    @F.pandas_udf(ArrayType(StringType()))
    def of(rows: pd.Series) -> pd.Series:
        return pd.Series([None if row is None else merged(list(row)) for row in rows], dtype=object)

    return of(items)


def _item_words(item: str | None) -> list[str]:
    return item.replace("-", " ").split() if item else []
