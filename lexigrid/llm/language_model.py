"""Scoring texts by a probabilistic suffix tree over words.

States are contexts of the last words, none to ``depth`` of them.  A context needs ``min_count`` occurrences to be looked at, and is
retained if its next-word distribution diverges from that of the context one word shorter: with its next words a seen at least
twice told apart and all others taken together, the sum of C(s,a) * ln(P(a|s) / P(a|s')) has to exceed half a logarithm of the
training tokens for each word told apart (the cost of its probability in a description of the model).  Of a retained context's
N(s) occurrences the M(s) before words told apart count for these, and the rest is smoothed over the shorter context,
P(a|s) = (C(s,a) + (N(s) - M(s) + k) * P(a|s')) / (N(s) + k), down to the words' own P(a) = (c+1) / (N+V+1).  Each token is
scored in the longest retained context that ends before it.  All of these sum to one over known words and one unknown word.

Texts become blocks of word numbers once.  A block asks once for each of its distinct words, then for its runs of 2, 3, ... words
and for the contexts one word shorter than those just answered; counts are summed in the keys' buckets and sent back, so what is
gathered grows with the corpus, is shuffled pre-aggregated by block and never meets in one task or the driver, however frequent a
word.  Once the contexts of one word are judged, what later rounds need is written: the tokens that longer runs may still hold, and the
texts' sums over all others; words and earlier answers are dropped.  A longer run is asked for only where the context before its last word is frequent enough and the run without its first
word occurs twice, and the rounds end with ``depth`` or when no such run is left.  Words are told apart by 64-bit
hashes, runs exactly: by the numbers, dealt by frequency, of the run without its last word and of that word.

Words are runs of anything but space and \\t \\n \\v \\f \\r with A-Z lower-cased; each text ends with one end token.  A null
text is empty.  Documents whose id's crc32 (as text; null: empty) leaves the held-out remainder are scored but not learned
from.  Repeated rows count as often as they stand and are scored each.  An empty table gives an empty result; columns other than
id and text aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.llm.blocks import BLOCK_BYTES, buckets_for
from lexigrid.llm.ngram_join import LOWER
from lexigrid.llm.shared import database, shuffle_partitions, written_buckets

END = np.uint64(0xE17D5EED)
STEP = np.uint64(0x9E3779B97F4A7C15)
SAVED = 2  # runs of so many words are saved with what is known about them, once it is known


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _grams(words: int) -> int:
    """The kind of asked keys that are runs of so many words."""
    return 2 * words


def _states(words: int) -> int:
    """The kind of asked keys that are contexts of so many words."""
    return 2 * words + 1


def _narrow(x: np.ndarray) -> bytes:
    """Whole numbers byte by byte: all lowest bytes, then all next ones, as far as the largest number needs; squeezed where that helps.  The first byte says how many, and whether squeezed."""
    most = int(x.max()) if len(x) else 0
    width = max(1, -(-most.bit_length() // 8))
    raw = x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    small = pa.compress(raw, "zstd", asbytes=True)
    return bytes([width | 128]) + small if len(small) < len(raw) else bytes([width]) + raw


def _wide(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if n:
        width = data[0] & 127
        raw = pa.decompress(data[1:], width * n, "zstd", asbytes=True) if data[0] & 128 else data[1:]
        out[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, n).T
    return out.view("<i8").ravel()


def _gaps(keys: np.ndarray) -> bytes:
    """Sorted keys as the gaps between them, whose high bytes are mostly zero."""
    return _narrow(np.diff(keys, prepend=np.uint64(0)))


def _keys(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(_wide(data, n).view("<u8"))


def _run_gaps(keys: np.ndarray, bits: np.uint64) -> tuple[bytes, bytes]:
    """Sorted keys of runs as the gaps between contexts, and those between the last words after one context."""
    context, last = keys >> bits, keys & ((np.uint64(1) << bits) - np.uint64(1))
    step, gap = np.diff(context, prepend=np.uint64(0)), last.copy()
    same = np.flatnonzero(step[1:] == 0) + 1
    gap[same] -= last[same - 1]
    return _narrow(step), _narrow(gap)


def _run_keys(data: bytes, last: bytes, n: int, bits: np.uint64) -> np.ndarray:
    step, gap = _wide(data, n).view("<u8"), _wide(last, n).view("<u8")
    new = step > 0
    new[:1] = True
    starts, run = np.flatnonzero(new), np.cumsum(gap)
    before = run[starts] - gap[starts]
    return (np.cumsum(step) << bits) | (run - np.repeat(before, np.diff(np.append(starts, n))))


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted distinct values, where one of each stands, and for each element which it is."""
    order = np.argsort(x)
    x = x[order]
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    place = np.empty(len(x), np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - 1
    return x[new], order[new], place


class _Sent:
    """Distinct keys by bucket and, in it, in their order, with what is said about each; given and answered in the order of ``keys``.

    Words are keys by hash.  A run's key is the number of the run without its last word beside the number of that word, and a context's
    is its own rank in the bucket that ranked it; ``bucket`` says where these go.
    """

    def __init__(self, keys: np.ndarray, buckets: int, bucket: np.ndarray | None = None, bits: np.uint64 | None = None):
        self.buckets, self.bits, self.order = buckets, bits, None
        if bucket is None:
            bucket = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)  # rises with the key
        else:
            bucket = bucket.astype(np.uint16 if buckets < 1 << 16 else np.int64)
            self.order = np.argsort(bucket, kind="stable")
            keys, bucket = keys[self.order], bucket[self.order]
        self.keys = keys
        starts = np.flatnonzero(np.diff(bucket.astype(np.int64), prepend=-1))
        self.cuts = [(int(bucket[s]), int(s), int(e)) for s, e in zip(starts, np.append(starts[1:], len(keys)), strict=False)]

    def _sorted(self, x: np.ndarray) -> np.ndarray:
        return x if self.order is None else x[..., self.order]

    def _given(self, x: np.ndarray) -> np.ndarray:
        if self.order is None:
            return x
        out = np.empty_like(x)
        out[self.order] = x
        return out

    def rows(self, kind: int, block: int, counts: np.ndarray, sums: np.ndarray | None = None) -> Iterator[dict]:
        """``sums``, of contexts: log-likelihood, number and occurrences; sent where the count isn't zero."""
        counts, sums = self._sorted(counts), None if sums is None else self._sorted(sums)
        for b, s, e in self.cuts:
            row = {"kind": kind, "bucket": b, "block": block, "many": e - s, "values": _narrow(counts[s:e])}
            if self.bits is None:
                row["keys"] = _gaps(self.keys[s:e])
            else:
                row["keys"], row["last"] = _run_gaps(self.keys[s:e], self.bits)
            if sums is not None:
                fit, number, seen = sums[:, s:e][:, counts[s:e] > 0]
                row |= {"fit": fit.tobytes(), "number": _narrow(number.astype(np.int64)), "seen": _narrow(seen.astype(np.int64))}
            yield row

    def counts(self, answers: dict, ranked: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each run the total count, whether the block is the one to speak for it, and its number if it occurs ``ranked`` times."""
        total, own, number = np.zeros(len(self.keys), np.int64), np.zeros(len(self.keys), bool), np.zeros(len(self.keys), np.uint64)
        for b, s, e in self.cuts:
            total[s:e] = _wide(answers[b]["total"], e - s)
            own[s:e] = np.unpackbits(np.frombuffer(answers[b]["own"], np.uint8), count=e - s)
            at = np.flatnonzero(total[s:e] >= ranked) + s
            number[at] = _wide(answers[b]["rank"], len(at)).view("<u8") * np.uint64(self.buckets) + np.uint64(b)
        return self._given(total), self._given(own), self._given(number)

    def told_apart(self, answers: dict) -> np.ndarray:
        """For each context its occurrences before words told apart; 0: not retained."""
        out = np.zeros(len(self.keys), np.int64)
        for b, s, e in self.cuts:
            out[s:e] = _wide(answers[b]["total"], e - s)
        return self._given(out)


class SuffixTree:
    """One block's part in each round; every round starts from the words, or what was saved of them, and the answers of the rounds since.

    After r rounds the counts of runs of up to r words are known, and which contexts of up to r - 2 words are retained; the next
    round asks for runs of r + 1 words and contexts of r - 1.  A bucket numbers the runs that later keys are made of by their
    frequency, so that a key is two mostly small numbers and no hash.
    """

    def __init__(self, buckets: int, min_count: int, smoothing: float, parts: int, held: int, depth: int):
        self.buckets, self.min_count, self.k, self.parts, self.held, self.depth = buckets, max(min_count, 1), smoothing, parts, held, depth
        self.n = self.v = 0
        self.bits = np.uint64(1)  # of a word's number

    def ranked(self, kind: int) -> int:
        """How often words and longer runs have to occur to be parts of keys."""
        return min(2, self.min_count) if kind == _grams(1) else self.min_count

    def held_out(self, doc: int | None) -> bool:
        return zlib.crc32(b"" if doc is None else str(doc).encode()) % self.parts == self.held

    def _runs(self, keys: np.ndarray, often: np.ndarray) -> _Sent:
        """Runs go by context, those after a frequent context (``often``: its count) to as many buckets as it needs."""
        context, last = keys >> self.bits, keys & ((np.uint64(1) << self.bits) - np.uint64(1))
        many = 1 + often // max(1, self.n // (4 * self.buckets))
        place = _mix(context * STEP + last % many.astype(np.uint64))
        return _Sent(keys, self.buckets, ((place >> np.uint64(32)) * np.uint64(self.buckets)) >> np.uint64(32), self.bits)

    def _saved(self, row: dict, end: np.ndarray, at: np.ndarray, score: np.ndarray, sums: Callable, runs: dict[str, np.ndarray]) -> dict:
        """The row without the tokens that no longer run will hold; their scores are summed by text."""
        often = (runs["total"] >= self.min_count)[at]
        after = np.zeros(len(end), bool)  # a frequent context stands before it
        after[1:] = often[:-1] & (end[1:] == end[:-1] + 1)
        live = np.flatnonzero(often | after & (runs["total"] >= 2)[at])
        end, at, used = end[live], at[live], np.zeros(len(runs["total"]), bool)
        score[end], used[at] = 0, True
        runs = {k: x[used] for k, x in runs.items()}
        out = {k: row[k] for k in ("block", "ids", "sizes", "known", "base")} | {"score": sums(score).tobytes(), "many": len(end), "end": _narrow(np.diff(end, prepend=end[:1])), "start": int(end[0]) if len(end) else 0}
        at = (np.cumsum(used, dtype=np.int32) - 1)[at]
        return out | {"runs": len(runs["total"]), "at": _narrow(at), "p": runs["p"].tobytes()} | {k: _narrow(runs[k]) for k in ("total", "number", "last")}

    def __call__(self, row: dict, answers: dict[int, dict], rounds: int, save: bool = False) -> list[dict] | dict:
        """Rows to ask after so many rounds, or the scores after the last.  ``save``: what later rounds need, as a row to start from."""
        sizes, block = np.array(row["sizes"], np.int64), row["block"]
        ends, scored = np.cumsum(sizes), save or rounds == self.depth + 2
        train = lambda: np.repeat([not self.held_out(d) for d in row["ids"]], sizes)
        sums = lambda x: np.add.reduceat(x, ends - sizes, dtype=float)
        more = np.ones(ends[-1], bool)  # whether another token of the text follows
        more[ends - 1] = False
        # of the runs of k words: their total counts, numbers, last words' numbers and the probability of the last word after the others;
        # the tokens where one ends, and which of them that is
        if "tokens" in row:
            word, token, start, out = np.frombuffer(row["words"], "<u8"), np.frombuffer(row["tokens"], "<i4"), 1, []
            words = _Sent(word, self.buckets)
            if not rounds:
                return list(words.rows(_grams(1), block, np.bincount(token[train()], minlength=len(word))))
            total, _, number = words.counts(answers[_grams(1)], self.ranked(_grams(1)))
            last, p = number, (total + 1.0) / (self.n + self.v + 1.0)
            end, at = np.arange(len(token), dtype=np.int32), token
            if scored:
                score = np.log10(p)[token]
                row |= {"known": _narrow(sums(total[token] > 0).astype(np.int64)), "base": sums(score).tobytes(), "score": bytes(8 * len(sizes))}
        else:
            start, out, n = SAVED, [], row["runs"]
            total, p, number, last = _wide(row["total"], n), np.frombuffer(row["p"], "<f8"), _wide(row["number"], n).view("<u8"), _wide(row["last"], n).view("<u8")
            end, at = np.cumsum(_wide(row["end"], row["many"])) + row["start"], _wide(row["at"], row["many"])
            if scored:
                score = np.zeros(ends[-1])
                score[end] = np.log10(p)[at]
        for k in range(start, self.depth + 1):
            if save and k == SAVED:
                return self._saved(row, end, at, score, sums, {"total": total, "number": number, "last": last, "p": p})
            if not len(end) and not save:
                break
            often = total >= self.min_count
            before = np.flatnonzero(often[at] & more[end])  # contexts of k words; the next token comes after each
            if len(before) and before[-1] + 1 == len(end):
                end, at = np.append(end, end[-1:]), np.append(at, at[-1:])  # no token's next
            goes_on = (end[before + 1] == end[before] + 1) & (total >= 2)[at[before + 1]]
            on = before[goes_on]
            context, shorter, deep = at[on], at[on + 1], end[on + 1]
            if int(number.max(initial=0)).bit_length() + int(self.bits) > 64:
                raise ValueError("more contexts than keys of 64 bits can tell apart")
            run, first, place = _distinct((number << self.bits)[context] | last[shorter])
            context, shorter = context[first], shorter[first]
            runs = self._runs(run, total[context])
            if rounds == k:
                return out + list(runs.rows(_grams(k + 1), block, np.bincount(place[train()[deep]], minlength=len(run))))
            run_total, own, run_number = runs.counts(answers.get(_grams(k + 1), {}), self.ranked(_grams(k + 1)))
            is_context = np.zeros(len(total), bool)
            is_context[at[before]] = True
            contexts = np.flatnonzero(is_context)
            contexts = contexts[np.argsort(number[contexts])]
            sent = _Sent(number[contexts] // np.uint64(self.buckets), self.buckets, number[contexts] % np.uint64(self.buckets))
            if rounds == k + 1:  # each context's sums over the next words that the block speaks for: count, log-likelihood, number; and its occurrences
                mine = np.flatnonzero(own & (run_total >= 2))
                c, whose = run_total[mine].astype(float), context[mine]
                told, fit, kinds = (np.bincount(whose, x, len(total))[contexts] for x in (c, c * np.log(c / p[shorter[mine]]), None))
                out = list(sent.rows(_states(k), block, told.astype(np.int64), np.stack([fit, kinds, total[contexts]])))
                run_p = p[shorter]  # not asked for in this round
            else:
                n = np.zeros(len(total), np.int64)
                n[contexts] = sent.told_apart(answers.get(_states(k), {}))
                rest = np.where(n > 0, (total - n + self.k) / (total + self.k), 1.0)
                run_p = p[shorter] * rest[context] + np.where((n[context] > 0) & (run_total >= 2), run_total / (total[context] + self.k), 0.0)
                if scored:
                    off = before[~goes_on]
                    score[end[off] + 1] += np.log10(rest)[at[off]]
                    score[deep] = np.log10(run_p)[place]
            end, at, total, number, last, p = deep, place, run_total, run_number, run & ((np.uint64(1) << self.bits) - np.uint64(1)), run_p
            del before, goes_on, on, deep, context, shorter, first, place, own, contexts, runs, sent  # before the next words are sorted
        if not scored:
            return out
        return {"n_tokens": sizes, "n_known": _wide(row["known"], len(sizes)), "base_score": np.frombuffer(row["base"], "<f8"), "score": np.frombuffer(row["score"], "<f8") + sums(score)}


def _release() -> None:
    """Freed Arrow memory goes back to the system: workers live on and would keep what their largest batch took, beside the executor's heap."""
    pa.default_memory_pool().release_unused()


def _few(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches as slices of so many rows, so that only these become Python objects at once."""
    for batch in batches:
        for s in range(0, batch.num_rows, rows):
            yield batch.slice(s, rows)


class _Numbers(dict):
    """The number of each word of a block, as met; the end is 0."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self) + 1
        return number


SLICE_ROWS = 500
BLOCKS = "block long, ids array<long>, sizes array<int>, words binary, tokens binary"


def _pack(block_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of about so many bytes of whole documents: their distinct words' hashes, and the words of the texts by number."""
    schema = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("words", pa.binary()), ("tokens", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, sizes, tokens, held = TaskContext.get().partitionId() << 24, [], [], [], 0
        number = _Numbers()

        def row() -> pa.RecordBatch:
            word = np.array([END, *map(xxhash.xxh3_64_intdigest, number)], np.uint64)
            word, place = np.unique(word, return_inverse=True)
            token = place.astype("<i4")[np.concatenate(tokens)]
            return pa.RecordBatch.from_pylist([{"block": block, "ids": ids, "sizes": sizes, "words": word.astype("<u8").tobytes(), "tokens": token.tobytes()}], schema=schema)

        for batch in _few(batches, SLICE_ROWS):
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ids and held + len(text) > block_bytes:
                    yield row()
                    block, ids, sizes, tokens, held, number = block + 1, [], [], [], 0, _Numbers()
                    _release()
                words = text.translate(LOWER).split()
                tokens.append(np.array([*map(number.__getitem__, words), 0], np.int32))
                ids.append(i)
                sizes.append(len(words) + 1)
                held += len(text)
        if ids:
            yield row()

    return pack


ASKED = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("block", pa.int64()), ("many", pa.int32()), *[(k, pa.binary()) for k in ("keys", "last", "values", "fit", "number", "seen")]])
ASKED_DDL = "kind int, bucket int, block long, many int, keys binary, last binary, values binary, fit binary, number binary, seen binary"
STATE = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), *[(k, pa.int32()) for k in ("many", "start", "runs")], *[(k, pa.binary()) for k in ("known", "base", "score", "end", "at", "p", "total", "number", "last")]])
STATE_DDL = "block long, ids array<long>, sizes array<int>, many int, start int, runs int, known binary, base binary, score binary, end binary, at binary, p binary, total binary, number binary, last binary"
ANSWER = "kind int, bucket int, block long, total binary, own binary, rank binary, n long, v long, numbers long"


def _answers(row: dict) -> dict[int, dict]:
    out: dict[int, dict] = {}
    for a in row["answers"] or []:
        out.setdefault(a["kind"], {})[a["bucket"]] = a
    return out


def _over(f: Callable) -> Callable:
    """``f`` over each block of the batches."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in _few(batches, 1):
            yield f({k: v[0] for k, v in one.to_pydict().items()})
            _release()

    return over


def _sum(tree: SuffixTree, penalty: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def add(rows: pd.DataFrame) -> pd.DataFrame:
        """Sums of each key's values, for each block that sent it; own: for one of these; rank: among the bucket's frequent runs."""
        _release()  # what the group before took
        rows = rows.sort_values("block")
        many, kind = rows["many"].to_numpy(), int(rows["kind"].iloc[0])
        if kind % 2 or kind == _grams(1):
            keys = [_keys(x, n) for x, n in zip(rows["keys"], many, strict=True)]
        else:
            keys = [_run_keys(x, y, n, tree.bits) for x, y, n in zip(rows["keys"], rows["last"], many, strict=True)]
        key, first, place = _distinct(np.concatenate(keys))
        local = np.concatenate([_wide(x, n) for x, n in zip(rows["values"], many, strict=True)])
        own, split = np.zeros(len(place), bool), lambda x: np.split(x, np.cumsum(many)[:-1])
        sums, ranks, numbers = np.bincount(place, local, len(key)).astype(np.int64), [b""] * len(rows), 0
        if kind % 2:
            told = np.flatnonzero(local)
            sizes, at = [np.count_nonzero(x) for x in split(local)], place[told]
            number, of = (np.concatenate([_wide(x, n) for x, n in zip(rows[k], sizes, strict=True)]) for k in ("number", "seen"))
            number, fit = np.bincount(at, number, len(key)), np.bincount(at, np.frombuffer(b"".join(rows["fit"]), "<f8"), len(key))
            seen = np.zeros(len(key))
            seen[at] = of
            rest = np.maximum(seen - sums, 0)
            gain = fit - sums * np.log(np.maximum(seen, 1)) + rest * np.log(np.maximum(rest, 1) / np.maximum(seen, 1))
            total = [_narrow(x) for x in split(np.where((sums > 0) & (gain > penalty * number), sums, 0)[place])]
            local = known = np.zeros(len(place), np.int64)
        else:
            own[first] = True
            known = own & (sums[place] > 0)
            frequent = np.flatnonzero(sums >= tree.ranked(kind))
            rank, numbers = np.zeros(len(key), np.int64), len(frequent) * tree.buckets
            rank[frequent[np.argsort(-sums[frequent], kind="stable")]] = np.arange(len(frequent))
            total, ranks = zip(*((_narrow(x), _narrow(y[x >= tree.ranked(kind)])) for x, y in zip(split(sums[place]), split(rank[place]), strict=True)), strict=True)
        return pd.DataFrame({
            "kind": rows["kind"], "bucket": rows["bucket"], "block": rows["block"], "total": total, "own": [np.packbits(x).tobytes() for x in split(own)], "rank": ranks,
            "n": [int(x.sum()) for x in split(local)], "v": [int(x.sum()) for x in split(known)], "numbers": numbers,
        })

    return add


def score_texts(docs: DataFrame, min_count: int = 12, smoothing: float = 4.0, depth: int = 5, parts: int = 7, held: int = 2, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    home, none = database(spark, "lm"), "array<struct<kind:int,bucket:int,total:binary,own:binary,rank:binary>>"
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"").cast("binary")).alias("data"))
    blocks = written_buckets(rows.mapInArrow(_pack(block_bytes), BLOCKS), "blocks", "block", shuffle_partitions(spark), home)
    tree = SuffixTree(buckets_for(spark, block_bytes * blocks.count()), min_count, smoothing, parts, held, depth)
    answers: list[DataFrame] = []

    def table() -> DataFrame:
        if not answers:
            return blocks.withColumn("answers", F.lit(None).cast(none))
        out = blocks
        for k, a in enumerate(answers):  # dealt by block as the blocks are, so each is shuffled once for all later rounds
            out = out.join(a.groupBy("block").agg(F.collect_list(F.struct("kind", "bucket", "total", "own", "rank")).alias(f"a{k}")).hint("shuffle_hash"), "block", "left")
        every = F.concat(*(F.coalesce(f"a{k}", F.array().cast(none)) for k in range(len(answers))))
        return out.select(*blocks.columns, every.alias("answers"))

    penalty = 0.0
    for rounds in range(depth + 2):

        def send(row: dict, rounds: int = rounds) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(tree(row, _answers(row), rounds), schema=ASKED)

        def save(row: dict) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([tree(row, _answers(row), SAVED + 1, save=True)], schema=STATE)

        asked = table().mapInArrow(_over(send), ASKED_DDL)
        summed = asked.groupBy("kind", "bucket").applyInPandas(_sum(tree, penalty), ANSWER).repartition(shuffle_partitions(spark), "block")
        answers.append(written_buckets(summed, f"round{rounds}", "block", shuffle_partitions(spark), home))
        if not rounds:
            sums = answers[0].agg(F.sum("n"), F.sum("v"), F.max("numbers")).first()
            tree.n, tree.v, tree.bits = sums[0] or 0, sums[1] or 0, np.uint64(max(1, (sums[2] or 0).bit_length()))
            penalty = float(np.log(max(tree.n, 1)) / 2)
        if answers[-1].isEmpty():  # no longer run is frequent enough
            break
        if rounds == SAVED <= depth:  # later rounds start from here
            blocks = written_buckets(table().mapInArrow(_over(save), STATE_DDL), "state", "block", shuffle_partitions(spark), home)
            for name in ("blocks", *(f"round{k}" for k in range(SAVED))):
                spark.sql(f"DROP TABLE {home}.{name}")
            del answers[:SAVED]
    columns = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def scores(row: dict) -> pa.RecordBatch:
        got, ids = tree(row, _answers(row), depth + 2), row["ids"]
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array([tree.held_out(d) for d in ids]), pa.array(got["n_tokens"], pa.int64()), pa.array(got["n_known"], pa.int64()), pa.array([tree.n] * len(ids), pa.int64()), pa.array(got["base_score"]), pa.array(got["score"])],
            ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    return table().mapInArrow(_over(scores), columns)
