"""Alignment of two tokenizers' tokens over the same bytes, and which ids of one stand for which of the other.

Places where a token of both ends cut a text's tokens into *groups*.  A run of tokens is a *fragment*: an open prefix (what ends
up to the first common place), closed groups, and an open suffix (what comes after the last).  Fragments compose: the left
suffix and the right prefix together are one closed group, or stay open where a side has no common place; this is associative
and the empty fragment is neutral, so byte ranges of one text are worked out in any tasks and reduced as a tree.

Texts up to ``chunk_bytes`` are one fragment without open ends.  Longer ones are cut at multiples of ``chunk_bytes``, within
words and characters too, and dealt to all tasks; each byte range comes with the bytes up to the next *safe* places, and its
tokens are those that end in it.  Safe is a space between two characters that surely aren't white space: no token of either
tokenizer crosses the place before it (checked for the vocabulary when it is loaded).  A multiple without a safe place in
``NEAR`` bytes on both sides is no cut.  Only open ends are reduced; closed groups stay where they are and are put in order at the
end, by place, for one running hash a text.

Tokens of the same piece between safe places are the same, so pieces are encoded once a worker.  Tokens are kept in blocks of
a few MB of text, with each block's distinct id pairs and their counts; pairs are summed over all blocks, and each block gets
back the counts of its own pairs, so what is shuffled is distinct pairs of blocks, not links.

Texts that are null, empty or whose tokens' bytes differ from the text (in any part) have no tokens: zeros and an empty hash.
Repeated rows, same id included, each count and give a row.  All pairs tied for the highest count of an id count as best.  An empty
table gives no row.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.llm.shared import shuffle_partitions, written, written_buckets
from lexigrid.llm.tokens import vocabulary

CHUNK_BYTES, BLOCK_BYTES, SLICE_BYTES, NEAR = 1 << 16, 4_000_000, 1_000_000, 4096
MOST_PIECES = 800_000
ARITY = 16
#: Before a space between two characters that surely aren't white space: U+0085, U+00A0 and all others begin with C2, E1, E2 or E3.
SAFE = re.compile(rb"(?:(?<=[!-~])|(?<=[\xc3-\xdf][\x80-\xbf])|(?<=[\xe0\xe4-\xef][\x80-\xbf]{2})|(?<=[\xf0-\xf4][\x80-\xbf]{3}))(?= [!-~\xc3-\xe0\xe4-\xf4])")
DIGITS = np.zeros((1 << 16, 6), np.uint8)
WIDTH = np.zeros(1 << 16, np.int64)
for _k in range(5):
    _from = 10**_k if _k else 0
    _ids = np.arange(_from, min(10 ** (_k + 1), 1 << 16))
    WIDTH[_ids] = _k + 1
    for _j in range(_k + 1):
        DIGITS[_ids, _j] = 48 + _ids // 10 ** (_k - _j) % 10


def differs(pieces: list[bytes], parts: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """Whether each piece differs from its next ``sizes`` parts, joined."""
    length = np.fromiter(map(len, pieces), np.int64, len(pieces))
    ends = np.append(0, np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts))))[np.cumsum(sizes)]
    wrong, joined = np.diff(ends, prepend=0) != length, b"".join(parts)
    if wrong.any():  # the others as if these were left out
        joined = b"".join([joined[s:e] for s, e, w in zip([0, *ends[:-1].tolist()], ends.tolist(), wrong.tolist(), strict=True) if not w])
    same = np.flatnonzero(~wrong)
    here = np.frombuffer(b"".join([pieces[i] for i in same.tolist()]), np.uint8) != np.frombuffer(joined, np.uint8)
    wrong[same[np.searchsorted(np.cumsum(length[same]), np.flatnonzero(here), side="right")]] = True
    return wrong


class Pair:
    """Both tokenizers, the byte lengths of their ids, and the tokens of the pieces met so far."""

    def __init__(self, first: str, second: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task a core
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(vocabulary(first)), SentencePieceProcessor(model_file=vocabulary(second))
        self.a.encode_special_tokens = True
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]  # the byte-level alphabet: other bytes stand from U+0100 on
        byte = {chr(x): x for x in printable} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in printable)}
        entries = {i: t for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.bytes_a = [bytes(byte[c] for c in entries[i]) if i in entries else b"" for i in range(max(entries) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError(f"{second} has pieces that cross a space")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.len_a, self.len_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.bytes_a, self.bytes_b))
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.wrong = np.zeros(1 << 12, bool)
        self.flat = [np.empty(1 << 14, np.uint16), np.empty(1 << 14, np.uint16)]
        self.bounds = [np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)]

    def _learn(self, pieces: list[bytes]) -> None:
        n = len(self.known)
        while n + len(pieces) + 1 > len(self.wrong):
            self.wrong, self.bounds = np.append(self.wrong, np.zeros_like(self.wrong)), [np.append(b, np.zeros_like(b)) for b in self.bounds]
        texts = [p.decode(errors="replace") for p in pieces]
        ids_a = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        ids_b = self.b.encode([t[1:] for t in texts], num_threads=1)  # it adds the space that each piece begins with
        self.wrong[n : n + len(pieces)] = False
        for k, (got, entries) in enumerate(((ids_a, self.bytes_a), (ids_b, self.bytes_b))):
            sizes = np.fromiter(map(len, got), np.int64, len(got))
            every = list(chain.from_iterable(got))
            used, total = int(self.bounds[k][n]), len(every)
            while used + total > len(self.flat[k]):
                self.flat[k] = np.append(self.flat[k], np.empty_like(self.flat[k]))
            self.flat[k][used : used + total] = every
            self.bounds[k][n + 1 : n + len(got) + 1] = used + np.cumsum(sizes)
            self.wrong[n : n + len(pieces)] |= differs(pieces, [entries[t] for t in every], sizes)
        self.known.update(zip(pieces, range(n, n + len(pieces)), strict=True))

    def encode(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, bool]]:
        """(ids of the first, of the second, some bytes differ) of each text; each begins with a space and at a safe place."""
        if len(self.known) > MOST_PIECES:
            self.clear()
        split = [SAFE.split(t) for t in texts]
        pieces = [p for x in split for p in x]
        if new := [p for p in dict.fromkeys(pieces) if p not in self.known]:
            for s in range(0, len(new), 4096):
                self._learn(new[s : s + 4096])
        which = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
        ends = np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))
        wrong, got = np.append(0, np.cumsum(self.wrong[which])), []
        for flat, bounds in zip(self.flat, self.bounds, strict=True):
            sizes = bounds[which + 1] - bounds[which]
            total = np.cumsum(sizes)
            ids = flat[np.repeat(bounds[which] - total + sizes, sizes) + np.arange(total[-1])]
            got.append(np.split(ids, total[ends[:-1] - 1]))
        bad = wrong[ends] > wrong[np.append(0, ends[:-1])]
        return list(zip(*got, bad.tolist(), strict=True))


@lru_cache(1)
def pair(first: str, second: str) -> Pair:
    """One for each worker process."""
    return Pair(first, second)


class Aligned:
    """Groups and links of the tokens of several texts in a row, each of which begins and ends at a common place."""

    def __init__(self, p: Pair, a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray):
        self.a, self.b, self.na, self.nb = a, b, na, nb
        self.end_a, self.end_b = np.cumsum(p.len_a[a]), np.cumsum(p.len_b[b])
        self.last_a = self.end_b[np.minimum(np.searchsorted(self.end_b, self.end_a), max(0, len(b) - 1))] == self.end_a if len(b) else np.zeros(len(a), bool)
        self.common = self.end_a[self.last_a]
        self.text_ends = np.append(0, self.end_a)[np.cumsum(na)]

    def links(self) -> np.ndarray:
        """The id pair of each link, first id << 16 | second id, in order: both tokens of every stretch between two ends."""
        ends = np.sort(np.concatenate([self.end_a, self.end_b]))  # np.union1d hashes them, which takes many times as long
        self.stops = ends[np.diff(ends, prepend=-1) > 0]
        one, two = self.a[np.searchsorted(self.end_a, self.stops)], self.b[np.searchsorted(self.end_b, self.stops)]
        return (one.astype(np.int64) << 16) | two

    def per_text(self, ends: np.ndarray, values: np.ndarray | None = None) -> np.ndarray:
        """For each text, how many of ``ends`` lie in it, or the sum of their values."""
        at = np.searchsorted(ends, self.text_ends, side="right")
        sums = at if values is None else np.append(0, np.cumsum(values))[at]
        return np.diff(sums, prepend=0)

    def strings(self) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of each text."""
        of_a, of_b = np.searchsorted(self.common, self.end_a), np.searchsorted(self.common, self.end_b)
        many_a, many_b = np.bincount(of_a, minlength=len(self.common)), np.bincount(of_b, minlength=len(self.common))
        n = len(self.a) + len(self.b)
        ids, mark = np.empty(n, np.uint16), np.full(n, 44, np.uint8)  # a comma
        at_a = np.arange(len(self.a)) + (np.cumsum(many_b) - many_b)[of_a]
        at_b = np.arange(len(self.b)) + np.cumsum(many_a)[of_b]
        ids[at_a], ids[at_b] = self.a, self.b
        mark[np.cumsum(many_a + many_b) - many_b - 1], mark[np.cumsum(many_a + many_b) - 1] = 124, 59  # | and ;
        width = WIDTH[ids]
        chars = DIGITS[ids]
        chars[np.arange(n), width] = mark
        flat = chars[np.arange(6) <= width[:, None]].tobytes()
        stop = np.append(0, np.cumsum(width + 1))[np.cumsum(self.na + self.nb)].tolist()
        return [flat[s : max(s, e - 1)] for s, e in zip([0, *stop[:-1]], stop, strict=True)]


ENTRY = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("ord", pa.int64()), ("parts", pa.int32()), ("a", pa.binary()), ("b", pa.binary())])
ENTRY_DDL = "row long, doc_id long, ord long, parts int, a binary, b binary"
BLOCK = pa.schema(
    [("block", pa.int64()), ("row", pa.list_(pa.int64())), ("doc_id", pa.list_(pa.int64())), ("ord", pa.list_(pa.int64())), ("parts", pa.list_(pa.int32())), ("na", pa.list_(pa.int32())), ("nb", pa.list_(pa.int32()))]
    + [("a", pa.binary()), ("b", pa.binary()), ("pairs", pa.list_(pa.int64())), ("n", pa.list_(pa.int64()))]
)
BLOCK_DDL = "block long, row array<long>, doc_id array<long>, ord array<long>, parts array<int>, na array<int>, nb array<int>, a binary, b binary, pairs array<long>, n array<long>"
Batches = Iterator[pa.RecordBatch]


def _numbered(branch: int) -> int:
    """The first of the numbers that this task of this branch may give."""
    return (branch << 60) | (TaskContext.get().partitionId() << 34)


def _sliced(batch: pa.RecordBatch, column: str) -> Iterator[dict[str, list]]:
    """The batch as rows of about a MB of ``column``."""
    start, size = 0, 0
    lens = [0 if x is None else len(x) for x in batch.column(column).to_pylist()]
    for i, n in enumerate(lens):
        if i > start and size + n > SLICE_BYTES:
            yield batch.slice(start, i - start).to_pydict()
            start, size = i, 0
        size += n
    if batch.num_rows:
        yield batch.slice(start).to_pydict()


def _packed(names: tuple[str, str], entries: Iterator[tuple], branch: int) -> Batches:
    """Blocks of entries (row, doc_id, ord, parts, ids, ids)."""
    p, block, held, size = pair(*names), _numbered(branch), [], 0

    def made() -> pa.RecordBatch:
        row, doc, order, parts, a, b = zip(*held, strict=True)
        na, nb = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
        a, b = np.concatenate(a), np.concatenate(b)
        pairs, n = np.unique(Aligned(p, a, b, na, nb).links(), return_counts=True)
        values = {"block": [block], "row": [row], "doc_id": [doc], "ord": [order], "parts": [parts], "na": [na.astype(np.int32)], "nb": [nb.astype(np.int32)], "a": [a.tobytes()], "b": [b.tobytes()], "pairs": [pairs], "n": [n]}
        return pa.RecordBatch.from_pydict(values, schema=BLOCK)

    for entry in entries:
        held.append(entry)
        size += 100 + 4 * (len(entry[4]) + len(entry[5]))  # a token has some four bytes of text, and there are two of each
        if size > 2 * BLOCK_BYTES:
            yield made()
            block, held, size = block + 1, [], 0
    if held:
        yield made()


NONE = np.empty(0, np.uint16)


def _whole_texts(names: tuple[str, str]) -> Callable[[Batches], Batches]:
    def work(batches: Batches) -> Batches:
        def entries() -> Iterator[tuple]:
            row, p = _numbered(0), pair(*names)
            for batch in batches:
                for part in _sliced(batch, "data"):
                    texts = [b" " + (x or b"") for x in part["data"]]
                    for doc, text, (a, b, bad) in zip(part["doc_id"], texts, p.encode(texts), strict=True):
                        gone = bad or len(text) == 1
                        yield row, doc, 0, 1, NONE if gone else a, NONE if gone else b
                        row += 1

        return _packed(names, entries(), 0)

    return work


def byte_ranges(text: bytes, chunk_bytes: int) -> list[tuple[int, int, int, int]]:
    """(begin, end, safe place up to it, safe place from its end on) of each byte range."""
    cuts = [(0, 0, 0)]
    for at in range(chunk_bytes, len(text), chunk_bytes):
        near = [m.start() for m in SAFE.finditer(text, max(0, at - NEAR), min(len(text), at + NEAR))]
        before, after = [x for x in near if x <= at], [x for x in near if x >= at]
        if before and after:
            cuts.append((at, before[-1], after[0]))
    cuts.append((len(text), len(text), len(text)))
    return [(s, e, left, right) for (s, left, _), (e, _, right) in zip(cuts, cuts[1:], strict=False)]


RANGE = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("no", pa.int32()), ("parts", pa.int32()), ("lead", pa.int64()), ("size", pa.int64()), ("data", pa.binary())])


def _ranges(chunk_bytes: int) -> Callable[[Batches], Batches]:
    def work(batches: Batches) -> Batches:
        row = _numbered(1)
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1).to_pydict()
                text = b" " + one["data"][0]
                every = byte_ranges(text, chunk_bytes)
                for no, (s, e, left, right) in enumerate(every):
                    values = {"row": row, "doc_id": one["doc_id"][0], "no": no, "parts": max(2, len(every)), "lead": s - left, "size": e - s, "data": text[left:right]}
                    yield pa.RecordBatch.from_pylist([values], schema=RANGE)
                row += 1

    return work


class Fragment:
    """Open prefix, whether there is a common place, and open suffix; ``at``: the range in which the prefix ends."""

    def __init__(self, pa_: np.ndarray, pb: np.ndarray, closed: bool, sa: np.ndarray, sb: np.ndarray, at: int):
        self.pa, self.pb, self.closed, self.sa, self.sb, self.at = pa_, pb, closed, sa, sb, at

    def then(self, right: Fragment) -> tuple[Fragment, tuple | None]:
        """Both as one, and the group that this closes: (range in which it ends, ids, ids)."""
        if not right.closed:  # its prefix is all that it has
            if not self.closed:
                return Fragment(np.append(self.pa, right.pa), np.append(self.pb, right.pb), False, NONE, NONE, self.at), None
            return Fragment(self.pa, self.pb, True, np.append(self.sa, right.pa), np.append(self.sb, right.pb), self.at), None
        if not self.closed:
            return Fragment(np.append(self.pa, right.pa), np.append(self.pb, right.pb), True, right.sa, right.sb, right.at), None
        return Fragment(self.pa, self.pb, True, right.sa, right.sb, self.at), (right.at, np.append(self.sa, right.pa), np.append(self.sb, right.pb))


FRAGMENT = pa.schema(
    [("row", pa.int64()), ("doc_id", pa.int64()), ("no", pa.int32()), ("parts", pa.int32()), ("at", pa.int32()), ("bad", pa.bool_()), ("closed", pa.bool_())]
    + [(k, pa.binary()) for k in ("pa", "pb", "ca", "cb", "sa", "sb")]
)
FRAGMENT_DDL = "row long, doc_id long, no int, parts int, at int, bad boolean, closed boolean, pa binary, pb binary, ca binary, cb binary, sa binary, sb binary"


def _fragments(names: tuple[str, str]) -> Callable[[Batches], Batches]:
    def work(batches: Batches) -> Batches:
        p = pair(*names)
        for batch in batches:
            for part in _sliced(batch, "data"):
                out = []
                for i, (a, b, bad) in enumerate(p.encode(part["data"])):
                    lead, size = part["lead"][i], part["size"][i]
                    end_a, end_b = np.cumsum(p.len_a[a]), np.cumsum(p.len_b[b])
                    in_a, in_b = ((lead < e) & (e <= lead + size) for e in (end_a, end_b))
                    a, b, end_a, end_b = a[in_a], b[in_b], end_a[in_a], end_b[in_b]
                    both = np.intersect1d(end_a, end_b, assume_unique=True)
                    first, last = (both[0], both[-1]) if len(both) and not bad else (lead + size, lead + size)
                    cut = {}
                    for k, ids, ends in (("a", a, end_a), ("b", b, end_b)):
                        cut["p" + k], cut["c" + k], cut["s" + k] = (ids[m].tobytes() for m in (ends <= first, (ends > first) & (ends <= last), ends > last))
                    out.append({"row": part["row"][i], "doc_id": part["doc_id"][i], "no": part["no"][i], "parts": part["parts"][i], "at": part["no"][i], "bad": bad, "closed": bool(len(both)), **cut})
                yield pa.RecordBatch.from_pylist(out, schema=FRAGMENT)

    return work


def _reduce(rows: pd.DataFrame) -> pd.DataFrame:
    """Up to ``ARITY`` neighbouring fragments of a text as one (``ca`` null), and the groups that this closes (in ``ca``, ``cb``)."""
    rows, ids = rows.sort_values("no"), lambda x: np.frombuffer(x, np.uint16)
    one, out, base = None, [], {"row": rows["row"].iloc[0], "doc_id": rows["doc_id"].iloc[0], "no": rows["no"].iloc[0] // ARITY, "parts": rows["parts"].iloc[0], "bad": False}
    for r in rows.itertuples():
        next_one, group = Fragment(ids(r.pa), ids(r.pb), r.closed, ids(r.sa), ids(r.sb), r.at), None
        one, group = one.then(next_one) if one else (next_one, None)
        if group:
            out.append(base | {"at": group[0], "closed": True, "ca": group[1].tobytes(), "cb": group[2].tobytes()})
    out.append(base | {"at": one.at, "closed": one.closed, "pa": one.pa.tobytes(), "pb": one.pb.tobytes(), "sa": one.sa.tobytes(), "sb": one.sb.tobytes()})
    return pd.DataFrame(out, columns=FRAGMENT.names)


def _long_entries(long: DataFrame, names: tuple[str, str], chunk_bytes: int) -> DataFrame:
    """Entries of texts over ``chunk_bytes``: the closed groups of each range, and those that meet across ranges, in order by ``ord``."""
    dealt = long.mapInArrow(_ranges(chunk_bytes), "row long, doc_id long, no int, parts int, lead long, size long, data binary").repartition(shuffle_partitions(long.sparkSession), "row", "no")
    fragments = written(dealt.mapInArrow(_fragments(names), FRAGMENT_DDL), "fragments")
    lost = fragments.where("bad").select("row", "doc_id").distinct()
    good = fragments.join(lost.select("row"), "row", "left_anti")
    entries = good.where(F.length("ca") > 0).select("row", "doc_id", (2 * F.col("no") + 1).cast("long").alias("ord"), "parts", F.col("ca").alias("a"), F.col("cb").alias("b"))
    parts = fragments.select(F.max("parts")).first()[0] or 0
    while parts > 0:
        done = written(good.groupBy("row", F.expr(f"no div {ARITY}")).applyInPandas(_reduce, FRAGMENT_DDL), "reduced")
        closed, good = done.where("ca is not null"), done.where("ca is null")
        entries = entries.union(closed.select("row", "doc_id", (2 * F.col("at")).cast("long"), "parts", "ca", "cb"))
        parts = 0 if parts <= ARITY else -(-parts // ARITY)
    entries = entries.union(good.select("row", "doc_id", (2 * F.col("at")).cast("long"), "parts", "pa", "pb"))
    empty = F.lit(b"").cast("binary")
    return entries.union(lost.select("row", "doc_id", F.lit(0).cast("long"), F.lit(2), empty, empty))


def _blocks_of(names: tuple[str, str]) -> Callable[[Batches], Batches]:
    def work(batches: Batches) -> Batches:
        def entries() -> Iterator[tuple]:
            for batch in batches:
                for i in range(batch.num_rows):
                    x = {k: v[0] for k, v in batch.slice(i, 1).to_pydict().items()}
                    yield x["row"], x["doc_id"], x["ord"], x["parts"], np.frombuffer(x["a"], np.uint16), np.frombuffer(x["b"], np.uint16)

        return _packed(names, entries(), 1)

    return work


PART = pa.schema([(k, pa.int64()) for k in ("row", "doc_id", "ord")] + [("parts", pa.int32())] + [(k, pa.int64()) for k in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")] + [("groups_sha256", pa.string()), ("groups", pa.binary())])
PART_DDL = "row long, doc_id long, ord long, parts int, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups binary"


def _measured(names: tuple[str, str]) -> Callable[[Batches], Batches]:
    """Blocks with the (pair, count, best) of their pairs -> a row for each entry; its groups as text only for texts of several."""

    def work(batches: Batches) -> Batches:
        p = pair(*names)
        for batch in batches:
            for i in range(batch.num_rows):
                x = batch.slice(i, 1)
                y = {k: x.column(k).to_pylist()[0] for k in ("row", "doc_id", "ord", "parts", "na", "nb", "a", "b")}
                na, nb = np.array(y["na"], np.int64), np.array(y["nb"], np.int64)
                got = Aligned(p, np.frombuffer(y["a"], np.uint16), np.frombuffer(y["b"], np.uint16), na, nb)
                links = got.links()
                answer = x.column("answers").flatten()
                key, count, best = (answer.field(k).to_numpy(zero_copy_only=False) for k in ("pair", "count", "best"))
                order = np.argsort(key)
                at = order[np.searchsorted(key[order], links)] if len(links) else np.empty(0, np.int64)
                shown = got.strings()
                sha = ["" if k > 1 or not s else hashlib.sha256(s).hexdigest() for k, s in zip(y["parts"], shown, strict=True)]
                values = {k: y[k] for k in ("row", "doc_id", "ord", "parts")} | {"n_a": na, "n_b": nb, "n_groups": got.per_text(got.common), "n_links": got.per_text(got.stops)}
                values |= {"n_best": got.per_text(got.stops, best[at].astype(np.int64)), "count_sum": got.per_text(got.stops, count[at].astype(np.int64)), "groups_sha256": sha}
                yield pa.RecordBatch.from_pydict(values | {"groups": [s if k > 1 else None for k, s in zip(y["parts"], shown, strict=True)]}, schema=PART)

    return work


def _joined(batches: Batches) -> Batches:
    """Rows sorted by text and place -> a row for each text: sums, and the hash of its groups in order."""
    sums = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
    now: dict | None = None

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([now | {"groups_sha256": now["sha"].hexdigest() if now["n_a"] else ""}], schema=pa.schema([PART.field("doc_id"), *[PART.field(k) for k in sums], PART.field("groups_sha256")]))

    for batch in batches:
        for i in range(batch.num_rows):
            x = {k: v[0] for k, v in batch.slice(i, 1).to_pydict().items()}
            if now and now["row"] != x["row"]:
                yield made()
                now = None
            if now is None:
                now = {"row": x["row"], "doc_id": x["doc_id"], "sha": hashlib.sha256()} | dict.fromkeys(sums, 0)
            if x["groups"]:
                now["sha"].update((b";" if now["n_a"] else b"") + x["groups"])
            for k in sums:
                now[k] += x[k]
    if now:
        yield made()


def align_tokens(docs: DataFrame, first: str = "byte_bpe_50k.json", second: str = "piece_bpe_32k.model", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of ``docs``."""
    names = (first, second)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("data"))
    is_long = F.coalesce(F.octet_length("data") > chunk_bytes, F.lit(False))
    long = _long_entries(texts.where(is_long), names, chunk_bytes).mapInArrow(_blocks_of(names), BLOCK_DDL)
    blocks = written_buckets(texts.where(~is_long).mapInArrow(_whole_texts(names), BLOCK_DDL).union(long), "token_blocks", "block", shuffle_partitions(docs.sparkSession))
    counts = written(blocks.select(F.explode(F.arrays_zip("pairs", "n")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.n").alias("count")), "pair_counts")
    most = counts.groupBy(F.col("pair").bitwiseAND(0xFFFF).alias("second")).agg(F.max("count").alias("most"))
    marked = counts.join(most, F.col("pair").bitwiseAND(0xFFFF) == F.col("second")).select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    asked = blocks.select("block", F.explode("pairs").alias("pair")).join(marked, "pair")
    answers = asked.groupBy("block").agg(F.collect_list(F.struct("pair", "count", "best")).alias("answers"))
    columns = [F.col(c) for c in ("row", "doc_id", "ord", "parts", "na", "nb", "a", "b")]
    none = F.array().cast("array<struct<pair: bigint, count: bigint, best: boolean>>")
    answered = blocks.join(answers.hint("shuffle_hash"), "block", "left").select(*columns, F.coalesce("answers", none).alias("answers"))
    parts = written(answered.mapInArrow(_measured(names), PART_DDL), "aligned_parts")
    out = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    several = parts.where("parts > 1").repartition(shuffle_partitions(docs.sparkSession), "row").sortWithinPartitions("row", "ord")
    joined = several.mapInArrow(_joined, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    return parts.where("parts = 1").select(*out).union(joined.select(*out))
