"""Suffix-array dedup: find every string of ``min_bytes`` bytes that starts at two places, and remove the bytes it covers.

The suffixes of all documents are put in order only as far as is asked, to a depth of ``min_bytes`` (L), and only where
they can tie.  A difference cover D modulo v (a Singer set, v = q*q+q+1 with q+1 residues) gives the sample: positions
whose offset in their document is in D modulo v.  For any two positions i and j some k < v puts both i+k and j+k into the
sample, so whatever agrees for L bytes also agrees at a common sample position.

1. Cover sample.  Sample strings of L-v+1 bytes are ranked among each other; a suffix none of whose sample positions in the
   next v bytes shares its rank with another is unique at depth L and needs no further work (most text ends here).
2. Long ties.  The surviving sample positions are ranked again at depth L+v.  A sample position p that ties there settles all
   suffixes that start in [p, p+v] without looking at them: they tie as well.  Only the first occurrence of such a string
   keeps its suffixes for step 3, since others may still tie with them.
3. Blockwise sort.  What is left goes to buckets, and each bucket of suffixes is sorted by itself; neighbours that agree tie.

Order among strings is that of 64-bit fingerprints, which serves as well as byte order when only ties are asked for; bucket
numbers come from further hash bits.  Two different strings of one bucket tie wrongly with a probability of 2^-64 a pair.
Memory is bounded by a block of text in one place and by a bucket of keys (about 1/400 of the keys of 1 GB, at every size) in
the other; keys that one passage repeats are sent once a block, so very frequent passages and large groups of copies meet in
no one task.

Nulls count as empty.  Texts of fewer than L bytes hold no repeats.  Repeated rows are documents of their own, so rows that
are equal and long enough remove each other.  An empty table gives an empty result; ``remove_repeats`` passes other columns on,
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.llm.blocks import ASK_SCHEMA, BLOCK_BYTES, BlockTable, Keys, ask, asked

MULTIPLIER = 0x9E3779B97F4A7C15


@lru_cache(4)
def difference_cover(limit: int) -> tuple[int, tuple[int, ...]]:
    """The largest modulus v = q*q+q+1 <= limit (q prime) and its q+1 residues: exponents of a generator of GF(q^3) on a plane."""
    best = (1, (0,))
    for q in (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31):
        if q * q + q + 1 <= limit:
            best = (q * q + q + 1, _singer(q))
    return best


def _singer(q: int) -> tuple[int, ...]:
    v, order = q * q + q + 1, q**3 - 1
    for a in range(q):
        for b in range(q):
            for c in range(1, q):
                # powers of x modulo x^3 - a x^2 - b x - c
                x, plane = (0, 0, 1), []
                for i in range(order):
                    if x[0] == 0:
                        plane.append(i % v)
                    x = ((a * x[0] + x[1]) % q, (b * x[0] + x[2]) % q, c * x[0] % q)
                    if x == (0, 0, 1):
                        break
                if i == order - 1:
                    return tuple(sorted(set(plane)))
    raise ValueError(q)


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    up, down = np.empty(n + 1, np.uint64), np.empty(n + 1, np.uint64)
    for out, base in ((up, MULTIPLIER), (down, pow(MULTIPLIER, -1, 2**64))):
        out[0] = 1
        np.multiply.accumulate(np.full(n, base, np.uint64), out=out[1:])
    return up, down, np.random.default_rng(20).integers(0, 2**64, 256, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Finder:
    """The rounds over one block; each is computed anew from the text and the answers of the rounds before."""

    def __init__(self, min_bytes: int, buckets: int):
        self.depth, self.buckets = min_bytes, buckets
        self.v, residues = difference_cover(max(1, min_bytes * 2 // 3))
        self.core = min_bytes - self.v + 1
        self.residues = np.zeros(self.v, bool)
        self.residues[list(residues)] = True

    def _sums(self, data: np.ndarray) -> None:
        size = 1 << max(16, int(len(data)).bit_length())
        up, self.down, table = _powers(size)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(table[data] * up[: len(data)], out=self.sums[1:])

    def _window(self, at: np.ndarray, length: int) -> np.ndarray:
        return (self.sums[at + length] - self.sums[at]) * self.down[at]

    def _keys(self, at: np.ndarray, length: int) -> Keys:
        half = length // 2
        a, b = _mix(self._window(at, half)), _mix(self._window(at + half, length - half) + np.uint64(1))
        bucket = (_mix(a + (b << np.uint64(1))) >> np.uint64(32)) % np.uint64(self.buckets)
        return Keys(bucket.astype(np.int32), _mix(a ^ (b * np.uint64(3))))

    def __call__(self, row: dict, round_no: int) -> Keys | np.ndarray | None:
        """Rounds 0 to 2: the keys to ask about.  Round 3: which bytes are covered.  None where nothing can repeat."""
        data, lens = np.frombuffer(row["data"], np.uint8), np.array(row["lens"], np.int64)
        ends = np.cumsum(lens)
        starts = ends - lens
        long = np.flatnonzero(lens >= self.depth)
        if not len(long):
            return None
        self._sums(data)
        offsets = np.flatnonzero(np.resize(self.residues, int(lens.max())))
        counts = np.searchsorted(offsets, lens[long] - self.core, side="right")
        sample = np.concatenate([offsets[:n] + s for n, s in zip(counts, starts[long], strict=True)])
        doc = np.repeat(long, counts)
        core = _mix(self._window(sample, self.core))
        keys = Keys(((core >> np.uint64(32)) % np.uint64(self.buckets)).astype(np.int32), (core & np.uint64(0xFFFFFFFF)).astype(np.uint32))
        if round_no == 0:
            return keys
        tie = keys.answered(row["a0"], "dup")
        sample, doc = sample[tie], doc[tie]
        if not len(sample):
            return None
        reach = self.depth + self.v
        fits = sample + reach <= ends[doc]
        whole = sample[fits]
        keys = self._keys(whole, reach) if len(whole) else None
        if round_no == 1:
            return keys
        n, edges = len(data), np.zeros(len(data) + 1, np.int32)
        settled = np.empty(0, np.int64)
        if keys is not None:
            dup = keys.answered(row["a1"], "dup")
            settled, kept = whole[dup], (keys.answered(row["a1"], "own") & keys.first)[dup]
            others = settled[~kept]
            np.add.at(edges, others, 1)
            np.add.at(edges, others + self.v + 1, -1)
        excluded = np.cumsum(edges[:n]) > 0
        edges[:] = 0
        np.add.at(edges, np.maximum(sample - self.v + 1, starts[doc]), 1)
        np.add.at(edges, sample + 1, -1)
        open_ = (np.cumsum(edges[:n]) > 0) & ~excluded
        last = np.zeros(n, bool)  # starts too near their document's end
        for e, size in zip(ends, lens, strict=True):
            last[e - min(size, self.depth - 1) : e] = True
        left = np.flatnonzero(open_ & ~last)
        keys = self._keys(left, self.depth) if len(left) else None
        if round_no == 2:
            return keys
        edges[:] = 0
        np.add.at(edges, settled, 1)
        np.add.at(edges, settled + reach, -1)
        if keys is not None:
            found = left[keys.answered(row["a2"], "dup")]
            np.add.at(edges, found, 1)
            np.add.at(edges, found + self.depth, -1)
        return np.cumsum(edges[:n]) > 0


def _spans(covered: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.view(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def _finish(finder: Finder, as_text: bool):
    schema = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("n_bytes", pa.int64()), ("kept", pa.binary())])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {k: v[0] for k, v in batch.slice(i, 1).to_pydict().items()}
                covered, out, at = finder(row, 3), [], 0
                for doc, size in zip(row["ids"], row["lens"], strict=True):
                    text, spans = row["data"][at : at + size], []
                    if covered is not None and covered[at : at + size].any():
                        own = covered[at : at + size]
                        spans, text = _spans(own), np.frombuffer(text, np.uint8)[~own].tobytes()
                        text = text.decode(errors="ignore").encode() if as_text else text
                    out.append({"doc_id": doc, "spans": [{"start": s, "end": e} for s, e in spans], "n_bytes": size, "kept": text})
                    at += size
                for s in range(0, len(out), 500):
                    yield pa.RecordBatch.from_pylist(out[s : s + 500], schema=schema)

    return finish


def repeated_spans(docs: DataFrame, min_bytes: int = 200, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, as_text: bool = False) -> DataFrame:
    """Per document: doc_id, spans (maximal runs of covered bytes, half-open), n_bytes, kept (the remaining bytes; as_text: made valid UTF-8)."""
    blocks = BlockTable(docs, F.col(text_col), id_col, block_bytes, "suffix_blocks")
    finder, answers = Finder(min_bytes, blocks.buckets), []
    for round_no, width in enumerate(("<u4", "<u8", "<u8")):
        sent = blocks.with_answers(*answers).mapInArrow(asked(finder, round_no), ASK_SCHEMA)
        answers.append(ask(sent, width, f"suffix_round{round_no}"))
    return blocks.with_answers(*answers).mapInArrow(_finish(finder, as_text), "doc_id long, spans array<struct<start:long,end:long>>, n_bytes long, kept binary")


def repeat_digest(docs: DataFrame, min_bytes: int = 200, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``repeated_spans`` as counts and a digest of what is kept."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return repeated_spans(docs, min_bytes, block_bytes=block_bytes).select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def remove_repeats(docs: DataFrame, min_bytes: int = 200) -> DataFrame:
    """``docs`` with repeated strings cut from ``text``; all columns stay.  A character that lost some bytes goes whole.

    Rows that are equal in doc_id and text have equal results, so one result serves them all.
    """
    rows = docs.select(F.xxhash64("doc_id", "text").alias("key"), F.struct("*").alias("row"))
    spans = repeated_spans(rows.select("key", "row.text"), min_bytes, "key", as_text=True).where(F.size("spans") > 0)
    cut = spans.select(F.col("doc_id").alias("key"), F.col("kept").cast("string").alias("kept")).dropDuplicates(["key"])
    row = F.col("row")
    return rows.join(cut, "key", "left").select(*((F.coalesce("kept", row[c]) if c == "text" else row[c]).alias(c) for c in docs.columns))
