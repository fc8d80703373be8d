"""Best-fit packing by exact complements.

Texts become token ids, documents longer than a sequence are cut into pieces of its full length, and pieces are packed whole.
What fits together depends on lengths alone, so the plan is made on the counts of pieces by length, a table of at most
``size`` rows whatever the corpus: from the longest length down, a sequence is filled exactly by one, two or three available
lengths that sum to its gap (looked up in an index from sums to the available lengths' singles, pairs and triples), as many times
over as the counts allow; where no such sum exists, the longest available piece that fits goes in, and the rest of the gap is
looked up again.  The plan says for each length which run of its pieces goes to which sequences and where.

Pieces of a length get consecutive numbers without meeting in one task: they are counted by (length, salt), the salts' counts
are summed up to offsets, and each (length, salt) is numbered by itself; a third of all pieces may have one length.  The table of
offsets has at most ``size`` * ``SALTS`` rows, half a million, however many documents there are.

Null texts are empty: a document then holds the end id alone.  Repeated rows are packed once for each row; which of equal
pieces takes which place doesn't matter.  An empty table gives an empty result; columns other than id and text aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexigrid.llm.shared import written
from lexigrid.llm.tokens import encoded


SALTS = 256


def _pieces(vocab: str, end_id: int, size: int):
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for name, ids in encoded(vocab, True, batch):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for k in range(0, len(ids), size):
                    part = ids[k : k + size]
                    out.append((name, k // size, k, len(part), zlib.crc32(part.tobytes())))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return cut


class Sums:
    """Index of the single, pair and triple sums of available lengths.

    ``left[n]``: pieces of length n left, which only ever get fewer, so an entry of the index that no longer can be met never can
    again and is passed over for good.
    """

    def __init__(self, left: np.ndarray):
        self.left = left
        self.pairs: dict[int, list[int]] = {}  # sum -> the greater lengths of its pairs, the least first
        self.triples: dict[int, list[int]] = {}  # sum -> lengths, the least first

    def _lengths(self, low: int, high: int) -> np.ndarray:
        return low + np.flatnonzero(self.left[low : high + 1] > 0)

    def pair(self, total: int, taken: int = 0) -> list[int] | None:
        """Two available lengths, the greatest first; one piece of length ``taken`` is spoken for."""
        if total not in self.pairs:
            greater = self._lengths(-(-total // 2), total - 1)
            self.pairs[total] = greater[self.left[total - greater] > 0].tolist()
        entries = self.pairs[total]
        for k in range(len(entries) - 1, -1, -1):
            x, y = entries[k], total - entries[k]
            if self.left[y] <= 0 or self.left[x] <= (x == y):
                del entries[k]
            elif self.left[x] > (x == y) + (x == taken) and self.left[y] > (y == taken):
                return [x, y]
        return None

    def triple(self, total: int) -> list[int] | None:
        if total not in self.triples:
            self.triples[total] = self._lengths(-(-total // 3), total - 2).tolist()
        entries = self.triples[total]
        while entries:
            if self.left[entries[-1]] > 0 and (two := self.pair(total - entries[-1], entries[-1])):
                return [entries[-1], *two]
            entries.pop()
        return None

    def exact(self, gap: int) -> list[int] | None:
        """One, two or three available lengths that sum to gap."""
        return [gap] if self.left[gap] > 0 else self.pair(gap) or self.triple(gap)


def plan(counts: np.ndarray, size: int) -> pd.DataFrame:
    """counts[n]: pieces of length n.  Rows: length, first, times, each, sequence, offset: pieces first.. of a length, ``each`` a
    sequence one after the other from offset, go to ``times`` sequences from number ``sequence`` on."""
    left = np.zeros(size + 1, np.int64)
    left[: len(counts)] = counts
    used, rows, sequence, sums = np.zeros(size + 1, np.int64), [], 0, Sums(left)
    for longest in range(size, 0, -1):
        while left[longest] > 0:
            pattern, gap = [longest], size - longest
            left[longest] -= 1
            while gap > 0:
                more = sums.exact(gap)
                if not more:  # best fit: the longest piece that fits
                    fitting = np.flatnonzero(left[: gap + 1] > 0)
                    if not len(fitting):
                        break
                    more = [int(fitting[-1])]
                for x in more:
                    left[x] -= 1
                pattern += more
                gap -= sum(more)
            kinds, each = np.unique(pattern, return_counts=True)
            left[kinds] += each
            times = int((left[kinds] // each).min())
            left[kinds] -= each * times
            at = 0
            for x, n in zip(kinds[::-1].tolist(), each[::-1].tolist(), strict=True):
                rows.append((x, int(used[x]), times, n, sequence, at))
                used[x] += n * times
                at += n * x
            sequence += times
    return pd.DataFrame(rows, columns=["length", "first", "times", "each", "sequence", "offset"]).sort_values(["length", "first"], ignore_index=True)


def _place(table: pd.DataFrame):
    keys = (table["length"].to_numpy(np.int64) << 44) + table["first"].to_numpy(np.int64)
    cols = {c: table[c].to_numpy(np.int64) for c in table}

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            length, number = f["length"].to_numpy(np.int64), f.pop("number").to_numpy(np.int64)
            k = np.searchsorted(keys, (length << 44) + number, side="right") - 1
            turn = number - cols["first"][k]
            each = cols["each"][k]
            yield f.assign(sequence_id=cols["sequence"][k] + turn // each, offset=cols["offset"][k] + turn % each * length)

    return place


def pack(docs: DataFrame, vocab: str = "word_bpe_49k.json", end_id: int = 0, size: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    columns = "doc_id long, piece int, start long, length long, ids_crc32 long"
    pieces = written(rows.mapInArrow(_pieces(vocab, end_id, size), columns), "pack_pieces")
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SALTS)))
    counts = written(salted.groupBy("length", "salt").agg(F.count("*").alias("n")), "pack_counts")
    by_length = counts.groupBy("length").agg(F.sum("n").alias("n")).collect()  # a row per length: at most ``size`` rows
    if not by_length:
        return pieces.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    histogram = np.zeros(size + 1, np.int64)
    for r in by_length:
        histogram[r.length] = r.n
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    turn = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    numbered = salted.withColumn("turn", turn).join(offsets, ["length", "salt"])
    numbered = numbered.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("turn") - 1).alias("number"))
    return numbered.mapInPandas(_place(plan(histogram, size)), f"{columns}, sequence_id long, offset long")
