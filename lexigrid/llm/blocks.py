"""Blocks of documents, and asking about all blocks' keys.

A *block* is one row that holds a few MB of whole documents, so that a task works on numpy arrays instead of rows.
``BlockTable`` writes them once, bucketed by block number.  ``ask`` sends every block's distinct 64-bit keys to the
bucket of each key, one row of packed keys for a block and bucket, answers there for each key and gives the answers
back as bit masks in the order of the keys sent.  Keys are pre-aggregated in their block, so a key costs at most one
entry a block however often it occurs, and a bucket holds about the same number of keys at every input size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.llm.shared import shuffle_partitions, written, written_buckets

BLOCK_BYTES = 4_000_000
BUCKET_BYTES = 16 << 20


def buckets_for(spark: SparkSession, total: int) -> int:
    """Buckets of about 16 MB of text, two at least for each task of a shuffle."""
    return max(2 * shuffle_partitions(spark), -(-total // BUCKET_BYTES))


def _pack(block_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("lens", pa.list_(pa.int32())), ("data", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, texts, size = TaskContext.get().partitionId() << 24, [], [], 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"block": block, "ids": ids, "lens": [len(x) for x in texts], "data": b"".join(texts)}], schema=schema)

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ids and size + len(text) > block_bytes:
                    yield row()
                    block, ids, texts, size = block + 1, [], [], 0
                ids.append(i)
                texts.append(text)
                size += len(text)
        if ids:
            yield row()

    return pack


class BlockTable:
    """Documents as blocks.  ``text`` is any Column of strings or bytes; null counts as empty."""

    def __init__(self, docs: DataFrame, text: Column, id_col: str = "doc_id", block_bytes: int = BLOCK_BYTES, label: str = "blocks"):
        spark = docs.sparkSession
        rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text.cast("binary"), F.lit(b"").cast("binary")).alias("data"))
        blocks = rows.mapInArrow(_pack(block_bytes), "block long, ids array<long>, lens array<int>, data binary")
        self.table = written_buckets(blocks, label, "block", shuffle_partitions(spark))
        total = self.table.select(F.sum(F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
        self.bytes, self.buckets = total, buckets_for(spark, total)

    def with_answers(self, *answers: DataFrame) -> DataFrame:
        """The blocks beside what was answered to them in each round: a0, a1, ... are arrays of (bucket, dup, own)."""
        out = self.table
        for k, answer in enumerate(answers):
            by_block = answer.groupBy("block").agg(F.collect_list(F.struct("bucket", "dup", "own")).alias(f"a{k}"))
            out = out.join(by_block.hint("shuffle_hash"), "block", "left")
        return out


class Keys:
    """A block's keys, each with its bucket, as sent to ``ask``: distinct and sorted by bucket and key."""

    def __init__(self, bucket: np.ndarray, key: np.ndarray):
        order = np.lexsort((key, bucket))
        b, k = bucket[order], key[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (b[1:] != b[:-1])
        self.place = np.empty(len(k), np.int64)  # of each key given among the distinct ones
        self.place[order] = np.cumsum(new) - 1
        self.first = np.zeros(len(k), bool)  # lexsort is stable: the first of equal keys in the order given
        self.first[order[new]] = True
        at = np.flatnonzero(new)
        self.many = np.diff(np.append(at, len(k))) > 1
        self.bucket, self.key = b[at], k[at]
        starts = np.flatnonzero(np.diff(self.bucket, prepend=-1))
        self.cuts = list(zip(starts, np.append(starts[1:], len(self.bucket)), strict=False))  # none without keys

    def rows(self, block: int) -> Iterator[dict]:
        for s, e in self.cuts:
            yield {"bucket": int(self.bucket[s]), "block": block, "keys": self.key[s:e].tobytes(), "many": np.packbits(self.many[s:e]).tobytes()}

    def answered(self, answers: list[dict] | None, name: str) -> np.ndarray:
        """For each key given, the bit ``name`` of its answer."""
        got, bits = {a["bucket"]: a[name] for a in answers or []}, np.zeros(len(self.key), bool)
        for s, e in self.cuts:
            bits[s:e] = np.unpackbits(np.frombuffer(got[int(self.bucket[s])], np.uint8), count=e - s)
        return bits[self.place]


ASK_SCHEMA = "bucket int, block long, keys binary, many binary"


def _answer(width: str) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        """dup: the key was sent by two blocks or stands twice in one.  own: of those that sent it, the smallest block."""
        rows = rows.sort_values("block")
        sent = [np.frombuffer(x, width) for x in rows["keys"]]
        sizes = [len(x) for x in sent]
        key = np.concatenate(sent)
        many = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(rows["many"], sizes, strict=True)]).astype(bool)
        order = np.argsort(key, kind="stable")
        k = key[order]
        new = np.ones(len(k), bool)
        new[1:] = k[1:] != k[:-1]
        group = np.cumsum(new) - 1
        repeated = (np.bincount(group) > 1) | np.maximum.reduceat(many[order], np.flatnonzero(new))
        dup, own = np.empty(len(k), bool), np.empty(len(k), bool)
        dup[order], own[order] = repeated[group], new
        ends = np.cumsum(sizes)
        cut = [slice(e - n, e) for e, n in zip(ends, sizes, strict=True)]
        return pd.DataFrame({"block": rows["block"], "bucket": rows["bucket"], "dup": [np.packbits(dup[c]).tobytes() for c in cut], "own": [np.packbits(own[c]).tobytes() for c in cut]})

    return answer


def asked(state: Callable, round_no: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function over blocks: ``state(row)`` gives the round's Keys, or None."""
    schema = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("many", pa.binary())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pydict()
                keys = state({k: v[0] for k, v in row.items()}, round_no)
                if keys is not None:
                    yield pa.RecordBatch.from_pylist(list(keys.rows(row["block"][0])), schema=schema)

    return send


def ask(entries: DataFrame, width: str, label: str) -> DataFrame:
    """Answers to packed rows: (block, bucket, dup, own), written."""
    return written(entries.groupBy("bucket").applyInPandas(_answer(width), "block long, bucket int, dup binary, own binary"), label)
