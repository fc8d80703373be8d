"""Token-ID output: ids in Simple-8b words, in files of blocks.

A 64-bit word holds a 4-bit selector and as many ids of one width as fit into 60 bits; selector 15 is an escape and says that
the next word is one id as it stands (of more than 30 bits, or alone at a block's end).  A block holds ``BLOCK_IDS`` ids at
most and has its own word offset in the file's header, so blocks are encoded and decoded side by side, in numpy, and any can
be read without those before.

A *file* is written by its task into the shared folder under a name that nothing reads, then moved to its own: the range of
ids that it is part of, the number of token ids of that part before it, and its own number.  It holds whole documents: their
ids, their numbers of token ids (as Simple-8b too), then the token ids: magic, number of ids, number of blocks, a word offset for
each block, the words.  ``spark.read`` reads it as a binary file.  Parts are ranges of doc_id (nulls first; equal ids by a hash
of the text), so files in order of their names hold the corpus in ascending doc_id order.

Null texts are empty and hold the end id alone.  Repeated rows are written as often as they stand.  An empty table gives no file
and an empty result; columns other than id and text aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem, FileType
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigrid.llm.shared import shared_path, written
from lexigrid.llm.tokens import encoded

#: Fixed values of the format: ids in a word and bits of an id, by selector; selector 15 is the escape.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
ESCAPE = 15
MAGIC, FILE_MAGIC = b"S8B1", b"S8F1"
BLOCK_IDS = 4096
FILE_IDS = 1 << 20


def encode(ids: np.ndarray) -> bytes:
    """Ids as blocks of words."""
    ids = ids.astype(np.uint64)
    n = len(ids)
    starts = np.arange(0, n, BLOCK_IDS)
    ends = np.minimum(starts + BLOCK_IDS, n)
    limit = np.repeat(ends, ends - starts)
    # the best selector at each place: the first whose ids all are narrow enough, of those that end in the block
    best = np.full(n, ESCAPE, np.int8)
    ok = np.arange(n)
    for s in range(14, -1, -1):  # what fits with more ids of fewer bits fits with fewer ids of more bits
        count, width = int(COUNTS[s]), int(WIDTHS[s])
        wide = np.zeros(n + 1, np.int32)
        np.cumsum((ids >> np.uint64(width)) > 0, out=wide[1:])
        ok = ok[ok + count <= limit[ok]]
        ok = ok[wide[ok + count] == wide[ok]]
        best[ok] = s
        if not len(ok):
            break
    alone = best == ESCAPE
    step = COUNTS[best]
    # walk all blocks side by side
    at, where = starts.copy(), []
    owner = np.arange(len(starts))
    live = at < ends
    while live.any():
        where.append((owner[live], at[live]))
        at[live] += step[at[live]]
        live = at < ends
    block = np.concatenate([b for b, _ in where]) if where else np.empty(0, int)
    pos = np.concatenate([p for _, p in where]) if where else np.empty(0, int)
    order = np.argsort(pos, kind="stable")
    block, pos = block[order], pos[order]
    size = 1 + alone[pos].astype(np.int64)
    word_at = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    words[word_at] = best[pos].astype(np.uint64) << np.uint64(60)
    for s in range(2, 15):
        mine = np.flatnonzero(best[pos] == s)
        if len(mine):
            count, width = int(COUNTS[s]), int(WIDTHS[s])
            part = ids[pos[mine][:, None] + np.arange(count)] << (np.arange(count, dtype=np.uint64) * np.uint64(width))
            words[word_at[mine]] |= np.bitwise_or.reduce(part, axis=1)
    out = alone[pos]
    words[word_at[out] + 1] = ids[pos[out]]
    offsets = np.searchsorted(block, np.arange(len(starts)))
    head = np.array([n, len(starts)], "<u4").tobytes()
    return MAGIC + head + (word_at[offsets] if len(starts) else offsets).astype("<u4").tobytes() + words.astype("<u8").tobytes()


def decode(data: bytes, block: int | None = None) -> np.ndarray:
    """All ids, or those of one block, found by its offset."""
    if data[:4] != MAGIC:
        raise ValueError("not Simple-8b")
    n, blocks = np.frombuffer(data, "<u4", 2, 4)
    offsets = np.frombuffer(data, "<u4", int(blocks), 12)
    words = np.frombuffer(data, "<u8", offset=12 + 4 * int(blocks))
    if block is not None:
        words = words[offsets[block] : offsets[block + 1] if block + 1 < blocks else None]
    selector = (words >> np.uint64(60)).astype(np.int64)
    # the word after an escape is an id, whatever its top bits say; escapes in a row of such words alternate
    raw = np.zeros(len(words), bool)
    for i in np.flatnonzero(selector == ESCAPE):
        if not raw[i] and i + 1 < len(words):
            raw[i + 1] = True
    count = np.where(raw, 0, COUNTS[selector])
    first = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), np.uint64)
    for s in range(2, 16):
        mine = np.flatnonzero((selector == s) & ~raw)
        if len(mine) and s != ESCAPE:
            k, width = int(COUNTS[s]), int(WIDTHS[s])
            part = (words[mine][:, None] >> (np.arange(k, dtype=np.uint64) * np.uint64(width))) & np.uint64((1 << width) - 1)
            out[first[mine][:, None] + np.arange(k)] = part
        elif len(mine):
            out[first[mine]] = words[mine + 1]
    return out


def file_bytes(doc_ids: list[int | None], sizes: list[int], ids: np.ndarray) -> bytes:
    """A whole file: its documents' ids, which of these are null, their numbers of token ids, then the token ids."""
    null = np.array([d is None for d in doc_ids], bool)
    names = np.array([0 if d is None else d for d in doc_ids], "<i8")
    counts = encode(np.array(sizes, np.uint64))
    return FILE_MAGIC + np.array([len(doc_ids), len(counts)], "<u4").tobytes() + names.tobytes() + np.packbits(null).tobytes() + counts + encode(ids)


def read_file(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, numbers of token ids, token ids of a file."""
    if data[:4] != FILE_MAGIC:
        raise ValueError("not a token file")
    n, size = (int(x) for x in np.frombuffer(data, "<u4", 2, 4))
    at = 12 + 8 * n
    names, bits = np.frombuffer(data, "<i8", n, 12), np.frombuffer(data, np.uint8, -(-n // 8), at)
    null = np.unpackbits(bits, count=n).astype(bool)
    at += len(bits)
    doc_ids = [None if x else d for d, x in zip(names.tolist(), null.tolist(), strict=True)]
    return doc_ids, decode(data[at : at + size]).astype(np.int64), decode(data[at + size :])


def _folder(spark: SparkSession) -> str:
    """A new folder under the shared one, with its scheme: tasks open files there without Spark's readers."""
    base = shared_path(spark, "token_files")
    if "://" not in base:
        base = base.removeprefix("file:")
        default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
        base = ("file://" if default.startswith("file:") else default.rstrip("/")) + base
    return base


def _files(folder: str, vocab: str, end_id: int, file_ids: int):
    schema = pa.schema([("part", pa.int32()), ("first", pa.int64()), ("n", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, attempt = TaskContext.get().partitionId(), 0, TaskContext.get().taskAttemptId()
        store, path = FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        docs, sizes, parts, held = [], [], [], 0

        def file() -> pa.RecordBatch:
            unfinished = f"{path}/.{part}-{first}-{attempt}"
            with store.open_output_stream(unfinished) as out:
                out.write(file_bytes(docs, sizes, np.concatenate(parts)))
            store.move(unfinished, f"{path}/{part:06d}-{first:016d}-{held:010d}.s8b")  # a task that runs again writes the same
            return pa.RecordBatch.from_pylist([{"part": part, "first": first, "n": held}], schema=schema)

        end = np.array([end_id], np.uint32)
        for batch in batches:
            for name, ids in encoded(vocab, False, batch):
                docs.append(name)
                sizes.append(len(ids) + 1)
                parts += [ids, end]
                held += sizes[-1]
                if held >= file_ids:
                    yield file()
                    first += held
                    docs, sizes, parts, held = [], [], [], 0
        if docs:
            yield file()

    return write


def write_token_files(docs: DataFrame, vocab: str = "byte_bpe_50k.json", end_id: int = 0, file_ids: int = FILE_IDS, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Write all documents as files named part-first-number.s8b, where first counts the part's ids before; the folder."""
    spark = docs.sparkSession
    folder = _folder(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    placed = rows.repartitionByRange("id").sortWithinPartitions("id", F.xxhash64("text"))
    written(placed.mapInArrow(_files(folder, vocab, end_id, file_ids), "part int, first long, n long"), "token_file_names")
    return folder


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("start_in_part", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
    for batch in batches:
        for i in range(batch.num_rows):
            row = {k: v[0] for k, v in batch.slice(i, 1).to_pydict().items()}
            names, sizes, ids = read_file(row["content"])
            ids, ends = ids.astype("<u4"), np.cumsum(sizes)
            for s in range(0, len(names), 500):
                out = [{"part": row["part"], "doc_id": d, "start_in_part": row["first"] + int(e - n), "n_tokens": int(n), "ids": ids[e - n : e].tobytes()} for d, n, e in zip(names[s : s + 500], sizes[s : s + 500], ends[s : s + 500], strict=True)]
                yield pa.RecordBatch.from_pylist(out, schema=schema)


READ = "doc_id long, start long, n_tokens long, ids binary"


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids (little-endian unsigned 32-bit numbers), from the files alone."""
    store, path = FileSystem.from_uri(folder)
    if store.get_file_info(path).type == FileType.NotFound:  # no document, no file
        return spark.createDataFrame([], READ)
    place = lambda k: F.regexp_extract("path", r"([0-9]+)-([0-9]+)-([0-9]+)\.s8b$", k).cast("long")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.s8b").load(folder).withColumns({"part": place(1).cast("int"), "first": place(2), "n": place(3)})
    totals = files.groupBy("part").agg(F.sum("n").alias("n"))  # a row for each part, from the files' names
    before = totals.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rows = files.select("part", "first", "content").mapInArrow(_read, "part int, doc_id long, start_in_part long, n_tokens long, ids binary")
    return rows.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("start_in_part")).alias("start"), "n_tokens", "ids")


def token_report(docs: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, from the files read back."""
    return read_token_files(docs.sparkSession, write_token_files(docs)).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
