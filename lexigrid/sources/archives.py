"""Files that hold many parts: packs of named arrays, matrices of fixed rows, and texts inside archives, read by part.

Each is a Spark data source whose partitions are files, several small ones, or ranges of one, known from the folder's listing alone.  A task opens its file where it
is, reads the index at its end and seeks to the parts asked for; what an option on names or rows excludes is not read.  Files are reached through
pyarrow's file systems, so a folder may be in any store that these know.
"""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _files(path: str, ending: str) -> list[tuple[str, int]]:
    """(path, size) of a folder's files, or of the one file."""
    system, at = _at(path)
    info = system.get_file_info(at)
    found = [info] if info.is_file else system.get_file_info(fs.FileSelector(at, recursive=True))
    return sorted((x.path, x.size) for x in found if x.is_file and x.path.endswith(ending) and not x.base_name.startswith((".", "_")))


@contextmanager
def _opened(base: str, path: str) -> Iterator[io.BufferedReader]:
    with _at(base)[0].open_input_file(path) as f:
        yield f


def replaced(folder: str, name: str, data: bytes) -> None:
    """A file written beside its place and then renamed into it: readers see the old one or the new one, whole."""
    system, at = _at(folder)
    system.create_dir(at, recursive=True)
    part = f"{at}/.{name}-{uuid4().hex}"
    with system.open_output_stream(part) as f:
        f.write(data)
    system.move(part, f"{at}/{name}")


@dataclass
class FilePart(InputPartition):
    path: str


@dataclass
class RowPart(InputPartition):
    """Rows begin to end of a file, whose first row is row ``first`` of the whole."""

    path: str
    first: int = 0
    begin: int = 0
    end: int = 0


class _Reader(DataSourceReader):
    """``only``: the names asked for by the option of that name, separated by commas; None for all.

    Options, not pushed filters: Spark keeps a source's pushed filters for every later use of the same DataFrame."""

    def __init__(self, options: dict, option: str):
        self.options, named = options, options.get(option)
        self.only = set(named.split(",")) if named is not None else None


class _PackReader(_Reader):
    def partitions(self) -> list[FilePart]:
        return [FilePart(p) for p, _ in _files(self.options["path"], ".npz")]

    def read(self, partition: FilePart) -> Iterator[tuple]:
        with _opened(self.options["path"], partition.path) as f:
            for name, array in arrays_of(f, self.only):
                yield partition.path.rpartition("/")[2].removesuffix(".npz"), name, list(array.shape), array.astype(float).ravel().tolist()


def arrays_of(file: io.BufferedReader, only: set[str] | None = None) -> Iterator[tuple[str, np.ndarray]]:
    """The named arrays of an open pack; with ``only`` these alone are read."""
    with zipfile.ZipFile(file) as z:
        for member in z.namelist():
            name = member.removesuffix(".npy")
            if member.endswith(".npy") and (only is None or name in only):
                with z.open(member) as f:
                    yield name, np.lib.format.read_array(f)


class PackSource(DataSource):
    """``spark.read.format("packs").load(folder)``: (pack, name, shape, values) of every array of its .npz files, or of those in the option ``names``."""

    @classmethod
    def name(cls) -> str:
        return "packs"

    def schema(self) -> str:
        return "pack string, name string, shape array<int>, values array<double>"

    def reader(self, schema) -> _PackReader:  # noqa: ANN001
        return _PackReader(self.options, "names")


class _RowReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.low, self.high = options, int(options.get("begin", 0)), options.get("end")
        self.high = None if self.high is None else int(self.high)
        self.dims, self.kind, self.rows = int(options["dims"]), np.dtype(options.get("dtype", "float16")), int(options.get("rows", 65536))

    def partitions(self) -> list[RowPart]:
        out, first, width = [], 0, self.dims * self.kind.itemsize
        for path, size in _files(self.options["path"], ""):
            low, high = max(0, self.low - first), min(size // width, (size // width if self.high is None else self.high - first))
            out += [RowPart(path, first, s, min(s + self.rows, high)) for s in range(low, high, self.rows)]
            first += size // width
        return out or [RowPart("")]

    def read(self, partition: RowPart) -> Iterator[tuple]:
        if not partition.path:
            return
        width = self.dims * self.kind.itemsize
        with _opened(self.options["path"], partition.path) as f:
            f.seek(partition.begin * width)
            got = np.frombuffer(f.read((partition.end - partition.begin) * width), self.kind).reshape(-1, self.dims)
        yield from enumerate(got.astype(float).tolist(), partition.first + partition.begin)


class RowSource(DataSource):
    """``spark.read.format("matrix").option("dims", d).load(path)``: (row, values) of a file of numbers, ``rows`` rows a partition; a folder's files follow
    each other by name.  Options ``begin`` and ``end``: only rows from the one to before the other."""

    @classmethod
    def name(cls) -> str:
        return "matrix"

    def schema(self) -> str:
        return "row long, values array<double>"

    def reader(self, schema) -> _RowReader:  # noqa: ANN001
        return _RowReader(self.options)


#: Names that splits and columns go by.
SPLITS = ("train", "val", "test")
FILE, GLOSS, PARTICIPANT = ("video file", "video_file", "filename"), ("gloss", "label"), ("participant id", "participant_id", "user")


class _SplitReader(_Reader):
    def partitions(self) -> list[FilePart]:
        return [FilePart(p) for p, _ in _files(self.options["path"], ".zip")]

    def read(self, partition: FilePart) -> Iterator[tuple]:
        with _opened(self.options["path"], partition.path) as f, zipfile.ZipFile(f) as z:
            for member in z.namelist():
                low = member.lower()
                split = next((s for s in SPLITS if s in low), None) if low.endswith(".csv") else None
                if split is None or (self.only is not None and split not in self.only):
                    continue
                with z.open(member) as m:
                    for row in csv.DictReader(io.TextIOWrapper(m, encoding="utf-8-sig", newline="")):
                        keys = {(k or "").lower().strip(): v for k, v in row.items()}
                        file, gloss, participant = (next((keys[c] for c in names if keys.get(c)), None) for names in (FILE, GLOSS, PARTICIPANT))
                        if file and gloss:
                            yield partition.path.rpartition("/")[2], split, participant, file, gloss.strip()


class SplitSource(DataSource):
    """``spark.read.format("zip_splits").load(folder)``: (archive, split, participant, file, gloss) of the train, val and test lists inside archives,
    found by their members' names; columns go by any of their usual names.  Rows without file or gloss are left out.  Option ``splits``: only these."""

    @classmethod
    def name(cls) -> str:
        return "zip_splits"

    def schema(self) -> str:
        return "archive string, split string, participant string, file string, gloss string"

    def reader(self, schema) -> _SplitReader:  # noqa: ANN001
        return _SplitReader(self.options, "splits")


@dataclass
class FilesPart(InputPartition):
    paths: list[str]


#: Small files share a partition up to so many bytes; each counts as OPEN_BYTES more.  Lines are handed over some BATCH_LETTERS at a time.
PART_BYTES, OPEN_BYTES, BATCH_LETTERS = 16 << 20, 64 << 10, 1 << 20
LINES = pa.schema([("archive", pa.string()), ("member", pa.string()), ("line", pa.int64()), ("text", pa.string())])


class _Utf16Reader(_Reader):
    def partitions(self) -> list[FilesPart]:
        out, held = [], PART_BYTES
        for path, size in _files(self.options["path"], ".zip"):
            if held + size + OPEN_BYTES > PART_BYTES:
                out.append(FilesPart([]))
                held = 0
            out[-1].paths.append(path)
            held += size + OPEN_BYTES
        return out or [FilesPart([])]

    def read(self, partition: FilesPart) -> Iterator[pa.RecordBatch]:
        for path in partition.paths:
            with _opened(self.options["path"], path) as f, zipfile.ZipFile(f) as z:
                for member in z.namelist():
                    if member.lower().endswith(".txt") and (self.only is None or member in self.only):
                        with z.open(member) as m:
                            mark = m.read(2)
                        kind = {b"\xff\xfe": "utf-16-le", b"\xfe\xff": "utf-16-be"}.get(mark)
                        with z.open(member) as m:
                            m.read(2 if kind else 0)
                            yield from _line_batches(path.rpartition("/")[2], member, io.TextIOWrapper(m, encoding=kind or "utf-16-le"))


def _line_batches(archive: str, member: str, lines: Iterator[str]) -> Iterator[pa.RecordBatch]:
    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([archive] * len(texts)), pa.array([member] * len(texts)), pa.array(range(first, first + len(texts)), pa.int64()), pa.array(texts, pa.string())], schema=LINES)

    texts, first, size = [], 1, 0
    for line in lines:
        texts.append(line.rstrip("\r\n"))
        size += len(line)
        if size > BATCH_LETTERS:
            yield made()
            texts, first, size = [], first + len(texts), 0
    if texts:
        yield made()


class Utf16Source(DataSource):
    """``spark.read.format("zip_utf16").load(folder)``: (archive, member, line, text) of the .txt members of archives, in UTF-16 with or without a mark.
    Option ``members``: only these."""

    @classmethod
    def name(cls) -> str:
        return "zip_utf16"

    def schema(self) -> str:
        return "archive string, member string, line long, text string"

    def reader(self, schema) -> _Utf16Reader:  # noqa: ANN001
        return _Utf16Reader(self.options, "members")


def registered(spark: SparkSession) -> SparkSession:
    """``spark`` with these sources."""
    for source in (PackSource, RowSource, SplitSource, Utf16Source):
        spark.dataSource.register(source)
    return spark


def write_archives(df: DataFrame, folder: str, archive: Column, members: Callable[[pd.DataFrame], dict[str, bytes]], ending: str = ".zip") -> DataFrame:
    """One file for each value of ``archive``, holding ``members`` of its rows; (archive, members) of those written.  A file is as large as its rows: choose ``archive`` so that they fit a task."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        data, name = io.BytesIO(), str(rows["archive"].iloc[0])
        with zipfile.ZipFile(data, "w") as z:
            parts = members(rows)
            for member, content in parts.items():
                z.writestr(member, content)
        replaced(folder, name + ending, data.getvalue())
        return pd.DataFrame({"archive": [name], "members": [len(parts)]})

    return df.withColumn("archive", archive.cast("string")).groupBy("archive").applyInPandas(one, "archive string, members int")


def array_bytes(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.asarray(array))
    return out.getvalue()


def write_packs(df: DataFrame, folder: str, pack: Column, name: str, values: str) -> DataFrame:
    """A pack of named arrays for each value of ``pack``."""
    members = lambda rows: {f"{n}.npy": array_bytes(np.asarray(v, np.float32)) for n, v in zip(rows[name], rows[values], strict=True)}
    return write_archives(df.select(F.col(name), F.col(values), pack.alias("pack")), folder, F.col("pack"), members, ".npz")
