"""Packs, matrices and archives by part."""

import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrid.sources.archives import _line_batches, array_bytes, arrays_of, registered, replaced
from lexigrid.sources.files import scratch


class Counted(io.BytesIO):
    read_so_far = 0

    def read(self, n=-1):
        got = super().read(n)
        self.read_so_far += len(got)
        return got


def pack(arrays):
    data = io.BytesIO()
    np.savez(data, **arrays)
    return data.getvalue()


def test_one_array_of_a_pack_reads_little():
    arrays = {f"a{i}": np.arange(10_000.0) + i for i in range(50)}
    f = Counted(pack(arrays))
    (name, got), = arrays_of(f, {"a7"})
    assert name == "a7" and np.array_equal(got, arrays["a7"])
    assert f.read_so_far < 80_000 + 20_000 < len(f.getvalue()) / 20


def test_packs(spark):
    folder = scratch(registered(spark), "t-packs")
    for p in range(3):
        replaced(folder, f"p{p}.npz", pack({"x": np.full((2, 3), p, np.float32), "y": np.arange(p)}))
    replaced(folder, "other.txt", b"no pack")
    df = spark.read.format("packs").load(folder)
    assert {(r.pack, r.name): (r.shape, r["values"]) for r in df.collect()} == {(f"p{p}", n): s for p in range(3) for n, s in (("x", ([2, 3], [float(p)] * 6)), ("y", ([p], [float(i) for i in range(p)])))}
    assert [r.pack for r in df.where("name = 'y' and size(values) = 2").collect()] == ["p2"]
    assert spark.read.format("packs").option("names", "x,z").load(folder).count() == 3
    replaced(folder, "p0.npz", pack({"x": np.ones(1)}))  # replaced whole
    assert spark.read.format("packs").load(folder).where("pack = 'p0'").count() == 1


def test_matrix(spark):
    folder = scratch(registered(spark), "t-matrix")
    m = np.arange(40, dtype=np.float16).reshape(10, 4)
    replaced(folder, "m.f16", m.tobytes())
    df = spark.read.format("matrix").option("dims", 4).option("rows", 3).load(f"{folder}/m.f16")
    assert [r["values"] for r in df.orderBy("row").collect()] == m.astype(float).tolist()
    some = spark.read.format("matrix").option("dims", 4).option("rows", 3).option("begin", 4).option("end", 6).load(f"{folder}/m.f16")
    assert [r["values"] for r in some.orderBy("row").collect()] == m[4:6].astype(float).tolist()
    parts = lambda d: len({r[1] for r in d.select("row", F.spark_partition_id()).collect()})
    assert parts(some) == 1 and parts(df) == 4
    assert df.where("row = 99").count() == 0
    replaced(folder, "n.f16", m[::-1].tobytes())  # a folder's files follow each other
    whole = spark.read.format("matrix").option("dims", 4).option("rows", 4).option("begin", 8).option("end", 12).load(folder)
    assert [r["values"] for r in whole.orderBy("row").collect()] == np.concatenate([m[8:], m[::-1][:2]]).astype(float).tolist()


@pytest.mark.parametrize("head", ["Video file,Gloss,Participant ID", "filename, LABEL ,user", "video_file,gloss,participant_id"])
def test_splits_by_any_header(spark, head):
    folder = scratch(registered(spark), "t-splits")
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("D/My_Train.CSV", f"{head}\na.mp4, HELLO ,P1\n,NONE,P2\nb.mp4,,P3\n")
        z.writestr("D/valid.csv", ("﻿" + head + '\n"c,1.mp4",TWO,\n').encode())
        z.writestr("notes.csv", "x\n1\n")
        z.writestr("test/clip.mp4", b"\x00")
    replaced(folder, "z.zip", data.getvalue())
    df = spark.read.format("zip_splits").load(folder)
    assert sorted((r.split, r.file, r.gloss, r.participant) for r in df.collect()) == [("train", "a.mp4", "HELLO", "P1"), ("val", "c,1.mp4", "TWO", None)]
    assert spark.read.format("zip_splits").option("splits", "val").load(folder).count() == 1


def test_utf16(spark):
    folder = scratch(registered(spark), "t-utf16")
    data, text = io.BytesIO(), "مرحبا\r\n\r\nğüzel \U0001f600\n"
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("bare.txt", text.encode("utf-16-le"))
        z.writestr("little.txt", b"\xff\xfe" + text.encode("utf-16-le"))
        z.writestr("big.txt", b"\xfe\xff" + text.encode("utf-16-be"))
        z.writestr("empty.txt", b"")
        z.writestr("other.bin", b"\x00")
    replaced(folder, "z.zip", data.getvalue())
    got = {}
    for r in spark.read.format("zip_utf16").load(folder).orderBy("line").collect():
        got.setdefault(r.member, []).append(r.text)
    assert got == dict.fromkeys(["bare.txt", "little.txt", "big.txt"], ["مرحبا", "", "ğüzel \U0001f600"])


def test_small_archives_share_a_partition(spark, sf):
    folder = scratch(registered(spark), "t-many")
    for i in range(300):
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            z.writestr("a.txt", f"{i}\r\n".encode("utf-16-le") * 3)
        replaced(folder, f"z{i:03}.zip", data.getvalue())
    df = spark.read.format("zip_utf16").load(folder)
    assert df.rdd.getNumPartitions() == 2
    assert sorted((r.archive, r.line, r.text) for r in df.collect()) == [(f"z{i:03}.zip", k, str(i)) for i in range(300) for k in (1, 2, 3)]


def test_long_members_come_in_batches():
    lines = ["x" * 1000] * 3000
    got = list(_line_batches("z.zip", "a.txt", iter(f"{x}\r\n" for x in lines)))
    assert len(got) == 3 and [x for b in got for x in b.column("line").to_pylist()] == list(range(1, 3001))
    assert [x for b in got for x in b.column("text").to_pylist()] == lines


def test_array_bytes():
    assert np.array_equal(np.lib.format.read_array(io.BytesIO(array_bytes(np.eye(2)))), np.eye(2))
