import random
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from plain_jpeg import walk
from tokenizers import Tokenizer

from lexigrid.llm import media
from lexigrid.llm.packing import Sums, pack, plan
from lexigrid.llm.simple8b import decode, encode, file_bytes, read_file, read_token_files, token_report, write_token_files
from lexigrid.llm.tokens import Encoder, vocabulary

ODD = ["", " ", "  a  b ", "a\n\nb\n c", "tab\tx", "It's  we'll don't", "a b c", "x\x1cy z", "é é ́x", "日本語 テスト", "<|endoftext|> x", "a <|endoftext|>b", "12 345,6", "wow!!! (ok).", "ΣΑΣ ΣΑΣ", "İI ı", "a\r\nb", "trail \n", "\nlead", "q" * 3000, "...a.b.c", "the,the.The THE,", "é.\nÉ."]


@pytest.mark.parametrize(("name", "drops"), [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_encoder_equals_tokenizer(spark, sf, name, drops):
    texts = ODD + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    plain = Tokenizer.from_file(vocabulary(name))
    rnd = random.Random(2)
    texts += ["".join(rnd.choice(["a", "B", " ", "\n", "'", "s", ".", "é", "1", "\t", " ", "\x1d", "ll"]) for _ in range(60)) for _ in range(300)]
    got = Encoder(name, drops).encode([t.encode() for t in texts])
    for text, ids in zip(texts, got, strict=True):
        assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids, text[:80]


def test_simple8b_round_trip():
    rnd = np.random.default_rng(3)
    for n in (1, 2, 239, 240, 241, 4095, 4096, 4097, 20000):
        for bits in (0, 1, 3, 8, 16, 31, 60, 63):
            ids = rnd.integers(0, 2**bits, n, dtype=np.uint64) * rnd.integers(0, 2, n, dtype=np.uint64)
            data = encode(ids)
            assert (decode(data) == ids).all()
            assert (decode(data, (n - 1) // 4096) == ids[(n - 1) // 4096 * 4096 :]).all()
    assert len(encode(np.zeros(24000, np.uint64))) < 1200
    with pytest.raises(ValueError):
        decode(b"nope" + bytes(20))


def test_token_report_against_tokenizer(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "", None, None, None)], docs.schema)
    docs = docs.union(extra).repartition(5)
    plain, start = Tokenizer.from_file(vocabulary("byte_bpe_50k.json")), 0
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_report(docs).collect()}
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        ids = [*plain.encode(r.text or "", add_special_tokens=False).ids, 0]
        assert got[r.doc_id] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_report(docs.limit(0)).count() == 0
    small = write_token_files(docs, file_ids=1000)
    assert {r.doc_id: (r.start, r.n_tokens) for r in read_token_files(spark, small).collect()} == {k: v[:2] for k, v in got.items()}
    files = sorted(Path(small.removeprefix("file://")).glob("*"))
    assert len(files) > 10 and not list(Path(small.removeprefix("file://")).glob(".[0-9]*-[0-9]*-[0-9]*[0-9]"))
    names, sizes, ids = read_file(files[-1].read_bytes())  # a plain file, whatever wrote it
    assert names[-1] == 10**6 + 1 and sizes[-1] == 1 and sizes.sum() == len(ids)


def test_token_files_edges(spark):
    docs = spark.createDataFrame([(7, "x y", 1), (7, "x y", 2), (None, "z", 3), (None, None, 4), (-3, "w " * 9000, 5)], "doc_id long, text string, part int")
    rows = sorted(((r.start, r.doc_id, r.n_tokens) for r in token_report(docs).collect()))
    assert [r[1] for r in rows] == [None, None, -3, 7, 7] and rows[-1][2] == rows[-2][2]
    assert all(a[0] + a[2] == b[0] for a, b in zip(rows, rows[1:])) and rows[0][0] == 0
    assert read_file(file_bytes([None, -1], [2, 1], np.array([5, 0, 0])))[0] == [None, -1]


def check_packing(rows, size=2048):
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(held)


def test_packing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(10**6, None), (10**6 + 1, ""), (5, "twice"), (5, "twice")], "doc_id long, text string"))
    plain = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    rows = pack(docs).collect()
    want = defaultdict(list)
    for r in docs.collect():
        ids = [*plain.encode(r.text or "", add_special_tokens=False).ids, 0]
        want[r.doc_id] += [(k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes())) for k in range(0, len(ids), 2048)]
    got = defaultdict(list)
    for r in rows:
        got[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    n, total = check_packing(rows), sum(r.length for r in rows)
    assert n <= -(-total // 2048) * 1.05 + 2
    assert pack(docs.limit(0)).count() == 0


def test_plan_uses_every_piece_once():
    rnd = np.random.default_rng(4)
    for most in (1, 5, 1000):
        counts = np.zeros(2049, np.int64)
        np.add.at(counts, rnd.integers(1, 2049, 3 * most), rnd.integers(1, most + 1))
        table, used = plan(counts, 2048), np.zeros(2049, np.int64)
        np.add.at(used, table.length, table.times * table.each)
        assert (used == counts).all()
        filled = (table.times * table.each * table.length).sum()
        assert filled == (counts * np.arange(2049)).sum()


def test_index_of_sums_against_all_combinations():
    from itertools import combinations_with_replacement

    rnd = np.random.default_rng(9)
    for _ in range(60):
        left = np.zeros(41, np.int64)
        np.add.at(left, rnd.integers(1, 41, 12), 1)
        sums = Sums(left)
        for _ in range(15):
            gap = int(rnd.integers(1, 41))
            some = any(sum(c) == gap and all(left[x] >= c.count(x) for x in c) for n in (1, 2, 3) for c in combinations_with_replacement(np.flatnonzero(left).tolist(), n))
            got = sums.exact(gap)
            assert (got is not None) == some and (not got or sum(got) == gap)
            for x in got or []:
                left[x] -= 1
            assert (left >= 0).all()


def test_media_round_trip(spark, sf):
    rnd = np.random.default_rng(5)
    for n in (64, 128, 640, 64 * 8191, 64 * 8192):
        payload = rnd.integers(0, 256, n, dtype=np.uint8).tobytes()
        data = media.to_jpeg(payload)
        image = media.parse(data)
        assert media.dc_thumbnail(image).tobytes()[:n] == payload
        if n <= 640:
            level = np.array(walk(image, 1, True, image["width"] // 8, image["height"] // 8, 1, 1))
            assert (np.clip(level + 128, 0, 255).astype(np.uint8).tobytes()) == payload
    with pytest.raises(ValueError):
        media.parse(b"\x89PNG")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(10**6, None), (10**6 + 1, "")], "doc_id long, text string"))
    import hashlib

    got = {r.doc_id: r for r in media.media_features(media.add_media(docs)).collect()}
    for r in docs.collect():
        text = (r.text or "").encode()
        payload = text + bytes(-len(text) % 64 or (0 if text else 64))
        g = got[r.doc_id]
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


def test_colour_jpeg_with_restarts():
    """A 16x16 image of two components by hand: 2x1 luminance sampling, restart interval 1, one AC coefficient."""
    bits = lambda s: np.packbits([int(x) for x in s] + [1] * (-len(s) % 8)).tobytes().replace(b"\xff", b"\xff\0")
    dc = bytes([0, 2] + [0] * 14) + bytes([0, 3])  # codes 00: size 0, 01: size 3
    ac = bytes([0, 2] + [0] * 14) + bytes([0, 1])  # 00: end of block, 01: next coefficient of size 1
    unit = "01" + "101" + "01" + "1" + "00" + "00" + "00" + "00" + "00"  # y: +5 with an AC value, y: +0, cb: 0
    scan = bits(unit) + b"\xff\xd0" + bits("01" + "010" + "00" + "00" + "00" + "00" + "00")
    seg = media._segment
    data = b"".join([b"\xff\xd8", seg(0xDB, b"\0" + bytes([16]) + bytes([1] * 63)), seg(0xC0, bytes([8, 0, 16, 0, 16, 2, 1, 0x21, 0, 2, 0x11, 0])), seg(0xC4, b"\x00" + dc), seg(0xC4, b"\x10" + ac), seg(0xDD, bytes([0, 1])), seg(0xDA, bytes([2, 1, 0, 2, 0, 0, 63, 0])), scan, b"\xff\xd9"])
    assert media.dc_thumbnail(media.parse(data)).tolist() == [[138, 138], [118, 118]]


@pytest.mark.parametrize("sampling", [(1,), (1, 1, 1), (2, 1, 1), (4,)])
@pytest.mark.parametrize("restart", [0, 3])
def test_any_tables_and_sampling(sampling, restart, monkeypatch):
    """Scans of random symbols under random code lengths, read in small parts, against the bit-by-bit reader."""
    monkeypatch.setattr(media, "PART_BYTES", 48)
    rnd = np.random.default_rng(len(sampling) + restart)
    dc_len, ac_len = [0, 1, 2, 2, 2, 1] + [0] * 10, [0, 1, 2, 1, 3, 2] + [0] * 10
    dc_sym, ac_sym = rnd.permutation(8).tolist(), [0x00, 0xF0, 0x01, 0x11, 0x23, 0x32, 0x05, 0x71, 0x0A]
    codes = []
    for lens, symbols in ((dc_len, dc_sym), (ac_len, ac_sym)):
        code, k, table = 0, 0, {}
        for n, count in enumerate(lens, 1):
            for _ in range(count):
                table[symbols[k]] = f"{code:0{n}b}"
                code, k = code + 1, k + 1
            code <<= 1
        codes.append(table)
    value = lambda size: "".join(rnd.choice(["0", "1"], size)) if size else ""

    def block():
        size = int(rnd.choice(dc_sym))
        out, n = codes[0][size] + value(size), 1
        while n < 64:
            symbol = int(rnd.choice(ac_sym, p=[0.3, 0.05, *[0.65 / 7] * 7]))
            step = 64 if symbol == 0 else (symbol >> 4) + 1
            if symbol and n + step > 64:
                continue
            out += codes[1][symbol] + value(symbol & 15)
            n += step
        return out

    one = len(sampling) == 1
    width, height = 37 * 8 - 3, 5 * 16 - 9
    across, down = -(-width // (8 * (1 if one else max(sampling)))), -(-height // 8)
    units = [("".join(block() for n in sampling for _ in range(1 if one else n))) for _ in range(across * down)]
    runs = ["".join(units[k : k + (restart or len(units))]) for k in range(0, len(units), restart or len(units))]
    packed = [np.packbits([int(x) for x in r] + [1] * (-len(r) % 8)).tobytes().replace(b"\xff", b"\xff\0") for r in runs]
    scan = b"".join(p + (bytes([255, 0xD0 + k % 8]) if k + 1 < len(packed) else b"") for k, p in enumerate(packed))
    seg = media._segment
    parts = b"".join(bytes([k + 1, (n << 4) | 1, 0]) for k, n in enumerate(sampling))
    head = [seg(0xDB, b"\0" + bytes([8]) + bytes([1] * 63)), seg(0xC0, bytes([8, height >> 8, height & 255, width >> 8, width & 255, len(sampling)]) + parts), seg(0xC4, b"\x00" + bytes(dc_len) + bytes(dc_sym)), seg(0xC4, b"\x10" + bytes(ac_len) + bytes(ac_sym)), seg(0xDD, bytes([0, restart]))]
    data = b"".join([b"\xff\xd8", *head, seg(0xDA, bytes([len(sampling)]) + b"".join(bytes([k + 1, 0]) for k in range(len(sampling))) + bytes([0, 63, 0])), scan, b"\xff\xd9"])
    image = media.parse(data)
    thumb = media.dc_thumbnail(image)
    level = np.array(walk(image, 1, one, thumb.shape[1], thumb.shape[0], 1, 1 if one else max(sampling)))
    assert thumb.tolist() == np.clip((level * 8 + 4 + 1024) // 8, 0, 255).tolist() and len(set(thumb.ravel().tolist())) > 20


def test_media_edges(spark):
    docs = spark.createDataFrame([(1, "a", "x"), (1, "a", "y"), (None, "b", "z"), (2, None, None)], "doc_id long, text string, media string")
    got = media.media_features(media.add_media(docs)).collect()
    assert sorted((r.doc_id or 0, r.n_bytes) for r in got) == [(0, 1), (1, 1), (1, 1), (2, 0)]
    assert len({tuple(r)[1:] for r in got if r.doc_id == 1}) == 1
    assert media.media_features(media.add_media(docs.limit(0))).count() == 0


def test_media_of_several_images():
    """A payload over what one image holds, at the bound and beyond it; the real bound is 66,576,448 bytes."""
    from lexigrid.llm import media

    assert media.MOST == 66_576_448
    payload = bytes(np.random.default_rng(4).integers(0, 256, 64 * 31, dtype=np.uint8))
    for most, count in ((64 * 31, 1), (64 * 30, 2), (64 * 10, 4), (64, 31)):
        stored = media.to_media(payload, most)
        found = list(media.images(stored))
        assert len(found) == count and found[-1]["end"] == len(stored)
        assert b"".join(media.dc_thumbnail(x).tobytes()[: int.from_bytes(x["comment"])] for x in found) == payload
