"""Media columns: payloads as baseline JPEG images, read back without an image library.

``add_media`` stores a payload as a gray baseline JPEG with one 8x8 block for each byte: the DC coefficient is quantised by 8, so
a block whose coefficient is byte-128 is flat and has the byte as its sample value, and the image's DC-only thumbnail (a pixel
for each block) is the payload, bit for bit.  Its DC Huffman code gives category s (0 to 8) a code of 9-s bits, so code and
magnitude bits come to 9 bits for every difference, and the AC code's only symbol, end of block, takes one more: any JPEG
reader can read it.

``dc_thumbnail`` reads any baseline JPEG (1 to 4 components, any Huffman tables and sampling factors, restart intervals): it
parses the markers, decodes the scan's Huffman codes in numpy and keeps luminance DC coefficients only.

Null payloads count as empty; an empty payload is padded to one row of 64 zero bytes.  The longest side of a JPEG is 65,535
samples, so payloads over 64 * 8191 bytes get wider rows, in multiples of 64 blocks, and payloads over ``MOST`` bytes (some 66 MB) are
several images, one after the other; the comment marker holds the true length of each.
Images are made and read a document at a time, so memory is bounded by the longest document.  Equal texts give equal images,
repeated rows a row each, an empty table an empty result; columns other than id and text aren't read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROW = 64
MOST_ROWS = 65535 // 8
MOST = ROW * MOST_ROWS * (65535 // (8 * ROW))
BATCH_BYTES = 8 << 20


def _codes() -> np.ndarray:
    """10 bits for each difference from -255 to 255: code of its category, magnitude, end of block."""
    out = np.zeros(511, np.uint64)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        code = (1 << (9 - s)) - 2  # s = 8: 0; 7: 10; 6: 110; ... the canonical code
        out[d + 255] = ((code << s) | (d if d >= 0 else d + (1 << s) - 1)) << 1
    return out


CODES = _codes()
DC_LENGTHS, DC_SYMBOLS = bytes([1] * 9 + [0] * 7), bytes(range(8, -1, -1))
AC_LENGTHS, AC_SYMBOLS = bytes([1] + [0] * 15), b"\0"


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


def to_media(payload: bytes, most: int = MOST) -> bytes:
    """``payload``, a positive multiple of 64 bytes, as images in a row of ``most`` bytes each."""
    return b"".join(to_jpeg(payload[s : s + most]) for s in range(0, len(payload), most))


def images(media: bytes) -> Iterator[dict]:
    """The parsed images of a row of them."""
    at = 0
    while at < len(media):
        image = parse(media, at)
        at = image["end"]
        yield image


def to_jpeg(payload: bytes) -> bytes:
    """``payload``: a positive multiple of 64 bytes, ``MOST`` at most."""
    width = ROW * -(-len(payload) // (ROW * MOST_ROWS))
    rows = -(-len(payload) // width)
    data = np.frombuffer(payload.ljust(rows * width, b"\0"), np.uint8)
    level = data.astype(np.int32) - 128
    bits = CODES[np.diff(level, prepend=0) + 255].reshape(-1, 4)
    word = (bits[:, 0] << np.uint64(30)) | (bits[:, 1] << np.uint64(20)) | (bits[:, 2] << np.uint64(10)) | bits[:, 3]
    scan = word.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].tobytes().replace(b"\xff", b"\xff\0")
    return b"".join([
        b"\xff\xd8", _segment(0xFE, struct.pack(">Q", len(payload))), _segment(0xDB, b"\0" + bytes([8]) + bytes([1] * 63)),
        _segment(0xC0, struct.pack(">BHHB", 8, rows * 8, width * 8, 1) + bytes([1, 0x11, 0])),
        _segment(0xC4, b"\x00" + DC_LENGTHS + DC_SYMBOLS), _segment(0xC4, b"\x10" + AC_LENGTHS + AC_SYMBOLS),
        _segment(0xDA, bytes([1, 1, 0, 0, 63, 0])), scan, b"\xff\xd9",
    ])


def parse(data: bytes, at: int = 0) -> dict:
    """Markers up to the scan: size, comment, components, quantiser steps, Huffman tables, restart interval, scan bytes; and where the image ends."""
    if data[at : at + 2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    out: dict = {"quant": {}, "huff": {}, "restart": 0, "comment": b""}
    at += 2
    while True:
        if data[at] != 255:
            raise ValueError("marker expected")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        size = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xFE:
            out["comment"] = body
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                out["quant"][body[0] & 15] = struct.unpack_from(">H" if wide else ">B", body, 1)[0]
                body = body[1 + 64 * (1 + wide) :]
        elif marker in (0xC0, 0xC1):
            _, out["height"], out["width"], n = struct.unpack_from(">BHHB", body)
            out["parts"] = {body[6 + 3 * i]: {"h": body[7 + 3 * i] >> 4, "v": body[7 + 3 * i] & 15, "q": body[8 + 3 * i]} for i in range(n)}
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("only baseline JPEG is read")
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                out["huff"][body[0]] = (body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDD:
            out["restart"] = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            out["order"] = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
            end = data.find(b"\xff\xd9", at)  # within a scan 255 is followed by 0 or a restart marker
            out["scan"], out["end"] = (data[at:end], end + 2) if end >= 0 else (data[at:], len(data))
            return out


class _Codes:
    """For each 16 bits that begin with a code: the code's length (0: none does), its symbol, and both with the magnitude bits."""

    def __init__(self, lengths: bytes, symbols: bytes):
        self.size, self.symbol, code, k = np.zeros(65536, np.uint8), np.zeros(65536, np.uint8), 0, 0
        for n, count in enumerate(lengths, 1):
            for _ in range(count):
                own = slice(code << (16 - n), (code + 1) << (16 - n))
                self.size[own], self.symbol[own] = n, symbols[k]
                code, k = code + 1, k + 1
            code <<= 1
        no_code = np.where(self.size > 0, 0, 1 << 24).astype(np.int32)
        self.dc_step = self.size + self.symbol.astype(np.int32) + no_code
        self.ac_step = self.size + (self.symbol & 15).astype(np.int32) + no_code
        self.places = np.where(self.symbol == 0, 64, (self.symbol >> 4) + 1).astype(np.uint8)  # coefficients that a symbol takes


_codes_of = lru_cache(64)(_Codes)


def _restarts(scan: bytes) -> list[bytes]:
    out, start, at = [], 0, scan.find(b"\xff")
    while at >= 0:
        if 0xD0 <= scan[at + 1 : at + 2][0] <= 0xD7 if at + 1 < len(scan) else False:
            out.append(scan[start:at])
            start = at + 2
        at = scan.find(b"\xff", at + 2)
    return [*out, scan[start:]]


#: Bytes of a scan that are decoded at once, and the most that one block's codes take.
PART_BYTES = 1 << 16
BLOCK_BYTES = 212
#: Jumps over 2, 4, ... 16 units: the decoder steps by the largest, then fills in.
DOUBLINGS = 4


def _block_ends(codes: np.ndarray, dc: _Codes, ac: _Codes) -> np.ndarray:
    """Where a block would end that began at each bit; ``codes``: the 16 bits from each bit on, with one more at the end, whose
    place also stands for ends too far on and for bits where no block begins."""
    far = len(codes) - 1
    ends = np.arange(far + 1, dtype=np.int32)
    ends += dc.dc_step[codes]
    np.minimum(ends, far, out=ends)
    code = codes[ends]
    live = ac.places[code] < 63
    ends += ac.ac_step[code]
    np.minimum(ends, far, out=ends)
    live = np.flatnonzero(live & (ends < far))
    place = 1 + ac.places[code[live]].astype(np.int32)
    while len(live):
        code = codes[ends[live]]
        ends[live] = np.minimum(ends[live] + ac.ac_step[code], far)
        place += ac.places[code]
        on = (place < 64) & (ends[live] < far)
        live, place = live[on], place[on]
    return ends


def _differences(scan: bytes, blocks: list[tuple], units: int) -> np.ndarray:
    """(unit, block): the DC differences of a scan without restarts, whose units are ``blocks`` of (DC table, AC table).

    Huffman codes are decoded from all bits at once: where a block would end if one began there.  From the scan's first bit the
    blocks that do begin are found by jumps of 16 units and then by halves of them.  Parts of bounded size follow each other.
    """
    data = np.frombuffer(scan.replace(b"\xff\0", b"\xff"), np.uint8)
    margin, out, found, begin = BLOCK_BYTES * len(blocks), [], 0, 0
    kinds = {(id(dc), id(ac)): (dc, ac) for dc, ac in blocks}
    for start in range(0, len(data), PART_BYTES):
        part = data[start : start + PART_BYTES + margin + 8].astype(np.uint32)
        size = 8 * min(PART_BYTES, len(data) - start)
        padded = np.concatenate([part, np.full(8, 255, np.uint32)])
        three = (padded[:-2] << np.uint32(16)) | (padded[1:-1] << np.uint32(8)) | padded[2:]
        codes = (three[:, None] >> np.arange(8, 0, -1, dtype=np.uint32)).astype(np.uint16).ravel()[:-7]
        ends = {k: _block_ends(codes, *v) for k, v in kinds.items()}
        unit_end = ends[id(blocks[0][0]), id(blocks[0][1])]
        for dc, ac in blocks[1:]:
            unit_end = ends[id(dc), id(ac)][unit_end]
        jump = np.where(unit_end < size, unit_end, len(codes) - 1)  # units that begin past the part belong to the next one
        jumps = [jump]
        for _ in range(DOUBLINGS):
            jumps.append(jumps[-1][jumps[-1]])
        at, anchors = begin, []
        while at < size and len(anchors) << DOUBLINGS < units - found:
            anchors.append(at)
            at = int(jumps[-1][at])
        units_at = np.array(anchors, np.int64)
        for j in jumps[-2::-1]:
            more = j[units_at]
            units_at = np.concatenate([units_at, more[more < size]])
        units_at = np.sort(units_at)[: units - found]
        if not len(units_at):
            begin -= size
            continue
        place, values = units_at, []
        for dc, ac in blocks:
            code = codes[place]
            length, bits = dc.size[code].astype(np.int64), dc.symbol[code].astype(np.int64)
            after = np.minimum(place + length, len(codes) - 1)
            magnitude = codes[after].astype(np.int64) >> (16 - bits)
            values.append(np.where((magnitude >> np.maximum(bits - 1, 0)) > 0, magnitude, magnitude - (1 << bits) + 1) * (bits > 0))
            place = ends[id(dc), id(ac)][place]
        if (place >= 8 * (len(part) + 1)).any():
            raise ValueError("broken scan")
        out.append(np.stack(values, axis=1))
        found += len(units_at)
        if found == units:
            break
        begin = int(unit_end[units_at[-1]]) - size
    if found < units:
        raise ValueError("broken scan")
    return np.concatenate(out)


def dc_thumbnail(image: dict) -> np.ndarray:
    """Luminance (first component) samples 0 to 255, one for each 8x8 block."""
    first, parts, order = image["order"][0][0], image["parts"], image["order"]
    y = parts[first]
    tall, wide = max(p["v"] for p in parts.values()), max(p["h"] for p in parts.values())
    one = len(order) == 1
    cols, rows = -(-image["width"] * y["h"] // (8 * wide)), -(-image["height"] * y["v"] // (8 * tall))
    h, v = (1, 1) if one else (y["h"], y["v"])
    across, down = (cols, rows) if one else (-(-image["width"] // (8 * wide)), -(-image["height"] // (8 * tall)))
    tables = {k: _codes_of(*x) for k, x in image["huff"].items()}
    blocks = [(tables[dc], tables[16 + ac]) for part, dc, ac in order for _ in range(1 if one else parts[part]["h"] * parts[part]["v"])]
    levels, left = [], across * down
    for run in _restarts(image["scan"]) if image["restart"] else [image["scan"]]:
        units = min(image["restart"] or left, left)
        if units:
            levels.append(np.cumsum(_differences(run, blocks, units)[:, : h * v].ravel()).reshape(units, h * v))
        left -= units
    if left:
        raise ValueError("broken scan")
    grid = np.concatenate(levels).reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)[:rows, :cols]
    return np.clip((grid * image["quant"][y["q"]] + 4 + 1024) // 8, 0, 255).astype(np.uint8)


def thumbnail_hash(thumb: np.ndarray) -> str:
    """64 bits: whether of 9 x 8 even cells each is brighter on average than the one before in its row of cells."""

    def ends(n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        start = np.arange(n) * size // n
        return start, np.maximum(np.arange(1, n + 1) * size // n, start + 1)

    (top, bottom), (left, right) = ends(8, thumb.shape[0]), ends(9, thumb.shape[1])
    sums = np.pad(thumb.astype(np.int64).cumsum(axis=0).cumsum(axis=1), ((1, 0), (1, 0)))
    cells = sums[np.ix_(bottom, right)] - sums[np.ix_(top, right)] - sums[np.ix_(bottom, left)] + sums[np.ix_(top, left)]
    cells = cells / ((bottom - top)[:, None] * (right - left))
    return np.packbits(cells[:, 1:] > cells[:, :-1]).tobytes().hex()


def _batches(rows: list[dict], schema: pa.Schema, size) -> Iterator[pa.RecordBatch]:
    held, total = [], 0
    for r in rows:
        held.append(r)
        total += size(r)
        if total >= BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def image(doc: int | None, text: bytes) -> dict:
        return {"doc_id": doc, "n_bytes": len(text), "media": to_media(text.ljust(max(ROW, -(-len(text) // ROW) * ROW), b"\0"))}

    for batch in batches:
        rows = (image(d, t) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        yield from _batches(rows, schema, lambda r: len(r["media"]))


def add_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each whole text as an image."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"").cast("binary")).alias("data"))
    return rows.mapInArrow(_store, "doc_id long, n_bytes long, media binary")


MEDIA_COLUMNS = "doc_id long, n_bytes long, width int, height int, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(n, {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[t]) for n, t in (c.split() for c in MEDIA_COLUMNS.split(", "))])
    for batch in batches:
        out = []
        for doc, n, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            payload, shown = [], []
            for image in images(media):
                thumb = dc_thumbnail(image)
                payload.append(thumb.tobytes()[: struct.unpack(">Q", image["comment"])[0]])
                shown.append((image["width"], image["height"], thumbnail_hash(thumb)))
            payload = b"".join(payload)
            out.append({
                "doc_id": doc, "n_bytes": n, "width": shown[0][0], "height": shown[0][1], "payload_bytes": len(payload),
                "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-ROW:]), "media_bytes": len(media),
                "media_sha256": hashlib.sha256(media).hexdigest(), "feature": "+".join(f"{w}x{h}:{x}" for w, h, x in shown),
            })
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def media_features(media: DataFrame) -> DataFrame:
    """Dimensions, digests and the thumbnail's hash, from the stored images."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_features, MEDIA_COLUMNS)
