"""Token ids of whole texts, by a public tokenizer's file.

Tokenizers of the kinds used here split a text before they merge, and never merge across certain places: so a text's ids are
those of its pieces in a row, and most pieces come again and again.  ``Encoder`` cuts only where it is sure: before a space
or around a line feed that stands between two characters other than white space, and between a Latin letter and a mark other
than the apostrophe.  It finds the distinct pieces of a run of texts by 64-bit hashes of their bytes, in numpy, keeps the ids
of those it has met (up to a bound, then it starts anew) and hands only new ones to the tokenizer.

``drops_space``: white space separates and yields no ids, and case is ignored (word_bpe_49k); pieces are then looked up
without the space before them and with Latin letters in lower case.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MARKS = b".,;:!?%&$*#()"  # not those of special tokens
MOST_PIECES = 2_000_000
SLICE_BYTES = 1_000_000
STEP = 0x9E3779B97F4A7C15

SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
MARK = np.zeros(256, bool)
MARK[list(MARKS)] = True
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
#: First bytes of characters that are not white space: ASCII ones, and those beyond unless such a byte begins white space too.
WORD_START = ~SPACES
WORD_START[[0xC2, 0xE1, 0xE2, 0xE3]] = False
#: Second bytes of the two-byte letters from U+00C0 to U+00FF, and what makes the upper-case ones lower-case.
LATIN = np.zeros(256, bool)
LATIN[[x for x in range(0x80, 0xC0) if x not in (0x97, 0xB7)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LATIN_LOWER = np.arange(256, dtype=np.uint8)
LATIN_LOWER[[x for x in range(0x80, 0x9F) if x != 0x97]] += 32


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file; a path is taken as it is."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    up, down = np.empty(n + 1, np.uint64), np.empty(n + 1, np.uint64)
    for out, base in ((up, STEP), (down, pow(STEP, -1, 2**64))):
        out[0] = 1
        np.multiply.accumulate(np.full(n, base, np.uint64), out=out[1:])
    return up, down, np.random.default_rng(8).integers(0, 2**64, 256, dtype=np.uint64)


class Encoder:
    def __init__(self, name: str, drops_space: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task a core
        from tokenizers import Tokenizer

        self.tokenizer, self.drops_space = Tokenizer.from_file(vocabulary(name)), drops_space
        self._clear()

    def _clear(self) -> None:
        self.known, self.place, self.pieces = np.empty(0, np.uint64), np.empty(0, np.int64), 0
        self.flat, self.bounds = np.empty(1 << 16, np.uint32), np.zeros(1 << 16, np.int64)

    def _cuts(self, data: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
        """Sorted starts of pieces; every text of one byte or more starts one."""
        n = len(data)
        letter = LETTER[data]
        letter[1:] |= LATIN[data[1:]] & (data[:-1] == 0xC3)
        ends_word = letter | ((data < 128) & ~SPACES[data])  # surely not white space
        starts_word = WORD_START[data]
        cut, first = np.zeros(n, bool), np.zeros(n + 1, bool)
        first[text_starts] = True
        if n > 2:
            alone = ends_word[:-2] & starts_word[2:] & ~first[1 : n - 1] & ~first[2:n]  # of the byte between
            between = data[1:-1]
            cut[1:-1] = alone & ((between == 32) | (between == 10))
            cut[np.flatnonzero(alone & (between == 10)) + 2] = True
        cut[1:] |= letter[:-1] & MARK[data[1:]]
        return np.flatnonzero(cut | first[:n])

    def _store(self, hashes: np.ndarray, texts: list[bytes]) -> None:
        got = []
        for s in range(0, len(texts), 4096):  # the tokenizer's own results are large
            got += [e.ids for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts[s : s + 4096]], add_special_tokens=False)]
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        total, used, n = int(sizes.sum()), int(self.bounds[self.pieces]), self.pieces
        while used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while n + len(got) + 1 > len(self.bounds):
            self.bounds = np.concatenate([self.bounds, np.zeros_like(self.bounds)])
        self.flat[used : used + total] = np.fromiter((i for x in got for i in x), np.uint32, total)
        self.bounds[n + 1 : n + len(got) + 1] = used + np.cumsum(sizes)
        at = np.searchsorted(self.known, hashes)
        self.known, self.place = np.insert(self.known, at, hashes), np.insert(self.place, at, np.arange(n, n + len(got)))
        self.pieces += len(got)

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids (uint32) of each text in UTF-8, as the tokenizer gives them for it without adding special tokens."""
        if self.pieces > MOST_PIECES:
            self._clear()
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(lens)
        if not ends[-1]:
            return [np.empty(0, np.uint32) for _ in texts]
        data = np.frombuffer(b"".join(texts), np.uint8)
        starts = self._cuts(data, (ends - lens)[lens > 0])
        stops = np.append(starts[1:], len(data))
        raw = data
        if self.drops_space:
            data = LOWER[data]
            two = np.flatnonzero(data[:-1] == 0xC3) + 1
            data[two] = LATIN_LOWER[data[two]]
            starts = starts + ((stops - starts > 1) & ((data[starts] == 32) | (data[starts] == 10)))
        up, down, table = _powers(1 << max(16, len(data).bit_length()))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(table[data] * up[: len(data)], out=sums[1:])
        h = (sums[stops] - sums[starts]) * down[starts]
        h = (h ^ (h >> np.uint64(30)) ^ (stops - starts).astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        kinds, first, which = np.unique(h, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.known, kinds), max(0, len(self.known) - 1))
        new = self.known[at] != kinds if len(self.known) else np.ones(len(kinds), bool)
        if new.any():
            where, source = first[new], data if self.drops_space else raw
            whole = source.tobytes()
            self._store(kinds[new], [whole[s:e] for s, e in zip(starts[where].tolist(), stops[where].tolist(), strict=True)])
            at = np.searchsorted(self.known, kinds)
        mine = self.place[at][which]
        sizes = self.bounds[mine + 1] - self.bounds[mine]
        total = np.cumsum(sizes)
        flat = self.flat[np.repeat(self.bounds[mine] - total + sizes, sizes) + np.arange(total[-1])]
        # pieces end where texts end
        per_text = np.diff(np.append(0, np.append(0, total)[np.searchsorted(stops, ends, side="right")]))
        cuts = np.cumsum(per_text)
        return [flat[e - n : e] for n, e in zip(per_text.tolist(), cuts.tolist(), strict=True)]


@lru_cache(2)
def encoder(name: str, drops_space: bool) -> Encoder:
    """One for each worker process; what it has met stays for the worker's next tasks."""
    return Encoder(name, drops_space)


def encoded(name: str, drops_space: bool, batch: pa.RecordBatch) -> Iterator[tuple[object, np.ndarray]]:
    """(first column, ids of the second) for each row of a batch, about a MB of text at a time."""
    enc, start = encoder(name, drops_space), 0
    sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0)))
    while start < batch.num_rows:
        before = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, before + SLICE_BYTES, side="right")))
        part = batch.slice(start, end - start)
        yield from zip(part.column(0).to_pylist(), enc.encode(part.column(1).to_pylist()), strict=True)
        start = end
