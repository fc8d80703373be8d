"""N-gram Jaccard join, size-aware: fixed-size subsets for small sets, inverted lists for large ones.

Links are the pairs of documents whose sets of distinct word shingles have a Jaccard index of ``percent``/100 or more; the
result is each document's connected component.  Equal sets are one class from the start, and only classes are compared.

1. Every block of documents sends its distinct shingles to their buckets once and learns for each how many blocks hold it.
   All sets are then ordered alike: shingles held once first, the commonest last.  Two linked sets of sizes n and m share at
   least ceil(J*n) and ceil(J*m) shingles, so they share one among each one's first n - ceil(J*n) + 1, and c among the first
   n - ceil(J*n) + c.  A set whose start holds only shingles found nowhere else can have no partner and ends here.
2. Small sets (below a boundary) are keyed by each pair of common shingles in the start with c = 2; large sets, and small ones
   that a large one can be linked to by size, by each single shingle in the start with c = 1.  The boundary is where the
   subsets of the sets below it cost less than their inverted lists would, by sums over powers of two of the sizes.
3. Each key's first set and its set of the commonest shingles are compared with all others of the key; links found so far give
   components.  As long as one comparison in twenty finds a link, a set outside each key's largest component is then compared
   with the key's sets of other components, and components are found anew.  What is left is compared in full: for each key all
   sets outside its largest component against all others of other components.  So a large group of near copies costs a few
   comparisons a member, and no link between two components is lost.
   A pair goes on only where sizes, places and sketches leave room for a link.  Places: what two sets share stands, in the order
   of all sets, at the first shared key or after it.  Sketches: the Hamming distance of two parity sketches (256 and 1024 bits)
   is never more than the sets' difference.  Neither drops a link.

Words are runs of anything but space and \\t \\n \\v \\f \\r, with A-Z lower-cased; a text of fewer words than a shingle's is one
shingle; a null or wordless text has the empty set and is linked with nothing.  Shingles are compared by 64-bit hashes and
sets by 128-bit ones.  Rows that repeat a doc_id are documents of one class or several like any other, and equal rows give equal
rows; a null doc_id can be a member but not the name of a component.  An empty table gives an empty result, and columns other
than id and text aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrid.llm.blocks import BLOCK_BYTES, BlockTable, Keys, asked
from lexigrid.llm.components import connected_components
from lexigrid.llm.shared import written

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Making, shuffling and sorting a keyed row costs about as much as so many comparisons in a list.
ROW_COST = 20
SHORT, LONG = [f"b{k}" for k in range(4)], [f"c{k}" for k in range(16)]
SKETCH = (*SHORT, *LONG)
#: Copies of the table of components for its join with the documents, of which a third may be copies of one.
SALTS = 8
BOUNDARIES = (0, 8, 16, 32, 64, 128, 256, 512, 1024)


def shingles(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    tokens = text.translate(LOWER).split()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))
    if not len(h):
        return h
    n = max(1, len(h) - words + 1)
    out = h[:n].copy()
    for k in range(1, min(words, len(h))):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(out ^ (out >> np.uint64(29)))


def _sketch(hashes: np.ndarray) -> np.ndarray:
    """Parities of the numbers of hashes by their last 8 bits, then by their last 10."""
    bits = (np.bincount((hashes & np.uint64(1023)).astype(np.int64), minlength=1024) & 1).astype(np.uint8)
    return np.packbits(np.concatenate([np.bitwise_xor.reduce(bits.reshape(4, 256)), bits])).view(np.int64)


class Prefixes:
    """What a block asks about its shingles, and the starts of its sets once answered."""

    def __init__(self, words: int, jaccard: Fraction, buckets: int):
        self.words, self.jaccard, self.buckets = words, jaccard, buckets

    def sets(self, row: dict) -> tuple[list[np.ndarray], list[bytes], list[bool]]:
        """Of each document: shingles, the set's name; whether it is the block's first with that set."""
        at, out, names, new, seen = 0, [], [], [], set()
        for size in row["lens"]:
            s = shingles(row["data"][at : at + size], self.words)
            at += size
            name = xxhash.xxh3_128_digest(s.tobytes())
            out.append(s)
            names.append(name)
            new.append(len(s) > 0 and name not in seen)
            seen.add(name)
        return out, names, new

    def keys(self, sets: list[np.ndarray]) -> Keys:
        every = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        return Keys(((every >> np.uint64(32)) % np.uint64(self.buckets)).astype(np.int32), (every & np.uint64(0xFFFFFFFF)).astype(np.uint32))

    def __call__(self, row: dict, _: int) -> Keys | None:
        sets, _, new = self.sets(row)
        own = [s for s, n in zip(sets, new, strict=True) if n]
        return self.keys(own) if own else None

    def needed(self, n: int) -> int:
        return -(-self.jaccard.numerator * n // self.jaccard.denominator)


def _count(rows: pd.DataFrame) -> pd.DataFrame:
    """For each key sent: a level, 0 for one set only, else about twice the logarithm of the number of blocks that hold it."""
    sent = [np.frombuffer(x, "<u4") for x in rows["keys"]]
    many = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(k)) for x, k in zip(rows["many"], sent, strict=True)])
    _, place, count = np.unique(np.concatenate(sent), return_inverse=True, return_counts=True)
    again = np.zeros(len(count), bool)
    again[place[many > 0]] = True
    level = np.where((count == 1) & ~again, 0, 1 + np.rint(2 * np.log2(np.maximum(count, 2)))).astype(np.uint8)
    cuts = np.cumsum([len(k) for k in sent])[:-1]
    return pd.DataFrame({"block": rows["block"], "bucket": rows["bucket"], "levels": [x.tobytes() for x in np.split(level[place], cuts)]})


STARTS = f"doc_id long, sid binary, n int, alone int, one array<long>, two array<long>, lists long, {', '.join(f'{b} long' for b in SKETCH)}, hashes array<long>"


def _starts(state: Prefixes, skip_below: int):
    schema = pa.schema([("doc_id", pa.int64()), ("sid", pa.binary()), ("n", pa.int32()), ("alone", pa.int32()), ("one", pa.list_(pa.int64())), ("two", pa.list_(pa.int64())), ("lists", pa.int64()), *[(b, pa.int64()) for b in SKETCH], ("hashes", pa.list_(pa.int64()))])

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {k: v[0] for k, v in batch.slice(i, 1).to_pydict().items()}
                sets, names, new = state.sets(row)
                own = [s for s, n in zip(sets, new, strict=True) if n]
                keys = state.keys(own)
                got, level = {a["bucket"]: a["levels"] for a in row["levels"] or []}, np.zeros(len(keys.key), np.uint8)
                for s, e in keys.cuts:
                    level[s:e] = np.frombuffer(got[int(keys.bucket[s])], np.uint8)
                level, at, out = level[keys.place], 0, []
                for doc, s, name, first in zip(row["ids"], sets, names, new, strict=True):
                    n = len(s)
                    r = {"doc_id": doc, "sid": name, "n": n, "lists": 0}
                    if first:
                        own_level = level[at : at + n]
                        at += n
                        if n >= skip_below:
                            p = n - state.needed(n) + 1
                            order = np.lexsort((s, own_level))[: p + 1]
                            common = own_level[order] > 0
                            one, two = s[order[:p][common[:p]]], s[order[common]]
                            if len(one):
                                b = _sketch(s)
                                lists = int((2.0 ** (own_level[order[:p]][common[:p]] / 2)).sum())
                                r |= {"alone": int((own_level == 0).sum()), "one": one.view(np.int64), "two": two.view(np.int64), "lists": lists, "hashes": s.view(np.int64)} | dict(zip(SKETCH, b.tolist(), strict=True))
                    out.append(r)
                for s in range(0, len(out), 500):
                    yield pa.RecordBatch.from_pylist(out[s : s + 500], schema=schema)

    return starts


def _boundary(starts: DataFrame) -> int:
    """Sets below it are keyed by pairs: the boundary of the least cost.  A row for each power of two reaches the driver."""
    pairs = F.size("two") * (F.size("two") - 1) / 2
    keying = lambda rows: F.sum(rows * ROW_COST)
    cost = starts.groupBy(F.ceil(F.log2("n")).alias("power")).agg(keying(pairs).alias("subsets"), (keying(F.size("one")) + F.sum("lists")).alias("lists")).collect()
    return min(BOUNDARIES, key=lambda x: sum(r.subsets if 2**r.power <= x else r.lists for r in cost))


def _keyed(starts: DataFrame, boundary: int, jaccard: float, *about: str) -> DataFrame:
    """(key, room, the columns asked for): a row for each subset of a small set and each list of a large one.  ``room``: the
    set's shingles from the key's first on, in the order of all sets, where those that no other set has come first."""
    own = (*dict.fromkeys((*about, "n", "alone")),)
    pairs = F.flatten(F.transform("two", lambda x, i: F.transform(F.slice("two", i + 2, F.size("two")), lambda y: F.struct(i.alias("i"), F.xxhash64(F.lit(2), x, y).alias("key")))))
    small = starts.where(F.col("n") < boundary).select(F.explode(pairs).alias("p"), *own).select("p.i", "p.key", *own)
    large = starts.where(F.col("n") >= jaccard * boundary).select(F.posexplode("one").alias("i", "key"), *own)
    return small.unionByName(large).select("key", (F.col("n") - F.col("alone") - F.col("i")).alias("room"), *about)


def _fits(x: str, y: str, jaccard: float) -> Column:
    """Whether sizes and places at a key leave room for a link."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    sizes = (n >= m * jaccard - 1e-6) & (m >= n * jaccard - 1e-6)
    return sizes & (F.least(f"{x}.room", f"{y}.room") >= (n + m) * (jaccard / (1 + jaccard)) - 1e-6)


def _sketches_fit(x: str, y: str, jaccard: float) -> Column:
    """Whether the sketches of two tables' sets leave room for a link."""
    most = (F.col(f"{x}.n") + F.col(f"{y}.n")) * ((1 - jaccard) / (1 + jaccard)) + 1e-6
    short, long = (sum(F.bit_count(F.col(f"{x}.{b}").bitwiseXOR(F.col(f"{y}.{b}"))) for b in bits) for bits in (SHORT, LONG))
    return (short <= most) & (long <= most)


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b) of sets' ids those that are linked: by sketches first, then by the sets."""
    jaccard = percent / 100
    left, right = (sets.select(F.col("id").alias(c), "n", *SKETCH).alias(c) for c in "ab")
    near = pairs.join(left, "a").join(right, "b").where(_sketches_fit("a", "b", jaccard))
    near = written(near.select("a", "b", F.col("a.n").alias("n"), F.col("b.n").alias("m")), "ngram_near")
    both = near.join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("hashes").alias("y")), "b")
    both = both.withColumn("common", F.size(F.array_intersect("x", "y")))
    return written(both.where(100 * F.col("common") >= percent * (F.col("n") + F.col("m") - F.col("common"))).select("a", "b"), "ngram_links")


PAIR = (F.least, F.greatest)


def _stars(keyed: DataFrame, centres: DataFrame, jaccard: float) -> DataFrame:
    """Pairs (a, b) of each key's centres with its other sets, as far as a link is possible; keyed: key, id, n, room."""
    stars = keyed.join(centres, "key").select(F.struct("id", "n", "room").alias("x"), F.explode("centres").alias("y"))
    near = stars.where((F.col("x.id") != F.col("y.id")) & _fits("x", "y", jaccard))
    return near.select(*(f("x.id", "y.id").alias(c) for f, c in zip(PAIR, "ab", strict=True))).distinct()


def _several(rows: DataFrame) -> DataFrame:
    """The keys with sets of several parts."""
    return rows.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("key")


def _outside(rows: DataFrame) -> DataFrame:
    """The rows outside their key's largest part."""
    sizes = rows.groupBy("key", "part").agg(F.count("*").alias("size"))
    return rows.join(sizes.groupBy("key").agg(F.max(F.struct("size", "part"))["part"].alias("major")), "key").where("part <> major").drop("major")


def similar_sets(starts: DataFrame, percent: int) -> DataFrame:
    """(id, component) of the sets that have links."""
    jaccard, boundary, of_set = percent / 100, _boundary(starts), F.struct("id", "n", "room")
    starts = starts.withColumn("lists", F.col("lists").cast("int"))
    # each key's set of the commonest shingles and its first by number against all others of the key: in a group of near copies
    # that is what they are copies of, for nearly all keys the same
    keyed = _keyed(starts, boundary, jaccard, "id", "n", "lists")
    ends = keyed.groupBy("key").agg(F.min(of_set).alias("low"), F.max(F.struct("lists", "id", "n", "room")).alias("top"), F.max("id").alias("last")).where("low.id < last")
    centres = ends.select("key", F.array("low", F.struct("top.id", "top.n", "top.room")).alias("centres"))
    tried = written(_stars(keyed, centres, jaccard), "ngram_pairs")
    links = _linked(tried, starts, percent)
    label = connected_components(links)
    parts = starts.join(label, "id", "left").withColumn("part", F.coalesce("component", "id"))
    named = _keyed(parts, boundary, jaccard, "id", "n", "lists", "part")
    mixed = written(named.join(_several(named), "key"), "ngram_mixed")
    while True:  # stars again among what is in several parts, from a set outside the largest
        top = _outside(mixed).groupBy("key").agg(F.max(F.struct("lists", "id", "n", "room")).alias("top"))
        centres = top.select("key", F.array(F.struct("top.id", "top.n", "top.room")).alias("centres"))
        more = written(_stars(mixed, centres, jaccard).join(tried, ["a", "b"], "left_anti"), "ngram_pairs")
        found = _linked(more, starts, percent)
        compared, new = more.count(), found.count()
        tried, links = tried.union(more), links.union(found)
        if new:
            label = connected_components(links)
            again = mixed.drop("part").join(label, "id", "left").withColumn("part", F.coalesce("component", "id")).drop("component")
            mixed = written(again.join(_several(again), "key"), "ngram_mixed")
        if 20 * new <= compared:
            break
    # what no link joins yet: the sets outside each key's largest component against those of all its other components
    full = written(mixed.join(starts.select("id", *SKETCH), "id"), "ngram_rest")
    x, y = _outside(full).alias("x"), full.alias("y")
    rest = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.part") != F.col("y.part")) & _fits("x", "y", jaccard) & _sketches_fit("x", "y", jaccard))
    rest = rest.select(*(f("x.id", "y.id").alias(c) for f, c in zip(PAIR, "ab", strict=True))).distinct().join(tried, ["a", "b"], "left_anti")
    return connected_components(links.union(_linked(rest, starts, percent)))


def ngram_groups(docs: DataFrame, words: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links)."""
    jaccard = Fraction(percent, 100)
    blocks = BlockTable(docs, F.col(text_col), id_col, block_bytes, "ngram_blocks")
    state = Prefixes(words, jaccard, blocks.buckets)
    sent = blocks.table.mapInArrow(asked(state, 0), "bucket int, block long, keys binary, many binary")
    counted = sent.groupBy("bucket").applyInPandas(_count, "block long, bucket int, levels binary")
    by_block = counted.groupBy("block").agg(F.collect_list(F.struct("bucket", "levels")).alias("levels"))
    # below this size a set is linked with equal ones only
    skip = next(n for n in range(1, 1 << 20) if Fraction(n, n + 1) >= jaccard) if jaccard < 1 else 1 << 30
    every = written(blocks.table.join(by_block.hint("shuffle_hash"), "block", "left").mapInArrow(_starts(state, skip), STARTS), "ngram_starts")
    # numbered in the written table, so the numbers stay
    starts = written(every.where("hashes IS NOT NULL").dropDuplicates(["sid"]).withColumn("id", F.monotonically_increasing_id()), "ngram_sets")
    label = similar_sets(starts, percent)
    # documents of one set: its smallest id; then the smallest of all sets of a component
    firsts = every.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows"))
    placed = firsts.join(starts.select("sid", "id"), "sid", "left").join(label, "id", "left")
    placed = written(placed.where("rows > 1 OR component IS NOT NULL").select("sid", "first", "component"), "ngram_firsts")
    whole = placed.where("component IS NOT NULL").groupBy("component").agg(F.min("first").alias("least"))
    names = placed.join(whole, "component", "left").select("sid", F.coalesce("least", "first").alias("component_id"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = every.withColumn("salt", F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(SALTS)).cast("int"))
    return rows.join(names, ["sid", "salt"], "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_first(docs: DataFrame, words: int = 4, percent: int = 85) -> DataFrame:
    """``docs`` with one document of each group, that of the smallest doc_id; all columns stay, whatever their names.

    Of rows that repeat a doc_id one stays.  Documents without words are linked with nothing and stay.  Rows with a null doc_id
    stay unless they are linked with a document that has one.
    """
    groups = written(ngram_groups(docs, words, percent), "ngram_groups")
    kept = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("rows"))
    kept = written(kept, "ngram_kept")
    rows = docs.select(F.col("doc_id").alias("key"), F.struct("*").alias("row"))
    same = F.col("key").eqNullSafe(F.col("id"))
    once = rows.join(kept.where("rows = 1 OR id IS NULL"), same, "left_semi")
    return once.union(rows.join(kept.where("rows > 1 AND id IS NOT NULL"), same, "left_semi").dropDuplicates(["key"])).select("row.*")
