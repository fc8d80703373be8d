"""URL filters by a cascade of Bloom filters.

A rule names a host and the start of a path; it fits the host and its subdomains.  The keys that a url could match are its host
and each parent domain, joined to its path's first n characters for each length n of a rule's path; those of all pages are the
key universe.  For each list (allow, block) a cascade is built over the complete universe: the first level encodes the listed
keys, the next the keys not listed that the first lets through, the next the listed ones that the second lets through, and so on
until nothing is left.  A key's membership is then exact for every key of the universe, and pages are judged in a map with the
cascades in the task: no join touches the pages.

A cascade takes about 1.44 * log2(universe / listed) bits for a listed key that occurs, and has to fit into a task: its size is
checked before it is built, and beyond ``most_bytes`` (some 20 million listed keys of the corpus) it is refused with an error.

Of several rules that fit the longest (host and path) wins, then the longer host.  Rules are unique by host and path; a rule on
both lists blocks.  A url without :// or a null one has an empty host and path, matches nothing and gets ``default``.  Repeated
rows are judged each, an empty table gives an empty result, and columns other than page_id and url aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrid.llm.shared import written

#: (action, host, path)
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """host (A-Z lower-cased) and path of a url; both empty without ://"""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def candidate_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """Keys a url could match, the longest first: array of (size, host, key)."""
    labels = F.split(host, r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))

    def cut(n: int) -> Column:
        key = lambda h: F.struct(-(F.length(h) + n), -F.length(h), F.concat(h, F.substring(path, 1, n)).alias("key"), F.length(h).alias("cut"))
        return F.when(F.length(path) >= n, F.transform(hosts, key))

    keys = F.flatten(F.filter(F.array(*map(cut, lengths)), lambda x: x.isNotNull())) if lengths else F.array()
    return F.when(host == "", F.slice(keys, 1, 0)).otherwise(F.array_sort(keys))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Level:
    """One Bloom filter; ``number`` sets its hashes apart from other levels'."""

    def __init__(self, keys: int, rate: float, number: int):
        self.hashes = max(1, round(-np.log2(rate)))
        self.bits = max(64, int(np.ceil(keys * self.hashes / np.log(2))))
        self.number, self.table = number, None

    def places(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        a, b = _mix(h1 + np.uint64(2 * self.number + 1)), _mix(h2 ^ np.uint64(0x5851F42D4C957F2D * (self.number + 1) % 2**64))
        return ((a[:, None] + b[:, None] * np.arange(1, self.hashes + 1, dtype=np.uint64)) >> np.uint64(11)) % np.uint64(self.bits)

    def holds(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        at = self.places(h1, h2)
        return ((self.table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)

    def fill(self, keys: DataFrame) -> None:
        """Partial tables of the partitions' keys in pieces of 64 KB, joined by or."""
        piece = 1 << 16

        def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            table = np.zeros(-(-self.bits // 8), np.uint8)
            for f in frames:
                at = self.places(f["h1"].to_numpy().astype(np.uint64), f["h2"].to_numpy().astype(np.uint64)).ravel()
                np.bitwise_or.at(table, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
            cuts = [(k, table[k : k + piece]) for k in range(0, len(table), piece)]
            yield pd.DataFrame([(k, x.tobytes()) for k, x in cuts if x.any()], columns=["at", "bits"])

        def merged(f: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"at": f["at"][:1], "bits": [np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in f["bits"]]).tobytes()]})

        self.table = np.zeros(-(-self.bits // 8), np.uint8)
        for r in keys.select("h1", "h2").mapInPandas(partial, "at long, bits binary").groupBy("at").applyInPandas(merged, "at long, bits binary").collect():
            self.table[r.at : r.at + len(r.bits)] = np.frombuffer(r.bits, np.uint8)


class Cascade:
    def __init__(self) -> None:
        self.levels: list[Level] = []

    def holds(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Exact for the keys it was built over."""
        out, live = np.zeros(len(h1), bool), np.ones(len(h1), bool)
        for k, level in enumerate(self.levels):
            passed = np.zeros(len(h1), bool)
            passed[live] = level.holds(h1[live], h2[live])
            out[live & ~passed] = k % 2 == 1
            live = passed
        out[live] = len(self.levels) % 2 == 1
        return out

    @property
    def size(self) -> int:
        return sum(len(x.table) for x in self.levels)


def _passes(level: Level) -> Column:
    @F.pandas_udf("boolean")
    def passes(h1: pd.Series, h2: pd.Series) -> pd.Series:
        return pd.Series(level.holds(h1.to_numpy().astype(np.uint64), h2.to_numpy().astype(np.uint64)))

    return passes("h1", "h2")


def build_cascade(universe: DataFrame, most_bytes: int) -> Cascade:
    """A cascade for ``listed`` among all keys (h1, h2, listed); an error if it would take more than ``most_bytes``."""
    cascade, inside, outside = Cascade(), universe.where("listed"), universe.where("NOT listed")
    n, m = inside.count(), outside.count()
    while n:
        rate = min(0.5, n / max(1.0, m) * 0.7) if not cascade.levels else 0.5
        level = Level(n, rate, len(cascade.levels))
        if cascade.size + level.bits // 8 > most_bytes:
            raise ValueError(f"a cascade for {n} listed keys takes more than most_bytes={most_bytes}: raise it, or filter by parts of the rules in turn")
        level.fill(inside)
        cascade.levels.append(level)
        inside, outside = outside.where(_passes(level)), inside
        n = inside.count()
    return cascade


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, default: str = "allow", most_bytes: int = 64 << 20) -> DataFrame:
    """Per page: page_id, host, path, rule (host and path of the rule that decides, else null), verdict."""
    spark = pages.sparkSession
    lengths = sorted({len(p) for _, _, p in rules})
    host, path = url_parts(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    keyed = parts.withColumn("keys", candidate_keys(F.col("host"), F.col("path"), lengths))
    hashes = (F.xxhash64("key", "cut"), F.xxhash64(F.lit(1), "cut", "key"))
    universe = keyed.select(F.explode("keys").alias("k")).select("k.key", "k.cut").distinct()
    listed = spark.createDataFrame([(h + p, len(h), a) for a, h, p in rules], "key string, cut int, action string")
    listed = listed.groupBy("key", "cut").agg(F.max("action").alias("action"))  # block comes after allow
    known = written(universe.join(listed, ["key", "cut"], "left").select(hashes[0].alias("h1"), hashes[1].alias("h2"), "action"), "url_keys")
    cascades = [build_cascade(known.select("h1", "h2", (F.coalesce(F.col("action"), F.lit("")) == a).alias("listed")), most_bytes) for a in ("allow", "block")]
    packed = keyed.withColumn("h1", F.transform("keys", lambda k: F.xxhash64(k["key"], k["cut"]))).withColumn("h2", F.transform("keys", lambda k: F.xxhash64(F.lit(1), k["cut"], k["key"])))

    @F.pandas_udf("at int, action string")
    def first_listed(h1: pd.Series, h2: pd.Series) -> pd.DataFrame:
        sizes = np.fromiter(map(len, h1), np.int64, len(h1))
        flat = [np.concatenate([np.asarray(x, np.int64) for x in h] or [np.empty(0, np.int64)]).astype(np.uint64) for h in (h1, h2)]
        allow, block = (c.holds(*flat) for c in cascades)
        at, row = np.arange(len(flat[0])) - np.repeat(np.cumsum(sizes) - sizes, sizes), np.repeat(np.arange(len(sizes)), sizes)
        hits = np.flatnonzero(allow | block)
        rows, first = np.unique(row[hits], return_index=True)
        place, action = np.full(len(sizes), -1, np.int32), np.full(len(sizes), None, object)
        place[rows], action[rows] = at[hits[first]], np.where(block[hits[first]], "block", "allow")
        return pd.DataFrame({"at": place, "action": action})

    found = packed.withColumn("hit", first_listed("h1", "h2"))
    rule = F.when(F.col("hit.at") >= 0, F.get("keys", F.col("hit.at"))["key"])
    return found.select("page_id", "host", "path", rule.alias("rule"), F.coalesce("hit.action", F.lit(default)).alias("verdict"))


URL_SQL = r"""
WITH rests AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), hosts AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM rests
), parts AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM hosts
), judged AS (
  SELECT page_id, host, path, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM parts
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM judged
"""
