"""URL filters by Bloom filter cascades: exact membership in a key list, without a join.

A rule is a host (with all its subdomains) and a path prefix. The keys of a URL are every suffix of its host at
a dot joined with every prefix of its path that has the length of some rule's path; the universe is all keys of
the corpus. Level 1 of a cascade encodes the listed keys, level 2 the keys of the universe that level 1 wrongly
holds, level 3 the listed keys that level 2 wrongly holds, and so on until a level holds nothing wrongly. A key of
the universe is listed exactly if the first level without it is an even one. Level 1 has so many bits a key that it
wrongly holds about as many keys of the universe as are listed, so further levels are no larger than the list. A list
whose level would be larger than MAX_BYTES is split by hash into shards, each with a cascade of its own over its share
of the universe; the shards are applied one after the other, so that tasks hold one cascade at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, log, log2

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read, renamed, restored

#: (host, path, verdict), fixed by the query's contract.
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
DEFAULT = "allow"  # what no rule fits
BITS, MAX_BYTES = 12, 256 << 20  # least bits of a key; the size from which a list is split into shards
UPPER, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass
class Level:
    """A Bloom filter over 64-bit key hashes."""

    words: np.ndarray
    seed: int
    hashes: int

    def holds(self, keys: np.ndarray) -> np.ndarray:
        at = positions(keys, self.seed, len(self.words) * 64, self.hashes)
        return ((self.words[at >> 6] >> (at & 63).astype("u8")) & np.uint64(1)).all(1)


def positions(keys: np.ndarray, seed: int, bits: int, hashes: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (keys.astype("u8") ^ np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
        a = x ^ (x >> np.uint64(29))
        b = (a * np.uint64(0xBF58476D1CE4E5B9)) | np.uint64(1)
        return ((a[:, None] + np.arange(hashes, dtype="u8") * (b ^ (b >> np.uint64(32)))[:, None]) % np.uint64(bits)).astype("i8")


def key_hash(key: Column) -> Column:
    return F.xxhash64(key)


def host_of(url: Column) -> Column:
    after = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(after, UPPER, LOW), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def keys_of(host: Column, path: Column, lengths: Column) -> Column:
    """Every host suffix with every path prefix of one of the lengths, longest first, of equals the longer host."""
    labels = F.split(host, r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    prefix = F.transform(F.filter(lengths, lambda n: n <= F.length(path)), lambda n: F.substring(path, F.lit(1), n))
    pairs = F.flatten(F.transform(suffix, lambda h: F.transform(prefix, lambda p: F.concat(h, p))))
    return F.sort_array(F.transform(F.array_distinct(pairs), lambda k: F.struct(F.length(k).alias("n"), F.instr(k, "/").alias("h"), k.alias("key"))), asc=False)["key"]


def bits_a_key(n: int, others: int) -> int:
    """Bits of each of n keys for a filter that wrongly holds at most about n of so many others."""
    return max(BITS, ceil(log2(max(1.0, others / n)) / log(2))) if n else BITS


def bloom(keys: DataFrame, seed: int, bits: int = BITS) -> Level | None:
    """The filter of a frame with the column h, set bit by bit on the executors; None if it has no key."""
    n = keys.count()
    if not n:
        return None
    size, hashes = max(1, -(-n * bits // 64)), round(bits * log(2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(positions(b.column(0).to_numpy(), seed, size * 64, hashes))
            word, first = np.unique(at >> 6, return_index=True)
            bits = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype("u8"), first) if at.size else np.empty(0, "u8")
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bits.view("i8"))], names=["word", "bits"])

    got = keys.select("h").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()  # at most size rows
    words = np.zeros(size, "u8")
    words[got.column("word").to_numpy()] = got.column("bits").to_numpy().view("u8")
    return Level(words, seed, hashes)


def held(keys: DataFrame, level: Level) -> DataFrame:
    shared = keys.sparkSession.sparkContext.broadcast(level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(shared.value.holds(b.column(0).to_numpy())))

    return keys.select("h").mapInArrow(run, "h long")


def cascade(listed: DataFrame, universe: DataFrame, others: int = 0) -> list[Level]:
    """Levels that tell the listed keys (column h) from all others of the universe (column h; about so many). Only keys
    that a level holds wrongly move on, so the universe is read once and never joined."""
    inside = cut(listed.select("h").distinct())
    first = bloom(inside, 1, bits_a_key(inside.count(), others))
    if first is None:
        return []
    levels = [first]
    outside = cut(held(universe, first).distinct().join(inside, "h", "left_anti"))
    while True:
        wrong = outside if len(levels) % 2 else inside
        level = bloom(wrong, 2 * len(levels) + 1)
        if level is None:
            return levels
        levels.append(level)
        if len(levels) % 2:
            outside = cut(held(outside, level))
        else:
            inside = cut(held(inside, level))


def member(levels: list[Level], keys: np.ndarray) -> np.ndarray:
    """Whether keys of the universe are listed."""
    listed, open_ = np.zeros(len(keys), bool), np.arange(len(keys))
    for k, level in enumerate(levels):
        got = level.holds(keys[open_])
        listed[open_[~got]] = k % 2 == 1
        open_ = open_[got]
    listed[open_] = len(levels) % 2 == 1
    return listed


def shards_of(n: int, others: int, most: int = MAX_BYTES) -> int:
    """Into how many shards a list of n keys is split, so that no level is larger than so many bytes."""
    return max(1, -(-n * bits_a_key(n, others) // (8 * most)))


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Adds host, path, rule and verdict to pages (of them, url is read).

    rules: host, path (from its first slash), verdict; a rule fits its host and all subdomains if the path starts
    with the rule's. The longest fitting rule wins, of equals the one with the longer host; where none fits, rule
    is null and the verdict the default. A url that is null or has no :// has neither host nor path and fits no
    rule. Other columns of pages stay, but for clashing names; repeated rows stay."""
    names = ["host", "path", "rule", "verdict"]
    frame, own = renamed(pages, names)
    columns = list(own.values())
    lengths = [r[0] for r in rules.select(F.length("path")).distinct().collect()]  # as many as rules' paths have lengths
    split = frame.select("*", host_of(F.col(own["url"])).alias("host"), path_of(F.col(own["url"])).alias("path"))
    keyed = split.withColumn("keys", keys_of(F.col("host"), F.col("path"), F.array(*map(F.lit, lengths)).cast("array<int>")))
    keyed = keyed.withColumn("hashes", F.transform("keys", key_hash))
    others = keyed.agg(F.sum(F.size("hashes"))).first()[0] or 0  # keys of the corpus, repeated ones counted
    ruled = rules.select("verdict", key_hash(F.concat("host", "path")).alias("h"))
    sizes = {r["verdict"]: r["count"] for r in ruled.groupBy("verdict").count().sort("verdict").collect()}  # two verdicts
    shards = shards_of(max(sizes.values(), default=0), others, max_bytes)
    frame = keyed.select(*columns, "host", "path", "keys", "hashes", F.lit(None).cast("int").alias("place"), F.lit(default).alias("verdict"))
    for k in range(shards):
        own_part = F.pmod("h", F.lit(shards)) == k
        universe = keyed.select(F.explode("hashes").alias("h")).filter(own_part)
        of = {v: cascade(ruled.filter((F.col("verdict") == v) & own_part), universe, others // shards) for v in sizes}
        frame = judged(frame, of, k, shards)
        frame = cut(frame) if k + 1 < shards else frame
    rule = F.get("keys", F.col("place"))
    return frame.select(*restored(own), "host", "path", rule.alias("rule"), "verdict")


def judged(frame: DataFrame, of: dict[str, list[Level]], shard: int, shards: int) -> DataFrame:
    """place (in keys, from 0) and verdict of the first listed key of each row, where that comes before the one that
    is there already. Only keys of the shard are looked up, the only ones that its cascades answer for."""
    shared = frame.sparkSession.sparkContext.broadcast(of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("hashes")
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype("i8")
            n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype("i8")
            row, within = np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
            mine = np.flatnonzero(np.mod(flat, shards) == shard)
            first = pc.fill_null(b.column("place"), np.iinfo("i4").max).to_numpy(zero_copy_only=False).astype("i8")
            verdict = b.column("verdict").to_numpy(zero_copy_only=False).astype(object)
            for v, levels in shared.value.items():
                hit = mine[member(levels, flat[mine])]
                before = first.copy()
                np.minimum.at(first, row[hit], within[hit])
                verdict[first < before] = v
            place = pa.array(first.astype("i4"), mask=first == np.iinfo("i4").max)
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], place, pa.array(verdict, pa.string())], names=b.schema.names)

    return frame.mapInArrow(run, frame.schema)


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge(read(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


QUERIES = {"op7_url_filters": op7_url_filters}
SQL = {
    "op7_url_filters": r"""
WITH rules(rule_host, rule_path, rule_verdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
parts AS (SELECT page_id, url, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
 coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
fits AS (SELECT row_number() OVER () AS r, * FROM parts),
best AS (SELECT r, arg_max(rule_host || rule_path, length(rule_host || rule_path) * 1000 + length(rule_host)) AS rule, arg_max(rule_verdict, length(rule_host || rule_path) * 1000 + length(rule_host)) AS verdict
 FROM fits JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY r)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits LEFT JOIN best USING (r)
"""
}
