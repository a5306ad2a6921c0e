"""Exact Jaccard join of documents on word shingles, by PartEnum signatures.

Two sets of s <= t shingles with Jaccard similarity of at least 0.8 differ in at most (s + t) / 9 elements. Set sizes
are cut into bands; a set emits signatures for every band in which the larger set of a pair may lie. For a band whose
pairs differ in at most k elements the domain of shingles is partitioned by hash into ``SHARE * k`` parts and each of
these into three. Differences are too few to hit two thirds of a part everywhere, so of all (part, subset of two of its
three thirds) enumerated, some hold the same elements of both sets: that content, hashed, is a signature the two share.
``guarantee`` says how many at least.

A subset that both sets leave empty tells nothing. Sets that leave too many empty emit signatures of a second,
independent partition as well, and so on (``FAMILIES`` of them, and in the end the empty subsets as signatures). Two
sets that agree on empty subsets only both see that they do, so no pair is lost.

Equal sets are one class from the start. A signature met by one class only goes, then classes that hold fewer shared
signatures than any partner would guarantee. Each bucket (the classes of a signature) proposes its members against two of
them; these pairs are verified on the exact sets and linked. Buckets within one component are done, so a large group of
near copies never expands into its pairs. Members of buckets that still span components are compared by their elements,
rarest first: of two similar sets the first element in common stands early in both, how early depends on their sizes,
and rows meet by element and pair of size cells. Whatever meets is verified on the exact sets.

Hot buckets: a task passes on only ``FEW`` classes of a signature by its key, others by a salted one; all else about
buckets is aggregated (smallest and largest class, two members) and joined back, which Spark combines before the shuffle
and splits where it is skewed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read, renamed, restored, small, written

SHINGLE, PERCENT, FAMILIES = 5, 80, 6
BAND = 1.6  # ratio of the ends of a size band
SHARE = 0.6  # parts of the first level, as a share of the differences; from 0.5 on a pair shares a signature
FEW, SALTS = 16, 255  # classes of a signature that a task passes on by its key; salts for the others
CELL = 1.05  # ratio of the ends of a size cell
BROADCAST_ROWS = 500_000  # of ids, 8 bytes each

U = np.uint64
with np.errstate(over="ignore"):
    ODD = U(0x9E3779B97F4A7C15)
    #: ODD ** i modulo 2**64 for the bytes of a word; longer words are hashed in Python.
    POWERS = np.cumprod(np.full(256, ODD, U), dtype=U)
BYTES = np.frombuffer(np.random.default_rng(7).bytes(256 * 8), U)
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words of a text in order, A-Z lower-cased."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(LOWER), np.uint8)
    if not raw.size:
        return np.empty(0, U)
    gap = SPACE[raw]
    edge = np.flatnonzero(np.diff(gap, prepend=True, append=True))
    start, end = edge[::2], edge[1::2]
    if not start.size:
        return np.empty(0, U)
    length = end - start
    within = np.arange(raw.size) - np.repeat(start, np.diff(np.append(start, raw.size)))[: raw.size] if start[0] == 0 else None
    if within is None:
        within = np.zeros(raw.size, "i8")
        within[start[0] :] = np.arange(start[0], raw.size) - np.repeat(start, np.diff(np.append(start, raw.size)))
    with np.errstate(over="ignore"):
        value = BYTES[raw] * POWERS[np.minimum(within, 255)]
        value[gap] = 0
        h = mix(np.add.reduceat(value, start) + length.astype(U))
    for k in np.flatnonzero(length > 256):
        h[k] = U(long_word(raw[start[k] : end[k]].tobytes()))
    return h


def long_word(word: bytes) -> int:
    import hashlib

    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text. Fewer words than a shingle make one; no words, none."""
    w = word_hashes(text or "")
    if not w.size:
        return w
    k = min(size, w.size)
    with np.errstate(over="ignore"):
        h = np.full(w.size - k + 1, U(k))
        for i in range(k):
            h = mix(h + w[i : i + h.size] * ODD)
    return np.unique(h)


def set_hash(s: np.ndarray) -> int:
    """One 63-bit value per set: two different sets share it with a probability of 2**-63."""
    with np.errstate(over="ignore"):
        return int(mix(mix(s + U(1)).sum(dtype=U) + U(s.size))) >> 1


def bands(n: int) -> list[tuple[int, int]]:
    """(first, last) size of the bands in which the larger set of a pair with a set of size n may lie."""
    out, first = [], 4
    while first * PERCENT <= n * 100:
        last = int(first * BAND)
        if n <= last:
            out.append((first, last))
        first = last + 1
    return out


def differences(s: int, t: int) -> int:
    """The most elements in which similar sets of s and t elements differ."""
    return (s + t) * (100 - PERCENT) // (100 + PERCENT)


def guarantee(parts: int, k: int) -> int:
    """Of the three subsets of each part, how many k differences leave alone at least: the first in a part spoils two,
    one in another third of it the last."""
    once = min(k, parts)
    return 3 * parts - 2 * once - min(k - once, parts)


def enumerated(h: np.ndarray, value: np.ndarray, parts: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The signatures of the non-empty subsets of sorted hashes h, and marks of the empty subsets."""
    third = ((h >> U(32)) * U(3 * parts)) >> U(32)
    at = np.flatnonzero(np.diff(third, prepend=U(3 * parts)))
    held, filled = np.zeros(3 * parts, U), np.zeros(3 * parts, bool)
    with np.errstate(over="ignore"):
        held[third[at]] = np.add.reduceat(value, at)
        filled[third[at]] = True
        held, filled = held.reshape(-1, 3), filled.reshape(-1, 3)
        without = held.sum(1, dtype=U, keepdims=True) - held  # each subset leaves one third out
        some = filled.sum(1, keepdims=True) > filled
        name = mix(np.arange(3 * parts, dtype=U) + U(seed) * ODD).reshape(-1, 3)
        return mix(without + name)[some], mix(name[~some] + U(1))


def signatures(s: np.ndarray) -> list[tuple[np.ndarray, int, int]]:
    """For each band of a set: its signatures, the band, and how many of them it at least shares with a partner there
    (the slack; 0 if that can't be said)."""
    out, n, value = [], s.size, mix(s + U(1))
    for first, last in bands(n):
        parts = int(SHARE * differences(last, last)) + 1
        sure = guarantee(parts, differences(n, min(n * 100 // PERCENT, last)))
        rows, slack, h, v = [], 0, s, value
        for family in range(FAMILIES):
            seed = first * FAMILIES + family
            if family:
                with np.errstate(over="ignore"):
                    h = mix(s + U(seed) * ODD)
                order = np.argsort(h)
                h, v = h[order], value[order]
            sig, empty = enumerated(h, v, parts, seed)
            rows.append(sig)
            slack = sure - empty.size
            if slack > 0:
                break
        else:
            rows.append(empty)
        out.append((np.concatenate(rows), first, slack if len(rows) == 1 else 0))
    return out


def signed(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """Rows of two kinds from one pass over docs. salt < 0, one for each row of docs: sig is its doc_id, fp the hash of its
    set (null for an empty one), meta the size of its set. salt >= 0, the signatures of each set: sig, fp and meta (band
    and slack). Of a set that a task meets again, and of sets of less than four elements, which are similar to equal ones
    only, signatures are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple[np.ndarray, int, int]] = []
        count = 0
        for b in batches:
            n, fps = [], []
            for t in b.column(1):
                s = shingle_set(t.as_py(), size)
                n.append(s.size)
                fps.append(fp := set_hash(s) if s.size else None)
                if s.size < 4 or fp in seen:
                    continue
                seen.add(fp)
                for sig, first, slack in signatures(s):
                    held.append((sig, fp, first << 32 | slack))
                    count += sig.size
                if count > 1_000_000:
                    yield rows(held)
                    held, count = [], 0
            spread = -1 - np.random.default_rng(len(seen)).integers(0, 1 << 14, len(n))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64()), pa.array(n, pa.int64()), pa.array(spread, pa.int32())], names=NAMES)
        if held:
            yield rows(held)

    def rows(held) -> pa.RecordBatch:
        sizes = [x[0].size for x in held]
        sig = np.concatenate([x[0] for x in held])
        fp, meta = (np.repeat(np.array([x[k] for x in held], "i8"), sizes) for k in (1, 2))
        order = np.argsort(sig, kind="stable")
        start = np.flatnonzero(np.diff(sig[order], prepend=~sig[order[:1]]))
        rank = np.empty(sig.size, "i8")
        rank[order] = np.arange(sig.size) - np.repeat(start, np.diff(start, append=sig.size))
        salt = np.where(rank < FEW, 0, 1 + fp % SALTS).astype("i4")
        return pa.RecordBatch.from_arrays(list(map(pa.array, (sig.view("i8"), fp, meta, salt))), names=NAMES)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "sig long, fp long, meta long, salt int")


NAMES = ["sig", "fp", "meta", "salt"]


def sets_of(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """fp and set (sorted 64-bit hashes, as bytes) of each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t.as_py(), size) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([set_hash(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["fp", "set"])

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "fp long, set binary")


@F.pandas_udf(T.BooleanType())
def similar(a: pd.Series, b: pd.Series) -> pd.Series:
    out = []
    for x, y in zip(a, b):
        x, y = np.frombuffer(x, U), np.frombuffer(y, U)
        both = np.intersect1d(x, y, assume_unique=True).size
        out.append(100 * both >= PERCENT * (x.size + y.size - both))
    return pd.Series(out, dtype=bool)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of classes whose sets (fp, n, set) are similar."""
    near = pairs.distinct().join(sets.selectExpr("fp as a", "n as na"), "a").join(sets.selectExpr("fp as b", "n as nb"), "b")
    near = near.filter(f"100 * least(na, nb) >= {PERCENT} * greatest(na, nb)").select("a", "b")
    both = near.join(sets.selectExpr("fp as a", "set as set_a"), "a").join(sets.selectExpr("fp as b", "set as set_b"), "b")
    return written(both.filter(similar("set_a", "set_b")).select("a", "b"))


def components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Carries the smallest label over links (a, b). labels: fp, comp, where comp is the smallest fp of the
    component so far. Each turn takes the least label of the neighbours' components and jumps to that
    component's own label, so chains shorten by half or better."""
    while True:
        ends = links.join(labels.toDF("a", "ca"), "a").join(labels.toDF("b", "cb"), "b").filter("ca <> cb").select(F.least("ca", "cb").alias("lo"), F.greatest("ca", "cb").alias("hi"))
        parents = written(ends.groupBy("hi").agg(F.min("lo").alias("lo")))
        if parents.isEmpty():
            return labels
        while True:  # a parent may have a parent
            up = parents.alias("x").join(parents.toDF("mid", "top").alias("y"), F.col("x.lo") == F.col("y.mid"), "left")
            jumped = written(up.select("hi", F.coalesce("top", "lo").alias("lo"), F.col("top").isNotNull().alias("moved")))
            parents = jumped.select("hi", "lo")
            if jumped.filter("moved").isEmpty():
                break
        labels = written(labels.join(parents, labels["comp"] == parents["hi"], "left").select("fp", F.coalesce("lo", "comp").alias("comp")))


def bucket_rows(docs: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """(rows, shared): doc_id, n_shingles and fp of each row of docs; sig, fp, slack and held (shared signatures of
    the class in that band) of the signatures that different classes have, but for classes with too few of them."""
    of_sig = Window.partitionBy("sig", "salt")
    met = signed(docs, size).withColumns({"lo": F.min("fp").over(of_sig), "hi": F.max("fp").over(of_sig)})
    kept = written(met.filter("salt <> 0 or lo <> hi").drop("lo", "hi"))
    rows = kept.filter("salt < 0").selectExpr("sig as doc_id", "meta as n_shingles", "fp")
    many = kept.filter("salt >= 0").select("sig", "fp", "meta").distinct()
    held = many.withColumn("held", F.count("*").over(Window.partitionBy("fp", "meta"))).withColumn("slack", F.expr("meta & 4294967295"))
    return rows, written(held.filter("held >= slack").drop("meta"))


def set_classes(docs: DataFrame, size: int = SHINGLE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, classes, labels): rows are doc_id, n_shingles and fp of each row of docs; classes are the distinct
    sets: fp, the smallest doc_id and the size; labels are fp and comp, the smallest fp of the component of each
    class that has a partner."""
    rows, shared = bucket_rows(docs, size)
    classes = written(rows.filter("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("first"), F.min("n_shingles").alias("n"), F.count("*").alias("n_rows")))
    # Two members of each bucket: that with most shared signatures (what others are copies of has more than they), one by chance.
    hubs = shared.groupBy("sig").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi"), F.max_by("fp", F.struct("held", "fp")).alias("full"), F.max_by("fp", F.xxhash64("fp", F.lit(size))).alias("other"))
    hubs = hubs.filter("lo <> hi").select("sig", F.array_distinct(F.array("full", "other")).alias("hubs"))
    shared = written(shared.join(hubs, "sig"))
    met = shared.select("fp", "slack", F.explode("hubs").alias("hub")).filter("fp <> hub").groupBy("hub", "fp", "slack").count().filter("count >= slack")
    ids = small(written(shared.select("fp").distinct()), BROADCAST_ROWS)
    sets = written(sets_of(texts_of(classes.join(ids, "fp", "left_semi"), docs), size).dropDuplicates(["fp"]).join(classes.select("fp", "n"), "fp"))
    links = verified(met.select(F.least("hub", "fp").alias("a"), F.greatest("hub", "fp").alias("b")), sets)
    labels = components(written(ids.select("fp", F.col("fp").alias("comp"))), links)
    links = verified(remaining_pairs(shared.select("sig", "fp").join(labels, "fp"), sets), sets)
    return rows, classes, components(labels, links)


def texts_of(classes: DataFrame, docs: DataFrame) -> DataFrame:
    """The texts of a first document each of the classes."""
    wanted = small(written(classes.select(F.col("first").alias("wanted")).distinct()), BROADCAST_ROWS)
    d = docs.select(F.col("doc_id").cast("long"), "text")
    return d.join(wanted, d["doc_id"].eqNullSafe(wanted["wanted"]), "left_semi")


def elements(sets: DataFrame) -> DataFrame:
    """fp, comp, n and e of each element e of sets (fp, comp, n, set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                each = [np.frombuffer(s.as_py(), "i8") for s in part.column("set")]
                of = pa.array(np.repeat(np.arange(len(each)), [x.size for x in each]))
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(of) for c in ("fp", "comp", "n")), pa.array(np.concatenate(each))], names=["fp", "comp", "n", "e"])

    return sets.select("fp", "comp", "n", "set").mapInArrow(run, "fp long, comp long, n long, e long")


def across(rows: DataFrame, *key: str) -> DataFrame:
    """key, found and top of the keys at which rows of different comp meet: the rows, and of these components the one
    with most classes."""
    met = rows.groupBy(*key).agg(F.count("*").alias("found"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max_by("comp", F.struct("weight", "comp")).alias("top") if "weight" in rows.columns else F.lit(0).alias("top"))
    return met.filter("lo <> hi").drop("lo", "hi")


def remaining_pairs(shared: DataFrame, sets: DataFrame) -> DataFrame:
    """All pairs (a, b) across components that may be linked. shared: sig, fp, comp.

    Only classes in buckets with several components are looked at. Their elements are put in one order: first those
    that no two components share, then by how many classes have them, rarest first. If A and B are linked, at least
    4/9 of n_a + n_b elements are common, so the first common one is at a place i in A with n_a - i + 1 of at least
    that, and likewise in B. So place i limits a partner's size; rows meet by element and by both sizes' cells. Pairs
    within one component needn't meet: of each key's largest component rows meet those of others only."""
    open_ = shared.join(across(shared, "sig"), "sig", "left_semi").select("fp", "comp").distinct()
    weights = open_.groupBy("comp").agg(F.count("*").alias("weight"))
    left = written(open_.join(weights, "comp"))
    each = elements(left.join(sets, "fp")).join(left.select("fp", "weight"), "fp")
    each = written(each)
    ranked = each.join(across(each.select("e", "comp"), "e").select("e", "found"), "e")
    of_class = Window.partitionBy("fp")
    place = F.row_number().over(of_class.orderBy("found", "e")) + F.col("n") - F.count("*").over(of_class)
    cell = lambda n: f"cast(floor(ln({n}) / ln({CELL})) as int)"
    whole = 100 + PERCENT
    placed = ranked.withColumn("i", place).withColumn("most", F.expr(f"{whole} * (n - i + 1) div {PERCENT} - n")).filter(f"100 * most >= {PERCENT} * n")
    placed = placed.withColumn("own", F.expr(cell("n"))).withColumn("cell", F.explode(F.expr(f"sequence({cell(f'ceil({PERCENT / 100} * n)')}, {cell('most')})")))
    rows = written(placed.selectExpr("e", "least(own, cell) as c1", "greatest(own, cell) as c2", "own", "fp", "comp", "weight", "n", "i"))
    key = ["e", "c1", "c2"]
    rows = written(rows.join(across(rows, *key).select(*key, "top"), key))
    a = rows.filter("comp <> top").selectExpr(*key, "fp as a", "comp as ca", "n as na", "i as ia", "own as oa")
    b = rows.selectExpr(*key, "fp as b", "comp as cb", "n as nb", "i as ib", "own as ob")
    fits = f"ca <> cb and (oa <> ob or c1 = c2) and {whole} * (na - ia + 1) >= {PERCENT} * (na + nb) and {whole} * (nb - ib + 1) >= {PERCENT} * (na + nb)"
    return a.join(b, key).filter(fits).selectExpr("least(a, b) as a", "greatest(a, b) as b").distinct()


def near_duplicate_groups(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable over links) of each row of docs.

    Nulls and texts without words are empty sets, linked with nothing: their component is their own doc_id. A
    null doc_id counts as larger than any other. Repeated rows stay; rows with one doc_id and different texts
    are linked as separate texts."""
    return grouped(*set_classes(docs, size))


def with_component(classes: DataFrame, labels: DataFrame) -> DataFrame:
    return classes.join(labels, "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))


def grouped(rows: DataFrame, classes: DataFrame, labels: DataFrame) -> DataFrame:
    named = with_component(classes, labels)
    roots = named.groupBy("comp").agg(F.min("first").alias("component_id"), F.sum("n_rows").alias("rows"))
    # Rows that are alone are their own component. A class may hold a third of all rows: broadcast, or split as skewed.
    of_class = small(written(named.join(roots.filter("rows > 1"), "comp").select("fp", "component_id")), BROADCAST_ROWS)
    return rows.join(of_class, "fp", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def with_fp(docs: DataFrame, text: str, size: int = SHINGLE) -> DataFrame:
    """Adds _fp, the hash of the shingle set (null for an empty one) of the column text, to docs."""
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = (shingle_set(t.as_py(), size) for t in b.column(text))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([set_hash(s) if s.size else None for s in sets], pa.int64())], names=[*b.schema.names, "_fp"])

    return docs.mapInArrow(run, f"{kind}, _fp long")


def deduplicated(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """One row of each group of docs: that with the smallest doc_id, null last. Rows without words are in no group;
    of equal ones with one doc_id, one stays. A doc_id tells rows apart only if it isn't null and comes once, else
    the row of a group is found by its doc_id and set."""
    rows, classes, labels = set_classes(docs, size)
    if rows.groupBy("doc_id").count().filter("doc_id is null or count > 1").isEmpty():
        groups = grouped(rows, classes, labels)
        gone = small(written(groups.filter("doc_id <> component_id").select(F.col("doc_id").alias("gone"))), BROADCAST_ROWS)
        return docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")
    best = F.min(F.struct(F.col("first").isNull().alias("none"), F.col("first").alias("_id"), F.col("fp").alias("_set")))
    keep = small(written(with_component(classes, labels).groupBy("comp").agg(best.alias("k")).select("k._id", "k._set")), BROADCAST_ROWS)
    frame, own = renamed(docs, [])
    doc_id, text = own["doc_id"], own["text"]
    marked = with_fp(frame, text, size)
    full = marked.join(keep, (marked["_fp"] == keep["_set"]) & marked[doc_id].eqNullSafe(keep["_id"]), "left_semi").dropDuplicates(["_fp"])
    empty = marked.filter("_fp is null")
    parts = [full, empty.filter(F.col(doc_id).isNotNull()).dropDuplicates([doc_id, text]), empty.filter(F.col(doc_id).isNull())]
    return reduce(DataFrame.unionByName, parts).select(*restored(own))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(read(spark, sf_dir, "documents"))


QUERIES = {"op5_ngram_jaccard_join": op5_ngram_jaccard_join}
SQL = {
    "op5_ngram_jaccard_join": r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1:i + 5], ' ') AS s FROM words, unnest(range(0, CASE WHEN len(w) = 0 THEN 0 ELSE greatest(len(w) - 4, 1) END)) AS r(i)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_common FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * n_common >= 80 * (x.n + y.n - n_common)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, coalesce(max(n), 0) AS n_shingles, min(b) AS component_id FROM documents d JOIN reach ON reach.a = d.doc_id LEFT JOIN sizes USING (doc_id) GROUP BY d.doc_id
"""
}
