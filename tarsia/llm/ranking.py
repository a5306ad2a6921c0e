"""Ranked lexical search: exact inner products of sparse vectors, pruned by ball trees.

A document's score for an item is an inner product: the weights of the item's terms with the document's impacts, which
depend on its counts and length. Documents come in blocks; each block's vectors are put in a ball tree (two far
documents attract halves of a node, down to leaves of a few dozen). A node knows its centroid and two radii: that
of the whole ball, and how far its documents reach over the centroid in each single coordinate. Centroid and
radius bound the inner product of all documents below. A search opens nodes best first and ends at the first node whose
bound, rounded up, is below the score of the last one in the top list; leaves are scored in integers, so the result is exact.

Only terms of items are kept of a document. Items are searched in blocks whose terms are few enough for the driver and
the tasks; each task keeps one list of the best for each item over all its blocks of documents.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, written

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOP = 10
ITEMS_AT_ONCE, TERMS_AT_ONCE = 2_000, 16_384  # of a block of items; an item of more terms stands alone
BLOCK, BLOCK_ENTRIES, LEAF = 8_192, 4_000_000, 64  # documents and counts in a tree, documents in a leaf
# Bytes of separators become blanks, A-Z small letters; those beyond ASCII stay.
FOLDED = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()


def item_terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(TERM), F.lit(0)))


def item_blocks(items: DataFrame) -> Iterator[list[Row]]:
    """The items (item_id, terms) that have a term, in lists of bounded size, split by a hash."""
    frame = written(items.select("item_id", item_terms(F.col("text")).alias("terms")).filter(F.size("terms") > 0))
    n, terms = frame.agg(F.count("*"), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    blocks = max(1, math.ceil(n / ITEMS_AT_ONCE), math.ceil(terms / TERMS_AT_ONCE))
    for k in range(blocks):
        part = frame.filter(F.pmod(F.xxhash64("item_id", "terms"), F.lit(blocks)) == k)
        rows: list[Row] = []
        size = 0
        for row in part.toLocalIterator():  # a block is a few thousand items; hashes may still crowd one
            if rows and (len(rows) >= ITEMS_AT_ONCE or size + len(row.terms) > TERMS_AT_ONCE):
                yield rows
                rows, size = [], 0
            rows.append(row)
            size += len(row.terms)
        if rows:
            yield rows


def counts(docs: DataFrame, number: dict[str, int]) -> DataFrame:
    """doc_id, n (terms), ids and tf (the terms that have a number, and how often) of each document with a term."""
    shared = docs.sparkSession.sparkContext.broadcast({t.encode(): k for t, k in number.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value.get
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                rows, n, ids, tf = [], [], [], []
                for k, text in enumerate(b.column(1).to_pylist()):
                    terms = (text or "").encode().translate(FOLDED).split()
                    if terms:
                        i, c = np.unique(np.array([x for x in map(of, terms) if x is not None], np.int32), return_counts=True)
                        rows.append(k)
                        n.append(len(terms))
                        ids.append(i)
                        tf.append(c)
                if rows:
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(n, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.int64()))], names=["doc_id", "n", "ids", "tf"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n long, ids array<int>, tf array<bigint>")


class Tree:
    """A ball tree over documents' sparse vectors: ptr, term and impact (integers) by document; scale: the root of each
    term's weight. Coordinates are impact * scale, a query's are scale."""

    def __init__(self, ids: list[int | None], ptr: np.ndarray, term: np.ndarray, impact: np.ndarray, scale: np.ndarray):
        self.size, self.scale = len(scale), scale
        value = impact * scale[term]
        order: list[np.ndarray] = []
        self.nodes: list[tuple[int, int, int, int]] = []  # left and right child, or -1; first and last document in the order
        self.centre: list[np.ndarray] = []
        self.over: list[np.ndarray] = []
        self.radius: list[float] = []
        self._build(np.arange(len(ids)), ptr, term, value, order)
        at = np.concatenate(order)
        rows, self.ptr = picked(ptr, at)
        self.ids, self.term, self.impact = [ids[k] for k in at], term[rows], impact[rows]
        self.centre, self.over, self.radius = np.stack(self.centre), np.stack(self.over), np.array(self.radius)

    def _build(self, docs: np.ndarray, ptr: np.ndarray, term: np.ndarray, value: np.ndarray, order: list[np.ndarray]) -> int:
        first = sum(map(len, order))
        if len(docs) <= LEAF:
            rows, p = picked(ptr, docs)
            dense = np.zeros((len(docs), self.size))
            dense[np.repeat(np.arange(len(docs)), np.diff(p)), term[rows]] = value[rows]
            centre = dense.mean(axis=0)
            order.append(docs)
            radius = float(np.sqrt(((dense - centre) ** 2).sum(axis=1).max()))
            return self._add((-1, -1, first, first + len(docs)), centre, np.maximum(dense.max(axis=0) - centre, 0), radius)
        rows, p = picked(ptr, docs)
        t, v = term[rows], value[rows]
        dot = lambda x: np.add.reduceat(np.append(v * x[t], 0.0), p[:-1])  # noqa: E731  (no document is empty)
        norm = np.add.reduceat(np.append(v * v, 0.0), p[:-1])

        def dense_of(k: int) -> np.ndarray:
            x = np.zeros(self.size)
            x[t[p[k] : p[k + 1]]] = v[p[k] : p[k + 1]]
            return x

        middle = np.bincount(t, v, self.size) / len(docs)
        a = int(np.argmax(norm - 2 * dot(middle)))
        pa_ = dense_of(a)
        to_a = dot(pa_)
        b = int(np.argmax(norm - 2 * to_a))
        nearer = norm[b] - norm[a] + 2 * (to_a - dot(dense_of(b)))
        by = np.argsort(-nearer, kind="stable")
        half = len(docs) // 2
        left, right = self._build(docs[by[:half]], ptr, term, value, order), self._build(docs[by[half:]], ptr, term, value, order)
        share = half / len(docs)
        centre = share * self.centre[left] + (1 - share) * self.centre[right]
        over = np.maximum(np.maximum(self.centre[left] + self.over[left], self.centre[right] + self.over[right]) - centre, 0)
        radius = max(self.radius[k] + float(np.linalg.norm(self.centre[k] - centre)) for k in (left, right))
        return self._add((left, right, first, first + len(docs)), centre, over, radius)

    def _add(self, node: tuple[int, int, int, int], centre: np.ndarray, over: np.ndarray, radius: float) -> int:
        self.nodes.append(node)
        self.centre.append(centre)
        self.over.append(over)
        self.radius.append(radius)
        return len(self.nodes) - 1

    def bounds(self, terms: np.ndarray) -> np.ndarray:
        """For each node a number that no score below it exceeds, rounding included: sums of some thousand terms err by
        less than a part in 10^11, and a part in 10^9 and one more are added."""
        q = self.scale[terms]
        reach = np.minimum(self.over[:, terms] @ q, self.radius * np.linalg.norm(q))
        return (self.centre[:, terms] @ q + reach) * (1 + 1e-9) + 1

    def search(self, terms: np.ndarray, weight: np.ndarray, best: list[tuple[int, bool, int]], k: int) -> int:
        """Puts documents into the heap best (score, whether it has an id, minus the id), and tells how many leaves it read."""
        bound = self.bounds(terms)
        own = np.zeros(self.size, np.int64)
        own[terms] = weight[terms]
        todo, leaves = [(-bound[-1], len(self.nodes) - 1)], 0
        while todo:
            top, node = heapq.heappop(todo)
            if -top < (best[0][0] if len(best) == k else 1):
                break
            left, right, first, last = self.nodes[node]
            if left >= 0:
                for child in (left, right):
                    heapq.heappush(todo, (max(top, -bound[child]), child))
                continue
            leaves += 1
            a, b = self.ptr[first], self.ptr[last]
            score = np.add.reduceat(self.impact[a:b] * own[self.term[a:b]], self.ptr[first:last] - a)
            for d in np.flatnonzero(score >= (best[0][0] if len(best) == k else 1)).tolist():
                i = self.ids[first + d]
                entry = (int(score[d]), i is not None, -(i or 0))
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
        return leaves


def picked(ptr: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the entries of some rows stand, one row after the other, and their own ptr."""
    many = ptr[rows + 1] - ptr[rows]
    new = np.concatenate(([0], np.cumsum(many)))
    return np.arange(new[-1]) + np.repeat(ptr[rows] - new[:-1], many), new


def trees(batches: Iterator[pa.RecordBatch], scale: np.ndarray) -> Iterator[Tree]:
    """Trees over blocks of the rows doc_id, m, ids, tf."""
    held: list[tuple[list, np.ndarray, np.ndarray, np.ndarray]] = []

    def tree() -> Tree:
        ids = [i for h in held for i in h[0]]
        ptr = np.concatenate(([0], np.cumsum(np.concatenate([h[1] for h in held]))))
        out = Tree(ids, ptr, np.concatenate([h[2] for h in held]), np.concatenate([h[3] for h in held]), scale)
        held.clear()
        return out

    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            b = whole.slice(at, 512)
            many = b.column("ids").value_lengths().to_numpy()
            term, tf = b.column("ids").flatten().to_numpy(), b.column("tf").flatten().to_numpy()
            m = np.repeat(b.column("m").to_numpy(), many)
            held.append((b.column("doc_id").to_pylist(), many, term, (1_000_000_000 * tf) // (1000 * tf + 8 * m)))
            if sum(len(h[0]) for h in held) >= BLOCK or sum(len(h[2]) for h in held) >= BLOCK_ENTRIES:
                yield tree()
    if held:
        yield tree()


def searched(rows: DataFrame, block: list[Row], top: int, spark: SparkSession) -> DataFrame:
    """item_id, rank, doc_id, score for a block of items."""
    number = {t: k for k, t in enumerate(sorted({t for r in block for t in r.terms}))}
    table = written(counts(rows, number))
    n, total = table.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(1))).first()
    df = np.zeros(len(number), np.int64)
    for k, x in table.select(F.explode("ids").alias("id")).groupBy("id").count().collect():  # a row for each term of the block at most
        df[k] = x
    weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    queries = [np.array(sorted(number[t] for t in r.terms), np.int64) for r in block]
    shared = spark.sparkContext.broadcast((weight, np.sqrt(weight), queries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, scale, queries = shared.value
        best: list[list] = [[] for _ in queries]
        for tree in trees(batches, scale):
            for terms, b in zip(queries, best):
                tree.search(terms, weight, b, top)
        found = [(k, -minus if some else None, score) for k, b in enumerate(best) for score, some, minus in b]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.int32(), pa.int64(), pa.int64()))], names=["query", "doc_id", "score"])

    # m = 100 - 90 + (90 n N) div L, in decimals, since the product may pass 64 bits.
    m = F.expr(f"10 + (cast(90 * n as decimal(19,0)) * cast({n} as decimal(19,0))) div cast({total} as decimal(19,0))").cast("long")
    found = table.filter(F.size("ids") > 0).select("doc_id", m.alias("m"), "ids", "tf").mapInArrow(run, "query int, doc_id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    names = spark.createDataFrame([(k, r.item_id) for k, r in enumerate(block)], "query int, item_id long")
    return ranked.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")  # a row for each item of the block


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """The top documents (doc_id, text) of each item (item_id, text): item_id, rank (from 1), doc_id, score (> 0).

    Ids are integers. Each row is an item or a document of its own, so repeated documents all count and may all be ranked,
    and a repeated item has its list twice. Equal scores go by doc_id, null last. A null text has no terms; an
    item without terms or without a document that shares one has no rows. Other columns are not read. The result is
    computed when this is called, up to the last ranking."""
    spark = docs.sparkSession
    found = [searched(docs.select("doc_id", "text"), block, top, spark) for block in item_blocks(items.select(F.col("item_id").cast("long"), F.col("text").cast("string")))]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES = {"op13_ranked_search": op13_ranked_search}
SQL = {
    "op13_ranked_search": r"""
WITH words AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
d AS (SELECT r, doc_id, CAST(len(t) AS BIGINT) AS n, t FROM words WHERE len(t) > 0),
total AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS l FROM d),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) GROUP BY r, term),
items AS (SELECT row_number() OVER () AS q, item_id, list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
asked AS (SELECT q, item_id, unnest(t) AS term FROM items),
w AS (SELECT term, CAST(floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM tf, total GROUP BY term, nn),
scores AS (SELECT q, item_id, d.r, d.doc_id, CAST(sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (10 + (90 * d.n * nn) // l)))) AS BIGINT) AS score
 FROM asked JOIN w USING (term) JOIN tf USING (term) JOIN d USING (r), total GROUP BY q, item_id, d.r, d.doc_id)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores WHERE score > 0) WHERE rank <= 10
"""
}
