"""Approximate nearest neighbours with learned partitions.

On a bounded sample, an exact neighbour graph is cut into parts of about equal size with few edges between
them; a small softmax classifier learns a vector's part from the parts of its neighbours. Every vector of the
table goes to its most probable part, a query to as many of the most probable parts as the sample shows to be
needed, where all members are ranked by their exact distance.

Parts are cut into blocks of bounded size, so a part that holds a third of all vectors (say, copies of one) is
searched by many tasks; queries of a part are dealt to chunks in the same way.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, read

SAMPLE, PARTS, DEGREE, RECALL, TOP = 4096, 32, 10, 0.96, 10
BLOCK, CHUNK = 16_384, 8_192  # vectors of a block, queries of a chunk, about


@dataclass
class Router:
    weights: np.ndarray
    bias: np.ndarray
    centre: np.ndarray
    probes: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        return (x - self.centre) @ self.weights + self.bias


def neighbour_graph(x: np.ndarray, degree: int) -> np.ndarray:
    """The nearest others of each row of x, by brute force."""
    degree = min(degree, len(x) - 1)
    square = (x * x).sum(1)
    out = np.empty((len(x), degree), int)
    for at in range(0, len(x), 512):
        d = square[None] - 2 * x[at : at + 512] @ x.T
        d[np.arange(len(d)), at + np.arange(len(d))] = np.inf
        out[at : at + 512] = np.argpartition(d, degree - 1, axis=1)[:, :degree] if degree else 0
    return out


def balanced_parts(graph: np.ndarray, parts: int, sweeps: int = 12, slack: float = 1.1) -> np.ndarray:
    """Parts of a neighbour graph of about equal size with few edges between them: grown breadth-first up to their
    share, then improved by moving nodes to the part of most of their neighbours while that has room."""
    n = len(graph)
    room = int(np.ceil(slack * n / parts))
    links: list[list[int]] = [[] for _ in range(n)]
    for a, row in enumerate(graph):
        for b in row:
            links[a].append(int(b))
            links[int(b)].append(a)
    part, share = np.full(n, -1), int(np.ceil(n / parts))
    order, k, held = iter(np.random.default_rng(5).permutation(n).tolist()), 0, 0
    queue: list[int] = []
    for start in order:
        if part[start] >= 0:
            continue
        queue = [start]
        while queue:
            a = queue.pop(0)
            if part[a] >= 0:
                continue
            if held == share:
                k, held, queue = k + 1, 0, []  # the next part grows from here
            part[a] = k
            held += 1
            queue += [b for b in links[a] if part[b] < 0]
    size = np.bincount(part, minlength=parts)
    for sweep in range(sweeps):
        moved = 0
        for a in np.random.default_rng(sweep).permutation(n).tolist():
            votes = np.bincount(part[links[a]], minlength=parts) if links[a] else np.zeros(parts)
            open_ = np.where(size < room, votes, -1)
            open_[part[a]] = votes[part[a]]
            b = int(open_.argmax())
            if open_[b] > votes[part[a]]:
                size[part[a]] -= 1
                size[b] += 1
                part[a] = b
                moved += 1
        if not moved:
            break
    return part


def fit_router(x: np.ndarray, parts: int = PARTS, recall: float = RECALL, top: int = TOP, steps: int = 300) -> tuple[Router, int]:
    """A router fitted on the rows of x, and its number of parts. It is asked to find the given share of the
    sample's own neighbours; in the whole table they lie nearer."""
    x = np.unique(x, axis=0) if len(x) else x
    parts = max(1, min(parts, len(x) // (4 * top)))
    dim = x.shape[1] if x.ndim == 2 and len(x) else 0
    if parts == 1:
        return Router(np.zeros((dim, 1)), np.zeros(1), np.zeros(dim), 1), 1
    graph = neighbour_graph(x, max(top, DEGREE))
    part = balanced_parts(graph, parts)
    centre, one = x.mean(0), np.eye(parts)
    goal = 0.5 * one[part] + 0.5 * one[part[graph]].mean(1)
    scale = np.sqrt(((x - centre) ** 2).sum(1).mean()) or 1.0
    z = (x - centre) / scale
    w, b = np.zeros((dim, parts)), np.zeros(parts)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, b)]
    for step in range(1, steps + 1):
        s = z @ w + b
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        off = (p - goal) / len(z)
        for value, grad, (m, v) in zip((w, b), (z.T @ off + 1e-5 * w, off.sum(0)), state):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            value -= 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    router = Router(w / scale, b, centre, parts)
    s = router.scores(x)
    home, rank = s.argmax(1), np.argsort(np.argsort(-s, axis=1), axis=1)
    needed = rank[np.arange(len(x))[:, None], home[graph]]  # the probe at which a neighbour's part comes
    router.probes = next((k for k in range(1, parts + 1) if (needed < k).mean() >= recall), parts)
    return router, parts


def usable(vectors: DataFrame, length: int | None = None) -> DataFrame:
    """vec_id and embedding (doubles) of the rows that take part: an id, and a vector of the given length that has
    finite components only and isn't zero."""
    v = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    bad = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    v = v.filter(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & ~bad & F.exists("embedding", lambda c: c != 0))
    return v.filter(F.size("embedding") == length) if length is not None else v


def usual_length(vectors: DataFrame) -> int:
    """The most frequent length of usable vectors, the smaller one of equally frequent ones; 0 without any."""
    most = usable(vectors).groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return most[0]["n"] if most else 0


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1) if len(flat) else np.empty((0, 0))


def nearest(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, id, distance) of the nearest rows of x, ties to smaller ids, without a row of the same id. A
    quick distance only preselects, with room for its rounding; distances are differences of the vectors."""
    square, out = (x * x).sum(1), []
    for at in range(0, len(q), 256):
        part = q[at : at + 256]
        d = (part * part).sum(1)[:, None] + square[None] - 2 * part @ x.T
        d[q_ids[at : at + 256, None] == ids[None]] = np.inf
        k = min(top, len(x)) - 1
        limit = np.partition(d, k, axis=1)[:, k]
        limit = limit + 1e-9 * (1 + square.max() + (part * part).sum(1))
        for r in range(len(part)):
            near = np.flatnonzero((d[r] <= limit[r]) & np.isfinite(d[r]))
            exact = np.sqrt(((x[near] - part[r]) ** 2).sum(1))
            order = np.lexsort((ids[near], exact))[:top]
            out.append((np.full(len(order), at + r), ids[near][order], exact[order]))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.empty(0, int), np.empty(0, "i8"), np.empty(0))


def search(vectors: DataFrame, queries: DataFrame, top: int = TOP, sample: int = SAMPLE, parts: int = PARTS, recall: float = RECALL) -> DataFrame:
    """query_id, rank (from 1), vec_id and score (Euclidean distance) of the nearest rows of vectors found for
    each row of queries (both vec_id, embedding; queries of usable vectors).

    A query doesn't find rows with its own vec_id; ties go to the smaller vec_id. Each query is routed to parts
    that together hold more than ``top`` vectors, so it gets min(top, candidates) rows. Repeated ids are separate
    candidates; of queries with one id, the smallest vector counts. Vectors and queries of another length than most
    vectors have take no part. Empty tables give no rows."""
    spark = vectors.sparkSession
    length = usual_length(vectors)
    rows = usable(vectors, length)
    drawn = rows.orderBy(F.xxhash64(F.lit("sample"), "vec_id"), "vec_id").limit(sample).select("embedding").toArrow()  # a bounded sample
    router, parts = fit_router(matrix(drawn.column("embedding")), parts, recall, top)
    shared = spark.sparkContext.broadcast(router)

    def best(batches):
        for b in batches:
            part = shared.value.scores(matrix(b.column("embedding"))).argmax(1) if b.num_rows else np.empty(0, int)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(part.astype("i4"))], names=["vec_id", "embedding", "part"])

    index = cut(rows.mapInArrow(best, "vec_id long, embedding array<double>, part int"))
    count = np.zeros(parts, "i8")
    for r in index.groupBy("part").count().collect():  # one row per part
        count[r["part"]] = r["count"]
    sizes = spark.sparkContext.broadcast(count)

    def routes(batches):
        for b in batches:
            if not b.num_rows:
                continue
            order = np.argsort(-shared.value.scores(matrix(b.column("embedding"))), axis=1, kind="stable")
            enough = (np.cumsum(sizes.value[order], axis=1) <= top).sum(1) + 1
            probes = [o[: max(shared.value.probes, e)].tolist() for o, e in zip(order, enough)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(probes, pa.list_(pa.int32()))], names=["vec_id", "embedding", "parts"])

    asked = usable(queries, length).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    routed = cut(asked.mapInArrow(routes, "vec_id long, embedding array<double>, parts array<int>").withColumn("part", F.explode("parts")).drop("parts"))
    asks = {r["part"]: r["count"] for r in routed.groupBy("part").count().collect()}
    number = lambda of, unit: F.element_at(F.array(*[F.lit(max(1, -(-int(of(p)) // unit))) for p in range(parts)]), F.col("part") + 1)
    blocks, chunks = number(lambda p: count[p], BLOCK), number(lambda p: asks.get(p, 0), CHUNK)
    deal = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), "vec_id"), n).cast("int")
    left = routed.withColumns({"chunk": deal(chunks, "q"), "block": F.explode(F.sequence(F.lit(0), blocks - 1))})
    right = index.withColumns({"block": deal(blocks, "v"), "chunk": F.explode(F.sequence(F.lit(0), chunks - 1))})

    def rank(q: pa.Table, x: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not q.num_rows or not x.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64())], names=names)
        q_ids, ids = q.column("vec_id").to_numpy(), x.column("vec_id").to_numpy()
        at, found, score = nearest(matrix(q.column("embedding")), q_ids, matrix(x.column("embedding")), ids, top)
        return pa.table([pa.array(q_ids[at]), pa.array(found), pa.array(score)], names=names)

    key = ["part", "block", "chunk"]
    kind = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(rank, kind)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.filter("vec_id % 100 = 0"))


QUERIES = {"op4_nearest_neighbours": op4_nearest_neighbours}
SQL: dict[str, str] = {}
