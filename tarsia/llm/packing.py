"""Best-fit packing of tokenised documents into fixed-length training sequences.

Texts are tokenised on the executors and cut into pieces of at most ``capacity`` tokens. What decides the
packing is only how many pieces there are of each length, a histogram of at most ``capacity`` rows. The plan is
made from that histogram by exact-complement hashing: the longest open length takes a single piece, a pair or a
triple whose lengths fill its gap exactly, as often as their counts allow; where no sum fits exactly, the
combination that leaves the smallest gap is taken and the rest of the gap filled best-fit. The plan is a bounded
list of (pattern, times); pieces find their place in it by their rank among the pieces of their length.
"""

from __future__ import annotations

import base64
import json
import os
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zlib
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, read, renamed, restored, tokenizer_path

CAPACITY = 2048
VOCABULARY = "byte_bpe_50k.tiktoken"  # the vocabulary of byte_bpe_50k.json, as ranks
JSON_FILE = "byte_bpe_50k.json"  # lies beside it
LONG_SPACE = 100_000  # white space in a row that tiktoken still splits (its regex stack ends near a million)
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids array<int>"


def encoder(path: str):
    """Byte-level BPE over the ranks in a file, with the added tokens that the JSON file beside it lists. Its ids
    equal those of the tokenizers library on that file (a test holds the two together); it is about five times as
    fast. encode_ordinary takes added tokens for ordinary text."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(json_path(path), encoding="utf-8") as f:
        added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)


def json_path(path: str) -> str:
    return os.path.join(os.path.dirname(path), JSON_FILE)


@lru_cache(maxsize=2)
def ids_of(path: str) -> Callable[[str], list[int]]:
    """The function from a text to its ids; added tokens inside a text are matched, as tokenizers does. Texts with
    very long white space, on which tiktoken's regex fails, go through the tokenizers library."""
    fast = encoder(path)
    added = fast.special_tokens_set
    long_space = re.compile(rf"(?<!\s)\s{{{LONG_SPACE}}}")
    whole = None

    def ids(text: str) -> list[int]:
        nonlocal whole
        if len(text) < LONG_SPACE or not long_space.search(text):
            return fast.encode(text, allowed_special=added, disallowed_special=())
        if whole is None:
            from tokenizers import Tokenizer

            whole = Tokenizer.from_file(json_path(path))
        return whole.encode(text, add_special_tokens=False).ids

    return ids


def cut_points(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all full but the first."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = 0, vocabulary: str | None = None, keep_ids: bool = True) -> DataFrame:
    """One row per piece of each row of docs (doc_id, text): ids of the text, then end_id, cut at capacity.

    A null text counts as empty (one piece holding end_id alone). Rows are independent: repeated rows give
    repeated pieces. keep_ids=False leaves the column ids null and keeps its checksum."""
    path = vocabulary or tokenizer_path(VOCABULARY)

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = ids_of(path)
        for batch in batches:
            doc_ids, texts = batch.column(0), batch.column(1)
            rows: list[tuple] = []
            held = 0
            for d, t in zip(doc_ids.to_pylist(), texts):
                ids = np.array([*encode(t.as_py() or ""), end_id], "<u4")
                for k, (s, n) in enumerate(cut_points(len(ids), capacity)):
                    x = ids[s : s + n]
                    rows.append((d, k, s, n, zlib.crc32(x.tobytes()), x.astype("i4") if keep_ids else None))
                held += len(ids)
                if held > 1_000_000:
                    yield piece_batch(rows)
                    rows, held = [], 0
            if rows:
                yield piece_batch(rows)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tokenise, PIECES)


def piece_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
    names = [x.split()[0] for x in PIECES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def plan_packing(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths of the pieces of a sequence, number of such sequences)] that use up a histogram of lengths.

    Each turn takes the longest length left and fills its gap: exactly by one, two or three lengths if their
    sum is there, else by the combination of at most three that comes nearest, again and again while anything
    fits. A turn repeats its pattern as often as the counts allow, so there are about as many turns as lengths."""
    left = np.zeros(capacity + 1, "i8")
    for n, c in counts.items():
        left[n] = c
    plan = []
    while (open_ := np.flatnonzero(left)).size:
        longest = int(open_[-1])
        used = Counter([longest])
        while best := fill(left, used, capacity - sum(k * v for k, v in used.items())):
            used.update(best)
        times = min(int(left[n]) // k for n, k in used.items())
        for n, k in used.items():
            left[n] -= times * k
        plan.append((tuple(sorted(used.elements(), reverse=True)), times))
    return plan


def fill(left: np.ndarray, used: Counter, gap: int) -> tuple[int, ...]:
    """Up to three lengths whose sum is as near to gap as the counts allow, () if none fits; an exact single
    goes before an exact pair, that before an exact triple, and longer parts before shorter ones."""
    if gap < 1:
        return ()
    free = left[: gap + 1].copy()
    for n, k in used.items():
        if n <= gap:
            free[n] -= k
    there = np.flatnonzero(free > 0)
    if not there.size:
        return ()
    if there[-1] == gap:
        return (gap,)
    twice = free > 1
    best: tuple[int, tuple[int, ...]] = (int(there[-1]), (int(there[-1]),))
    pair = np.zeros(gap + 1, "i8")  # for each sum, the longer part of a pair that has it
    for a in there:  # ascending, so that the longest part stays
        b = there[: np.searchsorted(there, min(a, gap - a), "right")]
        if b.size and b[-1] == a and not twice[a]:
            b = b[:-1]
        pair[a + b] = a
    if (sums := np.flatnonzero(pair)).size:
        s = int(sums[-1])
        if s > best[0]:
            best = (s, (int(pair[s]), s - int(pair[s])))
        if s == gap:
            return best[1]
    for a in there[::-1]:
        a = int(a)
        rest = gap - a
        low = pair[: rest + 1]
        for s in np.flatnonzero(low)[::-1]:
            b, c = int(low[s]), int(s - low[s])
            if all(free[n] >= k for n, k in Counter((a, b, c)).items()):
                if a + s > best[0]:
                    best = (int(a + s), (a, b, c))
                break
        if best[0] == gap:
            break
    return best[1]


def places(plan: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """The plan by length: for each length, where runs of ranks begin, the first sequence and the offset of a run."""
    rank, out, sequence = Counter(), {k: [] for k in ("length", "rank", "sequence", "offset")}, 0
    for lengths, times in plan:
        at = 0
        for n in lengths:
            for k, v in zip(out, (n, rank[n], sequence, at)):
                out[k].append(v)
            rank[n] += times
            at += n
        sequence += times
    order = np.lexsort((out["rank"], out["length"])) if out["rank"] else []
    return {k: np.array(v, "i8")[order] for k, v in out.items()}


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (any columns, of them length in 1..capacity), so that sequences
    hold at most capacity tokens, gapless from 0, and are few. Repeated rows are packed like any others; an
    empty frame stays empty; columns sequence_id and offset are replaced. Raises if a length is out of range."""
    spark = pieces.sparkSession
    pieces, own = renamed(pieces, ["sequence_id", "offset"])
    pieces = pieces.withColumnRenamed(own.pop("length"), "length")
    own["length"] = "length"
    columns = pieces.columns
    names = {"part": "_part", "rank": "_rank"}
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, "i8")
        for batch in batches:
            n = batch.column("length").to_numpy(zero_copy_only=False)
            if n.size and not (1 <= n.min() and n.max() <= capacity):
                raise ValueError(f"length outside 1..{capacity}")
            order = np.argsort(n, kind="stable")
            firsts = np.searchsorted(n[order], n[order])
            rank = np.empty(len(n), "i8")
            rank[order] = seen[n[order]] + np.arange(len(n)) - firsts
            seen += np.bincount(n, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(n), pa.int32()), pa.array(rank)], names=[*columns, *names.values()])

    # Numbered within task and length, then written once: the numbers never change afterwards.
    numbered = cut(pieces.mapInArrow(number, f"{kind}, _part int, _rank long"))
    per_part = numbered.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    per_part = per_part.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    histogram = {r["length"]: r["n"] for r in numbered.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    table = spark.sparkContext.broadcast(places(plan_packing(histogram, capacity)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = table.value
        starts = p["length"] << 44 | p["rank"]
        for batch in batches:
            n, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            at = np.searchsorted(starts, n << 44 | rank, "right") - 1
            more = [pa.array(p["sequence"][at] + rank - p["rank"][at]), pa.array(p["offset"][at])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *more], names=[*columns, "sequence_id", "offset"])

    ranked = numbered.join(per_part.select("length", "_part", "_base"), ["length", "_part"]).select(*columns, (F.col("_rank") + F.col("_base")).alias("_rank"))
    return ranked.mapInArrow(place, f"{kind}, sequence_id long, offset long").select(*restored(own), "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """The token sequences themselves: sequence_id, ids, and the pieces that each holds. A sequence has at most
    capacity tokens, so its group is bounded."""
    each = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    return packed.groupBy("sequence_id").agg(each.alias("p")).select(
        "sequence_id", F.flatten("p.ids").alias("ids"), F.expr("transform(p, x -> struct(x.doc_id, x.piece, x.offset))").alias("pieces")
    )


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"))


def pack_documents(docs: DataFrame) -> DataFrame:
    return pack(token_pieces(docs, keep_ids=False).drop("ids"))


QUERIES = {"op1_best_fit_packing": op1_best_fit_packing}
SQL: dict[str, str] = {}
