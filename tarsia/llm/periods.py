"""Runs of periodic words, found by recompression.

A text's words become numbers. A grid of every q-th word tells where a run of period q can lie: one of at least four
periods holds four grid words in a row, all equal. The texts that have such places are compressed level by
level, as in recompression: blocks of one symbol become a symbol with a count, then letters are split in left and
right ones and each pair of a left and a right one becomes a symbol of its own. Equal stretches of words get
equal symbols but for their margins, so the longest common extension of two places is found by walking up while
symbols agree and down where they differ, in steps as many as the logarithm of its length, whatever the counts of
the blocks. Each candidate is extended to both sides by the exact number of words.

Everything is done within one text; many texts are laid side by side, with a symbol that occurs once between them,
so that each step is one array operation over all. Rows never move between tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, read, renamed, restored

LEAST_WORDS, LEAST_PERIODS = 6, 4  # of a run
WORDS_AT_ONCE = 1 << 19  # texts are laid side by side up to so many words; a longer one stands alone


class Grammar:
    """All levels of the compressed sequence in flat arrays; a node is a place in them, and the words of the
    sequence are its first nodes. Symbols of at least ``lone`` at the first level occur once each and join no pair;
    one stands at either end.

    symbol, width (words below), first and last (child), begins and ends (the parent that the node begins or
    ends, else -1), more and less (equal symbols in a row from the node on, to the right and to the left)."""

    def __init__(self, words: np.ndarray, lone: int):
        parts: dict[str, list[np.ndarray]] = {k: [] for k in ("symbol", "width", "first", "last", "begins", "ends", "more", "less")}
        symbol, width, offset, fresh = words.astype(np.int64), np.ones(len(words), np.int64), 0, int(words.max()) + 1
        first = last = np.full(len(words), -1, np.int64)
        alone = symbol >= lone
        turn, level = 0, 0
        while True:
            n, level = len(symbol), level + 1
            same = symbol[1:] == symbol[:-1]
            edge = np.flatnonzero(np.concatenate(([True], ~same, [True])))
            count = np.diff(edge)
            starts, joined, other = edge[:-1], count > 1, count[count > 1]
            done = n == 2 * int(alone.sum()) - 1  # one node a text
            if not done and (turn == 1 or len(count) == n):
                left = left_ones(symbol, level)
                ok = ~alone[:-1] & ~alone[1:] & ~same
                down, up = ok & left[:-1] & ~left[1:], ok & ~left[:-1] & left[1:]
                pair = down if down.sum() >= up.sum() else up
                if not pair.any():  # other letters at the next level
                    turn = 0
                    continue
                starts = np.flatnonzero(np.concatenate(([True], ~pair)))
                joined = np.append(pair, False)[starts]
                other = symbol[starts[joined] + 1]
            rank = np.arange(n) - np.repeat(edge[:-1], count)
            for k, x in (("symbol", symbol), ("width", width), ("first", first), ("last", last), ("more", np.repeat(count, count) - rank), ("less", rank + 1)):
                parts[k].append(x)
            if done:
                break
            begun = np.zeros(n, bool)
            begun[starts] = True
            above = offset + n + np.cumsum(begun) - 1
            parts["begins"].append(np.where(begun, above, -1))
            parts["ends"].append(np.where(np.append(begun[1:], True), above, -1))
            ends = np.append(starts[1:], n) - 1
            new = symbol[starts]
            base = int(max(fresh, other.max() + 1))
            _, named = np.unique(new[joined] * base + other, return_inverse=True)
            new[joined] = fresh + named
            fresh += int(named.max()) + 1
            total = np.concatenate(([0], np.cumsum(width)))
            symbol, width, first, last, alone = new, total[ends + 1] - total[starts], offset + starts, offset + ends, alone[starts]
            offset, turn = offset + n, 1 - turn
        parts["begins"].append(np.full(n, -1, np.int64))
        parts["ends"].append(np.full(n, -1, np.int64))
        self.words = len(words)
        for k, x in parts.items():
            setattr(self, k, np.concatenate(x).astype(np.int32 if offset + n < 1 << 31 and k != "symbol" else np.int64))

    def extension(self, a: np.ndarray, b: np.ndarray, right: bool) -> np.ndarray:
        """The number of equal words from the places a and b on, each included, to the right or to the left."""
        many, up, child, way = (self.more, self.begins, self.first, 1) if right else (self.less, self.ends, self.last, -1)
        out = np.zeros(len(a), np.int64)
        row, u, v = np.arange(len(a)), a.astype(np.int64), b.astype(np.int64)
        while len(row):
            equal = self.symbol[u] == self.symbol[v]
            go = equal | (u >= self.words)
            row, u, v, equal = row[go], u[go], v[go], equal[go]
            step = np.where(equal, np.minimum(many[u], many[v]), 0)
            out[row] += step * self.width[u].astype(np.int64)
            pu, pv = u + way * step, v + way * step
            ru, rv = up[pu], up[pv]
            rise = (ru >= 0) & (rv >= 0)
            u = np.where(equal, np.where(rise, ru, pu), child[u])
            v = np.where(equal, np.where(rise, rv, pv), child[v])
        return out


def left_ones(symbol: np.ndarray, level: int) -> np.ndarray:
    """Which symbols are left letters of pairs: half of them, others at each level."""
    x = (symbol.astype(np.uint64) + np.uint64(level << 32)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x >> np.uint64(63) == 1


def candidates(words: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places g and periods q such that the words g, g + q, g + 2q and g + 3q are equal, g a multiple of q; one pair of
    arrays for all q from one power of two to the next. words: texts with a separator before and behind each, the
    longest first; sizes: their numbers of words."""
    upto = np.cumsum(sizes + 1) + 1
    longest = int(sizes[0]) if len(sizes) else 0
    low = 1
    while LEAST_PERIODS * low <= longest:
        at, period = [], []
        for q in range(low, min(2 * low, longest // LEAST_PERIODS + 1)):
            texts = int(np.searchsorted(-sizes, -LEAST_PERIODS * q, side="right"))  # those long enough
            part = words[: upto[texts - 1]]
            grid = part[::q]
            e = grid[1:] == grid[:-1]
            g = np.flatnonzero(e[:-2] & e[1:-1] & e[2:]) * q
            for k in {1, q // 2} if q > 1 and len(g) else ():
                g = g[(part[g + k] == part[g + k + q]) & (part[g + k] == part[g + k + 2 * q])]
            g = g[np.searchsorted(upto, g, "right") == np.searchsorted(upto, g + 3 * q, "right")]  # all in one text
            if len(g):
                at.append(g)
                period.append(np.full(len(g), q))
        if at:
            yield np.concatenate(at), np.concatenate(period)
        low *= 2


def side_by_side(texts: list[np.ndarray], kinds: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts with separators, and the places where they begin. Words are numbers below kinds."""
    sizes = np.array([len(t) for t in texts])
    begin = np.cumsum(sizes + 1) - sizes
    out = np.empty(int(sizes.sum()) + len(texts) + 1, np.int64)
    parts: list[np.ndarray] = []
    for k, t in enumerate(texts):
        parts += [np.array([kinds + k]), t]
    np.concatenate([*parts, np.array([kinds + len(texts)])], out=out)
    return out, begin


def runs_of(texts: list[np.ndarray], kinds: int) -> list[list[tuple[int, int, int]]]:
    """For each text (numbers below kinds) its runs (start, length, period), sorted by start, then period."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    order = sorted((k for k in range(len(texts)) if len(texts[k]) >= LEAST_WORDS), key=lambda k: -len(texts[k]))
    if not order:
        return found
    words, begin = side_by_side([texts[k] for k in order], kinds)
    places = [g for g, _ in candidates(words, np.array([len(texts[k]) for k in order]))]
    if not places:
        return found
    with_some = np.unique(np.searchsorted(begin, np.unique(np.concatenate(places)), side="right") - 1)
    order = [order[k] for k in with_some]
    words, begin = side_by_side([texts[k] for k in order], kinds)
    grammar = Grammar(words, kinds)
    reach = np.zeros(len(words), np.int64)  # the end of the farthest run, of those found, that holds the place
    for g, q in candidates(words, np.array([len(texts[k]) for k in order])):
        # Inside a run of a smaller period (which then divides q) nothing new can be found.
        new = reach[g] <= g + 3 * q
        g, q = g[new], q[new]
        start = g - grammar.extension(g - 1, g + q - 1, right=False)
        end = g + q + grammar.extension(g, g + q, right=True)
        held = (end > g + 3 * q) & (end - start >= np.maximum(LEAST_WORDS, LEAST_PERIODS * q))
        for s, e, p in np.unique(np.stack([start[held], end[held], q[held]], axis=1), axis=0).tolist():
            np.maximum(reach[s:e], e, out=reach[s:e])
            k = int(np.searchsorted(begin, s, side="right")) - 1
            found[order[k]].append((s - int(begin[k]), e - s, p))
    return [sorted(f, key=lambda r: (r[0], r[2])) for f in found]


def collapsed_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    """The words without those that a run repeats, joined by blanks."""
    if runs:
        keep = np.ones(len(words), bool)
        for start, length, period in runs:
            keep[start + period : start + length] = False
        words = [words[k] for k in np.flatnonzero(keep)]
    return b" ".join(words).decode()


def parts_of(texts: list[list[bytes]]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of WORDS_AT_ONCE words at most, or of one text."""
    at, n = 0, 0
    for k, t in enumerate(texts):
        if k > at and n + len(t) > WORDS_AT_ONCE:
            yield at, k
            at, n = k, 0
        n += len(t)
    if at < len(texts):
        yield at, len(texts)


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """Adds runs (array of start, length, period, in words; by start, then period) and collapsed (the text's words
    without those that a run repeats after its first period, joined by one blank) to docs, of which text is read.

    A run is a stretch of words of smallest period q, at least max(6, 4 q) words long, that no neighbouring word
    extends. A null text counts as empty: no runs, collapsed empty. Repeated rows each get their runs; rows may have
    null ids. Columns of docs that have the names of added ones, in any case, are replaced, all others stay."""
    frame, own = renamed(docs, ["runs", "collapsed"])
    text, names = own["text"], list(own.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                texts = [(t or "").encode().split() for t in batch.column(text).to_pylist()]
                for a, b in parts_of(texts):
                    number: dict[bytes, int] = {}
                    ids = [np.fromiter((number.setdefault(w, len(number)) for w in t), np.int64, len(t)) for t in texts[a:b]]
                    runs = runs_of(ids, len(number))
                    rows = [[dict(zip(("start", "length", "period"), r)) for r in rs] for rs in runs]
                    plain = [collapsed_words(t, r) for t, r in zip(texts[a:b], runs)]
                    yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array(rows, pa.list_(RUN)), pa.array(plain, pa.string())], names=[*names, "runs", "collapsed"])

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields)
    out = frame.mapInArrow(run, f"{kind}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
    return out.select(*restored(own), "runs", "collapsed")


def with_repeats(doc_id: Column, text: Column) -> Column:
    """The text, for a tenth of the ids with a tail that repeats its own words: with h the CRC of the id, g = h div
    10, the n words from a = g % n on become the first 1 + (n - a) div (3 + g % 8) of them, over and over."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    frame = F.struct(h.alias("h"), F.when(h % 10 == 0, F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).alias("w"))

    def tail(x: Column) -> Column:
        n, g = F.size(x["w"]).cast("long"), F.floor(x["h"] / 10)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(x["w"], F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")

    made = F.transform(F.array(frame), lambda x: F.when((x["h"] % 10 == 0) & (F.size(x["w"]) > 0), tail(x)))[0]
    return F.coalesce(made, text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", with_repeats(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic_runs(docs).drop("text")
    best = F.expr("aggregate(runs, cast(null as struct<start:bigint,length:bigint,period:bigint>), (b, r) -> if(b is null or r.length * b.period > b.length * r.period, r, b))")
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("").alias("lines"), "collapsed")
    return found.select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


QUERIES = {"op11_periodic_runs": op11_periodic_runs}
SQL: dict[str, str] = {}
