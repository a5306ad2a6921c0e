"""Language identification in two steps: the family first, then the language within it.

Features are hashed byte trigrams of the whole lower-cased text, as unit vectors of square roots. Families come
from the data: languages are merged by average linkage of their mean vectors, and the tree is cut where the similarity
of merges drops most, so three languages or more make at least two families. One-versus-rest linear support vector
machines tell families apart, one-versus-one machines the languages of one family.

The machines are fitted on the driver on a sample of labelled rows: ``SAMPLE`` shared by the languages in equal parts, at
least ``LEAST`` of each, never more than twice that in all; a row comes as one byte a feature. Everything else covers
every row. Prediction runs over whole texts on the executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, renamed, restored

BITS = 12  # of hashed features
SAMPLE, LEAST = 2000, 20  # labelled rows to fit on, shared by the languages in equal parts; of one language at least
UNKNOWN = "und"
TABLE = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def features(text: str) -> np.ndarray:
    """Unit vector of the square roots of hashed byte trigram counts; trigrams of two or more blanks are left out."""
    raw = np.frombuffer(b" " + text.lower().encode("utf-8", "surrogatepass").translate(TABLE) + b" ", np.uint8)
    a, b, c = raw[:-2].astype(np.uint32), raw[1:-1].astype(np.uint32), raw[2:].astype(np.uint32)
    h = (a | b << 8 | c << 16) * np.uint32(2654435761) >> np.uint32(32 - BITS)
    blank = raw == 32
    use = ~(blank[1:-1] & (blank[:-2] | blank[2:]))
    x = np.sqrt(np.bincount(h[use], minlength=1 << BITS)).astype("f4")
    norm = np.linalg.norm(x)
    return x / norm if norm else x


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def quantised(x: np.ndarray) -> bytes:
    """A feature vector in one byte a feature, in shares of its largest."""
    return np.rint(x * (255 / (x.max() or 1))).astype("u1").tobytes()


def fit_svm(positive: list[np.ndarray], negative: list[np.ndarray], penalty: float = 1e-3, steps: int = 120) -> np.ndarray:
    """Linear support vector machine (squared hinge, accelerated gradient descent) on blocks of rows, read in place; the
    last column of a block is 1. The two classes weigh the same."""
    blocks = [(x, y, np.float32(0.5 * y / max(1, sum(map(len, side))))) for side, y in ((positive, 1), (negative, -1)) for x in side if len(x)]
    w = v = np.zeros(blocks[0][0].shape[1], "f4")
    step = 1.0 / (penalty + 2.0 * 2.0)  # rows have squared length 2 at most, weights sum to 1
    for k in range(steps):
        new = v - step * (penalty * v - 2 * sum(x.T @ (np.maximum(0, 1 - y * (x @ v)) * weight) for x, y, weight in blocks))
        v = new + k / (k + 3) * (new - w)
        w = new
    return w


class Model:
    """Families of languages and the machines that tell them apart. x: rows of features and a last column of ones,
    sorted by language; names: the languages in that order; counts: how many rows each has."""

    def __init__(self, x: np.ndarray, names: list[str], counts: list[int]):
        self.languages = names
        ends = np.cumsum([0, *counts])
        rows = [x[ends[k] : ends[k + 1]] for k in range(len(names))]
        self.families = families(np.array([r[:, :-1].mean(0) for r in rows])) if names else []
        split = lambda members: ([rows[k] for k in members], [rows[k] for k in range(len(names)) if k not in members])
        self.of_family = np.array([fit_svm(*split(m)) for m in self.families]) if len(self.families) > 1 else None
        self.pairs = [list(combinations(m, 2)) for m in self.families]
        self.of_pair = [np.array([fit_svm([rows[a]], [rows[b]]) for a, b in p]) for p in self.pairs]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """The language of each row and a score in 0..1: its family's share times its mean share of the duels."""
        if not self.languages:
            return [UNKNOWN] * len(x), np.zeros(len(x))
        x = np.hstack([x, np.ones((len(x), 1), "f4")])
        share = np.ones((len(x), 1))
        if self.of_family is not None:
            share = squash(x @ self.of_family.T)
            share /= share.sum(1, keepdims=True)
        best = share.argmax(1)
        lang, score = np.zeros(len(x), int), share.max(1)
        for k, members in enumerate(self.families):
            rows = np.flatnonzero(best == k)
            if len(members) == 1 or not rows.size:
                lang[rows] = members[0]
                continue
            won = np.zeros((rows.size, len(self.languages)))
            for (a, b), p in zip(self.pairs[k], squash(x[rows] @ self.of_pair[k].T).T):
                won[:, a] += p
                won[:, b] += 1 - p
            lang[rows] = np.array(members)[won[:, members].argmax(1)]
            score[rows] *= won.max(1) / (len(members) - 1)
        return [self.languages[k] for k in lang], np.clip(score, 0, 1).astype(float)


def squash(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-4 * margin.astype(float)))


def families(means: np.ndarray) -> list[list[int]]:
    """Groups of languages: merged by average linkage of their means' cosines, cut before the merge at which
    similarity drops most. One or two languages are one family."""
    groups = [[k] for k in range(len(means))]
    if len(groups) < 3:
        return [[k for g in groups for k in g]] if groups else []
    unit = means / np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-12)
    near = unit @ unit.T
    steps, height = [groups], []
    while len(groups) > 1:
        a, b = max(combinations(range(len(groups)), 2), key=lambda p: near[np.ix_(groups[p[0]], groups[p[1]])].mean())
        height.append(near[np.ix_(groups[a], groups[b])].mean())
        groups = [g for k, g in enumerate(groups) if k not in (a, b)] + [sorted(groups[a] + groups[b])]
        steps.append(groups)
    drop = np.diff(height)  # between one merge and the next: steps[k + 1] stands before the merge of height[k + 1]
    return sorted(steps[int(drop.argmin()) + 1])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from rows with a text that has a letter, a lang and a doc_id that isn't held out. Of each language
    it takes the rows whose hash lies under a threshold that keeps the sample within its bound."""
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row per language
    if not counts:
        return Model(np.zeros((0, 1), "f4"), [], [])
    each = max(LEAST, sample // len(counts))
    share = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, each / n))])
    drawn = usable.filter(F.pmod(F.xxhash64(F.lit("draw"), "doc_id"), F.lit(1_000_003)) < share[F.col("lang")] * 1_000_003)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(lang, quantised(features(t))) for lang, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if has_letter(t)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.binary())], names=["lang", "x"])

    rows = drawn.select("lang", F.col("text").cast("string")).mapInArrow(run, "lang string, x binary").limit(2 * each * len(counts)).toArrow()
    lang = np.array(rows.column("lang").to_pylist(), object).astype(str)
    names, found = np.unique(lang, return_counts=True)
    x = np.ones((len(lang), (1 << BITS) + 1), "f4")
    column = rows.column("x")
    for k, at in enumerate(np.argsort(lang, kind="stable")):
        x[k, :-1] = np.frombuffer(column[int(at)].as_py(), "u1")
    x[:, :-1] /= np.maximum(np.linalg.norm(x[:, :-1], axis=1, keepdims=True), 1e-12)
    return Model(x, [str(n) for n in names], found.tolist())


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Adds lang_pred and score to docs (of them, text is read). A null text and one without a letter is
    ``und`` with score 0, as is every text if the model knows no language. Repeated rows stay."""
    frame, own = renamed(docs, ["lang_pred", "score"])
    return predicted(frame, own["text"], model).select(*restored(own), "lang_pred", "score")


def predicted(frame: DataFrame, text: str, model: Model) -> DataFrame:
    """frame, none of whose columns has one of these names, with lang_pred and score of the column text."""
    shared = frame.sparkSession.sparkContext.broadcast(model)
    names = frame.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                texts = b.column(text).to_pylist()
                rows = [k for k, t in enumerate(texts) if has_letter(t)]
                lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
                if rows:
                    for k, name, p in zip(rows, *model.predict(np.stack([features(texts[k]) for k in rows]))):
                        lang[k], score[k] = name, float(p)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang), pa.array(score)], names=[*names, "lang_pred", "score"])

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields)
    return frame.mapInArrow(run, f"{kind}, lang_pred string, score double")


def identified(docs: DataFrame) -> DataFrame:
    """The rows of docs that have a language: those identified as ``und`` go."""
    frame, own = renamed(docs, [])
    return predicted(frame, own["text"], fit(docs)).filter(F.col("lang_pred") != UNKNOWN).select(*restored(own))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = fit(docs)
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES = {"op10_language_id": op10_language_id}
SQL: dict[str, str] = {}
