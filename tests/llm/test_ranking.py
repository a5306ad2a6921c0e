"""Ranked search against SQL and against scoring every document."""

import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tarsia.llm import ranking

TERM = re.compile(ranking.TERM)
FOLD = str.maketrans(ranking.UPPER, ranking.LOWER)


def brute(docs, items, top=10):
    parts = [(i, Counter(TERM.findall((t or "").translate(FOLD)))) for i, t in docs]
    parts = [(i, c) for i, c in parts if c]
    n, total = len(parts), sum(sum(c.values()) for _, c in parts)
    df = Counter(t for _, c in parts for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in parts:
            m = 10 + 90 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(TERM.findall((text or "").translate(FOLD))) if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(scores)[:top])]
    return sorted(map(str, out))


def got(frame):
    return sorted(str((r.item_id, r["rank"], r.doc_id, r.score)) for r in frame.collect())


def test_same_as_sql(same):
    same("op13_ranked_search")


def test_whole_tables_against_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert got(ranking.op13_ranked_search(spark, sf_dir)) == brute(docs, items)


def test_odd_rows(spark, monkeypatch):
    draw = random.Random(2)
    words = "Alpha beta GAMMA delta ÄPFEL äpfel 日本 x1 B2 zeta".split()
    docs = [(k, " ".join(draw.choices(words, k=draw.randrange(1, 9)))) for k in range(60)]
    docs += [(1, None), (2, ""), (3, "-- ..."), (None, "alpha-beta"), (None, "alpha-beta"), (7, "Zeta " * 30_000), (7, "Zeta " * 30_000)]
    docs += [(100 + k, "alpha BETA") for k in range(25)]  # ties
    items = [(1, "alpha beta"), (1, "alpha beta"), (2, None), (3, "--"), (4, "unseen"), (None, "zeta x1 Äpfel"), (5, " ".join(words)), (6, "gamma\x00delta")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("Score", F.lit(1)).withColumn("item_id", F.lit("x"))
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("RANK", F.lit(1))
    assert got(ranking.search(frame, asked)) == brute(docs, items)
    assert got(ranking.search(frame, asked, 3)) == brute(docs, items, 3)
    monkeypatch.setattr(ranking, "TERMS_AT_ONCE", 4)  # several blocks of items
    assert got(ranking.search(frame, asked)) == brute(docs, items)
    assert ranking.search(frame.limit(0), asked).count() == 0 == ranking.search(frame, asked.limit(0)).count()


def vectors(draw, n, terms):
    """Documents of a few topics, and of copies."""
    rows = []
    for _ in range(n):
        topic = draw.integers(0, 12)
        own = np.unique(np.concatenate([topic * terms // 12 + draw.integers(0, terms // 12, draw.integers(1, 20)), draw.integers(0, terms, 3)]))
        rows += [own] * int(draw.choice([1, 1, 1, 4]))
    rows = rows[:n]
    ptr = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    term = np.concatenate(rows)
    return ptr, term, draw.integers(1, 10**6, len(term))


def test_tree_is_exact_and_prunes():
    draw = np.random.default_rng(4)
    ptr, term, impact = vectors(draw, 5000, 600)
    weight = draw.integers(0, 9000, 600)
    ids = draw.permutation(5000).tolist()
    tree = ranking.Tree(ids, ptr, term, impact, np.sqrt(weight))
    leaves, read = sum(left < 0 for left, *_ in tree.nodes), 0
    whole = np.zeros((5000, 600), np.int64)
    whole[np.repeat(np.arange(5000), np.diff(ptr)), term] = impact
    for _ in range(40):
        q = np.unique(draw.integers(0, 50, 8) + 50 * draw.integers(0, 12))
        score = whole[:, q] @ weight[q]
        best = []
        read += tree.search(q, weight, best, 10)
        want = sorted(((int(s), True, -i) for s, i in zip(score, ids) if s > 0), reverse=True)[:10]
        assert sorted(best, reverse=True) == want
        bound, place = tree.bounds(q), {i: k for k, i in enumerate(ids)}
        for k, (_, _, a, b) in enumerate(tree.nodes):
            assert bound[k] >= max(score[place[i]] for i in tree.ids[a:b])
    assert read < 0.5 * 40 * leaves
