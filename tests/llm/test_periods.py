"""Periodic runs against brute force, on small texts and on the whole table."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarsia.llm import periods

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(w):
    """Maximal stretches of each period, without those that have a smaller one."""
    out, n = [], len(w)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            s, e = i, j + q
            if e - s >= max(6, 4 * q) and not any(all(w[k] == w[k + p] for k in range(s, e - p)) for p in range(1, q)):
                out.append((s, e - s, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(doc_id, text):
    w = WORD.findall(text or "")
    if doc_id is None or not w:
        return w
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


@pytest.mark.parametrize("letters", [1, 2, 3, 9])
def test_runs_of_random_words(letters):
    draw = random.Random(letters)
    texts = []
    for _ in range(250):
        t = [draw.randrange(letters) for _ in range(draw.randrange(40))]
        for _ in range(draw.randrange(3)):  # a stretch again and again, some nested in another
            s = draw.randrange(len(t) + 1)
            t = t[:s] + t[s : s + draw.randrange(1, 9)] * draw.randrange(1, 12) + t[s:]
        texts.append(t[:400])
    assert periods.runs_of([np.array(t, np.int64) for t in texts], letters) == [brute(t) for t in texts]


def test_extensions_of_the_grammar():
    draw = random.Random(5)
    for letters in (1, 2, 5):
        texts = [np.array([draw.randrange(letters) for _ in range(draw.randrange(1, 300))]) for _ in range(4)] + [np.zeros(500, np.int64)]
        words, _ = periods.side_by_side(texts, letters)
        grammar = periods.Grammar(words, letters)
        a = np.array([draw.randrange(len(words)) for _ in range(400)])
        b = np.array([(x + draw.randrange(1, len(words))) % len(words) for x in a])
        right, left = grammar.extension(a, b, True), grammar.extension(a, b, False)
        for x, y, r, s in zip(a, b, right, left):
            want = next(k for k in range(len(words)) if max(x, y) + k >= len(words) or words[x + k] != words[y + k])
            back = next(k for k in range(len(words)) if min(x, y) - k < 0 or words[x - k] != words[y - k])
            assert (r, s) == (want, back)


def test_long_texts_in_time():
    """Blocks of one word, two words in turn and random words of few letters: 200,000 words each."""
    draw = np.random.default_rng(3)
    same, turn, two = np.zeros(200_000, np.int64), np.arange(200_000) % 2, draw.integers(0, 2, 200_000)
    a, b, c, d = periods.runs_of([same, turn, two, np.concatenate([two[:50_000]] * 4)], 2)
    assert a == [(0, 200_000, 1)] and b == [(0, 200_000, 2)]
    assert all(length >= max(6, 4 * q) for _, length, q in c) and (0, 200_000, 50_000) in d


def expected(doc_id, text):
    w = planted(doc_id, text)
    runs = brute(w)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (
        len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)),
        sha(" ".join(x for i, x in enumerate(w) if i not in gone)),
    )


COLUMNS = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query_on_the_whole_table(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = periods.op11_periodic_runs(spark, sf_dir).collect()
    assert len(got) == len(docs) and sum(r.n_runs > 0 for r in got) > 5
    for r in got:
        assert tuple(r[c] for c in COLUMNS) == expected(r.doc_id, docs[r.doc_id]), r.doc_id


def test_query_on_odd_rows(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, "\x0b \t"), (3, "la " * 9000), (3, "la " * 9000), (None, "x y " * 3 + "x y x y"), (None, None), (5, "a a " * 7 + "ü")]
    rows += [(k, "eins zwei drei vier fünf sechs sieben acht neun zehn") for k in range(10, 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((str(r.doc_id), str(tuple(r[c] for c in COLUMNS))) for r in periods.op11_periodic_runs(spark, str(tmp_path)).collect())
    assert got == sorted((str(i), str(expected(i, t) if len(t or "") < 9000 or zlib.crc32(str(i).encode()) % 10 == 0 else (1, 0, 9000, 1, 9000000, hashlib.sha256(b"0,9000,1\n").hexdigest(), hashlib.sha256(b"la").hexdigest()))) for i, t in rows)
    clash = df.withColumn("Runs", F.lit(1)).withColumn("COLLAPSED", F.lit(2)).withColumn("Extra", F.lit("e"))
    out = periods.periodic_runs(clash)
    assert out.columns == ["doc_id", "text", "Extra", "runs", "collapsed"] and out.count() == len(rows)
    assert periods.periodic_runs(df.limit(0)).count() == 0
