"""The pipeline's stages against brute force, and all operators on clashing names, repeated rows and empty tables."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tarsia.llm import chat, html, jaccard, language, media, mixing, neighbours, packing, urlfilter, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, whole int, rest int, cut int, base int, keys string, hashes string, salt string, region string, sequence_id string, offset string"


def documents(spark):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(900)]
    rows = []
    for k in range(60):
        base = [rng.choice(words) for _ in range(rng.randint(30, 120))]
        for copy in range(rng.randint(1, 3)):
            t = list(base)
            if copy:
                t[rng.randrange(len(t))] = "other"
            rows.append((k * 10 + copy, " ".join(t), "en" if k % 3 else None, f"s{k % 5}" if k % 7 else None))
    rows += [(700, None, "en", "s1"), (701, "", "en", "s1"), (702, "12 34", None, None), (None, "a text without an id", None, "s2"), (705, "wort " * 9000, "de", "s2"), (0, rows[0][1], "en", "s0")]
    return spark.createDataFrame([(*r, len(r[1] or ""), *["clash", 1, 2, 3, 4, "c", "c", "c", "c", "c", "c"]) for r in rows], DOCS)


def by_hand(rows):
    """The rows that stay: one of each group linked over pairs of similar shingle sets, that with the smallest id."""
    sets = [frozenset(jaccard.shingle_set(r.text).tolist()) for r in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                group = [group[b] if g == group[a] else g for g in group]
    best = {}
    for r, g, s in zip(rows, group, sets):
        key = g if s else (r.doc_id, r.text)
        best[key] = min(best.get(key, r), r, key=lambda x: (x.doc_id is None, x.doc_id or 0))
    return sorted(str((r.doc_id, r.text)) for r in best.values())


def test_stages(spark):
    docs = documents(spark)
    first = corpus_pipeline.language_id(spark, docs, "").collect()
    kept = [r for r in docs.collect() if r.text and any(map(str.isalpha, r.text))]
    assert sorted(map(str, first)) == sorted(map(str, kept))
    second = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(first, docs.schema), "").collect()
    assert sorted(str((r.doc_id, r.text)) for r in second) == by_hand(first)
    third = corpus_pipeline.source_mix(spark, spark.createDataFrame(second, docs.schema), "").collect()
    times, size, of_source = {}, {}, {}
    for r in second:
        of_source.setdefault(r.source, []).append(len(r.text.split()))
    for r in third:
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
        size[r.source] = size.get(r.source, 0) + len(r.text.split())
    assert max(times.values()) <= 3 and set(map(str, third)) <= set(map(str, second))
    whole = sum(map(sum, of_source.values()))
    level = {s: [5, 2, 1][k % 3] for k, s in enumerate([*sorted(x for x in of_source if x), None])}
    target, open_ = {}, dict(level)
    while open_:
        share = (whole - sum(target.values())) / sum(open_.values())
        over = {s for s, w in open_.items() if share * w > 3 * sum(of_source[s])}
        target |= {s: 3 * sum(of_source[s]) if over else share * open_[s] for s in over or open_}
        open_ = {s: w for s, w in open_.items() if over and s not in over}
    for s, words in of_source.items():
        assert abs(size.get(s, 0) - target[s]) <= max(words) / 2 + 1e-6
    last = corpus_pipeline.packed_sequences(spark, spark.createDataFrame(third, docs.schema), "").collect()
    assert_packed(last, third)


def assert_packed(pieces, docs):
    """Every piece of every document with its place, by the tokenizers library."""
    from tokenizers import Tokenizer

    from tarsia.llm.common import tokenizer_path

    whole = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    want = []
    for d in docs:
        ids = np.array([*whole.encode(d.text or "", add_special_tokens=False).ids, 0], "<u4")
        ends = [*range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        for k, (s, e) in enumerate(zip([0, *ends], ends)):
            want.append((str(d.doc_id), k, s, e - s, zlib.crc32(ids[s:e].tobytes())))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in pieces) == sorted(want)
    at = {}
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values()) <= 2048 and len(at) <= -(-sum(at.values()) // 2048) * 1.02 + 1


def test_packing_whole_table(spark, sf_dir):
    assert_packed(packing.op1_best_fit_packing(spark, sf_dir).collect(), spark.read.parquet(f"{sf_dir}/documents.parquet").collect())


def test_run(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    known = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert rows and {r.doc_id for r in rows} <= known


def test_empty_documents_through_all_stages(spark):
    docs = documents(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0


OPERATORS = {
    "packing": lambda d: packing.pack(packing.token_pieces(d).withColumns({"sequence_id": F.lit("c"), "offset": F.lit("c"), "Part": F.lit(1), "_rank": F.lit(2)})),
    "chat": lambda d: chat.maximal_conversations(d.select(F.col("doc_id").alias("conv_id"), F.lit(1).cast("long").alias("turn"), F.lit("user").alias("role"), "text", "size", "whole", "base")),
    "jaccard": jaccard.deduplicated,
    "html": lambda d: html.extract(d.select(F.col("doc_id").alias("page_id"), F.lit("http://h/").alias("url"), F.col("text").alias("html"), "salt", "region", "size", F.lit("c").alias("host"))),
    "urls": lambda d: urlfilter.judge(d.select(F.concat(F.lit("http://a.com/en/"), "doc_id").alias("url"), "keys", "hashes", F.lit("c").alias("rule")), d.sparkSession.createDataFrame(urlfilter.RULES, "host string, path string, verdict string")),
    "mixing": lambda d: mixing.mix(d),
    "media": lambda d: media.with_media(d.withColumn("media", F.lit("c"))),
    "language": lambda d: language.identify(d.withColumn("score", F.lit("c")), language.fit(d)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_repeated_and_empty(spark, name):
    docs = documents(spark)
    run = OPERATORS[name]
    out = run(docs.union(docs.limit(3)))
    assert len(out.columns) == len(set(c.lower() for c in out.columns)) and out.count() > 0
    assert run(docs.limit(0)).count() == 0


def test_url_odd_rows(spark):
    rows = [(1, None), (2, "no scheme"), (3, "http://EXAMPLE.com/en/7x"), (4, "x://a.b.net/de/?q"), (5, "http://xcom/en/"), (6, "http://example.net/de/81#f"), (6, "http://example.net/de/81#f"), (7, "http://com")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    rules = spark.createDataFrame(urlfilter.RULES, "host string, path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(pages, rules).collect()}
    assert got == {
        1: ("", "", None, "allow"),
        2: ("", "", None, "allow"),
        3: ("example.com", "/en/7x", "example.com/en/7", "allow"),
        4: ("a.b.net", "/de/", "net/de/", "allow"),
        5: ("xcom", "/en/", None, "allow"),
        6: ("example.net", "/de/81", "example.net/de/8", "block"),
        7: ("com", "", None, "allow"),
    }
    equal = spark.createDataFrame([("a.b", "/", "block"), ("b", "/xx", "allow")], "host string, path string, verdict string")
    assert [r.rule for r in urlfilter.judge(spark.createDataFrame([(1, "http://a.b/xx")], "page_id long, url string"), equal).collect()] == ["a.b/"]


def test_language_families(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language.fit(docs)
    assert len(model.languages) == 4 and 2 <= len(model.families) < 4 and model.of_family is not None
    x = np.stack([language.features(r.text) for r in docs.filter("text is not null").limit(200).collect()])
    lang, score = model.predict(x)
    assert language.families(np.eye(4)[[0, 0, 1, 1]] + 0.01) == [[0, 1], [2, 3]]
    model.of_family = None  # without its first step all rows fall to one family
    assert (model.predict(x)[1] != score).any()
    assert len(set(lang)) > 1 and ((0 <= score) & (score <= 1)).all()


def test_neighbours_lengths_and_repeated_ids(spark):
    rows = [(k, [float(k), 1.0]) for k in range(1, 30)] + [(100, [1.0, 2.0, 3.0]), (200, [2.5, 1.0]), (7, [7.0, 1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = neighbours.search(v, v.filter("vec_id % 100 = 0"), top=4).collect()
    assert [(r.query_id, r.vec_id) for r in sorted(got, key=lambda r: (r.query_id, r.rank))] == [(200, 2), (200, 3), (200, 1), (200, 4)]


def test_zip64_directory():
    """A directory whose sizes, offset and counts stand in ZIP64 records only."""
    import struct

    class File:
        def __init__(self, data):
            self.data = data

        def size(self):
            return len(self.data)

        def read_at(self, n, at):
            return self.data[at : at + n]

    data, name, big = b"abc" * 50, b"a.bin", 0xFFFFFFFF
    crc = zlib.crc32(data)
    local = struct.pack("<4s5H3I2H", b"PK\3\4", 45, 0, 0, 0, 0, crc, big, big, len(name), 20) + name + struct.pack("<2H2Q", 1, 16, len(data), len(data))
    extra = struct.pack("<2H3Q", 1, 24, len(data), len(data), 0)
    central = struct.pack("<4s6H3I5H2I", b"PK\1\2", 45, 45, 0, 0, 0, 0, crc, big, big, len(name), len(extra), 0, 0, 0, 0, big) + name + extra
    start = len(local) + len(data)
    end64 = struct.pack("<4sQ2H2I4Q", b"PK\6\6", 44, 45, 45, 0, 0, 1, 1, len(central), start)
    locator = struct.pack("<4sIQI", b"PK\6\7", 0, start + len(central), 1)
    end = struct.pack("<4s4H2IH", b"PK\5\6", 0, 0, 0xFFFF, 0xFFFF, big, big, 0)
    file = warc.Window(File(local + data + central + end64 + locator + end))
    at, n = warc.stored_at(file, warc.central_directory(file)["a.bin"])
    assert file.read(at, n) == data
