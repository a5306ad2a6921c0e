"""Training-data operators against SQL or brute force on small inputs."""

import hashlib
import io
import random
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarsia.llm import chat, html, jaccard, language, media, mixing, neighbours, packing, urlfilter, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name", ["op2_chat_formatting", "op3_warc_archives", "op5_ngram_jaccard_join", "op7_url_filters", "op8_source_mixing"])
def test_same_as_sql(same, name):
    same(name)


def odd_docs(spark):
    long = "wort " * 5000
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, long, "en", "a", len(long)), (3, long, "en", "a", len(long)), (4, "123 456", None, "b", 7), (None, "some words that have no id", "en", None, 1)]
    return spark.createDataFrame(rows, DOCS).withColumn("size", F.lit("clash")).withColumn("media", F.lit("clash"))


def test_ids_equal_those_of_the_json_vocabulary(spark, sf_dir):
    from tokenizers import Tokenizer

    from tarsia.llm.common import tokenizer_path

    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()] + ["", " \n", "ÄÖ 日本 \x00"]
    a, b = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")), packing.encoder(tokenizer_path(packing.VOCABULARY))
    assert [a.encode(t, add_special_tokens=False).ids for t in texts] == [b.encode_ordinary(t) for t in texts]


def test_ids_of_added_tokens(spark):
    from tokenizers import Tokenizer

    from tarsia.llm.common import tokenizer_path

    whole, encode = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")), packing.ids_of(tokenizer_path(packing.VOCABULARY))
    texts = ["hello <|endoftext|> world", "<|endoftext|>", "a  <|endoftext|><|endoftext|>\n\n b<|endoftext|", "<|ENDOFTEXT|> x", " \n", "", "ÄÖ 日本 \x00"]
    assert [encode(t) for t in texts] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert encode(texts[0]) == [31373, 220, 50256, 995]
    (row,) = packing.pack_documents(spark.createDataFrame([(1, texts[0])], "doc_id long, text string")).collect()
    assert row.length == 5 and row.ids_crc32 == zlib.crc32(np.array([31373, 220, 50256, 995, 0], "<u4").tobytes())


def test_ids_of_long_white_space(spark):
    from tokenizers import Tokenizer

    from tarsia.llm.common import tokenizer_path

    whole, encode = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")), packing.ids_of(tokenizer_path(packing.VOCABULARY))
    for text in ("x" + " " * 1_100_000 + "a", "\n" * 1_100_000, "\u3000" * 1_100_000 + "a b", ("a" + " " * 99_999) * 12):
        assert encode(text) == whole.encode(text, add_special_tokens=False).ids
    rows = packing.pack_documents(spark.createDataFrame([(1, " " * 1_100_000 + "a"), (2, "b")], "doc_id long, text string")).collect()
    assert sum(r.length for r in rows if r.doc_id == 1) == 1_100_001


def test_packing(spark, sf_dir):
    rows = packing.op1_best_fit_packing(spark, sf_dir).collect()
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in rows)
    assert len(held) <= -(-total // 2048) * 1.01 + 1


def test_packing_odd_rows(spark):
    rows = packing.pack_documents(odd_docs(spark)).collect()
    assert sorted(r.length for r in rows if r.doc_id in (1, 2)) == [1, 1]
    assert all(r.ids_crc32 == zlib.crc32(bytes(4)) for r in rows if r.doc_id == 1)
    assert packing.pack_documents(odd_docs(spark).limit(0)).count() == 0
    packed = packing.pack(packing.token_pieces(odd_docs(spark)))
    assert max(len(r.ids) for r in packing.sequences(packed).collect()) <= 2048


def test_plan_uses_each_length_and_is_tight():
    rng = random.Random(3)
    counts = {}
    for _ in range(3000):
        n = rng.randint(1, 64)
        counts[n] = counts.get(n, 0) + 1
    plan, used = packing.plan_packing(counts, 64), {}
    for lengths, times in plan:
        assert sum(lengths) <= 64
        for n in lengths:
            used[n] = used.get(n, 0) + times
    assert used == counts
    room = []  # best-fit decreasing, piece by piece
    for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        k = min((k for k, r in enumerate(room) if r >= n), key=lambda k: room[k], default=None)
        if k is None:
            room.append(64 - n)
        else:
            room[k] -= n
    assert sum(t for _, t in plan) <= len(room) + 1


def test_jaccard_brute_force(spark):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(400)]
    base = [rng.choice(words) for _ in range(60)]
    texts = [None, "", "one", "one", "One two", " ".join(base)]
    for _ in range(40):
        t = list(base)
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(60)] = rng.choice(words)
        texts.append(" ".join(t))
    passage = " ".join(rng.choice(words) for _ in range(50))
    texts += [passage + " " + " ".join(rng.choice(words) for _ in range(rng.randint(5, 60))) for _ in range(90)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicate_groups(df).collect()}
    sets = [set(jaccard.shingle_set(t).tolist()) for t in texts]
    comp = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                lo, hi = sorted((comp[a], comp[b]))
                comp = [lo if c == hi else c for c in comp]
    assert got == dict(enumerate(comp))


def test_jaccard_odd_rows(spark):
    out = jaccard.near_duplicate_groups(odd_docs(spark)).collect()
    assert len(out) == 6 and {r.component_id for r in out if r.doc_id == 3} == {3}
    assert jaccard.near_duplicate_groups(odd_docs(spark).limit(0)).count() == 0


def test_deduplicated_repeated_and_null_ids(spark):
    x, y, z = ("one two three four five six seven eight", "nothing like any of the others is said in here", "a third text that stands all alone among these rows")
    rows = [(3, x), (5, x), (5, y), (5, y), (None, z), (None, z), (None, x), (7, ""), (7, ""), (None, None)]
    got = jaccard.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, ((r.doc_id, r.text) for r in got))) == sorted(map(str, [(3, x), (5, y), (None, z), (7, ""), (None, None)]))
    plain = jaccard.deduplicated(spark.createDataFrame([(3, x), (5, x), (6, y), (7, ""), (8, "")], "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in plain) == [3, 6, 7, 8]


def test_mixing_odd_rows(spark):
    out = mixing.mix(odd_docs(spark)).collect()
    assert len(out) == 6 and all(r["copies"] <= 3 for r in out)
    assert mixing.mix(odd_docs(spark).limit(0)).count() == 0


def test_mixing_buckets_of_texts_without_blanks(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), F.repeat(F.lit("語"), 600).alias("text"))
    most = mixing.keyed(docs).groupBy("_bucket").count().agg(F.max("count")).first()[0]
    assert most < 40


def test_media_round_trip(spark):
    for raw in (b"", b"a", bytes(range(64)), bytes(70_000)):
        payload = media.padded(raw)
        data = media.store(payload)
        (track,) = media.tracks(memoryview(data))
        offset, size, key = media.samples(memoryview(data), track)
        assert b"".join(data[o : o + n] for o, n in zip(offset, size)) == payload and key.all()
    assert media.describe(b"junk")[-1] and media.describe(None) == (None,) * 5
    out = media.digests(media.with_media(odd_docs(spark)).select("doc_id", "n_bytes", "media")).collect()
    assert {r.payload_sha256 for r in out if r.doc_id in (1, 2)} == {hashlib.sha256(bytes(64)).hexdigest()}
    assert media.probe(media.with_media(odd_docs(spark))).count() == 6


def test_zip64_and_comment():
    class File:
        def __init__(self, data):
            self.data = data

        def size(self):
            return len(self.data)

        def read_at(self, n, at):
            return self.data[at : at + n]

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.comment = b"PK\5\6 in a comment"
        with z.open("a.bin", "w", force_zip64=True) as f:
            f.write(b"abc" * 50)
    file = warc.Window(File(out.getvalue()))
    at, n = warc.stored_at(file, warc.central_directory(file)["a.bin"])
    assert file.read(at, n) == b"abc" * 50


def test_warc_odd_rows(spark, tmp_path):
    rows = [(1, None, None), (2, "http://a/ b\n", "x" * 200), (3, "http://a", "x" * 200), (None, "http://c", "x" * 200), (4, "http://d", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    archives = warc.write_archives(pages, f"file://{tmp_path}/w")
    got = {r.page_id: r for r in warc.read_records(warc.locate(archives)).collect()}
    assert got[2].record_type == "response" and got[3].refers_to == 2 and got[1].payload_bytes == 0 and got[3].payload_bytes == 200
    assert warc.read_records(warc.locate(warc.write_archives(pages.limit(0), f"file://{tmp_path}/e"))).count() == 0


def test_neighbours_recall(spark, sf_dir):
    rows = neighbours.op4_nearest_neighbours(spark, sf_dir).collect()
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").toPandas()
    x, ids = np.stack(e.embedding).astype(float), e.vec_id.to_numpy()
    found = {}
    for r in rows:
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = []
    for q in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        hits.append(len(found[ids[q]] & set(ids[np.lexsort((ids, d))[:10]])) / 10)
    assert np.mean(hits) >= 0.9


def test_neighbours_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [0.0, 2.0]), (None, [1.0, 1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r.rank, r.vec_id) for r in neighbours.search(v, v.filter("vec_id = 0")).orderBy("rank").collect()]
    assert got == [(1, 1), (2, 6)]
    assert neighbours.search(v.limit(0), v.limit(0)).count() == 0


def test_html_without_article(spark):
    page = '<html><body><div class="menu"><a href=x>Home</a></div><div class=content><h2>{0}</h2><p>Text of {0} &amp; more<p>second {0}</div><div id="comments"><p>me too</p></div><form>x</form></body></html>'
    rows = [(k, f"http://h/{k}", page.format(f"page{k}")) for k in range(4)] + [(9, None, None), (10, "http://h/10", "")]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[2] == "page2\nText of page2 & more\nsecond page2" and got[9] == "" and got[10] == ""


def texts_of(spark, pages):
    rows = [(k, f"http://h/{k}", p) for k, p in enumerate(pages)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    return [got[k] for k in range(len(pages))]


def test_html_same_as_plain_reading(spark, sf_dir):
    """All given pages keep their article in one element; a few substitutions read it."""
    import html as entities
    import re

    got = {r.page_id: r for r in html.op6_html_extraction(spark, sf_dir).collect()}
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        found = re.search(r"(?s)<article>(.*?)</article>", r.html or "")
        plain = re.sub(r"(?s)<(script|style).*?</\1>|<!--.*?-->", "", found[1] if found else "")
        parts = re.split(r"</?(?:p|h\d|div|ul|li|article)\b[^>]*>", plain)
        parts = [" ".join(entities.unescape(re.sub(r"<br[^>]*>", " ", x) if "<" in x else x).split()) for x in parts]
        parts = [" ".join(re.sub(r"<[^>]*>", "", x).split()) for x in parts]
        want = "\n".join(x for x in parts if x)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)


@pytest.mark.parametrize(
    "page",
    [
        "<div class=top>The site of {0} tales</div><div class=box><h2>T{1}</h2><p>The body of number {1} goes on.</p></div><div class=end>All rights</div>",
        "<dl><dt>Home of {0}</dt><dd><h2>T{1}</h2><p>The body of number {1} goes on.</p></dd><dt>Archive</dt></dl>",
        "<article>Look here</article><section><h2>T{1}</h2><p>The body of number {1} goes on.</p></section><article>Old hat</article>",
    ],
)
def test_html_wrapper_decides(spark, page):
    pages = [f"<html><body>{page.format('ten', k)}</body></html>" for k in range(10)]
    want = [f"T{k}\nThe body of number {k} goes on." for k in range(10)]
    assert texts_of(spark, pages) == want
    assert all(html.main_text(p, None) != w for p, w in zip(pages, want))


def test_html_streams_align():
    """Random balanced streams: what two wrappers make is balanced, and has every text of either or a slot for it."""
    rng = random.Random(4)

    def markup(depth):
        return "".join(f"<{t}>{markup(depth - 1) if depth else ''}{rng.choice(['x', 'y', ''])}</{t}>" for t in rng.choices(["div", "section", "ul", "p" if not depth else "div"], k=rng.randint(0, 4)))

    for _ in range(300):
        a, b = (html.stream(html.parse(f"<body>{markup(3)}</body>"), [k]) for k in (1, 2))
        w = html.aligned(a, b)
        assert html.group_ends(w)[0] == len(w) and w[0][html.PAGES] == 2
        texts = {x[html.TEXT] for x in w if x[html.KIND] == html.WORDS}
        assert html.VARIES in texts or texts >= {x[html.TEXT] for s in (a, b) for x in s if x[html.KIND] == html.WORDS}
        again = html.aligned(w, b)
        assert sum(x[html.CHARS] for x in again) == sum(x[html.CHARS] for s in (a, b, b) for x in s)
        assert len(html.aligned(a, a)) == len(a)


def test_html_odd_rows(spark):
    rows = [(1, "http://h/1", None, "clash"), (1, "http://h/1", None, "clash"), (2, None, "<p>" + "word " * 50_000, "clash"), (None, "no host", "<p>x</p>", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, salt string").withColumn("region", F.lit("c"))
    got = sorted((str(r.page_id), r.n_chars, str(r.salt)) for r in html.extract(pages).collect())
    assert got == [("1", 0, "clash"), ("1", 0, "clash"), ("2", 249_999, "clash"), ("None", 1, "None")]
    assert html.extract(pages.limit(0)).count() == 0


def test_html_copies_and_shared_headings(spark):
    page = "<html><body><div class=top>The site</div><div class=content><h2>{0}</h2><p>{1}</p></div></body></html>"
    copy = page.format("T", "Body")
    assert texts_of(spark, [copy] * 5) == ["The site\nT\nBody"] * 5
    differ = [page.format("Report" if k < 4 else f"Title {k}", f"The long body of page number {k}") for k in range(12)]
    got = texts_of(spark, [*differ, copy, copy, copy])
    assert got[0] == "Report\nThe long body of page number 0" and got[12:] == ["T\nBody"] * 3
    near = [f"<html><body><div><h2>{k}</h2></div><div><p>One and the same long article.</p></div></body></html>" for k in range(4)]
    assert texts_of(spark, near) == [f"{k}\nOne and the same long article." for k in range(4)]


def test_html_wrappers_named_by_hints():
    body = "<h2>Title</h2><p>The body of an article that is long enough.</p>"
    want = "Title\nThe body of an article that is long enough."
    for page in (
        f"<div class='has-sidebar'><nav>Home</nav><article>{body}</article></div>",
        f"<div id='page-with-menu'><article>{body}</article></div>",
        f"<div class=banner><article>{body}</article></div><div class=related><article>Other</article></div>",
        f"<form action=x><nav>Home</nav>{body}</form>",
        f"<article><section class='related-work'>{body}</section><div class='site-footer'>x</div></article>",
        f"<article>{body}</article><aside><article>Teaser</article></aside>",
        f"<main>{body}<div class=comments><p>{'me too ' * 40}</p></div></main>",
        f"<div class='cookie-banner'>We bake</div><div>{body}</div>",
    ):
        assert html.main_text(f"<html><body>{page}</body></html>", None) == want, page


@pytest.mark.parametrize("tag", sorted(html.RAW))
def test_html_unclosed_raw_elements(tag):
    assert "after" in html.main_text(f"<article><p>before<{tag}><p>after</article>", None)
    assert html.main_text(f"<article><p>before</p><{tag}>\"if a<b</{tag.upper()} ><p>after</p></article>", None) == "before\nafter"


def test_html_deep_nesting(spark):
    pages = [f"<html><body><p>first {k}</p>" + f"<{t}>" * 5000 + f"<p>deep {t}</p>" + "".join(f"<{t}>x{i} " for i in range(50)) for k, t in enumerate(("div", "font", "span", "ul", "blockquote"))]
    pages.append("<div>" * 100_000 + "<nav>menu</nav><article><p>one<p>two</article>" + "</div>" * 100_000 + "<p>after")
    pages.append("<div>" * 400 + "one<div>two</div>three" + "</div>" * 399 + "<p>four</div>")
    got = texts_of(spark, pages)
    for k, tag in enumerate(("div", "font", "span", "ul", "blockquote")):
        assert html.main_text(pages[k], None).split() == ["first", str(k), "deep", tag, *(f"x{i}" for i in range(50))]
        assert got[k]
    assert got[5] == "one\ntwo" and html.main_text(pages[6], None) == "one\ntwo\nthree\nfour"


def test_cascade_is_exact(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("h"), "id")
    levels = urlfilter.cascade(keys.filter("id % 50 = 0"), keys)
    rows = keys.collect()
    got = urlfilter.member(levels, np.array([r.h for r in rows]))
    assert [bool(g) for g in got] == [r.id % 50 == 0 for r in rows]


def test_language_held_out(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = language.op10_language_id(spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null")
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] >= 0.95
    odd = language.identify(odd_docs(spark), language.fit(docs)).collect()
    assert [r.lang_pred for r in odd if r.doc_id in (1, 2, 4)] == ["und"] * 3


def test_chat_odd_rows(spark):
    rows = [(1, 1, "user", "hi"), (2, 1, "user", "hi"), (2, 2, None, None), (3, 1, "user", "hi"), (3, 2, None, None), (None, 1, "user", "else")]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.maximal_conversations(t).collect()
    assert sorted((str(r.conv_id), r.n_copies) for r in got) == [("2", 2), ("None", 1)]


def test_url_rules_in_shards(spark, sf_dir):
    """A list split into shards, and levels sized for a far larger universe, give the same rows as one small cascade."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url").unionByName(spark.createDataFrame([(-1, None), (-2, "x"), (-3, "s://a.example.com/en/7")], "page_id long, url string"))
    rules = spark.createDataFrame(urlfilter.RULES, "host string, path string, verdict string")
    rows = lambda d: sorted(map(str, d.collect()))
    assert urlfilter.shards_of(3, 1000, 1) > 2 and urlfilter.bits_a_key(5, 5 << 30) > 40
    assert rows(urlfilter.judge(pages, rules)) == rows(urlfilter.judge(pages, rules, max_bytes=1))
    keys = spark.range(4000).select(F.xxhash64("id").alias("h"), "id")
    levels = urlfilter.cascade(keys.filter("id % 400 = 0"), keys, 1 << 30)
    got = keys.sort("id").toPandas()
    assert (urlfilter.member(levels, got.h.to_numpy()) == (got.id % 400 == 0)).all()
