"""Names that clash in any case, pages whose names are their own, boxes in boxes, and whole results of two queries by hand."""

import hashlib
import struct
import time
import zlib

import pytest
from pyspark.sql import functions as F

from tarsia.llm import html, jaccard, language, media

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ADDED = {"identify": ["lang_pred", "score"], "identified": ["lang_pred", "score", "in_0"], "extract": ["text", "n_chars", "host", "region", "salt"], "with_media": ["media", "n_bytes"], "probe": ["codec", "duration", "n_samples", "keyframes", "error"], "deduplicated": ["_fp", "gone", "comp", "fp", "_id", "_set"]}


@pytest.mark.parametrize("upper", [False, True])
@pytest.mark.parametrize("name", list(ADDED))
def test_clashing_names(spark, name, upper):
    words = "the quick brown fox jumps over the lazy dog and runs away from here"
    rows = [(1, words, "en", "a", 1), (2, words, "en", "a", 1), (2, "und der hund läuft über die straße nach hause", "de", "b", 2), (None, words, "en", None, 1), (5, None, None, None, None)]
    docs = spark.createDataFrame(rows * 3, DOCS).drop("n_chars")
    if name == "extract":
        docs = docs.withColumnRenamed("text", "html").withColumn("url", F.lit("http://a.b/c"))
    frame = docs.withColumns({(c.upper() if upper else c): F.lit("mine") for c in ADDED[name]})
    if name == "identify":
        out, new = language.identify(frame, language.fit(docs)), ADDED[name]
    elif name == "identified":
        out, new = language.identified(frame), []
    elif name == "extract":
        out, new = html.extract(frame), ["text", "n_chars"]
    elif name == "with_media":
        out, new = media.with_media(frame), ADDED[name]
    elif name == "probe":
        out, new = media.probe(media.with_media(frame)), ADDED[name]
    else:
        out, new = jaccard.deduplicated(frame), []
    lost = {c.lower() for c in new} | ({"html"} if name == "extract" else set())
    before = frame.columns if name != "probe" else [*frame.columns, "n_bytes"]
    assert out.columns == [c for c in before if c.lower() not in lost] + new
    got = out.collect()
    assert len(got) == {"identified": 12, "deduplicated": 3}.get(name, 15)
    for c in (c for c in out.columns if c.lower() in map(str.lower, ADDED[name]) and c not in new):
        assert {r[out.columns.index(c)] for r in got} == {"mine"}


def test_pages_with_names_of_their_own(spark):
    """A host whose pages each have class names of their own: wrappers stay as small as a page, and time is in proportion."""
    page = lambda k: f"<html><body><div class='nav_{k}x'>Home</div><article class='a{k}x'><p class='p{k}x'>Text of page {k}</p><p>More {k * 7}</p></article><div class='f{k}x'>Foot {k % 3}</div></body></html>"

    def took(n):
        began, whole, longest = time.process_time(), None, 0
        for k in range(n):
            w = html.stream(html.parse(page(k)), [k])
            longest = max(longest, len(w))
            whole = w if whole is None else html.condensed(html.aligned(whole, w), longest)
        assert len(whole) < 2 * longest + 600
        return time.process_time() - began, whole

    took(200)
    small, large = took(1500)[0], took(6000)
    assert large[0] < 8 * small + 1
    found = html.region(large[1])
    assert html.main_text(page(3), found) == "Text of page 3\nMore 21"
    pages = spark.createDataFrame([(k, "http://x.y/", page(k)) for k in range(1200)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html.extract(pages).collect()} == {k: f"Text of page {k}\nMore {k * 7}" for k in range(1200)}


def test_boxes_in_boxes():
    data = b""
    for _ in range(3000):
        data = struct.pack(">I4s", len(data) + 8, b"moov") + data
    assert media.describe(data)[-1] == "no track"
    junk = bytearray(media.store(media.padded(b"x" * 64)))
    at = junk.index(b"stsz")
    junk[at + 8 : at + 16] = struct.pack(">II", 1, 2**32 - 1)
    assert "samples of" in media.describe(bytes(junk))[-1]


def test_media_query_on_the_whole_table(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = media.op9_media_columns(spark, sf_dir).collect()
    assert len(got) == len(docs)
    stored = {r.doc_id: bytes(r.media) for r in media.with_media(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).collect()}
    for r in got:
        raw = (docs[r.doc_id] or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (64 if not raw else 0))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert payload in stored[r.doc_id] and (r.media_bytes, r.media_sha256) == (len(stored[r.doc_id]), hashlib.sha256(stored[r.doc_id]).hexdigest())
        assert f"frames={len(payload) // 64};" in r.feature


def test_language_query_on_the_whole_table(spark, sf_dir):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = language.op10_language_id(spark, sf_dir).collect()
    known = {r.lang for r in docs.values() if r.lang}
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        text = docs[r.doc_id].text
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        assert r.lang_pred == "und" if not any(c.isalpha() for c in text or "") else r.lang_pred in known
    tested = [r for r in got if r.held_out and docs[r.doc_id].lang and r.lang_pred != "und"]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in tested) >= 0.95 * len(tested)
