"""Personal data: base spans against Python's patterns on the whole table, added spans on planted texts."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarsia.llm import private

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if k % 2 == 0 else x * 2 - 9 * (x > 4) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0


def holds(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    return kind == "email" or (9 <= len(d) <= 15 if kind == "phone" else 12 <= len(d) <= 19 and luhn(d))


def base(text):
    order = list(BASE)
    found = [(m.start(), order.index(k), m.end()) for k, p in BASE.items() if k != "email" or "@" in (text or "") for m in re.finditer(p, text or "") if holds(k, m[0])]
    return [(s, e, order[k]) for s, k, e in sorted(found)]


def line(spans):
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def card(draw, n=16):
    d = "".join(draw.choices("0123456789", k=n - 1))
    return next(d + x for x in "0123456789" if luhn(d + x))


def no_card(draw, n=16):
    d = card(draw, n)
    return d[:-1] + str((int(d[-1]) + 1) % 10)


ODD = [
    None, "", "a@b.com_c@d.com", "a@b@c.de x@y", "x@y.z.", "@a.b", ".@a.b-.c%d@e.f.g@h.i", "ü1@ö.de é.x@y.de", "1.2.3.4.5.6.7.8 1.2.3.256 001.02.3.4 1.2.3.00000255 9999999999999999999.1.1.1",
    "0000 0000-0000 0000 0", "4111 1111-1111 1111", "4111  1111 1111 1111", "+1 (377) 555-0271 2390409500648960", "+123456789012345 +1234567890123456 +12345678 + 1 +1  ++12 345 678 9.", "+484516811440 1 2 3 4 5 6 7",
    "𝔸𝔹 a@b.de 𝔸 +49 30 1234567", "a" * 50_000 + "@" + "b." * 50_000, "1-" * 60_000, "1." * 60_000, "+1 " * 20_000, " " * 100_000 + "1", "a@" * 40_000,
]


def test_base_spans_of_odd_texts(spark):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(None, "a@b.de"), (None, "a@b.de")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("Spans", F.lit(1)).withColumn("fold", F.lit("f")).withColumn("found", F.lit("g"))
    out = private.personal_spans(frame)
    assert out.columns == ["doc_id", "text", "fold", "found", "spans"]
    got = sorted((str(r.doc_id), line((s.start, s.end, s.kind) for s in r.spans if s.base)) for r in out.collect())
    assert got == sorted((str(i), line(base(t))) for i, t in rows)
    assert private.personal_spans(frame.limit(0)).count() == 0


def test_query_on_the_whole_table(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = private.op12_personal_data(spark, sf_dir).collect()
    assert len(got) == len(docs)
    for r in got:
        want = base(docs[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for *_, k in want) for kind in BASE]
        assert r.base_sha256 == hashlib.sha256(line(want).encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert set(line([s]) for s in want) <= set(spans)
        keys = [(int(s), list(BASE).index(k)) for k, s, _ in (x.split(":") for x in spans)]
        assert keys == sorted(keys)


@pytest.fixture(scope="module")
def planted(spark):
    """Texts with personal data and with numbers that are none, and what is to be added to the base spans."""
    draw = random.Random(9)
    word = lambda: "".join(draw.choices("abdeilnorst", k=draw.randrange(2, 9)))
    ip = lambda: ".".join(str(draw.randrange(256)) for _ in range(4))
    phone = lambda: f"+{draw.randrange(1, 99)} ({draw.randrange(100, 1000)}) 555-{draw.randrange(1000, 10000)}"
    mail = lambda: f"{word()}{draw.randrange(99)}@mail{draw.randrange(9)}.example.com"
    hexes = lambda: '"' + "".join(draw.choices("0123456789abcdef", k=40)) + '"'
    plain = [card, no_card]
    rows, more = [], {}
    for k in range(1200):
        parts = [word() for _ in range(draw.randrange(5, 40))]
        for _ in range(draw.randrange(3)):
            new = draw.choice([ip, phone, mail, hexes, lambda: draw.choice(plain)(draw), lambda: f"{draw.randrange(256)}.{draw.randrange(300, 999)}.1.2"])()
            parts.insert(draw.randrange(len(parts)), new)
        text, extra = " ; ".join(parts), []
        if k % 40 == 0:  # two numbers side by side, one a card
            extra, text = [("card", c := card(draw))], f"{text} ; {no_card(draw)} {c} ; {word()}"
        elif k % 40 == 1:
            extra, text = [("card", c := card(draw)), ("phone", p := phone())], f"{text} ; {p} {c} ; {word()}"
        elif k % 40 == 2:
            extra, text = [("email", m := mail().replace("@", " [at] ").replace(".", " [dot] "))], f"{text} ; {m} ; {word()}"
        elif k % 40 == 3:
            extra, text = [("ip", i := ip().replace(".", "[.]"))], f"{text} ; {i} ; {word()}"
        elif k % 40 == 4:
            text = f"{text} ; {no_card(draw)} {no_card(draw)} ; we met at home.then left at {draw.randrange(9)}.{word()} ; 1[.]2[.]3[.]999"
        rows.append((k, text))
        more[k] = sorted((text.index(m), text.index(m) + len(m), kind) for kind, m in extra)
    return spark.createDataFrame(rows, "doc_id long, text string").cache(), rows, more


def test_added_spans(planted):
    frame, rows, more = planted
    texts, hit, wrong, due = dict(rows), 0, [], 0
    for r in private.personal_spans(frame).collect():
        assert [(s.start, s.end, s.kind) for s in r.spans if s.base] == base(texts[r.doc_id])
        added = {(s.start, s.end, s.kind) for s in r.spans if not s.base}
        want = set(more[r.doc_id]) - set(base(texts[r.doc_id]))
        due, hit = due + len(want), hit + len(added & want)
        wrong += [texts[r.doc_id][s:e] for s, e, _ in added - want]
    assert due > 100 and hit >= 0.9 * due and len(wrong) <= 0.02 * due, (due, hit, wrong)


def test_redaction(planted):
    frame, _, _ = planted
    text = "call +1 (377) 555-0271, mail a.b@c.de now +484516811440"
    model = private.fit(private.proposals(frame, ["doc_id"]))
    one = frame.sparkSession.createDataFrame([(1, text), (2, None), (3, "nothing")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in private.redacted(private.personal_spans(one, model)).collect()}
    assert got == {1: "call [PHONE], mail [EMAIL] now [PHONE]", 2: None, 3: "nothing"}


def test_trees_in_sql_equal_those_in_the_fit(spark):
    draw = np.random.default_rng(1)
    code = draw.integers(0, 1 << 15, 800)
    x = private.unpacked(code)
    y = (x[:, 0] & (x[:, 2] != 1)).astype(float)
    trees = private.boosted(x, y, np.ones(800))
    assert ((sum(private.value(t, x) for t in trees) > 0) == (y == 1)).mean() > 0.99
    model = private.Model({2: trees}, {2: 100.0})
    frame = spark.createDataFrame([(int(c), 2) for c in code] + [(1, 1)], "code int, kind int")
    got = [r[0] for r in frame.select(F.struct("code", "kind").alias("s")).select(F.expr(private.margin(model))).collect()]
    assert got[:-1] == (sum(private.value(t, x) for t in trees) - 100).tolist() and got[-1] is None


def test_no_threshold_without_evidence():
    one = np.ones(5)
    assert private.calibrated(np.arange(5.0), one, one) is None  # too few
    assert private.calibrated(np.arange(-1.0, 4.0), one, 10 * one) == 1.0
    assert private.calibrated(np.arange(5.0), np.array([0, 1, 1, 0, 1]), 10 * one) == 4.0
