"""Registered queries of the package against their SQL, and small frames with known answers."""

import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from tarsia.functions import stats
from tarsia.operators import catalog, peers, records, rules
from tarsia.plans.registry import ORACLES, QUERIES
from tarsia.sources.projection import Tables

@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(same, name):
    same(name)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_rule_order_of_rows(spark, sf_dir):
    """A rule's result doesn't depend on how its input is partitioned."""
    a, b = Tables(spark, sf_dir), Tables(spark, sf_dir)
    b.alert = a.alert.repartition(7, "rule_id")
    key = lambda t: sorted(map(str, rules.eg05(t).collect()))
    assert key(a) == key(b)


def test_null_keys_are_versions_of_their_own(spark):
    rows = [("a", "E1", None, 1), ("a", "E1", None, 2), ("a", "E1", "x", 1), ("a", "E1", "x", 2), ("b", "E1", "x", 1), ("b", "E1", "x", 1)]
    got = records.current_version(spark.createDataFrame(rows, "source string, entity_id string, id string, pub_seq int"), ["source", "entity_id", "id"]).collect()
    assert sorted(map(str, ((r.source, r.id, r.pub_seq) for r in got))) == sorted(map(str, [("a", None, 1), ("a", None, 2), ("a", "x", 2), ("b", "x", 1)]))


def test_zones_and_utc_months(spark, sf_dir):
    """A known zone that the records don't use, unknown and missing ones; the month is that of the UTC time."""
    t = Tables(spark, sf_dir)
    t.entity = spark.createDataFrame([("E1", "Asia/Tokyo"), ("E2", None), ("E3", "Mars/Olympus")], "entity_id string, timezone string")
    at = "2026-01-31 23:30:00"
    t.alert = spark.createDataFrame([(e, f"A{k}", s) for k, (e, s) in enumerate([("E1", at), ("E2", at), ("E3", None)])], "entity_id string, alert_id string, s string").selectExpr("entity_id", "alert_id", "cast(s as timestamp_ntz) as created_at")
    got = {r.entity_id: (r.zone, r.month, r.alerts, r.night, r.weekend) for r in rules.local_counts(t).collect()}
    assert got == {"E1": ("Asia/Tokyo", "2026-01", 1, 0, 1), "E2": ("UTC", "2026-01", 1, 1, 1), "E3": ("UTC", None, 1, 0, 0)}


def test_masks(spark):
    texts = ["see host.example.org now", "x12345678 12345678", "a.b@example.com from 10.1.2.3", "1:2:3:4:5:6:7:8", None]
    got = [r.m for r in spark.createDataFrame([(x,) for x in texts], "v string").select(records.redacted(F.col("v")).alias("m")).collect()]
    assert got == ["see [REDACTED_HOST] now", "x12345678 [REDACTED_NUM]", "[REDACTED_EMAIL] from [REDACTED_IPV4]", "[REDACTED_IPV6]", ""]


def test_hypergeometric_tail(spark):
    from math import comb

    from tarsia.operators.statistics import hypergeom_tail

    cases = [(2, 5, 4, 20), (0, 5, 4, 20), (5, 5, 4, 20), (1, 0, 4, 20), (3, 6, 6, 9), (4, 4, 4, 4)]
    got = [r.p for r in spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, k int, n int, s int, m int").orderBy("i").select(hypergeom_tail(*map(F.col, "knsm")).alias("p")).collect()]
    want = [1.0 if n <= 0 else sum(comb(s, i) * comb(m - s, n - i) for i in range(k, min(n, s) + 1)) / comb(m, n) for k, n, s, m in cases]
    assert got == pytest.approx(want, abs=1e-12)


def test_header_names():
    from tarsia.operators.ingest import header_name

    seen = set()
    assert [header_name(h, seen, k + 1) for k, h in enumerate(["Alert ID", "alert_id", " ", "State", "", "ALERT-ID"])] == ["alert_id", "alert_id_2", "column_3", "state", "column_5", "alert_id_3"]


def test_period_bounds(spark):
    from tarsia.operators.ingest import period_bounds

    labels = ["2026", "2026-Q4", "2026-H2", "2026-03", "2026-13", "Q1", None]
    rows = spark.createDataFrame([(x,) for x in labels], "v string").select(*period_bounds(F.col("v"))).collect()
    assert [tuple(map(str, r)) for r in rows] == [("2026-01-01", "2027-01-01"), ("2026-10-01", "2027-01-01"), ("2026-07-01", "2027-01-01"), ("2026-03-01", "2026-04-01"), ("None", "None"), ("None", "None"), ("None", "None")]


def test_word_runs_of_a_long_text(spark):
    text = " ".join(f"word{k}" for k in range(100_000))
    (row,) = spark.createDataFrame([(text,)], "v string").select(F.size(catalog.word_shingles(F.col("v"))).alias("n")).collect()
    assert row.n == 99_998


def test_kept_tables_can_be_forgotten(spark, sf_dir):
    from tarsia.sources import storage

    first = Tables(spark, sf_dir).alert
    assert first.inputFiles() == Tables(spark, sf_dir).alert.inputFiles()
    storage.forget(sf_dir)
    assert first.inputFiles() != Tables(spark, sf_dir).alert.inputFiles()


def test_fingerprint_sees_every_table(spark, sf_dir):
    names = ("alert", "workflow_event", "soc_case", "case_alert_link", "escalation", "log_source_daily", "declared_kpi", "sla_policy", "entity")
    t, b = Tables(spark, sf_dir), Tables(spark, sf_dir)
    b.escalation = t.escalation.limit(t.escalation.count() - 1)
    first, second = ({r["table"]: (r["n"], r["hash"]) for r in records.fingerprint(x).collect()} for x in (t, b))
    assert set(names) <= set(first) and not {"a0", "a1"} & set(first)
    assert [n for n in first if first[n] != second[n]] == ["escalation"]


def test_evidence_without_cap(spark):
    hits = spark.createDataFrame([("E1", f"A{k}") for k in range(30)], "entity_id string, id string")
    (row,) = rules.first_ids(hits, "id", None).collect()
    assert row.evidence.split(",") == sorted(f"A{k}" for k in range(30))


def test_pseudonym_is_hmac(spark):
    df = spark.createDataFrame([("a",), ("Ünï",), ("",), (None,)], "v string").select("v", records.pseudonym(F.col("v")).alias("p"))
    for r in df.collect():
        want = "U_" + hmac.new(records.KEY, r.v.encode(), hashlib.sha256).hexdigest()[:16] if r.v else None
        assert r.p == want


def test_wilson_and_chance_floor(spark):
    lo, hi = stats.wilson(F.col("h"), F.col("n"))
    df = spark.createDataFrame([(8, 10), (0, 0)], "h int, n int").select(lo.alias("lo"), hi.alias("hi")).collect()
    assert (df[0].lo, df[0].hi) == (0.4902, 0.9433) and df[1].lo is None
    k = spark.createDataFrame([(0, 10), (100, 1000), (10000, 10)], "n int, p int").select(rules.chance_floor(F.col("n"), F.col("p")).alias("k"))
    assert [r.k for r in k.collect()] == [1, 3, 16]  # 1000 P(X >= 2) = 4.68 and 1000 P(X >= 3) = 0.155 at a mean of 0.1


def test_benjamini_hochberg_and_ranks(spark):
    df = spark.createDataFrame([(0.01,), (0.04,), (0.03,), (0.9,)], "p double")
    got = {r.p: round(r.q, 6) for r in stats.benjamini_hochberg(df, "p").collect()}
    assert got == {0.01: 0.04, 0.03: 0.053333, 0.04: 0.053333, 0.9: 0.9}
    ranks = stats.fractional_rank(spark.createDataFrame([(5.0,), (5.0,), (1.0,)], "v double"), "v").collect()
    assert sorted(r["rank"] for r in ranks) == [1.0, 2.5, 2.5]


def test_times_that_cannot_be_read(spark):
    df = spark.createDataFrame([("2024-01-01T05:30:00+05:30",), ("soon",), ("",), (None,), ("1704067200",)], "t string")
    got = [str(r.at) for r in df.select(records.read_time(F.col("t")).alias("at")).collect()]
    assert got == ["2024-01-01 00:00:00", "None", "None", "None", "2024-01-01 00:00:00"]


def test_numbers_flags_and_shingles(spark):
    df = spark.createDataFrame([("1,234,567.5",), ("12,34,567",), ("1,23,45",), (" -7 ",), ("",), (None,)], "v string")
    assert [r.n for r in df.select(catalog.read_number(F.col("v")).alias("n")).collect()] == [1234567.5, 1234567.0, None, -7.0, None, None]
    df = spark.createDataFrame([(" Yes",), ("off",), ("maybe",), (None,)], "v string")
    assert [r.b for r in df.select(catalog.read_bool(F.col("v")).alias("b")).collect()] == [True, False, None, None]
    df = spark.createDataFrame([("One two of THREE, four",), ("ab one two",), ("a b",), (None,)], "v string")
    got = [r.s for r in df.select(catalog.word_shingles(F.col("v")).alias("s")).collect()]
    assert got == [["one_two_three", "two_three_four"], ["one_two"], [], []]


def test_outliers_of_uneven_entities(spark, sf_dir):
    """An entity whose share lies far from its peers' is found, with a scale that keeps to the floor."""
    t = Tables(spark, sf_dir)
    large = [r.entity_id for r in t.alert.groupBy("entity_id").count().filter("count >= 30").collect()]
    near = peers.bridge(t).filter(F.col("entity_id").isin(large) & F.col("peer_id").isin(large)).groupBy("entity_id").count()
    odd, n_peers = near.orderBy(F.desc("count"), "entity_id").first()
    assert n_peers >= 3
    t.alert = t.alert.withColumn("disposition", F.when(F.col("entity_id") == odd, "benign").otherwise(F.lit("false_positive")))
    got = {r.entity_id: r.z for r in catalog.peer_outliers(t).filter("metric = 'fp_share'").collect()}
    assert got == {odd: -50.0}
