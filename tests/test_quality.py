"""Maintenance windows, gaps of numbers and references on planted rows."""

from datetime import date

from pyspark.sql import functions as F

from tarsia.operators import quality
from tarsia.sources.projection import Tables


def test_days_under_maintenance(spark):
    days = spark.createDataFrame([(e, a, f"2026-{m:02d}-{d:02d}") for e, a in (("E1", "A"), ("E1", "B"), ("E2", "A")) for m, d in ((1, 30), (1, 31), (2, 1), (2, 2), (4, 1))], "entity_id string, asset_id string, d string").select("entity_id", "asset_id", F.to_date("d").alias("date"))
    windows = [("E1", "A", "2026-01-31", "2026-02-01"), ("E1", "A", "2026-02-01", "2026-02-02"), ("E1", "B", "2026-02-02", None), ("E2", None, "2025-12-01", "2026-01-30"), ("E2", "A", "2026-05-01", "2026-06-01"), ("E2", "A", "2026-02-02", "2026-02-01"), ("E3", None, "2026-01-01", None)]
    w = spark.createDataFrame(windows, "entity_id string, asset_id string, s string, e string").select("entity_id", "asset_id", F.to_date("s").alias("starts_on"), F.to_date("e").alias("ends_on"))
    got = sorted((r.entity_id, r.asset_id, r.date) for r in quality.maintained(days, w).collect())
    assert got == [("E1", "A", date(2026, 1, 31)), ("E1", "A", date(2026, 2, 1)), ("E1", "A", date(2026, 2, 2)), ("E1", "B", date(2026, 2, 2)), ("E1", "B", date(2026, 4, 1)), ("E2", "A", date(2026, 1, 30))]
    assert quality.maintained(days.limit(0), w).count() == 0 == quality.maintained(days, w.limit(0)).count()


def test_gaps_of_numbers(spark, sf_dir):
    t = Tables(spark, sf_dir)
    numbers = [*range(1000, 1030), 1030, 1030, 1081, 1131, 5000, 2_000_000]
    rows = [("E1", f"A{n}") for n in numbers] + [("E2", "A1"), ("E2", "A900"), ("E3", None), ("E3", "no number")]
    t.alert = spark.createDataFrame(rows, "entity_id string, alert_id string")
    got = sorted((r.entity_id, r.sample.split("|")[1]) for r in quality.gaps(t).collect())
    assert got == [("E1", "1030->1081 (diff=51)"), ("E1", "1131->5000 (diff=3869)"), ("E1", "5000->2000000 (diff=1995000)")]


def test_references_that_lead_nowhere(spark, sf_dir):
    t = Tables(spark, sf_dir)
    none = lambda schema: spark.createDataFrame([], schema)
    t.alert = spark.createDataFrame([("E1", "A1", "X"), ("E1", "A2", None), ("E1", "A3", ""), ("E2", "B1", "X")], "entity_id string, alert_id string, asset_id string")
    t.asset = spark.createDataFrame([("E1", "Y")], "entity_id string, asset_id string")
    t.closure = spark.createDataFrame([("E1", "A1"), ("E1", None), ("E1", "gone"), ("E3", "gone")], "entity_id string, ref_id string")
    t.workflow_event = spark.createDataFrame([("E1", "gone", "case"), ("E1", "gone", "alert")], "entity_id string, ref_id string, ref_type string")
    t.escalation, t.soc_case = none("entity_id string, ref_id string"), none("entity_id string, case_id string")
    t.case_alert_link = spark.createDataFrame([("E2", "A1", "C1")], "entity_id string, alert_id string, case_id string")
    got = sorted((r.entity_id, r.tab, r.sample) for r in quality.orphans(t).collect())
    assert got == [("E1", "alert:asset_id", "A1"), ("E1", "alert:asset_id", "A2"), ("E1", "closure:ref_id", "None"), ("E1", "closure:ref_id", "gone"), ("E1", "workflow_event:ref_id", "gone"), ("E2", "case_alert_link:alert_id", "A1")]
