"""States of rules, blocking checks and patterns over providers on planted rows."""

from pyspark.sql import functions as F

from tarsia.operators import contracts, ingest, statistics
from tarsia.sources.projection import Tables

FOUND = "entity_id string, rule_id string, score double, confidence double, severity string"


def states(spark, sf_dir, monkeypatch, found, decisions=None):
    t = Tables(spark, sf_dir)
    t.alert = t.alert
    t.entity = spark.createDataFrame([("E00",), ("E99",)], "entity_id string")
    monkeypatch.setattr(contracts, "findings", lambda _: spark.createDataFrame(found, FOUND))
    d = spark.createDataFrame(decisions, "entity_id string, rule_id string") if decisions else None
    return {(r.entity_id, r.rule_id): (r.state, r.missing) for r in contracts.results(t, d).collect()}


def test_states(spark, sf_dir, monkeypatch):
    got = states(spark, sf_dir, monkeypatch, [("E00", "NS03", 50.0, 1.0, "high")], [("E00", "EG07"), ("E99", "EG07")])
    assert len(got) == 40
    assert got["E00", "EG07"] == got["E99", "EG07"] == ("not_applicable", "")
    assert got["E00", "NS03"] == ("finding", "")
    assert got["E99", "NS06"] == ("insufficient_evidence", "alert,asset,log_source_daily")
    assert got["E99", "EG08"] == ("insufficient_evidence", "escalation")  # reads no alerts


def test_useless_columns_degrade(spark, sf_dir, monkeypatch):
    t = Tables(spark, sf_dir)
    t.alert = t.alert.withColumn("disposition", F.lit("Unknown")).withColumn("closed_by", F.lit(None).cast("string"))
    monkeypatch.setattr(contracts, "findings", lambda _: spark.createDataFrame([], FOUND))
    got = {r.rule_id: (r.state, r.missing) for r in contracts.results(t).filter("entity_id = 'E00'").collect()}
    assert got["EG11"] == ("degraded", "alert.disposition") and got["EG07"] == ("degraded", "alert.closed_by")
    level = contracts.coverage(t).filter("entity_id = 'E00'").first()
    assert level.requests.split(",")[0] == "alert.disposition" and level.level == "partial"


def test_only_format_errors_block(spark, sf_dir):
    """An alert closed before it was created and gaps in numbers are evidence; a key twice, a blank severity and an unknown word
    block."""
    base = Tables(spark, sf_dir)
    t = Tables(spark, sf_dir)
    t.entity, t.asset, t.soc_case, t.case_alert_link = base.entity, base.asset, base.soc_case, base.case_alert_link
    a = base.alert.filter("entity_id in ('E00', 'E01', 'E02', 'E04')")
    first = F.col("alert_id") == F.min("alert_id").over(__import__("pyspark.sql", fromlist=["Window"]).Window.partitionBy("entity_id"))
    a = a.withColumn("first", first)
    a = a.withColumn("closed_at", F.when(F.col("first") & (F.col("entity_id") == "E00"), F.col("created_at") - F.expr("interval 1 hour")).otherwise(F.col("closed_at")))
    a = a.withColumn("severity_final", F.when(F.col("first") & (F.col("entity_id") == "E01"), "").otherwise(F.col("severity_final")))
    a = a.withColumn("status", F.when(F.col("first") & (F.col("entity_id") == "E02"), "unmapped").otherwise(F.col("status")))
    t.alert = a.unionByName(a.filter("first and entity_id = 'E04'")).drop("first")
    got = {r.entity_id: r for r in ingest.blocking(t).collect()}
    assert (got["E00"].blocking, got["E00"].upload, got["E00"].interface) == ("", "published", "published") and "close_before_create" in got["E00"].reported
    assert [(got[e].blocking, got[e].upload, got[e].interface, got[e].automatic) for e in ("E01", "E02", "E04")] == [(c, "held", "rejected", "published") for c in ("missing_required_field", "unrecognised_value", "duplicate_primary_keys")]


def patterns(spark, monkeypatch, sf_dir, provider, hits, told=None):
    t = Tables(spark, sf_dir)
    t.entity = spark.createDataFrame(list(provider.items()), "entity_id string, soc_provider string")
    monkeypatch.setattr(statistics, "findings", lambda _: spark.createDataFrame([(e, r, 80.0, 1.0, s) for e, r, s in hits], FOUND))
    rows = [(e, "NS01", "assessed_clear") for e in told or provider]
    monkeypatch.setattr(statistics, "results", lambda _: spark.createDataFrame(rows, "entity_id string, rule_id string, state string"))
    return statistics.systemic(t).collect()


def test_a_pattern_needs_three_clients(spark, sf_dir, monkeypatch):
    who = {f"A{k}": "X" if k < 4 else "Y" if k < 8 else "internal" for k in range(16)}
    rows = patterns(spark, monkeypatch, sf_dir, who, [(f"A{k}", "NS01", "high") for k in (0, 1, 2, 4, 5, 9, 10, 11)])
    got = {r.provider: r for r in rows}
    assert (got["X"].affected, got["X"].level != "not_tested", got["X"].severity) == (3, True, "high")
    assert (got["Y"].affected, got["Y"].level, got["Y"].p) == (2, "not_tested", None) and "internal" not in got


def test_only_assessable_entities_are_compared(spark, sf_dir, monkeypatch):
    who = {f"A{k}": "X" if k < 5 else "Z" for k in range(12)}
    (row,) = patterns(spark, monkeypatch, sf_dir, who, [(f"A{k}", "NS01", "low") for k in (0, 1, 2)], told=["A3", "A6", "A7"])
    assert (row.assessable, row.clients, row.others_affected, row.others_assessable) == (4, 5, 0, 2)
    assert row.p == 0.2  # 4 of 4 choose 3 over 6 choose 3
