"""Windows over all tables, runs over several windows, and what is kept of a data folder."""

import shutil
from datetime import datetime

from pyspark.sql import functions as F

from tarsia.operators import contracts, metrics, rules, scoring, selection
from tarsia.sources import storage
from tarsia.sources.projection import Tables

ALERTS = "entity_id string, alert_id string, created string, closed string, acknowledged string, closed_by string, disposition string, status string"


def small(spark, sf_dir):
    """One alert before the quarter, one in its last second, two closed in and after it, one without a time; and what hangs on them."""
    t = Tables(spark, sf_dir)
    a = [
        ("E1", "BEFORE", "2025-12-31 23:59:59", None, None, None, "unknown", "open"), ("E1", "LAST", "2026-03-31 23:59:59", None, None, None, "unknown", "open"),
        ("E1", "LATER", "2026-02-01 00:00:00", "2026-05-01 00:00:00", "2026-04-20 00:00:00", "bob", "true_positive", "closed"), ("E1", "INSIDE", "2026-02-02 00:00:00", "2026-02-03 00:00:00", "2026-02-02 01:00:00", "eve", "false_positive", "closed"),
        ("E1", "UNDATED", None, None, None, None, None, "open"), ("E1", "AFTER", "2026-04-01 00:00:00", None, None, None, None, "open"),
    ]
    rows = spark.createDataFrame(a, ALERTS)
    at = lambda c: F.col(c).cast("timestamp_ntz")
    t.alert = rows.select("entity_id", "alert_id", at("created").alias("created_at"), at("closed").alias("closed_at"), at("acknowledged").alias("acknowledged_at"), at("acknowledged").alias("first_touch_at"), "closed_by", F.lit("human").alias("closed_by_type"), F.lit(None).cast("string").alias("playbook_id"), "disposition", "status")
    cases = [("E1", "BACKLOG", "2025-11-01", "2026-06-01", "closed"), ("E1", "GONE", "2025-11-01", "2025-12-01", "closed"), ("E1", "NEW", "2026-04-02", None, "open")]
    t.soc_case = spark.createDataFrame(cases, "entity_id string, case_id string, o string, c string, status string").select("entity_id", "case_id", "status", at("o").alias("opened_at"), at("c").alias("closed_at"))
    t.closure = spark.createDataFrame([("E1", "LATER"), ("E1", "INSIDE"), ("E1", "GONE"), ("E2", "INSIDE"), ("E1", None)], "entity_id string, ref_id string")
    t.case_alert_link = spark.createDataFrame([("E1", "GONE", "LAST"), ("E1", "BACKLOG", "BEFORE"), ("E1", "GONE", "BEFORE"), ("E1", None, "LAST")], "entity_id string, case_id string, alert_id string")
    events = [("E1", "LAST", None), ("E1", "BEFORE", None), ("E1", "BEFORE", "2025-12-31"), ("E1", "LAST", "2025-12-31"), ("E1", "BEFORE", "2026-02-01"), ("E1", "LAST", "2026-04-01"), ("E1", "BACKLOG", "2025-11-02")]
    t.workflow_event = spark.createDataFrame(events, "entity_id string, ref_id string, at string").select("entity_id", "ref_id", at("at").alias("ts"))
    t.declared_kpi = spark.createDataFrame([("E1", p) for p in ("2026-Q1", "2025", "2026-H2", "2026", "soon")], "entity_id string, period string")
    days = ["2025-12-31", "2026-01-01", "2026-03-31", "2026-04-01"]
    t.log_source_daily = spark.createDataFrame([("E1", d) for d in days], "entity_id string, d string").select("entity_id", F.to_date("d").alias("date"))
    return t


def ids(rows, column):
    return sorted(str(r[column]) for r in rows.collect())


def test_a_quarter_closes_over_what_belongs_together(spark, sf_dir):
    s = selection.selected(small(spark, sf_dir), (selection.Span("q", datetime(2026, 1, 1), datetime(2026, 4, 1)),))
    s.__dict__["changed"] = True  # frames made here are kept nowhere
    assert ids(s.alert, "alert_id") == ["INSIDE", "LAST", "LATER"]
    later = s.alert.filter("alert_id = 'LATER'").first()
    assert (later.entity_id, later.closed_at, later.acknowledged_at, later.closed_by, later.disposition, later.status) == ("E1@q", None, None, None, None, "open")
    assert s.alert.filter("alert_id = 'INSIDE'").first().disposition == "false_positive"
    assert [(r.case_id, r.status, r.closed_at) for r in s.soc_case.collect()] == [("BACKLOG", "open", None)]
    assert ids(s.closure, "ref_id") == ["INSIDE"]
    assert sorted((str(r.case_id), r.alert_id) for r in s.case_alert_link.collect()) == [("BACKLOG", "BEFORE"), ("GONE", "LAST"), ("None", "LAST")]
    assert sorted((r.ref_id, str(r.ts)) for r in s.workflow_event.collect()) == [("BACKLOG", "2025-11-02 00:00:00"), ("BEFORE", "2026-02-01 00:00:00"), ("LAST", "2025-12-31 00:00:00"), ("LAST", "None")]
    assert ids(s.declared_kpi, "period") == ["2026", "2026-Q1", "soon"] and ids(s.log_source_daily, "date") == ["2026-01-01", "2026-03-31"]


def test_windows_without_start_overlap(spark, sf_dir):
    s = selection.selected(small(spark, sf_dir), (selection.Span("a", None, datetime(2026, 2, 2)), selection.Span("b", None, datetime(2026, 4, 1))))
    s.__dict__["changed"] = True
    got = sorted((r.entity_id, r.alert_id, r.status) for r in s.alert.collect())
    assert got == [("E1@a", "BEFORE", "open"), ("E1@a", "LATER", "open"), ("E1@b", "BEFORE", "open"), ("E1@b", "INSIDE", "closed"), ("E1@b", "LAST", "open"), ("E1@b", "LATER", "open")]


def test_one_run_over_windows_equals_a_run_for_each(spark, sf_dir):
    """The findings of all windows at once against those of tables cut to one window, whose entities keep their ids."""
    t = Tables(spark, sf_dir)
    windows = selection.cutoffs(t)
    key = lambda df: sorted(str((r.entity_id, r.rule_id, r.hits, r.population, round(r.distance, 9), r.score, r.evidence)) for r in df.collect())
    together = selection.split_scope(rules.findings(selection.history_tables(t)))
    for w in windows[:2]:
        alone = selection.selected(t, (w,), f"alone-{w.name}-", {w.name: selection.history_tables(t).moments[w.name]})
        assert key(together.filter(F.col("run") == w.name)) == key(selection.split_scope(rules.findings(alone)))


def test_results_follow_the_given_tables(spark, sf_dir, tmp_path):
    """What is kept of a folder isn't used again after one of its tables was replaced."""
    folder = f"{tmp_path}/data"
    shutil.copytree(sf_dir, folder)
    before = metrics.stats(Tables(spark, folder)).first().total
    few = spark.read.parquet(f"{sf_dir}/orders.parquet").limit(100).toPandas()
    shutil.rmtree(f"{folder}/orders.parquet", ignore_errors=True) if (tmp_path / "data/orders.parquet").is_dir() else (tmp_path / "data/orders.parquet").unlink()
    few.to_parquet(f"{folder}/orders.parquet", coerce_timestamps="us")
    assert before > metrics.stats(Tables(spark, folder)).first().total > 0
    assert metrics.stats(Tables(spark, folder)).first().total <= 100


def test_a_domain_that_nobody_could_look_at_is_left_out(spark, sf_dir, monkeypatch):
    """An unknown domain's score is null and the index stands on the others; too little evidence leaves the band open but for the
    floor of a serious finding."""
    t = Tables(spark, sf_dir)
    t.entity = spark.createDataFrame([("E1",), ("E2",), ("E3",)], "entity_id string")
    found = [("E1", "EG01", 50.0, 1.0, "high"), ("E3", "EG01", 10.0, 0.9, "critical")]
    monkeypatch.setattr(scoring, "findings", lambda _: spark.createDataFrame(found, "entity_id string, rule_id string, score double, confidence double, severity string"))
    told = lambda e, r: "finding" if (e, r) in {f[:2] for f in found} else "assessed_clear" if e == "E1" and rules.DOMAINS[r] != "Escalation" else "insufficient_evidence"
    states = [(e, r, rules.DOMAINS[r], told(e, r), "", 5) for e in ("E1", "E2", "E3") for r in rules.RULES]
    frame = spark.createDataFrame(states, "entity_id string, rule_id string, domain string, state string, missing string, population int")
    monkeypatch.setattr(scoring, "results", lambda _t, _d: frame)
    monkeypatch.setattr(contracts, "results", lambda _t, _d: frame)
    score = {(r.entity_id, r.domain): (r.score, r.status) for r in scoring.domain_scores(t).collect()}
    assert score["E1", "Investigation"] == (50.0, "assessed") and score["E1", "Escalation"] == (None, "unknown") and score["E1", "Cyber Resilience"] == (0.0, "assessed")
    assert score["E3", "Investigation"] == (10.0, "partial") and score["E2", "Investigation"] == (None, "unknown")
    index = {r.entity_id: r for r in scoring.risk_index(t).collect()}
    assert (index["E1"].base, index["E1"].risk_index, index["E1"].band) == (round(0.15 * 50 / 0.85, 4), 8.9, "moderate")
    assert (index["E2"].base, index["E2"].band) == (0.0, "insufficient_evidence") and (index["E3"].base, index["E3"].band) == (10.0, "high")


def test_handled_alerts_of_a_window_with_a_start(spark, sf_dir):
    """Records met once for all windows give what each window's own tables give, with several closures and undated events."""
    t = Tables(spark, sf_dir)
    some = F.substring("ref_id", 2, 8).cast("long") % 3
    base = t.closure
    t.closure = base.unionByName(base.filter(some == 0).withColumn("comment_len", F.lit(3))).unionByName(base.filter(some == 1))
    t.workflow_event = t.workflow_event.withColumn("ts", F.when(F.length("ref_id") + F.col("note_len") % 5 != 9, F.col("ts")))
    s = selection.selected(t, selection.QUARTER + (selection.Span("May", None, datetime(2026, 5, 1)),))
    columns = ["entity_id", "alert_id", "high", "sec", "n_events", "looked", "comment_len", "note", "nth", "other"]
    got = sorted(map(str, rules.handled(s).select(*columns).collect()))
    plain = rules.with_steps(s, [F.lit(True)], "severity_final").withColumns({"high": F.col("severity_final").isin("high", "critical"), "n_events": F.col("steps")[0], "looked": F.col("looks")[0] > 0})
    assert got == sorted(map(str, plain.select(*columns).collect())) and len(got) > 100

    key = ["entity_id", "alert_id"]
    looked = t.workflow_event.filter("ref_type = 'alert' and action = 'investigate'").select("entity_id", F.col("ref_id").alias("alert_id")).distinct().withColumn("yes", F.lit(True))
    notes = t.closure.select("entity_id", F.col("ref_id").alias("alert_id"), "comment_len").distinct()
    want = rules.human_closed(t).select(*key).join(looked, key, "left").join(notes, key, "left").select(*key, "comment_len", (F.col("yes").isNull() & (F.coalesce("comment_len", F.lit(0)) < 25)).alias("bad"))
    assert sorted(map(str, rules.unlooked_rows(t).collect())) == sorted(map(str, want.collect()))


def test_history_writes_no_events_and_closures(spark, sf_dir):
    """Windows explode the largest tables on the fly; neither they nor what is a mere view are written and dealt out."""
    storage.forget(sf_dir)
    selection.history_findings(Tables(spark, sf_dir)).count()
    kept = {k[2] for k in storage._KEPT if k[1] == sf_dir}
    assert "history3-handled" in kept and not [n for n in kept if n.endswith("log_source_daily") or n.endswith("closure") or n.startswith("history") and n.endswith("workflow_event")]


def test_rules_keep_what_they_ask_for_twice(spark, sf_dir):
    """Closures in bulk, comments used again, months and the like are counted once a session, not once for hits and once for evidence."""
    storage.forget(sf_dir)
    rules.findings(Tables(spark, sf_dir)).count()
    kept = {k[2] for k in storage._KEPT if k[1] == sf_dir}
    assert {"templates", "alert_pairs", "bulk_closures", "busy_people", "quiet_assets", "local_counts", "own_months"} <= kept


def test_silent_days_of_readings_that_cancel_out(spark, sf_dir):
    """A day is silent where its readings sum to 0, negative and lacking ones included; days of assets that always report aren't summed."""
    t = Tables(spark, sf_dir)
    t.asset = spark.createDataFrame([("E1", a, 3, True, None, None) for a in "ABC"], "entity_id string, asset_id string, criticality int, monitored_flag boolean, in_service_from date, in_service_to date")
    log = [("A", 1, 5), ("A", 1, -5), ("A", 2, None), ("A", 3, 0), ("A", 3, None), ("A", 4, 7), ("B", 1, 2), ("B", 2, None), ("C", 1, -1)]
    rows = spark.createDataFrame([("E1", a, d, n) for a, d, n in log], "entity_id string, asset_id string, d int, event_count int")
    t.log_source_daily = rows.select("entity_id", "asset_id", F.make_date(F.lit(2026), F.lit(6), "d").alias("date"), "event_count")
    assert [(r.asset_id, r.days) for r in rules.silent_days(t).collect()] == [("A", 2)]
    plan = rules.silent_days(t)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan


def test_windows_meet_telemetry_comments_and_links_once(spark, sf_dir):
    """What is counted once for all windows equals what the tables of each window give, with a start too; rows aren't taken once a window."""
    t = Tables(spark, sf_dir)
    day = F.col("date")
    t.log_source_daily = t.log_source_daily.withColumns({"event_count": F.when(F.day(day) % 7 != 3, F.col("event_count") - 40), "date": F.when(F.day(day) != 9, F.add_months(day, -F.day(day) % 4))})
    t.closure = t.closure.withColumn("comment_norm_hash", F.substring("comment_norm_hash", 1, 1))
    link = t.case_alert_link
    t.case_alert_link = link.unionByName(link.limit(5)).unionByName(link.limit(7).withColumn("case_id", F.lit(None).cast("string"))).unionByName(link.limit(3).withColumn("alert_id", F.lit("NONE")))
    windows = (*selection.QUARTER, selection.Span("May", None, datetime(2026, 5, 1)), selection.Span("all", None, datetime(2026, 9, 1)))
    s, plain = selection.selected(t, windows), selection.selected(t, windows)
    plain.__dict__["changed"] = True  # then rules meet the tables of the windows
    told = lambda df: sorted(str([r[c] for c in sorted(df.columns)]) for r in df.collect())
    got = told(rules.telemetry(s))
    assert got == told(rules.telemetry(plain)) and len(got) > 100 and len({r.split("@")[1][:3] for r in got if "@" in r}) == 3
    assert told(rules.groups_of(s, 10)) == told(rules.groups_of(plain, 10)) != []
    at = lambda df, c: [(r.entity_id.split("@")[1], r[c]) for r in df.select("entity_id", c).collect()]
    cases, alerts = set(at(s.soc_case, "case_id")), set(at(s.alert, "alert_id"))
    want = sorted((w.name, str(r.case_id), r.alert_id) for r in t.case_alert_link.collect() for w in windows if (w.name, r.case_id) in cases or (w.name, r.alert_id) in alerts)
    assert sorted((r.entity_id.split("@")[1], str(r.case_id), r.alert_id) for r in s.case_alert_link.collect()) == want != []


def test_history_counts_before_it_takes_records_for_each_window(spark, sf_dir):
    """Telemetry of an asset is one kept row for all windows; links and comments don't meet alerts taken once a window."""
    storage.forget(sf_dir)
    h = selection.history_tables(Tables(spark, sf_dir))
    rules.findings(h).count()
    kept = {k[2] for k in storage._KEPT if k[1] == sf_dir}
    assert {"history3-telemetry", "history3-quiet_assets", "history3-alert_pairs"} <= kept
    plan = selection.links(Tables(spark, sf_dir), selection.cutoffs(Tables(spark, sf_dir)))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1 and plan.index("Generate explode") < plan.index("Join LeftOuter")


def test_ghosts_without_a_rule(spark, sf_dir):
    """An alert that names an asset but no rule makes it heard of; one without an asset tells nothing."""
    t = Tables(spark, sf_dir)
    t.alert = spark.createDataFrame([("E1", "A", None, "benign"), ("E1", None, "R1", "benign")], "entity_id string, asset_id string, rule_id string, disposition string")
    t.asset = spark.createDataFrame([("E1", a, None, None) for a in "ABC"], "entity_id string, asset_id string, in_service_from date, in_service_to date")
    t.log_source_daily = spark.createDataFrame([("E1", "B", 0), ("E1", "B", 2), ("E1", "C", 0), ("E1", None, 5)], "entity_id string, asset_id string, event_count int").withColumn("date", F.to_date(F.lit("2026-06-01")))
    base, silent = rules.ghosts(t)
    assert base.count() == 3 and [r.asset_id for r in silent.collect()] == ["C"]
    assert rules.repeated_pairs(t).count() == 0
