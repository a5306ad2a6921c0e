"""The twenty detection rules, each one frame over all entities.

A rule returns a row for every entity in which it fires: entity_id, rule_id, hits, population, distance, confidence,
score, severity and evidence (the first record ids, joined by commas).

Entities whose id ends in @ and a name belong to the scope of that name: they are compared with entities of it only, and its
own dates count. So several windows of time are judged by one run of the rules.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial
from hashlib import md5
from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarsia.functions.stats import micros, median_mad, robust_z, seconds_between, share
from tarsia.operators.peers import bridge, scope
from tarsia.sources.projection import Tables

HIGH = ("high", "critical")
SINCE, UNTIL = "2026-01-01", "2026-07-01"
#: Weight of severity and least sample of each rule.
WEIGHTS = {
    "EG01": (85, 10), "EG02": (80, 15), "EG03": (95, 5), "EG04": (75, 20), "EG05": (70, 10), "EG06": (90, 20), "EG07": (75, 20), "EG08": (85, 5), "EG09": (70, 10), "EG10": (95, 10),
    "EG11": (80, 200), "EG12": (80, 15), "NS01": (95, 1), "NS02": (85, 30), "NS03": (85, 30), "NS04": (90, 10), "NS05": (75, 20), "NS06": (85, 10), "NS07": (95, 1), "NS08": (90, 1),
}
DOMAINS = {
    "EG01": "Investigation", "EG02": "Investigation", "EG03": "Escalation", "EG04": "Investigation", "EG05": "Operational Discipline", "EG06": "Governance and Oversight",
    "EG07": "Operational Discipline", "EG08": "Escalation", "EG09": "Incident Response", "EG10": "Governance and Oversight", "EG11": "Threat Detection", "EG12": "Security Operations",
    "NS01": "Threat Detection", "NS02": "Threat Detection", "NS03": "Security Operations", "NS04": "Governance and Oversight", "NS05": "Threat Detection", "NS06": "Cyber Resilience",
    "NS07": "Incident Response", "NS08": "Governance and Oversight",
}

# Parameters of the rules. EG03 and NS07 have none.
PARAMS = {
    "EG01": {"fast_share_threshold": 0.15, "min_fast_count": 5}, "EG02": {"max_uninvestigated_share": 0.15, "min_uninvestigated_count": 5}, "EG04": {"max_comment_hash_share": 0.25, "min_hash_group_size": 10},
    "EG05": {"min_repeat_count": 8, "min_unaddressed_pairs": 2, "max_chance_pairs": 0.5}, "EG06": {"min_bulk_closures_per_minute": 8, "max_deadline_hugging_share": 0.25}, "EG07": {"min_closures_per_analyst_hour": 30},
    "EG08": {"min_unacknowledged_escalations": 3}, "EG09": {"stale_case_days": 14, "min_stale_cases": 3}, "EG10": {"mttr_gap_ratio_threshold": 0.6}, "EG11": {"min_alert_volume": 200, "max_robust_z": 3.5, "min_spread": 0.01, "max_fp_rate": 0.98},
    "EG12": {"min_skipped_cases": 2}, "NS01": {"min_silent_days": 3, "min_asset_criticality": 3}, "NS02": {"min_peer_share": 0.6}, "NS03": {"max_night_share": 0.03, "min_alert_volume": 100, "max_robust_z": 3.5, "min_spread": 0.02},
    "NS04": {"min_tp_without_case": 3}, "NS05": {"max_dormant_share": 0.4, "min_dormant_rules": 5}, "NS06": {"min_ghost_assets": 2}, "NS08": {"review_period_months": 6},
}
#: Those two fire at one record; how many it takes is a parameter of theirs all the same.
BASE = PARAMS | {"EG03": {"min_unescalated": 1}, "NS07": {"min_unreported": 1}}
Params = dict[str, float]


def first_ids(hits: DataFrame, ident: str, k: int | None, order: list[Column] | None = None) -> DataFrame:
    """entity_id and evidence: the first k ids of each entity, all if k is None. No more are ever gathered."""
    w = Window.partitionBy("entity_id").orderBy(*(order or []), ident)
    top = hits.withColumn("_n", F.row_number().over(w))
    top = top if k is None else top.filter(F.col("_n") <= k)
    each = F.array_sort(F.collect_list(F.struct("_n", F.col(ident).alias("id"))))
    return top.groupBy("entity_id").agg(F.array_join(each["id"], ",").alias("evidence"))


def finding(rule: str, stats: DataFrame, severity: Callable[[Column], Column] | str, evidence: DataFrame) -> DataFrame:
    """stats: entity_id, hits, population and distance of the entities in which the rule fires."""
    weight, least = WEIGHTS[rule]
    out = stats.withColumn("_c", F.least(F.lit(1.0), F.col("population") / float(max(1, least))))
    out = out.withColumn("score", F.bround(F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.least(F.lit(2.0), "distance")) / 2.0 * weight * F.col("_c")), 1))
    out = out.withColumns({"confidence": F.bround("_c", 2), "severity": F.lit(severity) if isinstance(severity, str) else severity(F.col("score"))})
    out = out.join(evidence, "entity_id", "left")
    return out.select("entity_id", F.lit(rule).alias("rule_id"), F.col("hits").cast("long"), F.col("population").cast("long"), F.col("distance").cast("double"), "confidence", "score", "severity", "evidence")


def over(limit: float, high: str, low: str) -> Callable[[Column], Column]:
    return lambda score: F.when(score > limit, high).otherwise(low)


def too_many(least: float, share_of: float) -> Column:
    return (F.col("hits") >= least) & (F.col("hits") / F.col("population") > share_of)


def apart(name: str, rule: str, key: str, p: Params) -> str:
    """The name under which a frame is kept that holds what reaches a threshold: its own for each value but the rule's."""
    return name if p[key] == BASE[rule][key] else f"{name}-{p[key]}"


def human_closed(t: Tables) -> DataFrame:
    return t.alert.filter("closed_by_type = 'human' and closed_at is not null")


def handled(t: Tables) -> DataFrame:
    """Alerts closed by people with what became of them: high, sec (seconds until closed), n_events, looked (an investigation step) and the
    closures that name them, derived once a session. An alert with several closures has a row for each, numbered in nth (null
    without any); other is true where a closure's comment_len differs from that of the one before."""

    if t.derived and not t.changed:
        return t.derived("handled")
    rows = t.once("handled", lambda: with_steps(t, [F.lit(True)], "severity_final"))
    return rows.withColumns({"high": F.col("severity_final").isin(*HIGH), "n_events": F.col("steps")[0], "looked": F.col("looks")[0] > 0}).drop("severity_final", "steps", "looks")


def with_steps(t: Tables, known: list[Column], *more: str) -> DataFrame:
    """Alerts closed by people with sec, more columns, their closures, and for each condition of workflow events how many meet it (steps) and
    how many of those are investigation steps (looks)."""
    key = ["entity_id", "alert_id"]
    closed = human_closed(t).select(*key, *more, seconds_between(F.col("closed_at"), F.col("created_at")).alias("sec"))
    looked = F.coalesce(F.col("action") == "investigate", F.lit(False))
    counts = [F.count_if(c).alias(f"n{k}") for k, c in enumerate(known)] + [F.count_if(c & looked).alias(f"l{k}") for k, c in enumerate(known)]
    steps = t.workflow_event.filter("ref_type = 'alert'").groupBy("entity_id", F.col("ref_id").alias("alert_id")).agg(*counts)
    w = Window.partitionBy(*key).orderBy("comment_len")
    notes = t.closure.select("entity_id", F.col("ref_id").alias("alert_id"), "comment_len", F.col("comment_norm_hash").alias("note"))
    notes = notes.withColumns({"nth": F.row_number().over(w), "last": F.lag("comment_len").over(w)}).withColumn("other", (F.col("nth") == 1) | ~F.col("last").eqNullSafe(F.col("comment_len"))).drop("last")
    rows = closed.join(steps, key, "left").join(notes, key, "left")
    array = lambda p: F.array(*[F.coalesce(f"{p}{k}", F.lit(0)) for k in range(len(known))])
    return rows.select(*closed.columns, array("n").alias("steps"), array("l").alias("looks"), "comment_len", "note", "nth", "other")


def each_alert(t: Tables) -> DataFrame:
    return handled(t).filter("nth is null or nth = 1")


def fast_rows(t: Tables) -> DataFrame:
    """Human-closed high and critical alerts, fast: closed faster than the 5th percentile of the pooled peers, with at
    most one workflow event. Peers' durations are pooled as a histogram, so the pool stays small."""
    closed = each_alert(t).filter("high and sec >= 0").select("entity_id", "alert_id", "sec", "n_events")
    histogram = closed.groupBy("entity_id", "sec").agg(F.count("*").alias("n"))
    pooled = bridge(t).join(histogram.withColumnRenamed("entity_id", "peer_id"), "peer_id").groupBy("entity_id", "sec").agg(F.sum("n").alias("n"))
    p5 = pooled.groupBy("entity_id").agg(F.percentile("sec", F.lit(0.05), F.col("n")).alias("p5"))
    rows = closed.join(F.broadcast(p5), "entity_id", "left")
    fast = (F.col("sec") < F.coalesce(F.nullif("p5", F.lit(0.0)), F.lit(900.0))) & (F.col("n_events") <= 1)
    return rows.withColumn("fast", fast)


def eg01(t: Tables, p: Params = BASE["EG01"]) -> DataFrame:
    """Too many of them closed fast."""
    rows = fast_rows(t)
    stats = rows.groupBy("entity_id").agg(F.count_if("fast").alias("hits"), F.count("*").alias("population")).withColumn("distance", share(F.col("hits"), F.col("population")) / p["fast_share_threshold"])
    return finding("EG01", stats.filter(too_many(p["min_fast_count"], p["fast_share_threshold"])), over(70, "high", "medium"), first_ids(rows.filter("fast"), "alert_id", 10))


def unlooked_rows(t: Tables) -> DataFrame:
    """Alerts closed by people, bad: without an investigation step and with a short comment."""
    return handled(t).filter("nth is null or other").select("entity_id", "alert_id", "comment_len", (~F.col("looked") & (F.coalesce("comment_len", F.lit(0)) < 25)).alias("bad"))


def eg02(t: Tables, p: Params = BASE["EG02"]) -> DataFrame:
    """Too many of them."""
    rows = unlooked_rows(t)
    stats = rows.groupBy("entity_id").agg(F.count_if("bad").alias("hits"), F.count("*").alias("population")).withColumn("distance", share(F.col("hits"), F.col("population")) / 0.15)
    return finding("EG02", stats.filter(too_many(p["min_uninvestigated_count"], p["max_uninvestigated_share"])), over(70, "high", "medium"), first_ids(rows.filter("bad"), "alert_id", 10))


def counted(rule: str, base: DataFrame, hits: DataFrame, ident: str, unit: float, least: int, severity, k: int | None, order: list[Column] | None = None) -> DataFrame:
    """Rules that fire at a number of hits: distance is hits / unit, the population the rows of base."""
    stats = base.groupBy("entity_id").agg(F.count("*").alias("population")).join(hits.groupBy("entity_id").agg(F.count("*").alias("hits")), "entity_id")
    stats = stats.filter(F.col("hits") >= least).withColumn("distance", F.col("hits") / unit)
    return finding(rule, stats, severity, first_ids(hits, ident, k, order))


def eg03(t: Tables, p: Params = BASE["EG03"]) -> DataFrame:
    """Critical true positives that nobody escalated."""
    base = t.alert.filter("severity_final = 'critical' and disposition = 'true_positive'")
    done = t.escalation.select("entity_id", F.col("ref_id").alias("alert_id"))
    return counted("EG03", base, base.join(done, ["entity_id", "alert_id"], "left_anti"), "alert_id", 2.0, p["min_unescalated"], "critical", None)


def groups_of(t: Tables, least: int = 1) -> DataFrame:
    if t.derived and not t.changed:
        return t.derived("notes").filter(F.col("n") >= least)
    return handled(t).filter("note is not null").groupBy("entity_id", "note").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def comment_groups(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Alerts closed by people, and the comments they were closed with: n of each."""
    return each_alert(t).select("entity_id", "alert_id"), groups_of(t)


def eg04(t: Tables, p: Params = BASE["EG04"]) -> DataFrame:
    """Alerts closed with one of the comments that are used ten times or more."""
    closed = each_alert(t).select("entity_id", "alert_id")
    least, most = p["min_hash_group_size"], p["max_comment_hash_share"]
    groups = t.once(apart("templates", "EG04", "min_hash_group_size", p), lambda: groups_of(t, least))
    firsts = handled(t).join(groups, ["entity_id", "note"]).groupBy("entity_id", "note").agg(F.first("n").alias("n"), F.min("alert_id").alias("alert_id"))  # of few groups only
    stats = closed.groupBy("entity_id").agg(F.count("*").alias("population")).join(groups.groupBy("entity_id").agg(F.sum("n").alias("hits")), "entity_id")
    stats = stats.withColumn("distance", share(F.col("hits"), F.col("population")) / most).filter(F.col("hits") / F.col("population") > most)
    return finding("EG04", stats, lambda s: F.when(s < 70, "medium").otherwise("high"), first_ids(firsts, "alert_id", 10, [F.desc("n")]))


def chance_floor(n: Column, pairs: Column, most: float | Column = 0.5, limit: int | Column = 16) -> Column:
    """The least count that chance alone rarely reaches, for n alerts spread over so many pairs: the smallest
    k < limit with pairs * P(Poisson(n / pairs) >= k) below most, else limit."""
    cap = F.lit(limit) if isinstance(limit, int) else limit
    mean = n / pairs.cast("double")
    step = F.aggregate(
        F.sequence(F.lit(1), cap - 1),
        F.struct(F.exp(-mean).alias("p"), F.lit(1.0).alias("tail"), cap.alias("k")),
        lambda s, k: F.struct(
            (s["p"] * mean / k).alias("p"),
            (s["tail"] - s["p"]).alias("tail"),
            F.when((s["k"] == cap) & (pairs * (s["tail"] - s["p"]) < most), k).otherwise(s["k"]).alias("k"),
        ),
    )
    return F.when((n <= 0) | (pairs <= 0), 1).otherwise(step["k"])


def alert_pairs(t: Tables) -> DataFrame:
    """entity_id, asset_id, rule_id (each may be null), n and other: how many alerts each pair has, and how many of them have a true or no
    known reason. Derived once a session."""
    other = F.count_if(~F.coalesce(F.col("disposition").isin("false_positive", "benign"), F.lit(False)))
    return t.once("alert_pairs", lambda: t.alert.groupBy("entity_id", "asset_id", "rule_id").agg(F.count("*").alias("n"), other.alias("other")))


def repeated_pairs(t: Tables) -> DataFrame:
    """Asset and rule pairs that never fire for a true reason and have no remediation: n, with the entity's alerts and the space of
    its pairs."""
    key = ["entity_id", "asset_id", "rule_id"]
    pairs = alert_pairs(t).filter("asset_id is not null and rule_id is not null")
    size = pairs.groupBy("entity_id").agg(F.sum("n").alias("alerts"), (F.countDistinct("asset_id") * F.countDistinct("rule_id")).alias("space"))
    fixed = t.remediation.select("entity_id", F.col("linked_asset_id").alias("asset_id"), F.col("linked_rule_id").alias("rule_id"))
    return pairs.filter("other = 0").join(fixed, key, "left_anti").join(F.broadcast(size), "entity_id")


def eg05(t: Tables, p: Params = BASE["EG05"]) -> DataFrame:
    """Such pairs that fire again and again."""
    least, floor = p["min_repeat_count"], chance_floor(F.col("alerts"), F.col("space"), p["max_chance_pairs"], 2 * p["min_repeat_count"])
    hits = repeated_pairs(t).filter(F.col("n") >= F.greatest(F.lit(least), floor)).withColumn("id", F.concat_ws("::", "asset_id", "rule_id"))
    stats = hits.groupBy("entity_id").agg(F.count("*").alias("hits"), F.sum("n").alias("population")).filter(F.col("hits") >= p["min_unaddressed_pairs"]).withColumn("distance", F.col("hits") / float(p["min_unaddressed_pairs"]))
    return finding("EG05", stats, "medium", first_ids(hits, "id", 5, [F.desc("n")]))


def eg06(t: Tables, p: Params = BASE["EG06"]) -> DataFrame:
    """Closures in bulk (eight or more by one person within a minute), or just inside the agreed time."""
    closed = human_closed(t)
    least = p["min_bulk_closures_per_minute"]
    batches = t.once(apart("bulk_closures", "EG06", "min_bulk_closures_per_minute", p), lambda: closed.groupBy("entity_id", "closed_by", F.date_trunc("minute", F.col("closed_at").cast("timestamp")).alias("minute")).agg(F.count("*").alias("n")).filter(F.col("n") >= least))
    of = closed.select("entity_id", "alert_id", F.coalesce("closed_by", F.lit("")).alias("who"), F.col("closed_by").isNull().alias("nobody"), F.date_trunc("minute", F.col("closed_at").cast("timestamp")).alias("minute"))
    same = ["entity_id", "who", "nobody", "minute"]
    firsts = of.join(batches.select("entity_id", F.coalesce("closed_by", F.lit("")).alias("who"), F.col("closed_by").isNull().alias("nobody"), "minute"), same, "left_semi").groupBy(*same).agg(F.min("alert_id").alias("alert_id"))
    due = closed.join(F.broadcast(t.sla_policy.select("entity_id", F.col("severity").alias("severity_final"), "resolve_minutes")), ["entity_id", "severity_final"])
    took, limit = seconds_between(F.col("closed_at"), F.col("created_at")), F.col("resolve_minutes") * 60.0
    tight = due.groupBy("entity_id").agg(F.count("*").alias("population"), F.count_if((took >= 0.9 * limit) & (took <= limit)).alias("tight"))
    stats = tight.join(batches.groupBy("entity_id").agg(F.count("*").alias("hits")), "entity_id", "left").withColumns({"hits": F.coalesce("hits", F.lit(0)), "hug": F.col("tight") / F.col("population") > p["max_deadline_hugging_share"]})
    stats = stats.filter("hits > 0 or hug").withColumn("distance", F.when(F.col("hug") & (F.col("hits") > 0), 2.0).otherwise(1.2))
    return finding("EG06", stats, over(80, "critical", "high"), first_ids(firsts, "alert_id", 10))


def eg07(t: Tables, p: Params = BASE["EG07"]) -> DataFrame:
    """One person closes thirty alerts or more within a clock hour."""
    least = p["min_closures_per_analyst_hour"]
    hours = human_closed(t).groupBy("entity_id", "closed_by", F.date_trunc("hour", F.col("closed_at").cast("timestamp")).alias("hour")).agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    people = t.once(apart("busy_people", "EG07", "min_closures_per_analyst_hour", p), lambda: hours.groupBy("entity_id", "closed_by").agg(F.max("n").alias("n")))
    stats = people.groupBy("entity_id").agg(F.max("n").alias("hits"), F.max("n").alias("population")).withColumn("distance", F.col("hits") / 30.0)
    return finding("EG07", stats, lambda s: F.when(s < 75, "medium").otherwise("high"), first_ids(people, "closed_by", 10, [F.desc("n")]))


def eg08(t: Tables, p: Params = BASE["EG08"]) -> DataFrame:
    return counted("EG08", t.escalation, t.escalation.filter("acknowledged_at is null"), "esc_id", 3.0, p["min_unacknowledged_escalations"], "high", 5)


def references(t: Tables) -> DataFrame:
    """scope and reference: the latest creation or closing of alerts and cases of each scope, or the time that is given for it."""
    if t.moments:
        return t.spark.createDataFrame([(k, str(v)) for k, v in t.moments.items()], "scope string, at string").select("scope", F.col("at").cast("timestamp_ntz").alias("reference"))
    a = t.alert.groupBy("entity_id").agg(F.greatest(F.max("created_at"), F.max("closed_at")).alias("at"))
    c = t.soc_case.groupBy("entity_id").agg(F.greatest(F.max("opened_at"), F.max("closed_at")).alias("at"))
    return a.unionAll(c).groupBy(scope().alias("scope")).agg(F.max("at").alias("reference"))


def reference_date(t: Tables) -> DataFrame:
    """One row: the latest of all."""
    return references(t).agg(F.max("reference").alias("reference"))


def eg09(t: Tables, p: Params = BASE["EG09"]) -> DataFrame:
    """Cases still open two weeks before the reference date."""
    old = t.soc_case.filter("closed_at is null").withColumn("scope", scope()).join(F.broadcast(references(t)), "scope").filter((micros(F.col("reference")) - micros(F.col("opened_at"))) > F.lit(p["stale_case_days"] * 86_400_000_000))
    return counted("EG09", t.soc_case, old, "case_id", 3.0, p["min_stale_cases"], "medium", 5, [F.col("opened_at")])


def kpi_rows(t: Tables) -> DataFrame:
    """Measured times to resolve beside declared ones."""
    closed = t.alert.filter(F.col("severity_final").isin(*HIGH) & F.col("closed_at").isNotNull() & (F.col("closed_at") >= F.col("created_at")))
    own = closed.groupBy("entity_id", F.col("severity_final").alias("severity")).agg(F.count("*").alias("n"), F.sum(micros(F.col("closed_at")) - micros(F.col("created_at"))).alias("us"))
    declared = t.declared_kpi.filter("metric = 'MTTR'").select("entity_id", "period", "severity", "value")
    return own.join(F.broadcast(declared), ["entity_id", "severity"]).withColumn("id", F.concat_ws(":", F.lit("MTTR"), "severity", "period"))


def kpi_gaps(t: Tables) -> DataFrame:
    """By how much measured times exceed declared ones, each by the number of alerts."""
    stats = kpi_rows(t).groupBy("entity_id").agg(F.sum("n").alias("population"), (F.sum("us") / 60e6 / F.sum("n")).alias("found"), (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("said"), F.count("*").alias("hits"))
    return stats.withColumn("gap", (F.col("found") - F.col("said")) / F.greatest("said", F.lit(1.0)))


def eg10(t: Tables, p: Params = BASE["EG10"]) -> DataFrame:
    """Measured times to resolve are longer than declared ones."""
    stats = kpi_gaps(t).filter((F.col("gap") > p["mttr_gap_ratio_threshold"]) & (F.col("found") != 0) & (F.col("said") != 0)).withColumn("distance", F.col("gap") / 0.5)
    return finding("EG10", stats, "critical", first_ids(kpi_rows(t), "id", 10))


def eg11(t: Tables, p: Params = BASE["EG11"]) -> DataFrame:
    """No true positive among many alerts, or far more false ones than peers have."""
    per = t.alert.groupBy("entity_id").agg(F.count("*").alias("population"), F.count_if(F.col("disposition") == "true_positive").alias("tp"), F.count_if(F.col("disposition").isin("false_positive", "benign")).alias("hits"))
    per = per.filter(F.col("population") >= p["min_alert_volume"]).withColumn("rate", F.col("hits") / F.col("population").cast("double"))
    cohort = median_mad(bridge(t).join(per.select(F.col("entity_id").alias("peer_id"), "rate"), "peer_id"), "entity_id", "rate")
    stats = per.join(cohort, "entity_id", "left").withColumn("z", robust_z(F.col("rate"), F.col("med"), F.col("mad"), p["min_spread"], F.coalesce("n", F.lit(0))))
    stats = stats.filter((F.col("tp") == 0) | (F.col("z") >= p["max_robust_z"]) | (F.col("z").isNull() & (F.col("rate") > p["max_fp_rate"]))).withColumn("distance", F.col("rate") / 0.98)
    rank = F.when(F.col("severity_final") == "critical", 0).when(F.col("severity_final") == "high", 1).otherwise(2)
    return finding("EG11", stats, "high", first_ids(t.alert.join(F.broadcast(stats.select("entity_id")), "entity_id", "left_semi"), "alert_id", 10, [rank]))


def eg12(t: Tables, p: Params = BASE["EG12"]) -> DataFrame:
    base = t.soc_case.filter("severity = 'critical'")
    done = t.workflow_event.filter("ref_type = 'case' and action = 'contain'").select("entity_id", F.col("ref_id").alias("case_id"))
    return counted("EG12", base, base.join(done, ["entity_id", "case_id"], "left_anti"), "case_id", 2.0, p["min_skipped_cases"], "high", None)


def telemetry(t: Tables) -> DataFrame:
    """entity_id, asset_id, since, until, heard, quiet: the first and last day of an asset's telemetry, and whether one of its rows is
    above 0 or isn't. Derived once a session."""
    if t.derived and not t.changed:
        return t.derived("telemetry")
    return t.once("telemetry", lambda: by_asset(t, [F.lit(True)])).select("entity_id", "asset_id", "t0.*").drop("inside")


def by_asset(t: Tables, known: list[Column]) -> DataFrame:
    """entity_id, asset_id and for each condition of telemetry rows a struct t0, t1, ...: inside (some row meets it), since, until, heard and
    quiet of the rows that do."""
    one = lambda c: {"inside": F.bool_or(c), "since": F.min(F.when(c, F.col("date"))), "until": F.max(F.when(c, F.col("date"))), "heard": F.bool_or(c & (F.col("event_count") > 0)), "quiet": F.bool_or(c & (F.col("event_count") <= 0))}
    return t.log_source_daily.groupBy("entity_id", "asset_id").agg(*[F.struct(*[v.alias(n) for n, v in one(c).items()]).alias(f"t{k}") for k, c in enumerate(known)])


def silent_days(t: Tables) -> DataFrame:
    """entity_id, asset_id, criticality, days: monitored assets and their days without telemetry while in service."""
    assets = t.asset.filter("monitored_flag")
    # A day's sum is 0 only where one of its rows is 0 or less: days of assets without such a row aren't summed.
    log = t.log_source_daily.select("entity_id", "asset_id", "date", "event_count")
    quiet = t.once("quiet_assets", lambda: telemetry(t).filter("quiet").select("entity_id", "asset_id"))
    # Days of one asset stay together, so no further shuffle is needed for its days.
    days = log.join(quiet, ["entity_id", "asset_id"], "left_semi").repartition("entity_id", "asset_id").groupBy("entity_id", "asset_id", "date").agg(F.sum("event_count").alias("n")).filter("n = 0")
    silent = days.join(assets, ["entity_id", "asset_id"]).filter("(in_service_from is null or date >= in_service_from) and (in_service_to is null or date <= in_service_to)")
    return silent.groupBy("entity_id", "asset_id", "criticality").agg(F.count("*").alias("days"))


def ns01(t: Tables, p: Params = BASE["NS01"]) -> DataFrame:
    """Monitored critical assets without telemetry for three days or more while in service."""
    silent = silent_days(t).filter((F.col("criticality") >= p["min_asset_criticality"]) & (F.col("days") >= p["min_silent_days"]))
    stats = silent.groupBy("entity_id").agg(F.count("*").alias("hits"), F.count("*").alias("population"), (F.max("days") / float(p["min_silent_days"])).alias("distance"))
    return finding("NS01", stats, "critical", first_ids(silent, "asset_id", None))


def peer_categories(t: Tables) -> tuple[DataFrame, DataFrame]:
    """entity_id, category, n and peers: how many of the entity's reporting peers report a category; and what each entity reports."""
    have = t.alert.filter("category is not null").select("entity_id", "category").distinct()
    totals = t.alert.groupBy("entity_id").agg(F.count("*").alias("population"))
    peers = bridge(t).join(totals.select(F.col("entity_id").alias("peer_id")), "peer_id", "left_semi").join(totals.select("entity_id"), "entity_id", "left_semi")
    size = peers.groupBy("entity_id").agg(F.count("*").alias("peers"))
    common = peers.join(have.withColumnRenamed("entity_id", "peer_id"), "peer_id").groupBy("entity_id", "category").agg(F.count("*").alias("n"))
    return common.join(size, "entity_id"), have


def ns02(t: Tables, p: Params = BASE["NS02"]) -> DataFrame:
    """Alert categories that three peers in five report and the entity doesn't."""
    common, have = peer_categories(t)
    totals = t.alert.groupBy("entity_id").agg(F.count("*").alias("population"))
    missing = common.filter(F.col("n") >= F.greatest(F.lit(1), F.ceil(p["min_peer_share"] * F.col("peers") - 1e-9))).join(have, ["entity_id", "category"], "left_anti")
    stats = totals.join(missing.groupBy("entity_id").agg(F.count("*").alias("hits")), "entity_id").withColumn("distance", F.col("hits") / 1.5)
    return finding("NS02", stats, "high", first_ids(missing, "category", None))


def valid_zones(t: Tables) -> DataFrame:
    """entity_id and zone: the entity's, if the platform knows it, else UTC."""
    known = t.spark.createDataFrame([(z,) for z in sorted(available_timezones() - {"Factory", "localtime"})], "zone string")
    e = t.entity.select("entity_id", F.trim("timezone").alias("zone")).join(F.broadcast(known.withColumn("known", F.lit(True))), "zone", "left")
    return e.select("entity_id", F.when(F.col("known"), F.col("zone")).otherwise("UTC").alias("zone"))


def local_alerts(t: Tables, only: DataFrame | None = None) -> DataFrame:
    """Alerts with their local time; only: of these entities (few)."""
    local = F.convert_timezone(F.lit("UTC"), F.col("zone"), F.col("created_at"))
    alerts = t.alert if only is None else t.alert.join(F.broadcast(only), "entity_id", "left_semi")
    a = alerts.select("entity_id", "alert_id", "created_at").join(F.broadcast(valid_zones(t)), "entity_id").withColumn("local", local)
    return a.withColumn("night", (F.hour("local") < 8) | (F.hour("local") >= 20))


def month(column: str = "created_at") -> Column:
    """A month's first day: found faster than its name, which is told of few rows then."""
    return F.trunc(F.to_date(column), "month")


def local_counts(t: Tables) -> DataFrame:
    """Alerts by entity and month of their UTC time: all, those at local night, those on a local weekend. Alerts without a
    time have no month. Derived once a session."""
    counts = [F.count("*").alias("alerts"), F.count_if("night").alias("night"), F.count_if(F.dayofweek("local").isin(1, 7)).alias("weekend")]
    return t.once("local_counts", lambda: local_alerts(t).groupBy("entity_id", "zone", month().alias("month")).agg(*counts).withColumn("month", F.date_format("month", "yyyy-MM")))


def ns03(t: Tables, p: Params = BASE["NS03"]) -> DataFrame:
    """Far fewer alerts at night than peers have. Evidence: the five latest at night and the last of each of the ten latest
    local days."""
    per = local_counts(t).groupBy("entity_id").agg(F.sum("alerts").alias("population"), F.sum("night").alias("hits")).filter(F.col("population") >= p["min_alert_volume"]).withColumn("rate", F.col("hits") / F.col("population").cast("double"))
    cohort = median_mad(bridge(t).join(per.select(F.col("entity_id").alias("peer_id"), "rate"), "peer_id"), "entity_id", "rate")
    stats = per.join(cohort, "entity_id", "left").withColumn("z", robust_z(F.col("rate"), F.col("med"), F.col("mad"), p["min_spread"], F.coalesce("n", F.lit(0))))
    stats = stats.filter((F.col("z") <= -p["max_robust_z"]) | (F.col("z").isNull() & (F.col("rate") < p["max_night_share"]))).withColumn("distance", F.lit(2.0))
    near = local_alerts(t, stats.select("entity_id")).filter("local is not null")
    last = [F.desc("created_at"), F.col("alert_id")]
    nights = near.filter("night").withColumn("n", F.row_number().over(Window.partitionBy("entity_id").orderBy(*last))).filter("n <= 5")
    ends = near.withColumn("k", F.row_number().over(Window.partitionBy("entity_id", F.to_date("local")).orderBy(*last))).filter("k = 1")
    days = ends.withColumn("n", F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc(F.to_date("local"))))).filter("n <= 10")
    pick = lambda df, kind: df.select("entity_id", "alert_id", F.struct(F.lit(kind).alias("kind"), "n").alias("at"))
    both = pick(nights, 0).unionByName(pick(days, 1)).groupBy("entity_id", "alert_id").agg(F.min("at").alias("at"))
    return finding("NS03", stats, "high", first_ids(both, "alert_id", None, [F.col("at")]))


def ns04(t: Tables, p: Params = BASE["NS04"]) -> DataFrame:
    base = t.alert.filter(F.col("severity_final").isin(*HIGH) & (F.col("disposition") == "true_positive"))
    return counted("NS04", base, base.join(t.case_alert_link, ["entity_id", "alert_id"], "left_anti"), "alert_id", 3.0, p["min_tp_without_case"], over(75, "critical", "high"), 5)


def ns05(t: Tables, p: Params = BASE["NS05"]) -> DataFrame:
    """Enabled rules that never fire."""
    base = t.detection_rule.filter("enabled")
    dormant = base.join(t.alert.select("entity_id", "rule_id").distinct(), ["entity_id", "rule_id"], "left_anti")
    stats = base.groupBy("entity_id").agg(F.count("*").alias("population")).join(dormant.groupBy("entity_id").agg(F.count("*").alias("hits")), "entity_id")
    stats = stats.filter(too_many(p["min_dormant_rules"], p["max_dormant_share"])).withColumn("distance", F.col("hits") / F.col("population") / 0.4)
    return finding("NS05", stats, "medium", first_ids(dormant, "rule_id", 10))


def ghosts(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Assets in service, and those of them that neither alert nor send telemetry."""
    span = telemetry(t).groupBy("entity_id").agg(F.min("since").alias("since"), F.max("until").alias("until"))
    span = span.groupBy(scope().alias("scope")).agg(F.min("since").alias("since"), F.max("until").alias("until"))
    base = t.asset.withColumn("scope", scope()).join(F.broadcast(span), "scope", "left").filter("(in_service_from is null or in_service_from <= until) and (in_service_to is null or in_service_to >= since)")
    heard = telemetry(t).filter("heard").select("entity_id", "asset_id")
    return base, base.join(heard, ["entity_id", "asset_id"], "left_anti").join(alert_pairs(t).select("entity_id", "asset_id"), ["entity_id", "asset_id"], "left_anti")


def ns06(t: Tables, p: Params = BASE["NS06"]) -> DataFrame:
    """Assets in service that neither alert nor send telemetry."""
    return counted("NS06", *ghosts(t), "asset_id", 2.0, p["min_ghost_assets"], "high", None)


def ns07(t: Tables, p: Params = BASE["NS07"]) -> DataFrame:
    base = t.soc_case.filter("severity = 'critical'")
    hits = base.join(t.external_report.select("entity_id", F.col("incident_id").alias("case_id")), ["entity_id", "case_id"], "left_anti")
    stats = hits.groupBy("entity_id").agg(F.count("*").alias("hits"), F.count("*").alias("population")).filter(F.col("hits") >= p["min_unreported"]).withColumn("distance", F.col("hits").cast("double"))
    return finding("NS07", stats, "critical", first_ids(hits, "case_id", None))


def own_months(t: Tables) -> DataFrame:
    """scope, entity_id, month: the months in which an entity has alerts, derived once a session."""
    months = lambda: t.alert.select("entity_id", month().alias("month")).distinct().select(scope().alias("scope"), "entity_id", F.date_format("month", "yyyy-MM").alias("month"))
    return t.once("own_months", months)


def ns08(t: Tables, p: Params = BASE["NS08"]) -> DataFrame:
    """Months in which others report and the entity doesn't."""
    period = p["review_period_months"]
    own = own_months(t)
    months = own.select("scope", "month").distinct()
    alone = own.groupBy("scope").agg(F.countDistinct("entity_id").alias("entities"))  # nobody to compare an only entity with
    expected = months.groupBy("scope").agg(F.count("*").alias("months")).join(alone, "scope").select("scope", F.when(F.col("entities") == 1, period).otherwise(F.least(F.lit(period), "months")).alias("expected"))
    missing = own.select("scope", "entity_id").distinct().join(F.broadcast(months), "scope").join(own.select("entity_id", "month"), ["entity_id", "month"], "left_anti")
    stats = own.groupBy("scope", "entity_id").agg(F.count("*").alias("n")).join(F.broadcast(expected), "scope").filter("n < expected").withColumn("hits", F.col("expected") - F.col("n"))
    stats = stats.withColumns({"population": F.lit(10), "distance": F.col("hits") / 2.0})
    return finding("NS08", stats, "high", first_ids(missing, "month", None))


def hits(t: Tables) -> dict[str, DataFrame]:
    """The records that rules count: entity_id and more, for the rules that fire at a number of them."""
    key = ["entity_id", "alert_id"]
    serious = t.alert.filter(F.col("severity_final").isin(*HIGH) & (F.col("disposition") == "true_positive"))
    contained = t.workflow_event.filter("ref_type = 'case' and action = 'contain'").select("entity_id", F.col("ref_id").alias("case_id"))
    return {
        "EG08": t.escalation.filter("acknowledged_at is null"), "EG12": t.soc_case.filter("severity = 'critical'").join(contained, ["entity_id", "case_id"], "left_anti"),
        "NS04": serious.join(t.case_alert_link, key, "left_anti"), "NS05": t.detection_rule.filter("enabled").join(t.alert.select("entity_id", "rule_id").distinct(), ["entity_id", "rule_id"], "left_anti"), "NS06": ghosts(t)[1],
    }


RULES = {f.__name__.upper(): f for f in (eg01, eg02, eg03, eg04, eg05, eg06, eg07, eg08, eg09, eg10, eg11, eg12, ns01, ns02, ns03, ns04, ns05, ns06, ns07, ns08)}


def findings(t: Tables) -> DataFrame:
    """The findings of all rules, derived once a session: scores, queues and states all start from them."""
    return t.union_once("findings", [partial(rule, t) for rule in RULES.values()])


def proposal(changes: dict[str, Params]) -> str:
    """The name under which what follows from some changes is kept."""
    said = "-".join(f"{r}_{k}_{v}" for r in sorted(changes) for k, v in sorted(changes[r].items()))
    return f"proposed-{md5(said.encode()).hexdigest()[:12]}"


def proposed(t: Tables, changes: dict[str, Params]) -> DataFrame:
    """The findings that the rules would make with some parameters changed, without evidence; derived once a session. Rules that keep theirs
    keep their findings."""

    def again(rule: str) -> DataFrame:
        # Entities are distinct; saying so lets the join with evidence, which nobody asks for here, go.
        return RULES[rule](t, BASE[rule] | changes[rule]).drop("evidence").distinct()

    stay = [r for r in RULES if r not in changes]
    makes = [partial(again, r) for r in RULES if r in changes]
    if stay:
        makes.append(lambda: findings(t).filter(F.col("rule_id").isin(*stay)).drop("evidence"))
    return t.union_once(proposal(changes), makes)
