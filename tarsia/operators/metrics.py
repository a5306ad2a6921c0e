"""Aggregates over alerts and their workflow, and page queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarsia.functions.stats import median, micros, seconds_between
from tarsia.operators.rules import HIGH
from tarsia.sources.projection import Tables



def since_created(column: str):
    return seconds_between(F.col(column), F.col("created_at"))


def timing(t: Tables) -> DataFrame:
    rows = t.alert.filter("closed_at >= created_at")
    q = lambda p: F.percentile(since_created("closed_at"), F.lit(p))
    return rows.groupBy("entity_id", "severity_final", "closed_by_type").agg(
        F.count("*").alias("n"), median(since_created("acknowledged_at")).alias("median_ack"), median(since_created("first_touch_at")).alias("median_touch"),
        q(0.05).alias("p5_close"), q(0.5).alias("p50_close"), q(0.95).alias("p95_close"),
    )


def workflow(t: Tables) -> DataFrame:
    events = t.workflow_event.filter("ref_type = 'alert'").groupBy("entity_id", F.col("ref_id").alias("alert_id")).agg(F.count("*").alias("n"), F.count_if(F.col("action") == "investigate").alias("looked"))
    rows = t.alert.select("entity_id", "alert_id", "closed_by_type").join(events, ["entity_id", "alert_id"], "left").fillna(0, ["n", "looked"])
    return rows.groupBy("entity_id", "closed_by_type").agg(F.count("*").alias("alerts"), F.avg("n").alias("events_per_alert"), F.avg((F.col("n") <= 1).cast("int")).alias("share_thin"), F.avg((F.col("looked") == 0).cast("int")).alias("share_unlooked"))


def sweep(t: Tables) -> DataFrame:
    """entity_id, metric, value: counts and mean durations by severity, disposition and closer, volume by hour, categories."""
    groups = t.alert.groupBy("entity_id", F.concat_ws(":", "severity_final", "disposition", "closed_by_type").alias("g")).agg(
        F.count("*").alias("n"), (F.sum(micros(F.col("closed_at")) - micros(F.col("created_at"))) / 1e6 / F.count("closed_at")).alias("mean"))
    out = [groups.select("entity_id", F.concat(F.lit("count:"), "g").alias("metric"), F.col("n").cast("double").alias("value")), groups.filter("mean is not null").select("entity_id", F.concat(F.lit("mean_close:"), "g").alias("metric"), F.bround("mean", 3).alias("value"))]
    for name, key in (("hour:", F.lpad(F.hour("created_at").cast("string"), 2, "0")), ("category:", F.col("category"))):
        out.append(t.alert.groupBy("entity_id", F.concat(F.lit(name), key).alias("metric")).agg(F.count("*").cast("double").alias("value")))
    return reduce(DataFrame.unionByName, out)


def mtta_mttr(t: Tables) -> DataFrame:
    return t.alert.groupBy("entity_id", "severity_final").agg(
        F.count("*").alias("n"), median(since_created("closed_at") / 60).alias("mttr_min"), median(since_created("acknowledged_at") / 60).alias("mtta_min"),
        (100.0 * F.count_if(F.col("disposition") == "false_positive") / F.count("*")).alias("fp_pct"), (100.0 * F.count_if(F.col("closed_by_type") == "automation") / F.count("*")).alias("soar_pct"),
    )


def kpi_reconciliation(t: Tables) -> DataFrame:
    own = t.alert.filter("closed_at >= created_at").groupBy("entity_id", F.col("severity_final").alias("severity")).agg(F.count("*").alias("n"), F.sum(micros(F.col("closed_at")) - micros(F.col("created_at"))).alias("us"))
    both = t.declared_kpi.filter("metric = 'MTTR'").join(own, ["entity_id", "severity"])
    found = F.col("us") / 60e6 / F.col("n")
    return both.select("entity_id", "severity", "period", F.col("value").alias("declared"), F.bround(found, 4).alias("measured"), F.bround((found - F.col("value")) / F.greatest("value", F.lit(1.0)), 4).alias("gap"))


def usable(t: Tables) -> DataFrame:
    """For each text column of alerts: values that are there, that aren't blank, that say something."""
    columns = ["rule_id", "category", "asset_id", "closed_by", "closed_by_type", "disposition", "status", "playbook_id", "severity_final"]
    text = {c: F.lower(F.trim(F.col(c))) for c in columns}
    parts = []
    for c, v in text.items():
        parts.append(F.struct(F.lit(c).alias("column"), F.count(c).alias("n_present"), F.count_if(v != "").alias("n_filled"), F.count_if(~v.isin("", "unknown", "unmapped", "none", "null")).alias("n_usable")))
    return t.alert.groupBy("entity_id").agg(F.array(*parts).alias("p")).select("entity_id", F.inline("p"))


def search(t: Tables, text: str = "%R0%", severity: str = "high", page: int = 0, size: int = 25) -> DataFrame:
    """A page of matching alerts, newest first, with the number of all matches."""
    hit = t.alert.filter((F.col("severity_final") == severity) & (F.col("alert_id").like(text) | F.col("rule_id").like(text) | F.col("asset_id").like(text)))
    total = hit.agg(F.count("*").alias("total"))
    rows = hit.orderBy(F.desc("created_at"), "alert_id").offset(page * size).limit(size)
    return rows.join(F.broadcast(total)).select("entity_id", "alert_id", "rule_id", "asset_id", F.bround(since_created("closed_at") / 60, 1).alias("minutes"), "total")


def stats(t: Tables) -> DataFrame:
    return t.alert.agg(
        F.count("*").alias("total"), F.count_if(F.col("severity_final").isin(*HIGH)).alias("serious"), F.count_if(F.col("closed_by_type") == "automation").alias("automated"),
        (100.0 * F.count_if(F.col("disposition") == "false_positive") / F.greatest(F.count("*"), F.lit(1))).alias("fp_pct"),
    )


def monthly(t: Tables) -> DataFrame:
    """entity_id, month, alerts, per_day (over the days of the month that alerts cover) and shares where n >= 20."""
    span = t.alert.groupBy("entity_id").agg(F.min(F.to_date("created_at")).alias("since"), F.max(F.to_date("created_at")).alias("until"))
    m = t.alert.groupBy("entity_id", F.date_trunc("month", F.col("created_at").cast("timestamp")).cast("date").alias("m")).agg(
        F.count("*").alias("alerts"), F.count_if(F.col("disposition") == "true_positive").alias("tp"), F.count_if(F.col("closed_by_type") == "automation").alias("auto"))
    days = F.datediff(F.least(F.last_day("m"), "until"), F.greatest("m", "since")) + 1
    enough = lambda c: F.when(F.col("alerts") >= 20, F.col(c) / F.col("alerts"))
    return m.join(F.broadcast(span), "entity_id").select("entity_id", F.date_format("m", "yyyy-MM").alias("month"), "alerts", (F.col("alerts") / days).alias("per_day"), enough("tp").alias("tp_share"), enough("auto").alias("auto_share"))


def blind_signals(t: Tables) -> DataFrame:
    """What an examiner sees of an entity without its findings."""
    a = t.alert.groupBy("entity_id").agg(
        F.count("*").alias("alerts"), median(since_created("closed_at") / 60).alias("mttr_min"), (100.0 * F.avg((F.col("closed_by_type") == "automation").cast("int"))).alias("soar_pct"),
        F.count_if(F.col("severity_final").isin(*HIGH)).alias("serious"))
    kpi = t.declared_kpi.filter("metric = 'MTTR'").groupBy("entity_id").agg(F.max_by("value", F.struct("period", "severity")).alias("declared"))
    esc = t.escalation.groupBy("entity_id").agg(F.count("*").alias("escalations"))
    heard = t.log_source_daily.filter("event_count > 0").select("entity_id", "asset_id").distinct()
    quiet = t.asset.filter("criticality >= 3").join(heard, ["entity_id", "asset_id"], "left_anti").groupBy("entity_id").agg(F.count("*").alias("silent"))
    out = a.join(kpi, "entity_id", "left").join(esc, "entity_id", "left").join(quiet, "entity_id", "left").fillna(0, ["escalations", "silent"])
    return out.withColumn("esc_share", F.col("escalations") / F.nullif("serious", F.lit(0)))


def cusum_alarms(t: Tables) -> DataFrame:
    """Months in which an entity's daily volume leaves its first three months' level (two-sided sums)."""
    from tarsia.functions.stats import cusum

    m = monthly(t)
    n = Window.partitionBy("entity_id").orderBy("month")
    first = m.withColumn("n", F.row_number().over(n)).filter("n <= 3").groupBy("entity_id").agg(median(F.col("per_day")).alias("level"))
    z = m.join(F.broadcast(first), "entity_id").withColumn("z", (F.col("per_day") - F.col("level")) / F.greatest(0.1 * F.col("level"), F.lit(0.01)))
    return cusum(z, "entity_id", "month", "z").select("entity_id", "month", F.bround("up", 6).alias("up"), F.bround("down", 6).alias("down"), "alarm")
