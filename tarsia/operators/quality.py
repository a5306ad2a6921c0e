"""Issues of submitted tables with their severity and samples, and silence of assets that maintenance explains."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarsia.operators.ingest import with_faults
from tarsia.operators.rules import finding, first_ids
from tarsia.sources.projection import Tables

# Severity of checks, the tables' references, the gap of numbers and the rate of blanks that count, samples.
SEVERITY = {"missing_required_field": "error", "duplicate_primary_keys": "error", "close_before_create": "error", "unrecognised_value": "error", "orphan_foreign_keys": "error", "id_sequence_gap": "warning", "high_null_rate": "warning"}
RELATIONS = (("alert", "asset_id", "asset", "asset_id"), ("closure", "ref_id", "alert", "alert_id"), ("workflow_event", "ref_id", "alert", "alert_id"), ("escalation", "ref_id", "alert", "alert_id"), ("case_alert_link", "alert_id", "alert", "alert_id"), ("case_alert_link", "case_id", "soc_case", "case_id"))
GAP, LEAST_NUMBERS, BLANK_RATE, SAMPLES, BUCKET = 50, 20, 0.15, 5, 1024


def blank(c: str) -> Column:
    return F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")


def orphans(t: Tables) -> DataFrame:
    """entity_id, check, tab, sample: references to records that the entity didn't submit. A null reference is one; an empty text is
    none. Where an entity has no record that could be referred to, nothing is told. All relations meet all parents in one join."""
    refs = []
    for child, column, parent, _ in RELATIONS:
        rows = getattr(t, child)
        rows = rows.filter("ref_type = 'alert'") if child == "workflow_event" else rows
        own = F.coalesce(F.col("alert_id") if child == "alert" else F.col(column), F.lit("None"))
        refs.append(rows.select("entity_id", F.lit(f"{child}:{column}").alias("tab"), F.lit(parent).alias("parent"), F.col(column).alias("id"), own.alias("sample")))
    parents = [getattr(t, p).filter(~blank(c)).select("entity_id", F.lit(p).alias("parent"), F.col(c).alias("id")) for p, c in {(p, c) for _, _, p, c in RELATIONS}]
    known = reduce(DataFrame.unionByName, parents).distinct()
    every = reduce(DataFrame.unionByName, refs).filter("id is null or id <> ''").join(known.select("entity_id", "parent").distinct(), ["entity_id", "parent"], "left_semi")
    return every.join(known, ["entity_id", "parent", "id"], "left_anti").select("entity_id", F.lit("orphan_foreign_keys").alias("check"), "tab", "sample")


def gaps(t: Tables) -> DataFrame:
    """Jumps of over GAP between the numbers at the end of an entity's alert ids, of which it has over LEAST_NUMBERS. Numbers are
    ordered within ranges of BUCKET; of a range only its ends are ordered with those of others."""
    k = F.regexp_extract("alert_id", "([0-9]{1,18})$", 1).try_cast("long")
    numbers = t.alert.select("entity_id", k.alias("k")).filter("k is not null").groupBy("entity_id", F.expr(f"k div {BUCKET}").alias("b"), "k").agg(F.count("*").alias("n"))
    inner = numbers.withColumn("a", F.lag("k").over(Window.partitionBy("entity_id", "b").orderBy("k"))).filter(F.col("k") - F.col("a") > GAP).select("entity_id", "a", "k")
    ends = numbers.groupBy("entity_id", "b").agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.sum("n").alias("n"))
    order = Window.partitionBy("entity_id").orderBy("b")
    outer = ends.select("entity_id", F.lag("hi").over(order).alias("a"), F.col("lo").alias("k")).filter(F.col("k") - F.col("a") > GAP)
    many = ends.groupBy("entity_id").agg(F.sum("n").alias("n")).filter(F.col("n") > LEAST_NUMBERS).select("entity_id")
    text = F.concat(F.lpad("a", 19, "0"), F.lit("|"), F.col("a").cast("string"), F.lit("->"), F.col("k").cast("string"), F.lit(" (diff="), (F.col("k") - F.col("a")).cast("string"), F.lit(")"))
    return inner.unionByName(outer).join(many, "entity_id", "left_semi").select("entity_id", F.lit("id_sequence_gap").alias("check"), F.lit("alert").alias("tab"), text.alias("sample"))


def alert_hits(t: Tables) -> DataFrame:
    """Alerts in which a field is lacking, a word unknown or the order of times wrong, and keys that come again."""
    a = t.alert
    own = F.coalesce("alert_id", F.lit("None"))
    fields = [("missing_required_field", c, blank(c)) for c in ("alert_id", "created_at", "severity_final")] + [("unrecognised_value", c, F.coalesce(F.col(c) == "unmapped", F.lit(False))) for c in ("severity_orig", "severity_final", "status", "disposition")]
    fields.append(("close_before_create", "closed_at", F.coalesce(F.col("closed_at") < F.col("created_at"), F.lit(False))))
    each = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(check).alias("check"), F.lit(f"alert:{name}").alias("tab"))) for check, name, c in fields]))
    rows = a.select("entity_id", own.alias("sample"), F.explode(each).alias("x")).select("entity_id", "x.check", "x.tab", "sample")
    twice = a.filter(~blank("alert_id")).groupBy("entity_id", "alert_id").agg(F.count("*").alias("n")).filter("n > 1")
    return rows.unionByName(twice.select("entity_id", F.lit("duplicate_primary_keys").alias("check"), F.lit("alert:alert_id").alias("tab"), F.col("alert_id").alias("sample")))


def null_rates(t: Tables) -> DataFrame:
    columns = ("rule_id", "asset_id", "closed_by", "disposition")
    n = t.alert.groupBy("entity_id").agg(F.count("*").alias("all"), *[F.count_if(blank(c)).alias(c) for c in columns])
    long = n.unpivot(["entity_id", "all"], list(columns), "column", "n").filter(F.col("n") / F.col("all") > BLANK_RATE)
    return long.select("entity_id", F.lit("high_null_rate").alias("check"), F.concat(F.lit("alert:"), "column").alias("tab"), "n")


def issues(t: Tables) -> DataFrame:
    """entity_id, check, tab (table and column), severity, n, samples (of each the first five in order)."""
    key = ["entity_id", "check", "tab"]
    hits = alert_hits(t).unionByName(orphans(t)).unionByName(gaps(t))
    counts = hits.groupBy(*key).agg(F.count("*").alias("n"))
    first = hits.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy("sample"))).filter(F.col("k") <= SAMPLES)
    shown = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "sample"))), lambda x: F.regexp_replace(x["sample"], r"^\d{19}\|", "")), "; ")
    out = counts.join(first.groupBy(*key).agg(shown.alias("samples")), key).unionByName(null_rates(t).withColumn("samples", F.lit("")))
    severity = F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])[F.col("check")]
    return out.select(*key, severity.alias("severity"), "n", "samples")


def torn(t: Tables) -> Tables:
    """The tables with faulty alerts, and with references that lead nowhere: closures without one, escalations and links of records that
    weren't submitted, an entity whose cases weren't."""
    out = with_faults(t)
    k = lambda c: F.substring(c, 2, 8).try_cast("long")
    e = F.substring("entity_id", 2, 2).cast("int")
    out.closure = t.closure.withColumn("ref_id", F.when((e % 5 == 4) & (k("ref_id") % 70 == 0), None).when((e % 5 == 0) & (k("ref_id") % 90 == 0), "").otherwise(F.col("ref_id")))
    out.escalation = t.escalation.withColumn("ref_id", F.when(k("ref_id") % 3 == 0, F.concat(F.lit("Z"), "ref_id")).otherwise(F.col("ref_id")))
    out.workflow_event = t.workflow_event
    out.soc_case = t.soc_case.filter((e != 7) & (k("case_id") % 4 != 0))
    return out


# Maintenance


def maintenance(t: Tables) -> DataFrame:
    """entity_id, asset_id (null: all), starts_on, ends_on (null: open): windows of a third of the assets, some that overlap, some
    without an end, and one of a whole entity in each of a few."""
    k = F.substring_index("asset_id", "-", -1).try_cast("long")
    a = t.asset.filter("asset_id like 'AST-%'").select("entity_id", "asset_id", k.alias("k"))
    day = lambda d: F.lit(f"2026-06-{d:02d}").cast("date")
    none = F.lit(None).cast("date")
    one = a.filter("k % 3 = 0").select("entity_id", "asset_id", day(7).alias("starts_on"), day(8).alias("ends_on"))
    two = a.filter("k % 6 = 0").select("entity_id", "asset_id", day(8).alias("starts_on"), day(9).alias("ends_on"))
    open_ = a.filter("k % 9 = 0").select("entity_id", "asset_id", day(9).alias("starts_on"), none.alias("ends_on"))
    whole = t.entity.filter(F.substring("entity_id", 2, 2).cast("int") % 17 == 0).select("entity_id", F.lit(None).cast("string").alias("asset_id"), day(6).alias("starts_on"), day(6).alias("ends_on"))
    return reduce(DataFrame.unionByName, [one, two, open_, whole])


def maintained(days: DataFrame, windows: DataFrame) -> DataFrame:
    """The rows of days (entity_id, asset_id, date) that a window covers. Windows are laid on the months they touch, up to the last
    day there is, so that a day meets the windows of its month only; then the days decide."""
    last = days.agg(F.max("date").alias("last"))
    until = F.least(F.coalesce("ends_on", "last"), "last")
    laid = windows.join(F.broadcast(last)).withColumn("until", until).filter("starts_on <= until")
    laid = laid.withColumn("month", F.explode(F.sequence(F.trunc("starts_on", "month"), F.trunc("until", "month"), F.expr("interval 1 month"))))
    by_month = days.withColumn("month", F.trunc("date", "month"))
    inside = F.col("date").between(F.col("starts_on"), F.col("until"))
    w = laid.select("entity_id", F.col("asset_id").alias("w_asset"), "month", "starts_on", "until")
    of_asset = by_month.withColumn("w_asset", F.col("asset_id")).join(w.filter("w_asset is not null"), ["entity_id", "w_asset", "month"]).filter(inside)
    of_entity = by_month.join(w.filter("w_asset is null"), ["entity_id", "month"]).filter(inside)
    return of_asset.select("entity_id", "asset_id", "date").unionByName(of_entity.select("entity_id", "asset_id", "date")).distinct()


def silence(t: Tables, windows: DataFrame) -> DataFrame:
    """entity_id, asset_id, silent (days without events in service and outside maintenance), explained (those that it covers) of
    monitored critical assets."""
    assets = t.asset.filter("monitored_flag and criticality >= 3").select("entity_id", "asset_id", "in_service_from", "in_service_to")
    days = t.log_source_daily.groupBy("entity_id", "asset_id", "date").agg(F.sum("event_count").alias("n")).filter("n = 0").join(assets, ["entity_id", "asset_id"])
    off = maintained(days.select("entity_id", "asset_id", "date"), windows).withColumn("off", F.lit(True))
    served = F.expr("(in_service_from is null or date >= in_service_from) and (in_service_to is null or date <= in_service_to)")
    rows = days.withColumn("served", served).join(off, ["entity_id", "asset_id", "date"], "left")
    return rows.groupBy("entity_id", "asset_id").agg(F.count_if(F.col("served") & F.col("off").isNull()).alias("silent"), F.count_if(F.col("off")).alias("explained"))


def silent_assets(t: Tables, least: int = 3) -> DataFrame:
    return silence(t, maintenance(t)).withColumn("fires", F.col("silent") >= least)


def ns01_maintained(t: Tables) -> DataFrame:
    """The finding of silent assets once maintenance is known."""
    silent = silent_assets(t).filter("fires")
    stats = silent.groupBy("entity_id").agg(F.count("*").alias("hits"), F.count("*").alias("population"), (F.max("silent") / 3.0).alias("distance"))
    return finding("NS01", stats, "critical", first_ids(silent, "asset_id", None))


QUERIES = {"dq_issues_sampled": lambda t: issues(torn(t)), "silent_assets_maintenance": silent_assets, "ns01_with_maintenance": ns01_maintained}
