"""What each rule needs before its silence means anything, and the state of every rule for every entity.

States: not_applicable (by a decision), insufficient_evidence (a table is lacking, or too few records), finding, degraded (a
column holds no usable value, so the rule can't fire), assessed_clear.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarsia.operators.rules import DOMAINS, RULES, WEIGHTS, findings
from tarsia.sources.projection import Tables

# Tables that a rule rests on beside alerts, rules that read no alerts, columns of alerts that it rests on, and
# the table whose rows are its population where that is not alerts.
NEEDS = {
    "EG01": ("workflow_event",), "EG02": ("workflow_event", "closure"), "EG03": ("escalation",), "EG04": ("closure",), "EG05": ("remediation",), "EG06": ("sla_policy",), "EG08": ("escalation",), "EG09": ("soc_case",),
    "EG10": ("declared_kpi",), "EG12": ("soc_case", "workflow_event"), "NS01": ("asset", "log_source_daily"), "NS04": ("case_alert_link",), "NS05": ("detection_rule",), "NS06": ("asset", "log_source_daily"), "NS07": ("soc_case", "external_report"),
}
ALERT_FREE = ("EG08", "EG09", "EG12", "NS01", "NS07")
FIELDS = {
    "EG01": ("severity_final", "closed_at"), "EG02": ("closed_at",), "EG03": ("severity_final", "disposition"), "EG04": ("closed_at",), "EG05": ("rule_id", "asset_id", "disposition"), "EG06": ("severity_final", "closed_at", "closed_by"),
    "EG07": ("closed_at", "closed_by"), "EG10": ("severity_final", "closed_at"), "EG11": ("disposition",), "NS02": ("category",), "NS04": ("severity_final", "disposition"), "NS05": ("rule_id",), "NS06": ("asset_id",),
}
POPULATION = {"EG08": "escalation", "EG09": "soc_case", "EG12": "soc_case", "NS01": "asset", "NS07": "soc_case"}
ASSESSED = ("finding", "assessed_clear")


def tables_of(rule: str) -> tuple[str, ...]:
    return (() if rule in ALERT_FREE else ("alert",)) + NEEDS.get(rule, ())


TABLES = tuple(sorted({x for r in RULES for x in tables_of(r)}))
COLUMNS = tuple(sorted({c for cs in FIELDS.values() for c in cs}))


def texts(values: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def sizes(t: Tables) -> DataFrame:
    """entity_id and sizes: the number of rows in each table that has some."""
    each = [getattr(t, n).groupBy("entity_id").agg(F.lit(n).alias("tab"), F.count("*").alias("n")) for n in TABLES]
    return reduce(DataFrame.unionByName, each).groupBy("entity_id").agg(F.map_from_entries(F.collect_list(F.struct("tab", "n"))).alias("sizes"))


def unusable(t: Tables) -> DataFrame:
    """entity_id and unusable: columns of alerts in which none of its alerts says anything."""
    says = {c: F.col(c).isNotNull() & (~F.lower(F.col(c).cast("string")).isin("unknown", "unmapped", "") if c in ("disposition", "severity_final") else F.lit(True)) for c in COLUMNS}
    none = F.array(*[F.when(F.count_if(v) == 0, F.lit(c)) for c, v in says.items()])
    return t.alert.groupBy("entity_id").agg(F.array_compact(none).alias("unusable"))


def inputs(t: Tables) -> DataFrame:
    """entity_id, rule_id, domain, missing (tables), blind (columns of alerts), population, least: what each rule has to go by."""
    rule = [F.struct(F.lit(r).alias("rule_id"), F.lit(DOMAINS[r]).alias("domain"), texts(tables_of(r)).alias("needs"), texts(FIELDS.get(r, ())).alias("fields"), F.lit(POPULATION.get(r, "alert")).alias("tab"), F.lit(WEIGHTS[r][1]).alias("least")) for r in RULES]
    e = t.entity.select("entity_id").join(sizes(t), "entity_id", "left").join(unusable(t), "entity_id", "left")
    e = e.withColumns({"sizes": F.coalesce("sizes", F.create_map().cast("map<string,bigint>")), "unusable": F.coalesce("unusable", texts(()))})
    rows = e.select("entity_id", "sizes", "unusable", F.inline(F.array(*rule)))
    return rows.select(
        "entity_id", "rule_id", "domain", F.array_except("needs", F.map_keys("sizes")).alias("missing"), F.array_intersect("fields", "unusable").alias("blind"),
        F.coalesce(F.try_element_at("sizes", "tab"), F.lit(0)).alias("population"), "least",
    )


def results(t: Tables, decisions: DataFrame | None = None, found: DataFrame | None = None) -> DataFrame:
    """entity_id, rule_id, domain, state, missing (inputs that are lacking, joined by commas), population. decisions: entity_id and
    rule_id of rules that are declared not to apply. found: findings to go by in place of the tables'."""
    found = (findings(t) if found is None else found).groupBy("entity_id").agg(F.collect_set("rule_id").alias("found"))
    rows = inputs(t).join(found, "entity_id", "left")
    if decisions is not None:
        rows = rows.join(decisions.select("entity_id", "rule_id").distinct().withColumn("off", F.lit(True)), ["entity_id", "rule_id"], "left")
    else:
        rows = rows.withColumn("off", F.lit(False))
    lacks, fires = F.size("missing") > 0, F.coalesce(F.array_contains("found", F.col("rule_id")), F.lit(False))
    state = F.when(F.col("off"), "not_applicable").when(lacks, "insufficient_evidence").when(fires, "finding").when(F.size("blind") > 0, "degraded")
    state = state.when(F.col("population") < F.col("least"), "insufficient_evidence").otherwise("assessed_clear")
    told = F.when(F.col("off"), "").when(lacks, F.array_join(F.sort_array("missing"), ",")).when(fires, "").otherwise(F.array_join(F.transform(F.sort_array("blind"), lambda c: F.concat(F.lit("alert."), c)), ","))
    return rows.select("entity_id", "rule_id", "domain", state.alias("state"), told.alias("missing"), "population")


def coverage(t: Tables, decisions: DataFrame | None = None, insufficient: float = 0.25, assessable: float = 0.9, found: DataFrame | None = None) -> DataFrame:
    """entity_id, assessed, applicable, coverage, level, requests: the share of applicable rules that could be assessed, what it
    makes of the entity, and the inputs to ask for, those that open most rules first."""
    r = results(t, decisions) if found is None else results(t, decisions, found)
    n = r.groupBy("entity_id").agg(F.count_if(F.col("state").isin(*ASSESSED)).alias("assessed"), F.count_if(F.col("state") != "not_applicable").alias("applicable"))
    ask = r.filter("missing <> ''").select("entity_id", F.explode(F.split("missing", ",")).alias("need")).groupBy("entity_id", "need").agg(F.count("*").alias("n"))
    ask = ask.groupBy("entity_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "need"))), lambda x: x["need"]), ",").alias("requests"))
    n = n.withColumn("coverage", F.when(F.col("applicable") > 0, F.bround(F.col("assessed") / F.col("applicable"), 4)).otherwise(0.0))
    level = F.when((F.col("applicable") == 0) | (F.col("coverage") < insufficient), "insufficient").when(F.col("coverage") >= assessable, "assessable").otherwise("partial")
    return n.withColumn("level", level).join(ask, "entity_id", "left").withColumn("requests", F.coalesce("requests", F.lit("")))
