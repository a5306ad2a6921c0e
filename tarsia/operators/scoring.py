"""From findings to domain scores, risk index, bands, rankings and the review queue."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarsia.functions.stats import median
from tarsia.operators.contracts import ASSESSED, coverage, results
from tarsia.operators.rules import DOMAINS, findings
from tarsia.sources.projection import Tables

# Weights of the eight domains, bands of the risk index and the least band of a severity.
DOMAIN_WEIGHTS = {
    "Threat Detection": 0.15, "Investigation": 0.15, "Escalation": 0.15, "Incident Response": 0.15, "Security Operations": 0.10, "Governance and Oversight": 0.15, "Operational Discipline": 0.075, "Cyber Resilience": 0.075,
}
BANDS = ((25.0, "low"), (50.0, "moderate"), (75.0, "high"))
QUEUE, TARGETED = 30, 0.7
SEED = 42


def with_domain(f: DataFrame) -> DataFrame:
    return f.withColumn("domain", F.create_map(*[F.lit(x) for kv in DOMAINS.items() for x in kv])[F.col("rule_id")])


def domain_scores(t: Tables, decisions: DataFrame | None = None, found: DataFrame | None = None) -> DataFrame:
    """entity_id, domain, score, n_findings, applicable, assessed, status for all eight domains: noisy-or of the findings' scores;
    without one 0, or null where no rule of the domain could be assessed (status unknown). found: findings to go by in place of the tables'."""
    given = {} if found is None else {"found": found}
    states = results(t, decisions, **given).groupBy("entity_id", "domain").agg(F.count_if(F.col("state") != "not_applicable").alias("applicable"), F.count_if(F.col("state").isin(*ASSESSED)).alias("assessed"))
    hit = with_domain(findings(t) if found is None else found).groupBy("entity_id", "domain").agg(F.product(1 - F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score") / 100.0))).alias("miss"), F.count("*").alias("n"))
    out = states.join(hit, ["entity_id", "domain"], "left")
    score = F.when(F.col("miss").isNotNull() | (F.col("assessed") > 0), F.bround(100.0 * (1 - F.coalesce("miss", F.lit(1.0))), 1))
    status = F.when(F.col("assessed") == 0, "unknown").when(F.col("assessed") == F.col("applicable"), "assessed").otherwise("partial")
    return out.select("entity_id", "domain", score.alias("score"), F.coalesce("n", F.lit(0)).alias("n_findings"), "applicable", "assessed", status.alias("status"))


LEVELS = ("low", "moderate", "high", "critical")


def risk_index(t: Tables, decisions: DataFrame | None = None, found: DataFrame | None = None) -> DataFrame:
    """entity_id, base (weighted mean of the known domains, 0 without any), n_rules, risk_index and band: that of the index, raised
    to the floor that the severest finding with a confidence of 0.5 or more sets; where too little could be assessed,
    the floor alone, else insufficient_evidence. found: findings to go by in place of the tables'."""
    given = {} if found is None else {"found": found}
    weights = F.create_map(*[F.lit(x) for kv in DOMAIN_WEIGHTS.items() for x in kv])
    base = domain_scores(t, decisions, **given).filter("score is not null").withColumn("w", weights[F.col("domain")]).groupBy("entity_id").agg(
        F.sum(F.round(F.col("w") * 1000).cast("long") * F.round(F.col("score") * 10).cast("long")).alias("points"), F.sum(F.round(F.col("w") * 1000).cast("long")).alias("w")
    )
    base = base.withColumn("base", F.col("points") / 10.0 / F.col("w"))  # whole numbers up to here, so the order of rows doesn't matter
    rules = (findings(t) if found is None else found).groupBy("entity_id").agg(F.countDistinct("rule_id").alias("n_rules"), F.max(F.when(F.col("confidence") >= 0.5, F.when(F.col("severity") == "critical", 2).when(F.col("severity") == "high", 1).otherwise(-1))).alias("floor"))
    out = t.entity.select("entity_id").join(base, "entity_id", "left").join(rules, "entity_id", "left").join(coverage(t, decisions, **given).select("entity_id", F.col("level").alias("known")), "entity_id", "left")
    out = out.withColumns({"base": F.coalesce("base", F.lit(0.0)), "n_rules": F.coalesce("n_rules", F.lit(0)), "floor": F.coalesce("floor", F.lit(-1))})
    out = out.withColumn("risk_index", F.bround((9.0 * F.col("base") + F.least(F.lit(100.0), 10.0 * F.col("n_rules"))) / 10.0, 1))
    level = F.when(F.col("risk_index") <= 25, 0).when(F.col("risk_index") <= 50, 1).when(F.col("risk_index") <= 75, 2).otherwise(3)
    named = lambda k: F.try_element_at(F.array(*map(F.lit, LEVELS)), k + 1)
    band = F.when(F.col("known") != "insufficient", named(F.greatest(level, F.col("floor")))).when(F.col("floor") >= 0, named(F.col("floor"))).otherwise("insufficient_evidence")
    return out.select("entity_id", F.bround("base", 4).alias("base"), "n_rules", "risk_index", band.alias("band"))


def rank_controls(t: Tables) -> DataFrame:
    """Rules by the entities that fail them, the highest severity and the sum of scores."""
    rank = F.when(F.col("severity") == "critical", 4).when(F.col("severity") == "high", 3).when(F.col("severity") == "medium", 2).otherwise(1)
    return findings(t).groupBy("rule_id").agg(F.countDistinct("entity_id").alias("n_entities"), F.max(rank).alias("max_severity"), F.bround(F.sum("score"), 1).alias("total"))


def rank_processes(t: Tables) -> DataFrame:
    return domain_scores(t).groupBy("domain").agg(F.count_if(F.col("score") >= 50).alias("n_weak"), median(F.col("score")).alias("median_score"), F.max("score").alias("max_score"))


def heatmap(t: Tables) -> DataFrame:
    """Entities by domains; a column for each domain."""
    wide = domain_scores(t).groupBy("entity_id").pivot("domain", list(DOMAIN_WEIGHTS)).agg(F.first("score"))
    return wide.toDF(*[c.lower().replace(" ", "_") for c in wide.columns])


def portfolio(t: Tables) -> DataFrame:
    """Findings of either family and the three highest titles of each entity."""
    f = findings(t).withColumn("n", F.row_number().over(Window.partitionBy("entity_id", F.substring("rule_id", 1, 2)).orderBy(F.desc("score"), "rule_id")))
    top = lambda p: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rule_id").startswith(p) & (F.col("n") <= 3), F.struct("n", "rule_id")))), lambda x: x["rule_id"]), ",")
    return f.groupBy("entity_id").agg(F.count_if(F.col("rule_id").startswith("EG")).alias("n_eg"), F.count_if(F.col("rule_id").startswith("NS")).alias("n_ns"), top("EG").alias("top_eg"), top("NS").alias("top_ns"))


def review_queue(t: Tables) -> DataFrame:
    """Per entity the records with most evidence, up to 70 % of the queue, and a seeded control sample of other
    alerts, one in each severity before more of any. Order of chance is md5 of seed and id."""
    listed = findings(t).filter("evidence is not null").select("entity_id", "score", F.explode(F.split("evidence", ",")).alias("record_id"))
    scored = listed.groupBy("entity_id", "record_id").agg(F.bround(F.sum("score"), 1).alias("priority"))
    first = scored.withColumn("n", F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("priority"), "record_id"))).filter(F.col("n") <= int(QUEUE * TARGETED))
    first = first.select("entity_id", "record_id", "priority", F.lit("targeted").alias("arm"))
    chance = F.md5(F.concat(F.lit(f"{SEED}:"), "alert_id"))
    pool = t.alert.join(first.select("entity_id", F.col("record_id").alias("alert_id")), ["entity_id", "alert_id"], "left_anti")
    pool = pool.withColumn("k", F.row_number().over(Window.partitionBy("entity_id", "severity_final").orderBy(chance, "alert_id"))).filter(F.col("k") <= QUEUE)
    drawn = pool.withColumn("n", F.row_number().over(Window.partitionBy("entity_id").orderBy("k", chance, "alert_id"))).filter(F.col("n") <= QUEUE - int(QUEUE * TARGETED))
    return first.unionByName(drawn.select("entity_id", F.col("alert_id").alias("record_id"), F.lit(0.0).alias("priority"), F.lit("random").alias("arm")))
