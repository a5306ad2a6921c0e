"""How well findings, queue and thresholds hold up against what is planted and against reviewers' labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarsia.functions.stats import wilson
from tarsia.operators.assessment import covered_scores
from tarsia.operators.records import PLANTED
from tarsia.operators.rules import findings
from tarsia.operators.scoring import DOMAIN_WEIGHTS, review_queue, risk_index
from tarsia.sources.projection import Tables

SHARE = 0.2  # by which thresholds are moved
DEPTHS = (10, 25, 50, 100)
#: Least counts of the rules that fire at a number of hits.
COUNTED = {"EG03": 1, "EG08": 3, "EG12": 2, "NS04": 3, "NS07": 1}
SPEED = ("EG01", "EG02")


def truth(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(e, r) for r, es in PLANTED.items() for e in es], "entity_id string, rule_id string")


def positives(t: Tables) -> DataFrame:
    return truth(t).select("entity_id").distinct()


def ranking_at_k(t: Tables) -> DataFrame:
    """One row: of the k riskiest entities, k the number with a planted defect, how many have one."""
    planted = positives(t).withColumn("hit", F.lit(1))
    n = planted.agg(F.count("*").alias("k"))
    order = Window.orderBy(F.desc("risk_index"), "entity_id")  # entities, one row each
    ranked = risk_index(t).join(planted, "entity_id", "left").withColumn("at", F.row_number().over(order)).join(F.broadcast(n))
    return ranked.agg(F.max("k").alias("k"), F.sum(F.when(F.col("at") <= F.col("k"), F.coalesce("hit", F.lit(0)))).alias("hits")).withColumns({"precision": F.col("hits") / F.col("k"), "recall": F.col("hits") / F.col("k")})


def precision_with_ties(t: Tables) -> DataFrame:
    """The same over risk in steps of ten, averaged over the orders of entities of one step."""
    steps = risk_index(t).join(positives(t).withColumn("hit", F.lit(1)), "entity_id", "left").groupBy(F.floor(F.col("risk_index") / 10).alias("step")).agg(F.count("*").alias("n"), F.count("hit").alias("hits"))
    k = positives(t).agg(F.count("*").alias("k"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # at most eleven steps
    slots = F.greatest(F.lit(0), F.least(F.col("n"), F.col("k") - F.col("before")))
    return steps.withColumn("before", before).join(F.broadcast(k)).agg(F.max("k").alias("k"), F.bround(F.sum(slots * F.col("hits") / F.col("n")), 6).alias("expected_hits"))


def review_lift(t: Tables) -> DataFrame:
    """How often the first records of the queue are of high severity, against all alerts."""
    hit = F.col("severity_final").isin("high", "critical").cast("int")
    alerts = t.alert.select("entity_id", F.col("alert_id").alias("record_id"), hit.alias("hit"))
    base = alerts.agg(F.avg("hit").alias("prevalence"))
    head = review_queue(t).join(alerts, ["entity_id", "record_id"]).orderBy(F.desc("priority"), "entity_id", "record_id").limit(max(DEPTHS))
    ranked = head.withColumn("at", F.row_number().over(Window.orderBy(F.desc("priority"), "entity_id", "record_id")))  # as many rows as the greatest depth
    each = ranked.withColumn("depth", F.explode(F.array(*map(F.lit, DEPTHS)))).filter("at <= depth").groupBy("depth").agg(F.avg("hit").alias("rate"))
    return each.join(F.broadcast(base)).select("depth", F.bround("rate", 6).alias("rate"), F.bround("prevalence", 6).alias("prevalence"), F.bround(F.col("rate") / F.col("prevalence"), 4).alias("lift"))


def shadow_pilot(t: Tables) -> DataFrame:
    """Rule by rule: findings that are planted, that are not, planted ones missed, and the 95 % interval of precision."""
    key = ["entity_id", "rule_id"]
    both = findings(t).select(*key, F.lit(1).alias("f")).join(truth(t).withColumn("p", F.lit(1)), key, "full_outer")
    n = both.groupBy("rule_id").agg(F.count_if(F.expr("f = 1 and p = 1")).alias("tp"), F.count_if(F.expr("f = 1 and p is null")).alias("fp"), F.count_if(F.expr("f is null")).alias("fn"))
    low, high = wilson(F.col("tp"), F.col("tp") + F.col("fp"), 1.96)
    return n.withColumns({"low": low, "high": high})


def baselines(t: Tables) -> DataFrame:
    """entity_id and the naive one-threshold flag that it meets."""
    human = t.alert.filter("closed_by_type = 'human'")
    sec = (F.unix_micros(F.col("closed_at").cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))) / 1e6
    fast = human.filter("severity_final in ('high', 'critical') and closed_at is not null").groupBy("entity_id").agg(F.avg(F.when(sec.between(0, 600), 1.0).otherwise(0.0)).alias("v")).filter("v > 0.1")
    notes = t.closure.select("entity_id", F.col("ref_id").alias("alert_id"), "comment_len")
    short = human.join(notes, ["entity_id", "alert_id"]).groupBy("entity_id").agg(F.avg(F.when(F.coalesce("comment_len", F.lit(0)) < 25, 1.0).otherwise(0.0)).alias("v")).filter("v > 0.1")
    silent = t.alert.filter("severity_final = 'critical'").join(t.escalation.select("entity_id", F.col("ref_id").alias("alert_id")), ["entity_id", "alert_id"], "left_anti").select("entity_id").distinct()
    named = lambda df, name: df.select("entity_id", F.lit(name).alias("baseline"))
    return named(fast, "fast_closure").unionByName(named(short, "short_comment")).unionByName(named(silent, "no_escalation"))


def family_ablation(t: Tables) -> DataFrame:
    """An entity's findings combined: all, without EG rules, without NS rules."""
    miss = lambda keep: 100 * (1 - F.product(F.when(keep, 1 - F.col("score") / 100.0).otherwise(1.0)))
    eg = F.col("rule_id").startswith("EG")
    out = findings(t).groupBy("entity_id").agg(*[F.bround(miss(k), 4).alias(n) for k, n in ((F.lit(True), "whole"), (~eg, "without_eg"), (eg, "without_ns"))])
    return t.entity.select("entity_id").join(out, "entity_id", "left").fillna(0.0)


def confounders(t: Tables) -> DataFrame:
    """Findings that are not planted: those of speed rules, those of small entities, all."""
    fp = findings(t).select("entity_id", "rule_id").join(truth(t), ["entity_id", "rule_id"], "left_anti").join(t.entity.select("entity_id", "size_band"), "entity_id")
    names = {"speed_rules": F.col("rule_id").isin(*SPEED), "small_entity": F.col("size_band") == "small", "all": F.lit(True)}
    wide = fp.agg(*[F.count_if(c).alias(n) for n, c in names.items()])
    return wide.unpivot([], list(names), "confounder", "n")


def hit_counts(t: Tables) -> DataFrame:
    """entity_id, rule_id, hits of the rules that fire at a number of hits, below their thresholds too."""
    as_ref = lambda df, name: df.select("entity_id", F.col("ref_id").alias(name))
    serious = t.alert.filter("disposition = 'true_positive'")
    critical = t.soc_case.filter("severity = 'critical'")
    hits = {
        "EG03": serious.filter("severity_final = 'critical'").join(as_ref(t.escalation, "alert_id"), ["entity_id", "alert_id"], "left_anti"),
        "EG08": t.escalation.filter("acknowledged_at is null"),
        "EG12": critical.join(as_ref(t.workflow_event.filter("ref_type = 'case' and action = 'contain'"), "case_id"), ["entity_id", "case_id"], "left_anti"),
        "NS04": serious.filter("severity_final in ('high', 'critical')").join(t.case_alert_link, ["entity_id", "alert_id"], "left_anti"),
        "NS07": critical.join(t.external_report.select("entity_id", F.col("incident_id").alias("case_id")), ["entity_id", "case_id"], "left_anti"),
    }
    counts = [df.groupBy("entity_id").agg(F.lit(r).alias("rule_id"), F.count("*").alias("hits")) for r, df in hits.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def limits(values: dict[str, int]):
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[F.col("rule_id")]


def threshold_sensitivity(t: Tables) -> DataFrame:
    """Findings against what is planted with thresholds lower, as they are, and higher by a fifth (one at least)."""
    step = F.greatest(F.lit(1), F.bround(SHARE * limits(COUNTED)).cast("int"))
    grid = t.spark.range(-1, 2).select(F.col("id").cast("int").alias("move"))
    found = t.once("hit_counts", lambda: hit_counts(t)).join(F.broadcast(grid)).filter(F.col("hits") >= F.greatest(F.lit(1), limits(COUNTED) + F.col("move") * step))
    planted = truth(t).filter(F.col("rule_id").isin(*COUNTED)).join(F.broadcast(grid)).withColumn("p", F.lit(True))
    both = found.select("move", "entity_id", "rule_id", F.lit(True).alias("f")).join(planted, ["move", "entity_id", "rule_id"], "full_outer")
    return both.groupBy("rule_id", "move").agg(F.count_if(F.col("f") & F.col("p")).alias("tp"), F.count_if(F.col("f") & F.col("p").isNull()).alias("fp"), F.count_if(F.col("p") & F.col("f").isNull()).alias("fn"))


def average_rank(column: str) -> Column:
    """The rank of a value, highest first, the mean of the places of equal ones."""
    same = F.count("*").over(Window.partitionBy(column))
    return F.rank().over(Window.orderBy(F.desc(column))) + (same - 1) / 2  # entities, one row each


def weight_stability(t: Tables, share: float = SHARE) -> DataFrame:
    """move, rho, stable: Spearman correlation of the entities' ranks with those under domain weights that are all higher or
    lower by a share and sum to one again. Domains that can't be told count as 0 here."""
    weights = F.create_map(*[F.lit(x) for d, w in DOMAIN_WEIGHTS.items() for x in (d, round(w * 1000))])
    moves = F.explode(F.array(F.lit(1 - share), F.lit(1 + share)))
    each = covered_scores(t).select("entity_id", "domain", F.coalesce("score", F.lit(0.0)).alias("score"), moves.alias("factor"))
    parts = F.round(weights[F.col("domain")] * F.col("factor")).cast("long"), F.round(F.col("score") * 10).cast("long")
    moved = each.groupBy("factor", "entity_id").agg(F.sum(parts[0] * parts[1]).alias("points"), F.sum(parts[0]).alias("w"))
    risk = risk_index(t).select("entity_id", "n_rules", "risk_index")
    index = F.bround((9.0 * (F.col("points") / 10.0 / F.col("w")) + F.least(F.lit(100.0), 10.0 * F.col("n_rules"))) / 10.0, 1)
    both = moved.join(risk, "entity_id").select("entity_id", "risk_index", F.bround("factor", 1).alias("factor"), index.alias("moved"))
    wide = both.groupBy("entity_id", "risk_index").pivot("factor", [0.8, 1.2]).agg(F.first("moved")).toDF("entity_id", "risk_index", "lower", "higher")
    ranks = wide.select(*[average_rank(c).alias(c) for c in ("risk_index", "lower", "higher")])
    rho = ranks.agg(*[F.bround(F.corr("risk_index", c), 4).alias(c) for c in ("lower", "higher")])
    return rho.unpivot([], ["lower", "higher"], "move", "rho").withColumn("stable", F.col("rho") >= 0.85)


QUERIES = {
    "weight_stability": weight_stability,
    "entity_ranking_at_k": ranking_at_k, "precision_at_k_ties": precision_with_ties, "review_lift": review_lift, "shadow_pilot": shadow_pilot, "naive_baselines": baselines,
    "family_ablation": family_ablation, "confounder_findings": confounders, "threshold_sensitivity": threshold_sensitivity,
}
