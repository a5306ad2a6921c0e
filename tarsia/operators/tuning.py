"""Thresholds of rules as values: what each one, moved by a fifth, adds and removes.

Each rule is taken apart into what it measures, which knows no threshold, and whether it fires, which is asked for all
variants of its parameters at once: variants meet the measured groups, pairs or counts, never the records. So every record is
read once, whatever the number of variants. A proposal of new values is previewed by a run of the rules with them instead, since scores and
bands follow from it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarsia.functions.stats import median_mad, micros, seconds_between
from tarsia.operators import rules
from tarsia.operators.peers import bridge, scope
from tarsia.operators.records import PLANTED
from tarsia.operators.rules import BASE as PARAMETERS
from tarsia.operators.rules import PARAMS, findings, proposal, proposed
from tarsia.operators.scoring import risk_index
from tarsia.sources.projection import Tables

# Those that the preview proposes.
PROPOSED = {
    "EG01": {"fast_share_threshold": 0.3}, "EG02": {"max_uninvestigated_share": 0.05, "min_uninvestigated_count": 3}, "EG03": {"min_unescalated": 8}, "EG04": {"max_comment_hash_share": 0.6, "min_hash_group_size": 20},
    "EG05": {"min_repeat_count": 5, "min_unaddressed_pairs": 3, "max_chance_pairs": 2.0}, "EG06": {"min_bulk_closures_per_minute": 4, "max_deadline_hugging_share": 0.1}, "EG07": {"min_closures_per_analyst_hour": 60}, "EG08": {"min_unacknowledged_escalations": 5},
    "EG09": {"stale_case_days": 30, "min_stale_cases": 2}, "EG10": {"mttr_gap_ratio_threshold": 2.0}, "EG11": {"min_alert_volume": 100, "max_robust_z": 2.5, "min_spread": 0.005, "max_fp_rate": 0.9}, "EG12": {"min_skipped_cases": 1},
    "NS01": {"min_silent_days": 6, "min_asset_criticality": 2}, "NS02": {"min_peer_share": 0.8}, "NS03": {"max_night_share": 0.2, "min_alert_volume": 50, "max_robust_z": 2.5, "min_spread": 0.01}, "NS04": {"min_tp_without_case": 2},
    "NS05": {"max_dormant_share": 0.6, "min_dormant_rules": 3}, "NS06": {"min_ghost_assets": 4}, "NS07": {"min_unreported": 40}, "NS08": {"review_period_months": 5},
}
FACTORS = (0.8, 1.2)
BASE = "base"


def moved(value: float, factor: float) -> float:
    """A threshold scaled: whole numbers move by one at least and stay above 0, shares stay within 1."""
    if isinstance(value, int):
        out = round(value * factor)
        return max(1, out if out != value else value + (1 if factor > 1 else -1))
    out = round(value * factor, 6)
    return min(1.0, out) if 0 < value <= 1 else out


def variants(rule: str) -> list[tuple[str, str, float, dict[str, float]]]:
    """(parameter, change, tested value, all parameters) of a rule, the base first."""
    base = PARAMS[rule]
    return [(BASE, "", 0.0, base)] + [(k, f"{f - 1:+.0%}", moved(v, f), {**base, k: moved(v, f)}) for k, v in base.items() for f in FACTORS]


def tried(measured: DataFrame, rule: str) -> DataFrame:
    """Each row with each variant, its parameters in p and its name in variant."""
    each = [F.struct(F.lit(k + c).alias("variant"), F.struct(*[F.lit(v).alias(n) for n, v in p.items()]).alias("p")) for k, c, _, p in variants(rule)]
    return measured.select("*", F.inline(F.array(*each)))


def some(hits: DataFrame, least: Column | None = None, *more: str) -> DataFrame:
    """The entities and variants with at least so many rows (one, if not said)."""
    n = hits.groupBy("entity_id", "variant", *more).agg(F.count("*").alias("n"), F.first("p").alias("p"))
    return n.filter(F.col("n") >= (F.lit(1) if least is None else least)).select("entity_id", "variant")


def p(name: str) -> Column:
    return F.col(f"p.{name}")


def shares(rows: DataFrame, flag: str, rule: str, share: str, least: str) -> DataFrame:
    n = rows.groupBy("entity_id").agg(F.count_if(flag).alias("hits"), F.count("*").alias("population"))
    return tried(n, rule).filter((F.col("hits") >= p(least)) & (F.col("hits") / F.col("population") > p(share))).select("entity_id", "variant")


def templates(t: Tables) -> DataFrame:
    closed, groups = rules.comment_groups(t)
    size = closed.groupBy("entity_id").agg(F.count("*").alias("population"))
    n = tried(groups, "EG04").filter(F.col("n") >= p("min_hash_group_size")).groupBy("entity_id", "variant").agg(F.sum("n").alias("hits"), F.first("p").alias("p"))
    return n.join(size, "entity_id").filter(F.col("hits") / F.col("population") > p("max_comment_hash_share")).select("entity_id", "variant")


def repeats(t: Tables) -> DataFrame:
    floor = rules.chance_floor(F.col("alerts"), F.col("space"), p("max_chance_pairs"), 2 * p("min_repeat_count"))
    return some(tried(rules.repeated_pairs(t), "EG05").filter(F.col("n") >= F.greatest(p("min_repeat_count"), floor)), F.col("p.min_unaddressed_pairs"))


def gaming(t: Tables) -> DataFrame:
    closed = rules.human_closed(t)
    minutes = closed.groupBy("entity_id", "closed_by", F.date_trunc("minute", F.col("closed_at").cast("timestamp")).alias("minute")).agg(F.count("*").alias("n"))
    bulk = some(tried(minutes.groupBy("entity_id").agg(F.max("n").alias("n")), "EG06").filter(F.col("n") >= p("min_bulk_closures_per_minute")))
    due = closed.join(F.broadcast(t.sla_policy.select("entity_id", F.col("severity").alias("severity_final"), "resolve_minutes")), ["entity_id", "severity_final"])
    took, limit = seconds_between(F.col("closed_at"), F.col("created_at")), F.col("resolve_minutes") * 60.0
    tight = due.groupBy("entity_id").agg(F.count("*").alias("population"), F.count_if((took >= 0.9 * limit) & (took <= limit)).alias("tight"))
    hug = tried(tight, "EG06").filter(F.col("tight") / F.col("population") > p("max_deadline_hugging_share")).select("entity_id", "variant")
    return bulk.join(tight.select("entity_id"), "entity_id", "left_semi").unionByName(hug).distinct()


def rates(t: Tables, per: DataFrame, rule: str) -> DataFrame:
    """The measured rates with each variant's cohort and z: of entities with alerts enough only."""
    v = tried(per, rule).filter(F.col("population") >= p("min_alert_volume"))
    near = bridge(t).join(v.select(F.col("entity_id").alias("peer_id"), "variant", "rate"), "peer_id")
    cohort = median_mad(near.withColumn("key", F.concat_ws("|", "entity_id", "variant")), "key", "rate")
    z = (F.col("rate") - F.col("med")) / F.greatest(1.4826 * F.col("mad"), p("min_spread"))
    return v.withColumn("key", F.concat_ws("|", "entity_id", "variant")).join(cohort, "key", "left").withColumn("z", F.when(F.coalesce("n", F.lit(0)) >= 3, z))


def dispositions(t: Tables) -> DataFrame:
    per = t.alert.groupBy("entity_id").agg(F.count("*").alias("population"), F.count_if(F.col("disposition") == "true_positive").alias("tp"), F.count_if(F.col("disposition").isin("false_positive", "benign")).alias("hits"))
    rows = rates(t, per.withColumn("rate", F.col("hits") / F.col("population").cast("double")), "EG11")
    return rows.filter((F.col("tp") == 0) | (F.col("z") >= p("max_robust_z")) | (F.col("z").isNull() & (F.col("rate") > p("max_fp_rate")))).select("entity_id", "variant")


def nights(t: Tables) -> DataFrame:
    per = rules.local_counts(t).groupBy("entity_id").agg(F.sum("alerts").alias("population"), F.sum("night").alias("hits"))
    rows = rates(t, per.withColumn("rate", F.col("hits") / F.col("population").cast("double")), "NS03")
    return rows.filter((F.col("z") <= -p("max_robust_z")) | (F.col("z").isNull() & (F.col("rate") < p("max_night_share")))).select("entity_id", "variant")


def months(t: Tables) -> DataFrame:
    own = rules.own_months(t)
    span = own.groupBy("scope").agg(F.countDistinct("month").alias("months"), F.countDistinct("entity_id").alias("entities"))
    n = own.groupBy("scope", "entity_id").agg(F.count("*").alias("n")).join(F.broadcast(span), "scope")
    expected = F.when(F.col("entities") == 1, p("review_period_months")).otherwise(F.least(p("review_period_months"), F.col("months")))
    return tried(n, "NS08").filter(F.col("n") < expected).select("entity_id", "variant")


def firing(t: Tables) -> DataFrame:
    """rule_id, entity_id, variant of every rule with parameters."""
    h = rules.hits(t)
    closed = rules.human_closed(t)
    hours = closed.groupBy("entity_id", "closed_by", F.date_trunc("hour", F.col("closed_at").cast("timestamp")).alias("hour")).agg(F.count("*").alias("n")).groupBy("entity_id").agg(F.max("n").alias("n"))
    late = t.soc_case.filter("closed_at is null").withColumn("scope", scope()).join(F.broadcast(rules.references(t)), "scope").select("entity_id", (micros(F.col("reference")) - micros(F.col("opened_at"))).alias("age"))
    silent = rules.silent_days(t).filter("days > 0")
    size, base = rules.peer_categories(t)
    counted = lambda rule, name: tried(h[rule].groupBy("entity_id").agg(F.count("*").alias("n")), rule).filter(F.col("n") >= p(name)).select("entity_id", "variant")
    dormant = h["NS05"].groupBy("entity_id").agg(F.count("*").alias("hits")).join(t.detection_rule.filter("enabled").groupBy("entity_id").agg(F.count("*").alias("population")), "entity_id")
    out = {
        "EG01": shares(rules.fast_rows(t), "fast", "EG01", "fast_share_threshold", "min_fast_count"), "EG02": shares(rules.unlooked_rows(t), "bad", "EG02", "max_uninvestigated_share", "min_uninvestigated_count"),
        "EG04": templates(t), "EG05": repeats(t), "EG06": gaming(t), "EG07": tried(hours, "EG07").filter(F.col("n") >= p("min_closures_per_analyst_hour")).select("entity_id", "variant"),
        "EG08": counted("EG08", "min_unacknowledged_escalations"), "EG09": some(tried(late, "EG09").filter(F.col("age") > p("stale_case_days") * F.lit(86_400_000_000)), F.col("p.min_stale_cases")),
        "EG10": tried(rules.kpi_gaps(t), "EG10").filter((F.col("gap") > p("mttr_gap_ratio_threshold")) & (F.col("found") != 0) & (F.col("said") != 0)).select("entity_id", "variant"),
        "EG11": dispositions(t), "EG12": counted("EG12", "min_skipped_cases"), "NS01": some(tried(silent, "NS01").filter((F.col("criticality") >= p("min_asset_criticality")) & (F.col("days") >= p("min_silent_days")))),
        "NS02": some(tried(size, "NS02").filter(F.col("n") >= F.greatest(F.lit(1), F.ceil(p("min_peer_share") * F.col("peers") - 1e-9))).join(base, ["entity_id", "category"], "left_anti")), "NS03": nights(t),
        "NS04": counted("NS04", "min_tp_without_case"), "NS05": tried(dormant, "NS05").filter((F.col("hits") >= p("min_dormant_rules")) & (F.col("hits") / F.col("population") > p("max_dormant_share"))).select("entity_id", "variant"),
        "NS06": counted("NS06", "min_ghost_assets"), "NS08": months(t),
    }
    return reduce(DataFrame.unionByName, [f.distinct().select(F.lit(r).alias("rule_id"), "entity_id", "variant") for r, f in out.items()])


def sensitivity(t: Tables) -> DataFrame:
    """rule_id, param, change, baseline, tested, tp, fp, fn (against what is planted), added, removed (against the base)."""
    found = t.once("firing", lambda: firing(t))
    rows = [(r, k, c, float(PARAMS[r][k]), float(v), k + c) for r in PARAMS for k, c, v, _ in variants(r) if k != BASE]
    grid = t.spark.createDataFrame(rows, "rule_id string, param string, change string, baseline double, tested double, variant string")
    truth = t.spark.createDataFrame([(r, e) for r, es in PLANTED.items() if r in PARAMS for e in es], "rule_id string, entity_id string").withColumn("planted", F.lit(True))
    base = found.filter(F.col("variant") == BASE).select("rule_id", "entity_id", F.lit(True).alias("was"))
    known = truth.join(base, ["rule_id", "entity_id"], "full_outer").join(F.broadcast(grid.select("rule_id", "variant")), "rule_id")
    both = known.join(found.withColumn("now", F.lit(True)), ["rule_id", "entity_id", "variant"], "full_outer").filter(F.col("variant") != BASE)
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    n = {"tp": yes("now") & yes("planted"), "fp": yes("now") & ~yes("planted"), "fn": ~yes("now") & yes("planted"), "added": yes("now") & ~yes("was"), "removed": ~yes("now") & yes("was")}
    counts = both.groupBy("rule_id", "variant").agg(*[F.count_if(c).alias(k) for k, c in n.items()])
    return grid.join(counts, ["rule_id", "variant"], "left").fillna(0, list(n)).select("rule_id", "param", "change", "baseline", "tested", *n)


def preview(t: Tables, changes: dict[str, dict[str, float]] = PROPOSED) -> DataFrame:
    """What changed parameters would do, beside the findings and the bands as they are: kind, entity_id, rule_id, param, change, hits, before, after,
    band_before, band_after.

    parameter: each changed one with both values. finding: of every rule, added, removed or same, with the scores. band: entities whose
    band would change, with the risk index. findings: their number."""
    key = ["entity_id", "rule_id"]
    now, then = findings(t), proposed(t, changes)
    both = now.select(*key, F.col("hits").alias("had"), F.col("score").alias("before")).join(then.select(*key, "hits", F.col("score").alias("after")), key, "full_outer")
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("same")
    of = lambda rows, a: rows.select("entity_id", F.col("risk_index").alias(a), F.col("band").alias(f"band_{a}"))
    # Each run's bands are a job of their own, which keeps plans small: they ask for the sizes of all tables.
    was, will = t.once("risk_index", lambda: risk_index(t)), t.once(f"{proposal(changes)}-risk", lambda: risk_index(t, found=then))
    bands = of(was, "before").join(of(will, "after"), "entity_id").filter("band_before <> band_after")
    rows = [(r, k, float(PARAMETERS[r][k]), float(v)) for r, values in changes.items() for k, v in values.items()]
    moves = t.spark.createDataFrame(rows, "rule_id string, param string, before double, after double")
    counts = both.agg(F.count("before").cast("double").alias("before"), F.count("after").cast("double").alias("after"))
    columns = {"entity_id": "string", "rule_id": "string", "param": "string", "change": "string", "hits": "long", "before": "double", "after": "double", "band_before": "string", "band_after": "string"}

    def one(kind: str, frame: DataFrame) -> DataFrame:
        return frame.select(F.lit(kind).alias("kind"), *[F.col(c) if c in frame.columns else F.lit(None).cast(k).alias(c) for c, k in columns.items()])

    parts = {
        "parameter": moves.withColumn("change", F.lit("moved")), "finding": both.withColumns({"change": change, "hits": F.coalesce("hits", "had")}),
        "band": bands.withColumn("change", F.lit("moved")), "findings": counts,
    }
    return reduce(DataFrame.unionByName, [one(k, f) for k, f in parts.items()])


QUERIES = {"threshold_sensitivity_all": sensitivity, "tuning_preview": preview}
