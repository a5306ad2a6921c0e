"""Assessment runs beside each other, and the views that join scores, findings, evidence and decisions.

Two runs are looked at: the base run are the findings as they are; the later run is the same portfolio after remediation,
as an examiner would find it: rules of every fourth entity are clear, scores of every third are one tenth lower. Decisions,
exceptions and labels are derived from the findings in the same way, so that there is something to join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarsia.functions.stats import median
from tarsia.operators import contracts
from tarsia.operators.catalog import coverage
from tarsia.operators.metrics import kpi_reconciliation
from tarsia.operators.peers import bridge, cohorts
from tarsia.operators.rules import findings
from tarsia.operators.scoring import domain_scores, review_queue, risk_index, with_domain
from tarsia.sources.projection import Tables

LEAST_PEERS, ACTIONABLE = 3, 50.0
# Levels of concern on one scale.
CONCERN = {"low": 1, "moderate": 2, "elevated": 3, "high": 3, "critical": 4}


def entity_number() -> Column:
    return F.substring("entity_id", 2, 2).cast("int")


def later_run(t: Tables) -> DataFrame:
    lower = F.when(entity_number() % 3 == 0, F.bround(F.col("score") * 0.9, 1)).otherwise(F.col("score"))
    return findings(t).filter(entity_number() % 4 != 1).withColumn("score", lower)


def run_compare(t: Tables) -> DataFrame:
    """entity_id, rule_id, before, after, change of the two runs: added, removed, changed or same."""
    key = ["entity_id", "rule_id"]
    both = findings(t).select(*key, F.col("score").alias("before")).join(later_run(t).select(*key, F.col("score").alias("after")), key, "full_outer")
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before").eqNullSafe(F.col("after")), "same").otherwise("changed")
    return both.withColumn("change", change)


def remediation_evidence(t: Tables) -> DataFrame:
    """Of each base finding: whether the later run shows it remedied (the same rule is clear there), and how its evidence
    changed."""
    key = ["entity_id", "rule_id"]
    ids = lambda df, name: df.select(*key, F.split("evidence", ",").alias(name))
    both = ids(findings(t), "a").join(ids(later_run(t), "b"), key, "left")
    kept = F.size(F.array_intersect("a", F.coalesce("b", F.array().cast("array<string>"))))
    return both.select(*key, F.when(F.col("b").isNull(), "remedied").otherwise("still_found").alias("outcome"), kept.alias("kept"), (F.size("a") - kept).alias("gone"))


def exceptions(t: Tables) -> DataFrame:
    """Approved exceptions, one for each rule at an entity with an even number, with their validity."""
    f = findings(t).filter(entity_number() % 2 == 0).select("entity_id", "rule_id")
    until = F.when(entity_number() % 4 == 0, F.lit("2026-12-31")).otherwise(F.lit("2026-03-31")).cast("date")
    return f.withColumns({"valid_from": F.lit("2026-01-01").cast("date"), "valid_until": until, "approved": F.lit(True)})


def in_force(rows: DataFrame, day: str) -> DataFrame:
    """The rows that are approved and valid on a day; an open end stays valid."""
    return rows.filter(F.col("approved") & (F.col("valid_from") <= F.lit(day).cast("date")) & (F.col("valid_until").isNull() | (F.col("valid_until") >= F.lit(day).cast("date"))))


def with_exceptions(t: Tables, day: str = "2026-07-01") -> DataFrame:
    """Findings and whether an exception in force keeps them out of scores and queue; never critical ones."""
    valid = in_force(exceptions(t), day).select("entity_id", "rule_id").distinct().withColumn("x", F.lit(True))
    f = findings(t).join(valid, ["entity_id", "rule_id"], "left")
    return f.select("entity_id", "rule_id", "severity", "score", (F.col("x").isNotNull() & (F.col("severity") != "critical")).alias("excepted"))


def decisions_in_force(t: Tables) -> DataFrame:
    """How many exceptions are valid on the first day of each month."""
    months = t.spark.range(1, 13).select(F.make_date(F.lit(2026), F.col("id").cast("int"), F.lit(1)).alias("day"))
    e = exceptions(t).join(F.broadcast(months), F.expr("approved and valid_from <= day and (valid_until is null or valid_until >= day)"))
    return e.groupBy("day").agg(F.count("*").alias("n"), F.countDistinct("entity_id").alias("entities"))


def peer_medians(t: Tables, least: int = LEAST_PEERS) -> DataFrame:
    """entity_id, domain, score, n_peers and the peers' median (null under a least number of them)."""
    d = domain_scores(t)
    near = bridge(t).select("entity_id", "peer_id").join(d.select(F.col("entity_id").alias("peer_id"), "domain", F.col("score").alias("ps")), "peer_id")
    med = near.groupBy("entity_id", "domain").agg(F.count("ps").alias("n_peers"), median(F.col("ps")).alias("m"))
    return d.select("entity_id", "domain", "score").join(med, ["entity_id", "domain"], "left").select("entity_id", "domain", "score", F.coalesce("n_peers", F.lit(0)).alias("n_peers"), F.when(F.col("n_peers") >= least, F.col("m")).alias("peer_median"))


def band_tier(band: Column) -> Column:
    """The tier by which a band is shown; all but low call for action."""
    b = F.lower(F.trim(band))
    return F.when(b.startswith("insufficient"), "insufficient").when(b.startswith("critical") | b.startswith("high"), "critical").when(b.startswith("moderate"), "moderate").otherwise("low")


def league(t: Tables) -> DataFrame:
    """Entities with profile, risk and coverage, the riskiest first."""
    r = risk_index(t).select("entity_id", "risk_index", "band", "n_rules")
    e = t.entity.select("entity_id", "name", "sector", "size_band")
    rows = e.join(r, "entity_id", "left").join(coverage(t).select("entity_id", "coverage", "level"), "entity_id", "left").withColumn("tier", band_tier(F.coalesce("band", F.lit("insufficient"))))
    return rows.orderBy(F.desc_nulls_last("risk_index"), "entity_id")


def league_page(t: Tables, tier: str = "low", text: str = "a") -> DataFrame:
    """One tier whose entities' names contain a text, the least covered first (without coverage before all)."""
    hit = league(t).filter((F.col("tier") == tier) & F.lower("name").contains(text.lower()))
    return hit.orderBy(F.asc_nulls_first("coverage"), "entity_id").select("entity_id", "name", "tier", "coverage", "risk_index")


def profile(t: Tables) -> DataFrame:
    """One row an entity: risk, its domain farthest above its peers, its largest gap between measured and declared times."""
    far = peer_medians(t).withColumn("above", F.col("score") - F.col("peer_median")).filter("above > 0").groupBy("entity_id").agg(F.max_by("domain", F.struct("above", "domain")).alias("domain"), F.max("above").alias("above"))
    gap = kpi_reconciliation(t).groupBy("entity_id").agg(F.max("gap").alias("gap"))
    found = findings(t).groupBy("entity_id").agg(F.count("*").alias("findings"), F.max_by("rule_id", F.struct("score", "rule_id")).alias("top_rule"))
    rows = risk_index(t).select("entity_id", "risk_index", "band")
    for more in (far, gap, found, cohorts(t).select("entity_id", "n_peers", "strength")):
        rows = rows.join(more, "entity_id", "left")
    return rows.fillna(0, ["findings"])


def attention(t: Tables) -> DataFrame:
    """What to do next about an entity: its top finding from a score of ``ACTIONABLE``, an open case, missing inputs, or nothing."""
    top = findings(t).groupBy("entity_id").agg(F.max_by("rule_id", F.struct("score", "rule_id")).alias("rule_id"), F.max("score").alias("score"))
    open_ = t.soc_case.filter("closed_at is null").groupBy("entity_id").agg(F.min("case_id").alias("case_id"))
    lacks = coverage(t).filter("level <> 'assessable'").select("entity_id", F.lit(True).alias("lacks"))
    rows = t.entity.select("entity_id").join(top, "entity_id", "left").join(open_, "entity_id", "left").join(lacks, "entity_id", "left")
    reason = F.when(F.col("score") >= ACTIONABLE, "finding").when(F.col("case_id").isNotNull(), "open_case").when(F.col("lacks"), "missing_inputs").otherwise("none")
    subject = F.when(reason == "finding", F.col("rule_id")).when(reason == "open_case", F.col("case_id"))
    return rows.select("entity_id", reason.alias("reason"), subject.alias("subject"))


def concordance(t: Tables) -> DataFrame:
    """How near an examiner's blind level of concern (here by the entity's number) comes to the band: 100 less 25 a level."""
    word = F.element_at(F.array(*map(F.lit, CONCERN)), entity_number() % len(CONCERN) + 1)
    level = F.create_map(*[F.lit(x) for kv in CONCERN.items() for x in kv])
    return risk_index(t).select("entity_id", word.alias("concern"), "band", F.greatest(F.lit(0.0), 100.0 - 25.0 * F.abs(level[word] - level[F.col("band")])).alias("agreement"))


def decided(t: Tables) -> DataFrame:
    """Decisions on records of the queue: one or two for each, of which the latest counts."""
    q = review_queue(t).select("entity_id", "record_id")
    k = F.conv(F.substring(F.md5(F.col("record_id")), 1, 8), 16, 10).cast("long") % 5
    first = q.filter(k < 4).select("entity_id", "record_id", F.lit(1).alias("at"), F.lit("in_review").alias("status"))
    return first.unionByName(q.filter(k < 2).select("entity_id", "record_id", F.lit(2).alias("at"), F.when(k == 0, "confirmed").otherwise("dismissed").alias("status")))


def carried_queue(t: Tables) -> DataFrame:
    """The queue with the latest decision on each record; open without one."""
    last = decided(t).groupBy("entity_id", "record_id").agg(F.max_by("status", "at").alias("status"))
    return review_queue(t).join(last, ["entity_id", "record_id"], "left").withColumn("status", F.coalesce("status", F.lit("open")))


def queue_list(t: Tables, status: str = "open", limit: int = 50) -> DataFrame:
    """The head of the queue of one status, with the numbers of all records of that status and of the random ones."""
    q = carried_queue(t).filter(F.col("status") == status)
    n = q.agg(F.count("*").alias("total"), F.count_if(F.col("arm") == "random").alias("random"))
    return q.orderBy(F.desc("priority"), "entity_id", "record_id").limit(limit).join(F.broadcast(n)).select("entity_id", "record_id", "priority", "arm", "total", "random")


def evidence_cards(t: Tables) -> DataFrame:
    """Records of the queue with the findings that name them."""
    each = findings(t).select("entity_id", "rule_id", "severity", F.explode(F.split("evidence", ",")).alias("record_id"))
    return review_queue(t).filter("arm = 'targeted'").select("entity_id", "record_id", "priority").join(each, ["entity_id", "record_id"])


def finding_cards(t: Tables) -> DataFrame:
    """A finding with the number of its evidence, its first and last record and its rank at the entity."""
    ids = F.split("evidence", ",")
    rank = F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("score"), "rule_id"))
    return findings(t).select("entity_id", "rule_id", "severity", "score", F.size(ids).alias("n_evidence"), F.array_min(ids).alias("first"), F.array_max(ids).alias("last"), rank.alias("rank"))


def blind_sample(t: Tables, flagged: int = 3, control: int = 2, rest: int = 2, risk: DataFrame | None = None) -> DataFrame:
    """Entities for a blind review: the riskiest, some of the least risky and some of the rest, in a seeded order. risk: the risk index, where
    it is at hand."""
    h = F.sha2(F.concat(F.lit("42:"), "entity_id"), 256)
    r = (risk_index(t) if risk is None else risk).select("entity_id", "risk_index", h.alias("h"))
    top = r.orderBy(F.desc("risk_index"), "entity_id").limit(flagged).withColumn("arm", F.lit("flagged"))
    left = r.join(top.select("entity_id"), "entity_id", "left_anti")
    low = left.orderBy("risk_index", "h").limit(control).withColumn("arm", F.lit("control"))
    others = left.join(low.select("entity_id"), "entity_id", "left_anti").orderBy("h").limit(rest).withColumn("arm", F.lit("random"))
    few = top.unionByName(low).unionByName(others)  # as many rows as were asked for
    return few.select("entity_id", "arm", F.row_number().over(Window.orderBy("h")).alias("place"))


def trend(t: Tables) -> DataFrame:
    """Total scores of an entity over both runs and a warning where they fall by a tenth or more."""
    total = lambda df, run: df.groupBy("entity_id").agg(F.bround(F.sum("score"), 1).alias("total")).withColumn("run", F.lit(run))
    grid = t.entity.select("entity_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("run"))
    s = grid.join(total(findings(t), 1).unionByName(total(later_run(t), 2)), ["entity_id", "run"], "left").fillna(0.0, ["total"])
    before = F.lag("total").over(Window.partitionBy("entity_id").orderBy("run"))
    return s.withColumn("before", before).withColumn("warning", F.coalesce((F.col("before") > 0) & (F.col("total") <= 0.9 * F.col("before")), F.lit(False)))


def covered_scores(t: Tables) -> DataFrame:
    """Domain scores that say nothing where nothing was looked at, with the share of the domain's rules that could be assessed."""
    share = F.when(F.col("applicable") > 0, F.bround(F.col("assessed") / F.col("applicable"), 4)).otherwise(0.0)
    return domain_scores(t).select("entity_id", "domain", "score", share.alias("coverage"), "status")


def evidence_band(t: Tables) -> DataFrame:
    """The band of the risk index, which lacking evidence may leave open, and the inputs to ask for."""
    rows = contracts.coverage(t).select("entity_id", "coverage", "level", "requests")
    return rows.join(risk_index(t).select("entity_id", "band"), "entity_id").select("entity_id", "coverage", "level", "band", "requests")


QUERIES = {
    "rule_result_state_full": contracts.results, "covered_domain_scores": covered_scores, "evidence_band": evidence_band,
    "run_compare": run_compare, "remediation_evidence": remediation_evidence, "apply_exception": with_exceptions, "decisions_in_force": decisions_in_force, "peer_median_domain_scores": peer_medians,
    "entity_league": league, "league_filter_sort": league_page, "entity_profile": profile, "attention": attention, "blind_concordance": concordance, "queue_carry_decisions": carried_queue,
    "queue_list": queue_list, "queue_evidence_cards": evidence_cards, "finding_cards": finding_cards, "blind_sample_draw": blind_sample, "trend_series": trend,
}
