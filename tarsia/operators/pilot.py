"""A pilot under a frozen protocol: examiners judge entities blind, and the judgements are held against what the system says.

A task is one examiner's judgement of one entity in one run. Tasks of the same run and entity are a unit; a sample may be replicated
for a second examiner, so a unit may have several labels. Numbers of tasks are those that people can review.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarsia.functions.stats import median, seconds_between, wilson
from tarsia.operators.assessment import blind_sample, carried_queue
from tarsia.operators.catalog import seeded_split
from tarsia.operators.rules import HIGH
from tarsia.operators.scoring import risk_index
from tarsia.operators.statistics import SEED, beyond_chance, resampled
from tarsia.sources.projection import Tables

CONCERNS = ("Low", "Moderate", "Elevated", "Critical")
IMPORTANT = 2  # the level, from 0, from which a concern is important
FLAGGED_BANDS = ("elevated", "high", "critical", "severe")
PARTS, ARMS = ("held_out", "calibration"), ("flagged", "random", "control")
UNIT = ["run_id", "entity_id"]
# The protocol of the query; entities of each arm, share for calibration and the seed of its draw (not that of the sample,
# which would put the random arm into it), reviews an arm that the budget allows.
RUN, SAMPLE, CALIBRATION, SPLIT_SEED, BUDGET = "base", {"flagged": 8, "control": 5, "rest": 5}, 0.3, 11, 4
LAST = 10**9


def level(concern: Column) -> Column:
    """0 to 3; null for words that are no concern."""
    at = F.array_position(F.array(*map(F.lit, CONCERNS)), concern)
    return F.when(at > 0, at - 1)


def units(tasks: DataFrame, split: DataFrame, adjudicated: DataFrame) -> DataFrame:
    """run_id, entity_id, part, arm, rank, order, band, labels, status and label (a level) of each unit.

    agreed: several labels, all important or none; single: one; adjudicated: they differ and a third examiner has settled it;
    unresolved: nobody has; unanswered: no label. Where labels agree, the highest counts. A task without a concern isn't answered."""
    at = F.struct("sample_no", "position")
    t = tasks.withColumn("level", F.when(F.col("submitted_at").isNotNull(), level(F.col("concern")))).withColumn("seconds", seconds_between(F.col("submitted_at"), F.col("opened_at")))
    answered = F.col("level").isNotNull()
    u = t.groupBy(*UNIT).agg(
        F.min_by("arm", at).alias("arm"), F.min_by("rank", at).alias("rank"), F.coalesce(F.max_by("position", F.when(~F.col("replica"), at)), F.min_by("position", at)).alias("order"),
        F.min_by("band", F.when(answered & (F.col("band") != ""), at)).alias("band"), F.array_sort(F.collect_list(F.when(answered, F.struct("sample_no", "position", "reviewer", "level", "seconds")))).alias("labels"),
    )
    u = u.join(split.select("entity_id", "part"), "entity_id", "left").join(adjudicated.select(*UNIT, level(F.col("label")).alias("settled")), UNIT, "left")
    some, all_ = F.exists("labels", lambda x: x["level"] >= IMPORTANT), F.forall("labels", lambda x: x["level"] >= IMPORTANT)
    status = F.when(F.size("labels") == 0, "unanswered").when(some != all_, F.when(F.col("settled").isNotNull(), "adjudicated").otherwise("unresolved")).when(F.size("labels") > 1, "agreed").otherwise("single")
    label = F.when(F.col("status").isin("agreed", "single"), F.array_max(F.transform("labels", lambda x: x["level"]))).when(F.col("status") == "adjudicated", F.col("settled"))
    return u.withColumn("status", status).select(*UNIT, F.coalesce("part", F.lit("not_in_protocol")).alias("part"), "arm", "rank", "order", "band", "labels", "status", label.alias("label"))


def important() -> Column:
    return F.col("label") >= IMPORTANT


def long(rows: DataFrame, section: Column | str, item: Column | str, measures: dict[str, Column]) -> DataFrame:
    """section, item, measure, value: a row for each measure."""
    each = F.array(*[F.struct(F.lit(m).alias("measure"), v.cast("double").alias("value")) for m, v in measures.items()])
    return rows.select(F.col(section).alias("section") if isinstance(section, str) else section.alias("section"), (F.col(item) if isinstance(item, str) else item).alias("item"), F.inline(each)).withColumn("detail", F.lit(None).cast("string"))


def listed(rows: DataFrame, section: Column, measure: str, detail: Column) -> DataFrame:
    """A row for each unit, its item the run and the entity."""
    return rows.select(section.alias("section"), F.concat_ws("/", *UNIT).alias("item"), F.lit(measure).alias("measure"), F.lit(None).cast("double").alias("value"), detail.alias("detail"))


def word(at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, CONCERNS)), at.cast("int") + 1)


def counted(u: DataFrame, one: DataFrame) -> DataFrame:
    """How many units of each part have which status; only their number of those that the protocol doesn't know."""
    states = ("unanswered", "unresolved", "adjudicated", "agreed", "single")
    n = u.groupBy("part").agg(F.count("*").alias("units"), F.count("label").alias("labelled"), *[F.count_if(F.col("status") == s).alias(s) for s in states])
    grid = one.select(F.explode(F.array(*map(F.lit, (*PARTS, "not_in_protocol")))).alias("part")).join(n, "part", "left").fillna(0)
    known = long(grid.filter(F.col("part").isin(*PARTS)), "part", F.lit("all"), {c: F.col(c) for c in ("units", "labelled", *states)})
    return known.unionByName(long(grid.filter("part = 'not_in_protocol'"), "part", F.lit("all"), {"units": F.col("units")}))


def rates(u: DataFrame, queue: DataFrame, one: DataFrame, budget: int, seed: int) -> DataFrame:
    """Each arm of each part: labelled units, important ones, their rate with its Wilson interval and one that resamples whole entities, and
    what a budget of reviews finds in the order of the arm. The arms of the review queue likewise, by record."""
    told = u.filter(F.col("label").isNotNull())
    first = Window.partitionBy("part", "arm").orderBy(F.when(F.col("arm") == "flagged", F.coalesce(F.nullif("rank", F.lit(0)), F.lit(LAST))), "order", *reversed(UNIT))
    told = told.withColumn("within", F.row_number().over(first) <= budget)
    n = told.groupBy("part", "arm").agg(
        F.count("*").alias("n"), F.count_if(important()).alias("positive"), F.countDistinct("entity_id").alias("entities"),
        F.count_if("within").alias("budget_reviewed"), F.count_if(F.col("within") & important()).alias("budget_important"),
    )
    grid = one.select(F.explode(F.array(*map(F.lit, PARTS))).alias("part")).withColumn("arm", F.explode(F.array(*map(F.lit, ARMS))))
    records = queue.groupBy("arm").agg(F.count("*").alias("records"), F.count_if("decided").alias("n"), F.count_if("confirmed").alias("positive"))
    clusters = told.groupBy("part", "arm", "entity_id").agg(F.count("*").alias("n"), F.count_if(important()).alias("k"))
    of_queue = queue.filter("decided").groupBy(F.lit("queue").alias("part"), "arm", "entity_id").agg(F.count("*").alias("n"), F.count_if("confirmed").alias("k"))
    near = resampled(clusters.unionByName(of_queue), ["part", "arm"], seed=seed).select("part", "arm", F.bround("low", 4).alias("low"), F.bround("high", 4).alias("high"))
    low, high = wilson(F.col("positive"), F.col("n"), 1.96)
    rate = {"rate": F.bround(F.try_divide(F.col("positive"), F.col("n")), 4), "wilson_low": low, "wilson_high": high, "cluster_low": F.col("low"), "cluster_high": F.col("high")}
    count = lambda *names: {c: F.col(c) for c in names}
    arms = long(grid.join(n, ["part", "arm"], "left").fillna(0).join(near, ["part", "arm"], "left"), "part", "arm", count("n", "positive", "entities", "budget_reviewed", "budget_important") | rate)
    false = long(grid.filter("arm = 'flagged'").join(n, ["part", "arm"], "left").fillna(0), "part", "arm", {"false_positives": F.col("n") - F.col("positive")})
    seen = long(records.withColumn("part", F.lit("queue")).join(near, ["part", "arm"], "left"), "part", "arm", {"n": F.col("records"), "decided": F.col("n"), "confirmed": F.col("positive")} | rate)
    return arms.unionByName(false).unionByName(seen)


def lists(u: DataFrame) -> DataFrame:
    """Important concerns in arms that the system doesn't stand behind, at entities it rates low (missed), and unresolved disagreements."""
    low = ~reduce(lambda a, b: a | b, [F.lower(F.coalesce("band", F.lit(""))).startswith(b) for b in FLAGGED_BANDS])
    missed = u.filter(F.col("part").isin(*PARTS) & F.col("arm").isin("random", "control") & important() & low)
    open_ = u.filter("status = 'unresolved'")
    said = F.concat_ws(",", F.transform("labels", lambda x: word(x["level"])))
    return listed(missed, F.col("part"), "missed", F.concat_ws(",", "arm", word(F.col("label")), "band")).unionByName(listed(open_, F.lit("disagreement"), "concerns", said))


def agreement(u: DataFrame, one: DataFrame) -> DataFrame:
    """The first two labels of units that have two: how often they agree on important or not, and beyond chance, there and by level."""
    pairs = u.filter(F.size("labels") >= 2).select(F.col("labels")[0]["level"].alias("x"), F.col("labels")[1]["level"].alias("y"))
    binary = F.struct(F.lit("binary").alias("scale"), (F.col("x") >= IMPORTANT).cast("int").alias("a"), (F.col("y") >= IMPORTANT).cast("int").alias("b"))
    levels = F.struct(F.lit("levels").alias("scale"), F.col("x").cast("int").alias("a"), F.col("y").cast("int").alias("b"))
    cells = pairs.select(F.inline(F.array(binary, levels))).groupBy("scale", "a", "b").agg(F.count("*").alias("n"))
    k = beyond_chance(cells, "scale", len(CONCERNS))
    of = lambda scale, c: F.max(F.when(F.col("scale") == scale, c))
    both = k.agg(
        F.coalesce(of("binary", F.col("total")), F.lit(0)).alias("pairs"), F.bround(of("binary", F.col("same") / F.col("total")), 4).alias("observed_binary"),
        F.bround(of("binary", F.col("kappa")), 4).alias("kappa_binary"), F.bround(of("levels", F.col("weighted")), 4).alias("kappa_weighted_levels"),
    )
    return long(both, F.lit("agreement"), F.lit("all"), {c: F.col(c) for c in both.columns})


def times(u: DataFrame) -> DataFrame:
    """Seconds from the first opening of a task to its submission, of all examiners and of each; of all also how many weren't recorded."""
    each = u.select(F.explode("labels").alias("l")).select("l.reviewer", "l.seconds")
    who = each.withColumn("who", F.explode(F.array(F.lit("all"), F.concat(F.lit("by:"), "reviewer")))).filter("seconds is not null")
    w = Window.partitionBy("who")
    ranked = who.withColumns({"i": F.row_number().over(w.orderBy("seconds")) - 1, "m": F.count("*").over(w)})
    p90 = F.max(F.when(F.col("i") == F.least(F.col("m") - 1, F.floor(F.lit(0.9) * F.col("m"))), F.col("seconds")))
    n = ranked.groupBy("who").agg(F.count("*").alias("n"), F.bround(median(F.col("seconds")), 1).alias("median_s"), F.bround(p90, 1).alias("p90_s"))
    blank = each.agg(F.count_if(F.col("seconds").isNull()).alias("not_recorded"), F.count("seconds").alias("n"))
    told = long(n, F.lit("review_time"), F.regexp_replace("who", "^by:", ""), {"median_s": F.col("median_s"), "p90_s": F.col("p90_s")})
    by = long(n.filter("who <> 'all'"), F.lit("review_time"), F.substring("who", 4, 1 << 30), {"n": F.col("n")})
    return told.unionByName(by).unionByName(long(blank, F.lit("review_time"), F.lit("all"), {"n": F.col("n"), "not_recorded": F.col("not_recorded")}))


def evaluate(tasks: DataFrame, runs: DataFrame, config: str, split: DataFrame, adjudicated: DataFrame, queue: DataFrame, budget: int = BUDGET, seed: int = SEED) -> DataFrame:
    """section, item, measure, value, detail: the figures of a pilot.

    tasks: sample_no, position, run_id, entity_id, arm, rank, band, reviewer, replica, opened_at, submitted_at, concern. runs: run_id and config;
    those under another configuration than the protocol's are left out, and named. split: entity_id and part; entities for calibration
    are told apart. adjudicated: run_id, entity_id, label. queue: entity_id, arm, decided, confirmed of records."""
    one = tasks.sparkSession.range(1)
    known = tasks.select("run_id").distinct().join(runs, "run_id", "left").select("run_id", F.coalesce(F.col("config") == config, F.lit(False)).alias("same"))
    u = units(tasks.join(known.filter("same").select("run_id"), "run_id", "left_semi"), split, adjudicated)
    named = known.select(F.lit("runs").alias("section"), F.col("run_id").alias("item"), F.when(F.col("same"), "evaluated").otherwise("excluded").alias("measure"), F.lit(1.0).alias("value"), F.lit(None).cast("string").alias("detail"))
    return reduce(DataFrame.unionByName, [counted(u, one), rates(u, queue, one, budget, seed), lists(u), agreement(u, one), times(u), named])


def signals(t: Tables) -> DataFrame:
    """entity_id, n, serious and whether an entity stands out by a raw signal: few escalations, many false positives, quick closures, open
    alerts or unacknowledged ones, each against the share over all entities. Whole numbers are compared."""
    quick = seconds_between(F.col("closed_at"), F.col("created_at")) < 3600
    people = (F.col("closed_by_type") == "human") & F.col("closed_at").isNotNull()
    counts = {"n": F.lit(True), "serious": F.col("severity_final").isin(*HIGH), "fp": F.col("disposition") == "false_positive", "people": people, "quick": people & quick, "open": F.col("status") == "open", "unacked": F.col("acknowledged_at").isNull()}
    a = t.alert.groupBy("entity_id").agg(*[F.count_if(c).alias(k) for k, c in counts.items()])
    e = t.entity.select("entity_id").join(a, "entity_id", "left").join(t.escalation.groupBy("entity_id").agg(F.count("*").alias("escalated")), "entity_id", "left").fillna(0)
    total = e.agg(*[F.sum(c).alias(f"all_{c}") for c in (*counts, "escalated")])
    above = lambda part, whole: F.col(part) * F.col(f"all_{whole}") > F.col(f"all_{part}") * F.col(whole)
    few = F.col("escalated") * F.col("all_serious") < F.col("all_escalated") * F.col("serious")
    out = {"few_escalations": few, "many_false": above("fp", "n"), "quick_closures": above("quick", "people"), "open_alerts": above("open", "n"), "unacknowledged": above("unacked", "n")}
    return e.join(F.broadcast(total)).select("entity_id", "n", "serious", *[c.cast("int").alias(k) for k, c in out.items()])


def examined(t: Tables) -> tuple[DataFrame, DataFrame]:
    """The tasks of two examiners over one blind sample of the base run, and what a third settled. The given data hold no judgements; these are
    derived from raw signals of the entity's records: each examiner looks at three, and one that stands out raises the concern by a level."""
    risk = t.once("pilot_risk", lambda: risk_index(t).select("entity_id", "risk_index", "band"))
    rank = F.row_number().over(Window.orderBy(F.desc("risk_index"), "entity_id"))  # entities, one row each
    drawn = blind_sample(t, **SAMPLE, risk=risk).join(risk.withColumn("rank", rank), "entity_id").join(signals(t), "entity_id")
    again = F.row_number().over(Window.orderBy(F.sha2(F.concat(F.lit(f"{SEED * 7919}:"), "entity_id"), 256)))
    drawn = drawn.withColumns({"again": again, "rank": F.when(F.col("arm") == "flagged", F.col("rank"))})
    said = lambda *names: word(reduce(lambda a, b: a + b, map(F.col, names)))
    start = F.lit("2026-07-01 09:00:00").cast("timestamp_ntz")
    later = lambda s: start + F.make_dt_interval(secs=s)

    def task(no: int, position: str, blank: Column, unseen: Column, seconds: Column, concern: Column) -> DataFrame:
        done = F.when(~blank, later(seconds))
        return drawn.select(
            F.lit(no).alias("sample_no"), F.col(position).alias("position"), F.lit(RUN).alias("run_id"), "entity_id", "arm", "rank", "band", F.lit(f"examiner_{no}").alias("reviewer"), F.lit(no > 1).alias("replica"),
            F.when(~unseen, start).alias("opened_at"), done.alias("submitted_at"), F.when(~blank, concern).alias("concern"),
        )

    n, serious = F.col("n"), F.col("serious")
    first = task(1, "place", n % 4 == 0, serious % 7 == 0, 60 + n % 600, said("few_escalations", "many_false", "unacknowledged"))
    second = task(2, "again", n % 6 == 0, serious % 5 == 0, 90 + serious % 900, said("few_escalations", "many_false", "open_alerts"))
    third = drawn.filter(serious % 2 == 0).select(F.lit(RUN).alias("run_id"), "entity_id", said("few_escalations", "many_false", "quick_closures").alias("label"))
    return first.unionByName(second), third


def pilot_evaluation(t: Tables) -> DataFrame:
    """The figures of a pilot over one blind sample of the base run, and of the review queue."""
    by_two, third = examined(t)
    tasks, settled = t.once("pilot_tasks", lambda: by_two), t.once("pilot_settled", lambda: third)
    split = seeded_split(t, CALIBRATION, SPLIT_SEED).select("entity_id", F.when(F.col("part") == "holdout", "held_out").otherwise(F.col("part")).alias("part"))
    q = carried_queue(t).select("entity_id", "arm", F.col("status").isin("confirmed", "dismissed").alias("decided"), (F.col("status") == "confirmed").alias("confirmed"))
    runs = t.spark.range(1).select(F.lit(RUN).alias("run_id"), F.lit("as given").alias("config"))
    return evaluate(tasks, runs, "as given", split, settled, t.once("pilot_queue", lambda: q))


QUERIES = {"pilot_evaluation": pilot_evaluation}
