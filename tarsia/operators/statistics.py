"""Statistics over entities and their alerts: outlyingness, control charts, intervals, agreement, correlation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarsia.functions.stats import benjamini_hochberg, cusum, median, seconds_between, share, wilson
from tarsia.operators.contracts import ASSESSED, results
from tarsia.operators.metrics import monthly
from tarsia.operators.peers import bridge
from tarsia.operators.rules import findings
from tarsia.sources.projection import Tables

LEVELS = ("low", "medium", "high", "critical")
PHASE, LAMBDA, WIDTH = 5, 0.2, 3.0  # values that a chart is centred on, weight of the newest, limits in standard deviations
RESAMPLES, SEED = 2000, 42


def daily(t: Tables) -> DataFrame:
    return t.alert.filter("created_at is not null").groupBy("entity_id", F.to_date("created_at").alias("day")).agg(F.count("*").alias("n"))


def robust_z_scores(t: Tables) -> DataFrame:
    """How far each day's alerts lie from the entity's median day: 0.6745 (x - median) / MAD; without a MAD by the mean
    deviation; without any spread 0 or infinite."""
    d = daily(t)
    centre = d.groupBy("entity_id").agg(median(F.col("n")).alias("med"))
    off = d.join(F.broadcast(centre), "entity_id").withColumn("off", F.col("n") - F.col("med"))
    spread = off.groupBy("entity_id").agg(median(F.abs("off")).alias("mad"), F.avg(F.abs("off")).alias("dev"))
    z = F.when(F.col("mad") > 0, 0.6745 * F.col("off") / F.col("mad")).when(F.col("dev") > 0, 0.6745 * F.col("off") / (1.2533 * F.col("dev")))
    z = z.when(F.col("off") == 0, 0.0).otherwise(F.signum("off") * float("inf"))
    return off.join(F.broadcast(spread), "entity_id").select("entity_id", "day", "n", F.bround(z, 6).alias("z"))


def quartiles(t: Tables) -> DataFrame:
    """Quartiles of the seconds to acknowledgement, from a histogram of whole seconds."""
    h = t.alert.filter("acknowledged_at is not null").groupBy("entity_id", "severity_final", seconds_between(F.col("acknowledged_at"), F.col("created_at")).alias("sec")).agg(F.count("*").alias("k"))
    q = h.groupBy("entity_id", "severity_final").agg(*[F.percentile("sec", F.lit(p), F.col("k")).alias(n) for p, n in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))])
    return q.withColumn("iqr", F.col("p75") - F.col("p25"))


def rates(t: Tables) -> DataFrame:
    return t.alert.groupBy("entity_id").agg(F.count("*").alias("n"), share(F.count_if(F.col("disposition") == "false_positive"), F.count("*")).alias("rate"))


def percentile_ranks(t: Tables) -> DataFrame:
    """Where an entity's share of false positives stands among its peers': 100 (less + equal / 2) / n; 50 without peers."""
    r = rates(t)
    near = bridge(t).select("entity_id", "peer_id").join(r.select(F.col("entity_id").alias("peer_id"), F.col("rate").alias("pv")), "peer_id").join(F.broadcast(r), "entity_id")
    met = near.groupBy("entity_id").agg((100.0 * (F.count_if(F.col("pv") < F.col("rate")) + 0.5 * F.count_if(F.col("pv") == F.col("rate"))) / F.count("*")).alias("x"))
    return r.join(met, "entity_id", "left").select("entity_id", F.bround(F.coalesce("x", F.lit(50.0)), 6).alias("percentile_rank"))


def ewma_chart(t: Tables) -> DataFrame:
    """Weekly volumes smoothed, with control limits around the median of the first ``PHASE`` weeks; an entity with fewer
    has no chart. A series has as many values as there are weeks, so it stands in one array."""
    week = F.date_trunc("week", F.col("created_at").cast("timestamp")).cast("date")
    w = t.alert.filter("created_at is not null").groupBy("entity_id", week.alias("week")).agg(F.count("*").cast("double").alias("x"))
    s = w.groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("week", "x"))).alias("s")).filter(F.size("s") >= PHASE)
    first = F.explode(F.slice("s", 1, PHASE)["x"])
    med = s.select("entity_id", first.alias("x")).groupBy("entity_id").agg(median(F.col("x")).alias("med"))
    mad = s.select("entity_id", first.alias("x")).join(F.broadcast(med), "entity_id").groupBy("entity_id").agg(median(F.abs(F.col("x") - F.col("med"))).alias("mad"))
    s = s.join(F.broadcast(med), "entity_id").join(F.broadcast(mad), "entity_id")
    smooth = F.aggregate("s", F.array(F.col("med")), lambda acc, v: F.concat(acc, F.array(LAMBDA * v["x"] + (1 - LAMBDA) * F.element_at(acc, -1))))
    rows = s.select("entity_id", "med", "mad", F.posexplode(F.arrays_zip(F.col("s.week").alias("week"), F.slice(smooth, 2, F.size("s")).alias("z"))).alias("i", "v"))
    sigma = F.when(F.col("mad") > 0, 1.4826 * F.col("mad")).otherwise(1.0)
    half = WIDTH * sigma * F.sqrt(LAMBDA / (2 - LAMBDA) * (1 - F.pow(F.lit(1 - LAMBDA), 2 * (F.col("i") + 1))))
    rows = rows.select("entity_id", F.col("v.week").alias("week"), F.col("v.z").alias("z"), (F.col("med") - half).alias("lcl"), (F.col("med") + half).alias("ucl"))
    return rows.select("entity_id", "week", *[F.bround(c, 4).alias(c) for c in ("z", "lcl", "ucl")], ((F.col("z") > F.col("ucl")) | (F.col("z") < F.col("lcl"))).alias("alarm"))


def wilson_intervals(t: Tables) -> DataFrame:
    n = t.alert.groupBy("entity_id", "severity_final").agg(F.count("*").alias("n"), F.count_if(F.col("disposition") == "true_positive").alias("hits"))
    low, high = wilson(F.col("hits"), F.col("n"), 1.96)
    return n.select("entity_id", "severity_final", "n", "hits", low.alias("low"), high.alias("high"))


def spearman(t: Tables) -> DataFrame:
    """Of each sector's entities: rank correlation of volume and share of false positives, ties sharing their rank."""
    r = rates(t).join(t.entity.select("entity_id", "sector"), "entity_id")
    rank = lambda c: F.rank().over(Window.partitionBy("sector").orderBy(F.desc(c))) + (F.count("*").over(Window.partitionBy("sector", c)) - 1) / 2.0
    d = r.withColumns({"a": rank("n"), "b": rank("rate")}).groupBy("sector").agg(F.count("*").alias("n"), F.sum(F.pow(F.col("a") - F.col("b"), 2)).alias("d2"))
    rho = F.when(F.col("n") <= 1, 1.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1 - 6 * F.col("d2") / (F.col("n") * (F.col("n") * F.col("n") - 1)))))
    return d.select("sector", "n", F.bround(rho, 6).alias("rho"))


def kappas(t: Tables) -> DataFrame:
    """Agreement of first and final severity beyond chance, plain and with linear weights; null where chance alone agrees."""
    level = lambda c: F.array_position(F.array(*map(F.lit, LEVELS)), F.col(c)) - 1
    cells = t.alert.select("entity_id", level("severity_orig").alias("a"), level("severity_final").alias("b")).filter("a >= 0 and b >= 0").groupBy("entity_id", "a", "b").agg(F.count("*").alias("n"))
    return beyond_chance(cells, "entity_id", len(LEVELS)).select("entity_id", "total", F.bround("kappa", 6).alias("kappa"), F.bround("weighted", 6).alias("weighted"))


def beyond_chance(cells: DataFrame, by: str, levels: int) -> DataFrame:
    """by, total, same (pairs that agree), kappa and weighted (with linear weights) of two raters' levels a and b, counted from 0; cells: n of
    each pair of them. Null where chance alone agrees."""
    side = lambda c: cells.groupBy(by, c).agg(F.sum("n").alias(f"n_{c}"))
    plain, linear = F.when(F.col("a") == F.col("b"), 1.0).otherwise(0.0), 1 - F.abs(F.col("a") - F.col("b")) / (levels - 1.0)
    total = cells.groupBy(by).agg(F.sum("n").alias("total"), F.sum(plain * F.col("n")).alias("op"), F.sum(linear * F.col("n")).alias("ol"))
    chance = side("a").join(side("b"), by).groupBy(by).agg(*[F.sum(w * F.col("n_a") * F.col("n_b")).alias(k) for w, k in ((plain, "ep"), (linear, "el"))])
    both = total.join(chance, by)
    value = lambda o, e: F.when(F.col(e) / F.col("total") / F.col("total") < 1, (F.col(o) / F.col("total") - F.col(e) / F.col("total") / F.col("total")) / (1 - F.col(e) / F.col("total") / F.col("total")))
    return both.select(by, "total", F.col("op").alias("same"), value("op", "ep").alias("kappa"), value("ol", "el").alias("weighted"))


def bootstrap_intervals(t: Tables, resamples: int = RESAMPLES) -> DataFrame:
    """The share of false positives of each severity with an interval that resamples whole entities, by seeded hashes.
    Work is resamples x entities, whatever the number of alerts."""
    e = t.alert.groupBy("severity_final", "entity_id").agg(F.count("*").alias("n"), F.count_if(F.col("disposition") == "false_positive").alias("k"))
    ends = resampled(e, ["severity_final"], resamples)
    return ends.select("severity_final", F.bround(F.col("all_k") / F.col("all_n"), 4).alias("share"), F.bround("low", 4).alias("low"), F.bround("high", 4).alias("high"))


def resampled(e: DataFrame, by: list[str], resamples: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """by, all_n, all_k, low, high: the interval of k / n over resamples of whole entities; e: n and k of each entity in each group. Groups of
    fewer than two entities have none."""
    e = e.withColumn("at", F.row_number().over(Window.partitionBy(*by).orderBy("entity_id")) - 1)
    size = e.groupBy(*by).agg(F.count("*").alias("m"), F.sum("n").alias("all_n"), F.sum("k").alias("all_k")).filter("m >= 2")
    draws = size.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1)))).withColumn("d", F.explode(F.sequence(F.lit(0), F.col("m").cast("int") - 1)))
    pick = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *by, "r", "d")), 1, 8), 16, 10).cast("long") % F.col("m")
    rate = draws.withColumn("at", pick).join(F.broadcast(e), [*by, "at"]).groupBy(*by, "r").agg((F.sum("k") / F.sum("n").cast("double")).alias("rate"))
    place = rate.withColumn("i", F.row_number().over(Window.partitionBy(*by).orderBy("rate", "r")) - 1)
    ends = place.groupBy(*by).agg(*[F.max(F.when(F.col("i") == i, F.col("rate"))).alias(n) for i, n in ((int(0.025 * resamples), "low"), (min(resamples - 1, int(0.975 * resamples)), "high"))])
    return size.join(ends, by).select(*by, "all_n", "all_k", "low", "high")


def hypergeom_tail(k: Column, n: Column, successes: Column, population: Column) -> Column:
    """P(X >= k) when n are drawn of a population with so many successes; one-sided Fisher test. For small populations."""
    log_choose = lambda a, b: F.aggregate(F.filter(F.sequence(F.lit(0), b.cast("int")), lambda i: i > 0), F.lit(0.0), lambda s, i: s + F.log((a - b + i) / i.cast("double")))
    low, high = F.greatest(k, F.lit(0), n - (population - successes)), F.least(n, successes)
    terms = F.transform(F.sequence(low.cast("int"), high.cast("int")), lambda i: F.exp(log_choose(successes, i) + log_choose(population - successes, n - i) - log_choose(population, n)))
    tail = F.least(F.lit(1.0), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x))
    return F.when((population <= 0) | (n <= 0), 1.0).when(low > high, F.when(k > high, 0.0).otherwise(1.0)).otherwise(tail)


def systemic(t: Tables, provider: Column | None = None, least: int = 3, notable: float = 0.2) -> DataFrame:
    """Rules that fire at clients of one provider more often than at other entities. A pair of provider and rule is tested where
    it fires at a least number of the provider's clients; the pool are the entities for which the rule could be assessed.
    p: of the tail, q: over all tested pairs, severity: the highest that the rule has anywhere."""
    clients = t.entity.select("entity_id", F.coalesce(F.col("soc_provider") if provider is None else provider, F.lit("internal")).alias("provider"))
    rank = F.when(F.col("severity") == "critical", 3).when(F.col("severity") == "high", 2).when(F.col("severity") == "medium", 1).otherwise(0)
    hit = findings(t).groupBy("entity_id", "rule_id").agg(F.max(rank).alias("rank"), F.lit(True).alias("hit"))
    told = results(t).filter(F.col("state").isin(*ASSESSED)).select("entity_id", "rule_id")
    pool = told.join(hit, ["entity_id", "rule_id"], "full_outer").join(clients, "entity_id").withColumn("hit", F.coalesce("hit", F.lit(False)))
    of_rule = pool.groupBy("rule_id").agg(F.count_if("hit").alias("successes"), F.count("*").alias("pool"), F.max("rank").alias("rank"))
    met = pool.filter("provider <> 'internal'").groupBy("provider", "rule_id").agg(F.count_if("hit").alias("affected"), F.count("*").alias("assessable"))
    rows = met.filter("affected > 0").join(of_rule, "rule_id").join(clients.groupBy("provider").agg(F.count("*").alias("clients")), "provider")
    rows = rows.withColumn("tested", F.col("affected") >= least)
    p = hypergeom_tail(F.col("affected"), F.col("assessable"), F.col("successes"), F.col("pool"))
    tested = benjamini_hochberg(rows.filter("tested").withColumn("p", p), "p").select("provider", "rule_id", "p", "q")
    out = rows.join(tested, ["provider", "rule_id"], "left")
    level = F.when(~F.col("tested"), "not_tested").when(F.col("q") <= notable, "notable").otherwise("weak")
    severity = F.element_at(F.array(*map(F.lit, ("low", "medium", "high", "critical"))), F.col("rank") + 1)
    return out.select(
        "provider", "rule_id", "affected", "assessable", "clients", (F.col("successes") - F.col("affected")).alias("others_affected"), (F.col("pool") - F.col("assessable")).alias("others_assessable"),
        F.bround("p", 6).alias("p"), F.bround("q", 6).alias("q"), level.alias("level"), severity.alias("severity"),
    )


def systemic_of_models(t: Tables) -> DataFrame:
    """The same over the models by which entities run their operations, tested from two entities on."""
    return systemic(t, F.when(F.col("soc_model") == "inhouse", "internal").otherwise(F.col("soc_model")), least=2)


#: Monthly series: whether they stand on a logarithmic scale, and the least spread they are measured by.
SERIES = {"per_day": (True, 0.1), "tp_share": (False, 0.02), "auto_share": (False, 0.02)}
REFERENCE, LEAST_MONTHS, SLACK, INTERVAL = 3, 5, 0.5, 4.0


def time_shifts(t: Tables) -> DataFrame:
    """Each monthly series of at least ``LEAST_MONTHS`` points against its first ``REFERENCE``: the peaks of two-sided
    cumulative sums of what deviates from their median in units of their spread, the month in which one first leaves the
    decision interval, the month in which it last rose from zero before that, and medians before and from then on."""
    by = ["entity_id", "metric"]
    rows = monthly(t).unpivot(["entity_id", "month"], list(SERIES), "metric", "v").filter("v is not null")
    w = Window.partitionBy(*by).orderBy("month")
    rows = rows.withColumns({"i": F.row_number().over(w), "points": F.count("*").over(Window.partitionBy(*by))}).filter(F.col("points") >= LEAST_MONTHS)
    log = F.col("metric").isin(*[m for m, (l, _) in SERIES.items() if l])
    floor = F.create_map(*[F.lit(x) for m, (_, f) in SERIES.items() for x in (m, f)])[F.col("metric")]
    rows = rows.withColumn("x", F.when(log, F.log10(F.col("v") + 1)).otherwise(F.col("v")))
    early = F.when(F.col("i") <= REFERENCE, F.col("x"))
    med = rows.groupBy(*by).agg(median(early).alias("med"), median(F.when(F.col("i") <= REFERENCE, F.col("v"))).alias("before"))
    rows = rows.join(med, by)
    rows = rows.join(rows.groupBy(*by).agg(median(F.abs(early - F.col("med"))).alias("mad")), by)
    z = rows.filter(F.col("i") > REFERENCE).withColumn("z", (F.col("x") - F.col("med")) / F.greatest(1.4826 * F.col("mad"), floor))
    z = z.withColumn("series", F.concat_ws("|", *by))
    chart = cusum(z, "series", "month", "z", SLACK, INTERVAL)
    first = chart.groupBy(*by).agg(F.min(F.when(F.col("alarm"), F.col("i"))).alias("first"), F.max("up").alias("peak_up"), F.max("down").alias("peak_down"))
    at = chart.join(first, by).withColumn("rises", F.max(F.when(F.col("i") == F.col("first"), F.col("up") > INTERVAL)).over(Window.partitionBy(*by)))
    zero = F.when(F.col("rises"), F.col("up")).otherwise(F.col("down")) == 0
    start = at.groupBy(*by).agg(F.max(F.when(zero & (F.col("i") < F.col("first")), F.col("i"))).alias("last_zero"))
    found = first.join(start, by).withColumn("start", F.when(F.col("first").isNotNull(), F.coalesce("last_zero", F.lit(REFERENCE)) + 1))
    whole = rows.join(found, by)
    return whole.groupBy(*by).agg(
        F.max("points").alias("points"), F.bround(F.max("peak_up"), 4).alias("peak_up"), F.bround(F.max("peak_down"), 4).alias("peak_down"), F.max(F.when(F.col("i") == F.col("first"), F.col("month"))).alias("alarm_month"),
        F.max(F.when(F.col("i") == F.col("start"), F.col("month"))).alias("shift_from"), F.bround(F.max("before"), 6).alias("before"), F.bround(median(F.when(F.col("i") >= F.col("start"), F.col("v"))), 6).alias("after"),
    )


QUERIES = {
    "time_shifts": time_shifts,
    "robust_z_score": robust_z_scores, "iqr_bounds": quartiles, "percentile_rank": percentile_ranks, "ewma": ewma_chart, "wilson_interval": wilson_intervals, "spearman": spearman, "cohens_kappa": kappas,
    "cluster_bootstrap": bootstrap_intervals, "systemic_correlation": systemic, "systemic_correlation_models": systemic_of_models,
}
