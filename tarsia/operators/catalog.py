"""Submissions and their catalogue, source mappings, cumulative windows, word shingles, rule states and peer outliers."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarsia.functions.stats import micros
from tarsia.operators import contracts
from tarsia.operators.contracts import results
from tarsia.operators.peers import bridge
from tarsia.operators.records import SEVERITY, taxonomy
from tarsia.sources.projection import Tables

CUTS, SHINGLE, KEPT, SEED = 4, 3, 10, 42

# Catalogue of submissions


def submissions(t: Tables) -> DataFrame:
    """entity_id, tab, pub_seq, completeness, since, until, n: one batch for each month; those of June have no dates."""
    at = t.alert.select("entity_id", F.lit("alert").alias("tab"), F.col("created_at").alias("at")).unionByName(t.soc_case.select("entity_id", F.lit("soc_case").alias("tab"), F.col("opened_at").alias("at")))
    n = at.groupBy("entity_id", "tab", F.trunc(F.col("at").cast("date"), "month").alias("month")).agg(F.count("*").alias("n"))
    state = F.when(F.col("n") % 5 == 0, "rejected").when(F.col("n") % 5 == 1, "declared_empty").otherwise("rows")
    dated = F.month("month") != 6
    return n.select("entity_id", "tab", F.month("month").alias("pub_seq"), state.alias("completeness"), F.when(dated, F.col("month")).alias("since"), F.when(dated, F.add_months("month", 1)).alias("until"), "n")


def submitted_tables(t: Tables) -> DataFrame:
    """What is known of each table of an entity: rows if any batch had some, else the latest word."""
    latest = F.max_by("completeness", F.struct(F.col("completeness") == "rows", F.col("pub_seq")))
    return submissions(t).groupBy("entity_id", "tab").agg(latest.alias("completeness"))


def tables_for_period(t: Tables, start: str = "2026-02-15", end: str = "2026-04-01") -> DataFrame:
    """Tables of batches that overlap [start, end); a batch without dates always counts."""
    inside = F.col("since").isNull() | ((F.col("since") < F.lit(end).cast("date")) & (F.col("until") > F.lit(start).cast("date")))
    return submissions(t).filter(inside).groupBy("entity_id", "tab").agg(F.count("*").alias("n_batches"))


def window_status(t: Tables, start: str = "2026-04-01", end: str = "2026-05-01") -> DataFrame:
    """entity x table in a window: present (rows in it), else what was said of the table: rejected, declared_empty (with no
    rows, or by a batch that covers the window), stale (for other times only), omitted (never)."""
    since, until = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    rows = t.alert.select("entity_id", F.lit("alert").alias("tab"), F.col("created_at").alias("at")).unionByName(t.soc_case.select("entity_id", F.lit("soc_case").alias("tab"), F.col("opened_at").alias("at")))
    have = rows.filter((F.col("at") >= since) & (F.col("at") < until)).select("entity_id", "tab").distinct().withColumn("rows", F.lit(True))
    covers = tables_for_period(t, start, end).select("entity_id", "tab", F.lit(True).alias("covers"))
    grid = t.entity.select("entity_id", F.explode(F.array(F.lit("alert"), F.lit("soc_case"), F.lit("asset"))).alias("tab"))
    key = ["entity_id", "tab"]
    all_ = grid.join(have, key, "left").join(submitted_tables(t), key, "left").join(covers, key, "left")
    state = F.when(F.col("rows"), "present").when(F.col("completeness").isNull(), "omitted").when(F.col("completeness") == "rejected", "rejected")
    state = state.when((F.col("completeness") == "declared_empty") | F.col("covers"), "declared_empty").otherwise("stale")
    return all_.select("entity_id", F.col("tab").alias("table"), state.alias("state"))


def overlapping_batches(t: Tables) -> DataFrame:
    """Pairs of one entity's batches whose periods intersect, each once."""
    s = submissions(t).filter("since is not null").select("entity_id", "tab", "pub_seq", "since", "until")
    a, b = s.toDF("entity_id", "tab_a", "seq_a", "since_a", "until_a"), s.toDF("entity_id", "tab_b", "seq_b", "since_b", "until_b")
    met = a.join(b, "entity_id").filter("since_a < until_b and since_b < until_a and struct(tab_a, seq_a) < struct(tab_b, seq_b)")
    return met.select("entity_id", "tab_a", "seq_a", "tab_b", "seq_b")


def content_hash(t: Tables) -> DataFrame:
    """Rows of each entity's alerts and a sum of row hashes modulo 2**60, the same in any order of rows."""
    row = F.md5(F.concat_ws("|", "alert_id", "rule_id", "severity_final", "status"))
    h = t.alert.select("entity_id", F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(20,0)").alias("h"))
    return h.groupBy("entity_id").agg(F.count("*").alias("n"), (F.sum("h") % (1 << 60)).cast("long").alias("content_hash"))


def auto_registered(t: Tables) -> DataFrame:
    """The register, here without every fifth entity, and a default profile for entities seen in alerts only."""
    known = t.entity.filter(F.substring("entity_id", 2, 2).cast("int") % 5 != 0).select("entity_id", "sector", "size_band", F.lit("register").alias("origin"))
    seen = t.alert.select("entity_id").distinct().join(known, "entity_id", "left_anti")
    return known.unionByName(seen.select("entity_id", F.lit("unknown").alias("sector"), F.lit("unknown").alias("size_band"), F.lit("data").alias("origin")))


def cumulative_windows(t: Tables) -> DataFrame:
    """Counts of each entity up to each of CUTS equal steps over the whole span: one aggregation, then running sums."""
    us = micros(F.col("created_at"))
    span = t.alert.agg(F.min(us).alias("lo"), F.max(us).alias("hi"))
    a = t.alert.select("entity_id", "severity_final", "status", us.alias("us")).join(F.broadcast(span))
    cut = F.expr(f"cast(greatest(1, ({CUTS} * (us - lo) + (hi - lo) - 1) div greatest(hi - lo, 1)) as int)")
    n = a.groupBy("entity_id", cut.alias("cut")).agg(F.count("*").alias("alerts"), F.count_if(F.col("severity_final").isin("high", "critical")).alias("serious"), F.count_if(F.col("status") == "open").alias("open"))
    grid = n.select("entity_id").distinct().withColumn("cut", F.explode(F.sequence(F.lit(1), F.lit(CUTS))))
    so_far = Window.partitionBy("entity_id").orderBy("cut").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return grid.join(n, ["entity_id", "cut"], "left").select("entity_id", "cut", *[F.sum(F.coalesce(c, F.lit(0))).over(so_far).alias(c) for c in ("alerts", "serious", "open")])


# Source mappings


@dataclass
class Mapping:
    """How rows of an export become rows of a table: an expression for each column, the rows that are meant, and the
    columns without which a row is rejected."""

    columns: dict[str, Column]
    where: Column
    required: tuple[str, ...]

    def outcome(self) -> Column:
        """filtered, rejected:<column> or stored; needs the mapped columns."""
        first = F.when(~F.coalesce(self.where, F.lit(False)), "filtered")
        return reduce(lambda c, r: c.when(F.col(f"out.{r}").isNull(), f"rejected:{r}"), self.required, first).otherwise("stored")

    def apply(self, export: DataFrame) -> DataFrame:
        mapped = export.withColumn("out", F.struct(*[c.alias(n) for n, c in self.columns.items()]))
        return mapped.withColumn("outcome", self.outcome())


def first_filled(*columns: Column) -> Column:
    """The first value that isn't null or blank."""
    return F.coalesce(*[F.nullif(F.trim(c.cast("string")), F.lit("")) for c in columns])


def orders_mapping() -> Mapping:
    k = F.col("o_orderkey")
    return Mapping(
        columns={
            "alert_id": F.when(k % 29 != 0, F.concat(F.lit("A"), k.cast("string"))),
            "severity": taxonomy(F.regexp_extract("o_orderpriority", r"-(.*)$", 1), SEVERITY),
            "owner": first_filled(F.when(k % 3 == 0, "  "), F.when(k % 2 == 0, F.concat(F.lit("c"), (k % 7).cast("string"))), F.lit("nobody")),
            "closed": F.when(F.col("o_orderstatus") == "F", True).otherwise(F.lit(False)),
            "origin": F.lit("orders"),
        },
        where=F.col("o_orderstatus") != "P",
        required=("alert_id", "severity"),
    )


def mapped_orders(t: Tables) -> DataFrame:
    return orders_mapping().apply(t.orders).filter("outcome = 'stored'").select("out.*")


def mapping_coverage(t: Tables) -> DataFrame:
    """Rows of each file (here: priority) read, left out, rejected and stored, and whether that blocks it: an error
    from half a file of rejected rows."""
    m = orders_mapping().apply(t.orders).withColumn("file", F.col("o_orderpriority"))
    n = m.groupBy("file").agg(F.count("*").alias("n_read"), F.count_if(F.col("outcome") == "filtered").alias("filtered"), F.count_if(F.col("outcome").startswith("rejected")).alias("rejected"), F.count_if(F.col("outcome") == "stored").alias("stored"), F.count_if((F.col("outcome") == "stored") & (F.col("out.owner") != "nobody")).alias("owned"))
    return n.withColumn("level", F.when(F.col("rejected") == 0, "none").when(2 * F.col("rejected") >= F.col("n_read"), "error").otherwise("warning"))


# Text and values


def read_bool(text: Column) -> Column:
    v = F.lower(F.trim(text))
    return F.when(v.isin("yes", "y", "true", "on", "1"), True).when(v.isin("no", "n", "false", "off", "0"), False)


def read_number(text: Column) -> Column:
    """A number with or without separators of thousands, western (1,234,567.8) or Indian (12,34,567.8); else null."""
    v = F.trim(text)
    western, indian = r"^[+-]?\d{1,3}(,\d{3})+(\.\d+)?$", r"^[+-]?\d{1,2}(,\d{2})*,\d{3}(\.\d+)?$"
    return F.when(v.rlike(western) | v.rlike(indian) | v.rlike(r"^[+-]?\d+(\.\d+)?$"), F.regexp_replace(v, ",", "").try_cast("double"))


def parsed_values(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    text = F.when(k % 3 == 0, F.format_number("c_acctbal", 2)).when(k % 3 == 1, F.concat(F.lit(" "), F.col("c_acctbal").cast("decimal(12,2)").cast("string"))).otherwise("n/a")
    flag = F.when(k % 4 == 0, " Yes").when(k % 4 == 1, "OFF").when(k % 4 == 2, "").otherwise("perhaps")
    return t.customer.select("c_custkey", read_number(text).alias("number"), read_bool(flag).alias("flag"))


def word_shingles(text: Column, size: int = SHINGLE) -> Column:
    """Runs of words longer than two characters, in their order; fewer words than a run make one of all."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda x: F.length(x) > 2)
    # Bound to a variable first, so that a text is split once and not once a run.
    runs = F.flatten(F.transform(F.array(words), lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - size + 1, F.lit(1))), lambda i: F.concat_ws("_", F.slice(w, i, size)))))
    return F.filter(runs, lambda x: x != "")


def jaccard(a: Column, b: Column) -> Column:
    """Of the distinct elements of two arrays; 1 if both are empty."""
    a, b = F.array_distinct(a), F.array_distinct(b)
    both = F.size(F.array_intersect(a, b))
    return F.when(a.isNull() | b.isNull(), None).when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / (F.size(a) + F.size(b) - both))


def turn_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn's shingles (number, hashes of the first ten) and their similarity with the turn before."""
    s = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "text", word_shingles(F.col("text")).alias("s"))
    before = s.withColumn("p", F.lag("s").over(Window.partitionBy("conv_id").orderBy("turn", "text")))
    head = F.array_join(F.transform(F.slice("s", 1, KEPT), lambda x: F.substring(F.sha2(x, 256), 1, 12)), ",")
    return before.select("conv_id", "turn", F.size("s").alias("n_shingles"), head.alias("head"), F.bround(jaccard(F.col("s"), F.col("p")), 6).alias("similarity"))


# States of rules and outliers

def rule_states(t: Tables) -> DataFrame:
    return results(t).select("entity_id", "rule_id", "state")


def coverage(t: Tables) -> DataFrame:
    """Share of rules that could be assessed, and what it makes of an entity."""
    return contracts.coverage(t).select("entity_id", "assessed", "applicable", "coverage", "level")


#: Least scale of a share and of a logarithm, least population, least |z|, and how many are kept.
FLOORS, LEAST_N, LEAST_Z, TOP = {"share": 0.02, "log": 0.1}, 30, 3.5, 10


def entity_metrics(t: Tables) -> DataFrame:
    """entity_id, metric, n, v: shares of alerts, and the logarithm of their number."""
    share = lambda c: F.count_if(c) / F.count("*")
    shares = {"fp_share": F.col("disposition") == "false_positive", "benign_share": F.col("disposition") == "benign", "auto_share": F.col("closed_by_type") == "automation", "open_share": F.col("status") == "open", "critical_share": F.col("severity_final") == "critical", "unacked_share": F.col("acknowledged_at").isNull()}
    wide = t.alert.groupBy("entity_id").agg(F.count("*").alias("n"), F.log10(F.count("*") + 1).alias("log_alerts"), *[share(c).alias(m) for m, c in shares.items()])
    return wide.unpivot(["entity_id", "n"], ["log_alerts", *shares], "metric", "v").filter(F.col("n") >= LEAST_N)


def peer_outliers(t: Tables) -> DataFrame:
    """Metrics of an entity far from the median of at least three peers."""
    m = entity_metrics(t)
    near = bridge(t).select("entity_id", "peer_id").join(m.select(F.col("entity_id").alias("peer_id"), "metric", F.col("v").alias("pv")), "peer_id")
    med = near.groupBy("entity_id", "metric").agg(F.percentile("pv", F.lit(0.5)).alias("med"), F.count("*").alias("n_peers"))
    mad = near.join(med, ["entity_id", "metric"]).groupBy("entity_id", "metric", "med", "n_peers").agg(F.percentile(F.abs(F.col("pv") - F.col("med")), F.lit(0.5)).alias("mad"))
    least = F.when(F.col("metric").startswith("log"), FLOORS["log"]).otherwise(FLOORS["share"])
    z = (F.col("v") - F.col("med")) / F.greatest(1.4826 * F.col("mad"), least)
    out = m.join(mad, ["entity_id", "metric"]).filter("n_peers >= 3").withColumn("z", F.bround(z, 4)).filter(F.abs("z") >= LEAST_Z)
    return out.select("entity_id", "metric", F.bround("v", 6).alias("value"), F.bround("med", 6).alias("baseline"), "n_peers", "z")


def anomaly_scan(t: Tables) -> DataFrame:
    """The farthest outliers of each entity, at most TOP, and how many more there are."""
    w = Window.partitionBy("entity_id")
    ranked = peer_outliers(t).withColumn("rank", F.row_number().over(w.orderBy(F.desc(F.abs("z")), "metric"))).withColumn("suppressed", F.greatest(F.lit(0), F.count("*").over(w) - TOP))
    return ranked.filter(F.col("rank") <= TOP).select("entity_id", "rank", "metric", "z", "suppressed")


def seeded_split(t: Tables, share: float = 0.4, seed: int = SEED) -> DataFrame:
    """Entities in the order of a seeded hash; the first share of them for calibration. Numbers a list of entities."""
    h = t.entity.select("entity_id", F.sha2(F.concat(F.lit(f"{seed}:"), "entity_id"), 256).alias("h")).withColumn("n", F.row_number().over(Window.orderBy("h")))
    total = t.entity.agg(F.count("*").alias("total"))
    return h.join(F.broadcast(total)).select("entity_id", F.when(F.col("n") <= F.bround(share * F.col("total")), "calibration").otherwise("holdout").alias("part"))
