"""Files of a submission, what they are taken for, and what becomes of them: published batches and persisted runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarsia.operators.contracts import results as rule_results
from tarsia.operators.ingest import blocking, fresh, header_key, scan_json, with_faults
from tarsia.operators.rules import findings
from tarsia.operators.scoring import domain_scores, review_queue, risk_index
from tarsia.sources.projection import Tables

# Names of tables, parts of file names that stand for a table (the first that fits counts), and headers that do.
TABLES = ("alert", "case_record", "case", "escalation", "closure", "workflow_event", "asset", "log_source_daily", "declared_kpi", "entity", "detection_rule", "case_alert_link", "sla_policy", "external_report", "remediation")
PARTS = (
    ("case_alert_link", "case_alert_link"), ("workflow_event", "workflow_event"), ("workflow", "workflow_event"), ("lifecycle", "workflow_event"), ("detection_rule", "detection_rule"), ("detection", "detection_rule"),
    ("sla_policy", "sla_policy"), ("sla", "sla_policy"), ("external_report", "external_report"), ("log_source_daily", "log_source_daily"), ("log_source", "log_source_daily"), ("declared_kpi", "declared_kpi"),
    ("escalat", "escalation"), ("closur", "closure"), ("case", "case_record"), ("incident", "case_record"), ("ticket", "case_record"), ("alert", "alert"), ("notable", "alert"), ("asset", "asset"), ("host", "asset"),
    ("inventory", "asset"), ("telemetry", "log_source_daily"), ("kpi", "declared_kpi"), ("metric", "declared_kpi"), ("entity", "entity"), ("cse", "entity"), ("organization", "entity"), ("event", "alert"),
)
HEADERS = (
    (("alert_id", "notable_id", "alertid"), "alert"), (("case_id", "incident_number", "ticket_id"), "case_record"), (("escalation_id", "from_tier", "to_tier"), "escalation"), (("closure_id", "comment", "duration_seconds"), "closure"),
    (("step_name", "step_order", "activity"), "workflow_event"), (("asset_id", "criticality", "hostname"), "asset"), (("event_count", "log_source_type"), "log_source_daily"), (("declared_value", "metric", "metric_name"), "declared_kpi"), (("sector", "size_band"), "entity"),
)
POLICIES = ("auto", "strict", "if_clean", "preview")
CLAIMED = "notable_%"  # file names that the mapping of the events' export describes


def recognised(stem: Column, headers: Column) -> Column:
    """The table that a file's name or headers stand for, else null."""
    name = F.lower(F.trim(stem))
    keys = F.transform(headers, header_key)
    by_name = [F.when(name.contains(p), table) for p, table in PARTS]
    by_header = [F.when(F.arrays_overlap(keys, F.array(*map(F.lit, names))), table) for names, table in HEADERS]
    return F.coalesce(F.when(name.isin(*TABLES), name), *by_name, *by_header)


def listing(t: Tables) -> DataFrame:
    """customer, stem, headers: one file of each customer, named in the ways that people name files."""
    k = F.col("c_custkey").cast("string")
    named = ["alert", " CASE ", "Notables_{}", "case_alert_link_{}", "workflow-export", "Lifecycle{}", "detections", "SLA targets", "tickets", "hosts {}", "kpis", "cse list", "events", "escalated closures"]
    by_header = [" Alert ID ", "Incident-Number", "From Tier", "Comment", "step name", "HostName", "event_count", "Metric Name", "Size Band", "colour"]
    stems = F.array(*[F.replace(F.lit(n), F.lit("{}"), k) for n in named], *[F.concat(F.lit("x"), k)] * len(by_header))
    heads = F.array(*[F.array(F.lit("a"))] * len(named), *[F.array(F.lit("a"), F.lit(h)) for h in by_header])
    at = (F.col("c_custkey") % (len(named) + len(by_header)) + 1).cast("int")
    return t.customer.select("c_custkey", F.element_at(stems, at).alias("stem"), F.element_at(heads, at).alias("headers"))


def recognise(t: Tables) -> DataFrame:
    return listing(t).select("c_custkey", recognised(F.col("stem"), F.col("headers")).alias("tab"))


def declared_empty(t: Tables) -> DataFrame:
    """One delimited file of each nation, a header line and the orders of its customers; every fourth has no rows, every
    fifth headers that stand for no table. A file with headers only says that its table was submitted and is empty."""
    head = F.when(F.col("n_nationkey") % 5 == 3, "colour,size").otherwise("Alert ID,Status")
    nations = t.spark.read.parquet(f"{t.sf_dir}/nation.parquet")
    lines = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).filter("c_nationkey % 4 <> 0").select(F.col("c_nationkey").alias("nation"), F.concat_ws(",", "o_orderkey", "o_orderstatus").alias("line"))
    path = fresh(t, "nations")
    nations.select(F.col("n_nationkey").alias("nation"), head.alias("line")).unionByName(lines).write.partitionBy("nation").text(path)
    read = t.spark.read.text(path)
    is_head = F.col("value").rlike("^[A-Za-z]")
    files = read.filter(F.trim("value") != "").groupBy("nation").agg(F.max(F.when(is_head, F.col("value"))).alias("head"), F.count_if(~is_head).alias("n"))
    tab = recognised(F.lit("export"), F.split("head", ","))
    return files.select("nation", tab.alias("tab"), F.when(F.col("n") > 0, "rows").otherwise("declared_empty").alias("completeness"), "n").filter("tab is not null")


def scan_published(t: Tables) -> DataFrame:
    """Batches of orders, one for each year, of which later ones have a column more and one holds a file that can't be
    read. Only published batches are read, their columns united by name."""
    year = F.year("o_orderdate")
    rows = t.orders.select((year - 1991).alias("pub_seq"), F.col("o_orderkey").alias("order_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    path = fresh(t, "batches")
    rows.filter("pub_seq <= 3").drop("priority").write.partitionBy("pub_seq").parquet(path)
    rows.filter("pub_seq > 3").write.mode("append").partitionBy("pub_seq").parquet(path)
    t.spark.createDataFrame([("no columns here",)], "value string").write.mode("append").text(f"{path}/pub_seq=2")
    batches = t.orders.groupBy((year - 1991).alias("pub_seq")).agg(F.min("o_custkey").alias("first_customer")).withColumn("state", F.when(F.col("pub_seq") % 3 == 0, "held").otherwise("published"))
    known = batches.filter("state = 'published'").select("pub_seq", "first_customer")
    read = t.spark.read.option("mergeSchema", True).option("ignoreCorruptFiles", True).parquet(path)
    return read.join(known, "pub_seq").select("pub_seq", "first_customer", "order_id", "status", "priority")  # prunes the folders of other batches


def publish(t: Tables) -> DataFrame:
    """policy, entity_id, status, n_problems, n_rows: what becomes of an entity's alerts under each policy, and the rows that
    readers then see. auto publishes, strict rejects a submission with problems, if_clean holds it, preview stores
    nothing. Rows are written first, the batch last: readers see rows of published batches only."""
    t = with_faults(t)
    found = blocking(t).select("entity_id", F.size(F.filter(F.split("blocking", ","), lambda c: c != "")).alias("n_problems"))
    grid = found.withColumn("policy", F.explode(F.array(*map(F.lit, POLICIES))))
    clean = F.col("n_problems") == 0
    status = F.when(F.col("policy") == "preview", "preview").when(clean | (F.col("policy") == "auto"), "published").when(F.col("policy") == "strict", "rejected").otherwise("held")
    rows_at, batches_at = fresh(t, "staged-alerts"), fresh(t, "batches")
    batches = grid.select("policy", "entity_id", status.alias("status"), "n_problems")
    stored = batches.filter("status in ('published', 'held')").select("policy", "entity_id")
    t.alert.select("entity_id", "alert_id").join(stored, "entity_id").write.partitionBy("policy").parquet(rows_at)
    batches.write.parquet(batches_at)
    known = t.spark.read.schema(batches.schema).parquet(batches_at)
    seen = t.spark.read.parquet(rows_at).join(known.filter("status = 'published'"), ["policy", "entity_id"], "left_semi").groupBy("policy", "entity_id").agg(F.count("*").alias("n_rows"))
    return known.join(seen, ["policy", "entity_id"], "left").select("policy", "entity_id", "status", "n_problems", F.coalesce("n_rows", F.lit(0)).alias("n_rows"))


def persist_run(t: Tables, runs: tuple[str, ...] = ("R1", "R2", "R2")) -> DataFrame:
    """tab, run_id, entity_id, n: the results of a run, each table partitioned by run. A run that is stored again replaces
    itself and leaves others alone."""
    results = {
        "finding": findings(t), "domain_score": domain_scores(t), "entity_score": risk_index(t), "rule_result": rule_results(t),
        "evidence": findings(t).filter("evidence is not null").select("entity_id", "rule_id", F.explode(F.split("evidence", ",")).alias("record_id")), "queue": review_queue(t),
    }
    path, out = fresh(t, "runs"), []
    for tab, rows in results.items():
        once = t.once(f"run_{tab}", lambda rows=rows: rows)
        for run in runs:
            once.withColumn("run_id", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(f"{path}/{tab}")
        out.append(t.spark.read.parquet(f"{path}/{tab}").groupBy(F.lit(tab).alias("tab"), "run_id", "entity_id").agg(F.count("*").alias("n")))
    return reduce(DataFrame.unionByName, out)


def file_issues(t: Tables) -> DataFrame:
    """file, check, severity, n: files of events, one for each twentieth of users, that can't be read, are read in part, are
    told apart by neither name nor headers, or that the mapping doesn't describe."""
    e = t.spark.read.parquet(f"{t.sf_dir}/events.parquet")
    part = (F.col("user_id") % 20).cast("int")
    cut = (part == 7) | ((part % 3 == 0) & (F.col("event_id") % 40 == 0))
    whole = F.to_json(F.struct("event_id", "event_type"))
    path = fresh(t, "event-files")
    e.select(part.alias("part"), F.when(cut, F.substring(whole, 1, 12)).otherwise(whole).alias("line")).write.partitionBy("part").text(path)
    rows = scan_json(t, path, "event_id long, event_type string, part int")
    n = rows.groupBy("part").agg(F.count("*").alias("n"), F.count_if(F.col("_bad").isNotNull() & F.col("event_id").isNull()).alias("bad"))
    stem = F.concat(F.when(F.col("part") == 11, "misc_").when(F.col("part") == 13, "cases_").otherwise("notable_"), F.col("part").cast("string"))
    known = recognised(stem, F.array(F.lit("event")))
    check = F.when(F.col("bad") == F.col("n"), "file_unreadable").when(known.isNull(), "file_not_recognised").when(~stem.like(CLAIMED), "file_not_mapped").when(F.col("bad") > 0, "file_partly_read")
    out = n.select(stem.alias("file"), check.alias("check"), F.when(check == "file_unreadable", "error").otherwise("warning").alias("severity"), F.when(check == "file_partly_read", F.col("bad")).otherwise(1).alias("n"))
    return out.filter("check is not null")


QUERIES = {
    "recognise_table": recognise, "empty_declares": declared_empty, "scan_parquet_published": scan_published, "publish_batch": publish, "persist_run": persist_run, "file_issues": file_issues,
}
