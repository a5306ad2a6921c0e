"""Reading submissions: delimited and JSON files, headers, aliases, hygiene of rows, and what speaks against taking a file.

The exports that are read here are written from the given tables first, with the faults that such files have.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarsia.operators.catalog import first_filled, read_number
from tarsia.operators.contracts import inputs
from tarsia.operators.records import SEVERITY, dq_issues, norm_hash, pseudonym, read_time, taxonomy
from tarsia.sources.projection import Tables
from tarsia.sources.storage import shared_dir

# Names under which exports give a column.
ALIASES = {
    "order_id": ("order_id", "id", "order"),
    "status": ("status", "state", "order_state"),
    "amount": ("total_price", "amount", "price"),
    "severity": ("priority", "urgency"),
}
# Checks that keep a submission from being published, since its records can't be read reliably. What the others
# find is evidence: blocking it would let a submitter correct the signal away.
BLOCKING = ("missing_required_field", "duplicate_primary_keys", "unrecognised_value")


def fresh(t: Tables, name: str) -> str:
    there = shared_dir(t.spark)
    if not there:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{there.rstrip('/')}/tarsia-{name}-{uuid.uuid4().hex}"


def header_key(name: Column) -> Column:
    """The form in which headers are compared: lower case, all but letters and digits as one _, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", "_"), "^_+|_+$", "")


def header_name(name: str, seen: set[str], place: int) -> str:
    """The key of one header of a file: blank ones by their place, repeated ones numbered."""
    key = "".join(c if c.isalnum() else " " for c in name.lower()).split()
    base = "_".join(key) or f"column_{place}"
    out, n = base, 2
    while out in seen:
        out, n = f"{base}_{n}", n + 1
    seen.add(out)
    return out


def scan_csv(t: Tables, path: str) -> DataFrame:
    """A delimited file, all columns as text under the keys of its headers, without rows that are blank throughout."""
    head = t.spark.read.text(path).first()  # the header line
    names: set[str] = set()
    keys = [header_name(h.strip('"'), names, k + 1) for k, h in enumerate(head[0].split(","))] if head else []
    rows = t.spark.read.csv(path, header=True, quote='"', escape='"', schema=", ".join(f"`{k}` string" for k in keys), enforceSchema=True) if keys else t.spark.read.text(path)
    filled = F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in rows.columns]).isNotNull()
    return rows.filter(filled)


def with_aliases(rows: DataFrame, aliases: dict[str, tuple[str, ...]] = ALIASES) -> DataFrame:
    """The canonical columns, each from the first of its names that is there and filled; other columns go."""
    there = {c: [F.col(a) for a in names if a in rows.columns] for c, names in aliases.items()}
    return rows.select(*[(first_filled(*cols) if cols else F.lit(None).cast("string")).alias(c) for c, cols in there.items()])


def orders_csv(t: Tables) -> DataFrame:
    """Orders as an export: odd headers, blank rows, one column under two names."""
    k = F.col("o_orderkey")
    blank = k % 23 == 0
    text = lambda c: F.when(~blank, c.cast("string"))
    rows = t.orders.select(
        text(k).alias("Order-ID"), text(F.when(k % 3 == 0, F.lit(" ")).otherwise(F.col("o_orderstatus"))).alias(" State "), text(F.col("o_orderstatus")).alias("order STATE"),
        text(F.format_number(F.round("o_totalprice", 2), 2)).alias("Total  Price"), text(F.regexp_extract("o_orderpriority", r"-(.*)$", 1)).alias("Priority"))
    path = fresh(t, "orders-csv")
    rows.write.csv(path, header=True, emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return with_aliases(scan_csv(t, path)).select(F.col("order_id").try_cast("long").alias("order_id"), "status", read_number(F.col("amount")).alias("amount"), taxonomy(F.col("severity"), SEVERITY).alias("severity"))


def scan_json(t: Tables, path: str, schema: str) -> DataFrame:
    """One object a line; lines that aren't one come with the text in _bad and null columns."""
    return t.spark.read.schema(f"{schema}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)


def events_json(t: Tables) -> DataFrame:
    """Events written one object a line, every fortieth cut short, and read back: rows and unreadable lines of each type."""
    e = t.spark.read.parquet(f"{t.sf_dir}/events.parquet")
    whole = F.to_json(F.struct("event_id", "user_id", "event_type", "value"))
    path = fresh(t, "events-json")
    e.select(F.when(F.col("event_id") % 40 == 0, F.substring(whole, 1, 20)).otherwise(whole).alias("line")).write.text(path)
    rows = scan_json(t, path, "event_id long, user_id long, event_type string, value double")
    kind = F.when(F.col("_bad").isNotNull(), "unreadable").otherwise(F.col("event_type"))
    return rows.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.bround(F.sum(F.col("value").cast("decimal(18,4)")), 4).cast("double").alias("total"))


def envelopes(t: Tables) -> DataFrame:
    """Objects that hold their rows in a field data, as services answer: one for each customer, read back row by row."""
    o = t.orders.filter("o_orderkey % 5 = 0").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))).alias("data"))
    path = fresh(t, "envelope-json")
    o.select(F.to_json(F.struct(F.col("o_custkey").alias("source"), "data")).alias("line")).write.text(path)
    rows = scan_json(t, path, "source long, data array<struct<o_orderkey: long, o_orderstatus: string>>")
    return rows.select("source", F.inline("data")).withColumnsRenamed({"o_orderkey": "order_id", "o_orderstatus": "status"})


def headers(t: Tables) -> DataFrame:
    """Names of parts as if they were the headers of a brand's file: keys, repeated ones numbered."""
    p = t.spark.read.parquet(f"{t.sf_dir}/part.parquet")
    raw = F.concat(F.lit(" "), F.regexp_replace(F.upper("p_name"), " ", " - "), F.when(F.col("p_partkey") % 2 == 0, F.lit(" #")).otherwise(F.lit("!")))
    rows = p.select("p_partkey", "p_brand", header_key(raw).alias("key"))
    n = F.row_number().over(Window.partitionBy("p_brand", "key").orderBy("p_partkey"))
    return rows.withColumn("n", n).select("p_partkey", "key", F.when(F.col("n") == 1, F.col("key")).otherwise(F.concat_ws("_", "key", "n")).alias("name"))


def hygiene(t: Tables) -> DataFrame:
    """Alerts as submitted, made fit: who closed is a person if not said, people's names are pseudonyms, a missing final
    severity is the first one."""
    k = F.substring("alert_id", 2, 8).cast("long")
    raw = t.alert.select("entity_id", "alert_id", "severity_orig", F.when(k % 17 != 0, F.col("severity_final")).alias("severity_final"), F.when(k % 13 == 0, " ").otherwise(F.col("closed_by_type")).alias("closed_by_type"), "closed_by")
    kind = F.coalesce(F.nullif(F.lower(F.trim("closed_by_type")), F.lit("")), F.lit("human"))
    return raw.select("entity_id", "alert_id", F.coalesce("severity_final", "severity_orig").alias("severity_final"), kind.alias("closed_by_type"), F.when(kind == "human", pseudonym(F.col("closed_by"))).otherwise(F.col("closed_by")).alias("closed_by"))


def comment_hygiene(t: Tables) -> DataFrame:
    """Comments (here: turns) leave their hash and length behind, their text goes."""
    c = t.spark.read.parquet(f"{t.sf_dir}/conversations.parquet")
    return c.groupBy("conv_id").agg(F.count("*").alias("n"), F.countDistinct(norm_hash(F.col("text"))).alias("distinct"), F.sum(F.length("text")).alias("length"))


def period_bounds(label: Column) -> tuple[Column, Column]:
    """[start, end) of 2026, 2026-Q1, 2026-H2 or 2026-03; null for any other label."""
    part = lambda g: F.nullif(F.regexp_extract(F.trim(label), r"^(\d{4})(?:-(?:Q([1-4])|H([12])|(0[1-9]|1[0-2])))?$", g), F.lit("")).cast("int")
    year, q, h, m = part(1), part(2), part(3), part(4)
    first = F.coalesce((q - 1) * 3 + 1, (h - 1) * 6 + 1, m, F.lit(1))
    months = F.when(q.isNotNull(), 3).when(h.isNotNull(), 6).when(m.isNotNull(), 1).otherwise(12)
    start = F.make_date(year, first, F.lit(1))
    return start, F.add_months(start, months)


def periods(t: Tables) -> DataFrame:
    """Alerts in each of the periods that their own dates name, and in one that names none."""
    at = F.col("created_at")
    labels = F.array(F.date_format(at, "yyyy"), F.concat(F.date_format(at, "yyyy-"), F.lit("Q"), F.quarter(at)), F.concat(F.date_format(at, "yyyy-"), F.lit("H"), F.when(F.month(at) < 7, 1).otherwise(2)), F.date_format(at, "yyyy-MM"), F.lit("last year"))
    rows = t.alert.select(F.explode(labels).alias("label")).groupBy("label").agg(F.count("*").alias("n"))
    start, end = period_bounds(F.col("label"))
    return rows.select("label", "n", start.alias("start"), end.alias("end"))


def chain(t: Tables) -> DataFrame:
    """A log of cases, each row with a hash over its predecessor's id and its own content; a few rows were changed later."""
    w = Window.partitionBy("entity_id").orderBy("case_id")
    rows = t.soc_case.select("entity_id", "case_id", "severity", F.lag("case_id", 1, "start").over(w).alias("before"))
    k = F.substring("case_id", 2, 8).cast("long")
    return rows.withColumn("hash", F.sha2(F.concat_ws("|", "before", "case_id", "severity"), 256)).withColumn("severity", F.when(k % 101 == 0, "low").otherwise(F.col("severity")))


def chain_verify(t: Tables) -> DataFrame:
    """entity_id, rows, broken ones and the first of them."""
    w = Window.partitionBy("entity_id").orderBy("case_id")
    rows = chain(t).withColumn("ok", (F.sha2(F.concat_ws("|", "before", "case_id", "severity"), 256) == F.col("hash")) & (F.col("before") == F.lag("case_id", 1, "start").over(w)))
    return rows.groupBy("entity_id").agg(F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("broken"), F.min(F.when(~F.col("ok"), F.col("case_id"))).alias("first_break"))


def invalid_times(t: Tables) -> DataFrame:
    """Texts that stand where a time should and can't be read as one, for each user."""
    e = t.spark.read.parquet(f"{t.sf_dir}/events.parquet")
    k = F.col("event_id") % 7
    text = F.when(k == 0, "soon").when(k == 1, " ").when(k == 2, "2024-13-45 10:00:00").otherwise(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss"))
    rows = e.select("user_id", text.alias("text"))
    bad = (F.trim("text") != "") & read_time(F.col("text")).isNull()
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(bad).alias("invalid")).filter("invalid > 0")


def rule_inputs(t: Tables) -> DataFrame:
    """entity_id, rule_id, state: not_assessed where a table is lacking, degraded where a column of alerts is useless, else
    assessed."""
    state = F.when(F.size("missing") > 0, "not_assessed").when(F.size("blind") > 0, "degraded").otherwise("assessed")
    return inputs(t).select("entity_id", "rule_id", state.alias("state"))


def rule_input_coverage(t: Tables) -> DataFrame:
    states = ("assessed", "degraded", "not_assessed")
    return rule_inputs(t).groupBy("entity_id").agg(*[F.count_if(F.col("state") == s).alias(s) for s in states])


def dependency_issues(t: Tables) -> DataFrame:
    """entity_id, check, need, rules: tables that an entity lacks (rule_table_missing) and columns of its alerts that say nothing
    (rule_input_missing), with the rules that can't be told or can't fire for it."""
    rows = inputs(t)
    of = lambda c, check, name: rows.select("entity_id", F.lit(check).alias("check"), F.explode(c).alias("need"), "rule_id").withColumn("need", name(F.col("need")))
    both = of("missing", "rule_table_missing", lambda n: n).unionByName(of("blind", "rule_input_missing", lambda n: F.concat(F.lit("alert."), n)))
    return both.groupBy("entity_id", "check", "need").agg(F.array_join(F.sort_array(F.collect_set("rule_id")), ",").alias("rules"))


def with_faults(t: Tables) -> Tables:
    """The tables with alerts as careless submitters send them: of every fifth entity some twice, of the next with words that
    nobody knows, of the next without severity; others are as they were."""
    e, k = F.substring("entity_id", 2, 2).cast("int") % 5, F.substring("alert_id", 2, 8).cast("long")
    a = t.alert.withColumns({
        "disposition": F.when((e == 2) & (k % 40 == 0), "unmapped").otherwise(F.col("disposition")),
        "severity_final": F.when((e == 3) & (k % 50 == 0), " ").otherwise(F.col("severity_final")),
    })
    out = Tables(t.spark, t.sf_dir)
    for n in ("entity", "asset", "soc_case", "case_alert_link"):
        setattr(out, n, getattr(t, n))
    out.alert = a.withColumn("copy", F.explode(F.when((e == 1) & (k % 60 == 0), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("copy")
    return out


def blocking(t: Tables) -> DataFrame:
    """entity_id, blocking and reported (checks that find something, joined by commas), and what becomes of the submission by the
    way it comes: an upload with a blocking problem is held, one by the interface rejected, others are published."""
    found = dq_issues(t).select("entity_id", F.split_part("check", F.lit(":"), F.lit(1)).alias("check")).distinct()
    stops = F.col("check").isin(*BLOCKING)
    names = lambda c: F.array_join(F.sort_array(F.collect_set(F.when(c, F.col("check")))), ",")
    each = found.groupBy("entity_id").agg(names(stops).alias("blocking"), names(~stops).alias("reported"))
    rows = t.entity.select("entity_id").join(each, "entity_id", "left").fillna("", ["blocking", "reported"])
    by = lambda word: F.when(F.col("blocking") != "", word).otherwise("published")
    return rows.select("entity_id", "blocking", "reported", by("held").alias("upload"), by("rejected").alias("interface"), F.lit("published").alias("automatic"))


def blocking_of_faulty(t: Tables) -> DataFrame:
    return blocking(with_faults(t))


def csv_safe(text: Column) -> Column:
    """Text that spreadsheets would take for a formula starts with an apostrophe."""
    return F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)


def exported(t: Tables) -> DataFrame:
    """Customers as an export whose cells are safe, read back."""
    k = F.col("c_custkey")
    name = F.concat(F.when(k % 4 == 0, "=").when(k % 4 == 1, "@").when(k % 4 == 2, "-").otherwise(""), "c_name")
    path = fresh(t, "customers-csv")
    t.customer.select("c_custkey", csv_safe(name).alias("name"), csv_safe(F.col("c_mktsegment")).alias("segment")).write.csv(path, header=True)
    return t.spark.read.csv(path, header=True, schema="c_custkey long, name string, segment string")


def flat_mapping(t: Tables) -> DataFrame:
    """The older kind of mapping: one table, columns by name, values by word; a severity serves as first and final one."""
    columns = {"id": F.concat(F.lit("A"), F.col("o_orderkey").cast("string")), "state": F.create_map(*[F.lit(x) for kv in (("F", "closed"), ("O", "open")) for x in kv])[F.col("o_orderstatus")], "severity_orig": taxonomy(F.regexp_extract("o_orderpriority", r"-(.*)$", 1), SEVERITY)}
    out = t.orders.select(*[c.alias(n) for n, c in columns.items()])
    return out.withColumn("severity_final", F.col("severity_orig")).groupBy("state", "severity_orig", "severity_final").agg(F.count("*").alias("n"))


QUERIES = {
    "scan_csv": orders_csv, "scan_json": events_json, "scan_json_envelope": envelopes, "header_normalise": headers, "row_hygiene": hygiene, "comment_hygiene": comment_hygiene, "period_bounds": periods,
    "hash_chain_verify": chain_verify, "invalid_timestamp": invalid_times, "rule_input_coverage": rule_input_coverage, "dependency_issues": dependency_issues, "blocking_decision": blocking_of_faulty, "export_csv": exported, "flat_mapping": flat_mapping,
}
