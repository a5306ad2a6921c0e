"""Record versions, windows, cleaning of text and data-quality checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarsia.sources.projection import CANONICAL, Tables

KEY = b"not-a-secret: the key is a parameter"


def batches(t: Tables) -> DataFrame:
    """Alerts as two sources published them: everything with number 1, a third again, corrected, with number 2 or 3; some
    without an id."""
    k = F.substring("alert_id", 2, 8).cast("long")
    source = F.when(k % 2 == 0, "siem").otherwise("desk")
    first = t.alert.select(source.alias("source"), "entity_id", "alert_id", "severity_final", "status", F.lit(1).alias("pub_seq"))
    again = first.filter(k % 3 != 0).withColumns({"pub_seq": (1 + k % 3).cast("int"), "status": F.lit("closed")})
    return first.unionByName(again).withColumn("alert_id", F.when(k % 97 != 0, F.col("alert_id")))


def current_version(rows: DataFrame, keys: list[str], order: str = "pub_seq") -> DataFrame:
    """Of each key the rows of the latest publication, distinct. Repeats within it stay one; a row with a null in its key
    has no other versions, so it stays."""
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    latest = F.rank().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    keyed = rows.filter(known).withColumn("_r", latest).filter("_r = 1").drop("_r")
    return keyed.unionByName(rows.filter(~known)).distinct()


def as_of(rows: DataFrame, max_seq: int, keys: list[str]) -> DataFrame:
    return current_version(rows.filter(F.col("pub_seq") <= max_seq), keys)


def merged_entity(t: Tables) -> DataFrame:
    """Per entity and column the newest value that isn't null."""
    e = t.entity.select("entity_id", "sector", "size_band", F.lit(1).alias("seq"))
    later = e.filter("size_band <> 'small'").select("entity_id", F.lit(None).cast("string").alias("sector"), F.upper("size_band").alias("size_band"), F.lit(2).alias("seq"))
    newest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq")))
    return e.unionByName(later).groupBy("entity_id").agg(newest("sector").alias("sector"), newest("size_band").alias("size_band"))


def windowed_alerts(t: Tables, start: str, end: str) -> DataFrame:
    """Alerts created in [start, end), with what happened at its end or later masked."""
    since, until = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    late = F.coalesce(F.col("closed_at") >= until, F.lit(False))
    a = t.alert.filter((F.col("created_at") >= since) & (F.col("created_at") < until))
    masked = {c: F.when(~late, F.col(c)) for c in ("closed_at", "closed_by", "closed_by_type", "disposition", "playbook_id")}
    masked |= {c: F.when(F.col(c) < until, F.col(c)) for c in ("acknowledged_at", "first_touch_at")}
    return a.withColumns(masked | {"status": F.when(late, "open").otherwise(F.col("status")), "was_masked": late})


def table_status(t: Tables) -> DataFrame:
    """entity x table: present or omitted."""
    names = ("alert", "soc_case", "escalation", "closure", "asset", "remediation", "external_report")
    have = reduce(DataFrame.unionByName, [getattr(t, n).select("entity_id", F.lit(n).alias("table")).distinct() for n in names])
    grid = t.entity.select("entity_id", F.explode(F.array(*map(F.lit, names))).alias("table"))
    return grid.join(have.withColumn("x", F.lit(1)), ["entity_id", "table"], "left").select("entity_id", "table", F.when(F.col("x") == 1, "present").otherwise("omitted").alias("state"))


def fingerprint(t: Tables) -> DataFrame:
    """Rows of each canonical table and a sum of their hashes modulo 2**60, the same in any order of rows."""

    def one(name: str) -> DataFrame:
        df = getattr(t, name)
        row = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in df.columns]))
        h = F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(20,0)")
        return df.agg(F.lit(name).alias("table"), F.count("*").alias("n"), F.coalesce(F.sum(h) % (1 << 60), F.lit(0)).cast("long").alias("hash"))

    return reduce(DataFrame.unionByName, [one(n) for n in CANONICAL])


# Text


def pseudonym(value: Column, key: bytes = KEY, prefix: str = "U_") -> Column:
    """prefix and 16 hex digits of HMAC-SHA256(key, value), from built-in functions; null and empty stay null."""
    block = key.ljust(64, b"\0")
    pad = lambda x: F.lit(bytearray(b ^ x for b in block))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), value.cast("binary")), 256))
    return F.when(value != "", F.concat(F.lit(prefix), F.substring(F.sha2(F.concat(pad(0x5C), inner), 256), 1, 16)))


# Patterns that are masked, in this order, and what stands for them.
MASKS = [
    (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "[REDACTED_EMAIL]"),
    (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "[REDACTED_IPV4]"),
    (r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b", "[REDACTED_IPV6]"),
    (r"\b[a-zA-Z0-9][-a-zA-Z0-9]{1,62}(?:\.[a-zA-Z0-9][-a-zA-Z0-9]{1,62})+\b", "[REDACTED_HOST]"),
    (r"\b\d{8,}\b", "[REDACTED_NUM]"),
]


def redacted(text: Column) -> Column:
    """Text with identifiers masked; null becomes empty. Word boundaries and digits are those of Unicode."""
    return reduce(lambda c, m: F.regexp_replace(c, f"(?U){m[0]}", m[1]), MASKS, F.coalesce(text, F.lit("")))


def redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    n = F.col("conv_id") * 31 + F.col("turn")
    # Turns hold few identifiers, so each gets some: an address, a host and numbers with and without a word around them.
    more = F.concat_ws(" ", F.concat_ws(".", F.lit("10"), n % 256, F.lit("7"), n % 199), F.concat(F.lit("host"), n, F.lit(".example.org")), F.concat(F.lit("x12345678 "), 10_000_000 + n), F.concat(F.lit("mail"), n, F.lit("@example.com")))
    return c.select("conv_id", "turn", redacted(F.when(n % 3 == 0, F.col("text")).otherwise(F.concat_ws(" ", "text", more))).alias("masked"))


def norm_hash(text: Column) -> Column:
    flat = F.regexp_replace(F.trim(F.lower(F.coalesce(text, F.lit("")))), r"\s+", " ")
    return F.substring(F.sha2(flat, 256), 1, 16)


def conversation_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return c.select("conv_id", "turn", norm_hash(F.col("text")).alias("hash"), F.length("text").alias("n"))


def pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.select("c_custkey", pseudonym(F.col("c_name")).alias("pseudonym"))


def entity_gate(ident: Column, bound: Column) -> Column:
    """Why a row is set aside, or accepted."""
    bad = ~ident.rlike(r"^[A-Za-z0-9][A-Za-z0-9_.-]{0,63}$") | ident.contains("..")
    return F.when(F.trim(F.coalesce(ident, F.lit(""))) == "", "missing").when(bad, "invalid").when(ident != bound, "mismatch").otherwise("accepted")


def gate_counts(t: Tables) -> DataFrame:
    k = F.substring("alert_id", 2, 8).cast("long")
    raw = F.when(k % 11 == 0, "").when(k % 13 == 0, "bad..id").when(k % 17 == 0, "E99").otherwise(F.col("entity_id"))
    return t.alert.select("entity_id", entity_gate(raw, F.col("entity_id")).alias("verdict")).groupBy("entity_id", "verdict").agg(F.count("*").alias("n"))


# Words for severities in exports.
SEVERITY = {"p1": "critical", "1": "critical", "critical": "critical", "urgent": "critical", "p2": "high", "high": "high", "p3": "medium", "medium": "medium", "moderate": "medium", "p4": "low", "low": "low", "info": "low"}


def taxonomy(value: Column, words: dict[str, str]) -> Column:
    """Known words mapped, blank as null, anything else unmapped."""
    v = F.lower(F.trim(value))
    return F.when(v.isNull() | (v == ""), None).otherwise(F.coalesce(F.create_map(*[F.lit(x) for kv in words.items() for x in kv])[v], F.lit("unmapped")))


def order_severities(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    word = F.when(F.col("o_orderkey") % 7 == 0, " P1 ").otherwise(F.regexp_extract("o_orderpriority", r"-(.*)$", 1))
    return o.groupBy(taxonomy(word, SEVERITY).alias("severity")).agg(F.count("*").alias("n"))


def parsed_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timestamps written in five ways read back: ISO with and without offset, epoch seconds and milliseconds, nonsense."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("at"))
    k = F.col("event_id") % 5
    text = F.when(k == 0, F.date_format("at", "yyyy-MM-dd HH:mm:ss")).when(k == 1, F.concat(F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+05:30"))).when(k == 2, F.unix_seconds("at").cast("string")).when(k == 3, F.unix_millis("at").cast("string")).otherwise("soon")
    return e.select("event_id", text.alias("text")).select("event_id", read_time(F.col("text")).alias("at"))


def read_time(text: Column) -> Column:
    """UTC wall-clock time of a text, null if it can't be read."""
    t = F.trim(text)
    seconds = F.when(t.rlike(r"^\d{9,10}$"), F.timestamp_seconds(t.try_cast("long"))).when(t.rlike(r"^\d{12,13}$"), F.timestamp_millis(t.try_cast("long")))
    iso = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), t.try_cast("timestamp"))
    return F.coalesce(seconds, iso).cast("timestamp_ntz")


# Data quality


def dq_issues(t: Tables) -> DataFrame:
    """entity_id, check, n of all checks that find something."""
    a = t.alert
    blank = lambda c: F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    count = lambda df, name: df.groupBy("entity_id").agg(F.count("*").alias("n")).select("entity_id", F.lit(name).alias("check"), "n")
    out = [count(a.filter(blank("alert_id") | blank("created_at") | blank("severity_final")), "missing_required_field"), count(a.filter("closed_at < created_at"), "close_before_create")]
    out.append(count(a.filter(~blank("alert_id")).groupBy("entity_id", "alert_id").count().filter("count > 1"), "duplicate_primary_keys"))
    number = a.select("entity_id", F.regexp_extract("alert_id", r"(\d+)$", 1).try_cast("long").alias("k")).distinct()
    steps = number.withColumn("gap", F.col("k") - F.lag("k").over(Window.partitionBy("entity_id").orderBy("k")))
    out.append(count(steps.filter("gap > 50"), "id_sequence_gap"))
    out.append(count(a.join(t.asset.select("entity_id", "asset_id").distinct(), ["entity_id", "asset_id"], "left_anti"), "orphan_asset"))
    out.append(count(t.case_alert_link.join(t.soc_case.select("entity_id", "case_id"), ["entity_id", "case_id"], "left_anti"), "orphan_link"))
    rates = a.groupBy("entity_id").agg(F.count("*").alias("all"), *[F.count_if(blank(c)).alias(c) for c in ("rule_id", "asset_id", "closed_by", "disposition")])
    long = rates.unpivot(["entity_id", "all"], ["rule_id", "asset_id", "closed_by", "disposition"], "column", "n").filter("n / all > 0.15")
    out.append(long.select("entity_id", F.concat(F.lit("high_null_rate:"), "column").alias("check"), "n"))
    out.append(count(a.filter("disposition = 'unmapped' or status = 'unmapped' or severity_final = 'unmapped'"), "unrecognised_value"))
    return reduce(DataFrame.unionByName, out)


def dq_summary(t: Tables) -> DataFrame:
    return dq_issues(t).groupBy("check").agg(F.sum("n").alias("n"), F.countDistinct("entity_id").alias("n_entities"))


def detection_prf(t: Tables) -> DataFrame:
    """Findings against what the projection plants: true and false positives, misses, precision and recall of a rule."""
    from tarsia.operators.rules import findings

    truth = t.spark.createDataFrame([(e, r) for r, es in PLANTED.items() for e in es], "entity_id string, rule_id string").withColumn("planted", F.lit(True))
    both = findings(t).select("entity_id", "rule_id", F.lit(True).alias("found")).join(truth, ["entity_id", "rule_id"], "full_outer")
    s = both.groupBy("rule_id").agg(F.count_if(F.col("found") & F.col("planted")).alias("tp"), F.count_if(F.col("found") & F.col("planted").isNull()).alias("fp"), F.count_if(F.col("planted") & F.col("found").isNull()).alias("fn"))
    return s.withColumns({"precision": F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), "recall": F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))})


# Entities with a planted defect.
PLANTED = {
    "EG01": ["E04"], "EG02": ["E05"], "EG03": ["E14"], "EG04": ["E16"], "EG05": ["E00", "E05", "E10", "E15", "E20"], "EG06": ["E06", "E08"], "EG07": ["E06", "E08"], "EG08": ["E15"], "EG09": ["E01"], "EG10": ["E22"],
    "EG11": ["E20"], "EG12": ["E13"], "NS01": ["E17"], "NS02": ["E03"], "NS03": ["E12"], "NS04": ["E10"], "NS05": ["E19"], "NS06": ["E02", "E08", "E14"], "NS07": ["E21"], "NS08": ["E09"],
}
