"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source gets a word budget: its weight's share of all words, at most ``MAX_EPOCHS`` times its own size, the
excess handed on by weight. A budget of e sizes and a rest takes each document e times; for the rest documents
are drawn without replacement with probabilities that follow a quality weight: each has the exponential key
-ln(u) / weight, keys are sorted within the source and sizes summed up to the rest.

Only the range of keys in which the sum crosses the rest needs sorting. Keys fall into ordered ranges,
``BUCKETS`` for each doubling of the key; sums by range show which are taken whole and which one is cut, and only rows of the latter
are shuffled. A range holds at most a thousandth of exponential keys of any weights (x * exp(-x) * ln(2) / BUCKETS is
its share), so a source that holds a third of all rows sorts a thousandth of them, whatever its quality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, cut, read, renamed, restored, small, written

WEIGHTS, MAX_EPOCHS, SEED, BUCKETS, BROADCAST_SOURCES = (5, 2, 1), 3, 17, 256, 20_000
IDEAL_WORD = 6.0  # characters of a word that the quality weight favours
BLANKS = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality(text: Column, size: Column) -> Column:
    """In (0, 1]: texts whose words are about as long as words usually are weigh most."""
    solid = F.length(F.translate(text, BLANKS, "")).cast("double")
    return F.coalesce(1.0 / (1.0 + F.abs(solid / F.nullif(size, F.lit(0)) - IDEAL_WORD)), F.lit(1.0))


def keyed(docs: DataFrame, weight: Column | None = None) -> DataFrame:
    """Adds _source, size, _key and _bucket. The draw u comes from md5 of seed, doc_id and size, so reruns agree."""
    drawn = F.md5(F.concat_ws(":", F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("size").cast("string")))
    u = (F.conv(F.substring(drawn, 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)
    sized = docs.withColumn("size", words(F.col("text")))
    with_key = sized.withColumn("_key", -F.log(u) / (weight if weight is not None else quality(F.col("text"), F.col("size"))))
    source = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
    return with_key.withColumns({"_source": source, "_bucket": F.floor(F.log2(F.least(F.greatest("_key", F.lit(1e-18)), F.lit(1e18))) * BUCKETS).cast("int")})


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = MAX_EPOCHS) -> DataFrame:
    """sizes: one row per source with _source and source_size. Adds target, in words.

    Sources sorted by code point, null last, weigh the given weights in turn. With caps of epochs * size, sources
    in the order of cap / weight are capped as long as the water level (what is left, by weight) lies above."""
    named = Window.orderBy(F.col("_source").eqNullSafe("n").asc(), "_source")
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(named) - 1, F.lit(len(weights))).cast("int") + 1)
    s = sizes.withColumn("weight", weight).withColumn("cap", float(epochs) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "_source")
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    s = s.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    s = s.withColumn("order", F.row_number().over(order))
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("order", "level"))).over(everything)["level"]
    return s.withColumn("target", F.coalesce(F.least("cap", level * F.col("weight")), F.col("cap"))).select("_source", "source_size", "target")


def planned_rows(docs: DataFrame, weights: tuple[int, ...], epochs: int, weight: Column | None, without: list[str], keep_text: bool = True) -> tuple[DataFrame, dict[str, str]]:
    """docs under names of its own (as ``renamed`` says), with size, source_size, target and copies."""
    frame, own = renamed(docs, without)
    kept = {c: n for c, n in own.items() if keep_text or c != "text"}
    # The columns that the draw reads stand beside the renamed ones; what comes out of the words is written once.
    rows = keyed(frame.select("*", *[F.col(own[c]).alias(c) for c in ("doc_id", "text", "source")]), weight).drop("text", "source")
    rows = written(rows.select(*kept.values(), "doc_id", "_source", "size", "_key", "_bucket"))
    columns = list(kept.values())
    sums = cut(rows.groupBy("_source", "_bucket").agg(F.sum("size").alias("size")))
    budget = targets(sums.groupBy("_source").agg(F.sum("size").alias("source_size")), weights, epochs)
    budget = budget.withColumn("whole", F.coalesce(F.floor(F.col("target") / F.nullif("source_size", F.lit(0))), F.lit(0)).cast("int"))
    budget = budget.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    up_to = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    crossed = sums.withColumn("end", F.sum("size").over(up_to)).join(budget.select("_source", "rest"), "_source").filter("end > rest")
    crossed = crossed.groupBy("_source").agg(F.min(F.struct(F.col("_bucket").alias("cut"), (F.col("end") - F.col("size")).alias("base"))).alias("c"))
    plan = small(cut(budget.join(crossed, "_source", "left").select("_source", "source_size", "target", "whole", "rest", "c.cut", "c.base")), BROADCAST_SOURCES)
    out = [*columns, "size", "source_size", "target"]
    planned = rows.join(plan, "_source")
    clear = planned.filter("cut is null or _bucket <> cut").select(*out, F.expr("whole + if(_bucket < cut and source_size > 0, 1, 0)").alias("copies"))
    in_order = Window.partitionBy("_source").orderBy("_key", F.col("doc_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = planned.filter("_bucket = cut").withColumn("end", F.col("base") + F.sum("size").over(in_order))
    both = clear.unionByName(edge.select(*out, F.expr("whole + if(end - size / 2.0 <= rest, 1, 0)").alias("copies")))
    return both, kept


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = MAX_EPOCHS, weight: Column | None = None, keep_text: bool = True) -> DataFrame:
    """Adds size (words), source_size, target and copies (times the mix takes the document) to docs.

    docs has at least doc_id, text and source; nulls: a null text has no words, a null source is a source of its
    own, a null doc_id an id like any other. The document at which a source's rest is crossed is taken if that
    comes nearer to the target. Ties in the key go by doc_id, equal rows in any order. A source without words
    has copies 0. Columns of docs with the names of added ones are replaced. keep_text=False leaves text out. A weight
    is an expression over doc_id, text and size."""
    added = ["size", "source_size", "target", "copies"]
    rows, own = planned_rows(docs, weights, epochs, weight, added, keep_text)
    return rows.select(*restored(own), *added)


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of docs, each as often as the mix takes it."""
    rows, own = planned_rows(docs, WEIGHTS, MAX_EPOCHS, None, [])
    out = rows.filter("copies > 0").withColumn("copies", F.explode(F.sequence(F.lit(1), "copies")))
    return out.select(*restored(own))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(read(spark, sf_dir, "documents").select("doc_id", "source", "text"), keep_text=False)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


QUERIES = {"op8_source_mixing": op8_source_mixing}
SQL = {
    "op8_source_mixing": r"""
WITH sized AS (SELECT doc_id, source, text, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
keyed AS (SELECT doc_id, source, size,
 -ln((CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || CAST(size AS VARCHAR)), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE)
 / coalesce(1.0::DOUBLE / (1.0::DOUBLE + abs(CAST(length(translate(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS DOUBLE) / nullif(size, 0) - 6.0::DOUBLE)), 1.0::DOUBLE) AS k FROM sized),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT) + 1] AS w FROM sized GROUP BY source),
caps AS (SELECT *, 3.0::DOUBLE * source_size AS cap FROM sizes),
levels AS (SELECT *, row_number() OVER o AS n, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM caps WINDOW o AS (ORDER BY cap / w, source NULLS FIRST)),
budgets AS (SELECT source, source_size, coalesce(least(cap, w * (SELECT arg_min(level, n) FROM levels WHERE level * w <= cap)), cap) AS target FROM levels),
rests AS (SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0) AS whole FROM budgets),
drawn AS (SELECT doc_id, size, source_size, target, whole, target - whole * source_size AS rest, sum(size) OVER (PARTITION BY k.source ORDER BY k, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) AS upto
 FROM keyed k JOIN rests r ON k.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN upto - size / 2.0 <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM drawn
"""
}
