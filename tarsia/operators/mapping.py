"""Declarative mappings: how the rows of one kind of export become rows of one or more tables."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarsia.operators.catalog import first_filled, read_number
from tarsia.sources.projection import Tables

TRUE, FALSE = ("true", "yes", "y", "1", "t"), ("false", "no", "n", "0", "f")


@dataclass(frozen=True)
class Lookup:
    """Another export of the same submission that says what a value stands for: the row of the greatest value counts
    where a key is there more than once."""

    export: str
    key: str
    value: str


@dataclass(frozen=True)
class Field:
    """One column of a table: the first filled of the source columns or a constant, and what is done to it in turn."""

    columns: tuple[str, ...] = ()
    const: str | None = None
    when: dict[str, tuple[str, ...]] = field(default_factory=dict)  # else null
    extract: str | None = None  # pattern whose first group counts
    transform: str | None = None  # length, number, boolean
    lookup: Lookup | None = None
    values: dict[str, str] | None = None  # other values give the default
    default: str | None = None


@dataclass(frozen=True)
class TableSpec:
    """A table that an export feeds: its columns, the rows that are meant, columns without which a row is rejected."""

    table: str
    columns: dict[str, Field]
    where: dict[str, tuple[str, ...]] = field(default_factory=dict)
    required: tuple[str, ...] = ()

    def reads(self) -> set[str]:
        """The source columns that are mapped or looked at."""
        named = [set(f.columns) | set(f.when) for f in self.columns.values()]
        return set(self.where).union(*named)


def allowed(conditions: dict[str, tuple[str, ...]]) -> Column:
    return reduce(Column.__and__, [F.coalesce(F.trim(F.col(c).cast("string")).isin(*v), F.lit(False)) for c, v in conditions.items()], F.lit(True))


def value_of(f: Field, looked_up: str | None) -> Column:
    """The value of a field as text; looked_up: the column that holds what its lookup found."""
    raw = first_filled(*map(F.col, f.columns)) if f.columns else F.lit(f.const)
    default = F.lit(f.default).cast("string")
    if f.transform == "length":
        out = F.coalesce(F.length(raw), F.lit(0)).cast("string")
    else:
        text = F.nullif(F.regexp_extract(raw, f.extract, 1), F.lit("")) if f.extract else raw
        if f.transform == "number":
            text = read_number(text).cast("string")
        elif f.transform == "boolean":
            text = F.when(F.lower(text).isin(*TRUE), "true").when(F.lower(text).isin(*FALSE), "false")
        elif looked_up:
            text = first_filled(F.col(looked_up))
        elif f.values is not None:
            text = F.create_map(*[F.lit(x) for kv in f.values.items() for x in kv])[text]
        out = F.coalesce(text, default)
    return F.when(allowed(f.when), out) if f.when else out


def apply(spec: TableSpec, export: DataFrame, others: dict[str, DataFrame]) -> DataFrame:
    """The rows of an export with out (the mapped columns, as text) and outcome: filtered, missing a, b, or stored."""
    found: dict[str, str] = {}
    for name, f in spec.columns.items():
        if f.lookup:
            found[name] = f"_found_{name}"
            pairs = others[f.lookup.export].select(F.trim(F.col(f.lookup.key).cast("string")).alias(f"_key_{name}"), F.col(f.lookup.value).cast("string").alias("_value"))
            pairs = pairs.filter(F.col(f"_key_{name}") != "").groupBy(f"_key_{name}").agg(F.max("_value").alias(found[name]))
            key = F.regexp_extract(first_filled(*map(F.col, f.columns)), f.extract, 1) if f.extract else first_filled(*map(F.col, f.columns))
            export = export.join(pairs, key == F.col(f"_key_{name}"), "left").drop(f"_key_{name}")  # the optimiser broadcasts small exports
    rows = export.withColumn("out", F.struct(*[value_of(f, found.get(n)).alias(n) for n, f in spec.columns.items()]))
    missing = F.array_compact(F.array(*[F.when(F.coalesce(F.trim(F.col(f"out.{c}")), F.lit("")) == "", F.lit(c)) for c in spec.required])) if spec.required else F.array().cast("array<string>")
    lacks = F.when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ", "))).otherwise("stored")
    return rows.withColumn("outcome", F.when(~allowed(spec.where), "filtered").otherwise(lacks)).drop(*found.values())


def unused(specs: list[TableSpec], export: DataFrame) -> list[str]:
    """Source columns that no table reads."""
    return sorted(set(export.columns).difference(*[s.reads() for s in specs]))


# Orders as the export of a product that feeds two tables; customers are the export that owners are looked up in.
LEVELS = {"URGENT": "critical", "HIGH": "high", "MEDIUM": "medium", "LOW": "low"}
ORDERS = [
    TableSpec(
        "alert",
        {
            "id": Field(("o_orderkey",)),
            "owner": Field(("o_custkey",), lookup=Lookup("customers", "c_custkey", "c_name"), default="nobody"),
            "severity": Field(("o_orderpriority",), extract=r"-(.*)$", values=LEVELS),
            "open": Field(("o_orderstatus",), values={"O": "true", "F": "false"}),
            "source": Field(const="orders"),
        },
        where={"o_orderstatus": ("O", "F")},
        required=("id", "severity"),
    ),
    TableSpec(
        "closure",
        {
            "id": Field(("o_orderkey",)),
            "comment_len": Field(("o_orderpriority",), transform="length"),
            "severity": Field(("o_orderpriority",), extract=r"-(.*)$", values=LEVELS, when={"o_orderpriority": ("1-URGENT", "2-HIGH")}, default="low"),
        },
        where={"o_orderstatus": ("F",)},
        required=("id",),
    ),
]


def exports(t: Tables) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The exports; customers are incomplete."""
    return t.orders, {"customers": t.customer.filter("c_custkey % 6 <> 0")}


def declared_mapping(t: Tables) -> DataFrame:
    """The stored rows of both tables; columns that a table doesn't have are null."""
    orders, others = exports(t)
    parts = [apply(s, orders, others).filter("outcome = 'stored'").select(F.lit(s.table).alias("tab"), "out.*") for s in ORDERS]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def declared_coverage(t: Tables) -> DataFrame:
    """tab, measure, n: rows read, stored, filtered and rejected by reason, and the filled values of each mapped column of
    stored rows; under the table '*' the rows that no table took, and 1 for each source column that none reads."""
    orders, others = exports(t)
    out, taken = [], []
    for s in ORDERS:
        rows = apply(s, orders, others)
        stored = F.col("outcome") == "stored"
        taken.append(rows.filter(stored).select("o_orderkey"))
        reasons = rows.groupBy("outcome").agg(F.count("*").alias("n")).select(F.lit(s.table).alias("tab"), F.concat(F.lit("rows "), "outcome").alias("measure"), "n")
        filled = rows.agg(F.count("*").alias("rows read"), *[F.count_if(stored & F.col(f"out.{c}").isNotNull()).alias(f"filled {c}") for c in s.columns])
        out += [reasons, filled.unpivot([], filled.columns, "measure", "n").select(F.lit(s.table).alias("tab"), "measure", "n")]
    lost = orders.join(reduce(DataFrame.unionByName, taken), "o_orderkey", "left_anti").agg(F.count("*").alias("n"))
    out.append(lost.select(F.lit("*").alias("tab"), F.lit("rows lost").alias("measure"), "n"))
    names = F.array(*[F.lit(f"unused {c}") for c in unused(ORDERS, orders)]).cast("array<string>")
    out.append(t.spark.range(1).select(F.lit("*").alias("tab"), F.explode(names).alias("measure"), F.lit(1).cast("long").alias("n")))
    return reduce(DataFrame.unionByName, out)


QUERIES = {"declared_mapping": declared_mapping, "declared_mapping_coverage": declared_coverage}
