"""Reading what people send: times in the many ways they are written, delimited files that each have their own separator and
columns, JSON in any of its shapes with nested values."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarsia.operators.ingest import fresh
from tarsia.sources.projection import Tables

# Times

MONTHS = ("jan(?:uary)?", "feb(?:ruary)?", "mar(?:ch)?", "apr(?:il)?", "may", "june?", "july?", "aug(?:ust)?", "sep(?:tember)?", "oct(?:ober)?", "nov(?:ember)?", "dec(?:ember)?")
MONTH = "(" + "|".join(MONTHS) + ")"
DAY_NAME = "(?:mon|tue|wed|thu|fri|sat|sun)"
CLOCK = r"(\d{1,2}):(\d{1,2})(?::(\d{1,2})(?:\.(\d{1,6}))?)?(?: ?([ap]m))?"
#: Epoch seconds from 1990 to 2100.
EPOCH = (631152000, 4102444800)


def part(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def at(year: Column, month: Column, day: Column, clock: list[Column]) -> Column:
    """A time of the wall, null where there is no such day or hour."""
    h, m, s, f, half = clock
    hour = F.when(half.isNull(), h).when(h.between(1, 12) & f.isNull(), h % 12 + F.when(half == "pm", 12).otherwise(0)).when(h.isNotNull(), -1)
    second = F.coalesce(s, F.lit(0)) + F.coalesce(F.rpad(f, 6, "0").try_cast("int"), F.lit(0)) / F.lit(1_000_000).cast("decimal(8,0)")
    return F.try_make_timestamp_ntz(year, month, day, F.coalesce(hour, F.lit(0)), F.coalesce(m, F.lit(0)), second.cast("decimal(16,6)"))


def written_time(text: Column, zone: Column | str = "UTC", order: str = "") -> Column:
    """The UTC time (without zone) of a text, null if it can't be read or has two readings.

    Epoch seconds (ten digits and a fraction) and milliseconds (13), ISO with or without offset, year first with - / or ., month
    names in any usual place, ordinals, commas, am and pm, the C library's form; a trailing UTC, GMT or Z. Every pattern
    that fits gives a time; day first and month first that differ give null, unless order says dmy or mdy. A text
    without offset is local time of the zone: of the two times of an hour that clocks repeat the first, of a time that they skip
    the one as long after the jump."""
    where = F.lit(zone) if isinstance(zone, str) else zone
    return let(F.struct(F.lower(F.trim(text)).alias("t"), where.alias("zone")), lambda x: read_parts(x["t"], x["zone"], order))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed, and written into the plan, once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def read_parts(t: Column, zone: Column, order: str) -> Column:
    """The parts of a text are taken apart once each, then put together."""
    seconds = F.when(t.rlike(r"^\d{10}(\.\d+)?$"), t.try_cast("decimal(30,6)")).when(t.rlike(r"^\d{13}$"), (t.try_cast("decimal(20,0)") / 1000).cast("decimal(30,6)"))
    epoch = let(seconds, lambda s: F.when(s.between(*EPOCH), F.timestamp_micros((s * 1_000_000).cast("long"))))
    shift = F.regexp_extract(t, r":\d{1,2}(?:\.\d+)? ?([+-]\d{2}(?::?\d{2})?)$", 1)
    body = F.when(t.rlike(r":\d{1,2}(?:\.\d+)? ?([+-]\d{2}(?::?\d{2})?)$"), F.regexp_replace(t, r" ?[+-]\d{2}(?::?\d{2})?$", "")).otherwise(F.regexp_replace(t, r"\s*(utc|gmt|z)$", ""))
    body = F.regexp_replace(F.regexp_replace(body, r"\b(\d{1,2})(st|nd|rd|th)\b", "$1"), r"\s*,\s*", " ")
    body = F.regexp_replace(F.trim(F.regexp_replace(body, r"\s+", " ")), r"^(\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{8})t(?=\d)", "$1 ")
    body = F.regexp_replace(body, rf"^(?:{DAY_NAME} )?({MONTH} \d{{1,2}}) (\d{{1,2}}:\d{{1,2}}:\d{{1,2}}) (\d{{4}})$", "$1 $4 $3")
    wall = let(body, lambda text: let(F.struct(clock_of(text).alias("clock"), F.regexp_replace(text, rf" {CLOCK}$", "").alias("day")), lambda x: wall_time(x["day"], x["clock"], order)))

    def instant(x: Column) -> Column:
        minutes = F.substring(x["shift"], 2, 2).try_cast("int") * 60 + F.coalesce(F.substring(F.replace(x["shift"], F.lit(":"), F.lit("")), 4, 2).try_cast("int"), F.lit(0))
        offset = F.when(x["shift"] != "", F.when(x["shift"].startswith("-"), -1).otherwise(1) * minutes)
        return F.when(offset.isNotNull(), x["wall"] - F.make_dt_interval(mins=offset)).when(t.rlike(r"(utc|gmt|z)$"), x["wall"]).otherwise(F.convert_timezone(zone, F.lit("UTC"), x["wall"]))

    other = F.when(~t.rlike(r"^\d{9,}$") | t.rlike(r"^\d{14,}$"), let(F.struct(shift.alias("shift"), wall.alias("wall")), instant))
    return F.coalesce(F.convert_timezone(F.current_timezone(), F.lit("UTC"), epoch.cast("timestamp_ntz")), other)


def clock_of(text: Column) -> Column:
    """h, m, s, f (digits of a fraction) and half (am or pm) at the end of a text, null where they aren't there."""
    has = rf" {CLOCK}$"
    numbers = [part(text, has, g).try_cast("int").alias(n) for g, n in ((1, "h"), (2, "m"), (3, "s"))]
    return F.struct(*numbers, part(text, has, 4).alias("f"), part(text, has, 5).alias("half"))


def wall_time(day: Column, c: Column, order: str) -> Column:
    clock = [c["h"], c["m"], c["s"], c["f"], c["half"]]

    def read(pattern: str, year: int, month: int, date: int, named: bool = False) -> Column:
        of = lambda g: part(day, f"^{pattern}$", g)
        number = F.coalesce(*[F.when(of(month).rlike(f"^{m}$"), k + 1) for k, m in enumerate(MONTHS)]) if named else of(month).try_cast("int")
        return F.when(day.rlike(f"^{pattern}$"), at(of(year).try_cast("int"), number, of(date).try_cast("int"), clock))

    either = r"(\d{1,2})([-/.])(\d{1,2})\2(\d{4})"
    both = F.struct(read(either, 4, 3, 1).alias("dmy"), read(either, 4, 1, 3).alias("mdy"))
    one = let(both, lambda b: b[order] if order else F.when(b["dmy"].isNull() | b["mdy"].isNull() | (b["dmy"] == b["mdy"]), F.coalesce(b["dmy"], b["mdy"])))
    return F.coalesce(
        read(r"(\d{4})([-/.])(\d{1,2})\2(\d{1,2})", 1, 3, 4), read(r"(\d{4})(\d{2})(\d{2})", 1, 2, 3), read(rf"(?:{DAY_NAME} )?{MONTH} (\d{{1,2}}) (\d{{4}})", 3, 1, 2, True),
        read(rf"(\d{{1,2}})([ -]){MONTH}\2(\d{{4}})", 4, 3, 1, True), read(rf"(\d{{4}})-{MONTH}-(\d{{1,2}})", 1, 2, 3, True), one,
    )


def time_forms(t: Tables) -> DataFrame:
    """Times of events, to the second, written in sixteen ways and read back; some name no time, some have two readings."""
    e = t.spark.read.parquet(f"{t.sf_dir}/events.parquet").select("event_id", F.date_trunc("second", F.col("ts").cast("timestamp")).alias("at"))
    form = lambda p: F.date_format("at", p)
    ways = [
        form("yyyy-MM-dd HH:mm:ss"), F.concat(form("yyyy-MM-dd'T'HH:mm:ss"), F.lit("+05:30")), F.unix_seconds("at").cast("string"), F.unix_millis("at").cast("string"), F.lit("soon"),
        F.concat(form("MMM d"), F.lit("th "), form("yyyy HH:mm:ss")), form("d MMMM yyyy HH:mm"), form("MMM d, yyyy hh:mm:ss a"), form("yyyy/MM/dd HH:mm"), form("EEE MMM d HH:mm:ss yyyy"), form("dd/MM/yyyy HH:mm:ss"), form("MM.dd.yyyy"),
        F.concat(form("yyyy-MM-dd HH:mm:ss"), F.lit(" UTC")), form("yyyyMMdd HH:mm:ss"), F.concat(form("yyyy-MM-dd HH:mm:ss.SSS"), F.lit("-0300")), F.lit(" "),
    ]
    text = F.element_at(F.array(*ways), (F.col("event_id") % len(ways) + 1).cast("int"))
    return e.select("event_id", text.alias("text")).select("event_id", written_time(F.col("text")).alias("at"))


def local_forms(t: Tables) -> DataFrame:
    """The same days at half past two, as the clocks of four zones show it, read as times of their zones: with hours that clocks
    skip or repeat."""
    zones = ["UTC", "Europe/Paris", "America/New_York", "Asia/Kathmandu"]
    days = t.spark.read.parquet(f"{t.sf_dir}/events.parquet").select(F.to_date("ts").alias("day")).unionByName(t.orders.select(F.to_date("o_orderdate").alias("day"))).distinct()
    rows = days.withColumn("zone", F.explode(F.array(*map(F.lit, zones)))).withColumn("text", F.concat(F.date_format("day", "d MMM yyyy"), F.lit(" 2:30 AM")))
    return rows.select("day", "zone", written_time(F.col("text"), F.col("zone")).alias("at"))


# Delimited files


SEPARATORS = (",", ";", "\t", "|")


def cells(line: str, sep: str) -> list[str]:
    """The cells of a header line; quotes may hold separators and doubled quotes."""
    out = [m.group(1) for m in re.finditer(rf'(?:^|{re.escape(sep)})("(?:[^"]|"")*"|[^{re.escape(sep)}]*)', line)]
    return [c[1:-1].replace('""', '"') if c.startswith('"') and c.endswith('"') and len(c) > 1 else c for c in out]


def sniffed(line: str) -> str:
    """The separator that stands most often outside quotes in a header line."""
    bare = re.sub(r'"(?:[^"]|"")*"', "", line)
    return max(SEPARATORS, key=bare.count)


def key_of(name: str) -> str:
    """The form in which headers are compared: compatible letters made one, lower case, all else as one _, none at the ends."""
    return re.sub(r"[\W_]+", "_", unicodedata.normalize("NFKC", name).lower()).strip("_")


def clean_headers(names: list[str]) -> list[str]:
    """Keys of headers: blank ones by their place, repeated ones numbered."""
    seen: set[str] = set()
    out = []
    for k, raw in enumerate(names):
        base = key_of(raw.replace("﻿", "")) or f"column_{k + 1}"
        name, n = base, 2
        while name in seen:
            name, n = f"{base}_{n}", n + 1
        seen.add(name)
        out.append(name)
    return out


def scan_delimited(spark: SparkSession, path: str, sep: str | None = None, multiline: bool = True) -> DataFrame:
    """Delimited files of a folder, all columns as text under the keys of their headers, with the file of each row in _file.

    Each file has its own header and, unless sep is given, its own separator; files of one layout are read together, columns
    meet by their keys. Short rows are filled with null, what is too long for its header is dropped, rows without any
    value go. multiline: cells may hold line ends, for which a file is read by one task. The headers are looked up when
    this is called: one line a file comes to the driver."""
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value", F.monotonically_increasing_id().alias("n"))
    heads = lines.filter("start = 0 and trim(value) <> ''").groupBy("file").agg(F.min_by("value", "n").alias("head")).collect()
    layouts: dict[tuple[str, tuple[str, ...]], list[str]] = {}
    for row in heads:
        head = row.head.replace("﻿", "").rstrip("\r")
        by = sep or ("\t" if row.file.lower().endswith(".tsv") else sniffed(head))
        layouts.setdefault((by, tuple(clean_headers(cells(head, by)))), []).append(row.file)
    frames = []
    for (by, names), files in sorted(layouts.items()):
        schema = ", ".join(f"`{n}` string" for n in names)
        rows = spark.read.csv(sorted(files), header=True, sep=by, quote='"', escape='"', schema=schema, enforceSchema=True, multiLine=multiline, mode="PERMISSIVE")
        filled = reduce(lambda a, b: a | b, [F.trim(F.col(f"`{n}`")) != "" for n in names])
        frames.append(rows.filter(F.coalesce(filled, F.lit(False))).withColumn("_file", F.col("_metadata.file_path")))
    if not frames:
        return spark.createDataFrame([], "_file string")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def mixed_layouts(t: Tables) -> DataFrame:
    """Customers as four offices send them: other columns first, other separators, names that hold a separator, a mark at the
    start of the file, cells with line ends; read as one table."""
    office = F.col("c_custkey") % 4
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    name, segment, number = F.col("c_name"), F.col("c_mktsegment"), F.col("c_custkey").cast("string")
    layouts = [
        ("Customer-ID,Segment,Name", [number, segment, quoted(F.concat(name, F.lit(", Ltd")))], ","), ("segment;customer id;NAME", [segment, number, quoted(F.concat(name, F.lit("; \"x\"")))], ";"),
        ('﻿"name"\t"customer_id"\t"a\tb"\tSEGMENT', [name, number, F.lit("-"), segment], "\t"), ("Name|Segment|Ｃustomer ID", [quoted(F.concat(name, F.lit("\nnext line"))), segment, number], "|"),
    ]
    path = fresh(t, "offices")
    for k, (head, columns, sep) in enumerate(layouts):
        body = t.customer.filter(office == k).select(F.concat_ws(sep, *columns).alias("line"))
        t.spark.createDataFrame([(head,)], "line string").unionByName(body).coalesce(1).write.text(f"{path}/office-{k}")
    rows = scan_delimited(t.spark, path)
    return rows.select(F.col("customer_id").try_cast("long").alias("customer_id"), "name", "segment")


# JSON

ENVELOPES = ("data", "records", "items", "results", "value", "rows", "events", "alerts", "hits")


def json_records(spark: SparkSession, path: str) -> DataFrame:
    """_file, record (VARIANT) and bad (text) of JSON files: one object a line, an array of objects, an object that holds such an
    array in a usual field, single objects or several one after another, over one line or many. What is no object comes as bad,
    its record null.

    A file whose first line is a whole value is read line by line, in as many tasks as it has splits, others as a whole, each by
    one task: value by value, and line by line what can't be read so. Names of files stay where their rows are."""
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("start"), F.regexp_replace("value", "^﻿", "").alias("text"), F.monotonically_increasing_id().alias("n"))
    lines = lines.filter("trim(text) <> ''")
    heads = lines.filter("start = 0").groupBy("_file").agg(F.min_by("text", "n").alias("head"))
    whole = F.broadcast(heads.filter(F.expr("try_parse_json(head) is null and trim(head) rlike '^[\\\\[{]'")).select("_file"))  # one name a file
    gathered = lines.join(whole, "_file", "left_semi").groupBy("_file").agg(F.array_sort(F.collect_list(F.struct("start", "n", "text"))).alias("x"))
    value = F.array_join(F.col("x")["text"], "\n")
    # After a bracket that closes, a line of the same value begins with a comma or another one that closes. (The parser skips what
    # follows a value.)
    values = gathered.select("_file", F.explode(F.split(value, r"(?<=[}\]])\s*\n\s*(?![,}\]\s])")).alias("value"))
    one = F.when(F.expr("try_parse_json(value)").isNotNull(), F.array("value")).otherwise(F.filter(F.split("value", "\n"), lambda x: F.trim(x) != ""))
    texts = lines.join(whole, "_file", "left_anti").select("_file", "text").unionByName(values.select("_file", F.explode(one).alias("text")))
    v = texts.withColumn("v", F.expr("try_parse_json(text)"))
    inside = F.coalesce(*[F.expr(f"try_variant_get(v, '$.{k}', 'array<variant>')") for k in ENVELOPES])
    many = F.coalesce(F.expr("try_variant_get(v, '$', 'array<variant>')"), inside, F.array("v"))
    rows = v.select("_file", "text", F.explode_outer(many).alias("record"))
    is_object = F.expr("coalesce(schema_of_variant(record) LIKE 'OBJECT<%', false)")
    return rows.select("_file", F.when(is_object, F.col("record")).alias("record"), F.when(~is_object, F.col("text")).alias("bad"))


def json_path(path: str) -> str:
    return "$" + "".join(f"['{p}']" for p in path.split("."))


def value_at(record: str, *paths: str) -> Column:
    """The first filled value at one of some paths of a VARIANT column, as text. A name with dots is looked up as it stands before
    its parts are followed."""
    each = []
    for p in paths:
        each += [F.expr(f"try_variant_get({record}, \"$['{p}']\", 'string')")] + ([F.expr(f"try_variant_get({record}, \"{json_path(p)}\", 'string')")] if "." in p else [])
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in each])


PAGE = 400_000  # order numbers, of which a page has every tenth at most


def json_shapes(t: Tables) -> DataFrame:
    """Orders as five services answer: an object a line with some cut short, arrays, arrays in a field, objects over many lines, and
    names with dots; read as one table with values from inside objects. Pages are of bounded size, so their number grows."""
    o = t.orders.filter("o_orderkey % 10 < 5").withColumn("kind", F.col("o_orderkey") % 10)
    nested = F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.struct(F.struct(F.col("o_orderstatus").alias("code")).alias("state")).alias("order"), F.col("o_orderpriority").alias("priority")))
    dotted = F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("order.state.code"), F.lit(" ").alias("priority"), F.col("o_orderpriority").alias("urgency")))
    path = fresh(t, "services")
    line = F.when(F.col("o_orderkey") % 50 == 0, F.substring(nested, 1, 15)).otherwise(nested)
    o.filter("kind = 0").select(line.alias("line")).write.text(f"{path}/lines")
    page = F.floor(F.col("o_orderkey") / PAGE).alias("page")
    listed = lambda k, text: o.filter(F.col("kind") == k).groupBy(page).agg(F.array_join(F.sort_array(F.collect_list(text)), ",\n").alias("x"))
    listed(1, nested).select(F.concat(F.lit("[\n"), "x", F.lit("\n]")).alias("line"), "page").write.partitionBy("page").text(f"{path}/arrays")
    listed(2, nested).select(F.concat(F.lit('{"total": 1, "data": ['), F.replace("x", F.lit("\n"), F.lit("")), F.lit("]}")).alias("line"), "page").write.partitionBy("page").text(f"{path}/fields")
    o.filter("kind = 3 and o_orderkey % 100 = 3").select(F.replace(nested, F.lit(","), F.lit(",\n  ")).alias("line"), page).repartition("page").write.partitionBy("page").text(f"{path}/single")
    o.filter("kind = 4").select(dotted.alias("line")).write.text(f"{path}/dots")
    rows = json_records(t.spark, path)
    known = rows.filter("record is not null").select(value_at("record", "id").cast("long").alias("id"), value_at("record", "order.state.code").alias("status"), value_at("record", "priority", "urgency").alias("priority"))
    lost = rows.filter("record is null").agg(F.count("*").alias("n")).select((-F.col("n")).alias("id"), F.lit("bad").alias("status"), F.lit(None).cast("string").alias("priority"))
    return known.unionByName(lost)


QUERIES = {"parse_timestamp_forms": time_forms, "parse_timestamp_zones": local_forms, "scan_delimited_layouts": mixed_layouts, "scan_json_shapes": json_shapes}
