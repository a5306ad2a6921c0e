"""Which records an assessment sees: windows over all tables, closed over what belongs together, and runs over many windows.

A window is [start, end), or all time before its end. What happened at its end or later isn't known yet: it is masked. Several
windows are selected at once: each record is taken once for each window it lies in, its entity's id ending in @ and the
window's name (see peers.scope), so that one run of the rules judges all windows and each table is read once.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarsia.operators import contracts, rules
from tarsia.operators.ingest import period_bounds
from tarsia.operators.rules import findings
from tarsia.operators.scoring import domain_scores, risk_index
from tarsia.sources.projection import CANONICAL, Tables

RUNS = 3


@dataclass(frozen=True)
class Span:
    """A window: its name, start (None: no lower bound) and end, which is exclusive."""

    name: str
    start: datetime | None
    end: datetime

    def __post_init__(self) -> None:
        if "@" in self.name:
            raise ValueError("a window's name has no @")
        if self.start is not None and self.start >= self.end:
            raise ValueError("a window ends after it starts")


def time(value: datetime | None) -> Column:
    return F.lit(value.isoformat(sep=" ") if value else None).cast("timestamp_ntz")


def spans(windows: tuple[Span, ...]) -> Column:
    return F.array(*[F.struct(F.lit(w.name).alias("name"), time(w.start).alias("start"), time(w.end).alias("end")) for w in windows])


# The time that places a record, and what is masked from the window's end on, with the columns that go with it.
PLACED = {"alert": "created_at", "soc_case": "opened_at", "workflow_event": "ts", "escalation": "escalated_at", "remediation": "created_at", "external_report": "reported_at", "log_source_daily": "date"}
DATED_ONLY = ("alert", "soc_case", "log_source_daily")  # of these, and remediation and external_report, undated rows can't be placed
MASKED = {
    "alert": {"closed_at": {"closed_by": None, "closed_by_type": None, "disposition": None, "playbook_id": None, "status": "open"}, "acknowledged_at": {}, "first_touch_at": {}},
    "soc_case": {"closed_at": {"status": "open"}}, "escalation": {"acknowledged_at": {}}, "remediation": {"closed_at": {}}, "detection_rule": {"last_fired": {}},
}


def selected(t: Tables, windows: tuple[Span, ...], tag: str = "", moments: dict[str, datetime] | None = None) -> Tables:
    """The tables as they were known in each window. A record without a time is left out of a table that is placed by it.

    alert: created in the window. soc_case: opened before its end and not closed before its start. case_alert_link: its case or alert is selected.
    closure: its parent is selected and closed. workflow_event, escalation: before the end, and in the window or about a selected alert or
    case. remediation: open in the window. external_report: before the end. log_source_daily: days in the window. declared_kpi: its period
    overlaps the window or names none. Other tables: whole."""
    out = Tables(t.spark, t.sf_dir, tag or "window-" + "-".join(f"{w.name}_{w.start}_{w.end}" for w in windows).replace(" ", "T").replace(":", "") + "-", lambda name: picked(t, out, name, windows), moments, ("closure", "log_source_daily", "workflow_event"))
    return out


def rows_by_window(rows: DataFrame, windows: tuple[Span, ...], inside: Column) -> DataFrame:
    """Each row once for every window w in which it lies."""
    every = rows.withColumn("w", F.explode(spans(windows))).filter(inside)
    return every


def scoped(rows: DataFrame) -> DataFrame:
    return rows.withColumn("entity_id", F.concat_ws("@", "entity_id", "w.name")).drop("w")


def masked(rows: DataFrame, name: str) -> DataFrame:
    """What happened at the end of the window w or later is not known."""
    for column, more in MASKED.get(name, {}).items():
        if column in rows.columns:
            late = F.coalesce(F.col(column) >= F.col("w.end"), F.lit(False))
            rows = rows.withColumns({c: F.when(late, F.lit(v)).otherwise(F.col(c)) for c, v in more.items()} | {column: F.when(~late, F.col(column))})
    return rows


def parents(out: Tables, closed: bool = False) -> DataFrame:
    """entity_id (with the window) and ref_id of selected alerts and cases; closed: of those closed inside."""
    return all_parents(out, closed).distinct()


def all_parents(out: Tables, closed: bool = False) -> DataFrame:
    keep = F.col("closed_at").isNotNull() if closed else F.lit(True)
    return out.alert.filter(keep).select("entity_id", F.col("alert_id").alias("ref_id")).unionByName(out.soc_case.filter(keep).select("entity_id", F.col("case_id").alias("ref_id")))


def met(t: Tables, out: Tables, windows: tuple[Span, ...]) -> tuple[DataFrame, list[Column]]:
    """rules.with_steps over all windows, records met once, and whether an alert is selected and closed in each of them."""
    known = [F.col("ts").isNull() | (F.col("ts") < time(w.end)) for w in windows]
    rows = t.once(f"{out.tag}handled", lambda: rules.with_steps(t, known, "severity_final", "created_at", "closed_at"))
    return rows, [lies("alert", rows, time(w.start), time(w.end)) & (F.col("closed_at") < time(w.end)) for w in windows]


def handled(t: Tables, out: Tables, windows: tuple[Span, ...]) -> DataFrame:
    """rules.handled of the selected tables, with records met once, not once a window: an alert that is selected and closed in a window has its
    closures there, and the workflow events before its end or without a time."""
    rows, closed = met(t, out, windows)
    each = [F.struct(F.lit(w.name).alias("name"), closed[k].alias("inside"), F.col("steps")[k].alias("n_events"), (F.col("looks")[k] > 0).alias("looked")) for k, w in enumerate(windows)]
    seen = rows.withColumn("w", F.explode(F.array(*each))).filter("w.inside").withColumns({"high": F.col("severity_final").isin(*rules.HIGH), "n_events": F.col("w.n_events"), "looked": F.col("w.looked")})
    return scoped(seen).drop("steps", "looks", "severity_final", "created_at", "closed_at")


def notes(t: Tables, out: Tables, windows: tuple[Span, ...]) -> DataFrame:
    """rules.groups_of of the selected tables: comments are counted once for all windows."""
    rows, closed = met(t, out, windows)
    counts = rows.filter("note is not null").groupBy("entity_id", "note").agg(*[F.count_if(c).alias(f"n{k}") for k, c in enumerate(closed)])
    each = [F.struct(F.lit(w.name).alias("name"), F.col(f"n{k}").alias("n")) for k, w in enumerate(windows)]
    return scoped(counts.withColumn("w", F.explode(F.array(*each))).filter("w.n > 0").select("entity_id", "note", "w.n", "w"))


def telemetry(t: Tables, out: Tables, windows: tuple[Span, ...]) -> DataFrame:
    """rules.telemetry of the selected tables: days are read once, not once a window."""
    known = [F.coalesce(lies("log_source_daily", t.log_source_daily, time(w.start), time(w.end)), F.lit(False)) for w in windows]
    rows = t.once(f"{out.tag}telemetry", lambda: rules.by_asset(t, known))
    each = [F.struct(F.lit(w.name).alias("name"), F.col(f"t{k}").alias("t")) for k, w in enumerate(windows)]
    return scoped(rows.withColumn("w", F.explode(F.array(*each))).filter("w.t.inside").select("entity_id", "asset_id", "w.t.*", "w")).drop("inside")


def links(t: Tables, windows: tuple[Span, ...]) -> DataFrame:
    """The links of each window in which their case or alert is selected; cases and alerts are met once, not once a window."""
    rows = t.case_alert_link

    def known(name: str, ident: str) -> DataFrame:
        those = getattr(t, name)
        return those.groupBy("entity_id", ident).agg(*[F.bool_or(lies(name, those, time(w.start), time(w.end))).alias(f"{ident}{k}") for k, w in enumerate(windows)])

    both = rows.join(known("soc_case", "case_id"), ["entity_id", "case_id"], "left").join(known("alert", "alert_id"), ["entity_id", "alert_id"], "left")
    each = [F.struct(F.lit(w.name).alias("name"), (F.col(f"case_id{k}") | F.col(f"alert_id{k}")).alias("inside")) for k, w in enumerate(windows)]
    return scoped(both.withColumn("w", F.explode(F.array(*each))).filter("w.inside")).select(*rows.columns)


def lies(name: str, rows: DataFrame, start: Column, end: Column) -> Column:
    """Whether a row of a table that is selected by its own times lies in a window."""
    at = F.col(PLACED[name])
    if name in ("alert", "log_source_daily"):
        since, until = (start, end) if name == "alert" else (F.to_date(start), F.to_date(end))
        return (at < until) & (start.isNull() | (at >= since))
    over = start.isNotNull() & (F.col("closed_at") < start) if "closed_at" in rows.columns else F.lit(False)
    return (at < end) & ~F.coalesce(over, F.lit(False))


def picked(t: Tables, out: Tables, name: str, windows: tuple[Span, ...]) -> DataFrame:
    start, end = F.col("w.start"), F.col("w.end")
    if name == "handled":
        return handled(t, out, windows)
    if name == "notes":
        return notes(t, out, windows)
    if name == "telemetry":
        return telemetry(t, out, windows)
    if name == "case_alert_link":
        return links(t, windows)
    rows = getattr(t, name)
    if name in ("alert", "log_source_daily", "soc_case", "remediation"):
        return scoped(masked(rows_by_window(rows, windows, lies(name, rows, start, end)), name))
    if name == "external_report":
        return scoped(rows_by_window(rows, windows, F.col(PLACED[name]) < end))
    if name == "closure":
        # Of each record the windows in which it is selected and closed, so that closures are met once, not once a window.
        names = [w.name for w in windows]
        base = all_parents(out, closed=True).select(F.substring_index("entity_id", "@", 1).alias("entity_id"), "ref_id", F.substring_index("entity_id", "@", -1).alias("in"))
        known = base.groupBy("entity_id", "ref_id").agg(*[F.bool_or(F.col("in") == n).alias(f"in{k}") for k, n in enumerate(names)])
        inside = F.array_compact(F.array(*[F.when(F.col(f"in{k}"), F.lit(n)) for k, n in enumerate(names)]))
        return rows.join(known, ["entity_id", "ref_id"]).withColumn("in", F.explode(inside)).withColumn("entity_id", F.concat_ws("@", "entity_id", "in")).select(*rows.columns)
    if name in ("workflow_event", "escalation"):
        at = F.col(PLACED[name])
        endless = all(w.start is None for w in windows)  # then every dated row before the end is inside
        inside = at.isNotNull() if endless else at.isNotNull() & (start.isNull() | (at >= start))
        part = lambda keep: scoped(masked(rows_by_window(rows, windows, keep), name))
        if endless and rows.filter(at.isNull()).isEmpty():  # nothing that has to be looked up
            return part(inside & (at < end)).select(*rows.columns)
        about = part((at.isNull() | (at < end)) & ~inside).join(parents(out), ["entity_id", "ref_id"], "left_semi")
        return part(inside & (at < end)).unionByName(about).select(*rows.columns)
    if name == "declared_kpi":
        first, last = period_bounds(F.col("period"))
        meets = first.isNull() | ((first < end) & (start.isNull() | (last > start)))
        return scoped(rows_by_window(rows, windows, meets))
    return scoped(masked(rows.withColumn("w", F.explode(spans(windows))), name))


QUARTER = (Span("2026-Q2", datetime(2026, 4, 1), datetime(2026, 7, 1)),)
#: Columns by which a table's rows are compared in the report.
ABOUT = {"alert": "closed_at", "soc_case": "closed_at", "escalation": "acknowledged_at"}


def window_report(t: Tables, windows: tuple[Span, ...] = QUARTER) -> DataFrame:
    """entity_id, table, n_before, n, known: rows before and after the selection of a quarter, and those whose end (closure,
    acknowledgement) is known in it. A line for each table of each entity that has rows before."""
    s = selected(t, windows)

    def one(name: str) -> DataFrame:
        ends = F.count(ABOUT[name]) if name in ABOUT else F.lit(None).cast("long")
        before = getattr(t, name).groupBy("entity_id").agg(F.count("*").alias("n_before"))
        after = getattr(s, name).groupBy(F.substring_index("entity_id", "@", 1).alias("entity_id")).agg(F.count("*").alias("n"), ends.alias("known"))
        joined = before.join(after, "entity_id", "left")
        return joined.select("entity_id", F.lit(name).alias("table"), "n_before", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("known", F.lit(0)).alias("known") if name in ABOUT else "known")

    return reduce(DataFrame.unionByName, [one(n) for n in CANONICAL if n not in ("entity", "sla_policy")])


def cutoffs(t: Tables, runs: int = RUNS) -> tuple[Span, ...]:
    """Windows without a lower bound, up to each of some equal steps through the time in which alerts were created; named by the
    quarter of the last moment, with its day where a quarter comes again. One row is looked up."""
    low, high = t.alert.agg(F.min("created_at"), F.max("created_at")).first()
    if low is None or high <= low or runs < 1:
        return ()
    out: list[Span] = []
    for k in range(1, runs + 1):
        at = low + (high - low) * k / runs
        name = f"{at.year}-Q{(at.month - 1) // 3 + 1}"
        out.append(Span(f"{name} (as of {at.date()})" if any(w.name == name for w in out) else name, None, at + timedelta(microseconds=1)))
    return tuple(out)


def history_tables(t: Tables, runs: int = RUNS) -> Tables:
    windows = cutoffs(t, runs)
    if not windows:  # nothing to judge
        return selected(t, (Span("none", None, datetime(1970, 1, 1)),), "history0-")
    return selected(t, windows, f"history{runs}-", {w.name: w.end - timedelta(microseconds=1) for w in windows})


def split_scope(rows: DataFrame) -> DataFrame:
    return rows.withColumn("run", F.substring_index("entity_id", "@", -1)).withColumn("entity_id", F.substring_index("entity_id", "@", 1))


def history(t: Tables) -> DataFrame:
    """entity_id, run, risk_index, band, n_rules, coverage, n_findings, total: each entity as it would have been judged at each cut-off."""
    h = history_tables(t)
    found = findings(h).groupBy("entity_id").agg(F.count("*").alias("n_findings"), F.bround(F.sum("score"), 1).alias("total"))
    rows = risk_index(h).join(contracts.coverage(h).select("entity_id", "coverage"), "entity_id").join(found, "entity_id", "left")
    return split_scope(rows).select("entity_id", "run", "risk_index", "band", "n_rules", "coverage", F.coalesce("n_findings", F.lit(0)).alias("n_findings"), F.coalesce("total", F.lit(0.0)).alias("total"))


def history_findings(t: Tables) -> DataFrame:
    return split_scope(findings(history_tables(t))).select("entity_id", "run", "rule_id", "hits", "population", "confidence", "score", "severity")


def history_domains(t: Tables) -> DataFrame:
    return split_scope(domain_scores(history_tables(t))).select("entity_id", "run", "domain", "score", "status")


def history_changes(t: Tables) -> DataFrame:
    """entity_id, rule_id, change, before, after: the findings of the last run beside those of the run before it."""
    names = [w.name for w in cutoffs(t)][-2:]
    f = split_scope(findings(history_tables(t))).select("entity_id", "run", "rule_id", "score")
    if len(names) < 2:
        return f.limit(0).select("entity_id", "rule_id", F.lit("").alias("change"), F.col("score").alias("before"), F.col("score").alias("after"))
    of = lambda k, c: f.filter(F.col("run") == names[k]).select("entity_id", "rule_id", F.col("score").alias(c))
    both = of(0, "before").join(of(1, "after"), ["entity_id", "rule_id"], "full_outer")
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") == F.col("after"), "same").otherwise("changed")
    return both.select("entity_id", "rule_id", change.alias("change"), "before", "after")


QUERIES = {"selection_all_tables": window_report, "history_runs": history, "history_findings": history_findings, "history_domain_scores": history_domains, "history_changes": history_changes}
