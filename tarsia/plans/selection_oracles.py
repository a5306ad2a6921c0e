"""SQL (DuckDB) for windows over all tables and for runs at several cut-offs: each run is a query of its own over its window."""

from __future__ import annotations

from tarsia.plans.contract_oracles import TABLES, F
from tarsia.plans.more_oracles import BAND, DS, RI
from tarsia.plans.oracles import HEAD, REFERENCE, RULES

RUNS = 3


def late(column: str, **more: str) -> str:
    return ", ".join(f"CASE WHEN {column} >= e THEN {v} ELSE {c} END AS {c}" for c, v in (more | {column: "NULL"}).items())


ALERT = ", ".join([late("closed_at", closed_by="NULL", closed_by_type="NULL", disposition="NULL", playbook_id="NULL", status="'open'"), late("acknowledged_at"), late("first_touch_at")])
KPI = "SELECT k.* FROM declared_kpi k, {w} WHERE CASE WHEN regexp_matches(period, '^[0-9]{{4}}-H[12]$') THEN make_date(CAST(period[1:4] AS INT), CASE period[7:7] WHEN '1' THEN 1 ELSE 7 END, 1) < e AND (s IS NULL OR make_date(CAST(period[1:4] AS INT), CASE period[7:7] WHEN '1' THEN 1 ELSE 7 END, 1) + INTERVAL 6 MONTH > s) ELSE true END"
ABOUT = "(EXISTS (SELECT 1 FROM {w}_alert a WHERE a.entity_id = x.entity_id AND a.alert_id = x.ref_id) OR EXISTS (SELECT 1 FROM {w}_soc_case c WHERE c.entity_id = x.entity_id AND c.case_id = x.ref_id))"
# In the order in which they build on each other; w has the columns s and e.
PICKED = {
    "alert": f"SELECT a.* REPLACE ({ALERT}) FROM alert a, {{w}} WHERE NOT (created_at IS NULL OR created_at >= e OR (s IS NOT NULL AND created_at < s))",
    "soc_case": f"SELECT c.* REPLACE ({late('closed_at', status="'open'")}) FROM soc_case c, {{w}} WHERE NOT (opened_at IS NULL OR opened_at >= e OR (s IS NOT NULL AND closed_at IS NOT NULL AND closed_at < s))",
    "case_alert_link": "SELECT * FROM case_alert_link x WHERE NOT (NOT EXISTS (SELECT 1 FROM {w}_soc_case c WHERE c.entity_id = x.entity_id AND c.case_id = x.case_id) AND NOT EXISTS (SELECT 1 FROM {w}_alert a WHERE a.entity_id = x.entity_id AND a.alert_id = x.alert_id))",
    "closure": "SELECT * FROM closure x WHERE NOT (NOT EXISTS (SELECT 1 FROM {w}_alert a WHERE a.entity_id = x.entity_id AND a.alert_id = x.ref_id AND a.closed_at IS NOT NULL) AND NOT EXISTS (SELECT 1 FROM {w}_soc_case c WHERE c.entity_id = x.entity_id AND c.case_id = x.ref_id AND c.closed_at IS NOT NULL))",
    "workflow_event": f"SELECT x.* FROM workflow_event x, {{w}} WHERE NOT ((ts IS NULL AND NOT {ABOUT}) OR coalesce(ts >= e, false) OR coalesce(s IS NOT NULL AND ts < s AND NOT {ABOUT}, false))",
    "escalation": f"SELECT x.* REPLACE ({late('acknowledged_at')}) FROM escalation x, {{w}} WHERE NOT ((escalated_at IS NULL AND NOT {ABOUT}) OR coalesce(escalated_at >= e, false) OR coalesce(s IS NOT NULL AND escalated_at < s AND NOT {ABOUT}, false))",
    "remediation": "SELECT r.* FROM remediation r, {w} WHERE created_at < e", "external_report": "SELECT r.* FROM external_report r, {w} WHERE reported_at < e",
    "log_source_daily": "SELECT l.* FROM log_source_daily l, {w} WHERE date < CAST(e AS DATE) AND (s IS NULL OR date >= CAST(s AS DATE))", "declared_kpi": KPI,
    "asset": "SELECT * FROM asset", "detection_rule": "SELECT * FROM detection_rule", "sla_policy": "SELECT * FROM sla_policy", "entity": "SELECT * FROM entity",
}


def tables(w: str) -> str:
    return ", ".join(f"{w}_{n} AS MATERIALIZED ({q.format(w=w)})" for n, q in PICKED.items())


CUTS = f"""sp AS (SELECT epoch_us(min(created_at)) AS lo, epoch_us(max(created_at)) AS hi FROM alert),
cu AS (SELECT k, make_timestamp(CAST(lo + round((hi - lo) * k / {RUNS}.0::DOUBLE) AS BIGINT)) AS latest FROM sp, range(1, {RUNS + 1}) r(k)),
nm AS (SELECT k, latest, strftime(latest, '%Y') || '-Q' || quarter(latest) || CASE WHEN EXISTS (SELECT 1 FROM cu b WHERE b.k < cu.k AND year(b.latest) = year(cu.latest) AND quarter(b.latest) = quarter(cu.latest)) THEN ' (as of ' || CAST(latest AS DATE) || ')' ELSE '' END AS name FROM cu)"""
WINDOWS = ", ".join(f"w{k} AS (SELECT name, latest, CAST(NULL AS TIMESTAMP) AS s, latest + INTERVAL 1 MICROSECOND AS e FROM nm WHERE k = {k}), {tables(f'w{k}')}" for k in range(1, RUNS + 1))


def within(k: int) -> str:
    return "WITH " + ", ".join(f"{n} AS (SELECT * FROM w{k}_{n})" for n in PICKED)


def found(k: int) -> str:
    """The findings of a run, with its own moment of reference."""
    each = [q[len(HEAD):].replace(REFERENCE, f"ref AS (SELECT latest FROM w{k})") for q in RULES.values()]
    return f"f{k} AS MATERIALIZED (" + "\nUNION ALL BY NAME ".join(f"SELECT * FROM ({within(k)}{q})" for q in each) + ")"


def runs(select: str, *ctes: str) -> str:
    """A query over each run, united; in it f are the run's findings and w{k} holds its name."""
    def own(k: int) -> str:
        inner = "".join(f", {c.replace(F, f'f AS (SELECT * FROM f{k})')}" for c in ctes) if ctes else f", f AS (SELECT * FROM f{k})"
        return f"SELECT * FROM ({within(k)}{inner} {select.replace('{k}', str(k))})"

    return f"{HEAD}, {CUTS}, {WINDOWS}, " + ", ".join(found(k) for k in range(1, RUNS + 1)) + "\n" + " UNION ALL ".join(own(k) for k in range(1, RUNS + 1))


CHANGED = runs("SELECT {k} AS k, entity_id, rule_id, score FROM f")
REPORTED = [n for n in (*TABLES,) if n != "sla_policy"]
KNOWN = {"alert": "closed_at", "soc_case": "closed_at", "escalation": "acknowledged_at"}

ORACLES = {
    "selection_all_tables": f"{HEAD}, q AS (SELECT TIMESTAMP '2026-04-01' AS s, TIMESTAMP '2026-07-01' AS e), {tables('q')} " + " UNION ALL ".join(
        f"SELECT b.entity_id, '{n}' AS \"table\", n_before, coalesce(n, 0) AS n, {'coalesce(known, 0)' if n in KNOWN else 'known'} AS known FROM (SELECT entity_id, count(*) AS n_before FROM {n} GROUP BY 1) b LEFT JOIN (SELECT entity_id, count(*) AS n, {f'count({KNOWN[n]})' if n in KNOWN else 'CAST(NULL AS BIGINT)'} AS known FROM q_{n} GROUP BY 1) a ON a.entity_id = b.entity_id" for n in REPORTED),
    "history_runs": runs(f"SELECT ri.entity_id, (SELECT name FROM w{{k}}) AS run, risk_index, {BAND} AS band, n_rules, coverage, coalesce(n_findings, 0) AS n_findings, coalesce(total, 0) AS total FROM ri JOIN (SELECT entity_id, coverage FROM co) co ON co.entity_id = ri.entity_id LEFT JOIN (SELECT entity_id, count(*) AS n_findings, round_even(sum(score), 1) AS total FROM f GROUP BY 1) x ON x.entity_id = ri.entity_id", RI),
    "history_findings": runs("SELECT entity_id, (SELECT name FROM w{k}) AS run, rule_id, hits, population, confidence, score, severity FROM f"),
    "history_domain_scores": runs("SELECT entity_id, (SELECT name FROM w{k}) AS run, domain, score, status FROM ds", DS),
    "history_changes": f"SELECT coalesce(a.entity_id, b.entity_id) AS entity_id, coalesce(a.rule_id, b.rule_id) AS rule_id, CASE WHEN a.score IS NULL THEN 'added' WHEN b.score IS NULL THEN 'removed' WHEN a.score = b.score THEN 'same' ELSE 'changed' END AS change, a.score AS before, b.score AS after FROM (SELECT * FROM ({CHANGED}) WHERE k = {RUNS - 1}) a FULL JOIN (SELECT * FROM ({CHANGED}) WHERE k = {RUNS}) b ON a.entity_id = b.entity_id AND a.rule_id = b.rule_id",
}
