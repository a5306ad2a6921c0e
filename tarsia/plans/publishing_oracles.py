"""SQL (DuckDB) for files and what they stand for, mappings, publication, persisted runs and moved weights."""

from __future__ import annotations

from tarsia.operators.scoring import DOMAIN_WEIGHTS
from tarsia.plans.assessment_oracles import FOUND, QUEUE, RISK
from tarsia.plans.ingest_oracles import BLOCKED, FAULTS
from tarsia.plans.ingest_oracles import ORACLES as INGEST
from tarsia.plans.oracles import query

# What each of the 24 kinds of file stands for, in order.
KINDS = "['alert', 'case', 'alert', 'case_alert_link', 'workflow_event', 'workflow_event', 'detection_rule', 'sla_policy', 'case_record', 'asset', 'declared_kpi', 'entity', 'alert', 'escalation', 'alert', 'case_record', 'escalation', 'closure', 'workflow_event', 'asset', 'log_source_daily', 'declared_kpi', 'entity', NULL]"
LEVEL = "CASE substr(o_orderpriority, 3) WHEN 'URGENT' THEN 'critical' WHEN 'HIGH' THEN 'high' WHEN 'MEDIUM' THEN 'medium' WHEN 'LOW' THEN 'low' END"
OWNER = "coalesce(CASE WHEN c_custkey % 6 <> 0 THEN c_name END, 'nobody')"
FROM = "FROM orders LEFT JOIN customer ON c_custkey = o_custkey"
ALERTS = f"al AS (SELECT o_orderkey AS k, CASE WHEN o_orderstatus NOT IN ('O', 'F') THEN 'filtered' WHEN {LEVEL} IS NULL THEN 'missing severity' ELSE 'stored' END AS outcome, {OWNER} AS owner, {LEVEL} AS severity, CASE o_orderstatus WHEN 'O' THEN 'true' ELSE 'false' END AS open {FROM})"
CLOSURES = f"cl AS (SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'F' THEN 'stored' ELSE 'filtered' END AS outcome, length(o_orderpriority)::VARCHAR AS comment_len, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN {LEVEL} END AS severity FROM orders)"
CHECKS = f"{FAULTS}, {BLOCKED}, bl AS (SELECT entity_id, CASE blocking WHEN '' THEN 0 ELSE len(string_split(blocking, ',')) END AS n_problems FROM bd)"
COVERED = f"cs AS (SELECT * FROM ({INGEST['covered_domain_scores']}))"
FILES = "ef AS (SELECT CAST(user_id % 20 AS INT) AS part, count(*) AS n, count(*) FILTER (user_id % 20 = 7 OR user_id % 20 % 3 = 0 AND event_id % 40 = 0) AS bad FROM events GROUP BY 1)"
POINTS = "CASE domain " + " ".join(f"WHEN '{d}' THEN {round(w * 1000)}" for d, w in DOMAIN_WEIGHTS.items()) + " END"


def ranked(column: str) -> str:
    return f"rank() OVER (ORDER BY {column} DESC) + (count(*) OVER (PARTITION BY {column}) - 1) / 2.0::DOUBLE"


def counted(tab: str, source: str) -> str:
    return f"SELECT '{tab}' AS tab, run_id, entity_id, count(*) AS n FROM {source}, (SELECT unnest(['R1', 'R2']) AS run_id) GROUP BY ALL"


def filled(tab: str, source: str, column: str, value: str) -> str:
    return f"SELECT '{tab}' AS tab, 'filled {column}' AS measure, count(*) FILTER (outcome = 'stored' AND {value} IS NOT NULL) AS n FROM {source}"


ORACLES = {
    "recognise_table": f"SELECT c_custkey, {KINDS}[c_custkey % 24 + 1] AS tab FROM customer",
    "empty_declares": "SELECT n_nationkey AS nation, 'alert' AS tab, CASE WHEN count(o_orderkey) > 0 THEN 'rows' ELSE 'declared_empty' END AS completeness, count(o_orderkey) AS n FROM nation LEFT JOIN (SELECT c_nationkey, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey % 4 <> 0) ON c_nationkey = n_nationkey WHERE n_nationkey % 5 <> 3 GROUP BY 1",
    "scan_parquet_published": "SELECT pub_seq, first_customer, o_orderkey AS order_id, o_orderstatus AS status, CASE WHEN pub_seq > 3 THEN o_orderpriority END AS priority FROM (SELECT *, CAST(year(o_orderdate) - 1991 AS INT) AS pub_seq, min(o_custkey) OVER (PARTITION BY year(o_orderdate)) AS first_customer FROM orders) WHERE pub_seq % 3 <> 0",
    "publish_batch": query("SELECT policy, bl.entity_id, status, n_problems, CASE WHEN status = 'published' THEN coalesce(n, 0) ELSE 0 END AS n_rows FROM (SELECT bl.*, policy, CASE WHEN policy = 'preview' THEN 'preview' WHEN policy = 'auto' OR n_problems = 0 THEN 'published' WHEN policy = 'strict' THEN 'rejected' ELSE 'held' END AS status FROM bl, (SELECT unnest(['auto', 'strict', 'if_clean', 'preview']) AS policy)) bl LEFT JOIN (SELECT entity_id, count(*) AS n FROM fb GROUP BY 1) a ON a.entity_id = bl.entity_id", CHECKS),
    "persist_run": query(" UNION ALL ".join([counted("finding", "f"), counted("evidence", "(SELECT entity_id, unnest(string_split(evidence, ',')) AS id FROM f)"), counted("queue", "q"),
        *[counted(tab, f"(SELECT entity_id, unnest(range({n})) FROM entity)") for tab, n in (("domain_score", 8), ("entity_score", 1), ("rule_result", 20))]]), FOUND, QUEUE),
    "file_issues": f"WITH {FILES} SELECT * FROM (SELECT CASE part WHEN 11 THEN 'misc_' WHEN 13 THEN 'cases_' ELSE 'notable_' END || part AS file, CASE WHEN bad = n THEN 'file_unreadable' WHEN part = 11 THEN 'file_not_recognised' WHEN part = 13 THEN 'file_not_mapped' WHEN bad > 0 THEN 'file_partly_read' END AS \"check\", CASE WHEN bad = n THEN 'error' ELSE 'warning' END AS severity, CASE WHEN bad < n AND bad > 0 AND part NOT IN (11, 13) THEN bad ELSE 1 END AS n FROM ef) WHERE \"check\" IS NOT NULL",
    "declared_mapping": f"WITH {ALERTS}, {CLOSURES} SELECT 'alert' AS tab, k::VARCHAR AS id, owner, severity, open, 'orders' AS source, NULL AS comment_len FROM al WHERE outcome = 'stored' UNION ALL SELECT 'closure', k::VARCHAR, NULL, severity, NULL, NULL, comment_len FROM cl WHERE outcome = 'stored'",
    "declared_mapping_coverage": f"WITH {ALERTS}, {CLOSURES} " + " UNION ALL ".join([
        *[f"SELECT '{t}' AS tab, 'rows ' || outcome AS measure, count(*) AS n FROM {s} GROUP BY 2" for t, s in (("alert", "al"), ("closure", "cl"))], *[f"SELECT '{t}', 'rows read', count(*) FROM {s}" for t, s in (("alert", "al"), ("closure", "cl"))],
        *[filled("alert", "al", c, v) for c, v in (("id", "k"), ("owner", "owner"), ("severity", "severity"), ("open", "open"), ("source", "'orders'"))], *[filled("closure", "cl", c, v) for c, v in (("id", "k"), ("comment_len", "comment_len"), ("severity", "severity"))],
        "SELECT '*', 'rows lost', count(*) FROM al JOIN cl USING (k) WHERE al.outcome <> 'stored' AND cl.outcome <> 'stored'", "SELECT '*', 'unused ' || unnest(['o_orderdate', 'o_totalprice']), 1"]),
    "weight_stability": query(f"SELECT unnest(['lower', 'higher']) AS move, rho, rho >= 0.85 AS stable FROM (SELECT round_even(corr({'a'}, {'b'}), 4) AS rho FROM (SELECT {ranked('risk_index')} AS a, {ranked('moved')} AS b FROM (SELECT r.entity_id, risk_index, round_even((9.0::DOUBLE * (points / 10.0::DOUBLE / 1000) + least(100.0::DOUBLE, 10.0::DOUBLE * n_rules)) / 10.0::DOUBLE, 1) AS moved FROM r JOIN (SELECT entity_id, sum({POINTS} * CAST(round(coalesce(score, 0) * 10) AS BIGINT)) AS points FROM cs GROUP BY 1) p ON p.entity_id = r.entity_id)))", RISK, COVERED),
}
