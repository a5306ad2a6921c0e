"""SQL (DuckDB) for what is read, cleaned and checked on the way in."""

from __future__ import annotations

from tarsia.operators.records import KEY
from tarsia.plans.contract_oracles import COVERAGE, INPUTS, RESULTS, F
from tarsia.plans.more_oracles import DQ, DS
from tarsia.plans.more_oracles import ORACLES as MORE
from tarsia.plans.oracles import query

SEV = "CASE substr(o_orderpriority, 3) WHEN 'URGENT' THEN 'critical' WHEN 'HIGH' THEN 'high' WHEN 'MEDIUM' THEN 'medium' WHEN 'LOW' THEN 'low' ELSE 'unmapped' END"


def blob(pad: int) -> str:
    return "'" + "".join(f"\\x{b ^ pad:02X}" for b in KEY.ljust(64, b"\0")) + "'::BLOB"


def hmac(value: str) -> str:
    return f"CASE WHEN {value} <> '' THEN 'U_' || substr(sha256({blob(0x5C)} || unhex(sha256({blob(0x36)} || encode({value})))), 1, 16) END"


# Alerts as careless submitters send them, and what the checks find in them.
FAULTY = """fa AS (SELECT * REPLACE (CASE WHEN e = 2 AND k % 40 = 0 THEN 'unmapped' ELSE disposition END AS disposition, CASE WHEN e = 3 AND k % 50 = 0 THEN ' ' ELSE severity_final END AS severity_final) FROM (SELECT *, CAST(substr(entity_id, 2, 2) AS INT) % 5 AS e, CAST(substr(alert_id, 2) AS BIGINT) AS k FROM alert)),
fb AS (SELECT * FROM fa UNION ALL SELECT * FROM fa WHERE e = 1 AND k % 60 = 0)"""
FAULTS = FAULTY + ", " + DQ.replace("FROM alert", "FROM fb")
BLOCKED = """bd AS MATERIALIZED (SELECT e.entity_id, coalesce(array_to_string(list(DISTINCT c ORDER BY c) FILTER (stops), ','), '') AS blocking, coalesce(array_to_string(list(DISTINCT c ORDER BY c) FILTER (NOT stops), ','), '') AS reported
 FROM entity e LEFT JOIN (SELECT entity_id, split_part("check", ':', 1) AS c, split_part("check", ':', 1) IN ('missing_required_field', 'duplicate_primary_keys', 'unrecognised_value') AS stops FROM ru) d ON d.entity_id = e.entity_id GROUP BY 1)"""

ORACLES = {
    "rule_result_state_full": query("SELECT * FROM rr", F, RESULTS),
    "covered_domain_scores": query("SELECT entity_id, domain, score, CASE WHEN applicable > 0 THEN round_even(assessed / applicable::DOUBLE, 4) ELSE 0 END AS coverage, status FROM ds", DS),
    "evidence_band": query(f"SELECT r.entity_id, co.coverage, co.level, r.band, co.requests FROM ({MORE['entity_risk_index']}) r JOIN co ON co.entity_id = r.entity_id", F, RESULTS, COVERAGE),
    "scan_csv": f"SELECT o_orderkey AS order_id, o_orderstatus AS status, round(o_totalprice, 2) AS amount, {SEV} AS severity FROM orders WHERE o_orderkey % 23 <> 0",
    "scan_json": "SELECT CASE WHEN event_id % 40 = 0 THEN 'unreadable' ELSE event_type END AS kind, count(*) AS n, CAST(sum(CASE WHEN event_id % 40 <> 0 THEN CAST(value AS DECIMAL(18, 4)) END) AS DOUBLE) AS total FROM events GROUP BY 1",
    "scan_json_envelope": "SELECT o_custkey AS source, o_orderkey AS order_id, o_orderstatus AS status FROM orders WHERE o_orderkey % 5 = 0",
    "header_normalise": "SELECT p_partkey, key, CASE WHEN n = 1 THEN key ELSE key || '_' || n END AS name FROM (SELECT p_partkey, replace(lower(p_name), ' ', '_') AS key, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) AS n FROM part)",
    "row_hygiene": query(f"SELECT entity_id, alert_id, severity_final, kind AS closed_by_type, CASE WHEN kind = 'human' THEN {hmac('closed_by')} ELSE closed_by END AS closed_by FROM (SELECT entity_id, alert_id, closed_by, CASE WHEN k % 17 = 0 THEN severity_orig ELSE severity_final END AS severity_final, CASE WHEN k % 13 = 0 THEN 'human' ELSE coalesce(closed_by_type, 'human') END AS kind FROM (SELECT *, CAST(substr(alert_id, 2, 8) AS BIGINT) AS k FROM alert))"),
    "pseudonymise": f"SELECT c_custkey, {hmac('c_name')} AS pseudonym FROM customer",
    "comment_hygiene": r"SELECT conv_id, count(*) AS n, count(DISTINCT regexp_replace(trim(lower(coalesce(text, ''))), '\s+', ' ', 'g')) AS distinct, sum(length(text))::BIGINT AS length FROM conversations GROUP BY 1",
    "period_bounds": query("SELECT label, count(*) AS n, s AS start, CAST(s + to_months(m) AS DATE) AS end FROM (SELECT strftime(created_at, '%Y') AS label, date_trunc('year', created_at)::DATE AS s, 12 AS m FROM alert UNION ALL SELECT strftime(created_at, '%Y') || '-Q' || quarter(created_at), date_trunc('quarter', created_at)::DATE, 3 FROM alert UNION ALL SELECT strftime(created_at, '%Y') || '-H' || CASE WHEN month(created_at) < 7 THEN 1 ELSE 2 END, make_date(year(created_at), CASE WHEN month(created_at) < 7 THEN 1 ELSE 7 END, 1), 6 FROM alert UNION ALL SELECT strftime(created_at, '%Y-%m'), date_trunc('month', created_at)::DATE, 1 FROM alert UNION ALL SELECT 'last year', NULL, NULL FROM alert) GROUP BY 1, 3, m"),
    "hash_chain_verify": query("SELECT entity_id, count(*) AS n, count(*) FILTER (bad) AS broken, min(case_id) FILTER (bad) AS first_break FROM (SELECT entity_id, case_id, CAST(substr(case_id, 2, 8) AS BIGINT) % 101 = 0 AND severity <> 'low' AS bad FROM soc_case) GROUP BY 1"),
    "invalid_timestamp": "SELECT user_id, count(*) AS n, count(*) FILTER (event_id % 7 IN (0, 2)) AS invalid FROM events GROUP BY 1 HAVING count(*) FILTER (event_id % 7 IN (0, 2)) > 0",
    "rule_input_coverage": query("SELECT entity_id, count(*) FILTER (len(missing) = 0 AND len(blind) = 0) AS assessed, count(*) FILTER (len(missing) = 0 AND len(blind) > 0) AS degraded, count(*) FILTER (len(missing) > 0) AS not_assessed FROM inp GROUP BY 1", INPUTS),
    "dependency_issues": query("SELECT entity_id, \"check\", need, array_to_string(list(DISTINCT rule_id ORDER BY rule_id), ',') AS rules FROM (SELECT entity_id, rule_id, 'rule_table_missing' AS \"check\", unnest(missing) AS need FROM inp UNION ALL SELECT entity_id, rule_id, 'rule_input_missing', 'alert.' || unnest(blind) FROM inp) GROUP BY 1, 2, 3", INPUTS),
    "blocking_decision": query("SELECT *, CASE WHEN blocking <> '' THEN 'held' ELSE 'published' END AS upload, CASE WHEN blocking <> '' THEN 'rejected' ELSE 'published' END AS interface, 'published' AS automatic FROM bd", FAULTS, BLOCKED),
    "export_csv": "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '''=' WHEN 1 THEN '''@' WHEN 2 THEN '''-' ELSE '' END || c_name AS name, c_mktsegment AS segment FROM customer",
    "flat_mapping": f"SELECT CASE o_orderstatus WHEN 'F' THEN 'closed' WHEN 'O' THEN 'open' END AS state, {SEV} AS severity_orig, {SEV} AS severity_final, count(*) AS n FROM orders GROUP BY 1, 2, 3",
}
