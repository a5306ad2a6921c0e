"""SQL (DuckDB) for the states of rules, written down again from the specification."""

from __future__ import annotations

from tarsia.plans.oracles import RULES

FINDINGS = "\nUNION ALL BY NAME ".join(f"SELECT * FROM ({q})" for q in RULES.values())
F = f"f AS MATERIALIZED ({FINDINGS})"

# Rule, domain, tables, columns of alerts, table of the population, least sample.
CONTRACTS = """ct AS (SELECT * FROM (VALUES
 ('EG01', 'Investigation', ['alert', 'workflow_event'], ['severity_final', 'closed_at'], 'alert', 10), ('EG02', 'Investigation', ['alert', 'workflow_event', 'closure'], ['closed_at'], 'alert', 15),
 ('EG03', 'Escalation', ['alert', 'escalation'], ['severity_final', 'disposition'], 'alert', 5), ('EG04', 'Investigation', ['alert', 'closure'], ['closed_at'], 'alert', 20),
 ('EG05', 'Operational Discipline', ['alert', 'remediation'], ['rule_id', 'asset_id', 'disposition'], 'alert', 10), ('EG06', 'Governance and Oversight', ['alert', 'sla_policy'], ['severity_final', 'closed_at', 'closed_by'], 'alert', 20),
 ('EG07', 'Operational Discipline', ['alert'], ['closed_at', 'closed_by'], 'alert', 20), ('EG08', 'Escalation', ['escalation'], [], 'escalation', 5), ('EG09', 'Incident Response', ['soc_case'], [], 'soc_case', 10),
 ('EG10', 'Governance and Oversight', ['alert', 'declared_kpi'], ['severity_final', 'closed_at'], 'alert', 10), ('EG11', 'Threat Detection', ['alert'], ['disposition'], 'alert', 200), ('EG12', 'Security Operations', ['soc_case', 'workflow_event'], [], 'soc_case', 15),
 ('NS01', 'Threat Detection', ['asset', 'log_source_daily'], [], 'asset', 1), ('NS02', 'Threat Detection', ['alert'], ['category'], 'alert', 30), ('NS03', 'Security Operations', ['alert'], [], 'alert', 30),
 ('NS04', 'Governance and Oversight', ['alert', 'case_alert_link'], ['severity_final', 'disposition'], 'alert', 10), ('NS05', 'Threat Detection', ['alert', 'detection_rule'], ['rule_id'], 'alert', 20),
 ('NS06', 'Cyber Resilience', ['alert', 'asset', 'log_source_daily'], ['asset_id'], 'alert', 10), ('NS07', 'Incident Response', ['soc_case', 'external_report'], [], 'soc_case', 1), ('NS08', 'Governance and Oversight', ['alert'], [], 'alert', 1)
) v(rule_id, domain, needs, fields, pop, least))"""
TABLES = ("alert", "asset", "case_alert_link", "closure", "declared_kpi", "detection_rule", "escalation", "external_report", "log_source_daily", "remediation", "sla_policy", "soc_case", "workflow_event")
SIZES = "sz AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT entity_id, '{n}' AS tab, count(*) AS n FROM {n} GROUP BY 1" for n in TABLES) + ")"
USELESS = "un AS (" + " UNION ALL ".join(
    f"SELECT entity_id, '{c}' AS col FROM alert GROUP BY 1 HAVING count({c}) FILTER ({f"lower({c}) NOT IN ('unknown', 'unmapped', '')" if c in ('disposition', 'severity_final') else 'true'}) = 0" for c in ("asset_id", "category", "closed_at", "closed_by", "disposition", "rule_id", "severity_final")
) + ")"
INPUTS = f"""{CONTRACTS}, {SIZES}, {USELESS}, hv AS (SELECT entity_id, list(tab) AS tabs FROM sz GROUP BY 1), uc AS (SELECT entity_id, list(col) AS cols FROM un GROUP BY 1),
inp AS MATERIALIZED (SELECT e.entity_id, rule_id, domain, list_sort(list_filter(needs, lambda x: NOT list_contains(coalesce(tabs, []), x))) AS missing, list_sort(list_filter(fields, lambda x: list_contains(coalesce(cols, []), x))) AS blind,
 coalesce((SELECT n FROM sz WHERE sz.entity_id = e.entity_id AND sz.tab = ct.pop), 0) AS population, least FROM entity e CROSS JOIN ct LEFT JOIN hv ON hv.entity_id = e.entity_id LEFT JOIN uc ON uc.entity_id = e.entity_id)"""
RESULTS = f"""{INPUTS}, rr AS MATERIALIZED (SELECT entity_id, rule_id, domain, CASE WHEN len(missing) > 0 THEN 'insufficient_evidence' WHEN fires THEN 'finding' WHEN len(blind) > 0 THEN 'degraded' WHEN population < least THEN 'insufficient_evidence' ELSE 'assessed_clear' END AS state,
 CASE WHEN len(missing) > 0 THEN array_to_string(missing, ',') WHEN fires THEN '' ELSE array_to_string(list_transform(blind, lambda x: 'alert.' || x), ',') END AS missing, population
 FROM (SELECT *, EXISTS (SELECT 1 FROM f WHERE f.entity_id = inp.entity_id AND f.rule_id = inp.rule_id) AS fires FROM inp))"""
COVERAGE = """co AS MATERIALIZED (SELECT entity_id, assessed, applicable, coverage, CASE WHEN coverage < 0.25 THEN 'insufficient' WHEN coverage >= 0.9 THEN 'assessable' ELSE 'partial' END AS level,
 coalesce((SELECT array_to_string(list(need ORDER BY n DESC, need), ',') FROM (SELECT need, count(*) AS n FROM (SELECT unnest(string_split(missing, ',')) AS need FROM rr WHERE rr.entity_id = c.entity_id AND missing <> '') GROUP BY 1)), '') AS requests
 FROM (SELECT entity_id, count(*) FILTER (state IN ('finding', 'assessed_clear')) AS assessed, count(*) AS applicable, round_even(count(*) FILTER (state IN ('finding', 'assessed_clear')) / count(*)::DOUBLE, 4) AS coverage FROM rr GROUP BY 1) c)"""
