"""SQL (DuckDB) for issues with samples and for maintenance."""

from __future__ import annotations

from tarsia.plans.ingest_oracles import FAULTY
from tarsia.plans.oracles import finding, query

K = "TRY_CAST(substr({0}, 2, 8) AS BIGINT)"
E = "CAST(substr(entity_id, 2, 2) AS INT)"
TORN = f"""{FAULTY}, tc AS (SELECT * REPLACE (CASE WHEN {E} % 5 = 4 AND {K.format('ref_id')} % 70 = 0 THEN NULL WHEN {E} % 5 = 0 AND {K.format('ref_id')} % 90 = 0 THEN '' ELSE ref_id END AS ref_id) FROM closure),
te AS (SELECT * REPLACE (CASE WHEN {K.format('ref_id')} % 3 = 0 THEN 'Z' || ref_id ELSE ref_id END AS ref_id) FROM escalation), ts AS (SELECT * FROM soc_case WHERE {E} <> 7 AND {K.format('case_id')} % 4 <> 0)"""
FIELDS = [("missing_required_field", c, f"trim(coalesce(CAST({c} AS VARCHAR), '')) = ''") for c in ("alert_id", "created_at", "severity_final")] + [("unrecognised_value", c, f"{c} = 'unmapped'") for c in ("severity_orig", "severity_final", "status", "disposition")] + [("close_before_create", "closed_at", "closed_at < created_at")]
RELATIONS = (("alert:asset_id", "fb", "asset_id", "asset", "asset_id", "alert_id"), ("closure:ref_id", "tc", "ref_id", "fb", "alert_id", "ref_id"), ("workflow_event:ref_id", "(SELECT * FROM workflow_event WHERE ref_type = 'alert')", "ref_id", "fb", "alert_id", "ref_id"),
             ("escalation:ref_id", "te", "ref_id", "fb", "alert_id", "ref_id"), ("case_alert_link:alert_id", "case_alert_link", "alert_id", "fb", "alert_id", "alert_id"), ("case_alert_link:case_id", "case_alert_link", "case_id", "ts", "case_id", "case_id"))
HITS = "hi AS (" + " UNION ALL ".join([
    *[f"SELECT entity_id, '{check}' AS \"check\", 'alert:{c}' AS tab, coalesce(alert_id, 'None') AS sample FROM fb WHERE {cond}" for check, c, cond in FIELDS],
    "SELECT entity_id, 'duplicate_primary_keys', 'alert:alert_id', alert_id FROM fb WHERE alert_id <> '' GROUP BY entity_id, alert_id HAVING count(*) > 1",
    *[f"SELECT x.entity_id, 'orphan_foreign_keys', '{tab}', coalesce(x.{own}, 'None') FROM {child} x WHERE (x.{c} IS NULL OR x.{c} <> '') AND EXISTS (SELECT 1 FROM {parent} p WHERE p.entity_id = x.entity_id AND p.{pid} <> '') AND NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.entity_id = x.entity_id AND p.{pid} = x.{c})" for tab, child, c, parent, pid, own in RELATIONS],
    "SELECT entity_id, 'id_sequence_gap', 'alert', lpad(a::VARCHAR, 19, '0') || '|' || a || '->' || k || ' (diff=' || (k - a) || ')' FROM (SELECT entity_id, k, lag(k) OVER (PARTITION BY entity_id ORDER BY k) AS a, count(*) OVER (PARTITION BY entity_id) AS n FROM (SELECT entity_id, CAST(regexp_extract(alert_id, '([0-9]+)$', 1) AS BIGINT) AS k FROM fb)) WHERE k - a > 50 AND n > 20",
]) + ")"
RATES = "SELECT entity_id, 'high_null_rate', 'alert:' || c, 'warning', n, '' FROM (UNPIVOT (SELECT entity_id, count(*) AS total, " + ", ".join(f"count(*) FILTER (trim(coalesce({c}, '')) = '') AS {c}" for c in ("rule_id", "asset_id", "closed_by", "disposition")) + " FROM fb GROUP BY 1) ON rule_id, asset_id, closed_by, disposition INTO NAME c VALUE n) WHERE n / total > 0.15"
WINDOWS = f"""mw AS (SELECT entity_id, asset_id, DATE '2026-06-07' AS s, DATE '2026-06-08' AS e FROM ka WHERE k % 3 = 0 UNION ALL SELECT entity_id, asset_id, DATE '2026-06-08', DATE '2026-06-09' FROM ka WHERE k % 6 = 0
 UNION ALL SELECT entity_id, asset_id, DATE '2026-06-09', NULL FROM ka WHERE k % 9 = 0 UNION ALL SELECT entity_id, NULL, DATE '2026-06-06', DATE '2026-06-06' FROM entity WHERE {E} % 17 = 0)"""
SILENCE = ("ka AS (SELECT entity_id, asset_id, CAST(substr(asset_id, 5) AS BIGINT) AS k FROM asset WHERE asset_id LIKE 'AST-%')", WINDOWS,
    "si AS (SELECT entity_id, asset_id, count(*) FILTER (served AND NOT kept) AS silent, count(*) FILTER (kept) AS explained FROM (SELECT l.entity_id, l.asset_id, (in_service_from IS NULL OR date >= in_service_from) AND (in_service_to IS NULL OR date <= in_service_to) AS served, EXISTS (SELECT 1 FROM mw WHERE mw.entity_id = l.entity_id AND (mw.asset_id IS NULL OR mw.asset_id = l.asset_id) AND date >= s AND (e IS NULL OR date <= e)) AS kept FROM (SELECT entity_id, asset_id, date FROM log_source_daily GROUP BY 1, 2, 3 HAVING sum(event_count) = 0) l JOIN asset a ON a.entity_id = l.entity_id AND a.asset_id = l.asset_id WHERE monitored_flag AND criticality >= 3) GROUP BY 1, 2)")

ORACLES = {
    "dq_issues_sampled": query(
        "SELECT entity_id, \"check\", tab, CASE \"check\" WHEN 'id_sequence_gap' THEN 'warning' ELSE 'error' END AS severity, any_value(total) AS n, array_to_string(list(regexp_replace(sample, '^[0-9]{19}\\|', '') ORDER BY k), '; ') AS samples FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, \"check\", tab ORDER BY sample) AS k, count(*) OVER (PARTITION BY entity_id, \"check\", tab) AS total FROM hi) WHERE k <= 5 GROUP BY 1, 2, 3 UNION ALL " + RATES, TORN, HITS),
    "silent_assets_maintenance": query("SELECT *, silent >= 3 AS fires FROM si", *SILENCE),
    "ns01_with_maintenance": finding("NS01", "SELECT entity_id, count(*) AS hits, count(*) AS population, max(silent) / 3.0::DOUBLE AS distance FROM si WHERE silent >= 3 GROUP BY 1", "'critical'", "SELECT * FROM si WHERE silent >= 3", "asset_id", ctes=SILENCE),
}
