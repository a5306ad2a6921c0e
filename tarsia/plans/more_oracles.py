"""SQL (DuckDB) for scoring, aggregates, versions, cleaning and data quality."""

from __future__ import annotations

from tarsia.operators.records import PLANTED
from tarsia.operators.rules import DOMAINS
from tarsia.operators.scoring import DOMAIN_WEIGHTS
from tarsia.plans.contract_oracles import COVERAGE, FINDINGS, RESULTS, F
from tarsia.plans.oracles import LOCAL, PEERS, query

DOMAIN = "CASE rule_id " + " ".join(f"WHEN '{r}' THEN '{d}'" for r, d in DOMAINS.items()) + " END"
WEIGHT = "CASE domain " + " ".join(f"WHEN '{d}' THEN {w}::DOUBLE" for d, w in DOMAIN_WEIGHTS.items()) + " END"
DS = f"""{F}, {RESULTS}, ds AS MATERIALIZED (SELECT g.entity_id, g.domain, CASE WHEN miss IS NOT NULL OR assessed > 0 THEN round_even(100.0::DOUBLE * (1 - coalesce(miss, 1.0)), 1) END AS score, coalesce(n, 0) AS n_findings, applicable, assessed,
 CASE WHEN assessed = 0 THEN 'unknown' WHEN assessed = applicable THEN 'assessed' ELSE 'partial' END AS status
 FROM (SELECT entity_id, domain, count(*) AS applicable, count(*) FILTER (state IN ('finding', 'assessed_clear')) AS assessed FROM rr GROUP BY 1, 2) g
 LEFT JOIN (SELECT entity_id, {DOMAIN} AS domain, product(1 - score / 100.0::DOUBLE) AS miss, count(*) AS n FROM f GROUP BY 1, 2) x ON x.entity_id = g.entity_id AND x.domain = g.domain)"""
RI = f"""{DS}, {COVERAGE}, ri AS (SELECT e.entity_id, coalesce(base, 0.0) AS base, coalesce(n_rules, 0) AS n_rules, coalesce(fl, -1) AS fl, level, round_even((9.0::DOUBLE * coalesce(base, 0.0) + least(100.0::DOUBLE, 10.0::DOUBLE * coalesce(n_rules, 0))) / 10.0::DOUBLE, 1) AS risk_index
 FROM entity e LEFT JOIN (SELECT entity_id, CAST(sum(CAST(round({WEIGHT} * 1000) AS BIGINT) * CAST(round(score * 10) AS BIGINT)) AS DOUBLE) / 10.0::DOUBLE / CAST(sum(CAST(round({WEIGHT} * 1000) AS BIGINT)) AS DOUBLE) AS base FROM ds WHERE score IS NOT NULL GROUP BY 1) b ON b.entity_id = e.entity_id
 LEFT JOIN (SELECT entity_id, count(DISTINCT rule_id) AS n_rules, max(CASE WHEN confidence >= 0.5 THEN CASE severity WHEN 'critical' THEN 2 WHEN 'high' THEN 1 ELSE -1 END END) AS fl FROM f GROUP BY 1) r ON r.entity_id = e.entity_id LEFT JOIN co ON co.entity_id = e.entity_id)"""
BAND = "CASE WHEN level <> 'insufficient' THEN ['low', 'moderate', 'high', 'critical'][greatest(CASE WHEN risk_index <= 25 THEN 0 WHEN risk_index <= 50 THEN 1 WHEN risk_index <= 75 THEN 2 ELSE 3 END, fl) + 1] WHEN fl >= 0 THEN ['low', 'moderate', 'high', 'critical'][fl + 1] ELSE 'insufficient_evidence' END"
MIN = "(epoch_us({0}) - epoch_us(created_at)) / 1e6"
MONTHS = """mo AS (SELECT entity_id, strftime(created_at, '%Y-%m') AS month, CAST(date_trunc('month', created_at) AS DATE) AS m, count(*) AS alerts, count(*) FILTER (disposition = 'true_positive') AS tp, count(*) FILTER (closed_by_type = 'automation') AS auto FROM alert GROUP BY 1, 2, 3),
sp AS (SELECT entity_id, min(created_at::DATE) AS d0, max(created_at::DATE) AS d1 FROM alert GROUP BY 1),
ms AS (SELECT entity_id, month, alerts, alerts / (date_diff('day', greatest(m, d0), least(last_day(m), d1)) + 1)::DOUBLE AS per_day, CASE WHEN alerts >= 20 THEN tp / alerts::DOUBLE END AS tp_share, CASE WHEN alerts >= 20 THEN auto / alerts::DOUBLE END AS auto_share FROM mo JOIN sp USING (entity_id))"""
BATCHES = """kb AS (SELECT *, CAST(substr(alert_id, 2, 8) AS BIGINT) AS k FROM alert),
fb AS (SELECT CASE WHEN k % 2 = 0 THEN 'siem' ELSE 'desk' END AS source, entity_id, alert_id, severity_final, status, 1 AS pub_seq, k FROM kb),
bt AS (SELECT source, entity_id, CASE WHEN k % 97 <> 0 THEN alert_id END AS alert_id, severity_final, status, pub_seq FROM (SELECT * FROM fb UNION ALL SELECT source, entity_id, alert_id, severity_final, 'closed', CAST(1 + k % 3 AS INT), k FROM fb WHERE k % 3 <> 0))"""
CURRENT = "SELECT DISTINCT source, entity_id, alert_id, severity_final, status, pub_seq FROM (SELECT *, CASE WHEN alert_id IS NULL THEN row_number() OVER () END AS own FROM bt WHERE pub_seq <= {0}) QUALIFY rank() OVER (PARTITION BY source, entity_id, alert_id, own ORDER BY pub_seq DESC) = 1"
BLANKS = ("rule_id", "category", "asset_id", "closed_by", "closed_by_type", "disposition", "status", "playbook_id", "severity_final")
NAMES = ("alert", "soc_case", "escalation", "closure", "asset", "remediation", "external_report")
DQ = """ru AS (SELECT entity_id, 'missing_required_field' AS "check", count(*) AS n FROM alert WHERE trim(coalesce(alert_id, '')) = '' OR created_at IS NULL OR trim(coalesce(severity_final, '')) = '' GROUP BY 1
 UNION ALL SELECT entity_id, 'close_before_create', count(*) FROM alert WHERE closed_at < created_at GROUP BY 1
 UNION ALL SELECT entity_id, 'duplicate_primary_keys', count(*) FROM (SELECT entity_id, alert_id FROM alert GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1
 UNION ALL SELECT entity_id, 'id_sequence_gap', count(*) FROM (SELECT entity_id, k - lag(k) OVER (PARTITION BY entity_id ORDER BY k) AS gap FROM (SELECT DISTINCT entity_id, CAST(substr(alert_id, 2) AS BIGINT) AS k FROM alert)) WHERE gap > 50 GROUP BY 1
 UNION ALL SELECT entity_id, 'orphan_asset', count(*) FROM alert a WHERE NOT EXISTS (SELECT 1 FROM asset s WHERE s.entity_id = a.entity_id AND s.asset_id = a.asset_id) GROUP BY 1
 UNION ALL SELECT entity_id, 'orphan_link', count(*) FROM case_alert_link l WHERE NOT EXISTS (SELECT 1 FROM soc_case c WHERE c.entity_id = l.entity_id AND c.case_id = l.case_id) GROUP BY 1
 UNION ALL SELECT entity_id, 'high_null_rate:' || c, n FROM (UNPIVOT (SELECT entity_id, count(*) AS total, count(*) FILTER (coalesce(rule_id, '') = '') AS rule_id, count(*) FILTER (coalesce(asset_id, '') = '') AS asset_id, count(*) FILTER (coalesce(closed_by, '') = '') AS closed_by, count(*) FILTER (coalesce(disposition, '') = '') AS disposition FROM alert GROUP BY 1) ON rule_id, asset_id, closed_by, disposition INTO NAME c VALUE n) WHERE n / total > 0.15
 UNION ALL SELECT entity_id, 'unrecognised_value', count(*) FROM alert WHERE 'unmapped' IN (disposition, status, severity_final) GROUP BY 1)"""

# Patterns that are masked, in this order.
MASKS = {
    r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b": "EMAIL", r"\b(?:\d{1,3}\.){3}\d{1,3}\b": "IPV4", r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b": "IPV6",
    r"\b[a-zA-Z0-9][-a-zA-Z0-9]{1,62}(?:\.[a-zA-Z0-9][-a-zA-Z0-9]{1,62})+\b": "HOST", r"\b\d{8,}\b": "NUM",
}
REDACTED = "x"
for pattern, word in MASKS.items():
    REDACTED = f"regexp_replace({REDACTED}, '{pattern}', '[REDACTED_{word}]', 'g')"
COLUMNS = {
    "entity": "entity_id name sector size_band soc_model soc_provider timezone declared_shift_hours", "alert": "entity_id alert_id rule_id category severity_orig severity_final asset_id created_at acknowledged_at first_touch_at closed_at closed_by closed_by_type playbook_id disposition status",
    "workflow_event": "entity_id ref_type ref_id ts actor action note_len", "soc_case": "entity_id case_id severity status owner opened_at closed_at", "case_alert_link": "entity_id case_id alert_id",
    "escalation": "entity_id esc_id ref_id escalated_at from_role to_role acknowledged_at outcome", "closure": "entity_id ref_id reason_code disposition comment_norm_hash comment_len",
    "asset": "entity_id asset_id asset_type criticality monitored_flag in_service_from in_service_to", "log_source_daily": "entity_id asset_id source_type date event_count", "detection_rule": "entity_id rule_id category mitre_technique enabled",
    "remediation": "entity_id ticket_id linked_asset_id linked_rule_id type created_at", "external_report": "entity_id incident_id reported_to reported_at", "declared_kpi": "entity_id period metric severity value", "sla_policy": "entity_id severity ack_minutes resolve_minutes",
}
ROWS = {n: "concat_ws('|', " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '~')" for c in cs.split()) + ")" for n, cs in COLUMNS.items()}

ORACLES = {
    "findings": f"SELECT * FROM ({FINDINGS})",
    "peer_cohorts": query("SELECT entity_id, level, count(*) AS n_peers, array_to_string(list(peer_id ORDER BY peer_id), ',') AS members, CASE WHEN count(*) >= 5 AND level < 4 THEN 'established' ELSE 'exploratory' END AS strength FROM peers GROUP BY 1, 2", PEERS),
    "peer_exclusions": query("SELECT entity_id, level, attribute, count(*) AS n FROM (SELECT entity_id, level, CASE WHEN level IN (0, 1, 2) AND NOT s THEN 'sector' WHEN level IN (0, 1, 3) AND NOT z THEN 'size_band' WHEN level = 0 AND NOT m THEN 'soc_model' WHEN level = 0 AND NOT h THEN 'schedule' END AS attribute FROM lv JOIN pick USING (entity_id)) WHERE attribute IS NOT NULL GROUP BY ALL", PEERS),
    "local_time_counts": query("SELECT entity_id, zone, strftime(created_at, '%Y-%m') AS month, count(*) AS alerts, count(*) FILTER (hour(lt) < 8 OR hour(lt) >= 20) AS night, count(*) FILTER (dayofweek(lt) IN (0, 6)) AS weekend FROM loc GROUP BY 1, 2, 3", LOCAL),
    "domain_scores": query("SELECT * FROM ds", DS),
    "entity_risk_index": query(f"SELECT entity_id, round_even(base, 4) AS base, n_rules, risk_index, {BAND} AS band FROM ri", RI),
    "rank_controls": query("SELECT rule_id, count(DISTINCT entity_id) AS n_entities, max(CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) AS max_severity, round_even(sum(score), 1) AS total FROM f GROUP BY 1", F),
    "rank_processes": query("SELECT domain, count(*) FILTER (score >= 50) AS n_weak, median(score) AS median_score, max(score) AS max_score FROM ds GROUP BY 1", DS),
    "domain_heatmap": query("SELECT entity_id, " + ", ".join(f"max(score) FILTER (domain = '{d}') AS {d.lower().replace(' ', '_')}" for d in DOMAIN_WEIGHTS) + " FROM ds GROUP BY 1", DS),
    "portfolio_summary": query("SELECT entity_id, count(*) FILTER (fam = 'EG') AS n_eg, count(*) FILTER (fam = 'NS') AS n_ns, coalesce(array_to_string(list(rule_id ORDER BY n) FILTER (fam = 'EG' AND n <= 3), ','), '') AS top_eg, coalesce(array_to_string(list(rule_id ORDER BY n) FILTER (fam = 'NS' AND n <= 3), ','), '') AS top_ns FROM (SELECT *, substr(rule_id, 1, 2) AS fam, row_number() OVER (PARTITION BY entity_id, substr(rule_id, 1, 2) ORDER BY score DESC, rule_id) AS n FROM f) GROUP BY 1", F),
    "review_queue": query(
        "SELECT entity_id, record_id, priority, 'targeted' AS arm FROM ft UNION ALL SELECT entity_id, alert_id, 0.0, 'random' FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY k, c, alert_id) AS n FROM pool WHERE k <= 30) WHERE n <= 9", F,
        "sc AS (SELECT entity_id, record_id, round_even(sum(score), 1) AS priority FROM (SELECT entity_id, score, unnest(string_split(evidence, ',')) AS record_id FROM f WHERE evidence IS NOT NULL) GROUP BY 1, 2)",
        "ft AS (SELECT entity_id, record_id, priority FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY priority DESC, record_id) AS n FROM sc) WHERE n <= 21)",
        "pool AS (SELECT *, row_number() OVER (PARTITION BY entity_id, severity_final ORDER BY c, alert_id) AS k FROM (SELECT entity_id, alert_id, severity_final, md5('42:' || alert_id) AS c FROM alert a WHERE NOT EXISTS (SELECT 1 FROM ft WHERE ft.entity_id = a.entity_id AND ft.record_id = a.alert_id)))"),
    "detection_prf": query("SELECT rule_id, count(*) FILTER (found AND planted) AS tp, count(*) FILTER (found AND planted IS NULL) AS fp, count(*) FILTER (planted AND found IS NULL) AS fn, count(*) FILTER (found AND planted) / nullif(count(*) FILTER (found), 0)::DOUBLE AS precision, count(*) FILTER (found AND planted) / nullif(count(*) FILTER (planted), 0)::DOUBLE AS recall FROM (SELECT entity_id, rule_id, true AS found FROM f) FULL JOIN truth USING (entity_id, rule_id) GROUP BY 1", F,
        "truth AS (SELECT entity_id, rule_id, true AS planted FROM (VALUES " + ", ".join(f"('{e}', '{r}')" for r, es in PLANTED.items() for e in es) + ") v(entity_id, rule_id))"),
    "timing_metrics": query(f"SELECT entity_id, severity_final, closed_by_type, count(*) AS n, median({MIN.format('acknowledged_at')}) AS median_ack, median({MIN.format('first_touch_at')}) AS median_touch, quantile_cont({MIN.format('closed_at')}, 0.05) AS p5_close, quantile_cont({MIN.format('closed_at')}, 0.5) AS p50_close, quantile_cont({MIN.format('closed_at')}, 0.95) AS p95_close FROM alert WHERE closed_at >= created_at GROUP BY 1, 2, 3"),
    "workflow_metrics": query("SELECT entity_id, closed_by_type, count(*) AS alerts, avg(n) AS events_per_alert, avg(CAST(n <= 1 AS INT)) AS share_thin, avg(CAST(looked = 0 AS INT)) AS share_unlooked FROM (SELECT a.entity_id, closed_by_type, coalesce(n, 0) AS n, coalesce(looked, 0) AS looked FROM alert a LEFT JOIN (SELECT entity_id, ref_id, count(*) AS n, count(*) FILTER (action = 'investigate') AS looked FROM workflow_event WHERE ref_type = 'alert' GROUP BY 1, 2) w ON w.entity_id = a.entity_id AND w.ref_id = a.alert_id) GROUP BY 1, 2"),
    "metric_sweep": query("SELECT entity_id, 'count:' || g AS metric, n::DOUBLE AS value FROM gr UNION ALL SELECT entity_id, 'mean_close:' || g, round_even(m, 3) FROM gr WHERE m IS NOT NULL UNION ALL SELECT entity_id, 'hour:' || strftime(created_at, '%H'), count(*)::DOUBLE FROM alert GROUP BY 1, 2 UNION ALL SELECT entity_id, 'category:' || category, count(*)::DOUBLE FROM alert GROUP BY 1, 2",
        "gr AS (SELECT entity_id, concat_ws(':', severity_final, disposition, closed_by_type) AS g, count(*) AS n, sum(epoch_us(closed_at) - epoch_us(created_at))::DOUBLE / 1e6 / nullif(count(closed_at), 0) AS m FROM alert GROUP BY 1, 2)"),
    "mtta_mttr_scan": query(f"SELECT entity_id, severity_final, count(*) AS n, median({MIN.format('closed_at')} / 60) AS mttr_min, median({MIN.format('acknowledged_at')} / 60) AS mtta_min, 100.0::DOUBLE * count(*) FILTER (disposition = 'false_positive') / count(*) AS fp_pct, 100.0::DOUBLE * count(*) FILTER (closed_by_type = 'automation') / count(*) AS soar_pct FROM alert GROUP BY 1, 2"),
    "kpi_reconciliation": query("SELECT entity_id, severity, period, value AS declared, round_even(us / 60e6 / n, 4) AS measured, round_even((us / 60e6 / n - value) / greatest(value, 1), 4) AS gap FROM declared_kpi JOIN (SELECT entity_id, severity_final AS severity, count(*) AS n, sum(epoch_us(closed_at) - epoch_us(created_at))::DOUBLE AS us FROM alert WHERE closed_at >= created_at GROUP BY 1, 2) USING (entity_id, severity) WHERE metric = 'MTTR'"),
    "usable_counts": query(" UNION ALL ".join(f"SELECT entity_id, '{c}' AS \"column\", count({c}) AS n_present, count(*) FILTER (trim({c}) <> '') AS n_filled, count(*) FILTER (lower(trim({c})) NOT IN ('', 'unknown', 'unmapped', 'none', 'null')) AS n_usable FROM alert GROUP BY 1" for c in BLANKS)),
    "alerts_search": query("SELECT entity_id, alert_id, rule_id, asset_id, round_even((epoch_us(closed_at) - epoch_us(created_at)) / 1e6 / 60, 1) AS minutes, (SELECT count(*) FROM hit) AS total FROM hit ORDER BY created_at DESC, alert_id LIMIT 25", "hit AS (SELECT * FROM alert WHERE severity_final = 'high' AND (alert_id LIKE '%R0%' OR rule_id LIKE '%R0%' OR asset_id LIKE '%R0%'))"),
    "alerts_stats": query("SELECT count(*) AS total, count(*) FILTER (severity_final IN ('high', 'critical')) AS serious, count(*) FILTER (closed_by_type = 'automation') AS automated, 100.0::DOUBLE * count(*) FILTER (disposition = 'false_positive') / greatest(count(*), 1) AS fp_pct FROM alert"),
    "monthly_series": query("SELECT * FROM ms", MONTHS),
    "cusum": query("SELECT entity_id, month, round_even(u - least(0, min(u) OVER w), 6) AS up, round_even(d - least(0, min(d) OVER w), 6) AS down, u - least(0, min(u) OVER w) > 4 OR d - least(0, min(d) OVER w) > 4 AS alarm FROM (SELECT entity_id, month, sum(z - 0.5::DOUBLE) OVER w AS u, sum(-z - 0.5::DOUBLE) OVER w AS d FROM zz WINDOW w AS (PARTITION BY entity_id ORDER BY month)) WINDOW w AS (PARTITION BY entity_id ORDER BY month)", MONTHS,
        "lv AS (SELECT entity_id, median(per_day) AS level FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY month) AS n FROM ms) WHERE n <= 3 GROUP BY 1)", "zz AS (SELECT entity_id, month, (per_day - level) / greatest(0.1::DOUBLE * level, 0.01::DOUBLE) AS z FROM ms JOIN lv USING (entity_id))"),
    "blind_signals": query(f"SELECT a.*, declared, coalesce(escalations, 0) AS escalations, coalesce(silent, 0) AS silent, coalesce(escalations, 0) / nullif(serious, 0)::DOUBLE AS esc_share FROM (SELECT entity_id, count(*) AS alerts, median({MIN.format('closed_at')} / 60) AS mttr_min, 100.0::DOUBLE * avg(CAST(closed_by_type = 'automation' AS INT)) AS soar_pct, count(*) FILTER (severity_final IN ('high', 'critical')) AS serious FROM alert GROUP BY 1) a LEFT JOIN (SELECT entity_id, arg_max(value, severity) AS declared FROM declared_kpi WHERE metric = 'MTTR' GROUP BY 1) k ON k.entity_id = a.entity_id LEFT JOIN (SELECT entity_id, count(*) AS escalations FROM escalation GROUP BY 1) e ON e.entity_id = a.entity_id LEFT JOIN (SELECT entity_id, count(*) AS silent FROM asset s WHERE criticality >= 3 AND NOT EXISTS (SELECT 1 FROM log_source_daily l WHERE l.entity_id = s.entity_id AND l.asset_id = s.asset_id AND event_count > 0) GROUP BY 1) q ON q.entity_id = a.entity_id"),
    "reference_date": query("SELECT max(x) AS reference FROM (SELECT max(created_at) AS x FROM alert UNION ALL SELECT max(closed_at) FROM alert UNION ALL SELECT max(opened_at) FROM soc_case UNION ALL SELECT max(closed_at) FROM soc_case)"),
    "current_version": query(CURRENT.format(9), BATCHES),
    "as_of_snapshot": query(CURRENT.format(2), BATCHES),
    "entity_merge_latest_nonnull": query("SELECT entity_id, sector, CASE WHEN size_band = 'small' THEN size_band ELSE upper(size_band) END AS size_band FROM entity"),
    "apply_window": query("SELECT entity_id, alert_id, CASE WHEN NOT late THEN closed_at END AS closed_at, CASE WHEN late THEN 'open' ELSE status END AS status, CASE WHEN acknowledged_at < TIMESTAMP '2026-04-01' THEN acknowledged_at END AS acknowledged_at, late AS was_masked FROM (SELECT *, coalesce(closed_at >= TIMESTAMP '2026-04-01', false) AS late FROM alert WHERE created_at >= TIMESTAMP '2026-01-01' AND created_at < TIMESTAMP '2026-04-01')"),
    "table_status": query("SELECT e.entity_id, t AS \"table\", CASE WHEN h.entity_id IS NULL THEN 'omitted' ELSE 'present' END AS state FROM entity e CROSS JOIN (SELECT unnest([" + ", ".join(f"'{n}'" for n in NAMES) + "]) AS t) g LEFT JOIN (" + " UNION ".join(f"SELECT entity_id, '{n}' AS tab FROM {n}" for n in NAMES) + ") h ON h.entity_id = e.entity_id AND tab = t"),
    "redact_text": "SELECT conv_id, turn, " + REDACTED + " AS masked FROM (SELECT conv_id, turn, CASE WHEN n % 3 = 0 THEN coalesce(text, '') ELSE concat_ws(' ', text, concat_ws('.', 10, n % 256, 7, n % 199), 'host' || n || '.example.org', 'x12345678 ' || (10000000 + n), 'mail' || n || '@example.com') END AS x FROM (SELECT *, conv_id * 31 + turn AS n FROM conversations))",
    "data_fingerprint": query(" UNION ALL ".join(f"SELECT '{n}' AS \"table\", count(*) AS n, CAST(coalesce(sum(CAST('0x' || substr(md5({row}), 1, 15) AS BIGINT)), 0) % 1152921504606846976 AS BIGINT) AS hash FROM {n}" for n, row in ROWS.items())),
    "norm_hash": r"SELECT conv_id, turn, substr(sha256(regexp_replace(trim(lower(coalesce(text, ''))), '\s+', ' ', 'g')), 1, 16) AS hash, length(text) AS n FROM conversations",
    "entity_gate": query("SELECT entity_id, CASE WHEN k % 11 = 0 THEN 'missing' WHEN k % 13 = 0 THEN 'invalid' WHEN k % 17 = 0 THEN 'mismatch' ELSE 'accepted' END AS verdict, count(*) AS n FROM (SELECT entity_id, CAST(substr(alert_id, 2) AS BIGINT) AS k FROM alert) GROUP BY 1, 2"),
    "taxonomy_normalise": "SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'critical' ELSE CASE substr(o_orderpriority, 3) WHEN 'URGENT' THEN 'critical' WHEN 'HIGH' THEN 'high' WHEN 'MEDIUM' THEN 'medium' WHEN 'LOW' THEN 'low' ELSE 'unmapped' END END AS severity, count(*) AS n FROM orders GROUP BY 1",
    "parse_timestamp": "SELECT event_id, CASE event_id % 5 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('second', ts) - INTERVAL 330 MINUTE WHEN 2 THEN date_trunc('second', ts) WHEN 3 THEN date_trunc('milliseconds', ts) END AS at FROM events",
    "dq_issues": query("SELECT * FROM ru", DQ),
    "dq_summary": query('SELECT "check", sum(n)::BIGINT AS n, count(DISTINCT entity_id) AS n_entities FROM ru GROUP BY 1', DQ),
}
