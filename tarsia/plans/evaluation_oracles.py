"""SQL (DuckDB) for evaluations."""

from __future__ import annotations

from tarsia.plans.assessment_oracles import FOUND, QUEUE, RISK
from tarsia.plans.oracles import query

# The planted defects, as the projections make them.
TRUTH = """tr AS (SELECT unnest(string_split(es, ' ')) AS entity_id, rule_id FROM (VALUES ('EG01', 'E04'), ('EG02', 'E05'), ('EG03', 'E14'), ('EG04', 'E16'), ('EG05', 'E00 E05 E10 E15 E20'), ('EG06', 'E06 E08'), ('EG07', 'E06 E08'), ('EG08', 'E15'), ('EG09', 'E01'), ('EG10', 'E22'),
 ('EG11', 'E20'), ('EG12', 'E13'), ('NS01', 'E17'), ('NS02', 'E03'), ('NS03', 'E12'), ('NS04', 'E10'), ('NS05', 'E19'), ('NS06', 'E02 E08 E14'), ('NS07', 'E21'), ('NS08', 'E09')) v(rule_id, es))"""
POSITIVE = "ps AS (SELECT DISTINCT entity_id FROM tr)"
WILSON = "CASE WHEN n > 0 THEN round_even(greatest(0, (p + 3.8416::DOUBLE / (2 * n)) / (1 + 3.8416::DOUBLE / n) - h), 4) END AS low, CASE WHEN n > 0 THEN round_even(least(1, (p + 3.8416::DOUBLE / (2 * n)) / (1 + 3.8416::DOUBLE / n) + h), 4) END AS high"
HALF = "1.96::DOUBLE * sqrt(p * (1 - p) / n + 3.8416::DOUBLE / (4.0::DOUBLE * n * n)) / (1 + 3.8416::DOUBLE / n) AS h"
STATUS = "CASE CAST('0x' || substr(md5(record_id), 1, 8) AS BIGINT) % 5 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'dismissed' WHEN 4 THEN 'open' ELSE 'in_review' END"
HITS = """hc AS (SELECT entity_id, rule_id, count(*) AS hits FROM (
 SELECT entity_id, 'EG03' AS rule_id FROM alert a WHERE severity_final = 'critical' AND disposition = 'true_positive' AND NOT EXISTS (SELECT 1 FROM escalation e WHERE e.entity_id = a.entity_id AND e.ref_id = a.alert_id)
 UNION ALL SELECT entity_id, 'EG08' FROM escalation WHERE acknowledged_at IS NULL
 UNION ALL SELECT entity_id, 'EG12' FROM soc_case c WHERE severity = 'critical' AND NOT EXISTS (SELECT 1 FROM workflow_event w WHERE w.entity_id = c.entity_id AND w.ref_id = c.case_id AND ref_type = 'case' AND action = 'contain')
 UNION ALL SELECT entity_id, 'NS04' FROM alert a WHERE severity_final IN ('high', 'critical') AND disposition = 'true_positive' AND NOT EXISTS (SELECT 1 FROM case_alert_link l WHERE l.entity_id = a.entity_id AND l.alert_id = a.alert_id)
 UNION ALL SELECT entity_id, 'NS07' FROM soc_case c WHERE severity = 'critical' AND NOT EXISTS (SELECT 1 FROM external_report r WHERE r.entity_id = c.entity_id AND r.incident_id = c.case_id)) GROUP BY 1, 2)"""
LEAST = "CASE rule_id WHEN 'EG03' THEN 1 WHEN 'EG08' THEN 3 WHEN 'EG12' THEN 2 WHEN 'NS04' THEN 3 ELSE 1 END"

ORACLES = {
    "entity_ranking_at_k": query("SELECT k, hits, hits / k::DOUBLE AS precision, hits / k::DOUBLE AS recall FROM (SELECT (SELECT count(*) FROM ps) AS k, CAST(count(*) AS BIGINT) AS hits FROM (SELECT entity_id FROM r ORDER BY risk_index DESC, entity_id LIMIT (SELECT count(*) FROM ps)) WHERE entity_id IN (SELECT entity_id FROM ps))", RISK, TRUTH, POSITIVE),
    "precision_at_k_ties": query("SELECT k, round_even(sum(greatest(0, least(n, k - b)) * hits / n::DOUBLE), 6) AS expected_hits FROM (SELECT s.*, (SELECT count(*) FROM ps) AS k, (SELECT coalesce(sum(n), 0) FROM st x WHERE x.step > s.step) AS b FROM st s) GROUP BY k", RISK, TRUTH, POSITIVE,
        "st AS (SELECT floor(risk_index / 10) AS step, count(*) AS n, count(*) FILTER (entity_id IN (SELECT entity_id FROM ps)) AS hits FROM r GROUP BY 1)"),
    "review_lift": query("SELECT CAST(depth AS INT) AS depth, round_even(avg(hit), 6) AS rate, round_even(any_value(prevalence), 6) AS prevalence, round_even(avg(hit) / any_value(prevalence), 4) AS lift FROM hd, (SELECT unnest([10, 25, 50, 100]) AS depth), (SELECT avg(CAST(severity_final IN ('high', 'critical') AS INT)) AS prevalence FROM alert) WHERE place <= depth GROUP BY 1", QUEUE,
        "hd AS (SELECT CAST(severity_final IN ('high', 'critical') AS INT) AS hit, row_number() OVER (ORDER BY priority DESC, q.entity_id, record_id) AS place FROM q JOIN alert a ON a.entity_id = q.entity_id AND a.alert_id = q.record_id)"),
    "shadow_pilot": query(f"SELECT rule_id, tp, fp, fn, {WILSON} FROM (SELECT *, {HALF} FROM (SELECT *, tp + fp AS n, tp / nullif(tp + fp, 0)::DOUBLE AS p FROM (SELECT rule_id, count(*) FILTER (f AND p) AS tp, count(*) FILTER (f AND NOT p) AS fp, count(*) FILTER (NOT f) AS fn FROM (SELECT entity_id, rule_id, bool_or(src = 1) AS f, bool_or(src = 2) AS p FROM (SELECT entity_id, rule_id, 1 AS src FROM f UNION ALL SELECT entity_id, rule_id, 2 FROM tr) GROUP BY 1, 2) GROUP BY 1)))", FOUND, TRUTH),
    "naive_baselines": query("""SELECT entity_id, 'fast_closure' AS baseline FROM alert WHERE closed_by_type = 'human' AND severity_final IN ('high', 'critical') AND closed_at IS NOT NULL GROUP BY 1 HAVING avg(CASE WHEN epoch_us(closed_at) - epoch_us(created_at) BETWEEN 0 AND 600000000 THEN 1.0::DOUBLE ELSE 0 END) > 0.1
 UNION ALL SELECT a.entity_id, 'short_comment' FROM alert a JOIN closure c ON c.entity_id = a.entity_id AND c.ref_id = a.alert_id WHERE closed_by_type = 'human' GROUP BY 1 HAVING avg(CASE WHEN coalesce(comment_len, 0) < 25 THEN 1.0::DOUBLE ELSE 0 END) > 0.1
 UNION ALL SELECT DISTINCT entity_id, 'no_escalation' FROM alert a WHERE severity_final = 'critical' AND NOT EXISTS (SELECT 1 FROM escalation e WHERE e.entity_id = a.entity_id AND e.ref_id = a.alert_id)"""),
    "family_ablation": query("SELECT e.entity_id, coalesce(a, 0) AS whole, coalesce(b, 0) AS without_eg, coalesce(c, 0) AS without_ns FROM entity e LEFT JOIN (SELECT entity_id, round_even(100.0::DOUBLE * (1 - product(1 - score / 100.0::DOUBLE)), 4) AS a, round_even(100.0::DOUBLE * (1 - coalesce(product(1 - score / 100.0::DOUBLE) FILTER (rule_id LIKE 'NS%'), 1)), 4) AS b, round_even(100.0::DOUBLE * (1 - coalesce(product(1 - score / 100.0::DOUBLE) FILTER (rule_id LIKE 'EG%'), 1)), 4) AS c FROM f GROUP BY 1) x ON x.entity_id = e.entity_id", FOUND),
    "confounder_findings": query("SELECT unnest(['speed_rules', 'small_entity', 'all']) AS confounder, unnest([count(*) FILTER (rule_id IN ('EG01', 'EG02')), count(*) FILTER (size_band = 'small'), count(*)]) AS n FROM f JOIN entity USING (entity_id) WHERE NOT EXISTS (SELECT 1 FROM tr WHERE tr.entity_id = f.entity_id AND tr.rule_id = f.rule_id)", FOUND, TRUTH),
    "threshold_sensitivity": query(f"SELECT rule_id, move, count(*) FILTER (f AND p) AS tp, count(*) FILTER (f AND NOT p) AS fp, count(*) FILTER (NOT f) AS fn FROM (SELECT entity_id, rule_id, move, bool_or(src = 1) AS f, bool_or(src = 2) AS p FROM (SELECT entity_id, rule_id, move, 1 AS src FROM hc, mv WHERE hits >= greatest(1, {LEAST} + move) UNION ALL SELECT entity_id, rule_id, move, 2 FROM tr, mv WHERE rule_id IN ('EG03', 'EG08', 'EG12', 'NS04', 'NS07')) GROUP BY 1, 2, 3) GROUP BY 1, 2", HITS, TRUTH, "mv AS (SELECT unnest([-1, 0, 1]) AS move)"),
}
