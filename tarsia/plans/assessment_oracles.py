"""SQL (DuckDB) for runs beside each other and joined views; scores, findings and queue are subqueries of their own."""

from __future__ import annotations

from tarsia.plans.catalog_oracles import ORACLES as CATALOG
from tarsia.plans.more_oracles import ORACLES as MORE
from tarsia.plans.oracles import PEERS, query

N = "CAST(substr(entity_id, 2, 2) AS INT)"
FOUND = f"f AS MATERIALIZED (SELECT * FROM ({MORE['findings']}))"
LATER = f"{FOUND}, g AS (SELECT * REPLACE (CASE WHEN {N} % 3 = 0 THEN round_even(score * 0.9::DOUBLE, 1) ELSE score END AS score) FROM f WHERE {N} % 4 <> 1)"
RISK = f"r AS MATERIALIZED (SELECT * FROM ({MORE['entity_risk_index']}))"
DOMAINS = f"ds AS MATERIALIZED (SELECT * FROM ({MORE['domain_scores']}))"
COVER = f"cv AS MATERIALIZED (SELECT * FROM ({CATALOG['coverage_classification']}))"
QUEUE = f"q AS MATERIALIZED (SELECT * FROM ({MORE['review_queue']}))"
EXCEPTIONS = f"x AS (SELECT entity_id, rule_id, CASE WHEN {N} % 4 = 0 THEN DATE '2026-12-31' ELSE DATE '2026-03-31' END AS until FROM f WHERE {N} % 2 = 0)"
MEDIANS = "pm AS (SELECT p.entity_id, d.domain, count(d.score) AS n_peers, median(d.score) AS m FROM peers p JOIN ds d ON d.entity_id = p.peer_id GROUP BY 1, 2)"
TIER = "CASE WHEN band IS NULL THEN 'insufficient' WHEN band IN ('critical', 'high') THEN 'critical' WHEN band = 'moderate' THEN 'moderate' ELSE 'low' END"
LEAGUE = f"lg AS (SELECT e.entity_id, e.name, e.sector, e.size_band, r.risk_index, r.band, r.n_rules, cv.coverage, cv.level, {TIER} AS tier FROM entity e LEFT JOIN r ON r.entity_id = e.entity_id LEFT JOIN cv ON cv.entity_id = e.entity_id)"
EACH = "each AS (SELECT entity_id, rule_id, severity, score, unnest(string_split(evidence, ',')) AS id FROM f)"

ORACLES = {
    "run_compare": query("SELECT coalesce(f.entity_id, g.entity_id) AS entity_id, coalesce(f.rule_id, g.rule_id) AS rule_id, f.score AS before, g.score AS after, CASE WHEN f.entity_id IS NULL THEN 'added' WHEN g.entity_id IS NULL THEN 'removed' WHEN f.score = g.score THEN 'same' ELSE 'changed' END AS change FROM f FULL JOIN g ON f.entity_id = g.entity_id AND f.rule_id = g.rule_id", LATER),
    "remediation_evidence": query(f"SELECT entity_id, rule_id, CASE WHEN {N} % 4 = 1 THEN 'remedied' ELSE 'still_found' END AS outcome, CAST(CASE WHEN {N} % 4 = 1 THEN 0 ELSE count(DISTINCT id) END AS INT) AS kept, CAST(CASE WHEN {N} % 4 = 1 THEN count(*) ELSE count(*) - count(DISTINCT id) END AS INT) AS gone FROM each GROUP BY 1, 2", FOUND, EACH),
    "apply_exception": query("SELECT entity_id, rule_id, severity, score, severity <> 'critical' AND EXISTS (SELECT 1 FROM x WHERE x.entity_id = f.entity_id AND x.rule_id = f.rule_id AND until >= DATE '2026-07-01') AS excepted FROM f", FOUND, EXCEPTIONS),
    "decisions_in_force": query("SELECT day, count(*) AS n, count(DISTINCT entity_id) AS entities FROM x, (SELECT make_date(2026, m, 1) AS day FROM range(1, 13) v(m)) WHERE until >= day GROUP BY 1", FOUND, EXCEPTIONS),
    "peer_median_domain_scores": query("SELECT d.entity_id, d.domain, d.score, coalesce(n_peers, 0) AS n_peers, CASE WHEN n_peers >= 3 THEN m END AS peer_median FROM ds d LEFT JOIN pm USING (entity_id, domain)", PEERS, DOMAINS, MEDIANS),
    "entity_league": query("SELECT * FROM lg", RISK, COVER, LEAGUE),
    "league_filter_sort": query("SELECT entity_id, name, tier, coverage, risk_index FROM lg WHERE tier = 'low' AND contains(lower(name), 'a')", RISK, COVER, LEAGUE),
    "entity_profile": query(
        "SELECT r.entity_id, risk_index, band, domain, above, gap, coalesce(findings, 0) AS findings, top_rule, n_peers, strength FROM r LEFT JOIN (SELECT entity_id, arg_max(domain, (above, domain)) AS domain, max(above) AS above FROM (SELECT ds.entity_id, ds.domain, ds.score - m AS above FROM ds JOIN pm USING (entity_id, domain) WHERE n_peers >= 3) WHERE above > 0 GROUP BY 1) a USING (entity_id)"
        f" LEFT JOIN (SELECT entity_id, max(gap) AS gap FROM ({MORE['kpi_reconciliation']}) GROUP BY 1) k USING (entity_id) LEFT JOIN (SELECT entity_id, count(*) AS findings, arg_max(rule_id, (score, rule_id)) AS top_rule FROM f GROUP BY 1) t USING (entity_id) LEFT JOIN (SELECT entity_id, n_peers, strength FROM ({MORE['peer_cohorts']})) c USING (entity_id)",
        PEERS, DOMAINS, MEDIANS, RISK, FOUND),
    "attention": query(
        "SELECT entity_id, reason, CASE reason WHEN 'finding' THEN rule_id WHEN 'open_case' THEN case_id END AS subject FROM (SELECT e.entity_id, rule_id, case_id, CASE WHEN score >= 50 THEN 'finding' WHEN case_id IS NOT NULL THEN 'open_case' WHEN level <> 'assessable' THEN 'missing_inputs' ELSE 'none' END AS reason FROM entity e LEFT JOIN (SELECT entity_id, arg_max(rule_id, (score, rule_id)) AS rule_id, max(score) AS score FROM f GROUP BY 1) t ON t.entity_id = e.entity_id LEFT JOIN (SELECT entity_id, min(case_id) AS case_id FROM soc_case WHERE closed_at IS NULL GROUP BY 1) c ON c.entity_id = e.entity_id LEFT JOIN cv ON cv.entity_id = e.entity_id)",
        FOUND, COVER),
    "blind_concordance": query(f"SELECT entity_id, concern, band, greatest(0, 100.0::DOUBLE - 25.0::DOUBLE * abs(CASE concern WHEN 'low' THEN 1 WHEN 'moderate' THEN 2 WHEN 'critical' THEN 4 ELSE 3 END - CASE band WHEN 'low' THEN 1 WHEN 'moderate' THEN 2 WHEN 'high' THEN 3 ELSE 4 END)) AS agreement FROM (SELECT *, ['low', 'moderate', 'elevated', 'high', 'critical'][{N} % 5 + 1] AS concern FROM r)", RISK),
    "queue_evidence_cards": query("SELECT q.entity_id, q.record_id, q.priority, e.rule_id, e.severity FROM q JOIN each e ON e.entity_id = q.entity_id AND e.id = q.record_id WHERE arm = 'targeted'", QUEUE, FOUND, EACH),
    "finding_cards": query("SELECT entity_id, rule_id, any_value(severity) AS severity, any_value(score) AS score, CAST(count(*) AS INT) AS n_evidence, min(id) AS first, max(id) AS last, CAST(row_number() OVER (PARTITION BY entity_id ORDER BY any_value(score) DESC, rule_id) AS INT) AS rank FROM each GROUP BY entity_id, rule_id", FOUND, EACH),
    "blind_sample_draw": query(
        "SELECT entity_id, arm, CAST(row_number() OVER (ORDER BY h) AS INT) AS place FROM (SELECT * FROM tp UNION ALL SELECT * FROM lw UNION ALL (SELECT entity_id, risk_index, h, 'random' AS arm FROM rh WHERE entity_id NOT IN (SELECT entity_id FROM tp) AND entity_id NOT IN (SELECT entity_id FROM lw) ORDER BY h LIMIT 2))",
        RISK, "rh AS (SELECT entity_id, risk_index, sha256('42:' || entity_id) AS h FROM r)", "tp AS (SELECT *, 'flagged' AS arm FROM rh ORDER BY risk_index DESC, entity_id LIMIT 3)", "lw AS (SELECT *, 'control' AS arm FROM rh WHERE entity_id NOT IN (SELECT entity_id FROM tp) ORDER BY risk_index, h LIMIT 2)"),
    "trend_series": query(
        "SELECT entity_id, run, total, before, coalesce(before > 0 AND total <= 0.9::DOUBLE * before, false) AS warning FROM (SELECT *, lag(total) OVER (PARTITION BY entity_id ORDER BY run) AS before FROM (SELECT e.entity_id, v.run, coalesce(total, 0) AS total FROM entity e CROSS JOIN (SELECT unnest([1, 2]) AS run) v LEFT JOIN (SELECT entity_id, 1 AS run, round_even(sum(score), 1) AS total FROM f GROUP BY 1 UNION ALL SELECT entity_id, 2, round_even(sum(score), 1) FROM g GROUP BY 1) s ON s.entity_id = e.entity_id AND s.run = v.run))", LATER),
    "queue_carry_decisions": query("SELECT entity_id, record_id, priority, arm, CASE k WHEN 0 THEN 'confirmed' WHEN 1 THEN 'dismissed' WHEN 4 THEN 'open' ELSE 'in_review' END AS status FROM (SELECT *, CAST('0x' || substr(md5(record_id), 1, 8) AS BIGINT) % 5 AS k FROM q)", QUEUE),
    "queue_list": query("SELECT entity_id, record_id, priority, arm, (SELECT count(*) FROM o) AS total, (SELECT count(*) FROM o WHERE arm = 'random') AS random FROM o ORDER BY priority DESC, entity_id, record_id LIMIT 50", QUEUE, "o AS (SELECT * FROM q WHERE CAST('0x' || substr(md5(record_id), 1, 8) AS BIGINT) % 5 = 4)"),
}
