"""SQL (DuckDB) for the catalogue, mappings, shingles, rule states and outliers."""

from __future__ import annotations

from tarsia.plans.contract_oracles import COVERAGE, RESULTS, F
from tarsia.plans.oracles import PEERS, query

SUB = """sub AS (SELECT entity_id, tab, seq AS pub_seq, CASE n % 5 WHEN 0 THEN 'rejected' WHEN 1 THEN 'declared_empty' ELSE 'rows' END AS completeness, CASE WHEN seq <> 6 THEN m END AS since, CASE WHEN seq <> 6 THEN CAST(m + INTERVAL 1 MONTH AS DATE) END AS until
 FROM (SELECT entity_id, tab, CAST(date_trunc('month', began) AS DATE) AS m, CAST(month(began) AS INT) AS seq, count(*) AS n FROM (SELECT entity_id, 'alert' AS tab, created_at AS began FROM alert UNION ALL SELECT entity_id, 'soc_case', opened_at FROM soc_case) GROUP BY ALL))"""
MAPPED = """mp AS (SELECT *, CASE WHEN o_orderstatus = 'P' THEN 'filtered' WHEN o_orderkey % 29 = 0 THEN 'rejected' WHEN sev IS NULL THEN 'rejected' ELSE 'stored' END AS outcome
 FROM (SELECT *, CASE substr(o_orderpriority, 3) WHEN 'URGENT' THEN 'critical' WHEN 'HIGH' THEN 'high' WHEN 'MEDIUM' THEN 'medium' WHEN 'LOW' THEN 'low' ELSE 'unmapped' END AS sev, CASE WHEN o_orderkey % 2 = 0 THEN 'c' || CAST(o_orderkey % 7 AS VARCHAR) ELSE 'nobody' END AS owner FROM orders))"""
OUTLIERS = """mt AS (SELECT entity_id, metric, v FROM (UNPIVOT (SELECT entity_id, count(*) AS n, log10(count(*) + 1) AS log_alerts, avg(CAST(disposition = 'false_positive' AS INT)) AS fp_share, avg(CAST(disposition = 'benign' AS INT)) AS benign_share, count(*) FILTER (closed_by_type = 'automation') / count(*)::DOUBLE AS auto_share, avg(CAST(status = 'open' AS INT)) AS open_share, avg(CAST(severity_final = 'critical' AS INT)) AS critical_share, avg(CAST(acknowledged_at IS NULL AS INT)) AS unacked_share FROM alert GROUP BY 1) ON COLUMNS(* EXCLUDE (entity_id, n)) INTO NAME metric VALUE v) WHERE n >= 30),
nr AS (SELECT p.entity_id, metric, v FROM peers p JOIN mt ON mt.entity_id = p.peer_id),
md AS (SELECT entity_id, metric, median(v) AS med, count(*) AS n_peers FROM nr GROUP BY 1, 2),
ma AS (SELECT entity_id, metric, any_value(med) AS med, any_value(n_peers) AS n_peers, median(abs(v - med)) AS mad FROM nr JOIN md USING (entity_id, metric) GROUP BY 1, 2),
po AS (SELECT entity_id, metric, round_even(v, 6) AS value, round_even(med, 6) AS baseline, n_peers, round_even((v - med) / greatest(1.4826::DOUBLE * mad, CASE WHEN metric = 'log_alerts' THEN 0.1::DOUBLE ELSE 0.02::DOUBLE END), 4) AS z FROM mt JOIN ma USING (entity_id, metric) WHERE n_peers >= 3),
ot AS (SELECT * FROM po WHERE abs(z) >= 3.5)"""
SHINGLES = r"""WITH w AS (SELECT conv_id, turn, text, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}_]+'), lambda x: length(x) > 2) AS w FROM conversations),
s AS (SELECT conv_id, turn, text, (CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, '_')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || '_' || w[i + 1] || '_' || w[i + 2]) END) AS s FROM w),
p AS (SELECT *, lag(s) OVER (PARTITION BY conv_id ORDER BY turn, text NULLS FIRST) AS p FROM s)"""

ORACLES = {
    "submitted_tables": query("SELECT entity_id, tab, arg_max(completeness, pub_seq + CASE completeness WHEN 'rows' THEN 100 ELSE 0 END) AS completeness FROM sub GROUP BY 1, 2", SUB),
    "tables_for_period": query("SELECT entity_id, tab, count(*) AS n_batches FROM sub WHERE since IS NULL OR NOT (until <= DATE '2026-02-15' OR since >= DATE '2026-04-01') GROUP BY 1, 2", SUB),
    "table_status_in_window": query(
        "SELECT entity_id, tab AS \"table\", CASE WHEN EXISTS (SELECT 1 FROM rw WHERE rw.entity_id = g.entity_id AND rw.tab = g.tab) THEN 'present' WHEN NOT EXISTS (SELECT 1 FROM sub WHERE sub.entity_id = g.entity_id AND sub.tab = g.tab) THEN 'omitted' WHEN said = 'rejected' THEN 'rejected' WHEN said = 'declared_empty' OR EXISTS (SELECT 1 FROM sub WHERE sub.entity_id = g.entity_id AND sub.tab = g.tab AND (since IS NULL OR NOT (until <= DATE '2026-04-01' OR since >= DATE '2026-05-01'))) THEN 'declared_empty' ELSE 'stale' END AS state FROM g",
        SUB, "rw AS (SELECT entity_id, 'alert' AS tab FROM alert WHERE created_at >= TIMESTAMP '2026-04-01' AND created_at < TIMESTAMP '2026-05-01' UNION SELECT entity_id, 'soc_case' FROM soc_case WHERE opened_at >= TIMESTAMP '2026-04-01' AND opened_at < TIMESTAMP '2026-05-01')",
        "sd AS (SELECT entity_id, tab, arg_max(completeness, pub_seq + CASE completeness WHEN 'rows' THEN 100 ELSE 0 END) AS said FROM sub GROUP BY 1, 2)",
        "g AS (SELECT e.entity_id, t.tab, said FROM entity e CROSS JOIN (SELECT unnest(['alert', 'soc_case', 'asset']) AS tab) t LEFT JOIN sd ON sd.entity_id = e.entity_id AND sd.tab = t.tab)"),
    "overlapping_batches": query("SELECT a.entity_id, a.tab AS tab_a, a.pub_seq AS seq_a, b.tab AS tab_b, b.pub_seq AS seq_b FROM sub a JOIN sub b ON a.entity_id = b.entity_id AND (a.tab < b.tab OR a.tab = b.tab AND a.pub_seq < b.pub_seq) AND a.since < b.until AND b.since < a.until", SUB),
    "content_hash": query("SELECT entity_id, count(*) AS n, CAST(sum(CAST('0x' || substr(md5(concat_ws('|', alert_id, rule_id, severity_final, status)), 1, 15) AS BIGINT)) % 1152921504606846976 AS BIGINT) AS content_hash FROM alert GROUP BY 1"),
    "auto_register_entity": query("SELECT entity_id, sector, size_band, 'register' AS origin FROM entity WHERE CAST(substr(entity_id, 2) AS INT) % 5 <> 0 UNION ALL SELECT DISTINCT entity_id, 'unknown', 'unknown', 'data' FROM alert WHERE CAST(substr(entity_id, 2) AS INT) % 5 = 0"),
    "cumulative_windows": query("SELECT entity_id, CAST(i AS INT) AS cut, count(*) FILTER (t) AS alerts, count(*) FILTER (t AND severity_final IN ('high', 'critical')) AS serious, count(*) FILTER (t AND status = 'open') AS open FROM (SELECT a.*, i, 4 * (epoch_us(created_at) - lo) <= (hi - lo) * i AS t FROM alert a, (SELECT min(epoch_us(created_at)) AS lo, max(epoch_us(created_at)) AS hi FROM alert) s, (SELECT unnest(range(1, 5)) AS i) c) GROUP BY 1, 2"),
    "source_mapping": query("SELECT 'A' || CAST(o_orderkey AS VARCHAR) AS alert_id, sev AS severity, owner, o_orderstatus = 'F' AS closed, 'orders' AS origin FROM mp WHERE outcome = 'stored'", MAPPED),
    "mapping_coverage": query("SELECT *, CASE WHEN rejected = 0 THEN 'none' WHEN rejected * 2 >= n_read THEN 'error' ELSE 'warning' END AS level FROM (SELECT o_orderpriority AS file, count(*) AS n_read, count(*) FILTER (outcome = 'filtered') AS filtered, count(*) FILTER (outcome = 'rejected') AS rejected, count(*) FILTER (outcome = 'stored') AS stored, count(*) FILTER (outcome = 'stored' AND owner <> 'nobody') AS owned FROM mp GROUP BY 1)", MAPPED),
    "parse_values": "SELECT c_custkey, CASE WHEN c_custkey % 3 <> 2 THEN round(c_acctbal::DOUBLE, 2) END AS number, CASE c_custkey % 4 WHEN 0 THEN true WHEN 1 THEN false END AS flag FROM customer",
    "word_shingles": SHINGLES + " SELECT conv_id, turn, CAST(len(s) AS INT) AS n_shingles, array_to_string(list_transform(s[1:10], lambda x: substr(sha256(x), 1, 12)), ',') AS head, round_even(CASE WHEN p IS NULL THEN NULL WHEN len(s) = 0 AND len(p) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(s, p)) / (list_unique(s) + list_unique(p) - len(list_intersect(s, p)))::DOUBLE END, 6) AS similarity FROM p",
    "rule_result_state": query("SELECT entity_id, rule_id, state FROM rr", F, RESULTS),
    "coverage_classification": query("SELECT entity_id, assessed, applicable, coverage, level FROM co", F, RESULTS, COVERAGE),
    "peer_outliers": query("SELECT * FROM ot", PEERS, OUTLIERS),
    "anomaly_scan": query("SELECT entity_id, CAST(rank AS INT) AS rank, metric, z, suppressed FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY abs(z) DESC, metric) AS rank, greatest(0, count(*) OVER (PARTITION BY entity_id) - 10) AS suppressed FROM ot) WHERE rank <= 10", PEERS, OUTLIERS),
    "seeded_entity_split": query("SELECT entity_id, CASE WHEN row_number() OVER (ORDER BY sha256('42:' || entity_id)) <= (SELECT round_even(0.4::DOUBLE * count(*), 0) FROM entity) THEN 'calibration' ELSE 'holdout' END AS part FROM entity"),
}
