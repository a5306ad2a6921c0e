"""SQL (DuckDB) for the statistics."""

from __future__ import annotations

from tarsia.plans.contract_oracles import RESULTS, F
from tarsia.plans.more_oracles import MONTHS
from tarsia.plans.oracles import PEERS, query

RATES = "rates AS (SELECT entity_id, count(*) AS n, count(*) FILTER (disposition = 'false_positive') / count(*)::DOUBLE AS rate FROM alert GROUP BY 1)"
LEVEL = "list_position(['low', 'medium', 'high', 'critical'], {0}) - 1"

def systemic(provider: str, least: int) -> str:
    return query(
        "SELECT met.provider, met.rule_id, affected, assessable, clients, successes - affected AS others_affected, pop - assessable AS others_assessable, round_even(p, 6) AS p, round_even((SELECT min(least(1, b.p * b.m / b.r)) FROM pv b WHERE b.r >= pv.r), 6) AS q,"
        f" CASE WHEN affected < {least} THEN 'not_tested' WHEN (SELECT min(least(1, b.p * b.m / b.r)) FROM pv b WHERE b.r >= pv.r) <= 0.2 THEN 'notable' ELSE 'weak' END AS level, ['low', 'medium', 'high', 'critical'][rank] AS severity FROM met LEFT JOIN pv ON pv.provider = met.provider AND pv.rule_id = met.rule_id", F, RESULTS,
        f"cl AS (SELECT entity_id, {provider} AS provider FROM entity)", "po AS (SELECT cl.entity_id, provider, rule_id, EXISTS (SELECT 1 FROM f WHERE f.entity_id = rr.entity_id AND f.rule_id = rr.rule_id) AS hit FROM rr JOIN cl USING (entity_id) WHERE state IN ('finding', 'assessed_clear') OR EXISTS (SELECT 1 FROM f WHERE f.entity_id = rr.entity_id AND f.rule_id = rr.rule_id))",
        "met AS (SELECT *, (SELECT count(*) FROM po x WHERE x.rule_id = po.rule_id AND x.hit) AS successes, (SELECT count(*) FROM po x WHERE x.rule_id = po.rule_id) AS pop, (SELECT count(*) FROM cl WHERE cl.provider = po.provider) AS clients, (SELECT max(CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) FROM f WHERE f.rule_id = po.rule_id) AS rank FROM (SELECT provider, rule_id, count(*) FILTER (hit) AS affected, count(*) AS assessable FROM po WHERE provider <> 'internal' GROUP BY 1, 2) po WHERE affected > 0)",
        "lf AS (SELECT i, sum(ln(greatest(i, 1))) OVER (ORDER BY i) AS v FROM range(0, 1000) x(i))",
        f"pr AS (SELECT provider, rule_id, least(1, sum(exp(a.v - b.v - c.v + d.v - e.v - g.v - h.v + j.v + l.v))) AS p FROM met, range(0, 1000) x(k), lf a, lf b, lf c, lf d, lf e, lf g, lf h, lf j, lf l WHERE affected >= {least} AND k >= affected AND k <= least(assessable, successes) AND assessable - k <= pop - successes AND a.i = successes AND b.i = k AND c.i = successes - k AND d.i = pop - successes AND e.i = assessable - k AND g.i = pop - successes - assessable + k AND h.i = pop AND j.i = assessable AND l.i = pop - assessable GROUP BY 1, 2)",
        "pv AS (SELECT *, row_number() OVER (ORDER BY p) AS r, count(*) OVER () AS m FROM pr)")


ORACLES = {
    "time_shifts": query(
        "SELECT se.entity_id, se.metric, any_value(points) AS points, round_even(any_value(peak_up), 4) AS peak_up, round_even(any_value(peak_down), 4) AS peak_down, max(month) FILTER (i = first_i) AS alarm_month, max(month) FILTER (i = start_i) AS shift_from, round_even(any_value(bm), 6) AS before, round_even(median(v) FILTER (i >= start_i), 6) AS after FROM se JOIN b1 USING (entity_id, metric) JOIN sx USING (entity_id, metric) GROUP BY 1, 2", MONTHS,
        "un AS (SELECT entity_id, month, 'per_day' AS metric, per_day AS v, log10(per_day + 1) AS x, 0.1::DOUBLE AS floor_ FROM ms UNION ALL SELECT entity_id, month, 'tp_share', tp_share, tp_share, 0.02 FROM ms WHERE tp_share IS NOT NULL UNION ALL SELECT entity_id, month, 'auto_share', auto_share, auto_share, 0.02 FROM ms WHERE auto_share IS NOT NULL)",
        "se AS (SELECT *, row_number() OVER (PARTITION BY entity_id, metric ORDER BY month) AS i, count(*) OVER (PARTITION BY entity_id, metric) AS points FROM un QUALIFY points >= 5)",
        "b1 AS (SELECT entity_id, metric, median(x) FILTER (i <= 3) AS med, median(v) FILTER (i <= 3) AS bm FROM se GROUP BY 1, 2)",
        "b2 AS (SELECT entity_id, metric, any_value(med) AS med, median(abs(x - med)) FILTER (i <= 3) AS mad FROM se JOIN b1 USING (entity_id, metric) GROUP BY 1, 2)",
        "zz AS (SELECT se.entity_id, se.metric, i, (x - med) / greatest(1.4826::DOUBLE * mad, floor_) AS z FROM se JOIN b2 USING (entity_id, metric) WHERE i > 3)",
        "cs AS (SELECT *, sum(z - 0.5::DOUBLE) OVER w AS u, sum(-z - 0.5::DOUBLE) OVER w AS d FROM zz WINDOW w AS (PARTITION BY entity_id, metric ORDER BY i))",
        "ch AS (SELECT entity_id, metric, i, u - least(0, min(u) OVER w) AS up, d - least(0, min(d) OVER w) AS down FROM cs WINDOW w AS (PARTITION BY entity_id, metric ORDER BY i))",
        "fi AS (SELECT entity_id, metric, min(i) FILTER (up > 4 OR down > 4) AS first_i, max(up) AS peak_up, max(down) AS peak_down FROM ch GROUP BY 1, 2)",
        "sx AS (SELECT fi.entity_id, fi.metric, first_i, peak_up, peak_down, CASE WHEN first_i IS NOT NULL THEN coalesce((SELECT max(i) FROM ch c WHERE c.entity_id = fi.entity_id AND c.metric = fi.metric AND c.i < first_i AND CASE WHEN (SELECT up > 4 FROM ch y WHERE y.entity_id = fi.entity_id AND y.metric = fi.metric AND y.i = first_i) THEN c.up ELSE c.down END = 0), 3) + 1 END AS start_i FROM fi)"),
    "robust_z_score": query(
        "SELECT entity_id, day, n, round_even(CASE WHEN mad > 0 THEN 0.6745::DOUBLE * o / mad WHEN dev > 0 THEN 0.6745::DOUBLE * o / (1.2533::DOUBLE * dev) WHEN o = 0 THEN 0::DOUBLE ELSE sign(o) * 'inf'::DOUBLE END, 6) AS z FROM o JOIN s USING (entity_id)",
        "d AS (SELECT entity_id, created_at::DATE AS day, count(*) AS n FROM alert WHERE created_at IS NOT NULL GROUP BY 1, 2)",
        "o AS (SELECT d.*, n - (SELECT median(n) FROM d x WHERE x.entity_id = d.entity_id) AS o FROM d)", "s AS (SELECT entity_id, median(abs(o)) AS mad, avg(abs(o)) AS dev FROM o GROUP BY 1)"),
    "iqr_bounds": query(
        "SELECT *, p75 - p25 AS iqr FROM (SELECT entity_id, severity_final, quantile_cont(s, 0.25) AS p25, quantile_cont(s, 0.5) AS p50, quantile_cont(s, 0.75) AS p75 FROM (SELECT *, (epoch_us(acknowledged_at) - epoch_us(created_at)) / 1e6 AS s FROM alert WHERE acknowledged_at IS NOT NULL) GROUP BY 1, 2)"),
    "percentile_rank": query(
        "SELECT r.entity_id, round_even(coalesce(100.0::DOUBLE * (count(*) FILTER (x.rate < r.rate) + 0.5::DOUBLE * count(*) FILTER (x.rate = r.rate)) / nullif(count(x.rate), 0), 50), 6) AS percentile_rank FROM rates r LEFT JOIN peers p ON p.entity_id = r.entity_id LEFT JOIN rates x ON x.entity_id = p.peer_id GROUP BY 1", PEERS, RATES),
    "ewma": query(
        "SELECT entity_id, week, round_even(z, 4) AS z, round_even(med - half, 4) AS lcl, round_even(med + half, 4) AS ucl, z > med + half OR z < med - half AS alarm FROM (SELECT z.*, med, 3.0::DOUBLE * CASE WHEN mad > 0 THEN 1.4826::DOUBLE * mad ELSE 1 END * sqrt(0.2::DOUBLE / 1.8::DOUBLE * (1 - pow(0.8::DOUBLE, 2 * z.i))) AS half FROM z JOIN m USING (entity_id))",
        "w AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY week) AS i, count(*) OVER (PARTITION BY entity_id) AS k FROM (SELECT entity_id, date_trunc('week', created_at)::DATE AS week, count(*)::DOUBLE AS x FROM alert WHERE created_at IS NOT NULL GROUP BY 1, 2))",
        "c AS (SELECT entity_id, median(x) AS med FROM w WHERE i <= 5 AND k >= 5 GROUP BY 1)", "m AS (SELECT entity_id, med, median(abs(x - med)) AS mad FROM w JOIN c USING (entity_id) WHERE i <= 5 GROUP BY 1, 2)",
        "z AS (SELECT a.entity_id, a.week, a.i, pow(0.8::DOUBLE, a.i) * max(med) + sum(0.2::DOUBLE * pow(0.8::DOUBLE, a.i - b.i) * b.x) AS z FROM w a JOIN w b ON a.entity_id = b.entity_id AND b.i <= a.i JOIN m ON m.entity_id = a.entity_id GROUP BY 1, 2, 3)"),
    "wilson_interval": query(
        "SELECT entity_id, severity_final, n, hits, round_even(greatest(0, c - h), 4) AS low, round_even(least(1, c + h), 4) AS high FROM (SELECT *, (p + 1.96::DOUBLE * 1.96::DOUBLE / (2 * n)) / (1 + 1.96::DOUBLE * 1.96::DOUBLE / n) AS c, 1.96::DOUBLE * sqrt(p * (1 - p) / n + 1.96::DOUBLE * 1.96::DOUBLE / (4.0::DOUBLE * n * n)) / (1 + 1.96::DOUBLE * 1.96::DOUBLE / n) AS h FROM (SELECT *, hits / n::DOUBLE AS p FROM (SELECT entity_id, severity_final, count(*) AS n, count(*) FILTER (disposition = 'true_positive') AS hits FROM alert GROUP BY 1, 2)))"),
    "spearman": query(
        "SELECT sector, count(*) AS n, round_even(CASE WHEN count(*) <= 1 THEN 1 ELSE greatest(-1, least(1, 1 - 6 * sum((a - b) * (a - b)) / (count(*) * (count(*) * count(*) - 1)))) END, 6) AS rho FROM rk GROUP BY 1", RATES,
        "v AS (SELECT sector, r.* FROM rates r JOIN entity USING (entity_id))",
        "rk AS (SELECT sector, (SELECT count(*) FILTER (x.n > v.n) + (count(*) FILTER (x.n = v.n) + 1) / 2.0::DOUBLE FROM v x WHERE x.sector = v.sector) AS a, (SELECT count(*) FILTER (x.rate > v.rate) + (count(*) FILTER (x.rate = v.rate) + 1) / 2.0::DOUBLE FROM v x WHERE x.sector = v.sector) AS b FROM v)"),
    "cohens_kappa": query(
        "SELECT entity_id, total, CASE WHEN ep < 1 THEN round_even((op - ep) / (1 - ep), 6) END AS kappa, CASE WHEN el < 1 THEN round_even((ol - el) / (1 - el), 6) END AS weighted FROM ob JOIN ex USING (entity_id)",
        f"lv AS (SELECT entity_id, {LEVEL.format('severity_orig')} AS a, {LEVEL.format('severity_final')} AS b FROM alert)",
        "ob AS (SELECT entity_id, count(*) AS total, avg(CASE WHEN a = b THEN 1.0::DOUBLE ELSE 0 END) AS op, avg(1 - abs(a - b) / 3.0::DOUBLE) AS ol FROM lv GROUP BY 1)",
        "ex AS (SELECT x.entity_id, sum(CASE WHEN a = b THEN x.p * y.p ELSE 0 END) AS ep, sum((1 - abs(a - b) / 3.0::DOUBLE) * x.p * y.p) AS el FROM (SELECT entity_id, a, count(*) / (SELECT total FROM ob WHERE ob.entity_id = lv.entity_id)::DOUBLE AS p FROM lv GROUP BY 1, 2) x JOIN (SELECT entity_id, b, count(*) / (SELECT total FROM ob WHERE ob.entity_id = lv.entity_id)::DOUBLE AS p FROM lv GROUP BY 1, 2) y USING (entity_id) GROUP BY 1)"),
    "cluster_bootstrap": query(
        "SELECT severity_final, round_even(any_value(ak) / any_value(an)::DOUBLE, 4) AS share, round_even(max(rate) FILTER (i = 51), 4) AS low, round_even(max(rate) FILTER (i = 1951), 4) AS high FROM rr JOIN sz USING (severity_final) GROUP BY 1",
        "en AS (SELECT severity_final, entity_id, count(*) AS n, count(*) FILTER (disposition = 'false_positive') AS k, row_number() OVER (PARTITION BY severity_final ORDER BY entity_id) - 1 AS ix FROM alert GROUP BY 1, 2)",
        "sz AS (SELECT severity_final, count(*) AS m, sum(n) AS an, sum(k) AS ak FROM en GROUP BY 1 HAVING count(*) >= 2)",
        "dr AS (SELECT severity_final, r, CAST('0x' || substr(md5('42:' || severity_final || ':' || r || ':' || d), 1, 8) AS BIGINT) % m AS ix FROM sz, range(2000) a(r), range(1000) b(d) WHERE d < m)",
        "rr AS (SELECT *, row_number() OVER (PARTITION BY severity_final ORDER BY rate, r) AS i FROM (SELECT severity_final, r, sum(k) / sum(n)::DOUBLE AS rate FROM dr JOIN en USING (severity_final, ix) GROUP BY 1, 2))"),
    "systemic_correlation": systemic("coalesce(soc_provider, 'internal')", 3),
    "systemic_correlation_models": systemic("CASE soc_model WHEN 'inhouse' THEN 'internal' ELSE soc_model END", 2),
}
