"""SQL (DuckDB) for the figures of a pilot: one run, two examiners and a third for what they differ on."""

from __future__ import annotations

from tarsia.plans.assessment_oracles import QUEUE, RISK
from tarsia.plans.evaluation_oracles import HALF, STATUS, WILSON
from tarsia.plans.oracles import query

WORD = "['Low', 'Moderate', 'Elevated', 'Critical'][{0} + 1]"
SIGNALS = """ag AS (SELECT entity_id, count(*) AS n, count(*) FILTER (severity_final IN ('high', 'critical')) AS serious, count(*) FILTER (disposition = 'false_positive') AS fp, count(*) FILTER (closed_by_type = 'human' AND closed_at IS NOT NULL) AS people,
 count(*) FILTER (closed_by_type = 'human' AND epoch_us(closed_at) - epoch_us(created_at) < 3600000000) AS quick, count(*) FILTER (status = 'open') AS opened, count(*) FILTER (acknowledged_at IS NULL) AS unacked FROM alert GROUP BY 1),
sg AS MATERIALIZED (SELECT e.entity_id, COLUMNS('^(n|serious|fp|people|quick|opened|unacked|escalated)$') FROM entity e LEFT JOIN ag ON ag.entity_id = e.entity_id LEFT JOIN (SELECT entity_id, count(*) AS escalated FROM escalation GROUP BY 1) x ON x.entity_id = e.entity_id),
sn AS (SELECT entity_id, coalesce(n, 0) AS n, coalesce(serious, 0) AS serious, coalesce(CAST(coalesce(escalated, 0) * (SELECT sum(serious) FROM sg) < (SELECT coalesce(sum(escalated), 0) FROM sg) * serious AS INT), 0) AS few, coalesce(CAST(fp * (SELECT sum(n) FROM sg) > (SELECT sum(fp) FROM sg) * n AS INT), 0) AS many,
 coalesce(CAST(quick * (SELECT sum(people) FROM sg) > (SELECT sum(quick) FROM sg) * people AS INT), 0) AS fast, coalesce(CAST(opened * (SELECT sum(n) FROM sg) > (SELECT sum(opened) FROM sg) * n AS INT), 0) AS late, coalesce(CAST(unacked * (SELECT sum(n) FROM sg) > (SELECT sum(unacked) FROM sg) * n AS INT), 0) AS mute FROM sg)"""
DRAWN = """rh AS MATERIALIZED (SELECT entity_id, risk_index, band, sha256('42:' || entity_id) AS h, row_number() OVER (ORDER BY risk_index DESC, entity_id) AS nth FROM r), tp AS MATERIALIZED (SELECT entity_id FROM rh WHERE nth <= 8),
lw AS MATERIALIZED (SELECT entity_id FROM rh WHERE entity_id NOT IN (SELECT entity_id FROM tp) ORDER BY risk_index, h LIMIT 5), ot AS MATERIALIZED (SELECT entity_id FROM rh WHERE entity_id NOT IN (SELECT entity_id FROM tp) AND entity_id NOT IN (SELECT entity_id FROM lw) ORDER BY h LIMIT 5),
dn AS MATERIALIZED (SELECT rh.*, arm, row_number() OVER (ORDER BY h) AS place FROM rh JOIN (SELECT entity_id, 'flagged' AS arm FROM tp UNION ALL SELECT entity_id, 'control' FROM lw UNION ALL SELECT entity_id, 'random' FROM ot) USING (entity_id)),
pt AS (SELECT entity_id, CASE WHEN row_number() OVER (ORDER BY sha256('11:' || entity_id)) <= round_even(0.3::DOUBLE * count(*) OVER (), 0) THEN 'calibration' ELSE 'held_out' END AS part FROM entity)"""
UNITS = f"""jd AS (SELECT entity_id, n, serious, CASE WHEN n % 4 <> 0 THEN few + many + mute END AS l1, CASE WHEN n % 6 <> 0 THEN few + many + late END AS l2, CASE WHEN serious % 2 = 0 THEN few + many + fast END AS l3 FROM sn),
ju AS (SELECT *, CASE WHEN l1 IS NULL AND l2 IS NULL THEN 'unanswered' WHEN l1 IS NULL OR l2 IS NULL THEN 'single' WHEN (l1 >= 2) = (l2 >= 2) THEN 'agreed' WHEN l3 IS NOT NULL THEN 'adjudicated' ELSE 'unresolved' END AS status FROM jd),
un AS MATERIALIZED (SELECT entity_id, part, arm, CASE WHEN arm = 'flagged' THEN nth ELSE 0 END AS nth, place, band, l1, l2, n, serious, status, CASE WHEN status IN ('agreed', 'single') THEN greatest(coalesce(l1, l2), coalesce(l2, l1)) WHEN status = 'adjudicated' THEN l3 END AS label FROM dn JOIN ju USING (entity_id) JOIN pt USING (entity_id)),
td AS MATERIALIZED (SELECT *, label >= 2 AS important, row_number() OVER (PARTITION BY part, arm ORDER BY nth, place) <= 4 AS within FROM un WHERE label IS NOT NULL),
qs AS MATERIALIZED (SELECT entity_id, arm, s IN ('confirmed', 'dismissed') AS decided, s = 'confirmed' AS confirmed FROM (SELECT entity_id, arm, {STATUS} AS s FROM q))"""
INTERVAL = """cl AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY part, arm ORDER BY entity_id) - 1 AS ix, count(*) OVER (PARTITION BY part, arm) AS m FROM (SELECT part, arm, entity_id, count(*) AS n, count(*) FILTER (important) AS k FROM td GROUP BY 1, 2, 3 UNION ALL SELECT 'queue', arm, entity_id, count(*), count(*) FILTER (confirmed) FROM qs WHERE decided GROUP BY 2, 3)),
dw AS (SELECT part, arm, a, CAST('0x' || substr(md5('42:' || part || ':' || arm || ':' || a || ':' || b), 1, 8) AS BIGINT) % m AS ix FROM (SELECT DISTINCT part, arm, m FROM cl WHERE m >= 2), range(2000) x(a), range(1000) y(b) WHERE b < m),
rs AS (SELECT part, arm, rate, row_number() OVER (PARTITION BY part, arm ORDER BY rate, a) AS i FROM (SELECT part, arm, a, sum(k) / sum(n)::DOUBLE AS rate FROM dw JOIN cl USING (part, arm, ix) GROUP BY 1, 2, 3)),
iv AS (SELECT part, arm, round_even(max(rate) FILTER (i = 51), 4) AS cluster_low, round_even(max(rate) FILTER (i = 1951), 4) AS cluster_high FROM rs GROUP BY 1, 2)"""
GRID = "gp AS (SELECT unnest(['held_out', 'calibration']) AS part), ga AS (SELECT part, unnest(['flagged', 'random', 'control']) AS arm FROM gp)"
ARM = f"""ar AS MATERIALIZED (SELECT *, {WILSON} FROM (SELECT *, {HALF} FROM (SELECT *, k / nullif(n, 0)::DOUBLE AS p FROM (SELECT part, arm, count(label) AS n, count(*) FILTER (important) AS k, count(DISTINCT entity_id) AS entities, count(*) FILTER (within) AS reviewed, count(*) FILTER (within AND important) AS found, 0 AS records FROM ga LEFT JOIN td USING (part, arm) GROUP BY 1, 2
 UNION ALL SELECT 'queue', arm, count(*) FILTER (decided), count(*) FILTER (confirmed), 0, 0, 0, count(*) FROM qs GROUP BY 2))) LEFT JOIN iv USING (part, arm))"""
TIMES = """tm AS (SELECT who, CASE WHEN NOT unseen THEN s END AS s FROM (SELECT 'examiner_1' AS who, l1 AS l, serious % 7 = 0 AS unseen, 60.0::DOUBLE + n % 600 AS s FROM un UNION ALL SELECT 'examiner_2', l2, serious % 5 = 0, 90.0::DOUBLE + serious % 900 FROM un) WHERE l IS NOT NULL),
tw AS (SELECT who, s, row_number() OVER (PARTITION BY who ORDER BY s) - 1 AS i, count(*) OVER (PARTITION BY who) AS m FROM (SELECT * FROM tm UNION ALL SELECT 'all', s FROM tm) WHERE s IS NOT NULL)"""
PAIRS = """pr AS (SELECT l1 AS x, l2 AS y FROM un WHERE l1 IS NOT NULL AND l2 IS NOT NULL), pn AS (SELECT count(*) AS n, avg(CAST((x >= 2) = (y >= 2) AS INT)) AS same, avg(1 - abs(x - y) / 3.0::DOUBLE) AS near FROM pr),
ex AS (SELECT avg(CAST((a.x >= 2) = (b.y >= 2) AS INT)) AS same, avg(1 - abs(a.x - b.y) / 3.0::DOUBLE) AS near FROM pr a, pr b)"""


def rows(section: str, item: str, measures: dict[str, str], source: str) -> str:
    names, values = ", ".join(f"'{m}'" for m in measures), ", ".join(f"CAST({v} AS DOUBLE)" for v in measures.values())
    return f"SELECT {section} AS section, {item} AS item, unnest([{names}]) AS measure, unnest([{values}]) AS value, CAST(NULL AS VARCHAR) AS detail FROM {source}"


RATE = {"rate": "round_even(p, 4)", "wilson_low": "low", "wilson_high": "high", "cluster_low": "cluster_low", "cluster_high": "cluster_high"}
STATES = {s: f"count(*) FILTER (status = '{s}')" for s in ("unanswered", "unresolved", "adjudicated", "agreed", "single")}
KAPPA = "CASE WHEN ex.{0} < 1 THEN round_even((pn.{0} - ex.{0}) / (1 - ex.{0}), 4) END"

ORACLES = {
    "pilot_evaluation": query(" UNION ALL ".join([
        rows("part", "'all'", {"units": "count(status)", "labelled": "count(label)"} | STATES, "gp LEFT JOIN un USING (part) GROUP BY part"), rows("'not_in_protocol'", "'all'", {"units": "0"}, "(SELECT 1)"),
        rows("part", "arm", {"n": "n", "positive": "k", "entities": "entities", "budget_reviewed": "reviewed", "budget_important": "found"} | RATE, "ar WHERE part <> 'queue'"),
        rows("part", "arm", {"false_positives": "n - k"}, "ar WHERE part <> 'queue' AND arm = 'flagged'"), rows("part", "arm", {"n": "records", "decided": "n", "confirmed": "k"} | RATE, "ar WHERE part = 'queue'"),
        f"SELECT part, 'base/' || entity_id, 'missed', CAST(NULL AS DOUBLE), arm || ',' || {WORD.format('label')} || ',' || band FROM td WHERE arm IN ('random', 'control') AND important AND NOT regexp_matches(lower(band), '^(elevated|high|critical|severe)')",
        f"SELECT 'disagreement', 'base/' || entity_id, 'concerns', CAST(NULL AS DOUBLE), {WORD.format('l1')} || ',' || {WORD.format('l2')} FROM un WHERE status = 'unresolved'",
        rows("'agreement'", "'all'", {"pairs": "n", "observed_binary": "round_even(pn.same, 4)", "kappa_binary": KAPPA.format("same"), "kappa_weighted_levels": KAPPA.format("near")}, "pn, ex"),
        rows("'review_time'", "who", {"median_s": "round_even(median(s), 1)", "p90_s": "round_even(max(s) FILTER (i = least(m - 1, floor(0.9::DOUBLE * m))), 1)"}, "tw GROUP BY who"), rows("'review_time'", "who", {"n": "count(*)"}, "tw WHERE who <> 'all' GROUP BY who"),
        rows("'review_time'", "'all'", {"n": "count(s)", "not_recorded": "count(*) - count(s)"}, "tm"), "SELECT 'runs', 'base', 'evaluated', 1.0::DOUBLE, CAST(NULL AS VARCHAR)",
    ]), RISK, QUEUE, SIGNALS, DRAWN, UNITS, INTERVAL, GRID, ARM, TIMES, PAIRS),
}
