"""SQL (DuckDB) for moved thresholds: each variant is a run of the rule's own SQL with the value put in its place."""

from __future__ import annotations

from tarsia.plans.contract_oracles import F
from tarsia.plans.evaluation_oracles import TRUTH
from tarsia.plans.more_oracles import BAND, RI
from tarsia.plans.oracles import HEAD, RULES

# Rule, parameter, its value, the two moved ones, and the places where the value stands ({0}; {1}: twice the value).
PLACES = [
    ("EG01", "fast_share_threshold", 0.15, (0.12, 0.18), ["hits / population > {0}"]), ("EG01", "min_fast_count", 5, (4, 6), ["hits >= {0} "]), ("EG02", "max_uninvestigated_share", 0.15, (0.12, 0.18), ["hits / population > {0}"]), ("EG02", "min_uninvestigated_count", 5, (4, 6), ["hits >= {0} "]),
    ("EG04", "max_comment_hash_share", 0.25, (0.2, 0.3), ["hits / population > {0}"]), ("EG04", "min_hash_group_size", 10, (8, 12), ["HAVING count(*) >= {0}"]),
    ("EG05", "min_repeat_count", 8, (6, 10), ["greatest({0}, floor)", "range(0, {1})", "range(1, {1})", ", {1}) AS floor"]), ("EG05", "min_unaddressed_pairs", 2, (1, 3), ["HAVING count(*) >= {0}"]), ("EG05", "max_chance_pairs", 0.5, (0.4, 0.6), ["< {0})"]),
    ("EG06", "min_bulk_closures_per_minute", 8, (6, 10), ["HAVING count(*) >= {0}"]), ("EG06", "max_deadline_hugging_share", 0.25, (0.2, 0.3), ["> {0} AS hug"]), ("EG07", "min_closures_per_analyst_hour", 30, (24, 36), ["count(*) >= {0}"]), ("EG08", "min_unacknowledged_escalations", 3, (2, 4), ["hits >= {0}"]),
    ("EG09", "stale_case_days", 14, (11, 17), ["INTERVAL {0} DAY"]), ("EG09", "min_stale_cases", 3, (2, 4), ["hits >= {0}"]), ("EG10", "mttr_gap_ratio_threshold", 0.6, (0.48, 0.72), ["> {0} AND"]),
    ("EG11", "min_alert_volume", 200, (160, 240), ["count(*) >= {0}"]), ("EG11", "max_robust_z", 3.5, (2.8, 4.2), ["z >= {0}"]), ("EG11", "min_spread", 0.01, (0.008, 0.012), ["mad, {0}::DOUBLE"]), ("EG11", "max_fp_rate", 0.98, (0.784, 1.0), ["rate > {0}"]),
    ("EG12", "min_skipped_cases", 2, (1, 3), ["hits >= {0}"]), ("NS01", "min_silent_days", 3, (2, 4), ["HAVING count(*) >= {0}"]), ("NS01", "min_asset_criticality", 3, (2, 4), ["criticality >= {0}"]), ("NS02", "min_peer_share", 0.6, (0.48, 0.72), ["ceil({0} *"]),
    ("NS03", "max_night_share", 0.03, (0.024, 0.036), ["rate < {0}"]), ("NS03", "min_alert_volume", 100, (80, 120), ["count(*) >= {0}"]), ("NS03", "max_robust_z", 3.5, (2.8, 4.2), ["z <= -{0}"]), ("NS03", "min_spread", 0.02, (0.016, 0.024), ["mad, {0}::DOUBLE"]),
    ("NS04", "min_tp_without_case", 3, (2, 4), ["hits >= {0}"]), ("NS05", "max_dormant_share", 0.4, (0.32, 0.48), ["hits / population > {0}"]), ("NS05", "min_dormant_rules", 5, (4, 6), ["hits >= {0} "]), ("NS06", "min_ghost_assets", 2, (1, 3), ["hits >= {0}"]),
    ("NS08", "review_period_months", 6, (5, 7), ["THEN {0} ELSE least({0},"]),
]


def put(sql: str, places: list[str], old: float, new: float) -> str:
    for place in places:
        before, after = (place.format(v, 2 * v) for v in (old, new))
        if before not in sql:
            raise ValueError(f"{before} isn't in the rule's SQL")
        sql = sql.replace(before, after)
    return sql


def fires(rule: str, variant: str, sql: str) -> str:
    return f"SELECT '{rule}' AS rule_id, '{variant}' AS variant, entity_id FROM (WITH {sql[len(HEAD):].removeprefix(',')})"


MOVED = [(r, k, c, v, new, put(RULES[r], places, v, new)) for r, k, v, news, places in PLACES for c, new in zip(("-20%", "+20%"), news)]
FIRES = "fi AS MATERIALIZED (" + " UNION ALL ".join([fires(r, "base", RULES[r]) for r in sorted({m[0] for m in MOVED})] + [fires(r, k + c, sql) for r, k, c, _, _, sql in MOVED]) + ")"
GRID = "gr AS (SELECT * FROM (VALUES " + ", ".join(f"('{r}', '{k}', '{c}', {v}::DOUBLE, {new}::DOUBLE)" for r, k, c, v, new, _ in MOVED) + ") v(rule_id, param, change, baseline, tested))"
NOW = "EXISTS (SELECT 1 FROM fi WHERE fi.rule_id = g.rule_id AND fi.entity_id = g.entity_id AND fi.variant = g.param || g.change)"
WAS = "EXISTS (SELECT 1 FROM fi WHERE fi.rule_id = g.rule_id AND fi.entity_id = g.entity_id AND fi.variant = 'base')"
PLANTED = "EXISTS (SELECT 1 FROM tr WHERE tr.rule_id = g.rule_id AND tr.entity_id = g.entity_id)"

# A proposal: rule, parameter, its value and the proposed one. Of four of them scores depend too; two rules have no place of their own above.
PROPOSED = [
    ("EG01", "fast_share_threshold", 0.15, 0.3), ("EG02", "max_uninvestigated_share", 0.15, 0.05), ("EG02", "min_uninvestigated_count", 5, 3), ("EG03", "min_unescalated", 1, 8), ("EG04", "max_comment_hash_share", 0.25, 0.6), ("EG04", "min_hash_group_size", 10, 20),
    ("EG05", "min_repeat_count", 8, 5), ("EG05", "min_unaddressed_pairs", 2, 3), ("EG05", "max_chance_pairs", 0.5, 2.0), ("EG06", "min_bulk_closures_per_minute", 8, 4), ("EG06", "max_deadline_hugging_share", 0.25, 0.1), ("EG07", "min_closures_per_analyst_hour", 30, 60),
    ("EG08", "min_unacknowledged_escalations", 3, 5), ("EG09", "stale_case_days", 14, 30), ("EG09", "min_stale_cases", 3, 2), ("EG10", "mttr_gap_ratio_threshold", 0.6, 2.0), ("EG11", "min_alert_volume", 200, 100), ("EG11", "max_robust_z", 3.5, 2.5), ("EG11", "min_spread", 0.01, 0.005),
    ("EG11", "max_fp_rate", 0.98, 0.9), ("EG12", "min_skipped_cases", 2, 1), ("NS01", "min_silent_days", 3, 6), ("NS01", "min_asset_criticality", 3, 2), ("NS02", "min_peer_share", 0.6, 0.8), ("NS03", "max_night_share", 0.03, 0.2), ("NS03", "min_alert_volume", 100, 50), ("NS03", "max_robust_z", 3.5, 2.5),
    ("NS03", "min_spread", 0.02, 0.01), ("NS04", "min_tp_without_case", 3, 2), ("NS05", "max_dormant_share", 0.4, 0.6), ("NS05", "min_dormant_rules", 5, 3), ("NS06", "min_ghost_assets", 2, 4), ("NS07", "min_unreported", 1, 40), ("NS08", "review_period_months", 6, 5),
]
MORE = {
    ("EG01", "fast_share_threshold"): ["/ {0}::DOUBLE AS distance"], ("EG04", "max_comment_hash_share"): ["/ {0}::DOUBLE AS distance"], ("EG05", "min_unaddressed_pairs"): ["count(*) / {0}.0::DOUBLE AS distance"], ("NS01", "min_silent_days"): ["max(days) / {0}.0::DOUBLE AS distance"],
    ("EG03", "min_unescalated"): ["WHERE hits >= {0}"],
}


def moved_rules() -> dict[str, str]:
    known, out = {(r, k): places for r, k, _, _, places in PLACES}, dict(RULES)
    for r, k, v, new in PROPOSED:
        if r == "NS07":
            out[r] = put(out[r], ["AS distance FROM q GROUP BY 1"], 0, 0).replace("AS distance FROM q GROUP BY 1", f"AS distance FROM q GROUP BY 1 HAVING count(*) >= {new}")
        else:
            out[r] = put(out[r], known.get((r, k), []) + MORE.get((r, k), []), v, new)
    return out


def banded(f: str) -> str:
    return f"(WITH {RI.replace(F, f'f AS (SELECT * FROM {f})')} SELECT entity_id, risk_index, {BAND} AS band FROM ri)"


NONE = {c: f"CAST(NULL AS {k}) AS {c}" for c, k in {"entity_id": "VARCHAR", "rule_id": "VARCHAR", "param": "VARCHAR", "change": "VARCHAR", "hits": "BIGINT", "before": "DOUBLE", "after": "DOUBLE", "band_before": "VARCHAR", "band_after": "VARCHAR"}.items()}


def line(kind: str, source: str, **columns: str) -> str:
    return f"SELECT '{kind}' AS kind, " + ", ".join(f"{columns[c]} AS {c}" if c in columns else none for c, none in NONE.items()) + f" FROM {source}"


PREVIEW = " UNION ALL ".join([
    line("parameter", "(VALUES " + ", ".join(f"('{r}', '{k}', {v}::DOUBLE, {new}::DOUBLE)" for r, k, v, new in PROPOSED) + ") v(r, k, a, b)", rule_id="r", param="k", change="'moved'", before="a", after="b"),
    line("finding", "fa FULL JOIN fb ON fa.entity_id = fb.entity_id AND fa.rule_id = fb.rule_id", entity_id="coalesce(fa.entity_id, fb.entity_id)", rule_id="coalesce(fa.rule_id, fb.rule_id)", change="CASE WHEN fa.score IS NULL THEN 'added' WHEN fb.score IS NULL THEN 'removed' ELSE 'same' END", hits="coalesce(fb.hits, fa.hits)", before="fa.score", after="fb.score"),
    line("band", "ba JOIN bb ON ba.entity_id = bb.entity_id WHERE ba.band <> bb.band", entity_id="ba.entity_id", change="'moved'", before="ba.risk_index", after="bb.risk_index", band_before="ba.band", band_after="bb.band"),
    line("findings", "(SELECT 1)", before="CAST((SELECT count(*) FROM fa) AS DOUBLE)", after="CAST((SELECT count(*) FROM fb) AS DOUBLE)"),
])

ORACLES = {
    "tuning_preview": f"{HEAD}, {F.replace('f AS', 'fa AS', 1)}, fb AS MATERIALIZED (" + " UNION ALL BY NAME ".join(f"SELECT * FROM ({q})" for q in moved_rules().values()) + f"), ba AS MATERIALIZED (SELECT * FROM {banded('fa')}), bb AS MATERIALIZED (SELECT * FROM {banded('fb')}) {PREVIEW}",
    "threshold_sensitivity_all": f"{HEAD}, {TRUTH}, {FIRES}, {GRID} SELECT rule_id, param, change, baseline, tested, count(*) FILTER (now AND planted) AS tp, count(*) FILTER (now AND NOT planted) AS fp, count(*) FILTER (NOT now AND planted) AS fn, count(*) FILTER (now AND NOT was) AS added, count(*) FILTER (NOT now AND was) AS removed"
    f" FROM (SELECT *, {NOW} AS now, {WAS} AS was, {PLANTED} AS planted FROM (SELECT gr.*, entity_id FROM gr CROSS JOIN entity) g) GROUP BY 1, 2, 3, 4, 5",
}
