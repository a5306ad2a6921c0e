"""Proposed parameters: every rule is run anew with them, and entities are banded by what it finds then."""

import pytest

from tarsia.operators import rules, tuning
from tarsia.operators.scoring import risk_index
from tarsia.sources.projection import Tables

KEY = ["entity_id", "rule_id"]


@pytest.fixture(scope="module")
def t(spark, sf_dir):
    return Tables(spark, sf_dir)


def rows(frame, kind):
    return [r for r in frame if r.kind == kind]


def test_parameters_of_every_rule_are_previewed(t):
    got = tuning.preview(t).collect()
    assert {r.rule_id for r in rows(got, "parameter")} == set(rules.RULES) == set(tuning.PROPOSED)
    assert {(r.rule_id, r.param) for r in rows(got, "parameter")} >= {(r, p) for r in tuning.PROPOSED for p in tuning.PROPOSED[r]}
    found = rows(got, "finding")
    assert {(r.entity_id, r.rule_id) for r in found if r.change != "added"} == {(r.entity_id, r.rule_id) for r in rules.findings(t).select(*KEY).collect()}
    (total,) = rows(got, "findings")
    assert (total.before, total.after) == (sum(r.change != "added" for r in found), sum(r.change != "removed" for r in found))


def test_one_change_moves_findings_and_bands(t):
    """Silence of five days is none if six are asked for: the entity loses its only critical finding, and its band with it."""
    got = tuning.preview(t, {"NS01": {"min_silent_days": 6}}).collect()
    assert [(r.rule_id, r.param, r.before, r.after) for r in rows(got, "parameter")] == [("NS01", "min_silent_days", 3, 6)]
    moved = [(r.entity_id, r.rule_id, r.change) for r in rows(got, "finding") if r.change != "same"]
    assert moved == [("E17", "NS01", "removed")] and len(rows(got, "finding")) == rules.findings(t).count()
    before = {r.entity_id: r for r in risk_index(t).collect()}
    assert [(r.entity_id, r.before, r.band_before) for r in rows(got, "band")] == [("E17", before["E17"].risk_index, before["E17"].band)]
    assert rows(got, "band")[0].after < before["E17"].risk_index and rows(got, "band")[0].band_after != before["E17"].band


def test_scores_follow_the_threshold(t):
    (was,) = [r for r in rules.eg01(t).collect() if r.entity_id == "E04"]
    p = rules.BASE["EG01"] | {"fast_share_threshold": 0.75}
    (now,) = [r for r in rules.eg01(t, p).collect() if r.entity_id == "E04"]
    assert (was.hits, was.population) == (now.hits, now.population) and now.score < was.score
    assert now.distance == pytest.approx(was.hits / was.population / 0.75) and was.distance == pytest.approx(was.hits / was.population / 0.15)


def test_unchanged_values_find_the_same(t):
    """All rules run anew with their own values; a group or batch that reaches another threshold is kept apart from theirs."""
    columns = [*KEY, "hits", "population", "distance", "confidence", "score", "severity"]
    key = lambda f: sorted(map(str, f.select(*columns).collect()))
    rules.proposed(t, {"EG04": {"min_hash_group_size": 2}, "EG06": {"min_bulk_closures_per_minute": 2}, "EG07": {"min_closures_per_analyst_hour": 2}}).count()
    assert key(rules.proposed(t, rules.BASE)) == key(rules.findings(t))


@pytest.mark.parametrize("rule", sorted(rules.RULES))
def test_evidence_is_left_out(t, rule):
    plan = rules.RULES[rule](t, rules.BASE[rule]).drop("evidence").distinct()._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
