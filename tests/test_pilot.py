"""A pilot's figures on planted judgements; every expected figure follows from them."""

import pytest

from tarsia.operators import pilot

TASK = "sample_no int, position int, run_id string, entity_id string, arm string, rank int, band string, reviewer string, replica boolean, opened_at string, submitted_at string, concern string"
ARM = {"f1": "flagged", "f2": "flagged", "f3": "flagged", "c1": "control", "c2": "control", "r1": "random", "r2": "random"}
BAND = {"f": "high", "c": "low", "r": "moderate"}
FIRST = {"f1": "Elevated", "f2": "Critical", "f3": "Low", "c1": "Critical", "c2": "Low", "r1": "Low", "r2": "Moderate"}
SECOND = FIRST | {"f1": "Moderate", "r1": None}  # differs on f1, leaves r1 unanswered


def tasks(labels, run="A", sample=1):
    who = f"examiner_{sample}"
    return [
        (sample, i, run, e, ARM[e], i if e[0] == "f" else None, BAND[e[0]], who, sample > 1, "2026-07-01 09:00:00", "2026-07-01 09:02:00" if c else None, c)
        for i, (e, c) in enumerate(sorted(labels.items()), 1)
    ]


def figures(spark, rows, calibration=(), settled=(), budget=2, unknown=()):
    frame = spark.createDataFrame(rows, TASK)
    frame = frame.withColumns({c: frame[c].cast("timestamp_ntz") for c in ("opened_at", "submitted_at")})
    split = spark.createDataFrame([(e, "calibration" if e in calibration else "held_out") for e in ARM if e not in unknown], "entity_id string, part string")
    runs = spark.createDataFrame([("A", "x"), ("B", "y"), ("C", "x")], "run_id string, config string")
    queue = spark.createDataFrame([("f1", "targeted", True, True), ("f2", "targeted", True, False), ("f2", "targeted", False, False)], "entity_id string, arm string, decided boolean, confirmed boolean")
    out = pilot.evaluate(frame, runs, "x", split, spark.createDataFrame(list(settled), "run_id string, entity_id string, label string"), queue, budget).collect()
    return {(r.section, r.item, r.measure): r.detail if r.detail else r.value for r in out}


def test_labels_of_two_examiners(spark):
    got = figures(spark, tasks(FIRST) + tasks(SECOND, sample=2))
    held = {k[1:]: v for k, v in got.items() if k[0] == "held_out"}
    # f1 is unresolved: left out, not counted as a negative.
    assert [held["all", m] for m in ("units", "labelled", "unresolved", "adjudicated", "unanswered", "agreed", "single")] == [7, 6, 1, 0, 0, 5, 1]
    assert [(held[a, "n"], held[a, "positive"]) for a in ("flagged", "control", "random")] == [(2, 1), (2, 1), (2, 0)]
    assert (held["flagged", "budget_reviewed"], held["flagged", "budget_important"], held["flagged", "false_positives"]) == (2, 1, 1)
    assert held["flagged", "rate"] == 0.5 and held["flagged", "wilson_low"] == 0.0945 and (held["flagged", "cluster_low"], held["flagged", "cluster_high"]) == (0, 1)
    assert [(k, v) for k, v in held.items() if k[1] == "missed"] == [(("A/c1", "missed"), "control,Critical,low")]
    assert got["agreement", "all", "pairs"] == 6 and got["agreement", "all", "observed_binary"] == pytest.approx(5 / 6, abs=1e-4)
    assert got["agreement", "all", "kappa_binary"] == pytest.approx(2 / 3, abs=1e-4)  # chance: (1/2)(1/3) + (1/2)(2/3)
    assert [got["review_time", "all", m] for m in ("n", "median_s", "p90_s", "not_recorded")] == [13, 120, 120, 0] and got["review_time", "examiner_2", "n"] == 6
    assert [k[1:] + (v,) for k, v in got.items() if k[0] == "disagreement"] == [("A/f1", "concerns", "Elevated,Moderate")]
    assert [got["queue", "targeted", m] for m in ("n", "decided", "confirmed", "cluster_low", "cluster_high")] == [3, 2, 1, 0, 1]


def test_a_third_examiner_settles_it(spark):
    got = figures(spark, tasks(FIRST) + tasks(SECOND, sample=2), settled=[("A", "f1", "Elevated"), ("A", "f2", "Low")])  # f2 needs none
    assert [got["held_out", "all", m] for m in ("unresolved", "adjudicated")] == [0, 1]
    assert (got["held_out", "flagged", "n"], got["held_out", "flagged", "positive"]) == (3, 2)
    assert (got["held_out", "flagged", "budget_reviewed"], got["held_out", "flagged", "budget_important"]) == (2, 2)  # f1, f2 by rank


def test_other_configurations_and_calibration(spark):
    rows = tasks(FIRST) + tasks(dict.fromkeys(ARM, "Critical"), "B", 3) + tasks(dict.fromkeys(ARM, None), "C", 4)
    got = figures(spark, rows, calibration=("f1", "c1"), unknown=("r2",))
    assert {k[1]: k[2] for k in got if k[0] == "runs"} == {"A": "evaluated", "B": "excluded", "C": "evaluated"}
    assert [(got[p, "all", "units"], got[p, "all", "unanswered"]) for p in ("held_out", "calibration")] == [(8, 4), (4, 2)] and got["not_in_protocol", "all", "units"] == 2
    assert got["calibration", "flagged", "positive"] == 1 and got["calibration", "flagged", "cluster_low"] is None  # one entity has no interval
    assert got["held_out", "random", "n"] == 1 and got["agreement", "all", "pairs"] == 0 and got["agreement", "all", "kappa_binary"] is None


def test_units_of_one_entity_are_drawn_together(spark):
    """Two entities whose units agree across runs: as good as two observations."""
    rows = [r for k in range(20) for r in tasks({"f1": "Critical", "f2": "Low"}, "A" if k % 2 else "C", k + 1)]
    got = figures(spark, rows)
    assert (got["held_out", "flagged", "n"], got["held_out", "flagged", "entities"]) == (4, 2)
    assert (got["held_out", "flagged", "cluster_low"], got["held_out", "flagged", "cluster_high"]) == (0, 1)
    assert got["held_out", "flagged", "wilson_low"] > 0.1


def test_the_query_evaluates_two_labels(spark, sf_dir):
    from tarsia.plans.registry import QUERIES

    got = QUERIES["pilot_evaluation"](spark, sf_dir)
    have = {(r.section, r.measure) for r in got.select("section", "measure").distinct().collect()}
    want = {(p, m) for p in pilot.PARTS for m in ("unresolved", "cluster_low", "budget_important")}
    assert want | {("agreement", "kappa_weighted_levels"), ("review_time", "p90_s"), ("queue", "decided")} <= have
