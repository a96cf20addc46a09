"""Confidence components on literal cases."""

import pytest

from findingflow.operators import confidence

SCHEMA = "k int, scanner string, rule_id string, evidence_kinds array<string>, corroboration_bound double, independent_sources int, reachability string, n_references int"


@pytest.fixture(scope="module")
def got(spark):
    rows = [
        (1, "a", "R", ["corroboration"], 0.4, 2, "reachable", 1),
        (2, "a", "R", ["corroboration", "manual_validation"], 0.4, 1, "unreachable", 0),
        (3, "a", "S", ["exploit_validation"], None, None, "unknown", None),
        (4, "x", "R", None, None, None, "potentially_reachable", 3),
        (5, "a", "R", ["known_exploited", "manual_validation"], 9.0, 3, None, None),
    ]
    posteriors = spark.createDataFrame([("a", "R", 0.9, 0.75, 40, 5), ("a", "S", 0.97, 0.2, 3, 1)], "scanner string, rule_id string, mean double, lower double, tp long, fp long")
    return {r.k: r for r in confidence.components(spark.createDataFrame(rows, SCHEMA), posteriors).collect()}


def pairs(r, *names):
    return [tuple(round(x, 6) for x in r[n]) if r[n] else None for n in names]


def test_validity_gains_by_corroboration_and_people(got):
    assert pairs(got[1], "reliability", "validity") == [(0.9, 0.75), (0.94, 0.79)]
    assert pairs(got[2], "validity") == [(1.0, 0.85)] and pairs(got[5], "validity") == [(0.95, 0.8)]
    assert pairs(got[4], "reliability", "validity") == [None, None]


def test_evidence_decides_the_other_components(got):
    assert pairs(got[1], "reach", "exploit", "fix") == [(0.9, 0.7), None, (0.7, 0.5)]
    assert pairs(got[3], "reach", "exploit", "fix") == [None, (0.8, 0.6), None] and pairs(got[5], "exploit") == [(0.6, 0.35)]


def test_overall_is_the_least_scored_component(got):
    assert (got[1].overall_estimate, got[1].overall_bound, got[1].overall_tier, got[1].maturity) == (0.7, 0.5, "Likely", "Moderate")
    assert (got[2].overall_bound, got[2].overall_tier) == (0.02, "Noise") and (got[3].overall_bound, got[3].overall_tier, got[3].maturity) == (0.2, "Experimental", "Experimental")
    assert (got[4].overall_estimate, got[4].overall_tier, got[4].maturity) == (0.6, "Unscored", "Unscored")
