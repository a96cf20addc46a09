"""The standard packs on their trial contexts, and rule tables that are wrong."""

import pytest
from pyspark.sql import functions as F

from findingflow.operators import packs, policy

FIELDS = "severity string, cwe array<string>, epss double, confidence_lower_bound double, kev boolean, reachability string, environment string, asset_criticality string, introduced_in_pull_request boolean, fix_availability boolean, scanner_health string, secret_validation_status string"
NAMES = [f.split()[0] for f in FIELDS.split(", ")]
SAVED = {"severity": "high", "cwe": ["CWE-89"], "confidence_lower_bound": None, "reachability": "unknown", "fix_availability": True, "scanner_health": "missing"}


def context(spark, *rows):
    return spark.createDataFrame([("r", "1", f"f{i}", *({**SAVED, **row}.get(n) for n in NAMES)) for i, row in enumerate(rows)], f"repository string, run_id string, finding_id string, {FIELDS}")


def test_every_pack_meets_its_expectation(spark):
    assert len(packs.PACKS) == 10 and [p.policy_id for p in packs.PACKS] == list(packs.TRIALS) and all(len(p.rules) >= 2 for p in packs.PACKS)
    df = context(spark, *[shared for shared, _ in packs.TRIALS.values()])
    expected = spark.createDataFrame([("r", "1", f"f{i}", name, "BLOCK_IMMEDIATELY", rule) for i, (name, (_, rule)) in enumerate(packs.TRIALS.items())], "repository string, run_id string, finding_id string, policy_id string, expected_outcome string, expected_policy string")
    checked = policy.check_expectations(packs.evaluate_policies(df), expected, (*policy.FINDING, "policy_id"))
    assert checked.where("passed").count() == checked.count() == 10


def test_one_scan_equals_each_policy_by_itself(spark):
    df = context(spark, {}, {"severity": None, "cwe": None, "scanner_health": None, "fix_availability": None}, {"severity": "medium", "reachability": "confirmed", "kev": True, "environment": "production"}, {"epss": 0.7, "reachability": "likely", "secret_validation_status": "unknown"})
    together = packs.evaluate_policies(df)
    assert "Exchange" not in together._jdf.queryExecution().executedPlan().toString()
    got = {(r.policy_id, r.finding_id): (r.matched_policy, r.action, r.outcome, r.trace) for r in together.collect()}
    want = {}
    for p in packs.PACKS:
        for r in policy.evaluate_policy(df, [x._asdict() for x in p.rules], p.default_action).collect():
            want[p.policy_id, r.finding_id] = (r.matched_policy, r.action, r.outcome, r.trace)
    assert got == want and len(got) == 40
    assert got["high-assurance-baseline", "f1"][2] == "INSUFFICIENT_EVIDENCE" and got["startup-baseline", "f1"][2] == "INVESTIGATE"


def test_rule_tables_round_trip_and_are_checked(spark, monkeypatch):
    table = packs.rule_table(spark)
    assert sorted(packs.read_policies(table)) == sorted(packs.PACKS)
    for broken in (table.withColumn("place", F.lit(1)), table.withColumn("name", F.lit("x")), table.withColumn("action", F.lit("explode")), table.withColumn("default_action", F.col("name"))):
        with pytest.raises(ValueError):
            packs.read_policies(broken)
    monkeypatch.setattr(packs, "MOST_RULES", 3)
    with pytest.raises(ValueError):
        packs.read_policies(table)
    assert packs.evaluate_policies(context(spark, {}), [packs.Policy("empty", (), "monitor")]).first().outcome == "MONITOR"


def test_expectations_and_contexts_are_told_apart_by_run(spark):
    found = spark.createDataFrame([("a", "1", "f", "kev", "MONITOR"), ("b", "1", "f", None, "INVESTIGATE")], "repository string, run_id string, finding_id string, matched_policy string, outcome string")
    expected = spark.createDataFrame([("a", "1", "f", "MONITOR", "kev"), ("b", "1", "f", "MONITOR", None), ("c", "1", "f", "MONITOR", None)], "repository string, run_id string, finding_id string, expected_outcome string, expected_policy string")
    assert {r.repository: r.passed for r in policy.check_expectations(found, expected).collect()} == {"a": True, "b": False, "c": False}
    runtime = spark.createDataFrame([("a", "1", "f", "kev", "own"), ("a", "1", None, "kev", "shared"), ("b", "2", None, "kev", "other run")], "repository string, run_id string, finding_id string, field string, value string")
    got = policy.build_context(found.withColumn("kev", F.lit("finding")), runtime, ("kev",))
    assert {r.repository: (r.value_kev, r.source_kev) for r in got.collect()} == {"a": ("own", "runtime.finding"), "b": ("finding", "finding")}
