"""Stores that are written again, and payloads against plain dictionaries."""

import json

from findingflow.operators import payloads
from findingflow.sources import stores

ROWS = "repository string, run_id string, finding_id string, severity string"


def test_writing_a_run_again_changes_nothing_and_leaves_others_alone(spark, tmp_path):
    path = str(tmp_path / "findings")
    first = [("a", "1", "f1", "high"), ("a", "1", "f2", "low"), ("a", "2", "f1", "high"), ("b", "1", "f1", "low"), (None, "1", "f9", "low")]
    stores.write_runs(spark.createDataFrame(first, ROWS), path, buckets=3)
    read = lambda: sorted(map(str, (tuple(r) for r in spark.read.parquet(path).drop("bucket").select("repository", "run_id", "finding_id", "severity").collect())))
    assert read() == sorted(map(str, first))
    again = [("a", "1", "f3", "critical"), ("c", "1", "f1", "low")]
    for _ in range(2):
        stores.write_runs(spark.createDataFrame(again, ROWS), path, buckets=3)
        assert read() == sorted(map(str, [*again, *first[2:]]))
    assert stores.exists(spark, path) and not stores.exists(spark, f"{path}-other")


def test_records_are_kept_once_and_deletions_last(spark):
    schema = "feedback_id string, verdict string, scanner string, at int"
    stored = spark.createDataFrame([("k1", "tp", "zap", 1)], schema)
    incoming = spark.createDataFrame([("k1", "fp", "zap", 2), ("k2", "fp", "zap", 4), ("k2", "tp", "zap", 3), ("k3", "tp", "bandit", 5)], schema)
    deleted = spark.createDataFrame([("k3",)], "feedback_id string")
    once = stores.upsert(stored, incoming, "feedback_id", "at", deleted)
    assert sorted(tuple(r) for r in once.collect()) == [("k1", "tp", "zap", 1), ("k2", "tp", "zap", 3)]
    assert sorted(tuple(r) for r in stores.upsert(once, incoming, "feedback_id", "at", deleted).collect()) == sorted(tuple(r) for r in once.collect())
    assert stores.upsert(stored, incoming, "feedback_id", "at").count() == 3
    assert [r.feedback_id for r in stores.select_records(once, scanner="zap", verdict="tp", feedback_id="k2").collect()] == ["k2"] and stores.select_records(once, scanner="", verdict=None).count() == 2


def test_payloads_of_every_kind(spark, tmp_path):
    fields = dict.fromkeys(payloads.FIELDS)
    rows = [{**fields, "finding_id": "1", "fingerprint": "f", "severity": "high", "scanner": "zap", "rule_id": "R\"1", "description": "é", "file_path": "a.py", "line": 3, "category": "dast"}, {**fields, "fingerprint": "g"}]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "finding_id string, fingerprint string, severity string, scanner string, rule_id string, description string, file_path string, line int, category string")
    targets = {"linear": {"team_id": "t"}, "jira": {"project_key": "P", "issue_type": "Task"}, "slack": {"channel": "#c"}, "microsoft_teams": {}, "email": {"to": "x@y"}, "webhook": {"url": "u"}, "siem": {"format": "cef"}}
    made = payloads.payloads(df, targets)
    got = {(r.target, r.finding_id): json.loads(r.payload) for r in made.collect()}
    assert len(got) == 14 and all(list(v) == sorted(v) and v["schema_version"] == "1.0.0" and v["integration_type"] == k[0] for k, v in got.items())
    assert got["linear", "1"]["labels"] == ["security:high", "scanner:zap"] and got["linear", "1"]["team_id"] == "t" and got["linear", "1"]["project_id"] is None and got["linear", "1"]["title"] == '[HIGH] zap: R"1'
    assert got["jira", "g"]["issue_type"] == "Task" and got["jira", "g"]["description"] == "" and got["jira", "g"]["title"] == "[INFO] : unknown" and got["jira", "g"]["rule_id"] is None
    assert got["slack", "g"]["text"] == ":warning: *INFO* finding in `?`: ?" and got["microsoft_teams", "1"]["card_text"] == "**HIGH** from zap" and got["email", "1"]["subject"] == '[Findings] HIGH finding: R"1'
    assert got["webhook", "g"]["payload"] == {"event": "finding.created", "finding": {"finding_id": None, "fingerprint": "g", "severity": None, "scanner": None, "rule_id": None, "file_path": None, "line": None}}
    assert (got["siem", "1"]["cef_severity"], got["siem", "g"]["cef_severity"], got["siem", "g"]["category"], got["siem", "1"]["src_line"], got["siem", "1"]["siem_format"]) == (7, 0, "application-security", 3, "cef")
    payloads.write_payloads(made, str(tmp_path / "out"))
    assert {r.target: r["count"] for r in spark.read.text(str(tmp_path / "out")).groupBy("target").count().collect()} == dict.fromkeys(targets, 2)
