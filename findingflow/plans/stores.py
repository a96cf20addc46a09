"""Queries over stored tables and outgoing payloads: S10, S11, A12."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import payloads as ops
from ..session import shared_path
from ..sources import stores
from ._registry import query

TARGETS = {
    "linear": {"team_id": "T1"}, "jira": {"project_key": "SEC"}, "slack": {"channel": "#sec"}, "microsoft_teams": {"webhook_url": "https://hooks.example/t"}, "email": {"to": "sec@example.org"}, "webhook": {"url": "https://hooks.example/w"}, "siem": {},
}
SENT = """SELECT cast(row_id AS string) AS finding_id, concat('f', cast(row_id AS string)) AS fingerprint, CASE WHEN row_id % 5 > 0 THEN severity END AS severity, CASE WHEN row_id % 7 > 0 THEN scanner END AS scanner, CASE WHEN row_id % 11 > 0 THEN rule_id END AS rule_id, CASE WHEN row_id % 3 = 0 THEN concat('in "', file, '"') END AS description,
  file AS file_path, CASE WHEN row_id % 2 = 0 THEN start_line END AS line, CASE WHEN row_id % 13 > 0 THEN category END AS category FROM findings WHERE row_id % 4 = 1 OR row_id % 4 = 2"""
_TEXT = lambda c: f"coalesce('\"' || replace({c}, '\"', chr(92) || '\"') || '\"', 'null')"
_HEAD = """concat('"finding_id":"', finding_id, '","integration_type":"{0}"')"""
_TITLE = """concat('"title":"[', upper(s), '] ', coalesce(scanner, ''), ': ', coalesce(rule_id, 'unknown'), '"')"""
_LABELS = """concat('"labels":["security:', s, '","scanner:', c, '"]')"""
_WHO = f"""'"rule_id":' || {_TEXT("rule_id")} || ',"scanner":"' || c || '","schema_version":"1.0.0","severity":"' || s || '"'"""
_TICKET = f"""concat('{{"description":"', replace(coalesce(description, ''), '"', chr(92) || '"'), '","file_path":', {_TEXT("file_path")}, ',', {_HEAD}, {{1}}, ',', {_LABELS}, ',"line":', coalesce(cast(line AS varchar), 'null'), {{2}}, ',', {_WHO}, {{3}}, ',', {_TITLE}, '}}')"""
_SPELLED = {
    "linear": _TICKET.replace("{0}", "linear").replace("{1}", "''").replace("{2}", "',\"project_id\":null'").replace("{3}", "',\"team_id\":\"T1\"'"),
    "jira": _TICKET.replace("{0}", "jira").replace("{1}", "',\"issue_type\":\"Bug\"'").replace("{2}", "',\"project_key\":\"SEC\"'").replace("{3}", "''"),
    "slack": f"""concat('{{"channel":"#sec",', {_HEAD.format("slack")}, ',', {_WHO}, ',"text":":warning: *', upper(s), '* finding in `', coalesce(scanner, '?'), '`: ', coalesce(rule_id, '?'), '",', {_TITLE}, '}}')""",
    "microsoft_teams": f"""concat('{{"card_text":"**', upper(s), '** from ', c, '","card_title":"Security Finding: ', coalesce(rule_id, '?'), '",', {_HEAD.format("microsoft_teams")}, ',', {_WHO}, ',', {_TITLE}, ',"webhook_url":"https://hooks.example/t"}}')""",
    "email": f"""concat('{{', {_HEAD.format("email")}, ',', {_WHO}, ',"subject":"[Findings] ', upper(s), ' finding: ', coalesce(rule_id, '?'), '",', {_TITLE}, ',"to":"sec@example.org"}}')""",
    "webhook": f"""concat('{{', {_HEAD.format("webhook")}, ',"payload":{{"event":"finding.created","finding":{{"file_path":', {_TEXT("file_path")}, ',"finding_id":"', finding_id, '","fingerprint":"', fingerprint, '","line":', coalesce(cast(line AS varchar), 'null'), ',"rule_id":', {_TEXT("rule_id")}, ',"scanner":', {_TEXT("scanner")}, ',"severity":', {_TEXT("severity")}, '}}}},', {_WHO}, ',', {_TITLE}, ',"webhook_url":"https://hooks.example/w"}}')""",
    "siem": f"""concat('{{"category":"', coalesce(category, 'application-security'), '","cef_severity":', cast(CASE s WHEN 'critical' THEN 10 WHEN 'high' THEN 7 WHEN 'medium' THEN 4 WHEN 'low' THEN 2 ELSE 0 END AS varchar), ',"event_type":"security_finding",', {_HEAD.format("siem")}, ',', {_WHO}, ',"siem_format":"json","src_file":', {_TEXT("file_path")}, ',"src_line":', coalesce(cast(line AS varchar), 'null'), ',"src_scanner":', {_TEXT("scanner")}, ',', {_TITLE}, '}}')""",
}


@query(
    f"WITH x AS ({SENT}), f AS (SELECT *, coalesce(severity, 'info') AS s, coalesce(scanner, 'unknown') AS c FROM x) " + " UNION ALL ".join(f"SELECT '{target}' AS target, finding_id, {text} AS payload FROM f" for target, text in _SPELLED.items()),
    findings="findings",
)
def s11_payload_kinds(findings):
    return ops.payloads(findings.sparkSession.sql(SENT.replace("FROM findings", "FROM {f}"), f=findings), TARGETS)


def stored(findings: DataFrame) -> DataFrame:
    return findings.select("repository", "run_id", "row_id", "severity")


@query(
    """WITH again AS (SELECT repository, run_id FROM findings WHERE run_year = 1995 AND row_id % 2 = 0 GROUP BY 1, 2), f AS (SELECT f.*, a.run_id IS NOT NULL AS again FROM findings f LEFT JOIN again a ON a.repository = f.repository AND a.run_id = f.run_id)
    SELECT repository, run_id, count(*) AS n, sum(row_id)::BIGINT AS total, count(*) FILTER (again) AS replaced FROM f WHERE NOT again OR row_id % 2 = 0 GROUP BY 1, 2""",
    findings="findings",
)
def s10_write_runs_again(findings):
    spark, path = findings.sparkSession, shared_path(findings.sparkSession, "runs")
    stores.write_runs(stored(findings.where("run_year < 1996")), path)
    stores.write_runs(stored(findings.where("run_year >= 1996")), path)
    for _ in range(2):
        stores.write_runs(stored(findings.where("run_year = 1995 and row_id % 2 = 0")).withColumn("severity", F.lit("replaced")), path)
    return spark.read.parquet(path).groupBy("repository", "run_id").agg(F.count("*").alias("n"), F.sum("row_id").alias("total"), F.count_if(F.col("severity") == "replaced").alias("replaced"))


FEEDBACK = "SELECT concat('k', cast(user_id AS string), '-', event_type) AS feedback_id, scanner, concat('repo-', cast(user_id % 5 AS string)) AS repository, event_id AS seen FROM scanner_runs"


@query(
    f"""WITH f AS ({FEEDBACK}), a AS (SELECT feedback_id, scanner, repository, min(seen) AS seen FROM f WHERE seen % 2 = 0 GROUP BY 1, 2, 3), b AS (SELECT feedback_id, scanner, repository, min(seen) AS seen FROM f WHERE seen % 2 = 1 GROUP BY 1, 2, 3)
    SELECT * FROM (SELECT * FROM a UNION ALL SELECT * FROM b WHERE feedback_id NOT IN (SELECT feedback_id FROM a)) WHERE feedback_id NOT LIKE '%3-click' AND repository <> 'repo-1' AND repository IN (SELECT 'repo-2' UNION SELECT 'repo-3')""",
    runs="scanner_runs",
)
def a12_feedback_store(runs):
    f = runs.sparkSession.sql(FEEDBACK.replace("FROM scanner_runs", "FROM {r}"), r=runs)
    old = f.where("seen % 2 = 0").groupBy("feedback_id", "scanner", "repository").agg(F.min("seen").alias("seen"))
    gone = f.where("feedback_id like '%3-click'")
    kept = stores.upsert(old, f.where("seen % 2 = 1"), "feedback_id", "seen", gone)
    again = stores.upsert(kept, f, "feedback_id", "seen", gone.unionByName(f.where("repository = 'repo-1'"))).join(kept.select("feedback_id"), "feedback_id", "left_semi").select(old.columns)
    return stores.select_records(again, repository="repo-2").unionByName(stores.select_records(again, repository="repo-3", scanner=None))
