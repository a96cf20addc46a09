"""Portfolio queries: A16 to A25, W2, J21 and drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import portfolio as ops
from ._registry import query

COUNTS = ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in ops.SEVERITIES)
RISK = "CASE severity " + " ".join(f"WHEN '{s}' THEN {w}" for s, w in ops.WEIGHTS.items()) + " ELSE 0 END"
R6 = lambda df, *c: df.withColumns({x: F.round(x, 6) for x in c})


@query(f"SELECT CASE WHEN grouping(repository) = 1 THEN '(all)' ELSE repository END AS repository, count(*) AS total, {COUNTS} FROM findings GROUP BY ROLLUP (repository)", findings="findings")
def a16_multi_repository_dashboard(findings):
    return ops.multi_repository_dashboard(findings)


@query(
    f"""WITH per AS (SELECT concat('org-', cast(cast(substr(repository, 6) AS int) % 25 AS string)) AS organisation, repository, sum({RISK}) AS risk, count(*) AS total FROM findings GROUP BY 1, 2),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY organisation ORDER BY risk DESC, repository) AS place FROM per)
    SELECT organisation, cast(sum(risk) AS bigint) AS risk_score, cast(sum(total) AS bigint) AS total, string_agg(repository, ',' ORDER BY place) FILTER (place <= 5) AS highest FROM ranked GROUP BY 1""",
    findings="findings",
)
def a17_organisation_risk(findings):
    return ops.organisation_risk(findings.withColumn("organisation", F.expr("concat('org-', cast(cast(substr(repository, 6) AS int) % 25 AS string))")))


@query(
    """WITH t AS (SELECT repository, run_year, count(*) AS total FROM findings GROUP BY 1, 2),
    e AS (SELECT repository, count(*) AS snapshots, arg_min(total, run_year) AS first_total, arg_max(total, run_year) AS last_total FROM t GROUP BY 1)
    SELECT *, CASE WHEN last_total < first_total THEN 'improving' WHEN last_total > first_total THEN 'worsening' ELSE 'stable' END AS direction FROM e""",
    findings="findings",
)
def w2_repository_trends(findings):
    return ops.repository_trends(findings)


@query("SELECT repository, run_year, count(*) AS total, " + ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in ("critical", "high", "medium", "low", "info", "unknown")) + " FROM findings GROUP BY 1, 2", findings="findings")
def w2_trend_points(findings):
    return ops.trend_points(findings)


@query(
    """SELECT scanner, count(*) AS total_runs, count(*) FILTER (success) AS successes, count(*) FILTER (NOT success) AS failures, round(count(*) FILTER (success) / count(*), 6) AS success_rate,
    round(avg(duration_seconds), 6) AS avg_duration, string_agg(DISTINCT version, ',' ORDER BY version) AS versions FROM scanner_runs GROUP BY 1""",
    runs="scanner_runs",
)
def a18_scanner_health(runs):
    return R6(ops.scanner_health(runs), "success_rate", "avg_duration")


@query(
    """SELECT CASE WHEN grouping(event_type) = 1 THEN '(all)' ELSE event_type END AS policy, count(*) AS total, count(*) FILTER (success) AS passed, round(count(*) FILTER (success) / count(*), 6) AS rate
    FROM scanner_runs GROUP BY ROLLUP (event_type)""",
    runs="scanner_runs",
)
def a19_policy_compliance(runs):
    return R6(ops.policy_compliance(runs.select(F.col("event_type").alias("policy"), F.col("success").alias("passed"))), "rate")


@query(
    """SELECT CASE WHEN grouping(severity) = 1 THEN '(all)' ELSE severity END AS severity, count(*) AS sample_size, round(avg(resolved_at - opened_at) / 86400, 6) AS mttr_days
    FROM findings WHERE opened_at IS NOT NULL AND resolved_at IS NOT NULL GROUP BY ROLLUP (severity)""",
    findings="findings",
)
def a20_mean_time_to_remediation(findings):
    return R6(ops.mean_time_to_remediation(findings), "mttr_days")


@query(f"SELECT coalesce(owner, '(unassigned)') AS owner, count(*) AS total, {COUNTS}, count(*) FILTER (status <> 'resolved') AS open FROM findings GROUP BY 1", findings="findings")
def a21_ownership(findings):
    return ops.ownership(findings)


NOW = 200_000.0


@query(
    f"""SELECT count(*) AS total, count(*) FILTER (expires_at <= {NOW}) AS expired, count(*) FILTER (expires_at > {NOW} AND expires_at <= {NOW + ops.WEEK}) AS expiring_soon,
    count(*) FILTER (expires_at IS NULL OR expires_at > {NOW + ops.WEEK}) AS active, round(count(*) FILTER (expires_at <= {NOW}) / count(*), 6) AS expired_rate FROM suppressions""",
    suppressions="suppressions",
)
def a22_suppression_expiry(suppressions):
    return R6(ops.suppression_expiry(suppressions, NOW), "expired_rate")


@query(
    """WITH p AS (SELECT repository, fingerprint, min(CASE WHEN to_state IN ('resolved', 'false_positive', 'closed') THEN sequence END) AS c, max(CASE WHEN to_state IN ('open', 'acknowledged') THEN sequence END) AS o FROM history GROUP BY 1, 2)
    SELECT count(c) AS resolved, count(*) FILTER (o > c) AS reopened, round(count(*) FILTER (o > c) / count(c), 6) AS rate FROM p""",
    history="history",
)
def a23_reopened_rate(history):
    return R6(ops.reopened_rate(history), "rate")


@query(
    """WITH r AS (SELECT event_id % 2 = 0 AS proposed, event_id % 3 = 0 AS accepted, success AS verified FROM scanner_runs)
    SELECT count(*) FILTER (proposed) AS proposed, count(*) FILTER (proposed AND accepted) AS accepted_of_proposed, count(*) FILTER (accepted) AS accepted, count(*) FILTER (accepted AND verified) AS verified,
    round(count(*) FILTER (proposed AND accepted) / count(*) FILTER (proposed), 6) AS acceptance_rate, round(count(*) FILTER (accepted AND verified) / count(*) FILTER (accepted), 6) AS verification_rate,
    count(*) FILTER (accepted AND verified) * cast(2.0 AS double) AS hours_saved FROM r""",
    runs="scanner_runs",
)
def a24_automation_savings(runs):
    return R6(ops.automation_savings(runs.selectExpr("event_id % 2 = 0 AS proposed", "event_id % 3 = 0 AS accepted", "success AS verified")), "acceptance_rate", "verification_rate")


@query(
    "SELECT cast(sum(CASE WHEN coalesce(CASE WHEN event_id % 5 > 0 THEN event_id % 4 > 0 END, true) THEN event_id % 10 ELSE 0 END) AS bigint) AS triaged, sum(CASE WHEN coalesce(CASE WHEN event_id % 5 > 0 THEN event_id % 4 > 0 END, true) THEN event_id % 10 ELSE 0 END) * cast(0.5 AS double) AS hours_saved FROM scanner_runs",
    runs="scanner_runs",
)
def a24_triage_savings(runs):
    return ops.triage_savings(runs.selectExpr("CASE WHEN event_id % 5 > 0 THEN event_id % 4 > 0 END AS auto_triaged", "event_id % 10 AS findings_count"))


@query(
    """SELECT CASE WHEN grouping(scanner) = 1 THEN '(all)' ELSE scanner END AS scanner, count(*) AS total, count(*) FILTER (NOT success) AS failed, round(count(*) FILTER (NOT success) / count(*), 6) AS failure_rate
    FROM scanner_runs GROUP BY ROLLUP (scanner)""",
    runs="scanner_runs",
)
def a25_failure_rates(runs):
    return R6(ops.failure_rates(runs), "failure_rate")


@query(
    """WITH t AS (SELECT scanner, cast(min(user_id % 40) + 1 AS double) AS target_seconds FROM scanner_runs GROUP BY 1), d AS (SELECT scanner, avg(duration_seconds) AS a FROM scanner_runs GROUP BY 1)
    SELECT scanner, round(a, 6) AS avg_duration, target_seconds, a <= target_seconds * 1.5 AS passed FROM d JOIN t USING (scanner)""",
    runs="scanner_runs",
)
def a25_timing_targets(runs):
    targets = runs.groupBy("scanner").agg((F.min(F.col("user_id") % 40) + 1).cast("double").alias("target_seconds"))
    return R6(ops.timing_targets(runs, targets), "avg_duration")


SNAPSHOT = "SELECT advisory_id AS cve_id, epss, kev, CASE WHEN cvss_score >= 7 THEN 'high' WHEN cvss_score >= 4 THEN 'medium' END AS severity FROM threat_records WHERE source <> 'epss'"
LATER = "SELECT cve_id, CASE WHEN length(cve_id) + cast(right(cve_id, 1) AS int) > 16 THEN 0.5 ELSE epss END AS epss, kev, CASE WHEN right(cve_id, 1) = '3' THEN NULL ELSE severity END AS severity FROM b WHERE right(cve_id, 2) <> '07'"


@query(
    f"""WITH b AS ({SNAPSHOT} AND right(advisory_id, 2) <> '11'), c AS ({LATER.replace("FROM b", f"FROM ({SNAPSHOT}) AS b")}), j AS (SELECT coalesce(b.cve_id, c.cve_id) AS cve_id, b.cve_id AS bid, c.cve_id AS cid,
      b.epss IS DISTINCT FROM c.epss AS e, b.kev IS DISTINCT FROM c.kev AS k, b.severity IS DISTINCT FROM c.severity AS s FROM b FULL OUTER JOIN c ON b.cve_id = c.cve_id)
    SELECT cve_id, CASE WHEN bid IS NULL THEN 'new' WHEN cid IS NULL THEN 'removed' ELSE 'changed' END AS change,
      CASE WHEN bid IS NULL OR cid IS NULL THEN '' ELSE concat_ws(',', CASE WHEN e THEN 'epss' END, CASE WHEN k THEN 'kev' END, CASE WHEN s THEN 'severity' END) END AS fields
    FROM j WHERE bid IS NULL OR cid IS NULL OR e OR k OR s""",
    records="threat_records",
)
def j21_threat_changes(records):
    spark = records.sparkSession
    whole = spark.sql(SNAPSHOT.replace("threat_records", "{r}"), r=records)
    return ops.threat_changes(whole.where("right(cve_id, 2) <> '11'"), spark.sql(LATER.replace("FROM b", "FROM {b}"), b=whole))


@query(
    """WITH m AS (SELECT scanner AS tool, run_year, avg(confidence) AS precision, count(*) FILTER (status = 'open') / count(*) AS recall, count(*) FILTER (severity = 'high') / count(*) AS f1 FROM findings GROUP BY 1, 2),
    t AS (SELECT tool, run_year, 'precision' AS metric, precision AS v FROM m UNION ALL SELECT tool, run_year, 'recall', recall FROM m UNION ALL SELECT tool, run_year, 'f1', f1 FROM m)
    SELECT a.tool, a.metric, round(a.v, 6) AS was, round(b.v, 6) AS now, round(b.v - a.v, 4) AS delta FROM t AS a JOIN t AS b ON a.tool = b.tool AND a.metric = b.metric AND a.run_year = 1997 AND b.run_year = 1998 WHERE abs(b.v - a.v) > 0.01""",
    findings="findings",
)
def j22_benchmark_drift(findings):
    m = findings.groupBy(F.col("scanner").alias("tool"), "run_year").agg(F.avg("confidence").alias("precision"), (F.count_if(F.col("status") == "open") / F.count("*")).alias("recall"), (F.count_if(F.col("severity") == "high") / F.count("*")).alias("f1"))
    return R6(ops.benchmark_drift(m.where("run_year = 1997"), m.where("run_year = 1998")), "was", "now")
