"""Run, baseline and gate queries: A14, A15, A29, V2, W4, J7, J8, G1 to G3."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import baseline, runs
from ._registry import query
from .findings import FINGERPRINTS, RANKED, canonical

STATES = ", ".join(f"count(*) FILTER (state = '{s}') AS {s.lower()}" for s in runs.STATES)
SEVERITIES = ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in runs.SEVERITIES)
ZEROS = ", ".join(f"coalesce({c}, 0) AS {c}" for c in ["total_findings", *runs.SEVERITIES, "required_scanners", "healthy_scanners", "errors", *[s.lower() for s in runs.STATES]])


def of_runs(findings: DataFrame) -> DataFrame:
    """Findings under the run ids of the bound scanner runs."""
    return findings.withColumn("run_id", F.expr("concat('run-', cast(row_id % 101 AS string))"))


@query(
    f"""WITH f AS (SELECT concat('run-', cast(row_id % 101 AS string)) AS run_id, count(*) AS total_findings, {SEVERITIES} FROM findings GROUP BY 1),
    s AS (SELECT run_id, CASE WHEN count(*) FILTER (required AND NOT healthy) > 0 THEN 'failed' WHEN count(*) FILTER (state = 'PARTIAL') > 0 THEN 'partial' ELSE 'complete' END AS status, cast(min(ts) AS varchar)[1:19] AS started_at, cast(max(ts) AS varchar)[1:19] AS ended_at,
      count(*) FILTER (required) AS required_scanners, count(*) FILTER (healthy) AS healthy_scanners, count(*) FILTER (NOT healthy AND state <> 'SKIPPED') AS errors, {STATES} FROM scanner_runs GROUP BY 1)
    SELECT run_id, coalesce(status, 'complete') AS status, started_at, ended_at, {ZEROS} FROM s FULL OUTER JOIN f USING (run_id)""",
    findings="findings",
    scanners="scanner_runs",
)
def a14_run_summary(findings, scanners):
    out = runs.run_summary(of_runs(findings), scanners)
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("started_at", "ended_at")})


@query(
    """SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'SKIPPED' WHEN event_id % 7 = 0 OR event_id % 5 = 0 THEN 'FAILED_SCANNER' WHEN event_id % 3 = 0 THEN 'PARTIAL' WHEN user_id % 2 = 1 THEN 'FINDINGS' ELSE 'CLEAN' END AS state,
      event_id % 11 > 0 AND event_id % 7 > 0 AND event_id % 5 > 0 AND event_id % 3 > 0 AS healthy FROM scanner_runs""",
    scanners="scanner_runs",
)
def a15_scanner_state(scanners):
    made = scanners.selectExpr("event_id", "event_id % 11 = 0 AS skipped", "event_id % 7 = 0 AS timed_out", "event_id % 5 > 0 AS report_produced", "CASE WHEN event_id % 3 = 0 THEN 'partial' ELSE 'parsed' END AS parser_status", "user_id % 2 AS finding_count")
    return runs.scanner_results(made).select("event_id", "state", "healthy")


@query(
    """WITH f AS (SELECT concat('run-', cast(row_id % 101 AS string)) AS run_id, count(*) FILTER (severity = 'critical') AS g FROM findings GROUP BY 1),
    s AS (SELECT run_id, count(*) FILTER (required AND NOT healthy) AS b FROM scanner_runs GROUP BY 1), j AS (SELECT run_id, coalesce(g, 0) AS gating_findings, coalesce(b, 0) AS required_failures FROM s FULL OUTER JOIN f USING (run_id))
    SELECT *, CASE WHEN gating_findings > 0 THEN 'fail' WHEN required_failures > 0 THEN 'warn' ELSE 'pass' END AS outcome, CASE WHEN gating_findings > 0 THEN 1 ELSE 0 END AS exit_code FROM j""",
    findings="findings",
    scanners="scanner_runs",
)
def v2_threshold_policy(findings, scanners):
    return runs.threshold_policy(of_runs(findings), scanners, fail_on="critical", on_scanner_failure="warn")


@query(
    """WITH f AS (SELECT concat('run-', cast(row_id % 101 AS string)) AS run_id, count(*) FILTER (severity = 'critical') AS g FROM findings GROUP BY 1),
    s AS (SELECT run_id, count(*) FILTER (required AND NOT healthy) AS b, string_agg(DISTINCT CASE WHEN required AND NOT healthy THEN concat(scanner, ' (', state, ')') END, ', ' ORDER BY CASE WHEN required AND NOT healthy THEN concat(scanner, ' (', state, ')') END) AS failed, count(*) % 3 = 0 AS stale, count(*) AS n FROM scanner_runs GROUP BY 1),
    j AS (SELECT run_id, coalesce(g, 0) AS gating_findings, coalesce(b, 0) AS required_failures, failed, coalesce(stale, false) AS stale, n FROM s FULL OUTER JOIN f USING (run_id))
    SELECT concat('policy-result-', left(sha256(concat('{"fail_on":"critical","run_id":"', run_id, '","scanner_failure_policy":"fail","severity_basis":"normalised"}')), 24)) AS policy_result_id, run_id, gating_findings, required_failures,
      CASE WHEN required_failures > 0 OR gating_findings > 0 THEN 'fail' ELSE 'pass' END AS outcome, CASE WHEN required_failures > 0 THEN 2 WHEN gating_findings > 0 THEN 1 ELSE 0 END AS exit_code,
      concat(CASE WHEN required_failures > 0 THEN concat('Required scanner failure: ', failed, '.') WHEN gating_findings > 0 THEN concat(cast(gating_findings AS varchar), ' finding(s) met or exceeded the critical normalised-severity threshold.') ELSE 'No finding met the critical normalised-severity threshold.' END,
        CASE WHEN stale THEN concat(' Warning: ', cast(n AS varchar), ' finding(s) use stale threat data.') ELSE '' END) AS reason, CASE WHEN stale THEN 'stale' WHEN n IS NULL THEN 'not-requested' ELSE 'fresh' END AS threat_data_status FROM j""",
    findings="findings",
    scanners="scanner_runs",
)
def v2_policy_results(findings, scanners):
    n = F.count("*")
    threat = scanners.groupBy("run_id").agg(F.when(n % 3 == 0, "stale").otherwise("fresh").alias("status"), n.alias("stale_findings"))
    return runs.policy_results(of_runs(findings), scanners, threat, fail_on="critical")


@query(
    f"""WITH r AS (SELECT run_id, cast(row_id AS varchar) AS finding_id, severity, cast(row_number() OVER (PARTITION BY run_id ORDER BY {RANKED} DESC, cast(row_id AS varchar)) AS int) AS place, greatest(count(*) OVER (PARTITION BY run_id) - 10, 0) AS more FROM findings)
    SELECT run_id, place, finding_id, severity, more FROM r WHERE place <= 10""",
    findings="findings",
)
def w4_top_findings(findings):
    return runs.top_findings(findings.withColumn("finding_id", F.col("row_id").cast("string")))


NOW_YEAR, COMPARED_AT = 1998, 1998 * 372 * 86400.0


def year(findings: DataFrame, y: int) -> DataFrame:
    """The least row of each fingerprint of a year, with the columns that comparison reads."""
    one = canonical(findings.where(F.col("run_year") == y)).groupBy("repository", "fingerprint").agg(F.min_by(F.struct("severity", "reachability", "status", "dep_name", "row_id", "resolved_at"), "row_id").alias("x"))
    return one.select("repository", "fingerprint", "x.*").withColumns(
        {"kev_status": F.col("row_id") % 17 == 0, "known_exploitation_date": F.when(F.col("row_id") % 19 == 0, "2024-01-01"), "public_exploit": F.lit(None).cast("boolean"), "suppression_expiry": F.col("resolved_at")}
    )


def changes(findings: DataFrame) -> DataFrame:
    return baseline.diff(year(findings, NOW_YEAR - 1), year(findings, NOW_YEAR), COMPARED_AT)


RK = RANKED.replace("severity", "{0}.severity")
DIFF = f"""{FINGERPRINTS}, y AS (SELECT *, row_id % 17 = 0 OR row_id % 19 = 0 AS ex, row_number() OVER (PARTITION BY repository, fingerprint, run_year ORDER BY row_id) AS p FROM canon),
    b AS (SELECT * FROM y WHERE p = 1 AND run_year = {NOW_YEAR - 1}), c AS (SELECT * FROM y WHERE p = 1 AND run_year = {NOW_YEAR}),
    changes AS (SELECT repository, fingerprint, CASE WHEN b.row_id IS NULL THEN 'new' WHEN c.row_id IS NULL THEN 'removed' ELSE 'persisting' END AS presence,
      coalesce({RK.format("c")} > {RK.format("b")} AND b.row_id IS NOT NULL AND c.row_id IS NOT NULL, false) AS worsened,
      coalesce(b.row_id IS NOT NULL AND c.reachability = 'reachable' AND b.reachability <> 'reachable', false) AS newly_reachable,
      coalesce(c.dep_name IS NOT NULL AND NOT b.ex AND c.ex, false) AS newly_exploited, coalesce(c.status = 'suppressed' AND c.resolved_at <= {COMPARED_AT}, false) AS expired_suppression, c.severity AS severity
      FROM b FULL OUTER JOIN c USING (repository, fingerprint))"""


@query(f"WITH {DIFF} SELECT * FROM changes", findings="findings")
def j7_baseline_diff(findings):
    return changes(findings)


REGRESSED = """latest AS (SELECT concat('repo-', cast(user_id % 60 AS string)) AS repository, scanner, event_id % 2 AS half, arg_max(state, event_id) AS state, arg_max(healthy, event_id) AS healthy FROM scanner_runs GROUP BY 1, 2, 3),
    regressions AS (SELECT b.repository, b.scanner, b.state AS baseline_state, a.state AS current_state, CASE WHEN a.healthy IS NULL THEN 'previously healthy scanner is missing' ELSE 'previously healthy scanner is now unhealthy' END AS reason
      FROM latest AS b LEFT JOIN latest AS a ON a.repository = b.repository AND a.scanner = b.scanner AND a.half = 1 WHERE b.half = 0 AND b.healthy AND (a.healthy IS NULL OR NOT a.healthy))"""


def regressions(scanners: DataFrame) -> DataFrame:
    latest = scanners.groupBy(F.expr("concat('repo-', cast(user_id % 60 AS string))").alias("repository"), "scanner", (F.col("event_id") % 2).alias("half")).agg(F.max_by("state", "event_id").alias("state"), F.max_by("healthy", "event_id").alias("healthy"))
    return baseline.coverage_regressions(latest.where("half = 0"), latest.where("half = 1"), ("repository",))


@query(f"WITH {REGRESSED} SELECT * FROM regressions", scanners="scanner_runs")
def j8_coverage_regressions(scanners):
    return regressions(scanners)


REASONS = """concat_ws(',', CASE WHEN presence = 'new' THEN 'new' END, CASE WHEN worsened THEN 'worsened' END, CASE WHEN newly_reachable THEN 'newly_reachable' END, CASE WHEN newly_exploited THEN 'newly_exploited' END, CASE WHEN expired_suppression THEN 'expired_suppression' END)"""
BLOCKED = f"""{DIFF}, chosen AS (SELECT *, {REASONS} AS reasons FROM changes WHERE presence <> 'removed'), blocked AS (SELECT repository, fingerprint, severity, reasons FROM chosen WHERE reasons <> '' AND severity IN ('critical', 'high'))"""


@query(f"WITH {BLOCKED} SELECT * FROM blocked", findings="findings", scanners="scanner_runs")
def g1_blocked_findings(findings, scanners):
    return baseline.gate(changes(findings), regressions(scanners), mode="worsened")[0]


GATED = f"""{BLOCKED}, {REGRESSED}, r AS (SELECT repository FROM changes UNION SELECT repository FROM regressions UNION SELECT concat('repo-', cast(user_id % 70 AS string)) FROM scanner_runs), k AS (SELECT repository, count(*) AS candidates FROM chosen WHERE reasons <> '' GROUP BY 1),
    x AS (SELECT repository, count(*) AS blocked FROM blocked GROUP BY 1), z AS (SELECT repository, count(*) AS regressions FROM regressions GROUP BY 1),
    gated AS (SELECT repository, coalesce(candidates, 0) AS candidates, coalesce(blocked, 0) AS blocked, coalesce(regressions, 0) AS regressions, coalesce(blocked, 0) = 0 AND coalesce(regressions, 0) = 0 AS passed
    FROM r LEFT JOIN k USING (repository) LEFT JOIN x USING (repository) LEFT JOIN z USING (repository))"""


def gated(findings: DataFrame, scanners: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The gate over everything that changed; some repositories were scanned without any finding."""
    scanned = scanners.select(F.expr("concat('repo-', cast(user_id % 70 AS string))").alias("repository")).distinct()
    return baseline.gate(changes(findings), regressions(scanners), mode="worsened", runs=scanned)


@query(f"WITH {GATED} SELECT * FROM gated", findings="findings", scanners="scanner_runs")
def g1_gate(findings, scanners):
    return gated(findings, scanners)[1]


@query(
    f"""WITH {GATED}, f AS (SELECT * FROM y WHERE p = 1 AND run_year = {NOW_YEAR}), m AS (SELECT repository, fingerprint FROM f WHERE severity = 'critical' AND reachability = 'reachable'),
    o AS (SELECT repository, CASE WHEN count(*) FILTER (severity = 'critical' AND reachability = 'reachable') > 4 THEN 'fail' WHEN count(*) FILTER (severity = 'critical' AND reachability = 'reachable') > 0 THEN 'warn' ELSE 'pass' END AS outcome FROM f GROUP BY 1),
    n AS (SELECT f.repository, count(*) AS total, count(*) FILTER (presence = 'new') AS new, count(*) FILTER ((f.repository, f.fingerprint) IN (SELECT (repository, fingerprint) FROM m) OR (f.repository, f.fingerprint) IN (SELECT (repository, fingerprint) FROM blocked)) AS blocking,
      count(*) FILTER (status = 'suppressed') AS suppressed, count(*) FILTER (row_id % 3 = 0) AS unscored FROM f JOIN changes USING (repository, fingerprint) GROUP BY 1)
    SELECT repository, coalesce(total, 0) AS total, coalesce(new, 0) AS new, coalesce(blocking, 0) AS blocking, coalesce(suppressed, 0) AS suppressed, coalesce(unscored, 0) AS unscored, CASE WHEN outcome = 'fail' OR NOT passed THEN 'FAIL' WHEN outcome = 'warn' THEN 'WARN' ELSE 'PASS' END AS decision
    FROM gated LEFT JOIN n USING (repository) LEFT JOIN o USING (repository)""",
    findings="findings",
    scanners="scanner_runs",
)
def a29_check_counts(findings, scanners):
    made, current = changes(findings), year(findings, NOW_YEAR).withColumn("confidence", F.when(F.col("row_id") % 3 > 0, 0.5))
    blocked, passed = gated(findings, scanners)
    hit = (F.col("severity") == "critical") & (F.col("reachability") == "reachable")
    n = F.count_if(hit)
    policy = current.groupBy("repository").agg(F.when(n > 4, "fail").when(n > 0, "warn").otherwise("pass").alias("outcome"))
    return runs.check_counts(current, made, current.where(hit), blocked, policy, passed)


RUNS = "SELECT run_id, repository, CASE WHEN run_year % 3 = 0 THEN 'dev' ELSE 'main' END AS ref FROM findings GROUP BY 1, 2, 3"


def with_refs(findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    return canonical(findings), findings.sparkSession.sql(RUNS.replace("findings", "{f}"), f=findings)


@query(
    f"""WITH {FINGERPRINTS}, r AS ({RUNS}), k AS (SELECT run_id, repository, fingerprint, count(*) AS n FROM canon JOIN r USING (run_id, repository) WHERE ref = 'main' GROUP BY 1, 2, 3)
    SELECT run_id, count(*) AS findings FROM k WHERE n = 1 GROUP BY 1""",
    findings="findings",
)
def g2_create_baselines(findings):
    return baseline.create_baselines(*with_refs(findings))[0].groupBy("run_id").agg(F.count("*").alias("findings"))


@query(
    f"""WITH {FINGERPRINTS}, r AS ({RUNS}) SELECT run_id, NULL AS fingerprint, 'not the default branch' AS reason FROM r WHERE ref <> 'main'
    UNION ALL SELECT run_id, fingerprint, 'duplicate fingerprint' FROM canon JOIN r USING (run_id, repository) WHERE ref = 'main' GROUP BY 1, 2 HAVING count(*) > 1""",
    findings="findings",
)
def g2_rejected_baselines(findings):
    return baseline.create_baselines(*with_refs(findings))[1]


@query(
    f"""WITH {FINGERPRINTS}, a AS (SELECT DISTINCT repository, fingerprint FROM canon WHERE run_year = {NOW_YEAR - 1}), b AS (SELECT DISTINCT repository, fingerprint FROM canon WHERE run_year = {NOW_YEAR})
    SELECT repository, fingerprint, CASE WHEN b.repository IS NULL THEN 'removed' WHEN a.repository IS NULL THEN 'new' ELSE 'persisting' END AS member FROM a FULL OUTER JOIN b USING (repository, fingerprint)""".replace("b.repository IS NULL", "b.fingerprint IS NULL").replace("a.repository IS NULL", "a.fingerprint IS NULL"),
    findings="findings",
)
def g3_fingerprint_sets(findings):
    return baseline.fingerprint_sets(canonical(findings.where(F.col("run_year") == NOW_YEAR - 1)), canonical(findings.where(F.col("run_year") == NOW_YEAR)))
