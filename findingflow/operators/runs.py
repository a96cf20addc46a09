"""Scan runs: scanner states, summaries and the threshold policy of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import json_text
from ..functions.severity import THRESHOLD, rank

SEVERITIES = ("critical", "high", "medium", "low", "info", "unknown")
STATES = ("CLEAN", "FINDINGS", "FAILED_SCANNER", "PARTIAL", "SKIPPED")


def scanner_state() -> Column:
    """State of a scanner execution from its metadata, its report and how the report was read."""
    return (
        F.when(F.coalesce("skipped", F.lit(False)), "SKIPPED")
        .when(F.coalesce("timed_out", F.lit(False)) | ~F.coalesce("report_produced", F.lit(False)), "FAILED_SCANNER")
        .when(F.col("parser_status") == "failed", "FAILED_SCANNER")
        .when(F.col("parser_status") == "partial", "PARTIAL")
        .when(F.coalesce("finding_count", F.lit(0)) > 0, "FINDINGS")
        .otherwise("CLEAN")
    )


def scanner_results(executions: DataFrame) -> DataFrame:
    """Executions with ``state`` and ``healthy``: clean or with findings."""
    return executions.withColumn("state", scanner_state()).withColumn("healthy", F.col("state").isin("CLEAN", "FINDINGS"))


def run_summary(findings: DataFrame, scanners: DataFrame) -> DataFrame:
    """One row per run: status, span, totals, counts by severity and by scanner state, errors.

    A run fails with an unhealthy required scanner, else is partial with a partial one. Other severities count as
    unknown. Runs without findings appear; findings of runs without scanners too.
    """
    known = F.when(F.coalesce("severity", F.lit("unknown")).isin(*SEVERITIES), F.col("severity")).otherwise("unknown")
    f = findings.groupBy("run_id").agg(F.count("*").alias("total_findings"), *[F.count_if(known == s).alias(s) for s in SEVERITIES])
    failing = F.count_if(F.col("required") & ~F.col("healthy"))
    s = scanners.groupBy("run_id").agg(
        F.when(failing > 0, "failed").when(F.count_if(F.col("state") == "PARTIAL") > 0, "partial").otherwise("complete").alias("status"),
        F.min("ts").alias("started_at"),
        F.max("ts").alias("ended_at"),
        F.count_if("required").alias("required_scanners"),
        F.count_if("healthy").alias("healthy_scanners"),
        F.count_if(~F.col("healthy") & (F.col("state") != "SKIPPED")).alias("errors"),
        *[F.count_if(F.col("state") == x).alias(x.lower()) for x in STATES],
    )
    joined = s.join(f, "run_id", "full_outer")
    counts = ["total_findings", *SEVERITIES, "required_scanners", "healthy_scanners", "errors", *[x.lower() for x in STATES]]
    return joined.fillna(0, counts).fillna("complete", ["status"])


def threshold_policy(findings: DataFrame, scanners: DataFrame, fail_on: str = "high", on_scanner_failure: str = "fail", severity: str = "severity") -> DataFrame:
    """Outcome and exit code per run: scanner failure under ``fail`` (2), findings at the threshold (1), failure under ``warn``, else pass."""
    gating = F.lit(False) if fail_on == "none" else rank(F.col(severity)) >= THRESHOLD[fail_on]
    f = findings.groupBy("run_id").agg(F.count_if(gating).alias("gating_findings"))
    s = scanners.groupBy("run_id").agg(F.count_if(F.col("required") & ~F.col("healthy")).alias("required_failures"))
    both = s.join(f, "run_id", "full_outer").fillna(0, ["gating_findings", "required_failures"])
    broken, hit = F.col("required_failures") > 0, F.col("gating_findings") > 0
    stop, warn = F.lit(on_scanner_failure == "fail"), F.lit(on_scanner_failure == "warn")
    outcome = F.when(broken & stop, "fail").when(hit, "fail").when(broken & warn, "warn").otherwise("pass")
    return both.select("run_id", "gating_findings", "required_failures", outcome.alias("outcome"), F.when(broken & stop, 2).when(hit, 1).otherwise(0).alias("exit_code"))


def policy_results(findings: DataFrame, scanners: DataFrame, threat_data: DataFrame, fail_on: str = "high", on_scanner_failure: str = "fail", severity: str = "severity", basis: str = "normalised") -> DataFrame:
    """``threshold_policy`` with the reason of each outcome, a warning about stale threat data, and the result's id.

    ``threat_data`` has status and stale_findings per run; runs without a row did not ask for any.
    """
    judged = threshold_policy(findings, scanners, fail_on, on_scanner_failure, severity)
    failed = F.when(F.col("required") & ~F.col("healthy"), F.concat("scanner", F.lit(" ("), "state", F.lit(")")))
    names = scanners.groupBy("run_id").agg(F.array_join(F.array_sort(F.collect_set(failed)), ", ").alias("failed"))
    joined = judged.join(names, "run_id", "left").join(threat_data.select("run_id", "status", "stale_findings"), "run_id", "left")
    broken = F.col("required_failures") > 0
    reason = (
        F.when(broken & F.lit(on_scanner_failure == "fail"), F.concat(F.lit("Required scanner failure: "), "failed", F.lit(".")))
        .when(F.col("gating_findings") > 0, F.concat(F.col("gating_findings").cast("string"), F.lit(f" finding(s) met or exceeded the {fail_on} {basis}-severity threshold.")))
        .when(broken & F.lit(on_scanner_failure == "warn"), F.concat(F.lit("Required scanner failure was allowed by warn policy: "), "failed", F.lit(".")))
        .otherwise("Finding severity gating is disabled." if fail_on == "none" else f"No finding met the {fail_on} {basis}-severity threshold.")
    )
    status = F.coalesce("status", F.lit("not-requested"))
    stale = F.when(status == "stale", F.concat(F.lit(" Warning: "), F.col("stale_findings").cast("string"), F.lit(" finding(s) use stale threat data."))).otherwise("")
    identity = F.concat(F.lit(f'{{"fail_on":"{fail_on}","run_id":'), json_text(F.col("run_id")), F.lit(f',"scanner_failure_policy":"{on_scanner_failure}","severity_basis":"{basis}"}}'))
    result = F.concat(F.lit("policy-result-"), F.substring(F.sha2(identity, 256), 1, 24))
    return joined.select(result.alias("policy_result_id"), *judged.columns, F.concat(reason, stale).alias("reason"), status.alias("threat_data_status"))


def check_counts(findings: DataFrame, changes: DataFrame, matched: DataFrame, blocked: DataFrame, policy: DataFrame, gate: DataFrame) -> DataFrame:
    """Per repository: total, new, blocking, suppressed and unscored findings, and the decision.

    ``matched`` and ``blocked`` (repository, fingerprint) are what the policy matched and the gate blocked; blocking
    counts findings of either, once. ``policy`` has each repository's outcome, ``gate`` whether it passed. FAIL if the
    policy fails or errs or the gate did not pass, for lost coverage too; WARN if the policy warns; else PASS. Every
    repository of ``findings``, ``policy`` or ``gate`` has a row, so a gate that failed without findings is seen.
    """
    new = changes.where("presence = 'new'").select("repository", "fingerprint").distinct().withColumn("is_new", F.lit(1))
    stops = matched.select("repository", "fingerprint").unionByName(blocked.select("repository", "fingerprint")).distinct().withColumn("stops", F.lit(1))
    marked = findings.join(stops, ["repository", "fingerprint"], "left").join(new, ["repository", "fingerprint"], "left")
    counted = marked.groupBy("repository").agg(
        F.count("*").alias("total"), F.count("is_new").alias("new"), F.count("stops").alias("blocking"), F.count_if(F.col("status") == "suppressed").alias("suppressed"), F.count_if(F.col("confidence").isNull()).alias("unscored")
    )
    joined = counted.join(policy.select("repository", "outcome"), "repository", "full_outer").join(gate.select("repository", "passed"), "repository", "full_outer").fillna(0, ["total", "new", "blocking", "suppressed", "unscored"])
    decision = F.when(F.col("outcome").isin("fail", "error") | ~F.coalesce("passed", F.lit(True)), "FAIL").when(F.col("outcome") == "warn", "WARN").otherwise("PASS")
    return joined.select("repository", "total", "new", "blocking", "suppressed", "unscored", decision.alias("decision"))


def top_findings(findings: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` most severe findings of each run (then least id), with how many more there are."""
    by_run = Window.partitionBy("run_id")
    place = F.row_number().over(by_run.orderBy(rank(F.col("severity")).desc(), "finding_id"))
    sized = findings.groupBy("run_id").agg(F.greatest(F.count("*") - n, F.lit(0)).alias("more"))
    return findings.withColumn("place", place).where(F.col("place") <= n).join(sized, "run_id").select("run_id", "place", "finding_id", "severity", "more")
