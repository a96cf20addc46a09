"""Measures over many repositories. Every grouping is an ordinary aggregate with partial sums, so a giant repository is no hot task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.severity import RANK

SEVERITIES = ("critical", "high", "medium", "low", "info")
# What one open finding of each severity adds to a risk score.
WEIGHTS = {"critical": 10, "high": 5, "medium": 2, "low": 1, "info": 0}
WEEK = 7 * 86400.0


def severity_name() -> Column:
    """Lower-case severity; a missing one counts as info."""
    return F.lower(F.coalesce("severity", F.lit("info")))


def severity_counts() -> list[Column]:
    return [F.count_if(severity_name() == s).alias(s) for s in SEVERITIES]


def risk() -> Column:
    return F.coalesce(F.sum(sum((F.when(severity_name() == s, w).otherwise(0) for s, w in WEIGHTS.items()), F.lit(0))), F.lit(0))


def share(part: Column, whole: Column, empty: float = 0.0) -> Column:
    return F.when(whole == 0, F.lit(empty)).otherwise(part / whole)


def multi_repository_dashboard(findings: DataFrame) -> DataFrame:
    """Totals by severity per repository and over all (``(all)``). Severities outside the five count in the total only."""
    name = F.when(F.grouping("repository") == 1, "(all)").otherwise(F.coalesce("repository", F.lit("unknown")))
    return findings.rollup("repository").agg(name.alias("name"), F.count("*").alias("total"), *severity_counts()).select(F.col("name").alias("repository"), "total", *SEVERITIES)


def organisation_risk(findings: DataFrame, top: int = 5) -> DataFrame:
    """Risk score and totals per organisation with its ``top`` riskiest repositories; ties go by repository name."""
    per = findings.groupBy("organisation", "repository").agg(risk().alias("risk"), F.count("*").alias("total"))
    place = F.row_number().over(Window.partitionBy("organisation").orderBy(F.desc("risk"), "repository"))
    ranked = per.withColumn("place", place)
    highest = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("place") <= top, F.struct("place", "repository")))), lambda r: r["repository"]), ",")
    return ranked.groupBy("organisation").agg(F.sum("risk").alias("risk_score"), F.sum("total").alias("total"), highest.alias("highest"))


def repository_trends(findings: DataFrame, at: str = "run_year") -> DataFrame:
    """First and last snapshot totals per repository by ``at``, and the direction between them."""
    totals = findings.groupBy("repository", at).agg(F.count("*").alias("total"))
    ends = totals.groupBy("repository").agg(F.count("*").alias("snapshots"), F.min_by("total", at).alias("first_total"), F.max_by("total", at).alias("last_total"))
    direction = F.when(F.col("last_total") < F.col("first_total"), "improving").when(F.col("last_total") > F.col("first_total"), "worsening").otherwise("stable")
    return ends.withColumn("direction", direction)


def trend_points(findings: DataFrame, at: str = "run_year") -> DataFrame:
    """Totals and counts by severity of each snapshot of a repository; other severities count as unknown."""
    known = F.when(F.col("severity").isin(*RANK), F.col("severity")).otherwise("unknown")
    return findings.groupBy("repository", at).agg(F.count("*").alias("total"), *[F.count_if(known == s).alias(s) for s in RANK])


def scanner_health(runs: DataFrame) -> DataFrame:
    """Runs, successes, mean duration of those that have one, and versions seen per scanner."""
    wins = F.count_if(F.coalesce("success", F.lit(False)))
    versions = F.array_join(F.sort_array(F.collect_set(F.coalesce("version", F.lit("unknown")))), ",")
    return runs.groupBy("scanner").agg(
        F.count("*").alias("total_runs"), wins.alias("successes"), (F.count("*") - wins).alias("failures"), (wins / F.count("*")).alias("success_rate"), F.avg("duration_seconds").alias("avg_duration"), versions.alias("versions")
    )


def policy_compliance(evaluations: DataFrame) -> DataFrame:
    """Share of passed evaluations per policy and over all; 1.0 where there is none."""
    passed = F.count_if(F.coalesce("passed", F.lit(False)))
    name = F.when(F.grouping("policy") == 1, "(all)").otherwise(F.coalesce("policy", F.lit("unknown")))
    out = evaluations.rollup("policy").agg(name.alias("name"), F.count("*").alias("total"), passed.alias("passed"))
    return out.select(F.col("name").alias("policy"), "total", "passed", share(F.col("passed"), F.col("total"), 1.0).alias("rate"))


def mean_time_to_remediation(findings: DataFrame) -> DataFrame:
    """Mean days from opening to resolution, per severity and over all (null severity name ``(all)``)."""
    done = findings.where("opened_at is not null and resolved_at is not null").withColumn("severity", severity_name())
    name = F.when(F.grouping("severity") == 1, "(all)").otherwise(F.col("severity"))
    out = done.rollup("severity").agg(name.alias("name"), F.count("*").alias("sample_size"), (F.avg(F.col("resolved_at") - F.col("opened_at")) / 86400).alias("mttr_days"))
    return out.select(F.col("name").alias("severity"), "sample_size", "mttr_days")


def ownership(findings: DataFrame) -> DataFrame:
    """Findings per owner; null, empty and ``unknown`` owners are one row ``(unassigned)``."""
    owner = F.when(F.coalesce("owner", F.lit("")).isin("", "unknown"), "(unassigned)").otherwise(F.col("owner"))
    still = F.count_if(~F.col("status").eqNullSafe(F.lit("resolved")))
    return findings.groupBy(owner.alias("owner_name")).agg(F.count("*").alias("total"), *severity_counts(), still.alias("open")).withColumnRenamed("owner_name", "owner")


def suppression_expiry(suppressions: DataFrame, now: float) -> DataFrame:
    """How many suppressions are active, expired (at or before now) and expiring within seven days; and the expired share."""
    at = F.col("expires_at")
    expired, soon = F.count_if(at <= now), F.count_if((at > now) & (at <= now + WEEK))
    out = suppressions.agg(F.count("*").alias("total"), expired.alias("expired"), soon.alias("expiring_soon"), (F.count("*") - expired - soon).alias("active"))
    return out.withColumn("expired_rate", share(F.col("expired"), F.col("total")))


CLOSED, OPEN = ("resolved", "false_positive", "closed"), ("open", "acknowledged")


def reopened_rate(history: DataFrame, keys: tuple[str, ...] = ("repository", "fingerprint")) -> DataFrame:
    """Findings that were ever closed, and those of them that were open again later."""
    state = F.lower("to_state")
    per = history.groupBy(*keys).agg(F.min(F.when(state.isin(*CLOSED), F.col("sequence"))).alias("closed"), F.max(F.when(state.isin(*OPEN), F.col("sequence"))).alias("opened"))
    out = per.agg(F.count("closed").alias("resolved"), F.count_if(F.col("opened") > F.col("closed")).alias("reopened"))
    return out.withColumn("rate", share(F.col("reopened"), F.col("resolved")))


def automation_savings(remediations: DataFrame, hours_per_fix: float = 2.0) -> DataFrame:
    """Acceptance and verification rates of automatic fixes and the hours they saved."""
    yes = lambda *c: F.count_if(F.expr(" and ".join(f"coalesce({x}, false)" for x in c)))
    out = remediations.agg(yes("proposed").alias("proposed"), yes("proposed", "accepted").alias("accepted_of_proposed"), yes("accepted").alias("accepted"), yes("accepted", "verified").alias("verified"))
    return out.select(
        "*",
        share(F.col("accepted_of_proposed"), F.col("proposed")).alias("acceptance_rate"),
        share(F.col("verified"), F.col("accepted")).alias("verification_rate"),
        F.bround(F.col("verified") * F.lit(hours_per_fix), 1).alias("hours_saved"),
    )


def triage_savings(runs: DataFrame, hours_per_triage: float = 0.5) -> DataFrame:
    """Findings triaged without a person, and the hours saved; runs count as automatic unless they say otherwise."""
    triaged = F.coalesce(F.sum(F.when(F.coalesce("auto_triaged", F.lit(True)), F.coalesce("findings_count", F.lit(0)))), F.lit(0))
    return runs.agg(triaged.alias("triaged")).withColumn("hours_saved", F.bround(F.col("triaged") * F.lit(hours_per_triage), 1))


def failure_rates(runs: DataFrame) -> DataFrame:
    """Failed runs per scanner and over all."""
    name = F.when(F.grouping("scanner") == 1, "(all)").otherwise(F.col("scanner"))
    failed = F.count_if(~F.coalesce("success", F.lit(False)))
    return runs.rollup("scanner").agg(name.alias("name"), F.count("*").alias("total"), failed.alias("failed"), (failed / F.count("*")).alias("failure_rate")).select(F.col("name").alias("scanner"), "total", "failed", "failure_rate")


def timing_targets(runs: DataFrame, targets: DataFrame, factor: float = 1.5) -> DataFrame:
    """Mean duration per scanner against its target times ``factor``; scanners without a target are left out."""
    took = runs.where("duration_seconds is not null").groupBy("scanner").agg(F.avg("duration_seconds").alias("avg_duration"))
    return took.join(targets, "scanner").select("scanner", "avg_duration", "target_seconds", (F.col("avg_duration") <= F.col("target_seconds") * factor).alias("passed"))


def threat_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Advisories that are new, removed, or changed in epss, kev or severity between two snapshots keyed by cve_id."""
    fields = ("epss", "kev", "severity")
    b, a = before.select("cve_id", F.struct(*fields).alias("was")), after.select("cve_id", F.struct(*fields).alias("now"))
    change = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "removed").when(~F.col("was").eqNullSafe(F.col("now")), "changed")
    what = F.concat_ws(",", *[F.when(F.col("was").isNotNull() & F.col("now").isNotNull() & ~F.col(f"was.{f}").eqNullSafe(F.col(f"now.{f}")), f) for f in fields])
    return b.join(a, "cve_id", "full_outer").select("cve_id", change.alias("change"), what.alias("fields")).where("change is not null")


def benchmark_drift(before: DataFrame, after: DataFrame, threshold: float = 0.01) -> DataFrame:
    """Tool metrics that moved by more than ``threshold`` between two evaluations."""
    metrics = ("precision", "recall", "f1")
    tall = lambda df, as_: df.select("tool", F.explode(F.create_map(*[x for m in metrics for x in (F.lit(m), F.col(m))])).alias("metric", as_))
    both = tall(before, "was").join(tall(after, "now"), ["tool", "metric"])
    return both.where(F.abs(F.col("now") - F.col("was")) > threshold).withColumn("delta", F.bround(F.col("now") - F.col("was"), 4))
