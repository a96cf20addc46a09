"""Comparison of a run with its baseline, and the gate on what changed. All joins are equi-joins on (repository, fingerprint)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.severity import THRESHOLD, rank

KEY = ("repository", "fingerprint")
# Policy outcomes that block a release.
BLOCKING = ("BLOCK_IMMEDIATELY", "FIX_BEFORE_RELEASE", "INSUFFICIENT_EVIDENCE")


def exploited(side: str) -> Column:
    return F.coalesce(F.col(f"{side}.kev_status"), F.lit(False)) | (F.coalesce(F.col(f"{side}.known_exploitation_date"), F.lit("")) != "") | F.coalesce(F.col(f"{side}.public_exploit"), F.lit(False))


COMPARED = ("severity", "reachability", "status", "dep_name", "kev_status", "known_exploitation_date", "public_exploit", "suppression_expiry")


def split_repeats(findings: DataFrame, key: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is unique, and rejects: one row per repeated key with its count. A repeat is an error, never one of several."""
    counts = findings.groupBy(*key).count()
    return findings.join(counts.where("count = 1"), list(key), "left_semi"), counts.where("count > 1")


def diff(baseline: DataFrame, current: DataFrame, compared_at: float, key: tuple[str, ...] = KEY) -> DataFrame:
    """Every fingerprint of either side with presence (new, removed, persisting) and what else changed, as booleans."""
    b = baseline.select(*key, F.struct(*COMPARED).alias("was"))
    c = current.select(*key, F.struct(*COMPARED).alias("now"))
    both = F.col("was").isNotNull() & F.col("now").isNotNull()
    safe = lambda x: F.coalesce(x, F.lit(False))
    expired = (F.col("now.status") == "suppressed") & (F.col("now.suppression_expiry") <= compared_at)
    return b.join(c, list(key), "full_outer").select(
        *key,
        F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "removed").otherwise("persisting").alias("presence"),
        safe(both & (rank(F.col("now.severity")) > rank(F.col("was.severity")))).alias("worsened"),
        safe(both & (F.col("now.reachability") == "reachable") & ~F.col("was.reachability").eqNullSafe(F.lit("reachable"))).alias("newly_reachable"),
        safe(both & F.col("now.dep_name").isNotNull() & ~exploited("was") & exploited("now")).alias("newly_exploited"),
        safe(expired).alias("expired_suppression"),
        F.col("now.severity").alias("severity"),
    )


def coverage_regressions(before: DataFrame, after: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Scanners (keys and scanner) that were healthy and are missing or unhealthy now."""
    b = before.where("healthy").select(*keys, "scanner", F.col("state").alias("baseline_state"))
    a = after.select(*keys, "scanner", F.col("state").alias("current_state"), F.coalesce("healthy", F.lit(False)).alias("healthy"))
    reason = F.when(F.col("healthy").isNull(), "previously healthy scanner is missing").otherwise("previously healthy scanner is now unhealthy")
    return b.join(a, [*keys, "scanner"], "left").where("healthy is null or not healthy").select(*keys, "scanner", "baseline_state", "current_state", reason.alias("reason"))


def gate(
    changes: DataFrame, regressions: DataFrame, mode: str = "new", fail_on: str = "high", enforce_legacy: bool = False, policy: DataFrame | None = None, runs: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(blocked rows with their reasons, one row per repository with counts and whether it passed).

    Mode ``new`` looks at new findings, ``worsened`` and ``policy`` at everything that changed, ``all`` (or
    ``enforce_legacy``) at all. Policy mode blocks by ``policy`` (key, outcome), the others by severity. A repository
    of ``changes``, ``regressions`` or ``runs`` (all that were scanned) has a row: without findings it passes only if
    no coverage was lost.
    """
    reasons = F.array_compact(
        F.array(
            F.when(F.col("presence") == "new", "new"), F.when(F.col("worsened"), "worsened"), F.when(F.col("newly_reachable"), "newly_reachable"),
            F.when(F.col("newly_exploited"), "newly_exploited"), F.when(F.col("expired_suppression"), "expired_suppression"),
        )
    )
    whole = mode == "all" or enforce_legacy
    legacy = F.when(F.size("reasons") == 0, F.array(F.lit("legacy"))).otherwise(F.col("reasons")) if whole else F.col("reasons")
    candidate = F.array_contains("reasons", "new") if mode == "new" and not whole else F.size("reasons") > 0
    judged = changes.withColumn("reasons", reasons).withColumn("reasons", legacy).withColumn("candidate", (F.col("presence") != "removed") & candidate)
    if mode == "policy":
        if policy is None:
            raise ValueError("mode policy needs the outcomes of a policy")
        stops = policy.where(F.col("outcome").isin(*BLOCKING)).select(*KEY).distinct().withColumn("stops", F.lit(True))
        judged = judged.join(stops, list(KEY), "left").withColumn("reasons", F.array_append("reasons", F.lit("policy"))).withColumn("blocked", F.col("candidate") & F.coalesce("stops", F.lit(False)))
    else:
        judged = judged.withColumn("blocked", F.col("candidate") & (rank(F.col("severity")) >= THRESHOLD[fail_on]))
    blocked = judged.where("blocked").select(*KEY, "severity", F.array_join("reasons", ",").alias("reasons"))
    zero = F.lit(0)
    parts = [judged.select("repository", F.col("candidate").cast("int").alias("candidates"), F.col("blocked").cast("int").alias("blocked"), zero.alias("regressions"))]
    parts.append(regressions.select("repository", zero, zero, F.lit(1)))
    if runs is not None:
        parts.append(runs.select("repository", zero, zero, zero))
    every = parts[0]
    for part in parts[1:]:
        every = every.union(part)
    counted = every.groupBy("repository").agg(*[F.sum(c).alias(c) for c in ("candidates", "blocked", "regressions")])
    return blocked, counted.withColumn("passed", (F.col("blocked") == 0) & (F.col("regressions") == 0))


def create_baselines(findings: DataFrame, runs: DataFrame, default_ref: str = "main") -> tuple[DataFrame, DataFrame]:
    """Baselines from runs of the default branch; rejects: (run_id, fingerprint, reason) for other branches and repeats."""
    ok = runs.where(F.col("ref") == default_ref).select("run_id", "repository")
    wrong = runs.where(~F.col("ref").eqNullSafe(F.lit(default_ref))).select("run_id", F.lit(None).cast("string").alias("fingerprint"), F.lit("not the default branch").alias("reason"))
    unique, repeats = split_repeats(findings.join(ok, ["run_id", "repository"]), ("run_id", "repository", "fingerprint"))
    return unique, wrong.unionByName(repeats.select("run_id", "fingerprint", F.lit("duplicate fingerprint").alias("reason")))


def fingerprint_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    """Keys only in a (removed), only in b (new) and in both (persisting), by set operations."""
    x, y = a.select(*KEY), b.select(*KEY)
    tag = lambda df, name: df.withColumn("member", F.lit(name))
    return tag(x.subtract(y), "removed").unionByName(tag(y.subtract(x), "new")).unionByName(tag(x.intersect(y), "persisting"))
