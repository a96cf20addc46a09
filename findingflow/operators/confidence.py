"""Confidence of findings from rule posteriors and recorded evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .benchmark import maturity, tier

# Fixed values: (estimate, bound) by reachability state, exploit evidence and remediation references.
REACHABILITY = {"reachable": (0.9, 0.7), "potentially_reachable": (0.6, 0.35), "unreachable": (0.1, 0.02)}
EXPLOIT_VALIDATED, EXPLOIT_OTHER, REMEDIATION = (0.8, 0.6), (0.6, 0.35), (0.7, 0.5)


def pair(when: Column, value: tuple[float, float]) -> Column:
    return F.when(when, F.struct(F.lit(value[0]).alias("estimate"), F.lit(value[1]).alias("bound")))


def components(findings: DataFrame, posteriors: DataFrame) -> DataFrame:
    """``findings`` with estimate and bound of the rule's reliability, validity, reachability, exploitability, remediation and overall; the sample behind them and its maturity.

    Validity starts from the rule's posterior (mean, lower; keyed by scanner and rule_id) and gains up to 0.1 for
    corroboration by two independent sources (0.1 times their bound; 0.05 without one) and 0.05 for manual
    validation. Overall is the least of those that are scored; a rule's reliability itself is not counted again.
    Findings need evidence_kinds, corroboration_bound, independent_sources, reachability, n_references.
    """
    joined = findings.join(posteriors.select("scanner", "rule_id", "mean", "lower", (F.col("tp") + F.col("fp")).alias("sample")), ["scanner", "rule_id"], "left")
    has = lambda kind: F.coalesce(F.array_contains("evidence_kinds", kind), F.lit(False))
    bounded = F.col("corroboration_bound").isNotNull() & (F.coalesce("independent_sources", F.lit(0)) >= 2)
    uplift = F.when(has("corroboration") & bounded, F.least(F.lit(0.1), 0.1 * F.col("corroboration_bound"))).when(has("corroboration"), 0.05).otherwise(0.0) + F.when(has("manual_validation"), 0.05).otherwise(0.0)
    estimate = F.bround(F.least(F.lit(1.0), F.col("mean") + uplift), 6)
    validity = F.when(F.col("mean").isNotNull(), F.struct(estimate.alias("estimate"), F.bround(F.least(estimate, F.col("lower") + uplift), 6).alias("bound")))
    reach = F.coalesce(*[pair(F.col("reachability") == s, v) for s, v in REACHABILITY.items()])
    exploit = F.coalesce(pair(has("exploit_validation"), EXPLOIT_VALIDATED), pair(has("known_exploited") | has("exploit_precondition"), EXPLOIT_OTHER))
    fix = pair(F.coalesce("n_references", F.lit(0)) > 0, REMEDIATION)
    reliability = F.when(F.col("mean").isNotNull(), F.struct(F.col("mean").alias("estimate"), F.col("lower").alias("bound")))
    out = joined.withColumns({"reliability": reliability, "maturity": F.when(F.col("sample").isNotNull(), maturity(F.col("sample"))).otherwise("Unscored"), "validity": validity, "reach": reach, "exploit": exploit, "fix": fix})
    parts = ("validity", "reach", "exploit", "fix")
    overall = {f"overall_{k}": F.least(*[F.col(f"{p}.{k}") for p in parts]) for k in ("estimate", "bound")}
    level = F.when(F.col("sample").isNotNull() & F.col("overall_bound").isNotNull(), tier(F.col("sample"), F.col("overall_bound"))).otherwise("Unscored")
    return out.withColumns(overall).withColumn("overall_tier", level)


def tier_label(component_tier: Column, stored_tier: Column, confidence: Column) -> Column:
    """The tier to show: the component's, else the stored one, else by confidence (0.7 High, 0.3 Likely, else Noise)."""
    return F.coalesce(F.nullif(component_tier, F.lit("")), F.nullif(stored_tier, F.lit("")), F.when(confidence >= 0.7, "High").when(confidence >= 0.3, "Likely").otherwise("Noise"))


def act_first(findings: DataFrame) -> DataFrame:
    """Findings of tier High, most confident first (then by id)."""
    return findings.where("tier = 'High'").orderBy(F.desc("confidence"), "finding_id")
