"""Policies compiled to columns: no shuffle, no Python, one ``when`` chain over a finding's context.

A condition that meets a missing value is false, never null, so ``not`` over it is true.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions.identity import glob_regex, glob_regex_column

RUN = ("repository", "run_id")
FINDING = (*RUN, "finding_id")
PROBABILITIES = ("epss", "confidence_lower_bound")
GLOBS = ("repository", "branch")
LISTS = ("cwe", "cve")
COMPARISON = re.compile(r"(>=|<=|>|<|==)([01](?:\.[0-9]+)?)")
COMPARE: dict[str, Callable[[Column, float], Column]] = {
    ">=": lambda c, v: c >= v,
    "<=": lambda c, v: c <= v,
    ">": lambda c, v: c > v,
    "<": lambda c, v: c < v,
    "==": lambda c, v: c == v,
}
# What each policy action comes to.
OUTCOMES = {
    "block": "BLOCK_IMMEDIATELY",
    "fix_before_release": "FIX_BEFORE_RELEASE",
    "fix_within_sla": "FIX_WITHIN_SLA",
    "investigate": "INVESTIGATE",
    "monitor": "MONITOR",
    "allow": "MONITOR",
    "accept_risk": "ACCEPTED_RISK",
    "suppress": "TEMPORARILY_SUPPRESSED",
    "insufficient_evidence": "INSUFFICIENT_EVIDENCE",
}


def predicate(field: str, expected: object) -> Column:
    """One selector: probabilities compare (a bare number means at least), lists contain, names match shell patterns, the rest is equal; a list of expected values is any of them."""
    actual = F.col(field)
    if field in PROBABILITIES:
        if isinstance(expected, int | float) and not isinstance(expected, bool):
            return F.coalesce(actual >= float(expected), F.lit(False))
        found = COMPARISON.fullmatch(str(expected))
        return F.coalesce(COMPARE[found[1]](actual, float(found[2])), F.lit(False)) if found else F.lit(False)
    if isinstance(expected, list):
        out = F.lit(False)
        for one in expected:
            out = out | predicate(field, one)
        return out
    if field in LISTS:
        return F.coalesce(F.array_contains(actual, expected), F.lit(False))
    if field in GLOBS and isinstance(expected, str):
        return F.coalesce(actual.rlike(glob_regex(expected)), F.lit(False))
    return actual.eqNullSafe(F.lit(expected))


def compile_expression(tree: dict) -> Column:
    """A recursive ``any`` / ``all`` / ``not`` tree over selectors as one boolean column."""
    if "any" in tree:
        out = F.lit(False)
        for child in tree["any"]:
            out = out | compile_expression(child)
        return out
    if "all" in tree:
        out = F.lit(True)
        for child in tree["all"]:
            out = out & compile_expression(child)
        return out
    if "not" in tree:
        return ~compile_expression(tree["not"])
    ((field, expected),) = tree.items()
    return predicate(field, expected)


def evaluate_policy(context: DataFrame, rules: list[dict], default_action: str = "investigate") -> DataFrame:
    """``context`` with matched_policy, action, outcome and trace: the names of all matching rules, the first of which wins."""
    hits = [(r["name"], r["action"], compile_expression(r["when"])) for r in rules]
    trace = F.array_compact(F.array(*[F.when(c, n) for n, _, c in hits])) if hits else F.array().cast("array<string>")
    traced = context.withColumn("trace", trace).withColumn("matched_policy", F.try_element_at("trace", F.lit(1)))
    actions = F.create_map(*[F.lit(x) for n, a, _ in hits for x in (n, a)]) if hits else F.create_map()
    action = F.coalesce(F.element_at(actions, F.col("matched_policy")) if hits else F.lit(None), F.lit(default_action))
    outcomes = F.create_map(*[F.lit(x) for pair in OUTCOMES.items() for x in pair])
    return traced.withColumn("action", action).withColumn("outcome", F.element_at(outcomes, F.col("action"))).withColumn("trace", F.array_join("trace", ","))


def check_expectations(evaluations: DataFrame, expectations: DataFrame, keys: tuple[str, ...] = FINDING) -> DataFrame:
    """Expected against actual outcome and rule per finding (and policy, if ``keys`` name it); a finding without an evaluation fails."""
    actual = evaluations.select(*keys, F.col("outcome").alias("actual_outcome"), F.col("matched_policy").alias("actual_policy"))
    ok = F.col("actual_outcome").eqNullSafe(F.col("expected_outcome")) & (F.col("expected_policy").isNull() | F.col("actual_policy").eqNullSafe(F.col("expected_policy")))
    return expectations.join(actual, list(keys), "left").withColumn("passed", ok)


LAYERS = {"override": 0, "own": 1, "organisation": 2, "parent": 3}


def resolve_policies(layers: DataFrame, repositories: DataFrame) -> DataFrame:
    """Effective rules per repository: of each name the first by layer (override, own, organisation, parent), then position.

    ``layers`` has layer, position, name, action and repository_glob (null: all); globs meet the distinct
    repositories only, which both sides' sizes keep small.
    """
    rank = F.create_map(*[F.lit(x) for pair in LAYERS.items() for x in pair])
    fits = F.col("repository_glob").isNull() | F.rlike("repository", glob_regex_column(F.col("repository_glob")))
    met = repositories.select("repository").distinct().join(layers.withColumn("rank", F.element_at(rank, F.col("layer"))), fits)
    place = F.row_number().over(Window.partitionBy("repository", "name").orderBy("rank", "position"))
    kept = met.withColumn("n", place).where("n = 1")
    order = F.row_number().over(Window.partitionBy("repository").orderBy("rank", "position"))
    return kept.select("repository", order.alias("place"), "name", "action", "layer")


def build_context(findings: DataFrame, runtime: DataFrame, fields: tuple[str, ...], environment: str | None = None, run: tuple[str, ...] = RUN) -> DataFrame:
    """Each field with its source, by precedence: the finding's runtime value, the one its run shares, the finding, its environment map.

    ``runtime`` has the run's keys, finding_id (null: shared by the run), field and value.
    """
    entries = F.map_from_entries(F.collect_list(F.struct("field", "value")))
    wanted = runtime.where(F.col("field").isin(*fields)).groupBy(*run, "finding_id", "field").agg(F.max("value").alias("value"))
    own = wanted.where("finding_id is not null").groupBy(*run, "finding_id").agg(entries.alias("own"))
    shared = wanted.where("finding_id is null").groupBy(*run).agg(entries.alias("shared"))
    joined = findings.join(own, [*run, "finding_id"], "left").join(shared, list(run), "left")

    def choices(field: str) -> list[tuple[str, Column]]:
        at = lambda m: F.element_at(F.col(m), F.lit(field))
        out = [("runtime.finding", at("own")), ("runtime.shared", at("shared"))]
        if field in findings.columns:
            out.append(("finding", F.col(field).cast("string")))
        return out + ([("environment", at(environment))] if environment else [])

    for field in fields:
        joined = joined.withColumn(f"value_{field}", F.coalesce(*[c for _, c in choices(field)])).withColumn(f"source_{field}", F.coalesce(*[F.when(c.isNotNull(), n) for n, c in choices(field)]))
    return joined.select(*run, "finding_id", *[x for f in fields for x in (f"value_{f}", f"source_{f}")])


# What a decision rests on.
COMPONENTS = (
    "finding_validity_confidence",
    "original_severity",
    "normalised_severity",
    "reachability",
    "epss",
    "cisa_kev",
    "public_exploit_availability",
    "internet_exposure",
    "authentication_requirements",
    "data_sensitivity",
    "asset_criticality",
    "runtime_environment",
    "existing_controls",
    "fix_availability",
    "new_existing_status",
    "human_triage_state",
)
UNRESOLVED = ("unknown", "not_applicable")
HIGH = ("normalised_severity", "in", ("critical", "high"))
REACHABLE = ("reachability", "equals", "reachable")
EXPOSED = (HIGH, REACHABLE, ("runtime_environment", "equals", "production"), ("internet_exposure", "equals", True))
# The default decision rules, in order, and their outcomes.
DEFAULT_RULES = (
    ("honour-temporary-suppression", "TEMPORARILY_SUPPRESSED", (("human_triage_state", "equals", "suppressed"),)),
    ("honour-accepted-risk", "ACCEPTED_RISK", (("human_triage_state", "equals", "accepted_risk"),)),
    ("honour-false-positive-triage", "LIKELY_NOISE", (("human_triage_state", "equals", "false_positive"),)),
    ("insufficient-core-evidence", "INSUFFICIENT_EVIDENCE", (("finding_validity_confidence", "is_known", False),)),
    ("block-exploitable-production-risk", "BLOCK_IMMEDIATELY", (*EXPOSED, ("authentication_requirements", "equals", False), ("cisa_kev", "equals", True))),
    ("block-public-exploit-production-risk", "BLOCK_IMMEDIATELY", (*EXPOSED, ("public_exploit_availability", "equals", True))),
    ("fix-new-reachable-risk-before-release", "FIX_BEFORE_RELEASE", (HIGH, REACHABLE, ("new_existing_status", "equals", "new"))),
    ("fix-known-high-risk-within-sla", "FIX_WITHIN_SLA", (HIGH, ("fix_availability", "equals", True))),
    ("monitor-contained-low-risk", "MONITOR", (("normalised_severity", "in", ("low", "info")), ("internet_exposure", "equals", False))),
    ("investigate-uncertain-risk", "INVESTIGATE", (("human_triage_state", "in", ("open", "acknowledged")),)),
)


def condition(schema: DataFrame, component: str, operator: str, expected: object) -> Column:
    """One of seven operators on a component; equality is null-safe, comparisons with a missing value are false."""
    c = F.col(component)
    if operator == "equals":
        return c.eqNullSafe(F.lit(expected))
    if operator == "not_equals":
        return ~c.eqNullSafe(F.lit(expected))
    if operator == "in":
        return F.coalesce(c.isin(*expected), F.lit(False))
    if operator in ("gte", "lte"):
        return F.coalesce(c >= expected if operator == "gte" else c <= expected, F.lit(False))
    if operator == "contains":
        held = F.array_contains(c, expected) if isinstance(schema.schema[component].dataType, ArrayType) else F.contains(c, F.lit(expected))
        return F.coalesce(held, F.lit(False))
    if operator == "is_known":
        return c.isNotNull() if expected else c.isNull()
    raise ValueError(f"unknown operator {operator}")


def decide(context: DataFrame, rules: tuple = DEFAULT_RULES, default: str = "INVESTIGATE") -> DataFrame:
    """``context`` (finding_id and the 16 components) with outcome, matched_rule, known and strength.

    A component counts as known if it has a value that is not unresolved; strength also needs the lower confidence bound.
    """
    matched = F.coalesce(*[F.when(_all(context, conditions), name) for name, _, conditions in rules])
    outcomes = F.create_map(*[F.lit(x) for name, outcome, _ in rules for x in (name, outcome)])
    known = sum((F.when(F.col(c).isNotNull() & ~F.coalesce(F.col(c).cast("string").isin(*UNRESOLVED), F.lit(False)), 1).otherwise(0) for c in COMPONENTS), F.lit(0))
    bound = F.coalesce("finding_validity_confidence", F.lit(-1.0))
    strength = F.when((F.col("known") >= 14) & (bound >= 0.7), "strong").when((F.col("known") >= 10) & (bound >= 0.4), "moderate").when(F.col("known") >= 6, "weak").otherwise("insufficient")
    found = context.withColumn("matched_rule", matched).withColumn("known", known)
    return found.withColumn("outcome", F.coalesce(F.element_at(outcomes, F.col("matched_rule")), F.lit(default))).withColumn("strength", strength)


def _all(context: DataFrame, conditions: tuple) -> Column:
    out = F.lit(True)
    for one in conditions:
        out = out & condition(context, *one)
    return out


def decision_summary(decisions: DataFrame) -> DataFrame:
    """Decisions per run: by outcome, by strength, and with unresolved components."""
    outcomes = [*dict.fromkeys(o for _, o, _ in DEFAULT_RULES)]
    return decisions.groupBy("run_id").agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("outcome") == o).alias(o.lower()) for o in outcomes],
        *[F.count_if(F.col("strength") == s).alias(s) for s in ("strong", "moderate", "weak", "insufficient")],
        F.count_if(F.col("known") < len(COMPONENTS)).alias("uncertain"),
    )


def scanner_health_on_findings(findings: DataFrame, scanners: DataFrame) -> DataFrame:
    """Each finding with its scanner's health in its run; null where the run has no such scanner."""
    health = scanners.groupBy("run_id", "scanner").agg(F.when(F.every("healthy"), "healthy").otherwise("unhealthy").alias("scanner_health"))
    return findings.join(health, ["run_id", "scanner"], "left")
