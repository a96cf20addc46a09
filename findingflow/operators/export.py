"""Rows for other systems: payloads, SARIF rules and results, cross-tabs, timelines, migrations, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import clean, short_key
from ..functions.severity import RANK, rank

# Severities in event systems.
CEF = {"critical": 10, "high": 7, "medium": 4, "low": 2, "info": 0}


def payload() -> Column:
    """A finding for a ticket, chat or event system: title, labels, CEF severity, as JSON."""
    severity = F.lower(F.coalesce("severity", F.lit("info")))
    title = F.concat(F.lit("["), F.upper(severity), F.lit("] "), F.coalesce("scanner", F.lit("")), F.lit(": "), F.coalesce("rule_id", F.lit("unknown")))
    labels = F.array(F.concat(F.lit("security:"), severity), F.concat(F.lit("scanner:"), F.coalesce("scanner", F.lit("unknown"))))
    cef = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in CEF.items() for x in pair]), severity), F.lit(0))
    return F.struct(title.alias("title"), labels.alias("labels"), cef.alias("cef_severity"))


def payload_rows(findings: DataFrame) -> DataFrame:
    return findings.select("finding_id", F.to_json(payload()).alias("payload"))


def sarif_rules(findings: DataFrame) -> DataFrame:
    """One rule per run and rule id: its most severe finding (least fingerprint on ties) and a dense index from 0 by rule id."""
    first = Window.partitionBy("run_id", "rule_id").orderBy(rank(F.col("severity")).desc(), "fingerprint")
    rules = findings.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    index = F.row_number().over(Window.partitionBy("run_id").orderBy("rule_id")) - 1
    return rules.select("run_id", "rule_id", index.alias("rule_index"), "severity", "fingerprint")


def sarif_results(findings: DataFrame) -> DataFrame:
    """Every finding with its rule's index, level and partial fingerprint."""
    level = F.when(F.col("severity").isin("critical", "high"), "error").when(F.col("severity") == "medium", "warning").otherwise("note")
    rules = sarif_rules(findings).select("run_id", "rule_id", "rule_index")
    partial = short_key(F.col("rule_id"), F.col("file"), F.col("fingerprint"))
    return findings.join(rules, ["run_id", "rule_id"]).select("run_id", "finding_id", "rule_id", "rule_index", level.alias("level"), partial.alias("partial_fingerprint"))


def cross_tab(findings: DataFrame) -> DataFrame:
    """Findings by scanner and severity, with the share of low and info."""
    names = [s for s in RANK]
    out = findings.groupBy("scanner").pivot("severity", names).count().fillna(0, names)
    total = sum((F.col(s) for s in names), F.lit(0))
    return out.select("scanner", *names, total.alias("total"), ((F.col("low") + F.col("info")) / total).alias("noise_share"))


def timeline(fetches: DataFrame) -> DataFrame:
    """When each finding's sources were fetched, and a row ``(all)`` per finding with the latest; repeats once."""
    each = fetches.select("finding_id", "source", "fetched_at").where("fetched_at is not null").distinct()
    return each.unionByName(each.groupBy("finding_id").agg(F.lit("(all)").alias("source"), F.max("fetched_at").alias("fetched_at")))


# Categories of scanners that say none.
CATEGORIES = {"pip-audit": "sca", "trivy": "sca", "osv-scanner": "sca", "grype": "sca", "gitleaks": "secret", "trufflehog": "secret", "checkov": "iac", "hadolint": "iac", "zap": "dast"}


def migrate(legacy: DataFrame) -> DataFrame:
    """Rows of the old shape in canonical columns: names trimmed, line positive, confidence in [0, 1], category by scanner."""
    scanner = F.lower(F.coalesce(F.nullif(clean(F.col("tool")), F.lit("")), F.lit("unknown")))
    categories = F.create_map(*[F.lit(x) for pair in CATEGORIES.items() for x in pair])
    return legacy.select(
        "row_id", scanner.alias("scanner"), F.coalesce(F.nullif(clean(F.col("rule_id")), F.lit("")), F.lit("unknown")).alias("rule_id"),
        F.coalesce(F.element_at(categories, scanner), F.lit("sast")).alias("category"), F.when(F.col("line") > 0, F.col("line")).alias("start_line"),
        F.when(F.col("confidence").between(0, 1), F.col("confidence")).alias("confidence"), F.coalesce("first_seen", F.lit("1970-01-01")).alias("first_seen"),
        F.greatest("last_seen", F.coalesce("first_seen", F.lit("1970-01-01"))).alias("last_seen"),
    )


def migrate_fingerprint(findings: DataFrame, current: str = "v2:") -> DataFrame:
    """Fingerprints of older versions replaced by ``new_fingerprint``, the old value kept as evidence."""
    old = ~F.startswith("fingerprint", F.lit(current))
    kept = F.when(old, F.array_append("evidence", F.concat(F.lit("previous-fingerprint:"), F.col("fingerprint")))).otherwise(F.col("evidence"))
    return findings.withColumn("evidence", kept).withColumn("fingerprint", F.when(old, F.col("new_fingerprint")).otherwise(F.col("fingerprint")))


# The contract of a finding. Texts with their greatest length (null: none), which may be null, lists, domains, ranges and forms.
TEXTS = {"finding_id": 256, "fingerprint": 512, "scanner": 128, "rule_id": 512, "category": 128, "title": 1024, "severity_reason": None}
NULLABLE_TEXTS = ("scanner_version", "rule_version", "original_severity", "confidence_method", "code_region_hash", "infrastructure_resource", "secret_fingerprint", "rule_ancestry")
REQUIRED = ("description", "cwe", "cve", "ghsa", "osv", "severity", "reachability", "status", "first_seen", "last_seen", "evidence")
DOMAINS = {
    "severity": ("critical", "high", "medium", "low", "info", "unknown"),
    "reachability": ("reachable", "potentially_reachable", "unreachable", "unknown", "not_applicable"),
    "status": ("open", "acknowledged", "suppressed", "resolved", "false_positive", "accepted_risk"),
    "dependency_scope": ("runtime", "development", "test", "build", "optional", "unknown"),
}
RANGES = {"confidence": (0, 1), "confidence_sample_size": (0, None), "start_line": (1, None), "end_line": (1, None), "occurrence_count": (1, None), "agreement_strength": (0, 1)}
FORMS = {"introduced_commit": "^[0-9a-fA-F]{7,64}$"}
ITEM_FORMS = {
    "cwe": "^CWE-[1-9][0-9]*$",
    "cve": "^CVE-[0-9]{4}-[0-9]{4,}$",
    "ghsa": "^GHSA-[A-Za-z0-9]{4}-[A-Za-z0-9]{4}-[A-Za-z0-9]{4}$",
    "osv": "^.{1,128}$",
    "source_finding_ids": "^.+$",
    "correlation_signals": "^(cwe|file|symbol|source|sink|code_region|dependency|cve|infrastructure_resource|secret_fingerprint)$",
}
UNIQUE = ("cwe", "cve", "ghsa", "osv", "source_finding_ids", "supporting_scanners", "contradicting_scanners", "correlation_signals")


def validate(findings: DataFrame) -> DataFrame:
    """(row_id, field:kind) of every breach of the findings contract: required, length, enum, range, pattern, unique.

    A required column that is missing is a breach of every row; other missing columns are none. All rules are one
    array of conditions in one select.
    """
    has, c = set(findings.columns), F.col
    breaks = lambda form: lambda v: v.isNull() | ~v.rlike(form)
    rules: dict[str, Column] = {}
    for field in (*TEXTS, *REQUIRED):
        rules[f"{field}:required"] = c(field).isNull() if field in has else F.lit(True)
    for field, most in TEXTS.items():
        if field in has:
            rules[f"{field}:length"] = (F.length(field) < 1) | (F.length(field) > most if most else F.lit(False))
    for field in has & set(NULLABLE_TEXTS):
        rules[f"{field}:length"] = c(field) == ""
    for field, domain in DOMAINS.items():
        if field in has:
            rules[f"{field}:enum"] = ~c(field).isin(*domain)
    for field, (low, high) in RANGES.items():
        if field in has:
            rules[f"{field}:range"] = (c(field) < low) | (c(field) > high if high is not None else F.lit(False))
    for field, form in FORMS.items():
        if field in has:
            rules[f"{field}:pattern"] = ~c(field).rlike(form)
    for field, form in ITEM_FORMS.items():
        if field in has:
            rules[f"{field}:pattern"] = F.exists(field, breaks(form))
    for field in UNIQUE:
        if field in has:
            rules[f"{field}:unique"] = F.size(F.array_distinct(field)) < F.size(field)
    broken = F.array_compact(F.array(*[F.when(rules[name], name) for name in sorted(rules)]))
    return findings.select("row_id", F.explode(broken).alias("code"))


def verify_digests(documents: DataFrame) -> DataFrame:
    """Whether each document's stored digest is that of its canonical text."""
    return documents.select("document_id", F.col("stored").eqNullSafe(F.concat(F.lit("sha256:"), F.sha2("canonical", 256))).alias("ok"))


def commitments(labels: DataFrame) -> DataFrame:
    """Commitment of each blind label: sha256 over blind id, decision and salt; and whether the published one holds."""
    made = F.sha2(F.concat_ws("\n", "blind_id", "decision", "salt"), 256)
    return labels.select("blind_id", made.alias("commitment"), F.coalesce(F.col("published") == made, F.lit(False)).alias("ok"))
