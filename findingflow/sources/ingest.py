"""Scanner reports to canonical findings: read, normalise, identify; what cannot be read is reported, not lost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import fingerprint, finding_id, identifiers, repository_path, split_identifiers
from ..functions.severity import scanner_severity, secret_severity
from ..operators.export import CATEGORIES
from .reports import READERS, failures

SECRET_SCANNERS = ("gitleaks", "trufflehog")
ECOSYSTEMS = {"pip-audit": "pypi"}


def canonical(raw: DataFrame, repository: Column, run_id: Column, seen_at: Column) -> DataFrame:
    """Raw rows in the columns of the findings contract; identifiers by namespace, severity with its reason, fingerprint and id."""
    table = lambda d: F.element_at(F.create_map(*[F.lit(x) for pair in d.items() for x in pair]), F.col("scanner"))
    text, strings = F.lit(None).cast("string"), F.array().cast("array<string>")
    known = split_identifiers(F.coalesce("ids", strings))
    category = F.when(F.col("package").isNotNull(), "sca").otherwise(F.coalesce(table(CATEGORIES), F.lit("sast")))
    judged = raw.withColumns({"said": scanner_severity(F.col("scanner"), F.col("severity")), "known": known, "place": repository_path(F.col("file"))})
    secret = F.col("scanner").isin(*SECRET_SCANNERS)
    made = judged.select(
        F.lit("1.0.0").alias("schema_version"), F.col("path").alias("report_path"), repository.alias("repository"), run_id.alias("run_id"), "scanner", text.alias("scanner_version"),
        F.coalesce("rule_id", F.lit("unknown")).alias("rule_id"), text.alias("rule_version"), category.alias("category"), identifiers(F.col("cwe")).alias("cwe"), "known.cve", "known.ghsa", "known.osv",
        F.coalesce(F.nullif("title", F.lit("")), "rule_id", F.lit("unknown")).alias("title"), F.coalesce("title", F.lit("")).alias("description"), F.nullif("severity", F.lit("")).alias("original_severity"),
        F.when(secret, secret_severity(F.col("rule_id"), F.col("severity"), F.lit(None).cast("boolean"))).otherwise(F.col("said.severity")).alias("severity"), F.col("said.rule").alias("severity_reason"),
        F.lit(None).cast("double").alias("confidence"), F.col("place").alias("file"), F.when(F.col("start_line") > 0, F.col("start_line")).alias("start_line"), F.when(F.col("end_line") > 0, F.col("end_line")).alias("end_line"),
        text.alias("symbol"), text.alias("source"), text.alias("sink"), F.col("package").alias("dep_name"), F.col("version").alias("dep_version"), F.when(F.col("package").isNotNull(), table(ECOSYSTEMS)).alias("dep_ecosystem"),
        text.alias("dependency_scope"), F.lit("unknown").alias("reachability"), text.alias("introduced_commit"), seen_at.alias("first_seen"), seen_at.alias("last_seen"), F.lit("open").alias("status"), strings.alias("evidence"),
        F.lit(1).alias("occurrence_count"),
    )
    parts = [F.col(c) for c in ("category", "rule_id", "file", "symbol", "source", "sink", "cwe", "cve", "ghsa", "osv", "dep_name", "dep_ecosystem")]
    printed = made.withColumn("fingerprint", fingerprint(*parts))
    return printed.withColumn("finding_id", finding_id(F.col("scanner"), F.col("rule_id"), F.col("fingerprint")))


def ingest(spark: SparkSession, scanner: str, path: str, repository: Column, run_id: Column, seen_at: Column) -> tuple[DataFrame, DataFrame]:
    """(canonical findings, failures) of the reports of one scanner at ``path``; the last three may depend on the report's ``path``."""
    return canonical(READERS[scanner](spark, path), repository, run_id, seen_at), failures(spark, scanner, path)
