"""Ingest and write queries over reports that Spark derives from the tables and keeps in the shared folder: S1 to S10."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shared_path
from ..sources import feeds, ingest, reports
from ._registry import query


def as_lines(documents: DataFrame, tag: str) -> str:
    """Write one JSON document a line and give the path."""
    path = shared_path(documents.sparkSession, tag)
    documents.write.text(path)
    return path


@query(
    "SELECT rule_id, CASE WHEN row_id % 2 = 0 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, file, count(*) AS n, min(start_line) AS first_line FROM findings WHERE scanner = 'trivy' GROUP BY 1, 2, 3",
    findings="findings",
)
def s4_ingest_json_lines(findings):
    place = F.struct(F.struct(F.struct("file", F.col("start_line").alias("line")).alias("Filesystem")).alias("Data"))
    path = as_lines(findings.where("scanner = 'trivy'").select(F.to_json(F.struct(F.col("rule_id").alias("DetectorName"), (F.col("row_id") % 2 == 0).alias("Verified"), place.alias("SourceMetadata")))), "trufflehog")
    raw = reports.trufflehog(findings.sparkSession, path)
    return raw.groupBy("rule_id", "severity", "file").agg(F.count("*").alias("n"), F.min("start_line").alias("first_line"))


@query("SELECT CASE event_id % 10 WHEN 0 THEN 'malformed report' WHEN 1 THEN 'unexpected root' ELSE 'ok' END AS state, count(*) AS n FROM events GROUP BY 1", events="events")
def s7_failed_reports(events):
    text = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("{broken "), "props")).when(F.col("event_id") % 10 == 1, F.col("props")).otherwise('{"results": [{"test_id": "B1"}]}')
    made = reports.json_reports(events.sparkSession, as_lines(events.select(text.alias("value")), "reports"), "results array<struct<test_id:string>>", lines=True)
    good, failed = reports.split_failures(made, "results")
    return good.select(F.lit("ok").alias("state")).unionByName(failed.select(F.col("reason").alias("state"))).groupBy("state").agg(F.count("*").alias("n"))


@query(
    """SELECT 'osv' AS source, concat('CVE-2024-', cast(10000 + p_partkey AS string)) AS advisory_id, CASE WHEN p_size % 2 = 0 THEN '1.0,2.0' ELSE '2.0' END AS fixed_versions, '' AS epss FROM part WHERE p_partkey % 3 = 0
    UNION ALL SELECT 'epss', concat('CVE-2024-', cast(10000 + p_partkey AS string)), '', cast(cast(p_size AS double) / 64.0 AS varchar) FROM part""",
    part="part",
)
def s9_read_feeds(part):
    spark, cve = part.sparkSession, F.concat(F.lit("CVE-2024-"), (F.col("p_partkey") + 10000).cast("string"))
    event = lambda v: F.struct(F.lit("0").alias("introduced"), v.alias("fixed"))
    events = F.array(event(F.lit("2.0")), event(F.when(F.col("p_size") % 2 == 0, "1.0")))
    osv = part.where("p_partkey % 3 = 0").select(F.to_json(F.struct(cve.alias("id"), F.array(F.struct(F.array(F.struct(events.alias("events"))).alias("ranges"))).alias("affected"))))
    epss = part.select(F.to_json(F.struct(cve.alias("cve"), (F.col("p_size").cast("double") / 64.0).cast("string").alias("epss"))))
    both = feeds.read_osv(spark, as_lines(osv, "osv")).unionByName(feeds.read_epss(spark, as_lines(epss, "epss")))
    fixed, score = F.coalesce(F.array_join("fixed_versions", ","), F.lit("")), F.coalesce(F.col("epss").cast("string"), F.lit(""))
    return both.select("source", F.element_at("advisory_ids", 1).alias("advisory_id"), fixed.alias("fixed_versions"), score.alias("epss"))


@query("SELECT repository, count(*) AS n FROM findings GROUP BY 1", findings="findings")
def s10_write_findings(findings):
    path = shared_path(findings.sparkSession, "findings")
    reports.write_findings(findings.select("repository", "row_id"), path)
    return findings.sparkSession.read.parquet(path).groupBy("repository").agg(F.count("*").alias("n"))


def as_reports(results: DataFrame, wrap: Callable[[Column], Column], tag: str) -> str:
    """Write one report a file, each of the results ``r`` of one block of a thousand orders, and give the path."""
    path = shared_path(results.sparkSession, tag)
    made = results.groupBy("block").agg(F.collect_list("r").alias("l")).select(F.to_json(wrap(F.col("l"))))
    made.write.option("maxRecordsPerFile", 1).text(path)
    return path


def named(name: str) -> Callable[[Column], Column]:
    return lambda found: F.struct(found.alias(name))


def blocks(findings: DataFrame) -> DataFrame:
    return findings.withColumn("block", F.expr("row_id div 10000"))


def shown(raw: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return raw.select("scanner", *[text(c).alias(c) for c in ("rule_id", "severity", "file", "start_line", "package")], F.coalesce(F.array_join("cwe", ","), F.lit("")).alias("cwe"))


SHOWN = "coalesce(cast({} AS varchar), '') AS {}"


def plain(scanner: str, where: str, rule_id: str = "rule_id", severity: str = "NULL", file: str = "file", start_line: str = "start_line", package: str = "NULL", cwe: str = "NULL") -> str:
    """The SQL of what a reader gives for the findings of ``where``."""
    given = {"rule_id": rule_id, "severity": severity, "file": file, "start_line": start_line, "package": package, "cwe": cwe}
    return f"SELECT '{scanner}' AS scanner, " + ", ".join(SHOWN.format(e, c) for c, e in given.items()) + f" FROM findings WHERE {where}"


@query(
    " UNION ALL ".join(
        [
            plain("bandit", "row_id % 9 = 0", severity="original_severity", cwe="cwe"),
            plain("semgrep", "row_id % 9 = 1", severity="original_severity", cwe="cwe"),
            plain("pip-audit", "row_id % 9 = 2 AND cve IS NOT NULL", rule_id="cve", file="NULL", start_line="NULL", package="dep_name"),
            plain("gitleaks", "row_id % 9 = 3"),
            plain("checkov", "row_id % 9 = 4", severity="original_severity"),
            plain("hadolint", "row_id % 9 = 5", severity="original_severity"),
            plain("gosec", "row_id % 9 = 6", severity="original_severity", cwe="cwe"),
            plain("brakeman", "row_id % 9 = 7", cwe="cwe"),
            plain("eslint-security", "row_id % 9 = 8 AND start_line % 3 > 0", severity="CASE start_line % 3 WHEN 2 THEN 'ERROR' ELSE 'WARNING' END"),
        ]
    ),
    findings="findings",
)
def s1_ingest_json(findings):
    spark, f = findings.sparkSession, blocks(findings)
    number, line, level = F.substring("cwe", 5, 9), F.col("start_line"), F.col("original_severity")

    def put(k: int, tag: str, wrap: Callable[[Column], Column], **fields: Column) -> str:
        return as_reports(f.where(f"row_id % 9 = {k}").select("block", F.struct(*[v.alias(n) for n, v in fields.items()]).alias("r")), wrap, tag)

    rule, file = F.col("rule_id"), F.col("file")
    at = lambda n: F.struct(n.alias("line"))
    found = [
        reports.bandit(spark, put(0, "bandit", named("results"), test_id=rule, issue_severity=level, filename=file, line_number=line, issue_cwe=F.struct(number.cast("int").alias("id")))),
        reports.semgrep(spark, put(1, "semgrep", named("results"), check_id=rule, path=file, start=at(line), end=at(line), extra=F.struct(level.alias("severity"), F.struct(F.array(F.concat("cwe", F.lit(": named"))).alias("cwe")).alias("metadata")))),
        reports.gitleaks(spark, put(3, "gitleaks", lambda found: found, RuleID=rule, File=file, StartLine=line)),
        reports.checkov(spark, put(4, "checkov", lambda found: F.struct(F.struct(found.alias("failed_checks")).alias("results")), check_id=rule, severity=level, file_path=file, file_line_range=F.array(line, line + 2))),
        reports.hadolint(spark, put(5, "hadolint", lambda found: found, code=rule, level=level, file=file, line=line)),
        reports.gosec(spark, put(6, "gosec", named("Issues"), rule_id=rule, severity=level, file=file, line=F.concat(line.cast("string"), F.lit("-"), (line + 3).cast("string")), cwe=F.struct(number.alias("id")))),
        reports.brakeman(spark, put(7, "brakeman", named("warnings"), check_name=rule, file=file, line=line, cwe_id=F.when(number.isNotNull(), F.array(number.cast("int"))))),
    ]
    vulns = f.where("row_id % 9 = 2 and cve is not null").groupBy("block", "dep_name").agg(F.collect_list(F.struct(F.col("cve").alias("id"))).alias("vulns"))
    found.append(reports.pip_audit(spark, as_reports(vulns.select("block", F.struct(F.col("dep_name").alias("name"), F.lit("1").alias("version"), "vulns").alias("r")), named("dependencies"), "pip-audit")))
    messages = f.where("row_id % 9 = 8").groupBy("block", "file").agg(F.collect_list(F.struct(rule.alias("ruleId"), (line % 3).alias("severity"), line.alias("line"))).alias("messages"))
    found.append(reports.eslint(spark, as_reports(messages.select("block", F.struct(file.alias("filePath"), "messages").alias("r")), lambda found: found, "eslint")))
    return reduce(DataFrame.unionByName, map(shown, found))


@query(
    plain("trivy", "scanner = 'trivy' AND cve IS NOT NULL", rule_id="cve", severity="original_severity", start_line="NULL", package="dep_name", cwe="cwe") + " UNION ALL " + plain("trivy", "scanner = 'trivy' AND cve IS NULL", severity="original_severity"),
    findings="findings",
)
def s2_ingest_two_branches(findings):
    rated = F.col("original_severity").alias("Severity")
    vuln = F.struct(F.col("cve").alias("VulnerabilityID"), F.col("dep_name").alias("PkgName"), rated, F.array_compact(F.array("cwe")).alias("CweIDs"))
    conf = F.struct(F.col("rule_id").alias("ID"), rated, F.struct(F.col("start_line").alias("StartLine")).alias("CauseMetadata"))
    targets = blocks(findings.where("scanner = 'trivy'")).groupBy("block", F.col("file").alias("Target")).agg(
        F.collect_list(F.when(F.col("cve").isNotNull(), vuln)).alias("Vulnerabilities"), F.collect_list(F.when(F.col("cve").isNull(), conf)).alias("Misconfigurations")
    )
    return shown(reports.trivy(findings.sparkSession, as_reports(targets.select("block", F.struct("Target", "Vulnerabilities", "Misconfigurations").alias("r")), named("Results"), "trivy")))


@query(
    " UNION ALL ".join(
        [
            plain("zap", "scanner = 'zap'", severity="upper(severity)", file="CASE WHEN row_id % 4 > 0 THEN file END", start_line="NULL", cwe="cwe"),
            plain("zap", "scanner = 'zap' AND row_id % 4 = 1", severity="upper(severity)", file="'again'", start_line="NULL", cwe="cwe"),
            plain("osv-scanner", "scanner = 'pip-audit' AND cve IS NOT NULL", rule_id="cve", severity="original_severity", file="'lock'", start_line="NULL", package="dep_name"),
            plain("grype", "scanner = 'gosec' AND cve IS NOT NULL", rule_id="cve", severity="original_severity", file="NULL", start_line="NULL", package="dep_name"),
        ]
    ),
    findings="findings",
)
def s3_ingest_three_levels(findings):
    spark, f = findings.sparkSession, blocks(findings)
    place = lambda uri: F.struct(uri.alias("uri"))
    instances = F.when(F.col("row_id") % 4 == 1, F.array(place(F.col("file")), place(F.lit("again")))).when(F.col("row_id") % 4 > 0, F.array(place(F.col("file"))))
    alert = F.struct(F.col("rule_id").alias("pluginid"), F.concat(F.upper("severity"), F.lit(" (Low)")).alias("riskdesc"), F.substring("cwe", 5, 9).alias("cweid"), instances.alias("instances"))
    sites = f.where("scanner = 'zap'").groupBy("block", "run_id").agg(F.collect_list(alert).alias("alerts"))
    zap = reports.zap(spark, as_reports(sites.select("block", F.struct("alerts").alias("r")), named("site"), "zap"))
    vuln = F.struct(F.col("cve").alias("id"), F.struct(F.col("original_severity").alias("severity")).alias("database_specific"))
    packages = f.where("scanner = 'pip-audit' and cve is not null").groupBy("block", "dep_name").agg(F.collect_list(vuln).alias("vulnerabilities"))
    each = F.struct(F.struct(F.lit("lock").alias("path")).alias("source"), F.array(F.struct(F.struct(F.col("dep_name").alias("name")).alias("package"), "vulnerabilities")).alias("packages"))
    osv = reports.osv(spark, as_reports(packages.select("block", each.alias("r")), named("results"), "osv-scanner"))
    match = F.struct(F.struct(F.col("cve").alias("id"), F.col("original_severity").alias("severity")).alias("vulnerability"), F.struct(F.col("dep_name").alias("name")).alias("artifact"))
    grype = reports.grype(spark, as_reports(f.where("scanner = 'gosec' and cve is not null").select("block", match.alias("r")), named("matches"), "grype"))
    return shown(zap).unionByName(shown(osv)).unionByName(shown(grype))


@query(plain("codeql-sarif", "scanner = 'semgrep'", severity="CASE rule_id WHEN 'R4' THEN 'CRITICAL' WHEN 'R5' THEN 'MEDIUM' ELSE 'WARNING' END", cwe="CASE WHEN rule_id IN ('R4', 'R5') THEN 'CWE-79' END"), findings="findings")
def s5_ingest_sarif(findings):
    """Two rules carry a score and a tag, the others only the level of their results."""
    f = blocks(findings.where("scanner = 'semgrep'"))
    place = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), F.struct(F.col("start_line").alias("startLine")).alias("region")).alias("physicalLocation"))
    result = F.struct(F.col("rule_id").alias("ruleId"), F.lit("warning").alias("level"), F.array(place).alias("locations"))
    scored = F.struct(F.when(F.col("rule_id") == "R4", "9.8").otherwise("5.0").alias("security-severity"), F.array(F.lit("external/cwe/cwe-079")).alias("tags"))
    rule = F.struct(F.col("rule_id").alias("id"), F.when(F.col("rule_id").isin("R4", "R5"), scored).alias("properties"))
    run = f.groupBy("block").agg(F.collect_list(result).alias("results"), F.collect_set(F.to_json(rule)).alias("rules"))
    rules = F.transform("rules", lambda r: F.from_json(r, "id string, properties struct<`security-severity`:string,tags:array<string>>"))
    made = run.select("block", F.struct(F.struct(F.struct(rules.alias("rules")).alias("driver")).alias("tool"), "results").alias("r"))
    return shown(reports.sarif(findings.sparkSession, as_reports(made, named("runs"), "sarif")))


@query(plain("spotbugs", "scanner = 'bandit'", severity="CASE WHEN severity = 'high' THEN 1 ELSE 2 END", cwe="cwe"), findings="findings")
def s6_ingest_xml(findings):
    path = shared_path(findings.sparkSession, "spotbugs")
    line = lambda file, start: F.struct(file.alias("_sourcepath"), start.alias("_start"), start.alias("_end"))
    lines = F.array(line(F.col("file"), F.col("start_line")), line(F.lit("later"), F.lit(1)))
    bugs = findings.where("scanner = 'bandit'").select(F.col("rule_id").alias("_type"), F.when(F.col("severity") == "high", 1).otherwise(2).alias("_priority"), F.substring("cwe", 5, 9).alias("_cweid"), F.lit("m").alias("LongMessage"), lines.alias("SourceLine"))
    bugs.write.format("xml").option("rootTag", "BugCollection").option("rowTag", "BugInstance").save(path)
    return shown(reports.spotbugs(findings.sparkSession, path))


@query("SELECT sha256(concat(string_agg(c_name, ',' ORDER BY c_name), chr(10))) AS sha256 FROM customer GROUP BY c_custkey // 100", customer="customer")
def s8_report_digests(customer):
    path = shared_path(customer.sparkSession, "digests")
    named_in = customer.groupBy(F.expr("c_custkey div 100")).agg(F.array_join(F.array_sort(F.collect_list("c_name")), ",").alias("value"))
    named_in.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return reports.report_digests(customer.sparkSession, path).select("sha256")


def mixed_reports(findings: DataFrame, region: DataFrame) -> str:
    """Reports of every ninth finding in one folder with malformed ones, one for each region, and ones of another shape."""
    fields = F.struct(F.col("rule_id").alias("test_id"), F.col("original_severity").alias("issue_severity"), F.col("file").alias("filename"), F.col("start_line").alias("line_number"), F.struct(F.substring("cwe", 5, 9).cast("int").alias("id")).alias("issue_cwe"))
    path = as_reports(blocks(findings.where("row_id % 9 = 0")).select("block", fields.alias("r")), named("results"), "mixed")
    for text in (F.concat(F.lit('{"results": ['), "r_name"), F.concat(F.lit('{"runs": "'), "r_name", F.lit('"}'))):
        region.select(text).write.mode("append").option("maxRecordsPerFile", 1).text(path)
    return path


INGESTED = """WITH f AS (SELECT *, concat('v2:sha256:', sha256(concat('{"algorithm":"v2","identity":{"cwe":[', CASE WHEN cwe IS NULL THEN '' ELSE concat('"', cwe, '"') END, '],"file":"', file, '","kind":"sast","rule_id":"', lower(rule_id), '","sink":"","source":"","symbol":""}}'))) AS fingerprint FROM findings WHERE row_id % 9 = 0)
    SELECT fingerprint, concat('finding-v2-', left(sha256(concat('{"algorithm":"v2","fingerprint":"', fingerprint, '","rule_id":"', lower(rule_id), '","scanner":"bandit"}')), 24)) AS finding_id, 'sast' AS category, CASE original_severity WHEN 'HIGH' THEN 'high' WHEN 'MEDIUM' THEN 'medium' WHEN 'LOW' THEN 'low' ELSE 'unknown' END AS severity,
    file, start_line, coalesce(cwe, '') AS cwe, nullif(original_severity, '') AS original_severity FROM f"""


@query(INGESTED, findings="findings", region="region")
def p9_ingest_canonical(findings, region):
    found, _ = ingest.ingest(findings.sparkSession, "bandit", mixed_reports(findings, region), F.lit("r"), F.lit("1"), F.lit("2024-01-01T00:00:00Z"))
    return found.select("fingerprint", "finding_id", "category", "severity", "file", "start_line", F.array_join("cwe", ",").alias("cwe"), "original_severity")


@query("SELECT 'malformed report' AS reason, 'bandit' AS scanner, count(*) AS n FROM region UNION ALL SELECT 'unexpected root', 'bandit', count(*) FROM region", findings="findings", region="region")
def s7_reader_failures(findings, region):
    _, failed = ingest.ingest(findings.sparkSession, "bandit", mixed_reports(findings, region), F.lit("r"), F.lit("1"), F.lit("2024-01-01T00:00:00Z"))
    return failed.groupBy("reason", "scanner").agg(F.count("*").alias("n"))
