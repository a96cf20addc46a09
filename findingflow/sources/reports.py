"""Scanner reports as raw findings, one row per result: path, scanner, rule_id, severity, title, file, start_line, end_line, cwe, ids, package, version.

Every reader has an explicit schema, reads whole reports in parallel and explodes them; nothing is parsed in Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import cwe_list

RAW = "path string, scanner string, rule_id string, severity string, title string, file string, start_line int, end_line int, cwe array<string>, ids array<string>, package string, version string"
Reader = Callable[[SparkSession, str], DataFrame]
READERS: dict[str, Reader] = {}


#: By scanner: the field that its reports, or their elements, must have, and whether they are JSON lines.
ROOTS: dict[str, tuple[str, bool]] = {}


def reader(name: str, root: str | None = None, lines: bool = False) -> Callable[[Reader], Reader]:
    """Register a parser by scanner name: any function from (spark, path) to rows of the raw shape. ``root`` is what a JSON report must have."""

    def keep(f: Reader) -> Reader:
        READERS[name] = f
        if root:
            ROOTS[name] = root, lines
        return f

    return keep


def rows(df: DataFrame, scanner: str, **fields: Column | str) -> DataFrame:
    """``df`` in the raw shape; fields not given are null."""
    types = dict(part.strip().split(" ", 1) for part in RAW.replace("array<string>", "array<string>").split(", "))
    given = {"path": F.col("path"), "scanner": F.lit(scanner), **{k: F.col(v) if isinstance(v, str) else v for k, v in fields.items()}}
    return df.select(*[(given[c] if c in given else F.lit(None)).cast(t).alias(c) for c, t in types.items()])


def json_reports(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """JSON reports with their path; what does not parse stays as a row with ``_corrupt``."""
    made = spark.read.schema(f"{schema}, _corrupt string").option("multiLine", not lines).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return made.withColumn("path", F.input_file_name())


def split_failures(reports: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """(good reports, failures with a reason): corrupt text, or a root that is not what the scanner writes."""
    reason = F.when(F.col("_corrupt").isNotNull(), "malformed report").when(F.col(root).isNull(), "unexpected root")
    judged = reports.withColumn("reason", reason)
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null").select("path", "reason")


def failures(spark: SparkSession, scanner: str, path: str) -> DataFrame:
    """(path, scanner, reason) of every report that a registered reader cannot read: malformed, or without the root the scanner writes."""
    if scanner in ROOTS:
        root, lines = ROOTS[scanner]
        failed = split_failures(json_reports(spark, path, f"`{root}` string", lines), root)[1]
    else:
        whole = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
        reason = F.when(~F.rlike("value", F.lit(r"(?s)<BugCollection[\s>/]")), "unexpected root").when(~F.rlike("value", F.lit(r"(?s)(</BugCollection>|/>)\s*$")), "malformed report")
        failed = whole.select("path", reason.alias("reason")).where("reason is not null")
    return failed.distinct().select("path", F.lit(scanner).alias("scanner"), "reason")


@reader("bandit", "results")
def bandit(spark: SparkSession, path: str) -> DataFrame:
    r = json_reports(spark, path, "results array<struct<test_id:string,issue_severity:string,issue_text:string,filename:string,line_number:int,issue_cwe:struct<id:int>>>").select("path", F.explode("results").alias("r"))
    return rows(r, "bandit", rule_id="r.test_id", severity="r.issue_severity", title="r.issue_text", file="r.filename", start_line="r.line_number", cwe=cwe_list(F.col("r.issue_cwe.id").cast("string")))


@reader("semgrep", "results")
def semgrep(spark: SparkSession, path: str) -> DataFrame:
    extra = "struct<severity:string,message:string,metadata:struct<cwe:array<string>>>"
    r = json_reports(spark, path, f"results array<struct<check_id:string,path:string,start:struct<line:int>,end:struct<line:int>,extra:{extra}>>").select("path", F.explode("results").alias("r"))
    return rows(r, "semgrep", rule_id="r.check_id", severity="r.extra.severity", title="r.extra.message", file="r.path", start_line="r.start.line", end_line="r.end.line", cwe=cwe_list(F.array_join("r.extra.metadata.cwe", " ")))


@reader("pip-audit", "dependencies")
def pip_audit(spark: SparkSession, path: str) -> DataFrame:
    r = json_reports(spark, path, "dependencies array<struct<name:string,version:string,vulns:array<struct<id:string,aliases:array<string>,description:string>>>>").select("path", F.explode("dependencies").alias("d")).select("path", "d", F.explode("d.vulns").alias("v"))
    return rows(r, "pip-audit", rule_id="v.id", title="v.description", ids=F.array_distinct(F.concat(F.array("v.id"), F.coalesce("v.aliases", F.array().cast("array<string>")))), package="d.name", version="d.version")


@reader("gitleaks", "RuleID")
def gitleaks(spark: SparkSession, path: str) -> DataFrame:
    """The root is an array: every element is a row."""
    r = json_reports(spark, path, "RuleID string, Description string, File string, StartLine int, EndLine int, Severity string").where("RuleID is not null")
    return rows(r, "gitleaks", rule_id="RuleID", severity="Severity", title="Description", file="File", start_line="StartLine", end_line="EndLine")


@reader("checkov", "results")
def checkov(spark: SparkSession, path: str) -> DataFrame:
    r = json_reports(spark, path, "results struct<failed_checks:array<struct<check_id:string,check_name:string,severity:string,file_path:string,file_line_range:array<int>>>>").select("path", F.explode("results.failed_checks").alias("r"))
    return rows(r, "checkov", rule_id="r.check_id", severity="r.severity", title="r.check_name", file="r.file_path", start_line=F.get("r.file_line_range", F.lit(0)), end_line=F.get("r.file_line_range", F.lit(1)))


@reader("hadolint", "code")
def hadolint(spark: SparkSession, path: str) -> DataFrame:
    r = json_reports(spark, path, "code string, message string, file string, line int, level string").where("code is not null")
    return rows(r, "hadolint", rule_id="code", severity="level", title="message", file="file", start_line="line")


@reader("gosec", "Issues")
def gosec(spark: SparkSession, path: str) -> DataFrame:
    r = json_reports(spark, path, "Issues array<struct<rule_id:string,severity:string,details:string,file:string,line:string,cwe:struct<id:string>>>").select("path", F.explode("Issues").alias("r"))
    return rows(r, "gosec", rule_id="r.rule_id", severity="r.severity", title="r.details", file="r.file", start_line=F.regexp_extract("r.line", r"^(\d+)", 1).try_cast("int"), cwe=cwe_list(F.col("r.cwe.id")))


@reader("brakeman", "warnings")
def brakeman(spark: SparkSession, path: str) -> DataFrame:
    r = json_reports(spark, path, "warnings array<struct<check_name:string,warning_type:string,message:string,file:string,line:int,cwe_id:array<int>>>").select("path", F.explode("warnings").alias("r"))
    return rows(r, "brakeman", rule_id="r.check_name", title="r.message", file="r.file", start_line="r.line", cwe=F.transform("r.cwe_id", lambda n: F.concat(F.lit("CWE-"), n.cast("string"))))


@reader("eslint-security", "filePath")
def eslint(spark: SparkSession, path: str) -> DataFrame:
    """File by message; messages of severity 0 are off and dropped."""
    r = json_reports(spark, path, "filePath string, messages array<struct<ruleId:string,severity:int,message:string,line:int,endLine:int>>").select("path", "filePath", F.explode("messages").alias("m")).where("m.severity > 0")
    return rows(r, "eslint-security", rule_id="m.ruleId", severity=F.when(F.col("m.severity") == 2, "ERROR").otherwise("WARNING"), title="m.message", file="filePath", start_line="m.line", end_line="m.endLine")


@reader("trivy", "Results")
def trivy(spark: SparkSession, path: str) -> DataFrame:
    """Vulnerabilities and misconfigurations are two branches of one report."""
    vuln = "array<struct<VulnerabilityID:string,PkgName:string,InstalledVersion:string,Severity:string,Title:string,CweIDs:array<string>>>"
    conf = "array<struct<ID:string,Severity:string,Title:string,CauseMetadata:struct<StartLine:int,EndLine:int>>>"
    each = json_reports(spark, path, f"Results array<struct<Target:string,Vulnerabilities:{vuln},Misconfigurations:{conf}>>").select("path", F.explode("Results").alias("r"))
    v = each.select("path", "r.Target", F.explode("r.Vulnerabilities").alias("v"))
    m = each.select("path", "r.Target", F.explode("r.Misconfigurations").alias("m"))
    return rows(v, "trivy", rule_id="v.VulnerabilityID", severity="v.Severity", title="v.Title", file="Target", cwe="v.CweIDs", ids=F.array("v.VulnerabilityID"), package="v.PkgName", version="v.InstalledVersion").unionByName(
        rows(m, "trivy", rule_id="m.ID", severity="m.Severity", title="m.Title", file="Target", start_line="m.CauseMetadata.StartLine", end_line="m.CauseMetadata.EndLine")
    )


@reader("zap", "site")
def zap(spark: SparkSession, path: str) -> DataFrame:
    """Site by alert by instance; an alert without instances is one row without a place."""
    alert = "struct<pluginid:string,alert:string,riskdesc:string,cweid:string,instances:array<struct<uri:string>>>"
    a = json_reports(spark, path, f"site array<struct<alerts:array<{alert}>>>").select("path", F.explode("site").alias("s")).select("path", F.explode("s.alerts").alias("a")).select("path", "a", F.explode_outer("a.instances").alias("i"))
    return rows(a, "zap", rule_id="a.pluginid", severity=F.regexp_extract("a.riskdesc", r"^(\w+)", 1), title="a.alert", file="i.uri", cwe=cwe_list(F.col("a.cweid")))


@reader("osv-scanner", "results")
def osv(spark: SparkSession, path: str) -> DataFrame:
    vuln = "struct<id:string,summary:string,aliases:array<string>,database_specific:struct<severity:string>>"
    p = json_reports(spark, path, f"results array<struct<source:struct<path:string>,packages:array<struct<package:struct<name:string,version:string,ecosystem:string>,vulnerabilities:array<{vuln}>>>>>")
    p = p.select("path", F.explode("results").alias("r")).select("path", "r", F.explode("r.packages").alias("p")).select("path", "r", "p", F.explode("p.vulnerabilities").alias("v"))
    return rows(p, "osv-scanner", rule_id="v.id", severity="v.database_specific.severity", title="v.summary", file="r.source.path", ids=F.array_distinct(F.concat(F.array("v.id"), F.coalesce("v.aliases", F.array().cast("array<string>")))), package="p.package.name", version="p.package.version")


@reader("grype", "matches")
def grype(spark: SparkSession, path: str) -> DataFrame:
    m = json_reports(spark, path, "matches array<struct<vulnerability:struct<id:string,severity:string,description:string>,artifact:struct<name:string,version:string>>>").select("path", F.explode("matches").alias("m"))
    return rows(m, "grype", rule_id="m.vulnerability.id", severity="m.vulnerability.severity", title="m.vulnerability.description", ids=F.array("m.vulnerability.id"), package="m.artifact.name", version="m.artifact.version")


def syft_packages(spark: SparkSession, path: str) -> DataFrame:
    """Artifacts are a package inventory, not findings."""
    return json_reports(spark, path, "artifacts array<struct<name:string,version:string,type:string,purl:string>>").select("path", F.explode("artifacts").alias("a")).select("path", "a.*")


@reader("trufflehog", "DetectorName", lines=True)
def trufflehog(spark: SparkSession, path: str) -> DataFrame:
    """A JSON document per line; verified secrets are high, others medium."""
    r = json_reports(spark, path, "DetectorName string, Verified boolean, SourceMetadata struct<Data:struct<Filesystem:struct<file:string,line:int>>>", lines=True).where("DetectorName is not null")
    return rows(r, "trufflehog", rule_id="DetectorName", severity=F.when(F.col("Verified"), "HIGH").otherwise("MEDIUM"), file="SourceMetadata.Data.Filesystem.file", start_line="SourceMetadata.Data.Filesystem.line")


@reader("codeql-sarif", "runs")
def sarif(spark: SparkSession, path: str) -> DataFrame:
    """Results meet the rules of their own run; severity is the rule's security score as a band, else the level."""
    props = "properties:struct<`security-severity`:string,tags:array<string>>"
    place = "array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int,endLine:int>>>>"
    schema = f"runs array<struct<tool:struct<driver:struct<rules:array<struct<id:string,{props}>>>>,results:array<struct<ruleId:string,level:string,message:struct<text:string>,locations:{place}>>>>"
    run = json_reports(spark, path, schema).select("path", F.posexplode("runs").alias("n", "run"))
    rules = run.select("path", "n", F.explode("run.tool.driver.rules").alias("rule")).select("path", "n", F.col("rule.id").alias("ruleId"), F.col("rule.properties").alias("p")).dropDuplicates(["path", "n", "ruleId"])
    results = run.select("path", "n", F.explode("run.results").alias("r")).withColumn("ruleId", F.col("r.ruleId")).join(rules, ["path", "n", "ruleId"], "left")
    score = F.col("p.security-severity").try_cast("double")
    band = F.when(score >= 9, "CRITICAL").when(score >= 7, "HIGH").when(score >= 4, "MEDIUM").when(score > 0, "LOW")
    at = F.get("r.locations", F.lit(0))["physicalLocation"]
    return rows(results, "codeql-sarif", rule_id="ruleId", severity=F.coalesce(band, F.upper("r.level")), title="r.message.text", file=at["artifactLocation"]["uri"], start_line=at["region"]["startLine"], end_line=at["region"]["endLine"], cwe=cwe_list(F.array_join("p.tags", " ")))


@reader("spotbugs")
def spotbugs(spark: SparkSession, path: str) -> DataFrame:
    """XML, a row per bug, at its first source line."""
    line = "array<struct<_sourcepath:string,_start:int,_end:int>>"
    r = spark.read.format("xml").option("rowTag", "BugInstance").schema(f"_type string, _priority string, _cweid string, LongMessage string, SourceLine {line}").load(path).withColumn("path", F.input_file_name())
    first = F.get("SourceLine", F.lit(0))
    return rows(r, "spotbugs", rule_id="_type", severity="_priority", title="LongMessage", file=first["_sourcepath"], start_line=first["_start"], end_line=first["_end"], cwe=cwe_list(F.col("_cweid")))


def report_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of every raw report."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def write_findings(findings: DataFrame, path: str, buckets: int = 64) -> None:
    """Findings as Parquet, partitioned by a bounded bucket of the repository."""
    findings.withColumn("repository_bucket", F.pmod(F.hash("repository"), F.lit(buckets))).write.mode("overwrite").partitionBy("repository_bucket").parquet(path)
