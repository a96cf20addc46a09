import hashlib
import json

from pyspark.sql import functions as F

from findingflow.operators.export import validate
from findingflow.sources import feeds, ingest, reports


def put(tmp_path, name, data):
    (tmp_path / name).write_text(data if isinstance(data, str) else json.dumps(data))
    return str(tmp_path / name)


def got(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_flat_reports(spark, tmp_path):
    p = put(tmp_path, "b.json", {"results": [{"test_id": "B1", "issue_severity": "HIGH", "filename": "a.py", "line_number": 3, "issue_cwe": {"id": 89}}]})
    assert got(reports.bandit(spark, p), "scanner", "rule_id", "severity", "file", "start_line", "cwe") == [("bandit", "B1", "HIGH", "a.py", 3, ["CWE-89"])]
    p = put(tmp_path, "g.json", [{"RuleID": "aws", "File": "x", "StartLine": 1}, {"RuleID": "jwt", "File": "y", "StartLine": 2}])
    assert got(reports.gitleaks(spark, p), "rule_id", "file", "start_line") == [("aws", "x", 1), ("jwt", "y", 2)]
    p = put(tmp_path, "e.json", [{"filePath": "a.js", "messages": [{"ruleId": "r", "severity": 0}, {"ruleId": "s", "severity": 2, "line": 4}]}])
    assert got(reports.eslint(spark, p), "rule_id", "severity", "file") == [("s", "ERROR", "a.js")]
    p = put(tmp_path, "t.json", '{"DetectorName": "AWS", "Verified": true}\n{"DetectorName": "X", "Verified": false}\n')
    assert got(reports.trufflehog(spark, p), "rule_id", "severity") == [("AWS", "HIGH"), ("X", "MEDIUM")]
    p = put(tmp_path, "go.json", {"Issues": [{"rule_id": "G1", "severity": "LOW", "file": "m.go", "line": "12-14", "cwe": {"id": "78"}}]})
    assert got(reports.gosec(spark, p), "rule_id", "start_line", "cwe") == [("G1", 12, ["CWE-78"])]


def test_nested_reports(spark, tmp_path):
    p = put(tmp_path, "p.json", {"dependencies": [{"name": "a", "version": "1", "vulns": [{"id": "PYSEC-1", "aliases": ["CVE-1"]}, {"id": "PYSEC-2"}]}, {"name": "b", "version": "2", "vulns": []}]})
    assert got(reports.pip_audit(spark, p), "rule_id", "package", "ids") == [("PYSEC-1", "a", ["PYSEC-1", "CVE-1"]), ("PYSEC-2", "a", ["PYSEC-2"])]
    p = put(tmp_path, "tr.json", {"Results": [{"Target": "img", "Vulnerabilities": [{"VulnerabilityID": "CVE-2", "PkgName": "z", "Severity": "LOW"}]}, {"Target": "Dockerfile", "Misconfigurations": [{"ID": "DS1", "Severity": "HIGH", "CauseMetadata": {"StartLine": 7}}]}]})
    assert got(reports.trivy(spark, p), "rule_id", "file") == [("CVE-2", "img"), ("DS1", "Dockerfile")]
    p = put(tmp_path, "z.json", {"site": [{"alerts": [{"pluginid": "10", "riskdesc": "High (Medium)", "cweid": "79", "instances": [{"uri": "/a"}, {"uri": "/b"}]}, {"pluginid": "11", "riskdesc": "Low", "cweid": "-1"}]}]})
    assert [(r.rule_id, r.severity, r.file) for r in reports.zap(spark, p).orderBy("rule_id", "file").collect()] == [("10", "High", "/a"), ("10", "High", "/b"), ("11", "Low", None)]
    p = put(tmp_path, "o.json", {"results": [{"source": {"path": "lock"}, "packages": [{"package": {"name": "q", "version": "3"}, "vulnerabilities": [{"id": "GHSA-1"}]}]}]})
    assert got(reports.osv(spark, p), "rule_id", "package", "file") == [("GHSA-1", "q", "lock")]
    p = put(tmp_path, "s.json", {"artifacts": [{"name": "n", "version": "1", "type": "deb"}]})
    assert got(reports.syft_packages(spark, p), "name", "type") == [("n", "deb")]


def test_sarif_and_xml(spark, tmp_path):
    rule = lambda i, s: {"id": i, "properties": {"security-severity": s, "tags": ["external/cwe/cwe-079"]}}
    result = {"ruleId": "r1", "level": "note", "message": {"text": "m"}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": "a.js"}, "region": {"startLine": 5}}}]}
    p = put(tmp_path, "s.sarif", {"runs": [{"tool": {"driver": {"rules": [rule("r1", "9.1")]}}, "results": [result]}, {"tool": {"driver": {"rules": []}}, "results": [result]}]})
    assert [(r.severity, r.cwe, r.start_line) for r in reports.sarif(spark, p).orderBy("severity").collect()] == [("CRITICAL", ["CWE-79"], 5), ("NOTE", [], 5)]
    p = put(tmp_path, "b.xml", '<BugCollection><BugInstance type="SQL" priority="1" cweid="89"><LongMessage>m</LongMessage><SourceLine sourcepath="A.java" start="3" end="4"/><SourceLine sourcepath="B.java" start="9" end="9"/></BugInstance></BugCollection>')
    assert got(reports.spotbugs(spark, p), "rule_id", "severity", "file", "start_line") == [("SQL", "1", "A.java", 3)]


def test_failures_digests_and_writing(spark, tmp_path):
    put(tmp_path, "ok.json", {"results": []})
    put(tmp_path, "bad.json", "{nope")
    put(tmp_path, "odd.json", {"other": 1})
    good, failed = reports.split_failures(reports.json_reports(spark, f"{tmp_path}/*.json", "results array<struct<test_id:string>>"), "results")
    assert good.count() == 1 and sorted((r.path.rsplit("/")[-1], r.reason) for r in failed.collect()) == [("bad.json", "malformed report"), ("odd.json", "unexpected root")]
    d = {r.path.rsplit("/")[-1]: r.sha256 for r in reports.report_digests(spark, f"{tmp_path}/*.json").collect()}
    assert d["bad.json"] == hashlib.sha256(b"{nope").hexdigest()
    reports.write_findings(spark.createDataFrame([("r", 1)], "repository string, n int"), f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 1
    assert set(reports.READERS) >= {"bandit", "trivy", "zap", "codeql-sarif", "spotbugs"} and len(reports.READERS) == 16


def test_feeds(spark, tmp_path):
    p = put(tmp_path, "osv.json", {"id": "GHSA-1", "aliases": ["CVE-1"], "affected": [{"ranges": [{"events": [{"introduced": "0"}, {"fixed": "2"}]}, {"events": [{"fixed": "1"}]}]}]})
    assert got(feeds.read_osv(spark, p), "advisory_ids", "fixed_versions") == [(["GHSA-1", "CVE-1"], ["1", "2"])]
    score = lambda s: [{"cvssData": {"baseScore": s}}]
    p = put(tmp_path, "nvd.json", {"vulnerabilities": [{"cve": {"id": "CVE-2", "metrics": {"cvssMetricV2": score(5.0), "cvssMetricV31": score(7.5)}}}]})
    assert got(feeds.read_nvd(spark, p), "cvss_score", "cvss_version") == [(7.5, "3.1")]
    assert got(feeds.read_epss(spark, put(tmp_path, "e.json", {"cve": "CVE-3", "epss": "0.5"})), "epss") == [(0.5,)]
    assert got(feeds.read_kev(spark, put(tmp_path, "k.json", {"vulnerabilities": [{"cveID": "CVE-4"}]})), "kev", "source") == [(True, "cisa-kev")]
    p = put(tmp_path, "gh.json", {"ghsa_id": "GHSA-5", "cve_id": None, "cvss": {"score": 9.0}, "vulnerabilities": [{"first_patched_version": "3"}]})
    assert got(feeds.read_github(spark, p), "advisory_ids", "cvss_score", "fixed_versions") == [(["GHSA-5"], 9.0, ["3"])]


GOOD = {
    "bandit": {"results": []}, "semgrep": {"results": []}, "pip-audit": {"dependencies": []}, "gitleaks": [{"RuleID": "aws"}], "checkov": {"results": {"failed_checks": []}}, "hadolint": [{"code": "DL1"}], "gosec": {"Issues": []},
    "brakeman": {"warnings": []}, "eslint-security": [{"filePath": "a.js", "messages": []}], "trivy": {"Results": []}, "zap": {"site": []}, "osv-scanner": {"results": []}, "grype": {"matches": []}, "trufflehog": {"DetectorName": "AWS"},
    "codeql-sarif": {"runs": []}, "spotbugs": "<BugCollection></BugCollection>",
}


def test_every_reader_reports_what_it_cannot_read(spark, tmp_path):
    assert set(GOOD) == set(reports.READERS)
    for scanner, good in GOOD.items():
        folder = tmp_path / scanner
        folder.mkdir()
        put(folder, "good", good)
        put(folder, "bad", "<BugCollection><BugInst" if scanner == "spotbugs" else '{"x')
        put(folder, "odd", "<other/>" if scanner == "spotbugs" else {"other": 1})
        found = reports.failures(spark, scanner, str(folder))
        assert sorted((r.path.rsplit("/")[-1], r.reason) for r in found.collect()) == [("bad", "malformed report"), ("odd", "unexpected root")], scanner


def test_reports_end_in_the_contract(spark, tmp_path):
    put(tmp_path, "b.json", {"results": [{"test_id": "B1", "issue_severity": "HIGH", "issue_text": "", "filename": "./a//b.py", "line_number": 0, "issue_cwe": {"id": 89}}]})
    put(tmp_path, "bad.json", "{nope")
    found, failed = ingest.ingest(spark, "bandit", str(tmp_path), F.lit("r"), F.lit("1"), F.lit("2024-01-01T00:00:00Z"))
    (r,) = found.collect()
    assert (r.file, r.start_line, r.severity, r.title, r.cwe, r.category, r.status) == ("a/b.py", None, "high", "B1", ["CWE-89"], "sast", "open") and r.fingerprint.startswith("v2:sha256:")
    assert failed.count() == 1 and validate(found.withColumn("row_id", F.lit(1))).count() == 0
    p = put(tmp_path / "..", "p.json", {"dependencies": [{"name": "a", "version": "1", "vulns": [{"id": "PYSEC-1", "aliases": ["CVE-2024-1234", "GHSA-a1b2-c3d4-e5f6"]}]}]})
    (r,) = ingest.ingest(spark, "pip-audit", p, F.lit("r"), F.lit("1"), F.lit("2024-01-01T00:00:00Z"))[0].collect()
    assert (r.category, r.cve, r.ghsa, r.osv, r.dep_name, r.dep_ecosystem) == ("sca", ["CVE-2024-1234"], ["GHSA-a1b2-c3d4-e5f6"], ["PYSEC-1"], "a", "pypi")


def test_contract_breaches(spark):
    row = dict(row_id=1, cwe=["CWE-0", "CWE-0"], osv=[""], start_line=0, confidence=1.5, severity="awful", title="t" * 1025, introduced_commit="z")
    schema = "row_id int, cwe array<string>, osv array<string>, start_line int, confidence double, severity string, title string, introduced_commit string"
    got = {r.code for r in validate(spark.createDataFrame([tuple(row.values())], schema)).collect()}
    assert got >= {"cwe:pattern", "cwe:unique", "osv:pattern", "start_line:range", "confidence:range", "severity:enum", "title:length", "introduced_commit:pattern", "fingerprint:required", "evidence:required"}
    assert "title:required" not in got
