"""Export, redaction, validation and supply queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import redact
from ..operators import export, supply
from ._registry import query
from .findings import FINGERPRINTS, RANKED, canonical
from .portfolio import R6


ASSIGNED = r"""(^|[^A-Za-z0-9_])([A-Za-z0-9_]*(?:api[_-]?key|password|passwd|secret|token|private[_-]?key)[A-Za-z0-9_]*\s*[:=]\s*)(?:"[^"''\r\n]+"|''[^"''\r\n]+'')"""
QUOTED = r"""((?:^|[^A-Za-z0-9_])[A-Za-z0-9_]*(?:api[_-]?key|password|passwd|secret|token|private[_-]?key)[A-Za-z0-9_]*\s*[:=]\s*)"""
AWS = "'(AKIA|ASIA)[A-Z0-9]{16}'"
KEYS = r"'-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----(.|\s)*?-----END [A-Z0-9 ]*PRIVATE KEY-----'"


@query(
    rf"""WITH d AS (SELECT doc_id, text || ' ' || CASE doc_id % 4 WHEN 0 THEN 'ASIA' ELSE 'AKIA' END || 'ABCDEFGH12345678 db_password = "x y" -----BEGIN EC2 PRIVATE KEY-----' || chr(10) || 'k' || chr(10) || '-----END EC2 PRIVATE KEY-----' AS text FROM documents WHERE text IS NOT NULL),
    a AS (SELECT doc_id, regexp_replace(regexp_replace(text, '{QUOTED}"[^"''\r\n]+"', '\1"[REDACTED]"', 'gi'), '{QUOTED}''[^"''\r\n]+''', concat('\1', chr(39), '[REDACTED]', chr(39)), 'gi') AS t, len(regexp_extract_all(text, '(?i){ASSIGNED}')) AS n FROM d),
    b AS (SELECT doc_id, regexp_replace(t, '(\bBearer\s+)[A-Za-z0-9._~+/=-]{{8,}}', '\1[REDACTED]', 'gi') AS t, n + len(regexp_extract_all(t, '(?i)\bBearer\s+[A-Za-z0-9._~+/=-]{{8,}}')) AS n FROM a)
    SELECT doc_id, regexp_replace(regexp_replace(t, {AWS}, '[REDACTED]', 'g'), {KEYS}, '[REDACTED]', 'g') AS text, cast(n + len(regexp_extract_all(t, {AWS})) + len(regexp_extract_all(t, {KEYS})) AS bigint) AS n_redacted FROM b""",
    documents="documents",
)
def p13_redact_secrets(documents):
    more = F.concat(F.col("text"), F.lit(" "), F.when(F.col("doc_id") % 4 == 0, "ASIA").otherwise("AKIA"), F.lit('ABCDEFGH12345678 db_password = "x y" -----BEGIN EC2 PRIVATE KEY-----\nk\n-----END EC2 PRIVATE KEY-----'))
    return documents.where("text is not null").select("doc_id", redact.redact_text(more).alias("r")).select("doc_id", "r.text", "r.n_redacted")


@query("""SELECT event_id, concat('{"list":[{"api-key":"[REDACTED]","n":', cast(user_id AS varchar), '}],"props":', regexp_replace(props, '": ', '":', 'g'), ',"token":"[REDACTED]"}') AS document FROM events""", events="events")
def p14_redact_json(events):
    nested = F.concat(F.lit('{"token": {"a": 1}, "list": [{"n": '), F.col("user_id").cast("string"), F.lit(', "api-key": "x"}], "props": '), F.col("props"), F.lit("}"))
    return events.select("event_id", redact.redact_json(nested).alias("document"))


@query(
    """SELECT row_id, concat('[', upper(severity), '] ', scanner, ': ', rule_id) AS title, concat('security:', severity, ',scanner:', scanner) AS labels, cast(CASE severity WHEN 'critical' THEN 10 WHEN 'high' THEN 7 WHEN 'medium' THEN 4 WHEN 'low' THEN 2 ELSE 0 END AS int) AS cef_severity FROM findings""",
    findings="findings",
)
def p15_payload(findings):
    return findings.select("row_id", export.payload().alias("p")).select("row_id", "p.title", F.array_join("p.labels", ",").alias("labels"), "p.cef_severity")


@query(
    """SELECT cast(row_id AS varchar) AS finding_id, concat('{"title":"[', upper(severity), '] ', scanner, ': ', rule_id, '","labels":["security:', severity, '","scanner:', scanner, '"],"cef_severity":', cast(CASE severity WHEN 'critical' THEN 10 WHEN 'high' THEN 7 WHEN 'medium' THEN 4 WHEN 'low' THEN 2 ELSE 0 END AS varchar), '}') AS payload FROM findings""",
    findings="findings",
)
def s11_payload_rows(findings):
    return export.payload_rows(findings.withColumn("finding_id", F.col("row_id").cast("string")))


@query(
    f"""WITH {FINGERPRINTS}, r AS (SELECT *, row_number() OVER (PARTITION BY run_id, rule_id ORDER BY {RANKED} DESC, fingerprint) AS n FROM canon)
    SELECT run_id, rule_id, cast(row_number() OVER (PARTITION BY run_id ORDER BY rule_id) - 1 AS int) AS rule_index, severity, fingerprint FROM r WHERE n = 1""",
    findings="findings",
)
def w3_sarif_rules(findings):
    return export.sarif_rules(canonical(findings))


@query(
    f"""WITH {FINGERPRINTS}, i AS (SELECT run_id, rule_id, cast(row_number() OVER (PARTITION BY run_id ORDER BY rule_id) - 1 AS int) AS rule_index FROM canon GROUP BY 1, 2)
    SELECT run_id, cast(row_id AS varchar) AS finding_id, rule_id, rule_index, CASE WHEN severity IN ('critical', 'high') THEN 'error' WHEN severity = 'medium' THEN 'warning' ELSE 'note' END AS level, left(sha256(concat_ws('|', rule_id, file, fingerprint)), 16) AS partial_fingerprint FROM canon JOIN i USING (run_id, rule_id)""",
    findings="findings",
)
def w3_sarif_results(findings):
    return export.sarif_results(canonical(findings).withColumn("finding_id", F.col("row_id").cast("string")))


@query("SELECT scanner, " + ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in ("critical", "high", "medium", "low", "info", "unknown")) + ", count(*) AS total, round(count(*) FILTER (severity IN ('low', 'info')) / count(*), 6) AS noise_share FROM findings GROUP BY 1", findings="findings")
def a28_cross_tab(findings):
    return R6(export.cross_tab(findings), "noise_share")


@query(
    "WITH f AS (SELECT DISTINCT concat('F', cast(user_id AS string)) AS finding_id, event_type AS source, event_id % 50 AS fetched_at FROM scanner_runs WHERE event_id % 4 > 0) SELECT * FROM f UNION ALL SELECT finding_id, '(all)', max(fetched_at) FROM f GROUP BY 1",
    runs="scanner_runs",
)
def a32_timeline(runs):
    return export.timeline(runs.selectExpr("concat('F', cast(user_id AS string)) AS finding_id", "event_type AS source", "CASE WHEN event_id % 4 > 0 THEN event_id % 50 END AS fetched_at"))


@query(
    """SELECT row_id, CASE WHEN row_id % 9 = 0 THEN 'unknown' ELSE scanner END AS scanner, CASE WHEN row_id % 8 = 0 THEN 'unknown' ELSE rule_id END AS rule_id, CASE WHEN row_id % 9 = 0 THEN 'sast' WHEN scanner IN ('pip-audit', 'trivy') THEN 'sca' WHEN scanner = 'checkov' THEN 'iac' WHEN scanner = 'zap' THEN 'dast' ELSE 'sast' END AS category,
    coalesce(cast(CASE WHEN start_line > 100 THEN start_line - 100 END AS varchar), '') AS start_line, CASE WHEN row_id % 7 > 0 THEN confidence END AS confidence, concat('y', cast(run_year AS string)) AS first_seen, concat('y', cast(run_year AS string)) AS last_seen FROM findings""",
    findings="findings",
)
def p9_migrate(findings):
    legacy = findings.select("row_id", F.when(F.col("row_id") % 9 == 0, "  ").otherwise(F.concat(F.lit(" "), F.upper("scanner"))).alias("tool"), F.when(F.col("row_id") % 8 > 0, F.concat("rule_id", F.lit(" "))).alias("rule_id"), (F.col("start_line") - 100).alias("line"),
        F.when(F.col("row_id") % 7 == 0, 1.5).otherwise(F.col("confidence")).alias("confidence"), F.concat(F.lit("y"), F.col("run_year").cast("string")).alias("first_seen"), F.lit(None).cast("string").alias("last_seen"))
    return export.migrate(legacy).withColumn("start_line", F.coalesce(F.col("start_line").cast("string"), F.lit("")))


@query(f"WITH {FINGERPRINTS} SELECT row_id, fingerprint, CASE WHEN row_id % 3 = 0 THEN concat('seen,previous-fingerprint:v1:', cast(row_id AS varchar)) ELSE 'seen' END AS evidence FROM canon", findings="findings")
def p10_migrate_fingerprint(findings):
    c = canonical(findings).withColumnRenamed("fingerprint", "new_fingerprint")
    old = c.withColumns({"fingerprint": F.when(F.col("row_id") % 3 == 0, F.concat(F.lit("v1:"), F.col("row_id").cast("string"))).otherwise(F.col("new_fingerprint")), "evidence": F.array(F.lit("seen"))})
    return export.migrate_fingerprint(old).select("row_id", "fingerprint", F.array_join("evidence", ",").alias("evidence"))


@query("SELECT case_id AS blind_id, sha256(concat(case_id, chr(10), cast(first_label AS varchar), chr(10), 's1')) AS commitment, first_label = second_label AS ok FROM reviews", reviews="reviews")
def p18_commitments(reviews):
    published = F.sha2(F.concat_ws("\n", "case_id", F.col("second_label").cast("string"), F.lit("s1")), 256)
    return export.commitments(reviews.select(F.col("case_id").alias("blind_id"), F.col("first_label").cast("string").alias("decision"), F.lit("s1").alias("salt"), published.alias("published")))


BREACHES = {
    "severity:enum": "row_id % 5 = 0", "reachability:enum": "row_id % 29 = 0", "status:enum": "row_id % 31 = 0", "dependency_scope:enum": "row_id % 37 = 0", "start_line:range": "start_line < 101", "end_line:range": "row_id % 41 = 0",
    "confidence:range": "confidence > 0.5", "occurrence_count:range": "row_id % 43 = 0", "cwe:pattern": "cwe = 'CWE-22'", "cwe:unique": "cwe = 'CWE-89' AND row_id % 2 = 0", "cve:pattern": "row_id % 47 = 0", "finding_id:required": "row_id % 11 = 0",
    "title:required": "row_id % 13 = 0", "title:length": "row_id % 13 = 1", "rule_version:length": "row_id % 17 = 0", "introduced_commit:pattern": "row_id % 19 = 0", "last_seen:required": "row_id % 53 = 0", "evidence:required": "row_id % 59 = 0", "severity_reason:length": "row_id % 61 = 0", "original_severity:length": "original_severity = ''",
}


@query(" UNION ALL ".join(f"SELECT row_id, '{code}' AS code FROM findings WHERE {where}" for code, where in BREACHES.items()), findings="findings")
def v1_validate(findings):
    bad = lambda n, wrong, right: F.when(F.col("row_id") % n == 0, wrong).otherwise(right)
    none, text = F.lit(None), F.array().cast("array<string>")
    weakness = F.array_compact(F.array(F.replace("cwe", F.lit("CWE-22"), F.lit("CWE22")), F.when((F.col("cwe") == "CWE-89") & (F.col("row_id") % 2 == 0), F.col("cwe"))))
    f = findings.withColumns(
        {
            "severity": bad(5, "awful", F.col("severity")), "reachability": bad(29, "maybe", F.col("reachability")), "status": bad(31, "gone", F.col("status")), "dependency_scope": bad(37, "peer", none), "start_line": F.col("start_line") - 100, "end_line": bad(41, 0, 1),
            "confidence": F.col("confidence") * 2, "occurrence_count": bad(43, 0, 1), "cwe": weakness, "cve": bad(47, F.array(F.lit("CVE-24-1")), text), "ghsa": F.array(F.lit("GHSA-a1b2-c3d4-e5f6")), "osv": text, "finding_id": bad(11, none, "f"),
            "title": F.when(F.col("row_id") % 13 == 0, none).when(F.col("row_id") % 13 == 1, F.repeat(F.lit("t"), 1025)).otherwise("t"), "rule_version": bad(17, "", none), "introduced_commit": bad(19, "xyz", "0123abc"), "first_seen": F.col("opened_at"), "last_seen": bad(53, none, F.col("opened_at")),
            "evidence": bad(59, none, text), "severity_reason": bad(61, "", "r"), "description": F.lit(""), "fingerprint": F.lit("v2:x"),
        }
    )
    return export.validate(f)


@query("SELECT event_id AS document_id, event_id % 3 > 0 AS ok FROM events", events="events")
def v13_verify_digests(events):
    stored = F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("sha256:"), F.sha2("props", 256))).otherwise("sha256:0")
    return export.verify_digests(events.select(F.col("event_id").alias("document_id"), F.col("props").alias("canonical"), stored.alias("stored")))


FILES = "SELECT DISTINCT repository, CASE WHEN row_id % 23 = 0 THEN concat('vendor/', file) WHEN row_id % 19 = 0 THEN concat('tests/', replace(file, '.py', '.js')) ELSE file END AS path FROM findings"


def files_of(findings: DataFrame) -> DataFrame:
    return findings.sparkSession.sql(FILES.replace("FROM findings", "FROM {f}"), f=findings)


TREE = """SELECT concat('repo-', cast(p_partkey % 50 AS string)) AS repository, concat('svc', cast(p_size % 3 AS string)) AS root, p_partkey % 13 AS k,
    concat('svc', cast(p_size % 3 AS string), '/', CASE p_partkey % 13 WHEN 0 THEN 'package.json' WHEN 1 THEN 'src/App.tsx' WHEN 2 THEN 'go.mod' WHEN 3 THEN 'Pipfile.lock' WHEN 4 THEN '__tests__/t_case.py' WHEN 5 THEN 'node_modules/m/i.js' WHEN 6 THEN 'dist/app.js'
      WHEN 7 THEN 'Dockerfile.dev' WHEN 8 THEN 'deploy.yaml' WHEN 9 THEN 'infra/main.tf' WHEN 10 THEN 'stack.json' WHEN 11 THEN 'api.yml' ELSE 'requirements-dev.txt' END) AS path,
    CASE p_partkey % 13 WHEN 8 THEN concat('apiVersion: v1', chr(10), 'kind: Pod') WHEN 10 THEN 'AWSTemplateFormatVersion: 1' WHEN 11 THEN 'openapi: 3.0' END AS text,
    CASE p_partkey % 13 WHEN 0 THEN 'react' WHEN 2 THEN 'github.com/gin-gonic/gin/v2' WHEN 12 THEN 'Flask' ELSE 'other' END AS name, CASE p_partkey % 13 WHEN 12 THEN 'development' ELSE 'runtime' END AS scope FROM part"""


def tree(part: DataFrame) -> DataFrame:
    return part.sparkSession.sql(TREE.replace("FROM part", "FROM {p}"), p=part)


def known(name: str, cases: dict[int, str]) -> str:
    """SQL for the sorted distinct values of the given cases of ``k``."""
    case = "CASE k " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in cases.items()) + " END"
    return f"coalesce(string_agg(DISTINCT {case}, ',' ORDER BY {case}), '') AS {name}"


N = lambda k, name: f"count(*) FILTER (k = {k}) AS {name}"


@query(
    f"""WITH t AS ({TREE}) SELECT repository, count(*) FILTER (k NOT IN (5, 6)) AS files, {known("languages", {0: "javascript", 1: "typescript", 4: "python"})}, {known("managers", {0: "npm", 2: "go-modules", 3: "pipenv", 12: "pip"})},
    {known("build_systems", {0: "npm", 2: "go", 12: "python"})}, {N(3, "lock_files")}, {N(7, "container_files")}, {N(8, "kubernetes_files")}, {N(9, "terraform_files")}, {N(10, "cloudformation_files")}, {N(11, "openapi_specifications")},
    coalesce(string_agg(DISTINCT CASE WHEN k = 4 THEN root || '/__tests__' END, ',' ORDER BY CASE WHEN k = 4 THEN root || '/__tests__' END), '') AS test_directories, {N(6, "generated_files")}, {N(5, "vendored_files")},
    {known("frameworks", {0: "react", 2: "gin", 12: "flask"})}, count(*) FILTER (k <> 12) AS runtime_dependencies, count(*) FILTER (k = 12) AS development_dependencies FROM t GROUP BY 1""",
    part="part",
)
def a30_inventory(part):
    return supply.inventory(tree(part), tree(part))


@query(
    """SELECT concat('repo-', cast(p_partkey % 50 AS string)) AS repository, concat('m/', cast(p_partkey AS string), '/requirements-dev.txt') AS path, replace(p_name, ' ', '-') AS name, concat('==', cast(p_size AS string)) AS "constraint", 'development' AS scope FROM part
    UNION ALL SELECT concat('repo-', cast(p_partkey % 50 AS string)), concat('m/', cast(p_partkey AS string), '/package.json'), lower(p_brand), '^1', 'runtime' FROM part UNION ALL SELECT concat('repo-', cast(p_partkey % 50 AS string)), concat('m/', cast(p_partkey AS string), '/package.json'), 'jest', '*', 'development' FROM part""",
    part="part",
)
def a31_dependencies(part):
    at = lambda name: F.concat(F.lit("m/"), F.col("p_partkey").cast("string"), F.lit("/" + name))
    repo = F.concat(F.lit("repo-"), (F.col("p_partkey") % 50).cast("string")).alias("repository")
    pip = part.select(repo, at("requirements-dev.txt").alias("path"), F.concat(F.lit("# pins\n"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("[x] =="), F.col("p_size").cast("string"), F.lit("  # why\n")).alias("text"))
    npm = part.select(repo, at("package.json").alias("path"), F.concat(F.lit('{"dependencies": {"'), F.lower("p_brand"), F.lit('": "^1"}, "devDependencies": {"jest": "*"}}')).alias("text"))
    return supply.dependencies_from_text(pip.unionByName(npm))


@query(f"WITH f AS ({FILES}) SELECT repository, path, CASE WHEN path LIKE 'vendor/src/%' THEN 'vendor/src' WHEN path LIKE 'vendor/%' THEN 'vendor' ELSE '' END AS root FROM f", findings="findings")
def j25_package_owner(findings):
    f = files_of(findings)
    return supply.package_owner(f, f.select("repository", F.explode(F.array(F.lit(""), F.lit("vendor"), F.lit("vendor/src"), F.lit("ven"))).alias("root")))


@query(
    f"""WITH t AS ({TREE}), s AS (SELECT * FROM t WHERE k NOT IN (5, 6)) SELECT repository, 'bandit' AS scanner, root, count(*) AS files FROM s WHERE k = 4 GROUP BY 1, 3 UNION ALL SELECT repository, 'eslint-security', root, count(*) FROM s WHERE k = 1 GROUP BY 1, 3
    UNION ALL SELECT repository, 'checkov', root, count(*) FROM s WHERE k IN (7, 9) GROUP BY 1, 3 UNION ALL SELECT repository, 'gitleaks', '.', count(*) FROM s GROUP BY 1""",
    part="part",
)
def j24_scanner_plan(part):
    return supply.scanner_plan(tree(part), [("bandit", ("python",), (), False), ("eslint-security", ("javascript", "typescript"), (), False), ("checkov", (), ("infra/*.tf", "Dockerfile*"), False), ("gitleaks", (), (), True), ("gosec", ("go",), (), False)])


@query(f"WITH f AS ({FILES}) SELECT repository, path FROM f WHERE path LIKE 'vendor/%'", findings="findings")
def v9_changed_files(findings):
    f = files_of(findings)
    return supply.changed_files(f, f.where("path like 'vendor/%'"))


@query("SELECT DISTINCT repository, dep_name AS name, CASE WHEN length(dep_name) % 3 = 0 THEN 'b' ELSE 'a' END AS checksum FROM findings WHERE dep_name IS NOT NULL AND (length(dep_name) % 3 = 0 OR repository = 'repo-7')", findings="findings")
def v9_changed_packages(findings):
    p = findings.where("dep_name is not null").select("repository", F.col("dep_name").alias("name"), F.when(F.length("dep_name") % 3 == 0, "b").otherwise("a").alias("checksum")).distinct()
    return supply.changed_packages(p, p.where("repository <> 'repo-7'").withColumn("checksum", F.lit("a")))


@query("SELECT concat('m/', cast(p_partkey AS varchar), '/requirements.txt') AS path, cast(p_size AS int) AS line_number, 'requirement' AS code FROM part WHERE p_partkey % 3 > 0 AND p_partkey % 4 > 0", part="part")
def v10_unpinned(part):
    line = F.when(F.col("p_partkey") % 4 == 0, "# note").when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit("==1"))).otherwise(F.concat("p_name", F.lit(">=1")))
    return supply.unpinned(part.select(F.concat(F.lit("m/"), F.col("p_partkey").cast("string"), F.lit("/requirements.txt")).alias("path"), F.col("p_size").cast("int").alias("line_number"), line.alias("line")))


@query(
    """SELECT concat('c', cast(p_partkey AS varchar)) AS subject, 'language:domain' AS code FROM part WHERE p_partkey % 5 = 4 UNION ALL SELECT 'language=Cobol', 'coverage' UNION ALL SELECT concat('c', cast(p_partkey AS varchar)), 'pairing' FROM part WHERE p_partkey % 10 = 7
    UNION ALL SELECT concat('f', cast(p_partkey AS varchar)), 'unreferenced' FROM part WHERE p_partkey % 6 = 5 UNION ALL SELECT concat('f', cast(p_partkey AS varchar)), 'undeclared' FROM part WHERE p_partkey % 6 < 5 AND p_partkey % 7 = 3""",
    part="part",
)
def v11_corpus_check(part):
    key = F.col("p_partkey")
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    language = F.element_at(F.array(*map(F.lit, ("Go", "Ruby", "Java", "PHP", "Perl"))), (key % 5 + 1).cast("int"))
    pair = F.when(key % 10 == 7, name("c", F.lit(-1))).when(key % 2 == 0, name("c", F.when(key % 4 == 0, key).otherwise(key)))
    cases = part.select(name("c", key).alias("case_id"), language.alias("language"), pair.alias("paired_case_id"), F.when(key % 6 < 5, F.array(name("f", key))).otherwise(F.array().cast("array<string>")).alias("files"))
    files = part.where("p_partkey % 7 <> 3 or p_partkey % 6 = 5").select(name("f", key).alias("path"))
    return supply.corpus_check(cases, files, {"language": ["Go", "Ruby", "Java", "PHP", "Cobol"]})


@query(
    """SELECT cast(p_partkey AS varchar) AS value, 'shared item_id' AS code FROM part WHERE p_partkey % 12 = 0 UNION ALL SELECT DISTINCT p_type, 'shared hash' FROM part WHERE p_partkey % 3 = 0 AND p_type IN (SELECT p_type FROM part WHERE p_partkey % 4 = 0)
    UNION ALL SELECT DISTINCT p_brand, 'tuning input' FROM part WHERE p_size < 5 AND p_brand NOT IN (SELECT p_brand FROM part WHERE p_size > 48)""",
    part="part",
)
def v12_leakage(part):
    side = lambda c: part.where(c).select(F.col("p_type").alias("hash"), F.col("p_partkey").alias("item_id"))
    names = lambda c: part.where(c).select(F.col("p_brand").alias("name")).distinct()
    return supply.leakage(side("p_partkey % 3 = 0"), side("p_partkey % 4 = 0"), names("p_size < 5"), names("p_size > 48"))


CONTROLS = "SELECT concat('C', cast(n_nationkey AS string)) AS control_id, CASE n_nationkey % 4 WHEN 0 THEN 'SAST findings of Bandit' WHEN 1 THEN 'IaC checks' WHEN 2 THEN 'container scans by trivy and SCA' ELSE 'access reviews' END AS evidence FROM nation"


@query(
    f"""WITH c AS ({CONTROLS}), p AS (SELECT category, scanner, count(*) AS n FROM findings GROUP BY 1, 2) SELECT control_id, evidence, cast(coalesce(sum(n), 0) AS bigint) AS n, CASE WHEN sum(n) > 0 THEN 'evidence_available' ELSE 'no_evidence' END AS status FROM c LEFT JOIN p ON contains(lower(evidence), category) OR contains(lower(evidence), scanner) GROUP BY 1, 2""",
    findings="findings",
    nation="nation",
)
def j19_compliance_evidence(findings, nation):
    return supply.compliance_evidence(findings, nation.sparkSession.sql(CONTROLS.replace("FROM nation", "FROM {n}"), n=nation))


@query("SELECT row_id, CASE WHEN cwe = 'CWE-79' THEN 'escape output' ELSE 'bind parameters' END AS guidance FROM findings WHERE (cwe = 'CWE-79' AND rule_id = 'R4') OR (cwe = 'CWE-89' AND rule_id = 'R5')", findings="findings")
def j18_attach_guidance(findings):
    profiles = findings.select("rule_id").distinct().where("rule_id in ('R4', 'R5')").select("rule_id", F.explode(F.array(F.struct(F.array(F.lit("CWE-79"), F.lit("CWE-80")).alias("profile_cwe"), F.lit("escape output").alias("guidance")), F.struct(F.array(F.lit("CWE-89")).alias("profile_cwe"), F.lit("bind parameters").alias("guidance")))).alias("p")).select("rule_id", "p.*")
    return supply.attach_guidance(canonical(findings), profiles).select("row_id", "guidance")


def packages(part: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    key = F.col("p_partkey")
    name = lambda c: F.concat(F.lit("p"), c.cast("string"))
    repo = (key % 2).cast("string").alias("repository")
    locked = part.where("p_partkey % 5 > 0").select(repo, name(key).alias("name"), F.col("p_size").cast("string").alias("version"), F.when(key % 4 == 0, F.array(name(key + 1), name(key + 2))).otherwise(F.array().cast("array<string>")).alias("parents"))
    return locked, part.where("p_partkey % 4 = 0").select(repo, name(key).alias("name")), part.where("p_partkey % 3 = 0").select(repo, name(key).alias("name"), F.col("p_brand").alias("licence"))


@query("SELECT cast(p_partkey % 2 AS varchar) AS repository, concat('p', cast(p_partkey AS varchar)) AS name, cast(p_size AS varchar) AS version, p_partkey % 4 = 0 AS direct, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE 'NOASSERTION' END AS licence FROM part WHERE p_partkey % 5 > 0", part="part")
def j20_sbom_components(part):
    return supply.sbom(*packages(part))[0]


@query(
    """WITH l AS (SELECT p_partkey AS k FROM part WHERE p_partkey % 5 > 0), e AS (SELECT k + 1 AS p FROM l WHERE k % 4 = 0 UNION SELECT k + 2 FROM l WHERE k % 4 = 0)
    SELECT '0' AS repository, concat('p', cast(p_partkey AS varchar)) AS name, 'direct but not locked' AS gap FROM part WHERE p_partkey % 4 = 0 AND p_partkey % 5 = 0 UNION ALL SELECT '0', concat('p', cast(p AS varchar)), 'parent not locked' FROM e WHERE p % 2 = 1 OR p NOT IN (SELECT k FROM l)""",
    part="part",
)
def j20_sbom_gaps(part):
    return supply.sbom(*packages(part))[2]


@query(
    f"""WITH {FINGERPRINTS}, b AS (SELECT * FROM canon WHERE run_year = 1997), a AS (SELECT * FROM canon WHERE run_year = 1998), t AS (SELECT repository, min(fingerprint) AS fingerprint FROM b GROUP BY 1), s AS (SELECT t.repository, count(*) AS still FROM t WHERE EXISTS (SELECT 1 FROM a WHERE a.repository = t.repository AND a.fingerprint = t.fingerprint) GROUP BY 1),
    n AS (SELECT a.repository, count(*) AS new_serious FROM a WHERE severity IN ('critical', 'high') AND NOT EXISTS (SELECT 1 FROM b WHERE b.repository = a.repository AND b.fingerprint = a.fingerprint) GROUP BY 1), h AS (SELECT concat('repo-', cast(user_id % 50 AS string)) AS repository, count(*) AS unhealthy FROM scanner_runs WHERE required AND NOT healthy GROUP BY 1)
    SELECT t.repository, coalesce(still, 0) AS still, coalesce(new_serious, 0) AS new_serious, coalesce(unhealthy, 0) AS unhealthy, coalesce(still, 0) = 0 AND coalesce(new_serious, 0) = 0 AND coalesce(unhealthy, 0) = 0 AS verified FROM t LEFT JOIN s USING (repository) LEFT JOIN n USING (repository) LEFT JOIN h USING (repository)""",
    findings="findings",
    scanners="scanner_runs",
)
def j23_verify_fix(findings, scanners):
    c = canonical(findings)
    before, after = c.where("run_year = 1997"), c.where("run_year = 1998")
    health = scanners.withColumn("repository", F.expr("concat('repo-', cast(user_id % 50 AS string))"))
    return supply.verify_fix(before, after, before.groupBy("repository").agg(F.min("fingerprint").alias("fingerprint")), health)
