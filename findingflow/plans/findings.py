"""Normalisation, identity, deduplication and correlation queries: P1 to P8, P11, P12, A1, A2, J1, J2, J11, A3."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import identity, severity
from ..operators import correlate
from ..session import durable
from ._registry import query


def values_sql() -> str:
    return ", ".join(f"('{s}', '{name}', '{sev}')" for s, name, sev in severity.label_pairs())


@query(
    f"""WITH m(s, l, v) AS (VALUES {values_sql()})
    SELECT row_id, CASE WHEN original_severity = '' THEN 'unknown' ELSE coalesce(v, 'unknown') END AS severity, CASE WHEN coalesce(v, 'unknown') = 'unknown' THEN 'low' ELSE 'high' END AS quality,
      CASE WHEN original_severity = '' THEN concat(scanner, ':missing->unknown') WHEN v IS NULL THEN concat(scanner, ':', original_severity, '->unknown-unrecognized') ELSE concat(scanner, ':', original_severity, '->', v) END AS rule
    FROM findings LEFT JOIN m ON s = scanner AND l = original_severity""",
    findings="findings",
)
def p1_scanner_severity(findings):
    return findings.select("row_id", severity.scanner_severity(F.col("scanner"), F.col("original_severity")).alias("s")).select("row_id", "s.severity", "s.quality", "s.rule")


@query(
    """SELECT advisory_id, source, CASE WHEN cvss_score = 0 THEN 'info' WHEN cvss_score < 4 THEN 'low' WHEN cvss_score < 7 THEN 'medium' WHEN cvss_score < 9 THEN 'high' WHEN cvss_score >= 9 THEN 'critical' END AS severity FROM threat_records""",
    records="threat_records",
)
def p2_cvss_severity(records):
    return records.select("advisory_id", "source", severity.cvss_severity(F.col("cvss_score")).alias("severity"))


@query(
    """WITH s AS (SELECT p_size AS k, CASE p_partkey % 3 WHEN 0 THEN 'nvd' WHEN 1 THEN 'ghsa' ELSE 'redhat' END AS source, cast(2 + p_partkey % 3 AS int) AS version, cast(p_partkey % 101 AS double) / 10.0 AS score FROM part),
    n AS (SELECT s.* FROM s JOIN (SELECT k, source, max(version) AS v FROM s GROUP BY 1, 2) AS m ON s.k = m.k AND s.source = m.source AND s.version = m.v),
    r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, version DESC, source DESC) AS p FROM n)
    SELECT k, round(score, 6) AS score, version, source FROM r WHERE p = 1""",
    part="part",
)
def p3_best_cvss(part):
    rows = part.selectExpr("p_size AS k", "CASE p_partkey % 3 WHEN 0 THEN 'nvd' WHEN 1 THEN 'ghsa' ELSE 'redhat' END AS source", "cast(2 + p_partkey % 3 AS int) AS version", "cast(p_partkey % 101 AS double) / 10.0D AS score")
    held = rows.groupBy("k").agg(F.collect_set(F.struct("source", "version", "score")).alias("scores"))
    return held.select("k", severity.best_cvss(F.col("scores")).alias("b")).select("k", F.round("b.score", 6).alias("score"), "b.version", "b.source")


@query(
    """WITH s AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'aws-access-key' WHEN 1 THEN 'generic-api-key' WHEN 2 THEN 'private-key' WHEN 3 THEN 'jwt' END AS rule, CASE WHEN event_id % 7 = 0 THEN 'LOW' END AS label, CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS verified FROM scanner_runs),
    b AS (SELECT *, CASE WHEN rule IN ('aws-access-key', 'private-key') THEN 'high' WHEN rule = 'generic-api-key' THEN 'medium' ELSE 'unknown' END AS base FROM s)
    SELECT event_id, CASE WHEN label IS NOT NULL THEN 'low' WHEN verified THEN CASE WHEN base = 'unknown' THEN 'medium' ELSE base END
      WHEN NOT verified THEN CASE base WHEN 'high' THEN 'medium' WHEN 'medium' THEN 'low' ELSE 'unknown' END WHEN base = 'high' THEN 'medium' ELSE base END AS severity FROM b""",
    runs="scanner_runs",
)
def p4_secret_severity(runs):
    rows = runs.selectExpr("event_id", "CASE event_id % 5 WHEN 0 THEN 'aws-access-key' WHEN 1 THEN 'generic-api-key' WHEN 2 THEN 'private-key' WHEN 3 THEN 'jwt' END AS rule", "CASE WHEN event_id % 7 = 0 THEN 'LOW' END AS label", "CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS verified")
    return rows.select("event_id", severity.secret_severity(F.col("rule"), F.col("label"), F.col("verified")).alias("severity"))


@query(
    """SELECT p_partkey, concat('CVE-2024-', cast(p_partkey AS string)) AS cve, CASE WHEN p_size % 2 = 0 THEN concat('GHSA-', lower(p_brand)) ELSE '' END AS ghsa, concat('PYSEC-', cast(p_size AS string)) AS osv FROM part""",
    part="part",
)
def p5_split_identifiers(part):
    given = F.array(F.concat(F.lit("CVE-2024-"), F.col("p_partkey")), F.concat(F.lit(" PYSEC-"), F.col("p_size")), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("GHSA-"), F.lower("p_brand"))).otherwise(" "), F.concat(F.lit("CVE-2024-"), F.col("p_partkey")))
    s = part.select("p_partkey", identity.split_identifiers(given).alias("s"))
    return s.select("p_partkey", *[F.array_join(f"s.{c}", ",").alias(c) for c in ("cve", "ghsa", "osv")])


@query(
    """SELECT row_id, coalesce(array_to_string(list_sort(list_distinct(regexp_extract_all(concat('see ', coalesce(cwe, 'none'), ' and CWE-', cast(start_line % 3 AS string)), 'CWE-\\d+'))), ','), '') AS cwe FROM findings""",
    findings="findings",
)
def p6_cwe_list(findings):
    text = F.concat(F.lit("see "), F.coalesce("cwe", F.lit("none")), F.lit(" and cwe_"), (F.col("start_line") % 3).cast("string"))
    return findings.select("row_id", F.array_join(identity.cwe_list(text), ",").alias("cwe"))


@query("SELECT row_id, file AS path FROM findings", findings="findings")
def p7_repository_path(findings):
    """The bound path, wrapped in what normalisation removes: drive letters, backslashes, dots and parent steps."""
    odd = F.concat(F.lit(".\\x\\..\\"), F.replace("file", F.lit("/"), F.lit("//./")))
    return findings.select("row_id", identity.repository_path(odd).alias("path"))



def canonical(findings: DataFrame) -> DataFrame:
    """Bound findings in the canonical columns: arrays of identifiers, fingerprint and id."""
    none = F.lit(None).cast("string")
    lists = findings.withColumns({c: F.array_compact(F.array(c)) for c in ("cwe", "cve")})
    full = lists.withColumns({"ghsa": F.array().cast("array<string>"), "osv": F.array().cast("array<string>"), "source": none, "sink": none, "dep_ecosystem": F.when(F.col("dep_name").isNotNull(), "PIP")})
    args = [F.col(c) for c in ("category", "rule_id", "file", "symbol", "source", "sink", "cwe", "cve", "ghsa", "osv", "dep_name", "dep_ecosystem")]
    printed = full.withColumn("fingerprint", identity.fingerprint(*args))
    return printed.withColumn("finding_id", identity.finding_id(F.col("scanner"), F.col("rule_id"), F.col("fingerprint")))


FINGERPRINTS = """canon AS (SELECT *, concat('v2:sha256:', sha256(concat('{"algorithm":"v2","identity":', CASE WHEN dep_name IS NOT NULL
      THEN concat('{"advisory_identifiers":["', cve, '"],"category":"sca","component":{"ecosystem":"pypi","name":"', regexp_replace(lower(dep_name), '[-_.]+', '-', 'g'), '"},"kind":"dependency"}')
      ELSE concat('{"cwe":[', CASE WHEN cwe IS NULL THEN '' ELSE concat('"', cwe, '"') END, '],"file":"', file, '","kind":"', category, '","rule_id":"', lower(rule_id), '","sink":"","source":"","symbol":"', symbol, '"}') END, '}'))) AS fingerprint FROM findings)"""


@query(
    f"""WITH {FINGERPRINTS} SELECT row_id, fingerprint, concat('finding-v2-', left(sha256(concat('{{"algorithm":"v2","fingerprint":"', fingerprint, '","rule_id":"', lower(rule_id), '","scanner":"', scanner, '"}}')), 24)) AS finding_id FROM canon""",
    findings="findings",
)
def p8_fingerprint(findings):
    return canonical(findings).select("row_id", "fingerprint", "finding_id")


@query(
    """WITH l AS (SELECT doc_id, unnest(string_split_regex(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))) AS line, generate_subscripts(string_split_regex(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), 1) AS i FROM documents),
    t AS (SELECT doc_id, i, trim(regexp_replace(line, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ') AS line FROM l)
    SELECT d.doc_id, CASE WHEN count(line) > 0 THEN sha256(string_agg(line, chr(10) ORDER BY i)) END AS region FROM documents AS d LEFT JOIN (SELECT * FROM t WHERE line <> '' AND line NOT LIKE '#%' AND line NOT LIKE '//%') AS t USING (doc_id) GROUP BY 1""",
    documents="documents",
)
def p11_region_hash(documents):
    return documents.select("doc_id", identity.region_hash(F.col("text")).alias("region"))


@query("SELECT row_id, left(sha256(concat_ws('|', scanner, rule_id, file, coalesce(cwe, ''))), 16) AS key FROM findings", findings="findings")
def p12_short_key(findings):
    return findings.select("row_id", identity.short_key(*[F.col(c) for c in ("scanner", "rule_id", "file", "cwe")]).alias("key"))


def sightings(findings: DataFrame) -> DataFrame:
    """Canonical findings with sightings, and far fewer lines and symbols, so that runs hold repeats."""
    some = findings.withColumns({"start_line": (F.col("start_line") % 40).cast("int"), "symbol": F.concat(F.lit("fn"), (F.col("start_line") % 2).cast("string"))})
    return canonical(some).withColumns({"first_seen": F.col("opened_at"), "last_seen": F.coalesce("resolved_at", "opened_at"), "occurrence_count": (F.col("row_id") % 3).cast("int"), "end_line": F.lit(None).cast("int")})


SIGHTINGS = FINGERPRINTS.replace("symbol, '\"}')", "sym, '\"}')").replace("FROM findings)", "FROM (SELECT *, cast(start_line % 40 AS int) AS line, concat('fn', cast(start_line % 2 AS string)) AS sym FROM findings))")
ISSUES = f"""{SIGHTINGS}, issues AS (SELECT repository, run_id, scanner, fingerprint AS identity, cast(sum(greatest(1, row_id % 3)) AS bigint) AS occurrence_count,
      count(DISTINCT concat(file, '|', line, '|', sym)) AS n_locations, min(opened_at) AS first_seen, max(coalesce(resolved_at, opened_at)) AS last_seen, arg_min(severity, -{{rank}}) AS severity
      FROM canon GROUP BY 1, 2, 3, 4)""".replace("{rank}", "CASE severity WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'low' THEN 2 WHEN 'info' THEN 1 ELSE 0 END")


@query(f"WITH {ISSUES} SELECT * FROM issues", findings="findings")
def a1_deduplicate(findings):
    out = correlate.deduplicate(sightings(findings))
    return out.select("repository", "run_id", "scanner", "identity", "occurrence_count", F.size("locations").cast("bigint").alias("n_locations"), "first_seen", "last_seen", "severity")


def issues(findings: DataFrame) -> DataFrame:
    """Deduplicated issues with what correlation compares."""
    keep = ("category", "end_line", "cwe", "cve", "symbol", "source", "sink", "dep_name", "dep_ecosystem", "rule_id", "finding_id", "fingerprint")
    none = F.lit(None).cast("string")
    made = correlate.deduplicate(sightings(findings), keep=keep)
    return made.withColumns({"issue_id": F.concat_ws("|", "scanner", "identity"), "code_region_hash": none, "infrastructure_resource": none, "secret_fingerprint": none})


RANKED = "CASE severity WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'low' THEN 2 WHEN 'info' THEN 1 ELSE 0 END"
PAIRS = f"""{SIGHTINGS}, r AS (SELECT *, row_number() OVER (PARTITION BY repository, run_id, scanner, fingerprint ORDER BY {RANKED} DESC, file, line) AS p FROM canon),
    i AS (SELECT *, concat(scanner, '|', fingerprint) AS issue_id FROM r WHERE p = 1),
    j AS (SELECT a.repository, a.run_id, a.issue_id AS a_id, b.issue_id AS b_id, a.file = b.file AS f, coalesce(a.cwe = b.cwe, false) AS w, a.sym = b.sym AS y, abs(a.line - b.line) <= 5 AS g, coalesce(a.dep_name = b.dep_name, false) AS d, coalesce(a.cve = b.cve, false) AS v
      FROM i AS a JOIN i AS b ON a.repository = b.repository AND a.run_id = b.run_id AND a.issue_id < b.issue_id AND a.scanner <> b.scanner AND (a.file = b.file OR a.cve = b.cve)),
    pairs AS (SELECT repository, run_id, a_id, b_id, concat_ws(',', CASE WHEN f AND g THEN 'code_region' END, CASE WHEN v THEN 'cve' END, CASE WHEN w THEN 'cwe' END, CASE WHEN d THEN 'dependency' END, CASE WHEN f THEN 'file' END, CASE WHEN y THEN 'symbol' END) AS signals
      FROM j WHERE (d AND v) OR (f AND (w OR y) AND 1 + CASE WHEN w THEN 2 ELSE 0 END + CASE WHEN y THEN 2 ELSE 0 END + CASE WHEN g THEN 2 ELSE 0 END >= 5))"""


@query(f"WITH {PAIRS} SELECT * FROM pairs", findings="findings")
def j1_candidate_pairs(findings):
    return correlate.candidate_pairs(issues(findings))


@query(f"WITH {PAIRS} SELECT repository, count(*) AS pairs, count(*) FILTER (signals LIKE 'code_region%') AS near FROM pairs GROUP BY 1", findings="findings")
def j2_region_relation(findings):
    pairs = correlate.candidate_pairs(issues(findings))
    return pairs.groupBy("repository").agg(F.count("*").alias("pairs"), F.count_if(F.startswith("signals", F.lit("code_region"))).alias("near"))


def members(findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    found = durable(issues(findings))
    pairs = durable(correlate.candidate_pairs(found))
    return found.join(correlate.clusters(found, pairs), ["repository", "run_id", "issue_id"]), pairs


@query(findings="findings")
def a3_clusters(findings):
    return members(findings)[0].select("repository", "run_id", "issue_id", "cluster_id")


def ancestry(findings: DataFrame) -> DataFrame:
    return findings.where("rule_id in ('R1', 'R2', 'R3')").select(F.concat_ws(":", "scanner", "rule_id").alias("rule_key"), F.concat(F.lit("upstream-"), "rule_id").alias("ancestry")).distinct()


@query(findings="findings")
def a2_merge_clusters(findings):
    clustered, pairs = members(findings)
    own = correlate.independent_sources(clustered, ancestry(findings))
    against = own.where("start_line % 7 = 0").select(*correlate.RUN, F.col("fingerprint").alias("finding_identity"), F.lit("reviewer").alias("contradicting_scanner")).distinct()
    return correlate.merge_clusters(own, pairs, correlate.attach_contradictions(own, against))


@query(
    f"""WITH {ISSUES}, x AS (SELECT DISTINCT repository, run_id, identity FROM issues WHERE scanner = 'bandit' AND occurrence_count > 1)
    SELECT DISTINCT repository, run_id, concat(scanner, '|', identity) AS cluster_id, 'reviewer' AS scanner FROM issues JOIN x USING (repository, run_id, identity)""",
    findings="findings",
)
def j11_contradictions(findings):
    found = issues(findings).withColumn("cluster_id", F.col("issue_id"))
    against = found.where("scanner = 'bandit' and occurrence_count > 1").select(*correlate.RUN, F.col("fingerprint").alias("finding_identity"), F.lit("reviewer").alias("contradicting_scanner")).distinct()
    return correlate.attach_contradictions(found, against)
