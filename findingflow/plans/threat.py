"""Threat and reachability queries: J5, J6, A27, J12, J13, J14."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import threat as ops
from ._registry import query

NUMBERED = "concat('F', cast(row_number() OVER (PARTITION BY repository, run_id ORDER BY row_id, file, start_line, scanner, rule_id, original_severity, status, confidence) AS string)) AS finding_id"
ADVISED = "SELECT cast(row_id AS string) AS finding_id, run_id, cve, concat('CVE-2024-', cast(10000 + start_line % 300 AS string)) AS other FROM findings WHERE cve IS NOT NULL AND row_id % 2 = 1"


def advised(findings: DataFrame) -> DataFrame:
    f = findings.sparkSession.sql(ADVISED.replace("FROM findings", "FROM {f}"), f=findings)
    return f.withColumn("advisories", F.array("cve", "other")).distinct()


MERGED = f"""f AS (SELECT DISTINCT * FROM ({ADVISED})), r AS (SELECT advisory_id, max(cvss_score) AS cvss_score, max(epss) AS epss, bool_or(kev) AS kev, bool_or(stale) AS stale FROM threat_records GROUP BY 1), x AS (SELECT *, cve AS advisory_id FROM f UNION ALL SELECT *, other FROM f),
    s AS (SELECT finding_id, cve, other, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM x JOIN threat_records USING (advisory_id) GROUP BY 1, 2, 3),
    e AS (SELECT finding_id, run_id, cve, other, max(cvss_score) AS cvss_score, max(epss) AS epss, coalesce(bool_or(kev), false) AS kev_status, coalesce(bool_or(stale), false) AS stale FROM x LEFT JOIN r USING (advisory_id) GROUP BY 1, 2, 3, 4)"""


@query(f"WITH {MERGED} SELECT finding_id, round(cvss_score, 6) AS cvss_score, round(epss, 6) AS epss, kev_status, coalesce(sources, '') AS sources, stale FROM e LEFT JOIN s USING (finding_id, cve, other)", findings="findings", records="threat_records")
def j5_enrich(findings, records):
    return ops.enrich(advised(findings), records, kev_checked=True).withColumns({c: F.round(c, 6) for c in ("cvss_score", "epss")})


FED = """SELECT source, advisory_id, cvss_score, CASE WHEN cvss_score IS NOT NULL THEN concat('V:', source) END AS cvss_vector, CASE WHEN source = 'epss' THEN epss END AS epss, CASE WHEN source = 'epss' THEN epss / 2 END AS epss_percentile, kev, CASE WHEN kev THEN concat('2024-0', cast(1 + length(advisory_id) % 9 AS string)) END AS known_exploitation_date,
  CASE WHEN kev THEN CASE WHEN right(advisory_id, 1) = '5' THEN 'known' ELSE 'unknown' END END AS ransomware_association, CASE WHEN source = 'osv' THEN right(advisory_id, 2) END AS fixed_version, concat('20', right(advisory_id, 2)) AS published, concat('21', right(advisory_id, 2)) AS modified, CASE WHEN source <> 'osv' THEN concat('22', right(advisory_id, 2)) END AS data_source_timestamp FROM threat_records"""
ASKED = """SELECT row_id, repository, run_id, finding_id, 'cisa-kev' AS source, CASE row_id % 4 WHEN 0 THEN 'fresh-cache' WHEN 1 THEN 'refreshed' WHEN 2 THEN 'stale-cache' ELSE 'failed' END AS status, CASE WHEN row_id % 4 < 2 THEN '2250' END AS fetched_at, row_id % 4 = 2 AS stale, CASE WHEN row_id % 4 = 3 THEN 'timeout' END AS failure FROM n WHERE row_id % 5 > 0
  UNION ALL SELECT row_id, repository, run_id, finding_id, 'nvd', 'fresh-cache', '2201', false, NULL FROM n WHERE row_id % 3 = 0"""
NAMED = f"SELECT row_id, repository, run_id, {NUMBERED}, cve, concat('CVE-2024-', cast(10000 + start_line % 300 AS string)) AS other FROM findings WHERE cve IS NOT NULL"


@query(
    f"""WITH n AS ({NAMED}), r AS ({FED}), s AS ({ASKED}), x AS (SELECT *, cve AS advisory_id FROM n UNION ALL SELECT *, other FROM n WHERE other <> cve), j AS (SELECT n.*, r.* EXCLUDE (advisory_id), r.advisory_id AS hit FROM x AS n LEFT JOIN r USING (advisory_id)),
    m AS (SELECT repository, run_id, finding_id, cve, other, row_id, max(cvss_score) AS cvss_score, max(epss) AS epss_probability, bool_or(kev) AS k, string_agg(DISTINCT fixed_version, ',' ORDER BY fixed_version) AS fixed_versions, min(published) AS published_date, max(modified) AS modified_date, max(data_source_timestamp) AS stamped,
      string_agg(DISTINCT source, ',' ORDER BY source) AS record_sources, min(known_exploitation_date) FILTER (kev) AS known_exploitation_date, min(known_exploitation_date || ransomware_association) FILTER (kev) AS ransom FROM j GROUP BY ALL),
    c AS (SELECT repository, run_id, finding_id, min(source) AS cvss_source FROM j JOIN m USING (repository, run_id, finding_id) WHERE j.cvss_score = m.cvss_score GROUP BY ALL),
    a AS (SELECT repository, run_id, finding_id, bool_or(source = 'cisa-kev' AND status IN ('fresh-cache', 'refreshed')) AS checked, bool_or(stale) AS stale, max(fetched_at) AS fetched_at, string_agg(source, ',' ORDER BY source) AS sources, coalesce(string_agg(concat(source, ':', failure), ',' ORDER BY source) FILTER (failure IS NOT NULL), '') AS failures FROM s GROUP BY 1, 2, 3)
    SELECT repository, run_id, finding_id, concat_ws(',', least(cve, other), nullif(greatest(cve, other), least(cve, other))) AS advisory_ids, round(cvss_score, 6) AS cvss_score, 'V:' || cvss_source AS cvss_vector, cvss_source, round(epss_probability, 6) AS epss_probability, round(epss_probability / 2, 6) AS epss_percentile, CASE WHEN epss_probability IS NOT NULL THEN 'epss' END AS epss_source,
      CASE WHEN k THEN true WHEN checked THEN false END AS kev_status, known_exploitation_date, substr(ransom, 8) AS ransomware_association, coalesce(fixed_versions, '') AS fixed_versions, published_date, modified_date, greatest(stamped, fetched_at) AS data_source_timestamp, coalesce(stale, false) AS stale, coalesce(record_sources, '') AS record_sources, coalesce(sources, '') AS sources, coalesce(failures, '') AS failures
    FROM m LEFT JOIN c USING (repository, run_id, finding_id) LEFT JOIN a USING (repository, run_id, finding_id)""",
    findings="findings",
    records="threat_records",
)
def j5_enrich_fields(findings, records):
    sql = findings.sparkSession.sql
    n = sql(NAMED.replace("FROM findings", "FROM {f}"), f=findings)
    fed = sql(FED.replace("FROM threat_records", "FROM {r}"), r=records).withColumns({"advisory_ids": F.array("advisory_id"), "fixed_versions": F.array_compact(F.array("fixed_version"))})
    found = ops.enrich_fields(n.withColumn("advisories", F.array("cve", "other")), fed, sql(ASKED.replace("FROM n", "FROM {n}"), n=n))
    listed = {c: F.array_join(c, ",") for c in ("advisory_ids", "fixed_versions", "record_sources", "sources")}
    spelled = F.array_join(F.transform("failures", lambda x: F.concat_ws(":", x["source"], x["failure"])), ",")
    return found.withColumns({**listed, "failures": spelled, **{c: F.round(c, 6) for c in ("cvss_score", "epss_probability", "epss_percentile")}})


CACHE = "SELECT source, advisory_id AS key, cast(max(p) AS double) AS expires_at FROM (SELECT source, advisory_id, length(source) * 1000 + cast(right(advisory_id, 4) AS int) AS p FROM threat_records) AS t GROUP BY 1, 2"


@query(
    f"""WITH c AS ({CACHE}), k AS (SELECT DISTINCT v.s AS source, cve AS key, right(cve, 1) = '3' AS cvss_known FROM findings, (VALUES ('nvd'), ('osv'), ('epss')) AS v(s) WHERE cve IS NOT NULL)
    SELECT source, key, cvss_known, CASE WHEN source = 'nvd' AND cvss_known THEN 'not-applicable' WHEN expires_at IS NULL THEN 'cache-miss' WHEN 4000 >= expires_at THEN 'stale-cache' ELSE 'fresh-cache' END AS status FROM k LEFT JOIN c USING (source, key)""",
    findings="findings",
    records="threat_records",
)
def j6_cache_status(findings, records):
    cache = findings.sparkSession.sql(CACHE.replace("FROM threat_records", "FROM {r}"), r=records)
    keys = findings.where("cve is not null").select(F.explode(F.array(F.lit("nvd"), F.lit("osv"), F.lit("epss"))).alias("source"), F.col("cve").alias("key"), (F.right("cve", F.lit(1)) == "3").alias("cvss_known")).distinct()
    return ops.cache_status(keys, cache, 4000.0)


@query(
    f"""WITH {MERGED}, z AS (SELECT run_id, count(*) AS enriched, count(*) FILTER (stale AND epss > 0.9) AS stale_findings, cast(sum(CASE WHEN length(finding_id) % 4 = 0 AND right(run_id, 1) = '4' THEN 1 ELSE 0 END) AS bigint) AS failed_sources, bool_and(cvss_score IS NULL) AS un FROM e GROUP BY 1)
    SELECT run_id, enriched, stale_findings, failed_sources, CASE WHEN stale_findings > 0 THEN 'stale' WHEN failed_sources > 0 THEN 'degraded' WHEN un THEN 'unavailable' ELSE 'fresh' END AS status FROM z""",
    findings="findings",
    records="threat_records",
)
def a27_threat_data_status(findings, records):
    f = advised(findings)
    e = ops.enrich(f.withColumn("finding_id", F.concat_ws("|", "finding_id", "run_id", "cve", "other")), records, True).withColumn("p", F.split("finding_id", r"\|"))
    made = e.select(F.col("p")[0].alias("finding_id"), F.col("p")[1].alias("run_id"), (F.col("stale") & (F.col("epss") > 0.9)).alias("stale"), F.col("cvss_score").isNotNull().alias("any_usable"))
    return ops.threat_data_status(made.withColumn("failures", F.when((F.length("finding_id") % 4 == 0) & (F.right("run_id", F.lit(1)) == "4"), 1).otherwise(0)))


@query(
    """SELECT run_id, count(dep_name) AS dependency_findings_analyzed, count(*) FILTER (dep_name IS NULL AND row_id % 3 > 0) AS source_findings_analyzed, count(*) FILTER (dep_name IS NULL AND row_id % 5 = 0) AS source_paths_found,
    count(*) FILTER (dep_name IS NULL AND row_id % 3 = 0) AS unsupported_findings, count(*) FILTER (row_id % 7 = 0) AS incomplete_findings, count(*) FILTER (dep_name IS NOT NULL AND reachability = 'reachable') AS confirmed_reachable, count(*) FILTER (row_id % 11 = 0) AS dynamically_confirmed FROM findings GROUP BY 1""",
    findings="findings",
)
def a27_reachability_summary(findings):
    k, incomplete = F.col("row_id"), (F.col("row_id") % 7 == 0).alias("analysis_incomplete")
    dependency = F.when(F.col("dep_name").isNotNull(), F.struct(F.when(F.col("reachability") == "reachable", "CONFIRMED_REACHABLE").otherwise("UNKNOWN").alias("status"), incomplete))
    source = F.when(F.col("dep_name").isNull(), F.struct(F.when(k % 3 == 0, "unsupported").otherwise("full").alias("support"), F.when(k % 5 == 0, "path-found").otherwise("no-path").alias("status"), incomplete))
    dynamic = F.when(k % 2 == 1, F.struct(F.when(k % 11 == 0, "confirmed").otherwise("likely").alias("status"))).otherwise(F.when(k % 11 == 0, F.struct(F.lit("confirmed").alias("status"))))
    return ops.reachability_summary(findings.withColumns({"dependency_reachability": dependency, "source_to_sink": source, "dynamic_correlation": dynamic}))


ENDPOINTS = f"SELECT repository, run_id, {NUMBERED}, concat('https://app.example/', rule_id, '/', cast(start_line % 30 AS string), CASE WHEN row_id % 2 = 0 THEN '/?q=1' ELSE '' END) AS endpoint, concat('request.args.', symbol) AS source, concat('db.', CASE WHEN row_id % 3 = 0 THEN 'Execute' ELSE 'run' END) AS sink FROM findings WHERE category = 'dast'"
OBSERVED = "SELECT concat('repo-', cast(event_id % 50 AS string)) AS repository, concat('o', cast(event_id AS string)) AS observation_id, concat('R', cast(user_id % 20 AS string), '/', cast(event_id % 30 AS string)) AS endpoint, concat('FN', cast(event_id % 9 AS string)) AS parameter, CASE WHEN event_id % 4 = 0 THEN 'cursor.execute' ELSE 'none' END AS sink, CASE event_type WHEN 'click' THEN 'confirmed' WHEN 'view' THEN 'failed-reproduction' WHEN 'error' THEN 'inconclusive' WHEN 'signup' THEN 'blocked-authentication' ELSE 'not-attempted' END AS outcome, CASE WHEN event_id % 3 = 0 THEN 'admin' END AS authentication_state FROM scanner_runs"


@query(
    f"""WITH f AS (SELECT *, concat('/', split_part(endpoint, '/', 4), '/', split_part(endpoint, '/', 5)) AS p FROM ({ENDPOINTS})), o AS ({OBSERVED}),
    m AS (SELECT f.repository, run_id, finding_id, observation_id, outcome, coalesce(authentication_state, 'unknown') AS state, CASE outcome WHEN 'confirmed' THEN 4 WHEN 'blocked-authentication' THEN 3 WHEN 'failed-reproduction' THEN 2 WHEN 'inconclusive' THEN 1 ELSE 0 END::BIGINT AS s,
      contains(source, lower(parameter)) AS by_parameter, f.sink = 'db.Execute' AND o.sink = 'cursor.execute' AS by_sink FROM f JOIN o ON f.repository = o.repository AND f.p = concat('/', o.endpoint))
    SELECT repository, run_id, finding_id, arg_max(observation_id, s * 1000000000 - cast(substr(observation_id, 2) AS bigint)) AS observation_id, arg_max(outcome, s) AS status, arg_max(state, s * 1000000000 - cast(substr(observation_id, 2) AS bigint)) AS authentication_state,
      string_agg(DISTINCT observation_id, ',' ORDER BY observation_id) AS matched, bool_or(by_parameter) AS parameter_matched, bool_or(by_sink) AS sink_matched, coalesce(string_agg(DISTINCT observation_id, ',' ORDER BY observation_id) FILTER (outcome = 'failed-reproduction'), '') AS failed,
      CASE WHEN max(s) = 4 THEN 'increased' ELSE 'unchanged' END AS priority_adjustment FROM m WHERE by_parameter OR by_sink GROUP BY 1, 2, 3""",
    findings="findings",
    runs="scanner_runs",
)
def j12_match_observations(findings, runs):
    sql = findings.sparkSession.sql
    f = sql(ENDPOINTS.replace("FROM findings", "FROM {f}"), f=findings).select(*ops.FINDING, F.array("endpoint").alias("endpoints"), F.array("source").alias("sources"), F.array("sink").alias("sinks"))
    # ids of one length order as numbers, as the SQL does
    o = sql(OBSERVED.replace("FROM scanner_runs", "FROM {r}"), r=runs).withColumn("observation_id", F.concat(F.lit("o"), F.lpad(F.substring("observation_id", 2, 12), 12, "0")))
    short = lambda c: F.concat(F.lit("o"), F.regexp_replace(F.substring(c, 2, 12), "^0+(?=.)", ""))
    spelled = lambda c: F.array_join(F.array_sort(F.transform(c, short)), ",")
    found = ops.match_observations(f, o)
    return found.select(*ops.FINDING, short(F.col("observation_id")).alias("observation_id"), "status", "authentication_state", spelled("matched_observation_ids").alias("matched"), "parameter_matched", "sink_matched", spelled("failed_attempts").alias("failed"), "priority_adjustment")


PLACES = f"""SELECT repository, run_id, {NUMBERED}, file, start_line, start_line + CASE row_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN 10 WHEN 3 THEN 70 WHEN 4 THEN 300 ELSE 100000 END AS end_line,
  CASE row_id % 3 WHEN 0 THEN concat('request.', symbol) WHEN 1 THEN 'q' ELSE '' END AS source, CASE row_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'x' ELSE concat('db.', symbol) END AS sink FROM findings WHERE category = 'sast' AND row_id % 5 < 3"""
FLOWS = "SELECT DISTINCT repository, run_id, concat_ws('|', 'w', cast(row_id AS string), file, cast(start_line AS string)) AS flow_id, file AS sink_file, start_line AS sink_line, CASE row_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'Q' ELSE symbol END AS source_symbol, CASE WHEN row_id % 2 = 0 THEN concat('cursor.', symbol) ELSE 'x' END AS sink_symbol, confidence AS path_confidence FROM findings WHERE row_id % 7 < 3 AND category = 'sast'"


@query(
    f"""WITH f AS ({PLACES}), p AS ({FLOWS}), m AS (SELECT f.repository, f.run_id, finding_id, flow_id, path_confidence, CASE WHEN sink_line BETWEEN start_line AND coalesce(end_line, start_line) THEN 'line'
      WHEN (source <> '' OR coalesce(sink, '') <> '') AND (source = '' OR contains(source, lower(source_symbol)) OR contains(lower(source_symbol), source)) AND (coalesce(sink, '') = '' OR sink = sink_symbol OR string_split(sink, '.')[-1] = string_split(sink_symbol, '.')[-1]) THEN 'symbols' END AS how
      FROM f JOIN p ON f.repository = p.repository AND f.run_id = p.run_id AND f.file = p.sink_file),
    k AS (SELECT *, row_number() OVER (PARTITION BY repository, run_id, finding_id ORDER BY how, path_confidence DESC, flow_id) AS n FROM m WHERE how IS NOT NULL) SELECT repository, run_id, finding_id, flow_id, how FROM k WHERE n = 1""",
    findings="findings",
)
def j13_attach_flows(findings):
    sql = findings.sparkSession.sql
    return ops.attach_flows(sql(PLACES.replace("FROM findings", "FROM {f}"), f=findings), sql(FLOWS.replace("FROM findings", "FROM {f}"), f=findings))


EVIDENCE = """SELECT repository, run_id, replace(p_name, ' ', '_') AS package, p_size % 2 = 0 AS declared, CASE WHEN p_size % 4 = 0 THEN 'runtime' ELSE 'development' END AS scope, p_size % 3 = 0 AS locked, p_size % 7 < 3 AS imported, CASE WHEN p_size % 5 < 2 THEN true END AS called, p_size % 11 < 6 AS deployed, p_size % 13 < 9 AS known_symbols
  FROM part JOIN (SELECT DISTINCT repository, run_id FROM findings) AS r ON p_partkey % 7 = cast(substr(repository, 6) AS int) % 7"""
SCANS = "SELECT DISTINCT repository, run_id, CASE WHEN repository LIKE '%3' THEN 2 END AS parse_failures, repository NOT LIKE '%4' AS has_inventory FROM findings"
PACKAGES = f"SELECT row_id, repository, run_id, {NUMBERED}, replace(dep_name, ' ', '-') AS dep_name, CASE WHEN row_id % 5 = 0 THEN '1.0' END AS dep_version, CASE row_id % 6 WHEN 0 THEN true WHEN 1 THEN false END AS dep_direct, CASE WHEN row_id % 4 = 0 THEN 'runtime' WHEN row_id % 4 = 1 THEN 'unknown' END AS dependency_scope FROM findings"


@query(
    f"""WITH f AS ({PACKAGES}), s AS ({SCANS}), e AS (SELECT repository, run_id, regexp_replace(lower(package), '[-_.]+', '-', 'g') AS n, bool_or(declared) AS d, bool_or(declared AND scope = 'runtime') AS rt, bool_or(locked) AS l, bool_or(imported) AS i, coalesce(bool_or(called), false) AS c, bool_or(deployed) AS y, bool_or(known_symbols) AS k FROM ({EVIDENCE}) GROUP BY 1, 2, 3),
    j AS (SELECT f.*, coalesce(d, false) AS d, coalesce(rt, false) AS rt, coalesce(l, false) AS l, coalesce(i, false) AS i, CASE WHEN k THEN c END AS dep_called, CASE WHEN has_inventory THEN coalesce(y, false) END AS dep_deployed, coalesce(parse_failures, 0) AS bad
      FROM f JOIN s USING (repository, run_id) LEFT JOIN e ON e.repository = f.repository AND e.run_id = f.run_id AND e.n = f.dep_name),
    w AS (SELECT *, CASE WHEN dep_direct THEN 'direct' WHEN NOT dep_direct THEN 'transitive' WHEN d THEN 'direct' WHEN l THEN 'transitive' ELSE 'unknown' END AS dep_relationship, CASE WHEN coalesce(dependency_scope, 'unknown') = 'unknown' AND d THEN CASE WHEN rt THEN 'runtime' ELSE 'development' END ELSE coalesce(dependency_scope, 'unknown') END AS dep_in_scope, d OR l OR dep_version IS NOT NULL AS dep_installed FROM j),
    x AS (SELECT *, dep_relationship = 'unknown' OR dep_in_scope = 'unknown' OR dep_deployed IS NULL OR dep_called IS NULL OR bad > 0 AS dep_incomplete FROM w),
    z AS (SELECT *, CASE WHEN dep_name IS NULL THEN 'NOT_ANALYSED' WHEN NOT dep_installed THEN 'NO_PATH_FOUND' WHEN dep_called AND NOT dep_incomplete THEN 'CONFIRMED_REACHABLE' WHEN dep_incomplete THEN 'ANALYSIS_INCOMPLETE' WHEN i THEN 'LIKELY_REACHABLE' ELSE 'NO_PATH_FOUND' END AS dep_status FROM x)
    SELECT repository, run_id, finding_id, dep_status, CASE dep_status WHEN 'CONFIRMED_REACHABLE' THEN 'reachable' WHEN 'LIKELY_REACHABLE' THEN 'potentially_reachable' ELSE 'unknown' END AS dep_reachability, dep_relationship, dep_in_scope, dep_deployed, dep_called, dep_installed, dep_incomplete FROM z""",
    findings="findings",
    part="part",
)
def j14_dependency_reachability(findings, part):
    sql = findings.sparkSession.sql
    evidence = sql(EVIDENCE.replace("FROM part", "FROM {p}").replace("FROM findings", "FROM {f}"), p=part, f=findings)
    found = ops.dependency_reachability(sql(PACKAGES.replace("FROM findings", "FROM {f}"), f=findings), evidence, sql(SCANS.replace("FROM findings", "FROM {f}"), f=findings))
    return found.select(*ops.FINDING, "dep_status", "dep_reachability", "dep_relationship", "dep_in_scope", "dep_deployed", "dep_called", "dep_installed", "dep_incomplete")
