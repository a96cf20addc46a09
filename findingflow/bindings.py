"""The driver's tables as canonical tables, in SQL that Spark and DuckDB read alike.

``{name}`` stands for a source table or another binding. Spark gets DataFrames for them; the checking SQL gets
common table expressions of the same text.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

SOURCES = "region nation customer supplier part orders lineitem events documents labels conversations".split()
DAY = "cast((year({0}) * 372 + month({0}) * 31 + day({0})) * 86400.0 as double)"

BINDINGS = {
    "findings": f"""
        SELECT l_orderkey * 10 + l_linenumber AS row_id,
          concat('repo-', cast(o_custkey % 50 as string)) AS repository,
          concat('run-', cast(o_custkey % 50 as string), '-', cast(year(o_orderdate) as string)) AS run_id,
          cast(year(o_orderdate) as int) AS run_year,
          CASE l_suppkey % 7 WHEN 0 THEN 'bandit' WHEN 1 THEN 'semgrep' WHEN 2 THEN 'trivy' WHEN 3 THEN 'gosec' WHEN 4 THEN 'checkov' WHEN 5 THEN 'zap' ELSE 'pip-audit' END AS scanner,
          concat('R', cast(l_partkey % 20 as string)) AS rule_id,
          CASE WHEN l_returnflag = 'R' THEN 'sca' WHEN l_suppkey % 7 = 4 THEN 'iac' WHEN l_suppkey % 7 = 5 THEN 'dast' ELSE 'sast' END AS category,
          concat('src/', replace(lower(p_type), ' ', '_'), '/', cast(p_size % 5 as string), '.py') AS file,
          cast(floor(l_quantity * 10) as int) AS start_line,
          concat('fn', cast(l_linenumber as string)) AS symbol,
          CASE l_partkey % 4 WHEN 0 THEN 'CWE-79' WHEN 1 THEN 'CWE-89' WHEN 2 THEN 'CWE-22' END AS cwe,
          CASE WHEN l_returnflag = 'R' THEN concat('CVE-2024-', cast(10000 + l_partkey as string)) END AS cve,
          CASE WHEN l_returnflag = 'R' THEN p_name END AS dep_name,
          CASE cast(round(l_discount * 100) as int) % 6 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'LOW' WHEN 3 THEN 'CRITICAL' WHEN 4 THEN 'ERROR' ELSE '' END AS original_severity,
          CASE cast(round(l_discount * 100) as int) % 6 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' WHEN 3 THEN 'critical' WHEN 4 THEN 'info' ELSE 'unknown' END AS severity,
          CASE WHEN l_linestatus = 'O' THEN 'reachable' ELSE 'unknown' END AS reachability,
          CASE WHEN l_tax >= 0.065 THEN 'suppressed' WHEN l_tax >= 0.045 THEN 'resolved' ELSE 'open' END AS status,
          CASE WHEN l_suppkey % 5 > 0 THEN concat('team-', cast(l_suppkey % 5 as string)) END AS owner,
          cast(l_quantity as double) / 50.0 AS confidence,
          {DAY.format("o_orderdate")} AS opened_at,
          CASE WHEN l_tax >= 0.045 THEN {DAY.format("l_shipdate")} END AS resolved_at
        FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey JOIN {{part}} ON l_partkey = p_partkey""",
    "scanner_runs": """
        SELECT event_id, concat('run-', cast(user_id % 97 as string)) AS run_id, user_id,
          CASE user_id % 7 WHEN 0 THEN 'bandit' WHEN 1 THEN 'semgrep' WHEN 2 THEN 'trivy' WHEN 3 THEN 'gosec' WHEN 4 THEN 'checkov' WHEN 5 THEN 'zap' ELSE 'pip-audit' END AS scanner,
          event_type, event_id % 9 <> 0 AS success, CASE WHEN event_id % 11 <> 0 THEN value END AS duration_seconds,
          CASE event_id % 5 WHEN 0 THEN 'FAILED_SCANNER' WHEN 1 THEN 'PARTIAL' WHEN 2 THEN 'FINDINGS' WHEN 3 THEN 'CLEAN' ELSE 'SKIPPED' END AS state,
          event_id % 5 NOT IN (0, 1) AS healthy, event_id % 3 = 0 AS required,
          concat('v', cast(event_id % 4 as string)) AS version, ts
        FROM {events}""",
    "reviews": """
        SELECT concat('case-', cast(doc_id as string)) AS case_id, cast(quality as int) AS first_label, cast(1 - toxic as int) AS second_label FROM {labels}""",
    "truth": """
        SELECT concat('T', cast(p_partkey as string)) AS truth_id, concat('src/', replace(lower(p_type), ' ', '_'), '/', cast(p_size % 5 as string), '.py') AS file,
          concat('R', cast(p_partkey % 20 as string)) AS rule_id, CASE p_partkey % 4 WHEN 0 THEN 'CWE-79' WHEN 1 THEN 'CWE-89' WHEN 2 THEN 'CWE-22' END AS cwe,
          concat('fn', cast(1 + p_partkey % 7 as string)) AS symbol
        FROM {part} WHERE p_partkey % 20 = 0""",
    "threat_records": """
        SELECT concat('CVE-2024-', cast(10000 + p_partkey as string)) AS advisory_id, CASE p_partkey % 3 WHEN 0 THEN 'osv' WHEN 1 THEN 'nvd' ELSE 'cisa-kev' END AS source,
          round(p_retailprice / 250.0, 1) AS cvss_score, cast(p_size as double) / 100.0 AS epss, p_partkey % 3 = 2 AS kev, p_size % 4 = 0 AS stale FROM {part}
        UNION ALL
        SELECT concat('CVE-2024-', cast(10000 + p_partkey as string)), 'epss', NULL, cast(p_partkey % 101 as double) / 100.0, false, p_partkey % 5 = 0 FROM {part} WHERE p_partkey % 2 = 0""",
    "suppressions": """
        SELECT concat('S', cast(o_orderkey as string)) AS suppression_id, concat('repo-', cast(o_custkey % 50 as string)) AS repository, concat('R', cast(o_orderkey % 20 as string)) AS rule_id,
          concat('src/*/', cast(o_orderkey % 5 as string), '.py') AS path_glob, cast(1 + year(o_orderdate) as int) AS expires_year, cast(year(o_orderdate) as int) AS created_year,
          CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice END AS expires_at, o_orderpriority AS reason
        FROM {orders} WHERE o_orderkey % 10 = 0""",
    "history": """
        SELECT concat('repo-', cast(user_id % 7 as string)) AS repository, concat('F', cast(cast(floor(user_id / 7) as bigint) as string)) AS fingerprint, cast(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) as int) AS sequence,
          CASE event_type WHEN 'click' THEN 'open' WHEN 'view' THEN 'acknowledged' WHEN 'purchase' THEN 'resolved' WHEN 'signup' THEN 'suppressed' ELSE 'false_positive' END AS to_state,
          ts AS changed_at, CASE WHEN event_id % 3 = 0 THEN value END AS expires_at, event_id % 4 = 0 AS approved
        FROM {events}""",
}


def needs(name: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", BINDINGS[name])))


def bind(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A source table or a canonical table as a DataFrame."""
    if name not in BINDINGS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(BINDINGS[name], **{n: bind(spark, sf_dir, n) for n in needs(name)})


def with_bindings(sql: str) -> str:
    """``sql`` preceded by a common table expression for every binding it names."""
    wanted: list[str] = []

    def want(name: str) -> None:
        for n in needs(name):
            if n in BINDINGS:
                want(n)
        if name not in wanted:
            wanted.append(name)

    for name in BINDINGS:
        if re.search(rf"\b{name}\b", sql):
            want(name)
    parts = [f"{n} AS ({re.sub(r'{(\w+)}', lambda m: m[1], BINDINGS[n])})" for n in wanted]
    head, rest = re.match(r"(WITH RECURSIVE |WITH |)(.*)", sql.strip(), re.S).groups()
    return (head or "WITH ") + ",\n".join(parts) + ("," if head else "") + "\n" + rest if parts else sql
