"""How many rows operators make where many rows of one key look alike: never those of all pairs."""

from pyspark.sql import functions as F

from findingflow.operators import correlate, lifecycle, threat


def most_rows(df):
    """The most rows that a single step of ``df`` puts out."""
    df.collect()
    todo, most = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        step = todo.pop()
        rows, name = step.metrics().get("numOutputRows"), step.getClass().getSimpleName()
        most = max(most, rows.get().value()) if rows.isDefined() else most
        if name == "AdaptiveSparkPlanExec":
            todo.append(step.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(step.plan())
        else:
            todo += [step.children().apply(i) for i in range(step.children().size())]
    return most


def test_suppressions_are_tried_by_kind(spark):
    empty = F.array().cast("array<string>")
    f = spark.range(3000).selectExpr("id AS row_id", "'r' AS repository", "'F' AS fingerprint", "concat('src/', id % 3, '.py') AS file", "cast(null AS string) AS ref", "if(id % 2 = 0, 'production', null) AS environment", "'c' AS context", "'mine' AS reason")
    s = spark.range(1000).selectExpr("id AS suppression_id", "'r' AS repository", "'F' AS fingerprint", "array(concat('*/', id % 5, '.p?')) AS paths", "'c' AS recorded_context", "cast(id AS double) AS created_at", "if(id % 4 = 0, null, id + 500.0D) AS expires_at").withColumns({"branches": empty, "environments": F.when(F.col("suppression_id") % 2 == 0, F.array(F.lit("production"))).otherwise(empty)})
    want = {}
    for i in range(3000):
        for j in range(1000):
            why = "path" if j % 5 != i % 3 else "environment" if j % 2 == 0 and i % 2 else "not_created" if j > 700 else "expired" if j % 4 and j + 500 <= 700 else None
            want[why] = want.get(why, 0) + 1
    matches, rejects = lifecycle.match_suppressions(f, s, 700.0)
    assert matches.columns == ["repository", "fingerprint", *[c for c in f.columns if c not in ("repository", "fingerprint", "reason")], *[c for c in s.columns if c not in ("repository", "fingerprint")]]
    assert matches.count() == want.pop(None) and {r.reason: r["count"] for r in rejects.groupBy("reason").count().collect()} == want
    assert rejects.columns == [*matches.columns, "reason"]
    none = lifecycle.match_suppressions(f, s.withColumn("created_at", F.lit(701.0)), 700.0)[0]
    assert most_rows(none) < 100_000


def test_flows_of_one_line_meet_findings_once(spark):
    f = spark.range(2000).selectExpr("'r' AS repository", "'1' AS run_id", "concat('f', id) AS finding_id", "'a.py' AS file", "cast(id % 50 AS int) AS start_line", "cast(9000 AS int) AS end_line", "'in' AS source", "if(id % 2 = 0, 'db.run', '') AS sink")
    p = spark.range(2000).selectExpr("'r' AS repository", "'1' AS run_id", "concat('w', id) AS flow_id", "'a.py' AS sink_file", "cast(100 AS int) AS sink_line", "'input' AS source_symbol", "'x.run' AS sink_symbol", "cast(id % 7 AS double) AS path_confidence")
    best = min(f"w{i}" for i in range(2000) if i % 7 == 6)
    found = threat.attach_flows(f, p)
    assert {(r.flow_id, r.how) for r in found.collect()} == {(best, "line")} and found.count() == 2000 and most_rows(found) < 100_000
    beyond = threat.attach_flows(f, p.withColumn("sink_line", F.lit(None).cast("int")))
    assert {(r.flow_id, r.how) for r in beyond.collect()} == {(best, "symbols")} and most_rows(beyond) < 100_000


def test_observations_meet_findings_that_look_alike_once(spark):
    f = spark.range(2000).selectExpr("'r' AS repository", "'1' AS run_id", "concat('f', id) AS finding_id", "array('https://h/a') AS endpoints", "array('request.args.name') AS sources", "array('db.Execute') AS sinks")
    o = spark.range(300).selectExpr("'r' AS repository", "concat('o', id) AS observation_id", "'/a/' AS endpoint", "if(id % 2 = 0, 'NAME', '') AS parameter", "if(id % 3 = 0, 'cursor.execute', '') AS sink", "if(id = 7, 'confirmed', 'failed-reproduction') AS outcome", "cast(null AS string) AS authentication_state")
    found = threat.match_observations(f, o).select("finding_id", "status", "observation_id", F.size("matched_observation_ids").alias("n"))
    assert {tuple(r)[1:] for r in found.collect()} == {("failed-reproduction", "o0", 200)} and found.count() == 2000 and most_rows(found) < 10_000


def test_a_pair_of_issues_meets_once_and_is_not_made_distinct(spark):
    """Two scanners with 150 issues each that share weakness, symbol, source, sink and lines: 22,500 pairs, no more rows on the way."""
    none = F.lit(None).cast("string")
    rest = {c: none for c in ("code_region_hash", "dep_name", "dep_ecosystem", "infrastructure_resource", "secret_fingerprint")}
    issues = spark.range(300).selectExpr("'r' AS repository", "'1' AS run_id", "if(id % 2 = 0, 'a', 'b') AS scanner", "concat(if(id % 2 = 0, 'a|', 'b|'), id) AS issue_id", "'a.py' AS file", "1 AS start_line", "cast(null AS int) AS end_line", "array('CWE-1', 'CWE-2') AS cwe", "cast(array() AS array<string>) AS cve", "'f' AS symbol", "'in' AS source", "'out' AS sink").withColumns(rest)
    counted = correlate.candidate_pairs(issues).groupBy("signals").count()
    assert [r["count"] for r in counted.collect()] == [22_500] and most_rows(counted) <= 22_500
