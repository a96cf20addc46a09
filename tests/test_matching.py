"""Matching of findings with labelled truth, with many truths that look alike."""

import random

import pytest
from pyspark.sql import functions as F

from findingflow.operators import benchmark

TRUTH = "repository string, truth_id string, scanner_rule string, file string, symbol string, cwe string, source string, sink string, code_region_hash string, line int"
FOUND = "repository string, finding_key string, scanner string, rule_id string, file string, symbol string, cwe string, source string, sink string, code_region_hash string, start_line int, truth_ref string"
W = benchmark.WEIGHTS


def plain_score(f, t):
    """None unless the pair qualifies."""
    low = lambda v: (v or "").strip().lower().removeprefix("./") or None
    same = lambda i, j: low(f[i]) is not None and low(f[i]) == low(t[j])
    file, symbol, cwe = same(4, 3), same(5, 4), same(6, 5)
    rule = t[2] is not None and f"{f[2]}:{f[3]}".lower() == t[2].lower()
    flow, region = file and same(7, 6) and same(8, 7), file and same(9, 8)
    ref = f[11] is not None and f[11].upper() == t[1].upper()
    if not (ref or (rule and file) or region or flow or (file and symbol and cwe)):
        return None
    near = file and None not in (f[10], t[9]) and abs(f[10] - t[9]) <= 5
    hits = {"vulnerability_id": ref, "scanner_rule": rule, "code_region_hash": region, "source_sink": flow, "symbol": file and symbol, "cwe": cwe, "file": file, "line_proximity": near}
    return sum(W[k] for k, v in hits.items() if v)


@pytest.fixture(scope="module")
def odd():
    """Truths and findings of several rows each, ids that differ in case only, and findings that name a truth."""
    rng = random.Random(7)
    any_of = lambda *values: rng.choice(values)
    truth, found = [], []
    for i in range(60):
        for _ in range(any_of(1, 1, 2)):
            truth.append((any_of("a", "b"), f"{any_of('t', 'T')}{i % 55}", any_of(None, "x:r1", "X:R2"), any_of("p.py", "./P.py", "q.py"), any_of(None, "f", "g"), any_of(None, "CWE-1", "cwe-2"), any_of(None, "in"), any_of(None, "out"), any_of(None, None, "h"), any_of(None, 10, 14, 90)))
    for i in range(120):
        for _ in range(any_of(1, 1, 2)):
            found.append((any_of("a", "b"), f"k{i}", "x", any_of("R1", "R2", "R3"), any_of("p.py", "q.py", "z.py", None), any_of(None, "F", "g"), any_of(None, "CWE-1", "CWE-2"), any_of(None, "in"), any_of(None, "OUT"), any_of(None, None, "H"), any_of(None, 12, 60), any_of(None, None, f"t{rng.randrange(70)}")))
    want = {}
    for f in found:
        for t in truth:
            if f[0] == t[0] and (s := plain_score(f, t)) is not None:
                want[f[0], f[1], t[1]] = max(s, want.get((f[0], f[1], t[1]), 0))
    return truth, found, want


def test_candidates_equal_all_pairs(spark, odd):
    truth, found, want = odd
    t, f = spark.createDataFrame(truth, TRUTH), spark.createDataFrame(found, FOUND)
    got = benchmark.match_candidates(f, t, ("repository",)).collect()
    assert len(got) == len(want) and {(r.repository, r.finding_key, r.truth_id): r.score for r in got} == want


def test_decisions_from_counts_equal_those_from_pairs(spark, odd):
    truth, found, want = odd
    t, f = spark.createDataFrame(truth, TRUTH), spark.createDataFrame(found, FOUND)
    plain = {}
    for (_, key, truth_id), score in want.items():
        plain.setdefault(key, []).append((-score, truth_id))
    for key, pairs in plain.items():
        best, first = min(pairs)
        close = sum(score - best < benchmark.CLOSE for score, _ in pairs)
        plain[key] = ("ambiguous", None) if close > 1 else ("matched", first)
    for candidates in (benchmark.counted_candidates(f, t, ("repository",)), benchmark.match_candidates(f, t, ("repository",))):
        assert {r.finding_key: (r.status, r.truth_id) for r in benchmark.match_decisions(candidates).collect()} == plain
    assert {"ambiguous", "matched"} == {s for s, _ in plain.values()}


def test_truths_that_look_alike_are_met_once(spark):
    """3000 findings and 3000 truths of one file, symbol and weakness: nine million pairs, 3000 counted rows."""
    none = F.lit(None).cast("string")
    rest = {c: none for c in ("source", "sink", "code_region_hash")}
    f = spark.range(3000).selectExpr("concat('k', id) AS finding_key", "'x' AS scanner", "'y' AS rule_id", "'a.py' AS file", "'f' AS symbol", "'CWE-79' AS cwe", "cast(id AS int) AS start_line").withColumns({**rest, "truth_ref": none})
    t = spark.range(3000).selectExpr("concat('T', id) AS truth_id", "'z:z' AS scanner_rule", "'a.py' AS file", "'f' AS symbol", "'CWE-79' AS cwe", "9 AS line").withColumns(rest)
    counted = benchmark.counted_candidates(f, t)
    assert [(r.n, r["count"]) for r in counted.groupBy("n").count().collect()] == [(3000, 3000)]
    assert {r.status for r in benchmark.match_decisions(counted).collect()} == {"ambiguous"}
    assert benchmark.match_candidates(f.limit(100), t).count() == 300_000
