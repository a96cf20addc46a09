"""Runtime observations, flow paths and dependency evidence against literal cases and plain versions."""

import random
from urllib.parse import urlsplit

import pytest
from pyspark.sql import functions as F

from findingflow.operators import threat

KEYS = "repository string, run_id string, finding_id string"
FOUND = f"{KEYS}, endpoints array<string>, sources array<string>, sinks array<string>"
SEEN = "repository string, observation_id string, endpoint string, parameter string, sink string, outcome string, authentication_state string"


def test_endpoints_are_paths(spark):
    given = ["https://h.example/a/b/?q=1#f", "/a/", "a/b", "http://h", "", "/", "?q", "//h/x", "/Case/Kept", "http://h/?q=/z"]

    def plain(value):
        path = urlsplit(value).path or value
        return "/" + path.strip("/")

    got = spark.createDataFrame([(v,) for v in given], "v string").select(threat.normal_endpoint(F.col("v"))).collect()
    assert [r[0] for r in got] == [plain(v) for v in given]


def match(spark, findings, observations):
    return {(r.repository, r.finding_id): r for r in threat.match_observations(spark.createDataFrame(findings, FOUND), spark.createDataFrame(observations, SEEN)).collect()}


def test_strongest_outcome_with_all_matched_attempts(spark):
    finding = ("a", "1", "f", ["/login", "/x"], ["request.args['User_ID']", None], ["db.cursor.execute"])
    seen = [
        ("a", "o1", "https://h/login/", "user_id", None, "failed-reproduction", ""), ("a", "o2", "/login?x", "other", "conn.EXECUTE", "inconclusive", "admin"), ("a", "o3", "/x", "id", None, "blocked-authentication", "anonymous"),
        ("a", "o4", "/login", "", "", "confirmed", None), ("a", "o5", "/elsewhere", "user_id", None, "confirmed", None), ("a", "o6", "/login", "user_idx", None, "confirmed", None), ("a", "o7", "/login", "user_id", None, "likely", None),
        ("b", "o8", "/login", "user_id", None, "confirmed", None),
    ]
    r = match(spark, [finding], seen)["a", "f"]
    assert (r.status, r.observation_id, r.authentication_state, r.priority_adjustment) == ("blocked-authentication", "o3", "anonymous", "unchanged")
    assert r.matched_observation_ids == ["o1", "o2", "o3"] and r.failed_attempts == ["o1"] and r.parameter_matched and r.sink_matched
    confirmed = match(spark, [finding], [*seen, ("a", "o9", "/login", "args", "", "confirmed", "user")])["a", "f"]
    assert (confirmed.status, confirmed.priority_adjustment, confirmed.authentication_state) == ("confirmed", "increased", "user")


def test_one_id_in_two_repositories_and_short_parameters(spark):
    findings = [(repository, run, "f", ["/p"], [source], []) for repository, run, source in (("a", "1", "xyz"), ("b", "1", "q"), ("a", "2", "yz"), ("c", "1", ""))]
    seen = [("a", "o1", "/p", "x", "", "confirmed", None), ("b", "o2", "/p", "q", None, "not-attempted", None), ("c", "o3", "/p", "q", None, "confirmed", None), ("a", "o4", "/p", "yz", "", "inconclusive", None)]
    got = threat.match_observations(spark.createDataFrame(findings, FOUND), spark.createDataFrame(seen, SEEN)).collect()
    assert sorted((r.repository, r.run_id, r.status, ",".join(r.matched_observation_ids)) for r in got) == [("a", "1", "confirmed", "o1,o4"), ("a", "2", "inconclusive", "o4"), ("b", "1", "not-attempted", "o2")]


def test_contained_texts_share_a_key(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(300):
        text = "".join(rng.choices("abAB.é", k=rng.randint(0, 12)))
        a, b = sorted((rng.randint(0, len(text)), rng.randint(0, len(text))))
        rows.append((text, text[a:b]))
    df = spark.createDataFrame(rows, "text string, part string")
    assert df.where(F.array_contains(threat.containing_keys(F.col("text")), threat.contained_key(F.col("part")))).count() == 300


PLACE = f"{KEYS}, file string, start_line int, end_line int, source string, sink string"
FLOW = "repository string, run_id string, flow_id string, sink_file string, sink_line int, source_symbol string, sink_symbol string, path_confidence double"


def plain_flow(finding, flows):
    repository, run, _, file, start, end, source, sink = finding
    own = [f for f in flows if f[:2] == (repository, run) and f[3] == file]
    end = start if end is None else end
    order = lambda f: (-f[7], f[2])
    inside = [f for f in own if start is not None and f[4] is not None and start <= f[4] <= end]
    if inside:
        return min(inside, key=order)[2], "line"
    source, sink = (source or "").strip().lower(), (sink or "").strip().lower()

    def agrees(f):
        checks = [source in f[5].lower() or f[5].lower() in source] if source else []
        if sink:
            checks.append(sink.rsplit(".", 1)[-1] == f[6].lower().rsplit(".", 1)[-1])
        return bool(checks) and all(checks)

    alike = [f for f in own if agrees(f)]
    return (min(alike, key=order)[2], "symbols") if alike else None


def test_flows_by_lines_and_symbols_equal_a_plain_search(spark):
    rng = random.Random(7)
    names = ["", "q", "request.args", "args", "db.execute", "Cursor.Execute", "run"]
    place = lambda: (rng.choice("ab"), rng.choice("12"), rng.choice(["x.py", "y.py"]))
    flows, findings = [], []
    for i in range(60):
        repository, run, file = place()
        flows.append((repository, run, f"w{i:02d}", file, rng.choice([None, 1, 2, 17, 300, 5000, 10**6, 2 * 10**9, rng.randint(1, 400)]), rng.choice(names), rng.choice(names), rng.choice([0.5, 0.7, 0.9])))
    for i in range(120):
        repository, run, file = place()
        start = rng.choice([None, 1, 5, 16, 290, 10**6 - 3])
        end = rng.choice([None, start, start + 1, start + 15, start + 16, start + 17, start + 400, 10**6, 2 * 10**9, start - 1]) if start else None
        findings.append((repository, run, f"f{i % 40}|{i}", file, start, end, rng.choice([*names, None]), rng.choice([*names, None])))
    found = threat.attach_flows(spark.createDataFrame(findings, PLACE), spark.createDataFrame(flows, FLOW).repartition(3))
    got = {(r.repository, r.run_id, r.finding_id): (r.flow_id, r.how) for r in found.collect()}
    assert got == {f[:3]: want for f in findings if (want := plain_flow(f, flows))}
    assert {how for _, how in got.values()} == {"line", "symbols"}


def test_one_finding_id_in_two_repositories_gets_its_own_flow(spark):
    findings = spark.createDataFrame([(r, "1", "f", "x.py", 1, 9, "", "") for r in "ab"], PLACE)
    flows = spark.createDataFrame([(r, "1", f"w-{r}", "x.py", 4, "", "", 0.5) for r in "ab"], FLOW)
    assert sorted(tuple(r) for r in threat.attach_flows(findings, flows).collect()) == [("a", "1", "f", "w-a", "line"), ("b", "1", "f", "w-b", "line")]


WHOLE = {"declared": True, "scope": "runtime", "locked": True, "imported": True, "called": True, "deployed": True, "known_symbols": True}


@pytest.mark.parametrize(
    ("finding", "evidence", "scan", "want"),
    [
        ({}, WHOLE, {}, ("CONFIRMED_REACHABLE", "reachable", False)),
        ({}, {**WHOLE, "called": False}, {}, ("LIKELY_REACHABLE", "potentially_reachable", False)),
        ({}, {**WHOLE, "called": False, "imported": False}, {}, ("NO_PATH_FOUND", "unknown", False)),
        ({}, {**WHOLE, "known_symbols": False}, {}, ("ANALYSIS_INCOMPLETE", "unknown", True)),
        ({}, WHOLE, {"has_inventory": False}, ("ANALYSIS_INCOMPLETE", "unknown", True)),
        ({}, WHOLE, {"parse_failures": 1}, ("ANALYSIS_INCOMPLETE", "unknown", True)),
        ({}, {**WHOLE, "deployed": False}, {}, ("CONFIRMED_REACHABLE", "reachable", False)),
        ({}, {**WHOLE, "declared": False}, {}, ("ANALYSIS_INCOMPLETE", "unknown", True)),
        ({"dependency_scope": "development"}, {**WHOLE, "declared": False}, {}, ("CONFIRMED_REACHABLE", "reachable", False)),
        ({"dep_version": None}, {**WHOLE, "declared": False, "locked": False}, {}, ("NO_PATH_FOUND", "unknown", True)),
        ({"dep_name": None}, WHOLE, {}, ("NOT_ANALYSED", "unknown", True)),
    ],
)
def test_dependency_status(spark, finding, evidence, scan, want):
    f = {"dep_name": "My_Pkg", "dep_version": "1", "dep_direct": None, "dependency_scope": None, **finding}
    s = {"parse_failures": None, "has_inventory": True, **scan}
    findings = spark.createDataFrame([("r", "1", "f", *f.values()), ("other", "1", "f", *f.values())], f"{KEYS}, dep_name string, dep_version string, dep_direct boolean, dependency_scope string")
    proof = spark.createDataFrame([("r", "1", "my-pkg", *evidence.values())], "repository string, run_id string, package string, declared boolean, scope string, locked boolean, imported boolean, called boolean, deployed boolean, known_symbols boolean")
    scans = spark.createDataFrame([("r", "1", *s.values())], "repository string, run_id string, parse_failures int, has_inventory boolean")
    got = {r.repository: (r.dep_status, r.dep_reachability, r.dep_incomplete) for r in threat.dependency_reachability(findings, proof, scans).collect()}
    assert got["r"] == want and got["other"][1] == "unknown"


def test_feeds_are_merged_field_by_field_with_their_sources(spark):
    record = lambda source, ids, **more: (source, ids, *({"cvss_score": None, "cvss_vector": None, "epss": None, "epss_percentile": None, "kev": None, "known_exploitation_date": None, "ransomware_association": None, "fixed_versions": [], "published": None, "modified": None, "data_source_timestamp": None} | more).values())
    schema = "source string, advisory_ids array<string>, cvss_score double, cvss_vector string, epss double, epss_percentile double, kev boolean, known_exploitation_date string, ransomware_association string, fixed_versions array<string>, published string, modified string, data_source_timestamp string"
    records = spark.createDataFrame(
        [
            record("nvd", ["CVE-1"], cvss_score=9.1, cvss_vector="N", published="2024-02", modified="2024-03", data_source_timestamp="2024-05"),
            record("github-advisories", ["GHSA-1", "CVE-1"], cvss_score=9.1, cvss_vector="G", fixed_versions=["2.0", "1.5"], published="2024-01"),
            record("osv", ["GHSA-1"], cvss_vector="O", fixed_versions=["2.0"], modified="2024-04"),
            record("epss", ["CVE-1"], epss=0.2, epss_percentile=0.9), record("epss", ["CVE-2"], epss=0.7, epss_percentile=0.4),
            record("cisa-kev", ["CVE-2"], kev=True, known_exploitation_date="2023-01", ransomware_association="known"), record("osv", ["CVE-3"], kev=False),
        ],
        schema,
    )
    findings = spark.createDataFrame([("a", "1", "f", ["CVE-1", "GHSA-1"]), ("b", "1", "f", ["CVE-1", "CVE-2", None]), ("a", "2", "f", ["CVE-3"]), ("a", "3", "f", ["CVE-3"]), ("a", "4", "f", ["CVE-9"]), ("a", "5", "f", [])], f"{KEYS}, advisories array<string>")
    statuses = spark.createDataFrame([("a", "1", "f", "cisa-kev", "refreshed", "2024-06", False, None), ("a", "2", "f", "cisa-kev", "fresh-cache", None, False, None), ("a", "3", "f", "cisa-kev", "stale-cache", None, True, None), ("a", "3", "f", "nvd", "failed", None, None, "timeout")], f"{KEYS}, source string, status string, fetched_at string, stale boolean, failure string")
    got = {(r.repository, r.run_id): r for r in threat.enrich_fields(findings, records, statuses).collect()}
    r = got["a", "1"]
    assert (r.cvss_score, r.cvss_vector, r.cvss_source, r.epss_probability, r.epss_percentile) == (9.1, "G", "github-advisories", 0.2, 0.9)
    assert (r.kev_status, r.fixed_versions, r.published_date, r.modified_date, r.data_source_timestamp) == (False, ["1.5", "2.0"], "2024-01", "2024-04", "2024-06")
    assert r.advisory_ids == ["CVE-1", "GHSA-1"] and r.record_sources == ["epss", "github-advisories", "nvd", "osv"] and r.sources == ["cisa-kev"]
    r = got["b", "1"]
    assert (r.kev_status, r.known_exploitation_date, r.ransomware_association, r.epss_probability, r.epss_percentile, r.advisory_ids) == (True, "2023-01", "known", 0.7, 0.4, ["CVE-1", "CVE-2", "GHSA-1"])
    assert [got["a", n].kev_status for n in "2345" if ("a", n) in got] == [False, None, None] and got["a", "3"].stale and [tuple(x) for x in got["a", "3"].failures] == [("nvd", "timeout")]
    assert got["a", "4"].advisory_ids == ["CVE-9"] and got["a", "4"].fixed_versions == [] and len(got) == 5
