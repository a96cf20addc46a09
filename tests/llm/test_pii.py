import hashlib
import re

from collections import defaultdict

from findingflow.llm import queries
from findingflow.llm.pii import KINDS, Taken, base_spans, contexts, find_pii, is_secret_seed, loose_spans, luhn, redact, words_after, words_before

SHAPES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for k, (kind, shape) in enumerate(SHAPES.items()):
        for m in re.finditer(shape, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((k, *m.span()))
    return sorted(out, key=lambda s: (s[1], s[0]))


TEXTS = [
    None, "", "a@b.c@d.e x_y@z-1.co.uk. @x.y q@w", "1.2.3.4.5.6.7.8 256.1.1.1 010.0.0.255 1.2.3", "4111 1111-1111 1111 and 4111111111111112, 1.2.3.4111111111111111",
    "+1 (504) 555-2652 +12 +1234567890123456 ++44 20 7946 0958", "a.b@c" * 50, "x" * 5000 + "@" + "y" * 500 + ".z", "1" * 3000, "é" * 5 + "me@ex.org\n9807915762804490", "a@b.com_x@y.zz",
]


def test_base_spans_equal_the_plain_patterns():
    for text in TEXTS:
        assert base_spans(text or "") == plain(text or ""), text


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, base string")


def test_contexts_discover_unseen_identifiers(spark):
    known = [(i, f"kundin {i} erreichbar unter telefon nummer +49 30 5550{i:03d} ab morgen", "") for i in range(12)]
    rest = [
        (100, "bitte telefon nummer (030) 555 0199 ab morgen", ""),
        (101, "der preis von 030 555 0199 ist falsch", ""),
        (102, "telefon nummer (030) 555 0199 ab", ""),
        (None, None, ""),
        (103, "", ""),
        (103, "", ""),
    ]
    got = find_pii(frame(spark, known + rest)).collect()
    assert len(got) == len(known) + len(rest)
    found = {r.doc_id: [(KINDS[s.kind], s.start, s.end) for s in r.found] for r in got}
    assert found[100] == [("phone", 21, 35)] and found[102] == [("phone", 15, 29)] and found[101] == []
    assert all(len(r.base) == 1 for r in got if r.doc_id is not None and r.doc_id < 12)
    clean = {r.doc_id: r.text for r in redact(frame(spark, known + rest)).collect()}
    assert clean[100] == "bitte telefon nummer [PHONE] ab morgen" and clean[103] == "" and clean[None] is None
    assert clean[101] == rest[1][1] and clean[3].endswith("telefon nummer [PHONE] ab morgen")


def test_edges(spark):
    assert find_pii(frame(spark, [])).count() == 0
    rows = [(1, t, "clash") for t in TEXTS] * 2
    got = find_pii(frame(spark, rows)).collect()
    want = sorted(str(plain(t or "")) for _, t, _ in rows)
    assert sorted(str([(s.kind, s.start, s.end) for s in r.base]) for r in got) == want
    assert redact(frame(spark, rows)).count() == len(rows)


def test_query_counts_each_kind_and_digests_all(spark, tmp_path):
    texts = [*TEXTS, "000000000000.0.0.1 a@b.co", "+1 (504) 555-2652 or 4111 1111 1111 1111, 10.0.0.1 me@x.org", "\U0001f600 10.0.0.1 then 10.0.0.2 \U0001f600 me@x.org"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for folder in (str(tmp_path), "/root/testdata/sf0.01"):
        want = {}
        for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
            spans = plain(r.text or "")
            digest = hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
            want[r.doc_id] = (*(sum(s[0] == k for s in spans) for k in range(4)), digest)
        got = queries.op10_pii(spark, folder).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256").collect()
        assert len(got) == len(want) and {r[0]: tuple(r[1:]) for r in got} == want


def plain_graph(texts, rounds=3, min_known=5, min_score=0.8):
    """Found spans by plain rounds over all mentions."""
    seeds, loose = [], []
    for i, t in enumerate(texts):
        base = base_spans(t or "")
        seeds += [(i, *s, True) for s in base]
        loose += [(i, *s, s[0] == 4 and is_secret_seed(t, s[1], s[2])) for s in loose_spans(t or "", base)]
    edges = defaultdict(dict)
    for i, kind, a, b, known in seeds + loose:
        value = (kind, re.sub(r"\W+", "", texts[i][a:b].lower()))
        for p in contexts(texts[i], kind, a, b):
            edges[p][value] = max(edges[p].get(value, 0.0), float(known))
    good = lambda graph: {p: sum(v.values()) / len(v) for p, v in graph.items() if sum(v.values()) >= min_known and sum(v.values()) / len(v) >= min_score}
    patterns = good(edges)
    for _ in range(rounds - 1):
        best = defaultdict(float)
        for p, score in patterns.items():
            for v in edges[p]:
                best[v] = max(best[v], score)
        patterns = good({p: {v: max(k, best[v]) for v, k in vs.items()} for p, vs in edges.items()})
    return [sorted((a, kind, b) for j, kind, a, b, _ in loose if j == i and any(p in patterns for p in contexts(texts[i], kind, a, b))) for i in range(len(texts))]


def test_found_spans_of_the_given_tables_equal_plain_rounds(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip((r.doc_id for r in docs), plain_graph([r.text for r in docs]), strict=True))
    got = {r.doc_id: r for r in queries.op10_pii(spark, "/root/testdata/sf0.01").collect()}
    assert sum(map(len, want.values())) > 0
    for k, spans in want.items():
        personal, secrets = ([tuple(x.split(":")) for x in column.split(",") if x] for column in (got[k].spans, got[k].secrets))
        assert sorted(secrets) == sorted((KINDS[kind], str(a), str(b)) for a, kind, b in spans if kind == 4)
        found = {(KINDS[kind], str(a), str(b)) for a, kind, b in spans if kind < 4}
        assert got[k].n_found == len(found) and found <= set(personal)


def test_quoted_secrets_are_found_by_their_context(spark):
    keyed = [(i, f'x token = "{i:039x}a" y', "") for i in range(1, 9)]
    rest = [(20, 'token = "Zq93-unseen-key-0001x" z', ""), (21, "commit 00112233445566778899aabbccddeeff00112233 fixed", ""), (22, "token was 00112233445566778899aabbccddeeff x", "")]
    got = {r.doc_id: [(KINDS[s.kind], s.start, s.end) for s in r.found] for r in find_pii(frame(spark, keyed + rest)).collect()}
    assert got[3] == [("secret", 11, 51)] and got[20] == [("secret", 9, 30)] and got[21] == [] and got[22] == []


def test_redaction_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "mail a@b.cd now", "x", 2), (None, None, "y", 3)], "doc_id long, text string, spans string, span_id int").withColumnRenamed("spans", "_spans")
    for given in (df, df.withColumnRenamed("_spans", "spans")):
        got = redact(given)
        assert got.columns == given.columns and sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, [(1, "mail [EMAIL] now", "x", 2), (None, None, "y", 3)]))


def test_words_around_are_whole():
    text = "a" * 500 + " " + "b" * 300 + " = 1 " + "c" * 999
    assert words_before(text, 803, 2) == ["b" * 300, "="] and words_after(text, 805, 1) == ["c" * 999] and words_before("x y", 0, 2) == []


def test_taken_stretches():
    taken = Taken([(5, 9), (7, 12), (20, 21)])
    assert [taken.add(*x) for x in ((0, 5), (4, 6), (12, 20), (12, 13), (21, 30), (19, 21), (40, 41), (30, 40))] == [True, False, True, False, True, False, True, True]
