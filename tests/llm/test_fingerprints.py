import hashlib
import random
import re

from pyspark.sql import functions as F

from findingflow.llm import fingerprints
from findingflow.llm.fingerprints import fingerprint_edits, sketch

rng = random.Random(2)
VOCABULARY = ["".join(rng.choices("abcdefghéüßñ🙂", k=rng.randint(1, 8))) for _ in range(500)]


def prose(n):
    return " ".join(rng.choices(VOCABULARY, k=n))


def test_edits_and_likeness(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "PER_RANGE", 7)
    texts = [prose(rng.randint(0, 120)) for _ in range(80)] + [None, "", " ...  ", "one", "A b, c!", "a B c", prose(4000)]
    ids = rng.sample(range(-(10**12), 10**12), 40) + list(range(len(texts) - 40))
    rows = list(zip(ids, texts, strict=True))
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fingerprint string").repartition(5)
    got = {r.doc_id: r for r in fingerprint_edits(df).collect()}
    assert len(got) == len(rows)
    rows.sort()
    words = lambda t: re.findall(r"[^\W]+", t.lower())
    sh = lambda t: {tuple(words(t)[i : i + 5]) for i in range(max(1, len(words(t)) - 4))} if words(t) else set()
    errors, by_text = [], {}
    for n, (i, t) in enumerate(rows):
        t, following, r = t or "", rows[(n + 1) % len(rows)][1] or "", got[i]
        h = len(t) // 2
        edited = t[: len(t) - h] + following[:h]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        by_text.setdefault(t, r.fingerprint)
        by_text.setdefault(edited, r.edited_fingerprint)
        assert by_text[t] == r.fingerprint and by_text[edited] == r.edited_fingerprint
        for other, near in ((edited, r.near_edited), (following, r.near_next)):
            a, b = sh(t), sh(other)
            true = len(a & b) / len(a | b) if a | b else 1.0
            assert 0 <= near <= 1
            if len(a | b) > 40:
                errors.append(abs(near - true))
    assert sum(errors) / len(errors) < 0.05


def test_ties_nulls_and_empty(spark):
    schema = "doc_id long, text string"
    got = fingerprint_edits(spark.createDataFrame([(None, "abcd"), (5, "xy"), (5, "xy"), (5, "zz")], schema)).collect()
    edited = sorted(r.edited_sha256 for r in got)
    assert edited == sorted(hashlib.sha256(t.encode()).hexdigest() for t in ("abxy", "xx", "xz", "za"))
    assert fingerprint_edits(spark.createDataFrame([], schema)).count() == 0
    (alone,) = fingerprint_edits(spark.createDataFrame([(1, "abc def")], schema)).collect()
    assert alone.edited_sha256 == hashlib.sha256(b"abc abc").hexdigest()


def test_ranges_have_equal_counts_however_ids_are_spread(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "PER_RANGE", 50)
    ids = [*range(2000), 10**15, -(2**63) + 5, *[77] * 1500, *[None] * 900]
    df = spark.createDataFrame([(i, f"text {n}") for n, i in enumerate(ids)], "doc_id long, text string")
    rows = df.withColumn("_key", F.coalesce("doc_id", F.lit(fingerprints.LEAST)))
    dealt = fingerprints.dealt_in_order(rows, "_key").where("_guest = 0")
    sizes = [r["count"] for r in dealt.groupBy("_bucket").count().collect()]
    assert sum(sizes) == len(ids) and max(sizes) <= 200
    got = fingerprint_edits(df).collect()
    assert len(got) == len(ids)
    own = {i: f"text {n}" for n, i in enumerate(ids)}
    for r in got:
        if r.doc_id is not None and 100 <= r.doc_id < 1999:
            t, following = own[r.doc_id], own[r.doc_id + 1]
            h = len(t) // 2
            assert r.edited_sha256 == hashlib.sha256((t[: len(t) - h] + following[:h]).encode()).hexdigest()


def test_sketches_merge(spark):
    a, b = prose(300), prose(200)
    s = {r.k: set(r.s) for r in sketch(spark.createDataFrame([("a", a), ("b", b), ("ab", a + " " + b)], "k string, text string"), "text", "s").collect()}
    assert s["a"] | s["b"] <= s["ab"] and len(s["ab"]) - len(s["a"] | s["b"]) <= 4
    assert 0.15 < len(s["ab"]) / 496 < 0.35


def test_plan_is_native(spark):
    df = fingerprint_edits(spark.createDataFrame([(1, "a")], "doc_id long, text string")).select(F.col("fingerprint"))
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
