import random
import re

from findingflow.llm import decontaminate
from findingflow.llm.decontaminate import drop_contaminated, find_contaminated

rng = random.Random(9)
VOCABULARY = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(2000)]


def prose(n):
    return rng.choices(VOCABULARY, k=n)


def shingle_set(text):
    w = re.findall(r"\w+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def tables():
    items = [prose(n) for n in (1, 3, 5, 6, 9, 12, 13, 20, 33, 40, 64, 65, 130, 200)] + [prose(rng.randint(5, 90)) for _ in range(60)]
    docs = [prose(rng.randint(0, 300)) for _ in range(200)]
    for item in items:
        for cut in (0, 0, 1, 3):
            part = item[: len(item) - cut] if rng.random() < 0.5 else [*item[: len(item) // 2], *prose(cut > 1), *item[len(item) // 2 :]]
            docs.append(prose(rng.randint(0, 3000)) + part + prose(rng.randint(0, 3000)))
    docs += [items[0], items[1], items[1] + ["x"]]
    docs = [(i, " ".join(d).upper() if i % 3 else ", ".join(d), 0) for i, d in enumerate(docs)] + [(None, None, 1), (900, "", 2), (900, "", 2), (901, " ".join(items[5] + items[6] + items[20]), 3)]
    return docs, [(i, " ".join(t)) for i, t in enumerate(items)] + [(500, None), (501, ""), (3, " ".join(items[3]))]


def brute(docs, items):
    out = set()
    for n, (doc_id, text, _) in enumerate(docs):
        own = shingle_set(text)
        for item_id, item in items:
            want = shingle_set(item)
            if want and len(want & own) >= 0.8 * len(want):
                out.add((n, doc_id, item_id, len(want), len(want & own)))
    return out


def test_pairs_equal_brute_force(spark, monkeypatch):
    docs, items = tables()
    want = sorted((str(d), i, n, k) for _, d, i, n, k in brute(docs, items))
    d = spark.createDataFrame(docs, "doc_id long, text string, n_item int").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    for block in (decontaminate.BLOCK, 2500):
        monkeypatch.setattr(decontaminate, "BLOCK", block)
        got = find_contaminated(d, b).collect()
        assert sorted((str(r.doc_id), r.item_id, r.n_item, r.n_shared) for r in got) == want
        assert all(r.containment == r.n_shared / r.n_item for r in got)
        bad = {n for n, *_ in brute(docs, items)}
        kept = drop_contaminated(d, b)
        assert kept.columns == d.columns
        assert sorted(map(str, kept.collect())) == sorted(map(str, spark.createDataFrame([x for n, x in enumerate(docs) if n not in bad], d.schema).collect()))


def test_empty_tables(spark):
    d, b = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string"), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert find_contaminated(d, b).count() == 1
    assert find_contaminated(d.limit(0), b).count() == find_contaminated(d, b.limit(0)).count() == 0
    assert drop_contaminated(d, b.limit(0)).count() == 1
