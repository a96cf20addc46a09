import math
import random
import re
from collections import Counter

import pytest

from findingflow.llm import ranked_search
from findingflow.llm.ranked_search import top_documents

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
rng = random.Random(4)
VOCABULARY = ["the", "of", "Straße", "ÉTÉ", "é", "x1", "naïve", "日本", *("".join(rng.choices("abcdefgh", k=rng.randint(1, 4))) for _ in range(150))]


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def brute(docs, items, k=10):
    bags = [(i, Counter(terms(t))) for i, t, *_ in docs]
    bags = [(i, b) for i, b in bags if b]
    total, length = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in set(items):
        found = []
        for doc, b in bags:
            m = 100 - 90 + (90 * sum(b.values()) * total) // length
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * b[t]) // (1000 * b[t] + 8 * m)) for t in set(terms(text)) if t in b)
            if score > 0:
                found.append((-score, doc is None, doc or 0))
        out += [(item, r, None if none else doc, -s) for r, (s, none, doc) in enumerate(sorted(found)[:k], 1)]
    return sorted(map(str, out))


def tables():
    docs = [(i, " ".join(rng.choices(VOCABULARY, k=rng.choice([0, 1, 3, 20, 200]))), 1, "x") for i in range(200)]
    docs += [(1000 - i, docs[7][1].upper() if i % 2 and docs[7][1].isascii() else docs[7][1] + " .", 1, "x") for i in range(40)]  # one class of many copies
    docs += [(500, "hello " * 3000 + "the été,x1;x1", 2, "y"), (None, "the of x1", 0, None), (None, None, 0, None), (3, "the", 1, "z"), (3, "the", 1, "z"), (4, "", 1, None)]
    items = [(i, " ".join(rng.choices(VOCABULARY, k=rng.randint(1, 12)))) for i in range(25)]
    return docs, [*items, items[0], (77, None), (78, ""), (79, "nowhere_found zzzzzz"), (None, "x1 the the")]


@pytest.mark.parametrize("block", [ranked_search.BLOCK, 40])
def test_lists_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ranked_search, "BLOCK", block)
    monkeypatch.setattr(ranked_search, "CELLS", 500)
    monkeypatch.setattr(ranked_search, "PIECE", 64)
    docs, items = tables()
    d = spark.createDataFrame(docs, "doc_id long, text string, m int, terms string").repartition(5)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = top_documents(d, b)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(str((r.item_id, r.rank, r.doc_id, r.score)) for r in got.collect()) == brute(docs, items)


def test_sums_beyond_doubles_are_exact(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "EXACT", 1)
    docs, items = tables()
    d, b = spark.createDataFrame(docs, "doc_id long, text string, m int, terms string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted(str((r.item_id, r.rank, r.doc_id, r.score)) for r in top_documents(d, b, k=3).collect()) == brute(docs, items, 3)


def test_empty_tables(spark):
    d, b = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    for x, y in ((d.limit(0), b), (d, b.limit(0)), (d.limit(0), b.limit(0))):
        assert top_documents(x, y).collect() == []
    assert top_documents(d, b).count() == 1
