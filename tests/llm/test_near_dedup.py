import random
from collections import defaultdict

import numpy as np
import pytest

from findingflow.llm.near_dedup import DF_BITS, components, inverse_frequencies, keep_one, near_duplicates, signatures, vectors, weigh, weighted_jaccard

rng = random.Random(4)
VOCABULARY = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(3000)]


def prose(n):
    return rng.choices(VOCABULARY, k=n)


def edited(words, n):
    words = list(words)
    for at in rng.sample(range(len(words)), n):
        words[at] = rng.choice(VOCABULARY)
    return words


def corpus():
    texts = [" ".join(prose(rng.randint(1, 200))) for _ in range(150)]
    passage = prose(60)
    for _ in range(25):
        base = prose(rng.randint(80, 300))
        texts += [" ".join(edited(base, rng.randint(0, 6))) for _ in range(rng.randint(1, 5))]
    texts += [" ".join(prose(60) + passage + prose(60)) for _ in range(120)]
    hot = prose(200)
    texts += [" ".join(edited(hot, 2)) for _ in range(90)]
    return texts + [None, "", "", "...", "...", "!?", "one two", "one two", "one TWO"] + texts[:5]


def brute(texts, idf):
    made = []
    for t in texts:
        h, n, _ = vectors([t or ""])
        made.append((h, weigh(h, n, idf)))
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for k in range(i):
            if (texts[i] or "") == (texts[k] or "") or weighted_jaccard(made[i], made[k]) >= 0.8:
                a, b = sorted((find(i), find(k)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


def test_classes_equal_brute_force(spark):
    texts = corpus()
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, class_id string").repartition(4)
    got = {r.doc_id: r for r in near_duplicates(df).collect()}
    want = brute(texts, inverse_frequencies(df, "text"))
    assert [got[i].class_id for i in range(len(texts))] == want
    sizes = defaultdict(int)
    for c in want:
        sizes[c] += 1
    assert all(got[i].class_size == sizes[c] for i, c in enumerate(want))


def test_pairs_among_texts_that_share_a_passage(spark):
    passage, texts = prose(450), []
    for _ in range(150):
        more = prose(63)
        texts += [" ".join(prose(37) + passage + more) for _ in range(2)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want = brute(texts, inverse_frequencies(df, "text"))
    assert 100 < len(set(want)) < 200
    got = {r.doc_id: r.class_id for r in near_duplicates(df).collect()}
    assert [got[i] for i in range(len(texts))] == want


def linked(texts, idf):
    """Classes by all pairs at once; every shingle must occur once in its text."""
    hashes, times, starts = vectors(texts)
    assert (times == 1).all()
    own, at = np.unique(hashes, return_inverse=True)
    grid = np.zeros((len(texts), len(own)), np.float32)
    grid[np.repeat(np.arange(len(texts)), np.diff(starts)), at] = np.sqrt(weigh(own, np.ones(len(own)), idf))[at]
    both = grid @ grid.T
    total = np.diag(both)
    alike = both / (total[:, None] + total[None, :] - both) >= 0.8
    root = np.arange(len(texts))
    while True:
        least = np.where(alike, root[None, :], len(texts)).min(1)
        if (least == root).all():
            return root.tolist(), int(np.triu(alike, 1).sum())
        root = least


@pytest.mark.parametrize("n", [100, 300])
def test_a_hot_family_whose_pairs_are_barely_alike(spark, n):
    base = rng.sample(VOCABULARY, 200)
    texts = [" ".join(edited(base, 3)) for _ in range(n)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want, links = linked(texts, inverse_frequencies(df, "text"))
    got = {r.doc_id: r.class_id for r in near_duplicates(df).collect()}
    assert links > n // 50 and 1 < len(set(want)) < n
    assert [got[i] for i in range(n)] == want


def test_samples_agree_as_often_as_texts_are_alike():
    idf = np.linspace(1, 1.5, 1 << DF_BITS).astype(np.float32)
    base = prose(400)
    found = []
    for n in (2, 8, 20, 40):
        texts = [" ".join(base), " ".join(edited(base, n))] + [" ".join(edited(base, n)) for _ in range(20)]
        h, t, s = vectors(texts)
        w = weigh(h, t, idf)
        sig = signatures(h, w, s[:-1])
        for k in range(1, len(texts)):
            exact = weighted_jaccard((h[s[0] : s[1]], w[s[0] : s[1]]), (h[s[k] : s[k + 1]], w[s[k] : s[k + 1]]))
            found.append((sig[0] == sig[k]).mean() - exact)
    assert abs(np.mean(found)) < 0.03


def test_components(spark):
    chain = [(bytes([i]), bytes([i + 1])) for i in range(40)] + [(b"\xf0", b"\xf1")]
    got = {r.node: r.label for r in components(spark.createDataFrame(chain, "a binary, b binary")).collect()}
    assert set(map(bytes, got.values())) == {b"\x00", b"\xf0"} and len(got) == 43
    assert components(spark.createDataFrame([], "a binary, b binary")).count() == 0


def test_empty_and_null_ids(spark):
    schema = "doc_id long, text string"
    assert near_duplicates(spark.createDataFrame([], schema)).count() == 0
    got = near_duplicates(spark.createDataFrame([(None, "a b c"), (None, "a b c"), (7, "x y z " * 20_000)], schema)).collect()
    assert sorted((str(r.doc_id), str(r.class_id), r.class_size) for r in got) == [("7", "7", 1), ("None", "None", 2), ("None", "None", 2)]


def test_one_row_of_each_class_stays_with_columns_of_any_name(spark):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(1, words, 1, "a", "b"), (2, words + " more", 2, "a", "b"), (1, words, 3, "a", "b"), (3, "other text of five words", 4, None, None)]
    for names in ("node", "row_id", "row_node"), ("_node", "_id", "kept"), ("label", "id", "class_id"):
        df = spark.createDataFrame(rows, f"doc_id long, text string, {names[0]} int, {names[1]} string, {names[2]} string")
        got = keep_one(df)
        assert got.columns == df.columns and sorted(r.doc_id for r in got.collect()) == [1, 3]
