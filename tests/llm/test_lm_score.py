import math
import random
from collections import Counter

import numpy as np
import pytest

from findingflow.llm import lm_score
from findingflow.llm._words import word_hashes
from findingflow.llm.lm_score import EDGE, FREQUENT, Network, Vocabulary, fit, fresh, score

rng = random.Random(8)
AFTER = {w: rng.sample("abcdefghijklmnopqrst", 3) for w in "abcdefghijklmnopqrst"}


def chain(n):
    words = [rng.choice("abcdef")]
    while len(words) < n:
        words.append(rng.choice(AFTER[words[-1]]))
    return " ".join(words)


def corpus(spark, n=600):
    return spark.createDataFrame([(i, chain(rng.randint(50, 200))) for i in range(n)], "doc_id long, text string").repartition(4)


@pytest.fixture(scope="module")
def model(spark):
    return fit(corpus(spark))


def test_probabilities_sum_to_one(model):
    net = Network(model.parameters)
    around = np.array([[1, 2, 3, 4], [0, 0, 9, 4000]], np.uint16)
    total = sum(np.exp(net.log_probability(around, np.full(2, t, np.uint16))) for t in range(lm_score.VOCABULARY))
    assert np.allclose(total, 1, atol=1e-3)


def plain_score(model, counts, text):
    """Token by token: the network's probability of the id, and a rare word's share of it."""
    net, known = Network(model.parameters), Vocabulary(model.vocabulary)
    hashes = word_hashes([text or ""])[0]
    ids = known.ids(hashes).tolist()
    pad = [EDGE] * 2 + ids + [EDGE] * 2
    total = 0.0
    for k, (i, h) in enumerate(zip(ids, hashes.tolist(), strict=True)):
        total += float(net.log_probability(np.array([[pad[k], pad[k + 1], pad[k + 3], pad[k + 4]]], np.uint16), np.array([i], np.uint16))[0])
        if i > FREQUENT:
            total += math.log(max(1, counts.get(h, 0))) - math.log(1 + sum(n for g, n in counts.items() if known.ids(np.array([g], np.uint64))[0] == i))
    return len(ids), total


def test_scores_equal_brute_force_and_order_matters(spark, model):
    texts = [chain(100), "", None, "!?", "a", "zzz unseen a b c " * 3, chain(20_000)]
    shuffled = texts[0].split()
    rng.shuffle(shuffled)
    texts.append(" ".join(shuffled))
    got = {r.doc_id: r for r in score(spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int"), model).collect()}
    for i, t in enumerate(texts):
        if i != 6:
            n, want = plain_score(model, {}, t)
            assert got[i].n_tokens == n and got[i].log_likelihood == pytest.approx(want, rel=1e-3, abs=1e-3)
    assert got[6].n_tokens == 20_000 and got[1].mean_log_likelihood is None and got[2].log_likelihood == 0.0
    assert got[0].mean_log_likelihood > got[7].mean_log_likelihood + 0.3
    untrained, known = Network(fresh(np.zeros(lm_score.VOCABULARY))), Vocabulary(model.vocabulary)
    ids = known.ids(word_hashes([texts[0]])[0])
    assert got[0].mean_log_likelihood > untrained.log_probability(lm_score.windows(ids, np.array([0, len(ids)])), ids).mean() + 2


def test_rare_words_go_by_their_counts_and_repeats_score_apart(spark):
    made = lambda n: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))
    once, twice = [made(80) for _ in range(60)], [made(80) for _ in range(20)]
    texts = once + twice + twice
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    model = fit(docs)
    counts = Counter(word_hashes(texts)[0].tolist())
    assert {r["hash"] % (1 << 64): r["n"] for r in model.counts.collect()} == counts
    got = {r.doc_id: r.log_likelihood for r in score(docs, model).collect()}
    for i in (0, 65, 99):
        assert got[i] == pytest.approx(plain_score(model, counts, texts[i])[1], rel=1e-3)
    assert min(got[i] for i in range(60, 100)) > max(got[i] for i in range(60))


def test_every_window_is_learnt_from(spark):
    words = " ".join(f"word{i}" for i in range(40))
    model = fit(spark.createDataFrame([(1, words)], "doc_id long, text string"))
    start = Network(fresh(np.concatenate([[0], np.ones(40), np.zeros(lm_score.VOCABULARY - 41)])))
    moved = (Network(model.parameters).e != start.e).any(2)
    assert moved[:, 1:41].sum() == 4 * 40 - 2 * (1 + 2) and moved[:, 0].all() and not moved[:, 41:].any()


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert score(none, fit(none)).count() == 0
    assert score(spark.createDataFrame([(None, "a b")], "doc_id long, text string"), fit(none)).count() == 1
