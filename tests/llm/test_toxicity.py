import math
import random
import tracemalloc

import numpy as np

from findingflow.llm.toxicity import Ftrl, crc_mod5, distinct_features, drop_toxic, features, margin_shift, score_toxicity, train, training_rows
from findingflow.llm._words import word_hashes

rng = random.Random(1)
CALM = "the of and that with from this for are was house tree river stone light cloud".split()
RUDE = "idiot scum moron".split()


def text(toxic):
    words = rng.choices(CALM, k=rng.randint(5, 60))
    for _ in range(2 * toxic):
        words.insert(rng.randrange(len(words)), rng.choice(RUDE))
    return " ".join(words)


def test_held_out_accuracy(spark):
    truth = {i: int(rng.random() < 0.2) for i in range(1500)}
    docs = spark.createDataFrame([(i, text(t), "x", 0.1) for i, t in truth.items()], "doc_id long, text string, lang string, score double")
    # The labels of held-out rows are wrong: they must not be learnt from.
    labels = spark.createDataFrame([(i, 1 - t if crc_mod5(i) == 0 else t) for i, t in truth.items()] + [(1, None), (5000, 1), (None, 1)], "doc_id long, toxic int")
    got = score_toxicity(docs, labels).collect()
    assert len(got) == 1500
    assert all(r.held_out == (crc_mod5(r.doc_id) == 0) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in got)
    out = [r for r in got if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in out) / len(out) > 0.98


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 3), (1, "", 3), (None, "idiot", 3), (2, "the " * 30_000, 3)], "doc_id long, text string, predicted int")
    labels = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "doc_id long, toxic int")
    got = score_toxicity(docs, labels).collect()
    assert len(got) == 4 and len({r.score for r in got if r.doc_id == 1}) == 1
    assert score_toxicity(docs, labels.limit(0)).where("predicted = 1").count() == 0
    assert score_toxicity(docs.limit(0), labels).count() == 0
    clash = docs.withColumnsRenamed({"predicted": "predicted_toxic"}).withColumn("score", docs.doc_id)
    kept = drop_toxic(clash, labels)
    assert kept.columns == ["doc_id", "text", "predicted_toxic", "score"] and kept.count() == 4


def test_features_stay_inside_a_text():
    together = features(*word_hashes(["a b c", "d e", "", "f"]))
    for i, one in enumerate(["a b c", "d e", "", "f"]):
        assert set(together[0][together[1] == i]) == set(distinct_features(one))


def test_margin_shift():
    m, y = np.array([-3.0, -2.0, -1.0, 0.5]), np.array([0, 0, 1, 1])
    assert margin_shift(m, y) == 1.5 and margin_shift(m, y * 0) == 0.0


def plain_ftrl(rows, alpha=1.0, beta=1.0, l1=8.0, l2=0.1):
    """One coordinate at a time, in dictionaries, as the algorithm is written; the bias has no penalties."""
    z, n = {}, {}

    def weight(i):
        a, b = (0.0, 0.0) if i == "bias" else (l1, l2)
        x = z.get(i, 0.0)
        return 0.0 if abs(x) <= a else -(x - math.copysign(a, x)) / ((beta + math.sqrt(n.get(i, 0.0))) / alpha + b)

    for slots, label in rows:
        at = [*slots, "bias"]
        w = {i: weight(i) for i in at}
        g = 1 / (1 + math.exp(-max(-35, min(35, sum(w.values()))))) - label
        for i in at:
            sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / alpha
            z[i] = z.get(i, 0.0) + g - sigma * w[i]
            n[i] = n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z}


def test_learning_equals_the_plain_algorithm():
    rows = [(np.array(sorted(rng.sample(range(60), rng.randint(0, 12)) + [60] * 0), np.int32), int(rng.random() < 0.3)) for _ in range(400)]
    want, model = plain_ftrl([(r.tolist(), y) for r, y in rows], l1=1.0), Ftrl(6, l1=1.0)
    for slots, label in rows:
        model.learn(slots, label)
    got = model.weights(slice(0, -1))
    assert np.allclose(got[:60], [want.get(i, 0.0) for i in range(60)]) and math.isclose(model.bias(), want["bias"])
    assert (got == 0).sum() > 5 and (got != 0).sum() > 5


def test_scores_equal_a_plain_sum(spark):
    truth = {i: int(rng.random() < 0.3) for i in range(300)}
    texts = {i: text(t) for i, t in truth.items()}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame(list(truth.items()), "doc_id long, toxic int")
    slots, weights, bias = train(training_rows(docs, labels, "doc_id", "text", "toxic", 1000, 20))
    known = dict(zip(slots.tolist(), weights.tolist(), strict=True))
    for r in score_toxicity(docs, labels, sample=1000).collect():
        margin = bias + sum(known.get(i, 0.0) for i in distinct_features(texts[r.doc_id]).tolist())
        assert math.isclose(r.score, 1 / (1 + math.exp(-margin)), rel_tol=1e-5)


def test_what_is_learnt_from_is_bounded(spark):
    docs = spark.createDataFrame([(i % 100, f"w{i} x{i} y{i}") for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, toxic int")
    every = training_rows(docs, labels, "doc_id", "text", "toxic", 1000, 20)
    assert len(every) == sum(crc_mod5(i) != 0 for i in range(100))  # one text an id
    some = training_rows(docs, labels, "doc_id", "text", "toxic", 1000, 20, most_features=100)
    assert sum(len(s) for s, _ in some) <= 100 and 10 < len(some) < 30
    assert [s.tolist() for s, _ in some] == [s.tolist() for s, _ in every[: len(some)]]


def test_features_stay_out_of_the_drivers_memory(spark):
    docs = spark.range(500).selectExpr("id doc_id", "array_join(transform(sequence(1, 5000), x -> concat('w', xxhash64(id, x))), ' ') text")
    labels = spark.range(500).selectExpr("id doc_id", "int(id % 2) toxic")
    tracemalloc.start()
    rows = training_rows(docs, labels, "doc_id", "text", "toxic", 1000, 20)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    size = 4 * sum(len(slots) for slots, _ in rows)
    assert size > 25_000_000 and most < size / 3


def test_all_weights_equal_those_worked_out_at_once():
    model, drawn = Ftrl(18), np.random.default_rng(1)
    model.z[:], model.n[:] = drawn.normal(0, 9, len(model.z)), drawn.random(len(model.n))
    assert (model.all_weights() == model.weights(slice(0, -1))).all()
