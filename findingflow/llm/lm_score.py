"""Masked pseudo-likelihood of documents under a bidirectional window network.

A small network, trained in numpy, predicts every token of a text from the two tokens on each side of it. A
document's score is the sum of these conditional log-probabilities.

1. One scan counts every word of every document. The most frequent words have ids of their own; the others share
   hashed ids, and an id's probability is dealt out to its words by their counts in the whole corpus, so every word
   is predicted however large the vocabulary. One part of each shared id is kept for words the corpus does not have.
2. Every partition of documents trains the network on all its windows from the same start, whose output biases are the
   words' frequencies; Spark averages the parameters, weighted by windows, in groups of at most 64 at a time.
3. A scan scores every position of every text. The output layer is a softmax in three levels of 16. Shared ids
   are settled by joins: the rare words of each segment (a few megabytes of text) meet the corpus counts by their hash,
   and go back to the segment's documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import map_batches, materialise, text_groups, values
from ._words import word_hashes

REACH = 2  # tokens on each side
BRANCH = 16
VOCABULARY = BRANCH**3
EDGE, RARE_BITS = 0, 9  # the id beyond a text's ends; rare words share 2**RARE_BITS ids
RARE = 1 << RARE_BITS
FREQUENT = VOCABULARY - 1 - RARE
WIDTH = 16
ROUNDS, RATE, BATCH = 1, 0.1, 32_768
CHUNK = 8192  # parameters a row when they are averaged
TOGETHER = 64  # copies averaged at once
SEGMENT = 8_000_000  # characters whose rare words are looked up together
SPAN = 2 * REACH
SIZES = (SPAN * VOCABULARY * WIDTH, WIDTH, WIDTH * BRANCH, BRANCH, BRANCH * WIDTH * BRANCH, BRANCH**2, BRANCH**2 * WIDTH * BRANCH, BRANCH**3)


class Model(NamedTuple):
    """What scoring needs: three arrays of fixed size, and the counts of all words as a table."""

    vocabulary: np.ndarray  # hashes of the frequent words, most frequent first
    parameters: np.ndarray
    shared: np.ndarray  # how many tokens of the corpus each shared id stands for
    counts: DataFrame  # hash, n


class Network:
    """Views into one flat vector: embeddings by place and token, hidden bias, and for each of three levels a softmax per node: weights and biases."""

    def __init__(self, flat: np.ndarray):
        self.flat, cuts = flat, np.cumsum((0, *SIZES))
        e, self.b, *levels = (flat[i:j] for i, j in zip(cuts, cuts[1:], strict=False))
        self.e = e.reshape(SPAN, VOCABULARY, WIDTH)
        self.weights = [w.reshape(-1, WIDTH, BRANCH) for w in levels[::2]]
        self.biases = [b.reshape(-1, BRANCH) for b in levels[1::2]]

    def hidden(self, context: np.ndarray) -> np.ndarray:
        h = self.e[0].take(context[:, 0], 0)
        for k in range(1, SPAN):
            h += self.e[k].take(context[:, k], 0)
        h += self.b
        return np.tanh(h, out=h)

    def log_probability(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Log-probability of each target given the tokens around it. Rows are worked on in order of their target, so each node's are one slice."""
        order = np.argsort(target, kind="stable")
        target, h = target[order], self.hidden(context[order])
        found = np.zeros(len(target), np.float32)
        for weights, biases, (own, nodes) in zip(self.weights, self.biases, paths(target), strict=True):
            for node, i, j in nodes:
                scores = h[i:j] @ weights[node]
                scores += biases[node]
                picked = scores[np.arange(j - i), own[i:j]]
                np.exp(scores, out=scores)
                found[i:j] += picked - np.log(scores.sum(1))
        out = np.empty_like(found)
        out[order] = found
        return out

    def train(self, context: np.ndarray, target: np.ndarray, rate: float, squares: Network) -> None:
        """One Adagrad step on a batch."""
        order = np.argsort(target, kind="stable")
        context, target = context[order], target[order]
        h = self.hidden(context)
        slope = np.zeros_like(h)
        for level, (own, nodes) in enumerate(paths(target)):
            for node, i, j in nodes:
                weights, rows = self.weights[level][node], h[i:j]
                error = rows @ weights
                error += self.biases[level][node]
                np.exp(error, out=error)
                error /= error.sum(1, keepdims=True)
                error[np.arange(j - i), own[i:j]] -= 1
                slope[i:j] += error @ weights.T
                step(weights, rows.T @ error, rate, squares.weights[level][node])
                step(self.biases[level][node], error.sum(0), rate, squares.biases[level][node])
        slope *= 1 - h * h
        step(self.b, slope.sum(0), rate, squares.b)
        for k in range(SPAN):
            order = np.argsort(context[:, k], kind="stable")
            token = context[order, k]
            first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            token, total = token[first], np.add.reduceat(slope.take(order, 0), first, 0)
            held = squares.e[k].take(token, 0) + total * total
            squares.e[k, token] = held
            self.e[k, token] -= rate * total / np.sqrt(held + 1e-8)


def step(weights: np.ndarray, slope: np.ndarray, rate: float, squares: np.ndarray) -> None:
    squares += slope * slope
    weights -= rate * slope / np.sqrt(squares + 1e-8)


def paths(target: np.ndarray) -> list[tuple[np.ndarray, list[tuple[int, int, int]]]]:
    """For each level: the branch each of the sorted targets takes there, and (node, from, to) of the rows that pass through each node."""
    out = []
    for level in range(3):
        node = target // (VOCABULARY // BRANCH**level)
        first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        out.append((target // (VOCABULARY // BRANCH ** (level + 1)) % BRANCH, list(zip(node[first].tolist(), first.tolist(), [*first[1:].tolist(), len(target)], strict=True))))
    return out


def fresh(counts: np.ndarray) -> np.ndarray:
    """The common start: small embeddings and weights, and output biases that give each id its share of ``counts``."""
    rng = np.random.default_rng(3)
    flat = np.zeros(sum(SIZES), np.float32)
    net, mass = Network(flat), counts + 0.5
    net.e[:] = rng.normal(0, 0.1, net.e.shape)
    for level in range(3):
        net.weights[level][:] = rng.normal(0, 0.1, net.weights[level].shape)
        share = mass.reshape(BRANCH**level, BRANCH, -1).sum(2)
        net.biases[level][:] = np.log(share / share.sum(1, keepdims=True))
    return flat


class Vocabulary:
    """Token ids by word hash: frequent words have their own, others share the last RARE ids by the leading bits of their hash."""

    def __init__(self, frequent: np.ndarray):
        self.order = np.argsort(frequent).astype(np.uint16)
        self.sorted = frequent[self.order]

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        rare = (hashes >> np.uint64(64 - RARE_BITS)).astype(np.uint16) + np.uint16(1 + FREQUENT)
        if not len(self.sorted):
            return rare
        at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
        return np.where(self.sorted[at] == hashes, self.order[at] + np.uint16(1), rare)


def windows(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The tokens around each token: REACH before, REACH after, EDGE beyond the text's ends."""
    counts = np.diff(starts)
    owner = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(ids)) + REACH * (owner + 1)  # texts stand apart by REACH edges
    padded = np.full(len(ids) + REACH * (len(counts) + 1), EDGE, ids.dtype)
    padded[place] = ids
    return np.stack([padded[place + k] for k in (*range(-REACH, 0), *range(1, REACH + 1))], 1)


def count_words(docs: DataFrame, text_col: str, most: int = 1_000_000) -> DataFrame:
    """Rows of (hash, n): how often each word occurs in part of a partition."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def rows() -> pa.RecordBatch:
            words, back = np.unique(np.concatenate([w for w, _ in held]), return_inverse=True)
            n = np.bincount(back, np.concatenate([n for _, n in held]), len(words)).astype(np.int64)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], names=["hash", "n"])

        for batch in batches:
            for group in text_groups(((None, t or "") for t in values(batch.column(0)))):
                held.append(np.unique(word_hashes([t for _, t in group])[0], return_counts=True))
                if sum(len(w) for w, _ in held) > most:
                    yield rows()
        if held:
            yield rows()

    return map_batches(docs.select(text_col), scan, "hash bigint, n bigint")


def train_round(docs: DataFrame, text_col: str, vocabulary: np.ndarray, start: np.ndarray, rate: float, most: int = BATCH) -> np.ndarray:
    """Parameters after every partition of documents has trained from ``start`` on all its windows, averaged by windows."""
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, start))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, begin = shared.value
        known, net, squares, n = Vocabulary(words), Network(begin.copy()), Network(np.full(len(begin), 0.1, np.float32)), 0
        for batch in batches:
            for group in text_groups(((None, t or "") for t in values(batch.column(0)))):
                hashes, starts = word_hashes([t for _, t in group])
                ids = known.ids(hashes)
                around = windows(ids, starts)
                at = 0
                while at < len(ids):  # steps grow with what was seen, so that small partitions take many
                    size = min(most, max(512, n // 16), len(ids) - at)
                    net.train(around[at : at + size], ids[at : at + size], rate, squares)
                    at, n = at + size, n + size
        if n:
            chunks = [net.flat[at : at + CHUNK].tobytes() for at in range(0, len(net.flat), CHUNK)]
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array(range(len(chunks)), pa.int32()), pa.array([part] * len(chunks), pa.int32()), pa.array([n] * len(chunks), pa.int64()), pa.array(chunks)], names=["chunk", "part", "n", "weights"])

    def average(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(n * np.frombuffer(w, np.float32).astype(np.float64) for n, w in zip(pdf["n"], pdf["weights"], strict=True))
        n = pdf["n"].sum()
        return pd.DataFrame({"chunk": [pdf["chunk"].iloc[0]], "part": [pdf["part"].iloc[0] // TOGETHER], "n": [n], "weights": [(total / n).astype(np.float32).tobytes()]})

    schema = "chunk int, part int, n bigint, weights binary"
    held = map_batches(docs.select(text_col), learn, schema)
    merge = lambda rows: rows.groupBy("chunk", F.floor(F.col("part") / TOGETHER).alias("together")).applyInPandas(average, schema)
    held = materialise(merge(held), "lm-averages")
    most = held.agg(F.max("part")).first()[0] or 0
    while most > 0:  # until one row a chunk is left, however many partitions there are
        held, most = merge(held), most // TOGETHER
    rows = sorted((r.chunk, r.weights) for r in held.collect())
    return np.frombuffer(b"".join(w for _, w in rows), np.float32) if rows else start


def fit(docs: DataFrame, text_col: str = "text", rounds: int = ROUNDS) -> Model:
    """Counts of all words, and the network trained on all windows."""
    counts = materialise(count_words(docs, text_col).groupBy("hash").agg(F.sum("n").alias("n")), "lm-counts")
    frequent = counts.orderBy(F.desc("n"), "hash").limit(FREQUENT).collect()
    vocabulary, times = np.array([r["hash"] for r in frequent], np.int64).view(np.uint64), np.array([r["n"] for r in frequent], np.int64)
    shared = np.zeros(RARE, np.int64)
    for r in counts.groupBy(F.shiftrightunsigned("hash", 64 - RARE_BITS).alias("slot")).agg(F.sum("n").alias("n")).collect():
        shared[r["slot"]] = r["n"]
    np.subtract.at(shared, (vocabulary >> np.uint64(64 - RARE_BITS)).astype(np.int64), times)
    flat = fresh(np.concatenate([[0], times, np.zeros(FREQUENT - len(times)), shared]))
    for k in range(rounds):
        flat = train_round(docs, text_col, vocabulary, flat, RATE / (k + 1))
    return Model(vocabulary, flat, shared, counts)


def score_by_id(docs: DataFrame, model: Model, id_col: str, text_col: str) -> DataFrame:
    """A row per document (segment, id, n_tokens, base, and its rare words as places in the segment's list), and one per segment with that list (words)."""
    shared = docs.sparkSession.sparkContext.broadcast((model.vocabulary, model.parameters, np.log(model.shared + 1.0)))
    rows = docs.select(id_col, text_col)
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, flat, log_shared = shared.value
        known, net, part = Vocabulary(vocabulary), Network(flat), TaskContext.get().partitionId()
        id_type = None

        def texts() -> Iterator[tuple]:
            nonlocal id_type
            for batch in batches:
                id_type = batch.schema.types[0]
                yield from zip(values(batch.column(0)), (t or "" for t in values(batch.column(1))), strict=True)

        for k, group in enumerate(text_groups(texts(), SEGMENT)):
            hashes, starts = word_hashes([t for _, t in group])
            ids = known.ids(hashes)
            around, each = windows(ids, starts), np.empty(len(ids))
            for at in range(0, len(ids), BATCH):
                each[at : at + BATCH] = net.log_probability(around[at : at + BATCH], ids[at : at + BATCH])
            rare = np.flatnonzero(ids > FREQUENT)
            each[rare] -= log_shared[ids[rare] - (1 + FREQUENT)]
            words, places = np.unique(hashes[rare], return_inverse=True)
            total = np.concatenate([[0.0], np.cumsum(each)])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(rare, starts), pa.int32()), pa.array(places, pa.int32()))
            segment = pa.array([part << 32 | k] * (len(group) + 1), pa.int64())
            columns = [pa.array([i for i, _ in group], id_type), pa.array(np.diff(starts), pa.int64()), pa.array(total[starts[1:]] - total[starts[:-1]]), lists, pa.nulls(len(group), WORDS)]
            yield pa.RecordBatch.from_arrays([segment[1:], *columns], names=NAMES)
            last = [pa.nulls(1, c.type) for c in columns[:-1]]
            yield pa.RecordBatch.from_arrays([segment[:1], *last, pa.array([words.view(np.int64)], WORDS)], names=NAMES)

    return map_batches(rows, run, f"segment bigint, id {kind}, n_tokens bigint, base double, rare array<int>, words array<bigint>")


WORDS = pa.list_(pa.int64())
NAMES = ["segment", "id", "n_tokens", "base", "rare", "words"]


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_tokens, log_likelihood (sum over all tokens) and mean_log_likelihood for every row.

    Tokens are lower-case words. Texts without words, null ones too, have 0 tokens, a sum of 0.0 and a null mean.
    Words that the model's corpus lacks are as likely as those it has once. Null ids stay null, repeated rows are
    repeated, an empty table gives an empty one, other columns are ignored.
    """
    scored = materialise(score_by_id(docs, model, id_col, text_col), "lm-scored")
    wanted = scored.where("words is not null").select(F.col("segment").alias("of"), F.posexplode("words").alias("place", "hash"))
    gains = wanted.join(model.counts.where("n > 1"), "hash").select("of", "place", F.log("n").alias("gain"))
    kind = scored.schema["id"].dataType.simpleString()

    def settle(rows: pa.Table, gained: pa.Table) -> pa.Table:
        """One segment: each rare word adds the logarithm of its count."""
        rows = rows.combine_chunks()
        lists = rows["rare"].combine_chunks() if rows.num_rows else pa.array([], pa.list_(pa.int32()))
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        place = gained["place"].to_numpy()
        places, begins = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(np.diff(lists.offsets.to_numpy()))])
        gain = np.zeros(1 + max(places.max(initial=0), place.max(initial=0)))
        gain[place] = gained["gain"].to_numpy()
        total = np.concatenate([[0.0], np.cumsum(gain[places])])
        n, sums = rows["n_tokens"].to_numpy(), rows["base"].to_numpy() + total[begins[1:]] - total[begins[:-1]]
        mean = pa.array(sums / np.maximum(n, 1), mask=n == 0)
        return pa.table([rows["id"], rows["n_tokens"], pa.array(sums), mean], names=[id_col, "n_tokens", "log_likelihood", "mean_log_likelihood"])

    both = scored.where("words is null").drop("words").groupBy("segment").cogroup(gains.groupBy("of"))
    return both.applyInArrow(settle, f"`{id_col}` {kind}, n_tokens bigint, log_likelihood double, mean_log_likelihood double")
