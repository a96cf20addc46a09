"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes of its words, of pairs of adjacent words and of pairs one or two words
apart, in ``2**bits`` slots. FTRL-proximal gives each coordinate its own learning rate and, through its L1 term, a
weight of exactly zero to all but a few. Only the nonzero weights are kept and broadcast: at most ``2**bits`` of them
(4 MB) whatever the corpus. Learning reads a bounded, documented sample of the labelled texts; scoring reads all.
"""

from __future__ import annotations

import tempfile
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import map_batches, materialise, slices, text_groups, values
from ._words import MIX, stir, word_hashes

BITS = 20
SAMPLE = 16_000
MOST_FEATURES = 48_000_000  # 192 MB on the driver's disk
BLOCK = 1 << 16  # slots whose weights are worked out at once
PACKED = 256 << 10  # bytes of features in a row for the driver
SKIPS = (0, 1, 2)  # words between the two words of a pair


def features(words: np.ndarray, starts: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all features of all texts, with the text each belongs to; not yet distinct."""
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    slots, owners = [stir(words)], [owner]
    for skip in SKIPS:
        step = skip + 1
        if len(words) > step:
            same = owner[step:] == owner[:-step]
            pair = stir(words[:-step] * MIX + np.uint64(2 * skip + 1) ^ words[step:])
            slots.append(pair[same])
            owners.append(owner[step:][same])
    return (np.concatenate(slots) >> np.uint64(64 - bits)).astype(np.int64), np.concatenate(owners)


def distinct_features(text: str, bits: int = BITS) -> np.ndarray:
    return np.unique(features(*word_hashes([text]), bits)[0]).astype(np.int32)


class Ftrl:
    """FTRL-proximal with per-coordinate rates; the bias is a coordinate of its own, without L1."""

    def __init__(self, bits: int = BITS, alpha: float = 1.0, beta: float = 1.0, l1: float = 8.0, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def all_weights(self) -> np.ndarray:
        """The weights of all slots, worked out in blocks, so that no work array is as long as the model."""
        w = np.empty(len(self.z) - 1)
        for at in range(0, len(w), BLOCK):
            w[at : at + BLOCK] = self.weights(slice(at, min(at + BLOCK, len(w))))
        return w

    def bias(self) -> float:
        return float(-self.z[-1] / ((self.beta + np.sqrt(self.n[-1])) / self.alpha))

    def learn(self, slots: np.ndarray, label: int) -> None:
        w, b = self.weights(slots), self.bias()
        g = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35))) - label
        n = self.n[slots]
        self.z[slots] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[slots] = n + g * g
        more = self.n[-1] + g * g
        self.z[-1] += g - (np.sqrt(more) - np.sqrt(self.n[-1])) / self.alpha * b
        self.n[-1] = more


def margin_shift(margins: np.ndarray, labels: np.ndarray) -> float:
    """What to add to the margins so that their signs agree with most labels: the middle of the best interval."""
    cuts = np.unique(margins)
    if len(cuts) < 2 or not 0 < labels.sum() < len(labels):
        return 0.0
    middles = (cuts[1:] + cuts[:-1]) / 2
    order = np.argsort(margins)
    ranked, below = labels[order], np.searchsorted(margins[order], middles)
    right = (below - np.concatenate([[0], np.cumsum(ranked)])[below]) + (ranked.sum() - np.concatenate([[0], np.cumsum(ranked)])[below])
    best = np.flatnonzero(right == right.max())
    return float(-(middles[best[0]] + middles[best[-1]]) / 2)


def train(rows: list[tuple[np.ndarray, int]], bits: int = BITS, epochs: int = 4) -> tuple[np.ndarray, np.ndarray, float]:
    """Slots and values of the nonzero weights, and the bias. Every tenth row is kept back to set the bias by."""
    model, order = Ftrl(bits), np.random.default_rng(11)
    learnt = [i for i in range(len(rows)) if i % 10 or len(rows) < 100]
    for _ in range(epochs):
        for i in order.permutation(learnt):
            model.learn(*rows[i])
    w, bias = model.all_weights(), model.bias()
    back = rows[::10] if len(rows) >= 100 else []
    bias += margin_shift(np.array([w[s].sum() + bias for s, _ in back]), np.array([label for _, label in back]))
    slots = np.flatnonzero(w)
    return slots.astype(np.int64), w[slots].astype(np.float32), bias


def held_out(id_col: str) -> F.Column:
    """True for the fifth of the rows, by crc32 of the id as text, that is never learnt from; null ids count as 'null'."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int, bits: int, most_features: int = MOST_FEATURES) -> list[tuple[np.ndarray, int]]:
    """Features and labels of at most about ``sample`` labelled texts, chosen by a hash of their id; only features reach the driver.

    Of the sample, in order of that hash, texts are taken while their features number at most ``most_features``, so the
    driver's share is bounded in bytes too. They lie in a temporary file that is mapped, not in the driver's own memory. An id with several texts counts with the least of them.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(id_col).agg(F.max(label_col).cast("int").alias("label"))
    share = sample / max(sample, known.count())
    chance = F.xxhash64(id_col, F.lit("toxicity")).bitwiseAND(F.lit((1 << 30) - 1))
    picked = materialise(known.where(chance < int(share * (1 << 30))), "toxicity-sample")
    texts = docs.select(id_col, text_col).join(F.broadcast(picked), id_col).groupBy(id_col, "label").agg(F.min(F.coalesce(text_col, F.lit(""))).alias("text"))
    chosen = texts.select(chance.alias("chance"), "label", "text")

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [distinct_features(t, bits).tobytes() for t in values(batch.column(2))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found, pa.binary())], names=["chance", "label", "slots"])

    made = materialise(map_batches(chosen, turn, "chance bigint, label int, slots binary"), "toxicity-features")
    sizes = np.array(sorted(tuple(r) for r in made.select("chance", F.octet_length("slots") / 4).collect()) or np.empty((0, 2))).reshape(-1, 2)
    fit = int(np.searchsorted(np.cumsum(sizes[:, 1]), most_features, "right"))
    if fit < len(sizes):
        made = made.where(F.col("chance") < int(sizes[fit, 0]))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts' features in rows of about PACKED bytes, so that the driver holds neither many small buffers nor several copies of a huge one."""
        for batch in batches:
            for part in slices(batch, 2, PACKED):
                slots = part.column(2).to_pylist()
                columns = [pa.array([x.to_pylist()], pa.list_(t)) for x, t in ((part.column(0), pa.int64()), (part.column(1), pa.int32()))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([[len(x) // 4 for x in slots]], pa.list_(pa.int32())), pa.array([b"".join(slots)], pa.binary())], names=["chances", "labels", "sizes", "slots"])

    rows, at = [], 0
    with tempfile.TemporaryFile() as file:
        for r in map_batches(made, pack, "chances array<bigint>, labels array<int>, sizes array<int>, slots binary").toLocalIterator():
            file.write(r.slots)
            for by, size, label in zip(r.chances, r.sizes, r.labels, strict=True):
                rows.append((by, size, label, at))
                at += size
        file.flush()
        held = np.asarray(np.memmap(file, np.int32, "r")) if at else np.empty(0, np.int32)  # stays mapped while it is used, without a name
    rows.sort(key=lambda row: row[:3])
    return [(held[at : at + size], label) for _, size, label, at in rows]


def fitted(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int, bits: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Slots, nonzero weights and bias, learnt from the labelled ones among ``docs``."""
    rows = training_rows(docs, labels, id_col, text_col, label_col, sample, bits)
    return train(rows, bits) if rows else (np.empty(0, np.int64), np.empty(0, np.float32), -1e-6)


def scorer(model: tuple[np.ndarray, np.ndarray, float], bits: int) -> Callable[[Iterable], np.ndarray]:
    """What turns texts into scores."""
    slots, weights, bias = model
    table = np.zeros(1 << bits, np.float32)
    table[slots] = weights

    def scores(texts: Iterable) -> np.ndarray:
        out = []
        for group in text_groups(((None, t or "") for t in texts), 1_000_000):
            found, owner = features(*word_hashes([t for _, t in group]), bits)
            hit = table[found] != 0
            pairs = np.unique(owner[hit] << bits | found[hit])
            sums = np.bincount(pairs >> bits, table[pairs & ((1 << bits) - 1)], len(group)) + bias
            out.append(1 / (1 + np.exp(-np.clip(sums, -35, 35))))
        return np.concatenate(out) if out else np.empty(0)

    return scores


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, bits: int = BITS) -> DataFrame:
    """``id_col``, held_out, score (0 to 1) and predicted for every row of ``docs``.

    ``sample`` (and ``MOST_FEATURES``) bounds the labelled texts that are learnt from, by a hash of the id, so they are the same ones every time;
    rows whose crc32(id as text) is divisible by 5 are held out. Null and empty texts score by the bias alone.
    Ids may repeat or be null; labels that are null or neither 0 nor 1 are ignored, an id labelled twice counts by
    its larger label, and without any label every score is 0.5 or less and nothing is predicted toxic.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, id_col, text_col, label_col, sample, bits))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = scorer(shared.value, bits)
        for batch in batches:
            s = scores(values(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[id_col, "held_out", "score", "predicted"])

    rows_in = docs.select(id_col, text_col, held_out(id_col).alias("held_out"))
    return map_batches(rows_in, score, f"`{id_col}` {rows_in.schema[id_col].dataType.simpleString()}, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, bits: int = BITS) -> DataFrame:
    """``docs``, all columns, without the rows that ``score_toxicity`` predicts to be toxic."""
    shared, at = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, id_col, text_col, label_col, sample, bits)), docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = scorer(shared.value, bits)
        for batch in batches:
            yield batch.filter(pa.array(scores(values(batch.column(at))) < 0.5))

    return map_batches(docs, keep, docs.schema)


def crc_mod5(doc_id: int) -> int:
    """The remainder that decides what is held out, in plain Python (for tests)."""
    return zlib.crc32(str(doc_id).encode()) % 5
