"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

1. Document frequencies of five-word shingles, counted over all documents in ``2**DF_BITS`` hashed slots.
2. One scan gives every text a signature: ``BANDS * ROWS`` consistent weighted samples of its TF-IDF shingles, whose
   chance of agreeing in each place is the weighted Jaccard similarity of two texts.
3. Texts that agree in a whole band are candidates. Equal texts were joined to one node before, by their digest. In
   a bucket of up to ``SMALL`` nodes all pairs are compared. A larger bucket is dealt out again by further samples
   and its parts are compared with one centre each; this only finds classes early.
4. Candidate pairs whose signatures agree enough are verified by the weighted Jaccard similarity of the whole texts.
5. All texts of larger buckets are then joined exactly: two similar texts share a shingle among the rarest of each
   (prefix filter). The likeliest pair of each two classes is tried first, then all pairs that are still apart: only
   pairs that are already in one class are left out.
6. Classes are the connected components of verified pairs, found by hooking labels and contracting links.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ._common import map_batches, materialise, text_groups, unused, values
from ._words import shingles, stir, word_hashes

SIZE, SIMILARITY = 5, 0.8
BANDS, ROWS = 12, 3
HASHES = BANDS * ROWS
REFINE = 2  # further samples by which a large bucket is dealt out
SMALL = 32
BLOCK = 512  # members of a prefix group that meet in one row
AGREE = 19  # of the 36 samples: 1 in 10,000 pairs at 0.8 agrees in fewer
DF_BITS = 20  # 1 MB of weights
SLOT_BITS = 15
BROADCAST_ROWS = 500_000


def vectors(texts: list[str], size: int = SIZE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: (hash of 52 bits, times it occurs, where each text begins). At most 4096 texts."""
    hashes, begins = shingles(*word_hashes(texts), size)
    owner = np.repeat(np.arange(len(texts), dtype=np.uint64), np.diff(begins))
    keys = np.sort(owner << np.uint64(52) | hashes >> np.uint64(12))
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    times = np.diff(np.concatenate([first, [len(keys)]]))
    keys = keys[first]
    starts = np.searchsorted(keys >> np.uint64(52), np.arange(len(texts) + 1, dtype=np.uint64))
    return keys & np.uint64((1 << 52) - 1), times, starts


def df_slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(52 - DF_BITS)).astype(np.int64)


def inverse_frequencies(docs: DataFrame, text_col: str) -> np.ndarray:
    """A weight from 1 (in every document) to 1.5 (in one) for each slot. Counts cover all documents; only slots reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, n = np.zeros(1 << DF_BITS, np.int64), 0
        for batch in batches:
            for group in text_groups(((None, t or "") for t in values(batch.column(0)))):
                totals += np.bincount(df_slot(vectors([t for _, t in group])[0]), minlength=1 << DF_BITS)
                n += len(group)
        at = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(totals[at], n), pa.int64())], names=["slot", "n"])

    counted = map_batches(docs.select(text_col), count, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n"))
    weights, total = np.zeros(1 << DF_BITS), 0
    for batch in counted.toArrow().to_batches():
        slots, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        weights[slots[slots >= 0]] = n[slots >= 0]
        total += int(n[slots < 0].sum())
    return inverse(weights, max(1, total))


def inverse(frequencies: np.ndarray, total: int) -> np.ndarray:
    """The weights of slots in so many of ``total`` documents, worked out in the place of ``frequencies``."""
    np.minimum(frequencies, total, out=frequencies)
    frequencies += 1
    np.divide(1 + total, frequencies, out=frequencies)
    np.log(frequencies, out=frequencies)
    frequencies *= 0.5
    frequencies /= np.log(1 + total)
    frequencies += 1
    return frequencies.astype(np.float32)


def weigh(hashes: np.ndarray, times: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return (1 + np.log(times)).astype(np.float32) * idf[df_slot(hashes)]


@lru_cache(1)
def _draws() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each sample and slot: r and ln c with r, c from Gamma(2, 1), and beta uniform."""
    rng, shape = np.random.Generator(np.random.Philox(20240607)), (HASHES, 1 << SLOT_BITS)
    return rng.gamma(2, 1, shape).astype(np.float32), np.log(rng.gamma(2, 1, shape)).astype(np.float32), rng.random(shape, np.float32)


def signatures(hashes: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Samples of each non-empty text, as rows of 32-bit values. Ioffe's scheme: the element with least ln a = ln c - r (t - beta + 1), t = floor(ln w / r + beta)."""
    r, log_c, beta = _draws()
    slot = (stir(hashes) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
    low, log_w = stir(hashes + np.uint64(1)).astype(np.uint32), np.log(weights)
    out = np.empty((len(starts), HASHES), np.uint32)
    for j in range(HASHES):
        rj, bj = r[j].take(slot), beta[j].take(slot)
        t = np.floor(log_w / rj + bj)
        log_a = (log_c[j].take(slot) - rj * (t - bj + 1)).view(np.int32)
        rank = np.where(log_a < 0, ~log_a, log_a | np.int32(-(1 << 31))).view(np.uint32)
        element = low ^ t.astype(np.int32).view(np.uint32) * np.uint32(0x85EBCA6B)
        out[:, j] = np.minimum.reduceat(rank.astype(np.uint64) << np.uint64(32) | element, starts).astype(np.uint32)
    return out


def sign(docs: DataFrame, idf: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """``id_col``, node (md5 of the text), bands and signature; the last two are null for texts without words."""
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bands, signature = [], []
            for group in text_groups(((None, t) for t in values(batch.column(2)))):
                hashes, times, starts = vectors([t for _, t in group])
                full = np.flatnonzero(np.diff(starts))
                made: list = [None] * len(group)
                keys: list = [None] * len(group)
                if len(full):
                    rows = signatures(hashes, weigh(hashes, times, shared.value), starts[full])
                    band = np.zeros((len(full), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
                    for k in range(ROWS):
                        band = stir(band ^ rows[:, k::ROWS].astype(np.uint64))
                    for i, row, key in zip(full, rows, band.view(np.int64), strict=True):
                        made[i], keys[i] = row.tobytes(), key
                bands += keys
                signature += made
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bands, pa.list_(pa.int64())), pa.array(signature, pa.binary())], names=[id_col, "node", "bands", "signature"])

    rows = docs.select(id_col, F.unhex(F.md5(F.coalesce(text_col, F.lit("")))).alias("node"), F.coalesce(text_col, F.lit("")).alias("text"))
    return map_batches(rows, run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, node binary, bands array<bigint>, signature binary")


@F.pandas_udf(IntegerType())
def agreement(a: pd.Series, b: pd.Series) -> pd.Series:
    """In how many samples two signatures agree."""
    left, right = (np.frombuffer(b"".join(x), np.uint32).reshape(-1, HASHES) for x in (a, b))
    return pd.Series((left == right).sum(1).astype(np.int32))


def _refined(signature: Column) -> Column:
    """Keys by which a large bucket is dealt out: single samples, spread over the bands."""
    return F.array(*[F.xxhash64(F.lit(j), F.substring(signature, 1 + 4 * j, 4)) for j in range(0, HASHES, HASHES // REFINE)])


def _sized(rows: DataFrame) -> DataFrame:
    """``rows`` of key and node with the size of their key's group, groups of one left out."""
    return rows.join(rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "key")


def _all_pairs(groups: DataFrame) -> DataFrame:
    """Agreeing pairs inside groups of at most SMALL nodes."""

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for members in values(batch.column(0), 50):
                members.sort(key=lambda m: m["node"])
                rows = np.frombuffer(b"".join(m["signature"] for m in members), np.uint32).reshape(-1, HASHES)
                for i in range(len(members) - 1):
                    for k in np.flatnonzero((rows[i + 1 :] == rows[i]).sum(1) >= AGREE):
                        a.append(members[i]["node"])
                        b.append(members[i + 1 + k]["node"])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    gathered = groups.groupBy("key").agg(F.collect_list(F.struct("node", "signature")).alias("members"))
    return map_batches(gathered.select("members"), pair, "a binary, b binary")


def candidate_pairs(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs (a, b) of nodes, a < b, that share a bucket and whose signatures agree enough; and the nodes of buckets above SMALL, of which only pairs with a centre are given."""
    rows = nodes.where("bands is not null").select("node", F.explode("bands").alias("key"))
    shared = materialise(_sized(rows), "dedup-buckets")
    hit = shared.join(nodes.select("node", "signature"), "node")
    small = _all_pairs(hit.where(F.col("size") <= SMALL))
    again = hit.where(F.col("size") > SMALL).select("node", "signature", F.explode(F.transform(_refined(F.col("signature")), lambda k: F.xxhash64("key", k))).alias("key"))
    large = materialise(again, "dedup-large")
    sized = large.join(large.groupBy("key").agg(F.count("*").alias("size"), F.min(F.struct(F.xxhash64("key", "node").alias("by"), "node", "signature")).alias("centre")).where("size > 1"), "key")
    star = sized.where(F.col("node") != F.col("centre.node"))
    spoke = star.where(agreement("signature", "centre.signature") >= AGREE).select(F.col("centre.node").alias("a"), F.col("node").alias("b"))
    spoke = spoke.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return small.unionByName(spoke).distinct(), large.select("node").distinct()


def prefix(weights: np.ndarray, rarity: np.ndarray, hashes: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Places of a text's rarest shingles, of which any text as alike as ``similarity`` shares one, the weight from each on in order of rarity, and the text's weight.

    Let e be the first shingle, rarest first, that two texts share. What they share comes at or after e in both, so it
    weighs no more than the rest from e on, and it weighs at least ``similarity`` of either text.
    """
    order = np.lexsort((hashes, -rarity))
    ordered = weights[order].astype(np.float64)
    total = float(ordered.sum())
    rest = total - np.concatenate([[0.0], np.cumsum(ordered)[:-1]])
    n = int(np.count_nonzero(rest >= similarity * total * (1 - 1e-6)))
    return order[:n], rest[:n], total


def prefixes(texts: DataFrame, idf: np.ndarray, similarity: float) -> DataFrame:
    """key, node, total and rest for each shingle in the prefix of each of ``texts`` (node, text)."""
    shared = texts.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for group in text_groups((None, t) for t in values(batch.column(1))):
                hashes, times, starts = vectors([t for _, t in group])
                weights, rarity = weigh(hashes, times, shared.value), shared.value[df_slot(hashes)]
                keys, rests, totals, counts = [], [], [], []
                for i, j in zip(starts[:-1], starts[1:], strict=True):
                    found, rest, total = prefix(weights[i:j], rarity[i:j], hashes[i:j], similarity)
                    keys.append(hashes[i:j][found])
                    rests.append(rest)
                    totals.append(np.full(len(found), total))
                    counts.append(len(found))
                owner = pa.array(np.repeat(np.arange(at, at + len(group)), counts))
                columns = [pa.array(np.concatenate(keys).astype(np.int64)), batch.column(0).take(owner), pa.array(np.concatenate(totals)), pa.array(np.concatenate(rests))]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "node", "total", "rest"])
                at += len(group)

    return map_batches(texts.select("node", "text"), run, "key bigint, node binary, total double, rest double")


def exact_pairs(prefixed: DataFrame, labels: DataFrame, similarity: float, every: bool) -> DataFrame:
    """Pairs (a, b), a < b, of texts of different labels that can be as alike as ``similarity``, from their ``prefixes`` and labels (node, label bigint): all of them, or the likeliest one of each two labels."""
    rows = prefixed.join(labels, "node")
    several = rows.groupBy("key").agg(F.count("*").alias("size"), F.min("label").alias("least"), F.max("label").alias("most")).where("least != most").select("key", "size")
    blocks = F.ceil(F.col("size") / BLOCK)
    dealt = rows.join(several, "key").withColumn("own", F.pmod(F.xxhash64("node", "key"), blocks))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))
    cells = met.groupBy("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")).agg(F.collect_list(F.struct("node", "label", "total", "rest", "own")).alias("members"))
    bound = similarity / (1 + similarity) * (1 - 1e-6)

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in range(len(batch)):
                low, high = batch.column(0)[cell].as_py(), batch.column(1)[cell].as_py()
                members = batch.column(2)[cell].values.flatten()
                label, total, rest, own = (members[k].to_numpy() for k in (1, 2, 3, 4))
                a, b, scores = [], [], []
                for i in range(len(own) - 1) if low == high else np.flatnonzero(own == low):
                    rivals = slice(i + 1, None) if low == high else slice(None)
                    score = np.minimum(rest[rivals], rest[i]) / (total[rivals] + total[i])
                    ok = (label[rivals] != label[i]) & (score >= bound)
                    if low != high:
                        ok &= own == high
                    found = np.flatnonzero(ok)
                    score = score[found]
                    found += i + 1 if low == high else 0
                    if not every and len(found):
                        order = np.argsort(-score, kind="stable")
                        first = order[np.unique(label[found[order]], return_index=True)[1]]
                        found, score = found[first], score[first]
                    a.append(np.full(len(found), i))
                    b.append(found)
                    scores.append(score)
                if a:
                    x, y = (pa.array(np.concatenate(z)) for z in (a, b))
                    yield pa.RecordBatch.from_arrays([members[0].take(x), members[0].take(y), members[1].take(x), members[1].take(y), pa.array(np.concatenate(scores))], names=["a", "b", "label_a", "label_b", "score"])

    found = map_batches(cells.select("low", "high", "members"), pair, "a binary, b binary, label_a bigint, label_b bigint, score double")
    ordered = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.least("label_a", "label_b").alias("low"), F.greatest("label_a", "label_b").alias("high"), "score")
    if every:
        return ordered.select("a", "b").distinct()
    return ordered.groupBy("low", "high").agg(F.max_by(F.struct("a", "b"), F.struct("score", "a", "b")).alias("best")).select("best.a", "best.b").distinct()


def weighted_jaccard(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of least weights over sum of greatest, of two sorted shingle vectors."""
    _, i, k = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
    both = float(np.minimum(x[1][i], y[1][k]).sum(dtype=np.float64))
    total = float(x[1].sum(dtype=np.float64) + y[1].sum(dtype=np.float64)) - both
    return both / total if total else 0.0


def texts_of(wanted: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """node and text, once for each node of ``wanted``."""
    wanted = materialise(wanted, "dedup-wanted")
    if wanted.count() <= BROADCAST_ROWS:  # else an ordinary join
        wanted = F.broadcast(wanted)
    texts = docs.select(F.unhex(F.md5(F.coalesce(text_col, F.lit("")))).alias("node"), F.col(text_col).alias("text")).join(wanted, "node", "left_semi")
    return materialise(texts.dropDuplicates(["node"]), "dedup-texts")


def verify(pairs: DataFrame, texts: DataFrame, idf: np.ndarray, similarity: float) -> DataFrame:
    """The pairs whose whole texts have at least this weighted Jaccard similarity."""
    left, right = (texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
    shared = texts.sparkSession.sparkContext.broadcast(idf)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector = lru_cache(16)(lambda text: (lambda v: (v[0], weigh(v[0], v[1], shared.value)))(vectors([text])))
        for batch in batches:
            ok = [weighted_jaccard(vector(x), vector(y)) >= similarity for x, y in zip(values(batch.column(2), 50), values(batch.column(3), 50), strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return map_batches(joined, check, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """node, label for every node of ``links`` (a, b): the least node of its component.

    In each round every node takes the label of its least neighbour (or itself), and links between nodes of one label
    vanish: later rounds only join what is left between labels.
    """
    edges = materialise(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    placed = None
    while True:
        nearest = edges.select(F.col("a").alias("node"), "a").unionByName(edges.select(F.col("b").alias("node"), "a")).groupBy("node").agg(F.min("a").alias("label"))
        hooked = materialise(nearest, "labels")
        further = hooked.select(F.col("node").alias("label"), F.col("label").alias("further"))
        labels = materialise(hooked.join(further, "label").select("node", F.col("further").alias("label")), "labels")
        placed = labels if placed is None else materialise(relabel(placed, labels), "labels")
        left, right = (labels.select(F.col("node").alias(c), F.col("label").alias(f"label_{c}")) for c in "ab")
        between = edges.join(left, "a").join(right, "b").where("label_a != label_b")
        edges = materialise(between.select(F.least("label_a", "label_b").alias("a"), F.greatest("label_a", "label_b").alias("b")).distinct(), "links")
        if edges.isEmpty():
            return placed


def relabel(placed: DataFrame, labels: DataFrame) -> DataFrame:
    """``placed`` (node, label) with each label that is a node of ``labels`` replaced by that node's label."""
    further = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
    return placed.join(further, "label", "left").select("node", F.coalesce("further", "label").alias("label"))


def with_links(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, label) after more ``links`` (a, b), which may bring new nodes."""
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    every = materialise(labels.unionByName(ends.join(labels, "node", "left_anti").select("node", F.col("node").alias("label"))), "labels")
    left, right = (every.select(F.col("node").alias(c), F.col("label").alias(f"label_{c}")) for c in "ab")
    between = links.join(left, "a").join(right, "b").select(F.col("label_a").alias("a"), F.col("label_b").alias("b"))
    return materialise(relabel(every, components(between)), "labels")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``id_col``, node (digest of the text), class_id (the least id of its class), class_size (rows), n_texts (different texts) and kept for every row.

    ``kept`` marks the row of least (id, node) in its class, and its exact repetitions.

    Equal texts are always one class, so all null and empty texts are; other texts without any word are alike only
    if equal. Texts of fewer than five words have one shingle, all their words. Null ids stay null and a class whose
    ids are all null has a null class_id; repeated rows are repeated; an empty table gives an empty one; other
    columns are ignored.
    """
    idf = inverse_frequencies(docs, text_col)
    signed = materialise(sign(docs, idf, id_col, text_col), "dedup-signatures")
    nodes = materialise(signed.select("node", "bands", "signature").dropDuplicates(["node"]), "dedup-nodes")
    pairs, crowded = candidate_pairs(nodes)
    pairs, crowded = materialise(pairs, "dedup-pairs"), materialise(crowded, "dedup-crowded")
    texts = texts_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).unionByName(crowded).distinct(), docs, text_col)
    links = materialise(verify(pairs, texts, idf, similarity), "dedup-links")
    labels = components(links)
    if not crowded.isEmpty():
        prefixed = materialise(prefixes(texts.join(crowded, "node", "left_semi"), idf, similarity), "dedup-prefixes")
        for every in (False, True):  # one pair of each two classes joins most of them; then all that are left
            labelled = crowded.join(labels, "node", "left").select("node", F.xxhash64(F.coalesce("label", "node")).alias("label"))
            more = materialise(exact_pairs(prefixed, labelled, similarity, every), "dedup-exact")
            if more.isEmpty():
                break
            labels = with_links(labels, materialise(verify(more, texts, idf, similarity), "dedup-links"))
    counted = signed.groupBy("node").agg(F.min(F.struct(F.col(id_col).isNull().alias("no"), F.col(id_col).alias("id"), "node")).alias("least"), F.count("*").alias("rows"))
    placed = counted.join(labels, "node", "left").withColumn("class", F.coalesce("label", "node"))
    whole = placed.where("label is not null or rows > 1").groupBy("class").agg(F.min("least").alias("least"), F.sum("rows").alias("class_size"), F.count("*").alias("n_texts"))
    table = placed.where("label is not null or rows > 1").drop("least").join(whole, "class").select("node", "least", "class_size", "n_texts")
    joined = signed.select(id_col, "node").join(table, "node", "left")
    single = F.col("class_size").isNull()
    return joined.select(
        id_col,
        "node",
        F.when(single, F.col(id_col)).otherwise(F.col("least.id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).alias("class_size"),
        F.coalesce("n_texts", F.lit(1)).alias("n_texts"),
        (single | (F.col(id_col).eqNullSafe(F.col("least.id")) & (F.col("node") == F.col("least.node")))).alias("kept"),
    )


def _by_row(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str, how: str) -> DataFrame:
    """``docs`` semi- or anti-joined with ``rows`` of (id, node), broadcast if few."""
    row_id, row_node = unused(docs, "row_id", "row_node")
    rows = materialise(rows.select(F.col(id_col).alias(row_id), F.col("node").alias(row_node)), "dedup-rows")
    if rows.count() <= BROADCAST_ROWS:
        rows = F.broadcast(rows)
    own = F.unhex(F.md5(F.coalesce(text_col, F.lit(""))))
    return docs.join(rows, F.col(id_col).eqNullSafe(F.col(row_id)) & (own == F.col(row_node)), how)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``docs``, all columns, whatever their names, with one row of each near-duplicate class: the one of least id (then digest of the text)."""
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = materialise(near_duplicates(plain, "id", "text", similarity).withColumnRenamed("id", id_col), "dedup-classes")
    kept = _by_row(docs, found.where("not kept").select(id_col, "node").distinct(), id_col, text_col, "left_anti")
    repeated = found.where("kept").groupBy(id_col, "node").count().where("count > 1")
    if repeated.isEmpty():
        return kept
    (node,) = unused(docs, "node")
    once = _by_row(kept, repeated, id_col, text_col, "left_semi").withColumn(node, F.md5(F.coalesce(text_col, F.lit("")))).dropDuplicates([id_col, node])
    return _by_row(kept, repeated, id_col, text_col, "left_anti").unionByName(once.select(docs.columns))
