"""Benchmark passages inside documents, by size-partitioned MinHash containment search.

Items are partitioned by their number of shingles, in powers of two. For a partition of items of up to u shingles a
document is seen as overlapping windows of 2u shingles, u apart, so an item lies whole inside a window of about its
own size and containment becomes a similarity that MinHash can see, however long the document is. A window's
signature is one-permutation MinHash: the least shingle hash in each of 2u bins. A window that shares a bin's minimum
with an item of the partition is a candidate; items of up to 8 shingles have a bin for every hash. Each candidate is
verified by exact containment: distinct shingles of the item that the whole document holds.

Items are taken in blocks of at most about ``BLOCK`` shingles, each broadcast and searched in one scan, so what a
task holds does not grow with the benchmark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import map_batches, materialise, text_groups, values
from ._words import shingles, stir, word_hashes

SIZE, CONTAINMENT = 5, 0.8
DIRECT = 8
BLOCK = 2_000_000
FILTER_BITS = 22


class Items:
    """One block of benchmark items: their shingles, and by partition the minima that candidates must share."""

    def __init__(self, items: list[np.ndarray]):
        self.items = items
        parts: dict[int, list[int]] = {}
        for i, hashes in enumerate(items):
            if len(hashes):
                parts.setdefault(max(DIRECT, 1 << (len(hashes) - 1).bit_length()), []).append(i)
        self.parts = {u: self.index(u, members) for u, members in parts.items()}

    def index(self, u: int, members: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted minima, the item of each, and a filter over their leading bits."""
        values, owners = [], []
        for i in members:
            minima = self.items[i] if u == DIRECT else bin_minima(self.items[i], np.zeros(len(self.items[i]), np.int64), 1, 2 * u)
            minima = minima[minima != NONE]
            values.append(minima)
            owners.append(np.full(len(minima), i))
        value, owner = np.concatenate(values), np.concatenate(owners)
        order = np.argsort(value, kind="stable")
        sieve = np.zeros(1 << FILTER_BITS, bool)
        sieve[(value >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
        return value[order], owner[order], sieve

    def search(self, texts: list[str]) -> list[tuple[int, int, int]]:
        """(text, item, shared shingles) of every pair with a candidate window."""
        hashes, begins = shingles(*word_hashes(texts), SIZE)
        if not len(hashes):
            return []
        counts = np.diff(begins)
        owner = np.repeat(np.arange(len(texts)), counts)
        found: set[tuple[int, int]] = set()
        for u, (value, item, sieve) in self.parts.items():
            if u == DIRECT:
                seen, at = hashes, owner
            else:
                seen, at = window_minima(hashes, owner, begins, u)
            hit = np.flatnonzero(sieve[(seen >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
            low, high = np.searchsorted(value, seen[hit]), np.searchsorted(value, seen[hit], "right")
            for h, a, b in zip(hit, low, high, strict=True):
                for k in range(a, b):
                    found.add((int(at[h]), int(item[k])))
        return [(t, i, int(np.isin(self.items[i], hashes[begins[t] : begins[t + 1]]).sum())) for t, i in sorted(found)]


NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def bin_minima(hashes: np.ndarray, block: np.ndarray, blocks: int, bins: int) -> np.ndarray:
    """The least hash in each bin of each block, NONE where there is none."""
    out = np.full(blocks * bins, NONE)
    where = (stir(hashes) >> np.uint64(64 - (bins.bit_length() - 1))).astype(np.int64)
    np.minimum.at(out, block * bins + where, hashes)
    return out


def window_minima(hashes: np.ndarray, owner: np.ndarray, begins: np.ndarray, u: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of all windows in a row, and the text of each value: minima of two neighbouring blocks of u shingles."""
    counts, bins = np.diff(begins), 2 * u
    blocks = -(-counts // u)
    first = np.concatenate([[0], np.cumsum(blocks)])
    block = first[owner] + (np.arange(len(hashes)) - begins[owner]) // u
    table = bin_minima(hashes, block, int(first[-1]), bins).reshape(-1, bins)
    text = np.repeat(np.arange(len(counts)), blocks)
    if len(text) > 1:
        together = np.flatnonzero(text[1:] == text[:-1])
        alone = np.flatnonzero(blocks[text] == 1)
        windows = np.concatenate([np.minimum(table[together], table[together + 1]), table[alone]])
        text = text[np.concatenate([together, alone])]
    else:
        windows = table
    return windows.ravel(), np.repeat(text, bins)


def _distinct(text: str) -> np.ndarray:
    return np.unique(shingles(*word_hashes([text]), SIZE)[0])


def benchmark_blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Items (id, distinct shingle hashes) in blocks of about BLOCK shingles; equal texts of one id once. Items without words are left out."""

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [_distinct(t or "") for t in values(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(m) for m in made], pa.int64()), pa.array([m.tobytes() for m in made], pa.binary())], names=["item", "n", "hashes"])

    rows = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).distinct()
    items = materialise(map_batches(rows, turn, f"item {rows.schema['item'].dataType.simpleString()}, n bigint, hashes binary").where("n > 0"), "benchmark")
    total = items.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    blocks = -(-total // BLOCK)
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("hashes"), F.lit(blocks)) == k).select("item", "hashes").collect()
        part.sort(key=lambda r: (r.item is not None, r.item, bytes(r.hashes)))
        if part:
            yield [r.item for r in part], [np.frombuffer(r.hashes, np.uint64) for r in part]


def _hits(texts: Iterator, shared: Items, least: float) -> Iterator[tuple[int, int, int]]:
    """(row, item, shared shingles) of contained items, for all texts of a batch."""
    base = 0
    for group in text_groups((None, t or "") for t in texts):
        for row, item, both in shared.search([t for _, t in group]):
            if both >= least * len(shared.items[item]):
                yield base + row, item, both
        base += len(group)


def find_contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", containment: float = CONTAINMENT
) -> DataFrame:
    """A row per document and benchmark item it contains: ids, n_item and n_shared (distinct shingles), containment.

    Shingles are five lower-case words. An item of one to four words has one shingle, all its words, and is found
    only in documents of exactly these words; an item or document without words matches nothing. Repeated rows of
    documents give repeated rows; null ids stay null; empty tables give an empty result; other columns are ignored.
    """
    rows = docs.select(id_col, text_col)
    item_type, id_type = benchmark.schema[item_col].dataType.simpleString(), rows.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, `{item_col}` {item_type}, n_item bigint, n_shared bigint, containment double"
    out = docs.sparkSession.createDataFrame([], schema)
    for names, hashes in benchmark_blocks(benchmark, item_col, item_text_col):
        shared = docs.sparkSession.sparkContext.broadcast((names, hashes))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, hashes = shared.value
            items = Items(hashes)
            for batch in batches:
                found = list(_hits(values(batch.column(1)), items, containment))
                sizes, both = np.array([len(hashes[i]) for _, i, _ in found], np.int64), np.array([n for _, _, n in found], np.int64)
                rows = batch.column(0).take(pa.array([r for r, _, _ in found], pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [rows, pa.array([names[i] for _, i, _ in found], item_arrow), pa.array(sizes), pa.array(both), pa.array(both / np.maximum(sizes, 1))],
                    names=[id_col, item_col, "n_item", "n_shared", "containment"],
                )

        item_arrow = pa.int64() if item_type == "bigint" else pa.int32() if item_type == "int" else pa.string()
        out = out.unionByName(map_batches(rows, search, schema))
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", containment: float = CONTAINMENT) -> DataFrame:
    """``docs``, all columns, without the documents that contain an item; documents without words stay."""
    at, schema = docs.columns.index(text_col), docs.schema
    for _, hashes in benchmark_blocks(benchmark, item_col, item_text_col):
        shared = docs.sparkSession.sparkContext.broadcast(hashes)

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = Items(shared.value)
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[row for row, _, _ in _hits(values(batch.column(at)), items, containment)]] = False
                yield batch.filter(pa.array(clean))

        docs = map_batches(docs, keep, schema)
    return docs
