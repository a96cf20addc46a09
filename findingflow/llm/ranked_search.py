"""The best documents for each of a set of queries, scored once per class of equal bags.

1. Items are taken in blocks of about ``BLOCK`` (item, term) pairs. A block's vocabulary is what its items name.
2. One scan restricts every document to that vocabulary: its length and a sorted vector of (term, times).
3. Documents with the same vector and the same length factor ``m`` score alike for every item. They form a class:
   vectors meet by a 64-bit hash and are verified by comparing them whole. Each class keeps its ``k`` least ids, which
   is all that a list of ``k`` can use.
4. Every class is scored once against all items of the block; a task passes on its ``k`` best classes per item.
5. The ``k`` best classes of each item are expanded to their members by ascending id.

Only the items, their vocabulary and its document frequencies reach the driver, one bounded block at a time.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import map_batches, materialise, values

BLOCK = 500_000
PIECE = 1 << 20  # bytes of a text split at once
CELLS = 2_000_000  # scores or contributions held at once
EXACT = 1 << 53
#: Every byte that is part of a term stays, A-Z in lower case; all others separate.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def term_runs(text: bytes) -> Iterator[list[bytes]]:
    """All terms of a UTF-8 text in order, about PIECE bytes at a time."""
    text, at = text.translate(TERM_BYTES), 0
    while at < len(text):
        to = text.find(b" ", at + PIECE)
        to = len(text) if to < 0 else to
        yield text[at:to].split()
        at = to


def bag(text: bytes, vocabulary: dict[bytes, int]) -> tuple[int, list[int], list[int]]:
    """Terms of the whole text with repeats, and the numbers of those in the vocabulary, ascending, with how often each occurs."""
    n, seen = 0, Counter()
    for words in term_runs(text):
        n += len(words)
        counted = Counter(words)
        for w in counted.keys() & vocabulary.keys():
            seen[vocabulary[w]] += counted[w]
    terms = sorted(seen)
    return n, terms, [seen[t] for t in terms]


def item_blocks(items: DataFrame, item_col: str, text_col: str) -> tuple[DataFrame, Iterator[list[tuple[int, list[bytes]]]]]:
    """The items (number, ``item_col``), and lists of (number, distinct terms) of about BLOCK terms each."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [sorted({w for words in term_runs(t or b"") for w in words}) for t in values(batch.column(1).cast(pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.binary()))], names=["id", "terms"])

    rows = items.select(F.col(item_col).alias("id"), F.col(text_col).cast("string").alias("text")).distinct()
    kind = rows.schema["id"].dataType.simpleString()
    found = materialise(map_batches(rows, split, f"id {kind}, terms array<binary>").where("size(terms) > 0").withColumn("item", F.monotonically_increasing_id()), "search-items")
    blocks = -(-found.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0] // BLOCK)

    def take() -> Iterator[list[tuple[int, list[bytes]]]]:
        for k in range(blocks):
            part = found.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k).select("item", "terms").collect()
            if part:
                yield [(r.item, [bytes(t) for t in r.terms]) for r in part]

    return found.select("item", F.col("id").alias(item_col)), take()


def restrict(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Every document (id, text) as id, n (all its terms), terms and times (those of the vocabulary)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [bag(t or b"", shared.value) for t in values(batch.column(1).cast(pa.binary()), 50)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n for n, _, _ in made], pa.int64()), pa.array([t for _, t, _ in made], pa.list_(pa.int32())), pa.array([c for _, _, c in made], pa.list_(pa.int64()))],
                names=["id", "n", "terms", "times"],
            )

    return map_batches(docs, count, f"id {docs.schema['id'].dataType.simpleString()}, n bigint, terms array<int>, times array<bigint>")


def bag_classes(bags: DataFrame, documents: int, length: int, k: int) -> DataFrame:
    """Classes of documents that no item can tell apart: m, terms, times and members, the ``k`` least ids ascending (null last)."""
    m = F.expr(f"100 - 90 + (90 * n * {documents}) div {max(length, 1)}").cast("bigint")
    keys = ["hash", "m", "terms", "times"]
    hashed = bags.where("size(terms) > 0").withColumn("m", m).withColumn("hash", F.xxhash64("m", "terms", "times")).withColumn("member", F.struct(F.col("id").isNull().alias("none"), "id"))
    ranked = hashed.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("member"))).where(F.col("rank") <= k)
    return ranked.groupBy(*keys).agg(F.sort_array(F.collect_list("member")).alias("members")).drop("hash")


class Postings:
    """Which items hold each term, and the terms' weights."""

    def __init__(self, items: list[tuple[int, list[bytes]]], vocabulary: dict[bytes, int]):
        self.numbers = np.array([n for n, _ in items], np.int64)
        pairs = np.array([(vocabulary[t], i) for i, (_, terms) in enumerate(items) for t in terms], np.int64).reshape(-1, 2)
        self.items = pairs[np.argsort(pairs[:, 0], kind="stable"), 1]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(pairs[:, 0], minlength=len(vocabulary)))])
        self.longest = max(len(terms) for _, terms in items)
        self.weights = np.zeros(len(vocabulary), np.int64)

    def scores(self, m: np.ndarray, starts: np.ndarray, terms: np.ndarray, times: np.ndarray) -> np.ndarray:
        """A row of item scores for each bag."""
        size = (len(m), len(self.numbers))
        bags = np.repeat(np.arange(len(m)), np.diff(starts))
        each = self.weights[terms] * ((1_000_000_000 * times) // (1000 * times + 8 * m[bags]))
        held = self.starts[terms + 1] - self.starts[terms]
        before = np.cumsum(held) - held
        at = np.arange(int(held.sum())) - np.repeat(before - self.starts[terms], held)
        cell = np.repeat(bags * size[1], held) + self.items[at]
        if self.longest * int(self.weights.max(initial=0)) * 1_000_000 < EXACT:  # then sums of doubles are exact
            return np.bincount(cell, np.repeat(each, held), size[0] * size[1]).astype(np.int64).reshape(size)
        out = np.zeros(size[0] * size[1], np.int64)
        np.add.at(out, cell, np.repeat(each, held))
        return out.reshape(size)

    def runs(self, starts: np.ndarray, terms: np.ndarray) -> Iterator[tuple[int, int]]:
        """Ranges of bags whose scores and contributions number about CELLS."""
        work = np.concatenate([[0], np.cumsum(self.starts[terms + 1] - self.starts[terms])])[starts] + np.arange(len(starts)) * len(self.numbers)
        at = 0
        while at < len(starts) - 1:
            to = max(at + 1, int(np.searchsorted(work, work[at] + CELLS, "right")) - 1)
            yield at, to
            at = to


def score_classes(classes: DataFrame, postings: Postings, k: int) -> DataFrame:
    """item, score and members of the ``k`` best classes of each item in each task, equal scores by the first member."""
    shared = classes.sparkSession.sparkContext.broadcast(postings)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        best: list[list[tuple]] = [[] for _ in own.numbers]  # (-score, first member, members)
        least = np.ones(len(best), np.int64)
        for batch in batches:
            m = batch.column(0).to_numpy()
            lists = batch.column(1)
            starts = lists.offsets.to_numpy().astype(np.int64)
            terms, times = (c.values.to_numpy()[c.offsets[0].as_py() : c.offsets[-1].as_py()].astype(np.int64) for c in (lists, batch.column(2)))
            starts = starts - starts[0]
            for a, b in own.runs(starts, terms):
                inside = slice(starts[a], starts[b])
                found = own.scores(m[a:b], starts[a : b + 1] - starts[a], terms[inside], times[inside])
                for i in np.flatnonzero((found >= least).any(axis=0)):
                    column = found[:, i]
                    rows = np.flatnonzero(column >= least[i])
                    if len(rows) > k:
                        rows = rows[column[rows] >= np.partition(column[rows], -k)[-k]]
                    more = []
                    for r in rows:
                        members = [(x["none"], x["id"]) for x in batch.column(3)[a + int(r)].as_py()]
                        more.append((-int(column[r]), members[0], members))
                    best[i] = sorted(best[i] + more, key=lambda x: (x[0], x[1][0], x[1][1] if not x[1][0] else 0))[:k]
                    if len(best[i]) == k:
                        least[i] = -best[i][-1][0]
        rows = [(i, x) for i, found in enumerate(best) for x in found]
        yield pa.RecordBatch.from_arrays(
            [pa.array(own.numbers[[i for i, _ in rows]]), pa.array([-x[0] for _, x in rows], pa.int64()), pa.array([[{"none": n, "id": d} for n, d in x[2]] for _, x in rows], members_type)],
            names=["item", "score", "members"],
        )

    kind = classes.schema["members"].dataType.simpleString()
    from pyspark.sql.pandas.types import to_arrow_type

    members_type = to_arrow_type(classes.schema["members"].dataType)
    return map_batches(classes.select("m", "terms", "times", "members"), score, f"item bigint, score bigint, members {kind}")


def top_documents(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``item_col``, rank (from 1), ``id_col`` and score (above 0) of the ``k`` best documents of each item; equal scores by ascending id, null ids last.

    A null or empty text has no term and is found by nothing; such an item finds nothing. Repeated documents count and
    are ranked as often as they occur; an item (id and text) that is repeated is ranked once, and two texts of one
    item id each get a list. Empty tables give an empty result; other columns are ignored.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    names, blocks = item_blocks(items, item_col, item_text_col)
    out = None
    for block in blocks:
        vocabulary = {t: i for i, t in enumerate(sorted({t for _, terms in block for t in terms}))}
        bags = materialise(restrict(texts, vocabulary), "search-bags")
        documents, length = bags.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        postings = Postings(block, vocabulary)
        frequencies = bags.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()  # at most one row per term of the block
        for term, df in zip(frequencies["term"].to_pylist(), frequencies["count"].to_pylist(), strict=True):
            postings.weights[term] = math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))
        classes = materialise(bag_classes(bags, documents, length, k), "search-classes")
        scored = score_classes(classes, postings, k)
        best = scored.withColumn("place", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("members")[0]))).where(F.col("place") <= k)
        expanded = best.select("item", "score", F.explode("members").alias("member"))
        ranked = expanded.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "member"))).where(F.col("rank") <= k)
        found = ranked.select("item", "rank", F.col("member.id").alias(id_col), "score")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return docs.select(id_col).limit(0).join(items.select(item_col).limit(0), F.lit(True)).select(item_col, F.lit(0).alias("rank"), id_col, F.lit(0).cast("bigint").alias("score"))
    return out.join(names, "item").select(item_col, "rank", id_col, "score")


#: The same result in DuckDB SQL, for ten documents an item.
SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row_no, doc_id, terms, len(terms) AS n
  FROM (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents)
  WHERE len(terms) > 0),
stats AS (SELECT count(*) AS total, sum(n)::BIGINT AS length FROM docs),
wanted AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
tf AS (
  SELECT row_no, term, count(*) AS tf FROM (SELECT row_no, unnest(terms) AS term FROM docs) WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(total) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, stats GROUP BY term),
scored AS (
  SELECT item_id, row_no, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * total) // length))))::BIGINT AS score
  FROM wanted JOIN weights USING (term) JOIN tf USING (term) JOIN docs USING (row_no), stats GROUP BY ALL),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST, row_no)::INT AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
