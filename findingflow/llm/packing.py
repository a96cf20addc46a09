"""Best-fit packing of token sequences, after Martello and Toth's dominance reduction.

Only the histogram of piece lengths (at most ``max_tokens`` rows, whatever the corpus) reaches the driver. There the
reduction fixes sets of lengths that dominate every alternative, best-fit decreasing packs the rest, both on whole
classes of equal lengths, and the outcome is a table of ranges: "pieces k0..k1 of length l go to sequences
s.. at this offset". Sets are fixed in bulk, so the number of ranges follows that of lengths and not the corpus
(some 37,000 for a log-normal histogram of 4096 lengths, whatever its counts). Pieces are numbered within their length by the place
of their input partition plus their place in it, so no key, however hot, is sorted in one task.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ._common import Memo, caches, map_batches, materialise, slices
from .token_counts import PLAIN, byte_alphabet, byte_shower

_loaded: dict[int, Memo] = {}
TOGETHER = 8_000_000  # bytes of text whose words are looked up together
MARKS = ",.;:!?"
MARK_OF = np.full(256, len(MARKS))
MARK_OF[list(MARKS.encode())] = range(len(MARKS))
ALNUM = np.array([chr(b).isascii() and chr(b).isalnum() for b in range(256)])
# Fixed value: the pre-token pattern of the tokenizer file handled here, which drops white space and ignores case.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Plan:
    """Sequences under construction, as ranges of equal sequences."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.capacity, self.left = capacity, {n: c for n, c in histogram.items() if c > 0}
        self.taken = dict.fromkeys(self.left, 0)
        self.sequences, self.fixed = 0, 0
        self.ranges: list[tuple[int, int, int, int, int]] = []  # length, first rank, past the last rank, first sequence, offset

    def put(self, length: int, n: int, sequence: int, offset: int) -> None:
        """The next ``n`` pieces of this length, one each into ``n`` sequences."""
        k = self.taken[length]
        self.ranges.append((length, k, k + n, sequence, offset))
        self.taken[length] = k + n
        self.left[length] -= n
        if not self.left[length]:
            del self.left[length]

    def fix(self, lengths: tuple[int, ...], n: int) -> None:
        """``n`` finished sequences that each hold these lengths."""
        offset = 0
        for length in lengths:
            self.put(length, n, self.sequences, offset)
            offset += length
        self.sequences += n
        self.fixed += n


def reduce_by_dominance(plan: Plan) -> None:
    """Fix every set that provably dominates all others holding its largest piece, until none is left.

    A set S with largest piece j dominates if whatever else could share a sequence with j can be swapped for the
    other pieces of S. That holds if j fits with nothing; if j and k fill the sequence exactly; if j fits with one
    more piece at most, for the largest such k; and if j fits with two more at most, for k again when k is no
    smaller than the best fitting pair, or for that pair when it fills the sequence. What is left afterwards only gets
    scarcer, so a set goes on dominating until one of its lengths runs out: all copies are fixed at once.
    """
    capacity, changed = plan.capacity, True
    while changed:
        changed = False
        for j in sorted(plan.left, reverse=True):
            while j in plan.left:
                lengths = sorted(plan.left)
                smallest = []
                for x in lengths:  # the three smallest pieces other than one j
                    smallest += [x] * min(3 - len(smallest), plan.left[x] - (x == j))
                    if len(smallest) == 3:
                        break
                if not smallest or j + smallest[0] > capacity:
                    plan.fix((j,), plan.left[j])
                    changed = True
                    continue
                at = bisect_left(lengths, capacity - j + 1) - 1
                if lengths[at] == j and plan.left[j] < 2:
                    at -= 1
                k = lengths[at]
                pairs = plan.left[j] // 2 if k == j else min(plan.left[j], plan.left[k])
                if j + k == capacity:
                    plan.fix((j, k), pairs)
                    changed = True
                    continue
                if len(smallest) < 2 or j + smallest[0] + smallest[1] > capacity:
                    plan.fix((j, k), pairs)
                    changed = True
                    continue
                if len(smallest) < 3 or j + sum(smallest) > capacity:
                    a, b = best_pair(plan, lengths, j)
                    if k >= a + b:
                        plan.fix((j, k), pairs)
                    elif j + a + b == capacity:
                        plan.fix((j, a, b), min(plan.left[x] // (j, a, b).count(x) for x in (j, a, b)))
                    else:
                        break
                    changed = True
                    continue
                break


def best_pair(plan: Plan, lengths: list[int], j: int) -> tuple[int, int]:
    """The two pieces with the largest sum that still fit with j."""
    best = (0, 0)
    for a in lengths:
        for b in (lengths[i] for i in range(bisect_left(lengths, plan.capacity - j - a + 1) - 1, -1, -1)):
            if b < a or a + b <= sum(best):
                break
            if all(plan.left[x] >= (a, b, j).count(x) for x in (a, b)):
                best = (a, b)
                break
    return best


def best_fit(plan: Plan) -> None:
    """Best-fit decreasing over whole classes: each length fills the tightest sequences first, then opens new ones."""
    room: dict[int, list[tuple[int, int]]] = {}
    gaps: list[int] = []

    def leave(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in room:
                room[gap] = []
                insort(gaps, gap)
            room[gap].append((first, n))

    for length in sorted(plan.left, reverse=True):
        while length in plan.left:
            at = bisect_left(gaps, length)
            if at < len(gaps):
                gap = gaps[at]
                first, n = room[gap].pop()
                if not room[gap]:
                    del room[gap], gaps[at]
            else:
                gap, first = plan.capacity, plan.sequences
                n = -(-plan.left[length] // (gap // length))
                plan.sequences += n
            each = gap // length
            full = min(n, plan.left[length] // each)
            for i in range(each if full else 0):
                plan.put(length, full, first, plan.capacity - gap + i * length)
            leave(gap - each * length, first, full)
            if full < n:
                more = plan.left.get(length, 0)
                for i in range(more):
                    plan.put(length, 1, first + full, plan.capacity - gap + i * length)
                leave(gap - more * length, first + full, 1 if more else 0)
                leave(gap, first + full + bool(more), n - full - bool(more))


def plan_sequences(histogram: dict[int, int], capacity: int) -> Plan:
    """Pack ``histogram`` (length to count) into as few sequences as dominance and best fit give."""
    plan = Plan(histogram, capacity)
    reduce_by_dominance(plan)
    best_fit(plan)
    return plan


def _encoder(spec: str) -> Memo:
    """Per worker: a memo from word to its ids, as bytes."""
    key = hash(spec)
    if key not in _loaded:
        tokenizer = Tokenizer.from_str(spec)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        pre_tokens, merge, show = regex.compile(PRE_TOKEN).findall, tokenizer.model.tokenize, byte_shower(byte_alphabet())
        special = re.compile("|".join(re.escape(t.content) for t in tokenizer.get_added_tokens_decoder().values()) or "(?!)")

        def ids(word: str) -> bytes:
            if word.isascii() and word.isalpha():
                found = [t.id for t in merge(word.lower())]
            elif PLAIN.fullmatch(word) and not special.search(word):
                found = [t.id for p in pre_tokens(word.lower()) for t in merge(show(p))]
            else:
                found = tokenizer.encode(word, add_special_tokens=False).ids
            return array("I", found).tobytes()

        _loaded[key] = Memo(ids, limit=150_000)
        caches.append(_loaded[key])
    return _loaded[key]


def gather(sizes: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the values of ``runs`` of a pool whose runs have these sizes, and where each run then begins (with the end appended)."""
    ends, own = np.cumsum(sizes), sizes[runs]
    begins = np.concatenate([[0], np.cumsum(own)])
    places = np.repeat((ends[runs] - own - begins[:-1]).astype(np.int32), own)
    places += np.arange(begins[-1], dtype=np.int32)
    return places, begins


def ends_in_mark(words: pa.Array) -> np.ndarray:
    """Which of MARKS stands at the end of each word, right after a letter or digit of ASCII, where a pre-token ends; else len(MARKS)."""
    kinds = np.full(len(words), len(MARKS))
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    long = np.flatnonzero(np.diff(ends) > 1)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    kinds[long] = np.where(ALNUM[data[ends[long + 1] - 2]], MARK_OF[data[ends[long + 1] - 1]], len(MARKS))
    return kinds


def encode_texts(texts: pa.Array, of: Memo) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, and where each text begins (with the end appended). Each different word, less the mark at its end, is looked up once."""
    split = pc.ascii_split_whitespace(texts)
    begins = split.offsets.to_numpy() - split.offsets[0].as_py()
    coded = split.flatten().dictionary_encode()
    words, mark = coded.dictionary, ends_in_mark(coded.dictionary)
    bare = pc.if_else(pa.array(mark < len(MARKS)), pc.binary_slice(words.cast(pa.binary()), 0, -1), words.cast(pa.binary())).dictionary_encode()
    each = [*map(of.__getitem__, bare.dictionary.cast(pa.string()).to_pylist()), *map(of.__getitem__, MARKS), b""]
    sizes, pool = np.fromiter(map(len, each), np.int64, len(each)) // 4, np.frombuffer(b"".join(each), "<u4")
    halves = np.stack([bare.indices.to_numpy(), len(bare.dictionary) + mark], 1).ravel()
    places, parts = gather(sizes, halves)
    of_words, total = gather(np.diff(parts[::2]), coded.indices.to_numpy())
    return pool[places][of_words], total[begins]


def cut_pieces(docs: DataFrame, tokenizer_path: str, max_tokens: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise whole texts, append ``end_id``, and cut only what exceeds ``max_tokens``.

    Gives ``id_col``, piece, start, length, ids_crc32, and the piece's place: ``part`` and ``rank`` within its length
    there. The tokenizer must drop white space and split as ``PRE_TOKEN`` does, so that the different words of a few
    megabytes of text are merged once; words beyond Latin-1, and those that hold a special token's string, are
    encoded by the library. A null text counts as empty: one piece, ``end_id``.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, seen, part = _encoder(shared.value), [0] * (max_tokens + 1), TaskContext.get().partitionId()
        for batch in batches:
            for group in slices(batch, 1, TOGETHER):
                ids, begins = encode_texts(pc.fill_null(group.column(1).cast(pa.string()), ""), of)
                rows, out = [], ([], [], [], [], [])
                for row, (a, b) in enumerate(zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)):
                    own = ids[a:b].tobytes() + end
                    n = b - a + 1
                    for piece, start in enumerate(range(0, n, max_tokens)):
                        length = min(max_tokens, n - start)
                        rows.append(row)
                        for column, value in zip(out, (piece, start, length, zlib.crc32(own[4 * start : 4 * (start + length)]), seen[length]), strict=True):
                            column.append(value)
                        seen[length] += 1
                arrays = [group.column(0).take(pa.array(rows, pa.int64())), *map(pa.array, out, [pa.int32(), *[pa.int64()] * 4])]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array([part] * len(rows), pa.int32())], names=names)

    rows = docs.select(id_col, text_col)
    names = [id_col, "piece", "start", "length", "ids_crc32", "rank", "part"]
    return map_batches(rows, cut, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint, rank bigint, part int")


def pack(docs: DataFrame, tokenizer_path: str, max_tokens: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece of every document with the sequence and offset it is packed at.

    Null and empty texts are one-token documents; repeated rows are packed each; null ids stay null; an empty table
    gives an empty one; columns other than the two named are ignored. Order within equal lengths is free, so ties
    may go to any sequence; the number of sequences depends on the lengths alone.
    """
    pieces = materialise(cut_pieces(docs, tokenizer_path, max_tokens, end_id, id_col, text_col), "pieces")
    counts = materialise(pieces.groupBy("length", "part").count(), "piece-counts")
    plan = plan_sequences({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}, max_tokens)
    table = np.array(sorted(plan.ranges) or np.empty((0, 5)), np.int64).reshape(-1, 5)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        t, shift = shared.value, 1 << 48  # ranks stay below 2**48
        at = np.searchsorted(t[:, 0] * shift + t[:, 1], length.to_numpy() * shift + rank.to_numpy(), side="right") - 1
        return pd.DataFrame({"sequence_id": t[at, 3] + rank.to_numpy() - t[at, 1], "offset": t[at, 4]})

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    placed = pieces.join(base, ["length", "part"]).withColumn("at", place("length", F.col("rank") + F.col("base")))
    return placed.select(id_col, "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset")
