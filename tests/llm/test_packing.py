import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from findingflow.llm.packing import Plan, best_fit, pack, plan_sequences, reduce_by_dominance

PATH = public_tokenizers.path("word_bpe_49k.json")


def fewest(lengths, capacity):
    """Brute force: the least number of sequences."""
    best, bins = len(lengths), []
    lengths = sorted(lengths, reverse=True)

    def go(i):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + lengths[i] <= capacity and bins[b] not in bins[:b]:
                bins[b] += lengths[i]
                go(i + 1)
                bins[b] -= lengths[i]
        bins.append(lengths[i])
        go(i + 1)
        bins.pop()

    go(0)
    return best


def sequences(plan):
    out = defaultdict(list)
    for length, lo, hi, first, offset in plan.ranges:
        for k in range(hi - lo):
            out[first + k].append((offset, length))
    return out


def test_plans_are_feasible_and_near_the_optimum():
    rng = random.Random(5)
    for _ in range(150):
        capacity = rng.choice([10, 20, 60])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(1, 11))]
        plan = plan_sequences(Counter(lengths), capacity)
        got = sequences(plan)
        assert sorted(x for s in got.values() for _, x in s) == sorted(lengths)
        for s in got.values():
            at = 0
            for offset, length in sorted(s):
                assert offset == at
                at += length
            assert at <= capacity
        assert plan.sequences == len(got) <= fewest(lengths, capacity) + 1


def test_reduction_keeps_an_optimum():
    rng = random.Random(6)
    for _ in range(300):
        capacity = rng.choice([10, 21, 50])
        lengths = [rng.randint(2, capacity) for _ in range(rng.randint(1, 10))]
        plan = Plan(Counter(lengths), capacity)
        reduce_by_dominance(plan)
        rest = [n for n, c in plan.left.items() for _ in range(c)]
        assert plan.fixed + fewest(rest, capacity) == fewest(lengths, capacity), lengths


def test_dominating_sets_are_fixed_in_bulk():
    for histogram in ({2000: 10**9, 1000: 10**9}, {2048: 10**9, 1024: 3 * 10**9, 2047: 5}, {1500: 10**9, 1298: 10**9, 1300: 10**9}, {3000: 10**9, 500: 10**9, 596: 10**9}):
        plan = plan_sequences(dict(histogram), 4096)
        assert len(plan.ranges) < 200
        placed = Counter()
        for length, lo, hi, _, _ in plan.ranges:
            placed[length] += hi - lo
        assert placed == histogram and plan.sequences >= -(-sum(n * c for n, c in histogram.items()) // 4096)


def test_best_fit_on_large_classes():
    plan = Plan({4096: 3, 3000: 1000, 1000: 2500, 96: 700, 1: 100_000}, 4096)
    best_fit(plan)
    filled = Counter()
    for length, lo, hi, first, _ in plan.ranges:
        for k in range(first, first + hi - lo):
            filled[k] += length
    assert max(filled.values()) <= 4096 and len(filled) == plan.sequences and not plan.left


def test_pieces_carry_the_library_ids(spark):
    t = Tokenizer.from_file(PATH)
    texts = [None, "", "Hello World it's 12x", "a" * 30 + " <|endoftext|> b", "wörter und ñandú " * 2500, "x\x1cy　z", "é ́ İI", "the"] + ["the"] * 50
    df = spark.createDataFrame([(i, x, 1) for i, x in enumerate(texts)], "doc_id long, text string, sequence_id int").repartition(3)
    got = pack(df, PATH).collect()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    for i, x in enumerate(texts):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
        pieces = sorted(by[i], key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(-(-len(ids) // 4096)))
        for r in pieces:
            part = ids[r.start : r.start + r.length]
            assert len(part) == r.length and zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
        assert all(r.length == 4096 for r in pieces[:-1])
    seq = defaultdict(list)
    for r in got:
        seq[r.sequence_id].append((r.offset, r.length))
    for s in seq.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 4096


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
