import hashlib
import random
import re
import zlib

import pytest

from findingflow.llm import prefix_trie as module
from findingflow.llm.prefix_trie import prefix_trie, rank

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    turns = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            turns.setdefault(conv, []).append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in turns.items()}
    rebuilt = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = own.get(c - (c % 20 if c >= 0 else -(-c % 20)), [])[:h] + own[c][h:]
    members = {}
    for c, ts in rebuilt.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    out = []

    def walk(p):
        leaves, saved = (0 if p in children else 1), (len(members[p]) - 1) * (len(WORD.findall(p[-1][1])) if p else 0)
        for q in children.get(p, []):
            more = walk(q)
            leaves, saved = leaves + more[0], saved + more[1]
        ends = sorted(c for c in members[p] if len(rebuilt[c]) == len(p))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(children.get(p, [])), leaves, saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
        return leaves, saved

    if members:
        walk(())
    return sorted(map(str, out))


def conversations():
    rng = random.Random(8)
    rows = []
    for c in [*range(-25, 150), 10**12, 10**12 + 3]:
        first = rng.choice(["hot", "hot", "hot", "warm", f"own {c}"])
        for t in range(rng.choice([0, 1, 2, 3, 4, 5, 9])):
            text = first if t == 0 else rng.choice(["a b", " c\td ", "é f", "", None, f"own {c} {t}"]) if t < 3 or first != "hot" else "same every time"
            rows.append((c, rng.choice([t, t, t, None]) if t > 4 else t, rng.choice(["user", None]) if t == 3 else "user", text))
    rows += [(7, 0, "user", "twice"), (7, 0, "user", "twice"), (None, 0, "user", "nobody's"), (None, None, None, None), (40, None, "x", "y"), (41, 0, "us", "er"), (42, 0, "u", "ser")]
    rows += [(55, t, "user", f"long {t}") for t in range(70)] + [(56, t, "user", f"long {t}") for t in range(65)]
    return rows


@pytest.mark.parametrize(("span", "base", "bits"), [(1024, 50_000, 16), (4, 30, 2)])
def test_nodes_equal_brute_force(spark, monkeypatch, span, base, bits):
    monkeypatch.setattr(module, "SPAN", span)
    monkeypatch.setattr(module, "BASE", base)
    monkeypatch.setattr(module, "PIECE_BITS", bits)
    rows = conversations()
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, depth int, node string").repartition(3)
    found = prefix_trie(df).collect()
    assert sorted(str(tuple(r)[:8]) for r in found) == brute(rows)
    assert sorted(x for r in found for x in (r.enter_at, r.exit_at)) == list(range(2 * len(found)))
    for r in found:  # a subtree's arcs lie between its own
        assert (r.exit_at - r.enter_at + 1) // 2 == sum(r.enter_at <= x.enter_at <= r.exit_at for x in found)


def test_ranks_of_several_lists(spark):
    rng = random.Random(2)
    ids = rng.sample(range(10**6), 300)
    lists = [ids[:1], ids[1:3], ids[3:120], ids[120:]]
    rows = [(x, own[k + 1] if k + 1 < len(own) else None, 1, x % 7, x) for own in lists for k, x in enumerate(own)]
    df = spark.createDataFrame(rows, "id long, next long, steps long, leaves long, saved long").repartition(4)
    want = {x: (k, sum(y % 7 for y in own[:k]), sum(own[:k])) for own in lists for k, x in enumerate(own)}
    assert {r.id: (r.steps, r.leaves, r.saved) for r in rank(df, 10).collect()} == want


def test_empty_table_and_turnless_conversation(spark):
    df = spark.createDataFrame([(21, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    assert prefix_trie(df.limit(0)).collect() == []
    turnless = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 4 and c % 20)
    rows = [(turnless, 0, "user", "x")]
    assert [str(tuple(r)[:8]) for r in prefix_trie(spark.createDataFrame(rows, df.schema)).collect()] == brute(rows)
