"""What conversations share at their beginnings: the trie of their turns, measured by the Euler-tour technique.

1. Every turn gets its place in its conversation and the digest of its role and text. Conversations are rebuilt: a
   few opening turns come from another conversation.
2. A prefix of d turns has the key (d, XOR of d 64-bit pairs), each pair drawn from a turn's digest and place. Prefixes
   with one key are one node (two different ones share 128 bits by chance only). XOR needs no order of evaluation, so
   a conversation of any length is worked on in segments of ``SPAN`` turns.
3. Each node has an enter arc and an exit arc. A node's enter arc leads to that of its first child (or to its own exit
   arc), its exit arc to the enter arc of its next sibling (or to the exit arc of its parent): one list, the tour.
   Siblings are chained inside buckets of ``SPAN`` node numbers, then bucket by bucket.
4. The list is ranked by random-mate contraction: in each round an arc that draws heads takes in the next arc if that
   draws tails, with its weights. A quarter of the arcs go in each round; once at most ``BASE`` are left, one task
   walks them. Then the rounds are undone in reverse. Work is in proportion to the arcs.
5. Steps, leaves and savings are added up along the list, so every arc knows the sums before it. What a subtree holds is
   the difference between its exit and its enter arc.

Nothing but counts of rows and the root's number reaches the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import map_batches, materialise

SPAN = 1024
BASE = 50_000
PIECE_BITS = 16  # conversation ids that share all but these bits are spelled together
OPENING = 4  # a conversation takes crc32(id) mod OPENING turns from the one whose id is the last multiple of EVERY
EVERY = 20
WORD = r"[^\x20\x09-\x0D]+"
KEY = ["depth", "a", "b"]
SUMS = ["steps", "leaves", "saved"]


def opening(conv: Column) -> Column:
    """How many turns a conversation takes from another."""
    return F.crc32(conv.cast("string").cast("binary")) % OPENING


def placed_turns(conversations: DataFrame) -> DataFrame:
    """conv, pos (from 1, by turn, null first, then digest), digest and words of every turn."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    turn = F.col("turn").cast("bigint")
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv"),
        turn.alias("turn"),
        F.coalesce(F.floor(turn / SPAN), F.lit(-(1 << 62))).cast("bigint").alias("segment"),
        F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256).alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("words"),
    )
    inside = rows.withColumn("within", F.row_number().over(Window.partitionBy("conv", "segment").orderBy(F.asc_nulls_first("turn"), "digest")))
    sizes = rows.groupBy("conv", "segment").count()
    before = sizes.withColumn("before", F.sum("count").over(Window.partitionBy("conv").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1))).where("before > 0").drop("count")
    return inside.join(before, ["conv", "segment"], "left").select("conv", (F.coalesce("before", F.lit(0)) + F.col("within")).alias("pos"), "digest", "words")


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, depth, digest, words, last) of every turn of the rebuilt conversations; and the conversations (conv) that have none."""
    h = opening(F.col("conv"))
    donors = turns.where((F.col("conv") % EVERY == 0) & (F.col("pos") < OPENING))
    given = donors.groupBy("conv").agg(F.count("*").alias("given")).withColumnRenamed("conv", "donor")
    convs = turns.groupBy("conv").agg(F.count("*").alias("n")).withColumn("donor", F.col("conv") - F.col("conv") % EVERY).withColumn("h", h)
    convs = convs.join(given, "donor", "left").withColumn("k", F.least("h", F.coalesce("given", F.lit(0)))).select("conv", "donor", "n", "h", "k")
    convs = materialise(convs, "trie-conversations")
    own = turns.join(convs.where("n > h").drop("donor"), "conv").where("pos > h").select("conv", (F.col("k") + F.col("pos") - F.col("h")).alias("depth"), "digest", "words", (F.col("pos") == F.col("n")).alias("last"))
    taken = donors.withColumnRenamed("conv", "donor").join(convs.where("k > 0"), "donor").where("pos <= k").select("conv", F.col("pos").alias("depth"), "digest", "words", ((F.col("pos") == F.col("k")) & (F.col("n") <= F.col("h"))).alias("last"))
    return own.unionByName(taken), convs.where("k = 0 and n <= h").select("conv")


def prefixes(turns: DataFrame) -> DataFrame:
    """Each turn's conversation, the key of the prefix that it ends, the key (up_a, up_b) of the one before, words and last."""
    drawn = F.sha2(F.concat("digest", F.lit(":"), F.col("depth").cast("string")), 256)
    half = lambda at: F.conv(F.substring(drawn, at, 16), 16, -10).cast("bigint")
    rows = turns.select("conv", "depth", "words", "last", half(1).alias("x"), half(17).alias("y"), F.floor((F.col("depth") - 1) / SPAN).alias("segment"))
    running = Window.partitionBy("conv", "segment").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.withColumn("a", F.bit_xor("x").over(running)).withColumn("b", F.bit_xor("y").over(running))
    whole = rows.groupBy("conv", "segment").agg(F.bit_xor("x").alias("a"), F.bit_xor("y").alias("b"))
    earlier = Window.partitionBy("conv").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    carried = whole.select("conv", "segment", F.bit_xor("a").over(earlier).alias("carry_a"), F.bit_xor("b").over(earlier).alias("carry_b")).where("segment > 0")
    found = inside.join(carried, ["conv", "segment"], "left")
    a, b = (F.col(c).bitwiseXOR(F.coalesce(f"carry_{c}", F.lit(0))) for c in "ab")
    return found.select("conv", "depth", a.alias("a"), b.alias("b"), a.bitwiseXOR(F.col("x")).alias("up_a"), b.bitwiseXOR(F.col("y")).alias("up_b"), "words", "last")


def trie(members: DataFrame, turnless: DataFrame) -> DataFrame:
    """The nodes: node (a number), key, conv_id, parent, parent_conv_id, n_convs, saved."""
    grouped = members.groupBy(*KEY).agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.min("up_a").alias("up_a"), F.min("up_b").alias("up_b"), F.min("words").alias("words"))
    every = members.where("depth = 1").select("conv").unionByName(turnless)
    zero = F.lit(0).cast("bigint")
    root = every.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(*(zero.alias(c) for c in KEY), "conv_id", "n_convs", zero.alias("up_a"), zero.alias("up_b"), zero.alias("words"))
    columns = [*KEY, "conv_id", "n_convs", "up_a", "up_b", ((F.col("n_convs") - 1) * F.col("words")).alias("saved")]
    nodes = materialise(grouped.select(columns).unionByName(root.select(columns)).withColumn("node", F.monotonically_increasing_id()), "trie-nodes")
    top = nodes.where("depth = 0").first()
    if top is None:
        return nodes.select("node", *KEY, "conv_id", "n_convs", "saved", F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    parents = nodes.where("depth > 0").select((F.col("depth") + 1).alias("depth"), F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    deeper = nodes.where("depth > 1").join(parents, ["depth", "up_a", "up_b"])
    first = nodes.where("depth = 1").withColumn("parent", F.lit(top.node)).withColumn("parent_conv_id", F.lit(top.conv_id))
    none = F.lit(None).cast("bigint")
    above = nodes.where("depth = 0").withColumn("parent", none).withColumn("parent_conv_id", none)
    columns = ["node", *KEY, "conv_id", "n_convs", "saved", "parent", "parent_conv_id"]
    return deeper.select(columns).unionByName(first.select(columns)).unionByName(above.select(columns))


def with_family(tree: DataFrame) -> DataFrame:
    """``tree`` with first_child, next_sibling and n_children. Siblings follow each other by node number."""
    kids = tree.where("parent is not null").select("parent", "node", F.floor(F.col("node") / SPAN).alias("bucket"))
    buckets = kids.groupBy("parent", "bucket").agg(F.min("node").alias("first"), F.count("*").alias("n"))
    following = buckets.select("parent", "bucket", F.lead("first").over(Window.partitionBy("parent").orderBy("bucket")).alias("beyond"))
    chained = kids.withColumn("next", F.lead("node").over(Window.partitionBy("parent", "bucket").orderBy("node"))).join(following, ["parent", "bucket"])
    siblings = chained.select("node", F.coalesce("next", "beyond").alias("next_sibling"))
    families = buckets.groupBy(F.col("parent").alias("node")).agg(F.min("first").alias("first_child"), F.sum("n").alias("n_children"))
    return tree.join(families, "node", "left").join(siblings, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))


def tour(tree: DataFrame) -> DataFrame:
    """The arcs: id (twice the node's number, and one more for its exit), next, and what each adds to the sums."""
    enter, leave = F.col("node") * 2, F.col("node") * 2 + 1
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    entering = tree.select(enter.alias("id"), F.coalesce(F.col("first_child") * 2, leave).alias("next"), one.alias("steps"), (F.col("n_children") == 0).cast("bigint").alias("leaves"), "saved")
    leaving = tree.select(leave.alias("id"), F.coalesce(F.col("next_sibling") * 2, F.col("parent") * 2 + 1).alias("next"), one.alias("steps"), zero.alias("leaves"), zero.alias("saved"))
    return entering.unionByName(leaving)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums before each element of a list that is here as a whole (at most BASE elements)."""
    rows = [list(zip(*(c.to_pylist() for c in batch.columns), strict=True)) for batch in batches]
    after = {r[0]: r[1:] for part in rows for r in part}
    starts = after.keys() - {r[0] for r in after.values()}
    out = []
    for at in starts:
        sums = (0,) * len(SUMS)
        while at is not None:
            out.append((at, *sums))
            at, *own = after[at]
            sums = tuple(x + y for x, y in zip(sums, own, strict=True))
    yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * (1 + len(SUMS)), names=["id", *SUMS])


def rank(arcs: DataFrame, base: int | None = None) -> DataFrame:
    """id and, under the names of SUMS, what the elements before it in its list add up to."""
    base = base or BASE
    live, rounds = materialise(arcs, "tour"), []
    left = live.count()
    while left > base:
        heads = lambda c, r=len(rounds): F.pmod(F.xxhash64(c, F.lit(r)), F.lit(2)) == 1
        takes = heads("id") & F.col("next").isNotNull() & ~heads("next")
        takers = live.where(takes).select(F.col("id").alias("into"), F.col("next").alias("id"), *(F.col(c).alias(f"own_{c}") for c in SUMS))
        tails = live.where(~heads("id")).join(takers, "id", "left")
        merged = tails.select(
            F.coalesce("into", "id").alias("id"),
            "next",
            *((F.col(c) + F.coalesce(f"own_{c}", F.lit(0))).alias(c) for c in SUMS),
            F.when(F.col("into").isNotNull(), F.col("id")).alias("gone"),
            *(f"own_{c}" for c in SUMS),
        )
        none = F.lit(None).cast("bigint")
        others = live.where(heads("id") & ~takes).select("*", none.alias("gone"), *(none.alias(f"own_{c}") for c in SUMS))
        made = materialise(merged.unionByName(others), "tour-round")
        rounds.append(made.where("gone is not null").select("gone", "id", *(f"own_{c}" for c in SUMS)))
        live = made.select("id", "next", *SUMS)
        left = live.count()
    placed = materialise(map_batches(live.coalesce(1), _walk, ", ".join(f"{c} bigint" for c in ["id", *SUMS])), "tour-placed")
    for gone in reversed(rounds):
        back = gone.join(placed, "id").select(F.col("gone").alias("id"), *((F.col(c) + F.col(f"own_{c}")).alias(c) for c in SUMS))
        placed = materialise(placed.unionByName(back), "tour-placed")
    return placed


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's pieces, joined by commas; pieces of one key follow each other in order."""
    key, digest, found = None, None, []
    for batch in batches:
        for *own, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
            if own == key:
                digest.update(b",")
            else:
                if key:
                    found.append((*key, digest.hexdigest()))
                key, digest = own, hashlib.sha256()
            digest.update(text.encode())
        if len(found) > 10_000:
            yield _spelled(found)
            found = []
    if key:
        found.append((*key, digest.hexdigest()))
    yield _spelled(found)


def _spelled(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], names=[*KEY, "ends_sha256"])


def end_digests(members: DataFrame, turnless: DataFrame) -> DataFrame:
    """The key of every node where conversations end, and the digest of their ids, ascending.

    Ids are spelled in pieces of at most 2 ** PIECE_BITS. A node of one piece, as nearly all are, is digested by a
    column expression; the pieces of others stream through one task each, as a digest is sequential.
    """
    zero = F.lit(0).cast("bigint")
    ends = members.where("last").select(*KEY, "conv").unionByName(turnless.select(*(zero.alias(c) for c in KEY), "conv"))
    pieces = ends.groupBy(*KEY, F.shiftright("conv", PIECE_BITS).alias("piece")).agg(F.array_join(F.sort_array(F.collect_list("conv")).cast("array<string>"), ",").alias("ids"))
    pieces = materialise(pieces, "trie-ends")
    counted = pieces.groupBy(*KEY).agg(F.count("*").alias("n"), F.any_value("ids").alias("ids"))
    single = counted.where("n = 1").select(*KEY, F.sha2("ids", 256).alias("ends_sha256"))
    several = pieces.join(counted.where("n > 1").select(*KEY), KEY, "left_semi")
    # by a hash of the key: an exchange on the key itself would be left out after the join, which adaptive execution may undo later
    ordered = several.select(*KEY, "piece", "ids").repartition(F.xxhash64(*KEY)).sortWithinPartitions(*KEY, "piece")
    return single.unionByName(map_batches(ordered, _digest, "depth bigint, a bigint, b bigint, ends_sha256 string"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, enter_at and exit_at.

    ``conversations`` has conv_id, turn, role and text. Null roles and texts are empty; turns without a number come
    first; turns of one number are ordered by the digest of role and text; repeated rows are turns of their own; rows
    without conv_id belong to no conversation and are left out. The remainder of a negative id is negative or 0, so its
    opening comes from the next multiple of EVERY towards 0. An empty table has no node. enter_at and exit_at are the
    places of the node's arcs in the tour, from 0. Other columns are ignored.
    """
    turns = materialise(placed_turns(conversations), "trie-turns")
    rebuilt, turnless = rebuilt_turns(turns)
    members = materialise(prefixes(rebuilt), "trie-members")
    tree = materialise(with_family(trie(members, turnless)), "trie")
    sums = rank(tour(tree)).groupBy(F.floor(F.col("id") / 2).alias("node"))
    span = lambda c: (F.max(c) - F.min(c)).alias(f"in_{c}")  # noqa: E731  sums never fall along the tour
    held = sums.agg(span("leaves"), span("saved"), F.min("steps").alias("enter_at"), F.max("steps").alias("exit_at"))
    found = tree.join(held, "node").join(end_digests(members, turnless), KEY, "left")
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("in_leaves").alias("n_leaves"), F.col("in_saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"), "enter_at", "exit_at"
    )


#: The columns of the trie itself, in DuckDB SQL: each node is added to every prefix of its first conversation.
SQL = r"""
WITH RECURSIVE steps AS (
  SELECT n, 0 AS k, n::BIGINT AS v FROM range(256) t(n)
  UNION ALL SELECT n, k + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM steps WHERE k < 8),
crc_table AS (SELECT list(v ORDER BY n) AS crcs FROM steps WHERE k = 8),
turns AS (
  SELECT conv_id, sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS digest, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, conv_id - conv_id % 20 AS donor,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda x, y: xor(x // 256, crcs[(xor(x, y) % 256) + 1])), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM turns), crc_table),
rebuilt AS (
  SELECT c.conv_id, 0 AS part, pos, digest, words FROM convs c JOIN turns t ON t.conv_id = c.donor AND t.pos <= c.h
  UNION ALL SELECT c.conv_id, 1, pos, digest, words FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos > c.h),
members AS (
  SELECT conv_id, row_number() OVER w AS depth, string_agg(digest, ',') OVER w AS key, words FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos ROWS UNBOUNDED PRECEDING)
  UNION ALL SELECT conv_id, 0, '', 0 FROM convs),
with_up AS (SELECT *, lag(key) OVER (PARTITION BY conv_id ORDER BY depth) AS up, depth = max(depth) OVER (PARTITION BY conv_id) AS last FROM members),
nodes AS (
  SELECT depth, key, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saved,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends_sha256
  FROM with_up GROUP BY depth, key),
children AS (SELECT depth - 1 AS depth, up AS key, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
tree AS (SELECT n.*, coalesce(n_children, 0) AS n_children, p.conv_id AS parent_conv_id FROM nodes n LEFT JOIN children c USING (depth, key) LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.key = n.up),
held AS (
  SELECT m.depth, m.key, sum((t.n_children = 0)::BIGINT) AS n_leaves, sum(t.saved) AS saved_tokens
  FROM tree t JOIN members m ON m.conv_id = t.conv_id AND m.depth <= t.depth GROUP BY ALL)
SELECT conv_id, depth::BIGINT AS depth, parent_conv_id, n_convs, n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256
FROM tree JOIN held USING (depth, key)
"""
