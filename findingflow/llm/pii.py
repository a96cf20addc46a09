"""Personal data in texts: fixed shapes first, then bootstrapped contextual extraction.

The spans of the fixed shapes are seeds; so are quoted strings with the shape of a key or token, which are not
reported by themselves. The words around seeds are lexical patterns ("two words before", "word before and word after",
"word before", per kind). Loosely shaped strings that no seed covers are candidates with patterns of their own.
Spark scores the graph of patterns and instances in rounds: a pattern is as good as the share of its instances that
are known, an instance as good as its best pattern. Candidates, and quoted secrets, in the context of a pattern that
is good enough after the last round are reported as found. All of it is grouping and joining on (pattern) or
(instance) over every mention; nothing is collected, and only documents' mentions, never their texts, are shuffled.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import map_batches, materialise, unused, values

KINDS = ("email", "ip", "card", "phone", "secret")  # the last has no fixed shape of its own: it is only ever found

# The shapes of the base spans.
EMAIL_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
EMAIL_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Loose shapes: what may be an identifier if its context says so.
LOOSE = (
    (0, re.compile(r"(?<![\w.+-])[\w.+-]++(?: ?\[at\] ?| ?\(at\) ?|@| at )[\w-]++(?:(?: ?\[dot\] ?| ?\(dot\) ?|\.| dot )[\w-]++)+", re.I), re.compile(r"\[at\]|\(at\)|@|\[dot\]|\(dot\)| dot ", re.I)),
    (1, re.compile(r"(?<![\w.])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)| dot )[0-9]{1,3}){3}(?![\w.])|(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){4,7}[0-9A-Fa-f]{1,4}(?![\w:])"), re.compile(r"\[\.\]|\(\.\)| dot |:")),
    (2, re.compile(r"(?<![\w.])[0-9](?:[ ./-]?[0-9]){11,18}(?![\w.])"), re.compile(r"[0-9]")),
    (3, re.compile(r"(?<![\w.+])(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ ./-]?[0-9]{2,4}){2,4}(?![\w.])"), re.compile(r"[0-9]")),
    (4, re.compile(r"(?<![\w+/=-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{16,}+=*(?![\w+/=-])"), re.compile(r"[0-9]")),
)
# The shapes of keys and tokens that seed the patterns of secrets, if they stand in quotes.
SECRET = re.compile(r"[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{64}|(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9_-]{20,}|eyJ[A-Za-z0-9_-]{16,}")
QUOTES = "\"'`"
DIGIT = re.compile(r"[0-9]")
WORD = re.compile(r"\w+|[=:#]")
REACH = 60  # characters looked at first; more if words are longer
BROADCAST_SPANS = 1_000_000  # of about 12 bytes, and four more for each document that has any
SPAN = "struct<kind:int,start:int,end:int>"
MENTION = "struct<kind:int,start:int,end:int,instance:bigint,known:boolean,patterns:array<bigint>>"
_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
_MENTION = pa.struct([*_SPAN, ("instance", pa.int64()), ("known", pa.bool_()), ("patterns", pa.list_(pa.int64()))])


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses. Each is found from its @, so that long runs of letters cost nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and EMAIL_LOCAL.match(text[start - 1]):
            start -= 1
        found = EMAIL_DOMAIN.match(text, at) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by start, then kind: matches of the fixed shapes, less those that fail their check."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        out += [(1, *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
        out += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], s[0], s[2]))


class Taken:
    """Disjoint stretches of a text, in order."""

    def __init__(self, spans: Iterable[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def add(self, a: int, b: int) -> bool:
        """Take [a, b) if all of it is free."""
        at = bisect_right(self.ends, a)
        if at < len(self.starts) and self.starts[at] < b:
            return False
        self.starts.insert(at, a)
        self.ends.insert(at, b)
        return True


def loose_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates: loosely shaped strings that overlap no base span; where shapes overlap, the earlier kind."""
    digits, lower = DIGIT.search(text) is not None, text.lower()
    dotted = "dot" in lower or "[at]" in lower or "(at)" in lower
    taken, out = Taken((a, b) for _, a, b in base), []
    for kind, shape, mark in LOOSE:
        if not (digits if kind else dotted):
            continue
        for m in shape.finditer(text):
            a, b = m.span()
            if mark.search(m[0]) and taken.add(a, b):
                out.append((kind, a, b))
    return out


def words_before(text: str, at: int, n: int) -> list[str]:
    """The last ``n`` words, whole, before a place."""
    reach = REACH
    while True:
        low = max(0, at - reach)
        found = WORD.findall(text[low:at].lower())
        if low == 0 or len(found) > n:  # the first word may be cut
            return found[-n:]
        reach *= 4


def words_after(text: str, at: int, n: int) -> list[str]:
    """The first ``n`` words, whole, from a place on."""
    reach = REACH
    while True:
        found = WORD.findall(text[at : at + reach].lower())
        if at + reach >= len(text) or len(found) > n:  # the last word may be cut
            return found[:n]
        reach *= 4


def contexts(text: str, kind: int, start: int, end: int) -> list[int]:
    """The patterns around a span, hashed: the two words before it; the word before and the word after; the word before."""
    before, after = words_before(text, start, 2), words_after(text, end, 1)
    found = []
    if len(before) == 2:
        found.append(f"{kind}|{before[0]} {before[1]} _")
    if before and after:
        found.append(f"{kind}|{before[-1]} _ {after[0]}")
    if before:
        found.append(f"{kind}|{before[-1]} _")
    return [xxhash.xxh64_intdigest(p) - (1 << 63) for p in found]


def is_secret_seed(text: str, start: int, end: int) -> bool:
    """Whether a string stands in quotes and has the shape of a key or token."""
    return 0 < start and end < len(text) and text[start - 1] == text[end] and text[end] in QUOTES and SECRET.fullmatch(text, start, end) is not None


def _mention(text: str, kind: int, start: int, end: int) -> dict:
    value = re.sub(r"\W+", "", text[start:end].lower())
    instance = xxhash.xxh64_intdigest(f"{kind}|{value}") - (1 << 63)
    return {"kind": kind, "start": start, "end": end, "instance": instance, "known": kind == 4 and is_secret_seed(text, start, end), "patterns": contexts(text, kind, start, end)}


def mentions(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per document: its base spans with their patterns, and its candidates. ``text_key`` tells texts of one id apart."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seeds, loose = [], []
            for text in values(batch.column(2)):
                base = base_spans(text) if text else []
                seeds.append([_mention(text, *s) for s in base])
                loose.append([_mention(text, *s) for s in loose_spans(text, base)] if text else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(seeds, pa.list_(_MENTION)), pa.array(loose, pa.list_(_MENTION))], names=[id_col, "text_key", "seeds", "loose"])

    rows = docs.select(id_col, F.xxhash64(text_col).alias("text_key"), text_col)
    return map_batches(rows, scan, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, text_key bigint, seeds array<{MENTION}>, loose array<{MENTION}>")


def score_patterns(seen: DataFrame, rounds: int, min_known: float, min_score: float) -> DataFrame:
    """Patterns that are good after ``rounds``: at least ``min_known`` known instances, and ``min_score`` of all known.

    Seeds are known from the start with score 1; a candidate is known with its best pattern's score once that is
    good. Only patterns that some candidate has are scored, so the graph is no larger than the candidates need.
    """

    def edges(column: str, known: Column) -> DataFrame:
        m = seen.select(F.explode(column).alias("m")).select("m.instance", known.cast("double").alias("known"), F.explode("m.patterns").alias("pattern"))
        return m.select("pattern", "instance", "known").distinct()

    loose = edges("loose", F.col("m.known"))
    graph = edges("seeds", F.lit(1.0)).join(loose.select("pattern").distinct(), "pattern", "left_semi").unionByName(loose)
    graph = materialise(graph.groupBy("pattern", "instance").agg(F.max("known").alias("known")), "pii-graph")

    def good(scored: DataFrame) -> DataFrame:
        total = F.sum("known")
        return scored.groupBy("pattern").agg(total.alias("n"), (total / F.count("*")).alias("score")).where((F.col("n") >= min_known) & (F.col("score") >= min_score)).select("pattern", "score")

    patterns = good(graph)
    for _ in range(rounds - 1):
        best = graph.join(patterns, "pattern").groupBy("instance").agg(F.max("score").alias("best"))
        scored = graph.join(best, "instance", "left").select("pattern", "instance", F.greatest("known", F.coalesce("best", F.lit(0.0))).alias("known"))
        patterns = good(scored)
    return patterns


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 3, min_known: float = 5.0, min_score: float = 0.8) -> DataFrame:
    """``id_col``, text_key (xxhash64 of the text), base and found: arrays of (kind, start, end), kind an index of ``KINDS``.

    Starts and ends are code points, end exclusive; both arrays are sorted by start, then kind. ``found`` never
    overlaps ``base``. A null or empty text has none. Null ids stay null; repeated rows give repeated results; an
    empty table gives an empty one; other columns are ignored.
    """
    seen = materialise(mentions(docs, id_col, text_col), "pii-mentions")
    good = score_patterns(seen, rounds, min_known, min_score)
    hits = (
        seen.select(id_col, "text_key", F.explode("loose").alias("m"))
        .select(id_col, "text_key", "m.kind", "m.start", "m.end", F.explode("m.patterns").alias("pattern"))
        .join(good, "pattern", "left_semi")
        .groupBy(F.col(id_col).alias("hit_id"), F.col("text_key").alias("hit_key"))
        .agg(F.collect_set(F.struct("kind", "start", "end")).alias("hits"))
    )
    spans = lambda c, order: F.array_sort(c, order)
    plain = F.transform("seeds", lambda m: F.struct(m["kind"].alias("kind"), m["start"].alias("start"), m["end"].alias("end")))
    joined = seen.join(hits, F.col(id_col).eqNullSafe(F.col("hit_id")) & (F.col("text_key") == F.col("hit_key")), "left")
    return joined.select(id_col, "text_key", plain.alias("base"), spans(F.coalesce("hits", F.array().cast(f"array<{SPAN}>")), by_start).alias("found"))


def by_start(x: Column, y: Column) -> Column:
    """Comparator of spans: by start, then kind."""
    difference = F.when(x["start"] != y["start"], x["start"] - y["start"]).otherwise(x["kind"] - y["kind"])
    return F.signum(difference).cast("int")


def count_kind(spans: Column | str, kind: int) -> Column:
    """How many of the spans are of one kind. The lambda takes the span alone: a second parameter, even one with a default, would get its position."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def spell(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])), ",")


def redact_spans(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` with every span replaced by its kind in brackets; overlapping spans become the first one's kind."""
    out, done = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], s[0])):
        if start >= done:
            out += [text[done:start], f"[{KINDS[kind].upper()}]"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings: float) -> DataFrame:
    """``docs`` with all personal data in ``text_col`` replaced by ``[KIND]``. Null texts stay null; all columns are kept, whatever their names.

    Texts meet their spans by (id, hash of text), and only texts that have spans leave the JVM.
    """
    span_id, span_key, spans_col = unused(docs, "span_id", "span_key", "spans")
    spans = find_pii(docs, id_col, text_col, **settings).select(F.col(id_col).alias(span_id), F.col("text_key").alias(span_key), F.concat("base", "found").alias(spans_col))
    spans = materialise(spans.where(F.size(spans_col) > 0).dropDuplicates([span_id, span_key]), "pii-spans")
    if (spans.agg(F.sum(F.size(spans_col) + 4)).first()[0] or 0) <= BROADCAST_SPANS:  # beyond that, an ordinary join
        spans = F.broadcast(spans)
    at, names = docs.columns.index(text_col), docs.columns

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = zip(values(batch.column(at)), values(batch.column(len(names))), strict=True)
            texts = pa.array([redact_spans(text, [(s["kind"], s["start"], s["end"]) for s in spans]) for text, spans in found], batch.schema.types[at])
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], texts, *batch.columns[at + 1 : len(names)]], names=names)

    own = (F.col(id_col).eqNullSafe(F.col(span_id))) & (F.xxhash64(text_col) == F.col(span_key))
    hit = map_batches(docs.join(spans, own, "inner").select(*docs.columns, spans_col), cover, docs.schema)
    return docs.join(spans, own, "left_anti").unionByName(hit)
