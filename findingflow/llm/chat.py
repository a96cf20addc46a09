"""Conversations formatted by a compiled template, as a stream of turns.

Turns are dealt by conversation and sorted within it by Spark (which spills); each task then renders the stream
through the template one turn at a time, so a conversation of any length needs the memory of two turns. The output
is a row per turn with its formatted text, its offset in the conversation's output and the span under the loss mask.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import map_batches
from .templates import compile_template

# The template marks turns by control strings; texts and roles are escaped, so those strings mark nothing else.
TEMPLATE = (
    "{% for m in messages %}"
    "{% if m.role == 'user' %}[INST] {{ m.text | escape }} [/INST]"
    "{% elif m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}</s>"
    "{% else %}[ROLE] {{ m.role | escape }} [TEXT] {{ m.text | escape }} [/ROLE]{% endif %}"
    "{% endfor %}"
)
CONTROL = re.compile(r"\\|(?=\[/?INST\]|\[/?ROLE\]|\[TEXT\]|</?s>)")
ESCAPED = re.compile(r"\\(.)", re.S)


def escape(value: str | None) -> str:
    """A backslash before every backslash and every control string."""
    value = value or ""
    return CONTROL.sub(lambda m: "\\\\" if m[0] else "\\", value) if any(c in value for c in "\\[<") else value


def unescape(value: str) -> str:
    return ESCAPED.sub(r"\1", value) if "\\" in value else value


def read_turn(formatted: str, at: int = 0) -> tuple[str, str, int]:
    """Role, text and end of the formatted turn that starts at ``at``. Scans for the first unescaped control string."""
    if formatted.startswith("[INST] ", at):
        end = unescaped(formatted, " [/INST]", at + 7)
        return "user", unescape(formatted[at + 7 : end]), end + 8
    if formatted.startswith("[ROLE] ", at):
        middle = unescaped(formatted, " [TEXT] ", at + 7)
        end = unescaped(formatted, " [/ROLE]", middle + 8)
        return unescape(formatted[at + 7 : middle]), unescape(formatted[middle + 8 : end]), end + 8
    end = unescaped(formatted, "</s>", at)
    return "assistant", unescape(formatted[at:end]), end + 4


def unescaped(formatted: str, mark: str, at: int) -> int:
    """The next place of ``mark`` whose control string has no odd run of backslashes before it."""
    while (at := formatted.find(mark, at)) >= 0:
        if mark[0] == " ":
            return at  # the blank stands between any backslash and the control string
        slashes = 0
        while slashes < at and formatted[at - slashes - 1] == "\\":
            slashes += 1
        if slashes % 2 == 0:
            return at
        at += 1
    raise ValueError(f"no {mark.strip()} in a formatted turn")


def sorted_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text: a conversation in one partition, in order. Null texts and roles count as empty."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartition(F.xxhash64("conv_id")).sortWithinPartitions("conv_id", "turn", "role", "text")


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batched(rows: Iterator[tuple], schema: pa.Schema, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 100 + sum(len(v) for v in row if isinstance(v, str))
        if size >= most or len(held) >= 5000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


LOSS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
FORMATTED = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("offset", pa.int64()), ("formatted", pa.string()), ("loss", LOSS)])
DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def format_chats(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """A row per turn: conv_id, position (from 0), offset, formatted, and loss: the spans under the loss mask in the conversation's output.

    Rows stay dealt by conversation and in order within each partition. Turns go by (turn, role, text), nulls first, so
    repeated or tied turns all stay, in a fixed order. Rows of a null conv_id are one conversation. An empty table
    gives an empty one; other columns are ignored. The template should loop over ``messages``; what it writes after
    the loop goes to a row of its own.
    """

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = compile_template(template, {"escape": escape})

        def rows() -> Iterator[tuple]:
            for conv_id, turns in groupby(_stream(batches), key=lambda r: r[0]):
                texts, loss, start, at, position = [], [], 0, 0, 0
                for text, generated in run({"messages": ({"role": r[2], "text": r[3]} for r in turns)}):
                    if text is None:
                        yield conv_id, position, start, "".join(texts), loss
                        texts, loss, start, position = [], [], at, position + 1
                        continue
                    if generated:
                        if loss and loss[-1]["end"] == at:
                            loss[-1]["end"] += len(text)
                        else:
                            loss.append({"start": at, "end": at + len(text)})
                    texts.append(text)
                    at += len(text)
                if texts:
                    yield conv_id, position, start, "".join(texts), loss

        yield from _batched(rows(), FORMATTED)

    return map_batches(sorted_turns(conversations), render, "conv_id bigint, position bigint, offset bigint, formatted string, loss array<struct<start:bigint,end:bigint>>")


def digest_chats(formatted: DataFrame) -> DataFrame:
    """A row per conversation, read back from what ``format_chats`` wrote with the default template.

    conv_id, n_turns, turns_sha256 (role, newline, text, newline of every turn), loss_chars and loss_sha256 of the
    unescaped text under the loss mask, formatted_chars. Digests are updated turn by turn.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for conv_id, turns in groupby(_stream(batches), key=lambda r: r[0]):
                all_text, loss_text, n, chars, loss_chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                for _, _, offset, text, loss in turns:
                    at = 0
                    while at < len(text):
                        role, said, at = read_turn(text, at)
                        all_text.update(f"{role}\n{said}\n".encode())
                        n += 1
                    chars += len(text)
                    for span in loss:
                        masked = unescape(text[span["start"] - offset : span["end"] - offset])
                        loss_text.update(masked.encode())
                        loss_chars += len(masked)
                yield conv_id, n, all_text.hexdigest(), loss_chars, loss_text.hexdigest(), chars

        yield from _batched(rows(), DIGESTS)

    return map_batches(formatted, read, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
