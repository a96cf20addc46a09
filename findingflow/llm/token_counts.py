"""Token counts with the whole-token shortcut.

Offline, on the driver, every string of the vocabulary is encoded alone once; those that come back as exactly
their own id are *whole tokens*. In the scan a pre-token that is a whole token counts as one without any merge;
only the rest goes through the library's merges. The set and the tokenizer file are bounded by the vocabulary.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from ._common import Memo, caches, map_batches, values

# Fixed value: the byte-level pre-token pattern of the tokenizer files handled here.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Pre-tokens never cross these chunks: each starts and ends where a pre-token does.
CHUNK = re.compile(r" ?\S+|\s+(?!\S)|\s+")
# Letters and digits here are classed alike by every Unicode version; other chunks go to the library whole.
PLAIN = re.compile(r"[\t\n\r -~\xa0-\xff]*")
# White space to Python, but not to the library.
ODD_SPACE = re.compile(r"[\x1c-\x1f]")

_loaded: dict[int, tuple] = {}
caches.append(_loaded)


def byte_alphabet() -> dict[str, int]:
    """The visible character that stands for each byte in a byte-level vocabulary, reversed."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def byte_shower(alphabet: dict[str, int]) -> Callable[[str], str]:
    """Text to the visible characters of its bytes, as the merges of a byte-level vocabulary take them."""
    table = {b: c for c, b in alphabet.items()}

    def show(text: str) -> str:
        return text if text.isascii() and text.isalpha() else text.encode().decode("latin-1").translate(table)

    return show


def prove_whole_tokens(tokenizer: Tokenizer) -> frozenset[str]:
    """Vocabulary strings that, encoded alone, give exactly one token: their own id."""
    alphabet, texts, ids = byte_alphabet(), [], []
    for shown, token_id in tokenizer.get_vocab(with_added_tokens=False).items():
        try:
            texts.append(bytes(alphabet[c] for c in shown).decode("utf-8"))
        except (KeyError, UnicodeDecodeError):
            continue
        ids.append(token_id)
    encoded = tokenizer.encode_batch(texts, add_special_tokens=False)
    return frozenset(t for t, i, e in zip(texts, ids, encoded, strict=True) if e.ids == [i])


def _counter(spec: str, whole: frozenset[str]) -> tuple[Tokenizer, Memo, re.Pattern]:
    """Per worker: the tokenizer, a memo from chunk to its number of tokens, and what sends a text to the library whole."""
    key = hash(spec)
    if key not in _loaded:
        tokenizer = Tokenizer.from_str(spec)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        pre_tokens, merge, show = regex.compile(PRE_TOKEN).findall, tokenizer.model.tokenize, byte_shower(byte_alphabet())

        def count(chunk: str) -> int:
            if chunk in whole:
                return 1
            if not PLAIN.fullmatch(chunk):
                return len(tokenizer.encode(chunk, add_special_tokens=False).ids)
            return sum(1 if p in whole else len(merge(show(p))) for p in pre_tokens(chunk))

        special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        odd = re.compile("|".join([ODD_SPACE.pattern, *map(re.escape, special)]))
        _loaded[key] = tokenizer, Memo(count), odd
    return _loaded[key]


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_bytes, n_tokens, over_limit for every row of ``docs``.

    A null or empty text has 0 bytes and 0 tokens. A null id stays null; repeated rows give repeated results; an
    empty table gives an empty one. Columns other than the two named are ignored, whatever their names. Texts that
    hold a special token's string, or white space the library splits otherwise, are encoded whole by the library.
    """
    sc = docs.sparkSession.sparkContext
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    shared = sc.broadcast((spec, prove_whole_tokens(Tokenizer.from_str(spec))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, memo, odd = _counter(*shared.value)
        of, chunks = memo.__getitem__, CHUNK.findall
        for batch in batches:
            texts = pc.fill_null(batch.column(1).cast(pa.string()), "")
            counts = [
                len(tokenizer.encode(t, add_special_tokens=False).ids) if odd.search(t) else sum(map(of, chunks(t)))
                for t in values(texts)
            ]
            n = pa.array(counts, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pc.binary_length(texts).cast(pa.int64()), n, pc.greater(n, limit)],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    rows = docs.select(id_col, text_col)
    id_type = rows.schema[id_col].dataType.simpleString()
    return map_batches(rows, count, f"`{id_col}` {id_type}, n_bytes bigint, n_tokens bigint, over_limit boolean")
