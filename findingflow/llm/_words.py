"""Words of many texts as numpy arrays of 64-bit hashes."""

from __future__ import annotations

import re

import numpy as np

# Odd 64-bit multipliers that mix hashes.
MIX = np.uint64(0x9E3779B97F4A7C15)
STIR = np.uint64(0xC2B2AE3D27D4EB4F)
ODD = re.compile(r"[^\w\x00-\x7f]+")  # characters outside ASCII that are no part of words
IN_WORD = np.array([b >= 128 or chr(b).isalnum() or chr(b) == "_" for b in range(256)])
VALUE = np.where(IN_WORD, np.random.Generator(np.random.Philox(7)).integers(1, 1 << 63, 256, np.uint64, endpoint=False), 0).astype(np.uint64)
TOGETHER = 500_000  # bytes worked on at once


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-case words (runs of ``\\w``) of all texts in a row, and where each text starts (with the end appended).

    A word's hash is the sum of its bytes' values times powers of MIX, then stirred. Work goes in blocks that end
    between words, so memory beside the result is that of one block.
    """
    coded = [(t.lower() if t.isascii() else ODD.sub(" ", t.lower())).encode() for t in texts]
    data = np.frombuffer(b" ".join([*coded, b""]), np.uint8)
    ends = np.cumsum(np.fromiter(map(len, coded), np.int64, len(coded)) + 1)
    found, places, at = [], [], 0
    while at < len(data):
        to = min(at + TOGETHER, len(data))
        while to < len(data) and IN_WORD[data[to - 1]]:
            gap = np.flatnonzero(~IN_WORD[data[to : to + TOGETHER]])
            to = to + int(gap[0]) + 1 if len(gap) else min(to + TOGETHER, len(data))
        hashes, starts = _block(data[at:to])
        found.append(hashes)
        places.append(starts + at)
        at = to
    if not found:
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    return np.concatenate(found), np.concatenate([[0], np.searchsorted(np.concatenate(places), ends)])


def _block(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of some bytes, and where each begins."""
    inside = IN_WORD.take(data)
    starts = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    if inside[0]:
        starts = np.concatenate([[0], starts])
    if not len(starts):
        return np.empty(0, np.uint64), starts
    data = data[starts[0] :]
    lengths = np.diff(starts, append=starts[0] + len(data))
    place = np.arange(len(data), dtype=np.int32) - np.repeat((starts - starts[0]).astype(np.int32), lengths)
    powers = np.full(int(lengths.max()), MIX)
    powers[0] = 1
    values = VALUE.take(data)
    values *= np.cumprod(powers).take(place)
    return stir(np.add.reduceat(values, starts - starts[0])), starts


def stir(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    x = (x ^ (x >> np.uint64(31))) * MIX
    x = (x ^ (x >> np.uint64(29))) * STIR
    return x ^ (x >> np.uint64(32))


def shingles(words: np.ndarray, starts: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``size`` words inside one text, and where each text's begin (with the end appended).

    A text of fewer words, but at least one, has one shingle: all its words.
    """
    counts = np.diff(starts)
    made = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    begins = np.concatenate([[0], np.cumsum(made)]).astype(np.int64)
    if not begins[-1]:
        return np.empty(0, np.uint64), begins
    owner = np.repeat(np.arange(len(counts)), made)
    at = np.arange(begins[-1]) - begins[owner] + starts[owner]
    length = np.minimum(counts[owner], size)
    out = np.zeros(len(at), np.uint64)
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    short = length < size
    for k in range(size):
        part = padded[at + k]
        if short.any():
            part = np.where(k < length, part, np.uint64(k + 1))
        out = (out ^ part) * MIX
        out ^= out >> np.uint64(29)
    return stir(out), begins
