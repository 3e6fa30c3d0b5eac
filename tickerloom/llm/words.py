"""Words and word shingles of whole texts as 64-bit hashes, a batch of texts at a time.

Texts are handled as UTF-8 bytes: lowering bytes changes A-Z alone, and splitting bytes cuts at the ASCII blanks
``[\\x20\\x09-\\x0D]`` alone, so both are exact for the word definitions used here. Equal words get equal hashes on every
executor; two different shingles meet in one hash with a probability of about 2^-64 for each pair.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd

#: Characters that one round of vector work takes at most (a single longer text is taken whole).
ROUND_CHARS = 1_000_000
#: Turns every byte that is no digit, letter or part of a non-ASCII character into a blank (after lowering).
ALNUM = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))

_STEP = np.uint64(0x9E3779B97F4A7C15)
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rounds(texts: Sequence[str | bytes | None], chars: int | None = None) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``chars`` (ROUND_CHARS) characters each."""
    most = chars or ROUND_CHARS
    start = held = 0
    for i, text in enumerate(texts):
        size = len(text) if text else 0
        if held and held + size > most:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(texts):
        yield start, len(texts)


def split_words(text: str | bytes | None, table: bytes | None = None) -> list[bytes]:
    """Words, A-Z lowered; ``table`` may first turn other bytes into blanks."""
    raw = text.encode() if isinstance(text, str) else text or b""
    return (raw.lower().translate(table) if table else raw.lower()).split()


def hashed_words(texts: Sequence[str | bytes | None], table: bytes | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words in order, and where each text's words begin (with the end as the last entry)."""
    words: list[bytes] = []
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    for i, text in enumerate(texts):
        words += split_words(text, table)
        starts[i + 1] = len(words)
    if not words:
        return np.zeros(0, dtype=np.uint64), starts
    codes, kinds = pd.factorize(np.array(words, dtype=object))
    return pd.util.hash_array(kinds, categorize=False)[codes], starts


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of k words; empty if there are fewer."""
    if len(words) < k:
        return np.zeros(0, dtype=np.uint64)
    n, out = len(words) - k + 1, np.full(len(words) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        out = out * _STEP + mixed(words[i : i + n] + np.uint64(i + 1))
    return mixed(out)


def shingle_sets(texts: Sequence[str | bytes | None], k: int) -> Iterator[np.ndarray]:
    """For each text its distinct k-word shingles, ascending; a shorter text is one shingle, one without words has none."""
    for lo, hi in rounds(texts):
        words, starts = hashed_words(texts[lo:hi])
        every = shingles(words, k)
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            if b - a >= k:
                yield np.unique(every[a : b - k + 1])
            else:
                yield shingles(words[a:b], b - a) if b > a else words[:0]


def portions(text: bytes | None, size: int = ROUND_CHARS, lower: bool = True) -> Iterator[list[bytes]]:
    """The words of one text in order, with A-Z lowered; a long text comes in portions of about ``size`` bytes, cut at blanks."""
    raw, start = text or b"", 0
    while start < len(raw):
        end = start + size
        if end < len(raw):
            # To the end of the word that lies there.
            blank = _BLANK.search(raw, end)
            end = blank.start() if blank else len(raw)
        part = raw[start:end]
        yield (part.lower() if lower else part).split()
        start = end
