"""Periodic runs of words, by online dyadic square catching.

A run is a longest stretch of consecutive words with a smallest period q, of at least ``EXPONENT`` periods and ``LENGTH`` words.

Words are appended to a stream, a portion at a time. On level k stand catchers, one for each completed block of z = 2^k
words that starts at a multiple of z; they look for periods of z to 2z - 1. While words are appended, the catcher of the block
at s compares, for a period q, the block and the z words that end the period with those one and two periods on. They agree
when the words s to s + 3q have the period, and the comparison falls due when word s + 3q - 1 is appended: a square, and one
more period that keeps chance repeats out. Suffixes are compared by hashes of z words (two halves make the hash of the next
level), over all catchers and periods that a portion makes due in one vector step, so n words take about n log n steps.
Squares of one period at neighbouring blocks merge into a run, which is checked and extended word by word, and goes on
growing as long as appended words keep its period. A square inside a run of a smaller period is that run over again.

Short texts share a stream, parted by words of their own that cannot repeat; a long text has its stream to itself.

Cases: null and empty texts have no words and no runs; repeated rows each have their result; null ids are kept as they are; an
empty table gives an empty table; only the id, the text and the order column are read, and results are named anew, so other
columns cannot clash. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tickerloom.llm.words import mixed, portions, rounds
from tickerloom.llm.work import lean

#: Least periods and least words of a run.
EXPONENT, LENGTH = 4, 6
#: Words that are appended at once, and words up to which texts share a stream.
PORTION, SHORT = 65_536, 2_048
_SEEN = 3  # periods that a catcher sees before it reports
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _stretches(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of True begin and end."""
    edge = np.diff(np.r_[False, same, False].astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


class Catchers:
    """The runs of a stream of at most ``longest`` words without a part of their own."""

    def __init__(self, longest: int):
        self.longest, self.words = longest, np.zeros(0, dtype=np.uint64)
        self.hashes: list[np.ndarray] = []  # by level, for the words from ``first`` on
        self.first: list[int] = []
        self.ended: dict[tuple[int, int], int] = {}  # (start, period) to end
        self.open: dict[tuple[int, int], int] = {}  # those that reach the last word

    def append(self, words: np.ndarray) -> None:
        old = len(self.words)
        self.words = np.concatenate([self.words, words])
        now = len(self.words)
        live = {}
        for (start, q), end in self.open.items():
            live[start, q] = self._grown(end, q)
        k = 0
        while _SEEN << k <= min(now, self.longest):
            self._hash(k, now)
            live |= self._caught(k, old, now, live)
            k += 1
        for level in range(k):  # what later portions still compare
            keep = now - 2 * _SEEN * (1 << level)
            if keep > self.first[level]:
                self.hashes[level] = self.hashes[level][keep - self.first[level] :]
                self.first[level] = keep
        self.open = {run: end for run, end in live.items() if end == now}
        self.ended |= {run: end for run, end in live.items() if end < now}

    def runs(self) -> np.ndarray:
        """(start, length, period) of all runs, by start and period."""
        found = [(start, end - start, q) for (start, q), end in (self.ended | self.open).items()
                 if end - start >= max(LENGTH, EXPONENT * q)]
        return np.array(sorted(found, key=lambda r: (r[0], r[2])), dtype=np.int64).reshape(-1, 3)

    def _grown(self, end: int, q: int) -> int:
        """The end of the stretch that keeps the period from ``end`` on."""
        step = 64
        while end < len(self.words):
            same = self.words[end : end + step] == self.words[end - q : end - q + step][: len(self.words) - end]
            if not same.all():
                return end + int(same.argmin())
            end += len(same)
            step *= 4
        return end

    def _hash(self, k: int, now: int) -> None:
        """Hashes of 2^k words for all places that have so many."""
        if len(self.hashes) == k:
            self.hashes.append(np.zeros(0, dtype=np.uint64))
            self.first.append(0)
        done = self.first[k] + len(self.hashes[k])
        if not k:
            new = mixed(self.words[done:now])
        else:
            half, below, first = 1 << (k - 1), self.hashes[k - 1], self.first[k - 1]
            n = now - 2 * half + 1 - done
            left = below[done - first : done - first + n]
            right = below[done - first + half : done - first + half + n]
            new = mixed(left * _STEP + right)
        self.hashes[k] = np.concatenate([self.hashes[k], new])

    def _caught(self, k: int, old: int, now: int, live: dict[tuple[int, int], int]) -> dict[tuple[int, int], int]:
        """New runs of periods 2^k to 2^(k + 1) - 1 whose squares the words ``old`` to ``now`` complete."""
        z, h, first = 1 << k, self.hashes[k], self.first[k]
        block = np.arange(max(0, old - 2 * _SEEN * z) // z * z, now - _SEEN * z + 1, z)
        least = np.maximum(z, (old - block) // _SEEN + 1)
        count = np.maximum(np.minimum(2 * z - 1, (now - block) // _SEEN) - least + 1, 0)
        s = np.repeat(block, count)
        q = np.repeat(least - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        at = s - first
        met = np.flatnonzero(h[at] == h[at + q])
        at, q = at[met], q[met]
        for shift in (0, -z):  # the block itself, and the words that end the period
            for period in (1, 2) if shift else (1,):
                same = h[at + period * q + shift] == h[at + (period + 1) * q + shift]
                at, q = at[same], q[same]
        s = at + first
        known = sorted((start, end) for (start, period), end in live.items() if period < 2 * z)
        if known and len(s):
            starts, ends = np.array(known).T
            before = np.searchsorted(starts, s, "right")
            reach = np.r_[0, np.maximum.accumulate(ends)][before]
            s, q = s[reach < s + _SEEN * q], q[reach < s + _SEEN * q]
        found: dict[tuple[int, int], int] = {}
        if not len(s):
            return found
        order = np.lexsort((s, q))
        s, q = s[order], q[order]
        apart = np.flatnonzero(np.r_[True, (q[1:] != q[:-1]) | (s[1:] != s[:-1] + z)])
        for a, b in zip(apart, np.r_[apart[1:], len(s)], strict=True):
            period = int(q[a])
            lo, hi = max(0, int(s[a]) - z), min(now, int(s[b - 1]) + _SEEN * period + z)
            begin, end = _stretches(self.words[lo : hi - period] == self.words[lo + period : hi])
            long = end - begin >= (_SEEN - 1) * period
            for x, y in zip(begin[long], end[long], strict=True):
                found[lo + int(x), period] = self._grown(lo + int(y) + period, period)
        return found


def runs_of(texts: list[np.ndarray]) -> list[np.ndarray]:
    """For each text (its words as numbers): (start, length, period) of its runs, by start and period."""
    out: list[np.ndarray] = [np.zeros((0, 3), dtype=np.int64)] * len(texts)
    shared: list[int] = []

    def read(members: list[int]) -> None:
        stream = []
        for i in members:  # a number of its own ends each text
            stream += [texts[i], np.array([(1 << 63) + i], dtype=np.uint64)]
        starts = np.cumsum([0, *[len(texts[i]) + 1 for i in members]])
        catchers = Catchers(max(len(texts[i]) for i in members))
        whole = np.concatenate(stream)
        for at in range(0, len(whole), PORTION):
            catchers.append(whole[at : at + PORTION])
        found = catchers.runs()
        cuts = np.searchsorted(found[:, 0], starts)
        for place, i in enumerate(members):
            out[i] = found[cuts[place] : cuts[place + 1]] - [starts[place], 0, 0]

    held = 0
    for i, text in enumerate(texts):
        if len(text) > SHORT:
            read([i])
        elif len(text) >= LENGTH:
            shared.append(i)
            held += len(text) + 1
            if held >= PORTION - SHORT:
                read(shared)
                shared, held = [], 0
    if shared:
        read(shared)
    return out


def word_numbers(raw: bytes | None) -> np.ndarray:
    """A number below 2^63 for each word."""
    parts = [np.zeros(0, dtype=np.uint64)]
    for words in portions(raw, lower=False):
        if words:
            codes, kinds = pd.factorize(np.array(words, dtype=object))
            parts.append(pd.util.hash_array(kinds, categorize=False)[codes] >> np.uint64(1))
    return np.concatenate(parts)


def dropped(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words some run holds after its first period."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge[:n]) > 0


def collapsed(raw: bytes | None, taken: np.ndarray | None) -> bytes:
    """The words ``taken`` (places; all, in order, if None) joined by single blanks."""
    if taken is None:
        return b" ".join(b" ".join(words) for words in portions(raw, lower=False) if words)
    flat = np.frombuffer(raw, dtype=np.uint8)
    edge = np.diff(np.r_[True, (flat == 0x20) | ((flat >= 0x09) & (flat <= 0x0D)), True].astype(np.int8))
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    out = []
    for at in range(0, len(taken), PORTION):
        part = taken[at : at + PORTION]
        out.append(b" ".join([raw[a:b] for a, b in zip(begin[part].tolist(), end[part].tolist(), strict=True)]))
    return b" ".join(out)


def periodic_runs(
    docs: DataFrame, text: str = "text", row_id: str = "doc_id",
    order: Callable[[int, object], np.ndarray | None] | None = None, order_by: Column | None = None,
) -> DataFrame:
    """Per row: its id, n_words, runs (start, length, period; by start and period) and collapsed (words outside repeats).

    ``order(number of words, value of order_by)`` may give the places of the words to take instead of the text's own order.
    """
    given = F.lit(None).cast("int") if order_by is None else order_by
    rows = docs.select(F.col(row_id).alias("id"), F.col(text).cast("binary").alias("raw"), given.alias("by"))
    schema = T.StructType([rows.schema["id"]] + T._parse_datatype_string(
        "n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string").fields)

    def read(frames):
        for frame in frames:
            raws, by = frame["raw"].tolist(), frame["by"].tolist()
            for lo, hi in rounds(raws):
                numbers = [word_numbers(raw) for raw in raws[lo:hi]]
                takes = [order(len(w), v) if order and not pd.isna(v) else None for w, v in zip(numbers, by[lo:hi], strict=True)]
                numbers = [w if take is None else w[take] for w, take in zip(numbers, takes, strict=True)]
                out = []
                for raw, w, take, runs in zip(raws[lo:hi], numbers, takes, runs_of(numbers), strict=True):
                    kept = np.flatnonzero(~dropped(len(w), runs)) if len(runs) else None
                    if take is not None:
                        kept = take if kept is None else take[kept]
                    named = [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs.tolist()]
                    out.append((len(w), named, collapsed(raw, kept).decode()))
                own = pd.DataFrame(out, columns=["n_words", "runs", "collapsed"], index=frame.index[lo:hi])
                yield pd.concat([frame[["id"]].iloc[lo:hi], own], axis=1)

    return rows.mapInPandas(lean(read), schema).withColumnRenamed("id", row_id)
