"""A learned title scorer: hashed words and word pairs, a multinomial model, fitted by sums that Spark gathers.

A title's features are its lower-cased words and marks and the pairs of neighbours, hashed into ``2 ** bits`` places, each counted once and
scaled to length 1. The model is a weight for each (place, class) and one for each class. Titles are cut once, and kept in blocks of one
class that fit a core's cache. Each round every task sums the gradient over its blocks; sums meet by place, and at most ``2 ** bits``
places of them come to the driver, which takes one step (per-place step sizes, so rare words learn as well). What travels is bounded by
the model, never by the rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tickerloom.session import discard, staged

CLASSES = 3  # bearish, neutral, bullish
BITS, ROUNDS, RATE, DECAY = 16, 40, 0.5, 1e-4
BLOCK = 1 << 17  # words that are worked on at once; a title is never divided
LONG = 24  # a word's bytes from here on are summed for each word rather than for a block
_TOKEN = re.compile(r"[^\W\d_]+|[^\w\s]+|\d+")


# CRC-32 by bytes: what a register's low byte adds.
_STEP = np.array([zlib.crc32(bytes([i ^ 255])) for i in range(256)], np.uint32) ^ np.uint32(0xFF000000)


def _summed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, registers: np.ndarray) -> np.ndarray:
    """CRC-32 registers (checksums inverted) after a slice of ``data`` each, a byte of all slices at a time."""
    sizes = ends - starts
    short = np.minimum(sizes, LONG)
    order = np.argsort(-short.astype(np.int8), kind="stable")
    at, out = starts[order], registers[order]
    longer = len(sizes) - np.cumsum(np.bincount(short, minlength=LONG))
    for k in range(LONG):
        own = out[:longer[k]]
        own[:] = _STEP.take((own ^ data.take(at[:len(own)] + k)) & 255) ^ (own >> 8)
    back = np.empty_like(out)
    back[order] = out
    for i in np.flatnonzero(sizes > LONG):
        back[i] = ~np.uint32(zlib.crc32(data[starts[i] + LONG:ends[i]], int(~back[i])))
    return back


def _places(words: list[str], counts: list[int], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Of titles whose words follow each other, so many for each: all places (a title's ascending, each once), and how many each has."""
    if not words:
        return np.zeros(0, np.uint32), np.zeros(len(counts), np.int64)
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    gaps = np.flatnonzero(data == ord(" "))
    starts, ends = np.r_[0, gaps + 1], np.r_[gaps, len(data)]
    title = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
    own = _summed(data, starts, ends, np.full(len(words), 0xFFFFFFFF, np.uint32))
    # A pair's checksum ("a b") goes on from that of its first word.
    second = np.flatnonzero(title[1:] == title[:-1]) + 1
    pairs = _summed(data, starts[second] - 1, ends[second], own[second - 1])
    top = np.uint64((1 << bits) - 1)
    keys = (~np.r_[own, pairs]).astype(np.uint64) & top | np.r_[title, title[second]] << np.uint64(bits)
    keys.sort()
    keys = keys[np.r_[True, keys[1:] != keys[:-1]]]
    return (keys & top).astype(np.uint32), np.bincount((keys >> np.uint64(bits)).astype(np.int64), minlength=len(counts))


def _blocks(texts: Iterable[str | None], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places as :func:`_places` gives them, of all texts in their order, some ``BLOCK`` words at a time."""
    words, counts = [], []
    for text in texts:
        own = _TOKEN.findall((text or "").lower())
        words += own
        counts.append(len(own))
        if len(words) >= BLOCK:
            yield _places(words, counts, bits)
            words, counts = [], []
    if counts:
        yield _places(words, counts, bits)


def features(text: str | None, bits: int) -> tuple[np.ndarray, float]:
    """The places of a text's features (ascending, each once) and the value that all of them have."""
    places = next(_blocks([text], bits))[0]
    return places, float(_scale(len(places)))


def _scale(sizes):
    """The value of each feature of titles that have so many."""
    return np.where(np.asarray(sizes) > 0, 1 / np.sqrt(np.maximum(sizes, 1)), 0.0)


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of runs that follow each other; empty ones give 0."""
    out, some = np.zeros(len(sizes)), sizes > 0
    if some.any():
        out[some] = np.add.reduceat(values, (np.cumsum(sizes) - sizes)[some])
    return out


def _products(columns: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Titles (rows) by the columns' weights: sums over places that follow each other in ``flat``, so many for each title."""
    at = flat.astype(np.intp, copy=False)
    return np.stack([_sums(w.take(at, mode="clip"), sizes) for w in columns], axis=1) * _scale(sizes)[:, None]


@dataclass(frozen=True)
class Model:
    bits: int
    weights: np.ndarray  # a row for each place, a column for each class
    base: np.ndarray

    def logits(self, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Of titles whose places follow each other in ``flat``, so many for each."""
        return _products(np.ascontiguousarray(self.weights.T), flat, sizes) + self.base

    def score(self, texts: list[str]) -> np.ndarray:
        return np.concatenate([np.zeros((0, CLASSES)), *[self.logits(*block) for block in _blocks(texts, self.bits)]])


def _odds(logits: np.ndarray) -> np.ndarray:
    raised = np.exp(logits - logits.max(axis=1, keepdims=True))
    return raised / raised.sum(axis=1, keepdims=True)


def _packed(bits: int) -> np.dtype:
    return np.dtype("<u2" if bits <= 16 else "<u4")


def _gradient(rows: DataFrame, model: Model, weights: np.ndarray) -> pd.DataFrame:
    """Sums by place (-1 for the classes' own weights)."""
    shared = rows.sparkSession.sparkContext.broadcast((model, weights))

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, weights = shared.value
        # Odds depend on differences between classes only, and a title's errors add up to 0: the first class follows from the others.
        lead = np.ascontiguousarray((model.weights[:, 1:] - model.weights[:, :1]).T)
        total, base = np.zeros((CLASSES, 1 << model.bits)), np.zeros(CLASSES)
        for frame in frames:
            for label, sizes, places in zip(frame["label"], frame["sizes"], frame["places"], strict=True):
                flat = np.frombuffer(places, _packed(model.bits)).astype(np.intp)
                sizes = np.frombuffer(sizes, "<i8")
                logits = np.zeros((len(sizes), CLASSES))
                logits[:, 1:] = _products(lead, flat, sizes) + (model.base[1:] - model.base[0])
                wrong = _odds(logits)
                wrong[:, label] -= 1
                wrong *= weights[label]
                base += wrong.sum(axis=0)
                wrong *= _scale(sizes)[:, None]
                for c in range(1, CLASSES):
                    total[c] += np.bincount(flat, np.repeat(wrong[:, c], sizes), 1 << model.bits)
        total[0] = -total[1:].sum(axis=0)
        total = total.T
        held = np.flatnonzero(np.abs(total).sum(axis=1))
        out = np.vstack([total[held], base])
        yield pd.DataFrame({"place": np.r_[held, -1], **{f"g{c}": out[:, c] for c in range(CLASSES)}})

    told = rows.mapInPandas(sums, "place bigint, " + ", ".join(f"g{c} double" for c in range(CLASSES)))
    out = told.groupBy("place").agg(*[F.sum(f"g{c}").alias(f"g{c}") for c in range(CLASSES)]).toArrow().to_pandas()
    shared.unpersist()
    return out


def fit(titles: DataFrame, text: str = "Title", label: str = "label", bits: int = BITS, rounds: int = ROUNDS) -> Model:
    """Learns from titles with a class (0 bearish, 1 neutral, 2 bullish); rows without one teach nothing. Classes weigh alike."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for c, texts in frame.groupby("label")["text"]:
                held = [(c, len(sizes), sizes.astype("<i8").tobytes(), flat.astype(_packed(bits)).tobytes())
                        for flat, sizes in _blocks(texts, bits)]
                yield pd.DataFrame(held, columns=["label", "titles", "sizes", "places"])

    given = titles.select(F.col(text).alias("text"), F.col(label).cast("int").alias("label")).filter(F.col("label").between(0, CLASSES - 1))
    rows, path = staged(given.mapInPandas(cut, "label int, titles bigint, sizes binary, places binary"), "title-features")
    counts = np.zeros(CLASSES)
    for r in rows.groupBy("label").agg(F.sum("titles")).collect():
        counts[r[0]] = r[1]
    model = Model(bits, np.zeros((1 << bits, CLASSES)), np.zeros(CLASSES))
    if not counts.sum():
        return model
    share = np.divide(1, counts * np.count_nonzero(counts), out=np.zeros(CLASSES), where=counts > 0)
    seen, seen_base = np.full((1 << bits, CLASSES), 1e-8), np.full(CLASSES, 1e-8)
    for _ in range(rounds):
        told = _gradient(rows, model, share)
        grad = np.zeros((1 << bits, CLASSES))
        own = told[told["place"] >= 0]
        grad[own["place"].to_numpy()] = own[[f"g{c}" for c in range(CLASSES)]].to_numpy()
        base = told.loc[told["place"] < 0, [f"g{c}" for c in range(CLASSES)]].to_numpy()[0]
        grad += DECAY * model.weights
        seen, seen_base = seen + grad**2, seen_base + base**2
        model = Model(bits, model.weights - RATE * grad / np.sqrt(seen), model.base - RATE * base / np.sqrt(seen_base))
    discard(titles.sparkSession, path)
    return model


def learned_logits(spark: SparkSession, model: Model) -> Callable[[Column], Column]:
    """A scorer as :func:`tickerloom.functions.sentiment.word_logits` is one."""
    shared = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(shared.value.score(texts.tolist())))

    return F.pandas_udf(score, "array<double>")
