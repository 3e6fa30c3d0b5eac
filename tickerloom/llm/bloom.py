"""Bloom filters of 64-bit keys, built by Spark and used in tasks."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tickerloom.llm.words import mixed
from tickerloom.llm.work import lean

#: Share of wrong keys that a filter lets through.
LET_THROUGH = 0.05
#: Bits of a filter at most (32 MB): beyond about 40 million keys it lets more wrong keys through.
MOST_BITS = 1 << 28


@dataclass(frozen=True)
class Filter:
    """64-bit words, number of bits, number of probes, and what tells its hashes from those of other filters."""

    words: np.ndarray
    bits: int
    probes: int
    salt: int


def probed(keys: np.ndarray, salt: int, bits: int, probes: int) -> np.ndarray:
    """The bit positions of each key, one row for each probe."""
    first = mixed(keys.astype(np.uint64) ^ mixed(np.array([salt + 1], dtype=np.uint64))[0])
    step = mixed(first + np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    at = np.arange(probes, dtype=np.uint64)[:, None]
    return (first + at * step) % np.uint64(bits)


def lets_through(keys: np.ndarray, held: Filter) -> np.ndarray:
    """Which keys the filter holds (or takes for held)."""
    at = probed(keys, held.salt, held.bits, held.probes)
    return ((held.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=0)


def filled(keys: DataFrame, count: int, salt: int = 0) -> Filter:
    """A filter of the ``_key`` column, sized for ``count`` keys. Tasks OR bits by word; the words come to the driver."""
    bits = max(64, min(MOST_BITS, 64 * math.ceil(-count * math.log(LET_THROUGH) / math.log(2) ** 2 / 64)))
    probes = max(1, round(bits / max(1, count) * math.log(2)))
    probes = min(probes, 16)

    def words(frames):
        for frame in frames:
            at = np.sort(probed(frame["_key"].to_numpy(), salt, bits, probes).ravel())
            word, bit = at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63))
            if len(word):
                begin = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
                yield pd.DataFrame({"word": word[begin].astype(np.int64),
                                    "held": np.bitwise_or.reduceat(bit, begin).view(np.int64)})

    merged = keys.select("_key").mapInPandas(words, "word bigint, held bigint")
    own = merged.groupBy("word").agg(F.bit_or("held").alias("held")).toPandas()
    out = np.zeros(bits // 64, dtype=np.uint64)
    out[own["word"].to_numpy(np.int64)] = own["held"].to_numpy(np.int64).view(np.uint64)
    return Filter(out, bits, probes, salt)


def may_hold(spark: SparkSession, held: Filter, key: Column) -> Column:
    """Whether the filter lets a key (a long, not null) through."""
    shared = spark.sparkContext.broadcast(held)

    def kept(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for keys in batches:
            yield pd.Series(lets_through(keys.to_numpy(), shared.value))

    return F.pandas_udf(lean(kept), "boolean")(key)


def passing(rows: DataFrame, held: Filter, key: str = "_key") -> DataFrame:
    """The rows whose key (a long, not null) the filter lets through."""
    return rows.filter(may_hold(rows.sparkSession, held, F.col(key)))


def without(rows: DataFrame, gone: DataFrame, own_key: Column, gone_key: Column, same: Column) -> DataFrame:
    """The rows that are the ``same`` as none of ``gone``. Only those that a filter takes for such move to a join."""
    held = filled(gone.select(gone_key.alias("_key")), gone.count())
    may = may_hold(rows.sparkSession, held, own_key)
    return rows.filter(~may).unionByName(rows.filter(may).join(gone, same, "left_anti"))
