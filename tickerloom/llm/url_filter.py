"""Rules over URLs, and a cascade of Bloom filters for a list of keys.

The cascade encodes which keys of a known universe (all keys of the corpus) are listed. Level 1 is a Bloom filter of the
listed keys; level 2 holds the unlisted keys that level 1 lets through, level 3 the listed keys that level 2 lets through,
and so on until a level lets nothing wrong through. A key is listed if the first level that rejects it is an even one
(or none rejects and the number of levels is odd). For every key of the universe the answer is exact, with no join.

Filters are built by Spark (bits are OR-ed by word) and hold at most SEGMENT_KEYS listed keys each, so their size is bounded;
a longer list is cut into segments by key hash, each with its own cascade and its own pass over its share of the rows.
Keys are 64-bit hashes; should a listed and an unlisted key share one, another salt is taken.

Cases: a null URL, and one without ``://``, has an empty host and an empty path, which rules of the empty host alone could fit; a null
key is not listed; of rules of equal length the later one counts; repeated rows are judged alike, each for itself; an empty table,
an empty list and a list of all keys are as any other; columns named like a result are replaced, all others stay.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tickerloom.llm import bloom
from tickerloom.llm.work import stage

#: Listed keys of one cascade; its first level then takes about 2.5 MB.
SEGMENT_KEYS = 2_000_000
_MOST_LEVELS = 60
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: str) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered; empty for null or no ``://``."""
    host = F.regexp_extract(F.col(url), r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit(""))


def path_of(url: str) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(F.col(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


@dataclass(frozen=True)
class Rule:
    """Fits ``host`` and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def rule_columns(rules: list[Rule], host: str = "host", path: str = "path") -> dict[str, Column]:
    """The longest rule that fits, and its verdict; both null if none does."""
    text = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.text)):
        inside = (F.col(host) == rule.host) | F.col(host).endswith("." + rule.host)
        fits = inside & F.col(path).startswith(rule.path)
        text = F.when(fits, F.lit(rule.text)).otherwise(text)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return {"rule": text, "rule_verdict": verdict}


def listed_by(keys: np.ndarray, cascade: list[bloom.Filter]) -> np.ndarray:
    """Membership of each key hash by the cascade."""
    passed, listed = np.ones(len(keys), dtype=bool), np.zeros(len(keys), dtype=bool)
    for number, level in enumerate(cascade):
        held = np.zeros(len(keys), dtype=bool)
        held[passed] = bloom.lets_through(keys[passed], level)
        listed[passed & ~held] = number % 2 == 1
        passed &= held
    listed[passed] = len(cascade) % 2 == 1
    return listed


def build_cascade(universe: DataFrame, salt: int = 0) -> list[bloom.Filter] | None:
    """The cascade of a table with _key (hash, long) and _listed; None if a listed and an unlisted key share a hash."""
    clash = universe.groupBy("_key").agg(F.min("_listed").alias("a"), F.max("_listed").alias("b")).filter("a <> b")
    if not clash.isEmpty():
        return None
    levels: list[bloom.Filter] = []
    inside, outside = universe.filter("_listed").select("_key"), universe.filter("NOT _listed").select("_key")
    while (count := inside.count()) and len(levels) < _MOST_LEVELS:
        level = bloom.filled(inside, count, salt * 1009 + len(levels))
        wrong, _ = stage(bloom.passing(outside, level), "cascade-level")
        levels.append(level)
        inside, outside = wrong, inside
    return levels


def _judge(cascade):
    """The membership function of a broadcast cascade."""

    @F.pandas_udf("boolean")
    def listed(key: pd.Series) -> pd.Series:
        return pd.Series(listed_by(key.to_numpy(), cascade.value))

    return listed


def with_listed(rows: DataFrame, key: str, universe: DataFrame, name: str = "listed") -> DataFrame:
    """Adds whether ``key`` is listed. ``universe`` has (key, listed): every key of ``rows`` once, none null.

    A null key is not listed. A key that is missing from the universe may be called listed wrongly.
    """
    segments = max(1, math.ceil(universe.filter("listed").count() / SEGMENT_KEYS))
    parts = []
    for segment in range(segments):
        for salt in range(8):
            hashed = lambda c, salt=salt: F.xxhash64(F.lit(salt), F.col(c))
            of_segment = F.pmod(F.xxhash64(F.lit("segment"), F.col("key")), F.lit(segments)) == segment
            own, _ = stage(universe.filter(of_segment).select(hashed("key").alias("_key"),
                                                               F.col("listed").alias("_listed")), "cascade-keys")
            if (levels := build_cascade(own, salt)) is not None:
                break
        else:
            raise RuntimeError("no salt tells the keys apart")
        shared = rows.sparkSession.sparkContext.broadcast(levels)

        mine = F.pmod(F.xxhash64(F.lit("segment"), F.coalesce(F.col(key), F.lit(""))), F.lit(segments)) == segment
        part = rows.filter(mine) if segments > 1 else rows
        parts.append(part.withColumn(name, F.col(key).isNotNull() & _judge(shared)(hashed(key))))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
