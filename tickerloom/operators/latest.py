"""Newest rows, first rows, and the first n rows per key. None of them sorts a whole key in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

SALTS = 64


def latest_with_ties(df: DataFrame, key: str, order: str) -> DataFrame:
    """All rows that carry their key's greatest ``order``."""
    top = df.groupBy(key).agg(F.max(order).alias(order))
    return df.join(top, [key, order]).select(*df.columns)


def latest_date(df: DataFrame, key: str, order: str, name: str = "latest_date") -> DataFrame:
    return df.groupBy(key).agg(F.max(order).alias(name))


def max_date(df: DataFrame, order: str = "Date", name: str = "max_date") -> DataFrame:
    return df.agg(F.max(order).alias(name))


def _pick(df: DataFrame, key: list[str], by: list[str], pick) -> DataFrame:
    rest = [c for c in df.columns if c not in key]
    lead = [c for c in by if c in rest]
    row = F.struct(*lead, *[c for c in rest if c not in lead])
    best = df.groupBy(*key).agg(pick(row).alias("_row"))
    return best.select(*[F.col(c) if c in key else F.col(f"_row.{c}").alias(c) for c in df.columns])


def latest_one(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Exactly one row per key, the greatest by ``order`` (remaining columns break ties)."""
    return _pick(df, key, order, F.max)


def first_one(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Exactly one row per key, the least by ``order`` (remaining columns break ties)."""
    return _pick(df, key, order, F.min)


def cap_per_key(df: DataFrame, key: str, order: list[str], n: int = 100, spread: Column | None = None) -> DataFrame:
    """The first ``n`` rows per key. A key is first cut down within ``SALTS`` parts, then as a whole."""
    salt = F.pmod(spread if spread is not None else F.xxhash64(*order), F.lit(SALTS))
    salted = df.withColumn("_salt", salt)
    part = Window.partitionBy(key, "_salt").orderBy(*order)
    whole = Window.partitionBy(key).orderBy(*order)
    for w in (part, whole):
        salted = salted.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)
    return salted.drop("_rn", "_salt")


def dedupe_headlines(df: DataFrame, key: str = "ticker", seq: str = "seq") -> DataFrame:
    """One row per (ticker, headline key): the first to arrive.

    Rows meet by the key's SHA-256, so that long titles do not travel twice.
    """
    from tickerloom.functions.text import headline_key

    keyed = df.withColumn("_key", F.sha2(headline_key(F.col("title"), F.col("source")), 256))
    return first_one(keyed, [key, "_key"], [seq]).drop("_key")


def first_nonempty_source(df: DataFrame, key: str, priority: str) -> DataFrame:
    """Rows of the best source that has any rows for the key."""
    best = df.groupBy(key).agg(F.min(priority).alias(priority))
    return df.join(best, [key, priority]).select(*df.columns)
