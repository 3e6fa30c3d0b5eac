"""Sorted output, distinct sets and unions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def sort_desc(df: DataFrame, column: str, *ties: str) -> DataFrame:
    return df.orderBy(F.col(column).desc_nulls_last(), *ties)


def newest_first(df: DataFrame, ts: str, *ties: str) -> DataFrame:
    return df.orderBy(F.col(ts).desc_nulls_last(), *ties)


def preview(df: DataFrame, order: list, n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def tickers(df: DataFrame, column: str = "ticker") -> DataFrame:
    return df.select(column).distinct().orderBy(column)


def concat_all(frames: list[DataFrame]) -> DataFrame:
    """All rows of all batches, duplicates kept."""
    return reduce(DataFrame.unionByName, frames)
