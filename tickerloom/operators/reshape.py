"""Wide and long price tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tickerloom.schemas import BAR_FIELDS


def wide_to_long(df: DataFrame, tickers: list[str], fields=BAR_FIELDS, date: str = "Date") -> DataFrame:
    """One row per (date, ticker) from columns named ``<ticker>|<field>``, in one pass without a shuffle.

    A (date, ticker) without any value is left out.
    """
    entry = [
        F.struct(F.lit(t).alias("Ticker"), *[F.col(f"`{t}|{f}`").alias(f) for f in fields]) for t in tickers
    ]
    long = df.select(date, F.inline(F.array(*entry)))
    return long.filter(F.coalesce(*[F.col(f).cast("double") for f in fields]).isNotNull())


def long_to_wide(df: DataFrame, tickers: list[str], fields=BAR_FIELDS, date: str = "Date") -> DataFrame:
    cells = [
        F.max(F.when(F.col("Ticker") == t, F.col(f))).alias(f"{t}|{f}") for t in tickers for f in fields
    ]
    return df.groupBy(date).agg(*cells)


def flatten_names(df: DataFrame, names: list[str]) -> DataFrame:
    return df.toDF(*names)
