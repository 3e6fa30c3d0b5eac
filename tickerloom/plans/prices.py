"""RSI series and summary, daily change, latest prices, chart data."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tickerloom.functions.numbers import OVERBOUGHT, OVERSOLD, round_half_even, rsi_level
from tickerloom.functions.text import split_ticker
from tickerloom.operators.aggregates import rsi_summary
from tickerloom.operators.filters import drop_null, trailing_days
from tickerloom.operators.indicators import pct_change, rsi, unique_bars
from tickerloom.operators.latest import latest_one
from tickerloom.operators.reshape import wide_to_long
from tickerloom.session import stage


def rsi_series(bars: DataFrame, period: int = 14, unique: bool = False) -> DataFrame:
    """Bars with their RSI. ``unique=True`` says that no (ticker, day) repeats."""
    return rsi(bars if unique else unique_bars(bars), period)


def rsi_report(bars: DataFrame, period: int = 14, unique: bool = False) -> DataFrame:
    return rsi_summary(rsi_series(bars, period, unique))


def rsi_chart_data(rated: DataFrame, days: int = 7) -> DataFrame:
    """The last week's RSI points with their level and the two reference lines.

    The series is written once, as both its last day and its rows are read.
    """
    return trailing_days(stage(rated.select("Date", "Ticker", "RSI"), "rated"), "Date", days).select(
        "Date", "Ticker", "RSI", rsi_level(F.col("RSI")).alias("level"),
        F.lit(OVERBOUGHT).cast("double").alias("overbought_at"), F.lit(OVERSOLD).cast("double").alias("oversold_at"),
    )


def daily_change(wide: DataFrame, tickers: list[str]) -> DataFrame:
    """Long bars with the change to the day before; rows with a gap in any column are dropped."""
    return drop_null(pct_change(unique_bars(wide_to_long(wide, tickers))))


def bar_changes(bars: DataFrame, unique: bool = False) -> DataFrame:
    return drop_null(pct_change(bars if unique else unique_bars(bars)))


def latest_prices(bars: DataFrame) -> DataFrame:
    """One row per ticker, split into coin and currency, with the last close to two digits as text."""
    last = latest_one(bars.select("Ticker", "Date", "Close"), ["Ticker"], ["Date"])
    coin, fiat = split_ticker(F.col("Ticker"))
    price = round_half_even(F.col("Close")).cast("string")
    return last.select(coin.alias("ticker"), price.alias("current_price"), fiat.alias("fiat_currency"))
