"""The market board and the peer-to-peer market."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tickerloom.functions.numbers import change_class, change_label, round_half_up, thousands
from tickerloom.functions.sentiment import sentiment_label
from tickerloom.operators.filters import split_orders
from tickerloom.operators.joins import orders_with_seller, with_icon, with_sentiment
from tickerloom.operators.latest import latest_with_ties
from tickerloom.operators.ordering import newest_first, sort_desc, tickers


def market_board(bars: DataFrame, scores: DataFrame, icons: DataFrame) -> DataFrame:
    """Latest bar per ticker with mean sentiment and icon, best change first."""
    last = latest_with_ties(
        bars.select(F.col("Ticker").alias("ticker"), "Date", "Open", "Volume", "percentage_change"), "ticker", "Date"
    )
    board = with_icon(with_sentiment(last, scores), icons)
    change, day, recent = F.col("percentage_change"), F.col("avg_sentiment_score"), F.col("avg_sentiment_score1")
    shown = board.select(
        "ticker", round_half_up(F.col("Open")).alias("open"), thousands(F.col("Volume")).alias("volume"),
        "percentage_change", change_label(change).alias("change_label"), change_class(change).alias("change_class"),
        "avg_sentiment_score", sentiment_label(day).alias("sentiment"),
        "avg_sentiment_score1", sentiment_label(recent).alias("sentiment1"), "image_name",
    )
    return sort_desc(shown, "percentage_change", "ticker", "image_name")


def p2p_listing(orders: DataFrame, users: DataFrame, viewer_id=None) -> DataFrame:
    """All orders with their seller, newest first, marked as the viewer's own or the market's."""
    listed = orders_with_seller(orders, users).select(
        "order_id", "user_id", "user_name", "email", "ticker", "price", "payment_mode", "status", "created_at"
    )
    return newest_first(split_orders(listed, viewer_id), "created_at", "order_id")


def market_tickers(listing: DataFrame) -> DataFrame:
    return tickers(listing.filter(F.col("side") == "market"))
