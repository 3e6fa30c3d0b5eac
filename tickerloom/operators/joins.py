"""Joins. No side is forced into a broadcast: Spark decides by measured size and splits skewed partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tickerloom.functions.numbers import to_money
from tickerloom.functions.text import icon_ticker, ticker_clean
from tickerloom.operators.aggregates import held_per_price, mean_score_clean, summed_holdings


def left_join_known(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Left join that spreads rows without a key over all tasks; they match nothing and would else meet in one."""
    spread = F.when(F.col(key).isNull(), F.pmod(F.xxhash64(*df.columns), F.lit(1024))).otherwise(F.lit(0))
    # Always 0, but not a constant to the optimizer, which would take it out of the join's keys.
    zero = F.pmod(F.xxhash64(key), F.lit(1))
    left, right = df.withColumn("_spread", spread.cast("bigint")), other.withColumn("_spread", zero.cast("bigint"))
    return left.join(right, [key, "_spread"], "left").drop("_spread")


def with_sentiment(board: DataFrame, scores: DataFrame) -> DataFrame:
    """Board rows with their ticker's mean scores; tickers meet without dashes."""
    keyed = board.withColumn("ticker_clean", ticker_clean(F.col("ticker")))
    return keyed.join(mean_score_clean(scores), "ticker_clean", "left").drop("ticker_clean")


def with_icon(board: DataFrame, icons: DataFrame) -> DataFrame:
    """Board rows with their icon; several icons for a ticker repeat the row."""
    named = icons.select(icon_ticker(F.col("image_name")).alias("ticker_clean"), "image_name")
    keyed = board.withColumn("ticker_clean", ticker_clean(F.col("ticker")))
    return keyed.join(named, "ticker_clean", "left").drop("ticker_clean")


def orders_with_seller(orders: DataFrame, users: DataFrame) -> DataFrame:
    seller = users.select("user_id", F.col("name").alias("user_name"), "email")
    return orders.join(seller, "user_id")


def with_price(tx: DataFrame, price: DataFrame) -> DataFrame:
    return tx.join(price, "crypto_price_id")


def tx_with_coin(tx: DataFrame, price: DataFrame) -> DataFrame:
    """Every transaction with its coin's row, if there is one."""
    return left_join_known(tx, price, "crypto_price_id")


def order_availability(orders: DataFrame, tx: DataFrame, price: DataFrame) -> DataFrame:
    """Orders with their owner's net coins of the ordered ticker, 0 without transactions."""
    held = with_price(held_per_price(tx), price.select("crypto_price_id", "ticker"))
    net = summed_holdings(held, "user_id", "ticker").select("user_id", "ticker", F.col("remaining_coins").alias("_net"))
    return (
        orders.join(net, ["user_id", "ticker"], "left")
        .withColumn("coins_available", F.coalesce("_net", F.lit(0).cast("decimal(28,8)")))
        .drop("_net")
    )


def price_id_for(df: DataFrame, price: DataFrame) -> DataFrame:
    """Adds the ticker's least price id; NULL for an unknown ticker."""
    ids = price.groupBy("ticker").agg(F.min("crypto_price_id").alias("crypto_price_id"))
    return df.join(ids, "ticker", "left")


def merge_means(daily: DataFrame, recent: DataFrame) -> DataFrame:
    return daily.join(recent, "Ticker")


def existing(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    return df.join(other.select(key), key, "left_semi")


def missing(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    return df.join(other.select(key), key, "left_anti")


def priced(price: DataFrame) -> DataFrame:
    """The price table with its text price as a number beside it."""
    return price.withColumn("price", to_money(F.col("current_price")))
