"""Grouped sums, means and spans; each reduces on the map side before its shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tickerloom.functions.numbers import OVERBOUGHT, OVERSOLD, to_money
from tickerloom.functions.text import ticker_clean

COINS = "decimal(28,8)"


def sum_where(kinds, value: str, kind: str = "transaction_type") -> Column:
    chosen = F.col(kind).isin(*([kinds] if isinstance(kinds, str) else kinds))
    return F.sum(F.when(chosen, F.col(value)).otherwise(F.lit(0)))


def rsi_summary(rsi: DataFrame) -> DataFrame:
    """Counts and shares of overbought and oversold rows per ticker."""
    counts = rsi.groupBy("Ticker").agg(
        F.count("RSI").alias("Total"),
        F.sum((F.col("RSI") > OVERBOUGHT).cast("bigint")).alias("Overbought"),
        F.sum((F.col("RSI") < OVERSOLD).cast("bigint")).alias("Oversold"),
    )

    def share(part: str) -> Column:
        return F.try_divide(100.0 * F.coalesce(F.col(part), F.lit(0)), F.col("Total"))

    return counts.fillna(0, ["Overbought", "Oversold"]).withColumns(
        {"OverboughtPercent": share("Overbought"), "OversoldPercent": share("Oversold")}
    )


def holdings(tx: DataFrame, *keys: str, latest_tx: bool = False) -> DataFrame:
    """Coins bought, sold and remaining per key; only plain buys and sells count."""
    extra = [F.max("transaction_id").alias("transaction_id")] if latest_tx else []
    sums = tx.groupBy(*keys).agg(
        sum_where("buy", "number_of_coins").cast(COINS).alias("total_bought"),
        sum_where("sell", "number_of_coins").cast(COINS).alias("total_sold"),
        *extra,
    )
    return sums.withColumn("remaining_coins", (F.col("total_bought") - F.col("total_sold")).cast(COINS))


def held_per_price(tx: DataFrame) -> DataFrame:
    """Sums per (user, price id): what is joined to prices afterwards is one row for each, not the log."""
    return tx.groupBy("user_id", "crypto_price_id").agg(
        sum_where("buy", "number_of_coins").cast(COINS).alias("bought"),
        sum_where("sell", "number_of_coins").cast(COINS).alias("sold"),
        (sum_where("buy", "cost") - sum_where("sell", "cost")).cast("decimal(30,2)").alias("spent"),
        F.max("transaction_id").alias("newest"),
    )


def summed_holdings(held: DataFrame, *keys: str) -> DataFrame:
    """:func:`held_per_price` rows with their price, summed per key."""
    sums = held.groupBy(*keys).agg(
        F.sum("bought").cast(COINS).alias("total_bought"), F.sum("sold").cast(COINS).alias("total_sold"),
        F.sum("spent").cast("decimal(30,2)").alias("net_cost"), F.max("newest").alias("transaction_id"),
    )
    return sums.withColumn("remaining_coins", (F.col("total_bought") - F.col("total_sold")).cast(COINS))


def net_coins(tx: DataFrame, keys: list[str], name: str = "net") -> DataFrame:
    return holdings(tx, *keys).select(*keys, F.col("remaining_coins").alias(name))


def market_value() -> Column:
    # 26 + 18 digits is the widest product that keeps eight decimals.
    return (F.col("remaining_coins").cast("decimal(26,8)") * to_money(F.col("current_price"))).cast("decimal(38,8)")


def valuation(held: DataFrame, *keys: str) -> DataFrame:
    """Holdings with net cost and market value per (keys, current_price), from :func:`held_per_price` rows with prices.

    ``net_cost`` sums the cost column as it is stored: a unit price on some rows, a total on others.
    """
    sums = summed_holdings(held, *keys, "current_price").drop("transaction_id")
    columns = [*keys, "current_price", "total_bought", "total_sold", "net_cost", "remaining_coins"]
    return sums.select(*columns).withColumn("market_value", market_value())


def mean_score(df: DataFrame, name: str = "avg_sentiment_score", key: str = "Ticker") -> DataFrame:
    return df.groupBy(key).agg(F.avg("sentiment_score").alias(name))


def mean_score_clean(scores: DataFrame) -> DataFrame:
    return scores.groupBy(ticker_clean(F.col("ticker")).alias("ticker_clean")).agg(
        F.avg("avg_sentiment_score").alias("avg_sentiment_score"),
        F.avg("avg_sentiment_score1").alias("avg_sentiment_score1"),
    )


def available_coins(tx: DataFrame, *keys: str) -> DataFrame:
    """Net coins per key, NULL unless above zero."""
    net = net_coins(tx, list(keys), "_net")
    return net.select(*keys, F.when(F.col("_net") > 0, F.col("_net")).alias("available_coins"))


def ledger_balance(tx: DataFrame) -> DataFrame:
    """Signed sum of amounts per user: both buy types count up, both sell types down."""
    up, down = sum_where(("buy", "p2p-buy"), "amount"), sum_where(("sell", "p2p-sell"), "amount")
    return tx.groupBy("user_id").agg((up - down).cast("decimal(30,8)").alias("balance"))


def portfolio_total(portfolio: DataFrame, *keys: str) -> DataFrame:
    return portfolio.groupBy(*keys).agg(
        F.coalesce(F.sum("market_value"), F.lit(0)).cast("decimal(38,8)").alias("total_market_value")
    )


def news_span(news: DataFrame, ts: str = "date_time") -> DataFrame:
    """First and last time and the whole days between them, over rows with a time."""
    span = news.filter(F.col(ts).isNotNull()).groupBy("ticker").agg(
        F.min(ts).alias("from_date"), F.max(ts).alias("to_date")
    )
    gap = F.unix_micros("to_date") - F.unix_micros("from_date")
    return span.withColumn("days", F.floor(gap / F.lit(86_400_000_000)).cast("bigint"))
