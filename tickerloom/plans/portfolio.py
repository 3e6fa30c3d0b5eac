"""Holdings, portfolio, history and balances, for one user or for all at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tickerloom.functions.numbers import trade_amount
from tickerloom.operators import aggregates as A
from tickerloom.operators.filters import lookup, positive
from tickerloom.operators.joins import order_availability, tx_with_coin, with_price
from tickerloom.operators.ordering import newest_first


def _of(df: DataFrame, user_id) -> DataFrame:
    return df if user_id is None else lookup(df, user_id=user_id)


def _held(tx: DataFrame | None, user_id, held: DataFrame | None) -> DataFrame:
    return _of(held, user_id) if held is not None else A.held_per_price(_of(tx, user_id))


def portfolio(tx: DataFrame | None, price: DataFrame, user_id=None, held: DataFrame | None = None) -> DataFrame:
    """Coins held per (user, ticker, price) with net cost and market value, positive holdings only.

    Holdings whose price is no number are worth 0. ``held`` may give kept sums (``Book.held``) instead of the log.
    """
    coins = price.select("crypto_price_id", "ticker", "current_price")
    held = with_price(_held(tx, user_id, held), coins)
    valued = positive(A.valuation(held, "user_id", "ticker"), "remaining_coins")
    return valued.withColumn("market_value", F.coalesce("market_value", F.lit(0).cast("decimal(38,8)")))


def portfolio_totals(tx: DataFrame, price: DataFrame, user_id=None) -> DataFrame:
    return A.portfolio_total(portfolio(tx, price, user_id), "user_id")


def sellable(tx: DataFrame | None, price: DataFrame, user_id=None, held: DataFrame | None = None) -> DataFrame:
    """Positive holdings per (user, ticker) with the newest transaction id; ``held`` as for :func:`portfolio`."""
    coins = price.select("crypto_price_id", "ticker")
    held = A.summed_holdings(with_price(_held(tx, user_id, held), coins), "user_id", "ticker")
    return positive(held, "remaining_coins").select("user_id", "ticker", "remaining_coins", "transaction_id")


def swappable(tx: DataFrame, price: DataFrame, user_id=None) -> DataFrame:
    """Positive holdings per coin row, with its price and currency."""
    net = A.net_coins(_of(tx, user_id), ["user_id", "crypto_price_id"], "total")
    return with_price(positive(net, "total"), price).select(
        "user_id", "crypto_price_id", "total", "ticker", "current_price", "fiat_currency"
    )


def user_orders(orders: DataFrame, tx: DataFrame, price: DataFrame, user_id=None) -> DataFrame:
    """Orders with the owner's coins of that ticker and the value they would bring; those of one user newest first."""
    with_coins = order_availability(_of(orders, user_id), _of(tx, user_id), price)
    valued = with_coins.withColumn("order_value", trade_amount(F.col("coins_available"), F.col("price")))
    shown = valued if user_id is None else newest_first(valued, "created_at", "order_id")
    return shown.select(
        "order_id", "user_id", "ticker", "price", "payment_mode", "status", "created_at", "coins_available", "order_value"
    )


def history(tx: DataFrame, price: DataFrame, user_id=None) -> DataFrame:
    """Transactions with their coin's ticker and price."""
    coin = price.select("crypto_price_id", "ticker", "current_price", "fiat_currency")
    return tx_with_coin(_of(tx, user_id), coin)


def coins_of(tx: DataFrame, user_id=None, price_id=None) -> DataFrame:
    chosen = _of(tx, user_id)
    if price_id is not None:
        chosen = lookup(chosen, crypto_price_id=price_id)
    return A.available_coins(chosen, "user_id", "crypto_price_id")


def balance_of(tx: DataFrame, user_id=None) -> DataFrame:
    """Ledger balance per user; asked for one user, an empty ledger gives 0."""
    if user_id is None:
        return A.ledger_balance(tx)
    up = A.sum_where(("buy", "p2p-buy"), "amount") - A.sum_where(("sell", "p2p-sell"), "amount")
    return lookup(tx, user_id=user_id).agg(
        F.lit(user_id).cast("bigint").alias("user_id"),
        F.coalesce(up, F.lit(0)).cast("decimal(30,8)").alias("balance"),
    )


def listing(tx: DataFrame, price: DataFrame, wanted: DataFrame) -> DataFrame:
    """Detail of listed transactions: wanted has a transaction_id column."""
    chosen = tx.join(wanted.select("transaction_id"), "transaction_id", "left_semi")
    return with_price(chosen, price).select(
        "transaction_id", F.col("user_id").alias("seller_id"), "number_of_coins", "amount", "ticker", "current_price"
    )


def user_list(users: DataFrame) -> DataFrame:
    return users.select("user_id", "name", "email", "phone", "status")
