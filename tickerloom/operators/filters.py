"""Row filters and validation."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F


class Checked(NamedTuple):
    valid: DataFrame
    rejects: DataFrame


def lookup(df: DataFrame, **keys) -> DataFrame:
    for name, value in keys.items():
        df = df.filter(F.col(name) == F.lit(value))
    return df


def lookup_set(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    return df.join(wanted.select(key), key, "left_semi")


def balances_for(users: DataFrame, wallet: DataFrame) -> DataFrame:
    """Each user's wallet balance, 0 without a wallet."""
    from tickerloom.functions.numbers import to_money

    held = wallet.select("user_id", to_money(F.col("amount")).alias("_held"))
    return users.select("user_id").join(held, "user_id", "left").select(
        "user_id", F.coalesce("_held", F.lit(0).cast("decimal(18,8)")).alias("balance")
    )


def rows_for(df: DataFrame, column: str = "ticker", value: str | None = None) -> DataFrame:
    """Rows of one ticker; no ticker, or ``all``, keeps every row."""
    return df if value in (None, "", "all") else df.filter(F.col(column) == value)


def trailing_days(df: DataFrame, date: str = "Date", days: int = 7) -> DataFrame:
    """Rows of the ``days`` days up to the table's own last date, both ends included."""
    last = df.agg(F.max(date).alias("last")).scalar()
    return df.filter(F.col(date) >= F.date_sub(last, days))


def drop_null(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    return df.dropna("any", subset=subset)


def split_orders(df: DataFrame, viewer_id=None) -> DataFrame:
    side = F.lit("market") if viewer_id is None else F.when(F.col("user_id") == viewer_id, "own").otherwise("market")
    return df.withColumn("side", side)


def search_ticker(df: DataFrame, text: str, column: str = "ticker") -> DataFrame:
    return df.filter(F.upper(column).contains(text.upper()))


def positive(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column) > 0)


def validate(df: DataFrame, rules: list[tuple[str, Column]]) -> Checked:
    """Splits rows by the first rule they break; a rule that is NULL counts as broken."""
    reason = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(why)) for why, ok in rules])
    marked = df.withColumn("reject_reason", reason)
    return Checked(
        marked.filter(F.col("reject_reason").isNull()).drop("reject_reason"),
        marked.filter(F.col("reject_reason").isNotNull()),
    )


def exclude_self_trade(df: DataFrame, buyer: str, seller: str) -> Checked:
    return validate(df, [("own order", F.col(buyer) != F.col(seller))])


def affordable(requests: DataFrame, wallet: DataFrame) -> Checked:
    """Requests (user_id, coins, cost) with coins above 0 whose cost the wallet covers, each taken alone."""
    from tickerloom.functions.numbers import to_money

    held = wallet.select("user_id", to_money(F.col("amount")).alias("balance"))
    checked = requests.join(held, "user_id", "left").withColumn(
        "balance", F.coalesce("balance", F.lit(0).cast("decimal(18,8)"))
    )
    return validate(
        checked, [("coins", F.col("coins") > 0), ("balance", F.col("cost") <= F.col("balance"))]
    )


def covered_by_holding(requests: DataFrame, holdings: DataFrame, keys: list[str]) -> Checked:
    """Sell requests whose coins do not exceed the holding, each taken alone."""
    checked = requests.join(holdings.select(*keys, "remaining_coins"), keys, "left").withColumn(
        "remaining_coins", F.coalesce("remaining_coins", F.lit(0).cast("decimal(28,8)"))
    )
    return validate(
        checked, [("coins", F.col("coins") > 0), ("holding", F.col("coins") <= F.col("remaining_coins"))]
    )


def not_registered(requests: DataFrame, users: DataFrame) -> DataFrame:
    """Requests whose (email, phone) pair no user has."""
    return requests.join(users.select("email", "phone"), ["email", "phone"], "left_anti")


def already_registered(requests: DataFrame, users: DataFrame) -> DataFrame:
    return requests.join(users.select("email", "phone"), ["email", "phone"], "left_semi")
