"""Ledger events applied to whole tables: (tables, batch of requests) -> (new tables, rejects).

``wallet`` has one row per user and holds its amount as text; results hold it as a decimal. The transaction log
is keyed by ``transaction_id``; a request's ``request_id`` becomes the id of the row it logs.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window, functions as F

from tickerloom.functions.numbers import swap_quantity, swap_value, to_money, trade_amount, unit_cost
from tickerloom.functions.text import canonical_status
from tickerloom.operators.filters import not_registered, validate
from tickerloom.operators.joins import left_join_known, price_id_for
from tickerloom.operators.latest import first_one, latest_one
from tickerloom.operators.ordered import staged_ranks, union_all
from tickerloom.operators.settlement import AMOUNT, ROW, bits, marked_by, outcomes, settle
from tickerloom.operators.swaps import matched_in_turn
from tickerloom.schemas import PAYMENT_MODES
from tickerloom.session import discard, in_parts, stage, staged, staged_parts

LOG = ("transaction_id", "user_id", "crypto_price_id", "number_of_coins", "amount", "cost",
       "transaction_type", "created_at")
COIN, SUM = "decimal(30,8)", "decimal(38,8)"
UNVERIFIED, VERIFIED = "not verified", "verified"


class Outcome(NamedTuple):
    """New tables after a batch; a table the batch does not touch is None.

    ``transactions`` is the log without the rows of ``retracted`` (as they stood, None for none) and with those of ``logged``.
    """

    wallet: DataFrame | None = None
    transactions: DataFrame | None = None
    orders: DataFrame | None = None
    rejects: DataFrame | None = None
    users: DataFrame | None = None
    logged: DataFrame | None = None
    retracted: DataFrame | None = None


def balances(wallet: DataFrame) -> DataFrame:
    """The amounts as numbers; those of a wallet that a batch has given out are numbers already."""
    amount = to_money(F.col("amount")) if dict(wallet.dtypes)["amount"] == "string" else F.col("amount")
    return wallet.select("user_id", amount.cast(SUM).alias("amount"))


def apply_deltas(wallet: DataFrame, deltas: DataFrame) -> DataFrame:
    """Adds the sum of (user_id, delta) to each wallet; a user without a wallet gets one, starting at 0."""
    moved = deltas.groupBy("user_id").agg(F.sum("delta").cast(SUM).alias("_moved"))
    held = balances(wallet).withColumnRenamed("amount", "_held")
    zero = F.lit(0).cast(SUM)
    return held.join(moved, "user_id", "full").select(
        "user_id", (F.coalesce("_held", zero) + F.coalesce("_moved", zero)).cast(SUM).alias("amount")
    )


def ensure_wallet(wallet: DataFrame, users: DataFrame) -> DataFrame:
    return apply_deltas(wallet, users.select("user_id", F.lit(0).cast(COIN).alias("delta")))


def _positive(name: str):
    return (name, F.col(name) > 0)


def deposit(wallet: DataFrame, requests: DataFrame) -> Outcome:
    """requests: request_id, user_id, amount."""
    ok, bad = validate(requests, [("user_id", F.col("user_id").isNotNull()), _positive("amount")])
    return Outcome(wallet=apply_deltas(wallet, ok.select("user_id", F.col("amount").cast(COIN).alias("delta"))), rejects=bad)


def withdraw(wallet: DataFrame, requests: DataFrame, floor: bool = False) -> Outcome:
    """requests: request_id, request_ts, user_id, amount. ``floor`` refuses what the wallet cannot cover then."""
    ok, bad = validate(requests, [("user_id", F.col("user_id").isNotNull()), _positive("amount")])
    if floor:
        asked = ok.select(
            "request_ts", "request_id", F.col("user_id").alias("payer"), F.lit(None).cast("bigint").alias("payee"),
            F.col("amount").alias("debit"), F.lit(0).alias("credit"), F.lit(True).alias("checked"),
            F.lit(None).cast("string").alias("item"), F.lit(None).cast("string").alias("blocked"),
        )
        settled = stage(settle(asked, balances(wallet).withColumnRenamed("amount", "balance")), "withdrawn")
        verdict = ok.join(settled.select("request_id", "accepted", "reject_reason"), "request_id")
        ok = verdict.filter("accepted").drop("accepted", "reject_reason")
        bad = bad.unionByName(verdict.filter(~F.col("accepted")).drop("accepted"))
    return Outcome(wallet=apply_deltas(wallet, ok.select("user_id", (-F.col("amount")).cast(COIN).alias("delta"))), rejects=bad)


def _logged(requests: DataFrame, kind: str, user, coins, amount, cost) -> DataFrame:
    return requests.select(
        F.col("request_id").cast("decimal(38,0)").alias("transaction_id"),
        user.alias("user_id"),
        F.col("crypto_price_id"),
        coins.cast(COIN).alias("number_of_coins"),
        amount.cast(COIN).alias("amount"),
        cost.cast(COIN).alias("cost"),
        F.lit(kind).alias("transaction_type"),
        F.col("request_ts").alias("created_at"),
    )


def log_rows(tx: DataFrame) -> DataFrame:
    """The log in the width all new rows have."""
    return tx.select(*[
        F.col(c).cast(COIN).alias(c) if c in ("number_of_coins", "amount", "cost") else F.col(c) for c in LOG
    ])


def _once(requests: DataFrame) -> DataFrame:
    """Adds ``_again``, if it is not there: whether the request's id came before (by time; equal rows in any order)."""
    if "_again" in requests.columns:
        return requests
    order = Window.partitionBy("request_id").orderBy("request_ts", F.xxhash64(*requests.columns))
    return requests.withColumn("_again", F.row_number().over(order) > 1)


def _checked_trades(requests: DataFrame, *amounts: str):
    """Trades of a known user, with positive numbers, and of repeated ids the first."""
    rules = [("user_id", F.col("user_id").isNotNull()), *map(_positive, amounts)]
    ok, bad = validate(_once(requests), [*rules, ("request_id repeats", ~F.col("_again"))])
    return ok.drop("_again"), bad.drop("_again")


def buy(tx: DataFrame, wallet: DataFrame, requests: DataFrame) -> Outcome:
    """requests: request_id, request_ts, user_id, crypto_price_id, coins, amount. Cost is the unit price."""
    ok, bad = _checked_trades(requests, "coins", "amount")
    new = _logged(ok, "buy", F.col("user_id"), F.col("coins"), F.col("amount"), unit_cost(F.col("amount"), F.col("coins")))
    paid = ok.select("user_id", (-F.col("amount")).cast(COIN).alias("delta"))
    return Outcome(apply_deltas(wallet, paid), log_rows(tx).unionByName(new), rejects=bad, logged=new)


def sell(tx: DataFrame, wallet: DataFrame, requests: DataFrame) -> Outcome:
    """requests: request_id, request_ts, user_id, crypto_price_id, coins, cost (the unit price)."""
    ok, bad = _checked_trades(requests, "coins", "cost")
    earned = trade_amount(F.col("coins"), F.col("cost"))
    new = _logged(ok, "sell", F.col("user_id"), F.col("coins"), earned, F.col("cost"))
    got = ok.select("user_id", earned.cast(COIN).alias("delta"))
    return Outcome(apply_deltas(wallet, got), log_rows(tx).unionByName(new), rejects=bad, logged=new)


#: What a book writes once before these run, as all of an outcome reads it.
buy.prepared = sell.prepared = _once


def buy_listed(tx: DataFrame, wallet: DataFrame, price: DataFrame, requests: DataFrame) -> Outcome:
    """requests: request_id, request_ts, buyer_id, transaction_id, payment_type ('wallet' or other).

    Logs a buy at coins x current price, turns the listed row into a sell, and debits a wallet payer, who may go
    below zero.
    """
    coin = price.select("crypto_price_id", "ticker", to_money(F.col("current_price")).alias("_price"))
    requests = stage(requests, "asked")
    # Only rows that are asked for go on to their prices.
    listed = (
        tx.select("transaction_id", F.col("user_id").alias("seller_id"), "crypto_price_id", "number_of_coins", "amount")
        .join(requests.select("transaction_id"), "transaction_id", "left_semi")
        .join(coin, "crypto_price_id")
        .drop("crypto_price_id")
    )
    asked = stage(left_join_known(requests, listed, "transaction_id"), "listed")
    ok, bad = validate(
        asked,
        [("transaction not found", F.col("seller_id").isNotNull()), ("own order", F.col("buyer_id") != F.col("seller_id"))],
    )
    ok = price_id_for(ok, price).withColumn("_total", trade_amount(F.col("number_of_coins"), F.col("_price")))
    new = _logged(ok, "buy", F.col("buyer_id"), F.col("number_of_coins"), F.col("amount"), F.col("_total"))
    sold, _ = staged(ok.select("transaction_id", F.lit(True).alias("_sold")).distinct(), "sold")
    retyped = (
        log_rows(tx)
        .join(sold, "transaction_id", "left")
        .withColumn("transaction_type", F.when(F.col("_sold"), "sell").otherwise(F.col("transaction_type")))
        .select(*LOG)
    )
    before = log_rows(tx).join(sold, "transaction_id", "left_semi").select(*LOG)
    after = before.withColumn("transaction_type", F.lit("sell"))
    debit = ok.filter(F.col("payment_type") == "wallet").select(
        F.col("buyer_id").alias("user_id"), (-F.col("_total")).cast(COIN).alias("delta")
    )
    kept = [*requests.columns, "reject_reason"]
    return Outcome(apply_deltas(wallet, debit), retyped.unionByName(new), rejects=bad.select(*kept),
                   logged=after.unionByName(new), retracted=before)


def settle_p2p(orders: DataFrame, tx: DataFrame, wallet: DataFrame, price: DataFrame, requests: DataFrame) -> Outcome:
    """requests: request_id, request_ts, buyer_id, order_id; the outcome is that of one request after another.

    A wallet order moves its price from buyer to seller and logs a buy and a p2p-sell of one coin; a bank order
    logs the buy only. The order is then gone.
    """
    book = orders.select("order_id", F.col("user_id").alias("seller_id"), "ticker", "price", "payment_mode")
    asked = left_join_known(requests, book, "order_id")
    by_wallet = F.col("payment_mode") == "Wallet"
    zero = F.lit(0).cast(AMOUNT)
    terms = {
        "payer": F.col("buyer_id"),
        "payee": F.col("seller_id"),
        "debit": F.when(by_wallet, F.col("price")).otherwise(zero),
        "credit": F.when(by_wallet, F.col("price")).otherwise(zero),
        "checked": F.coalesce(by_wallet, F.lit(False)),
        "item": F.col("order_id"),
        "blocked": F.when(F.col("seller_id").isNull(), "order not found")
        .when(F.col("buyer_id") == F.col("seller_id"), "own order")
        .when(~F.col("payment_mode").isin(*PAYMENT_MODES), "payment mode"),
    }
    held = balances(wallet).withColumnRenamed("amount", "balance")
    went, stayed = outcomes([asked], held, terms=lambda df: df.withColumns(terms))
    won = price_id_for(went, price)
    one = F.lit(1)
    bought = _logged(won, "buy", F.col("buyer_id"), one, F.col("price"), F.col("price"))
    # The seller's row needs an id of its own: the negative of the buyer's.
    sold = _logged(
        won.filter(by_wallet).withColumn("request_id", -F.col("request_id")),
        "p2p-sell", F.col("seller_id"), one, F.col("price"), F.col("price"),
    )
    moves = F.when(by_wallet, F.col("price")).otherwise(zero).cast(COIN)
    legs = won.select(
        F.inline(F.array(
            F.struct(F.col("buyer_id").alias("user_id"), (-moves).cast(COIN).alias("delta")),
            F.struct(F.col("seller_id").alias("user_id"), moves.alias("delta")),
        ))
    )
    return Outcome(
        apply_deltas(wallet, legs),
        union_all([log_rows(tx), bought, sold]),
        remove_orders(orders, won.select("order_id")),
        stayed.select(*requests.columns, "reject_reason"),
        logged=bought.unionByName(sold),
    )


def list_or_buy(orders: DataFrame, tx: DataFrame, wallet: DataFrame, requests: DataFrame) -> Outcome:
    """requests: request_id, request_ts, user_id, transaction_id, ticker, price, payment_mode.

    The owner's request lists the transaction as p2p-sell with a pending order; anyone else's buys it at
    coins x price if the wallet covers that, pays the owner in wallet mode, and completes its orders so far.
    """
    ok, bad = validate(
        requests,
        [
            ("ticker", F.col("ticker").isNotNull()),
            _positive("price"),
            ("payment_mode", F.col("payment_mode").isin(*PAYMENT_MODES)),
            ("transaction_id", F.col("transaction_id").isNotNull()),
        ],
    )
    # Rows that share an id are one row of the log.
    owners = tx.groupBy("transaction_id").agg(F.min(F.struct("user_id", "number_of_coins")).alias("own")).select(
        "transaction_id", F.col("own.user_id").alias("owner_id"), "own.number_of_coins")
    # A transaction's requests meet their owner, and later what became of it, some transactions after others.
    count = ok.count()
    some = in_parts(count, "transaction_id")
    asked = [ok.filter(own).join(owners.filter(own), "transaction_id", "left") for own in some]
    zero = F.lit(0).cast(AMOUNT)
    buying = ~F.col("listing")
    terms = {
        "payer": F.col("user_id"),
        "payee": F.col("owner_id"),
        "debit": F.when(buying, F.col("amount")).otherwise(zero),
        "credit": F.when(buying & (F.col("payment_mode") == "Wallet"), F.col("amount")).otherwise(zero),
        "checked": F.coalesce(buying, F.lit(False)),
        "item": F.lit(None).cast("decimal(38,0)"),
        "blocked": F.when(F.col("owner_id").isNull(), "transaction not found"),
    }

    def seen(df: DataFrame) -> DataFrame:
        df = df.withColumns({"amount": trade_amount(F.col("number_of_coins"), F.col("price")), "listing": F.col("owner_id") == F.col("user_id")})
        return df.withColumns(terms)

    went, stayed = outcomes(asked, balances(wallet).withColumnRenamed("amount", "balance"), terms=seen)
    seq = F.struct("request_ts", "request_id")

    def ended(went: DataFrame) -> DataFrame:
        last = went.groupBy("transaction_id").agg(
            F.max(F.struct("request_ts", "request_id", "listing")).getField("listing").alias("_listed_last"),
            F.max(F.when(F.col("listing"), F.struct("request_ts", "request_id", "price", "amount"))).alias("_list"),
            F.max(F.when(buying, seq)).isNotNull().alias("_sold"),
        )
        return last.select("transaction_id", "_listed_last", "_sold", F.col("_list.price").alias("_price"), F.col("_list.amount").alias("_amount"))

    def completed(went: DataFrame) -> DataFrame:
        bought = went.filter(buying).groupBy("transaction_id").agg(F.max(seq).alias("_bought"))
        return went.filter("listing").join(bought, "transaction_id").filter(F.col("_bought") > seq).select(ROW)

    last, _ = staged_parts([ended(went.filter(own)) for own in some], "listed-last")
    done, at_done = staged_parts([completed(went.filter(own)) for own in some], "completed")
    done = stage(bits(done, ROW), "completed-rows")
    discard(tx.sparkSession, at_done)
    touched = log_rows(tx).join(last, "transaction_id", "left")
    new_tx = (
        touched
        .withColumns(
            {
                "cost": F.coalesce(F.col("_price").cast(COIN), F.col("cost")),
                "amount": F.coalesce(F.col("_amount").cast(COIN), F.col("amount")),
                "transaction_type": F.when(F.col("_listed_last"), "p2p-sell")
                .when(F.col("_sold"), "buy")
                .otherwise(F.col("transaction_type")),
            }
        )
        .select(*LOG)
    )
    sold = last.filter("_sold").select("transaction_id", "_sold")
    old = (
        left_join_known(orders, sold, "transaction_id")
        .withColumn("status", F.when(F.col("_sold"), "completed").otherwise(F.col("status")))
        .drop("_sold")
    )
    opened = (
        marked_by(went.filter("listing"), ROW, done, count)
        .select(
            F.col("request_id").cast("decimal(38,0)").alias("order_id"), "user_id", "ticker",
            F.col("price").cast(COIN).alias("price"), "payment_mode",
            F.when(F.col("_marked"), "completed").otherwise("pending").alias("status"),
            F.col("request_ts").alias("created_at"), F.col("transaction_id").cast("decimal(38,0)").alias("transaction_id"),
        )
    )
    old = old.select(
        F.col("order_id").cast("decimal(38,0)").alias("order_id"), "user_id", "ticker",
        F.col("price").cast(COIN).alias("price"), "payment_mode", "status", "created_at",
        F.col("transaction_id").cast("decimal(38,0)").alias("transaction_id"),
    )
    paid = went.filter(buying).select(
        F.inline(F.array(
            F.struct(F.col("payer").alias("user_id"), (-F.col("debit")).cast(COIN).alias("delta")),
            F.struct(F.col("payee").alias("user_id"), F.col("credit").cast(COIN).alias("delta")),
        ))
    ).filter(F.col("delta") != 0)
    turned_down = stayed.select(*requests.columns, "reject_reason")
    ids = last.select("transaction_id")
    return Outcome(apply_deltas(wallet, paid), new_tx, old.unionByName(opened), bad.unionByName(turned_down),
                   logged=new_tx.join(ids, "transaction_id", "left_semi").select(*LOG),
                   retracted=log_rows(tx).join(ids, "transaction_id", "left_semi").select(*LOG))


def swap(tx: DataFrame, requests: DataFrame) -> Outcome:
    """requests: request_id, request_ts, user_id, from_coin, to_coin, from_qty, from_price, to_price.

    A swap rewrites the user's buy row of the coin with the least id, as the log stands after the swaps before it. For most
    users that is the k-th buy row for the k-th swap of a coin, matched for all at once. Only users who also swap away
    coins that the batch brings them are followed in order (:mod:`tickerloom.operators.swaps`).
    """
    trades, at_trades = staged(_once(requests), "trades")
    ok, bad = _checked_trades(trades, "from_qty", "from_price", "to_price")
    pair, spark = ["user_id", "crypto_price_id"], tx.sparkSession
    given = ok.select("user_id", F.col("from_coin").alias("crypto_price_id")).distinct()
    gained = ok.select("user_id", F.col("to_coin").alias("crypto_price_id")).distinct()
    chained, at_chained = staged(given.join(gained, pair, "left_semi").select("user_id").distinct(), "chained")
    held = tx.filter(F.col("transaction_type") == "buy").join(given, pair, "left_semi").select(*pair, "transaction_id")
    held, at_held = staged(held.distinct(), "held-buys")  # rows that share an id are one row of the log
    ranked, at_ranked = staged_ranks(
        ok.join(chained, "user_id", "left_anti").select("user_id", F.col("from_coin").alias("crypto_price_id"), "request_ts", "request_id"),
        pair, ["request_ts", "request_id"], "_k")
    rows, at_rows = staged_ranks(held.join(chained, "user_id", "left_anti"), pair, ["transaction_id"], "_k")
    at_once = ranked.join(rows, [*pair, "_k"], "left").select("request_id", "transaction_id")
    in_turn, at_turn = matched_in_turn(ok.join(chained, "user_id", "left_semi"), held.join(chained, "user_id", "left_semi"))
    matched, at_matched = staged_parts([at_once, in_turn], "swaps")
    discard(spark, at_held, at_ranked, at_rows, at_chained, at_turn)
    # Requests meet their rows, and rows the last of their requests, some after others.
    count = matched.count()
    found = [(ok.filter(own), matched.filter(own)) for own in in_parts(count, "request_id")]
    told, at_told = staged_parts([asked.join(rows.filter(F.col("transaction_id").isNotNull()), "request_id").select(
        "transaction_id", "request_ts", "request_id", F.col("to_coin").alias("_coin"),
        swap_value(F.col("from_qty"), F.col("from_price")).alias("_value"),
        swap_quantity(F.col("from_qty"), F.col("from_price"), F.col("to_price")).alias("_coins"),
        F.col("to_price").cast(COIN).alias("_cost"),
    ) for asked, rows in found], "told")
    unmet = [asked.join(rows.filter(F.col("transaction_id").isNull()).select("request_id"), "request_id", "left_semi") for asked, rows in found]
    unmet = [asked.withColumn("reject_reason", F.lit("no buy to swap")).select(*bad.columns) for asked in unmet]
    rejects, _ = staged_parts([bad, *unmet], "unswapped")
    discard(spark, at_matched, at_trades)
    change, _ = staged_parts([latest_one(told.filter(own), ["transaction_id"], ["request_ts", "request_id"]).drop("request_ts", "request_id")
                              for own in in_parts(count, "transaction_id")], "swapped")
    discard(spark, at_told)
    new_tx = (
        log_rows(tx)
        .join(change, "transaction_id", "left")
        .withColumns(
            {
                "crypto_price_id": F.coalesce("_coin", "crypto_price_id"),
                "number_of_coins": F.coalesce("_coins", "number_of_coins"),
                "amount": F.coalesce("_value", "amount"),
                "cost": F.coalesce("_cost", "cost"),
            }
        )
        .select(*LOG)
    )
    ids = change.select("transaction_id")
    return Outcome(transactions=new_tx, rejects=rejects, logged=new_tx.join(ids, "transaction_id", "left_semi").select(*LOG),
                   retracted=log_rows(tx).join(ids, "transaction_id", "left_semi").select(*LOG))


def set_status(users: DataFrame, events: DataFrame) -> DataFrame:
    """events: user_id, event_ts, event_id, status; each user's newest event decides."""
    newest = latest_one(events.select("user_id", "event_ts", "event_id", "status"), ["user_id"], ["event_ts", "event_id"])
    change = newest.select("user_id", canonical_status(F.col("status")).alias("_status"))
    return (
        users.join(change, "user_id", "left")
        .withColumn("status", F.coalesce("_status", canonical_status(F.col("status"))))
        .select(*users.columns)
    )


def register(users: DataFrame, requests: DataFrame) -> Outcome:
    """requests: request_id, name, email, phone. ``users`` of the outcome holds the new ones only.

    Rejected: missing fields, a known (email, phone) pair, a known email, and all but the first of an email.
    """
    ok, bad = validate(requests, [(c, F.col(c).isNotNull() & (F.trim(c) != "")) for c in ("name", "email", "phone")])
    fresh = not_registered(ok, users).join(users.select("email"), "email", "left_anti")
    first = first_one(fresh, ["email"], ["request_id"])
    added = first.select("request_id", "name", "email", "phone", F.lit(UNVERIFIED).alias("status"))
    skipped = ok.join(first.select("request_id"), "request_id", "left_anti").withColumn(
        "reject_reason", F.lit("already registered")
    )
    return Outcome(users=added, rejects=bad.unionByName(skipped.select(*bad.columns)))


def remove_orders(orders: DataFrame, consumed: DataFrame) -> DataFrame:
    return orders.join(consumed.select("order_id"), "order_id", "left_anti")


def register_icon(icons: DataFrame, names: DataFrame) -> DataFrame:
    return icons.select("image_name").unionByName(names.select("image_name"))
