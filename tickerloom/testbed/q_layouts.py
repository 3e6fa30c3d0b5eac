"""Queries over tables that are laid out by day or by user first; each gives what its plain form gives."""

from __future__ import annotations

import uuid

from tickerloom.operators import aggregates as A, joins as J
from tickerloom.operators.indicators import rsi
from tickerloom.session import work_path
from tickerloom.sources import layout
from tickerloom.sources.versions import Store
from tickerloom.testbed.q_groups import HOLDINGS_SQL
from tickerloom.testbed.registry import day, query, rounded


def _by_user(v, rows, buckets: int):
    name = f"by_user_{uuid.uuid4().hex}"
    return layout.save_by_user(rows, name, work_path(v.spark, name), buckets)


@query("f3_trailing_days_laid_out", "rsi", f"""
SELECT "Ticker", {day('"Date"')} AS "Date", round("RSI", 6) AS "RSI" FROM rsi WHERE "Date" >= (SELECT max("Date") FROM rsi) - 7""")
def _(v):
    store = Store(v.spark, work_path(v.spark, "by-day"))
    layout.load_by_day(store, "rsi", rsi(v.prices()).select("Ticker", "Date", "RSI"), ranges=16)
    return rounded(layout.trailing_days(store, "rsi"), 6, "RSI")


@query("j4_orders_laid_out", "p2p_orders users", "SELECT order_id, user_id, name AS user_name, email FROM p2p_orders JOIN users USING (user_id)")
def _(v):
    buckets = layout.buckets_for(v.p2p_orders().count(), v.users().count())
    orders, users = _by_user(v, v.p2p_orders().drop("transaction_id"), buckets), _by_user(v, v.users(), buckets)
    return J.orders_with_seller(orders, users).select("order_id", "user_id", "user_name", "email")


@query("a2_holdings_laid_out", "transactions", HOLDINGS_SQL)
def _(v):
    # Each line is a transaction; counting lines reads no data.
    return A.holdings(_by_user(v, v.transactions(), layout.buckets_for(v._table("lineitem").count())), "user_id", "crypto_price_id")
