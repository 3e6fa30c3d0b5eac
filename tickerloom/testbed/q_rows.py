"""Filters (F, V), joins (J), sorts (O) and sets (D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickerloom import schemas
from tickerloom.operators import filters as R, joins as J
from tickerloom.operators.aggregates import holdings, mean_score
from tickerloom.operators.indicators import rsi
from tickerloom.operators.latest import first_one, latest_one, latest_with_ties
from tickerloom.operators.ordering import concat_all, newest_first, preview, sort_desc, tickers
from tickerloom.functions.sentiment import sentiment_from_logits
from tickerloom.testbed.q_columns import SCORE_SQL
from tickerloom.testbed.registry import day, moment, query, rounded

ID = "cast(transaction_id AS varchar) AS transaction_id"


@query("f1_key_lookup", "p2p_orders", "SELECT order_id, user_id, price::double AS price FROM p2p_orders WHERE ticker = 'C7-USD'")
def _(v):
    return R.lookup(v.p2p_orders(), ticker="C7-USD").select("order_id", "user_id", "price")


@query("f1_lookup_set", "transactions users", f"""
SELECT {ID}, user_id FROM transactions WHERE user_id IN (SELECT user_id FROM users WHERE status = 'Not Verified')""")
def _(v):
    wanted = v.users().filter(F.col("status") == "Not Verified")
    return R.lookup_set(v.transactions(), wanted, "user_id").select("transaction_id", "user_id")


@query("f1_balance_lookup", "wallet", """
SELECT s.s_suppkey AS user_id, coalesce(w.amount::decimal(18,8), 0)::double AS balance
FROM (SELECT s_suppkey FROM supplier UNION ALL SELECT -1 - s_suppkey FROM supplier) s LEFT JOIN wallet w ON w.user_id = s.s_suppkey""")
def _(v):
    known = v._table("supplier").select(F.col("s_suppkey").alias("user_id"))
    return R.balances_for(known.unionByName(known.select((-1 - F.col("user_id")).alias("user_id"))), v.wallet())


@query("f2_news_of_ticker", "news_data", """
SELECT doc_id, ticker, 'one' AS asked FROM news_data WHERE ticker = 'src3' UNION ALL SELECT doc_id, ticker, 'all' FROM news_data""")
def _(v):
    news = v.news_data().select("doc_id", "ticker")
    return concat_all(
        [R.rows_for(news, "ticker", t).withColumn("asked", F.lit(n)) for t, n in (("src3", "one"), ("all", "all"))]
    )


@query("f3_trailing_days", "rsi", f"""
SELECT "Ticker", {day('"Date"')} AS "Date", round("RSI", 6) AS "RSI" FROM rsi WHERE "Date" >= (SELECT max("Date") FROM rsi) - 7""")
def _(v):
    return rounded(R.trailing_days(rsi(v.prices())).select("Ticker", "Date", "RSI"), 6, "RSI")


@query("f4_drop_null", "prices", f"""
SELECT {day('"Date"')} AS "Date", "Ticker", 'any' AS how FROM prices WHERE "Open" <> "Close" AND "Low" >= 1
UNION ALL SELECT {day('"Date"')}, "Ticker", 'subset' FROM prices WHERE "Open" <> "Close" """)
def _(v):
    gaps = v.prices().select(
        "Date", "Ticker", F.nullif("Open", "Close").alias("Open"), F.when(F.col("Low") >= 1, F.col("Low")).alias("Low")
    )
    return concat_all([
        R.drop_null(gaps, subset).select("Date", "Ticker", F.lit(how).alias("how"))
        for subset, how in ((None, "any"), (["Open"], "subset"))
    ])


@query("f5_split_orders", "p2p_orders", """
SELECT order_id, user_id, CASE WHEN user_id = 7 THEN 'own' ELSE 'market' END AS side FROM p2p_orders""")
def _(v):
    return R.split_orders(v.p2p_orders(), 7).select("order_id", "user_id", "side")


@query("f6_search_ticker", "crypto_price", "SELECT crypto_price_id, ticker FROM crypto_price WHERE upper(ticker) LIKE '%C1%'")
def _(v):
    return R.search_ticker(v.crypto_price(), "c1").select("crypto_price_id", "ticker")


HOLDINGS_SQL = """
SELECT user_id, crypto_price_id, sum(CASE WHEN transaction_type = 'buy' THEN number_of_coins ELSE 0 END)::double AS total_bought,
       sum(CASE WHEN transaction_type = 'sell' THEN number_of_coins ELSE 0 END)::double AS total_sold,
       sum(CASE transaction_type WHEN 'buy' THEN number_of_coins WHEN 'sell' THEN -number_of_coins ELSE 0 END)::double AS remaining_coins
FROM transactions GROUP BY user_id, crypto_price_id"""


@query("f7_positive_holdings", "transactions", f"SELECT * FROM ({HOLDINGS_SQL}) WHERE remaining_coins > 0")
def _(v):
    return R.positive(holdings(v.transactions(), "user_id", "crypto_price_id"), "remaining_coins")


@query("f8_self_trade", "transactions", f"""
SELECT {ID}, CASE WHEN user_id = other_user THEN 'own order' END AS reject_reason FROM transactions""")
def _(v):
    asked = v.transactions().select("transaction_id", "user_id", "other_user")
    ok, bad = R.exclude_self_trade(asked, "other_user", "user_id")
    return ok.withColumn("reject_reason", F.lit(None).cast("string")).unionByName(bad).select("transaction_id", "reject_reason")


@query("f9_affordable", "transactions wallet", f"""
SELECT {ID}, CASE WHEN number_of_coins < 3 THEN 'coins' WHEN t.amount > coalesce(w.amount::decimal(18,8), 0) THEN 'balance' END AS reject_reason
FROM transactions t LEFT JOIN wallet w USING (user_id)""")
def _(v):
    asked = v.transactions().select(
        "transaction_id", "user_id", F.when(F.col("number_of_coins") >= 3, F.col("number_of_coins")).otherwise(F.lit(0)).alias("coins"),
        F.col("amount").alias("cost"),
    )
    ok, bad = R.affordable(asked, v.wallet())
    return ok.withColumn("reject_reason", F.lit(None).cast("string")).unionByName(bad).select("transaction_id", "reject_reason")


@query("f9_covered_by_holding", "transactions", f"""
WITH h AS ({HOLDINGS_SQL})
SELECT cast(t.transaction_id AS varchar) AS transaction_id,
       CASE WHEN t.number_of_coins > coalesce(h.remaining_coins, 0) THEN 'holding' END AS reject_reason
FROM transactions t LEFT JOIN h ON h.user_id = t.other_user AND h.crypto_price_id = t.crypto_price_id""")
def _(v):
    tx = v.transactions()
    asked = tx.select("transaction_id", F.col("other_user").alias("user_id"), "crypto_price_id", F.col("number_of_coins").alias("coins"))
    keys = ["user_id", "crypto_price_id"]
    ok, bad = R.covered_by_holding(asked, holdings(tx, *keys), keys)
    return ok.withColumn("reject_reason", F.lit(None).cast("string")).unionByName(bad).select("transaction_id", "reject_reason")


def _sign_ups(v):
    """Suppliers sign up; those whose key is a customer's repeat that customer's email and phone."""
    name = F.concat(F.lit("Customer#"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0"))
    known = F.col("s_acctbal") > 0
    return v._table("supplier").select(
        F.col("s_suppkey").alias("request_id"),
        F.when(known, name).otherwise(F.col("s_name")).alias("name"),
        F.concat(F.lower(F.when(known, name).otherwise(F.col("s_name"))), F.lit("@example.com")).alias("email"),
        F.concat(F.lit("+"), F.col("s_suppkey").cast("string")).alias("phone"),
    )


SIGN_UPS_SQL = """
SELECT s_suppkey AS request_id, CASE WHEN s_acctbal > 0 THEN 'Customer#' || lpad(s_suppkey::varchar, 9, '0') ELSE s_name END AS name,
       lower(CASE WHEN s_acctbal > 0 THEN 'Customer#' || lpad(s_suppkey::varchar, 9, '0') ELSE s_name END) || '@example.com' AS email,
       '+' || s_suppkey AS phone FROM supplier"""


@query("f10_existing_users", "users", f"""
WITH r AS ({SIGN_UPS_SQL})
SELECT request_id, EXISTS (SELECT 1 FROM users u WHERE u.email = r.email AND u.phone = r.phone) AS known FROM r""")
def _(v):
    asked, users = _sign_ups(v), v.users()
    return concat_all([
        R.already_registered(asked, users).select("request_id", F.lit(True).alias("known")),
        R.not_registered(asked, users).select("request_id", F.lit(False).alias("known")),
    ])


@query("v1_validate", "p2p_orders", """
SELECT order_id, CASE WHEN price <= 50000 THEN 'price' WHEN payment_mode NOT IN ('Wallet', 'Bank') THEN 'payment_mode'
  WHEN u.user_id IS NULL OR status = 'completed' THEN 'status' END AS reject_reason
FROM p2p_orders LEFT JOIN (SELECT c_custkey AS user_id FROM customer) u USING (user_id)""")
def _(v):
    rules = [
        ("price", F.col("price") > 50000),
        ("payment_mode", F.col("payment_mode").isin(*schemas.PAYMENT_MODES)),
        ("status", F.col("status") == "pending"),
    ]
    ok, bad = R.validate(v.p2p_orders().select("order_id", "price", "payment_mode", "status"), rules)
    return ok.withColumn("reject_reason", F.lit(None).cast("string")).unionByName(bad).select("order_id", "reject_reason")


@query("j1_latest_with_ties", sql=f"""
SELECT o_custkey, o_orderkey, {moment('o_orderdate::timestamp')} AS o_orderdate FROM orders
QUALIFY rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC) = 1""")
def _(v):
    orders = v._table("orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("timestamp").alias("o_orderdate"))
    return latest_with_ties(orders, "o_custkey", "o_orderdate")


SCORES_CLEAN_SQL = """
SELECT replace(ticker, '-', '') AS ticker_clean, avg(avg_sentiment_score) AS s, avg(avg_sentiment_score1) AS s1 FROM scores GROUP BY 1"""


@query("j2_with_sentiment", "prices scores", f"""
SELECT "Ticker" AS ticker, {day('"Date"')} AS "Date", round(s, 6) AS avg_sentiment_score, round(s1, 6) AS avg_sentiment_score1
FROM prices LEFT JOIN ({SCORES_CLEAN_SQL}) ON replace("Ticker", '-', '') = ticker_clean""")
def _(v):
    board = J.with_sentiment(v.prices().select(F.col("Ticker").alias("ticker"), "Date"), v.scores())
    return rounded(board, 6, "avg_sentiment_score", "avg_sentiment_score1")


@query("j3_with_icon", "prices icons", f"""
SELECT "Ticker" AS ticker, {day('"Date"')} AS "Date", image_name
FROM prices LEFT JOIN icons ON "Ticker" = replace(replace(image_name, '.png', ''), '-', '')""")
def _(v):
    return J.with_icon(v.prices().select(F.col("Ticker").alias("ticker"), "Date"), v.icons())


@query("j4_orders_with_seller", "p2p_orders users", "SELECT order_id, user_id, name AS user_name, email FROM p2p_orders JOIN users USING (user_id)")
def _(v):
    return J.orders_with_seller(v.p2p_orders(), v.users()).select("order_id", "user_id", "user_name", "email")


@query("j5_with_price", "transactions crypto_price", f"""
SELECT {ID}, ticker, current_price FROM transactions JOIN crypto_price USING (crypto_price_id)""")
def _(v):
    return J.with_price(v.transactions(), v.crypto_price()).select("transaction_id", "ticker", "current_price")


@query("j7_tx_with_coin", "transactions crypto_price", f"""
SELECT {ID}, ticker, c.current_price FROM transactions t LEFT JOIN (SELECT * FROM crypto_price WHERE current_price::double >= 950) c
ON t.crypto_price_id = c.crypto_price_id""")
def _(v):
    known = J.priced(v.crypto_price()).filter(F.col("price") >= 950).drop("price")
    return J.tx_with_coin(v.transactions(), known).select("transaction_id", "ticker", "current_price")


@query("j8_order_availability", "p2p_orders transactions crypto_price", """
SELECT order_id, p.ticker, coalesce(net, 0)::double AS coins_available FROM p2p_orders p LEFT JOIN (
  SELECT user_id, ticker, sum(CASE transaction_type WHEN 'buy' THEN number_of_coins WHEN 'sell' THEN -number_of_coins ELSE 0 END) AS net
  FROM transactions JOIN crypto_price USING (crypto_price_id) GROUP BY user_id, ticker) n
ON n.user_id = p.user_id AND n.ticker = p.ticker""")
def _(v):
    held = J.order_availability(v.p2p_orders(), v.transactions(), v.crypto_price())
    return held.select("order_id", "ticker", "coins_available")


@query("j9_price_id_for", "p2p_orders crypto_price", """
SELECT order_id, ticker, id AS crypto_price_id FROM p2p_orders LEFT JOIN
  (SELECT ticker, min(crypto_price_id) AS id FROM crypto_price GROUP BY ticker) USING (ticker)""")
def _(v):
    return J.price_id_for(v.p2p_orders().select("order_id", "ticker"), v.crypto_price())


@query("j10_existence", "transactions users", """
SELECT DISTINCT other_user AS user_id, true AS has_orders FROM transactions WHERE other_user IN (SELECT o_custkey FROM orders)
UNION ALL SELECT DISTINCT user_id, false FROM users WHERE user_id NOT IN (SELECT o_custkey FROM orders)""")
def _(v):
    buyers = v._table("orders").select(F.col("o_custkey").alias("user_id"))
    others = v._table("lineitem").select(F.col("l_suppkey").alias("user_id")).distinct()
    return concat_all([
        J.existing(others, buyers, "user_id").withColumn("has_orders", F.lit(True)),
        J.missing(v.users().select("user_id"), buyers, "user_id").withColumn("has_orders", F.lit(False)),
    ])


@query("j6_merge_means", "logits", f"""
WITH s AS (SELECT vec_id, ticker, {SCORE_SQL} AS score FROM logits)
SELECT ticker AS "Ticker", round(a, 6) AS avg_sentiment_score, round(b, 6) AS avg_sentiment_score1
FROM (SELECT ticker, avg(score) AS a FROM s GROUP BY ticker)
JOIN (SELECT ticker, avg(score) AS b FROM s WHERE score > 0 AND ticker <> '3' GROUP BY ticker) USING (ticker)""")
def _(v):
    scored = v.logits().select(F.col("ticker").alias("Ticker"), sentiment_from_logits(F.col("logits")).alias("sentiment_score"))
    recent = scored.filter((F.col("sentiment_score") > 0) & (F.col("Ticker") != "3"))
    merged = J.merge_means(mean_score(scored), mean_score(recent, "avg_sentiment_score1"))
    return rounded(merged, 6, "avg_sentiment_score", "avg_sentiment_score1")


@query("o1_sort_desc", "changes", f"""
SELECT "Ticker", {day('"Date"')} AS "Date", round(percentage_change, 6) AS percentage_change FROM changes
ORDER BY percentage_change DESC NULLS LAST""")
def _(v):
    return rounded(sort_desc(v.changes(), "percentage_change", "Ticker").select("Ticker", "Date", "percentage_change"), 6, "percentage_change")


@query("o2_newest_first", "p2p_orders", f"SELECT order_id, {moment('created_at')} AS created_at FROM p2p_orders ORDER BY created_at DESC, order_id")
def _(v):
    return newest_first(v.p2p_orders(), "created_at", "order_id").select("order_id", "created_at")


@query("o3_latest_by_date", "prices", f"""
SELECT "Ticker", {day('"Date"')} AS "Date", "Close" FROM prices QUALIFY row_number() OVER (PARTITION BY "Ticker" ORDER BY "Date" DESC) = 1""")
def _(v):
    return latest_one(v.prices().select("Ticker", "Date", "Close"), ["Ticker"], ["Date"])


@query("o4_first_row", "crypto_price", """
SELECT ticker, crypto_price_id, current_price FROM crypto_price QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY crypto_price_id) = 1""")
def _(v):
    return first_one(v.crypto_price().select("ticker", "crypto_price_id", "current_price"), ["ticker"], ["crypto_price_id"])


@query("o5_preview", "rsi", f"""
SELECT "Ticker", {day('"Date"')} AS "Date", round("RSI", 6) AS "RSI" FROM rsi ORDER BY rsi."Date" DESC, "Ticker" LIMIT 20""")
def _(v):
    return rounded(preview(rsi(v.prices()), [F.desc("Date"), "Ticker"], 20).select("Ticker", "Date", "RSI"), 6, "RSI")


@query("d1_tickers", "news_data", "SELECT DISTINCT ticker FROM news_data ORDER BY ticker")
def _(v):
    return tickers(v.news_data())


@query("d2_market_tickers", "p2p_orders", "SELECT DISTINCT ticker FROM p2p_orders WHERE user_id <> 7")
def _(v):
    split = R.split_orders(v.p2p_orders(), 7)
    return split.filter(F.col("side") == "market").select("ticker").distinct()


@query("d3_union_all", sql="SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def _(v):
    return concat_all([
        v._table("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")),
        v._table("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")),
    ])
