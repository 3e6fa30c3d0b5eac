"""Aggregations (A) and per-key ordered operators (W)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickerloom.functions.sentiment import sentiment_from_logits
from tickerloom.functions.text import headline_key
from tickerloom.operators import aggregates as A, indicators as I, latest as L
from tickerloom.operators.joins import with_price
from tickerloom.operators.ordered import rank_in_key, range_chunks, running_totals
from tickerloom.plans.portfolio import portfolio, sellable
from tickerloom.testbed.q_columns import SCORE_SQL
from tickerloom.testbed.q_rows import HOLDINGS_SQL, SCORES_CLEAN_SQL
from tickerloom.testbed.registry import day, moment, query, rounded
from pyspark.sql import Window

SUMMARY_SQL = """
SELECT "Ticker", count("RSI") AS "Total", count(*) FILTER ("RSI" > 70) AS "Overbought", count(*) FILTER ("RSI" < 30) AS "Oversold",
       100.0::double * count(*) FILTER ("RSI" > 70) / count("RSI") AS "OverboughtPercent",
       100.0::double * count(*) FILTER ("RSI" < 30) / count("RSI") AS "OversoldPercent" FROM rsi GROUP BY "Ticker" """


@query("a1_rsi_summary", "rsi", SUMMARY_SQL)
def _(v):
    return A.rsi_summary(I.rsi(v.prices()))


@query("a2_holdings", "transactions", HOLDINGS_SQL)
def _(v):
    return A.holdings(v.transactions(), "user_id", "crypto_price_id")


VALUATION_SQL = """
SELECT user_id, ticker, current_price, total_bought::double AS total_bought, total_sold::double AS total_sold,
       (total_bought - total_sold)::double AS remaining_coins, net_cost::double AS net_cost,
       round(((total_bought - total_sold)::decimal(26,8) * current_price::decimal(12,4))::double, 4) AS market_value FROM (
  SELECT user_id, ticker, current_price,
         sum(CASE WHEN transaction_type = 'buy' THEN number_of_coins ELSE 0 END) AS total_bought,
         sum(CASE WHEN transaction_type = 'sell' THEN number_of_coins ELSE 0 END) AS total_sold,
         sum(CASE transaction_type WHEN 'buy' THEN cost WHEN 'sell' THEN -cost ELSE 0 END) AS net_cost
  FROM transactions JOIN crypto_price USING (crypto_price_id) GROUP BY user_id, ticker, current_price)"""


@query("a3_valuation", "transactions crypto_price", VALUATION_SQL)
def _(v):
    return rounded(A.valuation(with_price(A.held_per_price(v.transactions()), v.crypto_price()), "user_id", "ticker"), 4, "market_value")


@query("a4_mean_score", "logits", f"""
SELECT ticker AS "Ticker", round(avg({SCORE_SQL}), 6) AS avg_sentiment_score FROM logits GROUP BY ticker""")
def _(v):
    scored = v.logits().select(F.col("ticker").alias("Ticker"), sentiment_from_logits(F.col("logits")).alias("sentiment_score"))
    return rounded(A.mean_score(scored), 6, "avg_sentiment_score")


@query("a5_mean_score_clean", "scores", f"""
SELECT ticker_clean, round(s, 6) AS avg_sentiment_score, round(s1, 6) AS avg_sentiment_score1 FROM ({SCORES_CLEAN_SQL})""")
def _(v):
    return rounded(A.mean_score_clean(v.scores()), 6, "avg_sentiment_score", "avg_sentiment_score1")


AVAILABLE_SQL = f"""
SELECT user_id, crypto_price_id, CASE WHEN remaining_coins > 0 THEN remaining_coins END AS available_coins FROM ({HOLDINGS_SQL})"""


@query("a6_available_coins", "transactions", AVAILABLE_SQL)
def _(v):
    return A.available_coins(v.transactions(), "user_id", "crypto_price_id")


@query("a7_latest_tx", "transactions crypto_price", """
SELECT user_id, ticker, cast(max(transaction_id) AS varchar) AS transaction_id FROM transactions JOIN crypto_price USING (crypto_price_id)
GROUP BY user_id, ticker""")
def _(v):
    held = A.holdings(with_price(v.transactions(), v.crypto_price()), "user_id", "ticker", latest_tx=True)
    return held.select("user_id", "ticker", "transaction_id")


LEDGER_SQL = """
SELECT user_id, sum(CASE WHEN transaction_type IN ('buy', 'p2p-buy') THEN amount ELSE -amount END)::double AS balance
FROM transactions GROUP BY user_id"""


@query("a8_ledger_balance", "transactions", LEDGER_SQL)
def _(v):
    return A.ledger_balance(v.transactions())


TOTALS_SQL = f"SELECT user_id, round(sum(market_value), 3) AS total_market_value FROM ({VALUATION_SQL}) WHERE remaining_coins > 0 GROUP BY user_id"


@query("a9_portfolio_total", "transactions crypto_price", TOTALS_SQL)
def _(v):
    return rounded(A.portfolio_total(portfolio(v.transactions(), v.crypto_price()), "user_id"), 3, "total_market_value")


@query("a10_news_span", "news_data", f"""
SELECT ticker, {moment('min(date_time)')} AS from_date, {moment('max(date_time)')} AS to_date,
       date_diff('second', min(date_time), max(date_time)) // 86400 AS days FROM news_data GROUP BY ticker""")
def _(v):
    return A.news_span(v.news_data())


@query("a11_latest_date", "prices", f"""SELECT "Ticker", {day('max("Date")')} AS latest_date FROM prices GROUP BY "Ticker" """)
def _(v):
    return L.latest_date(v.prices(), "Ticker", "Date")


@query("a12_max_date", "prices", f"""SELECT {day('max("Date")')} AS max_date FROM prices""")
def _(v):
    return L.max_date(v.prices())


RSI_SQL = f"""SELECT "Ticker", {day('"Date"')} AS "Date", "Close", round("RSI", 6) AS "RSI" FROM rsi"""


@query("w1_rsi", "rsi", RSI_SQL)
def _(v):
    return rounded(I.rsi(v.prices()).select("Ticker", "Date", "Close", "RSI"), 6, "RSI")


@query("w1_rsi_by_ranges", "ticks", f"""
SELECT event_id, "Ticker", round("RSI", 6) AS "RSI" FROM (
 SELECT *, CASE WHEN loss > 0 THEN 100 - 100 / (1 + gain / loss) WHEN gain > 0 THEN 100.0 END AS "RSI" FROM (
  SELECT event_id, "Ticker", avg(up) OVER w AS gain, avg(down) OVER w AS loss, count(*) OVER w AS n FROM (
   SELECT *, CASE WHEN d > 0 THEN d ELSE 0 END AS up, CASE WHEN d < 0 THEN -d ELSE 0 END AS down FROM (
    SELECT *, "Close" - lag("Close") OVER (PARTITION BY "Ticker" ORDER BY ts, event_id) AS d FROM ticks))
  WINDOW w AS (PARTITION BY "Ticker" ORDER BY ts, event_id ROWS 13 PRECEDING)) WHERE n = 14) WHERE "RSI" IS NOT NULL""")
def _(v):
    """Series by event type hold a fifth of all rows each; they are cut into ranges."""
    rated = I.rsi_by_ranges(v.ticks(), order=("ts", "event_id"), parts=16)
    return rounded(rated.select("event_id", "Ticker", "RSI"), 6, "RSI")


@query("w4_pct_change_by_ranges", "ticks", """
SELECT event_id, "Ticker", round(known / lag(known) OVER w - 1, 6) AS percentage_change FROM (
  SELECT *, last_value(CASE WHEN event_id % 5 > 0 THEN "Close" END IGNORE NULLS) OVER (PARTITION BY "Ticker" ORDER BY ts, event_id) AS known FROM ticks)
WINDOW w AS (PARTITION BY "Ticker" ORDER BY ts, event_id) QUALIFY known / lag(known) OVER w IS NOT NULL AND lag(known) OVER w <> 0""")
def _(v):
    """Every fifth value is missing; the last known one counts, over range borders too."""
    gaps = v.ticks().withColumn("Close", F.when(F.col("event_id") % 5 > 0, F.col("Close")))
    changed = I.pct_change_by_ranges(gaps, order=("ts", "event_id"), parts=16)
    return rounded(changed.select("event_id", "Ticker", "percentage_change"), 6, "percentage_change")


def _by_day():
    return Window.partitionBy("Ticker").orderBy("Date")


@query("w2_delta", "prices", f"""
SELECT "Ticker", {day('"Date"')} AS "Date", round("Close" - lag("Close") OVER (PARTITION BY "Ticker" ORDER BY "Date"), 6) AS delta FROM prices""")
def _(v):
    moved = v.prices().select("Ticker", "Date", I.delta(F.col("Close"), _by_day()).alias("delta"))
    return rounded(moved, 6, "delta")


@query("w3_rolling_mean", "prices", f"""
SELECT "Ticker", {day('"Date"')} AS "Date", round(CASE WHEN count("Close") OVER w >= 14 THEN avg("Close") OVER w END, 6) AS mean
FROM prices WINDOW w AS (PARTITION BY "Ticker" ORDER BY "Date" ROWS 13 PRECEDING)""")
def _(v):
    mean = v.prices().select("Ticker", "Date", I.rolling_mean(F.col("Close"), 14, _by_day()).alias("mean"))
    return rounded(mean, 6, "mean")


@query("w4_pct_change", "prices", f"""
WITH f AS (SELECT "Ticker", "Date", last_value(CASE WHEN "Volume" > 1 THEN "Close" END IGNORE NULLS) OVER
             (PARTITION BY "Ticker" ORDER BY "Date" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM prices)
SELECT "Ticker", {day('"Date"')} AS "Date", round(p, 6) AS percentage_change FROM
  (SELECT *, c / lag(c) OVER (PARTITION BY "Ticker" ORDER BY "Date") - 1 AS p FROM f) WHERE p IS NOT NULL AND NOT isnan(p) AND NOT isinf(p)""")
def _(v):
    gaps = v.prices().withColumn("Close", F.when(F.col("Volume") > 1, F.col("Close")))
    return rounded(I.pct_change(gaps).select("Ticker", "Date", "percentage_change"), 6, "percentage_change")


@query("w5_latest_one", sql=f"""
SELECT o_custkey, o_orderkey, {moment('o_orderdate::timestamp')} AS o_orderdate, o_totalprice FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def _(v):
    orders = v._table("orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("timestamp").alias("o_orderdate"), "o_totalprice")
    return L.latest_one(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"])


DEDUPE_SQL = """
SELECT ticker, doc_id, title, source, date_time FROM news_data
QUALIFY row_number() OVER (PARTITION BY ticker, trim(title) || '||' || trim(source) ORDER BY doc_id) = 1"""


def _headlines(v):
    return v.news_data().withColumnRenamed("doc_id", "seq")


@query("w6_dedupe_headlines", "news_data", f"SELECT ticker, doc_id AS seq, md5(title) AS title_md5 FROM ({DEDUPE_SQL})")
def _(v):
    return L.dedupe_headlines(_headlines(v)).select("ticker", "seq", F.md5("title").alias("title_md5"))


@query("w7_cap_per_key", "news_data", f"""
SELECT ticker, doc_id AS seq FROM ({DEDUPE_SQL}) QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY doc_id) <= 30""")
def _(v):
    return L.cap_per_key(L.dedupe_headlines(_headlines(v)), "ticker", ["seq"], 30).select("ticker", "seq")


@query("m8_request_ranks", sql="""
SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events""")
def _(v):
    """Row numbers within five heavy keys."""
    return rank_in_key(v._table("events").select("event_id", "event_type", "ts"), ["event_type"], ["ts", "event_id"], "n").select("event_id", "n")
