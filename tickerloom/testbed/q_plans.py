"""The composite queries (Q)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickerloom.plans import market, news, portfolio as P, prices as R
from tickerloom.testbed.q_columns import WORD_SCORE_SQL, prose_logits
from tickerloom.testbed.q_groups import AVAILABLE_SQL, DEDUPE_SQL, LEDGER_SQL, RSI_SQL, SUMMARY_SQL, VALUATION_SQL
from tickerloom.testbed.q_rows import SCORES_CLEAN_SQL
from tickerloom.testbed.q_tables import CHART_SQL, DOMAIN_SQL, DRIVER_PAGES, PRIORITY_SQL, TITLE_SQL
from tickerloom.testbed.registry import day, moment, query, rounded
from tickerloom.testbed.views import EVENT_TYPES


@query("q1_market_board", "changes scores icons", f"""
WITH s AS ({SCORES_CLEAN_SQL}), l AS (SELECT "Ticker", max("Date") AS d FROM changes GROUP BY "Ticker")
SELECT cd."Ticker" AS ticker, round("Open", 2) AS open, format('{{:,}}', "Volume") AS volume, round(percentage_change, 6) AS percentage_change,
  CASE WHEN percentage_change > 0 THEN printf('%+.4f%%', percentage_change) ELSE printf('%.4f%%', percentage_change) END AS change_label,
  CASE WHEN percentage_change < 0 THEN 'negative' WHEN percentage_change > 0 THEN 'positive' ELSE 'neutral' END AS change_class,
  round(s.s, 6) AS avg_sentiment_score, CASE WHEN s.s IS NULL THEN 'neutral' WHEN s.s >= 0.5 THEN 'positive' ELSE 'negative' END AS sentiment,
  round(s.s1, 6) AS avg_sentiment_score1, CASE WHEN s.s1 IS NULL THEN 'neutral' WHEN s.s1 >= 0.5 THEN 'positive' ELSE 'negative' END AS sentiment1,
  image_name
FROM changes cd JOIN l ON cd."Ticker" = l."Ticker" AND cd."Date" = l.d
LEFT JOIN s ON replace(cd."Ticker", '-', '') = ticker_clean
LEFT JOIN icons ON replace(cd."Ticker", '-', '') = replace(replace(image_name, '.png', ''), '-', '')
ORDER BY percentage_change DESC NULLS LAST""")
def _(v):
    board = market.market_board(v.changes(), v.scores(), v.icons())
    return rounded(board, 6, "percentage_change", "avg_sentiment_score", "avg_sentiment_score1")


@query("q2_rsi_series", "rsi", RSI_SQL)
def _(v):
    return rounded(R.rsi_series(v.prices()).select("Ticker", "Date", "Close", "RSI"), 6, "RSI")


@query("q3_rsi_report", "rsi", SUMMARY_SQL)
def _(v):
    return R.rsi_report(v.prices(), unique=True)


@query("q4_rsi_chart", "rsi", CHART_SQL)
def _(v):
    return rounded(R.rsi_chart_data(R.rsi_series(v.prices(), unique=True)), 6, "RSI")


@query("q5_daily_change", "type_bars", f"""
SELECT {day('"Date"')} AS "Date", "Ticker", "Open", "High", "Low", "Close", "Volume", round(p, 6) AS percentage_change FROM (
  SELECT *, "Close" / lag("Close") OVER (PARTITION BY "Ticker" ORDER BY "Date") - 1 AS p FROM type_bars) WHERE p IS NOT NULL""")
def _(v):
    return rounded(R.daily_change(v.wide(), list(EVENT_TYPES)), 6, "percentage_change")


@query("q6_latest_prices", "prices", """
SELECT "Ticker" AS ticker, round_even("Close", 2)::varchar AS current_price, 'UNKNOWN' AS fiat_currency FROM prices
QUALIFY row_number() OVER (PARTITION BY "Ticker" ORDER BY "Date" DESC) = 1""")
def _(v):
    return R.latest_prices(v.prices())


@query("q7_ingest_news", sql=f"""
WITH p AS (SELECT page_id, {DOMAIN_SQL} AS ticker, {PRIORITY_SQL} AS priority, trim({TITLE_SQL}) AS title FROM pages),
k AS (SELECT * FROM p WHERE priority = (SELECT min(priority) FROM p q WHERE q.ticker = p.ticker)),
d AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY ticker, title ORDER BY page_id) = 1)
SELECT ticker, title, 'N/A' AS source, NULL::varchar AS date_time FROM d
QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY page_id) <= 100""")
def _(v):
    return news.ingest_news(v.pages(), DRIVER_PAGES)


@query("q8_score_news", "news_data", f"""
WITH s AS ({WORD_SCORE_SQL})
SELECT a.ticker AS "Ticker", round(a.m, 6) AS avg_sentiment_score, round(b.m, 6) AS avg_sentiment_score1 FROM
  (SELECT ticker, avg(score) AS m FROM s GROUP BY ticker) a
  JOIN (SELECT ticker, avg(score) AS m FROM s JOIN news_data USING (doc_id, ticker)
        WHERE date_time >= (SELECT max(date_time) FROM news_data) - INTERVAL 3 DAY GROUP BY ticker) b ON a.ticker = b.ticker""")
def _(v):
    titled = v.news_data().select(F.col("ticker").alias("Ticker"), F.col("title").alias("Title"), "date_time")
    return rounded(news.score_recent(titled, scorer=prose_logits), 6, "avg_sentiment_score", "avg_sentiment_score1")


# Some prices are no number: their holdings are worth 0.
UNREADABLE_SQL = """crypto_price_id % 9 = 4"""
Q9_SQL = VALUATION_SQL.replace("FROM transactions JOIN crypto_price USING (crypto_price_id)", f"""FROM transactions JOIN (
  SELECT crypto_price_id, ticker, CASE WHEN {UNREADABLE_SQL} THEN 'soon' ELSE current_price END AS current_price FROM crypto_price)
  USING (crypto_price_id)""").replace("current_price::", "TRY_CAST(current_price AS double)::")


@query("q9_portfolio", "transactions crypto_price", f"SELECT * REPLACE (coalesce(market_value, 0) AS market_value) FROM ({Q9_SQL}) WHERE remaining_coins > 0")
def _(v):
    price = v.crypto_price()
    price = price.withColumn("current_price", F.when(F.expr(UNREADABLE_SQL), "soon").otherwise(F.col("current_price")))
    return rounded(P.portfolio(v.transactions(), price), 4, "market_value")


USER_ORDERS_SQL = f"""
SELECT order_id, p.user_id, p.ticker, price::double AS price, payment_mode, status, {moment('created_at')} AS created_at,
       coalesce(net, 0)::double AS coins_available, round((coalesce(net, 0)::decimal(20,4) * price::decimal(15,4))::double, 4) AS order_value
FROM p2p_orders p LEFT JOIN (
  SELECT user_id, ticker, sum(CASE transaction_type WHEN 'buy' THEN number_of_coins WHEN 'sell' THEN -number_of_coins ELSE 0 END) AS net
  FROM transactions JOIN crypto_price USING (crypto_price_id) GROUP BY user_id, ticker) n
ON n.user_id = p.user_id AND n.ticker = p.ticker"""


@query("q10_user_orders", "p2p_orders transactions crypto_price", USER_ORDERS_SQL)
def _(v):
    return rounded(P.user_orders(v.p2p_orders(), v.transactions(), v.crypto_price()), 4, "order_value")


@query("q11_sellable", "transactions crypto_price", """
SELECT user_id, ticker, remaining_coins::double AS remaining_coins, cast(transaction_id AS varchar) AS transaction_id FROM (
  SELECT user_id, ticker, sum(CASE transaction_type WHEN 'buy' THEN number_of_coins WHEN 'sell' THEN -number_of_coins ELSE 0 END) AS remaining_coins,
         max(transaction_id) AS transaction_id FROM transactions JOIN crypto_price USING (crypto_price_id) GROUP BY user_id, ticker)
WHERE remaining_coins > 0""")
def _(v):
    return P.sellable(v.transactions(), v.crypto_price())


@query("q12_swappable", "transactions crypto_price", """
SELECT user_id, crypto_price_id, total::double AS total, ticker, current_price, fiat_currency FROM (
  SELECT user_id, crypto_price_id, ticker, current_price, fiat_currency,
         sum(CASE transaction_type WHEN 'buy' THEN number_of_coins WHEN 'sell' THEN -number_of_coins ELSE 0 END) AS total
  FROM transactions JOIN crypto_price USING (crypto_price_id) GROUP BY ALL) WHERE total > 0""")
def _(v):
    return P.swappable(v.transactions(), v.crypto_price())


LISTING_SQL = f"""
SELECT order_id, user_id, name AS user_name, email, ticker, price::double AS price, payment_mode, p.status,
       {moment('created_at')} AS created_at, CASE WHEN user_id = 7 THEN 'own' ELSE 'market' END AS side
FROM p2p_orders p JOIN users USING (user_id)"""


@query("q13_p2p_listing", "p2p_orders users", LISTING_SQL)
def _(v):
    return market.p2p_listing(v.p2p_orders(), v.users(), 7)


@query("q13_market_tickers", "p2p_orders users", f"SELECT DISTINCT ticker FROM ({LISTING_SQL}) WHERE side = 'market'")
def _(v):
    return market.market_tickers(market.p2p_listing(v.p2p_orders(), v.users(), 7))


@query("q14_history", "transactions crypto_price", f"""
SELECT cast(transaction_id AS varchar) AS transaction_id, user_id, crypto_price_id, number_of_coins::double AS number_of_coins,
       amount::double AS amount, cost::double AS cost, transaction_type, {moment('created_at')} AS created_at, ticker, current_price, fiat_currency
FROM transactions LEFT JOIN crypto_price USING (crypto_price_id)""")
def _(v):
    return P.history(v.transactions().drop("other_user", "line"), v.crypto_price())


@query("q15_coins_of", "transactions", AVAILABLE_SQL)
def _(v):
    return P.coins_of(v.transactions())


@query("q16_news_feed", "news_data", f"""
SELECT ticker, md5(title) AS title_md5, source, {moment('date_time')} AS date_time,
  CASE WHEN s < 0 THEN s || ' sec ago' WHEN s < 60 THEN s || ' sec ago' WHEN s < 3600 THEN (s // 60) || ' min ago'
       WHEN s < 86400 THEN (s // 3600) || ' hr ago' WHEN s < 172800 THEN '1 day ago' ELSE (s // 86400) || ' days ago' END AS age
FROM (SELECT *, date_diff('second', date_time, TIMESTAMP '2024-01-09 00:00:00') AS s FROM news_data)""")
def _(v):
    feed = news.news_feed(v.news_data(), "2024-01-09 00:00:00")
    return feed.select("ticker", F.md5("title").alias("title_md5"), "source", "date_time", "age")


@query("q16_news_tickers", "news_data", "SELECT DISTINCT ticker FROM news_data ORDER BY ticker")
def _(v):
    return news.news_tickers(v.news_data())


@query("q17_ledger_balance", "transactions", LEDGER_SQL)
def _(v):
    return P.balance_of(v.transactions())


@query("q18_listing", "transactions crypto_price", """
SELECT cast(transaction_id AS varchar) AS transaction_id, user_id AS seller_id, number_of_coins::double AS number_of_coins,
       amount::double AS amount, ticker, current_price
FROM transactions JOIN crypto_price USING (crypto_price_id) WHERE transaction_type = 'p2p-sell'""")
def _(v):
    tx = v.transactions()
    return P.listing(tx, v.crypto_price(), tx.filter(F.col("transaction_type") == "p2p-sell"))


@query("q19_user_list", "users", "SELECT user_id, name, email, phone, status FROM users")
def _(v):
    return P.user_list(v.users())
