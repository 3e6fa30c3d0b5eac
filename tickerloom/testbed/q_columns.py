"""Column functions (P) and sentiment scorers (U)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickerloom.functions import learned as L, numbers as N, sentiment as S, text as X
from tickerloom.operators.indicators import rsi
from tickerloom.testbed.registry import day, moment, query, rounded

AS_OF = "2024-01-31 00:00:00"


@query("p1_round2", sql="""SELECT event_id, round(value / 7, 2) AS half_up, round_even(value / 7, 2) AS half_even FROM events""")
def _(v):
    x = F.col("value") / 7
    return v._table("events").select(
        "event_id", N.round_half_up(x).alias("half_up"), N.round_half_even(x).alias("half_even")
    )


@query("p2_thousands", sql="SELECT event_id, format('{:,}', event_id * 12345) AS volume FROM events")
def _(v):
    return v._table("events").select("event_id", N.thousands(F.col("event_id") * 12345).alias("volume"))


@query("p3_ticker_clean", "crypto_price", "SELECT crypto_price_id, replace(ticker, '-', '') AS clean FROM crypto_price")
def _(v):
    return v.crypto_price().select("crypto_price_id", X.ticker_clean(F.col("ticker")).alias("clean"))


@query("p4_split_ticker", sql="""
WITH t AS (SELECT p_partkey, 'C' || (p_partkey % 50) || '-USD' AS a, p_type AS b,
                  p_brand || '-' || p_type || '-USD' AS c FROM part)
SELECT p_partkey, split_part(a, '-', 1) AS coin_a, split_part(a, '-', 2) AS fiat_a, b AS coin_b, 'UNKNOWN' AS fiat_b,
       regexp_extract(c, '^([^-]*)-(.*)$', 1) AS coin_c, regexp_extract(c, '^([^-]*)-(.*)$', 2) AS fiat_c FROM t""")
def _(v):
    t = v._table("part").select(
        "p_partkey",
        F.concat(F.lit("C"), (F.col("p_partkey") % 50).cast("string"), F.lit("-USD")).alias("a"),
        F.col("p_type").alias("b"),
        F.concat("p_brand", F.lit("-"), "p_type", F.lit("-USD")).alias("c"),
    )
    parts = {n: X.split_ticker(F.col(n)) for n in "abc"}
    return t.select(
        "p_partkey", *[p.alias(f"{w}_{n}") for n, pair in parts.items() for w, p in zip(("coin", "fiat"), pair)]
    )


@query("p5_icon_ticker", "icons", "SELECT image_name, replace(replace(image_name, '.png', ''), '-', '') AS ticker FROM icons")
def _(v):
    return v.icons().select("image_name", X.icon_ticker(F.col("image_name")).alias("ticker"))


@query("p6_clean_datetime", sql="""
SELECT event_id, CASE WHEN event_type = 'view' THEN strftime(ts, '%d %b %Y') ELSE strftime(ts, '%d %b %Y %H:%M:%S GMT') END
       AS cleaned FROM events""")
def _(v):
    raw = F.when(F.col("event_type") == "view", F.date_format("ts", "dd MMM yyyy")).otherwise(
        F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    )
    return v._table("events").select("event_id", X.clean_datetime(raw).alias("cleaned"))


def _raw_time():
    return (
        F.when(F.col("event_type") == "error", F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss 'GMT'"))
        .when(F.col("event_type") == "click", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(F.col("event_type") == "view", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+00:00'"))
        .when(F.col("event_type") == "purchase", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
        .otherwise("N/A")
    )


@query("p7_parse_news_time", sql=f"""
SELECT event_id, {moment("CASE WHEN event_type <> 'signup' THEN date_trunc('second', ts) END")} AS parsed FROM events""")
def _(v):
    return v._table("events").select("event_id", X.parse_news_time(_raw_time()).alias("parsed"))


TIMEAGO_SQL = f"""
WITH a AS (SELECT event_id, ts, date_diff('microsecond', ts, TIMESTAMP '{AS_OF}') // 1000000 AS s, event_type FROM events)
SELECT event_id, CASE WHEN event_type = 'signup' THEN 'N/A' WHEN s < 60 THEN s || ' sec ago'
  WHEN s < 3600 THEN (s // 60) || ' min ago' WHEN s < 86400 THEN (s // 3600) || ' hr ago'
  WHEN s < 172800 THEN (s // 86400) || ' day ago' WHEN s < 2592000 THEN (s // 86400) || ' days ago'
  ELSE {day('ts')} END AS age FROM a"""


@query("p8_timeago", sql=TIMEAGO_SQL)
def _(v):
    ts = F.when(F.col("event_type") != "signup", F.col("ts").cast("timestamp"))
    return v._table("events").select("event_id", X.timeago(ts, F.lit(AS_OF).cast("timestamp")).alias("age"))


@query("p9_to_money", sql="""
SELECT c_custkey, try_cast(CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'abc' WHEN 'BUILDING' THEN ''
  ELSE cast(c_acctbal AS varchar) END AS decimal(18,8))::double AS amount FROM customer""")
def _(v):
    raw = F.when(F.col("c_mktsegment") == "HOUSEHOLD", "abc").when(F.col("c_mktsegment") == "BUILDING", "").otherwise(
        F.col("c_acctbal").cast("string")
    )
    return v._table("customer").select("c_custkey", N.to_money(raw).alias("amount"))


@query("p10_null_passthrough", sql="""
SELECT event_id, CASE WHEN value <= 100 THEN cast(floor(value) AS bigint) END AS volume,
       coalesce(CASE WHEN value <= 100 THEN cast(floor(value) AS bigint) END, 0) AS volume_or_zero FROM events""")
def _(v):
    volume = F.when(F.col("value") <= 100, F.floor("value").cast("bigint"))
    return v._table("events").select(
        "event_id", volume.alias("volume"), N.null_to_zero(volume).alias("volume_or_zero")
    )


@query("p11_iso_date", sql=f"SELECT event_id, {day('ts')} AS day_text, {day('ts')} AS day_back FROM events")
def _(v):
    text = X.iso_date(F.col("ts"))
    return v._table("events").select("event_id", text.alias("day_text"), F.to_date(text).alias("day_back"))


@query("p12_rsi_level", "rsi", f"""
SELECT "Ticker", {day('"Date"')} AS "Date", CASE WHEN "RSI" > 70 THEN 'overbought' WHEN "RSI" < 30 THEN 'oversold'
       ELSE 'neutral' END AS level FROM rsi""")
def _(v):
    return rsi(v.prices()).select("Ticker", "Date", N.rsi_level(F.col("RSI")).alias("level"))


@query("p13_change_label", "changes", f"""
SELECT "Ticker", {day('"Date"')} AS "Date",
  CASE WHEN percentage_change > 0 THEN printf('%+.4f%%', percentage_change) ELSE printf('%.4f%%', percentage_change) END AS label,
  CASE WHEN percentage_change < 0 THEN 'negative' WHEN percentage_change > 0 THEN 'positive' ELSE 'neutral' END AS class
FROM changes""")
def _(v):
    c = F.col("percentage_change")
    return v.changes().select("Ticker", "Date", N.change_label(c).alias("label"), N.change_class(c).alias("class"))


@query("p14_sentiment_label", sql="""
SELECT vec_id, CASE WHEN label = 3 THEN 'neutral' WHEN embedding[1]::double * 4 >= 0.5 THEN 'positive' ELSE 'negative' END AS sentiment
FROM embeddings""")
def _(v):
    score = F.when(F.col("label") != 3, F.col("embedding")[0].cast("double") * 4)
    return v._table("embeddings").select("vec_id", S.sentiment_label(score).alias("sentiment"))


SCORE_SQL = "(exp(l2) - exp(l0)) / (exp(l0) + exp(l1) + exp(l2))"


@query("p15_sentiment_from_logits", "logits", f"SELECT vec_id, round({SCORE_SQL}, 6) AS score FROM logits")
def _(v):
    return rounded(v.logits().select("vec_id", S.sentiment_from_logits(F.col("logits")).alias("score")), 6, "score")


@query("p16_trade_arithmetic", "transactions", """
SELECT cast(transaction_id AS varchar) AS transaction_id,
  ((2 * (amount * 100)::hugeint * 1000000 + number_of_coins::bigint) // (2 * number_of_coins::bigint))::double / 1e8 AS unit_cost,
  (number_of_coins::decimal(10,0) * cost::decimal(12,2))::double AS amount_back FROM transactions""")
def _(v):
    return v.transactions().select(
        "transaction_id",
        N.unit_cost(F.col("amount"), F.col("number_of_coins")).alias("unit_cost"),
        N.trade_amount(F.col("number_of_coins"), F.col("cost")).alias("amount_back"),
    )


@query("p17_swap_quote", sql="""
WITH q AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice * 100)::hugeint * l_quantity::hugeint AS v,
                  round((1 + l_discount) * 100)::hugeint AS p FROM lineitem)
SELECT l_orderkey, l_linenumber::bigint AS l_linenumber, l_partkey, l_suppkey, v::double / 100 AS old_value,
       ((2 * v * 100000000 + p) // (2 * p))::double / 1e8 AS new_qty FROM q""")
def _(v):
    qty, frm, to = (
        F.col("l_quantity").cast("decimal(18,8)"),
        F.col("l_extendedprice").cast("decimal(15,8)"),
        F.round(1 + F.col("l_discount"), 2).cast("decimal(15,8)"),
    )
    return v._table("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        N.swap_value(qty, frm).alias("old_value"), N.swap_quantity(qty, frm, to).alias("new_qty"),
    )


@query("p18_number_formats", sql="""
SELECT event_id, printf('%.2f', value / 7) AS money, printf('%.3f', value / 7) AS score, printf('%.8f', value / 7) AS coins FROM events""")
def _(v):
    x = F.col("value") / 7
    return v._table("events").select(
        "event_id", N.fixed(x, 2).alias("money"), N.fixed(x, 3).alias("score"), N.fixed(x, 8).alias("coins")
    )


@query("p19_headline_key", "news_data", """
SELECT doc_id, md5(trim(title) || '||' || CASE WHEN source = 'de' THEN '' ELSE trim(source) END) AS key FROM news_data""")
def _(v):
    provider = F.when(F.col("source") != "de", F.col("source"))
    return v.news_data().select("doc_id", F.md5(X.headline_key(F.col("title"), provider)).alias("key"))


@query("p20_defaults", "p2p_orders", f"""
SELECT order_id, 'buy' AS transaction_type, CASE WHEN status = 'completed' THEN 'completed' ELSE 'pending' END AS status,
       {moment('created_at')} AS created_at FROM p2p_orders""")
def _(v):
    status = F.when(F.col("status") == "completed", F.col("status"))
    return v.p2p_orders().select(
        "order_id", F.lit("buy").alias("transaction_type"), F.coalesce(status, F.lit("pending")).alias("status"),
        F.coalesce(F.col("created_at"), F.lit(AS_OF).cast("timestamp")).alias("created_at"),
    )


@query("u1_rsi_period", "rsi", f"""
SELECT "Ticker", {day('"Date"')} AS "Date", round("RSI", 6) AS "RSI" FROM (
 SELECT *, CASE WHEN l7 > 0 THEN 100 - 100 / (1 + g7 / l7) WHEN g7 > 0 THEN 100.0 END AS "RSI" FROM (
  SELECT "Ticker", "Date", avg(up) OVER w AS g7, avg(down) OVER w AS l7, count(*) OVER w AS n FROM (
   SELECT *, CASE WHEN d > 0 THEN d ELSE 0 END AS up, CASE WHEN d < 0 THEN -d ELSE 0 END AS down FROM (
    SELECT *, "Close" - lag("Close") OVER (PARTITION BY "Ticker" ORDER BY "Date") AS d FROM prices))
  WINDOW w AS (PARTITION BY "Ticker" ORDER BY "Date" ROWS 6 PRECEDING)) WHERE n = 7) WHERE "RSI" IS NOT NULL""")
def _(v):
    return rounded(rsi(v.prices(), period=7).select("Ticker", "Date", "RSI"), 6, "RSI")


@query("u2_clean_datetime", "news_data", f"""
SELECT doc_id, strftime(date_time, '%d %b %Y %H:%M:%S GMT') AS cleaned FROM news_data""")
def _(v):
    raw = F.date_format("date_time", "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    return v.news_data().select("doc_id", X.clean_datetime(raw).alias("cleaned"))


@query("u3_timeago", "news_data", f"""
WITH a AS (SELECT doc_id, date_time, date_diff('second', date_time, TIMESTAMP '2024-01-01 12:00:00') AS s FROM news_data)
SELECT doc_id, CASE WHEN s < 60 THEN s || ' sec ago' WHEN s < 3600 THEN (s // 60) || ' min ago'
  WHEN s < 86400 THEN (s // 3600) || ' hr ago' ELSE 'older' END AS age FROM a""")
def _(v):
    at = F.lit("2024-01-01 12:00:00").cast("timestamp")
    return v.news_data().select("doc_id", X.timeago(F.col("date_time"), at).alias("age"))


def count_letters():
    """A stand-in classifier with the interface of an external one: texts in, three logits out."""

    def model(texts):
        return [[t.count("a") / (len(t) + 1), t.count("e") / (len(t) + 1), t.count("o") / (len(t) + 1)] for t in texts]

    return model


@query("u4_model_scorer", "news_data", """
WITH c AS (SELECT doc_id, (length(title) - length(replace(title, 'a', ''))) / (length(title) + 1) AS l0,
                  (length(title) - length(replace(title, 'e', ''))) / (length(title) + 1) AS l1,
                  (length(title) - length(replace(title, 'o', ''))) / (length(title) + 1) AS l2 FROM news_data)
SELECT doc_id, round((exp(l2) - exp(l0)) / (exp(l0) + exp(l1) + exp(l2)), 6) AS score FROM c""")
def _(v):
    logits = v.news_data().select("doc_id", S.model_logits(count_letters)(F.col("title")).alias("logits"))
    return rounded(logits.select("doc_id", S.sentiment_from_logits(F.col("logits")).alias("score")), 6, "score")


def word_count_sql(words) -> str:
    listed = ", ".join(f"'{w}'" for w in words)
    return f"len([x FOR x IN w IF x IN ({listed})])::double"


# The driver's invented prose has no market words: these lists name words that it does have.
PROSE_WORDS = (*S.BULLISH_WORDS, "the", "and"), (*S.BEARISH_WORDS, "of", "der")


def prose_logits(text):
    return S.word_logits(text, *PROSE_WORDS)


WORD_SCORE_SQL = f"""
SELECT doc_id, ticker, (exp(l2) - exp(l0)) / (exp(l0) + 1 + exp(l2)) AS score FROM (
  SELECT doc_id, ticker, {word_count_sql(PROSE_WORDS[1])} / len(w) AS l0, {word_count_sql(PROSE_WORDS[0])} / len(w) AS l2
  FROM (SELECT doc_id, ticker, regexp_split_to_array(lower(title), '[^\\p{{L}}]+') AS w FROM news_data))"""


@query("u4_word_scorer", "news_data", f"SELECT doc_id, round(score, 6) AS score FROM ({WORD_SCORE_SQL})")
def _(v):
    score = S.sentiment_from_logits(prose_logits(F.col("title")))
    return rounded(v.news_data().select("doc_id", score.alias("score")), 6, "score")


@query("u4_learned_scorer")
def _(v):
    """Labelled documents as titles: low quality is class 0, the rest class 2; a quarter is held out. Scores of all, both scorers."""
    rows = v._table("documents").join(v._table("labels"), "doc_id").select(
        "doc_id", "text", F.when(F.col("quality") == 0, 0).otherwise(2).alias("label"),
        (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2).alias("held_out"))
    # Cutting texts costs far more than moving them: all cores take part, however few row groups hold the documents.
    rows = rows.repartition("doc_id")
    model = L.fit(rows.filter(~F.col("held_out")), "text")
    learned, listed = L.learned_logits(v.spark, model), S.word_logits
    scored = rows.select("doc_id", "label", "held_out", *[
        S.sentiment_from_logits(scorer(F.col("text"))).alias(name) for name, scorer in (("score", learned), ("list_score", listed))])
    return rounded(scored, 6, "score", "list_score")
