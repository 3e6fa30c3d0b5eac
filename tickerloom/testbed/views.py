"""The model's tables as views of the driver tables, in Spark and in SQL.

Each view has a function (Spark) and an entry in ``SQL`` of the same name. Keys come from the rows themselves,
never from a position in a scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tickerloom.operators.indicators import pct_change
from tickerloom.operators.reshape import long_to_wide

COINS = 50


class Views:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def prices(self) -> DataFrame:
        """Daily bars of each user's event values; one row per (Ticker, Date)."""
        when = F.struct("ts", "event_id")
        return (
            self._table("events")
            .groupBy(F.col("user_id").cast("string").alias("Ticker"), F.to_date("ts").alias("Date"))
            .agg(
                F.min_by("value", when).alias("Open"),
                F.max("value").alias("High"),
                F.min("value").alias("Low"),
                F.max_by("value", when).alias("Close"),
                F.count("value").alias("Volume"),
            )
            .select("Date", "Ticker", "Open", "High", "Low", "Close", "Volume")
        )

    def ticks(self) -> DataFrame:
        """Every event as a tick of its type: five series that hold all rows between them."""
        return self._table("events").select(
            F.col("event_type").alias("Ticker"), "ts", "event_id", F.col("value").alias("Close")
        )

    def changes(self) -> DataFrame:
        """The daily price table: bars with their change."""
        return pct_change(self.prices())

    def wide(self) -> DataFrame:
        """One column per (event type, field) and day; the five types stand for tickers."""
        when = F.struct("ts", "event_id")
        bars = (
            self._table("events")
            .groupBy(F.col("event_type").alias("Ticker"), F.to_date("ts").alias("Date"))
            .agg(
                F.min_by("value", when).alias("Open"),
                F.max("value").alias("High"),
                F.min("value").alias("Low"),
                F.max_by("value", when).alias("Close"),
                F.count("value").alias("Volume"),
            )
        )
        return long_to_wide(bars, list(EVENT_TYPES))

    def transactions(self) -> DataFrame:
        """Line items as ledger rows; the four-part key packed into one number is their id."""
        line = self._table("lineitem")
        owner = self._table("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("user_id"))
        # Prices are whole cents and quantities whole numbers, kept in doubles: integers become decimals
        # far faster than doubles do.
        cents, coins = F.round(F.col("l_extendedprice") * 100).cast("bigint"), F.col("l_quantity").cast("bigint")
        unit_cents = F.expr("(2 * cents + coins) div (2 * coins)")
        line = line.withColumns({"cents": cents, "coins": coins})
        kind = (
            F.when(F.col("l_returnflag").isin("N", "A"), "buy")
            .when(F.col("l_linestatus") == "F", "sell")
            .otherwise("p2p-sell")
        )
        return line.join(owner, "l_orderkey").select(
            transaction_id().alias("transaction_id"),
            "user_id",
            F.col("l_partkey").alias("crypto_price_id"),
            F.col("coins").cast("decimal(18,8)").alias("number_of_coins"),
            (F.col("cents") * cent()).cast("decimal(15,8)").alias("amount"),
            (unit_cents * cent()).cast("decimal(15,2)").alias("cost"),
            kind.alias("transaction_type"),
            F.col("l_shipdate").cast("timestamp").alias("created_at"),
            F.col("l_suppkey").alias("other_user"),
            F.col("l_linenumber").cast("bigint").alias("line"),
        )

    def crypto_price(self) -> DataFrame:
        return self._table("part").select(
            F.col("p_partkey").alias("crypto_price_id"),
            F.concat(F.lit("C"), (F.col("p_partkey") % COINS).cast("string"), F.lit("-USD")).alias("ticker"),
            F.col("p_retailprice").cast("string").alias("current_price"),
            F.lit("USD").alias("fiat_currency"),
        )

    def users(self) -> DataFrame:
        return self._table("customer").select(
            F.col("c_custkey").alias("user_id"),
            F.col("c_name").alias("name"),
            F.concat(F.lower("c_name"), F.lit("@example.com")).alias("email"),
            F.concat(F.lit("+"), F.col("c_custkey").cast("string")).alias("phone"),
            F.when(F.col("c_acctbal") < 0, "Not Verified").otherwise("Verified").alias("status"),
        )

    def wallet(self) -> DataFrame:
        return self._table("customer").select(
            F.col("c_custkey").alias("user_id"), F.col("c_acctbal").cast("string").alias("amount")
        )

    def p2p_orders(self) -> DataFrame:
        return self._table("orders").select(
            F.col("o_orderkey").alias("order_id"),
            F.col("o_custkey").alias("user_id"),
            F.concat(F.lit("C"), (F.col("o_orderkey") % COINS).cast("string"), F.lit("-USD")).alias("ticker"),
            F.col("o_totalprice").cast("decimal(15,8)").alias("price"),
            F.when(F.col("o_orderpriority").substr(1, 1).isin("1", "2", "3"), "Wallet").otherwise("Bank").alias("payment_mode"),
            F.when(F.col("o_orderstatus") == "F", "completed").otherwise("pending").alias("status"),
            F.col("o_orderdate").cast("timestamp").alias("created_at"),
            F.lit(None).cast("decimal(38,0)").alias("transaction_id"),
        )

    def news_data(self) -> DataFrame:
        minutes = F.col("doc_id") * F.lit(60).cast("bigint") + F.lit(1_704_067_200).cast("bigint")
        return self._table("documents").select(
            "doc_id", F.col("source").alias("ticker"), F.col("text").alias("title"), F.col("lang").alias("source"),
            F.timestamp_seconds(minutes).alias("date_time"),
        )

    def logits(self) -> DataFrame:
        three = F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double"))
        return self._table("embeddings").select("vec_id", F.col("label").cast("string").alias("ticker"), three.alias("logits"))

    def scores(self) -> DataFrame:
        """Stored scores: two per vector, under tickers that carry a dash."""
        embedding = F.transform("embedding", lambda x: x.cast("double"))
        return self._table("embeddings").select(
            F.concat((F.col("label") % 5).cast("string"), F.lit("-"), (F.col("label") % 2).cast("string")).alias("ticker"),
            embedding[0].alias("avg_sentiment_score"),
            embedding[1].alias("avg_sentiment_score1"),
        )

    def icons(self) -> DataFrame:
        """An icon for each customer in credit, a second one in one market segment."""
        customer = self._table("customer")
        key = F.col("c_custkey").cast("string")
        own = customer.filter(F.col("c_acctbal") >= 0).select(F.concat(key, F.lit(".png")).alias("image_name"))
        second = customer.filter(F.col("c_mktsegment") == "BUILDING").select(F.concat(key, F.lit("-.png")).alias("image_name"))
        return own.unionByName(second)

    def pages(self) -> DataFrame:
        """Captured pages: the top-level domain stands for the ticker, the path's first folder for the address tried."""
        domain = F.regexp_extract("url", r"^http[s]?://[^/]*\.([a-z]+)[/:?]?", 1)
        second = F.when(F.col("html").startswith('<!DOCTYPE html><html lang="en">'), 1).otherwise(2)
        return self._table("pages").select("page_id", domain.alias("ticker"), second.alias("priority"), "html")


EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def cent():
    return F.lit("0.01").cast("decimal(2,2)")


def transaction_id():
    def part(name: str, scale: int):
        return F.col(name).cast("decimal(20,0)") * F.lit("1" + "0" * scale).cast(f"decimal({scale + 1},0)")

    packed = part("l_orderkey", 22) + part("l_linenumber", 21) + part("l_partkey", 10) + F.col("l_suppkey")
    return packed.cast("decimal(38,0)")


_BARS_SQL = """
  SELECT cast(ts AS date) AS "Date", {ticker} AS "Ticker",
         arg_min(value, (ts, event_id)) AS "Open", max(value) AS "High", min(value) AS "Low",
         arg_max(value, (ts, event_id)) AS "Close", count(value) AS "Volume"
  FROM events GROUP BY ALL"""

SQL = {
    "prices": _BARS_SQL.format(ticker="cast(user_id AS varchar)"),
    "type_bars": _BARS_SQL.format(ticker="event_type"),
    "ticks": """SELECT event_type AS "Ticker", ts, event_id, value AS "Close" FROM events""",
    "changes": """
  SELECT * FROM (SELECT *, "Close" / lag("Close") OVER (PARTITION BY "Ticker" ORDER BY "Date") - 1 AS percentage_change
                 FROM prices) WHERE percentage_change IS NOT NULL AND NOT isnan(percentage_change)
                                AND NOT isinf(percentage_change)""",
    "transactions": """
  SELECT l_orderkey::hugeint * 10000000000000000000000::hugeint + l_linenumber::hugeint * 1000000000000000000000::hugeint
         + l_partkey::hugeint * 10000000000::hugeint + l_suppkey::hugeint AS transaction_id,
         o_custkey AS user_id, l_partkey AS crypto_price_id, l_quantity::decimal(18,8) AS number_of_coins,
         l_extendedprice::decimal(15,8) AS amount,
         -- cents per coin, half up, in whole numbers
         ((2 * round(l_extendedprice * 100)::bigint + l_quantity::bigint) // (2 * l_quantity::bigint))::decimal(17,0)
           * 0.01::decimal(3,2) AS cost,
         CASE WHEN l_returnflag IN ('N', 'A') THEN 'buy' WHEN l_linestatus = 'F' THEN 'sell' ELSE 'p2p-sell' END
           AS transaction_type,
         l_shipdate::timestamp AS created_at, l_suppkey AS other_user, l_linenumber::bigint AS line
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "crypto_price": """
  SELECT p_partkey AS crypto_price_id, 'C' || (p_partkey % 50) || '-USD' AS ticker,
         cast(p_retailprice AS varchar) AS current_price, 'USD' AS fiat_currency FROM part""",
    "users": """
  SELECT c_custkey AS user_id, c_name AS name, lower(c_name) || '@example.com' AS email, '+' || c_custkey AS phone,
         CASE WHEN c_acctbal < 0 THEN 'Not Verified' ELSE 'Verified' END AS status FROM customer""",
    "wallet": "SELECT c_custkey AS user_id, cast(c_acctbal AS varchar) AS amount FROM customer",
    "p2p_orders": """
  SELECT o_orderkey AS order_id, o_custkey AS user_id, 'C' || (o_orderkey % 50) || '-USD' AS ticker,
         o_totalprice::decimal(15,8) AS price,
         CASE WHEN o_orderpriority[1] IN ('1', '2', '3') THEN 'Wallet' ELSE 'Bank' END AS payment_mode,
         CASE WHEN o_orderstatus = 'F' THEN 'completed' ELSE 'pending' END AS status,
         o_orderdate::timestamp AS created_at FROM orders""",
    "news_data": """
  SELECT doc_id, source AS ticker, text AS title, lang AS source,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS date_time FROM documents""",
    "logits": """
  SELECT vec_id, cast(label AS varchar) AS ticker, embedding[1]::double AS l0, embedding[2]::double AS l1,
         embedding[3]::double AS l2 FROM embeddings""",
    "scores": """
  SELECT (label % 5) || '-' || (label % 2) AS ticker, embedding[1]::double AS avg_sentiment_score,
         embedding[2]::double AS avg_sentiment_score1 FROM embeddings""",
    "icons": """
  SELECT c_custkey || '.png' AS image_name FROM customer WHERE c_acctbal >= 0
  UNION ALL SELECT c_custkey || '-.png' FROM customer WHERE c_mktsegment = 'BUILDING'""",
    "rsi": """
  SELECT * FROM (
    SELECT *, CASE WHEN loss > 0 THEN 100 - 100 / (1 + gain / loss) WHEN gain > 0 THEN 100.0 END AS "RSI" FROM (
      SELECT *, avg(up) OVER w AS gain, avg(down) OVER w AS loss, count(*) OVER w AS seen FROM (
        SELECT *, CASE WHEN delta > 0 THEN delta ELSE 0 END AS up, CASE WHEN delta < 0 THEN -delta ELSE 0 END AS down FROM (
          SELECT *, "Close" - lag("Close") OVER (PARTITION BY "Ticker" ORDER BY "Date") AS delta FROM prices))
      WINDOW w AS (PARTITION BY "Ticker" ORDER BY "Date" ROWS 13 PRECEDING))
    WHERE seen >= 14) WHERE "RSI" IS NOT NULL""",
}

# Views that other views read.
NEEDS = {"changes": ["prices"], "rsi": ["prices"]}


def with_views(*names: str, body: str) -> str:
    order: list[str] = []
    for name in names:
        for n in (*NEEDS.get(name, []), name):
            if n not in order:
                order.append(n)
    body = body.strip()
    if body.startswith("WITH "):
        body = "," + body[len("WITH"):]
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in order) + "\n" + body
