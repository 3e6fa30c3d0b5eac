"""Sources and sinks (S) and reshaping (T). Files are first written from the driver tables, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickerloom import schemas
from tickerloom.functions.text import parse_news_time
from tickerloom.operators.indicators import rsi
from tickerloom.operators.latest import first_nonempty_source
from tickerloom.operators.ordering import concat_all
from tickerloom.operators.aggregates import rsi_summary
from tickerloom.operators.reshape import flatten_names, long_to_wide, wide_to_long
from tickerloom.plans.prices import rsi_chart_data
from tickerloom.session import work_path
from tickerloom.sources import files, headlines, messages
from tickerloom.testbed.registry import day, moment, query, rounded
from tickerloom.testbed.views import EVENT_TYPES, Views

BARS_SQL = f"""SELECT {day('"Date"')} AS "Date", "Ticker", "Open", "High", "Low", "Close", "Volume" FROM """


@query("s1_read_prices", "prices", BARS_SQL + "prices")
def _(v):
    path = work_path(v.spark, "prices")
    files.write_csv(v.prices(), path)
    return files.read_prices(v.spark, path)


def _news_csv(v: Views):
    """News rows as the CSV holds them: some titles are the word N/A, some sources another missing word."""
    news, toxic = v.news_data(), v._table("labels").select("doc_id", F.col("toxic"))
    marked = news.join(toxic, "doc_id", "left")
    return marked.select(
        F.col("ticker").alias("Ticker"),
        F.when(F.col("toxic") == 1, "N/A").otherwise(F.col("title")).alias("Title"),
        F.when(F.col("source") == "de", "null").otherwise(F.col("source")).alias("Source"),
        F.date_format("date_time", "yyyy-MM-dd HH:mm:ss").alias("date_time"),
    )


NEWS_CSV_SQL = """
SELECT ticker AS "Ticker", md5(CASE WHEN toxic = 1 THEN NULL ELSE title END) AS title_md5,
       CASE WHEN source <> 'de' THEN source END AS "Source", strftime(date_time, '%Y-%m-%d %H:%M:%S') AS date_time
FROM news_data LEFT JOIN labels USING (doc_id)"""


@query("s2_read_news", "news_data", NEWS_CSV_SQL)
def _(v):
    path = work_path(v.spark, "news")
    files.write_csv(_news_csv(v), path, bom=True)
    return files.read_news(v.spark, path, line_breaks=True).select("Ticker", F.md5("Title").alias("title_md5"), "Source", "date_time")


@query("s3_read_news_escaped", "news_data", f"""
SELECT CASE ticker WHEN 'src3' THEN 'Ticker' ELSE ticker END AS "Ticker", md5(replace(title, chr(10), ' ')) AS title_md5,
       source AS "Source", {moment('date_time')} AS date_time FROM news_data""")
def _(v):
    path = work_path(v.spark, "escaped")
    time = F.date_format("date_time", "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    name = F.when(F.col("ticker") == "src3", "Ticker").otherwise(F.col("ticker"))
    files.write_news_escaped(v.news_data().select(name.alias("ticker"), "title", "source", time), path, header=True)
    back = files.read_news_escaped(v.spark, path)
    return back.select(
        "Ticker", F.md5("Title").alias("title_md5"), "Source", parse_news_time(F.col("date_time")).alias("date_time")
    )


PRICE_CSV = ["ticker", "current_price", "fiat_currency"]


@query("s4_read_csv_strict", "crypto_price", """
SELECT ticker, current_price, fiat_currency, 'right header' AS file FROM crypto_price
UNION ALL SELECT NULL, NULL, NULL, 'wrong header: nothing loaded'""")
def _(v):
    right, wrong = work_path(v.spark, "right"), work_path(v.spark, "wrong")
    rows = v.crypto_price().select(*PRICE_CSV)
    files.write_csv(rows, right)
    # The right header as a later line does not make up for a wrong first one.
    files.write_csv(rows.limit(3).withColumnRenamed("fiat_currency", "junk").unionByName(
        v.spark.createDataFrame([PRICE_CSV], ["ticker", "current_price", "junk"])).coalesce(1), wrong)
    loaded = files.read_csv_strict(v.spark, right, schemas.CRYPTO_PRICE_CSV, PRICE_CSV)
    try:
        refused = files.read_csv_strict(v.spark, wrong, schemas.CRYPTO_PRICE_CSV, PRICE_CSV)
    except files.HeaderMismatch:
        refused = v.spark.range(1).select(*[F.lit(None).cast("string").alias(c) for c in PRICE_CSV])
    return loaded.withColumn("file", F.lit("right header")).unionByName(
        refused.withColumn("file", F.lit("wrong header: nothing loaded"))
    )


@query("s5_load_prices", "crypto_price", """
SELECT ticker, current_price, fiat_currency FROM crypto_price UNION ALL
SELECT ticker, current_price, fiat_currency FROM crypto_price""")
def _(v):
    path, table = work_path(v.spark, "csv"), work_path(v.spark, "crypto_price")
    files.write_csv(v.crypto_price().select(*PRICE_CSV), path)
    files.load_prices(v.spark, path, table)
    return files.load_prices(v.spark, path, table)


@query("s6_table", sql="SELECT * FROM customer")
def _(v):
    return files.table(v.spark, v.folder, "customer")


@query("s7_publish", "prices", f"""
SELECT {day('"Date"')} AS key, {day('"Date"')} AS "Date", "Ticker", "Close", "Volume" FROM prices""")
def _(v):
    sent = messages.to_messages(v.prices())
    record = F.from_json("value", messages.BAR_RECORD)
    return sent.select("key", record.alias("r")).select("key", "r.Date", "r.Ticker", "r.Close", "r.Volume")


@query("s9_write_csv", "prices", f"""
SELECT "Ticker" || ',' || {day('"Date"')} || ',' || cast("Volume" AS varchar) AS line FROM prices""")
def _(v):
    path = work_path(v.spark, "csv")
    files.write_csv(v.prices().select("Ticker", "Date", "Volume"), path)
    return v.spark.read.text(path).select(F.col("value").alias("line")).filter(F.col("line") != "Ticker,Date,Volume")


@query("s10_publish_files", "rsi", f"""SELECT "Ticker", {day('"Date"')} AS "Date", round("RSI", 6) AS "RSI" FROM rsi""")
def _(v):
    path = files.publish_files(rsi(v.prices()), work_path(v.spark, "store"), "rsi_data/")
    return rounded(v.spark.read.schema(schemas.BARS_WITH_RSI).parquet(path).select("Ticker", "Date", "RSI"), 6, "RSI")


@query("s11_read_prefix", "prices", """
SELECT 'daily' AS kind, "Ticker", "Volume" FROM prices UNION ALL
SELECT 'again', "Ticker", "Volume" FROM prices""")
def _(v):
    base = work_path(v.spark, "store")
    for kind in ("daily", "again"):
        files.publish_files(v.prices().select("Ticker", "Volume"), base, f"rsi_data/{kind}")
    kind = F.element_at(F.split("file_path", "/"), -2)
    return files.read_prefix(v.spark, base, "rsi_data").select(kind.alias("kind"), "Ticker", "Volume")


@query("s12_append", "prices", BARS_SQL + "prices")
def _(v):
    """Every day is a load; the later ones are loaded twice, which leaves each day once and the earlier ones as they are."""
    path = work_path(v.spark, "crypto_data")
    bars = v.prices().withColumn("run", F.date_format("Date", "yyyy-MM-dd"))
    for part in (bars, bars.filter(F.col("Date") >= "2024-01-16")):
        files.append(part, path, run="run")
    return v.spark.read.schema(f"{schemas.BARS}, run string").parquet(path).drop("run")


@query("s13_rename", "rsi", """
SELECT "Ticker", 100.0 * count(*) FILTER ("RSI" > 70) / count(*) AS "OverboughtPercent",
       100.0 * count(*) FILTER ("RSI" < 30) / count(*) AS "OversoldPercent" FROM rsi GROUP BY "Ticker" """)
def _(v):
    as_file = rsi_summary(rsi(v.prices())).withColumnsRenamed(
        {"OverboughtPercent": "Overbought%", "OversoldPercent": "Oversold%"}
    )
    return files.rename_rsi_summary(as_file).select("Ticker", "OverboughtPercent", "OversoldPercent")


H1 = headlines.Selector("h1")
DRIVER_PAGES = headlines.CardSelectors(
    card=headlines.Selector("article"), title=H1, provider=headlines.Selector("cite"), clock=headlines.Selector("time")
)
DOMAIN_SQL = r"regexp_extract(url, '^http[s]?://[^/]*\.([a-z]+)[/:?]?', 1)"
PRIORITY_SQL = """CASE WHEN html LIKE '<!DOCTYPE html><html lang="en">%' THEN 1 ELSE 2 END"""
# An entity that is cut off before its semicolon still counts.
TITLE_SQL = """regexp_replace(replace(replace(regexp_extract(html, '<h1>(.*?)</h1>', 1, 's'), '&quot;', '"'), '&#x27;', chr(39)),
  '&amp;?', '&', 'g')"""


@query("s14_extract_headlines", sql=f"""
SELECT page_id, {DOMAIN_SQL} AS ticker, 0::bigint AS position, trim({TITLE_SQL}) AS title, 'N/A' AS source, 'N/A' AS raw_time
FROM pages""")
def _(v):
    return headlines.extract_headlines(v.pages(), DRIVER_PAGES)


@query("s15_first_nonempty_source", sql=f"""
WITH p AS (SELECT page_id, {DOMAIN_SQL} AS ticker, {PRIORITY_SQL} AS priority FROM pages)
SELECT page_id, ticker, priority::bigint AS priority FROM p
WHERE priority = (SELECT min(priority) FROM p q WHERE q.ticker = p.ticker)""")
def _(v):
    return first_nonempty_source(v.pages().select("page_id", "ticker", "priority"), "ticker", "priority")


CHART_SQL = f"""
SELECT {day('"Date"')} AS "Date", "Ticker", round("RSI", 6) AS "RSI",
       CASE WHEN "RSI" > 70 THEN 'overbought' WHEN "RSI" < 30 THEN 'oversold' ELSE 'neutral' END AS level,
       70.0::double AS overbought_at, 30.0::double AS oversold_at
FROM rsi WHERE "Date" >= (SELECT max("Date") FROM rsi) - 7"""


@query("s16_rsi_chart_data", "rsi", CHART_SQL)
def _(v):
    return rounded(rsi_chart_data(rsi(v.prices())), 6, "RSI")


@query("t1_wide_to_long", "type_bars", BARS_SQL + "type_bars")
def _(v):
    return wide_to_long(v.wide(), list(EVENT_TYPES))


@query("t1_long_to_wide", "type_bars", f"""
SELECT {day('"Date"')} AS "Date", """ + ", ".join(
    f"""max("Close") FILTER ("Ticker" = '{t}') AS close_{t}, max("Volume") FILTER ("Ticker" = '{t}') AS volume_{t}""" for t in EVENT_TYPES
) + ' FROM type_bars GROUP BY "Date"')
def _(v):
    wide = long_to_wide(wide_to_long(v.wide(), list(EVENT_TYPES)), list(EVENT_TYPES), ("Close", "Volume"))
    return wide.select("Date", *[F.col(f"`{t}|{f}`").alias(f"{f.lower()}_{t}") for t in EVENT_TYPES for f in ("Close", "Volume")])


@query("t2_flatten_names", "prices", f"""SELECT {day('"Date"')} AS day, "Ticker" AS coin, "Close" AS last FROM prices""")
def _(v):
    return flatten_names(v.prices().select("Date", "Ticker", "Close"), ["day", "coin", "last"])


@query("t3_concat_batches", "prices type_bars", f"{BARS_SQL} (SELECT * FROM prices UNION ALL SELECT * FROM type_bars UNION ALL SELECT * FROM prices)")
def _(v):
    return concat_all([v.prices(), wide_to_long(v.wide(), list(EVENT_TYPES)), v.prices()])
