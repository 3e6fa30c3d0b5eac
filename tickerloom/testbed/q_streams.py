"""Streams (S8, R): bars travel as JSON files written from the driver tables, then through Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tickerloom import schemas
from tickerloom.session import work_path
from tickerloom.sources import messages
from tickerloom.streaming import bars as B, revisions as R
from tickerloom.testbed.q_groups import RSI_SQL
from tickerloom.testbed.q_tables import BARS_SQL
from tickerloom.testbed.registry import day, moment, query, rounded
from tickerloom.testbed.views import Views

HALF = "2024-01-16"


def _stream(v: Views, path: str) -> DataFrame:
    return messages.parse_bars(messages.consume_files(v.spark, path)).bars


def _drained(v: Views, stream: DataFrame) -> DataFrame:
    out, log = work_path(v.spark, "out"), work_path(v.spark, "checkpoint")
    B.drain(stream, out, log).awaitTermination()
    return v.spark.read.schema(stream.schema).parquet(out)


@query("s8_consume", "prices", f"""
SELECT 'bar' AS kind, "Ticker" || '@' || {day('"Date"')} AS what FROM prices UNION ALL
SELECT 'reject', '{{"Ticker": "' || "Ticker" || '", "Close": oops' FROM (SELECT DISTINCT "Ticker" FROM prices) UNION ALL
SELECT 'reject', '{{"Ticker": "' || "Ticker" || '", "Date": "someday"}}' FROM (SELECT DISTINCT "Ticker" FROM prices)""")
def _(v):
    path = work_path(v.spark, "topic")
    bars = v.prices()
    messages.publish_to_files(bars, path)
    tickers = bars.select("Ticker").distinct()
    for tail in (', "Close": oops', ', "Date": "someday"}'):
        broken = F.concat(F.lit('{"Ticker": "'), "Ticker", F.lit('"' + tail))
        tickers.select(broken.alias("value")).write.mode("append").text(path)
    good, bad, log = (work_path(v.spark, n) for n in ("bars", "rejects", "checkpoint"))
    messages.drain_parsed(messages.consume_files(v.spark, path), good, bad, log).awaitTermination()
    at = F.concat("Ticker", F.lit("@"), F.date_format("Date", "yyyy-MM-dd"))
    bars = v.spark.read.schema(schemas.BARS).parquet(good)
    return bars.select(F.lit("bar").alias("kind"), at.alias("what")).unionByName(
        v.spark.read.schema("value string").parquet(bad).select(F.lit("reject").alias("kind"), F.col("value").alias("what"))
    )


@query("r1_earliest_offset", "prices", BARS_SQL + "prices")
def _(v):
    path = work_path(v.spark, "topic")
    messages.publish_to_files(v.prices(), path)
    return _drained(v, _stream(v, path))


def _in_two_halves(v: Views, path: str, run) -> None:
    """Publishes the days before and from HALF on, letting ``run`` drain after each."""
    bars = v.prices()
    for part in (F.col("Date") < HALF, F.col("Date") >= HALF):
        messages.publish_to_files(bars.filter(part), path)
        run()


@query("r2_bounded_drain", "prices", BARS_SQL + "prices")
def _(v):
    """A drain that is started again takes only what is new."""
    path, out, log = (work_path(v.spark, n) for n in ("topic", "out", "checkpoint"))
    _in_two_halves(v, path, lambda: B.drain(_stream(v, path), out, log).awaitTermination())
    return v.spark.read.schema(schemas.BARS).parquet(out)


def _after_each(v: Views, path: str, step, log: str) -> None:
    started = _stream(v, path).writeStream.foreachBatch(step).option("checkpointLocation", log)
    started.trigger(availableNow=True).start().awaitTermination()


def _with_late_bars(v: Views, path: str, run) -> None:
    """As :func:`_in_two_halves`, but every seventh ticker's first day comes last, on its own."""
    bars = v.prices()
    first = F.min("Date").over(Window.partitionBy("Ticker"))
    late = (F.pmod(F.col("Ticker").cast("bigint"), F.lit(7)) == 3) & (F.col("Date") == first)
    marked = bars.withColumn("_late", late)
    for part in (~F.col("_late") & (F.col("Date") < HALF), ~F.col("_late") & (F.col("Date") >= HALF), F.col("_late")):
        messages.publish_to_files(marked.filter(part).drop("_late"), path)
        run()


@query("r3_rsi_after_batch", "rsi", RSI_SQL)
def _(v):
    """Late bars and all: the last batch holds the first day of some tickers."""
    path, bars, rated, log = (work_path(v.spark, n) for n in ("topic", "bars", "rsi", "checkpoint"))
    _with_late_bars(v, path, lambda: _after_each(v, path, B.rsi_after_batch(bars, rated), log))
    return rounded(B.current_rsi(v.spark, rated).select("Ticker", "Date", "Close", "RSI"), 6, "RSI")


LATE_SQL = """(SELECT "Ticker", min("Date") AS "Date" FROM prices WHERE "Ticker"::bigint % 7 = 3 GROUP BY "Ticker")"""


@query("r4_stream_rsi", "prices", f"""
WITH late AS (SELECT * FROM {LATE_SQL} l WHERE EXISTS (SELECT 1 FROM prices p WHERE p."Ticker" = l."Ticker" AND p."Date" > l."Date")),
p AS (SELECT * FROM prices ANTI JOIN late USING ("Ticker", "Date")),
d AS (SELECT *, "Close" - lag("Close") OVER (PARTITION BY "Ticker" ORDER BY "Date") AS delta FROM p),
r AS (SELECT "Ticker", "Date", "Close", avg(greatest(coalesce(delta, 0), 0)) OVER w AS gain, avg(greatest(-coalesce(delta, 0), 0)) OVER w AS loss,
             count(*) OVER w AS seen FROM d WINDOW w AS (PARTITION BY "Ticker" ORDER BY "Date" ROWS 13 PRECEDING))
SELECT "Ticker", {day('"Date"')} AS "Date", "Close", round(CASE WHEN loss > 0 THEN 100 - 100 / (1 + gain / loss) ELSE 100.0 END, 6) AS "RSI", false AS late
FROM r WHERE seen >= 14 AND (loss > 0 OR gain > 0)
UNION ALL SELECT "Ticker", {day('"Date"')}, "Close", NULL, true FROM prices SEMI JOIN late USING ("Ticker", "Date")""")
def _(v):
    """Late bars come out marked, for the batch form to take up."""
    path, out, log = (work_path(v.spark, n) for n in ("topic", "out", "checkpoint"))
    _with_late_bars(v, path, lambda: B.drain(B.stream_rsi(_stream(v, path)), out, log).awaitTermination())
    return rounded(v.spark.read.schema(B.RATED).parquet(out), 6, "RSI")


@query("r4_revised_rsi", "rsi", RSI_SQL)
def _(v):
    """Late bars are taken up, and what they change is given out anew."""
    path, out, log = (work_path(v.spark, n) for n in ("topic", "out", "checkpoint"))
    _with_late_bars(v, path, lambda: B.drain(R.revised_rsi(_stream(v, path)), out, log).awaitTermination())
    rated = R.newest(v.spark.read.schema(R.RATED).parquet(out), "Ticker", "Date").filter(F.col("RSI").isNotNull())
    return rounded(rated.select("Ticker", "Date", "Close", "RSI"), 6, "RSI")


@query("r5_dedupe_bars", "prices", f"""SELECT "Ticker", {day('"Date"')} AS "Date", "Close" FROM prices""")
def _(v):
    """A producer that runs again, weeks later, and late bars in between."""
    path, out, log = (work_path(v.spark, n) for n in ("topic", "bars", "checkpoint"))
    _with_late_bars(v, path, lambda: _after_each(v, path, B.new_bars(out), log))
    messages.publish_to_files(v.prices(), path)
    _after_each(v, path, B.new_bars(out), log)
    return B.read_bars(v.spark, out).select("Ticker", "Date", "Close")


def _weeks_sql(slide: int) -> str:
    return f"""
WITH s AS (SELECT unnest(range({7 // slide})) AS back),
w AS (SELECT time_bucket(INTERVAL {slide} DAY, "Date"::timestamp, TIMESTAMP '1970-01-01') - to_days(({slide} * back)::int) AS s, p.*, r."RSI"
      FROM prices p LEFT JOIN rsi r USING ("Ticker", "Date"), s)
SELECT {moment('s')} AS week_start, "Ticker", max("High") AS high, min("Low") AS low, count(*) AS bars,
       count(*) FILTER ("RSI" > 70) AS overbought, count(*) FILTER ("RSI" < 30) AS oversold FROM w GROUP BY s, "Ticker" """


def _weeks(v: Views, slide: str) -> DataFrame:
    path, bars, rated, log = (work_path(v.spark, n) for n in ("topic", "bars", "rsi", "checkpoint"))
    _with_late_bars(v, path, lambda: _after_each(v, path, B.rsi_after_batch(bars, rated), log))
    return B.weekly_range(B.current(v.spark, rated, schemas.BARS_WITH_RSI), slide)


@query("r6_weekly_range", "prices rsi", _weeks_sql(7))
def _(v):
    return _weeks(v, "7 days")


@query("r6_rolling_week", "prices rsi", _weeks_sql(1))
def _(v):
    return _weeks(v, "1 day")


def _streamed_weeks(v: Views, slide: int) -> DataFrame:
    path, out, log = (work_path(v.spark, n) for n in ("topic", "out", "checkpoint"))
    _with_late_bars(v, path, lambda: B.drain(R.revised_weeks(_stream(v, path), slide), out, log).awaitTermination())
    return R.newest(v.spark.read.schema(R.WEEKS).parquet(out), "Ticker", "week_start")


@query("r6_streamed_weeks", "prices rsi", _weeks_sql(7))
def _(v):
    return _streamed_weeks(v, 7)


@query("r6_streamed_rolling_weeks", "prices rsi", _weeks_sql(1))
def _(v):
    return _streamed_weeks(v, 1)
