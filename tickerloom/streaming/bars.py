"""Bars as a stream: bounded drain, RSI after each batch, incremental RSI, replay removal; weekly ranges of the result."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tickerloom import schemas
from tickerloom.functions.numbers import OVERBOUGHT, OVERSOLD
from tickerloom.operators.indicators import rsi, unique_bars
from tickerloom.session import discard, staged
from tickerloom.sources.versions import Store

BATCH = "batch"
#: Days before a batch's first that are looked through for the bars before it; tickers with fewer bars there are looked up further back.
NEAR_DAYS = 92
RATED = "Ticker string, Date date, Close double, RSI double, late boolean"


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Writes everything there is now to Parquet, then stops."""
    return (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )


TABLE = "bars"
_DAY = "Date"


def new_bars(path: str):
    """A ``foreachBatch`` function that keeps one bar of each (ticker, day), however late a repeated one comes.

    The table is a :class:`~tickerloom.sources.versions.Store` at ``path``. A batch is compared with the parts, and in them the row
    groups, that hold days between its first and its last. A batch that is run again changes nothing, no bar is lost to
    a watermark, and parts are merged in tiers, so that many batches leave few of them.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        store = Store(batch.sparkSession, path)
        if store.applied(TABLE) >= batch_id:
            return
        once, at = staged(unique_bars(batch), "batch")
        first, last = once.agg(F.min(_DAY), F.max(_DAY)).first()
        fresh = once
        if store.version and first is not None:
            known = store.read(TABLE, first, last).select("Ticker", _DAY)
            fresh = once.join(known, ["Ticker", _DAY], "left_anti").select(once.columns)
        change = store.change()
        change.append(TABLE, fresh, _DAY)
        change.merge(TABLE)
        change.commit(TABLE, batch_id)
        discard(batch.sparkSession, at)

    return run


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    """What :func:`new_bars` has kept so far."""
    return Store(spark, path).read(TABLE)


def weekly_range(bars: DataFrame, slide: str = "7 days") -> DataFrame:
    """High, low and number of bars per ticker and seven-day window, the last ones included.

    Windows follow each other; with a ``slide`` of "1 day" they roll. Where the bars have an RSI, its overbought and
    oversold days are counted as well. A streamed table is read back and reported after each drain.
    """
    rated = "RSI" in bars.columns
    counts = [F.count(F.when(F.col("RSI") > OVERBOUGHT, 1)).alias("overbought"),
              F.count(F.when(F.col("RSI") < OVERSOLD, 1)).alias("oversold")] if rated else []
    window = F.window(F.col("Date").cast("timestamp"), "7 days", slide)
    return bars.groupBy(window.alias("w"), "Ticker").agg(
        F.max("High").alias("high"), F.min("Low").alias("low"), F.count(F.lit(1)).alias("bars"), *counts
    ).select(F.col("w.start").alias("week_start"), "Ticker", "high", "low", "bars", *(["overbought", "oversold"] if rated else []))


def current(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of :func:`rsi_after_batch`: of each (ticker, day) the row of the newest batch, in the columns of ``schema``."""
    store = Store(spark, path)
    if not store.version:
        return spark.createDataFrame([], schema)
    rows = unique_bars(store.read(store.tables()[0]), prefer=[BATCH])
    return rows.select(*[f.name for f in T.StructType.fromDDL(schema)])


def current_rsi(spark: SparkSession, path: str) -> DataFrame:
    """The bars that have an RSI now. A day whose newest row has none no longer shows an earlier one."""
    return current(spark, path, schemas.BARS_WITH_RSI).filter(F.col("RSI").isNotNull())


def _newest(rows: DataFrame) -> DataFrame:
    return unique_bars(rows, prefer=[BATCH])


def rsi_after_batch(bars_path: str, rsi_path: str, period: int = 14):
    """A ``foreachBatch`` function that adds a batch's bars, and the RSI of its tickers from its first day on.

    Both tables are stores whose rows carry the number of their batch; a batch that is run again changes nothing. Of a ticker's history
    only the bars from the batch's first day on and the ``period`` before are read: those of a quarter of a year, and further ones
    of tickers that have too few there. Days that have no RSI (any more) are written as well, so that a correction can take one back.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        bars = Store(spark, bars_path)
        if bars.applied(TABLE) < batch_id:
            change = bars.change()
            change.append(TABLE, batch.withColumn(BATCH, F.lit(batch_id).cast("bigint")), _DAY)
            change.merge(TABLE, _newest)
            change.commit(TABLE, batch_id)
        rated = Store(spark, rsi_path)
        if rated.applied("rsi") >= batch_id:
            return
        touched, at = staged(batch.groupBy("Ticker").agg(F.min(_DAY).alias("_from")), "touched")
        history, paths = _history(bars, touched, period, batch_id)
        rows = history.join(rsi(history, period).select("Ticker", _DAY, "RSI"), ["Ticker", _DAY], "left")
        days = rows.join(touched, "Ticker").filter(F.col(_DAY) >= F.col("_from")).drop("_from")
        change = rated.change()
        change.append("rsi", days.withColumn(BATCH, F.lit(batch_id).cast("bigint")), _DAY)
        change.merge("rsi", _newest)
        change.commit("rsi", batch_id)
        discard(spark, at, *paths)

    return run


def _history(bars: Store, touched: DataFrame, period: int, batch_id: int) -> tuple[DataFrame, list[str]]:
    """Each touched ticker's bars from its ``_from`` on, and at least ``period`` before or all there are."""
    first = touched.agg(F.min("_from")).first()[0]
    if first is None:
        return bars.read(TABLE).drop(BATCH), []
    near = first - dt.timedelta(days=NEAR_DAYS)

    def own(tickers: DataFrame, low=None, high=None) -> DataFrame:
        # Batches that came later than a repeated one do not count for it.
        return _newest(bars.read(TABLE, low, high).filter(F.col(BATCH) <= batch_id).join(tickers.select("Ticker"), "Ticker", "left_semi"))

    recent, at = staged(own(touched, near), "history")
    if not bars.reaches(TABLE, near - dt.timedelta(days=1)):
        return recent.drop(BATCH), [at]
    before = recent.join(touched, "Ticker").filter(F.col(_DAY) < F.col("_from")).groupBy("Ticker").count()
    short = touched.join(before, "Ticker", "left").filter(F.coalesce("count", F.lit(0)) < period)
    return recent.unionByName(own(short, None, near - dt.timedelta(days=1))).drop(BATCH), [at]


def stream_rsi(stream: DataFrame, period: int = 14) -> DataFrame:
    """RSI of each bar as it arrives. Per ticker the last ``period`` + 1 closes are kept.

    Bars should come in day order per ticker. One that is not newer than the last is given out with ``late`` set and
    without RSI, for :func:`rsi_after_batch` to work its ticker out anew. So is another close for the newest day; a repeat
    of the same one is dropped. :func:`tickerloom.streaming.revisions.revised_rsi` takes bars in any order.
    """

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, closes = (state.get if state.exists else (None, []))
        closes = list(closes)
        # One close a day, however often a bar is repeated; the greatest of differing ones.
        pending: dict = {}
        for frame in frames:
            for day, close in frame.groupby("Date")["Close"].max().items():
                known = pending.get(day)
                pending[day] = close if known is None or pd.isna(known) or close > known else known
        out = []
        for day, close in sorted(pending.items()):
            if seen is not None and str(day) <= seen:
                last = closes[-1] if closes else None
                same = (last is None and pd.isna(close)) or (last is not None and close == last)
                if str(day) < seen or not same:
                    out.append((key[0], day, close, None, True))
                continue
            seen = str(day)
            # The first bar's missing difference counts as no movement; so do missing closes.
            closes = (closes + [None if pd.isna(close) else float(close)])[-(period + 1):]
            out.append((key[0], day, close, rsi_of(closes, period), False))
        state.update((seen, closes))
        told = [row for row in out if row[3] is not None or row[4]]
        if told:
            yield pd.DataFrame(told, columns=["Ticker", "Date", "Close", "RSI", "late"])

    return stream.select("Ticker", "Date", "Close").groupBy("Ticker").applyInPandasWithState(
        step,
        RATED,
        "seen string, closes array<double>",
        "append",
        GroupStateTimeout.NoTimeout,
    )


def rsi_of(closes: list, period: int) -> float | None:
    if len(closes) < period:
        return None
    moves = [0.0 if a is None or b is None else b - a for a, b in zip(closes, closes[1:])]
    if len(closes) == period:
        moves = [0.0] + moves
    gain = sum(m for m in moves if m > 0) / period
    loss = -sum(m for m in moves if m < 0) / period
    if loss > 0:
        return 100 - 100 / (1 + gain / loss)
    return 100.0 if gain > 0 else None
