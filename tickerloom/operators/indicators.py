"""Price indicators per ticker.

Bars are unique per (ticker, day) once :func:`unique_bars` ran, so a ticker's window holds at most one row per
calendar day and the plain window forms below are bounded. Series ordered by anything but a date have no such bound:
:func:`rsi` and :func:`pct_change` take them by ranges of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F, types as T

from tickerloom.functions.numbers import nan_to_null
from tickerloom.operators.ordered import CHUNK, range_chunks, with_previous_rows


def unique_bars(df: DataFrame, key: str = "Ticker", order: str = "Date", prefer: list[str] | None = None) -> DataFrame:
    """One row per (ticker, day): the greatest by ``prefer`` (default: all other columns)."""
    rest = [c for c in df.columns if c not in (key, order)]
    ranked = list(prefer or []) + [c for c in rest if c not in (prefer or [])]
    best = df.groupBy(key, order).agg(F.max(F.struct(*ranked)).alias("_best"))
    return best.select(*[F.col(c) if c in (key, order) else F.col(f"_best.{c}").alias(c) for c in df.columns])


def delta(value: Column, w: WindowSpec) -> Column:
    return value - F.lag(value).over(w)


def rolling_mean(value: Column, n: int, w: WindowSpec) -> Column:
    """Mean of the last n rows; NULL until n non-null values are there."""
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(value).over(frame) >= n, F.avg(value).over(frame))


def rsi_value(gain: Column, loss: Column) -> Column:
    """100 - 100 / (1 + gain/loss); only gains give 100, no movement gives NULL."""
    return F.when(loss > 0, 100 - 100 / (1 + F.try_divide(gain, loss))).when(gain > 0, F.lit(100.0))


def _with_rsi(df: DataFrame, w: WindowSpec, period: int, value: str) -> DataFrame:
    close = nan_to_null(F.col(value))
    moved = df.withColumn("_delta", delta(close, w)).withColumns(
        {
            # A missing difference (first row, missing close) counts as no movement.
            "_gain": F.when(F.col("_delta") > 0, F.col("_delta")).otherwise(0.0),
            "_loss": F.when(F.col("_delta") < 0, -F.col("_delta")).otherwise(0.0),
        }
    )
    gain, loss = (rolling_mean(F.col(c), period, w) for c in ("_gain", "_loss"))
    means = moved.withColumns({"_gain": gain, "_loss": loss})
    return means.withColumn("RSI", rsi_value(F.col("_gain"), F.col("_loss"))).drop("_delta", "_gain", "_loss")


def _daily(df: DataFrame, order: str) -> bool:
    return isinstance(df.schema[order].dataType, T.DateType)


def rsi(df: DataFrame, period: int = 14, key: str = "Ticker", order: str = "Date", value: str = "Close") -> DataFrame:
    """Relative strength index over simple moving averages; rows without a value are dropped."""
    if not _daily(df, order):
        return rsi_by_ranges(df, period, key, (order,), value)
    w = Window.partitionBy(key).orderBy(order)
    return _with_rsi(df, w, period, value).filter(F.col("RSI").isNotNull())


def rsi_by_ranges(
    df: DataFrame, period: int = 14, key: str = "Ticker", order: tuple[str, ...] = ("ts",), value: str = "Close",
    parts: int | None = None,
) -> DataFrame:
    """The same index for series of any length: ranges of rows, each with the ``period`` rows before it."""
    chunks = range_chunks(df, [key], list(order), parts)
    haloed = with_previous_rows(chunks, [key], list(order), period)
    w = Window.partitionBy(key, CHUNK).orderBy(*order)
    rated = _with_rsi(haloed, w, period, value)
    return rated.filter(~F.col("_halo") & F.col("RSI").isNotNull()).drop("_halo", CHUNK)


def pct_change(df: DataFrame, key: str = "Ticker", order: str = "Date", value: str = "Close",
               name: str = "percentage_change") -> DataFrame:
    """Change to the row before, as a fraction; a missing value counts as the last known one.

    The first row of a key, and rows without a change, are dropped.
    """
    if not _daily(df, order):
        return pct_change_by_ranges(df, key, (order,), value, name)
    w = Window.partitionBy(key).orderBy(order)
    known = F.last(nan_to_null(F.col(value)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    filled = df.withColumn("_known", known)
    change = F.try_divide(F.col("_known"), F.lag("_known").over(w)) - 1
    return filled.withColumn(name, change).filter(F.col(name).isNotNull()).drop("_known")


def pct_change_by_ranges(
    df: DataFrame, key: str = "Ticker", order: tuple[str, ...] = ("ts",), value: str = "Close",
    name: str = "percentage_change", parts: int | None = None,
) -> DataFrame:
    """The same change for series of any length: ranges of rows, each told the last known value before it."""
    chunks = range_chunks(df, [key], list(order), parts).withColumn("_value", nan_to_null(F.col(value)))
    newest = F.max_by("_value", F.when(F.col("_value").isNotNull(), F.struct(*order)))
    ends = chunks.groupBy(key, CHUNK).agg(newest.alias("_end"))
    # One row for each range of a key.
    earlier = Window.partitionBy(key).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(key, CHUNK, F.last("_end", ignorenulls=True).over(earlier).alias("_carried"))
    w = Window.partitionBy(key, CHUNK).orderBy(*order)
    known = F.last("_value", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    filled = chunks.join(carried, [key, CHUNK]).withColumn("_known", F.coalesce(known, "_carried"))
    change = F.try_divide(F.col("_known"), F.coalesce(F.lag("_known").over(w), "_carried")) - 1
    return filled.withColumn(name, change).filter(F.col(name).isNotNull()).drop("_known", "_carried", "_value", CHUNK)
