"""Bars in any order, late and corrected ones too, as streams of revised results.

State is kept by ticker and month: a batch reads the months of its own days and their neighbours, however long a ticker's history is.
Tickers are dealt to groups, so that what a call costs (rows and results that cross to Python and back) is shared by a group's tickers.
Every change gives out what it changes, as rows with a rising ``revision``: an RSI that is new, corrected or (NULL) taken back, a
week's range. Of each (ticker, day) or (ticker, week) the row of the greatest revision counts (:func:`newest`), and those rows are
what the batch forms give for all bars so far, whatever their order and split into batches. Of differing bars of a day the greatest
(by Open, High, Low, Close, Volume) counts, as in :func:`tickerloom.operators.indicators.unique_bars`.
"""

from __future__ import annotations

import datetime as dt
import json
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tickerloom.functions.numbers import OVERBOUGHT, OVERSOLD
from tickerloom.streaming.bars import rsi_of

RATED = "Ticker string, Date date, Close double, RSI double, revision bigint"
WEEKS = "week_start timestamp, Ticker string, high double, low double, bars bigint, overbought bigint, oversold bigint, revision bigint"
STATE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FIELDS = ("Open", "High", "Low", "Close", "Volume")
_DAY_ZERO, _WEEK = dt.date(1970, 1, 1), 7
_HIGH, _LOW, _CLOSE, _RSI = 1, 2, 3, 5  # places in a day's values
#: Groups of tickers; rows of a group that are taken up at once, and results that are given out at once.
GROUPS, ROWS_IN, ROWS_OUT = 1024, 100_000, 50_000


class History:
    """A ticker's days, month by month as they are needed. A day holds its bar's fields and its RSI."""

    def __init__(self, months, index):
        self._months, self._index, self._loaded, self._touched = months, index, {}, set()
        known = index.get()
        self.months, self.revision = (json.loads(known[0]), int(known[1])) if known else ([], 0)
        self._kept = set(self.months)

    @staticmethod
    @lru_cache(4096)
    def month_of(day: int) -> int:
        date = _DAY_ZERO + dt.timedelta(days=day)
        return date.year * 12 + date.month

    def days(self, month: int) -> dict[int, list]:
        if month not in self._loaded:
            held = self._months.getValue((month,)) if month in self._kept else None
            self._loaded[month] = {day: values for day, *values in json.loads(held[0])} if held else {}
        return self._loaded[month]

    def get(self, day: int) -> list | None:
        return self.days(self.month_of(day)).get(day)

    def put(self, day: int, values: list) -> None:
        month = self.month_of(day)
        self.days(month)[day] = values
        self._touched.add(month)
        at = bisect_left(self.months, month)
        if at == len(self.months) or self.months[at] != month:
            self.months.insert(at, month)

    def between(self, low: int, high: int) -> list[int]:
        """The days from low to high, in order."""
        own = self.months[bisect_left(self.months, self.month_of(low)) : bisect_right(self.months, self.month_of(high))]
        return [day for month in own for day in sorted(self.days(month)) if low <= day <= high]

    def before(self, day: int, n: int) -> list[int]:
        out: list[int] = []
        for month in reversed(self.months[: bisect_right(self.months, self.month_of(day))]):
            out = [d for d in sorted(self.days(month)) if d < day] + out
            if len(out) >= n:
                break
        return out[max(0, len(out) - n) :]

    def after(self, day: int, n: int) -> list[int]:
        out: list[int] = []
        for month in self.months[bisect_left(self.months, self.month_of(day)) :]:
            out += [d for d in sorted(self.days(month)) if d > day]
            if len(out) >= n:
                break
        return out[:n]

    def save(self) -> None:
        for month in self._touched:
            self._months.updateValue((month,), (json.dumps([[day, *values] for day, values in sorted(self.days(month).items())]),))
        self._index.update((json.dumps(self.months), self.revision))


class _Own:
    """What maps over many tickers hold for one: as a map by the rest of the key, or as a value."""

    def __init__(self, held, ticker: str | None):
        self._held, self._key = held, (ticker or "", ticker is not None)  # a key holds no null

    def getValue(self, key: tuple) -> tuple | None:
        return self._held.getValue((*self._key, *key))

    def updateValue(self, key: tuple, value: tuple) -> None:
        self._held.updateValue((*self._key, *key), value)

    def get(self) -> tuple | None:
        return self.getValue(())

    def update(self, value: tuple) -> None:
        self.updateValue((), value)


def _plain(value):
    return None if value is None or value != value else float(value)


def _order(values: list) -> tuple:
    """Missing values count as the least."""
    return tuple((v is not None, v or 0.0) for v in values[: len(FIELDS)])


def take(history: History, rows: Iterator[pd.DataFrame | dict]) -> set[int]:
    """Adds bars; the days that are new or have another bar now."""
    changed = set()
    for frame in rows:
        for date, *fields in zip(frame["Date"], *[frame[f] for f in FIELDS], strict=True):
            date = date if type(date) is dt.date else pd.Timestamp(date).date()
            day, values = (date - _DAY_ZERO).days, [_plain(v) for v in fields]
            known = history.get(day)
            if known is None or _order(values) > _order(known):
                history.put(day, [*values, known[_RSI] if known else None])
                changed.add(day)
    return changed


def rate(history: History, changed: set[int], period: int) -> dict[int, float | None]:
    """Works out the RSI that changed days reach: theirs and that of ``period`` bars after. The days that have another one now."""
    out, todo = {}, sorted(changed)
    while todo:
        first = last = todo[0]
        reach = history.after(last, period)
        while len(todo) > 1 and reach and todo[1] <= reach[-1]:
            last = todo.pop(1)
            reach = history.after(last, period)
        todo.pop(0)
        days = history.before(first, period) + history.between(first, last) + reach
        closes = [history.get(day)[_CLOSE] for day in days]
        for at in range(bisect_left(days, first), len(days)):
            rated, values = rsi_of(closes[max(0, at - period) : at + 1], period), history.get(days[at])
            if rated != values[_RSI]:
                out[days[at]] = values[_RSI]
                history.put(days[at], [*values[:_RSI], rated])
    return out


def week_starts(days: set[int], slide: int) -> list[tuple[int, int]]:
    """Runs (first, last) of the starts of seven-day windows, ``slide`` days apart, that hold one of the days."""
    starts = sorted({s for day in days for s in range(day - day % slide, day - _WEEK, -slide)})
    runs: list[list[int]] = []
    for s in starts:
        if runs and s - runs[-1][1] <= slide:
            runs[-1][1] = s
        else:
            runs.append([s, s])
    return [(a, b) for a, b in runs]


def _sliding(values: np.ndarray, fold) -> np.ndarray:
    """fold over each seven values in a row: over the end of one block of seven and the beginning of the next, two looks a window."""
    n = len(values) - _WEEK + 1
    none = -np.inf if fold is np.maximum else np.inf
    blocks = np.concatenate([values, np.full(-len(values) % _WEEK, none)]).reshape(-1, _WEEK)
    ahead = fold.accumulate(blocks, axis=1).ravel()
    behind = fold.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return fold(behind[:n], ahead[_WEEK - 1 : _WEEK - 1 + n])


def weeks(history: History, days: set[int], slide: int) -> list[tuple]:
    """(start, high, low, bars, overbought, oversold) of the windows that hold one of the days, from daily panes."""
    out = []
    for first, last in week_starts(days, slide):
        width = last + _WEEK - first
        high, low = np.full(width, -np.inf), np.full(width, np.inf)
        counts = np.zeros((3, width + 1), dtype=np.int64)
        for day in history.between(first, last + _WEEK - 1):
            values, at = history.get(day), day - first
            high[at] = -np.inf if values[_HIGH] is None else values[_HIGH]
            low[at] = np.inf if values[_LOW] is None else values[_LOW]
            rated = values[_RSI]
            counts[:, at + 1] = 1, rated is not None and rated > OVERBOUGHT, rated is not None and rated < OVERSOLD
        sums = np.cumsum(counts, axis=1)
        highs, lows = _sliding(high, np.maximum), _sliding(low, np.minimum)
        for at in range(0, last - first + 1, slide):
            bars, over, under = (int(s[at + _WEEK] - s[at]) for s in sums)
            if bars:
                out.append((first + at, *[float(x[at]) if np.isfinite(x[at]) else None for x in (highs, lows)], bars, over, under))
    return out


class _Revised(StatefulProcessor):
    """One ticker a call."""

    def __init__(self, period: int, slide: int | None):
        self.period, self.slide = period, slide

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.months = handle.getMapState("months", "month int", "days string")
        self.index = handle.getValueState("index", "months string, revision bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out = self._revised(key[0], History(self.months, self.index), rows)
        if out is not None:
            yield self._frame(out)

    def _revised(self, ticker: str | None, history: History, rows: Iterator) -> list[tuple] | None:
        """What the rows change; None if nothing."""
        changed = take(history, rows)
        if not changed:
            return None
        rated = rate(history, changed, self.period)
        history.revision += 1
        history.save()
        return self._rows(ticker, history, changed, rated) if self.slide is None else self._weeks(ticker, history, changed | set(rated))

    def _rows(self, ticker: str | None, history: History, changed: set[int], rated: dict[int, float | None]) -> list[tuple]:
        out = []
        for day in sorted(changed | set(rated)):
            values = history.get(day)
            # A bar that has no RSI and had none says nothing.
            if values[_RSI] is not None or rated.get(day) is not None:
                out.append((ticker, _DAY_ZERO + dt.timedelta(days=day), values[_CLOSE], values[_RSI], history.revision))
        return out

    def _weeks(self, ticker: str | None, history: History, days: set[int]) -> list[tuple]:
        return [(s, ticker, *rest, history.revision) for s, *rest in weeks(history, days, self.slide)]

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        if self.slide is None:
            return pd.DataFrame(rows, columns=["Ticker", "Date", "Close", "RSI", "revision"], dtype=object)
        frame = pd.DataFrame(rows, columns=["week_start", "Ticker", "high", "low", "bars", "overbought", "oversold", "revision"])
        starts = frame["week_start"].to_numpy("int64").astype("datetime64[D]").astype("datetime64[ns]")
        return frame.assign(week_start=starts).astype({"high": "float64", "low": "float64"})

    def close(self) -> None:
        pass


class _Grouped(_Revised):
    """A group of tickers a call: a ticker's rows are taken up together as far as they come within ``ROWS_IN`` rows."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.months = handle.getMapState("months", "ticker string, named boolean, month int", "days string")
        self.index = handle.getMapState("index", "ticker string, named boolean", "months string, revision bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for frame in rows:
            held.append(frame)
            size += len(frame)
            if size >= ROWS_IN:
                yield from self._given(pd.concat(held))
                held, size = [], 0
        if held:
            yield from self._given(pd.concat(held))

    def _given(self, frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        of, tickers = pd.factorize(frame["Ticker"], use_na_sentinel=False)
        order = np.argsort(of, kind="stable")
        columns = {c: frame[c].to_numpy()[order].tolist() for c in ("Date", *FIELDS)}
        ends, out = np.cumsum(np.bincount(of, minlength=len(tickers))).tolist(), []
        for ticker, first, last in zip(tickers, [0, *ends], ends):
            ticker = None if pd.isna(ticker) else ticker
            history = History(_Own(self.months, ticker), _Own(self.index, ticker))
            out += self._revised(ticker, history, iter([{c: v[first:last] for c, v in columns.items()}])) or []
            if len(out) >= ROWS_OUT:
                yield self._frame(out)
                out = []
        if out:
            yield self._frame(out)


def _revised(stream: DataFrame, schema: str, period: int, slide: int | None) -> DataFrame:
    # State by (ticker, month) needs the store that keeps maps.
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE)
    rows = stream.select("Ticker", "Date", *[F.col(f).cast("double").alias(f) for f in FIELDS])
    grouped = rows.withColumn("bucket", F.pmod(F.xxhash64("Ticker"), F.lit(GROUPS))).groupBy("bucket")
    return grouped.transformWithStateInPandas(_Grouped(period, slide), schema, "Append", "None")


def revised_rsi(stream: DataFrame, period: int = 14) -> DataFrame:
    """RSI of bars in any order: new, corrected and (NULL) taken back ones, with a revision."""
    return _revised(stream, RATED, period, None)


def revised_weeks(stream: DataFrame, slide_days: int = 7, period: int = 14) -> DataFrame:
    """Range of each seven-day window (following each other, or rolling with ``slide_days`` 1), and its overbought and oversold days."""
    if _WEEK % slide_days:
        raise ValueError("slide_days is 1 or 7")
    return _revised(stream, WEEKS, period, slide_days)


def newest(revisions: DataFrame, *key: str) -> DataFrame:
    """Of each key the row of the greatest revision, without that column."""
    rest = [c for c in revisions.columns if c not in (*key, "revision")]
    best = revisions.groupBy(*key).agg(F.max_by(F.struct(*rest), "revision").alias("best"))
    return best.select(*[F.col(c) if c in key else F.col(f"best.{c}").alias(c) for c in revisions.columns if c != "revision"])
