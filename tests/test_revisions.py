import datetime as dt
import json
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickerloom import schemas
from tickerloom.operators.indicators import rsi, unique_bars
from tickerloom.sources import messages
from tickerloom.streaming import bars as B, revisions as R

D0 = dt.date(2025, 1, 1)


class Held:
    """State as a dictionary, for tests without a stream."""

    def __init__(self):
        self.values, self.one, self.reads = {}, None, 0

    def containsKey(self, key):
        return key in self.values

    def getValue(self, key):
        self.reads += 1
        return self.values[key]

    def updateValue(self, key, value):
        self.values[key] = value

    def exists(self):
        return self.one is not None

    def get(self):
        return self.one

    def update(self, value):
        self.one = value


def processor(slide=None):
    out = R._Revised(14, slide)
    out.months, out.index = Held(), Held()
    return out


def frame(rows):
    return pd.DataFrame(rows, columns=["Date", *R.FIELDS])


def random_bars(seed, days=160):
    rng = random.Random(seed)
    rows = []
    for i in range(days):
        if rng.random() < 0.8:
            close = None if rng.random() < 0.04 else round(rng.uniform(1, 9), 2)
            rows.append((D0 + dt.timedelta(days=i * (1 if seed % 2 else 3)), 1.0, rng.uniform(5, 9), rng.uniform(1, 4), close, 1.0))
    for _ in range(days // 6):  # repeats and other closes of a day
        d, *rest = rng.choice(rows)
        rows.append((d, *rest) if rng.random() < 0.4 else (d, 1.0, rng.uniform(5, 9), rng.uniform(1, 4), round(rng.uniform(1, 9), 2), 2.0))
    rng.shuffle(rows)
    return rows


def split(rows, seed):
    rng, at = random.Random(seed), 0
    while at < len(rows):
        n = rng.choice([1, 2, 7, 40])
        yield rows[at : at + n]
        at += n


def batch_bars(rows):
    """The greatest bar of each day, in order."""
    best = {}
    for row in rows:
        if row[0] not in best or R._order(list(row[1:])) > R._order(list(best[row[0]][1:])):
            best[row[0]] = row
    return [best[d] for d in sorted(best)]


def batch_rsi(bars):
    closes = [b[4] for b in bars]
    out = {}
    for i in range(13, len(closes)):
        moves = [0.0 if j == 0 or closes[j] is None or closes[j - 1] is None else closes[j] - closes[j - 1] for j in range(i - 13, i + 1)]
        gain, loss = sum(m for m in moves if m > 0), -sum(m for m in moves if m < 0)
        if loss > 0:
            out[bars[i][0]] = 100 - 100 / (1 + gain / loss)
        elif gain > 0:
            out[bars[i][0]] = 100.0
    return out


@pytest.mark.parametrize("seed", range(8))
def test_any_order_and_any_split_gives_the_batch_rsi(seed):
    rows, own, told = random_bars(seed), processor(), {}
    for part in split(rows, seed):
        for out in own.handleInputRows(("A",), iter([frame(part)]), None):
            for r in out.itertuples():
                told[r.Date] = r.Close, r.RSI
    bars = batch_bars(rows)
    want = batch_rsi(bars)
    got = {d: v for d, (_, v) in told.items() if v is not None}
    assert got.keys() == want.keys() and all(abs(got[d] - want[d]) < 1e-9 for d in want)
    closes = {b[0]: b[4] for b in bars}
    assert all(told[d][0] == closes[d] for d in want)


@pytest.mark.parametrize("slide", [1, 7])
@pytest.mark.parametrize("seed", range(4))
def test_any_order_and_any_split_gives_the_batch_weeks(seed, slide):
    rows, own, told = random_bars(seed), processor(slide), {}
    for part in split(rows, seed + 50):
        for out in own.handleInputRows(("A",), iter([frame(part)]), None):
            for r in out.itertuples():
                told[r.week_start.date()] = r.high, r.low, r.bars, r.overbought, r.oversold
    bars = batch_bars(rows)
    rated, want = batch_rsi(bars), {}
    for d, _, high, low, _, _ in bars:
        n = (d - dt.date(1970, 1, 1)).days
        for s in range(n - n % slide, n - 7, -slide):
            h, lo, k, over, under = want.get(s, (0.0, 99.0, 0, 0, 0))
            want[s] = max(h, high), min(lo, low), k + 1, over + (rated.get(d, 50) > 70), under + (rated.get(d, 50) < 30)
    assert told == {dt.date(1970, 1, 1) + dt.timedelta(days=s): v for s, v in want.items()}


def test_a_batch_reads_few_months_of_a_long_history():
    own = processor()
    rows = [(D0 + dt.timedelta(days=i), 1.0, 2.0, 1.0, float(i % 7), 1.0) for i in range(3000)]
    list(own.handleInputRows(("A",), iter([frame(rows)]), None))
    own.months.reads = 0
    list(own.handleInputRows(("A",), iter([frame([(D0 + dt.timedelta(days=1500), 1.0, 2.0, 1.0, 99.0, 1.0)])]), None))
    assert own.months.reads <= 4
    assert len(json.loads(own.index.one[0])) > 90


def test_windows_from_blocks():
    rng = np.random.default_rng(1)
    for n in (7, 8, 13, 14, 15, 40):
        x = rng.random(n)
        assert np.allclose(R._sliding(x, np.maximum), [x[i : i + 7].max() for i in range(n - 6)])
        assert np.allclose(R._sliding(x, np.minimum), [x[i : i + 7].min() for i in range(n - 6)])


def streamed(spark, tmp_path, parts, make, schema):
    for part in parts:
        messages.publish_to_files(part, str(tmp_path / "in"))
        stream = messages.parse_bars(messages.consume_files(spark, str(tmp_path / "in"))).bars
        B.drain(make(stream), str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    return spark.read.schema(schema).parquet(str(tmp_path / "out"))


def table(spark, seed=3):
    rows = [(d, t, o, h, lo, c, int(v)) for k, t in enumerate("AB") for d, o, h, lo, c, v in random_bars(seed + k, 50)]
    return spark.createDataFrame(rows, schemas.BARS)


def test_streams_equal_the_batch_forms(spark, tmp_path):
    bars = table(spark)
    parts = [bars.filter(F.pmod(F.xxhash64("Date", "Close", "High"), F.lit(3)) == i) for i in range(3)]
    got = R.newest(streamed(spark, tmp_path / "rsi", parts, R.revised_rsi, R.RATED), "Ticker", "Date").filter("RSI IS NOT NULL")
    best = unique_bars(bars)
    want = {(r.Ticker, r.Date): (r.Close, round(r.RSI, 9)) for r in rsi(best).collect()}
    assert {(r.Ticker, r.Date): (r.Close, round(r.RSI, 9)) for r in got.collect()} == want and want
    rolling = R.newest(streamed(spark, tmp_path / "weeks", parts, lambda s: R.revised_weeks(s, 1), R.WEEKS), "Ticker", "week_start")
    rated = best.join(rsi(best).select("Ticker", "Date", "RSI"), ["Ticker", "Date"], "left")
    assert sorted(map(tuple, rolling.collect())) == sorted(map(tuple, B.weekly_range(rated, "1 day").collect()))


def test_another_close_of_the_newest_day_is_given_out_as_late(spark, tmp_path):
    day = dt.date(2025, 1, 20)
    closes = [100.0, 150.0, 150.0, 100.0]
    parts = [spark.createDataFrame([(day, "A", 1.0, 2.0, 0.5, c, 1)], schemas.BARS) for c in closes]
    got = streamed(spark, tmp_path, parts, B.stream_rsi, B.RATED).collect()
    assert [(r.Date, r.Close, r.RSI, r.late) for r in got] == [(day, 150.0, None, True)] * 2


class HeldForMany(Held):
    def getValue(self, key):
        return self.values.get(key)


def test_a_group_of_tickers_is_revised_at_once(monkeypatch):
    monkeypatch.setattr(R, "ROWS_IN", 70)
    given = {t: random_bars(seed, 60) for seed, t in enumerate(["A", None, "", "B"])}
    dealt = sorted(((t, *row) for t, rows in given.items() for row in rows), key=lambda r: (r[1], r[2:4]))
    for slide in (None, 1, 7):
        own = R._Grouped(14, slide)
        own.months, own.index = HeldForMany(), HeldForMany()
        frames = [pd.DataFrame(dealt[i : i + 40], columns=["Ticker", "Date", *R.FIELDS]) for i in range(0, len(dealt), 40)]
        told = list(own.handleInputRows((5,), iter(frames), None))
        assert len(told) <= -(-len(frames) // 2)  # a frame for two of the given ones, not one for each ticker
        got = {(t, r[0 if slide else 1]): tuple(r) for f in told for t, r in zip(f["Ticker"], f.itertuples(index=False))}
        for t, rows in given.items():
            alone = processor(slide)
            at = [[row for tt, *row in dealt[i : i + 80] if tt == t] for i in range(0, len(dealt), 80)]
            out = [f for part in at for f in alone.handleInputRows((t,), iter([frame(part)]), None)]
            want = {r[0 if slide else 1]: tuple(r) for f in out for r in f.itertuples(index=False)}
            assert {k: str(v) for (tt, k), v in got.items() if tt is t or tt == t} == {k: str(v) for k, v in want.items()} and want


def test_a_stream_takes_bars_without_a_ticker(spark, tmp_path):
    bars = table(spark).withColumn("Ticker", F.when(F.col("Ticker") == "A", F.col("Ticker")))
    for i in range(2):
        bars.filter(F.pmod(F.xxhash64("Date", "Close"), F.lit(2)) == i).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(bars.schema).parquet(str(tmp_path / "in"))
        B.drain(R.revised_weeks(stream, 7), str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    got = R.newest(spark.read.schema(R.WEEKS).parquet(str(tmp_path / "out")), "Ticker", "week_start").drop("overbought", "oversold")
    want = B.weekly_range(unique_bars(bars))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.filter("Ticker IS NULL").count()
