import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tickerloom import schemas
from tickerloom.operators.indicators import rsi
from tickerloom.sources import messages
from tickerloom.streaming import bars as B

D0 = dt.date(2025, 1, 1)


def price_bars(spark, days=40):
    rng = random.Random(3)
    rows = [(D0 + dt.timedelta(days=i), t, 1.0, 2.0, 0.5, rng.uniform(1, 9), 1) for t in ("A", "B", "C") for i in range(days) if rng.random() < 0.9]
    return spark.createDataFrame(rows, schemas.BARS)


def close_to(got, want):
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def rated(df):
    return {(r.Ticker, r.Date): r.RSI for r in df.collect()}


@pytest.mark.parametrize("cuts", [[], [5, 20], [1, 13, 14, 15, 39]])
def test_stream_rsi_equals_batch_for_any_split(spark, tmp_path, cuts):
    bars, path = price_bars(spark), str(tmp_path / "in")
    edges = [0, *cuts, 1000]
    for low, high in zip(edges, edges[1:]):
        day = F.date_diff("Date", F.lit(D0))
        messages.publish_to_files(bars.filter((day >= low) & (day < high)), path)
        stream = messages.parse_bars(messages.consume_files(spark, path)).bars
        B.drain(B.stream_rsi(stream), str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    close_to(rated(spark.read.parquet(str(tmp_path / "out"))), rated(rsi(bars)))


def test_rsi_after_batch_takes_late_and_repeated_bars(spark, tmp_path):
    bars, path = price_bars(spark), str(tmp_path / "in")
    step = B.rsi_after_batch(str(tmp_path / "bars"), str(tmp_path / "rsi"))
    day = F.date_diff("Date", F.lit(D0))
    late = (day == 10) & (F.col("Ticker") == "A")
    for part in (~late & (day < 30), late, (day >= 25)):
        messages.publish_to_files(bars.filter(part), path)
        stream = messages.parse_bars(messages.consume_files(spark, path)).bars
        query = stream.writeStream.foreachBatch(step).option("checkpointLocation", str(tmp_path / "log"))
        query.trigger(availableNow=True).start().awaitTermination()
    close_to(rated(B.current_rsi(spark, str(tmp_path / "rsi"))), rated(rsi(bars)))
    # A batch that is run again after a crash leaves the tables as they were.
    step(bars.filter(day >= 25), 2)
    close_to(rated(B.current_rsi(spark, str(tmp_path / "rsi"))), rated(rsi(bars)))


def after_batch(spark, tmp_path, rows, step):
    path = str(tmp_path / "in")
    messages.publish_to_files(rows, path)
    stream = messages.parse_bars(messages.consume_files(spark, path)).bars
    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", str(tmp_path / "log"))
    query.trigger(availableNow=True).start().awaitTermination()


def test_replayed_and_late_bars_are_kept_once(spark, tmp_path):
    bars, out = price_bars(spark), str(tmp_path / "out")
    day = F.date_diff("Date", F.lit(D0))
    for part in (day >= 8, day < 12, day >= 0):
        after_batch(spark, tmp_path, bars.filter(part), B.new_bars(out))
    want = sorted(map(tuple, bars.select("Ticker", "Date", "Close").collect()))
    assert sorted(map(tuple, B.read_bars(spark, out).select("Ticker", "Date", "Close").collect())) == want
    B.new_bars(out)(bars.filter(day < 12), 1)  # run again after a crash
    assert sorted(map(tuple, B.read_bars(spark, out).select("Ticker", "Date", "Close").collect())) == want


def test_many_batches_leave_few_parts_and_read_little(spark, tmp_path):
    """A batch a day; each reads the days near its own, from few parts."""
    from tickerloom.sources.versions import Store

    bars_path, rsi_path, kept_path = (str(tmp_path / n) for n in ("bars", "rsi", "kept"))
    step, keep = B.rsi_after_batch(bars_path, rsi_path), B.new_bars(kept_path)
    rng, rows, read = random.Random(8), [], []
    plain = Store.read

    def noted(self, table, low=None, high=None):
        read.append(sum(p.may_hold(None if low is None else str(low), None if high is None else str(high)) for p in self.parts(table)))
        return plain(self, table, low, high)

    for i in range(10):
        day = [(D0 + dt.timedelta(days=10 * i), t, 1.0, 2.0, 0.5, rng.uniform(1, 9), 1) for t in ("A", "B")]
        rows += day
        batch = spark.createDataFrame(day, schemas.BARS)
        step(batch, i)
        Store.read = noted
        try:
            keep(batch, i)
        finally:
            Store.read = plain
    bars = spark.createDataFrame(rows, schemas.BARS)
    close_to(rated(B.current_rsi(spark, rsi_path)), rated(rsi(bars)))
    assert B.read_bars(spark, kept_path).count() == len(rows)
    for path in (bars_path, rsi_path, kept_path):
        store = Store(spark, path)
        assert len(store.parts(store.tables()[0])) <= 3 * 3 and store.version == 10
    assert max(read) <= 1  # a new day touches no part


def test_tickers_with_few_bars_are_looked_up_further_back(spark, tmp_path):
    """A ticker of monthly bars has less than 14 in a quarter of a year."""
    rows = [(D0 + dt.timedelta(days=30 * i), "A", 1.0, 2.0, 0.5, float(i * 7 % 5), 1) for i in range(40)]
    rows += [(D0 + dt.timedelta(days=i), "B", 1.0, 2.0, 0.5, float(i * 3 % 7), 1) for i in range(1, 1200, 3)]
    rsi_path = str(tmp_path / "rsi")
    step = B.rsi_after_batch(str(tmp_path / "bars"), rsi_path)
    late = lambda r: r[0] in (D0 + dt.timedelta(days=600), D0 + dt.timedelta(days=1141))
    for i, part in enumerate(([r for r in rows[:-30] if not late(r)], rows[-30:], [r for r in rows if late(r)])):
        step(spark.createDataFrame(part, schemas.BARS), i)
    close_to(rated(B.current_rsi(spark, rsi_path)), rated(rsi(spark.createDataFrame(rows, schemas.BARS))))


def test_a_correction_can_take_back_an_rsi(spark, tmp_path):
    def bar(i, close):
        return (D0 + dt.timedelta(days=i), "A", 1.0, 2.0, 0.5, close, 1)

    bars = spark.createDataFrame([bar(i, 5.0) for i in range(14)] + [bar(14, 6.0)], schemas.BARS)
    right = spark.createDataFrame([bar(14, 5.0)], schemas.BARS)
    rsi_path = str(tmp_path / "rsi")
    step = B.rsi_after_batch(str(tmp_path / "bars"), rsi_path)
    after_batch(spark, tmp_path, bars, step)
    assert rated(B.current_rsi(spark, rsi_path)) == {("A", D0 + dt.timedelta(days=14)): 100.0}
    after_batch(spark, tmp_path, right, step)
    assert rated(B.current_rsi(spark, rsi_path)) == {}


def test_late_bars_come_out_marked(spark, tmp_path):
    bars = price_bars(spark).filter("Ticker = 'A'")
    day = F.date_diff("Date", F.lit(D0))
    for part in (day != 7, day == 7):
        messages.publish_to_files(bars.filter(part), str(tmp_path / "in"))
        stream = messages.parse_bars(messages.consume_files(spark, str(tmp_path / "in"))).bars
        B.drain(B.stream_rsi(stream), str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    late = spark.read.parquet(str(tmp_path / "out")).filter("late").collect()
    assert [(r.Ticker, r.Date, r.RSI) for r in late] == [("A", D0 + dt.timedelta(days=7), None)]


def test_weeks_close_and_roll(spark):
    bars = price_bars(spark).withColumn("RSI", F.lit(75.0))
    weekly = B.weekly_range(bars).collect()
    assert sum(r.bars for r in weekly) == bars.count() == sum(r.overbought for r in weekly)
    rolling = B.weekly_range(bars, "1 day")
    assert rolling.agg(F.sum("bars")).first()[0] == 7 * bars.count()
    assert "overbought" not in B.weekly_range(price_bars(spark)).columns
