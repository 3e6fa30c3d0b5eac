import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tickerloom import schemas
from tickerloom.operators import aggregates as A, indicators as I
from tickerloom.operators.filters import trailing_days
from tickerloom.operators.ordered import range_chunks, rank_in_key, running_totals
from tickerloom.operators.reshape import wide_to_long
from tickerloom.plans.prices import daily_change, latest_prices, rsi_series

D0 = dt.date(2025, 1, 1)


def loop_rsi(closes, period=14):
    """RSI of one series as a loop; None where there is none."""
    moves = [0.0] + [0.0 if a is None or b is None else b - a for a, b in zip(closes, closes[1:])]
    out = []
    for i in range(len(closes)):
        last = moves[i - period + 1:i + 1] if i >= period - 1 else None
        gain = sum(m for m in last if m > 0) / period if last else 0
        loss = -sum(m for m in last if m < 0) / period if last else 0
        out.append(None if not last else 100 - 100 / (1 + gain / loss) if loss else 100.0 if gain else None)
    return out


def bars(spark, series):
    """series: ticker -> closes, one a day; rows arrive shuffled."""
    rows = [
        (D0 + dt.timedelta(days=i), t, c, c, c, c, 1) for t, closes in series.items() for i, c in enumerate(closes)
    ]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, schemas.BARS)


def rated(df):
    return {(r.Ticker, r.Date): r.RSI for r in df.collect()}


def expected(series, period=14):
    return {
        (t, D0 + dt.timedelta(days=i)): x
        for t, closes in series.items()
        for i, x in enumerate(loop_rsi(closes, period))
        if x is not None
    }


def test_rsi_edge_cases(spark):
    rng = random.Random(2)
    walk = [round(100 + rng.uniform(-5, 5), 2) for _ in range(40)]
    series = {
        "N13": walk[:13], "N14": walk[:14], "N15": walk[:15], "UP": [float(i) for i in range(20)],
        "DOWN": [float(-i) for i in range(20)], "FLAT": [5.0] * 20, "GAP": walk[:8] + [None] + walk[9:30],
        "NAN": walk[:8] + [math.nan] + walk[9:30], "LONG": walk,
    }
    got = rated(I.rsi(bars(spark, series)))
    want = expected({t: [None if c is None or math.isnan(c) else c for c in s] for t, s in series.items()})
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert not any(t in ("N13", "FLAT") for t, _ in got)
    assert {v for (t, _), v in got.items() if t == "UP"} == {100.0}
    assert {v for (t, _), v in got.items() if t == "DOWN"} == {0.0}
    assert all(0 <= v <= 100 for v in got.values())


def test_rsi_drops_repeated_bars(spark):
    once = bars(spark, {"A": [float((i * 7) % 11) for i in range(30)]})
    assert rated(rsi_series(once.unionByName(once))) == rated(rsi_series(once))


def test_rsi_golden_series(spark):
    # Closes of two coins and the RSI of their last two days.
    golden = {
        "ADA-USD": ([0.8257520198822021, 0.8076189756393433, 0.81318598985672, 0.7627890110015869, 0.7921929955482483,
                     0.7817010283470154, 0.8081660270690918, 0.8067970275878906, 0.8072029948234558, 0.8500400185585022,
                     0.8703200221061707, 0.8663150072097778, 0.8399220108985901, 0.8373519778251648, 0.8718159794807434,
                     0.8134839534759521], [58.44336409977619, 50.93695426541864]),
        "BTC-USD": ([112748.5078125, 112014.5, 113328.6328125, 109049.2890625, 109712.828125, 109681.9453125, 112122.640625,
                     114400.3828125, 114056.0859375, 118648.9296875, 120681.2578125, 122266.53125, 122425.4296875,
                     123513.4765625, 124752.53125, 121335.7109375], [76.34646888746455, 68.30279633022118]),
    }
    got = rated(I.rsi(bars(spark, {t: c for t, (c, _) in golden.items()})))
    for t, (closes, want) in golden.items():
        for i, x in zip((14, 15), want):
            assert abs(got[(t, D0 + dt.timedelta(days=i))] - x) < 1e-9


def test_rsi_summary_golden(spark):
    # One coin's RSI column and its summary.
    btc = [54.99215148058749, 51.87103493186517, 47.34934018491608, 27.80555698747358, 28.148781530568627, 28.382124089888222,
           39.982513317514325, 47.19778900008258, 42.07440372911735, 55.000720291212666, 57.649684679990415, 64.11418187426449,
           64.30687575198952, 67.02803565020321, 76.34646888746455, 68.30279633022118]
    rows = [("BTC-USD", x) for x in btc] + [("EDGE", 70.0), ("EDGE", 30.0), ("NONE", None)]
    got = {r.Ticker: tuple(r)[1:] for r in A.rsi_summary(spark.createDataFrame(rows, "Ticker string, RSI double")).collect()}
    assert got["BTC-USD"] == (16, 1, 3, 6.25, 18.75)
    assert got["EDGE"] == (2, 0, 0, 0.0, 0.0)
    assert got["NONE"] == (0, 0, 0, None, None)


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_rsi_by_ranges_equals_one_window(spark, parts):
    """A ticker with nine tenths of all rows, cut into ranges shorter than the look-back."""
    rng = random.Random(parts)
    rows = [("HOT", i, rng.uniform(1, 9)) for i in range(300)] + [("T%d" % (i % 3), i, rng.uniform(1, 9)) for i in range(60)]
    ticks = spark.createDataFrame(rows, "Ticker string, n int, Close double").withColumn("ts", F.timestamp_seconds("n"))
    whole = {(r.Ticker, r.n): r.RSI for r in I.rsi(ticks, order="ts").collect()}
    cut = {(r.Ticker, r.n): r.RSI for r in I.rsi_by_ranges(ticks, order=("ts", "n"), parts=parts).collect()}
    assert cut.keys() == whole.keys()
    assert all(abs(cut[k] - whole[k]) < 1e-9 for k in whole)


@pytest.mark.parametrize("parts", [1, 9])
def test_running_totals_and_ranks(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.choice("aaaab"), i, rng.randrange(9)) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, n int, v int")
    chunks = range_chunks(df, ["k"], ["n"], parts)
    got = {(r.k, r.n): (r.inc, r.rank) for r in running_totals(chunks, ["k"], ["n"], {"inc": F.col("v"), "rank": F.lit(1)}).collect()}
    excl = {(r.k, r.n): r.e for r in running_totals(chunks, ["k"], ["n"], {"e": F.col("v")}, inclusive=False).collect()}
    total, count = {"a": 0, "b": 0}, {"a": 0, "b": 0}
    for k, n, v in rows:
        assert excl[(k, n)] == total[k]
        total[k], count[k] = total[k] + v, count[k] + 1
        assert got[(k, n)] == (total[k], count[k])
    ranks = {(r.k, r.n): r.rank_in_key for r in rank_in_key(df, ["k"], ["n"]).collect()}
    assert ranks == {key: rank for key, (_, rank) in got.items()}


def test_pct_change(spark):
    got = {(r.Ticker, (r.Date - D0).days): r.percentage_change for r in I.pct_change(bars(spark, {
        "ONE": [5.0], "GAP": [1.0, None, 2.0], "ZERO": [0.0, 1.0, 3.0],
        # Two closes and their change.
        "BTC-USD": [115169.765625, 114277.671875],
    })).collect()}
    assert got.pop(("BTC-USD", 1)) == pytest.approx(-0.007745902278769146, abs=1e-12)
    assert got == {("GAP", 1): 0.0, ("GAP", 2): 1.0, ("ZERO", 2): 2.0}


def test_wide_to_long_and_daily_change(spark):
    names = [f"{t}|{f}" for t in ("A", "B") for f in schemas.BAR_FIELDS]
    rows = [(D0, *[1.0] * 4, 5, *[None] * 5), (D0 + dt.timedelta(days=1), *[2.0] * 4, 6, *[3.0] * 4, 7)]
    kinds = ["bigint" if n.endswith("Volume") else "double" for n in names]
    wide = spark.createDataFrame(rows, "Date date, " + ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds)))
    long = {(r.Ticker, (r.Date - D0).days): (r.Close, r.Volume) for r in wide_to_long(wide, ["A", "B"]).collect()}
    assert long == {("A", 0): (1.0, 5), ("A", 1): (2.0, 6), ("B", 1): (3.0, 7)}
    changed = daily_change(wide, ["A", "B"]).collect()
    assert [(r.Ticker, r.percentage_change) for r in changed] == [("A", 1.0)]


def test_trailing_week_counts_from_the_last_date(spark):
    df = spark.createDataFrame([(D0 + dt.timedelta(days=i),) for i in (0, 1, 2, 3, 5, 8, 9)], "Date date")
    assert sorted((r.Date - D0).days for r in trailing_days(df).collect()) == [2, 3, 5, 8, 9]


def test_latest_prices(spark):
    got = {tuple(r) for r in latest_prices(bars(spark, {"BTC-USD": [1.0, 2.125], "X": [3.0]})).collect()}
    assert got == {("BTC", "2.12", "USD"), ("X", "3.0", "UNKNOWN")}


def test_series_that_are_not_daily_go_by_ranges(spark):
    rows = [(k, i, None if i % 7 == 3 else float(1 + (i * i) % 11)) for k in "ab" for i in range(90)]
    ticks = spark.createDataFrame(rows, "Ticker string, seq bigint, Close double")
    days = ticks.withColumn("seq", F.date_add(F.lit("2020-01-01").cast("date"), F.col("seq").cast("int")))
    for run, column in ((I.rsi, "RSI"), (I.pct_change, "percentage_change")):
        by_ranges, plain = run(ticks, order="seq"), run(days, order="seq")
        at = F.date_diff("seq", F.lit("2020-01-01").cast("date"))
        want = {(r.Ticker, r["at"]): r[column] for r in plain.withColumn("at", at).collect()}
        got = {(r.Ticker, r.seq): r[column] for r in by_ranges.collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want) and want
    small = {(r.Ticker, r.seq): r.percentage_change for r in I.pct_change_by_ranges(ticks, order=("seq",), parts=30).collect()}
    assert small.keys() == want.keys() and all(abs(small[k] - want[k]) < 1e-9 for k in want)
