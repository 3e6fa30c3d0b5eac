import datetime as dt
import math
from decimal import Decimal

from pyspark.sql import functions as F

from tickerloom.functions import numbers as N, sentiment as S, text as X


def values(spark, rows, kind, *columns):
    """One list per column expression, in the order of the rows."""
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    out = df.select("i", *[c(F.col("x")).alias(f"c{n}") for n, c in enumerate(columns)]).orderBy("i").collect()
    picked = [[r[f"c{n}"] for r in out] for n in range(len(columns))]
    return picked[0] if len(columns) == 1 else picked


def test_rounding_half_up_and_half_even(spark):
    up, even = values(spark, [0.125, 0.375, 2.5, None], "double", N.round_half_up, N.round_half_even)
    assert up == [0.13, 0.38, 2.5, None]
    assert even == [0.12, 0.38, 2.5, None]


def test_money_text(spark):
    rows = ["", "abc", "15336853.00", None, " 7.5", "-1"]
    plain = values(spark, rows, "string", N.to_money)
    assert plain == [None, None, Decimal("15336853.00000000"), None, Decimal("7.50000000"), Decimal("-1.00000000")]
    clamped = values(spark, ["15336853.00", "-15336853", "1"], "string", lambda c: N.to_money(c, saturate=True))
    assert clamped == [Decimal("9999999.99999999"), Decimal("-9999999.99999999"), Decimal("1.00000000")]


def test_tickers(spark):
    rows = ["BTC-USD", "BTC", "A-B-C", None]
    assert values(spark, rows, "string", X.ticker_clean) == ["BTCUSD", "BTC", "ABC", None]
    coin, fiat = values(spark, rows, "string", lambda c: X.split_ticker(c)[0], lambda c: X.split_ticker(c)[1])
    assert coin == ["BTC", "BTC", "A", None]
    assert fiat == ["USD", "UNKNOWN", "B-C", None]
    assert values(spark, ["BTC-USD.png", "ETHUSD.png"], "string", X.icon_ticker) == ["BTCUSD", "ETHUSD"]


def test_news_times(spark):
    rows = ["Thu, 11 Sep 2025 05:11:58 GMT", "11 Sep 2025 05:11:58 GMT", "2025-09-11T05:11:58Z",
            "2025-09-11T05:11:58+00:00", "2025-09-11T07:11:58+02:00", "2025-09-11 05:11:58", "N/A", "", None]
    at = dt.datetime(2025, 9, 11, 5, 11, 58)
    assert values(spark, rows, "string", lambda c: X.parse_news_time(c)) == [at] * 6 + [None] * 3
    cleaned = values(spark, rows[:3] + [None], "string", X.clean_datetime)
    assert cleaned == ["11 Sep 2025 05:11:58 GMT", "11 Sep 2025 05:11:58 GMT", "2025-09-11T05:11:58Z", None]


def test_timeago(spark):
    now = dt.datetime(2025, 10, 13, 12, 0, 0)
    ages = [dt.timedelta(seconds=s) for s in (0, 59, 60, 59 * 60 + 59, 3600, 23 * 3600, 86400, 2 * 86400, 30 * 86400 - 1, 30 * 86400)]
    rows = [now - a for a in ages] + [None, now + dt.timedelta(seconds=90)]
    at = F.lit("2025-10-13 12:00:00").cast("timestamp")
    assert values(spark, rows, "timestamp", lambda c: X.timeago(c, at)) == [
        "0 sec ago", "59 sec ago", "1 min ago", "59 min ago", "1 hr ago", "23 hr ago", "1 day ago", "2 days ago",
        "29 days ago", "2025-09-13", "N/A", "-90 sec ago",
    ]


def test_levels_are_strict(spark):
    assert values(spark, [70.0, 70.1, 30.0, 29.9, None], "double", N.rsi_level) == [
        "neutral", "overbought", "neutral", "oversold", None,
    ]


def test_change_labels(spark):
    label, kind = values(spark, [0.05123456, -0.5, 0.0, None], "double", N.change_label, N.change_class)
    assert label == ["+0.0512%", "-0.5000%", "0.0000%", None]
    assert kind == ["positive", "negative", "neutral", None]


def test_sentiment(spark):
    rows = [[0.1, 0.2, 0.9], [5.0, 5.0, 5.0], [1000.0, 0.0, -1000.0], [-800.0, -900.0, 800.0]]
    scores = values(spark, rows, "array<double>", S.sentiment_from_logits)
    assert abs(scores[0] - 0.28299) < 1e-5
    assert scores[1:] == [0.0, -1.0, 1.0]
    assert values(spark, [None, 0.5, 0.49], "double", S.sentiment_label) == ["neutral", "positive", "negative"]


def test_word_scorer_reads_the_whole_text(spark):
    text = "nothing here " * 3000 + "crash"
    low, none, high = values(spark, [text, "nothing", "rally Rally RALLY"], "string", lambda c: S.sentiment_from_logits(S.word_logits(c)))
    assert low < 0 and none == 0 and high > 0.3


def test_trade_arithmetic(spark):
    df = spark.createDataFrame([(Decimal("10"), Decimal("3")), (Decimal("1"), Decimal("0"))], "a decimal(15,8), n decimal(18,8)")
    out = df.select(N.unit_cost(F.col("a"), F.col("n")).alias("u"), N.trade_amount(F.col("n"), F.col("a")).alias("t")).collect()
    assert [r.u for r in out] == [Decimal("3.33333333"), None]
    assert [r.t for r in out] == [Decimal("30.00000000"), Decimal("0E-8")]


def test_formats(spark):
    assert values(spark, [1600069384, 0, -1234], "bigint", N.thousands) == ["1,600,069,384", "0", "-1,234"]
    assert values(spark, [1.23456789], "double", lambda c: N.fixed(c, 3)) == ["1.235"]


def test_missing_words_and_nan(spark):
    assert values(spark, ["N/A", "", "null", "fine", None], "string", X.na_to_null) == [None, None, None, "fine", None]
    assert values(spark, [math.nan, 1.0], "double", N.nan_to_null) == [None, 1.0]


def test_headline_key(spark):
    df = spark.createDataFrame([(" a ", "b "), (None, "b"), ("a", None)], "t string, p string")
    assert [r[0] for r in df.select(X.headline_key(F.col("t"), F.col("p"))).collect()] == ["a||b", "||b", "a||"]
