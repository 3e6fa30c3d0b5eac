import datetime as dt

import pytest
from pyspark.sql import functions as F

from tickerloom import schemas
from tickerloom.functions.text import parse_news_time
from tickerloom.operators.filters import drop_null
from tickerloom.plans.news import clean_news, ingest_news, news_feed, score_news
from tickerloom.sources import files, headlines, messages

HEADER = ["ticker", "current_price", "fiat_currency"]


def test_news_csv_missing_words_quotes_and_line_breaks(spark, tmp_path):
    (tmp_path / "n.csv").write_text(
        '﻿Ticker,Title,Source,date_time\nAUSD,"Up, and ""away""\nnow",The Block,"2025-10-13 08:26:09"\n'
        'AUSD,N/A,X,2025-10-13 08:26:09\nBUSD, padded ,NaN,\n', encoding="utf-8")
    news = files.read_news(spark, str(tmp_path), line_breaks=True)
    assert sorted(map(tuple, news.collect()), key=str) == sorted([
        ("AUSD", 'Up, and "away"\nnow', "The Block", "2025-10-13 08:26:09"), ("AUSD", None, "X", "2025-10-13 08:26:09"),
        ("BUSD", " padded ", None, None)], key=str)
    assert drop_null(news).count() == 1


def test_escaped_news_csv(spark, tmp_path):
    (tmp_path / "n.csv").write_text(
        "Ticker,Title,Source,Date/Time\nAUSD,Coins\\, up,The Block,Thu\\, 11 Sep 2025 05:11:58 GMT\nAUSD,N/A,,2025-09-11T05:11:58Z\n")
    rows = files.read_news_escaped(spark, str(tmp_path)).withColumn("at", parse_news_time(F.col("date_time"))).collect()
    at = dt.datetime(2025, 9, 11, 5, 11, 58)
    assert {(r.Title, r.Source, r.at) for r in rows} == {("Coins, up", "The Block", at), ("N/A", "", at)}


def test_strict_header(spark, tmp_path):
    good, bad = tmp_path / "good", tmp_path / "bad"
    good.mkdir(), bad.mkdir()
    (good / "a.csv").write_text("ticker,current_price,fiat_currency\nBTC-JPY,15336853.00,JPY\n")
    (bad / "a.csv").write_text("ticker,current_price,fiat_currency\nBTC-JPY,1,JPY\n")
    (bad / "b.csv").write_text("ticker,price,fiat_currency\nBTC-JPY,1,JPY\n")
    table = str(tmp_path / "table")
    assert files.load_prices(spark, str(good), table).count() == 1
    with pytest.raises(files.HeaderMismatch):
        files.load_prices(spark, str(bad), table)
    assert spark.read.parquet(table).count() == 1


def test_append_twice_or_by_run(spark, tmp_path):
    df = spark.createDataFrame([("a", "r1"), ("b", "r2")], "v string, run string")
    plain, runs = str(tmp_path / "plain"), str(tmp_path / "runs")
    for _ in range(2):
        files.append(df, plain)
        files.append(df, runs, run="run")
    assert spark.read.parquet(plain).count() == 4
    files.append(df.filter("run = 'r2'").withColumn("v", F.lit("c")), runs, run="run")
    assert sorted(r.v for r in spark.read.parquet(runs).collect()) == ["a", "c"]


def test_prefix_listing(spark, tmp_path):
    base = str(tmp_path)
    for name in ("one", "two/deep"):
        files.publish_files(spark.createDataFrame([(name,)], "v string").coalesce(1), base, f"rsi_data/{name}/")
    files.publish_files(spark.createDataFrame([("other",)], "v string"), base, "else")
    assert sorted(r.v for r in files.read_prefix(spark, base, "rsi_data/").collect()) == ["one", "two/deep"]


def test_messages_round_trip_nan_and_rejects(spark):
    lines = ['{"Date": "2025-10-01", "Ticker": "A", "Open": 1.5, "High": 2, "Low": 1, "Close": NaN, "Volume": 7}',
             "not json", '{"Date": "soon", "Ticker": "A"}', '{"Date": "2025-10-01"}']
    bars, bad = messages.parse_bars(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert [tuple(r) for r in bars.collect()] == [(dt.date(2025, 10, 1), "A", 1.5, 2.0, 1.0, None, 7)]
    assert sorted(r.value for r in bad.collect()) == sorted(lines[1:])
    sent = messages.to_messages(bars.withColumn("Close", F.lit(1.0))).collect()[0]
    assert sent.key == "2025-10-01"
    assert sent.value == '{"Date":"2025-10-01","Ticker":"A","Open":1.5,"High":2.0,"Low":1.0,"Close":1.0,"Volume":7}'
    assert messages.topic_options("stock", "host:1")["startingOffsets"] == "earliest"


CARD = ("<article data-qa-id='news-headline-card'>{}</article>")
PAGE = "<div><article>not a card</article>" + "".join(CARD.format(c) for c in [
    "<div data-qa-id='news-headline-title' data-overflow-tooltip-text='Full &amp; long'>Full…</div>"
    "<span class='x provider-y'><span> The </span>Block </span><relative-time event-time='Thu, 11 Sep 2025 05:11:58 GMT'>now</relative-time>",
    "<div data-qa-id='news-headline-title'> Text <b>title</b><br> here</div><time datetime='2025-09-11T05:11:58Z'>then</time>",
    "<span class='provider'>P</span><time>yesterday</time>",
    "<relative-time>no attribute</relative-time><time datetime='2025-09-11T05:11:58Z'></time>",
]) + "</div>"


def test_headline_cards(spark):
    pages = spark.createDataFrame([(1, "BTCUSD", PAGE), (2, "BTCUSD", None), (3, "X", "<p>none</p>")], "page_id bigint, ticker string, html string")
    rows = headlines.extract_headlines(pages).orderBy("position").collect()
    assert [tuple(r)[3:] for r in rows] == [
        ("Full & long", "The Block", "Thu, 11 Sep 2025 05:11:58 GMT"), ("Text title here", "N/A", "2025-09-11T05:11:58Z"),
        ("N/A", "P", "yesterday"), ("N/A", "N/A", "N/A"),
    ]


def test_news_intake(spark):
    card = CARD.format("<div data-qa-id='news-headline-title'>{}</div><time datetime='2025-09-11T05:11:58Z'></time>")
    rows = [(1, "A", 1, "<p>no cards</p>"), (2, "A", 2, card.format("one") + card.format("two")), (3, "A", 2, card.format("one")), (4, "A", 3, card.format("late"))]
    pages = spark.createDataFrame(rows, "page_id bigint, ticker string, priority int, html string")
    news = ingest_news(pages)
    assert sorted(r.title for r in news.collect()) == ["one", "two"]
    assert {r.date_time for r in news.collect()} == {dt.datetime(2025, 9, 11, 5, 11, 58)}
    cards = spark.createDataFrame([("A", f"t{i}", "s", "N/A", i) for i in range(150)], "ticker string, title string, source string, raw_time string, seq bigint")
    assert clean_news(cards).count() == 100


def test_scores_need_both_news_sets(spark):
    def news(rows):
        return spark.createDataFrame(rows, "Ticker string, Title string, Source string")

    daily = news([("A", "rally", "s"), ("A", None, "s"), ("B", "crash", "s")])
    got = score_news(daily, news([("A", "crash", "s"), ("C", "x", "s")])).collect()
    assert [r.Ticker for r in got] == ["A"] and got[0].avg_sentiment_score > 0 > got[0].avg_sentiment_score1


def test_news_feed(spark):
    rows = [("A", "x", "s", dt.datetime(2025, 1, 1)), ("B", "y", "s", None), ("A", "z", "s", dt.datetime(2025, 1, 2))]
    news = spark.createDataFrame(rows, "ticker string, title string, source string, date_time timestamp")
    feed = news_feed(news, "2025-01-02 00:00:30").collect()
    assert [(r.title, r.age) for r in feed] == [("z", "30 sec ago"), ("x", "1 day ago"), ("y", "N/A")]
    assert [r.title for r in news_feed(news, "2025-01-02", "A").collect()] == ["z", "x"]


def test_price_csv(spark, tmp_path):
    bars = spark.createDataFrame([(dt.date(2025, 1, 1), "A", 1.0, 2.0, 0.5, None, 3)], schemas.BARS)
    files.write_csv(bars, str(tmp_path / "p"))
    assert [tuple(r) for r in files.read_prices(spark, str(tmp_path / "p")).collect()] == [tuple(r) for r in bars.collect()]


def test_a_ticker_may_be_called_ticker(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Ticker,Title,Source,Date/Time\nTicker,one\\, two,S,x\nTicker,Title,S,x\n")
    (tmp_path / "b.csv").write_text("T,three,S,x\n")
    rows = files.read_news_escaped(spark, str(tmp_path)).collect()
    assert sorted((r.Ticker, r.Title) for r in rows) == [("T", "three"), ("Ticker", "Title"), ("Ticker", "one, two")]


def test_only_the_first_line_is_the_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("ticker,current_price,junk\nticker,current_price,fiat_currency\nA,1,USD\n")
    with pytest.raises(files.HeaderMismatch):
        files.read_csv_strict(spark, str(tmp_path), schemas.CRYPTO_PRICE_CSV, ["ticker", "current_price", "fiat_currency"])
    good = tmp_path / "good"
    good.mkdir()
    (good / "a.csv").write_text("ticker,current_price,fiat_currency\nA,1,USD\n")
    loaded = files.read_csv_strict(spark, str(good), schemas.CRYPTO_PRICE_CSV, ["ticker", "current_price", "fiat_currency"])
    assert [tuple(r) for r in loaded.collect()] == [("A", "1", "USD")]
