"""News intake, sentiment scores and the news feed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tickerloom.functions.sentiment import sentiment_from_logits, word_logits
from tickerloom.functions.text import parse_news_time, timeago
from tickerloom.operators.aggregates import mean_score
from tickerloom.operators.filters import drop_null, rows_for
from tickerloom.operators.joins import merge_means
from tickerloom.operators.latest import cap_per_key, dedupe_headlines, first_nonempty_source
from tickerloom.operators.ordering import newest_first, tickers
from tickerloom.session import stage
from tickerloom.sources.headlines import CardSelectors, extract_headlines

MAX_CARDS = 100


def ingest_news(pages: DataFrame, selectors: CardSelectors = CardSelectors(), cap: int = MAX_CARDS) -> DataFrame:
    """Captured pages to news rows.

    pages: page_id, ticker, priority (of the address the page came from), html. Per ticker the first address with
    any card wins; the first ``cap`` distinct headlines in page order stay.
    """
    # Written once: the pages are parsed a single time, though their cards are read twice.
    cards = stage(extract_headlines(pages, selectors, keep=("page_id", "ticker", "priority")), "cards")
    kept = first_nonempty_source(cards, "ticker", "priority").withColumn("seq", F.struct("page_id", "position"))
    return clean_news(kept.select("ticker", "title", "source", "raw_time", "seq"), cap)


def clean_news(cards: DataFrame, cap: int = MAX_CARDS) -> DataFrame:
    """cards: ticker, title, source, raw_time, seq (arrival order)."""
    first = cap_per_key(dedupe_headlines(cards), "ticker", ["seq"], cap)
    return first.select("ticker", "title", "source", parse_news_time(F.col("raw_time")).alias("date_time"))


def score_titles(news: DataFrame, scorer: Callable[[Column], Column] = word_logits) -> DataFrame:
    """Complete rows with the score of their title."""
    return drop_null(news).withColumn("sentiment_score", sentiment_from_logits(scorer(F.col("Title"))))


def score_news(daily: DataFrame, recent: DataFrame, scorer: Callable[[Column], Column] = word_logits) -> DataFrame:
    """Mean title score per ticker over the daily and over the three-day news, for tickers in both."""
    return merge_means(
        mean_score(score_titles(daily, scorer), "avg_sentiment_score"),
        mean_score(score_titles(recent, scorer), "avg_sentiment_score1"),
    )


def score_recent(
    news: DataFrame, days: int = 3, ts: str = "date_time", scorer: Callable[[Column], Column] = word_logits
) -> DataFrame:
    """As :func:`score_news` where the recent news are the last ``days`` days of the same table: each title is scored once.

    The table's last time is looked up beforehand from its time column alone.
    """
    last = news.agg(F.max(ts)).first()[0]
    since = F.lit(last).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS")
    scored = drop_null(news, ["Ticker", "Title"]).withColumn("sentiment_score", sentiment_from_logits(scorer(F.col("Title"))))
    recent = F.when(F.col(ts) >= since, F.col("sentiment_score"))
    means = scored.groupBy("Ticker").agg(
        F.avg("sentiment_score").alias("avg_sentiment_score"), F.avg(recent).alias("avg_sentiment_score1"),
        F.count(F.when(F.col(ts) >= since, 1)).alias("_recent"),
    )
    return means.filter("_recent > 0").drop("_recent")


def news_feed(news: DataFrame, as_of, ticker: str | None = None) -> DataFrame:
    """News newest first, with its age at ``as_of``; of one ticker or of all."""
    at = F.lit(as_of).cast("timestamp")
    shown = rows_for(news, "ticker", ticker).withColumn("age", timeago(F.col("date_time"), at))
    return newest_first(shown.select("ticker", "title", "source", "date_time", "age"), "date_time", "ticker", "title")


def news_tickers(news: DataFrame) -> DataFrame:
    return tickers(news)
