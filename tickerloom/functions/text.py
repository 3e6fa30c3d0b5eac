"""Ticker, headline and time expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Words a CSV reader with default settings takes for a missing value (fixed values).
NA_WORDS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
KEY_SEPARATOR = "||"


# White space of any script, and the four separators that count as such elsewhere.
_BLANK = r"[\s\x1c-\x1f]"


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, f"(?U)^{_BLANK}+|{_BLANK}+$", "")


def na_to_null(c: Column, words=NA_WORDS) -> Column:
    return F.when(~c.isin(*words), c)


def ticker_clean(c: Column) -> Column:
    return F.replace(c, F.lit("-"), F.lit(""))


def split_ticker(c: Column) -> tuple[Column, Column]:
    """(coin, fiat) around the first dash; a ticker without a dash has fiat UNKNOWN."""
    dash = F.instr(c, "-")
    return (
        F.when(dash > 0, F.substring_index(c, "-", 1)).otherwise(c),
        F.when(dash > 0, F.substr(c, dash + 1)).when(c.isNotNull(), "UNKNOWN"),
    )


def icon_ticker(c: Column) -> Column:
    return ticker_clean(F.replace(c, F.lit(".png"), F.lit("")))


def clean_datetime(c: Column) -> Column:
    """The text after the first comma, trimmed; text without a comma is kept."""
    comma = F.instr(c, ",")
    return F.when(comma > 0, strip(F.substr(c, comma + 1))).otherwise(c)


def parse_news_time(c: Column) -> Column:
    """``Thu, 11 Sep 2025 05:11:58 GMT`` or ISO-8601; anything else gives NULL."""
    rfc = F.try_to_timestamp(clean_datetime(c), F.lit("d MMM yyyy HH:mm:ss 'GMT'"))
    return F.when(c.contains("GMT"), rfc).otherwise(F.try_to_timestamp(c))


def timeago(ts: Column, as_of: Column) -> Column:
    """Age of ``ts`` at ``as_of`` in words; from 30 days on the date itself."""
    secs = ((F.unix_micros(as_of) - F.unix_micros(ts)) / F.lit(1_000_000)).cast("bigint")

    def age(unit_secs: int, word: str) -> Column:
        return F.concat((secs / F.lit(unit_secs)).cast("bigint").cast("string"), F.lit(word))

    return (
        F.when(ts.isNull(), "N/A")
        .when(secs < 60, age(1, " sec ago"))
        .when(secs < 3_600, age(60, " min ago"))
        .when(secs < 86_400, age(3_600, " hr ago"))
        .when(secs < 2 * 86_400, age(86_400, " day ago"))
        .when(secs < 30 * 86_400, age(86_400, " days ago"))
        .otherwise(F.date_format(ts, "yyyy-MM-dd"))
    )


def headline_key(title: Column, provider: Column) -> Column:
    return F.concat_ws(
        KEY_SEPARATOR, F.coalesce(strip(title), F.lit("")), F.coalesce(strip(provider), F.lit(""))
    )


def iso_date(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def canonical_status(c: Column) -> Column:
    return F.lower(F.trim(c))
