"""Sentiment from three logits (bearish, neutral, bullish) and a pluggable scorer."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, functions as F

# The weight of each class in a headline's score.
CLASS_WEIGHTS = (-1.0, 0.0, 1.0)
POSITIVE_FROM = 0.5

# The default scorer's own word lists.
BULLISH_WORDS = (
    "gain", "gains", "rally", "rallies", "surge", "surges", "soar", "soars", "rise", "rises", "bullish",
    "record", "growth", "boost", "upgrade", "breakout", "outperform", "win",
)
BEARISH_WORDS = (
    "loss", "losses", "drop", "drops", "fall", "falls", "crash", "crashes", "plunge", "plunges", "bearish",
    "hack", "lawsuit", "fraud", "ban", "selloff", "downgrade", "fear",
)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def sentiment_from_logits(logits: Column) -> Column:
    """Softmax over the logits, then the weighted sum of the class probabilities."""
    weights = F.array(*[F.lit(w) for w in CLASS_WEIGHTS])

    def weigh(odds: Column) -> Column:
        total = F.aggregate(odds, F.lit(0.0), lambda acc, x: acc + x)
        signed = F.aggregate(F.zip_with(odds, weights, lambda o, w: o * w), F.lit(0.0), lambda acc, x: acc + x)
        return signed / total

    def odds(values: Column) -> Column:
        return _let(F.array_max(values), lambda top: F.transform(values, lambda x: F.exp(x - top)))

    return _let(logits, lambda values: _let(odds(values), weigh))


def word_logits(text: Column, bullish=BULLISH_WORDS, bearish=BEARISH_WORDS) -> Column:
    """Default scorer: the share of the text's words that are on the bearish and on the bullish list."""

    def shares(words: Column) -> Column:
        # The text is cut once; each word is looked up in a hashed set.
        count = F.size(words).cast("double")
        share = lambda listed: F.size(F.filter(words, lambda w: w.isin(*listed))).cast("double") / count
        return F.array(share(bearish), F.lit(0.0), share(bullish))

    return F.when(text.isNotNull(), _let(F.split(F.lower(text), r"[^\p{L}]+"), shares)).otherwise(
        F.array(F.lit(None).cast("double"), F.lit(0.0), F.lit(None).cast("double")))


def sentiment_label(score: Column) -> Column:
    return F.when(score.isNull(), "neutral").when(score >= POSITIVE_FROM, "positive").otherwise("negative")


def model_logits(load: Callable[[], Callable[[list[str]], list[list[float]]]]) -> Callable[[Column], Column]:
    """A scorer around an external classifier.

    ``load`` runs once per Python worker and returns texts -> logits; Spark feeds it Arrow batches of
    ``spark.sql.execution.arrow.maxRecordsPerBatch`` texts.
    """

    @F.pandas_udf("array<double>")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            yield pd.Series([[float(x) for x in row] for row in model(texts.fillna("").tolist())])

    return score
