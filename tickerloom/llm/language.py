"""Language of a text, word first: known words by their log frequency per language, other words by n-grams.

A word that training saw at least twice is scored by its log frequency in each language. Any other word is scored by its
character 4-grams that training saw (word ends count as characters), or if there are none by its 3-grams, 2-grams and
single characters; a word without even those says nothing. A text's scores are the sums over all of its words, and its
language is the one with the greatest sum (the first by name on a tie).

The model is fitted on at most ``per_language`` labelled rows of each of the ``MOST_LANGUAGES`` commonest labels (by name on a tie),
those with the least hash of their id, and no more than an even share of ``TRAINING_BYTES`` a language, so its size is bounded; a
row teaches whole or not at all. Scoring reads whole texts of all rows, long ones in pieces.

Cases: null texts and texts without a letter are ``und`` with score 0, as is everything if no row is labelled; a text
with no known word or character gets the first language with an even score; labels that are null teach nothing; repeated
rows each get their result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tickerloom.llm.words import ROUND_CHARS, rounds, shingles
from tickerloom.llm.work import lean, packed

UNKNOWN = "und"
PER_LANGUAGE = 1000
#: Languages that are learned, and bytes of text that teach, over all languages together.
MOST_LANGUAGES, TRAINING_BYTES = 1000, 32_000_000
LONGEST = 4
#: Added to each count before the frequencies are taken.
SMOOTHING = 0.5
#: ASCII letters and all parts of other characters stay; the rest cuts words.
_BLANK = re.compile(r"[\x20\x09-\x0D]")
_LETTERS = bytes(c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def held_out(row_id: Column) -> Column:
    """Rows that never teach: crc32 of the id as text leaves 2 on division by 4, or there is no id."""
    return F.coalesce(F.crc32(row_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def pieces(text: str | None, size: int) -> Iterator[str]:
    """The text in pieces of about ``size`` characters, cut at blanks."""
    start, text = 0, text or ""
    while start < len(text):
        blank = _BLANK.search(text, start + size)
        end = blank.start() if blank else len(text)
        yield text[start:end]
        start = end


def words_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct words, the number of each word in order, where each text's words begin)."""
    words: list[bytes] = []
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    for i, text in enumerate(texts):
        words += (text or "").lower().encode("utf-8", "replace").translate(_LETTERS).split()
        starts[i + 1] = len(words)
    if not words:
        return np.zeros(0, dtype=object), np.zeros(0, dtype=np.int64), starts
    codes, kinds = pd.factorize(np.array(words, dtype=object))
    return kinds, codes, starts


def grams(kinds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, word) of each ``size``-gram of the words, their ends marked by a blank on either side."""
    if not len(kinds):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    text = [f" {w.decode('utf-8', 'replace')} " for w in kinds]
    sizes = np.array([len(t) for t in text])
    chars = np.frombuffer("".join(text).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(kinds)), sizes)
    if len(chars) < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = owner[: len(chars) - size + 1] == owner[size - 1 :]
    found, owner = shingles(chars, size), owner[: len(chars) - size + 1]
    if size == 1:  # the marks alone tell nothing
        inside = inside & (chars != 0x20)
    return found[inside], owner[inside]


@dataclass(frozen=True)
class Model:
    """Log frequencies by language: of words (tables[0]) and of n-grams (tables[n]), each with ascending hashes."""

    languages: list[str]
    tables: dict[int, tuple[np.ndarray, np.ndarray]]

    def looked_up(self, size: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are known, and the scores of those."""
        known, scores = self.tables[size]
        if not len(known) or not len(keys):
            return np.zeros(len(keys), dtype=bool), scores[:0]
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        hit = known[at] == keys
        return hit, scores[at[hit]]

    def word_scores(self, kinds: np.ndarray) -> np.ndarray:
        """A row for each distinct word, a column for each language."""
        out = np.zeros((len(kinds), len(self.languages)))
        hit, scores = self.looked_up(0, pd.util.hash_array(kinds, categorize=False))
        out[hit] = scores
        rest = np.flatnonzero(~hit)
        for size in range(LONGEST, 0, -1):
            keys, owner = grams(kinds[rest], size)
            hit, scores = self.looked_up(size, keys)
            owner = owner[hit]
            seen = np.bincount(owner, minlength=len(rest))
            for lang in range(len(self.languages)):
                total = np.bincount(owner, weights=scores[:, lang], minlength=len(rest))
                out[rest, lang] = np.where(seen > 0, total / np.maximum(seen, 1), 0)
            rest = rest[seen == 0]
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language and its share of the likelihood, for texts that have letters."""
        # The more languages, the fewer characters at once.
        size = max(4_000, ROUND_CHARS * 4 // max(4, len(self.languages)))
        owner, parts = [], []
        for i, text in enumerate(texts):
            for part in pieces(text, size):
                owner.append(i)
                parts.append(part)
        total, of = np.zeros((len(texts), len(self.languages))), np.array(owner, dtype=np.int64)
        for lo, hi in rounds(parts, size):
            kinds, codes, starts = words_of(parts[lo:hi])
            each = self.word_scores(kinds)[codes]
            some = np.flatnonzero(np.diff(starts))
            if len(some):
                np.add.at(total, of[lo:hi][some], np.add.reduceat(each, starts[some], axis=0))
        names = [self.languages[b] for b in total.argmax(axis=1)]
        return names, 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)


def _counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How often each word (size 0) and each n-gram occurs, by language, within a batch."""
    for frame in frames:
        for lang, own in frame.groupby("lang"):
            texts = own["text"].tolist()
            for lo, hi in rounds(texts):
                kinds, codes, _ = words_of(texts[lo:hi])
                if not len(kinds):
                    continue
                times = np.bincount(codes)
                yield pd.DataFrame({"size": 0, "key": pd.util.hash_array(kinds, categorize=False).view(np.int64),
                                    "lang": lang, "n": times})
                for size in range(1, LONGEST + 1):
                    keys, owner = grams(kinds, size)
                    distinct, place = np.unique(keys, return_inverse=True)
                    total = np.bincount(place, weights=times[owner], minlength=len(distinct)).astype(np.int64)
                    yield pd.DataFrame({"size": size, "key": distinct.view(np.int64), "lang": lang, "n": total})


def training_rows(docs: DataFrame, text: str, label: str, row_id: str, per_language: int) -> DataFrame:
    """(lang, text) of at most ``per_language`` rows of each language that are not held out."""
    able = docs.filter(~held_out(F.col(row_id)) & F.col(label).isNotNull() & F.col(text).isNotNull())
    named = able.select(F.col(row_id).alias("_id"), F.col(label).cast("string").alias("_lang"), F.xxhash64(row_id).alias("_hash"),
                        F.octet_length(text).cast("bigint").alias("_bytes"))
    counts = named.groupBy("_lang").count().orderBy(F.desc("count"), "_lang").limit(MOST_LANGUAGES).collect()
    if not counts:
        return docs.limit(0).select(F.col(label).cast("string").alias("lang"), F.col(text).alias("text"))
    share = TRAINING_BYTES // len(counts)
    # Only hashes below a bound that leaves some more than the wanted rows go through the ranking.
    margin = per_language + 6 * math.isqrt(per_language) + 10
    bounds = F.create_map(*[F.lit(x) for lang, n in counts for x in (lang, 2.0**64 * margin / n - 2.0**63)])
    order = Window.partitionBy("_lang").orderBy("_hash", "_id")
    least = named.filter((F.col("_hash") <= F.element_at(bounds, F.col("_lang"))) & (F.col("_bytes") <= share))
    ranked = least.withColumns({"_at": F.row_number().over(order), "_sum": F.sum("_bytes").over(
        order.rowsBetween(Window.unboundedPreceding, Window.currentRow))})
    chosen = ranked.filter((F.col("_at") <= per_language) & (F.col("_sum") <= share)).select("_id").distinct()
    rows = able.select(F.col(row_id).alias("_id"), F.col(label).cast("string").alias("lang"), F.col(text).alias("text"))
    # At most per_language ids of at most MOST_LANGUAGES languages: a bounded table, and no text is moved.
    return rows.join(F.broadcast(chosen), "_id", "left_semi").select("lang", "text")


def fit(docs: DataFrame, text: str = "text", label: str = "lang", row_id: str = "doc_id",
        per_language: int = PER_LANGUAGE) -> Model:
    """Learns from the labelled rows that are not held out."""
    rows = training_rows(docs, text, label, row_id, per_language)
    counts = rows.mapInPandas(lean(_counted), "size int, key bigint, lang string, n bigint")
    # As Arrow columns: an object a value would take many times their bytes on the driver.
    summed = counts.groupBy("size", "key", "lang").agg(F.sum("n").alias("n")).toArrow()
    sizes, hashes, times = (summed[c].to_numpy() for c in ("size", "key", "n"))
    named = summed["lang"].combine_chunks().dictionary_encode()
    languages = sorted(named.dictionary.to_pylist())
    of = np.array([languages.index(x) for x in named.dictionary.to_pylist()], dtype=np.int64)[named.indices.to_numpy(zero_copy_only=False)]
    tables = {}
    for size in range(LONGEST + 1):
        own = sizes == size
        keys, place = np.unique(hashes[own].astype(np.int64).view(np.uint64), return_inverse=True)
        table = np.zeros((len(keys), len(languages)))
        table[place, of[own]] = times[own]
        if size == 0:  # words seen once are left to their n-grams
            often = table.sum(axis=1) > 1
            keys, table = keys[often], table[often]
        table = np.log((table + SMOOTHING) / (table.sum(axis=0) + SMOOTHING * max(1, len(keys))))
        tables[size] = keys, table
    return Model(languages, tables)


def lettered(text: str) -> Column:
    return F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))


def prediction(spark: SparkSession, model: Model, text: str = "text") -> Column:
    """A struct of lang_pred and score (0 to 1) of a text column."""
    none = F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    if not model.languages:
        return none
    shared = spark.sparkContext.broadcast(model)

    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            names, shares = shared.value.predict(texts.tolist())
            yield pd.DataFrame({"lang_pred": names, "score": shares})

    found = F.pandas_udf(lean(predict), "lang_pred string, score double")(F.col(text))
    return F.when(lettered(text), found).otherwise(none)


def with_language(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds lang_pred and score to the rows; columns of these names are replaced, any others stay."""
    named = docs.select(packed(docs, ("lang_pred", "score")), prediction(docs.sparkSession, model, text).alias("found"))
    return named.select("row.*", "found.*")
