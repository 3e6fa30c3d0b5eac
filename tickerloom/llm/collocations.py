"""Phrases whose words belong together, counted with stripes.

A stripe is a prefix of words with an associative counter of the words that come next. Tasks build the stripes of their own
texts and give them out packed; stripes of one prefix are merged elementwise. What is asked of a phrase is read off merged
stripes alone: its count is an entry of its prefix's stripe, the total of the empty prefix's stripe counts all words, and the
longer phrases that may subsume it are the entries of its own stripe (a word more at the end) and its entries in other stripes
(a word more at the front).

Passes over the texts: stripes of the empty prefix (words), of one word (pairs), and of two words up to ``longest - 1``. A
phrase occurs at most as often as any part, so pairs are only taken of words that occur ``least`` times, longer phrases only
where all their pairs do. Those frequent parts go to the tasks as a Bloom filter of a bounded size, whose errors only cost
entries that are dropped when merged; when they are too many for one filter, the pass is made once for each share of the prefixes.

Merging is dealt to buckets, of some megabytes of text each. A stripe that would by itself outgrow its bucket is cut into
sub-stripes by the next word. Such prefixes have more than a bucket's share of all words, so there is less than one a bucket.

A candidate's score is ``SCALE * a // (l + r)``, a its count and l, r those of its two parts at the cut (of all cuts) that gives the
lowest score. A candidate goes if a longer one that holds it occurs at least ``subsumed`` percent as often.

Cases: null and empty texts have no words; a null language is ``und``; repeated rows count as often as they occur; a text may be of
any length, as words are handed on in portions; equal scores rank by count, then by the phrase's bytes; an empty table
gives an empty table. Only text and language are read, so other columns cannot clash. Words are told apart by 63-bit hashes,
phrases by those of all their words.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tickerloom.llm import bloom
from tickerloom.llm.words import mixed, portions, rounds
from tickerloom.llm.work import lean, stage

LONGEST, LEAST, SUBSUMED, BEST = 4, 30, 80, 2000
SCALE = 2_000_000
#: Words that a task combines at once.
CHUNK = 1_000_000
#: Bytes of text whose stripes one bucket merges, about, and buckets at least.
BUCKET_BYTES, LEAST_BUCKETS = 8_000_000, 64
#: Frequent parts that one filter holds (some 30 MB).
FILTER_KEYS = 40_000_000
UNKNOWN = "und"
_END = -1  # stands between pieces
_POSITIVE = np.int64(2**63 - 1)
# Marks of [.,;:!?\x0A-\x0D] end a piece; a tab is a blank.
_MARKS = bytes(0x2E if c in b".,;:!?\x0a\x0b\x0c\x0d" else 0x20 if c == 0x09 else c for c in range(256))
_PACKED = "lang string, size int, bucket bigint, heads binary, sizes binary, tails binary, counts binary, " \
    "spelt array<struct<number: bigint, word: string>>"
_MERGED = "lang string, words array<bigint>, n bigint, key bigint"


def numbered(raws: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The words of some texts in order as numbers, with _END after each piece, in portions; and each portion's vocabulary."""
    for lo, hi in rounds(raws):
        whole = b".".join([raw or b"" for raw in raws[lo:hi]] + [b""])
        for words in portions(whole.translate(_MARKS).replace(b".", b" . ")):
            if not words:
                continue
            codes, kinds = pd.factorize(np.array(words, dtype=object))
            numbers = (pd.util.hash_array(kinds, categorize=False) >> np.uint64(1)).view(np.int64)
            numbers[kinds == b"."] = _END
            yield numbers[codes], kinds, numbers


def phrase_keys(lang: str, words: list[np.ndarray]) -> np.ndarray:
    """A hash of each phrase, given as columns of words."""
    out = np.full(len(words[0]), (zlib.crc32(lang.encode()) << 8) + len(words), dtype=np.uint64)
    for column in words:
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + column.view(np.uint64))
    return out.view(np.int64)


@dataclass(frozen=True)
class Pass:
    """What tasks need for one pass: the phrase sizes to take, the parts they may have, and how stripes are dealt."""

    sizes: tuple[int, ...]
    buckets: int
    allowed: bloom.Filter | None = None  # frequent phrases of min(sizes) - 1 words; share ``part`` of ``parts`` of them
    part: int = 0
    parts: int = 1
    hot: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # keys of large stripes' prefixes, ascending
    cuts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # their numbers of sub-stripes
    spells: bool = False

    def frequent(self, lang: str, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places where a phrase's first part may start, and where its later parts may."""
        step = min(self.sizes) - 1
        span = max(0, len(words) - step + 1)
        inside = np.logical_and.reduce([words[i : i + span] != _END for i in range(step)])
        at = np.flatnonzero(inside)
        keys = phrase_keys(lang, [words[at + i] for i in range(step)])
        mine = (keys & _POSITIVE) % self.parts == self.part
        own = np.zeros(span, dtype=bool)
        own[at[mine]] = bloom.lets_through(keys[mine].view(np.uint64), self.allowed)
        # A filter of one share cannot judge the later parts.
        return own, own if self.parts == 1 else inside

    def rows(self, lang: str, words: np.ndarray, done: int, vocabulary: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple]:
        """The stripes of some words, packed; phrases that end among the first ``done`` words are counted already."""
        if self.allowed is None:
            yield from self.stripes(lang, [words[done:][words[done:] != _END]])
            return
        own, able = self.frequent(lang, words)
        step = min(self.sizes) - 1
        for size in self.sizes:
            n = max(0, len(words) - size + 1)
            at = np.flatnonzero(np.logical_and.reduce([own[:n], *[able[i : i + n] for i in range(1, size - step + 1)]]))
            at = at[at + size > done]
            yield from self.stripes(lang, [words[at + i] for i in range(size)])
        if self.spells:
            at = np.flatnonzero(own)
            used = np.unique(np.concatenate([words[at + i] for i in range(step)]))
            kinds, numbers = (np.concatenate(x) for x in zip(*vocabulary, strict=True))
            numbers, first = np.unique(numbers, return_index=True)
            held = np.isin(numbers, used, assume_unique=True)
            if held.any():
                pairs = zip(numbers[held].tolist(), kinds[first[held]], strict=True)
                spelt = [{"number": n, "word": w.decode("utf-8", "replace")} for n, w in pairs]
                yield lang, 0, -1, None, None, None, None, spelt

    def stripes(self, lang: str, columns: list[np.ndarray]) -> Iterator[tuple]:
        """Phrases, given as columns of words, as rows of packed stripes, one for each bucket."""
        if not len(columns[0]):
            return
        size, tail = len(columns), columns[-1]
        head = np.zeros(len(tail), dtype=np.int64)
        for column in columns[:-1]:
            codes, kinds = pd.factorize(column)
            head = pd.factorize(head * len(kinds) + codes)[0].astype(np.int64)
        codes, kinds = pd.factorize(tail)
        _, first, counts = np.unique(head * len(kinds) + codes, return_index=True, return_counts=True)
        columns, head, tail = [column[first] for column in columns], head[first], tail[first]
        place = mixed(phrase_keys(lang, columns[:-1] or [np.zeros_like(tail)]).view(np.uint64))
        # A large stripe is cut by the next word, as is that of the empty prefix.
        parts = np.full(len(tail), self.buckets if size == 1 else 1, dtype=np.uint64)
        if size > 1 and len(self.hot):
            keys = phrase_keys(lang, columns[: min(self.sizes) - 1])
            at = np.minimum(np.searchsorted(self.hot, keys), len(self.hot) - 1)
            parts = np.where(self.hot[at] == keys, self.cuts[at], 1).astype(np.uint64)
        bucket = ((place % np.uint64(self.buckets) + mixed(tail.view(np.uint64)) % parts) % np.uint64(self.buckets)).astype(np.int64)
        order = np.lexsort((head, bucket))
        columns, head, bucket = [column[order] for column in columns], head[order], bucket[order]
        tail, counts = columns[-1], counts[order].astype(np.int32)
        new = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (head[1:] != head[:-1])])
        heads = np.stack([column[new] for column in columns[:-1]] or [np.zeros(0, np.int64)], axis=-1)
        edges = np.r_[new, len(tail)]
        sizes, of = np.diff(edges).astype(np.int32), bucket[new]
        begin = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        for a, b in zip(begin.tolist(), np.r_[begin[1:], len(new)].tolist(), strict=True):
            own = slice(edges[a], edges[b])
            yield (lang, size, int(of[a]), heads[a:b].tobytes(), sizes[a:b].tobytes(), tail[own].tobytes(),
                   counts[own].tobytes(), None)


def packed(rows: DataFrame, what: Pass, longest: int) -> DataFrame:
    """The stripes that tasks make of their own rows (lang, raw), and with ``spells`` the spelling of frequent words."""
    shared = rows.sparkSession.sparkContext.broadcast(what)

    def scan(frames):
        what, held, carried = shared.value, {}, {}

        def made() -> pd.DataFrame:
            out = []
            for lang, (parts, vocabulary) in held.items():
                before = carried.get(lang, np.zeros(0, np.int64))
                words = np.concatenate([before, *parts])
                out += what.rows(lang, words, len(before), vocabulary)
                carried[lang] = words[max(0, len(words) - longest + 1) :]
            held.clear()
            return pd.DataFrame(out, columns=["lang", "size", "bucket", "heads", "sizes", "tails", "counts", "spelt"])

        count = 0
        for frame in frames:
            for lang, own in frame.groupby("lang", sort=False):
                for words, kinds, numbers in numbered(own["raw"].tolist()):
                    parts, vocabulary = held.setdefault(lang, ([], []))
                    parts.append(words)
                    if what.spells:
                        vocabulary.append((kinds, numbers))
                    count += len(words)
                    if count >= CHUNK:
                        yield made()
                        count = 0
        if held:
            yield made()

    return rows.mapInPandas(lean(scan), _PACKED)


def merged(stripes: DataFrame, least: int) -> DataFrame:
    """Stripes of equal prefixes added elementwise: phrases of at least that count, and the empty phrase with totals of words."""

    def add(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        lang, size, _ = key
        flat = {c: np.frombuffer(b"".join(frame[c]), kind) for c, kind in
                (("heads", np.int64), ("sizes", np.int32), ("tails", np.int64), ("counts", np.int32))}
        of = np.repeat(np.arange(len(flat["sizes"])), flat["sizes"])
        columns = [flat["heads"][i :: size - 1][of] for i in range(size - 1)] + [flat["tails"]]
        order = np.lexsort(columns[::-1])
        columns = [column[order] for column in columns]
        new = np.flatnonzero(np.r_[True, np.logical_or.reduce([column[1:] != column[:-1] for column in columns])])
        counts = np.add.reduceat(flat["counts"][order].astype(np.int64), new)
        kept = counts >= least
        columns = [column[new[kept]] for column in columns]
        words, n, keys = list(np.stack(columns, axis=1)), counts[kept].tolist(), phrase_keys(lang, columns).tolist()
        if size == 1:
            words, n, keys = [*words, np.zeros(0, np.int64)], [*n, int(counts.sum())], [*keys, 0]
        return pd.DataFrame({"lang": lang, "words": pd.Series(words, dtype=object), "n": n, "key": keys})

    return stripes.groupBy("lang", "size", "bucket").applyInPandas(add, _MERGED)


def phrase_counts(docs: DataFrame, text: str, lang: str, longest: int, least: int) -> tuple[DataFrame, DataFrame]:
    """(lang, words, n): all phrases that occur ``least`` times, and for no words the totals; and (number, word)."""
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text).cast("binary").alias("raw"))
    size = rows.agg(F.sum(F.octet_length("raw"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, math.ceil(size / BUCKET_BYTES))
    words, _ = stage(merged(packed(rows, Pass((1,), buckets), longest), least), "words")
    total = words.filter(F.size("words") == 0).agg(F.sum("n")).first()[0] or 0
    share = max(1, total // buckets)
    level, levels, spelling = words.filter(F.size("words") == 1), [words], []
    for sizes in [(2,), tuple(range(3, longest + 1))] if longest > 2 else [(2,)]:
        # Counts add up to no more than all words, so fewer than ``buckets`` of them pass the share.
        hot = level.filter(F.col("n") > share).select("key", "n").orderBy("key").toPandas()
        count = level.count()
        parts, found = max(1, math.ceil(count / FILTER_KEYS)), []
        for part in range(parts):
            own = level.filter(F.pmod(F.col("key").bitwiseAND(F.lit(int(_POSITIVE))), F.lit(parts)) == part)
            what = Pass(sizes, buckets, bloom.filled(own.select(F.col("key").alias("_key")), own.count() if parts > 1 else count),
                        part, parts, hot["key"].to_numpy(np.int64), -(-hot["n"].to_numpy(np.int64) // share), sizes[-1] == longest)
            given = packed(rows, what, longest)
            if what.spells:
                given, _ = stage(given, "stripes")
                spelling.append(given.filter("size = 0").select(F.explode("spelt").alias("s")).select("s.*"))
                given = given.filter("size > 0")
            found.append(stage(merged(given, least), "phrases")[0])
        level = _all(found)
        levels.append(level)
    return _all(levels).select("lang", "words", "n"), _all(spelling).groupBy("number").agg(F.min("word").alias("word"))


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def _exact(column: str) -> Column:
    return F.col(column).cast("decimal(20,0)")


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST,
    subsumed: int = SUBSUMED, best: int = BEST,
) -> DataFrame:
    """Each language's ``best`` phrases: lang, rank, phrase, a, l, r, n, score."""
    counts, spelling = phrase_counts(docs, text, lang, longest, least)
    size = F.size("words")
    totals = counts.filter(size == 0).groupBy("lang").agg(F.sum("n").alias("n"))
    phrases = counts.filter(size >= 2).withColumnRenamed("n", "a")
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1))).withColumns({
        "first": F.slice("words", F.lit(1), F.col("k")), "rest": F.slice("words", F.col("k") + 1, size - F.col("k"))})
    part = counts.filter(size >= 1)
    scored = cuts.join(part.select("lang", F.col("words").alias("first"), F.col("n").alias("l")), ["lang", "first"]).join(
        part.select("lang", F.col("words").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    scored = scored.withColumns({"up": _exact("a") * F.lit(SCALE).cast("decimal(7,0)"), "down": _exact("l") + _exact("r")})
    lowest = scored.groupBy("lang", "words").agg(F.min(F.struct(F.expr("up div down").alias("score"), "k", "a", "l", "r")).alias("cut"))
    # A longer candidate yet occurs no more often than the one that is a word longer and lies in it.
    inner = F.explode(F.array(F.slice("words", F.lit(1), size - 1), F.slice("words", F.lit(2), size - 1)))
    longer = phrases.filter(size >= 3).select("lang", inner.alias("words"), "a").groupBy("lang", "words").agg(F.max("a").alias("most"))
    rows = lowest.join(longer, ["lang", "words"], "left").select("lang", "words", "cut.*", "most").filter(
        F.col("most").isNull() | (_exact("most") * 100 < _exact("a") * subsumed))
    rows, _ = stage(rows, "candidates")
    each = rows.select("lang", "words", F.posexplode("words").alias("at", "number")).join(spelling, "number")
    spelt = each.groupBy("lang", "words").agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("own"))
    named = rows.join(spelt.select("lang", "words", F.concat_ws(" ", "own.word").alias("phrase")), ["lang", "words"])
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = named.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= best)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
