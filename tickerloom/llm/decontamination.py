"""Which documents hold passages of benchmark items: a prefix-filtered set join with exact windows.

An item is a set of windows (10 consecutive words, or the whole item if shorter), a window a sequence of word shingles.
One pass over the documents keeps, per document, the places of shingles that occur in any item. Shingles are then ordered by
how often they occur in all documents. Containment is whole, so one shingle of a window is a necessary prefix: the rarest.
Only where it occurs is the window tried: its start and end must lie inside the document (positional and length bound),
and every shingle must follow in order.

The items' shingles go to the tasks as sorted arrays of a bounded size (``most_windows``); a larger benchmark is taken in
several such parts, each with a pass of its own, and the parts' hits are united.

Cases: null texts and texts without words have no words, no hits and, as items, no windows; equal items of different ids
each count, an item without an id counts for words only;
repeated rows each get their own result; null ids are kept as they are; an empty table gives an empty table. :func:`decontaminate`
keeps all columns as they are, whatever their names; the other results hold the id and their own columns alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from tickerloom.llm import bloom
from tickerloom.llm.words import ALNUM, hashed_words, rounds, shingles
from tickerloom.llm.work import lean, packed, stage

WINDOW = 10
SHINGLE = 4
MOST_WINDOWS = 400_000
_FLAG_BITS = 22


def item_windows(items: DataFrame, text: str, item: str, window: int, size: int) -> DataFrame:
    """A row per item window: item (text), number, words, tokens (its shingles in order)."""

    def cut(frames):
        for frame in frames:
            out = []
            for name, raw in zip(frame["item"], frame["text"], strict=True):
                words, _ = hashed_words([raw], ALNUM)
                width = min(window, len(words))
                for i in range(len(words) - width + 1 if width else 0):
                    part = shingles(words[i : i + width], min(size, width))
                    out.append((name, i, width, part.view(np.int64)))
            yield pd.DataFrame(out, columns=["item", "number", "words", "tokens"])

    rows = items.select(F.col(item).cast("string").alias("item"), F.col(text).cast("binary").alias("text"))
    return rows.mapInPandas(cut, "item string, number int, words int, tokens array<bigint>")


@dataclass(frozen=True)
class Tokens:
    """Sorted item shingles, with a flag table that turns most other shingles away at once."""

    sizes: list[int]
    sorted: np.ndarray
    flags: np.ndarray

    @staticmethod
    def of(tokens: np.ndarray, sizes: list[int]) -> Tokens:
        flags = np.zeros(1 << _FLAG_BITS, dtype=bool)
        flags[tokens >> np.uint64(64 - _FLAG_BITS)] = True
        return Tokens(sizes, np.sort(tokens), flags)

    def held(self, every: np.ndarray) -> np.ndarray:
        """Positions of the shingles that are tokens."""
        at = np.flatnonzero(self.flags[every >> np.uint64(64 - _FLAG_BITS)])
        near = np.minimum(np.searchsorted(self.sorted, every[at]), max(0, len(self.sorted) - 1))
        return at[self.sorted[near] == every[at]] if len(self.sorted) else at[:0]


def shingle_hits(texts: list, tokens: Tokens):
    """For each text: its number of words, and positions and values of its item shingles."""
    for lo, hi in rounds(texts):
        words, starts = hashed_words(texts[lo:hi], ALNUM)
        places, values = [], []
        for size in tokens.sizes:
            every = shingles(words, size)
            at = tokens.held(every)
            doc = np.searchsorted(starts, at, side="right") - 1
            inside = at + size <= starts[doc + 1]
            places.append(at[inside])
            values.append(every[at[inside]])
        place, value = np.concatenate(places), np.concatenate(values)
        order = np.argsort(place, kind="stable")
        place, value = place[order], value[order]
        ends = np.searchsorted(place, starts)
        for i in range(hi - lo):
            own = slice(ends[i], ends[i + 1])
            yield int(starts[i + 1] - starts[i]), (place[own] - starts[i]).astype(np.int32), value[own].view(np.int64)


@dataclass(frozen=True)
class Index:
    """Windows by their rarest shingle: window w has tokens flat[begin[w]:begin[w + 1]]."""

    prefix: np.ndarray  # ascending; one entry a window
    offset: np.ndarray
    words: np.ndarray
    item: np.ndarray
    begin: np.ndarray
    flat: np.ndarray


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (count[0] of them), then the same for the next entries."""
    total = int(count.sum())
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(total)


def occurrences(base: np.ndarray, place: np.ndarray, value: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """(window, first word) of each occurrence.

    ``base`` are the texts' first words (and the end), ``place`` counts words over all texts and ascends.
    """
    lo, hi = np.searchsorted(index.prefix, value, "left"), np.searchsorted(index.prefix, value, "right")
    window = _ranges(lo, hi - lo)
    at = np.repeat(place, hi - lo)
    doc = np.searchsorted(base, at, side="right") - 1
    start = at - index.offset[window]
    fits = (start >= base[doc]) & (start + index.words[window] <= base[doc + 1])
    window, start = window[fits], start[fits]
    count = index.begin[window + 1] - index.begin[window]
    wanted = index.flat[_ranges(index.begin[window], count)]
    where = _ranges(start, count)
    # Every shingle of the window must stand at its place; a place has one entry for each shingle size at most.
    same = np.zeros(len(where), dtype=bool)
    left, right = np.searchsorted(place, where, "left"), np.searchsorted(place, where, "right")
    for step in range(int((right - left).max(initial=0))):
        here = left + step < right
        same[here] |= value[left[here] + step] == wanted[here]
    if not len(window):
        return window, start
    whole = np.logical_and.reduceat(same, np.cumsum(count) - count)
    return window[whole], start[whole]


def _matched(hits: DataFrame, index: Index, keys: list[str]) -> DataFrame:
    """Per document: n_words, spans of hit words (start, end) and the items that occur."""
    shared = hits.sparkSession.sparkContext.broadcast(index)
    schema = T.StructType([hits.schema[k] for k in keys] + T._parse_datatype_string(
        "n_words bigint, spans array<struct<start: int, end: int>>, items array<string>").fields)

    def match(frames):
        index = shared.value
        for frame in frames:
            n = frame["n_words"].to_numpy()
            base = np.r_[0, np.cumsum(n)]
            sizes = frame["places"].map(len).to_numpy()
            flat = lambda c, kind: np.concatenate([np.zeros(0, kind), *frame[c].to_numpy()]).astype(kind)
            place = flat("places", np.int64) + np.repeat(base[:-1], sizes)
            window, start = occurrences(base, place, flat("values", np.int64).view(np.uint64), index)
            covered = np.zeros(int(base[-1]) + 1, dtype=np.int32)
            np.add.at(covered, start, 1)
            np.add.at(covered, start + index.words[window], -1)
            on = np.cumsum(covered) > 0
            doc = np.searchsorted(base, start, side="right") - 1
            spans, items = [[] for _ in n], [[] for _ in n]
            for d in np.unique(doc):
                edge = np.diff(np.r_[False, on[base[d] : base[d + 1]], False].astype(np.int8))
                ends = zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)
                spans[d] = [{"start": int(a), "end": int(b)} for a, b in ends]
            for d, i in set(zip(doc.tolist(), index.item[window].tolist(), strict=True)):
                if i is not None:
                    items[d].append(i)
            yield frame[keys].assign(n_words=n, spans=spans, items=[sorted(x) for x in items])

    return hits.mapInPandas(lean(match), schema)


def _united(parts: list[DataFrame], docs: DataFrame, keys: list[str]) -> DataFrame:
    """The hits of several benchmark parts as one row per document row."""
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)

    def merge(frames):
        for frame in frames:
            out = []
            for nested in frame["spans"]:
                merged: list[dict] = []
                for a, b in sorted((s["start"], s["end"]) for s in nested):
                    if merged and a <= merged[-1]["end"]:
                        merged[-1]["end"] = max(b, merged[-1]["end"])
                    else:
                        merged.append({"start": int(a), "end": int(b)})
                out.append(merged)
            yield frame.assign(spans=out)

    grouped = every.groupBy(*keys).agg(
        F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    merged = grouped.mapInPandas(merge, every.schema)
    named = merged.select(*[F.col(k).alias(f"_m{k}") for k in keys], "n_words", "spans", "items")
    on = [F.col(k).eqNullSafe(F.col(f"_m{k}")) for k in keys]
    return docs.select(*keys).join(named, on, "left").select(*keys, "n_words", "spans", "items")


def benchmark_hits(
    docs: DataFrame, items: DataFrame, text: str = "text", row_id: str = "doc_id", item_id: str = "item_id",
    item_text: str = "text", window: int = WINDOW, size: int = SHINGLE, most_windows: int = MOST_WINDOWS,
) -> DataFrame:
    """Per document row: its id, _text (a hash of its text), n_words, spans (of hit words) and items (sorted, as text)."""
    keys = [row_id, "_text"]
    rows = docs.select(row_id, F.xxhash64(F.col(text)).alias("_text"), F.col(text).cast("binary").alias("_raw"))
    # An item given twice has its windows once.
    windows, _ = stage(item_windows(items, item_text, item_id, window, size).distinct(), "item-windows")
    count = windows.count()
    parts, of = [], -(-count // most_windows) or 1
    for number in range(of):
        own = windows.filter(F.pmod(F.xxhash64("item", "number"), F.lit(of)) == number) if of > 1 else windows
        parts.append(_part(rows, own, keys, size))
    return parts[0] if of == 1 else _united(parts, rows, keys)


def _part(rows: DataFrame, windows: DataFrame, keys: list[str], size: int) -> DataFrame:
    """The hits of at most ``most_windows`` windows."""
    spark = rows.sparkSession
    numbered = windows.withColumn("window", F.struct("item", "number"))
    distinct = numbered.select(F.explode("tokens").alias("token"), F.least("words", F.lit(size)).alias("size")).distinct()
    found = distinct.toPandas()
    shared = spark.sparkContext.broadcast(
        Tokens.of(found["token"].to_numpy(np.int64).view(np.uint64), sorted(map(int, found["size"].unique()))))
    schema = T.StructType([rows.schema[k] for k in keys] + T._parse_datatype_string(
        "n_words bigint, places array<int>, values array<bigint>").fields)

    def scan(frames):
        tokens = shared.value if shared.value.sizes else Tokens([size], shared.value.sorted, shared.value.flags)
        for frame in frames:
            got = list(shingle_hits(frame["_raw"].tolist(), tokens))
            yield frame[keys].assign(n_words=[g[0] for g in got], places=[g[1] for g in got], values=[g[2] for g in got])

    hits, _ = stage(rows.mapInPandas(lean(scan), schema), "shingle-hits")
    often = hits.select(F.explode("values").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    ranked = (
        numbered.select("window", "words", "tokens", F.posexplode("tokens").alias("offset", "token"))
        .join(often, "token")
        .groupBy("window", "words", "tokens")
        .agg(F.min(F.struct("n", "offset", "token")).alias("rarest"), F.count("*").alias("present"))
        .filter(F.col("present") == F.size("tokens"))  # else some shingle occurs in no document
        .select("window.item", "words", "tokens", "rarest.offset", "rarest.token")
    ).toPandas()
    prefix = ranked["token"].to_numpy(np.int64).view(np.uint64)
    ranked = ranked.iloc[np.argsort(prefix, kind="stable")]
    sizes = ranked["tokens"].map(len).to_numpy(np.int64)
    index = Index(
        np.sort(prefix), ranked["offset"].to_numpy(np.int64), ranked["words"].to_numpy(np.int64),
        ranked["item"].to_numpy(), np.r_[0, np.cumsum(sizes)].astype(np.int64),
        np.concatenate([np.zeros(0, np.int64), *ranked["tokens"]]).astype(np.int64).view(np.uint64),
    )
    return _matched(hits, index, keys)


def counted(hits: DataFrame) -> DataFrame:
    """Adds n_hit, n_items, items_sha256 and contaminated."""
    width = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"])
    return hits.withColumns({
        "n_hit": width, "n_items": F.size("items").cast("bigint"),
        "items_sha256": F.sha2(F.concat_ws(",", "items"), 256), "contaminated": F.size("spans") > 0,
    })


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", row_id: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark window, with their columns as they are."""
    named = docs.select(F.col(row_id).alias("id"), F.col(text).alias("text"))
    hit = benchmark_hits(named, items, "text", "id", **options).filter(F.size("spans") > 0)
    bad, _ = stage(hit.select(F.col("id").alias("bad_id"), F.col("_text").alias("bad_text")).distinct(), "contaminated")
    rows = docs.select(packed(docs), F.col(row_id).alias("id"), F.xxhash64(F.col(text)).alias("hash"))
    same = F.col("id").eqNullSafe(F.col("bad_id")) & (F.col("hash") == F.col("bad_text"))
    return bloom.without(rows, bad, F.xxhash64("id", "hash"), F.xxhash64("bad_id", "bad_text"), same).select("row.*")
