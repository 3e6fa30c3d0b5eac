"""Near copies by SimHash fingerprints, found with multi-index hashing.

A text's shingles (repeats included) are hashed to 64 bits each; a fingerprint bit is 1 if more than half of the hashes have
it. Texts link when their fingerprints differ in at most ``distance`` bits.

1. Documents become fingerprints; equal ones become one node, so copies are never paired.
2. Fingerprints are cut into m segments, each with a table of its own. Of ``distance = m * s + a`` differing bits either one of
   the first a + 1 segments holds at most s, or one of the others at most s - 1. So every fingerprint asks the tables for the
   small Hamming ball of that radius around its own segment, and every linked pair meets in some table. Of two segments
   that differ only the greater asks, so a pair meets once a table. m is chosen by the number of fingerprints:
   fewer, wider segments as tables fill up; any m finds every link.
3. What meets in a table's bucket is compared whole, vectors at a time. A bucket of more than ``BLOCK`` fingerprints is cut into
   blocks, and a pair of blocks is one task's work. A task gives out which of its fingerprints belong together as a star for
   each group of them, never all pairs.
4. Components of those links name the documents.

Cases: null texts and texts without words have no shingles and the fingerprint zero, which links like any other; a text of fewer
words than a shingle is one shingle; repeated rows share a fingerprint; null ids never name a component that has another id;
an empty table gives an empty table. Texts are taken in portions, however long. Only the id and the text are read, and only
the id, ``fingerprint`` and ``component_id`` given out, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from tickerloom.llm.components import components
from tickerloom.llm.words import portions
from tickerloom.llm.work import discard, lean, stage

BITS = 64
#: Fingerprints of one bucket that are compared in one task.
BLOCK = 8_192
#: Rows of buckets that are handled together, about, and groups of buckets at least.
GROUP_ROWS, LEAST_GROUPS = 200_000, 256
#: Pairs compared in one step.
STEP = 1_000_000
#: What an index row costs, in comparisons.
ROW_COST = 100
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_LANES = np.arange(8, dtype=np.int64) * 256


def shingle_hashes(text: bytes | None, words: int, seed: int) -> Iterator[np.ndarray]:
    """The hashes of a text's shingles in order, a portion at a time."""
    carry: list[bytes] = []
    whole = True
    for found in portions(text):
        carry += found
        if len(carry) >= words:
            whole = False
            yield _hashes(carry, words, seed)
            carry = carry[len(carry) - words + 1 :]
    if whole and carry:
        yield _hashes(carry, len(carry), seed)


def _hashes(found: list[bytes], words: int, seed: int) -> np.ndarray:
    line, digest = b" ".join(found), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    n = len(found) - words + 1
    spans = zip(starts[:n].tolist(), ends[words - 1 :].tolist(), strict=True)
    return np.fromiter((digest(line[a:b], seed) for a, b in spans), np.uint64, n)


def fingerprint(text: bytes | None, words: int = 4, seed: int = 42) -> int:
    """As a number, the bits that more than half of the text's shingle hashes have."""
    ones, total = np.zeros((8, 8), dtype=np.int64), 0
    for hashes in shingle_hashes(text, words, seed):
        total += len(hashes)
        lanes = hashes.astype("<u8").view(np.uint8).reshape(-1, 8) + _LANES
        ones += np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256) @ _BYTE_BITS
    return int.from_bytes(np.packbits(2 * ones > total, bitorder="little").tobytes(), "little") if total else 0


def fingerprints(docs: DataFrame, text: str = "text", row_id: str = "doc_id", words: int = 4, seed: int = 42) -> DataFrame:
    """Per row: its id and its fingerprint as a (signed) long."""
    rows = docs.select(F.col(row_id).alias("id"), F.col(text).cast("binary").alias("raw"))
    schema = T.StructType([rows.schema["id"], T.StructField("print", T.LongType())])

    def sign(frames):
        for frame in frames:
            own = np.array([fingerprint(raw, words, seed) for raw in frame["raw"]], dtype=np.uint64)
            yield frame[["id"]].assign(print=own.view(np.int64))

    return rows.mapInPandas(lean(sign), schema)


@dataclass(frozen=True)
class Segment:
    """Bits ``low`` to ``low + width - 1`` of a fingerprint, whose table is asked for a ball of this radius."""

    number: int
    low: int
    width: int
    radius: int

    def keys(self, values: np.ndarray) -> np.ndarray:
        return (np.uint64(self.number) << np.uint64(56) | values).view(np.int64)

    def values(self, prints: np.ndarray) -> np.ndarray:
        return prints >> np.uint64(self.low) & np.uint64((1 << self.width) - 1)

    def ball(self) -> list[int]:
        """What to flip for each other value within the radius."""
        return [sum(1 << b for b in bits) for r in range(1, self.radius + 1) for bits in combinations(range(self.width), r)]


def cut(m: int, distance: int) -> list[Segment]:
    """m segments, and the radii within which two fingerprints at that distance must meet in at least one."""
    s, a = divmod(distance, m)
    edges = [BITS * i // m for i in range(m + 1)]
    parts = [Segment(i, edges[i], edges[i + 1] - edges[i], s if i <= a else s - 1) for i in range(m)]
    return [part for part in parts if part.radius >= 0]


def _balls(part: Segment) -> int:
    return sum(comb(part.width, r) for r in range(part.radius + 1))


def segments(count: int, distance: int) -> list[Segment]:
    """The cut that costs least for so many fingerprints: index rows against comparisons in filled buckets."""

    def cost(parts: list[Segment]) -> float:
        return sum((1 + _balls(p) / 2) * ROW_COST + _balls(p) / 2 * count / 2.0**p.width for p in parts)

    return min((cut(m, distance) for m in range(2, max(2, distance) + 1)), key=cost)


def index_rows(prints: DataFrame, parts: list[Segment]) -> DataFrame:
    """(key, print, asks): each fingerprint's place in each table, and the lesser keys of its balls, which it asks."""

    def index(frames):
        for frame in frames:
            own = frame["print"].to_numpy(np.int64)
            for part in parts:
                values = part.values(own.view(np.uint64))
                yield pd.DataFrame({"key": part.keys(values), "print": own, "asks": False})
                for flips in part.ball():
                    near = values ^ np.uint64(flips)
                    less = near < values
                    yield pd.DataFrame({"key": part.keys(near[less]), "print": own[less], "asks": True})

    return prints.select("print").mapInPandas(lean(index), "key bigint, print bigint, asks boolean")


def full_buckets(prints: DataFrame, parts: list[Segment]) -> DataFrame:
    """(full, blocks) of the keys whose buckets hold more than one block."""
    keys = [F.shiftrightunsigned("print", part.low).bitwiseAND(F.lit((1 << part.width) - 1)).bitwiseOR(F.lit(part.number << 56))
            for part in parts]
    held = prints.select(F.explode(F.array(*keys)).alias("full")).groupBy("full").agg(F.count("*").alias("n"))
    return held.filter(F.col("n") > BLOCK).select("full", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))


def united(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each the least place of its group) once the places a and b are joined, pair by pair."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(next_label := label[label], label):
            label = next_label


def met(held: np.ndarray, keys: np.ndarray, asking: np.ndarray, ask_keys: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars (fingerprint, centre) of the groups that links within buckets join.

    ``held`` stand in the buckets ``keys`` (ascending); each is compared with those after it in its bucket, and each of
    ``asking`` with all of the bucket ``ask_keys``.
    """
    nodes, place = np.unique(np.concatenate([held, asking]), return_inverse=True)
    label, bits = np.arange(len(nodes)), nodes.view(np.uint64)
    at = np.arange(len(held))
    ends = np.searchsorted(keys, keys, "right")
    lo = np.r_[at + 1, np.searchsorted(keys, ask_keys, "left")]
    hi = np.r_[ends, np.searchsorted(keys, ask_keys, "right")]
    span = hi - lo
    todo = np.flatnonzero(span)
    total = np.cumsum(span[todo])
    start = 0
    while start < len(todo):
        done = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, done + STEP, "right")))
        own, count = todo[start:end], span[todo[start:end]]
        other = np.repeat(lo[own] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        one = np.repeat(place[own], count)
        near = np.bitwise_count(bits[one] ^ bits[place[other]]) <= distance
        label = united(label, one[near], place[other[near]])
        start = end
    away = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[away], nodes[label[away]]


def links(prints: DataFrame, count: int, distance: int) -> DataFrame:
    """(a, b): links that join the ``count`` different fingerprints of ``prints`` as all their links would."""
    parts = segments(count, distance)
    full = full_buckets(prints, parts)
    placed = index_rows(prints, parts).join(full, F.col("key") == F.col("full"), "left")
    # Held in one block, and asking those before it; who only asks, asks all blocks.
    own = F.when(F.col("asks"), F.col("blocks")).otherwise(F.pmod(F.xxhash64("print"), F.col("blocks"))).cast("int")
    own = F.coalesce(own, F.col("asks").cast("int"))
    rows = placed.withColumn("own", own).withColumn("block", F.explode(F.sequence(
        F.lit(0), F.when(F.col("asks"), F.col("own") - 1).otherwise(F.col("own")))))
    groups = max(LEAST_GROUPS, int(count * sum(1 + _balls(p) / 2 for p in parts)) // GROUP_ROWS)
    rows = rows.select("key", "block", "print", (F.col("block") != F.col("own")).alias("asks"),
                       F.pmod(F.xxhash64("key", "block"), F.lit(groups)).alias("group"))

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        blocks = frame["block"].to_numpy(np.int64)
        keys = pd.factorize(frame["key"])[0] * (blocks.max() + 1) + blocks
        asks, prints = frame["asks"].to_numpy(bool), frame["print"].to_numpy(np.int64)
        order = np.flatnonzero(~asks)
        order = order[np.argsort(keys[order], kind="stable")]
        a, b = met(prints[order], keys[order], prints[asks], keys[asks], distance)
        return pd.DataFrame({"a": a, "b": b})

    return rows.groupBy("group").applyInPandas(compare, "a bigint, b bigint")


def near_copies(
    docs: DataFrame, text: str = "text", row_id: str = "doc_id", words: int = 4, distance: int = 4, seed: int = 42
) -> DataFrame:
    """Per row: its id, fingerprint (16 hexadecimal digits) and component_id (the least id that links reach)."""
    rows, _ = stage(fingerprints(docs, text, row_id, words, seed), "fingerprints")
    prints, at = stage(rows.groupBy("print").agg(F.min("id").alias("least")), "distinct-fingerprints")
    found, kept = stage(links(prints, prints.count(), distance), "links-found")
    joins, path = stage(components(found), "components")
    named = prints.join(joins, F.col("print") == F.col("node"), "left").withColumn("root", F.coalesce("root", "print"))
    least = named.filter("node IS NOT NULL").groupBy("root").agg(F.min("least").alias("first"))
    final, _ = stage(named.join(least, "root", "left").select(
        "print", F.when(F.col("node").isNull(), F.col("least")).otherwise(F.col("first")).alias("component_id")), "named")
    discard(docs.sparkSession, at, kept, path)
    return rows.join(final, "print").select(
        F.col("id").alias(row_id), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
