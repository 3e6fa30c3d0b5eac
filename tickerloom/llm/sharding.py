"""Histogram sort into shards of near equal bytes.

Rows are ordered by a key: a hash of the text, and a hash of the id among equal texts. Splitters between shards are found
by counting: each round lays probes into the key intervals that still hold a wanted splitter, counts the exact bytes below
every probe over all rows, and narrows the intervals, until each splitter meets its target within the tolerance. Only the
counts of the probes reach the driver (at most ``shards * probes`` a round). Rows then go through one exchange.

Equal texts stay in one shard: where a splitter would fall into a group of them, the boundary goes to the nearer end of the
group. Only a group of more than ``WHOLE_SHARE`` of a shard's bytes by itself is cut, by the id's hash. DataFrame functions only.

Cases: a null or empty text counts no bytes but its row's overhead; null ids are ordered by their text alone; fully equal
rows have one key and share a shard; an empty table gives an empty table.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, functions as F

from tickerloom.llm.work import BLOCK_ROWS, blocks, packed, running, scratch, stage

ROW_BYTES = 8
PROBES = 64
TOLERANCE = 0.002
#: Share of a shard's bytes up to which a group of equal texts is never cut.
WHOLE_SHARE = 0.05
_TOP = 2**63 - 1


def size_of(text: str) -> Column:
    """UTF-8 bytes of the text and a fixed overhead."""
    return (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + ROW_BYTES).cast("bigint")


def _hash(*columns: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*columns), 1)


def _counts(keys: DataFrame, key: str, spans: list[tuple[int, int]], probes: int) -> list[tuple[int, int, int]]:
    """(least key, greatest key, bytes) of each non-empty cell; every key range of ``spans`` is cut into ``probes`` cells."""
    cell = F.lit(None).cast("bigint")
    for lo, hi in spans:
        width = max(1, -(-(hi - lo + 1) // probes))
        cell = F.when(F.col(key).between(lo, hi), F.expr(f"{lo}L + ({key} - {lo}L) div {width}L * {width}L")).otherwise(cell)
    cells = keys.select(cell.alias("cell"), key, "_size").filter(F.col("cell").isNotNull()).groupBy("cell")
    return sorted(tuple(r)[1:] for r in cells.agg(F.min(key), F.max(key), F.sum("_size")).collect())


def _search(keys: DataFrame, key: str, below: int, targets: list[float], slack: float, probes: int):
    """For each target: the boundary nearest to it, the bytes below that, and the key that straddles the target.

    The straddling key (with the bytes below it) is None where the boundary is within ``slack``. ``below`` are the
    bytes below all of ``keys``. Boundaries are keys: the rows at or above one come after it.
    """
    best: dict[float, tuple[int, int]] = {}
    inside: dict[float, tuple[int, int] | None] = {}
    todo = {t: (0, _TOP, below) for t in targets}
    while todo:
        spans = sorted({(a, b) for a, b, _ in todo.values()})
        counted = _counts(keys, key, spans, probes * max(1, len(targets) // len(spans)))
        cells = {span: [c for c in counted if span[0] <= c[0] <= span[1]] for span in spans}
        left = {}
        for t, (a, b, base) in todo.items():
            own = cells[a, b]
            sums = list(accumulate((n for *_, n in own), initial=base))
            i = min(len(own) - 1, max(0, bisect_right(sums, t) - 1))
            least, most, _ = own[i]
            after = own[i + 1][0] if i + 1 < len(own) else b + 1
            near = min((least, sums[i]), (after, sums[i + 1]), best.get(t, (least, sums[i])), key=lambda x: abs(x[1] - t))
            best[t], inside[t] = near, None
            if abs(near[1] - t) > slack:
                if least < most:
                    left[t] = (least, most, sums[i])
                else:
                    inside[t] = (least, sums[i])
        todo = left
    return {t: (*best[t], inside[t]) for t in targets}


def splitters(keys: DataFrame, shards: int, tolerance: float = TOLERANCE, probes: int = PROBES) -> list[tuple[int, int]]:
    """The (key, id hash) pairs at which shards 1 to ``shards - 1`` begin. ``keys`` has _key, _tie and _size."""
    total = keys.agg(F.sum("_size")).first()[0] or 0
    if not total:
        return []
    slack = tolerance * total / shards
    targets = [total * i / shards for i in range(1, shards)]
    found = _search(keys, "_key", 0, targets, slack, probes)
    out = {t: (key, 0) for t, (key, _, _) in found.items()}
    cut: dict[tuple[int, int], list[float]] = {}
    for t, (_, _, straddling) in found.items():
        if straddling:
            cut.setdefault(straddling, []).append(t)
    if cut:
        groups = keys.filter(F.col("_key").isin([key for key, _ in cut]))
        held = groups.groupBy("_key").agg(F.countDistinct("_tie"), F.sum("_size")).collect()
        large = {key for key, ties, size in held if ties > 1 and size > WHOLE_SHARE * total / shards}
    for (key, below), inside in cut.items():
        if key in large:
            ties = _search(keys.filter(F.col("_key") == key), "_tie", below, inside, slack, probes)
            out |= {t: (key, tie) for t, (tie, at, _) in ties.items() if abs(at - t) < abs(found[t][1] - t)}
    return sorted(out[t] for t in targets)


def shard_of(bounds: list[tuple[int, int]]) -> Column:
    """How many splitters lie at or below a row's key."""
    at = F.lit(0)
    for key, tie in bounds:
        # A boundary past the largest value lies above every row.
        if key > _TOP:
            continue
        above = F.col("_key") > F.lit(key)
        at = at + (above | ((F.col("_key") == F.lit(key)) & (F.col("_tie") >= F.lit(tie)))
                   if tie <= _TOP else above).cast("int")
    return at


def _place(docs: DataFrame) -> tuple[Column, Column]:
    """The number of a row's file (files are numbered in the order of the tasks that wrote them) and its place in the file."""
    at = docs.metadataColumn("_metadata")
    number = F.regexp_extract(at["file_name"], r"part-(\d+)", 1).try_cast("bigint")
    return F.coalesce(number, F.lit(0).cast("bigint")), F.coalesce(at["row_index"], F.lit(0).cast("bigint"))


def shard_by_bytes(
    docs: DataFrame, shards: int = 24, text: str = "text", row_id: str = "doc_id", tolerance: float = TOLERANCE, in_order: bool = False
) -> DataFrame:
    """The rows with size (long), shard (0 to ``shards - 1``) and slot (gapless from 0 within a shard).

    Slots go by the hashes, or with ``in_order`` by the rows' places in the files that ``docs`` is read from, so that a table written
    in an order keeps it within each shard. Columns of the results' names are replaced; any others stay.
    """
    file, line = _place(docs) if in_order else (F.lit(0).cast("bigint"),) * 2
    plain = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(packed(docs, ("size", "shard", "slot")), _hash(plain).alias("_key"),
                        _hash(F.col(row_id), plain).alias("_tie"), size_of(text).alias("_size"), file.alias("_file"), line.alias("_line"))
    with scratch(docs.sparkSession):
        keys, _ = stage(keyed.select("_key", "_tie", "_size"), "shard-keys")
        bounds, count = splitters(keys, shards, tolerance), keys.count()
    # Of a file, as many rows a block as leave each shard about BLOCK_ROWS of them.
    of_file = F.col("_file") * F.lit(2**32) + F.expr(f"_line div {BLOCK_ROWS * shards}L")
    block = of_file if in_order else blocks(F.col("_tie"), count // shards)
    rows = keyed.withColumns({"shard": shard_of(bounds), "_block": block})
    placed = running(rows, "shard", ["_line", "_tie", "_key"] if in_order else ["_tie", "_key"], "_block", "slot", F.lit(1).cast("bigint"))
    return placed.select("row.*", F.col("_size").alias("size"), "shard", "slot")
