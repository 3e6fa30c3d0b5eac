"""Running totals and row look-back along an order, for keys of any size.

A plain ``Window.partitionBy(key)`` sorts a whole key in one task. Here rows are first spread by ranges of
(key, order), so one key may span many ranges; each range is worked on alone and only a small record per
(key, range) is carried on to the next ranges of the same key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickerloom.session import discard, stage, staged

CHUNK = "_chunk"


def range_chunks(df: DataFrame, key: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """Rows with the number of their (key, order) range, written once to the shared folder.

    ``order`` must be total within a key. The numbers are stored, so every later reader sees the same ranges.
    """
    return stage(_ranges(df, key, order, parts), "chunks")


def _ranges(df: DataFrame, key: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    args = ([parts] if parts else []) + [F.col(c).asc_nulls_first() for c in (*key, *order)]
    return df.repartitionByRange(*args).withColumn(CHUNK, F.spark_partition_id())


def running_totals(
    chunks: DataFrame, key: list[str], order: list[str], totals: dict[str, Column], inclusive: bool = True
) -> DataFrame:
    """Adds running sums per key; ``inclusive=False`` leaves the row itself out."""
    summed = {f"_v_{name}": value for name, value in totals.items()}
    rows = chunks.withColumns(summed)
    per_chunk = rows.groupBy(*key, CHUNK).agg(*[F.sum(v).alias(v) for v in summed])
    before = Window.partitionBy(*key).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_chunk.select(*key, CHUNK, *[F.sum(v).over(before).alias(f"_o{v}") for v in summed])
    local = (
        Window.partitionBy(*key, CHUNK)
        .orderBy(*[F.col(c).asc_nulls_first() for c in order])
        .rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    )
    # Keys may be NULL-free only: rows and offsets meet on equality.
    joined = rows.withColumns({v: F.sum(v).over(local) for v in summed}).join(offsets, [*key, CHUNK], "left")
    out = {
        name: F.coalesce(F.col(f"_v_{name}"), F.lit(0)) + F.coalesce(F.col(f"_o_v_{name}"), F.lit(0))
        for name in totals
    }
    return joined.withColumns(out).drop(*summed, *[f"_o{v}" for v in summed])


def rank_in_key(df: DataFrame, key: list[str], order: list[str], name: str = "rank_in_key") -> DataFrame:
    """Row number per key without gathering a key in one task."""
    chunks = range_chunks(df, key, order)
    return running_totals(chunks, key, order, {name: F.lit(1).cast("bigint")}).drop(CHUNK)


def staged_ranks(df: DataFrame, key: list[str], order: list[str], name: str) -> tuple[DataFrame, str]:
    """As :func:`rank_in_key`, written; and its path. Nothing else stays behind."""
    chunks, path = staged(_ranges(df, key, order), "chunks")
    ranked = staged(running_totals(chunks, key, order, {name: F.lit(1).cast("bigint")}).drop(CHUNK), "ranks")
    discard(df.sparkSession, path)
    return ranked


def with_previous_rows(chunks: DataFrame, key: list[str], order: list[str], n: int) -> DataFrame:
    """Copies into each range the ``n`` rows of the same key that precede it, marked ``_halo``.

    A window of at most n rows back is then exact within (key, range).
    """
    rest = [c for c in chunks.columns if c not in {*key, *order, CHUNK}]
    latest = Window.partitionBy(*key, CHUNK).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    tails = (
        chunks.withColumn("_back", F.row_number().over(latest))
        .filter(F.col("_back") <= n)
        .groupBy(*key, CHUNK)
        .agg(F.sort_array(F.collect_list(F.struct(*order, *rest))).alias("_tail"))
    )
    # Every range of a key holds at least one of its rows: n ranges back always suffice.
    before = Window.partitionBy(*key).orderBy(CHUNK).rowsBetween(-n, -1)
    carried = F.flatten(F.collect_list("_tail").over(before))
    halo = (
        tails.withColumn("_prev", carried)
        .withColumn("_prev", F.slice("_prev", F.greatest(F.size("_prev") - n + 1, F.lit(1)), n))
        .select(*key, CHUNK, F.explode("_prev").alias("_row"))
        .select(*key, *[F.col(f"_row.{c}").alias(c) for c in (*order, *rest)], CHUNK, F.lit(True).alias("_halo"))
    )
    return chunks.withColumn("_halo", F.lit(False)).unionByName(halo)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
