"""Staged tables that can be deleted again, lean workers, and row numbers without a single large task."""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tickerloom.session import configure, discard, staged

__all__ = ["blocks", "discard", "lean", "packed", "running", "scratch", "stage", "table"]

_scratch: list[list[str]] = []


def stage(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As :func:`tickerloom.session.staged`; within :func:`scratch` the table is deleted with the others."""
    out, path = staged(df, name)
    if _scratch:
        _scratch[-1].append(path)
    return out, path


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables staged inside, at its end; what reads them must be written by then."""
    _scratch.append([])
    try:
        yield
    finally:
        discard(spark, *_scratch.pop())


def packed(df: DataFrame, leave: tuple[str, ...] = ()) -> Column:
    """All columns but ``leave`` as one struct ``row``: with it no column's name can clash. ``row.*`` gives them back."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns if c not in leave]).alias("row")


def lean(fn: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """Wraps a function over a task's batches: once it is through, freed memory goes back to the system.

    Workers wait for further tasks, several beside each executor, and would keep what their largest batch once took.
    """

    @functools.wraps(fn)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from fn(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
            if trim:
                trim(0)

    return run


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{folder}/{name}.parquet")


#: Rows that one block of :func:`running` holds about, and blocks that are added up together (as a power of 2).
BLOCK_ROWS, SUM_BITS = 1_000, 12


def blocks(spread: Column, rows: int) -> Column:
    """A block number for each row, rising with ``spread`` (evenly spread longs of 0 to 2^63 - 1), ~BLOCK_ROWS rows each."""
    bits = max(0, (rows // BLOCK_ROWS).bit_length())
    return F.shiftright(spread, 63 - bits) if bits else F.lit(0).cast("bigint")


def running(df: DataFrame, group: str, order: list[str], block: str, name: str, value: Column) -> DataFrame:
    """Adds the sum of ``value`` over the rows before a row, per group, in (block, order).

    Blocks are summed alone, their totals in runs of 2^SUM_BITS, and the totals of those per group, so a group that holds a third of
    all rows still is many tasks. Rows move once, by group and block, which are never null. ``df`` has the columns
    ``group`` and ``block``; ``block`` must rise with ``order``; ties in ``order`` count as equal rows, which may come either way round.
    """
    before = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(group, block).agg(F.sum(value).alias("_run_total")).withColumn("_run_part", F.shiftright(block, SUM_BITS))
    own = F.coalesce(F.sum("_run_total").over(before(group, "_run_part").orderBy(block)), F.lit(0))
    parts = totals.groupBy(group, "_run_part").agg(F.sum("_run_total").alias("_run_sum"))
    parts = parts.withColumn("_run_base", F.coalesce(F.sum("_run_sum").over(before(group).orderBy("_run_part")), F.lit(0)))
    offsets = totals.withColumn("_run_own", own).join(parts, [group, "_run_part"]).select(
        F.col(group).alias("_run_group"), F.col(block).alias("_run_block"), (F.col("_run_base") + F.col("_run_own")).alias("_run_offset"))
    rows = df.withColumn("_run_before", F.coalesce(F.sum(value).over(before(group, block).orderBy(*order)), F.lit(0)))
    meet = (F.col(group) == F.col("_run_group")) & (F.col(block) == F.col("_run_block"))
    return (
        rows.join(offsets, meet)
        .withColumn(name, (F.col("_run_before") + F.col("_run_offset")).cast("bigint"))
        .drop("_run_before", "_run_group", "_run_block", "_run_offset")
    )
