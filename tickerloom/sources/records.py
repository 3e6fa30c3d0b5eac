"""CSV records with line breaks in quoted fields, read by as many tasks as the file has blocks.

Whether a line begins a record depends on all lines before it: a quote may have been opened in any of them. A line changes what
follows in one of few ways, told by where it ends if it begins outside of quotes and if it begins inside. Such functions of two
states can be put together in any grouping, so

1. every task puts together those of its block's lines (one small row for each batch of lines),
2. a scan over these rows gives each block the state it begins with,
3. blocks that begin outside and never open a quote that their line does not close (nearly all) have a record a line; the lines
   of the others get their state within their block, and those of one record are joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tickerloom.session import staged

# A field that ends on its line, and lines of such fields that begin outside or inside of quotes.
_FIELD = r'(?:"(?:[^"]++|"")*+"[^,]*+|(?!")[^,]*+)'
_ENDS_OUTSIDE = rf"(?s)^{_FIELD}(?:,{_FIELD})*+$"
_LEAVES_QUOTES = rf'(?s)^(?:[^"]++|"")*+"[^,]*+(?:,{_FIELD})*+$'
BLOCK = ["file", "block"]
_SEGMENTS = "file string, block bigint, seq bigint, out0 int, out1 int, opens boolean"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their file and block, their order (at), and where they end if they begin outside (out0) or inside (out1) of quotes."""
    raw = spark.read.text(path, lineSep="\n").select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"))
    quoted = F.col("value").contains('"')
    return raw.withColumns({
        "out0": F.when(quoted & ~F.col("value").rlike(_ENDS_OUTSIDE), 1).otherwise(0),
        "out1": F.when(quoted & F.col("value").rlike(_LEAVES_QUOTES), 0).otherwise(1),
    })


def _put_together(out0: np.ndarray, out1: np.ndarray) -> tuple[int, int]:
    """Where lines in a row end that begin outside, and inside."""
    same = np.flatnonzero(out0 == out1)
    after = same[-1] + 1 if len(same) else 0
    swaps = int(((out0[after:] == 1) & (out1[after:] == 0)).sum()) % 2
    begin = (int(out0[after - 1]),) * 2 if len(same) else (0, 1)
    return begin[0] ^ swaps, begin[1] ^ swaps


def _segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seq = 0
    for lines in batches:
        out = []
        for (file, block), own in lines.groupby(["file", "block"], sort=False):
            out0, out1 = own["out0"].to_numpy(), own["out1"].to_numpy()
            out.append((file, block, seq, *_put_together(out0, out1), bool(out0.any())))
            seq += 1
        yield pd.DataFrame(out, columns=["file", "block", "seq", "out0", "out1", "opens"])


def _with_state(rows: DataFrame, start: Column, keys: list[str], order: list[str]) -> DataFrame:
    """Adds the state before each row. The last row before it that ends alike however it begins tells it, turned over by each
    row since that swaps the states; without one it is ``start``, turned over by all."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    swap = (F.col("out0") > F.col("out1")).cast("int")
    rows = rows.withColumn("_swaps", F.coalesce(F.sum(swap).over(before), F.lit(0)))
    sure = F.when(F.col("out0") == F.col("out1"), F.struct(F.col("out0").alias("state"), F.col("_swaps").alias("swaps")))
    rows = rows.withColumn("_known", F.last(sure, ignorenulls=True).over(before))
    turned = F.coalesce(F.col("_known.state"), start) + F.col("_swaps") - F.coalesce(F.col("_known.swaps"), F.lit(0))
    return rows.withColumn("state", F.pmod(turned, F.lit(2))).drop("_swaps", "_known")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """file, block, at (the place of the record's first line) and record: the records of quoted CSV files, without empty lines."""
    lines = _lines(spark, path)
    segments, _ = staged(lines.select(*BLOCK, "out0", "out1").mapInPandas(_segments, _SEGMENTS), "quote-segments")
    # One row for each batch of lines; a file's are scanned together.
    scanned = _with_state(segments, F.lit(0), ["file"], ["block", "seq"])
    blocks = scanned.groupBy(*BLOCK).agg(F.min_by("state", "seq").alias("start"), F.max("opens").alias("opens"))
    blocks, _ = staged(blocks.withColumn("plain", (F.col("start") == 0) & ~F.col("opens")), "quote-blocks")
    placed = lines.join(blocks.select(*BLOCK, "start", "plain"), BLOCK)
    whole = placed.filter("plain").select(*BLOCK, "at", F.col("value").alias("record"))
    within = _with_state(placed.filter("NOT plain"), F.col("start"), BLOCK, ["at"])
    count = Window.partitionBy(*BLOCK).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    numbered = within.withColumn("n", F.sum((F.col("state") == 0).cast("int")).over(count))
    numbered, _ = staged(numbered.select(*BLOCK, "at", "n", "value"), "quoted-lines")
    # Lines before a block's first record belong to the last one of the blocks before.
    last = numbered.groupBy(*BLOCK).agg(F.max("n").alias("n"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.withColumn("from", F.last(F.when(F.col("n") > 0, F.struct("block", "n")), True).over(earlier)).select(*BLOCK, "from")
    owned = numbered.join(carried, BLOCK).withColumn(
        "own", F.when(F.col("n") > 0, F.struct("block", "n")).otherwise(F.col("from")))
    joined = owned.groupBy("file", "own").agg(F.sort_array(F.collect_list(F.struct("block", "at", "value"))).alias("parts"))
    several = joined.select("file", F.col("parts")[0]["block"].alias("block"), F.col("parts")[0]["at"].alias("at"),
                            F.concat_ws("\n", "parts.value").alias("record"))
    every = whole.unionByName(several)
    return every.withColumn("record", F.regexp_replace("record", r"\r$", "")).filter(F.trim("record") != "")


def read_quoted(spark: SparkSession, path: str, schema: str, **options) -> DataFrame:
    """Quoted CSV files with a header and line breaks inside of quotes; the first record of each file is its header."""
    records = read_records(spark, path)
    first = records.groupBy("file").agg(F.min(F.struct("block", "at")).alias("head"))
    body = records.join(first, "file").filter(F.struct("block", "at") != F.col("head"))
    told = {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items() if k != "header"}
    return body.select(F.from_csv("record", F.lit(schema), told).alias("r")).select("r.*")
