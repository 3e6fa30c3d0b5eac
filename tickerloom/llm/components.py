"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tickerloom.llm.work import discard, stage


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def _starred(links: DataFrame, larger: bool) -> tuple[DataFrame, str]:
    """Each node's neighbours are hung on its least neighbour: the larger ones, or itself and the smaller ones.

    ``links`` have a > b. The least neighbours are staged, so a node with very many links can be split in the join.
    """
    sides = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if larger else links
    least, path = stage(sides.groupBy("a").agg(F.min("b").alias("least")), "least-neighbours")
    met = sides.join(least.withColumn("least", F.least("a", "least")), "a")
    if larger:
        out = met.filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        out = met.select(F.explode(F.array(F.struct("a", F.col("least").alias("b")),
                                           F.struct(F.col("b").alias("a"), F.col("least").alias("b")))).alias("l"))
        out = out.select("l.a", "l.b")
    hung, kept = stage(out.filter("a > b").distinct(), "links")
    discard(links.sparkSession, path)
    return hung, kept


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of ``links`` (a, b; longs): the root is the least node that links reach.

    Large and small stars by turns, until no link changes; the number of rounds grows with the logarithm of the size.
    """
    ordered = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, path = stage(ordered, "links")
    before = None
    while (state := _state(now)) != before:
        before = state
        for larger in (True, False):
            hung, kept = _starred(now, larger)
            discard(links.sparkSession, path)
            now, path = hung, kept
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
