import zlib

import pytest
from pyspark.sql import functions as F

from tickerloom.llm import sharding as S, work
from tickerloom.llm.queries import op6


def held(rows, shards):
    """Checks what every sharding must hold; the bytes of each shard."""
    sums, slots = [0] * shards, [[] for _ in range(shards)]
    for r in rows:
        sums[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    return sums


def test_one_text_holding_a_third_of_the_rows_is_cut(spark, docs, monkeypatch):
    monkeypatch.setattr(work, "BLOCK_ROWS", 50)
    texts = ["the same text " * 3] * 700 + [f"text {i} " + "x" * (i % 90) for i in range(1400)]
    placed = S.shard_by_bytes(docs(*texts), 8).collect()
    sums = held(placed, 8)
    assert max(sums) - min(sums) < 0.02 * sum(sums) / 8 + 2 * max(r.size for r in placed)
    small = {}
    for r in placed:
        if r.text != texts[0]:
            small.setdefault(r.text, set()).add(r.shard)
    assert all(len(s) == 1 for s in small.values())
    assert len({r.shard for r in placed if r.text == texts[0]}) >= 3


def test_shards_follow_the_key(spark, docs):
    placed = S.shard_by_bytes(docs(*[f"t{i % 300}" for i in range(900)]), 5)
    ranges = placed.withColumn("key", F.shiftrightunsigned(F.xxhash64("text"), 1)).groupBy("shard").agg(
        F.min("key").alias("lo"), F.max("key").alias("hi")).orderBy("shard").collect()
    assert all(a.hi < b.lo for a, b in zip(ranges, ranges[1:], strict=False))


@pytest.mark.parametrize("shards", [1, 3, 24])
def test_cases(spark, docs, shards):
    rows = docs((1, None), (2, ""), (3, "é" * 100_000), (4, "a"), (4, "a"), (None, "b"), (None, None))
    rows = rows.withColumns({"shard": F.lit("old"), "slot": F.lit("old"), "size": F.lit("old"), "_key": F.lit(1)})
    placed = S.shard_by_bytes(rows, shards).collect()
    held(placed, shards)
    assert sorted((r.doc_id or 0, r.size) for r in placed) == [(0, 8), (0, 9), (1, 8), (2, 8), (3, 200_008), (4, 9), (4, 9)]
    assert S.shard_by_bytes(rows.limit(0), shards).count() == 0


def test_query(spark, folder):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = op6(spark, folder)
    assert "Python" not in got._jdf.queryExecution().toString()
    rows = got.collect()
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {
        i: (len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t in texts.items()}
    sums = held(rows, 24)
    mean, largest = sum(sums) / 24, max(r.size for r in rows)
    assert all(abs(s - mean) <= largest + 0.01 * mean for s in sums)
    assert {(r.law, r.grown_shard) for r in rows} == {("bytes", None)}
