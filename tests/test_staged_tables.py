import time
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests import test_ledger as ledger, test_settlement as settlements
from tickerloom import session
from tickerloom.operators import ledger as M, settlement


def left(spark, run):
    """Names of the staged tables that are there after ``run`` and were not before."""
    tables = lambda: {p.parent for p in Path(session.shared_dir(spark)).rglob("_SUCCESS")}
    before = tables()
    run()
    return {p.name: str(p) for p in tables() - before}


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle")}


def test_shuffle_files_go_once_a_table_is_written(spark):
    before = shuffle_files(spark)
    table, _ = session.staged(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    until = time.time() + 20
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before and table.count() == 7
    assert spark.conf.get(session.CLEANUP) == "false"


def test_parts_hold_each_key_once(spark, monkeypatch):
    monkeypatch.setattr(session, "PART_ROWS", 10)
    rows = spark.range(101).select(F.when(F.col("id") % 5 > 0, F.col("id") % 20).alias("key"), "id")
    own = session.in_parts(101, "key")
    table, _ = session.staged_parts([rows.filter(x).coalesce(1) for x in own], "parts")
    assert len(own) == 11 and sorted(r.id for r in table.collect()) == list(range(101))
    assert table.withColumn("part", F.input_file_name()).groupBy("key").agg(F.countDistinct("part").alias("n")).filter("n > 1").isEmpty()


@pytest.mark.parametrize("by_payer", [0, 10**9])
def test_settlement_writes_requests_once(spark, monkeypatch, by_payer):
    monkeypatch.setattr(settlement, "BY_PAYER", by_payer)
    requests, held = settlements.batch(21, 200, 30)
    frame, wallet = spark.createDataFrame(requests, ledger.SETTLE), spark.createDataFrame(list(held.items()), settlements.BALANCE)
    got = {}
    there = left(spark, lambda: got.update({r.request_id: r.accepted for r in settlement.settle(frame, wallet, 50).collect()}))
    assert got == ledger.in_turn(requests, held) and 0 < sum(got.values()) < 200
    assert set(there) == {"requests", "accepted-rows"}


def test_many_marks_find_their_rows(spark):
    """Rows of many tasks, of frames written after one another."""
    rows = spark.range(0, 100_000, 1, 5).withColumn("n", F.monotonically_increasing_id() + F.lit(3 << 52))
    marks = settlement.bits(rows.filter("id % 7 = 3 OR id > 90000"), "n")
    for count in (100_000, settlement.MOST_BITS):
        found = settlement.marked_by(rows, "n", marks, count)
        assert found.filter("_marked <> (id % 7 = 3 OR id > 90000)").isEmpty() and found.filter("_marked").count() > 10_000


def test_settle_p2p_writes_no_terms(spark, monkeypatch):
    plain = settlement._by_payer
    monkeypatch.setattr(settlement, "BY_PAYER", 0)
    rounds = []
    monkeypatch.setattr(settlement, "_by_payer", lambda *a: rounds.append(1) or plain(*a))
    orders = spark.createDataFrame([(10, 2, "ETH", Decimal(5), "Wallet", "pending", ledger.T0, None)], ledger.ORDERS)
    price = spark.createDataFrame([(1, "ETH", "5")], "crypto_price_id bigint, ticker string, current_price string")
    asked = spark.createDataFrame([(i, ledger.at(i), 1, 10 + i // 3) for i in range(4)], "request_id bigint, request_ts timestamp, buyer_id bigint, order_id bigint")
    tx = spark.createDataFrame([ledger.tx(1, 1, 2, 4, 40)], ledger.TX)
    out = []
    there = left(spark, lambda: out.append(M.settle_p2p(orders, tx, ledger.wallet(spark, {1: "5"}), price, asked)))
    assert set(there) == {"requests", "accepted-rows"} and rounds
    kept = set(spark.read.parquet(there["requests"]).columns)
    assert kept == {*asked.columns, "seller_id", "ticker", "price", "payment_mode", settlement.ROW}
    assert {r.request_id: r.reject_reason for r in out[0].rejects.collect()} == dict.fromkeys((1, 2, 3), "order not found")
    assert out[0].orders.isEmpty()


def test_list_or_buy_in_parts(spark, monkeypatch):
    monkeypatch.setattr(session, "PART_ROWS", 20)
    there = left(spark, lambda: ledger.test_list_or_buy_equals_one_by_one(spark, 1))
    assert set(there) == {"requests", "accepted-rows", "listed-last", "completed-rows"}


@pytest.mark.parametrize("size", [None, 7])
def test_swaps_in_parts(spark, monkeypatch, size):
    monkeypatch.setattr(session, "PART_ROWS", 20)
    there = left(spark, lambda: ledger.test_swaps_equal_one_by_one(spark, monkeypatch, 1, size))
    assert set(there) == {"swapped", "unswapped"}
