import datetime as dt

import __spark_entry__  # noqa: F401  registers the queries
import pytest
from pyspark.sql import functions as F

from tickerloom.operators import aggregates as A
from tickerloom.operators.filters import trailing_days
from tickerloom.operators.joins import orders_with_seller
from tickerloom.sources import layout as L
from tickerloom.session import LEDGER_SETTINGS
from tickerloom.sources.versions import Store
from tickerloom.testbed.registry import QUERIES
from tickerloom.testbed.views import Views

D0 = dt.date(2024, 1, 1)


def daily(spark, days=200):
    return spark.range(days * 5).select(
        F.date_add(F.lit(D0), (F.col("id") % days).cast("int")).alias("Date"), (F.col("id") % 5).cast("string").alias("Ticker"),
        F.col("id").cast("double").alias("Close"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_trailing_week_reads_its_own_days_only(spark, tmp_path):
    bars, store = daily(spark), Store(spark, str(tmp_path))
    assert L.last_day(store, "bars") is None
    L.load_by_day(store, "bars", bars, ranges=20)
    assert len(store.parts("bars")) >= 15 and L.last_day(store, "bars") == D0 + dt.timedelta(days=199)
    week = L.trailing_days(store, "bars")
    assert sorted(map(tuple, week.collect())) == sorted(map(tuple, trailing_days(bars).collect()))
    assert len(week.inputFiles()) <= 2 < len(store.read("bars").inputFiles())
    assert plan(week).count("FileScan") == 1 and "Exchange" not in plan(week)
    assert L.on_last_day(store, "bars").count() == 5
    # A later day is another part; the ranges stay as they are.
    change = store.change()
    change.append("bars", spark.createDataFrame([(D0 + dt.timedelta(days=230), "0", 1.0)], bars.schema).coalesce(1))
    change.merge("bars")
    change.commit()
    assert L.trailing_days(store, "bars").count() == 1 == len(L.trailing_days(store, "bars").inputFiles())
    store.vacuum(keep=1)
    assert Store(spark, str(tmp_path)).read("bars").count() == 1001


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("by-user"))
    n = 400
    users = spark.range(100).select(F.col("id").alias("user_id"), F.concat(F.lit("n"), "id").alias("name"), F.lit("e").alias("email"))
    orders = spark.range(n).select(F.col("id").alias("order_id"), (F.col("id") * 7 % 110).alias("user_id"), F.lit("ETH").alias("ticker"))
    tx = spark.range(n).select(
        F.col("id").alias("transaction_id"), (F.col("id") * 3 % 100).alias("user_id"), (F.col("id") % 4).alias("crypto_price_id"),
        F.lit(2).cast("decimal(18,8)").alias("number_of_coins"), F.lit(5).cast("decimal(15,8)").alias("amount"), F.lit(1).cast("decimal(15,2)").alias("cost"),
        F.when(F.col("id") % 3 == 0, "sell").otherwise("buy").alias("transaction_type"))
    plain = {"users": users, "orders": orders, "tx": tx}
    yield plain, {k: L.save_by_user(df, f"by_user_{k}", f"{path}/{k}", 8) for k, df in plain.items()}, path
    for k in plain:
        spark.sql(f"DROP TABLE IF EXISTS by_user_{k}")


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture
def joins_sort(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_joins_and_sums_by_user_move_nothing(spark, tables, joins_sort):
    plain, laid, _ = tables
    for make in (lambda t: orders_with_seller(t["orders"], t["users"]), lambda t: A.held_per_price(t["tx"]), lambda t: A.ledger_balance(t["tx"]),
                 lambda t: t["orders"].join(A.ledger_balance(t["tx"]), "user_id", "left"),
                 lambda t: A.net_coins(t["tx"], ["user_id", "crypto_price_id"]).join(t["users"], "user_id")):
        want, got = make(plain), make(laid)
        assert "Exchange" in plan(want) and "Exchange" not in plan(got)
        assert rows(got) == rows(want.select(got.columns))


def test_one_users_query_reads_one_bucket(spark, tables):
    plain, laid, _ = tables
    mine = A.held_per_price(laid["tx"].filter("user_id = 42"))
    assert "SelectedBucketsCount: 1 out of 8" in mine._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert rows(mine) == rows(A.held_per_price(plain["tx"].filter("user_id = 42")))


def test_another_session_opens_the_table(spark, tables):
    plain, _, path = tables
    other = spark.newSession()
    again = L.open_by_user(other, "opened_users", f"{path}/users", "user_id bigint, name string, email string", 8)
    assert rows(again) == rows(plain["users"])
    assert "Exchange" not in plan(again.groupBy("user_id").count())
    other.sql("DROP TABLE opened_users")


def line_items(spark, folder, orders=300, lines=6000):
    spark.range(orders).select(F.col("id").alias("o_orderkey"), (F.col("id") % 90).alias("o_custkey")).write.parquet(f"{folder}/orders.parquet")
    spark.range(lines).select(
        (F.col("id") % orders).alias("l_orderkey"), (F.col("id") * 7 % 211).alias("l_partkey"), (F.col("id") % 11).alias("l_suppkey"),
        (F.col("id") % 5).cast("int").alias("l_linenumber"), (F.col("id") % 9 + 1).cast("double").alias("l_quantity"),
        F.lit(12.5).alias("l_extendedprice"), F.lit("N").alias("l_returnflag"), F.when(F.col("id") % 2 == 0, "F").otherwise("O").alias("l_linestatus"),
        F.lit(dt.datetime(2024, 1, 1)).alias("l_shipdate")).write.parquet(f"{folder}/lineitem.parquet")


def test_buckets_grow_with_the_table(spark, tmp_path, monkeypatch):
    assert [L.buckets_for(*n) for n in ((0,), (3, 8_000_000), (8_000_001, 5), (216_000_000,))] == [16, 16, 17, 432]
    monkeypatch.setattr(L, "BUCKET_ROWS", 200)
    line_items(spark, tmp_path)
    made, save = [], L.save_by_user
    monkeypatch.setattr(L, "save_by_user", lambda rows, name, path, buckets: made.append(buckets) or save(rows, name, path, buckets))
    got = QUERIES["a2_holdings_laid_out"](spark, str(tmp_path))
    assert made == [30] and "Exchange" not in plan(got)
    assert rows(got) == rows(QUERIES["a2_holdings"](spark, str(tmp_path)).select(got.columns))


def test_a_longer_log_is_summed_in_more_parts(spark, tmp_path, monkeypatch):
    line_items(spark, tmp_path)
    spark.range(211).select(F.col("id").alias("p_partkey"), F.lit(2.0).alias("p_retailprice")).write.parquet(f"{tmp_path}/part.parquet")
    size = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1"}
    for name, value in size.items():
        monkeypatch.setitem(LEDGER_SETTINGS, name, value)
    try:
        assert len(QUERIES["a9_portfolio_total"](spark, str(tmp_path)).collect()) == 90  # applies the settings
        log = Views(spark, str(tmp_path)).transactions()
        short, whole = (A.held_per_price(tx).rdd.getNumPartitions() for tx in (log.filter("line = 0"), log))
        assert int(spark.conf.get("spark.sql.shuffle.partitions")) < whole and 3 * short < whole
    finally:
        for name in (*size, *LEDGER_SETTINGS):
            spark.conf.unset(name)
