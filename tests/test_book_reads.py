from decimal import Decimal

from pyspark.sql import functions as F

from tests.test_ledger import at
from tickerloom.operators import ledger as M
from tickerloom.operators.book import Book
from tickerloom.session import work_path

LOG = ("transaction_id decimal(38,0), user_id bigint, crypto_price_id bigint, number_of_coins decimal(18,8), amount decimal(18,8), "
       "cost decimal(18,8), transaction_type string, created_at timestamp")


def test_a_book_and_its_batches_read_their_input_once(spark, tmp_path):
    """What makes the log and the requests is run once, however many tables an outcome has."""
    runs = spark.sparkContext.accumulator(0)

    @F.udf("bigint")
    def counted(x):
        runs.add(1)
        return x

    own = counted.asNondeterministic()
    log = spark.createDataFrame([(Decimal(i), i % 3, 1, Decimal(2), Decimal(4), Decimal(2), "buy", at(i)) for i in range(6)], LOG)
    book = Book(spark, work_path(spark, "book"))
    book.create(wallet=spark.createDataFrame([(1, "5")], "user_id bigint, amount string"), transactions=log.withColumn("user_id", own("user_id")))
    assert runs.value == 6
    asked = spark.createDataFrame([(Decimal(100 + i), at(i), i % 3, 1, Decimal(i), Decimal(4)) for i in range(4)],
                                  "request_id decimal(38,0), request_ts timestamp, user_id bigint, crypto_price_id bigint, coins decimal(18,8), amount decimal(18,8)")
    book.apply("trades", 1, M.buy, "transactions", "wallet", requests=asked.withColumn("user_id", own("user_id")))
    assert runs.value == 10
    assert {r.user_id: r.bought for r in book.held().collect()} == {0: Decimal(7), 1: Decimal(5), 2: Decimal(6)}
    assert book.read("rejects").count() == 1
