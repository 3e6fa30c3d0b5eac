import datetime as dt
import random
from decimal import Decimal

import pytest

from tickerloom.operators import aggregates as A, ledger as M
from tickerloom.operators.book import Book
from tickerloom.plans import portfolio as P

T0 = dt.datetime(2025, 1, 1)
TX = ("transaction_id decimal(38,0), user_id bigint, crypto_price_id bigint, number_of_coins decimal(18,8), "
      "amount decimal(15,8), cost decimal(15,2), transaction_type string, created_at timestamp")
ORDERS = ("order_id bigint, user_id bigint, ticker string, price decimal(15,8), payment_mode string, status string, "
          "created_at timestamp, transaction_id decimal(38,0)")
TRADES = "request_id decimal(38,0), request_ts timestamp, user_id bigint, crypto_price_id bigint, coins decimal(18,8), amount decimal(15,8)"
LISTED = "request_id decimal(38,0), request_ts timestamp, buyer_id bigint, transaction_id decimal(38,0), payment_type string"
LISTS = ("request_id decimal(38,0), request_ts timestamp, user_id bigint, transaction_id decimal(38,0), ticker string, "
         "price decimal(15,8), payment_mode string")
SWAPS = ("request_id decimal(38,0), request_ts timestamp, user_id bigint, from_coin bigint, to_coin bigint, from_qty decimal(18,8), "
         "from_price decimal(18,8), to_price decimal(18,8)")


def at(i):
    return T0 + dt.timedelta(seconds=i)


@pytest.fixture
def book(spark, tmp_path):
    rng = random.Random(1)
    log = [(Decimal(i), rng.randrange(1, 5), rng.randrange(1, 4), Decimal(rng.randrange(1, 9)), Decimal(rng.randrange(1, 50)),
            Decimal(rng.randrange(1, 20)), rng.choice(["buy", "buy", "sell", "p2p-sell", "p2p-buy"]), T0) for i in range(1, 40)]
    own = Book(spark, str(tmp_path / "book"))
    own.create(
        wallet=spark.createDataFrame([(u, "500") for u in range(1, 5)], "user_id bigint, amount string"),
        transactions=spark.createDataFrame(log, TX), orders=spark.createDataFrame([], ORDERS),
        price=spark.createDataFrame([(1, "BTC", "3", "USD"), (2, "ETH", "2", "USD"), (3, "ETH", "x", "USD")],
                                    "crypto_price_id bigint, ticker string, current_price string, fiat_currency string"))
    return own


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def check(book):
    log, price = book.read("transactions"), book.read("price")
    assert rows(book.held()) == rows(A.held_per_price(log).select(book.held().columns))
    assert rows(book.balances()) == rows(A.ledger_balance(log))
    assert rows(P.portfolio(None, price, held=book.held())) == rows(P.portfolio(log, price))
    assert rows(P.sellable(None, price, 2, book.held())) == rows(P.sellable(log, price, 2))


@pytest.mark.parametrize("seed", range(2))
def test_kept_sums_equal_a_full_recompute(spark, book, seed):
    """Batches that add, re-type and swap rows, in random order."""
    rng = random.Random(seed)
    check(book)
    for number in range(6):
        ids = [int(r.transaction_id) for r in book.read("transactions").collect()]
        base, one = 1000 * (number + 1), Decimal(1)
        kind = number % 5 if seed else rng.choice([0, 2, 3, 4])
        pick = lambda: Decimal(rng.choice(ids))
        if kind in (0, 1):
            asked = spark.createDataFrame([(Decimal(base + i), at(i), rng.randrange(1, 6), rng.randrange(1, 4), Decimal(rng.randrange(0, 5)),
                                            Decimal(rng.randrange(1, 9))) for i in range(6)], TRADES)
            operator, names = (M.buy if kind == 0 else M.sell), ("transactions", "wallet")
            asked = asked if kind == 0 else asked.withColumnRenamed("amount", "cost")
        elif kind == 2:
            asked = spark.createDataFrame([(Decimal(base + i), at(i), rng.randrange(1, 6), pick(), rng.choice(["wallet", "card"])) for i in range(5)], LISTED)
            operator, names = M.buy_listed, ("transactions", "wallet", "price")
        elif kind == 3:
            asked = spark.createDataFrame([(Decimal(base + i), at(i), rng.randrange(1, 5), pick(), "ETH", Decimal(rng.randrange(1, 6)),
                                            rng.choice(["Wallet", "Bank"])) for i in range(12)], LISTS)
            operator, names = M.list_or_buy, ("orders", "transactions", "wallet")
        else:
            asked = spark.createDataFrame([(Decimal(base + i), at(i), rng.randrange(1, 5), rng.randrange(1, 4), rng.randrange(1, 4), one, one, one)
                                           for i in range(8)], SWAPS)
            operator, names = M.swap, ("transactions",)
        assert book.apply("feed", number, operator, *names, requests=asked)
        assert not book.apply("feed", number, operator, *names, requests=asked)
        check(book)
    assert len(book.store().parts("held")) < 7


def test_a_batch_that_adds_rows_reads_no_others(spark, book):
    from tickerloom.operators.balances import deltas

    asked = spark.createDataFrame([(Decimal(500), T0, 1, 1, Decimal(2), Decimal(3))], TRADES)
    log = book.read("transactions")
    done = M.buy(log, book.read("wallet"), asked)
    assert deltas(done.logged, done.retracted, done.transactions, 1).inputFiles() == [] != log.inputFiles()
    assert deltas(done.logged, None, done.transactions, 1).count() == 1
    assert not set(book.held().inputFiles()) & set(log.inputFiles())
