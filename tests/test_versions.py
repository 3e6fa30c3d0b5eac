import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tickerloom.operators import ledger as M
from tickerloom.operators.book import Book
from tickerloom.sources.versions import FAN, Change, Conflict, Store

T0 = dt.datetime(2025, 1, 1)
TRADES = ("request_id bigint, request_ts timestamp, user_id bigint, crypto_price_id bigint, coins decimal(18,8), amount decimal(15,8)")
TX = ("transaction_id decimal(38,0), user_id bigint, crypto_price_id bigint, number_of_coins decimal(18,8), "
      "amount decimal(15,8), cost decimal(15,2), transaction_type string, created_at timestamp")


def days(spark, low, high, **more):
    rows = [(dt.date(2025, 1, 1) + dt.timedelta(days=i), i) for i in range(low, high)]
    return spark.createDataFrame(rows, "Date date, value int").withColumns({k: F.lit(v) for k, v in more.items()})


def values(df):
    return sorted(r.value for r in df.collect())


def test_a_change_shows_as_a_whole_and_to_later_readers_only(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.version == 0 and store.tables() == []
    with pytest.raises(KeyError):
        store.read("a")
    change = store.change()
    change.append("a", days(spark, 0, 3), "Date")
    change.replace("b", days(spark, 5, 6))
    assert Store(spark, str(tmp_path)).version == 0
    assert change.commit("feed", 7) == 1
    before = Store(spark, str(tmp_path))
    change = store.change()
    change.append("a", days(spark, 3, 5))
    change.replace("b", days(spark, 9, 9))
    change.commit()
    assert values(before.read("a")) == [0, 1, 2] and values(before.read("b")) == [5]
    after = Store(spark, str(tmp_path))
    assert values(after.read("a")) == [0, 1, 2, 3, 4] and values(after.read("b")) == []
    assert (after.version, after.applied("feed"), after.applied("other")) == (2, 7, -1)


def test_the_second_of_two_writers_fails(spark, tmp_path):
    one, two = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    changes = [s.change() for s in (one, two)]
    for i, change in enumerate(changes):
        change.append("a", days(spark, i, i + 1))
    changes[0].commit()
    with pytest.raises(Conflict):
        changes[1].commit()
    assert values(Store(spark, str(tmp_path)).read("a")) == [0]


def test_parts_are_merged_in_tiers_and_ranges_read_few_of_them(spark, tmp_path):
    count = FAN * FAN + FAN + 1
    for i in range(count):
        store = Store(spark, str(tmp_path))
        change = store.change()
        change.append("a", days(spark, 2 * i, 2 * i + 2), "Date")
        change.merge("a")
        change.commit("feed", i)
    store = Store(spark, str(tmp_path))
    tiers = [p.tier for p in store.parts("a")]
    assert len(tiers) <= 3 * (FAN - 1) and max(tiers) == 2 and sum(p.rows for p in store.parts("a")) == 2 * count
    assert values(store.read("a")) == list(range(2 * count))
    low, high = dt.date(2025, 1, 1) + dt.timedelta(days=2 * count - 3), dt.date(2025, 1, 1) + dt.timedelta(days=2 * count - 2)
    near = store.read("a", low, high)
    assert values(near) == [2 * count - 3, 2 * count - 2] and len(near.inputFiles()) < len(store.read("a").inputFiles())
    store.vacuum(keep=1)
    assert values(Store(spark, str(tmp_path)).read("a")) == list(range(2 * count))
    assert len(store._listed("parts/a")) == len(tiers) and len(store._names()) == 1


def test_merging_may_drop_what_later_parts_replace(spark, tmp_path):
    for i in range(FAN):
        store = Store(spark, str(tmp_path))
        change = store.change()
        change.append("a", days(spark, 0, 3, batch=i), "Date")
        change.merge("a", lambda rows: rows.groupBy("Date").agg(F.max("value").alias("value"), F.max("batch").alias("batch")))
        change.commit()
    store = Store(spark, str(tmp_path))
    assert {(r.value, r.batch) for r in store.read("a").collect()} == {(i, FAN - 1) for i in range(3)} and len(store.parts("a")) == 1


def trades(spark, start, count, user=1):
    rows = [(start + i, T0 + dt.timedelta(seconds=i), user, 1, Decimal(1 if i % 4 else 0), Decimal(10)) for i in range(count)]
    return spark.createDataFrame(rows, TRADES)


@pytest.fixture
def book(spark, tmp_path):
    own = Book(spark, str(tmp_path / "book"))
    own.create(wallet=spark.createDataFrame([(1, "100"), (2, "5.5")], "user_id bigint, amount string"),
               transactions=spark.createDataFrame([(Decimal(1), 1, 1, Decimal(1), Decimal(1), Decimal(1), "buy", T0)], TX))
    return own


def state(book):
    wallet = {r.user_id: Decimal(r.amount) for r in book.read("wallet").collect()}
    log = sorted((int(r.transaction_id), r.transaction_type) for r in book.read("transactions").collect())
    rejects = sorted(r.request_id for r in book.read("rejects").collect()) if "rejects" in book.store().tables() else []
    return wallet, log, rejects


def test_a_repeated_batch_changes_nothing(spark, book):
    asked = trades(spark, 10, 5)
    assert book.apply("shop", 1, M.buy, "transactions", "wallet", requests=asked)
    once = state(book)
    assert once == ({1: Decimal(70), 2: Decimal("5.5")}, [(1, "buy"), (11, "buy"), (12, "buy"), (13, "buy")], ["10", "14"])
    assert not book.apply("shop", 1, M.buy, "transactions", "wallet", requests=asked)
    assert not book.apply("shop", 0, M.buy, "transactions", "wallet", requests=asked)
    assert state(book) == once and book.store().version == 2
    assert book.apply("till", 1, M.sell, "transactions", "wallet", requests=trades(spark, 20, 2, 2).withColumnRenamed("amount", "cost"))
    assert state(book)[0] == {1: Decimal(70), 2: Decimal("15.5")}


@pytest.mark.parametrize("stop_at", [1, 2, 3])
def test_a_stop_between_two_writes_leaves_the_old_state_whole(spark, book, monkeypatch, stop_at):
    before, written = state(book), []
    plain = Change._written

    def stops(self, table, rows, tier):
        part = plain(self, table, rows, tier)
        written.append(table)
        if len(written) == stop_at:
            raise KeyboardInterrupt
        return part

    monkeypatch.setattr(Change, "_written", stops)
    with pytest.raises(KeyboardInterrupt):
        book.apply("shop", 1, M.buy, "transactions", "wallet", requests=trades(spark, 10, 5))
    assert written[:1] == ["wallet"] and state(book) == before and book.store().version == 1
    monkeypatch.setattr(Change, "_written", plain)
    assert book.apply("shop", 1, M.buy, "transactions", "wallet", requests=trades(spark, 10, 5))
    assert state(book)[0] == {1: Decimal(70), 2: Decimal("5.5")}
    store = book.store()
    store.vacuum(keep=1)
    assert {t: len(store._listed(f"parts/{t}")) for t in store.tables()} == {t: len(store.parts(t)) for t in store.tables()}
    assert state(book)[0] == {1: Decimal(70), 2: Decimal("5.5")}


def test_batches_of_all_kinds_equal_one_whole_batch(spark, tmp_path, book):
    """The log is appended to, rewritten and merged; what comes out is what the operators give in a row."""
    rng = random.Random(4)
    tx, wallet = book.read("transactions"), book.read("wallet")
    for number in range(6):
        asked = trades(spark, 100 * (number + 1), rng.randrange(1, 6), rng.choice([1, 2]))
        if number % 3 == 2:
            asked = asked.withColumnRenamed("amount", "cost")
        kind = M.sell if number % 3 == 2 else M.buy
        done = kind(tx, wallet, asked)
        tx, wallet = done.transactions, done.wallet
        assert book.apply("feed", number, kind, "transactions", "wallet", requests=asked)
    assert state(book)[0] == {r.user_id: r.amount for r in wallet.collect()}
    assert state(book)[1] == sorted((int(r.transaction_id), r.transaction_type) for r in tx.collect())
    assert len(book.store().parts("transactions")) < 6
