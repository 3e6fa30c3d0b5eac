import datetime as dt
import random
import time
from collections import defaultdict
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tickerloom.operators import ledger as M

T0 = dt.datetime(2025, 1, 1)
TX = ("transaction_id decimal(38,0), user_id bigint, crypto_price_id bigint, number_of_coins decimal(18,8), "
      "amount decimal(15,8), cost decimal(15,2), transaction_type string, created_at timestamp")
ORDERS = ("order_id bigint, user_id bigint, ticker string, price decimal(15,8), payment_mode string, status string, "
          "created_at timestamp, transaction_id decimal(38,0)")
P2P = "request_id decimal(38,0), request_ts timestamp, buyer_id bigint, order_id bigint"
LISTS = ("request_id decimal(38,0), request_ts timestamp, user_id bigint, transaction_id decimal(38,0), ticker string, "
         "price decimal(15,8), payment_mode string")


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def wallet(spark, amounts):
    return spark.createDataFrame([(u, a) for u, a in amounts.items()], "user_id bigint, amount string")


def amounts(df):
    return {r.user_id: r.amount for r in df.collect()}


def tx(n, user, coin, coins, amount, kind="buy", cost="1"):
    return (Decimal(n), user, coin, Decimal(coins), Decimal(amount), Decimal(cost), kind, T0)


@pytest.fixture(scope="module")
def price(spark):
    rows = [(1, "BTC", "100", "USD"), (2, "ETH", "10", "USD"), (3, "ETH", "11", "USD")]
    return spark.createDataFrame(rows, "crypto_price_id bigint, ticker string, current_price string, fiat_currency string")


def test_deposit_creates_missing_wallets_and_reads_text(spark):
    req = spark.createDataFrame([(1, 1, 5.0), (2, 1, 2.5), (3, 9, 1.0), (4, 1, -3.0)], "request_id bigint, user_id bigint, amount double")
    out = M.deposit(wallet(spark, {1: "10.5", 2: "abc"}), req)
    assert amounts(out.wallet) == {1: Decimal(18), 2: Decimal(0), 9: Decimal(1)}
    assert [r.request_id for r in out.rejects.collect()] == [4]


def test_withdraw_without_and_with_floor(spark):
    req = spark.createDataFrame(
        [(1, at(1), 1, Decimal(6)), (2, at(2), 1, Decimal(6)), (3, at(3), 1, Decimal(4)), (4, at(1), 2, Decimal(1))],
        "request_id bigint, request_ts timestamp, user_id bigint, amount decimal(18,8)",
    )
    held = wallet(spark, {1: "10"})
    assert amounts(M.withdraw(held, req).wallet) == {1: Decimal(-6), 2: Decimal(-1)}
    floored = M.withdraw(held, req, floor=True)
    assert amounts(floored.wallet) == {1: Decimal(0)}
    assert sorted(r.request_id for r in floored.rejects.collect()) == [2, 4]


def test_buy_and_sell(spark):
    log = spark.createDataFrame([], TX)
    req = spark.createDataFrame(
        [(1, at(1), 1, 1, Decimal(4), Decimal(10)), (2, at(2), 1, 1, Decimal(0), Decimal(10))],
        "request_id bigint, request_ts timestamp, user_id bigint, crypto_price_id bigint, coins decimal(18,8), amount decimal(15,8)",
    )
    out = M.buy(log, wallet(spark, {1: "3"}), req)
    row = out.transactions.collect()[0]
    assert (row.cost, row.amount, row.transaction_type) == (Decimal("2.5"), Decimal(10), "buy")
    assert amounts(out.wallet) == {1: Decimal(-7)}
    assert out.rejects.count() == 1
    sold = M.sell(log, wallet(spark, {1: "3"}), req.withColumnRenamed("amount", "cost"))
    assert amounts(sold.wallet) == {1: Decimal(43)}
    assert sold.transactions.collect()[0].amount == Decimal(40)


def test_buy_listed(spark, price):
    log = spark.createDataFrame([tx(1, 5, 3, 2, 9, "p2p-sell"), tx(2, 6, 1, 1, 9)], TX)
    req = spark.createDataFrame(
        [(11, at(1), 7, Decimal(1), "wallet"), (12, at(2), 5, Decimal(1), "wallet"), (13, at(3), 7, Decimal(99), "wallet"), (14, at(4), 8, Decimal(2), "bank")],
        "request_id bigint, request_ts timestamp, buyer_id bigint, transaction_id decimal(38,0), payment_type string",
    )
    out = M.buy_listed(log, wallet(spark, {5: "0"}), price, req)
    rows = {int(r.transaction_id): r for r in out.transactions.collect()}
    assert rows[1].transaction_type == "sell" and rows[2].transaction_type == "sell"
    # The coin of the new row is the ticker's least price id; the cost is the total.
    assert (rows[11].crypto_price_id, rows[11].cost, rows[11].user_id) == (2, Decimal(22), 7)
    assert rows[14].cost == Decimal(100)
    assert amounts(out.wallet) == {5: Decimal(0), 7: Decimal(-22)}
    assert {r.request_id: r.reject_reason for r in out.rejects.collect()} == {12: "own order", 13: "transaction not found"}


def one_by_one(orders, held, requests):
    """The settlement as a loop."""
    book, balance, outcome = dict(orders), defaultdict(Decimal, held), {}
    for rid, _ts, buyer, oid in sorted(requests, key=lambda r: (r[1], r[0])):
        if oid not in book:
            outcome[rid] = "order not found"
            continue
        seller, cost, mode = book[oid]
        if seller == buyer:
            outcome[rid] = "own order"
        elif mode == "Wallet" and balance[buyer] < cost:
            outcome[rid] = "insufficient balance"
        else:
            if mode == "Wallet":
                balance[buyer] -= cost
                balance[seller] += cost
            del book[oid]
            outcome[rid] = None
    return outcome, balance, book


@pytest.mark.parametrize("seed", range(4))
def test_p2p_settlement_equals_one_by_one(spark, price, seed):
    rng = random.Random(seed)
    users = list(range(1, 8))
    held = {u: Decimal(rng.randrange(-5, 60)) for u in users if u != 3}
    orders = {i: (rng.choice(users), Decimal(rng.randrange(1, 40)), rng.choice(["Wallet", "Wallet", "Bank"])) for i in range(40)}
    # User 1 asks for a third of everything; some times are equal, so request ids decide.
    requests = [
        (Decimal(i), at(rng.randrange(60)), 1 if rng.random() < 0.33 else rng.choice(users), rng.randrange(45)) for i in range(1, 150)
    ]
    rows = [(i, s, "ETH", p, m, "pending", T0, None) for i, (s, p, m) in orders.items()]
    log = spark.createDataFrame([], TX)
    out = M.settle_p2p(
        spark.createDataFrame(rows, ORDERS), log, wallet(spark, {u: str(a) for u, a in held.items()}), price,
        spark.createDataFrame(requests, P2P),
    )
    outcome, balance, book = one_by_one(orders, held, requests)
    rejects = {r.request_id: r.reject_reason for r in out.rejects.collect()}
    assert rejects == {k: v for k, v in outcome.items() if v}
    got = amounts(out.wallet)
    assert {u: a for u, a in got.items() if a} == {u: a for u, a in balance.items() if a}
    assert sum(got.values()) == sum(held.values())
    assert {r.order_id for r in out.orders.collect()} == set(book)
    logged = out.transactions.groupBy("transaction_type").count().collect()
    won = [r for r in requests if outcome[r[0]] is None]
    by_wallet = [r for r in won if orders[r[3]][2] == "Wallet"]
    assert {r.transaction_type: r["count"] for r in logged} == {
        k: n for k, n in (("buy", len(won)), ("p2p-sell", len(by_wallet))) if n
    }


def test_p2p_edge_cases(spark, price):
    orders = [(1, 5, "ETH", Decimal(10), "Wallet", "pending", T0, None), (2, 5, "DOGE", Decimal(10), "Bank", "pending", T0, None)]
    requests = [(Decimal(1), at(1), 6, 1), (Decimal(2), at(2), 7, 1), (Decimal(3), at(3), 8, 1), (Decimal(4), at(0), 5, 2), (Decimal(5), at(5), 9, 2)]
    out = M.settle_p2p(
        spark.createDataFrame(orders, ORDERS), spark.createDataFrame([], TX), wallet(spark, {6: "9.99", 7: "10"}), price,
        spark.createDataFrame(requests, P2P),
    )
    assert {int(r.request_id): r.reject_reason for r in out.rejects.collect()} == {
        1: "insufficient balance", 3: "order not found", 4: "own order",
    }
    assert amounts(out.wallet) == {5: Decimal(10), 6: Decimal("9.99"), 7: Decimal(0), 9: Decimal(0)}
    assert {r.crypto_price_id for r in out.transactions.collect()} == {2, None}


SETTLE = ("request_ts timestamp, request_id bigint, payer bigint, payee bigint, debit decimal(30,8), credit decimal(30,8), "
          "checked boolean, item string, blocked string")


def in_turn(requests, held):
    """The settlement as a loop; requests are in order."""
    left, taken, out = dict(held), set(), {}
    for _, rid, payer, payee, debit, credit, checked, item, _ in requests:
        good = item not in taken and (not checked or left.get(payer, Decimal(0)) >= debit)
        out[rid] = good
        if good:
            taken |= {item} - {None}
        if good and checked:
            left[payer] = left.get(payer, Decimal(0)) - debit
            left[payee] = left.get(payee, Decimal(0)) + credit
    return out


@pytest.mark.parametrize("slice_rows, most_rounds", [(10, 21), (10_000, 1)])
def test_settlement_in_slices_equals_one_by_one(spark, monkeypatch, slice_rows, most_rounds):
    """Payments to and fro, items that several want, one account in every payment."""
    from tickerloom.operators import settlement

    rng, rounds = random.Random(5), []
    plain = settlement._round
    monkeypatch.setattr(settlement, "_round", lambda *a: rounds.append(1) or plain(*a))
    requests = []
    for i in range(200):
        payer, payee = (1, 2) if i % 2 else (2, 1)
        if i % 5 == 0:
            payer, payee = rng.choice([3, 4]), 1
        price = Decimal(rng.choice([100, 100, 7, 60]))
        requests.append((at(i // 3), i, payer, payee, price, price, i % 11 != 0, rng.choice([None, f"i{i % 23}"]), None))
    held = {1: Decimal(100), 3: Decimal(40)}
    frame = spark.createDataFrame(requests, SETTLE).repartition(3)
    wallet = spark.createDataFrame(list(held.items()), "user_id bigint, balance decimal(38,8)")
    got = {r.request_id: r.accepted for r in settlement.settle(frame, wallet, slice_rows).collect()}
    assert got == in_turn(requests, held)
    assert 1 <= len(rounds) <= most_rounds


@pytest.mark.parametrize("window", [64, 3])
def test_rounds_do_not_grow_with_the_batch_for_random_pairs(spark, monkeypatch, window):
    """Accounts grow with the batch: far fewer rounds than slices, and the outcome of one after another."""
    from tickerloom.operators import settlement

    rng, rounds = random.Random(7), []
    plain = settlement._round
    monkeypatch.setattr(settlement, "_round", lambda *a: rounds.append(len(a[2])) or plain(*a))
    monkeypatch.setattr(settlement, "WINDOW", window)
    n, accounts, size = 6_000, 1_500, 250
    requests = []
    for i in range(n):
        price = Decimal(rng.randrange(1, 10_000)) / 100
        item = f"i{rng.randrange(n)}" if i % 3 else None
        requests.append((at(i // 5), i, rng.randrange(accounts), rng.randrange(accounts), price, price, i % 9 != 0, item, None))
    held = {a: Decimal(rng.randrange(0, 20_000)) / 100 for a in range(accounts)}
    wallet = spark.createDataFrame(list(held.items()), "user_id bigint, balance decimal(38,8)")
    got = settlement.settle(spark.createDataFrame(requests, SETTLE), wallet, size).collect()
    assert {r.request_id: r.accepted for r in got} == in_turn(requests, held)
    slices = rounds[0]
    assert slices >= 20 and len(rounds) <= (slices // 2 if window > slices else slices)
    assert sum(rounds) <= slices * len(rounds) // 2 + slices


def test_amounts_finer_than_cents_and_too_large_for_64_bits(spark):
    from tickerloom.operators import settlement

    for scale in (Decimal("0.00000001"), Decimal("1e17")):
        rng = random.Random(3)
        requests = [(at(i), i, rng.randrange(4), rng.randrange(4), rng.randrange(1, 30) * scale, rng.randrange(1, 30) * scale, True, None, None)
                    for i in range(80)]
        held = {a: 40 * scale for a in range(3)}
        wallet = spark.createDataFrame(list(held.items()), "user_id bigint, balance decimal(38,8)")
        got = settlement.settle(spark.createDataFrame(requests, SETTLE), wallet, 30).collect()
        assert {r.request_id: r.accepted for r in got} == in_turn(requests, held)


def test_a_long_chain_is_one_round_a_slice(spark):
    """Two accounts pass the same money to and fro ten thousand times."""
    from tickerloom.operators import settlement

    price = Decimal(100)
    requests = [(at(i), i, 1 + i % 2, 2 - i % 2, price, price, True, None, None) for i in range(10_000)]
    wallet = spark.createDataFrame([(1, price)], "user_id bigint, balance decimal(38,8)")
    started = time.time()
    done = settlement.settle(spark.createDataFrame(requests, SETTLE), wallet, 4000).collect()
    assert all(r.accepted for r in done) and time.time() - started < 60


@pytest.mark.parametrize("seed", range(2))
def test_list_or_buy_equals_one_by_one(spark, seed):
    rng = random.Random(seed)
    users = [1, 2, 3, 4]
    owner = {i: rng.choice(users) for i in range(1, 13)}
    coins = {i: rng.randrange(1, 4) for i in owner}
    held = {u: Decimal(rng.randrange(0, 60)) for u in users[:3]}
    requests = [
        (Decimal(100 + i), at(rng.randrange(50)), rng.choice(users), Decimal(rng.randrange(1, 14)), "ETH", Decimal(rng.randrange(0, 12)), rng.choice(["Wallet", "Bank"]))
        for i in range(60)
    ]
    log = spark.createDataFrame([tx(i, owner[i], 2, coins[i], 7) for i in owner], TX)
    old = [(900 + i, owner[i], "ETH", Decimal(5), "Bank", "pending", T0, Decimal(i)) for i in (1, 2)]
    out = M.list_or_buy(
        spark.createDataFrame(old, ORDERS), log, wallet(spark, {u: str(a) for u, a in held.items()}), spark.createDataFrame(requests, LISTS)
    )
    balance, kind, amount, cost = defaultdict(Decimal, held), {i: "buy" for i in owner}, {i: Decimal(7) for i in owner}, {i: Decimal(1) for i in owner}
    orders, rejects = {Decimal(900 + i): [Decimal(i), "pending"] for i in (1, 2)}, {}
    for rid, _ts, user, tid, _t, price, mode in sorted(requests, key=lambda r: (r[1], r[0])):
        if price <= 0:
            rejects[rid] = "price"
        elif tid not in owner:
            rejects[rid] = "transaction not found"
        elif owner[tid] == user:
            kind[tid], cost[tid], amount[tid] = "p2p-sell", price, price * coins[tid]
            orders[rid] = [tid, "pending"]
        elif balance[user] < price * coins[tid]:
            rejects[rid] = "insufficient balance"
        else:
            balance[user] -= price * coins[tid]
            if mode == "Wallet":
                balance[owner[tid]] += price * coins[tid]
            kind[tid] = "buy"
            for o in orders.values():
                if o[0] == tid:
                    o[1] = "completed"
    assert {r.request_id: r.reject_reason for r in out.rejects.collect()} == rejects
    assert {u: a for u, a in amounts(out.wallet).items() if a} == {u: a for u, a in balance.items() if a}
    assert {int(r.transaction_id): (r.transaction_type, r.amount, r.cost) for r in out.transactions.collect()} == {
        i: (kind[i], amount[i], cost[i]) for i in owner
    }
    assert {r.order_id: [r.transaction_id, r.status] for r in out.orders.collect()} == orders


def test_swap(spark):
    log = spark.createDataFrame([tx(1, 1, 2, 4, 40), tx(2, 1, 2, 4, 40), tx(3, 1, 2, 4, 40, "sell"), tx(4, 2, 2, 4, 40)], TX)
    schema = ("request_id bigint, request_ts timestamp, user_id bigint, from_coin bigint, to_coin bigint, from_qty decimal(18,8), "
              "from_price decimal(18,8), to_price decimal(18,8)")
    d = Decimal
    req = [(1, at(2), 1, 2, 9, d(4), d(10), d(3)), (2, at(1), 1, 2, 8, d(4), d(10), d(5)), (3, at(3), 1, 2, 7, d(4), d(10), d(5)), (4, at(4), 2, 2, 7, d(4), d(10), d(0))]
    out = M.swap(log, spark.createDataFrame(req, schema))
    rows = {int(r.transaction_id): (r.crypto_price_id, r.number_of_coins, r.amount, r.cost) for r in out.transactions.collect()}
    assert rows[1] == (8, d(8), d(40), d(5))
    assert rows[2] == (9, d("13.33333333"), d(40), d(3))
    assert rows[3][0] == 2 and rows[4][0] == 2
    assert {r.request_id: r.reject_reason for r in out.rejects.collect()} == {3: "no buy to swap", 4: "to_price"}


def test_status_and_registration(spark):
    users = spark.createDataFrame(
        [(1, "a", "a@x", "1", "Not Verified"), (2, "b", "b@x", "2", "Verified")], "user_id bigint, name string, email string, phone string, status string"
    )
    events = spark.createDataFrame([(1, at(1), 1, "Verified"), (1, at(2), 2, " NOT verified"), (9, at(1), 3, "Verified")], "user_id bigint, event_ts timestamp, event_id bigint, status string")
    assert {r.user_id: r.status for r in M.set_status(users, events).collect()} == {1: "not verified", 2: "verified"}
    req = [(1, "a", "a@x", "1"), (2, "a", "a@x", "9"), (3, "c", "c@x", "3"), (4, "c", "c@x", "4"), (5, "", "d@x", "5"), (6, "e", "e@x", "2")]
    out = M.register(users, spark.createDataFrame(req, "request_id bigint, name string, email string, phone string"))
    assert sorted(r.request_id for r in out.users.collect()) == [3, 6]
    assert {r.request_id: r.reject_reason for r in out.rejects.collect()} == {
        1: "already registered", 2: "already registered", 4: "already registered", 5: "name",
    }


def test_trades_need_a_user_and_an_id_of_their_own(spark):
    tx = spark.createDataFrame([], "transaction_id decimal(38,0), user_id bigint, crypto_price_id bigint, number_of_coins decimal(18,8), "
                                   "amount decimal(15,8), cost decimal(15,2), transaction_type string, created_at timestamp")
    wallet = spark.createDataFrame([(1, "10")], "user_id bigint, amount string")
    at = dt.datetime(2025, 1, 1)
    asked = "request_id bigint, request_ts timestamp, user_id bigint, crypto_price_id bigint, coins decimal(18,8), {} decimal(18,8)"
    rows = [(1, at, None, 1, Decimal(1), Decimal(3)), (2, at, 1, 1, Decimal(1), Decimal(3)),
            (2, at + dt.timedelta(1), 1, 1, Decimal(1), Decimal(4)), (3, at, 1, 1, Decimal(0), Decimal(4))]
    for run, price, left in ((M.buy, "amount", 7), (M.sell, "cost", 13)):
        done = run(tx, wallet, spark.createDataFrame(rows, asked.format(price)))
        assert sorted((r.request_id, r.reject_reason) for r in done.rejects.collect()) == [
            (1, "user_id"), (2, "request_id repeats"), (3, "coins")]
        assert [int(r.transaction_id) for r in done.transactions.collect()] == [2]
        assert {r.user_id: int(r.amount) for r in done.wallet.collect()} == {1: left}


def test_a_wallet_given_out_is_taken_up_with_any_amount(spark):
    held = spark.createDataFrame([(1, Decimal("12345678901234.5"))], "user_id bigint, amount decimal(38,8)")
    more = spark.createDataFrame([(1, 1, 0.5)], "request_id bigint, user_id bigint, amount double")
    assert amounts(M.deposit(held, more).wallet) == {1: Decimal("12345678901235")}


@pytest.mark.parametrize("size", [None, 7, 1])
@pytest.mark.parametrize("seed", range(2))
def test_swaps_equal_one_by_one(spark, monkeypatch, seed, size):
    """Coins gained in the batch are swapped on; one user makes a third of the requests."""
    if size:  # users of more than a few rows are followed in slices
        from tickerloom.operators import swaps

        monkeypatch.setattr(swaps, "USER_ROWS", 8)
        monkeypatch.setattr(swaps, "SLICE", size + 6)
    rng = random.Random(seed)
    log = [(100 + i, rng.choice([1, 1, 2, 3]), rng.randrange(4), rng.choice(["buy", "buy", "sell"])) for i in range(40)]
    asked = [(i, rng.choice([1, 2, 3, 4]), rng.randrange(5), rng.randrange(5) if seed else 9) for i in range(60)]
    coin, want, refused = {i: (u, c) for i, u, c, kind in log if kind == "buy"}, {}, set()
    for request, user, give, take in asked:
        able = [i for i, held in coin.items() if held == (user, give)]
        if able:
            coin[min(able)] = (user, take)
            want[min(able)] = take
        else:
            refused.add(request)
    tx = spark.createDataFrame([(Decimal(i), u, c, Decimal(1), Decimal(1), Decimal(1), kind, at(0)) for i, u, c, kind in log],
                               "transaction_id decimal(38,0), user_id bigint, crypto_price_id bigint, number_of_coins decimal(18,8), "
                               "amount decimal(15,8), cost decimal(15,2), transaction_type string, created_at timestamp")
    one = Decimal(1)
    requests = spark.createDataFrame([(i, at(i // 2), u, g, t, one, one, one) for i, u, g, t in asked],
                                     "request_id bigint, request_ts timestamp, user_id bigint, from_coin bigint, to_coin bigint, "
                                     "from_qty decimal(18,8), from_price decimal(18,8), to_price decimal(18,8)")
    done = M.swap(tx, requests)
    got = {int(r.transaction_id): r.crypto_price_id for r in done.transactions.collect()}
    assert got == {i: want.get(i, c) for i, _, c, _ in log}
    assert {r.request_id for r in done.rejects.collect()} == refused


def test_a_hot_users_swaps_are_tasks_of_even_size(spark, monkeypatch, tmp_path):
    """One user holds and asks for a third of everything; no group is above twice the median."""
    from tickerloom.operators import swaps

    monkeypatch.setattr(swaps, "USER_ROWS", 60)
    monkeypatch.setattr(swaps, "SLICE", 40)
    sizes, plain = str(tmp_path / "sizes"), swaps._replayed

    def noted(user):
        own = plain(user)

        def replay(rows):
            with open(sizes, "a") as file:
                file.write(f"{(rows['kind'] == swaps._ASKED).sum()} {len(rows)}\n")
            return own(rows)

        return replay

    monkeypatch.setattr(swaps, "_replayed", noted)
    rng, coin, want = random.Random(9), {}, {}
    log = [(1000 + i, 1 if i < 150 else 2 + i % 60, rng.randrange(3)) for i in range(450)]
    asked = [(i, 1 if i % 3 == 0 else 2 + rng.randrange(60), rng.randrange(4), rng.randrange(4)) for i in range(600)]
    coin = {i: (u, c) for i, u, c in log}
    for request, user, give, take in asked:
        able = [i for i, held in coin.items() if held == (user, give)]
        if able:
            coin[min(able)] = (user, take)
            want[min(able)] = take
    one = Decimal(1)
    rows = spark.createDataFrame([(Decimal(i), u, c, one, one, one, "buy", at(0)) for i, u, c in log], TX)
    requests = spark.createDataFrame([(i, at(i), u, g, t, one, one, one) for i, u, g, t in asked],
                                     "request_id bigint, request_ts timestamp, user_id bigint, from_coin bigint, to_coin bigint, "
                                     "from_qty decimal(18,8), from_price decimal(18,8), to_price decimal(18,8)")
    got = {int(r.transaction_id): r.crypto_price_id for r in M.swap(rows, requests).transactions.collect()}
    assert got == {i: want.get(i, c) for i, _, c in log}
    groups = sorted(tuple(map(int, line.split())) for line in open(sizes))
    assert len(groups) >= 5 and max(n for n, _ in groups) <= 40
    assert max(rows for _, rows in groups) <= 2 * groups[len(groups) // 2][1] <= 2 * 40 * 3
