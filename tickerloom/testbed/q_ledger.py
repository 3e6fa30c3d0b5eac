"""Ledger batches (M). The request batches are views of the driver tables as well."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickerloom.operators import ledger as M
from tickerloom.operators.book import Book
from tickerloom.operators.ordering import concat_all
from tickerloom.session import stage, work_path
from tickerloom.testbed.q_rows import SIGN_UPS_SQL, _sign_ups
from tickerloom.testbed.registry import moment, query
from tickerloom.testbed.views import Views, with_views

MONEY = "decimal(18,8)"
WALLET_SQL = """
SELECT user_id, (coalesce(w.amount::decimal(18,8), 0) + coalesce(d.delta, 0))::double AS amount
FROM wallet w FULL JOIN (SELECT user_id, sum(delta) AS delta FROM deltas GROUP BY user_id) d USING (user_id)"""


def _told(part: str, df, key: str, value: str):
    text, number = F.col(value).cast("string"), F.lit(None).cast("double")
    if part == "wallet":
        text, number = F.lit(None).cast("string"), F.col(value).cast("double")
    return df.select(F.lit(part).alias("part"), F.col(key).cast("string").alias("key"), text.alias("value"), number.alias("amount"))


def deposits(v: Views):
    """Every order's total comes in; suppliers' balances do too, for users without a wallet."""
    orders = v._table("orders").select(
        F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("user_id"), F.col("o_totalprice").cast(MONEY).alias("amount")
    )
    fresh = v._table("supplier").select(
        (-1 - F.col("s_suppkey")).alias("request_id"), (-1 - F.col("s_suppkey")).alias("user_id"), F.col("s_acctbal").cast(MONEY).alias("amount")
    )
    return orders.unionByName(fresh)


@query("m1_deposit", "wallet", f"""
WITH deltas AS (SELECT o_custkey AS user_id, o_totalprice::decimal(18,8) AS delta FROM orders UNION ALL
  SELECT -1 - s_suppkey, s_acctbal::decimal(18,8) FROM supplier WHERE s_acctbal > 0) {WALLET_SQL}""")
def _(v):
    return M.deposit(v.wallet(), deposits(v)).wallet


def withdrawals(v: Views):
    return v._table("orders").select(
        F.col("o_orderkey").alias("request_id"), F.col("o_orderdate").cast("timestamp").alias("request_ts"),
        F.col("o_custkey").alias("user_id"), (F.col("o_totalprice").cast("decimal(12,2)") * F.lit("0.01").cast("decimal(3,2)")).cast(MONEY).alias("amount"),
    )


@query("m2_withdraw", "wallet", f"""
WITH deltas AS (SELECT o_custkey AS user_id, -(o_totalprice::decimal(12,2) * 0.01::decimal(3,2))::decimal(18,8) AS delta FROM orders) {WALLET_SQL}""")
def _(v):
    return M.withdraw(v.wallet(), withdrawals(v)).wallet


@query("m2_withdraw_floor", "wallet", """
SELECT user_id, CASE WHEN a IS NULL THEN w.amount::decimal(18,8)::double ELSE
  list_reduce(a, lambda have, ask: CASE WHEN have >= ask THEN have - ask ELSE have END, w.amount::decimal(18,8))::double END AS amount
FROM wallet w LEFT JOIN (SELECT o_custkey AS user_id, list((o_totalprice::decimal(12,2) * 0.01::decimal(3,2))::decimal(18,8) ORDER BY o_orderdate, o_orderkey) AS a
                         FROM orders GROUP BY o_custkey) USING (user_id)""")
def _(v):
    return M.withdraw(v.wallet(), withdrawals(v), floor=True).wallet


def trades(v: Views):
    """One trade request per order; ids start above every ledger id."""
    return v._table("orders").select(
        (F.col("o_orderkey").cast("decimal(20,0)") + F.lit("1" + "0" * 36).cast("decimal(38,0)")).cast("decimal(38,0)").alias("request_id"),
        F.col("o_orderdate").cast("timestamp").alias("request_ts"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_custkey").alias("crypto_price_id"),
        (F.col("o_orderkey") % 7).cast(MONEY).alias("coins"),
        F.col("o_totalprice").cast("decimal(15,8)").alias("amount"),
    )


LOG_SQL = f"""
SELECT cast(transaction_id AS varchar) AS transaction_id, user_id, crypto_price_id, number_of_coins::double AS number_of_coins,
       amount::double AS amount, cost::double AS cost, transaction_type, {moment('created_at')} AS created_at FROM transactions"""
TRADES_SQL = """
SELECT (o_orderkey::hugeint + 1000000000000000000000000000000000000::hugeint)::varchar AS transaction_id, o_custkey AS user_id,
       o_custkey AS crypto_price_id, (o_orderkey % 7)::bigint AS coins, round(o_totalprice * 100)::hugeint AS cents, o_totalprice,
       o_orderdate::timestamp AS created_at FROM orders WHERE o_orderkey % 7 > 0"""


@query("m3_buy_log", "transactions", f"""
WITH t AS ({TRADES_SQL}) {LOG_SQL} UNION ALL
SELECT transaction_id, user_id, crypto_price_id, coins::double, o_totalprice, ((2 * cents * 1000000 + coins) // (2 * coins))::double / 1e8,
       'buy', {moment('created_at')} FROM t""")
def _(v):
    return M.buy(v.transactions(), v.wallet(), trades(v)).transactions


@query("m3_buy_wallet", "wallet", f"""
WITH t AS ({TRADES_SQL}), deltas AS (SELECT user_id, -o_totalprice::decimal(18,8) AS delta FROM t) {WALLET_SQL}""")
def _(v):
    return M.buy(v.transactions(), v.wallet(), trades(v)).wallet


def sales(v: Views):
    return trades(v).withColumnRenamed("amount", "cost")


@query("m4_sell_log", "transactions", f"""
WITH t AS ({TRADES_SQL}) {LOG_SQL} UNION ALL
SELECT transaction_id, user_id, crypto_price_id, coins::double, (coins * cents)::double / 100, o_totalprice, 'sell', {moment('created_at')} FROM t""")
def _(v):
    return M.sell(v.transactions(), v.wallet(), sales(v)).transactions


@query("m4_sell_wallet", "wallet", f"""
WITH t AS ({TRADES_SQL}), deltas AS (SELECT user_id, coins * o_totalprice::decimal(18,8) AS delta FROM t) {WALLET_SQL}""")
def _(v):
    return M.sell(v.transactions(), v.wallet(), sales(v)).wallet


@query("m3_batches_committed", "wallet transactions", f"""
WITH t AS ({TRADES_SQL}), deltas AS (SELECT o_custkey AS user_id, o_totalprice::decimal(18,8) AS delta FROM orders
  UNION ALL SELECT -1 - s_suppkey, s_acctbal::decimal(18,8) FROM supplier WHERE s_acctbal > 0
  UNION ALL SELECT user_id, -o_totalprice::decimal(18,8) FROM t UNION ALL SELECT user_id, coins * o_totalprice::decimal(18,8) FROM t)
SELECT 'wallet' AS part, user_id::varchar AS key, NULL AS value, amount FROM ({WALLET_SQL})
UNION ALL SELECT 'log', transaction_id::varchar, transaction_type, NULL FROM transactions
UNION ALL SELECT 'log', transaction_id, unnest(['buy', 'sell']), NULL FROM t
UNION ALL SELECT 'reject', unnest([(o_orderkey::hugeint + 1000000000000000000000000000000000000::hugeint)::varchar,
    (o_orderkey::hugeint + 1000000000000000000000000000000000000::hugeint)::varchar]), 'coins', NULL FROM orders WHERE o_orderkey % 7 = 0
UNION ALL SELECT 'reject', (-1 - s_suppkey)::varchar, 'amount', NULL FROM supplier WHERE s_acctbal <= 0""")
def _(v):
    """Deposits, buys and sales as batches of a versioned book, each sent twice."""
    book = Book(v.spark, work_path(v.spark, "book"))
    book.create(wallet=v.wallet(), transactions=v.transactions())
    for _ in range(2):
        book.apply("deposits", 1, M.deposit, "wallet", requests=deposits(v))
        book.apply("trades", 1, M.buy, "transactions", "wallet", requests=trades(v))
        book.apply("trades", 2, M.sell, "transactions", "wallet", requests=sales(v))
    return concat_all([
        _told("wallet", book.read("wallet"), "user_id", "amount"),
        _told("log", book.read("transactions"), "transaction_id", "transaction_type"),
        _told("reject", book.read("rejects"), "request_id", "reject_reason"),
    ])


def _traded(v: Views) -> Book:
    book = Book(v.spark, work_path(v.spark, "book"))
    book.create(wallet=v.wallet(), transactions=v.transactions())
    book.apply("trades", 1, M.buy, "transactions", "wallet", requests=trades(v))
    book.apply("trades", 2, M.sell, "transactions", "wallet", requests=sales(v))
    return book


TRADED_SQL = f"""
WITH t AS ({TRADES_SQL}), every AS (
  SELECT user_id, crypto_price_id, transaction_id::varchar AS id, number_of_coins::decimal(38,8) AS coins, amount::decimal(38,8) AS amount,
         cost::decimal(38,8) AS cost, transaction_type AS kind FROM transactions
  UNION ALL SELECT user_id, crypto_price_id, transaction_id, coins::decimal(38,8), o_totalprice::decimal(38,8),
         ((2 * cents * 1000000 + coins) // (2 * coins))::decimal(30,0) * 0.00000001::decimal(9,8), 'buy' FROM t
  UNION ALL SELECT user_id, crypto_price_id, transaction_id, coins::decimal(38,8), coins * o_totalprice::decimal(18,8), o_totalprice::decimal(38,8), 'sell' FROM t)"""


@query("a2_holdings_kept", "transactions", f"""{TRADED_SQL}
SELECT user_id, crypto_price_id, coalesce(sum(coins) FILTER (kind = 'buy'), 0)::double AS bought, coalesce(sum(coins) FILTER (kind = 'sell'), 0)::double AS sold,
       round(coalesce(sum(cost) FILTER (kind = 'buy'), 0) - coalesce(sum(cost) FILTER (kind = 'sell'), 0), 2)::double AS spent,
       max(id::hugeint)::varchar AS newest FROM every GROUP BY user_id, crypto_price_id""")
def _(v):
    """Holdings of a book after two batches, from the batches' deltas."""
    return _traded(v).held().withColumn("newest", F.col("newest").cast("string"))


@query("a8_balances_kept", "transactions", f"""{TRADED_SQL}
SELECT user_id, (coalesce(sum(amount) FILTER (kind IN ('buy', 'p2p-buy')), 0) - coalesce(sum(amount) FILTER (kind IN ('sell', 'p2p-sell')), 0))::double AS balance
FROM every GROUP BY user_id""")
def _(v):
    return _traded(v).balances()


def listed_requests(v: Views):
    """Every offered transaction is asked for by its line's other user; odd lines pay from the wallet."""
    offered = v.transactions().filter(F.col("transaction_type") == "p2p-sell")
    return offered.select(
        (F.col("transaction_id") + F.lit("1" + "0" * 36).cast("decimal(38,0)")).cast("decimal(38,0)").alias("request_id"),
        F.col("created_at").alias("request_ts"), F.col("other_user").alias("buyer_id"), "transaction_id",
        F.when(F.col("line") % 2 == 1, "wallet").otherwise("card").alias("payment_type"),
    )


BOUGHT_SQL = """
SELECT t.*, ticker, i.id AS new_coin, t.number_of_coins * current_price::decimal(12,4) AS total
FROM transactions t JOIN crypto_price USING (crypto_price_id)
JOIN (SELECT ticker, min(crypto_price_id) AS id FROM crypto_price GROUP BY ticker) i USING (ticker)
WHERE transaction_type = 'p2p-sell' AND user_id <> other_user"""


@query("m5_buy_listed_log", "transactions crypto_price", f"""
WITH b AS ({BOUGHT_SQL})
SELECT cast(transaction_id AS varchar) AS transaction_id, user_id, crypto_price_id, number_of_coins::double AS number_of_coins,
       amount::double AS amount, cost::double AS cost,
       CASE WHEN transaction_type = 'p2p-sell' AND user_id <> other_user THEN 'sell' ELSE transaction_type END AS transaction_type,
       {moment('created_at')} AS created_at FROM transactions
UNION ALL SELECT (transaction_id + 1000000000000000000000000000000000000::hugeint)::varchar, other_user, new_coin, number_of_coins::double,
       amount::double, total::double, 'buy', {moment('created_at')} FROM b""")
def _(v):
    return M.buy_listed(v.transactions(), v.wallet(), v.crypto_price(), listed_requests(v)).transactions


@query("m5_buy_listed_wallet", "transactions crypto_price wallet", f"""
WITH b AS ({BOUGHT_SQL}), deltas AS (SELECT other_user AS user_id, -total AS delta FROM b WHERE line % 2 = 1)
SELECT user_id, round(amount, 6) AS amount FROM ({WALLET_SQL})""")
def _(v):
    wallet = M.buy_listed(v.transactions(), v.wallet(), v.crypto_price(), listed_requests(v)).wallet
    return wallet.select("user_id", F.round(F.col("amount").cast("double"), 6).alias("amount"))


def p2p_requests(v: Views):
    """Every line item asks for its order, in the name of the customer with its supplier's number."""
    return v.transactions().select(
        F.col("transaction_id").alias("request_id"), F.col("created_at").alias("request_ts"),
        F.col("other_user").alias("buyer_id"),
        F.floor(F.col("transaction_id") / F.lit("1" + "0" * 22).cast("decimal(38,0)")).cast("bigint").alias("order_id"),
    )


# A reduction over all requests in their order; its state is every balance, and who took each item (or which were accepted).
# Amounts are whole cents, as those of the tables are.
ACCOUNTS_SQL = """
u AS (SELECT name, row_number() OVER (ORDER BY name) AS i, coalesce(round(amount::double * 100), 0)::bigint AS cents
      FROM (SELECT user_id AS name FROM wallet UNION SELECT other_user FROM transactions UNION SELECT user_id FROM transactions)
      LEFT JOIN wallet ON user_id = name),
held AS (SELECT list(cents ORDER BY i) AS bal FROM u)"""
MOVED_SQL = """list_transform(a.bal, lambda b, i: b - CASE WHEN i = x.payer THEN x.debit ELSE 0 END + CASE WHEN i = x.payee THEN x.credit ELSE 0 END)"""
P2P_SQL = f"""
WITH {ACCOUNTS_SQL},
book AS (SELECT *, row_number() OVER (ORDER BY order_id) AS item FROM p2p_orders),
r AS (SELECT t.transaction_id AS id, row_number() OVER (ORDER BY t.created_at, t.transaction_id) AS k, item, p.i AS payer, q.i AS payee,
             CASE payment_mode WHEN 'Wallet' THEN round(price * 100)::bigint ELSE 0 END AS debit, payment_mode = 'Wallet' AS checked, other_user = b.user_id AS own
      FROM transactions t JOIN book b ON b.order_id = (t.transaction_id // 10000000000000000000000::hugeint)::bigint
      JOIN u p ON p.name = other_user JOIN u q ON q.name = b.user_id),
l AS (SELECT list({{k: k, item: item, payer: payer, payee: payee, debit: debit, credit: debit, checked: checked, own: own, bal: NULL::bigint[], won: NULL::bigint[]}}
                  ORDER BY k) AS l FROM r),
s AS (SELECT list_reduce(l, lambda a, x: CASE WHEN a.won[x.item] > 0 OR x.own OR (x.checked AND a.bal[x.payer] < x.debit) THEN a ELSE
        {{k: x.k, item: x.item, payer: x.payer, payee: x.payee, debit: x.debit, credit: x.credit, checked: x.checked, own: x.own,
          bal: CASE WHEN x.debit = 0 THEN a.bal ELSE {MOVED_SQL} END, won: a.won[1 : x.item - 1] || [x.k] || a.won[x.item + 1 :]}} END,
        {{k: 0, item: 0, payer: 0, payee: 0, debit: 0, credit: 0, checked: false, own: false, bal: (SELECT bal FROM held),
          won: (SELECT list(0::bigint) FROM book)}}) AS e FROM l)
SELECT 'wallet' AS part, name::varchar AS key, NULL AS value, s.e.bal[i]::double / 100 AS amount FROM u, s
UNION ALL SELECT 'order', order_id::varchar, status, NULL FROM book, s WHERE s.e.won[item] = 0
UNION ALL SELECT 'reject', id::varchar, CASE WHEN s.e.won[item] BETWEEN 1 AND k THEN 'order not found' WHEN own THEN 'own order'
                 ELSE 'insufficient balance' END, NULL FROM r, s WHERE s.e.won[item] <> k"""


@query("m6_settle_p2p", "transactions p2p_orders wallet", P2P_SQL)
def _(v):
    """Wallets, orders and rejects after the batch."""
    done = M.settle_p2p(v.p2p_orders(), v.transactions(), v.wallet(), v.crypto_price(), p2p_requests(v))
    return concat_all([
        _told("wallet", done.wallet, "user_id", "amount"),
        _told("order", done.orders, "order_id", "status"),
        _told("reject", done.rejects, "request_id", "reject_reason"),
    ])


def list_or_buy_requests(v: Views, tx=None):
    """Each line's owner lists it; a day later the line's other user asks for it. ``tx``: the transactions, if they are at hand."""
    tx = v.transactions() if tx is None else tx
    mode = F.when(F.col("line") % 2 == 1, "Wallet").otherwise("Bank")

    def ask(user: str, days: int, offset: str):
        return tx.select(
            (F.col("transaction_id") + F.lit(offset).cast("decimal(38,0)")).cast("decimal(38,0)").alias("request_id"),
            (F.col("created_at") + F.expr(f"INTERVAL {days} DAYS")).alias("request_ts"),
            F.col(user).alias("user_id"), "transaction_id", F.lit("C0-USD").alias("ticker"), F.col("cost").alias("price"),
            mode.alias("payment_mode"),
        )

    return ask("user_id", 0, "1" + "0" * 36).unionByName(ask("other_user", 1, "2" + "0" * 36))


LISTS_SQL = f"""
WITH {ACCOUNTS_SQL},
t AS (SELECT *, min(number_of_coins) OVER (PARTITION BY transaction_id) AS coins FROM transactions),
asked AS (
  SELECT transaction_id AS tx, transaction_id + 1000000000000000000000000000000000000::hugeint AS id, created_at AS moment, user_id AS buyer, user_id AS owner,
         coins, cost, line FROM t
  UNION ALL SELECT transaction_id, transaction_id + 2000000000000000000000000000000000000::hugeint, created_at + INTERVAL 1 DAY, other_user, user_id,
         coins, cost, line FROM t),
r AS (SELECT *, row_number() OVER (ORDER BY moment, id) AS k, buyer = owner AS lists, cost > 0 AS able,
             round(coins * cost * 100)::bigint AS debit FROM asked),
b AS (SELECT k, p.i AS payer, q.i AS payee, debit, CASE WHEN line % 2 = 1 THEN debit ELSE 0 END AS credit, row_number() OVER (ORDER BY k) AS n
      FROM r JOIN u p ON p.name = buyer JOIN u q ON q.name = owner WHERE able AND NOT lists),
l AS (SELECT list({{payer: payer, payee: payee, debit: debit, credit: credit, bal: NULL::bigint[], yes: NULL::varchar}} ORDER BY k) AS l FROM b),
s AS (SELECT list_reduce(l, lambda a, x: CASE WHEN a.bal[x.payer] < x.debit
        THEN {{payer: 0, payee: 0, debit: 0, credit: 0, bal: a.bal, yes: a.yes || '0'}}
        ELSE {{payer: 0, payee: 0, debit: 0, credit: 0, bal: {MOVED_SQL}, yes: a.yes || '1'}} END,
        {{payer: 0, payee: 0, debit: 0, credit: 0, bal: (SELECT bal FROM held), yes: ''}}) AS e FROM l),
done AS (SELECT r.*, able AND (lists OR s.e.yes[n] = '1') AS yes FROM r LEFT JOIN b USING (k), s),
last AS (SELECT tx, max(k) FILTER (yes AND lists) AS listed, max(k) FILTER (yes AND NOT lists) AS bought FROM done GROUP BY tx)
SELECT 'log' AS part, transaction_id::varchar AS key, CASE WHEN listed > coalesce(bought, 0) THEN 'p2p-sell' WHEN bought > 0 THEN 'buy'
       ELSE transaction_type END AS value, NULL AS amount FROM transactions JOIN last ON tx = transaction_id
UNION ALL SELECT 'wallet', name::varchar, NULL, s.e.bal[i]::double / 100 FROM u, s
UNION ALL SELECT 'order', order_id::varchar, status, NULL FROM p2p_orders
UNION ALL SELECT 'order', id::varchar, CASE WHEN bought > k THEN 'completed' ELSE 'pending' END, NULL FROM done JOIN last USING (tx) WHERE yes AND lists
UNION ALL SELECT 'reject', id::varchar, CASE WHEN able THEN 'insufficient balance' ELSE 'price' END, NULL FROM done WHERE NOT yes"""


@query("m7_list_or_buy", "transactions p2p_orders wallet", LISTS_SQL)
def _(v):
    """Log, wallets, orders and rejects after the batch."""
    tx = stage(v.transactions(), "log")
    done = M.list_or_buy(v.p2p_orders(), tx, v.wallet(), list_or_buy_requests(v, tx))
    return concat_all([
        _told("log", done.transactions, "transaction_id", "transaction_type"),
        _told("wallet", done.wallet, "user_id", "amount"),
        _told("order", done.orders, "order_id", "status"),
        _told("reject", done.rejects, "request_id", "reject_reason"),
    ])


def swap_requests(v: Views):
    """Every buy and every offer is a wish to swap its coin into the one numbered like its other user."""
    tx = v.transactions().filter(F.col("transaction_type").isin("buy", "p2p-sell"))
    return tx.select(
        F.col("transaction_id").alias("request_id"), F.col("created_at").alias("request_ts"), "user_id",
        F.col("crypto_price_id").alias("from_coin"), F.col("other_user").alias("to_coin"),
        F.col("number_of_coins").alias("from_qty"), F.col("cost").alias("from_price"), F.col("line").cast(MONEY).alias("to_price"),
    )


# One request of each user a step: it takes the user's least buy row of the coin as the log stands then.
SWAPS_SQL = "WITH RECURSIVE" + with_views("transactions", body=f"""
WITH r AS (SELECT user_id, crypto_price_id AS from_coin, other_user AS to_coin, (number_of_coins::bigint::hugeint * (cost * 100)::hugeint) AS cents, line,
                  row_number() OVER (PARTITION BY user_id ORDER BY created_at, transaction_id) AS k
           FROM (SELECT * FROM transactions WHERE transaction_type IN ('buy', 'p2p-sell')
                 QUALIFY row_number() OVER (PARTITION BY transaction_id ORDER BY created_at) = 1) WHERE cost > 0 AND line > 0),
st(tx, owner, coin, step, via) USING KEY (tx) AS (
  (SELECT transaction_id, user_id, crypto_price_id, 0::bigint, 0::bigint FROM transactions WHERE transaction_type = 'buy'
   UNION ALL SELECT -1::hugeint, NULL, NULL, 0, 0)
  UNION
  (SELECT tx, NULL, NULL, step + 1, 0 FROM st WHERE tx = -1 AND step < (SELECT max(k) FROM r)
   UNION ALL SELECT min(h.tx), r.user_id, any_value(r.to_coin), r.k, r.k FROM recurring.st h
   JOIN r ON h.owner = r.user_id AND h.coin = r.from_coin JOIN st n ON n.tx = -1 AND r.k = n.step + 1 GROUP BY r.user_id, r.k)),
c AS (SELECT tx, r.to_coin AS coin, cents, line FROM st JOIN r ON st.owner = r.user_id AND st.via = r.k WHERE via > 0)
SELECT cast(t.transaction_id AS varchar) AS transaction_id, user_id, coalesce(coin, crypto_price_id) AS crypto_price_id,
       CASE WHEN coin IS NULL THEN number_of_coins::double ELSE ((2 * cents * 1000000 + c.line) // (2 * c.line))::double / 1e8 END AS number_of_coins,
       CASE WHEN coin IS NULL THEN amount::double ELSE cents::double / 100 END AS amount,
       CASE WHEN coin IS NULL THEN cost::double ELSE c.line::double END AS cost, transaction_type, {moment('created_at')} AS created_at
FROM transactions t LEFT JOIN c ON c.tx = t.transaction_id""")[len("WITH"):]


@query("m8_swap_log", sql=SWAPS_SQL)
def _(v):
    return M.swap(v.transactions(), swap_requests(v)).transactions


@query("m9_set_status", "users", """
WITH e AS (SELECT user_id, CASE event_type WHEN 'signup' THEN 'not verified' WHEN 'error' THEN 'suspended' ELSE 'verified' END AS status
           FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT user_id, name, coalesce(e.status, lower(trim(u.status))) AS status FROM users u LEFT JOIN e USING (user_id)""")
def _(v):
    kind = F.col("event_type")
    status = F.when(kind == "signup", "Not Verified ").when(kind == "error", " Suspended").otherwise("Verified")
    events = v._table("events").select("user_id", F.col("ts").alias("event_ts"), "event_id", status.alias("status"))
    return M.set_status(v.users(), events).select("user_id", "name", "status")


@query("m10_register", "users", f"""
WITH r AS ({SIGN_UPS_SQL}), r2 AS (SELECT * FROM r UNION ALL SELECT request_id + 1000000, name, email, phone || '0' FROM r
  UNION ALL SELECT request_id + 2000000, NULL, 'x' || email, phone FROM r)
SELECT request_id, name, email, phone, 'not verified' AS status FROM r2
WHERE name IS NOT NULL AND email NOT IN (SELECT email FROM users)
QUALIFY row_number() OVER (PARTITION BY email ORDER BY request_id) = 1""")
def _(v):
    asked = _sign_ups(v)
    again = asked.withColumns({"request_id": F.col("request_id") + 1000000, "phone": F.concat("phone", F.lit("0"))})
    nameless = asked.withColumns({
        "request_id": F.col("request_id") + 2000000, "name": F.lit(None).cast("string"), "email": F.concat(F.lit("x"), "email"),
    })
    return M.register(v.users(), concat_all([asked, again, nameless])).users


@query("m11_ensure_wallet", "wallet", """
SELECT user_id, amount::decimal(18,8)::double AS amount FROM wallet UNION ALL SELECT -1 - s_suppkey, 0 FROM supplier""")
def _(v):
    ids = v._table("supplier").select(F.col("s_suppkey").alias("user_id"))
    return M.ensure_wallet(v.wallet(), ids.unionByName(ids.select((-1 - F.col("user_id")).alias("user_id"))))


@query("m12_remove_orders", "p2p_orders", "SELECT order_id, user_id FROM p2p_orders WHERE status <> 'completed'")
def _(v):
    orders = v.p2p_orders()
    return M.remove_orders(orders, orders.filter(F.col("status") == "completed")).select("order_id", "user_id")


@query("m13_register_icon", "icons", "SELECT image_name FROM icons UNION ALL SELECT s_name || '.png' FROM supplier")
def _(v):
    return M.register_icon(v.icons(), v._table("supplier").select(F.concat("s_name", F.lit(".png")).alias("image_name")))
