"""Holdings and ledger balances kept up to date by signed deltas.

A batch's new log rows count up, the rows it rewrites count down as they stood and up as they stand. A batch adds one
row of sums for each (user, price id) that it touches, and reads no others; what a key stands at is the sum of its rows. The
newest transaction id of a key cannot be added up: where a row has left a key (a swap takes it to another coin), that key's newest
is looked up in the log, among the touched users' rows, and from then on counts instead of earlier ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

KEY = ["user_id", "crypto_price_id"]
COINS, COST, MONEY = "decimal(38,8)", "decimal(30,2)", "decimal(30,8)"
#: Cost is kept with all its digits, and rounded where it is read.
SUMS = {"bought": COINS, "sold": COINS, "spent": "decimal(38,8)", "balance": MONEY, "rows": "bigint"}
_NEWEST = "array<struct<as_of: bigint, reset: boolean, id: decimal(38,0)>>"


def _when(kinds: tuple[str, ...], value: Column) -> Column:
    return F.when(F.col("transaction_type").isin(*kinds), value).otherwise(F.lit(0))


def deltas(logged: DataFrame, retracted: DataFrame | None, log: DataFrame, as_of: int) -> DataFrame:
    """(user_id, crypto_price_id, sums, newest) that a batch adds. ``log`` is the log after it, read for keys that lost a row."""
    rows = logged.withColumn("sign", F.lit(1))
    if retracted is not None:
        rows = rows.unionByName(retracted.withColumn("sign", F.lit(-1)))
    coins, cost, amount = (F.col(c) * F.col("sign") for c in ("number_of_coins", "cost", "amount"))
    # A row that stays in its key leaves nothing of its id; one that is gone leaves less than nothing.
    each = rows.groupBy(*KEY, "transaction_id").agg(
        F.sum(_when(("buy",), coins)).cast(COINS).alias("bought"), F.sum(_when(("sell",), coins)).cast(COINS).alias("sold"),
        F.sum(_when(("buy",), cost) - _when(("sell",), cost)).cast(SUMS["spent"]).alias("spent"),
        F.sum(_when(("buy", "p2p-buy"), amount) - _when(("sell", "p2p-sell"), amount)).cast(MONEY).alias("balance"),
        F.sum("sign").cast("bigint").alias("rows"), F.max("sign").alias("stands"),
    )
    sums = each.groupBy(*KEY).agg(
        *[F.sum(c).cast(kind).alias(c) for c, kind in SUMS.items()],
        F.max(F.when(F.col("stands") > 0, F.col("transaction_id"))).cast("decimal(38,0)").alias("id"),
        F.max(F.col("stands") < 0).alias("reset"),
    )
    if retracted is not None:
        lost = sums.filter("reset").select(*KEY)
        found = _of_keys(log, lost).groupBy(*KEY).agg(F.max("transaction_id").cast("decimal(38,0)").alias("_now"))
        sums = _meet(sums, found).withColumn("id", F.when(F.col("reset"), F.col("_now")).otherwise(F.col("id"))).drop("_now")
    newest = F.array(F.struct(F.lit(as_of).cast("bigint").alias("as_of"), "reset", "id")).cast(_NEWEST)
    return sums.withColumn("newest", newest).select(*KEY, *SUMS, "newest")


def _of_keys(log: DataFrame, keys: DataFrame) -> DataFrame:
    own = keys.select(*[F.col(c).alias(f"_{c}") for c in KEY])
    return log.join(own, F.col("user_id").eqNullSafe(F.col("_user_id")) & F.col("crypto_price_id").eqNullSafe(F.col("_crypto_price_id")), "left_semi")


def _meet(sums: DataFrame, found: DataFrame) -> DataFrame:
    own = found.select(*[F.col(c).alias(f"_{c}") for c in KEY], "_now")
    same = F.col("user_id").eqNullSafe(F.col("_user_id")) & F.col("crypto_price_id").eqNullSafe(F.col("_crypto_price_id"))
    return sums.join(own, same, "left").drop("_user_id", "_crypto_price_id")


def folded(rows: DataFrame) -> DataFrame:
    """Deltas of equal keys added up; of the newest ids those that may still count."""
    sums = rows.groupBy(*KEY).agg(*[F.sum(c).cast(kind).alias(c) for c, kind in SUMS.items()],
                                  F.flatten(F.collect_list("newest")).alias("newest"))
    since = F.array_max(F.transform("newest", lambda x: F.when(x["reset"], x["as_of"])))
    counts = sums.withColumn("_since", since).withColumn(
        "newest", F.filter("newest", lambda x: F.col("_since").isNull() | (x["as_of"] >= F.col("_since"))))
    best = F.array_max(F.transform("newest", lambda x: x["id"]))
    as_of = F.array_max(F.transform("newest", lambda x: x["as_of"]))
    # Later resets must still count: the entry keeps the last one's time, and that of its latest row.
    merged = F.array(F.struct(as_of.alias("as_of"), F.col("_since").isNotNull().alias("reset"), best.alias("id"))).cast(_NEWEST)
    return counts.withColumn("newest", merged).select(*KEY, *SUMS, "newest")


def held(rows: DataFrame) -> DataFrame:
    """user_id, crypto_price_id, bought, sold, spent, newest: as ``held_per_price`` gives for the log."""
    return folded(rows).filter("rows > 0").select(
        *KEY, "bought", "sold", F.col("spent").cast(COST).alias("spent"), F.col("newest")[0]["id"].alias("newest"))


def balance(rows: DataFrame) -> DataFrame:
    """user_id, balance: as ``ledger_balance`` gives for the log."""
    sums = rows.groupBy("user_id").agg(F.sum("balance").cast(MONEY).alias("balance"), F.sum("rows").alias("rows"))
    return sums.filter("rows > 0").drop("rows")
