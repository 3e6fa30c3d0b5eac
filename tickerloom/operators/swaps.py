"""Which buy row each swap request rewrites, where requests of a user build on one another.

A request takes the user's least buy row of a coin, as the log stands after the requests before it, and makes it a row of another coin.
Users of up to ``USER_ROWS`` rows are followed whole, many users a task. The requests of a greater one are cut into slices of their
order. Slices come one after another, but each is a group of its own size, handed no more than it can reach: of the rows
that the user held of a coin, taken in the order of their ids, the next as many as the slice has requests for that coin, and of
the rows that came to the coin meanwhile as many of the least. A slice hands on how far it got in the first and what changed among the second.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tickerloom.operators.ordered import staged_ranks, union_all
from tickerloom.session import discard, staged, staged_parts

#: Buys and requests of a user who is followed whole, at most, and requests of a slice of any other.
USER_ROWS, SLICE = 100_000, 50_000
NUMBER = "decimal(38,0)"
_HELD, _GAINED, _ASKED = 0, 1, 2
_TOLD = f"user_id {{user}}, request string, row {NUMBER}, coin string, used bigint, change int"
_PAIR = ["user_id", "coin"]


def _text(column: str | None) -> Column:
    return F.col(column).cast("string") if column else F.lit(None).cast("string")


def _named(requests: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests (user_id, at, request_id, request, coin, to) and rows (user_id, coin, row)."""
    asked = requests.select("user_id", F.col("request_ts").alias("at"), "request_id", _text("request_id").alias("request"),
                            _text("from_coin").alias("coin"), _text("to_coin").alias("to"))
    rows = held.select("user_id", _text("crypto_price_id").alias("coin"), F.col("transaction_id").cast(NUMBER).alias("row"))
    return asked, rows


def matched_in_turn(requests: DataFrame, held: DataFrame) -> tuple[DataFrame, str]:
    """(request_id, transaction_id) of requests (user_id, request_ts, request_id, from_coin, to_coin) on the users' buy rows, and the
    path of the table that holds them."""
    requests, at_requests = staged(requests.select("user_id", "request_ts", "request_id", "from_coin", "to_coin"), "swaps-asked")
    held, at_held = staged(held, "swaps-held")
    sizes = requests.select("user_id").unionByName(held.select("user_id")).groupBy("user_id").count()
    great, at_great = staged(sizes.filter(F.col("count") > USER_ROWS).select("user_id"), "great-users")
    parts, steps = [_whole(*_named(requests.join(great, "user_id", "left_anti"), held.join(great, "user_id", "left_anti")))], []
    if not great.isEmpty():
        sliced, steps = _in_slices(*_named(requests.join(great, "user_id", "left_semi"), held.join(great, "user_id", "left_semi")))
        parts.append(sliced)
    told, path = staged_parts(parts, "swaps-told")
    discard(told.sparkSession, at_requests, at_held, at_great, *steps)
    matched = told.select(F.col("request").cast(requests.schema["request_id"].dataType).alias("request_id"),
                       F.col("row").cast(held.schema["transaction_id"].dataType).alias("transaction_id"))
    return matched, path


def _whole(asked: DataFrame, held: DataFrame) -> DataFrame:
    """Users next to each other in a task, each one's rows first and then the requests in order."""
    buys = held.select("user_id", F.lit(_HELD).alias("kind"), F.lit(None).cast("timestamp").alias("at"),
                       F.lit(None).cast(asked.schema["request_id"].dataType).alias("request_id"), _text(None).alias("request"), "row", "coin",
                       _text(None).alias("to"))
    wishes = asked.select("user_id", F.lit(_ASKED).alias("kind"), "at", "request_id", "request", F.lit(None).cast(NUMBER).alias("row"), "coin", "to")
    rows = buys.unionByName(wishes).repartition("user_id").sortWithinPartitions("user_id", "kind", "at", "request_id").drop("at", "request_id")
    return rows.mapInPandas(_swap_in_turn, f"request string, row {NUMBER}")


def _swap_in_turn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs down each user's buys and then requests; a swapped row is at once a buy of its new coin."""
    user, heaps = None, {}
    for batch in batches:
        out = []
        for owner, kind, row, coin, request, to in zip(*(batch[c] for c in ("user_id", "kind", "row", "coin", "request", "to"))):
            if owner != user:
                user, heaps = owner, {}
            if kind == _HELD:
                heapq.heappush(heaps.setdefault(coin, []), row)
                continue
            if own := heaps.get(coin):
                row = heapq.heappop(own)
                heapq.heappush(heaps.setdefault(to, []), row)
            out.append((request, row))
        yield pd.DataFrame(out, columns=["request", "row"])


def _in_slices(asked: DataFrame, held: DataFrame) -> tuple[DataFrame, list[str]]:
    """(request, row) for users too great for one task, and the tables to delete once that is read."""
    user = held.schema["user_id"].dataType
    told_schema = _TOLD.format(user=user.simpleString())
    asked, at_asked = staged_ranks(asked, ["user_id"], ["at", "request_id"], "k")
    held, at_held = staged_ranks(held, _PAIR, ["row"], "rank")
    told = held.sparkSession.createDataFrame([], told_schema)
    last = asked.agg(F.max("k")).first()[0] or 0
    rounds, paths = [], []
    for number in range(-(-last // SLICE)):
        own = asked.filter((F.col("k") > number * SLICE) & (F.col("k") <= (number + 1) * SLICE))
        rows, at_least = _handed(own, held, told)
        step, path = staged(rows.groupBy("user_id").applyInPandas(_replayed(user), told_schema), "slice-told")
        discard(held.sparkSession, at_least)
        rounds.append(step)
        paths.append(path)
        told = union_all(rounds)
    discard(held.sparkSession, at_asked, at_held)
    return told.filter("request IS NOT NULL").select("request", "row"), paths


def _handed(own: DataFrame, held: DataFrame, told: DataFrame) -> tuple[DataFrame, str]:
    """A slice's requests, and the rows that these can reach; and the table to delete once that is read."""
    needs = own.groupBy(*_PAIR).agg(F.count("*").alias("n"))
    used = told.filter("used IS NOT NULL").groupBy(*_PAIR).agg(F.sum("used").alias("done"))
    ranks = needs.join(used, _PAIR, "left").withColumn("done", F.coalesce("done", F.lit(0).cast("bigint")))
    ranks = ranks.select(*_PAIR, F.explode(F.sequence(F.col("done") + 1, F.col("done") + F.col("n"))).alias("rank"))
    next_held = held.join(ranks, [*_PAIR, "rank"], "left_semi")
    there = told.filter("change IS NOT NULL").groupBy(*_PAIR, "row").agg(F.sum("change").alias("net")).filter("net > 0")
    ranked, path = staged_ranks(there.join(needs, _PAIR).select(*_PAIR, "row", "n"), _PAIR, ["row"], "rank")
    least = ranked.filter("rank <= n")
    row = lambda df, kind: df.select("user_id", F.lit(kind).alias("kind"), F.lit(0).cast("bigint").alias("k"), _text(None).alias("request"),
                                     "row", "coin", _text(None).alias("to"))
    wishes = own.select("user_id", F.lit(_ASKED).alias("kind"), F.col("k").cast("bigint").alias("k"), "request", F.lit(None).cast(NUMBER).alias("row"), "coin", "to")
    return union_all([row(next_held, _HELD), row(least, _GAINED), wishes]), path


def _replayed(user: T.DataType):
    def replay(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["kind", "k"], kind="stable")
        heaps, begun, out = {}, set(), []
        used, there = Counter(), set()
        for kind, row, coin, request, to in zip(*(rows[c] for c in ("kind", "row", "coin", "request", "to"))):
            if kind != _ASKED:
                heapq.heappush(heaps.setdefault(coin, []), (row, kind))
                if kind == _GAINED:
                    begun.add((coin, row))
                    there.add((coin, row))
                continue
            own = heaps.get(coin)
            if not own:
                out.append((request, None, None, None, None))
                continue
            row, kind = heapq.heappop(own)
            if kind == _HELD:
                used[coin] += 1
            else:
                there.discard((coin, row))
            heapq.heappush(heaps.setdefault(to, []), (row, _GAINED))
            there.add((to, row))
            out.append((request, row, None, None, None))
        out += [(None, None, coin, n, None) for coin, n in used.items()]
        out += [(None, row, coin, None, 1) for coin, row in there - begun]
        out += [(None, row, coin, None, -1) for coin, row in begun - there]
        told = pd.DataFrame(out, columns=["request", "row", "coin", "used", "change"], dtype=object)
        return told.assign(user_id=rows["user_id"].iloc[0])

    return replay
