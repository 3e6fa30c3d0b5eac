"""Ledger batches applied once and as a whole: wallets, log, orders and rejects change together or not at all."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tickerloom.operators.balances import balance, deltas, folded, held
from tickerloom.operators.ledger import Outcome, log_rows
from tickerloom.session import stage
from tickerloom.sources.versions import Store

REJECTS, HELD = "rejects", "held"


class Book:
    """The ledger's tables in a :class:`~tickerloom.sources.versions.Store`.

    ``apply`` runs a ledger operator on the tables as they stand and commits everything it gives out in one version, with the
    batch's number. A source numbers its batches upwards; a number that is not above its last one is a repeat and changes nothing.
    Rows that an operator only adds to the log become a part of their own; the log is not rewritten for them. Holdings and
    balances are kept by deltas in the same version (:mod:`tickerloom.operators.balances`).
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def store(self) -> Store:
        return Store(self.spark, self.root)

    def create(self, **tables: DataFrame) -> int:
        """The first version; does nothing if there is one. With a log, holdings and balances are kept from then on."""
        store = self.store()
        if not store.version:
            change = store.change()
            for name, rows in tables.items():
                change.replace(name, log_rows(rows) if name == "transactions" else rows)
            if "transactions" in tables:
                log = change.read("transactions")  # as written: what made it is not run again
                change.replace(HELD, deltas(log, None, log, 0))
            change.commit()
        return store.version

    def read(self, table: str) -> DataFrame:
        return self.store().read(table)

    def held(self) -> DataFrame:
        """Sums per (user, price id), from the deltas alone."""
        return held(self.read(HELD))

    def balances(self) -> DataFrame:
        """Ledger balance per user, from the deltas alone."""
        return balance(self.read(HELD))

    def apply(self, source: str, number: int, operator: Callable[..., Outcome], *tables: str, requests: DataFrame) -> bool:
        """Runs ``operator(*tables, requests)`` and commits; False if the batch was applied before."""
        store = self.store()
        if store.applied(source) >= number:
            return False
        if prepared := getattr(operator, "prepared", None):
            requests = stage(prepared(requests), "requests")
        done = operator(*[store.read(t) for t in tables], requests)
        change = store.change()
        for name in ("wallet", "orders", "users"):
            rows = getattr(done, name)
            if rows is not None:
                change.replace(name, rows) if name != "users" else change.append(name, rows)
        if done.transactions is not None:
            logged = done.logged
            if done.retracted is None:
                logged = change.append("transactions", logged)
                log = logged  # not read
            else:
                change.replace("transactions", done.transactions)
                log = change.read("transactions")
            change.append(HELD, deltas(logged, done.retracted, log, store.version))
            if done.retracted is None:
                change.merge("transactions")
            change.merge(HELD, folded)
        if done.rejects is not None:
            told = done.rejects.select(
                F.lit(source).alias("source"), F.lit(number).cast("bigint").alias("batch"), F.col("request_id").cast("string").alias("request_id"),
                "reject_reason", F.to_json(F.struct("*")).alias("request"))
            change.append(REJECTS, told)
            change.merge(REJECTS)
        change.commit(source, number)
        return True
