"""Tables laid out for how they are asked: by day in a store, by user in buckets."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from tickerloom.sources.versions import Store

#: Rows of a bucket, on average.
BUCKET_ROWS = 500_000


def load_by_day(store: Store, table: str, rows: DataFrame, date: str = "Date", ranges: int = 64) -> int:
    """Adds rows so that a file holds a range of days, which the manifest tells."""
    change = store.change()
    change.append_ranges(table, rows, date, ranges)
    return change.commit()


def last_day(store: Store, table: str) -> dt.date | None:
    """The table's last date; no file is opened for it."""
    _, high = store.ends(table)
    return dt.date.fromisoformat(high[:10]) if high else None


def trailing_days(store: Store, table: str, days: int = 7) -> DataFrame:
    """Rows of the ``days`` days up to the table's last date, both ends included; only files that hold some are read."""
    last = last_day(store, table)
    return store.read(table) if last is None else store.read(table, last - dt.timedelta(days=days))


def on_last_day(store: Store, table: str) -> DataFrame:
    return trailing_days(store, table, 0)


def buckets_for(*counts: int, least: int = 16) -> int:
    """Buckets for tables that are joined or summed together, of so many rows each: a task reads one bucket, and must hold it."""
    return max(least, -(-max(counts) // BUCKET_ROWS))


def save_by_user(rows: DataFrame, name: str, path: str, buckets: int = 64, key: str = "user_id") -> DataFrame:
    """Writes a table in buckets of users, one sorted file each.

    Joins and sums by user of tables with as many buckets need no exchange, and one user's rows are in one file. The name lives in the
    session's catalog; :func:`open_by_user` gives it to another session.
    """
    spread = rows.repartition(buckets, key)
    spread.write.format("parquet").mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return rows.sparkSession.table(name)


def open_by_user(spark: SparkSession, name: str, path: str, schema: str, buckets: int = 64, key: str = "user_id") -> DataFrame:
    """A table that :func:`save_by_user` has written; ``schema`` as in ``CREATE TABLE``."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)
