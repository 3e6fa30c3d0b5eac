"""Bars as keyed JSON records, on a broker topic or in files."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tickerloom import schemas
from tickerloom.functions.numbers import nan_to_null

BAR_RECORD = schemas.BARS.replace("Date date", "Date string")


class Parsed(NamedTuple):
    bars: DataFrame
    rejects: DataFrame


def to_messages(df: DataFrame) -> DataFrame:
    """Key: the day as text. Value: the row as JSON."""
    day = F.date_format("Date", "yyyy-MM-dd")
    rest = [c for c in df.columns if c != "Date"]
    return df.select(day.alias("key"), F.to_json(F.struct(day.alias("Date"), *rest)).alias("value"))


def publish(df: DataFrame, topic: str, servers: str) -> None:
    to_messages(df).write.format("kafka").options(**{"kafka.bootstrap.servers": servers, "topic": topic}).save()


def publish_to_files(df: DataFrame, path: str) -> None:
    to_messages(df).select("value").write.mode("append").text(path)


def topic_options(topic: str, servers: str) -> dict[str, str]:
    """From the earliest record on; records already expired do not stop the stream."""
    return {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": "earliest",
        "failOnDataLoss": "false",
    }


def consume(spark: SparkSession, topic: str, servers: str) -> DataFrame:
    stream = spark.readStream.format("kafka").options(**topic_options(topic, servers)).load()
    return stream.select(F.col("value").cast("string").alias("value"))


def consume_files(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.format("text")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def parse_bars(values: DataFrame) -> Parsed:
    """Typed bars, and the records that are no bar. A bare NaN in a record becomes NULL."""
    record = F.from_json("value", BAR_RECORD + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    parsed = values.select("value", record.alias("r")).withColumn("day", F.expr("try_to_date(r.Date, 'yyyy-MM-dd')"))
    good = F.col("r._bad").isNull() & F.col("day").isNotNull() & F.col("r.Ticker").isNotNull()
    fields = [nan_to_null(F.col(f"r.{c}")).alias(c) for c in schemas.BAR_FIELDS if c != "Volume"]
    bars = parsed.filter(good).select(
        F.col("day").alias("Date"), F.col("r.Ticker").alias("Ticker"), *fields, F.col("r.Volume").alias("Volume")
    )
    return Parsed(bars, parsed.filter(~F.coalesce(good, F.lit(False))).select("value"))


def drain_parsed(values: DataFrame, bars: str, rejects: str, checkpoint: str) -> StreamingQuery:
    """Reads a stream of records once and writes its bars and its rejects, each batch as one part of both tables.

    A batch that is run again writes its parts anew.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        parsed = parse_bars(batch)
        for rows, path in ((parsed.bars, bars), (parsed.rejects, rejects)):
            rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return values.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
