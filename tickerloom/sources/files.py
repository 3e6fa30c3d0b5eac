"""Files in and out: price and news CSV, Parquet tables, result folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tickerloom import schemas
from tickerloom.functions.text import NA_WORDS, na_to_null
from tickerloom.sources.records import read_quoted

# Text fields keep their blanks and may hold quotes.
_QUOTED = dict(header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False,
               ignoreTrailingWhiteSpace=False, emptyValue="", maxCharsPerColumn=-1)


class HeaderMismatch(ValueError):
    """A file's first line differs from the agreed header; nothing is loaded."""


def read_prices(spark: SparkSession, path: str, schema: str = schemas.BARS) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, dateFormat="yyyy-MM-dd")


def read_news(
    spark: SparkSession, path: str, na_values=NA_WORDS, schema: str = schemas.NEWS_CSV, line_breaks: bool = False
) -> DataFrame:
    """Quoted news CSV; words that stand for a missing value become NULL in every field.

    ``line_breaks`` allows them inside quoted fields; a file is read by many tasks all the same.
    """
    raw = read_quoted(spark, path, schema, **_QUOTED) if line_breaks else spark.read.schema(schema).csv(path, **_QUOTED)
    return raw.select(*[na_to_null(F.col(c), na_values).alias(c) for c in raw.columns])


NEWS_HEADERS = ("Ticker,Title,Source,Date/Time", "Ticker,Title,Source,date_time")


def read_news_escaped(
    spark: SparkSession, path: str, names=("Ticker", "Title", "Source", "date_time"), headers=NEWS_HEADERS
) -> DataFrame:
    """Unquoted news CSV, one record a line, whose commas are escaped by a backslash.

    A line of a file's first block that is a whole header is left out; a ticker may be called like a header field.
    """
    lines = spark.read.text(path).withColumn("first", F.col("_metadata.file_block_start") == 0)
    is_header = F.col("first") & F.rtrim("value").isin(*headers)
    rows = lines.filter(~is_header).select(F.split("value", r"(?<!\\),").alias("f"))
    return rows.select(*[F.regexp_replace(F.get("f", F.lit(i)), r"\\,", ",").alias(n) for i, n in enumerate(names)])


def first_lines(spark: SparkSession, path: str) -> DataFrame:
    """file_path and first line of each file that is not empty; one pass, a row per file after it."""
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("at"),
    )
    return lines.filter("start = 0").groupBy("file_path").agg(F.min_by("value", "at").alias("line"))


def read_csv_strict(spark: SparkSession, path: str, schema: str, header: list[str]) -> DataFrame:
    """Reads only if the first line of every file is exactly the agreed header."""
    if not first_lines(spark, path).filter(F.col("line") != ",".join(header)).isEmpty():
        raise HeaderMismatch(f"{path}: expected header {header}")
    return spark.read.schema(schema).csv(path, header=True)


def load_prices(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Appends a checked price CSV to the price table; a wrong header loads nothing."""
    header = ["ticker", "current_price", "fiat_currency"]
    append(read_csv_strict(spark, path, schemas.CRYPTO_PRICE_CSV, header), table)
    return spark.read.parquet(table)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def append(df: DataFrame, path: str, run: str | None = None) -> None:
    """Adds rows to a table. With ``run`` (a column: the load's date, never a coarser period) a repeated load replaces
    its own partitions instead of doubling them; everything a partition held before goes."""
    if run is None:
        df.write.mode("append").parquet(path)
    else:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(run).parquet(path)


def write_csv(df: DataFrame, path: str, bom: bool = False) -> None:
    """CSV with a header, quotes only where needed; ``bom`` starts each file with a byte-order mark."""
    if bom:
        df = df.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0])
    df.write.mode("overwrite").csv(
        path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )


def write_news_escaped(df: DataFrame, path: str, header: bool = False) -> None:
    """One record a line: line breaks become blanks. ``header`` puts the header before each file's first line."""
    line = F.concat_ws(",", *[
        F.replace(F.translate(F.coalesce(c, F.lit("")), "\r\n", "  "), F.lit(","), F.lit("\\,")) for c in df.columns
    ])
    if header:
        first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0
        line = F.concat(F.when(first, F.lit(NEWS_HEADERS[0] + "\n")).otherwise(""), line)
    df.select(line.alias("value")).write.mode("overwrite").text(path)


def publish_files(df: DataFrame, base: str, prefix: str) -> str:
    """Writes a result under ``base/prefix``, on any file system Spark can reach."""
    path = f"{base.rstrip('/')}/{prefix.strip('/')}"
    df.write.mode("overwrite").parquet(path)
    return path


def read_prefix(spark: SparkSession, base: str, prefix: str = "", pattern: str = "*.parquet") -> DataFrame:
    """All files below ``base/prefix`` with the name of the file each row came from."""
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    path = f"{base.rstrip('/')}/{prefix.strip('/')}"
    return reader.parquet(path).withColumns(
        {"file_name": F.col("_metadata.file_name"), "file_path": F.col("_metadata.file_path")}
    )


def rename_rsi_summary(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({"Overbought%": "OverboughtPercent", "Oversold%": "OversoldPercent"})
