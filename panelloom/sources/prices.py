"""Price book: reading, validation, upsert and layout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import finite, normalize_ticker
from ..operators.versioning import keep_latest
from ..schemas import PRICES


def read_prices(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """Long price book; a date bound reaches the scan as a pushed filter."""
    df = spark.read.schema(PRICES).parquet(path)
    return df if since is None else df.where(F.col("date") >= F.lit(since).cast("date"))


def price_panel(prices: DataFrame, securities: DataFrame) -> DataFrame:
    """Prices with their security's metadata (rows without metadata are kept)."""
    return prices.join(securities, "ticker", "left")


def melt_prices(wide: DataFrame, date: str = "date") -> DataFrame:
    """Date-by-ticker frame -> long rows; missing and non-finite closes are skipped."""
    names = [c for c in wide.columns if c != date]
    long = wide.unpivot([date], names, "ticker", "close")
    return long.select(normalize_ticker("ticker").alias("ticker"), date, finite("close").alias("close")).where("close is not null")


def pivot_prices(prices: DataFrame, tickers: Sequence[str]) -> DataFrame:
    """Wide export of an explicit ticker list."""
    return prices.groupBy("date").pivot("ticker", list(tickers)).agg(F.first("close"))


def validate_prices(prices: DataFrame, order: str = "batch", place: Sequence[str] = ()) -> DataFrame:
    """First row per (ticker, date), non-positive closes to NULL; raises without any usable series.

    Rows that tie in ``order`` stand in the order of the columns ``place``, then by their close, so that reruns agree.
    """
    rest = [c for c in prices.columns if c not in {"ticker", "date", order, *place}]
    at = F.when(F.col(order).isNotNull(), F.struct(order, *place, "close"))
    first = prices.groupBy("ticker", "date").agg(F.min_by(F.struct(*rest), at).alias("__v")).select("ticker", "date", *[F.col(f"__v.{c}").alias(c) for c in rest])
    clean = first.withColumn("close", F.when(F.col("close") > 0, finite("close")))
    counts = clean.groupBy("ticker").agg(F.count("close").alias("n"))
    ok = counts.agg(F.max("n").alias("m")).select(
        F.assert_true(F.coalesce(F.col("m") >= 2, F.lit(False)), F.lit("no ticker has enough valid prices")).alias("__ok"),
        F.lit(1).alias("__k"),
    )
    return clean.withColumn("__k", F.lit(1)).join(ok, "__k").where("__ok is null").drop("__k", "__ok")


def upsert_prices(stored: DataFrame, batch: DataFrame, order: str = "batch") -> DataFrame:
    """Last write wins per (ticker, date); NULL and non-finite closes never overwrite."""
    clean = batch.withColumn("ticker", normalize_ticker("ticker")).withColumn("close", finite("close")).where("close is not null")
    old = stored if order in stored.columns else stored.withColumn(order, F.lit(-1).cast("long"))
    both = old.select("ticker", "date", "close", F.col(order).cast("long").alias(order)).unionByName(
        clean.select("ticker", "date", "close", F.col(order).cast("long").alias(order))
    )
    return keep_latest(both, ["ticker", "date"], order)


def write_prices(prices: DataFrame, path: str) -> None:
    """Month-partitioned layout: an upsert rewrites only the months it touches.

    The rebalance hint sizes the files and splits a month too large for one task.
    """
    (
        prices.withColumn("month", F.date_format("date", "yyyy-MM"))
        .hint("rebalance", F.col("month"))
        .sortWithinPartitions("ticker", "date")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)
    )


def months_of_book(spark: SparkSession, path: str, months: list[str]) -> DataFrame:
    """Rows of the given months ("yyyy-MM"); a partition filter, so that no other folder is read."""
    return spark.read.schema(PRICES + ", batch long, month string").parquet(path).where(F.col("month").isin(months)).drop("month")


def merge_into_book(spark: SparkSession, path: str, batch: DataFrame, stage: str) -> None:
    """Upsert ``batch(ticker, date, close, batch)`` into the book at ``path``.

    Only partitions of touched months are read; their names, at most one per calendar month of the batch, come to
    the driver.  The result is staged before partitions are replaced.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    batch = batch.withColumn("month", F.date_format("date", "yyyy-MM"))
    if exists:
        stored = months_of_book(spark, path, [r.month for r in batch.select("month").distinct().collect()])
    else:
        stored = spark.createDataFrame([], PRICES + ", batch long")
    merged = upsert_prices(stored, batch.drop("month"))
    merged.write.mode("overwrite").parquet(stage)
    write_prices(spark.read.schema(PRICES + ", batch long").parquet(stage), path)


def distinct_tickers(*frames: DataFrame) -> DataFrame:
    """Deterministic union of symbol lists."""
    total = frames[0].select("ticker")
    for f in frames[1:]:
        total = total.union(f.select("ticker"))
    return total.distinct().orderBy("ticker")
