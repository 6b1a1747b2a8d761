"""Writers: facts by partition, portfolio and entity exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_facts(df: DataFrame, path: str, *, date: str = "date", build: str = "build_id") -> None:
    """Replace only the (build, month) partitions present in ``df``; large ones are split over tasks."""
    (
        df.withColumn("month", F.date_format(date, "yyyy-MM"))
        .hint("rebalance", F.col(build), F.col("month"))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(build, "month").parquet(path)
    )


def export_csv(df: DataFrame, path: str, columns: Sequence[str], order: Sequence[str]) -> None:
    """Ordered CSV; the order is global across the part files."""
    df.select(*columns).orderBy(*order).write.mode("overwrite").option("header", True).csv(path)


def entity_json(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, F.to_json(F.struct(*sorted(df.columns))).alias("json"))


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def replay_export(portfolio: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Daily export frame of a replay next to its benchmark."""
    from ..operators.replay import benchmark_path

    return benchmark_path(portfolio, benchmark).select(
        "strategy", "date", F.col("ret").alias("portfolio_return"), "benchmark_return",
        F.col("equity").alias("portfolio_equity"), "benchmark_equity", "turnover", "cost",
        F.col("drawdown").alias("portfolio_drawdown"), "benchmark_drawdown",
    )
