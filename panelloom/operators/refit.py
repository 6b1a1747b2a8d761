"""A store of fits by (level, month) that is brought up to date partition by partition."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_table
from .exposures import FIT_SCHEMA, WINDOW_DAYS, exposure_grid
from .versioning import diff_observations, update_summary

PANEL = "factor string, date date, ret double"


def _overwrite(df: DataFrame, path: str, parts: Sequence[str]) -> None:
    """Replace the partitions that ``df`` has rows of, and no others."""
    df.hint("rebalance", *[F.col(p) for p in parts]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def read_fits(spark: SparkSession, root: str) -> DataFrame:
    """Fits of a store; the rows that only mark a partition as done are left out."""
    return spark.read.schema(f"{FIT_SCHEMA}, is_provisional boolean").parquet(f"{root}/fits").where("ticker is not null")


def read_panel(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(f"{PANEL}, month string").parquet(f"{root}/panel").drop("month")


def affected_partitions(changes: DataFrame, calendar: DataFrame, ends: DataFrame, levels: Mapping[str, Sequence[str]], window: int) -> DataFrame:
    """(level, period) whose fits can differ: the level holds a changed factor, and the month's window reaches a changed date.

    A level's effective date may lie before the month's end, so windows are taken twice as long as they are.
    """
    spark = changes.sparkSession
    members = spark.createDataFrame([(level, f) for level, names in levels.items() for f in names], "level string, factor string")
    spans = changes.join(members, "factor").groupBy("level").agg(F.min("date").alias("first"), F.max("date").alias("last"))
    # the calendar places of both dates: the first trading day on or after the one, the last on or before the other
    days = calendar.select("date", "idx").withColumn("__k", F.lit(1))
    placed = spans.withColumn("__k", F.lit(1)).join(days, "__k").groupBy("level", "first").agg(F.max(F.when(F.col("date") <= F.col("last"), F.col("idx"))).alias("reach"))
    months = ends.select("period", "month_end", F.col("idx").alias("end_idx")).withColumn("__k", F.lit(1))
    pairs = placed.withColumn("__k", F.lit(1)).join(months, "__k")  # levels of a catalog times months
    return pairs.where((F.col("month_end") >= F.col("first")) & (F.col("end_idx") - 2 * window <= F.coalesce("reach", F.lit(0)))).select("level", "period")


def update_fit_store(
    root: str,
    panel: DataFrame,
    returns: DataFrame,
    calendar: DataFrame,
    ends: DataFrame,
    levels: Mapping[str, Sequence[str]],
    *,
    window: int = WINDOW_DAYS,
    **options,
) -> DataFrame:
    """Bring the fits under ``root`` up to date with ``panel(factor, date, ret)``; returns one row: mode, changed_observations, refit_partitions.

    The panel is compared with the stored one; fits of affected levels and months are solved again and replace exactly those
    partitions (``fits/level=…/period=…``), each with a row without ticker so that a partition that lost all fits is replaced too.
    Fits are written before the changed months of the panel are, so a job that dies in between finds the same changes again
    and, as a partition's fits depend on nothing but the input, writes the same once more.  A first call fits everything.
    Stock returns are taken as given; corrected prices of a stock need its months refitted by the caller.
    """
    spark = panel.sparkSession
    panel = panel.where("ret is not null").select("factor", F.col("date").cast("date").alias("date"), "ret")
    try:
        stored = read_panel(spark, root)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = spark.createDataFrame([], PANEL)
    changes = scratch_table(diff_observations(panel, stored).select("factor", "date", "ret", "change"), "panel-changes")
    summary = scratch_table(update_summary(changes, stored).select("mode", "changed_observations"), "refit-summary")  # before the stored panel changes
    affected = scratch_table(affected_partitions(changes, calendar, ends, levels, window), "refit-partitions")
    pairs = affected.collect()  # levels of the catalog times months at most
    if pairs:
        named = {r.level for r in pairs}
        months = ends.join(affected.select("period").distinct(), "period", "left_semi")
        fresh = exposure_grid(returns, panel, calendar, months, {k: v for k, v in levels.items() if k in named}, window=window, **options)
        fresh = fresh.join(F.broadcast(affected), ["level", "period"], "left_semi")
        marks = affected.select("level", "period")
        _overwrite(fresh.unionByName(marks, allowMissingColumns=True), f"{root}/fits", ["level", "period"])
    touched = changes.select(F.date_format("date", "yyyy-MM").alias("month")).distinct()
    dated = panel.withColumn("month", F.date_format("date", "yyyy-MM"))
    if pairs or not changes.isEmpty():
        _overwrite(dated.join(touched, "month", "left_semi"), f"{root}/panel", ["month"])
    return summary.withColumn("refit_partitions", F.lit(len(pairs)).cast("long"))
