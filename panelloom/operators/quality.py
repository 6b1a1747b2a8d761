"""Coverage, history depth and retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import THEMES


def factor_coverage(observations: DataFrame, factor: str = "factor", value: str = "ret") -> DataFrame:
    """Observations, panel length, ratio and span per factor."""
    obs = observations.where(F.col(value).isNotNull())
    panel = obs.agg(F.countDistinct("date").alias("panel_observations")).withColumn("__k", F.lit(1))
    return (
        obs.groupBy(factor)
        .agg(F.count(F.lit(1)).alias("observations"), F.min("date").alias("start"), F.max("date").alias("end"))
        .withColumn("__k", F.lit(1))
        .join(panel, "__k")
        .withColumn("ratio", F.col("observations") / F.col("panel_observations"))
        .drop("__k")
    )


def stock_coverage(fits: DataFrame, by=("level",)) -> DataFrame:
    """Latest date, stocks at it, stocks with history, upper median and maximum of months.

    The median runs over a histogram of month counts, whose size is the number of
    distinct counts, not the number of stocks.
    """
    by = list(by)
    newest = fits.groupBy(*by).agg(F.max("as_of").alias("latest_as_of"))
    at_latest = (
        fits.join(newest, by).where("as_of = latest_as_of").groupBy(*by).agg(F.countDistinct("ticker").alias("latest_stocks"))
    )
    months = fits.groupBy(*by, "ticker").agg(F.countDistinct("period").alias("m"))
    hist = months.groupBy(*by, "m").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*by).orderBy("m")
    ranked = hist.withColumn("cum", F.sum("c").over(w)).withColumn("n", F.sum("c").over(Window.partitionBy(*by)))
    depth = ranked.groupBy(*by).agg(
        F.sum(F.when(F.col("m") > 1, F.col("c")).otherwise(F.lit(0))).alias("stocks_with_history"),
        F.min(F.when(F.col("cum") > F.floor(F.col("n") / 2), F.col("m"))).alias("median_months"),
        F.max("m").alias("maximum_months"),
    )
    return newest.join(at_latest, by).join(depth, by)


def quality_flags(df: DataFrame, factor: str = "factor") -> DataFrame:
    f = F.col(factor)
    # The flags are part of the results.
    flag = (
        F.when(f == "Liquidity", "weak_proxy_liquidity")
        .when(f.isin("LowVolatility", "BetaFactor"), "collinear_style_pair")
        .when(f.isin(*THEMES), "fixed_thematic_membership")
    )
    return df.withColumn("quality_flags", F.array_compact(F.array(flag)))


def missing_tickers(requested: DataFrame, prices: DataFrame, minimum: int = 2) -> DataFrame:
    """Requested symbols with fewer than ``minimum`` closes."""
    n = prices.where("close is not null").groupBy("ticker").agg(F.count(F.lit(1)).alias("closes"))
    return (
        requested.select("ticker").distinct().join(n, "ticker", "left")
        .withColumn("closes", F.coalesce("closes", F.lit(0).cast("long")))
        .where(F.col("closes") < minimum)
    )


def short_history(prices: DataFrame, floor: int = 60, share: float = 0.6) -> DataFrame:
    """Symbols with fewer closes than max(floor, int(share * longest history))."""
    n = prices.where("close is not null").groupBy("ticker").agg(F.count(F.lit(1)).alias("closes"))
    longest = n.agg(F.max("closes").alias("m")).withColumn("__k", F.lit(1))
    need = F.greatest(F.lit(floor), F.floor(F.col("m") * share))
    return (
        n.withColumn("__k", F.lit(1)).join(longest, "__k").withColumn("required", need.cast("long"))
        .where("closes < required").select("ticker", "closes", "required")
    )


def truncate_history(observations: DataFrame, cutoff: str, factor="factor", index: str = "cumulative_index"):
    """Drop rows before the cutoff and rebase the index to the first kept value (unless it is 0 or missing)."""
    kept = observations.where(F.col("date") >= F.lit(cutoff).cast("date"))
    base = kept.groupBy(factor).agg(F.min_by(index, "date").alias("__b"))
    return kept.join(base, factor).withColumn(
        index, F.when(F.coalesce(F.col("__b"), F.lit(0.0)) == 0, F.col(index)).otherwise(F.col(index) / F.col("__b"))
    ).drop("__b")
