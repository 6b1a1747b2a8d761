"""Predictive statistics of scores: rank correlation, quantile spreads, membership change."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import quantile_group, ranked
from ..functions.scalars import safe_corr
from .regression import mean_with_hac


def aligned(scores: DataFrame, forward: DataFrame, period: str = "period") -> DataFrame:
    """Complete (period, ticker, score, forward_return) rows of periods present on both sides."""
    return scores.join(forward, [period, "ticker"]).where("score is not null and forward_return is not null")


def rank_ic(panel: DataFrame, period: str = "period") -> DataFrame:
    """Spearman correlation of score and forward return per period (more than 2 names)."""
    a = ranked(panel, [period], "score", "ticker", prefix="s_")
    b = ranked(a, [period], "forward_return", "ticker", prefix="f_")
    return (
        b.groupBy(period)
        .agg(safe_corr("s_percentile", "f_percentile").alias("ic"), F.count(F.lit(1)).alias("n"))
        .where("n > 2")
    )


def quantile_returns(panel: DataFrame, period: str = "period", groups: int = 5) -> DataFrame:
    """Mean forward return of each score group; periods with under 2*groups names are skipped."""
    r = ranked(panel, [period], "score", "ticker", prefix="s_", ascending=True)
    return (
        r.where(F.col("s_ranked_count") >= 2 * groups)
        .withColumn("bucket", quantile_group(F.col("s_rank"), F.col("s_ranked_count"), groups))
        .groupBy(period, "bucket")
        .agg(F.avg("forward_return").alias("mean_return"), F.count(F.lit(1)).alias("n"))
    )


def period_spreads(panel: DataFrame, period: str = "period", groups: int = 5) -> DataFrame:
    """Per period: rank correlation, top-minus-bottom spread and hit flag."""
    q = quantile_returns(panel, period, groups)
    pick = lambda g: F.max(F.when(F.col("bucket") == g, F.col("mean_return")))
    spreads = q.groupBy(period).agg((pick(groups - 1) - pick(0)).alias("spread"), F.sum("n").alias("names"))
    return spreads.join(rank_ic(panel, period).select(period, "ic"), period).withColumn(
        "hit", (F.col("spread") > 0).cast("double")
    )


def selection_statistics(panel: DataFrame, period: str = "period", groups: int = 5) -> DataFrame:
    s = period_spreads(panel, period, groups)
    sd = F.stddev_samp("ic")
    return s.agg(
        F.avg("ic").alias("rank_ic"),
        F.when(sd > 0, F.avg("ic") / sd).alias("icir"),
        F.avg("spread").alias("top_minus_bottom"),
        F.avg("hit").alias("hit_rate"),
        F.count(F.lit(1)).alias("observations"),
    )


def screen_statistics(
    panel: DataFrame, selections: DataFrame, period: str = "period", cost_bps: float = 25
) -> DataFrame:
    """Selection statistics plus robust spread inference, quintile means, turnover and cost."""
    base = selection_statistics(panel, period)
    spreads = period_spreads(panel, period).select(F.lit(1).alias("k"), F.col(period).alias("date"), "spread")
    hac = mean_with_hac(spreads, "k", "spread", 3, 3)
    hac = hac.where("n >= 3").select(F.col("t_stat").alias("spread_hac_t"), F.col("p_value").alias("spread_hac_p"))
    q = quantile_returns(panel, period).agg(
        *[F.avg(F.when(F.col("bucket") == g, F.col("mean_return"))).alias(f"quantile_{g + 1}") for g in range(5)]
    )
    t = membership_change(selections, period).agg(
        F.avg("changes").alias("turnover"), (F.sum("changes") * cost_bps / 10000).alias("estimated_cost")
    )
    one = lambda df: df.withColumn("__k", F.lit(1))
    # four one-row tables side by side
    return (
        one(base)
        .join(one(hac), "__k", "left")
        .join(one(q), "__k", "left")
        .join(one(t), "__k", "left")
        .drop("__k")
        .withColumn("annualized_icir", F.col("icir") * (12.0**0.5))
        .withColumn("short_history", F.col("observations") < 36)
    )


def membership_change(selections: DataFrame, period: str = "period") -> DataFrame:
    """Half the number of names entering or leaving; the first period counts as 0."""
    order = Window.orderBy(period)  # one row per period
    periods = selections.select(period).distinct().withColumn("__next", F.lead(period).over(order))
    now = selections.select(period, "ticker").distinct()
    before = (
        now.join(periods.where("__next is not null"), period)
        .select(F.col("__next").alias(period), "ticker", F.lit(-1).alias("d"))
    )
    delta = now.withColumn("d", F.lit(1)).unionByName(before).groupBy(period, "ticker").agg(F.abs(F.sum("d")).alias("d"))
    first = periods.agg(F.min(period).alias(period))
    changes = delta.groupBy(period).agg((F.sum("d") / 2.0).alias("changes"))
    return changes.join(first.withColumn("__f", F.lit(True)), period, "left").select(
        period, F.when(F.col("__f"), F.lit(0.0)).otherwise(F.col("changes")).alias("changes")
    )
