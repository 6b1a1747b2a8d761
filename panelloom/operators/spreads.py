"""Baskets and long-short spreads, one row per (factor, date)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def basket_returns(returns: DataFrame, members: DataFrame, *, require_all: bool = False) -> DataFrame:
    """Equal-weight mean by (factor, date).

    ``members(factor, ticker)``.  Missing members are skipped, or make the date NULL
    when ``require_all`` (so that membership cannot drift unnoticed).
    """
    sizes = members.groupBy("factor").agg(F.count(F.lit(1)).alias("__size"))
    out = (
        returns.where("ret is not null")
        .join(members, "ticker")
        .groupBy("factor", "date")
        .agg(F.avg("ret").alias("ret"), F.count("ret").alias("__n"))
    )
    if require_all:
        out = out.join(sizes, "factor").where("__n = __size").drop("__size")
    return out.drop("__n")


def spread_returns(returns: DataFrame, legs: DataFrame) -> DataFrame:
    """Long mean minus short mean; a factor without a short (or long) leg counts it as 0.

    ``legs(factor, side, ticker)`` with side ``long`` or ``short``.  A date is NULL, and
    dropped, when a defined leg has no return on it.
    """
    has = legs.groupBy("factor").agg(
        F.max((F.col("side") == "long").cast("int")).alias("has_long"),
        F.max((F.col("side") == "short").cast("int")).alias("has_short"),
    )
    side = lambda s: F.avg(F.when(F.col("side") == s, F.col("ret")))
    legs_by_date = (
        returns.where("ret is not null")
        .join(legs, "ticker")
        .groupBy("factor", "date")
        .agg(side("long").alias("l"), side("short").alias("s"))
    )
    long_leg = F.when(F.col("has_long") == 1, F.col("l")).otherwise(F.lit(0.0))
    short_leg = F.when(F.col("has_short") == 1, F.col("s")).otherwise(F.lit(0.0))
    return (
        legs_by_date.join(has, "factor")
        .select("factor", "date", (long_leg - short_leg).alias("ret"))
        .where("ret is not null")
    )
