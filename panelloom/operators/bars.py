"""Compounding of daily returns into weekly, monthly and yearly-week bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import compound, month_start, week_ending_friday


def weekly_returns(df: DataFrame, key: str, values=("ret",)) -> DataFrame:
    """Friday-ending compounded returns; weeks without rows inside the span are 0."""
    bars = (
        df.withColumn("week", week_ending_friday("date"))
        .groupBy(key, "week")
        .agg(*[compound(v).alias(v) for v in values])
    )
    spine = (
        bars.groupBy(key)
        .agg(F.min("week").alias("a"), F.max("week").alias("b"))
        .select(key, F.explode(F.sequence("a", "b", F.expr("interval 7 days"))).alias("week"))
    )
    return spine.join(bars, [key, "week"], "left").fillna(0.0, list(values))


def period_bars(df: DataFrame, key: str, frequency: str, value: str = "ret", index: str | None = None):
    """Compounded return, last date and last index value per day, ISO week or month."""
    data = df.where(F.col(value).isNotNull())
    buckets = {
        "daily": F.col("date").cast("string"),
        "weekly": F.concat_ws(
            "-", F.expr("extract(YEAROFWEEK from date)"), F.lpad(F.weekofyear("date").cast("string"), 2, "0")
        ),
        "monthly": F.date_format("date", "yyyy-MM"),
    }
    if frequency not in buckets:
        raise ValueError("frequency must be daily, weekly or monthly")
    aggs = [F.max("date").alias("date"), compound(value).alias("period_return")]
    if index:
        aggs.append(F.max_by(index, "date").alias(index))
    return data.groupBy(key, buckets[frequency].alias("bucket")).agg(*aggs)


def monthly_returns(df: DataFrame, key: str, value: str = "ret") -> DataFrame:
    return df.groupBy(key, month_start("date").alias("period")).agg(compound(value).alias(value))


def forward_monthly_returns(df: DataFrame, key: str, value: str = "ret") -> DataFrame:
    """Return of the calendar month after ``period``, for signals dated in ``period``."""
    monthly = monthly_returns(df, key, value)
    return monthly.select(
        key, F.add_months("period", -1).alias("period"), F.col(value).alias("forward_return")
    )


def month_closes(prices: DataFrame, key: str = "ticker") -> DataFrame:
    """Month-end bars: the last close of each series in each month."""
    return prices.groupBy(key, month_start("date").alias("date")).agg(F.max_by("close", "date").alias("close"))
