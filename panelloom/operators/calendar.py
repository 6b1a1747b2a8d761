"""Trading calendar and as-of lookups.

The calendar has one row per date, so its windows are bounded by the number of days
ever traded, whatever the size of the price book.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import month_start


def trading_calendar(prices: DataFrame) -> DataFrame:
    """(date, idx, period, prev_date, next_date, is_month_end) of the shared date axis."""
    w = Window.orderBy("date")
    return (
        prices.select("date")
        .distinct()
        .select(
            "date",
            F.row_number().over(w).cast("long").alias("idx"),
            month_start("date").alias("period"),
            F.lag("date").over(w).alias("prev_date"),
            F.lead("date").over(w).alias("next_date"),
        )
        .withColumn(
            "is_month_end",
            F.coalesce(month_start("next_date") != F.col("period"), F.lit(True)),
        )
    )


def per_date(df: DataFrame) -> DataFrame:
    """Mark a table with one row per trading date (or month) for broadcast.

    Its size is bounded by the days ever traded (a century is 26,000 rows), whatever
    the number of securities, so the large side of the join need not be shuffled by date.
    """
    return F.broadcast(df)


def month_ends(
    calendar: DataFrame,
    mode: str = "backfill",
    max_months: int | None = None,
    earliest_change: str | None = None,
) -> DataFrame:
    """Last trading date per month: all (optionally the last N), only the newest, or,
    in ``auto`` mode, every month at or after the earliest corrected date."""
    if mode not in {"auto", "latest", "backfill"}:
        raise ValueError("mode must be auto, latest or backfill")
    ends = calendar.where("is_month_end").select("period", F.col("date").alias("month_end"), "idx")
    newest = Window.orderBy(F.desc("period"))
    numbered = ends.withColumn("__n", F.row_number().over(newest))
    if mode == "auto" and earliest_change is not None:
        numbered = numbered.where(F.col("month_end") >= F.lit(earliest_change).cast("date"))
    elif mode in {"auto", "latest"}:
        numbered = numbered.where("__n = 1")
    elif max_months is not None:
        numbered = numbered.where(F.col("__n") <= int(max_months))
    return numbered.drop("__n")


def as_of_backward(
    left: DataFrame,
    right: DataFrame,
    values: Sequence[str],
    *,
    by: Sequence[str] = (),
    on: str = "date",
) -> DataFrame:
    """Latest ``values`` of ``right`` at or before each ``on`` of ``left``.

    Union plus ``last(ignore nulls)``: one sort instead of a range join.  Only the
    distinct lookup keys are sorted, so duplicates on the left cost nothing there.
    Each key must hold one row per date on the right.
    """
    by = list(by)
    asked = left.select(*by, on).distinct().withColumn("__src", F.lit(1))
    known = right.select(*by, on, F.struct(*values).alias("__v")).withColumn("__src", F.lit(0))
    w = Window.partitionBy(*by).orderBy(on, "__src").rowsBetween(Window.unboundedPreceding, 0)
    filled = (
        known.unionByName(asked, allowMissingColumns=True)
        .withColumn("__v", F.last("__v", ignorenulls=True).over(w))
        .where("__src = 1")
        .select(*by, on, *[F.col(f"__v.{v}").alias(v) for v in values])
    )
    return left.join(filled, [*by, on], "left")


def next_trading_day(signals: DataFrame, calendar: DataFrame, on: str = "signal_date") -> DataFrame:
    """Add ``execution_date`` and its ``exec_idx``: the first date strictly after ``on``."""
    days = calendar.select(F.col("date").alias(on), F.struct("date", "idx").alias("__v"))
    asked = signals.select(on).distinct().withColumn("__q", F.lit(True))
    both = days.unionByName(asked, allowMissingColumns=True)
    strict = Window.orderBy(F.desc(on), F.col("__q").desc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    # Questions sort before the trading day of the same date, hence see later days only.
    answered = (
        both.withColumn("__n", F.last("__v", ignorenulls=True).over(strict))
        .where("__q")
        .select(on, F.col("__n.date").alias("execution_date"), F.col("__n.idx").alias("exec_idx"))
    )
    return signals.join(answered, on, "left")


def latest_per_key(df: DataFrame, keys: Sequence[str], order: str = "as_of", as_of=None) -> DataFrame:
    """Newest row per key (optionally at or before ``as_of``) with partial aggregation."""
    data = df if as_of is None else df.where(F.col(order) <= F.lit(as_of).cast("date"))
    rest = [c for c in df.columns if c not in keys]
    return (
        data.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.col(order)).alias("__v"))
        .select(*keys, *[F.col(f"__v.{c}").alias(c) for c in rest])
    )


def fill_prices(prices: DataFrame, dates: DataFrame, by: Sequence[str] = ("ticker",)) -> DataFrame:
    """Last close on or before each requested (key, date), else the first later one."""
    keys = list(by)
    back = Window.partitionBy(*keys).orderBy("date", "__src")
    ahead = Window.partitionBy(*keys).orderBy(F.desc("date"), F.desc("__src"))
    asked = dates.select(*keys, "date").distinct().withColumn("__src", F.lit(1))
    both = prices.select(*keys, "date", "close").withColumn("__src", F.lit(0)).unionByName(
        asked, allowMissingColumns=True
    )
    return (
        both.withColumn("__b", F.last("close", True).over(back.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("__a", F.last("close", True).over(ahead.rowsBetween(Window.unboundedPreceding, 0)))
        .where("__src = 1")
        .select(*keys, "date", F.coalesce("__b", "__a").alias("close"))
    )
