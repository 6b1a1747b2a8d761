"""Per-series window operators.

A series is identified by ``key`` and holds one row per date, so each window sorts at
most one calendar of rows.  Two kinds of frame are used:

* ``gaps="break"``: frames run over the shared calendar index, so a missing day leaves a
  hole and full-window statistics become NULL.  This equals laying the series out on
  the whole date axis without producing the absent rows.
* ``gaps="skip"``: frames run over the rows a series really has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.scalars import SQRT_YEAR, safe_corr
from .calendar import per_date

HORIZONS = (1, 3, 5, 10, 21, 63, 126, 252)
PANEL_WINDOWS = (1, 5, 21, 63, 252)


def frame(key, start: int, end: int, gaps: str = "skip") -> WindowSpec:
    keys = [key] if isinstance(key, str) else list(key)
    if gaps == "break":
        return Window.partitionBy(*keys).orderBy("idx").rangeBetween(start, end)
    if gaps == "skip":
        return Window.partitionBy(*keys).orderBy("date").rowsBetween(start, end)
    raise ValueError("gaps must be skip or break")


def _running(key) -> WindowSpec:
    keys = [key] if isinstance(key, str) else list(key)
    return Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)


def simple_returns(prices: DataFrame, calendar: DataFrame, key: str = "ticker") -> DataFrame:
    """close / previous close - 1, NULL unless both dates are neighbours on the calendar."""
    w = Window.partitionBy(key).orderBy("idx")
    adjacent = F.col("idx") - F.lag("idx").over(w) == 1
    return (
        prices.where("close is not null")
        .join(per_date(calendar.select("date", "idx")), "date")
        .withColumn("ret", F.when(adjacent, F.try_divide(F.col("close"), F.lag("close").over(w)) - 1))
    )


def guarded(stat: Column, value, w: WindowSpec, need: int) -> Column:
    """Window statistic that is NULL unless the frame holds ``need`` values."""
    return F.when(F.count(value).over(w) >= need, stat.over(w))


def horizon_return(value: str, h: int, key="ticker", gaps: str = "skip") -> Column:
    w = frame(key, -(h - 1), 0, gaps)
    return guarded(F.product(1 + F.col(value)), value, w, h) - 1


def with_horizon_returns(df: DataFrame, key: str, value: str = "ret", horizons=HORIZONS, gaps="skip"):
    return df.select("*", *[horizon_return(value, h, key, gaps).alias(f"ret_{h}") for h in horizons])


def with_zscores(df: DataFrame, key: str, value: str = "ret", horizons=HORIZONS, gaps="skip") -> DataFrame:
    """z of the h-day sum against its own trailing 252 observations (at least h of them).

    The yearly moments of each sum come from running totals of its deviations from
    the series mean (current minus the total 252 rows ago), so the cost per row does not
    depend on the window length.  With ``gaps="break"`` they use a range frame.
    """
    sums = df.select(
        "*",
        *[guarded(F.sum(value), value, frame(key, -(h - 1), 0, gaps), h).alias(f"__s{h}") for h in horizons],
    )
    if gaps == "break":
        year = frame(key, -251, 0, gaps)
        parts = []
        for h in horizons:
            s = F.col(f"__s{h}")
            parts += [F.count(s).over(year).alias(f"__n{h}"), F.avg(s).over(year).alias(f"__m{h}"), F.stddev_samp(s).over(year).alias(f"__d{h}")]
        stats = sums.select("*", *parts)
    else:
        stats = _yearly_moments(sums, key, horizons)
    zs = []
    for h in horizons:
        n, m, d = (F.col(f"__{p}{h}") for p in "nmd")
        zs.append(F.when((n >= h) & (d > 0), (F.col(f"__s{h}") - m) / d).alias(f"z_{h}"))
    return stats.select(*df.columns, *zs)


def _yearly_moments(sums: DataFrame, key: str, horizons, window: int = 252) -> DataFrame:
    whole, run = Window.partitionBy(key), _running(key)
    walk = Window.partitionBy(key).orderBy("date")
    out = sums.select(
        "*",
        *[F.avg(f"__s{h}").over(whole).alias(f"__c{h}") for h in horizons],
        *[F.var_pop(f"__s{h}").over(whole).alias(f"__v{h}") for h in horizons],
    )
    dev = lambda h: F.coalesce(F.col(f"__s{h}") - F.col(f"__c{h}"), F.lit(0.0))
    out = out.select(
        "*",
        *[F.count(f"__s{h}").over(run).alias(f"__k{h}") for h in horizons],
        *[F.sum(dev(h)).over(run).alias(f"__p{h}") for h in horizons],
        *[F.sum(dev(h) * dev(h)).over(run).alias(f"__q{h}") for h in horizons],
    )
    since = lambda p, h: F.col(f"__{p}{h}") - F.coalesce(F.lag(f"__{p}{h}", window).over(walk), F.lit(0))
    out = out.select("*", *[since(p, h).alias(f"__{p}w{h}") for h in horizons for p in "kpq"])
    cols = []
    for h in horizons:
        n, total, square = F.col(f"__kw{h}"), F.col(f"__pw{h}"), F.col(f"__qw{h}")
        var = F.try_divide(square - F.try_divide(total * total, n), n - 1)
        # differences of running totals leave rounding noise: below this it is a constant window
        flat = var <= F.lit(1e-13) * F.col(f"__v{h}")
        cols += [
            n.alias(f"__n{h}"),
            F.when(n > 0, F.col(f"__c{h}") + F.try_divide(total, n)).alias(f"__m{h}"),
            F.when((n > 1) & ~flat, F.sqrt(var)).alias(f"__d{h}"),
        ]
    return out.select(*sums.columns, *cols)


def cumulative_index(df: DataFrame, key, value: str = "ret", name: str = "cumulative_index") -> DataFrame:
    return df.withColumn(name, F.product(1 + F.col(value)).over(_running(key)))


def drawdown(df: DataFrame, key, equity: str = "equity", name: str = "drawdown") -> DataFrame:
    return df.withColumn(name, F.try_divide(F.col(equity), F.max(equity).over(_running(key))) - 1)


def trailing_rows(df: DataFrame, key, n: int, order: str = "date") -> DataFrame:
    keys = [key] if isinstance(key, str) else list(key)
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def shift(df: DataFrame, key, value: str, name: str, periods: int = 1) -> DataFrame:
    keys = [key] if isinstance(key, str) else list(key)
    return df.withColumn(name, F.lag(value, periods).over(Window.partitionBy(*keys).orderBy("date")))


def lag_autocorrelation(df: DataFrame, key: str, value: str = "ret", lag: int = 1) -> DataFrame:
    lagged = shift(df, key, value, "__lag", lag)
    return lagged.groupBy(key).agg(safe_corr(value, "__lag").alias("autocorrelation"))


def realized_volatility(df: DataFrame, key: str, value: str = "ret", lookback: int = 60, minimum: int = 20):
    """Annualised deviation of the last ``lookback`` rows and the last drawdown."""
    w = Window.partitionBy(key).orderBy(F.desc("date"))
    equity = cumulative_index(df, key, value, "equity")
    dd = drawdown(equity, key).withColumn("__n", F.row_number().over(w))
    return (
        dd.groupBy(key)
        .agg(
            F.count(value).alias("n"),
            (F.stddev_samp(F.when(F.col("__n") <= lookback, F.col(value))) * SQRT_YEAR).alias("v"),
            F.max(F.when(F.col("__n") == 1, F.col("drawdown"))).alias("d"),
        )
        .select(
            key,
            F.when(F.col("n") >= minimum, F.col("v")).alias("realized_volatility"),
            F.when(F.col("n") >= minimum, F.col("d")).alias("drawdown"),
        )
    )


def lagged_vol_target(
    df: DataFrame,
    key: str,
    value: str = "ret",
    *,
    target: float = 0.10,
    lookback: int = 60,
    max_leverage: float = 5.0,
    minimum: int | None = None,
    gaps: str = "skip",
    name: str = "scaled_return",
) -> DataFrame:
    """Scale to a target volatility with the estimate known the day before.

    The frame ends one row earlier.  ``minimum=None`` asks for a full window and
    drops the warm-up rows; otherwise ``minimum`` observations are enough and
    rows without an estimate stay NULL.
    """
    w = frame(key, -lookback, -1, gaps)
    need = lookback if minimum is None else minimum
    sd = guarded(F.stddev_samp(value), value, w, need)
    lever = F.when(sd == 0, F.lit(max_leverage)).otherwise(
        F.least(F.lit(max_leverage), F.lit(target) / (sd * SQRT_YEAR))
    )
    # least() skips NULLs, so the guard is repeated on the deviation itself.
    out = df.withColumn("__sd", sd).withColumn("leverage", F.when(F.col("__sd").isNotNull(), lever))
    out = out.withColumn(name, F.col("leverage") * F.col(value)).drop("__sd")
    return out.where(F.col(name).isNotNull()) if minimum is None else out


def default_minimum(window: int) -> int:
    return max(20, window // 2)
