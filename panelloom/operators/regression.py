"""Rolling regressions, factor stripping and robust single-factor inference."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import NORMAL_975, SQRT_YEAR, all_present, dot, two_sided_p
from .bars import weekly_returns
from .returns import frame, guarded, lagged_vol_target

WINDOW_WEEKS = 156


def rolling_slope(df: DataFrame, key: str, y: str, x: str, window: int, name: str = "beta") -> DataFrame:
    """Slope of y on x (with intercept) over the last ``window`` rows, full windows only."""
    return df.withColumn(name, guarded(F.regr_slope(y, x), y, frame(key, -(window - 1), 0), window))


def _weekly_betas(weekly: DataFrame, key: str, k: int, window: int) -> DataFrame:
    """(key, week, betas): rolling slopes, or one static slope when history is short."""
    if k == 1:
        whole = Window.partitionBy(key)
        roll = whole.orderBy("week").rowsBetween(-(window - 1), 0)
        n = F.count(F.lit(1)).over(whole)
        rolled = F.when(F.count(F.lit(1)).over(roll) >= window, F.regr_slope("y", "x0").over(roll))
        beta = F.when(n >= window, rolled).otherwise(F.regr_slope("y", "x0").over(whole))
        return weekly.select(key, "week", F.when(beta.isNotNull(), F.array(beta)).alias("betas"))

    columns = [f"x{i}" for i in range(k)]
    key_type = weekly.schema[key].dataType.simpleString()

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        from ..functions.kernels import rolling_betas

        pdf = pdf.sort_values("week")
        size = window if len(pdf) >= window else len(pdf)
        betas = rolling_betas(pdf["y"].to_numpy(), pdf[columns].to_numpy(), size)
        if len(pdf) < window:
            betas[:] = betas[-1]
        packed = [None if row[0] != row[0] else row.tolist() for row in betas]
        return pd.DataFrame({key: pdf[key], "week": pdf["week"], "betas": packed})

    # A group is one series' weeks: bounded by the calendar.
    return weekly.groupBy(key).applyInPandas(fit, f"{key} {key_type}, week date, betas array<double>")


def strip_design(
    design: DataFrame,
    k: int,
    *,
    key: str = "factor",
    window_weeks: int = WINDOW_WEEKS,
    beta_timing: str = "same_friday",
) -> DataFrame:
    """Remove rolling exposures from daily returns.

    ``design(key, date, y, x array<double>)``; rows with any missing value are
    ignored.  Betas come from Friday-compounded returns (intercept fitted but left in the
    residual).  A day uses the newest Friday at or before it, the days before the
    first beta use that first one and are flagged ``is_warmup``.  ``next_week``
    delays every beta by one week.
    """
    if beta_timing not in {"same_friday", "next_week"}:
        raise ValueError("beta_timing must be same_friday or next_week")
    complete = design.where(F.col("y").isNotNull() & all_present("x"))
    flat = complete.select(key, "date", "y", *[F.col("x")[i].alias(f"x{i}") for i in range(k)])
    weekly = weekly_returns(flat, key, ["y", *[f"x{i}" for i in range(k)]])
    betas = _weekly_betas(weekly, key, k, window_weeks)
    if beta_timing == "next_week":
        betas = betas.withColumn("betas", F.lag("betas").over(Window.partitionBy(key).orderBy("week")))
    events = complete.select(key, "date", "y", "x", F.lit(1).alias("__src")).unionByName(
        betas.select(key, F.col("week").alias("date"), "betas", F.lit(0).alias("__src")),
        allowMissingColumns=True,
    )
    w = Window.partitionBy(key).orderBy("date", "__src")
    first = F.first("betas", True).over(
        Window.partitionBy(key).orderBy("date", "__src").rowsBetween(
            Window.unboundedPreceding, Window.unboundedFollowing
        )
    )
    held = F.last("betas", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return (
        events.withColumn("__held", held)
        .withColumn("__b", F.coalesce("__held", first))
        .where("__src = 1")
        .select(
            key,
            "date",
            F.col("__b").alias("betas"),
            (F.col("y") - dot("__b", "x")).alias("ret"),
            F.col("__held").isNull().alias("is_warmup"),
        )
    )


def build_stripped(design: DataFrame, k: int, *, key: str = "factor", beta_timing="same_friday", **scale):
    """Strip (when there are regressors) and scale to the target volatility."""
    if k:
        pure = strip_design(design, k, key=key, beta_timing=beta_timing).select(key, "date", "ret")
    else:
        pure = design.where("y is not null").select(key, "date", F.col("y").alias("ret"))
    return lagged_vol_target(pure, key, "ret", **scale).select(
        key, "date", F.col("scaled_return").alias("ret")
    )


def rolling_purify(df: DataFrame, key: str, y: str, x: str, window: int = 126, minimum: int = 63) -> DataFrame:
    """One-parent residual including the intercept, over a calendar-index window.

    Rows where either value is missing take no part and get no residual.
    """
    w = frame(key, -(window - 1), 0, "break")
    pair = df.where(F.col(y).isNotNull() & F.col(x).isNotNull())
    # frames start at the first date of the whole axis, hence the calendar position test
    enough = (F.count(F.lit(1)).over(w) >= minimum) & (F.col("idx") >= minimum)
    resid = F.col(y) - F.regr_intercept(y, x).over(w) - F.regr_slope(y, x).over(w) * F.col(x)
    return pair.withColumn("residual", F.when(enough, resid))


def mean_with_hac(df: DataFrame, key: str, value: str, maximum: int, divisor: int | None = None, order: str = "date") -> DataFrame:
    """Robust t and p of a mean with ``maximum`` lags, or with ``floor(n / divisor)`` where that is fewer."""
    lags = F.lit(maximum) if divisor is None else F.least(F.lit(maximum), F.floor(F.col("n") / divisor))
    w = Window.partitionBy(key).orderBy(order)
    stats = df.where(F.col(value).isNotNull()).groupBy(key).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean")
    )
    e = df.where(F.col(value).isNotNull()).join(stats, key).withColumn("__e", F.col(value) - F.col("mean"))
    lagged = e.select(
        key, "n", "mean", "__e", *[F.lag("__e", i).over(w).alias(f"__l{i}") for i in range(1, maximum + 1)]
    )
    sums = lagged.groupBy(key, "n", "mean").agg(
        F.sum(F.col("__e") * F.col("__e")).alias("g0"),
        *[F.coalesce(F.sum(F.col("__e") * F.col(f"__l{i}")), F.lit(0.0)).alias(f"g{i}") for i in range(1, maximum + 1)],
    )
    sums = sums.withColumn("__lags", lags.cast("int"))
    meat = F.col("g0")
    for i in range(1, maximum + 1):
        weight = F.greatest(1 - F.lit(float(i)) / (F.col("__lags") + 1), F.lit(0.0))
        meat = meat + 2 * weight * F.col(f"g{i}")
    out = sums.withColumn("se", F.sqrt(meat) / F.col("n"))
    return out.select(
        key,
        "n",
        "mean",
        "se",
        F.try_divide("mean", "se").alias("t_stat"),
        two_sided_p(F.try_divide("mean", "se")).alias("p_value"),
    )


def single_factor_fit(df: DataFrame, keys, y: str, x: str, *, lags: int = 5, min_obs: int = 60) -> DataFrame:
    """OLS of y on one regressor with Bartlett-weighted robust inference, per group.

    Two aggregations over the group keys: moments, then lagged score products.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    data = df.where(F.col(y).isNotNull() & F.col(x).isNotNull()).select(
        *keys, "date", F.col(y).alias("y"), F.col(x).alias("x")
    )
    fit = (
        data.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("x").alias("mx"),
            F.avg("y").alias("my"),
            F.var_pop("x").alias("vx"),
            F.var_pop("y").alias("vy"),
            F.covar_pop("x", "y").alias("cxy"),
        )
        .where((F.col("n") >= min_obs) & (F.col("vx") > 0))
        .withColumn("beta", F.col("cxy") / F.col("vx"))
        .withColumn("alpha", F.col("my") - F.col("beta") * F.col("mx"))
        .withColumn("rss", F.col("n") * (F.col("vy") - F.col("beta") * F.col("cxy")))
    )
    w = Window.partitionBy(*keys).orderBy("date")
    # u: score of the intercept, v: score of the slope with the regressor centred.
    scored = (
        data.join(fit.select(*keys, "alpha", "beta", "mx"), keys)
        .withColumn("u", F.col("y") - F.col("alpha") - F.col("beta") * F.col("x"))
        .withColumn("v", F.col("u") * (F.col("x") - F.col("mx")))
    )
    steps = range(1, lags + 1)
    lagged = scored.select(
        *keys, "u", "v",
        *[F.lag("u", i).over(w).alias(f"u{i}") for i in steps],
        *[F.lag("v", i).over(w).alias(f"v{i}") for i in steps],
    )
    uu, uv, vv = F.sum(F.col("u") * F.col("u")), F.sum(F.col("u") * F.col("v")), F.sum(F.col("v") * F.col("v"))
    nz = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    for i in steps:
        b = 1 - i / (lags + 1.0)
        uu = uu + 2 * b * nz(F.col("u") * F.col(f"u{i}"))
        vv = vv + 2 * b * nz(F.col("v") * F.col(f"v{i}"))
        uv = uv + b * nz(F.col("u") * F.col(f"v{i}") + F.col("v") * F.col(f"u{i}"))
    meat = lagged.groupBy(*keys).agg(uu.alias("muu"), uv.alias("muv"), vv.alias("mvv"))
    sxx = F.col("n") * F.col("vx")
    var_b = F.col("mvv") / (sxx * sxx)
    var_a = (
        F.col("muu") / (F.col("n") * F.col("n"))
        - 2 * F.col("mx") * F.col("muv") / (F.col("n") * sxx)
        + F.col("mx") * F.col("mx") * var_b
    )
    out = fit.join(meat, keys).withColumn("se", F.sqrt(var_b)).withColumn("alpha_se", F.sqrt(var_a))
    r2 = 1 - F.try_divide(F.col("rss"), F.col("n") * F.col("vy"))
    return out.select(
        *keys,
        F.col("n").alias("observation_count"),
        "alpha",
        "alpha_se",
        "beta",
        F.col("se").alias("standard_error"),
        F.try_divide("beta", "se").alias("t_stat"),
        two_sided_p(F.try_divide("beta", "se")).alias("p_value"),
        (F.col("beta") - NORMAL_975 * F.col("se")).alias("ci_low"),
        (F.col("beta") + NORMAL_975 * F.col("se")).alias("ci_high"),
        (1 - (1 - r2) * (F.col("n") - 1) / (F.col("n") - 2)).alias("adjusted_r2"),
        (F.sqrt(F.col("rss") / (F.col("n") - 1)) * SQRT_YEAR).alias("residual_volatility"),
        F.lit("Fixed-model OLS/HAC").alias("inference_method"),
    )
