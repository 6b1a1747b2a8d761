"""Shrinkage of means, betas and premia toward priors; closed forms over aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNINFORMATIVE_ERROR = 1_000_000.0
DOUBLE_EPSILON = 2.220446049250313e-16


def shrink_means(
    df: DataFrame,
    entity: str = "ticker",
    value: str = "ret",
    *,
    by: Sequence[str] = (),
    annualization: int = 252,
    min_observations: int = 60,
    prior_mean: float | None = None,
    prior_variance: float | None = None,
) -> DataFrame:
    """Annualised sample means pulled to a precision-weighted common mean.

    Prior variance: cross-sectional variance of the raw means less their average
    sampling variance, floored at 0.  Entities below ``min_observations`` raise.
    """
    group = list(by) or ["__all"]
    data = df if by else df.withColumn("__all", F.lit(0))
    n = F.count(value)
    raw = data.groupBy(*group, entity).agg(
        n.alias("observations"),
        (F.avg(value) * annualization).alias("raw_expected_return"),
        F.try_divide(F.var_samp(value) * float(annualization**2), n).alias("sampling_variance"),
    )
    raw = raw.withColumn(
        "observations",
        F.when(F.col("observations") >= min_observations, F.col("observations")).otherwise(
            F.raise_error(F.concat(F.lit("insufficient observations: "), F.col(entity).cast("string"))).cast("long")
        ),
    )
    precision = 1.0 / F.greatest(F.col("sampling_variance"), F.lit(DOUBLE_EPSILON))
    m = F.sum(F.col("raw_expected_return") * precision) / F.sum(precision)
    v = F.greatest(F.var_samp("raw_expected_return") - F.avg("sampling_variance"), F.lit(0.0))
    prior = raw.groupBy(*group).agg(
        (m if prior_mean is None else F.lit(float(prior_mean))).alias("prior_mean"),
        (v if prior_variance is None else F.lit(float(prior_variance))).alias("prior_variance"),
    )
    total = F.col("prior_variance") + F.col("sampling_variance")
    return (
        raw.join(prior, group)
        .withColumn("shrinkage_weight", F.when(total > 0, F.col("prior_variance") / total).otherwise(F.lit(0.0)))
        .withColumn(
            "expected_return",
            F.col("prior_mean") + F.col("shrinkage_weight") * (F.col("raw_expected_return") - F.col("prior_mean")),
        )
        .drop("__all")
    )


def shrink_betas(exposures: DataFrame, *, by: Sequence[str] = (), max_informative_error: float = 1.0, prior_variance: DataFrame | None = None):
    """Pull each factor's betas to 0; tau2 = mean(beta^2 - se^2) over informative errors.

    ``exposures(by, ticker, factor, beta, standard_error)``; ``prior_variance(factor,
    prior_variance)`` replaces the estimate.
    """
    if max_informative_error <= 0:
        raise ValueError("max_informative_error must be positive")
    informative = F.col("standard_error") < max_informative_error
    moment = F.col("beta") * F.col("beta") - F.col("standard_error") * F.col("standard_error")
    counts = exposures.groupBy(*by, "factor").agg(
        F.greatest(F.coalesce(F.avg(F.when(informative, moment)), F.lit(0.0)), F.lit(0.0)).alias("prior_variance"),
        F.count(F.when(informative, F.lit(1))).alias("informative_count"),
    )
    if prior_variance is not None:
        counts = counts.drop("prior_variance").join(prior_variance, "factor")
    total = F.col("prior_variance") + F.col("standard_error") * F.col("standard_error")
    out = exposures.join(counts, [*by, "factor"]).withColumn(
        "shrinkage_weight", F.when(total > 0, F.col("prior_variance") / total).otherwise(F.lit(0.0))
    )
    return out.withColumn("raw_beta", F.col("beta")).withColumn("beta", F.col("raw_beta") * F.col("shrinkage_weight"))


def shrink_premia(
    factor_returns: DataFrame,
    priors: DataFrame,
    *,
    by: Sequence[str] = (),
    annualization: int = 252,
    prior_dispersion: float = 0.03,
    min_observations: int = 252,
) -> DataFrame:
    """Blend trailing factor means with assumed premia ``priors(factor, assumption)``.

    Columns are those of the diagnostics table: premium, assumption, historical_mean,
    historical_standard_error, history_weight, observations.  A prior without history, or with too little, raises.
    """
    if prior_dispersion < 0:
        raise ValueError("prior_dispersion must be non-negative")
    n = F.count("ret")
    sample = (
        factor_returns.join(priors, "factor", "left_semi")
        .groupBy(*by, "factor")
        .agg(
            n.alias("observations"),
            (F.avg("ret") * annualization).alias("historical_mean"),
            F.try_divide(F.stddev_samp("ret") * annualization, F.sqrt(n.cast("double"))).alias("historical_standard_error"),
        )
    )
    tau2 = float(prior_dispersion) ** 2
    total = F.lit(tau2) + F.pow("historical_standard_error", 2)
    out = priors.join(sample, "factor", "left").withColumn(
        "history_weight", F.when(total > 0, F.lit(tau2) / total).otherwise(F.lit(0.0))
    )
    fault = F.when(F.col("observations").isNull(), "unknown factor premium: ").otherwise("insufficient factor history: ")
    blend = F.col("assumption") + F.col("history_weight") * (F.col("historical_mean") - F.col("assumption"))
    return out.withColumn(
        "premium",
        F.when(F.col("observations") >= min_observations, blend).otherwise(F.raise_error(F.concat(fault, F.col("factor"))).cast("double")),
    )


def factor_implied_returns(
    exposures: DataFrame, premia: DataFrame, *, stocks: DataFrame | None = None, by: Sequence[str] = (), risk_free_rate: float = 0.0, shrink: bool = False
):
    """Sum of beta times premium plus cash; betas optionally shrunk first.

    One row per (by, ticker) of ``stocks`` (default: of the exposures); one without a priced exposure expects the
    cash rate.  A premium of a factor that no stock is exposed to raises.
    """
    e = shrink_betas(exposures, by=by) if shrink else exposures
    keys = [*by, "ticker"]
    on = [c for c in [*by, "factor"] if c in premia.columns]
    held = exposures.select("factor").distinct().withColumn("__held", F.lit(True))
    premium = F.when(F.col("__held"), F.col("premium")).otherwise(
        F.raise_error(F.concat(F.lit("unknown factor premium: "), F.col("factor"))).cast("double")
    )
    priced = premia.join(held, "factor", "left").select(*on, premium.alias("premium"))
    sums = e.join(priced, on, "left").groupBy(*keys).agg(F.sum(F.col("beta") * F.col("premium")).alias("__sum"))
    rows = sums if stocks is None else stocks.select(*keys).distinct().join(sums, keys, "left")
    return rows.select(*keys, (F.coalesce("__sum", F.lit(0.0)) + F.lit(float(risk_free_rate))).alias("expected_return"))


def equal_sharpe_returns(variances: DataFrame, *, risk_free_rate: float = 0.0, common_sharpe: float = 0.5):
    """cash + k * volatility from ``variances(..., ticker, variance)``."""
    if common_sharpe <= 0:
        raise ValueError("common_sharpe must be positive")
    fine = (F.col("variance") > 0) & (F.col("variance") < F.lit(float("inf")))
    vol = F.when(fine, F.sqrt("variance")).otherwise(
        F.raise_error(F.concat(F.lit("variance must be positive and finite: "), F.col("ticker"))).cast("double")
    )
    return variances.withColumn("volatility", vol).withColumn(
        "expected_return", F.lit(float(risk_free_rate)) + F.lit(float(common_sharpe)) * F.col("volatility")
    )


def historical_means(returns: DataFrame, entity: str = "ticker", *, by: Sequence[str] = (), annualization: int = 252):
    return returns.groupBy(*by, entity).agg((F.avg("ret") * annualization).alias("expected_return"))


def forecast_dispersion(expected: DataFrame, by: Sequence[str]) -> DataFrame:
    """Population deviation of the forecasts and a flag for a flat cross-section."""
    d = F.stddev_pop("expected_return")
    return expected.groupBy(*by).agg(d.alias("dispersion"), (d <= 1e-10).alias("is_flat"))


def assert_finite_unique(df: DataFrame, keys: Sequence[str], values: Sequence[str], name: str, *, allow_null: bool = False) -> DataFrame:
    """Validation row: raises on duplicate keys, infinities, NaN, or (optionally) NULLs."""
    bad = F.lit(False)
    for v in values:
        c = F.col(v).cast("double")
        bad = bad | F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(False))
        if not allow_null:
            bad = bad | c.isNull()
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("c"), F.count_if(bad).alias("b"))
    totals = per_key.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("rows"),
        F.count_if(F.col("c") > 1).alias("duplicate_keys"),
        F.coalesce(F.sum("b"), F.lit(0)).alias("bad_values"),
    )
    check = lambda cond, msg: F.assert_true(cond, F.lit(f"{name}: {msg}"))
    return totals.select(
        "rows",
        F.when(check(F.col("rows") > 0, "no rows").isNull(), F.col("duplicate_keys")).alias("duplicate_keys"),
        F.when(
            check((F.col("duplicate_keys") == 0) & (F.col("bad_values") == 0), "duplicate labels or non-finite values").isNull(),
            F.col("bad_values"),
        ).alias("bad_values"),
    )
