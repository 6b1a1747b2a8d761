"""Portfolio exposures, Euler risk split, attribution, limits and breaches.

All functions take many portfolios (and dates) at once: ``by`` names the columns that
identify one risk calculation.  Portfolio variance is built from its factor betas
(``b' O b`` plus specific variance), so the asset covariance matrix, quadratic in the
number of holdings, is never formed here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import safe_div
from .calendar import as_of_backward
from .forecasts import UNINFORMATIVE_ERROR


def holding_weights(holdings: DataFrame, prices: DataFrame, as_of: DataFrame) -> DataFrame:
    """(portfolio, as_of, ticker, weight, total_value).

    Given weights are normalised when every holding has one; otherwise shares times
    the last price at or before the date, holdings without a price left out.
    ``as_of(as_of)`` lists the dates.
    """
    flags = holdings.groupBy("portfolio").agg(
        (F.count("weight") == F.count(F.lit(1))).alias("all_weights"), F.sum("weight").alias("weight_sum")
    )
    h = holdings.join(flags, "portfolio").withColumn("explicit", F.col("all_weights") & (F.col("weight_sum") > 0))
    # one array of requested dates on every holding row: a parameter list
    dates = as_of.agg(F.array_sort(F.collect_set("as_of")).alias("__dates")).withColumn("__k", F.lit(1))
    grid = h.withColumn("__k", F.lit(1)).join(dates, "__k").withColumn("as_of", F.explode("__dates")).drop("__k", "__dates")
    asked = grid.where("not explicit").select("ticker", F.col("as_of").alias("date"))
    book = prices.join(asked.select("ticker").distinct(), "ticker", "left_semi")
    w = Window.partitionBy("ticker").orderBy("date", "__src").rowsBetween(Window.unboundedPreceding, 0)
    last = (
        book.select("ticker", "date", "close", F.lit(0).alias("__src"))
        .unionByName(asked.distinct().withColumn("__src", F.lit(1)), allowMissingColumns=True)
        .withColumn("close", F.last("close", True).over(w))
        .where("__src = 1")
        .select("ticker", F.col("date").alias("as_of"), "close")
    )
    valued = (
        grid.where("not explicit")
        .join(last, ["ticker", "as_of"], "left")
        .withColumn("value", F.coalesce("shares", F.lit(0.0)) * F.col("close"))
        .where("value is not null")
    )
    keys = ["portfolio", "as_of"]
    totals = valued.groupBy(*keys).agg(F.sum("value").alias("total_value")).where("total_value > 0")
    by_shares = valued.join(totals, keys).select(*keys, "ticker", (F.col("value") / F.col("total_value")).alias("weight"), "total_value")
    by_weight = grid.where("explicit").select(
        *keys, "ticker", (F.col("weight") / F.col("weight_sum")).alias("weight"), F.lit(None).cast("double").alias("total_value")
    )
    return by_shares.unionByName(by_weight)


def modelled_weights(weights: DataFrame, fits: DataFrame, by: Sequence[str], on: Sequence[str] = ("ticker",)):
    """Keep modelled holdings, rescale them to 1 and report the covered weight."""
    kept = weights.join(fits, list(on))
    cover = kept.groupBy(*by).agg(F.sum("weight").alias("coverage")).where("coverage > 0")
    return kept.join(cover, list(by)).withColumn("raw_weight", F.col("weight")).withColumn(
        "weight", F.col("weight") / F.col("coverage")
    )


def portfolio_betas(weights: DataFrame, exposures: DataFrame, by: Sequence[str], on: Sequence[str] = ("ticker",)):
    """Sum of weight times beta per factor."""
    w = weights.select(*dict.fromkeys([*by, *on]), "weight")
    e = exposures.select(*on, "factor", "beta")
    return w.join(e, list(on)).groupBy(*by, "factor").agg(F.sum(F.col("weight") * F.col("beta")).alias("exposure"))


def specific_variance(weights: DataFrame, by: Sequence[str], vol: str = "residual_volatility") -> DataFrame:
    return weights.groupBy(*by).agg(
        F.sum(F.pow(F.col("weight") * F.coalesce(F.col(vol), F.lit(0.0)), 2)).alias("specific_variance")
    )


def concentration(weights: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sum of squares, largest name and largest sector weight."""
    sector = weights.groupBy(*by, "sector").agg(
        F.sum("weight").alias("s"), F.sum(F.col("weight") * F.col("weight")).alias("h"), F.max("weight").alias("m")
    )
    return sector.groupBy(*by).agg(
        F.sum("h").alias("concentration"), F.max("m").alias("stock_weight"), F.max("s").alias("sector_weight")
    )


def _packed_matrix(omega: DataFrame, on: Sequence[str]) -> DataFrame:
    """One row per matrix: array of (factor, {factor: value}); size set by the catalog."""
    rows = omega.groupBy(*on, "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "value"))).alias("m"))
    return rows.groupBy(*on).agg(F.collect_list(F.struct(F.col("row").alias("factor"), "m")).alias("__omega"))


def factor_marginals(betas: DataFrame, omega: DataFrame, by: Sequence[str], omega_by: Sequence[str] = (), value="exposure"):
    """(by, factor, exposure, marginal) with marginal = row of O times the betas.

    ``betas(by, factor, exposure)`` and ``omega(omega_by, row, col, value)``; factors of the
    matrix without a beta count as 0.  K rows per portfolio, not K squared.
    """
    packed = betas.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("factor", value))).alias("__b"))
    if omega_by:
        joined = packed.join(_packed_matrix(omega, omega_by), list(omega_by))
    else:
        joined = packed.withColumn("__k", F.lit(1)).join(_packed_matrix(omega.withColumn("__k", F.lit(1)), ["__k"]), "__k")
    wide = joined.select(*by, "__b", F.explode("__omega").alias("__o")).select(*by, "__b", "__o.factor", "__o.m")
    product = F.aggregate(
        F.map_entries("m"),
        F.lit(0.0),
        lambda acc, e: acc + e["value"] * F.coalesce(F.element_at(F.col("__b"), e["key"]), F.lit(0.0)),
    )
    return wide.select(
        *by,
        "factor",
        F.coalesce(F.element_at(F.col("__b"), F.col("factor")), F.lit(0.0)).alias(value),
        product.alias("marginal"),
    )


def decompose(betas: DataFrame, specific: DataFrame, omega: DataFrame, by: Sequence[str], omega_by: Sequence[str] = ()):
    """Total rows: (by, factor_variance, specific_variance, predicted_variance, predicted_volatility)."""
    marg = factor_marginals(betas, omega, by, omega_by)
    return _totals(marg, specific, by)


def _totals(marg: DataFrame, specific: DataFrame, by: Sequence[str]) -> DataFrame:
    fv = marg.groupBy(*by).agg(F.sum(F.col("exposure") * F.col("marginal")).alias("factor_variance"))
    total = F.col("factor_variance") + F.col("specific_variance")
    return (
        fv.join(specific, list(by))
        .withColumn("predicted_variance", total)
        .withColumn("predicted_volatility", F.sqrt(F.greatest(total, F.lit(0.0))))
        .withColumn("specific_contribution", safe_div("specific_variance", "predicted_volatility"))
        .withColumn("specific_risk_percent", safe_div("specific_variance", "predicted_variance"))
    )


def euler_split(betas: DataFrame, specific: DataFrame, omega: DataFrame, by: Sequence[str], omega_by: Sequence[str] = ()):
    """Factor rows whose contributions, with the specific one, add up to the volatility."""
    marg = factor_marginals(betas, omega, by, omega_by)
    totals = _totals(marg, specific, by)
    comp = F.col("exposure") * F.col("marginal")
    vol = F.col("predicted_volatility")
    return marg.join(totals, list(by)).select(
        *by,
        "factor",
        "exposure",
        F.col("marginal").alias("factor_marginal"),
        comp.alias("factor_component"),
        safe_div(F.col("marginal"), vol).alias("marginal_risk"),
        safe_div(comp, vol).alias("contribution"),
        safe_div(safe_div(comp, vol), vol).alias("risk_percent"),
        safe_div(comp, F.col("factor_variance")).alias("factor_percent"),
        "factor_variance",
        "specific_variance",
        "predicted_volatility",
        "specific_contribution",
    )


def risk_rows(split: DataFrame, by: Sequence[str]) -> DataFrame:
    """Display rows ordered by contribution, the specific row last; percents of volatility."""
    factors = split.select(*by, F.col("factor").alias("name"), "contribution", "predicted_volatility", F.lit(False).alias("is_specific"))
    specific = split.groupBy(*by).agg(
        F.max("specific_contribution").alias("contribution"), F.max("predicted_volatility").alias("predicted_volatility")
    )
    rows = factors.unionByName(
        specific.withColumn("name", F.lit("Specific")).withColumn("is_specific", F.lit(True))
    )
    # catalog size plus one row per portfolio
    w = Window.partitionBy(*by).orderBy("is_specific", F.col("contribution").desc(), "name")
    return rows.select(
        *by,
        "name",
        "contribution",
        safe_div(100 * F.col("contribution"), "predicted_volatility").alias("percent"),
        "is_specific",
        F.row_number().over(w).alias("position"),
    )


def attribution(betas: DataFrame, factor_returns: DataFrame, weights: DataFrame, asset_returns: DataFrame, by: Sequence[str], on=("ticker",), when: Sequence[str] = ()):
    """Realised return split into factor contributions and a residual.

    ``when`` names the columns (a period) shared by ``by`` and both return tables.
    Returns (by, realized_return, factor_return, residual_contribution, contributions map).
    """
    f = betas.join(factor_returns.withColumnRenamed("ret", "__fr"), ["factor", *when])
    fr = f.withColumn("c", F.col("exposure") * F.col("__fr")).groupBy(*by).agg(
        F.sum("c").alias("factor_return"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("factor", "c")))).alias("contributions"),
    )
    a = weights.join(asset_returns.withColumnRenamed("ret", "__ar"), [*on, *[c for c in when if c not in on]], "left")
    real = a.groupBy(*by).agg(F.sum(F.col("weight") * F.coalesce("__ar", F.lit(0.0))).alias("realized_return"))
    return real.join(fr, list(by)).withColumn("residual_contribution", F.col("realized_return") - F.col("factor_return"))


def active_risk(betas: DataFrame, benchmark: DataFrame, specific: DataFrame, omega: DataFrame, by: Sequence[str], omega_by: Sequence[str] = ()):
    """(by, tracking_error): exposures minus the benchmark's, plus specific variance."""
    b = benchmark.withColumnRenamed("beta", "__bm")
    shared = [c for c in by if c in b.columns]
    active = betas.join(b, [*shared, "factor"], "left").withColumn(
        "exposure", F.col("exposure") - F.coalesce("__bm", F.lit(0.0))
    ).drop("__bm")
    marg = factor_marginals(active, omega, by, omega_by)
    var = marg.groupBy(*by).agg(F.sum(F.col("exposure") * F.col("marginal")).alias("v"))
    return var.join(specific, list(by)).select(
        *by, F.sqrt(F.greatest(F.col("v") + F.col("specific_variance"), F.lit(0.0))).alias("tracking_error")
    ), active


def portfolio_daily_returns(weights: DataFrame, returns: DataFrame, by: Sequence[str]) -> DataFrame:
    """Fixed-weight daily return; assets missing on a day contribute nothing."""
    return (
        weights.select(*by, "ticker", "weight")
        .join(returns.where("ret is not null"), "ticker")
        .groupBy(*by, "date")
        .agg(F.sum(F.col("weight") * F.col("ret")).alias("ret"))
    )


def unpivot_metrics(snapshot: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    return snapshot.unpivot(list(by), list(metrics), "metric", "value").withColumn("factor", F.lit(""))


def evaluate_limits(metrics: DataFrame, limits: DataFrame, on: Sequence[str] = ("portfolio",)) -> DataFrame:
    """Slack of each limit: the smaller distance to its bounds; unknown values are skipped.

    ``metrics(on, [as_of], metric, factor, value)``; factor is ``''`` except for factor metrics.
    """
    rows = metrics.where("value is not null").join(limits, [*on, "metric", "factor"])
    low = F.col("value") - F.col("lower_bound")
    high = F.col("upper_bound") - F.col("value")
    return rows.withColumn("slack", F.least(low, high)).withColumn("breached", F.coalesce(F.col("slack") < 0, F.lit(False)))


def breach_episodes(evaluations: DataFrame, keys: Sequence[str], order: str = "as_of") -> DataFrame:
    """One row per run of consecutive breached dates of a limit.

    A later breach refreshes the open event; the first date back inside resolves it.
    """
    w = Window.partitionBy(*keys).orderBy(order)  # one row per evaluated date
    runs = (
        evaluations.withColumn("__b", F.col("breached").cast("int"))
        .withColumn("__start", ((F.col("__b") == 1) & (F.coalesce(F.lag("__b").over(w), F.lit(0)) == 0)).cast("int"))
        .withColumn("__run", F.sum("__start").over(w))
        .withColumn("__ok", F.when(F.col("__b") == 0, F.col(order)))
        .where("__run > 0")
    )
    return (
        runs.groupBy(*keys, "__run")
        .agg(
            F.min(F.when(F.col("__b") == 1, F.col(order))).alias("opened"),
            F.max(F.when(F.col("__b") == 1, F.col(order))).alias("last_breach"),
            F.max_by(F.when(F.col("__b") == 1, F.col("value")), F.when(F.col("__b") == 1, F.col(order))).alias("observed_value"),
            F.max_by(F.when(F.col("__b") == 1, F.col("slack")), F.when(F.col("__b") == 1, F.col(order))).alias("slack"),
            F.min("__ok").alias("resolved"),
        )
        .withColumn("status", F.when(F.col("resolved").isNull(), "open").otherwise("resolved"))
        .drop("__run")
    )


def holdings_matrix(weights: DataFrame, fits: DataFrame, exposures: DataFrame, factors, keys: Sequence[str] = ("ticker",)):
    """(portfolio, ticker, factor, beta): NULL for unmodelled names, 0 for unselected factors."""
    grid = weights.withColumn("factor", F.explode(factors))
    known = fits.select(*keys).distinct().withColumn("__m", F.lit(True))
    e = exposures.select(*keys, "factor", "beta")
    return (
        grid.join(known, list(keys), "left")
        .join(e, [*keys, "factor"], "left")
        .withColumn("beta", F.when(F.col("__m"), F.coalesce("beta", F.lit(0.0))))
        .drop("__m")
    )


def weighted_fit_quality(modelled: DataFrame, by: Sequence[str], value: str = "adjusted_r2") -> DataFrame:
    """Weighted mean over modelled weight, and the weight covered."""
    w = F.col("raw_weight")
    return modelled.groupBy(*by).agg(
        F.sum(w).alias("covered_weight"), (F.sum(w * F.col(value)) / F.sum(w)).alias(f"weighted_{value}")
    )


def restate_contributions(df: DataFrame, column: str, volatility: str) -> DataFrame:
    """Map of variance contributions -> volatility contributions."""
    return df.withColumn(column, F.transform_values(column, lambda k, v: safe_div(v, F.col(volatility))))




def limits_in_force(metrics: DataFrame, limits: DataFrame, on: str = "as_of", keys: Sequence[str] = ("portfolio", "metric", "factor")) -> DataFrame:
    """Known metrics with the limit that holds on their date: slack and breach as in :func:`evaluate_limits`.

    ``limits(keys, lower_bound, upper_bound, valid_from, valid_to)``; of several started limits the newest counts, and none after its
    ``valid_to``.  The interval is found by an as-of lookup on its start, and its end is checked on the row found, so no range join is needed.
    """
    starts = limits.select(*keys, F.col("valid_from").alias(on), "lower_bound", "upper_bound", "valid_to", F.lit(True).alias("limited"))
    found = as_of_backward(metrics.where("value is not null"), starts, ["lower_bound", "upper_bound", "valid_to", "limited"], by=keys, on=on)
    held = found.where(F.col("limited") & (F.col("valid_to").isNull() | (F.col(on) <= F.col("valid_to")))).drop("valid_to", "limited")
    slack = F.least(F.col("value") - F.col("lower_bound"), F.col("upper_bound") - F.col("value"))
    return held.withColumn("slack", slack).withColumn("breached", F.coalesce(slack < 0, F.lit(False)))


def breach_states(evaluations: DataFrame, on: str = "as_of", keys: Sequence[str] = ("portfolio", "metric", "factor")) -> DataFrame:
    """``evaluations`` with ``state``: open, update or resolved against the limit's evaluation before; null where nothing is breached."""
    before = F.coalesce(F.lag("breached").over(Window.partitionBy(*keys).orderBy(on)), F.lit(False))  # one row per evaluated date
    state = F.when(F.col("breached") & before, "update").when(F.col("breached"), "open").when(before, "resolved")
    return evaluations.withColumn("state", state)


def risk_inputs(
    members: DataFrame,
    fits: DataFrame,
    exposures: DataFrame,
    factors: DataFrame,
    rates: DataFrame,
    benchmark: DataFrame,
    *,
    by: Sequence[str] = ("portfolio",),
    on: str = "as_of",
    default_rate: float = 0.0,
    missing: str = "raise",
) -> DataFrame:
    """What a risk run needs of every member at every signal date, one row per design factor.

    ``members(by, on, ticker)`` for all runs at once; ``fits(ticker, as_of, residual_volatility)`` and ``exposures(ticker, as_of, factor,
    beta, standard_error)`` are looked up at the newest fit on or before the date, ``rates(date, annualized_rate)`` likewise (else
    ``default_rate``).  Factors of the design (``factors(factor)``, a catalog) that a fit left out have a beta of 0 and an uninformative
    standard error.  A member without any fit raises, or with ``missing="flag"`` keeps null betas.  ``benchmark(factor, beta)`` is set beside.
    """
    if missing not in ("raise", "flag"):
        raise ValueError(f"unknown treatment of missing fits: {missing}")
    known = fits.select("ticker", F.col("as_of").alias(on), F.col("as_of").alias("fit_as_of"), "residual_volatility")
    rows = as_of_backward(members.select(*by, on, "ticker"), known, ["fit_as_of", "residual_volatility"], by=["ticker"], on=on)
    rate = as_of_backward(members.select(on).distinct(), rates.select(F.col("date").alias(on), "annualized_rate"), ["annualized_rate"], on=on)
    rows = rows.join(rate, on).withColumn("annualized_rate", F.coalesce("annualized_rate", F.lit(float(default_rate)))).withColumn("has_fit", F.col("fit_as_of").isNotNull())
    if missing == "raise":
        problem = F.raise_error(F.concat(F.lit("no stock model on or before "), F.col(on).cast("string"), F.lit(" for "), F.col("ticker")))
        rows = rows.withColumn("has_fit", F.when(F.col("has_fit"), F.lit(True)).otherwise(problem.cast("boolean")))
    design = factors.select("factor").distinct().join(benchmark.select("factor", F.col("beta").alias("benchmark_beta")), "factor", "left")
    packed = design.agg(F.collect_list(F.struct("factor", F.coalesce("benchmark_beta", F.lit(0.0)).alias("benchmark_beta"))).alias("__f")).withColumn("__k", F.lit(1))
    grid = rows.withColumn("__k", F.lit(1)).join(packed, "__k").select(*rows.columns, F.explode("__f").alias("__d")).select(*rows.columns, "__d.factor", "__d.benchmark_beta")
    e = exposures.select("ticker", F.col("as_of").alias("fit_as_of"), "factor", "beta", "standard_error")
    return grid.join(e, ["ticker", "fit_as_of", "factor"], "left").withColumn("beta", F.when(F.col("has_fit"), F.coalesce("beta", F.lit(0.0)))).withColumn(
        "standard_error", F.coalesce("standard_error", F.lit(UNINFORMATIVE_ERROR)))
