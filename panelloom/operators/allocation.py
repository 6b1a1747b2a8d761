"""Risk matrices, closed-form allocations, bounds and constraint audit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import ranked
from ..functions.scalars import dot
from .risk import factor_marginals

BUDGET_TOLERANCE = 1e-5
BOUND_TOLERANCE = 1e-7
MAX_NAMES = 2000
OBJECTIVES = ("min_variance", "mean_variance", "max_sharpe", "max_diversification")


def bounded_names(df: DataFrame, by: Sequence[str], limit: int = MAX_NAMES) -> DataFrame:
    """Fail when a matrix would hold more than ``limit`` names.

    A dense matrix is quadratic in its names; wider portfolios are served by the factor
    form of the risk functions, which never builds one.
    """
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    checked = sizes.where(
        F.assert_true(F.col("__n") <= limit, F.lit(f"more than {limit} names in one risk matrix")).isNull()
    )
    return df.join(checked.drop("__n"), list(by), "left_semi")


def filled_specific(specific: DataFrame, by: Sequence[str], vol: str = "residual_volatility") -> DataFrame:
    """Missing residual volatilities take the median of their portfolio."""
    med = specific.groupBy(*by).agg(F.median(vol).alias("__med"))
    return specific.join(med, list(by)).withColumn(vol, F.coalesce(vol, "__med")).drop("__med")


def factor_risk_matrix(
    exposures: DataFrame,
    omega: DataFrame,
    specific: DataFrame,
    *,
    by: Sequence[str],
    omega_by: Sequence[str] = (),
    correlation: DataFrame | None = None,
    shrinkage: float = 0.8,
) -> DataFrame:
    """B O B' + D per portfolio as (by, row, col, value).

    D mixes the diagonal of specific variances with correlated residual risk:
    ``s * diag + (1 - s) * corr o (sigma sigma')``; without ``correlation(row, col, value)``
    it is the diagonal.  ``exposures(by, ticker, factor, beta)``.
    """
    by = list(by)
    e = exposures.select(*by, "ticker", "factor", F.col("beta").alias("exposure"))
    marg = factor_marginals(e, omega, [*by, "ticker"], omega_by)
    vectors = marg.groupBy(*by, "ticker").agg(
        F.array_sort(F.collect_list(F.struct("factor", "exposure", "marginal"))).alias("v")
    )
    sig = filled_specific(specific, by).select(*by, "ticker", F.col("residual_volatility").alias("sigma"))
    names = bounded_names(
        vectors.join(sig, [*by, "ticker"]).select(
            *by, "ticker", "sigma", F.col("v.exposure").alias("b"), F.col("v.marginal").alias("g")
        ),
        by,
    )
    columns = names.groupBy(*by).agg(F.collect_list(F.struct(F.col("ticker").alias("col"), F.col("b").alias("b2"), F.col("sigma").alias("sigma2"))).alias("__all"))
    cells = (
        names.join(columns, by)
        .select(*by, F.col("ticker").alias("row"), "g", "sigma", F.explode("__all").alias("__c"))
        .select(*by, "row", "__c.col", dot("g", "__c.b2").alias("common"), (F.col("sigma") * F.col("__c.sigma2")).alias("ss"))
    )
    same = F.col("row") == F.col("col")
    diagonal = F.when(same, F.col("ss")).otherwise(F.lit(0.0))
    if correlation is None:
        return cells.select(*by, "row", "col", (F.col("common") + diagonal).alias("value"))
    on = [c for c in [*by, "row", "col"] if c in correlation.columns]
    mixed = cells.join(correlation.select(*on, F.col("value").alias("rho")), on, "left")
    empirical = F.coalesce("rho", F.lit(0.0)) * F.col("ss")
    return mixed.select(
        *by, "row", "col", (F.col("common") + shrinkage * diagonal + (1 - shrinkage) * empirical).alias("value")
    )


def gershgorin_floor(matrix: DataFrame, by: Sequence[str]) -> DataFrame:
    """Lower bound of the smallest eigenvalue; non-negative means certainly PSD."""
    same = F.col("row") == F.col("col")
    rows = matrix.groupBy(*by, "row").agg(
        (F.sum(F.when(same, F.col("value")).otherwise(F.lit(0.0))) - F.sum(F.when(same, F.lit(0.0)).otherwise(F.abs("value")))).alias("low")
    )
    return rows.groupBy(*by).agg(F.min("low").alias("eigenvalue_floor"), F.count(F.lit(1)).alias("size"))


def effective_bounds(
    names: DataFrame,
    *,
    mode: str = "absolute",
    min_weight: float = 0.0,
    max_weight: float = 0.15,
    cap: float | None = None,
    by: Sequence[str] = ("portfolio",),
) -> DataFrame:
    """Add lower, upper and ``feasible`` (bounds valid and a budget of 1 reachable).

    ``relative`` bounds are distances from the column ``previous``.
    """
    if mode == "absolute":
        low, high = F.lit(float(min_weight)), F.lit(float(max_weight))
    elif mode == "relative":
        if min_weight < 0 or max_weight < 0:
            raise ValueError("relative distances must be non-negative")
        low = F.greatest(F.lit(0.0), F.col("previous") - min_weight)
        high = F.least(F.lit(1.0), F.col("previous") + max_weight)
        if cap is not None:
            high = F.least(high, F.lit(float(cap)))
    else:
        raise ValueError(f"unknown bound mode: {mode}")
    b = names.withColumn("lower", low).withColumn("upper", high)
    ok = F.bool_and((F.col("lower") >= 0) & (F.col("upper") <= 1) & (F.col("lower") <= F.col("upper")))
    sums = b.groupBy(*by).agg((ok & (F.sum("lower") <= 1 + 1e-9) & (F.sum("upper") >= 1 - 1e-9)).alias("feasible"))
    return b.join(sums, list(by))


def equal_weights(names: DataFrame, by: Sequence[str] = ("portfolio",)) -> DataFrame:
    n = names.groupBy(*by).agg((1.0 / F.count(F.lit(1))).alias("equal_weight"))
    return names.join(n, list(by))


def greedy_max_return(names: DataFrame, by: Sequence[str] = ("portfolio",)) -> DataFrame:
    """Optimal weights for maximum forecast under box bounds and a full budget.

    Lower bounds first, then the remaining budget in forecast order.
    ``names(by, ticker, expected_return, lower, upper)``.
    """
    room = names.withColumn("room", F.col("upper") - F.col("lower"))
    left = names.groupBy(*by).agg((1 - F.sum("lower")).alias("__left"))
    walked = ranked(room, by, "expected_return", "ticker", running="room")
    fill = F.greatest(F.lit(0.0), F.least(F.col("room"), F.col("__left") - F.col("running")))
    return walked.join(left, list(by)).withColumn("optimized_weight", F.col("lower") + fill).select(
        *names.columns, "optimized_weight"
    )


def ex_ante(
    names: DataFrame,
    exposures: DataFrame,
    omega: DataFrame,
    *,
    by: Sequence[str],
    omega_by: Sequence[str] = (),
    weight: str = "weight",
) -> DataFrame:
    """Per name: marginal and component risk, and the portfolio's totals, in factor form.

    Covariance with the portfolio is ``b_i . (O b_p) + w_i s_i^2``, so cost is linear in names.
    ``names(by, ticker, weight, previous, expected_return, residual_volatility)``.
    """
    by = list(by)
    w = names.select(*by, "ticker", F.col(weight).alias("__w"))
    e = exposures.select(*by, "ticker", "factor", "beta")
    pb = w.join(e, [*by, "ticker"]).groupBy(*by, "factor").agg(F.sum(F.col("__w") * F.col("beta")).alias("exposure"))
    marg = factor_marginals(pb, omega, by, omega_by)
    common = (
        e.join(marg.select(*by, "factor", "marginal"), [*by, "factor"])
        .groupBy(*by, "ticker")
        .agg(F.sum(F.col("beta") * F.col("marginal")).alias("__c"))
    )
    own = F.coalesce(F.col("residual_volatility"), F.lit(0.0))
    rows = names.join(common, [*by, "ticker"], "left").withColumn(
        "__cov", F.coalesce("__c", F.lit(0.0)) + F.col(weight) * own * own
    )
    totals = rows.groupBy(*by).agg(
        F.sum(F.col(weight) * F.col("__cov")).alias("variance"),
        F.sum(F.col(weight) * F.coalesce("expected_return", F.lit(0.0))).alias("portfolio_return"),
        F.sum(F.abs(F.col(weight) - F.coalesce("previous", F.lit(0.0)))).alias("turnover"),
    )
    vol = F.sqrt(F.greatest(F.col("variance"), F.lit(0.0)))
    return (
        rows.join(totals, by)
        .withColumn("expected_volatility", vol)
        .withColumn("marginal_risk", F.col("__cov") / F.greatest(vol, F.lit(1e-16)))
        .withColumn("component_risk", F.col(weight) * F.col("marginal_risk"))
        .withColumn("risk_contribution", F.col(weight) * F.col("__cov") / F.greatest(F.col("variance"), F.lit(1e-16)))
        .drop("__c", "__cov")
    )


_BOUND = "array<struct<name: string, lower: double, upper: double>>"
_SETTINGS = f"sectors {_BOUND}, bounds {_BOUND}, relative {_BOUND}, benchmark map<string, double>, caps array<struct<name: string, maximum: double>>, omega array<struct<factor: string, row: map<string, double>>>"


def _settings(weights: DataFrame, sector_bounds, factor_bounds, relative_factor_bounds, benchmark_betas, component_caps, omega) -> DataFrame:
    """All settings of an audit as one row: its lists are as long as the catalog of factors or sectors, which the driver may hold."""
    bounds = lambda df, name: [] if df is None else [(r[0], r[1], r[2]) for r in df.select(name, "lower", "upper").collect()]
    benchmark = None if benchmark_betas is None else {r[0]: r[1] for r in benchmark_betas.select("factor", "beta").collect()}
    caps = [] if component_caps is None else [(r[0], r[1]) for r in component_caps.select("factor", "maximum").collect()]
    rows: dict[str, dict[str, float]] = {}
    for r in [] if omega is None else omega.select("row", "col", "value").collect():
        rows.setdefault(r[0], {})[r[1]] = r[2]
    one = (bounds(sector_bounds, "sector"), bounds(factor_bounds, "factor"), bounds(relative_factor_bounds, "factor"), benchmark, caps, list(rows.items()))
    return weights.sparkSession.createDataFrame([one], _SETTINGS)


def audit(
    weights: DataFrame,
    *,
    by: Sequence[str] = ("portfolio",),
    exposures: DataFrame | None = None,
    omega: DataFrame | None = None,
    sector_bounds: DataFrame | None = None,
    factor_bounds: DataFrame | None = None,
    relative_factor_bounds: DataFrame | None = None,
    benchmark_betas: DataFrame | None = None,
    turnover_cap: float | None = None,
    max_factor_variance: float | None = None,
    component_caps: DataFrame | None = None,
    tracking_error_limit: float | None = None,
) -> DataFrame:
    """Slack of every constraint as (by, kind, name, slack, violated).

    ``weights(by, ticker, sector, weight, previous, lower, upper, residual_volatility)``;
    bound tables hold (sector | factor, lower, upper), caps (factor, maximum),
    ``benchmark_betas(factor, beta)`` without which the previous weights are the benchmark.

    One pass over the weights adds up what all constraints need, by kind and name; a portfolio's sums are then a few maps on one
    row, from which its slacks are exploded.  Name bounds are read off the weights themselves.
    """
    by = list(by)
    zero = F.lit(0.0)
    part = lambda kind, name, value, prior=zero: F.struct(F.lit(kind).alias("kind"), name.alias("name"), value.cast("double").alias("value"), prior.cast("double").alias("prior"))
    none = F.lit("")
    move = F.col("weight") if benchmark_betas is not None else F.col("weight") - F.col("previous")
    parts = F.array(
        part("budget", none, F.col("weight")), part("turnover", none, F.abs(F.col("weight") - F.col("previous"))), part("sector", F.col("sector"), F.col("weight")),
        part("specific", none, F.pow(move * F.coalesce("residual_volatility", zero), 2)))
    rows = weights
    if exposures is not None:
        shared = [c for c in [*by, "ticker"] if c in exposures.columns]
        betas = exposures.groupBy(*shared).agg(F.map_from_entries(F.collect_list(F.struct("factor", "beta"))).alias("__b"))
        rows = weights.join(betas, shared, "left")
        entries = F.map_entries(F.coalesce("__b", F.create_map().cast("map<string, double>")))
        parts = F.concat(parts, F.transform(entries, lambda e: part("factor", e["key"], F.col("weight") * e["value"], F.col("previous") * e["value"])))
    long = rows.select(*by, F.explode(parts).alias("p")).select(*by, "p.*").groupBy(*by, "kind", "name").agg(F.sum("value").alias("value"), F.sum("prior").alias("prior"))
    scalar = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("value")))
    table = lambda kind, column: F.map_from_entries(F.collect_list(F.when((F.col("kind") == kind) & F.col("name").isNotNull(), F.struct("name", column))))
    sums = long.groupBy(*by).agg(
        scalar("budget").alias("w"), scalar("turnover").alias("t"), scalar("specific").alias("s"),
        table("sector", "value").alias("in_sector"), table("factor", "value").alias("exposure"), table("factor", "prior").alias("prior"))
    settings = _settings(weights, sector_bounds, factor_bounds, relative_factor_bounds, benchmark_betas, component_caps, omega)
    j = sums.join(F.broadcast(settings))  # one row beside each portfolio's

    slack = lambda kind, name, value, tolerance: F.struct(F.lit(kind).alias("kind"), name.alias("name"), value.cast("double").alias("slack"), F.lit(tolerance).alias("tolerance"))
    get = lambda m, key: F.coalesce(F.try_element_at(m, key), zero)
    held = lambda bounds: F.filter(bounds, lambda b: F.map_contains_key(F.col("exposure"), b["name"]))
    both = lambda bounds, kind, value: F.flatten(F.transform(bounds, lambda b: F.array(
        slack(f"{kind}_minimum", b["name"], value(b["name"]) - b["lower"], BUDGET_TOLERANCE), slack(f"{kind}_maximum", b["name"], b["upper"] - value(b["name"]), BUDGET_TOLERANCE))))
    against = F.col("prior") if benchmark_betas is None else F.col("benchmark")
    gap = lambda f: get(F.col("exposure"), f) - get(against, f)
    out = [F.array(slack("fully_invested", none, F.lit(BUDGET_TOLERANCE) - F.abs(F.col("w") - 1), 0.0))]
    if turnover_cap is not None:
        out.append(F.array(slack("turnover_cap", none, F.lit(float(turnover_cap)) - F.col("t"), BUDGET_TOLERANCE)))
    if sector_bounds is not None:
        out.append(both(F.col("sectors"), "sector", lambda name: get(F.col("in_sector"), name)))
    if exposures is not None:
        out.append(both(held(F.col("bounds")), "factor", lambda name: get(F.col("exposure"), name)))
        out.append(both(held(F.col("relative")), "relative_factor", gap))
    if exposures is not None and omega is not None:
        marginal = lambda value: lambda o: F.aggregate(F.map_entries(o["row"]), zero, lambda a, e: a + e["value"] * value(e["key"]))
        quadratic = lambda value: F.aggregate("omega", zero, lambda a, o: a + value(o["factor"]) * marginal(value)(o))
        own = lambda f: get(F.col("exposure"), f)
        active = lambda f: F.when(F.map_contains_key(F.col("exposure"), f), gap(f)).otherwise(zero)
        modelled = F.size("exposure") > 0
        rest = []
        if max_factor_variance is not None:
            rest.append(F.array(slack("factor_variance", none, F.lit(float(max_factor_variance)) - quadratic(own), BUDGET_TOLERANCE)))
        if component_caps is not None:
            cap = lambda o: F.filter("caps", lambda c: c["name"] == o["factor"])
            rest.append(F.flatten(F.transform("omega", lambda o: F.transform(cap(o), lambda c: slack("factor_component", c["name"], c["maximum"] - F.abs(own(o["factor"]) * marginal(own)(o)), BUDGET_TOLERANCE)))))
        if tracking_error_limit is not None:
            rest.append(F.array(slack("tracking_error", none, F.lit(float(tracking_error_limit) ** 2) - quadratic(active) - F.col("s"), BUDGET_TOLERANCE)))
        out += [F.when(modelled, r).otherwise(F.filter(r, lambda x: F.lit(False))) for r in rest]
    found = j.select(*by, F.explode(F.concat(*out)).alias("c")).select(*by, "c.*")
    names = weights.select(*by, F.explode(F.array(
        slack("minimum_weight", F.col("ticker"), F.col("weight") - F.col("lower"), BOUND_TOLERANCE), slack("maximum_weight", F.col("ticker"), F.col("upper") - F.col("weight"), BOUND_TOLERANCE))).alias("c")).select(*by, "c.*")
    return found.unionByName(names).withColumn("violated", F.col("slack") < -F.col("tolerance")).drop("tolerance")


def exposure_comparison(original: DataFrame, optimized: DataFrame, bounds: DataFrame | None, by: Sequence[str]) -> DataFrame:
    """Union of both exposure maps with 0 defaults, the change and an in-bounds flag."""
    o = original.select(*by, "factor", F.col("exposure").alias("original"), F.lit(0.0).alias("optimized"))
    n = optimized.select(*by, "factor", F.lit(0.0).alias("original"), F.col("exposure").alias("optimized"))
    both = o.unionByName(n).groupBy(*by, "factor").agg(F.sum("original").alias("original"), F.sum("optimized").alias("optimized"))
    both = both.withColumn("change", F.col("optimized") - F.col("original"))
    if bounds is None:
        return both
    return both.join(bounds, "factor", "left").withColumn(
        "within", F.col("optimized").between(F.col("lower") - 1e-6, F.col("upper") + 1e-6)
    )


def sector_totals(holdings: DataFrame, bounds: DataFrame | None, by: Sequence[str]) -> DataFrame:
    """Original and optimised weight per sector; blank sectors are ``Unclassified``."""
    sector = F.when(F.coalesce(F.col("sector"), F.lit("")) == "", "Unclassified").otherwise(F.col("sector"))
    t = (
        holdings.withColumn("sector", sector)
        .groupBy(*by, "sector")
        .agg(
            F.sum(F.coalesce("original_weight", F.lit(0.0))).alias("original"),
            F.sum(F.coalesce("optimized_weight", F.lit(0.0))).alias("optimized"),
        )
        .withColumn("change", F.col("optimized") - F.col("original"))
    )
    if bounds is None:
        return t
    return t.join(bounds, "sector", "left").withColumn(
        "within", F.col("optimized").between(F.col("lower") - 1e-6, F.col("upper") + 1e-6)
    )


def study_rollup(variants: DataFrame, by: Sequence[str]) -> DataFrame:
    return variants.groupBy(*by).agg(
        F.count(F.lit(1)).alias("variant_count"),
        F.count_if(F.col("status") == "succeeded").alias("succeeded_count"),
    )


