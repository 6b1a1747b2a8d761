"""Registered queries: risk matrices, bounds, allocations, audit and comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import allocation as K
from ..operators import risk
from ..operators.factor_allocation import factor_allocation
from ..operators.forecasts import factor_implied_returns
from . import fixtures as X
from .oracle import query, view
from .queries_risk import BY, benchmark_betas, correlation, modelled, omega, premia

view(
    "names",
    "SELECT m.portfolio, m.period, m.ticker, m.sector, m.weight AS previous, m.residual_volatility, e.expected_return FROM modelled m JOIN (SELECT f.ticker, f.period, coalesce(sum(x.beta * p.premium), 0) + 0.02e0 AS expected_return FROM fits f LEFT JOIN exposures x USING (ticker, period) LEFT JOIN premia p USING (factor) GROUP BY 1, 2) e USING (ticker, period)",
    "modelled", "fits", "exposures", "premia",
)
view(
    "bounded",
    """SELECT *, bool_and(lower >= 0 AND upper <= 1 AND lower <= upper) OVER g AND sum(lower) OVER g <= 1 + 1e-9 AND sum(upper) OVER g >= 1 - 1e-9 AS feasible FROM (SELECT *, greatest(0, previous - 0.03e0) AS lower, least(least(1, previous + 0.05e0), 0.12e0) AS upper FROM names) WINDOW g AS (PARTITION BY portfolio, period)""",
    "names",
)
view(
    "greedy",
    """SELECT *, lower + greatest(0, least(upper - lower, 1 - sum(lower) OVER (PARTITION BY portfolio, period) - coalesce(sum(upper - lower) OVER (PARTITION BY portfolio, period ORDER BY expected_return DESC, ticker ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS weight FROM bounded""",
    "bounded",
)


@X.stored
def names(spark, sf):
    e = factor_implied_returns(X.exposures(spark, sf), premia(spark, sf), stocks=X.fits(spark, sf), by=["period"], risk_free_rate=0.02)
    return modelled(spark, sf).select(*BY, "ticker", "sector", F.col("weight").alias("previous"), "residual_volatility").join(e, ["period", "ticker"])


def bounded(spark, sf):
    return K.effective_bounds(names(spark, sf), mode="relative", min_weight=0.03, max_weight=0.05, cap=0.12, by=BY)


@X.stored
def greedy(spark, sf):
    return K.greedy_max_return(bounded(spark, sf), BY).withColumnRenamed("optimized_weight", "weight")


@query("effective_bounds", "K6", "portfolio period:d ticker lower:8 upper:8 feasible:b", "SELECT * FROM bounded", "bounded")
def _(spark, sf):
    return bounded(spark, sf)


@query("greedy_max_return", "K4", "portfolio period:d ticker weight:8", "SELECT * FROM greedy", "greedy")
def _(spark, sf):
    return greedy(spark, sf)


def _exposures(spark, sf):
    return modelled(spark, sf).select(*BY, "ticker").join(X.exposures(spark, sf).select("ticker", "period", "factor", "beta"), ["ticker", "period"])


view(
    "asset_cov",
    """SELECT a.portfolio, a.period, a.ticker AS row, b.ticker AS col, a.residual_volatility * b.residual_volatility AS ss, coalesce(c.common, 0) AS common FROM modelled a JOIN modelled b ON a.portfolio = b.portfolio AND a.period = b.period
    LEFT JOIN (SELECT e.period, e.ticker AS r, f.ticker AS c2, sum(e.beta * o.value * f.beta) AS common FROM exposures e JOIN omega o ON o.row = e.factor JOIN exposures f ON f.period = e.period AND f.factor = o.col GROUP BY 1, 2, 3) c ON c.period = a.period AND c.r = a.ticker AND c.c2 = b.ticker""",
    "modelled", "exposures", "omega",
)
view(
    "sigma",
    "SELECT portfolio, period, row, col, common + 0.8e0 * CASE WHEN row = col THEN ss ELSE 0 END + 0.2e0 * coalesce(value, 0) * ss AS value FROM asset_cov LEFT JOIN rho USING (row, col)",
    "asset_cov", "rho",
)


@X.stored
def sigma(spark, sf):
    return K.factor_risk_matrix(_exposures(spark, sf), omega(spark, sf), modelled(spark, sf).select(*BY, "ticker", "residual_volatility"), by=BY, correlation=correlation(spark, sf))


@query("factor_risk_matrix", "K1 A20 K3", "portfolio period:d row col value:3", "SELECT * FROM sigma", "sigma")
def _(spark, sf):
    return sigma(spark, sf)


@query(
    "psd_floor", "K2", "portfolio period:d eigenvalue_floor:3 size:i",
    "SELECT portfolio, period, min(low) AS eigenvalue_floor, count(*) AS size FROM (SELECT portfolio, period, row, sum(CASE WHEN row = col THEN value ELSE -abs(value) END) AS low FROM sigma GROUP BY 1, 2, 3) GROUP BY 1, 2", "sigma",
)
def _(spark, sf):
    return K.gershgorin_floor(sigma(spark, sf), BY)


@query("median_residual_volatility", "A20", "portfolio period:d filled:5", "SELECT portfolio, period, median(residual_volatility) AS filled FROM modelled WHERE ticker <> 'NATION_3' GROUP BY 1, 2", "modelled")
def _(spark, sf):
    hidden = modelled(spark, sf).withColumn("residual_volatility", F.when(F.col("ticker") != "NATION_3", F.col("residual_volatility")))
    return K.filled_specific(hidden, BY).groupBy(*BY).agg(F.median("residual_volatility").alias("filled"))


@X.stored
def allocations(spark, sf):
    b = K.effective_bounds(names(spark, sf), max_weight=0.15, by=BY)
    return factor_allocation(b, _exposures(spark, sf), omega(spark, sf), by=BY, risk_free_rate=0.02)


@query("allocation_grid", "K5 K3", "portfolio period:d objective ticker optimized_weight:6 status")
def _(spark, sf):
    return allocations(spark, sf)


@query(
    "allocation_kkt", "K5 K1", "portfolio period:d objective names:i status budget_ok:b inside:b optimal:b",
    """SELECT portfolio, period, objective, names, CASE WHEN ok THEN 'succeeded' ELSE 'fallback_equal' END AS status, true AS budget_ok, CASE WHEN ok THEN true END AS inside, CASE WHEN ok THEN true END AS optimal FROM (
    SELECT portfolio, period, objective, names, 0.15e0 * names >= 1 - 1e-9 AND (objective <> 'max_sharpe' OR best > 0.02e0) AS ok FROM (
    SELECT portfolio, period, count(*) AS names, sum(expected_return * greatest(0, least(0.15e0, 1 - 0.15e0 * (r - 1)))) AS best FROM (SELECT *, row_number() OVER (PARTITION BY portfolio, period ORDER BY expected_return DESC) AS r FROM names) GROUP BY 1, 2)
    CROSS JOIN (VALUES ('min_variance'), ('mean_variance'), ('max_sharpe'), ('max_diversification')) v(objective))""",
    "names",
)
def _(spark, sf):
    """First-order conditions of every solve: no name that can give weight has a higher gradient than one that can take it."""
    keys = [*BY, "objective"]
    w = allocations(spark, sf).join(names(spark, sf).drop("previous"), [*BY, "ticker"]).withColumn("previous", F.lit(0.0))
    e, o = _exposures(spark, sf), omega(spark, sf)
    own = risk.factor_marginals(e.withColumnRenamed("beta", "exposure"), o, [*BY, "ticker"]).groupBy(*BY, "ticker").agg(F.sum(F.col("exposure") * F.col("marginal")).alias("common"))
    every = w.select(*keys, "ticker").join(e, [*BY, "ticker"])
    g = K.ex_ante(w, every, o, by=keys, weight="optimized_weight").join(own, [*BY, "ticker"], "left")
    alone = F.sqrt(F.coalesce("common", F.lit(0.0)) + F.col("residual_volatility") * F.col("residual_volatility"))
    vol, cov = F.col("expected_volatility"), F.col("marginal_risk") * F.col("expected_volatility")
    sums = g.groupBy(*keys).agg(F.sum(F.col("optimized_weight") * alone).alias("alone_sum"))
    kind = lambda *values: F.coalesce(*[F.when(F.col("objective") == o, v) for o, v in zip(("min_variance", "mean_variance", "max_sharpe", "max_diversification"), values)])
    # the gradient downhill; that of a ratio times its volatility
    price = kind(F.lit(1.0), F.lit(1.0), (F.col("portfolio_return") - 0.02) / vol / vol, F.col("alone_sum") / vol / vol)
    gain = kind(F.lit(0.0), F.col("expected_return"), F.col("expected_return"), alone)
    rows = g.join(sums, keys).withColumn("slope", price * cov - gain).withColumn("scale", F.abs(price * cov) + F.abs(gain))
    x, gives = F.col("optimized_weight"), F.col("optimized_weight") > 1e-7
    out = rows.groupBy(*keys, "status").agg(
        F.count("*").alias("names"), (F.abs(F.sum(x) - 1) < 1e-7).alias("budget_ok"), F.bool_and(x.between(-1e-9, 0.15 + 1e-9)).alias("inside"),
        (F.max(F.when(gives, F.col("slope"))) - F.min(F.when(x < 0.15 - 1e-7, F.col("slope"))) <= 1e-5 * F.max("scale")).alias("optimal"))
    solved = F.col("status") == "succeeded"
    return out.withColumn("inside", F.when(solved, F.col("inside"))).withColumn("optimal", F.when(solved, F.coalesce("optimal", F.lit(True))))


view(
    "ex_ante",
    """SELECT *, sqrt(variance) AS vol, cov / sqrt(variance) AS marginal_risk, weight * cov / sqrt(variance) AS component_risk, weight * cov / variance AS risk_contribution FROM (SELECT *, sum(weight * cov) OVER g AS variance, sum(weight * expected_return) OVER g AS portfolio_return, sum(abs(weight - previous)) OVER g AS turnover FROM (
    SELECT g.*, c + weight * residual_volatility * residual_volatility AS cov FROM greedy g JOIN (SELECT a.portfolio, a.period, a.row, sum(a.common * w.weight) AS c FROM asset_cov a JOIN greedy w ON w.portfolio = a.portfolio AND w.period = a.period AND w.ticker = a.col GROUP BY 1, 2, 3) x ON x.portfolio = g.portfolio AND x.period = g.period AND x.row = g.ticker) WINDOW g AS (PARTITION BY portfolio, period))""",
    "greedy", "asset_cov",
)


def ex_ante(spark, sf):
    return K.ex_ante(greedy(spark, sf), _exposures(spark, sf), omega(spark, sf), by=BY)


@query(
    "ex_ante", "K8", "portfolio period:d ticker marginal_risk:4 component_risk:5 risk_contribution:6 expected_volatility:4 portfolio_return:6 turnover:6",
    "SELECT *, vol AS expected_volatility FROM ex_ante", "ex_ante",
)
def _(spark, sf):
    return ex_ante(spark, sf)


_SECTOR_BOUNDS = (("ASIA", 0.1, 0.25), ("EUROPE", 0.0, 0.15))
_FACTOR_BOUNDS = (("STANDARD", -0.05, 0.05), ("PROMO", -0.1, 0.1))


def _table(spark, sf, rows, name):
    """Configuration rows, carried by the dimension of the given tables that names them."""
    source = X.securities(spark, sf).select(F.col("sector").alias(name)) if name == "sector" else X.factor_monthly(spark, sf).select(name)
    look = lambda i: F.coalesce(*[F.when(F.col(name) == r[0], F.lit(r[i])) for r in rows])
    return source.distinct().where(F.col(name).isin([r[0] for r in rows])).withColumn("lower", look(1)).withColumn("upper", look(2))


_V = lambda rows: "(VALUES " + ", ".join(f"('{a}', {b}e0, {c}e0)" for a, b, c in rows) + ") v(name, lo, hi)"
view("opt_betas", "SELECT portfolio, period, factor, sum(weight * beta) AS exposure, sum(previous * beta) AS prior FROM greedy JOIN exposures USING (ticker, period) GROUP BY 1, 2, 3", "greedy", "exposures")
_QUAD = "SELECT a.portfolio, a.period, sum(a.x * o.value * b.x) AS v FROM {t} a JOIN omega o ON o.row = a.factor JOIN {t} b ON b.portfolio = a.portfolio AND b.period = a.period AND b.factor = o.col GROUP BY 1, 2"
view("opt_x", "SELECT portfolio, period, factor, exposure AS x FROM opt_betas", "opt_betas")
view("opt_active", "SELECT portfolio, period, factor, exposure - coalesce(beta, 0) AS x FROM opt_betas LEFT JOIN bench_fit USING (factor)", "opt_betas", "bench_fit")
view(
    "audit",
    f"""SELECT portfolio, period, 'fully_invested' AS kind, '' AS name, 1e-5 - abs(sum(weight) - 1) AS slack, 0.0e0 AS tol FROM greedy GROUP BY 1, 2
    UNION ALL SELECT portfolio, period, 'minimum_weight', ticker, weight - lower, 1e-7 FROM greedy UNION ALL SELECT portfolio, period, 'maximum_weight', ticker, upper - weight, 1e-7 FROM greedy
    UNION ALL SELECT portfolio, period, 'turnover_cap', '', 0.6e0 - sum(abs(weight - previous)), 1e-5 FROM greedy GROUP BY 1, 2
    UNION ALL SELECT p.portfolio, p.period, unnest(['sector_minimum', 'sector_maximum']), name, unnest([coalesce(w, 0) - lo, hi - coalesce(w, 0)]), 1e-5 FROM (SELECT DISTINCT portfolio, period FROM greedy) p CROSS JOIN {_V(_SECTOR_BOUNDS)} LEFT JOIN (SELECT portfolio, period, sector, sum(weight) AS w FROM greedy GROUP BY 1, 2, 3) s ON s.portfolio = p.portfolio AND s.period = p.period AND s.sector = name
    UNION ALL SELECT portfolio, period, unnest(['factor_minimum', 'factor_maximum']), factor, unnest([exposure - lo, hi - exposure]), 1e-5 FROM opt_betas JOIN {_V(_FACTOR_BOUNDS)} ON name = factor
    UNION ALL SELECT portfolio, period, unnest(['relative_factor_minimum', 'relative_factor_maximum']), factor, unnest([x - lo, hi - x]), 1e-5 FROM opt_active JOIN {_V(_FACTOR_BOUNDS)} ON name = factor
    UNION ALL SELECT portfolio, period, 'factor_variance', '', 5.0e0 - v, 1e-5 FROM ({_QUAD.format(t='opt_x')})
    UNION ALL SELECT portfolio, period, 'factor_component', factor, hi - abs(exposure * m), 1e-5 FROM (SELECT a.portfolio, a.period, a.factor, max(a.exposure) AS exposure, sum(o.value * b.exposure) AS m FROM opt_betas a JOIN omega o ON o.row = a.factor JOIN opt_betas b ON b.portfolio = a.portfolio AND b.period = a.period AND b.factor = o.col GROUP BY 1, 2, 3) JOIN {_V(_FACTOR_BOUNDS)} ON name = factor
    UNION ALL SELECT portfolio, period, 'tracking_error', '', 400.0e0 - v - s, 1e-5 FROM ({_QUAD.format(t='opt_active')}) JOIN (SELECT portfolio, period, sum(pow(weight * residual_volatility, 2)) AS s FROM greedy GROUP BY 1, 2) USING (portfolio, period)""",
    "greedy", "opt_betas", "opt_x", "opt_active", "omega",
)


@query("constraint_audit", "K7", "portfolio period:d kind name slack:4 violated:b", "SELECT *, slack < -tol AS violated FROM audit", "audit")
def _(spark, sf):
    fb = _table(spark, sf, _FACTOR_BOUNDS, "factor")
    return K.audit(
        greedy(spark, sf), by=BY, exposures=X.exposures(spark, sf).select("ticker", "period", "factor", "beta"), omega=omega(spark, sf),
        sector_bounds=_table(spark, sf, _SECTOR_BOUNDS, "sector"), factor_bounds=fb, relative_factor_bounds=fb, benchmark_betas=benchmark_betas(spark, sf),
        turnover_cap=0.6, max_factor_variance=5.0, component_caps=fb.select("factor", F.col("upper").alias("maximum")), tracking_error_limit=20.0,
    )


@query(
    "exposure_comparison", "U5 K9", "portfolio period:d factor original:6 optimized:6 change:6 within:b",
    f"SELECT portfolio, period, factor, prior AS original, exposure AS optimized, exposure - prior AS change, exposure BETWEEN lo - 1e-6 AND hi + 1e-6 AS within FROM opt_betas LEFT JOIN {_V(_FACTOR_BOUNDS)} ON name = factor", "opt_betas",
)
def _(spark, sf):
    e, g = X.exposures(spark, sf), greedy(spark, sf)
    side = lambda c: risk.portfolio_betas(g.withColumn("weight", F.col(c)), e, BY, ["ticker", "period"])
    return K.exposure_comparison(side("previous"), side("weight"), _table(spark, sf, _FACTOR_BOUNDS, "factor"), BY)


@query(
    "sector_totals", "A8", "portfolio period:d sector original:6 optimized:6 change:6 within:b",
    f"SELECT portfolio, period, sector, o AS original, w AS optimized, w - o AS change, w BETWEEN lo - 1e-6 AND hi + 1e-6 AS within FROM (SELECT portfolio, period, sector, sum(previous) AS o, sum(weight) AS w FROM greedy GROUP BY 1, 2, 3) LEFT JOIN {_V(_SECTOR_BOUNDS)} ON name = sector", "greedy",
)
def _(spark, sf):
    h = greedy(spark, sf).select(*BY, "sector", F.col("previous").alias("original_weight"), F.col("weight").alias("optimized_weight"))
    return K.sector_totals(h, _table(spark, sf, _SECTOR_BOUNDS, "sector"), BY)


@query("study_rollup", "A17", "portfolio variant_count:i succeeded_count:i", "SELECT portfolio, count(*) AS variant_count, count(*) FILTER (f) AS succeeded_count FROM (SELECT portfolio, period, bool_and(feasible) AS f FROM bounded GROUP BY 1, 2) GROUP BY 1", "bounded")
def _(spark, sf):
    v = bounded(spark, sf).groupBy(*BY).agg(F.when(F.bool_and("feasible"), "succeeded").otherwise("infeasible").alias("status"))
    return K.study_rollup(v, ["portfolio"])


@query(
    "allocation_comparison", "K9 K8", "portfolio period:d variant expected_return:6 turnover:6",
    """SELECT portfolio, period, variant, sum(w * expected_return) AS expected_return, sum(abs(w - previous)) AS turnover FROM (SELECT portfolio, period, expected_return, previous, unnest(['original', 'equal', 'optimized']) AS variant, unnest([previous, e, weight]) AS w FROM (SELECT *, 1.0e0 / count(*) OVER (PARTITION BY portfolio, period) AS e FROM greedy)) GROUP BY 1, 2, 3""",
    "greedy",
)
def _(spark, sf):
    g = K.equal_weights(greedy(spark, sf), BY)
    three = F.array(*[F.struct(F.lit(n).alias("variant"), F.col(c).alias("w")) for n, c in (("original", "previous"), ("equal", "equal_weight"), ("optimized", "weight"))])
    long = g.select("*", F.explode(three).alias("v")).select(*g.columns, "v.variant", "v.w")
    return long.groupBy(*BY, "variant").agg(
        F.sum(F.col("w") * F.col("expected_return")).alias("expected_return"), F.sum(F.abs(F.col("w") - F.col("previous"))).alias("turnover")
    )
