"""Registered queries: weights, covariance, risk split, attribution, limits and forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import forecasts as P
from ..operators import moments, replay, risk
from ..operators.calendar import latest_per_key
from . import fixtures as X
from .oracle import query, view

FACTORS = list(X.FACTORS)
_IN = ", ".join(f"'{f}'" for f in FACTORS)

view(
    "weights",
    """SELECT portfolio, as_of, ticker, v / sum(v) OVER (PARTITION BY portfolio, as_of) AS weight, sum(v) OVER (PARTITION BY portfolio, as_of) AS total_value FROM (
    SELECT h.portfolio, e.as_of, h.ticker, shares * p.close AS v FROM holdings h CROSS JOIN ends e ASOF JOIN stock_prices p ON p.ticker = h.ticker AND e.as_of >= p.date)""",
    "holdings", "ends", "stock_prices",
)


def weights(spark, sf):
    return risk.holding_weights(
        X.holdings(spark, sf).withColumn("weight", F.lit(None).cast("double")), X.stock_prices(spark, sf), X.month_end_dates(spark, sf).select("as_of")
    )


@X.stored
def stored_weights(spark, sf):
    return weights(spark, sf)


@query("holding_weights", "R1 J6", "portfolio as_of:d ticker weight:8 total_value:2", "SELECT * FROM weights", "weights")
def _(spark, sf):
    return weights(spark, sf)


@query(
    "explicit_weights", "R1 Q6", "portfolio as_of:d ticker weight:8",
    "SELECT portfolio, as_of, ticker, shares / sum(shares) OVER (PARTITION BY portfolio, as_of) AS weight FROM holdings CROSS JOIN ends", "holdings ends",
)
def _(spark, sf):
    h = X.holdings(spark, sf).withColumn("weight", F.col("shares"))
    return risk.holding_weights(h, X.stock_prices(spark, sf), X.month_end_dates(spark, sf).select("as_of"))


view(
    "omega",
    "SELECT a.factor AS row, b.factor AS col, coalesce(covar_samp(a.ret, b.ret), 0) * 252 AS value FROM factor_mret a JOIN factor_mret b USING (date) GROUP BY 1, 2",
    "factor_mret",
)


def omega(spark, sf):
    return moments.covariance(X.factor_monthly(spark, sf), "factor", "ret", FACTORS)


@query("factor_cov", "A4", "row col value:5", "SELECT * FROM omega", "omega")
def _(spark, sf):
    return omega(spark, sf)


@query(
    "factor_cov_pairwise", "A4", "row col value:5",
    """SELECT x.t AS row, y.t AS col, coalesce(covar_samp(a.ret, b.ret), 0) * 252 AS value FROM (SELECT n_name AS t FROM nation) x CROSS JOIN (SELECT n_name AS t FROM nation) y
    LEFT JOIN (SELECT * FROM stock_ret WHERE ret IS NOT NULL) a ON a.ticker = x.t LEFT JOIN (SELECT * FROM stock_ret WHERE ret IS NOT NULL) b ON b.ticker = y.t AND b.date = a.date GROUP BY 1, 2""",
    "stock_ret",
)
def _(spark, sf):
    return moments.covariance(X.stock_returns(spark, sf).where("ret is not null"), "ticker", "ret", [f"NATION_{i}" for i in range(25)])


view("complete_days", "SELECT date FROM proxy_ret WHERE ret IS NOT NULL GROUP BY 1 HAVING count(*) = 6", "proxy_ret")


@query(
    "complete_sample_cov", "A5", "row col value:4",
    "SELECT a.ticker AS row, b.ticker AS col, covar_samp(a.ret, b.ret) * 252 AS value FROM proxy_ret a JOIN proxy_ret b USING (date) JOIN complete_days USING (date) GROUP BY 1, 2", "proxy_ret complete_days",
)
def _(spark, sf):
    return moments.complete_covariance(X.proxy_returns(spark, sf), "ticker", "ret", FACTORS, "sample")


@query(
    "diagonal_cov", "A5", "row col value:4",
    "SELECT a.ticker AS row, b.ticker AS col, CASE WHEN a.ticker = b.ticker THEN var_samp(a.ret) * 252 ELSE 0 END AS value FROM proxy_ret a JOIN proxy_ret b USING (date) JOIN complete_days USING (date) GROUP BY 1, 2", "proxy_ret complete_days",
)
def _(spark, sf):
    return moments.complete_covariance(X.proxy_returns(spark, sf), "ticker", "ret", FACTORS, "diagonal")


view("cen", "SELECT ticker, date, ret - avg(ret) OVER (PARTITION BY ticker) AS c FROM proxy_ret JOIN complete_days USING (date)", "proxy_ret", "complete_days")
view("emp", "SELECT a.ticker AS row, b.ticker AS col, avg(a.c * b.c) AS v FROM cen a JOIN cen b USING (date) GROUP BY 1, 2", "cen")


@query(
    "ledoit_wolf", "A6", "row col value:4 shrink:8",
    """SELECT row, col, ((1 - s) * v + CASE WHEN row = col THEN s * mu ELSE 0 END) * 252 AS value, s AS shrink FROM (SELECT row, col, v, mu, CASE WHEN delta > 0 THEN least(b, delta) / delta ELSE 0 END AS s FROM (
    SELECT row, col, v, mu, (frob - 6 * mu * mu) / 6 AS delta, (fourth / n - frob) / (6 * n) AS b FROM emp,
    (SELECT sum(v) FILTER (row = col) / 6 AS mu, sum(v * v) AS frob FROM emp), (SELECT count(*) AS n, sum(q * q) AS fourth FROM (SELECT date, sum(c * c) AS q FROM cen GROUP BY 1))))""",
    "emp cen",
)
def _(spark, sf):
    return moments.complete_covariance(X.proxy_returns(spark, sf), "ticker", "ret", FACTORS)


NAMES = [f"NATION_{i}" for i in range(25)]
view(
    "rho",
    "SELECT a.ticker AS row, b.ticker AS col, corr(a.ret, b.ret) AS value FROM stock_mret a JOIN stock_mret b USING (date) WHERE date IN (SELECT DISTINCT date FROM stock_mret WHERE ret IS NOT NULL ORDER BY 1 DESC LIMIT 60) AND a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY 1, 2",
    "stock_mret",
)


def correlation(spark, sf):
    return moments.correlation(X.stock_monthly(spark, sf).where("ret is not null"), "ticker", "ret", NAMES, last=60).where("value is not null")


@query("trailing_correlation", "A7", "row col value:6", "SELECT * FROM rho", "rho")
def _(spark, sf):
    return correlation(spark, sf)


# One risk run per (portfolio, month): weights at the month end times that month's fits.
view(
    "modelled",
    """SELECT *, w / sum(w) OVER g AS weight, sum(w) OVER g AS coverage FROM (SELECT portfolio, f.period, h.as_of, ticker, f.sector, h.weight AS w, f.residual_volatility, f.adjusted_r2 FROM weights h JOIN fits f USING (ticker, as_of)) WINDOW g AS (PARTITION BY portfolio, period)""",
    "weights", "fits",
)
view("pbetas", "SELECT portfolio, period, factor, sum(weight * beta) AS exposure FROM modelled JOIN exposures USING (ticker, period) GROUP BY 1, 2, 3", "modelled", "exposures")
view(
    "pmarg",
    """SELECT k.portfolio, k.period, k.factor, coalesce(b.exposure, 0) AS exposure, sum(o.value * coalesce(c.exposure, 0)) AS marginal FROM (SELECT DISTINCT portfolio, period, f2 AS factor FROM pbetas CROSS JOIN (SELECT DISTINCT row FROM omega) x(f2)) k
    LEFT JOIN pbetas b ON b.portfolio = k.portfolio AND b.period = k.period AND b.factor = k.factor JOIN omega o ON o.row = k.factor
    LEFT JOIN pbetas c ON c.portfolio = k.portfolio AND c.period = k.period AND c.factor = o.col GROUP BY 1, 2, 3, 4""",
    "pbetas", "omega",
)
view(
    "ptotals",
    """SELECT *, factor_variance + specific_variance AS predicted_variance, sqrt(factor_variance + specific_variance) AS vol FROM (SELECT portfolio, period, sum(exposure * marginal) AS factor_variance FROM pmarg GROUP BY 1, 2)
    JOIN (SELECT portfolio, period, sum(pow(weight * residual_volatility, 2)) AS specific_variance FROM modelled GROUP BY 1, 2) USING (portfolio, period)""",
    "pmarg", "modelled",
)
BY = ["portfolio", "period"]


@X.stored
def modelled(spark, sf):
    f = X.fits(spark, sf).select("ticker", "as_of", "period", "sector", "residual_volatility", "adjusted_r2")
    return risk.modelled_weights(stored_weights(spark, sf), f, BY, ["ticker", "as_of"])


def betas(spark, sf):
    return risk.portfolio_betas(modelled(spark, sf), X.exposures(spark, sf), BY, ["ticker", "period"])


def specific(spark, sf):
    return risk.specific_variance(modelled(spark, sf), BY)


@query("portfolio_betas", "A10", "portfolio period:d factor exposure:6", "SELECT * FROM pbetas", "pbetas")
def _(spark, sf):
    return betas(spark, sf)


@query(
    "risk_totals", "R2 A11", "portfolio period:d factor_variance:4 specific_variance:4 predicted_volatility:5 specific_risk_percent:6",
    "SELECT *, vol AS predicted_volatility, specific_variance / predicted_variance AS specific_risk_percent FROM ptotals", "ptotals",
)
def _(spark, sf):
    return risk.decompose(betas(spark, sf), specific(spark, sf), omega(spark, sf), BY)


@query(
    "risk_decomposition", "R2 R8", "portfolio period:d factor exposure:6 marginal_risk:5 contribution:5 risk_percent:6",
    "SELECT m.portfolio, m.period, factor, exposure, marginal / vol AS marginal_risk, exposure * marginal / vol AS contribution, exposure * marginal / vol / vol AS risk_percent FROM pmarg m JOIN ptotals USING (portfolio, period)", "pmarg ptotals",
)
def _(spark, sf):
    return risk.euler_split(betas(spark, sf), specific(spark, sf), omega(spark, sf), BY)


@query(
    "risk_rows_ordered", "T5 R8", "portfolio period:d name percent:5 is_specific:b position:i",
    """SELECT portfolio, period, name, 100 * c / vol AS percent, s AS is_specific, row_number() OVER (PARTITION BY portfolio, period ORDER BY s, c DESC, name) AS position FROM (SELECT m.portfolio, m.period, factor AS name, exposure * marginal / vol AS c, false AS s, vol FROM pmarg m JOIN ptotals USING (portfolio, period)
    UNION ALL SELECT portfolio, period, 'Specific', specific_variance / vol, true, vol FROM ptotals)""",
    "pmarg ptotals",
)
def _(spark, sf):
    return risk.risk_rows(risk.euler_split(betas(spark, sf), specific(spark, sf), omega(spark, sf), BY), BY)


@query(
    "attribution", "R3 A14", "portfolio period:d realized_return:6 factor_return:6 residual_contribution:6",
    """SELECT *, realized_return - factor_return AS residual_contribution FROM (SELECT portfolio, m.period, sum(weight * coalesce(r.ret, 0)) AS realized_return FROM modelled m LEFT JOIN (SELECT ticker, CAST(date - INTERVAL 1 MONTH AS DATE) AS period, ret FROM stock_mret WHERE ret IS NOT NULL) r ON r.ticker = m.ticker AND r.period = m.period GROUP BY 1, 2)
    JOIN (SELECT portfolio, b.period, sum(exposure * ret) AS factor_return FROM pbetas b JOIN (SELECT factor, CAST(date - INTERVAL 1 MONTH AS DATE) AS period, ret FROM factor_mret) USING (factor, period) GROUP BY 1, 2) USING (portfolio, period)""",
    "modelled stock_mret pbetas factor_mret",
)
def _(spark, sf):
    shift = lambda df, k: df.where("ret is not null").select(k, F.add_months("date", -1).alias("period"), "ret")
    return risk.attribution(
        betas(spark, sf), shift(X.factor_monthly(spark, sf), "factor"), modelled(spark, sf).select("portfolio", "period", "ticker", "weight"),
        shift(X.stock_monthly(spark, sf), "ticker"), BY, on=("ticker",), when=("period",),
    )


@query(
    "fit_quality", "A13", "portfolio period:d covered_weight:8 weighted_adjusted_r2:6",
    "SELECT portfolio, period, sum(w) AS covered_weight, sum(w * adjusted_r2) / sum(w) AS weighted_adjusted_r2 FROM modelled GROUP BY 1, 2", "modelled",
)
def _(spark, sf):
    return risk.weighted_fit_quality(modelled(spark, sf), BY)


@query(
    "concentration", "A9 A12", "portfolio period:d concentration:6 stock_weight:6 sector_weight:6",
    "SELECT portfolio, period, sum(h) AS concentration, max(m) AS stock_weight, max(s) AS sector_weight FROM (SELECT portfolio, period, sector, sum(weight * weight) AS h, max(weight) AS m, sum(weight) AS s FROM modelled GROUP BY 1, 2, 3) GROUP BY 1, 2", "modelled",
)
def _(spark, sf):
    return risk.concentration(modelled(spark, sf), BY)


view("bench_fit", "SELECT factor, regr_slope(b.ret, f.ret) AS beta FROM benchmark_mret b JOIN factor_mret f USING (date) WHERE b.ret IS NOT NULL GROUP BY 1", "benchmark_mret", "factor_mret")


def benchmark_betas(spark, sf):
    j = X.benchmark_monthly(spark, sf).select("date", F.col("ret").alias("y")).join(X.factor_monthly(spark, sf), "date")
    return j.groupBy("factor").agg(F.regr_slope("y", "ret").alias("beta"))


view("act", "SELECT portfolio, period, factor, exposure - coalesce(beta, 0) AS x FROM pbetas LEFT JOIN bench_fit USING (factor)", "pbetas", "bench_fit")
view(
    "tracking",
    """SELECT portfolio, period, sqrt(greatest(v + specific_variance, 0)) AS tracking_error FROM (SELECT a.portfolio, a.period, sum(a.x * o.value * b.x) AS v FROM act a JOIN omega o ON o.row = a.factor JOIN act b ON b.portfolio = a.portfolio AND b.period = a.period AND b.factor = o.col GROUP BY 1, 2) JOIN ptotals USING (portfolio, period)""",
    "act", "omega", "ptotals",
)


@query("tracking_error", "R4", "portfolio period:d tracking_error:5", "SELECT * FROM tracking", "tracking")
def _(spark, sf):
    return risk.active_risk(betas(spark, sf), benchmark_betas(spark, sf), specific(spark, sf), omega(spark, sf), BY)[0]


@query("active_exposures", "R4", "portfolio period:d factor exposure:6", "SELECT portfolio, period, factor, x AS exposure FROM act", "act")
def _(spark, sf):
    return risk.active_risk(betas(spark, sf), benchmark_betas(spark, sf), specific(spark, sf), omega(spark, sf), BY)[1]


@query(
    "portfolio_realized", "R4 W22", "portfolio date:d ret:6",
    "SELECT portfolio, date, sum(weight * ret) AS ret FROM (SELECT portfolio, ticker, weight FROM weights WHERE as_of = (SELECT max(as_of) FROM ends)) JOIN stock_ret USING (ticker) WHERE ret IS NOT NULL GROUP BY 1, 2", "weights ends stock_ret",
)
def _(spark, sf):
    w = latest_per_key(stored_weights(spark, sf), ["portfolio", "ticker"], "as_of")
    return risk.portfolio_daily_returns(w, X.stock_returns(spark, sf), ["portfolio"])


view(
    "drift",
    """SELECT m.portfolio, n.date AS period, m.ticker, m.weight * (1 + coalesce(r.ret, 0)) AS v FROM modelled m JOIN month_cal c ON c.date = m.period JOIN month_cal n ON n.idx = c.idx + 1 LEFT JOIN stock_mret r ON r.ticker = m.ticker AND r.date = n.date""",
    "modelled", "month_cal", "stock_mret",
)
view(
    "turnovers",
    """SELECT portfolio, period, sum(abs(w)) AS turnover FROM (SELECT portfolio, period, ticker, sum(w) AS w FROM (SELECT portfolio, period, ticker, weight AS w FROM modelled UNION ALL SELECT portfolio, period, ticker, -v / sum(v) OVER (PARTITION BY portfolio, period) FROM drift) GROUP BY 1, 2, 3)
    SEMI JOIN (SELECT DISTINCT portfolio, period FROM modelled) USING (portfolio, period) WHERE period < (SELECT max(date) FROM month_cal) GROUP BY 1, 2""",
    "modelled", "drift", "month_cal",
)
view(
    "snapshot",
    """SELECT portfolio, period, vol AS total_volatility, tracking_error, coverage, concentration, stock_weight, sector_weight, specific_variance / predicted_variance AS residual_risk_share, turnover FROM ptotals JOIN tracking USING (portfolio, period)
    JOIN (SELECT portfolio, period, max(coverage) AS coverage FROM modelled GROUP BY 1, 2) USING (portfolio, period)
    JOIN (SELECT portfolio, period, sum(h) AS concentration, max(t) AS stock_weight, max(s) AS sector_weight FROM (SELECT portfolio, period, sector, sum(weight * weight) AS h, max(weight) AS t, sum(weight) AS s FROM modelled GROUP BY 1, 2, 3) GROUP BY 1, 2) USING (portfolio, period) LEFT JOIN turnovers USING (portfolio, period)""",
    "ptotals", "tracking", "modelled", "turnovers",
)
METRICS = ("total_volatility", "tracking_error", "coverage", "concentration", "stock_weight", "sector_weight", "residual_risk_share", "turnover")
_METRICS = ", ".join(METRICS)
FACTOR_METRICS = ("factor_beta", "factor_risk_contribution")
_LIMITS = (
    ("total_volatility", None, 28.0), ("coverage", 0.9, None), ("sector_weight", 0.1, 0.3), ("residual_risk_share", None, 0.5), ("tracking_error", 1.0, 30.0), ("factor_beta", -0.05, 0.2),
    ("concentration", None, 0.05), ("stock_weight", None, 0.08), ("turnover", None, 0.2), ("factor_risk_contribution", -0.5, 3.0),
)
view(
    "limits",
    "SELECT DISTINCT portfolio, m AS metric, CASE WHEN m IN ('factor_beta', 'factor_risk_contribution') THEN 'PROMO' ELSE '' END AS factor, lo AS lower_bound, hi AS upper_bound FROM holdings CROSS JOIN (VALUES "
    + ", ".join(f"('{m}', {'NULL' if a is None else f'{a}e0'}, {'NULL' if b is None else f'{b}e0'})" for m, a, b in _LIMITS) + ") v(m, lo, hi)",
    "holdings",
)


def limits(spark, sf):
    table = F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(a).cast("double").alias("lower_bound"), F.lit(b).cast("double").alias("upper_bound")) for m, a, b in _LIMITS])
    return (
        X.holdings(spark, sf).select("portfolio").distinct().select("portfolio", F.explode(table).alias("l")).select("portfolio", "l.*")
        .withColumn("factor", F.when(F.col("metric").isin(*FACTOR_METRICS), "PROMO").otherwise(""))
    )


@X.stored
def metrics(spark, sf):
    """Monitor of every portfolio and month in long form."""
    b, s, o, m = betas(spark, sf), specific(spark, sf), omega(spark, sf), modelled(spark, sf)
    totals = risk.decompose(b, s, o, BY)
    te, _ = risk.active_risk(b, benchmark_betas(spark, sf), s, o, BY)
    cover = m.groupBy(*BY).agg(F.max("coverage").alias("coverage"))
    traded = replay.decision_turnover(m, X.stock_monthly(spark, sf), X.month_calendar(spark, sf)).select(*BY, "turnover")
    snap = totals.join(te, BY).join(cover, BY).join(risk.concentration(m, BY), BY).join(traded, BY, "left").select(
        *BY, F.col("predicted_volatility").alias("total_volatility"), "tracking_error", "coverage", "concentration", "stock_weight", "sector_weight",
        F.col("specific_risk_percent").alias("residual_risk_share"), "turnover",
    )
    split = risk.euler_split(b, s, o, BY).select(*BY, F.lit("factor_risk_contribution").alias("metric"), F.col("contribution").alias("value"), "factor")
    factor_rows = b.select(*BY, F.lit("factor_beta").alias("metric"), F.col("exposure").alias("value"), "factor").unionByName(split)
    return risk.unpivot_metrics(snap, BY, METRICS).unionByName(factor_rows).where("value is not null")


view(
    "monitor",
    f"""SELECT portfolio, period, name AS metric, '' AS factor, value FROM (UNPIVOT snapshot ON {_METRICS} INTO NAME name VALUE value) UNION ALL SELECT portfolio, period, 'factor_beta', factor, exposure FROM pbetas
    UNION ALL SELECT m.portfolio, m.period, 'factor_risk_contribution', factor, exposure * marginal / vol FROM pmarg m JOIN ptotals USING (portfolio, period)""",
    "snapshot", "pbetas", "pmarg", "ptotals",
)


@query("monitor_metrics", "R4 R5", "portfolio period:d metric factor value:5", "SELECT * FROM monitor", "monitor")
def _(spark, sf):
    return metrics(spark, sf)


view(
    "evaluations",
    """SELECT l.portfolio, l.metric, l.factor, period, value, least(value - lower_bound, upper_bound - value) AS slack FROM limits l JOIN monitor m ON m.portfolio = l.portfolio AND m.metric = l.metric AND m.factor = l.factor""",
    "limits", "monitor",
)


def evaluations(spark, sf):
    return risk.evaluate_limits(metrics(spark, sf), limits(spark, sf))


@query("limit_slack", "R5", "portfolio metric period:d value:5 slack:5 breached:b", "SELECT *, slack < 0 AS breached FROM evaluations", "evaluations")
def _(spark, sf):
    return evaluations(spark, sf)


@query(
    "limit_breaches", "R6", "portfolio metric opened:d last_breach:d observed_value:5 slack:5 resolved:d status",
    """SELECT portfolio, metric, min(period) FILTER (b = 1) AS opened, max(period) FILTER (b = 1) AS last_breach, arg_max(value, period) FILTER (b = 1) AS observed_value, arg_max(slack, period) FILTER (b = 1) AS slack, min(period) FILTER (b = 0) AS resolved,
    CASE WHEN min(period) FILTER (b = 0) IS NULL THEN 'open' ELSE 'resolved' END AS status FROM (SELECT *, sum(CASE WHEN b = 1 AND coalesce(pb, 0) = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY portfolio, metric ORDER BY period) AS run FROM (
    SELECT *, lag(b) OVER (PARTITION BY portfolio, metric ORDER BY period) AS pb FROM (SELECT *, CASE WHEN slack < 0 THEN 1 ELSE 0 END AS b FROM evaluations))) WHERE run > 0 GROUP BY portfolio, metric, run""",
    "evaluations",
)
def _(spark, sf):
    return risk.breach_episodes(evaluations(spark, sf), ["portfolio", "metric"], "period")


# each limit as set until the middle of 1999, then tighter until the end of 2000, then none
view(
    "dated_limits",
    """SELECT portfolio, metric, factor, lower_bound, upper_bound, DATE '1992-01-01' AS valid_from, DATE '1999-06-30' AS valid_to FROM limits
    UNION ALL SELECT portfolio, metric, factor, lower_bound, upper_bound * 0.9e0, DATE '1999-07-01', DATE '2000-12-31' FROM limits""",
    "limits",
)
view(
    "rebalance_states",
    """SELECT *, CASE WHEN slack < 0 THEN CASE WHEN p < 0 THEN 'update' ELSE 'open' END WHEN p < 0 THEN 'resolved' END AS state FROM (SELECT *, lag(slack) OVER (PARTITION BY portfolio, metric, factor ORDER BY period) AS p FROM (
    SELECT m.portfolio, m.period, m.metric, m.factor, value AS observed, least(value - lower_bound, upper_bound - value) AS slack FROM monitor m JOIN dated_limits l ON l.portfolio = m.portfolio AND l.metric = m.metric AND l.factor = m.factor AND m.period BETWEEN valid_from AND valid_to
    SEMI JOIN turnovers t ON t.portfolio = m.portfolio AND t.period = m.period))""",
    "monitor", "dated_limits", "turnovers",
)


def rebalances(spark, sf):
    return replay.decision_turnover(modelled(spark, sf), X.stock_monthly(spark, sf), X.month_calendar(spark, sf))


def rebalance_states(spark, sf):
    """State of every limit in force at each rebalance of the portfolios."""
    date = lambda d: F.lit(d).cast("date")
    base = limits(spark, sf)
    dated = base.withColumns({"valid_from": date("1992-01-01"), "valid_to": date("1999-06-30")}).unionByName(
        base.withColumns({"upper_bound": F.col("upper_bound") * 0.9, "valid_from": date("1999-07-01"), "valid_to": date("2000-12-31")}))
    traded = metrics(spark, sf).join(rebalances(spark, sf).select(*BY, "execution_date"), BY)
    return risk.breach_states(risk.limits_in_force(traded, dated, "period"), "period")


@query(
    "rebalance_limits", "H13 R5 R6", "portfolio execution_date:d metric factor observed:5 slack:5 state",
    "SELECT s.portfolio, n.date AS execution_date, metric, factor, observed, slack, state FROM rebalance_states s JOIN month_cal c ON c.date = s.period JOIN month_cal n ON n.idx = c.idx + 1 WHERE state IS NOT NULL", "rebalance_states month_cal",
)
def _(spark, sf):
    return rebalance_states(spark, sf).where("state is not null").withColumnRenamed("value", "observed")


@query(
    "rebalance_limit_audit", "H13", "portfolio period:d names:i turnover:6 limits:i breached:i opened:i resolved:i",
    """SELECT portfolio, period, names, turnover, limits, breached, opened, resolved FROM (SELECT portfolio, period, count(*) AS names FROM modelled WHERE weight > 0 GROUP BY 1, 2) JOIN turnovers USING (portfolio, period) JOIN (SELECT portfolio, period, count(*) AS limits, count(*) FILTER (slack < 0) AS breached,
    count(*) FILTER (state = 'open') AS opened, count(*) FILTER (state = 'resolved') AS resolved FROM rebalance_states GROUP BY 1, 2) USING (portfolio, period)""",
    "modelled turnovers rebalance_states",
)
def _(spark, sf):
    counted = rebalance_states(spark, sf).groupBy(*BY).agg(
        F.count("*").alias("limits"), F.count_if("breached").alias("breached"), F.count_if(F.col("state") == "open").alias("opened"), F.count_if(F.col("state") == "resolved").alias("resolved"))
    return rebalances(spark, sf).join(counted, BY)


@query(
    "risk_inputs", "K3 J7 J6", "portfolio as_of:d ticker factor beta:6 standard_error:6 fit_as_of:d residual_volatility:5 annualized_rate:8 benchmark_beta:6 has_fit:b",
    """SELECT m.portfolio, m.as_of, m.ticker, x.factor, CASE WHEN f.as_of IS NOT NULL THEN coalesce(e.beta, 0) END AS beta, coalesce(e.standard_error, 1000000) AS standard_error, f.as_of AS fit_as_of, f.residual_volatility, coalesce(r.annualized_rate, 0.02e0) AS annualized_rate, coalesce(b.beta, 0) AS benchmark_beta, f.as_of IS NOT NULL AS has_fit
    FROM (SELECT portfolio, CAST(as_of + 10 AS DATE) AS as_of, ticker FROM holdings CROSS JOIN ends) m ASOF LEFT JOIN (SELECT * FROM fits WHERE ticker <> 'NATION_3') f ON f.ticker = m.ticker AND m.as_of >= f.as_of ASOF LEFT JOIN cash_rates r ON m.as_of >= r.date
    CROSS JOIN (SELECT DISTINCT factor FROM factor_mret) x LEFT JOIN exposures e ON e.ticker = m.ticker AND e.as_of = f.as_of AND e.factor = x.factor LEFT JOIN bench_fit b ON b.factor = x.factor""",
    "holdings ends fits cash_rates factor_mret exposures bench_fit",
)
def _(spark, sf):
    """All portfolios ten days after each month end; one member never had a fit."""
    dates = X.month_end_dates(spark, sf).agg(F.collect_set(F.date_add("as_of", 10)).alias("d")).withColumn("k", F.lit(1))
    members = X.holdings(spark, sf).select("portfolio", "ticker", F.lit(1).alias("k")).join(dates, "k").select("portfolio", "ticker", F.explode("d").alias("as_of"))
    return risk.risk_inputs(
        members, X.fits(spark, sf).where("ticker <> 'NATION_3'"), X.exposures(spark, sf), X.factor_monthly(spark, sf).select("factor").distinct(), X.cash_rates(spark, sf), benchmark_betas(spark, sf), default_rate=0.02, missing="flag",
    )


@query(
    "holdings_matrix", "R7 J10", "portfolio ticker factor beta:6",
    """SELECT h.portfolio, h.ticker, f.factor, CASE WHEN m.ticker IS NOT NULL THEN coalesce(e.beta, 0) END AS beta FROM holdings h CROSS JOIN (SELECT DISTINCT factor FROM factor_mret) f LEFT JOIN (SELECT DISTINCT ticker FROM fits WHERE period = DATE '1999-06-01' AND sector <> 'ASIA') m ON m.ticker = h.ticker
    LEFT JOIN exposures e ON e.ticker = h.ticker AND e.factor = f.factor AND e.period = DATE '1999-06-01'""",
    "holdings factor_mret fits exposures",
)
def _(spark, sf):
    at = "period = date '1999-06-01'"
    return risk.holdings_matrix(
        X.holdings(spark, sf).select("portfolio", "ticker"), X.fits(spark, sf).where(at + " and sector <> 'ASIA'"), X.exposures(spark, sf).where(at), F.array(*[F.lit(f) for f in FACTORS])
    )


@query(
    "risk_restatement", "R11", "portfolio period:d factor contribution:5",
    "SELECT m.portfolio, m.period, factor, exposure * marginal / vol AS contribution FROM pmarg m JOIN ptotals USING (portfolio, period)", "pmarg ptotals",
)
def _(spark, sf):
    split = risk.euler_split(betas(spark, sf), specific(spark, sf), omega(spark, sf), BY)
    old = split.groupBy(*BY, "predicted_volatility").agg(F.map_from_entries(F.collect_list(F.struct("factor", "factor_component"))).alias("m"))
    return risk.restate_contributions(old, "m", "predicted_volatility").select(*BY, F.explode("m").alias("factor", "contribution"))


_MEANS = """SELECT *, m0 + w * (raw - m0) AS expected FROM (SELECT *, CASE WHEN tau2 + sv > 0 THEN tau2 / (tau2 + sv) ELSE 0 END AS w FROM (SELECT ticker, n, raw, sv, sum(raw / greatest(sv, 2.220446049250313e-16)) OVER () / sum(1 / greatest(sv, 2.220446049250313e-16)) OVER () AS m0,
    greatest(var_samp(raw) OVER () - avg(sv) OVER (), 0) AS tau2 FROM (SELECT ticker, count(*) AS n, avg(ret) * 252 AS raw, var_samp(ret) * 63504.0e0 / count(*) AS sv FROM {src} WHERE ret IS NOT NULL GROUP BY 1)))"""


@query(
    "shrink_means", "P1", "ticker observations:i raw_expected_return:4 sampling_variance:3 prior_mean:4 prior_variance:3 shrinkage_weight:6 expected_return:4",
    "SELECT ticker, n AS observations, raw AS raw_expected_return, sv AS sampling_variance, m0 AS prior_mean, tau2 AS prior_variance, w AS shrinkage_weight, expected AS expected_return FROM (" + _MEANS.format(src="stock_ret") + ")", "stock_ret",
)
def _(spark, sf):
    return P.shrink_means(X.stock_returns(spark, sf))


@query(
    "shrink_betas", "P2", "ticker period:d factor raw_beta:6 beta:6 prior_variance:6 shrinkage_weight:6 informative_count:i",
    """SELECT ticker, period, factor, beta AS raw_beta, w * beta AS beta, tau2 AS prior_variance, w AS shrinkage_weight, c AS informative_count FROM (SELECT *, CASE WHEN tau2 + se * se > 0 THEN tau2 / (tau2 + se * se) ELSE 0 END AS w FROM (SELECT *, greatest(coalesce(avg(CASE WHEN se < 0.3e0 THEN beta * beta - se * se END) OVER g, 0), 0) AS tau2, count(*) FILTER (se < 0.3e0) OVER g AS c
    FROM (SELECT ticker, period, factor, beta, standard_error AS se FROM exposures) WINDOW g AS (PARTITION BY period, factor)))""",
    "exposures",
)
def _(spark, sf):
    return P.shrink_betas(X.exposures(spark, sf), by=["period"], max_informative_error=0.3)


view(
    "premia",
    """SELECT factor, a AS assumption, m AS historical_mean, se AS historical_standard_error, n AS observations, 0.0009e0 / (0.0009e0 + se * se) AS history_weight, a + 0.0009e0 / (0.0009e0 + se * se) * (m - a) AS premium FROM (SELECT factor, count(ret) AS n, avg(ret) * 252 AS m, stddev_samp(ret) * 252 / sqrt(CAST(count(ret) AS DOUBLE)) AS se FROM factor_mret GROUP BY 1)
    CROSS JOIN LATERAL (SELECT CASE WHEN factor = 'STANDARD' THEN 0.05e0 ELSE 0.02e0 END AS a)""",
    "factor_mret",
)


def premia(spark, sf):
    a = F.when(F.col("factor") == "STANDARD", F.lit(0.05)).otherwise(F.lit(0.02))
    priors = X.factor_monthly(spark, sf).select("factor").distinct().withColumn("assumption", a)
    return P.shrink_premia(X.factor_monthly(spark, sf), priors, min_observations=24)


@query("shrink_premia", "P3 K10", "factor premium:8 assumption:4 historical_mean:5 historical_standard_error:5 history_weight:8 observations:i", "SELECT * FROM premia", "premia")
def _(spark, sf):
    return premia(spark, sf)


@query(
    "factor_implied", "P4", "ticker period:d expected_return:8",
    "SELECT f.ticker, f.period, coalesce(sum(e.beta * p.premium), 0) + 0.02e0 AS expected_return FROM fits f LEFT JOIN exposures e USING (ticker, period) LEFT JOIN premia p USING (factor) GROUP BY 1, 2", "fits exposures premia",
)
def _(spark, sf):
    return P.factor_implied_returns(X.exposures(spark, sf), premia(spark, sf), stocks=X.fits(spark, sf), by=["period"], risk_free_rate=0.02)


@query(
    "equal_sharpe", "P5", "ticker volatility:5 expected_return:5",
    "SELECT ticker, sqrt(v) AS volatility, 0.03e0 + 0.5e0 * sqrt(v) AS expected_return FROM (SELECT ticker, var_samp(ret) * 252 AS v FROM stock_ret WHERE ret IS NOT NULL GROUP BY 1)", "stock_ret",
)
def _(spark, sf):
    v = X.stock_returns(spark, sf).groupBy("ticker").agg((F.var_samp("ret") * 252).alias("variance"))
    return P.equal_sharpe_returns(v, risk_free_rate=0.03)


@query(
    "raw_mean_dispersion", "P6", "sector dispersion:4 is_flat:b",
    "SELECT sector, stddev_pop(m) AS dispersion, stddev_pop(m) <= 1e-10 AS is_flat FROM (SELECT ticker, sector, avg(ret) * 252 AS m FROM stock_ret JOIN securities USING (ticker) WHERE ret IS NOT NULL GROUP BY 1, 2) GROUP BY 1", "stock_ret securities",
)
def _(spark, sf):
    means = P.historical_means(X.stock_returns(spark, sf))
    return P.forecast_dispersion(means.join(X.securities(spark, sf), "ticker"), ["sector"])

