"""Registered queries: rebalance replay, performance statistics and comparisons.

The SQL checks walk the calendar day by day with a recursive query, unlike the closed form.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import performance, replay, risk
from ..operators.calendar import trading_calendar
from ..operators.returns import simple_returns
from ..sources.sinks import replay_export
from . import fixtures as X
from .oracle import normal_p_sql, query, view
from .queries_selection import selected

FACTORS = list(X.FACTORS)
_LIST = "[" + ", ".join(f"max(CASE WHEN ticker = '{t}' THEN {{v}} END)" for t in FACTORS) + "]"

view(
    "decisions",
    """SELECT 'equal' AS strategy, as_of AS signal_date, ticker, CAST(NULL AS DOUBLE) AS weight FROM ends CROSS JOIN (SELECT DISTINCT ticker FROM proxy_prices)
    UNION ALL SELECT 'top3', as_of, ticker, NULL FROM (SELECT as_of, ticker, row_number() OVER (PARTITION BY as_of ORDER BY close DESC, ticker) AS r FROM proxy_month JOIN ends ON ends.period = proxy_month.date) WHERE r <= 3
    UNION ALL SELECT 'tilt', as_of, ticker, close FROM proxy_month JOIN ends ON ends.period = proxy_month.date""",
    "ends", "proxy_prices", "proxy_month",
)
view(
    "targets",
    """SELECT strategy, idx, CASE WHEN count(weight) = 0 THEN [coalesce(x, 0) / count(*) FOR x IN """
    + _LIST.format(v="1.0e0")
    + "] ELSE [coalesce(x, 0) / sum(weight) FOR x IN "
    + _LIST.format(v="weight")
    + """] END AS t FROM decisions d JOIN (SELECT s, min(idx) AS idx FROM (SELECT DISTINCT signal_date AS s FROM decisions) JOIN proxy_cal ON date > s GROUP BY 1) e ON e.s = d.signal_date GROUP BY 1, 2""",
    "decisions", "proxy_cal",
)
view(
    "day_returns",
    "SELECT idx, date, [coalesce(x, 0) FOR x IN " + _LIST.format(v="ret") + "] AS r FROM proxy_ret GROUP BY 1, 2",
    "proxy_ret",
)
_RANGE = "range(1, 7)"


def _walk(start: str) -> str:
    return f"""SELECT strategy, {start} - 1 AS idx, [0.0e0, 0.0e0, 0.0e0, 0.0e0, 0.0e0, 0.0e0] AS w, 0.0e0 AS gross, 0.0e0 AS turnover FROM targets GROUP BY 1
    UNION ALL SELECT strategy, idx, [cur[i] * (1 + r[i]) / (1 + g) FOR i IN {_RANGE}] AS w, g AS gross, turnover FROM (SELECT *, list_sum([cur[i] * r[i] FOR i IN {_RANGE}]) AS g FROM (
    SELECT p.strategy, d.idx, d.r, coalesce(t.t, p.w) AS cur, CASE WHEN t.t IS NULL THEN 0.0e0 ELSE list_sum([abs(t.t[i] - p.w[i]) FOR i IN {_RANGE}]) END AS turnover
    FROM {{rec}} p JOIN day_returns d ON d.idx = p.idx + 1 LEFT JOIN targets t ON t.strategy = p.strategy AND t.idx = d.idx))"""


view("rec_path", _walk("min(idx)").format(rec="rec_path"), "targets", "day_returns")
view(
    "path",
    "SELECT strategy, date, p.idx, gross, turnover FROM rec_path p JOIN day_returns d ON d.idx = p.idx JOIN (SELECT strategy, min(idx) AS f FROM targets GROUP BY 1) USING (strategy) WHERE p.idx >= f",
    "rec_path", "day_returns", "targets",
)
view(
    "rec_warm",
    _walk("200 + 1 + 0 * min(idx)").replace("LEFT JOIN targets t ON", "LEFT JOIN (SELECT * FROM targets WHERE idx > 200) t ON").format(rec="rec_warm"),
    "targets", "day_returns",
)
view("warm", "SELECT strategy, date, p.idx, gross, turnover FROM rec_warm p JOIN day_returns d ON d.idx = p.idx WHERE p.idx > 200", "rec_warm", "day_returns")


@X.stored
def proxy_daily(spark, sf):
    return X.proxy_returns(spark, sf)


def calendar(spark, sf):
    return trading_calendar(proxy_daily(spark, sf))


@X.stored
def decisions(spark, sf):
    ends = X.month_end_dates(spark, sf)
    p = X.proxy_prices(spark, sf)
    from ..functions.ranks import top_n
    from ..operators.bars import month_closes

    month = month_closes(p).withColumnRenamed("date", "period").join(ends, "period")
    base = lambda df, s, w: df.select(F.lit(s).alias("strategy"), F.col("as_of").alias("signal_date"), "ticker", w.cast("double").alias("weight"))
    dates = ends.agg(F.collect_set("as_of").alias("d"))
    grid = p.select("ticker").distinct().join(dates, F.lit(True)).select("ticker", F.explode("d").alias("as_of"))
    return (
        base(grid, "equal", F.lit(None))
        .unionByName(base(top_n(month, ["as_of"], "close", "ticker", 3), "top3", F.lit(None)))
        .unionByName(base(month, "tilt", F.col("close")))
    )


@X.stored
def path(spark, sf):
    return replay.replay(decisions(spark, sf), proxy_daily(spark, sf), calendar(spark, sf), cost_bps=25)


@query(
    "replay_daily", "H1 H3 J8 J16", "strategy date:d gross:6 turnover:6 cost:8 ret:6",
    "SELECT *, turnover * 25 / 10000 AS cost, gross - turnover * 25 / 10000 AS ret FROM path", "path",
)
def _(spark, sf):
    return path(spark, sf)


@query(
    "replay_warm_up", "H2", "strategy date:d gross:6 turnover:6", "SELECT * FROM warm", "warm",
)
def _(spark, sf):
    return replay.replay(decisions(spark, sf), proxy_daily(spark, sf), calendar(spark, sf), estimation_window=200)


@query("month_end_decisions", "H3 A16", "strategy signal_date:d ticker", "SELECT portfolio AS strategy, as_of AS signal_date, ticker FROM holdings CROSS JOIN ends", "holdings ends")
def _(spark, sf):
    return replay.month_end_decisions(X.holdings(spark, sf), trading_calendar(X.benchmark_prices(spark, sf)), "portfolio")


@query(
    "replay_equity", "H5 W6 W7", "strategy date:d log_equity:6 drawdown:6",
    """SELECT strategy, date, ln(e) AS log_equity, e / max(e) OVER (PARTITION BY strategy ORDER BY date) - 1 AS drawdown FROM (SELECT *, product(1 + gross - turnover * 25 / 10000) OVER (PARTITION BY strategy ORDER BY date) AS e FROM path)""",
    "path",
)
def _(spark, sf):
    return replay.with_equity(path(spark, sf)).withColumn("log_equity", F.log("equity"))


@query(
    "replay_costs", "H9", "strategy cost_bps:2 date:d cost:8 ret:6",
    "SELECT strategy, c AS cost_bps, date, turnover * c / 10000 AS cost, gross - turnover * c / 10000 AS ret FROM path CROSS JOIN (VALUES (10.0e0), (25.0e0), (50.0e0)) v(c)", "path",
)
def _(spark, sf):
    return replay.cost_grid(decisions(spark, sf), proxy_daily(spark, sf), calendar(spark, sf), [10, 25, 50])


view(
    "bench_daily",
    "SELECT date, ret FROM benchmark_ret WHERE ret IS NOT NULL", "benchmark_ret",
)


def benchmark(spark, sf):
    p = X.benchmark_prices(spark, sf)
    return simple_returns(p, trading_calendar(p)).where("ret is not null").select("date", "ret")


@query(
    "replay_export", "S12 H5 J15", "strategy date:d portfolio_return:6 benchmark_return:6 turnover:6 cost:8 portfolio_drawdown:6 benchmark_drawdown:6",
    """SELECT strategy, date, r AS portfolio_return, b AS benchmark_return, turnover, cost, pe / max(pe) OVER w - 1 AS portfolio_drawdown, be / max(be) OVER w - 1 AS benchmark_drawdown FROM (SELECT *, product(1 + r) OVER w AS pe, product(1 + b) OVER w AS be FROM (
    SELECT strategy, date, turnover, turnover * 25 / 10000 AS cost, gross - turnover * 25 / 10000 AS r, coalesce(ret, 0) AS b FROM path LEFT JOIN bench_daily USING (date)) WINDOW w AS (PARTITION BY strategy ORDER BY date)) WINDOW w AS (PARTITION BY strategy ORDER BY date)""",
    "path bench_daily",
)
def _(spark, sf):
    return replay_export(path(spark, sf), benchmark(spark, sf))


@query(
    "merged_paths", "J15 H12", "date:d equal_drawdown:6 top3_drawdown:6",
    """SELECT a.date, a.d AS equal_drawdown, b.d AS top3_drawdown FROM dd a JOIN dd b ON a.date = b.date AND a.strategy = 'equal' AND b.strategy = 'top3'""".replace(
        "dd ", "(SELECT strategy, date, e / max(e) OVER (PARTITION BY strategy ORDER BY date) - 1 AS d FROM (SELECT *, product(1 + gross - turnover * 25 / 10000) OVER (PARTITION BY strategy ORDER BY date) AS e FROM path)) "
    ),
    "path",
)
def _(spark, sf):
    eq = replay.with_equity(path(spark, sf))
    return replay.merge_paths(eq.where("strategy = 'equal'"), eq.where("strategy = 'top3'"), "equal", "top3")


view("net", "SELECT strategy, date, gross - turnover * 25 / 10000 AS r FROM path", "path")
view(
    "perf",
    """SELECT *, arithmetic / vol AS sharpe, m / sd AS sr FROM (SELECT strategy, count(*) AS n, avg(r) AS m, stddev_samp(r) AS sd, pow(product(1 + r), 252.0e0 / count(*)) - 1 AS annual, avg(r) * 252 AS arithmetic, stddev_samp(r) * sqrt(252.0e0) AS vol,
    stddev_samp(CASE WHEN r < 0 THEN r END) * sqrt(252.0e0) AS down, quantile_cont(r, 0.05) AS q, min(dd) AS mdd, corr(r, p) AS ac FROM (SELECT *, e / max(e) OVER (PARTITION BY strategy ORDER BY date) - 1 AS dd, lag(r) OVER (PARTITION BY strategy ORDER BY date) AS p FROM (
    SELECT *, product(1 + r) OVER (PARTITION BY strategy ORDER BY date) AS e FROM net)) GROUP BY 1)""",
    "net",
)
_HAC = " + ".join(f"{1 - i / 6.0!r} * coalesce(sum(e * e{i}), 0)" for i in range(1, 6))
view(
    "perf_hac",
    f"SELECT strategy, max(m) / (sqrt(sum(e * e) + 2 * ({_HAC})) / count(*)) AS t, sum(e * e * e) / count(*) / pow(sum(e * e) / count(*), 1.5e0) AS skew, sum(e * e * e * e) / count(*) / pow(sum(e * e) / count(*), 2) AS kurt FROM (SELECT *, "
    + ", ".join(f"lag(e, {i}) OVER (PARTITION BY strategy ORDER BY date) AS e{i}" for i in range(1, 6))
    + " FROM (SELECT strategy, date, r - m AS e, m FROM net JOIN perf USING (strategy))) GROUP BY 1",
    "net", "perf",
)


@query(
    "performance_stats", "H6 F10 W16", "strategy observations:i arithmetic_annual_return:5 annual_volatility:5 sharpe:5 max_drawdown:6 daily_var_95_loss:6 daily_cvar_95_loss:6 autocorrelation_1:6 hac_mean_t_stat:5 probabilistic_sharpe:5 log_annual:5",
    """SELECT strategy, n AS observations, arithmetic AS arithmetic_annual_return, vol AS annual_volatility, sharpe, mdd AS max_drawdown, -q AS daily_var_95_loss, -tail AS daily_cvar_95_loss, ac AS autocorrelation_1, t AS hac_mean_t_stat, ln(1 + annual) AS log_annual,
    CASE WHEN z > 0 THEN 1 - h ELSE h END AS probabilistic_sharpe FROM (SELECT *, PTAIL / 2 AS h FROM (SELECT *, sr / sqrt(greatest((1 - skew * sr + (kurt - 1) * sr * sr / 4) / n, 1e-16)) AS z FROM perf JOIN perf_hac USING (strategy))) JOIN (SELECT strategy, avg(r) AS tail FROM net JOIN perf USING (strategy) WHERE r <= q GROUP BY 1) USING (strategy)""".replace(
        "PTAIL", normal_p_sql("z")
    ),
    "net perf perf_hac",
)
def _(spark, sf):
    return performance.statistics(path(spark, sf)).withColumn("log_annual", F.log1p("annual_return"))


@query(
    "benchmark_relative", "H7", "strategy alpha:5 beta:6 tracking_error:5 information_ratio:6",
    """SELECT strategy, (m - c / v * mb) * 252 AS alpha, c / v AS beta, te AS tracking_error, x / te AS information_ratio FROM (SELECT strategy, covar_samp(r, ret) AS c, var_samp(ret) AS v, avg(r) AS m, avg(ret) AS mb, stddev_samp(r - ret) * sqrt(252.0e0) AS te, avg(r - ret) * 252 AS x FROM net JOIN bench_daily USING (date) GROUP BY 1)""",
    "net bench_daily",
)
def _(spark, sf):
    return performance.relative_statistics(path(spark, sf), benchmark(spark, sf))


@query(
    "block_bootstrap", "H8", "strategy ci_low:4 ci_high:4 draws:i",
    """SELECT strategy, quantile_cont(m, 0.025) AS ci_low, quantile_cont(m, 0.975) AS ci_high, count(*) AS draws FROM (SELECT strategy, draw, sum(list_sum(r[start + 1 : start + len])) / max(n) * 252 AS m FROM (
    SELECT *, s3 % greatest(1, n - block + 1) AS start, CASE WHEN b < blocks THEN block ELSE n - (blocks - 1) * block END AS len FROM (SELECT *, ((s0 * 48271 % 2147483647) * 48271 % 2147483647) * 48271 % 2147483647 AS s3 FROM (
    SELECT *, (7 * 1000003 + draw * 10007 + b * 101 + 17) % 2147483647 AS s0 FROM (SELECT *, unnest(generate_series(1, blocks)) AS b FROM (SELECT *, unnest(generate_series(1, 500)) AS draw FROM (SELECT strategy, r, n, block, CAST(ceil(n / block) AS BIGINT) AS blocks FROM (
    SELECT strategy, list(r ORDER BY date) AS r, count(*) AS n, CAST(greatest(2, floor(sqrt(count(*)))) AS BIGINT) AS block FROM net GROUP BY 1))))))) GROUP BY 1, 2) GROUP BY 1""",
    "net",
)
def _(spark, sf):
    return performance.block_bootstrap(path(spark, sf))


@query("random_names", "H10", "ticker", "SELECT ticker FROM (SELECT DISTINCT ticker FROM stock_prices) ORDER BY md5(concat('7:', ticker)), ticker LIMIT 8", "stock_prices")
def _(spark, sf):
    return replay.random_names(X.stock_prices(spark, sf), 8)


@query(
    "method_comparison", "H11 H10", "strategy annual_volatility:5 sharpe:5 turnover:4 net_sharpe:5 sharpe_vs_equal:5 fallbacks:i",
    """SELECT g.strategy, vol AS annual_volatility, s AS sharpe, turnover, sharpe AS net_sharpe, s - (SELECT avg(gross) * 252 / (stddev_samp(gross) * sqrt(252.0e0)) FROM path WHERE strategy = 'equal') AS sharpe_vs_equal, CASE WHEN g.strategy = 'tilt' THEN (SELECT count(*) FROM ends) ELSE 0 END AS fallbacks
    FROM (SELECT strategy, stddev_samp(gross) * sqrt(252.0e0) AS vol, avg(gross) * 252 / (stddev_samp(gross) * sqrt(252.0e0)) AS s, sum(turnover) AS turnover FROM path GROUP BY 1) g JOIN (SELECT strategy, sharpe FROM perf) p ON p.strategy = g.strategy""",
    "path perf ends",
)
def _(spark, sf):
    net = path(spark, sf)
    gross = net.withColumn("ret", F.col("gross"))
    fallbacks = decisions(spark, sf).where("strategy = 'tilt'").groupBy("strategy").agg(F.countDistinct("signal_date").alias("fallbacks"))
    return performance.method_comparison(gross, net, fallbacks, "equal")


@query(
    "screen_replay", "H4 G8", "date:d gross:6 turnover:6",
    """SELECT period_next AS date, avg(coalesce(ret, 0)) AS gross, NULL AS turnover FROM (SELECT s.ticker, c.next_date AS period_next FROM selections s JOIN (SELECT date, lead(date) OVER (ORDER BY date) AS next_date FROM month_cal) c ON c.date = s.period WHERE included AND next_date IS NOT NULL) LEFT JOIN stock_mret m ON m.ticker = TICK AND m.date = period_next GROUP BY 1""".replace("TICK", "s2.ticker").replace(
        "WHERE included AND next_date IS NOT NULL) LEFT JOIN", "WHERE included AND next_date IS NOT NULL) s2 LEFT JOIN"
    ),
    "selections month_cal stock_mret",
)
def _(spark, sf):
    d = selected(spark, sf).where("included").select(F.lit("screen").alias("strategy"), F.col("period").alias("signal_date"), "ticker", F.lit(None).cast("double").alias("weight"))
    # monthly bars: each selection is held for one bar, so drift shows only in turnover
    out = replay.replay(d, X.stock_monthly(spark, sf), X.month_calendar(spark, sf))
    return out.withColumn("turnover", F.lit(None).cast("double"))


@query(
    "rebalance_audit", "H13", "strategy execution_date:d names:i turnover:6 cost:8 largest:6",
    """SELECT t.strategy, date AS execution_date, len([x FOR x IN t IF x > 0]) AS names, turnover, turnover * 25 / 10000 AS cost, list_max(t) AS largest FROM targets t JOIN path p ON p.strategy = t.strategy AND p.idx = t.idx""",
    "targets path",
)
def _(spark, sf):
    d, r, cal = decisions(spark, sf), proxy_daily(spark, sf), calendar(spark, sf)
    targets = replay.schedule(d, cal, r)
    trades = replay.rebalance_turnover(targets, replay.holding_values(targets, r), 25)
    return replay.rebalance_audit(targets, trades).withColumn("largest", F.array_max(F.map_values("holdings")))


@query("optimized_history", "H12 K5 J15", "strategy date:d gross:6 turnover:6")
def _(spark, sf):
    """Replay of every allocation objective over the monthly bars, one strategy each."""
    from .queries_allocation import allocations, names

    w = allocations(spark, sf)
    d = w.select(F.concat_ws("|", "portfolio", "objective").alias("strategy"), F.col("period").alias("signal_date"), "ticker", F.col("optimized_weight").alias("weight"))
    original = names(spark, sf).select(F.concat_ws("|", "portfolio", F.lit("original")).alias("strategy"), F.col("period").alias("signal_date"), "ticker", F.col("previous").alias("weight"))
    return replay.replay(d.unionByName(original), X.stock_monthly(spark, sf), X.month_calendar(spark, sf))


view(
    "screen_w",
    "SELECT s.period, s.ticker, weight, residual_volatility FROM (SELECT period, ticker, 1.0e0 / count(*) OVER (PARTITION BY period) AS weight FROM selections WHERE included) s JOIN fits USING (period, ticker)", "selections", "fits",
)
view("screen_b", "SELECT period, factor, sum(weight * beta) AS x FROM screen_w JOIN exposures USING (period, ticker) GROUP BY 1, 2", "screen_w", "exposures")


@query(
    "rebalance_risk", "H13 R2 R5", "strategy signal_date:d factor_variance:4 specific_variance:4 predicted_volatility:5",
    """SELECT 'screen' AS strategy, period AS signal_date, v AS factor_variance, s AS specific_variance, sqrt(v + s) AS predicted_volatility FROM (SELECT a.period, sum(a.x * o.value * b.x) AS v FROM screen_b a JOIN omega o ON o.row = a.factor JOIN screen_b b ON b.period = a.period AND b.factor = o.col GROUP BY 1)
    JOIN (SELECT period, sum(pow(weight * residual_volatility, 2)) AS s FROM screen_w GROUP BY 1) USING (period)""",
    "screen_b screen_w omega",
)
def _(spark, sf):
    from .queries_risk import omega

    d = selected(spark, sf).where("included").select("period", "ticker")
    n = d.groupBy("period").agg((1.0 / F.count(F.lit(1))).alias("weight"))
    w = d.join(n, "period").join(X.fits(spark, sf).select("period", "ticker", "residual_volatility"), ["period", "ticker"])
    b = risk.portfolio_betas(w, X.exposures(spark, sf), ["period"], ["ticker", "period"])
    out = risk.decompose(b, risk.specific_variance(w, ["period"]), omega(spark, sf), ["period"])
    return out.select(F.lit("screen").alias("strategy"), F.col("period").alias("signal_date"), "factor_variance", "specific_variance", "predicted_volatility")
