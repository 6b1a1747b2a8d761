"""Registered queries: calendar, joins in time, window operators, bars and baskets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bars, moments, regression, returns, spreads
from ..operators.calendar import as_of_backward, fill_prices, latest_per_key, month_ends, next_trading_day, trading_calendar
from ..operators.evaluation import aligned
from . import fixtures as X
from .oracle import query, view


view(
    "wk",
    "SELECT ticker, date + CAST((12 - dayofweek(date)) % 7 AS INTEGER) AS w, product(1 + ret) - 1 AS r FROM stock_ret WHERE ret IS NOT NULL GROUP BY 1, 2",
    "stock_ret",
)

view(
    "pw",
    "SELECT ticker, date + CAST((12 - dayofweek(date)) % 7 AS INTEGER) AS w, product(1 + ret) - 1 AS r FROM proxy_ret WHERE ret IS NOT NULL GROUP BY 1, 2",
    "proxy_ret",
)

view(
    "proxy_week",
    """SELECT s.ticker, s.week, coalesce(r, 0) AS ret FROM (SELECT ticker, CAST(unnest(generate_series(a, b, INTERVAL 7 DAY)) AS DATE) AS week FROM
    (SELECT ticker, min(w) AS a, max(w) AS b FROM pw GROUP BY 1)) s LEFT JOIN pw ON pw.ticker = s.ticker AND pw.w = s.week""",
    "pw",
)


@query("returns_dense", "W1", "ticker date:d ret:8", "SELECT ticker, date, ret FROM stock_ret WHERE ret IS NOT NULL", "stock_ret")
def _(spark, sf):
    return X.stock_returns(spark, sf).where("ret is not null")


@query(
    "horizon_returns_calendar", "W2", "ticker date:d h3:6 h5:6",
    """SELECT ticker, date, CASE WHEN count(ret) OVER a = 3 THEN product(1 + ret) OVER a - 1 END AS h3, CASE WHEN count(ret) OVER b = 5 THEN product(1 + ret) OVER b - 1 END AS h5
    FROM stock_ret WINDOW a AS (PARTITION BY ticker ORDER BY idx ROWS 2 PRECEDING), b AS (PARTITION BY ticker ORDER BY idx ROWS 4 PRECEDING) QUALIFY h3 IS NOT NULL""",
    "stock_ret",
)
def _(spark, sf):
    r = X.stock_returns(spark, sf)
    return r.select("ticker", "date", returns.horizon_return("ret", 3, "ticker", "break").alias("h3"), returns.horizon_return("ret", 5, "ticker", "break").alias("h5")).where("h3 is not null")


_Z = """SELECT ticker, date, z_5, z_63 FROM (SELECT *, CASE WHEN count(s5) OVER y >= 5 AND stddev_samp(s5) OVER y > 0 THEN (s5 - avg(s5) OVER y) / stddev_samp(s5) OVER y END AS z_5,
 CASE WHEN count(s63) OVER y >= 63 AND stddev_samp(s63) OVER y > 0 THEN (s63 - avg(s63) OVER y) / stddev_samp(s63) OVER y END AS z_63 FROM (
 SELECT ticker, date, CASE WHEN count(*) OVER a = 5 THEN sum(ret) OVER a END AS s5, CASE WHEN count(*) OVER b = 63 THEN sum(ret) OVER b END AS s63 FROM proxy_ret WHERE ret IS NOT NULL
 WINDOW a AS (PARTITION BY ticker ORDER BY date ROWS 4 PRECEDING), b AS (PARTITION BY ticker ORDER BY date ROWS 62 PRECEDING)) WINDOW y AS (PARTITION BY ticker ORDER BY date ROWS 251 PRECEDING))"""


@query("rolling_zscores", "W3", "ticker date:d z_5:6 z_63:6", _Z, "proxy_ret")
def _(spark, sf):
    return returns.with_zscores(X.proxy_returns(spark, sf).where("ret is not null"), "ticker", horizons=(5, 63))


@query(
    "vol_target", "W4", "ticker date:d leverage:6 scaled_return:6",
    """SELECT ticker, date, lev AS leverage, lev * ret AS scaled_return FROM (SELECT *, CASE WHEN count(ret) OVER w = 60 THEN least(5.0e0, CASE WHEN stddev_samp(ret) OVER w = 0 THEN 5.0e0 ELSE 0.1e0 / (stddev_samp(ret) OVER w * sqrt(252.0e0)) END) END AS lev
    FROM proxy_ret WHERE ret IS NOT NULL WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)) WHERE lev IS NOT NULL""",
    "proxy_ret",
)
def _(spark, sf):
    return returns.lagged_vol_target(X.proxy_returns(spark, sf).where("ret is not null"), "ticker")


@query(
    "vol_target_minimum", "W5", "ticker date:d scaled_return:6",
    """SELECT ticker, date, CASE WHEN n >= 30 THEN least(5.0e0, CASE WHEN s = 0 THEN 5.0e0 ELSE 0.1e0 / (s * sqrt(252.0e0)) END) * ret END AS scaled_return FROM (SELECT *, count(ret) OVER w AS n, stddev_samp(ret) OVER w AS s
    FROM stock_ret WINDOW w AS (PARTITION BY ticker ORDER BY idx ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)) WHERE ret IS NOT NULL""",
    "stock_ret",
)
def _(spark, sf):
    r = X.stock_returns(spark, sf)
    return returns.lagged_vol_target(r, "ticker", minimum=returns.default_minimum(60), gaps="break").where("ret is not null")


@query(
    "cumulative_drawdown", "W6 W7", "date:d equity:5 drawdown:6",
    """SELECT date, e AS equity, e / max(e) OVER (ORDER BY date) - 1 AS drawdown FROM (SELECT date, product(1 + ret) OVER (ORDER BY date) AS e FROM benchmark_ret WHERE ret IS NOT NULL)""",
    "benchmark_ret",
)
def _(spark, sf):
    p = X.benchmark_prices(spark, sf)
    r = returns.simple_returns(p, trading_calendar(p)).where("ret is not null")
    return returns.drawdown(returns.cumulative_index(r, "ticker", "ret", "equity"), "ticker")


@query(
    "weekly_friday_compound", "W8", "ticker week:d ret:6",
    """SELECT s.ticker, s.week, coalesce(r, 0) AS ret FROM (SELECT ticker, unnest(generate_series(a, b, INTERVAL 7 DAY)) AS week FROM (SELECT ticker, min(w) AS a, max(w) AS b FROM wk GROUP BY 1)) s
    LEFT JOIN wk ON wk.ticker = s.ticker AND wk.w = s.week""",
    "wk",
)
def _(spark, sf):
    r = X.stock_returns(spark, sf).where("ret is not null")
    return bars.weekly_returns(r, "ticker")




def _period(bucket: str) -> str:
    return f"""SELECT ticker, {bucket} AS bucket, max(date) AS date, product(1 + ret) - 1 AS period_return, arg_max(i, date) AS cumulative_index FROM (SELECT *,
    product(1 + ret) OVER (PARTITION BY ticker ORDER BY date) AS i FROM proxy_ret WHERE ret IS NOT NULL) GROUP BY 1, 2"""


for _freq, _sql in (("weekly", "strftime(date, '%G-%V')"), ("monthly", "strftime(date, '%Y-%m')"), ("daily", "CAST(date AS VARCHAR)")):

    @query(f"period_compound_{_freq}", "W9", "ticker bucket date:d period_return:6 cumulative_index:5", _period(_sql), "proxy_ret")
    def _(spark, sf, freq=_freq):
        r = returns.cumulative_index(X.proxy_returns(spark, sf).where("ret is not null"), "ticker")
        return bars.period_bars(r, "ticker", freq, index="cumulative_index")


@query(
    "forward_back_fill", "W10", "ticker date:d close:4",
    """SELECT ticker, date, coalesce(last_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date),
    first_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS close
    FROM (SELECT ticker, as_of AS date FROM ends CROSS JOIN (SELECT DISTINCT ticker FROM stock_prices)) LEFT JOIN stock_prices USING (ticker, date)""",
    "ends stock_prices",
)
def _(spark, sf):
    p = X.stock_prices(spark, sf)
    ends = X.month_end_dates(spark, sf).agg(F.collect_set("as_of").alias("d"))
    asked = p.select("ticker").distinct().join(ends, F.lit(True)).select("ticker", F.explode("d").alias("date"))
    marked = p.join(X.month_end_dates(spark, sf).select(F.col("as_of").alias("date")), "date", "left_semi")
    return fill_prices(marked, asked)


@query(
    "lagged_values", "W11", "ticker date:d prior:8",
    "SELECT ticker, date, lag(ret) OVER (PARTITION BY ticker ORDER BY date) AS prior FROM proxy_ret WHERE ret IS NOT NULL", "proxy_ret",
)
def _(spark, sf):
    return returns.shift(X.proxy_returns(spark, sf).where("ret is not null"), "ticker", "ret", "prior")


@query(
    "trailing_rows", "W12", "ticker date:d ret:8",
    "SELECT ticker, date, ret FROM stock_ret WHERE ret IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) <= 252", "stock_ret",
)
def _(spark, sf):
    return returns.trailing_rows(X.stock_returns(spark, sf).where("ret is not null"), "ticker", 252)




@query(
    "rolling_slope_156w", "W13", "ticker week:d beta:6",
    """SELECT y.ticker, y.week, regr_slope(y.ret, x.ret) OVER w AS beta FROM proxy_week y JOIN proxy_week x ON x.week = y.week AND x.ticker = 'STANDARD' WHERE y.ticker <> 'STANDARD'
    WINDOW w AS (PARTITION BY y.ticker ORDER BY y.week ROWS 155 PRECEDING) QUALIFY count(*) OVER w = 156""",
    "proxy_week",
)
def _(spark, sf):
    wk = bars.weekly_returns(X.proxy_returns(spark, sf).where("ret is not null"), "ticker")
    x = wk.where("ticker = 'STANDARD'").select("week", F.col("ret").alias("x"))
    j = wk.where("ticker <> 'STANDARD'").join(x, "week").withColumn("date", F.col("week"))
    return regression.rolling_slope(j, "ticker", "ret", "x", 156).where("beta is not null")


@query(
    "rolling_purify", "W15", "ticker date:d residual:6",
    """SELECT ticker, date, ret - a - b * x AS residual FROM (SELECT y.ticker, y.date, y.idx, y.ret, x.ret AS x, count(*) OVER w AS n, regr_slope(y.ret, x.ret) OVER w AS b, regr_intercept(y.ret, x.ret) OVER w AS a
    FROM proxy_ret y JOIN proxy_ret x ON x.date = y.date AND x.ticker = 'STANDARD' WHERE y.ticker <> 'STANDARD' AND y.ret IS NOT NULL AND x.ret IS NOT NULL
    WINDOW w AS (PARTITION BY y.ticker ORDER BY y.idx RANGE BETWEEN 125 PRECEDING AND CURRENT ROW)) WHERE n >= 63 AND idx >= 63""",
    "proxy_ret",
)
def _(spark, sf):
    r = X.proxy_returns(spark, sf)
    x = r.where("ticker = 'STANDARD'").select("date", F.col("ret").alias("x"))
    out = regression.rolling_purify(r.where("ticker <> 'STANDARD'").join(x, "date"), "ticker", "ret", "x")
    return out.where("residual is not null")


@query(
    "lag_autocorrelation", "W16", "ticker autocorrelation:6",
    "SELECT ticker, corr(ret, p) AS autocorrelation FROM (SELECT ticker, ret, lag(ret) OVER (PARTITION BY ticker ORDER BY date) AS p FROM stock_ret WHERE ret IS NOT NULL) GROUP BY 1",
    "stock_ret",
)
def _(spark, sf):
    return returns.lag_autocorrelation(X.stock_returns(spark, sf).where("ret is not null"), "ticker")


@query(
    "realized_volatility", "W22", "ticker realized_volatility:6 drawdown:6",
    """SELECT ticker, CASE WHEN count(*) >= 20 THEN stddev_samp(ret) FILTER (rn <= 60) * sqrt(252.0e0) END AS realized_volatility, CASE WHEN count(*) >= 20 THEN max(dd) FILTER (rn = 1) END AS drawdown FROM (
    SELECT *, e / max(e) OVER (PARTITION BY ticker ORDER BY date) - 1 AS dd FROM (SELECT ticker, date, ret, product(1 + ret) OVER (PARTITION BY ticker ORDER BY date) AS e,
    row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rn FROM proxy_ret WHERE ret IS NOT NULL)) GROUP BY 1""",
    "proxy_ret",
)
def _(spark, sf):
    return returns.realized_volatility(X.proxy_returns(spark, sf).where("ret is not null"), "ticker")


@query(
    "month_ends", "A16 F14", "period:d month_end:d",
    "SELECT CAST(date_trunc('month', date) AS DATE) AS period, max(date) AS month_end FROM stock_prices GROUP BY 1", "stock_prices",
)
def _(spark, sf):
    return month_ends(trading_calendar(X.stock_prices(spark, sf)))


@query(
    "month_ends_recent_and_corrected", "F14", "mode period:d month_end:d",
    """SELECT mode, period, as_of AS month_end FROM ends JOIN (VALUES ('auto'), ('latest'), ('last6')) v(mode) ON (mode = 'auto' AND as_of >= DATE '1999-05-20')
    OR (mode = 'latest' AND as_of = (SELECT max(as_of) FROM ends)) OR (mode = 'last6' AND period IN (SELECT period FROM ends ORDER BY 1 DESC LIMIT 6))""",
    "ends",
)
def _(spark, sf):
    cal = trading_calendar(X.benchmark_prices(spark, sf))
    tag = lambda df, m: df.select(F.lit(m).alias("mode"), "period", "month_end")
    return (
        tag(month_ends(cal, "auto", earliest_change="1999-05-20"), "auto")
        .unionByName(tag(month_ends(cal, "latest"), "latest"))
        .unionByName(tag(month_ends(cal, max_months=6), "last6"))
    )


@query("monthly_returns", "A14", "ticker period:d ret:6", "SELECT ticker, CAST(date_trunc('month', date) AS DATE) AS period, coalesce(product(1 + ret), 1) - 1 AS ret FROM stock_ret WHERE close IS NOT NULL GROUP BY 1, 2", "stock_ret")
def _(spark, sf):
    return bars.monthly_returns(X.stock_returns(spark, sf), "ticker")


@query(
    "forward_monthly_returns", "H14", "ticker period:d forward_return:6",
    "SELECT ticker, CAST(date_trunc('month', date) - INTERVAL 1 MONTH AS DATE) AS period, coalesce(product(1 + ret), 1) - 1 AS forward_return FROM stock_ret WHERE close IS NOT NULL GROUP BY 1, 2", "stock_ret",
)
def _(spark, sf):
    return bars.forward_monthly_returns(X.stock_returns(spark, sf), "ticker")


@query(
    "cash_rate_asof", "J6 W10 J4", "date:d annualized_rate:8",
    """SELECT o.date, annualized_rate FROM (SELECT DISTINCT CAST(ts AS DATE) + 7 AS date FROM events UNION SELECT DISTINCT CAST(ts AS DATE) - 7 FROM events) o ASOF LEFT JOIN cash_rates r ON o.date >= r.date""",
    "cash_rates",
)
def _(spark, sf):
    e = X.table(spark, sf, "events").select(F.col("ts").cast("date").alias("date"))
    asked = e.select(F.date_add("date", 7).alias("date")).union(e.select(F.date_sub("date", 7))).distinct()
    return as_of_backward(asked, X.cash_rates(spark, sf), ["annualized_rate"])


@query(
    "latest_fit_per_stock", "J7", "ticker as_of:d adjusted_r2:6",
    "SELECT ticker, max(as_of) AS as_of, arg_max(adjusted_r2, as_of) AS adjusted_r2 FROM fits WHERE as_of <= DATE '1999-06-15' GROUP BY 1", "fits",
)
def _(spark, sf):
    return latest_per_key(X.fits(spark, sf), ["ticker"], "as_of", "1999-06-15")


@query(
    "next_execution_day", "J8", "signal_date:d execution_date:d",
    """SELECT s AS signal_date, (SELECT min(date) FROM benchmark_prices WHERE date > s) AS execution_date FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS s FROM orders)""",
    "benchmark_prices",
)
def _(spark, sf):
    s = X.table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("signal_date")).distinct()
    return next_trading_day(s, trading_calendar(X.benchmark_prices(spark, sf)))


@query(
    "latest_observation", "J9", "factor date:d ret:8",
    "SELECT factor, max(date) AS date, arg_max(ret, date) AS ret FROM factor_mret WHERE date <= DATE '2000-02-15' GROUP BY 1", "factor_mret",
)
def _(spark, sf):
    return latest_per_key(X.factor_monthly(spark, sf), ["factor"], "date", "2000-02-15")


@query(
    "design_join_complete", "J1", "ticker date:d y:6 x:6",
    "SELECT s.ticker, s.date, s.ret AS y, f.ret AS x FROM stock_mret s JOIN factor_mret f ON s.date = f.date AND f.factor = 'PROMO' WHERE s.ret IS NOT NULL",
    "stock_mret factor_mret",
)
def _(spark, sf):
    y = X.stock_monthly(spark, sf).select("ticker", "date", F.col("ret").alias("y"))
    x = X.factor_monthly(spark, sf).where("factor = 'PROMO'").select("date", F.col("ret").alias("x"))
    return y.join(x, "date").dropna(subset=["y", "x"])


@query(
    "series_outer_join", "J2", "date:d stock_ret:6 proxy_ret:6",
    """SELECT coalesce(a.date, b.date) AS date, a.ret AS stock_ret, b.ret AS proxy_ret FROM (SELECT date, ret FROM stock_ret WHERE ticker = 'NATION_1' AND ret IS NOT NULL) a
    FULL JOIN (SELECT date, ret FROM proxy_ret WHERE ticker = 'PROMO' AND ret IS NOT NULL) b ON a.date = b.date""",
    "stock_ret proxy_ret",
)
def _(spark, sf):
    both = X.stock_returns(spark, sf).where("ticker = 'NATION_1'").unionByName(X.proxy_returns(spark, sf).where("ticker = 'PROMO'"))
    wide = moments.wide_panel(both.where("ret is not null"), "ticker", "ret", ["NATION_1", "PROMO"])
    return wide.select("date", F.col("v0").alias("stock_ret"), F.col("v1").alias("proxy_ret"))


@query(
    "score_forward_join", "J17", "ticker period:d score:6 forward_return:6",
    """SELECT ticker, period, beta AS score, forward_return FROM exposures JOIN (SELECT ticker, CAST(date - INTERVAL 1 MONTH AS DATE) AS period, ret AS forward_return FROM stock_mret WHERE ret IS NOT NULL) USING (ticker, period) WHERE factor = 'STANDARD'""",
    "exposures stock_mret",
)
def _(spark, sf):
    s = X.exposures(spark, sf).where("factor = 'STANDARD'").select("ticker", "period", F.col("beta").alias("score"))
    f = X.stock_monthly(spark, sf).where("ret is not null").select("ticker", F.add_months("date", -1).alias("period"), F.col("ret").alias("forward_return"))
    return aligned(s, f)


def _members(spark, sf):
    return X.securities(spark, sf).select(F.col("sector").alias("factor"), "ticker")


@query(
    "basket_skip_missing", "A1", "factor date:d ret:6",
    "SELECT sector AS factor, date, avg(ret) AS ret FROM stock_ret JOIN securities USING (ticker) WHERE ret IS NOT NULL GROUP BY 1, 2", "stock_ret securities",
)
def _(spark, sf):
    return spreads.basket_returns(X.stock_returns(spark, sf), _members(spark, sf))


@query(
    "basket_require_all", "A2", "factor date:d ret:6",
    """SELECT sector AS factor, date, avg(ret) AS ret FROM stock_mret JOIN (SELECT ticker, sector, count(*) OVER (PARTITION BY sector) AS members FROM securities) USING (ticker)
    WHERE ret IS NOT NULL GROUP BY 1, 2 HAVING count(*) = max(members)""",
    "stock_mret securities",
)
def _(spark, sf):
    return spreads.basket_returns(X.stock_monthly(spark, sf), _members(spark, sf), require_all=True)


@query(
    "basket_spread", "A3", "factor date:d ret:6",
    """SELECT a.sector AS factor, date, avg(ret) FILTER (half = 0) - avg(ret) FILTER (half = 1) AS ret FROM stock_mret JOIN (SELECT ticker, sector, row_number() OVER (PARTITION BY sector ORDER BY ticker) % 2 AS half FROM securities) a USING (ticker)
    WHERE ret IS NOT NULL GROUP BY 1, 2 HAVING count(*) FILTER (half = 0) > 0 AND count(*) FILTER (half = 1) > 0
    UNION ALL SELECT 'ALL_LONG', date, avg(ret) FROM stock_mret WHERE ret IS NOT NULL GROUP BY 2""",
    "stock_mret securities",
)
def _(spark, sf):
    from pyspark.sql import Window

    sec = X.securities(spark, sf)
    half = F.row_number().over(Window.partitionBy("sector").orderBy("ticker")) % 2
    legs = sec.select(F.col("sector").alias("factor"), F.when(half == 0, "long").otherwise("short").alias("side"), "ticker")
    legs = legs.unionByName(sec.select(F.lit("ALL_LONG").alias("factor"), F.lit("long").alias("side"), "ticker"))
    return spreads.spread_returns(X.stock_monthly(spark, sf), legs)
