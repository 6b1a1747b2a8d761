"""Registered queries: regressions, factor construction, exposures and dataset versions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.ranks import top_n
from ..operators import catalog, exposures, moments, refit, regression, returns, versioning
from ..operators.calendar import month_ends, trading_calendar
from ..operators.signals import factor_groups
from ..session import cut_lineage, shared_folder
from . import factor_model as M
from . import fixtures as X
from .oracle import VIEWS, arg_max_null, normal_p_sql, query, view

_OBS = """SELECT ticker AS factor, date, ret AS scaled_return, product(1 + ret) OVER (PARTITION BY ticker ORDER BY date) AS cumulative_index,
 count(ret) OVER (PARTITION BY ticker) / (SELECT count(DISTINCT date) FROM proxy_ret WHERE ret IS NOT NULL) AS coverage,
 {cols} FROM (SELECT *, {sums} FROM proxy_ret WHERE ret IS NOT NULL WINDOW {wins}) WINDOW y AS (PARTITION BY ticker ORDER BY date ROWS 251 PRECEDING)"""
_H = (1, 5, 21, 63, 252)
_obs_sql = _OBS.format(
    cols=", ".join(
        f"h{h}, CASE WHEN count(s{h}) OVER y >= {h} AND stddev_samp(s{h}) OVER y > 0 THEN (s{h} - avg(s{h}) OVER y) / stddev_samp(s{h}) OVER y END AS z{h}" for h in _H
    ),
    sums=", ".join(f"CASE WHEN count(*) OVER w{h} = {h} THEN sum(ret) OVER w{h} END AS s{h}, CASE WHEN count(*) OVER w{h} = {h} THEN product(1 + ret) OVER w{h} - 1 END AS h{h}" for h in _H),
    wins=", ".join(f"w{h} AS (PARTITION BY ticker ORDER BY date ROWS {h - 1} PRECEDING)" for h in _H),
)
view("observations", _obs_sql, "proxy_ret")


def proxy_panel(spark, sf):
    return X.proxy_returns(spark, sf).where("ret is not null").select(F.col("ticker").alias("factor"), "date", "ret")


@query(
    "factor_observations", "F16 F19 W2 W3 W6", "factor date:d scaled_return:8 cumulative_index:4 coverage:8 h5:6 h63:5 h252:4 z5:6 z63:6 z252:6",
    "SELECT * FROM observations", "observations",
)
def _(spark, sf):
    obs = M.factor_observations(proxy_panel(spark, sf))
    cell = lambda m, h: F.element_at(m, F.lit(h))
    return obs.select(
        "factor", "date", "scaled_return", "cumulative_index", "coverage",
        *[cell("horizons", h).alias(f"h{h}") for h in (5, 63, 252)], *[cell("zscores", h).alias(f"z{h}") for h in (5, 63, 252)],
    )


_panel_cols = ", ".join(
    f"100 * {arg_max_null('scaled_return' if h == 1 else f'h{h}', 'date')} AS return_percent_{h}, {arg_max_null(f'z{h}', 'date')} AS z_{h}" for h in _H
)


@query(
    "factor_latest_panel", "R9 J9 W1 W2 W3", "factor date:d " + " ".join(f"return_percent_{h}:4 z_{h}:6" for h in _H),
    f"SELECT factor, max(date) AS date, {_panel_cols} FROM observations GROUP BY 1", "observations",
)
def _(spark, sf):
    return M.latest_panel(M.factor_observations(proxy_panel(spark, sf), coverage=False))


view(
    "strip_design",
    "SELECT y.ticker AS factor, y.date, y.ret AS y, x.ret AS x FROM proxy_ret y JOIN proxy_ret x ON x.date = y.date AND x.ticker = 'STANDARD' WHERE y.ticker <> 'STANDARD' AND y.ret IS NOT NULL AND x.ret IS NOT NULL",
    "proxy_ret",
)
view(
    "strip_bars",
    "SELECT factor, date + CAST((12 - dayofweek(date)) % 7 AS INTEGER) AS week, product(1 + y) - 1 AS y, product(1 + x) - 1 AS x FROM strip_design GROUP BY 1, 2",
    "strip_design",
)
view(
    "strip_weeks",
    """SELECT s.factor, s.week, coalesce(y, 0) AS y, coalesce(x, 0) AS x FROM (SELECT factor, CAST(unnest(generate_series(min(week), max(week), INTERVAL 7 DAY)) AS DATE) AS week FROM strip_bars GROUP BY 1) s LEFT JOIN strip_bars USING (factor, week)""",
    "strip_bars",
)
view(
    "strip_betas",
    """SELECT factor, week, CASE WHEN count(*) OVER p < 156 THEN regr_slope(y, x) OVER p WHEN count(*) OVER w = 156 THEN regr_slope(y, x) OVER w END AS beta
    FROM strip_weeks WINDOW p AS (PARTITION BY factor), w AS (PARTITION BY factor ORDER BY week ROWS 155 PRECEDING)""",
    "strip_weeks",
)
view(
    "stripped",
    """SELECT d.factor, d.date, coalesce(b.beta, f.beta) AS beta, y - coalesce(b.beta, f.beta) * x AS ret, b.beta IS NULL AS is_warmup FROM strip_design d
    ASOF LEFT JOIN (SELECT * FROM strip_betas WHERE beta IS NOT NULL) b ON b.factor = d.factor AND d.date >= b.week
    JOIN (SELECT factor, arg_min(beta, week) AS beta FROM strip_betas WHERE beta IS NOT NULL GROUP BY 1) f ON f.factor = d.factor""",
    "strip_design", "strip_betas",
)


def strip_design(spark, sf):
    r = X.proxy_returns(spark, sf).where("ret is not null")
    x = r.where("ticker = 'STANDARD'").select("date", F.array("ret").alias("x"))
    return r.where("ticker <> 'STANDARD'").join(x, "date").select(F.col("ticker").alias("factor"), "date", F.col("ret").alias("y"), "x")


@query("strip_single_factor", "F6 W8 W13 J4 W10", "factor date:d beta:6 ret:6 is_warmup:b", "SELECT * FROM stripped", "stripped")
def _(spark, sf):
    return regression.strip_design(strip_design(spark, sf), 1).withColumn("beta", F.col("betas")[0])


@query(
    "strip_next_week", "F6 W11", "factor date:d beta:6 ret:6",
    """SELECT d.factor, d.date, coalesce(b.beta, f.beta) AS beta, y - coalesce(b.beta, f.beta) * x AS ret FROM strip_design d
    ASOF LEFT JOIN (SELECT * FROM lagged WHERE beta IS NOT NULL) b ON b.factor = d.factor AND d.date >= b.week
    JOIN (SELECT factor, arg_min(beta, week) AS beta FROM lagged WHERE beta IS NOT NULL GROUP BY 1) f ON f.factor = d.factor""".replace(
        "lagged", "(SELECT factor, week, lag(beta) OVER (PARTITION BY factor ORDER BY week) AS beta FROM strip_betas)"
    ),
    "strip_design strip_betas",
)
def _(spark, sf):
    return regression.strip_design(strip_design(spark, sf), 1, beta_timing="next_week").withColumn("beta", F.col("betas")[0])


@query(
    "strip_static_fallback", "W14", "factor date:d beta:6 ret:6 is_warmup:b",
    """SELECT d.factor, date, b.beta, y - b.beta * x AS ret, date < first_week AS is_warmup FROM strip_design d JOIN (SELECT factor, regr_slope(y, x) AS beta, min(week) AS first_week FROM strip_weeks GROUP BY 1) b USING (factor)""",
    "strip_design strip_weeks",
)
def _(spark, sf):
    return regression.strip_design(strip_design(spark, sf), 1, window_weeks=5000).withColumn("beta", F.col("betas")[0])


_SCALE = """SELECT factor, date, lev * ret AS ret FROM (SELECT *, CASE WHEN count(ret) OVER w = 60 THEN least(5.0e0, CASE WHEN stddev_samp(ret) OVER w = 0 THEN 5.0e0 ELSE 0.1e0 / (stddev_samp(ret) OVER w * sqrt(252.0e0)) END) END AS lev
    FROM {src} WINDOW w AS (PARTITION BY factor ORDER BY {order} BETWEEN 60 PRECEDING AND 1 PRECEDING)) WHERE lev * ret IS NOT NULL"""


@query("factor_build_stripped", "F7", "factor date:d ret:6", _SCALE.format(src="stripped", order="date ROWS"), "stripped")
def _(spark, sf):
    return regression.build_stripped(strip_design(spark, sf), 1)


# Stand-ins of the macro and style specifications on the proxy book.
MACRO = (
    ("Market", "raw", "STANDARD", None, 1),
    ("Rates", "vol", "PROMO", None, -1),
    ("Dollar", "vol", "SMALL", "LARGE", 1),
)
STYLE = (("Size", "ECONOMY", "STANDARD"), ("Quality", "MEDIUM", "LARGE"), ("Mirror", "LARGE", "MEDIUM"))

view(
    "macro_raw",
    """SELECT 'Market' AS factor, date, idx, ret FROM proxy_ret WHERE ticker = 'STANDARD' UNION ALL SELECT 'Rates', date, idx, -ret FROM proxy_ret WHERE ticker = 'PROMO'
    UNION ALL SELECT 'Dollar', a.date, a.idx, a.ret - b.ret FROM proxy_ret a JOIN proxy_ret b ON a.date = b.date AND a.ticker = 'SMALL' AND b.ticker = 'LARGE'""",
    "proxy_ret",
)
view(
    "style_design",
    """SELECT f AS factor, y.date, y.ret AS y, x.ret AS x FROM (VALUES ('Size', 'ECONOMY', 'STANDARD'), ('Quality', 'MEDIUM', 'LARGE'), ('Mirror', 'LARGE', 'MEDIUM')) v(f, a, b)
    JOIN proxy_ret y ON y.ticker = a JOIN proxy_ret x ON x.ticker = b AND x.date = y.date WHERE y.ret IS NOT NULL AND x.ret IS NOT NULL""",
    "proxy_ret",
)
for _v in ("bars", "weeks", "betas"):
    view(f"style_{_v}", VIEWS[f"strip_{_v}"][1].replace("strip_", "style_"), *[d.replace("strip_", "style_") for d in VIEWS[f"strip_{_v}"][0]])
view("style_pure", VIEWS["stripped"][1].replace("strip_", "style_"), "style_design", "style_betas")


@query(
    "core_factor_layer", "F1 F7", "factor date:d ret:6",
    "SELECT factor, date, ret FROM macro_raw WHERE factor = 'Market' AND ret IS NOT NULL UNION ALL "
    + f"SELECT * FROM ({_SCALE.format(src='macro_raw', order='idx ROWS')}) WHERE factor <> 'Market' UNION ALL "
    + _SCALE.format(src="style_pure", order="date ROWS"),
    "macro_raw style_pure",
)
def _(spark, sf):
    return M.core_layer(X.proxy_returns(spark, sf), MACRO, STYLE)


def layered_returns(spark, sf):
    """One dense book: part types, supplier regions, market segments and order priorities."""
    li = X.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    p = X.table(spark, sf, "part").select("p_partkey", "p_type")
    s = X.table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    n = X.table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    r = X.table(spark, sf, "region").select("r_regionkey", "r_name")
    o = X.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    c = X.table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    j = (
        li.join(p, li.l_partkey == p.p_partkey).join(s, li.l_suppkey == s.s_suppkey).join(n, s.s_nationkey == n.n_nationkey)
        .join(r, n.n_regionkey == r.r_regionkey).join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey)
    )
    names = F.explode(F.array("p_type", "r_name", "c_mktsegment", "o_orderpriority")).alias("ticker")
    book = (
        j.select(names, F.col("l_shipdate").cast("date").alias("date"), "l_extendedprice")
        .groupBy("ticker", "date").agg(F.max("l_extendedprice").alias("close"))
    )
    return returns.simple_returns(book, trading_calendar(book))


SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


# Raw macro legs: a lagged 60-day estimate needs two gap-free months, rare on the small tables.
LAYERED_MACRO = (("Market", "raw", "STANDARD", None, 1), ("Rates", "raw", "PROMO", None, -1), ("Dollar", "raw", "SMALL", "LARGE", 1))


def layered_model(spark, sf, **switches):
    r = cut_lineage(layered_returns(spark, sf))
    return M.build_model(
        r, macro=LAYERED_MACRO, style=STYLE,
        sectors={f"Sector: {x}": x for x in (*REGIONS, "ABSENT")},
        industries={f"Industry: {x}": x for x in SEGMENTS},
        countries={f"Country: {x}": x for x in PRIORITIES},
        themes=[("Theme: A", "ASIA"), ("Theme: A", "BUILDING"), ("Theme: B", "EUROPE"), ("Theme: B", "PROMO")],
        **switches,
    )


@query("factor_model_full", "F2 F3 F4 F5 W13", "factor date:d ret:6")
def _(spark, sf):
    return layered_model(spark, sf)


@query("factor_model_core_sector", "F2 F5", "factor date:d ret:6")
def _(spark, sf):
    return layered_model(spark, sf, with_industries=False)


@query(
    "single_factor_hac", "F8 F10", "ticker observation_count:i alpha:6 alpha_se:6 beta:6 standard_error:6 t_stat:5 p_value:6 ci_low:6 ci_high:6 adjusted_r2:6 residual_volatility:5",
    """SELECT ticker, n AS observation_count, a AS alpha, sqrt(saa) AS alpha_se, b AS beta, sqrt(sbb) AS standard_error, b / sqrt(sbb) AS t_stat, b - 1.959963984540054e0 * sqrt(sbb) AS ci_low, b + 1.959963984540054e0 * sqrt(sbb) AS ci_high, 1 - (rss / (n - 2)) / (tss / (n - 1)) AS adjusted_r2, sqrt(rss / (n - 1)) * sqrt(252.0e0) AS residual_volatility, P AS p_value
    FROM (SELECT *, PVAL AS P FROM (SELECT ticker, n, a, b, sum(e * e) AS rss, max(tss) AS tss,
      (sum(g * g) + 2 * (LAGS_G)) AS saa, (sum(h * h) + 2 * (LAGS_H)) AS sbb FROM (SELECT *, LAGCOLS FROM (SELECT *, y - a - b * x AS e,
        (y - a - b * x) * (1.0e0 / n - mx * (x - mx) / sxx) AS g, (y - a - b * x) * (x - mx) / sxx AS h FROM (SELECT s.ticker, s.date, s.ret AS y, f.ret AS x, count(*) OVER p AS n, regr_slope(s.ret, f.ret) OVER p AS b, regr_intercept(s.ret, f.ret) OVER p AS a,
        avg(f.ret) OVER p AS mx, regr_sxx(s.ret, f.ret) OVER p AS sxx, regr_syy(s.ret, f.ret) OVER p AS tss FROM stock_mret s JOIN factor_mret f ON s.date = f.date AND f.factor = 'STANDARD' WHERE s.ret IS NOT NULL WINDOW p AS (PARTITION BY s.ticker)))
        WINDOW t AS (PARTITION BY ticker ORDER BY date)) GROUP BY 1, 2, 3, 4))""".replace(
        "LAGCOLS", ", ".join(f"lag(g, {i}) OVER t AS g{i}, lag(h, {i}) OVER t AS h{i}" for i in range(1, 6))
    )
    .replace("LAGS_G", " + ".join(f"{1 - i / 6.0!r} * coalesce(sum(g * g{i}), 0)" for i in range(1, 6)))
    .replace("LAGS_H", " + ".join(f"{1 - i / 6.0!r} * coalesce(sum(h * h{i}), 0)" for i in range(1, 6)))
    .replace("PVAL", normal_p_sql("b / sqrt(sbb)")),
    "stock_mret factor_mret",
)
def _(spark, sf):
    x = X.factor_monthly(spark, sf).where("factor = 'STANDARD'").select("date", F.col("ret").alias("x"))
    return regression.single_factor_fit(X.stock_monthly(spark, sf).join(x, "date"), "ticker", "ret", "x", min_obs=24)


@query(
    "gram_two_factor_fit", "A19 F8", "ticker observation_count:i alpha:6 beta_1:6 beta_2:6 adjusted_r2:6",
    """SELECT ticker, n AS observation_count, my - b1 * m1 - b2 * m2 AS alpha, b1 AS beta_1, b2 AS beta_2, 1 - ((syy - b1 * s1y - b2 * s2y) / (n - 3)) / (syy / (n - 1)) AS adjusted_r2 FROM (
    SELECT *, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b1, (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS b2 FROM (SELECT s.ticker, count(*) AS n, avg(s.ret) AS my, avg(f.ret) AS m1, avg(g.ret) AS m2,
    regr_sxx(f.ret, f.ret) AS s11, regr_sxx(g.ret, g.ret) AS s22, regr_sxy(f.ret, g.ret) AS s12, regr_sxy(s.ret, f.ret) AS s1y, regr_sxy(s.ret, g.ret) AS s2y, regr_sxx(s.ret, s.ret) AS syy
    FROM stock_mret s JOIN factor_mret f ON s.date = f.date AND f.factor = 'STANDARD' JOIN factor_mret g ON s.date = g.date AND g.factor = 'PROMO' WHERE s.ret IS NOT NULL GROUP BY 1))""",
    "stock_mret factor_mret",
)
def _(spark, sf):
    f = X.factor_monthly(spark, sf)
    x1 = f.where("factor = 'STANDARD'").select("date", F.col("ret").alias("x1"))
    x2 = f.where("factor = 'PROMO'").select("date", F.col("ret").alias("x2"))
    return moments.two_regressor_fit(X.stock_monthly(spark, sf).join(x1, "date").join(x2, "date"), ["ticker"], "ret", "x1", "x2")


def _grid(spark, sf, levels, mode="fixed", ends=None, window=36, minimum=24):
    cal = X.month_calendar(spark, sf)
    return exposures.exposure_grid(
        X.stock_monthly(spark, sf), X.factor_monthly(spark, sf), cal, month_ends(cal) if ends is None else ends(cal), levels,
        window=window, minimum=minimum, selection_mode=mode,
    )


view(
    "grid_rows",
    """SELECT s.ticker, m.date AS period, s.date, s.idx, s.ret AS y, f.ret AS x1, g.ret AS x2 FROM month_cal m JOIN stock_mret s ON s.idx > m.idx - 36 AND s.idx <= m.idx
    JOIN factor_mret f ON f.date = s.date AND f.factor = 'STANDARD' JOIN factor_mret g ON g.date = s.date AND g.factor = 'PROMO' WHERE s.ret IS NOT NULL""",
    "month_cal", "stock_mret", "factor_mret",
)
view(
    "grid_moments",
    """SELECT *, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b1, (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS b2 FROM (SELECT ticker, period, count(*) AS n, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2,
    regr_sxx(x1, x1) AS s11, regr_sxx(x2, x2) AS s22, regr_sxy(x1, x2) AS s12, regr_sxy(y, x1) AS s1y, regr_sxy(y, x2) AS s2y, regr_sxx(y, y) AS syy FROM grid_rows GROUP BY 1, 2 HAVING count(*) >= 24)""",
    "grid_rows",
)


@query(
    "exposure_grid_fixed", "F8 F10 F12 A19", "ticker period:d as_of:d observation_count:i design_factor_count:i coverage:6 alpha:6 adjusted_r2:6 residual_volatility:5 is_provisional:b",
    """SELECT ticker, period, period AS as_of, n AS observation_count, 2 AS design_factor_count, c AS coverage, my - b1 * m1 - b2 * m2 AS alpha, 1 - ((syy - b1 * s1y - b2 * s2y) / (n - 3)) / (syy / (n - 1)) AS adjusted_r2,
    sqrt((syy - b1 * s1y - b2 * s2y) / (n - 1)) * sqrt(252.0e0) AS residual_volatility, period = (SELECT max(date) FROM month_cal) AS is_provisional FROM grid_moments JOIN
    (SELECT s.ticker, m.date AS period, count(*) / least(36, max(m.idx)) AS c FROM month_cal m JOIN stock_mret s ON s.idx > m.idx - 36 AND s.idx <= m.idx AND s.ret IS NOT NULL GROUP BY 1, 2) USING (ticker, period)""",
    "grid_moments month_cal stock_mret",
)
def _(spark, sf):
    return exposures.fit_rows(_grid(spark, sf, {"two": ["STANDARD", "PROMO"]}))


@query(
    "exposure_grid_inference", "F8 F10 F12", "ticker period:d factor beta:6 standard_error:6 t_stat:4 ci_low:6",
    """SELECT ticker, period, factor, b AS beta, sqrt(v) AS standard_error, b / sqrt(v) AS t_stat, b - 1.959963984540054e0 * sqrt(v) AS ci_low FROM (SELECT ticker, period, factor, b,
    (sum(u * u) + 2 * (LAGS)) / (sum(z * z) * sum(z * z)) AS v FROM (SELECT *, LAGCOLS FROM (SELECT ticker, period, date, factor, b, z, z * e AS u FROM (
      SELECT r.ticker, period, date, y - my - b1 * (x1 - m1) - b2 * (x2 - m2) AS e, unnest(['STANDARD', 'PROMO']) AS factor, unnest([b1, b2]) AS b,
      unnest([x1 - m1 - s12 / s22 * (x2 - m2), x2 - m2 - s12 / s11 * (x1 - m1)]) AS z FROM grid_rows r JOIN grid_moments USING (ticker, period)))
    WINDOW t AS (PARTITION BY ticker, period, factor ORDER BY date)) GROUP BY 1, 2, 3, 4)""".replace(
        "LAGCOLS", ", ".join(f"lag(u, {i}) OVER t AS u{i}" for i in range(1, 6))
    ).replace("LAGS", " + ".join(f"{1 - i / 6.0!r} * coalesce(sum(u * u{i}), 0)" for i in range(1, 6))),
    "grid_rows grid_moments",
)
def _(spark, sf):
    return exposures.exposure_rows(_grid(spark, sf, {"two": ["STANDARD", "PROMO"]}))


@query("exposure_grid_elastic_net", "F9 F12", "ticker level period:d active_factor_count:i observation_count:i adjusted_r2:6")
def _(spark, sf):
    levels = {"three": ["STANDARD", "PROMO", "SMALL"], "six": list(X.FACTORS)}
    return exposures.fit_rows(_grid(spark, sf, levels, "elastic_net", month_ends))


@query("latest_exposures", "F11", "ticker level as_of:d factor beta:6 standard_error:6 p_value:6")
def _(spark, sf):
    out = exposures.latest_exposures(X.stock_monthly(spark, sf), X.factor_monthly(spark, sf), X.month_calendar(spark, sf), X.FACTORS)
    return exposures.exposure_rows(out)


@query(
    "catalog_members_rank", "F15 G3", "level factor position:i family_order:i",
    """SELECT sector AS level, ticker AS factor, row_number() OVER (PARTITION BY sector ORDER BY current_shares DESC, ticker) AS position, CASE WHEN current_shares > 3 THEN 4 ELSE 3 END AS family_order FROM securities""",
    "securities",
)
def _(spark, sf):
    sec = X.securities(spark, sf)
    members = top_n(sec.select(F.col("sector").alias("level"), F.col("ticker").alias("factor"), F.col("current_shares").cast("double").alias("s")), ["level"], "s", "factor", 1000)
    defs = sec.select(F.col("ticker").alias("factor"), F.when(F.col("current_shares") > 3, "sector").otherwise("style").alias("family"))
    return factor_groups(defs, members.withColumnRenamed("pick", "position"))


@query(
    "construction_details", "F20", "factor kind long_leg hedges n:i",
    """SELECT p_type AS factor, k AS kind, l AS long_leg, h AS hedges, count(*) AS n FROM part LEFT JOIN (VALUES ('STANDARD', 'direct_etf', 'IVV', ''), ('PROMO', 'inverted_etf', 'TLT', ''), ('SMALL', 'residualized_style', 'IJR', 'IVV'),
    ('LARGE', 'residualized_sector', 'XLK', 'core factors'), ('MEDIUM', 'long_short', 'UUP', ''), ('ECONOMY', 'unknown', NULL, '')) v(f, k, l, h) ON f = p_type GROUP BY 1, 2, 3, 4""",
)
def _(spark, sf):
    pairs = {"STANDARD": "Market", "PROMO": "InterestRate", "SMALL": "SmallSize", "LARGE": "Sector: Technology", "MEDIUM": "USDollar", "ECONOMY": "Nothing"}
    name = F.coalesce(*[F.when(F.col("p_type") == k, F.lit(v)) for k, v in pairs.items()])
    parts = X.table(spark, sf, "part").groupBy(F.col("p_type").alias("factor"), name.alias("construction")).agg(F.count(F.lit(1)).alias("n"))
    out = catalog.construction_details(catalog.specifications(spark), parts)
    return out.withColumn("hedges", F.coalesce(F.concat_ws(",", "purified_against"), F.lit("")))


@query(
    "theme_equations", "F21", "factor ticker weight:8",
    "SELECT sector AS factor, ticker, 1.0e0 / count(*) OVER (PARTITION BY sector) AS weight FROM securities", "securities",
)
def _(spark, sf):
    eq = catalog.theme_equations(X.securities(spark, sf).select(F.col("sector").alias("factor"), "ticker"), "2001-12-01")
    return eq.select("factor", F.explode("basket_weights").alias("ticker", "weight"))


def _stored(spark, sf, corrected: bool):
    f = X.factor_monthly(spark, sf).select("factor", "date", "ret")
    old = f.where("date < date '2001-06-01'")
    if corrected:
        old = old.withColumn("ret", F.when((F.col("date") == F.lit("1999-03-01").cast("date")) & (F.col("factor") == "PROMO"), F.col("ret") + 0.5).otherwise(F.col("ret")))
    return f, old


view("stored_append", "SELECT factor, date, ret FROM factor_mret WHERE date < DATE '2001-06-01'", "factor_mret")
view(
    "stored_correct",
    "SELECT factor, date, CASE WHEN date = DATE '1999-03-01' AND factor = 'PROMO' THEN ret + 0.5e0 ELSE ret END AS ret FROM factor_mret WHERE date < DATE '2001-06-01'",
    "factor_mret",
)


@query(
    "factor_diff", "F17", "factor date:d ret:8 previous:8 change",
    """SELECT n.factor, n.date, n.ret, o.ret AS previous, CASE WHEN o.ret IS NULL THEN 'added' ELSE 'changed' END AS change FROM factor_mret n LEFT JOIN stored_correct o USING (factor, date)
    WHERE o.ret IS NULL OR NOT abs(o.ret - n.ret) <= 1e-8 + 1e-5 * abs(n.ret)""",
    "factor_mret stored_correct",
)
def _(spark, sf):
    return versioning.diff_observations(*_stored(spark, sf, True))


_SUMMARY = """SELECT CASE WHEN c = 0 THEN 'unchanged' WHEN e > p THEN 'append' ELSE 'correction' END AS mode, c AS changed_observations, e AS earliest_changed_date, p AS previous_as_of FROM (
    SELECT count(*) AS c, min(n.date) AS e, (SELECT max(date) FROM {s}) AS p FROM factor_mret n LEFT JOIN {s} o USING (factor, date) WHERE o.ret IS NULL OR NOT abs(o.ret - n.ret) <= 1e-8 + 1e-5 * abs(n.ret))"""


@query(
    "factor_update_mode", "F17", "mode changed_observations:i earliest_changed_date:d previous_as_of:d",
    " UNION ALL ".join(f"SELECT * FROM ({_SUMMARY.format(s=s)})" for s in ("stored_append", "stored_correct", "(SELECT factor, date, ret FROM factor_mret)")),
    "factor_mret stored_append stored_correct",
)
def _(spark, sf):
    out = []
    for corrected in (False, True):
        new, old = _stored(spark, sf, corrected)
        out.append(versioning.update_summary(versioning.diff_observations(new, old), old))
    out.append(versioning.update_summary(versioning.diff_observations(new, new), new))
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(
    "fit_invalidation", "F18", "mode ticker period:d as_of:d",
    """SELECT 'correction' AS mode, ticker, period, as_of FROM fits WHERE as_of >= DATE '1999-03-01' UNION ALL
    SELECT 'append', ticker, period, as_of FROM fits WHERE period = (SELECT max(date) FROM factor_mret) AND as_of <> (SELECT max(date) FROM factor_mret)""",
    "fits factor_mret",
)
def _(spark, sf):
    fits, out = X.fits(spark, sf), []
    for corrected in (True, False):
        new, old = _stored(spark, sf, corrected)
        summary = versioning.update_summary(versioning.diff_observations(new, old), old)
        stale = versioning.invalidated_fits(fits, summary, new.agg(F.max("date").alias("latest_date")))
        out.append(stale.select(F.lit("correction" if corrected else "append").alias("mode"), "ticker", "period", "as_of"))
    return out[0].unionByName(out[1])


# windows end at the last day of the whole design, and a month is fitted up to three after a stock's last return
view(
    "six_ends",
    "SELECT m.date AS period, m.idx, max(c.idx) AS e FROM month_cal m JOIN month_cal c ON c.idx <= m.idx SEMI JOIN (SELECT date FROM factor_mret GROUP BY 1 HAVING count(*) = 6) f ON f.date = c.date GROUP BY 1, 2",
    "month_cal", "factor_mret",
)
_SIX_ROWS = """SELECT s.ticker, m.period, count(*) AS n FROM six_ends m JOIN stock_mret s ON s.idx > m.e - {w} AND s.idx <= m.e AND s.ret IS NOT NULL SEMI JOIN (SELECT date FROM factor_mret GROUP BY 1 HAVING count(*) = 6) f ON f.date = s.date
    JOIN (SELECT ticker, max(date) AS b FROM stock_mret WHERE ret IS NOT NULL GROUP BY 1) l ON l.ticker = s.ticker AND m.period <= l.b + INTERVAL 3 MONTH {where} GROUP BY 1, 2 HAVING count(*) >= {least}"""


@query(
    "refit_partitions", "F22 S9 F12", "step mode changed:i partitions:i level ticker period:d observation_count:i adjusted_r2:6",
    """SELECT step, mode, changed, partitions, level, ticker, period, n AS observation_count, adjusted_r2 FROM (
    SELECT 'two' AS level, ticker, period, n, 1 - ((syy - b1 * s1y - b2 * s2y) / (n - 3)) / (syy / (n - 1)) AS adjusted_r2 FROM grid_moments UNION ALL
    SELECT 'six', ticker, period, n, NULL FROM (SIX_ROWS))
    CROSS JOIN (SELECT 'update' AS step, 'correction' AS mode, 1 + (SELECT count(*) FROM factor_mret WHERE date >= DATE '2001-06-01') AS changed, 2 * count(*) AS partitions FROM month_cal WHERE date >= DATE '1999-03-01')""".replace("SIX_ROWS", _SIX_ROWS.format(w=36, where="", least=24)),
    "grid_moments month_cal stock_mret factor_mret six_ends",
)
def _(spark, sf):
    """A store is built from the older panel and brought up to date: its fits equal a full build from the newer one."""
    new, old = _stored(spark, sf, True)
    cal = X.month_calendar(spark, sf)
    root = shared_folder(spark, "stores", f"fits-{uuid.uuid4().hex}")
    for panel in (old, new):
        summary = refit.update_fit_store(
            root, panel, X.stock_monthly(spark, sf), cal, month_ends(cal), {"two": ["STANDARD", "PROMO"], "six": list(X.FACTORS)}, window=36, minimum=24, selection_mode="fixed")
    told = summary.select(F.lit("update").alias("step"), "mode", F.col("changed_observations").alias("changed"), F.col("refit_partitions").alias("partitions"), F.lit(1).alias("k"))
    fits = refit.read_fits(spark, root).withColumn("adjusted_r2", F.when(F.col("level") == "two", F.col("adjusted_r2")))
    return fits.withColumn("k", F.lit(1)).join(told, "k")


def normal_equations(fits, returns, factors, window):
    """(ticker, level, period, observation_count, regressors, orthogonal): whether residuals, recomputed from returns, are orthogonal to 1 and all regressors kept."""
    wide = factors.groupBy("date").agg(F.map_from_entries(F.collect_list(F.struct("factor", "ret"))).alias("x"))
    rows = returns.where("ret is not null").select("ticker", "date", "idx", F.col("ret").alias("y")).join(wide, "date")
    span = fits.select("ticker", "level", "period", "alpha", "factors", "beta", "end_idx", "design", F.explode(F.sequence(F.col("end_idx") - window + 1, F.col("end_idx"))).alias("idx"))
    j = span.join(rows, ["ticker", "idx"]).where(F.forall("design", lambda f: F.try_element_at("x", f).isNotNull()))
    fitted = F.aggregate(F.arrays_zip("factors", "beta"), F.col("alpha"), lambda s, z: s + z["beta"] * F.element_at("x", z["factors"]))
    e = j.withColumn("e", F.col("y") - fitted).select("ticker", "level", "period", "e", F.explode(F.concat(F.array(F.struct(F.lit("1").alias("f"), F.lit(1.0).alias("v"))), F.transform("factors", lambda f: F.struct(f.alias("f"), F.element_at("x", f).alias("v"))))).alias("r"))
    cells = e.groupBy("ticker", "level", "period", "r.f").agg(F.count("*").alias("n"), F.sum(F.col("e") * F.col("r.v")).alias("c"), F.sqrt(F.sum(F.col("e") * F.col("e")) * F.sum(F.col("r.v") * F.col("r.v"))).alias("scale"))
    return cells.groupBy("ticker", "level", "period").agg(F.max("n").alias("observation_count"), (F.count("*") - 1).alias("regressors"), F.bool_and(F.abs("c") <= 1e-7 * F.col("scale") + 1e-12).alias("orthogonal"))


def _checked(spark, sf, fits, window, design=X.FACTORS):
    places = X.month_calendar(spark, sf).select(F.col("date").alias("as_of"), F.col("idx").alias("end_idx"))
    marked = fits.join(places, "as_of").withColumn("design", F.array(*[F.lit(f) for f in design]))
    return normal_equations(marked, X.stock_monthly(spark, sf), X.factor_monthly(spark, sf), window)


@query(
    "exposure_orthogonality", "F8 F12", "ticker period:d observation_count:i regressors:i orthogonal:b",
    f"SELECT ticker, period, n AS observation_count, 6 AS regressors, true AS orthogonal FROM ({_SIX_ROWS.format(w=36, where='', least=24)})", "six_ends month_cal stock_mret factor_mret",
)
def _(spark, sf):
    """Six-factor fits of all months: residuals recomputed from returns are orthogonal to every regressor."""
    return _checked(spark, sf, _grid(spark, sf, {"six": list(X.FACTORS)}), 36)


@query(
    "elastic_net_orthogonality", "F9 F12", "ticker period:d observation_count:i chosen:b orthogonal:b",
    f"SELECT ticker, period, n AS observation_count, true AS chosen, true AS orthogonal FROM ({_SIX_ROWS.format(w=36, where='', least=24)})", "six_ends month_cal stock_mret factor_mret",
)
def _(spark, sf):
    """Fits after selection: at least one and at most six factors, and residuals orthogonal to all that were kept."""
    out = _checked(spark, sf, _grid(spark, sf, {"six": list(X.FACTORS)}, "elastic_net"), 36)
    return out.withColumn("chosen", F.col("regressors").between(1, 6))


@query(
    "latest_exposure_orthogonality", "F11", "ticker observation_count:i orthogonal:b",
    f"SELECT ticker, n AS observation_count, true AS orthogonal FROM ({_SIX_ROWS.format(w=252, where='WHERE m.idx = (SELECT max(idx) FROM month_cal)', least=60)})", "six_ends month_cal stock_mret factor_mret",
)
def _(spark, sf):
    out = exposures.latest_exposures(X.stock_monthly(spark, sf), X.factor_monthly(spark, sf), X.month_calendar(spark, sf), X.FACTORS, selection_mode="fixed")
    return _checked(spark, sf, out, 252)


@query("incremental_update", "F22", "ticker level period:d observation_count:i adjusted_r2:6")
def _(spark, sf):
    new, old = _stored(spark, sf, True)
    cal = X.month_calendar(spark, sf)
    ends = month_ends(cal)
    levels = {"two": ["STANDARD", "PROMO"]}
    opts = dict(window=36, minimum=24, selection_mode="fixed")
    r = X.stock_monthly(spark, sf)
    stored = cut_lineage(exposures.exposure_grid(r, old, cal, ends, levels, **opts))
    return M.incremental_update(new, old, stored, r, cal, ends, levels, **opts)["fits"]


@query(
    "merge_unseen_observations", "J12 F23", "factor date:d ret:8",
    "SELECT * FROM stored_correct UNION ALL SELECT factor, date, ret FROM factor_mret WHERE date >= DATE '2001-06-01'", "stored_correct factor_mret",
)
def _(spark, sf):
    new, old = _stored(spark, sf, True)
    return versioning.merge_unseen(old, new, ["factor", "date"])


@query(
    "merge_replacing_fits", "J13 F23", "ticker period:d adjusted_r2:6 origin",
    """SELECT ticker, period, -1 AS adjusted_r2, 'kept' AS origin FROM fits WHERE period < DATE '1999-01-01' UNION ALL
    SELECT ticker, period, adjusted_r2, CASE WHEN period < DATE '2000-01-01' THEN 'replaced' ELSE 'created' END FROM fits WHERE period >= DATE '1999-01-01'""",
    "fits",
)
def _(spark, sf):
    f = X.fits(spark, sf).select("ticker", "period", "adjusted_r2")
    target = f.where("period < date '2000-01-01'").withColumn("adjusted_r2", F.lit(-1.0))
    return versioning.merge_replacing(target, f.where("period >= date '1999-01-01'"), ["ticker", "period"])


@query(
    "repoint_ids", "F23", "o_orderkey:i o_custkey:i",
    "SELECT o_orderkey, CASE WHEN o_custkey % 5 = 0 THEN o_custkey + 1000000 ELSE o_custkey END AS o_custkey FROM orders",
)
def _(spark, sf):
    c = X.table(spark, sf, "customer").where("c_custkey % 5 = 0")
    mapping = c.select(F.col("c_custkey").alias("old_id"), (F.col("c_custkey") + 1000000).alias("new_id"))
    return versioning.repoint(X.table(spark, sf, "orders").select("o_orderkey", "o_custkey"), mapping, "o_custkey")


@query(
    "best_build", "T6", "stock_count:i as_of:d build_id",
    """SELECT n AS stock_count, as_of, build_id FROM (SELECT f.sector AS build_id, m AS as_of, count(DISTINCT ticker) AS n FROM fits f JOIN (SELECT sector, max(as_of) AS m FROM fits GROUP BY 1) g ON g.sector = f.sector AND f.as_of = m GROUP BY 1, 2)
    ORDER BY n DESC, as_of DESC, build_id DESC LIMIT 1""",
    "fits",
)
def _(spark, sf):
    return versioning.best_build(X.fits(spark, sf).withColumnRenamed("sector", "build_id"))


@query(
    "modelled_holdings", "T6 A15", "portfolio build_id modeled:i",
    "SELECT portfolio, sector AS build_id, count(DISTINCT ticker) AS modeled FROM fits JOIN holdings USING (ticker) GROUP BY 1, 2", "fits holdings",
)
def _(spark, sf):
    return versioning.modelled_holdings(X.fits(spark, sf).withColumnRenamed("sector", "build_id"), X.holdings(spark, sf))


@query(
    "fit_counts_by_level", "A15", "sector fit_count:i stocks:i most:i",
    "SELECT sector, count(*) AS fit_count, count(DISTINCT ticker) AS stocks, max(observation_count) AS most FROM fits GROUP BY 1", "fits",
)
def _(spark, sf):
    return X.fits(spark, sf).groupBy("sector").agg(
        F.count(F.lit(1)).alias("fit_count"), F.countDistinct("ticker").alias("stocks"), F.max("observation_count").alias("most")
    )
