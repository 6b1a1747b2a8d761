"""Registered queries: cross-sectional scores, screens, selections and their evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ranks import quantile_group, ranked, top_n
from ..operators import cross_section as CS
from ..operators import evaluation, screening, signals
from ..operators.calendar import as_of_backward
from . import fixtures as X
from .oracle import query, view

WEIGHTS = {"STANDARD": 2.0, "PROMO": 1.0, "SMALL": 1.5}
DIRECTIONS = {"PROMO": -1}
_W_SQL = "(VALUES ('STANDARD', 2.0e0, 1), ('PROMO', 1.0e0, -1), ('SMALL', 1.5e0, 1)) w(factor, weight, direction)"

# Average-rank percentile, as a check of the sliced ranks.
_PCT = "(rank() OVER (PARTITION BY {p} ORDER BY {s}) + (count(*) OVER (PARTITION BY {p}, {s}) - 1) / 2.0e0) / count(*) OVER (PARTITION BY {p})"
_RANK = "row_number() OVER (PARTITION BY {p} ORDER BY {s} DESC, ticker)"


def _by(template: str, part: str, score: str) -> str:
    return template.format(p=part, s=score)


view(
    "grid_betas",
    f"SELECT f.ticker, f.sector, f.period, f.as_of, w.factor, w.weight, w.direction, coalesce(e.beta, 0) AS beta, e.beta IS NOT NULL AS selected, e.t_stat FROM fits f CROSS JOIN {_W_SQL} "
    "LEFT JOIN exposures e ON e.ticker = f.ticker AND e.period = f.period AND e.factor = w.factor",
    "fits", "exposures",
)
view(
    "z_betas",
    "SELECT *, CASE WHEN stddev_pop(beta) OVER g > 0 THEN (beta - avg(beta) OVER g) / stddev_pop(beta) OVER g ELSE 0 END * direction AS z FROM grid_betas WINDOW g AS (PARTITION BY period, factor)",
    "grid_betas",
)
# Composites are rounded before ranking only where both engines rank the same digits.
view(
    "composites",
    "SELECT ticker, sector, period, as_of, sum(weight * greatest(least(z, 3), -3)) / sum(abs(weight)) AS composite, sum(CASE WHEN selected THEN 1 ELSE 0 END) / 3.0e0 AS confidence FROM z_betas GROUP BY 1, 2, 3, 4",
    "z_betas",
)


@query(
    "beta_fill_unselected", "J10 J5", "ticker period:d factor beta:6 selected:b", "SELECT * FROM grid_betas", "grid_betas",
)
def _(spark, sf):
    return CS.fill_unselected(
        X.fits(spark, sf).select("ticker", "period"), X.exposures(spark, sf).select("ticker", "period", "factor", "beta"), ["ticker", "period"], CS.factor_table(WEIGHTS, DIRECTIONS, X.FACTORS)
    )


@query("zscore_cross_section", "W20 W21", "ticker period:d z:6 capped:6", """SELECT ticker, date AS period, z, greatest(least(-z, 3), -3) AS capped FROM (SELECT ticker, date, CASE WHEN stddev_pop(ret) OVER g > 0 THEN (ret - avg(ret) OVER g) / stddev_pop(ret) OVER g ELSE 0 END AS z
    FROM stock_mret WHERE ret IS NOT NULL WINDOW g AS (PARTITION BY date))""", "stock_mret")
def _(spark, sf):
    r = X.stock_monthly(spark, sf).where("ret is not null").select("ticker", F.col("date").alias("period"), "ret")
    return CS.capped_zscore(CS.zscore(r, ["period"], "ret", "z"), ["period"], "ret", "capped", -1)


@query(
    "cross_section_ranks", "W17 W18 W19", "ticker date:d rank:i percentile:8 n:i quintile:i",
    f"""SELECT ticker, date, row_number() OVER (PARTITION BY date ORDER BY close DESC, ticker) AS rank, {_by(_PCT, 'date', 'close')} AS percentile, n, CASE WHEN n > 1 THEN CAST(greatest(ceil(5 * (r - 1) / (n - 1)), 1) - 1 AS INT) ELSE 0 END AS quintile
    FROM (SELECT *, count(*) OVER (PARTITION BY date) AS n, row_number() OVER (PARTITION BY date ORDER BY close, ticker DESC) AS r FROM (SELECT ticker, date, round(close / 10000) AS close FROM stock_prices))""",
    "stock_prices",
)
def _(spark, sf):
    # rounded closes produce heavy ties
    p = X.stock_prices(spark, sf).withColumn("close", F.round(F.col("close") / 10000))
    r = ranked(p, ["date"], "close", "ticker")
    up = F.col("ranked_count") + 1 - F.col("rank")
    return r.withColumn("n", F.col("ranked_count")).withColumn("quintile", quantile_group(up, F.col("ranked_count")))


@query(
    "rank_whole_table", "W17 W18", "l_orderkey:i l_linenumber:i rank:i percentile:8",
    """SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_quantity DESC, k) AS rank, (rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0e0) / count(*) OVER (PARTITION BY l_returnflag) AS percentile
    FROM (SELECT *, concat(lpad(CAST(l_orderkey AS VARCHAR), 10, '0'), '-', CAST(l_linenumber AS VARCHAR)) AS k FROM lineitem)""",
)
def _(spark, sf):
    li = X.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    key = F.concat(F.lpad(F.col("l_orderkey").cast("string"), 10, "0"), F.lit("-"), F.col("l_linenumber").cast("string"))
    return ranked(li.withColumn("k", key), ["l_returnflag"], "l_quantity", "k")


@query(
    "rank_integer_tie", "W17 W18", "o_orderkey:i rank:i percentile:8",
    """SELECT o_orderkey, row_number() OVER (ORDER BY s, o_orderkey) AS rank, (rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0e0) / count(*) OVER () AS percentile
    FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 0e0 ELSE CAST(o_totalprice AS DOUBLE) END AS s FROM orders)""",
)
def _(spark, sf):
    s = F.when(F.col("o_orderkey") % 3 == 0, F.lit(0.0)).otherwise(F.col("o_totalprice").cast("double"))
    return ranked(X.table(spark, sf, "orders").select("o_orderkey", s.alias("s")), [], "s", "o_orderkey", ascending=True).select("o_orderkey", "rank", "percentile")


@query(
    "rank_text_tie", "W17 W18", "o_orderkey:i rank:i percentile:8",
    """SELECT o_orderkey, row_number() OVER (ORDER BY s DESC, concat('株式会社の名前', lpad(CAST(o_orderkey AS VARCHAR), 12, '0'))) AS rank, (rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0e0) / count(*) OVER () AS percentile
    FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 0e0 ELSE CAST(o_totalprice AS DOUBLE) END AS s FROM orders)""",
)
def _(spark, sf):
    s = F.when(F.col("o_orderkey") % 3 == 0, F.lit(0.0)).otherwise(F.col("o_totalprice").cast("double"))
    name = F.concat(F.lit("株式会社の名前"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0"))
    rows = X.table(spark, sf, "orders").select("o_orderkey", s.alias("s"), name.alias("k"))
    return ranked(rows, [], "s", "k").select("o_orderkey", "rank", "percentile")


_G1 = f"""SELECT ticker, period, beta, selected, score, {_by(_RANK, 'period', 'score')} AS rank, 100 * {_by(_PCT, 'period', 'score')} AS percentile, beta * ret AS contribution FROM (
    SELECT ticker, period, beta, selected, ret, -1 * CASE WHEN stddev_pop(beta) OVER g > 0 THEN (beta - avg(beta) OVER g) / stddev_pop(beta) OVER g ELSE 0 END AS score FROM (SELECT f.ticker, f.period, coalesce(e.beta, 0) AS beta, e.beta IS NOT NULL AS selected, m.ret
    FROM fits f LEFT JOIN exposures e ON e.ticker = f.ticker AND e.period = f.period AND e.factor = 'PROMO' LEFT JOIN factor_mret m ON m.factor = 'PROMO' AND m.date = f.period {{where}}) WINDOW g AS (PARTITION BY period))"""


@query(
    "factor_rank", "G1 W17 W18 W20", "ticker period:d beta:6 selected:b score:6 rank:i percentile:6 contribution:6",
    _G1.format(where="WHERE f.period = (SELECT max(period) FROM fits)"), "fits exposures factor_mret",
)
def _(spark, sf):
    newest = signals.latest_fits(X.fits(spark, sf))
    ret = X.factor_monthly(spark, sf).where("factor = 'PROMO'").select(F.col("date").alias("period"), F.col("ret").alias("factor_return"))
    return signals.rank_exposures(newest, _e(spark, sf), "PROMO", direction=-1, latest_return=ret, by=("period",))


def _e(spark, sf):
    return X.exposures(spark, sf).select("ticker", "period", "factor", "beta")


@query(
    "factor_rank_sector", "G1 W24", "ticker period:d score:6 rank:i percentile:6", _G1.format(where="WHERE f.sector = 'ASIA'"), "fits exposures factor_mret",
)
def _(spark, sf):
    return signals.rank_exposures(X.fits(spark, sf), _e(spark, sf), "PROMO", direction=-1, sector="ASIA", by=("period",))


@query(
    "company_history", "G2 W24", "ticker as_of:d beta:6 percentile:6 adjusted_r2:6 observation_count:i",
    f"""SELECT ticker, as_of, beta, percentile, adjusted_r2, observation_count FROM ({_G1.format(where='')}) JOIN fits USING (ticker, period) WHERE ticker = 'NATION_1'""".replace("-1 * CASE", "CASE"),
    "fits exposures factor_mret",
)
def _(spark, sf):
    return signals.company_history(X.fits(spark, sf), X.exposures(spark, sf).select("ticker", "as_of", "factor", "beta"), "PROMO", "NATION_1")


@query(
    "chart_extremes", "T3", "ticker period:d position:i rank:i",
    f"""SELECT ticker, period, rank AS position, rank FROM r WHERE rank <= 5 UNION ALL SELECT ticker, period, least(5, n) + n - rank + 1, rank FROM r WHERE rank > n - 5""".replace(
        " r WHERE", f" (SELECT ticker, period, {_by(_RANK, 'period', 'composite')} AS rank, count(*) OVER (PARTITION BY period) AS n FROM composites) WHERE"
    ),
    "composites",
)
def _(spark, sf):
    return signals.chart_extremes(ranked(_scored(spark, sf), ["period"], "composite", "ticker"))


def _scored(spark, sf):
    keys = ["ticker", "period"]
    long = CS.fill_unselected(X.fits(spark, sf).select(*keys), _e(spark, sf), keys, CS.factor_table(WEIGHTS, DIRECTIONS, X.FACTORS))
    return CS.composite(long, ["period"])


@query("composite_scores", "G4 W21", "ticker period:d composite:6", "SELECT * FROM composites", "composites")
def _(spark, sf):
    return _scored(spark, sf)


_SCREEN = f"""SELECT ticker, period, passed, composite, percentile, CASE WHEN passed THEN row_number() OVER (PARTITION BY period, passed ORDER BY composite DESC, ticker) END AS rank FROM (
    SELECT ticker, period, passed, composite, {_by(_PCT, 'period', 'composite')} AS percentile FROM (SELECT ticker, period, sector IN ('ASIA', 'EUROPE', 'AFRICA') AND Market >= -0.6e0 AND adjusted_r2 <= 0.2e0 AS passed,
    sum(weight * greatest(least(z, 3), -3)) / sum(abs(weight)) AS composite FROM (SELECT g.ticker, g.period, weight, CASE WHEN stddev_pop(beta * scale) OVER g > 0 THEN (beta * scale - avg(beta * scale) OVER g) / stddev_pop(beta * scale) OVER g ELSE 0 END * direction AS z FROM (
    SELECT *, 1.0e0 AS scale FROM grid_betas UNION ALL SELECT ticker, sector, period, as_of, 'SMALL_regime', 1.5e0, 1, beta, selected, t_stat, -0.5e0 FROM grid_betas WHERE factor = 'SMALL') g WINDOW g AS (PARTITION BY period, factor)) JOIN fits USING (ticker, period) GROUP BY 1, 2, 3))"""


@query("composite_screen", "G5 Q8 W17 W18", "ticker period:d passed:b composite:6 rank:i percentile:6", _SCREEN, "grid_betas fits")
def _(spark, sf):
    filters = {"sectors": ["ASIA", "EUROPE", "AFRICA"], "beta": {"min": -0.6}, "adjusted_r2": {"max": 0.2}}
    return screening.screen_preview(
        X.fits(spark, sf), _e(spark, sf), WEIGHTS, filters, directions=DIRECTIONS, regimes={"SMALL": -0.5}, by=["period"], known=X.FACTORS
    )


@query(
    "screen_run", "G6 J7 T1 U4", "ticker pick:i composite:6 source",
    f"""SELECT coalesce(s.ticker, m.n_name) AS ticker, pick, composite, CASE WHEN m.n_name IS NOT NULL THEN 'manual' ELSE 'model' END AS source FROM (SELECT ticker, composite, row_number() OVER (ORDER BY composite DESC, ticker) AS pick FROM (
    SELECT ticker, sector, sum(weight * greatest(least(z, 3), -3)) / sum(abs(weight)) AS composite FROM (SELECT ticker, sector, weight, CASE WHEN stddev_pop(beta) OVER g > 0 THEN (beta - avg(beta) OVER g) / stddev_pop(beta) OVER g ELSE 0 END * direction AS z
    FROM (SELECT * FROM grid_betas WHERE as_of <= DATE '2000-06-15' QUALIFY row_number() OVER (PARTITION BY ticker, factor ORDER BY as_of DESC) = 1) WINDOW g AS (PARTITION BY factor)) GROUP BY 1, 2) WHERE sector <> 'AFRICA' AND ticker <> 'NATION_4' QUALIFY pick <= 6) s
    FULL JOIN (SELECT n_name FROM nation WHERE n_name IN ('NATION_2', 'NATION_5')) m ON m.n_name = s.ticker""",
    "grid_betas",
)
def _(spark, sf):
    from ..operators.calendar import latest_per_key

    fits = latest_per_key(X.fits(spark, sf), ["ticker"], "as_of", "2000-06-15")
    e = X.exposures(spark, sf).join(fits.select("ticker", "as_of"), ["ticker", "as_of"], "left_semi")
    as_group = lambda df: df.withColumn("run", F.lit(1))
    preview = screening.screen_preview(
        as_group(fits), as_group(e.select("ticker", "factor", "beta")), WEIGHTS, {"sectors": ["AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]}, directions=DIRECTIONS, by=["run"], known=X.FACTORS
    )
    model = top_n(preview.where("passed and ticker <> 'NATION_4'").select("run", "ticker", "composite"), ["run"], "composite", "ticker", 6)
    manual = X.table(spark, sf, "nation").where("n_name in ('NATION_2', 'NATION_5')").select(F.col("n_name").alias("ticker"), F.lit("manual").alias("source"))
    return model.join(manual, "ticker", "full_outer").withColumn("source", F.coalesce("source", F.lit("model")))


_SELECT = f"""SELECT ticker, period, as_of, composite, percentile, confidence, eligible, model_selected, model_selected OR ticker = 'NATION_1' AS included, CASE WHEN ticker = 'NATION_1' THEN 'manual' WHEN model_selected THEN 'model' ELSE '' END AS selection_source, rank FROM (
    SELECT *, eligible AND row_number() OVER (PARTITION BY period, eligible ORDER BY composite DESC, ticker) <= 5 AS model_selected FROM (SELECT c.*, {_by(_RANK, 'period', 'composite')} AS rank, 100 * {_by(_PCT, 'period', 'composite')} AS percentile,
    observation_count >= 26 AND adjusted_r2 >= -0.05e0 AND ticker <> 'NATION_2' AS eligible FROM composites c JOIN fits f USING (ticker, period)))"""
view("selections", _SELECT, "composites", "fits")


def selected(spark, sf):
    return screening.selection(
        X.fits(spark, sf), _e(spark, sf), WEIGHTS, directions=DIRECTIONS, top=5, manual=["NATION_1"], by=["period"], known=X.FACTORS,
        minimum_days=26, minimum_adjusted_r2=-0.05, excluded=["NATION_2"],
    )


@query(
    "selection_monthly", "G7 G8 Q9 T1 U4", "ticker period:d composite:6 rank:i percentile:6 confidence:6 eligible:b model_selected:b included:b selection_source",
    "SELECT * FROM selections", "selections",
)
def _(spark, sf):
    return selected(spark, sf)


@query(
    "selection_included", "G7 T7 U4", "ticker period:d selection_source position:i portfolio_weight:8",
    """SELECT ticker, period, selection_source, row_number() OVER (PARTITION BY period ORDER BY selection_source = 'manual', composite DESC NULLS LAST, ticker) AS position, 1.0e0 / count(*) OVER (PARTITION BY period) AS portfolio_weight
    FROM (SELECT ticker, period, composite, selection_source FROM selections WHERE included UNION ALL SELECT DISTINCT 'ZZ-UNFITTED', period, NULL, 'manual' FROM fits)""",
    "selections fits",
)
def _(spark, sf):
    manual = X.fits(spark, sf).select("period", F.lit("ZZ-UNFITTED").alias("ticker")).distinct()
    return screening.with_manual(selected(spark, sf), manual, ["period"])


@query(
    "selection_decisions", "G8 H4", "strategy signal_date:d ticker",
    "SELECT 'screen' AS strategy, max(as_of) OVER (PARTITION BY period) AS signal_date, ticker FROM selections WHERE included AND period IN (SELECT DISTINCT period FROM selections ORDER BY 1 DESC LIMIT 24)", "selections",
)
def _(spark, sf):
    return screening.monthly_decisions(selected(spark, sf), "screen", max_months=24)


view(
    "scored",
    """SELECT ticker, period, composite AS score, forward_return FROM composites JOIN (SELECT ticker, CAST(date - INTERVAL 1 MONTH AS DATE) AS period, ret AS forward_return FROM stock_mret WHERE ret IS NOT NULL) USING (ticker, period)""",
    "composites", "stock_mret",
)
view(
    "score_groups",
    f"""SELECT *, {_by(_PCT, 'period', 'score')} AS ps, {_by(_PCT, 'period', 'forward_return')} AS pf, CASE WHEN n > 1 THEN CAST(greatest(ceil(5 * (r - 1) / (n - 1)), 1) - 1 AS INT) ELSE 0 END AS bucket FROM (SELECT *, count(*) OVER (PARTITION BY period) AS n, row_number() OVER (PARTITION BY period ORDER BY score, ticker) AS r FROM scored)""",
    "scored",
)
view(
    "ic_spreads",
    "SELECT period, corr(ps, pf) AS ic, avg(forward_return) FILTER (bucket = 4) - avg(forward_return) FILTER (bucket = 0) AS spread, max(n) AS names FROM score_groups WHERE n >= 10 GROUP BY 1",
    "score_groups",
)


def scored_panel(spark, sf):
    f = X.stock_monthly(spark, sf).where("ret is not null").select("ticker", F.add_months("date", -1).alias("period"), F.col("ret").alias("forward_return"))
    return evaluation.aligned(_scored(spark, sf).select("ticker", "period", F.col("composite").alias("score")), f)


@query("rank_ic", "G9", "period:d ic:6 n:i", "SELECT period, corr(ps, pf) AS ic, max(n) AS n FROM score_groups WHERE n > 2 GROUP BY 1", "score_groups")
def _(spark, sf):
    return evaluation.rank_ic(scored_panel(spark, sf))


@query(
    "quintile_returns", "W19 G11", "period:d bucket:i mean_return:6 n:i",
    "SELECT period, bucket, avg(forward_return) AS mean_return, count(*) AS n FROM score_groups WHERE n >= 10 GROUP BY 1, 2", "score_groups",
)
def _(spark, sf):
    return evaluation.quantile_returns(scored_panel(spark, sf))


@query(
    "selection_statistics", "G10", "rank_ic:6 icir:6 top_minus_bottom:6 hit_rate:6 observations:i",
    "SELECT avg(ic) AS rank_ic, avg(ic) / stddev_samp(ic) AS icir, avg(spread) AS top_minus_bottom, avg(CASE WHEN spread > 0 THEN 1.0e0 ELSE 0.0e0 END) AS hit_rate, count(*) AS observations FROM ic_spreads", "ic_spreads",
)
def _(spark, sf):
    return evaluation.selection_statistics(scored_panel(spark, sf))


view(
    "membership_changes",
    """SELECT p.period, CASE WHEN prev IS NULL THEN 0 ELSE (len(list_filter(names, lambda x: NOT list_contains(prev, x))) + len(list_filter(prev, lambda x: NOT list_contains(names, x)))) / 2.0e0 END AS changes
    FROM (SELECT period, names, lag(names) OVER (ORDER BY period) AS prev FROM (SELECT period, list(ticker) AS names FROM selections WHERE included GROUP BY 1)) p""",
    "selections",
)


@query("membership_change", "W23 J16", "period:d changes:4", "SELECT * FROM membership_changes", "membership_changes")
def _(spark, sf):
    return evaluation.membership_change(selected(spark, sf).where("included").select("period", "ticker"))


@query(
    "screen_statistics", "G11 F10 W23", "rank_ic:6 icir:6 annualized_icir:5 top_minus_bottom:6 hit_rate:6 observations:i spread_hac_t:5 quantile_1:6 quantile_3:6 quantile_5:6 turnover:6 estimated_cost:6 short_history:b",
    """SELECT *, icir * sqrt(12.0e0) AS annualized_icir, observations < 36 AS short_history FROM (SELECT avg(ic) AS rank_ic, avg(ic) / stddev_samp(ic) AS icir, avg(spread) AS top_minus_bottom, avg(CASE WHEN spread > 0 THEN 1.0e0 ELSE 0.0e0 END) AS hit_rate, count(*) AS observations FROM ic_spreads),
    (SELECT max(m) / (sqrt(sum(e * e) + 2 * (0.75e0 * sum(e * e1) + 0.5e0 * sum(e * e2) + 0.25e0 * sum(e * e3))) / count(*)) AS spread_hac_t FROM (SELECT *, lag(e, 1) OVER (ORDER BY period) AS e1, lag(e, 2) OVER (ORDER BY period) AS e2, lag(e, 3) OVER (ORDER BY period) AS e3 FROM (SELECT period, spread - avg(spread) OVER () AS e, avg(spread) OVER () AS m FROM ic_spreads))),
    (SELECT avg(mr) FILTER (bucket = 0) AS quantile_1, avg(mr) FILTER (bucket = 2) AS quantile_3, avg(mr) FILTER (bucket = 4) AS quantile_5 FROM (SELECT period, bucket, avg(forward_return) AS mr FROM score_groups WHERE n >= 10 GROUP BY 1, 2)),
    (SELECT avg(changes) AS turnover, sum(changes) * 25 / 10000 AS estimated_cost FROM membership_changes)""",
    "ic_spreads score_groups membership_changes",
)
def _(spark, sf):
    return evaluation.screen_statistics(scored_panel(spark, sf), selected(spark, sf).where("included").select("period", "ticker"))


@query(
    "membership_filter", "J11 J14", "portfolio ticker fitted:b",
    "SELECT portfolio, ticker, ticker IN (SELECT ticker FROM fits WHERE sector IN ('ASIA', 'EUROPE')) AS fitted FROM holdings", "holdings fits",
)
def _(spark, sf):
    h = X.holdings(spark, sf)
    names = X.fits(spark, sf).where("sector in ('ASIA', 'EUROPE')").select("ticker")
    inside = h.join(names, "ticker", "left_semi").withColumn("fitted", F.lit(True))
    return inside.unionByName(h.join(names, "ticker", "left_anti").withColumn("fitted", F.lit(False)))


@query("sector_list", "A18", "sector", "SELECT DISTINCT sector FROM fits", "fits")
def _(spark, sf):
    return signals.distinct_sectors(X.fits(spark, sf))


@query(
    "top_exposures", "T4", "ticker factor beta:6 pick:i",
    """SELECT ticker, factor, beta, row_number() OVER (PARTITION BY ticker ORDER BY abs(beta) DESC, factor) AS pick FROM exposures WHERE period = (SELECT max(period) FROM exposures) QUALIFY pick <= 3""", "exposures",
)
def _(spark, sf):
    newest = signals.latest_fits(X.exposures(spark, sf).withColumn("size", F.abs("beta")))
    return top_n(newest, ["ticker"], "size", "factor", 3)


@query(
    "stock_page", "R10 T4", "ticker as_of:d factor beta:6 contribution:6 adjusted_r2:6",
    """SELECT ticker, e.as_of, factor, beta, beta * ret AS contribution, adjusted_r2 FROM exposures e JOIN fits f USING (ticker, period) LEFT JOIN (SELECT factor, date AS period, ret FROM factor_mret) m USING (factor, period) WHERE ticker = 'NATION_3'""",
    "exposures fits factor_mret",
)
def _(spark, sf):
    e = X.exposures(spark, sf).where("ticker = 'NATION_3'")
    f = X.fits(spark, sf).select("ticker", "period", "adjusted_r2")
    m = X.factor_monthly(spark, sf).select("factor", F.col("date").alias("period"), "ret")
    return e.join(f, ["ticker", "period"]).join(m, ["factor", "period"], "left").withColumn("contribution", F.col("beta") * F.col("ret"))


@query(
    "fit_asof_by_key", "J6 J7", "ticker date:d beta:6",
    """SELECT a.ticker, a.date, b.beta FROM (SELECT DISTINCT ticker, date FROM stock_prices) a ASOF LEFT JOIN (SELECT ticker, as_of AS date, beta FROM exposures WHERE factor = 'STANDARD') b ON a.ticker = b.ticker AND a.date >= b.date""",
    "stock_prices exposures",
)
def _(spark, sf):
    known = X.exposures(spark, sf).where("factor = 'STANDARD'").select("ticker", F.col("as_of").alias("date"), "beta")
    return as_of_backward(X.stock_prices(spark, sf).select("ticker", "date"), known, ["beta"], by=["ticker"])
