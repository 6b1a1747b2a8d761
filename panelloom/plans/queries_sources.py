"""Registered queries: sources, ingest, data quality and set operations."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import catalog, quality, versioning
from ..operators import screening as S
from ..operators.allocation import equal_weights
from ..operators.forecasts import assert_finite_unique
from ..operators.returns import cumulative_index
from ..sources import prices as P
from ..sources import reference_data as R
from ..session import shared_folder
from ..sources import sinks
from ..sources.sinks import entity_json
from . import fixtures as X
from .oracle import query, view


@query("price_book", "S1", "ticker date:d close:4", "SELECT * FROM stock_prices", "stock_prices")
def _(spark, sf):
    return X.stock_prices(spark, sf)


@query(
    "price_panel_metadata", "S2 J5", "ticker sector date:d close:4 current_shares:i",
    "SELECT * FROM stock_prices JOIN securities USING (ticker)", "stock_prices securities",
)
def _(spark, sf):
    return P.price_panel(X.stock_prices(spark, sf), X.securities(spark, sf))


_RATE_SQL = """SELECT strftime(CAST(ts AS DATE), '%m/%d/%Y') AS date_text,
  CASE WHEN event_id % 7 = 0 THEN 'n/a' ELSE CAST(round(value / 100.0, 4) AS VARCHAR) END AS percent_text, event_id AS seq FROM events"""


@query(
    "cash_rate_clean", "S3", "date:d annualized_rate:8",
    """SELECT date, arg_min(rate, seq) AS annualized_rate FROM (SELECT CAST(ts AS DATE) AS date, event_id AS seq,
    round(value / 100.0, 4) / 100 AS rate FROM events WHERE event_id % 7 <> 0) GROUP BY 1""",
)
def _(spark, sf):
    e = X.table(spark, sf, "events")
    text = F.when(F.col("event_id") % 7 == 0, "n/a").otherwise(F.round(F.col("value") / 100.0, 4).cast("string"))
    raw = e.select(F.date_format("ts", "MM/dd/yyyy").alias("date_text"), text.alias("percent_text"), F.col("event_id").alias("seq"))
    return R.clean_cash_rates(raw)


@query(
    "holdings_parse", "S4 Q1", "portfolio ticker shares:4 weight:6 problem",
    """SELECT concat('P_', c_mktsegment) AS portfolio, replace(upper(trim(concat(' ', lower(n_name), '.', CAST(c_custkey AS VARCHAR), ' '))), '.', '-') AS ticker,
    CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal END AS shares, CASE WHEN c_custkey % 3 = 1 THEN 0.25e0 END AS weight,
    CASE WHEN c_custkey % 3 = 0 THEN 'provide weight or shares' END AS problem
    FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
def _(spark, sf):
    c, n = X.table(spark, sf, "customer"), X.table(spark, sf, "nation")
    name = F.concat(F.lit(" "), F.lower("n_name"), F.lit("."), F.col("c_custkey").cast("string"), F.lit(" "))
    third = F.col("c_custkey") % 3
    raw = c.join(n, c.c_nationkey == n.n_nationkey).select(
        F.concat(F.lit("P_"), F.col("c_mktsegment")).alias("portfolio"),
        F.when(third == 1, name).alias("ticker"),
        F.when(third != 1, name).alias("symbol"),
        F.when(third != 0, F.col("c_acctbal").cast("string")).alias("shares"),
        F.when(third == 1, "0.25").alias("weight"),
    )
    return R.parse_holdings(raw)


@query(
    "securities_upsert", "S5", "ticker name asset_type sector currency current_shares:2 source",
    """SELECT n_name AS ticker, n_name AS name, 'old' AS asset_type, 'none' AS sector, 'EUR' AS currency, 1.0e0 AS current_shares, 'stored' AS source
    FROM nation WHERE n_name NOT IN (SELECT n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey)
    UNION ALL SELECT DISTINCT n_name, '', 'stock', r_name, 'USD', CAST(c AS DOUBLE), 'feed' FROM nation JOIN region ON n_regionkey = r_regionkey
    JOIN (SELECT s_nationkey, count(*) AS c FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey""",
)
def _(spark, sf):
    n = X.table(spark, sf, "nation")
    stored = n.select(
        F.col("n_name").alias("ticker"), F.col("n_name").alias("name"), F.lit("old").alias("asset_type"), F.lit("none").alias("sector"),
        F.lit("").alias("industry"), F.lit("").alias("exchange"), F.lit("EUR").alias("currency"), F.lit(1.0).alias("current_shares"),
        F.lit(None).cast("double").alias("market_cap"), F.lit(None).cast("date").alias("metadata_as_of"), F.lit("stored").alias("source"),
    )
    incoming = X.securities(spark, sf).where("current_shares > 0").withColumn("ticker", F.concat(F.lit(" "), F.lower("ticker")))
    return R.upsert_securities(stored, incoming.select("ticker", "sector", "current_shares"), "feed")


view(
    "price_updates",
    "SELECT n_name AS ticker, CAST(l_shipdate AS DATE) AS date, l_orderkey % 2 AS batch, max(l_extendedprice) AS close "
    "FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE l_extendedprice > 0 GROUP BY 1, 2, 3",
)


def price_updates(spark, sf):
    li = X.table(spark, sf, "lineitem")
    parts = [X.stock_prices(spark, sf, li.where(F.col("l_orderkey") % 2 == b)).withColumn("batch", F.lit(b).cast("long")) for b in (0, 1)]
    return parts[0], parts[1]


@query(
    "price_upsert_last_wins", "S6", "ticker date:d close:4 batch:i",
    "SELECT ticker, date, arg_max(close, batch) AS close, max(batch) AS batch FROM price_updates GROUP BY 1, 2", "price_updates",
)
def _(spark, sf):
    old, new = price_updates(spark, sf)
    return P.upsert_prices(old, new)


@query(
    "cash_rate_upsert", "S7", "date:d annualized_rate:8 batch:i",
    """SELECT date, arg_max(r, b) AS annualized_rate, max(b) AS batch FROM (SELECT CAST(ts AS DATE) AS date, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS b,
    max(value) / 10000.0e0 AS r FROM events GROUP BY 1, 2) GROUP BY 1""",
)
def _(spark, sf):
    e = X.table(spark, sf, "events")
    side = lambda cond, b: e.where(cond).groupBy(F.col("ts").cast("date").alias("date")).agg(
        (F.max("value") / F.lit(10000.0)).alias("annualized_rate")
    ).withColumn("batch", F.lit(b))
    return R.upsert_rates(side("event_type <> 'error'", 0), side("event_type = 'error'", 1))


@query("prices_melt", "S8", "ticker date:d close:4", "SELECT * FROM proxy_prices", "proxy_prices")
def _(spark, sf):
    return P.melt_prices(P.pivot_prices(X.proxy_prices(spark, sf), X.FACTORS))


@query(
    "entity_json", "S11", "ticker json",
    """SELECT ticker, concat('{"current_shares":', CAST(current_shares AS VARCHAR), ',"sector":"', sector, '","ticker":"', ticker, '"}') AS json FROM securities""",
    "securities",
)
def _(spark, sf):
    return entity_json(X.securities(spark, sf), "ticker")


@query(
    "ticker_union", "S13", "ticker",
    "SELECT ticker FROM stock_prices UNION SELECT ticker FROM proxy_prices UNION SELECT ticker FROM benchmark_prices",
    "stock_prices proxy_prices benchmark_prices",
)
def _(spark, sf):
    return P.distinct_tickers(X.stock_prices(spark, sf), X.proxy_prices(spark, sf), X.benchmark_prices(spark, sf))


@query(
    "ticker_normalize", "Q1", "raw ticker slug",
    """SELECT DISTINCT concat(' ', lower(p_name), '.', p_brand) AS raw, replace(upper(trim(concat(' ', lower(p_name), '.', p_brand))), '.', '-') AS ticker,
    trim(regexp_replace(lower(concat(' ', lower(p_name), '.', p_brand)), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part""",
)
def _(spark, sf):
    raw = F.concat(F.lit(" "), F.lower("p_name"), F.lit("."), F.col("p_brand"))
    return X.table(spark, sf, "part").select(raw.alias("raw")).distinct().select(
        "raw", scalars.normalize_ticker("raw").alias("ticker"), scalars.slug("raw").alias("slug")
    )


@query(
    "prices_validate", "Q2", "ticker date:d close:4",
    """SELECT ticker, date, CASE WHEN c > 0 THEN c END AS close FROM (SELECT n_name AS ticker, CAST(l_shipdate AS DATE) AS date,
    arg_min(l_extendedprice * CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END, l_orderkey * 10 + l_linenumber) AS c
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2)""",
)
def _(spark, sf):
    """Lines that share order and number stand as they lie in the table."""
    li, s, n = (X.table(spark, sf, t) for t in ("lineitem", "supplier", "nation"))
    li = li.withColumns({"file": F.col("_metadata.file_path"), "row": F.col("_metadata.row_index")})
    raw = li.join(s, li.l_suppkey == s.s_suppkey).join(n, s.s_nationkey == n.n_nationkey).select(
        F.col("n_name").alias("ticker"), F.col("l_shipdate").cast("date").alias("date"),
        (F.col("l_extendedprice") * F.when(F.col("l_returnflag") == "R", -1).otherwise(1)).alias("close"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("batch"), "file", "row",
    )
    return P.validate_prices(raw, place=("file", "row"))


@query(
    "missing_tickers", "Q3", "ticker closes:i",
    """SELECT n_name AS ticker, coalesce(c, 0) AS closes FROM (SELECT n_name FROM nation UNION SELECT r_name FROM region)
    LEFT JOIN (SELECT ticker, count(*) AS c FROM stock_prices GROUP BY 1) ON ticker = n_name WHERE coalesce(c, 0) < 2""",
    "stock_prices",
)
def _(spark, sf):
    want = X.table(spark, sf, "nation").select(F.col("n_name").alias("ticker")).union(X.table(spark, sf, "region").select("r_name"))
    return quality.missing_tickers(want, X.stock_prices(spark, sf))


@query(
    "short_history", "Q4", "ticker closes:i required:i",
    """SELECT ticker, n AS closes, need AS required FROM (SELECT ticker, n, greatest(60, CAST(floor(max(n) OVER () * 0.6e0) AS BIGINT)) AS need
    FROM (SELECT p_name AS ticker, count(DISTINCT CAST(l_shipdate AS DATE)) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)) WHERE n < need""",
)
def _(spark, sf):
    return quality.short_history(X.proxy_prices(spark, sf, "p_name"))


@query(
    "ticker_list_parse", "Q5", "c_custkey:i ticker pos:i",
    """SELECT c_custkey, ticker, min(pos) AS pos FROM (SELECT c_custkey, unnest(t) AS ticker, generate_subscripts(t, 1) - 1 AS pos FROM
    (SELECT c_custkey, [replace(upper(trim(x)), '.', '-') FOR x IN string_split(replace(s, chr(10), ','), ',')] AS t FROM
    (SELECT c_custkey, concat(lower(c_mktsegment), '.a, ', c_name, chr(10), upper(c_mktsegment), '.A,,b') AS s FROM customer))) WHERE ticker <> '' GROUP BY 1, 2""",
)
def _(spark, sf):
    text = F.concat(F.lower("c_mktsegment"), F.lit(".a, "), F.col("c_name"), F.lit("\n"), F.upper("c_mktsegment"), F.lit(".A,,b"))
    return S.parse_tickers(X.table(spark, sf, "customer").select("c_custkey", text.alias("s")), "s", "c_custkey")


view(
    "raw_holdings",
    "SELECT concat('P_', c_mktsegment) AS portfolio, n_name AS ticker, CASE WHEN c_mktsegment = 'BUILDING' AND n_nationkey = 3 THEN NULL ELSE CAST(count(*) AS DOUBLE) END AS weight "
    "FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY c_mktsegment, n_name, n_nationkey "
    "UNION ALL SELECT 'P_MACHINERY', n_name, 2.0e0 FROM nation WHERE n_regionkey = 1",
)


@query(
    "holdings_validate", "Q6", "portfolio ticker weight:8 validation",
    """SELECT portfolio, ticker, CASE WHEN count(weight) OVER p = count(*) OVER p THEN weight / sum(weight) OVER p ELSE weight END AS weight,
    CASE WHEN count(*) OVER (PARTITION BY portfolio, ticker) > 1 THEN 'duplicate ticker' END AS validation
    FROM raw_holdings WINDOW p AS (PARTITION BY portfolio)""",
    "raw_holdings",
)
def _(spark, sf):
    c, n = X.table(spark, sf, "customer"), X.table(spark, sf, "nation")
    grouped = c.join(n, c.c_nationkey == n.n_nationkey).groupBy("c_mktsegment", "n_name", "n_nationkey").agg(F.count(F.lit(1)).cast("double").alias("w"))
    hole = (F.col("c_mktsegment") == "BUILDING") & (F.col("n_nationkey") == 3)
    a = grouped.select(F.concat(F.lit("P_"), F.col("c_mktsegment")).alias("portfolio"), F.col("n_name").alias("ticker"), F.when(~hole, F.col("w")).alias("weight"))
    b = n.where("n_regionkey = 1").select(F.lit("P_MACHINERY").alias("portfolio"), F.col("n_name").alias("ticker"), F.lit(2.0).alias("weight"))
    return R.validate_holdings(a.unionByName(b))


@query(
    "holdings_without_prices", "Q7 U3", "ticker",
    "SELECT DISTINCT ticker FROM (SELECT ticker FROM holdings UNION SELECT p_name FROM part) WHERE ticker NOT IN (SELECT ticker FROM stock_prices)",
    "holdings stock_prices",
)
def _(spark, sf):
    want = X.holdings(spark, sf).select("ticker").union(X.table(spark, sf, "part").select("p_name"))
    return R.without_prices(want, X.stock_prices(spark, sf))


@query(
    "screen_rules", "Q8", "ticker period:d passed:b sector:b beta:b adjusted_r2:b coverage:b",
    """SELECT ticker, period, (s AND b AND r AND c) AS passed, s AS sector, b AS beta, r AS adjusted_r2, c AS coverage FROM (SELECT ticker, period,
    sector IN ('ASIA', 'EUROPE', 'AMERICA') AS s, Market >= -0.2e0 AND Market <= 0.4e0 AS b, adjusted_r2 >= -0.03e0 AS r, coverage >= 0.8e0 AS c FROM fits)""",
    "fits",
)
def _(spark, sf):
    filters = {"sectors": ["ASIA", "EUROPE", "AMERICA"], "beta": {"min": -0.2, "max": 0.4}, "adjusted_r2": {"min": -0.03}, "coverage": {"min": 0.8}}
    out = S.rule_flags(X.fits(spark, sf), filters)
    return out.select("ticker", "period", "passed", *[F.col("rules")[r].alias(r) for r in ("sector", "beta", "adjusted_r2", "coverage")])


@query(
    "selection_eligibility", "Q9", "ticker period:d eligible:b",
    """SELECT ticker, period, observation_count >= 30 AND coverage >= 0.9e0 AND adjusted_r2 >= -0.04e0 AND sector IN ('ASIA', 'AFRICA', 'EUROPE')
    AND ticker NOT IN ('NATION_1', 'NATION_2') AS eligible FROM fits""",
    "fits",
)
def _(spark, sf):
    ok = S.eligibility(sectors=["ASIA", "AFRICA", "EUROPE"], minimum_days=30, minimum_coverage=0.9, minimum_adjusted_r2=-0.04, excluded=["NATION_1", "NATION_2"])
    return X.fits(spark, sf).withColumn("eligible", ok)


@query(
    "filter_defaults", "Q10", "o_orderkey:i days:i floor:4",
    """SELECT o_orderkey, coalesce(d, 252) AS days, CASE WHEN d IS NULL AND abs(c - 0.8e0) < 1e-9 THEN NULL ELSE c END AS floor FROM (SELECT o_orderkey,
    CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 500 END AS d, CASE WHEN o_orderkey % 4 = 0 THEN 0.8e0 WHEN o_orderkey % 4 = 1 THEN 0.5e0 END AS c FROM orders)""",
)
def _(spark, sf):
    key = F.col("o_orderkey")
    days, floor = S.resolve_filters(
        F.when(key % 3 == 0, key % 500), F.when(key % 4 == 0, F.lit(0.8)).when(key % 4 == 1, F.lit(0.5))
    )
    return X.table(spark, sf, "orders").select("o_orderkey", days.alias("days"), floor.alias("floor"))


@query(
    "feature_prefilter", "Q11", "ticker period:d",
    "SELECT ticker, period FROM fits WHERE coverage >= 0.75e0 AND residual_volatility <= 30 AND sector IN ('ASIA', 'EUROPE')", "fits",
)
def _(spark, sf):
    return S.prefilter(
        X.fits(spark, sf), minimums={"coverage": 0.75, "not_a_field": 3.0}, maximums={"residual_volatility": 30.0}, allowed_sectors=["ASIA", "EUROPE"]
    )


@query(
    "factor_coverage", "Q12", "ticker observations:i panel_observations:i ratio:8 start:d end:d",
    """SELECT ticker, count(ret) AS observations, (SELECT count(DISTINCT date) FROM stock_ret WHERE ret IS NOT NULL) AS panel_observations,
    count(ret) / (SELECT count(DISTINCT date) FROM stock_ret WHERE ret IS NOT NULL) AS ratio, min(date) AS start, max(date) AS "end" FROM stock_ret WHERE ret IS NOT NULL GROUP BY 1""",
    "stock_ret",
)
def _(spark, sf):
    return quality.factor_coverage(X.stock_returns(spark, sf), "ticker")


@query(
    "stock_coverage", "Q13", "sector latest_as_of:d latest_stocks:i stocks_with_history:i median_months:i maximum_months:i",
    """SELECT sector, latest_as_of, latest_stocks, stocks_with_history, median_months, maximum_months FROM
    (SELECT sector, max(as_of) AS latest_as_of FROM fits GROUP BY 1) JOIN
    (SELECT sector, count(*) FILTER (m > 1) AS stocks_with_history, max(m) AS maximum_months, list_sort(list(m))[CAST(floor(count(*) / 2) AS INT) + 1] AS median_months
     FROM (SELECT sector, ticker, count(DISTINCT period) AS m FROM fits GROUP BY 1, 2) GROUP BY 1) USING (sector) JOIN
    (SELECT f.sector, count(DISTINCT ticker) AS latest_stocks FROM fits f JOIN (SELECT sector, max(as_of) AS m FROM fits GROUP BY 1) g ON f.sector = g.sector AND as_of = m GROUP BY 1) USING (sector)""",
    "fits",
)
def _(spark, sf):
    return quality.stock_coverage(X.fits(spark, sf), ("sector",))


@query(
    "quality_flags", "Q14", "factor flags observations:i",
    """SELECT factor, flags, count(*) AS observations FROM (SELECT CASE ticker WHEN 'PROMO' THEN 'Liquidity' WHEN 'SMALL' THEN 'BetaFactor' WHEN 'LARGE' THEN 'Theme: Space Economy' ELSE ticker END AS factor,
    CASE ticker WHEN 'PROMO' THEN 'weak_proxy_liquidity' WHEN 'SMALL' THEN 'collinear_style_pair' WHEN 'LARGE' THEN 'fixed_thematic_membership' ELSE '' END AS flags FROM proxy_prices) GROUP BY 1, 2""",
    "proxy_prices",
)
def _(spark, sf):
    f = F.when(F.col("ticker") == "PROMO", "Liquidity").when(F.col("ticker") == "SMALL", "BetaFactor")
    f = f.when(F.col("ticker") == "LARGE", "Theme: Space Economy").otherwise(F.col("ticker"))
    out = quality.quality_flags(X.proxy_prices(spark, sf).withColumn("factor", f))
    return out.groupBy("factor", F.concat_ws(",", "quality_flags").alias("flags")).agg(F.count(F.lit(1)).alias("observations"))


@query(
    "input_validation", "Q15", "rows:i duplicate_keys:i bad_values:i",
    "SELECT count(*) AS rows, 0 AS duplicate_keys, 0 AS bad_values FROM stock_prices", "stock_prices",
)
def _(spark, sf):
    return assert_finite_unique(X.stock_prices(spark, sf), ["ticker", "date"], ["close"], "price book")


@query(
    "retention_truncate", "Q16", "ticker date:d cumulative_index:5",
    """SELECT ticker, date, i / first_value(i) OVER (PARTITION BY ticker ORDER BY date) AS cumulative_index FROM (SELECT ticker, date,
    product(1 + ret) OVER (PARTITION BY ticker ORDER BY date) AS i FROM proxy_ret WHERE ret IS NOT NULL) WHERE date >= DATE '1998-01-01'""",
    "proxy_ret",
)
def _(spark, sf):
    obs = cumulative_index(X.proxy_returns(spark, sf).where("ret is not null"), "ticker")
    return quality.truncate_history(obs, "1998-01-01", "ticker")


@query("content_checksum", "Q17", "rows:i checksum")
def _(spark, sf):
    return versioning.content_checksum(X.stock_prices(spark, sf), ["ticker", "date", "close"])


@query("methodology_fingerprint", "Q18 F15", "fingerprint")
def _(spark, sf):
    own = X.securities(spark, sf).select(F.col("ticker").alias("factor"), F.col("sector").alias("family"))
    members = X.holdings(spark, sf).select(F.col("portfolio").alias("level"), F.col("ticker").alias("factor"), F.col("shares").alias("position"))
    return versioning.methodology_fingerprint(own, members, model_version="v", mode="proxy", configuration={"start": "x", "window": 156})


@query(
    "metadata_caps", "J3", "ticker sector current_shares:i cap:2",
    "SELECT s.ticker, sector, current_shares, max_p AS cap FROM securities s LEFT JOIN (SELECT ticker, max(close) AS max_p FROM stock_prices GROUP BY 1) p ON s.ticker = p.ticker",
    "securities stock_prices",
)
def _(spark, sf):
    caps = X.stock_prices(spark, sf).groupBy("ticker").agg(F.max("close").alias("cap"))
    return R.with_current_caps(X.securities(spark, sf), caps)


@query(
    "first_source_wins", "U1", "ticker kind",
    """SELECT ticker, arg_min(kind, p) AS kind FROM (SELECT DISTINCT ticker, 'stock' AS kind, 0 AS p FROM stock_prices UNION ALL
    SELECT n_name, 'nation', 1 FROM nation UNION ALL SELECT DISTINCT ticker, 'proxy', 2 FROM proxy_prices) GROUP BY 1""",
    "stock_prices proxy_prices",
)
def _(spark, sf):
    a = X.stock_prices(spark, sf).select("ticker").distinct().withColumn("kind", F.lit("stock"))
    b = X.table(spark, sf, "nation").select(F.col("n_name").alias("ticker"), F.lit("nation").alias("kind"))
    c = X.proxy_prices(spark, sf).select("ticker").distinct().withColumn("kind", F.lit("proxy"))
    return R.first_wins(a, b, c)


@query(
    "date_intersection", "U2", "date:d",
    "SELECT date FROM stock_prices INTERSECT SELECT CAST(o_orderdate AS DATE) FROM orders", "stock_prices",
)
def _(spark, sf):
    return X.stock_prices(spark, sf).select("date").intersect(X.table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("date")))


@query(
    "selection_union", "U4", "portfolio ticker source",
    """SELECT portfolio, ticker, CASE WHEN bool_or(s = 'manual') THEN 'manual' ELSE 'model' END AS source FROM (SELECT portfolio, ticker, 'model' AS s FROM holdings
    UNION ALL SELECT concat('P_', c_mktsegment), p_brand, 'manual' FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey) GROUP BY 1, 2""",
    "holdings",
)
def _(spark, sf):
    model = X.holdings(spark, sf).select("portfolio", "ticker", F.lit(True).alias("included"), F.lit(0.0).alias("composite"), F.lit("model").alias("selection_source"))
    li = X.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    o = X.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    c = X.table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    p = X.table(spark, sf, "part").select("p_partkey", "p_brand")
    manual = (
        li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(p, li.l_partkey == p.p_partkey)
        .select(F.concat(F.lit("P_"), F.col("c_mktsegment")).alias("portfolio"), F.col("p_brand").alias("ticker"))
    )
    return S.with_manual(model, manual, ["portfolio"]).withColumnRenamed("selection_source", "source")


@query(
    "isclose_changes", "2.8", "ticker date:d near:b",
    """SELECT a.ticker, a.date, abs(a.close - b.close) <= 1e-8 + 1e-5 * abs(b.close) AS near FROM price_updates a JOIN price_updates b
    ON a.ticker = b.ticker AND a.date = b.date AND a.batch = 0 AND b.batch = 1""",
    "price_updates",
)
def _(spark, sf):
    a, b = price_updates(spark, sf)
    j = a.select("ticker", "date", F.col("close").alias("x")).join(b.select("ticker", "date", F.col("close").alias("y")), ["ticker", "date"])
    return j.withColumn("near", scalars.is_close("x", "y"))


@query(
    "normal_cdf_table", "2.8", "cdf_bucket:i n:i lowest:8 highest:8",
    None,
)
def _(spark, sf):
    z = X.stock_returns(spark, sf).where("ret is not null").select(scalars.normal_cdf("ret").alias("p"))
    return z.groupBy(F.floor(F.col("p") * 10).alias("cdf_bucket")).agg(F.count(F.lit(1)).alias("n"), F.min("p").alias("lowest"), F.max("p").alias("highest"))


@query(
    "universe_top_caps", "T2 F13", "ticker cap:2",
    """SELECT ticker, current_shares * c AS cap FROM securities JOIN (SELECT ticker, arg_max(close, date) AS c FROM stock_prices GROUP BY 1) USING (ticker) ORDER BY cap DESC, ticker LIMIT 10""",
    "securities stock_prices",
)
def _(spark, sf):
    sec = X.securities(spark, sf).withColumn("market_cap", F.lit(None).cast("double")).withColumn("asset_type", F.lit("stock"))
    return catalog.top_by_cap(catalog.market_caps(sec, X.stock_prices(spark, sf)).where("close is not null"), 10)


@query(
    "universe_top_one_per_company", "T2 F13", "ticker sector cap:2",
    """SELECT ticker, sector, cap FROM (SELECT ticker, sector, current_shares * c AS cap, row_number() OVER (PARTITION BY sector ORDER BY current_shares * c DESC, ticker) AS r
    FROM securities JOIN (SELECT ticker, arg_max(close, date) AS c FROM stock_prices GROUP BY 1) USING (ticker)) WHERE r = 1 ORDER BY cap DESC, ticker LIMIT 3""",
    "securities stock_prices",
)
def _(spark, sf):
    sec = X.securities(spark, sf).withColumn("market_cap", F.lit(None).cast("double"))
    return catalog.top_by_cap(catalog.market_caps(sec, X.stock_prices(spark, sf)), 3, "sector")


def _universe(spark, sf, **choice):
    sec = X.securities(spark, sf).withColumn("market_cap", F.lit(None).cast("double")).withColumn("asset_type", F.when(F.col("sector") == "EUROPE", "fund").otherwise("stock"))
    prices = X.stock_prices(spark, sf).unionByName(X.benchmark_prices(spark, sf))
    return catalog.exposure_universe(sec, prices, benchmark="ALL", **choice)


@query(
    "universe_all_and_benchmark", "F13", "ticker", "SELECT ticker FROM securities SEMI JOIN stock_prices USING (ticker) WHERE sector <> 'EUROPE' UNION ALL SELECT 'ALL' FROM (SELECT count(*) AS n FROM benchmark_prices) WHERE n > 0",
    "securities stock_prices benchmark_prices",
)
def _(spark, sf):
    return _universe(spark, sf)


@query(
    "universe_requested", "F13", "ticker", "SELECT min(ticker) AS ticker FROM securities SEMI JOIN stock_prices USING (ticker) WHERE sector <> 'EUROPE' GROUP BY sector", "securities stock_prices",
)
def _(spark, sf):
    """An explicit list, written carelessly: the first stock of every sector."""
    sec = X.securities(spark, sf).join(X.stock_prices(spark, sf).select("ticker").distinct(), "ticker", "left_semi").where("sector <> 'EUROPE'")
    first = [r.t for r in sec.groupBy("sector").agg(F.min("ticker").alias("t")).collect()]  # one row a sector
    return _universe(spark, sf, requested=[f" {t.lower()} " for t in first] + first[:1] + [" "])


_LEVELS = {"base": ("STANDARD", "PROMO", "MISSING"), "base_sector": ("STANDARD", "PROMO", "SMALL", "LARGE"), "full": ("STANDARD", "SMALL", "UNKNOWN", "MEDIUM", "LARGE", "ECONOMY", "PROMO")}


@query(
    "level_columns", "F15", "level factor position:i",
    "SELECT level, factor, row_number() OVER (PARTITION BY level ORDER BY i) - 1 AS position FROM (VALUES "
    + ", ".join(f"('{level}', '{f}', {i})" for level, names in _LEVELS.items() for i, f in enumerate(names)) + ") v(level, factor, i) SEMI JOIN factor_mret USING (factor)",
    "factor_mret",
)
def _(spark, sf):
    available = [r.factor for r in X.factor_monthly(spark, sf).select("factor").distinct().collect()]  # the catalog
    return catalog.catalog_members(spark, catalog.level_columns(_LEVELS, available, list(_LEVELS)))


@query("equal_weight_allocation", "K4", "portfolio ticker equal_weight:8", "SELECT portfolio, ticker, 1.0e0 / count(*) OVER (PARTITION BY portfolio) AS equal_weight FROM holdings", "holdings")
def _(spark, sf):
    return equal_weights(X.holdings(spark, sf))


def _fresh(spark, name: str) -> str:
    return shared_folder(spark, "exports", f"{name}-{uuid.uuid4().hex}")


@query(
    "facts_partition_overwrite", "S9 S6", "build_id ticker date:d close:4",
    "SELECT 'b' AS build_id, ticker, date, CASE WHEN date >= DATE '1999-01-01' THEN close + 1 ELSE close END AS close FROM stock_prices", "stock_prices",
)
def _(spark, sf):
    facts = X.stock_prices(spark, sf).withColumn("build_id", F.lit("b"))
    path = _fresh(spark, "facts")
    sinks.write_facts(facts, path)
    # the second write touches only the months it holds
    sinks.write_facts(facts.where("date >= date '1999-01-01'").withColumn("close", F.col("close") + 1), path)
    return spark.read.parquet(path)


@query("holdings_csv_export", "S10 S4", "portfolio ticker shares:4", "SELECT * FROM holdings", "holdings")
def _(spark, sf):
    path = _fresh(spark, "holdings")
    sinks.export_csv(X.holdings(spark, sf).withColumn("weight", F.lit(None).cast("double")), path, ["portfolio", "ticker", "weight", "shares"], ["portfolio", "ticker"])
    return R.read_holdings(spark, path).where("problem is null")


@query("cash_rate_files", "S3", "date:d annualized_rate:8", "SELECT CAST(ts AS DATE) AS date, round(max(value) / 100.0, 4) / 100 AS annualized_rate FROM events GROUP BY 1")
def _(spark, sf):
    path = _fresh(spark, "rates")
    daily = X.table(spark, sf, "events").groupBy(F.col("ts").cast("date").alias("d")).agg(F.round(F.max("value") / 100.0, 4).alias("v"))
    daily.select(F.date_format("d", "MM/dd/yyyy").alias("Date"), F.col("v").alias(R.RATE_COLUMN)).write.option("header", True).csv(path)
    return R.read_cash_rates(spark, path)
