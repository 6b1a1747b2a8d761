"""The supplied tables seen as price books, securities, portfolios and rates.

Each fixture is an aggregate of the whole table, in Spark here and as SQL text for the
independent check in :mod:`panelloom.plans.oracle`.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.bars import month_closes
from ..operators.calendar import trading_calendar
from ..operators.returns import simple_returns
from ..session import scratch_table

FACTORS = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
MARKET = "STANDARD"
FIT_MONTHS = 36
FIT_MINIMUM = 24


_TABLES: dict = {}


def stored(fn):
    """Write a derived fact table once per application and data folder, then scan it.

    Price books, fits, exposures and monthly bars are stored facts in practice; reading them back keeps the
    plans of their many consumers short, makes them survive lost executors, and reads the lines once a book.
    """

    @functools.wraps(fn)
    def read(spark: SparkSession, sf: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf, fn.__name__)
        if key not in _TABLES:
            df = scratch_table(fn(spark, sf), fn.__name__)
            _TABLES[key] = (df.inputFiles()[0].rsplit("/", 1)[0], df.schema)
        path, schema = _TABLES[key]
        return spark.read.schema(schema).parquet(path)

    return read


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _book(rows: DataFrame, ticker) -> DataFrame:
    return (
        rows.where("l_extendedprice > 0")
        .groupBy(ticker.alias("ticker"), F.col("l_shipdate").cast("date").alias("date"))
        .agg(F.max("l_extendedprice").alias("close"))
    )


def stock_prices(spark, sf, rows: DataFrame | None = None) -> DataFrame:
    """The nations' daily closes; those of all lines are stored."""
    return _stock_book(spark, sf) if rows is None else _stock_closes(spark, sf, rows)


@stored
def _stock_book(spark, sf) -> DataFrame:
    return _stock_closes(spark, sf, table(spark, sf, "lineitem"))


def _stock_closes(spark, sf, rows: DataFrame) -> DataFrame:
    li = rows.select("l_suppkey", "l_shipdate", "l_extendedprice")
    s = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    joined = li.join(s, li.l_suppkey == s.s_suppkey).join(n, s.s_nationkey == n.n_nationkey)
    return _book(joined, F.col("n_name"))


def proxy_prices(spark, sf, by: str = "p_type") -> DataFrame:
    """Daily closes by a column of the parts; those by type, the factors, are stored."""
    return _factor_book(spark, sf) if by == "p_type" else _part_closes(spark, sf, by)


@stored
def _factor_book(spark, sf) -> DataFrame:
    return _part_closes(spark, sf, "p_type")


def _part_closes(spark, sf, by: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_partkey", "l_shipdate", "l_extendedprice")
    p = table(spark, sf, "part").select("p_partkey", by)
    return _book(li.join(p, li.l_partkey == p.p_partkey), F.col(by))


@stored
def benchmark_prices(spark, sf) -> DataFrame:
    return _book(table(spark, sf, "lineitem").select("l_shipdate", "l_extendedprice"), F.lit("ALL"))


def securities(spark, sf) -> DataFrame:
    n, r, s = table(spark, sf, "nation"), table(spark, sf, "region"), table(spark, sf, "supplier")
    counts = s.groupBy("s_nationkey").agg(F.count("s_suppkey").alias("c"))
    return (
        n.join(r, n.n_regionkey == r.r_regionkey)
        .join(counts, n.n_nationkey == counts.s_nationkey, "left")
        .select(
            F.col("n_name").alias("ticker"),
            F.col("r_name").alias("sector"),
            F.coalesce("c", F.lit(0)).cast("long").alias("current_shares"),
        )
    )


def holdings(spark, sf) -> DataFrame:
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    return (
        c.join(n, c.c_nationkey == n.n_nationkey)
        .groupBy(F.concat(F.lit("P_"), F.col("c_mktsegment")).alias("portfolio"), F.col("n_name").alias("ticker"))
        .agg(F.count(F.lit(1)).cast("double").alias("shares"))
    )


def cash_rates(spark, sf) -> DataFrame:
    return (
        table(spark, sf, "events")
        .groupBy(F.col("ts").cast("date").alias("date"))
        .agg((F.max("value") / F.lit(10000.0)).alias("annualized_rate"))
    )


def stock_returns(spark, sf) -> DataFrame:
    p = stock_prices(spark, sf)
    return simple_returns(p, trading_calendar(p))


def proxy_returns(spark, sf, by: str = "p_type") -> DataFrame:
    p = proxy_prices(spark, sf, by)
    return simple_returns(p, trading_calendar(p))


def month_calendar(spark, sf) -> DataFrame:
    return trading_calendar(month_closes(benchmark_prices(spark, sf)))


@stored
def stock_monthly(spark, sf) -> DataFrame:
    """Monthly bars of the stocks with their return; ``date`` is the first of the month."""
    return simple_returns(month_closes(stock_prices(spark, sf)), month_calendar(spark, sf))


@stored
def factor_monthly(spark, sf) -> DataFrame:
    """(factor, date, idx, ret) monthly factor returns."""
    bars = simple_returns(month_closes(proxy_prices(spark, sf)), month_calendar(spark, sf))
    return bars.where("ret is not null").select(F.col("ticker").alias("factor"), "date", "idx", "ret")


def benchmark_monthly(spark, sf) -> DataFrame:
    bars = simple_returns(month_closes(benchmark_prices(spark, sf)), month_calendar(spark, sf))
    return bars.where("ret is not null").select("date", "idx", "ret")


def month_end_dates(spark, sf) -> DataFrame:
    cal = trading_calendar(benchmark_prices(spark, sf))
    return cal.where("is_month_end").select("period", F.col("date").alias("as_of"))


def _rolled(spark, sf) -> DataFrame:
    y = stock_monthly(spark, sf).where("ret is not null").select("ticker", "date", "idx", F.col("ret").alias("y"))
    x = factor_monthly(spark, sf).select("factor", "date", F.col("ret").alias("x"))
    w = Window.partitionBy("ticker", "factor").orderBy("idx").rangeBetween(-(FIT_MONTHS - 1), 0)
    return (
        y.join(x, "date")
        .select(
            "ticker", "factor", F.col("date").alias("period"),
            F.count(F.lit(1)).over(w).alias("n"),
            F.regr_sxx("y", "x").over(w).alias("sxx"),
            F.regr_syy("y", "x").over(w).alias("syy"),
            F.regr_sxy("y", "x").over(w).alias("sxy"),
        )
        .where((F.col("n") >= FIT_MINIMUM) & (F.col("sxx") > 0))
        .withColumn("beta", F.col("sxy") / F.col("sxx"))
        .withColumn("rss", F.greatest(F.col("syy") - F.col("beta") * F.col("sxy"), F.lit(0.0)))
        .withColumn("standard_error", F.sqrt(F.col("rss") / (F.col("n") - 2) / F.col("sxx")))
        .withColumn("t_stat", F.col("beta") / F.col("standard_error"))
        .join(month_end_dates(spark, sf), "period")
    )


@stored
def exposures(spark, sf) -> DataFrame:
    """(ticker, period, as_of, factor, beta, standard_error, t_stat, n) of selected factors."""
    keep = (F.col("factor") == MARKET) | (F.abs("t_stat") > 0.5)
    return _rolled(spark, sf).where(keep).select(
        "ticker", "period", "as_of", "factor", "beta", "standard_error", "t_stat", "n"
    )


@stored
def fits(spark, sf) -> DataFrame:
    """(ticker, sector, period, as_of, adjusted_r2, residual_volatility, observation_count, coverage, ...)."""
    r2 = 1 - F.col("rss") / F.col("syy")
    market = _rolled(spark, sf).where(F.col("factor") == MARKET).select(
        "ticker", "period", "as_of",
        (1 - (1 - r2) * (F.col("n") - 1) / (F.col("n") - 2)).alias("adjusted_r2"),
        (F.sqrt(F.col("rss") / (F.col("n") - 1)) * F.lit(252.0**0.5)).alias("residual_volatility"),
        F.col("n").alias("observation_count"),
        (F.col("n") / F.lit(float(FIT_MONTHS))).alias("coverage"),
        F.abs("t_stat").alias("beta_significance"),
        F.col("beta").alias("Market"),
    )
    return market.join(securities(spark, sf), "ticker")
