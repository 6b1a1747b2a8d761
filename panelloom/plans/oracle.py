"""SQL text of the fixtures and a registry that pairs each query with its check."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import NORMAL_TAIL_BOTTOM, NORMAL_TAIL_TOP

# name -> (dependencies, SQL)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def view(name: str, sql: str, *deps: str) -> None:
    VIEWS[name] = (deps, sql)


def _price_view(key: str, joins: str) -> str:
    return (
        f"SELECT {key} AS ticker, CAST(l_shipdate AS DATE) AS date, max(l_extendedprice) AS close "
        f"FROM lineitem {joins} WHERE l_extendedprice > 0 GROUP BY 1, 2"
    )


view("stock_prices", _price_view("n_name", "JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey"))
view("proxy_prices", _price_view("p_type", "JOIN part ON l_partkey = p_partkey"))
view("brand_prices", _price_view("p_brand", "JOIN part ON l_partkey = p_partkey"))
view("benchmark_prices", _price_view("'ALL'", ""))
view(
    "securities",
    "SELECT n_name AS ticker, r_name AS sector, CAST(count(s_suppkey) AS BIGINT) AS current_shares FROM nation "
    "JOIN region ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2",
)
view(
    "holdings",
    "SELECT concat('P_', c_mktsegment) AS portfolio, n_name AS ticker, CAST(count(*) AS DOUBLE) AS shares "
    "FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2",
)
view(
    "cash_rates",
    "SELECT CAST(ts AS DATE) AS date, max(value) / 10000.0 AS annualized_rate FROM events GROUP BY 1",
)


def _calendar(prices: str) -> str:
    return f"SELECT date, row_number() OVER (ORDER BY date) AS idx FROM (SELECT DISTINCT date FROM {prices})"


def _dense_returns(prices: str, cal: str) -> str:
    """Returns on the full date-by-ticker grid, as a check of the index-based form."""
    return (
        f"SELECT ticker, date, idx, close, close / lag(close) OVER (PARTITION BY ticker ORDER BY idx) - 1 AS ret FROM ("
        f"SELECT t.ticker, c.date, c.idx, p.close FROM {cal} c CROSS JOIN (SELECT DISTINCT ticker FROM {prices}) t "
        f"LEFT JOIN {prices} p ON p.ticker = t.ticker AND p.date = c.date)"
    )


for _n in ("stock", "proxy", "brand", "benchmark"):
    view(f"{_n}_cal", _calendar(f"{_n}_prices"), f"{_n}_prices")
    view(f"{_n}_ret", _dense_returns(f"{_n}_prices", f"{_n}_cal"), f"{_n}_prices", f"{_n}_cal")
    view(
        f"{_n}_month",
        f"SELECT ticker, CAST(date_trunc('month', date) AS DATE) AS date, arg_max(close, date) AS close FROM {_n}_prices GROUP BY 1, 2",
        f"{_n}_prices",
    )
view("month_cal", _calendar("benchmark_month"), "benchmark_month")
for _n in ("stock", "proxy", "benchmark"):
    view(f"{_n}_mret", _dense_returns(f"{_n}_month", "month_cal"), f"{_n}_month", "month_cal")
view("factor_mret", "SELECT ticker AS factor, date, idx, ret FROM proxy_mret WHERE ret IS NOT NULL", "proxy_mret")
view(
    "ends",
    "SELECT CAST(date_trunc('month', date) AS DATE) AS period, max(date) AS as_of FROM benchmark_prices GROUP BY 1",
    "benchmark_prices",
)
view(
    "rolled",
    """SELECT *, sxy / sxx AS beta, greatest(syy - sxy / sxx * sxy, 0.0e0) AS rss,
  sqrt(greatest(syy - sxy / sxx * sxy, 0.0e0) / (n - 2) / sxx) AS standard_error,
  sxy / sxx / sqrt(greatest(syy - sxy / sxx * sxy, 0.0e0) / (n - 2) / sxx) AS t_stat
FROM (SELECT s.ticker, f.factor, s.date AS period, count(*) OVER w AS n, regr_sxx(s.ret, f.ret) OVER w AS sxx,
  regr_syy(s.ret, f.ret) OVER w AS syy, regr_sxy(s.ret, f.ret) OVER w AS sxy
  FROM stock_mret s JOIN factor_mret f USING (date) WHERE s.ret IS NOT NULL
  WINDOW w AS (PARTITION BY s.ticker, f.factor ORDER BY s.idx RANGE BETWEEN 35 PRECEDING AND CURRENT ROW))
JOIN ends USING (period) WHERE n >= 24 AND sxx > 0""",
    "stock_mret", "factor_mret", "ends",
)
view(
    "exposures",
    "SELECT ticker, period, as_of, factor, beta, standard_error, t_stat, n FROM rolled WHERE factor = 'STANDARD' OR abs(t_stat) > 0.5",
    "rolled",
)
view(
    "fits",
    """SELECT ticker, sector, current_shares, period, as_of, 1 - (1 - (1 - rss / syy)) * (n - 1) / (n - 2) AS adjusted_r2,
  sqrt(rss / (n - 1)) * sqrt(252.0e0) AS residual_volatility, n AS observation_count, n / 36.0e0 AS coverage,
  abs(t_stat) AS beta_significance, beta AS Market FROM rolled JOIN securities USING (ticker) WHERE factor = 'STANDARD'""",
    "rolled", "securities",
)


def with_views(sql: str, deps: tuple[str, ...]) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for d in VIEWS[name][0]:
            visit(d)
        order.append(name)

    for d in deps:
        visit(d)
    hint = lambda n: "" if n.startswith("rec_") else "MATERIALIZED "
    ctes = [f"{n} AS {hint(n)}({VIEWS[n][1]})" for n in order] + [f"answer AS ({sql})"]
    head = "WITH RECURSIVE " if any(n.startswith("rec_") for n in order) else "WITH "
    return head + ",\n".join(ctes)


def arg_max_null(value: str, order: str) -> str:
    """Value at the newest row, NULL included (the built-in skips NULL values)."""
    return f"max(struct_pack(o := {order}, v := {value})).v"


def normal_p_sql(t: str) -> str:
    """Two-sided normal p-value by the complementary error function's continued form."""
    z = f"abs({t})"
    top, bottom = "0.0e0", "0.0e0"
    for k in NORMAL_TAIL_TOP:
        top = f"({top} * {z} + {k!r}e0)"
    for k in NORMAL_TAIL_BOTTOM:
        bottom = f"({bottom} * {z} + {k!r}e0)"
    return f"CASE WHEN {z} < 7.07106781186547e0 THEN 2 * exp(-{z} * {z} / 2) * {top} / {bottom} ELSE 0.0e0 END"


@dataclass(frozen=True)
class Query:
    name: str
    covers: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def _parse(shape: str) -> list[tuple[str, str]]:
    return [(p.split(":")[0], p.split(":")[1] if ":" in p else "s") for p in shape.split()]


def _spark_out(df: DataFrame, shape) -> DataFrame:
    cols = []
    for name, kind in shape:
        c = F.col(name)
        if kind == "d":
            c = F.date_format(c.cast("date"), "yyyy-MM-dd")
        elif kind in {"i", "b"}:
            c = c.cast("int").cast("long") if kind == "b" else c.cast("long")
        elif kind != "s":
            c = F.round(c.cast("double"), int(kind)) + F.lit(0.0)
        cols.append(c.alias(name))
    return df.select(*cols)


def _sql_out(shape) -> str:
    cols = []
    for name, kind in shape:
        q = f'"{name}"'
        if kind == "d":
            q = f"CAST(CAST({q} AS DATE) AS VARCHAR)"
        elif kind == "i":
            q = f"CAST({q} AS BIGINT)"
        elif kind == "b":
            q = f"CAST(CAST({q} AS INTEGER) AS BIGINT)"
        elif kind != "s":
            q = f"round(CAST({q} AS DOUBLE), {kind}) + 0.0e0"
        cols.append(f'{q} AS "{name}"')
    return "SELECT " + ", ".join(cols) + " FROM answer"


def query(name: str, covers: str, shape: str, sql: str | None = None, deps: str = ""):
    """Register a query.  ``shape`` lists output columns as ``name[:kind]``: a number rounds a
    double, i integer, b boolean, d date, otherwise text; the same shape wraps the SQL."""
    parsed = _parse(shape)

    def wrap(fn):
        text = None if sql is None else with_views(sql, tuple(deps.split())) + "\n" + _sql_out(parsed)
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, covers, lambda spark, sf: _spark_out(fn(spark, sf), parsed), text)
        return fn

    return wrap
