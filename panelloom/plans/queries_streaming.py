"""Registered queries: the incremental flows run as streams over files derived from the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.calendar import month_ends
from ..session import shared_folder
from ..streaming import flows, keyed
from . import fixtures as X
from .oracle import query
from .queries_sources import price_updates


def _folder(spark, name: str) -> str:
    return shared_folder(spark, "streams", f"{name}-{uuid.uuid4().hex}")


@query(
    "stream_price_upsert", "X1 S6", "ticker date:d close:4",
    "SELECT ticker, date, arg_max(close, batch) AS close FROM price_updates GROUP BY 1, 2", "price_updates",
)
def _(spark, sf):
    root = _folder(spark, "prices")
    for part in price_updates(spark, sf):  # two arrivals: the first load and its corrections
        part.write.mode("append").parquet(f"{root}/in")
        stream = flows.price_stream(spark, f"{root}/in", "ticker string, date date, close double, batch long")
        flows.upsert_stream(stream.withColumn("seq", F.col("batch")), f"{root}/book", f"{root}/state").start().awaitTermination()
    return spark.read.parquet(f"{root}/book").select("ticker", "date", "close")


@query(
    "stream_weekly_returns", "X1 W8", "ticker week:d ret:6",
    "SELECT ticker, w AS week, r AS ret FROM wk", "wk",
)
def _(spark, sf):
    root = _folder(spark, "weekly")
    r = X.stock_returns(spark, sf).where("ret is not null").select("ticker", F.col("date").cast("timestamp").alias("ts"), "ret")
    late = F.col("ts") < "2000-01-04"  # arrives second: whole old weeks and the rest of one split between both
    for part in (r.where(~late), r.where(late)):
        part.write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema("ticker string, ts timestamp, ret double").parquet(f"{root}/in")
        flows.weekly_stream(stream, f"{root}/out", f"{root}/state").start().awaitTermination()
    return flows.weekly_table(spark, f"{root}/out")


@query(
    "stream_refit_months", "X2 F17 F18", "mode period:d changed_observations:i",
    """SELECT 'correction' AS mode, date AS period, c AS changed_observations FROM month_cal, (SELECT count(*) AS c FROM factor_mret n LEFT JOIN stored_correct o USING (factor, date) WHERE o.ret IS NULL OR NOT abs(o.ret - n.ret) <= 1e-8 + 1e-5 * abs(n.ret)) WHERE date >= DATE '1999-03-01'""",
    "month_cal factor_mret stored_correct",
)
def _(spark, sf):
    from .queries_factors import _stored

    root = _folder(spark, "refit")
    new, old = _stored(spark, sf, True)
    new.write.parquet(f"{root}/in")
    old.write.parquet(f"{root}/stored")
    stream = spark.readStream.schema("factor string, date date, ret double").parquet(f"{root}/in")
    ends = month_ends(X.month_calendar(spark, sf))
    flows.refit_stream(stream, lambda: spark.read.parquet(f"{root}/stored"), ends, f"{root}/out", f"{root}/state").start().awaitTermination()
    return spark.read.parquet(f"{root}/out")


@query(
    "stream_breach_events", "X3 R6", "limit_id event as_of:d observed_value:5 slack:5",
    """SELECT concat_ws('|', portfolio, metric) AS limit_id, CASE WHEN slack < 0 THEN CASE WHEN coalesce(p, 0) < 0 THEN 'update' ELSE 'open' END ELSE 'resolved' END AS event, period AS as_of, value AS observed_value, slack
    FROM (SELECT *, lag(slack) OVER (PARTITION BY portfolio, metric ORDER BY period) AS p FROM evaluations) WHERE slack < 0 OR p < 0""",
    "evaluations",
)
def _(spark, sf):
    from .queries_risk import evaluations

    root = _folder(spark, "breach")
    rows = evaluations(spark, sf).select(F.concat_ws("|", "portfolio", "metric").alias("limit_id"), F.col("period").alias("as_of"), "value", "slack")
    late = F.month("as_of") % 2 == 0  # every other month arrives second
    for part in (rows.where(~late), rows.where(late)):
        part.write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema("limit_id string, as_of date, value double, slack double").parquet(f"{root}/in")
        flows.breach_stream(stream, f"{root}/out", f"{root}/state").start().awaitTermination()
    return flows.breach_table(spark, f"{root}/out")


_ARRIVALS = "CASE WHEN month(period) % 5 = 0 THEN DATE '2010-06-01' WHEN month(period) % 3 = 0 THEN DATE '2011-06-01' ELSE period END"


@query(
    "stream_breach_lifecycle", "X3 R6", "limit_id event as_of:d observed_value:5 slack:5",
    f"""SELECT limit_id, event, period AS as_of, value AS observed_value, slack FROM (SELECT *, CASE WHEN slack < 0 THEN CASE WHEN coalesce(p, 0) < 0 THEN 'update' ELSE 'open' END ELSE 'resolved' END AS event FROM (
    SELECT concat_ws('|', portfolio, metric) AS limit_id, *, lag(slack) OVER (PARTITION BY portfolio, metric ORDER BY period) AS p FROM evaluations) WHERE slack < 0 OR p < 0)
    UNION ALL SELECT limit_id, 'silent', period, value, slack FROM (SELECT concat_ws('|', portfolio, metric) AS limit_id, arg_max(period, period) AS period, arg_max(value, period) AS value, arg_max(slack, period) AS slack, max({_ARRIVALS}) AS seen
    FROM evaluations GROUP BY 1) WHERE slack < 0 AND seen + INTERVAL 45 DAY <= (SELECT max({_ARRIVALS}) FROM evaluations)""",
    "evaluations",
)
def _(spark, sf):
    """Three arrivals: most months in time, every fifth and then every third month late; breaches of limits that fall silent are reported."""
    from .queries_risk import evaluations

    root = _folder(spark, "lifecycle")
    rows = evaluations(spark, sf).select(F.concat_ws("|", "portfolio", "metric").alias("limit_id"), F.col("period").alias("as_of"), "value", "slack")
    month = F.month("as_of")
    arrived = F.when(month % 5 == 0, F.lit("2010-06-01").cast("date")).when(month % 3 == 0, F.lit("2011-06-01").cast("date")).otherwise(F.col("as_of"))
    rows = rows.withColumn("arrived", arrived.cast("timestamp"))
    late = [month % 5 == 0, (month % 3 == 0) & (month % 5 != 0)]
    for part in (rows.where(~(late[0] | late[1])), rows.where(late[0]), rows.where(late[1])):
        part.write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema("limit_id string, as_of date, value double, slack double, arrived timestamp").parquet(f"{root}/in")
        keyed.breach_lifecycle(stream, f"{root}/out", f"{root}/state").awaitTermination()
    return keyed.lifecycle_table(spark, f"{root}/out")


@query(
    "stream_closed_weeks", "X1 W8", "ticker week:d ret:6 n:i",
    """SELECT ticker, week, product(1 + ret) - 1 AS ret, count(*) AS n FROM (SELECT ticker, ret, date, CAST(date + (12 - dayofweek(date)) % 7 * INTERVAL 1 DAY AS DATE) AS week FROM stock_ret WHERE ret IS NOT NULL)
    WHERE week + INTERVAL 1 DAY <= (SELECT max(date) FROM stock_ret WHERE ret IS NOT NULL) - INTERVAL 7 DAY GROUP BY 1, 2""",
    "stock_ret",
)
def _(spark, sf):
    """Three arrivals: the first years in time, the rest, then rows of old weeks that were closed long before."""
    root = _folder(spark, "windows")
    r = X.stock_returns(spark, sf).where("ret is not null").select("ticker", F.col("date").cast("timestamp").alias("ts"), "ret")
    newest = r.agg(F.max("ts").alias("newest")).withColumn("k", F.lit(1))
    late = (F.pmod(F.xxhash64("ticker", "ts"), F.lit(10)) == 0) & (F.year("ts") < 1998)
    r = r.withColumn("k", F.lit(1)).join(newest, "k").withColumn("arrived", F.when(late, F.col("newest")).otherwise(F.col("ts"))).drop("k", "newest")
    early = F.col("ts") < "1996-01-01"
    for part in (r.where(~late & early), r.where(~late & ~early), r.where(late)):
        part.write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema("ticker string, ts timestamp, ret double, arrived timestamp").parquet(f"{root}/in")
        for q in keyed.closed_weeks(stream, f"{root}/out", f"{root}/state"):
            q.awaitTermination()
    return keyed.closed_week_table(spark, f"{root}/out")
