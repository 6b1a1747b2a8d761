"""Incremental flows as Structured Streaming jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import compound, week_ending_friday
from ..operators.versioning import affected_months, diff_observations, keep_latest, update_summary
from ..schemas import PRICES
from ..sources.prices import merge_into_book


def price_stream(spark: SparkSession, folder: str, schema: str = PRICES) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def upsert_stream(stream: DataFrame, book: str, state: str):
    """Apply each micro-batch to the price book; a late row is a correction, never dropped.

    The micro-batch id orders writes, so replaying a batch after a failure is idempotent.
    ``seq`` in the stream orders rows inside a batch.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        order = F.col("seq") if "seq" in batch.columns else F.lit(0).cast("long")
        rows = keep_latest(batch.select("ticker", "date", "close", order.alias("seq")), ["ticker", "date"], "seq")
        merge_into_book(batch.sparkSession, book, rows.drop("seq").withColumn("batch", F.lit(batch_id).cast("long")), f"{state}/stage")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True)


def refit_stream(stream: DataFrame, stored: Callable[[], DataFrame], month_ends: DataFrame, sink: str, state: str):
    """Diff each micro-batch of factor observations and append the months to fit again.

    ``stored`` re-reads the current observations for every batch; only dates inside the batch's range are compared.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        current = stored()
        first, last = batch.agg(F.min("date"), F.max("date")).first()
        changes = diff_observations(batch, current.where(F.col("date").between(F.lit(first), F.lit(last))))
        found = update_summary(changes, current)
        summary = batch.sparkSession.createDataFrame([found.first()], found.schema)  # one row, evaluated once
        months = affected_months(summary, month_ends)
        s = summary.select("mode", "changed_observations", F.lit(1).alias("k"))
        months.withColumn("k", F.lit(1)).join(s, "k").drop("k").withColumn("batch_id", F.lit(batch_id)).write.mode(
            "append"
        ).parquet(sink)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True)


def weekly_stream(stream: DataFrame, sink: str, state: str, ts: str = "ts", value: str = "ret", key: str = "ticker"):
    """Friday-ending weekly compounding of a return stream; a late row corrects its week, however old.

    Rows are kept by week under ``{sink}/rows``, the latest batch of a (key, ts) counting.  Each micro-batch compounds the
    weeks it touches again and appends them to ``{sink}/bars``; :func:`weekly_table` keeps the newest of each.
    Replaying a batch changes nothing.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(key, F.col(ts).alias("ts"), F.col(value).alias("ret"), F.lit(batch_id).cast("long").alias("batch"), week_ending_friday(F.to_date(ts)).alias("week"))
        rows.hint("rebalance", F.col("week")).write.mode("append").partitionBy("week").parquet(f"{sink}/rows")
        touched = rows.select(key, "week").distinct()
        weeks = [r.week for r in touched.select("week").distinct().collect()]  # dates only: one value per calendar week of the batch
        kept = spark.read.schema(rows.schema).parquet(f"{sink}/rows").where(F.col("week").isin(weeks))
        kept = keep_latest(kept.join(touched, [key, "week"], "left_semi"), [key, "week", "ts"], "batch")
        bars = kept.groupBy(key, "week").agg(compound("ret").alias(value), F.lit(batch_id).cast("long").alias("batch"))
        bars.write.mode("append").parquet(f"{sink}/bars")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True)


def weekly_table(spark: SparkSession, sink: str, key: str = "ticker") -> DataFrame:
    return keep_latest(spark.read.parquet(f"{sink}/bars"), [key, "week"], "batch").drop("batch")


def breach_events(evaluations: DataFrame) -> DataFrame:
    """Open / update / resolve events of risk limits from ``evaluations(limit_id, as_of, value, slack)``.

    A breached date opens an event or updates the one of the date before; the first date back inside resolves it.
    """
    dates = Window.partitionBy("limit_id").orderBy("as_of")  # one row per evaluated date
    breached = F.col("slack") < 0
    was = F.coalesce(F.lag(breached).over(dates), F.lit(False))
    event = F.when(breached & was, "update").when(breached, "open").when(was, "resolved")
    return evaluations.select("limit_id", event.alias("event"), "as_of", F.col("value").alias("observed_value"), "slack").where("event is not null")


def breach_stream(stream: DataFrame, sink: str, state: str):
    """Events of a stream of evaluations; a late or repeated date corrects the limit's history.

    Evaluations, one per limit and date, are kept under ``{sink}/evaluations``.  Each micro-batch derives the events of the limits
    it touches again and appends them to ``{sink}/events``; :func:`breach_table` keeps each limit's newest set.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark, number = batch.sparkSession, F.lit(batch_id).cast("long").alias("batch")
        rows = batch.select("limit_id", "as_of", "value", "slack", number)
        rows.write.mode("append").parquet(f"{sink}/evaluations")
        touched = rows.select("limit_id").distinct()
        kept = spark.read.schema(rows.schema).parquet(f"{sink}/evaluations").join(touched, "limit_id", "left_semi")
        events = breach_events(keep_latest(kept, ["limit_id", "as_of"], "batch").drop("batch"))
        # a touched limit without events leaves a row too, so that it replaces an older set
        touched.join(events, "limit_id", "left").select("*", number).write.mode("append").parquet(f"{sink}/events")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True)


def breach_table(spark: SparkSession, sink: str) -> DataFrame:
    events = spark.read.parquet(f"{sink}/events")
    newest = events.groupBy("limit_id").agg(F.max("batch").alias("batch"))
    # a replayed batch may have written its set twice
    return events.join(newest, ["limit_id", "batch"], "left_semi").where("event is not null").drop("batch").distinct()
