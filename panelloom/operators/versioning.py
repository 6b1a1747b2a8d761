"""Content identity, incremental diffs and dataset merging."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import is_close, month_start

# Run settings that never change what is computed.
RUN_KEYS = (
    "_idempotency_key", "idempotency_key", "price_snapshot_id", "snapshot_id", "start", "end",
    "workers", "max_months", "tickers", "top_n_by_market_cap",
)


def content_checksum(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Order-free digest of a table: row count, xor and wrapped sum of row hashes.

    One partially aggregated pass; any changed, added or removed row alters it.
    """
    h = F.xxhash64(*(columns or df.columns))
    parts = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.bit_xor(h).alias("x"),
        F.sum(h.cast("decimal(38,0)")).alias("s"),
    )
    text = F.concat_ws(":", F.col("rows").cast("string"), F.col("x").cast("string"), F.col("s").cast("string"))
    return parts.select("rows", F.sha2(text, 256).alias("checksum"))


def methodology_fingerprint(definitions: DataFrame, members: DataFrame, *, model_version: str, mode: str, configuration: Mapping | None = None) -> DataFrame:
    """SHA-256 over sorted definitions, catalogs and the settings that affect results."""
    stable = {k: str(v) for k, v in sorted((configuration or {}).items()) if k not in RUN_KEYS}
    settings = ";".join(f"{k}={v}" for k, v in stable.items())
    cols = sorted(definitions.columns)
    # both tables are catalogs of at most a few hundred rows
    d = definitions.agg(F.to_json(F.array_sort(F.collect_list(F.struct(*cols)))).alias("d")).withColumn("__k", F.lit(1))
    m = members.agg(
        F.to_json(F.array_sort(F.collect_list(F.struct("level", "position", "factor")))).alias("m")
    ).withColumn("__k", F.lit(1))
    head = F.lit(f"{model_version}|{mode}|{settings}|")
    return d.join(m, "__k").select(F.sha2(F.concat(head, "d", F.lit("|"), "m"), 256).alias("fingerprint"))


def diff_observations(new: DataFrame, stored: DataFrame, keys: Sequence[str] = ("factor", "date"), value: str = "ret") -> DataFrame:
    """Rows of ``new`` that are unseen or differ beyond tolerance, with ``change`` added|changed."""
    old = stored.select(*keys, F.col(value).alias("__old"), F.lit(True).alias("__seen"))
    j = new.join(old, list(keys), "left")
    return j.where(F.col("__seen").isNull() | ~is_close("__old", value)).withColumn(
        "change", F.when(F.col("__seen").isNull(), "added").otherwise("changed")
    ).withColumnRenamed("__old", "previous").drop("__seen")


def update_summary(changes: DataFrame, stored: DataFrame) -> DataFrame:
    """(mode, changed_observations, earliest_changed_date, previous_as_of): full, unchanged, append or correction."""
    k = F.lit(1).alias("__k")
    c = changes.groupBy(k).agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("earliest_changed_date"))
    s = stored.agg(F.max("date").alias("previous_as_of")).withColumn("__k", F.lit(1))
    mode = (
        F.when(F.col("previous_as_of").isNull(), "full")
        .when(F.coalesce("n", F.lit(0)) == 0, "unchanged")
        .when(F.col("earliest_changed_date") > F.col("previous_as_of"), "append")
        .otherwise("correction")
    )
    return s.join(c, "__k", "left").select(
        mode.alias("mode"),
        F.coalesce("n", F.lit(0).cast("long")).alias("changed_observations"),
        "earliest_changed_date",
        "previous_as_of",
    )


def invalidated_fits(fits: DataFrame, summary: DataFrame, latest_date: DataFrame) -> DataFrame:
    """Fits to drop: after an append, same-month fits of another date; after a correction,
    every fit at or after the first change.  ``summary`` and ``latest_date`` have one row."""
    s = summary.withColumn("__k", F.lit(1)).join(latest_date.select(F.col("latest_date")).withColumn("__k", F.lit(1)), "__k")
    j = fits.withColumn("__k", F.lit(1)).join(s, "__k")
    append = (F.col("mode") == "append") & (F.col("period") == month_start("latest_date")) & (F.col("as_of") != F.col("latest_date"))
    correction = (F.col("mode") == "correction") & (F.col("as_of") >= F.col("earliest_changed_date"))
    return j.where(append | correction).select(*fits.columns)


def affected_months(summary: DataFrame, month_ends: DataFrame) -> DataFrame:
    """Month ends to fit again: from the first corrected date on, otherwise the newest one."""
    newest = month_ends.agg(F.max("month_end").alias("__last")).withColumn("__k", F.lit(1))
    s = summary.withColumn("__k", F.lit(1)).join(newest, "__k")
    j = month_ends.withColumn("__k", F.lit(1)).join(s, "__k")
    keep = F.when(F.col("mode") == "correction", F.col("month_end") >= F.col("earliest_changed_date")).otherwise(
        (F.col("mode") != "unchanged") & (F.col("month_end") == F.col("__last"))
    )
    return j.where(keep).select(*month_ends.columns)


def merge_unseen(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Target rows plus source rows whose key the target does not hold."""
    return target.unionByName(source.join(target.select(*keys), list(keys), "left_anti"))


def merge_replacing(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Source rows win over target rows of the same key; ``origin`` is kept, replaced or created."""
    seen = target.select(*keys).withColumn("__t", F.lit(True))
    incoming = source.join(seen, list(keys), "left").withColumn(
        "origin", F.when(F.col("__t"), "replaced").otherwise("created")
    ).drop("__t")
    kept = target.join(source.select(*keys), list(keys), "left_anti").withColumn("origin", F.lit("kept"))
    return kept.unionByName(incoming)


def repoint(df: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """Replace ids by ``mapping(old_id, new_id)``; other ids stay."""
    m = mapping.select(F.col("old_id").alias(column), "new_id")
    return df.join(m, column, "left").withColumn(column, F.coalesce("new_id", column)).drop("new_id").select(*df.columns)


def best_build(fits: DataFrame, build: str = "build_id") -> DataFrame:
    """Build with the most stocks at its latest date; later date, then larger id break ties."""
    newest = fits.groupBy(build).agg(F.max("as_of").alias("as_of"))
    sized = fits.join(newest, [build, "as_of"], "left_semi").groupBy(build, "as_of").agg(F.countDistinct("ticker").alias("stock_count"))
    return sized.agg(F.max(F.struct("stock_count", "as_of", build)).alias("b")).select("b.*")


def modelled_holdings(fits: DataFrame, holdings: DataFrame, build: str = "build_id") -> DataFrame:
    return fits.join(holdings, "ticker").groupBy("portfolio", build).agg(F.countDistinct("ticker").alias("modeled"))


def keep_latest(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Last write wins per key: an aggregate with map-side combine, no window."""
    rest = [c for c in df.columns if c not in {*keys, order}]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__v"), F.max(order).alias(order))
    return best.select(*keys, *[F.col(f"__v.{c}").alias(c) for c in rest], order)


