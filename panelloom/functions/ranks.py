"""Exact ranks inside groups of any size, by one plan.

Rows are range-partitioned and sorted by group, score and tie-break, whatever their types, so a group or a
score shared by many rows spreads over partitions.  The place of a row inside its partition plus the
rows of its group in earlier partitions is its rank.  Sampled ranges only steer the balance.  Places
and counts must come from one evaluation, so the sorted rows are checkpointed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

PART_ROWS = 1 << 33  # rows of one partition that monotonically_increasing_id numbers: a fixed value


def ranked(
    df: DataFrame,
    by: Sequence[str],
    score: str,
    tie: str,
    *,
    prefix: str = "",
    ascending: bool = False,
    running: str | None = None,
) -> DataFrame:
    """Add ``rank`` (ties broken by ``tie``), ``percentile`` in (0, 1] and ``ranked_count``.

    ``rank`` runs from 1 in descending score order unless ``ascending``.  Ties of the
    percentile share their average rank.  Rows with a NULL score stay, unranked.
    ``running`` names a column whose total over better-ranked rows is added as
    ``{prefix}running``.
    """
    names, group = list(df.columns), [f"__g{i}" for i in range(len(by))]
    order = F.col(score).asc() if ascending else F.col(score).desc()
    keys = [*by, order, F.col(tie).asc()]
    scored = df.where(F.col(score).isNotNull()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = cut_lineage(
        scored.select(
            "*", *[F.col(c).alias(g) for c, g in zip(by, group)],
            F.spark_partition_id().alias("__part"), (F.monotonically_increasing_id() % PART_ROWS).alias("__place"),
        )
    )
    amount = F.coalesce(F.col(running).cast("double"), F.lit(0.0)) if running else F.lit(0.0)
    parts = placed.groupBy(*group, "__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__place").alias("__from"), F.sum(amount).alias("__a"))
    # one row per group and partition that holds it: at most as many in a group as there are partitions
    earlier = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        *group, "__part", "__from",
        F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"),
        F.coalesce(F.sum("__a").over(earlier), F.lit(0.0)).alias("__run_before"),
        F.sum("__n").over(Window.partitionBy(*group)).alias("__total"),
    )
    rows = _join(placed, offsets, [*group, "__part"]).withColumn("__rank", F.col("__before") + F.col("__place") - F.col("__from") + 1)
    if running:
        inside = Window.partitionBy(*group, "__part").orderBy("__place").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("__run", F.col("__run_before") + F.coalesce(F.sum(amount).over(inside), F.lit(0.0)))
    # equal scores: counted per partition first, so that a frequent score is many short keys and not one long one
    value = Window.partitionBy(*group, "__score")
    ties = rows.withColumn("__score", F.col(score)).groupBy(*group, "__score", "__part").agg(F.min("__rank").alias("__low"), F.count(F.lit(1)).alias("__same"))
    ties = ties.select(*group, "__score", "__part", F.min("__low").over(value).alias("__low"), F.sum("__same").over(value).alias("__same"))
    joined = _join(rows.withColumn("__score", F.col(score)), ties, [*group, "__score", "__part"])
    mean_rank = F.col("__low") + (F.col("__same") - 1) / 2.0
    upward = mean_rank if ascending else F.col("__total") + 1 - mean_rank
    out = joined.select(
        *names,
        F.col("__rank").alias(f"{prefix}rank"),
        (upward / F.col("__total")).alias(f"{prefix}percentile"),
        F.col("__total").alias(f"{prefix}ranked_count"),
        *([F.col("__run").alias(f"{prefix}running")] if running else []),
    )
    return out.unionByName(df.where(F.col(score).isNull()), allowMissingColumns=True)


def _join(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inner join on keys that may be NULL; the key columns of ``left`` stay."""
    left, right = left.alias("l"), right.alias("r")
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in on]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    return left.join(right, condition).select("l.*", *[f"r.{c}" for c in right.columns if c not in on])


def quantile_group(rank: Column, count: Column, groups: int = 5) -> Column:
    """0-based equal-frequency group of an ascending rank, interpolated at the edges.

    Integer arithmetic: the smallest q with (rank-1)*groups <= q*(count-1).
    """
    steps = (rank.cast("long") - 1) * groups
    width = F.greatest(count.cast("long") - 1, F.lit(1))
    upper = F.floor((steps + width - 1) / width).cast("int")
    return F.greatest(upper, F.lit(1)) - 1


def top_n(df: DataFrame, by: Sequence[str], score: str, tie: str, n) -> DataFrame:
    """Best ``n`` rows of each group; Spark limits every task before the shuffle."""
    w = Window.partitionBy(*by).orderBy(F.col(score).desc_nulls_last(), F.col(tie).asc())
    return df.withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= n)
