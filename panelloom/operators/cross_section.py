"""Cross-sectional scores.

Moments of a cross-section are partial aggregates joined back to the rows;
ranks go through :mod:`panelloom.functions.ranks`.  Neither gathers a cross-section
in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import ranked
from ..functions.scalars import clip

SCORE_CAP = 3.0


def zscore(df: DataFrame, by: Sequence[str], value: str, name: str = "z", direction=1) -> DataFrame:
    """Population z-score inside each group; 0 where the group does not vary."""
    data = df if by else df.withColumn("__all", F.lit(0))
    group = list(by) or ["__all"]
    stats = data.groupBy(*group).agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__sd"))
    z = F.when(F.col("__sd") > 0, (F.col(value) - F.col("__m")) / F.col("__sd")).otherwise(F.lit(0.0))
    out = data.join(stats, group).withColumn(name, z * direction)
    return out.drop("__m", "__sd", "__all")


def capped_zscore(df: DataFrame, by, value: str, name: str = "z", direction=1, cap: float = SCORE_CAP) -> DataFrame:
    return zscore(df, by, value, name, direction).withColumn(name, clip(name, -cap, cap))


def factor_table(weights: Mapping[str, float], directions: Mapping[str, int] | None = None, known: Sequence[str] | None = None):
    """Literal array of (factor, weight, direction): a configuration, not data; names are checked against ``known``."""
    directions = directions or {}
    check_factors(weights, known)
    if not weights:
        raise ValueError("no factors configured")
    return F.array(
        *[
            F.struct(
                F.lit(n).alias("factor"),
                F.lit(float(w)).alias("weight"),
                F.lit(int(directions.get(n, 1))).alias("direction"),
            )
            for n, w in weights.items()
        ]
    )


def check_factors(weights: Mapping[str, float], known: Sequence[str] | None) -> None:
    """Raise where a weighted factor is not one of ``known``; it would count as beta 0 everywhere.  None: no check."""
    missing = [] if known is None else sorted(n for n, w in weights.items() if w and n not in known)
    if missing:
        raise ValueError(f"configured factors are unavailable: {', '.join(missing)}")


def fill_unselected(fits: DataFrame, exposures: DataFrame, keys: Sequence[str], factors) -> DataFrame:
    """One row per fit and configured factor; a factor the fit did not select has beta 0.

    ``factors`` is an array column of structs (literal or per-row).  It is exploded on
    the fits, so the grid needs no cross join.
    """
    grid = fits.withColumn("__f", F.explode(factors)).select("*", "__f.*").drop("__f")
    extra = [c for c in exposures.columns if c not in {*keys, "factor"}]
    joined = grid.join(exposures.select(*keys, "factor", *extra), [*keys, "factor"], "left")
    return joined.withColumn("selected", F.col("beta").isNotNull()).withColumn(
        "beta", F.coalesce("beta", F.lit(0.0))
    )


def composite(df: DataFrame, by: Sequence[str], entity: str = "ticker", value: str = "beta") -> DataFrame:
    """Weighted mean of capped, signed z-scores: sum(w*z) / sum(|w|).

    Input is long: (by, entity, factor, value, weight, direction), complete over factors.
    """
    scored = capped_zscore(df, [*by, "factor"], value, "z", F.col("direction"))
    return scored.groupBy(*by, entity).agg(
        (F.sum(F.col("weight") * F.col("z")) / F.sum(F.abs("weight"))).alias("composite"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("factor", "z")))).alias("components"),
    )


def with_ranks(df: DataFrame, by: Sequence[str], score: str, tie: str = "ticker") -> DataFrame:
    return ranked(df, by, score, tie)
