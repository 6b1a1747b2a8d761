"""Single-factor rankings of the fitted universe."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import FAMILY_ORDER
from ..functions.ranks import ranked
from .cross_section import fill_unselected, zscore


def latest_fits(fits: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Fits dated at the newest as_of (per ``keys``)."""
    group = list(keys)
    newest = fits.groupBy(*group).agg(F.max("as_of").alias("as_of"))
    return fits.join(newest, [*group, "as_of"], "left_semi")


def rank_exposures(
    fits: DataFrame,
    exposures: DataFrame,
    factor: str,
    *,
    direction: int = 1,
    sector: str = "",
    latest_return: DataFrame | None = None,
    by: Sequence[str] = ("as_of",),
) -> DataFrame:
    """Score, rank and percentile of one factor's betas inside each ``by`` group.

    The sector filter applies before standardising.  Unselected factors take part with
    beta 0.  ``latest_return(as_of, factor_return)`` adds beta * return.
    """
    pool = fits.where(F.col("sector") == sector) if sector else fits
    keys = [*by, "ticker"]
    one = F.array(F.struct(F.lit(factor).alias("factor")))
    betas = fill_unselected(pool, exposures, keys, one)
    scored = zscore(betas, by, "beta", "score", direction)
    out = ranked(scored, by, "score", "ticker")
    out = out.withColumn("percentile", 100 * F.col("percentile"))
    if latest_return is not None:
        out = out.join(latest_return, list(by), "left").withColumn(
            "contribution", F.col("beta") * F.col("factor_return")
        )
    return out


def company_history(fits: DataFrame, exposures: DataFrame, factor: str, ticker: str, direction: int = 1):
    """Beta, universe percentile and fit statistics of one company at each of its dates."""
    own_dates = fits.where(F.col("ticker") == ticker).select("as_of").distinct()
    universe = fits.join(own_dates, "as_of", "left_semi")
    return rank_exposures(universe, exposures, factor, direction=direction).where(F.col("ticker") == ticker)


def chart_extremes(ranked_rows: DataFrame, by: Sequence[str] = (), n: int = 5, rank: str = "rank") -> DataFrame:
    """First n and last n (listed from the end); small groups repeat rows, as intended."""
    count = F.col("ranked_count")
    first = ranked_rows.where(F.col(rank) <= n).withColumn("position", F.col(rank))
    last = ranked_rows.where(F.col(rank) > count - n).withColumn(
        "position", F.least(F.lit(n), count) + count - F.col(rank) + 1
    )
    return first.unionByName(last)


def factor_groups(definitions: DataFrame, members: DataFrame) -> DataFrame:
    """Catalog members with the display position of their family."""
    order = F.array(*[F.lit(f) for f in FAMILY_ORDER])
    return members.join(definitions, "factor").withColumn("family_order", F.array_position(order, F.col("family")))


def distinct_sectors(fits: DataFrame) -> DataFrame:
    return fits.where("sector is not null and sector <> ''").select("sector").distinct()
