"""Monthly multi-factor exposure grid: securities x model levels x month ends.

Plan: narrow returns are shuffled once by ticker; the (date, factor vector) design is then
broadcast (one row per date, at most 128 factors: bounded by the calendar) and joined on the
date, which keeps the partitioning by ticker, and one Arrow batch per ticker solves all its months and
levels.  Rows are not multiplied by the number of overlapping windows.  A group holds one
security's calendar, so its size is bounded.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import month_start
from .calendar import per_date

WINDOW_DAYS = 756
MINIMUM_DAYS = 252
HAC_LAGS = 5
#: A design of so many factors at most is hinted for broadcast; for a wider one Catalyst picks the join by size.
HINTED_FACTORS = 128
# Labels stored with a fit.
LABELS = {
    "fixed": "Fixed-model OLS/HAC",
    "elastic_net": "ElasticNetCV selection; conditional OLS/HAC",
}
FIT_SCHEMA = (
    "ticker string, level string, period date, as_of date, alpha double, adjusted_r2 double, "
    "residual_volatility double, active_factor_count int, design_factor_count int, observation_count int, "
    "coverage double, inference_method string, factors array<string>, beta array<double>, "
    "standard_error array<double>, t_stat array<double>, p_value array<double>, ci_low array<double>, "
    "ci_high array<double>"
)
STATS = ("beta", "standard_error", "t_stat", "p_value", "ci_low", "ci_high")


def design_panel(factors: DataFrame, order: Sequence[str], value: str = "ret") -> DataFrame:
    """(date, fidx, x): factor vectors in ``order`` on the factor date axis (one row per date)."""
    packed = (
        factors.where(F.col("factor").isin(list(order)))
        .groupBy("date")
        .agg(F.array(*[F.max(F.when(F.col("factor") == f, F.col(value))) for f in order]).alias("x"))
    )
    return packed.withColumn("fidx", F.row_number().over(Window.orderBy("date")).cast("long"))


def effective_dates(design: DataFrame, calendar: DataFrame, ends: DataFrame, levels: Mapping[str, Sequence[str]], order: Sequence[str]):
    """Per month end: the newest date with a complete design of each level.

    (period, eff array<struct<level, as_of, idx, fidx>>); windows run over one row per date.
    """
    position = {f: i for i, f in enumerate(order)}
    days = calendar.select("date", "idx").join(design, "date", "full_outer")
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    days = days.withColumn("idx", F.last("idx", True).over(w))
    structs = []
    for level, names in levels.items():
        full = F.col("x").isNotNull()
        for f in names:
            full = full & F.col("x")[position[f]].isNotNull()
        here = F.when(full, F.struct(F.lit(level).alias("level"), F.col("date").alias("as_of"), "idx", "fidx"))
        structs.append(F.last(here, True).over(w))
    packed = days.select("date", F.array_compact(F.array(*structs)).alias("eff"))
    return ends.select("period", F.col("month_end").alias("date"), F.col("idx").alias("end_idx")).join(packed, "date")


def _solver(levels: Mapping[str, Sequence[str]], order: Sequence[str], window: int, minimum: int, mode: str, lags: int):
    position = {f: i for i, f in enumerate(order)}
    columns = {lvl: [position[f] for f in names] for lvl, names in levels.items()}

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        from ..functions.kernels import elastic_net_select, ols_hac

        marks = pdf[pdf["eff"].notna()]
        rows = pdf[pdf["ret"].notna()].sort_values("idx")
        idx = rows["idx"].to_numpy()
        usable = rows[rows["x"].notna()]
        out = []
        if len(usable):
            x = np.stack(usable["x"].to_numpy()).astype(float)
            y, uidx, fidx = (usable[c].to_numpy() for c in ("ret", "idx", "fidx"))
            for period, eff in zip(marks["period"], marks["eff"]):
                for e in eff:
                    cols = columns[e["level"]]
                    inside = (uidx > e["idx"] - window) & (uidx <= e["idx"]) & (fidx > e["fidx"] - window) & (fidx <= e["fidx"])
                    sub = x[inside][:, cols]
                    ok = ~np.isnan(sub).any(axis=1)
                    xs, ys = sub[ok], y[inside][ok]
                    if len(ys) < minimum:
                        continue
                    kept = np.arange(len(cols)) if mode == "fixed" else elastic_net_select(xs, ys)
                    fit = ols_hac(ys, xs[:, kept], lags)
                    seen = int(((idx > e["idx"] - window) & (idx <= e["idx"])).sum())
                    out.append(
                        (
                            pdf["ticker"].iloc[0], e["level"], period, e["as_of"], float(fit["beta"][0]),
                            fit["adjusted_r2"], fit["residual_vol"], len(kept), len(cols), len(ys),
                            seen / float(min(window, e["idx"])), LABELS[mode],
                            [levels[e["level"]][k] for k in kept],
                            *[fit[s][1:].tolist() for s in ("beta", "se", "t", "p", "low", "high")],
                        )
                    )
        names = [c.strip().split(" ")[0] for c in FIT_SCHEMA.split(", ")]
        return pd.DataFrame(out, columns=names)

    return solve


def exposure_grid(
    returns: DataFrame,
    factors: DataFrame,
    calendar: DataFrame,
    ends: DataFrame,
    levels: Mapping[str, Sequence[str]],
    *,
    window: int = WINDOW_DAYS,
    minimum: int = MINIMUM_DAYS,
    selection_mode: str = "elastic_net",
    hac_lags: int = HAC_LAGS,
) -> DataFrame:
    """One row per (ticker, level, month) with at least ``minimum`` complete observations.

    ``returns(ticker, date, idx, ret)``, ``factors(factor, date, ret)``; ``ends`` selects the
    months.  The effective date of a level is the last one with its full design.
    """
    if selection_mode not in LABELS:
        raise ValueError("selection_mode must be elastic_net or fixed")
    levels = {k: list(v) for k, v in levels.items() if v}
    order = list(dict.fromkeys(f for names in levels.values() for f in names))
    design = design_panel(factors, order)
    eff = effective_dates(design, calendar, ends, levels, order)
    # only rows inside a window of a requested month are shuffled, so a refit of one month does not move all history
    place = F.explode("eff.idx").alias("i")
    first, last = (eff.select(place).agg(edge("i").alias("i")).scalar() for edge in (F.min, F.max))
    narrow = returns.where("ret is not null").where((F.col("idx") > first - window) & (F.col("idx") <= last)).select("ticker", "date", "idx", "ret")
    # A month is fitted while the trailing window can still hold the minimum.
    spare = int(window / 20) + 2
    spans = narrow.groupBy("ticker").agg(month_start(F.min("date")).alias("a"), month_start(F.max("date")).alias("b"))
    marks = spans.select(
        "ticker",
        F.explode(F.sequence("a", F.add_months("b", spare), F.expr("interval 1 month"))).alias("period"),
    ).join(per_date(eff.select("period", "eff")), "period")
    events = narrow.unionByName(marks, allowMissingColumns=True)
    # An explicit count keeps one solver task per core: adaptive coalescing looks at bytes only.
    parts = int(returns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    side = per_date(design) if len(order) <= HINTED_FACTORS else design
    joined = events.repartition(parts, "ticker").join(side, "date", "left")
    fits = joined.groupBy("ticker").applyInPandas(
        _solver(levels, order, window, minimum, selection_mode, hac_lags), FIT_SCHEMA
    )
    newest = calendar.agg(F.max("period").alias("__p")).withColumn("__k", F.lit(1))
    return (
        fits.withColumn("__k", F.lit(1)).join(newest, "__k")
        .withColumn("is_provisional", F.col("period") == F.col("__p")).drop("__k", "__p")
    )


def exposure_rows(fits: DataFrame) -> DataFrame:
    """(ticker, level, period, as_of, factor, beta, ...): one row per selected factor."""
    return fits.select(
        "ticker", "level", "period", "as_of", F.explode(F.arrays_zip("factors", *STATS)).alias("e")
    ).select("ticker", "level", "period", "as_of", F.col("e.factors").alias("factor"), *[f"e.{s}" for s in STATS])


def fit_rows(fits: DataFrame) -> DataFrame:
    return fits.drop("factors", *STATS)


def latest_exposures(returns, factors, calendar, names: Sequence[str], *, window: int = 252, minimum: int = 60, **kw):
    """Exposures of every security over the last ``window`` rows."""
    w = Window.orderBy(F.desc("date"))
    end = calendar.withColumn("__n", F.row_number().over(w)).where("__n = 1").select("period", F.col("date").alias("month_end"), "idx")
    return exposure_grid(returns, factors, calendar, end, {"window": list(names)}, window=window, minimum=minimum, **kw)
