"""Screens, eligibility and monthly selections."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import ranked, top_n
from ..functions.scalars import normalize_ticker
from .cross_section import check_factors, composite, factor_table, fill_unselected

# Fixed values of the screen rules: rule name -> feature column.
RULE_COLUMNS = {
    "market_cap": "market_cap",
    "beta": "Market",
    "significance": "beta_significance",
    "adjusted_r2": "adjusted_r2",
    "residual_volatility": "residual_volatility",
    "coverage": "coverage",
}
DEFAULT_TRADING_DAYS = 252
FORMER_COVERAGE_DEFAULT = 0.8


def parse_tickers(df: DataFrame, text: str, key: str) -> DataFrame:
    """(key, ticker, pos): symbols split at commas and newlines, first mention kept."""
    parts = F.split(F.translate(F.col(text), "\n", ","), ",")
    return (
        df.select(key, F.posexplode(parts).alias("pos", "raw"))
        .withColumn("ticker", normalize_ticker("raw"))
        .where("ticker <> ''")
        .groupBy(key, "ticker")
        .agg(F.min("pos").alias("pos"))
    )


def resolve_filters(days: Column, coverage: Column) -> tuple[Column, Column]:
    """Effective (minimum days, coverage floor) of a stored screen.

    Unset days mean one year, and in that case a bare 80 % coverage, the former
    default, no longer applies.
    """
    dropped = F.coalesce(days.isNull() & (F.abs(coverage - FORMER_COVERAGE_DEFAULT) < 1e-9), F.lit(False))
    floor = F.when(~dropped, coverage)
    return F.coalesce(days.cast("int"), F.lit(DEFAULT_TRADING_DAYS)), floor


def eligibility(
    *,
    sectors: Iterable[str] | None = None,
    minimum_days: int | None = None,
    minimum_coverage: float | None = None,
    minimum_adjusted_r2: float | None = None,
    excluded: Iterable[str] = (),
) -> Column:
    """Boolean over the fit columns (sector, observation_count, coverage, adjusted_r2, ticker)."""
    days = F.lit(minimum_days).cast("int")
    cover = F.lit(minimum_coverage).cast("double")
    need, floor = resolve_filters(days, cover)
    keep = (F.col("observation_count") >= need) & F.coalesce(F.col("coverage") >= floor, floor.isNull())
    sectors = [s for s in sectors or [] if s]
    if sectors:
        keep = keep & F.col("sector").isin(sectors)
    if minimum_adjusted_r2 is not None:
        keep = keep & (F.col("adjusted_r2") >= float(minimum_adjusted_r2))
    excluded = list(excluded)
    if excluded:
        keep = keep & ~F.col("ticker").isin(excluded)
    return F.coalesce(keep, F.lit(False))


def prefilter(
    df: DataFrame,
    *,
    minimums: Mapping[str, float] | None = None,
    maximums: Mapping[str, float] | None = None,
    allowed_sectors: Sequence[str] | None = None,
) -> DataFrame:
    """Min/max/sector filter on a feature table; unknown feature names are ignored."""
    for name, low in (minimums or {}).items():
        if name in df.columns:
            df = df.where(F.col(name) >= low)
    for name, high in (maximums or {}).items():
        if name in df.columns:
            df = df.where(F.col(name) <= high)
    return df.where(F.col("sector").isin(list(allowed_sectors))) if allowed_sectors else df


def rule_flags(df: DataFrame, filters: Mapping) -> DataFrame:
    """Add ``passed`` and the map ``rules``: one flag per configured rule."""
    flags: dict[str, Column] = {}
    if filters.get("sectors"):
        flags["sector"] = F.col("sector").isin(list(filters["sectors"]))
    for rule, column in RULE_COLUMNS.items():
        if rule not in filters:
            continue
        if column not in df.columns:
            raise ValueError(f"filter {rule} needs the field {column}")
        bounds = filters[rule] or {}
        value, ok = F.col(column).try_cast("double"), F.lit(True)
        if bounds.get("min") is not None:
            ok = ok & F.coalesce(value >= float(bounds["min"]), F.lit(False))
        if bounds.get("max") is not None:
            ok = ok & F.coalesce(value <= float(bounds["max"]), F.lit(False))
        flags[rule] = ok
    flags = {k: F.coalesce(v, F.lit(False)) for k, v in flags.items()}
    passed = F.lit(True)
    for ok in flags.values():
        passed = passed & ok
    pairs = [item for name, ok in flags.items() for item in (F.lit(name), ok)]
    rules = F.create_map(*pairs) if pairs else F.expr("map()").cast("map<string,boolean>")
    return df.withColumn("passed", passed).withColumn("rules", rules)


def effective_weights(weights: Mapping[str, float], regimes: Mapping[str, float] | None):
    """(name, source factor, multiplier, weight) of every scored column.

    A regime column is its factor times a scalar.  It is scored with direction +1 and
    the factor's weight; standardising leaves only the sign (or zero) of the scalar.
    """
    rows = [(n, n, 1.0, float(w)) for n, w in weights.items()]
    for factor, level in (regimes or {}).items():
        rows.append((f"{factor}_regime", factor, float(level), float(weights.get(factor, 1.0))))
    return rows


def screen_preview(
    fits: DataFrame,
    exposures: DataFrame,
    weights: Mapping[str, float],
    filters: Mapping,
    *,
    directions: Mapping[str, int] | None = None,
    regimes: Mapping[str, float] | None = None,
    by: Sequence[str] = ("as_of",),
    known: Sequence[str] | None = None,
) -> DataFrame:
    """Composite over all rows, rank over the passed ones, percentile over all.

    ``fits`` carry the rule columns; ``exposures(by, ticker, factor, beta)``.  ``known`` names the catalog's factors:
    a weighted or regime factor outside it raises.
    """
    directions = directions or {}
    check_factors({**weights, **dict.fromkeys(regimes or {}, 1.0)}, known)
    rows = effective_weights(weights, regimes)
    if not sum(abs(r[3]) for r in rows):
        raise ValueError("a screen needs a non-zero factor weight")
    table = F.array(
        *[
            F.struct(
                F.lit(source).alias("factor"),
                F.lit(name).alias("column"),
                F.lit(scale).alias("scale"),
                F.lit(weight).alias("weight"),
                F.lit(int(directions.get(name, 1))).alias("direction"),
            )
            for name, source, scale, weight in rows
        ]
    )
    keys = [*by, "ticker"]
    long = fill_unselected(fits.select(*keys), exposures.select(*keys, "factor", "beta"), keys, table)
    long = long.withColumn("beta", F.col("beta") * F.col("scale")).withColumn("factor", F.col("column"))
    scored = composite(long, by)
    flagged = rule_flags(fits, filters)
    joined = flagged.join(scored, keys).withColumn("__p", F.when(F.col("passed"), F.col("composite")))
    among_all = ranked(joined, by, "composite", "ticker", prefix="all_")
    among_passed = ranked(among_all, by, "__p", "ticker", prefix="passed_")
    return among_passed.select(
        *[c for c in joined.columns if c != "__p"],
        F.col("passed_rank").alias("rank"),
        F.col("all_percentile").alias("percentile"),
    )


def selection(
    fits: DataFrame,
    exposures: DataFrame,
    weights: Mapping[str, float],
    *,
    directions: Mapping[str, int] | None = None,
    top: int = 20,
    manual: Sequence[str] = (),
    by: Sequence[str] = ("as_of",),
    known: Sequence[str] | None = None,
    **rules,
) -> DataFrame:
    """Universe-wide composite, then eligibility, then the best ``top`` per group.

    A weighted factor outside ``known`` (the catalog's names) raises.  Zero weights are ignored.  Manual names that have a fit are flagged in place.
    Adds score ranks, percentile (0-100), confidence, model_selected and included.
    """
    if any(w < 0 for w in weights.values()):
        raise ValueError("weights must be non-negative; invert with a direction")
    weights = {n: w for n, w in weights.items() if w}
    if not 1 <= int(top) <= 100:
        raise ValueError("the stock limit lies between 1 and 100")
    manual = list(manual)
    overlap = set(manual) & set(rules.get("excluded", ()))
    if overlap:
        raise ValueError(f"both manual and excluded: {sorted(overlap)}")
    signs = {n: -1 if (directions or {}).get(n, 1) < 0 else 1 for n in weights}
    keys = [*by, "ticker"]
    long = fill_unselected(
        fits.select(*keys), exposures.select(*keys, "factor", "beta"), keys, factor_table(weights, signs, known)
    )
    counts = long.groupBy(*keys).agg((F.sum(F.col("selected").cast("int")) / F.lit(float(len(weights)))).alias("confidence"))
    scored = composite(long, by).join(counts, keys)
    rows = fits.join(scored, keys).withColumn("eligible", eligibility(**rules))
    rows = ranked(rows, by, "composite", "ticker").withColumn("percentile", 100 * F.col("percentile"))
    picked = top_n(rows.where("eligible").select(*keys, "composite"), by, "composite", "ticker", int(top))
    rows = rows.join(picked.select(*keys, F.lit(True).alias("model_selected")), keys, "left").withColumn(
        "model_selected", F.coalesce("model_selected", F.lit(False))
    )
    is_manual = F.col("ticker").isin(manual) if manual else F.lit(False)
    return rows.withColumn("included", F.col("model_selected") | is_manual).withColumn(
        "selection_source",
        F.when(is_manual, "manual").when(F.col("model_selected"), "model").otherwise(""),
    )


def with_manual(rows: DataFrame, manual: DataFrame, by: Sequence[str] = ("as_of",)) -> DataFrame:
    """Included rows plus manual names (by, ticker) without a fit, with equal weights.

    Model names come first by score, then manual ones by ticker; ``position`` orders them.
    """
    keys = [*by, "ticker"]
    kept = rows.where("included").select(*keys, "composite", "selection_source")
    extra = manual.select(*keys).distinct().join(kept, keys, "left_anti").withColumn("selection_source", F.lit("manual"))
    both = kept.unionByName(extra, allowMissingColumns=True)
    # included rows per group: the stock limit plus the manual list
    order = Window.partitionBy(*by).orderBy(
        (F.col("selection_source") == "manual"), F.col("composite").desc_nulls_last(), "ticker"
    )
    sizes = both.groupBy(*by).agg((1.0 / F.count(F.lit(1))).alias("portfolio_weight"))
    return both.join(sizes, list(by)).withColumn("position", F.row_number().over(order))


def monthly_decisions(rows: DataFrame, strategy: str, *, period: str = "period", as_of="as_of", max_months=None):
    """Decision table (strategy, signal_date, ticker, weight NULL = equal) of included rows."""
    dates = rows.groupBy(period).agg(F.max(as_of).alias("signal_date"))
    if max_months is not None:
        w = Window.orderBy(F.desc(period))  # one row per month
        dates = dates.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= int(max_months)).drop("__n")
    return (
        rows.where("included")
        .select(period, "ticker")
        .join(dates, period)
        .select(
            F.lit(strategy).alias("strategy"),
            "signal_date",
            "ticker",
            F.lit(None).cast("double").alias("weight"),
        )
    )
