"""The five-layer factor model and its incremental update."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..operators.bars import monthly_returns
from ..operators.calendar import per_date
from ..operators.exposures import design_panel, exposure_grid
from ..operators.quality import factor_coverage, quality_flags
from ..operators.regression import build_stripped
from ..operators.returns import HORIZONS, cumulative_index, lagged_vol_target, with_horizon_returns, with_zscores
from ..operators.spreads import basket_returns
from ..operators.versioning import affected_months, diff_observations, invalidated_fits, update_summary
from ..session import cut_lineage


def specified_legs(returns: DataFrame, macro: Sequence[tuple] = (), style: Sequence[tuple] = ()) -> DataFrame:
    """(factor, layer, kind, sign, paired, date, idx, long, short, hedge): the legs of all specified factors side by side.

    Every leg is a row of one specification table, which meets the returns once; a leg without a return on a day is null there.
    """
    rows = [(f, "macro", kind, sign, short is not None, role, ticker) for f, kind, long, short, sign in macro for role, ticker in (("long", long), ("short", short)) if ticker]
    rows += [(f, "style", None, 1, False, role, ticker) for f, long, hedge in style for role, ticker in (("long", long), ("hedge", hedge))]
    spec = returns.sparkSession.createDataFrame(rows, "factor string, layer string, kind string, sign int, paired boolean, role string, ticker string")
    legs = returns.where("ret is not null").select("ticker", "date", "idx", "ret").join(spec, "ticker")
    of = lambda role, value: F.max(F.when(F.col("role") == role, F.col(value)))
    return legs.groupBy("factor", "layer", "kind", "sign", "paired", "date").agg(
        of("long", "idx").alias("idx"), *[of(role, "ret").alias(role) for role in ("long", "short", "hedge")])


def _macro(legs: DataFrame) -> DataFrame:
    raw = F.col("long") * F.col("sign") - F.when(F.col("paired"), F.col("short")).otherwise(F.lit(0.0))
    series = legs.where("layer = 'macro'").select("factor", "kind", "date", "idx", raw.alias("ret")).where("ret is not null")
    scaled = lagged_vol_target(series.where("kind = 'vol'"), "factor", gaps="break")
    return series.where("kind = 'raw'").select("factor", "date", "ret").unionByName(
        scaled.select("factor", "date", F.col("scaled_return").alias("ret"))
    )


def _style(legs: DataFrame, beta_timing: str) -> DataFrame:
    rows = legs.where("layer = 'style' and long is not null and hedge is not null").select("factor", "date", F.col("long").alias("y"), F.array("hedge").alias("x"))
    return build_stripped(rows, 1, beta_timing=beta_timing)


def macro_factors(returns: DataFrame, macro: Sequence[tuple] = C.MACRO) -> DataFrame:
    """Signed leg or long-minus-short spread, raw or volatility-scaled, as (factor, date, ret)."""
    return _macro(specified_legs(returns, macro=macro))


def style_factors(returns: DataFrame, style: Sequence[tuple] = C.STYLE, beta_timing: str = "same_friday") -> DataFrame:
    """Each long leg stripped of its own hedge; all styles in one job keyed by factor."""
    return _style(specified_legs(returns, style=style), beta_timing)


def core_layer(returns: DataFrame, macro=C.MACRO, style=C.STYLE) -> DataFrame:
    """Macro and style factors from one table of legs, written out once, so that returns are planned once whatever the number of factors."""
    legs = cut_lineage(specified_legs(returns, macro, style))
    return _macro(legs).unionByName(_style(legs, "same_friday"))


def stripped_layer(
    targets: DataFrame, stack: DataFrame, stack_names: Sequence[str], beta_timing: str = "same_friday"
) -> DataFrame:
    """Targets (factor, date, y) stripped of the complete-case stack (factor, date, ret)."""
    design = design_panel(stack, stack_names).select("date", "x")
    return build_stripped(targets.join(per_date(design), "date"), len(stack_names), beta_timing=beta_timing)


def proxy_targets(returns: DataFrame, proxies: Mapping[str, str], *, required: bool) -> DataFrame:
    """Daily returns of layer ETFs named by factor; absent ones are skipped or raise."""
    spark = returns.sparkSession
    spec = spark.createDataFrame(list(proxies.items()), "factor string, ticker string")
    if required:
        traded = returns.select("ticker").distinct().withColumn("__ok", F.lit(True))
        checked = spec.join(traded, "ticker", "left")
        fail = F.raise_error(F.concat(F.lit("missing proxy prices: "), F.col("ticker"))).cast("string")
        spec = checked.select("factor", F.when(F.col("__ok"), F.col("ticker")).otherwise(fail).alias("ticker"))
    return returns.where("ret is not null").join(spec, "ticker").select("factor", "date", F.col("ret").alias("y"))


def theme_targets(returns: DataFrame, members: Sequence[tuple[str, str]]) -> DataFrame:
    """Basket means that need every fixed member."""
    spec = returns.sparkSession.createDataFrame(list(members), "factor string, ticker string")
    return basket_returns(returns, spec, require_all=True).withColumnRenamed("ret", "y")


def build_model(
    returns: DataFrame,
    *,
    macro: Sequence[tuple] = C.MACRO,
    style: Sequence[tuple] = C.STYLE,
    sectors: Mapping[str, str] | None = C.SECTORS,
    industries: Mapping[str, str] | None = C.INDUSTRIES,
    countries: Mapping[str, str] | None = C.COUNTRIES,
    themes: Sequence[tuple[str, str]] | None = None,
    with_sectors: bool = True,
    with_industries: bool = True,
    with_countries: bool = True,
    with_themes: bool = True,
    persist=cut_lineage,
) -> DataFrame:
    """Hierarchical factor panel (factor, date, ret).

    Every layer is stripped of all layers before it, so each is written once (``persist``,
    a reliable checkpoint by default) and read by the next.  A layer switched
    off ends the hierarchy there.
    """
    themes = C.theme_members() if themes is None else list(themes)
    stack = persist(core_layer(returns, macro, style))
    names = [m[0] for m in macro] + [s[0] for s in style]
    layers = (
        (with_sectors, sectors, False),
        (with_industries, industries, True),
        (with_countries, countries, True),
    )
    for wanted, table, required in layers:
        if not wanted:
            return stack
        targets = proxy_targets(returns, table, required=required)
        layer = persist(stripped_layer(targets, stack, names))
        stack = stack.unionByName(layer)
        names = names + list(table)
        if not required:
            # absent sector proxies leave no rows; keep only the factors that exist
            present = {r[0] for r in layer.select("factor").distinct().limit(len(table)).collect()}
            names = [n for n in names if n not in table or n in present]
    if not with_themes:
        return stack
    layer = persist(stripped_layer(theme_targets(returns, themes), stack, names))
    return stack.unionByName(layer)


def thematic_factor(returns: DataFrame, stack: DataFrame, stack_names: Sequence[str], *, tickers: Sequence[str] | None = None, etf: str | None = None, name: str = "Thematic"):
    """One custom theme from a complete basket or a single ETF."""
    if tickers:
        targets = theme_targets(returns, [(name, t) for t in tickers])
    elif etf:
        targets = proxy_targets(returns, {name: etf}, required=True)
    else:
        raise ValueError("give tickers or an etf")
    return stripped_layer(targets, stack, stack_names)


def factor_observations(panel: DataFrame, horizons: Sequence[int] = HORIZONS, coverage: bool = True) -> DataFrame:
    """Stored form of a panel: index, horizon returns and z-scores as maps, coverage, flags.

    All statistics share one partitioning and one sort by (factor, date).
    """
    obs = cumulative_index(panel.where("ret is not null"), "factor")
    wide = with_zscores(with_horizon_returns(obs, "factor", horizons=horizons), "factor", horizons=horizons)
    as_map = lambda p: F.map_from_arrays(F.array(*[F.lit(h) for h in horizons]), F.array(*[F.col(f"{p}_{h}") for h in horizons]))
    out = wide.select(
        "factor", "date", F.col("ret").alias("scaled_return"), "cumulative_index", as_map("ret").alias("horizons"), as_map("z").alias("zscores")
    )
    if coverage:  # needs the panel's distinct dates, hence a second pass
        out = out.join(factor_coverage(panel).select("factor", F.col("ratio").alias("coverage")), "factor")
    return quality_flags(out)


def latest_panel(observations: DataFrame, windows: Sequence[int] = (1, 5, 21, 63, 252)) -> DataFrame:
    """Return percent and z per window at each factor's own latest date."""
    rest = [c for c in observations.columns if c != "factor"]
    last = observations.groupBy("factor").agg(F.max_by(F.struct(*rest), "date").alias("o"))
    cells = []
    for w in windows:
        r = F.col("o.scaled_return") if w == 1 else F.element_at("o.horizons", F.lit(w))
        cells += [(100 * r).alias(f"return_percent_{w}"), F.element_at("o.zscores", F.lit(w)).alias(f"z_{w}")]
    return last.select("factor", F.col("o.date").alias("date"), *cells)


def incremental_update(
    new_panel: DataFrame,
    stored_panel: DataFrame,
    stored_fits: DataFrame,
    returns: DataFrame,
    calendar: DataFrame,
    ends: DataFrame,
    levels: Mapping[str, Sequence[str]],
    **fit_options,
) -> dict[str, DataFrame]:
    """Diff, invalidate and re-fit only the affected months; all parts stay lazy.

    ``fits`` holds the surviving stored rows and the new ones, new winning per key.
    """
    changes = diff_observations(new_panel, stored_panel)
    summary = update_summary(changes, stored_panel)
    latest = new_panel.agg(F.max("date").alias("latest_date"))
    stale = invalidated_fits(stored_fits, summary, latest)
    months = affected_months(summary, ends)
    fresh = exposure_grid(returns, new_panel, calendar, months, levels, **fit_options)
    keys = ["ticker", "level", "period"]
    kept = stored_fits.join(stale.select(*keys), keys, "left_anti").join(fresh.select(*keys), keys, "left_anti")
    return {"changes": changes, "summary": summary, "stale": stale, "months": months, "fits": kept.unionByName(fresh, allowMissingColumns=True)}


def monthly_factor_returns(panel: DataFrame) -> DataFrame:
    return monthly_returns(panel, "factor")
