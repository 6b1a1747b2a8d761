"""Factor definitions, nested catalogs, construction metadata and universe choice."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as C
from .calendar import latest_per_key


def catalog_members(spark: SparkSession, catalogs: Mapping[str, Sequence[str]] = C.CATALOGS) -> DataFrame:
    """(level, factor, position) in catalog order."""
    rows = [(lvl, f, i) for lvl, fs in catalogs.items() for i, f in enumerate(fs)]
    return spark.createDataFrame(rows, "level string, factor string, position int")


def level_columns(catalogs: Mapping[str, Sequence[str]], available: Sequence[str], levels: Sequence[str]) -> dict[str, list[str]]:
    """Ordered factor list per requested level, limited to factors that exist."""
    unknown = sorted(set(levels) - set(catalogs))
    if unknown:
        raise ValueError(f"unknown catalogs: {unknown}")
    have = set(available)
    return {lvl: [f for f in catalogs[lvl] if f in have] for lvl in levels}


def specifications(spark: SparkSession) -> DataFrame:
    """Raw construction specs: (construction, layer, spec_kind, long_leg, short_leg, hedge, sign, basket)."""
    rows = [(n, "macro", k, lo, sh, None, s, None) for n, k, lo, sh, s in C.MACRO]
    rows += [(n, "style", "strip", lo, None, h, 1, None) for n, lo, h in C.STYLE]
    for layer, table in (("sector", C.SECTORS), ("industry", C.INDUSTRIES), ("country", C.COUNTRIES)):
        rows += [(n, layer, "strip", etf, None, None, 1, None) for n, etf in table.items()]
    rows += [(n, "thematic", "strip", None, None, None, 1, list(t)) for n, t in C.THEMES.items()]
    return spark.createDataFrame(
        rows,
        "construction string, layer string, spec_kind string, long_leg string, short_leg string, "
        "hedge string, sign int, basket array<string>",
    )


def construction_details(specs: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """User-facing construction metadata derived from the specs."""
    # The labels below are part of the results.
    kind = (
        F.when((F.col("layer") == "macro") & F.col("short_leg").isNotNull(), "long_short")
        .when((F.col("layer") == "macro") & (F.col("sign") == -1), "inverted_etf")
        .when(F.col("layer") == "macro", "direct_etf")
        .when(F.col("layer") == "thematic", "residualized_thematic_basket")
        .otherwise(F.concat(F.lit("residualized_"), F.col("layer")))
    )
    stack = (
        F.when(F.col("layer") == "style", F.col("hedge"))
        .when(F.col("layer") == "sector", "core factors")
        .when(F.col("layer") == "industry", "core and sector factors")
        .when(F.col("layer") == "country", "core, sector, and industry factors")
        .when(F.col("layer") == "thematic", "core, sector, industry, and country factors")
    )
    stripped = F.col("layer") != "macro"
    out = specs.select(
        "construction",
        "layer",
        kind.alias("kind"),
        "long_leg",
        "short_leg",
        (F.col("sign") == -1).alias("inverted"),
        F.array_compact(F.array(stack)).alias("purified_against"),
        F.coalesce("basket", F.array().cast("array<string>")).alias("basket"),
        F.when(F.col("spec_kind") != "raw", F.lit(C.TARGET_VOLATILITY)).alias("volatility_target"),
        F.when(stripped, "Friday-compounded weekly returns").alias("estimation_frequency"),
        F.when(stripped, "156 weeks").alias("rolling_window"),
    )
    if names is None:
        return out
    return names.join(out, "construction", "left").withColumn("kind", F.coalesce("kind", F.lit("unknown")))


def definitions(spark: SparkSession) -> DataFrame:
    """(factor, construction, family, level, sort_order, provenance_badge) of every catalog factor."""
    rows = []
    for i, name in enumerate(C.CATALOGS["all_factors"]):
        if name in C.CORE_CATALOG:
            family = "market" if name == "Market" else ("macro" if i < 6 else "style")
        elif name in C.SECTOR_CATALOG:
            family = "sector"
        else:
            family = "industry" if name in C.INDUSTRIES else "country" if name in C.COUNTRIES else "thematic"
        level = "base" if name in C.CORE_CATALOG else family
        badge = "public_approximation" if name in C.APPROXIMATED_STYLES or family == "thematic" else "exact_etf"
        rows.append((name, C.CONSTRUCTION_NAMES.get(name, name), family, level, i, badge))
    return spark.createDataFrame(
        rows, "factor string, construction string, family string, level string, sort_order int, provenance_badge string"
    )


def theme_equations(members: DataFrame, date) -> DataFrame:
    """Equal basket weights per theme as a map."""
    sized = members.groupBy("factor").agg(F.array_sort(F.collect_list("ticker")).alias("t"))
    return sized.select(
        "factor",
        F.lit(date).cast("date").alias("date"),
        F.map_from_entries(F.transform("t", lambda x: F.struct(x, 1.0 / F.size("t")))).alias("basket_weights"),
        F.lit("fixed_equal_weight_basket").alias("kind"),
    )


def market_caps(securities: DataFrame, prices: DataFrame) -> DataFrame:
    """Stored caps when any exists, else current shares times the last known price."""
    any_cap = securities.agg(F.count("market_cap").alias("__caps")).withColumn("__k", F.lit(1))
    last = latest_per_key(prices.select("ticker", "date", "close"), ["ticker"], "date").select("ticker", "close")
    return (
        securities.withColumn("__k", F.lit(1)).join(any_cap, "__k").join(last, "ticker", "left")
        .withColumn(
            "cap",
            F.when(F.col("__caps") > 0, F.col("market_cap")).otherwise(F.col("current_shares") * F.col("close")),
        )
        .drop("__k", "__caps")
    )


def top_by_cap(caps: DataFrame, n: int, company: str | None = None) -> DataFrame:
    """Largest n by cap, one security per company id when that column is given."""
    data = caps.where("cap is not null")
    if company:
        w = Window.partitionBy(company).orderBy(F.desc("cap"), "ticker")  # share classes of one company
        data = data.withColumn("__c", F.row_number().over(w)).where("__c = 1").drop("__c")
    return data.orderBy(F.desc("cap"), "ticker").limit(int(n))


def exposure_universe(securities: DataFrame, prices: DataFrame, *, requested: Sequence[str] | None = None, top_n: int | None = None, company: str | None = None, benchmark: str = C.BENCHMARK):
    """Stocks to fit: an explicit list (unknown names raise), the top n by cap, or all plus the benchmark."""
    traded = prices.select("ticker").distinct()
    stocks = securities.where("asset_type = 'stock'").join(traded, "ticker", "left_semi")
    if requested:
        names = [r.strip().upper() for r in requested if r.strip()]
        spark = prices.sparkSession
        asked = spark.createDataFrame([(n,) for n in dict.fromkeys(names)], "ticker string")
        found = asked.join(stocks.select("ticker", F.lit(True).alias("__ok")), "ticker", "left")
        problem = F.raise_error(F.concat(F.lit("unknown stock ticker: "), F.col("ticker")))
        return found.select(F.when(F.col("__ok"), F.col("ticker")).otherwise(problem.cast("string")).alias("ticker"))
    if top_n:
        return top_by_cap(market_caps(stocks, prices), top_n, company).select("ticker")
    return stocks.select("ticker").union(traded.where(F.col("ticker") == benchmark)).distinct()
