"""Security master, holdings and cash rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import finite, normalize_ticker
from ..operators.versioning import keep_latest

# A column of the source file, the accepted range, defaults of missing texts.
RATE_COLUMN = "13 WEEKS COUPON EQUIVALENT"
RATE_RANGE = (-0.01, 0.25)
TEXT_DEFAULTS = {"name": "", "asset_type": "stock", "sector": "", "industry": "", "exchange": "", "currency": "USD"}


def read_cash_rates(spark: SparkSession, path: str, column: str = RATE_COLUMN) -> DataFrame:
    """One CSV per year, percent yields -> (date, annualized_rate); see :func:`clean_cash_rates`."""
    raw = spark.read.option("header", True).csv(path)
    if column not in raw.columns:
        raise ValueError(f"the rate files have no column {column}")
    return clean_cash_rates(raw.select(F.col("Date").alias("date_text"), F.col(column).alias("percent_text")))


def clean_cash_rates(raw: DataFrame) -> DataFrame:
    """Month/day/year dates and percent text; bad values dropped, duplicate dates keep the
    first file row (``seq`` when given), implausible yields raise."""
    seq = F.col("seq") if "seq" in raw.columns else F.monotonically_increasing_id()
    rates = raw.select(
        F.to_date("date_text", "M/d/yyyy").alias("date"),
        (finite(F.col("percent_text").try_cast("double")) / 100).alias("annualized_rate"),
        seq.alias("seq"),
    ).where("date is not null and annualized_rate is not null")
    first = rates.groupBy("date").agg(F.min_by("annualized_rate", "seq").alias("annualized_rate"))
    low, high = RATE_RANGE
    checked = F.when(F.col("annualized_rate").between(low, high), F.col("annualized_rate")).otherwise(
        F.raise_error(F.lit("cash yields fall outside a plausible range")).cast("double")
    )
    return first.select("date", checked.alias("annualized_rate"))


def upsert_rates(stored: DataFrame, incoming: DataFrame, order: str = "batch") -> DataFrame:
    return keep_latest(stored.unionByName(incoming), ["date"], order)


def read_holdings(spark: SparkSession, path: str) -> DataFrame:
    return parse_holdings(spark.read.option("header", True).csv(path))


def parse_holdings(raw: DataFrame) -> DataFrame:
    """(…, ticker, weight, shares, problem): ``ticker`` or ``symbol``; blank symbols are skipped,
    rows without weight and shares are marked."""
    text = lambda c: F.when(F.trim(F.col(c)) != "", F.col(c)) if c in raw.columns else F.lit(None).cast("string")
    ticker = normalize_ticker(F.coalesce(text("ticker"), text("symbol")))
    rest = [c for c in raw.columns if c not in {"ticker", "symbol", "weight", "shares"}]
    out = raw.select(*rest, ticker.alias("ticker"), text("weight").try_cast("double").alias("weight"), text("shares").try_cast("double").alias("shares"))
    return out.where("ticker <> ''").withColumn(
        "problem", F.when(F.col("weight").isNull() & F.col("shares").isNull(), "provide weight or shares")
    )


def validate_holdings(holdings: DataFrame) -> DataFrame:
    """Normalise weights when all are given; mark duplicates, negatives and zero sums."""
    dup = holdings.groupBy("portfolio", "ticker").agg(F.count(F.lit(1)).alias("__c"))
    stats = holdings.groupBy("portfolio").agg(
        (F.count("weight") == F.count(F.lit(1))).alias("__all"), F.sum("weight").alias("__s"), F.min("weight").alias("__m")
    )
    j = holdings.join(dup, ["portfolio", "ticker"]).join(stats, "portfolio")
    problem = (
        F.when(F.col("__c") > 1, "duplicate ticker")
        .when(F.col("__all") & (F.col("__m") < 0), "negative weight")
        .when(F.col("__all") & (F.col("__s") <= 0), "weights must sum to a positive value")
    )
    return j.select(
        *[c for c in holdings.columns if c != "weight"],
        F.when(F.col("__all") & (F.col("__s") > 0), F.col("weight") / F.col("__s")).otherwise(F.col("weight")).alias("weight"),
        problem.alias("validation"),
    )


def without_prices(wanted: DataFrame, prices: DataFrame) -> DataFrame:
    """Symbols that no price refers to."""
    return wanted.select("ticker").distinct().join(prices.select("ticker").distinct(), "ticker", "left_anti")


def upsert_securities(stored: DataFrame, incoming: DataFrame, source: str) -> DataFrame:
    """Replace listed securities by incoming metadata with field defaults; others stay."""
    new = incoming.withColumn("ticker", normalize_ticker("ticker")).where("ticker <> ''")
    for name, default in TEXT_DEFAULTS.items():
        new = new.withColumn(name, F.coalesce(F.col(name), F.lit(default)) if name in new.columns else F.lit(default))
    for name, kind in (("current_shares", "double"), ("market_cap", "double"), ("metadata_as_of", "date")):
        new = new.withColumn(name, F.col(name).cast(kind) if name in new.columns else F.lit(None).cast(kind))
    new = new.withColumn("source", F.lit(source)).select(*stored.columns)
    return stored.join(new.select("ticker"), "ticker", "left_anti").unionByName(new)


def first_wins(*frames: DataFrame, key: str = "ticker") -> DataFrame:
    """Union in priority order; the first frame holding a key supplies its row."""
    tagged = [f.withColumn("__p", F.lit(i)) for i, f in enumerate(frames)]
    total = tagged[0]
    for f in tagged[1:]:
        total = total.unionByName(f, allowMissingColumns=True)
    rest = [c for c in total.columns if c not in {key, "__p"}]
    return total.groupBy(key).agg(F.min_by(F.struct(*rest), "__p").alias("v")).select(key, *[F.col(f"v.{c}").alias(c) for c in rest])


def with_current_caps(metadata: DataFrame, caps: DataFrame) -> DataFrame:
    return metadata.join(caps, "ticker", "left")
