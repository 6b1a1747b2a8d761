"""Performance statistics of daily return paths, all strategies at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import normal_cdf, safe_div
from .regression import mean_with_hac
from .returns import cumulative_index, drawdown, lag_autocorrelation

MIN_OBSERVATIONS = 20
# Multiplier and modulus of the Park-Miller generator.
LCG_MULTIPLIER = 48271
LCG_MODULUS = 2147483647


def statistics(df: DataFrame, key: str = "strategy", value: str = "ret", periods: int = 252) -> DataFrame:
    """Return, risk, tail and inference statistics; needs at least 20 observations.

    A strategy holds one row per trading date, which bounds its windows.
    """
    r = df.where(F.col(value).isNotNull()).select(key, "date", F.col(value).alias("r"))
    curve = drawdown(cumulative_index(r, key, "r", "equity"), key)
    n, root = F.count("r"), float(periods) ** 0.5
    base = (
        curve.groupBy(key)
        .agg(
            n.alias("observations"),
            (F.pow(F.product(1 + F.col("r")), F.lit(float(periods)) / n) - 1).alias("annual_return"),
            (F.avg("r") * periods).alias("arithmetic_annual_return"),
            (F.stddev_samp("r") * root).alias("annual_volatility"),
            (F.stddev_samp(F.when(F.col("r") < 0, F.col("r"))) * root).alias("__down"),
            F.min("drawdown").alias("max_drawdown"),
            F.percentile("r", F.lit(0.05)).alias("__q05"),
            F.avg("r").alias("__mean"),
            F.stddev_samp("r").alias("__sd"),
            F.skewness("r").alias("__skew"),
            (F.kurtosis("r") + 3).alias("__kurt"),
            F.max_by("equity", "date").alias("__equity"),
        )
        .where(F.col("observations") >= MIN_OBSERVATIONS)
    )
    # quantile and tail come from one evaluation, so a return at the boundary is always inside
    edge = F.percentile("r", F.lit(0.05)).over(Window.partitionBy(key))
    tail = r.withColumn("__q", edge).where("r <= __q").groupBy(key).agg(F.avg("r").alias("__tail"))
    hac = mean_with_hac(r, key, "r", 5, 5).select(
        key, F.col("t_stat").alias("hac_mean_t_stat"), F.col("p_value").alias("hac_mean_p_value")
    )
    auto = lag_autocorrelation(r, key, "r").withColumnRenamed("autocorrelation", "autocorrelation_1")
    sr = F.when(F.col("__sd") > 0, F.col("__mean") / F.col("__sd"))
    spread = F.sqrt(
        F.greatest((1 - F.col("__skew") * sr + (F.col("__kurt") - 1) * sr * sr / 4) / F.col("observations"), F.lit(1e-16))
    )
    return (
        base.join(tail, key).join(hac, key).join(auto, key)
        .select(
            key,
            "observations",
            "annual_return",
            "arithmetic_annual_return",
            "annual_volatility",
            F.when(F.col("annual_volatility") > 0, F.col("arithmetic_annual_return") / F.col("annual_volatility")).alias("sharpe"),
            F.when(F.col("__down") > 0, F.col("annual_return") / F.col("__down")).alias("sortino"),
            F.when(F.col("max_drawdown") < 0, F.col("annual_return") / F.abs("max_drawdown")).alias("calmar"),
            "max_drawdown",
            (-F.col("__q05")).alias("daily_var_95_loss"),
            (-F.col("__tail")).alias("daily_cvar_95_loss"),
            "autocorrelation_1",
            "hac_mean_t_stat",
            "hac_mean_p_value",
            normal_cdf(sr / spread).alias("probabilistic_sharpe"),
            (F.col("__equity") - 1).alias("cumulative_return"),
        )
    )


def relative_statistics(df: DataFrame, benchmark: DataFrame, key: str = "strategy", value: str = "ret", periods: int = 252):
    """Alpha, beta, tracking error and information ratio on common dates."""
    b = benchmark.where("ret is not null").select("date", F.col("ret").alias("__b"))
    j = df.where(F.col(value).isNotNull()).join(b, "date").withColumn("__x", F.col(value) - F.col("__b"))
    g = j.groupBy(key).agg(
        F.covar_samp(value, "__b").alias("c"),
        F.var_samp("__b").alias("v"),
        F.avg(value).alias("m"),
        F.avg("__b").alias("mb"),
        (F.stddev_samp("__x") * float(periods) ** 0.5).alias("tracking_error"),
        (F.avg("__x") * periods).alias("excess"),
    )
    beta = safe_div("c", "v")
    return g.select(
        key,
        ((F.col("m") - beta * F.col("mb")) * periods).alias("alpha"),
        beta.alias("beta"),
        "tracking_error",
        F.when(F.col("tracking_error") > 0, F.col("excess") / F.col("tracking_error")).alias("information_ratio"),
    )


def _draw(seed: int, draw, block):
    """Pseudo-random integer of (seed, draw, block): three Park-Miller steps."""
    x = (F.lit(seed).cast("long") * 1000003 + draw.cast("long") * 10007 + block.cast("long") * 101 + 17) % LCG_MODULUS
    for _ in range(3):
        x = (x * LCG_MULTIPLIER) % LCG_MODULUS
    return x


def block_bootstrap(
    df: DataFrame, key: str = "strategy", value: str = "ret", *, samples: int = 500, seed: int = 7, scale: float = 252.0
) -> DataFrame:
    """95 % interval of the scaled mean from moving blocks of length max(2, floor(sqrt(n))).

    A block's sum is a difference of two prefix sums, so a draw looks up two values
    per block by equi join instead of copying the rows of its blocks.
    """
    w = Window.partitionBy(key).orderBy("date")  # one row per date
    r = df.where(F.col(value).isNotNull())
    prefix = r.select(
        key, F.row_number().over(w).cast("long").alias("pos"),
        F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cum"),
    )
    size = r.groupBy(key).agg(F.count(F.lit(1)).alias("n")).withColumn(
        "block", F.greatest(F.lit(2), F.floor(F.sqrt(F.col("n").cast("double")))).cast("long")
    )
    draws = (
        size.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(samples))))
        .withColumn("blocks", F.ceil(F.col("n") / F.col("block")).cast("long"))
        .withColumn("b", F.explode(F.sequence(F.lit(1).cast("long"), F.col("blocks"))))
        .withColumn("start", _draw(seed, F.col("draw"), F.col("b")) % F.greatest(F.lit(1), F.col("n") - F.col("block") + 1))
        .withColumn("len", F.when(F.col("b") < F.col("blocks"), F.col("block")).otherwise(F.col("n") - (F.col("blocks") - 1) * F.col("block")))
    )
    head = prefix.select(key, F.col("pos").alias("start"), F.col("cum").alias("before"))
    tail = prefix.select(key, F.col("pos").alias("stop"), F.col("cum").alias("upto"))
    sums = (
        draws.withColumn("stop", F.col("start") + F.col("len"))
        .join(tail, [key, "stop"])
        .join(head, [key, "start"], "left")
        .groupBy(key, "draw", "n")
        .agg((F.sum(F.col("upto") - F.coalesce("before", F.lit(0.0))) / F.col("n") * scale).alias("mean"))
    )
    return sums.groupBy(key).agg(
        F.percentile("mean", F.lit(0.025)).alias("ci_low"),
        F.percentile("mean", F.lit(0.975)).alias("ci_high"),
        F.count(F.lit(1)).alias("draws"),
    )


def method_comparison(gross: DataFrame, net: DataFrame, fallbacks: DataFrame, baseline: str, key: str = "strategy"):
    """Gross and net statistics per method next to the equal-weight row, best Sharpe first."""
    g = statistics(gross, key).join(
        gross.groupBy(key).agg(F.sum("turnover").alias("turnover")), key
    )
    n = statistics(net, key).select(key, F.col("annual_return").alias("net_annual_return"), F.col("sharpe").alias("net_sharpe"))
    base = g.where(F.col(key) == baseline).select(F.lit(1).alias("__k"), F.col("sharpe").alias("__base"))
    return (
        g.join(n, key).join(fallbacks, key, "left").withColumn("__k", F.lit(1)).join(base, "__k", "left")
        .select(
            key, "annual_return", "annual_volatility", "sharpe", "max_drawdown", "cumulative_return", "turnover",
            "net_annual_return", "net_sharpe",
            (F.col("annual_return") - F.col("net_annual_return")).alias("cost_drag"),
            (F.col("sharpe") - F.col("__base")).alias("sharpe_vs_equal"),
            F.coalesce("fallbacks", F.lit(0).cast("long")).alias("fallbacks"),
        )
        .orderBy(F.desc("sharpe"))
    )
