"""Rebalance replay in closed form.

Between two executions holdings drift freely, so the value of name i is its target
weight times the compounded return since the execution.  Daily portfolio returns are
ratios of summed values and turnover compares targets with drifted weights: products,
sums and lags, with no loop over days.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .calendar import next_trading_day, per_date
from .returns import cumulative_index, drawdown


def month_end_decisions(holdings: DataFrame, calendar: DataFrame, strategy: str = "strategy") -> DataFrame:
    """Fixed holdings, equal weight, one decision per month end."""
    ends = calendar.where("is_month_end").select(F.col("date").alias("signal_date"))
    packed = ends.agg(F.array_sort(F.collect_list("signal_date")).alias("__d")).withColumn("__k", F.lit(1))
    return (
        holdings.select(F.col(strategy).alias("strategy"), "ticker").withColumn("__k", F.lit(1)).join(packed, "__k")
        .select("strategy", F.explode("__d").alias("signal_date"), "ticker", F.lit(None).cast("double").alias("weight"))
    )


def schedule(decisions: DataFrame, calendar: DataFrame, tickers: DataFrame, *, first_idx: int = 0) -> DataFrame:
    """Executable target weights (strategy, signal_date, execution_date, exec_idx, end_idx, ticker, weight).

    Execution is the trading day after the signal.  Names without any price are left
    out; given weights are normalised over the rest, otherwise weights are equal.  Of
    several signals with one execution day the newest counts.  Executions
    before calendar position ``first_idx`` (warm-up) are ignored.
    """
    known = decisions.join(tickers.select("ticker").distinct(), "ticker", "left_semi")
    placed = next_trading_day(known, calendar).where(F.col("exec_idx").isNotNull() & (F.col("exec_idx") > first_idx))
    keys = ["strategy", "exec_idx"]
    newest = placed.groupBy(*keys).agg(F.max("signal_date").alias("signal_date"))
    placed = placed.join(newest, [*keys, "signal_date"], "left_semi")
    sums = placed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"), F.count("weight").alias("__given"), F.sum("weight").alias("__w")
    )
    # A decision whose given weights do not add up to something positive cannot be executed.
    sums = sums.where((F.col("__given") == 0) | (F.col("__w") > 0))
    last = calendar.groupBy(F.lit(1).alias("__k")).agg(F.max("idx").alias("__last"))
    spans = (
        sums.withColumn("__k", F.lit(1))
        .join(last, "__k")
        .withColumn(
            "end_idx",
            F.coalesce(F.lead("exec_idx").over(Window.partitionBy("strategy").orderBy("exec_idx")) - 1, F.col("__last")),
        )
        .drop("__k", "__last")
    )
    weight = F.when(F.col("__given") > 0, F.coalesce("weight", F.lit(0.0)) / F.col("__w")).otherwise(1.0 / F.col("__n"))
    return placed.join(spans, keys).select(
        "strategy", "signal_date", "execution_date", "exec_idx", "end_idx", "ticker", weight.alias("weight")
    )


def holding_values(targets: DataFrame, returns: DataFrame) -> DataFrame:
    """Drifting value of each held name per day, starting from its target weight.

    One equi join with the returns on (ticker, idx); missing returns count as 0.
    """
    days = targets.withColumn("idx", F.explode(F.sequence("exec_idx", "end_idx")))
    r = returns.where("ret is not null").select("ticker", "idx", "ret")
    w = Window.partitionBy("strategy", "exec_idx", "ticker").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return days.join(r, ["ticker", "idx"], "left").withColumn(
        "value", F.col("weight") * F.product(1 + F.coalesce("ret", F.lit(0.0))).over(w)
    )


def rebalance_turnover(targets: DataFrame, values: DataFrame, cost_bps: float = 0.0) -> DataFrame:
    """(strategy, exec_idx, turnover, cost): two-sided change against the drifted weights."""
    ends = values.where("idx = end_idx")
    total = ends.groupBy("strategy", "exec_idx").agg(F.sum("value").alias("__v"))
    nxt = targets.select("strategy", "exec_idx").distinct()
    drifted = (
        ends.join(total, ["strategy", "exec_idx"])
        .select("strategy", (F.col("end_idx") + 1).alias("exec_idx"), "ticker", F.try_divide(-F.col("value"), F.col("__v")).alias("d"))
        .join(nxt, ["strategy", "exec_idx"], "left_semi")
    )
    change = (
        targets.select("strategy", "exec_idx", "ticker", F.col("weight").alias("d"))
        .unionByName(drifted)
        .groupBy("strategy", "exec_idx", "ticker")
        .agg(F.abs(F.sum("d")).alias("d"))
    )
    return (
        change.groupBy("strategy", "exec_idx")
        .agg(F.sum("d").alias("turnover"))
        .withColumn("cost", F.col("turnover") * (cost_bps / 10000.0))
    )


def replay(
    decisions: DataFrame,
    returns: DataFrame,
    calendar: DataFrame,
    *,
    cost_bps: float = 0.0,
    estimation_window: int | None = None,
) -> DataFrame:
    """Daily (strategy, date, idx, gross, turnover, cost, ret).

    ``estimation_window`` keeps the first rows for warm-up: no execution before it, and
    the path starts there with returns of 0 until the first trade.
    """
    first = estimation_window or 0
    targets = schedule(decisions, calendar, returns, first_idx=first)
    values = holding_values(targets, returns)
    daily = values.groupBy("strategy", "exec_idx", "idx").agg(F.sum("value").alias("v"))
    w = Window.partitionBy("strategy", "exec_idx").orderBy("idx")
    gross = daily.withColumn("gross", F.try_divide(F.col("v"), F.coalesce(F.lag("v").over(w), F.lit(1.0))) - 1)
    trades = rebalance_turnover(targets, values, cost_bps)
    path = gross.join(trades.withColumn("idx", F.col("exec_idx")).drop("exec_idx"), ["strategy", "idx"], "left")
    path = path.drop("exec_idx", "v")
    if estimation_window:
        starts = path.groupBy("strategy").agg(F.min("idx").alias("__f"))
        lead_in = starts.where(F.col("__f") > first + 1).select(
            "strategy", F.explode(F.sequence(F.lit(first + 1).cast("long"), F.col("__f") - 1)).alias("idx")
        )
        path = path.unionByName(lead_in, allowMissingColumns=True)
    path = path.fillna(0.0, ["gross", "turnover", "cost"])
    return path.join(per_date(calendar.select("idx", "date")), "idx").withColumn("ret", F.col("gross") - F.col("cost"))


def with_equity(path: DataFrame, key: str = "strategy") -> DataFrame:
    """Add equity and drawdown of the net returns."""
    return drawdown(cumulative_index(path, key, "ret", "equity"), key)


def cost_grid(decisions: DataFrame, returns: DataFrame, calendar: DataFrame, costs: Sequence[float], **kw) -> DataFrame:
    """Net path per cost scenario; the gross path is computed once."""
    gross = replay(decisions, returns, calendar, **kw)
    return (
        gross.withColumn("cost_bps", F.explode(F.array(*[F.lit(float(c)) for c in costs])))
        .withColumn("cost", F.col("turnover") * F.col("cost_bps") / 10000.0)
        .withColumn("ret", F.col("gross") - F.col("cost"))
    )


def benchmark_path(path: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Replay dates with the benchmark's return, equity and drawdown beside the strategy's."""
    b = benchmark.select("date", F.col("ret").alias("benchmark_return"))
    both = with_equity(path).join(b, "date", "left").withColumn("benchmark_return", F.coalesce("benchmark_return", F.lit(0.0)))
    both = cumulative_index(both, "strategy", "benchmark_return", "benchmark_equity")
    return drawdown(both, "strategy", "benchmark_equity", "benchmark_drawdown")


def merge_paths(left: DataFrame, right: DataFrame, left_name: str, right_name: str) -> DataFrame:
    """Two replay paths on their common dates."""
    pick = lambda df, n: df.select("date", F.col("equity").alias(f"{n}_equity"), F.col("drawdown").alias(f"{n}_drawdown"))
    return pick(left, left_name).join(pick(right, right_name), "date")


def random_names(tickers: DataFrame, n: int, seed: int = 7) -> DataFrame:
    """Reproducible choice of ``n`` names: order by a seeded digest (a top-n, not a sort)."""
    return (
        tickers.select("ticker").distinct()
        .withColumn("__h", F.md5(F.concat(F.lit(f"{seed}:"), F.col("ticker"))))
        .orderBy("__h", "ticker").limit(n).drop("__h")
    )


def rebalance_audit(targets: DataFrame, trades: DataFrame) -> DataFrame:
    """One row per execution: positive holdings as a map, turnover and cost."""
    held = targets.where("weight > 0").groupBy("strategy", "signal_date", "execution_date", "exec_idx").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("ticker", "weight")))).alias("holdings"),
        F.count(F.lit(1)).alias("names"),
    )
    return held.join(trades, ["strategy", "exec_idx"])


def decision_turnover(weights: DataFrame, returns: DataFrame, calendar: DataFrame, *, by: str = "portfolio", on: str = "period") -> DataFrame:
    """(by, on, execution_date, names, turnover): what each decision trades against the drifted weights of the one before.

    ``weights(by, on, ticker, weight)`` are the decisions; those without a later trading day are left out.
    """
    asked = weights.select(F.col(by).alias("strategy"), F.col(on).alias("signal_date"), "ticker", F.col("weight").cast("double").alias("weight"))
    targets = schedule(asked, calendar, returns)
    trades = rebalance_turnover(targets, holding_values(targets, returns))
    held = targets.groupBy("strategy", "exec_idx", "signal_date", "execution_date").agg(F.count_if(F.col("weight") > 0).alias("names"))
    return held.join(trades, ["strategy", "exec_idx"]).select(F.col("strategy").alias(by), F.col("signal_date").alias(on), "execution_date", "names", "turnover")
