"""Box-and-budget allocations in factor form, for portfolios of any width.

The covariance ``B O B' + D`` is never formed.  With one multiplier for each factor exposure and one for the budget the
weights fall apart into one clipped ratio per name, so a round is an aggregate over names: factor sums of the weights
and of the names that lie inside their bounds.  A Newton step on the few multipliers follows, on one row per portfolio.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import scratch_table
from .allocation import OBJECTIVES, filled_specific

#: Names of a block; rounds at most; largest miss of budget and factor sums at the end.
BLOCK, ROUNDS, TOLERANCE = 4096, 120, 1e-9
#: Shares of the full curvature that are added to that of the names inside their bounds: from a plain Newton step to one that can't overshoot.
BLENDS = (1e-12, 1e-3, 1e-2, 0.1, 0.4, 1.0)
#: Smallest specific variance: a name without any is given this much.
LEAST_VARIANCE = 1e-10
#: Risk price, as a share of forecast over variance, below which a ratio without a positive numerator is given up.
LEAST_PRICE = 1e-6

_POINT = "struct<y: array<double>, tau: double>"
_TASK = f"struct<objective: string, status: string, lam: double, y: array<double>, tau: double, curvature: array<double>, bracket: array<double>, points: array<{_POINT}>>"


def residual_factors(returns: DataFrame, names: DataFrame, *, by: Sequence[str], shrinkage: float, ticker: str = "ticker") -> tuple[DataFrame, DataFrame]:
    """Correlated residual risk ``(1 - s) * corr o (sigma sigma')`` as exposures to one factor a date, with their unit covariance.

    ``returns(ticker, date, ret)`` holds the dates of the correlation only; a missing return counts as the mean of its series, and
    ``names(by, ticker, residual_volatility)``.  With these factors the specific variances count ``s`` times.
    """
    stats = returns.groupBy(ticker).agg(F.avg("ret").alias("__m"), F.stddev_samp("ret").alias("__s"), F.count("ret").alias("__n")).where("__s > 0")
    scale = F.sqrt((F.lit(1.0) - shrinkage) / (F.col("__n") - 1))
    z = returns.where("ret is not null").join(stats, ticker).select(ticker, F.concat(F.lit("residual "), F.col("date").cast("string")).alias("factor"), ((F.col("ret") - F.col("__m")) / F.col("__s") * scale).alias("__z"))
    exposures = names.select(*by, ticker, "residual_volatility").join(z, ticker).select(*by, ticker, "factor", (F.col("residual_volatility") * F.col("__z")).alias("beta"))
    unit = z.select(F.col("factor").alias("row")).distinct().select("row", F.col("row").alias("col"), F.lit(1.0).alias("value"))
    return exposures, unit


class _Sums:
    """Sums over names at one point: weights, their factor sums, and the curvature of the names inside their bounds."""

    def __init__(self, k: int, values: np.ndarray | None = None):
        self.k = k
        self.v = np.zeros(7 + 3 * k + k * k) if values is None else values

    weight = property(lambda s: s.v[0])
    inside = property(lambda s: s.v[1])
    forecast = property(lambda s: s.v[2])
    specific = property(lambda s: s.v[3])
    value = property(lambda s: s.v[4])
    scale = property(lambda s: s.v[5])
    bent = property(lambda s: s.v[6])
    betas = property(lambda s: s.v[7 : 7 + s.k])
    cross = property(lambda s: s.v[7 + s.k : 7 + 2 * s.k])
    bent_betas = property(lambda s: s.v[7 + 2 * s.k : 7 + 3 * s.k])
    gram = property(lambda s: s.v[7 + 3 * s.k :].reshape(s.k, s.k))


class _Block:
    """Names of one portfolio as arrays."""

    def __init__(self, row: dict, omega: np.ndarray):
        self.b = np.asarray(row["b"], dtype=np.float64).reshape(-1, len(omega))
        self.d, self.mu, self.low, self.high = (np.asarray(row[c], dtype=np.float64) for c in ("d", "mu", "low", "high"))
        self.sigma = np.sqrt(np.einsum("ij,jk,ik->i", self.b, omega, self.b) + self.d)
        self.omega = omega

    def forecast(self, objective: str) -> np.ndarray:
        return {"min_variance": np.zeros_like(self.mu), "max_diversification": self.sigma}.get(objective, self.mu)

    def weights(self, task: dict, point: dict) -> tuple[np.ndarray, np.ndarray]:
        """Weights at a point and the gain of each name net of factor and budget prices."""
        gain = self.forecast(task["objective"]) - task["lam"] * (self.b @ (self.omega @ np.array(point["y"]))) - point["tau"]
        return np.clip(gain / (task["lam"] * self.d), self.low, self.high), gain

    def sums(self, task: dict, point: dict) -> np.ndarray:
        w, gain = self.weights(task, point)
        bend = 1 / (task["lam"] * self.d)
        inside = np.where((w > self.low) & (w < self.high), bend, 0.0)
        mu = self.forecast(task["objective"])
        return np.concatenate([
            [w.sum(), inside.sum(), mu @ w, self.d @ (w * w), (task["lam"] / 2 * self.d * w * w - gain * w).sum(), bend.sum(), mu @ inside],
            self.b.T @ w, self.b.T @ inside, self.b.T @ (mu * inside), ((self.b * inside[:, None]).T @ self.b).ravel(),
        ])

    def start(self, task: dict, n: int) -> np.ndarray:
        """Sums at equal weights, and those of all names as if inside their bounds at a risk price of 1."""
        mu, w, bend = self.forecast(task["objective"]), np.full(len(self.d), 1.0 / n), 1 / self.d
        return np.concatenate([
            [w.sum(), bend.sum(), mu @ w, self.d @ (w * w), 0.0, bend.sum(), mu @ bend],
            self.b.T @ w, self.b.T @ bend, np.zeros(len(self.omega)), ((self.b * bend[:, None]).T @ self.b).ravel(),
        ])


def _direction(s: _Sums, omega: np.ndarray, task: dict, point: dict, lam: float, blend: float) -> tuple[np.ndarray, float]:
    """Newton step of the multipliers towards the solution at risk price ``lam``, where it may differ from the task's.

    ``blend`` of the curvature of all names is added to that of the names inside their bounds; all of it bounds the dual's
    curvature everywhere, so that step never overshoots.
    """
    k, old, y, tau = s.k, task["lam"], np.array(point["y"]), point["tau"]
    every = _Sums(k, np.array(task["curvature"]))
    gram, cross, inside = (old * own + blend * whole for own, whole in ((s.gram, every.gram), (s.cross, every.cross), (s.inside, every.inside)))
    jac = np.empty((k + 1, k + 1))
    jac[:k, :k] = np.eye(k) + gram @ omega
    jac[:k, k] = cross / lam
    jac[k, :k] = cross @ omega
    jac[k, k] = inside / lam
    miss = np.append(s.betas - y, s.weight - 1)
    # names inside their bounds follow the price of risk
    miss -= (lam - old) / lam * np.append(s.bent_betas - tau * s.cross, s.bent - tau * s.inside)
    step = np.linalg.solve(jac, miss)
    return step[:k], float(step[k])


def _points(s: _Sums, omega: np.ndarray, task: dict, point: dict, lam: float) -> list[dict]:
    out = []
    for blend in BLENDS:
        dy, dt = _direction(s, omega, task, point, lam, blend)
        out.append({"y": (np.array(point["y"]) + dy).tolist(), "tau": point["tau"] + dt})
    return out


def _next_price(bracket: list[float], lam: float, gap: float) -> tuple[float, list[float]]:
    """The next risk price, and the bracket (low, high, gap at low, gap at high, side that moved last), nan where unknown.

    The gap falls through zero. Until it is bracketed the price moves to where a better ratio is certain (or down, without any excess); then by
    false position, where the gap of an end that stays twice is halved.
    """
    low, high, low_gap, high_gap, side = bracket or [np.nan] * 5
    far = 4 if side == np.sign(gap) else 1  # again on the same side: reach beyond, for a bracket
    if gap > 0:
        low, low_gap, high_gap, side = lam, gap, high_gap / (2 if side > 0 else 1), 1.0
    else:
        high, high_gap, low_gap, side = lam, gap, low_gap / (2 if side < 0 else 1), -1.0
    if np.isnan(low):
        return max(lam + far * gap, lam / 4), [low, high, low_gap, high_gap, side]
    if np.isnan(high):
        return lam + far * gap, [low, high, low_gap, high_gap, side]
    return (low * high_gap - high * low_gap) / (high_gap - low_gap), [low, high, low_gap, high_gap, side]


def _advance(task: dict, sums: list[_Sums], omega: np.ndarray, risk_free: float, tolerance: float) -> dict:
    """Take the best of the points tried; either the portfolio is solved, its risk price moves, or new points are laid out."""
    lam, k = task["lam"], len(omega)
    if task["status"] == "start":
        s = sums[0]
        variance = float(s.betas @ omega @ s.betas) + s.specific
        if task["objective"] in ("max_sharpe", "max_diversification"):
            excess = s.forecast - (risk_free if task["objective"] == "max_sharpe" else 0.0)
            lam = max(excess, abs(s.forecast), abs(s.forecast - excess), 1e-9) / max(variance, 1e-16)  # rather high: easy to solve, and lowered from there
        tau = (s.bent - lam) / s.scale
        return task | {"status": "open", "lam": lam, "y": [0.0] * k, "tau": tau, "curvature": s.v.tolist(), "points": [{"y": [0.0] * k, "tau": tau}]}

    misses = [max(np.abs(s.betas - np.array(p["y"])).max(initial=0.0), abs(s.weight - 1)) for p, s in zip(task["points"], sums)]
    duals = [-lam / 2 * float(np.array(p["y"]) @ omega @ np.array(p["y"])) + s.value - p["tau"] for p, s in zip(task["points"], sums)]
    top = max(duals)
    # close to the optimum rounding hides which dual value is larger; the smaller miss decides there
    best = min((i for i, d in enumerate(duals) if d >= top - 1e-11 * (1 + abs(top))), key=misses.__getitem__)
    point, s, miss = task["points"][best], sums[best], misses[best]
    task = task | {"y": point["y"], "tau": point["tau"]}
    if task["objective"] not in ("max_sharpe", "max_diversification"):
        if miss < tolerance:
            return task | {"status": "succeeded", "points": []}
    # a ratio is largest where the risk price equals excess over variance; inner solves need only be as good as the gap
    elif miss < max(tolerance, 1e-3 * min([1.0, *(abs(g) / lam for g in task["bracket"][2:4])])):
        excess = s.forecast - (risk_free if task["objective"] == "max_sharpe" else 0.0)
        variance = float(s.betas @ omega @ s.betas) + s.specific
        gap = excess / variance - lam
        if excess <= 0 and lam < LEAST_PRICE * max(abs(s.forecast), 1e-12) / variance:
            return task | {"status": "fallback_equal", "points": []}
        if abs(gap) <= 1e-8 * lam and miss < tolerance:
            return task | {"status": "succeeded", "points": []}
        if abs(gap) > 1e-8 * lam:
            new, bracket = _next_price(task["bracket"], lam, gap)
            return task | {"lam": new, "bracket": bracket, "points": _points(s, omega, task, point, new)}
    return task | {"points": _points(s, omega, task, point, lam)}


def factor_allocation(
    names: DataFrame,
    exposures: DataFrame,
    omega: DataFrame,
    *,
    by: Sequence[str],
    objectives: Sequence[str] = OBJECTIVES,
    risk_aversion: float = 1.0,
    risk_free_rate: float = 0.0,
    specific_share: float = 1.0,
    rounds: int = ROUNDS,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """(by, objective, ticker, optimized_weight, status): optimal weights inside the bounds that add up to 1.

    ``names(by, ticker, expected_return, lower, upper, residual_volatility)``, ``exposures(by, ticker, factor, beta)`` and
    ``omega(row, col, value)``; a missing beta or forecast counts as 0, a missing residual volatility as the portfolio's
    median, and ``specific_share`` scales the specific variances.  Objectives are those of :data:`OBJECTIVES`.
    Portfolios whose bounds leave no room for a budget of 1, ratios without a positive numerator and solves that miss
    ``tolerance`` after ``rounds`` keep equal weights under ``fallback_equal``.

    Names are dealt into blocks once.  A round reads all blocks, adds up K * K sums per portfolio, objective and step
    length inside each task, and meets one row per portfolio again; its multipliers are written to the shared folder.
    Nothing grows with the square of the names, and no task holds a portfolio.
    """
    by = list(by)
    unknown = set(objectives) - set(OBJECTIVES)
    if unknown:
        raise ValueError(f"unknown objectives: {sorted(unknown)}")
    if risk_aversion <= 0:
        raise ValueError("the risk aversion must be positive")
    known = filled_specific(names.select(*by, "ticker", "expected_return", "lower", "upper", "residual_volatility"), by)
    catalog = omega.agg(F.array_sort(F.collect_set("row")).alias("__f"), F.map_from_entries(F.collect_list(F.struct(F.struct("row", "col").alias("k"), "value"))).alias("__o"))
    catalog = catalog.select("__f", F.flatten(F.transform("__f", lambda r: F.transform("__f", lambda c: F.coalesce(F.try_element_at("__o", F.struct(r.alias("row"), c.alias("col"))), F.lit(0.0))))).alias("omega"), F.lit(1).alias("__k"))
    catalog = scratch_table(catalog, "catalog")  # one row: the factors of the model
    betas = exposures.groupBy(*by, "ticker").agg(F.map_from_entries(F.collect_list(F.struct("factor", "beta"))).alias("__b"))
    own = F.col("residual_volatility") * F.col("residual_volatility") * specific_share
    rows = known.join(betas, [*by, "ticker"], "left").withColumn("__k", F.lit(1)).join(catalog.select("__f", "__k"), "__k").select(
        *by, "ticker", F.transform("__f", lambda f: F.coalesce(F.try_element_at("__b", f), F.lit(0.0))).alias("b"),
        F.greatest(F.coalesce(own, F.lit(0.0)), F.lit(LEAST_VARIANCE)).alias("d"), F.coalesce("expected_return", F.lit(0.0)).alias("mu"), F.col("lower").alias("low"), F.col("upper").alias("high"))
    sizes = scratch_table(known.groupBy(*by).agg(F.count("*").alias("n"), F.sum("lower").alias("floor"), F.sum("upper").alias("ceiling"), F.bool_and(F.col("lower") <= F.col("upper")).alias("ordered")), "portfolio-sizes")
    dealt = rows.join(sizes.select(*by, "n"), by).withColumn("block", F.pmod(F.xxhash64("ticker"), F.ceil(F.col("n") / BLOCK)).cast("int"))
    part = lambda c: F.transform("__r", lambda x: x[c])
    blocks = dealt.groupBy(*by, "n", "block").agg(F.collect_list(F.struct("ticker", "b", "d", "mu", "low", "high")).alias("__r")).select(
        *by, "n", part("ticker").alias("ticker"), F.flatten(part("b")).alias("b"), *[part(c).alias(c) for c in ("d", "mu", "low", "high")])
    blocks = scratch_table(blocks, "name-blocks")

    feasible = F.col("ordered") & (F.col("floor") <= 1 + 1e-9) & (F.col("ceiling") >= 1 - 1e-9)
    blank = [F.struct(
        F.lit(o).alias("objective"), F.when(feasible, F.lit("start")).otherwise(F.lit("fallback_equal")).alias("status"), F.lit(float(risk_aversion) if o == "mean_variance" else 1.0).alias("lam"),
        F.array().cast("array<double>").alias("y"), F.lit(0.0).alias("tau"), F.array().cast("array<double>").alias("curvature"), F.array().cast("array<double>").alias("bracket"),
        F.array(F.struct(F.array().cast("array<double>").alias("y"), F.lit(0.0).alias("tau"))).alias("points")).cast(_TASK) for o in objectives]
    state = sizes.withColumn("tasks", F.array(*blank)).withColumn("__k", F.lit(1)).join(catalog.select("omega", "__k"), "__k").select(*by, "omega", "tasks")
    state = scratch_table(state, "multipliers")
    ids = ", ".join(f"`{c}` {names.schema[c].dataType.simpleString()}" for c in by)
    state_schema = to_arrow_schema(state.schema)

    def open_tasks(row: dict) -> Iterator[tuple[int, dict]]:
        return ((i, t) for i, t in enumerate(row["tasks"]) if t["status"] in ("start", "open"))

    def add_up(batches):
        held: dict[tuple, np.ndarray] = {}

        def packed():
            rows = [dict(zip(by, key[: len(by)])) | {"task": key[-2], "point": key[-1], "sums": v.tolist()} for key, v in held.items()]
            held.clear()
            return pa.RecordBatch.from_pylist(rows, schema=pa.schema([state_schema.field(c) for c in by] + [("task", pa.int32()), ("point", pa.int32()), ("sums", pa.list_(pa.float64()))]))

        for batch in batches:
            for row in batch.to_pylist():
                k = int(round(len(row["omega"]) ** 0.5))
                block = _Block(row, np.array(row["omega"]).reshape(k, k))
                for i, t in open_tasks(row):
                    for p, point in enumerate(t["points"]):
                        key = (*(row[c] for c in by), i, p)
                        found = block.start(t, row["n"]) if t["status"] == "start" else block.sums(t, point)
                        held[key] = held[key] + found if key in held else found
                if len(held) > 2000:
                    yield packed()
        if held:
            yield packed()

    def step(key: tuple, state: pa.Table, sums: pa.Table) -> pa.Table:
        out = state.to_pylist()
        total: dict[tuple[int, int], np.ndarray] = {}
        for r in sums.to_pylist():
            at = (r["task"], r["point"])
            total[at] = total[at] + np.array(r["sums"]) if at in total else np.array(r["sums"])
        for row in out:
            k = int(round(len(row["omega"]) ** 0.5))
            om = np.array(row["omega"]).reshape(k, k)
            for i, t in list(open_tasks(row)):
                row["tasks"][i] = _advance(t, [_Sums(k, total[i, p]) for p in range(len(t["points"]))], om, risk_free_rate, tolerance)
        return pa.Table.from_pylist(out, schema=state_schema)

    unsolved = "exists(tasks, t -> t.status in ('start', 'open'))"
    for _ in range(rounds):
        going = state.where(unsolved)
        if going.isEmpty():
            break
        sums = blocks.join(going, by).mapInArrow(add_up, f"{ids}, task int, point int, sums array<double>")
        moved = going.groupBy(*by).cogroup(sums.groupBy(*by)).applyInArrow(step, state.schema)
        state = scratch_table(moved.unionByName(state.where(f"not {unsolved}")), "multipliers")

    def weigh(batches):
        for batch in batches:
            for row in batch.to_pylist():
                k = int(round(len(row["omega"]) ** 0.5))
                block = _Block(row, np.array(row["omega"]).reshape(k, k))
                for t in row["tasks"]:
                    solved = t["status"] == "succeeded"
                    w = block.weights(t, t)[0] if solved else np.full(len(block.d), 1.0 / row["n"])
                    rows = [{c: row[c] for c in by} | {"objective": t["objective"], "ticker": name, "optimized_weight": float(x), "status": "succeeded" if solved else "fallback_equal"} for name, x in zip(row["ticker"], w)]
                    yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([state_schema.field(c) for c in by] + [("objective", pa.string()), ("ticker", pa.string()), ("optimized_weight", pa.float64()), ("status", pa.string())]))

    return blocks.join(state, by).mapInArrow(weigh, f"{ids}, objective string, ticker string, optimized_weight double, status string")
