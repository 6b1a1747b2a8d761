"""Allocations in factor form, the fit store, keyed streams, dated limits and one-pass audits on small tables."""

import datetime as dt
import glob
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelloom.functions.kernels import allocate
from panelloom.operators import allocation, factor_allocation, refit, risk
from panelloom.operators.calendar import month_ends, trading_calendar
from panelloom.operators.exposures import exposure_grid
from panelloom.operators.returns import simple_returns
from panelloom.plans import factor_model
from panelloom.streaming import keyed

D = dt.date


def portfolios(spark, sizes, seed=1, k=4, high=0.3):
    rng = np.random.default_rng(seed)
    names, betas, groups = [], [], {}
    om = rng.normal(size=(k, k))
    om = om @ om.T * 0.02
    for p, n in sizes.items():
        b, s, mu = rng.normal(size=(n, k)), rng.uniform(0.1, 0.4, n), rng.normal(0.06, 0.04, n)
        top = max(high, 1.5 / n)
        groups[p] = b @ om @ b.T + np.diag(s * s), mu, top
        names += [(p, f"n{i:05d}", float(mu[i]), 0.0, top, float(s[i])) for i in range(n)]
        betas += [(p, f"n{i:05d}", f"f{j}", float(b[i, j])) for i in range(n) for j in range(k)]
    names = spark.createDataFrame(names, "portfolio string, ticker string, expected_return double, lower double, upper double, residual_volatility double")
    betas = spark.createDataFrame(betas, "portfolio string, ticker string, factor string, beta double")
    omega = spark.createDataFrame([(f"f{i}", f"f{j}", float(om[i, j])) for i in range(k) for j in range(k)], "row string, col string, value double")
    return names, betas, omega, groups


def test_factor_form_equals_the_dense_solver(spark, monkeypatch):
    monkeypatch.setattr(factor_allocation, "BLOCK", 7)  # every portfolio lies in several blocks
    names, betas, omega, groups = portfolios(spark, {"a": 12, "b": 30})
    tight = names.where("portfolio = 'a'").withColumns({"portfolio": F.lit("tight"), "upper": F.lit(0.01)})
    out = factor_allocation.factor_allocation(names.unionByName(tight), betas, omega, by=["portfolio"], risk_free_rate=0.01).toPandas()
    for (p, objective), g in out.groupby(["portfolio", "objective"]):
        w = g.sort_values("ticker")["optimized_weight"].to_numpy()
        if p == "tight":
            assert set(g["status"]) == {"fallback_equal"} and np.allclose(w, 1 / len(w))
            continue
        cov, mu, top = groups[p]
        want, ok = allocate(cov, mu, np.zeros(len(mu)), np.full(len(mu), top), objective, 1.0, 0.01)
        assert ok and set(g["status"]) == {"succeeded"}
        assert np.abs(w - want).max() < 1e-5 and abs(w.sum() - 1) < 1e-8


def test_wide_portfolio_meets_first_order_conditions(spark):
    names, betas, omega, groups = portfolios(spark, {"wide": 5000}, high=0.002)
    out = factor_allocation.factor_allocation(names, betas, omega, by=["portfolio"], objectives=["min_variance"]).toPandas().sort_values("ticker")
    w = out["optimized_weight"].to_numpy()
    slope = groups["wide"][0] @ w
    assert set(out["status"]) == {"succeeded"} and abs(w.sum() - 1) < 1e-8 and w.min() >= 0 and w.max() <= 0.002 + 1e-12
    assert slope[w > 1e-9].max() <= slope[w < 0.002 - 1e-9].min() + 1e-6 * np.abs(slope).max()


def test_hard_solves_end_in_few_rounds():
    rng = np.random.default_rng(7)
    for trial in range(40):
        n, k = int(rng.integers(8, 50)), 5
        b, m = rng.normal(size=(n, k)) * rng.choice([0.1, 1, 3]), rng.normal(size=(k, k))
        om, d, mu = m @ m.T * rng.choice([0.0, 0.02, 5]), rng.uniform(0.001, 0.3, n), rng.normal(0.03, 0.03, n)
        block = factor_allocation._Block({"b": b.ravel(), "d": d, "mu": mu, "low": np.zeros(n), "high": np.full(n, 0.15)}, om)
        for objective in allocation.OBJECTIVES[:2]:
            task = {"objective": objective, "status": "start", "lam": 1.0, "y": [], "tau": 0.0, "curvature": [], "bracket": [], "points": [{"y": [], "tau": 0.0}]}
            for _ in range(factor_allocation.ROUNDS):
                sums = [factor_allocation._Sums(k, block.start(task, n) if task["status"] == "start" else block.sums(task, p)) for p in task["points"]]
                task = factor_allocation._advance(task, sums, om, 0.0, 1e-9)
                if task["status"] == "succeeded":
                    break
            assert task["status"] == "succeeded", (trial, objective)


def test_residual_factors_rebuild_the_mixed_covariance(spark):
    rng = np.random.default_rng(2)
    r = rng.normal(size=(20, 3))
    returns = spark.createDataFrame([(f"n{j}", D(2020, 1, 1 + i), float(r[i, j])) for i in range(20) for j in range(3)], "ticker string, date date, ret double")
    sigma = np.array([0.1, 0.2, 0.4])
    names = spark.createDataFrame([("p", f"n{j}", float(sigma[j])) for j in range(3)], "portfolio string, ticker string, residual_volatility double")
    e, unit = factor_allocation.residual_factors(returns, names, by=["portfolio"], shrinkage=0.8)
    wide = e.toPandas().pivot(index="ticker", columns="factor", values="beta").to_numpy()
    assert unit.count() == 20
    assert np.allclose(wide @ wide.T, 0.2 * np.corrcoef(r.T) * np.outer(sigma, sigma))


def fit_inputs(spark):
    rng = np.random.default_rng(3)
    days = [D(2020, 1, 1) + dt.timedelta(days=i) for i in range(300)]
    prices = [(t, d, float(v)) for t in ("S1", "S2") for d, v in zip(days, 100 * np.cumprod(1 + rng.normal(0, 0.01, len(days))))]
    panel = [(f, d, float(rng.normal(0, 0.01))) for f in ("A", "B", "C") for d in days]
    book = spark.createDataFrame(prices, "ticker string, date date, close double")
    cal = trading_calendar(book)
    return simple_returns(book, cal), spark.createDataFrame(panel, "factor string, date date, ret double"), cal


def test_only_affected_partitions_are_written_again(spark, tmp_path, monkeypatch):
    returns, panel, cal = fit_inputs(spark)
    levels, opts = {"ab": ["A", "B"], "c": ["C"]}, dict(window=40, minimum=20, selection_mode="fixed")
    root = str(tmp_path / "store")
    old = panel.where("date < '2020-10-01'").withColumn("ret", F.when((F.col("factor") == "A") & (F.col("date") == "2020-05-10"), 0.5).otherwise(F.col("ret")))
    first = refit.update_fit_store(root, old, returns, cal, month_ends(cal), levels, **opts).first()
    assert first["mode"] == "full"
    files = lambda: {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{root}/fits/*/*/*.parquet")}
    before = files()

    corrected = old.withColumn("ret", F.when((F.col("factor") == "A") & (F.col("date") == "2020-05-10"), 0.01).otherwise(F.col("ret")))
    whole = refit._overwrite

    def dies(df, path, parts):
        if path.endswith("/panel"):
            raise OSError("lost")
        whole(df, path, parts)

    monkeypatch.setattr(refit, "_overwrite", dies)
    with pytest.raises(OSError):  # fits are written, the panel is not
        refit.update_fit_store(root, corrected, returns, cal, month_ends(cal), levels, **opts)
    monkeypatch.setattr(refit, "_overwrite", whole)
    summary = refit.update_fit_store(root, corrected, returns, cal, month_ends(cal), levels, **opts).first()
    assert (summary["mode"], summary["changed_observations"]) == ("correction", 1)
    after = files()
    kept = {p for p in before if after.get(p) == before[p]}
    assert all("level=ab" in p and "2020-05" <= p.split("period=")[1][:7] <= "2020-08" for p in before if p not in kept) and len(kept) < len(before)

    refit.update_fit_store(root, panel, returns, cal, month_ends(cal), levels, **opts)  # and the rest of the year is appended
    assert refit.update_fit_store(root, panel, returns, cal, month_ends(cal), levels, **opts).first()["mode"] == "unchanged"
    columns = ["ticker", "level", "period", "observation_count", "adjusted_r2"]
    want = exposure_grid(returns, panel.withColumn("ret", F.when((F.col("factor") == "A") & (F.col("date") == "2020-05-10"), F.col("ret")).otherwise(F.col("ret"))), cal, month_ends(cal), levels, **opts)
    rounded = lambda df: sorted((r[0], r[1], r[2], r[3], round(r[4], 9)) for r in df.select(columns).collect())
    assert rounded(refit.read_fits(spark, root)) == rounded(want)


def run_lifecycle(spark, root, batches):
    for n, rows in enumerate(batches):
        frame = spark.createDataFrame([(l, D.fromisoformat(a), 1.0 - s, s, dt.datetime.fromisoformat(t)) for l, a, s, t in rows], "limit_id string, as_of date, value double, slack double, arrived timestamp")
        frame.coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(frame.schema).parquet(f"{root}/in")
        keyed.breach_lifecycle(stream, f"{root}/out", f"{root}/state", silent_days=30).awaitTermination()
    return sorted((r.limit_id, str(r.as_of), r.event) for r in keyed.lifecycle_table(spark, f"{root}/out").collect())


def test_late_evaluations_rewrite_a_limits_life(spark, tmp_path):
    got = run_lifecycle(spark, str(tmp_path), [
        [("a", "2020-01-01", -1.0, "2020-01-01"), ("a", "2020-03-01", -1.0, "2020-03-01"), ("b", "2020-01-01", -2.0, "2020-01-01"), ("c", "2020-01-01", 1.0, "2020-01-01")],
        [("a", "2020-02-01", 1.0, "2020-03-05"), ("a", "2020-04-01", 1.0, "2020-04-01")],  # a late date back inside: March opens anew
        [("a", "2020-03-01", 2.0, "2020-04-02")],  # March is corrected: nothing is left to resolve in April
    ])
    assert got == [("a", "2020-01-01", "open"), ("a", "2020-02-01", "resolved"), ("b", "2020-01-01", "open"), ("b", "2020-01-01", "silent")]


def test_weeks_close_once_and_late_rows_correct_them(spark, tmp_path):
    root = str(tmp_path)
    batches = [
        [("x", "2024-01-01", 0.1, "2024-01-01"), ("x", "2024-01-05", 0.1, "2024-01-05"), ("x", "2024-01-06", 0.5, "2024-01-06")],  # Monday and Friday of one week, Saturday of the next
        [("x", "2024-01-04", 0.1, "2024-01-10"), ("x", "2024-01-26", 0.2, "2024-01-26")],  # late, but its week still waits; then the watermark moves on
        [("x", "2024-01-03", -0.5, "2024-02-20"), ("x", "2024-02-20", 0.3, "2024-02-20")],  # long after its week
    ]
    for rows in batches:
        frame = spark.createDataFrame([(k, dt.datetime.fromisoformat(t), r, dt.datetime.fromisoformat(a)) for k, t, r, a in rows], "ticker string, ts timestamp, ret double, arrived timestamp")
        frame.coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(frame.schema).parquet(f"{root}/in")
        for q in keyed.closed_weeks(stream, f"{root}/out", f"{root}/state"):
            q.awaitTermination()
    got = {str(r.week): (round(r.ret, 9), r.n) for r in keyed.closed_week_table(spark, f"{root}/out").collect()}
    assert got == {"2024-01-05": (round(1.1**3 * 0.5 - 1, 9), 4), "2024-01-12": (0.5, 1), "2024-01-26": (0.2, 1)}


def test_limits_hold_between_their_dates(spark):
    metrics = spark.createDataFrame([("p", D(2020, m, 1), "vol", "", float(m)) for m in range(1, 7)] + [("p", D(2020, 2, 1), "vol", "", None)], "portfolio string, as_of date, metric string, factor string, value double")
    limits = spark.createDataFrame([("p", "vol", "", None, 2.5, D(2020, 2, 1), D(2020, 3, 31)), ("p", "vol", "", 4.5, None, D(2020, 4, 1), D(2020, 5, 1))],
                                   "portfolio string, metric string, factor string, lower_bound double, upper_bound double, valid_from date, valid_to date")
    rows = risk.breach_states(risk.limits_in_force(metrics, limits)).orderBy("as_of").collect()
    assert [(r.as_of.month, r.slack, r.state) for r in rows] == [(2, 0.5, None), (3, -0.5, "open"), (4, -0.5, "update"), (5, 0.5, "resolved")]


def test_members_without_a_fit(spark):
    members = spark.createDataFrame([("p", D(2020, 2, 1), "A"), ("p", D(2020, 2, 1), "B")], "portfolio string, as_of date, ticker string")
    fits = spark.createDataFrame([("A", D(2020, 1, 15), 0.2), ("A", D(2020, 2, 15), 0.3), ("B", D(2020, 2, 15), 0.1)], "ticker string, as_of date, residual_volatility double")
    exposures = spark.createDataFrame([("A", D(2020, 1, 15), "M", 1.2, 0.1), ("A", D(2020, 2, 15), "M", 9.0, 0.1)], "ticker string, as_of date, factor string, beta double, standard_error double")
    factors = spark.createDataFrame([("M",), ("X",)], "factor string")
    rates = spark.createDataFrame([(D(2020, 1, 31), 0.01)], "date date, annualized_rate double")
    bench = spark.createDataFrame([("M", 1.0)], "factor string, beta double")
    got = risk.risk_inputs(members, fits, exposures, factors, rates, bench, missing="flag").collect()
    assert {(r.ticker, r.factor, r.beta, r.standard_error, r.benchmark_beta, r.annualized_rate, r.has_fit) for r in got} == {
        ("A", "M", 1.2, 0.1, 1.0, 0.01, True), ("A", "X", 0.0, 1e6, 0.0, 0.01, True), ("B", "M", None, 1e6, 1.0, 0.01, False), ("B", "X", None, 1e6, 0.0, 0.01, False)}
    with pytest.raises(Exception, match="no stock model on or before"):
        risk.risk_inputs(members, fits, exposures, factors, rates, bench).collect()


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_audit_and_core_layer_plans(spark):
    from panelloom.plans import load_registry

    plan = plan_of(load_registry()["constraint_audit"].run(spark, "/root/testdata/sf0.001"))
    assert plan.count("FileScan") <= 6 and "CartesianProduct" not in plan
    from panelloom.plans import fixtures as X
    from panelloom.plans.queries_factors import MACRO, STYLE

    returns = X.proxy_returns(spark, "/root/testdata/sf0.001")
    legs = plan_of(factor_model.specified_legs(returns, MACRO, STYLE))
    assert legs.count("l_extendedprice") and sum("FileScan" in line and "l_shipdate" in line for line in legs.splitlines()) <= 2
