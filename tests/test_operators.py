"""Operators on small closed cases, identities and metamorphic checks."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelloom import constants as C
from panelloom.functions.ranks import ranked
from panelloom.functions.scalars import normal_cdf
from panelloom.operators import allocation, calendar, evaluation, exposures, forecasts, moments, replay, returns, risk, screening
from panelloom.operators.catalog import catalog_members, construction_details, definitions, exposure_universe, specifications
from panelloom.operators.performance import statistics
from panelloom.operators.regression import single_factor_fit, strip_design
from panelloom.plans import factor_model
from panelloom.sources import prices as prices_src
from panelloom.sources import reference_data


def days(n, start="2020-01-01"):
    return list(pd.bdate_range(start, periods=n).date)


def book(spark, wide: pd.DataFrame):
    long = wide.rename_axis("date").reset_index().melt("date", var_name="ticker", value_name="close").dropna()
    return spark.createDataFrame(list(long.itertuples(index=False, name=None)), "date date, ticker string, close double")


def random_book(spark, tickers, n=420, seed=12):
    rng = np.random.default_rng(seed)
    wide = pd.DataFrame(100 * np.cumprod(1 + rng.normal(0.0003, 0.01, (n, len(tickers))), axis=0), index=days(n), columns=tickers)
    return wide, book(spark, wide)


@pytest.mark.parametrize("parts", [1, 7])
@pytest.mark.parametrize("ascending", [False, True])
def test_ranks_match_pandas_with_heavy_ties(spark, parts, ascending):
    rng = np.random.default_rng(3)
    n = 1500
    score = np.where(rng.random(n) < 0.4, 0.0, np.round(rng.normal(size=n), 1))
    pdf = pd.DataFrame({"g": rng.integers(0, 2, n).astype(str), "t": [f"NAME{i:05d}" for i in rng.permutation(n)], "s": score, "v": rng.random(n)})
    pdf.loc[::50, "s"] = None
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None).values.tolist(), "g string, t string, s double, v double")
    shuffles, coalesce = "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled"
    before = {c: spark.conf.get(c) for c in (shuffles, coalesce)}
    try:
        spark.conf.set(shuffles, parts)
        spark.conf.set(coalesce, False)  # so that one score lies in several partitions
        got = ranked(df, ["g"], "s", "t", ascending=ascending, running="v").toPandas().sort_values("t").reset_index(drop=True)
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    want = pdf.sort_values("t").reset_index(drop=True)
    order = want.dropna().sort_values(["s", "t"], ascending=[ascending, True])
    first = order.groupby("g").cumcount() + 1
    before = order.groupby("g")["v"].cumsum() - order["v"]
    assert len(got) == n
    assert np.allclose(got["rank"].astype(float), first.reindex(want.index).astype(float), equal_nan=True)
    assert np.allclose(got["percentile"].astype(float), want.groupby("g")["s"].rank(pct=True), equal_nan=True)
    assert np.allclose(got["running"].astype(float), before.reindex(want.index), equal_nan=True)


def test_ranks_of_null_groups_number_ties_and_empty_input(spark):
    rows = [(None, i, 1.0) for i in range(1, 13)] + [("a", 1, 2.0), ("a", 2, None)]
    df = spark.createDataFrame(rows, "g string, id int, s double")
    got = {(r.g, r.id): (r["rank"], r.percentile) for r in ranked(df, ["g"], "s", "id").collect()}
    assert all(got[(None, i)] == (i, 6.5 / 12) for i in range(1, 13))
    assert got[("a", 1)] == (1, 1.0) and got[("a", 2)] == (None, None)
    assert ranked(df.where("false"), ["g"], "s", "id").count() == 0


def test_normal_cdf(spark):
    import math

    xs = [-8.0, -3.0, -1.0, 0.0, 0.5, 1.959963984540054, 6.9, 7.5, 9.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(normal_cdf("x")).collect()]
    assert np.allclose(got, [0.5 * math.erfc(-x / math.sqrt(2)) for x in xs], atol=1e-14)


def test_returns_do_not_bridge_gaps(spark):
    d = days(4)
    wide = pd.DataFrame({"A": [1.0, 2.0, None, 4.0], "B": [1.0, 1.0, 1.0, 2.0]}, index=d)
    p = book(spark, wide)
    rows = {(r["ticker"], r["date"]): r["ret"] for r in returns.simple_returns(p, calendar.trading_calendar(p)).collect()}
    assert rows[("A", d[1])] == 1.0 and rows[("A", d[3])] is None and rows[("B", d[3])] == 1.0


def test_lagged_scaling_uses_prior_day(spark):
    d = days(81)
    vals = [0.001] * 79 + [0.0011, 0.2]
    df = spark.createDataFrame([("F", a, v) for a, v in zip(d, vals)], "factor string, date date, ret double")
    out = returns.lagged_vol_target(df, "factor").orderBy("date").toPandas()
    prior = np.std(vals[20:80], ddof=1) * np.sqrt(252)
    assert len(out) == 21
    assert out["scaled_return"].iloc[-1] == pytest.approx(0.2 * min(5.0, 0.1 / prior))


def test_zscores_match_pandas(spark):
    rng = np.random.default_rng(5)
    r = pd.Series(rng.normal(0, 0.01, 400), index=days(400))
    df = spark.createDataFrame([("F", a, float(v)) for a, v in r.items()], "factor string, date date, ret double")
    got = returns.with_zscores(df, "factor", horizons=(1, 21)).orderBy("date").toPandas()
    for h in (1, 21):
        s = r.rolling(h).sum()
        want = (s - s.rolling(252, min_periods=h).mean()) / s.rolling(252, min_periods=h).std()
        assert np.allclose(got[f"z_{h}"].astype(float), want, equal_nan=True)


def test_rolling_output_ignores_the_future(spark):
    wide, p = random_book(spark, ["A"], 300)
    cut = wide.index[200]
    changed = wide.copy()
    changed.loc[changed.index > cut] *= 1.5
    outs = []
    for frame in (wide, changed):
        b = book(spark, frame)
        r = returns.simple_returns(b, calendar.trading_calendar(b)).where("ret is not null")
        z = returns.with_zscores(returns.lagged_vol_target(r, "ticker"), "ticker", "scaled_return", horizons=(5,))
        outs.append(z.where(F.col("date") <= F.lit(cut)).orderBy("date").select("scaled_return", "z_5").toPandas().astype(float))
    assert np.allclose(outs[0], outs[1], equal_nan=True)


def test_strip_removes_parent(spark):
    rng = np.random.default_rng(4)
    n = 1000
    x = rng.normal(0, 0.01, n)
    y = 1.8 * x + rng.normal(0, 0.002, n)
    rows = [("child", d, float(b), [float(a)]) for d, a, b in zip(days(n), x, y)]
    df = spark.createDataFrame(rows, "factor string, date date, y double, x array<double>")
    out = strip_design(df, 1).orderBy("date").toPandas()
    assert abs(np.corrcoef(out["ret"], x)[0, 1]) < 0.15
    assert out["is_warmup"].iloc[0] and not out["is_warmup"].iloc[-1]


def test_strip_kernel_equals_single_regressor_plan(spark):
    rng = np.random.default_rng(6)
    n = 900
    x = rng.normal(0, 0.01, n)
    y = 0.7 * x + rng.normal(0, 0.004, n)
    base = [("f", d, float(b), float(a)) for d, a, b in zip(days(n), x, y)]
    df = spark.createDataFrame(base, "factor string, date date, y double, a double")
    one = strip_design(df.select("factor", "date", "y", F.array("a").alias("x")), 1).orderBy("date").toPandas()
    two = strip_design(df.select("factor", "date", "y", F.array("a", "a").alias("x")), 2).orderBy("date").toPandas()
    assert np.allclose(one["ret"], two["ret"], atol=1e-7)


def test_exposure_recovers_beta(spark):
    rng = np.random.default_rng(8)
    n = 320
    m = rng.normal(0, 0.01, n)
    rows = [("S", d, float(a), float(1.2 * a + e)) for d, a, e in zip(days(n), m, rng.normal(0, 0.002, n))]
    fit = single_factor_fit(spark.createDataFrame(rows, "ticker string, date date, x double, y double"), "ticker", "y", "x").first()
    assert abs(fit["beta"] - 1.2) < 0.1 and fit["observation_count"] == n and fit["ci_low"] < fit["beta"] < fit["ci_high"]


def test_exposure_grid_covers_stale_months_until_the_minimum(spark):
    wide, p = random_book(spark, ["A", "B", "M", "N"], 320)
    wide.loc[wide.index > wide.index[250], "B"] = None
    p = book(spark, wide)
    cal = calendar.trading_calendar(p)
    r = returns.simple_returns(p, cal)
    f = r.where("ticker in ('M', 'N') and ret is not null").select(F.col("ticker").alias("factor"), "date", "ret")
    out = exposures.exposure_grid(
        r.where("ticker in ('A', 'B')"), f, cal, calendar.month_ends(cal), {"one": ["M"], "two": ["M", "N"]}, window=120, minimum=60, selection_mode="fixed"
    ).toPandas()
    ret = wide.pct_change(fill_method=None)
    ends = pd.Series(wide.index, index=pd.to_datetime(wide.index)).groupby(lambda d: (d.year, d.month)).max()
    want = 0
    for end in ends:
        for t in ("A", "B"):
            part = ret.loc[:end].tail(120)[[t, "M", "N"]].dropna()
            if len(part) < 60:
                continue
            want += 1
            row = out[(out.ticker == t) & (out.level == "two") & (out.as_of == end)]
            assert len(row) == 1
            a = np.column_stack([np.ones(len(part)), part[["M", "N"]]])
            b = np.linalg.lstsq(a, part[t], rcond=None)[0]
            assert np.allclose(list(row["beta"].iloc[0]), b[1:]) and row["observation_count"].iloc[0] == len(part)
            assert row["coverage"].iloc[0] == pytest.approx(ret.loc[:end].tail(120)[t].notna().mean())
    assert (out.level == "two").sum() == want
    assert out["is_provisional"].sum() == 2 * out[out.period == out.period.max()]["ticker"].nunique()


def test_risk_split_adds_up(spark):
    w = spark.createDataFrame([("p", "A", 0.6, 0.1), ("p", "B", 0.4, 0.2)], "portfolio string, ticker string, weight double, residual_volatility double")
    e = spark.createDataFrame([("A", "F", 1.0), ("A", "G", 0.2), ("B", "F", 0.5), ("B", "G", -0.3)], "ticker string, factor string, beta double")
    o = spark.createDataFrame([("F", "F", 0.04), ("F", "G", 0.01), ("G", "F", 0.01), ("G", "G", 0.09)], "row string, col string, value double")
    split = risk.euler_split(risk.portfolio_betas(w, e, ["portfolio"]), risk.specific_variance(w, ["portfolio"]), o, ["portfolio"]).toPandas()
    b = np.array([0.8, 0.0])
    total = b @ [[0.04, 0.01], [0.01, 0.09]] @ b + 0.06**2 + 0.08**2
    assert split["predicted_volatility"].iloc[0] == pytest.approx(np.sqrt(total))
    assert split["contribution"].sum() + split["specific_contribution"].iloc[0] == pytest.approx(np.sqrt(total))


def test_attribution_identity(spark):
    w = spark.createDataFrame([("p", "A", 0.5), ("p", "B", 0.5)], "portfolio string, ticker string, weight double")
    e = spark.createDataFrame([("A", "F", 1.0), ("B", "F", 0.0)], "ticker string, factor string, beta double")
    out = risk.attribution(
        risk.portfolio_betas(w, e, ["portfolio"]), spark.createDataFrame([("F", 0.02)], "factor string, ret double"), w,
        spark.createDataFrame([("A", 0.03), ("B", 0.01)], "ticker string, ret double"), ["portfolio"],
    ).first()
    assert out["realized_return"] == pytest.approx(0.02) and out["factor_return"] == pytest.approx(0.01)
    assert out["residual_contribution"] == pytest.approx(0.01) and out["contributions"] == {"F": pytest.approx(0.01)}


def test_drift_between_rebalances(spark):
    d = days(100)
    wide = pd.DataFrame({"A": np.linspace(100, 160, 100), "B": [100.0] * 100}, index=d)
    p = book(spark, wide)
    cal = calendar.trading_calendar(p)
    r = returns.simple_returns(p, cal)
    dec = spark.createDataFrame([("s", d[9], t, 0.5) for t in "AB"] + [("s", d[59], t, 0.5) for t in "AB"], "strategy string, signal_date date, ticker string, weight double")
    got = replay.replay(dec, r, cal, cost_bps=10).orderBy("date").toPandas()
    ret, cur, want, turn = wide.pct_change(fill_method=None).fillna(0), np.zeros(2), [], []
    for i in range(10, 100):
        t = 0.0
        if i in (10, 60):
            t, cur = np.abs(np.array([0.5, 0.5]) - cur).sum(), np.array([0.5, 0.5])
        g = cur @ ret.iloc[i].to_numpy()
        want.append(g - t * 0.001)
        turn.append(t)
        cur = cur * (1 + ret.iloc[i].to_numpy()) / (1 + g)
    assert np.allclose(got["ret"], want) and np.allclose(got["turnover"], turn)


def test_replay_ignores_prices_after_the_end(spark):
    wide, p = random_book(spark, ["A", "B"], 200)
    cut = wide.index[150]
    changed = wide.copy()
    changed.loc[changed.index > cut] *= 2
    outs = []
    for f in (wide, changed):
        b = book(spark, f)
        cal = calendar.trading_calendar(b)
        dec = replay.month_end_decisions(spark.createDataFrame([("s", "A"), ("s", "B")], "strategy string, ticker string"), cal)
        outs.append(replay.replay(dec, returns.simple_returns(b, cal), cal).where(F.col("date") <= F.lit(cut)).orderBy("date").toPandas()["ret"])
    assert np.allclose(outs[0], outs[1])


def test_performance_statistics(spark):
    rng = np.random.default_rng(2)
    r = pd.Series(rng.normal(0.0005, 0.01, 300))
    df = spark.createDataFrame([("s", d, float(v)) for d, v in zip(days(300), r)] + [("short", d, 0.01) for d in days(10)], "strategy string, date date, ret double")
    out = statistics(df).toPandas()
    assert list(out["strategy"]) == ["s"]
    eq = (1 + r).cumprod()
    row = out.iloc[0]
    assert row["annual_return"] == pytest.approx(eq.iloc[-1] ** (252 / 300) - 1)
    assert row["max_drawdown"] == pytest.approx((eq / eq.cummax() - 1).min())
    assert row["daily_cvar_95_loss"] == pytest.approx(-r[r <= r.quantile(0.05)].mean())
    assert row["autocorrelation_1"] == pytest.approx(r.autocorr(1))


def test_rank_ic_is_one_on_monotone_data(spark):
    rows = [(m, f"N{i:02d}", float(i), i / 100) for m in range(10) for i in range(20)]
    panel = spark.createDataFrame(rows, "period int, ticker string, score double, forward_return double")
    s = evaluation.selection_statistics(panel).first()
    assert s["rank_ic"] == pytest.approx(1.0) and s["hit_rate"] == 1.0 and s["observations"] == 10
    assert s["top_minus_bottom"] == pytest.approx(0.16)


def screen_tables(spark):
    fits = spark.createDataFrame([(1, t, s, 252, 0.9, 0.5) for t, s in zip("ABCD", "XXYY")], "as_of int, ticker string, sector string, observation_count int, coverage double, adjusted_r2 double")
    e = spark.createDataFrame([(1, t, "quality", float(i + 1)) for i, t in enumerate("ABCD")] + [(1, t, "risk", float(4 - i)) for i, t in enumerate("ABCD")], "as_of int, ticker string, factor string, beta double")
    return fits, e


def test_upserts_read_only_touched_months(spark, tmp_path):
    from panelloom.sources.prices import months_of_book, write_prices

    rows = [("A", dt.date(2020, m, 3), float(m), 0) for m in (1, 2, 3)]
    write_prices(spark.createDataFrame(rows, "ticker string, date date, close double, batch long"), str(tmp_path / "book"))
    part = months_of_book(spark, str(tmp_path / "book"), ["2020-02"])
    plan = part._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters: ["):].split("PushedFilters")[0]
    assert "month" in filters and "2020-02" in filters
    assert [r.close for r in part.collect()] == [2.0]


def test_late_weekly_rows_correct_old_weeks(spark, tmp_path):
    from panelloom.streaming import flows

    folder = str(tmp_path)
    batches = [[("A", "2020-06-01 00:00:00", 0.1)], [("A", "2020-01-06 00:00:00", 0.2), ("A", "2020-06-02 00:00:00", 0.1)], [("A", "2020-06-01 00:00:00", 0.5)]]
    for rows in batches:
        spark.createDataFrame(rows, "ticker string, ts string, ret double").selectExpr("ticker", "cast(ts as timestamp) ts", "ret").write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema("ticker string, ts timestamp, ret double").parquet(f"{folder}/in")
        flows.weekly_stream(stream, f"{folder}/out", f"{folder}/state").start().awaitTermination()
    got = {str(r.week): r.ret for r in flows.weekly_table(spark, f"{folder}/out").collect()}
    assert got == pytest.approx({"2020-01-10": 0.2, "2020-06-05": 1.5 * 1.1 - 1})


def test_unknown_factors_raise(spark):
    fits, e = screen_tables(spark)
    for weights, regimes in (({"quality": 1, "qualty": 1}, None), ({"quality": 1}, {"rsk": 0.5})):
        with pytest.raises(ValueError, match="unavailable"):
            screening.screen_preview(fits, e, weights, {}, regimes=regimes, known=["quality", "risk"])
    with pytest.raises(ValueError, match="unavailable"):
        screening.selection(fits, e, {"qualty": 1.0}, known=["quality", "risk"])
    screening.selection(fits, e, {"quality": 1.0, "qualty": 0.0}, known=["quality", "risk"])


def test_forecasts_keep_every_stock_and_raise_on_unknown_premia(spark):
    from panelloom.operators import forecasts

    e = spark.createDataFrame([("A", "M", 2.0), ("B", "S", 1.0)], "ticker string, factor string, beta double")
    stocks = spark.createDataFrame([("A",), ("B",), ("C",)], "ticker string")
    premia = spark.createDataFrame([("M", 0.05)], "factor string, premium double")
    got = {r.ticker: r.expected_return for r in forecasts.factor_implied_returns(e, premia, stocks=stocks, risk_free_rate=0.02).collect()}
    assert got == pytest.approx({"A": 0.12, "B": 0.02, "C": 0.02})
    with pytest.raises(Exception, match="unknown factor premium: Z"):
        forecasts.factor_implied_returns(e, spark.createDataFrame([("M", 0.05), ("Z", 0.1)], premia.schema)).collect()
    history = spark.createDataFrame([("M", 0.001 * i) for i in range(30)], "factor string, ret double")
    priors = spark.createDataFrame([("M", 0.05), ("Z", 0.02)], "factor string, assumption double")
    with pytest.raises(Exception, match="unknown factor premium: Z"):
        forecasts.shrink_premia(history, priors, min_observations=24).collect()
    with pytest.raises(Exception, match="insufficient factor history: M"):
        forecasts.shrink_premia(history, priors.where("factor = 'M'"), min_observations=31).select("premium").collect()
    for bad in (0.0, None, float("inf")):
        with pytest.raises(Exception, match="variance must be positive"):
            forecasts.equal_sharpe_returns(spark.createDataFrame([("A", bad)], "ticker string, variance double")).collect()


def test_screen_directions_and_rules(spark):
    fits, e = screen_tables(spark)
    out = screening.screen_preview(fits, e, {"quality": 1, "risk": 1}, {"sectors": ["Y"]}, directions={"risk": -1}).orderBy("ticker").toPandas()
    assert out.set_index("ticker")["rank"].to_dict() == pytest.approx({"A": None, "B": None, "C": 2, "D": 1}, nan_ok=True) or list(out["rank"].fillna(0)) == [0, 0, 2, 1]
    assert out["percentile"].tolist() == [0.25, 0.5, 0.75, 1.0]


def test_selection_top_n_and_manual(spark):
    fits, e = screen_tables(spark)
    out = screening.selection(fits, e, {"quality": 1.0, "risk": 0.0}, top=2, manual=["A"], excluded=["D"]).toPandas().set_index("ticker")
    assert out["model_selected"].to_dict() == {"A": False, "B": True, "C": True, "D": False}
    assert out["selection_source"].to_dict() == {"A": "manual", "B": "model", "C": "model", "D": ""}
    with pytest.raises(ValueError):
        screening.selection(fits, e, {"quality": -1.0})
    with pytest.raises(ValueError):
        screening.selection(fits, e, {"quality": 1.0}, manual=["A"], excluded=["A"])


def test_bounds_greedy_and_audit(spark):
    n = spark.createDataFrame([("p", t, m, 0.25) for t, m in zip("ABCD", (0.04, 0.09, 0.01, 0.06))], "portfolio string, ticker string, expected_return double, previous double")
    b = allocation.effective_bounds(n, min_weight=0.05, max_weight=0.5)
    w = allocation.greedy_max_return(b).toPandas().set_index("ticker")["optimized_weight"]
    assert w.to_dict() == pytest.approx({"A": 0.05, "B": 0.5, "C": 0.05, "D": 0.4})
    assert not allocation.effective_bounds(n, max_weight=0.2).first()["feasible"]
    full = allocation.greedy_max_return(b).withColumnRenamed("optimized_weight", "weight").withColumn("sector", F.lit("One")).withColumn("residual_volatility", F.lit(0.1))
    bad = allocation.audit(full, turnover_cap=0.1).where("violated").toPandas()
    assert list(bad["kind"]) == ["turnover_cap"]


def test_moments_by_tiles(spark):
    wide, p = random_book(spark, list("ABCDEF"), 300)
    wide.iloc[5:90, 2] = None
    p = book(spark, wide)
    r = returns.simple_returns(p, calendar.trading_calendar(p)).where("ret is not null")
    ret = wide.pct_change(fill_method=None)
    for tile in (4, 256):
        cov = moments.covariance(r, "ticker", "ret", list("ABCDEF"), tile=tile).toPandas().pivot(index="row", columns="col", values="value")
        corr = moments.correlation(r, "ticker", "ret", list("ABCDEF"), last=None, tile=tile).toPandas().pivot(index="row", columns="col", values="value")
        assert np.allclose(cov, ret.cov() * 252) and np.allclose(corr, ret.corr())


def test_covariance_of_many_series(spark):
    x = np.random.default_rng(6).normal(size=(40, 600))
    rows = [(f"S{j:03d}", i, float(x[i, j])) for i in range(40) for j in range(600)]
    df = spark.createDataFrame(rows, "ticker string, day int, ret double").withColumn("date", F.expr("date_add(date'2020-01-01', day)"))
    names = [f"S{j:03d}" for j in range(600)]
    out = moments.complete_covariance(df, "ticker", "ret", names).toPandas()
    c = x - x.mean(axis=0)
    m = c.T @ c / 40
    mu, frob = np.trace(m) / 600, (m * m).sum()
    delta = (frob - 600 * mu * mu) / 600
    shrink = min((((c * c).sum(axis=1) ** 2).sum() / 40 - frob) / (600 * 40), delta) / delta
    got = out.pivot(index="row", columns="col", values="value").to_numpy()
    assert got.shape == (600, 600) and np.allclose(got, ((1 - shrink) * m + shrink * mu * np.eye(600)) * 252)


def test_shrinkage_edges(spark):
    rng = np.random.default_rng(1)
    rows = [(t, float(v)) for t in "AB" for v in rng.normal(0, 0.01, 100)]
    df = spark.createDataFrame(rows, "ticker string, ret double")
    pinned = forecasts.shrink_means(df, prior_mean=0.05, prior_variance=0.0).toPandas()
    assert np.allclose(pinned["expected_return"], 0.05)
    with pytest.raises(Exception, match="insufficient"):
        forecasts.shrink_means(df, min_observations=1000).collect()
    e = spark.createDataFrame([("A", "F", 0.5, 0.1), ("B", "F", 0.0, 1e6)], "ticker string, factor string, beta double, standard_error double")
    out = forecasts.shrink_betas(e).toPandas().set_index("ticker")
    assert out.loc["A", "prior_variance"] == pytest.approx(0.24) and out.loc["B", "beta"] == 0.0 and out.loc["A", "informative_count"] == 1


def test_price_upsert_last_write_wins(spark):
    d = days(3)
    old = spark.createDataFrame([("AAA", d[0], 10.0, 0), ("AAA", d[1], 11.0, 0)], "ticker string, date date, close double, batch long")
    new = spark.createDataFrame([("aaa", d[1], 12.0, 1), ("AAA", d[2], 13.0, 1), ("AAA", d[0], float("nan"), 1)], "ticker string, date date, close double, batch long")
    rows = prices_src.upsert_prices(old, new).orderBy("date").collect()
    assert [(r["date"], r["close"]) for r in rows] == [(d[0], 10.0), (d[1], 12.0), (d[2], 13.0)]


def test_validation_rejects_empty_books(spark):
    bad = spark.createDataFrame([("A", days(1)[0], -1.0, 0)], "ticker string, date date, close double, batch long")
    with pytest.raises(Exception, match="valid prices"):
        prices_src.validate_prices(bad).collect()


def test_month_end_modes(spark):
    p = spark.createDataFrame([("A", dt.date(2026, m, d), 1.0) for m, d in ((8, 31), (9, 2), (9, 3))], "ticker string, date date, close double")
    cal = calendar.trading_calendar(p)
    pick = lambda **k: sorted(r["month_end"] for r in calendar.month_ends(cal, **k).collect())
    assert pick() == [dt.date(2026, 8, 31), dt.date(2026, 9, 3)]
    assert pick(mode="auto") == pick(mode="latest") == [dt.date(2026, 9, 3)]
    assert pick(mode="auto", earliest_change="2026-08-15") == [dt.date(2026, 8, 31), dt.date(2026, 9, 3)]
    with pytest.raises(ValueError):
        calendar.month_ends(cal, "sometimes")


def test_cash_rate_files(spark):
    raw = spark.createDataFrame([("01/02/2024", "5.25", 0), ("1/3/2024", "n/a", 1), ("01/02/2024", "9.0", 2)], "date_text string, percent_text string, seq long")
    assert [tuple(r) for r in reference_data.clean_cash_rates(raw).collect()] == [(dt.date(2024, 1, 2), pytest.approx(0.0525))]
    with pytest.raises(Exception, match="plausible"):
        reference_data.clean_cash_rates(raw.withColumn("percent_text", F.lit("40"))).collect()


def test_catalogs_nest_and_metadata(spark):
    sizes = {k: len(v) for k, v in C.CATALOGS.items()}
    assert sizes == {"base": 15, "base_sector": 26, "base_sector_industry": 36, "all_factors": 56}
    order = list(C.CATALOGS.values())
    assert all(b[: len(a)] == a for a, b in zip(order, order[1:]))
    assert catalog_members(spark).count() == 133
    d = construction_details(specifications(spark), definitions(spark).select("factor", "construction")).toPandas()
    assert len(d) == 56 and (d["kind"] != "unknown").all()
    assert C.BENCHMARK in C.proxy_tickers()


def test_unknown_requested_tickers_raise(spark):
    _, p = random_book(spark, ["A", "B"], 5)
    sec = spark.createDataFrame([("A", "stock"), ("B", "stock")], "ticker string, asset_type string")
    assert [r[0] for r in exposure_universe(sec, p, requested=["a"]).collect()] == ["A"]
    with pytest.raises(Exception, match="unknown stock"):
        exposure_universe(sec, p, requested=["A", "Q"]).collect()


def test_factor_model_layers(spark):
    names = ["M1", "M2", "M3", "S1", "S2", "I1", "C1", "T1", "T2"]
    _, p = random_book(spark, names, 900)
    r = returns.simple_returns(p, calendar.trading_calendar(p))
    out = factor_model.build_model(
        r, macro=(("Market", "raw", "M1", None, 1), ("Rate", "vol", "M2", "M3", 1)), style=(("Size", "M3", "M1"),),
        sectors={"S": "S1", "Gone": "NONE"}, industries={"I": "I1"}, countries={"C": "C1"}, themes=[("T", "T1"), ("T", "T2")],
    )
    counts = {r["factor"]: r["n"] for r in out.groupBy("factor").agg(F.count("ret").alias("n")).collect()}
    assert set(counts) == {"Market", "Rate", "Size", "S", "I", "C", "T"}
    assert counts["Market"] > counts["Rate"] > counts["S"] > counts["I"] > counts["C"] > counts["T"] > 0
    with pytest.raises(Exception, match="missing proxy"):
        factor_model.build_model(r, macro=(("Market", "raw", "M1", None, 1),), style=(), sectors={"S": "S1"}, industries={"I": "NONE"}, countries={}, themes=[])


def test_fits_of_one_month_equal_those_of_all(spark):
    _, book_df = random_book(spark, ["A", "B", "C"], n=420)
    cal = calendar.trading_calendar(book_df)
    rets = returns.simple_returns(book_df, cal)
    factors = rets.where("ret is not null and ticker = 'C'").select(F.lit("M").alias("factor"), "date", "ret")
    ends = calendar.month_ends(cal)
    newest = ends.orderBy(F.desc("month_end")).limit(1)
    settings = {"levels": {"base": ["M"]}, "window": 90, "minimum": 60, "selection_mode": "fixed"}
    every = exposures.exposure_grid(rets, factors, cal, ends, **settings)
    one = exposures.exposure_grid(rets, factors, cal, newest, **settings).toPandas().sort_values("ticker").reset_index(drop=True)
    period = one["period"].iloc[0]
    same = every.where(F.col("period") == F.lit(period)).toPandas().sort_values("ticker").reset_index(drop=True)
    assert len(one) == 3
    pd.testing.assert_frame_equal(one, same)
