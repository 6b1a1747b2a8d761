"""Covariance and Gram matrices of a named list of series.

The series of a matrix (a factor catalog, the names of one portfolio) become one row of places and values per date.  Each
Arrow batch of dates gives the moments of a tile of series against another, and the blocks add up in one partially
aggregated pass: no self join and no pair rows per date.  There is one route for every number of series.
Matrices leave in long form ``(row, col, value)``, both triangles.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Series of a tile; a task holds the moments of two tiles per group at once.
TILE = 256


def wide_panel(df: DataFrame, series: str, value: str, names: Sequence[str], by: Sequence[str] = ("date",)):
    """One row per ``by`` with one column ``v0..vk`` per name, in order."""
    return (
        df.where(F.col(series).isin(list(names)))
        .groupBy(*by)
        .agg(*[F.max(F.when(F.col(series) == n, F.col(value))).alias(f"v{i}") for i, n in enumerate(names)])
    )


def dated_rows(df: DataFrame, series: str, value: str, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, date, at, v): the places in ``names`` of the series present on a date and their values; the largest of repeated ones."""
    places = df.sparkSession.createDataFrame(list(enumerate(names)), "__at int, __name string")
    cells = df.where(F.col(value).isNotNull() & ~F.isnan(value)).join(places, F.col(series) == F.col("__name"))
    cells = cells.groupBy(*by, "date", "__at").agg(F.max(F.col(value).cast("double")).alias("__v"))
    rows = cells.groupBy(*by, "date").agg(F.sort_array(F.collect_list(F.struct("__at", "__v"))).alias("__c"))
    return rows.select(*by, "date", F.col("__c.__at").alias("at"), F.col("__c.__v").alias("v"))


def _moments(rows: DataFrame, names: Sequence[str], by: Sequence[str], tile: int) -> DataFrame:
    """(by, row, col, n, cxy, cxx, cyy): pairwise-complete sums of centred products.

    Every batch gives one block per group and pair of tiles, centred on its own pairwise means;
    blocks combine with the means of the batches, so no large sums cancel.
    """
    k = len(names)
    tiles = -(-k // tile)
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(tiles) for b in range(a, tiles)])
    split = rows.withColumn("p", F.explode(pairs)).select(*by, "p.a", "p.b", F.arrays_zip("at", "v").alias("c"))
    split = split.withColumn("c", F.filter("c", lambda c: F.floor(c["at"] / tile).isin(F.col("a"), F.col("b"))))
    split = split.select(*by, "a", "b", F.col("c.at").alias("at"), F.col("c.v").alias("v"))
    types = {c: rows.schema[c].dataType.simpleString() for c in by}

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for pdf in batches:
            for key, part in pdf.groupby([*by, "a", "b"], dropna=False, sort=False):
                a, b = key[-2:]
                line = np.repeat(np.arange(len(part)), [len(v) for v in part["at"]])
                place, value = np.concatenate(part["at"].to_list()), np.concatenate(part["v"].to_list())
                sides = []
                for t in (a, b):
                    own = place // tile == t
                    x, seen = np.zeros((2, len(part), min(tile, k - t * tile)))
                    x[line[own], place[own] - t * tile] = value[own]
                    seen[line[own], place[own] - t * tile] = 1
                    sides.append((x, seen))
                (x, xs), (y, ys) = sides
                n, sx, sy = xs.T @ ys, x.T @ ys, xs.T @ y
                safe = np.where(n > 0, n, 1.0)
                i, j = np.indices(n.shape)
                out = {
                    "i": i + a * tile, "j": j + b * tile, "n": n, "sx": sx, "sy": sy,
                    "cxy": x.T @ y - sx * sy / safe, "cxx": (x * x).T @ ys - sx * sx / safe, "cyy": xs.T @ (y * y) - sy * sy / safe,
                }
                frame = pd.DataFrame({c: v.ravel() for c, v in out.items()})
                for name, level in zip(by, key):
                    frame[name] = level
                yield frame[frame["n"] > 0]

    sums = ["n", "sx", "sy", "cxy", "cxx", "cyy"]
    order = [*by, "i", "j", *sums]
    schema = ", ".join([*[f"{c} {t}" for c, t in types.items()], "i int, j int", *[f"{c} double" for c in sums]])
    raw = split.mapInPandas(lambda it: (f[order] for f in blocks(it)), schema)

    def joint(c: str, x: str, y: str):
        return (F.sum(F.col(c) + F.col(x) * F.col(y) / F.col("n")) - F.sum(x) * F.sum(y) / F.sum("n")).alias(c)

    total = raw.groupBy(*by, "i", "j").agg(F.sum("n").alias("n"), joint("cxy", "sx", "sy"), joint("cxx", "sx", "sx"), joint("cyy", "sy", "sy"))
    entry = F.struct("i", "j", "cxx", "cyy")
    mirrored = F.struct(F.col("j").alias("i"), F.col("i").alias("j"), F.col("cyy").alias("cxx"), F.col("cxx").alias("cyy"))
    both = F.when(F.floor(F.col("i") / tile) == F.floor(F.col("j") / tile), F.array(entry)).otherwise(F.array(entry, mirrored))
    labels = F.array(*[F.lit(x) for x in names])
    return total.select(*by, "n", "cxy", F.explode(both).alias("e")).select(
        *by, F.element_at(labels, F.col("e.i") + 1).alias("row"), F.element_at(labels, F.col("e.j") + 1).alias("col"), "n", "cxy", "e.cxx", "e.cyy"
    )


def covariance(
    df: DataFrame, series: str, value: str, names: Sequence[str], *, annualize: int = 252, by: Sequence[str] = (), tile: int = TILE
) -> DataFrame:
    """Pairwise-complete sample covariance, annualised; undefined entries are 0."""
    m = _moments(dated_rows(df, series, value, names, by), names, by, tile)
    known = m.select(*by, "row", "col", F.when(F.col("n") > 1, F.col("cxy") / (F.col("n") - 1) * annualize).alias("value"))
    labels = F.array(*[F.lit(x) for x in names])
    groups = df.where(F.col(series).isin(list(names))).select(*by).distinct() if by else df.sparkSession.range(1).select()
    cells = groups.select(*by, F.explode(labels).alias("row")).select(*by, "row", F.explode(labels).alias("col"))
    return cells.join(known, [*by, "row", "col"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def correlation(df: DataFrame, series: str, value: str, names: Sequence[str], *, last: int | None = 252, tile: int = TILE):
    """Pairwise correlation over the last ``last`` dates of the panel; only pairs with a common date have a row."""
    if last is not None:
        dates = df.where(F.col(series).isin(list(names))).select("date").distinct().orderBy(F.desc("date")).limit(last)
        df = df.where(F.col("date") >= dates.agg(F.min("date").alias("date")).scalar())  # before the pivot
    root = F.sqrt(F.col("cxx") * F.col("cyy"))
    value_ = F.when((F.col("n") > 1) & (root > 0), F.col("cxy") / root)
    return _moments(dated_rows(df, series, value, names), names, (), tile).select("row", "col", value_.alias("value"))


def complete_covariance(
    df: DataFrame, series: str, value: str, names: Sequence[str], method: str = "ledoit_wolf", annualize: int = 252, tile: int = TILE
) -> DataFrame:
    """Covariance over the dates on which every series is present.

    Fewer than two such dates give no rows.  ``sample``, ``diagonal`` or ``ledoit_wolf``: shrinkage toward a scaled identity with
    the published optimal intensity, from sums of squares and products only.
    """
    if method not in ("sample", "diagonal", "ledoit_wolf"):
        raise ValueError(f"unknown covariance estimator: {method}")
    k = len(names)
    rows = dated_rows(df, series, value, names).where(F.size("at") == k)
    m = _moments(rows, names, (), tile).where("n > 1")
    same = F.col("row") == F.col("col")
    if method != "ledoit_wolf":
        entry = F.col("cxy") / (F.col("n") - 1) * annualize
        return m.select("row", "col", (entry if method == "sample" else F.when(same, entry).otherwise(F.lit(0.0))).alias("value"))
    m = m.select("row", "col", "n", (F.col("cxy") / F.col("n")).alias("m"))
    cells = rows.select("date", F.explode(F.arrays_zip("at", "v")).alias("c")).select("date", "c.at", "c.v")
    centred = cells.join(cells.groupBy("at").agg(F.avg("v").alias("mean")), "at").withColumn("d", F.col("v") - F.col("mean"))
    lengths = centred.groupBy("date").agg(F.sum(F.col("d") * F.col("d")).alias("q"))
    fourth = lengths.agg(F.sum(F.col("q") * F.col("q")).alias("q")).scalar()
    sums = m.agg(F.max("n").alias("n"), F.sum(F.col("m") * F.col("m")).alias("frob"), (F.sum(F.when(same, F.col("m"))) / k).alias("mu"))
    sums = sums.withColumn("delta", (F.col("frob") - k * F.col("mu") * F.col("mu")) / k).withColumn("b", (fourth / F.col("n") - F.col("frob")) / (k * F.col("n")))
    sums = sums.withColumn("shrink", F.when(F.col("delta") > 0, F.least("b", "delta") / F.col("delta")).otherwise(F.lit(0.0)))
    out = m.withColumn("s", sums.select(F.struct("shrink", "mu").alias("s")).scalar())
    diagonal = F.when(same, F.col("s.shrink") * F.col("s.mu")).otherwise(F.lit(0.0))
    return out.select("row", "col", (((1 - F.col("s.shrink")) * F.col("m") + diagonal) * annualize).alias("value"), "s.shrink")


def gram(df: DataFrame, by: Sequence[str], y: str, xs: Sequence[str]) -> DataFrame:
    """n, sums and cross products of (1, xs, y) over complete rows, one row per group.

    Every aggregate is a plain sum, so it combines before the shuffle and spreads
    over any hot group.
    """
    cols = [*xs, y]
    data = df.dropna(subset=cols)
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.sum(c).alias(f"s_{c}") for c in cols]
    aggs += [F.sum(F.col(a) * F.col(b)).alias(f"p_{a}_{b}") for i, a in enumerate(cols) for b in cols[i:]]
    return data.groupBy(*by).agg(*aggs)


def two_regressor_fit(df: DataFrame, by: Sequence[str], y: str, x1: str, x2: str) -> DataFrame:
    """OLS of y on two regressors from its Gram row (Cramer's rule on centred sums)."""
    g = gram(df, by, y, [x1, x2])

    def c(a, b):
        a, b = sorted([a, b], key=[x1, x2, y].index)
        return F.col(f"p_{a}_{b}") - F.col(f"s_{a}") * F.col(f"s_{b}") / F.col("n")

    det = c(x1, x1) * c(x2, x2) - c(x1, x2) * c(x1, x2)
    b1 = (c(x1, y) * c(x2, x2) - c(x2, y) * c(x1, x2)) / det
    b2 = (c(x2, y) * c(x1, x1) - c(x1, y) * c(x1, x2)) / det
    fit = g.where((F.col("n") > 3) & (det != 0)).select("*", b1.alias("beta_1"), b2.alias("beta_2"))
    rss = c(y, y) - F.col("beta_1") * c(x1, y) - F.col("beta_2") * c(x2, y)
    return fit.select(
        *by,
        F.col("n").alias("observation_count"),
        ((F.col(f"s_{y}") - F.col("beta_1") * F.col(f"s_{x1}") - F.col("beta_2") * F.col(f"s_{x2}")) / F.col("n")).alias("alpha"),
        "beta_1",
        "beta_2",
        (1 - (rss / (F.col("n") - 3)) / F.nullif(c(y, y) / (F.col("n") - 1), F.lit(0.0))).alias("adjusted_r2"),
    )
