"""Embedding near duplicates by collision counting: sorted one-dimensional projections, windows around every vector, exact cosines for pairs that collide often enough."""

from __future__ import annotations

from math import ceil, comb, erf, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_table
from .neardup import components, spanning
from .vectors import usable

#: Least cosine of a link, chance of missing a link at that cosine (looser than for any closer pair), seed of the projections.
COSINE, MISS, SEED = 0.93, 5e-4, 1313
#: Half-width of a window in units of the distance at the threshold; projections whose collisions are counted at least.
REACH, COUNTED = 2.0, 24
#: Vectors of a cell and of a block of a cell; vectors drawn as centres of dense groups, and the size from which a group counts as dense.
CELL, BLOCK, CENTRES, DENSE = 4096, 2048, 256, 512
#: Share of a sorted projection of unit vectors in one strip, about: what one more sorting level leaves of a cell.
LEFT = 0.5
#: Allowance for rounding of angles, in radians.
SLACK = 1e-7


class Plan:
    """Windows and thresholds that follow from the least cosine and the chance of a miss."""

    def __init__(self, cosine: float, miss: float):
        if not 0 < cosine < 1:
            raise ValueError("the least cosine lies between 0 and 1")
        self.cosine, self.miss = cosine, miss
        self.angle = float(np.arccos(cosine))
        self.half = np.float32(REACH * sqrt(2 - 2 * cosine))
        self.strip = np.float32(2 * self.half)
        # a pair at the threshold is as far apart on a Gaussian projection as a normal variable of that distance
        self.collides = erf(REACH / sqrt(2))

    def levels(self, size: int) -> int:
        """Projections sorted one inside the other until a cell holds about CELL vectors."""
        return max(1, ceil(log(max(size, 1) / CELL) / -log(LEFT))) if size > 1 else 1

    def orders(self, levels: int) -> int:
        """Independent nested orders, such that a pair at the threshold meets in one of them but with half the chance of a miss."""
        return ceil(log(self.miss / 2) / log(1 - self.collides**levels))

    def least(self, counted: int) -> int:
        """Collisions that a pair at the threshold reaches but with half the chance of a miss."""
        p, tail = self.collides, 0.0
        for n in range(counted + 1):
            tail += comb(counted, n) * p**n * (1 - p) ** (counted - n)
            if tail > self.miss / 2:
                return n
        return counted


def directions(dim: int, n: int) -> np.ndarray:
    """The first ``n`` Gaussian directions; more of them leave the first ones as they are."""
    return np.random.default_rng([SEED, dim]).normal(size=(n, dim))


def units(x: np.ndarray) -> np.ndarray:
    """Rows divided by their lengths; the largest component is taken out first, so that squares stay finite."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def grouped(batch: pa.RecordBatch) -> list[tuple[object, np.ndarray, np.ndarray]]:
    """(label, places, unit vectors) of the rows of a batch that share label and length."""
    labels, vecs = batch["label"].to_pylist(), batch["vec"].to_pylist()
    places: dict[tuple, list[int]] = {}
    for i, (label, v) in enumerate(zip(labels, vecs)):
        places.setdefault((label, len(v)), []).append(i)
    return [(label, np.array(at), units(np.array([vecs[i] for i in at], dtype=np.float64))) for (label, _), at in places.items()]


def angles(found: np.ndarray, label: object, centres: list[tuple]) -> np.ndarray:
    """Angle of every row to every centre; infinite where label or length differ."""
    out = np.full((len(found), len(centres)), np.inf)
    own = [c for c, (other, v) in enumerate(centres) if other == label and len(v) == found.shape[1]]
    if own:
        out[:, own] = np.arccos(np.clip(found @ np.array([centres[c][1] for c in own]).T, -1, 1))
    return out


def first_within(angle: np.ndarray, limit: float) -> np.ndarray:
    """First centre within ``limit``; -1 where none is."""
    near = angle <= limit
    return np.where(near.any(axis=1), near.argmax(axis=1), -1) if near.shape[1] else np.full(len(near), -1)


def with_balls(classes: DataFrame, plan: Plan) -> DataFrame:
    """``classes`` with ``ball``, a dense group around a centre, and ``open``, the balls whose members it may be linked with.

    Centres are at most CENTRES vectors, drawn by a hash, so that a group with a twentieth of all vectors is found with near
    certainty. A vector within half the threshold angle of a centre that has DENSE such vectors belongs to that ball: any two
    of a ball are linked, and further than one and a half times that angle from the centre nothing is linked with any of
    it. What lies between is open. A vector keeps balls before its own (or all of them, if it has none) as open.
    """
    drawn = classes.orderBy(F.xxhash64("cid", F.lit(SEED)), "cid").limit(CENTRES).select("label", "vec").collect()  # CENTRES rows
    centres = [(r.label, units(np.array([r.vec], dtype=np.float64))[0]) for r in drawn]
    near, far = plan.angle / 2 - SLACK, 1.5 * plan.angle + SLACK

    def count(batches):
        total = np.zeros(len(centres) + 1, dtype=np.int64)
        for b in batches:
            for label, _, u in grouped(b):
                np.add.at(total, first_within(angles(u, label, centres), near), 1)
        at = np.flatnonzero(total[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["c", "n"])

    sizes = classes.select("label", "vec").mapInArrow(count, "c bigint, n bigint").groupBy("c").agg(F.sum("n").alias("n"))
    dense = [centres[r.c] for r in sizes.where(F.col("n") >= DENSE).orderBy("c").collect()]  # CENTRES rows at most

    def place(batches):
        for b in batches:
            ball, open_ = np.full(len(b), -1, dtype=np.int32), np.zeros((len(b), CENTRES), dtype=bool)
            if dense:
                for label, at, u in grouped(b):
                    angle = angles(u, label, dense)
                    ball[at] = own = first_within(angle, near)
                    earlier = np.arange(len(dense)) < np.where(own < 0, len(dense), own)[:, None]
                    open_[at, : len(dense)] = (angle <= far) & earlier
            lists = [np.flatnonzero(o).astype(np.int32) if any_ else None for o, any_ in zip(open_, open_.any(axis=1))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ball), pa.array(lists, type=pa.list_(pa.int32()))], names=[*b.schema.names, "ball", "open"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in classes.schema)
    return classes.mapInArrow(place, f"{fields}, ball int, open array<int>")


def windows(general: DataFrame, plan: Plan) -> DataFrame:
    """Copies of vectors in the cells of nested sorts: strips of one projection, inside each strips of the next, and so on.

    A strip is as wide as two half-windows; a vector also lies in the strip next door if the middle between it and another vector
    in its window may. So any two vectors in each other's windows of all projections of an order meet in the cell of their middle.
    """
    sizes = general.groupBy("label", "dim").agg(F.count("*").alias("__n")).where("__n > 1")
    most = 48
    orders = F.array(*[F.lit(plan.orders(k)) for k in range(1, most + 1)])
    levels = F.least(F.lit(most), F.greatest(F.lit(1), F.ceil(F.log(F.col("__n") / CELL) / -log(LEFT)))).cast("int")
    sizes = scratch_table(sizes.select("label", "dim", levels.alias("levels")).withColumn("orders", F.element_at(orders, F.col("levels"))), "label-sizes")
    kind = general.schema["label"].dataType.simpleString()
    schema = f"label {kind}, dim int, levels int, orders int, ord int, cell binary, cid bigint, n bigint, ball int, open array<int>, vec binary, proj binary"

    def run(batches):
        for b in batches:
            levels, orders = (b[c].to_numpy() for c in ("levels", "orders"))
            for _, at, u in grouped(b):
                k, g = int(levels[at[0]]), int(orders[at[0]])
                proj = (u @ directions(u.shape[1], max(COUNTED, k * g)).T).astype(np.float32)
                reach = plan.half * np.float32(0.5001)
                low, high = (np.floor((proj[:, : k * g] + d) / plan.strip).astype(np.int16) for d in (-reach, reach))
                raw = np.array([b["vec"][int(i)].as_py() for i in at], dtype=np.float64)
                short = raw.astype(np.float32)
                raw = short if (short == raw).all() else raw
                for o in range(g):
                    row, cell = np.arange(len(at)), np.empty((len(at), 0), dtype=np.int16)
                    for c in range(o * k, o * k + k):
                        two = np.flatnonzero(high[row, c] > low[row, c])
                        cell = np.vstack([np.column_stack([cell, low[row, c]]), np.column_stack([cell[two], high[row[two], c]])])
                        row = np.append(row, row[two])
                    for first in range(0, len(row), 1000):
                        r, own = row[first : first + 1000], cell[first : first + 1000]
                        from_ = b.take(pa.array(at[r]))
                        yield pa.RecordBatch.from_arrays([
                            *(from_[c] for c in ("label", "dim", "levels", "orders")), pa.array(np.full(len(r), o, dtype=np.int32)), pa.array([x.tobytes() for x in own], type=pa.binary()),
                            *(from_[c] for c in ("cid", "n", "ball", "open")), pa.array([x.tobytes() for x in raw[r]], type=pa.binary()), pa.array([x.tobytes() for x in proj[r]], type=pa.binary()),
                        ], names=[c.split()[0] for c in schema.split(", ")])

    return general.join(sizes, ["label", "dim"]).mapInArrow(run, schema)


def colliding(left: np.ndarray, right: np.ndarray, same: bool, order: int, levels: int, cell: np.ndarray, plan: Plan):
    """(left places, right places), a chunk of the left at a time: pairs that belong to this cell and collide in enough windows.

    Rows are sorted by the first projection of the order, so that a chunk's windows are one slice. A pair belongs to the cell
    of its middle in the first order in which it meets, and so comes up once. Pairs that can't reach the least count any more are left.
    """
    half, strip, counted = plan.half, plan.strip, left.shape[1]
    own, least = range(order * levels, (order + 1) * levels), plan.least(counted)
    dense = min(counted, 12)
    for first in range(0, len(left), 128):
        chunk = left[first : first + 128]
        lo = np.searchsorted(right[:, own[0]], chunk[0, own[0]] - half * np.float32(1.001), side="left")
        hi = np.searchsorted(right[:, own[0]], chunk[-1, own[0]] + half * np.float32(1.001), side="right")
        if same:
            lo = max(lo, first + 1)
        if lo >= hi:
            continue
        facing = right[lo:hi]
        count = np.zeros((len(chunk), len(facing)), dtype=np.int16)
        for c in range(dense):
            count += np.abs(chunk[:, c, None] - facing[None, :, c]) <= half
        alive = count >= least - (counted - dense)
        if same:
            alive &= np.arange(lo, hi)[None, :] > np.arange(first, first + len(chunk))[:, None]
        p, q = np.nonzero(alive)
        n = count[p, q]
        for c in range(dense, counted):
            n = n + (np.abs(chunk[p, c] - facing[q, c]) <= half)
        keep = n >= least
        p, q = p[keep], q[keep]
        for c, at in zip(own, cell):
            x, y = chunk[p, c], facing[q, c]
            keep = (np.abs(x - y) <= half) & (np.floor((x + y) * np.float32(0.5) / strip) == at)
            p, q = p[keep], q[keep]
        for o in range(order):
            met = np.ones(len(p), dtype=bool)
            for c in range(o * levels, (o + 1) * levels):
                met &= np.abs(chunk[p, c] - facing[q, c]) <= half
            p, q = p[~met], q[~met]
        if len(p):
            yield first + p, lo + q


def links_of_cells(copies: DataFrame, plan: Plan) -> DataFrame:
    """(a, b, n): b's links found in a pair of blocks of a cell, as the number n of vectors behind them, and the smallest id a that they join it to."""
    cell = ["label", "dim", "ord", "cell"]
    sizes = scratch_table(copies.groupBy(*cell).agg(F.count("*").alias("__n")).where("__n > 1").select(*cell, F.ceil(F.col("__n") / BLOCK).cast("int").alias("blocks")), "cell-sizes")
    dealt = copies.join(sizes, cell).withColumn("blk", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least("blk", "other"), "j": F.greatest("blk", "other")})

    def run(rows: pa.Table) -> pa.Table:
        ids, blk, ball, weight = (rows[c].to_numpy() for c in ("cid", "blk", "ball", "n"))
        i, j, order, levels, dim = (rows[c][0].as_py() for c in ("i", "j", "ord", "levels", "dim"))
        strips = np.frombuffer(rows["cell"][0].as_py(), dtype=np.int16)
        proj = np.frombuffer(b"".join(rows["proj"].to_pylist()), dtype=np.float32).reshape(len(ids), -1)
        vec = np.array([np.frombuffer(v, dtype=np.float32 if len(v) == 4 * dim else np.float64) for v in rows["vec"].to_pylist()], dtype=np.float64)
        unit = units(vec)
        open_ = np.zeros((len(ids), CENTRES + 1), dtype=bool)
        for r, balls in enumerate(rows["open"].to_pylist()):
            if balls:
                open_[r, balls] = True
        order_of = np.argsort(proj[:, order * levels], kind="stable")
        sides = [order_of[blk[order_of] == x] for x in (i, j)]
        edges: list[tuple] = []
        links = np.zeros(len(ids), dtype=np.int64)
        by_id = np.argsort(ids)
        place = np.empty_like(by_id)
        place[by_id] = np.arange(len(ids))
        for p, q in colliding(proj[sides[0]], proj[sides[1]], i == j, order, levels, strips, plan):
            p, q = sides[0][p], sides[1][q]
            settled = np.minimum(np.where(ball[p] < 0, CENTRES, ball[p]), np.where(ball[q] < 0, CENTRES, ball[q]))
            outer = np.where(ball[p] == settled, q, p)
            asked = (settled == CENTRES) | ((ball[p] != ball[q]) & open_[outer, settled])
            p, q = p[asked], q[asked]
            linked = np.zeros(len(p), dtype=bool)
            for first in range(0, len(p), 1 << 14):
                part = slice(first, first + (1 << 14))
                linked[part] = np.einsum("ij,ij->i", unit[p[part]], unit[q[part]]) >= plan.cosine
            p, q = p[linked], q[linked]
            for x, y in ((p, q), (q, p)):
                links += np.bincount(x, weights=weight[y], minlength=len(ids)).astype(np.int64)
            a, b, _ = spanning(ids[by_id], place[p], place[q])
            edges.append((a, b))
        at = np.flatnonzero(links)
        joined = dict(zip(ids[at].tolist(), ids[at].tolist()))
        if edges:
            a, b = (np.concatenate(x) for x in zip(*edges))
            keys = ids[by_id]
            a, b, _ = spanning(keys, np.searchsorted(keys, a), np.searchsorted(keys, b))
            joined |= dict(zip(b.tolist(), a.tolist()))
        return pa.table({"a": pa.array([joined[x] for x in ids[at].tolist()], type=pa.int64()), "b": pa.array(ids[at], type=pa.int64()), "n": pa.array(links[at], type=pa.int64())})

    columns = [*cell, "i", "j", "blk", "levels", "cid", "n", "ball", "open", "vec", "proj"]
    return dealt.select(columns).groupBy(*cell, "i", "j").applyInArrow(run, "a bigint, b bigint, n bigint")


def vector_duplicates(vectors: DataFrame, cosine: float = COSINE, miss: float = MISS, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """key, n_links, component_id, kept for every row of ``vectors``; other columns are not looked at.

    Rows with equal labels are linked at a cosine of ``cosine`` or more, in double precision; rows whose key or label is null, or
    whose vector is null, empty, zero or holds null or non-finite components, with nothing. A pair of vectors at the least
    cosine is missed with chance ``miss``, any closer pair with less; no pair below it is linked. n_links counts the other rows linked
    directly, component_id is the smallest key reachable and kept marks it; a null key gives a null component that is kept. Rows with
    one key are vectors of their own.

    Rows with equal label and vector are one class from the start, and any two vectors of a dense group around a centre (see
    with_balls) are known to be linked, so a group of copies or near copies costs linear work. All others are sorted by projections
    in nested orders, in as many as the chance of a miss asks for; pairs in one cell are counted in all windows and those that
    collide often enough are compared exactly. Large cells are tested block against block; a pair of blocks sends one row a vector.
    """
    plan = Plan(cosine, miss)
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vec"))
    able = F.expr("id is not null and label is not null and size(vec) > 0 and forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(vec, x -> x <> 0)")
    rows = rows.withColumn("able", F.coalesce(able, F.lit(False)))
    classes = rows.where("able").groupBy("label", "vec").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    classes = scratch_table(classes.select("*", F.size("vec").alias("dim"), F.monotonically_increasing_id().alias("cid")), "vector-classes")
    placed = scratch_table(with_balls(classes, plan), "vector-balls")
    opened = [r.b for r in placed.select(F.explode("open").alias("b")).distinct().collect()]  # CENTRES numbers at most
    general = placed.where((F.col("ball") < 0) | F.col("ball").isin(opened) | F.col("open").isNotNull())
    found = scratch_table(links_of_cells(scratch_table(windows(general, plan), "vector-windows"), plan), "vector-links")
    balls = placed.where("ball >= 0").groupBy("ball").agg(F.sum("n").alias("members"), F.min("cid").alias("least"))
    balls = F.broadcast(balls)  # CENTRES rows at most
    inside = placed.join(balls, "ball").select(F.col("least").alias("a"), F.col("cid").alias("b"))
    edges = scratch_table(found.select("a", "b").unionByName(inside).where("a <> b").distinct(), "vector-edges")
    comp = components(edges).withColumnRenamed("doc", "cid")
    links = found.groupBy(F.col("b").alias("cid")).agg(F.sum("n").alias("links"))
    joined = placed.join(links, "cid", "left").join(balls, "ball", "left").join(comp, "cid", "left")
    known = joined.select(
        "label", "vec", "first", F.coalesce("comp", "cid").alias("comp"),
        (F.col("n") - 1 + F.coalesce("links", F.lit(0)) + F.coalesce(F.col("members") - F.col("n"), F.lit(0))).alias("n_links"))
    known = scratch_table(known, "vector-known")
    known = known.join(scratch_table(known.groupBy("comp").agg(F.min("first").alias("component_id")), "vector-components"), "comp").drop("comp", "first")
    out = rows.where("able").drop("able").join(known, ["label", "vec"]).select("id", "n_links", "component_id")
    out = out.unionByName(rows.where("not able").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))).withColumnRenamed("id", key)
