"""Approximate nearest neighbours: multiprobe p-stable hashing with exact reranking."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_table
from .vectors import best_of_rows, head, in_blocks, matrix, usable

#: Tables, hash functions of a table, width of a slot (in units of the longest vector), buckets visited in each table.
TABLES, FUNCTIONS, WIDTH, PROBES, SEED = 8, 6, 2.0, 32, 1212
BLOCK, QUERY_BLOCK = 4096, 1024


def draws(dim: int, tables: int, functions: int, width: float, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Gaussian (2-stable) directions for vectors of ``dim`` + 1 components, and offsets."""
    rng = np.random.default_rng([seed, dim])
    return rng.normal(size=(dim + 1, tables * functions)), rng.uniform(0, width, tables * functions)


def lifted(x: np.ndarray, longest: float, query: bool) -> np.ndarray:
    """One more component, such that the largest inner product is the smallest distance: candidates get equal length, queries are scaled to it."""
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    if query:
        return np.hstack([x / norm, np.zeros((len(x), 1))])
    x, norm = x / longest, norm / longest
    return np.hstack([x, np.sqrt(np.maximum(0, 1 - norm * norm))])


def probe_order(inside: np.ndarray, probes: int) -> list[list[tuple[int, int]]]:
    """Perturbations (function, step) of the buckets to visit, the likeliest first; ``inside`` is where in its slot each hash lies, 0 to 1.

    A step's cost is the squared distance to the border it crosses; sets of steps come out of a heap by their sum of costs.
    """
    steps = sorted((float(f if s < 0 else 1 - f) ** 2, i, s) for i, f in enumerate(inside) for s in (-1, 1))
    out: list[list[tuple[int, int]]] = [[]]
    heap = [(steps[0][0], (0,))]
    while heap and len(out) < probes:
        cost, chosen = heapq.heappop(heap)
        functions = [steps[i][1] for i in chosen]
        if len(set(functions)) == len(functions):
            out.append([steps[i][1:] for i in chosen])
        last = chosen[-1]
        if last + 1 < len(steps):
            heapq.heappush(heap, (cost + steps[last + 1][0], (*chosen, last + 1)))
            heapq.heappush(heap, (cost - steps[last][0] + steps[last + 1][0], (*chosen[:-1], last + 1)))
    return out


def hashed(rows: DataFrame, longest: float, query: bool, tables: int, functions: int, width: float, probes: int) -> DataFrame:
    """(id, dim, vec) -> the same with tbl and bucket: one row a table, or one a visited bucket for queries."""

    def run(batches):
        for whole in batches:
            dims = whole["dim"].to_numpy()
            for dim in np.unique(dims):
                own = np.flatnonzero(dims == dim)
                b = whole.take(pa.array(own))
                x = b["vec"].flatten().to_numpy(zero_copy_only=False).reshape(len(own), dim)
                a, shift = draws(int(dim), tables, functions, width)
                y = ((lifted(x, longest, query) @ a + shift) / width).reshape(len(own), tables, functions)
                slots = np.floor(y).astype(np.int32)
                row, table, bucket = [], [], []
                for i in range(len(own)):
                    for t in range(tables):
                        for steps in probe_order(y[i, t] - slots[i, t], probes) if query else [[]]:
                            s = slots[i, t].copy()
                            for f, way in steps:
                                s[f] += way
                            row.append(i)
                            table.append(t)
                            bucket.append(s.tobytes())
                out = b.take(pa.array(row, type=pa.int64()))
                yield pa.RecordBatch.from_arrays([out["id"], out["dim"], out["vec"], pa.array(table, type=pa.int32()), pa.array(bucket, type=pa.binary())], names=["id", "dim", "vec", "tbl", "bucket"])

    return rows.select("id", "dim", "vec").mapInArrow(run, "id bigint, dim int, vec array<double>, tbl int, bucket binary")


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding",
    tables: int = TABLES, functions: int = FUNCTIONS, width: float = WIDTH, probes: int = PROBES,
) -> DataFrame:
    """query_id, rank, vec_id, score: about the k rows of ``vectors`` with the largest inner product for each row of ``queries``.

    Vectors are lifted to equal length, so that the largest inner product is the smallest distance, and hashed in ``tables`` tables
    by ``functions`` p-stable functions each. A query visits ``probes`` buckets of each table in the order of estimated success;
    everything found there is scored. A query that finds fewer than k candidates this way is compared with all rows.
    Scores are sums of products in component order in double precision; a query's own id is no candidate; ties go to smaller ids.

    Null, empty, zero and non-finite vectors take no part; vectors of another length are no candidates. Equal vectors are
    hashed and scored once; their k + 1 smallest ids stand for all copies, as no other can be returned. Buckets are
    scored in blocks, whatever their size, and a task merges what its blocks find before sending it on.
    """
    rows = usable(vectors, key, vector, zero=False)
    classes = rows.withColumn("__n", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).where(F.col("__n") <= k + 1)
    classes = scratch_table(classes.groupBy("dim", "vec").agg(F.min("id").alias("id"), F.sort_array(F.collect_list("id")).alias("ids")), "classes")
    asked = scratch_table(usable(queries, key, vector, zero=False).dropDuplicates(["id"]).join(classes.select("vec", F.col("id").alias("cls")), "vec", "left").select(
        F.col("id").alias("query_id"), F.coalesce("cls", "id").alias("cls"), "dim", "vec"), "queries")
    wanted = asked.groupBy("dim", "vec").agg(F.min("cls").alias("id"))
    longest = classes.agg(F.max(F.expr("sqrt(aggregate(vec, 0D, (s, x) -> s + x * x))"))).first()[0] or 1.0

    def scored(pairs):
        def run(batches):
            for b in batches:
                found = []
                for q, c in zip(b["qblk_rows"], b["cblk_rows"]):
                    q, c = q.values, c.values
                    qid, cid = q.field("id").to_numpy(), c.field("id").to_numpy()
                    s = matrix(q) @ matrix(c).T
                    i, j = np.nonzero(best_of_rows(s, k + 1))
                    found.append((qid[i], cid[j], s[i, j]))
                q, c, s = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, dtype=np.int64),) * 3
                # tables overlap: one entry a pair, then the best of each query, with room for equal scores
                _, first = np.unique(np.stack([q, c]), axis=1, return_index=True) if len(q) else (None, np.empty(0, dtype=np.int64))
                at = first[head(q[first], c[first], s[first], 2 * (k + 1))]
                # one list a query: entries lie together by query, best first
                start = np.flatnonzero(np.concatenate(([True], q[at][1:] != q[at][:-1]))) if len(at) else np.empty(0, dtype=np.int64)
                entries = pa.StructArray.from_arrays([pa.array(c[at]), pa.array(-s[at].astype(float))], names=["c", "n"])
                lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(at)), type=pa.int32()), entries)
                yield pa.RecordBatch.from_arrays([pa.array(q[at][start]), lists], names=["q", "found"])

        return pairs.select("qblk_rows", "cblk_rows").mapInArrow(run, "q bigint, found array<struct<c: bigint, n: double>>")

    def leading(rows):
        """(q, c): the best of each query by the scores of matrix products, with room for their rounding, before vectors are joined again."""
        sorted_ = rows.groupBy("q").agg(F.array_sort(F.flatten(F.collect_list("found"))).alias("a"))
        # a pair found twice may differ in its last bits: one entry a candidate, then the cut on scores as they are
        once = F.expr("filter(a, (x, i) -> i = 0 or x.c <> a[greatest(i - 1, 0)].c)")
        merged = F.slice(F.array_sort(F.transform(once, lambda x: F.struct(x["n"].alias("n"), x["c"].alias("c")))), 1, 2 * (k + 1))
        return sorted_.select("q", F.explode(merged).alias("x")).select("q", F.col("x.c").alias("c")).distinct()

    cells = ["dim", "tbl", "bucket"]
    held = in_blocks(hashed(classes, longest, False, tables, functions, width, 1), cells, BLOCK, "cblk")
    visits = in_blocks(hashed(wanted, longest, True, tables, functions, width, probes), cells, QUERY_BLOCK, "qblk")
    found = scratch_table(leading(scored(visits.join(held, cells))), "found")

    weight = classes.select(F.col("id").alias("c"), F.size("ids").alias("n"))
    reached = found.join(weight, "c").groupBy("q").agg(F.sum("n").alias("n"))
    few = wanted.join(reached.where(F.col("n") > k).select(F.col("q").alias("id")), "id", "left_anti")
    everything = scored(in_blocks(few, ["dim"], QUERY_BLOCK, "qblk").join(in_blocks(classes, ["dim"], BLOCK, "cblk"), "dim"))
    found = found.unionByName(leading(everything)).distinct()

    left = found.join(wanted.select(F.col("id").alias("q"), F.col("vec").alias("qv")), "q")
    both = left.join(classes.select(F.col("id").alias("c"), F.col("vec").alias("cv"), "ids"), "c")
    exact = F.aggregate(F.zip_with("qv", "cv", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    best = Window.partitionBy("q").orderBy(F.desc("score"), "c")
    both = both.select("q", "c", "ids", exact.alias("score")).withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1)
    out = asked.select("query_id", F.col("cls").alias("q")).join(both, "q").select("query_id", F.explode("ids").alias("vec_id"), "score").where("query_id <> vec_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
