"""Vectors shared by the two searches: which rows take part, repeated vectors, blocks for matrix products."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def usable(vectors: DataFrame, key: str, vector: str, zero: bool) -> DataFrame:
    """(id, vec as doubles, dim) of the rows that take part: a key, at least one component, all finite; zero vectors if ``zero``."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vec")).where("id is not null and size(vec) > 0")
    rows = rows.where("forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    if not zero:
        rows = rows.where("exists(vec, x -> x <> 0)")
    return rows.withColumn("dim", F.size("vec"))


def first_copies(rows: DataFrame, n: int) -> DataFrame:
    """The ``n`` smallest ids of every vector. Ties go to smaller ids, so a search for fewer than ``n`` rows needs no other copies."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).where(F.col("__n") <= n).drop("__n")


def in_blocks(rows: DataFrame, group: list[str], most: int, name: str, *more: str) -> DataFrame:
    """Rows of (group, name, id, vec, more...) packed into about ``most`` rows a block, dealt by a hash of id.

    Result: group, the number of the block in column ``name``, and the array ``name``_rows of structs.
    """
    sizes = rows.groupBy(*group).agg(F.ceil(F.count("*") / most).cast("int").alias("__k"))
    dealt = rows.join(sizes, group).withColumn(name, F.pmod(F.xxhash64("id"), F.col("__k")).cast("int"))
    return dealt.groupBy(*group, name).agg(F.collect_list(F.struct("id", "vec", *more)).alias(f"{name}_rows"))


def matrix(structs: pa.StructArray, field: str = "vec") -> np.ndarray:
    """A list column of equal lengths as a matrix of doubles."""
    x = structs.field(field)
    return x.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(x), -1)


def best_of_rows(scores: np.ndarray, k: int) -> np.ndarray:
    """For each row, flags of all entries that reach its k-th largest value."""
    if scores.shape[1] <= k:
        return np.isfinite(scores)
    edge = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
    return (scores >= edge[:, None]) & np.isfinite(scores)


def head(query: np.ndarray, ident: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best entries of every query: higher scores first, then smaller ids."""
    order = np.lexsort((ident, -score, query))
    q = query[order]
    start = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1]))) if len(q) else np.empty(0, dtype=np.int64)
    place = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
    return order[place < k]
