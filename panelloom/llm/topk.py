"""Exact top-k search: every score is counted into histograms that are refined until each query's k-th score is known."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_table
from .vectors import first_copies, head, in_blocks, matrix, usable

SCALE, BINS = 1024, 256
#: Rows of a block of queries and of candidates.
QUERY_BLOCK, BLOCK = 1024, 4096
#: Sums of integer products below this are exact in double precision.
EXACT = 2.0**53
#: Bound on scores: the ends of a range, and their distance, then fit 64 bits.
LARGEST = 2.0**61
#: Score of a pair that is none.
NONE = np.iinfo(np.int64).min


def quantised(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """Components become floor(scale * x), kept as doubles that hold integers."""
    return rows.withColumn("vec", F.transform("vec", lambda x: F.floor(F.lit(float(scale)) * x).cast("double")))


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products, as 64-bit integers, of the rows of two matrices of doubles that hold integers.

    Beyond double precision the sums run modulo 2**64, which leaves every result below LARGEST exact whatever its terms are.
    """
    if q.shape[1] * np.abs(q).max(initial=0) * np.abs(c).max(initial=0) < EXACT:
        return (q @ c.T).astype(np.int64)
    return q.astype(np.int64) @ c.astype(np.int64).T


def reaching(scores: np.ndarray, k: int) -> np.ndarray:
    """For each row, flags of all pairs that reach its k-th largest score."""
    edge = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k] if scores.shape[1] > k else np.full(len(scores), NONE)
    return (scores >= edge[:, None]) & (scores > NONE)


def top_k(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of ``vectors`` with the highest integer inner product for each row of ``queries``.

    Components x count as floor(scale * x); a query's own id is no candidate; ties go to smaller ids; fewer rows where there
    are fewer candidates. Vectors that are null, empty or hold null or non-finite components take no part; vectors of another
    length are no candidates. Of equal vectors only the k + 1 smallest ids are candidates, as no other can be returned. Equal
    rows count once. An id with several vectors is a candidate with each of them, and asks with its shortest (of these, the least).
    Scores are exact 64-bit integers; ValueError if the lengths of the vectors allow one of LARGEST or more.

    Each round scores all candidates block against block and adds up, per query, the counts of BINS bins over the range in
    which its k-th score lies (at first the range that the lengths of the vectors allow); the bin with the k-th score is the next
    range, until bins are one wide. A block sends the bins of its own k best scores only: where fewer than k scores lie above
    a bin, no block has left any of them out. A last round keeps what reaches the k-th score. Scores are never stored.
    """
    cand = first_copies(quantised(usable(vectors, key, vector, zero=True), scale).dropDuplicates(["id", "vec"]), k + 1)
    blocks = scratch_table(in_blocks(cand, ["dim"], BLOCK, "cblk"), "candidates")
    asked = quantised(usable(queries, key, vector, zero=True), scale).groupBy("id").agg(F.min(F.struct("dim", "vec")).alias("own")).select("id", "own.*")
    norm = F.expr("sqrt(aggregate(vec, 0D, (s, x) -> s + x * x))")
    longest = cand.groupBy("dim").agg(F.max(norm).alias("longest"))
    reach = F.ceil(F.least(norm * F.col("longest") * (1 + 1e-9), F.lit(LARGEST)) + 1)
    bounded = asked.join(longest, "dim").withColumn("fits", norm * F.col("longest") < LARGEST)
    state = scratch_table(bounded.select(
        "dim", "id", "vec", "fits", (-reach).alias("lo"), (reach + 1).alias("hi"), F.floor(reach / (BINS // 2) + 1).alias("width"), F.lit(0).cast("long").alias("above")), "ranges")
    if not state.where("not fits").isEmpty():
        raise ValueError(f"inner products may reach {LARGEST:.0f}; take a smaller scale than {scale}")
    state = state.drop("fits")
    where = blocks.select("dim", "cblk")

    def score(rows, use):
        packed = in_blocks(rows, ["dim"], QUERY_BLOCK, "qblk", "lo", "hi", "width").join(where, "dim")
        pairs = packed.join(blocks, ["dim", "cblk"]).select("qblk_rows", "cblk_rows")

        def run(batches):
            for b in batches:
                found = []
                for q, c in zip(b["qblk_rows"], b["cblk_rows"]):
                    q, c = q.values, c.values
                    qid, cid = q.field("id").to_numpy(), c.field("id").to_numpy()
                    s = products(matrix(q), matrix(c))
                    s[qid[:, None] == cid[None, :]] = NONE
                    found.append(use(s, qid, cid, *(q.field(x).to_numpy() for x in ("lo", "hi", "width"))))
                cols = [np.concatenate(x) for x in zip(*found)] if found else [np.empty(0, dtype=np.int64)] * 3
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in cols], names=["query_id", "x", "y"])

        return pairs.mapInArrow(run, "query_id bigint, x bigint, y bigint")

    def count(s, qid, cid, lo, hi, width):
        i, j = np.nonzero(reaching(s, k))
        place = (s[i, j] - lo[i]) // width[i]
        own = (place >= 0) & (s[i, j] < hi[i])
        cell, n = np.unique(i[own] * BINS + place[own], return_counts=True)
        return qid[cell // BINS], cell % BINS, n

    def keep(s, qid, cid, lo, hi, width):
        i, j = np.nonzero(reaching(s, k) & (s >= lo[:, None]))
        first = head(i, cid[j], s[i, j], k)
        return qid[i[first]], cid[j[first]], s[i[first], j[first]]

    falling = Window.partitionBy("id").orderBy(F.desc("bin"))
    while not state.where("width > 0").isEmpty():
        open_ = state.where("width > 0")
        cells = score(open_, count).groupBy(F.col("query_id").alias("id"), F.col("x").alias("bin")).agg(F.sum("y").alias("n"))
        sums = cells.join(open_.select("id", "above"), "id").withColumn("upto", F.sum("n").over(falling) + F.col("above"))
        kth = sums.where(F.col("upto") >= k).groupBy("id").agg(F.max_by(F.struct("bin", (F.col("upto") - F.col("n")).alias("above")), "bin").alias("hit"))
        state = state.join(kth, "id", "left").select(
            "dim", "id", "vec",
            # fewer than k candidates: everything is wanted and the range stays as it is
            F.when(F.col("hit").isNotNull(), F.col("lo") + F.col("hit.bin") * F.col("width")).otherwise(F.col("lo")).alias("lo"),
            F.when(F.col("hit").isNotNull(), F.least("hi", F.col("lo") + (F.col("hit.bin") + 1) * F.col("width"))).otherwise(F.col("hi")).alias("hi"),
            F.when(F.col("hit").isNotNull() & (F.col("width") > 1), F.expr(f"(width + {BINS - 1}) div {BINS}")).otherwise(F.lit(0)).cast("long").alias("width"),
            F.coalesce("hit.above", "above").alias("above"),
        )
        state = scratch_table(state, "ranges")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    rows = score(state, keep).select("query_id", F.col("x").alias("vec_id"), F.col("y").alias("score"))
    return rows.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
