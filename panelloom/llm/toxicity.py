"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, labelled_texts, slices, small_batches

ORDERS, BITS, FEATURES, PER_CLASS, SEED = (3, 4, 5, 6), 20, 1 << 11, 3000, 83
_SPREAD = U64(0x9E3779B97F4A7C15)
_BASE = U64(0xD6E8FEB86659FD93)
#: Characters of a text that are hashed at once.
WINDOW = 1 << 17
_FOLD = np.array([32 if chr(i).isspace() else i for i in range(0x3001)], dtype=np.uint32)


def ngram_buckets(data: np.ndarray, bits: int = BITS) -> Iterator[np.ndarray]:
    """Hash buckets of the n-grams of characters of one UTF-8 text, lower case, white space as spaces, a space around it; with repeats.

    Long texts are hashed in windows of WINDOW characters that overlap, so that no n-gram is lost.
    """
    codes = np.frombuffer(f" {data.tobytes().decode('utf-8', 'replace').lower()} ".encode("utf-32-le", "replace"), dtype=np.uint32)
    for at in range(0, len(codes), WINDOW):
        part = codes[at : at + WINDOW + max(ORDERS) - 1]
        part = np.where(part < len(_FOLD), _FOLD[np.minimum(part, len(_FOLD) - 1)], part).astype(np.uint64)
        rolled = part
        for n in range(2, max(ORDERS) + 1):
            rolled = rolled[:-1] * _BASE + part[n - 1 :]
            if len(rolled) == 0:
                break
            if n in ORDERS:
                yield ((rolled[:WINDOW] * _SPREAD) >> U64(64 - bits)).view(np.int64)


def present(texts: pa.Array | pa.ChunkedArray, bits: int = BITS, wanted: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """Sorted distinct n-gram buckets of each text, in row order; only those with a true flag in ``wanted``, if given."""
    none = np.empty(0, dtype=np.int64)
    for _, data, offsets in slices(texts):
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            found = ngram_buckets(data[a:b], bits) if b > a else []
            found = [f if wanted is None else f[wanted[f]] for f in found]
            yield np.unique(np.concatenate(found)) if found else none


@dataclass
class NaiveBayesLinear:
    """Weight of each bucket's presence, and an intercept; a text without n-grams gets the intercept alone."""

    weight: np.ndarray  # float32, 2**BITS, zero for buckets that were not selected
    intercept: float

    @property
    def learnt(self) -> bool:
        """False if no n-gram has a weight: all texts then score the share of label 1, which tells nothing about any of them."""
        return bool(self.weight.any())

    def scores(self, texts: pa.Array | pa.ChunkedArray) -> np.ndarray:
        bits = int(np.log2(len(self.weight)))
        raw = np.array([self.weight[f].sum(dtype=np.float64) for f in present(texts, bits, self.weight != 0)], dtype=np.float64)
        return 1 / (1 + np.exp(-np.clip(raw + self.intercept, -40, 40)))


def _logistic(x: list[np.ndarray], r: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 2e-4, steps: int = 12, inner: int = 20) -> tuple[np.ndarray, float]:
    """Ridge logistic regression on presence times ``r``: Newton steps by conjugate gradients over a row-compressed matrix."""
    n, d = len(x), len(r)
    row = np.repeat(np.arange(n), [len(f) for f in x])
    col = np.concatenate(x).astype(np.int64)
    val, weight = r[col], weight / weight.sum()

    def forward(w):
        return np.bincount(row, val * w[col], minlength=n) + w[d]

    def backward(g):
        return np.append(np.bincount(col, val * g[row], minlength=d), g.sum())

    ridge = np.append(np.full(d, l2), 0.0)
    w = np.zeros(d + 1)
    w[d] = np.log((weight @ y + 1e-6) / (weight @ (1 - y) + 1e-6))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(forward(w), -40, 40)))
        left = -(backward(weight * (p - y)) + ridge * w)
        curve = weight * p * (1 - p) + 1e-9
        step, way, size = np.zeros(d + 1), left.copy(), left @ left
        goal = 1e-4 * size
        for _ in range(inner):
            if size <= goal:
                break
            turned = backward(curve * forward(way)) + ridge * way
            a = size / (way @ turned)
            step += a * way
            left -= a * turned
            size, last = left @ left, size
            way = left + size / last * way
        w += step / max(1.0, np.abs(forward(step)).max() / 8)
    return w[:d], float(w[d])


def fit_toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0, per_class: int = PER_CLASS, bits: int = BITS, features: int = FEATURES) -> NaiveBayesLinear:
    """Classifier learnt from at most ``per_class`` labelled documents of each class outside the hold-out.

    Executors count in how many documents of each class a bucket occurs (partial counts of at most 2**bits buckets a
    task) and keep the ``features`` buckets with the strongest log-count ratio, in standard errors; only these reach the driver.
    Then each sampled document sends only its kept buckets. Class weights restore the frequencies of the whole label table.
    Without labels of both classes, or without an n-gram in three labelled documents, nothing is learnt: all scores are the
    share of label 1 among the labels outside the hold-out, 0 without labels.
    """
    sample, sizes = labelled_texts(docs, labels, "toxic", modulus, held, per_class, SEED)

    def counted(batches):
        counts = np.zeros((2, 1 << bits), dtype=np.int32)
        for b in batches:
            for y, f in zip(b["y"].to_pylist(), present(b["text"], bits)):
                counts[y, f] += 1
        at = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_pydict({"f": at, "n0": counts[0, at].astype(np.int64), "n1": counts[1, at].astype(np.int64)})

    taken = {r[0]: r[1] for r in sample.groupBy("y").count().collect()}
    t0, t1 = taken.get(0, 0), taken.get(1, 0)
    ratio = F.log((F.col("n1") + 1) / (t1 + 2) / ((F.col("n0") + 1) / (t0 + 2)))
    strength = F.abs(ratio) / F.sqrt(1 / (F.col("n0") + 1) + 1 / (F.col("n1") + 1))
    counts = (
        sample.mapInArrow(counted, "f bigint, n0 bigint, n1 bigint").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
        .where("n0 + n1 >= 3").orderBy(strength.desc(), "f").limit(features).toArrow().sort_by("f")
    )
    if len(taken) < 2 or len(counts) == 0:
        zeros, ones = sizes.get(0, 0), sizes.get(1, 0)
        prior = np.log(ones / zeros) if zeros and ones else 40.0 if ones else -40.0
        return NaiveBayesLinear(np.zeros(1 << bits, dtype=np.float32), float(prior))
    bucket, n0, n1 = (counts[c].to_numpy() for c in ("f", "n0", "n1"))
    ratio = np.log(((n1 + 1) / (t1 + 2)) / ((n0 + 1) / (t0 + 2)))
    slot = np.full(1 << bits, -1, dtype=np.int32)
    slot[bucket] = np.arange(len(bucket))
    wanted = slot >= 0

    def selected(batches):
        for b in batches:
            found = [slot[f].astype(">u4").tobytes() for f in present(b["text"], bits, wanted)]
            yield pa.RecordBatch.from_arrays([b["y"], pa.array(found, type=pa.binary())], names=["y", "x"])

    # packed numbers: lists of them, as Python objects, took a good part of the driver's memory; big-endian bytes sort as the numbers do
    packed = sample.mapInArrow(selected, "y int, x binary").toArrow().sort_by([("y", "ascending"), ("x", "ascending")])
    y = packed["y"].to_numpy().astype(float)
    share = np.array([sizes[0] / t0, sizes[1] / t1])
    w, b = _logistic([np.frombuffer(v.as_buffer(), dtype=">u4").astype(np.int32) for v in packed["x"]], ratio, y, share[y.astype(int)])
    weight = np.zeros(1 << bits, dtype=np.float32)
    weight[bucket] = w * ratio
    return NaiveBayesLinear(weight, float(b))


def score_toxicity(docs: DataFrame, model: NaiveBayesLinear, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with the probability that toxic is 1, from the whole text; a null text scores like an empty one.

    Extra columns pass through; a column called ``into`` is replaced.
    """

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(pa.array(texts, type=pa.large_string(), from_pandas=True)), index=texts.index)

    return small_batches(docs).withColumn(into, score(F.col(text)))
