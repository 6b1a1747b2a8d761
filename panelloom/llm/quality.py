"""Quality scores: histogram gradient-boosted trees over document statistics, walked as flat arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, labelled_texts, slices, small_batches, word_hashes, word_spans

STATISTICS = (
    "log_chars", "log_words", "mean_word", "sd_word", "longest_word", "lower", "upper", "digit", "space", "mark", "other",
    "distinct_words", "top_word", "distinct_pairs", "same_as_last", "log_lines", "distinct_lines", "mean_line", "no_letter_words",
    "upper_words", "marked_words", "closed_lines", "char_entropy",
)
PER_CLASS, MAX_BINS, TREES, DEPTH, RATE, L2, MIN_ROWS = 8000, 64, 60, 4, 0.2, 1.0, 8
SEED = 61


def _kinds() -> np.ndarray:
    """Kind of each byte: 0 lower-case letter (and all beyond ASCII), 1 upper-case, 2 digit, 3 white space, 4 mark, 5 other."""
    out = np.zeros(256, dtype=np.uint8)
    for b in range(128):
        c = chr(b)
        out[b] = 1 if c.isupper() else 0 if c.isalpha() else 2 if c.isdigit() else 3 if c.isspace() else 4 if c.isprintable() else 5
    return out


_KINDS = _kinds()
_CLOSING = np.frombuffer(b".!?\"'", dtype=np.uint8)


def _runs(hashes: np.ndarray) -> np.ndarray:
    """Number of occurrences of each distinct hash."""
    if len(hashes) == 0:
        return np.zeros(0, dtype=np.int64)
    at = np.flatnonzero(np.diff(np.sort(hashes))) + 1
    return np.diff(np.concatenate(([0], at, [len(hashes)])))


def statistics(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> list[float]:
    """STATISTICS of one whole text from its bytes, word spans and word hashes; all zero for an empty one."""
    n, words = len(data), len(starts)
    if n == 0:
        return [0.0] * len(STATISTICS)
    kinds = _KINDS[data]
    m, lengths = max(words, 1), ends - starts
    seen = np.bincount(data, minlength=256)
    share = seen[seen > 0] / n
    counts, pairs = _runs(hashes), _runs(hashes[:-1] * U64(3) + hashes[1:])
    # lines: spans between line feeds that hold a word
    feeds = np.concatenate(([-1], np.flatnonzero(data == 10), [n]))
    first = np.unique(np.searchsorted(starts, feeds[:-1]))
    first = first[first < words]
    lines = max(len(first), 1)
    total = np.concatenate(([0], np.cumsum(hashes * (np.arange(words, dtype=np.uint64) * U64(2) + U64(1)))))
    position = np.concatenate(([0], np.cumsum(hashes)))
    last = np.append(first[1:], words)
    # the hash of a line is a sum over its words by place in the line
    line = total[last] - total[first] - (position[last] - position[first]) * (first.astype(np.uint64) * U64(2)) if words else total[:0]
    if words:
        letters = np.concatenate(([0], np.cumsum(kinds < 2, dtype=np.int64)))
        lower = np.concatenate(([0], np.cumsum(kinds == 0, dtype=np.int64)))
        no_letter = (letters[ends] == letters[starts]).mean()
        upper = ((letters[ends] - letters[starts] > 1) & (lower[ends] == lower[starts])).mean()
        marked = ((lengths > 2) & (kinds[ends - 1] >= 4) & (kinds[np.maximum(ends - 2, 0)] >= 4)).mean()
        closed = np.isin(data[ends[last - 1] - 1], _CLOSING).mean()
    else:
        lengths, no_letter, upper, marked, closed = np.zeros(1), 0.0, 0.0, 0.0, 0.0
    return [
        np.log1p(n), np.log1p(words), lengths.mean(), lengths.std(), lengths.max(), *(np.bincount(kinds, minlength=6) / n),
        len(counts) / m, counts.max(initial=0) / m, len(pairs) / max(words - 1, 1), (hashes[1:] == hashes[:-1]).sum() / m,
        np.log1p(lines), len(_runs(line)) / lines, n / lines, no_letter, upper, marked, closed, float(-(share * np.log2(share)).sum()),
    ]


def statistics_matrix(texts: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """One row of STATISTICS a text; a null text counts as empty."""
    rows = []
    for _, data, offsets in slices(texts):
        starts, ends, at = word_spans(data, offsets)
        hashes = word_hashes(data, starts, ends)
        for k in range(len(offsets) - 1):
            own = slice(at[k], at[k + 1])
            a = offsets[k]
            rows.append(statistics(data[a : offsets[k + 1]], starts[own] - a, ends[own] - a, hashes[own]))
    return np.array(rows, dtype=np.float64).reshape(-1, len(STATISTICS))


@dataclass
class BoostedTrees:
    """Complete binary trees of one depth in heap order: node i has children 2i+1 and 2i+2; a row goes right when its value exceeds the threshold."""

    start: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray  # trees x inner nodes; +inf sends all rows left
    leaf: np.ndarray  # trees x leaves

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for every row, all trees at once."""
        trees, inner = self.feature.shape
        rows, t = np.arange(len(x))[:, None], np.arange(trees)[None, :]
        node = np.zeros((len(x), trees), dtype=np.int64)
        for _ in range(int(np.log2(inner + 1))):
            node = 2 * node + 1 + (x[rows, self.feature[t, node]] > self.threshold[t, node])
        return 1 / (1 + np.exp(-(self.start + self.leaf[t, node - inner].sum(axis=1))))


def fit_trees(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees=TREES, depth=DEPTH, rate=RATE, l2=L2, max_bins=MAX_BINS, min_rows=MIN_ROWS) -> BoostedTrees:
    """Logistic boosting: values are binned once at quantiles, gain is read off per-node histograms of gradients."""
    inner, leaves, n, d = 2**depth - 1, 2**depth, len(x), x.shape[1]
    start = float(np.log((weight @ y + 1) / (weight @ (1 - y) + 1))) if n else 0.0
    model = BoostedTrees(start, np.zeros((trees, inner), dtype=np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves)))
    if n == 0 or y.min() == y.max():
        return model
    edges = [np.unique(np.quantile(x[:, j], np.arange(1, max_bins) / max_bins, method="lower")) for j in range(d)]
    bins = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)  # value <= edge[b] has bin <= b
    flat = bins + np.arange(d) * max_bins
    raw = np.full(n, start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = weight * (y - p), weight * p * (1 - p)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            key = ((node - first)[:, None] * (d * max_bins) + flat).ravel()
            shape = (width, d, max_bins)
            sums = [np.bincount(key, np.repeat(v, d), minlength=width * d * max_bins).reshape(shape).cumsum(axis=2) for v in (g, h, np.ones(n))]
            (gl, hl, cl), (gt, ht, ct) = sums, [s[:, :, -1:] for s in sums]
            gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
            gain[(cl < min_rows) | (ct - cl < min_rows)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            for k in range(width):
                j, b = divmod(int(best[k]), max_bins)
                if gain[k, j, b] > 1e-9 and b < len(edges[j]):
                    model.feature[t, first + k], model.threshold[t, first + k] = j, edges[j][b]
            f, at = model.feature[t, node], model.threshold[t, node]
            node = 2 * node + 1 + (x[np.arange(n), f] > at)
        at = node - inner
        model.leaf[t] = rate * np.bincount(at, g, minlength=leaves) / (np.bincount(at, h, minlength=leaves) + l2)
        raw += model.leaf[t, at]
    return model


def fit_quality(docs: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1, per_class: int = PER_CLASS) -> BoostedTrees:
    """Trees learnt from at most ``per_class`` labelled documents of each class outside the hold-out.

    Only the statistics of the sampled texts (2 * per_class rows at most) reach the driver. Class weights restore the
    frequencies of the whole label table. Without labels of both classes every score is the share of the known class.
    """
    sample, sizes = labelled_texts(docs, labels, "quality", modulus, held, per_class, SEED)
    names = [f"s{i}" for i in range(len(STATISTICS))]

    def measure(batches):
        for b in batches:
            m = statistics_matrix(b["text"])
            yield pa.RecordBatch.from_arrays([*map(pa.array, m.T), b["y"]], names=[*names, "y"])

    rows = sample.mapInArrow(measure, ", ".join(f"{c} double" for c in names) + ", y int").toPandas().sort_values([*names, "y"], kind="stable")
    y = rows["y"].to_numpy(dtype=np.float64)
    taken = np.bincount(y.astype(np.int64), minlength=2)
    weight = np.array([sizes.get(c, 0) / max(taken[c], 1) for c in (0, 1)])
    weight = weight / max(weight.max(), 1e-12)
    return fit_trees(rows[names].to_numpy(), y, weight[y.astype(np.int64)])


def score_quality(docs: DataFrame, model: BoostedTrees, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with the probability that quality is 1, from the whole text; a null text scores like an empty one.

    Extra columns pass through; a column called ``into`` is replaced.
    """

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        x = statistics_matrix(pa.array(texts, type=pa.large_string(), from_pandas=True))
        out = [model.predict(x[i : i + 1024]) for i in range(0, len(x), 1024)]
        return pd.Series(np.concatenate(out) if out else [], dtype="float64", index=texts.index)

    return small_batches(docs).withColumn(into, score(F.col(text)))
