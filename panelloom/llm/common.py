"""Helpers shared by the operators: table access, hold-out rules, bounded training samples, byte-level words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_table

U64 = np.uint64
#: Bytes that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: Texts are worked on in slices of about so many bytes; one longer text makes a slice of its own.
SLICE_BYTES = 256 << 10
_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[list(SEPARATORS)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RANDOM = np.random.default_rng(20240229)
_BYTE_CODE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = U64(0x9E3779B97F4A7C15)
_BASE_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


#: Rows that Spark hands to Python at once.
BATCH_ROWS, BATCH_KEY = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(docs: DataFrame) -> DataFrame:
    """``docs``, after lowering its session's Arrow batches to BATCH_ROWS rows if they are larger: texts are long, and a worker's memory is bounded."""
    conf = docs.sparkSession.conf
    if not 0 < int(conf.get(BATCH_KEY)) <= BATCH_ROWS:
        conf.set(BATCH_KEY, str(BATCH_ROWS))
    return docs


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % modulus


def held_out(doc_id: Column | str, modulus: int, held: int) -> Column:
    """True for rows no classifier may learn from; a row without id is not held out, but is not learnt from either."""
    return F.coalesce(remainder(doc_id, modulus) == held, F.lit(False))


def bounded_sample(rows: DataFrame, group: str, key: str, per_group: int, seed: int) -> tuple[DataFrame, dict]:
    """About ``per_group`` rows (never more) of each value of ``group``, the same at every run, and the group sizes.

    ``group`` must have few values (classes). Rows are first thinned by a hash of ``key`` to 1.2 times the
    bound, so that the ordering that enforces the bound reads a bounded number of rows.
    """
    sizes = {r[0]: r[1] for r in rows.where(F.col(group).isNotNull()).groupBy(group).count().collect()}
    kind = rows.schema[group].dataType.simpleString()
    shares = rows.sparkSession.createDataFrame([(g, 1.2 * per_group / n) for g, n in sizes.items()], f"{group} {kind}, __share double")
    unit = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    thin = rows.join(F.broadcast(shares), group).withColumn("__unit", unit).where("__unit < __share")
    order = Window.partitionBy(group).orderBy("__unit", key)
    out = thin.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= per_group)
    return out.select(rows.columns), sizes


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, per_class: int, seed: int) -> tuple[DataFrame, dict]:
    """(text, label) of a bounded sample of labelled documents outside the hold-out, and the class sizes.

    At most ``per_class`` rows of each class, written to the shared folder; their ids are broadcast (2 * per_class rows of two numbers at most).
    Of documents that share an id, the least text counts, found by partial aggregation; a repeated label counts once. Labels other than 0 and 1 are ignored.
    """
    rows = labels.select("doc_id", F.col(label).cast("int").alias("y")).where("y in (0, 1)").where(remainder("doc_id", modulus) != held).distinct()
    sample, sizes = bounded_sample(rows, "y", "doc_id", per_class, seed)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    return scratch_table(texts.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("text", "y"), f"sample-{label}"), sizes


def free_names(rows: DataFrame, *stems: str) -> list[str]:
    """Names for working columns that no column of ``rows`` has, case aside."""
    taken = {c.lower() for c in rows.columns}
    tail = next(t for t in ("_" * i for i in range(len(taken) + 1)) if taken.isdisjoint(s + t for s in stems))
    return [s + tail for s in stems]


def slices(texts: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows with about SLICE_BYTES of UTF-8; null rows are empty."""
    done = 0
    for chunk in texts.chunks if isinstance(texts, pa.ChunkedArray) else [texts]:
        chunk = chunk.cast(pa.large_binary()).fill_null(b"")
        _, offsets, data = chunk.buffers()
        at = np.frombuffer(offsets, dtype=np.int64)[chunk.offset : chunk.offset + len(chunk) + 1]
        raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
        row = 0
        while row < len(chunk):
            end = max(row + 1, int(np.searchsorted(at, at[row] + SLICE_BYTES, side="right")) - 1)
            yield done + row, raw[at[row] : at[end]], at[row : end + 1] - at[row]
            row = end
        done += len(chunk)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; the longest array asked for is kept if no longer than two slices."""
    kept = _POWERS.get(int(base))
    if kept is None or len(kept) < n:
        kept = np.full(max(n, 1), base, dtype=np.uint64)
        kept[0] = 1
        kept = np.multiply.accumulate(kept)
        if n <= 2 * SLICE_BYTES:
            _POWERS[int(base)] = kept
    return kept[:n]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of consecutive texts, and the offsets of each text's words among them.

    Words are maximal runs of bytes other than SEPARATORS inside one text.
    """
    n = len(data)
    inside = np.zeros(n + 2, dtype=bool)
    inside[1:-1] = ~_SEPARATOR[data]
    joint = np.zeros(n + 2, dtype=bool)  # a text starts here, whatever precedes
    joint[offsets + 1] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | joint[1:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | joint[2:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans, A-Z lowered: a polynomial over random byte codes, read off prefix sums modulo 2**64, then mixed."""
    n = len(data)
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE_CODE[_LOWER[data]] * powers(_BASE, n), out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * powers(_BASE_INVERSE, n + 1)[starts] + (ends - starts).astype(np.uint64))


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words; a shorter sequence is one shingle, no words are none."""
    n = len(words)
    if n == 0:
        return np.empty(0, dtype=np.uint64)
    width = min(n, size)
    total = np.full(n - width + 1, width, dtype=np.uint64)
    for k in range(width):
        total = total * U64(0xD6E8FEB86659FD93) + words[k : n - width + 1 + k]
    return np.unique(mix(total))
