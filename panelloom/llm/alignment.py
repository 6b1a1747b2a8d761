"""Alignment of two tokenizers: groups of tokens that cover the same bytes, and how often ids are linked across the corpus."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_table
from .common import small_batches
from .pieces import MODEL, SPACE, _model

BYTE_MODEL = "/opt/tokenizers/byte_bpe_50k.json"
#: How the byte-level model cuts a text before merging: fixed values of its format.
WORDS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of text in a block of documents (one longer text is a block of its own); links whose ids are looked up at once.
BLOCK_BYTES, LINKS = 8 << 20, 1 << 22
#: An id pair is one number: a * PAIR + b.
PAIR = 1 << 16


def byte_names() -> dict[str, int]:
    """Character that a byte-level vocabulary writes for each byte: printable ones themselves, the others from 256 on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    names = {chr(b): b for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in set(plain)):
        names[chr(256 + n)] = b
    return names


class Tokenizers:
    """Both vocabularies: encoders, bytes and byte lengths of every id, and ids as text with what follows them in a group list."""

    def __init__(self, byte_model: bytes, piece_model: bytes):
        spec, names = json.loads(byte_model), byte_names()
        special = {t["content"] for t in spec.get("added_tokens", []) if t.get("special")}
        a = {i: bytes(names[c] for c in t) for t, i in spec["model"]["vocab"].items() if t not in special}
        # ids follow the order of merges, so they serve as ranks; special strings in a text are ordinary text
        self.left = tiktoken.Encoding("left", pat_str=WORDS, mergeable_ranks={v: i for i, v in a.items()}, special_tokens={})
        self.right = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        pieces = range(self.right.get_piece_size())
        self.pieces = [
            bytes([int(self.right.id_to_piece(i)[3:5], 16)]) if self.right.is_byte(i) else self.right.id_to_piece(i).replace(SPACE, " ").encode() for i in pieces
        ]
        size = max(a, default=0) + 1
        if max(size, len(self.pieces)) > PAIR:
            raise ValueError(f"vocabularies of more than {PAIR} ids")
        self.sizes = np.array([len(a.get(i, b"")) for i in range(size)]), np.array([len(p) for p in self.pieces])
        self.spoken = [[np.array([f"{i}{end}" for i in range(n)], dtype=object) for end in (",", last)] for n, last in ((size, "|"), (len(self.pieces), ";"))]

    def encode(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of every text in both vocabularies; none if either can't give space + text back byte for byte."""
        none = np.empty(0, dtype=np.int64)
        for text, right in zip(texts, self.right.encode([t or "" for t in texts], num_threads=1)):
            whole = f" {text}"
            left = self.left.encode_ordinary(whole) if text else []
            data = whole.encode()
            if text and self.left.decode_bytes(left) == data and b"".join([self.pieces[i] for i in right]) == data:
                yield np.array(left, dtype=np.int64), np.array(right, dtype=np.int64)
            else:
                yield none, none


@lru_cache(maxsize=2)
def _load(byte_model: bytes, piece_model: bytes) -> Tokenizers:
    return Tokenizers(byte_model, piece_model)


def groups(left: list[int], right: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Places behind the last token of every group, in both end lists (ascending, with the same last end).

    While ends at the current shift between the two indexes are equal, tokens pair one to one: slices are compared whose
    length doubles with each success and halves after a failure, so a stretch of n pairs costs log n comparisons. An
    irregular group is closed by stepping the side that is behind; the shift changes by what one side had more.
    """
    runs: list[tuple[int, int, int]] = []  # first places of both sides, groups that follow one to one
    i = shift = 0
    n = len(left)
    while i < n:
        first, step, growing = i, 4, True
        while step:
            run = left[i : i + step]
            if run and run == right[i + shift : i + shift + step]:
                i += len(run)
                step = 2 * step if growing else step // 2
            else:
                growing = False
                step //= 2
        if i > first:
            runs.append((first, first + shift, i - first))
        if i == n:
            break
        j = i + shift
        x, y = left[i], right[j]
        while x != y:
            if x < y:
                i += 1
                x = left[i]
            else:
                j += 1
                y = right[j]
        runs.append((i, j, 1))
        i += 1
        shift = j + 1 - i
    a, b, size = np.array(runs, dtype=np.int64).reshape(-1, 3).T
    within = np.arange(1, size.sum() + 1) - np.repeat(np.cumsum(size) - size, size)
    return np.repeat(a, size) + within, np.repeat(b, size) + within


def spelled(t: Tokenizers, left: np.ndarray, right: np.ndarray, a: np.ndarray, b: np.ndarray) -> str:
    """Groups as text: ``a1,a2|b1;a3|b2,b3``."""
    out = np.empty(len(left) + len(right), dtype=object)
    for (ids, cuts, before), (comma, last) in zip(((left, a, np.append(0, b[:-1])), (right, b, a)), t.spoken):
        at = np.arange(len(ids)) + np.repeat(before, np.diff(cuts, prepend=0))
        out[at] = comma[ids]
        out[at[cuts - 1]] = last[ids[cuts - 1]]
    return "".join(out.tolist())[:-1]


def linked_ids(left: np.ndarray, right: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(group of each link, id pair of each link), about LINKS links at a time; ``a``, ``b`` are the places behind each group."""
    if not len(a):
        return
    starts = np.append(0, a[:-1]), np.append(0, b[:-1])
    wide = b - starts[1]
    links = (a - starts[0]) * wide
    total = np.cumsum(links)
    first = 0
    while first < len(a):
        end = max(first + 1, int(np.searchsorted(total, total[first] - links[first] + LINKS, side="right")))
        n = links[first:end]
        group = np.repeat(np.arange(first, end), n)
        within = np.arange(len(group)) - np.repeat(np.cumsum(n) - n, n)
        i = starts[0][group] + within // wide[group]
        j = starts[1][group] + within % wide[group]
        yield group, left[i] * PAIR + right[j]
        first = end


def distinct_links(left: np.ndarray, right: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Id pairs linked in a text, ascending, and how often each is."""
    parts = [np.unique(pair, return_counts=True) for _, pair in linked_ids(left, right, a, b)]
    if len(parts) < 2:
        return parts[0] if parts else (np.empty(0, dtype=np.int64),) * 2
    pair, at = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
    return pair, np.bincount(at, weights=np.concatenate([n for _, n in parts])).astype(np.int64)


def aligned(t: Tokenizers, texts: list[str | None]) -> Iterator[tuple[np.ndarray, ...]]:
    """Ids of both sides and the places behind the last token of each group, of every text."""
    for left, right in t.encode(texts):
        yield left, right, *groups(*[np.cumsum(size[ids]).tolist() for ids, size in zip((left, right), t.sizes)])


def _narrow(x: np.ndarray) -> bytes:
    return x.astype(np.min_scalar_type(int(x.max(initial=0)))).tobytes()


def _wide(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, dtype=f"<u{len(data) // n}").astype(np.int64) if n else np.empty(0, dtype=np.int64)


#: One row a document; ``pairs`` and ``docs`` are filled in one more row a block.
BLOCKS = "block bigint, key {}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, n_pairs int, at binary, times binary, pairs array<bigint>, docs array<int>"


def linked_blocks(docs: DataFrame, byte_model: str, piece_model: str, key: str, text: str) -> DataFrame:
    """Documents with their distinct id pairs, dealt into blocks of about BLOCK_BYTES of text.

    A block has one row with its pairs, ascending, and the number of its documents that hold each; a document's row has places in
    that list (``at``) and how often it has each pair (``times``), in as few bytes as they need.
    """
    data = _model(docs, byte_model), _model(docs, piece_model)
    rows = small_batches(docs).select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    schema = BLOCKS.format(rows.schema["key"].dataType.simpleString())
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        t, block = _load(*data), TaskContext.get().partitionId() << 33
        kinds = [pa.int64(), None, *[pa.int64()] * 4, pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32())]
        held: list[tuple] = []
        found: list[tuple[np.ndarray, np.ndarray]] = []
        keys: list[pa.Array] = []
        size = 0

        def closed():
            pair, at, n = np.unique(np.concatenate([p for p, _ in found]), return_inverse=True, return_counts=True)
            ends = np.cumsum([len(p) for p, _ in found])
            own = [(*row, len(p), _narrow(at[end - len(p) : end]), _narrow(times)) for row, (p, times), end in zip(held, found, ends)]
            cols = [pa.array([block] * len(own), type=kinds[0]), pa.concat_arrays(keys)]
            cols += [pa.array(list(c), type=k) for c, k in zip(zip(*own), kinds[2:-2])] + [pa.nulls(len(own), type=k) for k in kinds[-2:]]
            yield pa.RecordBatch.from_arrays(cols, names=names)
            cols = [pa.array([block], type=kinds[0]), pa.nulls(1, type=keys[0].type)] + [pa.nulls(1, type=k) for k in kinds[2:-2]]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([pair], type=kinds[-2]), pa.array([n.astype(np.int32)], type=kinds[-1])], names=names)

        for batch in batches:
            for first in range(0, len(batch), 64):
                part = batch.slice(first, 64)
                texts = part["text"].to_pylist()
                for left, right, a, b in aligned(t, texts):
                    found.append(distinct_links(left, right, a, b))
                    n_links = int((np.diff(a, prepend=0) * np.diff(b, prepend=0)).sum())
                    held.append((len(left), len(right), len(a), n_links, hashlib.sha256(spelled(t, left, right, a, b).encode()).hexdigest() if len(a) else ""))
                keys.append(part["key"])
                size += sum(len(x) for x in texts if x)
                if size >= BLOCK_BYTES:
                    yield from closed()
                    held, found, keys, size, block = [], [], [], 0, block + 1
        if held:
            yield from closed()

    return rows.mapInArrow(run, schema)


def align(docs: DataFrame, byte_model: str = BYTE_MODEL, piece_model: str = MODEL, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, groups) of every row of ``docs``: groups is an array of structs of two id arrays, in text order.

    Null and empty texts, and texts that either vocabulary can't give back byte for byte, have no groups.
    """
    data = _model(docs, byte_model), _model(docs, piece_model)
    rows = small_batches(docs).select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))

    def run(batches):
        t = _load(*data)
        for b in batches:
            for r, (left, right, *cuts) in enumerate(aligned(t, b["text"].to_pylist())):
                sides = [pa.ListArray.from_arrays(pa.array(np.append(0, cut).astype(np.int32)), pa.array(ids.astype(np.int32))) for ids, cut in zip((left, right), cuts)]
                group = pa.StructArray.from_arrays(sides, names=["a_ids", "b_ids"])
                yield pa.RecordBatch.from_arrays([b["key"].slice(r, 1), pa.ListArray.from_arrays(pa.array([0, len(group)], type=pa.int32()), group)], names=["key", "groups"])

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, groups array<struct<a_ids: array<int>, b_ids: array<int>>>").withColumnRenamed("key", key)


def link_counts(docs: DataFrame, byte_model: str = BYTE_MODEL, piece_model: str = MODEL, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row of ``docs``; other columns are not looked at.

    Every row is a document, whatever its key: rows that repeat count as often as they occur. Null and empty texts, and texts
    that either vocabulary can't give back byte for byte, have zeros and an empty digest.

    Documents are aligned once, in blocks; of their links the distinct pairs are kept. A block asks for each id pair once, so what is shuffled for the counts grows with the
    distinct pairs of a block and not with its links; the highest count of each left id (at most one row an id) is broadcast.
    Counts then meet the block's documents again.
    """
    blocks = scratch_table(linked_blocks(docs, byte_model, piece_model, key, text), "linked")
    kind = blocks.schema["key"].dataType.simpleString()
    asked = blocks.where("docs is not null").select("block", F.explode(F.arrays_zip("pairs", "docs")).alias("x")).select("block", F.col("x.pairs").alias("pair"), F.col("x.docs").alias("docs"))
    totals = asked.groupBy("pair").agg(F.sum("docs").alias("count"))
    totals = scratch_table(totals.withColumn("id", F.shiftright("pair", 16)), "pair-counts")
    best = totals.groupBy("id").agg(F.max("count").alias("most"))
    known = totals.join(F.broadcast(best), "id").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    answers = asked.drop("docs").join(known, "pair").select(F.col("block").alias("asker"), "pair", "count", "best")
    schema = f"key {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"

    def run(rows: pa.Table, counts: pa.Table) -> pa.Table:
        order = np.argsort(counts["pair"].to_numpy())  # a block asks for all its pairs, so this is the order of its list
        count, top = counts["count"].to_numpy()[order], counts["best"].to_numpy()[order]
        sums = np.zeros((rows.num_rows, 2), dtype=np.int64)
        for r, (n, at, times) in enumerate(zip(*(rows[c].to_pylist() for c in ("n_pairs", "at", "times")))):
            at, times = _wide(at, n), _wide(times, n)
            sums[r] = int(times[top[at]].sum()), int((times * count[at]).sum())
        out = rows.select(["key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
        return out.add_column(5, "n_best", pa.array(sums[:, 0])).add_column(6, "count_sum", pa.array(sums[:, 1]))

    texts = blocks.where("docs is null").drop("pairs", "docs")
    return texts.groupBy("block").cogroup(answers.groupBy("asker")).applyInArrow(run, schema).withColumnRenamed("key", key)
