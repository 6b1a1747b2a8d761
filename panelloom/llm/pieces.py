"""SentencePiece BPE encoding and decoding; giant texts by a parallel scan over max-plus transfer matrices.

A split of a text into pieces is its BPE encoding exactly if every two neighbours stay apart when their joint text is encoded
alone. So encoding is a best path: an allowed neighbour weighs 0, any other minus infinity. A chunk of a text is then a
matrix from the pieces that can lie across its first border to those across its last; matrices combine by max-plus products,
in any grouping, and once the pieces on the borders are known every chunk finds its own.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_table
from .common import small_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Characters of a chunk; longer texts are split. Words longer than LONG take the chunk method inside one task.
CHUNK, LONG = 1 << 15, 64
CACHE_WORDS = 80_000
NEVER = float("inf")
NORMAL, UNKNOWN, BYTE = 1, 2, 6  # piece types of the model format


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            value: int | bytes = varint()
        else:
            n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            value = data[at : at + n]
            at += n
        yield key >> 3, value


class Pieces:
    """Vocabulary of a BPE model with identity normalisation, a dummy prefix and byte fallback."""

    def __init__(self, model: bytes):
        self.text: list[str] = []
        self.score: list[float] = []
        self.kind: list[int] = []
        for number, value in _fields(model):
            if number == 1:
                f = dict(_fields(value))
                self.text.append(f[1].decode())
                self.score.append(float(np.frombuffer(f.get(2, b"\0\0\0\0"), dtype="<f4")[0]))
                self.kind.append(f.get(3, NORMAL))
        self.ids = {t: i for i, (t, k) in enumerate(zip(self.text, self.kind)) if k == NORMAL}
        self.rank = {t: -self.score[i] for t, i in self.ids.items()}
        self.bytes = {int(t[3:5], 16): i for i, (t, k) in enumerate(zip(self.text, self.kind)) if k == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.spoken = [t.replace(SPACE, " ") if k == NORMAL else "" for t, k in zip(self.text, self.kind)]
        self.longest = max(map(len, self.ids), default=1)
        self.pairs = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        # no piece crosses from another character into a space, so words can be encoded one by one
        self.words_apart = not any(p[1] == SPACE != p[0] for p in self.pairs)
        self.word = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+") if self.words_apart else re.compile(".+", re.S)
        self.cache: dict[str, bytes] = {}  # ids of words, four bytes each
        self.older: dict[str, bytes] = {}
        self.apart: dict[tuple[str, str], bool] = {}

    def merge(self, text: str) -> list[str]:
        """Pieces and single characters of a short text: the best-scored neighbours are joined first, the leftmost of equals."""
        parts, rank, never = list(text), self.rank.get, NEVER
        ranks = [rank(text[i : i + 2], never) for i in range(len(text) - 1)]
        while ranks and (best := min(ranks)) != never:
            i = ranks.index(best)
            joined = parts[i] = parts[i] + parts.pop(i + 1)
            del ranks[i]
            if i:
                ranks[i - 1] = rank(parts[i - 1] + joined, never)
            if i < len(ranks):
                ranks[i] = rank(joined + parts[i + 1], never)
        return parts

    def stay_apart(self, left: str, right: str) -> bool:
        if left[-1] + right[0] not in self.pairs:
            return True
        known = self.apart.get((left, right))
        if known is None:
            if len(self.apart) > CACHE_WORDS:
                self.apart.clear()
            known = self.apart[left, right] = self.merge(left + right) == [left, right]
        return known

    def numbers(self, parts: list[str]) -> list[int]:
        ids = self.ids
        try:
            return [ids[p] for p in parts]
        except KeyError:  # some character is no piece
            pass
        out: list[int] = []
        for p in parts:
            i = self.ids.get(p)
            if i is not None:
                out.append(i)
            else:
                out += [self.bytes.get(b, 0) for b in p.encode("utf-8", "surrogatepass")]
        return out

    def across(self, text: str, at: int) -> list[tuple[int, int]]:
        """Spans of pieces and single characters that begin before ``at`` and end at or behind it."""
        return [
            (a, b) for a in range(max(0, at - self.longest), at) for b in range(at, min(len(text), a + self.longest) + 1)
            if b - a == 1 or text[a:b] in self.ids
        ]

    def paths(self, text: str, start: tuple[int, int] | None, end: int) -> dict[int, int]:
        """Begin of the one piece that can end at each place, on paths of allowed neighbours from span ``start`` (or the text's head) to pieces that begin before ``end``."""
        begin = {start[1]: start[0]} if start else {0: 0}
        for b in range((start[1] if start else 0) + 1, min(len(text), end + self.longest) + 1):
            for a in range(max(0, b - self.longest), min(b, end)):
                if a in begin and (b - a == 1 or text[a:b] in self.ids) and (a == begin[a] or self.stay_apart(text[begin[a] : a], text[a:b])):
                    begin[b] = a
                    break
        return begin

    def trace(self, text: str, begin: dict[int, int], last: int, stop: int) -> list[str]:
        """Pieces from place ``stop`` to place ``last``."""
        out = []
        while last > stop:
            out.append(text[begin[last] : last])
            last = begin[last]
        return out[::-1]

    def word_ids(self, word: str) -> bytes:
        found = self.cache.get(word)
        if found is None and word in self.older:
            found = self.older[word]
            self.remember(word, found)
        if found is None:
            parts = self.merge(word) if len(word) <= LONG else self.trace(word, self.paths(word, None, len(word)), len(word), 0)
            found = array("i", self.numbers(parts)).tobytes()
            self.remember(word, found)
        return found

    def remember(self, word: str, ids: bytes) -> None:
        """Keep a word; when the cache is full it becomes the older half, whose words come back when they are met again."""
        if len(self.cache) > CACHE_WORDS:
            self.older = self.cache
            self.cache = {}
        self.cache[word] = ids

    def encode(self, text: str) -> np.ndarray:
        """Ids of a normalised text; words are joined whole, so the work goes with words and not with ids."""
        get, ids = self.cache.get, self.word_ids  # of the cache at the start: what is kept meanwhile is found by the slower way
        return np.frombuffer(b"".join([get(w) or ids(w) for w in self.word.findall(text)]), dtype="<i4")

    def decode(self, ids: np.ndarray) -> str:
        spoken, places = self.spoken, ids.tolist()
        if self.byte_of.keys().isdisjoint(places):
            return "".join([spoken[i] for i in places])[1:]
        out, raw = [], bytearray()
        for i in places:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            out.append(self.spoken[i])
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        return "".join(out)[1:]


def normalised(text: str | None) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


@lru_cache(maxsize=2)
def _load(model: bytes) -> Pieces:
    return Pieces(model)


class Chunk:
    """Characters [at, end) of a text, with up to ``longest`` characters on either side; places count from the head of ``text``."""

    def __init__(self, pieces: Pieces, text: str, at: int, end: int, first: bool, last: bool):
        self.p, self.text, self.at, self.end = pieces, text, at, end
        self.entries: list[tuple[int, int] | None] = [None] if first else list(pieces.across(text, at))
        self.exits = [s for s in pieces.across(text, end) if not last or s[1] == end]
        # places that no piece lies across: whatever came before, paths go on from there alike
        resets = [m.start() for m in re.finditer(SPACE, text[at:end]) if m.start() + at > 0 and text[at + m.start() - 1] != SPACE] if pieces.words_apart else []
        resets = [r + at for r in resets if r + at > at]
        self.head = resets[0] if resets else None
        self.tail = resets[-1] if resets else None

    def _from(self, entry: tuple[int, int] | None, end: int) -> dict[int, int]:
        return self.p.paths(self.text, entry, end)

    def matrix(self) -> np.ndarray:
        """0 from each entry to each exit that a path joins, else minus infinity."""
        out = np.full((len(self.entries), len(self.exits)), -np.inf)
        if self.head is None:
            for i, entry in enumerate(self.entries):
                begin = self._from(entry, self.end)
                for j, (a, b) in enumerate(self.exits):
                    if begin.get(b) == a or entry == (a, b):
                        out[i, j] = 0
            return out
        rest = self.text[self.tail :]
        begin = self.p.paths(rest, None, self.end - self.tail)
        reached = np.array([0 if begin.get(b - self.tail) == a - self.tail and a >= self.tail else -np.inf for a, b in self.exits])
        for i, entry in enumerate(self.entries):
            if self.head in self._from(entry, self.head):
                out[i] = reached
        return out

    def pieces(self, entry: int, exit_: int) -> list[int]:
        """Ids behind the entry up to and with the exit."""
        start, (a, b) = self.entries[entry], self.exits[exit_]
        done = start[1] if start else 0
        if self.head is None:
            return self.p.numbers(self.p.trace(self.text, self._from(start, self.end), b, done))
        ids = self.p.numbers(self.p.trace(self.text, self._from(start, self.head), self.head, done))
        ids += self.p.encode(self.text[self.head : self.tail]).tolist()
        rest = self.text[self.tail :]
        return ids + self.p.numbers(self.p.trace(rest, self.p.paths(rest, None, self.end - self.tail), b - self.tail, 0))


def product(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return (left[:, :, None] + right[None, :, :]).max(axis=1)


def border_states(matrices: list[np.ndarray]) -> list[int]:
    """States at the borders of a best path through all matrices, first and last border included.

    Neighbours are multiplied pairwise up a tree; going down, the state between the two halves of a node is the one where
    the sum of what leads there and on from there is largest.
    """
    levels = [matrices]
    while len(levels[-1]) > 1:
        m = levels[-1]
        levels.append([product(m[i], m[i + 1]) if i + 1 < len(m) else m[i] for i in range(0, len(m), 2)])
    whole = levels[-1][0]
    if not np.isfinite(whole).any():
        raise ValueError("no path through the text")
    states = [int(x) for x in np.unravel_index(whole.argmax(), whole.shape)]
    for m in reversed(levels[:-1]):
        finer = []
        for i in range(0, len(m), 2):
            a, b = states[i // 2], states[i // 2 + 1]
            finer.append(a)
            if i + 1 < len(m):
                finer.append(int((m[i][a, :] + m[i + 1][:, b]).argmax()))
        states = [*finer, states[-1]]
    return states


def _model(docs: DataFrame, model: str) -> bytes:
    """Contents of a model file; a path with a scheme is read by Spark."""
    if "://" in model:
        return bytes(docs.sparkSession.read.format("binaryFile").load(model).first()["content"])
    with open(model, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model: str = MODEL, key: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(key, ids) for every row of ``docs``: the ids that the model's own encoder gives for the whole text; other columns are not looked at.

    Null and empty texts have no ids. Texts of up to ``chunk`` characters are encoded word by word. Longer ones are dealt out
    in chunks: each gives its matrix, the matrices of a text (a few hundred bytes a chunk) are combined in one place, and
    each chunk then finds its ids between the two pieces on its borders.
    """
    data = _model(docs, model)
    halo = _load(data).longest
    rows = small_batches(docs).select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    short = F.coalesce(F.length("text"), F.lit(0)) < chunk

    def whole(batches):
        p = _load(data)
        for b in batches:
            for i in range(0, len(b), 512):
                part = b.slice(i, 512)
                ids = pa.array([p.encode(normalised(t)) for t in part["text"].to_pylist()], type=pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part["key"], ids], names=["key", "ids"])

    def split(batches):
        for b in batches:
            for r in range(len(b)):
                t = normalised(b["text"][r].as_py())
                n = -(-len(t) // chunk)
                for k in range(n):
                    first = max(0, k * chunk - halo)
                    yield pa.RecordBatch.from_arrays([
                        b["key"].slice(r, 1), b["uid"].slice(r, 1), pa.array([k], type=pa.int32()), pa.array([n], type=pa.int32()), pa.array([k * chunk - first], type=pa.int32()),
                        pa.array([min(len(t), (k + 1) * chunk) - first], type=pa.int32()), pa.array([t[first : (k + 1) * chunk + halo]], type=pa.string()),
                    ], names=["key", "uid", "k", "n", "at", "end", "text"])

    def rows_of(batch):
        for r in range(len(batch)):  # one at a time: a batch of chunks is large, as Python strings twice so
            yield batch.slice(r, 1).to_pylist()[0]

    def chunk_of(row) -> Chunk:
        return Chunk(_load(data), row["text"], row["at"], row["end"], row["k"] == 0, row["k"] == row["n"] - 1)

    def matrices(batches):
        for b in batches:
            m = [chunk_of(r).matrix() for r in rows_of(b)]
            yield pa.RecordBatch.from_arrays(
                [b["uid"], b["k"], pa.array([x.shape[0] for x in m], type=pa.int32()), pa.array([x.astype("<f4").tobytes() for x in m], type=pa.binary())], names=["uid", "k", "height", "matrix"])

    def combine(group: pa.Table) -> pa.Table:
        group = group.sort_by("k")
        m = [np.frombuffer(x, dtype="<f4").reshape(h, -1) for x, h in zip(group["matrix"].to_pylist(), group["height"].to_pylist())]
        s = border_states(m)
        return pa.table({"uid": group["uid"], "k": group["k"], "enter": pa.array(s[:-1], type=pa.int32()), "leave": pa.array(s[1:], type=pa.int32())})

    def resolve(batches):
        for b in batches:
            ids = [np.array(chunk_of(r).pieces(r["enter"], r["leave"]), dtype=np.int32) for r in rows_of(b)]
            yield pa.RecordBatch.from_arrays([b["key"], b["uid"], b["k"], pa.array(ids, type=pa.list_(pa.int32()))], names=["key", "uid", "k", "ids"])

    out = rows.where(short).mapInArrow(whole, f"key {kind}, ids array<int>")
    # ids of rows are given once and written out, so that a repeated task can't change them
    long = rows.where(~short).withColumn("uid", F.monotonically_increasing_id()).mapInArrow(split, f"key {kind}, uid bigint, k int, n int, at int, end int, text string")
    long = scratch_table(long, "chunks")
    if not long.isEmpty():
        dealt = long.repartition("uid", "k")
        states = dealt.mapInArrow(matrices, "uid bigint, k int, height int, matrix binary").groupBy("uid").applyInArrow(combine, "uid bigint, k int, enter int, leave int")
        done = long.join(states, ["uid", "k"]).select("key", "uid", "k", "n", "at", "end", "text", "enter", "leave").mapInArrow(resolve, f"key {kind}, uid bigint, k int, ids array<int>")
        done = done.groupBy("uid").agg(F.first("key").alias("key"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"])).alias("ids"))
        out = out.unionByName(done.select("key", "ids"))
    return out.withColumnRenamed("key", key)


def with_decoded(encoded: DataFrame, model: str = MODEL, ids: str = "ids", into: str = "text") -> DataFrame:
    """``encoded`` with the text of every row: pieces joined, byte pieces read as UTF-8, the leading space dropped.

    Null or no ids give an empty text. Other columns pass through; one called ``into`` is replaced.
    """
    data = _model(encoded, model)

    @F.pandas_udf("string")
    def run(rows: pd.Series) -> pd.Series:
        p = _load(data)
        return pd.Series([p.decode(x) if x is not None else "" for x in rows], index=rows.index, dtype="object")

    return small_batches(encoded).withColumn(into, run(F.col(ids)))
