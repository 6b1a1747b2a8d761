"""Prefix trie of conversations: a z-fast trie over prefix fingerprints, built in batches, its edges expanded into nodes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_table

#: Turns that one row of a path holds; longer conversations go on in further rows, each in the trie below its own start.
SEGMENT = 1024
#: Turns of one task's share of a trie, and of the batch of paths that is put into the trie before the others are looked up.
LOAD, BATCH = 1 << 14, 1 << 12
#: A path step: fingerprint of the prefix (16 bytes) and the bytes of its texts (8).
STEP, PRINT = 24, 16
ROOT = b"\0" * PRINT
PART_ROWS = 1 << 33  # rows of one partition that monotonically_increasing_id numbers: a fixed value
#: Turns that a rebuilt conversation takes from another one, at most; conversations that share one source.
HEAD, SHARING = 9, 5


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv, pos, d1, d2, size): turns of each conversation in order, null turns first, ties by role and text; digests and bytes of the text.

    Rows are range-sorted by conversation and turn, so that a long conversation spreads over partitions; the place in a partition
    plus the turns in earlier ones is the position.
    """
    empty = F.lit("")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv"), "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text")).where("conv is not null")
    keys = ["conv", F.asc_nulls_first("turn"), "role", "text"]
    digests = [F.xxhash64(F.lit(seed), F.length("role"), "role", "text").alias(f"d{seed}") for seed in (1, 2)]
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select(
        "conv", *digests, F.octet_length("text").cast("long").alias("size"), F.spark_partition_id().alias("part"), (F.monotonically_increasing_id() % PART_ROWS).alias("place"))
    placed = scratch_table(placed, "turns")
    parts = placed.groupBy("conv", "part").agg(F.min("place").alias("from"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.select("conv", "part", (before - F.col("from") + 1).alias("shift"))
    return placed.join(offsets, ["conv", "part"]).select("conv", (F.col("place") + F.col("shift")).alias("pos"), "d1", "d2", "size")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of the rebuilt conversations, and (conv, turns) of each: first turns of conv - conv % SHARING, then its own after as many."""
    sizes = scratch_table(turns.groupBy("conv").agg(F.count("*").alias("own")), "conversations")
    head = F.crc32(F.col("conv").cast("string")) % HEAD
    convs = sizes.select("conv", "own", head.alias("head"), (F.col("conv") - F.col("conv") % SHARING).alias("source"))
    there = sizes.select(F.col("conv").alias("source"), F.col("own").alias("__n"))
    convs = convs.join(there, "source", "left").withColumn("taken", F.least("head", F.coalesce("__n", F.lit(0)))).drop("__n")
    convs = scratch_table(convs.withColumn("turns", F.col("taken") + F.greatest(F.col("own") - F.col("head"), F.lit(0))), "rebuilt")
    first = turns.where(F.col("pos") < HEAD).withColumnRenamed("conv", "source").join(convs.select("conv", "source", "taken"), "source").where("pos <= taken")
    own = turns.join(convs.select("conv", "head", "taken"), "conv").where("pos > head").withColumn("pos", F.col("pos") - F.col("head") + F.col("taken"))
    columns = ["conv", "pos", "d1", "d2", "size"]
    return first.select(columns).unionByName(own.select(columns)), convs.select("conv", "turns")


def paths(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv, depth, start, pre, path, last, end, bytes): SEGMENT turns of a conversation at a time.

    A prefix's fingerprint is the exclusive or of 128-bit hashes of its turns and their positions. ``depth``, ``start`` and ``pre`` are
    turns, fingerprint and bytes before the row, ``end`` and ``bytes`` those behind it; ``last`` marks a conversation's last row.
    A conversation without turns has one row with an empty path.
    """
    salted = [F.xxhash64(F.lit(seed), "pos", "d1", "d2").alias(f"f{seed}") for seed in (3, 4)]
    steps = turns.select("conv", "pos", F.expr(f"(pos - 1) div {SEGMENT}").alias("seg"), *salted, "size")
    segs = steps.groupBy("conv", "seg").agg(F.array_sort(F.collect_list(F.struct("pos", "f3", "f4", "size"))).alias("steps"))
    segs = scratch_table(segs, "segments")
    sums = segs.select("conv", "seg", *[F.expr(f"aggregate(steps, 0L, (s, x) -> s ^ x.{f})").alias(f) for f in ("f3", "f4")], F.expr("aggregate(steps, 0L, (s, x) -> s + x.size)").alias("size"))
    earlier = Window.partitionBy("conv").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    starts = sums.select("conv", "seg", *[F.coalesce(F.bit_xor(f).over(earlier), zero).alias(f"s{f[1]}") for f in ("f3", "f4")], F.coalesce(F.sum("size").over(earlier), zero).alias("pre"))
    rows = segs.join(starts, ["conv", "seg"]).join(convs, "conv").select("conv", "seg", "s3", "s4", "pre", "steps", "turns")
    none = convs.where("turns = 0").select("conv", zero.alias("seg"), zero.alias("s3"), zero.alias("s4"), zero.alias("pre"), F.expr("filter(array(named_struct('pos', 0L, 'f3', 0L, 'f4', 0L, 'size', 0L)), x -> false)").alias("steps"), "turns")

    def run(batches):
        for b in batches:
            out = []
            for conv, seg, s3, s4, pre, steps, turns in zip(*(b[c].to_pylist() if c != "steps" else b[c] for c in b.schema.names)):
                values = steps.values
                n = len(values)
                cells = np.empty((n + 1, 3), dtype="<i8")
                cells[0] = s3, s4, pre
                for k, f in enumerate(("f3", "f4", "size")):
                    cells[1:, k] = values.field(f).to_numpy()
                cells[:, :2] = np.bitwise_xor.accumulate(cells[:, :2], axis=0)
                cells[:, 2] = np.cumsum(cells[:, 2])
                data = cells.tobytes()
                out.append((conv, seg * SEGMENT, data[:PRINT], pre, data[STEP:], seg * SEGMENT + n == turns, data[-STEP : -STEP + PRINT], int(cells[-1, 2])))
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.bool_(), pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], type=t) for k, t in enumerate(kinds)], names=["conv", "depth", "start", "pre", "path", "last", "end", "bytes"])

    return rows.unionByName(none).mapInArrow(run, "conv bigint, depth bigint, start binary, pre bigint, path binary, last boolean, end binary, bytes bigint")


def fattest(low: int, high: int) -> int:
    """The number in (low, high] that the largest power of two divides."""
    return high & (-1 << ((low ^ high).bit_length() - 1))


def prefix(path: bytes, n: int) -> bytes:
    """Fingerprint of the first n > 0 turns of a path."""
    return path[STEP * n - STEP : STEP * n - STEP + PRINT]


class Node:
    """A compacted node: its edge covers the depths (top, end] of ``path``."""

    __slots__ = ("top", "end", "path", "conv")

    def __init__(self, top: int, end: int, path: bytes, conv: int):
        self.top, self.end, self.path, self.conv = top, end, path, conv

    def handle(self) -> bytes:
        return prefix(self.path, fattest(self.top, self.end))


class ZFastTrie:
    """Compacted trie of paths; nodes are found by the fingerprint at the two-fattest depth of their edge.

    A fat binary search halves the depths that are left by their two-fattest number: a hit leads below the node found or
    ends on its edge, a miss rules out all depths from there on.
    """

    def __init__(self):
        self.root = Node(0, 0, b"", 0)
        self.handles: dict[bytes, Node] = {}
        self.first: dict[bytes, Node] = {}  # by the fingerprint at the first depth of the edge

    def exit(self, path: bytes) -> tuple[Node, int]:
        """The deepest node whose edge ``path`` enters, and the depth to which they agree."""
        n = len(path) // STEP
        at, low, high = self.root, 0, n
        while low < high:
            f = fattest(low, high)
            v = self.handles.get(prefix(path, f))
            if v is None:
                high = f - 1
            elif v.end <= n and prefix(path, v.end) == prefix(v.path, v.end):
                at, low = v, v.end
            else:
                return v, self.agreed(path, v, f)
        v = self.first.get(prefix(path, low + 1)) if low < n else None
        return (at, low) if v is None else (v, self.agreed(path, v, low + 1))

    @staticmethod
    def agreed(path: bytes, node: Node, low: int) -> int:
        """The largest depth on the edge at which both have one fingerprint; they have at ``low``."""
        high = min(len(path) // STEP, node.end)
        while low < high:
            middle = (low + high + 1) // 2
            if prefix(path, middle) == prefix(node.path, middle):
                low = middle
            else:
                high = middle - 1
        return low

    def add(self, node: Node) -> None:
        self.handles[node.handle()] = node
        self.first[prefix(node.path, node.top + 1)] = node

    def insert(self, path: bytes, conv: int) -> None:
        v, depth = self.exit(path)
        if depth < v.end:
            del self.handles[v.handle()]
            upper = Node(v.top, depth, v.path, v.conv)
            v.top = depth
            self.add(v)
            self.add(upper)
        n = len(path) // STEP
        if depth < n:
            self.add(Node(depth, n, path, conv))

    def nodes(self) -> list[Node]:
        return list(self.first.values())


def _bytes_upto(path: bytes, n: int, before: int) -> int:
    return int.from_bytes(path[STEP * n - STEP + PRINT : STEP * n], "little", signed=True) if n else before


def _share(rows: list[dict], own: bool) -> Iterator[tuple]:
    """Rows of one task's share of a group: nodes of the trie of its batch (if ``own``), points on their edges, what is left of the other paths."""
    trie = ZFastTrie()
    start, depth, pre = rows[0]["start"], rows[0]["depth"], rows[0]["pre"]
    for r in rows:
        if r["batch"]:
            trie.insert(r["path"], r["conv"])

    def at(node: Node, n: int) -> bytes:
        return prefix(node.path, n) if n else start

    for v in trie.nodes() if own else ():
        steps = [_bytes_upto(v.path, k, pre) for k in range(v.top + 1, v.end + 1)]
        yield 0, at(v, v.top), at(v, v.end), at(v, v.end), depth + v.end, depth + v.top, _bytes_upto(v.path, v.top, pre), steps, v.conv, None, None
    for r in rows:
        if r["batch"]:
            continue
        path = r["path"]
        v, d = trie.exit(path)
        if v.top < d < v.end:
            yield 0, at(v, v.top), at(v, v.end), at(v, d), depth + d, depth + v.top, _bytes_upto(v.path, v.top, pre), None, r["conv"], None, None
        if d < len(path) // STEP:
            yield 1, None, None, prefix(path, d) if d else start, depth + d, None, _bytes_upto(path, d, pre), None, r["conv"], prefix(path, d + 1), path[STEP * d :]


FOUND = "kind int, top binary, bottom binary, at binary, depth bigint, top_depth bigint, pre bigint, steps array<bigint>, conv bigint, grp binary, path binary"
_KINDS = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.binary()]


def insert_batch(items: DataFrame) -> DataFrame:
    """One round over ``items`` (grp, start, depth, pre, conv, path): a batch of each group becomes a trie, the others leave it where they exit.

    A group of up to LOAD turns is one batch. A larger one is dealt over tasks by a hash, and each gets the same batch of about
    BATCH turns, drawn by a hash. A path that leaves the trie goes on in the group of its next turn.
    """
    load = (F.octet_length("path") / STEP + 1)
    sizes = scratch_table(items.groupBy("grp").agg(F.sum(load).alias("load")).select("grp", "load", F.ceil(F.col("load") / LOAD).cast("int").alias("shares")), "group-loads")
    unit = F.pmod(F.xxhash64("conv", "depth", F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    rows = items.join(sizes, "grp").withColumn("batch", (F.col("shares") == 1) | (unit < BATCH / F.col("load")))
    share = F.when(F.col("batch"), F.sequence(F.lit(0), F.col("shares") - 1)).otherwise(F.array(F.pmod(F.xxhash64("conv", F.lit(12)), F.col("shares")).cast("int")))
    rows = rows.select("grp", "start", "depth", "pre", "conv", "path", "batch", F.explode(share).alias("share"))

    def run(batches):
        def packed(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=t) for k, t in enumerate(_KINDS)], names=[c.split()[0] for c in FOUND.split(", ")])

        held, key, out = [], None, []
        for b in batches:
            for r in b.to_pylist():
                if (r["grp"], r["share"]) != key:
                    if held:
                        out += _share(held, key[1] == 0)
                    held, key = [], (r["grp"], r["share"])
                held.append(r)
                if len(out) >= 1000:
                    yield packed(out)
                    out = []
        if held:
            out += _share(held, key[1] == 0)
        for first in range(0, len(out), 1000):
            yield packed(out[first : first + 1000])

    return rows.repartition("grp", "share").sortWithinPartitions("grp", "share").mapInArrow(run, FOUND)


def compacted(rows: DataFrame) -> DataFrame:
    """(at, depth, parent, steps, pre) of every compacted node but the root: places where paths part or end, and every SEGMENT turns.

    ``steps`` holds the bytes of the prefixes along the node's edge and ``pre`` those of its parent.
    """
    items = rows.where("path <> x''").groupBy("start", "end", "depth").agg(F.min("conv").alias("conv"), F.first("path").alias("path"), F.first("pre").alias("pre"))
    items = scratch_table(items.select(F.col("start").alias("grp"), "start", "depth", "pre", "conv", "path"), "trie-items")
    points = None
    while not items.isEmpty():
        found = scratch_table(insert_batch(items), "trie-round")
        here = found.where("kind = 0").select("top", "bottom", "at", "depth", "top_depth", "pre", "steps")
        points = here if points is None else points.unionByName(here)
        items = found.where("kind = 1").select("grp", F.col("at").alias("start"), "depth", "pre", "conv", "path")
    if points is None:
        points = insert_batch(items).select("top", "bottom", "at", "depth", "top_depth", "pre", "steps")
    distinct = points.groupBy("top", "bottom", "at", "depth").agg(*[F.max(c).alias(c) for c in ("top_depth", "pre", "steps")])
    edge = Window.partitionBy("top", "bottom")  # at most SEGMENT points
    along = edge.orderBy("depth")
    placed = distinct.select(
        "at", "depth", F.coalesce(F.lag("at").over(along), "top").alias("parent"), F.coalesce(F.lag("depth").over(along), "top_depth").alias("above"),
        "top_depth", "pre", F.max("steps").over(edge).alias("steps"))
    before = F.col("above") - F.col("top_depth")
    return placed.select(
        "at", "depth", "parent", F.expr("slice(steps, int(above - top_depth) + 1, int(depth - above))").alias("steps"),
        F.when(before > 0, F.expr("steps[int(above - top_depth) - 1]")).otherwise(F.col("pre")).alias("pre"))


def below(nodes: DataFrame, sums: list[str], least: str) -> DataFrame:
    """Sums and the minimum over each node's subtree, itself included, for ``nodes`` (at, parent, ...).

    Every round adds what lies as far below as the sums reach so far and doubles that distance, so rounds grow with the logarithm of the height.
    """
    state = nodes.withColumn("jump", F.col("parent"))
    columns = nodes.columns
    while True:
        state = scratch_table(state, "subtrees")
        rising = state.where("jump is not null")
        if rising.isEmpty():
            return state.drop("jump")
        gained = rising.groupBy(F.col("jump").alias("at")).agg(*[F.sum(c).alias(f"__{c}") for c in sums], F.min(least).alias("__least"))
        further = state.select(F.col("at").alias("jump"), F.col("jump").alias("__jump"))
        kept = [c for c in columns if c not in (*sums, least)]
        state = state.join(gained, "at", "left").join(further, "jump", "left").select(
            *kept, *[(F.col(c) + F.coalesce(f"__{c}", F.lit(0))).alias(c) for c in sums], F.least(least, "__least").alias(least), F.col("__jump").alias("jump"))


def digests(ends: DataFrame) -> DataFrame:
    """(at, sha) of ``ends`` (at, conv): SHA-256 of each node's conv ids, ascending and joined by commas.

    Ids are sorted and joined into pieces in parallel, whatever their node; a hash can't be split, so the pieces of a node, one row for thousands of
    ids, then pass through one running hash in order. Nothing is held but a batch of pieces.
    """

    def join(batches):
        for b in batches:
            at = b["at"].to_pylist()
            conv = b["conv"].to_pylist()
            cuts = [0, *[i for i in range(1, len(at)) if at[i] != at[i - 1]], len(at)] if at else [0]
            out = [(at[i], conv[i], ",".join(map(str, conv[i:j])).encode()) for i, j in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], type=t) for k, t in enumerate((pa.binary(), pa.int64(), pa.binary()))], names=["at", "conv", "piece"])

    def run(batches):
        key, state = None, None
        for b in batches:
            done = []
            for at, piece in zip(b["at"].to_pylist(), b["piece"].to_pylist()):
                if at != key:
                    if state is not None:
                        done.append((key, state.hexdigest()))
                    key, state = at, hashlib.sha256(piece)
                else:
                    state.update(b"," + piece)
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], type=pa.binary()), pa.array([d[1] for d in done], type=pa.string())], names=["at", "sha"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], type=pa.binary()), pa.array([state.hexdigest()])], names=["at", "sha"])

    pieces = ends.select("at", "conv").repartitionByRange("at", "conv").sortWithinPartitions("at", "conv").mapInArrow(join, "at binary, conv bigint, piece binary")
    return pieces.repartition("at").sortWithinPartitions("at", "conv").mapInArrow(run, "at binary, sha string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations, one row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``conversations`` has conv_id, turn, role and text; other columns are not looked at, rows without conv_id take no part, null role and
    text are empty, equal turn numbers are ordered by role and text, and repeated rows are turns of their own. No conversation
    gives no row. Prefixes are compared by 128-bit fingerprints.

    Copies of a conversation are one path. Paths are inserted into a z-fast trie in batches until none is left; sums over
    subtrees follow parent links of compacted nodes; each edge then gives a node for every depth it covers.
    """
    turns = numbered(conversations.select("conv_id", "turn", "role", "text"))
    rows = scratch_table(paths(*rebuilt(turns)), "paths")
    ends = rows.where("last").select(F.col("end").alias("at"), "conv", "bytes")
    nodes = scratch_table(compacted(rows), "trie-nodes")
    children = nodes.groupBy(F.col("parent").alias("at")).agg(F.count("*").alias("children"))
    members = ends.groupBy("at").agg(F.count("*").alias("convs"), F.sum("bytes").alias("total"), F.min("conv").alias("conv"))
    root = rows.select(F.lit(ROOT).alias("at")).limit(1).select("at", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("parent"), F.array(F.lit(0).cast("long")).alias("steps"), F.lit(0).cast("long").alias("pre"))
    zero = F.lit(0).cast("long")
    own = nodes.unionByName(root).join(members, "at", "left").join(children, "at", "left").select(
        "at", "depth", "parent", "steps", "pre", F.coalesce("children", zero).alias("children"), F.coalesce("convs", zero).alias("convs"), F.coalesce("total", zero).alias("total"),
        (F.element_at("steps", -1) - F.col("pre")).alias("edge"), (F.element_at("steps", -1) - F.col("pre")).alias("distinct"),
        F.col("children").isNull().cast("long").alias("leaves"), "conv")
    summed = below(own, ["convs", "total", "distinct", "leaves"], "conv")
    parents = summed.select(F.col("at").alias("parent"), F.col("conv").alias("parent_conv"))
    full = summed.join(parents, "parent", "left").join(digests(ends), "at", "left")
    each = full.withColumn("last", F.size("steps") - 1).select("*", F.posexplode("steps").alias("k", "upto"))
    at_end = F.col("k") == F.col("last")
    before = F.when(F.col("k") == 0, F.col("pre")).otherwise(F.expr("steps[k - 1]"))
    deeper = F.col("distinct") - F.col("edge") + F.element_at("steps", -1) - before
    return each.select(
        F.col("conv").alias("conv_id"), (F.col("depth") - F.col("last") + F.col("k")).alias("depth"),
        F.when(F.col("k") == 0, F.col("parent_conv")).otherwise(F.col("conv")).alias("parent_conv_id"), F.col("convs").alias("n_convs"),
        F.when(at_end, F.col("children")).otherwise(F.lit(1)).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("total") - F.col("convs") * before - deeper).alias("saved_tokens"),
        F.coalesce(F.when(at_end, F.col("sha")), F.sha2(F.lit(b""), 256)).alias("ends_sha256"))
