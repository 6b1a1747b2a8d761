"""MinHash near duplicates: banded candidates, sequential Bayesian pruning, exact verification, components."""

from __future__ import annotations

from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_table
from .common import U64, shingles, slices, small_batches, word_hashes, word_spans

#: Words of a shingle; linked at PERCENT or more; bands of ROWS signature values; values compared at once; chance of pruning a true link.
SHINGLE, PERCENT, BANDS, ROWS, BATCH, MISS = 4, 80, 25, 5, 25, 1e-5
#: Documents in a block of a bucket; shingles in a block of a group; columns of an incidence matrix; members that meet a whole group at first.
BLOCK, SHINGLES, COLUMNS, LEADS = 512, 1 << 17, 4096, 4
HASHES = BANDS * ROWS
_DRAW = np.random.default_rng(404)
_FACTOR = _DRAW.integers(0, 1 << 63, HASHES, dtype=np.uint64) * U64(2) + U64(1)
_SHIFT = _DRAW.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def signature(found: np.ndarray) -> bytes:
    """HASHES minima over a non-empty set of shingle hashes, 32 bits each."""
    low = np.full(HASHES, ~U64(0))
    for i in range(0, len(found), 256):
        low = np.minimum(low, (found[None, i : i + 256] * _FACTOR[:, None] + _SHIFT[:, None]).min(axis=1))
    return (low >> U64(32)).astype("<u4").tobytes()


def text_shingles(texts: pa.Array | pa.ChunkedArray, size: int = SHINGLE):
    """Sorted distinct shingle hashes of every whole text, in row order; none for null and wordless texts."""
    for _, data, offsets in slices(texts):
        starts, ends, at = word_spans(data, offsets)
        hashes = word_hashes(data, starts, ends)
        for a, b in zip(at[:-1], at[1:]):
            yield shingles(hashes[a:b], size)


def signatures(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, text) -> doc_id, n_shingles, two fingerprints of the set and its signature (null for an empty set)."""

    def measure(batches):
        for b in batches:
            found = list(text_shingles(b["text"], size))
            yield pa.RecordBatch.from_arrays([
                b["doc_id"], pa.array([len(x) for x in found], type=pa.int64()),
                pa.array([int(np.bitwise_xor.reduce(x).view(np.int64)) if len(x) else 0 for x in found], type=pa.int64()),
                pa.array([int(x.sum().view(np.int64)) if len(x) else 0 for x in found], type=pa.int64()),
                pa.array([signature(x) if len(x) else None for x in found], type=pa.binary()),
            ], names=["doc_id", "n_shingles", "fp1", "fp2", "sig"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(measure, "doc_id bigint, n_shingles bigint, fp1 bigint, fp2 bigint, sig binary")


@lru_cache
def fewest_matches(compared: int, percent: int = PERCENT, miss: float = MISS) -> int:
    """Fewest equal values among ``compared`` for which a pair can't be pruned.

    With a flat prior, similarity given m of n equal values is Beta(m + 1, n - m + 1); its upper tail at t is a binomial sum.
    A pair is pruned when P(similarity >= percent / 100) < miss.
    """
    t = percent / 100
    tail = 0.0
    for m in range(compared + 1):
        tail += comb(compared + 1, m) * t**m * (1 - t) ** (compared + 1 - m)
        if tail >= miss:
            return m
    return compared


def possible(left: np.ndarray, right: np.ndarray, percent: int = PERCENT, miss: float = MISS) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of two signature matrices that stay possible links when BATCH values after the other are compared."""
    x, y = map(np.ravel, np.meshgrid(np.arange(len(left)), np.arange(len(right)), indexing="ij"))
    equal = np.zeros(len(x), dtype=np.int64)
    for n in range(BATCH, HASHES + 1, BATCH):
        equal = equal + (left[x, n - BATCH : n] == right[y, n - BATCH : n]).sum(axis=1)
        alive = equal >= fewest_matches(n, percent, miss)
        x, y, equal = x[alive], y[alive], equal[alive]
    return x, y


def overlapping(left: list[np.ndarray], right: list[np.ndarray], percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of two lists of shingle sets with 100 * intersection >= percent * union, counted over all shingles.

    Shared shingles become columns of two 0/1 matrices, COLUMNS at a time; their product counts intersections.
    """
    counts = np.zeros((len(left), len(right)))
    sides = [(np.repeat(np.arange(len(s)), [len(v) for v in s]), np.concatenate(s)) for s in (left, right)]
    shared = np.intersect1d(sides[0][1], sides[1][1])
    at = [(row[keep], np.searchsorted(shared, value[keep])) for row, value in sides for keep in [np.isin(value, shared)]]
    for first in range(0, len(shared), COLUMNS):
        m = []
        for (row, col), n in zip(at, counts.shape):
            own = (col >= first) & (col < first + COLUMNS)
            m.append(np.zeros((n, min(COLUMNS, len(shared) - first)), dtype=np.float32))
            m[-1][row[own], col[own] - first] = 1
        counts += m[0] @ m[1].T
    total = np.array([len(v) for v in left])[:, None] + np.array([len(v) for v in right])[None, :]
    return np.nonzero((100 * counts >= percent * (total - counts)) & (counts > 0))


def spanning(ids: np.ndarray, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For nodes with ascending ``ids`` linked by index pairs: (smallest id of the node's component, id, number of links) of every linked node."""
    label = np.arange(len(ids))
    while len(p):
        low = np.minimum(label[p], label[q])
        new = label.copy()
        np.minimum.at(new, p, low)
        np.minimum.at(new, q, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    own = p != q
    links = np.bincount(p[own], minlength=len(ids)) + np.bincount(q[own], minlength=len(ids))
    at = np.flatnonzero(links)
    return ids[label[at]], ids[at], links[at]


def linked_in_blocks(members: DataFrame, load: str, most: int, test) -> DataFrame:
    """Edges (a, b, n) that join what ``test`` links between a lead and any member of its group, over ``members`` (grp, doc, payload, lead).

    A group is dealt into blocks by a hash of doc, leads apart from the others, so many that a block holds about ``most`` of
    column ``load``; every block of leads meets every block of its group in one row, tested as a matrix in one go. A row is
    copied once a block of leads, a lead once a block. A pair of blocks yields at most one edge a document, never its
    pairs: a is the smallest id that b is joined to there (itself at times), n the number of b's links.
    ``test`` takes two lists of payloads and returns linked index pairs.
    """
    blocks_of = [F.ceil(F.coalesce(F.sum(F.when(side, F.col(load))), F.lit(0)) / most).cast("int") for side in (F.col("lead"), ~F.col("lead"))]
    sizes = members.groupBy("grp").agg(blocks_of[0].alias("leads"), blocks_of[1].alias("others")).where("leads > 0")
    sizes = scratch_table(sizes, "group-sizes")  # an aggregate inside the join's stage would keep Spark from splitting a hot group there
    dealt = members.join(sizes, "grp").withColumn("blk", F.expr("int(if(lead, pmod(xxhash64(doc), leads), leads + pmod(xxhash64(doc), others)))"))
    meets = F.sequence(F.lit(0), F.expr("if(lead, leads + others, leads) - 1"))
    copies = dealt.select("grp", "blk", "doc", "payload", F.explode(meets).alias("other"))
    copies = copies.withColumn("i", F.least("blk", "other")).withColumn("j", F.greatest("blk", "other"))
    # dealt by all three, as rows that lie together by group already would all stay in one task
    rows = copies.repartition("grp", "i", "j").groupBy("grp", "i", "j").agg(
        F.collect_list(F.struct("doc", "blk", "payload")).alias("docs")).where("size(docs) > 1")

    def run(batches):
        for b in batches:
            edges = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
            for i, j, docs in zip(b["i"].to_pylist(), b["j"].to_pylist(), b["docs"]):
                docs = docs.values
                ids, order = np.unique(docs.field("doc").to_numpy(), return_index=True)
                block = docs.field("blk").to_numpy()[order]
                payload = docs.field("payload").take(pa.array(order)).to_pylist()
                left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
                if len(left) == 0 or len(right) == 0:
                    continue
                p, q = test([payload[x] for x in left], [payload[x] for x in right])
                for side, found in zip(edges, spanning(ids, left[p], right[q])):
                    side.append(found)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in edges], names=["a", "b", "n"])

    found = rows.select("i", "j", "docs").mapInArrow(run, "a bigint, b bigint, n bigint")
    return found.groupBy("a", "b").agg(F.sum("n").alias("n"))


def linked_components(members: DataFrame, load: str, most: int, test) -> DataFrame:
    """(doc, comp) of what ``test`` links inside any group of ``members`` (grp, doc, payload, and the size of a row in ``load``).

    Only what is joined counts, so pairs that are joined already need no test. First LEADS drawn members of each group meet
    all of it, then, where a group isn't all joined, the LEADS with most links so far. At last every member outside the
    group's largest part meets the whole group: with that, each pair is either joined or tested. A group of copies of one
    text is thus settled in time linear in its size; only a large group that falls apart needs more.
    """
    drawn = [F.min_by("doc", F.xxhash64("doc", F.lit(r))) for r in range(LEADS)]
    leads = scratch_table(members.groupBy("grp").agg(F.array(*drawn).alias("leads")), "leads")
    asked = members.join(leads, "grp").withColumn("lead", F.array_contains("leads", F.col("doc"))).drop("leads")
    edges = scratch_table(linked_in_blocks(asked, load, most, test), "drawn-links")
    comp = components(edges)
    for last in (False, True):
        placed = members.select("grp", "doc").distinct().join(comp, "doc", "left").select("grp", "doc", F.coalesce("comp", "doc").alias("part"))
        parts = placed.groupBy("grp", "part").agg(F.count("*").alias("n")).groupBy("grp").agg(
            F.max_by("part", F.struct("n", "part")).alias("main"), F.count("*").alias("parts"), F.sum("n").alias("size"))
        # of two members one has met the other
        apart = placed.join(scratch_table(parts.where("parts > 1 and size > 2"), "parts"), "grp")
        if last:
            apart = apart.withColumn("lead", F.col("part") != F.col("main"))
        else:
            degree = edges.groupBy(F.col("b").alias("doc")).agg(F.sum("n").alias("links"))
            best = Window.partitionBy("grp").orderBy(F.desc("links"), "doc")
            liked = apart.select("grp", "doc").join(degree, "doc").withColumn("place", F.row_number().over(best)).where(F.col("place") <= LEADS)
            apart = apart.join(liked.select("grp", "doc", F.lit(True).alias("liked")), ["grp", "doc"], "left").withColumn("lead", F.coalesce("liked", F.lit(False)))
        apart = scratch_table(apart.select("grp", "doc", "lead"), "apart")
        if apart.isEmpty():
            return comp
        # settled groups stay settled: only the others, with their payloads, are shuffled from here on
        asked = members.join(apart, ["grp", "doc"])
        if not last:
            asked = scratch_table(asked, "unsettled")
            members = asked.drop("lead")
        edges = edges.unionByName(scratch_table(linked_in_blocks(asked, load, most, test), "more-links"))
        comp = components(edges)
    return comp


def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (doc, comp): the smallest id reachable, for every id in an edge.

    Every round hooks each label to the smallest label next to it and then halves the paths between labels, so rounds grow
    with the logarithm of a component's diameter. Labels are written out every round; only a count reaches the driver.
    """
    both = edges.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(edges.select(F.col("b").alias("x"), F.col("a").alias("y")))
    label = scratch_table(both.groupBy("x").agg(F.least("x", F.min("y")).alias("l")), "labels")
    while True:
        near = edges.join(label.select(F.col("x").alias("a"), F.col("l").alias("la")), "a").join(label.select(F.col("x").alias("b"), F.col("l").alias("lb")), "b")
        hooks = near.where("la <> lb").select(F.greatest("la", "lb").alias("h"), F.least("la", "lb").alias("to")).groupBy("h").agg(F.min("to").alias("to"))
        hooks = scratch_table(hooks, "hooks")
        if hooks.isEmpty():
            return label.select(F.col("x").alias("doc"), F.col("l").alias("comp"))
        # where a hook leads is itself hooked: follow it once and, if that moved, once more
        for _ in range(2):
            further = hooks.select(F.col("h").alias("to"), F.col("to").alias("next"))
            hooks = hooks.join(further, "to", "left").select("h", F.coalesce("next", "to").alias("to"))
        label = scratch_table(label.join(hooks, label["l"] == hooks["h"], "left").select("x", F.coalesce("to", "l").alias("l")), "labels")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, miss: float = MISS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text; other columns are not looked at).

    A document's set holds its distinct shingles of ``size`` words; documents with 100 * intersection >= percent * union are
    linked; component_id is the smallest id reachable and kept marks it. Null and wordless texts are linked with nothing.
    A null id gives a null component that is kept; rows with one id count as one document.

    Equal sets fall together by fingerprint, so one document of each set goes on. Sets that share a band of their signatures
    are candidates (a link at the threshold is missed with chance (1 - 0.8**5)**25 = 5e-5). The posterior of a candidate's
    similarity prunes it after any batch of values; what is left falls into groups, and inside a group links are confirmed on
    full sets, for all pairs but those that confirmed links join already. Both tests run on pairs of blocks, so that neither a large bucket
    nor a large group is ever expanded into rows of pairs or held by one task. Only texts of documents in groups are looked at again.
    """
    docs = small_batches(docs).select(F.col("doc_id").cast("long"), "text")
    sigs = scratch_table(signatures(docs, size), "signatures")
    sets = sigs.where("sig is not null and doc_id is not null").groupBy("fp1", "fp2", "n_shingles", "sig").agg(F.min("doc_id").alias("doc"))
    sets = scratch_table(sets, "sets")
    bands = sets.select("doc", F.explode(F.array(*[F.xxhash64(F.lit(i), F.substring("sig", 1 + 4 * ROWS * i, 4 * ROWS)) for i in range(BANDS)])).alias("grp"))
    shared = scratch_table(bands.groupBy("grp").agg(F.count("*").alias("n")).where("n > 1").select("grp"), "shared")
    buckets = bands.join(shared, "grp").join(sets.select("doc", F.col("sig").alias("payload")), "doc").withColumn("one", F.lit(1))

    def by_signature(left, right):
        return possible(*(np.frombuffer(b"".join(s), dtype="<u4").reshape(-1, HASHES) for s in (left, right)), percent, miss)

    def by_set(left, right):
        return overlapping(*([np.frombuffer(v, dtype="<u8") for v in s] for s in (left, right)), percent)

    def load(batches):
        for b in batches:
            payload = [x.astype("<u8").tobytes() for x in text_shingles(b["text"], size)]
            yield pa.RecordBatch.from_arrays([b["grp"], b["doc"], pa.array(payload, type=pa.binary()), pa.array([len(x) // 8 for x in payload], type=pa.int64())], names=["grp", "doc", "payload", "n"])

    groups = linked_components(scratch_table(buckets, "buckets"), "one", BLOCK, by_signature)
    texts = docs.join(groups, docs["doc_id"] == groups["doc"]).select(F.col("comp").alias("grp"), "doc", "text")
    full = scratch_table(texts.mapInArrow(load, "grp bigint, doc bigint, payload binary, n bigint"), "full-sets")
    comp = linked_components(full, "n", SHINGLES, by_set)

    classes = sets.join(comp, "doc", "left").select("fp1", "fp2", "n_shingles", F.coalesce("comp", "doc").alias("comp"))
    out = sigs.drop("sig").join(classes, ["fp1", "fp2", "n_shingles"], "left")
    found = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("comp"))
    out = out.select("doc_id", "n_shingles", F.coalesce(found, "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
