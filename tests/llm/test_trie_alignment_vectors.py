"""Prefix trie, tokenizer alignment and vector near duplicates on small tables with nulls, ties, repeats and clashing columns, against brute force."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from panelloom.llm import alignment, turntrie, vectordup
from panelloom.llm.common import table
from panelloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def brute_trie(rows):
    source = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            source[c].append((t is not None, t or 0, r or "", x or ""))
    turns = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in source.items()}
    nodes, par, members, ends, kids = {(): 0}, {0: None}, collections.defaultdict(list), collections.defaultdict(list), collections.defaultdict(set)
    for c in sorted(turns):
        h = zlib.crc32(str(c).encode()) % 9
        seq = tuple(turns.get(c - int(np.fmod(c, 5)), [])[:h] + turns[c][h:])
        for d in range(len(seq) + 1):
            k = nodes.setdefault(seq[:d], len(nodes))
            members[k].append(c)
            if d:
                par[k] = nodes[seq[: d - 1]]
                kids[par[k]].add(k)
        ends[nodes[seq]].append(c)
    names = {k: s for s, k in nodes.items()}
    leaves, saved = collections.Counter(), collections.Counter()
    for k in sorted(names, key=lambda k: -len(names[k])):
        leaves[k] += not kids[k]
        saved[k] += (len(members[k]) - 1) * (len(names[k][-1][1].encode()) if names[k] else 0)
        if par[k] is not None:
            leaves[par[k]] += leaves[k]
            saved[par[k]] += saved[k]
    return sorted(
        (members[k][0], len(names[k]), members[par[k]][0] if par[k] is not None else -1, len(members[k]), len(kids[k]), leaves[k], saved[k], hashlib.sha256(",".join(map(str, ends[k])).encode()).hexdigest())
        for k in names if members[k])


def trie_rows(out):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in out.collect())


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, depth string, path string, pos int")


def odd_conversations():
    rows = [(None, 1, "user", "lost"), (7, None, "user", "null turn first"), (7, 0, None, None), (7, 0, "a", "tie"), (7, 0, "a", "tie"), (8, 3, "user", ""), (-3, 1, "user", "negative"), (10**12 + 4, 1, "user", "é" * 50000)]
    rows += [(c, t, "user" if t % 2 else "bot", f"line {t} of {c % 3 if t > 2 else 0}") for c in range(20, 60) for t in range(c % 13)]
    rows += [(c, t, "user", "same") for c in range(100, 160) for t in range(12)]  # copies, and a chain of prefixes below
    rows += [(1000 + 5 * c, t, "user", "chain") for c in range(40) for t in range(c)]
    return rows


@pytest.mark.parametrize("segment, load, batch", [(1024, 1 << 14, 1 << 12), (4, 64, 16)])
def test_trie_against_brute_force(spark, monkeypatch, segment, load, batch):
    for name, value in (("SEGMENT", segment), ("LOAD", load), ("BATCH", batch)):
        monkeypatch.setattr(turntrie, name, value)
    rows = odd_conversations()
    assert trie_rows(turntrie.prefix_trie(conversations(spark, rows))) == brute_trie(rows)


def test_trie_of_nothing(spark):
    assert turntrie.prefix_trie(conversations(spark, [])).count() == 0
    assert turntrie.prefix_trie(conversations(spark, [(None, 1, "a", "b")])).count() == 0
    turnless = [(c, 1, "a", "b") for c in range(1, 200) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1][:3]
    assert trie_rows(turntrie.prefix_trie(conversations(spark, turnless))) == brute_trie(turnless)


def test_z_fast_trie_finds_exits():
    rng = np.random.default_rng(3)
    strings = [tuple(rng.integers(0, 2, rng.integers(1, 40))) for _ in range(400)] + [(0,) * n for n in (1, 7, 64, 100)]

    def path(s):
        return b"".join(hashlib.md5(bytes(s[:k])).digest() + bytes(8) for k in range(1, len(s) + 1))

    trie = turntrie.ZFastTrie()
    for n, s in enumerate(strings[:200]):
        trie.insert(path(s), n)
    assert {turntrie.prefix(v.path, v.end) for v in trie.nodes()} >= {turntrie.prefix(path(s), len(s)) for s in strings[:200]}
    for s in strings:
        shared = max(next((k for k, (x, y) in enumerate(zip(s, t)) if x != y), min(len(s), len(t))) for t in strings[:200])
        assert trie.exit(path(s))[1] == shared


@pytest.fixture(scope="module")
def models():
    left = Tokenizer.from_file(alignment.BYTE_MODEL)
    left.encode_special_tokens = True
    return left, sentencepiece.SentencePieceProcessor(model_file=alignment.MODEL)


def brute_alignment(models, texts):
    left, right = models
    names = alignment.byte_names()
    spoken = lambda i: bytes(names[c] for c in left.id_to_token(i))

    def piece(i):
        p = right.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if right.is_byte(i) else p.replace("▁", " ").encode()

    docs = []
    for text in texts:
        a = [(i, spoken(i)) for i in left.encode(f" {text}", add_special_tokens=False).ids] if text else []
        b = [(i, piece(i)) for i in right.encode(text)] if text else []
        whole = f" {text}".encode()
        if not text or b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            a = b = []
        ends = [np.cumsum([len(x) for _, x in s]).tolist() for s in (a, b)]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups, at = [], 0
        for cut in cuts:
            groups.append([[i for (i, _), e in zip(s, end) if at < e <= cut] for s, end in zip((a, b), ends)])
            at = cut
        docs.append((len(a), len(b), groups))
    links = [[(x, y) for g in groups for x in g[0] for y in g[1]] for *_, groups in docs]
    count = collections.Counter(p for found in links for p in set(found))
    most = collections.defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    return [
        (n_a, n_b, len(groups), len(found), sum(count[p] == most[p[0]] for p in found), sum(count[p] for p in found),
         hashlib.sha256(";".join("|".join(",".join(map(str, s)) for s in g) for g in groups).encode()).hexdigest() if groups else "", groups)
        for (n_a, n_b, groups), found in zip(docs, links)]


def test_alignment_against_brute_force(spark, models, monkeypatch):
    monkeypatch.setattr(alignment, "LINKS", 50)
    real = [r.text for r in table(spark, SF, "documents").orderBy("doc_id").limit(25).collect()]
    texts = [None, "", " ", "a▁b", "<|endoftext|> and <s>", "tabs\t\n\n  end ", "naïve 日本語 😀 \x00", "same", "same", "Zwölf I'll we've 123abc", *real]
    rows = [(i if i else None, t, "a", "b", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, block string, key string, pairs int")
    want = brute_alignment(models, texts)
    got = {r.doc_id or 0: r for r in alignment.link_counts(docs).collect()}
    assert len(got) == len(texts)
    for i, w in enumerate(want):
        r = got[i]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) == w[:-1], texts[i]
    for r in alignment.align(docs).collect():
        assert [[list(g.a_ids), list(g.b_ids)] for g in r.groups] == want[r.doc_id or 0][-1]
    assert alignment.link_counts(docs.where("false")).count() == 0


def test_blocks_and_repeated_ids(spark, models, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 1)  # a block every 64 rows
    words = re.findall(r"\w+", table(spark, SF, "documents").where("length(text) > 2000").first().text)
    texts = [" ".join(words[i % 7 : i % 7 + 30]) for i in range(300)]
    docs = spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(2)
    got = collections.Counter((r.doc_id, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in alignment.link_counts(docs).collect())
    assert got == collections.Counter((i // 2, w[3], w[4], w[5], w[6]) for i, w in enumerate(brute_alignment(models, texts)))


def test_groups_step_over_runs():
    rng = np.random.default_rng(5)
    for n in (1, 2, 30, 3000):
        for share in (0.02, 0.5, 1.0):
            cuts = [sorted({n * 3, *np.flatnonzero(rng.random(n * 3) < share).tolist()} - {0}) for _ in range(2)]
            a, b = alignment.groups(*cuts)
            both = sorted(set(cuts[0]) & set(cuts[1]))
            assert [cuts[0][i - 1] for i in a] == both == [cuts[1][i - 1] for i in b], (n, share)


def brute_vectors(rows, least=0.93):
    able = [r for r in rows if r[0] is not None and r[2] is not None and r[1] and None not in r[1] and np.isfinite(r[1]).all() and np.any(r[1])]
    unit = []
    for r in able:
        v = np.array(r[1], dtype=float)
        v = v / np.abs(v).max()
        unit.append(v / np.linalg.norm(v))
    near = [[j for j in range(len(able)) if j != i and able[i][2] == able[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least] for i in range(len(able))]
    label = [r[0] for r in able]
    while True:
        new = [min([label[i], *(label[j] for j in near[i])]) for i in range(len(able))]
        if new == label:
            break
        label = new
    out = collections.Counter((r[0], len(n), c, r[0] == c) for r, n, c in zip(able, near, label))
    out.update((r[0], 0, r[0], True) for r in rows if not any(r is a for a in able))
    return out


def vector_rows(out):
    return collections.Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in out.collect())


@pytest.mark.parametrize("cell, block, dense", [(4096, 1024, 512), (20, 16, 10)])
def test_vector_duplicates_against_brute_force(spark, monkeypatch, cell, block, dense):
    for name, value in (("CELL", cell), ("BLOCK", block), ("DENSE", dense)):
        monkeypatch.setattr(vectordup, name, value)
    rng = np.random.default_rng(8)
    base = rng.normal(size=(60, 24))
    rows = [(i, (base[i % 60] + rng.normal(size=24) * 0.07 * (i % 4)).tolist(), i % 3) for i in range(400)]  # cosines on both sides of the threshold
    rows += [(1000 + i, (base[0] + rng.normal(size=24) * 0.12).tolist(), 0) for i in range(120)]  # a dense group and what lies around it
    rows += [(2000 + i, base[1].tolist(), 1) for i in range(50)] + [(2100, (base[1] * 1e180).tolist(), 1), (2101, (base[1] * 1e-180).tolist(), 1)]
    rows += [(3000, None, 1), (3001, [], 1), (3002, [0.0] * 24, 1), (3003, [float("nan")] + [1.0] * 23, 1), (3004, [None] + [1.0] * 23, 1), (3005, [float("inf")] * 24, 1),
             (3006, base[1].tolist(), None), (None, base[1].tolist(), 1), (3007, base[1][:5].tolist(), 1), (3008, base[1][:5].tolist(), 1), (7, base[1].tolist(), 1), (3009, [-0.0, 1.0], 2), (3010, [0.0, 1.0], 2)]
    frame = spark.createDataFrame([(*r, "a", 1.0, b"x") for r in rows], "vec_id bigint, embedding array<double>, label int, cid string, n double, open binary")
    assert vector_rows(vectordup.vector_duplicates(frame)) == brute_vectors(rows)


def test_vector_duplicates_of_nothing_and_recall(spark):
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    assert vectordup.vector_duplicates(empty).count() == 0
    plan = vectordup.Plan(0.93, 5e-4)
    rng = np.random.default_rng(9)
    x = vectordup.units(rng.normal(size=(4000, 64)))
    side = rng.normal(size=x.shape)
    side = vectordup.units(side - (side * x).sum(axis=1, keepdims=True) * x)
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * side  # pairs right at the threshold, the hardest to find
    for levels in (1, 2, 4):
        orders = plan.orders(levels)
        m = max(vectordup.COUNTED, levels * orders)
        hit = np.abs((x - y) @ vectordup.directions(64, m).T) <= plan.half
        met = hit[:, : levels * orders].reshape(len(x), orders, levels).all(axis=2).any(axis=1)
        assert (met & (hit.sum(axis=1) >= plan.least(m))).mean() >= 0.9975
    assert sum(QUERIES["op13_vectordup"](spark, SF).select("n_links").toPandas().n_links) == 0
