"""The operators on small tables with nulls, ties, repeats, long texts and clashing columns, against brute force."""

import gzip
import re

import numpy as np
import pyarrow as pa
import pytest

from panelloom.llm import ann, extract, language, mixing, neardup, pieces, quality, topk, toxicity, warc
from panelloom.llm.common import held_out, table

SF = "/root/testdata/sf0.01"


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, score string, target string")


def test_rows_without_id_are_drawn_one_by_one(spark):
    def mixed(text):  # source b is cut to less than its words; a third of them in rows without id
        rows = [(i, "w " * 20, None, "a", None, None) for i in range(300)] + [(i, "w " * 20, None, "b", None, None) for i in range(1000, 1200)]
        rows += [(None, text(i), None, "b", None, None) for i in range(100)]
        out = [r for r in mixing.mix_sources(docs(spark, rows)).select("doc_id", "source", "text", "copies", "taken", "target").collect() if r.source == "b"]
        return out, sorted((r.doc_id or 0, r.text, r.copies) for r in out)

    for text in (lambda i: "w " * 20, lambda i: f"{i} " * 20):
        out, found = mixed(text)
        assert abs(sum(r.taken for r in out) - out[0].target) <= 10 and found == mixed(text)[1]
        assert len({r.copies for r in out if r.doc_id is None}) == 2


@pytest.fixture(scope="module")
def odd(spark):
    long = "the quick brown fox jumps over it " * 9000
    rows = [(1, None, None, None, "x", "y"), (2, "", "en", "a", None, "y"), (3, " \n\t", "en", "a", "x", "y"), (4, long, "en", "b", "x", None), (5, long, "en", "b", "x", "y"), (5, "repeated id", "en", "b", "x", "y"), (None, "no id", "en", "b", "x", "y")]
    return docs(spark, rows)


def test_text_operators_keep_every_row_and_column(spark, odd):
    real, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    for out in (
        toxicity.score_toxicity(odd, toxicity.fit_toxicity(real, labels)), quality.score_quality(odd, quality.fit_quality(real, labels)),
        language.predict_language(odd, language.fit_languages(real)), mixing.mix_sources(odd),
    ):
        rows = out.collect()
        assert len(rows) == 7 and set(odd.columns) <= set(out.columns)
    named = {r.text: r for r in language.predict_language(odd, language.fit_languages(real)).collect()}
    assert named[None].lang_pred == named[""].lang_pred == "und" and named[""].score == 0.0
    assert mixing.mix_sources(odd.where("false")).count() == 0


def test_models_without_labels(spark, odd):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert all(0 <= r.score <= 1 for r in toxicity.score_toxicity(odd, toxicity.fit_toxicity(odd, none)).collect())
    assert all(0 <= r.score <= 1 for r in quality.score_quality(odd, quality.fit_quality(odd, none)).collect())


@pytest.mark.parametrize("name, label, modulus, held, least", [("toxicity", "toxic", 5, 0, 0.9), ("quality", "quality", 3, 1, 0.95)])
def test_held_out_accuracy(spark, name, label, modulus, held, least):
    module = {"toxicity": toxicity, "quality": quality}[name]
    real, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = getattr(module, f"fit_{name}")(real, labels)
    rows = getattr(module, f"score_{name}")(real.select("doc_id", "text"), model).join(labels, "doc_id").where(held_out("doc_id", modulus, held)).collect()
    assert np.mean([(r.score >= 0.5) == r[label] for r in rows]) >= least


def test_language_accuracy(spark):
    real = table(spark, SF, "documents")
    rows = language.predict_language(real, language.fit_languages(real)).where(held_out("doc_id", 4, 2)).collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) >= 0.95


def test_narrow_leads_are_rejected_at_every_size(spark, monkeypatch):
    best = [12, 60, 200, 255, 256, 1000, 100000]
    model = language.LanguageDictionaries({"aa": b"", "bb": b"", "cc": b""})

    def judged(lead):  # texts "x<best>"; the second language needs ``lead`` bytes more
        def run(text, compressors):
            return np.array([int(text[1:]), int(text[1:]) + lead(int(text[1:])), 10**9])

        monkeypatch.setattr(language, "sizes", run)
        rows = language.predict_language(docs(spark, [(n, f"x{n}", None, None, None, None) for n in best]), model).collect()
        return [r.rejected for r in sorted(rows, key=lambda r: r.doc_id)]

    assert judged(lambda n: 0) == [True] * len(best)
    assert judged(lambda n: 1)[1:] == [True] * (len(best) - 1)
    assert judged(lambda n: n // 10 + 1) == [False] * len(best)
    real = language.LanguageDictionaries({"en": b"the cat sat on the mat and the dog ran over the old green hill ", "de": b"der hund lief durch den alten wald und die katze lag auf dem dach "})
    monkeypatch.undo()
    texts = ["qwzx", "the cat sat on the mat and the dog ran", "der hund lief durch den alten wald", "the cat sat on der hund lief d"]
    got = {r.text: r for r in language.predict_language(docs(spark, [(i, t, None, None, None, None) for i, t in enumerate(texts)]), real).collect()}
    assert [got[t].rejected for t in texts] == [True, False, False, True]


def test_near_duplicates_against_brute_force(spark):
    real = table(spark, SF, "documents").select("doc_id", "text").where("doc_id < 400").collect()
    rows = [(r.doc_id, r.text) for r in real] + [(1001, None), (1002, ""), (1003, " \t "), (1004, "one TWO"), (1005, "One two"), (1006, real[0].text.upper()), (None, "one two"), (1007, " ".join(map(str, range(30000))))]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    sets = {}
    for i, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(low))
        sets[i] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()
    ids = sorted(i for i in sets if i is not None)
    root = {i: i for i in ids}
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b]) if a < b else 0
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                lo, hi = sorted((root[a], root[b]))
                root = {k: lo if v == hi else v for k, v in root.items()}
    assert len(got) == len(rows)
    for r in got:
        assert r.n_shingles == len(sets[r.doc_id])
        assert (r.component_id, r.kept) == ((root[r.doc_id], root[r.doc_id] == r.doc_id) if r.doc_id is not None else (None, True))
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_one_large_group_spreads_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 4)
    monkeypatch.setattr(neardup, "SHINGLES", 400)
    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join([*base[:40], f"x{i}", *base[40:]])) for i in range(40)]
    assert {r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()} == {0}


def test_groups_that_fall_apart_lose_no_link(spark, monkeypatch):
    """A star whose spokes are linked to its centre alone, a chain, and two texts next to the star but not linked with it."""
    monkeypatch.setattr(neardup, "BLOCK", 4)
    monkeypatch.setattr(neardup, "SHINGLES", 400)
    base = [f"w{i}" for i in range(103)]

    def changed(*at):
        return " ".join(f"y{k}.{at}" if k in at else w for k, w in enumerate(base))

    texts = [changed(k, k + 40) for k in range(5, 35)] + [" ".join(base)] + [changed(*range(3, 100, 12)), changed(*range(6, 100, 12))]
    texts += [" ".join(f"c{i}" for i in range(12 * k, 12 * k + 120)) for k in range(9)]
    sets = [{tuple(t.split()[k : k + 4]) for k in range(len(t.split()) - 3)} for t in texts]
    root = list(range(len(texts)))
    for a in root[:]:
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                lo, hi = sorted((root[a], root[b]))
                root = [lo if v == hi else v for v in root]
    assert root[:31] == [0] * 31 and len(set(root[33:])) == 1 and len(set(root)) == 4
    got = neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(root))


def test_mixing_meets_targets_and_reruns_agree(spark):
    real = table(spark, SF, "documents")
    rows = mixing.mix_sources(real).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in mixing.mix_sources(real.repartition(7)).collect())
    total = sum(r["size"] for r in rows)
    by = {}
    for r in rows:
        assert r.taken <= 3 * r["size"]
        by.setdefault(r.source, [r.target, 0, 0, r.source_size])
        by[r.source][1] += r.taken
        by[r.source][2] = max(by[r.source][2], r["size"])
    assert sum(t for t, *_ in by.values()) == pytest.approx(total)
    assert all(abs(taken - t) <= longest and t <= 3 * size + 1e-6 for t, taken, longest, size in by.values())


def test_mixing_with_weights(spark):
    rows = [(i, "w " * (1 + i % 7), "s", float(1 + i % 3)) for i in range(300)] + [(1000, "a b", None, None)]
    out = mixing.mix_sources(spark.createDataFrame(rows, "doc_id bigint, text string, source string, w double"), weight="w").collect()
    assert all(r.taken <= 3 * r["size"] for r in out)
    assert abs(sum(r.taken for r in out if r.source == "s") - max(r.target for r in out if r.source == "s")) <= 7


def vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(120)]
    rows += [(200 + i, rows[7][1]) for i in range(30)]
    rows += [(300, None), (400, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (500, [float("nan")] * 6), (600, [0.0] * 6), (700, []), (None, rows[1][1]), (800, [1.0, 2.0])]
    return rows, spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")


@pytest.mark.parametrize("search, k, zero", [("exact", 10, True), ("near", 5, False)])
def test_searches_against_brute_force(spark, search, k, zero):
    rows, df = vectors(spark)
    use = {i: v for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and (zero or any(v))}
    scale = (lambda v: np.floor(1024 * np.array(v))) if search == "exact" else np.array
    queries = df.where("vec_id % 20 = 0")
    got = (topk.top_k(df, queries, k) if search == "exact" else ann.nearest(df, queries, k, tables=10, probes=60)).collect()
    want = []
    for q in [i for i in use if i % 20 == 0]:
        found = sorted((-float(sum(scale(use[q]) * scale(v))), i) for i, v in use.items() if i != q and len(v) == len(use[q]))[:k]
        want += [(q, n + 1, i) for n, (_, i) in enumerate(found)]
    have = {(r.query_id, r["rank"], r.vec_id) for r in got}
    assert have == set(want) if search == "exact" else len(have & set(want)) >= 0.9 * len(want)


def test_ann_recall(spark):
    rows = table(spark, SF, "embeddings").select("vec_id", "embedding").collect()
    v = np.array([r.embedding for r in rows], dtype=float)
    got = {(r.query_id, r.vec_id) for r in ann.nearest(table(spark, SF, "embeddings"), table(spark, SF, "embeddings").where("vec_id % 20 = 0"), 20).collect()}
    want = set()
    for i, r in enumerate(rows):
        if r.vec_id % 20 == 0:
            s = v @ v[i]
            s[i] = -np.inf
            want |= {(r.vec_id, rows[j].vec_id) for j in np.argsort(-s, kind="stable")[:20]}
    assert len(got & want) >= 0.9 * len(want)


def test_nearest_of_very_short_vectors(spark):
    x = np.random.default_rng(8).normal(size=(120, 6)) * 1e-8
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = {}
    for r in ann.nearest(rows, rows.where("vec_id % 30 = 0"), k=5, probes=64).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    for q, found in got.items():
        assert found == [i for i in np.argsort(-(x @ x[q]), kind="stable") if i != q][:5]
    assert len(got) == 4


def test_warc_round_trip_and_salvage(spark, tmp_path):
    rows = [(1, "http://a/é b", "<p>x</p>"), (2, None, None), (3, "u", "<p>x</p>"), (4, "u", ""), (None, "u", "<p>x</p>"), (5, "u", "日本" * 70000)]
    path = warc.write_archives(spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1))
    got = {(r.record_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.read_archives(spark, path).collect()}
    assert got == {
        ("<urn:page:1>", "revisit", "<urn:page:3>", 8), ("<urn:page:3>", "response", None, 8), ("<urn:page:>", "revisit", "<urn:page:3>", 8),
        ("<urn:page:2>", "revisit", "<urn:page:4>", 0), ("<urn:page:4>", "response", None, 0), ("<urn:page:5>", "response", None, 420000),
    }
    records = [warc.record(i, "u", b"payload %d" % i * 50, None) for i in range(6)]
    members = [warc.member(r) for r in records]
    broken = bytearray(members[2])
    broken[len(broken) // 2] ^= 255
    data = b"junk" + members[0] + members[1] + bytes(broken) + records[3] + members[4][:-20] + members[5]
    found = list(warc.salvage(data))
    assert [x["record_id"] for *_, x in found if isinstance(x, dict)] == [f"<urn:page:{i}>" for i in (0, 1, 3, 5)]
    gaps = [(a, b) for a, b, x in found if isinstance(x, str)]
    at = 4 + len(members[0]) + len(members[1])
    assert gaps[:2] == [(0, 4), (at, at + len(broken))] and len(gaps) == 3
    assert list(warc.salvage(b"")) == []


def test_salvage_of_members_with_many_records():
    rng = np.random.default_rng(3)
    records = [warc.record(i, "u", rng.integers(32, 127, 30000, dtype=np.uint8).tobytes(), None) for i in range(12)]

    def ids(data):
        return [x["record_id"] for *_, x in warc.salvage(data) if isinstance(x, dict)]

    def reasons(data):
        return [x for *_, x in warc.salvage(data) if isinstance(x, str)]

    names = [f"<urn:page:{i}>" for i in range(12)]
    one = gzip.compress(b"".join(records))
    assert ids(one) == names and not reasons(one)
    assert ids(one + warc.member(records[0])) == [*names, names[0]]
    bad = bytearray(records[1])
    bad[-100] ^= 1
    inner = gzip.compress(records[0] + bytes(bad) + records[2] + b"junk" + records[3])
    assert ids(inner) == [names[0], names[2], names[3]] and reasons(inner) == ["block digest differs", "bytes after the record"]
    cut = one[: len(one) * 2 // 3] + warc.member(records[11])
    assert ids(cut)[:7] == names[:7] and ids(cut)[-1] == names[11] and len(reasons(cut)) == 1
    hurt = bytearray(one)
    hurt[len(one) // 2 : len(one) // 2 + 2000] = bytes(2000)
    assert ids(bytes(hurt))[:5] == names[:5]
    stored = gzip.compress(b"".join(records), compresslevel=0)
    assert ids(stored[:-20]) == names[:11]
    assert ids(one[:-9] + inner[:-9]) == [*names, names[0], names[2], names[3]]
    assert ids(gzip.compress(records[0])[:-4] + records[1]) == names[:2]


def test_extraction(spark):
    html = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>'</script></head><body class='has-sidebar'><nav><ul><li><a href='/'>Home</a></ul></nav>"
        "<div class=ad>Buy now</div><article><h1>A &amp; B</h1><p>One<br>two  three<p>Caf&eacute; <b>bold</b> text<aside>more</aside><form>mail</form></article>"
        "<section id='comments'><p>First comment that is long enough to look like an article, with many words in it, and more of them.</p></section><footer>&copy; us</footer>"
    )
    rows = [(1, "u", html), (2, None, None), (3, "u", ""), (None, "u", "<p"), (4, "u", "<div>" + "word " * 40 + "</div><nav>menu</nav>"), (5, "u", "<article><p>" + "x " * 50000)]
    got = {r.page_id: r for r in extract.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[1].text == "A & B\nOne two three\nCafé bold text"
    assert got[2].text == got[3].text == got[None].text == "" and got[2].n_chars == 0
    assert got[4].text == ("word " * 40).strip() and got[5].n_chars == 99999


def texts_of(*pages):
    return [r[0] for r in extract.main_texts(list(pages), extract.block_tree())]


def test_embedded_elements_lose_no_article():
    body = "word " * 40
    article = f"<article><p>{body}</p></article>"
    for before in (
        "<select><option>A<option selected>B</select>", "<select><optgroup label=x><option>A<optgroup label=y><option>B</select>", "<datalist><option value=a><option value=b></datalist>", "<option>A<option>B",
        "<svg width='1'/>", "<svg viewBox='0'><path d='M0'/><title>Icon</title><text>Icon</text></svg>", "<svg><path d='M0'><g>", "<div><svg><g></div>", "<svg><g><p></p><svg></svg>",
        "<math/>", "<object data='a'/>", "<object data='a'>", "<object><p>no plugin</p></object>", "<iframe src='a'/>", "<iframe src='a'>", "<iframe>old browser</iframe>", "<svg><title/></svg>",
        "<option-list>", "<title-bar></title-bar>", "<svg-icon name='a'></svg-icon>", "<object-view>", "<style-guide>", "<template><div><template></template>x</div></template>",
    ):
        assert texts_of(before + article) == [body.strip()], before
    for inner in ("<svg><path/></svg>", "<math><mi>x</mi></math>", "<object>y</object>", "<iframe>y</iframe>", "<svg/>", "<svg><title>t</title><text>y</text></svg>", "<math><mtext><b>y</b></mtext></math>"):
        assert texts_of(f"<article><p>{body}{inner} end</p></article>") == [body + "end"], inner
    assert texts_of(f"<article><p>{body}<svg><text>y</p><p>{body}</p></svg></article>") == [body.strip() + "\n" + body.strip()]
    assert texts_of(f"<script>a</scripts></script >{article}") == [body.strip()]


def test_marked_wrappers_lose_no_article():
    body, short = "word " * 40, "Short."
    inside = f"<p>{body}</p><p>{short}</p>"
    whole = body.strip() + "\n" + short
    for start, end in (
        ("<main class='layout with-sidebar'>", "</main>"), ("<article class='post comments-open'>", "</article>"), ("<article class='related'>", "</article>"), ("<main id=main role=main class='widget'>", "</main>"),
        ("<div class='content with-sidebar'>", "</div>"), ("<div class='sidebar content'>", "</div>"), ("<div class='sidebar'><div class='content'>", "</div></div>"), ("<div class='layout social'><main>", "</main></div>"),
        ("<div id='page' class='no-sidebar'><div class='entry-content'>", "</div></div>"), ("<div class='comments-closed post'>", "</div>"), ("<div class='layout--has-sidebar'><article>", "</article></div>"), ("<form id=aspnet><div id=content>", "</div></form>"),
    ):
        assert texts_of(start + inside + end) == [whole], start
    assert texts_of(f"<div id='page' class='no-sidebar'><p>{body}</p></div>") == [body.strip()]
    long = "word " * 250
    assert texts_of(f"<div class='sidebar'><p>{long}</p></div>", f"<aside><p>{long}</p></aside>", f"<div hidden><p>{long}</p></div>") == [long.strip(), "", ""]
    for aside in (
        f"<div class='sidebar'><p>{body}</p></div>", f"<div class='site-footer'><p>{body}</p></div>", f"<div class='post-navigation'><p>{body}</p></div>", f"<aside><div class='content'><p>{body}</p></div></aside>",
        f"<div id='comments'><article class='comment-body'><div class='comment-content'><p>{body}</p></div></article></div>", f"<div class='content' style='display:none'><p>{body}</p></div>",
    ):
        assert texts_of(aside + f"<article>{inside}</article>") == [whole], aside


def test_pieces_equal_the_library(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = [r.text for r in table(spark, SF, "documents").select("text").limit(150).collect()]
    texts += [None, "", " ", "a" * 5000, "日本語😀\x00é" * 300, "  two  spaces\n\n", "=" * 777 + " x" * 900, "<s>[PAD]</s>"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in pieces.with_decoded(pieces.encode(df, chunk=500)).collect()}
    for i, t in enumerate(texts):
        assert list(got[i].ids) == (lib.encode(t) if t else [])
        assert got[i].text == (t or "")


def test_max_plus_products_are_associative():
    rng = np.random.default_rng(5)
    a, b, c = (np.where(rng.random(s) < 0.5, -np.inf, rng.integers(-9, 9, s)) for s in ((3, 4), (4, 2), (2, 5)))
    assert (pieces.product(pieces.product(a, b), c) == pieces.product(a, pieces.product(b, c))).all()


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    given = table(spark, SF, "documents")
    toxic = {r.doc_id for r in table(spark, SF, "labels").where("toxic = 1").collect()}
    kept = given
    for name, stage in cp.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, SF)
        assert kept.columns == given.columns
        if name == "toxicity":
            left = {r.doc_id for r in kept.select("doc_id").collect()}
            assert len(toxic & left) <= 0.2 * len(toxic) and len(left) >= 0.8 * (before.count() - len(toxic))
    assert cp.STAGES[-1][1](spark, kept, SF).count() == kept.count() > 0
    assert cp.toxicity_stage(spark, given.where("false"), SF).count() == 0


@pytest.mark.parametrize("n", [10, 60, 160, 170, 1000, 5000])
def test_boilerplate_goes_whatever_its_length(n):
    body, more = " ".join(["word"] * 60), " ".join(["extra"] * n)
    for article in (f"<article><p>{body}</p></article>", f"<div><p>{body}</p></div>", f"<div class=post-content><p>{body}</p></div>"):
        for name in ("comments", "commentlist", "commentList", "relatedPosts", "site-footer", "cookie-notice", "sidebar", "adContainer", "noticeBox", "newsletterSignup"):
            aside = f"<div class={name}><h3>Title</h3><p>{more}</p><p>{more}</p></div>"
            assert texts_of(article + aside, aside + article) == [body, body], (article, name)
        for tag in ("footer", "aside", "nav", "form", "header"):
            aside = f"<{tag}><p>{more}</p></{tag}>"
            assert texts_of(article + aside, aside + article) == [body, body], (article, tag)


def test_neighbours_with_links_tell_menus_from_paragraphs():
    menu, line = "<ul><li><a href=a>one two three</a></li><li><a href=b>four five six</a></li></ul>", "<p>" + "line " * 12 + "</p>"
    text = "<p>" + "word " * 40 + "</p>"
    kept = lambda *parts: texts_of("".join(parts))[0].count("line")
    assert kept(text, line, text) == 12 and kept(menu, line, menu) == 0
    long = "<p>" + "word " * 90 + "</p>"
    assert texts_of(long * 3)[0].count("word") == 270
    asked = {extract.FEATURES[f] for f in extract.block_tree().feature if f >= 0}
    assert asked >= {"words", "links"} and asked & {"words_before", "words_after"} and asked & {"links_before", "links_after"}


def test_attributes_are_read_as_html_reads_them():
    for start in ("<p title=it's>", '<p class=a"b>', "<p title='a>b'>", '<p title="class=ad hidden">', "<p data-x = 'it\"s' class=x>", "<p title=\"it's\" alt='\"'>", "<p a=b=c hidden-by=x>", "<p =x>"):
        assert texts_of(f"<article>{start}First paragraph we don't know.</p><p>Second.</p></article>") == ["First paragraph we don't know.\nSecond."], start
    assert texts_of("<article><p title='>First we don't know.</p><p>Second.</p></article>") == ["Second."]  # a value up to its quote, as browsers read it
    for start in ("<p hidden>", "<p HIDDEN=''>", "<p aria-hidden = 'true'>", "<p style='color:red; display : none'>"):
        assert texts_of(f"<article>{start}First</p><p>Second.</p></article>") == ["Second."], start


@pytest.mark.parametrize("top", [20, 25, 29])
def test_exact_scores_beyond_double_precision(spark, top):
    rng = np.random.default_rng(top)
    base = rng.integers(-(1 << top), 1 << top, 7)
    rows = [(i, [int(x) for x in base + rng.integers(-2, 3, 7)]) for i in range(260)] + [(1000 + i, [int(x) for x in rng.integers(-(1 << top), 1 << top, 7)]) for i in range(80)]
    rows += [(7, rows[3][1]), (7, rows[3][1]), (100, rows[5][1])]  # repeated ids, with another and with an equal vector
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id bigint, embedding array<double>")
    got = topk.top_k(df, df.where("vec_id % 100 = 0"), 10, scale=1).collect()
    distinct = sorted({(i, tuple(v)) for i, v in rows})
    want = []
    for q in sorted({i for i, _ in rows if i % 100 == 0}):
        own = min(v for i, v in distinct if i == q)
        found = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, v in distinct if i != q)[:10]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == want
    assert max(abs(w[3]) for w in want) > 2**40


def test_scores_beyond_64_bits_raise_and_empty_tables_pass(spark):
    huge = spark.createDataFrame([(i, [2.0**40 + i, 1.0]) for i in range(3)], "vec_id bigint, embedding array<double>")
    with pytest.raises(ValueError, match="smaller scale"):
        topk.top_k(huge, huge, 2)
    assert topk.top_k(huge.where("false"), huge.where("false"), 2).count() == topk.top_k(huge, huge.where("false"), 2).count() == 0


def test_ngrams_are_of_characters(monkeypatch):
    def grams(text):
        return np.sort(np.concatenate(list(toxicity.ngram_buckets(np.frombuffer(text.encode(), dtype=np.uint8)))))

    for text in ("ab", "ÄÖÜ", "日本語です", "😀x😀", "a" * 20):
        n = len(text) + 2
        assert len(grams(text)) == sum(max(0, n - k + 1) for k in toxicity.ORDERS)
    assert (grams("ÄÖ Ü\nx") == grams("äö　ü x")).all() and not np.array_equal(grams("äö"), grams("äü"))
    long = "The Quick brown fox 日本 " * 30
    whole = grams(long)
    monkeypatch.setattr(toxicity, "WINDOW", 7)
    assert (grams(long) == whole).all()


def test_toxicity_against_plain_naive_bayes_ratios(spark):
    """Kept n-grams and their signs against a dictionary of n-grams over few texts."""
    bad, good = "you vile rotten fool", "a calm walk by the river"
    rows = [(i, f"{bad if i % 2 else good} {'xyz'[i % 3]}", None, None, None, None) for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)], "doc_id bigint, quality int, toxic int")
    model = toxicity.fit_toxicity(docs(spark, rows), labels, modulus=5, held=7)
    counts = {}
    for i, t, *_ in rows:
        s = f" {t} "
        for g in {s[a : a + n] for n in toxicity.ORDERS for a in range(len(s) - n + 1)}:
            counts.setdefault(g, [0, 0])[i % 2] += 1
    for g, (n0, n1) in counts.items():
        # the n-gram alone, without spaces around it: its own bucket is the only one that all orders below its length do not give
        code = np.frombuffer(g.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
        h = code[:1]  # an array, whose products wrap around
        for c in code[1:]:
            h = h * toxicity._BASE + c
        w = model.weight[int((h * toxicity._SPREAD)[0] >> np.uint64(64 - toxicity.BITS))]
        assert w != 0 if abs(n0 - n1) == 20 else abs(w) < 0.5
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(docs(spark, rows), model).collect()}
    assert all((got[i] >= 0.5) == bool(i % 2) for i in range(40))


def test_nothing_learnt_gives_the_share_of_label_one(spark):
    import corpus_pipeline as cp

    given = docs(spark, [(i, f"{i}{i}{i}{i}", None, None, None, None) for i in range(8)])
    for ones, share in ((0, 0.0), (2, 0.25), (8, 1.0)):
        labels = spark.createDataFrame([(i, int(i < ones), int(i < ones)) for i in range(8)], "doc_id bigint, quality int, toxic int")
        model = toxicity.fit_toxicity(given, labels, modulus=5, held=7)
        assert not model.learnt
        assert [r.score for r in toxicity.score_toxicity(given, model).collect()] == pytest.approx([share] * 8)
        assert cp.language_stage(spark, given, SF).count() == 8


def test_sample_bound_holds_for_repeated_ids(spark):
    from panelloom.llm.common import labelled_texts

    rows = [(1, f"text {i:03}", None, None, None, None) for i in range(500)] + [(2, None, None, None, None, None), (3, "c", None, None, None, None)]
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 0), (9, 0)], "doc_id bigint, toxic int")
    sample, sizes = labelled_texts(docs(spark, rows), labels, "toxic", 5, 7, 3, 1)
    assert sorted((r.y, r.text) for r in sample.collect()) == [(0, ""), (0, "c"), (1, "text 000")] and sizes == {0: 3, 1: 1}
    named = spark.createDataFrame([(i % 2, f"text {i:03} of many words", "en") for i in range(500)], "doc_id bigint, text string, lang string")
    assert len(language.fit_languages(named, 4, 9, 3).contents["en"].split(b"\n")) == 2


def test_working_columns_of_the_user_stay(spark):
    model = language.LanguageDictionaries({"en": b"the cat sat on the mat and the dog ran over the old green hill ", "de": b"der hund lief durch den alten wald und die katze lag auf dem dach "})
    given = spark.createDataFrame([(1, "the cat sat on the mat", "mine", "too")], "doc_id bigint, text string, `__TEXT` string, `__found` string")
    (row,) = language.predict_language(given, model).collect()
    assert (row["__TEXT"], row["__found"], row.lang_pred) == ("mine", "too", "en")


def test_dictionaries_share_their_bytes(spark, monkeypatch):
    monkeypatch.setattr(language, "DICTIONARY_BYTES", 200)
    given = spark.createDataFrame([(i, "é" * 300, "fr") for i in range(20)], "doc_id bigint, text string, lang string")
    content = language.fit_languages(given, 4, 9).contents["fr"]
    assert content == b"\n".join(["é".encode() * 4] * 20)
