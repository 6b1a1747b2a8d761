"""Main text of web pages: flat text blocks, judged by a decision tree over their own and their neighbours' words and links."""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches

# Names that the HTML standard gives, and words that sites use in class, id and role.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ASIDE_TAGS = frozenset("nav header footer aside form button select menu dialog fieldset".split())
MAIN_TAGS = frozenset("article main".split())
#: Their text is no text of the page, but they may stand inside a sentence.
EMBEDDED = frozenset("svg math object iframe template".split())
#: HTML that ends an open svg or math, unless inside one of HOLDS_HTML.
BREAKOUT = ASIDE_TAGS | MAIN_TAGS | frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing meta nobr ol p pre ruby s section small span strong strike sub sup table tt u ul var".split()
)
HOLDS_HTML = frozenset("foreignobject desc annotation-xml mi mo mn ms mtext object iframe template".split())
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter "
    "subscribe subscription signup sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead topbar header comment comments respond reply replies disqus "
    "share sharing social related recommended widget widgets pagination pager toolbar copyright legal disclaimer login search contentinfo complementary".split()
)
MAIN_WORDS = frozenset("article content post entry main story".split())
#: Parts of a class name that make it tell the state of a container rather than what it is, before or after an aside word.
STATE_BEFORE, STATE_AFTER = frozenset("with without no has have".split()), frozenset("open opened closed enabled disabled none on off".split())
#: Second halves of class names written as one word: commentlist, postcontent.
SECOND_HALVES = frozenset("list box area form section bar block wrap wrapper container panel body content text item items links posts inner".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|title|noscript|textarea)(?=[\s/>])(?!\s*/>)[^>]*>.*?(?:</(?P=raw)(?=[\s/>])[^>]*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-z][^\s/>]*)(?P<attrs>(?:[^=>]++|=\s*\"[^\"]*\"|=\s*'[^']*'|=\s*[^\s\"'>][^\s>]*+|=)*+)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.I | re.S,
)
#: A quote opens a value only right behind the equals sign; elsewhere it is part of a name or value.
ATTRIBUTE = re.compile(r"([^\s=/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
#: Words of a class name: parts begin at capitals behind small letters and end at other signs than letters and digits.
NAME_PARTS = re.compile(r"[A-Z]*[a-z0-9]+|[A-Z]+")

FEATURES = ("place", "heading", "words", "links", "words_before", "links_before", "words_after", "links_after")
#: The labelled table the tree learns from: FEATURES and whether a reader would count the block to the article. ``place`` is that of
#: the innermost marked container: -2 boilerplate by its tag or hidden, -1 boilerplate by its words alone, 0 none, 1 article. ``links`` are shares of a block's words inside links.
LABELLED = (
    (-1, 0, 6, 1.0, 0, 0.0, 5, 1.0, 0), (-1, 0, 1, 1.0, 1, 1.0, 1, 1.0, 0), (-1, 0, 8, 0.0, 1, 1.0, 12, 0.0, 0), (-1, 0, 25, 0.0, 90, 0.0, 0, 0.0, 0),
    (-1, 0, 60, 0.1, 40, 0.0, 30, 0.0, 0), (-1, 1, 4, 0.0, 30, 0.0, 20, 0.0, 0), (-1, 0, 120, 0.0, 80, 0.0, 80, 0.0, 0), (-1, 0, 15, 0.5, 15, 0.5, 0, 0.0, 0),
    (-1, 0, 2, 0.0, 1, 0.0, 2, 0.0, 0), (-1, 0, 30, 0.9, 10, 1.0, 10, 1.0, 0), (-1, 1, 12, 0.0, 3, 1.0, 70, 0.0, 0), (-1, 0, 45, 0.3, 6, 1.0, 50, 0.0, 0),
    (-1, 0, 200, 0.0, 80, 0.0, 80, 0.0, 0), (-1, 0, 300, 0.1, 120, 0.0, 20, 0.0, 0), (-1, 0, 5000, 0.0, 5, 1.0, 6, 1.0, 0), (-1, 0, 200, 0.9, 5, 1.0, 30, 0.0, 0), (-1, 0, 300, 0.8, 0, 0.0, 0, 0.0, 0),
    (-2, 0, 200, 0.0, 80, 0.0, 80, 0.0, 0), (-2, 0, 300, 0.1, 120, 0.0, 20, 0.0, 0), (-2, 0, 240, 0.0, 5, 1.0, 6, 1.0, 0), (-2, 0, 4, 1.0, 0, 0.0, 5, 1.0, 0), (-2, 1, 4, 0.0, 30, 0.0, 20, 0.0, 0),
    (1, 1, 12, 0.0, 8, 0.0, 90, 0.0, 1), (1, 0, 1, 0.0, 70, 0.0, 20, 0.0, 1), (1, 0, 90, 0.0, 12, 0.0, 100, 0.0, 1), (1, 0, 30, 0.2, 40, 0.0, 15, 0.0, 1),
    (1, 0, 3, 0.0, 100, 0.0, 25, 0.1, 1), (1, 0, 8, 0.4, 30, 0.0, 40, 0.0, 1), (1, 1, 2, 0.0, 50, 0.0, 60, 0.0, 1), (1, 0, 250, 0.05, 10, 0.0, 0, 0.0, 1),
    (1, 0, 20, 0.5, 60, 0.0, 12, 0.0, 1), (1, 0, 5, 0.0, 0, 0.0, 0, 0.0, 1), (1, 0, 40, 0.0, 6, 1.0, 8, 1.0, 1), (1, 1, 6, 1.0, 0, 0.0, 80, 0.0, 1),
    (1, 0, 62, 0.0, 41, 0.0, 0, 0.0, 1), (1, 0, 1, 0.0, 38, 0.0, 0, 0.0, 1), (1, 0, 10, 0.0, 80, 0.0, 0, 0.0, 1), (1, 0, 2, 0.0, 17, 0.0, 5, 0.0, 1), (1, 0, 33, 0.0, 52, 0.0, 3, 0.0, 1), (1, 0, 7, 0.3, 60, 0.0, 4, 1.0, 1),
    (1, 1, 3, 0.0, 20, 0.0, 2, 1.0, 1), (1, 1, 5, 0.0, 6, 1.0, 1, 0.0, 1), (1, 0, 14, 0.0, 6, 1.0, 5, 1.0, 1), (1, 0, 2, 0.0, 1, 1.0, 2, 1.0, 1), (1, 0, 9, 0.5, 4, 1.0, 3, 0.0, 1), (1, 0, 24, 0.0, 18, 0.0, 4, 0.0, 1),
    (1, 0, 4, 1.0, 4, 1.0, 4, 1.0, 0), (1, 0, 6, 1.0, 50, 0.0, 5, 1.0, 0), (1, 0, 3, 1.0, 5, 1.0, 20, 0.0, 0), (1, 0, 9, 1.0, 8, 1.0, 0, 0.0, 0),
    (0, 0, 80, 0.0, 60, 0.0, 70, 0.0, 1), (0, 0, 40, 0.1, 3, 1.0, 50, 0.0, 1), (0, 0, 25, 0.0, 60, 0.0, 8, 1.0, 1), (0, 0, 18, 0.0, 40, 0.0, 45, 0.0, 1),
    (0, 0, 9, 0.0, 50, 0.0, 60, 0.0, 1), (0, 1, 8, 0.0, 3, 1.0, 60, 0.0, 1), (0, 1, 4, 0.0, 40, 0.0, 50, 0.0, 1), (0, 0, 30, 0.3, 35, 0.0, 30, 0.1, 1),
    (0, 0, 120, 0.2, 4, 1.0, 4, 1.0, 1), (0, 0, 22, 0.0, 0, 0.0, 30, 0.0, 1), (0, 0, 3, 1.0, 2, 1.0, 3, 1.0, 0), (0, 0, 2, 0.0, 1, 1.0, 2, 1.0, 0),
    (0, 0, 6, 0.0, 4, 1.0, 3, 1.0, 0), (0, 0, 12, 0.9, 10, 0.9, 11, 1.0, 0), (0, 0, 25, 0.8, 30, 0.9, 40, 0.0, 0), (0, 1, 3, 0.0, 20, 0.0, 2, 1.0, 0),
    (0, 0, 40, 0.0, 0, 0.0, 1, 0.0, 1), (0, 0, 60, 0.0, 0, 0.0, 0, 0.0, 1), (0, 0, 45, 0.0, 2, 1.0, 3, 0.0, 1), (0, 0, 30, 0.0, 5, 1.0, 0, 0.0, 1), (0, 0, 90, 0.0, 1, 0.0, 2, 1.0, 1),
    (0, 0, 14, 0.0, 6, 1.0, 5, 1.0, 0), (0, 0, 11, 0.0, 4, 1.0, 9, 0.9, 0), (0, 0, 13, 0.1, 8, 0.9, 7, 1.0, 0), (0, 0, 16, 0.0, 12, 1.0, 4, 1.0, 0),
    (0, 0, 14, 0.0, 30, 0.0, 28, 0.0, 1), (0, 0, 11, 0.0, 44, 0.0, 35, 0.1, 1), (0, 0, 13, 0.1, 26, 0.0, 50, 0.0, 1), (0, 0, 16, 0.0, 31, 0.1, 22, 0.0, 1),
    (0, 0, 40, 0.0, 90, 0.0, 60, 0.0, 1), (0, 0, 25, 0.0, 120, 0.0, 0, 0.0, 1), (0, 0, 12, 0.0, 100, 0.0, 70, 0.0, 1), (0, 0, 64, 0.0, 140, 0.0, 8, 1.0, 1), (0, 0, 9, 0.0, 95, 0.1, 30, 0.0, 1),
    (0, 0, 10, 0.0, 80, 0.0, 0, 0.0, 0), (0, 0, 7, 0.3, 6, 1.0, 5, 0.6, 0), (0, 0, 5, 0.0, 2, 1.0, 3, 0.0, 0), (0, 0, 4, 1.0, 90, 0.0, 80, 0.0, 0),
)


@dataclass
class Block:
    text: str
    place: int
    heading: bool
    links: float  # share of its words inside links


def is_word(part: str, words: frozenset[str]) -> bool:
    """Is a part of a class name one of ``words``, alone or with one of SECOND_HALVES behind it?"""
    return part in words or any(part.endswith(h) and part[: -len(h)] in words for h in SECOND_HALVES)


def marked(name: str, attrs: str, outer: int) -> int:
    """Place inside a container with this tag and these attributes, in a container of place ``outer``.

    A class, id or role is an aside name if a part of it is an aside word and none tells a state (no-sidebar, comments-open), a
    main name if a part is a main word and it is no aside name. article and main keep 1 whatever they are called, except for an
    aside name alone inside boilerplate (the comments of a comment list); elsewhere a main name beats an aside name, and undoes
    one further out. What is hidden, or inside a tag of boilerplate, is not undone by names.
    """
    if name in ("option", "optgroup"):
        return -2
    aside = main = False
    if attrs and name not in ("html", "body"):
        for key, *values in ATTRIBUTE.findall(attrs):
            key, value = key.lower(), "".join(values)
            if key == "hidden" or key == "aria-hidden" and value.strip().lower() == "true" or key == "style" and "display:none" in re.sub(r"\s", "", value.lower()):
                return -2
            if key not in ("class", "id", "role"):
                continue
            for whole in value.split():
                parts = [p.lower() for p in NAME_PARTS.findall(whole)]
                at = next((i for i, p in enumerate(parts) if is_word(p, ASIDE_WORDS)), -1)
                if at < 0:
                    main = main or any(is_word(p, MAIN_WORDS) for p in parts)
                elif STATE_BEFORE.isdisjoint(parts[:at]) and STATE_AFTER.isdisjoint(parts[at + 1 :]):
                    aside = True
    if name in MAIN_TAGS:
        return -1 if aside and not main and outer < 0 else 1
    if name in ASIDE_TAGS - {"form"} and not (name == "header" and outer == 1):
        return -2
    if main and outer > -2:
        return 1
    return min(outer, -1) if aside or name == "form" else outer  # some sites put the whole page into a form


def blocks(page: str | None) -> list[Block]:
    """Text between block-level tags, white space collapsed, character references decoded; empty ones are left out.

    Comments, scripts, styles and titles are no text, nor is what stands in EMBEDDED elements up to their end or their parent's;
    one that closes itself or has no end tag behind it on the page holds nothing. An end tag closes up to the last open tag of its name and is
    ignored without one. A container marked by its tag, or by its class, id or role, places all blocks inside it until a
    container inside is marked otherwise (``marked``).
    """
    out: list[Block] = []
    open_tags: list[tuple[str, int]] = []  # name, place from here on
    parts: list[str] = []
    linked: list[str] = []
    heading = inside_link = embedded = 0  # embedded: open tags of EMBEDDED
    ends: dict[str, int] = {}  # where the last end tag of a name begins

    def flush() -> None:
        nonlocal parts, linked
        text = " ".join(entities.unescape("".join(parts)).split())
        if text:
            n = len(entities.unescape(" ".join(linked)).split()) if linked else 0
            out.append(Block(text, open_tags[-1][1] if open_tags else 0, bool(heading), min(1.0, n / (text.count(" ") + 1))))
        parts, linked = [], []

    def add(text: str) -> None:
        if text and not embedded:
            parts.append(text)
            if inside_link:
                linked.append(text)

    def cut(i: int) -> None:
        nonlocal embedded
        embedded -= sum(t in EMBEDDED for t, _ in open_tags[i:])
        del open_tags[i:]

    def ended(name: str) -> bool:
        if name not in ends:
            ends[name] = max((m.start() for m in re.finditer(rf"</{name}(?=[\s/>])", page, re.I)), default=-1)
        return ends[name] >= at

    at, page = 0, page or ""
    for m in TOKEN.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if embedded and not m["close"] and name in BREAKOUT:
            i = next(i for i in range(len(open_tags) - 1, -1, -1) if open_tags[i][0] in EMBEDDED)
            if open_tags[i][0] in ("svg", "math") and not any(t in HOLDS_HTML for t, _ in open_tags[i:]):
                cut(i)
        if name in EMBEDDED or embedded:
            if m["close"]:
                i = next((i for i in range(len(open_tags) - 1, -1, -1) if open_tags[i][0] == name), -1)
                first = next((i for i, (t, _) in enumerate(open_tags) if t in EMBEDDED), len(open_tags))
                if i >= first:
                    cut(i)
                if i < 0 or i >= first:
                    continue
                cut(first)  # the end of a parent
            else:
                if name not in VOID and not m["attrs"].endswith("/") and (name not in EMBEDDED or ended(name)):
                    open_tags.append((name, -1))
                    embedded += name in EMBEDDED
                continue
        if name in INLINE:
            if name == "br":
                add(" ")
            elif name == "a":
                inside_link = 0 if m["close"] else 1
            continue
        flush()
        inside_link = 0
        if m["close"]:
            if name in HEADINGS:
                heading = 0
            for i in range(len(open_tags) - 1, -1, -1):
                if open_tags[i][0] == name:
                    cut(i)
                    break
            continue
        if name in HEADINGS:
            heading = 1
        elif name == "p" or name in ASIDE_TAGS or name in MAIN_TAGS:
            heading = 0
        if name in VOID:
            continue
        if open_tags and (open_tags[-1][0] == "p" or open_tags[-1][0] == name == "li"):
            open_tags.pop()  # such a start ends an open paragraph, a list item the one before
        if open_tags and open_tags[-1][0] == "option" and (name in ("option", "optgroup") or not any(t in ("select", "datalist") for t, _ in open_tags)):
            open_tags.pop()  # an option ends before the next, outside a list before any block
        if name == "optgroup" and open_tags and open_tags[-1][0] == name:
            open_tags.pop()
        outer = open_tags[-1][1] if open_tags else 0
        open_tags.append((name, marked(name, m["attrs"], outer)))
    add(page[at:])
    flush()
    return out


def features(found: list[Block]) -> np.ndarray:
    own = np.array([(b.text.count(" ") + 1, b.links) for b in found], dtype=np.float64).reshape(-1, 2)
    edge = np.zeros((1, 2))
    return np.hstack([np.array([(b.place, b.heading) for b in found], dtype=np.float64).reshape(-1, 2), own, np.vstack([edge, own[:-1]]) if len(own) else own, np.vstack([own[1:], edge]) if len(own) else own])


@dataclass
class Tree:
    """A binary tree as arrays: inner nodes send x[feature] > threshold to ``right``, others to ``left``; leaves have feature -1."""

    feature: list[int]
    threshold: list[float]
    left: list[int]
    right: list[int]
    share: list[float]

    def predict(self, x: np.ndarray) -> np.ndarray:
        f, t, left, right, share = map(np.array, (self.feature, self.threshold, self.left, self.right, self.share))
        node = np.zeros(len(x), dtype=np.int64)
        while (inner := np.flatnonzero(f[node] >= 0)).size:
            at = node[inner]
            node[inner] = np.where(x[inner, f[at]] > t[at], right[at], left[at])
        return share[node] > 0.5


def fit_tree(x: np.ndarray, y: np.ndarray, depth: int = 8) -> Tree:
    """Splits by Gini impurity at midpoints; equal gains go to the earlier feature, then the smaller threshold."""
    tree = Tree([], [], [], [], [])

    def grow(rows: np.ndarray, level: int) -> int:
        me = len(tree.feature)
        for column, value in zip((tree.feature, tree.threshold, tree.left, tree.right, tree.share), (-1, 0.0, -1, -1, float(y[rows].mean()))):
            column.append(value)
        best = None
        if level and 0 < y[rows].sum() < len(rows):
            for j in range(x.shape[1]):
                values = np.unique(x[rows, j])
                for t in (values[:-1] + values[1:]) / 2:
                    right = x[rows, j] > t
                    impurity = sum(len(s) * s.mean() * (1 - s.mean()) for s in (y[rows[right]], y[rows[~right]]))
                    if best is None or impurity < best[0] - 1e-12:
                        best = impurity, j, t, right
        if best:
            _, tree.feature[me], tree.threshold[me], right = best
            tree.left[me] = grow(rows[~right], level - 1)
            tree.right[me] = grow(rows[right], level - 1)
        return me

    grow(np.arange(len(x)), depth)
    return tree


@lru_cache
def block_tree() -> Tree:
    rows = np.array(LABELLED, dtype=np.float64)
    return fit_tree(rows[:, :-1], rows[:, -1])


def judged(found: list[list[Block]], tree: Tree) -> list[np.ndarray]:
    """Flags of the blocks that the tree keeps, page by page."""
    x = [features(b) for b in found]
    kept = tree.predict(np.vstack(x)) if x else np.empty(0, dtype=bool)
    return np.split(kept, np.cumsum([len(b) for b in found])[:-1]) if found else []


def main_texts(pages: list[str | None], tree: Tree) -> list[tuple[str, int, int]]:
    """Main text, number of blocks and number of blocks kept of each page."""
    found = [blocks(p) for p in pages]
    kept = judged(found, tree)
    # names that leave a page without any text mark the whole page, not its boilerplate: such a page is judged without them
    again = [i for i, (b, k) in enumerate(zip(found, kept)) if not k.any() and not any(x.place == 1 for x in b) and any(x.place == -1 for x in b)]
    unnamed = [[Block(x.text, 0 if x.place == -1 else x.place, x.heading, x.links) for x in found[i]] for i in again]
    for i, k in zip(again, judged(unnamed, tree)):
        kept[i] = k
    out = []
    for b, k in zip(found, kept):
        own = [x.text for x, keep in zip(b, k) if keep]
        out.append(("\n".join(own), len(b), len(own)))
    return out


def extract(pages: DataFrame, tree: Tree | None = None) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks, n_kept of every row of ``pages`` (page_id, url, html); other columns are not looked at.

    The tree judges every block by FEATURES; kept blocks are joined in page order by line feeds. What is marked as boilerplate goes
    whatever its length. Only where that leaves a page without article and without any text are class, id and role passed over: they
    then mark the page as a whole. Null and empty pages, and pages without a kept block, give an empty text.
    """
    tree = tree or block_tree()

    def run(batches):
        for whole in batches:
            for i in range(0, len(whole), 256):
                b = whole.slice(i, 256)
                rows = main_texts(b["html"].to_pylist(), tree)
                yield pa.RecordBatch.from_arrays([
                    b["page_id"], b["url"], pa.array([r[0] for r in rows], type=pa.string()), pa.array([len(r[0]) for r in rows], type=pa.int64()),
                    pa.array([r[1] for r in rows], type=pa.int32()), pa.array([r[2] for r in rows], type=pa.int32()),
                ], names=["page_id", "url", "text", "n_chars", "n_blocks", "n_kept"])

    source = small_batches(pages).selectExpr("cast(page_id as bigint) page_id", "cast(url as string) url", "cast(html as string) html")
    return source.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint, n_blocks int, n_kept int")
