"""Main text of web pages: blocks are labelled content or boilerplate by a minimum cut.

A block's terminal capacities are the log odds of its place (elements around it, their names and classes) and of its shape
(length, links, punctuation).  What a shape says is learned from the pages: blocks whose place speaks clearly are examples for
the shape alone, around stated weights that hold where a table has few pages.  Smoothness is what best restores blocks whose
place is hidden, on pages that the weights were not learned from.
"""

from __future__ import annotations

import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from graphwarden.llm.streams import rows_like

# fixed values: element names of HTML, and words that sites use in class and id names
INLINE = set("""a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span
strike strong sub sup td th time tt u var wbr br img math mi mn mo ms mtext mspace mrow mfrac msqrt mroot msub msup msubsup munder
mover munderover mtable mtr mtd mstyle mpadded mphantom semantics annotation""".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe xmp noembed noframes object svg canvas video audio select".split())
#: of those, the ones whose missing end tag costs their start tag alone and not the rest of the page
MENDED = set("object svg canvas video audio select".split())
AGAINST_TAGS = set("nav footer aside menu dialog button form fieldset".split())
FOR_TAGS = {"article", "main"}
AGAINST_ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
AGAINST_WORDS = set("""ad ads advert advertisement adverts advertising adsense sponsor sponsored promo promotion banner cookie
cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login register sidebar
aside menu nav navbar navigation breadcrumb breadcrumbs footer header masthead comment comments reply replies respond
discussion disqus related recommended share sharing social widget widgets toolbar search pagination pager tags form toc
copyright legal disclaimer""".split())
#: of those, the words that also name parts of an article: inside one, a long text outweighs them
WEAK_WORDS = set("""related recommended notice notices alert legal disclaimer copyright promotion discussion sponsor header masthead
banner tags form""".split())
FOR_WORDS = set("article content entry main post story text body prose".split())
HEAD_WORDS = {"header", "masthead"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}

#: log odds of content by place: within an element that speaks against it, for it, or weakly against it
AGAINST, FOR, WEAK = -7.0, 4.0, -5.5
#: log odds of content by shape, as long as no page says otherwise: any block, its length, links, rights, heading, end of a sentence,
#: list item
STATED = (-1.5, 1.0, -3.0, -2.5, 1.0, 0.5, 0.0)
#: what a shape may say at most, less than what a place says
SHAPE_LIMIT = 3.0
#: pages and characters of each that a model is fitted on, and the number of blocks that the stated weights count as
FIT_PAGES, FIT_CHARACTERS, FIT_WEIGHT = 400, 50_000, 200.0
#: smoothness where no page says otherwise, and the values tried
SMOOTH, SMOOTH_TRIED = 0.8, (0.0, 0.2, 0.4, 0.8, 1.2, 1.6, 2.4)
#: steps in the tree between neighbours on a page that still have an edge; each one halves it
STEPS = 4

_TAG = re.compile(
    r"""<!--(?:.*?-->|.*\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_RIGHTS = re.compile("©|all rights reserved", re.I)


class Element:
    """An open element.  What holds for it and all elements around it is known when it is made, so nothing walks up later."""

    __slots__ = ("tag", "parent", "depth", "against", "favour", "soft", "out_of_sight", "in_article", "settled", "freed")

    def __init__(self, tag: str, parent, attributes: str):
        self.tag, self.parent, self.depth = tag, parent, parent.depth + 1 if parent is not None else 0
        hidden = tag == "head"
        inside = parent is not None and parent.in_article
        against = 2 * (tag in AGAINST_TAGS)  # 1: weakly
        favour = tag in FOR_TAGS
        self.in_article = inside or favour
        self.soft = tag in ("form", "fieldset", "header")  # void where the element turns out to hold the main text
        if tag == "header":
            against = 0 if inside else 2
        if attributes and tag not in ("html", "body"):
            for name, *values in _ATTRIBUTE.findall(attributes):
                name, value = name.lower(), "".join(values)
                if name == "hidden" or name == "aria-hidden" and value == "true":
                    hidden = True
                elif name == "style":
                    hidden |= "display:none" in value.replace(" ", "").lower()
                elif name == "role":
                    against = max(against, 2 * (value.lower() in AGAINST_ROLES))
                    favour |= value.lower() in ("main", "article")
                else:
                    named = [{w.lower() for w in _WORD.findall(x)} for x in value.split()]
                    words = set().union(*named)
                    if inside:  # an article's own head is not the site's
                        words -= HEAD_WORDS
                    if words & AGAINST_WORDS and not any(x and x <= FOR_WORDS for x in named):
                        self.soft |= not against
                        against = max(against, 2 if words & AGAINST_WORDS - WEAK_WORDS else 1)
                    elif words & FOR_WORDS:
                        favour = True
        self.against, self.favour = against, favour
        self.out_of_sight = hidden or parent is not None and parent.out_of_sight
        self.settled = None  # (against, favour) of the whole path, once no tag can change it
        self.freed = 0  # 1: nothing soft but headers and forms around it counts against it, 2: nothing soft at all

    def free(self, all_of_it: bool) -> None:
        """The soft elements around this one hold the main text after all; what was freed before is not visited again."""
        e, level = self.parent, 2 if all_of_it else 1
        while e is not None and e.freed < level:
            if e.soft and (all_of_it or e.tag not in ("header", "form", "fieldset")):
                e.against = 0
            e.freed = level
            e = e.parent

    def path(self) -> tuple[int, bool]:
        """How much this or an element around it speaks against content (0 to 2), and whether one inside that speaks for it.

        Asked when the page is read.
        """
        chain, e = [], self
        while e is not None and e.settled is None:
            chain.append(e)
            e = e.parent
        against, favour = e.settled if e is not None else (0, False)
        for e in reversed(chain):
            favour = (favour and e.against < 2) or (e.favour and not e.against)
            against = max(against, e.against)
            e.settled = against, favour
        return against, favour

    def steps_to(self, other: Element) -> int:
        """Steps in the tree from this element to another, ``STEPS`` + 1 where there are more than ``STEPS``."""
        a, b, n = self, other, 0
        while a is not b and n <= STEPS:
            if a.depth < b.depth:
                a, b = b, a
            a = a.parent
            n += 1
        return n


class Block:
    __slots__ = ("text", "linked", "element")

    def __init__(self, text: str, linked: int, element: Element):
        self.text, self.linked, self.element = text, linked, element


def blocks(html: str) -> list[Block]:
    """Text blocks of a page in order: white space is one space, references are decoded, raw and hidden parts are gone."""
    top = here = Element("#top", None, "")
    out: list[Block] = []
    parts: list[tuple[str, bool]] = []
    links, at, raw = 0, 0, None
    open_tags: Counter[str] = Counter()
    unclosed: set[str] = set()

    def leave():
        nonlocal here
        open_tags[here.tag] -= 1
        here = here.parent

    def flush():
        if parts:
            text = " ".join("".join(t for t, _ in parts).split())
            if text and not here.out_of_sight:
                out.append(Block(text, sum(len(t.strip()) for t, linked in parts if linked), here))
            parts.clear()

    for m in _TAG.finditer(html):
        if m.start() < at:
            continue
        if raw is None and m.start() > at:
            parts.append((unescape(html[at:m.start()]), links > 0))
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing = bool(m[1] or m[4])
        if raw is not None:
            if closing and tag == raw:
                raw = None
            continue
        if not closing and tag in RAW:
            if not (m[3] or m[6] or "").endswith("/"):
                end = None if tag in unclosed else re.compile(f"</{tag}", re.I).search(html, at)
                if end is not None:
                    raw, at = tag, end.start()
                elif tag in MENDED:
                    unclosed.add(tag)
                else:
                    at = len(html)
                    break
            continue
        if tag == "a":
            links = max(0, links + (-1 if closing else 1))
            continue
        if tag in INLINE:
            if tag in ("br", "td", "th", "img"):
                parts.append((" ", False))
            continue
        flush()
        links = 0
        if closing:
            if open_tags[tag] > 0:
                while here.tag != tag:
                    leave()
                leave()
        elif tag not in VOID:
            if tag == "body":
                while here.tag == "head":
                    leave()
            while here.tag == "p" or here.tag == tag == "li" or {here.tag, tag} <= {"dt", "dd"} or here.tag == tag == "tr":
                leave()
            here = Element(tag, here, m[3] or m[6] or "")
            open_tags[tag] += 1
            if tag in FOR_TAGS or tag == "h1" or here.favour and "main" in (m[3] or m[6] or ""):
                here.free(tag != "h1")
    if raw is None and at < len(html):
        parts.append((unescape(html[at:]), links > 0))
    flush()
    return out


@dataclass(frozen=True)
class Model:
    """Weights of a block's shape, and the smoothness of the cut."""

    weights: tuple[float, ...] = STATED
    smooth: float = SMOOTH


def place_odds(block: Block) -> float:
    """Log odds that a block is content, by the elements around it."""
    against, favour = block.element.path()
    if against == 1 and favour:
        return WEAK + FOR
    return AGAINST * (against > 0) + FOR * favour


def shape(block: Block) -> list[float]:
    """Features of a block's text, in the order of ``STATED``."""
    n, tag = len(block.text), block.element.tag
    return [1.0, min(math.log1p(n) / 2, 3.5), float(block.linked > 0.5 * n), float(bool(_RIGHTS.search(block.text))),
            float(tag in HEADINGS), float(block.text[-1] in ".!?…\"'”"), float(tag in ("li", "dt", "dd"))]


def shape_odds(shapes: np.ndarray, weights: tuple[float, ...]) -> np.ndarray:
    """Log odds that blocks are content, by their shapes."""
    return np.clip(shapes @ np.array(weights), -SHAPE_LIMIT, SHAPE_LIMIT)


def fitted_weights(shapes: np.ndarray, content: np.ndarray) -> tuple[float, ...]:
    """Logistic regression around the stated weights; both labels count alike, and all blocks as ``FIT_WEIGHT`` at most."""
    stated = w = np.array(STATED)
    if not len(content) or content.all() or not content.any():
        return STATED
    each = min(FIT_WEIGHT, len(content)) / 2 / np.where(content, content.sum(), (~content).sum())

    def loss(w):
        z = shapes @ w
        return (each * np.logaddexp(0.0, np.where(content, -z, z))).sum() + ((w - stated) ** 2).sum() / 2

    for _ in range(50):  # Newton's steps, halved while they lead up
        p = 1 / (1 + np.exp(-np.clip(shapes @ w, -40, 40)))
        slope = shapes.T @ (each * (p - content)) + (w - stated)
        step = np.linalg.solve((shapes * (each * p * (1 - p))[:, None]).T @ shapes + np.eye(len(w)), slope)
        while loss(w - step) > loss(w) and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(x) for x in w)


def _hidden(k: int) -> bool:
    """Whether the place of the k-th block is hidden when smoothness is chosen."""
    return k * 2654435761 % 2**32 < 2**31


def fitted_model(pages: list[str]) -> Model:
    """Weights learned from every other page, smoothness chosen on the rest: the least that restores most hidden places."""
    learn: tuple[list, list] = [], []
    held = []
    for k, html in enumerate(pages):
        found = blocks(html)
        if not found:
            continue
        shapes, places = np.array([shape(b) for b in found]), np.array([place_odds(b) for b in found])
        if k % 2:
            held.append((found, shapes, places))
        else:
            clear = np.abs(places) >= FOR
            learn[0].append(shapes[clear])
            learn[1].append(places[clear] > 0)
    weights = fitted_weights(np.concatenate(learn[0]), np.concatenate(learn[1])) if learn[0] else STATED
    wrong = dict.fromkeys(SMOOTH_TRIED, 0)
    asked = 0
    for found, shapes, places in held:
        hidden = np.array([_hidden(k) for k in range(len(found))]) & (np.abs(places) >= FOR)
        asked += int(hidden.sum())
        odds = shape_odds(shapes, weights) + np.where(hidden, 0.0, places)
        for smooth in SMOOTH_TRIED if hidden.any() else ():
            wrong[smooth] += int((labels(found, odds, smooth) != (places > 0))[hidden].sum())
    return Model(weights, min(SMOOTH_TRIED, key=wrong.get) if asked else SMOOTH)


def minimum_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Whether each node stays on the source's side of a minimum cut (maximum flow by levels and blocking paths).

    ``source[i]`` is the cost of parting node i from the source, ``sink[i]`` from the sink, an edge's weight that of
    parting its ends.
    """
    n = len(source)
    s, t = n, n + 1
    to: list[int] = []
    room: list[float] = []
    near: list[list[int]] = [[] for _ in range(n + 2)]

    def link(a, b, forth, back):
        near[a].append(len(to))
        to.append(b)
        room.append(forth)
        near[b].append(len(to))
        to.append(a)
        room.append(back)

    for i in range(n):
        through = min(source[i], sink[i])  # flows straight through the node
        if source[i] > through:
            link(s, i, source[i] - through, 0.0)
        if sink[i] > through:
            link(i, t, sink[i] - through, 0.0)
    for a, b, w in edges:
        link(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for e in near[a]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [x >= 0 for x in level[:n]]
        next_edge = [0] * (n + 2)
        path: list[int] = []
        a = s
        while True:
            if a == t:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                k = next(k for k, e in enumerate(path) if room[e] <= 1e-9)
                a = to[path[k] ^ 1]
                del path[k:]
                continue
            while next_edge[a] < len(near[a]):
                e = near[a][next_edge[a]]
                if room[e] > 1e-9 and level[to[e]] == level[a] + 1:
                    path.append(e)
                    a = to[e]
                    break
                next_edge[a] += 1
            else:
                if a == s:
                    break
                a = to[path.pop() ^ 1]
                next_edge[a] += 1


def labels(found: list[Block], odds: np.ndarray, smooth: float) -> np.ndarray:
    """Whether each block is content: the minimum cut for the log odds and the smoothness.

    Neighbours on the page have an edge that halves with each step between them in the tree, neighbours under one parent a
    whole one.
    """
    source, sink, edges, last = [], [], [], {}
    for i, block in enumerate(found):
        soft = math.log1p(math.exp(-abs(odds[i])))  # the cost of either label under the classifier's probability
        source.append(max(odds[i], 0.0) + soft)
        sink.append(max(-odds[i], 0.0) + soft)
        if i and smooth:
            steps = block.element.steps_to(found[i - 1].element)
            if steps <= STEPS:
                edges.append((i - 1, i, smooth / 2 ** steps))
        parent = id(block.element.parent or block.element)
        if parent in last and smooth:
            edges.append((last[parent], i, smooth))
        last[parent] = i
    return np.array(minimum_cut(source, sink, edges), bool)


def main_text(html: str, model: Model = Model()) -> str:
    """Content blocks of a page joined by empty lines."""
    found = blocks(html)
    if not found:
        return ""
    odds = shape_odds(np.array([shape(b) for b in found]), model.weights) + np.array([place_odds(b) for b in found])
    return "\n\n".join(b.text for b, keep in zip(found, labels(found, odds, model.smooth)) if keep)


def fit(pages: DataFrame, n: int = FIT_PAGES, characters: int = FIT_CHARACTERS) -> Model:
    """The model of a table's pages, from the ``n`` different ones of at most ``characters`` characters with the smallest hash.

    Hashes alone are ranked, so that tasks send the driver no pages but the ``n`` taken.
    """
    html = F.col("html").cast("string")
    fitting = rows_like(pages, ["html"]).select(html.alias("html")).where(F.length("html").between(1, characters)).withColumn(
        "hash", F.xxhash64("html"))
    taken = [r["hash"] for r in fitting.select("hash").distinct().orderBy("hash").limit(n).collect()]
    sample = fitting.where(F.col("hash").isin(taken)).groupBy("hash").agg(F.min("html").alias("html")).collect()
    return fitted_model([r["html"] for r in sorted(sample)])


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text, n_chars of each row of ``pages``, labelled by ``model`` or one fitted on a bounded sample of them.

    A null or empty html gives an empty text; so does a page without content blocks.  Rows with equal or null ids are
    handled one by one, nulls in url are kept.  Broken markup (unclosed elements, comments or quotes) never fails.
    """
    model = model or fit(pages)

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(h, model) if isinstance(h, str) else "" for h in batch], dtype=object)

    return rows_like(pages, ["page_id", "url", "html"]).select(
        F.col("page_id"), F.col("url"), text(F.col("html").cast("string")).alias("text")
    ).withColumn("n_chars", F.length("text").cast("long"))
