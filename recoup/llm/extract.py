"""Main text of web pages by a minimum cut.

A page is cut into text blocks in page order. A logistic classifier, fitted on what the pages' own
article and navigation parts hold, turns a block's text into log odds of content; the markup of the
elements around it gives theirs. Blocks and elements are the nodes of a graph: the log odds become
the capacities of their edges to the two terminals, and edges between neighbouring blocks, blocks of
one container, a block and its element, and an element and the one around it are the smoothness. The
minimum cut separates content from boilerplate: a short line of an article is kept for its container
and neighbours, long comments go with theirs.
"""
from __future__ import annotations

import html as entities
import math
import re
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recoup.llm.arrow import batch_of, schemas
from recoup.llm.text import pieces
from recoup.session import spread

#: Elements without an end tag, elements whose start or end parts blocks, and elements never shown.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption
    figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary
    table tbody td tfoot th thead title tr ul""".split())
HIDDEN = frozenset("""applet audio button canvas datalist head iframe input noembed noframes noscript object option
    progress rp script select style svg template textarea title video""".split())
#: Elements whose content is not markup.
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
#: What an opening tag ends: the elements, and the ones beyond which it does not look.
_LIST, _TABLE = frozenset(("ul", "ol", "menu", "dir")), frozenset(("table",))
_ENDS = {"li": (frozenset(("li",)), _LIST), "dt": (frozenset(("dt", "dd")), frozenset(("dl",))), "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
         "tr": (frozenset(("tr", "td", "th")), _TABLE), "td": (frozenset(("td", "th")), frozenset(("tr", "table"))), "th": (frozenset(("td", "th")), frozenset(("tr", "table")))}

_SCOPES = frozenset().union(*[a | b for a, b in _ENDS.values()])
_P_SCOPE = frozenset(("button", "td", "th", "table"))

#: Evidence of elements, roles and words of class and id names, as log odds of content.
ELEMENTS = {"article": 6.0, "main": 3.0, "nav": -12.0, "menu": -12.0, "footer": -12.0, "aside": -12.0, "header": -12.0, "form": -12.0,
            "dialog": -12.0, "search": -12.0, "fieldset": -6.0}
ROLES = {"main": 3.0, "article": 6.0, "navigation": -12.0, "banner": -12.0, "contentinfo": -12.0, "complementary": -12.0, "search": -12.0,
         "dialog": -12.0, "alertdialog": -12.0, "alert": -12.0, "menu": -12.0, "menubar": -12.0, "toolbar": -12.0, "form": -12.0}
CONTENT_WORDS = frozenset("article content entry main post story text".split())
BOILERPLATE_WORDS = frozenset("""ad ads adslot advert advertisement advertising adverts alert alerts banner breadcrumb breadcrumbs
    comment comments commentlist consent cookie cookies copyright disclaimer disqus footer gdpr header login masthead menu menus modal
    nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted promotion recommended related replies
    reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tagcloud thread threads toolbar widget widgets""".split())
#: A word of boilerplate after one of these says what a wrapper has or lacks, not what it is.
_ABOUT = frozenset("has have no not non with without hide show".split())
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))

#: Cost of a label change between neighbours of one container, and along a container's chain.
ADJACENT, PROXIMATE = 1.0, 0.6
#: Cost of a label change between a block and its element, and between an element and the one around it.
TIE, AROUND = 6.0, 0.8
_SCALE = 1000

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_ATTRIBUTE = re.compile(r"([^\s=\"'/]++)\s*+(?:=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
_TOKEN = re.compile(r"\S+")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_SENTENCE = re.compile(r"[.!?;:,。](?:\s|$)")


def _named(value: str, article: bool) -> tuple[float, bool, bool]:
    """Evidence of a class or id for content, whether a word of it names boilerplate, and whether
    it names the head of the text."""
    content = head = against = False
    for token in _TOKEN.findall(value):
        words = [w.lower() for w in _WORD.findall(token)]
        about = next((k for k, w in enumerate(words) if w in _ABOUT), len(words))
        named = {w for w in words[:about] if w in BOILERPLATE_WORDS}
        entry = any(w in CONTENT_WORDS for w in words[:about])
        if "header" in named and (article or entry):  # the head of the text, not of the page
            named.discard("header")
            head = True
        against |= bool(named)
        content |= entry
    return (0.0 if against or head else 2.0 if content else 0.0), against, head


class _Element:
    __slots__ = ("tag", "good", "bad", "hidden", "link", "article", "number", "depth", "buffer", "parent", "up", "down", "named", "core", "chars", "linked", "cores", "shut",
                 "p", "ends")

    def __init__(self, tag: str, parent: _Element | None, number: int) -> None:
        self.tag, self.parent, self.number = tag, parent, number
        self.good = parent.good if parent else 0.0
        self.bad = parent.bad if parent else 0.0
        self.hidden = parent.hidden if parent else False
        self.link = parent.link if parent else False
        self.article = parent.article if parent else False
        self.depth = parent.depth + 1 if parent else 0
        self.buffer: _Block | None = parent.buffer if parent else None
        self.up = self.down = 0.0  # own evidence, without the words that name boilerplate
        self.named = self.core = False
        self.shut = parent.shut if parent else False
        self.chars = self.linked = self.cores = 0  # characters, those in links, and articles inside
        # the open paragraph in scope, and what an li, dt, dd, tr, td or th would end: looked up, not searched
        self.p = self if tag == "p" else None if tag in _P_SCOPE or parent is None else parent.p
        self.ends = parent.ends if parent else {}
        if tag in _SCOPES:
            self.ends = self.ends | {k: self if tag in ended else None for k, (ended, beyond) in _ENDS.items() if tag in ended or tag in beyond}

    def weigh(self, attributes: str) -> bool:
        """Take up the element's own evidence; whether it speaks against content."""
        tag = self.tag
        before = self.bad
        own, head = ELEMENTS.get(tag, 0.0), False
        core = tag in ("article", "main")
        if tag == "a":
            self.link = True
        if tag in HIDDEN:
            self.hidden = True
        if attributes and not attributes.isspace():
            for name, *values in _ATTRIBUTE.findall(attributes):
                name, value = name.lower(), entities.unescape(values[0] or values[1] or values[2])
                if name == "role":
                    role = value.strip().lower()
                    self.take(ROLES.get(role, 0.0))
                    core |= role in ("article", "main")
                elif name in ("class", "id") and tag not in ("html", "body"):
                    evidence, against, entry = _named(value, self.article)
                    self.take(evidence)
                    self.named |= against
                    head |= entry
                elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and "display:none" in value.replace(" ", "").lower()):
                    self.hidden = True
        if tag == "header" and (self.article or head):
            own = 0.0 if head else -1.0
        self.take(own)
        self.shut |= self.down <= -12.0
        if core:
            self.core = not (self.article or self.named or self.hidden or self.shut)
            self.article = True
        if self.named:
            self.bad = -12.0
        return self.bad < before

    def take(self, evidence: float) -> None:
        self.up, self.down = max(self.up, evidence), min(self.down, evidence)
        self.good, self.bad = max(self.good, evidence), min(self.bad, evidence)


def _settle(elements: list[_Element]) -> None:
    """Final evidence of all elements, parents before children.

    A word that names boilerplate counts in full unless the element has evidence of its own against
    it: all article and main parts of the page are inside (it wraps them), or there are none and most
    of the page's text outside links is inside; then the word counts the less the larger that share is.
    """
    for e in reversed(elements):
        e.cores += e.core
        if e.parent:
            e.parent.chars += e.chars
            e.parent.linked += e.linked
            e.parent.cores += e.cores
    top = elements[0]
    plain = top.chars - top.linked
    for e in elements:
        bad = e.down
        if e.named:
            share = (e.chars - e.linked) / plain if plain and e.linked <= e.chars / 2 else 0.0
            if not top.cores:
                bad = min(bad, -24.0 * min(0.5, 1 - share))
            elif e.cores < top.cores or e.cores > 1 and share < 0.5:
                bad = -12.0
        e.good = max(e.parent.good, e.up) if e.parent else e.up
        e.bad = min(e.parent.bad, bad) if e.parent else bad


class _Block:
    """A run of text between block boundaries."""

    __slots__ = ("parts", "linked", "element", "order")

    def __init__(self, element: _Element) -> None:
        self.parts: list[str] = []
        self.linked = 0
        self.element = element
        self.order = -1


def blocks(page: str) -> list[tuple[str, int, _Element]]:
    """Text, characters inside links, and element of every block in page order."""
    found: list[_Block] = []
    count = 0
    top = _Element("", None, 0)
    top.buffer = _Block(top)
    elements = [top]

    def part(element: _Element) -> None:
        element.buffer = _Block(element)

    still_open: dict[str, int] = {}

    def leave(element: _Element) -> _Element:
        """Close everything down to the element; its parent is the open one."""
        gone = top
        while gone is not element:
            still_open[gone.tag] -= 1
            gone = gone.parent
        still_open[element.tag] -= 1
        return element.parent

    def write(element: _Element, text: str) -> None:
        if element.hidden or not text:
            return
        block = element.buffer
        if block.order < 0:
            if text.isspace():
                return
            block.order = len(found)
            found.append(block)
        block.parts.append(text)
        size = len(text.strip())
        element.chars += size
        if element.link:
            block.linked += len(text)
            element.linked += size

    at, size = 0, len(page)
    while at < size:
        open_ = page.find("<", at)
        if open_ < 0:
            open_ = size
        if open_ > at:
            text = page[at:open_]
            write(top, entities.unescape(text) if "&" in text else text)
        if open_ == size:
            break
        if page.startswith("<!--", open_):
            end = page.find("-->", open_ + 4)
            at = size if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), open_):
            end = page.find(">", open_)
            at = size if end < 0 else end + 1
            continue
        m = _TAG.match(page, open_)
        if not m:
            after = page[open_ + 1:open_ + 2]
            if after.isalpha() or after == "/":  # a broken tag ends at the next bracket
                end = page.find(">", open_)
                at = size if end < 0 else end + 1
            else:
                write(top, "<")
                at = open_ + 1
            continue
        at = m.end()
        tag = m[2].lower()
        if m[1]:
            if still_open.get(tag):
                element = top
                while element.tag != tag:
                    element = element.parent
                top = leave(element)
            if tag in BLOCKS:
                part(top)
            continue
        if tag == "br":
            write(top, " ") if top.buffer.order >= 0 else None
            continue
        if tag in BLOCKS:
            ended = top.ends.get(tag)
            if ended:
                top = leave(ended)
            if top.p:
                top = leave(top.p)
            part(top)
        if tag in VOID:
            continue
        count += 1
        element = _Element(tag, top, count)
        elements.append(element)
        against = element.weigh(m[3])
        if tag in BLOCKS or against:
            part(element)  # inline boilerplate is a block beside the one it stands in
        if not m[3].endswith("/") or tag in BLOCKS or tag in RAW:
            top = element
            still_open[tag] = still_open.get(tag, 0) + 1
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.IGNORECASE).search(page, at)
            at = end.start() if end else size
    _settle(elements)
    out = []
    for b in found:
        text = " ".join("".join(b.parts).split())
        if text:
            out.append((text, b.linked, b.element))
    return out


#: Weights of the text's features, if no page shows what is content: one, log length, sentences, link
#: share, share of capitals.
PRIOR = np.array([-1.0, 1.2, 0.5, -4.0, -1.0])
#: Bound of the classifier's log odds of a block, and what a paragraph's or heading's tag adds.
BOUND, TAG = 3.0, 0.8


def features(text: str, linked: int) -> list[float]:
    """What the classifier is fitted on: a block's text, no tag of it or of what holds it."""
    length = len(text)
    capitals = sum(c.isupper() for c in text[:4000]) / min(length, 4000)
    return [1.0, math.log1p(length / 40), min(len(_SENTENCE.findall(text)), 6) / 2, min(1.0, linked / length), min(1.0, 3 * capitals)]


def evidence(element: _Element) -> float:
    """Log odds of the markup around a block: of its element and all that hold it."""
    return element.good + element.bad


def fitted(x: np.ndarray, y: np.ndarray, steps: int = 25, pull: float = 1.0) -> np.ndarray:
    """Logistic weights, pulled towards the prior; both labels count the same in all."""
    w = PRIOR.copy()
    share = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (share * (y - p)) - pull * (w - PRIOR)
        h = (x * (share * p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(pages: DataFrame, html_col: str = "html", sample: int = 1_000) -> np.ndarray:
    """The classifier's weights from the pages' own structure: blocks whose markup says content (in an
    article or main part) against blocks whose markup says boilerplate. ``sample`` bounds the pages,
    those of smallest hash; at most 200 blocks of a page are taken, spread over it."""
    hashed = pages.select(F.col(html_col).alias("html"), F.xxhash64(html_col).alias("h")).where("html is not null")
    # the hashes alone are sorted; equal pages are one, joined before they are shuffled
    last = hashed.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    if last is None:
        return PRIOR
    chosen = hashed.where(F.col("h") <= last).groupBy("h").agg(F.any_value("html").alias("html")).select("html")
    schema, arrow = schemas([("y", T.DoubleType()), ("x", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, 0):
            y, x = [], []
            for page in part.column(0).to_pylist():
                known = [b for b in blocks(page) if evidence(b[2]) >= 3.0 or evidence(b[2]) <= -6.0]
                for b in known[::max(1, -(-len(known) // 200))]:
                    y.append(float(evidence(b[2]) > 0))
                    x.append([float(v) for v in features(*b[:2])])
            yield batch_of(arrow, y=y, x=x)

    rows = spread(chosen).mapInArrow(run, schema).collect()  # at most 200 small rows of each sampled page
    y = np.array([r["y"] for r in rows])
    if not len(y) or y.min() == y.max():
        return PRIOR
    return fitted(np.array([r["x"] for r in rows], float), y)


def text_odds(found: list[tuple[str, int, _Element]], weights: np.ndarray) -> list[float]:
    """The classifier: log odds of content of every block from its text and its own tag."""
    own = np.clip(np.array([features(*b[:2]) for b in found], float) @ weights, -BOUND, BOUND)
    return (own + np.array([TAG if b[2].tag == "p" or b[2].tag in _HEADINGS else 0.0 for b in found])).tolist()


def minimum_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """The content side of the cut.

    Labelling node i boilerplate costs softplus(odds), content softplus(-odds), and an edge costs its
    weight if its ends differ. Nodes that their terminals decide whatever their neighbours are, are
    settled first, which keeps the minimum; the others are cut by shortest augmenting paths.
    """
    n = len(odds)
    bias = [round(_SCALE * x) for x in odds]  # softplus(x) - softplus(-x) = x: only the difference counts
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for a, b, w in edges:
        c = round(_SCALE * w)
        if a != b and c > 0:
            near[a][b] = near[a].get(b, 0) + c
            near[b][a] = near[b].get(a, 0) + c
    label: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is not None or abs(bias[i]) < sum(near[i].values()):
            continue
        label[i] = bias[i] > 0
        for j, c in near[i].items():
            del near[j][i]
            bias[j] += c if label[i] else -c
            todo.append(j)
        near[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        for i, side in zip(rest, _flow(rest, bias, near), strict=True):
            label[i] = side
    return [bool(x) for x in label]


def _flow(nodes: list[int], bias: list[int], near: list[dict[int, int]]) -> list[bool]:
    """Source side of the minimum cut among the nodes, by Dinic's maximum flow."""
    number = {v: k for k, v in enumerate(nodes)}
    n = len(nodes)
    source, sink = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[int] = []

    def edge(a: int, b: int, there: int, back: int) -> None:
        head[a].append(len(to))
        to.append(b)
        room.append(there)
        head[b].append(len(to))
        to.append(a)
        room.append(back)

    for v in nodes:
        k = number[v]
        if bias[v] > 0:
            edge(source, k, bias[v], 0)
        elif bias[v] < 0:
            edge(k, sink, -bias[v], 0)
        for u, c in near[v].items():
            if u > v:
                edge(k, number[u], c, c)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in head[a]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[k] >= 0 for k in range(n)]
        nxt = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                push = min(room[e] for e in path)
                for e in path:
                    room[e] -= push
                    room[e ^ 1] += push
                path, a = [], source
                continue
            while nxt[a] < len(head[a]):
                e = head[a][nxt[a]]
                if room[e] and level[to[e]] == level[a] + 1:
                    break
                nxt[a] += 1
            if nxt[a] < len(head[a]):
                path.append(head[a][nxt[a]])
                a = to[path[-1]]
            elif path:
                a = to[path.pop() ^ 1]
                nxt[a] += 1
            else:
                break


def smoothness(elements: list[_Element]) -> list[tuple[int, int, float]]:
    """Edges between neighbours, weaker the further apart they stand in the tree, and along the
    blocks of one container."""
    edges = []
    last: dict[int, int] = {}
    for i, e in enumerate(elements):
        holder = e.parent.number if e.parent else 0
        if i:
            a, b, steps = elements[i - 1], e, 0
            while a is not b and steps < 12:
                if a.depth >= b.depth and a.parent:
                    a = a.parent
                elif b.parent:
                    b = b.parent
                steps += 1
            edges.append((i - 1, i, ADJACENT / (1 + max(0, steps - 2))))
        if holder in last and last[holder] < i - 1:
            edges.append((last[holder], i, PROXIMATE))
        last[holder] = i
    return edges


def graph(found: list[tuple[str, int, _Element]], weights: np.ndarray) -> tuple[list[float], list[tuple[int, int, float]]]:
    """Terminal log odds and edges: the blocks first, by their texts, then the elements that hold them
    and the elements around those, by the markup. A block is tied to its element, an element to the
    one around it, and neighbouring blocks to each other."""
    odds = text_odds(found, weights)
    edges = smoothness([b[2] for b in found])
    node: dict[int, int] = {}
    for i, (_, _, e) in enumerate(found):
        own = e.number not in node
        for x in (e, e.parent):
            if x is not None and x.number not in node:
                node[x.number] = len(odds)
                odds.append(evidence(x))
        edges.append((i, node[e.number], TIE))
        if own and e.parent is not None:
            edges.append((node[e.number], node[e.parent.number], AROUND))
    return odds, edges


def main_text(page: str | None, weights: np.ndarray = PRIOR) -> str:
    """Blocks of the page on the content side of the cut, in page order, joined by an empty line."""
    if not page:
        return ""
    found = blocks(page)
    if not found:
        return ""
    keep = minimum_cut(*graph(found, weights))
    return "\n\n".join(b[0] for b, k in zip(found, keep, strict=False) if k)


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text", sample: int = 1_000) -> DataFrame:
    """The classifier is fitted on at most ``sample`` pages (``fit``). The rows of ``pages`` with the html replaced by the column of the main text.

    Null, empty and textless pages have an empty text; whole pages are read, whatever their length.
    Other columns stay as they are (a column of the text's name is replaced); rows may repeat.
    """
    kept = [c for c in pages.columns if c not in (html_col, text_col)]
    rows = pages.select(*kept, html_col)
    weights = fit(pages, html_col, sample)
    schema, arrow = schemas([*[(f.name, f.dataType) for f in rows.schema][:-1], (text_col, T.StringType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, len(kept)):
            texts = [main_text(p, weights) for p in part.column(len(kept)).to_pylist()]
            yield batch_of(arrow, **dict(zip(kept, part.columns, strict=False)), **{text_col: texts})

    return spread(rows).mapInArrow(run, schema)
