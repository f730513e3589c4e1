"""Main text of web pages by minimum-cut labelling (free style: Arrow batches).

A page becomes blocks: runs of text between the bounds of block elements. A
logistic classifier over a block's tag path, names, links and text gives the
log odds of content, which are the capacities to source and sink. Neighbouring
blocks, and blocks of one container, are joined by edges whose weight falls with
the distance between their paths. Maximum flow finds the labelling of least total
cost, so a block may go the way of its surroundings against its own odds; the
blocks on the source side are the main text.

The classifier is fitted on a bounded sample of pages (``SAMPLE`` pages of up to
``SAMPLE_CHARS`` characters, first by a hash of their id; both are parameters)
that say where their article is: blocks inside it are content, others are not,
each once with what gives the label away and once without, so that pages without
an article are judged by the rest. The fit is penalised towards fixed weights,
which hold where no page has an article.

Scripts, styles, controls, navigation and the like cannot be content whatever the
cut (their cost is infinite); a form around an article or a top heading is a
wrapper and counts for nothing. Character references are decoded after markup is
taken away, white space in a block becomes one space, blocks are joined by one
newline in page order. Whole pages are processed, in time linear in their length
up to the flow. Null, empty and textless pages give an empty text. Repeated rows
are extracted each; pages without an id are extracted but not learnt from. An
empty table gives an empty result. Other columns are carried by the caller.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm import kernels as K
from lamina.llm.common import ship, small_batches, unused

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*+)(?:>|\Z)", re.S)
ATTR = re.compile(r"([a-zA-Z_:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.S)
SPACE = re.compile(r"[\s]+")
# Elements by their part in a page, and words of names and roles that mark boilerplate or content.
RAW = frozenset("script style noscript template textarea title iframe select xmp noembed noframes".split())
#: Without a closing tag these hide the rest of the page; of other raw elements only the tag goes.
TO_END = frozenset("script style".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul video audio".split())
NEVER = frozenset("nav footer aside form button head menu dialog fieldset legend label input".split())
SHELL = frozenset("header".split())
CONTENT = frozenset("article main".split())
CLOSES_P = BLOCK - frozenset(["html", "body", "head"])
#: An unclosed inline element ends where one of these begins.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 article main section body".split())
#: Marks of boilerplate wherever they stand in a name, and those that only do so alone or at a name's end (a "site-notice" is a notice, a "notice-period" is none).
STRONG = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored banner nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead comment comments disqus cookie cookies consent popup modal overlay subscribe newsletter signup login share sharing social pagination pager toolbar contentinfo complementary".split())
WEAK = frozenset("promo promotion side aside foot header reply replies notice alert related recommend recommended recommendations widget copyright legal search skip tag tags toc dialog hidden".split())
GOOD = frozenset("article main content post entry story body text".split())
BLOCK_NAMES = re.compile(r"[a-z]+")
INFINITE = 1e9
#: Weights of the edges between neighbours (shared by their distance) and to the container.
ADJACENT, NESTED = 3.0, 1.0
#: Pages of the sample, and the most characters of one.
SAMPLE, SAMPLE_CHARS = 400, 100_000
#: Strength of the pull towards the prior weights.
PENALTY = 2.0
#: Features of a block with their prior weights.
PRIOR = {
    "bias": -1.0,
    "inside an article": 5.0,
    "outside the article": -5.0,
    "name of content": 1.5,
    "name of boilerplate": -2.0,
    "share of links": -3.0,
    "share of links of a short text": -1.5,
    "log words": 0.6,
    "paragraph": 0.8,
    "heading": 0.8,
    "item or cell": -0.5,
    "ends like a sentence": 0.7,
    "copyright": -3.0,
}
#: Features that give a block's label away in training.
TELLING = [list(PRIOR).index(k) for k in ("inside an article", "outside the article", "name of content", "name of boilerplate")]


def named(names: str) -> tuple[bool, bool, bool]:
    """Whether class, id and role names mark boilerplate surely, perhaps, or mark content."""
    strong = weak = good = False
    for name in names.lower().split():
        words = BLOCK_NAMES.findall(name)
        if words:
            strong |= any(w in STRONG for w in words) or words[-1] in WEAK
            weak |= any(w in WEAK for w in words)
            good |= any(w in GOOD for w in words)
    return strong, weak, good


class Node:
    __slots__ = ("tag", "parent", "depth", "own", "weak", "good", "content", "wrapper", "bad", "inner")

    def __init__(self, tag: str, parent: Node | None, attrs: str) -> None:
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 0
        strong = weak = good = False
        if attrs and "=" in attrs:
            held = {k.lower(): a or b or c for k, a, b, c in ATTR.findall(attrs)}
            strong, weak, good = named(" ".join(held.get(k, "") for k in ("class", "id", "role", "aria-label", "itemprop")))
            strong = strong and not (good and tag in CONTENT)
            style = held.get("style", "").replace(" ", "").lower()
            strong = strong or "display:none" in style or held.get("aria-hidden") == "true"
        if not strong and re.search(r"\bhidden\b", attrs) and tag != "input":
            strong = "=" not in attrs or bool(re.search(r"(?:^|\s)hidden(?:\s|$|=)", attrs))
        inside = parent is not None and parent.content
        # A header inside an article holds its title; elsewhere it is the page's.
        self.own = strong or tag in NEVER or tag in SHELL and not inside
        self.weak = weak or (parent.weak if parent else False)
        self.good = good or (parent.good if parent else False)
        self.content = tag in CONTENT or inside
        self.wrapper = False
        self.bad = False
        self.inner = 0


def settle(nodes: list[Node]) -> None:
    """Decide which elements cannot be content; parents come before children. Forms around content are wrappers."""
    for n in nodes:
        if n.tag in CONTENT or n.tag == "h1":
            up = n.parent
            while up is not None and not up.wrapper:
                up.wrapper = True
                up = up.parent
    for n in nodes:
        n.bad = n.own and not (n.tag == "form" and n.wrapper) or n.parent is not None and n.parent.bad


class Block:
    __slots__ = ("text", "node", "linked")

    def __init__(self, text: str, node: Node, linked: int) -> None:
        self.text, self.node, self.linked = text, node, linked


def blocks(page: str) -> list[Block]:
    """Text blocks with the element they stand in, and how many of their characters are links."""
    out: list[Block] = []
    nodes = [Node("#", None, "")]
    open_blocks: list[Node] = [nodes[0]]
    parts: list[str] = []
    link_parts: list[str] = []
    links = 0
    at, n = 0, len(page)
    unclosed: set[str] = set()  # elements without a closing tag behind this place

    def push(tag: str, attrs: str) -> None:
        nodes.append(Node(tag, open_blocks[-1], attrs))
        open_blocks.append(nodes[-1])

    def closing(tag: str) -> re.Match | None:
        found = None if tag in unclosed else re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
        if not found:
            unclosed.add(tag)
        return found

    def flush() -> None:
        nonlocal parts, link_parts
        if parts:
            text = SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                linked = len(SPACE.sub(" ", html.unescape("".join(link_parts))).strip()) if link_parts else 0
                out.append(Block(text, open_blocks[-1], linked))
            parts, link_parts = [], []

    while at < n:
        m = TAG.search(page, at)
        end = m.start() if m else n
        if end > at:
            piece = page[at:end]
            parts.append(piece)
            if links:
                link_parts.append(piece)
        if not m:
            break
        at = m.end()
        tag = m.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(1):
            if tag == "a":
                links = max(0, links - 1)
            elif tag in BLOCK:
                flush()
                for i in range(len(open_blocks) - 1, 0, -1):
                    if open_blocks[i].tag == tag:
                        del open_blocks[i:]
                        break
                    if open_blocks[i].tag in ("article", "main", "body", "table") and tag in ("p", "li", "div", "span"):
                        break
            elif open_blocks[-1].tag == tag:  # an inline element that is a block of its own
                if open_blocks[-1].inner:
                    open_blocks[-1].inner -= 1
                else:
                    flush()
                    open_blocks.pop()
        elif tag in RAW:
            if close := closing(tag):
                at = close.end()
            elif tag in TO_END:
                at = n  # of others only the tag is left out
        elif tag == "br":
            parts.append("\n")
        elif tag == "a":
            links += 1
        elif tag in BLOCK:
            flush()
            links = 0
            if tag == "hr":
                continue
            if tag in CLOSES_P and open_blocks[-1].tag == "p":
                open_blocks.pop()
            if tag == "li" and open_blocks[-1].tag == "li" or tag in ("dd", "dt") and open_blocks[-1].tag in ("dd", "dt") or tag in ("td", "th") and open_blocks[-1].tag in ("td", "th"):
                open_blocks.pop()
            while tag in PROSE and len(open_blocks) > 1 and open_blocks[-1].tag not in BLOCK:
                open_blocks.pop()
            push(tag, m.group(3))
        elif tag == "label" or tag == "input" or tag in VOID or m.group(3).endswith("/"):
            continue
        elif open_blocks[-1].tag == tag:
            open_blocks[-1].inner += 1
        elif "=" in m.group(3) and marks(m.group(3)) and closing(tag):
            flush()
            push(tag, m.group(3))
    flush()
    settle(nodes)
    return out


def marks(attrs: str) -> bool:
    """Whether an inline element is named as boilerplate."""
    return named(" ".join(a or b or c for k, a, b, c in ATTR.findall(attrs) if k.lower() in ("class", "id", "role")))[0]


def features(found: list[Block]) -> np.ndarray:
    """One row per block, in the order of ``PRIOR``."""
    has_article = any(b.node.content and not b.node.bad for b in found)
    out = np.zeros((len(found), len(PRIOR)))
    for i, b in enumerate(found):
        node, words = b.node, b.text.count(" ") + 1
        density = min(1.0, b.linked / len(b.text))
        out[i] = (
            1.0,
            node.content,
            has_article and not node.content,
            node.good,
            node.weak,
            density,
            density * (words < 5),
            np.log(words),
            node.tag in ("p", "pre", "blockquote"),
            node.tag in ("h1", "h2", "h3", "h4", "h5", "h6"),
            node.tag in ("li", "td", "th", "dd", "dt"),
            b.text[-1] in ".!?…。！？:\"'”’»)",
            bool(re.match(r"(?:©|\(c\)|copyright\b|all rights reserved)", b.text, re.I)),
        )
    return out


def fit(pages: list[str], penalty: float = PENALTY, rounds: int = 25) -> np.ndarray:
    """Weights of the block classifier, from pages that have an article; the prior's where none has."""
    prior = np.array(list(PRIOR.values()))
    rows, labels = [], []
    for page in pages:
        found = blocks(page)
        if any(b.node.content and not b.node.bad for b in found):
            x = features(found)
            # Blocks that are ruled out need no odds of their own, but show what boilerplate reads like; doubtful names have no label.
            y = np.array([b.node.content and not b.node.bad for b in found], dtype=float)
            sure = np.array([b.node.bad or not (b.node.weak and b.node.content) for b in found])
            plain = x.copy()
            plain[:, TELLING] = 0.0
            rows += [x[sure], plain[sure]]
            labels += [y[sure], y[sure]]
    if not rows:
        return prior
    x, y = np.concatenate(rows), np.concatenate(labels)
    # Pages count, not blocks: the sample weighs as much as this many blocks against the prior.
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * min(len(y), 2000)
    w = prior.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w))
        w = w + np.linalg.solve(h, x.T @ (weight * (y - p)) - penalty * (w - prior))
    return w


def costs(found: list[Block], weights: np.ndarray) -> tuple[list[float], list[float]]:
    """Costs of calling each block boilerplate, and of calling it content: its log odds, or the certainty of its path."""
    odds = (features(found) @ weights).tolist()
    return [0.0 if b.node.bad else max(o, 0.0) for b, o in zip(found, odds, strict=True)], [INFINITE if b.node.bad else max(-o, 0.0) for b, o in zip(found, odds, strict=True)]


def maximum_flow(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Source side of a minimum cut: terminal capacities per node, undirected edges (Dinic's method).

    A node's own source and sink capacities cancel first; phases then push flow
    along shortest paths from nodes with an excess to nodes with a deficit.
    """
    n = len(source)
    excess = [a - b for a, b in zip(source, sink, strict=True)]
    to: list[int] = []
    cap: list[float] = []
    out: list[list[int]] = [[] for _ in range(n)]
    for a, b, w in edges:
        out[a].append(len(to))
        to.append(b)
        cap.append(w)
        out[b].append(len(to))
        to.append(a)
        cap.append(w)
    tiny = 1e-12
    while True:
        level = [-1] * n
        queue = deque(i for i in range(n) if excess[i] > tiny)
        for i in queue:
            level[i] = 0
        found = False
        while queue:
            i = queue.popleft()
            for e in out[i]:
                j = to[e]
                if cap[e] > tiny and level[j] < 0:
                    level[j] = level[i] + 1
                    found |= excess[j] < -tiny
                    queue.append(j)
        if not found:
            return [x >= 0 for x in level]
        at = [0] * n
        for s in range(n):
            if level[s] != 0:
                continue
            while excess[s] > tiny:
                # One augmenting path by depth-first search with current arcs.
                path: list[int] = []
                i = s
                while True:
                    if excess[i] < -tiny:
                        break
                    while at[i] < len(out[i]):
                        e = out[i][at[i]]
                        if cap[e] > tiny and level[to[e]] == level[i] + 1:
                            break
                        at[i] += 1
                    else:
                        if not path:
                            break
                        e = path.pop()
                        i = to[e ^ 1]
                        at[i] += 1
                        continue
                    path.append(e)
                    i = to[e]
                if not path or excess[i] >= -tiny:
                    break
                push = min(excess[s], -excess[i], min(cap[e] for e in path))
                for e in path:
                    cap[e] -= push
                    cap[e ^ 1] += push
                excess[s] -= push
                excess[i] += push
                at = [0] * n if push <= 0 else at


def distance(a: Node, b: Node) -> int:
    """Steps between two elements of the tree."""
    d = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent  # type: ignore[assignment]
        else:
            b = b.parent  # type: ignore[assignment]
        d += 1
    return d


def graph(found: list[Block], weights: np.ndarray) -> tuple[list[float], list[float], list[tuple[int, int, float]]]:
    """Terminal capacities of the blocks and of one node per container, and the edges."""
    source, sink = costs(found, weights)
    edges = []
    containers: dict[int, int] = {}
    for i, b in enumerate(found):
        if i:
            edges.append((i - 1, i, ADJACENT / (1 + distance(found[i - 1].node, b.node))))
        parent = b.node.parent or b.node
        k = containers.get(id(parent))
        if k is None:
            k = containers[id(parent)] = len(source)
            source.append(0.0)
            sink.append(0.0)
        edges.append((i, k, NESTED))
    return source, sink, edges


def label(found: list[Block], weights: np.ndarray) -> list[bool]:
    """Which blocks are content."""
    return maximum_flow(*graph(found, weights))[: len(found)]


def main_text(page: str | None, weights: np.ndarray | None = None) -> str:
    found = blocks(page) if page else []
    if not found:
        return ""
    weights = np.array(list(PRIOR.values())) if weights is None else weights
    return "\n".join(b.text for b, keep in zip(found, label(found, weights), strict=True) if keep)


def train(pages: DataFrame, sample: int = SAMPLE, max_chars: int = SAMPLE_CHARS) -> np.ndarray:
    """Fit on at most ``sample`` pages (an id's least page, whole), the first by a hash of ``page_id``."""
    ids = [r[0] for r in pages.where("page_id is not null").select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(sample).collect()]
    chosen = pages.where(F.col("page_id").isin(ids)).where(F.length("html") <= max_chars).groupBy("page_id").agg(F.min(F.col("html").cast("string")).alias("html"))
    return fit([r["html"] for r in chosen.orderBy("page_id").collect()])


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), weights: np.ndarray | None = None) -> DataFrame:
    """``keep``, ``text`` and ``n_chars`` of every page; the classifier is fitted on ``pages`` unless its weights are given."""
    small_batches(pages.sparkSession)
    weights = train(pages) if weights is None else weights
    name = unused(pages, "page_html")
    rows = pages.select(*keep, F.col("html").cast("string").alias(name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.frugal()
        for batch in batches:
            for lo, hi in K.slices(batch.column(name)):
                part = batch.slice(lo, hi - lo)
                texts = [main_text(p, weights) for p in part.column(name).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keep)
    return rows.mapInArrow(run, f"{kinds}, text string, n_chars long")


ship(__name__)
