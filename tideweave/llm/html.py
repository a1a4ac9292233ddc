"""Main text of web pages by minimum-cut labelling.

A page is read into blocks: runs of text between block-level tags, each with
the element it stands in.  A classifier gives every block the log-odds of being
content; they become capacities from the source or to the sink.  Neighbouring
blocks and blocks close in the tree are joined by smoothness edges as strong as
the odds of a middling block.  The minimum cut separates content from
boilerplate.

Landmarks (tags like article or nav, class and id names) are features like any
other: what one may say is fitted and bounded.  The classifier is fitted on
blocks that landmarks tell apart, once with all their landmarks and once each
with names, tags or both hidden, so it also learns what the text itself says,
and a page without any landmark is still told apart.
"""

from __future__ import annotations

import math
import re
from collections import deque
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideweave.llm.batches import arrow_map, sliced, strings
from tideweave.llm.quality import Logistic

#: Elements that end a block, that are never text, that hold none.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol "
    "optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
UNSEEN = frozenset("script style noscript template iframe svg math canvas object head title".split())
RAW = frozenset("script style noscript template iframe textarea xmp noembed noframes title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag of the key closes an open element of the values, within its scope.
CLOSES = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "option": {"option"},
}
SCOPES = frozenset("ul ol dl table select body html div section article nav aside main menu".split())
ENDS_P = BLOCKS - frozenset("body caption dd dt head html legend option optgroup tbody td tfoot th thead title tr".split())

#: A comment, declaration or tag.  Quotes count after an equals sign only; one
#: that is never closed reaches to the end of the page, as in a browser.
TAG = re.compile(
    r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*+(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*+)"
    r"((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>\"'][^\s>]*+|(?=>)|\Z))*+)(>|\Z)|/[^>]*+(?:>|\Z))",
    re.S,
)
NAMES = re.compile(r"(?:\s|^)(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
HIDDEN = re.compile(r"(?:\s|^)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
#: Words in class, id or role names, and what they say about the element.
AWAY = re.compile(
    r"(?:^|[\s_-])(?:ads?|ads?\d+|adsbygoogle|advert\w*|sponsor\w*|promo\w*|banners?|cookies?|consent|gdpr|notices?|"
    r"alerts?|popups?|modal|overlay|nav|navbar|navigation|menus?|breadcrumbs?|sidebars?|side|aside|widgets?|footer|foot|"
    r"header|masthead|topbar|toolbar|comments?|commentlist|replies|reply|disqus|discussion|respond|share|sharing|social|"
    r"related|recommend\w*|subscribe|newsletter|signup|login|search|form|pagination|pager|tags?|meta|copyright|legal|"
    r"disclaimer|contentinfo|complementary)(?:$|[\s_-])",
    re.I,
)
TOWARDS = re.compile(
    r"(?:^|[\s_-])(?:article|story|post|entry|content|main|body|text|prose)(?:$|[\s_-])", re.I
)
AWAY_TAGS = frozenset("nav footer aside form header menu button select dialog search fieldset".split())
TOWARDS_TAGS = frozenset(("article", "main"))
SPACE = re.compile(r"\s+")
OWN_HEADER = re.compile(r"article|entry|post", re.I)
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

#: Features of a block, and their log-odds where there is nothing to fit them on.
FEATURES = {
    "length": 0.6,
    "linked": -3.0,
    "sentence": 0.5,
    "paragraph": 1.0,
    "heading": 1.5,
    "item": 0.0,
    "copyright": -2.0,
    "commas": 0.3,
    "capitals": -0.5,
    "company": 0.4,
    "company share": 2.0,
    "boilerplate tag": -5.0,
    "boilerplate name": -5.0,
    "article tag": 3.0,
    "article name": 1.5,
}
DEFAULT_WEIGHTS = tuple(FEATURES.values())
DEFAULT_BIAS = -3.0
#: Which features tell the kind of element, and which are landmarks: tags, names.
KIND_FEATURES, TAG_FEATURES, NAME_FEATURES = (3, 4, 5), (11, 13), (12, 14)
#: Pages that the classifier is fitted on at most.
MAX_PAGES = 400
#: What a landmark may say at most, and what the text may say.
MOST_LANDMARK = 5.0
MOST_TEXT = 2.5
#: Capacity between neighbours under one parent, and its share where only one is in boilerplate by landmarks.
SMOOTHNESS = 1.6
CONTRAST = 0.1
SCALE = 1000


class Element:
    """A block-level element: its parent, and how deep it lies."""

    __slots__ = ("parent", "depth")

    def __init__(self, parent: Element | None) -> None:
        self.parent = parent
        self.depth = parent.depth + 1 if parent else 0


class Open:
    """An open element and what holds inside it."""

    __slots__ = ("name", "element", "tag", "unseen", "away_tag", "away_name", "towards", "named", "link")

    def __init__(
        self,
        name: str,
        element: Element,
        tag: str,
        unseen: bool = False,
        away_tag: bool = False,
        away_name: bool = False,
        towards: bool = False,
        named: bool = False,
        link: bool = False,
    ) -> None:
        self.name, self.element, self.tag, self.unseen = name, element, tag, unseen
        self.away_tag, self.away_name, self.towards, self.named, self.link = away_tag, away_name, towards, named, link


class Block:
    __slots__ = ("element", "pieces", "linked", "tag", "away_tag", "away_name", "towards", "named")

    def __init__(self, top: Open) -> None:
        self.element, self.tag = top.element, top.tag
        self.away_tag, self.away_name, self.towards, self.named = top.away_tag, top.away_name, top.towards, top.named
        self.pieces: list[str] = []
        self.linked = 0


def page_blocks(html: str) -> list[tuple[Block, str]]:
    """The blocks of a page in order, with their text."""
    out: list[tuple[Block, str]] = []
    root = Open("", Element(None), "")
    stack: list[Open] = []
    #: Where the open elements of each name stand in the stack, and the scopes.
    opened: dict[str, list[int]] = {}
    scopes: list[int] = [-1]
    at, block, n = 0, None, len(html)

    def finish() -> None:
        nonlocal block
        if block is not None:
            text = SPACE.sub(" ", unescape("".join(block.pieces))).strip()
            if text:
                out.append((block, text))
            block = None

    def add(raw: str) -> None:
        nonlocal block
        if not raw:
            return
        top = stack[-1] if stack else root
        if top.unseen:
            return
        if block is not None and (block.away_tag, block.away_name) != (top.away_tag, top.away_name):
            finish()
        if block is None:
            if raw.isspace():
                return
            block = Block(top)
        block.pieces.append(raw)
        if top.link:
            block.linked += len(raw)

    def close(k: int) -> None:
        for e in stack[k:]:
            opened[e.name].pop()
        while scopes[-1] >= k:
            scopes.pop()
        del stack[k:]

    while at < n:
        m = TAG.search(html, at)
        if m is None:
            add(html[at:])
            break
        add(html[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if not m[4]:
            break  # the page ends inside a tag
        if m[1]:
            if name in BLOCKS:
                finish()
            if opened.get(name):
                close(opened[name][-1])
            continue
        if name == "br":
            add(" ")
            continue
        if name in BLOCKS:
            finish()
            if name in ENDS_P and opened.get("p"):
                close(opened["p"][-1])
            last = max((opened[x][-1] for x in CLOSES.get(name, ()) if opened.get(x)), default=-1)
            if last > scopes[-1]:
                close(last)
        if name in VOID or m[3].endswith("/"):
            continue
        top = stack[-1] if stack else root
        attrs = m[3]
        names = " ".join(filter(None, (x for g in NAMES.findall(attrs) for x in g))) if "=" in attrs else ""
        names = CAMEL.sub("-", names)
        unseen = top.unseen or name in UNSEEN or (bool(attrs) and HIDDEN.search(attrs) is not None)
        away_name = bool(names) and name not in ("body", "html", "article", "main") and AWAY.search(names) is not None
        away_tag = name in AWAY_TAGS
        if name == "header" and top.towards and not (top.away_tag or top.away_name):
            # An article's own header holds its title.
            away_tag, away_name = False, away_name and not OWN_HEADER.search(names)
        grouped = name in BLOCKS
        opened.setdefault(name, []).append(len(stack))
        if name in SCOPES:
            scopes.append(len(stack))
        stack.append(
            Open(
                name,
                Element(top.element) if grouped else top.element,
                name if grouped else top.tag,
                unseen,
                top.away_tag or away_tag,
                top.away_name or away_name,
                top.towards or name in TOWARDS_TAGS,
                top.named or bool(names and TOWARDS.search(names)),
                top.link or name == "a",
            )
        )
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I).search(html, at)
            stop = end.start() if end else n
            if name == "textarea":
                add(html[at:stop])
            at = stop
    finish()
    return out


def companies(blocks: list[tuple[Block, str]]) -> list[tuple[int, float]]:
    """Characters outside links under each block's parent element, and their share of the page's."""
    held: dict[int, int] = {}
    parents = [id(b.element.parent or b.element) for b, _ in blocks]
    for parent, (b, text) in zip(parents, blocks, strict=True):
        held[parent] = held.get(parent, 0) + max(0, len(text) - b.linked)
    total = max(1, sum(held.values()))
    return [(held[p], held[p] / total) for p in parents]


def block_features(block: Block, text: str, company: tuple[int, float]) -> tuple[float, ...]:
    """The values of :data:`FEATURES`."""
    n, tag, away = len(text), block.tag, block.away_tag or block.away_name
    return (
        min(4.0, math.log1p(n / 20)),
        min(1.0, block.linked / max(1, n)),
        float(text[-1] in ".!?:;\"'”»…"),
        float(tag in ("p", "blockquote", "pre")),
        float(tag[:1] == "h" and tag[1:].isdigit()),
        float(tag == "li"),
        float(text[0] == "©"),
        min(1.0, 20 * text.count(",") / n),
        sum(map(str.isupper, text)) / n,
        min(4.0, math.log1p(company[0] / 100)),
        company[1],
        float(block.away_tag),
        float(block.away_name),
        float(block.towards and not away),
        float(block.named and not away),
    )


class BlockClassifier:
    """Log-odds that a block is content; text and landmarks are each bounded."""

    def __init__(self, weights: tuple[float, ...] = DEFAULT_WEIGHTS, bias: float = DEFAULT_BIAS) -> None:
        cut = TAG_FEATURES[0]
        bounded = (max(-MOST_LANDMARK, min(MOST_LANDMARK, w)) for w in weights[cut:])
        self.weights, self.bias = (*weights[:cut], *bounded), bias

    def odds(self, blocks: list[tuple[Block, str]]) -> list[float]:
        """Of every block of a page."""
        out, w, cut = [], self.weights, TAG_FEATURES[0]
        for (block, text), company in zip(blocks, companies(blocks), strict=True):
            x = block_features(block, text, company)
            own = self.bias + sum(a * b for a, b in zip(w[:cut], x[:cut], strict=True))
            marks = sum(a * b for a, b in zip(w[cut:], x[cut:], strict=True))
            out.append(max(-MOST_TEXT, min(MOST_TEXT, own)) + marks)
        return out


def fit_classifier(pages: list[str]) -> BlockClassifier:
    """Logistic regression on blocks whose landmarks tell what they are.

    Every block is shown with all its landmarks, without names, without tags,
    without either, and by its text alone.  Classes weigh alike; weights that the pages say
    nothing about stay near the defaults, and with fewer than 20 blocks of
    either class all do.
    """
    rows, labels = [], []
    for page in pages:
        blocks = page_blocks(page)
        for (block, text), company in zip(blocks, companies(blocks), strict=True):
            away = block.away_tag or block.away_name
            if away or block.towards:
                rows.append(block_features(block, text, company))
                labels.append(float(not away))
    y = np.array(labels)
    if min(y.sum(), len(y) - y.sum()) < 20:
        return BlockClassifier()
    x = np.array(rows)
    shown = []
    both = NAME_FEATURES + TAG_FEATURES
    for hidden in ((), NAME_FEATURES, TAG_FEATURES, both, both + KIND_FEATURES):
        one = x.copy()
        one[:, list(hidden)] = 0.0
        shown.append(one)
    share = y.mean()
    weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))
    model = Logistic.fit(
        np.vstack(shown), np.tile(y, len(shown)), ridge=2e-3, toward=np.array(DEFAULT_WEIGHTS), sample=np.tile(weight, len(shown))
    )
    return BlockClassifier(tuple(float(w) for w in model.weights), model.bias)


def tree_distance(a: Element, b: Element) -> int:
    """Steps between two elements; as many are taken."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def smoothness_edges(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Adjacent blocks, and the next block under the same parent element."""
    edges, last = [], {}
    away = [b.away_tag or b.away_name for b in blocks]

    def join(i: int, j: int, weight: float) -> None:
        edges.append((i, j, weight * SMOOTHNESS * (1.0 if away[i] == away[j] else CONTRAST)))

    for i, block in enumerate(blocks):
        if i:
            # Two siblings are two steps apart.
            join(i - 1, i, 1 / max(1, tree_distance(blocks[i - 1].element, block.element) - 1))
        parent = id(block.element.parent or block.element)
        if last.get(parent, i - 1) != i - 1:
            join(last[parent], i, 0.5)
        last[parent] = i
    return edges


def minimum_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which blocks stand on the source's side of the minimum cut.

    Flow that a block takes from the source straight to the sink is cancelled
    first; what is left is augmented along shortest paths level by level.
    """
    n = len(odds)
    source = [max(0, round(SCALE * x)) for x in odds]
    sink = [max(0, round(-SCALE * x)) for x in odds]
    if not any(source):
        return [False] * n
    if not any(sink):
        return [True] * n
    to: list[list[int]] = [[] for _ in range(n)]
    cap: list[int] = []
    head: list[int] = []
    for a, b, weight in edges:
        c = round(SCALE * weight)
        to[a].append(len(head))
        to[b].append(len(head) + 1)
        head += [b, a]
        cap += [c, c]
    while True:
        level = [-1] * n
        queue = deque(i for i in range(n) if source[i])
        for i in queue:
            level[i] = 0
        reached = False
        while queue:
            u = queue.popleft()
            reached |= sink[u] > 0
            for e in to[u]:
                if cap[e] and level[head[e]] < 0:
                    level[head[e]] = level[u] + 1
                    queue.append(head[e])
        if not reached:
            return [x >= 0 for x in level]
        at = [0] * n
        for root in range(n):
            while source[root]:
                path, u = [], root
                while True:
                    if sink[u]:
                        flow = min([source[root], sink[u], *(cap[e] for e in path)])
                        source[root] -= flow
                        sink[u] -= flow
                        for e in path:
                            cap[e] -= flow
                            cap[e ^ 1] += flow
                        break
                    while at[u] < len(to[u]):
                        e = to[u][at[u]]
                        if cap[e] and level[head[e]] == level[u] + 1:
                            break
                        at[u] += 1
                    if at[u] < len(to[u]):
                        path.append(to[u][at[u]])
                        u = head[path[-1]]
                    elif path:
                        u = head[path.pop() ^ 1]
                        at[u] += 1
                    else:
                        break
                if not path and (u == root and not sink[u] and at[u] >= len(to[u])):
                    break


def main_text(html: str, classifier: BlockClassifier | None = None) -> str:
    """The page's content blocks in order, joined by newlines."""
    blocks = page_blocks(html)
    if not blocks:
        return ""
    classifier = classifier or BlockClassifier()
    kept = minimum_cut(classifier.odds(blocks), smoothness_edges([b for b, _ in blocks]))
    return "\n".join(text for (_, text), keep in zip(blocks, kept, strict=True) if keep)


def sampled_pages(df: DataFrame, html_col: str, id_col: str, most: int) -> list[str]:
    """At most ``most`` pages, those with the smallest hashed ids; one page per id."""
    page = F.col(html_col).cast("string")
    ids = df.select(F.col(f"`{id_col}`").alias("__id")).where(F.col("__id").isNotNull()).distinct()
    chosen = F.broadcast(ids.orderBy(F.xxhash64("__id"), "__id").limit(most))  # bounded by ``most``
    rows = df.select(F.col(f"`{id_col}`").alias("__id"), page.alias("h")).join(chosen, "__id")
    one = rows.groupBy("__id").agg(F.min(F.struct(F.xxhash64("h").alias("k"), "h")).alias("r"))
    return sorted(r["h"] or "" for r in one.select("r.h").collect())


def extract_pages(
    df: DataFrame,
    html_col: str = "html",
    keep: tuple[str, ...] = ("page_id", "url"),
    classifier: BlockClassifier | None = None,
    max_pages: int = MAX_PAGES,
) -> DataFrame:
    """``keep``, ``text`` and ``n_chars`` of every row of ``df``.

    Without a ``classifier`` one is fitted on at most ``max_pages`` pages,
    sampled by the hash of the first column kept.  Null or empty html gives an
    empty text; repeated rows each get a row; an empty table gives an empty
    result; columns of ``df`` other than ``keep`` are not carried along.
    """
    model = classifier or fit_classifier(sampled_pages(df, html_col, keep[0], max_pages))
    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join(f"`{c}` {fields[c]}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, column=len(keep)):
            texts = [main_text(h, model) for h in strings(part.column(len(keep)))]
            columns = [*part.columns[: len(keep)], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "text", "n_chars"])

    picked = df.select(*(F.col(f"`{c}`") for c in keep), F.col(html_col).cast("string").alias("__html"))
    return arrow_map(picked, run, schema + ", text string, n_chars long")


def op5_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op5_html_main_text": op5_html_main_text}
ORACLES: dict[str, str] = {}
