"""Main text of web pages by minimum-cut labelling of their text blocks.

A page is read into blocks: runs of text without a block-level tag between them, with the open
elements around them.  A linear classifier with fixed weights turns each block's features into the
cost of calling it content or boilerplate; these are the capacities to the two terminals.  Blocks
next to each other, and following blocks of the same container, are tied by smoothness edges, the
stronger the closer they are in the document tree.  A maximum flow finds the cheapest labelling.

Defined results: null and empty pages have an empty text; markup that is never closed ends with the
page; character references are decoded; white space (also a line break tag) is one blank; repeated
pages are extracted each; null ids stay null.
"""

from __future__ import annotations

import html as markup
import re
from collections import Counter, deque
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from fitrank.llm.batches import as_batch, text_slices

VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
SKIPPED = frozenset(
    "script style noscript template svg math iframe object canvas audio video head title "
    "textarea select option datalist button input label".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav "
    "ol p pre search section summary table tbody tfoot thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CELLS = frozenset(("td", "th"))
# An opening tag on the left ends the nearest open element on the right, but not across the barrier.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}
PLAIN_TAGS = frozenset("nav footer aside form dialog menu search fieldset".split())
PLAIN_ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar "
    "status toolbar".split()
)
# Parts of a class name or id, which are split at hyphens and underscores.
PLAIN_WORD = re.compile(
    r"ads?|adverts?|advertisement|adsense|banner|billboard|breadcrumbs?|captcha|"
    r"comment\w*|consent|cookies?|copyright|dialog|discuss(?:ion)?|disqus|"
    r"dropdown|follow|footer|foot|gdpr|header|login|masthead|menu|menubar|modal|nav|navbar|"
    r"navigation|newsletter|notices?|notification|outbrain|overlay|pager|pagination|paywall|popup|"
    r"promo(?:tion)?|recommend(?:ed|ations)?|related|repl(?:y|ies)|responses?|search|share|sharing|"
    r"side|sidebar|signup|skip|social|sponsor(?:ed|s)?|subscribe|taboola|tags?|teaser|toc|toolbar|"
    r"topbar|warning|alert|widget",
    re.IGNORECASE,
)
LAYOUT_WORDS = frozenset("with without has no is show hide".split())  # with-sidebar: the rest of the page
MAIN_WORDS = frozenset("article content entry main post story".split())
NAME_PARTS = re.compile(r"[^\W\d_]+")
MAIN_NAMES = re.compile(
    r"(?:^|[\s_-])(?:article|body-?text|content|entry|main|post|story|text)(?:$|[\s_-])", re.IGNORECASE
)
TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
OTHER_TAG = re.compile(r"/[a-zA-Z]|[!?]|/>")
INSIDE_TAG = re.compile(r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+")
ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
RAW = {
    name: re.compile(f"</{name}(?=[\\s/>])", re.IGNORECASE)
    for name in "script style textarea title xmp iframe noembed noframes".split()
}
HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)

# Weights of the classifier: the score of a block is their sum; above zero it looks like content.
BIAS = 0.5
IN_PLAIN = -12.0  # by tag or role
IN_PLAIN_NAME = -6.0  # by a name that is a listed word or ends with one, as site-footer
IN_PLAIN_PART = -1.5  # by a name that only begins with one, as nav-open
IN_MAIN = 3.0
IN_MAIN_NAME = 1.0
LINKED = -3.0  # times the share of the letters inside links
LENGTH = 1.0  # times the words, in tens, up to 3
SENTENCES = 0.3  # for an end of sentence, up to 3
HEADING = 0.5
# Smoothness: neighbours in the page, and following blocks of one container, by tree distance.
NEXT_TO = 0.4
SAME_CONTAINER = 0.25
SCALE = 1000


class Box:
    """A block element in the document tree."""

    __slots__ = ("depth", "parent")

    def __init__(self, parent: Box | None):
        self.parent = parent
        self.depth = parent.depth + 1 if parent else 0


class Block(NamedTuple):
    text: str
    plain: bool
    plain_name: float
    main: bool
    named: bool
    heading: bool
    linked: float
    box: Box


class Element(NamedTuple):
    tag: str
    box: Box
    skipped: bool
    plain: bool
    plain_name: float
    main: bool
    named: bool
    link: bool
    heading: bool


class BlockReader:
    """Collects the text blocks of one page, in one pass over its characters."""

    def __init__(self):
        self.open = [Element("", Box(None), False, False, 0.0, False, False, False, False)]
        self.count_open: Counter[str] = Counter()
        self.blocks: list[Block] = []
        self.parts: list[str] = []
        self.linked = 0

    def read(self, html: str):
        """Handle text and tags.  A tag, comment or script that never ends takes the rest of the page.

        Where a quote in a tag never ends, tags end at the next ``>`` from there on.
        """
        at, quotes = 0, True
        while (start := html.find("<", at)) >= 0:
            if start > at:
                self.handle_data(html[at:start])
            if tag := TAG_NAME.match(html, start + 1):
                end = INSIDE_TAG.match(html, tag.end()).end() if quotes else len(html)
                if html[end : end + 1] != ">":
                    quotes, end = False, html.find(">", tag.end())
                if end < 0:
                    return
                at = end + 1
                name = tag[0].lower()
                self.handle_starttag(name, html[tag.end() : end])
                if name in RAW:
                    end = RAW[name].search(html, at)
                    if not end:
                        return
                    at = end.start()
            elif html.startswith("<!--", start):
                end = html.find("-->", start + 2)
                if end < 0:
                    return
                at = end + 3
            elif OTHER_TAG.match(html, start + 1):
                end = html.find(">", start)
                if end < 0:
                    return
                at = end + 1
                if name := TAG_NAME.match(html, start + 2):
                    if html[start + 1] == "/":
                        self.handle_endtag(name[0].lower())
            else:
                self.handle_data("<")
                at = start + 1
        self.handle_data(html[at:])

    def end_block(self):
        text = " ".join("".join(self.parts).split())
        if text:
            top = self.open[-1]
            share = min(1.0, self.linked / len(text))
            self.blocks.append(
                Block(text, top.plain, top.plain_name, top.main, top.named, top.heading, share, top.box)
            )
        self.parts, self.linked = [], 0

    def close_to(self, depth: int):
        """Close all elements from this depth on."""
        if any(e.tag in BLOCKS for e in self.open[depth:]):
            self.end_block()
        elif any(e.tag in CELLS for e in self.open[depth:]):
            self.parts.append(" ")
        self.count_open.subtract(e.tag for e in self.open[depth:])
        del self.open[depth:]

    def handle_starttag(self, tag: str, attributes: str):
        if tag == "br" or tag in CELLS:
            self.parts.append(" ")
        if tag in BLOCKS:
            for depth in range(len(self.open) - 1, 0, -1):
                if self.open[depth].tag == "p":
                    self.close_to(depth)
                    break
                if self.open[depth].tag in BLOCKS or self.open[depth].tag in CELLS:
                    break
        if tag in ENDS:
            closed, barrier = ENDS[tag]
            for depth in range(len(self.open) - 1, 0, -1):
                if self.open[depth].tag in closed:
                    self.close_to(depth)
                    if tag != "tr" or depth == 0:
                        break
                elif self.open[depth].tag in barrier:
                    break
        if tag in BLOCKS:
            self.end_block()
        if tag not in VOID:
            self.open.append(self.element(tag, read_attributes(attributes)))
            self.count_open[tag] += 1

    def element(self, tag: str, attrs: dict) -> Element:
        up = self.open[-1]
        names = f"{attrs.get('class') or ''} {attrs.get('id') or ''}" if attrs else ""
        role = (attrs.get("role") or "").lower() if attrs else ""
        hidden = bool(attrs) and (
            "hidden" in attrs
            or attrs.get("aria-hidden") == "true"
            or bool(HIDDEN_STYLE.search(attrs.get("style") or ""))
        )
        main = tag in ("article", "main") or role in ("main", "article")
        own_plain = (
            tag in PLAIN_TAGS
            or role in PLAIN_ROLES
            or (tag == "header" and not up.main)
        )
        named = plain_name(names, up.main) if names.strip() and tag not in ("html", "body") else 0.0
        if main or (tag == "h1" and up.main):
            # What encloses an article or its title says nothing of it; a comment is still a comment.
            named = min(named, up.plain_name) if named and up.plain_name and tag == "article" else 0.0
        else:
            named = min(named, up.plain_name)
        return Element(
            tag,
            Box(up.box) if tag in BLOCKS else up.box,
            up.skipped or hidden or tag in SKIPPED,
            up.plain or own_plain,
            named,
            up.main or (main and not named),
            up.named or (names.strip() != "" and bool(MAIN_NAMES.search(names))),
            up.link or tag == "a",
            up.heading or tag in HEADINGS,
        )

    def handle_endtag(self, tag: str):
        if not self.count_open[tag]:
            return
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth].tag == tag:
                self.close_to(depth)
                return

    def handle_data(self, data: str):
        top = self.open[-1]
        if not top.skipped:
            self.parts.append(markup.unescape(data) if "&" in data else data)
            if top.link:
                self.linked += len(data)


@lru_cache(1 << 12)
def plain_name(names: str, in_main: bool) -> float:
    """The weight of classes and ids that name a part around the article, 0 for none."""
    weight = 0.0
    tokens = names.lower().split()
    for token in tokens:
        parts = NAME_PARTS.findall(token)
        if in_main or not MAIN_WORDS.isdisjoint(parts):
            parts = [part for part in parts if part != "header"]  # of the article
        listed = [PLAIN_WORD.fullmatch(part) is not None for part in parts]
        if not any(listed) or (parts[0] in LAYOUT_WORDS and len(parts) > 1):
            continue
        if listed[-1] or sum(listed) > 1:
            weight = min(weight, IN_PLAIN_NAME)
        elif MAIN_WORDS.isdisjoint(tokens):  # else a mark of the article, as tag-music
            weight = min(weight, IN_PLAIN_PART)
    return weight


def read_attributes(inside: str) -> dict[str, str]:
    if not inside.strip(" /"):
        return {}
    return {
        name.lower(): value.strip("\"'") for name, value in reversed(ATTRIBUTE.findall(inside))
    }


def read_blocks(html: str) -> list[Block]:
    reader = BlockReader()
    reader.read(html)
    reader.close_to(1)
    reader.end_block()
    return reader.blocks


def score(block: Block) -> float:
    """Above zero for content."""
    words = block.text.count(" ") + 1
    ends = sum(block.text.count(mark) for mark in (". ", "! ", "? ", "。")) + (
        block.text[-1] in ".!?。"
    )
    return (
        BIAS
        + IN_PLAIN * block.plain
        + block.plain_name
        + IN_MAIN * block.main
        + IN_MAIN_NAME * block.named
        + LINKED * block.linked
        + LENGTH * min(words / 10, 3)
        + SENTENCES * min(ends, 3)
        + HEADING * block.heading
    )


def tree_distance(a: Box, b: Box) -> int:
    """Steps from one element to the other by way of their nearest common ancestor."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def smoothness(blocks: list[Block]) -> list[tuple[int, int, int]]:
    """Edges (block, block, capacity): neighbours, and following blocks of one container."""
    edges: dict[tuple[int, int], float] = {}
    last_in: dict[Box | None, int] = {}
    for i, block in enumerate(blocks):
        if i:
            edges[i - 1, i] = NEXT_TO / (1 + tree_distance(blocks[i - 1].box, block.box))
        before = last_in.get(block.box.parent)
        if before is not None:
            edges[before, i] = edges.get((before, i), 0.0) + SAME_CONTAINER
        last_in[block.box.parent] = i
    return [(a, b, int(c * SCALE)) for (a, b), c in edges.items() if int(c * SCALE)]


def source_side(
    count: int, from_source: list[int], to_sink: list[int], ties: list[tuple[int, int, int]]
) -> list[bool]:
    """Which nodes stay with the source in a minimum cut, by a maximum flow in level graphs."""
    source, sink = count, count + 1
    heads: list[int] = []
    room: list[int] = []
    links: list[list[int]] = [[] for _ in range(count + 2)]

    def tie(a: int, b: int, there: int, back: int):
        for x, y, capacity in ((a, b, there), (b, a, back)):
            links[x].append(len(heads))
            heads.append(y)
            room.append(capacity)

    for node in range(count):
        # What goes straight through needs no search.
        straight = min(from_source[node], to_sink[node])
        if from_source[node] > straight:
            tie(source, node, from_source[node] - straight, 0)
        if to_sink[node] > straight:
            tie(node, sink, to_sink[node] - straight, 0)
    for a, b, capacity in ties:
        tie(a, b, capacity, capacity)

    while True:
        level = [-1] * (count + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            node = queue.popleft()
            for edge in links[node]:
                if room[edge] and level[heads[edge]] < 0:
                    level[heads[edge]] = level[node] + 1
                    queue.append(heads[edge])
        if level[sink] < 0:
            return [depth >= 0 for depth in level[:count]]
        place = [0] * (count + 2)
        path: list[int] = []
        node = source
        while True:
            if node == sink:
                flow = min(room[edge] for edge in path)
                for edge in path:
                    room[edge] -= flow
                    room[edge ^ 1] += flow
                cut = next(i for i, edge in enumerate(path) if room[edge] == 0)
                node = heads[path[cut] ^ 1]
                del path[cut:]
                continue
            while place[node] < len(links[node]):
                edge = links[node][place[node]]
                if room[edge] and level[heads[edge]] == level[node] + 1:
                    path.append(edge)
                    node = heads[edge]
                    break
                place[node] += 1
            else:
                if not path:
                    break
                node = heads[path.pop() ^ 1]
                place[node] += 1


def content_blocks(html: str) -> list[str]:
    """The texts of the blocks labelled content, in page order."""
    blocks = read_blocks(html)
    scores = [int(score(block) * SCALE) for block in blocks]
    kept = source_side(
        len(blocks),
        [max(s, 0) for s in scores],
        [max(-s, 0) for s in scores],
        smoothness(blocks),
    )
    return [block.text for block, content in zip(blocks, kept, strict=True) if content]


def extract(
    pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html"
) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_blocks``, the number of blocks in the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, "html"):
            found = [content_blocks(html) for html in texts]
            yield as_batch(
                {
                    "page_id": part.column("page_id"),
                    "url": part.column("url"),
                    "text": pa.array(["\n\n".join(blocks) for blocks in found], pa.string()),
                    "n_blocks": pa.array([len(blocks) for blocks in found], pa.int32()),
                }
            )

    kind = pages.schema[id_column].dataType.simpleString()
    return pages.select(
        pages[id_column].alias("page_id"),
        pages[url_column].cast("string").alias("url"),
        pages[html_column].cast("string").alias("html"),
    ).mapInArrow(run, f"page_id {kind}, url string, text string, n_blocks int")
