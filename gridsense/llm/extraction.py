"""The main text of web pages, by a minimum cut between content and boilerplate.

A page is read into blocks of text, each below a path of elements. A linear classifier gives each block a score from its
elements' names, its links and its wording; positive scores are capacities from the content side, negative ones to the
boilerplate side. Blocks next to each other, and neighbours below one parent, are tied by edges that weaken with their distance in
the tree. A maximum flow finds the cheapest cut, and blocks on its content side are the text.

Pages are independent, so each task works through its own, one page at a time; Python's part is the parsing and the cut.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field as attribute
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsense.llm.base import columns, slices, text_of

# Names of HTML elements by what they mean for a reader.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
UNREAD = set("script style noscript template title svg iframe textarea select head object canvas math".split())
BLOCKS = set(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: What a start tag ends if it is open: an element of the first kind, unless one of the second was opened since.
CLOSES = {
    **{name: ({"p"}, {"button", "td", "th", "caption", "html"}) for name in BLOCKS - set("button caption legend summary td th tr tbody thead tfoot html body".split())},
    "li": ({"li", "p"}, {"ul", "ol", "menu", "td", "th"}),
    "dt": ({"dt", "dd", "p"}, {"dl", "td", "th"}),
    "dd": ({"dt", "dd", "p"}, {"dl", "td", "th"}),
    "tr": ({"tr", "td", "th", "p"}, {"table"}),
    "td": ({"td", "th", "p"}, {"table", "tr"}),
    "th": ({"td", "th", "p"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}),
}
#: Words in class and id names that tell of a part's purpose. Layout words may also name a frame around the whole page.
LAYOUT_WORDS = set("nav navbar navigation menu header masthead footer sidebar aside rail topbar bottombar toolbar breadcrumb breadcrumbs".split())
NOISE_WORDS = set(
    "ad ads adv advert advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
    "popup modal overlay newsletter subscribe subscription signup login comment comments disqus reply replies respond discussion share sharing "
    "social related recommended recommendations teaser pagination pager widget widgets copyright disclaimer skip search alert toast paywall".split()
)
CONTENT_WORDS = set("article content post entry story main body text prose maincontent articlebody".split())
FRAME_WORDS = set("has with no without".split())
NOISE_ROLES = set("navigation banner contentinfo complementary search alert dialog alertdialog menu menubar toolbar form".split())
NOISE_TEXT = re.compile(
    r"(?i)©|\ball rights reserved\b|\bcookies?\b|\bsubscribe\b|\bnewsletter\b|\bsign (?:up|in)\b|\blog ?in\b|\badvertisement\b|\bsponsored\b|\bprivacy policy\b|\bterms of (?:use|service)\b"
)
#: Scores in hundredths of a logarithmic odds ratio.
SCORES = {
    "nav": -800, "footer": -800, "aside": -800, "form": -800, "menu": -800, "dialog": -800, "search": -800, "button": -600,
    "header": -600, "fieldset": -600, "article": 400, "main": 300, "noise": -800, "layout": -800, "content": 200,
}
MOST_SUPPORT = 400
BIAS, PARAGRAPH, HEADING, PER_DOUBLING, SENTENCE, LINKED, NOISY, OUTSIDE = -50, 100, 60, 25, 50, 500, 450, 300
NEXT, SIBLING, ACROSS = 150, 100, 30
#: Elements nested deeper than this become siblings, as in browsers; their text stays.
MOST_DEPTH = 512

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S
)
UNENDED = re.compile(r"<[!?/a-zA-Z]")
ATTRIBUTE = re.compile(r"(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
HIDDEN = re.compile(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden")
SENTENCE_END = re.compile(r"[.!?…:;\"'”»)。！？]\s*$")


class Element:
    """An open or closed element: its hints, and the text found below it."""

    __slots__ = ("tag", "parent", "depth", "support", "against", "layout", "body", "plain")

    def __init__(self, tag: str, parent: Element | None):
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 0
        self.support = self.against = self.layout = 0
        self.body = False
        self.plain = 0


@dataclass
class TextBlock:
    element: Element
    text: str
    linked: int
    score: int = 0


def hints(element: Element, attributes: str) -> None:
    """What the element's name and attributes say for and against content."""
    tag = element.tag
    own = SCORES.get(tag, 0)
    within = element.parent
    if tag == "header":
        while within and not within.body:
            within = within.parent
        own = 0 if within else own
    words: set[str] = set()
    for name, *values in ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), next(filter(None, values), "")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and HIDDEN.search(value)):
            element.against += SCORES["noise"]
        elif name == "role":
            element.against += SCORES["noise"] if value.lower() in NOISE_ROLES else 0
            element.support += SCORES["main"] if value.lower() in ("main", "article") else 0
        elif name in ("class", "id") and tag not in ("html", "body"):
            for part in value.split():
                spelled = [w.lower() for w in WORD.findall(part)]
                whole = part.lower()
                words.update(spelled if not FRAME_WORDS & set(spelled) else ())
                words.add(whole)
    element.against += SCORES["noise"] if words & NOISE_WORDS else 0
    element.layout = SCORES["layout"] if words & LAYOUT_WORDS and not (tag == "header" and own == 0) else 0
    element.support += max(own, 0) + (SCORES["content"] if words & CONTENT_WORDS else 0)
    element.against += min(own, 0)
    element.body = tag in ("article", "main") and not words & NOISE_WORDS


def read(html: str) -> tuple[list[TextBlock], list[Element]]:
    """Blocks of text in page order, and all elements that hold blocks, parents first."""
    root = Element("html", None)
    stack, open_, elements = [root], Counter(html=1), [root]
    blocks: list[TextBlock] = []
    pieces: list[str] = []
    linked = 0

    def finish() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                owner = stack[-1]
                while owner.tag not in BLOCKS:
                    owner = owner.parent
                blocks.append(TextBlock(owner, text, linked))
            pieces.clear()
            linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        text = unescape(raw) if "&" in raw else raw
        pieces.append(text)
        if open_["a"]:
            linked += len(text) - text.count(" ")

    def pop_to(at: int) -> None:
        for element in stack[at:]:
            open_[element.tag] -= 1
        del stack[at:]

    at, end = 0, html.rfind(">") + 1
    while at < end:
        hit = TAG.search(html, at, end)
        if hit is None:
            break
        if hit.start() > at:
            add(html[at : hit.start()])
        at = hit.end()
        slash, name, rest = hit.group(1, 2, 3) if hit.group(2) else hit.group(4, 5, 6)
        if not name:
            continue
        tag = name.lower()
        if slash:
            if tag == "br":
                pieces.append(" ")
            if not open_[tag] or stack[-1] is root:
                continue
            if tag in BLOCKS:
                finish()
            place = next(i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == tag)
            if place:
                if tag not in BLOCKS and any(e.tag in BLOCKS for e in stack[place + 1 :]):
                    continue  # an inline end tag does not end blocks
                pop_to(place)
            continue
        if tag in VOID:
            if tag == "br":
                pieces.append(" ")
            elif tag == "hr":
                finish()
            continue
        if tag == "head":
            continue
        if tag in UNREAD:
            if not rest.endswith("/"):
                close = re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*>", re.I).search(html, at)
                at = close.end() if close else len(html)
            continue
        if tag in BLOCKS:
            finish()
        if tag in ("html", "body") and (tag == "html" or open_[tag]):
            continue
        ended, barrier = CLOSES.get(tag, ((), ()))
        if any(open_[t] for t in ended):
            last = None
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in barrier:
                    break
                if stack[i].tag in ended:
                    last = i
                    if not any(open_[t] for t in ended - {stack[i].tag}) and open_[stack[i].tag] == 1:
                        break
            if last is not None:
                pop_to(last)
        if len(stack) > MOST_DEPTH:
            pop_to(MOST_DEPTH)
        element = Element(tag, stack[-1])
        if tag in BLOCKS or rest:
            hints(element, rest)
        stack.append(element)
        open_[tag] += 1
        elements.append(element)
    if at < len(html):
        add(UNENDED.split(html[at:], maxsplit=1)[0])
    finish()
    return blocks, elements


def score(blocks: list[TextBlock], elements: list[Element]) -> None:
    """The classifier: each block's logarithmic odds of being content, in hundredths."""
    for block in blocks:
        letters = len(block.text) - block.text.count(" ")
        block.element.plain += max(letters - block.linked, 0)
    inside: dict[int, int] = {}  # text below articles and main parts, by element
    for element in reversed(elements):
        if element.parent:
            element.parent.plain += element.plain
    total = 0
    bodies = [e for e in elements if e.body and e.plain]
    for element in bodies:
        above = element.parent
        while above and not above.body:
            above = above.parent
        if above is None:
            total += element.plain
            above = element
            while above:
                inside[id(above)] = inside.get(id(above), 0) + element.plain
                above = above.parent
    sums: dict[int, tuple[int, int, bool]] = {}
    for element in elements:
        support, against, body = sums[id(element.parent)] if element.parent else (0, 0, False)
        frame = bool(total) and 2 * inside.get(id(element), 0) > total
        layout = 0 if frame and not element.body else element.layout
        sums[id(element)] = (support + element.support, against + element.against + layout, body or element.body)
    for block in blocks:
        support, against, body = sums[id(block.element)]
        letters = max(len(block.text) - block.text.count(" "), 1)
        words = block.text.count(" ") + 1
        found = BIAS + min(support, MOST_SUPPORT) + against + PER_DOUBLING * words.bit_length()
        tag = block.element.tag
        found += HEADING if tag in HEADINGS else PARAGRAPH if tag in ("p", "pre", "blockquote", "body", "html") else 0
        found += SENTENCE if SENTENCE_END.search(block.text) else 0
        found -= LINKED * block.linked // letters
        found -= NOISY if words < 60 and not body and NOISE_TEXT.search(block.text) else 0
        found -= OUTSIDE if total and not body else 0
        block.score = found


def ties(blocks: list[TextBlock]) -> list[tuple[int, int, int]]:
    """Edges between blocks next to each other, and between blocks that follow one another below one parent."""
    found = []
    previous: dict[int, int] = {}
    for i, block in enumerate(blocks):
        if i:
            found.append((i - 1, i, _weight(blocks[i - 1].element, block.element)))
        parent = block.element.parent or block.element
        before = previous.get(id(parent))
        if before is not None and not (block.element.against or block.element.layout or blocks[before].element.against):
            found.append((before, i, SIBLING))
        previous[id(parent)] = i
    return found


def _weight(one: Element, two: Element) -> int:
    """``NEXT`` for siblings, less with each further step in the tree, little where the way leads past a hint against."""
    steps, crossing = 0, False
    while one is not two:
        if one.depth >= two.depth:
            crossing |= bool(one.against or one.layout or one.body)
            one = one.parent
        else:
            crossing |= bool(two.against or two.layout or two.body)
            two = two.parent
        steps += 1
    return ACROSS if crossing else NEXT * 2 // max(steps, 2)


def content_side(scores: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """The smallest content side of a minimum cut.

    A node whose own capacity outweighs all its edges keeps its side in every such cut, so it is settled first and its edges
    become capacities of its neighbours; a maximum flow decides the rest.
    """
    size = len(scores)
    own, held = list(scores), [0] * size
    around: list[dict[int, int]] = [{} for _ in range(size)]
    for i, j, weight in edges:
        if i != j and weight:
            around[i][j] = around[i].get(j, 0) + weight
            around[j][i] = around[j].get(i, 0) + weight
            held[i] += weight
            held[j] += weight
    side: list[bool | None] = [None] * size
    waiting = deque(range(size))
    while waiting:
        i = waiting.popleft()
        if side[i] is not None or -held[i] < own[i] <= held[i]:
            continue
        side[i] = own[i] > held[i]
        for j, weight in around[i].items():
            if side[j] is None:
                own[j] += weight if side[i] else -weight
                held[j] -= weight
                waiting.append(j)
    rest = [i for i in range(size) if side[i] is None]
    if rest:
        number = {i: k for k, i in enumerate(rest)}
        links = [(number[i], number[j], w) for i in rest for j, w in around[i].items() if i < j and side[j] is None]
        for i, kept in zip(rest, _Flow([own[i] for i in rest], links).content(), strict=True):
            side[i] = kept
    return [bool(s) for s in side]


@dataclass
class _Flow:
    """Maximum flow by shortest layers; nodes 0 to n - 1, then the content side and the boilerplate side."""

    scores: list[int]
    links: list[tuple[int, int, int]]
    to: list[int] = attribute(default_factory=list)
    room: list[int] = attribute(default_factory=list)

    def __post_init__(self) -> None:
        size = len(self.scores)
        self.start, self.stop = size, size + 1
        self.out: list[list[int]] = [[] for _ in range(size + 2)]
        for i, value in enumerate(self.scores):
            if value > 0:
                self._arc(self.start, i, value, 0)
            elif value < 0:
                self._arc(i, self.stop, -value, 0)
        for i, j, weight in self.links:
            self._arc(i, j, weight, weight)

    def _arc(self, i: int, j: int, forth: int, back: int) -> None:
        for a, b, room in ((i, j, forth), (j, i, back)):
            self.out[a].append(len(self.to))
            self.to.append(b)
            self.room.append(room)

    def _layers(self) -> list[int]:
        layer = [-1] * len(self.out)
        layer[self.start] = 0
        queue = deque([self.start])
        while queue:
            i = queue.popleft()
            for arc in self.out[i]:
                j = self.to[arc]
                if self.room[arc] and layer[j] < 0:
                    layer[j] = layer[i] + 1
                    queue.append(j)
        return layer

    def content(self) -> list[bool]:
        while (layer := self._layers())[self.stop] >= 0:
            tried = [0] * len(self.out)
            way: list[int] = []
            i = self.start
            while True:
                if i == self.stop:
                    least = min(self.room[arc] for arc in way)
                    for arc in way:
                        self.room[arc] -= least
                        self.room[arc ^ 1] += least
                    full = next(k for k, arc in enumerate(way) if not self.room[arc])
                    i = self.to[way[full] ^ 1]
                    del way[full:]
                    continue
                arcs = self.out[i]
                while tried[i] < len(arcs):
                    arc = arcs[tried[i]]
                    if self.room[arc] and layer[self.to[arc]] == layer[i] + 1:
                        break
                    tried[i] += 1
                if tried[i] < len(arcs):
                    way.append(arcs[tried[i]])
                    i = self.to[arcs[tried[i]]]
                elif way:
                    i = self.to[way.pop() ^ 1]
                    tried[i] += 1
                else:
                    break
        return [depth >= 0 for depth in layer[: len(self.scores)]]


def main_text(html: str | None) -> str:
    """The page's main text: content blocks in page order, two line feeds between them."""
    blocks, elements = read(html or "")
    score(blocks, elements)
    kept = content_side([b.score for b in blocks], ties(blocks))
    return "\n\n".join(b.text for b, own in zip(blocks, kept, strict=True) if own)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``(key, url, text, n_chars)``, one row for each row of ``pages``.

    Null or empty html gives the empty text, as does a page without content. Pages of any length are read whole; tags that
    never end, unclosed elements and stray end tags are read as browsers do. White space is what Unicode takes as such, the
    no-break space included. Repeated rows and null keys or urls stay as they are, an empty table gives no rows, other columns are not
    looked at, and a block whose two sides cost the same is boilerplate.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = [main_text(page) for page in batch.column("html").to_pylist()]
            lengths = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("url"), pa.array(texts, pa.string()), lengths], ["key", "url", "text", "n_chars"]
            )

    named = pages.select(*columns(pages, key=key, url=url, html=html))
    rows = named.select(F.col("key").cast("long"), F.col("url").cast("string"), text_of("html").alias("html"))
    return rows.mapInArrow(work, "key long, url string, text string, n_chars long")
