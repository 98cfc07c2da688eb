"""Main text of web pages by tree scoring.

A tolerant reader turns a page into a tree of block elements and the runs of text in them.
Each paragraph outside menus and the like earns points for its length and its commas and
passes them to its ancestors: all to the first, half to the second, a quarter to the
third, and so on. An element's score is its points, with a head start for article-like
elements and names, discounted by link density. The best container is kept, or the article
around it, with those siblings that score well beside it, and what is boilerplate inside
them goes.

An element is boilerplate by its tag (menus, footers, forms ...), by being hidden, or by a
class, id or role that says so as a whole: every word of the name is one of fixed lists, and
one is a word for boilerplate. A name that only holds such a word among others costs points,
and its element goes only if it is mostly links.

The text is the kept blocks in page order, one a line: character references decoded, white
space within a block one space, ends trimmed.

Every step is linear in the page, whatever its nesting.

Edge cases: null or empty pages, and pages without main text, give the empty text.
Unclosed and misnested elements close as browsers would close them; a tag cut off by the
end of the page is no text. A `<` that opens no tag is text; a comment that is never closed
ends at the next tag; a script or style that is never closed takes the rest of the page. A
form around more than half of the prose is no form. Ties go to the earlier element.
Repeated rows are extracted each. Other columns are ignored. Pages are read whole.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_OPEN = re.compile(r"<([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\"<>])*+)>|<([a-zA-Z][a-zA-Z0-9:-]*)([^<>]*)>")
_CLOSE = re.compile(r"</([a-zA-Z][a-zA-Z0-9:-]*)[^<>]*>")
_OTHER = re.compile(r"<(?:[!?]|/[^<>a-zA-Z])[^<>]*>?")
_UNCLOSED = re.compile(r"<!--[^<>]*>?")
#: A tag that the end of the page cuts off: only its last attribute may lack a value.
_CUT_OFF = re.compile(r"</?(?:[a-zA-Z][a-zA-Z0-9:-]*(?:\s+[\w:@-]+\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'<>]+))*+(?:\s+[\w:@-]*(?:\s*=\s*(?:\"[^\"]*|'[^']*)?)?)?)?\s*/?\Z")
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'<>]+)))?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[^\W\d_a-zA-Z]+")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in "script style noscript template textarea iframe svg select object canvas".split()}
_BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_DROPPED = frozenset("nav footer aside button head title menu dialog fieldset".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog menu menubar toolbar form".split())
#: Words for boilerplate in names; words that may stand beside them without telling anything; words for articles.
_JUNK = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus foot footer gdpr login"
    " masthead menu modal nav navbar navigation newsletter notice pager pagination popup promo promos promotion related replies reply respond search share sharing"
    " sidebar side signup social sponsor sponsored subscribe subscription tags toolbar topbar widget widgets".split()
)
_PLAIN = frozenset(
    "a site page main top bottom left right box wrap wrapper container list section area block bar button buttons link links inner outer global primary secondary"
    " post posts article articles header item items col column group row holder panel form thread media text content unit slot icons icon form the and".split()
)
_GOOD = frozenset("article body content entry story text post main page".split())
_HEAD_START = {"article": 30.0, "main": 20.0, "section": 5.0, "div": 5.0, "blockquote": 3.0, "td": 3.0, "body": 0.0}
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPES = ("ul", "ol", "dl", "table", "body", "html", "menu")
_COMMAS = re.compile("[,\u060c\u3001\uff0c]")
#: A sibling is kept from this share of the best score; a block of links from this link density is dropped, one with a
#: suspicious name from DOUBT; what a name is worth in points.
SIBLING, LINKS, DOUBT, NAME = 0.2, 0.5, 0.25, 25.0


class _Node:
    __slots__ = ("tag", "parent", "junk", "in_article", "worth", "points", "length", "linked", "prose", "order")

    def __init__(self, tag: str, parent: _Node | None, order: int):
        self.tag, self.parent, self.order = tag, parent, order
        self.in_article = tag in ("article", "main") or (parent is not None and parent.in_article)
        self.junk, self.worth, self.points = False, 0.0, 0.0
        self.length = self.linked = self.prose = 0

    def density(self) -> float:
        return self.linked / self.length if self.length else 0.0

    def score(self) -> float:
        return (self.points + self.worth + _HEAD_START.get(self.tag, -3.0)) * (1.0 - self.density())


class _Block:
    __slots__ = ("node", "parts", "linked", "text")

    def __init__(self, node: _Node):
        self.node, self.parts, self.linked, self.text = node, [], 0, ""


def _named(node: _Node, names: str) -> None:
    """Judges a node by the words of its class and id."""
    for name in names.split():
        words = {w.lower() for w in _WORDS.findall(name)}
        bad, rest = words & _JUNK, words - _JUNK
        if bad and rest <= _PLAIN:
            node.junk = True
        elif bad:
            node.worth -= NAME
        elif words & _GOOD:
            node.worth += NAME
    node.worth = max(-NAME, min(NAME, node.worth))


def _judged(node: _Node, rest: str) -> None:
    """Marks a node that is boilerplate by itself, and weighs its names."""
    up = node.parent
    outside = up is None or not up.in_article
    if node.tag in _DROPPED or (node.tag == "header" and outside):
        node.junk = True
        return
    if not rest or node.tag in ("html", "body"):
        return
    got = {a.lower(): b or c or d for a, b, c, d in _ATTRIBUTE.findall(rest)}
    if "hidden" in got or got.get("aria-hidden", "").lower() == "true" or _UNSEEN.search(got.get("style", "")):
        node.junk = True
    elif node.tag not in ("article", "main"):
        node.junk = got.get("role", "").lower() in _ROLES
        names = f"{got.get('class', '')} {got.get('id', '')}"
        if outside and re.fullmatch(r"(?:(?:site|page|main|top)[-_]?)?header|top-?bar", got.get("class", "") or got.get("id", ""), re.I):
            node.junk = True
        _named(node, names)


class _Reader:
    """Reads a page into nodes, parents first, and blocks of text."""

    def __init__(self) -> None:
        root = _Node("html", None, 0)
        self.nodes, self.blocks, self.stack = [root], [], [root]
        self.places: dict[str, list[int]] = {"html": [0]}
        self.current: _Block | None = None
        self.links = False

    def text(self, raw: str) -> None:
        if self.current is None:
            if not raw or raw.isspace():
                return
            self.current = _Block(self.stack[-1])
            self.blocks.append(self.current)
        self.current.parts.append(raw)
        if self.links:
            self.current.linked += len(raw)

    def _pop_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            self.places[self.stack.pop().tag].pop()

    def _last(self, tags: tuple[str, ...]) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def close(self, tag: str) -> None:
        if tag == "a":
            self.links = False
        elif tag == "br":
            self.text(" ")
        elif tag in _BLOCKS:
            self.current = None
            at = self._last((tag,))
            if at > 0:
                self._pop_to(at)

    def open(self, tag: str, rest: str) -> None:
        if tag == "a":
            self.links = True
        elif tag == "br":
            self.text(" ")
        elif tag in _BLOCKS:
            self.current = None
            top = self.stack[-1].tag
            if top == "p" or (top in _HEADINGS and tag in _HEADINGS):
                self._pop_to(len(self.stack) - 1)
            closes = _CLOSES.get(tag)
            if closes:
                at = self._last(closes)
                if at > self._last(("table",) if tag == "tr" else _SCOPES):
                    self._pop_to(at)
            if self.stack[-1].tag == "head" and tag != "title":
                self._pop_to(len(self.stack) - 1)
            if tag == "html":
                return
            node = _Node(tag, self.stack[-1], len(self.nodes))
            _judged(node, rest)
            self.nodes.append(node)
            if tag not in _VOID:
                self.places.setdefault(tag, []).append(len(self.stack))
                self.stack.append(node)

    def read(self, page: str) -> None:
        at, size = 0, len(page)
        last_comment = page.rfind("-->")
        endless: set[str] = set()
        while at < size:
            k = page.find("<", at)
            if k < 0:
                self.text(page[at:])
                break
            if k > at:
                self.text(page[at:k])
            at = self._tag(page, k, last_comment, endless)

    def _tag(self, page: str, k: int, last_comment: int, endless: set[str]) -> int:
        """Takes what begins with the `<` at k, and returns where it ends."""
        if page.startswith("<!--", k):
            return page.find("-->", k + 4) + 3 if last_comment >= k + 4 else _UNCLOSED.match(page, k).end()
        found = _OPEN.match(page, k)
        if found:
            tag = (found[1] or found[3]).lower()
            if tag in _RAW and tag not in endless:
                end = _RAW[tag].search(page, found.end())
                if end:
                    return end.end()
                if tag in ("script", "style"):
                    return len(page)
                endless.add(tag)
            self.open(tag, found[2] or found[4] or "")
            return found.end()
        found = _CLOSE.match(page, k)
        if found:
            self.close(found[1].lower())
            return found.end()
        found = _OTHER.match(page, k)
        if found:
            return found.end()
        if page.find("<", k + 1) < 0 and _CUT_OFF.match(page, k):
            return len(page)
        self.text("<")
        return k + 1


def scored(reader: _Reader) -> tuple[list[_Node], list[_Block]]:
    """The nodes with their points, lengths and link lengths, and the blocks that are no boilerplate."""
    nodes, blocks = reader.nodes, reader.blocks
    for block in blocks:
        block.text = " ".join(html.unescape("".join(block.parts)).split())
        block.node.prose += 0 if block.node.tag == "li" else len(block.text) - min(block.linked, len(block.text))
    for node in reversed(nodes):
        if node.parent is not None and not node.junk:
            node.parent.prose += node.prose
    for node in nodes:
        form = node.tag == "form" and 2 * node.prose <= nodes[0].prose
        node.junk = node.junk or form or (node.parent is not None and node.parent.junk)
    blocks = [b for b in blocks if b.text and not b.node.junk]
    for block in blocks:
        block.node.length += len(block.text)
        block.node.linked += min(block.linked, len(block.text))
    for block in [b for b in blocks if b.node.tag != "li" and b.node.tag not in _HEADINGS] or blocks:
        holder = block.node if block.node.tag in _HEAD_START else block.node.parent
        (holder or block.node).points += 1.0 + len(_COMMAS.findall(block.text)) + min(len(block.text) / 100.0, 3.0)
    for node in reversed(nodes):
        if node.parent is not None:
            node.parent.length += node.length
            node.parent.linked += node.linked
            node.parent.points += node.points / 2
    return nodes, blocks


def extract(page: str | None) -> str:
    """The main text of one page."""
    if not page:
        return ""
    reader = _Reader()
    reader.read(page)
    nodes, blocks = scored(reader)
    if not blocks:
        return ""
    holders = [n for n in nodes if n.points and not n.junk]
    best = max(holders, key=lambda n: (n.score(), -n.order)) if holders else nodes[0]
    best = _around(best)
    bound = max(10.0, SIBLING * best.score())
    kept = {best}
    for node in nodes:
        if node.parent is best.parent and node is not best and not node.junk and node.length:
            text_like = node.tag in ("p", "pre", "blockquote") and node.length > 80 and node.density() < DOUBT
            if text_like or (node.points and node.score() >= bound):
                kept.add(node)
    inside = set()
    for node in nodes:
        if node in kept or (node.parent in inside and not _links(node)):
            inside.add(node)
    return "\n".join(b.text for b in blocks if b.node in inside)


def _around(best: _Node) -> _Node:
    """The outermost article, or else main element, around the best container; or else its parents, while they are prose too."""
    up, article, main = best, None, None
    while up is not None:
        article, main = up if up.tag == "article" else article, up if up.tag == "main" else main
        up = up.parent
    if article or main:
        return article or main
    while best.parent is not None and best.parent.tag in ("div", "section", "td", "center") and best.parent.worth >= 0 and best.parent.density() < DOUBT:
        best = best.parent
    return best


def _links(node: _Node) -> bool:
    """A block of links, or one that is partly links and has a suspicious name."""
    return node.tag in ("ul", "ol", "div", "section", "table", "dl") and node.density() > (DOUBT if node.worth < 0 else LINKS)


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) for every page."""
    kinds = [pages.schema[c].dataType.simpleString() for c in (page_id, url)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                batch = whole.slice(lo, 500)
                texts = [extract(x) for x in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(page).alias("html"))
    return rows.mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
