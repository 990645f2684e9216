"""The main text of web pages by scores over the element tree.

A page is read into a tree as browsers do, with elements closed where HTML implies it. Parts that by their kind, role or name are no article go first.
Each paragraph then gives points for its length and commas to the containers above it, less at each step; a
container's points are discounted by the share of its text that stands in links. The best one is kept, with those of its siblings that read
like parts of the same text, and its blocks are written in page order.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlpit.llm import arrow

# Elements of HTML by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe xmp noembed noframes".split())
#: Their content is no text of the page.
DROPPED = frozenset("head script style title textarea noscript template iframe xmp noembed noframes nav header footer aside form button select option datalist menu dialog svg math canvas audio video object applet map fieldset input label".split())
BLOCKS = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead caption tr ul".split()
)
#: Blocks of text proper, whose points go to what holds them.
PARAGRAPHS = frozenset("p pre blockquote li dd dt td th h1 h2 h3 h4 h5 h6 figcaption caption summary address".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
LISTS, CONTAINERS = frozenset("ul ol dl dir table".split()), frozenset("div section center details".split())
#: What an element's start closes, up to the elements that bound it.
CLOSES = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir".split())),
    "dt": (frozenset("dt dd".split()), frozenset(["dl"])),
    "dd": (frozenset("dt dd".split()), frozenset(["dl"])),
    "tr": (frozenset("tr td th".split()), frozenset(["table"])),
    "td": (frozenset("td th".split()), frozenset("tr table".split())),
    "th": (frozenset("td th".split()), frozenset("tr table".split())),
    "tbody": (frozenset("thead tbody tfoot tr td th caption".split()), frozenset(["table"])),
    "tfoot": (frozenset("thead tbody tfoot tr td th caption".split()), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset("select datalist".split())),
}
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar dialog alertdialog alert note".split())
#: Words in a class or id that name what is not the article.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay lightbox paywall subscribe subscription newsletter signup login nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toolbar sidebar sidebars sidenav aside rail widget widgets footer footnav header masthead topbar related recommended recommendations share sharing social search comment comments commentlist reply replies respond disqus discussion discussions feedback form skip".split()
)
COMMENTS = frozenset("comment comments commentlist reply replies respond disqus discussion discussions".split())
#: Elements that hold the article by definition.
HOLDERS = frozenset(["article", "main"])

TAG = re.compile(r"<(?:!--|!|\?|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|/?[a-zA-Z][^>]*>?)")
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
TELLING = re.compile("class|id|role|style|hidden", re.IGNORECASE)
NOT_SHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
COMMAS = re.compile("[,，、،]")

#: Shares of a paragraph's points that the containers above it get, from the nearest on.
SHARES = (1.0, 0.5, 0.25)
#: Points of a paragraph: one, one for each comma, and one for so many characters.
CHARACTERS = 100
#: Of the best container's score, what a sibling needs; and the link density at which a list is a menu.
SIBLING, MENU = 0.2, 0.8


class Node:
    """An element; ``parts`` are texts and elements in order."""

    __slots__ = ("name", "parent", "parts", "words", "gone", "points", "chars", "linked", "links", "holds")

    def __init__(self, name: str, parent: Node | None, words: frozenset, gone: bool):
        self.name, self.parent, self.words, self.gone = name, parent, words, gone
        self.parts: list[str | Node] = []
        self.points, self.chars, self.linked, self.links, self.holds = 0.0, 0, 0, 0, False


def _attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(source)}


def _element(name: str, source: str, parent: Node) -> Node:
    found = _attributes(source) if TELLING.search(source) else None
    if not found:
        return Node(name, parent, frozenset(), name in DROPPED)
    words = frozenset(w.lower() for w in WORD.findall(f"{found.get('class', '')} {found.get('id', '')}"))
    gone = name in DROPPED or "hidden" in found or found.get("role", "").lower() in ROLES or bool(NOT_SHOWN.search(found.get("style", "")))
    return Node(name, parent, words, gone)


def parse(page: str) -> Node:
    """The page's tree. Unknown or unclosed elements, stray ends and broken tags are taken as browsers take them, or nearly so."""
    root = Node("", None, frozenset(), False)
    stack, opened = [root], {}

    def close(upto: int) -> None:
        for node in stack[upto:]:
            opened[node.name] -= 1
        del stack[upto:]

    def text(raw: str) -> None:
        if raw:
            stack[-1].parts.append(html.unescape(raw) if "&" in raw else raw)

    at, size = 0, len(page)
    while at < size:
        m = TAG.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0] == "<!--":
                end = page.find("-->", at)
                at = size if end < 0 else end + 3
            elif m[0] in ("<!", "<?"):
                end = page.find(">", at)
                at = size if end < 0 else end + 1
            continue
        name = m[2].lower()
        if m[1]:
            if name == "br":
                text("\n")
            elif opened.get(name) and name not in ("html", "body"):
                k = len(stack) - 1
                while stack[k].name != name:
                    k -= 1
                close(k)
            continue
        if name in ("html", "body") and opened.get(name):
            continue
        if name in BLOCKS and opened.get("p"):
            k = len(stack) - 1
            while stack[k].name != "p":
                k -= 1
            close(k)
        if name in CLOSES:
            closed, bounds = CLOSES[name]
            if any(opened.get(c) for c in closed):
                k, last = len(stack) - 1, None
                while k > 0 and stack[k].name not in bounds:
                    last = k if stack[k].name in closed else last
                    k -= 1
                if last is not None:
                    close(last)
        node = _element(name, m[3], stack[-1])
        stack[-1].parts.append(node)
        if name in VOID:
            continue
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE).search(page, at)
            at = page.find(">", end.end()) + 1 or size if end else size
            continue
        if m[3].endswith("/") and name in ("svg", "math"):
            continue
        stack.append(node)
        opened[name] = opened.get(name, 0) + 1
    return root


def _all(root: Node) -> list[Node]:
    """Every element, those above before those below."""
    found, todo = [], [root]
    while todo:
        node = todo.pop()
        found.append(node)
        todo += [p for p in reversed(node.parts) if not isinstance(p, str)]
    return found


def _prune(nodes: list[Node]) -> None:
    """Marks what its name says is no article; wrappers around one are left, unless they are comments."""
    for node in reversed(nodes):
        if not node.gone and (node.holds or (node.name in HOLDERS and not node.words & COMMENTS)) and node.parent:
            node.parent.holds = True
    for node in nodes:
        if node.parent and node.parent.gone:
            node.gone = True
        elif node.words & NAMES and node.name not in ("", "html", "body"):
            node.gone = node.gone or bool(node.words & COMMENTS) or not (node.holds or node.name in HOLDERS)


def _measure(nodes: list[Node]) -> None:
    """Characters, linked ones and links of each element, without blanks and line ends and what is gone."""
    for node in reversed(nodes):
        if node.gone:
            continue
        node.chars += sum(len(p) - p.count(" ") - p.count("\n") for p in node.parts if isinstance(p, str))
        if node.name == "a":
            node.linked, node.links = node.chars, node.links + 1
        if node.parent:
            node.parent.chars += node.chars
            node.parent.linked += node.linked
            node.parent.links += node.links


def density(node: Node) -> float:
    return node.linked / node.chars if node.chars else 0.0


def _menus(nodes: list[Node]) -> None:
    """Marks lists of links, as lists or in a container of their own; an element's counts are left as they are."""
    for node in nodes:
        if node.parent and node.parent.gone:
            node.gone = True
        elif (node.name in LISTS and node.links >= 3 or node.name in CONTAINERS and node.links >= 2) and density(node) >= MENU and not node.holds:
            node.gone = True


def blocks(node: Node) -> Iterator[tuple[Node, str]]:
    """(block element, text) of each run of text below ``node`` between the borders of blocks, white space made one space."""
    holder = node
    while holder.name not in BLOCKS and holder.parent:
        holder = holder.parent
    found: list[str] = []
    todo: list[tuple[Node, int, Node]] = [(node, 0, holder)]
    while todo:
        own, k, block = todo.pop()
        if k == len(own.parts):
            if own.name in BLOCKS:
                if text := " ".join("".join(found).split()):
                    yield block, text
                found = []
            continue
        todo.append((own, k + 1, block))
        part = own.parts[k]
        if isinstance(part, str):
            found.append(part)
        elif part.name == "br":
            found.append("\n")
        elif part.name in BLOCKS:
            # what is gone is a border too
            if text := " ".join("".join(found).split()):
                yield block, text
            found = []
            if not part.gone:
                todo.append((part, 0, part))
        elif not part.gone:
            todo.append((part, 0, block))
    if text := " ".join("".join(found).split()):
        yield holder, text


def _score(root: Node) -> None:
    """Points of all containers: each paragraph's go to the three above it."""
    for block, text in blocks(root):
        node = block.parent if block.name in PARAGRAPHS and block.parent else block
        points = 1 + len(COMMAS.findall(text)) + len(text) / CHARACTERS
        points *= 1 - density(block) if block.name in PARAGRAPHS else 1
        for share in SHARES:
            if node is None:
                break
            node.points += share * points
            node = node.parent


def score(node: Node) -> float:
    return node.points * (1 - density(node))


def _best(nodes: list[Node]) -> list[Node]:
    """The best container and the siblings that belong to it; nothing for a page without text."""
    scored = [n for n in nodes if not n.gone and n.points > 0]
    if not scored:
        return []
    best = max(scored, key=score)
    holder, up = None, best
    while up:
        # an element that holds the article by definition, the outermost but one that holds the whole page's links too
        holder = up if up.name in HOLDERS and density(up) < 0.5 else holder
        up = up.parent
    if holder:
        best = holder
    while best.name in PARAGRAPHS | LISTS | {"tr", "tbody", "thead", "tfoot"} and best.parent:
        best = best.parent
    if not best.parent or best.name in ("", "html", "body"):
        return [best]
    least, kept, before = SIBLING * score(best), [], True
    for part in best.parent.parts:
        if part is best:
            kept.append(part)
            before = False
        elif not isinstance(part, str) and not part.gone and part.chars:
            texts = [t for _, t in blocks(part)]
            prose = part.name in ("p", "pre", "blockquote") and density(part) < 0.25 and any(len(t) >= 80 or t[-1] in ".!?…。" for t in texts)
            heading = before and part.name in HEADINGS
            if heading or prose or (part.name not in PARAGRAPHS and score(part) >= max(least, 1) and density(part) < 0.5):
                kept.append(part)
    return kept


def main_text(page: str) -> str:
    """The blocks of the page's main text, joined by newlines."""
    root = parse(page)
    nodes = _all(root)
    _prune(nodes)
    _measure(nodes)
    _menus(nodes)
    _score(root)
    return "\n".join(text for part in _best(nodes) for _, text in blocks(part))


def main_text_of(page: Column) -> Column:
    """Main text of a column of pages; null counts as empty. Each batch is taken page by page, so that a task holds one tree."""

    @F.arrow_udf("string")
    def extracted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield pa.array([main_text(t) for t in arrow.texts_of(column).to_pylist()], pa.string())

    return extracted(page)


def extract(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """``pages`` with the main text of each page in ``out_col``, which replaces a column of that name; all other columns stay.

    Null and empty pages, and pages without an article, have an empty text. Whole pages are read, however long; equal ones get equal texts, rows
    are neither lost nor reordered, and an empty table gives no rows. A ``br`` is white space within its block.
    """
    return pages.withColumn(out_col, main_text_of(F.col(f"`{html_col}`")))
