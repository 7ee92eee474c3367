"""Main text of web pages by tree scoring.

A tolerant parser builds a tree without scripts, menus, adverts and the like.  Each paragraph passes points for its
length and commas to its ancestors, halved at each step; a container's points are discounted by the share of its text
that stands in links.  The best container is kept, with those siblings that score near it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import reachable

# Element names of the HTML standard by their role here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
SKIPPED = frozenset("nav footer aside form script style noscript template iframe head title button select option input textarea label fieldset dialog menu svg math canvas object audio video map datalist".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCKS - frozenset("td th tr tbody thead tfoot body html option".split())
PARAGRAPHS = frozenset("p pre blockquote td li dd h1 h2 h3 h4 h5 h6".split())
# Words in class, id and role that mark what is no article.
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar aside menu nav navbar navigation breadcrumb "
    "breadcrumbs footer masthead comment comments disqus respond reply replies cookie cookies consent gdpr notice notification alert popup modal overlay "
    "newsletter subscribe subscription signup share sharing social related recommended pagination pager toolbar topbar widget complementary contentinfo search disclaimer copyright".split()
)
# Words that only say what kind of part such a word names.
KINDS = frozenset(
    "area article articles bar block body bottom box button buttons card container content entry feed footer form group header heading holder inner item items left "
    "link links list main more module outer panel post posts right row section slot space stories story tab tags text title top unit wrap wrapper zone".split()
)
# Words before such a word that tell of the page, not the element; words that make a header one of an article.
ABOUT_PAGE = frozenset("has with without no not hide show".split())
OF_ARTICLE = frozenset("article entry post story content headline".split())
# Elements that are part of what surrounds them, never an article by themselves.
PARTS = frozenset("ul ol dl table tbody thead tr blockquote figure pre p li dd td h1 h2 h3 h4 h5 h6".split())

_MARKUP = re.compile(
    r"<!--(?:>|->|.*?--!?>|.*\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)(?:>|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_SPACE = re.compile(r"\s+")
_SENTENCE = re.compile(r"[.!?…:;][\"'”’»)\]]*$")


class Node:
    __slots__ = ("tag", "parent", "children", "skip", "block", "score", "length", "linked", "good", "within", "kept", "doubt")

    def __init__(self, tag: str, parent: Node | None, skip: bool = False):
        self.tag, self.parent, self.skip = tag, parent, skip
        self.children: list = []  # nodes and text runs, in page order
        self.block = tag in BLOCKS
        self.score = 0.0
        self.length = self.linked = 0
        self.good = tag in ("article", "main")
        self.within = self.good or parent is not None and parent.within  # a marked article or something in one
        self.kept = self.doubt = False


def _unwanted(tag: str, attributes: str, within: bool) -> bool | None:
    """Whether an element is no part of an article; None where its links must tell.

    Within a marked article a name like ``related-work`` does not decide, only one whose every word says the same.
    """
    doubt = False
    if tag in SKIPPED or tag == "header" and not within:
        return True
    if not attributes:
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE):
                return True
        elif tag not in ("html", "body"):
            words = [w.lower() for w in _WORD.findall(value)]
            if any(w in BOILERPLATE and (i == 0 or words[i - 1] not in ABOUT_PAGE) for i, w in enumerate(words)):
                names = [[w.lower() for w in _WORD.findall(x)] for x in value.split()]
                if not within or any(BOILERPLATE.intersection(n) and (BOILERPLATE | KINDS).issuperset(n) for n in names):
                    return True
                doubt = True
            if "header" in words and not within and not OF_ARTICLE.intersection(words):
                return True
    return None if doubt else False


def parse(html: str) -> list[Node]:
    """A tree of what the page shows; what :func:`_unwanted` names is marked, with all below it.  Nodes in page order."""
    root = now = Node("#", None)
    nodes = [root]
    open_: Counter[str] = Counter()  # of each tag, how many of its elements hold the place read now
    at = 0
    while at < len(html):
        m = _MARKUP.search(html, at)
        if m is None:
            now.children.append(html[at:])
            break
        if m.start() > at:
            now.children.append(html[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            up = now if open_[tag] else root
            while up.parent is not None and up.tag != tag:
                if tag not in BLOCKS and up.block:  # the end of a line element does not end a block
                    up = root
                    break
                up = up.parent
            if up.parent is not None:
                now = _closed(now, up.parent, open_)
            continue
        if tag in CLOSES_P or tag in ("li", "dd", "dt", "option", "tr", "td", "th"):
            ends = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}.get(tag, ())
            stop = {"li": ("ul", "ol", "menu"), "dd": ("dl",), "dt": ("dl",), "option": ("select",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}.get(tag, ())
            up = now
            while up.parent is not None and up.tag not in stop:
                if up.tag in ends or up.tag == "p" and tag in CLOSES_P:
                    now = _closed(now, up.parent, open_)
                    if up.tag == "p" or tag != "tr":
                        break
                elif up.block and not ends:
                    break
                up = up.parent
        unwanted = _unwanted(tag, m[3], now.within)
        node = Node(tag, now, now.skip or unwanted is True)
        node.doubt = unwanted is None
        now.children.append(node)
        nodes.append(node)
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}[^>]*>", re.IGNORECASE).search(html, at)
            at = end.end() if end else len(html)
        elif tag not in VOID:
            now = node
            open_[tag] += 1
    return nodes


def _closed(now: Node, to: Node, open_: Counter[str]) -> Node:
    while now is not to:
        open_[now.tag] -= 1
        now = now.parent
    return to


def blocks(node: Node) -> list[tuple[str, Node, int]]:
    """Texts of blocks below ``node`` in page order: text, innermost block element, characters of it in links."""
    out: list[tuple[str, Node, int]] = []
    held: list[str] = []
    links = 0
    owner = node

    def flush() -> None:
        nonlocal links
        if held:
            text = _SPACE.sub(" ", unescape("".join(held))).strip()
            if text:
                out.append((text, owner, min(links, len(text))))
            held.clear()
        links = 0

    todo: list[tuple] = [(node, None, 0)]
    while todo:
        item, back, linked = todo.pop()
        if isinstance(item, str):
            held.append(item)
            links += linked * len(item.strip())
        elif item is None:
            flush()
            owner = back
        elif not item.skip:
            if item.block and item is not node:
                flush()
                todo.append((None, owner, 0))
                owner = item
            if item.tag in ("br", "img", "input", "hr"):
                held.append(" ")
            linked = linked or item.tag == "a"
            todo += [(c, None, linked) for c in reversed(item.children)]
    flush()
    return out


def extract(html: str) -> str:
    """The article of a page, one block a line; empty if the page shows no text."""
    nodes = parse(html)
    found = blocks(nodes[0])
    if not found:
        return ""
    for text, owner, linked in found:
        paragraph = owner.tag in PARAGRAPHS
        points = 1 + text.count(",") + min(len(text) / 100, 3) if paragraph or len(text) >= 25 else 0.2
        start = owner.parent if paragraph else owner
        start.score += points
        owner.length += len(text)
        owner.linked += linked
    for node in reversed(nodes[1:]):  # children before parents
        node.parent.score += node.score / 2
        node.parent.length += node.length
        node.parent.linked += node.linked

    def worth(n: Node) -> float:
        return n.score * (1 - n.linked / max(1, n.length)) * (1.5 if n.good else 1.0)

    best = max(nodes, key=worth)
    if best.within:  # a section of a marked article stands for the article
        while not best.good or best.parent.within:
            best = best.parent
    while best.tag in PARTS and not best.parent.skip:
        best = best.parent
    best.kept = True
    beside: set[int] = set()  # texts of no element of their own beside the best container
    if best.parent is not None and not best.good:
        own: dict[int, list[str]] = {}
        for i, (text, owner, linked) in enumerate(found):
            top = owner
            while top.parent is not None and top.parent is not best.parent:
                top = top.parent
            if top.parent is best.parent:
                own.setdefault(id(top), []).append(text)
            elif owner is best.parent and not linked and _said([text]):
                beside.add(i)
        bar = 0.2 * worth(best)
        for near in best.parent.children:
            if isinstance(near, Node) and not near.skip and near.length:
                dense = near.linked / near.length
                plain = near.tag in PARAGRAPHS and dense < 0.25 or dense == 0 and _said(own.get(id(near), []))
                near.kept = near.kept or plain or dense < 0.5 and worth(near) >= bar
    for node in nodes[1:]:
        node.kept = node.kept or node.parent.kept
        if node.doubt and node.linked > node.length / 2:
            node.kept = False
    return "\n".join(text for i, (text, owner, _) in enumerate(found) if owner.kept or i in beside)


def _said(texts: list[str]) -> bool:
    """Whether there is a sentence among texts, not names or labels alone, and none that claims a copyright."""
    return any(_SENTENCE.search(t) or len(t) > 80 for t in texts) and not any("©" in t for t in texts)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(x.as_py()) for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every page.

    Null or blank html gives an empty text, never null; repeated rows give equal rows; an empty table none.  Among
    equal containers the first wins.  Pages of any length and depth are read whole, in time that grows with them.  Beside the
    best container all paragraphs stay that are not mostly links, and all else that holds a sentence and no link, or scores a fifth of
    it.  Other columns are not read.
    """
    reachable(pages.sparkSession)
    slim = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    kinds = dict(slim.dtypes)
    return slim.mapInArrow(_extracted, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
