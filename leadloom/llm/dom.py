"""A forgiving HTML reader: element tree, text blocks and the marks of boilerplate."""

from __future__ import annotations

import re
import sys
from dataclasses import dataclass, field
from html import unescape

from pyspark import cloudpickle

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup; all but these two are dropped with their content.
RAW = frozenset("script style textarea title noscript xmp iframe noembed noframes template svg".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary "
    "table tbody td tfoot th thead tr ul".split()
)
#: An element of the left kind ends an open one of the right kinds.
ENDS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"),
    "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tr", "td", "th", "thead", "tbody"),
    "thead": ("tr", "td", "th"), "tfoot": ("tr", "td", "th", "tbody"),
}
#: Open elements beyond which an end tag or an implied end does not look.
BARRIERS = frozenset("table ul ol dl article section div body html main aside nav header footer form".split())
BOILER_TAGS = frozenset(
    "nav footer aside form button select dialog menu script style noscript template iframe svg textarea title "
    "head object canvas audio video datalist".split()
)
#: Words of class, id and role that mark what is not the article.
BOILER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox banner sponsor sponsored promo promotion "
    "cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription paywall "
    "sidebar widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs masthead topbar toolbar "
    "footer colophon copyright comment comments reply replies respond disqus discussion related recommended "
    "recommendations share sharing social login signin signup search searchbox pagination pager skip "
    "complementary contentinfo alert alertdialog".split()
)
HEADERS = frozenset(("header", "banner"))
#: Elements that their class, id and role do not mark.
PLAIN = frozenset(("html", "body", "main", "article"))
#: An element marked by its words alone that holds so much of the text that no element marks is not marked.
MOST = 0.9
ARTICLES = frozenset(("article", "main"))
#: Nesting beyond which elements are put beside each other.
DEEPEST = 150

_TAG = re.compile(
    r"<(?:!--.*?(?:--!?>|\Z)|![^>]*>|\?[^>]*>|(/?)([a-zA-Z][^\s/>]*)"
    r"([^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*|[^>]*)>)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@dataclass(slots=True)
class Element:
    tag: str
    label: str
    parent: Element | None
    depth: int
    boiler: bool
    article: int
    block: int
    link: bool
    worded: Element | None = None  #: the nearest element, itself included, that words alone mark
    children: list = field(default_factory=list)


@dataclass(slots=True)
class Text:
    """A text node: its place among the page's text nodes, block, and the marks it inherits."""

    value: str
    place: int
    block: int
    boiler: bool
    article: int
    link: bool
    blank: bool


def _marks(attributes: str) -> tuple[str, set[str]]:
    """Label part and words of class, id and role."""
    if "=" not in attributes:
        return "", set()
    kept, words = [], set()
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        if name.lower() in ("class", "id", "role"):
            value = unescape(a or b or c)
            kept.append(re.sub(r"\d+", "9", " ".join(sorted(value.split()))))
            words.update(w.lower() for w in _WORD.findall(value))
    return "|".join(kept), words


def read(html: str | None) -> tuple[Element, list[Text]]:
    """Tree and text nodes of a page; anything that is not well formed is read as browsers do.

    Text nodes of white space alone are listed but stand outside the tree. Null and empty pages are
    an empty tree.
    """
    root = Element("#root", "#root", None, 0, False, 0, 0, False)
    texts: list[Text] = []
    if not html:
        return root, texts
    here, blocks, articles, at, size = root, 0, 0, 0, len(html)
    worded: list[tuple[Text, Element]] = []

    def say(value: str) -> None:
        blank = value.isspace()
        node = Text(
            " " if blank else unescape(value) if "&" in value else value,
            len(texts), here.block, here.boiler, here.article, here.link, blank,
        )
        texts.append(node)
        if here.worded is not None and not node.boiler:
            worded.append((node, here.worded))
        if not blank:
            here.children.append(node)

    def leave(element: Element) -> Element:
        nonlocal blocks
        if element.tag in BLOCKS and element.parent is not None:
            blocks += 1
            element.parent.block = blocks
        return element.parent or element

    while at < size:
        found = _TAG.search(html, at)
        if found is None:
            say(html[at:])
            break
        if found.start() > at:
            say(html[at : found.start()])
        at = found.end()
        name = found.group(2)
        if name is None:
            continue
        name = name.lower()
        if found.group(1):
            up = here
            while up.parent is not None and up.tag != name:
                if up.tag in BARRIERS and name not in BARRIERS:
                    break
                up = up.parent
            if up.tag == name:
                while here is not up:
                    here = leave(here)
                here = leave(here)
            elif name in ("p", "br"):
                blocks += 1
                here.block = blocks
            continue
        if name in BLOCKS:
            up = here
            while up.parent is not None and up.tag != "p" and up.tag not in BARRIERS:
                up = up.parent
            if up.tag == "p":
                while here is not up:
                    here = leave(here)
                here = leave(here)
        for other in ENDS.get(name, ()):
            up = here
            while up.parent is not None and up.tag != other and up.tag not in BARRIERS:
                up = up.parent
            if up.tag == other:
                while here is not up:
                    here = leave(here)
                here = leave(here)
        attributes = found.group(3) or ""
        mark, words = _marks(attributes)
        if name in ("svg", "math") and attributes.rstrip().endswith("/"):
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(html, at)
            at = end.end() if end else at if name == "svg" else size
            continue
        if name in VOID:
            if name == "br":
                say(" ")
            elif name == "hr":
                blocks += 1
                here.block = blocks
            continue
        boiler = here.boiler or name in BOILER_TAGS or not here.article and name in HEADERS
        marked = name not in PLAIN and (words & BOILER_WORDS or not here.article and words & HEADERS)
        article = here.article
        if name in ARTICLES or "main" in words and "role" in attributes:
            rank = 2 if name == "article" else 1
            article = max(article, rank)
        if name in BLOCKS:
            blocks += 1
        parent = here if here.depth < DEEPEST else here.parent
        element = Element(
            name, f"{name}#{mark}" if mark else name, parent, parent.depth + 1, boiler, article,
            blocks if name in BLOCKS else here.block, here.link or name == "a", here.worded,
        )
        if marked:
            element.worded = element
        parent.children.append(element)
        here = element
    _mark(texts, worded)
    return root, texts


def _mark(texts: list[Text], worded: list[tuple[Text, Element]]) -> None:
    """Mark the texts inside elements that words mark, unless such an element holds most of the page."""
    held: dict[int, int] = {}
    for text, inner in worded:
        element = None if text.blank else inner
        while element is not None:
            held[id(element)] = held.get(id(element), 0) + len(text.value)
            element = element.parent and element.parent.worded
    least = MOST * sum(len(t.value) for t in texts if not t.boiler and not t.blank)
    for text, inner in worded:
        element = inner
        while element is not None and held.get(id(element), 0) >= least > 0:
            element = element.parent and element.parent.worded
        text.boiler = element is not None


def block_text(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


cloudpickle.register_pickle_by_value(sys.modules[__name__])
