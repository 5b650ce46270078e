"""Blocks of visible text of a page, and what its markup says about each.

One pass over the tags keeps the open block elements; no tree is built. Broken markup is read much as browsers read it: a
block element ends an open paragraph, an end tag ends all that was opened since, and one that fits nothing is passed over.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

MARKED, OPEN, ARTICLE = 0, 1, 2
"""Furniture by its markup, undecided, and inside the article."""

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|</(?![a-zA-Z])[^>]*+>?"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?:(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|(?P<rest>[^>]*+)(?:>|\Z))",
    re.DOTALL,
)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_TELLING = re.compile(r"class|id|role|hidden|style", re.IGNORECASE)
_HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)

# Elements of the public HTML standard, by what they are.
RAW_TEXT = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary "
    "table caption thead tbody tfoot tr td th ul template noscript".split()
)
FURNITURE = frozenset(
    "nav header footer aside form menu dialog search button select datalist head noscript template svg math canvas object audio video map".split()
)
FURNITURE_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split()
)
# Words that pages use in class names and ids of what is not the article.
FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist "
    "consent cookie cookies disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices "
    "notification pager pagination popup promo promotion related replies respond share sharing sidebar social sponsor "
    "sponsored subscribe subscription toolbar widget widgets".split()
)
_NOT_AFTER = frozenset("with has no without not is".split())
_PART_OF_TEXT = frozenset("article entry post story content section chapter".split())
# An end tag is implied by the same or a kindred element, up to the list or table that both are in.
_IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
}


def _names_furniture(name: str) -> bool:
    parts = re.split(r"[-_]+", name.lower())
    if parts[0] in _NOT_AFTER:
        return False
    if parts[-1] in ("header", "footer") and parts[0] in _PART_OF_TEXT:
        return False
    return parts[0] in FURNITURE_WORDS or parts[-1] in FURNITURE_WORDS


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in reversed(list(_ATTR.finditer(text)))}


def _is_furniture(name: str, attrs: str) -> bool:
    if name in FURNITURE:
        return True
    if not _TELLING.search(attrs):
        return False
    found = _attributes(attrs)
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or _HIDDEN_STYLE.search(found.get("style", "")):
        return True
    if name in ("html", "body", "main"):
        return False
    if found.get("role", "").lower() in FURNITURE_ROLES:
        return True
    named = f"{found.get('class', '')} {found.get('id', '')}".split()
    if name == "article":
        return any(part in ("comment", "comments", "reply") for one in named for part in re.split(r"[-_]+", one.lower()))
    return any(_names_furniture(one) for one in named)


class _Page:
    """What is open while a page is read."""

    def __init__(self) -> None:
        # Name and state of each open element; the states are (furniture, inside article, inside main).
        self.open: list[tuple[str, tuple[bool, bool, bool]]] = []
        self.names: Counter = Counter()
        self.state = (False, False, False)
        self.pieces: dict[tuple[bool, bool, bool], list[str]] = {}
        self.blocks: list[tuple[tuple[bool, bool, bool], str]] = []

    def text(self, raw: str) -> None:
        if raw:
            self.pieces.setdefault(self.state, []).append(unescape(raw))

    def end_block(self) -> None:
        if self.pieces:
            for state, pieces in self.pieces.items():
                words = " ".join("".join(pieces).split())
                if words:
                    self.blocks.append((state, words))
            self.pieces = {}

    def push(self, name: str, furniture: bool, attrs: str) -> None:
        dropped, article, main = self.state
        # An article inside an article is a reader's comment or another text.
        self.open.append((name, self.state))
        self.names[name] += 1
        is_main = name == "main" or bool(re.search(r"role\s*=\s*[\"']?main\b", attrs, re.IGNORECASE))
        nested = name == "article" and article
        self.state = (dropped or furniture or nested, article or name == "article", main or is_main)

    def pop_to(self, names: set[str], stop: set[str] = frozenset()) -> None:
        """Close all up to the innermost open element of these names, if no element of ``stop`` is nearer."""
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] in names:
                self.state = self.open[i][1]
                for name, _ in self.open[i:]:
                    self.names[name] -= 1
                del self.open[i:]
                return
            if self.open[i][0] in stop:
                return

    def start(self, name: str, attrs: str) -> None:
        furniture = _is_furniture(name, attrs)
        if name in BLOCKS:
            self.end_block()
            if self.names["p"]:
                self.pop_to({"p"})
            if name in _IMPLIED:
                same, within = _IMPLIED[name]
                if any(self.names[n] for n in same):
                    self.pop_to(same, within)
        elif name == "br":
            self.text(" ")
        if name not in VOID and (name in BLOCKS or furniture):
            self.push(name, furniture, attrs)

    def end(self, name: str) -> None:
        if name in BLOCKS or name == "br":
            self.end_block()
        if self.names[name] and name not in ("html", "body"):
            self.pop_to({name})


def page_blocks(html: str | None) -> list[tuple[int, str]]:
    """``(kind, text)`` of each block with text, in page order; the kind is ``MARKED``, ``OPEN`` or ``ARTICLE``.

    Character references are decoded and white space is one space. Text inside ``article`` elements is the article, or
    inside ``main`` if the page has no article.
    """
    page, at = _Page(), 0
    html = html or ""
    while found := _TAG.search(html, at):
        page.text(html[at : found.start()])
        at = found.end()
        if not found["name"]:
            continue
        name, attrs = found["name"].lower(), found["attrs"] or found["rest"] or ""
        if found["end"]:
            page.end(name)
        elif name in RAW_TEXT:
            closing = re.compile(rf"</{name}(?=[\s/>])[^>]*+>?|</{name}\Z", re.IGNORECASE).search(html, at)
            at = closing.end() if closing else len(html)
        else:
            page.start(name, attrs)
    page.text(html[at:])
    page.end_block()
    has_article = any(article and not dropped for (dropped, article, _), _ in page.blocks)

    def kind(state: tuple[bool, bool, bool]) -> int:
        dropped, article, main = state
        return MARKED if dropped else ARTICLE if (article if has_article else main) else OPEN

    return [(kind(state), text) for state, text in page.blocks]
