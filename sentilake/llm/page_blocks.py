"""Blocks of text of an HTML page, with the marks of the elements around them."""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from dataclasses import dataclass, field

# --- fixed values: HTML element names by their role ---
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
#: Elements that show nothing where they stand.
UNSEEN = frozenset("script style noscript template".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag of the key ends an open element of these names.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr",), "td": ("td", "th"),
    "th": ("td", "th"),
}
#: Elements that such an implied end does not reach beyond.
SCOPES = frozenset("ul ol dl table select article main section div nav aside header footer form body html".split())

#: Kinds of page parts that are no article text, by element name, and by words of class, id and role.
PARTS_BY_TAG = {
    "head": "markup", "script": "markup", "style": "markup", "title": "markup", "noscript": "markup", "template": "markup",
    "iframe": "markup", "object": "markup", "svg": "markup", "canvas": "markup", "noembed": "markup", "noframes": "markup",
    "nav": "menu", "menu": "menu", "header": "header", "footer": "footer", "aside": "sidebar", "dialog": "notice",
    "form": "form", "button": "form", "select": "form", "textarea": "form", "fieldset": "form", "datalist": "form",
}
PARTS_BY_WORD = {
    "menu": "nav navbar navigation navigator menu menubar breadcrumb breadcrumbs pagination pager toc skip skiplink toolbar",
    "header": "header masthead topbar banner sitehead",
    "footer": "footer contentinfo copyright colophon",
    "sidebar": "sidebar aside complementary rail related recommended recommendations recirculation trending popular widget widgets",
    "notice": "notice notices cookie cookies consent gdpr alert popup modal dialog overlay paywall disclaimer toast",
    "advert": "ad ads adbox adslot adsense adunit advert adverts advertisement advertising advertorial sponsor sponsored sponsors promo promos promotion promoted",
    "form": "form search login signin signup register subscribe subscription newsletter contactform",
    "share": "share sharing social follow",
    "comment": "comment comments commentlist disqus reply replies respond discussion responses",
}
CONTENT_WORDS = frozenset("article articlebody content post entry story main text body prose".split())
#: Words that say how a page is laid out ("has-sidebar"), not what the element is.
LAYOUT_WORDS = frozenset("has no with without layout".split())
_PART_OF = {word: part for part, words in PARTS_BY_WORD.items() for word in words.split()}
PARTS = (*PARTS_BY_WORD, "markup")
#: Parts that end inside an article or main element: a page may stand in one form, an article has a header of its own.
PAGE_PARTS = frozenset(["form", "header"])

_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<rest>(?>=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)(?P<closed>>?)"
    r"|<[!?/][^>]*>?",
    re.S,
)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[a-z0-9]+")
_HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


@dataclass(slots=True)
class Block:
    """Text between two block-level tags, or up to where the parts around it change."""

    start: int
    tag: str
    parts: frozenset[str]
    in_article: bool
    in_content: bool
    runs: list[str] = field(default_factory=list)
    linked: int = 0

    def cut(self) -> bool:
        return bool(self.parts) and (self.in_article or self.in_content)

    def text(self) -> str:
        """Character references decoded, white space as one space, trimmed."""
        return " ".join(entities.unescape("".join(self.runs)).split())


@dataclass(slots=True)
class _Open:
    name: str
    parts: frozenset[str]
    in_article: bool
    in_content: bool

    def cut(self) -> bool:
        """A menu, advert and the like that stands within the article: it goes, but does not part what is around it."""
        return bool(self.parts) and (self.in_article or self.in_content)


def _marks(name: str, rest: str, outer: _Open) -> _Open:
    """The state inside an element, from that around it."""
    words: set[str] = set()
    if "=" in rest:
        for found in _ATTRIBUTE.finditer(rest):
            words.update(_WORD.findall(_HUMP.sub(" ", found[2] or found[3] or found[4] or "").lower()))
    parts, in_article = set(outer.parts), outer.in_article
    own = PARTS_BY_TAG.get(name)
    by_word = {_PART_OF[w] for w in words if w in _PART_OF}
    if name in ("article", "main"):
        in_article = True
        parts -= PAGE_PARTS
        by_word &= {"comment"}
    elif name in ("html", "body") or words & LAYOUT_WORDS:
        by_word = set()
    if own:
        by_word.add(own)
    if in_article:
        by_word.discard("header")
    return _Open(name, frozenset(parts | by_word), in_article, outer.in_content or bool(words & CONTENT_WORDS) and name != "body")


def parse(page: str) -> tuple[list[Block], list[tuple[int, str, int, bool]]]:
    """Blocks with text in page order, and all tags as (place, name, blocks before it, in a part within the content).

    A tag soup parser: an end tag closes up to the nearest open element of its name, one without such an element is nothing; a
    block-level start ends an open paragraph. Text of script and style, comments and cut-off tags is no text.
    """
    blocks: list[Block] = []
    tags: list[tuple[int, str, int, bool]] = []
    root = _Open("", frozenset(), False, False)
    stack = [root]
    names: Counter[str] = Counter()
    links = at = 0
    block: Block | None = None

    def say(start: int, end: int) -> None:
        nonlocal block
        run = page[start:end]
        if not run:
            return
        here = stack[-1]
        if block is not None and block.parts != here.parts:
            block = None
        if block is None:
            if run.isspace():
                return
            tag = next((e.name for e in reversed(stack) if e.name and e.name not in INLINE), "")
            block = Block(start, tag, here.parts, here.in_article, here.in_content)
            blocks.append(block)
        block.runs.append(run)
        if links:
            block.linked += len(run.split())

    def leave(depth: int) -> None:
        nonlocal links
        links -= sum(1 for e in stack[depth:] if e.name == "a")
        names.subtract(e.name for e in stack[depth:])
        del stack[depth:]

    while at < len(page):
        found = _TOKEN.search(page, at)
        if found is None:
            say(at, len(page))
            break
        say(at, found.start())
        at = found.end()
        name = (found["name"] or "").lower()
        if not name or not found["closed"]:
            continue
        tags.append((found.start(), name, len(blocks), stack[-1].cut()))
        if name not in INLINE and name not in UNSEEN:
            block = None
        if found["end"]:
            # Names that are not open are not looked for, so that no page costs the square of its tags.
            for depth in range(len(stack) - 1, 0, -1) if names[name] else ():
                if stack[depth].name == name:
                    leave(depth)
                    break
                if name in INLINE and stack[depth].name not in INLINE:
                    break
            continue
        if name in VOID:
            continue
        if name not in INLINE:
            closes = [n for n in (*CLOSES.get(name, ()), "p") if names[n]]
            for depth in range(len(stack) - 1, 0, -1) if closes else ():
                if stack[depth].name in closes:
                    leave(depth)
                    break
                if stack[depth].name in SCOPES:
                    break
        if name in RAW:
            at = re.compile(rf"</{name}(?=[\s/>])[^>]*>?|\Z", re.I).search(page, at).end()
            continue
        stack.append(_marks(name, found["rest"], stack[-1]))
        names[name] += 1
        links += name == "a"
    return blocks, tags
