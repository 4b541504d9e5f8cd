"""Reading one page: elements with their paths and roles, text with its place."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import xxhash

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>"
    r"|<(?P<end>/?)(?P<name>[a-z][a-z0-9:-]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|</?[a-z][^>]*>|<[!?][^>]*>", re.S | re.I)
_ATTR = re.compile(r"([^\s=/>\"']+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SELF_CLOSED = re.compile(r"(?:^|[\s\"'])/\s*$")
#: Elements whose content is no text of the page, and those of them that run to the end of the page if never closed.
_RAW = {"script", "style", "noscript", "template", "svg", "iframe", "textarea", "select", "object", "canvas"}
_RAW_TO_END = {"script", "style", "textarea"}
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in sorted(_RAW)}
_VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr", "param"}
_BLOCK = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main",
    "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul", "caption",
}
#: Elements that end an open one of the given kind, and those that keep it apart.
_CLOSES = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
           "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"}),
           "option": ({"option"}, {"select"})}
_SCOPE = {"article", "aside", "body", "div", "footer", "form", "header", "html", "li", "main", "nav", "section", "table",
          "td", "th", "blockquote", "dd", "figure", "fieldset", "details"}
#: Elements, and words in classes, ids and roles, that mark what is not the article.
_ASIDE_TAGS = {"nav", "footer", "aside", "form", "button", "dialog", "menu", "head", "fieldset", "label"}
_ASIDE_WORDS = set("""
    ad ads advert advertisement advertising adbox banner breadcrumb breadcrumbs byline comment comments contentinfo
    complementary consent cookie cookies copyright dialog disqus footer form gdpr header legal login masthead menu modal
    nav navbar navigation newsletter notice notices outbrain pager pagination popup promo recommend recommended related
    respond search share sharing sidebar signup skip social sponsor sponsored subscribe taboola tags toolbar widget
""".split())
#: Words that say where or in what form something stands, so that they leave an aside word its meaning.
_LAYOUT_WORDS = set("""
    area bar block bottom box btn button buttons col column container fixed form icon icons inner item items left link links
    list main page panel right row section site slot sticky top widget wrap wrapper
""".split())
#: Aside words that name a part of an article when they stand inside one.
_ARTICLE_PARTS = {"header", "masthead"}
_ASIDE_ARTICLES = {"ad", "comment", "comments", "promo", "related"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_WHOLE = {"article", "main", "section", "div", "td", "body"}
#: Share of a page's article text from which an article or main element is its container.
NEARLY = 0.9


@dataclass
class Element:
    tag: str
    parent: int
    path: int
    aside: bool
    article: bool
    link: bool
    depth: int
    at: int
    mass: int = 0


@dataclass
class Page:
    elements: list[Element] = field(default_factory=list)
    #: element, text with character references decoded, hash of its path and words, number of the block it is in
    texts: list[tuple[int, str, int, int]] = field(default_factory=list)


def _hash(*parts: object) -> int:
    return xxhash.xxh3_64_intdigest("\0".join(map(str, parts)).encode("utf-8", "surrogatepass")) - (1 << 63)


def attributes(source: str) -> dict[str, str]:
    """Class, id and role of a tag, in lower case; the first of a name holds."""
    found: dict[str, str] = {}
    for a in _ATTR.finditer(source):
        name = a.group(1).lower()
        if name in ("class", "id", "role"):
            found.setdefault(name, (a.group(2) or a.group(3) or a.group(4) or "").lower())
    return found


def aside_words(marks: dict[str, str]) -> set[str]:
    """Aside words of the marks: only names made of nothing but aside and layout words count."""
    found: set[str] = set()
    for name in " ".join(marks.values()).split():
        words = {w for w in re.split(r"[^a-z]+", name) if w}
        if words <= _ASIDE_WORDS | _LAYOUT_WORDS:
            found |= words & _ASIDE_WORDS
    return found


def is_aside(name: str, up: Element, words: set[str]) -> bool:
    """Whether an element below ``up`` holds something else than the article."""
    if name in ("main", "body", "html"):
        return up.aside and name != "main"  # an element before the main part was never closed
    if up.aside or name in _ASIDE_TAGS:
        return True
    if name == "article":
        return bool(words & _ASIDE_ARTICLES)
    if up.article:
        return bool(words - _ARTICLE_PARTS)
    return name == "header" or bool(words)


def read_page(source: str) -> Page:
    """Elements and texts in page order; unclosed and stray tags are taken as browsers take them.

    Elements closed in their own tag are empty.  Elements without text of the page (``_RAW``) are left out up to
    their end tag; without one, scripts, styles and text areas run to the end and of the others only the tag goes.
    """
    page = Page([Element("#", -1, 0, False, False, False, 0, 0)])
    stack, block, at = [0], 0, 0
    endless: set[str] = set()

    def text(raw: str) -> None:
        if raw and not raw.isspace():
            words = html.unescape(raw)
            page.texts.append((stack[-1], words, _hash(page.elements[stack[-1]].path, " ".join(words.split())), block))
        elif raw:
            page.texts.append((stack[-1], " ", 0, block))

    def close(names: set[str], apart: set[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            tag = page.elements[stack[k]].tag
            if tag in names:
                del stack[k:]
                return
            if tag in apart:
                return

    m = _TAG.search(source)
    while m:
        text(source[at : m.start()])
        at = m.end()
        name = (m.group("name") or "").lower()
        tag, m = m, None
        empty = bool(name) and not tag.group("end") and bool(_SELF_CLOSED.search(tag.group("attrs")))
        if name in _RAW and not tag.group("end") and not (empty and name not in ("script", "style")) and name not in endless:
            end = _RAW_END[name].search(source, at)
            if end:
                at = end.end()
            elif name in _RAW_TO_END:
                return page
            else:
                endless.add(name)  # no later tag of this kind has an end either
        m = _TAG.search(source, at)
        if not name or name in _RAW:
            continue
        if name in _BLOCK:
            block += 1
        if tag.group("end"):
            close({name}, set() if name != "p" else _SCOPE)
            continue
        if name in _VOID or empty:
            page.texts.append((stack[-1], " ", 0, block))
            continue
        if name in _CLOSES:
            close(*_CLOSES[name])
        if name in _BLOCK:
            close({"p"}, _SCOPE)
        up = page.elements[stack[-1]]
        marks = attributes(tag.group("attrs"))
        article = up.article or name in ("article", "main")
        aside = is_aside(name, up, aside_words(marks))
        shape = " ".join(f"{k}={re.sub('[0-9]+', '0', v)}" for k, v in sorted(marks.items()))
        page.elements.append(Element(name, stack[-1], _hash(up.path, name, shape), aside, article,
                                     up.link or name == "a", up.depth + 1, len(page.elements)))
        stack.append(len(page.elements) - 1)
    text(source[at:])
    return page


def weigh(page: Page, constant: frozenset[int] | set[int] = frozenset()) -> None:
    """Set each element's mass: characters of article text in it, links and template text left out."""
    for e in page.elements:
        e.mass = 0
    for own, words, mark, _ in page.texts:
        e = page.elements[own]
        if e.aside or e.link or mark in constant:
            continue
        n = len(words.strip())
        while own >= 0:
            page.elements[own].mass += n
            own = page.elements[own].parent


def article_print(page: Page) -> int:
    """Hash of the page's article text, links left out: the same for copies of a page."""
    return _hash(*(mark for own, _, mark, _ in page.texts
                   if mark and not page.elements[own].aside and not page.elements[own].link))


def preference(tag: str) -> int:
    """Which container is taken among those that hold nearly all of the text."""
    return {"article": 2, "main": 1}.get(tag, 0)


def own_container(page: Page) -> int | None:
    """Path of the smallest container with all article text of the page.

    An article or main element with nearly all of it goes first, the one with most text before the deepest.
    """
    mass: dict[int, int] = {}
    for e in page.elements:
        if is_container(e):
            mass[e.path] = mass.get(e.path, 0) + e.mass
    most = max(mass.values(), default=0)
    if not most:
        return None
    rated = [(bool(preference(e.tag)) and mass[e.path] >= NEARLY * most, mass[e.path], e.depth, -e.at, e.path)
             for e in page.elements if is_container(e)]
    return max(rated)[4]


def is_container(e: Element) -> bool:
    return e.tag in _WHOLE and not e.aside


def slot_text(page: Page, container: int | None, constant: set[int]) -> str:
    """The blocks under the container, with white space made single blanks, joined by empty lines.

    A block is template text only if all of it is.  A heading inside an article is none: many
    articles of a host may have a part of the same name.
    """
    inside = [False] * len(page.elements)
    for i, e in enumerate(page.elements):
        inside[i] = container is None or e.path == container or (e.parent >= 0 and inside[e.parent])
    blocks: dict[int, list[str]] = {}
    own_text: set[int] = set()
    for own, words, mark, block in page.texts:
        if inside[own] and not page.elements[own].aside:
            blocks.setdefault(block, []).append(words)
            e = page.elements[own]
            if mark and (mark not in constant or (e.article and e.tag in _HEADINGS)):
                own_text.add(block)
    found = (" ".join("".join(b).split()) for n, b in sorted(blocks.items()) if n in own_text)
    return "\n\n".join(b for b in found if b)
