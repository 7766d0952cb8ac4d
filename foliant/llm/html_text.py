"""A forgiving reader of web pages: one page to its text blocks, each with its place in the page. Small per-page help for ``html_extract``."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import xxhash

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split())
#: A start tag ends an open element of these names, up to the named ancestor.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)),
    "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
}

# What is never the article: elements, roles, and words of class names and ids.
SKIP_TAGS = frozenset("head nav aside footer form button select dialog menu fieldset object audio video canvas map applet".split())
SKIP_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
SKIP_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner banners sponsor sponsored promo promotion promotions cookie cookies consent gdpr "
    "notice notices popup modal overlay newsletter subscribe subscription signup login sidebar sidebars menu menus nav navbar navigation breadcrumb "
    "breadcrumbs masthead topbar footer comment comments reply replies respond disqus discussion share sharing social related recommended widget "
    "widgets toolbar pagination pager search skip copyright".split())
#: Only outside an article: inside, a header holds its title.
OUTER_WORDS, OUTER_TAGS = frozenset({"header"}), frozenset({"header"})
#: Names of wrappers keep what is in them, whatever else they say.
KEEP_WORDS = frozenset("content main article post entry body wrapper layout page container wrap".split())
COMMENT_WORDS = frozenset("comment comments reply replies".split())

_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


@dataclass
class Block:
    """``slot`` and ``parent``: the paths of the block's element and of the one it is in; ``main``: inside an article or main element; ``skip``: inside what is never the article."""

    slot: int
    parent: int
    main: bool
    skip: bool
    text: str


class _Open:
    __slots__ = ("name", "path", "parent", "main", "skip")

    def __init__(self, name: str, path: int, parent: int, main: bool, skip: bool) -> None:
        self.name, self.path, self.parent, self.main, self.skip = name, path, parent, main, skip


_paths: dict[tuple[int, str, str], int] = {}


def _path(parent: int, name: str, label: str) -> int:
    """A 63-bit name of a place in the tree of elements."""
    key = (parent, name, label)
    got = _paths.get(key)
    if got is None:
        if len(_paths) > 100_000:
            _paths.clear()
        got = _paths[key] = xxhash.xxh64_intdigest(f"{parent}/{name}.{label}") >> 1
    return got


def _tag_end(page: str, at: int) -> int:
    """The end of the tag that begins at ``at``: the first > outside quotes, or else the first > at all."""
    end = page.find(">", at)
    if end < 0:
        return -1
    part = page[at:end]
    if '"' not in part and "'" not in part:
        return end
    i, quote = at, ""
    while i < len(page):
        c = page[i]
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c == ">":
            return i
        i += 1
    return end


def _attributes(text: str) -> dict[str, str]:
    return {k.lower(): html.unescape(v.strip("\"'")) for k, v in _ATTR.findall(text)} if text and not text.isspace() else {}


def _skips(name: str, attrs: dict[str, str], main: bool) -> bool:
    if name in SKIP_TAGS or (name in OUTER_TAGS and not main):
        return True
    if not attrs:
        return False
    if attrs.get("role", "").lower() in SKIP_ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", ""):
        return True
    names = f"{attrs.get('class', '')} {attrs.get('id', '')}".split()
    if name in ("html", "body", "main", "article"):
        return name == "article" and any(n.lower() in COMMENT_WORDS for n in names)
    parts = {p.lower() for n in names for p in _PART.findall(n)}
    bad = parts & (SKIP_WORDS if main else SKIP_WORDS | OUTER_WORDS)
    return bool(bad) and (not parts & KEEP_WORDS or bool(bad & COMMENT_WORDS))


def read_page(page: str) -> tuple[list[Block], dict[int, int]]:
    """The text blocks of a page in order, without empty ones, and how often each element path occurs."""
    blocks: list[Block] = []
    tags: dict[int, int] = {}
    stack = [_Open("", 0, 0, False, False)]
    words: list[str] = []
    where = stack[0]

    def flush() -> None:
        nonlocal words
        if words:
            text = " ".join("".join(words).split())
            if text:
                blocks.append(Block(where.path, where.parent, where.main, where.skip, text))
            words = []

    def pop_to(names: tuple[str, ...], stops: tuple[str, ...]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name in names:
                if stack[i].skip != stack[i - 1].skip or any(e.name in BLOCK for e in stack[i:]):
                    flush()
                del stack[i:]
                return
            if stack[i].name in stops:
                return

    def holder() -> _Open:
        for e in reversed(stack):
            if e.name in BLOCK or not e.name or e.skip != stack[-1].skip:
                return e
        return stack[0]

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            if not words:
                top = holder()
                where = _Open(top.name, top.path, top.parent, stack[-1].main, stack[-1].skip)
            part = page[at:lt]
            words.append(html.unescape(part) if "&" in part else part)
        if lt == n:
            break
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        closing = page.startswith("</", lt)
        m = _NAME.match(page, lt + 1 + closing)
        if not m:
            words.append("<")
            at = lt + 1
            continue
        end = _tag_end(page, m.end())
        if end < 0:  # a tag that the page breaks off in
            break
        name, at = m[0].lower(), end + 1
        if closing:
            if name in BLOCK:
                flush()
            pop_to((name,), ("article", "main", "body") if name not in ("article", "main", "body", "html") else ())
            continue
        if name in BLOCK:
            flush()
            if name not in ("option", "optgroup"):
                pop_to(("p",), ("article", "main", "td", "th", "li", "button"))
        if name in CLOSES:
            pop_to(*CLOSES[name])
        if name == "br":
            words.append(" ")
        attrs = _attributes(page[m.end():end])
        top = stack[-1]
        main = top.main or name in ("article", "main") or attrs.get("role") in ("main", "article")
        skip = top.skip or _skips(name, attrs, main)
        path = _path(top.path, name, f"{attrs.get('class', '')}#{attrs.get('role', '')}" if attrs else "")
        tags[path] = tags.get(path, 0) + 1
        if name in RAW and not page[m.end():end].endswith("/"):
            low = re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE).search(page, at)
            if not low:
                break
            end = page.find(">", low.end())
            at = n if end < 0 else end + 1
            continue
        if name not in VOID:
            if skip != top.skip:
                flush()
            stack.append(_Open(name, path, top.path, main, skip))
    flush()
    return blocks, tags


def text_hash(text: str) -> int:
    """A 63-bit name of a text."""
    return xxhash.xxh64_intdigest(text) >> 1


def article(blocks: list[Block], constant: frozenset[int]) -> list[str]:
    """The blocks of the article: of those that are not constant, as a slot or as a text in their slot, the ones inside article or main elements where there are any, else all."""
    open_blocks = [b for b in blocks if not b.skip]
    if constant:
        open_blocks = [b for b in open_blocks if b.slot not in constant and b.slot ^ text_hash(b.text) not in constant]
    return [b.text for b in open_blocks if b.main] or [b.text for b in open_blocks]
