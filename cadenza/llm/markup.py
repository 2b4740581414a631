"""Web pages as token streams: balanced tags with their markers, and text.

Tags that only shape text inside a line are left out, so ``<p>one <b>two</b></p>`` is a tag, a text and
its end. Missing end tags are filled in as browsers do it (a paragraph ends where the next block
starts, a list item at the next one), end tags without a start are ignored, and what a cut page leaves
open ends with the page. Scripts, styles, comments and the like never become tokens.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape
from zlib import crc32

_ATTRS = r"""(?:[^>=]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|))*+"""
MARKUP = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"
    r"|<(?P<raw>script|style|noscript|template|textarea|title|iframe|xmp|noembed|noframes)(?=[\s/>])" + _ATTRS
    + r"(?:>|\Z)(?:.*?(?:</(?P=raw)(?=[\s/>])[^>]*+(?:>|\Z)|\Z))"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*+)(?P<attrs>" + _ATTRS + r")(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)", re.I | re.S,
)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

# What HTML says of its elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside audio blockquote body button canvas caption center dd details dialog dir div dl dt fieldset"
    " figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main map menu nav"
    " object ol optgroup option p pre search section select summary svg table tbody td tfoot th thead tr ul video".split()
)
#: An element that starts ends the open ones named here, up to the nearest of the second set.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "thead": ({"tbody", "caption"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
}
_IN_LINES = frozenset("audio button canvas datalist map object select svg video option optgroup".split())
_WALLS = frozenset(("td", "th", "table", "caption", "button", "object"))

# Names by which pages mark their parts.
ASIDE_TAGS = frozenset(
    "nav footer aside form search dialog menu head button select option optgroup datalist svg canvas audio video object"
    " fieldset legend map frameset".split()
)
ASIDE_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr"
    " notice notices alert popup modal overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs pagination pager"
    " masthead footer comment comments reply replies respond disqus share sharing social newsletter subscribe signup"
    " login related recommended toolbar copyright disclaimer hidden".split()
)
NOT_AN_ARTICLE = frozenset("ad ads advert advertisement sponsored promo comment comments reply replies related teaser".split())
CONTENT_NAMES = frozenset(
    "article article-body articlebody article-content post post-body post-content entry entry-content content main"
    " main-content page-content story story-body".split()
)
ARTICLE, MAIN, NAMED, DENSEST = 1, 2, 4, 8
#: Elements nested deeper than this count as part of the one that holds them; their text stays.
DEPTH = 100
TEXT = "#"


@lru_cache(maxsize=50_000)
def label_of(tag: str, attrs: str) -> str:
    """The tag with its class, id, role and kind, without digits, so that numbered copies are alike."""
    first, words = [], []
    for name, *values in ATTRIBUTE.findall(attrs):
        name, value = name.lower(), "".join(values)
        if name == "class":
            words += value.split()
        elif name == "id":
            words += ("#" + value).split()
        elif name in ("role", "itemprop"):
            first += [f"{name}={v}" for v in value.split()]
        elif name == "hidden":
            first.append("hidden")
    return " ".join([tag, *(w for word in first + words if (w := re.sub(r"\d+", "", word)))])


@lru_cache(maxsize=50_000)
def part_of(label: str) -> tuple[bool, bool, int]:
    """Whether a label marks a part beside the main text, whether only outside of content, and its content mark."""
    tag, *tokens = label.split(" ")
    roles = {t.partition("=")[2].lower() for t in tokens if t.startswith("role=")}
    kinds = {t.partition("=")[2].lower() for t in tokens if t.startswith("itemprop=")}
    names = [t.lstrip("#") for t in tokens if "=" not in t]
    words = {w.lower() for name in names for w in WORD.findall(name)}
    if tag in ("html", "body"):
        return False, False, 0
    if tag in ("article", "main") or roles & {"article", "main"} or "articlebody" in kinds:
        if tag != "main" and words & NOT_AN_ARTICLE or "hidden" in tokens:
            return True, False, 0
        return False, False, MAIN if tag == "main" or "main" in roles else ARTICLE
    if tag in ASIDE_TAGS or roles & ASIDE_ROLES or words & ASIDE_WORDS:
        return True, False, 0
    if tag == "header" or "header" in words:
        return False, True, 0
    return False, False, NAMED if {n.lower() for n in names} & CONTENT_NAMES else 0


def item(label: str, children: list | None = None, chars: int = 0, links: int = 0, value: int | None = None, texts=()) -> list:
    """One place of an expression: label, quantifier, children, characters, those in links, value, text numbers."""
    return [label, 0, children, chars, links, value, list(texts)]


def tokens(page: str) -> tuple[list, list[tuple[int, str]]]:
    """The page as nested items, and its texts with the number of the block each lies in."""
    root: list = []
    stack = [("", root, True)]  # tag, children, whether its borders end a line
    texts: list[tuple[int, str]] = []
    block = chars_linked = 0
    open_links, buffer = 0, []

    def flush():
        nonlocal chars_linked, buffer
        text = "".join(buffer)
        if stripped := text.strip():
            stack[-1][1].append(item(TEXT, None, len(stripped), min(chars_linked, len(stripped)), crc32(stripped.encode("utf-8", "replace")), [len(texts)]))
            texts.append((block, text))
        chars_linked, buffer = 0, []

    def close(to: int):
        nonlocal block
        flush()
        if any(s[2] for s in stack[to:]):
            block += 1
        del stack[to:]

    def add(piece: str):
        nonlocal chars_linked
        piece = unescape(piece) if "&" in piece else piece
        buffer.append(piece)
        if open_links:
            chars_linked += len(piece)

    at = 0
    for m in MARKUP.finditer(page):
        if m.start() > at:
            add(page[at:m.start()])
        at = m.end()
        if (tag := m["tag"]) is None:
            continue
        tag, attrs = tag.lower(), m["attrs"]
        if m["end"]:
            if tag == "a":
                open_links = 0
            if tag in ("html", "body") or tag not in BLOCKS and tag != stack[-1][0]:
                continue
            heading = len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()
            for i in range(len(stack) - 1, 0, -1):
                name = stack[i][0]
                if name == tag or heading and len(name) == 2 and name[0] == "h" and name[1].isdigit():
                    close(i)
                    break
                if name in _WALLS and tag not in ("table", "tr", "tbody", "thead", "tfoot", "body"):
                    break
            continue
        if tag == "br":
            buffer.append(" ")
            continue
        if tag not in BLOCKS:
            if tag == "a":
                open_links = 1
            elif tag not in VOID and attrs and part_of(label_of(tag, attrs))[0] and len(stack) < DEPTH:
                flush()
                stack[-1][1].append(entry := item(label_of(tag, attrs), []))
                stack.append((tag, entry[2], False))
            continue
        if tag not in _IN_LINES:
            top = len(stack) - 1
            while not stack[top][2]:
                top -= 1
            if stack[top][0] == "p":
                close(top)
        if tag in ENDS:
            ended, border = ENDS[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in border:
                    break
                if stack[i][0] in ended:
                    close(i)
        flush()
        block += 1
        if tag in VOID or tag in ("html", "body") and any(s[0] == tag for s in stack) or len(stack) >= DEPTH:
            continue
        stack[-1][1].append(entry := item(label_of(tag, attrs) if attrs else tag, []))
        stack.append((tag, entry[2], True))
    if at < len(page):
        add(page[at:])
    close(1)
    return root, texts


def joined(texts: list[tuple[int, str]], kept) -> str:
    """The kept texts: those of one block on one line, white space within a block as one space."""
    lines: dict[int, list[str]] = {}
    for i in sorted(kept):
        block, text = texts[i]
        lines.setdefault(block, []).append(text)
    return "\n".join(line for parts in lines.values() if (line := " ".join("".join(parts).split())))
