"""A page's markup as a row of tokens: tags and runs of text, each with the path of block elements around it. Pure functions of one page."""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape
from typing import NamedTuple

import xxhash

MARK = re.compile(
    r"<(?:!--(?:.*?--!?>|.*)|[!?][^>]*>?|/(?P<end>[A-Za-z][^\s/>]*)[^>]*>?"
    r"|(?P<start>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>=]++|=\s*+(?:\"[^\"]*\"|'[^']*')|=)*+)>|[A-Za-z][^>]*\Z|/[^A-Za-z][^>]*>?)",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: Elements whose content is no markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base basefont bgsound br col embed frame hr img input link meta param source track wbr".split())
#: Elements inside a block; all others begin and end one.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
#: A start tag of the key ends an open element of the value, unless one of BARRIER is between them.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
BARRIER = frozenset("ul ol dl table article main aside nav section body html".split())
LANDMARK = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements, and words of a class, id or role, that hold no main text.
OUTSIDE = frozenset("head nav footer aside form button select datalist fieldset dialog noscript template svg math object canvas audio video map menu".split())
OUTSIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars footer "
    "masthead cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription paywall comment comments disqus respond reply replies "
    "social share sharing related recommended widget widgets toolbar login signup search pagination pager contentinfo complementary".split()
)
EXCLUDED, IN_MAIN, IN_ARTICLE, LINKED = 1, 2, 4, 8
#: The key of white space alone, which is in no class.
BLANK = 0


class Tokens(NamedTuple):
    keys: list[int]  #: equal for tokens of equal value on equal paths
    texts: list[str | None]  #: None for tags
    blocks: list[int]
    zones: list[int]


@lru_cache(maxsize=20_000)
def seen_tag(name: str, attrs: str) -> tuple[str, int]:
    """(label on the path, zone that the element opens)."""
    if not attrs.strip():
        given = {}
    else:
        given = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attrs)}
    classes, role = given.get("class", "").lower(), given.get("role", "").lower()
    named = re.sub(r"\d+", "0", f"{classes} {given.get('id', '').lower()} {role}")
    zone = 0
    if name == "article" or role == "article":
        zone = EXCLUDED if {"comment", "comments", "reply"} & set(classes.split()) else IN_ARTICLE
    elif name == "main" or role == "main":
        zone = IN_MAIN
    elif name in OUTSIDE or "hidden" in given or given.get("aria-hidden", "").lower() == "true" or name not in ("html", "body") and OUTSIDE_WORDS & set(re.split(r"[^a-z]+", named)):
        zone = EXCLUDED
    return f"{name} {named}".strip(), zone


def key(path: int, value: str) -> int:
    return xxhash.xxh64_intdigest(value.encode("utf-8", "replace"), path)


@lru_cache(maxsize=50_000)
def tag_key(path: int, value: str) -> int:
    return key(path, value)


def tokens(html: str) -> Tokens:
    """The page's tokens. Comments, declarations and what scripts and styles hold are none; character references are decoded."""
    out = Tokens([], [], [], [])
    stack: list[tuple[str, int, int]] = []  # (name, path, zone)
    path = zone = block = at = links = 0

    def pop_to(n: int) -> None:
        nonlocal path, zone
        del stack[n:]
        path, zone = (stack[-1][1], stack[-1][2]) if stack else (0, 0)

    def close(names, within=BARRIER) -> None:
        for n in range(len(stack) - 1, -1, -1):
            if stack[n][0] in names:
                pop_to(n)
                return
            if stack[n][0] in within:
                return

    def text(value: str) -> None:
        if not value:
            return
        value = unescape(value) if "&" in value else value
        flat = " ".join(value.split())
        out.keys.append(key(path, flat) if flat else BLANK)
        out.texts.append(value)
        out.blocks.append(block)
        out.zones.append(zone | LINKED * (links > 0))

    def tag(value: str) -> None:
        out.keys.append(tag_key(path, value))
        out.texts.append(None)
        out.blocks.append(block)
        out.zones.append(zone)

    while m := MARK.search(html, at):
        text(html[at : m.start()])
        at = m.end()
        if name := m["start"]:
            name, attrs = name.lower(), m["attrs"]
            if name in RAW:
                tag(f"<{name}")
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I).search(html, at)
                at = end.start() if end else len(html)
            elif name == "br":
                tag("<br")
                text(" ")
            elif name in VOID:
                block += name == "hr"
                tag(f"<{name}")
            elif name in INLINE:
                links += name == "a"
                tag(f"<{name}")
            else:
                block, links = block + 1, 0
                if stack and stack[-1][0] == "head" and name != "noscript":
                    close({"head"})
                close({"p"}, BARRIER | {"td", "th", "li", "dd", "div", "blockquote"})
                if name in ENDS:
                    close(ENDS[name], BARRIER - {"tbody"})
                elif name in HEADINGS and stack and stack[-1][0] in HEADINGS:
                    pop_to(len(stack) - 1)
                label, own = seen_tag(name, attrs)
                inside = zone & (IN_MAIN | IN_ARTICLE)
                if name == "header" and not inside:
                    own = EXCLUDED
                tag(f"<{label}")
                stack.append((name, path := tag_key(path, f"<{label}"), zone := zone | own))
        elif name := m["end"]:
            name = name.lower()
            if name in INLINE:
                links = max(0, links - (name == "a"))
                tag(f"</{name}")
            elif name not in VOID and name not in RAW:
                block, links = block + 1, 0
                tag(f"</{name}")
                close({name}, {"html"} if name in ("html", "body", *LANDMARK) else LANDMARK)
    text(html[at:])
    return out


def article(page: Tokens, furniture: frozenset, template: frozenset, menus: frozenset) -> str:
    """The main text: blocks in page order.

    An article, else a main element, else whatever the template's slots hold; without what is excluded, without furniture (blocks all of whose
    runs of text belong to the template), and outside of an article also without slots (named by the token of the template before them) that are menus.
    """
    wanted = 0
    for k, t, z in zip(page.keys, page.texts, page.zones, strict=True):
        if t is not None and k != BLANK and not z & EXCLUDED:
            if z & IN_ARTICLE:
                wanted = IN_ARTICLE
                break
            wanted |= z & IN_MAIN
    parts: list[str] = []
    held: list[str] = []
    own = False  # whether the block has text that isn't furniture
    slot, last = BLANK, -1
    for k, t, b, z in zip(page.keys, page.texts, page.blocks, page.zones, strict=True):
        if b != last:
            if own:
                parts.append(" ".join("".join(held).split()))
            held, own, last = [], False, b
        if k in template:
            slot = k
        if t is None or z & EXCLUDED or (not z & wanted if wanted else slot in menus):
            continue
        held.append(t)
        own |= k != BLANK and k not in furniture
    if own:
        parts.append(" ".join("".join(held).split()))
    return "\n".join(parts)
