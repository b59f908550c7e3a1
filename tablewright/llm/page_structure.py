"""Text blocks of a web page with their place in its structure."""

from __future__ import annotations

import re
from html import unescape

BOILERPLATE, CONTENT, OPEN = 0, 1, 2

#: Elements by what they mean for a reader.
SKIPPED = {"script", "style", "noscript", "template", "iframe", "object", "embed", "svg", "math", "canvas", "audio", "video",
           "textarea", "select", "option", "button", "title", "head"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp"}
APART = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "fieldset"}
MAIN = {"article", "main"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd",
          "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
APART_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar"}
APART_WORDS = {"ad", "ads", "advert", "advertisement", "adsense", "banner", "sponsor", "sponsored", "promo", "nav", "navbar", "navigation",
               "menu", "breadcrumb", "breadcrumbs", "header", "masthead", "footer", "sidebar", "cookie", "cookies", "consent", "gdpr", "notice",
               "popup", "modal", "overlay", "comments", "comment", "commentlist", "disqus", "share", "sharing", "social", "related",
               "newsletter", "subscribe", "subscription", "login", "signup", "search", "pagination", "skip"}

#: Of these words, the ones that also name a wrapper of a whole page after what stands beside its article.
LAYOUT_WORDS = {"nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "header", "masthead", "footer", "sidebar"}

_MARK = re.compile(r"<(?:(!--)|[!?]|(/?)([a-zA-Z][^\s/>]*))")
_ODD = re.compile(r"<[!?]")
_QUOTE_OR_END = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[a-z]+")
_RAW_END = {name: re.compile(f"</{name}\\b", re.I) for name in RAW}
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _is_apart(name: str, attributes: str, apart_words: set[str]) -> bool:
    if name in APART:
        return True
    if not attributes.strip(" /\n\t"):
        return False
    for key, a, b, c in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), a or b or c
        if key == "role":
            if value.lower() in APART_ROLES:
                return True
        elif key in ("class", "id"):
            words = _WORD.findall(_CAMEL.sub("-", value).lower())
            if name not in ("body", "html", "article", "main") and not apart_words.isdisjoint(words):
                return True
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return True
        elif key == "style" and "display:none" in value.replace(" ", "").lower():
            return True
    return False


def _tag_end(html: str, at: int, failed: set[int]) -> int:
    """Place of the > that ends a tag, not one inside a quoted value unless quotes never close; -1 without any.

    `failed` holds the quotes from which no end was found, so no part of a page is searched over and over.
    """
    place, seen = at, []
    while found := _QUOTE_OR_END.search(html, place):
        here = found.start()
        if html[here] == ">":
            return here
        if here in failed:
            break
        seen.append(here)
        place = html.find(html[here], here + 1) + 1
        if not place:
            break
    failed.update(seen)
    return html.find(">", at)


def blocks(html: str) -> list[tuple[int, str]]:
    """Kind and text of each block in page order: boilerplate by structure, inside the main element, or open.

    A main element inside a wrapper whose class or id is a layout word (`has-sidebar`) counts if the page has no other.
    Takes time in proportion to the page, however odd its markup is.
    """
    found = _parsed(html, APART_WORDS)
    if any(kind == CONTENT for kind, _ in found):
        return found
    lenient = _parsed(html, APART_WORDS - LAYOUT_WORDS)
    return lenient if any(kind == CONTENT for kind, _ in lenient) else found


def _parsed(html: str, apart_words: set[str]) -> list[tuple[int, str]]:
    out: list[tuple[int, str]] = []
    buffer: list[str] = []
    stack: list[tuple[str, int, int]] = []  # open elements: name, apart, main
    count: dict[str, int] = {}
    apart = main = 0
    at, end = 0, len(html)
    failed: set[int] = set()

    def flush() -> None:
        text = " ".join(unescape("".join(buffer)).split())
        buffer.clear()
        if text:
            out.append((BOILERPLATE if apart else CONTENT if main else OPEN, text))

    while at < end:
        found = _MARK.search(html, at)
        if found is None:
            buffer.append(html[at:])
            break
        buffer.append(html[at: found.start()])
        if found[1]:
            stop = html.find("-->", found.end())
            at = stop + 3 if stop >= 0 else end
            continue
        name = found[3]
        stop = _tag_end(html, found.end(), failed) if name else html.find(">", found.end())
        if stop < 0:  # nothing ends a tag any more: what is left is text, up to a comment or declaration
            odd = _ODD.search(html, found.start())
            buffer.append(html[found.start(): odd.start() if odd else end])
            break
        closing, attributes = found[2], html[found.end(): stop]
        at = stop + 1
        if not name:
            continue
        name = name.lower()
        if name not in INLINE:
            flush()
        if closing:
            if count.get(name):
                while True:
                    open_name, a, m = stack.pop()
                    if open_name in MAIN or a:
                        flush()
                    count[open_name] -= 1
                    apart -= a
                    main -= m
                    if open_name == name:
                        break
            continue
        if name in VOID:
            continue
        if name in RAW:
            stop = _RAW_END[name].search(html, at)
            at = html.find(">", stop.end()) + 1 if stop else end
            if not at:
                break
            continue
        if name == "p" and stack and stack[-1][0] == "p":  # an open paragraph ends where the next begins
            count["p"] -= 1
            stack.pop()
        a = int(name in SKIPPED or _is_apart(name, attributes, apart_words))
        if a:
            flush()
        if not attributes.endswith("/"):
            stack.append((name, a, int(name in MAIN)))
            count[name] = count.get(name, 0) + 1
            apart += a
            main += stack[-1][2]
    flush()
    return out
