"""JSON-LD, meta tags, reader-mode text and links of an HTML document."""

from __future__ import annotations

import json
import re
from urllib.parse import urljoin, urlsplit

from quarry.functions.css import compile_selector
from quarry.functions.dom import Element


class _Number(str):
    """A JSON number as it was written."""


def _reject(name: str):
    raise ValueError(name)


def load_json(text: str):
    """JSON with numbers as written; ValueError where it isn't JSON."""
    return json.loads(text, parse_float=_Number, parse_int=_Number, parse_constant=_reject)


def json_ld(document: Element) -> list:
    """The values of all JSON-LD blocks; a top-level array counts as its members, a malformed block as none."""
    out: list = []
    for e in compile_selector("script[type='application/ld+json']").iter(document):
        try:
            value = load_json(e.text().strip())
        except (ValueError, RecursionError):
            continue
        out += value if isinstance(value, list) else [value]
    return out


def json_path(value, path: str) -> str | None:
    """The scalar at a dotted path through objects: strings as they are, numbers as written, true and false by name; anything else is null."""
    for step in filter(None, path.split(".")):
        if not isinstance(value, dict) or step not in value:
            return None
        value = value[step]
    if isinstance(value, bool):
        return "true" if value else "false"
    return str(value) if isinstance(value, str) else None


def json_ld_value(blocks: list, path: str) -> str | None:
    return next((v for b in blocks if (v := json_path(b, path)) is not None), None)


def meta(document: Element, attribute: str, prefix: str = "") -> dict[str, str]:
    """content by name of the meta tags whose attribute starts with prefix (case ignored); the last of a name wins."""
    out: dict[str, str] = {}
    for e in document.descendants():
        if e.tag == "meta":
            name, content = e.attrs.get(attribute), e.attrs.get("content")
            if name and content is not None and name.lower().startswith(prefix.lower()):
                out[name] = content
    return out


def open_graph(document: Element) -> dict[str, str]:
    return meta(document, "property", "og:")


def meta_tags(document: Element) -> dict[str, str]:
    return meta(document, "name")


# Fixed values of the reader mode: what never is content, what may hold it, and the weights of the score.
NOISE = frozenset("script style nav header footer aside form iframe noscript svg button".split())
CANDIDATES = frozenset("article main section div td".split())
LEAST_CHARACTERS, PER_PARAGRAPH, PER_COMMA = 100, 25, 2


def _length(text: str) -> int:
    return len(text) + sum(c > "\uffff" for c in text)  # in UTF-16 units


def main_content(root: Element) -> str | None:
    """The text of the candidate below root with the highest score; nothing is changed in the tree.

    One walk from the leaves up gives each element its text length, the text
    length of its links, its paragraphs and commas; ties go to the first.
    """
    order: list[Element] = []
    stack = [root]
    while stack:
        e = stack.pop()
        order.append(e)
        stack += [c for c in reversed(e.elements()) if c.tag not in NOISE]
    sums: dict[int, list[int]] = {}
    for e in reversed(order):
        own = [0, 0, 0, 0]  # text, link text, paragraphs, commas
        for c in e.children:
            if isinstance(c, str):
                own[0] += _length(c)
                own[3] += c.count(",")
            elif c.tag not in NOISE:
                n = sums[id(c)]
                own = [own[0] + n[0], own[1] + n[1] + (n[0] if c.tag == "a" else 0), own[2] + n[2] + (c.tag == "p"), own[3] + n[3]]
        sums[id(e)] = own
    best, high = None, 0.0
    for e in order[1:]:
        if e.tag in CANDIDATES:
            text, link, paragraphs, commas = sums[id(e)]
            if text >= LEAST_CHARACTERS:
                score = text * (1 - link / text) + paragraphs * PER_PARAGRAPH + commas * PER_COMMA
                if score > high:
                    best, high = e, score
    if best is None:
        return None
    parts = [t for e in _clean(best) if e.tag == "p" and (t := clean_text(e).strip())]
    text = "\n\n".join(parts) if parts else clean_text(best).strip()
    return re.sub(r"[ \t]+", " ", text).strip() or None


def _clean(e: Element):
    stack = [c for c in reversed(e.elements()) if c.tag not in NOISE]
    while stack:
        c = stack.pop()
        yield c
        stack += [x for x in reversed(c.elements()) if x.tag not in NOISE]


def clean_text(e: Element) -> str:
    return "".join(c if isinstance(c, str) else clean_text(c) for c in e.children if isinstance(c, str) or c.tag not in NOISE)


# Links that need no resolving: a path from the root without dot segments, behind the base's origin; an absolute URL.
_TAIL = r"(?:\?[A-Za-z0-9_.~%=&+,:/-]+)?(?:#[A-Za-z0-9_.~%=&+,:/-]+)?"
_ORIGIN = re.compile(r"(https?://[A-Za-z0-9.-]+(?::[0-9]+)?)(?:[/?#]|\Z)")
_ROOTED = re.compile(r"(?:/|(?:/[A-Za-z0-9_~%=&+,-][A-Za-z0-9_.~%=&+,-]*)+/?)" + _TAIL)
_WHOLE = re.compile(r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[A-Za-z0-9_.~%=&+,/-]*)?" + _TAIL)


def absolute(base: str, href: str | None) -> str | None:
    """href resolved against base, or null if it is blank or no absolute URL comes out."""
    if not href or not (plain := href.strip()):
        return None
    if own := _ORIGIN.match(base):
        if _ROOTED.fullmatch(plain):
            return own[1] + plain
        if _WHOLE.fullmatch(plain):
            return plain
    try:
        out = urljoin(base, plain)
        parts = urlsplit(out)
    except ValueError:
        return None
    return out if parts.scheme and (parts.netloc or parts.path) else None


def links(document: Element, base: str, selector: str) -> list[str]:
    """Absolute URLs of the href attributes of all matches, in document order."""
    return [u for e in compile_selector(selector).iter(document) if (u := absolute(base, e.attrs.get("href"))) is not None]


# Where a next-page link is looked for, in this order.
NEXT_SELECTORS = ("a[rel='next']", "link[rel='next']", ".pagination .next a", ".pagination-next a", "a.next", "li.next > a")


def next_page(document: Element, base: str, *custom: str) -> str | None:
    """The next page's URL: custom selectors first, then the usual ones; the first with a usable href."""
    for selector in (*custom, *NEXT_SELECTORS):
        e = compile_selector(selector).first(document)
        if e is not None and (u := absolute(base, e.attrs.get("href"))) is not None:
            return u
    return None
