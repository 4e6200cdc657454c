"""A tolerant HTML tree on the standard library's tokeniser.

It builds what matters for selectors and text: html, head and body always exist,
end tags are implied where HTML implies them, table rows get a tbody, and open
formatting elements are continued in the next block.
"""

from __future__ import annotations

from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEAD = frozenset("base link meta noscript script style template title".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SCOPE = frozenset("html table td th caption template button object marquee applet".split())
# start tag -> (open tags that it ends, where the search for them stops)
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "caption": ({"caption"}, {"table"}),
}


class Element:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs or {}, [], None

    def append(self, child: Element | str) -> None:
        if isinstance(child, str):
            if self.children and isinstance(self.children[-1], str):
                self.children[-1] += child
                return
        else:
            child.parent = self
        self.children.append(child)

    def elements(self) -> list[Element]:
        return [c for c in self.children if not isinstance(c, str)]

    def descendants(self) -> Iterator[Element]:
        """In document order, without itself."""
        stack = [c for c in reversed(self.children) if not isinstance(c, str)]
        while stack:
            e = stack.pop()
            yield e
            stack.extend(c for c in reversed(e.children) if not isinstance(c, str))

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            else:
                stack.extend(reversed(n.children))
        return "".join(out)

    def html(self) -> str:
        """Its markup, itself included."""
        out, stack = [], [self]
        while stack:
            n = stack.pop()
            if isinstance(n, tuple):
                out.append(n[0])
            elif isinstance(n, str):
                out.append(escape(n, quote=False))
            elif n.tag.startswith("#"):
                stack.extend(reversed(n.children))
            else:
                out.append(f"<{n.tag}{''.join(f' {k}="{escape(v or "")}"' for k, v in n.attrs.items())}>")
                if n.tag not in VOID:
                    stack.append((f"</{n.tag}>",))
                    if n.tag in ("script", "style"):
                        stack.append(("".join(c for c in n.children if isinstance(c, str)),))
                    else:
                        stack.extend(reversed(n.children))
        return "".join(out)

    def root(self) -> Element:
        e = self
        while e.parent is not None:
            e = e.parent
        return e


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.document = Element("#document")
        self.html, self.head, self.body = Element("html"), Element("head"), Element("body")
        self.document.append(self.html)
        self.html.append(self.head)
        self.html.append(self.body)
        self.open = [self.html]
        self.in_body = False
        self.active: list[Element] = []  # formatting elements that are not closed yet

    def updatepos(self, i: int, j: int) -> int:
        return j  # lines and columns are not asked for

    def _enter_body(self) -> None:
        if not self.in_body:
            self.in_body, self.open = True, [self.html, self.body]

    def _push(self, tag: str, attrs: dict[str, str]) -> Element:
        e = Element(tag, attrs)
        self.open[-1].append(e)
        self.open.append(e)
        return e

    def _resume(self) -> None:
        for i, e in enumerate(self.active):
            if not any(e is o for o in self.open):
                self.active[i] = self._push(e.tag, dict(e.attrs))

    def _end(self, tags: set[str], stop: set[str]) -> None:
        """Closes the outermost open element among tags, as far as an element of stop."""
        cut = None
        for i in range(len(self.open) - 1, 1, -1):
            if self.open[i].tag in stop:
                break
            if self.open[i].tag in tags:
                cut = i
        if cut is not None:
            del self.open[cut:]

    def _end_p(self) -> None:
        for i in range(len(self.open) - 1, 1, -1):
            tag = self.open[i].tag
            if tag == "p":
                del self.open[i:]
                return
            if tag in SCOPE:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        own: dict[str, str] = {}
        for k, v in attrs:
            own.setdefault(k, v if v is not None else "")
        if tag in ("html", "head", "body"):
            target = {"html": self.html, "head": self.head, "body": self.body}[tag]
            for k, v in own.items():
                target.attrs.setdefault(k, v)
            if tag == "body":
                self._enter_body()
            return
        if not self.in_body:
            if tag in HEAD:
                self.open = [self.html, self.head]
                self._push(tag, own)
                if tag in VOID:
                    self.open.pop()
                return
            self._enter_body()
        if tag in CLOSES_P:
            self._end_p()
        if tag in HEADINGS and self.open[-1].tag in HEADINGS:
            self.open.pop()
        if tag in ENDS:
            self._end(*ENDS[tag])
        if tag == "tr" and self.open[-1].tag == "table":
            self._push("tbody", {})
        if tag in ("td", "th") and self.open[-1].tag in ("table", "tbody", "thead", "tfoot"):
            if self.open[-1].tag == "table":
                self._push("tbody", {})
            self._push("tr", {})
        if tag == "a" and (old := next((e for e in self.active if e.tag == "a"), None)) is not None:
            self.handle_endtag("a")
            self.active = [e for e in self.active if e is not old]
        if tag not in CLOSES_P and tag not in ENDS:
            self._resume()
        e = self._push(tag, own)
        if tag in VOID:
            self.open.pop()
        elif tag in FORMATTING:
            self.active.append(e)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # a slash closes nothing in HTML but void elements

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID or tag in ("html", "body", "head"):
            if tag == "br":
                self.handle_starttag("br", [])
            elif tag == "head" and not self.in_body:
                self.open = [self.html]
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                gone = self.open[i]
                del self.open[i:]
                self.active = [e for e in self.active if e is not gone]
                return
            if tag not in FORMATTING and self.open[i].tag in ("td", "th", "table") and tag not in ("table", "tr", "tbody", "thead", "tfoot"):
                break
        if tag in FORMATTING:
            self.active = [e for e in self.active if e.tag != tag]
        elif tag == "p":
            self._enter_body()
            self.open[-1].append(Element("p"))

    def handle_data(self, data: str) -> None:
        if not self.in_body:
            if self.open[-1] not in (self.html, self.head):
                self.open[-1].append(data)
                return
            if not data.strip(" \t\n\r\f"):
                return
            self._enter_body()
        if data.strip(" \t\n\r\f"):
            self._resume()
        self.open[-1].append(data)


def parse(html: str | None) -> Element:
    """The document of an HTML text; null is an empty document."""
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.document
