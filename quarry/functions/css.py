"""CSS selectors, compiled once into predicates that match from right to left.

Ancestors outside the scope take part in matching, as the DOM standard has it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

from quarry.functions.dom import Element

Test = Callable[[Element], bool]
_NAME = r"(?:[\w-]|[^\x00-\x7F]|\\.)+"
_TOKEN = re.compile(
    rf"""(?P<space>\s*(?P<comb>[>+~,])\s*|\s+)|(?P<star>\*)|\#(?P<id>{_NAME})|\.(?P<cls>{_NAME})|(?P<tag>{_NAME})
    |\[\s*(?P<attr>{_NAME})\s*(?:(?P<op>[~|^$*]?=)\s*(?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<bare>[^\s\]]+))\s*(?P<flag>[iIsS])?\s*)?\]
    |:(?P<colon>:?)(?P<pseudo>[\w-]+)(?P<call>\()?""",
    re.X,
)


class SelectorError(ValueError):
    pass


def _attr(name: str, op: str | None, value: str, fold: bool) -> Test:
    name = name.lower()
    value = value.lower() if fold else value
    checks: dict[str, Callable[[str], bool]] = {
        "=": lambda v: v == value,
        "~=": lambda v: value != "" and value in v.split(),
        "|=": lambda v: v == value or v.startswith(value + "-"),
        "^=": lambda v: value != "" and v.startswith(value),
        "$=": lambda v: value != "" and v.endswith(value),
        "*=": lambda v: value != "" and value in v,
    }
    if op is None:
        return lambda e: name in e.attrs
    check = checks[op]
    return lambda e: name in e.attrs and check(e.attrs[name].lower() if fold else e.attrs[name])


def _siblings(e: Element, same: bool) -> list[Element]:
    if e.parent is None:
        return [e]
    return [c for c in e.parent.elements() if not same or c.tag == e.tag]


def _place(e: Element, same: bool, last: bool) -> int:
    line = _siblings(e, same)
    i = next(k for k, c in enumerate(line) if c is e)
    return len(line) - i if last else i + 1


def _nth(text: str) -> Callable[[int], bool]:
    text = re.sub(r"\s+", "", text.lower())
    text = {"odd": "2n+1", "even": "2n"}.get(text, text)
    m = re.fullmatch(r"([+-]?\d*)n([+-]\d+)?|([+-]?\d+)", text)
    if not m:
        raise SelectorError(f"bad position: {text!r}")
    if m[3]:
        k = int(m[3])
        return lambda i: i == k
    a = int(m[1] + "1") if m[1] in ("", "+", "-") else int(m[1])
    b = int(m[2] or 0)
    return lambda i: (i - b) * (a > 0) - (i - b) * (a < 0) >= 0 and (i == b if a == 0 else (i - b) % a == 0)


_FIXED: dict[str, Test] = {
    "first-child": lambda e: _place(e, False, False) == 1,
    "last-child": lambda e: _place(e, False, True) == 1,
    "only-child": lambda e: len(_siblings(e, False)) == 1,
    "first-of-type": lambda e: _place(e, True, False) == 1,
    "last-of-type": lambda e: _place(e, True, True) == 1,
    "only-of-type": lambda e: len(_siblings(e, True)) == 1,
    "empty": lambda e: not any(not isinstance(c, str) or c for c in e.children),
    "root": lambda e: e.parent is not None and e.parent.tag == "#document",
    "checked": lambda e: "checked" in e.attrs or "selected" in e.attrs,
    "disabled": lambda e: "disabled" in e.attrs,
    "enabled": lambda e: e.tag in ("input", "button", "select", "textarea", "option") and "disabled" not in e.attrs,
    "link": lambda e: e.tag in ("a", "area") and "href" in e.attrs,
}


def _unescape(s: str) -> str:
    return re.sub(r"\\(.)", r"\1", s)


class _Parser:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    def fail(self):
        raise SelectorError(f"bad selector at {self.at}: {self.text!r}")

    def argument(self) -> str:
        depth, start = 1, self.at
        while self.at < len(self.text):
            c = self.text[self.at]
            depth += (c == "(") - (c == ")")
            self.at += 1
            if not depth:
                return self.text[start : self.at - 1]
        self.fail()

    def pseudo(self, m: re.Match) -> Test:
        name = m["pseudo"].lower()
        if m["colon"]:
            self.fail()
        if not m["call"]:
            if name not in _FIXED:
                self.fail()
            return _FIXED[name]
        arg = self.argument()
        if name in ("not", "is", "where", "matches"):
            inner = compile_selector(arg)
            return (lambda e: not inner.matches(e)) if name == "not" else inner.matches
        if name == "has":
            arg = arg.strip()
            inner = compile_selector(arg.lstrip("> ")) if not arg.startswith(("+", "~")) else self.fail()
            return (lambda e: any(map(inner.matches, e.elements()))) if arg.startswith(">") else (lambda e: any(map(inner.matches, e.descendants())))
        if name == "contains":
            word = arg.strip().strip("'\"")
            return lambda e: word in e.text()
        for kind, same, last in (("nth-child", False, False), ("nth-last-child", False, True), ("nth-of-type", True, False), ("nth-last-of-type", True, True)):
            if name == kind:
                check = _nth(arg)
                return lambda e: check(_place(e, same, last))
        self.fail()

    def selectors(self) -> list[tuple[list[list[Test]], list[str]]]:
        text = self.text = self.text.strip()
        out, compounds, combs = [], [[]], []
        if not text:
            self.fail()
        while self.at < len(text):
            m = _TOKEN.match(text, self.at)
            if not m or m.end() == self.at:
                self.fail()
            self.at = m.end()
            if m["space"] is not None:
                if not compounds[-1]:
                    self.fail()
                if m["comb"] == ",":
                    out.append((compounds, combs))
                    compounds, combs = [[]], []
                else:
                    combs.append(m["comb"] or " ")
                    compounds.append([])
                continue
            if m["tag"]:
                if compounds[-1]:
                    self.fail()
                tag = _unescape(m["tag"]).lower()
                compounds[-1].append(lambda e, tag=tag: e.tag == tag)
            elif m["star"]:
                compounds[-1].append(lambda e: e.tag != "#document")
            elif m["id"]:
                own = _unescape(m["id"])
                compounds[-1].append(lambda e, own=own: e.attrs.get("id") == own)
            elif m["cls"]:
                own = _unescape(m["cls"])
                compounds[-1].append(lambda e, own=own: own in e.attrs.get("class", "").split())
            elif m["attr"]:
                value = next((m[k] for k in ("dq", "sq", "bare") if m[k] is not None), "")
                compounds[-1].append(_attr(_unescape(m["attr"]), m["op"], value, (m["flag"] or "").lower() == "i"))
            else:
                compounds[-1].append(self.pseudo(m))
        if not compounds[-1]:
            self.fail()
        return [*out, (compounds, combs)]


class Selector:
    def __init__(self, text: str):
        self.alternatives = _Parser(text).selectors()

    @staticmethod
    def _holds(e: Element, compounds: list[list[Test]], combs: list[str], i: int) -> bool:
        if not all(t(e) for t in compounds[i]):
            return False
        if i == 0:
            return True
        kind = combs[i - 1]
        if kind in "> ":
            up = e.parent
            while up is not None and up.tag != "#document":
                if Selector._holds(up, compounds, combs, i - 1):
                    return True
                if kind == ">":
                    return False
                up = up.parent
            return False
        line = _siblings(e, False)
        k = next(k for k, c in enumerate(line) if c is e)
        before = line[k - 1 : k] if kind == "+" else line[:k]
        return any(Selector._holds(c, compounds, combs, i - 1) for c in before)

    def matches(self, e: Element) -> bool:
        return any(self._holds(e, c, k, len(c) - 1) for c, k in self.alternatives)

    def iter(self, scope: Element) -> Iterator[Element]:
        return (e for e in scope.descendants() if self.matches(e))

    def first(self, scope: Element) -> Element | None:
        return next(self.iter(scope), None)


@lru_cache(1024)
def compile_selector(text: str) -> Selector:
    """Raises SelectorError on a selector that isn't understood."""
    return Selector(text)
