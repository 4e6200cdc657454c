"""XPath 1.0 over the HTML tree: location paths on the abbreviated and common axes, predicates, the core string, number and boolean functions, unions."""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

from quarry.functions.dom import Element

_TOKEN = re.compile(r"\s*(?:(?P<num>\d+(?:\.\d*)?|\.\d+)|(?P<str>\"[^\"]*\"|'[^']*')|(?P<op>::|//|\.\.|!=|<=|>=|[/.@()\[\],|=<>+*-])|(?P<name>[A-Za-z_][\w.-]*(?::[A-Za-z_][\w.-]*)?))")


class XPathError(ValueError):
    pass


@dataclass(frozen=True)
class Attribute:
    owner: Element
    name: str
    value: str


@dataclass(frozen=True)
class Text:
    owner: Element
    place: int
    value: str


Node = Element | Attribute | Text


def string(v) -> str:
    if isinstance(v, list):
        return string(v[0]) if v else ""
    if isinstance(v, Element):
        return v.text()
    if isinstance(v, (Attribute, Text)):
        return v.value
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return ("-" * (v < 0) + "Infinity") if math.isinf(v) else str(int(v)) if v == int(v) else repr(v)
    return v


def number(v) -> float:
    if isinstance(v, bool):
        return float(v)
    if isinstance(v, float):
        return v
    s = string(v).strip(" \t\r\n")
    return float(s) if re.fullmatch(r"-?(\d+(\.\d*)?|\.\d+)", s) else math.nan


def boolean(v) -> bool:
    return bool(v) and not (isinstance(v, float) and math.isnan(v))


def _compare(op: str, a, b) -> bool:
    if isinstance(a, list) and not isinstance(b, bool):
        return any(_compare(op, string(x), b) for x in a)
    if isinstance(b, list) and not isinstance(a, bool):
        return any(_compare(op, a, string(x)) for x in b)
    if op in ("=", "!="):
        if isinstance(a, bool) or isinstance(b, bool):
            same = boolean(a) == boolean(b)
        elif isinstance(a, float) or isinstance(b, float):
            same = number(a) == number(b)
        else:
            same = string(a) == string(b)
        return same == (op == "=")
    x, y = number(a), number(b)
    return {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]


def _substring(s: str, start: float, length: float = math.inf) -> str:
    first = math.floor(start + 0.5)
    end = math.inf if math.isinf(length) else first + math.floor(length + 0.5)
    return "".join(c for i, c in enumerate(s, 1) if first <= i < end)


FUNCTIONS: dict[str, Callable] = {
    "contains": lambda c, a, b: string(b) in string(a),
    "starts-with": lambda c, a, b: string(a).startswith(string(b)),
    "normalize-space": lambda c, a=None: " ".join(re.split(r"[ \t\r\n]+", string(c.node if a is None else a))).strip(),
    "string": lambda c, a=None: string(c.node if a is None else a),
    "string-length": lambda c, a=None: float(len(string(c.node if a is None else a))),
    "concat": lambda c, *a: "".join(map(string, a)),
    "substring": lambda c, a, b, n=math.inf: _substring(string(a), number(b), n if n is math.inf else number(n)),
    "substring-before": lambda c, a, b: string(a).partition(string(b))[0] if string(b) in string(a) else "",
    "substring-after": lambda c, a, b: string(a).partition(string(b))[2],
    "translate": lambda c, a, b, t: string(a).translate({ord(x): string(t)[i] if i < len(string(t)) else None for i, x in reversed(list(enumerate(string(b))))}),
    "not": lambda c, a: not boolean(a),
    "boolean": lambda c, a: boolean(a),
    "true": lambda c: True,
    "false": lambda c: False,
    "number": lambda c, a=None: number(c.node if a is None else a),
    "count": lambda c, a: float(len(a)),
    "sum": lambda c, a: float(sum(map(number, a))),
    "position": lambda c: float(c.place),
    "last": lambda c: float(c.size),
    "name": lambda c, a=None: _name((a or [c.node])[0] if a != [] else None),
    "local-name": lambda c, a=None: _name((a or [c.node])[0] if a != [] else None),
    "floor": lambda c, a: float(math.floor(number(a))),
    "ceiling": lambda c, a: float(math.ceil(number(a))),
    "round": lambda c, a: float(math.floor(number(a) + 0.5)),
}


def _name(n) -> str:
    return n.tag if isinstance(n, Element) else n.name if isinstance(n, Attribute) else ""


@dataclass
class Context:
    node: Node
    place: int = 1
    size: int = 1


def _texts(e: Element) -> list[Text]:
    return [Text(e, i, c) for i, c in enumerate(e.children) if isinstance(c, str)]


def _children(n: Node) -> list[Node]:
    return [Text(n, i, c) if isinstance(c, str) else c for i, c in enumerate(n.children)] if isinstance(n, Element) else []


def _parent(n: Node) -> Element | None:
    return n.parent if isinstance(n, Element) else n.owner


def _below(n: Node) -> list[Node]:
    out: list[Node] = []
    for c in _children(n):
        out.append(c)
        out += _below(c)
    return out


def _above(n: Node) -> list[Node]:
    out, up = [], _parent(n)
    while up is not None:
        out.append(up)
        up = up.parent
    return out


def _beside(n: Node, step: int) -> list[Node]:
    up = _parent(n)
    if up is None or isinstance(n, Attribute):
        return []
    line = _children(up)
    i = next(k for k, c in enumerate(line) if c is n or (isinstance(n, Text) and c == n))
    return line[i + 1 :] if step > 0 else line[:i][::-1]


AXES: dict[str, Callable[[Node], list[Node]]] = {
    "child": _children,
    "descendant": _below,
    "descendant-or-self": lambda n: [n, *_below(n)],
    "self": lambda n: [n],
    "parent": lambda n: [p] if (p := _parent(n)) is not None else [],
    "ancestor": _above,
    "ancestor-or-self": lambda n: [n, *_above(n)],
    "attribute": lambda n: [Attribute(n, k, v) for k, v in n.attrs.items()] if isinstance(n, Element) else [],
    "following-sibling": lambda n: _beside(n, 1),
    "preceding-sibling": lambda n: _beside(n, -1),
}


class _Compiler:
    def __init__(self, text: str):
        self.tokens, at = [], 0
        text = text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise XPathError(f"bad XPath at {at}: {text!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.tokens.append(("end", ""))
        self.i = 0

    def peek(self, *values: str) -> bool:
        kind, v = self.tokens[self.i]
        return kind in ("op", "name") and v in values

    def take(self, *values: str) -> bool:
        if self.peek(*values):
            self.i += 1
            return True
        return False

    def need(self, value: str) -> None:
        if not self.take(value):
            raise XPathError(f"{value!r} expected before {self.tokens[self.i][1]!r}")

    def binary(self, below: Callable, table: dict[str, Callable]) -> Callable:
        left = below()
        while self.peek(*table):
            f = table[self.tokens[self.i][1]]
            self.i += 1
            right = below()
            left = (lambda c, f=f, a=left, b=right: f(c, a, b))
        return left

    def expr(self):
        return self.binary(self.conjunction, {"or": lambda c, a, b: boolean(a(c)) or boolean(b(c))})

    def conjunction(self):
        return self.binary(self.comparison, {"and": lambda c, a, b: boolean(a(c)) and boolean(b(c))})

    def comparison(self):
        return self.binary(self.additive, {op: (lambda c, a, b, op=op: _compare(op, a(c), b(c))) for op in ("=", "!=", "<", "<=", ">", ">=")})

    def additive(self):
        return self.binary(self.multiplicative, {"+": lambda c, a, b: number(a(c)) + number(b(c)), "-": lambda c, a, b: number(a(c)) - number(b(c))})

    def multiplicative(self):
        return self.binary(
            self.unary,
            {"*": lambda c, a, b: number(a(c)) * number(b(c)), "div": lambda c, a, b: number(a(c)) / number(b(c)) if number(b(c)) else math.nan, "mod": lambda c, a, b: math.fmod(number(a(c)), number(b(c))) if number(b(c)) else math.nan},
        )

    def unary(self):
        if self.take("-"):
            inner = self.unary()
            return lambda c: -number(inner(c))
        return self.binary(self.path, {"|": lambda c, a, b: _ordered([*a(c), *b(c)])})

    def path(self):
        kind, v = self.tokens[self.i]
        after = self.tokens[self.i + 1][1] if self.i + 1 < len(self.tokens) else ""
        if kind in ("num", "str") or v == "(" or (kind == "name" and after == "(" and v not in ("text", "node", "comment")):
            start = self.primary()
            while self.peek("["):
                start = self.filtered(start)
            if not self.peek("/", "//"):
                return start
            steps = self.steps()
            return lambda c: _walk(start(c), steps)
        if self.peek("/", "//"):
            if v == "/" and not self._starts_step(self.i + 1):
                self.i += 1
                return lambda c: [_root(c.node)]
            steps = self.steps()
            return lambda c: _walk([_root(c.node)], steps)
        steps = self.steps(relative=True)
        return lambda c: _walk([c.node], steps)

    def _starts_step(self, i: int) -> bool:
        kind, v = self.tokens[i]
        return kind == "name" or v in (".", "..", "@", "*")

    def primary(self):
        kind, v = self.tokens[self.i]
        self.i += 1
        if kind == "num":
            return lambda c: float(v)
        if kind == "str":
            return lambda c: v[1:-1]
        if v == "(":
            inner = self.expr()
            self.need(")")
            return inner
        if v not in FUNCTIONS:
            raise XPathError(f"unknown function {v}()")
        self.need("(")
        args = []
        while not self.take(")"):
            args.append(self.expr())
            if not self.peek(")"):
                self.need(",")
        f = FUNCTIONS[v]
        return lambda c: f(c, *(a(c) for a in args))

    def predicate(self):
        self.need("[")
        p = self.expr()
        self.need("]")
        return p

    def filtered(self, start):
        p = self.predicate()
        return lambda c: _filter(start(c), p)

    def steps(self, relative: bool = False) -> list[tuple]:
        out = []
        if relative:
            out.append(self.step())
        while self.peek("/", "//"):
            if self.take("//"):
                out.append((AXES["descendant-or-self"], lambda n: True, [], False))
            else:
                self.i += 1
            out.append(self.step())
        return out

    def step(self) -> tuple:
        if self.take("."):
            return AXES["self"], lambda n: True, [], False
        if self.take(".."):
            return AXES["parent"], lambda n: True, [], False
        axis = "child"
        if self.take("@"):
            axis = "attribute"
        elif self.tokens[self.i][0] == "name" and self.tokens[self.i + 1][1] == "::":
            axis = self.tokens[self.i][1]
            if axis not in AXES:
                raise XPathError(f"unknown axis {axis}")
            self.i += 2
        kind, v = self.tokens[self.i]
        self.i += 1
        main = Attribute if axis == "attribute" else Element
        if v == "*" and kind == "op":
            test = lambda n: isinstance(n, main) and _name(n) != "#document"
        elif kind == "name" and self.peek("(") and v in ("text", "node", "comment"):
            self.i += 1
            self.need(")")
            test = {"text": lambda n: isinstance(n, Text), "node": lambda n: True, "comment": lambda n: False}[v]
        elif kind == "name":
            own = v.lower()
            test = lambda n: isinstance(n, main) and _name(n) == own
        else:
            raise XPathError(f"a step expected before {v!r}")
        predicates = []
        while self.peek("["):
            predicates.append(self.predicate())
        return AXES[axis], test, predicates, axis in ("ancestor", "ancestor-or-self", "preceding-sibling")


def _root(n: Node) -> Element:
    return (n if isinstance(n, Element) else n.owner).root()


def _filter(nodes: list, p) -> list:
    out = []
    for i, n in enumerate(nodes, 1):
        v = p(Context(n, i, len(nodes)))
        if (v == i) if isinstance(v, float) else boolean(v):
            out.append(n)
    return out


def _key(n: Node):
    return (id(n),) if isinstance(n, Element) else (id(n.owner), n.name if isinstance(n, Attribute) else n.place)


def _unique(nodes: list[Node]) -> list[Node]:
    seen: dict = {}
    for n in nodes:
        seen.setdefault(_key(n), n)
    return list(seen.values())


def _ordered(nodes: list[Node]) -> list[Node]:
    """Distinct nodes in document order."""
    nodes = _unique(nodes)
    if len(nodes) < 2:
        return nodes
    place: dict = {}
    for i, n in enumerate([_root(nodes[0]), *_below(_root(nodes[0]))]):
        place[_key(n)] = i
    return sorted(nodes, key=lambda n: (place.get(_key(n), place.get((id(_parent(n)),), 0)), isinstance(n, Attribute)))


def _walk(nodes: list, steps: list[tuple]) -> list:
    for axis, test, predicates, backwards in steps:
        out: list[Node] = []
        for n in nodes:
            found = [m for m in axis(n) if test(m)]
            for p in predicates:
                found = _filter(found, p)
            out += found
        nodes = _unique(out)
        if backwards or len(steps) > 1:
            nodes = _ordered(nodes) if backwards else nodes
    return nodes


@lru_cache(1024)
def compile_xpath(text: str) -> Callable[[Node], object]:
    """Raises XPathError on an expression that isn't understood."""
    c = _Compiler(text)
    run = c.expr()
    if c.tokens[c.i][0] != "end":
        raise XPathError(f"{c.tokens[c.i][1]!r} not expected")
    return lambda node: run(Context(node))


def first_value(text: str, scope: Element, attribute: str | None = None) -> str | None:
    """The attribute of the first node found, or its trimmed text; null if nothing is found, the text is empty or the expression is bad."""
    try:
        found = compile_xpath(text)(scope)
    except (XPathError, TypeError, IndexError, RecursionError):
        return None
    if isinstance(found, list):
        if not found:
            return None
        if attribute is not None and isinstance(found[0], Element):
            return found[0].attrs.get(attribute.lower())
    return string(found).strip() or None
