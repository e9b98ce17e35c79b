"""The condition language: tokens, syntax tree, types, and a plain evaluator."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from ..errors import ConditionSyntaxError

_TOKEN = re.compile(r"\s*(?:(?P<num>[0-9]+)|(?P<ref>[$#]\w+)|(?P<word>[A-Za-z_]\w*)|(?P<any>\$(?=\s*\*))|(?P<op>==|!=|<=|>=|[-+<>(),*]))")
_REFERENCE = re.compile(r"[$#]\w+")
COMPARISONS = ("==", "!=", "<", "<=", ">", ">=")
MAX_INT = (1 << 63) - 1


class Node:
    """A part of a condition."""


@dataclass(frozen=True)
class Has(Node):
    identifier: str


@dataclass(frozen=True)
class Count(Node):
    identifier: str


@dataclass(frozen=True)
class Number(Node):
    value: int


@dataclass(frozen=True)
class Not(Node):
    inner: Node


@dataclass(frozen=True)
class Negative(Node):
    inner: Node


@dataclass(frozen=True)
class Both(Node):
    left: Node
    right: Node


@dataclass(frozen=True)
class Either(Node):
    left: Node
    right: Node


@dataclass(frozen=True)
class Compare(Node):
    left: Node
    op: str
    right: Node


@dataclass(frozen=True)
class Sum(Node):
    left: Node
    op: str
    right: Node


@dataclass(frozen=True)
class Members(Node):
    """`any of` or `all of` a set: `names` if given, else all identifiers that begin with `prefix`."""

    every: bool
    names: tuple[str, ...] | None
    prefix: str = "$"

    def resolve(self, declared: list[str]) -> list[str]:
        return list(self.names) if self.names is not None else [i for i in sorted(declared) if i.startswith(self.prefix)]


def tokens(text: str) -> list[str]:
    out, at = [], 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            raise ConditionSyntaxError(f"unexpected character {text[at:].strip()[0]!r} in condition")
        if m["num"] and int(m["num"]) > MAX_INT:
            raise ConditionSyntaxError(f"integer {m['num']} is out of range")
        out.append(m[0].strip())
        at = m.end()
    return out


class _Reader:
    """Lowest to highest: or, and, not, comparison, + and -, negative, the rest."""

    def __init__(self, text: str) -> None:
        self.items, self.at = tokens(text), 0

    def peek(self) -> str:
        return self.items[self.at] if self.at < len(self.items) else ""

    def take(self, what: str = "") -> str:
        found = self.peek()
        if not found or (what and found != what):
            raise ConditionSyntaxError(f"expected {what or 'an operand'}, found {found or 'the end'}")
        self.at += 1
        return found

    def either(self) -> Node:
        return self.chain("or", Either, self.both)

    def both(self) -> Node:
        return self.chain("and", Both, self.negated)

    def chain(self, word: str, join: type[Node], part: Callable[[], Node]) -> Node:
        """Parts joined by a word, as a balanced tree: its depth grows with the logarithm of their number."""
        nodes = [part()]
        while self.peek() == word:
            self.take()
            nodes.append(part())
        while len(nodes) > 1:
            nodes = [join(*pair) if len(pair) > 1 else pair[0] for pair in (nodes[i : i + 2] for i in range(0, len(nodes), 2))]
        return nodes[0]

    def negated(self) -> Node:
        if self.peek() == "not":
            self.take()
            return Not(self.compared())
        return self.compared()

    def compared(self) -> Node:
        node = self.added()
        if self.peek() in COMPARISONS:
            return Compare(node, self.take(), self.added())
        return node

    def added(self) -> Node:
        node = self.signed()
        while self.peek() in ("+", "-"):
            node = Sum(node, self.take(), self.signed())
        return node

    def signed(self) -> Node:
        depth = 0
        while self.peek() == "-":
            self.take()
            depth += 1
        node = self.operand()
        for _ in range(depth):
            node = Negative(node)
        return node

    def operand(self) -> Node:
        t = self.take()
        if t == "(":
            node = self.either()
            self.take(")")
            return node
        if t[0] == "$" and len(t) > 1:
            return Has(t)
        if t[0] == "#":
            return Count("$" + t[1:])
        if t.isdigit():
            return Number(int(t))
        if t in ("any", "all"):
            self.take("of")
            return self.members(t == "all")
        raise ConditionSyntaxError(f"unexpected {t!r} in condition")

    def members(self, every: bool) -> Node:
        if self.peek() == "them":
            self.take()
            return Members(every, None)
        self.take("(")
        first = self.take()
        if first[0] != "$":
            raise ConditionSyntaxError(f"a set holds $ identifiers, found {first!r}")
        if self.peek() == "*":
            self.take()
            self.take(")")
            return Members(every, None, first)
        names = [first]
        while self.peek() == ",":
            self.take()
            name = self.take()
            if name[0] != "$" or name == "$":
                raise ConditionSyntaxError(f"a set holds $ identifiers, found {name!r}")
            names.append(name)
        self.take(")")
        if names == ["$"]:
            raise ConditionSyntaxError("a set holds $ identifiers, found '$'")
        return Members(every, tuple(names))


def parse(text: str) -> Node:
    """The syntax tree of a condition; errors name what is wrong."""
    reader = _Reader(text)
    try:
        node = reader.either()
        if reader.peek():
            raise ConditionSyntaxError(f"unexpected {reader.peek()!r} after the condition")
        if kind(node) is not bool:
            raise ConditionSyntaxError("type error: a condition must be boolean")
    except RecursionError:
        raise ConditionSyntaxError("the condition is nested too deeply") from None
    return node


def kind(node: Node) -> type:
    """bool or int; raises where a part has the wrong one."""

    def need(part: Node, want: type, where: str) -> None:
        if kind(part) is not want:
            raise ConditionSyntaxError(f"type error: {where} needs {'a boolean' if want is bool else 'an integer'}")

    match node:
        case Has() | Members():
            return bool
        case Count() | Number():
            return int
        case Not(inner):
            need(inner, bool, "not")
            return bool
        case Negative(inner):
            need(inner, int, "-")
            return int
        case Both(a, b) | Either(a, b):
            need(a, bool, "and / or")
            need(b, bool, "and / or")
            return bool
        case Compare(a, op, b):
            need(a, int, op)
            need(b, int, op)
            return bool
        case Sum(a, op, b):
            need(a, int, op)
            need(b, int, op)
            return int
    raise TypeError(node)


def references(text: str) -> list[str]:
    """Identifiers with their sigils, as written; a name directly followed by * is a prefix."""
    return [m[0] for m in _REFERENCE.finditer(text) if text[m.end() : m.end() + 1] != "*"]


def wrap(value: int) -> int:
    """To a 64-bit two's complement integer."""
    return (value + (1 << 63)) % (1 << 64) - (1 << 63)


def evaluate(node: Node, counts: Mapping[str, int], assumed: str | None = None):
    """The value of a condition over hit counts by identifier, of all that are declared. `assumed` is
    taken to have matched where presence is asked."""
    has = lambda i: i == assumed or counts.get(i, 0) > 0
    again = lambda n: evaluate(n, counts, assumed)
    match node:
        case Has(i):
            return has(i)
        case Count(i):
            return counts.get(i, 0)
        case Number(v):
            return v
        case Not(inner):
            return not again(inner)
        case Negative(inner):
            return wrap(-again(inner))
        case Both(a, b):
            return again(a) and again(b)
        case Either(a, b):
            return again(a) or again(b)
        case Compare(a, op, b):
            x, y = again(a), again(b)
            return {"==": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
        case Sum(a, op, b):
            x, y = again(a), again(b)
            return wrap(x + y if op == "+" else x - y)
        case Members(every, _, _):
            ids = node.resolve(list(counts))
            return bool(ids) and all(map(has, ids)) if every else any(map(has, ids))
    raise TypeError(node)


def parts(node: Node):
    """The node and all below it."""
    yield node
    for name in ("inner", "left", "right"):
        if (below := getattr(node, name, None)) is not None:
            yield from parts(below)


def counted(node: Node) -> set[str]:
    """Identifiers whose number of hits matters."""
    return {n.identifier for n in parts(node) if isinstance(n, Count)}


def is_needed(identifier: str, node: Node, counts: Mapping[str, int]) -> bool:
    """Whether a costly pattern can still make the condition true: it is counted, or the condition
    holds if it matches and all that has not run does not."""
    return identifier in counted(node) or bool(evaluate(node, counts, identifier))
