"""Conditions as columns over hit counts."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lang import condition as C

#: Literals beyond this could leave 64 bits when hit counts are added; then sums run in decimals.
SAFE = 1 << 40


def demand(node: C.Node, declared: list[str]) -> dict[str, str]:
    """For each identifier that a condition asks about: "count" or "exists"."""
    out: dict[str, str] = {}
    for part in C.parts(node):
        ids = [part.identifier] if isinstance(part, C.Has) else part.resolve(declared) if isinstance(part, C.Members) else []
        for i in ids:
            out.setdefault(i, "exists")
    return out | dict.fromkeys(C.counted(node), "count")


def lower(node: C.Node, has: Mapping[str, Column], count: Mapping[str, Column], declared: list[str]) -> Column:
    """A boolean column. has and count: a column for each identifier; one that is missing has no hits."""
    wide = any(isinstance(n, C.Number) and n.value > SAFE for n in C.parts(node))
    return _Lowering(has, count, declared, wide).boolean(node)


class _Lowering:
    def __init__(self, has, count, declared, wide: bool) -> None:
        self.has, self.count, self.declared, self.wide = has, count, declared, wide
        self.kind = "decimal(38,0)" if wide else "bigint"

    def boolean(self, n: C.Node) -> Column:
        constant = self.constant(n)
        if constant is not None:
            return F.lit(constant)
        match n:
            case C.Has(i):
                return self.has.get(i, F.lit(False))
            case C.Not(inner):
                return ~self.boolean(inner)
            case C.Both(a, b):
                return self.boolean(a) & self.boolean(b)
            case C.Either(a, b):
                return self.boolean(a) | self.boolean(b)
            case C.Members():
                found = [self.has.get(i, F.lit(False)) for i in n.resolve(self.declared)]
                return reduce(lambda x, y: x & y if n.every else x | y, found)
            case C.Compare(a, op, b):
                x, y = self.compared(a), self.compared(b)
                return {"==": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
        raise TypeError(n)

    def constant(self, n: C.Node) -> bool | None:
        """The value of a part that asks about no identifier, or about an empty set."""
        if isinstance(n, C.Members) and not n.resolve(self.declared):
            return False
        if any(isinstance(p, (C.Has, C.Count, C.Members)) for p in C.parts(n)):
            return None
        return C.evaluate(n, {})

    def compared(self, n: C.Node) -> Column:
        x = self.integer(n)
        if not self.wide:
            return x
        # Sums are exact in decimals; wrap once, as adding wraps to the same either way.
        two63, two64 = (F.lit(str(1 << k)).cast("decimal(38,0)") for k in (63, 64))
        return F.pmod(x + two63, two64) - two63

    def integer(self, n: C.Node) -> Column:
        match n:
            case C.Number(v):
                return F.lit(str(v)).cast(self.kind) if self.wide else F.lit(v).cast("bigint")
            case C.Count(i):
                return self.count.get(i, F.lit(0)).cast(self.kind)
            case C.Negative(inner):
                return -self.integer(inner)
            case C.Sum(a, op, b):
                x, y = self.integer(a), self.integer(b)
                return (x + y if op == "+" else x - y).cast(self.kind)
        raise TypeError(n)


def undecided(node: C.Node, has: Mapping[str, Column], count: Mapping[str, Column], declared: list[str], pending: set[str]) -> Column:
    """Whether the condition could go either way, whatever the pending identifiers turn out to be."""
    true, false = _Decided(has, count, declared, pending).boolean(node)
    return ~(true | false)


class _Decided:
    """Pairs (surely true, surely false), by three-valued logic."""

    def __init__(self, has, count, declared, pending) -> None:
        self.known = _Lowering(has, count, declared, False)  # set anew for each comparison
        self.declared, self.pending = declared, pending

    def one(self, i: str) -> tuple[Column, Column]:
        if i in self.pending:
            return F.lit(False), F.lit(False)
        x = self.known.has.get(i, F.lit(False))
        return x, ~x

    def boolean(self, n: C.Node) -> tuple[Column, Column]:
        both = lambda p, q: (p[0] & q[0], p[1] | q[1])
        either = lambda p, q: (p[0] | q[0], p[1] & q[1])
        match n:
            case C.Has(i):
                return self.one(i)
            case C.Not(inner):
                t, f = self.boolean(inner)
                return f, t
            case C.Both(a, b):
                return both(self.boolean(a), self.boolean(b))
            case C.Either(a, b):
                return either(self.boolean(a), self.boolean(b))
            case C.Members():
                ids = n.resolve(self.declared)
                return reduce(both if n.every else either, map(self.one, ids)) if ids else (F.lit(False), F.lit(True))
            case C.Compare():
                if C.counted(n) & self.pending:
                    return F.lit(False), F.lit(False)
                self.known.wide = any(isinstance(p, C.Number) and p.value > SAFE for p in C.parts(n))
                self.known.kind = "decimal(38,0)" if self.known.wide else "bigint"
                x = self.known.boolean(n)
                return x, ~x
        raise TypeError(n)
