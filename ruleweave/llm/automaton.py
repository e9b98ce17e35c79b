"""One deterministic automaton for many regular expressions, over bytes.

Supported: literals, escapes, classes of ASCII characters, groups, |, ?, *, +, {m}, {m,}, {m,n} and
(?i:...). Rules are parsed to an NFA, joined by subset construction and minimised; the result is
transition arrays over byte classes. A scanning automaton has an implied "any prefix" and tells where
matches end; that of the reversed pattern, run backwards, tells where they begin; an anchored one, run
from there, how far the longest goes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

ESCAPES = {"n": 10, "r": 13, "t": 9}


class _Parser:
    """Builds NFA fragments: states hold (byte set, target) edges and empty moves."""

    def __init__(self) -> None:
        self.edges: list[list[tuple[frozenset[int], int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.edges.append([])
        self.empty.append([])
        return len(self.edges) - 1

    def rule(self, pattern: str) -> tuple[int, int]:
        self.p, self.i, self.fold = pattern, 0, False
        out = self.alternatives()
        if self.i < len(self.p):
            raise ValueError(f"unexpected {self.p[self.i]!r} at {self.i} of {pattern!r}")
        return out

    def peek(self) -> str:
        return self.p[self.i] if self.i < len(self.p) else ""

    def alternatives(self):
        parts = [self.sequence()]
        while self.peek() == "|":
            self.i += 1
            parts.append(self.sequence())
        if len(parts) == 1:
            return parts[0]
        a, b = self.state(), self.state()
        for x, y in parts:
            self.empty[a].append(x)
            self.empty[y].append(b)
        return a, b

    def sequence(self):
        a = b = self.state()
        while self.peek() not in ("", "|", ")"):
            x, y = self.repeat()
            self.empty[b].append(x)
            b = y
        return a, b

    def repeat(self):
        start, fold = self.i, self.fold
        frag = self.atom()
        end, low, high = self.i, 1, 1
        c = self.peek()
        if c and c in "?*+":
            low, high = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
            self.i += 1
        elif c == "{":
            stop = self.p.index("}", self.i)
            a, comma, b = self.p[self.i + 1 : stop].partition(",")
            low, high = int(a), (int(b) if b else None) if comma else int(a)
            self.i = stop + 1
        else:
            return frag
        after = self.i

        def again():
            self.i, self.fold = start, fold
            out = self.atom()
            assert self.i == end
            return out

        first = last = self.state()
        for _ in range(low):
            x, y = again()
            self.empty[last].append(x)
            last = y
        if high is None:
            x, y = again()
            stop = self.state()
            self.empty[last] += [x, stop]
            self.empty[y] += [x, stop]
            last = stop
        else:
            stop = self.state()
            for _ in range(high - low):
                x, y = again()
                self.empty[last] += [x, stop]
                last = y
            self.empty[last].append(stop)
            last = stop
        self.i = after
        return first, last

    def atom(self):
        c = self.peek()
        self.i += 1
        if c == "(":
            fold = self.fold
            if self.p.startswith("?i:", self.i):
                self.fold, self.i = True, self.i + 3
            elif self.p.startswith("?:", self.i):
                self.i += 2
            out = self.alternatives()
            if self.peek() != ")":
                raise ValueError(f"missing ) in {self.p!r}")
            self.i += 1
            self.fold = fold
            return out
        if c == "[":
            return self.leaf(self.charset())
        if c == "\\":
            return self.leaf({self.escape()})
        if not c.isascii():
            a = b = self.state()
            for x in c.encode():
                n = self.state()
                self.edges[b].append((frozenset({x}), n))
                b = n
            return a, b
        return self.leaf({ord(c)})

    def escape(self) -> int:
        c = self.peek()
        self.i += 1
        if c == "x":
            self.i += 2
            return int(self.p[self.i - 2 : self.i], 16)
        return ESCAPES.get(c, ord(c))

    def charset(self) -> set[int]:
        out: set[int] = set()
        while self.peek() != "]":
            a = self.peek()
            self.i += 1
            low = self.escape() if a == "\\" else ord(a)
            if self.peek() == "-" and self.p[self.i + 1] != "]":
                self.i += 1
                b = self.peek()
                self.i += 1
                out |= set(range(low, (self.escape() if b == "\\" else ord(b)) + 1))
            else:
                out.add(low)
        self.i += 1
        return out

    def reversed(self) -> _Parser:
        out = _Parser()
        for _ in self.edges:
            out.state()
        for s, (edges, empty) in enumerate(zip(self.edges, self.empty)):
            for chars, t in edges:
                out.edges[t].append((chars, s))
            for t in empty:
                out.empty[t].append(s)
        return out

    def leaf(self, chars: set[int]):
        if self.fold:
            chars = chars | {x ^ 32 for x in chars if 65 <= x & ~32 <= 90}
        a, b = self.state(), self.state()
        self.edges[a].append((frozenset(chars), b))
        return a, b


@dataclass
class Automaton:
    """step[state * width + klass[byte]]: the next state; 0 is the start. accepts[state]: a bit for
    each rule that a match of ends here."""

    klass: np.ndarray
    width: int
    step: np.ndarray
    accepts: np.ndarray


def build(patterns: list[str], anchored: bool = False, backwards: bool = False) -> Automaton:
    """anchored: a match begins at the first byte. backwards: for texts read from their end."""
    nfa = _Parser()
    ends: dict[int, int] = {}
    starts = []
    for i, p in enumerate(patterns):
        a, b = nfa.rule(p)
        a, b = (b, a) if backwards else (a, b)
        starts.append(a)
        ends[b] = ends.get(b, 0) | 1 << i
    if backwards:
        nfa = nfa.reversed()

    reach: dict[int, frozenset[int]] = {}

    def closure(s: int) -> frozenset[int]:
        if s not in reach:
            seen, todo = {s}, [s]
            while todo:
                for t in nfa.empty[todo.pop()]:
                    if t not in seen:
                        seen.add(t)
                        todo.append(t)
            reach[s] = frozenset(x for x in seen if nfa.edges[x] or x in ends)
        return reach[s]

    # Bytes that no edge tells apart form a class.
    sets = list(dict.fromkeys(chars for es in nfa.edges for chars, _ in es))
    signature = [tuple(b in s for s in sets) for b in range(256)]
    kinds = {s: i for i, s in enumerate(dict.fromkeys(signature))}
    klass = np.array([kinds[s] for s in signature], np.uint8)
    sample = [signature.index(s) for s in kinds]

    first = frozenset().union(*(closure(s) for s in starts))
    ids, todo, rows = {first: 0}, [first], []
    while todo:
        now = todo.pop(0)
        row = []
        for b in sample:
            to = set() if anchored else set(first)
            for s in now:
                for chars, t in nfa.edges[s]:
                    if b in chars:
                        to |= closure(t)
            key = frozenset(to)
            if key not in ids:
                ids[key] = len(ids)
                todo.append(key)
            row.append(ids[key])
        rows.append(row)
    label = np.zeros(len(ids), np.int64)
    for i, key in enumerate(ids):
        for s in key:
            label[i] |= ends.get(s, 0)
    table, label = _minimise(np.array(rows), label)
    return Automaton(klass, table.shape[1], table.astype(np.int32).ravel(), label.astype(np.uint32))


def separators(patterns: list[str]) -> np.ndarray:
    """For each byte whether no pattern has it anywhere, so that no match spans it."""
    nfa = _Parser()
    for p in patterns:
        nfa.rule(p)
    out = np.ones(256, bool)
    for chars in (c for es in nfa.edges for c, _ in es):
        out[list(chars)] = False
    return out


def _minimise(table: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Split blocks of states until all states of a block move alike; the start keeps number 0."""
    block = np.unique(label, return_inverse=True)[1]
    while True:
        key = np.column_stack([block, block[table]])
        new = np.unique(key, axis=0, return_inverse=True)[1].ravel()
        if new.max() == block.max():
            break
        block = new
    order = list(dict.fromkeys([int(block[0]), *map(int, block)]))
    number = np.empty(len(order), int)
    number[order] = range(len(order))
    block = number[block]
    member = np.array([int(np.flatnonzero(block == b)[0]) for b in range(len(order))])
    return block[table[member]], label[member]


def pieces(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray, length: int = 256) -> np.ndarray:
    """Where pieces begin, and the end of data: at each text, and about every `length` bytes after a
    separator. No match spans two pieces."""
    after = np.flatnonzero(separator[data]) + 1
    if len(after):
        grid = np.searchsorted(after, np.arange(length, len(data), length))
        after = after[np.unique(grid[grid < len(after)])]
    return np.unique(np.concatenate([offsets, after, [0, len(data)]]))


class Reader:
    """An automaton as lists, for reading few bytes one by one."""

    def __init__(self, auto: Automaton) -> None:
        self.klass = auto.klass.astype(np.uint8).tobytes()
        self.rows = auto.step.reshape(-1, auto.width).tolist()
        self.accepts = auto.accepts.tolist()
        self.dead = next((i for i, row in enumerate(self.rows) if not self.accepts[i] and set(row) == {i}), -1)

    def longest(self, text: bytes, at: int, stop: int) -> int:
        """End of the longest match that begins at `at`, anchored; -1 if none does."""
        state, end = 0, at if self.accepts[0] else -1
        for i in range(at, stop):
            state = self.rows[state][self.klass[text[i]]]
            if state == self.dead:
                break
            if self.accepts[state]:
                end = i + 1
        return end

    def places(self, text: bytes) -> list[int]:
        """Places where matches end, or begin if this automaton is for reading backwards and text is reversed."""
        state, out, rows, accepts = 0, [], self.rows, self.accepts
        for i, c in enumerate(text.translate(self.klass), 1):
            state = rows[state][c]
            if accepts[state]:
                out.append(i)
        return out

    def rules(self, text: bytes) -> int:
        """A bit for each rule that has a match."""
        state, found, rows, accepts = 0, self.accepts[0], self.rows, self.accepts
        for c in text.translate(self.klass):
            state = rows[state][c]
            if accepts[state]:
                found |= accepts[state]
        return found


#: Pieces of more bytes are read one by one.
LONG = 4096


def scan(data: np.ndarray, cuts: np.ndarray, auto: Automaton) -> np.ndarray:
    """A bit for each rule that has a match in a piece: all pieces move on together, one byte a step."""
    hits = np.zeros(len(cuts) - 1, np.uint32)
    size = np.diff(cuts)
    reader = None
    for i in np.flatnonzero(size > LONG):
        reader = reader or Reader(auto)
        hits[i] = reader.rules(data[cuts[i] : cuts[i + 1]].tobytes())
    short = np.flatnonzero(size <= LONG)
    order = short[np.argsort(-size[short], kind="stable")]
    at, size = cuts[:-1][order], size[order]
    live = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), "left")  # pieces longer than t
    symbol = auto.klass[data]
    state, found = np.zeros(len(at), np.int32), np.zeros(len(at), np.uint32)
    width = auto.width
    for t, n in enumerate(live):
        s = state[:n]
        np.take(auto.step, s * width + symbol[at[:n] + t], out=s)
        found[:n] |= auto.accepts[s]
    hits[order] = found
    return hits
