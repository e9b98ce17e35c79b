"""Regular expressions of rules, translated for the JVM and for Python.

Rules use a linear-time dialect: Unicode classes, no look-around or back-references, "." stops at
newlines only, "$" is the very end. The translation spells that out for each engine.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import regex

from ..errors import InvalidPattern
from ..shipping import Cache

#: Fixed: ASCII members of the bracketed classes.
POSIX = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": r"\x00-\x7F", "blank": r"\t ", "cntrl": r"\x00-\x1F\x7F", "digit": "0-9", "graph": "!-~",
    "lower": "a-z", "print": " -~", "punct": r"!-/:-@\[-`{-~", "space": r"\t\n\x0B\f\r ", "upper": "A-Z", "word": "0-9A-Za-z_", "xdigit": "0-9A-Fa-f",
}
#: Fixed: long names of general categories.
CATEGORIES = {
    "letter": "L", "mark": "M", "number": "N", "punctuation": "P", "symbol": "S", "separator": "Z", "other": "C",
    "uppercase_letter": "Lu", "lowercase_letter": "Ll", "titlecase_letter": "Lt", "decimal_number": "Nd", "letter_number": "Nl",
}
_SHORT = re.compile(r"(L[ultmo]?|M[nce]?|N[dlo]?|P[cdseifo]?|S[mcko]?|Z[slp]?|C[cfson]?)$")


@dataclass(frozen=True)
class Compiled:
    """java: for the JVM, or None where only Python has it. python: for the regex module. nullable: it
    can match nothing, which the engines count differently. required: a literal that every match has,
    or None; looking for it first is much faster."""

    java: str | None
    python: str
    nullable: bool
    required: str | None = None


class _Translator:
    def __init__(self, pattern: str, dotall: bool) -> None:
        self.p, self.i = pattern, 0
        self.multi, self.swap, self.dot = False, False, dotall
        self.java_ok = True

    def fail(self, why: str):
        raise InvalidPattern(f"{self.p!r}: {why}")

    def run(self) -> str:
        out = self.branch(0)
        if self.i < len(self.p):
            self.fail("unopened group")
        return out

    def branch(self, depth: int) -> str:
        """Alternatives up to a closing parenthesis; flags set inside end with it."""
        saved = self.multi, self.swap, self.dot
        out: list[str] = []  # finished atoms
        opened: list[str] = []  # flags set in this group, each as a group of its own
        while self.i < len(self.p):
            c = self.p[self.i]
            if c == ")" and depth:
                break
            if c == ")":
                self.fail("unopened group")
            if c in "*+?" or (c == "{" and re.match(r"\{\d+(,\d*)?\}", self.p[self.i :])):
                if not out or out[-1] == "|" or out[-1] in opened or out[-1].startswith((")|", "|(")):
                    self.fail("nothing to repeat")
                out[-1] = self.repeated(out[-1])
                continue
            if c == "{":
                self.fail("a repetition needs a number")
            atom = self.atom(depth)
            if atom == "|":
                atom = ")" * len(opened) + "|" + "".join(opened)
            elif re.fullmatch(r"\(\?[ix-]+:", atom):
                opened.append(atom)
            if atom:
                out.append(atom)
        self.multi, self.swap, self.dot = saved
        return "".join(out) + ")" * len(opened)

    def repeated(self, atom: str) -> str:
        m = re.match(r"[*+?]|\{(\d+)(,(\d*))?\}", self.p[self.i :])
        self.i += m.end()
        if m[1] and m[3] and int(m[3]) < int(m[1]):
            self.fail("a repetition ends before it begins")
        lazy = self.p.startswith("?", self.i)
        self.i += lazy
        out = atom + m[0] + ("?" if lazy != self.swap else "")
        if self.i < len(self.p) and self.p[self.i] in "*+?":
            out = f"(?:{out})"  # repeated again
        return out

    def atom(self, depth: int) -> str:
        c = self.p[self.i]
        self.i += 1
        if c == "^":
            return r"(?<![^\n])" if self.multi else r"\A"
        if c == "$":
            return r"(?![^\n])" if self.multi else r"\z"
        if c == ".":
            return r"(?:[^\n]|\n)" if self.dot else r"[^\n]"
        if c == "|":
            return c
        if c == "[":
            return self.charset()
        if c == "\\":
            return self.escape(False)
        if c == "(":
            return self.group(depth)
        return c

    def group(self, depth: int) -> str:
        head = re.match(r"\?(?:P?<([A-Za-z_][\w.\[\]]*)>|([a-zA-Z-]*)([:)]))", self.p[self.i :])
        if self.p.startswith("?", self.i) and (not head or self.p[self.i + 1 : self.i + 3] in ("<=", "<!")):
            self.fail("look-around is not supported")
        opening = "("
        if head:
            self.i += head.end()
            if head[1]:
                opening = f"(?<{re.sub('[^A-Za-z0-9]', '', head[1])}>"
            else:
                saved = self.multi, self.swap, self.dot
                passed = self.flags(head[2])
                if head[3] == ")":
                    return passed and f"(?{passed}:"
                opening = f"(?{passed}:"
                body = self.branch(depth + 1)
                self.multi, self.swap, self.dot = saved
                return self.closed(opening, body)
        return self.closed(opening, self.branch(depth + 1))

    def closed(self, opening: str, body: str) -> str:
        if not self.p.startswith(")", self.i):
            self.fail("unclosed group")
        self.i += 1
        return f"{opening}{body})"

    def flags(self, text: str) -> str:
        """Take in what is spelled out by the translation; give back what the engines take."""
        on, _, off = text.partition("-")
        for names, value in ((on, True), (off, False)):
            for f in names:
                if f == "m":
                    self.multi = value
                elif f == "s":
                    self.dot = value
                elif f == "U":
                    self.swap = value
                elif f == "u":
                    if not value:
                        self.fail("byte classes are not supported")
                elif f not in "ix":
                    self.fail(f"unknown flag {f}")
        keep = ["".join(f for f in names if f in "ix") for names in (on, off)]
        return keep[0] + ("-" + keep[1] if keep[1] else "")

    def escape(self, inside: bool) -> str:
        if self.i >= len(self.p):
            self.fail("it ends in a backslash")
        c = self.p[self.i]
        self.i += 1
        if c in "pP":
            m = re.match(r"\{\^?([^}]*)\}|(\w)", self.p[self.i :])
            if not m:
                self.fail("unfinished property")
            negated = (c == "P") != self.p.startswith("{^", self.i)
            self.i += m.end()
            name = (m[1] or m[2]).split("=")[-1].strip()
            short = CATEGORIES.get(name.lower().replace(" ", "_"), name)
            return f"\\{'P' if negated else 'p'}{{{short if _SHORT.match(short) else 'Is' + name}}}"
        if c in "dDwWsS" or (c in "bB" and not inside):
            return "\\" + c
        if c in "Az" and not inside:
            return "\\" + c
        if c in "aftnr":
            return "\\" + c
        if c == "v":
            return r"\x0B"
        if c in "xuU":
            m = re.match(r"\{([0-9A-Fa-f]+)\}", self.p[self.i :]) or re.match(r"([0-9A-Fa-f]{%d})" % {"x": 2, "u": 4, "U": 8}[c], self.p[self.i :])
            if not m or int(m[1], 16) > 0x10FFFF:
                self.fail("malformed code point")
            self.i += m.end()
            return r"\x{%X}" % int(m[1], 16)
        if c.isalnum():
            self.fail(f"\\{c} is not supported")
        return "\\" + c

    def charset(self) -> str:
        out = "["
        if self.p.startswith("^", self.i):
            out, self.i = "[^", self.i + 1
        if self.p.startswith("]", self.i):
            out, self.i = out + "\\]", self.i + 1
        while True:
            if self.i >= len(self.p):
                self.fail("unclosed class")
            c = self.p[self.i]
            if c == "]":
                self.i += 1
                return out + "]"
            if m := re.match(r"\[:(\^?)([a-z]+):\]", self.p[self.i :]):
                if m[2] not in POSIX:
                    self.fail(f"unknown class {m[2]}")
                self.i += m.end()
                out += f"[{m[1]}{POSIX[m[2]]}]"
            elif c == "[":
                self.i += 1
                out += self.charset()
            elif self.p.startswith(("--", "~~"), self.i):
                self.java_ok = False
                out, self.i = out + self.p[self.i : self.i + 2], self.i + 2
            elif self.p.startswith("&&", self.i):
                out, self.i = out + "&&", self.i + 2
            elif c == "\\":
                self.i += 1
                out += self.escape(True)
            else:
                out += c
                self.i += 1


def _for_python(java: str) -> str:
    out = re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: r"\U%08X" % int(m[1], 16), java)
    out = re.sub(r"\\z", r"\\Z", out)
    return re.sub(r"\(\?<([A-Za-z])", r"(?P<\1", out)


def translate(pattern: str, nocase: bool = False, dotall: bool = False, fullword: bool = False) -> Compiled:
    """Raises InvalidPattern for what is outside the dialect."""
    key = pattern, nocase, dotall, fullword
    if key not in _TRANSLATED:
        _TRANSLATED[key] = _translate(*key)
    return _TRANSLATED[key]


def _translate(pattern: str, nocase: bool, dotall: bool, fullword: bool) -> Compiled:
    t = _Translator(pattern, dotall)
    body = t.run()
    if fullword:
        body = rf"\b(?:{body})\b"
    python = ("(?i)" if nocase else "") + _for_python(body)
    try:
        compiled = python_pattern(python)
    except (regex.error, RecursionError, OverflowError) as e:
        raise InvalidPattern(f"{pattern!r}: {e}") from None
    return Compiled(("(?Udiu)" if nocase else "(?Ud)") + body if t.java_ok else None, python, _nullable(python, compiled), _required(python))


def _nested(python: str) -> bool:
    """Whether it may have sets within sets, which only the regex module's newer syntax reads."""
    return re.search(r"\[[^\]]*(?:\[|&&|--|~~)", python) is not None


_PATTERNS, _TRANSLATED = Cache(), Cache()


def python_pattern(python: str):
    if python not in _PATTERNS:
        _PATTERNS[python] = regex.compile(python, regex.V1 if _nested(python) else regex.V0)
    return _PATTERNS[python]


def _nullable(python: str, compiled) -> bool:
    try:
        if not _nested(python):
            return re._parser.parse(python).getwidth()[0] == 0
    except Exception:  # what only the regex module reads is probed
        pass
    return any(m.start() == m.end() for s in ("", "a", "a b", "1\n", "é-") for m in compiled.finditer(s))


#: Shorter literals are in most texts.
LEAST_REQUIRED = 3


def _required(python: str) -> str | None:
    """The longest run of characters that every match has, as far as the pattern's outer sequence tells."""
    try:
        tree = None if _nested(python) else re._parser.parse(python)
    except Exception:  # what only the regex module reads
        return None
    if tree is None or tree.state.flags & re.IGNORECASE:
        return None
    runs = [""]

    def walk(sequence) -> None:
        for op, what in sequence:
            name = str(op)
            if name == "LITERAL":
                runs[-1] += chr(what)
            elif name == "SUBPATTERN" and not (what[1] | what[2]) & re.IGNORECASE:
                walk(what[3])
            elif name not in ("AT", "ASSERT", "ASSERT_NOT"):
                runs.append("")

    walk(tree)
    best = max(runs, key=len)
    return best if len(best) >= LEAST_REQUIRED and best.isprintable() else None


def finditer(compiled: Compiled, text: str):
    """Leftmost matches without overlap; an empty one right after a match is none."""
    last = -1
    for m in python_pattern(compiled.python).finditer(text):
        if m.end() > m.start() or m.start() != last:
            yield m
        last = m.end()
