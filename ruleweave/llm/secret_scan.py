"""Secret scans: all rules in one automaton, one pass over the bytes of every text.

The pass marks short pieces of text in which a rule ends a match. In a marked piece the rule's own
automata give its spans: the reversed one all places where a match begins, the anchored one the longest
match from the leftmost of these; then the search goes on after it, so that spans of a kind don't overlap.
"""

from __future__ import annotations

import bisect
import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..plans.partitions import spread
from ..shipping import Shared
from . import automaton
from .common import in_tasks, slices, utf8


@dataclass(frozen=True)
class Rule:
    """A match is `prefix` and then `body`; it counts if what follows the longest prefix has at least
    `least` characters. `scan` is a small pattern that is found in every match that counts."""

    kind: str
    body: str
    least: int = 0
    scan: str = ""
    prefix: str = ""

    @property
    def pattern(self) -> str:
        return self.prefix + self.body


#: Fixed patterns and least lengths of the three base kinds.
BASE = (
    Rule("assign", r"[A-Za-z0-9+/_.=-]+", 6, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]""", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?"""),
    Rule("access", r"AKIA[A-Z0-9]+", 20, r"AKIA[A-Z0-9]"),
    Rule("hex", r"[0-9a-f]+", 24, r"[0-9a-f]{24}"),
)
#: Kinds that the operator adds: published token formats.
ADDED = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40, r"gh[pousr]_"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 15, r"xox[abprs]-"),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 39, r"AIza"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40, r"eyJ[A-Za-z0-9_-]+\.eyJ"),
)


@dataclass(frozen=True)
class Compiled:
    all: automaton.Automaton  # of the scan patterns
    separator: np.ndarray  # bytes that no rule has
    begin: tuple[automaton.Reader, ...]  # of each rule reversed
    whole: tuple[automaton.Reader, ...]  # of each rule, anchored
    prefix: tuple[automaton.Reader, ...]


def compile_rules(rules: tuple[Rule, ...]) -> Compiled:
    read = lambda pattern, **how: automaton.Reader(automaton.build([pattern], **how))
    return Compiled(
        automaton.build([r.scan or r.pattern for r in rules]),
        automaton.separators([r.pattern for r in rules]),
        tuple(read(r.pattern, backwards=True) for r in rules),
        tuple(read(r.pattern, anchored=True) for r in rules),
        tuple(read(r.prefix, anchored=True) for r in rules),
    )


def spans_of(text: bytes, rule: int, least: int, compiled: Compiled) -> list[tuple[int, int]]:
    """Matches of a rule in a piece that count: leftmost first, the longest from each place."""
    begins = [len(text) - i for i in reversed(compiled.begin[rule].places(text[::-1]))]
    out, at = [], 0
    while (n := bisect.bisect_left(begins, at)) < len(begins):
        start = begins[n]
        end = compiled.whole[rule].longest(text, start, len(text))
        if end - max(start, compiled.prefix[rule].longest(text, start, end - 1)) >= least:
            out.append((start, end))
        at = max(end, start + 1)
    return out


def find(data: np.ndarray, offsets: np.ndarray, rules: tuple[Rule, ...], compiled: Compiled) -> list[list[tuple[int, int, int]]]:
    """(start, rule number, end) of every match of each text, in code points of that text."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(offsets) - 1)]
    if not len(data):
        return out
    cuts = automaton.pieces(data, offsets, compiled.separator)
    hits = automaton.scan(data, cuts, compiled.all)
    marked = np.flatnonzero(hits)
    owner = np.searchsorted(offsets, cuts[marked], "right") - 1
    for i, doc in zip(marked, owner):
        text = data[cuts[i] : cuts[i + 1]].tobytes()
        base = int(cuts[i] - offsets[doc])
        for k, rule in enumerate(rules):
            if hits[i] >> k & 1:
                out[doc] += [(base + a, k, base + b) for a, b in spans_of(text, k, rule.least, compiled)]
    for doc in np.unique(owner):
        # Bytes that don't begin a code point, up to each place.
        more = np.concatenate([[0], np.cumsum((data[offsets[doc] : offsets[doc + 1]] & 0xC0) == 0x80)])
        out[doc] = sorted((a - int(more[a]), k, b - int(more[b])) for a, k, b in out[doc])
    return out


def secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE + ADDED, base: int = len(BASE)) -> DataFrame:
    """Secrets of every whole text; null counts as empty. One row per row, repeated and null ids too.

    doc_id; n_<kind> of the first `base` rules; base_sha256 over their spans; spans: kind:start:end of
    all, by start, then as the rules are listed, comma-joined. Offsets are code points, end exclusive.
    An empty table gives no rows. Only doc_id and text are read.
    """
    names = [r.kind for r in rules]
    shared = Shared(docs.sparkSession.sparkContext, compile_rules(rules))

    def run(batches):
        compiled = shared.value
        for batch in slices(batches, "text"):
            found = find(*utf8(batch["text"]), rules, compiled)
            join = lambda spans: ",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans)
            counts = [pa.array([sum(s[1] == k for s in spans) for spans in found], pa.int64()) for k in range(base)]
            digest = [hashlib.sha256(join([s for s in spans if s[1] < base]).encode()).hexdigest() for spans in found]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], *counts, pa.array(digest, pa.string()), pa.array([join(s) for s in found], pa.string())],
                ["doc_id", *(f"n_{k}" for k in names[:base]), "base_sha256", "spans"],
            )

    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in names[:base]) + ", base_sha256 string, spans string"
    return in_tasks(spread(docs.select("doc_id", "text")), run, schema)
