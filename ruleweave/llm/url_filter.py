"""URL filters: a broadcast trie over reversed host labels and path segments.

A rule is (host, path, verdict). It fits its host and all subdomains when the URL's path starts with
the rule's path. The longest rule wins: the one with more host labels, then the longer path; of the
same host and path given twice, block wins, else the last.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from ..plans.partitions import spread
from ..shipping import Shared
from .common import in_tasks, materialize

#: Rules of one trie; more rules are judged in several passes, so that one trie of bounded size is
#: broadcast at a time. The longest rule of all passes wins.
TRIE_RULES = 200_000
TO_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass(slots=True)
class PathNode:
    """Below a host: whole segments lead on; `ends` are last segments that may be cut short, and `sizes`
    their different lengths, largest first."""

    children: dict[str, PathNode] = field(default_factory=dict)
    ends: dict[str, tuple[str, str]] = field(default_factory=dict)
    sizes: tuple[int, ...] = ()

    def end(self, segment: str) -> str | None:
        """The longest end that the segment begins with."""
        return next((segment[:n] for n in self.sizes if n <= len(segment) and segment[:n] in self.ends), None)


@dataclass(slots=True)
class HostNode:
    children: dict[str, HostNode] = field(default_factory=dict)
    path: PathNode | None = None


def build_trie(rules: list[tuple[str, str, str]]) -> HostNode:
    root = HostNode()
    for host, path, verdict in rules:
        node = root
        for label in reversed(host.translate(TO_LOWER).split(".")) if host else ():
            node = node.children.setdefault(label, HostNode())
        node.path = node.path or PathNode()
        at = node.path
        *whole, last = path.split("/")
        for segment in whole:
            at = at.children.setdefault(segment, PathNode())
        if at.ends.get(last, ("", ""))[1] != "block":
            at.ends[last] = (host + path, verdict)
            if len(last) not in at.sizes:
                at.sizes = tuple(sorted({*at.sizes, len(last)}, reverse=True))
    return root


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null or without "://"."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    rest = rest.partition("#")[0].partition("?")[0]
    host, slash, path = rest.partition("/")
    return host.translate(TO_LOWER), slash + path


def lookup(root: HostNode, host: str, path: str) -> tuple[int, int, str, str] | None:
    """(host labels, length of the path, rule, verdict) of the longest rule that fits."""
    chain, node = [root], root
    for label in reversed(host.split(".")) if host else ():
        node = node.children.get(label)
        if node is None:
            break
        chain.append(node)
    segments = path.split("/")
    for depth in range(len(chain) - 1, -1, -1):
        found, size, at, before = None, 0, chain[depth].path, 0
        for segment in segments:
            if at is None:
                break
            if (end := at.end(segment)) is not None:  # a last rule segment may stop inside this one
                found, size = at.ends[end], before + len(end)
            at = at.children.get(segment)
            before += len(segment) + 1
        if found:
            return depth, size, *found
    return None


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], default: str = "allow", key: str = "page_id") -> DataFrame:
    """key, host, path, rule, verdict of every row of pages.

    rule is null where none fits; the verdict is then `default`. A null url or one without "://" has
    an empty host and path. Every row gives one row, repeated and null keys too; an empty table gives
    none. Only key and url are read.
    """
    rules = [(h.translate(TO_LOWER), p, v) for h, p, v in rules]
    kind = pages.schema[key].dataType.simpleString()
    names = [key, "host", "path", "rule", "verdict", "depth", "size"]
    schema = f"{key} {kind}, host string, path string, rule string, verdict string, depth int, size int"

    def run_with(shared, first: bool):
        def run(batches):
            root = shared.value
            for batch in batches:
                if first:
                    places, best = [split_url(u) for u in batch["url"].to_pylist()], [(-1, -1, None, default)] * batch.num_rows
                else:
                    places = list(zip(batch["host"].to_pylist(), batch["path"].to_pylist()))
                    best = list(zip(*(batch[c].to_pylist() for c in ("depth", "size", "rule", "verdict"))))
                for i, place in enumerate(places):
                    found = lookup(root, *place)
                    if found and (found[:2] > best[i][:2] or found[:2] == best[i][:2] and best[i][3] != "block"):
                        best[i] = found
                cols = [*zip(*places), *([x[k] for x in best] for k in (2, 3))] if places else [()] * 4
                sizes = [pa.array([x[k] for x in best], pa.int32()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([batch[key], *(pa.array(c, pa.string()) for c in cols), *sizes], names)

        return run

    out = None
    for i in range(0, max(1, len(rules)), TRIE_RULES):
        shared = Shared(pages.sparkSession.sparkContext, build_trie(rules[i : i + TRIE_RULES]))
        out = in_tasks(spread(pages.select(key, "url")) if out is None else materialize(out, "judged"), run_with(shared, out is None), schema)
    return out.select(*names[:5])
