"""String patterns as columns: whether, how often and where they match."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidPattern
from ..lang.model import MatchDetail, StringPattern
from .regex import Compiled, finditer, translate

HIT = "struct<matched_text:string,start_pos:bigint,end_pos:bigint>"


@dataclass(frozen=True)
class Search:
    """One search of a pattern: in the text as it is, or (stripped) without its NUL characters."""

    compiled: Compiled
    literal: str | None
    stripped: bool


def searches(p: StringPattern) -> list[Search]:
    """The searches whose hits, one list after the other, are the pattern's. Raises InvalidPattern."""
    nocase, wide, fullword = (m in p.modifiers for m in ("nocase", "wide", "fullword"))
    escaped = p.pattern if p.is_regex else re.sub(r"([^\w\s\0])", r"\\\1", p.pattern)
    out = []
    if "ascii" in p.modifiers or not wide:
        plain = None if p.is_regex or nocase or fullword or not p.pattern else p.pattern
        out.append(Search(translate(escaped, nocase, "dotall" in p.modifiers, fullword), plain, False))
    if wide and p.is_regex:
        out.append(Search(translate(p.pattern, nocase, False, fullword), None, True))
    elif wide:
        spread = "".join(c + "\0" for c in p.pattern)
        plain = None if nocase or fullword or not p.pattern else spread
        out.append(Search(translate("".join(re.sub(r"([^\w\s])", r"\\\1", c) + r"\x00" for c in p.pattern), nocase, False, fullword), plain, False))
    return out


def valid(p: StringPattern) -> bool:
    try:
        return searches(p) is not None
    except InvalidPattern:
        return False


# -- plain Python, for the evaluator and for what the JVM cannot do ------------------------------


def find(p: StringPattern, text: str) -> list[MatchDetail]:
    """All hits with byte offsets."""
    out = []
    for search in searches(p):
        out += [MatchDetail(p.identifier, m, a, b) for m, a, b in _hits(search, text)]
    return out


def _hits(search: Search, text: str) -> list[tuple[str, int, int]]:
    begins = range(len(text) + 1) if text.isascii() else [0, *accumulate(len(c.encode("utf-8", "surrogatepass")) for c in text)]
    if not search.stripped:
        return [(m[0], begins[m.start()], begins[m.end()]) for m in finditer(search.compiled, text)]
    # Offsets are those of the characters that stay, and the end of the text.
    stay = [i for i, c in enumerate(text) if c != "\0"] + [len(text)]
    return [(m[0], begins[stay[m.start()]], begins[stay[m.end()]]) for m in finditer(search.compiled, text.replace("\0", ""))]


# -- columns --------------------------------------------------------------------------------


def _udf(search: Search, detail: bool):
    def count(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else len(_hits(search, t)), na_action="ignore").astype("Int64")

    def hits(texts: pd.Series) -> pd.Series:
        keys = ("matched_text", "start_pos", "end_pos")
        return texts.map(lambda t: None if t is None else [dict(zip(keys, h)) for h in _hits(search, t)])

    return F.pandas_udf(hits, f"array<{HIT}>") if detail else F.pandas_udf(count, "bigint")


def _native(search: Search) -> bool:
    return search.compiled.java is not None and not search.compiled.nullable


def _source(search: Search, text: Column) -> Column:
    return F.translate(text, "\0", "") if search.stripped else text


def _likely(search: Search, text: Column) -> Column:
    """False where a match is impossible, as it would have a literal that the text doesn't have."""
    needed = search.compiled.required
    return F.contains(_source(search, text), F.lit(needed)) if needed else F.lit(True)


def exists(p: StringPattern, text: Column) -> Column:
    """Whether the pattern has a hit; never null for text that is not."""
    found = []
    for s in searches(p):
        if s.literal is not None:
            found.append(F.contains(text, F.lit(s.literal)))
        elif s.compiled.java is not None:
            found.append(_likely(s, text) & _source(s, text).rlike(s.compiled.java))
        else:
            found.append(_udf(s, False)(text) > 0)
    return _either(found)


def _either(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out | p
    return out


def count(p: StringPattern, text: Column) -> Column:
    """The number of hits, BIGINT."""
    total = F.lit(0).cast("bigint")
    for s in searches(p):
        if s.literal is not None:
            n = (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(s.literal), F.lit("")))) / len(s.literal.encode())
        elif _native(s):
            n = F.when(_likely(s, text), F.regexp_count(_source(s, text), F.lit(s.compiled.java))).otherwise(F.when(text.isNotNull(), 0))
        else:
            n = _udf(s, False)(text)
        total = total + n.cast("bigint")
    return total


def details(p: StringPattern, text: Column) -> Column:
    """array<struct<identifier, matched_text, start_pos, end_pos, score, explanation>>; null text gives none."""
    parts = []
    for s in searches(p):
        if _native(s) and not s.stripped:
            found = F.regexp_extract_all(text, F.lit(s.compiled.java), F.lit(0))
            hits = bound(F.struct(found.alias("hits"), F.split(text, s.compiled.java, -1).alias("gaps")), lambda both: _placed(p, both["hits"], both["gaps"]))  # noqa: B023
            hits = F.when(_likely(s, text), hits).otherwise(F.when(text.isNotNull(), empty_details()))
        else:
            hits = F.transform(_udf(s, True)(text), lambda h: _hit(p, h["matched_text"], h["start_pos"], h["end_pos"]))
        parts.append(hits)
    return F.coalesce(parts[0] if len(parts) == 1 else F.concat(*parts), empty_details())


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where a value that body uses several times is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _placed(p: StringPattern, hits: Column, gaps: Column) -> Column:
    """Details of hits, from what stands before each of them, in one pass."""
    nothing = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("starts"))
    sizes = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.struct(F.octet_length(g).alias("gap"), F.octet_length(h).alias("hit")))
    add = lambda done, x: F.struct((done["at"] + x["gap"] + x["hit"]).alias("at"), F.array_append(done["starts"], done["at"] + x["gap"]).alias("starts"))
    starts = F.aggregate(sizes, nothing, add)["starts"]
    return F.zip_with(hits, starts, lambda h, start: _hit(p, h, start, start + F.octet_length(h)))


def _hit(p: StringPattern, text: Column, start: Column, end: Column) -> Column:
    return detail(F.lit(p.identifier), text, start.cast("bigint"), end.cast("bigint"), F.lit(1.0), F.lit(""))


def detail(identifier: Column, text: Column, start: Column, end: Column, score: Column, explanation: Column) -> Column:
    return F.struct(identifier.alias("identifier"), text.alias("matched_text"), start.alias("start_pos"), end.alias("end_pos"), score.alias("score"), explanation.alias("explanation"))


def empty_details() -> Column:
    return F.array().cast("array<struct<identifier:string,matched_text:string,start_pos:bigint,end_pos:bigint,score:double,explanation:string>>")
