"""Rules as data, and the Spark types of results."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

MODIFIERS = ("nocase", "wide", "ascii", "dotall", "fullword")

MATCH_DETAIL = T.StructType(
    [
        T.StructField("identifier", T.StringType()),
        T.StructField("matched_text", T.StringType()),
        T.StructField("start_pos", T.LongType()),
        T.StructField("end_pos", T.LongType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("explanation", T.StringType()),
    ]
)
MATCH = T.StructType(
    [
        T.StructField("rule_idx", T.IntegerType()),
        T.StructField("rule_name", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("meta", T.MapType(T.StringType(), T.StringType())),
        T.StructField("matched", T.BooleanType()),
        T.StructField("matched_patterns", T.MapType(T.StringType(), T.ArrayType(MATCH_DETAIL))),
        T.StructField("errors", T.ArrayType(T.StringType())),
    ]
)


@dataclass(frozen=True)
class StringPattern:
    identifier: str
    pattern: str
    modifiers: frozenset[str] = frozenset()
    is_regex: bool = False


@dataclass(frozen=True)
class SimilarityPattern:
    identifier: str
    pattern: str
    threshold: float = 0.8
    cleaner: str = "default_cleaning"
    chunker: str = "no_chunking"
    matcher: str = "sbert"


@dataclass(frozen=True)
class HashPattern:
    identifier: str
    file_path: str
    threshold: float = 0.9
    hasher: str = "imagehash"


@dataclass(frozen=True)
class ClassifierPattern:
    identifier: str
    pattern: str
    threshold: float = 0.7
    cleaner: str = "default_cleaning"
    chunker: str = "no_chunking"
    classifier: str = "tuned-sbert"


@dataclass(frozen=True)
class ChatPattern:
    identifier: str
    pattern: str
    llm: str = "openai-api-compatible"
    cleaner: str = "no_op"
    chunker: str = "no_chunking"


@dataclass
class Rule:
    name: str
    tags: list[str] = field(default_factory=list)
    meta: dict[str, str] = field(default_factory=dict)
    strings: list[StringPattern] = field(default_factory=list)
    similarity: list[SimilarityPattern] = field(default_factory=list)
    phash: list[HashPattern] = field(default_factory=list)
    classifier: list[ClassifierPattern] = field(default_factory=list)
    chat: list[ChatPattern] = field(default_factory=list)
    condition: str = ""
    expression: object = None

    def patterns(self) -> list:
        return [*self.strings, *self.similarity, *self.phash, *self.classifier, *self.chat]

    def identifiers(self) -> list[str]:
        """Declared identifiers of all families, sorted."""
        return sorted({p.identifier for p in self.patterns()})


@dataclass(frozen=True)
class MatchDetail:
    identifier: str
    matched_text: str
    start_pos: int | None = None
    end_pos: int | None = None
    score: float = 1.0
    explanation: str = ""


@dataclass
class Match:
    rule_name: str
    tags: list[str]
    meta: dict[str, str]
    matched: bool
    matched_patterns: dict[str, list[MatchDetail]]

    def __str__(self) -> str:
        hits = sum(map(len, self.matched_patterns.values()))
        return f"Match(rule='{self.rule_name}', matched={str(self.matched).lower()}, patterns={hits})"
