"""A plain Python evaluator for one text: what scans are tested against, and what the SQL table function runs."""

from __future__ import annotations

from .engine import RuleSet
from .errors import RuleweaveError
from .functions.chunkers import chunk_text
from .functions.cleaners import clean_text
from .functions.vectors import cosine_of
from .lang import condition as C
from .lang.model import Match, MatchDetail, Rule
from .plans import strings


def scan_text(rules: RuleSet, text: str) -> list[Match]:
    """The matches of every rule, in source order. Only built-in cleaners and chunkers are known here."""
    return [_run(rules, n, r, text) for n, r in enumerate(rules.rules)]


def _run(rules: RuleSet, n: int, rule: Rule, text: str) -> Match:
    hits: dict[str, list[MatchDetail]] = {p.identifier: [] for p in rule.patterns()}
    get = rules.registry.get
    for p in rule.strings:
        if (n, p.identifier) not in rules.invalid:
            hits[p.identifier] = strings.find(p, text)
    chunks = lambda p: [c for c in chunk_text(p.chunker, clean_text(p.cleaner, text)) if c]
    for p in rule.similarity:
        try:
            first, *rest = get("matcher", p.matcher).embed([p.pattern, *(parts := chunks(p))])
            scores = [cosine_of(first, v) for v in rest]
            hits[p.identifier] = [MatchDetail(p.identifier, c, score=s, explanation=f"Semantic similarity: {s:.3f}") for c, s in zip(parts, scores) if s >= p.threshold and p.pattern]
        except RuleweaveError:
            pass
    for p in rule.classifier:
        try:
            scores = get("classifier", p.classifier).score(p.pattern, parts := chunks(p))
            hits[p.identifier] = [MatchDetail(p.identifier, c, score=s, explanation=f"Classifier confidence: {s:.3f}") for c, s in zip(parts, scores) if s >= p.threshold and p.pattern]
        except RuleweaveError:
            pass
    if rule.expression is not None:
        for p in rule.chat:
            if C.is_needed(p.identifier, rule.expression, {i: len(h) for i, h in hits.items()}):
                try:
                    answers = get("llm", p.llm).ask(p.pattern, parts := chunks(p))
                    hits[p.identifier] = [MatchDetail(p.identifier, c, explanation=why) for c, (yes, why) in zip(parts, answers) if yes]
                except RuleweaveError:
                    pass
    matched = rule.expression is not None and bool(C.evaluate(rule.expression, {i: len(h) for i, h in hits.items()}))
    return Match(rule.name, rule.tags, rule.meta, matched, hits if matched else {})
