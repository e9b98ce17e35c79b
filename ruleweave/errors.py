"""What can go wrong, from reading rules to running them."""

from __future__ import annotations


class RuleweaveError(Exception):
    """Base of all errors of this package."""


class RuleFileNotFound(RuleweaveError):
    """A rule file does not exist."""


class FileReadError(RuleweaveError):
    """A file exists but cannot be read."""


class RuleSyntaxError(RuleweaveError):
    """Rule text is malformed."""


class DuplicateIdentifier(RuleweaveError):
    """A rule declares one identifier twice."""


class UndefinedIdentifier(RuleweaveError):
    """A condition uses an identifier that its rule does not declare."""


class InvalidPattern(RuleweaveError):
    """A regular expression is outside the dialect or malformed."""


class ConditionSyntaxError(RuleweaveError):
    """A condition is malformed or mixes booleans and integers."""


class ComponentNotFound(RuleweaveError):
    """A rule names a cleaner, chunker or model that is not registered."""

    def __init__(self, kind: str, name: str) -> None:
        super().__init__(f"no {kind} named {name!r}")
        self.kind, self.name = kind, name


class SemanticError(RuleweaveError):
    """An embedding could not be had."""


class ClassifierError(RuleweaveError):
    """A classifier failed."""


class ChatError(RuleweaveError):
    """A language model gave no usable answer."""


class PerceptualHashError(RuleweaveError):
    """A file could not be hashed."""
