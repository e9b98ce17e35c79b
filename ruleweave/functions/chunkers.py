"""Chunkers: column functions from text to array<string>. A text that yields nothing is one chunk."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .cleaners import white_split, white_strip


def _trim(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def _kept(parts: Column, text: Column) -> Column:
    kept = F.filter(F.transform(parts, _trim), lambda x: x != "")
    return F.when(F.size(kept) == 0, F.array(text)).otherwise(kept)


def no_chunking(text: Column) -> Column:
    return F.array(text)


def sentence_chunking(text: Column) -> Column:
    """A chunk ends at each full stop, exclamation or question mark."""
    return _kept(F.regexp_extract_all(text, F.lit(r"[^.!?]*[.!?]|[^.!?]+"), F.lit(0)), text)


def paragraph_chunking(text: Column) -> Column:
    return _kept(F.split(text, "\n\n", -1), text)


def windows(size: int, step: int) -> Callable[[Column], Column]:
    """Windows of `size` words, a new one every `step` words."""

    def chunk(text: Column) -> Column:
        joined = lambda words: F.transform(F.sequence(F.lit(0), F.size(words) - 1, F.lit(step)), lambda i: F.array_join(F.slice(words, i + 1, F.lit(size)), " "))
        # The words are bound by a transform, as an expression inside a lambda is worked out anew each time.
        groups = F.get(F.transform(F.array(F.split(_trim(text), r"(?U)\s+", -1)), joined), F.lit(0))
        return F.when(F.regexp_like(text, F.lit(r"(?U)^\s*\z")), F.array(text)).otherwise(groups)

    return chunk


def word_chunker(size: int = 100) -> Callable[[Column], Column]:
    return windows(size, size) if size else no_chunking


def fixed_size_chunker(size: int = 512, overlap: int = 50) -> Callable[[Column], Column]:
    return windows(size, size - overlap if overlap < size else 1) if size else no_chunking


def word_chunking(text: Column) -> Column:
    return word_chunker()(text)


def fixed_size_chunking(text: Column) -> Column:
    return fixed_size_chunker()(text)


CHUNKERS = {f.__name__: f for f in (no_chunking, sentence_chunking, fixed_size_chunking, paragraph_chunking, word_chunking)}


# The same in Python, for one text.


def chunk_text(name: str, text: str) -> list[str]:
    if name == "sentence_chunking":
        parts = re.findall(r"[^.!?]*[.!?]|[^.!?]+", text)
    elif name == "paragraph_chunking":
        parts = text.split("\n\n")
    elif name in ("word_chunking", "fixed_size_chunking"):
        size, step = (100, 100) if name == "word_chunking" else (512, 462)
        words = white_split(text)
        return [" ".join(words[i : i + size]) for i in range(0, len(words), step)] or [text]
    else:
        return [text]
    return [x for p in parts if (x := white_strip(p))] or [text]
