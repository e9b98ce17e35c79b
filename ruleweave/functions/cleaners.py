"""Text cleaners: column functions from text to text."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def nfkc(text: Column) -> Column:
    """Unicode NFKC. ASCII text is its own NFKC, so only other rows are sent to Python."""

    @F.pandas_udf("string")
    def normalize(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")

    return F.coalesce(normalize(F.when(F.octet_length(text) != F.length(text), text)), text)


def collapse(text: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def default_cleaning(text: Column) -> Column:
    return collapse(F.lower(nfkc(text)))


def no_op(text: Column) -> Column:
    return text


def aggressive_cleaning(text: Column) -> Column:
    """Letters and white space only."""
    return collapse(F.lower(F.regexp_replace(nfkc(text), r"[^\p{IsAlphabetic}\p{IsWhite_Space}]|[\p{Nd}\p{Nl}\p{No}]", " ")))


CLEANERS = {f.__name__: f for f in (default_cleaning, no_op, aggressive_cleaning)}


# The same in Python, for one text.

#: White space as columns see it. str.split also splits at U+001C to U+001F.
_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WORDS, _ENDS = re.compile(f"[^{_WHITE}]+"), re.compile(f"^[{_WHITE}]+|[{_WHITE}]+\\Z")


def white_split(text: str) -> list[str]:
    return _WORDS.findall(text)


def white_strip(text: str) -> str:
    return _ENDS.sub("", text)


def clean_text(name: str, text: str) -> str:
    if name == "no_op":
        return text
    text = unicodedata.normalize("NFKC", text)
    if name == "aggressive_cleaning":
        import regex

        text = regex.sub(r"[^\p{Alphabetic}\p{White_Space}]|\p{N}", " ", text)
    return " ".join(white_split(text.lower()))
