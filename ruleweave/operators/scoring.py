"""Model-backed patterns over chunks: each yields array<struct<text, score, explanation>> and an error.

Chunks of a row stay in an array, so nothing is shuffled; a batch is scored at once, each distinct chunk
once, and what a task has scored in former batches is not scored again. An error costs the row's hits of
that pattern and is reported, not raised.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import cosine_of
from ..shipping import Cache

#: Texts whose scores a task keeps.
KEPT = 50_000

RESULT = "struct<hits:array<struct<matched_text:string,score:double,explanation:string>>,error:string>"


def _batched(answer, keep, repeatable: bool = True):
    """A column function on array<string> chunks. answer(list of texts) gives an item for each; keep(text,
    item) the hit or None. A row whose chunks are null is not asked about. repeatable: an answer holds for
    the same text in later batches."""
    known = Cache()

    @F.pandas_udf(RESULT)
    def run(chunks: pd.Series) -> pd.DataFrame:
        met = list(dict.fromkeys(c for row in chunks if row is not None for c in row if c))
        items, failed = {c: known[c] for c in met if c in known}, {}
        asked = [c for c in met if c not in items]
        try:
            items |= dict(zip(asked, answer(asked))) if asked else {}
        except Exception:  # find the texts that fail, one by one
            for c in asked:
                try:
                    items[c] = answer([c])[0]
                except Exception as e:
                    failed[c] = f"{type(e).__name__}: {e}"
        if repeatable:
            if len(known) + len(asked) > KEPT:
                known.clear()
            known.update((c, items[c]) for c in asked[:KEPT] if c in items)
        out = []
        for row in chunks:
            row = [] if row is None else [c for c in row if c]
            error = next((failed[c] for c in row if c in failed), None)
            hits = [] if error else [h for c in row if (h := keep(c, items[c]))]
            out.append((hits, error))
        return pd.DataFrame(out, columns=["hits", "error"])

    return run


def _hit(text: str, score: float, explanation: str) -> dict:
    return {"matched_text": text, "score": score, "explanation": explanation}


def similar(chunks: Column, embedder, pattern: str, threshold: float) -> Column:
    """Chunks whose embedding has a cosine of at least threshold with the pattern's, which is embedded once
    on the driver (or by the tasks, if that fails)."""
    if not pattern:
        return nothing()
    try:
        own = embedder.embed([pattern])[0]
    except Exception:  # tasks report what is wrong
        own = None

    def answer(texts):
        first, *rest = embedder.embed([pattern, *texts]) if own is None else [own, *embedder.embed(texts)]
        return [cosine_of(first, v) for v in rest]

    return _batched(answer, lambda t, s: _hit(t, s, f"Semantic similarity: {s:.3f}") if s >= threshold else None)(chunks)


def classified(chunks: Column, classifier, pattern: str, threshold: float) -> Column:
    """Chunks that the classifier scores at least threshold."""
    if not pattern:
        return nothing()
    return _batched(lambda texts: classifier.score(pattern, texts), lambda t, s: _hit(t, float(s), f"Classifier confidence: {s:.3f}") if s >= threshold else None)(chunks)


def asked(chunks: Column, chat, pattern: str) -> Column:
    """Chunks that the language model says yes to."""
    return _batched(lambda texts: chat.ask(pattern, texts), lambda t, a: _hit(t, 1.0, a[1]) if a[0] else None, not getattr(chat, "temperature", 0))(chunks)


def nothing(error: str | None = None) -> Column:
    return F.struct(F.array().cast("array<struct<matched_text:string,score:double,explanation:string>>").alias("hits"), F.lit(error).cast("string").alias("error"))


def hashed(content: Column, hasher) -> Column:
    """struct<hash, error> of file contents."""

    @F.pandas_udf("struct<hash:bigint,error:string>")
    def run(contents: pd.Series) -> pd.DataFrame:
        out = []
        for c in contents:
            try:
                out.append((None if c is None else hasher(c), None))
            except Exception as e:
                out.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame({"hash": pd.Series([h for h, _ in out], dtype="Int64"), "error": [e for _, e in out]})

    return run(content)


def embed_distinct(texts: DataFrame, column: str, embedder, name: str = "embedding") -> DataFrame:
    """Add the embedding of a column, asking for each distinct text of the table once."""

    @F.pandas_udf("array<float>")
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([list(map(float, v)) for v in embedder.embed(values.tolist())])

    distinct = texts.select(column).where(F.col(column).isNotNull()).distinct()
    return texts.join(distinct.withColumn(name, run(F.col(column))), column, "left")


def answer_distinct(texts: DataFrame, column: str, chat, pattern: str) -> DataFrame:
    """Add `answer` struct<matches, explanation>, asking for each distinct text of the table once."""

    @F.pandas_udf("struct<matches:boolean,explanation:string>")
    def run(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(chat.ask(pattern, values.tolist()), columns=["matches", "explanation"])

    distinct = texts.select(column).where(F.col(column).isNotNull()).distinct()
    return texts.join(distinct.withColumn("answer", run(F.col(column))), column, "left")
