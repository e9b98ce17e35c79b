"""Scans of streams: a scan keeps no state, so it runs on a stream as on a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..engine import RuleSet


def scan_stream(rules: RuleSet, stream: DataFrame, text: str = "text", **options) -> DataFrame:
    """The scan of a streaming table; all tiers run inside the stream's own plan."""
    return rules.scan(stream, text, **options)


def alert_counts(rules: RuleSet, stream: DataFrame, time: str, window: str, late: str, text: str = "text") -> DataFrame:
    """Matches per rule and window of event time; rows later than `late` are left out."""
    found = rules.scan(stream.withWatermark(time, late), text, output="matched")
    return found.groupBy(F.window(time, window), "rule_name").agg(F.count(F.lit(1)).alias("matches"))


def for_each_batch(rules: RuleSet, stream: DataFrame, sink, text: str = "text", **options) -> DataStreamWriter:
    """Scan each micro-batch as a table and hand the result to sink(df, batch_id): for chat and embedding
    tiers that de-duplicate their questions with a shuffle first, or for sinks without a streaming writer."""
    return stream.writeStream.foreachBatch(lambda batch, number: sink(rules.scan(batch, text, **options), number))
