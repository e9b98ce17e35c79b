"""Quality classifier by importance resampling.

Two generative models over hashed word n-grams, one of target texts (labelled good) and one of all raw
texts; a document's log weight is the log ratio of its probability under both. Adding independent
Gumbel noise and taking the k largest draws k documents without replacement in proportion to their
weights.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.partitions import spread
from .common import bucket_count, in_tasks, materialize, ranked, slices, texts
from .near_dedup import mix, word_hashes

#: Hashed features: words and pairs of neighbours.
BUCKETS = 10_000
#: The target model is fitted on at most so many labelled rows, those with the least hash of their id.
MAX_LABELLED = 20_000
SMOOTH = 0.5
#: The target model takes in so many features of raw text, so that few labelled rows do not overfit.
SHRINK = 200_000
SEED = 17
#: Rows that one task may order when the last places are given out.
LAST_ROWS = 10_000


def feature_buckets(docs: list[bytes]) -> list[np.ndarray]:
    out = []
    for text in docs:
        h = word_hashes(text)
        pairs = mix(mix(h[:-1]) + h[1:])
        out.append((np.concatenate([h, pairs]) % np.uint64(BUCKETS)).astype(np.int64))
    return out


def _counts(batches):
    counts = np.zeros((2, BUCKETS), np.int64)
    for batch in slices(batches, "text"):
        found = feature_buckets(texts(batch["text"]))
        target = batch["target"].to_pylist()
        counts[0] += np.bincount(np.concatenate(found), minlength=BUCKETS)
        chosen = [f for f, t in zip(found, target) if t]
        if chosen:
            counts[1] += np.bincount(np.concatenate(chosen), minlength=BUCKETS)
    at = np.flatnonzero(counts[0])
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[0][at]), pa.array(counts[1][at])], ["bucket", "raw", "target"])


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> np.ndarray:
    """Log ratio of target to raw probability for each bucket. The raw model counts all documents;
    the target model those of at most `most` ids labelled with quality 1, and never otherwise. Without any,
    all are 0."""
    good = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    marked = spread(docs.select("doc_id", "text")).join(F.broadcast(good.withColumn("target", F.lit(True))), "doc_id", "left")  # at most `most` ids
    counted = in_tasks(marked.select("text", F.coalesce("target", F.lit(False)).alias("target")), _counts, "bucket long, raw long, target long")
    counts = np.zeros((2, BUCKETS))
    for r in counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():  # at most BUCKETS rows
        counts[:, r["bucket"]] += r["raw"], r["target"]
    if not counts[1].any():
        return np.zeros(BUCKETS)
    raw = (counts[0] + SMOOTH) / (counts[0] + SMOOTH).sum()
    target = (counts[1] + SHRINK * raw) / (counts[1].sum() + SHRINK)
    return np.log(target / raw)


def _weigh(shared):
    def run(batches):
        ratio = shared.value
        for batch in slices(batches, "text"):
            found = feature_buckets(texts(batch["text"]))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["row_hash"], pa.array([len(f) for f in found], pa.int64()), pa.array([float(ratio[f].sum()) for f in found], pa.float64())],
                ["doc_id", "row_hash", "n_features", "log_weight"],
            )

    return run


def log_weights(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """doc_id, row_hash, n_features, log_weight of every row; null and empty texts weigh 0."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)
    source = spread(docs.select("doc_id", "text")).select("doc_id", "text", F.xxhash64("text").alias("row_hash"))
    return in_tasks(source, _weigh(shared), "doc_id long, row_hash long, n_features long, log_weight double")


def top_rows(scored: DataFrame, key: str, k: int) -> DataFrame:
    """Add `kept`: true for exactly k rows with the largest keys (all, if there are no more).

    scored must be a materialized table with a distinct `uid` per row, which breaks ties. The k-th key
    is found by counting rows in 4096 ranges of keys, again and again within the range that holds it;
    only rows of a last small range, or of one key, are ranked.
    """
    total = scored.count()
    if k >= total or k <= 0:
        return scored.withColumn("kept", F.lit(k > 0))
    low, high = scored.agg(F.min(key), F.max(key)).first()
    above = 0  # rows beyond `high`
    while True:
        inside = (F.col(key) >= low) & (F.col(key) <= high)
        step = (high - low) / 4096
        if step <= 0 or low + step == low:  # a few thousand different keys at most are left
            for r in scored.where(inside).groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc(key)).collect():
                low = high = r[key]
                if above + r["n"] >= k:
                    break
                above += r["n"]
            break
        number = F.least(F.floor((F.col(key) - low) / step), F.lit(4095))
        bins = scored.where(inside).groupBy(number.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("low"), F.max(key).alias("high")).collect()  # at most 4096 rows
        for b in sorted(bins, key=lambda b: -b["b"]):
            if above + b["n"] >= k:
                break
            above += b["n"]
        low, high = b["low"], b["high"]
        if b["n"] <= LAST_ROWS or low == high:
            break
    inside = (F.col(key) >= low) & (F.col(key) <= high)
    edge = scored.where(inside)
    if low == high:
        edge = ranked(edge, [], F.pmod(F.xxhash64("uid"), F.lit(bucket_count(edge.count()))), [F.col("uid")], "_rank")
    else:
        edge = edge.withColumn("_rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(key), "uid")) - 1)
    edge = edge.withColumn("kept", F.col("_rank") < k - above).drop("_rank")
    rest = scored.where(~inside).withColumn("kept", F.col(key) > high)
    return rest.unionByName(edge)


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, most: int = MAX_LABELLED, seed: int = SEED) -> DataFrame:
    """doc_id, row_hash, n_features, log_weight, sample_key, kept of every row of docs.

    A share of the rows is drawn (kept); by default the share of labels with quality 1, plus three
    standard errors, so that good rows are not crowded out. Noise is a hash of id, text and seed: runs
    agree, and equal rows draw alike, with ties broken by row. Null and empty texts weigh 0. An empty
    table gives no rows; without labels all weigh 0 and all are kept. Only doc_id and text are read.
    """
    ratio = fit(docs, labels, most)
    weights = log_weights(docs, ratio)
    unit = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "row_hash"), 11).cast("double") + 0.5) / float(1 << 53)
    keyed = weights.withColumn("sample_key", F.col("log_weight") - F.log(-F.log(unit))).withColumn("uid", F.monotonically_increasing_id())
    scored = materialize(keyed, "scored")
    if share is None:
        good, n = labels.agg(F.avg(F.col("quality").cast("double")), F.count("quality")).first()
        share = min(1.0, good + 3 * math.sqrt(good * (1 - good) / n)) if n else 1.0
    return top_rows(scored, "sample_key", math.ceil(share * scored.count())).drop("uid")
