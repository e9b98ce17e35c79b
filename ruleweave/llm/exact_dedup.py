"""Exact dedup by two-pass Bloom filtering.

Pass one folds the digests of all rows into two bit arrays, "seen" and "seen again"; pass two tests
every digest against "seen again". Only rows whose bits are all set there are grouped by digest in a
shuffle. The rest cannot have a copy and pass straight through. Digests are split by prefix into as
many filters as they need, up to MAX_FILTERS, one after another, so that one broadcast lives at a time;
beyond that many, filters fill up and more digests (some 40 bytes a row) go through the shuffle.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.partitions import spread
from . import bloom
from .common import in_tasks, keep_rows, materialize, partition, slices, texts

#: Each is a pass over the digests.
MAX_FILTERS = 8


def _digests(batches):
    uid, task = 0, partition() << 40
    for batch in slices(batches, "text"):
        found = [hashlib.sha256(t.lower()).digest() for t in texts(batch["text"])]
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], batch["row_hash"], pa.array(found, pa.binary()), pa.array(np.arange(uid, uid + len(found)) + task, pa.int64())],
            ["doc_id", "row_hash", "sha", "uid"],
        )
        uid += len(found)


def digest_positions(batch: pa.RecordBatch, bits: int) -> np.ndarray:
    """Bit positions of the digests in column `sha`."""
    words = np.frombuffer(b"".join(batch["sha"].to_pylist()), "<u8").reshape(-1, 4)
    return (words[:, :3] & np.uint64(bits - 1)).astype(np.int64)


def _test(bits: int, shared):
    def test(batches):
        again = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            hit = bloom.held(again, digest_positions(batch, bits))
            yield batch.append_column("maybe", pa.array(hit, pa.bool_()))

    return test


def _tested(digests: DataFrame) -> DataFrame:
    """digests with `maybe`: false for those that surely occur once."""
    rows = digests.count()
    filters = min(MAX_FILTERS, max(1, -(-rows * bloom.BITS_PER_KEY // bloom.MAX_BITS)))
    bits = bloom.bits_for(-(-rows // filters))
    prefix = F.pmod(F.conv(F.hex(F.substring("sha", 32, 1)), 16, 10).cast("int"), F.lit(filters))
    out = None
    for i in range(filters):
        part = digests if filters == 1 else digests.where(prefix == i)
        shared = digests.sparkSession.sparkContext.broadcast(bloom.fold(part, digest_positions, bits, "again").tobytes())
        tested = in_tasks(part, _test(bits, shared), "doc_id long, row_hash long, sha binary, uid long, maybe boolean")
        tested = materialize(tested, "tested")
        out = tested if out is None else out.unionByName(tested)
        shared.unpersist()
    return out


def decide(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, row_hash, text_sha256, keep_id, group_size, kept.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the
    row with the largest doc_id stays, null ids last; of rows equal in id and text as well, one. An
    empty table gives no rows. Only doc_id and text are read; other columns may have any name.
    row_hash (a 64-bit hash of the raw text) tells apart rows that share a doc_id.
    """
    source = spread(docs.select("doc_id", "text")).select("doc_id", "text", F.xxhash64("text").alias("row_hash"))
    tested = _tested(materialize(in_tasks(source, _digests, "doc_id long, row_hash long, sha binary, uid long"), "digests"))
    once = tested.where("not maybe").select("doc_id", "row_hash", "sha", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    several = tested.where("maybe")
    # Copies are counted before the shuffle. The groups are a table of their own, so that a group of any
    # size is split in the join and not bound to the aggregate's partitions.
    order = F.coalesce("doc_id", F.lit(-(1 << 63)))
    best = several.groupBy("sha").agg(F.max("doc_id").alias("keep_id"), F.max_by("uid", order).alias("best"), F.count(F.lit(1)).alias("group_size"))
    best = materialize(best, "best")
    joined = several.join(best, "sha").select("doc_id", "row_hash", "sha", "keep_id", "group_size", (F.col("uid") == F.col("best")).alias("kept"))
    both = once.unionByName(joined)
    return both.select("doc_id", "row_hash", F.lower(F.hex("sha")).alias("text_sha256"), "keep_id", "group_size", "kept")


def drop_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns."""
    return keep_rows(docs, decide(docs), "kept")
