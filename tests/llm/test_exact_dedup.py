import hashlib
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import functions as F

from ruleweave.llm import bloom
from ruleweave.llm import exact_dedup as E

from .conftest import EDGES, make

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOWER)].append(i)
    return {t: (max((i for i in ids if i is not None), default=None), len(ids)) for t, ids in groups.items()}


def test_edges_against_brute_force(spark, edges):
    got = E.decide(edges).collect()
    assert len(got) == len(EDGES)
    want = brute(EDGES)
    digest = {hashlib.sha256(t.encode()).hexdigest(): v for t, v in want.items()}
    assert all((r.keep_id, r.group_size) == digest[r.text_sha256] for r in got)
    assert sum(r.kept for r in got) == len(want)
    assert all(r.kept is False for r in got if r.doc_id != r.keep_id)
    assert E.decide(edges).where("kept and not (doc_id <=> keep_id)").count() == 0


def test_stage_keeps_one_row_of_each_text(spark, edges, empty):
    left = E.drop_copies(edges)
    assert left.columns == edges.columns
    rows = left.collect()
    assert sorted((r.text or "").translate(LOWER) for r in rows) == sorted(brute(EDGES))
    assert E.drop_copies(empty).count() == 0 and E.decide(empty).count() == 0


def test_overloaded_filter_gives_the_same(spark, edges, monkeypatch):
    """A filter too small for its rows only sends more of them through the shuffle."""
    monkeypatch.setattr(bloom, "bits_for", lambda keys: 1 << 6)
    docs = make(spark, [(i, f"text {i % 700}") for i in range(1000)])
    got = E.decide(docs)
    assert got.where("kept").count() == 700 and got.where("group_size = 2").count() == 600


def test_filter_has_every_repeated_digest(spark):
    docs = spark.range(300).select(F.unhex(F.sha2((F.col("id") % 250).cast("string"), 256)).alias("sha")).repartition(4)
    bits = 1 << 13
    again = bloom.fold(docs, E.digest_positions, bits, "again")
    hit = {r.sha: None for r in docs.collect()}
    held = bloom.held(again, E.digest_positions(pa.RecordBatch.from_arrays([pa.array(list(hit), pa.binary())], ["sha"]), bits))
    repeated = {hashlib.sha256(str(i).encode()).digest() for i in range(50)}
    assert all(h for s, h in zip(hit, held) if s in repeated) and held.sum() < 80
