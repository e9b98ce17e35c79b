import corpus_pipeline as C
from ruleweave.llm import decontaminate, exact_dedup, near_dedup, queries
from ruleweave.llm.common import materialize

from .conftest import EDGES, make


def test_stages_take_effect_and_keep_the_rest(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    left = {}
    for name, stage in C.STAGES:
        before = docs
        docs = materialize(stage(spark, before, sf_dir), name)
        left[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if name != "pack":
            assert docs.columns == before.columns
            assert docs.exceptAll(before).count() == 0
    assert [n for n, _ in C.STAGES] == ["language_id", "exact_dedup", "near_dedup", "decontaminate", "pack"]
    assert len(left["language_id"]) == 200
    all_docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert left["exact_dedup"] == {r.doc_id for r in exact_dedup.decide(all_docs).where("kept").collect()}
    near = {r.doc_id for r in near_dedup.near_duplicates(all_docs).where("kept").collect()}
    assert left["near_dedup"] <= left["exact_dedup"] and len(near) <= len(left["exact_dedup"])
    leaked = {r.doc_id for r in decontaminate.leaks(all_docs, bench).collect()}
    assert left["decontaminate"] == left["near_dedup"] - leaked and left["pack"] == left["decontaminate"]


def test_stages_on_edges_and_empty_tables(spark, sf_dir, edges, empty):
    for docs, some in ((edges, True), (empty, False)):
        for name, stage in C.STAGES:
            docs = materialize(stage(spark, docs, sf_dir), name)
        assert (docs.count() > 0) == some


def test_queries_cover_their_tables(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for name in ("op2_sharding", "op3_line_dedup", "op5_secret_scan", "op6_near_dedup", "op7_exact_dedup", "op9_quality", "op10_language_id"):
        assert queries.queries()[name](spark, sf_dir).count() == n, name


def test_sql_of_queries(spark, sf_dir):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        got, want = queries.queries()[name](spark, sf_dir).toPandas(), c.sql(sql).df()
        cols = sorted(want.columns)
        rows = lambda d: sorted(map(repr, d[cols].astype(object).where(d[cols].notna(), None).itertuples(index=False, name=None)))
        assert sorted(got.columns) == cols and rows(got) == rows(want)


def test_edges_are_whole(spark):
    assert make(spark, EDGES).count() == len(EDGES)
