"""Every query of the catalogue against its SQL in DuckDB, and those without SQL against plain Python."""

import duckdb
import pytest

import ruleweave.queries as Q
from ruleweave.evaluate import scan_text
from ruleweave.operators.models import HashingEmbedder

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def normal(df):
    cols = sorted(df.columns)
    return sorted(map(repr, df[cols].astype(object).where(df[cols].notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_same_rows_as_sql(spark, duck, sf_dir, name):
    got, want = Q.QUERIES[name](spark, sf_dir).toPandas(), duck.sql(Q.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


def test_similarity_rule_against_plain_evaluator(spark, sf_dir):
    rules = Q.compile_str('rule r { similarity: $s = "the and attion" threshold=0.55 chunker=sentence_chunking matcher=hashing\n condition: #s >= 1 }')
    rules.register_semantic_matcher("hashing", HashingEmbedder())
    want = {}
    for r in Q.docs(spark, sf_dir).collect():
        if (m := scan_text(rules, r.text)[0]).matched:
            want[r.doc_id] = len(m.matched_patterns["$s"])
    assert {r.doc_id: r.hits for r in Q.similarity_rule(spark, sf_dir).collect()} == want and want


def test_embed_distinct_covers_all_rows(spark, sf_dir):
    got = Q.embed_distinct(spark, sf_dir)
    assert got.count() == Q.read(spark, sf_dir, "pages").count() and got.where("size <> 16").count() == 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
