"""The pipeline stage by stage on the smallest tables, and its queries against SQL."""

import duckdb
import pytest

import corpus_pipeline
from wavelake.llm import queries

TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.save(stage(spark, docs, small), f"test-{name}")
        now = docs.count()
        assert 0 < now <= before
        if name != "pieces":
            assert docs.columns == columns
        before = now
    assert {"doc_id", "n_tokens", "ids", "decoded"} <= set(docs.columns)


def test_whole_run_equals_stages(spark, small):
    assert corpus_pipeline.run(spark, small).count() > 100


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    d = "/root/testdata/sf0.01"
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    want = db.execute(queries.ORACLE_SQL[name]).df()
    got = queries.QUERIES[name](spark, d).toPandas()[list(want.columns)]
    key = want.columns[0]
    assert sorted(map(str, want.sort_values(key).itertuples(index=False))) == sorted(map(str, got.astype(want.dtypes).sort_values(key).itertuples(index=False)))


def test_columns_named_like_the_last_stage_s_own_are_kept(spark):
    docs = spark.createDataFrame([(1, "a b", 7, "x", None), (2, None, 8, "y", 1)], "doc_id bigint, text string, ids int, n_tokens string, kept int")
    rows = {r.doc_id: r for r in corpus_pipeline.encode_pieces(spark, docs, "").collect()}
    assert (rows[1].input_ids, rows[1].input_n_tokens, rows[1].kept, rows[1].decoded) == (7, "x", None, "a b") and rows[1].n_tokens == len(rows[1].ids)
    assert (rows[2].input_ids, rows[2].kept, rows[2].n_tokens, rows[2].decoded) == (8, 1, 0, "")
