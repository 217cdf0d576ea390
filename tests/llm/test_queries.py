import duckdb
import pytest

import corpus_pipeline
from granary.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(SQL[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    rows = lambda df: sorted(str([None if x != x else x for x in r]) for r in df[cols].astype(object).where(df[cols].notna(), None).itertuples(index=False, name=None))
    assert rows(got.astype({"refers_to": "Int64"}) if "refers_to" in got else got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_covers_its_table(spark, name):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    rows = QUERIES[name](spark, SF)
    assert "doc_id" in rows.columns and rows.select("doc_id").distinct().count() <= n
    if name != "op3_benchmark_decontamination":
        assert rows.select("doc_id").distinct().count() == n


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF)
        assert after.columns == docs.columns, name
        ids = {r.doc_id for r in after.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in before.select("doc_id").collect()}
        before = after
    rows = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in rows.select("doc_id").collect()} == ids


def test_pipeline_on_an_empty_table(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
