"""The stages on the small tables, and the queries with SQL."""

import duckdb
import pytest

import corpus_pipeline
from geoflow.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import SF, same_rows


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    same_rows(QUERIES[name](spark, SF), ORACLE_SQL[name])


def test_held_out_language_and_toxicity(spark):
    lang = QUERIES["op1_language"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert lang.where("lang = lang_pred").count() >= 0.98 * lang.count()
    tox = QUERIES["op5_toxicity"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out")
    assert tox.where("predicted = toxic").count() >= 0.85 * tox.count()


def test_leaks_are_those_that_contain_an_item(spark):
    con = duckdb.connect()
    want = con.execute(f"select distinct doc_id from '{SF}/documents.parquet' d, '{SF}/benchmark.parquet' b where contains(d.text, b.text)").fetchall()
    assert sorted(r.doc_id for r in QUERIES["op4_decontamination"](spark, SF).collect()) == sorted(r[0] for r in want)


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == docs.columns
            docs = spark.createDataFrame(out.toPandas(), out.schema)
            assert 0.5 * n < docs.count() <= n
    assert out.count() == docs.count()
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, out.collect()))
