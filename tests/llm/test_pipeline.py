import duckdb
import pytest

import corpus_pipeline
from haplodeck.llm.queries import ORACLE, QUERIES


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_statement(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    df = QUERIES[name](spark, data)
    cur = con.execute(ORACLE[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert ordered(df.select(*names).collect()) == ordered(cur.fetchall())


def test_stages_in_a_row_equal_the_operators(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    verdict = {r.doc_id for r in QUERIES["op3_quality_rules"](spark, data).where("kept").collect()}
    seen = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen, data)
        if name == "quality rules":
            assert {r.doc_id for r in out.collect()} == verdict
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
            seen = out
    final = {r.doc_id: r.n_tokens for r in out.collect()}
    assert {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, data).collect()} == final
    assert set(final) == {r.doc_id for r in seen.collect()} and 0 < len(final) < docs.count()
