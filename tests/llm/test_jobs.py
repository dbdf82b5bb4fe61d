"""The registered queries: names, whole tables, and the pipeline's stages."""

import re

import pytest

import corpus_pipeline
from lexicue.llm.jobs import JOBS
from tests.compare import connect
from tests.conftest import SMALL


def test_one_query_of_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in JOBS) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(n for n in JOBS if not n.startswith(("op11_", "op12_"))))
def test_a_row_for_every_row(spark, name):
    rows = JOBS[name][0](spark, SMALL)
    table, key = ("pages", "page_id") if name.startswith("op4_") else ("documents", "doc_id")
    want = spark.read.parquet(f"{SMALL}/{table}.parquet").select(key)
    if name.startswith("op7_"):
        rows = rows.where("piece = 0")
    assert sorted(r[0] for r in rows.select(key).collect()) == sorted(r[0] for r in want.collect())


@pytest.mark.parametrize("name", [n for n, (_, sql) in JOBS.items() if sql])
def test_sql_gives_the_same_rows(spark, name):
    run, sql = JOBS[name]
    got = run(spark, SMALL)
    cursor = connect(SMALL).execute(sql)
    names = [d[0] for d in cursor.description]
    want = [dict(zip(names, r)) for r in cursor.fetchall()]
    assert sorted(names) == sorted(got.columns)
    assert sorted(repr(r.asDict()) for r in got.collect()) == sorted(repr({c: r[c] for c in got.columns}) for r in want)


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append(docs.count())
        assert name == corpus_pipeline.STAGES[-1][0] or docs.columns == columns
    assert seen[0] >= seen[1] == seen[2] == seen[3] <= seen[4]
    assert corpus_pipeline.run(spark, SMALL).count() == seen[-1]
