"""Registered queries beside their SQL, the pipeline, and plans without Python where none is allowed."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lumenframe.llm import catalog
from lumenframe.llm.common import read
from tests.check_sql import compare, duck
from tests.llm.test_operators import brute_near, check_packed, plain
from lumenframe.llm.packing import tokenizer_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(catalog.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    same, message = compare(spark, con, SF, name, catalog.queries()[name], catalog.oracle_sql()[name])
    assert same, message


@pytest.mark.parametrize("name", ["op3_secret_scans", "op5_line_dedup", "op9_source_mixing"])
def test_native_plans_hold_no_python(spark, name):
    plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|MapPartitions|CartesianProduct|NestedLoop", plan)


def test_pipeline_stages(spark):
    docs = read(spark, SF, "documents")
    columns = docs.columns
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        out = stage(spark, docs, SF).persist()
        got = out.collect()
        if name == "exact dedup":
            assert sorted(r["doc_id"] for r in got) == sorted({plain(t): d for d, t in sorted(rows, reverse=True)}.values())
        elif name == "SimHash near-dedup":
            assert {r["doc_id"] for r in got} == {c for _, _, c in brute_near(rows)}
        elif name == "best-fit packing":
            check_packed(got, rows, tokenizer_path())
        if name != "best-fit packing":
            assert out.columns == columns
        sizes.append(len(got))
        docs = out
    assert sizes[0] >= sizes[1] >= sizes[2]


def test_pipeline_takes_odd_rows(spark):
    from tests.llm.test_operators import odd_documents
    docs = odd_documents(spark).select(*read(spark, SF, "documents").columns)
    for docs in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
        docs.collect()


def test_run_is_the_stages_in_order(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.agg(F.countDistinct("sequence_id")).first()[0] > 0
