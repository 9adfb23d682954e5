import os

import pytest

from loomwright.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="no test tables")


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def ids(df, col):
    return sorted(r[0] for r in df.select(col).collect())


def test_model_rerank_takes_all_questions_and_documents(spark):
    got = catalog.QUERIES["v13_model_rerank"](spark, SF).select("query_id", "doc_id").collect()
    assert sorted({r.query_id for r in got}) == ids(table(spark, "benchmark"), "item_id")
    assert {r.doc_id for r in got} & set(ids(table(spark, "documents").filter("lang <> 'en'"), "doc_id"))


def test_answers_to_all_questions(spark):
    assert ids(catalog.QUERIES["v14_answers"](spark, SF), "query_id") == ids(table(spark, "benchmark"), "item_id")


def test_cache_is_asked_for_all_rows(spark):
    assert {i % 5 for i in ids(catalog.QUERIES["v24_semantic_cache"](spark, SF), "request_id")} == {0, 1, 2, 3, 4}


def test_calendar_of_all_orders(spark):
    assert sorted(map(int, ids(catalog.QUERIES["o9_calendar"](spark, SF), "uid"))) == ids(table(spark, "orders"), "o_orderkey")
