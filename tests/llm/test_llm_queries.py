import os

import pytest

from kumiko.llm.queries import ORACLES, QUERIES
from oracle import compare

ROOT = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    assert compare(spark, QUERIES[name], ORACLES[name], ROOT) is None


@pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test tables")
def test_held_out_language(spark):
    docs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{ROOT}/documents.parquet").collect()}
    got = [r for r in QUERIES["op2_language_id"](spark, ROOT).collect() if r["held_out"]]
    assert sum(docs[r["doc_id"]] == r["lang_pred"] for r in got) >= 0.95 * len(got)


@pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test tables")
def test_labelled_toxicity(spark):
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{ROOT}/labels.parquet").collect()}
    got = [r for r in QUERIES["op6_toxicity"](spark, ROOT).collect() if r["doc_id"] in truth]
    assert sum(int(r["toxic"]) == truth[r["doc_id"]] for r in got) >= 0.95 * len(got)
