"""Plan documents are read once: the rules are compiled, and only misshapen documents are parsed by the schemas."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tableprep.catalog import texts
from tableprep.plans import checks

GOOD = {
    "plan_name": "p", "status": "executable", "task_type": "clustering", "input_files": ["f"], "feature_columns": ["a"],
    "missing_value_plan": [{"columns": ["a"], "strategy": "median", "reason": "r"}], "split_strategy": {"strategy": "none", "random_state": "7"},
    "output_artifacts": [{"artifact_type": "train_data", "path": "x", "required": True}],
}


@pytest.fixture
def documents(spark):
    texts = [GOOD, {**GOOD, "missing_value_plan": ["fill"]}, {**GOOD, "split_strategy": 5}, {**GOOD, "assumptions": [1]}]
    rows = [*enumerate(map(json.dumps, texts)), (4, json.dumps(GOOD)[:-1]), (5, None)]
    return spark.createDataFrame(rows, "n int, document string")


def test_documents_are_parsed_by_the_schemas_only_where_misshapen(documents):
    opened = checks._opened(documents, "document")
    assert {r["n"] for r in opened.where("__regular").collect()} == {0, 3}
    plan = checks.plan_errors(documents, "document")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1 and "filter(array(CASE" not in plan


def test_kinds_are_judged_alike_in_regular_and_misshapen_documents(documents, monkeypatch):
    def errors():
        return {r["n"]: r["errors"] for r in checks.plan_errors(documents, "document").collect()}
    found, opened = errors(), checks._opened
    assert found[0] == [] and found[3] == ["assumptions is not a list of texts"]
    assert "missing_value_plan is not a list of objects" in found[1] and "split_strategy is not an object" in found[2]
    assert found[4] == found[5] == ["not a JSON object"]

    def by_schema(df, document):
        return opened(df, document).withColumns({
            "__regular": F.lit(False), "plan": F.from_json(document, checks.PLAN_SCHEMA), "__parts": F.from_json(document, checks.KEYS_SCHEMA),
        })
    monkeypatch.setattr(checks, "_opened", by_schema)
    assert errors() == found


@pytest.fixture
def one_split(spark, tmp_path):
    rows = spark.range(1200).selectExpr("id AS o_orderkey", "'1-URGENT' AS o_orderpriority")
    rows.coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("query", [texts.doc_plan_kinds, texts.doc_plan_errors, texts.doc_gate, texts.doc_gate_strict, texts.doc_legacy])
def test_documents_made_of_one_split_are_checked_by_many_tasks(spark, one_split, query):
    done = query(spark, one_split).select("o_orderkey", F.spark_partition_id().alias("task"))
    shares = {r["task"]: r["count"] for r in done.groupBy("task").count().collect()}
    assert sum(shares.values()) == 1200 and len(shares) == 4 and max(shares.values()) < 400
    above, _, dealt = done._jdf.queryExecution().analyzed().toString().partition("RepartitionByExpression")
    assert "AS document" in above and "AS document" not in dealt  # the orders are dealt, not the documents
