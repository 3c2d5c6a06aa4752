"""Bytes that the check of scene documents shuffles for each task when no side is small enough to broadcast."""

import __spark_entry__ as se
from tests.shuffled import shuffled


def test_documents_are_shuffled_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled(spark)[1]
        n = len(se.queries()["scene_documents_verified"](spark, "/root/testdata/sf0.001").collect())
        per = (shuffled(spark)[1] - before) / n
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert per < 2400, per


def test_no_document_is_broadcast(spark, monkeypatch):
    """Files of documents are small, what they hold is not: sides planned by file sizes were sent through the driver."""
    from rollscope.operators import scene_documents

    plans = []
    written = scene_documents.written
    monkeypatch.setattr(scene_documents, "written", lambda df: plans.append(df) or written(df))
    plans.append(se.queries()["scene_documents_verified"](spark, "/root/testdata/sf0.001"))
    assert len(plans) == 2
    assert not [p for p in plans if "Broadcast" in p._jdf.queryExecution().executedPlan().toString()]
