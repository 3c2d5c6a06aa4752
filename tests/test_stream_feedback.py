"""A trigger's rows are parsed on all cores, however few files they came in."""

import __spark_entry__ as se


def test_a_trigger_uses_all_cores(spark):
    df = se.queries()["stream_feedback"](spark, "/root/testdata/sf0.001")
    # Two triggers of two files each; every task that parsed rows wrote a file.
    assert len(df.inputFiles()) >= spark.sparkContext.defaultParallelism
