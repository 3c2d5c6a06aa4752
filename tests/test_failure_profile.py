from rollscope.operators import stats


def test_every_section(spark, tmp_path):
    rows = [("failure", ["a", "b"], 1.0, None), ("failure", ["b", "b", "positive", None], 0.0, 0.5), ("failure", None, 0.5, None),
            ("positive", ["a"], 1.0, None), (None, [], None, None)]
    path = str(tmp_path / "scored")
    spark.createDataFrame(rows, "buffer string, failure_tags array<string>, x double, y double").write.parquet(path)
    scored = spark.read.parquet(path)
    out = stats.failure_profile(scored, ["x", "y"])
    assert sorted(map(tuple, out.collect()), key=str) == sorted(
        [("reward_mean", "x", 0.625), ("reward_mean", "y", 0.5), ("failure_tag", "a", 1.0), ("failure_tag", "b", 3.0),
         ("buffer", "failure", 3.0), ("buffer", "positive", 1.0), ("buffer", None, 1.0)], key=str)
    assert sorted(map(tuple, stats.failure_profile(scored.limit(0), ["x", "y"]).collect())) == [("reward_mean", "x", None), ("reward_mean", "y", None)]
