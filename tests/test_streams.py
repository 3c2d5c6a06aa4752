"""Stateful jobs: groups close when full, by timer when rollouts are lost, and once only."""

import datetime as dt

from rollscope.streaming import jobs as J


def rows(group, day, values):
    return [(group, v, dt.datetime(2024, 1, day, i)) for i, v in enumerate(values)]


def test_groups_close_full_degenerate_and_stale(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", J.STATE_PROVIDER)
    schema = "group_id string, reward_scalar double, ts timestamp"
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    arrivals = [rows("full", 1, [0.1, 0.5]) + rows("flat", 1, [0.3, 0.3, 0.3]) + rows("lost", 1, [0.2]),
                rows("full", 2, [0.9]), rows("late", 20, [0.4])]
    for part in arrivals:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        stream = J.group_close(J.file_stream(spark, src, schema, "parquet", 1), 3, lateness="1 hour", stale_ms=3 * 86_400_000)
        J.drain(J.stream_append(stream, out, ck))
    got = {r.group_id: r for r in spark.read.parquet(out).collect()}
    assert {g: r.status for g, r in got.items()} == {"full": "complete", "flat": "degenerate", "lost": "incomplete"}
    assert got["full"].n == 3 and abs(got["full"].mean_reward - 0.5) < 1e-12 and abs(got["full"].std_reward - 0.4) < 1e-12
    assert got["lost"].n == 1 and got["lost"].std_reward is None or got["lost"].std_reward != got["lost"].std_reward


def test_groups_of_one_bucket_close_each_once(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", J.STATE_PROVIDER)
    schema = "group_id string, reward_scalar double, ts timestamp"
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    arrivals = [rows("full", 1, [0.1, 0.5]) + rows("lost", 1, [0.2]) + rows(None, 1, [0.2, 0.4]), rows("full", 2, [0.9, 0.5]) + rows("second", 3, [1.0]),
                rows("full", 3, [0.7]), rows("later", 6, [0.4]), rows("lost", 6, [0.3]), rows("end", 30, [0.4])]
    for part in arrivals:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        stream = J.group_close(J.file_stream(spark, src, schema, "parquet", 1), 3, lateness="1 hour", stale_ms=3 * 86_400_000, buckets=1)
        J.drain(J.stream_append(stream, out, ck))
    got = sorted((str(r.group_id), r.n, round(r.mean_reward, 9), r.max_reward, r.status) for r in spark.read.parquet(out).collect())
    assert got == [("None", 2, 0.3, 0.4, "incomplete"), ("full", 4, 0.5, 0.9, "overfull"), ("later", 1, 0.4, 0.4, "incomplete"),
                   ("lost", 1, 0.2, 0.2, "incomplete"), ("second", 1, 1.0, 1.0, "incomplete")]


def test_groups_share_the_trips_to_the_state_store(spark, tmp_path):
    """A call per group made a frame and several trips to the store for each."""
    from types import SimpleNamespace

    import pandas as pd

    saves = []
    closer = J.GroupCloser(2, 1000, 1e-6)
    closer.init(SimpleNamespace(getValueState=lambda *a: SimpleNamespace(get=lambda: None, update=saves.append), registerTimer=lambda at: None))
    frame = pd.DataFrame({"group_id": [f"g{i // 2}" for i in range(4000)], "reward": 0.5, "ms": 5})
    out = pd.concat(list(closer.handleInputRows((0,), iter([frame]), SimpleNamespace(getCurrentWatermarkInMs=lambda: 0))))
    assert len(out) == 2000 and set(out.status) == {"degenerate"} and len(saves) == 1 and len(saves[0][0]) == 2000


def test_rerun_of_a_batch_does_not_repeat_rows(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    spark.range(10).write.parquet(src)
    for checkpoint in (ck, ck, ck + "2"):
        # A fresh checkpoint replays the same batch number: its folder is replaced, not added to.
        J.drain(J.stream_score(J.file_stream(spark, src, "id bigint", "parquet", 50), lambda b: b, out, checkpoint))
    assert spark.read.parquet(out).count() == 10
