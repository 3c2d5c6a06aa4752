"""Incremental jobs over arriving rollouts: scoring, feedback, breakdowns, group closing, baselines."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from rollscope.operators.checks import dataset_fingerprint, index_sides
from rollscope.operators.stats import finite

STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def file_stream(spark: SparkSession, path: str, schema: StructType | str, fmt: str = "json",
                files_per_trigger: int = 1) -> DataFrame:
    """Stream of the files that land in a folder."""
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
            .format(fmt).load(path))


def drain(query: StreamingQuery) -> None:
    """Wait for an available-now query and pass its error on."""
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def stream_score(rollouts: DataFrame, score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Score micro-batches and publish each under its batch number.

    A batch that is run again after a failure overwrites its own folder, so every rollout is
    written exactly once; the checkpoint makes a restart skip finished input.
    """
    def publish(batch: DataFrame, batch_id: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (rollouts.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def stream_append(rows: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append-only file sink; rows appear once their batch is committed."""
    return (rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
            .trigger(availableNow=True).start(out))


def breakdown(rows: DataFrame, dims: Sequence[str], kind: str = "kind") -> DataFrame:
    """Running count and mean per kind; missing and non-finite values are left out."""
    return rows.groupBy(kind).agg(
        F.count(F.lit(1)).alias("samples"), *[F.avg(finite(F.col(d))).alias(f"mean_{d}") for d in dims])


def stream_breakdown(rows: DataFrame, dims: Sequence[str], out: str, checkpoint: str, kind: str = "kind") -> StreamingQuery:
    """Latest per-kind means; each trigger replaces the published table with the changed totals."""
    def publish(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (breakdown(rows, dims, kind).writeStream.outputMode("complete").foreachBatch(publish)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


GROUP_OUT = "group_id string, n bigint, mean_reward double, std_reward double, max_reward double, status string"
GROUP_STATE = ("ids array<string>, n array<bigint>, mean array<double>, m2 array<double>, top array<double>, closed array<boolean>, "
               "due array<bigint>")
# Groups share this many state entries: a call and its trips to the state store serve all groups of an entry at once.
BUCKETS = 1024


class GroupCloser(StatefulProcessor):
    """Emit a group's statistics once `size` rollouts are in; a timer closes groups that lost some.

    An entry holds the groups of one bucket. State is six numbers per group (count, mean, squared spread, maximum, closed,
    due), never the rows. Closed groups keep theirs: a group is emitted exactly once, whatever arrives later.
    """

    def __init__(self, size: int, stale_ms: int, std_threshold: float):
        self._size, self._stale_ms, self._std = size, stale_ms, std_threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._state = handle.getValueState("groups", GROUP_STATE)

    def _load(self) -> dict[str | None, list]:
        stored = self._state.get()
        return {} if stored is None else {g: list(v) for g, *v in zip(*stored)}

    def _save(self, groups: dict[str | None, list]) -> None:
        self._state.update((list(groups), *[list(c) for c in zip(*groups.values())]))

    def _frame(self, ended: list[tuple]) -> pd.DataFrame:
        out = []
        for group, n, mean, m2, top, status in ended:
            std = (m2 / (n - 1)) ** 0.5 if n > 1 else None
            if status == "complete" and std is not None and std <= self._std:
                status = "degenerate"
            out.append((group, n, mean, std, top, status))
        return pd.DataFrame(out, columns=["group_id", "n", "mean_reward", "std_reward", "max_reward", "status"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        groups, fresh = self._load(), {}
        timer = min((g[5] for g in groups.values() if not g[4]), default=None)
        touched = set()
        for pdf in rows:
            # One frame at a time: its own counts, means and spreads join those so far.
            ids, x = pdf["group_id"], pdf["reward"]
            per = x.groupby(ids, dropna=False, sort=False)
            spread = ((x - per.transform("mean")) ** 2).groupby(ids, dropna=False, sort=False).sum()
            first = pdf["ms"].groupby(ids, dropna=False, sort=False).min()
            parts = zip(first.index, per.size().tolist(), per.mean().tolist(), spread.tolist(), per.max().tolist(), first.tolist())
            for group, k, mid, square, most, seen in parts:
                group = group if isinstance(group, str) else None
                if group not in groups:
                    groups[group] = [0, 0.0, 0.0, float("-inf"), False, 0]
                    fresh[group] = seen
                elif group in fresh:
                    fresh[group] = min(fresh[group], seen)
                touched.add(group)
                g = groups[group]
                n, d = g[0], mid - g[1]
                g[2] += square + d * d * n * k / (n + k)
                g[1] += d * k / (n + k)
                g[0], g[3] = n + k, max(g[3], most)
        ended = []
        for group in touched:
            g = groups[group]
            if not g[4] and g[0] >= self._size:
                g[4] = True
                ended.append((group, *g[:4], "complete" if g[0] == self._size else "overfull"))
        now = timerValues.getCurrentWatermarkInMs() if fresh else 0
        for group, seen in fresh.items():
            groups[group][5] = max(seen, now) + self._stale_ms
        self._save(groups)
        # The entry's open groups wait for the first of their times.
        wait = min((groups[g][5] for g in fresh if not groups[g][4]), default=None)
        if wait is not None and (timer is None or wait < timer):
            self._handle.registerTimer(wait)
        if ended:
            yield self._frame(ended)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        groups, now = self._load(), max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)
        ended = []
        for group, g in groups.items():
            if not g[4] and g[5] <= now:
                # The closed mark stays, so a rollout that comes after this never opens the group again.
                g[4] = True
                ended.append((group, *g[:4], "incomplete"))
        if ended:
            self._save(groups)
        wait = min((g[5] for g in groups.values() if not g[4]), default=None)
        if wait is not None:
            self._handle.registerTimer(wait)
        if ended:
            yield self._frame(ended)

    def close(self) -> None:
        pass


def group_close(rollouts: DataFrame, size: int, *, ts: str = "ts", lateness: str = "1 hour", stale_ms: int = 86_400_000,
                std_threshold: float = 1e-6, buckets: int = BUCKETS) -> DataFrame:
    """Closed groups of a stream with columns group_id, reward_scalar and an event time. `buckets` stays as a checkpoint began."""
    rows = rollouts.withWatermark(ts, lateness).select(
        F.pmod(F.xxhash64("group_id"), F.lit(buckets)).alias("bucket"), "group_id", F.col("reward_scalar").cast("double").alias("reward"),
        F.unix_millis(ts).alias("ms"), ts)
    return rows.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=GroupCloser(size, stale_ms, std_threshold), outputStructType=GROUP_OUT,
        outputMode="Append", timeMode="EventTime")


EMA_OUT = "run_id bigint, game_id bigint, spy_reward double, b_spy double, spy_adjusted double"


class RoleBaseline(StatefulProcessor):
    """Exponential role baseline per run, carried across batches and restarts."""

    def __init__(self, alpha: float):
        self._alpha = alpha

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("baseline", "b double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        base = self._state.get()[0] if self._state.exists() else 0.0
        # A micro-batch of one run, bounded by the files of a trigger; sorting restores the game order inside it.
        pdf = pd.concat(list(rows)).sort_values("game_id")
        level = []
        for x in pdf["spy_reward"]:
            base = self._alpha * base + (1 - self._alpha) * x
            level.append(base)
        self._state.update((base,))
        yield pd.DataFrame({"run_id": key[0], "game_id": pdf["game_id"].to_numpy(), "spy_reward": pdf["spy_reward"].to_numpy(),
                            "b_spy": level, "spy_adjusted": pdf["spy_reward"].to_numpy() - level})

    def close(self) -> None:
        pass


def role_baseline(games: DataFrame, alpha: float = 0.9) -> DataFrame:
    return games.groupBy("run_id").transformWithStateInPandas(
        statefulProcessor=RoleBaseline(alpha), outputStructType=EMA_OUT, outputMode="Append", timeMode="None")


def reward_health(rollouts: DataFrame, window: str = "1 day", slide: str | None = None, lateness: str = "2 hours",
                  ts: str = "ts") -> DataFrame:
    """Tumbling or sliding reward windows per kind; rows behind the watermark are dropped."""
    win = F.window(ts, window, slide) if slide else F.window(ts, window)
    return rollouts.withWatermark(ts, lateness).groupBy(win.alias("w"), "kind").agg(
        F.count(F.lit(1)).alias("n"), F.avg("reward_scalar").alias("mean_reward")).select(
        F.col("w.start").alias("window_start"), "kind", "n", "mean_reward")


def resume_guard(inputs: DataFrame, config: dict, marker: str) -> None:
    """Refuse to continue a scored folder under other inputs or settings; records them on first use."""
    spark = inputs.sparkSession
    print_ = dataset_fingerprint(inputs).first()
    want = json.dumps({"fingerprint": print_["fingerprint"], "rows": print_["n"], "config": config}, sort_keys=True)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(marker)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(path):
        saved = spark.read.text(marker, wholetext=True).first()[0].strip()
        if saved != want:
            raise RuntimeError("the output was scored under other inputs or settings; use a fresh folder")
        return
    stream = fs.create(path, False)
    stream.write(bytearray(want.encode()))
    stream.close()


def partial_groups(done: DataFrame, inputs: DataFrame, key: str = "task_id") -> DataFrame:
    """Groups of a resumed sink that are neither absent nor whole."""
    sides = index_sides(inputs, done, key)
    return sides.filter((F.col("actual") > 0) & (F.col("actual") != F.col("expected"))).select(key, "expected", "actual")


def stage_restore_check(tables: dict[str, DataFrame], stored: DataFrame) -> DataFrame:
    """Stored counts and digests against the tables: one row per table with both sides and the verdict."""
    now = None
    for name, df in tables.items():
        row = dataset_fingerprint(df).select(F.lit(name).alias("table_name"), F.col("n").alias("rows_now"),
                                             F.col("fingerprint").alias("digest_now"))
        now = row if now is None else now.unionByName(row)
    if now is None:
        raise ValueError("no tables to check")
    return now.join(stored, "table_name", "left").select(
        "table_name", "rows_now", F.col("n").alias("rows_stored"),
        (F.col("rows_now").eqNullSafe(F.col("n")) & F.col("digest_now").eqNullSafe(F.col("fingerprint"))).alias("consistent"))
