"""Rankings, quotas, balanced picks, shuffles and allocations."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollscope.operators import skew
from rollscope.operators.stats import MASTERED, TRAINABLE


def hash_order(seed: int | str, *keys: str) -> Column:
    """Reproducible shuffle key: the same seed and keys give the same order everywhere."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]), 256)


def seed_ranking(stats: DataFrame, k: int) -> DataFrame:
    """The k trainable tasks with the most headroom, with the direction to edit them in."""
    verified = "frontier" in stats.columns
    pool = stats.filter(F.col("class") == TRAINABLE)
    order = [F.col("regret").desc()]
    direction = F.when(F.col("pass_rate") >= 0.5, F.lit("harder")).otherwise(F.lit("easier"))
    if verified:
        pool = pool.filter(F.col("gold_certificate_available"))
        order += [F.coalesce(F.col("evidence_gap"), F.lit(0.0)).desc(), F.col("evidence_std").desc()]
        direction = F.when(F.col("frontier") == "evidence", F.lit("hold")).otherwise(direction)
    order.append(F.col("task_id").asc())
    # sort + limit is a distributed top-k; the rank then runs over at most k rows.
    top = pool.orderBy(*order).limit(k)
    return top.select("*", direction.alias("direction"),
                      F.row_number().over(Window.orderBy(*order)).alias("rank"))


def retire_scenes(stats: DataFrame) -> DataFrame:
    """Mastered tasks of scenes whose every evaluated task is mastered (and certified, if known)."""
    ok = F.col("class") == MASTERED
    if "gold_certificate_available" in stats.columns:
        ok = ok & F.col("gold_certificate_available")
    scenes = (stats.filter(F.col("scene_id").isNotNull()).groupBy("scene_id")
              .agg(F.bool_and(ok).alias("done")).filter("done").select("scene_id"))
    return stats.filter(F.col("class") == MASTERED).join(scenes, "scene_id", "left_semi")


def top1_positive(scored: DataFrame) -> DataFrame:
    """The best positive of a task stays, its other positives become `unused`; ties keep the earliest."""
    best = scored.filter(F.col("buffer") == "positive").groupBy("task_id").agg(
        F.count(F.lit(1)).alias("__n"),
        F.max_by("gen_index", F.struct(F.col("reward_scalar"), -F.col("gen_index"))).alias("__best"))
    out = skew.attach_stats(scored, best, ["task_id"])
    extra = (F.col("buffer") == "positive") & (F.col("gen_index") != F.col("__best"))
    return out.select(
        *[c for c in scored.columns if c != "buffer"],
        F.when(extra, F.lit("unused")).otherwise(F.col("buffer")).alias("buffer"),
        F.when(extra, F.lit("positive_not_top1_for_task")).alias("selection_reason"))


def balanced_pick(df: DataFrame, label: str, order: Sequence[Column], n: int) -> DataFrame:
    """n rows with the flattest label histogram: rank per label, then take ranks round by round."""
    ranked = skew.top_per_key(df, [label], order, n, rank="__rn")
    return ranked.orderBy("__rn", label).limit(n).drop("__rn")


def interleave_kinds(df: DataFrame, kind: str, kind_pos: Column, order: Sequence[Column], cap: int) -> DataFrame:
    """Round-robin over kinds up to a cap; output carries its position."""
    ranked = skew.top_per_key(df.withColumn("__kp", kind_pos), [kind], order, cap, rank="__rn")
    top = ranked.orderBy("__rn", "__kp").limit(cap)
    return top.withColumn("pos", F.row_number().over(Window.orderBy("__rn", "__kp"))).drop("__rn", "__kp")


def quota_prefix(df: DataFrame, keys: Sequence[str], order: Sequence[Column], accepted: str, quota: int,
                 budget_factor: float = 1.5) -> DataFrame:
    """Judged prefix per key: rows in order until `quota` accepts or ceil(factor * quota) judgements."""
    budget = math.ceil(quota * budget_factor)
    # At most `budget` rows per key can be judged, so the running sum below sees a bounded partition.
    head = skew.top_per_key(df, keys, order, budget, rank="judge_pos")
    w = Window.partitionBy(*keys).orderBy("judge_pos").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col(accepted).cast("int")).over(w), F.lit(0))
    return head.withColumn("accepted_before", before).filter(F.col("accepted_before") < quota)


def seeded_limit(df: DataFrame, seed: int | str, keys: Sequence[str], n: int) -> DataFrame:
    """Deterministic shuffle, then the first n rows."""
    return df.orderBy(hash_order(seed, *keys)).limit(n)


def difficulty_allocation(mix: DataFrame, total: str, shares: Sequence[str]) -> DataFrame:
    """Whole-number shares per run that add up to the total.

    Every share is rounded half-even. Units that are missing go to all buckets alike, the rest of them to the largest
    shares. Units too many are taken from all buckets alike down to a common depth (or to zero), the rest of them from
    the largest shares that still have some.
    """
    k = len(shares)
    whole = lambda c: c.cast("bigint")
    added = lambda xs: F.aggregate(xs, whole(F.lit(0)), lambda s, x: s + x)
    base = F.array(*[whole(F.bround(F.col(s) * F.col(total), 0)) for s in shares])
    # Bucket numbers by share, largest first, ties in the given order.
    order = F.transform(F.array_sort(F.array(*[
        F.struct((-F.col(s)).alias("w"), F.lit(i).alias("i")) for i, s in enumerate(shares)])), lambda x: x["i"])
    rows = mix.withColumns({"__b": base, "__o": order}).withColumn("__d", whole(F.col(total)) - added(F.col("__b")))
    up, down = F.greatest(F.col("__d"), F.lit(0)), F.greatest(-F.col("__d"), F.lit(0))
    # Depth r: the largest whole number with sum(least(bucket, r)) <= down; that sum is the least over all splits of
    # the sorted buckets into m emptied ones and k - m cut by r.
    depth = F.array_max(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda m: F.floor(
        (down - added(F.slice(F.array_sort("__b"), F.lit(1), m))) / (k - m))))
    rows = rows.withColumns({"__up": up, "__r": whole(depth)})
    cut = F.transform("__b", lambda b: F.least(b, F.col("__r")))
    rows = rows.withColumn("__left", (down - added(cut)).cast("int"))
    more = F.slice("__o", F.lit(1), (F.col("__up") % k).cast("int"))
    less = F.slice(F.filter("__o", lambda i: F.get("__b", i) > F.col("__r")), F.lit(1), F.col("__left"))
    one = lambda xs, i: F.array_contains(xs, i).cast("bigint")
    return rows.select(*mix.columns, *[
        (F.get("__b", F.lit(i)) + whole(F.floor(F.col("__up") / k)) + one(more, F.lit(i))
         - F.least(F.get("__b", F.lit(i)), F.col("__r")) - one(less, F.lit(i))).alias(f"n_{s}") for i, s in enumerate(shares)])


def cyclic_repeat(df: DataFrame, key: str, seed: int, epoch: int, batch: int, cycle: int, mini: int) -> DataFrame:
    """Seeded order, incomplete batch dropped, each batch repeated `cycle` times, each row `mini` times."""
    if min(batch, cycle, mini) <= 0:
        raise ValueError("batch, cycle and mini must be positive")
    shuffled = df.withColumn("__h", hash_order(seed + epoch, key))
    numbered = skew.number_rows(shuffled, [F.col("__h")], "__rn").drop("__h")
    total = numbered.agg(F.max("__rn")).scalar()
    kept = numbered.filter(F.col("__rn") <= F.floor(total / batch) * batch)
    pos = (F.col("__rn") - 1)
    rows = kept.select(
        key, F.floor(pos / batch).alias("batch_id"), (pos % batch).alias("slot"),
        F.explode(F.sequence(F.lit(0), F.lit(cycle - 1))).alias("cycle"))
    return rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(mini - 1))).alias("repeat")).withColumn(
        "pos", (F.col("batch_id") * cycle + F.col("cycle")) * batch * mini + F.col("slot") * mini + F.col("repeat"))


def slot_assignment(position: Column, version: Column, players: Column) -> Column:
    return F.pmod(position + version, players) + 1


def take_by_mode(df: DataFrame, mode: str, pos: Column, key: str, seed: int = 0) -> DataFrame:
    """Source sampling: `all`, `first:N`, `end:N`, `random:N`, N may end in %."""
    if mode == "all":
        return df
    how, _, amount = mode.partition(":")
    if how not in ("first", "end", "random"):
        raise ValueError(f"unknown sampling mode: {mode}")
    order = {"first": pos.asc(), "end": pos.desc(), "random": hash_order(seed, key)}[how]
    if not amount.endswith("%"):
        return df.orderBy(order).limit(int(amount))
    share = float(amount[:-1]) / 100.0
    numbered = skew.number_rows(df.withColumn("__o", order if how == "random" else pos),
                                [F.col("__o").desc() if how == "end" else F.col("__o").asc()], "__rn")
    size = numbered.agg(F.max("__rn")).scalar()
    return numbered.filter(F.col("__rn") <= F.ceil(size * share)).drop("__rn", "__o")


def bucket_limits(df: DataFrame, bucket: str, order: Sequence[Column], limits: Mapping[str, int]) -> DataFrame:
    """First rows of each bucket up to that bucket's own limit."""
    most = max(limits.values()) if limits else 0
    ranked = skew.top_per_key(df.filter(F.col(bucket).isin(list(limits))), [bucket], order, most, rank="__rn")
    limit = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])[F.col(bucket)]
    return ranked.filter(F.col("__rn") <= limit).drop("__rn")
