"""Completeness, consistency and conflict checks between tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollscope.functions import facts as FX


def scene_verified(edits: DataFrame) -> DataFrame:
    """Whole-scene consistency: every attribute known, every edit changes something, no object twice."""
    known, moved = F.lit(True), F.lit(False)
    for a in FX.ATTRIBUTES:
        known = known & F.col(f"before_{a}").isin(*FX.DOMAINS[a]) & F.col(f"after_{a}").isin(*FX.DOMAINS[a])
        moved = moved | (F.col(f"before_{a}") != F.col(f"after_{a}"))
    # Two steps instead of a distinct count: duplicates show up as a per-object count above one.
    per_object = edits.groupBy("scene_id", "obj").agg(
        F.count(F.lit(1)).alias("n"), F.bool_and(F.coalesce(known & moved, F.lit(False))).alias("ok"))
    return per_object.groupBy("scene_id").agg(
        F.sum("n").alias("edits"), F.bool_and(F.col("ok") & (F.col("n") == 1)).alias("verified"))


def index_sides(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Rows per key on both sides by one tagged union and one aggregate."""
    both = expected.select(key, F.lit(1).alias("e"), F.lit(0).alias("a")).unionByName(
        actual.select(key, F.lit(0).alias("e"), F.lit(1).alias("a")))
    return both.groupBy(key).agg(F.sum("e").alias("expected"), F.sum("a").alias("actual"))


def prediction_completeness(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Counts of missing, extra and repeated indices and whether the predictions are complete."""
    out = index_sides(expected, actual, key).agg(
        F.sum("expected").alias("expected"), F.sum("actual").alias("actual"),
        F.count_if((F.col("expected") > 0) & (F.col("actual") == 0)).alias("missing"),
        F.count_if((F.col("expected") == 0) & (F.col("actual") > 0)).alias("extra"),
        F.count_if(F.col("actual") > 1).alias("duplicates"))
    return out.withColumn("complete", (F.col("expected") > 0) & (F.col("missing") == 0) & (F.col("extra") == 0)
                          & (F.col("duplicates") == 0))


def index_difference(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    sides = index_sides(expected, actual, key).filter("least(expected, 1) <> least(actual, 1)")
    return sides.select(key, F.when(F.col("actual") == 0, F.lit("missing")).otherwise(F.lit("extra")).alias("side"))


def rollout_completeness(tasks: DataFrame, rollouts: DataFrame, key: str, group_size: int) -> DataFrame:
    """Tasks without exactly `group_size` rollouts and rollouts of unknown tasks."""
    sides = index_sides(tasks, rollouts, key)
    return sides.filter((F.col("expected") == 0) | (F.col("actual") != group_size)).select(
        key, "actual", F.when(F.col("expected") == 0, F.lit("stray")).otherwise(F.lit("incomplete")).alias("problem"))


# Text that marks a failed inference.
FAIL_MARKER = "Failed to obtain answer"


def prediction_bad_rows(predictions: DataFrame, index: str, prediction: str) -> DataFrame:
    """Failed, empty and repeated predictions, one row per index."""
    text = F.col(prediction)
    per = predictions.groupBy(index).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.contains(F.coalesce(text, F.lit("")), F.lit(FAIL_MARKER))).alias("failed"),
        F.count_if(F.trim(F.coalesce(text, F.lit(""))) == "").alias("empty"))
    return per.filter("n > 1 or failed > 0 or empty > 0")


def percent_normalize(raw: Column, benchmark: Column, raw_scale: Sequence[str]) -> Column:
    """Score in percent: fractions are scaled unless the benchmark reports percents; out of range is null."""
    text = F.trim(raw)
    has = text.endswith("%")
    value = F.rtrim(text, F.lit("%")).try_cast("double")
    sane = value.isNotNull() & ~F.isnan(value) & (value >= 0)
    fraction = ~benchmark.isin(*raw_scale) & ~has
    pct = F.when(fraction, F.when(value <= 1, value * 100)).otherwise(value)
    return F.when(sane & (pct <= 100), pct)


def score_conflict(scores: DataFrame, cell: Sequence[str], score: str) -> DataFrame:
    """One score per cell, withheld with a reason when files disagree or are invalid."""
    distinct = scores.groupBy(*cell, score).agg(F.count(F.lit(1)).alias("files"))
    per = distinct.groupBy(*cell).agg(
        F.count(F.lit(1)).alias("values"), F.min(score).alias("value"), F.sum("files").alias("files"))
    return per.select(
        *cell, F.when(F.col("values") == 1, F.col("value")).alias("score"), "files",
        F.when(F.col("values") > 1, F.lit("conflicting score files"))
        .when(F.col("value").isNull(), F.lit("invalid overall score")).otherwise(F.lit("ok")).alias("reason"))


def model_benchmark_grid(models: DataFrame, cells: DataFrame, model: str, benchmark: str,
                         required: Sequence[str]) -> DataFrame:
    """Every required cell per model; the benchmark list is a literal array, not a second table."""
    grid = models.select(model, F.explode(F.array(*[F.lit(b) for b in required])).alias(benchmark))
    return grid.join(cells, [model, benchmark], "left").withColumn(
        "reason", F.coalesce(F.col("reason"), F.lit("score file missing")))


def benchmark_average(grid: DataFrame, model: str, benchmark: str, required: Sequence[str],
                      protocols: DataFrame) -> DataFrame:
    """Scores per model as columns plus their mean, given only if every cell is present and all models share one protocol.

    `protocols` has (model, signature) rows; a model without a signature makes the runs incomparable.
    """
    wide = grid.groupBy(model).pivot(benchmark, list(required)).agg(F.first("score"))
    full = F.lit(True)
    for b in required:
        full = full & F.col(b).isNotNull()
    complete = grid.agg(F.bool_and(F.col("score").isNotNull())).scalar()
    signed = grid.select(model).distinct().join(
        protocols.groupBy(model).agg(F.min("signature").alias("lo"), F.max("signature").alias("hi"),
                                     F.bool_and(F.col("signature").isNotNull()).alias("all")), model, "left")
    comparable = signed.agg((F.min("lo") == F.max("hi")) & F.bool_and(F.coalesce(F.col("all"), F.lit(False)))).scalar()
    mean = sum((F.col(b) for b in required), F.lit(0.0)) / len(required)
    return wide.withColumn("average", F.when(complete & F.coalesce(comparable, F.lit(False)) & full, mean))


def protocol_signature(settings: Mapping[str, Column]) -> Column:
    """Digest of the canonical JSON of the settings that make runs comparable; `settings` maps names to values."""
    return F.sha2(F.to_json(F.struct(*[settings[k].alias(k) for k in sorted(settings)])), 256)


def dataset_fingerprint(records: DataFrame) -> DataFrame:
    """Order-free fingerprint of a record set: summed digest limbs, so it folds without collecting rows."""
    digest = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(records.columns)]), {"ignoreNullFields": "false"}), 256)
    limbs = records.select(*[F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)").alias(f"l{i}")
                             for i in range(8)])
    sums = limbs.agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"l{i}").alias(f"l{i}") for i in range(8)])
    return sums.select("n", F.sha2(F.concat_ws("|", F.col("n").cast("string"), *[
        F.col(f"l{i}").cast("string") for i in range(8)]), 256).alias("fingerprint"))
