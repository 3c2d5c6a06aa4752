"""Per-task and per-run statistics of scored rollouts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollscope.operators.skew import attach_stats, null_safe_join, with_group_stats

# Pass-rate classes.
TOO_HARD, TRAINABLE, MASTERED = "too_hard", "trainable", "mastered"


def finite(value: Column) -> Column:
    """The value when it is a finite number, else null."""
    v = value.cast("double")
    return F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), v)


def clean_scalar(scalar: Column, answer: Column | None = None) -> Column:
    """Reward scalar; a missing one falls back to the answer dimension, a non-finite one is 0."""
    first = scalar.cast("double")
    if answer is not None:
        first = F.coalesce(first, answer.cast("double"))
    return F.coalesce(finite(first), F.lit(0.0))


def solved_flag(spy_correct: Column, answer: Column) -> Column:
    """Solved = the odd-image field is right when it was scored, else a full answer score."""
    return F.coalesce(spy_correct, answer >= 1.0, F.lit(False))


def pass_class(pass_rate: Column, verified_rate: Column | None = None) -> Column:
    top = pass_rate >= 1.0
    if verified_rate is not None:
        top = top & (verified_rate >= 1.0)
    return (F.when(pass_rate <= 0.0, F.lit(TOO_HARD)).when(top, F.lit(MASTERED))
            .otherwise(F.lit(TRAINABLE)))


def task_statistics(rollouts: DataFrame, *, task: str = "task_id", reward: str = "reward_scalar",
                    solved: str = "solved", scene: str | None = "scene_id",
                    order: str | None = "gen_index", keys: Sequence[str] = ()) -> DataFrame:
    """One row per task (of each of `keys`): size, pass rate, mean / max reward, regret, population std, class, scene.

    One partial/final hash aggregate on the task; no row of a task is ever gathered.
    """
    r = clean_scalar(F.col(reward))
    aggs = [
        F.count(F.lit(1)).alias("n"),
        F.avg(F.coalesce(F.col(solved), F.lit(False)).cast("int")).alias("pass_rate"),
        F.avg(r).alias("mean_reward"), F.max(r).alias("max_reward"),
        F.stddev_pop(r).alias("reward_std"),
    ]
    if scene is not None:
        aggs.append((F.min_by(scene, order) if order else F.min(scene)).alias("scene_id"))
    out = rollouts.groupBy(*keys, task).agg(*aggs)
    return out.select(
        "*", (F.col("max_reward") - F.col("mean_reward")).alias("regret"),
        pass_class(F.col("pass_rate")).alias("class"))


def solvability_summary(stats: DataFrame, std_floor: float = 0.02, keys: Sequence[str] = ()) -> DataFrame:
    """One row over all tasks, or per key. The collapse test reads the std rounded to 4 places, as reported."""
    return stats.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("num_tasks"),
        F.avg("pass_rate").alias("mean_solve_rate"),
        F.avg("regret").alias("mean_regret"),
        F.avg((F.round("reward_std", 4) <= std_floor).cast("int")).alias("advantage_collapse_rate"),
        *[F.count_if(F.col("class") == c).alias(f"num_{c}") for c in (TOO_HARD, TRAINABLE, MASTERED)])


def verified_summary(stats: DataFrame) -> DataFrame:
    """Summary of certificate-based statistics: frontier counts and mean over certified tasks only."""
    return stats.agg(
        *[F.count_if(F.col("frontier") == f).alias(f"num_{f}") for f in ("spy", "evidence", "unverifiable")],
        F.count_if("gold_certificate_available").alias("num_certified_tasks"),
        F.avg(F.when(F.col("gold_certificate_available"), F.col("verified_pass_rate")))
        .alias("mean_verified_pass_rate"))


def task_statistics_verified(rollouts: DataFrame, certificates: DataFrame) -> DataFrame:
    """Statistics that also require a visual certificate for mastery.

    `rollouts` carries `certified` (boolean per rollout); `certificates` has one row per uniquely
    accepted task with `gold_certificate_available`.
    """
    base = rollouts.groupBy("task_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("solved").cast("int")).alias("pass_rate"),
        F.avg("reward_scalar").alias("mean_reward"), F.max("reward_scalar").alias("max_reward"),
        F.stddev_pop("reward_scalar").alias("reward_std"),
        F.avg(F.coalesce(F.col("certified"), F.lit(False)).cast("int")).alias("certified_rate"))
    joined = base.join(certificates.select("task_id", "gold_certificate_available"), "task_id", "left")
    ok = F.coalesce(F.col("gold_certificate_available"), F.lit(False))
    rate = F.when(ok, F.col("certified_rate")).otherwise(F.lit(0.0))
    klass = pass_class(F.col("pass_rate"), rate)
    return joined.select(
        "task_id", "n", "pass_rate", "mean_reward", "max_reward", "reward_std",
        (F.col("max_reward") - F.col("mean_reward")).alias("regret"),
        ok.alias("gold_certificate_available"), rate.alias("verified_pass_rate"),
        F.when(ok, 1.0 - rate).alias("evidence_gap"),
        F.sqrt(rate * (1.0 - rate)).alias("evidence_std"), klass.alias("class"),
        F.when(~ok, F.lit("unverifiable"))
        .when((F.col("pass_rate") >= 1.0) & (klass == TRAINABLE), F.lit("evidence"))
        .when(klass == TRAINABLE, F.lit("spy")).alias("frontier"))


def modal_value(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Most frequent non-null value per key, ties to the smallest; counts first, so hot keys stay cheap."""
    counts = (df.filter(F.col(value).isNotNull()).groupBy(*keys, value)
              .agg(F.count(F.lit(1)).alias("c")))
    best = F.min_by(F.struct(F.col(value), F.col("c")), F.struct(-F.col("c"), F.col(value)))
    return (counts.groupBy(*keys).agg(best.alias("b"))
            .select(*keys, F.col("b")[value].alias("mode"), F.col("b")["c"].alias("mode_count")))


def answer_diagnostics(rollouts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per round: modal predicted count and its share of all rows, per-field accuracy, parse failures."""
    hit = lambda p, g: F.coalesce((F.col(p) == F.col(g)), F.lit(False)).cast("int")
    base = rollouts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(hit("spy_pred", "spy_gold")).alias("spy_acc"),
        F.avg(hit("count_pred", "count_gold")).alias("count_acc"),
        F.count_if(F.col("count_pred").isNull()).alias("parse_failed"))
    mode = modal_value(rollouts, keys, "count_pred")
    return null_safe_join(base, mode, list(keys), "left").select(
        *keys, "n", "mode", (F.coalesce(F.col("mode_count"), F.lit(0)) / F.col("n")).alias("mode_share"),
        "spy_acc", "count_acc", "parse_failed")


def value_histograms(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Long histogram: one row per key, field and non-null value."""
    arr = F.array(*[F.struct(F.lit(v).alias("field"), F.col(v).cast("bigint").alias("value")) for v in values])
    rows = df.select(*keys, F.inline(arr))
    return (rows.filter(F.col("value").isNotNull()).groupBy(*keys, "field", "value")
            .agg(F.count(F.lit(1)).alias("cnt")))


def grounding_diagnostics(scored: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Valid-box rate, mean IoU of valid rows, share of rows above 0.3 and box counts."""
    iou = F.when(F.col("bbox_valid"), F.col("iou"))
    return scored.groupBy(*keys).agg(
        F.avg(F.col("bbox_valid").cast("int")).alias("bbox_valid_rate"),
        F.avg(iou).alias("mean_iou_given_valid"),
        F.avg(F.coalesce(iou > 0.3, F.lit(False)).cast("int")).alias("iou_above_rate"),
        F.avg("num_boxes").alias("mean_pred_boxes"), F.max("num_boxes").alias("max_pred_boxes"))


def group_reward_stats(rollouts: DataFrame, group_size: int | None = None) -> DataFrame:
    """Mean and sample std per group; with `group_size`, an incomplete group raises at run time."""
    out = rollouts.groupBy("task_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg("reward_scalar").alias("mean_reward"),
        F.stddev_samp("reward_scalar").alias("std_reward"))
    if group_size is not None:
        if group_size < 2:
            raise ValueError("groups need at least two rollouts")
        guard = F.when(F.col("n") == group_size, F.col("n")).otherwise(
            F.raise_error(F.concat(F.lit("incomplete group "), F.col("task_id").cast("string"))).cast("bigint"))
        out = out.withColumn("n", guard)
    return out


def group_advantage(rollouts: DataFrame, *, scale: bool = False, mask_std: float | None = None,
                    eps: float = 1e-4) -> DataFrame:
    """Reward minus group mean, optionally over (sample std + eps); degenerate groups masked to 0."""
    df = with_group_stats(rollouts, ["task_id"], {
        "group_mean": F.avg("reward_scalar"), "group_std": F.stddev_samp("reward_scalar")})
    adv = F.col("reward_scalar") - F.col("group_mean")
    if scale:
        adv = adv / (F.col("group_std") + eps)
    if mask_std is not None:
        adv = F.when(F.col("group_std") <= mask_std, F.lit(0.0)).otherwise(adv)
    return df.withColumn("advantage", adv)


def degenerate_groups(rollouts: DataFrame, std_threshold: float) -> DataFrame:
    """Groups whose sample std is at or below the threshold, with their size."""
    return group_reward_stats(rollouts).filter(F.round("std_reward", 9) <= std_threshold)


def overlong_mask(advantages: DataFrame, truncated: Column) -> DataFrame:
    """Truncated rollouts contribute no advantage."""
    return advantages.withColumn("advantage", F.when(truncated, F.lit(0.0)).otherwise(F.col("advantage")))


def kind_breakdown(df: DataFrame, dims: Sequence[str], kind: str = "kind") -> DataFrame:
    """Mean and count of each dimension overall and per kind; missing and non-finite values excluded."""
    vals = df.select(kind, *[finite(F.col(d)).alias(d) for d in dims])
    grouped = vals.groupingSets([[], [F.col(kind)]], F.col(kind)).agg(
        F.grouping(kind).alias("is_total"), F.count(F.lit(1)).alias("samples"),
        *[F.avg(d).alias(f"mean_{d}") for d in dims], *[F.count(d).alias(f"n_{d}") for d in dims])
    return grouped.withColumn(kind, F.when(F.col("is_total") == 1, F.lit("all")).otherwise(F.col(kind))) \
        .drop("is_total")


def answer_shares(df: DataFrame, key: str, answer: str) -> DataFrame:
    """Per different answer of a group: `cnt` rows, their share of the group (0 for an empty answer), and the group's share on the modal answer."""
    counts = df.groupBy(key, answer).agg(F.count(F.lit(1)).alias("cnt"))
    said = F.col(answer) != ""
    totals = counts.groupBy(key).agg(
        F.sum("cnt").alias("__n"), F.sum(F.when(said, F.col("cnt"))).alias("answered"),
        F.max(F.when(said, F.col("cnt"))).alias("top"))
    modal = F.when(F.coalesce(F.col("answered"), F.lit(0)) <= 1, F.lit(1.0)).otherwise(
        F.col("top") / F.col("answered"))
    return counts.join(totals, key).select(
        key, answer, "cnt", F.when(said, F.col("cnt") / F.col("__n")).otherwise(F.lit(0.0)).alias("same_share"),
        modal.alias("modal_share"))


def group_agreement(df: DataFrame, key: str, answer: str) -> DataFrame:
    """Per row: share of its group giving the same answer. Per group: share on the modal answer."""
    return attach_stats(df, answer_shares(df, key, answer), [key, answer], "cnt")


def prior_baseline(df: DataFrame, pred: str, gold: str, margin: float = 0.05) -> DataFrame:
    """Accuracy against always answering the most common gold value."""
    right = F.coalesce(F.col(pred) == F.col(gold), F.lit(False))
    # One pass: rows and hits per gold value, then totals over the few distinct values.
    per = df.groupBy(gold).agg(F.count(F.lit(1)).alias("c"), F.count_if(right).alias("hits"))
    out = per.agg(F.sum("c").alias("n"), (F.sum("hits") / F.sum("c")).alias("accuracy"),
                  (F.max("c") / F.sum("c")).alias("prior_accuracy"))
    return out.withColumn("beats_prior", F.col("accuracy") > F.col("prior_accuracy") + margin)


def label_correlation(df: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """Pearson r, null under two rows or without variance on either side."""
    stats = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.corr(x, y).alias("r"),
        F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"))
    ok = (F.col("n") >= 2) & (F.col("vx") > 0) & (F.col("vy") > 0)
    return stats.select(*keys, "n", F.when(ok, F.col("r")).alias("r"))


def failure_profile(scored: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Long profile: reward means, tag counts over the failure buffer without `positive`, buffer counts."""
    means = scored.agg(*[F.avg(d).alias(d) for d in dims]).select(F.inline(F.array(*[
        F.struct(F.lit("reward_mean").alias("section"), F.lit(d).alias("name"), F.col(d).alias("value"))
        for d in dims])))
    tags = (scored.filter(F.col("buffer") == "failure").select(F.explode_outer("failure_tags").alias("name"))
            .filter(F.col("name") != "positive").groupBy("name")
            .agg(F.count(F.lit(1)).cast("double").alias("value"))
            .select(F.lit("failure_tag").alias("section"), "name", "value"))
    buffers = (scored.groupBy(F.col("buffer").alias("name"))
               .agg(F.count(F.lit(1)).cast("double").alias("value"))
               .select(F.lit("buffer").alias("section"), "name", "value"))
    return means.unionByName(tags).unionByName(buffers)


def label_histograms(df: DataFrame, label: str, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("cnt"))
