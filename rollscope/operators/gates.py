"""Ordered first-match rules: acceptance, routing and failure tags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Difficulty bands, gate thresholds and reasons.
DIFFICULTY_RANK = {"easy": 0, "medium": 1, "hard": 2}
SOLVABILITY_THRESHOLD = 0.4
AMBIGUITY_THRESHOLD = 0.8
TOO_HARD_REASON = "too_hard_for_difficulty_target"
LOW_SOLVABILITY_REASON = "low_solvability"
HIGH_AMBIGUITY_REASON = "high_ambiguity"
# Fixed value: a dimension under this counts as failed.
TAG_THRESHOLD = 0.5


def difficulty_rank(level: Column) -> Column:
    """easy 0, medium 1, hard 2; anything else counts as medium."""
    out = F.lit(1)
    for name, rank in DIFFICULTY_RANK.items():
        out = F.when(level == name, F.lit(rank)).otherwise(out)
    return out


def easier_level(target: Column) -> Column:
    """One band below the target, never below easy."""
    return F.when(difficulty_rank(target) >= 2, F.lit("medium")).otherwise(F.lit("easy"))


def accept_reason(level: Column, target: Column, solvability: Column, ambiguity: Column | None = None,
                  *, gap: int = 2, threshold: float = SOLVABILITY_THRESHOLD) -> Column:
    """Reject reason, empty when accepted. Missing signals never reject."""
    too_hard = difficulty_rank(F.coalesce(level, F.lit("medium"))) - difficulty_rank(target) >= max(1, gap)
    out = (F.when(too_hard, F.lit(TOO_HARD_REASON))
           .when(F.coalesce(solvability, F.lit(1.0)) < threshold, F.lit(LOW_SOLVABILITY_REASON)))
    if ambiguity is not None:
        out = out.when(F.coalesce(ambiguity, F.lit(0.0)) > AMBIGUITY_THRESHOLD, F.lit(HIGH_AMBIGUITY_REASON))
    return out.otherwise(F.lit(""))


def accept_gate(df: DataFrame, *, ambiguity: str | None = None, gap: int = 2,
                threshold: float = SOLVABILITY_THRESHOLD) -> DataFrame:
    reason = accept_reason(F.col("difficulty_level"), F.col("difficulty_target"), F.col("solvability_score"),
                           F.col(ambiguity) if ambiguity else None, gap=gap, threshold=threshold)
    return df.withColumn("reject_reason", reason).withColumn("accepted", F.col("reject_reason") == "")


def gate_feedback(df: DataFrame) -> DataFrame:
    """Feedback columns rebuilt from the gate outcome; too hard suggests one band easier."""
    too_hard = F.col("reject_reason") == TOO_HARD_REASON
    return df.select(
        "*", too_hard.alias("reduce_difficulty"),
        F.when(too_hard, easier_level(F.col("difficulty_target")))
        .otherwise(F.col("difficulty_target")).alias("suggested_difficulty"))


def failure_tag(answer: Column, budget: Column, process: Column, grounding: Column,
                consistency: Column) -> Column:
    """Single first-match tag of a reward vector."""
    t = TAG_THRESHOLD
    full = answer >= 1.0
    return (F.when(full & (process >= t) & (grounding >= t), F.lit("positive"))
            .when(full & (grounding < t), F.lit("shortcut_or_ungrounded_success"))
            .when(answer < 1.0, F.lit("reasoning_or_final_decision_failure"))
            .when(process < t, F.lit("process_failure"))
            .when(budget < t, F.lit("budget_failure"))
            .when(consistency < t, F.lit("consistency_failure"))
            .otherwise(F.lit("unknown_failure")))


def failure_tags(answer: Column, budget: Column, process: Column, grounding: Column,
                 consistency: Column) -> Column:
    """All tags that hold, in fixed order; `unknown_failure` when none does."""
    t = TAG_THRESHOLD
    full = answer >= 1.0
    rules = [
        (full & (process >= t) & (grounding >= t), "positive"),
        (full & (grounding < t), "shortcut_or_ungrounded_success"),
        (answer < 1.0, "reasoning_or_final_decision_failure"),
        (budget < t, "budget_failure"), (process < t, "process_failure"),
        (grounding < t, "grounding_failure"), (consistency < t, "consistency_failure"),
    ]
    tags = F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in rules]))
    return F.when(F.size(tags) == 0, F.array(F.lit("unknown_failure"))).otherwise(tags)


def route_reason(answer: Column, grounding: Column, process: Column, format_valid: Column,
                 shortcut: Column, tags: Column, facts_score: Column | None = None, *,
                 min_grounding: float = 0.2, min_process: float = 0.4, min_facts: float = 0.0) -> Column:
    """Routing reason of one rollout; the buffer is `positive` only for the last reason."""
    bad = lambda c: c.isNull() | F.isnan(c) | (c < 0.0) | (c > 1.0)
    out = (F.when(bad(answer) | bad(grounding) | bad(process), F.lit("invalid_reward_vector"))
           .when(answer < 1.0, F.lit("answer_incorrect"))
           .when(~F.coalesce(format_valid, F.lit(True)), F.lit("correct_answer_but_format_invalid"))
           .when(grounding < min_grounding, F.lit("correct_answer_but_grounding_below_threshold"))
           .when(process < min_process, F.lit("correct_answer_but_process_below_threshold")))
    if min_facts > 0.0 and facts_score is not None:
        out = out.when(bad(facts_score) | (facts_score < min_facts),
                       F.lit("correct_answer_but_visual_facts_incomplete"))
    hit = F.coalesce(shortcut, F.lit(False)) | F.array_contains(tags, "shortcut_or_ungrounded_success")
    return (out.when(hit, F.lit("correct_answer_but_shortcut_detected"))
            .when(F.array_contains(tags, "evidence_mismatch"), F.lit("correct_answer_but_evidence_mismatch"))
            .otherwise(F.lit("correct_grounded_structured")))


def tag_and_route(df: DataFrame, *, min_grounding: float = 0.2, min_process: float = 0.4,
                  min_facts: float = 0.0) -> DataFrame:
    """Add failure tags, buffer and reason to rows holding the five dimensions and their flags."""
    dims = [F.col(d) for d in ("answer", "budget", "process", "grounding", "consistency")]
    tagged = df.withColumn("failure_tags", failure_tags(*dims))
    facts = F.col("visual_facts_score") if "visual_facts_score" in df.columns else None
    reason = route_reason(F.col("answer"), F.col("grounding"), F.col("process"), F.col("format_valid"),
                          F.col("shortcut_detected"), F.col("failure_tags"), facts,
                          min_grounding=min_grounding, min_process=min_process, min_facts=min_facts)
    return tagged.withColumn("routing_reason", reason).withColumn(
        "buffer", F.when(F.col("routing_reason") == "correct_grounded_structured", F.lit("positive"))
        .otherwise(F.lit("failure")))


def keep_valid(keep: Column, num_edits: Column) -> Column:
    """Sorted kept positions; all edits when none given, null when malformed."""
    ok = (F.size(keep) > 0) & (F.size(F.array_distinct(keep)) == F.size(keep)) & F.forall(
        keep, lambda i: i.isNotNull() & (i >= 0))
    every = F.when(num_edits > 0, F.sequence(F.lit(0).cast("bigint"), num_edits.cast("bigint") - 1))
    return F.when(keep.isNull(), every).when(ok, F.array_sort(keep))


def dispatch(method: Column, scorers: dict[str, Column], default: str) -> Column:
    """Pick a scorer per row by its method name, unknown names take the default."""
    out = scorers[default]
    for name, col in scorers.items():
        if name != default:
            out = F.when(method == name, col).otherwise(out)
    return out


def all_present(cols: Sequence[str]) -> Column:
    out = F.lit(True)
    for c in cols:
        out = out & F.col(c).isNotNull()
    return out
