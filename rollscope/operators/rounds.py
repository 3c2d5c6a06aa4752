"""What the rounds of a run report, and what a round reads from the one before it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollscope.operators import curriculum, skew, stats

SOLVABILITY = ("num_tasks", "mean_solve_rate", "mean_regret", "advantage_collapse_rate",
               "num_too_hard", "num_trainable", "num_mastered")
COUNTS = ("num_pairs", "num_proposals", "num_parsed", "num_reached", "num_trainable_proposals", "distinct_subsets")


def round_report(scored: DataFrame, tasks: DataFrame, proposals: DataFrame, keys: Sequence[str] = ("round",),
                 recorded: DataFrame | None = None) -> DataFrame:
    """Answer, grounding, solvability, counterfactual and proposer sections of every round with scored rows.

    `scored` has the columns of the five operators that make the sections, `tasks` and `proposals` those of
    `counterfactual_pairs` and `proposal_report`; all carry `keys`. A round that `recorded` knows keeps the solvability
    written down then; the others are computed from their rows (`solvability_source`). A section without rows has
    counts 0 and null rates; a round without scored rows has no line. A null key is a round of its own, except in pairs.
    """
    keys = list(keys)
    out = skew.null_safe_join(stats.answer_diagnostics(scored, keys), stats.grounding_diagnostics(scored, keys), keys, "left")
    computed = stats.solvability_summary(stats.task_statistics(scored, scene=None, keys=keys), keys=keys)
    if recorded is None:
        out = skew.null_safe_join(out, computed, keys, "left").withColumn("solvability_source", F.lit("computed"))
    else:
        known = recorded.select(*keys, F.struct(*SOLVABILITY).alias("__known"))
        made = computed.select(*keys, F.struct(*SOLVABILITY).alias("__made"))
        out = skew.null_safe_join(skew.null_safe_join(out, known, keys, "left"), made, keys, "left")
        has = F.col("__known").isNotNull()
        out = out.select("*", *[F.when(has, F.col("__known")[c]).otherwise(F.col("__made")[c]).alias(c) for c in SOLVABILITY],
                         F.when(has, F.lit("recorded")).otherwise(F.lit("computed")).alias("solvability_source"))
        out = out.drop("__known", "__made")
    pairs = curriculum.counterfactual_pairs(scored, tasks, keys)
    out = skew.null_safe_join(out, curriculum.counterfactual_sensitivity(pairs, keys), keys, "left")
    report = curriculum.proposal_report(proposals, "keep", keys).withColumnRenamed("num_trainable", "num_trainable_proposals")
    out = skew.null_safe_join(out, report, keys, "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in COUNTS})


def state_before(rounds: DataFrame, states: Mapping[str, DataFrame], run: str = "run_id", at: str = "round") -> DataFrame:
    """Every round of a run with the state that the newest round before it left.

    `rounds` names the rounds that were run, once or more; a round that is missing there is passed over, so the round
    after it reads the one before it. A state table has (run, round) once and any other columns. What the round before
    did not write stays null: no older value takes its place. Adds `prev_round`, per state `has_<name>` and
    `<name>_<column>`, and `read_prev`, whether any state was found. First rounds find none. Null runs and rounds name nothing.
    """
    known = rounds.filter(F.col(run).isNotNull() & F.col(at).isNotNull()).select(run, at).distinct()
    placed = skew.number_rows_by_key(known, [run], [F.col(at)], "__at")
    before = placed.select(run, (F.col("__at") + 1).alias("__at"), F.col(at).alias("prev_round"))
    out = placed.join(before, [run, "__at"], "left").drop("__at")
    for name, state in states.items():
        values = [c for c in state.columns if c not in (run, at)]
        left = state.select(F.col(run), F.col(at).alias("prev_round"), F.lit(True).alias(f"has_{name}"),
                            *[F.col(c).alias(f"{name}_{c}") for c in values])
        out = out.join(left, [run, "prev_round"], "left").withColumn(f"has_{name}", F.coalesce(f"has_{name}", F.lit(False)))
    found = F.lit(False)
    for name in states:
        found = found | F.col(f"has_{name}")
    return out.withColumn("read_prev", found)
