"""Score and route: completions plus task context to reward vector, tags, buffer and scalar.

Everything up to the scalar is a narrow projection over one join with the task context; only the
top-1 selection and group agreement aggregate per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollscope.functions import boxes as B
from rollscope.functions import facts as FX
from rollscope.functions import rewards as R
from rollscope.functions import text as T
from rollscope.operators import gates, ranking
from rollscope.operators.pairs import mean_sibling_evidence, mean_sibling_jaccard, sibling_evidence
from rollscope.operators.stats import group_agreement
from rollscope.operators.skew import null_safe_join
from rollscope.session import cut_lineage


def extract(rollouts: DataFrame, mode: str = "auto") -> DataFrame:
    """Parse every completion once. Needs completion, solution, image_width and image_height."""
    c, s = F.col("completion"), F.col("solution")
    df = rollouts.withColumns({
        "spy": T.spy_field(c), "changed": T.count_field(c), "spy_gold": T.spy_field(s), "changed_gold": T.count_field(s),
        "exact": R.exact_answer(c, s), "format_valid": T.format_valid(c), "reasoning": T.reasoning(c),
        "attempts": B.evidence_attempts(c)})
    df = df.withColumns({
        "thought": T.squeeze(F.col("reasoning")), "steps": F.size(T.reasoning_steps(F.col("reasoning"))),
        "scaled": B.scaled_attempts(F.col("attempts"), F.col("image_width"), F.col("image_height"), mode)})
    return df.withColumns({
        "words": T.word_count(F.col("thought")), "valid": B.valid_boxes(F.col("scaled")),
        "num_found": F.size("attempts")})


def dimensions(parsed: DataFrame, cfg: R.RewardConfig) -> DataFrame:
    """The five dimensions of parsed rollouts. Needs gold_boxes (pixels) and valid_players of the task."""
    w, h = F.col("image_width"), F.col("image_height")
    df = parsed.withColumns({
        "pred_px": F.transform("valid", lambda a: F.array(a["box"][0] * w, a["box"][1] * h, a["box"][2] * w, a["box"][3] * h)),
        "players_ok": (F.size("valid") > 0) & F.forall("valid", lambda a: F.coalesce(
            F.array_contains(F.col("valid_players"), a["player"]), F.lit(False))),
        "all_name_spy": F.forall("valid", lambda a: F.coalesce(a["player"] == F.col("spy"), F.lit(False)))})
    if cfg.match_mode == "f1":
        df = df.withColumn("match", B.greedy_fold(B.iou_pairs(F.col("gold_boxes"), F.col("pred_px")), cfg.iou_threshold))
        overlap = B.match_scores(F.col("match.total"), F.size("gold_boxes"), F.size("pred_px"))[2]
    else:
        overlap = B.best_recall(F.col("gold_boxes"), F.col("pred_px"), cfg.iou_threshold)
    df = df.withColumns({
        "overlap": overlap, "shortcut_detected": R.shortcut(F.col("thought")) & (F.col("thought") != ""),
        "causal": R.causal_structure(F.col("thought")), "structure": R.spy_structure(F.col("thought"))})
    facts = None
    if cfg.process_mode == "visual_facts":
        df = df.withColumn("claims", FX.change_claims(F.col("completion")))
        tp = FX.multiset_overlap(F.col("claims.facts"), F.col("gold_facts"))
        facts = FX.fact_scores(tp, F.size("claims.facts") + F.col("claims.invalid"), F.size("gold_facts"))[2]
        df = df.withColumn("visual_facts_score", facts)
        facts = F.col("visual_facts_score")
    budget_steps = F.col("budget_steps") if "budget_steps" in df.columns else F.lit(None).cast("bigint")
    budget_tokens = F.col("budget_tokens") if "budget_tokens" in df.columns else F.lit(None).cast("bigint")
    return df.withColumns({
        "answer": R.answer_score(F.col("spy"), F.col("changed"), F.col("spy_gold"), F.col("changed_gold"), F.col("exact"), cfg),
        "budget": R.budget_score(F.when(F.col("reasoning") == "", F.lit(0)).otherwise(F.col("steps")), F.col("words"),
                                 budget_steps, budget_tokens, cfg.fallback_tokens),
        "process": R.process_score(F.col("thought"), F.col("causal"), F.col("structure"), F.col("shortcut_detected"),
                                   facts=facts, verified_weight=cfg.verified_weight),
        "grounding": R.grounding_score(F.col("num_found"), F.size("valid"), F.col("overlap"), F.size("gold_boxes"),
                                       F.col("players_ok"), F.size("valid_players") == 1, cfg),
        "consistency": R.field_consistency(
            F.col("spy"), F.col("changed"), F.col("thought"), F.size("valid"), F.col("all_name_spy"),
            B.near_duplicates(F.transform("valid", lambda a: a["box"])))})


def score_rollouts(rollouts: DataFrame, tasks: DataFrame, cfg: R.RewardConfig | None = None) -> DataFrame:
    """Full scoring: join context, parse, score, tag, route, scalar.

    rollouts: task_id, gen_index, completion, solution. tasks: task_id (unique), gold_boxes,
    valid_players, image_width, image_height and, for verified facts, gold_facts.
    """
    cfg = cfg or R.RewardConfig()
    df = dimensions(extract(rollouts.join(tasks, "task_id"), cfg.coordinate_mode), cfg)
    scalar = R.scalarize({d: F.col(d) for d in R.DIMENSIONS}, cfg, spy_correct(), F.col("exact") >= 1.0,
                         F.col("format_valid"), F.col("gen_index"))
    routed = gates.tag_and_route(df, min_grounding=cfg.min_grounding, min_process=cfg.min_process, min_facts=cfg.min_facts)
    return routed.withColumn("reward_scalar", scalar)


def spy_correct():
    """Null when gold has no spy, else whether the predicted spy equals it."""
    return F.when(F.col("spy_gold").isNotNull(), F.coalesce(F.col("spy") == F.col("spy_gold"), F.lit(False)))


# Parsed intermediates that nothing after scoring reads.
SCRATCH = ("attempts", "scaled", "valid", "pred_px", "match", "claims", "steps", "thought", "causal", "structure",
           "all_name_spy", "words")


def score_and_route(rollouts: DataFrame, tasks: DataFrame, cfg: R.RewardConfig | None = None) -> DataFrame:
    """Scored rollouts where at most the best positive of a task stays positive.

    The scored rows are stored once before the selection: a filter on `buffer` would otherwise be
    pushed below the scoring and unfold every parse it depends on again.
    """
    scored = score_rollouts(rollouts, tasks, cfg)
    kept = cut_lineage(scored.drop(*SCRATCH))
    return ranking.top1_positive(kept)


def group_consistency(rollouts: DataFrame, answer: float = 0.4, evidence: float = 0.3, reasoning: float = 0.3,
                      boxes: str | None = None) -> DataFrame:
    """Agreement of a rollout with its group: same answer, shared evidence, similar reasoning.

    Evidence is the words of the reasoning; in a group where the column `boxes` names predicted boxes, it is these.
    """
    words = F.array(*[F.lit(x) for x in R.EVIDENCE_WORDS])
    given = [F.col(boxes).alias("boxes")] if boxes else []
    src = rollouts.select("task_id", "gen_index", T.answer_norm(F.col("completion")).alias("said"),
                          T.tokens(T.reasoning(F.col("completion"))).alias("toks"), *given)
    # Three comparisons read these rows several times each: parse once, store, compare.
    src = cut_lineage(src.withColumn("keys", F.array_intersect("toks", words)))
    same = group_agreement(src.select("task_id", "gen_index", "said"), "task_id", "said")
    if boxes:
        ev = sibling_evidence(src, ["task_id"], "gen_index", "keys", "boxes").drop("method")
    else:
        ev = mean_sibling_evidence(src, ["task_id"], "gen_index", "keys")
    rs = mean_sibling_jaccard(src, ["task_id"], "gen_index", "toks")
    out = same.join(ev, ["task_id", "gen_index"]).join(rs, ["task_id", "gen_index"])
    # A group of one has nothing to disagree with.
    sizes = src.groupBy("task_id").agg(F.count(F.lit(1)).alias("members"))
    out = null_safe_join(out, sizes, ["task_id"])
    total = F.when(F.col("members") == 1, F.lit(1.0)).otherwise(
        answer * F.col("same_share") + evidence * F.col("evidence") + reasoning * F.col("mean_jaccard"))
    return out.select("task_id", "gen_index", F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)).alias("consistency"))
