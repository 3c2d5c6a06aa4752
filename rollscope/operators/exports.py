"""Training exports: replay rows, nested records, caps and mixing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollscope.operators import ranking

# Fixed value: smallest learnability of a proposal worth replaying.
LEARNABILITY_THRESHOLD = 0.5


def sft_replay_rows(scored: DataFrame) -> DataFrame:
    """Positive buffer as replay rows; the completion is the target."""
    return scored.filter(F.col("buffer") == "positive").withColumn("solution", F.col("completion")).withColumn(
        "source_buffer", F.lit("positive"))


def proposer_sft_rows(scored: DataFrame, threshold: float = LEARNABILITY_THRESHOLD) -> DataFrame:
    """Reached proposals that hit the learnable band and carry prompt and completion."""
    return scored.filter(
        F.col("reached") & (F.coalesce(F.col("basis"), F.lit("")) != "unverifiable")
        & (F.round("learnability", 9) >= threshold) & (F.coalesce(F.col("completion"), F.lit("")) != "")
        & (F.coalesce(F.col("prompt"), F.lit("")) != "")).withColumn("source_buffer", F.lit("proposer"))


def oracle_eligible(tasks: DataFrame) -> DataFrame:
    """Tasks whose facts, boxes, spy, image count and exact answer all agree."""
    answer = F.concat(F.lit(r"^\s*<answer>\s*spy\s*=\s*"), F.col("spy_player").cast("string"),
                      F.lit(r"\s*;\s*changed_attributes\s*=\s*"), F.size("facts").cast("string"), F.lit(r"\s*</answer>\s*\z"))
    return tasks.filter(
        (F.size("facts") > 0) & (F.size("boxes") > 0) & F.col("num_images").between(2, 8)
        & F.col("spy_player").between(1, F.col("num_images")) & F.regexp(F.col("solution"), answer))


def oracle_replay_rows(tasks: DataFrame, limit: int, seed: int = 1701) -> DataFrame:
    """Certificate text built from gold, for a seeded selection of eligible tasks."""
    spy = F.col("spy_player").cast("string")
    number = lambda v: F.when(v == F.floor(v), F.floor(v).cast("string")).otherwise(v.cast("string"))
    boxes = F.transform("boxes", lambda b: F.concat(
        F.lit('<bbox player="'), spy, F.lit('">['), F.array_join(F.transform(b, number), ","), F.lit("]</bbox>")))
    facts = F.transform("facts", lambda f: F.concat(
        F.lit("<change>"), f["attribute"], F.lit(":"), f["before"], F.lit("->"), f["after"], F.lit("</change>")))
    think = "<think>I compared the spy image with the other images and checked each changed attribute.</think>"
    text = F.array_join(F.concat(F.array(F.lit(think)), boxes, facts, F.array(F.trim("solution"))), "\n")
    picked = ranking.seeded_limit(oracle_eligible(tasks), seed, ["task_id"], limit)
    return picked.select("task_id", text.alias("completion"), F.lit("verified_oracle").alias("source_buffer"))


def grounding_context(boxes: Column, width: Column, height: Column, players: Column, spy: Column) -> Column:
    """Typed box context: any bad box empties the set; bad players empty it too."""
    sane = (width > 0) & (height > 0)
    inside = F.forall(boxes, lambda b: (F.size(b) == 4) & F.forall(b, lambda v: v.isNotNull() & ~F.isnan(v))
                      & (b[0] >= 0) & (b[0] < b[2]) & (b[2] <= width) & (b[1] >= 0) & (b[1] < b[3]) & (b[3] <= height))
    crowd = players.between(2, 8) & (spy.isNull() | spy.between(1, players))
    ok = F.coalesce(sane & inside & crowd, F.lit(False))
    empty = F.array().cast("array<array<double>>")
    valid = F.when(F.coalesce(crowd, F.lit(False)), F.when(spy.isNotNull(), F.array(spy.cast("bigint"))).otherwise(
        F.sequence(F.lit(1).cast("bigint"), players.cast("bigint")))).otherwise(F.array().cast("array<bigint>"))
    return F.struct(
        F.when(F.coalesce(sane, F.lit(False)), width).otherwise(F.lit(320)).alias("image_width"),
        F.when(F.coalesce(sane, F.lit(False)), height).otherwise(F.lit(240)).alias("image_height"),
        F.when(ok, boxes).otherwise(empty).alias("gold_boxes"), valid.alias("valid_players"))


def reference_subset(raw: Column) -> Column:
    """Type-stable part of a free-form judge block given as JSON text."""
    get = lambda p: F.get_json_object(raw, f"$.{p}")
    steps = F.from_json(get("reference_reasoning_steps"), "array<string>")
    return F.struct(
        F.coalesce(get("reference_source"), F.lit("")).alias("reference_source"),
        F.coalesce(get("difficulty_level"), F.lit("")).alias("difficulty_level"),
        get("reasoning_budget_steps").try_cast("bigint").alias("budget_steps"),
        get("reasoning_budget_tokens").try_cast("bigint").alias("budget_tokens"),
        F.coalesce(steps, F.array().cast("array<string>")).alias("steps"))


def verdict_normalize(raw: Column) -> Column:
    """Raw judge JSON to the full verdict with defaults and a derived suggestion."""
    get = lambda p: F.get_json_object(raw, f"$.{p}")
    accepted = F.coalesce(get("accepted").try_cast("boolean"), get("is_solvable").try_cast("boolean"), F.lit(True))
    reason = F.coalesce(F.nullif(get("reject_reason"), F.lit("")), F.when(accepted, F.lit("")).otherwise(F.lit("rejected")))
    level = F.coalesce(get("difficulty_level"), F.lit("medium"))
    low = F.lower(reason)
    too_hard = ~accepted & F.contains(low, F.lit("too")) & (F.contains(low, F.lit("hard")) | F.contains(low, F.lit("difficult")))
    derived = F.when(too_hard, F.when(level == "easy", F.lit("easy")).otherwise(F.lit("medium"))).otherwise(level)
    flagged = F.coalesce(get("ambiguity_flag").try_cast("boolean"), F.lit(False))
    num = lambda p, d: F.coalesce(get(p).try_cast("double"), d)
    return F.struct(
        accepted.alias("accepted"), reason.alias("reject_reason"), level.alias("difficulty_level"),
        num("solvability_score", F.when(accepted, F.lit(1.0)).otherwise(F.lit(0.4))).alias("solvability_score"),
        num("ambiguity_score", F.when(flagged, F.lit(0.7)).otherwise(F.lit(0.2))).alias("ambiguity_score"),
        num("visual_grounding_score", num("visual_verifiability", F.lit(0.7))).alias("visual_grounding_score"),
        F.coalesce(get("reasoning_budget_steps").try_cast("bigint"), F.lit(4)).alias("budget_steps"),
        F.coalesce(get("reasoning_budget_tokens").try_cast("bigint"), F.lit(160)).alias("budget_tokens"),
        F.coalesce(get("generator_feedback.suggested_difficulty"), get("suggested_difficulty"), derived).alias("suggested"),
        F.coalesce(get("generator_feedback.reason"), F.when(too_hard, F.lit("reduce_difficulty")).otherwise(F.lit("")))
        .alias("reason"))


# The two task kinds of a training record.
SPY_KIND, COUNT_KIND = "clevr_spy", "verified_count_qa"


def grpo_rows(tasks: DataFrame) -> DataFrame:
    """Nested training record per task: conversation plus typed context.

    Grounding columns (boxes, width, height, players, spy) that a table lacks count as null.
    """
    given = lambda c, t: F.col(c).cast(t) if c in tasks.columns else F.lit(None).cast(t)
    ground = grounding_context(given("boxes", "array<array<double>>"), given("width", "int"), given("height", "int"),
                               given("players", "bigint"), given("spy", "bigint"))
    human = F.when(F.col("image").isNotNull(), F.concat(F.lit("<image>\n"), "problem")).otherwise(F.col("problem"))
    talk = F.array(F.struct(F.lit("human").alias("from"), human.alias("value")),
                   F.struct(F.lit("gpt").alias("from"), F.col("solution").alias("value")))
    kind = F.when(F.col("kind") == COUNT_KIND, F.lit(COUNT_KIND)).otherwise(F.lit(SPY_KIND))
    qa = F.struct(F.when(kind == COUNT_KIND, F.col("gold_count")).alias("gold_count"),
                  F.when(kind == COUNT_KIND, F.col("pair_id")).otherwise(F.lit("")).alias("pair_id"))
    return tasks.select(
        "task_id", talk.alias("conversations"), F.lit("default").alias("accu_reward_method"),
        F.struct(kind.alias("task_kind"), qa.alias("verified_qa"), ground.alias("grounding")).alias("context"), "image")


def aux_cap(solver: DataFrame, oracle: DataFrame, scene: DataFrame, ratio: float) -> DataFrame:
    """Row caps of two auxiliary pools: half the allowance each, spare to the other; uncapped without positives."""
    count = lambda df, n: df.agg(F.count(F.lit(1)).alias(n))
    sizes = count(solver, "positives").select(
        "positives", count(oracle, "o").scalar().alias("n_oracle"), count(scene, "s").scalar().alias("n_scene"))
    total = F.col("n_oracle") + F.col("n_scene")
    cap = F.least(total, F.floor(F.col("positives") * ratio))
    out = sizes.withColumn("cap", F.when(F.col("positives") > 0, cap).otherwise(total))
    first = F.least(F.col("n_oracle"), F.floor((F.col("cap") + 1) / 2))
    second = F.least(F.col("n_scene"), F.floor(F.col("cap") / 2))
    out = out.withColumn("__o", first).withColumn("__s", second)
    o = F.col("__o") + F.least(F.col("cap") - F.col("__o") - F.col("__s"), F.col("n_oracle") - F.col("__o"))
    out = out.withColumn("oracle_cap", o)
    s = F.col("__s") + F.least(F.col("cap") - F.col("oracle_cap") - F.col("__s"), F.col("n_scene") - F.col("__s"))
    return out.select("positives", "n_oracle", "n_scene", "cap", "oracle_cap", s.alias("scene_cap"))


def mix_replace(rows: DataFrame, twins: DataFrame, key: str, paired: Column, fraction: float, seed: int) -> DataFrame:
    """Replace an even number of unpaired rows by question twins, keeping the total.

    The count is min(floor(n * fraction), eligible, twins) rounded down to even; which rows leave is
    decided by hash rank, found with the k-th smallest hash instead of a global sort of the pool.
    """
    if not 0.0 <= fraction <= 0.5:
        raise ValueError("fraction must be in [0, 0.5]")
    from rollscope.operators.skew import number_rows

    pool = rows.filter(~paired).select(key)
    ranked = number_rows(pool.withColumn("__h", ranking.hash_order(seed, key)), [F.col("__h"), F.col(key)], "__rn").drop("__h")
    offered = number_rows(twins.withColumn("__h", ranking.hash_order(seed, "pair_id")), [F.col("__h"), F.col("pair_role")],
                          "__rn").drop("__h")
    n = rows.agg(F.count(F.lit(1))).scalar()
    eligible, have = pool.agg(F.count(F.lit(1))).scalar(), twins.agg(F.count(F.lit(1))).scalar()
    cap = F.floor(F.least(F.floor(n * fraction), eligible, have) / 2) * 2
    gone = ranked.filter(F.col("__rn") <= cap).select(key)
    kept = rows.join(gone, key, "left_anti")
    return kept.unionByName(offered.filter(F.col("__rn") <= cap).drop("__rn"), allowMissingColumns=True)


def union_replays(parts: dict[str, DataFrame]) -> DataFrame:
    """Replay tables of several sources as one, tagged by source."""
    out = None
    for name, df in parts.items():
        tagged = df.withColumn("source_buffer", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    if out is None:
        raise ValueError("no replay tables given")
    return out


def task_metadata_flatten(tasks: DataFrame, meta: str, width: int = 320, height: int = 240) -> DataFrame:
    """Budget and image size from nested alternatives: the task's own value, then the judge's, then defaults."""
    m = F.col(meta)
    return tasks.select(
        *[c for c in tasks.columns if c != meta],
        F.coalesce(m["task"]["budget_steps"], m["judge"]["budget_steps"]).alias("budget_steps"),
        F.coalesce(m["task"]["budget_source"], m["judge"]["budget_source"], F.lit("fallback_default")).alias("budget_source"),
        F.coalesce(m["variant"]["image_width"], F.lit(width)).alias("image_width"),
        F.coalesce(m["variant"]["image_height"], F.lit(height)).alias("image_height"))


# Change count from which a task counts as visually saturated.
SATURATED = 6


def heuristic_verdict(tasks: DataFrame) -> DataFrame:
    """Rule-only verdict from the difficulty gap and the number of changes."""
    from rollscope.operators.gates import TOO_HARD_REASON, difficulty_rank, easier_level

    n = F.col("num_attr_changes")
    too_hard = difficulty_rank(F.col("difficulty_estimate")) - difficulty_rank(F.col("difficulty_target")) >= 2
    reason = F.when(too_hard, F.lit(TOO_HARD_REASON)).when(n >= SATURATED, F.lit("high_visual_ambiguity")).otherwise(F.lit(""))
    ok = reason == ""
    half = F.floor(n / 2)
    return tasks.select(
        "*", ok.alias("accepted"), reason.alias("reject_reason"), F.when(ok, F.lit(0.9)).otherwise(F.lit(0.4)).alias("solvability_score"),
        F.when(n >= 3, F.lit(0.85)).otherwise(F.lit(0.6)).alias("visual_grounding_score"),
        F.when(n >= SATURATED, F.lit(0.7)).otherwise(F.lit(0.2)).alias("ambiguity_score"),
        (3 + half).alias("budget_steps"), (120 + 20 * half).alias("budget_tokens"),
        F.when(too_hard, easier_level(F.col("difficulty_target"))).otherwise(F.col("difficulty_target")).alias("suggested"))


def passthrough_verdict(tasks: DataFrame) -> DataFrame:
    """Stable columns for tasks beyond the judging budget; marked as not judged, no feedback."""
    half = F.floor(F.col("num_attr_changes") / 2)
    return tasks.select(
        "*", F.lit(True).alias("accepted"), F.lit(False).alias("judged"), F.lit(1.0).alias("solvability_score"),
        F.lit(0.7).alias("visual_grounding_score"), F.lit(0.2).alias("ambiguity_score"), (3 + half).alias("budget_steps"),
        (120 + 20 * half).alias("budget_tokens"), F.lit(None).cast("string").alias("suggested"))
