"""Certificates, judge selection, verdict merging and reference-step coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollscope.functions import facts as FX
from rollscope.functions import text as T
from rollscope.operators.pairs import TILE
from rollscope.operators.skew import null_safe_join


def answer_certificate(scored: DataFrame, *, min_grounding: float = 0.2, min_facts: float = 1.0,
                       need_player: bool = True) -> Column:
    """A rollout proves mastery: right fields, valid format, no shortcut, grounded by its own boxes, full facts."""
    ok = ((F.col("spy") == F.col("spy_gold")) & (F.col("changed") == F.col("changed_gold")) & F.col("format_valid")
          & ~F.col("shortcut_detected") & (F.size("valid") > 0) & (F.col("grounding") >= min_grounding))
    if need_player:
        ok = ok & F.col("players_ok")
    if "visual_facts_score" in scored.columns:
        ok = ok & (F.col("visual_facts_score") >= min_facts) & (F.col("claims.invalid") == 0)
    return F.coalesce(ok, F.lit(False))


def _with_claims_met(rows: DataFrame, accepted: DataFrame, gold: DataFrame, claims: str, name: str, where: Column) -> DataFrame:
    """Rows plus a boolean: `where` holds, gold and answer equal the accepted task's and the claims are exactly its gold facts.

    Claims are parsed only where `where` holds.
    """
    triple = F.concat_ws(":", "attribute", "before", "after")
    # A task has at most one row per triple of the attribute domains.
    packed = gold.groupBy("task_id").agg(F.array_sort(F.flatten(F.collect_list(
        F.array_repeat(triple, F.col("n").cast("int"))))).alias("__gold"))
    known = accepted.select("task_id", F.col("spy").alias("__spy"), F.col("changed").alias("__changed"))
    out = rows.withColumn("__claims", F.when(where, FX.change_claims(F.col(claims)))).join(known, "task_id", "left").join(packed, "task_id", "left")
    said = F.array_sort(F.transform("__claims.facts", lambda f: F.concat_ws(":", f["attribute"], f["before"], f["after"])))
    same = lambda field: (F.col(f"__{field}") == F.col(f"{field}_gold")) & (F.col(f"__{field}") == F.col(field))
    whole = (same("spy") & same("changed") & (F.size("__gold") > 0) & (said == F.col("__gold"))
             & (F.col("__claims.invalid") == 0))
    return out.withColumn(name, F.coalesce(whole, F.lit(False))).drop("__claims", "__spy", "__changed", "__gold")


def may_certify(parsed: DataFrame, accepted: DataFrame, gold: DataFrame, *, claims: str = "completion") -> DataFrame:
    """Parsed rows with `open`: whether `visual_certificate` may hold, by fields, format and claims alone.

    Boxes and reasoning need not be parsed for it; a row that is not open is not certified, whatever these say.
    """
    fields = (F.col("spy") == F.col("spy_gold")) & (F.col("changed") == F.col("changed_gold")) & F.col("format_valid")
    return _with_claims_met(parsed, accepted, gold, claims, "open", fields)


def visual_certificate(scored: DataFrame, accepted: DataFrame, gold: DataFrame, *, claims: str = "completion",
                       min_grounding: float = 0.2, need_player: bool = True) -> DataFrame:
    """Scored rows with `certified`: the answer certificate against the accepted task and its gold facts.

    The rollout's own gold and its answer must equal the accepted task's (task_id, spy, changed), and the change claims
    of the text in `claims` must be exactly its gold facts (task_id, attribute, before, after, n): no false claim, none
    missing, none malformed. A task without an accepted row or without gold facts certifies nothing.
    """
    base = answer_certificate(scored, min_grounding=min_grounding, need_player=need_player)
    return _with_claims_met(scored, accepted, gold, claims, "certified", base)


def judge_reason(completion: Column, solution: Column) -> Column:
    """Why a rollout would, or would not, need the paid judge."""
    gold, said = T.answer_norm(solution), T.answer_norm(completion)
    return (F.when(gold == "", F.lit("no_gold_answer")).when(said == gold, F.lit("exact_match_succeeded"))
            .when((said == "") | ~F.contains(F.coalesce(completion, F.lit("")), F.lit("<answer>")), F.lit("final_answer_parse_failed"))
            .when(F.contains(T.squeeze(completion), gold), F.lit("gold_token_present_but_not_exact"))
            .otherwise(F.lit("exact_mismatch_possible_synonym")))


def needs_judge(reason: Column) -> Column:
    return ~reason.isin("no_gold_answer", "exact_match_succeeded")


def verdict_merge(vectors: DataFrame, verdicts: DataFrame, key: str) -> DataFrame:
    """A confident correct verdict lifts an answer below 1 to 1; the verdict key must be unique."""
    one = verdicts.groupBy(key).agg(F.bool_or("judge_correct").alias("__ok"))
    lifted = F.when(F.coalesce(F.col("__ok"), F.lit(False)) & (F.col("answer") < 1.0), F.lit(1.0)).otherwise(F.col("answer"))
    return vectors.join(one, key, "left").withColumn("answer", lifted).drop("__ok")


def step_coverage(reference: DataFrame, model: DataFrame, key: str, text: str) -> DataFrame:
    """Per key: `coverage`, the mean over reference steps of the similarity to the most similar model step (0 for keys
    without model steps), and `edits`, how many edit distances that took.

    Equal steps of either side are compared once and parsed once. Model steps are packed in tiles; each reference step
    meets the tiles of its key, the most promising members first. Token counts and lengths bound the similarity, and an
    edit distance is computed only where the bound is above the best so far. A null step is an empty one.
    """
    squeezed = T.squeeze(F.col(text)).alias("__s")
    with_words = lambda d: d.withColumn("__w", T.tokens(F.col("__s")))
    distinct = with_words(model.select(key, squeezed).distinct())
    asked = with_words(reference.select(key, squeezed).groupBy(key, "__s").agg(F.count(F.lit(1)).alias("__n")))
    sized = distinct.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    tiles = F.ceil(F.col("n") / F.lit(TILE)).cast("int")
    spread = null_safe_join(distinct, sized, [key]).withColumn("__tile", F.pmod(F.xxhash64("__s"), tiles).cast("int"))
    packed = spread.groupBy(key, "__tile").agg(F.collect_list(F.struct("__s", "__w")).alias("__m"))
    probes = null_safe_join(asked, sized, [key], "left").select(
        key, "__s", "__w", "__n", F.explode_outer(F.sequence(F.lit(0), tiles - 1)).alias("__tile"))

    def length_bound(m: Column) -> Column:
        a, b = F.length(m["__s"]), F.length(F.col("__s"))
        return F.when(F.greatest(a, b) == 0, F.lit(1.0)).otherwise(1.0 - F.abs(a - b) / F.greatest(a, b))

    def count_bound(m: Column) -> Column:
        a, b = F.size(m["__w"]), F.size(F.col("__w"))
        return F.when((a == 0) | (b == 0), F.lit(0.0)).otherwise(F.least(a, b) / F.greatest(a, b))

    def improve(acc: Column, m: Column) -> Column:
        def closer(top: Column) -> Column:
            exact = 0.5 * T.jaccard(m["__w"], F.col("__w")) + 0.5 * T.edit_ratio(m["__s"], F.col("__s"))
            return F.when(top <= acc["b"], acc).otherwise(
                F.struct(F.greatest(acc["b"], exact).alias("b"), (acc["e"] + 1).alias("e")))
        return F.when(-m["neg"] <= acc["b"], acc).otherwise(
            T.let(0.5 * T.jaccard(m["__w"], F.col("__w")) + 0.5 * m["len"], closer))

    bounded = F.transform("__m", lambda m: F.struct(
        (-(0.5 * count_bound(m) + 0.5 * length_bound(m))).alias("neg"), length_bound(m).alias("len"),
        m["__s"].alias("__s"), m["__w"].alias("__w")))
    nothing = F.struct(F.lit(0.0).alias("b"), F.lit(0).cast("long").alias("e"))
    best = F.when(F.col("__m").isNull(), nothing).otherwise(
        F.aggregate(F.array_sort(bounded), nothing, improve))
    met = null_safe_join(probes, packed, [key, "__tile"], "left").select(key, "__s", "__n", best.alias("best"))
    steps = met.groupBy(key, "__s", "__n").agg(F.max("best.b").alias("b"), F.sum("best.e").alias("e"))
    return steps.groupBy(key).agg((F.sum(F.col("b") * F.col("__n")) / F.sum("__n")).alias("coverage"),
                                  F.sum("e").alias("edits"))
