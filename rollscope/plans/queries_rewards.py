"""Queries over reward dimensions, the scalar and whole scored runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollscope.functions import rewards as R
from rollscope.functions import text as T
from rollscope.operators import exports, ranking, stats
from rollscope.operators.registry import RewardRegistry, group_udf, sample_udf
from rollscope.plans import scoring
from rollscope.plans.catalog import register
from rollscope.plans.queries_boxes import GREEDY_SQL
from rollscope.plans.queries_stats import DIMS, ROUTE_SQL, r9, routed
from rollscope.plans.queries_text import CNT, FORMAT_SQL, SPY, SQ, THINK_SQL, field_sql
from rollscope.session import cut_lineage
from rollscope.sources.views import view, with_sql

CFG = R.RewardConfig()


def has(text: str, words) -> str:
    return "(" + " or ".join(f"contains({text}, '{w}')" for w in words) + ")"


def hits(text: str, words) -> str:
    return "(" + " + ".join(f"contains({text}, '{w}')::int" for w in words) + ")"


OUT_RE = R.OUTLIER_PATTERN.replace("'", "''")
THOUGHT_SQL = f"""
th as (select gen_index, task_id, completion, {SQ.format(THINK_SQL.format('completion'))} as r from v_texts),
base as (select *, case when r = '' then 0 else len(string_split(r, ' ')) end as words from th),
struct0 as (select *, {hits('r', R.VISUAL_TERMS)} as vh, {hits('r', R.SPY_VISUAL_TERMS)} as svh, {has('r', R.COMPARE_TERMS)} as cmp, {has('r', R.SPY_COMPARE_TERMS)} as scmp,
 regexp_matches(r, '{OUT_RE}') as outl, {has('r', R.DERIVE_TERMS)} as der, {has('r', ('player', 'image'))} as named, contains(r, 'spy') as spyw,
 {has('r', R.SELECT_TERMS)} or regexp_matches(r, '{R.SPY_CHOICE_PATTERN}') as chosen,
 len(list_distinct(regexp_extract_all(r, '{R.NUMBERED_PATTERN}', 1))) as nums, len(list_distinct(regexp_extract_all(r, '{R.ORDINAL_PATTERN}'))) as ords,
 (case when words < 8 then 1 else 0 end + (not {has('r', R.SHORTCUT_VISUAL)})::int + (not {has('r', R.SHORTCUT_COMPARE)})::int
  + ({has('r', R.GUESS_TERMS)} and not regexp_matches(r, '{R.REASON_PATTERN}'))::int) as bad from base),
struct as (select *, case when r = '' then 0 else ((vh >= 2)::int + cmp::int + outl::int + der::int) / 4 end as causal,
 case when r = '' then 0 else least(1.0, case when nums >= 2 or (named and ords >= 2) then 0.2 when named then 0.1 else 0 end + case when scmp then 0.2 else 0 end + case when outl then 0.2 else 0 end
 + case when svh >= 2 then 0.2 when svh = 1 then 0.1 else 0 end + case when spyw and chosen then 0.2 when spyw then 0.1 else 0 end) end as structure, r = '' or bad >= 2 as shortcut from struct0)
"""


def thoughts(spark, sf):
    return view(spark, sf, "v_texts").select(
        "gen_index", "task_id", "completion", T.squeeze(T.reasoning(F.col("completion"))).alias("r"))


@register("causal_structure", with_sql("v_texts", "with " + THOUGHT_SQL + "select gen_index, round(causal, 9) as causal from struct"))
def causal_structure(spark, sf):
    return thoughts(spark, sf).select("gen_index", F.round(R.causal_structure(F.col("r")), 9).alias("causal"))


@register("shortcut", with_sql("v_texts", "with " + THOUGHT_SQL + "select gen_index, shortcut from struct"))
def shortcut(spark, sf):
    return thoughts(spark, sf).select("gen_index", R.shortcut(F.col("r")).alias("shortcut"))


@register("spy_structure", with_sql("v_texts", "with " + THOUGHT_SQL + "select gen_index, round(structure, 9) as structure from struct"))
def spy_structure(spark, sf):
    return thoughts(spark, sf).select("gen_index", F.round(R.spy_structure(F.col("r")), 9).alias("structure"))


@register("process_score", with_sql("v_texts", "with " + THOUGHT_SQL + """
select gen_index, round(case when r = '' then 0 else least(1.0, case when shortcut then least(raw, 0.4) else raw end) end, 9) as process
from (select *, case gen_index % 3 when 0 then 0.5 * 0.8 + 0.3 * causal + 0.2 * structure when 1 then greatest(0.3, structure) else structure end as raw from struct)"""))
def process_score(spark, sf):
    t = thoughts(spark, sf).withColumns({
        "cov": F.when(F.col("gen_index") % 3 == 0, F.lit(0.8)), "jac": F.when(F.col("gen_index") % 3 == 1, F.lit(0.3))})
    r = F.col("r")
    return t.select("gen_index", F.round(R.process_score(r, R.causal_structure(r), R.spy_structure(r), R.shortcut(r),
                                                         F.col("cov"), F.col("jac")), 9).alias("process"))


@register("budget_score", with_sql("v_texts", """
with b as (select gen_index, gen_index % 9 as steps, gen_index % 300 as words, case when gen_index % 3 = 0 then 4 end as bs, case when gen_index % 3 = 1 then 120 end as bt from v_texts),
t as (select *, coalesce(bt, 100) as tok from b)
select gen_index, round(case when bs is not null then case when steps <= bs then 1 when steps <= bs + 2 then 0.75 when steps <= bs + 4 then 0.6 else 0 end
 when words = 0 then 0 when words <= tok then 1 else greatest(0.0, (greatest(-1.0, 1 - 2.0 * (words - tok) / tok) + 1) / 2) end, 9) as budget from t"""))
def budget_score(spark, sf):
    b = view(spark, sf, "v_texts").selectExpr(
        "gen_index", "gen_index % 9 as steps", "gen_index % 300 as words", "if(gen_index % 3 = 0, 4, null) as bs",
        "if(gen_index % 3 = 1, 120, null) as bt")
    return b.select("gen_index", F.round(R.budget_score(F.col("steps"), F.col("words"), F.col("bs"), F.col("bt"), 100), 9)
                    .alias("budget"))


ANSWER_SQL = f"""
ans as (select gen_index, {field_sql('completion', SPY)} as spy, {field_sql('completion', CNT)} as changed, {field_sql('solution', SPY)} as spy_gold, {field_sql('solution', CNT)} as changed_gold from v_texts),
score as (select *, 0.7 * coalesce((spy = spy_gold)::int, 0) + 0.3 * case when changed = changed_gold then 1 when abs(changed - changed_gold) = 1 then 0.25 else 0 end as answer from ans)
"""


@register("answer_score", with_sql("v_texts", "with " + ANSWER_SQL + """
select gen_index, round(answer, 9) as fields, coalesce((spy = spy_gold and changed = changed_gold)::int, 0)::double as all_exact from score"""))
def answer_score(spark, sf):
    t = view(spark, sf, "v_texts").select(
        "gen_index", *[fn(F.col(c)).alias(n) for c, n, fn in (
            ("completion", "spy", T.spy_field), ("completion", "changed", T.count_field),
            ("solution", "spy_gold", T.spy_field), ("solution", "changed_gold", T.count_field))])
    cols = [F.col(c) for c in ("spy", "changed", "spy_gold", "changed_gold")]
    strict = R.RewardConfig(answer_mode="structured_exact_match")
    return t.select("gen_index", F.round(R.answer_score(*cols, F.lit(0.0), CFG), 9).alias("fields"),
                    R.answer_score(*cols, F.lit(0.0), strict).alias("all_exact"))


def context(spark, sf):
    """Task context of the completions: two gold boxes, the gold spy and the image size."""
    g = view(spark, sf, "v_gold_boxes").select(
        "task_id", F.array(*[F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2")]).alias("g"))
    second = F.array(F.col("g")[0] + 20, F.col("g")[1] + 10, F.col("g")[2] + 20, F.col("g")[3] + 10)
    return g.select("task_id", F.array(F.col("g"), second).alias("gold_boxes"),
                    F.array((F.col("task_id") % 5 + 1)).alias("valid_players"),
                    F.lit(320).alias("image_width"), F.lit(240).alias("image_height"))


def scored(spark, sf, cfg=CFG):
    rollouts = view(spark, sf, "v_texts").select("gen_index", "task_id", "kind", "completion", "solution")
    return scoring.score_rollouts(rollouts, context(spark, sf), cfg)


# Whole vector in SQL: parsed answers, reasoning structure, greedy box overlap, self-consistency.
VECTOR_SQL = GREEDY_SQL + ", " + THOUGHT_SQL.strip() + ", " + ANSWER_SQL.strip() + f"""
, found as (select gen_index, count(*) nf from boxes group by 1),
vb as (select gen_index, count(*) nv, bool_and(player is not null and player between 1 and 8) as named, min(player) pmin, max(player) pmax, min(case when player between 1 and 8 then 1 else 0 end) as pok from boxes where error is null group by 1),
dup as (select distinct a.gen_index from pred a join pred b on a.gen_index = b.gen_index and a.p < b.p where
 greatest(0.0, least(a.px2, b.px2) - greatest(a.px1, b.px1)) * greatest(0.0, least(a.py2, b.py2) - greatest(a.py1, b.py1)) >= 0.9 * ((a.px2 - a.px1) * (a.py2 - a.py1) + (b.px2 - b.px1) * (b.py2 - b.py1)
 - greatest(0.0, least(a.px2, b.px2) - greatest(a.px1, b.px1)) * greatest(0.0, least(a.py2, b.py2) - greatest(a.py1, b.py1)))),
f1 as (select gen_index, n, case when n > 0 and total > 0 then 2 * (total / 2) * (total / n) / (total / 2 + total / n) else 0 end as f from tot),
vec as (select s.gen_index, s.task_id, sc.spy, sc.changed, sc.spy_gold, sc.changed_gold, sc.answer, s.r, s.words, coalesce(found.nf, 0) nf, coalesce(vb.nv, 0) nv, {FORMAT_SQL.format('s.completion')} as format_valid,
 s.r <> '' and s.shortcut as shortcut_detected,
 case when s.words = 0 then 0.0 when s.words <= 400 then 1.0 else 0.0 end as budget,
 case when s.r = '' then 0 else least(1.0, case when s.shortcut then least(s.structure, 0.4) else s.structure end) end as process,
 case when coalesce(vb.nv, 0) = 0 then 0 else least(1.0, case when vb.pok = 1 and vb.pmin = s.task_id % 5 + 1 and vb.pmax = s.task_id % 5 + 1 then 0.1 else 0 end
  + 0.9 * f1.f * case when found.nf > vb.nv then (2 + vb.nv) / (2 + found.nf) else 1 end) end as grounding,
 case when coalesce(vb.nv, 0) > 0 and ((sc.spy is not null and not (vb.pok = 1 and vb.pmin = sc.spy and vb.pmax = sc.spy)) or (sc.changed is not null and vb.nv > sc.changed)) then 0 else
  (case when coalesce(vb.nv, 0) > 0 then 1 else 0 end + case when coalesce(vb.nv, 0) > 0 and dup.gen_index is null then 1 else 0 end
   + case when sc.spy is not null and s.r <> '' and list_contains(list_transform(regexp_extract_all(s.r, '{R.NUMBERED_PATTERN}', 1), lambda x: cast(x as bigint)), sc.spy) then 1 else 0 end)
  / (1 + case when coalesce(vb.nv, 0) > 0 then 1 else 0 end + case when sc.spy is not null and s.r <> '' then 1 else 0 end) end as consistency
 from struct s join score sc on s.gen_index = sc.gen_index left join found on found.gen_index = s.gen_index left join vb on vb.gen_index = s.gen_index
 left join dup on dup.gen_index = s.gen_index join f1 on f1.gen_index = s.gen_index),
scal as (select *, case when coalesce(spy = spy_gold, false) then 1.0 else 0.0 end as gate from vec),
total as (select *, 0.6 * answer + 0.03 * budget + gate * (0.05 * process + 0.25 * grounding + 0.07 * consistency) as reward_scalar from scal)
"""


@register("grounding_score", with_sql(("v_texts", "v_gold_boxes"), VECTOR_SQL + "select gen_index, nf as num_found, nv as num_valid, round(grounding, 8) as grounding from vec"))
def grounding_score(spark, sf):
    return scored(spark, sf).select("gen_index", F.col("num_found").cast("bigint").alias("num_found"),
                                    F.size("valid").cast("bigint").alias("num_valid"), r9("grounding", 8))


@register("field_consistency", with_sql(("v_texts", "v_gold_boxes"), VECTOR_SQL + "select gen_index, round(consistency, 8) as consistency from vec"))
def field_consistency(spark, sf):
    return scored(spark, sf).select("gen_index", r9("consistency", 8))


@register("reward_vector", with_sql(("v_texts", "v_gold_boxes"), VECTOR_SQL + """
select gen_index, round(answer, 8) answer, round(budget, 8) budget, round(process, 8) process, round(grounding, 8) grounding, round(consistency, 8) consistency, format_valid, shortcut_detected from vec"""))
def reward_vector(spark, sf):
    return scored(spark, sf).select("gen_index", *[r9(d, 8) for d in ("answer", "budget", "process", "grounding", "consistency")],
                                    "format_valid", "shortcut_detected")


@register("scalarize", with_sql(("v_texts", "v_gold_boxes"), VECTOR_SQL + "select gen_index, round(reward_scalar, 7) as reward_scalar from total"))
def scalarize(spark, sf):
    return scored(spark, sf).select("gen_index", r9("reward_scalar", 7))


@register("rescore_report", with_sql(("v_texts", "v_gold_boxes"), VECTOR_SQL + """
, route as (select *, case when round(answer, 9) < 1 then 'failure' when not format_valid or grounding < 0.2 or process < 0.4 or shortcut_detected or grounding < 0.5 then 'failure' else 'positive' end as buffer from total)
select count(*) num_rollouts, round(avg(reward_scalar), 7) mean_scalar, count(*) filter (where buffer = 'positive') positives, count(*) filter (where buffer = 'failure') failures,
 count(*) filter (where round(answer, 9) >= 1 and (shortcut_detected or grounding < 0.5)) shortcut_correct from route"""))
def rescore_report(spark, sf):
    df = scored(spark, sf)
    short = (F.col("answer") >= 1.0) & (F.col("shortcut_detected") | F.array_contains("failure_tags", "shortcut_or_ungrounded_success"))
    return df.agg(F.count(F.lit(1)).alias("num_rollouts"), F.round(F.avg("reward_scalar"), 7).alias("mean_scalar"),
                  F.count_if(F.col("buffer") == "positive").alias("positives"), F.count_if(F.col("buffer") == "failure").alias("failures"),
                  F.count_if(short).alias("shortcut_correct"))


@register("score_and_route", with_sql(("v_texts", "v_gold_boxes"), VECTOR_SQL + """
, route as (select *, case when round(answer, 9) < 1 then 'failure' when not format_valid or grounding < 0.2 or process < 0.4 or shortcut_detected or grounding < 0.5 then 'failure' else 'positive' end as buffer from total),
per as (select task_id, count(*) filter (where buffer = 'positive') p, count(*) filter (where buffer = 'failure') f from route group by 1)
select task_id, f as failures, least(p, 1) as positives, greatest(p - 1, 0) as unused from per"""))
def score_and_route(spark, sf):
    rollouts = view(spark, sf, "v_texts").select("gen_index", "task_id", "completion", "solution")
    df = scoring.score_and_route(rollouts, context(spark, sf), CFG)
    return df.groupBy("task_id").agg(*[F.count_if(F.col("buffer") == b).alias(n) for b, n in (
        ("failure", "failures"), ("positive", "positives"), ("unused", "unused"))])


@register("blind_reward_audit", with_sql(("v_texts", "v_gold_boxes"), VECTOR_SQL + """
select gen_index % 10 as policy, count(*) filter (where answer = 0) as wrong_rows, round(max(case when answer = 0 then reward_scalar end), 7) as worst, coalesce(max(case when answer = 0 then reward_scalar end) > 0.02, false) as above from total group by 1"""))
def blind_reward_audit(spark, sf):
    df = scored(spark, sf)
    wrong = F.col("answer") == 0.0
    worst = F.max(F.when(wrong, F.col("reward_scalar")))
    return df.groupBy((F.col("gen_index") % 10).alias("policy")).agg(
        F.count_if(wrong).alias("wrong_rows"), F.round(worst, 7).alias("worst"),
        F.coalesce(worst > 0.02, F.lit(False)).alias("above"))


@register("grounding_diagnostics", with_sql(("v_texts", "v_gold_boxes"), VECTOR_SQL + """
, k as (select v.*, t.kind, f1.f * case when nf > nv then (2 + nv) / (2 + nf) else 1 end as iou from vec v join v_texts t on v.gen_index = t.gen_index join f1 on f1.gen_index = v.gen_index)
select kind, round(avg((nv > 0)::int), 9) bbox_valid_rate, round(avg(case when nv > 0 then iou end), 8) mean_iou_given_valid, round(avg(coalesce(nv > 0 and round(iou, 9) > 0.3, false)::int), 9) iou_above_rate,
 round(avg(nv), 9) mean_pred_boxes, max(nv) max_pred_boxes from k group by kind"""))
def grounding_diagnostics(spark, sf):
    n, v = F.col("num_found"), F.size("valid")
    iou = F.round(F.when(n > v, F.col("overlap") * (2 + v) / (2 + n)).otherwise(F.col("overlap")), 9)
    df = scored(spark, sf).select("kind", (v > 0).alias("bbox_valid"), iou.alias("iou"), v.cast("bigint").alias("num_boxes"))
    out = stats.grounding_diagnostics(df, ["kind"])
    return out.select("kind", r9("bbox_valid_rate"), r9("mean_iou_given_valid", 8), r9("iou_above_rate"), r9("mean_pred_boxes"), "max_pred_boxes")


@register("grounding_scan", with_sql(("v_texts", "v_gold_boxes"), VECTOR_SQL + """
select count(*) n, count(*) filter (where nf > 0) present, count(*) filter (where nf = 0) missing, count(*) filter (where nv > 0) valid, count(*) filter (where nf > 0 and nv = 0) invalid,
 count(*) filter (where grounding > 0) nonzero, round(avg(reward_scalar), 7) mean_with, round(avg(reward_scalar - 0.25 * grounding), 7) mean_without from total"""))
def grounding_scan(spark, sf):
    found, v = F.col("num_found") > 0, F.size("valid") > 0
    return scored(spark, sf).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(found).alias("present"), F.count_if(~found).alias("missing"), F.count_if(v).alias("valid"),
        F.count_if(found & ~v).alias("invalid"), F.count_if(F.col("grounding") > 0).alias("nonzero"),
        F.round(F.avg("reward_scalar"), 7).alias("mean_with"),
        F.round(F.avg(F.col("reward_scalar") - 0.25 * F.col("grounding")), 7).alias("mean_without"))


@register("rollout_export_context", with_sql(("v_texts", "v_gold_boxes"), """
select t.gen_index, case when g.task_id is not null then 'export' else 'own' end as source, coalesce(g.x1, t.gen_index % 200) as x1
from v_texts t left join v_gold_boxes g on t.task_id = g.task_id and g.task_id in (select c_custkey from customer where c_acctbal >= 0)"""))
def rollout_export_context(spark, sf):
    solvent = view(spark, sf, "customer").filter("c_acctbal >= 0").select(F.col("c_custkey").alias("task_id"))
    ctx = view(spark, sf, "v_gold_boxes").join(solvent, "task_id", "left_semi").select("task_id", F.col("x1").alias("gx"))
    df = view(spark, sf, "v_texts").join(ctx, "task_id", "left")
    return df.select("gen_index", F.when(F.col("gx").isNotNull(), F.lit("export")).otherwise(F.lit("own")).alias("source"),
                     F.coalesce("gx", F.col("gen_index") % 200).alias("x1"))


# Claims by rollout: exact, one too many, one missing, a malformed one; gold facts of most tasks, one of them twice.
CLAIMS = ("<change>color:red->blue</change><change>size:small->large</change><change>color:red->blue</change>",
          "<change>color:red->blue</change><change>color:red->blue</change><change>size:small->large</change><change>shape:cube->sphere</change>",
          "<change>color:red->blue</change><change>size:small->large</change>",
          "<change>color:red->blue</change><change>color:red->blue</change><change>size:small->large</change><change>size:small</change>")


@register("visual_certificate", with_sql(("v_texts", "v_gold_boxes"), VECTOR_SQL + """
select gen_index, coalesce(spy = spy_gold and changed = changed_gold, false) and format_valid and not shortcut_detected and grounding >= 0.05
 and gen_index % 4 = 0 and task_id % 7 <> 3 and task_id % 5 <> 0 and task_id % 11 <> 2 as certified from vec"""))
def visual_certificate(spark, sf):
    from rollscope.operators.certificate import may_certify, visual_certificate as certify

    rollouts = view(spark, sf, "v_texts").select("gen_index", "task_id", "kind", "completion", "solution")
    said = F.element_at(F.array(*[F.lit(c) for c in CLAIMS]), (F.col("gen_index") % 4 + 1).cast("int"))
    c, s = F.col("completion"), F.col("solution")
    rollouts = rollouts.withColumn("claimed", F.concat(F.lit("<think>x</think>"), said, F.lit("<answer>y</answer>")))
    answers = rollouts.join(context(spark, sf).select("task_id"), "task_id").withColumns({
        "spy": T.spy_field(c), "changed": T.count_field(c), "spy_gold": T.spy_field(s), "changed_gold": T.count_field(s),
        "format_valid": T.format_valid(c)})
    # The accepted task differs for some tasks and is absent for others; some have no gold facts.
    tasks = answers.groupBy("task_id").agg(F.min("spy_gold").alias("spy"), F.min("changed_gold").alias("changed"))
    accepted = tasks.filter("task_id % 11 <> 2").withColumn("spy", F.when(F.col("task_id") % 7 == 3, -1).otherwise(F.col("spy")))
    gold = tasks.filter("task_id % 5 <> 0").selectExpr(
        "task_id", "inline(array(struct('color' attribute, 'red' before, 'blue' after, 2 n), struct('size' attribute, 'small' before, 'large' after, 1 n)))")
    # Only open rows are scored. Stored, since a filter on them would be pushed below the parsing.
    rows = may_certify(answers, accepted, gold, claims="claimed").select(
        "gen_index", "open", F.when(F.col("open"), F.struct(*rollouts.columns)).alias("rollout"))
    rows = cut_lineage(rows)
    df = scoring.score_rollouts(rows.filter("open").select("rollout.*"), context(spark, sf), CFG)
    out = certify(df, accepted, gold, claims="claimed", min_grounding=0.05, need_player=False)
    return rows.filter("not open").select("gen_index", F.lit(False).alias("certified")).unionByName(out.select("gen_index", "certified"))


@register("judge_candidates", with_sql("v_texts", """
with a as (select gen_index, """ + SQ.format("regexp_extract(solution, '(?s)<answer>(.*?)</answer>', 1)") + """ as gold,
 """ + SQ.format("trim(case when regexp_matches(completion, '(?s)<answer>.*?</answer>') then regexp_extract(completion, '(?s)<answer>(.*?)</answer>', 1) else completion end)") + """ as said,
 """ + SQ.format("completion") + """ as whole, contains(completion, '<answer>') as tagged from v_texts)
select gen_index, case when gold = '' then 'no_gold_answer' when said = gold then 'exact_match_succeeded' when said = '' or not tagged then 'final_answer_parse_failed'
 when contains(whole, gold) then 'gold_token_present_but_not_exact' else 'exact_mismatch_possible_synonym' end as reason from a"""))
def judge_candidates(spark, sf):
    from rollscope.operators.certificate import judge_reason

    return view(spark, sf, "v_texts").select("gen_index", judge_reason(F.col("completion"), F.col("solution")).alias("reason"))


@register("verdict_merge", with_sql("v_vectors", """
select v.gen_index, case when answer < 1 and kind = 'view' and v.gen_index % 4 = 0 then 1.0 else answer end as answer from v_vectors v"""))
def verdict_merge(spark, sf):
    from rollscope.operators.certificate import verdict_merge as merge

    v = view(spark, sf, "v_vectors")
    verdicts = v.filter("kind = 'view'").select("gen_index", (F.col("gen_index") % 4 == 0).alias("judge_correct"))
    return merge(v, verdicts, "gen_index").select("gen_index", "answer")


@register("warmup_gate", with_sql("v_vectors", "select gen_index, case when gen_index >= 500 then grounding else 0.0 end as grounding from v_vectors"))
def warmup_gate(spark, sf):
    return view(spark, sf, "v_vectors").select("gen_index", R.warmup_gate(F.col("grounding"), F.col("gen_index"), 500).alias("grounding"))


GROUP_SQL = """
with t as (select gen_index, task_id, kind as said, list_distinct(regexp_extract_all(lower(kind || case gen_index % 4 when 0 then ' red cube' when 1 then ' blue cube' else ' large red sphere' end), '[a-z0-9_]+')) as toks from v_rollouts),
k as (select *, list_filter(toks, lambda x: x in ('red', 'blue', 'cube', 'large', 'sphere')) as ks from t),
n as (select task_id, count(*) n from k group by 1), s as (select task_id, said, count(*) c from k group by 1, 2),
p as (select a.task_id, a.gen_index, a.said, sum(case when b.gen_index is null then 0 else len(list_intersect(a.ks, b.ks)) / (len(a.ks) + len(b.ks) - len(list_intersect(a.ks, b.ks))) end) / count(b.gen_index) as ev,
 sum(len(list_intersect(a.toks, b.toks)) / (len(a.toks) + len(b.toks) - len(list_intersect(a.toks, b.toks)))) / count(b.gen_index) as rs from k a join k b on a.task_id = b.task_id and a.gen_index <> b.gen_index group by 1, 2, 3)
select p.task_id, p.gen_index, round(0.4 * s.c / n.n + 0.3 * ev + 0.3 * rs, 10) as consistency from p join n on p.task_id = n.task_id join s on s.task_id = p.task_id and s.said = p.said"""


@register("group_consistency", with_sql("v_rollouts", GROUP_SQL))
def group_consistency(spark, sf):
    df = view(spark, sf, "v_rollouts").selectExpr(
        "gen_index", "task_id", "concat('<think>', kind, case gen_index % 4 when 0 then ' red cube' when 1 then ' blue cube' "
        "else ' large red sphere' end, '</think><answer>', kind, '</answer>') as completion")
    return scoring.group_consistency(df).select("task_id", "gen_index", r9("consistency", 10))


# With boxes, these are the evidence of a group that gives any: one box per rollout here, in two of three groups.
@register("group_consistency_boxes", with_sql("v_rollouts", GROUP_SQL[:GROUP_SQL.rindex("select p.task_id")].rstrip() + """,
b as (select task_id, gen_index, gen_index * 37 % 100 as x, gen_index * 11 % 80 as y from v_rollouts where task_id % 3 <> 0 and gen_index % 7 <> 0),
o as (select a.task_id, a.gen_index, greatest(0, 60 - abs(a.x - g.x)) * greatest(0, 50 - abs(a.y - g.y)) as inter from b a join b g on a.task_id = g.task_id and a.gen_index <> g.gen_index),
v as (select task_id, gen_index, avg(inter / (6000 - inter)) as iou from o group by 1, 2), have as (select distinct task_id from b)
select p.task_id, p.gen_index, round(case when n.n = 1 then 1 else 0.4 * s.c / n.n + 0.3 * case when have.task_id is null then ev else coalesce(iou, 0) end + 0.3 * rs end, 10) as consistency
 from p join n on p.task_id = n.task_id join s on s.task_id = p.task_id and s.said = p.said left join have on have.task_id = p.task_id left join v on v.task_id = p.task_id and v.gen_index = p.gen_index"""))
def group_consistency_boxes(spark, sf):
    df = view(spark, sf, "v_rollouts").selectExpr(
        "gen_index", "task_id", "concat('<think>', kind, case gen_index % 4 when 0 then ' red cube' when 1 then ' blue cube' "
        "else ' large red sphere' end, '</think><answer>', kind, '</answer>') as completion",
        "if(task_id % 3 = 0 or gen_index % 7 = 0, null, array(array(double(gen_index * 37 % 100), double(gen_index * 11 % 80), "
        "double(gen_index * 37 % 100 + 60), double(gen_index * 11 % 80 + 50)))) as boxes")
    return scoring.group_consistency(df, boxes="boxes").select("task_id", "gen_index", r9("consistency", 10))


# Letters outside ASCII become one mark on both sides: the SQL engine's edit distance counts bytes.
ASCII_TEXT = "regexp_replace(text, '[^\\x00-\\x7F]', '~', 'g')"
SIM_SQL = """
0.5 * case when len({a}w) = 0 or len({b}w) = 0 then 0 else len(list_intersect({a}w, {b}w)) / (len({a}w) + len({b}w) - len(list_intersect({a}w, {b}w))) end
 + 0.5 * case when greatest(length({a}s), length({b}s)) = 0 then 1 else 1 - levenshtein({a}s, {b}s) / greatest(length({a}s), length({b}s)) end"""
STEP_SQL = "select *, " + SQ.format("t") + " as s, list_distinct(regexp_extract_all(lower(t), '[a-z0-9_]+')) as w from (select conv_id, turn, role, " + ASCII_TEXT + " as t from conversations)"


def ascii_text(df):
    return df.withColumn("text", F.regexp_replace("text", r"[^\x00-\x7F]", "~"))


@register("step_coverage", "with c as (" + STEP_SQL + "), m as (select r.conv_id, r.turn, max(case when c.conv_id is null then 0 else "
          + SIM_SQL.format(a="c.", b="r.") + """ end) as best from c r left join c on r.conv_id = c.conv_id and c.role = 'assistant' where r.role = 'user' group by 1, 2)
select conv_id, round(avg(best), 8) as coverage from m group by 1""")
def step_coverage(spark, sf):
    from rollscope.operators.certificate import step_coverage as cover

    conv = ascii_text(view(spark, sf, "conversations"))
    side = lambda r: conv.filter(F.col("role") == r).select("conv_id", "text")
    return cover(side("user"), side("assistant"), "conv_id", "text").select("conv_id", r9("coverage", 8))


@register("step_similarity", "with c as (" + STEP_SQL + ") select a.conv_id, a.turn, round(" + SIM_SQL.format(a="a.", b="b.")
          + ", 8) as similarity from c a join c b on a.conv_id = b.conv_id and b.turn = a.turn + 1")
def step_similarity(spark, sf):
    conv = ascii_text(view(spark, sf, "conversations")).select("conv_id", "turn", "text")
    nxt = conv.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    return conv.join(nxt, ["conv_id", "turn"]).select(
        "conv_id", "turn", F.round(T.step_similarity(F.col("text"), F.col("next")), 8).alias("similarity"))


METHOD_SQL = """
with t as (select gen_index, gen_index % 4 as k, case gen_index % 3 when 0 then '<answer>Yes</answer>' when 1 then '<answer>B.</answer>' else '<answer>no</answer>' end as said,
 case when spy_gold % 2 = 0 then '<answer>yes</answer>' else '<answer>B.</answer>' end as gold, spy_gold % 2 = 0 as yes from v_texts)
"""


def _method_rows(spark, sf):
    return view(spark, sf, "v_texts").selectExpr(
        "gen_index", "case gen_index % 4 when 0 then 'yes_no' when 1 then 'mcq' when 2 then 'all_match' else 'unknown' end as method",
        "case gen_index % 3 when 0 then '<answer>Yes</answer>' when 1 then '<answer>B.</answer>' else '<answer>no</answer>' end as completion",
        "if(spy_gold % 2 = 0, '<answer>yes</answer>', '<answer>B.</answer>') as solution")


@register("method_dispatch", with_sql("v_texts", METHOD_SQL + """
select gen_index, case when k = 0 then case when (case gen_index % 3 when 0 then 'yes' when 1 then '' else 'no' end) = (case when yes then 'yes' else '' end) then 1.0 else 0.0 end
 when k = 1 then case when gen_index % 3 = 1 and not yes then 1.0 else 0.0 end
 else case when (gen_index % 3 = 0 and yes) or (gen_index % 3 = 1 and not yes) then 1.0 else 0.0 end end as score from t"""))
def method_dispatch(spark, sf):
    reg = RewardRegistry.default()
    return reg.dispatch(_method_rows(spark, sf), "method", default="all_match").select("gen_index", "score")


@register("reward_registry", with_sql("v_texts", METHOD_SQL + """
select gen_index, case when (gen_index % 3 = 0 and yes) or (gen_index % 3 = 1 and not yes) then 1.0 else 0.0 end as all_match, cast(length(said) as double) / 100 as extra from t"""))
def reward_registry(spark, sf):
    reg = RewardRegistry.default().extend({"extra": lambda c, s: F.length(c) / 100.0})
    return reg.score_all(_method_rows(spark, sf), ["all_match", "extra"]).select("gen_index", "all_match", "extra")


@register("custom_udf", with_sql("v_vectors", "select gen_index, round(answer + 0.5 * budget, 9) as total from v_vectors"))
def custom_udf(spark, sf):
    fn = sample_udf(lambda answer, budget: [a + 0.5 * b for a, b in zip(answer, budget)])
    return view(spark, sf, "v_vectors").select("gen_index", F.round(fn("answer", "budget"), 9).alias("total"))


@register("group_udf", with_sql("v_vectors", """
select gen_index, task_id, round(reward_scalar - median(reward_scalar) over (partition by task_id), 9) as centred from v_vectors"""))
def group_udf_query(spark, sf):
    def centre(pdf):
        out = pdf[["gen_index", "task_id"]].copy()
        out["centred"] = (pdf["reward_scalar"] - pdf["reward_scalar"].median()).round(9)
        return out

    df = view(spark, sf, "v_vectors").select("gen_index", "task_id", "reward_scalar")
    return group_udf(df, ["task_id"], centre, "gen_index bigint, task_id bigint, centred double")


@register("sft_replay_rows", with_sql("v_vectors", ROUTE_SQL + """
select gen_index, task_id, 'text ' || gen_index as solution, 'positive' as source_buffer, routing_reason from buffered where buffer = 'positive'"""))
def sft_replay_rows(spark, sf):
    df = routed(spark, sf).withColumn("completion", F.concat(F.lit("text "), F.col("gen_index").cast("string")))
    return exports.sft_replay_rows(df).select("gen_index", "task_id", "solution", "source_buffer", "routing_reason")


@register("round_totals", with_sql("v_vectors", ROUTE_SQL + """
select kind as round, count(*) n, round(avg(reward_scalar), 9) mean_reward, count(distinct task_id) tasks, count(*) filter (where buffer = 'positive') positives, round(avg(grounding), 9) mean_grounding from buffered group by 1"""))
def round_totals(spark, sf):
    df = routed(spark, sf)
    per_task = df.groupBy("kind", "task_id").agg(F.count(F.lit(1)).alias("n"), F.sum("reward_scalar").alias("r"),
                                                 F.count_if(F.col("buffer") == "positive").alias("p"), F.sum("grounding").alias("g"))
    return per_task.groupBy(F.col("kind").alias("round")).agg(
        F.sum("n").alias("n"), F.round(F.sum("r") / F.sum("n"), 9).alias("mean_reward"), F.count(F.lit(1)).alias("tasks"),
        F.sum("p").alias("positives"), F.round(F.sum("g") / F.sum("n"), 9).alias("mean_grounding"))
