"""Queries over proposals, pairs, plans, feedback and policies."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollscope.functions.rewards import learnability as learn
from rollscope.operators import curriculum as C
from rollscope.operators import gates, ranking, scenes, skew, stats
from rollscope.plans.catalog import register
from rollscope.plans.queries_scenes import CHANGED
from rollscope.plans.queries_stats import STATS_BIG, r9
from rollscope.sources.views import view, with_sql

MASK = "list_filter(range(0, 5), lambda i: ({0} >> i) & 1 = 1)"
KEEP_TXT = "array_to_string(" + MASK + ", ',')"


def proposals(spark, sf):
    return view(spark, sf, "v_proposals").withColumn("keep", scenes.mask_members(F.col("mask"), 5))


@register("learnability", with_sql("v_rollouts_big", STATS_BIG + "select task_id, round(4 * pass_rate * (1 - pass_rate), 9) as learnability from stats"))
def learnability(spark, sf):
    st = stats.task_statistics(view(spark, sf, "v_rollouts_big"), scene=None)
    return st.select("task_id", F.round(learn(F.col("pass_rate")), 9).alias("learnability"))


SCORE_SQL = STATS_BIG + """
, pr as (select proposal_id, proposal_id * 2 as tid, mask, kind from v_proposals),
scored as (select p.proposal_id, p.mask, s.n is not null as reached, coalesce(4 * s.pass_rate * (1 - s.pass_rate), 0) as learnability, s.class as solver_class
 from pr p left join stats s on s.task_id = p.tid and p.kind <> 'error')
"""


def scored_proposals(spark, sf):
    p = proposals(spark, sf)
    tasks = p.filter("kind <> 'error'").select("proposal_id", (F.col("proposal_id") * 2).alias("task_id"))
    st = stats.task_statistics(view(spark, sf, "v_rollouts_big"), scene=None)
    return C.proposal_score(p.drop("pass_rate"), tasks, st)


@register("proposal_score", with_sql(("v_proposals", "v_rollouts_big"), SCORE_SQL + """
select proposal_id, reached, solver_class, round(learnability, 9) learnability from scored"""))
def proposal_score(spark, sf):
    return scored_proposals(spark, sf).select("proposal_id", "reached", "solver_class", r9("learnability"))


@register("proposal_report", with_sql(("v_proposals", "v_rollouts_big"), SCORE_SQL + """
select count(*) num_proposals, count(*) num_parsed, count(*) filter (where reached) num_reached, round(sum(case when reached then learnability end) / count(*) filter (where reached), 9) mean_learnability,
 count(*) filter (where reached and solver_class = 'trainable') num_trainable, count(distinct mask) distinct_subsets, 1.0 as parse_rate, round(count(distinct mask) / count(*), 9) diversity from scored"""))
def proposal_report(spark, sf):
    out = C.proposal_report(scored_proposals(spark, sf), "keep")
    return out.select("num_proposals", "num_parsed", "num_reached", r9("mean_learnability"), "num_trainable",
                      "distinct_subsets", "parse_rate", r9("diversity"))


@register("proposer_sft_rows", with_sql(("v_proposals", "v_rollouts_big"), SCORE_SQL + f"""
select proposal_id, '<keep>[' || {KEEP_TXT.format('mask')} || ']</keep>' as completion, 'proposer' as source_buffer from scored where reached and round(learnability, 9) >= 0.5"""))
def proposer_sft_rows(spark, sf):
    from rollscope.operators.exports import proposer_sft_rows as rows

    p = scored_proposals(spark, sf).withColumn("completion", F.concat(
        F.lit("<keep>["), F.array_join(F.col("keep").cast("array<string>"), ","), F.lit("]</keep>"))).withColumn("prompt", F.lit("pick"))
    return rows(p).select("proposal_id", "completion", "source_buffer")


PAIRING_SQL = "with recursive " + with_sql("v_proposals", """
with edges as materialized (select a.scene_id, a.num_players, a.proposal_id as s, b.proposal_id as l,
 row_number() over (partition by a.scene_id, a.num_players order by a.proposal_id, b.proposal_id) as i
 from v_proposals a join v_proposals b on a.scene_id = b.scene_id and a.num_players = b.num_players and a.mask & b.mask = a.mask and bit_count(b.mask) = bit_count(a.mask) + 1),
walk as (select scene_id, num_players, 0::bigint as i, []::bigint[] as used, null::bigint as s, null::bigint as l from edges where i = 1
 union all select e.scene_id, e.num_players, e.i, case when list_contains(w.used, e.s) or list_contains(w.used, e.l) then w.used else w.used || [e.s, e.l] end,
 case when list_contains(w.used, e.s) or list_contains(w.used, e.l) then null else e.s end, e.l
 from walk w join edges e on e.scene_id = w.scene_id and e.num_players = w.num_players and e.i = w.i + 1)
select scene_id, cast(num_players as bigint) as num_players, s as small_id, l as large_id from walk where s is not null""").strip()[5:]


@register("proposal_pairing", PAIRING_SQL)
def proposal_pairing(spark, sf):
    return C.proposal_pairing(proposals(spark, sf).select(
        "scene_id", F.col("num_players").cast("bigint").alias("num_players"), "proposal_id", "keep"), "keep")


@register("distinct_choices", with_sql("v_proposals", f"""
select scene_id, num_players, {KEEP_TXT.format('mask')} as keep, min(proposal_id) as proposal_id from v_proposals group by scene_id, num_players, mask"""))
def distinct_choices(spark, sf):
    out = C.distinct_choices(proposals(spark, sf), ["scene_id", "num_players"], "keep", "proposal_id")
    return out.select("scene_id", "num_players", F.array_join("keep", ",").alias("keep"), "proposal_id")


@register("proposal_plan", with_sql("v_proposals", f"""
with ok as (select * from v_proposals where scene_id not in (select c_custkey from customer where c_acctbal < 0)), d as (select scene_id, num_players, mask, min(proposal_id) as proposal_id from ok group by 1, 2, 3 order by 4 limit 400)
select proposal_id, scene_id, {KEEP_TXT.format('mask')} as keep,
 cast(('0x' || substr(sha256('42|' || scene_id || '|' || num_players), 1, 8))::bigint % num_players + 1 as bigint) as spy_player from d"""))
def proposal_plan(spark, sf):
    p = proposals(spark, sf)
    closed = view(spark, sf, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("scene_id"))
    out = C.proposal_plan(p, 400, 42, exclude=closed)
    return out.select("proposal_id", "scene_id", F.array_join("keep", ",").alias("keep"), "spy_player")


TASKS_PAIR = ("o_orderkey as task_id", "concat('p', cast((o_orderkey - o_orderkey % 2) / 2 as string)) as pair_id",
              "case when o_orderkey % 2 = 0 then 'small' else 'large' end as pair_role", "(o_orderkey - o_orderkey % 2) / 2 as scene_id")


def pair_tasks(spark, sf):
    """Two tasks per scene; every fifth scene's large side is no superset, every eleventh has a bad spy."""
    return view(spark, sf, "orders").selectExpr(
        "o_orderkey as task_id", "concat('p', cast(o_orderkey div 2 as string)) as pair_id",
        "if(o_orderkey % 2 = 0, 'small', 'large') as pair_role", "o_orderkey div 2 as scene_id", "4 as num_players",
        "if((o_orderkey div 2) % 11 = 0, 9, (o_orderkey div 2) % 4 + 1) as spy_player",
        "if(o_orderkey % 2 = 0, array(0), if((o_orderkey div 2) % 5 = 0, array(1, 2), array(0, 1))) as keep")


@register("counterfactual_pairs", with_sql("v_rollouts_big", """
with m as (select task_id, count_pred, count(*) c from v_rollouts_big group by 1, 2 qualify row_number() over (partition by task_id order by count(*) desc, count_pred) = 1),
s as (select o_orderkey // 2 as scene_id, m.count_pred as mode from orders join m on m.task_id = o_orderkey where o_orderkey % 2 = 0),
l as (select o_orderkey // 2 as scene_id, m.count_pred as mode from orders join m on m.task_id = o_orderkey where o_orderkey % 2 = 1)
select 'p' || s.scene_id as pair_id, s.mode as small_mode, l.mode as large_mode from s join l on s.scene_id = l.scene_id where s.scene_id % 5 <> 0 and s.scene_id % 11 <> 0"""))
def counterfactual_pairs(spark, sf):
    out = C.counterfactual_pairs(view(spark, sf, "v_rollouts_big"), pair_tasks(spark, sf))
    return out.select("pair_id", "small_mode", "large_mode")


@register("pair_member_valid", """
select o_orderkey as task_id from orders where (o_orderkey // 2) % 11 <> 0""")
def pair_member_valid(spark, sf):
    return C.pair_member_valid(pair_tasks(spark, sf)).select("task_id")


@register("join_unique_accepted", with_sql("v_rollouts", """
with t as (select o_custkey as task_id, count(*) c, min(o_totalprice) price from orders group by 1)
select gen_index, r.task_id, case when c = 1 then price end as price from v_rollouts r left join t on r.task_id = t.task_id"""))
def join_unique_accepted(spark, sf):
    tasks = view(spark, sf, "orders").select(F.col("o_custkey").alias("task_id"), F.col("o_totalprice").alias("price"))
    return C.join_unique_accepted(view(spark, sf, "v_rollouts"), tasks).select("gen_index", "task_id", "price")


@register("keep_valid", with_sql("v_proposals", f"""
select proposal_id, case when proposal_id % 4 = 0 then '0,1,2,3,4' when proposal_id % 4 = 1 then null else {KEEP_TXT.format('mask')} end as keep from v_proposals"""))
def keep_valid(spark, sf):
    p = proposals(spark, sf)
    k = F.col("keep").cast("array<bigint>")
    raw = F.when(F.col("proposal_id") % 4 == 0, F.lit(None)).when(F.col("proposal_id") % 4 == 1, F.concat(k, k)).otherwise(F.reverse(k))
    return p.withColumn("raw", raw).select("proposal_id", F.array_join(
        gates.keep_valid(F.col("raw"), F.lit(5)), ",").alias("keep"))


LATTICE_SQL = f"""
with d as (select distinct scene_id, mask from v_proposals),
lat as (select a.scene_id, a.mask as sm, b.mask as lg, {KEEP_TXT.format('a.mask')} as small, {KEEP_TXT.format('b.mask')} as large
 from d a join d b on a.scene_id = b.scene_id and a.mask & b.mask = a.mask and bit_count(b.mask) = bit_count(a.mask) + 1),
sd as (select user_id as scene_id, count(*) * 1000 + user_id as rank, case user_id % 3 when 0 then 'harder' when 1 then 'easier' else 'hold' end as direction, min(event_id) % 31 + 1 as mask from events group by 1),
fit as (select sd.*, lat.* exclude (scene_id), sha256('7|' || sd.scene_id || '|' || small || '|' || large) as h from sd join lat on sd.scene_id = lat.scene_id where direction <> 'hold' or sm = mask or lg = mask),
one as (select * from fit qualify row_number() over (partition by scene_id order by h) = 1 order by rank limit 30)
"""


@register("edit_plan", with_sql("v_proposals", LATTICE_SQL + """
select rank, scene_id, scene_id || '::' || replace(small, ',', '-') || '|' || replace(large, ',', '-') as pair_id, r.role as pair_role, case when r.role = 'small' then small else large end as subset,
 case when direction = 'hold' then (lg = mask) else direction = 'harder' end = (r.role = 'large') as primary_side from one cross join (values ('small'), ('large')) r(role)"""))
def edit_plan(spark, sf):
    subs = proposals(spark, sf).select("scene_id", "keep").distinct()
    lattice = scenes.lattice_pairs(subs, ["scene_id"], "keep")
    seeds = view(spark, sf, "events").groupBy(F.col("user_id").alias("scene_id")).agg(
        F.count(F.lit(1)).alias("c"), F.min("event_id").alias("m")).select(
        "scene_id", (F.col("c") * 1000 + F.col("scene_id")).alias("rank"),
        F.expr("case scene_id % 3 when 0 then 'harder' when 1 then 'easier' else 'hold' end").alias("direction"),
        scenes.mask_members(F.col("m") % 31 + 1, 5).alias("keep"))
    out = C.edit_plan(seeds, lattice, 60, 7)
    return out.select("rank", "scene_id", "pair_id", "pair_role", F.array_join("subset", ",").alias("subset"),
                      F.col("primary").alias("primary_side"))


@register("drop_half_pairs", """
with m as (select o_orderkey, case when o_orderkey % 10 = 0 then null else o_orderkey // 2 end as pair_id, o_orderstatus <> 'P' as built from orders),
ok as (select pair_id from m where pair_id is not null group by 1 having bool_and(built))
select o_orderkey as task_id from m where pair_id in (select pair_id from ok) or (pair_id is null and built)""")
def drop_half_pairs(spark, sf):
    m = view(spark, sf, "orders").selectExpr(
        "o_orderkey as task_id", "if(o_orderkey % 10 = 0, null, o_orderkey div 2) as pair_id", "o_orderstatus <> 'P' as built")
    return C.drop_half_pairs(m).select("task_id")


VIS_SQL = """
with e as (select scene_id, obj, greatest(case when before_color <> after_color then 1.0 else 0 end, case when before_shape <> after_shape then 0.8 else 0 end,
 case when before_size <> after_size then 0.55 else 0 end, case when before_material <> after_material then 0.35 else 0 end) as sal,
 least(1.0, case when after_size = 'large' then 1.0 else 0.6 end * greatest(0.3, least(1.0, 12.0 / depth))) as sc from v_edits),
o as (select scene_id, obj, max(sal) sal, max(sc) sc from e where sal > 0 group by 1, 2), c as (select scene_id, count(*) clutter from v_edits group by 1),
s as (select o.scene_id, obj, round(sal * (0.5 + 0.5 * sc) * greatest(0.5, least(1.0, 8.0 / clutter)), 9) as score from o join c on o.scene_id = c.scene_id),
vis as (select *, row_number() over (partition by scene_id order by score desc, obj) as visible_rank from s qualify visible_rank <= 2)
"""


def _clutter(spark, sf):
    return view(spark, sf, "v_edits").groupBy("scene_id").agg(F.count(F.lit(1)).alias("clutter"))


@register("rank_visible_edits", with_sql("v_edits", VIS_SQL + "select scene_id, obj, score, visible_rank from vis"))
def rank_visible_edits(spark, sf):
    return C.rank_visible_edits(view(spark, sf, "v_edits"), _clutter(spark, sf)).select("scene_id", "obj", "score", "visible_rank")


@register("bootstrap_pairs", with_sql("v_edits", VIS_SQL + """
, p as (select scene_id, max(case when visible_rank = 1 then obj end) f, max(case when visible_rank = 2 then obj end) s from vis group by 1 having count(*) = 2),
k as (select * from p where scene_id not in (select o_orderkey from orders where o_orderstatus = 'F') order by sha256('5|' || scene_id) limit 50)
select scene_id, scene_id || '::bootstrap::' || f || '|' || least(f, s) || '-' || greatest(f, s) as pair_id, r.role as pair_role,
 case when r.role = 'small' then cast(f as varchar) else least(f, s) || ',' || greatest(f, s) end as keep from k cross join (values ('small'), ('large')) r(role)"""))
def bootstrap_pairs(spark, sf):
    edits = view(spark, sf, "v_edits")
    done = view(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("scene_id"))
    out = C.bootstrap_pairs(edits, _clutter(spark, sf), 100, 5, exclude=done)
    return out.select("scene_id", "pair_id", "pair_role", F.array_join("keep", ",").alias("keep"))


@register("fresh_tasks", with_sql("v_edits", f"""
with s as (select scene_id, cast(sum({CHANGED}) as bigint) ch, count(*) as boxes, round(sum(greatest(0.0, px - 48)), 6) as lefts from v_edits group by 1), n as (select *, (scene_id + 3) % 5 + 1 as spy from s)
select 'r1::' || scene_id as task_id, spy as spy_player, '<answer>spy=' || spy || '; changed_attributes=' || ch || '</answer>' as solution,
 array_to_string(list_transform(range(1, 6), lambda p: scene_id || case when p = spy then '_modified.png' else '_original.png' end), ',') as images, boxes, lefts from n"""))
def fresh_tasks(spark, sf):
    d = scenes.difficulty(view(spark, sf, "v_edits"))
    out = C.fresh_tasks(d, 5, F.col("scene_id"), 3, "r1", scenes.scene_boxes(view(spark, sf, "v_edits")))
    lefts = F.aggregate("gold_boxes", F.lit(0.0), lambda a, b: a + b[0])
    return out.select("task_id", "spy_player", "solution", F.array_join("image_path", ",").alias("images"),
                      F.size("gold_boxes").cast("bigint").alias("boxes"), F.round(lefts, 6).alias("lefts"))


@register("slot_assignment", with_sql("v_tasks", "select task_id, (task_id + 4) % 6 + 1 as slot from v_tasks"))
def slot_assignment(spark, sf):
    return view(spark, sf, "v_tasks").select("task_id", ranking.slot_assignment(
        F.col("task_id"), F.lit(4), F.lit(6)).alias("slot"))


@register("exclude_seen", """
select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'F')""")
def exclude_seen(spark, sf):
    seen = view(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return view(spark, sf, "customer").select("c_custkey").join(seen.distinct(), "c_custkey", "left_anti")


@register("stratified_take", with_sql("v_tasks", """
with r as (select *, row_number() over (partition by difficulty, count_gold order by sha256('3|' || task_id), task_id) rn from v_tasks),
p as (select *, row_number() over (partition by difficulty order by rn, count_gold) pos from r),
k as (select task_id, difficulty, count_gold, false as fill from p where pos <= case difficulty when 'easy' then 60 when 'medium' then 100 else 40 end),
z as (select *, row_number() over (partition by count_gold order by sha256('3|' || task_id), task_id) rn from v_tasks where task_id not in (select task_id from k)),
f as (select task_id, difficulty, count_gold, true as fill from z order by rn, count_gold limit 50)
select * from k union all select * from f"""))
def stratified_take(spark, sf):
    pool = view(spark, sf, "v_tasks").select("task_id", "difficulty", "count_gold")
    return C.stratified_take(pool, "difficulty", "count_gold", "task_id", {"easy": 60, "medium": 100, "hard": 40}, 250, 3)


FEEDBACK_SQL = """
with f as (select *, contains(reject_reason, 'too_hard') as hardr, coalesce(target, 'medium') as tg, case coalesce(target, 'medium') when 'easy' then 0 when 'medium' then 1 else 2 end
 - case suggested when 'easy' then 0 when 'medium' then 1 when 'hard' then 2 end as gap from v_feedback where judged),
fb as (select run_id, count(*) num_judged, count(*) filter (where not accepted) num_rejected, count(*) filter (where not accepted and hardr) too_difficult,
 count(*) filter (where target is null) target_missing, count(*) filter (where gap > 0) strict_easier, count(*) filter (where gap = 0 and accepted and not hardr) target_echo,
 count(*) filter (where reason = 'reduce_difficulty' or hardr) reduce_difficulty from f group by run_id)
"""


@register("feedback_summary", with_sql("v_feedback", FEEDBACK_SQL + "select * from fb"))
def feedback_summary(spark, sf):
    return C.feedback_summary(view(spark, sf, "v_feedback"), ["run_id"])


@register("feedback_histograms", with_sql("v_feedback", FEEDBACK_SQL + """
select 'reject_reason' as field, case when hardr then 'too_difficult' when reject_reason = '' then 'unspecified' else reject_reason end as value, count(*) cnt from f where not accepted group by 2
union all select 'suggested', suggested, count(*) from f where suggested is not null group by 2 union all select 'target', tg, count(*) from f group by 2
union all select 'gap', cast(gap as varchar), count(*) from f where suggested is not null group by 2"""))
def feedback_histograms(spark, sf):
    return C.feedback_histograms(view(spark, sf, "v_feedback"))


STATE_SQL = FEEDBACK_SQL + """
, vec as (select task_id % 12 as run_id, avg(answer) am, avg(grounding) gm, count(*) filter (where grounding < 0.5) gf, count(*) filter (where process < 0.5) pf from v_vectors group by 1),
st as (select vec.run_id, am as answer_mean, gm as grounding_mean, case when vec.run_id % 4 = 3 then gf else 0 end as grounding_failures, pf as process_failures,
 case when vec.run_id % 4 = 0 then coalesce(fb.too_difficult, 0) else 0 end as too_difficult, case when vec.run_id % 4 = 0 then coalesce(fb.strict_easier, 0) else 0 end as strict_easier,
 case when vec.run_id % 4 = 0 then coalesce(fb.reduce_difficulty, 0) else 0 end as reduce_difficulty, coalesce(fb.target_echo, 0) as target_echo,
 case when vec.run_id % 3 = 2 then null else vec.run_id / 12.0 end as solve_rate, case when vec.run_id % 2 = 0 then 0.5 end as verified_rate, case when vec.run_id % 5 = 1 then 0 end as num_certified, vec.run_id as version
 from vec left join fb on fb.run_id = vec.run_id)
"""


FOCUS_CTE = """
, fw as (select run_id, focus, printf('%.4f', round(count(*) / any_value(total), 4)) as w from
 (select task_id % 12 as run_id, case when grounding < 0.5 then 'visual_evidence_grounding' when process < 0.5 then 'multi_step_reasoning_structure' when answer < 1 then 'final_decision_reasoning' end as focus from v_vectors)
 join (select task_id % 12 as r, count(*) total from v_vectors group by 1) on r = run_id where focus is not null group by run_id, focus)
"""


def failure_tags(spark, sf):
    return view(spark, sf, "v_vectors").groupBy(
        (F.col("task_id") % 12).alias("run_id"),
        F.expr("case when grounding < 0.5 then 'grounding_failure' when process < 0.5 then 'process_failure' "
               "when answer < 1 then 'reasoning_or_final_decision_failure' else 'other' end").alias("tag")).agg(
        F.count(F.lit(1)).alias("n"))


@register("next_policy", with_sql(("v_feedback", "v_vectors"), STATE_SQL + FOCUS_CTE + """
, b as (select *, case when reduce_difficulty > 0 or strict_easier > 0 or too_difficult > 0 then 'hint' when num_certified = 0 then 'nocert' when solve_rate > 0.65 and verified_rate is not null then 'holde' when solve_rate > 0.65 then 'up'
 when solve_rate < 0.35 then 'down' when solve_rate is not null then 'band' when answer_mean >= 0.8 then 'aup' when answer_mean <= 0.2 then 'adown' else 'none' end as br from st)
select run_id, version + 1 as version, case when br in ('hint', 'down', 'adown') then 0.375 when br in ('up', 'aup') then 0.2 else 0.3 end as easy,
 case when br in ('hint', 'down', 'adown') then 0.575 else 0.5 end as medium, case when br in ('hint', 'down', 'adown') then 0.05 when br in ('up', 'aup') then 0.3 else 0.2 end as hard,
 case when br = 'hint' then 'easy' when br in ('up', 'aup') then 'hard' else 'medium' end as target, run_id * 2 + 1 as seed_offset,
 coalesce((select string_agg(focus || '=' || w, ',' order by focus) from fw where fw.run_id = b.run_id), '') as focus,
 concat_ws('; ', case when br = 'hint' and too_difficult > 0 then 'reduce_hard_due_to_reference_too_difficult(count=' || too_difficult || ')' end,
 case when br = 'hint' and reduce_difficulty > 0 and too_difficult = 0 then 'reduce_hard_due_to_explicit_reduce_signal(count=' || reduce_difficulty || ')' end,
 case when br = 'hint' and strict_easier > 0 then 'reduce_hard_due_to_strict_easier_suggestion(count=' || strict_easier || ')' end,
 case br when 'nocert' then 'hold_difficulty_until_visual_certificate_available' when 'holde' then 'hold_difficulty_until_visual_evidence_mastered(0.50)' when 'up' then 'increase_difficulty_solve_rate_above_band(' || printf('%.2f', solve_rate) || ')'
  when 'down' then 'reduce_difficulty_solve_rate_below_band(' || printf('%.2f', solve_rate) || ')' when 'band' then 'hold_difficulty_solve_rate_in_band(' || printf('%.2f', solve_rate) || ')'
  when 'aup' then 'increase_hard_due_to_strong_answer_accuracy' when 'adown' then 'reduce_difficulty_due_to_low_answer_accuracy' when 'none' then 'no_difficulty_signal_keep_previous' end,
 case when target_echo > 0 and br <> 'hint' then 'ignored_target_echo_suggestions(count=' || target_echo || ')' end,
 case when grounding_failures > 0 or grounding_mean < 0.5 then 'increase_grounding_focus_due_to_grounding_failure' end,
 case when process_failures > 0 then 'increase_process_focus_due_to_process_failure' end) as reasons from b
 union all select run_id, 1, 0.3, 0.5, 0.2, 'hard', 8, '', 'no_feedback_keep_previous_or_minimal_decay' from range(100, 103) q(run_id)"""))
def next_policy(spark, sf):
    fb = C.feedback_summary(view(spark, sf, "v_feedback"), ["run_id"])
    vec = view(spark, sf, "v_vectors").groupBy((F.col("task_id") % 12).alias("run_id")).agg(
        F.avg("answer").alias("answer_mean"), F.avg("grounding").alias("grounding_mean"),
        F.count_if(F.col("grounding") < 0.5).alias("gf"), F.count_if(F.col("process") < 0.5).alias("process_failures"))
    only = lambda c: f"if(run_id % 4 = 0, coalesce({c}, 0), 0) as {c}"
    state = vec.join(fb, "run_id", "left").selectExpr(
        "run_id", "answer_mean", "grounding_mean", "if(run_id % 4 = 3, gf, 0) as grounding_failures", "process_failures",
        only("too_difficult"), only("strict_easier"), only("reduce_difficulty"), "target_echo",
        "if(run_id % 3 = 2, null, run_id / 12.0D) as solve_rate", "if(run_id % 2 = 0, 0.5D, null) as verified_rate",
        "if(run_id % 5 = 1, 0L, null) as num_certified", "run_id as version", "run_id * 2 as prev_seed_offset", "0.3D as prev_easy", "0.5D as prev_medium",
        "0.2D as prev_hard", "'medium' as prev_target")
    # Three runs that nobody has said anything about.
    silent = spark.range(100, 103).selectExpr("id as run_id", *[
        f"cast({'0' if c == 'version' else '7' if c == 'prev_seed_offset' else '0.3' if c == 'prev_easy' else '0.5' if c == 'prev_medium' else '0.2' if c == 'prev_hard' else 'null'} as {t}) as {c}"
        if c != "prev_target" else "'hard' as prev_target" for c, t in state.dtypes if c != "run_id"])
    out = C.next_policy(state.unionByName(silent), C.focus_weights(failure_tags(spark, sf)))
    text = F.array_join(F.transform("focus", lambda f: F.concat_ws("=", f["focus"], F.format_string("%.4f", f["weight"]))), ",")
    return out.withColumn("focus", text)


@register("focus_weights", with_sql("v_vectors", """
with t as (select task_id % 12 as run_id, case when grounding < 0.5 then 'visual_evidence_grounding' when process < 0.5 then 'multi_step_reasoning_structure' when answer < 1 then 'final_decision_reasoning' end as focus from v_vectors)
select run_id, focus, round(count(*) / any_value(total), 9) as weight from t join (select task_id % 12 as r, count(*) total from v_vectors group by 1) on r = run_id where focus is not null group by run_id, focus"""))
def focus_weights(spark, sf):
    return C.focus_weights(failure_tags(spark, sf)).select("run_id", "focus", r9("weight"))


@register("editing_policy", with_sql("v_rollouts_big", STATS_BIG + """
, top as (select 'seed' as list, task_id, case when pass_rate >= 0.5 then 'harder' else 'easier' end as direction from stats where class = 'trainable' qualify row_number() over (order by regret desc, task_id) <= 16),
done as (select s.task_id % 5000 as scene_id from stats s group by 1 having bool_and(class = 'mastered'))
select list, task_id, task_id % 5000 as scene_id, direction from (select * from top union all select 'too_hard', task_id, 'easier' from stats where class = 'too_hard'
 union all select 'retire', task_id, null from stats where class = 'mastered' and task_id % 5000 in (select scene_id from done))"""))
def editing_policy(spark, sf):
    return C.editing_policy(stats.task_statistics(view(spark, sf, "v_rollouts_big").selectExpr("*", "slot as gen_index", "task_id % 5000 as scene_id")), 16)


@register("policy_diff", with_sql("v_vectors", """
with p as (select task_id as run_id, gen_index % 5 as round, round(avg(answer), 1) as a, count(*) as n from v_vectors group by 1, 2),
d as (select c.run_id, c.round, 'a' as field, cast(q.a as varchar) as old, cast(c.a as varchar) as new from p c join p q on q.run_id = c.run_id and q.round + 1 = c.round
 union all select c.run_id, c.round, 'n', cast(q.n as varchar), cast(c.n as varchar) from p c join p q on q.run_id = c.run_id and q.round + 1 = c.round)
select * from d where old is distinct from new"""))
def policy_diff(spark, sf):
    p = view(spark, sf, "v_vectors").groupBy(F.col("task_id").alias("run_id"), (F.col("gen_index") % 5).alias("round")).agg(
        # Rounded like the SQL: scaled first, so a mean a hair under a half still rounds up.
        (F.round(F.avg("answer") * 10) / 10).alias("a"), F.count(F.lit(1)).alias("n"))
    return C.policy_diff(p, ["a", "n"])


@register("feedback_by_next_run", with_sql(("v_feedback", "v_vectors"), STATE_SQL + """
select run_id + 1 as for_round, round(answer_mean, 9) as prev_answer_mean, target_echo as prev_target_echo from st"""))
def feedback_by_next_run(spark, sf):
    fb = C.feedback_summary(view(spark, sf, "v_feedback"), ["run_id"])
    vec = view(spark, sf, "v_vectors").groupBy((F.col("task_id") % 12).alias("run_id")).agg(F.avg("answer").alias("answer_mean"))
    return vec.join(fb, "run_id", "left").select(
        (F.col("run_id") + 1).alias("for_round"), F.round("answer_mean", 9).alias("prev_answer_mean"),
        F.coalesce("target_echo", F.lit(0)).alias("prev_target_echo"))


@register("task_statistics_verified", with_sql("v_vectors", """
with r as (select task_id, avg(case when answer >= 0.4 then 1.0 else 0.0 end) pr, max(reward_scalar) - avg(reward_scalar) regret, avg(case when answer >= 0.4 and grounding >= 0.2 and format_valid then 1.0 else 0.0 end) vr from v_vectors group by 1),
v as (select task_id, pr, regret, task_id % 4 <> 0 as ok, case when task_id % 4 <> 0 then vr else 0 end as vr from r),
k as (select *, case when pr <= 0 then 'too_hard' when pr >= 1 and vr >= 1 then 'mastered' else 'trainable' end as class from v)
select task_id, round(pr, 9) pass_rate, round(regret, 9) regret, ok as gold_certificate_available, round(vr, 9) verified_pass_rate, case when ok then round(1 - vr, 9) end as evidence_gap,
 round(sqrt(vr * (1 - vr)), 7) evidence_std, class, case when not ok then 'unverifiable' when pr >= 1 and class = 'trainable' then 'evidence' when class = 'trainable' then 'spy' end as frontier from k"""))
def task_statistics_verified(spark, sf):
    st = stats.task_statistics_verified(_verified_rollouts(spark, sf), _certificates(spark, sf))
    return st.select("task_id", r9("pass_rate"), r9("regret"), "gold_certificate_available", r9("verified_pass_rate"),
                     r9("evidence_gap"), r9("evidence_std", 7), "class", "frontier")


def _verified_rollouts(spark, sf):
    return view(spark, sf, "v_vectors").select(
        "task_id", "reward_scalar", (F.col("answer") >= 0.4).alias("solved"),
        ((F.col("answer") >= 0.4) & (F.col("grounding") >= 0.2) & F.col("format_valid")).alias("certified"))


def _certificates(spark, sf):
    return view(spark, sf, "v_vectors").select("task_id").distinct().withColumn(
        "gold_certificate_available", F.col("task_id") % 4 != 0)


@register("verified_summary", with_sql("v_vectors", """
with r as (select task_id, avg(case when answer >= 0.4 then 1.0 else 0.0 end) pr, avg(case when answer >= 0.4 and grounding >= 0.2 and format_valid then 1.0 else 0.0 end) vr from v_vectors group by 1),
v as (select pr, task_id % 4 <> 0 as ok, case when task_id % 4 <> 0 then vr else 0 end as vr from r)
select count(*) filter (where ok and pr > 0 and pr < 1) num_spy, count(*) filter (where ok and pr >= 1 and vr < 1) num_evidence, count(*) filter (where not ok) num_unverifiable,
 count(*) filter (where ok) num_certified_tasks, round(avg(case when ok then vr end), 9) mean_verified_pass_rate from v"""))
def verified_summary(spark, sf):
    st = stats.task_statistics_verified(_verified_rollouts(spark, sf), _certificates(spark, sf))
    return stats.verified_summary(st).select("num_spy", "num_evidence", "num_unverifiable", "num_certified_tasks",
                                             r9("mean_verified_pass_rate"))
