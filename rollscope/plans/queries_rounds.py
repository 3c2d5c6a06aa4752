"""Queries over the rounds of a run: the five-section report and the state of the round before."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollscope.operators import curriculum, rounds, scenes
from rollscope.plans.catalog import register
from rollscope.plans.queries_stats import r9
from rollscope.sources.views import view, with_sql

REPORT_SQL = """
with s as (select *, gen_index % 6 as round, gen_index % 4 <> 0 as bbox_valid, (gen_index % 9) / 8.0e0 as iou, gen_index % 5 as num_boxes, gen_index % 3 = 0 as ok,
 case when gen_index % 10 = 9 then null else count_pred end as said from v_rollouts),
md as (select round, said, count(*) c from s where said is not null group by 1, 2 qualify row_number() over (partition by round order by count(*) desc, said) = 1),
ans as (select s.round, count(*) n, avg(coalesce(spy_pred = spy_gold, false)::int) spy_acc, avg(coalesce(said = count_gold, false)::int) count_acc, count(*) filter (where said is null) parse_failed,
 avg(bbox_valid::int) bv, avg(case when bbox_valid then iou end) iv, avg(num_boxes) nb from s group by 1),
st as (select round, task_id, avg(ok::int) pr, avg(reward_scalar) mr, max(reward_scalar) xr, stddev_pop(reward_scalar) sd from s group by 1, 2),
sv as (select round, count(*) num_tasks, avg(pr) solve, avg(xr - mr) regret, avg((round(sd, 4) <= 0.02)::int) acr, count(*) filter (where pr <= 0) hard, count(*) filter (where pr >= 1) done from st group by 1),
tm as (select round, task_id, said from s where said is not null group by 1, 2, 3 qualify row_number() over (partition by round, task_id order by count(*) desc, said) = 1),
ts as (select distinct round, task_id, task_id // 2 as pair from s where task_id % 13 <> 0 and (task_id // 2) % 5 <> 0),
pp as (select a.round, x.said as small, y.said as large from ts a join ts b on a.round = b.round and a.pair = b.pair and a.task_id % 2 = 0 and b.task_id % 2 = 1
 join tm x on x.round = a.round and x.task_id = a.task_id join tm y on y.round = b.round and y.task_id = b.task_id),
pc as (select round, count(*) num_pairs, avg((small <> large)::int) moved from pp group by 1),
pr as (select proposal_id % 5 as round, count(*) num_proposals, count(distinct mask) kept, sum(case when proposal_id % 7 <> 0 then (proposal_id % 4) / 3.0e0 end) / count(*) filter (where proposal_id % 7 <> 0) as learn from v_proposals group by 1),
rec as (select task_id % 6 as round, count(*) num_tasks, avg(answer) solve from v_vectors where task_id % 6 in (1, 4) group by 1)
select ans.round, ans.n, md.said as mode, round(md.c / ans.n, 9) mode_share, round(spy_acc, 9) spy_acc, round(count_acc, 9) count_acc, parse_failed, round(bv, 9) bbox_valid_rate, round(iv, 9) mean_iou_given_valid,
 round(nb, 9) mean_pred_boxes, case when rec.round is null then 'computed' else 'recorded' end as solvability_source, coalesce(rec.num_tasks, sv.num_tasks) num_tasks, round(coalesce(rec.solve, sv.solve), 9) mean_solve_rate,
 case when rec.round is null then round(sv.regret, 8) end as mean_regret, case when rec.round is null then round(sv.acr, 9) end as advantage_collapse_rate, case when rec.round is null then sv.hard end as num_too_hard, case when rec.round is null then sv.done end as num_mastered,
 coalesce(num_pairs, 0) num_pairs, round(moved, 9) sensitivity, coalesce(num_proposals, 0) num_proposals, coalesce(kept, 0) distinct_subsets, round(learn, 9) mean_learnability
from ans join md on md.round = ans.round join sv on sv.round = ans.round left join pc on pc.round = ans.round left join pr on pr.round = ans.round left join rec on rec.round = ans.round"""


@register("round_report", with_sql(("v_rollouts", "v_proposals", "v_vectors"), REPORT_SQL))
def round_report(spark, sf):
    scored = view(spark, sf, "v_rollouts").withColumns({
        "round": F.expr("gen_index % 6"), "bbox_valid": F.expr("gen_index % 4 <> 0"), "iou": F.expr("(gen_index % 9) / 8.0D"),
        "num_boxes": F.expr("gen_index % 5"), "solved": F.expr("gen_index % 3 = 0"),
        "count_pred": F.expr("if(gen_index % 10 = 9, null, count_pred)")})
    # Every fifth pair's large side is no superset; every thirteenth task was accepted twice and proves nothing.
    tasks = scored.select("round", "task_id").distinct().selectExpr(
        "round", "task_id", "concat('p', cast(task_id div 2 as string)) as pair_id", "if(task_id % 2 = 0, 'small', 'large') as pair_role",
        "task_id div 2 as scene_id", "4 as num_players", "1 as spy_player",
        "if(task_id % 2 = 0, array(0), if((task_id div 2) % 5 = 0, array(1, 2), array(0, 1))) as keep")
    tasks = tasks.unionByName(tasks.filter("task_id % 13 = 0"))
    proposals = view(spark, sf, "v_proposals").selectExpr(
        "proposal_id % 5 as round", "mask", "proposal_id % 7 <> 0 as reached", "(proposal_id % 4) / 3.0D as learnability",
        "'trainable' as solver_class").withColumn("keep", scenes.mask_members(F.col("mask"), 5))
    recorded = view(spark, sf, "v_vectors").filter("task_id % 6 in (1, 4)").groupBy(F.expr("task_id % 6").alias("round")).agg(
        F.count(F.lit(1)).alias("num_tasks"), F.avg("answer").alias("mean_solve_rate"))
    for c, kind in (("mean_regret", "double"), ("advantage_collapse_rate", "double"), ("num_too_hard", "bigint"),
                    ("num_trainable", "bigint"), ("num_mastered", "bigint")):
        recorded = recorded.withColumn(c, F.lit(None).cast(kind))
    out = rounds.round_report(scored, tasks, proposals, recorded=recorded)
    return out.select("round", "n", "mode", r9("mode_share"), r9("spy_acc"), r9("count_acc"), "parse_failed", r9("bbox_valid_rate"),
                      r9("mean_iou_given_valid"), r9("mean_pred_boxes"), "solvability_source", "num_tasks", r9("mean_solve_rate"),
                      r9("mean_regret", 8), r9("advantage_collapse_rate"), "num_too_hard", "num_mastered", "num_pairs", r9("sensitivity"),
                      "num_proposals", "distinct_subsets", r9("mean_learnability"))


FEEDBACK_SQL = """
with v as (select task_id % 12 as run_id, gen_index % 7 as round, answer from v_vectors),
r as (select run_id, round, lag(round) over (partition by run_id order by round) as prev_round from (select distinct run_id, round from v where (run_id * 7 + round) % 5 <> 3)),
p as (select run_id, round, avg(answer) as a from v where (run_id + round) % 4 <> 0 group by 1, 2),
f as (select run_id, task_id % 7 as round, count(*) as judged, count(*) filter (where not accepted) as rejected from v_feedback where judged group by 1, 2)
select r.run_id, r.round, r.prev_round, p.run_id is not null as has_policy, round(p.a, 9) as policy_answer_mean, f.run_id is not null as has_feedback, f.judged as feedback_num_judged,
 f.rejected as feedback_num_rejected, p.run_id is not null or f.run_id is not null as read_prev
from r left join p on p.run_id = r.run_id and p.round = r.prev_round left join f on f.run_id = r.run_id and f.round = r.prev_round"""


@register("round_feedback", with_sql(("v_vectors", "v_feedback"), FEEDBACK_SQL))
def round_feedback(spark, sf):
    rows = view(spark, sf, "v_vectors").selectExpr("task_id % 12 as run_id", "gen_index % 7 as round", "answer")
    policy = rows.filter("(run_id + round) % 4 <> 0").groupBy("run_id", "round").agg(F.avg("answer").alias("answer_mean"))
    feedback = curriculum.feedback_summary(view(spark, sf, "v_feedback").withColumn("round", F.expr("task_id % 7")), ["run_id", "round"])
    out = rounds.state_before(rows.filter("(run_id * 7 + round) % 5 <> 3"), {"policy": policy, "feedback": feedback})
    return out.select("run_id", "round", "prev_round", "has_policy", r9("policy_answer_mean"), "has_feedback", "feedback_num_judged",
                      "feedback_num_rejected", "read_prev")
