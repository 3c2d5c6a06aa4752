"""Queries that rank, sample, allocate and number rows, and score detections."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollscope.operators import curriculum, detection, exports, ranking, skew
from rollscope.plans.catalog import register
from rollscope.plans.queries_stats import ROUTE_SQL, r9, routed
from rollscope.sources.views import view, with_sql


@register("balanced_pick", with_sql("v_tasks", """
with r as (select task_id, count_gold, row_number() over (partition by count_gold order by created, task_id) rn from v_tasks)
select task_id, count_gold from r order by rn, count_gold limit 500"""))
def balanced_pick(spark, sf):
    t = view(spark, sf, "v_tasks")
    return ranking.balanced_pick(t, "count_gold", [F.col("created"), F.col("task_id")], 500).select("task_id", "count_gold")


@register("interleave_kinds", with_sql("v_rollouts", """
with r as (select gen_index, kind, row_number() over (partition by kind order by sha256('9|' || gen_index)) rn,
 case kind when 'view' then 0 when 'click' then 1 when 'purchase' then 2 when 'signup' then 3 else 4 end kp from v_rollouts)
select gen_index, kind, cast(row_number() over (order by rn, kp) as integer) as pos from r qualify pos <= 700"""))
def interleave_kinds(spark, sf):
    pos = F.expr("case kind when 'view' then 0 when 'click' then 1 when 'purchase' then 2 when 'signup' then 3 else 4 end")
    out = ranking.interleave_kinds(view(spark, sf, "v_rollouts"), "kind", pos, [ranking.hash_order(9, "gen_index")], 700)
    return out.select("gen_index", "kind", "pos")


QUOTA_SQL = """
with r as (select gen_index, task_id, kind <> 'error' as accepted, row_number() over (partition by task_id order by gen_index) as judge_pos from v_rollouts),
j as (select *, coalesce(sum(accepted::int) over (partition by task_id order by judge_pos rows between unbounded preceding and 1 preceding), 0) as before from r where judge_pos <= 30),
q as (select gen_index, task_id, accepted, judge_pos from j where before < 20)
"""


def _judged(spark, sf):
    df = view(spark, sf, "v_rollouts").withColumn("accepted", F.col("kind") != "error")
    return ranking.quota_prefix(df, ["task_id"], [F.col("gen_index")], "accepted", 20)


@register("quota_prefix", with_sql("v_rollouts", QUOTA_SQL + "select gen_index, task_id, cast(judge_pos as integer) as judge_pos from q"))
def quota_prefix(spark, sf):
    return _judged(spark, sf).select("gen_index", "task_id", "judge_pos")


@register("judge_accounting", with_sql("v_rollouts", QUOTA_SQL + """
select task_id, count(*) judged, count(*) filter (where accepted) accepted, count(*) filter (where not accepted) rejected, greatest(0, 20 - count(*) filter (where accepted)) shortfall,
 count(*) >= 30 as budget_exhausted, count(*) < 30 and count(*) filter (where accepted) < 20 as pool_exhausted from q group by task_id"""))
def judge_accounting(spark, sf):
    return curriculum.judge_accounting(_judged(spark, sf), ["task_id"], 20, 30)


@register("seeded_shuffle_limit", with_sql("v_rollouts", """
select gen_index, task_id from v_rollouts order by sha256('1701|' || gen_index) limit 200"""))
def seeded_shuffle_limit(spark, sf):
    return ranking.seeded_limit(view(spark, sf, "v_rollouts"), 1701, ["gen_index"], 200).select("gen_index", "task_id")


@register("ordered_output", with_sql("v_rollouts", """
select task_id, gen_index, row_number() over (order by task_id, gen_index) as pos from v_rollouts"""))
def ordered_output(spark, sf):
    return skew.number_rows(view(spark, sf, "v_rollouts").select("task_id", "gen_index"),
                            [F.col("task_id"), F.col("gen_index")], "pos")


SHARD_SQL = "with s as (select task_id, (row_number() over (order by created, task_id) - 1) % 7 as shard, row_number() over (order by created, task_id) as pos from v_tasks) "


def _shards(spark, sf):
    t = view(spark, sf, "v_tasks").select("task_id", "created")
    return skew.number_rows(t, [F.col("created"), F.col("task_id")], "pos").withColumn("shard", F.pmod(F.col("pos") - 1, F.lit(7)))


@register("shard_round_robin", with_sql("v_tasks", SHARD_SQL + "select task_id, shard from s"))
def shard_round_robin(spark, sf):
    return _shards(spark, sf).select("task_id", "shard")


@register("shard_balance", with_sql("v_tasks", SHARD_SQL + "select shard, count(*) as rows_in_shard from s group by 1"))
def shard_balance(spark, sf):
    return _shards(spark, sf).groupBy("shard").agg(F.count(F.lit(1)).alias("rows_in_shard"))


@register("shard_concat", with_sql("v_tasks", SHARD_SQL + "select task_id, row_number() over (order by shard, pos) as out_pos from s"))
def shard_concat(spark, sf):
    return skew.number_rows(_shards(spark, sf), [F.col("shard"), F.col("pos")], "out_pos").select("task_id", "out_pos")


@register("train_val_split", with_sql("v_tasks", """
select task_id, case when ('0x' || substr(sha256('11|' || task_id), 1, 8))::bigint < 429496729 then 'val' else 'train' end as split from v_tasks"""))
def train_val_split(spark, sf):
    h = F.conv(F.substring(ranking.hash_order(11, "task_id"), 1, 8), 16, 10).cast("bigint")
    return view(spark, sf, "v_tasks").select(
        "task_id", F.when(h < int(0.1 * 2 ** 32), F.lit("val")).otherwise(F.lit("train")).alias("split"))


@register("cyclic_repeat", with_sql("v_rollouts", """
with o as (select gen_index, row_number() over (order by sha256('5|' || gen_index)) - 1 as p from v_rollouts),
b as (select gen_index, p // 64 as batch_id, p % 64 as slot from o where p < (select count(*) // 64 * 64 from v_rollouts))
select gen_index, batch_id, c.cycle, m.rep as repeat, (batch_id * 2 + c.cycle) * 64 * 3 + slot * 3 + m.rep as pos from b cross join (values (0), (1)) c(cycle) cross join (values (0), (1), (2)) m(rep)"""))
def cyclic_repeat(spark, sf):
    out = ranking.cyclic_repeat(view(spark, sf, "v_rollouts").select("gen_index"), "gen_index", 4, 1, 64, 2, 3)
    return out.select("gen_index", "batch_id", "cycle", "repeat", "pos")


# Runs of one share of the tasks each, with their own shares, with shares that add up to more, and to less.
MIX = """select scene_id % 97 as run_id, count(*) as total, case scene_id % 97 % 3 when 0 then count(case when difficulty = 'easy' then 1 end) / count(*)
 when 1 then 0.75e0 else 0.05e0 end as easy, case scene_id % 97 % 3 when 0 then count(case when difficulty = 'medium' then 1 end) / count(*)
 when 1 then 0.02e0 else 0.15e0 end as medium, case scene_id % 97 % 3 when 0 then count(case when difficulty = 'hard' then 1 end) / count(*)
 when 1 then 0.75e0 else 0.05e0 end as hard from v_tasks group by scene_id % 97"""


@register("difficulty_allocation", with_sql("v_tasks", f"""
with m as ({MIX}), b as (select run_id, total, unnest([1, 2, 3]) as i, unnest([easy, medium, hard]) as share from m),
r as (select *, round_even(share * total, 0)::bigint as n, row_number() over (partition by run_id order by share desc, i) - 1 as pos from b),
d as (select *, total - sum(n) over (partition by run_id) as drift from r),
-- one unit of surplus after the other, counted by how often each bucket is visited
v as (select d.*, row_number() over (partition by run_id order by u, pos) as turn from d join range(1, 100000) t(u) on drift < 0 and u <= n),
t as (select run_id, i, count(*) as taken from v where turn <= -drift group by 1, 2)
select run_id, total, max(case when i = 1 then g end)::bigint n_easy, max(case when i = 2 then g end)::bigint n_medium, max(case when i = 3 then g end)::bigint n_hard
from (select run_id, total, i, n + case when drift > 0 then drift // 3 + (pos < drift % 3)::int else 0 end - coalesce(taken, 0) as g from d left join t using (run_id, i)) group by 1, 2"""))
def difficulty_allocation(spark, sf):
    view(spark, sf, "v_tasks").createOrReplaceTempView("v_tasks")
    out = ranking.difficulty_allocation(spark.sql(MIX), "total", ["easy", "medium", "hard"])
    return out.select("run_id", "total", "n_easy", "n_medium", "n_hard")


@register("dedup_claim", """
with u as (select c_nationkey, c_custkey, c_acctbal from customer where c_acctbal > 0)
select c_nationkey, min(c_custkey) as c_custkey from u group by 1""")
def dedup_claim(spark, sf):
    usable = view(spark, sf, "customer").filter("c_acctbal > 0")
    return skew.top_one(usable, ["c_nationkey"], F.col("c_custkey"), biggest=False).select("c_nationkey", "c_custkey")


@register("latest_artifact", """
select user_id, event_type, event_id from events qualify row_number() over (partition by user_id, event_type order by ts desc, event_id desc) = 1""")
def latest_artifact(spark, sf):
    return view(spark, sf, "events").groupBy("user_id", "event_type").agg(
        F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@register("union_replays", with_sql("v_vectors", ROUTE_SQL + """
select gen_index, 'positive' as source_buffer from buffered where buffer = 'positive' union all select gen_index, 'unused' from buffered where buffer = 'failure' and answer >= 1"""))
def union_replays(spark, sf):
    r = routed(spark, sf)
    return exports.union_replays({
        "positive": r.filter("buffer = 'positive'").select("gen_index", "task_id"),
        "unused": r.filter("buffer = 'failure' and answer >= 1").select("gen_index"),
    }).select("gen_index", "source_buffer")


DETS = ("vec_id as det_id", "vec_id % 10 as image_id", "cast(label as bigint) as category", "(vec_id * 37 % 101) / 100.0e0 as score", "vec_id % 3 <> 0 as hit")
PR_SQL = "with d as (select " + ", ".join(DETS) + """ from embeddings), n as (select category, count(*) as positives from d group by 1),
c as (select d.*, sum(hit::int) over w as tp, sum((not hit)::int) over w as fp from d window w as (partition by category order by score desc, det_id rows unbounded preceding)),
r as (select c.*, tp / positives as recall, tp / (tp + fp) as precision from c join n on c.category = n.category)
"""


@register("pr_curve", PR_SQL + """
select det_id, category, cast(tp as bigint) tp, cast(fp as bigint) fp, round(recall, 9) recall, round(precision, 9) as precision,
 round(max(precision) over (partition by category order by score desc, det_id rows between current row and unbounded following), 9) as envelope from r""")
def pr_curve(spark, sf):
    d = view(spark, sf, "embeddings").selectExpr(*DETS)
    pos = d.groupBy("category").agg(F.count(F.lit(1)).alias("positives"))
    out = detection.pr_curve(d, ["category"], pos, [F.col("score").desc(), F.col("det_id").asc()])
    return out.select("det_id", "category", "tp", "fp", r9("recall"), r9("precision"), r9("envelope"))


@register("top_detections", "with d as (select " + ", ".join(DETS) + """ from embeddings)
select det_id, image_id, category, cast(row_number() over (partition by image_id, category order by score desc, det_id) as integer) as det_rank from d qualify det_rank <= 2""")
def top_detections(spark, sf):
    d = view(spark, sf, "embeddings").selectExpr(*DETS)
    return detection.top_detections(d, ["image_id", "category"], 2).select("det_id", "image_id", "category", "det_rank")


def det_boxes(spark, sf):
    return view(spark, sf, "embeddings").selectExpr(
        *DETS[:4], "array(double(vec_id * 7 % 200 + vec_id % 5), double(vec_id * 3 % 150), double(20 + vec_id * 11 % 120), "
        "double(20 + vec_id * 5 % 110)) as box")


def gold_boxes(spark, sf):
    return view(spark, sf, "embeddings").selectExpr(
        "vec_id as gold_id", "vec_id % 10 as image_id", "cast(label as bigint) as category", "vec_id % 23 = 0 as iscrowd",
        "if(vec_id % 4 = 0, null, double(vec_id * 13 % 12000)) as area",
        "array(double(vec_id * 7 % 200), double(vec_id * 3 % 150 + vec_id % 4), double(20 + vec_id * 11 % 120), "
        "double(20 + vec_id * 5 % 110)) as box")


BOX_SQL = """
d0 as (select vec_id as det_id, vec_id % 10 as image_id, cast(label as bigint) as category, (vec_id * 37 % 101) / 100.0e0 as score,
 (vec_id * 7 % 200 + vec_id % 5)::double x, (vec_id * 3 % 150)::double y, (20 + vec_id * 11 % 120)::double w, (20 + vec_id * 5 % 110)::double h from embeddings),
g0 as (select vec_id as gold_id, vec_id % 10 as image_id, cast(label as bigint) as category, vec_id % 23 = 0 as iscrowd,
 (vec_id * 7 % 200)::double x, (vec_id * 3 % 150 + vec_id % 4)::double y, (20 + vec_id * 11 % 120)::double w, (20 + vec_id * 5 % 110)::double h,
 case when vec_id % 4 = 0 then null else (vec_id * 13 % 12000)::double end as own_area from embeddings)
"""
AREA_ROWS = "(values " + ", ".join(f"('{a}', {lo}::double, {hi}::double)" for a, (lo, hi) in detection.AREAS.items()) + ") ar(area, lo, hi)"
THR_ROWS = "(values " + ", ".join(f"({t}::double)" for t in detection.THRESHOLDS) + ") th(thr)"


def match_sql(det: str, gold: str, key: str, areas: str) -> str:
    """Detections of a key one after the other, each taking its best free box: `walk` of a recursive query."""
    same = " and ".join(f"{{0}}.{k} = {{1}}.{k}" for k in key.split(", "))
    on = lambda x, y: same.format(x, y)
    cols = lambda t: ", ".join(f"{t}.{k}" for k in key.split(", "))
    inter = "greatest(0.0, least(d.x + d.w, g.x + g.w) - greatest(d.x, g.x)) * greatest(0.0, least(d.y + d.h, g.y + g.h) - greatest(d.y, g.y))"
    return f"""
rk as (select *, row_number() over (partition by {key} order by score desc, det_id) as r from {det} qualify r <= 100),
pr as (select d.det_id, g.gold_id, g.iscrowd, coalesce(g.own_area, g.w * g.h) as garea, {inter} as i,
 case when g.iscrowd then d.w * d.h else d.w * d.h + g.w * g.h - {inter} end as u from rk d join {gold} g on {on('d', 'g')}),
cd as (select det_id, area, list(struct_pack(counts := not iscrowd and garea between lo and hi, iou := i / u, gold_id := gold_id, crowd := iscrowd)
 order by not iscrowd and garea between lo and hi desc, i / u desc, gold_id desc) as cands from pr, {areas} where u > 0 and i / u >= 0.5 group by 1, 2),
st as (select rk.*, area, lo, hi, thr, coalesce(cands, []) as cands from rk cross join {areas} cross join {THR_ROWS} left join cd using (det_id, area)),
walk as (select {cols('k')}, area, lo, hi, thr, 0::bigint as r, null::bigint as det_id, null::double as score, []::bigint[] as used, false as matched, false as ignored
  from (select distinct {key} from rk) k cross join {areas} cross join {THR_ROWS}
 union all
 select {cols('f')}, area, lo, hi, thr, r, det_id, score, case when best is null then used else list_append(used, best.gold_id) end,
  best is not null, case when best is null then size < lo or size > hi else not best.counts end
 from (select {cols('w')}, w.area, w.lo, w.hi, w.thr, s.r, s.det_id, s.score, s.w * s.h as size, w.used, list_filter(s.cands,
   lambda c: c.iou >= least(w.thr, 1 - 1e-10) and (c.crowd or not list_contains(w.used, c.gold_id)))[1] as best
  from walk w join st s on {on('w', 's')} and w.area = s.area and w.thr = s.thr and s.r = w.r + 1) f)
"""


def ap_sql(source: str, positives: str, keys: str) -> str:
    """AP on 101 recall points and final recall: `ap` over scored rows of `source`, with `positives(keys, positives)`."""
    return f"""
ct as (select *, sum(matched::int) over o as tp, sum((not matched)::int) over o as fp from {source} where not ignored
 window o as (partition by {keys} order by score desc, image_id, r rows unbounded preceding)),
cv as (select ct.*, tp / positives as rc, tp / (tp + fp) as p from ct join {positives} using (POSKEYS) where positives > 0),
ce as (select {keys}, floor(rc * 100 + 1e-9) as g, max(p) as p, max(rc) as rc from cv group by all),
gp as (select {keys}, n.g, coalesce(max(p) filter (where ce.g >= n.g), 0) as p, max(rc) as rc from ce cross join range(0, 101) n(g) group by all),
ap as (select {keys}, sum(p) / 101 as ap, max(rc) as recall from gp group by all)
"""


MATCH_SQL = "with recursive " + BOX_SQL.strip() + ", " + match_sql("d0", "g0", "image_id, category", AREA_ROWS).strip()


@register("coco_match", MATCH_SQL + " select image_id, category, area, thr, det_id, matched, ignored from walk where r > 0")
def coco_match(spark, sf):
    m = detection.coco_match(det_boxes(spark, sf), gold_boxes(spark, sf), ["image_id", "category"])
    return m.select("image_id", "category", "area", "thr", "det_id", "matched", "ignored")


def _summary_sql() -> str:
    top, whole = "max_dets = 100", "area = 'all'"
    cells = [("AP", "ap", f"{top} and {whole}"), ("AP50", "ap", f"{top} and {whole} and thr = 0.5"), ("AP75", "ap", f"{top} and {whole} and thr = 0.75")]
    cells += [(f"AP_{a}", "ap", f"{top} and area = '{a}'") for a in ("small", "medium", "large")]
    cells += [(f"AR{m}", "recall", f"max_dets = {m} and {whole}") for m in detection.MAX_DETS]
    cells += [(f"AR_{a}", "recall", f"{top} and area = '{a}'") for a in ("small", "medium", "large")]
    return " union all ".join(f"select '{n}' as metric, round(coalesce(avg({c}) filter (where {w}), -1), 9) as value from fl" for n, c, w in cells)


@register("coco_ap_ar", MATCH_SQL + ", tg as (select w.*, md as max_dets from walk w cross join (values (1), (10), (100)) v(md) "
          "where r > 0 and r <= md and (md = 100 or area = 'all')), "
          f"ps as (select category, area, count(*) filter (where not iscrowd and coalesce(own_area, w * h) between lo and hi) as positives from g0 cross join {AREA_ROWS} group by 1, 2), "
          + ap_sql("tg", "ps", "category, area, thr, max_dets").replace("POSKEYS", "category, area").strip()
          + f""", fl as (select category, area, thr, max_dets, coalesce(ap, 0) as ap, coalesce(recall, 0) as recall from ps cross join {THR_ROWS} cross join (values (1), (10), (100)) v(max_dets)
 left join ap using (category, area, thr, max_dets) where positives > 0 and (max_dets = 100 or area = 'all')) """ + _summary_sql())
def coco_ap_ar(spark, sf):
    gold = gold_boxes(spark, sf)
    m = detection.coco_match(det_boxes(spark, sf), gold, ["image_id", "category"])
    return detection.coco_summary(m, gold).select("metric", r9("value"))


# Records 0-39: some have boxes on one side only, 40-41 have none.
RECORD_SQL = BOX_SQL.strip() + """,
rd as (select * exclude (image_id, score), 0 as image_id, 1.0::double as score, det_id % 40 as record_id from d0 where det_id % 40 <> 3),
rg as (select * exclude (image_id, iscrowd, own_area), false as iscrowd, w * h as own_area, gold_id % 40 as record_id from g0 where gold_id % 40 not in (5, 6)),
rw as (select * from rd where exists (select 1 from rg where rg.record_id = rd.record_id and rg.category = rd.category))
"""


@register("record_map", "with recursive " + RECORD_SQL.strip() + ", " + match_sql("rw", "rg", "record_id, category", "(values ('all', 0::double, 1e10::double)) ar(area, lo, hi)").strip()
          + ", wi as (select *, 0 as image_id from walk where r > 0), ps as (select record_id, category, count(*) as positives from rg group by 1, 2), "
          + ap_sql("wi", "ps", "record_id, category, thr").replace("POSKEYS", "record_id, category").strip()
          + f""", fl as (select record_id, thr, coalesce(ap, 0) as ap from ps cross join {THR_ROWS} left join ap using (record_id, category, thr)),
sc as (select record_id, avg(ap) as map, avg(ap) filter (where thr = 0.5) as map50 from fl group by 1),
sz as (select record_id, sum(g) as g, sum(p) as p from (select record_id, 1 as g, 0 as p from rg union all select record_id, 0, 1 from rd
 union all select unnest(range(0, 42)), 0, 0) group by 1)
select record_id, round(case when g = 0 and p = 0 then 1 else coalesce(map, 0) end, 9) as map, round(case when g = 0 and p = 0 then 1 else coalesce(map50, 0) end, 9) as map50,
 round(case when g = 0 and p = 0 then 1 else coalesce(map, 0) end * case when g >= p then 1 else g / p end, 9) as map_length from sz left join sc using (record_id)""")
def record_map(spark, sf):
    d = det_boxes(spark, sf).withColumn("score", F.lit(1.0)).withColumn("record_id", F.col("det_id") % 40).filter("record_id <> 3")
    g = gold_boxes(spark, sf).drop("area").withColumn("record_id", F.col("gold_id") % 40).withColumn("iscrowd", F.lit(False)).filter(
        "record_id not in (5, 6)")
    out = detection.record_map(d, g, "record_id", "category", spark.range(42).withColumnRenamed("id", "record_id"))
    return out.select("record_id", r9("map"), r9("map50"), r9("map_length"))


LABELLED = ("vec_id", "array(named_struct('bbox_2d', array(double(vec_id % 90), 10D, double(vec_id % 90 + 50), 60D), 'label', string(label)), "
            "named_struct('bbox_2d', array(200D, 10D, 240D, 60D), 'label', 'x')) as gold",
            "if(vec_id % 9 = 0, array(), array(named_struct('bbox_2d', array(double(vec_id % 90 + vec_id % 20), 10D, double(vec_id % 90 + 50 + vec_id % 20), 60D), "
            "'label', if(vec_id % 4 = 0, 'Y', string(label))))) as pred")
LABEL_SQL = """
with b as (select vec_id, vec_id % 20 as dx, vec_id % 4 <> 0 as same, vec_id % 9 = 0 as none from embeddings),
i as (select *, (50 - dx) * 50.0 as inter from b), o as (select *, inter / (2 * 2500 - inter) as iou from i),
m as (select vec_id, none, case when not none and iou >= 0.5 then 1 else 0 end as matched, case when not none and same and iou >= 0.5 then iou else 0 end as position,
 case when not none and same and iou >= 0.5 then 1 else 0 end as right_labels from o)
"""


def _labelled(spark, sf):
    df = view(spark, sf, "embeddings").selectExpr(*LABELLED[:2], LABELLED[2].replace(
        "array()", "cast(array() as array<struct<bbox_2d:array<double>,label:string>>)"))
    return df.select("*", detection.detect_match_label(F.col("gold"), F.col("pred")).alias("m"))


@register("detect_match_label", LABEL_SQL + "select vec_id, cast(matched as integer) as matches, cast(right_labels as integer) as right_labels, round(position, 9) as position from m")
def detect_match_label(spark, sf):
    return _labelled(spark, sf).select("vec_id", F.col("m.matches").alias("matches"), F.col("m.right_labels").alias("right_labels"),
                                       F.round("m.position", 9).alias("position"))


@register("detection_composite", LABEL_SQL + """
select vec_id, round(case when none then 0 else 0.7 * position / 2 + 0.3 * (1 - ((2 - matched) / 2 + (1 - matched)) / 2) end, 9) as score from m""")
def detection_composite(spark, sf):
    df = _labelled(spark, sf)
    return df.select("vec_id", F.round(detection.detection_composite(F.col("m"), F.size("gold"), F.size("pred")), 9).alias("score"))


@register("coco_filter", "with d as (select " + ", ".join(DETS) + """ from embeddings)
select det_id, image_id in (select image_id from d where category in (1, 2, 3) group by 1 having count(distinct category) = 3) as has_all from d
where category in (1, 2, 3) and image_id in (0, 1, 2, 3, 4, 5, 6, 7) and det_id % 23 <> 0 and (20 + det_id * 11 % 120) * (20 + det_id * 5 % 110) between 1025 and 9215""")
def coco_filter(spark, sf):
    ann = gold_boxes(spark, sf)
    kept = detection.coco_filter(ann, categories=[1, 2, 3], images=list(range(8)), area=(1024.0, 9216.0), crowd=False)
    whole = detection.images_with_all(ann, [1, 2, 3]).withColumn("has_all", F.lit(True))
    return kept.join(whole, "image_id", "left").select(F.col("gold_id").alias("det_id"), F.coalesce("has_all", F.lit(False)).alias("has_all"))


@register("coco_results", "with d as (select " + ", ".join(DETS) + """ from embeddings), r as (select *, (20 + det_id * 11 % 120) * (20 + det_id * 5 % 110) as area from d)
select image_id, count(*) as dets, min(case when id_ok then 1 else 0 end) as ids_ok, cast(sum(area) as double) as area from (select *, true as id_ok from r) group by 1""")
def coco_results(spark, sf):
    res = det_boxes(spark, sf).select("image_id", "category", "score", "box")
    images = gold_boxes(spark, sf).select("image_id").distinct()
    out = detection.load_results(res, images)
    return out.groupBy("image_id").agg(F.count(F.lit(1)).alias("dets"), F.min((F.col("det_id") >= 1).cast("int")).alias("ids_ok"),
                                       F.sum("area").alias("area"))


# Annotation and result documents of 40 images: doc 0 has boxes as results, 1 polygons (a triangle and a square), 2 key points.
COCO_DOC_SQL = """
with e as (select vec_id, vec_id % 3 as doc, vec_id // 3 as nr, cast(label as bigint) as category, vec_id % 40 as image, vec_id % 200 + 0.5e0 as x, vec_id * 3 % 150 as y, 20 + vec_id * 11 % 120 as w, 20 + vec_id * 5 % 110 as h from embeddings),
im as (select distinct doc, image from e),
ids as (select *, nr // 2 as id, row_number() over (partition by doc, nr // 2 order by vec_id desc) as back from e),
res as (select *, row_number() over (partition by doc order by vec_id) as pos from e)
select 'annotation' as part, doc, id, image as image_id, category, null as kind, cast(x as double) as x, cast(y as double) as y, cast(w as double) as w, cast(h as double) as h, cast(w * h as double) as area from ids where back = 1
union all select 'image', doc, image, image, null, null, null, null, 320, 240, null from im
union all select 'category', doc, category, null, category, 'c' || category, null, null, null, null, count(*) from e group by doc, category
union all select 'result', doc, pos, image, category, ['box', 'polygon', 'points'][doc + 1], x, y, w, h, case doc when 1 then w * h / 2.0 + 4 else w * h end from res"""


@register("coco_tables", COCO_DOC_SQL)
def coco_tables(spark, sf):
    e = view(spark, sf, "embeddings").selectExpr(
        "vec_id", "vec_id % 3 as doc", "(vec_id div 3) div 2 as id", "cast(label as bigint) as category", "vec_id % 40 as image",
        "vec_id % 200 + 0.5D as x", "double(vec_id * 3 % 150) as y", "double(20 + vec_id * 11 % 120) as w", "double(20 + vec_id * 5 % 110) as h")
    # Every id is written twice; the second entry counts. The polygon's square lies inside the box of its triangle.
    listed = e.groupBy("doc").agg(
        F.expr("transform(array_sort(collect_list(struct(vec_id, id, image as image_id, category as category_id, array(x, y, w, h) as bbox, w * h as area, 0 as iscrowd))), "
               "a -> struct(a.id, a.image_id, a.category_id, a.bbox, a.area, a.iscrowd))").alias("annotations"),
        F.expr("transform(array_sort(collect_set(image)), i -> struct(i as id, 320 as width, 240 as height, concat(i, '.png') as file_name))").alias("images"),
        F.expr("transform(array_sort(collect_set(category)), c -> struct(c as id, concat('c', c) as name))").alias("categories"))
    docs = listed.select("doc", F.to_json(F.struct("annotations", "images", "categories")).alias("body"))
    shape = F.expr("struct(vec_id, image as image_id, category as category_id, 0.5D as score, if(doc = 0, array(x, y, w, h), null) as bbox, "
                   "if(doc = 1, array(array(x, y, x + w, y, x, y + h), array(x + 1, y + 1, x + 3, y + 1, x + 3, y + 3, x + 1, y + 3)), null) as segmentation, "
                   "if(doc = 2, array(x, y, 2, x + w, y + h, 1, x + w / 2, y, 0), null) as keypoints)")
    results = e.select("doc", shape.alias("r")).groupBy("doc").agg(F.to_json(F.array_sort(F.collect_list("r"))).alias("body"))
    t = detection.coco_tables(docs)
    none = lambda kind: F.lit(None).cast(kind)
    box = lambda c: [F.col(c)[i].alias(n) for i, n in enumerate("xywh")]
    ann = t["annotations"].select(F.lit("annotation").alias("part"), "doc", "id", "image_id", F.col("category_id").alias("category"),
                                  none("string").alias("kind"), *box("bbox"), "area")
    images = t["images"].select(F.lit("image").alias("part"), "doc", "id", F.col("id").alias("image_id"), none("bigint").alias("category"),
                                none("string").alias("kind"), none("double").alias("x"), none("double").alias("y"),
                                F.col("width").cast("double").alias("w"), F.col("height").cast("double").alias("h"), none("double").alias("area"))
    per = t["category_images"].groupBy("doc", F.col("category_id").alias("id")).agg(F.count(F.lit(1)).cast("double").alias("area"))
    cats = t["categories"].join(per, ["doc", "id"], "left").select(
        F.lit("category").alias("part"), "doc", "id", none("bigint").alias("image_id"), F.col("id").alias("category"), F.col("name").alias("kind"),
        *[none("double").alias(n) for n in "xywh"], "area")
    found = detection.result_tables(results, t["images"]).select(
        F.lit("result").alias("part"), "doc", "id", "image_id", "category", "kind", *box("box"), "area")
    return ann.unionByName(images).unionByName(cats).unionByName(found)


@register("oks_match", """
with p as (select vec_id, vec_id % 7 as dx, vec_id % 5 as dy, vec_id % 3 = 0 as hidden, 400.0 + vec_id as area from embeddings)
select vec_id, round(case when hidden then (2 + exp(-pow(greatest(0.0, 10 + dx - 60), 2) / 0.04 / area / 2)) / 3
 else (exp(-(dx * dx + dy * dy) / 0.01 / area / 2) + exp(-(dx * dx) / 0.0225 / area / 2)) / 2 end, 9) as oks from p""")
def oks_match(spark, sf):
    p = view(spark, sf, "embeddings").selectExpr(
        "vec_id", "array(array(10D, 10D), array(20D, 20D), array(30D, 30D)) as g",
        "array(array(10D + vec_id % 7, 10D + vec_id % 5), array(20D + vec_id % 7, 20D), array(30D, 30D)) as p",
        "if(vec_id % 3 = 0, array(0, 0, 0), array(2, 1, 0)) as v", "400D + vec_id as area", "array(0D, 0D, 40D, 40D) as b")
    sim = detection.oks(F.col("g"), F.col("p"), F.col("v"), [0.05, 0.075, 0.1], F.col("area"), F.col("b"))
    return p.select("vec_id", F.round(sim, 9).alias("oks"))
