"""Queries that compare tables: completeness, conflicts, grids, averages, fingerprints, typed contexts."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollscope.operators import checks, exports
from rollscope.plans.catalog import register
from rollscope.plans.queries_stats import ROUTE_SQL, r9, routed
from rollscope.sources.views import view, with_sql


@register("prediction_completeness", """
select (select count(*) from documents) as expected, (select count(*) from labels) as actual, (select count(*) from documents where doc_id not in (select doc_id from labels)) as missing,
 (select count(*) from labels where doc_id not in (select doc_id from documents)) as extra, (select count(*) from (select doc_id from labels group by 1 having count(*) > 1)) as duplicates,
 (select count(*) from documents where doc_id not in (select doc_id from labels)) = 0 as complete""")
def prediction_completeness(spark, sf):
    return checks.prediction_completeness(view(spark, sf, "documents").select("doc_id"), view(spark, sf, "labels").select("doc_id"), "doc_id")


@register("index_difference", """
select o_orderkey as k, 'missing' as side from orders where o_orderkey not in (select l_orderkey from lineitem) union all
select distinct l_orderkey, 'extra' from lineitem where l_orderkey not in (select o_orderkey from orders)""")
def index_difference(spark, sf):
    e = view(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    return checks.index_difference(e, view(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k")), "k")


@register("rollout_completeness", """
with c as (select l_orderkey as k, count(*) n from lineitem group by 1)
select coalesce(o.o_orderkey, c.k) as k, coalesce(c.n, 0) as actual, case when o.o_orderkey is null then 'stray' else 'incomplete' end as problem
from orders o full outer join c on o.o_orderkey = c.k where o.o_orderkey is null or coalesce(c.n, 0) <> 4""")
def rollout_completeness(spark, sf):
    t = view(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    return checks.rollout_completeness(t, view(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k")), "k", 4)


@register("prediction_bad_rows", """
with p as (select l_orderkey as idx, case when l_linenumber = 3 then 'x Failed to obtain answer' when l_linenumber = 5 then '  ' else l_returnflag end as pred from lineitem)
select idx, count(*) n, count(*) filter (where contains(pred, 'Failed to obtain answer')) failed, count(*) filter (where trim(pred) = '') empty from p group by 1
having count(*) > 1 or count(*) filter (where contains(pred, 'Failed to obtain answer')) > 0 or count(*) filter (where trim(pred) = '') > 0""")
def prediction_bad_rows(spark, sf):
    p = view(spark, sf, "lineitem").selectExpr(
        "l_orderkey as idx", "case when l_linenumber = 3 then 'x Failed to obtain answer' when l_linenumber = 5 then '  ' else l_returnflag end as pred")
    return checks.prediction_bad_rows(p, "idx", "pred")


# Model = supplier nation, benchmark = part type class; a score file is one line item.
BENCH = ("MMVP", "MMStar", "BLINK", "ChartQA_TEST")
CELLS = ("l_suppkey % 12 as model", "case l_partkey % 4 when 0 then 'MMVP' when 1 then 'MMStar' when 2 then 'BLINK' else 'ChartQA_TEST' end as benchmark",
         "case when l_linenumber > 6 then 'n/a' when l_suppkey % 12 = 5 and l_quantity > 49 then '1.5' else concat(cast((l_suppkey % 12) / 16.0e0 as string), "
         "case when l_suppkey % 12 = 3 then '%' else '' end) end as raw")
CELLS_SQL = "with c0 as (select " + ", ".join(CELLS) + """ from lineitem), c1 as (select *, raw like '%\\%' escape '\\' as pctd, try_cast(rtrim(raw, '%') as double) as v from c0),
cells as (select model, benchmark, raw, case when v is null or v < 0 then null when benchmark <> 'ChartQA_TEST' and not pctd then case when v <= 1 then v * 100 end when v <= 100 then v end as score from c1),
agg as (select model, benchmark, count(distinct score) + max((score is null)::int) as vals, min(score) as v, count(*) as files from cells group by 1, 2),
conf as (select model, benchmark, case when vals = 1 then v end as score, files, case when vals > 1 then 'conflicting score files' when v is null then 'invalid overall score' else 'ok' end as reason from agg)
"""


def cells(spark, sf):
    c = view(spark, sf, "lineitem").selectExpr(*CELLS)
    return c.withColumn("score", checks.percent_normalize(F.col("raw"), F.col("benchmark"), ["ChartQA_TEST"]))


@register("percent_normalize", CELLS_SQL + "select model, benchmark, raw, count(*) n, round(max(score), 6) as score from cells group by 1, 2, 3")
def percent_normalize(spark, sf):
    return cells(spark, sf).groupBy("model", "benchmark", "raw").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("score"), 6).alias("score"))


@register("score_conflict", CELLS_SQL + "select model, benchmark, round(score, 6) as score, files, reason from conf")
def score_conflict(spark, sf):
    out = checks.score_conflict(cells(spark, sf), ["model", "benchmark"], "score")
    return out.select("model", "benchmark", F.round("score", 6).alias("score"), "files", "reason")


def grid(spark, sf):
    conf = checks.score_conflict(cells(spark, sf), ["model", "benchmark"], "score")
    models = view(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("model"))
    return checks.model_benchmark_grid(models, conf.drop("files"), "model", "benchmark", BENCH)


GRID_SQL = CELLS_SQL + """, grid as (select n_nationkey::bigint as model, b.benchmark, c.score, coalesce(c.reason, 'score file missing') as reason from nation
 cross join (values ('MMVP'), ('MMStar'), ('BLINK'), ('ChartQA_TEST')) b(benchmark) left join conf c on c.model = n_nationkey and c.benchmark = b.benchmark)
"""


@register("model_benchmark_grid", GRID_SQL + "select model, benchmark, round(score, 6) as score, reason from grid")
def model_benchmark_grid(spark, sf):
    return grid(spark, sf).select("model", "benchmark", F.round("score", 6).alias("score"), "reason")


AVG_CELLS = "select l_suppkey % 5 as model, case l_partkey % 3 when 0 then 'MMVP' when 1 then 'MMStar' else 'BLINK' end as benchmark, avg(l_discount) * 1000 as score from lineitem group by 1, 2"


@register("benchmark_average", f"""
with c as ({AVG_CELLS}) select model, round(max(case when benchmark = 'MMVP' then score end), 6) as mmvp, round(avg(score), 6) as average, false as withheld from c group by 1
union all select model + 100, null, null, true from c group by 1
union all select model + 200, null, null, true from c group by 1""")
def benchmark_average(spark, sf):
    li = view(spark, sf, "lineitem")
    c = li.groupBy((F.col("l_suppkey") % 5).alias("model"), F.expr(
        "case l_partkey % 3 when 0 then 'MMVP' when 1 then 'MMStar' else 'BLINK' end").alias("benchmark")).agg(
        (F.avg("l_discount") * 1000).alias("score"))
    same = c.select("model").distinct().withColumn("signature", checks.protocol_signature({"judge": F.lit("v1")}))
    mixed = same.withColumn("signature", F.concat("signature", F.col("model").cast("string")))
    three = ["MMVP", "MMStar", "BLINK"]
    good = checks.benchmark_average(c, "model", "benchmark", three, same)
    bad = checks.benchmark_average(c, "model", "benchmark", three, mixed)
    unsigned = checks.benchmark_average(c, "model", "benchmark", three, same.filter("model <> 4"))
    show = lambda df, shift, held: df.select(
        (F.col("model") + shift).alias("model"), (F.round("MMVP", 6) if not held else F.lit(None).cast("double")).alias("mmvp"),
        F.round("average", 6).alias("average"), F.col("average").isNull().alias("withheld"))
    return show(good, 0, False).unionByName(show(bad, 100, True)).unionByName(show(unsigned, 200, True))


@register("protocol_signature", """
select user_id, sha256('{"judge":"' || event_type || '","props":"' || replace(props, '"', '\\"') || '","use_fast":' || case when value > 100 then 'true' else 'false' end || '}') as signature from events""")
def protocol_signature(spark, sf):
    return view(spark, sf, "events").select("user_id", checks.protocol_signature({
        "use_fast": F.col("value") > 100, "judge": F.col("event_type"), "props": F.col("props")}).alias("signature"))


@register("dataset_fingerprint", """
with d as (select sha256('{"doc_id":' || doc_id || ',"quality":' || quality || ',"toxic":' || toxic || '}') as h from labels),
s as (select count(*) n, """ + ", ".join(f"cast(sum(('0x' || substr(h, {1 + 8 * i}, 8))::bigint) as bigint) l{i}" for i in range(8)) + """ from d)
select n, sha256(concat_ws('|', n, l0, l1, l2, l3, l4, l5, l6, l7)) as fingerprint from s""")
def dataset_fingerprint(spark, sf):
    return checks.dataset_fingerprint(view(spark, sf, "labels"))


@register("metadata_ids", with_sql("v_edits", """
select scene_id, obj, scene_id || '__keep0-' || obj as variant_id, 'counterfactual_qa::' || substr(sha256(scene_id || '|' || before_color), 1, 20) as pair_id from v_edits"""))
def metadata_ids(spark, sf):
    e = view(spark, sf, "v_edits")
    return e.select("scene_id", "obj", F.concat(F.col("scene_id").cast("string"), F.lit("__keep"), F.array_join(
        F.array(F.lit("0"), F.col("obj").cast("string")), "-")).alias("variant_id"),
        F.concat(F.lit("counterfactual_qa::"), F.substring(F.sha2(F.concat_ws("|", F.col("scene_id").cast("string"), "before_color"), 256), 1, 20)).alias("pair_id"))


@register("task_metadata_flatten", """
select o_orderkey as task_id, coalesce(case when o_orderkey % 2 = 0 then o_orderkey % 9 end, case when o_orderkey % 3 = 0 then 4 end) as budget_steps,
 coalesce(case when o_orderkey % 5 = 0 then 'task' end, case when o_orderkey % 3 = 0 then 'judge' end, 'fallback_default') as budget_source, case when o_orderkey % 7 = 0 then 640 else 320 end as image_width from orders""")
def task_metadata_flatten(spark, sf):
    from rollscope.operators.exports import task_metadata_flatten as flat

    t = view(spark, sf, "orders").selectExpr(
        "o_orderkey as task_id", "named_struct('task', named_struct('budget_steps', if(o_orderkey % 2 = 0, o_orderkey % 9, null), 'budget_source', if(o_orderkey % 5 = 0, 'task', null)), "
        "'judge', named_struct('budget_steps', if(o_orderkey % 3 = 0, 4L, null), 'budget_source', if(o_orderkey % 3 = 0, 'judge', null)), "
        "'variant', named_struct('image_width', if(o_orderkey % 7 = 0, 640, null), 'image_height', cast(null as int))) as meta")
    return flat(t, "meta").select("task_id", "budget_steps", "budget_source", "image_width")


RAW = ("concat('{', if(o_orderkey % 3 = 0, '\"accepted\": false, ', ''), if(o_orderkey % 6 = 0, '\"reject_reason\": \"too hard\", ', ''), "
       "if(o_orderkey % 5 = 0, '\"solvability_score\": 0.75, ', ''), if(o_orderkey % 4 = 0, '\"ambiguity_flag\": true, ', ''), "
       "if(o_orderkey % 7 = 0, '\"reasoning_budget_steps\": \"bad\", ', ''), '\"difficulty_level\": \"', case when o_orderkey % 2 = 0 then 'easy' else 'hard' end, '\"}') as raw")


@register("verdict_normalize", """
with f as (select o_orderkey as k, o_orderkey % 3 <> 0 as accepted, o_orderkey % 6 = 0 as th, case when o_orderkey % 2 = 0 then 'easy' else 'hard' end as lvl from orders)
select k as task_id, accepted, case when th then 'too hard' when accepted then '' else 'rejected' end as reject_reason, case when k % 5 = 0 then 0.75 when accepted then 1.0 else 0.4 end as solvability,
 case when k % 4 = 0 then 0.7 else 0.2 end as ambiguity, 4::bigint as budget_steps, case when th and not accepted then 'easy' else lvl end as suggested, case when th and not accepted then 'reduce_difficulty' else '' end as reason from f""")
def verdict_normalize(spark, sf):
    v = view(spark, sf, "orders").selectExpr("o_orderkey as task_id", RAW).select("task_id", exports.verdict_normalize(F.col("raw")).alias("v"))
    return v.select("task_id", "v.accepted", "v.reject_reason", F.col("v.solvability_score").alias("solvability"), F.col("v.ambiguity_score").alias("ambiguity"),
                    F.col("v.budget_steps").cast("bigint").alias("budget_steps"), "v.suggested", "v.reason")


@register("reference_subset", """
select o_orderkey as task_id, case when o_orderkey % 2 = 0 then 'easy' else 'hard' end as difficulty_level, null::bigint as budget_steps, 0::bigint as num_steps from orders""")
def reference_subset(spark, sf):
    v = view(spark, sf, "orders").selectExpr("o_orderkey as task_id", RAW).select("task_id", exports.reference_subset(F.col("raw")).alias("v"))
    return v.select("task_id", "v.difficulty_level", "v.budget_steps", F.size("v.steps").cast("bigint").alias("num_steps"))


@register("heuristic_verdict", """
with f as (select o_orderkey as k, o_orderkey % 8 as attrs, case when o_orderpriority like '1%' then 'hard' else 'easy' end as est, case when o_orderstatus = 'F' then 'easy' else 'hard' end as tgt from orders),
g as (select *, est = 'hard' and tgt = 'easy' as th from f)
select k as task_id, not th and attrs < 6 as accepted, case when th then 'too_hard_for_difficulty_target' when attrs >= 6 then 'high_visual_ambiguity' else '' end as reject_reason,
 3 + attrs // 2 as budget_steps, case when attrs >= 3 then 0.85 else 0.6 end as grounding from g""")
def heuristic_verdict(spark, sf):
    t = view(spark, sf, "orders").selectExpr(
        "o_orderkey as task_id", "o_orderkey % 8 as num_attr_changes", "if(o_orderpriority like '1%', 'hard', 'easy') as difficulty_estimate",
        "if(o_orderstatus = 'F', 'easy', 'hard') as difficulty_target")
    return exports.heuristic_verdict(t).select("task_id", "accepted", "reject_reason", "budget_steps", F.col("visual_grounding_score").alias("grounding"))


@register("passthrough_verdict", "select o_orderkey as task_id, true as accepted, false as judged, 3 + o_orderkey % 8 // 2 as budget_steps from orders")
def passthrough_verdict(spark, sf):
    t = view(spark, sf, "orders").selectExpr("o_orderkey as task_id", "o_orderkey % 8 as num_attr_changes")
    return exports.passthrough_verdict(t).select("task_id", "accepted", "judged", "budget_steps")


@register("grounding_context", with_sql("v_scene_objects", """
with b as (select scene_id, obj, px, depth % 240 as py, scene_id % 9 as players, scene_id % 6 as spy from v_scene_objects),
o as (select *, px + 20 <= 320 and py + 20 <= 240 and players between 2 and 8 and (spy = 0 or spy <= players) as ok from b)
select scene_id, obj, count(*) n, count(*) filter (where ok) as kept, cast(sum(case when players between 2 and 8 and (spy = 0 or spy <= players) then case when spy = 0 then players else 1 end else 0 end) as bigint) as valid_players from o group by 1, 2"""))
def grounding_context(spark, sf):
    d = view(spark, sf, "v_scene_objects").selectExpr(
        "scene_id", "obj", "array(array(px, depth % 240, px + 20, depth % 240 + 20)) as boxes", "scene_id % 9 as players", "nullif(scene_id % 6, 0) as spy")
    c = d.select("scene_id", "obj", exports.grounding_context(F.col("boxes"), F.lit(320), F.lit(240), F.col("players"), F.col("spy")).alias("c"))
    return c.groupBy("scene_id", "obj").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.size("c.gold_boxes") > 0).alias("kept"), F.sum(F.size("c.valid_players")).alias("valid_players"))


ORACLE_TASKS = ("o_orderkey as task_id", "o_orderkey % 5 + 1 as spy_player", "if(o_orderkey % 4 = 0, 1, 5) as num_images",
                "array(named_struct('attribute', 'color', 'before', 'red', 'after', 'blue'), named_struct('attribute', 'size', 'before', 'small', 'after', 'large')) as facts",
                "array(array(double(o_orderkey % 100), 10.5D, 120D, 90D)) as boxes",
                "concat('<answer>spy=', o_orderkey % 5 + 1, '; changed_attributes=', if(o_orderkey % 3 = 0, 3, 2), '</answer>') as solution")


@register("oracle_eligible", "select o_orderkey as task_id from orders where o_orderkey % 4 <> 0 and o_orderkey % 3 <> 0")
def oracle_eligible(spark, sf):
    return exports.oracle_eligible(view(spark, sf, "orders").selectExpr(*ORACLE_TASKS)).select("task_id")


@register("oracle_replay_rows", """
with e as (select o_orderkey as k from orders where o_orderkey % 4 <> 0 and o_orderkey % 3 <> 0 order by sha256('1701|' || o_orderkey) limit 64)
select k as task_id, 'verified_oracle' as source_buffer, '<think>I compared the spy image with the other images and checked each changed attribute.</think>' || chr(10) || '<bbox player="' || k % 5 + 1 || '">[' || k % 100 || ',10.5,120,90]</bbox>' || chr(10) ||
 '<change>color:red->blue</change>' || chr(10) || '<change>size:small->large</change>' || chr(10) || '<answer>spy=' || k % 5 + 1 || '; changed_attributes=2</answer>' as completion from e""")
def oracle_replay_rows(spark, sf):
    return exports.oracle_replay_rows(view(spark, sf, "orders").selectExpr(*ORACLE_TASKS), 64)


@register("aux_cap_split", with_sql("v_vectors", ROUTE_SQL + """
, n as (select count(*) filter (where buffer = 'positive') p, (select count(*) from benchmark) o, (select count(*) from labels) s from buffered),
c as (select *, least(o + s, cast(floor(p * 0.6) as bigint)) as cap from n), f as (select *, least(o, (cap + 1) // 2) as o1, least(s, cap // 2) as s1 from c),
g as (select *, o1 + least(cap - o1 - s1, o - o1) as o2 from f)
select p as positives, o as n_oracle, s as n_scene, cap, o2 as oracle_cap, s1 + least(cap - o2 - s1, s - s1) as scene_cap from g"""))
def aux_cap_split(spark, sf):
    solver = routed(spark, sf).filter("buffer = 'positive'")
    return exports.aux_cap(solver, view(spark, sf, "benchmark"), view(spark, sf, "labels"), 0.6)


@register("mix_replace", """
with e as (select o_orderkey as k, row_number() over (order by sha256('8|' || o_orderkey), o_orderkey) rn from orders where o_orderstatus <> 'P'),
cap as (select least(cast(floor((select count(*) from orders) * 0.02) as bigint), (select count(*) from e), (select count(*) * 2 from customer)) // 2 * 2 as c),
t as (select c_custkey, r.role, row_number() over (order by sha256('8|' || 'q' || c_custkey), r.role) rn from customer cross join (values ('edited'), ('original')) r(role))
select cast(o_orderkey as varchar) as task_id, 'task' as kind from orders where o_orderkey not in (select k from e, cap where rn <= c) union all
select 'q' || c_custkey || '::' || role, 'qa' from t, cap where rn <= c""")
def mix_replace(spark, sf):
    rows = view(spark, sf, "orders").selectExpr("cast(o_orderkey as string) as task_id", "'task' as kind", "o_orderstatus")
    twins = view(spark, sf, "customer").select(F.concat(F.lit("q"), F.col("c_custkey").cast("string")).alias("pair_id"), F.explode(
        F.array(F.lit("edited"), F.lit("original"))).alias("pair_role")).select(
        F.concat("pair_id", F.lit("::"), "pair_role").alias("task_id"), F.lit("qa").alias("kind"), "pair_id", "pair_role")
    return exports.mix_replace(rows, twins, "task_id", F.col("o_orderstatus") == "P", 0.02, 8).select("task_id", "kind")
