"""Queries over evidence boxes: parsing, scaling, overlap, matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollscope.functions import boxes as B
from rollscope.plans.catalog import register
from rollscope.plans.queries_stats import r9
from rollscope.sources.views import view, with_sql

# SQL twin for the spellings that occur in the completions.
ATTEMPTS_SQL = """
with att as (
 select gen_index, 1 + n as o, tag, false as is_json,
  regexp_extract(tag, 'player="([^"]*)"', 1) as player,
  case when regexp_extract(tag, 'coords="([^"]*)"', 1) <> '' then regexp_extract(tag, 'coords="([^"]*)"', 1)
   when contains(tag, 'x1="') then concat_ws(',', regexp_extract(tag, 'x1="([^"]*)"', 1), regexp_extract(tag, 'y1="([^"]*)"', 1),
    regexp_extract(tag, 'x2="([^"]*)"', 1), regexp_extract(tag, 'y2="([^"]*)"', 1))
   else regexp_extract(tag, '\\[(.*)\\]', 1) end as coords,
  case when len(regexp_extract_all(tag, 'player=')) > 1 then 'conflicting_player_ids' end as error
 from (select gen_index, unnest(tags) as tag, unnest(range(1, len(tags) + 1)) as n from (select gen_index,
  regexp_extract_all(completion, '(?s)<bbox[ >][^>]*>?.*?</bbox>') as tags from v_texts))
 union all
 select gen_index, 1, obj, true, regexp_extract(obj, '"player": "([^"]*)"', 1), regexp_extract(obj, '\\[([^\\]]*)\\]', 1), null
 from (select gen_index, unnest(regexp_extract_all(completion, '\\{[^{}]*bbox_2d[^{}]*\\}')) as obj from v_texts)
 union all
 select gen_index, 9, '', false, null, null, 'unclosed_bbox' from v_texts
 where len(regexp_extract_all(completion, '<bbox[ >]')) > len(regexp_extract_all(completion, '</bbox>'))),
parsed as (select gen_index, o, is_json, error, case when error is null then list_transform(string_split(coords, ','), lambda x: cast(trim(x) as double)) end as c,
 case when error is null then cast(player as bigint) end as player from att),
scaled as (select *, case when c is null then null when is_json or list_max(c) > 1 then [c[1] / 320, c[2] / 240, c[3] / 320, c[4] / 240] else c end as s from parsed),
boxes as (select gen_index, o, is_json, player, c, s, case when error is not null then error
 when list_min(s) < 0 or list_max(s) > 1 then 'out_of_range' when not (s[1] < s[3] and s[2] < s[4]) then 'bad_ordering' end as error from scaled)
"""


# Generators over computed arrays are outer ones with a null filter behind them: for an inner generator
# the optimizer adds a size test below it and so computes the array twice.
def attempts(spark, sf):
    return view(spark, sf, "v_texts").select("*", B.evidence_attempts(F.col("completion")).alias("attempts"))


def scaled(spark, sf):
    return attempts(spark, sf).select(
        "*", B.scaled_attempts(F.col("attempts"), F.lit(320), F.lit(240)).alias("scaled"))


@register("evidence_boxes", with_sql("v_texts", ATTEMPTS_SQL + """
select gen_index, cast(row_number() over (partition by gen_index order by o) - 1 as integer) as idx, is_json, player,
 case when c is not null then array_to_string(list_transform(c, lambda v: cast(v as double)::varchar), ',') end as coords,
 case when error in ('conflicting_player_ids', 'unclosed_bbox') then error end as error from boxes"""))
def evidence_boxes(spark, sf):
    rows = attempts(spark, sf).select("gen_index", F.posexplode_outer("attempts").alias("idx", "a")).filter("idx is not null")
    return rows.select("gen_index", "idx", F.col("a.is_json").alias("is_json"),
                       B.player_id(F.col("a.player")).alias("player"),
                       F.array_join(F.col("a.coords").cast("array<string>"), ",").alias("coords"),
                       F.col("a.error").alias("error"))


@register("box_scale", with_sql("v_texts", ATTEMPTS_SQL + """
select gen_index, cast(row_number() over (partition by gen_index order by o) - 1 as integer) as idx, error,
 case when error is null then round(s[1], 9) end as x1, case when error is null then round(s[2], 9) end as y1,
 case when error is null then round(s[3], 9) end as x2, case when error is null then round(s[4], 9) end as y2 from boxes"""))
def box_scale(spark, sf):
    rows = scaled(spark, sf).select("gen_index", F.posexplode_outer("scaled").alias("idx", "a")).filter("idx is not null")
    return rows.select("gen_index", "idx", F.col("a.error").alias("error"), *[
        F.round(F.col("a.box")[i], 9).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))])


@register("first_box_player", with_sql("v_texts", ATTEMPTS_SQL + """
select t.gen_index, f.player from v_texts t left join (select gen_index, player from boxes
 qualify row_number() over (partition by gen_index order by o) = 1) f on t.gen_index = f.gen_index"""))
def first_box_player(spark, sf):
    return attempts(spark, sf).select("gen_index", B.first_player(F.col("attempts")).alias("player"))


def rollout_boxes(spark, sf):
    """Predicted boxes in pixels next to the gold boxes of the task: one broadcast-or-shuffle join."""
    gold = view(spark, sf, "v_gold_boxes").select(
        "task_id", F.array(*[F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2")]).alias("g"))
    second = F.array(F.col("g")[0] + 20, F.col("g")[1] + 10, F.col("g")[2] + 20, F.col("g")[3] + 10)
    gold = gold.select("task_id", F.array(F.col("g"), second).alias("gold"))
    px = scaled(spark, sf).select("gen_index", "task_id", F.transform(
        B.valid_boxes(F.col("scaled")), lambda a: F.array(a["box"][0] * 320, a["box"][1] * 240, a["box"][2] * 320,
                                                          a["box"][3] * 240)).alias("pred"))
    return px.join(gold, "task_id")


PAIRS_SQL = ATTEMPTS_SQL + """
, pred as (select gen_index, row_number() over (partition by gen_index order by o) - 1 as p, s[1] * 320 px1, s[2] * 240 py1, s[3] * 320 px2, s[4] * 240 py2 from boxes where error is null),
gold as (select task_id, 0 as g, x1 * 1.0 x1, y1 * 1.0 y1, x2 * 1.0 x2, y2 * 1.0 y2 from v_gold_boxes
 union all select task_id, 1, x1 + 20.0, y1 + 10.0, x2 + 20.0, y2 + 10.0 from v_gold_boxes),
ov as (select t.gen_index, g.g, p.p, greatest(0.0, least(x2, px2) - greatest(x1, px1)) * greatest(0.0, least(y2, py2) - greatest(y1, py1)) inter,
 (x2 - x1) * (y2 - y1) + (px2 - px1) * (py2 - py1) tot from v_texts t join gold g on t.task_id = g.task_id join pred p on t.gen_index = p.gen_index),
pairs as (select gen_index, g, p, inter / (tot - inter) as iou from ov)
"""


@register("box_pairs_iou", with_sql(("v_texts", "v_gold_boxes"), PAIRS_SQL + """
select gen_index, cast(g as integer) g, cast(p as integer) p, round(iou, 9) iou from pairs"""))
def box_pairs_iou(spark, sf):
    rows = rollout_boxes(spark, sf).select("gen_index", F.explode_outer(B.iou_pairs(F.col("gold"), F.col("pred"))).alias("x")).filter("x is not null")
    return rows.select("gen_index", F.col("x.g").alias("g"), F.col("x.p").alias("p"),
                       F.round(-F.col("x.neg"), 9).alias("iou"))


@register("box_match_best", with_sql(("v_texts", "v_gold_boxes"), PAIRS_SQL + """
, best as (select gen_index, g, max(iou) as b from pairs group by gen_index, g)
select t.gen_index, round(coalesce(sum(case when b >= 0.1 then b else 0 end) / 2, 0), 9) as recall
from v_texts t left join best on t.gen_index = best.gen_index group by t.gen_index"""))
def box_match_best(spark, sf):
    df = rollout_boxes(spark, sf)
    return df.select("gen_index", F.round(B.best_recall(F.col("gold"), F.col("pred"), 0.1), 9).alias("recall"))


# With two gold boxes, greedy matching is: the best pair, then the best pair of what is left.
GREEDY_SQL = PAIRS_SQL + """
, ranked as (select *, row_number() over (partition by gen_index order by iou desc, g, p) rk from pairs where iou > 0 and iou >= 0.1),
one as (select * from ranked where rk = 1),
two as (select r.gen_index, r.iou from ranked r join one o on r.gen_index = o.gen_index where r.g <> o.g and r.p <> o.p
 qualify row_number() over (partition by r.gen_index order by r.rk) = 1),
np as (select gen_index, count(*) n from pred group by gen_index),
tot as (select t.gen_index, coalesce(o.iou, 0) + coalesce(w.iou, 0) as total, (o.iou is not null)::bigint + (w.iou is not null)::bigint as matched, coalesce(np.n, 0) n
 from v_texts t left join one o on t.gen_index = o.gen_index left join two w on t.gen_index = w.gen_index left join np on t.gen_index = np.gen_index)
"""


@register("box_match_greedy", with_sql(("v_texts", "v_gold_boxes"), GREEDY_SQL + """
select gen_index, matched, round(total / 2, 9) recall, round(case when n > 0 then total / n else 0 end, 9) as precision,
 round(case when n > 0 and total > 0 then 2 * (total / 2) * (total / n) / (total / 2 + total / n) else 0 end, 9) f1 from tot"""))
def box_match_greedy(spark, sf):
    df = rollout_boxes(spark, sf).select("*", B.greedy_fold(B.iou_pairs(F.col("gold"), F.col("pred")), 0.1).alias("m"))
    r, p, f = B.match_scores(F.col("m.total"), F.size("gold"), F.size("pred"))
    return df.select("gen_index", F.size("m.hits").cast("bigint").alias("matched"), r.alias("recall"),
                     p.alias("precision"), f.alias("f1")).select(
        "gen_index", "matched", r9("recall"), r9("precision"), r9("f1"))


@register("box_iou", """
with b as (select l_orderkey, l_linenumber, l_partkey % 300 as ax1, l_suppkey % 200 as ay1, l_partkey % 300 + l_quantity as ax2, l_suppkey % 200 + l_quantity as ay2,
 l_suppkey % 300 as bx1, l_partkey % 200 as by1, l_suppkey % 300 + 40 as bx2, l_partkey % 200 + 40 as by2 from lineitem),
o as (select *, greatest(0.0, least(ax2, bx2) - greatest(ax1, bx1)) * greatest(0.0, least(ay2, by2) - greatest(ay1, by1)) inter,
 (ax2 - ax1) * (ay2 - ay1) + 1600 tot from b)
select l_orderkey % 1000 as bucket, count(*) n, round(sum(inter / (tot - inter)), 6) total from o group by 1""")
def box_iou(spark, sf):
    df = view(spark, sf, "lineitem").selectExpr(
        "l_orderkey % 1000 as bucket",
        "array(double(l_partkey % 300), double(l_suppkey % 200), l_partkey % 300 + l_quantity, l_suppkey % 200 + l_quantity) as a",
        "array(double(l_suppkey % 300), double(l_partkey % 200), double(l_suppkey % 300 + 40), double(l_partkey % 200 + 40)) as b")
    return df.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"),
                                    F.round(F.sum(B.box_iou(F.col("a"), F.col("b"))), 6).alias("total"))


@register("box_iou_inclusive", """
with b as (select l_orderkey % 1000 as bucket, l_partkey % 60 as ax1, l_suppkey % 60 as ay1, l_partkey % 60 + l_quantity as ax2, l_suppkey % 60 + l_quantity as ay2,
 l_suppkey % 60 as bx1, l_partkey % 60 as by1, l_suppkey % 60 + 40 as bx2, l_partkey % 60 + 40 as by2 from lineitem),
o as (select *, greatest(ax1, bx1) x1, greatest(ay1, by1) y1, least(ax2 - 1, bx2 - 1) x2, least(ay2 - 1, by2 - 1) y2 from b),
i as (select bucket, case when x1 < x2 and y1 < y2 then (x2 - x1 + 1) * (y2 - y1 + 1) else 0 end as inter, (ax2 - ax1) * (ay2 - ay1) + 1600 as tot from o)
select bucket, round(sum(inter / (tot - inter)), 6) total, count(*) filter (where inter / (tot - inter) > 0.5) as hits from i group by bucket""")
def box_iou_inclusive(spark, sf):
    df = view(spark, sf, "lineitem").selectExpr(
        "l_orderkey % 1000 as bucket",
        "array(double(l_partkey % 60), double(l_suppkey % 60), l_partkey % 60 + l_quantity, l_suppkey % 60 + l_quantity) as a",
        "array(double(l_suppkey % 60), double(l_partkey % 60), double(l_suppkey % 60 + 40), double(l_partkey % 60 + 40)) as b")
    iou = B.box_iou_inclusive(F.col("a"), F.col("b"))
    return df.groupBy("bucket").agg(F.round(F.sum(iou), 6).alias("total"), F.count_if(iou > 0.5).alias("hits"))


@register("box_convert", """
select l_orderkey, l_linenumber, count(*) n, sum(l_quantity + l_suppkey) sum_x2, sum(l_partkey + l_linenumber) sum_y2,
 count(*) filter (where l_quantity > 10) valid from lineitem group by 1, 2""")
def box_convert(spark, sf):
    df = view(spark, sf, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "array(l_quantity, double(l_partkey), double(l_suppkey), double(l_linenumber)) as b",
        "if(l_quantity > 10, array(1D, 2D, 3D, 4D), array(1D, 2D, 3D)) as maybe")
    xy = B.xywh_to_xyxy(F.col("b"))
    return df.groupBy("l_orderkey", "l_linenumber").agg(
        F.count(F.lit(1)).alias("n"), F.sum(xy[2]).alias("sum_x2"), F.sum(xy[3]).alias("sum_y2"),
        F.count_if(B.is_box(F.col("maybe"))).alias("valid"))


@register("gold_boxes", with_sql("v_scene_objects", """
select scene_id, obj, count(*) n, round(sum(greatest(0.0, px - 48)), 4) x1, round(sum(least(320.0, px + 48)), 4) x2,
 round(sum(least(240.0, depth % 240 + 48) - greatest(0.0, depth % 240 - 48)), 4) h from v_scene_objects group by 1, 2"""))
def gold_boxes(spark, sf):
    b = B.centre_box(F.col("px"), F.col("depth") % 240)
    return view(spark, sf, "v_scene_objects").groupBy("scene_id", "obj").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(b[0]), 4).alias("x1"), F.round(F.sum(b[2]), 4).alias("x2"),
        F.round(F.sum(b[3] - b[1]), 4).alias("h"))


@register("near_dup_boxes", with_sql("v_texts", ATTEMPTS_SQL + """
, v as (select gen_index, o, s from boxes where error is null),
d as (select a.gen_index from v a join v b on a.gen_index = b.gen_index and a.o < b.o
 where greatest(0.0, least(a.s[3], b.s[3]) - greatest(a.s[1], b.s[1])) * greatest(0.0, least(a.s[4], b.s[4]) - greatest(a.s[2], b.s[2])) >=
 0.3 * ((a.s[3] - a.s[1]) * (a.s[4] - a.s[2]) + (b.s[3] - b.s[1]) * (b.s[4] - b.s[2])
  - greatest(0.0, least(a.s[3], b.s[3]) - greatest(a.s[1], b.s[1])) * greatest(0.0, least(a.s[4], b.s[4]) - greatest(a.s[2], b.s[2]))))
select gen_index, gen_index in (select gen_index from d) as near_dup from v_texts"""))
def near_dup_boxes(spark, sf):
    v = scaled(spark, sf).select("gen_index", F.transform(B.valid_boxes(F.col("scaled")), lambda a: a["box"]).alias("b"))
    return v.select("gen_index", B.near_duplicates(F.col("b"), 0.3).alias("near_dup"))
