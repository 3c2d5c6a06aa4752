"""Queries over scenes: facts, difficulty, questions, subsets, variants."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollscope.functions import facts as FX
from rollscope.operators import scenes, skew
from rollscope.plans.catalog import register
from rollscope.plans.queries_stats import r9
from rollscope.session import written
from rollscope.sources.views import view, with_sql

ATTRS = FX.ATTRIBUTES
ROWS_SQL = "rows0 as (" + " union all ".join(
    f"select scene_id, obj, '{a}' as attribute, before_{a} as before, after_{a} as after from v_edits" for a in ATTRS) + ")"
FACTS_SQL = "with " + ROWS_SQL + """,
ok as (select scene_id, count(*) filter (where before <> after) total from rows0 group by scene_id having not bool_or(before = 'mauve')),
facts as (select scene_id, attribute, before, after, count(*) n from rows0 where before <> after and scene_id in (select scene_id from ok) group by 1, 2, 3, 4)
"""


@register("gold_facts", with_sql("v_edits", "with " + ROWS_SQL + """,
ok as (select scene_id, count(*) filter (where before <> after) total, count(*) filter (where before <> after and attribute <> 'shape') +
 count(*) filter (where before <> after and attribute = 'shape' and scene_id % 4 <> 0) as stated from rows0 group by scene_id having not bool_or(before = 'mauve'))
select scene_id, attribute, before, after, count(*) n from rows0 where before <> after and scene_id in (select scene_id from ok where stated = total) group by 1, 2, 3, 4"""))
def gold_facts(spark, sf):
    edits = view(spark, sf, "v_edits")
    # Stated counts leave shape changes out in every fourth scene, so those with one must be dropped.
    stated = scenes.edit_facts(edits).groupBy("scene_id").agg(F.count_if(
        F.col("changed") & ((F.col("attribute") != "shape") | (F.col("scene_id") % 4 != 0))).alias("stated"))
    return scenes.gold_facts(edits, stated)


CLAIM_SQL = """
with c as (select gen_index, task_id, gen_index % 6 as k, (task_id + gen_index) % 8 = task_id % 8 as same, (task_id + gen_index) % 8 = (task_id + 3) % 8 as hit from v_claim_texts),
e as (select gen_index, task_id, case k when 0 then 2 when 1 then 1 when 3 then case when hit and not same then 1 else 0 end when 5 then 1 else 0 end as tp,
 case k when 0 then 2 when 1 then 2 when 5 then 3 else 1 end as predicted,
 case k when 2 then 1 when 3 then case when same then 1 else 0 end when 4 then 1 when 5 then 1 else 0 end as invalid from c)
"""


def claims(spark, sf):
    return view(spark, sf, "v_claim_texts").select("gen_index", "task_id", FX.change_claims(F.col("completion")).alias("c"))


@register("change_claims", with_sql("v_claim_texts", CLAIM_SQL + "select gen_index, predicted - invalid as valid, invalid from e"))
def change_claims(spark, sf):
    return claims(spark, sf).select("gen_index", F.size("c.facts").alias("valid"), F.col("c.invalid").alias("invalid"))


def gold_rows(spark, sf):
    return view(spark, sf, "v_claim_gold").select("task_id", F.inline(F.array(
        F.struct(F.lit("color").alias("attribute"), F.col("color_before").alias("before"), F.col("color_after").alias("after")),
        F.struct(F.lit("shape").alias("attribute"), F.col("shape_before").alias("before"), F.col("shape_after").alias("after")))))


def fact_table(spark, sf):
    c = claims(spark, sf)
    said = (c.select("gen_index", F.inline_outer("c.facts")).filter("attribute is not null").groupBy("gen_index", "attribute", "before", "after")
            .agg(F.count(F.lit(1)).alias("n")))
    gold = c.select("gen_index", "task_id").join(gold_rows(spark, sf), "task_id").groupBy(
        "gen_index", "attribute", "before", "after").agg(F.count(F.lit(1)).alias("n"))
    return scenes.fact_sides(said, gold, "gen_index"), c


@register("fact_f1", with_sql("v_claim_texts", CLAIM_SQL + """
select gen_index, cast(tp as bigint) tp, cast(predicted as bigint) predicted, round(tp / predicted, 9) as precision, round(tp / 2, 9) as recall, round(2 * tp / (predicted + 2), 9) as f1 from e"""))
def fact_f1(spark, sf):
    sides, c = fact_table(spark, sf)
    out = scenes.fact_f1(sides, "gen_index", c.select("gen_index", F.col("c.invalid").alias("invalid")))
    return out.select("gen_index", "tp", "predicted", r9("precision"), r9("recall"), r9("f1"))


@register("fact_intersection", with_sql("v_claim_texts", CLAIM_SQL + "select gen_index, cast(tp as bigint) as shared from e where tp > 0"))
def fact_intersection(spark, sf):
    sides, _ = fact_table(spark, sf)
    return sides.groupBy("gen_index").agg(F.sum(F.least("p", "g")).alias("shared")).filter("shared > 0")


@register("fact_equality", with_sql("v_claim_texts", CLAIM_SQL + "select gen_index, tp = 2 and predicted - invalid = 2 as equal from e"))
def fact_equality(spark, sf):
    sides, _ = fact_table(spark, sf)
    return sides.groupBy("gen_index").agg(F.bool_and(F.col("p") == F.col("g")).alias("equal"))


CHANGED = " + ".join(f"(before_{a} <> after_{a})::int" for a in ATTRS)


@register("difficulty", with_sql("v_edits", f"""
with r as (select scene_id, greatest(0, case when before_color <> after_color then 1.0 else 0 end, case when before_shape <> after_shape then 0.8 else 0 end,
 case when before_size <> after_size then 0.55 else 0 end, case when before_material <> after_material then 0.35 else 0 end) as sal,
 least(1.0, case when after_size = 'large' then 1.0 else 0.6 end * greatest(0.3, least(1.0, 12.0 / depth))) as sc, {CHANGED} as ch from v_edits),
g as (select scene_id, max(sal) salience, max(sc) as scale, count(*) clutter, sum(ch) num_attr_changes from r group by scene_id),
s as (select *, salience * (0.5 + 0.5 * scale) * greatest(0.5, least(1.0, 8.0 / clutter)) as score from g)
select scene_id, round(salience, 9) salience, round(scale, 9) as scale, clutter, cast(num_attr_changes as bigint) num_attr_changes, round(score, 8) score,
 case when round(score, 12) < 0.35 then 'hard' when round(score, 12) < 0.6 then 'medium' else 'easy' end as level from s"""))
def difficulty(spark, sf):
    return scenes.difficulty(view(spark, sf, "v_edits")).select(
        "scene_id", r9("salience"), r9("scale"), "clutter", "num_attr_changes", r9("score", 8), "level")


@register("changed_objects", with_sql("v_edits", f"""
select scene_id, obj, array_to_string(list_filter([{', '.join(f"case when before_{a} <> after_{a} then '{a}' end" for a in ATTRS)}], lambda x: x is not null), ',') as changed,
 {CHANGED} as num_changed, 'the ' || concat_ws(' ', after_size, after_color, after_material, after_shape) || ' at (' || cast(trunc(px) as integer) || ', ' || py || '), before ' ||
 concat_ws(' ', before_size, before_color, before_material, before_shape) as description from v_edits"""))
def changed_objects(spark, sf):
    return scenes.changed_objects(view(spark, sf, "v_edits"))


DELTA_SQL = "with " + ROWS_SQL + """,
sides as (select scene_id, attribute, before as value, 1 o, 0 n from rows0 union all select scene_id, attribute, after, 0, 1 from rows0),
deltas as (select scene_id, attribute, value, sum(o) as old, sum(n) as new from sides group by 1, 2, 3 having sum(o) <> sum(n))
"""


@register("count_deltas", with_sql("v_edits", DELTA_SQL + "select scene_id, attribute, value, cast(old as bigint) as old, cast(new as bigint) as new from deltas"))
def count_deltas(spark, sf):
    return scenes.count_deltas(view(spark, sf, "v_edits"))


ATTR_SQL = """
with o as (select scene_id, case a when 'shape' then 0 when 'color' then 1 when 'material' then 2 else 3 end as rk, a as attribute, value from
 (select scene_id, 'shape' a, before_shape as value from v_edits union all select scene_id, 'color', before_color from v_edits
 union all select scene_id, 'material', before_material from v_edits union all select scene_id, 'size', before_size from v_edits)),
c as (select scene_id, rk, attribute, value, count(*) n from o group by 1, 2, 3, 4), t as (select scene_id, count(*) total from v_edits group by 1),
attrs as (select c.scene_id, attribute, value, n, total from c join t on c.scene_id = t.scene_id where total >= 3 and n >= 2 and n < total
 qualify row_number() over (partition by c.scene_id order by rk, value) = 1)
"""


@register("attribute_counts", with_sql("v_edits", ATTR_SQL + "select scene_id, attribute, value, n, total from attrs"))
def attribute_counts(spark, sf):
    return scenes.attribute_counts(view(spark, sf, "v_edits"))


def relation_sql(kind: str) -> str:
    coord = "px" if kind == "left_right" else "depth"
    clear = "abs(a.c - b.c) >= 32" if kind == "left_right" else "a.size = b.size and abs(a.c - b.c) >= greatest(2.0, 0.2 * least(a.c, b.c))"
    less, more = ("left", "right") if kind == "left_right" else ("closer", "farther")
    return f"""{kind}_u as (select scene_id, concat_ws(' ', before_size, before_color, before_material, before_shape) as d, min(obj) obj, min({coord}) c, min(before_size) size
 from v_edits where before_color <> 'mauve' group by 1, 2 having count(*) = 1),
{kind}_p as (select a.scene_id, abs(a.c - b.c) gap, a.d d1, b.d d2, a.c c1, b.c c2, substr(sha256('1701|' || a.scene_id), 1, 1) >= '8' as swap
 from {kind}_u a join {kind}_u b on a.scene_id = b.scene_id and (a.obj < b.obj or (a.obj = b.obj and a.d < b.d)) where {clear}
 qualify row_number() over (partition by a.scene_id order by gap desc, d1, d2) = 1),
{kind}_r as (select scene_id, case when swap then d2 else d1 end as first, case when swap then d1 else d2 end as second, gap,
 case when case when swap then c2 else c1 end < case when swap then c1 else c2 end then '{less}' else '{more}' end as answer from {kind}_p)"""


@register("object_relations", with_sql("v_edits", "with " + relation_sql("left_right") + ", " + relation_sql("depth") + """
select 'left_right' as kind, scene_id, first, second, round(gap, 6) gap, answer from left_right_r union all
select 'depth', scene_id, first, second, round(gap, 6), answer from depth_r"""))
def object_relations(spark, sf):
    parts = [scenes.object_relations(view(spark, sf, "v_edits"), k).withColumn("kind", F.lit(k)) for k in ("left_right", "depth")]
    return parts[0].unionByName(parts[1]).select("kind", "scene_id", "first", "second", r9("gap", 6), "answer")


@register("scene_qa_rows", with_sql("v_edits", ATTR_SQL + ", " + relation_sql("left_right") + ", " + relation_sql("depth") + """
select scene_id, 'count' as kind, 'How many ' || case when attribute = 'shape' then value || 's' else value || ' objects' end || ' are in the image? Respond with <answer>number</answer> only.' as problem,
 '<answer>' || n || '</answer>' as completion from attrs union all
select scene_id, 'left_right', 'In the image, is the ' || first || ' to the left or right of the ' || second || '? Respond with <answer>left</answer> or <answer>right</answer> only.', '<answer>' || answer || '</answer>' from left_right_r union all
select scene_id, 'depth', 'Is the ' || first || ' closer to or farther from the camera than the ' || second || '? Respond with <answer>closer</answer> or <answer>farther</answer> only.', '<answer>' || answer || '</answer>' from depth_r"""))
def scene_qa_rows(spark, sf):
    return scenes.scene_qa_rows(view(spark, sf, "v_edits")).select("scene_id", "kind", "problem", "completion")


HASH_SQL = DELTA_SQL + """
, h as (select *, sha256('1701|' || scene_id || '|' || attribute || '|' || value) as rank from deltas),
firsts as (select * from h qualify row_number() over (partition by scene_id, attribute order by rank, value) = 1)
"""


@register("hash_rank_first", with_sql("v_edits", HASH_SQL + """
select scene_id, attribute, value, cast(old as bigint) as old, cast(new as bigint) as new from firsts"""))
def hash_rank_first(spark, sf):
    out = scenes.first_count_deltas(view(spark, sf, "v_edits"))
    return out.select("scene_id", "attribute", "value", "old", "new")


@register("counterfactual_qa_rows", with_sql("v_edits", HASH_SQL + """
, kept as (select * from firsts order by rank limit 500)
select 'counterfactual_qa::' || substr(sha256(scene_id || '|' || attribute || '|' || value), 1, 20) as pair_id, r.pair_role,
 'How many ' || case when attribute = 'shape' then value || 's' else value || ' objects' end || ' are in the image? Respond with <answer>number</answer> only.' as problem,
 cast(case when r.pair_role = 'original' then old else new end as bigint) as gold_count from kept cross join (values ('original'), ('edited')) r(pair_role)"""))
def counterfactual_qa_rows(spark, sf):
    return scenes.counterfactual_qa_rows(view(spark, sf, "v_edits"), 1001).select("pair_id", "pair_role", "problem", "gold_count")


@register("enumerate_subsets", with_sql("v_edits", """
with s as (select scene_id, count(*) k from v_edits group by 1), m as (select scene_id, unnest(range(1, (1::bigint << k::int))) as mask from s),
z as (select scene_id, bit_count(mask) as size, mask from m)
select scene_id, cast(size as integer) as size, count(*) as n, cast(sum(mask) as bigint) as mask_sum from z group by 1, 2"""))
def enumerate_subsets(spark, sf):
    per = view(spark, sf, "v_edits").groupBy("scene_id").agg(F.count(F.lit(1)).alias("k"))
    subs = scenes.enumerate_subsets(per, "k")
    return subs.groupBy("scene_id", F.bit_count("mask").alias("size")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("mask").alias("mask_sum"))


@register("lattice_pairs", with_sql("v_proposals", """
with d as (select distinct scene_id, mask from v_proposals)
select a.scene_id, array_to_string(list_filter(range(0, 5), lambda i: (a.mask >> i) & 1 = 1), ',') as small, array_to_string(list_filter(range(0, 5), lambda i: (b.mask >> i) & 1 = 1), ',') as large
from d a join d b on a.scene_id = b.scene_id and a.mask & b.mask = a.mask and bit_count(b.mask) = bit_count(a.mask) + 1"""))
def lattice_pairs(spark, sf):
    subs = view(spark, sf, "v_proposals").select("scene_id", "mask").distinct().select(
        "scene_id", scenes.mask_members(F.col("mask"), 5).alias("keep"))
    out = scenes.lattice_pairs(subs, ["scene_id"], "keep")
    return out.select("scene_id", F.array_join("small", ",").alias("small"), F.array_join("large", ",").alias("large"))


def picks(spark, sf):
    """One pick per proposal: kept line numbers of a scene that exists in the edits."""
    return view(spark, sf, "v_proposals").select(
        F.col("proposal_id").alias("pick_id"), F.col("proposal_id").alias("scene_id"),
        F.transform(scenes.mask_members(F.col("mask"), 5), lambda i: i + 1).alias("keep"))


@register("variant_rows", with_sql(("v_proposals", "v_edits"), f"""
with e as (select scene_id, obj, {CHANGED} as ch, greatest(0.0, px - 48) as x1, least(320.0, px + 48) as x2, greatest(0.0, py - 48) as y1, least(240.0, py + 48) as y2,
 count(*) over (partition by scene_id) as total from v_edits),
p as (select proposal_id, bit_count(mask & 31) as asked, mask, proposal_id || '__keep' || array_to_string(list_transform(list_filter(range(0, 5), lambda i: (mask >> i) & 1 = 1), lambda i: i + 1), '-') as variant_id from v_proposals)
select p.proposal_id as pick_id, any_value(variant_id) as variant_id, cast(sum(ch) as bigint) as num_attr_changes, count(*) as num_objects,
 string_agg(printf('%.3f,%.3f,%.3f,%.3f', x1, y1, x2, y2), ';' order by obj, x1, y1, x2, y2) as boxes, count(*) < any_value(total) as spliced,
 case when count(*) < any_value(total) then any_value(variant_id) || '_r48.png' else p.proposal_id || '_modified.png' end as spy_image
from p join e on e.scene_id = p.proposal_id and obj between 1 and 5 and (p.mask >> (obj - 1)) & 1 = 1 group by p.proposal_id having sum(ch) > 0 and count(*) = any_value(asked)"""))
def variant_rows(spark, sf):
    out = scenes.variant_rows(picks(spark, sf), view(spark, sf, "v_edits"))
    text = F.array_join(F.transform("gold_boxes", lambda b: F.format_string("%.3f,%.3f,%.3f,%.3f", b[0], b[1], b[2], b[3])), ";")
    return out.select("pick_id", "variant_id", "num_attr_changes", "num_objects", text.alias("boxes"), "spliced", "spy_image")


@register("overlap_anti", with_sql(("v_proposals", "v_edits"), """
with x as (select p.proposal_id, obj between 1 and 5 and (p.mask >> (greatest(obj, 1) - 1)) & 1 = 1 as kept, px, py from v_proposals p join v_edits e on e.scene_id = p.proposal_id),
bad as (select distinct a.proposal_id from x a join x b on a.proposal_id = b.proposal_id and a.kept and not b.kept and abs(a.px - b.px) < 96 and abs(a.py - b.py) < 96)
select proposal_id as pick_id from v_proposals where proposal_id not in (select proposal_id from bad)"""))
def overlap_anti(spark, sf):
    return scenes.overlap_anti(view(spark, sf, "v_edits"), picks(spark, sf)).select("pick_id")


@register("scene_verified", with_sql("v_edits", """
select scene_id, count(*) as edits, bool_and(before_color <> 'mauve') and count(*) = count(distinct obj) and bool_and(before_color <> after_color or before_shape <> after_shape or before_material <> after_material) as verified
from v_edits group by scene_id"""))
def scene_verified(spark, sf):
    from rollscope.operators.checks import scene_verified as check

    return check(view(spark, sf, "v_edits")).select("scene_id", "edits", "verified")


def scene_documents(spark, sf):
    """Tasks, scene documents and a listing made of the edits and proposals; some disagree by their numbers."""
    obj = lambda side: F.struct(*[F.col(f"{side}_{a}").alias(a) for a in FX.ATTRIBUTES])
    edits = view(spark, sf, "v_edits").groupBy("scene_id").agg(
        F.array_sort(F.collect_list(F.struct("obj", obj("before").alias("b"), obj("after").alias("a")))).alias("e"))
    # The documents, the listing and the tasks are all made of these.
    edits = written(edits)
    name = lambda what: F.concat(F.lit(what), F.col("scene_id").cast("string"), F.lit(".png"))
    path = F.concat(F.lit("/scenes/json/"), F.col("scene_id").cast("string"), F.lit(".json"))
    side = lambda f: F.transform("e", lambda x: x[f])
    rendered = F.when(F.col("scene_id") % 13 == 0, side("b")).otherwise(side("a"))
    doc = F.struct(
        F.struct(side("b").alias("objects")).alias("original_scene"), F.struct(rendered.alias("objects")).alias("modified_scene"),
        F.struct(F.transform("e", lambda x, i: F.struct(i.alias("index"), x["b"].alias("original"), x["a"].alias("replacement")))
                 .alias("replaced_objects")).alias("modification"),
        name("o").alias("original_image"), name("m").alias("modified_image"))
    scenes_table = edits.select(path.alias("path"), F.to_json(doc).alias("doc"))
    images = edits.select(F.explode(F.array(
        F.when(F.col("scene_id") % 7 > 0, F.concat(F.lit("/scenes/json/"), name("o"))),
        F.concat(F.lit("/scenes/json/"), name("m")), F.concat(F.lit("/scenes/replacement_images/"), name("k")))).alias("path"))

    asked = view(spark, sf, "v_proposals").withColumn("scene_id", F.col("proposal_id")).join(edits.hint("merge"), "scene_id", "left")
    whole = F.col("proposal_id") % 6 == 0
    kept = F.when(whole, F.sequence(F.lit(0), F.size("e") - 1)).otherwise(scenes.mask_members(F.col("mask"), 5))
    moved = lambda x: F.filter(F.array(*[F.struct(
        F.lit(a).alias("attribute"), x["b"][a].alias("before"), x["a"][a].alias("after")) for a in FX.ATTRIBUTES]),
        lambda f: f["before"] != f["after"])
    asked = asked.withColumn("keep", kept).withColumn("said", F.flatten(F.transform(
        F.filter("keep", lambda i: i < F.size("e")), lambda i: moved(F.get("e", i)))))
    spy = 1 + F.col("proposal_id") % 5
    shown = F.transform(F.sequence(F.lit(1), F.col("num_players")), lambda i: F.when(
        i != spy, name("o")).when(whole, name("m")).otherwise(name("k")))
    variant = F.when(~whole, F.struct(
        F.col("keep").alias("keep_indices"), (F.size("said") + (F.col("proposal_id") % 11 == 0).cast("int")).alias("num_attr_changes"),
        (F.col("mask") != 31).alias("spliced"), F.size("keep").alias("num_changed_objects"),
        name("k").alias("spy_image_path"), name("o").alias("civilian_image_path")))
    task = F.struct(path.alias("scene_path"), shown.alias("image_path"),
                    F.when(F.col("proposal_id") % 17 > 0, F.col("said")).alias("changes"),
                    F.struct(spy.alias("spy_player"), F.col("num_players"), variant.alias("variant")).alias("metadata"))
    return asked.select("proposal_id", F.to_json(task).alias("doc")), scenes_table, images.filter("path is not null")


@register("scene_documents_verified", with_sql(("v_proposals", "v_edits"), f"""
with s as (select scene_id, count(*) as n, bool_and(before_color <> 'mauve') as known, bool_and({CHANGED} > 0) as moved from v_edits group by 1),
t as (select p.*, s.*, p.proposal_id % 6 = 0 as whole from v_proposals p left join s on s.scene_id = p.proposal_id),
r as (select proposal_id, case when n is null then 'document' when not known then 'object attributes' when not moved then 'edit'
 when not whole and mask >= (1 << n) then 'keep' when proposal_id % 17 = 0 then 'facts'
 when not whole and proposal_id % 11 = 0 then 'attribute count' when proposal_id % 13 = 0 then 'modified scene' when proposal_id % 7 = 0 then 'images'
 when not whole and (mask <> 31) <> (bit_count(mask) < n) then 'spliced' when 1 + proposal_id % 5 > num_players then 'players' end as reason from t)
select proposal_id, reason, reason is null as verified from r"""))
def scene_documents_verified(spark, sf):
    from rollscope.operators.scene_documents import verify_scene_documents

    return verify_scene_documents(*scene_documents(spark, sf), task_id="proposal_id")
