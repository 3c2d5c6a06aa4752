"""Scene tables: facts, difficulty, questions, subsets and variants.

Scenes are kept as rows (one object or edit per row); whole-scene rules are partial aggregates.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollscope.functions import facts as FX
from rollscope.functions.boxes import centre_box
from rollscope.functions.text import let
from rollscope.operators import skew
from rollscope.operators.ranking import hash_order
from rollscope.session import cut_lineage

MAX_EDITS = 30
SUBSETS_PER_TASK = 2_000_000


def edit_facts(edits: DataFrame) -> DataFrame:
    """One row per edit and attribute with its transition and validity."""
    rows = F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(f"before_{a}").alias("before"),
                              F.col(f"after_{a}").alias("after")) for a in FX.ATTRIBUTES])
    out = edits.select("scene_id", "obj", F.inline(rows))
    ok = FX.in_domain(F.col("attribute"), F.col("before")) & FX.in_domain(F.col("attribute"), F.col("after"))
    return out.withColumn("valid", F.coalesce(ok, F.lit(False))).withColumn(
        "changed", F.col("before") != F.col("after"))


def gold_facts(edits: DataFrame, stated: DataFrame | None = None) -> DataFrame:
    """Fact multiset per scene; a scene with any malformed attribute or a wrong stated count has none.

    Triples travel as small numbers. A scene's verdict is one aggregate of its own, so only changed triples are shuffled.
    """
    triples = [(a, v, w) for a in FX.ATTRIBUTES for v in FX.DOMAINS[a] for w in FX.DOMAINS[a]]
    valid, total, codes = F.lit(True), F.lit(0), []
    for a in FX.ATTRIBUTES:
        before, after, values = F.col(f"before_{a}"), F.col(f"after_{a}"), FX.DOMAINS[a]
        valid = valid & F.coalesce(before.isin(*values) & after.isin(*values), F.lit(False))
        changed = F.coalesce(before != after, F.lit(False))
        total = total + changed.cast("int")
        at = lambda c: F.array_position(F.array(*[F.lit(v) for v in values]), c)  # noqa: B023, E731
        codes.append(F.when(changed & before.isin(*values) & after.isin(*values), (
            triples.index((a, values[0], values[0])) + (at(before) - 1) * len(values) + at(after)).cast("int")))
    counted = edits.select("scene_id", F.explode(F.array(*codes)).alias("__c")).filter("__c is not null").groupBy(
        "scene_id", "__c").agg(F.count(F.lit(1)).alias("n"))
    scenes = edits.groupBy("scene_id").agg(F.bool_and(valid).alias("ok"), F.sum(total).alias("total")).filter("ok")
    if stated is not None:
        scenes = scenes.join(stated, "scene_id").filter(F.col("stated") == F.col("total"))
    good = skew.null_safe_join(counted, scenes.select("scene_id"), ["scene_id"])
    part = lambda i: F.element_at(F.array(*[F.lit(t[i]) for t in triples]), F.col("__c"))
    return good.select("scene_id", part(0).alias("attribute"), part(1).alias("before"), part(2).alias("after"), "n")


def fact_sides(claims: DataFrame, gold: DataFrame, key: str) -> DataFrame:
    """Counts of each triple on both sides; one tagged union and one aggregate instead of an outer join."""
    triple = ["attribute", "before", "after"]
    both = claims.select(key, *triple, F.col("n").alias("p"), F.lit(0).cast("bigint").alias("g")).unionByName(
        gold.select(key, *triple, F.lit(0).cast("bigint").alias("p"), F.col("n").alias("g")))
    return both.groupBy(key, *triple).agg(F.sum("p").alias("p"), F.sum("g").alias("g"))


def fact_f1(sides: DataFrame, key: str, invalid: DataFrame | None = None) -> DataFrame:
    """Precision, recall and F1 per key from triple counts; `invalid` adds false claims per key."""
    per = sides.groupBy(key).agg(
        F.sum(F.least("p", "g")).alias("tp"), F.sum("p").alias("predicted"), F.sum("g").alias("gold"))
    if invalid is not None:
        per = per.join(invalid, key, "left").withColumn(
            "predicted", F.col("predicted") + F.coalesce(F.col("invalid"), F.lit(0)))
    p, r, f = FX.fact_scores(F.col("tp"), F.col("predicted"), F.col("gold"))
    return per.select(key, "tp", "predicted", "gold", (F.col("gold") > 0).alias("available"),
                      p.alias("precision"), r.alias("recall"), f.alias("f1"))


def difficulty(edits: DataFrame) -> DataFrame:
    """Label-independent difficulty per scene: best salience, best apparent size, clutter."""
    sal = F.lit(0.0)
    changes = F.lit(0)
    for a in FX.ATTRIBUTES:
        diff = F.col(f"before_{a}") != F.col(f"after_{a}")
        sal = F.greatest(sal, F.when(diff, F.lit(FX.SALIENCE[a])).otherwise(F.lit(0.0)))
        changes = changes + diff.cast("int")
    per = edits.groupBy("scene_id").agg(
        F.max(sal).alias("salience"), F.max(FX.object_scale(F.col("after_size"), F.col("depth"))).alias("scale"),
        F.count(F.lit(1)).alias("clutter"), F.sum(changes).alias("num_attr_changes"))
    score = FX.difficulty_score(F.col("salience"), F.col("scale"), F.col("clutter"))
    return per.select("*", score.alias("score"), FX.difficulty_level(score).alias("level"))


def changed_objects(edits: DataFrame) -> DataFrame:
    """Changed attributes and a one-line description of every edit."""
    names = F.array_compact(F.array(*[
        F.when(F.col(f"before_{a}") != F.col(f"after_{a}"), F.lit(a)) for a in FX.ATTRIBUTES]))
    side = lambda s: F.concat_ws(" ", *[F.col(f"{s}_{a}") for a in ("size", "color", "material", "shape")])
    text = F.concat(F.lit("the "), side("after"), F.lit(" at ("), F.col("px").cast("int").cast("string"), F.lit(", "),
                    F.col("py").cast("int").cast("string"), F.lit("), before "), side("before"))
    return edits.select("scene_id", "obj", F.array_join(names, ",").alias("changed"), F.size(names).alias("num_changed"),
                        text.alias("description"))


NEW_SIDE = 32


def _value_counts(edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edits per attribute value before (old) and after (new).

    First one row per scene (of less than 2^31 edits) with a column for each value of the domains, both counts in one number;
    then rows (scene_id, attribute, value, old, new) for every other value, null included.
    """
    one = lambda a, v: F.when(F.col(f"before_{a}") == v, F.lit(1)).otherwise(F.lit(0)).cast("bigint") + F.when(
        F.col(f"after_{a}") == v, F.lit(1 << NEW_SIDE)).otherwise(F.lit(0)).cast("bigint")
    known = edits.groupBy("scene_id").agg(F.count(F.lit(1)).alias("__edits"), *[
        F.sum(one(a, v)).alias(f"__{a}_{v}") for a in FX.ATTRIBUTES for v in FX.DOMAINS[a]])
    inside = lambda c, a: F.coalesce(F.col(c).isin(*FX.DOMAINS[a]), F.lit(False))
    odd = F.lit(False)
    for a in FX.ATTRIBUTES:
        odd = odd | ~inside(f"before_{a}", a) | ~inside(f"after_{a}", a)
    sides = [F.struct(F.lit(a).alias("attribute"), F.col(f"{side}_{a}").alias("value"), F.lit(int(side == "before")).alias("o"),
                      F.lit(int(side == "after")).alias("n")) for a in FX.ATTRIBUTES for side in ("before", "after")]
    rows = edits.filter(odd).select("scene_id", F.inline(F.array(*sides)))
    other = rows.filter(~F.coalesce(FX.in_domain(F.col("attribute"), F.col("value")), F.lit(False))).groupBy(
        "scene_id", "attribute", "value").agg(F.sum("o").alias("old"), F.sum("n").alias("new"))
    return known, other


def _sides(a: str, v: str) -> tuple[Column, Column]:
    both = F.col(f"__{a}_{v}")
    return both.bitwiseAND(F.lit((1 << NEW_SIDE) - 1)), F.shiftright(both, NEW_SIDE)


def count_deltas(edits: DataFrame) -> DataFrame:
    """Attribute values whose object count differs before and after the edits."""
    known, other = _value_counts(edits)
    cells = []
    for a in FX.ATTRIBUTES:
        for v in FX.DOMAINS[a]:
            old, new = _sides(a, v)
            cells.append(F.when(old != new, F.struct(F.lit(a).alias("attribute"), F.lit(v).alias("value"), old.alias("old"),
                                                     new.alias("new"))))
    rows = known.select("scene_id", F.inline(F.array(*cells))).filter("attribute is not null")
    return rows.unionByName(other.filter("old <> new"))


def first_count_deltas(edits: DataFrame, seed: int = 1701) -> DataFrame:
    """`hash_rank_first` of the count deltas per scene and attribute, picked inside the one row per scene."""
    known, other = _value_counts(edits)
    ranked = other.filter("old <> new").withColumn("rank", hash_order(seed, "scene_id", "attribute", "value"))
    pick = F.struct("rank", "value", "old", "new")
    rest = ranked.groupBy("scene_id").agg(*[F.min(F.when(F.col("attribute") == a, pick)).alias(f"__o_{a}") for a in FX.ATTRIBUTES])
    firsts = []
    for a in FX.ATTRIBUTES:
        cells = [F.col(f"__o_{a}")]
        for v in FX.DOMAINS[a]:
            old, new = _sides(a, v)
            rank = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col("scene_id").cast("string"), F.lit(a), F.lit(v)), 256)
            cells.append(F.when(old != new, F.struct(rank.alias("rank"), F.lit(v).alias("value"), old.alias("old"), new.alias("new"))))
        firsts.append(F.struct(F.lit(a).alias("attribute"), F.array_min(F.array(*cells)).alias("b")))
    rows = skew.null_safe_join(known, rest.hint("shuffle_hash"), ["scene_id"], "left").select("scene_id", F.inline(F.array(*firsts)))
    return rows.filter("b is not null").select("scene_id", "attribute", "b.value", "b.old", "b.new", "b.rank")


# Order in which count questions look for a usable attribute.
COUNT_ORDER = ("shape", "color", "material", "size")


def attribute_counts(objects: DataFrame) -> DataFrame:
    """First (attribute, value) of a scene that 2 or more but not all objects share."""
    known, other = _value_counts(objects)
    # Of one attribute's other values the least is enough: where it covers the whole scene there is no second one.
    rest = other.filter("old >= 2").groupBy("scene_id").agg(*[
        F.min(F.when(F.col("attribute") == a, F.struct("value", "old"))).alias(f"__o_{a}") for a in COUNT_ORDER])
    cells = []
    for i, a in enumerate(COUNT_ORDER):
        counts = [(F.col(f"__o_{a}.value"), F.col(f"__o_{a}.old"))] + [(F.lit(v), _sides(a, v)[0]) for v in FX.DOMAINS[a]]
        cells += [F.when((n >= 2) & (n < F.col("__edits")), F.struct(
            F.lit(i).alias("rank"), v.alias("value"), F.lit(a).alias("attribute"), n.alias("n"))) for v, n in counts]
    rows = skew.null_safe_join(known.filter("__edits >= 3"), rest.hint("shuffle_hash"), ["scene_id"], "left").select(
        "scene_id", F.array_min(F.array(*cells)).alias("b"), F.col("__edits").alias("total"))
    return rows.filter("b is not null").select("scene_id", "b.attribute", "b.value", "b.n", "total")


# Smallest gaps that count as clearly apart.
MIN_PIXELS, MIN_DEPTH, MIN_DEPTH_SHARE = 32.0, 2.0, 0.2
RELATION_COORD = {"left_right": "px", "depth": "depth"}


def _relations(objects: DataFrame, kinds: Sequence[str], seed: int) -> DataFrame:
    """Per scene and kind (as a struct column) the widest clear pair of uniquely described objects, null without one.

    Only descriptions that occur once stay, and there are 96 of them, which bounds a scene's list.
    """
    desc = F.concat_ws(" ", *[F.col(f"before_{a}") for a in ("size", "color", "material", "shape")])
    valid = F.lit(True)
    for a in FX.ATTRIBUTES:
        valid = valid & F.col(f"before_{a}").isin(*FX.DOMAINS[a])
    unique = (objects.filter(valid).groupBy("scene_id", desc.alias("d"))
              .agg(F.count(F.lit(1)).alias("n"), F.min("obj").alias("obj"), *[F.min(RELATION_COORD[k]).alias(f"c_{k}") for k in kinds])
              .filter("n = 1").withColumn("size", F.substring_index("d", " ", 1)))

    def widest(kind: str):
        def best(o: Column) -> Column:
            def pairs(a: Column, i: Column) -> Column:
                made = F.transform(F.slice(o, i + 2, F.size(o)), lambda b: F.struct(
                    (-F.abs(a["c"] - b["c"])).alias("neg"), a["d"].alias("d1"), b["d"].alias("d2"), a["c"].alias("c1"),
                    b["c"].alias("c2"), (a["size"] == b["size"]).alias("same")))
                if kind == "left_right":
                    return F.filter(made, lambda p: -p["neg"] >= MIN_PIXELS)
                return F.filter(made, lambda p: p["same"] & (-p["neg"] >= F.greatest(
                    F.lit(MIN_DEPTH), MIN_DEPTH_SHARE * F.least(p["c1"], p["c2"]))))

            return F.array_min(F.flatten(F.transform(o, pairs)))
        # Picked inside the aggregate: a filter on its result then cannot make it run twice.
        return let(F.array_sort(F.collect_list(F.struct("obj", "d", F.col(f"c_{kind}").alias("c"), "size"))), best).alias(kind)

    swap = F.substring(hash_order(seed, "scene_id"), 1, 1) >= "8"
    return unique.groupBy("scene_id").agg(*[widest(k) for k in kinds]).withColumn("swap", swap)


def _told(kind: str) -> tuple[Column, Column, Column]:
    """First and second description of a pair in the order they are asked, and the answer."""
    b = F.col(kind)
    side = lambda x, y: F.when(F.col("swap"), b[y]).otherwise(b[x])
    less, more = {"left_right": ("left", "right"), "depth": ("closer", "farther")}[kind]
    return (side("d1", "d2"), side("d2", "d1"),
            F.when(side("c1", "c2") < side("c2", "c1"), F.lit(less)).otherwise(F.lit(more)))


def object_relations(objects: DataFrame, kind: str, seed: int = 1701) -> DataFrame:
    """Widest clear left-right or depth pair of uniquely described objects per scene."""
    first, second, answer = _told(kind)
    return _relations(objects, [kind], seed).filter(F.col(kind).isNotNull()).select(
        "scene_id", first.alias("first"), second.alias("second"), (-F.col(kind)["neg"]).alias("gap"), answer.alias("answer"))


def _plural(attribute: Column, value: Column) -> Column:
    return F.when(attribute == "shape", F.concat(value, F.lit("s"))).otherwise(F.concat(value, F.lit(" objects")))


def count_question(attribute: Column, value: Column) -> Column:
    return F.concat(F.lit("How many "), _plural(attribute, value),
                    F.lit(" are in the image? Respond with <answer>number</answer> only."))


def scene_qa_rows(objects: DataFrame, seed: int = 1701) -> DataFrame:
    """Question rows of three kinds per scene, answers computed from the scene."""
    cnt = attribute_counts(objects).select(
        "scene_id", F.lit("count").alias("kind"), count_question(F.col("attribute"), F.col("value")).alias("problem"),
        F.col("n").cast("string").alias("answer"))
    asked = {"left_right": ("In the image, is the ", " to the left or right of the ",
                            "? Respond with <answer>left</answer> or <answer>right</answer> only."),
             "depth": ("Is the ", " closer to or farther from the camera than the ",
                       "? Respond with <answer>closer</answer> or <answer>farther</answer> only.")}

    def question(kind: str) -> Column:
        first, second, answer = _told(kind)
        head, middle, tail = (F.lit(t) for t in asked[kind])
        return F.when(F.col(kind).isNotNull(), F.struct(
            F.lit(kind).alias("kind"), F.concat(head, first, middle, second, tail).alias("problem"), answer.alias("answer")))

    pairs = _relations(objects, list(asked), seed).select("scene_id", F.inline(F.array(*[question(k) for k in asked])))
    return cnt.unionByName(pairs.filter("kind is not null")).withColumn(
        "completion", F.concat(F.lit("<answer>"), "answer", F.lit("</answer>")))


def hash_rank_first(rows: DataFrame, keys: Sequence[str], parts: Sequence[str], seed: int = 1701) -> DataFrame:
    """First row per key by sha256 rank of the named parts."""
    ranked = rows.withColumn("rank", hash_order(seed, *parts))
    return skew.top_one(ranked, keys, F.struct("rank", *[F.col(p) for p in parts if p not in keys]), biggest=False)


def counterfactual_qa_rows(edits: DataFrame, max_examples: int, seed: int = 1701) -> DataFrame:
    """Count questions asked on both images of a scene; whole pairs in hash order up to the cap."""
    parts = ["scene_id", "attribute", "value"]
    first = first_count_deltas(edits, seed)
    pairs = first.orderBy("rank", *parts).limit(max_examples // 2)
    pair_id = F.concat(F.lit("counterfactual_qa::"), F.substring(
        F.sha2(F.concat_ws("|", *[F.col(p).cast("string") for p in parts]), 256), 1, 20))
    sides = F.array(F.struct(F.lit("original").alias("pair_role"), F.col("old").alias("gold_count")),
                    F.struct(F.lit("edited").alias("pair_role"), F.col("new").alias("gold_count")))
    return pairs.select(pair_id.alias("pair_id"), *parts, count_question(F.col("attribute"), F.col("value"))
                        .alias("problem"), F.inline(sides))


def enumerate_subsets(scenes: DataFrame, num_edits: str, cap: int | None = None) -> DataFrame:
    """Non-empty subsets of each scene's edits as (scene_id, mask, keep), smallest first, at most `cap` per scene.

    Without a cap a scene has 2^edits - 1 rows by definition; more than MAX_EDITS edits is then an error. High and low
    halves of the bit mask are exploded one after the other, which keeps every intermediate array short. With a cap
    subsets are made size by size, and only up to the size that fills the cap, so a scene may have any number of edits;
    `mask` is null beyond 62 edits.
    """
    if cap is not None:
        return _first_subsets(scenes, num_edits, cap)
    k = F.when(F.col(num_edits) <= MAX_EDITS, F.col(num_edits)).otherwise(
        F.raise_error(F.concat(F.lit("too many edits in scene "), F.col("scene_id").cast("string"))).cast("bigint"))
    half = MAX_EDITS // 2
    upto = lambda bits: F.sequence(F.lit(0).cast("bigint"), F.pow(F.lit(2), bits).cast("bigint") - 1)
    # Subsets are made in as many tasks as their number asks for, not in as many as the scenes' few bytes would get.
    sized = cut_lineage(scenes.select("scene_id", k.alias("__k")))
    made = sized.agg(F.sum(F.pow(F.lit(2.0), "__k"))).first()[0] or 0.0
    tasks = math.ceil(made / SUBSETS_PER_TASK)
    if tasks > scenes.sparkSession.sparkContext.defaultParallelism:
        sized = sized.repartition(tasks, "scene_id")
    high = sized.select("scene_id", "__k", F.explode(upto(F.greatest(F.col("__k") - half, F.lit(0)))).alias("__hi"))
    both = high.select("scene_id", "__hi", F.explode(upto(F.least(F.col("__k"), F.lit(half)))).alias("__lo"))
    masks = both.select("scene_id", (F.col("__hi") * (1 << half) + F.col("__lo")).alias("mask")).filter("mask > 0")
    return masks.select("scene_id", "mask", mask_members(F.col("mask"), MAX_EDITS).alias("keep"))


def _first_subsets(scenes: DataFrame, num_edits: str, cap: int) -> DataFrame:
    """The first `cap` subsets of each scene by (size, members), grown by one member per round."""
    n = F.col("__n")
    # Only the first `cap` subsets of a size can grow into needed ones of the next: members ascend, so a subset sorts by
    # its prefix. `made` counts what the smaller sizes have delivered.
    level = scenes.select("scene_id", F.col(num_edits).cast("int").alias("__n"), F.lit(0).cast("bigint").alias("__made"),
                          F.array().cast("array<int>").alias("keep"))
    out = None
    while True:
        last = F.coalesce(F.try_element_at("keep", F.lit(-1)), F.lit(-1))
        grown = level.filter(last < n - 1).select("scene_id", "__n", "__made", "keep", F.explode(F.sequence(
            last + 1, n - 1)).alias("__i"))
        ranked = skew.top_per_key(grown.select("scene_id", "__n", "__made", F.array_append("keep", F.col("__i")).alias("keep")),
                                  ["scene_id"], [F.col("keep")], cap, rank="__rk")
        taken = cut_lineage(ranked.filter(F.col("__rk") + F.col("__made") <= cap))
        if taken.isEmpty():
            break
        out = taken if out is None else out.union(taken)
        sizes = taken.groupBy("scene_id").agg(F.count(F.lit(1)).alias("__got"))
        level = skew.null_safe_join(taken, sizes, ["scene_id"]).select(
            "scene_id", "__n", (F.col("__made") + F.col("__got")).alias("__made"), "keep").filter(F.col("__made") < cap)
    rows = taken if out is None else out
    mask = F.when(n <= 62, F.aggregate("keep", F.lit(0).cast("bigint"), lambda m, i: m + F.pow(F.lit(2), i).cast("bigint")))
    return rows.select("scene_id", mask.alias("mask"), "keep")


def mask_members(mask: Column, width: int) -> Column:
    return F.filter(F.array(*[F.lit(i) for i in range(width)]),
                    lambda i: F.getbit(mask, i) == 1)


def lattice_pairs(subsets: DataFrame, keys: Sequence[str], keep: str) -> DataFrame:
    """Subset pairs one element apart: each large subset looks up itself minus one element."""
    small = subsets.select(*keys, F.array_sort(keep).alias("small"))
    probe = subsets.select(*keys, F.array_sort(keep).alias("large"), F.explode(keep).alias("__drop")).withColumn(
        "small", F.filter("large", lambda i: i != F.col("__drop"))).drop("__drop")
    return small.join(probe.filter(F.size("small") > 0), [*keys, "small"])


# Size of a scene image.
IMAGE_WIDTH, IMAGE_HEIGHT = 320, 240


def scene_boxes(edits: DataFrame) -> DataFrame:
    """Gold boxes and descriptions of a scene's edits in object order, as one row per scene."""
    item = F.struct("obj", centre_box(F.col("px"), F.col("py"), width=IMAGE_WIDTH, height=IMAGE_HEIGHT).alias("box"))
    return edits.groupBy("scene_id").agg(F.array_sort(F.collect_list(item)).alias("b")).select(
        "scene_id", F.transform("b", lambda x: x["box"]).alias("gold_boxes"), F.size("b").alias("num_edits"))


def variant_rows(picks: DataFrame, edits: DataFrame) -> DataFrame:
    """Label, gold boxes, spliced flag and images of each pick; picks hold a scene and kept object numbers.

    Boxes are in the order of the kept objects; a pick that keeps every edit of its scene is the edited image itself.
    Picks of unknown objects and picks that change nothing are left out.
    """
    changes = F.lit(0)
    for a in FX.ATTRIBUTES:
        changes = changes + (F.col(f"before_{a}") != F.col(f"after_{a}")).cast("int")
    items = edits.select("scene_id", "obj", changes.alias("changes"), centre_box(
        F.col("px"), F.col("py"), width=IMAGE_WIDTH, height=IMAGE_HEIGHT).alias("box"))
    totals = edits.groupBy("scene_id").agg(F.count(F.lit(1)).alias("num_edits"))
    asked = picks.select("pick_id", "scene_id", F.array_sort(F.array_distinct("keep")).alias("keep"))
    rows = asked.select("pick_id", "scene_id", F.size("keep").alias("asked"), F.explode("keep").alias("obj")).join(items, ["scene_id", "obj"])
    labels = rows.groupBy("pick_id").agg(
        F.sum("changes").alias("num_attr_changes"), F.count(F.lit(1)).alias("num_objects"), F.max("asked").alias("asked"),
        F.array_sort(F.collect_list(F.struct("obj", "box"))).alias("b"))
    name = F.col("scene_id").cast("string")
    variant = F.concat(name, F.lit("__keep"), F.array_join(F.col("keep").cast("array<string>"), "-"))
    spliced = F.col("num_objects") < F.col("num_edits")
    out = asked.join(labels.filter((F.col("num_objects") == F.col("asked")) & (F.col("num_attr_changes") > 0)), "pick_id").join(totals, "scene_id")
    return out.select(
        "pick_id", "scene_id", variant.alias("variant_id"), "num_attr_changes", "num_objects",
        F.transform("b", lambda x: x["box"]).alias("gold_boxes"), spliced.alias("spliced"),
        F.when(spliced, F.concat(variant, F.lit("_r48.png"))).otherwise(F.concat(name, F.lit("_modified.png"))).alias("spy_image"),
        F.concat(name, F.lit("_original.png")).alias("civilian_image"),
        F.lit(IMAGE_WIDTH).alias("image_width"), F.lit(IMAGE_HEIGHT).alias("image_height"))


def overlap_anti(edits: DataFrame, picks: DataFrame, radius: float = 48.0, cell: float = 96.0) -> DataFrame:
    """Picks whose reverted patches touch no kept patch.

    Patches are bucketed into grid cells as wide as a patch, so only patches in the same cell meet.
    """
    box = edits.select("scene_id", "obj", (F.col("px") - radius).alias("x1"), (F.col("px") + radius).alias("x2"),
                       (F.col("py") - radius).alias("y1"), (F.col("py") + radius).alias("y2"))
    patches = picks.select("pick_id", "scene_id", "keep").join(box, "scene_id").select(
        "pick_id", F.array_contains("keep", F.col("obj")).alias("kept"), "x1", "x2", "y1", "y2")
    grid = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell)))
    celled = patches.withColumn("cx", grid("x1", "x2")).withColumn("cy", grid("y1", "y2"))
    kept = celled.filter("kept").drop("kept")
    lost = celled.filter("not kept").select("pick_id", "cx", "cy", *[
        F.col(c).alias(f"r{c}") for c in ("x1", "x2", "y1", "y2")])
    touch = kept.join(
        lost, (kept.pick_id == lost.pick_id) & (kept.cx == lost.cx) & (kept.cy == lost.cy)
        & (kept.x1 < lost.rx2) & (lost.rx1 < kept.x2) & (kept.y1 < lost.ry2) & (lost.ry1 < kept.y2), "left_semi")
    return picks.join(touch.select("pick_id").distinct(), "pick_id", "left_anti")
