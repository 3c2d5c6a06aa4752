"""Proposals, pairs, plans, feedback and the policy of the next round."""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from rollscope.functions.rewards import learnability
from rollscope.operators import gates, ranking, skew
from rollscope.operators.stats import modal_value
from rollscope.session import cut_lineage, written

# Failure tag to focus, the learnable band and the starting mix.
TAG_FOCUS = {
    "shortcut_or_ungrounded_success": "visual_evidence_grounding",
    "grounding_failure": "visual_evidence_grounding",
    "process_failure": "multi_step_reasoning_structure",
    "budget_failure": "reasoning_budget_control",
    "consistency_failure": "answer_consistency_control",
    "reasoning_or_final_decision_failure": "final_decision_reasoning",
}
BAND = (0.35, 0.65)
BALANCED = {"easy": 0.3, "medium": 0.5, "hard": 0.2}
LEVELS = ("easy", "medium", "hard")


def unique_rows(df: DataFrame, key: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rows whose key occurs once (within `keys`); repeated keys lose authority altogether."""
    cols = [c for c in df.columns if c not in (key, *keys)]
    one = df.filter(F.col(key).isNotNull()).groupBy(*keys, key).agg(
        F.count(F.lit(1)).alias("__n"), *[F.min(c).alias(c) for c in cols])
    return one.filter("__n = 1").select(*df.columns)


def join_unique_accepted(rollouts: DataFrame, tasks: DataFrame, key: str = "task_id") -> DataFrame:
    return rollouts.join(unique_rows(tasks, key), key, "left")


def proposal_score(proposals: DataFrame, tasks: DataFrame, stats: DataFrame) -> DataFrame:
    """Learnability of each proposal through its task's statistics; unreached ones score 0."""
    by_proposal = unique_rows(tasks.select("proposal_id", "task_id"), "proposal_id")
    df = proposals.join(by_proposal, "proposal_id", "left").join(stats, "task_id", "left")
    reached = F.col("n").isNotNull()
    rate, basis = F.col("pass_rate"), F.when(reached, F.lit("spy"))
    if "frontier" in stats.columns:
        certified = F.coalesce(F.col("gold_certificate_available"), F.lit(False)) & (
            F.coalesce(F.col("frontier"), F.lit("")) != "unverifiable")
        evidence = F.coalesce(F.col("frontier") == "evidence", F.lit(False))
        rate = F.when(certified, F.when(evidence, F.col("verified_pass_rate")).otherwise(F.col("pass_rate")))
        basis = F.when(reached, F.when(~certified, F.lit("unverifiable")).when(evidence, F.lit("verified_visual"))
                       .otherwise(F.lit("spy")))
    return df.select(
        *proposals.columns, "task_id", reached.alias("reached"), basis.alias("basis"),
        F.col("class").alias("solver_class"), F.col("pass_rate").alias("solved_rate"),
        F.when(reached, learnability(rate)).otherwise(F.lit(0.0)).alias("learnability"))


def proposal_report(scored: DataFrame, keep: str, keys: Sequence[str] = ()) -> DataFrame:
    """Parse rate, reach, mean learnability, distinct subsets and diversity in one row, or one per key."""
    text = F.array_join(F.col(keep).cast("array<string>"), ",")
    parsed = F.coalesce(F.size(keep) > 0, F.lit(False))
    # Group by subset first: the distinct count is then a plain row count.
    per = scored.groupBy(*keys, F.when(parsed, text).alias("subset")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("reached").alias("reached"),
        F.sum(F.when(F.col("reached"), F.col("learnability"))).alias("learn"),
        F.count_if(F.col("reached") & (F.col("solver_class") == "trainable")).alias("trainable"))
    out = per.groupBy(*keys).agg(
        F.sum("n").alias("num_proposals"), F.sum(F.when(F.col("subset").isNotNull(), F.col("n"))).alias("num_parsed"),
        F.sum("reached").alias("num_reached"), (F.sum("learn") / F.sum("reached")).alias("mean_learnability"),
        F.sum("trainable").alias("num_trainable"), F.count("subset").alias("distinct_subsets"))
    return out.select("*", (F.col("num_parsed") / F.col("num_proposals")).alias("parse_rate"),
                      (F.col("distinct_subsets") / F.col("num_parsed")).alias("diversity"))


def one_apart(picks: DataFrame) -> DataFrame:
    """small, large: names of distinct picks where the large one has one element more, from (name, group, keep) rows.

    Each pick offers its subsets by one element, so the pairs come from an equality join and their number is bounded by
    the picks' own sizes.
    """
    text = lambda k: F.array_join(k.cast("array<string>"), ",")
    less = picks.select(F.col("group"), F.col("name").alias("large"), F.explode(
        F.transform("keep", lambda x: text(F.filter("keep", lambda y: y != x)))).alias("part"))
    whole = picks.select(F.col("group").alias("group2"), F.col("name").alias("small"), text(F.col("keep")).alias("part2"))
    return less.join(whole, (F.col("group") == F.col("group2")) & (F.col("part") == F.col("part2"))).select("small", "large")


def least_pairs(items: DataFrame, edges: DataFrame) -> DataFrame:
    """small_id, large_id: what taking pairs in the order of (small id, large id) gives, a pair only if both ends are free.

    `items` holds (name, id), ids unique, and `edges` (small, large) says which names may pair. A pair that is the least at both
    ends is taken, its ends leave, and so on: that is the sequential result, and all groups advance in the same rounds. Only
    the least free id of a name can be in such a pair, so a round sees one row per name, however many ids share it. A
    taken pair of names goes on in the same round for as long as no other pair can come before: its next ids are matched by
    rank while they are below the least ids that compete.
    """
    edges = written(edges)
    paired = edges.select(F.explode(F.array("small", "large")).alias("name")).distinct()
    # Ids of a name are used in order, so the free ones are those from some rank on: its head.
    items = written(skew.number_rows_by_key(items.join(paired, "name"), ["name"], [F.col("id")], "rank").select("name", "rank", "id"))
    heads = items.filter("rank = 1")
    taken: list[DataFrame] = []
    while True:
        live = written(edges.join(heads.toDF("small", "small_rank", "a"), "small").join(heads.toDF("large", "large_rank", "b"), "large"))
        if live.isEmpty():
            break
        ends = live.select(F.explode(F.array("small", "large")).alias("name"), F.struct("a", "b", "small", "large", "small_rank", "large_rank").alias("e"))
        best = ends.groupBy("name").agg(F.min("e").alias("e"))
        won = best.groupBy("e").agg(F.count(F.lit(1)).alias("n")).filter("n = 2").select("e.*")
        # What competes with a taken pair: pairs that share one of its ends.
        mine = won.select("small", "large", F.explode(F.array("small", "large")).alias("name"))
        rival = mine.join(ends, "name").filter((F.col("e.small") != F.col("small")) | (F.col("e.large") != F.col("large")))
        small_is_small, large_is_small = F.col("e.small") == F.col("small"), F.col("e.small") == F.col("large")
        limits = rival.groupBy("small", "large").agg(
            F.min(F.when(~small_is_small & ~large_is_small, F.col("e.a"))).alias("a_below"),
            F.min(F.when(small_is_small, F.col("e.b"))).alias("b_below"), F.max(large_is_small).alias("chain"))
        runs = written(won.join(limits, ["small", "large"], "left"))

        def side(end: str, below: str, name: str) -> DataFrame:
            own = runs.select("small", "large", F.col(end).alias("name"), F.col(f"{end}_rank").alias("first"), F.col(below).alias("below"), "chain")
            met = own.join(items, "name").filter((F.col("rank") >= F.col("first")) & (F.col("below").isNull() | (F.col("id") < F.col("below"))))
            return met.select("small", "large", (F.col("rank") - F.col("first")).alias("step"), F.col("id").alias(name),
                              *(["chain"] if end == "small" else []))

        zipped = side("small", "a_below", "small_id").join(side("large", "b_below", "large_id"), ["small", "large", "step"])
        # A large pick that is the small one of another pair waits only while its partner comes first.
        late = F.min(F.when(F.col("chain") & (F.col("step") > 0) & (F.col("small_id") > F.col("large_id")), F.col("step"))).alias("stop")
        stop = zipped.groupBy("small", "large").agg(late).filter("stop is not null")
        ok = written(zipped.join(stop, ["small", "large"], "left").filter("stop is null or step < stop").select("small", "large", "small_id", "large_id"))
        taken.append(ok.select("small_id", "large_id"))
        moved = ok.select(F.explode(F.array("small", "large")).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("used"))
        at = heads.join(moved, "name", "left").select("name", (F.col("rank") + F.coalesce("used", F.lit(0))).alias("rank"))
        heads = written(at.join(items, ["name", "rank"]).select("name", "rank", "id"))
        edges = live.select("small", "large")
    if not taken:
        return items.select(F.col("id").alias("small_id"), F.col("id").alias("large_id")).limit(0)
    out = taken[0]
    for t in taken[1:]:
        out = out.union(t)
    return out


# A group whose picks have squared sizes of at most this sum is paired in order by one task; a larger one advances in rounds.
SMALL_GROUP = 250_000


def _pairs_in_order(picks: Sequence[tuple]) -> Iterator[tuple]:
    """Pairs of one group's (id, sorted elements) in order of id."""
    free = defaultdict(deque)
    for at, keep in picks:
        free[keep].append(at)
    larger = defaultdict(list)
    for keep in free:
        for i in range(len(keep)):
            less = keep[:i] + keep[i + 1:]
            if less in free:
                larger[less].append(free[keep])
    used = set()
    for at, keep in picks:
        if at in used or keep not in larger:
            continue
        heads = larger[keep]
        for ids in heads:
            while ids and ids[0] in used:
                ids.popleft()
        best = min((ids[0] for ids in heads if ids), default=None)
        if best is not None:
            used.update((at, best))
            yield at, best


def small_group_pairs(rows: DataFrame) -> DataFrame:
    """scene_id, num_players, small_id, large_id of groups that fit in a task, from (group, proposal_id, keep, scene_id, num_players)."""
    kind = lambda name, of: StructField(name, rows.schema[of].dataType)
    out = StructType([kind("scene_id", "scene_id"), kind("num_players", "num_players"), kind("small_id", "proposal_id"), kind("large_id", "proposal_id")])
    shape = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        found = []
        for _, members in groupby(stream, key=lambda r: r[0]):
            picks = list(members)
            found += [(*picks[0][3:], a, b) for a, b in _pairs_in_order([(r[1], tuple(r[2])) for r in picks])]
            if len(found) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), shape.types)], schema=shape)
                found = []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), shape.types)], schema=shape)

    return rows.select("group", "proposal_id", "keep", "scene_id", "num_players").repartition("group").sortWithinPartitions(
        "group", "proposal_id").mapInArrow(run, out)


def proposal_pairing(proposals: DataFrame, keep: str | None = None) -> DataFrame:
    """Pairs of one round's proposals that are one element apart, inside each (scene, players) group.

    Each proposal in order of its id takes the first free one that has all its elements and one more; a proposal joins one pair at
    most. Picks are arrays (`keep`) of any elements from 0 on, or the bits of `mask`. Empty picks, repeated or negative elements, null
    ids and null scenes never pair; missing player counts are a group of their own. Ids are unique. A group of up to SMALL_GROUP is paired in
    order by one task; larger ones are held in none and advance in rounds.
    """
    # A mask has 63 bits besides its sign.
    pick = F.col(keep) if keep else F.filter(F.sequence(F.lit(0), F.lit(62)), lambda i: F.col("mask").bitwiseAND(
        F.call_function("shiftleft", F.lit(1).cast("bigint"), i)) != 0)
    group = F.concat_ws("|", F.coalesce(F.col("num_players").cast("string"), F.lit("default")), F.col("scene_id").cast("string"))
    src = proposals.filter(F.col("scene_id").isNotNull() & F.col("proposal_id").isNotNull()).select(
        "scene_id", "num_players", "proposal_id", group.alias("group"), F.array_sort(pick).alias("keep"))
    ok = src.filter((F.size("keep") > 0) & F.forall("keep", lambda i: i >= 0) & (F.size(F.array_distinct("keep")) == F.size("keep")))
    width = F.size("keep").cast("bigint")
    ok = cut_lineage(skew.with_group_stats(ok, ["group"], {"__work": F.sum(width * width)}))
    few = small_group_pairs(ok.filter(F.col("__work") <= SMALL_GROUP))
    many = ok.filter(F.col("__work") > SMALL_GROUP)
    if many.isEmpty():
        return few
    many = many.withColumn("name", F.concat_ws(":", F.array_join(F.col("keep").cast("array<string>"), ","), "group"))
    edges = one_apart(many.groupBy("name").agg(F.first("group").alias("group"), F.first("keep").alias("keep")))
    pairs = least_pairs(many.select("name", F.col("proposal_id").alias("id")), edges)
    return few.unionByName(many.select("scene_id", "num_players", F.col("proposal_id").alias("small_id")).join(pairs, "small_id").select(
        "scene_id", "num_players", "small_id", "large_id"))


def pair_member_valid(tasks: DataFrame) -> DataFrame:
    """Tasks that can be one side of a counterfactual pair."""
    k = F.col("keep")
    return tasks.filter(
        F.col("pair_id").isNotNull() & F.col("pair_role").isin("small", "large") & F.col("scene_id").isNotNull()
        & (F.col("num_players") >= 1) & F.col("spy_player").between(1, F.col("num_players"))
        & (F.size(k) > 0) & F.forall(k, lambda i: i >= 0) & (F.size(F.array_distinct(k)) == F.size(k)))


def counterfactual_pairs(rollouts: DataFrame, tasks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Verified one-object pairs with the modal predicted count of each side; nothing meets across `by`.

    Sides are aggregated to one row per pair first, so the pairing needs no self-join.
    """
    task = [*by, "task_id"]
    valid = pair_member_valid(unique_rows(tasks, "task_id", by))
    seen = rollouts.join(valid.select(*task), task, "left_semi")
    modes = modal_value(seen, task, "count_pred")
    present = seen.select(*task).distinct()
    sides = valid.join(present, task).join(modes, task, "left")
    keys = [*by, "pair_id", "scene_id", "num_players", "spy_player"]
    side = lambda role, col: F.max(F.when(F.col("pair_role") == role, F.col(col)))
    per = sides.groupBy(*keys).agg(
        F.count_if(F.col("pair_role") == "small").alias("n_small"), F.count_if(F.col("pair_role") == "large").alias("n_large"),
        side("small", "keep").alias("small"), side("large", "keep").alias("large"),
        side("small", "mode").alias("small_mode"), side("large", "mode").alias("large_mode"))
    return per.filter((F.col("n_small") == 1) & (F.col("n_large") == 1)
                      & (F.size("large") == F.size("small") + 1) & (F.size(F.array_except("small", "large")) == 0)
                      & F.col("small_mode").isNotNull() & F.col("large_mode").isNotNull()).select(
        *keys, "small_mode", "large_mode")


def counterfactual_sensitivity(pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Share of pairs whose count moved, and of those whose count went up with the larger side, over all or per key."""
    moved = F.col("small_mode") != F.col("large_mode")
    out = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("num_pairs"), F.count_if(moved).alias("moved"),
                    F.count_if(F.col("large_mode") > F.col("small_mode")).alias("moved_up"))
    return out.select(*keys, "num_pairs", F.when(F.col("num_pairs") > 0, F.col("moved") / F.col("num_pairs"))
                      .alias("sensitivity"), F.when(F.col("num_pairs") > 0, F.col("moved_up") / F.greatest(
                          F.col("moved"), F.lit(1))).alias("direction_correct"))


def distinct_choices(proposals: DataFrame, keys: Sequence[str], keep: str, order: str) -> DataFrame:
    """First proposal of each (keys, sorted subset)."""
    src = proposals.withColumn("__k", F.array_join(F.array_sort(keep).cast("array<string>"), ","))
    return skew.top_one(src, [*keys, "__k"], F.col(order), biggest=False).select(*proposals.columns)


def proposal_plan(proposals: DataFrame, budget: int, seed: int, exclude: DataFrame | None = None) -> DataFrame:
    """Distinct valid picks up to the budget; one spy slot per (scene, players)."""
    k = F.col("keep")
    ok = proposals.filter((F.size(k) > 0) & F.forall(k, lambda i: i >= 0)
                          & (F.size(F.array_distinct(k)) == F.size(k)) & F.col("num_players").between(2, 8))
    if exclude is not None:
        ok = ok.join(exclude.select("scene_id").distinct(), "scene_id", "left_anti")
    plan = distinct_choices(ok, ["scene_id", "num_players"], "keep", "proposal_id").orderBy("proposal_id").limit(budget)
    return plan.withColumn("spy_player", hash_slot(seed, F.col("num_players"), "scene_id", "num_players"))


def hash_slot(seed: int, players: Column, *keys: str) -> Column:
    """Reproducible slot 1..players shared by rows with equal keys."""
    digits = F.conv(F.substring(ranking.hash_order(seed, *keys), 1, 8), 16, 10).cast("bigint")
    return digits % players + 1


def edit_plan(seeds: DataFrame, lattice: DataFrame, budget: int, seed: int, default_players: int = 5) -> DataFrame:
    """One neighbouring subset pair per seed scene, whole pairs within the budget.

    `hold` keeps the seed's own subset on one side; `harder` leads with the larger side.
    """
    first = skew.top_one(seeds, ["scene_id"], F.col("rank"), biggest=False)
    joined = first.join(lattice, "scene_id")
    own = F.col("keep")
    fits = (F.col("direction") != "hold") | F.coalesce((F.col("small") == own) | (F.col("large") == own), F.lit(False))
    picked = skew.top_one(
        joined.filter(fits).withColumn("__h", F.sha2(F.concat_ws(
            "|", F.lit(str(seed)), F.col("scene_id").cast("string"), F.array_join("small", ","), F.array_join("large", ",")), 256)),
        ["scene_id"], F.col("__h"), biggest=False)
    plan = picked.orderBy("rank").limit(budget // 2)
    lead_large = F.when(F.col("direction") == "hold", F.col("large") == own).otherwise(F.col("direction") == "harder")
    members = F.array(F.struct(F.lit("small").alias("pair_role"), F.col("small").alias("subset"), (~lead_large).alias("primary")),
                      F.struct(F.lit("large").alias("pair_role"), F.col("large").alias("subset"), lead_large.alias("primary")))
    pair_id = F.concat(F.col("scene_id").cast("string"), F.lit("::"), F.array_join("small", "-"), F.lit("|"),
                       F.array_join("large", "-"))
    return plan.select("rank", "scene_id", pair_id.alias("pair_id"),
                       hash_slot(seed, F.lit(default_players), "scene_id").alias("spy_player"), F.inline(members))


def drop_half_pairs(members: DataFrame) -> DataFrame:
    """Members of pairs whose every member was built; solo rows only need themselves."""
    whole = members.filter(F.col("pair_id").isNotNull()).groupBy("pair_id").agg(F.bool_and("built").alias("ok")).filter(
        "ok").select("pair_id")
    paired = members.join(whole, "pair_id", "left_semi")
    solo = members.filter(F.col("pair_id").isNull() & F.col("built"))
    return paired.unionByName(solo)


def rank_visible_edits(edits: DataFrame, clutter: DataFrame, top: int = 2) -> DataFrame:
    """Most visible edits per scene by difficulty score, ties to the lower object number."""
    from rollscope.functions import facts as FX

    sal = F.lit(0.0)
    for a in FX.ATTRIBUTES:
        sal = F.greatest(sal, F.when(F.col(f"before_{a}") != F.col(f"after_{a}"), F.lit(FX.SALIENCE[a])).otherwise(F.lit(0.0)))
    one = edits.select("scene_id", "obj", "depth", sal.alias("sal"), FX.object_scale(F.col("after_size"), F.col("depth")).alias("sc"))
    one = one.filter("sal > 0").groupBy("scene_id", "obj").agg(F.max("sal").alias("sal"), F.max("sc").alias("sc"))
    scored = one.join(clutter, "scene_id").withColumn("score", F.round(FX.difficulty_score(
        F.col("sal"), F.col("sc"), F.col("clutter")), 9))
    return skew.top_per_key(scored, ["scene_id"], [F.col("score").desc(), F.col("obj").asc()], top, rank="visible_rank")


def bootstrap_pairs(edits: DataFrame, clutter: DataFrame, slots: int, seed: int, exclude: DataFrame | None = None) -> DataFrame:
    """Two-member pairs (best edit; best two edits) from unseen scenes with at least two visible edits."""
    ranked = rank_visible_edits(edits, clutter, 2)
    if exclude is not None:
        ranked = ranked.join(exclude.select("scene_id").distinct(), "scene_id", "left_anti")
    per = ranked.groupBy("scene_id").agg(
        F.max(F.when(F.col("visible_rank") == 1, F.col("obj"))).alias("first"),
        F.max(F.when(F.col("visible_rank") == 2, F.col("obj"))).alias("second")).filter("second is not null")
    chosen = per.orderBy(ranking.hash_order(seed, "scene_id")).limit(slots // 2)
    large = F.array_sort(F.array("first", "second"))
    pair_id = F.concat(F.col("scene_id").cast("string"), F.lit("::bootstrap::"), F.col("first").cast("string"), F.lit("|"),
                       F.array_join(large.cast("array<string>"), "-"))
    return chosen.select("scene_id", pair_id.alias("pair_id"), F.inline(F.array(
        F.struct(F.lit("small").alias("pair_role"), F.array("first").alias("keep")),
        F.struct(F.lit("large").alias("pair_role"), large.alias("keep")))))


def fresh_tasks(scenes: DataFrame, players: int, position: Column, version: int, prefix: str, boxes: DataFrame) -> DataFrame:
    """Task rows for scenes: spy slot by position, one image path per player, computed gold answer and boxes.

    `boxes` has the gold boxes of each scene (`scene_boxes`).
    """
    spy = ranking.slot_assignment(position, F.lit(version), F.lit(players))
    base = scenes.withColumn("spy_player", spy)
    name = F.col("scene_id").cast("string")
    images = F.transform(F.sequence(F.lit(1), F.lit(players)), lambda p: F.concat(
        name, F.when(p == F.col("spy_player"), F.lit("_modified.png")).otherwise(F.lit("_original.png"))))
    answer = F.concat(F.lit("<answer>spy="), F.col("spy_player").cast("string"), F.lit("; changed_attributes="),
                      F.col("num_attr_changes").cast("string"), F.lit("</answer>"))
    none = F.array().cast("array<array<double>>")
    reason = F.concat(F.lit(f"policy v{version}: sampled_bucket="), F.col("level"))
    return base.join(boxes, "scene_id", "left").select(
        F.concat(F.lit(prefix + "::"), name).alias("task_id"), "scene_id", "spy_player", images.alias("image_path"),
        answer.alias("solution"), F.coalesce("gold_boxes", none).alias("gold_boxes"), F.lit(players).alias("num_players"),
        "level", reason.alias("generation_reason"))


def stratified_take(pool: DataFrame, bucket: str, label: str, key: str, wants: dict[str, int], total: int,
                    seed: int = 0) -> DataFrame:
    """Balanced pick per bucket, then a balanced backfill from what is left up to the total."""
    order = [ranking.hash_order(seed, key), F.col(key)]
    most = max(wants.values())
    ranked = skew.top_per_key(pool, [bucket, label], order, most, rank="__rn")
    want = F.create_map(*[F.lit(x) for kv in wants.items() for x in kv])[F.col(bucket)]
    # Bounded by buckets * labels * most rows; the second rank spreads each bucket over its labels.
    picked = skew.top_per_key(ranked, [bucket], [F.col("__rn"), F.col(label)], most, rank="__pos")
    picked = picked.filter(F.col("__pos") <= want).drop("__rn", "__pos").withColumn("fill", F.lit(False))
    missing = total - picked.agg(F.count(F.lit(1))).scalar()
    rest = pool.join(picked.select(key), key, "left_anti")
    spare = skew.top_per_key(rest, [label], order, total, rank="__rn").orderBy("__rn", label).limit(total)
    numbered = spare.select("*", (F.row_number().over(_order_window("__rn", label))).alias("__pos"))
    fill = numbered.filter(F.col("__pos") <= missing).drop("__rn", "__pos").withColumn("fill", F.lit(True))
    return picked.unionByName(fill)


def _order_window(*cols: str):
    from pyspark.sql import Window

    return Window.orderBy(*cols)


def feedback_summary(feedback: DataFrame, keys: Sequence[str] = (), run_target: str = "medium") -> DataFrame:
    """Difficulty signals of one round's verdicts; unjudged rows say nothing."""
    rank = gates.difficulty_rank
    rr = F.coalesce(F.col("reject_reason"), F.lit(""))
    too_hard = F.contains(rr, F.lit("too_hard")) | F.contains(rr, F.lit("too_difficult"))
    rejected = F.coalesce(~F.col("accepted"), F.lit(False))
    target = F.coalesce(F.col("target"), F.lit(run_target))
    gap = rank(target) - rank(F.col("suggested"))
    has = F.col("suggested").isNotNull()
    base = feedback.filter(F.coalesce(F.col("judged"), F.lit(True)))
    return base.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("num_judged"), F.count_if(rejected).alias("num_rejected"),
        F.count_if(rejected & too_hard).alias("too_difficult"),
        F.count_if(F.col("target").isNull()).alias("target_missing"),
        F.count_if(has & (gap > 0)).alias("strict_easier"),
        F.count_if(has & (gap == 0) & ~rejected & ~too_hard).alias("target_echo"),
        F.count_if((F.col("reason") == "reduce_difficulty") | too_hard).alias("reduce_difficulty"))


def feedback_histograms(feedback: DataFrame, keys: Sequence[str] = (), run_target: str = "medium") -> DataFrame:
    """Reject reasons, suggestions, targets and gaps as one long table."""
    rr = F.coalesce(F.col("reject_reason"), F.lit(""))
    too_hard = F.contains(rr, F.lit("too_hard")) | F.contains(rr, F.lit("too_difficult"))
    target = F.coalesce(F.col("target"), F.lit(run_target))
    canon = F.when(too_hard, F.lit("too_difficult")).when(rr == "", F.lit("unspecified")).otherwise(rr)
    gap = (gates.difficulty_rank(target) - gates.difficulty_rank(F.col("suggested"))).cast("string")
    cells = F.array(
        F.struct(F.lit("reject_reason").alias("field"), F.when(~F.col("accepted"), canon).alias("value")),
        F.struct(F.lit("suggested").alias("field"), F.col("suggested").alias("value")),
        F.struct(F.lit("target").alias("field"), target.alias("value")),
        F.struct(F.lit("gap").alias("field"), F.when(F.col("suggested").isNotNull(), gap).alias("value")))
    rows = feedback.filter(F.coalesce(F.col("judged"), F.lit(True))).select(*keys, F.inline(cells))
    return rows.filter(F.col("value").isNotNull()).groupBy(*keys, "field", "value").agg(F.count(F.lit(1)).alias("cnt"))


def judge_accounting(judged: DataFrame, keys: Sequence[str], quota: int, budget: int) -> DataFrame:
    """Accepted, judged and rejected counts of a judged prefix, its shortfall and what ran out."""
    out = judged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("judged"), F.count_if("accepted").alias("accepted"),
        F.count_if(~F.col("accepted")).alias("rejected"))
    short = F.greatest(F.lit(0), F.lit(quota) - F.col("accepted"))
    return out.select("*", short.alias("shortfall"), (F.col("judged") >= budget).alias("budget_exhausted"),
                      ((F.col("judged") < budget) & (F.col("accepted") < quota)).alias("pool_exhausted"))


def _shift(to: str, delta: float) -> dict[str, Column]:
    """Mix after moving weight one way, normalised to 1 and rounded to four places."""
    d = {k: F.col(f"prev_{k}") for k in LEVELS}
    if to == "easier":
        move = F.least(d["hard"], F.lit(delta))
        d = {"easy": d["easy"] + move * 0.5, "medium": d["medium"] + move * 0.5, "hard": d["hard"] - move}
    else:
        move = F.least(d["easy"], F.lit(delta))
        d = {"easy": d["easy"] - move, "medium": d["medium"], "hard": d["hard"] + move}
    total = d["easy"] + d["medium"] + d["hard"]
    return {k: F.round(v / F.when(total == 0, F.lit(1.0)).otherwise(total), 4) for k, v in d.items()}


# What says that a round gave any feedback at all: counts above zero, measured values.
FEEDBACK_COUNTS = ("too_difficult", "strict_easier", "reduce_difficulty", "num_rejected", "num_suggested", "grounding_failures",
                   "process_failures", "num_tags")
FEEDBACK_VALUES = ("solve_rate", "verified_rate", "answer_mean", "grounding_mean")


def next_policy(state: DataFrame, focus: DataFrame | None = None) -> DataFrame:
    """Difficulty mix, target, focus weights, seed offset and reasons of the next round for every run at once.

    One wide row per run: previous mix (prev_easy/medium/hard), prev_target, version, prev_seed_offset, feedback counts,
    solve_rate, verified_rate, num_certified and reward means; nulls mean "not measured". `focus` has the rows of
    `focus_weights`; there are at most as many per run as foci.
    """
    low, high = BAND
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    easier_hint = (n("reduce_difficulty") > 0) | (n("strict_easier") > 0) | (n("too_difficult") > 0)
    rate, verified, answer = F.col("solve_rate"), F.col("verified_rate"), F.col("answer_mean")
    branch = (
        F.when(easier_hint, F.lit("hint_easier"))
        .when(F.col("num_certified") == 0, F.lit("hold_no_certificate"))
        .when(rate.isNotNull() & (rate > high) & verified.isNotNull() & (verified <= high), F.lit("hold_evidence"))
        .when(rate > high, F.lit("harder")).when(rate < low, F.lit("easier"))
        .when(rate.isNotNull(), F.lit("hold_band")).when(answer >= 0.8, F.lit("answer_harder"))
        .when(answer <= 0.2, F.lit("answer_easier")).otherwise(F.lit("no_signal")))
    df = state.withColumn("branch", branch)
    easier, harder = _shift("easier", 0.15), _shift("harder", 0.10)
    up = F.col("branch").isin("harder", "answer_harder")
    down = F.col("branch").isin("hint_easier", "easier", "answer_easier")
    mix = {k: F.when(down, easier[k]).when(up, harder[k]).otherwise(F.round(F.col(f"prev_{k}"), 4)) for k in LEVELS}
    target = (F.when(F.col("branch") == "hint_easier", F.when(easier["hard"] > 0.05, F.lit("medium")).otherwise(F.lit("easy")))
              .when(up, F.lit("hard")).when(down, F.lit("medium")).otherwise(F.coalesce(F.col("prev_target"), F.lit("medium"))))
    count = lambda text, c: F.concat(F.lit(f"{text}(count="), n(c).cast("string"), F.lit(")"))
    pct = lambda text, c: F.concat(F.lit(f"{text}("), F.format_string("%.2f", F.col(c)), F.lit(")"))
    b = F.col("branch")
    reasons = F.array_compact(F.array(
        F.when((b == "hint_easier") & (n("too_difficult") > 0), count("reduce_hard_due_to_reference_too_difficult", "too_difficult")),
        F.when((b == "hint_easier") & (n("reduce_difficulty") > 0) & (n("too_difficult") == 0),
               count("reduce_hard_due_to_explicit_reduce_signal", "reduce_difficulty")),
        F.when((b == "hint_easier") & (n("strict_easier") > 0), count("reduce_hard_due_to_strict_easier_suggestion", "strict_easier")),
        F.when(b == "hold_no_certificate", F.lit("hold_difficulty_until_visual_certificate_available")),
        F.when(b == "hold_evidence", pct("hold_difficulty_until_visual_evidence_mastered", "verified_rate")),
        F.when(b == "harder", pct("increase_difficulty_solve_rate_above_band", "solve_rate")),
        F.when(b == "easier", pct("reduce_difficulty_solve_rate_below_band", "solve_rate")),
        F.when(b == "hold_band", pct("hold_difficulty_solve_rate_in_band", "solve_rate")),
        F.when(b == "answer_harder", F.lit("increase_hard_due_to_strong_answer_accuracy")),
        F.when(b == "answer_easier", F.lit("reduce_difficulty_due_to_low_answer_accuracy")),
        F.when(b == "no_signal", F.lit("no_difficulty_signal_keep_previous")),
        F.when((n("target_echo") > 0) & (b != "hint_easier"), count("ignored_target_echo_suggestions", "target_echo")),
        F.when((n("grounding_failures") > 0) | (F.col("grounding_mean") < 0.5),
               F.lit("increase_grounding_focus_due_to_grounding_failure")),
        F.when(n("process_failures") > 0, F.lit("increase_process_focus_due_to_process_failure"))))
    heard = F.lit(False)
    for c in FEEDBACK_COUNTS:
        heard = heard | (n(c) > 0 if c in state.columns else F.lit(False))
    for c in FEEDBACK_VALUES:
        heard = heard | F.col(c).isNotNull()
    text = F.when(heard, F.array_join(reasons, "; ")).otherwise(F.lit("no_feedback_keep_previous_or_minimal_decay"))
    if focus is not None:
        packed = focus.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("focus", F.round("weight", 4).alias("weight")))).alias("focus"))
        df = df.join(packed, "run_id", "left")
    none = F.array().cast("array<struct<focus:string,weight:double>>")
    return df.select("run_id", (n("version") + 1).alias("version"), *[mix[k].alias(k) for k in LEVELS], target.alias("target"),
                     (n("prev_seed_offset") + 1).alias("seed_offset"),
                     (F.coalesce("focus", none) if focus is not None else none).alias("focus"), text.alias("reasons"))


def editing_policy(stats: DataFrame, k: int) -> DataFrame:
    """What the next round edits: the k seeds with the most headroom, all tasks that are too hard, and retired scenes' tasks."""
    seeds = ranking.seed_ranking(stats, k).select(F.lit("seed").alias("list"), "task_id", "scene_id", "direction")
    hard = stats.filter(F.col("class") == "too_hard").select(F.lit("too_hard").alias("list"), "task_id", "scene_id", F.lit("easier").alias("direction"))
    done = ranking.retire_scenes(stats).select(F.lit("retire").alias("list"), "task_id", "scene_id", F.lit(None).cast("string").alias("direction"))
    return seeds.unionByName(hard).unionByName(done)


def focus_weights(tag_counts: DataFrame) -> DataFrame:
    """Share of failure tags per focus and run; the tag map is a literal."""
    focus = F.create_map(*[F.lit(x) for kv in TAG_FOCUS.items() for x in kv])[F.col("tag")]
    per = tag_counts.groupBy("run_id", focus.alias("focus")).agg(F.sum("n").alias("n"))
    totals = per.groupBy("run_id").agg(F.sum("n").alias("total"))
    return per.filter("focus is not null").join(totals, "run_id").select(
        "run_id", "focus", (F.col("n") / F.col("total")).alias("weight"))


def policy_diff(policies: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Changed fields between consecutive rounds, by an equi-join on the previous round number."""
    prev = policies.select("run_id", (F.col("round") + 1).alias("round"), *[F.col(f).alias(f"__p_{f}") for f in fields])
    rows = policies.join(prev, ["run_id", "round"])
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"__p_{f}").cast("string").alias("old"),
                               F.col(f).cast("string").alias("new")) for f in fields])
    return rows.select("run_id", "round", F.inline(cells)).filter(~F.col("old").eqNullSafe(F.col("new")))
