"""Derived tables of the test data, written once as select lists that both engines accept."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from rollscope.functions.facts import COLORS, MATERIALS, SHAPES, SIZES

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def pick(index: str, values: tuple[str, ...]) -> str:
    """SQL text choosing a word by a number."""
    cases = " ".join(f"when {i} then '{v}'" for i, v in enumerate(values))
    return f"(case ({index}) % {len(values)} {cases} end)"


# view -> (source table or view, select list, distinct)
VIEWS: dict[str, tuple[str, list[str], bool]] = {
    "v_tasks": ("orders", [
        "o_orderkey as task_id", "o_custkey as scene_id", "o_orderkey % 5 + 1 as spy_gold",
        "o_orderkey % 7 + 1 as count_gold",
        "case when o_orderpriority like '1%' then 'hard' when o_orderpriority like '2%' "
        "or o_orderpriority like '3%' then 'medium' else 'easy' end as difficulty",
        "o_orderstatus as judge_status", "o_totalprice as score", "o_orderdate as created",
    ], False),
    "v_rollouts": ("events", [
        "event_id as gen_index", "user_id as task_id", "user_id % 20 as scene_id", "event_type as kind",
        "value / 500.0 as reward_scalar", "event_type = 'purchase' as solved",
        "event_id % 5 + 1 as spy_pred", "user_id % 5 + 1 as spy_gold",
        "event_id % 7 + 1 as count_pred", "user_id % 7 + 1 as count_gold", "ts",
    ], False),
    "v_rollouts_big": ("lineitem", [
        "l_orderkey as task_id", "l_linenumber as slot", "l_discount * 10 as reward_scalar",
        "l_returnflag = 'R' as solved", "l_suppkey % 5 + 1 as spy_pred", "l_orderkey % 5 + 1 as spy_gold",
        "l_linenumber as count_pred", "l_orderkey % 7 + 1 as count_gold",
    ], False),
    "v_completions": ("v_rollouts", [
        "gen_index", "task_id",
        "concat('<think>Player ', cast(spy_pred as string), ' differs.</think><bbox player=\"', "
        "cast(spy_pred as string), '\">[', cast(gen_index % 200 as string), ',', "
        "cast(gen_index % 120 as string), ',', cast(gen_index % 200 + 60 as string), ',', "
        "cast(gen_index % 120 + 60 as string), ']</bbox><answer>spy=', cast(spy_pred as string), "
        "'; changed_attributes=', cast(count_pred as string), '</answer>') as completion",
        "concat('<answer>spy=', cast(spy_gold as string), '; changed_attributes=', "
        "cast(count_gold as string), '</answer>') as solution",
    ], False),
    "v_gold_boxes": ("events", [
        "user_id as task_id", "user_id % 200 as x1", "user_id % 120 as y1",
        "user_id % 200 + 60 as x2", "user_id % 120 + 60 as y2",
    ], True),
    "v_scene_objects": ("lineitem", [
        "l_orderkey as scene_id", "l_linenumber as obj", "l_partkey % 8 as color", "l_partkey % 3 as shape",
        "l_partkey % 2 as size", "l_suppkey % 2 as material", "l_suppkey % 8 as new_color",
        "l_suppkey % 3 as new_shape", "l_quantity * 6 as px", "l_extendedprice as depth",
    ], False),
    "v_votes": ("lineitem", [
        "l_orderkey as game_id", "l_linenumber as voter", "l_suppkey % 8 as voted", "l_orderkey % 7 + 1 as spy",
    ], False),
    "v_detections": ("embeddings", [
        "vec_id as det_id", "cast(label as bigint) as category", "vec_id % 50 as image_id",
    ], False),
    # Reward vectors per rollout: five dimensions in [0, 1] plus the flags routing reads.
    "v_vectors": ("events", [
        "event_id as gen_index", "user_id as task_id", "event_type as kind",
        "case when event_id % 3 = 0 then 1.0e0 else (event_id % 10) / 10.0e0 end as answer",
        "(event_id % 11) / 10.0e0 as budget", "(event_id % 7) / 6.0e0 as process",
        "(event_id % 9) / 8.0e0 as grounding", "(event_id % 13) / 12.0e0 as consistency",
        "event_id % 10 <> 0 as format_valid", "event_id % 8 = 0 as shortcut_detected",
        "(event_id % 5) / 4.0e0 as visual_facts_score", "value / 500.0 as reward_scalar", "ts",
    ], False),
    # Completions in many shapes: well formed, missing or repeated parts, every box spelling, broken boxes.
    "v_texts": ("v_rollouts", [
        "gen_index", "task_id", "kind", "count_gold", "spy_gold",
        "case gen_index % 10 "
        "when 0 then concat('<think>Player ', cast(spy_pred as string), ' shows a red cube, the others match. "
        "Therefore it is the spy.</think>\n<bbox player=\"', cast(spy_pred as string), '\">[', "
        "cast(gen_index % 200 as string), ',', cast(gen_index % 120 as string), ',', "
        "cast(gen_index % 200 + 60 as string), ',', cast(gen_index % 120 + 60 as string), "
        "']</bbox>\n<answer> Spy = ', cast(spy_pred as string), ';  changed_attributes = ', "
        "cast(count_pred as string), ' </answer>') "
        "when 1 then concat('I guess spy player ', cast(spy_pred as string), ' and changed attributes: ', "
        "cast(count_pred as string)) "
        "when 2 then concat('<think>First. Then compare. So done.</think><answer>spy=', "
        "cast(spy_pred as string), '; changed_attributes=', cast(count_pred as string), "
        "'</answer><answer>spy=9</answer>') "
        "when 3 then concat('<think>Look.</think><bbox player=\"2\">[1,2,30,40]<answer>spy=', "
        "cast(spy_pred as string), '; changed-attribute ', cast(count_pred as string), '</answer>') "
        "when 4 then concat('<think>a</think><bbox player=\"', cast(spy_pred as string), "
        "'\" coords=\"10,20,', cast(30 + gen_index % 50 as string), ',90\"></bbox><bbox player=\"', "
        "cast(spy_pred as string), '\">[40,30,120,90]</bbox><answer>spy=', cast(spy_pred as string), "
        "'; changed_attributes=2</answer>') "
        "when 5 then concat('<think>json</think>[{\"bbox_2d\": [5, 6, ', cast(70 + gen_index % 90 as string), "
        "', 80], \"player\": \"', cast(spy_pred as string), '\"}]<answer>spy=', cast(spy_pred as string), "
        "'; changed_attributes=', cast(count_pred as string), '</answer>') "
        "when 6 then '<think>long</think><answer>spy=12345678901; changed_attributes=3</answer>' "
        "when 7 then concat('<think>x</think><bbox x1=\"', cast(gen_index % 90 as string), "
        "'\" y1=\"10\" x2=\"60\" y2=\"200\" player=\"7\"></bbox><answer>spy=2; changed_attributes=1</answer>') "
        "when 8 then '<answer>spy=1; changed_attributes=1</answer> trailing <think>late</think>' "
        "else concat('<think>no box but spy player ', cast(spy_pred as string), '</think>"
        "<bbox player=\"2\" player=\"3\">[1,2,3,4]</bbox><answer>spy=', cast(spy_pred as string), '</answer>') "
        "end as completion",
        "concat('<answer>spy=', cast(spy_gold as string), '; changed_attributes=', "
        "cast(count_gold as string), '</answer>') as solution",
    ], False),
    # One edited object per row: attributes before and after; every 97th part has an unknown color.
    "v_edits": ("lineitem", [
        "l_orderkey as scene_id", "l_linenumber as obj",
        "case when l_partkey % 97 = 0 then 'mauve' else " + pick("l_partkey", COLORS) + " end as before_color",
        pick("l_partkey", SHAPES) + " as before_shape", pick("l_partkey", SIZES) + " as before_size",
        pick("l_suppkey", MATERIALS) + " as before_material", pick("l_suppkey", COLORS) + " as after_color",
        pick("l_suppkey", SHAPES) + " as after_shape", pick("l_partkey", SIZES) + " as after_size",
        pick("l_suppkey + l_partkey", MATERIALS) + " as after_material",
        "l_quantity * 6 as px", "l_suppkey % 240 as py", "l_discount * 100 + 6 as depth",
    ], False),
    # Completions with change claims: right, repeated, misplaced, wrong, unbalanced, extra.
    "v_claim_texts": ("events", [
        "event_id as gen_index", "user_id as task_id",
        "concat('<think>', case when event_id % 6 = 2 then concat('<change>color:', " + pick("user_id", COLORS)
        + ", '->', " + pick("user_id + 3", COLORS) + ", '</change>') else 'Looked.' end, '</think>', "
        "case event_id % 6 when 0 then concat('<change>color:', " + pick("user_id", COLORS) + ", '->', "
        + pick("user_id + 3", COLORS) + ", '</change><change> Shape : " + "', " + pick("user_id", SHAPES)
        + ", ' -> ', " + pick("user_id + 1", SHAPES) + ", '</change>') "
        "when 1 then concat('<change>color:', " + pick("user_id", COLORS) + ", '->', " + pick("user_id + 3", COLORS)
        + ", '</change><change>color:', " + pick("user_id", COLORS) + ", '->', " + pick("user_id + 3", COLORS)
        + ", '</change>') "
        "when 3 then concat('<change>color:', " + pick("user_id", COLORS) + ", '->', "
        + pick("user_id + event_id", COLORS) + ", '</change>') "
        "when 4 then concat('<change>color:', " + pick("user_id", COLORS) + ", '->') "
        "when 5 then concat('<change>shape:', " + pick("user_id", SHAPES) + ", '->', " + pick("user_id + 1", SHAPES)
        + ", '</change><change>material:rubber->metal</change>') else '' end, "
        "'<answer>spy=1; changed_attributes=2</answer>', case when event_id % 6 = 5 then "
        "'<change>size:small->large</change>' else '' end) as completion",
    ], False),
    "v_claim_gold": ("events", [
        "user_id as task_id", pick("user_id", COLORS) + " as color_before", pick("user_id + 3", COLORS)
        + " as color_after", pick("user_id", SHAPES) + " as shape_before", pick("user_id + 1", SHAPES) + " as shape_after",
    ], True),
    # Subset proposals: the bits of mask are the kept edits of a five-edit scene.
    "v_proposals": ("events", [
        "event_id as proposal_id", "user_id as scene_id", "event_id % 31 + 1 as mask",
        "3 + event_id % 2 as num_players", "event_type as kind", "value / 500.0 as pass_rate",
    ], False),
    # Judge verdicts; some rows miss the target, some were never judged.
    "v_feedback": ("orders", [
        "o_orderkey as task_id", "o_custkey as scene_id", "o_orderkey % 9 <> 0 as judged",
        "o_orderkey % 4 <> 0 as accepted",
        "case when o_orderkey % 4 <> 0 then '' when o_orderkey % 8 = 0 then 'too_hard_for_difficulty_target' "
        "when o_orderkey % 12 = 0 then '' else 'low_solvability' end as reject_reason",
        "case when o_orderkey % 11 = 0 then null when o_orderstatus = 'F' then 'easy' when o_orderstatus = 'O' "
        "then 'medium' else 'hard' end as target",
        "case when o_orderkey % 13 = 0 then null when o_orderpriority like '1%' then 'hard' "
        "when o_orderpriority like '2%' then 'medium' else 'easy' end as suggested",
        "case when o_orderkey % 16 = 0 then 'reduce_difficulty' else '' end as reason",
        "cast(o_orderkey % 10 as bigint) as run_id",
    ], False),
}


# Views whose rows cost real work per text; a small table in one file would otherwise run in one task.
TEXT_VIEWS = {"v_texts", "v_claim_texts", "documents", "conversations"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, path: str) -> DataFrame:
    """Deal rows over all cores when the table is too small for its splits to do so."""
    spark = df.sparkSession
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    cores = spark.sparkContext.defaultParallelism
    small = fs.getContentSummary(hpath).getLength() < cores * 64 * 1024 * 1024
    return df.repartition(cores) if small and cores > 1 else df


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table or a derived view as a DataFrame."""
    return _build(spark, sf_dir, name, name in TEXT_VIEWS)


def _build(spark: SparkSession, sf_dir: str, name: str, text: bool) -> DataFrame:
    if name in TABLES:
        df = table(spark, sf_dir, name)
        return spread(df, f"{sf_dir}/{name}.parquet") if text else df
    source, exprs, distinct = VIEWS[name]
    df = _build(spark, sf_dir, source, text).selectExpr(*exprs)
    return df.distinct() if distinct else df


@lru_cache(maxsize=None)
def _chain(name: str) -> tuple[str, ...]:
    if name in TABLES:
        return ()
    return _chain(VIEWS[name][0]) + (name,)


def cte(*names: str) -> str:
    """`with v as (...), ...` text defining the named views for the SQL check."""
    order: list[str] = []
    for name in names:
        order.extend(n for n in _chain(name) if n not in order)
    parts = []
    for name in order:
        source, exprs, distinct = VIEWS[name]
        parts.append(f"{name} as (select {'distinct ' if distinct else ''}{', '.join(exprs)} from {source})")
    return "with " + ", ".join(parts) + " "


def with_sql(views: tuple[str, ...] | list[str] | str, body: str) -> str:
    """SQL text with the view definitions in front; `body` may start with further `name as (...)` parts."""
    names = (views,) if isinstance(views, str) else tuple(views)
    head = cte(*names)
    stripped = body.strip()
    if stripped.lower().startswith("with "):
        return head.rstrip() + ", " + stripped[5:]
    return head + stripped
