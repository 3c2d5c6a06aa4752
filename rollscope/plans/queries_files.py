"""Queries through file sources and sinks: rows are written out and scanned back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructType

from rollscope.operators import exports
from rollscope.plans.catalog import register
from rollscope.plans.queries_stats import ROUTE_SQL, r9, routed
from rollscope.session import cut_lineage
from rollscope.sources import files as S
from rollscope.sources.views import view, with_sql

ROLLOUT = StructType().add("gen_index", LongType()).add("task_id", LongType()).add("kind", StringType()).add(
    "reward_scalar", DoubleType())
PLAIN = "select gen_index, task_id, kind, round(reward_scalar, 9) as reward_scalar from v_rollouts"


def _rollouts(spark, sf):
    return view(spark, sf, "v_rollouts").select("gen_index", "task_id", "kind", "reward_scalar")


@register("scan_jsonl", with_sql("v_rollouts", PLAIN))
def scan_jsonl(spark, sf):
    path = S.scratch(spark, "jsonl")
    _rollouts(spark, sf).write.json(path)
    return S.scan_jsonl(spark, path, ROLLOUT).select("gen_index", "task_id", "kind", r9("reward_scalar"))


@register("scan_jsonl_tolerant", with_sql("v_rollouts", PLAIN + " where kind <> 'error'"))
def scan_jsonl_tolerant(spark, sf):
    path = S.scratch(spark, "tolerant")
    rows = _rollouts(spark, sf)
    line = F.to_json(F.struct(*rows.columns))
    rows.select(F.when(F.col("kind") == "error", F.substring(line, 1, 12)).otherwise(line).alias("value")).write.text(path)
    good = S.scan_jsonl_tolerant(spark, path, ROLLOUT)
    none = S.scan_jsonl_tolerant(spark, path + "-missing", ROLLOUT)
    return good.unionByName(none).select("gen_index", "task_id", "kind", r9("reward_scalar"))


@register("scan_scene_docs", """
select l_orderkey % 25 as doc, count(*) as objects, cast(sum(l_partkey % 8) as bigint) as colors from lineitem group by 1""")
def scan_scene_docs(spark, sf):
    path = S.scratch(spark, "scenes")
    # One multi-line document per file: a pretty JSON array of objects per scene bucket.
    objs = view(spark, sf, "lineitem").select((F.col("l_orderkey") % 25).alias("doc"), (F.col("l_partkey") % 8).alias("color"))
    parts = objs.groupBy("doc", "color").agg(F.count(F.lit(1)).alias("cnt"))
    docs = parts.groupBy("doc").agg(F.collect_list(F.struct("color", "cnt")).alias("objects"))
    docs.select("doc", F.to_json(F.struct("objects"), {"pretty": "true"}).alias("value")).write.partitionBy("doc").text(path)
    out = S.scan_scene_docs(spark, path, "objects array<struct<color:bigint,cnt:bigint>>, doc bigint")
    rows = out.select("doc", F.inline("objects"))
    return rows.groupBy("doc").agg(F.sum("cnt").alias("objects"), F.sum(F.col("color") * F.col("cnt")).alias("colors"))


@register("discover_pairs", """
select 'scene' || p_partkey as base_name from part where p_size > 5 and p_retailprice > 950 and p_brand <> (select min(p_brand) from part)""")
def discover_pairs(spark, sf):
    # A file listing as a table: every part has an original, a modified and a scene file, some of them absent.
    low = view(spark, sf, "part").agg(F.min("p_brand")).scalar()
    name = F.concat(F.lit("scene"), F.col("p_partkey").cast("string"))
    path = lambda folder, end: F.concat(F.lit(folder), name, F.lit(end)).alias("path")
    listing = view(spark, sf, "part").select(F.inline(F.array(
        F.struct(path("/data/img/", "_original.png"), (F.col("p_size") > 5).alias("there")),
        F.struct(path("/data/img/", "_modified.png"), (F.col("p_retailprice") > 950).alias("there")),
        F.struct(path("/data/scenes/", "_comparison.json"), (F.col("p_brand") != low).alias("there")))))
    return S.discover_pairs(listing.filter("there"))


@register("manifest_union_sample", with_sql("v_rollouts", """
with s as (select gen_index, kind, row_number() over (partition by kind order by gen_index) a, row_number() over (partition by kind order by gen_index desc) d,
 row_number() over (partition by kind order by sha256('3|' || gen_index)) h, count(*) over (partition by kind) n from v_rollouts)
select gen_index, kind from s where kind = 'view' or (kind = 'click' and a <= 100) or (kind = 'error' and d <= 50) or (kind = 'signup' and h <= 70) or (kind = 'purchase' and a <= ceil(n * 0.25))"""))
def manifest_union_sample(spark, sf):
    r = _rollouts(spark, sf)
    rules = {"view": "all", "click": "first:100", "error": "end:50", "signup": "random:70", "purchase": "first:25%"}
    entries = [S.ManifestEntry(r.filter(F.col("kind") == k), rule) for k, rule in rules.items()]
    return S.manifest_union_sample(entries, "gen_index", "gen_index", 3).select("gen_index", "kind")


@register("manifest_with_method", with_sql("v_rollouts", """
select gen_index, coalesce(case when gen_index % 3 = 0 then 'mcq' end, case when kind = 'view' then 'yes_no' else 'default' end) as method,
 case when kind = 'view' then '/a/' else '/b/' end || gen_index || '.png' as image from v_rollouts"""))
def manifest_with_method(spark, sf):
    r = _rollouts(spark, sf).select("gen_index", "kind", F.when(F.col("gen_index") % 3 == 0, F.lit("mcq")).alias("method"),
                                    F.array(F.concat(F.col("gen_index").cast("string"), F.lit(".png"))).alias("image"))
    out = S.manifest_with_method([
        S.ManifestEntry(r.filter("kind = 'view'"), folder="/a", method="yes_no"),
        S.ManifestEntry(r.filter("kind <> 'view'"), folder="/b/", method="default")], "method", "image")
    return out.select("gen_index", "method", F.get("image", F.lit(0)).alias("image"))


@register("conversation_reshape", with_sql("v_rollouts", """
select gen_index, 'What is ' || kind || '?' as problem, kind as solution, case when gen_index % 2 = 0 then '/root/a.png' else '/root/a.png,/root/b.png' end as images from v_rollouts"""))
def conversation_reshape(spark, sf):
    r = _rollouts(spark, sf).select(
        "gen_index", F.array(F.concat(F.lit("<image>\nWhat is "), "kind", F.lit("?")),
                             F.concat(F.lit("<answer>"), "kind", F.lit("</answer>"))).alias("talk"),
        F.when(F.col("gen_index") % 2 == 0, F.array(F.lit("a.png"))).otherwise(F.array(F.lit("a.png"), F.lit("b.png"))).alias("image"))
    out = S.conversation_reshape(r, "talk", "image", "/root")
    return out.select("gen_index", "problem", "solution", F.array_join("image_path", ",").alias("images"))


@register("sink_jsonl_atomic", with_sql("v_rollouts", PLAIN + " where kind = 'view'"))
def sink_jsonl_atomic(spark, sf):
    path = S.scratch(spark, "atomic")
    r = _rollouts(spark, sf)
    S.sink_jsonl_atomic(r, path)
    S.sink_jsonl_atomic(r.filter("kind = 'view'"), path)
    return S.scan_jsonl(spark, path, ROLLOUT).select("gen_index", "task_id", "kind", r9("reward_scalar"))


@register("sink_buffers", with_sql("v_vectors", ROUTE_SQL + "select gen_index, task_id, buffer from buffered"))
def sink_buffers(spark, sf):
    path = S.scratch(spark, "buffers")
    S.sink_buffers(routed(spark, sf).select("gen_index", "task_id", "buffer"), path)
    return spark.read.schema("gen_index bigint, task_id bigint, buffer string").json(path)


@register("sink_training_export", with_sql("v_vectors", ROUTE_SQL + """
select 'positive' as part, count(*) cnt from buffered where buffer = 'positive' union all select 'proposer', count(*) from buffered where kind = 'view' union all select 'grpo', count(*) from orders"""))
def sink_training_export(spark, sf):
    r = routed(spark, sf)
    grpo = exports.grpo_rows(_grpo_tasks(spark, sf))
    return S.sink_training_export({
        "positive": r.filter("buffer = 'positive'").select("gen_index"),
        "proposer": r.filter("kind = 'view'").select("gen_index")}, grpo, S.scratch(spark, "export"))


def _grpo_tasks(spark, sf):
    return view(spark, sf, "orders").selectExpr(
        "cast(o_orderkey as string) as task_id", "concat('Q', o_orderkey) as problem", "concat('<answer>', o_orderkey % 7, '</answer>') as solution",
        "if(o_orderkey % 3 = 0, array('a.png'), null) as image", "if(o_orderkey % 5 = 0, 'verified_count_qa', 'clevr_spy') as kind",
        "o_orderkey % 7 as gold_count", "concat('p', o_orderkey div 2) as pair_id",
        "array(array(double(o_orderkey % 300), 10D, double(o_orderkey % 300 + 40), 90D), array(5D, 5D, 50D, 60D)) as boxes", "if(o_orderkey % 11 = 0, 0, 320) as width",
        "240 as height", "o_orderkey % 9 as players", "nullif(o_orderkey % 6, 0) as spy")


@register("grpo_rows", """
select cast(o_orderkey as varchar) as task_id, case when o_orderkey % 3 = 0 then '<image>' || chr(10) else '' end || 'Q' || o_orderkey as human, '<answer>' || o_orderkey % 7 || '</answer>' as gpt,
 case when o_orderkey % 5 = 0 then 'verified_count_qa' else 'clevr_spy' end as task_kind, case when o_orderkey % 5 = 0 then o_orderkey % 7 end as gold_count, case when o_orderkey % 5 = 0 then 'p' || o_orderkey // 2 else '' end as pair_id,
 case when o_orderkey % 11 <> 0 and o_orderkey % 300 + 40 <= 320 and o_orderkey % 9 between 2 and 8 and (o_orderkey % 6 = 0 or o_orderkey % 6 <= o_orderkey % 9)
  then (o_orderkey % 300)::varchar || ',5' else '' end as box_lefts,
 case when not (o_orderkey % 9 between 2 and 8 and (o_orderkey % 6 = 0 or o_orderkey % 6 <= o_orderkey % 9)) then '' when o_orderkey % 6 > 0 then (o_orderkey % 6)::varchar
  else array_to_string(range(1, o_orderkey % 9 + 1), ',') end as players, 320 as width from orders""")
def grpo_rows(spark, sf):
    out = exports.grpo_rows(_grpo_tasks(spark, sf))
    return out.select("task_id", F.col("conversations")[0]["value"].alias("human"), F.col("conversations")[1]["value"].alias("gpt"),
                      F.col("context.task_kind").alias("task_kind"), F.col("context.verified_qa.gold_count").alias("gold_count"),
                      F.col("context.verified_qa.pair_id").alias("pair_id"),
                      F.array_join(F.transform("context.grounding.gold_boxes", lambda b: b[0].cast("int").cast("string")), ",").alias("box_lefts"),
                      F.array_join(F.col("context.grounding.valid_players").cast("array<string>"), ",").alias("players"),
                      F.col("context.grounding.image_width").alias("width"))


@register("scan_step_dumps", with_sql("v_rollouts", """
select gen_index % 4 as global_step, gen_index % 2 as rank, count(*) n, round(sum(reward_scalar), 6) total from v_rollouts group by 1, 2"""))
def scan_step_dumps(spark, sf):
    path = S.scratch(spark, "dumps")
    r = _rollouts(spark, sf)
    marked = r.withColumns({"step": F.concat(F.lit("step_"), F.col("gen_index") % 4), "rank": F.concat(F.lit("rank"), F.col("gen_index") % 2)})
    marked.write.partitionBy("step", "rank").json(path)
    out = S.scan_step_dumps(spark, path, ROLLOUT)
    return out.groupBy("global_step", "rank").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("reward_scalar"), 6).alias("total"))


@register("union_rounds", with_sql("v_rollouts", """
select gen_index % 5 as round, count(*) n, count(distinct task_id) tasks from v_rollouts group by 1"""))
def union_rounds(spark, sf):
    path = S.scratch(spark, "rounds")
    _rollouts(spark, sf).withColumn("round", F.col("gen_index") % 5).write.partitionBy("round").json(path)
    out = spark.read.schema("gen_index bigint, task_id bigint, round bigint").json(path)
    per = out.groupBy("round", "task_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("round").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("tasks"))


@register("scan_scores", """
select cast(doc_id as varchar) as split, lang || ', "' || source || '"' as note, cast(n_chars as varchar) as overall from documents""")
def scan_scores(spark, sf):
    path = S.scratch(spark, "scores")
    d = view(spark, sf, "documents").selectExpr(
        "cast(doc_id as string) as split", "concat(lang, ', \"', source, '\"') as note", "cast(n_chars as string) as overall")
    d.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    return S.scan_table(spark, path, "csv", ["split", "note", "overall"])


@register("scan_predictions", "select cast(doc_id as varchar) as idx, lang as prediction from documents")
def scan_predictions(spark, sf):
    path = S.scratch(spark, "preds")
    d = view(spark, sf, "documents").selectExpr("cast(doc_id as string) as idx", "lang as prediction")
    # A split-JSON document per block of at most 256 rows: column names once, data as arrays.
    blocks = d.groupBy(F.floor(F.col("idx").cast("bigint") / 256).alias("b")).agg(F.collect_list(F.array("idx", "prediction")).alias("data"))
    blocks.select(F.array(F.lit("idx"), F.lit("prediction")).alias("columns"), "data").write.json(path)
    doc = spark.read.schema("columns array<string>, data array<array<string>>").json(path)
    rows = doc.select(F.explode(F.transform("data", lambda r: F.map_from_arrays(F.col("columns"), r))).alias("r"))
    return rows.select(F.col("r")["idx"].alias("idx"), F.col("r")["prediction"].alias("prediction"))


@register("file_fingerprint")
def file_fingerprint(spark, sf):
    return S.file_fingerprints(spark, sf, "*.parquet").orderBy("file_name")


@register("latest_status_files", """
with c as (select c_nationkey as cell, count(*) as customers from customer group by 1),
l as (select *, case when cell % 3 = 0 then 2 when cell % 5 <> 0 then 1 end as run from c)
select cell, run, case when run is not null and not (run = 2 and cell % 9 = 6) then customers end as customers,
 case when run is null then 'no status from this run' when run = 2 and cell % 9 = 6 then 'unreadable status'
 when run = 2 and cell % 6 = 0 then 'another model' when run = 1 and cell % 4 = 1 then 'another mode' end as problem from l""")
def latest_status_files(spark, sf):
    # Two runs leave status files; the second covers some cells. Some files of the first were there before.
    folder = S.scratch(spark, "statuses")
    per = view(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("cell")).agg(F.count(F.lit(1)).alias("customers"))

    def leave(rows, run):
        model = F.when((F.lit(run) == 2) & (F.col("cell") % 6 == 0), F.lit("other")).otherwise(F.lit("base"))
        mode = F.when(F.col("cell") % 2 == 0, F.lit(None)).when(
            (F.lit(run) == 1) & (F.col("cell") % 4 == 1), F.lit("infer")).otherwise(F.lit("all"))
        doc = F.to_json(F.struct(model.alias("model_name"), mode.alias("mode"), "customers"))
        broken = (F.lit(run) == 2) & (F.col("cell") % 9 == 6)
        text = F.when(broken, F.lit("{")).otherwise(doc)
        rows.select("cell", text.alias("value")).write.partitionBy("cell").text(f"{folder}/run={run}")

    leave(per, 1)
    before = cut_lineage(S.list_files(spark, folder, "*.txt").filter(
        F.regexp_extract("path", r"cell=(\d+)", 1).cast("bigint") % 5 == 0))
    leave(per.filter("cell % 3 = 0"), 2)
    cells = {"cell": F.regexp_extract("path", r"cell=(\d+)", 1).cast("bigint")}
    latest = S.latest_artifacts(S.list_files(spark, folder, "*.txt"), cells, previous=before)
    expected = per.select("cell", F.lit("base").alias("model_name"), F.lit("all").alias("mode"))
    out = S.run_statuses(expected, latest, S.read_documents(spark, folder, "*.txt"), ["cell"],
                         "model_name string, mode string, customers bigint")
    run = F.when(F.col("path").isNotNull(), F.regexp_extract("path", r"run=(\d+)", 1).cast("int"))
    return out.select("cell", run.alias("run"), F.col("status.customers").alias("customers"), "problem")
