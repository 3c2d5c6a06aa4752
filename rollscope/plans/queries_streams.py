"""Streaming jobs run over the event tables until the input is used up; results equal the batch ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollscope.operators import exports, games, gates, skew
from rollscope.plans.catalog import register
from rollscope.plans.queries_checks import RAW
from rollscope.plans.queries_games import PLAYERS, STRATEGIC_SQL, votes
from rollscope.plans.queries_stats import ROUTE_SQL, r9
from rollscope.sources.files import scratch
from rollscope.sources.views import view, with_sql
from rollscope.streaming import jobs as J


def landed(df, spark, name: str, files: int = 6) -> tuple[str, str]:
    """Write a table as several arriving files; returns the folder and its schema."""
    path = scratch(spark, name)
    df.repartition(files).write.parquet(path)
    return path, df.schema


def vectors(spark, sf):
    return view(spark, sf, "v_vectors").withColumn("ts", F.col("ts").cast("timestamp"))


@register("stream_score", with_sql("v_vectors", ROUTE_SQL + "select gen_index, task_id, buffer, routing_reason from buffered"))
def stream_score(spark, sf):
    src, schema = landed(vectors(spark, sf), spark, "score-in")
    out, ck = scratch(spark, "score-out"), scratch(spark, "score-ck")
    score = lambda b: gates.tag_and_route(b, min_facts=0.5).select("gen_index", "task_id", "buffer", "routing_reason")
    # Two runs on one checkpoint: the second finds nothing new, as after a restart.
    for _ in range(2):
        J.drain(J.stream_score(J.file_stream(spark, src, schema, "parquet", 2), score, out, ck))
    return spark.read.parquet(out).drop("batch")


@register("resume_guard", with_sql("v_vectors", """
select task_id, count(*) as expected, count(*) filter (where gen_index % 50 <> 7) as actual from v_vectors group by 1 having count(*) filter (where gen_index % 50 <> 7) not in (0, count(*))"""))
def resume_guard(spark, sf):
    v = vectors(spark, sf)
    marker = scratch(spark, "protocol")
    J.resume_guard(v.select("gen_index", "task_id"), {"weights": "v1"}, marker)
    J.resume_guard(v.select("gen_index", "task_id"), {"weights": "v1"}, marker)
    # A sink that lost some rollouts: its groups are reported before anything resumes.
    done = v.filter(F.col("gen_index") % 50 != 7).select("task_id")
    return J.partial_groups(done, v.select("task_id"))


@register("stage_restore_check", """
select 'documents' as table_name, (select count(*) from documents) as rows_now, (select count(*) from documents) as rows_stored, true as consistent
union all select 'labels', (select count(*) from labels), (select count(*) + 1 from labels), false""")
def stage_restore_check(spark, sf):
    from rollscope.operators.checks import dataset_fingerprint

    d, lab = view(spark, sf, "documents").select("doc_id", "n_chars"), view(spark, sf, "labels")
    stored = dataset_fingerprint(d).withColumn("table_name", F.lit("documents")).unionByName(
        dataset_fingerprint(lab).withColumn("table_name", F.lit("labels")).withColumn("n", F.col("n") + 1))
    return J.stage_restore_check({"documents": d, "labels": lab}, stored)


@register("stream_feedback", """
select o_orderkey as task_id, o_orderkey % 3 <> 0 as accepted, case when o_orderkey % 6 = 0 then 'too hard' when o_orderkey % 3 = 0 then 'rejected' else '' end as reject_reason from orders""")
def stream_feedback(spark, sf):
    src, schema = landed(view(spark, sf, "orders").selectExpr("o_orderkey as task_id", RAW), spark, "fb-in", 4)
    # A trigger takes two files, whatever their size: their rows are dealt over all cores before they are parsed.
    arrived = J.file_stream(spark, src, schema, "parquet", 2).repartition(max(2, spark.sparkContext.defaultParallelism))
    rows = arrived.select("task_id", exports.verdict_normalize(F.col("raw")).alias("v")).select(
        "task_id", "v.accepted", "v.reject_reason")
    out = scratch(spark, "fb-out")
    J.drain(J.stream_append(rows, out, scratch(spark, "fb-ck")))
    return spark.read.parquet(out)


@register("stream_breakdown", with_sql("v_vectors", """
select kind, count(*) samples, round(avg(answer), 9) mean_answer, round(avg(grounding), 9) mean_grounding from v_vectors group by kind"""))
def stream_breakdown(spark, sf):
    src, schema = landed(vectors(spark, sf), spark, "bd-in")
    out = scratch(spark, "bd-out")
    J.drain(J.stream_breakdown(J.file_stream(spark, src, schema, "parquet", 2), ["answer", "grounding"], out, scratch(spark, "bd-ck")))
    last = spark.read.parquet(out)
    newest = last.agg(F.max("batch")).scalar()
    return last.filter(F.col("batch") == newest).select("kind", "samples", r9("mean_answer"), r9("mean_grounding"))


@register("stream_group_close", with_sql("v_rollouts", """
with g as (select task_id || '-' || (row_number() over (partition by task_id order by gen_index) - 1) // 16 as group_id, reward_scalar from v_rollouts)
select group_id, count(*) n, round(avg(reward_scalar), 9) mean_reward, round(stddev_samp(reward_scalar), 8) std_reward, max(reward_scalar) max_reward,
 case when count(*) = 16 then 'complete' else 'incomplete' end as status from g group by 1"""))
def stream_group_close(spark, sf):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", J.STATE_PROVIDER)
    r = view(spark, sf, "v_rollouts").select("task_id", "gen_index", "reward_scalar", F.col("ts").cast("timestamp").alias("ts"))
    numbered = skew.number_rows_by_key(r, ["task_id"], [F.col("gen_index")], "rn")
    rows = numbered.select(F.concat(F.col("task_id").cast("string"), F.lit("-"), F.floor((F.col("rn") - 1) / 16).cast("string"))
                           .alias("group_id"), "reward_scalar", "ts")
    src, schema = landed(rows, spark, "close-in", 4)
    out, ck = scratch(spark, "close-out"), scratch(spark, "close-ck")

    def drain() -> None:
        closed = J.group_close(J.file_stream(spark, src, schema, "parquet", 2), 16, lateness="60 days", stale_ms=90 * 86_400_000)
        J.drain(J.stream_append(closed, out, ck))

    drain()
    # Time goes on: rows of a later season move the watermark, and its timers close the groups that lost rollouts.
    later = rows.agg(F.max("ts").alias("ts")).select(
        F.lit("later").alias("group_id"), F.lit(0.0).alias("reward_scalar"), (F.col("ts") + F.expr("interval 400 days")).alias("ts"))
    for _ in range(2):
        later.write.mode("append").parquet(src)
        drain()
    return spark.read.parquet(out).filter("group_id <> 'later'").select(
        "group_id", "n", r9("mean_reward"), r9("std_reward", 8), "max_reward", "status")


RUNS = 32


@register("stream_role_ema", with_sql("v_votes", STRATEGIC_SQL + f"""
, roles as (select game_id, game_id % {RUNS} as run_id, max(case when is_spy then reward end) s,
 row_number() over (partition by game_id % {RUNS} order by game_id) i from strat group by game_id)
select a.run_id, a.game_id, round(0.1 * sum(b.s * pow(0.9, a.i - b.i)) + 3e-13, 8) as b_spy, round(a.s - 0.1 * sum(b.s * pow(0.9, a.i - b.i)) + 3e-13, 8) as spy_adjusted
from roles a join roles b on a.run_id = b.run_id and b.i between a.i - 420 and a.i group by a.run_id, a.game_id, a.s"""))
def stream_role_ema(spark, sf):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", J.STATE_PROVIDER)
    roles = games.game_roles(games.strategic_rewards(votes(spark, sf), PLAYERS)).select(
        (F.col("game_id") % RUNS).alias("run_id"), "game_id", "spy_reward")
    half = roles.agg(F.percentile_approx("game_id", 0.5)).first()[0]
    src, out, ck = scratch(spark, "ema-in"), scratch(spark, "ema-out"), scratch(spark, "ema-ck")
    # The games arrive in two lots; every run's baseline survives the restart in between.
    for early in (True, False):
        roles.filter((F.col("game_id") <= half) == F.lit(early)).write.mode("append").parquet(src)
        rows = J.file_stream(spark, src, "run_id bigint, game_id bigint, spy_reward double", "parquet", 1000)
        J.drain(J.stream_append(J.role_baseline(rows), out, ck))
    # The first values of a run are short decimals: a shift keeps them off the halves where two sums may round apart.
    off = lambda c: F.round(F.col(c) + 3e-13, 8).alias(c)
    return spark.read.parquet(out).select("run_id", "game_id", off("b_spy"), off("spy_adjusted"))


@register("stream_reward_windows", with_sql("v_rollouts", """
select date_trunc('day', ts) as window_start, kind, count(*) n, round(avg(reward_scalar), 9) mean_reward from v_rollouts group by 1, 2
having date_trunc('day', ts) + interval 1 day <= (select max(ts) from v_rollouts) - interval 2 hour"""))
def stream_reward_windows(spark, sf):
    r = view(spark, sf, "v_rollouts").select("kind", "reward_scalar", F.col("ts").cast("timestamp").alias("ts"))
    src, schema = landed(r, spark, "win-in", 1)
    out = scratch(spark, "win-out")
    J.drain(J.stream_append(J.reward_health(J.file_stream(spark, src, schema, "parquet")), out, scratch(spark, "win-ck")))
    return spark.read.parquet(out).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "kind", "n", r9("mean_reward"))
