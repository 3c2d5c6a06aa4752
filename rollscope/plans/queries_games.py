"""Queries over game votes, clues and decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollscope.functions import games as G
from rollscope.operators import games, ordered, pairs
from rollscope.plans.catalog import register
from rollscope.plans.queries_stats import r9
from rollscope.sources.views import view, with_sql

PLAYERS = 7
VOTES_SQL = """
with votes as materialized (select game_id, voter, spy, case when voted = 0 then null else voted end as vote, voted = 0 and voter % 2 = 0 as na from v_votes),
tally as materialized (select game_id, max(spy) spy, count(*) cast_n, count(*) filter (where vote between 1 and 7) valid, count(*) filter (where na) nas,
 count(*) filter (where vote is null and not na) invalid from votes group by game_id),
rec as materialized (select t.game_id, t.spy, t.cast_n, t.valid, t.nas, t.invalid, p.player, coalesce(v.c, 0) as got from tally t cross join (select unnest(range(1, 8)) as player) p
 left join (select game_id, vote, count(*) c from votes where vote is not null group by 1, 2) v on v.game_id = t.game_id and v.vote = p.player)
"""


def votes(spark, sf):
    return view(spark, sf, "v_votes").selectExpr(
        "game_id", "voter", "spy", "if(voted = 0, null, voted) as vote", "voted = 0 and voter % 2 = 0 as na")


@register("vote_tally", with_sql("v_votes", VOTES_SQL + """
select game_id, cast(player as integer) player, got as votes, nas as na_votes, invalid as invalid_votes,
 round(case when valid > 0 then -0.5 * got / valid else 0 end, 9) as penalty from rec"""))
def vote_tally(spark, sf):
    return games.vote_tally(votes(spark, sf), PLAYERS).select(
        "game_id", "player", "votes", "na_votes", "invalid_votes", r9("penalty"))


@register("vote_rewards", with_sql("v_votes", VOTES_SQL + """
, got as materialized (select game_id, vote as player, count(*) c from votes where vote is not null group by 1, 2),
seen as (select game_id, voter, vote, na, spy, count(*) filter (where vote = spy) over g as on_spy, count(*) filter (where vote between 1 and 7) over g as valid,
 count(*) filter (where na) over g as nas from votes window g as (partition by game_id)),
r as (select v.game_id, v.voter, v.vote, v.na, case when v.voter = v.spy then
 1.0 - v.on_spy / 6.0 + 0.5 * (v.valid - v.on_spy + 0.5 * v.nas) / 6.0 - case when v.vote = v.spy then 1 else 0 end
 when v.vote is null and not v.na then -1.0
 else case when v.vote = v.spy then 1.0 else -1.0 end - 0.6 * coalesce(me.c, 0) / 6.0 end as raw
 from seen v left join got me on me.game_id = v.game_id and me.player = v.voter)
select game_id, voter, vote, round(greatest(-1.0, least(1.0, raw)), 9) as reward from r"""))
def vote_rewards(spark, sf):
    return games.vote_rewards(votes(spark, sf), PLAYERS).select("game_id", "voter", "vote", r9("reward"))


STRATEGIC_SQL = VOTES_SQL + """
, base as (select *, (valid - on_spy) / 6.0 as mean_civ from (select *, max(case when player = spy then got end) over (partition by game_id) as on_spy from rec) t),
strat as (select game_id, player, player = spy as is_spy, on_spy - mean_civ as psi, case when player = spy then -0.1 * (on_spy - mean_civ)
 else 0.1 * (on_spy - mean_civ) / 6.0 - 0.1 * (got - mean_civ) end as reward from base)
"""


@register("strategic_rewards", with_sql("v_votes", STRATEGIC_SQL + """
select game_id, cast(player as integer) player, is_spy, round(psi, 9) psi, round(reward, 9) reward from strat"""))
def strategic_rewards(spark, sf):
    return games.strategic_rewards(votes(spark, sf), PLAYERS).select("game_id", "player", "is_spy", r9("psi"), r9("reward"))


@register("role_ema", with_sql("v_votes", STRATEGIC_SQL + """
, roles as (select game_id, max(case when is_spy then reward end) s, avg(case when not is_spy then reward end) c, row_number() over (order by game_id) i from strat group by game_id)
select a.game_id, round(0.1 * sum(b.s * pow(0.9, a.i - b.i)), 9) as b_spy, round(a.s - 0.1 * sum(b.s * pow(0.9, a.i - b.i)), 9) as spy_adjusted,
 round(a.c - 0.1 * sum(b.c * pow(0.9, a.i - b.i)), 9) as civ_adjusted
from roles a join roles b on b.i between a.i - 420 and a.i group by a.game_id, a.s, a.c"""))
def role_ema(spark, sf):
    roles = games.game_roles(games.strategic_rewards(votes(spark, sf), PLAYERS))
    return games.role_ema(roles).select("game_id", r9("b_spy"), r9("spy_adjusted"), r9("civ_adjusted"))


@register("majority_vote", with_sql("v_votes", VOTES_SQL + """
, top as (select game_id, player from rec qualify row_number() over (partition by game_id order by got desc, player) = 1)
select t.game_id % 300 as step, count(*) as games, round(avg(case when t.valid > 0 and top.player = t.spy then 1.0 else 0.0 end), 9) as acc,
 round(avg(t.nas / t.cast_n), 9) as na, sum(t.cast_n) as votes_cast from tally t join top on t.game_id = top.game_id group by 1"""))
def majority_vote(spark, sf):
    g = games.majority_vote(votes(spark, sf), PLAYERS)
    return g.groupBy((F.col("game_id") % 300).alias("step")).agg(
        F.count(F.lit(1)).alias("games"), F.round(F.avg("correct"), 9).alias("acc"),
        F.round(F.avg("na_rate"), 9).alias("na"), F.sum("votes_cast").alias("votes_cast"))


@register("stage_switch", with_sql("v_votes", VOTES_SQL + """
, top as (select game_id, player from rec qualify row_number() over (partition by game_id order by got desc, player) = 1),
st as (select t.game_id % 10 as run_id, ((t.game_id - t.game_id % 10) // 10) % 300 as step, avg(case when t.valid > 0 and top.player = t.spy then 1.0 else 0.0 end) as acc,
 avg(t.nas / t.cast_n) as na from tally t join top on t.game_id = top.game_id group by 1, 2),
num as (select *, row_number() over (partition by run_id order by step) as i from st)
, sm as (select a.run_id, a.step, a.i, 0.05 * sum(b.acc * pow(0.95, a.i - b.i)) as ab, 0.05 * sum(b.na * pow(0.95, a.i - b.i)) as nb
 from num a join num b on a.run_id = b.run_id and b.i <= a.i group by 1, 2, 3),
fl as (select *, round(ab, 12) >= 0.15 and round(nb, 12) <= 0.09 as up, round(1 - ab, 12) >= 0.88 or round(nb, 12) >= 0.5 as down from sm),
walk as (with recursive w as (
 select run_id, i, step, ab, nb, 0 as stage, 1 as dwell, false as switched from fl where i = 1
 union all select f.run_id, f.i, f.step, f.ab, f.nb,
  case when (w.dwell + 1 >= 5 and case when w.stage = 0 then f.up else f.down end) or w.dwell + 1 >= 20 then 1 - w.stage else w.stage end,
  case when (w.dwell + 1 >= 5 and case when w.stage = 0 then f.up else f.down end) or w.dwell + 1 >= 20 then 0 else w.dwell + 1 end,
  (w.dwell + 1 >= 5 and case when w.stage = 0 then f.up else f.down end) or w.dwell + 1 >= 20
 from w join fl f on f.run_id = w.run_id and f.i = w.i + 1) select * from w)
select run_id, step, cast(stage as bigint) stage, switched, round(ab, 6) acc_bar, round(nb, 6) na_bar,
 case when step % 10 < 5 then 'decision' else 'clue' end as fixed_cycle from walk"""))
def stage_switch(spark, sf):
    g = games.majority_vote(votes(spark, sf), PLAYERS)
    steps = g.groupBy((F.col("game_id") % 10).alias("run_id"),
                      F.expr("((game_id - game_id % 10) div 10) % 300").alias("step")).agg(
        F.avg("correct").alias("acc"), F.avg("na_rate").alias("na"))
    out = ordered.stage_switch(steps, "run_id", "step", acc_up=0.15, na_down=0.09, err_up=0.88)
    return out.select("run_id", "step", "stage", "switched", r9("acc_bar", 6), r9("na_bar", 6),
                      ordered.cycle_stage(F.col("step"), 5).alias("fixed_cycle"))


@register("phase_normalize", with_sql("v_votes", STRATEGIC_SQL + """
, w as (select game_id, player, reward, avg(reward) over g as m, stddev_pop(reward) over g as s, max(reward) over g - min(reward) over g as rg from strat window g as (partition by game_id))
select game_id, cast(player as integer) player, round(case when s > 1e-8 and rg > 1e-8 then (reward - m) / (s + 1e-8) else reward - m end, 6) as normalized from w"""))
def phase_normalize(spark, sf):
    df = games.strategic_rewards(votes(spark, sf), PLAYERS)
    return games.phase_normalize(df, ["game_id"], "reward").select("game_id", "player", r9("normalized", 6))


@register("game_metrics", with_sql("v_rollouts_big", """
select coalesce(phase, 'overall') as phase, count(*) n, round(avg(reward_scalar), 9) as mean, round(stddev_pop(reward_scalar), 9) as std,
 min(reward_scalar) as min, max(reward_scalar) as max from (select case when slot % 2 = 0 then 'clue' else 'decision' end as phase, reward_scalar from v_rollouts_big)
group by grouping sets ((), (phase))"""))
def game_metrics(spark, sf):
    df = view(spark, sf, "v_rollouts_big").selectExpr("if(slot % 2 = 0, 'clue', 'decision') as phase", "reward_scalar")
    return games.game_metrics(df, "phase", "reward_scalar").select("phase", "n", r9("mean"), r9("std"), "min", "max")


REPLIES = ("case gen_index % 8 when 0 then concat('<think>they all look alike here</think><answer>', {v}, '</answer>') "
           "when 1 then '<think>not enough evidence</think><answer>n/a</answer>' "
           "when 2 then concat('long thoughts first ', chr(92), 'boxed{{', {v}, '}}') "
           "when 3 then concat('<answer>{{\"spy\": \"p\", \"reasoning\": \"x\"}}</answer>') "
           "when 4 then concat('<think>short</think><answer> Player ', {v}, ' I am sure') "
           "when 5 then concat('<think>the cube is gone now</think><answer>player ', {v}, ' not really sure about it</answer>') "
           "when 6 then '' else '<answer>no digits</answer>' end")
REPLY_EXPR = REPLIES.format(v="cast(spy_pred as string)")
REPLY_SQL = "with t as (select gen_index, spy_gold, spy_pred, " + REPLY_EXPR + " as reply from v_rollouts)"


def replies(spark, sf):
    return view(spark, sf, "v_rollouts").selectExpr("gen_index", "spy_gold", "spy_pred", "task_id", REPLY_EXPR + " as reply")


@register("vote_parse", with_sql("v_rollouts", REPLY_SQL + """
select gen_index, case when gen_index % 8 in (0, 2, 4, 5) then spy_pred end as vote, gen_index % 8 = 1 as na from t"""))
def vote_parse(spark, sf):
    r = F.col("reply")
    return replies(spark, sf).select("gen_index", G.vote(r).alias("vote"), G.is_na(G.reply_body(r)).alias("na"))


@register("clue_parse", with_sql("v_rollouts", REPLY_SQL + """
select gen_index, case gen_index % 8 when 2 then 'long thoughts first' when 3 then reply when 6 then '' when 7 then reply else regexp_extract(reply, '<think>(.*?)</think>', 1) end as thinking,
 case gen_index % 8 when 2 then cast(spy_pred as varchar) when 4 then 'Player ' || spy_pred || ' I am sure' when 6 then 'No valid clue provided.' else regexp_extract(reply, '<answer>(.*?)</answer>', 1) end as answer from t"""))
def clue_parse(spark, sf):
    return replies(spark, sf).select("gen_index", G.clue_thinking(F.col("reply")).alias("thinking"),
                                     G.clue_answer(F.col("reply")).alias("answer"))


@register("decision_format", with_sql("v_rollouts", REPLY_SQL + """
select gen_index, case gen_index % 8 when 0 then 1.0 when 1 then 1.0 when 2 then 0.0 when 3 then 0.2 when 4 then 0.3 when 5 then 0.7 when 6 then 0.0 else 0.2 end as decision,
 case gen_index % 8 when 0 then 1.0 when 1 then 1.0 when 2 then 1.0 when 3 then 0.3 when 4 then 0.3 when 5 then 0.7 when 6 then 0.0 else 0.3 end as basic,
 case gen_index % 8 when 0 then 1.0 when 1 then 1.0 when 2 then 0.0 when 3 then 0.3 when 4 then 0.5 when 5 then 1.0 when 6 then 0.0 else 0.3 end as phase from t"""))
def decision_format(spark, sf):
    r = F.col("reply")
    return replies(spark, sf).select("gen_index", G.decision_format(r).alias("decision"),
                                     G.basic_format(r).alias("basic"), G.phase_format(r).alias("phase"))


ACC_SQL = VOTES_SQL + """
, acc as (select game_id, voter, vote, na, spy, case when voter = spy then case when na then 0.2 when vote is null then -1.0 when vote = spy then -1.0 else 0.5 end
 else case when na then -0.5 when vote = spy then 1.0 else -1.0 end end as accuracy from votes)
"""


@register("decision_accuracy", with_sql("v_votes", ACC_SQL + """
select game_id, voter, vote, na, accuracy from acc"""))
def decision_accuracy(spark, sf):
    return votes(spark, sf).select("game_id", "voter", "vote", "na", G.decision_accuracy(
        F.col("vote"), F.col("na"), F.col("spy"), F.col("voter")).alias("accuracy"))


@register("decision_shaped", with_sql("v_votes", ACC_SQL + """
select game_id, voter, vote, na, round(0.3 * case when voter % 3 = 0 then -1 else 1 end + 1.2 * accuracy + case when accuracy > 0 then 0.99 else 0 end, 9) as player_reward,
 round(0.3 * case when voter % 3 = 0 then -1 else 1 end + case when na then -0.6 when vote = spy then 1.2 + 0.99 else -1.2 end, 9) as observer_reward from acc"""))
def decision_shaped(spark, sf):
    ok = F.col("voter") % 3 != 0
    v, na, spy = F.col("vote"), F.col("na"), F.col("spy")
    return votes(spark, sf).select(
        "game_id", "voter", "vote", "na",
        F.round(G.shaped_decision(ok, G.decision_accuracy(v, na, spy, F.col("voter"))), 9).alias("player_reward"),
        F.round(G.shaped_decision(ok, G.decision_accuracy(v, na, spy)), 9).alias("observer_reward"))


@register("potential_shaping", with_sql("v_votes", VOTES_SQL + """
select game_id, cast(player as integer) player, round(0.2 * case when player % 2 = 0 then 1 else -1 end - 0.99 * 0.5 * got / 6.0, 9) as clue_reward,
 round(0.2 * case when player % 2 = 0 then 1 else -1 end + case when got > 0 then 1.99 else -1.0 end, 9) as decision_reward from rec"""))
def potential_shaping(spark, sf):
    ok = F.col("player") % 2 == 0
    t = games.vote_tally(votes(spark, sf), PLAYERS)
    return t.select("game_id", "player",
                    F.round(G.potential_clue(ok, F.col("votes"), F.lit(PLAYERS)), 9).alias("clue_reward"),
                    F.round(G.potential_decision(ok, F.col("votes") > 0), 9).alias("decision_reward"))


CLUES = ("(event_id - event_id % 8) / 8 as game_id", "event_id % 8 as pos",
         "concat('The ', case event_id % 2 when 0 then 'large' else 'small' end, ' ', case user_id % 4 when 0 then 'red' when 1 then 'blue' "
         "when 2 then 'green' else 'mint' end, ' ', case event_id % 3 when 0 then 'cube' when 1 then 'sphere' else 'thing' end, "
         "case user_id % 5 when 0 then ' is left of it' when 1 then ' touching something' when 2 then ' the spy vote' else '' end) as clue")
CLUES_SQL = "with clues as (select event_id, " + ", ".join(CLUES) + " from events)"


def clues(spark, sf):
    return view(spark, sf, "events").selectExpr("event_id", *CLUES)


REP_SQL = CLUES_SQL + """
, w as (select *, lower(trim(clue)) as t, list_distinct(list_filter(string_split(lower(clue), ' '), lambda x: x <> '')) as ws from clues),
prs as (select a.game_id, a.pos, round(1.0 - levenshtein(a.t, b.t) / greatest(length(a.t), length(b.t)), 12) as sim,
 round(len(list_intersect(a.ws, b.ws)) / (len(a.ws) + len(b.ws) - len(list_intersect(a.ws, b.ws))), 12) as ov
 from w a join w b on a.game_id = b.game_id and b.pos < a.pos),
rep as (select w.game_id, w.pos, coalesce(sum(case when sim >= 0.7 then 0.8 when sim >= 0.5 then 0.4 when sim >= 0.3 then 0.2 else 0 end + case when ov >= 0.6 then 0.5 else 0 end), 0) as penalty
 from w left join prs p on w.game_id = p.game_id and w.pos = p.pos group by 1, 2)
"""


@register("clue_repetition", REP_SQL + "select game_id, pos, round(penalty, 9) as penalty from rep")
def clue_repetition(spark, sf):
    return pairs.clue_repetition(clues(spark, sf), "game_id", "pos", "clue").select("game_id", "pos", r9("penalty"))


def _in(words, text="low"):
    return " + ".join(f"contains({text}, '{w}')::int" for w in words)


@register("clue_content", CLUES_SQL + f"""
, l as (select event_id, lower(trim(clue)) as low, len(string_split(trim(clue), ' ')) as n from clues),
f as (select *, ({_in(G.COLORS)}) > 0 as c1, ({_in(G.SHAPES)}) > 0 as c2, ({_in(G.POSITIONS)}) > 0 as c3, ({_in(G.SIZES)}) > 0 as c4, ({_in(G.RELATIONS)}) > 0 as c5,
 {_in(G.LEAK_WORDS)} as leaks, {_in(G.VAGUE_PHRASES)} as vague from l),
k as (select *, c1::int + c2::int + c3::int + c4::int + c5::int as kinds from f),
s as (select event_id, 0.2 + 0.2 * c1::int + 0.25 * c2::int + 0.2 * c3::int + 0.15 * c4::int + 0.1 * c5::int + case when kinds >= 2 then 0.1 * (kinds - 1) else 0 end
 - 0.5 * leaks - 0.08 * vague - case when n < 4 or n > 20 then 0.1 else 0 end
 + 0.05 * regexp_matches(low, '\\b(larger|smaller|bigger|taller|shorter)\\s+than\\b')::int + 0.05 * regexp_matches(low, '\\bto the (left|right|front|behind)\\s+of\\b')::int
 + 0.05 * regexp_matches(low, '\\b(next to|beside|near|far from)\\b')::int + 0.05 * regexp_matches(low, '\\b(same|different)\\s+(color|size|shape)\\b')::int
 + 0.05 * (c1 and c2)::int as raw from k)
select event_id, round(greatest(0.0, least(1.0, raw - case event_id % 3 when 1 then 0.2 when 2 then 0.4 else 0 end)), 6) as score,
 round(greatest(0.0, least(1.0, raw - case event_id % 3 when 1 then 0.2 when 2 then 0.4 else 0 end))
  - case when event_id % 4 = 0 then 0 else 0.6 * (event_id % 4) / greatest(1, case when event_id % 5 = 0 then 3 else event_id % 5 - 1 end) end, 6) as voted from s""")
def clue_content(spark, sf):
    text = F.concat(F.lit("<think>I looked at every object</think><answer>"), F.col("clue"), F.lit("</answer>"))
    repetition = F.element_at(F.array(F.lit(0.0), F.lit(0.2), F.lit(0.4)), (F.col("event_id") % 3 + 1).cast("int"))
    scored = clues(spark, sf).select("event_id", G.clue_content(text, repetition).alias("s"))
    votes = F.when(F.col("event_id") % 4 > 0, F.col("event_id") % 4)
    voters = F.when(F.col("event_id") % 5 > 0, F.col("event_id") % 5)
    return scored.select("event_id", F.round("s", 6).alias("score"), F.round(G.clue_with_votes(F.col("s"), votes, voters), 6).alias("voted"))


@register("pairwise_jaccard", """
with t as (select conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')) as w from conversations),
p as (select a.conv_id, a.turn, count(b.turn) as n, sum(case when len(a.w) = 0 or len(b.w) = 0 then 0 else
 len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) end) as s
 from t a left join t b on a.conv_id = b.conv_id and a.turn <> b.turn group by 1, 2)
select conv_id, turn, round(case when n > 0 then s / n else 0 end, 9) as mean_jaccard from p""")
def pairwise_jaccard(spark, sf):
    from rollscope.functions.text import tokens

    df = view(spark, sf, "conversations").select(
        "conv_id", "turn", tokens(F.col("text")).alias("w"))
    return pairs.mean_sibling_jaccard(df, ["conv_id"], "turn", "w").select("conv_id", "turn", r9("mean_jaccard"))


@register("pairwise_evidence", f"""
{CLUES_SQL}, w as (select user_id, c.event_id, list_filter(list_distinct(regexp_extract_all(lower(clue), '[a-z0-9_]+')),
 lambda x: x in ('red', 'blue', 'green', 'cube', 'sphere', 'large', 'small')) as k from clues c join events e on c.event_id = e.event_id),
p as (select a.user_id, a.event_id, len(a.k) as own, count(b.event_id) as n, sum(case when len(a.k) = 0 or len(b.k) = 0 then 0 else
 len(list_intersect(a.k, b.k)) / (len(a.k) + len(b.k) - len(list_intersect(a.k, b.k))) end) as s
 from w a left join w b on a.user_id = b.user_id and a.event_id <> b.event_id group by 1, 2, 3)
select user_id, event_id, round(case when n = 0 then 1 when own = 0 then 0 else s / n end, 9) as evidence from p""")
def pairwise_evidence(spark, sf):
    from rollscope.functions.rewards import EVIDENCE_WORDS
    from rollscope.functions.text import tokens

    words = F.array(*[F.lit(w) for w in EVIDENCE_WORDS])
    df = view(spark, sf, "events").selectExpr("user_id", "event_id", CLUES[2]).select(
        "user_id", "event_id", F.array_intersect(tokens(F.col("clue")), words).alias("k"))
    return pairs.mean_sibling_evidence(df, ["user_id"], "event_id", "k").select("user_id", "event_id", r9("evidence"))


@register("basic_format", with_sql("v_rollouts", REPLY_SQL + """
select gen_index, case gen_index % 8 when 0 then 1.0 when 1 then 1.0 when 2 then 1.0 when 3 then 0.3 when 4 then 0.3 when 5 then 0.7 when 6 then 0.0 else 0.3 end as score from t"""))
def basic_format(spark, sf):
    return replies(spark, sf).select("gen_index", G.basic_format(F.col("reply")).alias("score"))


# Predicted boxes of a clue: none in every third group, none in every seventh row, else one to three.
BOX_COLUMN = """if(user_id % 3 = 0 or event_id % 7 = 0, null, transform(sequence(0, cast(event_id % 3 as int)), k -> array(
 double((event_id * 37 + k * 53) % 260), double((event_id * 11 + k * 29) % 180), double((event_id * 37 + k * 53) % 260 + 20 + event_id * 7 % 60),
 double((event_id * 11 + k * 29) % 180 + 20 + (event_id + k) * 5 % 50)))) as boxes"""
BOX_EVIDENCE_SQL = """
bx as (select user_id, event_id, k, event_id % 3 + 1 as nb, (event_id * 37 + k * 53) % 260 as x1, (event_id * 11 + k * 29) % 180 as y1, (event_id * 37 + k * 53) % 260 + 20 + event_id * 7 % 60 as x2,
 (event_id * 11 + k * 29) % 180 + 20 + (event_id + k) * 5 % 50 as y2 from events, range(0, 3) q(k) where user_id % 3 <> 0 and event_id % 7 <> 0 and k <= event_id % 3),
pairs as (select a.user_id, a.event_id, g.event_id as sib, g.k, g.nb, greatest(0, least(a.x2, g.x2) - greatest(a.x1, g.x1)) * greatest(0, least(a.y2, g.y2) - greatest(a.y1, g.y1)) as inter,
 (a.x2 - a.x1) * (a.y2 - a.y1) + (g.x2 - g.x1) * (g.y2 - g.y1) as areas from bx a join bx g on a.user_id = g.user_id and a.event_id <> g.event_id),
tops as (select user_id, event_id, sib, k, any_value(nb) as nb, max(inter / (areas - inter)) as top from pairs group by 1, 2, 3, 4),
seen as (select user_id, event_id, sum(top / nb) / count(distinct sib) as ev from tops group by 1, 2),
grp as (select user_id, count(*) as members, count(*) filter (where user_id % 3 <> 0 and event_id % 7 <> 0) as given from events group by 1)
"""


@register("pairwise_box_evidence", f"""
{CLUES_SQL}, {BOX_EVIDENCE_SQL}, w as (select user_id, c.event_id, list_filter(list_distinct(regexp_extract_all(lower(clue), '[a-z0-9_]+')),
 lambda x: x in ('red', 'blue', 'green', 'cube', 'sphere', 'large', 'small')) as ks from clues c join events e on c.event_id = e.event_id),
p as (select a.user_id, a.event_id, len(a.ks) as own, count(b.event_id) as n, sum(case when len(a.ks) = 0 or len(b.ks) = 0 then 0 else
 len(list_intersect(a.ks, b.ks)) / (len(a.ks) + len(b.ks) - len(list_intersect(a.ks, b.ks))) end) as s
 from w a left join w b on a.user_id = b.user_id and a.event_id <> b.event_id group by 1, 2, 3)
select p.user_id, p.event_id, case when grp.given > 0 then 'boxes' else 'words' end as method,
 round(case when members = 1 then 1 when grp.given > 0 then coalesce(seen.ev, 0) when own = 0 then 0 else s / n end, 9) as evidence
from p join grp on grp.user_id = p.user_id left join seen on seen.user_id = p.user_id and seen.event_id = p.event_id""")
def pairwise_box_evidence(spark, sf):
    from rollscope.functions.rewards import EVIDENCE_WORDS
    from rollscope.functions.text import tokens

    words = F.array(*[F.lit(w) for w in EVIDENCE_WORDS])
    df = view(spark, sf, "events").selectExpr("user_id", "event_id", CLUES[2], BOX_COLUMN).select(
        "user_id", "event_id", F.array_intersect(tokens(F.col("clue")), words).alias("k"), "boxes")
    return pairs.sibling_evidence(df, ["user_id"], "event_id", "k", "boxes").select("user_id", "event_id", "method", r9("evidence"))
