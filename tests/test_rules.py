"""Known answers for parsing, scoring, classes, configuration and sinks."""

import difflib

import pytest
from pyspark.sql import functions as F

from rollscope.functions import boxes as B
from rollscope.functions import facts as FX
from rollscope.functions import rewards as R
from rollscope.functions import text as T
from rollscope.operators import checks, curriculum, ranking, stats
from rollscope.plans import scoring
from rollscope.sources import files


def column(spark, texts, fn):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in df.select("i", fn(F.col("t")).alias("v")).orderBy("i").collect()]


def test_reasoning_steps(spark):
    texts = ["1. look\n2. compare\n3. decide", "- a thing\n- b thing", "Step 1: one\nStep 2: two", "First part. Second part! Ok.", "single", ""]
    assert column(spark, texts, T.reasoning_steps) == [
        ["look", "compare", "decide"], ["a thing", "b thing"], ["one", "two"], ["First part.", "Second part!"], ["single"], []]


@pytest.mark.parametrize("text, error", [
    ('<bbox player="2">[1,2,3,4]</bbox>', None),
    ('<bbox player="2" x1="1,2,3,4"></bbox>', None),
    ("<bbox player=2 coords='1,2,3,4'>[1,2,3,4]</bbox>", None),
    ('<bbox player="2" coords="1,2,3,5">[1,2,3,4]</bbox>', "conflicting_coords"),
    ('<bbox player="1" player="2">[1,2,3,4]</bbox>', "conflicting_player_ids"),
    ('<bbox player="2" x1="1" y1="2"></bbox>', "incomplete_coords"),
    ('<bbox alt="[1,2,3,4]"></bbox>', "missing_coords"),
    ('<bbox player="2">[1,2,x,4]</bbox>', "malformed_coords"),
    ('<bbox =bad>[1,2,3,4]</bbox>', "malformed_attributes"),
    ('<bbox player="2"/>[1,2,3,4]</bbox>', "self_closing_bbox"),
    ('<bbox player="2">[1,2,3,4]', "unclosed_bbox"),
    ('{"bbox_2d": [1,2,3,4], "player": "2", "player": "3"}', "conflicting_player_ids"),
    ('{"bbox_2d": [1,2,3,4], "bbox_2d": [5,6,7,8]}', "conflicting_coords"),
])
def test_box_attempt_errors(spark, text, error):
    (found,) = column(spark, [text], B.evidence_attempts)
    assert len(found) == 1 and found[0]["error"] == error


def test_box_order_and_range(spark):
    text = '{"bbox_2d": [1,2,3,4]} <bbox player="9">[400,1,410,9]</bbox> <bbox player="3">[9,9,1,1]</bbox>'
    df = spark.createDataFrame([(text,)], "t string").select(B.evidence_attempts(F.col("t")).alias("a"))
    row = df.select("a", B.scaled_attempts(F.col("a"), F.lit(320), F.lit(240)).alias("s")).first()
    assert [a["is_json"] for a in row.a] == [True, False, False]
    assert [s["error"] for s in row.s] == [None, "out_of_range", "bad_ordering"]


def test_change_claims(spark):
    texts = ["<think>t</think><change>color:red->blue</change><answer>x</answer>",
             "<change>color:red->red</change>", "<change>color:red->blue</change", "<think><change>color:red->blue</change></think>",
             "<answer>x</answer><change>size:small->large</change>", "<change a='1'>color:red->blue</change>"]
    got = column(spark, texts, FX.change_claims)
    assert [(len(c["facts"]), c["invalid"]) for c in got] == [(1, 0), (0, 1), (0, 1), (0, 1), (0, 1), (0, 2)]


def test_step_similarity_against_levenshtein(spark):
    def lev(a, b):
        prev = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            cur = [i]
            for j, y in enumerate(b, 1):
                cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
            prev = cur
        return prev[-1]
    pairs = [("The red cube", "a red cube moved"), ("été chaud", "ete chaud"), ("", "x"), ("same", "same")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = [r.s for r in df.select("i", T.step_similarity(F.col("a"), F.col("b")).alias("s")).orderBy("i").collect()]
    for (a, b), s in zip(pairs, got):
        a, b = " ".join(a.lower().split()), " ".join(b.lower().split())
        import re
        ta, tb = set(re.findall(r"[a-zA-Z0-9_]+", a)), set(re.findall(r"[a-zA-Z0-9_]+", b))
        jac = len(ta & tb) / len(ta | tb) if ta and tb else 0.0
        assert abs(s - (0.5 * jac + 0.5 * (1 - lev(a, b) / max(len(a), len(b))))) < 1e-9
        assert abs(difflib.SequenceMatcher(None, a, b).ratio() - (1 - lev(a, b) / max(len(a), len(b)))) <= 0.5


def test_task_classes_by_hand(spark):
    """Five groups of five; mean, headroom and class are worked out by hand."""
    groups = {10: [(0.9, True)] * 5, 11: [(0.0, False)] * 5, 12: [(0.25, False)] * 4 + [(0.75, True)],
              13: [(0.5, True)] * 3 + [(0.0, False)] * 2, 14: [(0.6, True)] * 4 + [(0.1, False)]}
    rows = [(task, i, r, ok, task // 2) for task, group in groups.items() for i, (r, ok) in enumerate(group)]
    table = stats.task_statistics(spark.createDataFrame(rows, "task_id int, gen_index int, reward_scalar double, solved boolean, scene_id int"))
    got = {r.task_id: (r["class"], round(r.pass_rate, 6), round(r.regret, 6)) for r in table.collect()}
    assert got == {10: ("mastered", 1.0, 0.0), 11: ("too_hard", 0.0, 0.0), 12: ("trainable", 0.2, 0.4),
                   13: ("trainable", 0.6, 0.2), 14: ("trainable", 0.8, 0.1)}
    ranked = [(r.rank, r.task_id, r.direction) for r in ranking.seed_ranking(table, 2).orderBy("rank").collect()]
    assert ranked == [(1, 12, "easier"), (2, 13, "harder")]
    # Scene 5 holds tasks 10 and 11, of which one is not mastered: nothing retires.
    assert ranking.retire_scenes(table).count() == 0
    assert [r.task_id for r in ranking.retire_scenes(table.filter("task_id <> 11")).collect()] == [10]


def test_incomplete_group_raises(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 0.6), (2, 0.1)], "task_id int, reward_scalar double")
    with pytest.raises(Exception, match="incomplete group 2"):
        stats.group_reward_stats(df, 2).collect()


def test_balanced_pick_flattens_the_histogram(spark):
    pool = spark.createDataFrame([(i, "abc"[0 if i < 50 else 1 if i < 57 else 2]) for i in range(60)], "id int, label string")
    got = {r.label: r["count"] for r in ranking.balanced_pick(pool, "label", [F.col("id")], 18).groupBy("label").count().collect()}
    # Three of c, seven of b, the rest from a.
    assert got == {"c": 3, "b": 7, "a": 8}


def test_allocation_by_hand_and_by_its_properties(spark):
    # (total, easy, medium, hard) -> counts worked out by hand.
    known = {(10, 0.5, 0.3, 0.2): (5, 3, 2), (11, 0.4, 0.4, 0.1): (5, 5, 1), (9, 0.0, 0.0, 0.5): (2, 1, 6),
             (6, 1.0, 1.0, 0.0): (3, 3, 0), (8, 1.0, 0.1, 1.0): (4, 0, 4), (0, 0.2, 0.2, 0.2): (0, 0, 0)}
    rnd = __import__("random").Random(6)
    drawn = [(rnd.randrange(200), *[round(rnd.random() * rnd.choice([0.2, 0.6, 1.2]), 3) for _ in range(3)]) for _ in range(120)]
    cases = [*known, *drawn]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, total int, easy double, medium double, hard double")
    for r in ranking.difficulty_allocation(df, "total", ["easy", "medium", "hard"]).collect():
        total, *shares = cases[r.i]
        got = (r.n_easy, r.n_medium, r.n_hard)
        assert sum(got) == total and min(got) >= 0
        if cases[r.i] in known:
            assert got == known[cases[r.i]]
        moved = [g - round(s * total) for g, s in zip(got, shares)]
        drift = total - sum(round(s * total) for s in shares)
        if drift >= 0:
            # Everybody gets the same, up to one unit, which goes to the larger shares.
            assert max(moved) - min(moved) <= 1
            assert all(moved[a] >= moved[b] for a in range(3) for b in range(3) if shares[a] > shares[b])
        else:
            # Nobody gains; whoever lost less than the most is empty or one unit behind.
            assert max(moved) <= 0
            assert all(g == 0 or m - min(moved) <= 1 for g, m in zip(got, moved))


def test_subsets_up_to_a_cap(spark):
    from itertools import combinations

    from rollscope.operators.scenes import enumerate_subsets

    sizes = {1: 4, 2: 100, 3: 1, 4: 0}
    df = spark.createDataFrame(list(sizes.items()), "scene_id int, k int")
    for cap in (1, 7, 120):
        want = []
        for scene, n in sizes.items():
            every = (c for s in range(1, n + 1) for c in combinations(range(n), s))
            want += [(scene, c) for c, _ in zip(every, range(cap))]
        got = enumerate_subsets(df, "k", cap)
        assert sorted((r.scene_id, tuple(r.keep)) for r in got.collect()) == sorted(want)
    assert {r.mask for r in enumerate_subsets(df.filter("scene_id = 1"), "k", 15).collect()} == set(range(1, 16))


def test_subsets_take_as_many_tasks_as_their_number_asks_for(spark, monkeypatch):
    """Scenes are few bytes: before, adaptive execution put all their subsets into one task."""
    from rollscope.operators import scenes

    monkeypatch.setattr(scenes, "SUBSETS_PER_TASK", 100)
    df = spark.range(50).select(F.col("id").alias("scene_id"), (F.col("id") % 8).alias("k")).coalesce(1)
    got = scenes.enumerate_subsets(df, "k")
    rows = got.select("scene_id", "mask", F.spark_partition_id().alias("task")).collect()
    assert sorted((r.scene_id, r.mask) for r in rows) == [(s, m) for s in range(50) for m in range(1, 1 << s % 8)]
    assert len({r.task for r in rows}) > 8


def test_agreement_query_does_not_join_rows_with_their_shares(spark):
    """A row per answer meets its group's totals; the rows themselves, read a second time before, meet nothing."""
    from rollscope.operators import stats

    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (1, ""), (2, "x"), (None, "x"), (3, "")], "task_id int, answer string")
    got = {(r.task_id, r.answer): (r.cnt, round(r.same_share, 9), round(r.modal_share, 9)) for r in stats.answer_shares(df, "task_id", "answer").collect()}
    assert got == {(1, "a"): (2, 0.5, 0.666666667), (1, "b"): (1, 0.25, 0.666666667), (1, ""): (1, 0.0, 0.666666667), (2, "x"): (1, 1.0, 1.0), (3, ""): (1, 0.0, 1.0)}
    assert stats.group_agreement(df, "task_id", "answer").count() == 7


def test_records_on_one_side(spark):
    from rollscope.operators.detection import record_map

    box = [0.0, 0.0, 10.0, 10.0]
    gold = spark.createDataFrame([(1, 1, 1, box, False), (2, 2, 1, box, False)], "record int, gold_id bigint, label int, box array<double>, iscrowd boolean")
    dets = spark.createDataFrame([(1, 1, 1, box, 1.0), (1, 4, 1, [50.0, 50.0, 5.0, 5.0], 1.0), (3, 3, 1, box, 1.0)],
                                 "record int, det_id bigint, label int, box array<double>, score double")
    got = {r.record: (round(r["map"], 6), round(r.map_length, 6)) for r in record_map(
        dets, gold, "record", "label", spark.range(5).selectExpr("cast(id as int) as record")).collect()}
    assert got == {0: (1.0, 1.0), 1: (1.0, 0.5), 2: (0.0, 0.0), 3: (0.0, 0.0), 4: (1.0, 1.0)}


def test_a_lone_rollout_is_consistent(spark):
    df = spark.createDataFrame([(1, 0, "<think>red cube</think><answer>a</answer>"), (2, 1, "<answer>a</answer>"), (2, 2, "<answer>b</answer>")],
                               "task_id int, gen_index int, completion string")
    got = {r.gen_index: r.consistency for r in scoring.group_consistency(df).collect()}
    assert got[0] == 1.0 and got[1] < 1.0


def test_boxed_answers_of_any_depth(spark):
    texts = [r"so \boxed{a{b{c{d}}}} it is", r"\boxed{1} or \boxed{2", "none", None, r"\boxed{x} \boxed{\frac{1}{2}}"]
    assert column(spark, texts, T.last_boxed) == ["a{b{c{d}}}", "1", None, None, r"\frac{1}{2}"]
    texts = [r"$\boxed 7$ then", r"\boxed{1} or \boxed x+1", r"a \fbox{b{c}} d", r"\fbox{1} \boxed{2}", r"\fbox{1", r"\fbox{1} \boxed{2"]
    assert column(spark, texts, T.last_boxed) == ["7", "x+1", "b{c}", "2", None, None]


def test_average_needs_one_protocol_for_all(spark):
    grid = spark.createDataFrame([(m, b, 50.0) for m in (1, 2) for b in ("x", "y")], "model int, bench string, score double")
    def mean(rows):
        signed = spark.createDataFrame(rows, "model int, signature string")
        return {r.model: r.average for r in checks.benchmark_average(grid, "model", "bench", ["x", "y"], signed).collect()}
    assert mean([(1, "s"), (2, "s")]) == {1: 50.0, 2: 50.0}
    for rows in ([(1, "s"), (2, "t")], [(1, "s")], [(1, "s"), (2, None)], [(1, "s"), (1, "t"), (2, "s")]):
        assert mean(rows) == {1: None, 2: None}


@pytest.mark.parametrize("bad", [
    {"weights": {"answer": 1.0}}, {"answer_mode": "loose"}, {"gating_mode": "x"}, {"match_mode": "best"}, {"coordinate_mode": "cm"},
    {"weights": {"answer": -1.0, "budget": 0, "process": 0, "grounding": 0, "consistency": 0}}])
def test_reward_config_rejects(bad):
    with pytest.raises(ValueError):
        R.RewardConfig(**bad)


def test_scored_rollout_end_to_end(spark):
    good = ('<think>Player 2 shows a blue cube while player 1 shows a red cube. The others match, so player 2 is the spy because only it '
            'is different from the majority.</think><bbox player="2">[40,30,120,90]</bbox><answer>spy=2; changed_attributes=1</answer>')
    bad = good.replace("spy=2", "spy=3")
    sol = "<answer>spy=2; changed_attributes=1</answer>"
    roll = spark.createDataFrame([(1, 0, good, sol), (1, 1, bad, sol), (1, 2, good, sol)],
                                 "task_id int, gen_index int, completion string, solution string")
    tasks = spark.createDataFrame([(1, [[40.0, 30.0, 120.0, 90.0]], [2], 320, 240)],
                                  "task_id int, gold_boxes array<array<double>>, valid_players array<bigint>, image_width int, image_height int")
    got = {r.gen_index: r for r in scoring.score_and_route(roll, tasks).collect()}
    assert got[0].answer == 1.0 and got[0].grounding == 1.0 and got[0].consistency == 1.0
    assert got[0].buffer == "positive" and got[2].buffer == "unused" and got[1].buffer == "failure"
    # Wrong spy closes the gate: only the answer and budget parts pay.
    assert abs(got[1].reward_scalar - (0.6 * 0.3 + 0.03)) < 1e-9
    control = scoring.score_rollouts(roll, tasks, R.RewardConfig(control_mode="format_only")).collect()
    assert all(r.reward_scalar == 1.0 for r in control)


def test_counterfactual_sensitivity(spark):
    tasks = spark.createDataFrame([("a", "p", "small", "s", 3, 1, [0]), ("b", "p", "large", "s", 3, 1, [0, 1])],
                                  "task_id string, pair_id string, pair_role string, scene_id string, num_players int, spy_player int, keep array<int>")
    for preds, want in (((4, 4), (0.0, 0.0)), ((2, 3), (1.0, 1.0))):
        roll = spark.createDataFrame([("a", preds[0]), ("b", preds[1])], "task_id string, count_pred int")
        row = curriculum.counterfactual_sensitivity(curriculum.counterfactual_pairs(roll, tasks)).first()
        assert (row.num_pairs, row.sensitivity, row.direction_correct) == (1, *want)


def test_percent_normalize(spark):
    df = spark.createDataFrame([("MMVP", ".5"), ("ChartQA_TEST", ".5"), ("MCQ", "1"), ("MMVP", "1.5"), ("MMVP", "70%"), ("MMVP", "nan")], "b string, r string")
    got = [r.s for r in df.select(checks.percent_normalize(F.col("r"), F.col("b"), ["ChartQA_TEST"]).alias("s")).collect()]
    assert got == [50.0, 0.5, 100.0, None, 70.0, None]


def test_fingerprint_ignores_order_but_not_content(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "i int, s string")
    fp = lambda df: checks.dataset_fingerprint(df).first().fingerprint
    assert fp(a) == fp(a.orderBy(F.col("i").desc())) and fp(a) != fp(a.distinct())


def test_atomic_sink_keeps_old_output_on_failure(spark, tmp_path):
    path = str(tmp_path / "out")
    files.sink_jsonl_atomic(spark.createDataFrame([(1,)], "i int"), path)
    broken = spark.createDataFrame([(2,)], "i int").select(F.raise_error(F.lit("boom")).cast("int").alias("i"))
    with pytest.raises(Exception, match="boom"):
        files.sink_jsonl_atomic(broken, path)
    assert [r.i for r in files.scan_jsonl(spark, path, "i int").collect()] == [1]


def test_strict_scan_fails_and_tolerant_scan_drops(spark, tmp_path):
    from pyspark.sql.types import LongType, StructType

    (tmp_path / "x.jsonl").write_text('{"i": 1}\n\nnot json\n{"i": 2}\n')
    schema = StructType().add("i", LongType())
    with pytest.raises(Exception):
        files.scan_jsonl(spark, str(tmp_path), schema).collect()
    assert sorted(r.i for r in files.scan_jsonl_tolerant(spark, str(tmp_path), schema).collect()) == [1, 2]


def test_resume_guard_refuses_other_settings(spark, tmp_path):
    from rollscope.streaming.jobs import resume_guard

    df = spark.createDataFrame([(1,)], "i int")
    marker = str(tmp_path / "protocol")
    resume_guard(df, {"w": 1}, marker)
    resume_guard(df, {"w": 1}, marker)
    with pytest.raises(RuntimeError):
        resume_guard(df, {"w": 2}, marker)


def test_exponential_text_is_parsed_in_bounded_time(spark):
    # Thousands of tags must neither overflow the stack nor blow up.
    text = "<think>x</think>" + "<bbox>[1,2,3,4]</bbox>" * 3000 + "<answer>spy=1; changed_attributes=1</answer>"
    assert column(spark, [text], T.format_valid) == [True]
    (found,) = column(spark, [text], B.evidence_attempts)
    assert len(found) == 3000


def test_agreement_query_gives_every_row_its_shares(spark, tmp_path, monkeypatch):
    """Before, the shares of the different answers were the result and no row met its own."""
    import __spark_entry__ as se
    from rollscope.operators import stats

    seen = []
    whole = stats.group_agreement
    monkeypatch.setattr(stats, "group_agreement", lambda *a: seen.append(whole(*a)) or seen[-1])
    spark.createDataFrame([(1, 1), (1, 1), (1, 2), (2, 3), (None, 3)], "l_orderkey bigint, l_linenumber int").selectExpr(
        "*", "0.1d as l_discount", "'R' as l_returnflag", "1 as l_suppkey").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {(r.task_id, r.answer): (r.cnt, r.same_share, r.modal_share) for r in se.queries()["group_agreement"](spark, str(tmp_path)).collect()}
    assert got == {(1, "1"): (2, 0.666666667, 0.666666667), (1, "2"): (1, 0.333333333, 0.666666667), (2, "3"): (1, 1.0, 1.0)}
    assert sorted((r.task_id, r.answer, round(r.same_share, 9)) for r in seen[0].collect()) == [
        (1, "1", 0.666666667), (1, "1", 0.666666667), (1, "2", 0.333333333), (2, "3", 1.0)]
