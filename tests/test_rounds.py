import pytest

from rollscope.operators import rounds

SCORED = ("round int, task_id string, scene_id int, gen_index int, reward_scalar double, solved boolean, spy_pred int, spy_gold int, "
          "count_pred int, count_gold int, bbox_valid boolean, iou double, num_boxes int")
TASKS = "round int, task_id string, pair_id string, pair_role string, scene_id int, num_players int, spy_player int, keep array<int>"
PROPOSALS = "round int, keep array<int>, reached boolean, learnability double, solver_class string"


def scored_rows(spark):
    rows = []
    for at in (0, 2, None):
        for task, said in (("a", 1), ("b", 2)):
            for i in range(4):
                rows.append((at, task, 1, i, i / 4, i > 1, 1, 1, None if i == 3 else said, 1, i > 0, 0.5, i))
    return spark.createDataFrame(rows, SCORED)


def test_report_sections_and_rounds_without_rows(spark):
    tasks = spark.createDataFrame([(0, "a", "p", "small", 1, 3, 1, [0]), (0, "b", "p", "large", 1, 3, 1, [0, 1]),
                                   (2, "a", "p", "small", 1, 3, 1, [0]), (2, "b", "p", "large", 1, 3, 1, [0, 1]),
                                   (2, "b", "p", "large", 1, 3, 1, [0, 1]), (7, "a", "p", "small", 1, 3, 1, [0])], TASKS)
    proposals = spark.createDataFrame([(0, [0], True, 1.0, "trainable"), (0, [0], True, 0.5, "mastered"), (0, [], False, 0.0, None),
                                       (9, [1], True, 1.0, "trainable")], PROPOSALS)
    recorded = spark.createDataFrame([(2, 5, 0.9, None, 0.1, 1, 2, 2)], "round int, num_tasks long, mean_solve_rate double, mean_regret double, "
                                     "advantage_collapse_rate double, num_too_hard long, num_trainable long, num_mastered long")
    got = {r["round"]: r for r in rounds.round_report(scored_rows(spark), tasks, proposals, recorded=recorded).collect()}
    # Rounds 7 and 9 have tasks or proposals but no scored row; the null key is a round like any other.
    assert set(got) == {0, 2, None}
    first, second, none = got[0], got[2], got[None]
    assert [r.n for r in (first, second, none)] == [8, 8, 8] and none["mode"] == 1 and none.mode_share == 3 / 8
    assert first.parse_failed == 2 and first.count_acc == 3 / 8 and first.bbox_valid_rate == 0.75
    assert (first.num_tasks, first.mean_solve_rate, first.solvability_source) == (2, 0.5, "computed")
    # The whole recorded section counts, its nulls too.
    assert (second.num_tasks, second.mean_solve_rate, second.mean_regret, second.solvability_source) == (5, 0.9, None, "recorded")
    assert (first.num_pairs, first.sensitivity, first.direction_correct) == (1, 1.0, 1.0)
    # Task b was accepted twice in round 2, which leaves its pair without proof; other rounds keep theirs.
    assert (second.num_pairs, second.sensitivity) == (0, None)
    assert (first.num_proposals, first.num_parsed, first.distinct_subsets, first.mean_learnability) == (3, 2, 1, 0.75)
    assert (second.num_proposals, second.mean_learnability) == (0, None)


def test_report_without_recorded_summaries_and_on_empty_tables(spark):
    tasks, proposals = spark.createDataFrame([], TASKS), spark.createDataFrame([], PROPOSALS)
    got = rounds.round_report(scored_rows(spark), tasks, proposals).collect()
    assert {r.solvability_source for r in got} == {"computed"} and {r.num_tasks for r in got} == {2}
    assert rounds.round_report(scored_rows(spark).limit(0), tasks, proposals).count() == 0


@pytest.mark.parametrize("missing", [False, True])
def test_state_of_the_round_before(spark, missing):
    ran = [(1, 0), (1, 1), (1, 1), (1, 3), (2, 5), (None, 1), (1, None)] + ([] if missing else [(1, 2)])
    policy = spark.createDataFrame([(1, 0, "p0"), (1, 1, "p1"), (1, 2, "p2"), (2, 4, "other")], "run_id int, round int, name string")
    feedback = spark.createDataFrame([(1, 0, 3)], "run_id int, round int, judged int")
    out = rounds.state_before(spark.createDataFrame(ran, "run_id int, round int"), {"policy": policy, "feedback": feedback})
    got = {(r.run_id, r["round"]): (r.prev_round, r.policy_name, r.feedback_judged, r.read_prev) for r in out.collect()}
    # Round 2 was not run: round 3 reads round 1. Feedback that round 1 did not write stays null.
    want = {(1, 0): (None, None, None, False), (1, 1): (0, "p0", 3, True), (2, 5): (None, None, None, False),
            (1, 3): (1, "p1", None, True) if missing else (2, "p2", None, True)}
    if not missing:
        want[(1, 2)] = (1, "p1", None, True)
    assert got == want
