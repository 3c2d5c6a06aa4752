import __spark_entry__ as se
from rollscope.plans import queries_rewards

SF = "/root/testdata/sf0.001"


def test_only_rows_that_may_be_certified_are_scored(spark, monkeypatch):
    """Before, boxes and reasoning of every row were parsed and scored."""
    taken = []
    score = queries_rewards.scoring.score_rollouts

    def counted(rollouts, tasks, cfg=None):
        taken.append(rollouts.count())
        return score(rollouts, tasks, cfg)

    monkeypatch.setattr(queries_rewards.scoring, "score_rollouts", counted)
    rows = se.queries()["visual_certificate"](spark, SF).collect()
    every = spark.read.parquet(f"{SF}/events.parquet").count()
    assert len(rows) == every and sum(taken) < every / 10
    assert sum(r.certified for r in rows) <= sum(taken)


def test_open_rows_are_those_that_boxes_and_reasoning_decide(spark):
    from rollscope.operators.certificate import may_certify, visual_certificate

    right, short = queries_rewards.CLAIMS[0], queries_rewards.CLAIMS[2]
    # spy, changed, their gold, format, claims, shortcut, boxes, grounding; then whether open and certified.
    rows = [(1, 2, 1, 2, True, right, False, 1, 0.5, True, True), (1, 2, 1, 2, True, right, False, 0, 0.5, True, False),
            (1, 2, 1, 2, True, right, True, 1, 0.5, True, False), (1, 2, 1, 2, True, right, False, 1, 0.0, True, False),
            (3, 2, 1, 2, True, right, False, 1, 0.5, False, False), (None, 2, 1, 2, True, right, False, 1, 0.5, False, False),
            (1, 2, 1, 2, False, right, False, 1, 0.5, False, False), (1, 2, 1, 2, True, short, False, 1, 0.5, False, False),
            (1, 2, 1, 2, True, None, False, 1, 0.5, False, False), (3, 2, 3, 2, True, right, False, 1, 0.5, False, False)]
    df = spark.createDataFrame([(i, 7, *r) for i, r in enumerate(rows)], "id int, task_id int, spy int, changed int, spy_gold int, "
                               "changed_gold int, format_valid boolean, said string, shortcut_detected boolean, boxes int, grounding double, "
                               "w_open boolean, w_certified boolean").selectExpr("*", "array_repeat(1, boxes) as valid", "true as players_ok")
    accepted = spark.sql("select 7 as task_id, 1 as spy, 2 as changed")
    gold = spark.sql("select 7 as task_id, inline(array(struct('color' attribute, 'red' before, 'blue' after, 2 n), "
                     "struct('size' attribute, 'small' before, 'large' after, 1 n)))")
    got = visual_certificate(may_certify(df, accepted, gold, claims="said"), accepted, gold, claims="said").collect()
    assert len(got) == len(rows)
    assert [(r.open, r.certified) for r in sorted(got, key=lambda r: r.id)] == [r[-2:] for r in rows]
