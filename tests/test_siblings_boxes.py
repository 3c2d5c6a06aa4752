"""Sibling box agreement against the plain double loop over a group's rows."""

import random

from rollscope.operators import pairs
from rollscope.plans import scoring
from tests.shuffled import shuffled

NAN = float("nan")


def iou(a, b):
    w = max(0.0, min(a[2], b[2]) - max(a[0], b[0]))
    h = max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    area = [max(0.0, (x[2] - x[0]) * (x[3] - x[1])) for x in (a, b)]
    union = area[0] + area[1] - w * h
    return w * h / union if union > 0 else 0.0


def good(box):
    return box is not None and len(box) == 4 and all(v is not None and abs(v) < float("inf") for v in box)


def recall(gold, pred):
    pred = [p for p in pred if good(p)]
    if not gold or not pred or not all(good(g) for g in gold):
        return 0.0
    return sum(max(iou(g, p) for p in pred) for g in gold) / len(gold)


def plain(rows):
    groups, out = {}, {}
    for g, i, boxes in rows:
        groups.setdefault(g, []).append((i, boxes))
    for g, members in groups.items():
        for i, mine in members:
            others = [b for j, b in members if j != i and b is not None]
            if len(members) == 1:
                out[i] = 1.0
            elif mine is None or not others:
                out[i] = 0.0
            else:
                out[i] = sum(recall(b, mine) for b in others) / len(others)
    return out


def sets(rnd, n, side):
    def box():
        x, y = rnd.randint(-side, side), rnd.randint(-side, side)
        return [float(x), float(y), float(x + rnd.randint(1, 9)), float(y + rnd.randint(1, 9))]
    shared = [box() for _ in range(4)]
    odd = [[1.0, 2.0, 3.0], [None, 0.0, 1.0, 1.0], [NAN, 0.0, 1.0, 1.0], [5.0, 5.0, 5.0, 9.0], [6.0, 6.0, 2.0, 2.0],
           [float("-inf"), 0.0, 4.0, 4.0], [-0.0, 0.0, 4.0, 4.0], [0.0, -0.0, 4.0, 4.0], [-1000.0, -1000.0, 1000.0, 1000.0]]
    out = []
    for _ in range(n):
        kind = rnd.random()
        if kind < 0.1:
            out.append(None)
        else:
            out.append([rnd.choice(shared) if rnd.random() < 0.4 else rnd.choice(odd) if rnd.random() < 0.1 else box()
                        for _ in range(rnd.randint(0, 4))])
    return out


def test_against_double_loop(spark):
    rnd = random.Random(4)
    rows, i = [], 0
    for group, n, side in ((1, 1, 5), (2, 2, 5), (3, 40, 12), (4, 150, 60), (None, 30, 8), (6, 12, 0)):
        for boxes in sets(rnd, n, side):
            rows.append((group, i, boxes))
            i += 1
    rows += [(7, i, None), (7, i + 1, None), (8, i + 2, [[0.0, 0.0, 4.0, 4.0]]), (8, i + 3, None), (9, i + 4, []), (9, i + 5, [])]
    df = spark.createDataFrame(rows, "grp int, id int, boxes array<array<double>>")
    got = {r.id: r.evidence for r in pairs.mean_sibling_box_overlap(df, ["grp"], "id", "boxes").collect()}
    want = plain(rows)
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert sum(v > 0 for v in want.values()) > 100
    assert pairs.mean_sibling_box_overlap(df.limit(0), ["grp"], "id", "boxes").count() == 0


def test_boxes_win_over_words(spark):
    box = [[0.0, 0.0, 4.0, 4.0]]
    rows = [(1, 1, ["red"], box), (1, 2, ["blue"], box), (1, 3, ["red"], None), (2, 4, ["red"], None), (2, 5, ["red"], None), (3, 6, [], None)]
    df = spark.createDataFrame(rows, "grp int, id int, words array<string>, boxes array<array<double>>")
    got = {r.id: (r.method, r.evidence) for r in pairs.sibling_evidence(df, ["grp"], "id", "words", "boxes").collect()}
    assert got == {1: ("boxes", 1.0), 2: ("boxes", 1.0), 3: ("boxes", 0.0), 4: ("words", 1.0), 5: ("words", 1.0), 6: ("words", 1.0)}


def test_tiles_against_double_loop(spark, monkeypatch):
    monkeypatch.setattr(pairs, "SMALL", 4)
    monkeypatch.setattr(pairs, "BOXES", 8)
    rnd = random.Random(5)
    rows, i = [], 0
    for group, n, side in ((1, 60, 12), (2, 120, 60), (None, 30, 8), (3, 2, 5)):
        for boxes in sets(rnd, n, side):
            rows.append((group, i, boxes))
            i += 1
    df = spark.createDataFrame(rows, "grp int, id int, boxes array<array<double>>")
    got = {r.id: r.evidence for r in pairs.mean_sibling_box_overlap(df, ["grp"], "id", "boxes").collect()}
    want = plain(rows)
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_a_tile_in_steps():
    import numpy as np
    import pandas as pd

    rnd = random.Random(6)
    box = lambda: (lambda x, y: [x, y, x + rnd.randint(1, 9), y + rnd.randint(1, 9)])(rnd.randint(0, 30), rnd.randint(0, 30))
    gold, probes = [box() for _ in range(2000)], [(f"s{i % 7 if i < 600 else 0}", box()) for i in range(900)]
    frame = pd.DataFrame([(None, 0.5, *g) for g in gold] + [(s, np.nan, *b) for s, b in probes],
                         columns=["__set", "__w", "__x1", "__y1", "__x2", "__y2"])
    got = pairs._tile_sums(frame).set_index("__set")["__total"].to_dict()
    for name in {s for s, _ in probes}:
        mine = [b for s, b in probes if s == name]
        assert abs(got[name] - sum(0.5 * max(iou(g, p) for p in mine) for g in gold)) < 1e-6


def test_overlapping_pairs_are_not_shuffled(spark):
    n = 600
    rows = [(1, i, [[float(i % 40), float(i % 30), 50.0 + i, 60.0 + i], [1.0, 1.0, 70.0, 80.0 + i]]) for i in range(n)]
    df = spark.createDataFrame(rows, "grp int, id int, boxes array<array<double>>")
    before = shuffled(spark)[0]
    assert all(r.evidence > 0 for r in pairs.mean_sibling_box_overlap(df, ["grp"], "id", "boxes").collect())
    assert shuffled(spark)[0] - before < 40 * n


def test_group_consistency_does_not_shuffle_pairs(spark):
    n = 500
    rows = [(1, i, "<think>red cube</think><answer>a</answer>", [[float(i % 40), float(i % 30), 50.0 + i, 60.0 + i]]) for i in range(n)]
    df = spark.createDataFrame(rows, "task_id int, gen_index int, completion string, boxes array<array<double>>")
    before = shuffled(spark)[0]
    assert len(scoring.group_consistency(df, boxes="boxes").collect()) == n
    assert shuffled(spark)[0] - before < 60 * n
