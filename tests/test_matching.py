"""Order-dependent matchers against brute force on small random groups."""

import random

import pytest
from pyspark.sql import functions as F

from rollscope.functions import boxes as B
from rollscope.operators import curriculum, detection


def iou(a, b):
    w = max(0.0, min(a[2], b[2]) - max(a[0], b[0]))
    h = max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return w * h / union if union > 0 else 0.0


def random_boxes(rnd, n):
    return [[float(x), float(y), float(x + rnd.randint(1, 6)), float(y + rnd.randint(1, 6))]
            for x, y in ((rnd.randint(0, 6), rnd.randint(0, 6)) for _ in range(n))]


def test_greedy_fold_equals_brute_force(spark):
    rnd = random.Random(1)
    cases = [(i, random_boxes(rnd, rnd.randint(0, 6)), random_boxes(rnd, rnd.randint(0, 6))) for i in range(200)]
    df = spark.createDataFrame(cases, "id int, gold array<array<double>>, pred array<array<double>>")
    got = df.select("id", B.greedy_fold(B.iou_pairs(F.col("gold"), F.col("pred")), 0.1).alias("m"),
                    B.best_recall(F.col("gold"), F.col("pred")).alias("r"), B.near_duplicates(F.col("pred"), 0.5).alias("d")).collect()
    for row in got:
        _, gold, pred = cases[row.id]
        todo = sorted(((-iou(g, p), gi, pi) for gi, g in enumerate(gold) for pi, p in enumerate(pred)))
        ug, up, total = set(), set(), 0.0
        for neg, gi, pi in todo:
            if -neg >= 0.1 and gi not in ug and pi not in up:
                ug.add(gi), up.add(pi)
                total += -neg
        assert abs(row.m.total - total) < 1e-12 and len(row.m.hits) == len(ug)
        best = [max(iou(g, p) for p in pred) for g in gold] if gold and pred else []
        assert abs(row.r - (sum(best) / len(best) if best else 0.0)) < 1e-12
        assert row.d == any(iou(a, b) >= 0.5 for i, a in enumerate(pred) for b in pred[i + 1:])


def test_proposal_pairing_equals_brute_force(spark):
    rnd = random.Random(2)
    data = [(rnd.randrange(4), 3 + rnd.randrange(2), i, rnd.randrange(1, 16)) for i in range(200)]
    df = spark.createDataFrame(data, "scene_id bigint, num_players bigint, proposal_id bigint, mask bigint")
    got = sorted((r.scene_id, r.num_players, r.small_id, r.large_id) for r in curriculum.proposal_pairing(df).collect())
    want = []
    for key in {(s, n) for s, n, _, _ in data}:
        group = [(i, m) for s, n, i, m in data if (s, n) == key]
        used = set()
        for a, m in group:
            if a in used:
                continue
            for b, x in group:
                if b != a and b not in used and m & x == m and bin(x).count("1") == bin(m).count("1") + 1:
                    used |= {a, b}
                    want.append((*key, a, b))
                    break
    assert got == sorted(want)


def brute_pairing(data):
    """Pairs of (scene, players, id, elements) rows, one proposal after the other."""
    out = []
    for key in {(s, n) for s, n, _, _ in data}:
        group = sorted((i, frozenset(k)) for s, n, i, k in data if (s, n) == key and k and min(k) >= 0 and len(set(k)) == len(k))
        used = set()
        for a, x in group:
            for b, y in group:
                if a not in used and b not in used and x < y and len(y) == len(x) + 1:
                    used |= {a, b}
                    out.append((*key, a, b))
    return sorted(out, key=str)


PICKS = "scene_id bigint, num_players bigint, proposal_id bigint, keep array<int>"


def test_proposal_pairing_of_wide_picks(spark):
    # Elements above bit 30 and 63, a group without a player count, picks that never pair.
    wide = [40, 70, 1000]
    data = [(1, 3, 1, [2, 40]), (1, 3, 2, [40]), (1, 3, 3, wide), (1, 3, 4, [70, 1000]), (1, 4, 5, [40, 2, 7]), (1, None, 6, [5]), (1, None, 7, [5, 45]),
            (1, 3, 8, []), (1, 3, 9, [40, 40]), (1, 3, 10, [-1]), (1, 3, 11, [40, -1]), (2, 3, 12, [40, 3])]
    got = curriculum.proposal_pairing(spark.createDataFrame(data, PICKS), "keep").collect()
    assert sorted(map(tuple, got), key=str) == brute_pairing(data) == sorted([(1, 3, 2, 1), (1, 3, 4, 3), (1, None, 6, 7)], key=str)
    masks = [(1, 3, 1, 1), (1, 3, 2, 1 | 1 << 45), (1, 3, 3, 1 << 62), (1, 3, 4, 1 << 62 | 1 << 31)]
    got = curriculum.proposal_pairing(spark.createDataFrame(masks, "scene_id bigint, num_players bigint, proposal_id bigint, mask bigint"))
    assert sorted((r.small_id, r.large_id) for r in got.collect()) == [(1, 2), (3, 4)]
    assert curriculum.proposal_pairing(spark.createDataFrame(data, PICKS).limit(0), "keep").count() == 0


def test_proposal_pairing_of_a_hot_group(spark):
    # One group with few distinct picks: many proposals share a pick, and whole runs of them are taken in a round.
    rnd = random.Random(4)
    picks = [[0], [0, 1], [0, 1, 2], [3]]
    data = [(1, 3, i, picks[min(3, i // 500)] if i < 1500 else picks[rnd.randrange(4)]) for i in range(1700)]
    got = curriculum.proposal_pairing(spark.createDataFrame(data, PICKS).repartition(4), "keep").collect()
    assert sorted(map(tuple, got), key=str) == brute_pairing(data) and len(got) > 500


@pytest.mark.parametrize("limit", [0, 60, 250_000])
def test_proposal_pairing_of_small_groups_takes_no_rounds(spark, monkeypatch, limit):
    """Groups within the limit are paired by one task each; before, all took rounds of joins. 0: all take them; 60: some do."""
    monkeypatch.setattr(curriculum, "SMALL_GROUP", limit)
    if limit > 60:
        monkeypatch.delattr(curriculum, "least_pairs")
    rnd = random.Random(5)
    data = [(rnd.randrange(6) if i % 3 else None if i % 7 == 0 else 9, rnd.choice([3, 4, None]), (i * 37) % 181,
             rnd.sample([0, 1, 2, 70], rnd.randrange(5)) + [5] * (i % 11 == 0)) for i in range(181)]
    got = curriculum.proposal_pairing(spark.createDataFrame(data, PICKS).repartition(3), "keep").collect()
    assert sorted(map(tuple, got), key=str) == brute_pairing([r for r in data if r[0] is not None]) and len(got) > 30


def coco_reference(dets, gold, lo, hi, thr, cap):
    ignored = lambda g: g["crowd"] or not lo <= g["box"][2] * g["box"][3] <= hi
    gold = sorted(gold, key=lambda g: (ignored(g), g["id"]))
    taken, out = set(), {}
    for d in sorted(dets, key=lambda d: (-d["score"], d["id"]))[:cap]:
        best, pick = min(thr, 1 - 1e-10), None
        for g in gold:
            if g["id"] in taken and not g["crowd"]:
                continue
            if pick is not None and not ignored(pick) and ignored(g):
                break
            a, b = d["box"], g["box"]
            w = max(0.0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]))
            h = max(0.0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
            union = a[2] * a[3] if g["crowd"] else a[2] * a[3] + b[2] * b[3] - w * h
            if w * h / union < best:
                continue
            best, pick = w * h / union, g
        if pick is not None:
            taken.add(pick["id"])
        outside = not lo <= d["box"][2] * d["box"][3] <= hi
        out[d["id"]] = (pick is not None, ignored(pick) if pick is not None else outside)
    return out


def test_coco_match_equals_brute_force(spark):
    rnd = random.Random(4)
    box = lambda: [float(rnd.randint(0, 30)), float(rnd.randint(0, 30)), float(rnd.randint(20, 60)), float(rnd.randint(20, 60))]
    dets = [dict(key=i % 5, id=i, score=rnd.randint(0, 9) / 10, box=box()) for i in range(60)]
    gold = [dict(key=i % 5, id=i, crowd=i % 9 == 0, box=box()) for i in range(50)]
    d = spark.createDataFrame([(x["key"], x["id"], x["score"], x["box"]) for x in dets], "image_id int, det_id bigint, score double, box array<double>")
    g = spark.createDataFrame([(x["key"], x["id"], x["crowd"], x["box"]) for x in gold], "image_id int, gold_id bigint, iscrowd boolean, box array<double>")
    thrs = (0.3, 0.5)
    # A cap of 8 also exercises the bound on kept candidates.
    got = {(r.image_id, r.area, r.thr, r.det_id): (r.matched, r.ignored)
           for r in detection.coco_match(d, g, ["image_id"], thrs, max_dets=8).collect()}
    want = {}
    for key in range(5):
        for area, (lo, hi) in detection.AREAS.items():
            for thr in thrs:
                found = coco_reference([x for x in dets if x["key"] == key], [x for x in gold if x["key"] == key], lo, hi, thr, 8)
                want.update({(key, area, thr, i): v for i, v in found.items()})
    assert got == want


def test_average_precision_grid(spark):
    hits = [True, False, True, True, False]
    m = spark.createDataFrame([("c", "all", 0.5, i, 1.0 - i / 10, h, False) for i, h in enumerate(hits)],
                              "category string, area string, thr double, det_id bigint, score double, matched boolean, ignored boolean")
    pos = spark.createDataFrame([("c", "all", 4)], "category string, area string, positives int")
    row = detection.average_precision(m, pos, ["category", "area", "thr"], [F.col("score").desc()]).first()
    points, tp = [], 0
    for i, h in enumerate(hits):
        tp += h
        points.append((tp / 4, tp / (i + 1)))
    grid = [max([p for r, p in points if r >= k / 100 - 1e-12], default=0.0) for k in range(101)]
    assert abs(row.ap - sum(grid) / 101) < 1e-9 and row.recall == 0.75


def test_record_map_one_record(spark):
    d = spark.createDataFrame([(1, "a", 0, 1.0, [0.0, 0.0, 10.0, 10.0])], "record_id int, category string, det_id bigint, score double, box array<double>")
    g = spark.createDataFrame([(1, "a", 0, False, [0.0, 0.0, 10.0, 10.0])], "record_id int, category string, gold_id bigint, iscrowd boolean, box array<double>")
    row = detection.record_map(d, g, "record_id", "category").first()
    assert abs(row["map"] - 1.0) < 1e-9 and abs(row["map50"] - 1.0) < 1e-9
