"""Scene counts, facts and questions: against plain loops, and what they shuffle."""

import hashlib
import random
from collections import Counter

import pytest

from rollscope.functions import facts as FX
from rollscope.operators import scenes
from rollscope.session import cut_lineage
from tests.shuffled import shuffled

COLUMNS = [f"{side}_{a}" for a in FX.ATTRIBUTES for side in ("before", "after")]
SCHEMA = "scene_id bigint, obj int, " + ", ".join(f"{c} string" for c in COLUMNS) + ", px double, depth double"


def edits(n, odd, seed=3):
    rnd, rows = random.Random(seed), []
    for scene in [*range(n), None]:
        for obj in range(rnd.randint(1, 7)):
            values = []
            for c in COLUMNS:
                a = c.split("_")[1]
                values.append(rnd.choice([None, "mauve", "teal"]) if rnd.random() < odd else rnd.choice(FX.DOMAINS[a]))
            rows.append((scene, obj, *values, float(rnd.randint(0, 300)), float(rnd.randint(6, 30))))
    return rows


def deltas(rows):
    old, new = Counter(), Counter()
    for r in rows:
        for i, c in enumerate(COLUMNS):
            (old if c.startswith("before") else new)[(r[0], c.split("_")[1], r[2 + i])] += 1
    return {(*k, old[k], new[k]) for k in old.keys() | new.keys() if old[k] != new[k]}


def test_deltas_with_odd_values(spark):
    rows = edits(120, 0.2)
    got = [tuple(r) for r in scenes.count_deltas(spark.createDataFrame(rows, SCHEMA)).select(
        "scene_id", "attribute", "value", "old", "new").collect()]
    assert len(got) == len(set(got)) and set(got) == deltas(rows)


def test_first_deltas_with_odd_values(spark):
    rows = edits(120, 0.2)
    best = {}
    for d in deltas(rows):
        rank = hashlib.sha256("|".join(["1701", *[str(x) for x in d[:3] if x is not None]]).encode()).hexdigest()
        best[d[:2]] = min(best.get(d[:2], (rank, d)), (rank, d), key=lambda x: x[0])
    got = {tuple(r) for r in scenes.first_count_deltas(spark.createDataFrame(rows, SCHEMA)).select(
        "scene_id", "attribute", "value", "old", "new", "rank").collect()}
    assert got == {(*d, rank) for rank, d in best.values()}


def test_facts_with_odd_values(spark):
    rows = edits(200, 0.02)
    bad = {r[0] for r in rows for i, c in enumerate(COLUMNS) if r[2 + i] not in FX.DOMAINS[c.split("_")[1]]}
    want = Counter()
    for r in rows:
        for i, a in enumerate(FX.ATTRIBUTES):
            before, after = r[2 + 2 * i], r[3 + 2 * i]
            if r[0] not in bad and before != after:
                want[(r[0], a, before, after)] += 1
    got = {tuple(r)[:4]: r.n for r in scenes.gold_facts(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == dict(want)


def test_counts_with_odd_values(spark):
    rows, want = edits(200, 0.3, 5), {}
    for scene in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == scene]
        for a in scenes.COUNT_ORDER:
            seen = Counter(r[2 + COLUMNS.index(f"before_{a}")] for r in mine)
            usable = sorted(((v is not None, v or ""), v, n) for v, n in seen.items() if len(mine) >= 3 and 2 <= n < len(mine))
            if usable:
                want[scene] = (a, *usable[0][1:], len(mine))
                break
    got = {r.scene_id: tuple(r)[1:] for r in scenes.attribute_counts(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want


# Bytes shuffled for each scene of about four edits.
@pytest.mark.parametrize("name, limit", [("count_deltas", 90), ("first_count_deltas", 110), ("gold_facts", 140), ("scene_qa_rows", 480)])
def test_bytes_per_scene(spark, name, limit):
    n = 6000
    df = cut_lineage(spark.createDataFrame(edits(n, 0.0), SCHEMA).coalesce(2))
    before = shuffled(spark)[1]
    getattr(scenes, name)(df).write.format("noop").mode("overwrite").save()
    assert (shuffled(spark)[1] - before) / n < limit
