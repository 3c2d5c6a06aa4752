"""Skew-safe helpers give the plain window result when every key counts as hot."""

import random

from pyspark.sql import functions as F

from rollscope.operators import ordered, pairs, skew


def rows_of(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def skewed(spark, n=500):
    rnd = random.Random(3)
    return spark.createDataFrame(
        [(1 if i % 3 == 0 else rnd.randrange(2, 9), i, float(rnd.randrange(100))) for i in range(n)], "k int, id int, v double")


def test_attach_stats_on_hot_keys(spark):
    df = skewed(spark)
    got = skew.with_group_stats(df, ["k"], {"m": F.max("v"), "n": F.count(F.lit(1))})
    data = [(r.k, r.id, r.v) for r in df.collect()]
    want = sorted((k, i, max(v for a, _, v in data if a == k), sum(a == k for a, _, _ in data)) for k, i, _ in data)
    assert rows_of(got, "k", "id", "m", "n") == want


def test_number_rows_global_and_by_key(spark):
    df = skewed(spark)
    data = sorted(((r.v, r.id, r.k) for r in df.collect()), key=lambda t: (-t[0], t[1]))
    order = [F.col("v").desc(), F.col("id").asc()]
    assert rows_of(skew.number_rows(df, order, "rn"), "rn", "id") == [(i + 1, t[1]) for i, t in enumerate(data)]
    seen, want = {}, []
    for _, i, k in data:
        seen[k] = seen.get(k, 0) + 1
        want.append((k, seen[k], i))
    assert rows_of(skew.number_rows_by_key(df, ["k"], order, "rn"), "k", "rn", "id") == sorted(want)


def test_running_sums_and_suffix_max(spark):
    df = skewed(spark)
    got = skew.running(df, ["k"], [F.col("id").asc()], sums={"s": F.col("v")}, suffix_max={"x": F.col("v")})
    want = []
    for k in {r.k for r in df.collect()}:
        group = sorted((r.id, r.v) for r in df.collect() if r.k == k)
        for j, (i, _) in enumerate(group):
            want.append((k, i, sum(v for _, v in group[:j + 1]), max(v for _, v in group[j:])))
    assert rows_of(got, "k", "id", "s", "x") == sorted(want)


def test_ema_across_chunks(spark):
    df = skewed(spark)
    got = ordered.ema(df, ["k"], [F.col("id").asc()], {"b": "v"}, 0.9, init=2.0, chunk=7)
    want = {}
    for k in {r.k for r in df.collect()}:
        base = 2.0
        for i, v in sorted((r.id, r.v) for r in df.collect() if r.k == k):
            base = 0.9 * base + 0.1 * v
            want[i] = base
    assert all(abs(r.b - want[r.id]) < 1e-9 for r in got.collect())


def test_stage_switch_known_steps(spark):
    # Perfect accuracy: 0.95^n <= 0.1 first holds at update 45; without triggers patience forces 20 and 40.
    steps = spark.createDataFrame([(1, i, 1.0, 0.0) for i in range(60)] + [(2, i, 0.5, 0.0) for i in range(60)],
                                  "run int, step int, acc double, na double")
    free = ordered.stage_switch(steps.filter("run = 1"), "run", "step", patience=None)
    assert [r.step + 1 for r in free.filter("switched").orderBy("step").collect()][:1] == [45]
    forced = ordered.stage_switch(steps.filter("run = 2"), "run", "step", err_up=0.99)
    assert [r.step + 1 for r in forced.filter("switched").orderBy("step").collect()][:2] == [20, 40]


def test_sibling_fold_with_many_tiles(spark):
    rnd = random.Random(5)
    words = "abcdefg"
    data = [(i % 2, i, sorted({rnd.choice(words) for _ in range(3)})) for i in range(60)]
    df = spark.createDataFrame(data, "g int, id int, w array<string>")
    want = {}
    for g, i, w in data:
        sims = [len(set(w) & set(x)) / len(set(w) | set(x)) for a, j, x in data if a == g and j != i]
        want[i] = sum(sims) / len(sims)
    for tile, block in ((64, 2048), (4, 2048), (4, 7)):
        got = pairs.sibling_overlap(df, ["g"], "id", "w", tile, block).collect()
        assert len(got) == 60 and all(abs(r.total / r.others - want[r.id]) < 1e-12 for r in got)
    assert {r.id: r.mean_jaccard for r in pairs.mean_sibling_jaccard(df, ["g"], "id", "w").collect()}.keys() == want.keys()


def test_sibling_sets_null_empty_repeated(spark):
    data = [(None, 1, ["a", "b"]), (None, 2, ["b", "a", "a"]), (None, 2, ["c"]), (None, 3, []), (None, 4, None), (7, 5, ["a"]), (7, 6, None)]
    df = spark.createDataFrame(data, "g int, id int, w array<string>")
    want = [(1, 2, 4, 1.0), (2, 1, 4, 0.0), (2, 2, 4, 1.0), (3, 0, 4, 0.0), (4, 0, 4, 0.0), (5, 1, 1, 0.0), (6, 0, 1, 0.0)]
    for tile in (64, 0):
        got = pairs.sibling_overlap(df, ["g"], "id", "w", tile, 2)
        assert rows_of(got, "id", "own", "others", "total") == want
        assert pairs.sibling_overlap(df.limit(0), ["g"], "id", "w", tile, 2).count() == 0


def test_hot_group_ships_sets_times_blocks(spark):
    df = spark.range(5000).selectExpr("1 as g", "id", "array(concat('w', id % 1000), concat('x', id % 7), 'all') as w")
    got = {r.id: r.total for r in pairs.sibling_overlap(df, ["g"], "id", "w", block=300).collect()}
    for i in (0, 1, 999, 4999):
        want = 0.0
        for j in range(5000):
            if j != i:
                both = 1 + (i % 1000 == j % 1000) + (i % 7 == j % 7)
                want += both / (6 - both)
        assert abs(got[i] - want) < 1e-6
    assert len(got) == 5000


def test_step_coverage_bounds_change_nothing(spark):
    from rollscope.functions import text as T
    from rollscope.operators.certificate import step_coverage

    rnd = random.Random(9)
    step = lambda: " ".join(rnd.choice(["red", "cube", "left", "of", "metal", "sphere", "moved"]) for _ in range(rnd.randrange(0, 9)))
    ref = [(k, step() if i else None) for k in (1, None, 3) for i in range(6)]
    said = [(k, step()) for k in (1, None) for _ in range(150)] + [(1, None), (1, ref[1][1])]
    left, right = (spark.createDataFrame(rows, "k int, text string") for rows in (ref, said))
    pairs_of = left.withColumn("i", F.monotonically_increasing_id()).alias("l").join(
        right.withColumn("met", F.lit(True)).alias("r"), F.col("l.k").eqNullSafe(F.col("r.k")), "left")
    plain = pairs_of.groupBy("l.k", "i").agg(F.coalesce(F.max(F.when(
        F.col("met"), T.step_similarity(F.col("r.text"), F.col("l.text")))), F.lit(0.0)).alias("b"))
    want = {r.k: r.c for r in plain.groupBy("k").agg(F.avg("b").alias("c")).collect()}
    got = step_coverage(left, right, "k", "text").collect()
    assert {r.k for r in got} == set(want) and all(abs(r.coverage - want[r.k]) < 1e-12 for r in got)
    assert want[3] == 0 and sum(r.edits for r in got) < 0.7 * 5 * 300


def test_ema_keeps_far_carries_at_every_rate(spark):
    rnd = random.Random(8)
    values = [1e6 if i == 0 else 0.0 if i < 900 else rnd.random() for i in range(1500)]
    df = spark.createDataFrame([(None, i, v) for i, v in enumerate(values)], "k int, id int, v double")
    for alpha in (0.0, 0.2, 0.9, 0.9999, 1.0):
        base, want = 0.5, []
        for v in values:
            base = alpha * base + (1 - alpha) * v
            want.append(base)
        got = [r.b for r in ordered.ema(df, ["k"], [F.col("id").asc()], {"b": "v"}, alpha, init=0.5, chunk=5).orderBy("id").collect()]
        assert len(got) == len(want)
        assert all(abs(a - b) <= 1e-9 * abs(b) + 1e-300 for a, b in zip(got, want)), alpha


def test_stage_switch_over_many_chunks(spark):
    rnd = random.Random(4)
    data = [(r, i, rnd.random(), rnd.random() * 0.2) for r in (1, None) for i in range(700)]
    steps = spark.createDataFrame(data, "run int, step int, acc double, na double")
    plain = ordered.CHUNK
    want = {(r.run, r.step): (r.stage, r.switched) for r in ordered.stage_switch(steps, "run", "step", acc_up=0.5).collect()}
    try:
        ordered.CHUNK = 6
        got = {(r.run, r.step): (r.stage, r.switched) for r in ordered.stage_switch(steps, "run", "step", acc_up=0.5).collect()}
    finally:
        ordered.CHUNK = plain
    assert len(want) == 1400 and got == want and any(s for _, s in want.values())


def test_null_keys_are_a_group(spark):
    df = spark.createDataFrame([(None, 1, 5.0), (None, 2, 7.0), (1, 3, 1.0)], "k int, id int, v double")
    assert rows_of(skew.running(df, ["k"], [F.col("id").asc()], sums={"s": F.col("v")}).fillna(-1), "k", "id", "s") == [
        (-1, 1, 5.0), (-1, 2, 12.0), (1, 3, 1.0)]
    assert rows_of(skew.number_rows_by_key(df, ["k"], [F.col("id").asc()]).fillna(-1), "k", "id", "rn") == [(-1, 1, 1), (-1, 2, 2), (1, 3, 1)]
    words = df.select("k", "id", F.array(F.lit("a"), F.col("id").cast("string")).alias("w"))
    assert {r.id: r.mean_jaccard for r in pairs.mean_sibling_jaccard(words, ["k"], "id", "w").collect()} == {1: 1 / 3, 2: 1 / 3, 3: 0.0}


def test_top_per_key_beyond_the_rank_limit(spark):
    df = spark.range(4000).selectExpr("if(id % 3 = 0, null, id % 2) as k", "id")
    small, large = (skew.top_per_key(df, ["k"], [F.col("id").desc()], n, rank="r") for n in (1000, 1001))
    assert large.groupBy("k").count().filter("count = 1001").count() == 3
    assert rows_of(large.filter("r <= 1000").fillna(-1), "k", "id", "r") == rows_of(small.fillna(-1), "k", "id", "r")


def test_suffix_maximum_is_linear(spark):
    import time

    def seconds(n):
        df = spark.range(n).selectExpr("1 as k", "id", "cast(hash(id) as double) as v")
        start = time.perf_counter()
        skew.running(df, ["k"], [F.col("id").asc()], suffix_max={"m": F.col("v")}).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start
    seconds(1000)
    assert seconds(400_000) < 40
