import hashlib
import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import types as T

from rollscope.llm.centroids import cluster

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                       T.StructField("cluster", T.StringType()), T.StructField("v", T.StringType())])


def brute(rows, k, rounds, dims, seed=2):
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, *_ in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    centroids = [v for _, v in start]

    def near():
        return [min((sum((x - y) ** 2 for x, y in zip(v, c)), n) for n, c in enumerate(centroids)) for _, v in kept]
    for _ in range(rounds):
        at = near()
        for n in range(len(centroids)):
            mine = [v for (_, v), (_, m) in zip(kept, at) if m == n]
            if mine:
                centroids[n] = [sum(x) // len(mine) for x in zip(*mine)]
    at = near()
    per = Counter()
    for d, n in at:
        per[n] += d
    return [(i, n, d, per[n], sum(per.values()), hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest())
            for (i, _), (d, n) in zip(kept, at)]


def rows_of(n, dims, seed):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 0.3) + (i % 3) for _ in range(dims)], "a", "b") for i in range(n)]
    rows += [(500 + i, rows[2][1], "a", "b") for i in range(40)] + [rows[1], rows[1], (None, rows[3][1], "", ""), (None, rows[3][1], "", "")]
    return rows + [(900, None, "", ""), (901, rows[0][1][:-1], "", ""), (902, [*rows[0][1], 0.0], "", ""), (903, [None] * dims, "", ""),
                   (904, [float("nan")] * dims, "", ""), (905, [float("inf")] * dims, "", ""), (906, [], "", "")]


def test_against_brute_force(spark):
    for dims, k, rounds in ((6, 7, 5), (6, 90, 3), (1, 3, 0), (6, 500, 2)):
        rows = rows_of(80, dims, dims + k)
        got = cluster(spark.createDataFrame(rows, SCHEMA).repartition(3), k=k, rounds=rounds, dims=dims)
        assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
        assert Counter(map(tuple, got.collect())) == Counter(brute(rows, k, rounds, dims))


def test_copies_keep_an_empty_centroid(spark):
    # Equal starting centroids: the smaller number takes all, the other one stays where it started.
    rows = [(i, [1.0, 2.0], "", "") for i in range(5)] + [(9, [-7.3, 0.0], "", "")]
    got = cluster(spark.createDataFrame(rows, SCHEMA), k=6, dims=2).collect()
    assert Counter(map(tuple, got)) == Counter(brute(rows, 6, 5, 2)) and all(r.inertia == 0 for r in got)


def test_no_vectors(spark):
    df = spark.createDataFrame(rows_of(5, 4, 1), SCHEMA)
    for empty in (df.limit(0), df):
        got = cluster(empty, dims=64)
        assert got.count() == 0 and dict(got.dtypes) == {
            "vec_id": "bigint", "cluster": "int", "distance": "bigint", "cluster_inertia": "bigint", "inertia": "bigint", "centroid_sha256": "string"}
