"""Centroid clustering of integer vectors in JVM expressions.

Components become integers floor(scale * x). A round is one pass: `zip_with` and `aggregate` compute each vector's squared
distances to a literal array of centroids, `array_min` over (distance, number) structs takes the nearest (ties: the smaller
number), and one partial/final aggregate sums the vectors' columns per centroid. Only these sums, one row per centroid, reach
the driver; new centroids are exact floors of sum / count. The vectors are stored once and never shuffled.

Defined results: vectors that are null, of another length, or with a null or non-finite component take no part. Rows with a
null id are assigned but never start a centroid. Repeated rows are separate vectors; repeated ids start centroids in the
order of (hash, vector). Fewer vectors than `k` give fewer centroids, none give an empty result. Columns besides id and
vector are ignored, whatever their names. Distances must fit in a long: components below 10^6 in size always do; beyond, the
job ends with an overflow error rather than a wrong number.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollscope.llm.common import stored

K, ROUNDS, SEED, DIMS, SCALE = 40, 5, 2, 64, 256


def finite(vector: Column) -> Column:
    """True if the array has no null, NaN or infinite component; null for a null array."""
    return F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf"))))


def integers(vector: Column, scale: int = SCALE) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def long_array(values: list[int]) -> str:
    # The least long cannot be written as a literal with a sign in front.
    return "array(" + ",".join(f"{v}L" if v > -(1 << 63) else "bigint('-9223372036854775808')" for v in values) + ")"


def nearest(centroids: list[list[int]], vector: str = "v") -> Column:
    """Struct (distance, cluster) of the nearest centroid."""
    table = "array(" + ",".join(map(long_array, centroids)) + ")"
    return F.expr(
        f"array_min(transform({table}, (c, i) -> named_struct('distance', aggregate(zip_with({vector}, c,"
        " (a, b) -> (a - b) * (a - b)), 0L, (s, x) -> s + x), 'cluster', i)))")


def updated(rows: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Centroids after one round: floors of the column means of their vectors; those without vectors stay."""
    dims = len(centroids[0])
    placed = rows.select(nearest(centroids)["cluster"].alias("cluster"), "v")
    sums = placed.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(dims)])
    out = list(centroids)
    # At most one row per centroid.
    for r in sums.collect():
        out[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(dims)]
    return out


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED, dims: int = DIMS, scale: int = SCALE,
            vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that takes part."""
    v = F.col(f"`{vector}`")
    kept = vectors.filter((F.size(v) == dims) & finite(v))
    rows = stored(kept.select(F.col(f"`{vec_id}`").alias("vec_id"), integers(v, scale).alias("v")), "vectors")
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    start = rows.filter("vec_id is not null").select(key.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    centroids = [list(r["v"]) for r in start]
    if not centroids:
        return rows.limit(0).select(
            "vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance"),
            F.lit(0).cast("bigint").alias("cluster_inertia"), F.lit(0).cast("bigint").alias("inertia"), F.lit("").alias("centroid_sha256"))
    for _ in range(rounds):
        centroids = updated(rows, centroids)
    final = stored(rows.select("vec_id", nearest(centroids).alias("at")).select("vec_id", "at.cluster", "at.distance"), "clusters")
    per = {r["cluster"]: r["d"] for r in final.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    names = ",".join(f"'{hashlib.sha256(','.join(map(str, c)).encode()).hexdigest()}'" for c in centroids)
    return final.select(
        "vec_id", "cluster", "distance",
        F.expr(f"{long_array([per.get(i, 0) for i in range(len(centroids))])}[cluster]").alias("cluster_inertia"),
        F.lit(sum(per.values())).cast("bigint").alias("inertia"), F.expr(f"array({names})[cluster]").alias("centroid_sha256"))
