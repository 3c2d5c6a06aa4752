import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollscope.llm import hard_negatives as hn

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                       T.StructField("label", T.IntegerType()), T.StructField("score", T.StringType()), T.StructField("uid", T.StringType())])


def brute(rows, every=5, n_pos=5, n_neg=3):
    kept = [(i, l, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, l, *_ in rows
            if l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (a, la, va) in enumerate(kept):
        if a is None or a % every:
            continue
        scored = [(-sum(x * y for x, y in zip(va, v)), i is None, i or 0, l) for j, (i, l, v) in enumerate(kept) if j != at]
        for s, none, p, _ in sorted(x for x in scored if x[3] == la)[:n_pos]:
            ok = sorted(x for x in scored if x[3] != la and 50 * -s <= -100 * x[0] <= 95 * -s)[:n_neg]
            out += [(a, None if none else p, k + 1, None if m else n, -s, -t) for k, (t, m, n, _) in enumerate(ok)]
    return out


def vectors(n, seed, dims=12, labels=4):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 0.4) + (0.3 if d == i % labels else 0) for d in range(dims)], i % labels if rng.random() > 0.4 else 0, "x", "y")
            for i in range(n)]
    # Copies under other labels, ties, repeated rows, short and empty vectors, rows that take no part.
    rows += [(1000 + i, rows[3][1], i % 3, "x", "y") for i in range(30)] + [rows[5], rows[10], rows[10]]
    rows += [(2000, rows[4][1][:5], 1, "", ""), (2005, [], 1, "", ""), (2010, [], 2, "", ""), (2015, rows[7][1], None, "", ""), (2020, None, 1, "", ""),
             (2025, rows[7][1][:-1] + [None], 1, "", ""), (2030, rows[7][1][:-1] + [float("nan")], 1, "", ""),
             (2035, rows[7][1][:-1] + [float("-inf")], 1, "", ""), (None, rows[3][1], 1, "", ""), (None, rows[3][1], 2, "", "")]
    return rows


@pytest.mark.parametrize("blocks", [(10_000, 10_000), (40, 16)])
def test_against_brute_force(spark, blocks):
    rows = vectors(160, 7)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = hn.hard_negatives(df, F.col("vec_id") % 5 == 0, block_rows=blocks[0], block_anchors=blocks[1])
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute(rows)
    assert len(want) > 100 and Counter(map(tuple, got.collect())) == Counter(want)


def test_no_rows(spark):
    df = spark.createDataFrame(vectors(20, 1), SCHEMA)
    assert hn.hard_negatives(df.limit(0), F.lit(True)).count() == 0
    assert hn.hard_negatives(df, F.lit(False)).count() == 0
    assert hn.hard_negatives(df.withColumn("label", F.lit(3)), F.lit(True)).count() == 0


def test_index_misses_no_pair():
    rng = np.random.default_rng(5)
    x = np.floor(rng.normal(0, 40, (400, 30)) * rng.uniform(0, 1, (400, 1)))
    a = np.floor(rng.normal(0, 40, (300, 30)))
    score = x @ a.T
    for quantile in (0.5, 0.99, 0.9999):
        least = np.quantile(score, quantile, axis=0) + rng.integers(-50, 50, 300)
        got = {(r, c): s for rr, cc, ss in hn.Index(x).above(a, least) for r, c, s in zip(rr.tolist(), cc.tolist(), ss.tolist())}
        assert got == {(r, c): score[r, c] for r, c in zip(*np.nonzero(score >= least))}


def test_index_leaves_out_what_norms_cover(monkeypatch):
    x = np.zeros((100, 16))
    x[:, :4] = 50
    x[:50, 8:] = 1
    left_out = []
    finish = hn.Index._finish
    monkeypatch.setattr(hn.Index, "_finish", lambda self, live, *rest: left_out.append((len(live), rest[-1])) or finish(self, live, *rest))
    list(hn.Index(x).above(x[:1] * 1.0, np.array([9000.0])))
    # Only the first list is read: the rest of each vector cannot reach the threshold by itself.
    assert left_out and all(lo == 8 for _, lo in left_out)


def test_large_components_stay_exact(spark):
    big = float(2 ** 20)
    rows = [(0, [big, 1.0], 1, "", ""), (1, [big, 2.0], 1, "", ""), (2, [big * 0.75, 1.0], 2, "", ""), (3, [big * 0.6, 0.0], 2, "", "")]
    got = hn.hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 0).collect()
    assert Counter(map(tuple, got)) == Counter(brute(rows, every=10)) and len(got) == 2
