import random

import numpy as np
import pytest
import xxhash

from rollscope.llm import simhash
from rollscope.llm.components import connected_components
from rollscope.llm.simhash import fingerprint, keep_one, near_duplicates


def brute_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0d]+", low) if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, most=4):
    """(id, fp) pairs to the smallest id reachable."""
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, (_, a) in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j][1]).bit_count() <= most:
                parent[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(fps):
        least[find(i)] = min(least.get(find(i), k), k)
    return {k: least[find(i)] for i, (k, _) in enumerate(fps)}


TEXTS = ["", " \n", "One", "one two", "A b C d", "É b C d e", "x　y z w q r s t", "the same words " * 50, "a\x0bb\x1cc d e f"]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert fingerprint(text.encode()) & (2**64 - 1) == brute_fingerprint(text)


def near_rows(n=220):
    rng = random.Random(5)
    rows, base = [], " ".join(rng.choice("abcdefghij") * rng.randint(1, 4) for _ in range(400))
    for i in range(n):
        words = (base if i % 3 else " ".join(str(rng.random()) for _ in range(60))).split()
        for _ in range(i % 7):
            words[rng.randrange(len(words))] = f"w{rng.randrange(9)}"
        rows.append((n - i, " ".join(words)))
    return rows + [(1000, None), (999, ""), (7, " "), (2000, rows[0][1]), (2000, rows[0][1])]


@pytest.mark.parametrize("crowded", [simhash.CROWDED, 3])
def test_components(spark, docs_of, crowded):
    rows = near_rows()
    want = brute_components([(k, brute_fingerprint(t or "")) for k, t in {(k, t) for k, t in rows}])
    got = near_duplicates(docs_of(rows), crowded=crowded).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got} == want
    kept = {r.doc_id for r in keep_one(docs_of(rows)).collect()}
    assert kept == set(want.values())


def test_links_at_every_distance(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(300)]
    fps = {*base}
    for b in base:
        for d in (1, 2, 3, 4, 5, 6):
            x = b
            for bit in rng.sample(range(64), d):
                x ^= 1 << bit
            fps.add(x)
    fps = sorted(fps)
    signed = [int(np.uint64(x).view(np.int64)) for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long").repartition(4)
    roots = dict(map(tuple, connected_components(simhash.links(df)).collect()))
    want = brute_components(list(enumerate(fps)))
    mine = {}
    for i, x in enumerate(signed):
        mine.setdefault(roots.get(x, x), []).append(i)
    assert {i: g[0] for g in mine.values() for i in g} == want


def test_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 300) if i != 150], "a long, b long")
    roots = dict(map(tuple, connected_components(edges).collect()))
    assert len(roots) == 301
    assert len({roots[i] for i in range(151)}) == 1 and len(set(roots.values())) == 2


def test_empty(spark, docs_of):
    assert near_duplicates(docs_of([(1, "x")]).limit(0)).count() == 0
