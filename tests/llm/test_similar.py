import random
import re

import numpy as np
import pytest

from corpus_pipeline import near_duplicates
from rollscope.llm import similar


def brute_shingles(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_groups(texts):
    """Group number of each text: linked from a Jaccard similarity of 0.8 on."""
    sets = [brute_shingles(t) for t in texts]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(sets))]


def pairs(n=60):
    """Texts with copies on both sides of the threshold, a common passage, short and empty texts."""
    rng = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(40))
    out = [None, "", " ", "One two", "one  TWO", "one two three"]
    for i in range(n):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(40, 300))]
        if i % 2:
            words += passage.split()
        out.append(" ".join(words))
        for cut in (0.04, 0.1, 0.15, 0.2, 0.24):
            if rng.random() < 0.5:
                out.append(" ".join(words[int(cut * len(words)):]))
                changed = list(words)
                for _ in range(max(1, int(cut * len(words) / 9))):
                    changed[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
                out.append(" ".join(changed))
    return out


def want(texts):
    least = {}
    for i, g in enumerate(brute_groups(texts)):
        least.setdefault(g, i)
    return sorted(least.values())


@pytest.mark.parametrize("least", [similar.SAMPLE_LEAST, 10**9])
def test_every_pair_from_the_threshold_on(spark, docs_of, monkeypatch, least):
    monkeypatch.setattr(similar, "SAMPLE_LEAST", least)
    texts = pairs()
    got = sorted(r.doc_id for r in near_duplicates(spark, docs_of(list(enumerate(texts))), "").collect())
    assert got == want(texts)


def test_pairs_between_080_and_095(spark, docs_of):
    words = [f"w{i}" for i in range(404)]
    rows = []
    for i, cut in enumerate((20, 40, 60, 80, 81)):
        own = [f"{i}{w}" for w in words]
        rows += [(2 * i, " ".join(own)), (2 * i + 1, " ".join(own[cut:]))]
    # 400 shingles each; 0.95, 0.9, 0.85 and 0.8 are copies, 319 / 400 is not.
    assert sorted(r.doc_id for r in near_duplicates(spark, docs_of(rows), "").collect()) == [0, 2, 4, 6, 8, 9]


def test_rows(spark, docs_of):
    a, b = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    rows = [(1, a), (1, a), (1, b), (2, a), (2, "its own text"), (None, a), (None, b), (None, "no id"), (None, "no id")]
    got = sorted(((r.doc_id, r.text) for r in near_duplicates(spark, docs_of(rows), "").collect()), key=str)
    assert got == sorted([(1, a), (1, b), (2, "its own text"), (None, "no id")], key=str)
    assert near_duplicates(spark, docs_of(rows).limit(0), "").count() == 0


def test_common_passage_and_long_texts(spark, docs_of, monkeypatch):
    # No sample: the counts over all prefixes find the passage, which stands in every text.
    monkeypatch.setattr(similar, "SAMPLE_LEAST", 10**9)
    monkeypatch.setattr(similar, "HOT", 3)
    passage = " ".join(f"p{i}" for i in range(300))
    texts = [f"{passage} " + " ".join(f"{i}x{j}" for j in range(60 + 30 * (i // 4))) for i in range(16)]
    long = [f"w{i}" for i in range(80_000)]
    texts += [passage + " " + " ".join(long), passage + " " + " ".join(long[9000:]), " ".join(long[40_000:]), texts[3] + " end"]
    rows = docs_of(list(enumerate(texts))).selectExpr("*", "1 as node", "2 as root", "3 as n", "4 as prefix", "5 as s")
    got = near_duplicates(spark, rows, "")
    assert got.columns == rows.columns
    assert sorted(r.doc_id for r in got.collect()) == want(texts) and near_duplicates(spark, rows.limit(0), "").count() == 0


def test_bitmap_lets_every_match_pass(spark):
    from pyspark.sql import functions as F

    from rollscope.llm.common import maybe_in

    df = spark.range(0, 20_000, 1, 4).selectExpr("id", "id % 7 as x", "cast(id as string) as t")
    wanted = spark.range(0, 20_000, 50).toDF("k")
    got = {r.id for r in maybe_in(df, F.col("id"), wanted).collect()}
    rest = {r.id for r in maybe_in(df, F.col("id"), wanted, other=True).collect()}
    assert set(range(0, 20_000, 50)) <= got and len(got) < 2500 and got | rest == set(range(20_000)) and not got & rest
    assert maybe_in(df, F.col("id"), wanted.limit(0)).count() == 0


def test_texts_without_a_partner_are_not_shuffled(spark):
    """The joins that drop rows came before the filter that spares texts, so all texts were shuffled for them."""
    from pyspark.sql import functions as F

    from rollscope.llm.similar import keep_one_similar
    from tests.shuffled import shuffled

    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    words = F.transform(F.sequence(F.lit(1), F.lit(20)), lambda i: F.repeat(F.md5(F.concat_ws("-", "id", i)), 12))
    noise = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(200)), lambda i: F.md5(F.concat_ws("+", "id", i))), "")
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.array_join(words, " "), noise).alias("text"))
    docs = docs.union(docs.limit(3).select((F.col("doc_id") + 1000).alias("doc_id"), "text")).union(docs.limit(1))
    texts = docs.select(F.sum(F.length("text"))).first()[0]
    try:
        for name in names:
            spark.conf.set(name, "-1")
        before = shuffled(spark)[1]
        assert sorted(r.doc_id for r in keep_one_similar(docs).select("doc_id", F.length("text")).collect()) == list(range(300))
        moved = shuffled(spark)[1] - before
        # The sample for frequent shingles takes all texts of so small a table once.
        assert moved < 1.1 * texts, moved / texts
    finally:
        for name in names:
            spark.conf.unset(name)


def test_members_of_a_shingle_meet_across_blocks(spark, docs_of, monkeypatch):
    monkeypatch.setattr(similar, "BLOCK", 3)
    monkeypatch.setattr(similar, "SAMPLE_LEAST", 10**9)
    texts = pairs(20)
    got = sorted(r.doc_id for r in near_duplicates(spark, docs_of(list(enumerate(texts))), "").collect())
    assert got == want(texts)


def test_a_common_passage_makes_no_row_per_pair(spark, docs_of, monkeypatch):
    """Before, each two of the texts were rows of several joins: the square of their number."""
    from tests.shuffled import shuffled

    monkeypatch.setattr(similar, "SAMPLE_LEAST", 10**9)
    passage = " ".join(f"p{i}" for i in range(30))
    texts = [passage + " " + " ".join(f"{i}x{j}" for j in range(100)) for i in range(700)]
    texts += [x + " end" for x in texts[:50]]
    rows = docs_of(list(enumerate(texts)))
    before = shuffled(spark)[0]
    assert near_duplicates(spark, rows, "").count() == 700
    assert shuffled(spark)[0] - before < 200_000


def test_members_that_all_may_be_linked_make_no_row_per_pair(spark):
    """Before, a shingle whose members all had like classes gave a row for each two of them: 44,850 here."""
    from pyspark.sql import functions as F

    members = spark.range(300).select(
        F.lit(1).cast("long").alias("s"), F.lit(300).cast("long").alias("members"), F.lit(False).alias("in_main"), F.col("id").alias("node"),
        F.col("id").alias("root"), F.lit(60).cast("long").alias("n"), F.lit(0).alias("p"), F.expr("unhex(repeat('01', 256))").alias("classes"))
    pairs = [tuple(r) for r in similar._met_in_cells(members, similar.BLOCK).collect()]
    assert len(pairs) == 299
    reached = {0}
    for _ in range(300):
        reached |= {x for p in pairs if reached & set(p) for x in p}
    assert len(reached) == 300


@pytest.mark.parametrize("block, hashes", [(2048, 1 << 20), (4, 1 << 20), (2048, 300)])
def test_links_inside_a_large_group_of_near_copies(spark, docs_of, monkeypatch, block, hashes):
    """Chains of texts of which only neighbours are similar, all with one passage; blocks by members and by sizes."""
    monkeypatch.setattr(similar, "SAMPLE_LEAST", 10**9)
    monkeypatch.setattr(similar, "SET_BLOCK", block)
    monkeypatch.setattr(similar, "SET_HASHES", hashes)
    monkeypatch.setattr(similar, "COMPARED", 64)
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for chain in range(6):
        words = [f"{chain}w{i}" for i in range(40)]
        for step in range(8):
            texts.append(" ".join(passage + words))
            for _ in range(rng.choice((1, 1, 2, 6))):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    got = sorted(r.doc_id for r in near_duplicates(spark, docs_of(list(enumerate(texts))), "").collect())
    assert got == want(texts) and 1 < len(got) < len(texts)


def test_whole_sets_of_long_unlike_texts_are_not_dealt_to_blocks(spark, docs_of, monkeypatch):
    """Class counts of texts of 8000 shingles are alike, so these were one group whose whole sets went to every block."""
    from tests.shuffled import shuffled

    monkeypatch.setattr(similar, "SAMPLE_LEAST", 10**9)
    monkeypatch.setattr(similar, "SET_HASHES", 16_000)
    passage = " ".join(f"p{i}" for i in range(40))
    texts = [passage + " " + " ".join(f"{i}x{j}" for j in range(8000)) for i in range(40)]
    texts += [" ".join(x.split()[:7800]) for x in texts[:2]]
    rows = docs_of(list(enumerate(texts)))
    before = shuffled(spark)[1]
    assert sorted(r.doc_id for r in near_duplicates(spark, rows, "").collect()) == list(range(40))
    moved = shuffled(spark)[1] - before
    assert moved < 12 * sum(map(len, texts)), moved / sum(map(len, texts))


def test_bitmaps_of_two_sizes_bound_common_shingles():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(-2**63, 2**63, n)) for n in (0, 1, 100, 128, 129, 150, 500, 520, 600)]
    sets += [np.concatenate([s[len(s) // 10:], rng.integers(-2**63, 2**63, len(s) // 10)]) for s in sets] + [sets[3][:110]]
    n = np.array([len(s) for s in sets])
    bitmaps = similar._Bitmaps([similar._bitmap(s) for s in sets], n)
    x, y = np.triu_indices(len(n), 1)
    fit = 5 * np.minimum(n[x], n[y]) >= 4 * np.maximum(n[x], n[y])
    x, y = x[fit], y[fit]
    common = np.array([len(np.intersect1d(sets[i], sets[j])) for i, j in zip(x, y)])
    enough = bitmaps.enough(x, y, n[x] + n[y])
    assert enough[9 * common >= 4 * (n[x] + n[y])].all() and not enough[(common == 0) & (n[x] > 0)].any()
    assert len({len(similar._bitmap(s)) for s in sets}) > 2
