import random

from hypothesis import given, settings
from hypothesis import strategies as st

from rollscope.llm.decontaminate import _finder, brute_contamination, contamination, drop_contaminated

WORDS = ["a", "b", "c", "é", "x1"]
TEXT = st.lists(st.sampled_from([*WORDS, "zz", "yy"]), max_size=40).map(" ".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=5), st.lists(TEXT, min_size=1, max_size=4))
def test_windows_against_brute_force(docs, items):
    items = [(str(i), t) for i, t in enumerate(items)]
    n, spans, found, _ = _finder([(k, t.encode()) for k, t in items], 4)()([d.encode() for d in docs])
    for i, d in enumerate(docs):
        want = brute_contamination(d, items, 4)
        assert (n[i], sum(b - a for a, b in spans[i]), len(found[i])) == want[:3]


ITEMS = [("i1", " ".join(f"w{i}" for i in range(40))), ("i2", "short item"), ("i3", ""), ("i4", None),
         ("i10", "A-b, c! " * 30), (None, "no id here"), ("i2", "short item")]
DOCS = [(1, " ".join(f"W{i}" for i in range(3, 30)) + " and more " * 5), (2, "a short ITEM, and a short item"), (3, None),
        (4, ""), (5, "a b c a b c a b c a b c a b c"), (6, "x " * 300 + "short item"), (7, "no id here"),
        (8, "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 zz"), (2, "a short ITEM, and a short item"), (None, "short item"),
        (9, "x " * 20000 + " ".join(f"w{i}" for i in range(13)))]


def check(spark, docs_of, **options):
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    got = contamination(docs_of(DOCS), items, **options).collect()
    want = sorted(((k, *brute_contamination(t, [x for x in ITEMS])) for k, t in DOCS if k != 7), key=str)
    mine = [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got if r.doc_id != 7]
    assert sorted(mine, key=str) == want
    null_item = next(r for r in got if r.doc_id == 7)
    assert (null_item.n_hit, null_item.n_items, null_item.contaminated) == (3, 0, True)
    return {r.doc_id: r for r in got}


def test_one_block(spark, docs_of):
    rows = check(spark, docs_of)
    assert dict(zip(rows[1].items, rows[1].longest)) == {"i1": 27}
    assert rows[1].spans == [[0, 27]]


def test_blocks(spark, docs_of):
    check(spark, docs_of, block_words=30)


def test_filter_keeps_columns_and_clean_rows(spark, docs_of):
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    docs = docs_of(DOCS).selectExpr("*", "1 as n_hit", "text as n_words", "doc_id as item_id")
    left = drop_contaminated(docs, items)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == [3, 4, 6, 8, 9]
    assert drop_contaminated(docs.limit(0), items).count() == 0
    assert drop_contaminated(docs, items.limit(0)).count() == len(DOCS)


def test_random_corpus(spark, docs_of):
    rng = random.Random(3)
    items = [(f"q{i}", " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 30)))) for i in range(8)]
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(200)) + " " + rng.choice(items)[1]) for i in range(30)]
    got = contamination(docs_of(rows), spark.createDataFrame(items, "item_id string, text string")).collect()
    for r in got:
        assert tuple(r)[1:6] == brute_contamination(rows[r.doc_id][1], items)
