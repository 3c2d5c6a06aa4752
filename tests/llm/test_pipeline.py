import math
import re
import zlib
from collections import Counter
from hashlib import md5

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

import corpus_pipeline
from rollscope.llm.decontaminate import brute_contamination
from rollscope.llm.mixing import mix_plan
from tests.llm.test_quality_rules import brute as brute_rules
from tests.llm.test_similar import brute_groups

SF = "/root/testdata/sf0.001"
SP = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def brute_kept(text):
    if brute_rules(text)[5]:
        return False
    words = re.findall(r"[^\x20\x09-\x0d]+", text)
    pieces = [p for w in words for p in SP.encode(w)]
    n = len(pieces)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(pieces).values())
    # The bands of Latin script, which all documents of this table have.
    return 1.5 <= sum(map(len, words)) / n <= 6 and sum(map(SP.is_byte, pieces)) / n <= 0.05 and \
        entropy >= 0.75 * math.log2(min(n, 64))


def brute_copies(rows):
    """(doc_id, text, source) to copies, by the sums themselves."""
    size = {k: len(re.findall(r"[^\x20\x09-\x0d]+", t or "")) for k, t, _ in rows}
    sources = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[k] for k, _, x in rows if x == s) for s in sources}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    full = set()
    while True:
        left = 1.5 * sum(total.values()) - sum(2.0 * total[s] for s in full)
        free = [s for s in sources if s not in full]
        level = left / sum(weight[s] for s in free)
        above = {s for s in free if 2.0 * total[s] < level * weight[s]}
        if not above:
            break
        full |= above
    target = {s: min(2.0 * total[s], level * weight[s]) for s in sources}
    out = {}
    for s in sources:
        u = int(md5(("=" + s if s is not None else "").encode()).hexdigest()[:8], 16) / 2**32
        own = sorted((k for k, _, x in rows if x == s), key=lambda k: (size[k], k))
        rate = target[s] / total[s] if total[s] else 0.0
        for i, k in enumerate(own):
            out[k] = math.floor((i + 1) * rate + u) - math.floor(i * rate + u)
    return out, size, total, target


def test_pipeline_against_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    items = [(str(k), t) for k, t in items]
    left = [r for r in docs if brute_kept(r[1])]
    least = {}
    for (k, *_), g in zip(left, brute_groups([t for _, t, _ in left])):
        least[g] = min(k, least.get(g, k))
    left = [r for r in left if r[0] in least.values()]
    left = [r for r in left if not brute_contamination(r[1], items)[4]]
    copies = brute_copies(left)[0]
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, at = [], 0
    for k, t, _ in sorted(left):
        ids = tok.encode(t, add_special_tokens=False).ids + [1]
        for _ in range(copies[k]):
            want.append((k, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            at += len(ids)
    got = sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()), key=lambda r: r[1])
    assert got == want and 0 < len(left) < len(docs)


def test_stages_keep_the_columns(spark, docs_of):
    docs = docs_of([(1, None, None), (2, "", "a")]).selectExpr("*", "1 as size", "2 as copies", "3 as fp", "4 as n_hit")
    for frame in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, frame, SF).columns == docs.columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 2


def test_mix(spark, docs_of):
    rows = [(i, "w " * (i % 13), f"s{i % 5}" if i % 7 else None) for i in range(400)] + [(900, None, "empty"), (901, "w " * 9000, "s1")]
    copies, size, total, target = brute_copies(rows)
    docs = docs_of(rows)
    got = {r.doc_id: r for r in mix_plan(docs).collect()}
    assert {k: r.copies for k, r in got.items()} == copies
    for k, _, s in rows:
        r = got[k]
        assert (r.size, r.source_size, r.taken) == (size[k], total[s], copies[k] * size[k]) and r.copies <= 2
        assert math.isclose(r.target, target[s])
    for s in total:
        assert abs(sum(r.taken for r in got.values() if r.source == s) - target[s]) <= max(size[k] for k, _, x in rows if x == s)
    repeated = docs_of([(1, "a b", "x"), (1, "a b", "x"), (None, "c", "x")])
    assert sum(r.copies for r in mix_plan(repeated).collect()) in range(3, 6)
    assert mix_plan(docs.limit(0)).count() == 0


def test_rows_with_one_id_keep_their_own_counts(spark):
    """Each row is taken as often as the plan says for its id, source and size, also under a shared or missing id."""
    from collections import Counter

    from rollscope.llm.mixing import mix_documents

    rows = [(1, "one two three", "a", 5), (1, "four five six", "a", 6), (1, "four five six", "a", 6), (1, "long " * 40, "a", 7), (1, "x", "b", 8),
            (None, "some words", "a", 9), (None, "some words", None, 9), (None, None, "a", 1), (2, "alone here", "a", 2), (3, "", "a", 3)]
    rows += [(i, "plain words of text " * (i % 5 + 1), "abc"[i % 3], i) for i in range(10, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies long").withColumnsRenamed({"doc_id": "id"})
    plan = Counter()
    for r in mix_plan(docs, doc_id="id").collect():
        plan[r.doc_id, r.source, r["size"]] += r.copies
    got = mix_documents(docs, doc_id="id")
    assert got.columns == docs.columns
    taken = Counter()
    texts = Counter()
    for r in got.collect():
        taken[r.id, r.source, len((r.text or "").split())] += 1
        texts[tuple(r)] += 1
    assert taken == +plan and set(texts) <= set(rows)
    # Documents of equal size and source never differ by more than one copy.
    assert all(n <= 2 * rows.count(k) for k, n in texts.items())
    assert sorted(map(str, got.collect())) == sorted(map(str, mix_documents(docs, doc_id="id").collect()))
    assert mix_documents(docs.limit(0), doc_id="id").count() == 0


def test_mix_shuffles_each_text_once_at_most(spark):
    """Before, all texts were shuffled a second time to look for ids that several rows share."""
    from pyspark.sql import functions as F

    from rollscope.llm.mixing import mix_documents
    from tests.shuffled import shuffled

    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(300)), lambda i: F.md5(
        F.concat_ws("-", "id", i)))).alias("text"), F.lit("a").alias("source"))
    try:
        for name in names:
            spark.conf.set(name, "-1")
        for rows, most in ((docs, 1.1), (docs.union(docs.limit(3)), 1.2)):
            before = shuffled(spark)[1]
            assert mix_documents(rows).select(F.sum(F.length("text"))).first()[0] > 400 * 9000
            texts = rows.select(F.sum(F.length("text"))).first()[0]
            assert shuffled(spark)[1] - before < most * texts, (shuffled(spark)[1] - before) / texts
    finally:
        for name in names:
            spark.conf.unset(name)


def test_mix_moves_few_texts(spark):
    """Before, the join of counts by id moved every text once the counts were too many to broadcast."""
    from pyspark.sql import functions as F

    from rollscope.llm.mixing import mix_documents
    from tests.shuffled import shuffled

    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(300)), lambda i: F.md5(
        F.concat_ws("-", "id", i)))).alias("text"), F.lit("a").alias("source"))
    docs = docs.union(docs.filter("doc_id < 3"))
    try:
        for name in names:
            spark.conf.set(name, "-1")
        before = shuffled(spark)[1]
        assert mix_documents(docs).select(F.sum(F.length("text"))).first()[0] > 400 * 9000
        texts = docs.select(F.sum(F.length("text"))).first()[0]
        assert shuffled(spark)[1] - before < 0.2 * texts, (shuffled(spark)[1] - before) / texts
    finally:
        for name in names:
            spark.conf.unset(name)


def test_counts_by_crowded_bitmaps(spark, monkeypatch):
    """Bitmaps without room name most ids; those rows find their counts by a join. More copies than three, too."""
    from pyspark.sql import functions as F

    from rollscope.llm import common
    from rollscope.llm.mixing import mix_documents

    monkeypatch.setattr(common, "KEY_BITS", 0)
    docs = spark.range(70_000).selectExpr("id as doc_id", "repeat('w ', int(id % 7)) as text", "concat('s', id % 3) as source")
    docs = docs.union(spark.sql("select cast(null as long), 'one two', 's1'"))
    for targets in ({}, {"share": 5.0, "most": 6.0}):
        plan = mix_plan(docs, **targets).filter("copies > 0").select("doc_id", "copies")
        got = mix_documents(docs, **targets).groupBy("doc_id").agg(F.count(F.lit(1)).alias("copies"))
        assert plan.exceptAll(got).isEmpty() and got.exceptAll(plan).isEmpty() and got.count() > 60_000
