import numpy as np
import pytest

from rollscope.llm import language_id, quality_model
from rollscope.llm.common import crc_mod
from rollscope.llm.quality_model import FEATURES, MOST_PASSAGES, Model, Passages, fit

SF = "/root/testdata/sf0.1"
ODD = [(-1, None), (-2, ""), (-3, " \n\t "), (-4, "12 34 !!"), (-5, "word " * 70000), (-6, "é"), (None, "some words here")]


@pytest.fixture(scope="module")
def tables(spark):
    return {t: spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels")}


def test_language_held_out(spark, tables):
    docs = tables["documents"]
    got = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert len(got) == docs.count() and len(held) > 1000
    assert (held.lang == held.lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_language_odd_rows(spark, docs_of):
    learnt = [(i, f"the quick brown fox number {i} jumps over lazy dogs", "s", "en") for i in range(20)]
    learnt += [(100 + i, f"der schnelle braune Fuchs springt über {i} faule Hunde", "s", "de") for i in range(20)]
    docs = docs_of(learnt + ODD + [(500, "über faule Hunde", "s", None)]).selectExpr("*", "1 as score", "2 as held_out")
    rows = {r.doc_id: r for r in language_id.identify(docs).collect()}
    assert len(rows) == 40 + len(ODD) + 1
    for k in (-1, -2, -3, -4):
        assert (rows[k].lang_pred, rows[k].score) == ("und", 0.0)
    assert rows[500].lang_pred == "de" and rows[-6].lang_pred in ("de", "en")
    assert language_id.identify(docs.limit(0)).count() == 0
    unlearnt = language_id.identify(docs.withColumn("lang", docs.lang.substr(9, 1)).filter("false").union(docs.limit(3)))
    assert unlearnt.count() == 3


def test_quality_held_out(spark, tables):
    docs, labels = tables["documents"], tables["labels"]
    got = quality_model.classify(docs, labels).join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    assert len(held) > 500
    right = (held.predicted == held.quality)
    assert right.mean() > 0.95
    assert right[held.quality == 0].mean() > 0.85
    again = quality_model.classify(docs, labels).select("doc_id", "score").toPandas()
    assert dict(zip(got.doc_id, got.score)).items() <= dict(zip(again.doc_id, again.score)).items()


def test_quality_odd_rows(spark, docs_of):
    docs = docs_of(ODD + [(i, "plain words " * 9 if i % 2 else "@@ ## " * 9) for i in range(30)] + [(3, "plain words " * 9)])
    docs = docs.selectExpr("*", "'x' as score", "1 as quality")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)] + [(3, 1), (3, 0), (None, 1), (77, None)], "doc_id long, quality int")
    got = quality_model.classify(docs, labels).collect()
    assert len(got) == len(ODD) + 31 and all(0 <= r.score <= 1 for r in got)
    assert [r.predicted for r in got if r.doc_id == 1] == [1] and [r.predicted for r in got if r.doc_id == 2] == [0]
    for some in (labels.filter("quality = 1"), labels.limit(0)):
        flat = quality_model.classify(docs, some).collect()
        assert {r.score for r in flat} == ({1.0} if some.count() else {0.5})
    assert quality_model.classify(docs.limit(0), labels).count() == 0


def test_passages_cover_the_text():
    x = Passages().rows(b"one two  " * 100 + b"TAIL!")
    assert x.shape == (4, FEATURES)
    assert np.allclose(x[:, :quality_model.CLASSES].sum(axis=1), 1)
    assert x[3, 3] > 0 and x[0, 3] == 0
    assert MOST_PASSAGES > 1000


def test_attention_finds_one_bad_passage():
    rng = np.random.default_rng(0)
    bags, y = [], []
    for i in range(1200):
        bag = rng.normal(0, 0.5, (rng.integers(1, 9), FEATURES)).astype(np.float32)
        y.append(i % 2)
        if i % 2:
            bag[rng.integers(len(bag)), 5] = 6
        bags.append(bag)
    w = fit(bags[:900], np.array(y[:900], float), np.ones(900))
    p = Model(0.5, w).scores(bags[900:])
    assert ((p > 0.5) == np.array(y[900:])).mean() > 0.85


def test_gradients():
    """One small step along the gradient of the loss matches finite differences through training: the loss falls."""
    rng = np.random.default_rng(1)
    bags = [rng.normal(0, 1, (3, FEATURES)).astype(np.float32) for _ in range(40)]
    y = np.array([float(b[:, 0].mean() > 0) for b in bags])

    def loss(w):
        p = np.clip(Model(0.5, w).scores(bags), 1e-9, 1 - 1e-9)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()
    assert loss(fit(bags, y, np.ones(40), epochs=40)) < 0.3 * loss(fit(bags, y, np.ones(40), epochs=1, rate=0))


def test_folds(spark):
    import zlib

    rows = spark.range(50).select("id", crc_mod("id", 4).alias("m")).collect()
    assert all(r.m == zlib.crc32(str(r.id).encode()) % 4 for r in rows)


def test_language_against_plain_loops(spark, tables):
    """The same fitted model, applied text by text and n-gram by n-gram."""
    import math

    docs = tables["documents"]
    model = language_id.learn(docs, where=crc_mod("doc_id", 5) != 0)
    some = docs.filter("doc_id % 97 = 0").unionByName(
        spark.createDataFrame([(-1, "x y", "s", "en"), (-2, "¡Ärger! 12 %%  ok", "s", "de")], "doc_id long, text string, source string, lang string"),
        allowMissingColumns=True)
    got = {r.doc_id: r for r in language_id.predict(some, model).collect()}
    texts = {r.doc_id: r.text for r in some.collect()}
    for key, text in texts.items():
        squeezed = [0x20]
        for b in text.encode() + b" ":
            b = b | 0x20 if 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A else b if b >= 0x80 else 0x20
            if b != 0x20 or squeezed[-1] != 0x20:
                squeezed.append(b)
        counts = {}
        for width, salt in ((2, 1), (3, 2)):
            for i in range(len(squeezed) - width + 1):
                code = int.from_bytes(bytes(squeezed[i:i + width]), "big") + (salt << 24)
                at = (code * 2654435761 & 0xFFFFFFFF) >> 20
                counts[at] = counts.get(at, 0) + 1
        weights = {at: math.log1p(n) * float(model.idf[at]) for at, n in counts.items()}
        norm = math.sqrt(sum(v * v for v in weights.values()))
        cosines = [sum(v * float(row[at]) for at, v in weights.items()) / norm for row in model.rows]
        best = max(cosines)
        assert abs(got[key].score - min(1, max(0, best))) < 2e-5, key
        close = {model.langs[j] for j, c in enumerate(cosines) if best - c < 1e-5}
        assert got[key].lang_pred in close, key
        if all(abs(best - r) > 1e-4 for r in model.radius):
            assert got[key].rejected in {best < model.radius[j] for j, c in enumerate(cosines) if best - c < 1e-5}


def test_unlearnt_language_is_rejected(spark, tables):
    docs = tables["documents"].filter("lang is not null")
    langs = sorted(r.lang for r in docs.select("lang").distinct().collect())
    for out in langs:
        model = language_id.learn(docs, where=(crc_mod("doc_id", 5) != 0) & (docs.lang != out))
        got = language_id.predict(docs.filter("crc32(cast(doc_id as string)) % 5 = 0"), model).toPandas()
        strange = got.lang == out
        assert got[strange].rejected.mean() > 0.9
        assert got[~strange].rejected.mean() < 0.05


def test_quality_scores_against_plain_loops():
    import math

    rng = np.random.default_rng(5)
    bags = [rng.normal(0, 1, (int(rng.integers(1, 6)), FEATURES)).astype(np.float32) for _ in range(30)]
    w = fit(bags, np.array([i % 2 for i in range(30)], float), np.ones(30), epochs=3)
    sig = lambda x: 1 / (1 + math.exp(-x))
    for bag, score in zip(bags, Model(0.5, w).scores(bags)):
        hidden, energy = [], []
        for row in bag:
            x = [(float(v) - m) / s for v, m, s in zip(row, w["mean"], w["scale"])]
            h = [math.tanh(sum(x[i] * w["W"][i][j] for i in range(FEATURES)) + w["b"][j]) for j in range(len(w["b"]))]
            t = [math.tanh(sum(h[i] * w["V"][i][j] for i in range(len(h)))) for j in range(len(w["a"]))]
            g = [sig(sum(h[i] * w["U"][i][j] for i in range(len(h)))) for j in range(len(w["a"]))]
            hidden.append(h)
            energy.append(sum(t[j] * g[j] * w["a"][j] for j in range(len(t))))
        att = [math.exp(e) / sum(map(math.exp, energy)) for e in energy]
        z = [sum(a * h[j] for a, h in zip(att, hidden)) for j in range(len(w["c"]))]
        assert abs(score - sig(sum(v * c for v, c in zip(z, w["c"])) + w["d"][0])) < 1e-6
