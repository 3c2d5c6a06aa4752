"""Quality classifier: attention-based multiple-instance learning.

A text is cut into passages of `PASSAGE_WORDS` words. Every passage is encoded (shares of character classes and of
hashed character pairs, word shape and repetition, through one trained layer), gated attention weighs the passages, and
the weighted representation is scored. Only the label of the document is known in training.

The model is fitted on at most `2 * SAMPLE_PER_LABEL` labelled documents of at most `MOST_PASSAGES` passages each (a
documented bound on training alone), weighted back to the shares of the labels. Scoring reads every whole text in one
pass, without a shuffle.

Defined results: null and empty texts have one empty passage and get a score like any other; without labels of both
kinds every score is the share of label 1 (0.5 without labels); documents with several labels are learnt from once per
distinct label; very long texts are scored over all their passages; equal rows get equal scores; input columns named like the
results are not read; empty tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollscope.llm.common import WordIds, add_columns, crc_mod

PASSAGE_WORDS = 64
PAIRS = 64
SAMPLE_PER_LABEL = 1500
MOST_PASSAGES = 2000
# Character classes: space, line end, a-z, A-Z, digit, stop marks, other ASCII marks, lead bytes, following bytes.
_CLASS = np.full(256, 6, np.int64)
for _value, _bytes in ((0, b" \t\x0b\x0c"), (1, b"\r\n"), (2, bytes(range(0x61, 0x7B))), (3, bytes(range(0x41, 0x5B))),
                       (4, b"0123456789"), (5, b".,;:!?'\"()-"), (7, bytes(range(0xC0, 0x100))), (8, bytes(range(0x80, 0xC0)))):
    _CLASS[list(_bytes)] = _value
CLASSES = 9
FEATURES = CLASSES + PAIRS + 4


class Passages:
    """Feature rows of the passages of texts."""

    def __init__(self) -> None:
        self.ids = WordIds()

    def rows(self, text: bytes) -> np.ndarray:
        words = text.split()
        n = max(1, -(-len(words) // PASSAGE_WORDS))
        x = np.zeros((n, FEATURES), np.float32)
        if not words:
            return x
        if len(self.ids) > 400_000:
            self.ids = WordIds()
        ids = np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))
        self.ids.new.clear()
        raw = np.frombuffer(text, np.uint8)
        kind = _CLASS[raw]
        blank = kind <= 1
        starts = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
        # A byte belongs to the passage of the last word that began before it.
        passage = np.zeros(len(raw), np.int64)
        passage[starts[PASSAGE_WORDS::PASSAGE_WORDS]] = 1
        passage = np.cumsum(passage)
        size = np.bincount(passage, minlength=n)[:, None]
        x[:, :CLASSES] = np.bincount(passage * CLASSES + kind, minlength=n * CLASSES).reshape(n, -1) / size
        pair = (raw[:-1].astype(np.uint32) << np.uint32(8) | raw[1:]) * np.uint32(2654435761) >> np.uint32(26)
        pairs = np.bincount(passage[:-1] * PAIRS + pair, minlength=n * PAIRS).reshape(n, -1)
        x[:, CLASSES:CLASSES + PAIRS] = np.sqrt(pairs / size)
        own = np.arange(len(ids)) // PASSAGE_WORDS
        count = np.bincount(own, minlength=n)
        distinct = np.bincount(np.unique(own << 32 | ids) >> 32, minlength=n)
        again = np.bincount(own[1:][ids[1:] == ids[:-1]], minlength=n)
        x[:, -4] = distinct / count
        x[:, -3] = again / count
        x[:, -2] = count / PASSAGE_WORDS
        x[:, -1] = np.log1p(size[:, 0] / count) / 4
        return x


@dataclass
class Model:
    """Weights; scores are in [0, 1]."""
    prior: float
    weights: dict[str, np.ndarray] | None = None

    def scores(self, bags: list[np.ndarray]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(bags), self.prior)
        return _forward(self.weights, np.concatenate(bags), np.cumsum([0, *map(len, bags)]))["p"]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _forward(w: dict[str, np.ndarray], x: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """Scores of bags x[at[i]:at[i + 1]] with everything that the gradients need."""
    first = at[:-1]
    x = (x - w["mean"]) / w["scale"]
    h = np.tanh(x @ w["W"] + w["b"])
    t, g = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
    e = (t * g) @ w["a"]
    n = np.diff(at)
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), n))
    a = e / np.repeat(np.add.reduceat(e, first), n)
    z = np.add.reduceat(a[:, None] * h, first, axis=0)
    return {"x": x, "h": h, "t": t, "g": g, "att": a, "z": z, "p": _sigmoid(z @ w["c"] + w["d"]), "n": n}


def fit(bags: list[np.ndarray], labels: np.ndarray, weight: np.ndarray, hidden: int = 24, gate: int = 12, epochs: int = 60,
        rate: float = 0.02, seed: int = 7) -> dict[str, np.ndarray]:
    """Adam on mini-batches of bags; a fixed seed, so reruns agree."""
    rng = np.random.default_rng(seed)
    every = np.concatenate(bags)
    w = {"mean": every.mean(axis=0), "scale": every.std(axis=0) + 1e-3,
         "W": rng.normal(0, 1 / np.sqrt(FEATURES), (FEATURES, hidden)), "b": np.zeros(hidden),
         "V": rng.normal(0, 0.3, (hidden, gate)), "U": rng.normal(0, 0.3, (hidden, gate)), "a": rng.normal(0, 0.3, gate),
         "c": rng.normal(0, 0.3, hidden), "d": np.zeros(1)}
    names = [k for k in w if k not in ("mean", "scale")]
    m = {k: np.zeros_like(w[k]) for k in names}
    v = {k: np.zeros_like(w[k]) for k in names}
    step = 0
    for epoch in range(epochs):
        for part in np.array_split(rng.permutation(len(bags)), max(1, len(bags) // 128)):
            at = np.cumsum([0, *[len(bags[i]) for i in part]])
            f = _forward(w, np.concatenate([bags[i] for i in part]), at)
            first, n = at[:-1], f["n"]
            dl = (f["p"] - labels[part]) * weight[part] / weight[part].sum()
            dz = dl[:, None] * w["c"]
            dzr = np.repeat(dz, n, axis=0)
            da = (dzr * f["h"]).sum(axis=1)
            de = f["att"] * (da - np.repeat(np.add.reduceat(f["att"] * da, first), n))
            dt = de[:, None] * w["a"] * f["g"] * (1 - f["t"] ** 2)
            dg = de[:, None] * w["a"] * f["t"] * f["g"] * (1 - f["g"])
            dh = f["att"][:, None] * dzr + dt @ w["V"].T + dg @ w["U"].T
            du = dh * (1 - f["h"] ** 2)
            grad = {"W": f["x"].T @ du, "b": du.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ dg,
                    "a": (f["t"] * f["g"]).T @ de, "c": f["z"].T @ dl, "d": dl.sum(keepdims=True)}
            step += 1
            for k in names:
                d = grad[k] + 1e-4 * w[k]
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.999 * v[k] + 0.001 * d * d
                w[k] = w[k] - rate * (1 - epoch / epochs) * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
    return w


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
          where: Column | None = None, sample_per_label: int = SAMPLE_PER_LABEL) -> Model:
    """Fit on a bounded sample of the labels that `where` allows."""
    own = labels.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("y")).filter(
        F.col("y").isin(0, 1) & F.col("doc_id").isNotNull())
    own = own if where is None else own.filter(where)
    share = own.agg(F.avg("y")).first()[0]
    if share is None or share in (0.0, 1.0):
        return Model(0.5 if share is None else float(share))
    parts = [own.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_per_label) for y in (0, 1)]
    # At most 2 * sample_per_label ids are broadcast.
    sample = F.broadcast(parts[0].union(parts[1]).distinct())
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))

    def make():
        passages = Passages()

        def run(texts: list[bytes]) -> list[list]:
            bags = [passages.rows(x) for x in texts]
            return [[x.tobytes() if len(x) <= MOST_PASSAGES else None for x in bags]]
        return run

    got = add_columns(rows.join(sample, "doc_id").select("doc_id", "y", "text"), make,
                      T.StructType([T.StructField("bag", T.BinaryType())])).filter("bag is not null").collect()
    got = sorted((r["doc_id"], r["y"], bytes(r["bag"])) for r in got)
    y = np.array([r[1] for r in got], float)
    if len(set(y.tolist())) < 2:
        return Model(float(share))
    bags = [np.frombuffer(r[2], np.float32).reshape(-1, FEATURES) for r in got]
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    return Model(float(share), fit(bags, y, weight))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Document rows without their text, with their score."""
    def make():
        passages = Passages()

        def run(texts: list[bytes]) -> list[np.ndarray]:
            return [np.round(model.scores([passages.rows(x) for x in texts]), 6)]
        return run

    return add_columns(docs, make, T.StructType([T.StructField("score", T.DoubleType())]), text)


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.7,
             folds: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, score, predicted; rows whose id's crc32 modulo `folds` is `held` are not learnt from."""
    model = learn(docs, labels, doc_id, text, where=crc_mod("doc_id", folds) != held)
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), (crc_mod(f"`{doc_id}`", folds) == held).alias("held_out"),
                       F.col(f"`{text}`").alias("text"))
    return score(rows, model).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
