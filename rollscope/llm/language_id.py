"""Language identification by nearest centroids of TF-IDF n-gram vectors.

A text becomes counts of its byte trigrams and bigrams (lower-case ASCII, everything else between letters as one
blank) in a fixed number of hashed dimensions, damped, weighted by inverse document frequency and normalised. Each
language has several centroids from spherical k-means; a text takes the language of the centroid with the largest
cosine, and is rejected if it is farther from it than nearly all learnt texts of that centroid (all but the share `accept`).

The model is fitted on at most `sample_rows` labelled rows (a documented bound; an equal share per language, chosen by
hash). Prediction reads every whole text in one pass, without a shuffle.

Defined results: null texts and texts without a letter are `und` with score 0, as is everything if nothing can be
learnt; null languages are not learnt from; of centroids with equal cosines the first counts (languages by code point);
very long texts are counted whole; equal rows get equal results; input columns named like the results (score, held_out,
rejected) are not read; empty tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollscope.llm.common import add_columns, crc_mod

DIMS = 4096
SAMPLE_ROWS = 4000
CENTROIDS = 4
# Letters of other scripts are multi-byte: all bytes from 0x80 count as letters here.
_TABLE = np.full(256, 0x20, np.uint8)
_TABLE[0x80:] = np.arange(0x80, 0x100)
_TABLE[0x61:0x7B] = np.arange(0x61, 0x7B)
_TABLE[0x41:0x5B] = np.arange(0x61, 0x7B)


def ngram_counts(text: bytes) -> np.ndarray:
    """Counts of hashed byte bigrams and trigrams."""
    b = _TABLE[np.frombuffer(b" " + text + b" ", np.uint8)].astype(np.uint32)
    b = b[np.concatenate([[True], (b[1:] != 0x20) | (b[:-1] != 0x20)])]
    two = (b[:-1] << np.uint32(8)) | b[1:]
    three = (two[:-1] << np.uint32(8)) | b[2:]
    out = np.zeros(DIMS, np.int64)
    for codes, salt in ((two, 1), (three, 2)):
        hashed = ((codes + np.uint32(salt << 24)) * np.uint32(2654435761)) >> np.uint32(20)
        out += np.bincount(hashed, minlength=DIMS)
    return out


def has_letter(text: bytes) -> bool:
    return any(map(str.isalpha, text.decode("utf-8", "replace")))


@dataclass(frozen=True)
class Centroids:
    idf: np.ndarray
    langs: tuple[str, ...]  # of each centroid
    rows: np.ndarray  # one centroid per row, of length 1
    radius: np.ndarray  # least cosine that is not rejected, per centroid

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        return _unit(np.log1p(counts).astype(np.float32) * self.idf)


def _unit(rows: np.ndarray) -> np.ndarray:
    norm = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return rows / np.maximum(norm, np.float32(1e-12))


def _kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; starts with the mean, then always with the row least like the centroids so far."""
    seeds = [_unit(x.mean(axis=0, keepdims=True))[0]]
    while len(seeds) < min(k, len(x)):
        seeds.append(x[int((x @ np.array(seeds).T).max(axis=1).argmin())])
    c = np.array(seeds)
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        c = np.array([_unit(x[near == j].mean(axis=0, keepdims=True))[0] if (near == j).any() else c[j] for j in range(len(c))])
    return c


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", where: Column | None = None,
          sample_rows: int = SAMPLE_ROWS, centroids: int = CENTROIDS, accept: float = 0.005) -> Centroids | None:
    """Fit on a bounded sample of the labelled rows that `where` allows; None if there are none."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"),
                       F.col(f"`{lang}`").alias("lang"), (F.lit(True) if where is None else where).alias("may"))
    rows = rows.filter(F.col("may") & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    # A language needs at least one row of the sample, so at most `sample_rows` languages, the largest, are learnt.
    sizes = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(sample_rows).collect()
    if not sizes:
        return None
    each = max(1, min(1000, sample_rows // len(sizes)))
    # Rows of a language in hashed order: those behind four times the wanted share can't be among the first, so the
    # ranking below sees a bounded number of rows of any language.
    span = float(1 << 64)
    share = F.element_at(F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]), F.lit(min(1.0, (4 * each + 100) / r["count"])))]), F.col("lang"))
    early = rows.select("doc_id", "lang", F.xxhash64("doc_id").alias("h")).filter(
        F.col("h").cast("double") <= share * F.lit(span) - F.lit(span / 2))
    order = Window.partitionBy("lang").orderBy("h", "doc_id")
    ids = early.withColumn("rk", F.row_number().over(order)).filter(F.col("rk") <= each).select("doc_id")
    # At most `sample_rows` ids are broadcast, and as many rows of fixed length reach the driver.
    chosen = rows.join(F.broadcast(ids.distinct()), "doc_id").select("lang", "text")
    field = T.StructType([T.StructField("counts", T.BinaryType())])
    got = add_columns(chosen, lambda: lambda texts: [[ngram_counts(x).astype(np.float32).tobytes() for x in texts]], field).collect()
    got = sorted((r["lang"], bytes(r["counts"])) for r in got)
    counts = np.array([np.frombuffer(c, np.float32) for _, c in got])
    labels = np.array([name for name, _ in got])
    idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + np.float32(1)
    x = _unit(np.log1p(counts) * idf)
    names, found, radius = [], [], []
    for name in sorted(set(labels)):
        own = x[labels == name]
        c = _kmeans(own, centroids)
        names += [str(name)] * len(c)
        found.append(c)
        cosines = own @ c.T
        near = cosines.argmax(axis=1)
        # A centroid that no learnt text is nearest to takes the distance of the language as a whole.
        radius += [float(np.quantile(cosines[near == j, j] if (near == j).any() else cosines.max(axis=1), accept)) for j in range(len(c))]
    return Centroids(idf, tuple(names), np.concatenate(found).astype(np.float32), np.array(radius))


FIELDS = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
                       T.StructField("rejected", T.BooleanType())])


def predict(docs: DataFrame, model: Centroids | None, text: str = "text") -> DataFrame:
    """Document rows without their text, with lang_pred, score (cosine, 0 to 1) and rejected."""
    def make():
        def run(texts: list[bytes]) -> list[list]:
            langs, scores, rejected = [], [], []
            for at in range(0, len(texts), 256):
                part = texts[at:at + 256]
                known = [model is not None and has_letter(x) for x in part]
                if model is None:
                    best, near = np.zeros(len(part), int), np.zeros(len(part))
                else:
                    cosines = model.vectors(np.array([ngram_counts(x) for x in part])) @ model.rows.T
                    best = cosines.argmax(axis=1)
                    near = np.clip(cosines[np.arange(len(part)), best], 0, 1)
                for k, b, c in zip(known, best, near):
                    langs.append(model.langs[b] if k else "und")
                    scores.append(round(float(c), 6) if k else 0.0)
                    rejected.append(not k or float(c) < model.radius[b])
            return [langs, scores, rejected]
        return run

    return add_columns(docs, make, FIELDS, text)


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected; rows whose id's crc32 modulo `folds` is `held` are not learnt from."""
    model = learn(docs, doc_id, text, lang, crc_mod(f"`{doc_id}`", folds) != held)
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), (crc_mod(f"`{doc_id}`", folds) == held).alias("held_out"),
                       F.col(f"`{text}`").alias("text"))
    return predict(rows, model)
