"""Hard-negative mining by threshold joins in blocks.

For each anchor: its `n_pos` best rows of the same label, and for each of these the first `n_neg` rows of other labels whose
score lies in a window below the positive's. Scores are inner products of integer vectors floor(scale * x).

Rows are dealt by hash into blocks of about `block_rows`, anchors into blocks of about `block_anchors`; every anchor block
meets every row block in a task of its own. Inside, an inverted index holds the dimensions in groups, those with most
energy first. A row stands in a group's list only while the norm of its remaining dimensions, times the largest anchor
norm, reaches the lowest threshold in use; what is left out is covered by that suffix norm. Partial scores are
accumulated list by list. A pair is dropped once its partial score plus the product of both suffix norms is below
its anchor's threshold, and few survivors are finished one by one. Thresholds start high and are lowered for anchors whose
windows did not fill, down to the end of the window (positives: until every row counts), so the result is exact. The
best few per block are ranked per key; no block sends more than `n_pos` or `n_neg` rows for a key.

Defined results: rows with a null label, a null vector, or a null or non-finite component take no part; an empty vector and
components that a shorter vector lacks count as zero. Equal scores are ordered by smaller id, null ids last; repeated rows
are separate rows, each of them an anchor if its id is. A row is never its own positive. A positive below zero has an
empty window. Columns besides id, vector and label are ignored. Scores must fit in a long; those from 2^50 on are computed in
integers without pruning.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollscope.llm.centroids import SCALE, finite, integers
from rollscope.llm.common import stored

N_POS, N_NEG, LOW, HIGH = 5, 3, 50, 95
BLOCK_ROWS, BLOCK_ANCHORS = 8192, 16384
# Dimensions in one list of the index; anchors that accumulate together; pairs that are finished together.
GROUP, SLICE, PAIRS = 8, 256, 1 << 17
# A slice is finished pair by pair once so few of its pairs are alive.
FEW = 0.1
# Thresholds of the positives, as shares of the largest possible score, and of the windows, as shares of the way down.
SHARES, DEPTHS = (0.5, 0.35, 0.25, 0.1, None), (0.1, 0.4, 1.0)
EXACT = float(1 << 50)


class Index:
    """Rows of one block by dimension groups, with their suffix norms."""

    def __init__(self, rows: np.ndarray) -> None:
        self.order = np.argsort(-(rows.astype(np.float64) ** 2).sum(0), kind="stable")
        self.x = np.ascontiguousarray(rows[:, self.order])
        self.cuts = list(range(0, rows.shape[1], GROUP)) + [rows.shape[1]]
        self.norms = suffix_norms(self.x, self.cuts)

    def above(self, anchors: np.ndarray, least: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, anchor, score) of all pairs whose score is at least the anchor's threshold, a slice of anchors at a time."""
        a = anchors[:, self.order]
        a_norms = suffix_norms(a, self.cuts)
        # Anchors with thresholds alike share a slice, so that its lowest threshold is not far from the others.
        by = np.argsort(least, kind="stable")
        for at in range(0, len(a), SLICE):
            pick = by[at:at + SLICE]
            for r, c, s in self._slice(a[pick], a_norms[:, pick], least[pick]):
                yield r, pick[c], s

    def _slice(self, a: np.ndarray, a_norms: np.ndarray, least: np.ndarray):
        if self.x.dtype != np.float64 or a.dtype != np.float64:
            score = self.x.astype(np.int64) @ a.astype(np.int64).T
            r, c = np.nonzero(score >= least)
            yield r, c, score[r, c]
            return
        live = np.arange(len(self.x))
        part = np.zeros((len(live), len(a)))
        lowest, largest = least.min(), a_norms[0].max()
        for g, (lo, hi) in enumerate(zip(self.cuts[:-1], self.cuts[1:])):
            bound = self.norms[g][live]
            indexed = bound * largest >= lowest - 0.5
            if not indexed.all():
                out = ~indexed
                yield from self._finish(live[out], part[out], a, least, bound[out], a_norms[g], lo)
                live, part = live[indexed], part[indexed]
            if not len(live):
                return
            part += self.x[live, lo:hi] @ a[:, lo:hi].T
            if hi < self.cuts[-1]:
                alive = part + self.norms[g + 1][live][:, None] * a_norms[g + 1] >= least - 0.5
                if alive.mean() <= FEW:
                    yield from self._finish(live, part, a, least, self.norms[g + 1][live], a_norms[g + 1], hi)
                    return
        yield from self._finish(live, part, a, least, np.zeros(len(live)), np.zeros(len(a)), self.cuts[-1])

    def _finish(self, live, part, a, least, bound, a_bound, lo):
        """Complete scores of the pairs that can still reach their threshold."""
        r, c = np.nonzero(part + bound[:, None] * a_bound >= least - 0.5)
        for at in range(0, len(r), PAIRS):
            rr, cc = r[at:at + PAIRS], c[at:at + PAIRS]
            score = part[rr, cc]
            if lo < self.cuts[-1]:
                score = score + np.einsum("ij,ij->i", self.x[live[rr], lo:], a[cc, lo:])
            hit = score >= least[cc]
            yield live[rr[hit]], cc[hit], score[hit]


def suffix_norms(x: np.ndarray, cuts: list[int]) -> np.ndarray:
    """Norm of each row from each cut on."""
    squares = x.astype(np.float64) ** 2
    parts = [squares[:, lo:hi].sum(1) for lo, hi in zip(cuts[:-1], cuts[1:])] + [np.zeros(len(x))]
    return np.sqrt(np.cumsum(parts[::-1], axis=0)[::-1])


def matrix(col: pa.ChunkedArray, dims: int) -> np.ndarray:
    """Vectors as rows, short ones filled with zeros; floats where every product is exact in them."""
    out = np.zeros((len(col), dims), np.int64)
    at = 0
    for chunk in col.chunks:
        size = np.diff(chunk.offsets.to_numpy())
        flat = chunk.flatten().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(chunk)), size)
        out[at + row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
        at += len(chunk)
    return out.astype(np.float64) if float(np.abs(out).max(initial=0)) ** 2 * max(1, dims) < EXACT else out


def first_of(key: np.ndarray, score: np.ndarray, ids: np.ndarray, none: np.ndarray, uid: np.ndarray, n: int) -> np.ndarray:
    """Positions of the first n of each key: higher scores, smaller ids, null ids last."""
    order = np.lexsort((uid, ids, none, -score, key))
    k = key[order]
    new = np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.zeros(0, bool)
    rank = np.arange(len(k)) - np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))
    return order[rank < n]


class Side:
    """Columns of the rows or anchors of a block."""

    def __init__(self, table: pa.Table, dims: int) -> None:
        self.uid = table["uid"].to_numpy()
        self.none = table["id"].is_null().to_numpy()
        self.ids = table["id"].fill_null(0).to_numpy()
        self.label = table["label"].to_numpy()
        self.x = matrix(table["v"], dims)


def gathered(index: Index, x: np.ndarray, least: np.ndarray):
    found = list(index.above(x, least))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(z) for z in zip(*found))


def best_same(rows: Side, anchors: Side, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score): the best n rows of this block with the anchor's label."""
    out = []
    for label in np.unique(anchors.label):
        mine, theirs = np.nonzero(rows.label == label)[0], np.nonzero(anchors.label == label)[0]
        if not len(mine):
            continue
        index = Index(rows.x[mine])
        top = np.sqrt((anchors.x[theirs].astype(np.float64) ** 2).sum(1)) * index.norms[0].max()
        left = np.arange(len(theirs))
        for share in SHARES:
            least = np.full(len(left), -np.inf) if share is None else np.ceil(share * top[left])
            r, c, s = gathered(index, anchors.x[theirs[left]], least)
            other = rows.uid[mine[r]] != anchors.uid[theirs[left[c]]]
            r, c, s = r[other], c[other], s[other]
            full = np.bincount(c, minlength=len(left)) >= n
            if share is None:
                full[:] = True
            take = full[c]
            r, c, s = mine[r[take]], theirs[left[c[take]]], s[take]
            best = first_of(c, s, rows.ids[r], rows.none[r], rows.uid[r], n)
            out.append((c[best], r[best], s[best]))
            left = left[~full]
            if not len(left):
                break
    return tuple(np.concatenate(z) for z in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def best_windows(rows: Side, anchors: Side, owner: np.ndarray, low: np.ndarray, high: np.ndarray, n: int):
    """(window, row, score): the best n rows of other labels in each window of scores; `owner` is a window's anchor."""
    out = []
    index = Index(rows.x)
    left = np.arange(len(owner))
    for depth in DEPTHS:
        if not len(left) or not len(rows.x):
            break
        floor = np.maximum(low[left], np.ceil(high[left] - depth * (high[left] - low[left])))
        if depth == DEPTHS[-1]:
            floor = low[left]
        mine, back = np.unique(owner[left], return_inverse=True)
        least = np.full(len(mine), np.inf)
        np.minimum.at(least, back, floor)
        start = np.argsort(back, kind="stable")
        first = np.searchsorted(back[start], np.arange(len(mine) + 1))
        keys, hits, scores = [], [], []
        for r, c, s in index.above(anchors.x[mine], least):
            ok = rows.label[r] != anchors.label[mine[c]]
            r, c, s = r[ok], c[ok], s[ok]
            # One step per window an anchor may have: at most n_pos.
            for j in range(int((first[1:] - first[:-1]).max(initial=0))):
                has = first[c] + j < first[c + 1]
                w = start[(first[c] + j)[has]]
                inside = (s[has] >= floor[w]) & (s[has] <= high[left[w]])
                keys.append(w[inside])
                hits.append(r[has][inside])
                scores.append(s[has][inside])
        w, r, s = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (keys, hits, scores))
        full = np.bincount(w, minlength=len(left)) >= n
        if depth == DEPTHS[-1]:
            full[:] = True
        take = full[w]
        w, r, s = w[take], r[take], s[take]
        best = first_of(w, s, rows.ids[r], rows.none[r], rows.uid[r], n)
        out.append((left[w[best]], r[best], s[best]))
        left = left[~full]
    return tuple(np.concatenate(z) for z in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def meet(rows: DataFrame, anchors: DataFrame, row_blocks: int, anchor_blocks: int, fn, schema: str) -> DataFrame:
    """Call fn(rows, anchors) for every pair of a row block and an anchor block."""
    def block(name: str, n: int) -> Column:
        return F.pmod(F.xxhash64("uid"), F.lit(n)).cast("int").alias(name)

    def every(name: str, n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)

    left = rows.select(block("rb", row_blocks), every("ab", anchor_blocks), "*")
    # Both sides may come from one table: new names for the right columns keep them apart.
    right = anchors.select(every("rb", row_blocks), block("ab", anchor_blocks), *[F.col(c).alias(c) for c in anchors.columns])
    return left.groupBy("rb", "ab").cogroup(right.groupBy("rb", "ab")).applyInArrow(fn, schema)


def ranked(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The first n rows per key with their rank; Spark cuts every task to n rows a key before the shuffle."""
    order = [F.desc("score"), F.asc_nulls_last("id"), F.asc("uid")]
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= n)


def hard_negatives(vectors: DataFrame, anchor: Column, n_pos: int = N_POS, n_neg: int = N_NEG, low: int = LOW, high: int = HIGH,
                   scale: int = SCALE, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
                   block_rows: int = BLOCK_ROWS, block_anchors: int = BLOCK_ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    `anchor` says which rows are anchors. Negatives score from `low` to `high` percent of the positive.
    """
    v = F.col(f"`{vector}`")
    src = vectors.filter(F.col(f"`{label}`").isNotNull() & finite(v)).select(
        F.monotonically_increasing_id().alias("uid"), F.col(f"`{vec_id}`").cast("bigint").alias("id"),
        F.col(f"`{label}`").cast("bigint").alias("label"), integers(v, scale).alias("v"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    rows = stored(src, "vectors")
    n, n_anchors, dims = rows.agg(F.count(F.lit(1)), F.count_if("anchor"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    row_blocks, anchor_blocks = -(-max(n, 1) // block_rows), -(-max(n_anchors, 1) // block_anchors)
    chosen = rows.filter("anchor").drop("anchor")
    rows = rows.drop("anchor")

    def positives(a: pa.Table, b: pa.Table) -> pa.Table:
        x, y = Side(a, dims), Side(b, dims)
        c, r, s = best_same(x, y, n_pos)
        return pa.table({"anchor": y.uid[c], "uid": x.uid[r], "id": pa.array(x.ids[r], mask=x.none[r]), "score": s.astype(np.int64)})

    found = meet(rows, chosen, row_blocks, anchor_blocks, positives, "anchor long, uid long, id long, score long")
    best = stored(ranked(found, ["anchor"], n_pos).select("anchor", "uid", "id", "score"), "positives")
    # At most n_pos windows an anchor.
    windows = best.filter("score >= 0").groupBy("anchor").agg(F.collect_list(F.struct("uid", "score")).alias("w"))
    asked = chosen.join(windows.withColumnRenamed("anchor", "uid"), "uid").select(
        "uid", "id", "label", "v", F.transform("w", lambda w: w["uid"]).alias("pos"), F.transform("w", lambda w: w["score"]).alias("pos_score"))

    def negatives(a: pa.Table, b: pa.Table) -> pa.Table:
        x, y = Side(a, dims), Side(b, dims)
        pos = [p for p in b["pos"].to_pylist()]
        owner = np.repeat(np.arange(len(pos)), [len(p) for p in pos]).astype(np.int64)
        uid = np.array([u for p in pos for u in p], np.int64)
        score = np.array([u for p in b["pos_score"].to_pylist() for u in p], np.int64)
        w, r, s = best_windows(x, y, owner, -(-score * low // 100), score * high // 100, n_neg)
        return pa.table({"anchor": y.uid[owner[w]], "positive": uid[w], "positive_score": score[w], "uid": x.uid[r],
                         "id": pa.array(x.ids[r], mask=x.none[r]), "score": s.astype(np.int64)})

    found = meet(rows, asked, row_blocks, anchor_blocks, negatives,
                 "anchor long, positive long, positive_score long, uid long, id long, score long")
    last = ranked(found, ["anchor", "positive"], n_neg)
    names = chosen.select(F.col("uid").alias("anchor"), F.col("id").alias("anchor_id"))
    partners = best.select("anchor", F.col("uid").alias("positive"), F.col("id").alias("positive_id"))
    return last.join(partners, ["anchor", "positive"]).join(names, "anchor").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))
