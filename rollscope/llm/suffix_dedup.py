"""Exact-substring dedup with longest-previous-factor arrays.

Bytes covered by a string of `length` bytes that also starts elsewhere are repeated. The suffixes of a corpus are dealt
to tasks by content: every window of `length` bytes is owned by its leftmost least `ANCHOR`-gram (by hash), so equal
windows meet wherever they stand, and consecutive windows with one anchor form one segment.

1. Every document yields one small row per segment: anchor hash, segment hash, place. Anchors that occur once are done;
   segments that occur twice as a whole are repeated throughout. Both are partial aggregates.
2. Different segments with one anchor (where copies begin, end or differ) are fetched once each and compared by suffix
   arrays: prefix doubling orders the owned suffixes up to `length` bytes, previous and next smaller positions in suffix
   order give the longest previous factor of each, and larger ones the longest next factor.
3. Every document unites its repeated starts.

An anchor with more than `crowded` different segments (the borders of a passage that very many documents share) is no
task's group: the windows of its segments are counted one by one by their hash, partial counts first.

Defined results: null text is empty; texts below `length` bytes keep everything; rows that are equal in id and text
are copies of each other and treated alike (none of them is the later one); texts of any length are cut into segments
and compared whole; whole segments are taken for equal by a 64-bit hash of their bytes; other columns, of any name,
are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollscope.llm.common import stored, text_values

LENGTH = 400
ANCHOR = 200
CROWDED = 4096
CHUNK_BYTES = 3 << 20

_rng = np.random.default_rng(20)
_VALUES = _rng.integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_U = np.uint64


class Powers:
    """Powers of the base and of its inverse modulo 2^64, grown on demand."""

    def __init__(self) -> None:
        self.n = 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 2 * self.n, 1 << 16)
            step = np.full(self.n, _BASE, _U)
            back = np.full(self.n, _INVERSE, _U)
            step[0] = back[0] = 1
            self.up, self.down = np.multiply.accumulate(step), np.multiply.accumulate(back)
        return self.up, self.down


def gram_hashes(raw: np.ndarray, size: int, powers: Powers) -> np.ndarray:
    """64-bit hash of every `size`-gram."""
    up, down = powers.upto(len(raw) + 1)
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(_VALUES[raw] * up[:len(raw)], dtype=_U)])
    h = (sums[size:] - sums[:-size]) * down[:len(raw) - size + 1]
    h ^= h >> _U(29)
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(32)
    return h


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` consecutive values."""
    n = len(x)
    blocks = np.full(-(-n // width) * width, np.iinfo(x.dtype).max, x.dtype)
    blocks[:n] = x
    blocks = blocks.reshape(-1, width)
    head = np.minimum.accumulate(blocks, axis=1).ravel()
    tail = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[:n - width + 1], head[width - 1:n])


def segments(text: bytes, length: int, anchor: int, powers: Powers) -> tuple[np.ndarray, ...]:
    """Anchor hash, segment hash, first owned start, number of owned starts and anchor place of each segment of a text."""
    raw = np.frombuffer(text, np.uint8)
    h = gram_hashes(raw, anchor, powers)
    place = (h & _U(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=_U)
    owner = (sliding_least(place, length - anchor + 1) & _U(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    n = np.diff(np.append(first, len(owner)))
    whole = np.array([xxhash.xxh3_64_intdigest(text[a:a + k + length - 1]) for a, k in zip(first.tolist(), n.tolist())], _U)
    return h[owner[first]].view(np.int64), whole.view(np.int64), first, n, owner[first]


# ---- suffix order ----

def suffix_ranks(raw: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Ranks of the suffixes at `starts` by their first `length` bytes, and the ranks of all positions for each power of 2.

    Every start must have `length` bytes after it.
    """
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)[:len(raw)]
    key = np.ascontiguousarray(words).view(">u8").ravel().astype(_U)
    levels = []
    size = 8
    while True:
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
        levels.append((size, rank))
        if 2 * size > length:
            break
        other = np.concatenate([rank[size:], np.zeros(min(size, len(rank)), np.int64)])[:len(rank)]
        key = (rank << 32) | other
        size *= 2
    last = (rank[starts] << 32) | rank[np.minimum(starts + length - size, len(rank) - 1)]
    return np.unique(last, return_inverse=True)[1], levels


def common_prefix(a: np.ndarray, b: np.ndarray, levels: list[tuple[int, np.ndarray]], raw: np.ndarray, length: int) -> np.ndarray:
    """Longest common prefix of suffix pairs, `length` at most; a negative start matches nothing."""
    some = (a >= 0) & (b >= 0)
    x, y = a[some], b[some]
    n = np.zeros(len(x), np.int64)
    last = len(raw) - 1
    # The largest power may fit several times; smaller ones once each, down to single bytes.
    for size, rank in reversed(levels):
        for _ in range(-(-length // size) if size == levels[-1][0] else 1):
            fits = (n + size <= length) & (rank[np.minimum(x + n, last)] == rank[np.minimum(y + n, last)])
            n += size * fits
    for _ in range(8):
        n += (n < length) & (raw[np.minimum(x + n, last)] == raw[np.minimum(y + n, last)])
    out = np.zeros(len(a), np.int64)
    out[some] = n
    return out


def _previous_smaller(x: np.ndarray) -> np.ndarray:
    """Index of the nearest smaller value before each, -1 without one: all wait for their candidates' answers together."""
    at = np.arange(len(x)) - 1
    open_ = np.flatnonzero(at >= 0)
    open_ = open_[x[at[open_]] >= x[open_]]
    while len(open_):
        at[open_] = at[at[open_]]
        live = at[open_] >= 0
        open_ = open_[live]
        open_ = open_[x[at[open_]] >= x[open_]]
    return at


def longest_previous(order: np.ndarray, position: np.ndarray, starts: np.ndarray, levels, raw: np.ndarray, length: int) -> np.ndarray:
    """Longest previous factor of each start (in the order of `starts`), `length` at most.

    `order` sorts the starts by suffix, `position` says which come earlier in the corpus.
    """
    x, at = position[order], starts[order]
    before = _previous_smaller(x)
    after = len(x) - 1 - _previous_smaller(x[::-1])[::-1]
    after[after == len(x)] = -1
    best = np.maximum(*(common_prefix(at, np.where(k >= 0, at[k], -1), levels, raw, length) for k in (before, after)))
    out = np.empty(len(x), np.int64)
    out[order] = best
    return out


def repeated_starts(texts: list[bytes], length: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For segments in corpus order: flags of the owned starts with an earlier and with a later equal window."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts])
    base = np.cumsum(sizes) - sizes
    n = sizes - length + 1
    ends = np.cumsum(n)
    starts = np.repeat(base - (ends - n), n) + np.arange(int(ends[-1]))
    ranks, levels = suffix_ranks(raw, starts, length)
    order = np.argsort(ranks, kind="stable")
    position = np.arange(len(starts))
    earlier = longest_previous(order, position, starts, levels, raw, length) >= length
    later = longest_previous(order, -position, starts, levels, raw, length) >= length
    return np.split(earlier, ends[:-1]), np.split(later, ends[:-1])


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


# ---- tables ----

SEGMENT = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "row", "anchor", "seg")]
                       + [T.StructField(n, T.IntegerType()) for n in ("lo", "n")])
PART = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "row", "group")]
                    + [T.StructField("lo", T.IntegerType()), T.StructField("text", T.BinaryType())])
SPAN = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "row")]
                    + [T.StructField(n, T.IntegerType()) for n in ("lo", "hi")])


def _segment_rows(rows: DataFrame, length: int, anchor: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            ids, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            held, size = [], 0
            for doc, key, text in zip(ids, keys, text_values(batch.column(2))):
                if len(text) < length:
                    continue
                anchors, whole, first, n, _ = segments(text, length, anchor, powers)
                held.append(pa.RecordBatch.from_arrays(
                    [pa.array([doc] * len(n), pa.int64()), pa.array(np.full(len(n), key)), pa.array(anchors), pa.array(whole),
                     pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32))], names=SEGMENT.names))
                size += len(n)
                if size > 50_000:
                    yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                    held, size = [], 0
            if held:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return rows.select("doc_id", "row", "text").mapInArrow(run, SEGMENT)


def _parts(docs: DataFrame, length: int) -> DataFrame:
    """Text of the wanted segments of each document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for doc, key, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                              text_values(batch.column(2)), batch.column(3).to_pylist()):
                for w in wanted:
                    out.append((doc, key, w["anchor"], w["lo"], text[w["lo"]:w["lo"] + w["n"] + length - 1]))
                    size += w["n"] + length
                    if size > 4 << 20:
                        yield _batch(out, PART)
                        out, size = [], 0
            if out:
                yield _batch(out, PART)

    return docs.mapInArrow(run, PART)


WINDOW = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "row", "anchor", "h")] + [T.StructField("lo", T.IntegerType())])


def _windows(docs: DataFrame, length: int) -> DataFrame:
    """Hash of every owned window of the wanted segments."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, key, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                              text_values(batch.column(2)), batch.column(3).to_pylist()):
                for w in wanted:
                    for lo in range(w["lo"], w["lo"] + w["n"]):
                        h = xxhash.xxh3_64_intdigest(text[lo:lo + length])
                        out.append((doc, key, w["anchor"], h - (h >> 63 << 64), lo))
                if len(out) > 100_000:
                    yield _batch(out, WINDOW)
                    out = []
            if out:
                yield _batch(out, WINDOW)

    return docs.mapInArrow(run, WINDOW)


def _batch(rows: list[tuple], kind: T.StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(kind)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _compare(parts: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """Runs of repeated starts of the segments of each group; groups come whole and sorted."""
    def spans(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        # A group of one has nothing to be compared with.
        rows = [r for i, r in enumerate(rows) if (i and rows[i - 1][2] == r[2]) or (i + 1 < len(rows) and rows[i + 1][2] == r[2])]
        if not rows:
            return
        earlier, later = repeated_starts([r[4] for r in rows], length)
        out = [(doc, key, lo + a, lo + b) for (doc, key, _, lo, _), x, y in zip(rows, earlier, later)
               for a, b in _runs(x if keep_first else x | y)]
        if out:
            yield _batch(out, SPAN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(4)]
            for row in zip(*cols, text_values(batch.column(4))):
                if held and row[:4] == held[-1][:4]:
                    continue  # the same segment of an equal row
                if size >= CHUNK_BYTES and row[2] != held[-1][2]:
                    yield from spans(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        yield from spans(held)

    return parts.mapInArrow(run, SPAN)


RESULT = T.StructType([T.StructField("doc_id", T.LongType())]
                      + [T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")]
                      + [T.StructField("kept_sha256", T.StringType()), T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
                         T.StructField("kept", T.BinaryType())])


def _cut(docs: DataFrame, length: int, with_text: bool) -> DataFrame:
    """Unite the repeated starts of each document and cut their bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for doc, text, starts in zip(batch.column(0).to_pylist(), text_values(batch.column(1)), batch.column(2).to_pylist()):
                spans: list[list[int]] = []
                for lo, hi in sorted((s["lo"], s["hi"]) for s in starts or ()):
                    if spans and lo <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], hi + length - 1)
                    else:
                        spans.append([lo, hi + length - 1])
                edges = [0, *[x for s in spans for x in s], len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
                out.append((doc, len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), spans,
                            kept if with_text else None))
                size += len(text)
                if size > 8 << 20:
                    yield _batch(out, RESULT)
                    out, size = [], 0
            if out:
                yield _batch(out, RESULT)

    return docs.mapInArrow(run, RESULT)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, anchor: int = ANCHOR,
                   keep_first: bool = True, crowded: int = CROWDED, with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (byte offsets, end exclusive), kept of each document row.

    `keep_first`: bytes covered by a string that also starts earlier (in order of id, then place) go; otherwise all bytes
    covered by a string that also starts anywhere else.
    """
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
                       F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("text"))
    rows = rows.withColumn("row", F.xxhash64("doc_id", "text"))
    segs = stored(_segment_rows(rows, length, anchor), "segments")
    place = F.struct("doc_id", "row", "lo", "n")
    kinds = segs.groupBy("anchor", "seg").agg(F.count("*").alias("c"), F.min(place).alias("rep"))
    shared = kinds.groupBy("anchor").agg(F.sum("c").alias("total"), F.count("*").alias("m")).filter("total > 1")
    hit = stored(kinds.join(shared, "anchor").select("anchor", "seg", "c", "rep", "m"), "shared")

    whole = segs.join(hit.filter("c > 1").select("anchor", "seg", "rep"), ["anchor", "seg"])
    if keep_first:
        whole = whole.filter(~place.eqNullSafe(F.col("rep")))
    whole = whole.select("doc_id", "row", "lo", (F.col("lo") + F.col("n")).alias("hi"))

    def texts_of(chosen: DataFrame) -> DataFrame:
        """Documents with the segments that one representative of each kind of segment is to be read from."""
        w = chosen.select("rep.*", "anchor").groupBy("doc_id", "row").agg(
            F.collect_list(F.struct("lo", "n", "anchor")).alias("wanted")).select(
            F.col("doc_id").alias("w_id"), F.col("row").alias("w_row"), "wanted")
        joined = rows.join(w, (F.col("row") == F.col("w_row")) & F.col("doc_id").eqNullSafe(F.col("w_id")))
        return joined.select("doc_id", "row", "text", "wanted")

    parts = _parts(texts_of(hit.filter((F.col("m") > 1) & (F.col("m") <= crowded))), length)
    compared = _compare(parts.repartition("group").sortWithinPartitions("group", "doc_id", "row", "lo"), length, keep_first)
    crowd = hit.filter(F.col("m") > crowded)
    if not crowd.isEmpty():
        # Equal rows give equal windows: one of them speaks for all.
        windows = stored(_windows(texts_of(crowd), length), "windows")
        start = F.struct("doc_id", "row", "lo")
        counts = windows.groupBy("anchor", "h").agg(F.min(start).alias("first"), F.max(start).alias("last")).filter(
            ~F.col("first").eqNullSafe(F.col("last")))
        again = windows.join(counts, ["anchor", "h"])
        again = again.filter(~start.eqNullSafe(F.col("first"))) if keep_first else again
        compared = compared.union(again.select("doc_id", "row", "lo", (F.col("lo") + 1).alias("hi")))

    spans = whole.union(compared).groupBy("doc_id", "row").agg(F.collect_set(F.struct("lo", "hi")).alias("starts"))
    s = spans.select(F.col("doc_id").alias("s_id"), F.col("row").alias("s_row"), "starts")
    joined = rows.join(s, (F.col("row") == F.col("s_row")) & F.col("doc_id").eqNullSafe(F.col("s_id")), "left")
    return _cut(joined.select("doc_id", "text", "starts"), length, with_text)
