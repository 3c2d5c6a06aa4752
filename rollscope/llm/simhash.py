"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into three segments. Two fingerprints at most 4 bits apart agree in segment B or differ in at most
one bit of segment A or C (otherwise they would differ in 2 + 1 + 2 bits). Each fingerprint enters the tables of its
three segments once and probes the Hamming balls of radius 1, 0 and 1: 45 probes. Probe and table rows of one value
meet in one place, where complete distances are verified.

Only distinct fingerprints meet, and a meeting place returns a spanning forest of its links, never all pairs. A table
value with more than `crowded` distinct fingerprints is not compared pairwise at all: two fingerprints are at most 4
bits apart exactly if their Hamming balls of radius 2 share a point, so its fingerprints are linked through these
points with one minimum per point. That is exact and linear.

Defined results: null or empty texts have fingerprint zero and are linked with each other like any other; equal rows
share a component; a bit set in exactly half the shingles is 0; very long texts are hashed whole; the component of null ids
alone is null; other columns, of any name, are not read; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollscope.llm.common import add_columns, stored
from rollscope.llm.components import connected_components

LOWER = bytes.maketrans(bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B)))
# (first bit, bits, radius)
SEGMENTS = ((0, 21, 1), (21, 22, 0), (43, 21, 1))
MOST_BITS = 4
CROWDED = 4096


def fingerprint(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of one text as a signed number."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    lo, hi = starts[:len(words) - k + 1].tolist(), ends[k - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, len(lo), 1 << 16):
        h = np.fromiter([digest(joined[a:b], seed) for a, b in zip(lo[at:at + (1 << 16)], hi[at:at + (1 << 16)])], np.uint64)
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    packed = np.packbits(2 * counts > len(lo), bitorder="little")
    return int(packed.view("<i8")[0])


def packed_majority(hashes: np.ndarray) -> int:
    """Signed number of the bits that are set in over half of the 64-bit hashes; zero without any."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at:at + (1 << 16)].astype("<i8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp of each document row."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return add_columns(rows, lambda: lambda texts: [[fingerprint(x) for x in texts]],
                       T.StructType([T.StructField("fp", T.LongType())]), "text").select("doc_id", "fp")


def _balls(fps: DataFrame, crowded: bool) -> DataFrame:
    """key, fp, probe: table and probe rows. `crowded`: only the table rows."""
    out = T.StructType([T.StructField("key", T.LongType()), T.StructField("fp", T.LongType()),
                        T.StructField("probe", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for s, (first, bits, radius) in enumerate(SEGMENTS):
                value = (fp.view(np.uint64) >> np.uint64(first)) & np.uint64((1 << bits) - 1)
                base = value.astype(np.int64) | (s << 32)
                masks = [(0, False)] if crowded else [
                    (0, False), (0, True), *[(1 << i, True) for i in range(bits if radius else 0)]]
                for mask, probe in masks:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(base ^ mask), pa.array(fp), pa.array(np.full(len(fp), probe))], names=out.names)

    return fps.select("fp").mapInArrow(run, out)


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, root) that connect what the edges (a, b) connect, one per node at most."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        if (new == root).all():
            break
        root = new
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


EDGE = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _meet(keyed: DataFrame) -> DataFrame:
    """Links found where table and probe rows of one key meet: rows come sorted by key, table rows first."""
    chunk = 1 << 21

    def links(key: np.ndarray, fp: np.ndarray, probe: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        members, m_key = fp[~probe], key[~probe]
        p_fp, p_key = fp[probe], key[probe]
        lo, hi = np.searchsorted(m_key, p_key, "left"), np.searchsorted(m_key, p_key, "right")
        some = hi > lo
        lo, n, p_fp = lo[some], (hi - lo)[some], p_fp[some]
        ends = np.cumsum(n)
        at = 0
        while at < len(n):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + chunk, "right")))
            k = n[at:to]
            e = np.cumsum(k)
            own = np.repeat(p_fp[at:to], k)
            other = members[np.repeat(lo[at:to] - (e - k), k) + np.arange(int(e[-1]))]
            near = (np.bitwise_count((own ^ other).view(np.uint64)) <= MOST_BITS) & (own != other)
            if near.any():
                yield _forest(own[near], other[near])
            at = to

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def emit(parts) -> Iterator[pa.RecordBatch]:
            cols = [np.concatenate(c) for c in zip(*parts)]
            for a, b in links(*cols):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=EDGE.names)

        # A key's table rows come before its probes: of an unfinished key only the table rows stay for the next batch.
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            if not len(cols[0]):
                continue
            yield from emit([*held, cols])
            if held and cols[0][-1] == held[0][0][0]:
                keep = cols[0] == cols[0][-1]
                keep &= ~cols[2]
                held = [*held, tuple(c[keep] for c in cols)]
            else:
                keep = (cols[0] == cols[0][-1]) & ~cols[2]
                held = [tuple(c[keep] for c in cols)] if keep.any() else []

    return keyed.mapInArrow(run, EDGE)


def _crowd_links(fps: DataFrame) -> DataFrame:
    """Links of fingerprints whose Hamming balls of radius 2 share a point, through the least fingerprint of each point."""
    out = T.StructType([T.StructField("point", T.LongType()), T.StructField("fp", T.LongType())])
    one = [1 << i for i in range(64)]
    masks = np.array([0, *one, *[x ^ y for i, x in enumerate(one) for y in one[:i]]], np.uint64).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(fp), 256):
                part = fp[at:at + 256]
                yield pa.RecordBatch.from_arrays(
                    [pa.array((part[:, None] ^ masks[None, :]).ravel()), pa.array(np.repeat(part, len(masks)))],
                    names=out.names)

    points = stored(fps.select("fp").mapInArrow(run, out), "points")
    least = points.groupBy("point").agg(F.min("fp").alias("b"))
    return points.join(least, "point").filter("fp <> b").select(F.col("fp").alias("a"), "b").distinct()


def links(fps: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that connect all those at most 4 bits apart."""
    tables = _balls(fps, crowded=True)
    full = stored(tables.groupBy("key").count().filter(F.col("count") > crowded).select("key"), "crowded")
    rows = _balls(fps, crowded=False)
    extra = None
    if not full.isEmpty():
        # Probes of a crowded value come from fingerprints near it: they join its crowd, and the value is left out.
        crowd = stored(rows.join(full, "key", "left_semi").select("fp").distinct(), "crowd")
        extra = _crowd_links(crowd)
        rows = rows.join(full, "key", "left_anti")
    met = _meet(rows.repartition("key").sortWithinPartitions("key", "probe"))
    return met if extra is None else met.union(extra)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", crowded: int = CROWDED) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable over links of at most 4 bits, itself included)."""
    rows = stored(fingerprints(docs, doc_id, text), "fingerprints")
    fps = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    roots = stored(connected_components(links(fps, crowded)).withColumnRenamed("node", "fp"), "roots")
    named = fps.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # Most components are single fingerprints; only the linked ones meet again for their minimum.
    linked = named.join(roots.select("root").distinct(), "root", "left_semi")
    least = linked.groupBy("root").agg(F.min("first_id").alias("least_id"))
    ids = named.join(least, "root", "left").select("fp", F.coalesce("least_id", "first_id").alias("component_id"))
    return rows.join(ids, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without all but the smallest doc_id of each component. Rows with a null id are kept."""
    found = near_duplicates(docs, doc_id, text)
    gone = found.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col(f"`{doc_id}`") == F.col("__gone"), "left_anti")
