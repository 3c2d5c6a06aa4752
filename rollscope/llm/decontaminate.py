"""Benchmark decontamination with training suffix arrays.

Every task builds the suffix array of its shard of documents and binary-searches every test suffix in it. Words outside
the benchmark cannot be part of a match, so the array holds only the suffixes of runs of benchmark words that are long
enough for the shortest window. The range of a search gives all verbatim occurrences; occurrences on one diagonal join
to the longest match with its place in the document and in the item.

The benchmark is read in blocks of at most `block_words` words (a bounded broadcast); for more blocks, the hits of each
are united per document. Documents are whole within a row and are never shuffled for one block.

Defined results: null text has no words; an item without words matches nothing; items with equal ids count once; null
item ids are left out of `items_sha256` and of `n_items`; empty tables give no hits. An input column with the name of
a result is replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollscope.llm.common import WordIds, add_columns, stored

WINDOW = 13
BLOCK_WORDS = 2_000_000
SLICE = 2 << 20

# ASCII letters to lower case, other ASCII characters but digits to blanks; bytes of other characters stay.
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text in ASCII lower case."""
    return text.translate(_TABLE).split()


class Benchmark:
    """Windows of a block of items, sorted, and the words they are made of."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW) -> None:
        self.window, self.vocab = window, WordIds()
        rows, self.item, self.at, self.size = [], [], [], []
        for item_id, text in items:
            ids = [self.vocab[w] + 1 for w in words_of(text)]
            k = min(window, len(ids))
            for i in range(len(ids) - k + 1 if ids else 0):
                rows.append(ids[i:i + k] + [0] * (window - k))
                self.item.append(item_id)
                self.at.append(i)
                self.size.append(k)
        self.rows = np.array(rows, np.uint32).reshape(-1, window)
        self.size = np.array(self.size, np.int64)
        self.shortest = int(self.size.min()) if rows else window

    def ids(self, words: list[bytes]) -> list[int]:
        """Number of each word, 0 for words of no item."""
        get = self.vocab.get
        return [get(w, -1) + 1 for w in words]


def _keys(rows: np.ndarray) -> np.ndarray:
    """Rows of word numbers as byte strings in the same order."""
    return np.ascontiguousarray(rows.astype(">u4")).view(f"S{4 * rows.shape[1]}").ravel()


def shard_matches(bench: Benchmark, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window row, position) of every occurrence of a window in a shard; 0 in `ids` separates runs."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    used = ids > 0
    if not used.any() or not len(bench.rows):
        return none
    edge = np.flatnonzero(np.diff(np.concatenate([[0], used.view(np.int8), [0]])))
    start, stop = edge[::2], edge[1::2]
    long = stop - start >= bench.shortest
    start, stop = start[long], stop[long]
    if not len(start):
        return none
    n = stop - start - bench.shortest + 1
    ends = np.cumsum(n)
    suffixes = np.repeat(start - (ends - n), n) + np.arange(int(ends[-1]))
    padded = np.concatenate([ids, np.zeros(bench.window, ids.dtype)])
    rows = padded[suffixes[:, None] + np.arange(bench.window)]
    rows[np.cumsum(rows == 0, axis=1) > 0] = 0  # a suffix ends with its run
    keys = _keys(rows)
    order = np.argsort(keys, kind="stable")
    array, keys = suffixes[order], keys[order]
    low = _keys(bench.rows)
    top = bench.rows.copy()
    top[np.arange(bench.window)[None, :] >= bench.size[:, None]] = 0xFFFFFFFF
    lo, hi = np.searchsorted(keys, low, "left"), np.searchsorted(keys, _keys(top), "right")
    n = hi - lo
    if not n.any():
        return none
    ends = np.cumsum(n)
    window = np.repeat(np.arange(len(n)), n)
    return window, array[np.repeat(lo - (ends - n), n) + np.arange(int(ends[-1]))]


def _join(starts: np.ndarray, stops: np.ndarray) -> list[tuple[int, int]]:
    """Union of intervals, sorted."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(stops[order])
    new = np.concatenate([[True], starts[1:] > reach[:-1]])
    first = np.flatnonzero(new)
    return list(zip(starts[first].tolist(), reach[np.append(first[1:] - 1, len(reach) - 1)].tolist()))


# Working columns of document rows while blocks are searched.
HITS = T.StructType([
    T.StructField("__n_words", T.LongType()),
    T.StructField("__spans", T.ArrayType(T.ArrayType(T.LongType()))),
    T.StructField("__items", T.ArrayType(T.StringType())),
    T.StructField("__longest", T.ArrayType(T.LongType())),
])


def _finder(items: list[tuple[str, bytes]], window: int):
    def make():
        bench = Benchmark(items, window)

        def find(texts: list[bytes]) -> list[list]:
            words = [words_of(x) for x in texts]
            n_words = [len(w) for w in words]
            flat: list[int] = []
            starts = []
            for w in words:
                starts.append(len(flat))
                flat += bench.ids(w)
                flat.append(0)
            ids = np.array(flat, np.uint32)
            rows, at = shard_matches(bench, ids)
            spans: list[list] = [[] for _ in texts]
            found: list[list] = [[] for _ in texts]
            longest: list[list] = [[] for _ in texts]
            if len(rows):
                doc = np.searchsorted(np.array(starts), at, "right") - 1
                order = np.argsort(doc, kind="stable")
                rows, at, doc = rows[order], at[order], doc[order]
                cut = np.flatnonzero(np.diff(doc)) + 1
                for r, p, d in zip(np.split(rows, cut), np.split(at, cut), doc[np.concatenate([[0], cut])]):
                    p = p - starts[d]
                    size = bench.size[r]
                    spans[d] = [list(x) for x in _join(p, p + size)]
                    best = longest_matches(bench, r, p)
                    found[d], longest[d] = list(best), list(best.values())
            return [n_words, spans, found, longest]
        return find
    return make


def longest_matches(bench: Benchmark, rows: np.ndarray, at: np.ndarray) -> dict[str, int]:
    """Longest verbatim match in words of each item: windows that follow each other on one diagonal are one match."""
    place = np.array([bench.at[r] for r in rows])
    first = rows - place  # the item's first window row names it
    order = np.lexsort((place, at - place, first))
    r, f, q, d = rows[order], first[order], place[order], (at - place)[order]
    new = np.concatenate([[True], (f[1:] != f[:-1]) | (d[1:] != d[:-1]) | (q[1:] != q[:-1] + 1)])
    begin = np.flatnonzero(new)
    n = np.diff(np.append(begin, len(r))) - 1 + bench.size[r[begin]]
    best: dict[str, int] = {}
    for row, k in zip(r[begin], n.tolist()):
        item = bench.item[row]
        if item is not None:
            best[item] = max(best.get(item, 0), k)
    return dict(sorted(best.items()))


def _blocks(bench: DataFrame, item_id: str, text: str, block_words: int) -> Iterator[list[tuple[str, bytes]]]:
    """Items in blocks of bounded size; a block with one item may be as long as that item."""
    sized = stored(bench.select(
        F.col(f"`{item_id}`").cast("string").alias("item_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("text")),
        "benchmark").withColumn("n", F.length("text"))
    total = sized.agg(F.sum("n").alias("n"), F.count("*").alias("rows")).first()
    count = max(1, -(-max((total["n"] or 0) // 4, total["rows"]) // block_words))
    for b in range(count):
        part = sized if count == 1 else sized.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == b)
        yield [(r["item_id"], bytes(r["text"])) for r in part.select("item_id", "text").collect()]


def benchmark_hits(docs: DataFrame, bench: DataFrame, text: str = "text", item_id: str = "item_id",
                   item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Document rows plus __n_words, __spans (hit words, [start, end)), __items and their __longest matches in words."""
    out = None
    for items in _blocks(bench, item_id, item_text, block_words):
        if out is None:
            out = add_columns(docs, _finder(items, window), HITS, text, SLICE, keep_text=True)
            continue
        # The next block goes over the same rows; its hits join those so far within the row.
        more = T.StructType([T.StructField(f"{f.name}_more", f.dataType) for f in HITS.fields])
        out = add_columns(out, _finder(items, window), more, text, SLICE, keep_text=True)
        out = out.withColumns({c: F.concat(c, f"{c}_more") for c in HITS.names[1:]}).drop(*more.names)
    return out


def _covered(spans: str) -> Column:
    """Words in a union of intervals."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("end"))
    return F.aggregate(F.sort_array(spans), zero, lambda a, s: F.struct(
        (a["n"] + F.greatest(F.lit(0).cast("long"), s[1] - F.greatest(s[0], a["end"]))).alias("n"),
        F.greatest(a["end"], s[1]).alias("end")))["n"]


def _contaminated(n_hit: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= F.col("__n_words"))


def contamination(docs: DataFrame, bench: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, longest, spans of each document row.

    `items` may name an item twice if the benchmark was read in several blocks; `n_items` and the digest do not.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    found = benchmark_hits(rows, bench, **options).withColumn("n_hit", _covered("__spans"))
    names = F.array_sort(F.array_distinct("__items"))
    return found.select(
        "doc_id", F.col("__n_words").alias("n_words"), "n_hit", F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"),
        _contaminated(F.col("n_hit")).alias("contaminated"), F.col("__items").alias("items"),
        F.col("__longest").alias("longest"), F.col("__spans").alias("spans"))


def drop_contaminated(docs: DataFrame, bench: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    found = benchmark_hits(docs, bench, text, **options)
    return found.filter(~_contaminated(_covered("__spans"))).select(*[F.col(f"`{c}`") for c in docs.columns])


def brute_contamination(doc: str | None, items: list[tuple[str, str | None]], window: int = WINDOW) -> tuple:
    """The rule word by word, for tests."""
    words = words_of((doc or "").encode())
    hit, ids = set(), set()
    for item_id, text in items:
        own = words_of((text or "").encode())
        k = min(window, len(own))
        for i in range(len(own) - k + 1 if own else 0):
            for p in range(len(words) - k + 1):
                if words[p:p + k] == own[i:i + k]:
                    hit.update(range(p, p + k))
                    ids.add(item_id)
    digest = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
    return len(words), len(hit), len(ids), digest, bool(hit) and 20 * len(hit) >= len(words)
