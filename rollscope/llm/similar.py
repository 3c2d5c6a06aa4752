"""Near-duplicates by SimHash candidates and exact Jaccard similarity of word shingles, for the pipeline.

Two texts are linked if their sets of 5-word shingles have a Jaccard similarity of 0.8 or more. SimHash alone cannot find
these pairs: at 0.8 two fingerprints differ by about 10 of 64 bits, too many for Hamming balls. So its multi-index
search (at most 4 bits apart) gives the first candidates, and a prefix filter, which misses no pair, gives the rest: if all sets
are put in one order of shingles, two similar ones share a shingle among the first n - ceil(0.8 n) + 1 of each. The order is by
hash, with frequent shingles last, so a common passage stands in few prefixes; any order gives the same result. Frequent are those of
a sample and, by counts over all prefixes of the corpus, those that more than `HOT` of them hold.

Each text's hashes are counted in 256 classes. The smaller counts of two texts sum to an upper bound of their common shingles;
pairs below the threshold go by these counts alone, the others are compared by their whole sets.

Copies meet as distinct sets. First the members of a SimHash component and then those of a prefix shingle are compared with one of
them only; then members of different components are compared, but never those of the largest component of a shingle with each
other, since they are connected already. They meet in cells of at most two blocks of members, whose pairs are looked at in place, three times:
by shingle and classes, which gives groups of components that may be linked, by group and bitmaps, which gives smaller groups, and by these and
whole sets. Classes say little of texts of thousands of shingles (the counts of any two are alike), so the bitmaps grow with the sets, and whole
sets are dealt only to the few cells of what the bitmaps leave. No pair becomes a row unless it
connects what its task had not yet connected, so rows grow with the members and not with their pairs. Joins on rare keys see rows that a bitmap of the keys lets pass (`maybe_in`), so texts
and shingles without a partner are not shuffled. Stored tables are removed once their successors are stored.

Defined results: null and empty texts have the empty set and are copies of each other; a text under five words is one shingle;
texts of any length are compared whole; ASCII letters are compared in lower case. A group keeps exactly one row: that of the smallest
doc_id (a null id only if there is no other), of the smallest text hash if rows with one id differ, and any one of rows equal in id and
text. Rows are judged one by one, so a row stays whatever happens to another row with its id. All columns stay as they are, whatever
their names (but for names that start with two underscores); an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollscope.llm.common import add_columns, maybe_in, release, stored
from rollscope.llm.components import connected_components
from rollscope.llm.simhash import LOWER, links, packed_majority

SHINGLE = 5
# Similarity of at least 4 / 5.
NUM, DEN = 4, 5
SAMPLE_ROWS, SAMPLE_LEAST, MOST_FREQUENT = 4000, 3, 200_000
# Prefix shingles of more distinct sets than HOT are moved behind the others, in so many further passes at most.
HOT, HOT_PASSES = 2000, 2
CLASSES = 256
# Members of a prefix shingle in one block; the blocks of a shingle meet in pairs. Pairs looked at, and compared by classes, at once.
BLOCK, LOOKED_AT, COMPARED = 512, 1 << 17, 1 << 13
# Members, or hashes of their whole sets, in one block of a group whose sets are compared.
SET_BLOCK, SET_HASHES = 1024, 1 << 18
# A set's bitmap has at least so many bits, and two for each hash. Members, or hashes of their sets, in one block of a group whose bitmaps are
# compared, and bytes of bitmaps compared at once.
LEAST_BITS, BITS_BLOCK, BITS_HASHES, BITS_COMPARED = 256, 1024, 1 << 25, 1 << 22


def shingles(text: bytes, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of one text."""
    words = text.translate(LOWER).split()
    if not words:
        return np.zeros(0, np.int64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(k, len(words))
    digest = xxhash.xxh64_intdigest
    pairs = zip(starts[:len(words) - k + 1].tolist(), ends[k - 1:].tolist())
    return np.unique(np.fromiter([digest(joined[a:b]) for a, b in pairs], np.uint64)).view(np.int64)


def _frequent(docs: DataFrame) -> list[int]:
    """Hashes of shingles that are frequent in a sample, the most frequent first."""
    n = docs.count()
    part = docs.select("text").filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < F.lit(
        min(1 << 20, SAMPLE_ROWS * (1 << 20) // max(1, n)))).distinct()
    field = T.StructType([T.StructField("s", T.ArrayType(T.LongType()))])
    sets = add_columns(part, lambda: lambda texts: [[shingles(x) for x in texts]], field)
    top = sets.select(F.explode("s").alias("s")).groupBy("s").count().filter(F.col("count") >= SAMPLE_LEAST).orderBy(
        F.desc("count"), "s").limit(MOST_FREQUENT).collect()
    return [r["s"] for r in top]


def _prefixes(docs: DataFrame, often: list[int]) -> DataFrame:
    """doc_id, text_hash, node (hash of the set), n (its size), fp, classes, prefix of each row. `often`: most frequent first."""
    found = np.array(often, np.int64)
    order = np.argsort(found)
    frequent, rank = found[order], -order
    fields = T.StructType([T.StructField("node", T.LongType()), T.StructField("n", T.LongType()), T.StructField("fp", T.LongType()),
                           T.StructField("classes", T.BinaryType()), T.StructField("prefix", T.ArrayType(T.LongType()))])

    def make():
        def run(texts: list[bytes]) -> list[list]:
            nodes, sizes, fps, classes, prefixes = [], [], [], [], []
            for x in texts:
                h = shingles(x)
                nodes.append(int(np.uint64(xxhash.xxh64_intdigest(h.tobytes())).view(np.int64)))
                sizes.append(len(h))
                fps.append(packed_majority(h))
                c = np.bincount(h & (CLASSES - 1), minlength=CLASSES)
                classes.append(c.astype(np.uint8).tobytes() if c.max() < 256 else None)
                if len(frequent) and len(h):
                    at = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
                    late = frequent[at] == h
                    h = np.concatenate([h[~late], h[late][np.argsort(rank[at[late]], kind="stable")]])
                prefixes.append(h[:len(h) - -(-NUM * len(h) // DEN) + 1])
            return [nodes, sizes, fps, classes, prefixes]
        return run

    return add_columns(docs, make, fields)


def _class_rows(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Classes of each row, one line each, and whether it has any."""
    valid = col.is_valid().to_numpy(zero_copy_only=False)
    out = np.zeros((len(col), CLASSES), np.uint8)
    out[valid] = np.frombuffer(b"".join(col.drop_null().to_pylist()), np.uint8).reshape(-1, CLASSES)
    return out, valid


def _enough(x: np.ndarray, y: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Whether two lines of classes allow enough common shingles for sets of these sizes in sum."""
    return (NUM + DEN) * np.minimum(x, y).sum(1, dtype=np.int64) >= NUM * total


def _possible(pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose classes allow enough common shingles, from rows a, na, ca, b, nb, cb."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, na, ca, b, nb, cb = (batch.column(i) for i in range(6))
            (x, x_valid), (y, y_valid) = _class_rows(ca), _class_rows(cb)
            keep = ~(x_valid & y_valid) | _enough(x, y, na.to_numpy(zero_copy_only=False) + nb.to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([a.filter(pa.array(keep)), b.filter(pa.array(keep))], names=["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def _bitmap(hashes: np.ndarray) -> bytes:
    """Bits at the hashes modulo the size, a power of two."""
    bits = np.zeros(max(LEAST_BITS, 1 << (2 * len(hashes) - 1).bit_length() if len(hashes) else 0), bool)
    bits[hashes & (len(bits) - 1)] = True
    return np.packbits(bits, bitorder="little").tobytes()


class _Bitmaps:
    """Bitmaps of some sets by their sizes in bytes, each also folded to half its size. Sets whose numbers of hashes allow a similarity
    of 0.8 have bitmaps of one size, or one of twice the other."""

    def __init__(self, bitmaps: list[bytes], n: np.ndarray) -> None:
        self.n, self.size = n, np.fromiter(map(len, bitmaps), np.int64, len(bitmaps))
        self.own, self.half = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in np.unique(np.concatenate([self.size, self.size // 2])).tolist():
            whole, twice = np.flatnonzero(self.size == size), np.flatnonzero(self.size == 2 * size)
            rows = np.frombuffer(b"".join(bitmaps[i] for i in whole), np.uint8).reshape(-1, size)
            folded = np.frombuffer(b"".join(bitmaps[i] for i in twice), np.uint8).reshape(-1, 2 * size)
            rows = np.concatenate([rows, folded[:, :size] | folded[:, size:]]).view(np.uint64)
            self.own[whole], self.half[twice] = np.arange(len(whole)), len(whole) + np.arange(len(twice))
            self.by_size[size] = rows, np.bitwise_count(rows).sum(1, dtype=np.int64)

    def enough(self, x: np.ndarray, y: np.ndarray, total: np.ndarray) -> np.ndarray:
        """Whether bitmaps allow enough common shingles: a bit that one set alone has stands for a shingle that it alone has."""
        keep = np.zeros(len(x), bool)
        sizes = np.minimum(self.size[x], self.size[y])
        for size in np.unique(sizes).tolist():
            rows, ones = self.by_size[size]
            here = np.flatnonzero(sizes == size)
            step = max(1, BITS_COMPARED // size)
            for at in range(0, len(here), step):
                part = here[at:at + step]
                i, j = x[part], y[part]
                a, b = (np.where(self.size[v] == size, self.own[v], self.half[v]) for v in (i, j))
                both = np.bitwise_count(rows[a] & rows[b]).sum(1, dtype=np.int64)
                common = both + np.minimum(self.n[i] - ones[a], self.n[j] - ones[b])
                keep[part] = (NUM + DEN) * common >= NUM * total[part]
        return keep


class _Joined:
    """Roots that a task has joined so far. `label` names the part of each row of one table; rows with one label need no pair."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def start(self, root: np.ndarray) -> None:
        names, at = np.unique(root, return_inverse=True)
        self.label = np.array([self._top(r) for r in names.tolist()], np.int64)[at]

    def _top(self, root: int) -> int:
        way = []
        while root in self.up:
            way.append(root)
            root = self.up[root]
        for r in way:
            self.up[r] = root
        return root

    def join(self, x: int, y: int) -> bool:
        """Whether the rows had different labels, which are one from now on."""
        a, b = int(self.label[x]), int(self.label[y])
        if a == b:
            return False
        self.label[self.label == b] = a
        self.up[b] = a
        return True


def _apart(joined: _Joined, ends: np.ndarray, starting: np.ndarray, lo: np.ndarray, hi: np.ndarray, own: np.ndarray, n: np.ndarray, p: np.ndarray,
           enough: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of pairs with different labels that are possible by sizes, positions and `enough`, some at a time. Rows are sorted by
    cell, cells end at `ends`; of each pair the first row is in `starting`."""
    label = joined.label
    count = ends[np.searchsorted(ends, starting, "right")] - starting - 1
    until = np.cumsum(count)
    at = 0
    while at < len(starting):
        to = max(at + 1, int(np.searchsorted(until, (until[at - 1] if at else 0) + LOOKED_AT, "right")))
        k = count[at:to]
        x = np.repeat(starting[at:to], k)
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(k) - k, k)
        total = n[x] + n[y]
        fits = ((label[x] != label[y]) & ((lo[x] == hi[x]) | (own[x] != own[y])) & (DEN * np.minimum(n[x], n[y]) >= NUM * np.maximum(n[x], n[y]))
                & ((NUM + DEN) * np.minimum(n[x] - p[x], n[y] - p[y]) >= NUM * total))
        x, y, total = x[fits], y[fits], total[fits]
        for c in range(0, len(x), COMPARED):
            a, b, both = x[c:c + COMPARED], y[c:c + COMPARED], total[c:c + COMPARED]
            open_ = label[a] != label[b]
            a, b, both = a[open_], b[open_], both[open_]
            keep = enough(a, b, both)
            yield a[keep], b[keep]
        at = to


def _by_classes(classes: np.ndarray, valid: np.ndarray) -> Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    return lambda x, y, total: ~(valid[x] & valid[y]) | _enough(classes[x], classes[y], total)


def _by_cells(rows: DataFrame, key: str, order: list[str], make: Callable[[], Callable[[pa.Table], pa.RecordBatch]]) -> DataFrame:
    """Pairs (a, b) that `make()`'s function finds in whole cells (key, lo, hi), the first three columns of `rows`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = make()
        # The last cell of a batch may go on in the next one.
        left: list[pa.RecordBatch] = []
        for batch in batches:
            rows = pa.Table.from_batches([*left, batch]).combine_chunks()
            if not len(rows):
                continue
            cut = int(_cell_starts(*(rows.column(i).to_numpy() for i in range(3)))[-1])
            if cut:
                yield find(rows.slice(0, cut))
            left = rows.slice(cut).to_batches()
        if left:
            yield find(pa.Table.from_batches(left))

    return rows.repartition(key, "lo", "hi").sortWithinPartitions(key, "lo", "hi", *order).mapInArrow(run, "a long, b long")


def _dealt(members: DataFrame, blocks: Column) -> DataFrame:
    """Members once for each cell of two blocks that they are in: plus own, lo, hi."""
    own = F.pmod(F.xxhash64("node", F.lit(7)), blocks).cast("int")
    dealt = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return dealt.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))


def _edges(a: list[int], b: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _met_in_cells(members: DataFrame, block: int) -> DataFrame:
    """Pairs (a, b) of roots that connect, directly or not, all roots with a possible pair of members of one shingle.

    `members`: s, members (of the shingle), in_main (of its largest component), node, root, n, p, classes. A shingle's members
    are dealt to blocks and each pair of blocks is a cell, in one task. Members of the largest component come last in a cell and
    start no pair, so they never meet each other. A task returns fewer pairs than it sees roots.
    """
    cells = _dealt(members, F.ceil(F.col("members") / F.lit(block)).cast("int")).select(
        "s", "lo", "hi", "in_main", "own", "node", "root", "n", "p", "classes")

    def make():
        joined = _Joined()

        def find(rows: pa.Table) -> pa.RecordBatch:
            s, lo, hi, in_main, own, _, root, n, p = (rows.column(i).to_numpy() for i in range(9))
            classes, valid = _class_rows(rows.column(9).combine_chunks())
            ends = np.append(_cell_starts(s, lo, hi)[1:], len(s))
            joined.start(root)
            a, b = [], []
            for x, y in _apart(joined, ends, np.flatnonzero(~in_main), lo, hi, own, n, p, _by_classes(classes, valid)):
                for i, j in zip(x.tolist(), y.tolist()):
                    if joined.join(i, j):
                        a.append(int(root[i]))
                        b.append(int(root[j]))
            return _edges(a, b)
        return find

    return _by_cells(cells, "s", ["in_main"], make)


def _grouped_cells(members: DataFrame, block: int, block_hashes: int, last: str) -> DataFrame:
    """Cells as above of groups, of blocks of about `block` members or `block_hashes` hashes. `members`: group, members (of the group),
    hashes_in_all (sizes in sum), node, root, n and the column `last`."""
    blocks = F.ceil(F.greatest(F.col("members") / F.lit(block), F.col("hashes_in_all") / F.lit(block_hashes))).cast("int")
    return _dealt(members, F.greatest(blocks, F.lit(1))).select("group", "lo", "hi", "own", "node", "root", "n", last)


def _near_in_cells(members: DataFrame, block: int, block_hashes: int) -> DataFrame:
    """Pairs (a, b) of roots that connect all roots of one group with a pair that their `bitmap`s allow."""
    def make():
        joined = _Joined()

        def find(rows: pa.Table) -> pa.RecordBatch:
            group, lo, hi, own, _, root, n = (rows.column(i).to_numpy() for i in range(7))
            ends = np.append(_cell_starts(group, lo, hi)[1:], len(n))
            joined.start(root)
            a, b = [], []
            for start, end in zip(np.append(0, ends[:-1]).tolist(), ends.tolist()):
                if (joined.label[start:end] == joined.label[start]).all():
                    continue
                bitmaps = _Bitmaps(rows.column(7).slice(start, end - start).to_pylist(), n[start:end])
                for x, y in _apart(joined, ends, np.arange(start, end), lo, hi, own, n, np.zeros(len(n), np.int64),
                                   lambda x, y, total: bitmaps.enough(x - start, y - start, total)):
                    for i, j in zip(x.tolist(), y.tolist()):
                        if joined.join(i, j):
                            a.append(int(root[i]))
                            b.append(int(root[j]))
            return _edges(a, b)
        return find

    return _by_cells(_grouped_cells(members, block, block_hashes, "bitmap"), "group", [], make)


def _linked_in_cells(members: DataFrame, block: int, block_hashes: int) -> DataFrame:
    """Pairs (a, b) of similar sets that connect all members of one group that similar sets connect, from their whole sets `hashes`.

    Sets are compared where they are; a task returns fewer pairs than it sees roots.
    """

    def make():
        joined = _Joined()

        def cell(rows: pa.Table) -> Iterator[tuple[int, int]]:
            lo, hi, own, node, root, n = (rows.column(i).to_numpy() for i in range(1, 7))
            # The largest component last; it starts no pair.
            names, at, count = np.unique(root, return_inverse=True, return_counts=True)
            if len(names) < 2:
                return
            in_main = at == count.argmax()
            order = np.argsort(in_main, kind="stable")
            lo, hi, own, node, root, n = (v[order] for v in (lo, hi, own, node, root, n))
            column = rows.column(7).combine_chunks().take(pa.array(order))
            hashes = column.flatten().to_numpy()
            ids = np.unique(hashes, return_inverse=True)[1].astype(np.int32)
            until = np.cumsum(n)
            counts = np.bincount(np.repeat(np.arange(len(n)) * CLASSES, n) + (hashes & (CLASSES - 1)), minlength=len(n) * CLASSES).reshape(-1, CLASSES)
            valid, classes = counts.max(axis=1) < 256, counts.astype(np.uint8)
            del hashes, counts, column
            mark = np.zeros(int(ids.max(initial=0)) + 1, bool)
            joined.start(root)
            label = joined.label
            for x, y in _apart(joined, np.array([len(n)]), np.flatnonzero(~in_main[order]), lo, hi, own, n, np.zeros(len(n), np.int64),
                               _by_classes(classes, valid)):
                cuts = np.flatnonzero(np.diff(x, prepend=-1))
                for i, others in zip(x[cuts].tolist(), np.split(y, cuts[1:])):
                    mark[ids[until[i] - n[i]:until[i]]] = True
                    others = others[label[others] != label[i]]
                    while len(others):
                        few = others[:max(1, int(np.searchsorted(np.cumsum(n[others]), LOOKED_AT, "right")))]
                        ends = np.cumsum(n[few])
                        hit = mark[ids[np.repeat(until[few] - ends, n[few]) + np.arange(int(ends[-1]))]]
                        common = np.diff(np.concatenate([[0], np.cumsum(hit)])[ends], prepend=0)
                        for j in few[(NUM + DEN) * common >= NUM * (n[i] + n[few])].tolist():
                            if joined.join(i, j):
                                yield int(node[i]), int(node[j])
                        others = others[len(few):]
                        others = others[label[others] != label[i]]
                    mark[ids[until[i] - n[i]:until[i]]] = False

        def find(rows: pa.Table) -> pa.RecordBatch:
            starts = _cell_starts(*(rows.column(i).to_numpy() for i in range(3)))
            pairs = [e for a, b in zip(starts, np.append(starts[1:], len(rows))) for e in cell(rows.slice(a, b - a))]
            return _edges([a for a, _ in pairs], [b for _, b in pairs])
        return find

    return _by_cells(_grouped_cells(members, block, block_hashes, "hashes"), "group", [], make)


def _cell_starts(s: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Where a new cell begins in sorted rows."""
    new = (s[1:] != s[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
    return np.flatnonzero(np.append(len(s) > 0, new))


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose sets are similar."""
    both = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.filter((NUM + DEN) * common >= NUM * (F.size("sa") + F.size("sb"))).select("a", "b")


class Links:
    """Verified links between sets, and what they connect so far. `rows`: one row per set (node, n, text_hash, classes)."""

    def __init__(self, rows: DataFrame, docs: DataFrame) -> None:
        self.rows, self.docs = rows, docs
        self.edges: DataFrame | None = None
        self.roots: DataFrame | None = None

    def whole(self, nodes: DataFrame, bitmaps: bool = False) -> DataFrame:
        """Complete sets of some nodes, each from one text; with `bitmaps` also the bitmap of each."""
        chosen = maybe_in(self.rows.select("node", "text_hash"), F.col("node"), nodes).join(nodes, "node")
        texts = maybe_in(self.docs.select("text_hash", "text"), F.col("text_hash"), chosen.select("text_hash"))
        fields = [T.StructField("hashes", T.ArrayType(T.LongType()))] + [T.StructField("bitmap", T.BinaryType())] * bitmaps
        one = texts.join(chosen, "text_hash").groupBy("node").agg(F.first("text").alias("text"))

        def columns(t: list[bytes]) -> list[list]:
            hashes = [shingles(x) for x in t]
            return [hashes, [_bitmap(h) for h in hashes]] if bitmaps else [hashes]

        return add_columns(one, lambda: columns, T.StructType(fields))

    def classes(self, nodes: DataFrame) -> DataFrame:
        """node, n, classes of some nodes."""
        return maybe_in(self.rows.select("node", "n", "classes"), F.col("node"), nodes).join(nodes, "node")

    def add(self, pairs: DataFrame) -> None:
        """Take in the similar ones of the pairs (a, b)."""
        near = stored(pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")

        def ends(df: DataFrame) -> DataFrame:
            return df.select("a").union(df.select("b")).toDF("node").distinct()

        known = self.classes(ends(near))
        possible = stored(_possible(near.join(known.toDF("a", "na", "ca"), "a").join(known.toDF("b", "nb", "cb"), "b")
                                    .select("a", "na", "ca", "b", "nb", "cb")), "possible")
        release(near)
        sets = stored(self.whole(ends(possible)), "sets")
        new = stored(_similar(possible, sets), "similar")
        release(possible, sets)
        self.take(new)

    def take(self, new: DataFrame) -> None:
        """Take in pairs (a, b) of similar sets from a stored table."""
        self.edges = new if self.edges is None else self.edges.union(new)
        found = connected_components(self.edges)
        old = self.roots
        self.roots = stored(found, "roots")
        if old is not None:
            release(old)

    def named(self, nodes: DataFrame) -> DataFrame:
        """Rows with `node`, plus the root of its component."""
        if self.roots is None:
            return nodes.withColumn("root", F.col("node"))
        return nodes.join(self.roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _fits(a: str, b: str):
    """Prefix positions and sizes allow a similarity of 0.8."""
    return ((DEN * F.least(f"{a}.n", f"{b}.n") >= NUM * F.greatest(f"{a}.n", f"{b}.n"))
            & ((NUM + DEN) * F.least(F.col(f"{a}.n") - F.col(f"{a}.p"), F.col(f"{b}.n") - F.col(f"{b}.p"))
               >= NUM * (F.col(f"{a}.n") + F.col(f"{b}.n"))))


def _first_rows(rows: DataFrame) -> DataFrame:
    """One row per set, and a few of the other rows."""
    first = stored(rows.groupBy("node").agg(F.min("row").alias("row")).select("row"), "first")
    return maybe_in(rows, F.col("row"), first)


def _sized(grouped: DataFrame) -> DataFrame:
    """Rows (group, node, root, n) plus members and sum of n of their group."""
    return grouped.join(grouped.groupBy("group").agg(F.count("*").alias("members"), F.sum("n").alias("hashes_in_all")), "group")


def components(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, text_hash, node) of all documents and roots (node, root) of the sets that are linked, from doc_id, text, text_hash."""
    often = _frequent(own)
    for left in range(HOT_PASSES, -1, -1):
        rows = stored(_prefixes(own, often).withColumn("row", F.monotonically_increasing_id()), "shingles")
        one = _first_rows(rows)
        counts = one.select(F.explode("prefix").alias("s")).groupBy("s").count().filter("count > 1")
        shared = stored(counts, "shared")
        hot = [r["s"] for r in shared.filter(F.col("count") > HOT).orderBy(F.desc("count"), "s").limit(MOST_FREQUENT).collect()] if left else []
        new = set(hot) - set(often)
        if not new:
            break
        known = set(hot)
        often = (hot + [s for s in often if s not in known])[:MOST_FREQUENT]
        release(rows, shared)
    entries = one.select("node", "n", F.posexplode("prefix").alias("p", "s"))
    keys = shared.select("s")
    meet = stored(maybe_in(entries, F.col("s"), keys).join(keys, "s").dropDuplicates(["s", "node"]), "shared-rows")
    release(shared)
    # One row per set without its prefix, for classes and texts.
    slim = stored(one.select("node", "n", "text_hash", "classes", "fp", "row").dropDuplicates(["node"]), "sets-once")
    found = Links(slim, own)

    # SimHash: each set with the least of its fingerprint's component.
    fps = stored(slim.groupBy("fp").agg(F.min("node").alias("first")), "fps")
    joint = stored(connected_components(links(fps)), "fp-roots").withColumnsRenamed({"node": "fp", "root": "fp_root"})
    leaders = stored(slim.select("node", "fp").join(joint, "fp", "left").withColumn("fp_root", F.coalesce("fp_root", "fp"))
                     .select("node", "fp_root"), "leaders")
    least = leaders.groupBy("fp_root").agg(F.min("node").alias("b"))
    found.add(leaders.join(least, "fp_root").select(F.col("node").alias("a"), "b"))
    release(fps, leaders)

    # Prefix shingles: each member with one of them, then the members of different components.
    now = found.named(meet)
    star = now.groupBy("s").agg(F.min(F.struct(F.xxhash64("node").alias("h"), "node", "n", "p", "root")).alias("c")).select("s", "c.*")
    found.add(now.alias("x").join(star.alias("y"), "s").filter(_fits("x", "y") & (F.col("x.root") != F.col("y.root")))
              .select(F.col("x.node").alias("a"), F.col("y.node").alias("b")))
    now = stored(found.named(meet), "rooted")
    per = now.groupBy("s", "root").count()
    main = stored(per.groupBy("s").agg(F.max(F.struct("count", "root"))["root"].alias("main"), F.count("*").alias("m"),
                                       F.sum("count").alias("members")).filter("m > 1").select("s", "main", "members"), "main")
    mixed = stored(maybe_in(now, F.col("s"), main.select("s")).join(main, "s").withColumn("in_main", F.col("root") == F.col("main")), "mixed")
    release(now)
    known = found.classes(mixed.select("node").distinct()).select("node", "classes")
    # Roots that possible pairs connect are a group; in it, each set meets each other one once, whatever shingles they share.
    maybe = stored(_met_in_cells(mixed.join(known, "node"), BLOCK).distinct(), "possible-roots")
    groups = stored(connected_components(maybe), "groups").toDF("root", "group")
    grouped = stored(mixed.select("node", "root", "n").dropDuplicates(["node"]).join(groups, "root"), "grouped")
    sets = stored(found.whole(grouped.select("node"), bitmaps=True), "sets")
    near = stored(_near_in_cells(_sized(grouped).join(sets.select("node", "bitmap"), "node"), BITS_BLOCK, BITS_HASHES).distinct(), "near-roots")
    closer = stored(connected_components(near), "near-groups").toDF("root", "group")
    regrouped = stored(grouped.drop("group").join(closer, "root"), "regrouped")
    new = stored(_linked_in_cells(_sized(regrouped).join(sets.select("node", "hashes"), "node"), SET_BLOCK, SET_HASHES), "similar")
    found.take(new)
    release(maybe, grouped, sets, near, regrouped)
    keys = stored(rows.select("doc_id", "text_hash", "node"), "keys")
    release(meet, mixed, main, slim, rows)
    return keys, found.roots


def keep_one_similar(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of documents that are linked by similarities of 0.8 or more."""
    own = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.xxhash64(f"`{text}`").alias("text_hash"))
    rows, roots = components(own)
    keys = rows.groupBy("doc_id", "text_hash", "node").count()
    keys = stored(keys.join(roots, "node", "left").select("doc_id", "text_hash", "count", F.coalesce("root", "node").alias("root")), "roots-of-rows")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    first = keys.groupBy("root").agg(F.min(rank).alias("first"))
    judged = keys.join(first, "root").withColumn("stays", F.col("first") == rank)
    row_key = F.xxhash64(F.col("doc_id"), F.col("text_hash"))
    # Rows to look at one by one: those that go, and those of which one stays.
    listed = stored(judged.filter("not stays or count > 1").select(
        F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "stays", row_key.alias("__key")).withColumnRenamed("stays", "__stays"), "listed")
    full = docs.withColumn("__text_hash", F.xxhash64(f"`{text}`"))
    full = full.withColumn("__row_key", F.xxhash64(F.col(f"`{doc_id}`").cast(own.schema["doc_id"].dataType), F.col("__text_hash")))
    names = listed.select("__key").distinct()
    maybe = maybe_in(full, F.col("__row_key"), names)
    clear = maybe_in(full, F.col("__row_key"), names, other=True)
    same = (F.col("__text_hash") == F.col("__hash")) & F.col(f"`{doc_id}`").eqNullSafe(F.col("__id"))
    # Outer and inner joins: an anti or semi join would be moved in front of the filter, and all texts be shuffled for it.
    left = maybe.join(listed.select("__id", "__hash"), same, "left").filter("__hash is null").drop("__id", "__hash")
    out = clear.unionByName(left)
    again = listed.filter("__stays")
    if not again.isEmpty():
        out = out.unionByName(maybe.join(again.select("__id", "__hash"), same).drop("__id", "__hash").dropDuplicates([doc_id, "__text_hash"]))
    return out.drop("__text_hash", "__row_key")
