"""Sibling comparisons inside groups without emitting all pairs.

Token sets are compared as different sets with counts (`sibling_overlap`). Other payloads are folded: a group is cut into tiles of about TILE members. Every row meets each tile of its group once and
folds the whole tile to one partial sum, so the shuffle carries rows times tiles, not rows times rows,
and a large group spreads over as many tasks as it has tiles.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from rollscope.functions.boxes import best_recall, is_box
from rollscope.operators.skew import attach_stats, null_safe_join, with_group_stats
from rollscope.session import cut_lineage

TILE = 64


def fold_siblings(df: DataFrame, keys: Sequence[str], row_id: str, payload: Sequence[str],
                  partials: dict[str, Callable[[Column, Column], Column]], tile: int = TILE) -> DataFrame:
    """Per row, sums over its group's members of fn(row, member); fn sees structs of id and payload.

    Functions exclude the row itself where they need to by comparing ids.
    """
    keys = list(keys)
    me = F.struct(F.col(row_id).alias("id"), *[F.col(c) for c in payload])
    sized = with_group_stats(df.select(*keys, row_id, *payload), keys, {"__size": F.count(F.lit(1))})
    tiles = F.ceil(F.col("__size") / F.lit(tile)).cast("int")
    # Members and probes both read these rows; storing them keeps the payload (often parsed text) from
    # being computed once per branch.
    base = cut_lineage(sized.select(*keys, me.alias("__me"), tiles.alias("__tiles")))
    members = base.select(*keys, F.pmod(F.xxhash64(F.col("__me")["id"]), F.col("__tiles")).cast("int").alias("__tile"),
                          F.col("__me"))
    packed = members.groupBy(*keys, "__tile").agg(F.collect_list("__me").alias("__members"))
    probes = base.select(*keys, "__me", F.explode(F.sequence(F.lit(0), F.col("__tiles") - 1)).alias("__tile"))
    met = null_safe_join(probes, packed, [*keys, "__tile"])
    def total(fn: Callable[[Column, Column], Column]) -> Column:
        return F.aggregate("__members", F.lit(0.0), lambda acc, m: acc + fn(F.col("__me"), m))

    sums = [total(fn).alias(n) for n, fn in partials.items()]
    part = met.select(*keys, F.col("__me")["id"].alias(row_id), *sums)
    return part.groupBy(*keys, row_id).agg(*[F.sum(n).alias(n) for n in partials])


def overlap(a: Column, b: Column) -> Column:
    """Jaccard of two token arrays without repeats, 0 when either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(
        both / F.size(F.array_union(a, b)))


# Sets per block of a large group, and tokens per block where sets are long: a cell of two blocks is one task's work.
BLOCK, BLOCK_TOKENS = 2048, 500_000


def _cell_sums(frame: pd.DataFrame) -> pd.DataFrame:
    """Per set of two blocks, the weighted similarities to the sets of the other block (of its own on the diagonal).

    An inverted index per block: only tokens on both sides are walked, so sets without a shared token cost nothing.
    """
    home = frame["__b"] == frame["__lo"]
    diagonal = frame["__lo"].iloc[0] == frame["__hi"].iloc[0]
    left = frame[home]
    right = left if diagonal else frame[~home]
    if left.empty or right.empty:
        return frame.iloc[:0].assign(total=0.0)

    def postings(side: pd.DataFrame) -> dict:
        index: dict = {}
        for i, found in enumerate(side["__t"]):
            for t in found:
                index.setdefault(t, []).append(i)
        return index

    rows, cols = postings(left), postings(right)
    common = np.zeros((len(left), len(right)), dtype=np.int32)
    for t in rows.keys() & cols.keys():
        common[np.ix_(rows[t], cols[t])] += 1
    sizes = [side["__t"].str.len().to_numpy(dtype=np.int32) for side in (left, right)]
    similar = common / np.maximum(sizes[0][:, None] + sizes[1][None, :] - common, 1)
    weights = right["__m"].to_numpy(dtype=float)
    if diagonal:
        # A set meets its own other rows; the row itself is left out.
        own = similar.diagonal() * (weights - 1)
        np.fill_diagonal(similar, 0.0)
        return left.assign(total=similar @ weights + own)
    out = left.assign(total=similar @ weights)
    return pd.concat([out, right.assign(total=left["__m"].to_numpy(dtype=float) @ similar)])


def sibling_overlap(df: DataFrame, keys: Sequence[str], row_id: str, tokens: str, tile: int = TILE,
                    block: int = BLOCK) -> DataFrame:
    """Per row: `own` tokens, `others` rows of its group, `total` Jaccard similarity to them (0 where a side is empty).

    Equal token sets meet once, weighted by how many rows have them. Groups of at most `tile` different sets are
    compared inside one packed row. Larger ones are cut into blocks, and each pair of blocks is one cell for one task:
    the shuffle carries sets times blocks. A null set is an empty one; repeated rows are rows of their own.
    """
    keys = list(keys)
    found = F.array_sort(F.array_distinct(F.coalesce(F.col(tokens), F.array().cast("array<string>"))))
    digest = F.sha2(F.to_json("__t"), 256)
    # Both the sets and the result read these rows; storing them keeps the parse behind the tokens from running twice.
    rows = cut_lineage(df.select(*keys, row_id, found.alias("__t")))
    sets = rows.groupBy(*keys, "__t").agg(F.count(F.lit(1)).alias("__m")).withColumn("__set", digest)
    sizes = sets.groupBy(*keys).agg(F.count(F.lit(1)).alias("__sets"), F.sum("__m").alias("__rows"),
                                    F.sum(F.size("__t")).alias("__tokens"))
    blocks = F.greatest(F.ceil(F.col("__sets") / block), F.ceil(F.col("__tokens") / BLOCK_TOKENS), F.lit(1)).cast("int")
    sized = cut_lineage(attach_stats(sets, sizes, keys).withColumn("__blocks", blocks))
    packable = (F.col("__sets") <= tile) & (F.col("__blocks") == 1)

    one = F.struct("__set", "__m", "__t")
    packed = sized.filter(packable).groupBy(*keys).agg(F.collect_list(one).alias("__all"))
    weighed = F.transform("__all", lambda me: F.struct(me["__set"].alias("__set"), F.aggregate(
        "__all", F.lit(0.0), lambda acc, m: acc + overlap(me["__t"], m["__t"]) * (
            m["__m"] - (m["__set"] == me["__set"]).cast("int"))).alias("total")))
    within = packed.select(*keys, F.inline(weighed))

    home = F.pmod(F.xxhash64("__set"), F.col("__blocks")).cast("int")
    dealt = sized.filter(~packable).select(*keys, "__set", "__m", "__t", home.alias("__b"), F.explode(
        F.sequence(F.lit(0), F.col("__blocks") - 1)).alias("__o"))
    cells = dealt.select(*keys, "__set", "__m", "__t", "__b", F.least("__b", "__o").alias("__lo"),
                         F.greatest("__b", "__o").alias("__hi"))
    columns = StructType([*[df.schema[k] for k in keys], StructField("__set", StringType()),
                          StructField("total", DoubleType())])
    across = cells.groupBy(*keys, "__lo", "__hi").applyInPandas(lambda f: _cell_sums(f)[columns.names], columns)
    totals = within.unionByName(across.groupBy(*keys, "__set").agg(F.sum("total").alias("total")))

    out = null_safe_join(rows.select(*keys, row_id, F.size("__t").alias("own"), digest.alias("__set")),
                         totals, [*keys, "__set"])
    out = attach_stats(out, sizes.select(*keys, "__rows"), keys)
    return out.select(*keys, row_id, "own", (F.col("__rows") - 1).alias("others"), "total")


def mean_sibling_jaccard(df: DataFrame, keys: Sequence[str], row_id: str, tokens: str) -> DataFrame:
    """Mean token overlap of each row with its group siblings; empty rows and lone rows are 0."""
    met = sibling_overlap(df, keys, row_id, tokens)
    return met.select(*keys, row_id, F.when(F.col("others") > 0, F.col("total") / F.col("others"))
                      .otherwise(F.lit(0.0)).alias("mean_jaccard"))


def mean_sibling_evidence(df: DataFrame, keys: Sequence[str], row_id: str, words: str) -> DataFrame:
    """Mean keyword-set overlap with siblings; a row without keywords is 0, a lone row is 1."""
    met = sibling_overlap(df, keys, row_id, words)
    return met.select(*keys, row_id, F.when(F.col("others") == 0, F.lit(1.0)).when(F.col("own") == 0, F.lit(0.0))
                      .otherwise(F.col("total") / F.col("others")).alias("evidence"))


# A group's grid has at most this many cells along a side; one of at most SMALL boxes is a single cell. A cell is cut
# into tiles of about BOXES boxes and sets.
GRID, SMALL, BOXES = 16, 1024, 2048


def _usable(box: Column) -> Column:
    finite = F.forall(box, lambda v: ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(is_box(box) & finite, F.lit(False))


def _cells(box: Column) -> Column:
    """Grid cells, level by level, whose boxes may overlap this one.

    A box lives in the one cell of its lower corner, at the first level whose cells are no smaller than the box.
    """
    def level(n: Column) -> Column:
        side = F.col("__cell") * F.pow(F.lit(2.0), n)
        at = lambda i, lo: F.floor((box[i] - F.col(lo)) / side).cast("int")
        span = lambda i, lo: F.sequence(F.greatest(at(i, lo) - 1, F.lit(0)), at(i + 2, lo))
        return F.flatten(F.transform(span(0, "__x0"), lambda x: F.transform(span(1, "__y0"), lambda y: F.struct(
            n.alias("l"), x.alias("x"), y.alias("y")))))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.col("__levels")), level))


def _level(side: Column) -> Column:
    return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(side / F.col("__cell"), F.lit(1.0))))).cast("int")


def _tile_sums(frame: pd.DataFrame) -> pd.DataFrame:
    """Per set of a tile, the weights of the tile's boxes times the set's best overlap with each."""
    gold = frame["__set"].isna().to_numpy()
    probes = frame[~gold].sort_values("__set", kind="stable")
    if probes.empty or not gold.any():
        return frame.iloc[:0].assign(__total=0.0)
    sides = ["__x1", "__y1", "__x2", "__y2"]
    g, p = frame.loc[gold, sides].to_numpy().T[:, None, :], probes[sides].to_numpy().T[:, :, None]
    weights, area = frame.loc[gold, "__w"].to_numpy(), (g[2] - g[0]) * (g[3] - g[1])
    starts = np.flatnonzero(np.r_[True, probes["__set"].to_numpy()[1:] != probes["__set"].to_numpy()[:-1]])
    ends = np.r_[starts[1:], len(probes)]
    totals, step = np.zeros(len(starts)), max(1, 500_000 // g.shape[2])
    for i, (lo, end) in enumerate(zip(starts, ends)):
        if end - lo > step:  # one set of very many boxes
            best = np.zeros(g.shape[2])
            for at in range(lo, end, step):
                best = np.maximum(best, _overlaps(p[:, at:min(end, at + step)], g, area).max(axis=0))
            totals[i] = best @ weights
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + step, "right")))
        if ends[i] - starts[i] <= step:
            iou = _overlaps(p[:, starts[i]:ends[j - 1]], g, area)
            totals[i:j] = np.maximum.reduceat(iou, starts[i:j] - starts[i], axis=0) @ weights
        i = j
    return probes.iloc[starts].assign(__total=totals)


def _overlaps(p: np.ndarray, g: np.ndarray, area: np.ndarray) -> np.ndarray:
    both = np.maximum(np.minimum(p[2], g[2]) - np.maximum(p[0], g[0]), 0.0) * np.maximum(
        np.minimum(p[3], g[3]) - np.maximum(p[1], g[1]), 0.0)
    union = (p[2] - p[0]) * (p[3] - p[1]) + area - both
    return np.divide(both, union, out=np.zeros_like(both), where=union > 0)


def mean_sibling_box_overlap(df: DataFrame, keys: Sequence[str], row_id: str, boxes: str) -> DataFrame:
    """Mean recall of siblings' boxes by a row's boxes.

    Equal boxes of a group carry one weight, the sum over its rows of their share in the row's boxes. A row's total is the
    sum over these weights of its best overlap with each. A group's boxes lie in grid cells, each in one; a set meets the
    cells it may overlap, in tiles of bounded size that give one sum per set, so no pair of boxes is ever a row. The row's
    own recall is taken off. A null set names no boxes: the row gets 0 and is nobody's sibling. An unusable box (not
    four finite numbers) makes its row's boxes unrecallable (0) and is passed over on the recalling side. A row with no
    sibling that has boxes gets 0, a lone row 1. Repeated rows are rows of their own; boxes without area overlap nothing.
    """
    keys = list(keys)
    # A negative zero is a zero here, so that equal boxes are one.
    plain = F.transform(F.col(boxes).cast("array<array<double>>"), lambda b: F.transform(b, lambda v: v + F.lit(0.0)))
    rows = cut_lineage(df.select(*keys, row_id, plain.alias("__b")))
    digest = F.sha2(F.to_json("__b"), 256)
    usable = F.filter("__b", _usable)
    sets = rows.filter(F.col("__b").isNotNull()).groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__m"))
    sets = sets.select(*keys, "__m", digest.alias("__set"), usable.alias("__p"), F.size("__b").alias("__n")).withColumn(
        "__whole", (F.col("__n") > 0) & (F.size("__p") == F.col("__n")))
    sets = cut_lineage(sets.withColumn("__own", F.when(F.col("__whole"), best_recall(F.col("__p"), F.col("__p"))).otherwise(F.lit(0.0))))

    box = F.col("__box")
    flat = lambda c: sets.select(*keys, "__set", "__m", "__n", "__whole", F.explode(c).alias("__box")).filter(
        (box[2] > box[0]) & (box[3] > box[1]))
    side = F.greatest(box[2] - box[0], box[3] - box[1])
    extent = F.greatest(F.max(box[2]) - F.min(box[0]), F.max(box[3]) - F.min(box[1]))
    grid = flat("__p").groupBy(*keys).agg(
        F.when(F.count(F.lit(1)) <= SMALL, 2 * extent).otherwise(F.greatest(F.least(F.max(side), 4 * F.avg(side)), extent / GRID))
        .alias("__cell"), F.max(side).alias("__side"), F.min(box[0]).alias("__x0"), F.min(box[1]).alias("__y0"),
        (F.count(F.lit(1)) <= SMALL).alias("__small"))
    grid = cut_lineage(grid.withColumn("__levels", _level(F.col("__side"))).drop("__side"))
    gold = attach_stats(flat("__p").filter("__whole").groupBy(*keys, "__box").agg(F.sum(F.col("__m") / F.col("__n")).alias("__w")),
                        grid, keys)
    lower = lambda i, lo: F.floor((box[i] - F.col(lo)) / (F.col("__cell") * F.pow(F.lit(2.0), F.col("__l")))).cast("int")
    gold = gold.withColumn("__l", _level(side)).withColumn("__cx", lower(0, "__x0")).withColumn("__cy", lower(1, "__y0"))
    probes = attach_stats(flat(F.array_distinct("__p")), grid, keys).withColumn("__c", F.explode(_cells(box)))
    probes = probes.select(*keys, "__small", "__set", "__box", F.col("__c.l").alias("__l"), F.col("__c.x").alias("__cx"),
                           F.col("__c.y").alias("__cy"))

    # A small group is one tile. Otherwise a cell has tiles of its boxes times blocks of its sets.
    at = [*keys, "__l", "__cx", "__cy"]
    no_set, no_weight = F.lit(None).cast("string").alias("__set"), F.lit(None).cast("double").alias("__w")
    one = [F.lit(0).alias("__t"), F.lit(0).alias("__k")]
    shape = [*at, "__t", "__k", "__set", "__w", *[box[i].alias(f"__{n}") for i, n in enumerate(("x1", "y1", "x2", "y2"))]]
    few = gold.filter("__small").select("*", no_set, *one).select(shape).unionByName(
        probes.filter("__small").select("*", no_weight, *one).select(shape))
    large, asking = gold.filter("not __small"), probes.filter("not __small")
    count = lambda d, n: d.groupBy(*at).agg(F.ceil(F.count(F.lit(1)) / BOXES).cast("int").alias(n))
    tiles = null_safe_join(count(large, "__ts"), count(asking, "__ks"), at)
    tile = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    many = null_safe_join(large, tiles, at).select("*", no_set, tile("__box", "__ts").alias("__t"), every("__ks").alias(
        "__k")).select(shape).unionByName(null_safe_join(asking, tiles, at).select(
            "*", no_weight, every("__ts").alias("__t"), tile("__set", "__ks").alias("__k")).select(shape))
    columns = StructType([*[df.schema[k] for k in keys], StructField("__set", StringType()), StructField("__total", DoubleType())])
    best = few.unionByName(many).groupBy(*at, "__t", "__k").applyInPandas(lambda f: _tile_sums(f)[columns.names], columns)
    totals = best.groupBy(*keys, "__set").agg(F.sum("__total").alias("__total"))
    totals = null_safe_join(sets.select(*keys, "__set", "__own"), totals, [*keys, "__set"], "left")

    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"), F.count("__b").alias("__with"))
    out = null_safe_join(rows.select(*keys, row_id, digest.alias("__set")), totals, [*keys, "__set"], "left")
    out = attach_stats(out, counts, keys)
    others = F.col("__with") - 1
    mean = F.greatest(F.lit(0.0), F.coalesce(F.col("__total"), F.lit(0.0)) - F.col("__own")) / others
    return out.select(*keys, row_id, F.when(F.col("__rows") == 1, F.lit(1.0)).when(
        F.col("__own").isNull() | (others <= 0), F.lit(0.0)).otherwise(mean).alias("evidence"))


def sibling_evidence(df: DataFrame, keys: Sequence[str], row_id: str, words: str, boxes: str) -> DataFrame:
    """Evidence agreement with siblings: boxes where a group gives any, words otherwise; `method` names which."""
    keys = list(keys)
    rows = cut_lineage(with_group_stats(df.select(*keys, row_id, words, boxes), keys, {"__given": F.count(boxes)}))
    seen = mean_sibling_box_overlap(rows.filter("__given > 0"), keys, row_id, boxes)
    said = mean_sibling_evidence(rows.filter("__given = 0"), keys, row_id, words)
    return seen.withColumn("method", F.lit("boxes")).unionByName(said.withColumn("method", F.lit("words")))


# Fixed values: (similarity at least, penalty) bands and the word-overlap penalty of repeated clues.
SIMILARITY_BANDS = ((0.7, 0.8), (0.5, 0.4), (0.3, 0.2))
OVERLAP_AT, OVERLAP_PENALTY = 0.6, 0.5


def clue_repetition(df: DataFrame, game: str, pos: str, text: str) -> DataFrame:
    """Penalty of each clue against every earlier clue of its game."""
    from rollscope.functions.text import edit_ratio, let

    words = F.array_distinct(F.filter(F.split(F.lower(F.col(text)), r"\s+"), lambda w: w != ""))
    src = df.select(game, pos, F.lower(F.trim(F.col(text))).alias("__t"), words.alias("__w"))

    def penalty(me: Column, m: Column) -> Column:
        def banded(sim: Column) -> Column:
            out = F.lit(0.0)
            for at, cost in reversed(SIMILARITY_BANDS):
                out = F.when(sim >= at, F.lit(cost)).otherwise(out)
            return out
        similar = let(F.round(edit_ratio(me["__t"], m["__t"]), 12), banded)
        shared = F.when(F.round(overlap(me["__w"], m["__w"]), 12) >= OVERLAP_AT, F.lit(OVERLAP_PENALTY)).otherwise(
            F.lit(0.0))
        return F.when((m["id"] < me["id"]) & (me["__t"] != "") & (m["__t"] != ""), similar + shared).otherwise(
            F.lit(0.0))

    return fold_siblings(src, [game], pos, ["__t", "__w"], {"penalty": penalty})
