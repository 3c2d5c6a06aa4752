"""Joins, ranks and running totals that stay balanced when one key holds a large share of all rows.

A window partitioned by a hot key runs in one task. These helpers use partial aggregation, joins that can be split
and range-partitioned prefix passes instead, so no step ever needs a whole group in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollscope.session import cut_lineage

def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where null equals null; the keys come from the left side, once."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    return left.join(renamed, on, how).drop(*[f"__r_{k}" for k in keys])


def attach_stats(df: DataFrame, stats: DataFrame, keys: Sequence[str], size_col: str = "__n") -> DataFrame:
    """Left-join one stats row per key back to the rows; null is a key like any other.

    `size_col` is dropped. The statistics are broadcast if they measure small; otherwise a key with a large share of
    the rows is split by the adaptive skew join, since each of its parts meets the same single row.
    """
    return null_safe_join(df, stats.drop(size_col), list(keys), "left")


def with_group_stats(df: DataFrame, keys: Sequence[str], aggs: Mapping[str, Column]) -> DataFrame:
    """Rows plus per-key aggregates: a partial/final aggregate joined back, not a window."""
    return attach_stats(df, df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()]), keys)


# A rank filter of at most this many rows is applied by every task before the shuffle.
RANK_BEFORE_SHUFFLE = 1000


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int,
                rank: str | None = None) -> DataFrame:
    """First n rows per key.

    Small n: every task cuts to n rows per key before the shuffle. Larger n: positions come from range-partitioned
    blocks, so a key with a large share of all rows is spread over many tasks. `order` decides ties for both.
    """
    if n <= RANK_BEFORE_SHUFFLE:
        out = df.withColumn("__rk", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    else:
        out = number_rows_by_key(df, keys, order, "__rk")
    out = out.filter(F.col("__rk") <= n)
    return out.withColumnRenamed("__rk", rank) if rank else out.drop("__rk")


def top_one(df: DataFrame, keys: Sequence[str], order_key: Column, biggest: bool = True) -> DataFrame:
    """One row per key by a partial max_by / min_by of the whole row."""
    pick = F.max_by if biggest else F.min_by
    cols = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(pick(F.struct(*cols), order_key).alias("__best"))
    return best.select(*keys, *[F.col("__best")[c].alias(c) for c in cols])


def _sorted_blocks(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Globally sorted rows with their block number and position in the block, written out once."""
    spark = df.sparkSession
    blocks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = df.repartitionByRange(blocks, *order).sortWithinPartitions(*order)
    located = ordered.select(
        "*", F.spark_partition_id().alias("__blk"),
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("__pos"))
    # The block borders come from a sample, so both passes below must read one stored copy.
    return cut_lineage(located)


def number_rows(df: DataFrame, order: Sequence[Column], name: str = "rn") -> DataFrame:
    """Global 1-based position in `order` without a single-task window."""
    rows = _sorted_blocks(df, order)
    counts = rows.groupBy("__blk").agg((F.max("__pos") + 1).alias("__cnt"))
    # One row per block: the window below is over the number of partitions, not over the data.
    before = Window.orderBy("__blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__blk", F.coalesce(F.sum("__cnt").over(before), F.lit(0)).alias("__off"))
    return (rows.join(F.broadcast(offsets), "__blk")
            .withColumn(name, F.col("__off") + F.col("__pos") + 1)
            .drop("__blk", "__pos", "__off"))


def number_rows_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column],
                       name: str = "rn") -> DataFrame:
    """1-based position per key, for keys of any size."""
    numbered = number_rows(df, [*[F.col(k).asc_nulls_first() for k in keys], *order], "__g")
    return (with_group_stats(numbered, keys, {"__first": F.min("__g")})
            .withColumn(name, F.col("__g") - F.col("__first") + 1).drop("__g", "__first"))


def running(df: DataFrame, keys: Sequence[str], order: Sequence[Column],
            sums: Mapping[str, Column] | None = None,
            suffix_max: Mapping[str, Column] | None = None) -> DataFrame:
    """Running sums (inclusive, in order) and suffix maxima (this row to the last) per key.

    Three steps: totals inside each sorted block, a carry over the block totals (one row per block
    and key), and their combination.
    """
    sums, suffix_max = dict(sums or {}), dict(suffix_max or {})
    keys = list(keys)
    src = df.select("*", *[c.alias(f"__s_{n}") for n, c in sums.items()],
                    *[c.alias(f"__m_{n}") for n, c in suffix_max.items()])
    rows = _sorted_blocks(src, [*[F.col(k).asc_nulls_first() for k in keys], *order])
    block = Window.partitionBy("__blk", *keys)
    head = block.orderBy("__pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Seen from the end a suffix maximum is a running maximum, which costs one step per row.
    tail = block.orderBy(F.col("__pos").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    part = rows.select(
        "*", *[F.sum(f"__s_{n}").over(head).alias(f"__rs_{n}") for n in sums],
        *[F.max(f"__m_{n}").over(tail).alias(f"__rm_{n}") for n in suffix_max])
    totals = rows.groupBy("__blk", *keys).agg(
        *[F.sum(f"__s_{n}").alias(f"__t_{n}") for n in sums],
        *[F.max(f"__m_{n}").alias(f"__x_{n}") for n in suffix_max])
    before = Window.partitionBy(*keys).orderBy("__blk").rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy(*keys).orderBy(F.col("__blk").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        F.col("__blk"), *keys,
        *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__c_{n}") for n in sums],
        *[F.max(f"__x_{n}").over(behind).alias(f"__d_{n}") for n in suffix_max])
    joined = null_safe_join(part, carry, ["__blk", *keys])
    return joined.select(
        *df.columns,
        *[(F.col(f"__rs_{n}") + F.col(f"__c_{n}")).alias(n) for n in sums],
        *[F.greatest(F.col(f"__rm_{n}"), F.coalesce(F.col(f"__d_{n}"), F.col(f"__rm_{n}"))).alias(n)
          for n in suffix_max])
