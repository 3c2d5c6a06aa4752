"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies, target / source size. Documents of a source are put
in order of size, their expected copies are prefix-summed, one random offset is added, and a document is emitted once
for each integer boundary that its stretch of the sum crosses. In order of size the words taken miss the target by at
most the size of the source's largest document.

Defined results: null text has size 0; null source is a source of its own, after all others; equal rows are separate
documents, also under one id or none; rows of equal size stand in order of their id, and rows of equal size and id get the
counts of their places in order of a hash of the row; a very long text is one document that crosses its boundaries like
any other; a source without words has target 0; other columns, of any name, come back unchanged; empty tables give empty
results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollscope.llm.common import WORD, maybe_in, stored, with_bit
from rollscope.operators.skew import null_safe_join, number_rows, number_rows_by_key

# Weights of the sources in order of their code points, repeating.
WEIGHTS = (5, 2, 1)


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def offset_of(source: str = "source") -> Column:
    """Random offset in [0, 1) of a source: a hash of its name, so reruns agree."""
    digest = F.md5(F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def source_targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0,
                   weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, target for one row per source (source, source_size).

    A target is min(most * source_size, level * weight). The level is raised until the targets sum to `share` of all
    sizes: each pass is one aggregate over the sources that leaves out those at their limit, until none is above.
    """
    ranked = stored(number_rows(sizes, [F.col("source").asc_nulls_last()], "rn").withColumn(
        "weight", F.element_at(F.array(*[F.lit(w) for w in weights]),
                               ((F.col("rn") - 1) % len(weights) + 1).cast("int"))), "sources")
    level, before = None, -1
    while True:
        free = F.lit(True) if level is None else ~(F.col("source_size") * most < F.lit(level) * F.col("weight"))
        got = ranked.agg(
            F.sum("source_size").alias("all"), F.count(F.when(free, 1)).alias("n"),
            F.sum(F.when(free, F.col("weight"))).alias("w"),
            F.sum(F.when(~free, F.col("source_size"))).alias("full")).first()
        if not got["n"] or got["n"] == before:
            break
        before = got["n"]
        level = (share * (got["all"] or 0) - most * (got["full"] or 0)) / got["w"]
    limit = F.col("source_size") * F.lit(most)
    target = limit if level is None else F.least(limit, F.lit(float(level)) * F.col("weight"))
    return ranked.select("source", "source_size", target.cast("double").alias("target"))


def mix_plan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
             **targets) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken and at (place in the order) for each document row."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"),
                       word_count(f"`{text}`").alias("size"))
    numbered = number_rows(rows, [F.col("source").asc_nulls_last(), F.col("size"), F.col("doc_id")], "at")
    sums = stored(numbered.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.min("at").alias("first")), "sizes")
    per_source = source_targets(sums.select("source", "source_size"), **targets).alias("t").join(
        sums.select(F.col("source").alias("s2"), "first"), F.col("t.source").eqNullSafe(F.col("s2"))).select(
        F.col("t.source").alias("s"), "source_size", "target", "first", offset_of("s").alias("u"))
    # One row per source, copied for each of 64 parts of the documents, so that a large source is no single key.
    spread = per_source.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(63))))
    joined = numbered.withColumn("part", (F.col("at") % 64).cast("int")).join(
        spread, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("salt")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    k = F.col("at") - F.col("first")
    copies = (F.floor((k + 1) * rate + F.col("u")) - F.floor(k * rate + F.col("u"))).cast("long")
    return joined.withColumn("copies", copies).select(
        "doc_id", "source", "size", "source_size", "target", "copies",
        (F.col("copies") * F.col("size")).alias("taken"), "at")


def mix_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
                  **targets) -> DataFrame:
    """The mix: each document row as often as its own row of the plan says.

    An id that stands on one row finds its count by the id, where the row is: its bits stand in two bitmaps, one of the ids that
    have the bit and one of the ids that the first names wrongly. Only rows that both name are joined with the plan, so texts
    are not shuffled. Rows that share an id (or have none) are paired with the plan's rows of the same id, source and size by
    position, in order of a hash of the row, so no row is taken for another.
    """
    plan = stored(mix_plan(docs, doc_id, text, source, **targets).select("doc_id", "source", "size", "copies", "at"), "mix-plan")
    # Stored, so that the joins below know their size before any document is shuffled.
    rows = stored(plan.groupBy("doc_id").agg(F.count(F.lit(1)).alias("__rows"), F.max("copies").alias("__copies")), "mix-rows")
    ident = F.col(f"`{doc_id}`")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    shared = rows.filter(F.col("__rows") > 1).select(F.col("doc_id").alias("__id"))
    some_shared = not shared.isEmpty()
    own = rows.filter("__rows = 1").select("doc_id", "__copies", F.xxhash64("doc_id").alias("__name"))
    most = own.agg(F.max("__copies")).first()[0] or 0
    # Both the documents and the plan's rows are judged by the same bitmaps: `sure` rows have their count in `__copies`.
    bits = []
    for k in range(most.bit_length()):
        has = F.shiftright("__copies", k).bitwiseAND(1) == 1
        named = own.filter(has).select("__name")
        wrong = stored(maybe_in(own.filter(~has), F.col("__name"), named).select("__name"), "mix-wrong")
        bits.append((named, wrong))

    def judged(df: DataFrame) -> DataFrame:
        sure, copies = F.lit(True), F.lit(0)
        for k, (named, wrong) in enumerate(bits):
            df = with_bit(with_bit(df, F.col("__name"), named, f"__named{k}"), F.col("__name"), wrong, f"__wrong{k}", seed=5)
            sure = sure & ~(F.col(f"__named{k}") & F.col(f"__wrong{k}"))
            copies = copies + F.when(F.col(f"__named{k}"), F.lit(1 << k)).otherwise(F.lit(0))
        if some_shared:
            df = with_bit(df, F.col("__name"), shared.select(F.xxhash64("__id").alias("__name")), "__several")
            sure = sure & ~F.col("__several")
        return df.withColumn("__sure", sure).withColumn("__found", copies.cast("long"))

    seen = judged(docs.select(whole.alias("__row"), ident.alias("__key"), F.xxhash64(ident).alias("__name")))
    taken = seen.filter("__sure and __found > 0").select("__row", F.col("__found").alias("__copies"))
    unsure = stored(judged(own).filter("not __sure").filter("__copies > 0").select(F.col("doc_id").alias("__id"), "__copies"), "mix-unsure")
    if not unsure.isEmpty():
        taken = taken.unionByName(seen.filter("not __sure").join(unsure, F.col("__key").eqNullSafe(F.col("__id"))).select("__row", "__copies"))
    if some_shared:
        key = ["__id", "__source", "__size"]
        placed = number_rows_by_key(
            plan.join(shared, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi").select(
                F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size"), "at", "copies"),
            key, [F.col("at")], "__rn")
        several = docs.select(
            whole.alias("__row"), ident.alias("__id"), F.col(f"`{source}`").alias("__source"), word_count(f"`{text}`").alias("__size"),
            F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("__hash"))
        # Only documents whose id may be shared are shuffled again; a semi join would be moved in front of that filter.
        several = maybe_in(several, F.xxhash64("__id"), shared.select(F.xxhash64("__id").alias("__name")))
        several = several.join(shared.select(F.col("__id").alias("__shared")), F.col("__id").eqNullSafe(F.col("__shared"))).drop("__shared")
        several = number_rows_by_key(several, key, [F.col("__hash")], "__rn")
        paired = null_safe_join(several, placed.select(*key, "__rn", F.col("copies").alias("__copies")), [*key, "__rn"]).filter("__copies > 0")
        taken = taken.unionByName(paired.select("__row", "__copies"))
    return taken.select("__row", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))).alias("__copy")).select(
        *[F.col("__row")[c].alias(c) for c in docs.columns])
