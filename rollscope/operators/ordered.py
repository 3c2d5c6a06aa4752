"""Recursive prefixes in order: exponential baselines and a two-stage switch.

Both cut the ordered rows of a key into short chunks, solve every chunk in parallel and carry only a
small state between chunks, so a key of any size is spread over many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollscope.operators import skew
from rollscope.session import cut_lineage

CHUNK = 512


# Chunk ends that still weigh on a later chunk are added one by one while they are this few; beyond that they are a
# recurrence of their own, solved in chunks again.
REACH = 64
# Powers of ten a double spans below one.
DIGITS = 320.0


def _recurrence(rows: DataFrame, keys: Sequence[str], position: str, names: Sequence[str], a: float, chunk: int) -> DataFrame:
    """Replace x by y in every column, y_n = a * y_(n-1) + x_n per key in order of the 0-based position, 0 < a < 1.

    Inside a chunk y is a scaled running sum. Chunk ends follow the same recurrence with a ** chunk; what the previous
    chunk's end is worth is added by an equi-join on the chunk number.
    """
    chunk = max(1, min(chunk, int(250 / -math.log10(a))))
    w = Window.partitionBy(*keys, "__chunk").orderBy("__p").rowsBetween(Window.unboundedPreceding, 0)
    weight = F.lit(a)
    cut = rows.withColumn("__chunk", F.floor(F.col(position) / chunk)).withColumn("__p", F.col(position) % chunk)
    local = cut.withColumns({n: F.pow(weight, F.col("__p")) * F.sum(F.col(n) * F.pow(weight, -F.col("__p"))).over(w) for n in names})
    ends = local.groupBy(*keys, "__chunk").agg(*[F.max_by(n, "__p").alias(n) for n in names])
    reach = math.ceil(DIGITS / (-math.log10(a) * chunk))
    if reach > REACH:
        whole = _recurrence(ends.withColumnRenamed("__chunk", "__at"), keys, "__at", names, a ** chunk, chunk)
        carry = whole.select(*keys, (F.col("__at") + 1).alias("__chunk"), *[F.col(n).alias(f"__c_{n}") for n in names])
    else:
        shifted = ends.select(*keys, F.explode(F.sequence(F.lit(1), F.lit(reach))).alias("__j"), "__chunk", *names)
        carry = shifted.select(
            *keys, (F.col("__chunk") + F.col("__j")).alias("__chunk"),
            *[(F.col(n) * F.pow(weight, (F.col("__j") - 1) * chunk)).alias(n) for n in names]
        ).groupBy(*keys, "__chunk").agg(*[F.sum(n).alias(f"__c_{n}") for n in names])
    joined = skew.null_safe_join(local, carry, [*keys, "__chunk"], "left")
    decay = F.pow(weight, F.col("__p") + 1)
    return joined.withColumns({n: F.col(n) + decay * F.coalesce(F.col(f"__c_{n}"), F.lit(0.0)) for n in names}).select(*rows.columns)


def ema(df: DataFrame, keys: Sequence[str], order: Sequence[Column], values: Mapping[str, str],
        alpha: float, init: float = 0.0, chunk: int = CHUNK, position: str | None = None) -> DataFrame:
    """Add b_n = alpha * b_(n-1) + (1 - alpha) * x_n per key, for each output name -> input column, 0 <= alpha <= 1.

    `position` names an optional output column with the row's place in its key.
    """
    keys, a = list(keys), float(alpha)
    rows = skew.number_rows_by_key(df, keys, order, "__rn")
    x = lambda col: (1 - a) * F.col(col)
    if a in (0.0, 1.0):
        out = rows.select(*df.columns, "__rn", *[(x(c) if a == 0.0 else F.lit(float(init))).cast("double").alias(n) for n, c in values.items()])
    else:
        fed = rows.select(*df.columns, "__rn", (F.col("__rn") - 1).alias("__n"), *[x(c).cast("double").alias(f"__y_{n}") for n, c in values.items()])
        solved = _recurrence(fed, keys, "__n", [f"__y_{n}" for n in values], a, chunk)
        out = solved.select(*df.columns, "__rn", *[
            (F.col(f"__y_{n}") + F.pow(F.lit(a), F.col("__rn")) * F.lit(float(init))).alias(n) for n in values])
    return out.withColumnRenamed("__rn", position) if position else out.drop("__rn")


def stage_switch(steps: DataFrame, run: str, step: str, *, rho: float = 0.95, acc_up: float = 0.9,
                 err_up: float = 0.4, na_up: float = 0.5, na_down: float = 0.1, min_dwell: int = 5,
                 patience: int | None = 20) -> DataFrame:
    """Two-stage switching per run over smoothed accuracy and n/a rate, one row per step in.

    State is (stage, dwell); the dwell counter never needs to exceed the larger limit, so a chunk of
    steps is a small table from entry state to exit state.
    """
    smooth = ema(steps, [run], [F.col(step).asc()], {"acc_bar": "acc", "na_bar": "na"}, rho,
                 position="__rn")
    limit = max(min_dwell, patience or 0)
    width = limit + 1
    flagged = smooth.select(
        run, step, "acc_bar", "na_bar", "__rn", F.floor((F.col("__rn") - 1) / CHUNK).alias("__chunk"),
        ((F.round("acc_bar", 12) >= acc_up) & (F.round("na_bar", 12) <= na_down)).alias("__up"),
        ((F.round(1.0 - F.col("acc_bar"), 12) >= err_up) | (F.round("na_bar", 12) >= na_up)).alias("__down"))
    chunks = flagged.groupBy(run, "__chunk").agg(F.array_sort(F.collect_list(F.struct(
        F.col("__rn"), F.col(step), F.col("acc_bar"), F.col("na_bar"), F.col("__up"), F.col("__down")))).alias("__s"))

    def next_state(state: Column, s: Column) -> Column:
        """state = stage * width + dwell; returns the state after one step."""
        stage, dwell = F.floor(state / width), F.least(state % width + 1, F.lit(limit))
        trigger = (dwell >= min_dwell) & F.when(stage == 0, s["__up"]).otherwise(s["__down"])
        if patience is not None:
            trigger = trigger | (dwell >= patience)
        return F.when(trigger, (1 - stage) * width).otherwise(stage * width + dwell).cast("bigint")

    entry = F.sequence(F.lit(0).cast("bigint"), F.lit(2 * width - 1).cast("bigint"))
    table = F.transform(entry, lambda s0: F.aggregate("__s", s0, next_state))
    maps = cut_lineage(chunks.select(run, "__chunk", table.alias("__map")))
    begin = _entry_states(maps, run, 2 * width)
    replay0 = F.struct(F.col("__start").alias("at"), F.array().cast("array<bigint>").alias("out"))
    states = F.aggregate("__s", replay0, lambda acc, s: F.struct(
        next_state(acc["at"], s).alias("at"),
        F.array_append(acc["out"], next_state(acc["at"], s)).alias("out")), lambda acc: acc["out"])
    replayed = skew.null_safe_join(chunks, begin, [run, "__chunk"]).select(
        run, F.inline_outer(F.arrays_zip(F.col("__s"), states.alias("__state")))).filter("__state is not null")
    return replayed.select(
        run, F.col("__s")[step].alias(step), F.col("__s")["acc_bar"].alias("acc_bar"),
        F.col("__s")["na_bar"].alias("na_bar"), F.floor(F.col("__state") / width).alias("stage"),
        (F.col("__state") % width == 0).alias("switched"))


def _entry_states(maps: DataFrame, run: str, states: int, start: int = 0) -> DataFrame:
    """State at the start of each chunk, from rows (run, __chunk, __map) with __map[state in] = state out.

    Up to CHUNK maps of a run are composed to one, again and again until a run has one map left; then the states are
    handed down. No row ever holds more than CHUNK maps, and the depth is logarithmic.
    """
    most = maps.agg(F.max("__chunk")).first()[0]
    if not most:
        return maps.select(run, "__chunk", F.lit(start).cast("bigint").alias("__start"))
    packs = cut_lineage(maps.groupBy(run, F.floor(F.col("__chunk") / CHUNK).alias("__pack")).agg(
        F.array_sort(F.collect_list(F.struct("__chunk", "__map"))).alias("__m")))
    same = F.sequence(F.lit(0).cast("bigint"), F.lit(states - 1).cast("bigint"))
    whole = F.transform(same, lambda s0: F.aggregate("__m", s0, lambda s, m: F.get(m["__map"], s.cast("int"))))
    above = _entry_states(packs.select(run, F.col("__pack").alias("__chunk"), whole.alias("__map")), run, states, start)
    given = skew.null_safe_join(packs, above.withColumnRenamed("__chunk", "__pack"), [run, "__pack"])
    zero = F.struct(F.col("__start").alias("at"), F.array().cast("array<struct<chunk:bigint,start:bigint>>").alias("out"))
    handed = F.aggregate("__m", zero, lambda acc, m: F.struct(
        F.get(m["__map"], acc["at"].cast("int")).alias("at"),
        F.array_append(acc["out"], F.struct(m["__chunk"].alias("chunk"), acc["at"].alias("start"))).alias("out")),
        lambda acc: acc["out"])
    return given.select(run, F.inline_outer(handed)).filter("chunk is not null").withColumnsRenamed({"chunk": "__chunk", "start": "__start"})


def cycle_stage(step: Column, length: int) -> Column:
    """Fixed cycle: the first `length` steps decide, the next `length` give clues."""
    return F.when(F.pmod(step, F.lit(2 * length)) < length, F.lit("decision")).otherwise(F.lit("clue"))
