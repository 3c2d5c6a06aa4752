"""Columns for visual-change facts: (attribute, before, after) triples and their multiset scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollscope.functions.text import let

# Attributes in order, their domains, their visibility and the difficulty cuts.
ATTRIBUTES = ("color", "shape", "size", "material")
COLORS = ("gray", "red", "blue", "green", "yellow", "purple", "brown", "cyan")
SHAPES = ("cube", "sphere", "cylinder")
SIZES = ("small", "large")
MATERIALS = ("rubber", "metal")
DOMAINS = {"color": COLORS, "shape": SHAPES, "size": SIZES, "material": MATERIALS}
SALIENCE = {"color": 1.0, "shape": 0.8, "size": 0.55, "material": 0.35}
HARD_BELOW, MEDIUM_BELOW = 0.35, 0.6

# Claim grammar.
CLAIM = r"(?is)<change>(.*?)</change>"
CLAIM_OPEN = r"(?i)<change\b[^>]*>"
CLAIM_CLOSE = r"(?i)</change\s*>"
CLAIM_BODY = (r"(?i)^\s*(color|shape|size|material)\s*:\s*([a-z][a-z0-9_-]*)\s*->\s*([a-z][a-z0-9_-]*)\s*\z")


def in_domain(attribute: Column, value: Column) -> Column:
    out = F.lit(False)
    for name, values in DOMAINS.items():
        out = out | ((attribute == name) & value.isin(*values))
    return out


def fact(attribute: Column, before: Column, after: Column) -> Column:
    """Fact struct when both values belong to the attribute and differ, else null."""
    ok = (before != after) & in_domain(attribute, before) & in_domain(attribute, after)
    return F.when(ok, F.struct(attribute.alias("attribute"), before.alias("before"), after.alias("after")))


def change_claims(text: Column) -> Column:
    """Struct of valid claimed facts and the number of invalid claims of a completion.

    Claims inside the thinking, reaching past the answer, malformed or unbalanced are invalid.
    """
    t = F.coalesce(text, F.lit(""))
    think_end = F.instr(t, F.lit("</think>"))
    answer_at = F.instr(t, F.lit("<answer>"))
    tags = F.regexp_extract_all(t, F.lit(CLAIM), 0)

    def located(found: Column) -> Column:
        start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<at:int,tag:string>>").alias("out"))

        def step(acc: Column, tag: Column) -> Column:
            at = F.call_function("locate", tag, t, acc["at"])
            return F.struct((at + F.length(tag)).alias("at"), F.array_append(
                acc["out"], F.struct(at.alias("at"), tag.alias("tag"))).alias("out"))
        return F.aggregate(found, start, step, lambda acc: acc["out"])

    def parsed(m: Column) -> Column:
        body = F.regexp_extract(m["tag"], CLAIM, 1)
        inside = (think_end > 0) & (m["at"] < think_end + 8)
        late = (answer_at > 0) & (m["at"] + F.length(m["tag"]) > answer_at)
        parts = [F.lower(F.regexp_extract(body, CLAIM_BODY, i)) for i in (1, 2, 3)]
        return F.when(~inside & ~late, fact(*parts))

    def summary(facts: Column) -> Column:
        valid = F.array_compact(facts)
        loose = (F.greatest(F.regexp_count(t, F.lit(CLAIM_OPEN)) - F.size(facts), F.lit(0))
                 + F.greatest(F.regexp_count(t, F.lit(CLAIM_CLOSE)) - F.size(facts), F.lit(0)))
        return F.struct(valid.alias("facts"), (F.size(facts) - F.size(valid) + loose).alias("invalid"))

    return let(F.transform(located(tags), parsed), summary)


def multiset_overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays."""
    count = lambda arr, x: F.size(F.filter(arr, lambda y: y == x))
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda s, x: s + F.least(count(a, x), count(b, x)))


def fact_scores(true_positive: Column, predicted: Column, gold: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1; invalid claims are part of `predicted`; no gold scores 0."""
    precision = F.when(predicted > 0, true_positive / predicted).otherwise(F.lit(0.0))
    recall = F.when(gold > 0, true_positive / gold).otherwise(F.lit(0.0))
    f1 = F.when((gold > 0) & (predicted + gold > 0), 2 * true_positive / (predicted + gold)).otherwise(F.lit(0.0))
    return precision, recall, f1


def object_scale(size: Column, depth: Column) -> Column:
    """Apparent size in [0, 1] from the size word and camera depth."""
    near = F.greatest(F.lit(0.3), F.least(F.lit(1.0), 12.0 / F.greatest(F.coalesce(depth, F.lit(10.0)), F.lit(1e-3))))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(F.lower(size) == "large", 1.0).otherwise(0.6) * near))


def difficulty_score(salience: Column, scale: Column, clutter: Column) -> Column:
    penalty = F.when(clutter > 0, F.greatest(F.lit(0.5), F.least(F.lit(1.0), 8.0 / clutter))).otherwise(F.lit(1.0))
    return salience * (0.5 + 0.5 * scale) * penalty


def difficulty_level(score: Column) -> Column:
    return (F.when(score < HARD_BELOW, F.lit("hard")).when(score < MEDIUM_BELOW, F.lit("medium"))
            .otherwise(F.lit("easy")))
