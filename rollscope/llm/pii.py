"""Personal data: candidate spans, gradient-boosted trees over format and context, calibrated thresholds.

Strict patterns with checks (digits, Luhn, octets) find the base spans, which always stay. Wider, high-recall generators
propose further spans of the same kinds: obfuscated addresses, other separators, numbers without a prefix. Boosted
trees score them on their format and context; a span is added if its score reaches its kind's threshold, the lowest one
that kept `PRECISION` on held-out rows and is not below
`LEAST_SCORE`.

The trees learn from at most `SAMPLE` strict matches per kind, passed or failed (a documented bound), from copies of
them in wider formats, and from copies with changed digits. Everything is DataFrame operations: patterns, features,
MLlib's trees, thresholds. Texts are read whole, and no join carries them.

Defined results: null text is empty; documents without candidates have zero counts and the digest of an empty text;
without both kinds of training rows nothing is added; equal rows get equal spans; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollscope.llm.common import stored

KINDS = ("email", "ip", "card", "phone")
# The base patterns. Possessive repeats and look-behinds change no match, they only keep the search linear.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# High-recall generators.
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?:\x20?(?:@|\(at\)|\[at\]|\{at\})\x20?|\x20at\x20)[A-Za-z0-9-]{1,63}+"
             r"(?:(?:\x20?(?:\(dot\)|\[dot\]|\{dot\})\x20?|\x20dot\x20|\.)[A-Za-z0-9-]{1,63}+){1,8}+",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?:\x20?(?:\.|\[\.\]|\(\.\))\x20?[0-9]{1,3}+){3}+(?![0-9.])",
    "card": r"(?<![0-9])[0-9](?:[\x20./_-]{0,2}[0-9]){13,18}+(?![0-9])",
    "phone": r"(?<![0-9+.])(?:\+|00)?\(?[0-9]{1,4}+\)?(?:[\x20./-]{1,2}\(?[0-9]{2,5}+\)?){1,5}+(?![0-9])",
}
SAMPLE = 3000
PRECISION, LEAST_SCORE = 0.995, 0.7
CONTEXT = 24
# Words that point to a kind, in front of it.
HINTS = {"email": "mail|contact|write|@", "ip": r"\bip\b|host|server|addr", "card": "card|visa|amex|pay|credit",
         "phone": "tel|phone|call|fax|mobile|sms|whatsapp"}


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a digit string of 14 to 19 digits passes the Luhn check."""
    at = F.reverse(number)
    total = F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), lambda acc, i: acc + (
        lambda d: F.when(i % 2 == 1, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d)))(
        F.substring(at, i, F.lit(1)).cast("int")))
    return F.when(F.length(number).between(14, 19), total % 10 == 0).otherwise(F.lit(False))


def octets(value: Column) -> Column:
    """Whether all numbers of a dotted value are at most 255."""
    parts = F.regexp_extract_all(value, F.lit("[0-9]+"), F.lit(0))
    return F.forall(parts, lambda p: F.regexp_like(p, F.lit("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")))


def passes(kind: str, value: Column) -> Column:
    number = digits(value)
    return {"email": F.lit(True), "ip": octets(value), "card": luhn(number),
            "phone": F.length(number).between(10, 15)}[kind]


def matches(text: Column, pattern: str) -> Column:
    """Array of (value, start, end, left, right) of all matches; offsets in code points.

    Offsets are running sums of the lengths of matches and of the pieces between them, added up in blocks of 128, so a
    text with very many matches costs no quadratic copying.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    steps = F.transform(found, lambda v, i: F.struct(
        v.alias("v"), F.length(F.get(pieces, i)).alias("gap"), F.right(F.get(pieces, i), F.lit(CONTEXT)).alias("left"),
        F.left(F.get(pieces, i + 1), F.lit(CONTEXT)).alias("right")))
    size = 128
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / size).cast("int")),
                         lambda b: F.slice(steps, b * size + 1, F.lit(size)))
    total = F.transform(blocks, lambda s: F.aggregate(s, F.lit(0), lambda a, x: a + x["gap"] + F.length(x["v"])))
    first = F.aggregate(total, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda a, n: F.struct(
        (a["at"] + n).alias("at"), F.array_append(a["out"], a["at"]).alias("out")))["out"]
    row = "array<struct<value:string,start:int,end:int,left:string,right:string>>"
    inside = F.zip_with(blocks, first, lambda s, at: F.aggregate(
        s, F.struct(at.alias("at"), F.array().cast(row).alias("out")), lambda a, x: F.struct(
            (a["at"] + x["gap"] + F.length(x["v"])).alias("at"),
            F.array_append(a["out"], F.struct(
                x["v"].alias("value"), (a["at"] + x["gap"]).alias("start"),
                (a["at"] + x["gap"] + F.length(x["v"])).alias("end"), x["left"].alias("left"), x["right"].alias("right"),
            )).alias("out")))["out"])
    return F.when(F.size(found) > 0, F.flatten(inside)).otherwise(F.array().cast(row))


def _candidates(rows: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """One row per match: doc_id, row, kind, value, start, end, left, right."""
    likely = rows.filter(F.regexp_like("text", F.lit(r"[0-9@]|[(\[{](?:at|dot)| at ")))
    out = None
    for kind, pattern in patterns.items():
        own = likely.select("doc_id", "row", F.lit(kind).alias("kind"), F.explode(matches(F.col("text"), pattern)).alias("m")).select(
            "doc_id", "row", "kind", "m.*")
        out = own if out is None else out.union(own)
    return out


FEATURES = ("is_email", "is_ip", "is_card", "is_phone", "n_digits", "n_chars", "n_groups", "longest_group", "luhn_ok",
            "octets_ok", "prefix", "top_level", "marks", "hint", "apart_left", "apart_right")


def features(rows: DataFrame) -> DataFrame:
    """Format and context of candidates, as one vector."""
    v, number = F.col("value"), digits(F.col("value"))
    groups = F.regexp_extract_all(v, F.lit("[0-9]+"), F.lit(0))
    hint = F.lit(False)
    for kind, words in HINTS.items():
        hint = hint | ((F.col("kind") == kind) & F.regexp_like(F.lower("left"), F.lit(words)))
    short = F.length(v) <= 200
    cols = {
        **{f"is_{k}": F.col("kind") == k for k in KINDS},
        "n_digits": F.least(F.length(number), F.lit(40)), "n_chars": F.least(F.length(v), F.lit(200)),
        "n_groups": F.least(F.size(groups), F.lit(40)),
        "longest_group": F.least(F.coalesce(F.array_max(F.transform(groups, F.length)), F.lit(0)), F.lit(40)),
        "luhn_ok": short & luhn(number), "octets_ok": short & octets(v) & (F.size(groups) == 4),
        "prefix": F.regexp_like(v, F.lit(r"^(?:\+|00)")),
        "top_level": F.regexp_like(v, F.lit(r"(?:\.|dot[)\]}]?\x20?)[A-Za-z]{2,12}$")),
        "marks": F.length(F.regexp_replace(v, "[A-Za-z0-9]", "")),
        "hint": hint,
        "apart_left": (F.col("left") == "") | F.regexp_like("left", F.lit(r"[\s(\[<:;,\"']$")),
        "apart_right": (F.col("right") == "") | F.regexp_like("right", F.lit(r"^[\s)\]>:;,.!?\"']")),
    }
    named = rows.select("*", *[F.coalesce(cols[c].cast("double"), F.lit(0.0)).alias(c) for c in FEATURES])
    return VectorAssembler(inputCols=list(FEATURES), outputCol="vector").transform(named).drop(*FEATURES)


def _training_rows(rows: DataFrame, sample: int) -> DataFrame:
    """Labelled candidates: strict matches, the same in wider formats, and the same with changed digits.

    A phone number without a prefix counts as one only behind a word that points to it.
    """
    strict = _candidates(rows, BASE)
    # The least hashes of each kind: every task keeps at most `sample` rows of them.
    parts = [strict.filter(F.col("kind") == k).orderBy(F.xxhash64("doc_id", "row", "start"), "start").limit(sample) for k in KINDS]
    base = parts[0]
    for p in parts[1:]:
        base = base.union(p)
    base = stored(base, "pii-sample")
    v = F.col("value")
    wider = F.when(F.col("kind") == "email", F.regexp_replace(F.regexp_replace(v, "@", " (at) "), r"\.", " (dot) ")).when(
        F.col("kind") == "ip", F.regexp_replace(v, r"\.", "[.]")).when(
        F.col("kind") == "card", F.regexp_replace(digits(v), "(.{4})(?=.)", "$1.")).otherwise(
        F.regexp_replace(v, r"^\+", "00"))
    changed = F.when(F.col("kind") == "email", F.regexp_replace(v, "@.*$", " at night dot 9")).when(
        F.col("kind") == "ip", F.regexp_replace(v, r"^[0-9]+\.", "777.")).when(
        F.col("kind") == "card", F.translate(v, "0123456789", "1234567890")).otherwise(F.regexp_replace(v, "[0-9]{4}$", ""))
    bare = base.filter(F.col("kind") == "phone").withColumn("value", F.regexp_replace(v, r"^\+[0-9]{1,2}[\x20-]?", ""))
    every = base.union(base.withColumn("value", wider)).union(base.withColumn("value", changed)).withColumn("bare", F.lit(False))
    for left in ("and then ", "please call "):
        for longer in ("", " 41", " 12 34"):
            every = every.union(bare.withColumn("value", F.concat(v, F.lit(longer))).withColumn("left", F.lit(left)).withColumn(
                "bare", F.lit(True)))
    valid = F.lit(False)
    for kind in KINDS:
        check = F.regexp_like(v, F.lit(r"[A-Za-z]{2,}[)\]}]?$")) if kind == "email" else passes(kind, v)
        valid = valid | ((F.col("kind") == kind) & check)
    named = F.col("left").contains("call")
    return every.withColumn("label", F.when(F.col("bare"), named & valid).otherwise(valid).cast("double"))


class Detector:
    """Trees and thresholds per kind."""

    def __init__(self, model: GBTClassificationModel | None, thresholds: dict[str, float]) -> None:
        self.model, self.thresholds = model, thresholds

    def scored(self, rows: DataFrame) -> DataFrame:
        return self.model.transform(features(rows)).withColumn("score", vector_to_array("probability")[1])


def learn(rows: DataFrame, sample: int = SAMPLE, precision: float = PRECISION) -> Detector:
    """Fit the trees on two thirds of the training rows and calibrate the thresholds on the rest."""
    train = stored(features(_training_rows(rows, sample)).withColumn(
        "held", F.pmod(F.xxhash64("row", "start", "kind"), F.lit(3)) == 0), "pii-train")
    kinds = train.filter(~F.col("held")).agg(F.count_distinct("label")).first()[0]
    if kinds < 2:
        return Detector(None, {})
    model = GBTClassifier(featuresCol="vector", labelCol="label", maxIter=12, maxDepth=4, stepSize=0.3, seed=11,
                          minInstancesPerNode=5).fit(train.filter(~F.col("held")))
    out = Detector(model, {})
    held = model.transform(train.filter("held")).select(
        "kind", "label", F.floor(vector_to_array("probability")[1] * 100).cast("int").alias("bin"))
    # At most 101 bins for each of the four kinds.
    bins = held.groupBy("kind", "bin").agg(F.sum("label").alias("right"), F.count("*").alias("n")).collect()
    for kind in KINDS:
        right = n = 0.0
        for b in sorted((r for r in bins if r["kind"] == kind), key=lambda r: -r["bin"]):
            right, n = right + b["right"], n + b["n"]
            if right < precision * n or b["bin"] < 100 * LEAST_SCORE:
                break
            out.thresholds[kind] = b["bin"] / 100
    return out


def joined_spans(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), F.array_position(F.array(*[F.lit(k) for k in KINDS]), s["kind"]).alias("k"),
        s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find_personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE,
                       precision: float = PRECISION) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base, added (arrays of spans) of each document row."""
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows = rows.withColumn("row", F.xxhash64("doc_id", "text"))
    span = "array<struct<kind:string,start:int,end:int>>"
    likely = F.regexp_like("text", F.lit("[0-9]|@"))

    def strict(kind: str) -> Column:
        good = F.filter(matches(F.col("text"), BASE[kind]), lambda m: passes(kind, m["value"]))
        return F.transform(good, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end")))

    empty = F.array().cast(span)
    found = rows.select("doc_id", "row", *[F.when(likely, strict(k)).otherwise(empty).alias(k) for k in KINDS])
    detector = learn(rows, sample, precision)
    if detector.thresholds:
        limit = F.element_at(F.create_map(*[x for k, t in detector.thresholds.items() for x in (F.lit(k), F.lit(t))]), F.col("kind"))
        extra = detector.scored(_candidates(rows, WIDE)).filter(F.col("score") >= limit).groupBy(
            F.col("doc_id").alias("e_id"), F.col("row").alias("e_row")).agg(
            F.collect_set(F.struct("kind", "start", "end")).alias("extra"))
        found = found.join(extra, (F.col("row") == F.col("e_row")) & F.col("doc_id").eqNullSafe(F.col("e_id")), "left")
    else:
        found = found.withColumn("extra", F.lit(None).cast(span))
    base = F.concat(*KINDS)
    # What overlaps a base span of its kind is that span in other words.
    added = F.filter(F.coalesce("extra", empty), lambda e: ~F.exists(base, lambda b: (b["kind"] == e["kind"]) & (
        b["start"] < e["end"]) & (e["start"] < b["end"])))
    return found.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], base.alias("base"), added.alias("added"))


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, text of each document row with every span replaced by its kind in brackets. Ids must be unique."""
    found = find_personal_data(docs, doc_id, text, **options)
    spans = found.select(F.col("doc_id").alias("f_id"), F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))).alias("spans"))
    body = F.coalesce(F.col("text"), F.lit(""))
    step = F.aggregate("spans", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), lambda a, s: F.when(
        s["start"] < a["at"], F.struct(a["out"].alias("out"), F.greatest(a["at"], s["end"]).alias("at"))).otherwise(F.struct(
            F.concat(a["out"], F.substring(body, a["at"] + 1, s["start"] - a["at"]), F.lit("["), s["kind"], F.lit("]")).alias("out"),
            s["end"].alias("at"))))
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    joined = rows.join(spans, F.col("doc_id").eqNullSafe(F.col("f_id"))).withColumn("step", step)
    return joined.select("doc_id", F.concat(F.col("step.out"), F.substring(body, F.col("step.at") + 1, F.length(body))).alias("text"))
