"""Reward columns: per-dimension scores, the outcome gate and the scalar."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollscope.functions import text as T

# Reward dimensions and word lists of the structure checks.
DIMENSIONS = ("answer", "budget", "process", "grounding", "consistency")
VISUAL_TERMS = ("color", "colour", "shape", "size", "material", "object", "objects", "red", "blue", "green",
                "yellow", "purple", "cyan", "brown", "gray", "grey", "metal", "metallic", "rubber", "matte",
                "shiny", "sphere", "cube", "cylinder", "large", "small", "left", "right", "front", "behind")
SPY_VISUAL_TERMS = VISUAL_TERMS + ("spheres", "cubes", "cylinders")
COMPARE_TERMS = ("compare", "compared", "comparison", "same", "similar", "match", "matches", "different",
                 "differs", "unlike", "whereas", "while", "but", "majority", "others", "other two", "remaining")
SPY_COMPARE_TERMS = COMPARE_TERMS + ("matching",)
OUTLIER_PATTERN = (r"\b(?:different from|differs from|does not match|doesn't match|not match|unique|outlier|"
                   r"minority|only|stands out)\b")
DERIVE_TERMS = ("therefore", "thus", "so", "hence", "conclude", "conclusion", "must be", "should be", "based on",
                "according to", "indicates", "suggests", "confirm", "confirmed")
SELECT_TERMS = ("therefore", "thus", "so", "hence", "conclude", "select", "choose", "chosen", "answer", "must be",
                "should be", "is the spy")
SHORTCUT_VISUAL = ("color", "shape", "object", "image", "player")
SHORTCUT_COMPARE = ("compare", "same", "match", "different", "whereas", "majority")
GUESS_TERMS = ("i guess", "probably", "maybe", "perhaps", "might be")
REASON_PATTERN = r"\b(?:because|since|as the|due to)\b"
NUMBERED_PATTERN = r"\b(?:player|image|agent)\s*[-#:]*\s*(\d+)\b"
ORDINAL_PATTERN = r"\b(?:first|second|third|1st|2nd|3rd|one|two|three)\b"
SPY_CHOICE_PATTERN = (
    r"\b(?:player|image|agent)\s*[-#:]*\s*\d+\s+(?:is|must be|should be|appears to be|seems to be)\s+(?:the\s+)?spy\b"
    r"|\b(?:spy\s+is|answer\s+is|choose|select)\s+(?:the\s+)?(?:player|image|agent)?\s*[-#:]*\s*\d+\b")
EVIDENCE_WORDS = ("color", "colour", "shape", "size", "material", "object", "red", "blue", "green", "yellow",
                  "purple", "cyan", "brown", "gray", "grey", "sphere", "cube", "cylinder", "metal", "rubber",
                  "large", "small")


@dataclass(frozen=True)
class RewardConfig:
    """Weights, thresholds and component modes; turned into literals when a plan is built."""

    weights: dict[str, float] = field(default_factory=lambda: {
        "answer": 0.6, "grounding": 0.25, "process": 0.05, "consistency": 0.07, "budget": 0.03})
    answer_mode: str = "structured_fields"
    answer_fields: dict[str, float] = field(default_factory=lambda: {"spy": 0.7, "changed_attributes": 0.3})
    off_by_one_credit: float = 0.25
    graded_fields: tuple[str, ...] = ("changed_attributes",)
    format_credit: float = 0.0
    player_id_credit: float = 0.1
    iou_credit: float = 0.9
    match_mode: str = "f1"
    iou_threshold: float = 0.1
    coordinate_mode: str = "auto"
    require_correct_player: bool = False
    warmup_steps: int = 0
    process_mode: str = "legacy"
    verified_weight: float = 0.75
    require_valid_format_for_aux: bool = False
    fallback_tokens: int = 400
    gating_mode: str = "spy"
    gating_floor: float = 0.0
    gated_dims: tuple[str, ...] = ("grounding", "process", "consistency")
    control_mode: str = "none"
    min_grounding: float = 0.2
    min_process: float = 0.4
    min_facts: float = 0.0

    def __post_init__(self) -> None:
        if set(self.weights) != set(DIMENSIONS):
            raise ValueError("weights must name the five dimensions")
        if any(not 0.0 <= w < float("inf") for w in self.weights.values()):
            raise ValueError("weights must be finite and nonnegative")
        allowed = {
            "answer_mode": ("exact_match", "structured_exact_match", "structured_fields"),
            "match_mode": ("recall", "f1"), "coordinate_mode": ("normalized", "pixel", "auto"),
            "process_mode": ("legacy", "visual_facts"), "gating_mode": ("none", "spy", "answer"),
            "control_mode": ("none", "random", "format_only")}
        for name, values in allowed.items():
            if getattr(self, name) not in values:
                raise ValueError(f"{name} must be one of {values}")


def any_term(text: Column, terms: tuple[str, ...]) -> Column:
    """Whether any term occurs; the term list is one constant array, so the plan stays small."""
    words = F.array(*[F.lit(t) for t in terms])
    return T.let(text, lambda t: F.exists(words, lambda w: F.contains(t, w)))


def term_hits(text: Column, terms: tuple[str, ...]) -> Column:
    words = F.array(*[F.lit(t) for t in terms])
    return T.let(text, lambda t: F.size(F.filter(words, lambda w: F.contains(t, w))))


def exact_answer(completion: Column, solution: Column) -> Column:
    said, gold = T.answer_norm(completion), T.answer_norm(solution)
    return ((said == gold) & (gold != "")).cast("double")


def field_credit(pred: Column, gold: Column, off_by_one: float = 0.0) -> Column:
    out = F.when(gold.isNull() | pred.isNull(), F.lit(0.0)).when(pred == gold, F.lit(1.0))
    if off_by_one:
        out = out.when(F.abs(pred - gold) == 1, F.lit(off_by_one))
    return out.otherwise(F.lit(0.0))


def answer_score(spy: Column, count: Column, spy_gold: Column, count_gold: Column, exact: Column,
                 cfg: RewardConfig) -> Column:
    """Answer dimension from parsed fields, per configured mode."""
    if cfg.answer_mode == "exact_match":
        return exact
    if cfg.answer_mode == "structured_exact_match":
        return F.coalesce(((spy == spy_gold) & (count == count_gold)).cast("double"), F.lit(0.0))
    parsed = {"spy": (spy, spy_gold), "changed_attributes": (count, count_gold)}
    total = F.lit(0.0)
    for name, weight in cfg.answer_fields.items():
        pred, gold = parsed[name]
        near = cfg.off_by_one_credit if name in cfg.graded_fields else 0.0
        total = total + F.lit(float(weight)) * field_credit(pred, gold, near)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), total))


def budget_by_steps(steps: Column, budget: Column) -> Column:
    return (F.when(steps <= budget, F.lit(1.0)).when(steps <= budget + 2, F.lit(0.75))
            .when(steps <= budget + 4, F.lit(0.6)).otherwise(F.lit(0.0)))


def budget_by_tokens(words: Column, budget: Column) -> Column:
    over = F.greatest(F.lit(-1.0), 1.0 - 2.0 * (words - budget) / budget)
    return (F.when(words == 0, F.lit(0.0)).when(words <= budget, F.lit(1.0))
            .otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (over + 1.0) / 2.0))))


def budget_score(steps: Column, words: Column, budget_steps: Column, budget_tokens: Column,
                 fallback_tokens: int) -> Column:
    """Step budget first, then token budget, then the fallback token budget."""
    return (F.when(budget_steps.isNotNull(), budget_by_steps(steps, budget_steps))
            .when(budget_tokens.isNotNull(), budget_by_tokens(words, budget_tokens))
            .otherwise(budget_by_tokens(words, F.lit(fallback_tokens))))


def causal_structure(squeezed: Column) -> Column:
    """Share of four checks: visual evidence, comparison, outlier, derivation."""
    def share(r: Column) -> Column:
        checks = [term_hits(r, VISUAL_TERMS) >= 2, any_term(r, COMPARE_TERMS), r.rlike(OUTLIER_PATTERN),
                  any_term(r, DERIVE_TERMS)]
        total = sum((c.cast("int") for c in checks[1:]), checks[0].cast("int"))
        return F.when(r == "", F.lit(0.0)).otherwise(total / 4.0)

    return T.let(squeezed, share)


def shortcut_reasons(squeezed: Column) -> Column:
    def reasons(r: Column) -> Column:
        found = F.array_compact(F.array(
            F.when(T.word_count(r) < 8, F.lit("very_short_reasoning")),
            F.when(~any_term(r, SHORTCUT_VISUAL), F.lit("missing_visual_evidence")),
            F.when(~any_term(r, SHORTCUT_COMPARE), F.lit("missing_comparison")),
            F.when(any_term(r, GUESS_TERMS) & ~r.rlike(REASON_PATTERN), F.lit("guess_without_evidence"))))
        return F.when(r == "", F.array(F.lit("empty_reasoning"))).otherwise(found)

    return T.let(squeezed, reasons)


def shortcut(squeezed: Column) -> Column:
    return T.let(squeezed, lambda r: (r == "") | (F.size(shortcut_reasons(r)) >= 2))


def spy_structure(squeezed: Column) -> Column:
    """Structure score of spot-the-odd-image reasoning, five parts of 0.2."""
    def total(r: Column) -> Column:
        numbered = F.size(F.array_distinct(F.regexp_extract_all(r, F.lit(NUMBERED_PATTERN), 1)))
        ordinal = F.size(F.array_distinct(F.regexp_extract_all(r, F.lit(ORDINAL_PATTERN), 0)))
        named = any_term(r, ("player", "image"))
        visual = T.let(term_hits(r, SPY_VISUAL_TERMS), lambda n: F.when(n >= 2, 0.2).when(n == 1, 0.1).otherwise(0.0))
        spy = F.contains(r, F.lit("spy"))
        chosen = any_term(r, SELECT_TERMS) | r.rlike(SPY_CHOICE_PATTERN)
        score = (
            F.when((numbered >= 2) | (named & (ordinal >= 2)), 0.2).when(named, 0.1).otherwise(0.0)
            + F.when(any_term(r, SPY_COMPARE_TERMS), 0.2).otherwise(0.0)
            + F.when(r.rlike(OUTLIER_PATTERN), 0.2).otherwise(0.0) + visual
            + F.when(spy & chosen, 0.2).when(spy, 0.1).otherwise(0.0))
        return F.when(r == "", F.lit(0.0)).otherwise(F.least(F.lit(1.0), score))

    return T.let(squeezed, total)


def process_score(squeezed: Column, causal: Column, structure: Column, is_shortcut: Column,
                  coverage: Column | None = None, reference_jaccard: Column | None = None,
                  facts: Column | None = None, verified_weight: float = 0.75) -> Column:
    """Process dimension; shortcuts cap at 0.4, verified facts are blended in when given."""
    raw = structure
    if reference_jaccard is not None:
        raw = F.when(reference_jaccard.isNotNull(), F.greatest(reference_jaccard, structure)).otherwise(raw)
    if coverage is not None:
        raw = F.when(coverage.isNotNull(), 0.5 * coverage + 0.3 * causal + 0.2 * structure).otherwise(raw)
    capped = F.when(is_shortcut, F.least(raw, F.lit(0.4))).otherwise(raw)
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), capped))
    score = F.when(squeezed == "", F.lit(0.0)).otherwise(score)
    if facts is not None:
        score = verified_weight * facts + (1.0 - verified_weight) * score
    return score


def grounding_score(num_found: Column, num_valid: Column, overlap: Column, num_gold: Column,
                    players_ok: Column, single_gold_player: Column, cfg: RewardConfig) -> Column:
    """Format, player and overlap credits; invalid tags dilute F1; strict mode needs the right player."""
    iou = overlap
    if cfg.match_mode == "f1":
        iou = F.when(num_found > num_valid, iou * (num_gold + num_valid) / (num_gold + num_found)).otherwise(iou)
    if cfg.require_correct_player:
        iou = F.when(single_gold_player & players_ok, iou).otherwise(F.lit(0.0))
    base = cfg.format_credit + F.when(players_ok, F.lit(cfg.player_id_credit)).otherwise(F.lit(0.0))
    full = F.least(F.lit(1.0), base + cfg.iou_credit * iou)
    return F.when(num_valid == 0, F.lit(0.0)).when(num_gold == 0, base).otherwise(full)


def field_consistency(spy: Column, count: Column, squeezed: Column, num_boxes: Column, all_name_spy: Column,
                      near_dup: Column) -> Column:
    """Hard contradictions zero the score, soft checks are averaged."""
    has = num_boxes > 0
    contradiction = (has & spy.isNotNull() & ~F.coalesce(all_name_spy, F.lit(False))) | (
        has & count.isNotNull() & (num_boxes > count))
    named = F.array_contains(F.transform(
        F.regexp_extract_all(squeezed, F.lit(NUMBERED_PATTERN), 1), lambda d: d.try_cast("bigint")), spy)
    soft = F.array_compact(F.array(
        has.cast("double"), F.when(has, (~near_dup).cast("double")),
        F.when(spy.isNotNull() & (squeezed != ""), named.cast("double"))))
    mean = F.aggregate(soft, F.lit(0.0), lambda s, v: s + v) / F.size(soft)
    return F.when(contradiction, F.lit(0.0)).otherwise(mean)


def scalarize(vector: dict[str, Column], cfg: RewardConfig, spy_correct: Column, answer_correct: Column,
              format_valid: Column, control_key: Column | None = None) -> Column:
    """Weighted sum after the outcome gate; unknown outcomes leave the gate open; zero weights drop out."""
    opened = {"none": F.lit(True), "spy": F.coalesce(spy_correct, F.lit(True)),
              "answer": F.coalesce(answer_correct, F.lit(True))}[cfg.gating_mode]
    gate = F.when(opened, F.lit(1.0)).otherwise(F.lit(cfg.gating_floor))
    if cfg.control_mode == "format_only":
        return format_valid.cast("double")
    if cfg.control_mode == "random":
        if control_key is None:
            raise ValueError("the random control needs a row key")
        # A seeded hash stands in for the random draw so that reruns agree.
        return F.pmod(F.xxhash64(control_key), F.lit(1_000_003)) / 1_000_003.0
    total = F.lit(0.0)
    for dim in DIMENSIONS:
        weight = cfg.weights[dim]
        if weight == 0:
            continue
        part = F.lit(float(weight)) * vector[dim]
        if cfg.gating_mode != "none" and dim in cfg.gated_dims:
            part = part * gate
        if cfg.require_valid_format_for_aux and dim in ("grounding", "process", "consistency"):
            part = F.when(F.coalesce(format_valid, F.lit(True)), part).otherwise(F.lit(0.0))
        total = total + part
    return total


def warmup_gate(grounding: Column, step: Column, warmup_steps: int) -> Column:
    return F.when(step >= warmup_steps, grounding).otherwise(F.lit(0.0))


def count_qa_score(completion: Column, solution: Column, stated_gold: Column) -> tuple[Column, Column]:
    """(gold usable, score): 1 when a strict count answer equals the consistent gold."""
    pred, gold = T.strict_count(completion), T.gold_count(solution)
    usable = F.coalesce(stated_gold.between(0, 1000) & (gold == stated_gold), F.lit(False))
    return usable, (usable & F.coalesce(pred == stated_gold, F.lit(False))).cast("double")


def learnability(pass_rate: Column) -> Column:
    """4p(1-p) of a clamped pass rate; unknown is 0."""
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), pass_rate))
    return F.when(pass_rate.isNull() | F.isnan(pass_rate), F.lit(0.0)).otherwise(4.0 * p * (1.0 - p))
