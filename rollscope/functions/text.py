"""Columns that pull typed fields out of completion text. All of them stay JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace stripped at the ends of a text.
WS = " \t\n\r\f\x0b"

# Completion grammar.
ANSWER = r"(?s)<answer>(.*?)</answer>"
THINK = r"(?s)<think>(.*?)</think>"
SPY_FIELD = r"(?i)spy\s*(?:player)?\s*[:=]?\s*(?:player\s*)?(\d+)"
COUNT_FIELD = r"(?i)changed[\s_-]*attributes?\s*[:=]?\s*(\d+)"
FORMAT = (r"(?s)^\s*<think>.*?</think>\s*"
          r"(?:<bbox[^>]*>[^<]*</bbox>\s*|<change>[^<]*</change>\s*)*+"
          r"<answer>[^<]*</answer>\s*(?:<bbox[^>]*>[^<]*</bbox>\s*)*+\z")
FORMAT_SIMPLE = r"(?s)^<think>.*?</think>\s*<answer>.*?</answer>\z"
FORMAT_REC = r"(?s)<think>.*?</think>\s*<answer>.*?\{.*\[\d+,\s*\d+,\s*\d+,\s*\d+\].*\}.*?</answer>"
STEP_PATTERNS = (
    r"(?s)(?:^|\n)\s*(?:\d+[\.\)]\s*)(.+?)(?=(?:\n\s*(?:\d+[\.\)]|Step\s*\d|$))|\z)",
    r"(?s)(?:^|\n)\s*(?:Step\s*\d+[:\-\.]\s*)(.+?)(?=(?:\n\s*(?:\d+[\.\)]|Step\s*\d|$))|\z)",
    r"(?s)(?:^|\n)\s*[-*]\s+(.+?)(?=(?:\n\s*[-*]\s|\n\s*(?:\d+[\.\)]|Step\s*\d|$))|\z)",
)
STEP_TAIL = r"\n\s*(?:\d+[\.\)]|Step\s*\d|[-*]\s).*$"
KEEP = r"(?is)<keep>\s*\[?([^\]<]*?)\]?\s*</keep>"
PLAYERS = r"(?i)<players>\s*(\d+)\s*</players>"
STRICT_COUNT = r"^\s*<answer>\s*(0|[1-9][0-9]*)\s*</answer>\s*\z"
BARE_COUNT = r"^\s*(0|[1-9][0-9]*)\s*\z"
JSON_FENCE = r"(?s)```json(.*?)```"
CHOICE = r"(?<![A-Z])([A-Z])(?=[\.\,\?\!\:\;]|$)"
CHOICE_KEYWORDS = ("答案", "选择", "正确", "是", "对", "ANSWER", "CORRECT", "CHOOSE", "SELECT", "RIGHT",
                   "认为", "应该", "觉得", "THINK", "BELIEVE", "SHOULD")
CHOICE_STOPS = "。.!！,，"
# Fixed value: integer text longer than this is not a number.
MAX_DIGITS = 10


def let(value: Column, body) -> Column:
    """Bind a value once for use in several places: lambdas would otherwise evaluate it per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WS))


def squeeze(text: Column) -> Column:
    """Lower case, single spaces, trimmed; null becomes empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))


def word_count(squeezed: Column) -> Column:
    return F.when(squeezed == "", F.lit(0)).otherwise(
        F.length(squeezed) - F.length(F.replace(squeezed, F.lit(" "), F.lit(""))) + 1)


def answer_body(text: Column) -> Column:
    """First answer body, else the whole text; stripped."""
    t = F.coalesce(text, F.lit(""))
    return strip(F.when(t.rlike(ANSWER), F.regexp_extract(t, ANSWER, 1)).otherwise(t))


def answer_norm(text: Column) -> Column:
    return squeeze(answer_body(text))


def answer_last(text: Column) -> Column:
    """Last answer body; a newline after whitespace vanishes, else it is a space; trailing dots cut; lower."""
    bodies = F.regexp_extract_all(text, F.lit(ANSWER), 1)
    body = F.when(F.size(bodies) > 0, F.element_at(bodies, -1)).otherwise(text)
    for ch in ("\\n", "\\r"):
        body = F.regexp_replace(F.regexp_replace(body, rf"(?<=\s){ch}", ""), ch, " ")
    return F.lower(F.rtrim(strip(body), F.lit(".")))


def reasoning(text: Column) -> Column:
    return strip(F.regexp_extract(F.coalesce(text, F.lit("")), THINK, 1))


def count_of(text: Column, token: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(token), F.lit("")))) / len(token)).cast("int")


def format_valid(text: Column) -> Column:
    """One reasoning part, then evidence, then one answer, nothing else."""
    t = F.coalesce(text, F.lit(""))
    once = F.lit(True)
    for token in ("<think>", "</think>", "<answer>", "</answer>"):
        once = once & (count_of(t, token) == 1)
    return once & t.rlike(FORMAT)


def small_int(digits: Column, max_digits: int = MAX_DIGITS) -> Column:
    """Digits to bigint; empty or too long is null."""
    return F.when((digits != "") & (F.length(digits) <= max_digits), digits.try_cast("bigint"))


def answer_field(text: Column, pattern: str) -> Column:
    """Integer field of the answer; the whole text counts only when there is no answer tag."""
    t = F.coalesce(text, F.lit(""))
    inside = F.regexp_extract(answer_body(t), pattern, 1)
    wide = F.when((inside == "") & ~F.contains(t, F.lit("<answer>")), F.regexp_extract(t, pattern, 1))
    return small_int(F.coalesce(wide, inside))


def spy_field(text: Column) -> Column:
    return answer_field(text, SPY_FIELD)


def count_field(text: Column) -> Column:
    return answer_field(text, COUNT_FIELD)


def reasoning_steps(text: Column) -> Column:
    """Steps of a reasoning text: numbered, `Step n`, bullets (two or more), else sentences, else all of it."""
    def steps(t: Column) -> Column:
        out = F.when(t == "", F.array().cast("array<string>"))
        for pattern in STEP_PATTERNS:
            found = F.filter(F.transform(F.regexp_extract_all(t, F.lit(pattern), 1), strip), lambda s: s != "")
            clean = let(found, lambda f: F.when(F.size(f) >= 2, F.transform(
                f, lambda s: strip(F.regexp_replace(s, STEP_TAIL, "")))))
            out = F.coalesce(out, clean)
        sents = let(F.filter(F.transform(F.split(t, r"(?<=[.!?])\s+"), strip), lambda s: F.length(s) > 3),
                    lambda f: F.when(F.size(f) >= 2, f))
        return F.coalesce(out, sents, F.array(t))

    return let(strip(F.coalesce(text, F.lit(""))), steps)


def tokens(text: Column) -> Column:
    """Distinct word tokens."""
    return F.array_distinct(F.regexp_extract_all(squeeze(text), F.lit(r"[a-zA-Z0-9_]+"), 0))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard of two token sets, 0 when either is empty."""
    share = let(F.size(F.array_intersect(a, b)), lambda both: both / (F.size(a) + F.size(b) - both))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(share)


def edit_ratio(a: Column, b: Column) -> Column:
    """1 - levenshtein / longer length; stand-in for block-matching ratios."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1.0 - F.levenshtein(a, b) / longest)


def step_similarity(a: Column, b: Column) -> Column:
    return 0.5 * jaccard(tokens(a), tokens(b)) + 0.5 * edit_ratio(squeeze(a), squeeze(b))


def proposal_keep(text: Column, num_objects: Column) -> Column:
    """Distinct sorted in-range positions of a proposal, null when missing or malformed."""
    body = strip(F.regexp_extract(F.coalesce(text, F.lit("")), KEEP, 1))
    parts = F.filter(F.split(body, r"[,\s]+"), lambda p: p != "")
    nums = F.transform(parts, lambda p: F.when(p.rlike(r"^[+-]?\d{1,10}$"), p.try_cast("bigint")))
    ok = (F.size(nums) > 0) & F.forall(nums, lambda i: i.isNotNull() & (i >= 0) & (i < num_objects))
    return F.when(ok, F.array_sort(F.array_distinct(nums)))


def proposal_players(text: Column, low: int = 3, high: int = 8) -> Column:
    asked = small_int(F.regexp_extract(F.coalesce(text, F.lit("")), PLAYERS, 1))
    return F.when(asked.between(low, high), asked).otherwise(F.lit((low + high) // 2).cast("bigint"))


def strict_count(text: Column) -> Column:
    """Whole text is one answer holding a count of at most four digits."""
    return small_int(F.regexp_extract(F.coalesce(text, F.lit("")), STRICT_COUNT, 1), 4)


def gold_count(solution: Column) -> Column:
    s = F.coalesce(solution, F.lit(""))
    tagged = F.regexp_extract(s, STRICT_COUNT, 1)
    return small_int(F.when(tagged != "", tagged).otherwise(F.regexp_extract(s, BARE_COUNT, 1)), 4)


def yes_no(text: Column) -> Column:
    """First yes / no of the answer, empty when neither occurs."""
    t = F.lower(F.coalesce(text, F.lit("")))
    return F.regexp_extract(answer_body(t), r"(yes|no)", 1)


def choice_letter(text: Column) -> Column:
    """Best standalone letter by nearby keywords, late position and following punctuation; first wins ties."""
    def best(t: Column) -> Column:
        letters = F.array_distinct(F.regexp_extract_all(t, F.lit(CHOICE), 1))

        def scored(letter: Column, i: Column) -> Column:
            pos = F.instr(t, letter) - 1
            start = F.greatest(pos - 20, F.lit(0))
            context = F.substring(t, start + 1, pos + 20 - start)
            follow = F.substring(t, pos + 2, F.lit(1))
            hits = let(context, lambda c: sum(
                (F.contains(c, F.lit(w)).cast("int") for w in CHOICE_KEYWORDS), F.lit(0)))
            score = (hits + F.when(pos > F.length(t) * 0.7, 2).otherwise(0)
                     + F.when((follow != "") & F.contains(F.lit(CHOICE_STOPS), follow), 1).otherwise(0))
            return F.struct(score.alias("score"), (-i).alias("rank"), letter.alias("letter"))

        return F.array_max(F.transform(letters, scored))["letter"]

    return let(F.regexp_replace(F.upper(text), r"\s+", " "), best)


def fenced_boxes(text: Column, last: bool = True) -> Column:
    """Boxes of the last (or first) fenced JSON array; unreadable JSON gives an empty array."""
    schema = "array<struct<bbox_2d:array<double>,label:string>>"
    bodies = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(JSON_FENCE), 1)
    body = F.when(F.size(bodies) > 0, F.element_at(bodies, -1 if last else 1))
    return F.coalesce(F.from_json(strip(body), schema), F.array().cast(schema))


def completion_text(raw: Column) -> Column:
    """Plain text of a completion given as text, one message or a message list (JSON)."""
    return F.coalesce(F.get_json_object(raw, "$[0].content"), F.get_json_object(raw, "$.content"), raw,
                      F.lit(""))


def ngram_repetition(text: Column, n: int = 6) -> Column:
    """Minus the share of repeated word n-grams."""
    def score(words: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(1))),
                            lambda i: F.array_join(F.slice(words, i, n), " "))
        share = let(grams, lambda g: F.size(F.array_distinct(g)) / F.size(g))
        return F.when(F.size(words) < n, F.lit(0.0)).otherwise(-(1.0 - share))

    return let(F.split(squeeze(text), " "), score)


def repetition_reward(text: Column, n: int = 6) -> Column:
    """Repetition of fenced box items when there are any, else of word n-grams."""
    items = F.transform(
        F.filter(fenced_boxes(text, last=False), lambda b: b["bbox_2d"].isNotNull() & b["label"].isNotNull()),
        lambda b: F.concat(b["bbox_2d"].cast("string"), F.lit("_"), b["label"]))
    return F.when(F.size(items) > 0, -(1.0 - F.size(F.array_distinct(items)) / F.size(items))).otherwise(
        ngram_repetition(text, n))


# Curves of the length-shaped reward.
COSINE_MAX_LEN = 1024
COSINE_CORRECT = (1.0, 0.5)
COSINE_WRONG = (0.0, -0.5)


def cosine_length(length: Column, accuracy: Column) -> Column:
    """Correct answers pay more when short, wrong ones cost more when long."""
    def curve(at_zero: float, at_max: float) -> Column:
        return at_max + (at_zero - at_max) * (1 + F.cos(length * F.pi() / COSINE_MAX_LEN)) / 2
    right = curve(*COSINE_CORRECT)
    # The wrong-answer curve starts at its floor and rises to its ceiling.
    wrong = curve(COSINE_WRONG[1], COSINE_WRONG[0])
    return F.when(accuracy >= 0.7, right).otherwise(wrong)


def fuzzy_text(content: Column, solution: Column) -> Column:
    """Numbers compare as numbers, choices as letters, other answers by edit ratio."""
    gold, said = answer_body(solution), answer_last_body(content)
    clean_gold, clean_said = answer_last(gold), answer_last(said)
    numeric = F.when(clean_gold.try_cast("double").isNotNull() & clean_said.try_cast("double").isNotNull(),
                     (clean_gold.try_cast("double") == clean_said.try_cast("double")).cast("double"))
    ratio = edit_ratio(clean_said, clean_gold)
    gold_choice = choice_letter(gold)
    picked = F.coalesce((choice_letter(said) == gold_choice).cast("double"), F.lit(0.0))
    return (F.when(said == gold, F.lit(1.0)).when(gold.rlike(r"\d"), F.coalesce(numeric, ratio))
            .when(gold_choice.isNotNull(), picked).otherwise(ratio))


def answer_last_body(text: Column) -> Column:
    bodies = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(ANSWER), 1)
    return strip(F.when(F.size(bodies) > 0, F.element_at(bodies, -1)).otherwise(text))


def all_match(content: Column, solution: Column) -> Column:
    return (answer_last(content) == answer_last(solution)).cast("double")


def mcq_score(content: Column, solution: Column) -> Column:
    gold = F.coalesce(choice_letter(answer_body(solution)), strip(solution))
    return F.coalesce((choice_letter(answer_body(content)) == gold).cast("double"), F.lit(0.0))


def yes_no_score(content: Column, solution: Column) -> Column:
    return (yes_no(content) == yes_no(solution)).cast("double")


def last_boxed(text: Column) -> Column:
    """Content of the last boxed answer; null when there is none.

    A box without braces comes first and reaches to the next dollar sign or the end. Else it is the last closed box, with braces of
    any depth, and in texts without `\\boxed` the last closed `\\fbox`.
    """
    t = F.coalesce(text, F.lit(""))
    bare = F.substring_index(F.substring_index(t, "\\boxed ", -1), "$", 1)
    return F.when(F.instr(t, F.lit("\\boxed ")) > 0, bare).when(F.instr(t, F.lit("\\boxed")) > 0, _last_closed(t, r"\\boxed\{")).otherwise(
        _last_closed(t, r"\\fbox\{"))


def _last_closed(text: Column, opening: str) -> Column:
    """What the last closed brace after an opening holds."""
    opened = F.split(text, opening)

    def closed(rest: Column) -> Column:
        # Pieces between braces and the braces themselves; the content ends where the depth falls below zero.
        zero = F.struct(F.lit(0).alias("depth"), F.lit("").alias("out"))
        walk = F.aggregate(F.regexp_extract_all(rest, F.lit(r"[{}]|[^{}]++"), F.lit(0)), zero, lambda a, p: F.when(
            a["depth"] < 0, a).otherwise(let(a["depth"] + F.when(p == "{", 1).when(p == "}", -1).otherwise(0), lambda d: F.struct(
                d.alias("depth"), F.when(d < 0, a["out"]).otherwise(F.concat(a["out"], p)).alias("out")))))
        return F.when(walk["depth"] < 0, walk["out"])

    parts = F.transform(F.slice(opened, 2, F.greatest(F.size(opened) - 1, F.lit(0))), closed)
    found = F.filter(parts, lambda p: p.isNotNull())
    return F.when(F.size(found) > 0, F.element_at(found, -1))


# LaTeX rewrites applied in order (old, new).
LATEX_REWRITES = (("\n", ""), ("\\!", ""), ("\\\\", "\\"), ("tfrac", "frac"), ("dfrac", "frac"), ("\\left", ""), ("\\right", ""),
                  ("^{\\circ}", ""), ("^\\circ", ""), ("\\$", ""))


def latex_normalize(text: Column) -> Column:
    """Canonical form of a LaTeX answer: spacing, units, fractions and roots written one way."""
    t = F.coalesce(text, F.lit(""))
    for old, new in LATEX_REWRITES:
        t = F.replace(t, F.lit(old), F.lit(new))
    # Units follow as a text group; several such groups leave the answer as it is.
    unit = F.lit("\\text{ ")
    t = let(t, lambda s: F.when(F.instr(s, unit) > 0, F.substring(s, F.lit(1), F.instr(s, unit) - 1)).otherwise(s))
    t = F.replace(t, F.lit("\\%"), F.lit(""))
    t = F.replace(F.replace(t, F.lit(" ."), F.lit(" 0.")), F.lit("{."), F.lit("{0."))
    t = F.regexp_replace(t, r"^\.", "0.")
    t = F.regexp_replace(t, r"^[^=]{0,2}=([^=]*)$", "$1")
    t = F.replace(F.regexp_replace(t, r"\\sqrt([^{])", r"\\sqrt{$1}"), F.lit(" "), F.lit(""))
    t = F.regexp_replace(t, r"\\frac([^{])([^{])", r"\\frac{$1}{$2}")
    t = F.regexp_replace(t, r"\\frac([^{])\{", r"\\frac{$1}{")
    t = F.regexp_replace(t, r"^0\.5$", r"\\frac{1}{2}")
    return F.regexp_replace(t, r"^(0|-?[1-9]\d*)/(0|-?[1-9]\d*)$", r"\\frac{$1}{$2}")


def latex_equal(answer: Column, gold: Column) -> Column:
    return latex_normalize(F.coalesce(last_boxed(answer), answer)) == latex_normalize(gold)
