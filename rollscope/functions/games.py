"""Columns of the odd-image game: vote and clue parsing, decision and clue scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollscope.functions.text import let, strip

# Reply grammar.
BOXED = r"(?s)\\\\?boxed\{(.*?)\}"
CLOSED = r"(?s)<answer>(.*?)</answer>"
OPEN = r"(?s)<answer>\s*(.*)"
THINK = r"(?s)<think>(.*?)</think>"
DIGIT = r"\b([1-9])\b"
PROMPT_ECHO = ("you are player", "your task is", "game instructions", "required output format", "example answer")
NO_CLUE = "No valid clue provided."

# Reward constants.
SUSPICION_WEIGHT, MISLEAD_WEIGHT, NA_MISLEAD = 0.6, 0.5, 0.5
GAMMA = 0.99
CLUE_FORMAT, VOTE_POTENTIAL, ACCURACY = 0.2, 0.5, 1.0
SHAPED_FORMAT, SHAPED_ACCURACY = 0.3, 1.2

# Clue vocabularies.
COLORS = ("red", "blue", "green", "yellow", "purple", "cyan", "brown", "gray", "grey", "orange", "pink", "white",
          "black", "dark", "light", "bright")
SHAPES = ("cube", "sphere", "cylinder", "ball", "box", "block", "circle", "round", "square", "rectangular", "cuboid",
          "cylindrical", "spherical", "cubes", "spheres", "cylinders", "balls", "boxes", "blocks", "circles",
          "squares")
POSITIONS = ("left", "right", "front", "behind", "above", "below", "next", "beside", "near", "far", "close",
             "distant", "center", "middle", "side", "edge", "corner", "top", "bottom", "between", "among", "around",
             "inside", "outside", "in front of", "to the left", "to the right", "on top of", "underneath")
SIZES = ("large", "small", "big", "tiny", "huge", "massive", "little", "giant", "larger", "smaller", "bigger",
         "smallest", "largest", "biggest", "medium")
RELATIONS = ("touching", "aligned", "parallel", "perpendicular", "diagonal", "stacked", "grouped", "scattered",
             "clustered", "arranged", "positioned")
LEAK_WORDS = ("odd", "player", "spy", "different", "same", "vote", "voting", "suspect", "suspicious", "game",
              "round", "clue", "guess", "guessing", "identify", "who is", "which one", "which player",
              "other players", "others", "i am", "you are", "we are", "they are", "everyone", "somebody",
              "modified", "original", "changed", "replaced", "switch", "switched")
VAGUE_PHRASES = ("i see", "there is", "there are", "i notice", "i can see", "i think", "something", "objects",
                 "things", "stuff", "picture shows", "image has", "scene contains", "various", "some", "several",
                 "many", "few")
COMPARATIVES = (r"\b(larger|smaller|bigger|taller|shorter)\s+than\b",
                r"\bto the (left|right|front|behind)\s+of\b", r"\b(next to|beside|near|far from)\b",
                r"\b(same|different)\s+(color|size|shape)\b")


def reply_body(text: Column, boxed: bool = True) -> Column:
    """Boxed text, else the answer body, else what follows an open answer tag; null when none."""
    opened = F.split(strip(F.regexp_extract(text, OPEN, 1)), r"</answer>|<think>|<answer>")
    out = F.when(text.rlike(CLOSED), strip(F.regexp_extract(text, CLOSED, 1))).when(
        text.rlike(OPEN), strip(F.get(opened, F.lit(0))))
    return F.when(text.rlike(BOXED), strip(F.regexp_extract(text, BOXED, 1))).otherwise(out) if boxed else out


def is_na(body: Column) -> Column:
    return F.coalesce(F.upper(body).isin("N/A", "NA"), F.lit(False))


def vote(text: Column) -> Column:
    """Voted player: first single digit of the reply, else the `spy` field of a JSON reply."""
    body = reply_body(text)
    digit = F.regexp_extract(body, DIGIT, 1)
    return F.when(is_na(body), F.lit(None)).otherwise(F.coalesce(
        F.when(digit != "", digit.try_cast("bigint")),
        F.when(body.startswith("{"), F.get_json_object(body, "$.spy").try_cast("bigint"))))


def clue_thinking(text: Column) -> Column:
    """Think body, else the text before the boxed reply, else the lines that are not prompt echo."""
    before = strip(F.regexp_extract(text, r"(?s)^(.*?)\\\\?boxed\{", 1))
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda s: (s != "") & ~s.rlike(BOXED) & ~s.rlike(
        "(?i)" + "|".join(PROMPT_ECHO)))
    return F.when(text.rlike(THINK), strip(F.regexp_extract(text, THINK, 1))).when(before != "", before).otherwise(
        F.array_join(lines, "\n"))


def clue_answer(text: Column) -> Column:
    return F.coalesce(reply_body(text), F.lit(NO_CLUE))


def _digits(body: Column) -> Column:
    return F.regexp_count(F.upper(body), F.lit(DIGIT))


def _answer_band(body: Column) -> Column:
    up = F.upper(strip(body))
    one = _digits(body) == 1
    return (F.when(one & up.rlike(r"^\d+$"), F.lit(1.0)).when(is_na(up), F.lit(1.0))
            .when(one & (F.size(F.split(up, r"\s+")) <= 2), F.lit(0.9)).when(one, F.lit(0.7)).otherwise(F.lit(0.3)))


def decision_format(text: Column) -> Column:
    """Format band of a decision that must think and then answer."""
    think, body = strip(F.regexp_extract(text, THINK, 1)), F.coalesce(reply_body(text, boxed=False), F.lit(""))
    has_think = text.rlike(THINK)
    return (F.when(has_think & (body != ""), F.when(F.length(think) < 10, F.lit(0.3)).otherwise(_answer_band(body)))
            .when(has_think | (body != ""), F.lit(0.2)).otherwise(F.lit(0.0)))


def basic_format(text: Column) -> Column:
    """Format band where untagged thinking and boxed replies count too."""
    think, body = clue_thinking(text), F.coalesce(reply_body(text), F.lit(""))
    return (F.when((think != "") & (body != ""), F.when(F.length(think) > 10, _answer_band(body)).otherwise(F.lit(0.3)))
            .when((think != "") | (body != ""), F.lit(0.2)).otherwise(F.lit(0.0)))


def phase_format(text: Column) -> Column:
    """1 for long thinking plus an answer, 0.5 for short thinking, 0.3 for half, 0 for neither."""
    think, body = strip(F.regexp_extract(text, THINK, 1)), F.coalesce(reply_body(text, boxed=False), F.lit(""))
    has_think = text.rlike(THINK)
    return (F.when(has_think & (body != ""), F.when(F.length(think) > 10, F.lit(1.0)).otherwise(F.lit(0.5)))
            .when(has_think | (body != ""), F.lit(0.3)).otherwise(F.lit(0.0)))


def decision_accuracy(voted: Column, na: Column, spy: Column, player: Column | None = None) -> Column:
    """Role-dependent vote score; without a player the voter is an observer."""
    seeker = F.when(na, F.lit(-0.5)).when(voted == spy, F.lit(1.0)).otherwise(F.lit(-1.0))
    if player is None:
        return seeker
    hider = (F.when(na, F.lit(0.2)).when(voted.isNull(), F.lit(-1.0)).when(voted == spy, F.lit(-1.0))
             .otherwise(F.lit(0.5)))
    return F.when(player == spy, hider).otherwise(seeker)


def shaped_decision(format_ok: Column, accuracy: Column) -> Column:
    """Format sign, weighted accuracy and the discounted potential of a good vote."""
    return (SHAPED_FORMAT * (2 * format_ok.cast("int") - 1) + SHAPED_ACCURACY * accuracy
            + GAMMA * (accuracy > 0).cast("int"))


def potential_clue(format_ok: Column, votes_after: Column, players: Column) -> Column:
    potential = -VOTE_POTENTIAL * votes_after / F.greatest(F.lit(1), players - 1)
    return CLUE_FORMAT * (2 * format_ok.cast("int") - 1) + GAMMA * potential


def potential_decision(format_ok: Column, correct: Column) -> Column:
    hit = correct.cast("int")
    return CLUE_FORMAT * (2 * format_ok.cast("int") - 1) + ACCURACY * (2 * hit - 1) + GAMMA * hit


def _hits(text: Column, words: tuple[str, ...]) -> Column:
    return F.size(F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w)))


# Cost of the votes a clue's author received, and the voters of a game when unknown.
CLUE_VOTE_COST, USUAL_VOTERS = 0.6, 4


def clue_with_votes(content: Column, votes_received: Column, total_voters: Column) -> Column:
    """Clue score less the share of the others' votes against its author; without votes the content alone."""
    others = F.greatest(F.lit(1), F.coalesce(total_voters, F.lit(USUAL_VOTERS)) - 1)
    return F.when(votes_received.isNull(), content).otherwise(content - CLUE_VOTE_COST * votes_received / others)


def clue_content(text: Column, repetition: Column) -> Column:
    """Content score of a clue: vocabulary gains, then repetition, leak, vagueness and length costs."""
    gains = ((COLORS, 0.2), (SHAPES, 0.25), (POSITIONS, 0.2), (SIZES, 0.15), (RELATIONS, 0.1))

    def scored(low: Column) -> Column:
        counts = F.struct(*[(_hits(low, words) > 0).alias(f"k{i}") for i, (words, _) in enumerate(gains)])

        def total(k: Column) -> Column:
            score = F.lit(0.2)
            for i, (_, gain) in enumerate(gains):
                score = score + F.when(k[f"k{i}"], F.lit(gain)).otherwise(F.lit(0.0))
            kinds = sum((k[f"k{i}"].cast("int") for i in range(len(gains))), F.lit(0))
            score = score + F.when(kinds >= 2, 0.1 * (kinds - 1)).otherwise(F.lit(0.0)) - repetition
            words = F.size(F.filter(F.split(low, r"\s+"), lambda w: w != ""))
            score = (score - 0.5 * _hits(low, LEAK_WORDS) - 0.08 * _hits(low, VAGUE_PHRASES)
                     - F.when((words < 4) | (words > 20), F.lit(0.1)).otherwise(F.lit(0.0)))
            for pattern in COMPARATIVES:
                score = score + F.when(low.rlike(pattern), F.lit(0.05)).otherwise(F.lit(0.0))
            score = score + F.when(k["k0"] & k["k1"], F.lit(0.05)).otherwise(F.lit(0.0))
            return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))

        return let(counts, total)

    def banded(body: Column) -> Column:
        think = strip(F.regexp_extract(text, THINK, 1))
        return (F.when(~text.rlike(THINK) | (body == ""), F.lit(0.0)).when(F.length(think) < 10, F.lit(0.1))
                .when(F.regexp_count(body, F.lit(r"[.!?]+")) > 2, F.lit(0.2)).otherwise(let(F.lower(body), scored)))

    return let(F.coalesce(reply_body(text), F.lit("")), banded)
