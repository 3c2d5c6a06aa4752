"""Box columns: parsing, scaling, overlap and one-to-one matching inside a row.

The boxes of a rollout come from one text, so arrays stay as small as that text and no shuffle is
needed to match them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollscope.functions.text import WS, let, strip

# Box grammar.
TAG = r"(?is)<bbox(?=[\s>])[^>]*>.*?</bbox>"
TAG_PARTS = r"(?is)^<bbox([^>]*)>(.*)</bbox>$"
TAG_OPEN = r"(?is)<bbox(?=[\s>])[^>]*>"
ATTR = r"\s+[a-zA-Z_][\w-]*\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]+)"
ATTR_ALL = rf"(?s)^(?:{ATTR})*+\s*$"
NUMBER = r"^[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?\z"
BOX_JSON = (r"(?is)\{([^{}]*?\"bbox_2d\"\s*:\s*\[\s*-?\d*\.?\d+\s*,\s*-?\d*\.?\d+\s*,\s*-?\d*\.?\d+\s*,"
            r"\s*-?\d*\.?\d+\s*\][^{}]*?)\}")
BOX_JSON_COORDS = r"(?is)\"bbox_2d\"\s*:\s*\[([^\]]*)\]"
PLAYER_JSON = r"(?i)\"player\"\s*:\s*(?:\"([^\"]*)\"|([^,}\s]+))(?=\s*(?:[,}]|$))"
COORD_ATTRS = ("coords", "bbox2d", "bbox_2d", "bbox-2d")
CORNERS = ("x1", "y1", "x2", "y2")
MAX_PLAYER = 8


def coord_list(text: Column) -> Column:
    """Four finite numbers, optionally in brackets, else null."""
    def parse(t: Column) -> Column:
        opened, closed = t.startswith("["), t.endswith("]")
        body = F.when(opened & closed, F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(t)
        nums = F.transform(F.split(body, ","), lambda p: let(
            strip(p), lambda q: F.when(q.rlike(NUMBER), q.try_cast("double"))))
        return let(nums, lambda n: F.when(
            (opened == closed) & (F.size(n) == 4) & F.forall(
                n, lambda v: v.isNotNull() & (F.abs(v) < F.lit(float("inf")))), n))

    return F.when(F.contains(text, F.lit(",")), let(strip(text), parse))


def player_id(raw: Column) -> Column:
    n = F.when(raw.rlike(r"^[0-9]{1,10}$"), raw.try_cast("bigint"))
    return F.when(n.between(1, MAX_PLAYER), n)


def _close(a: Column, b: Column) -> Column:
    return F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) <= 1e-6), lambda v: v)


def _positions(text: Column, found: Column) -> Column:
    """Start of each found piece; pieces come left to right without overlap."""
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<at:int,piece:string>>").alias("out"))
    def step(acc: Column, piece: Column) -> Column:
        at = F.call_function("locate", piece, text, acc["at"])
        return F.struct((at + F.length(piece)).alias("at"),
                        F.concat(acc["out"], F.array(F.struct(at.alias("at"), piece.alias("piece")))).alias("out"))
    return F.aggregate(found, start, step, lambda acc: acc["out"])


def _tag_attempts(text: Column) -> Column:
    located = _positions(text, F.regexp_extract_all(text, F.lit(TAG), 0))

    def parts(m: Column) -> Column:
        attrs = F.regexp_extract(m["piece"], TAG_PARTS, 1)
        body = F.regexp_extract(m["piece"], TAG_PARTS, 2)
        pairs = F.transform(F.regexp_extract_all(attrs, F.lit(ATTR), 0), lambda a: F.struct(
            F.lower(F.regexp_extract(a, r"^\s*([\w-]+)", 1)).alias("name"),
            F.regexp_replace(F.regexp_extract(a, r"(?s)=\s*(.*)$", 1), r"(?s)^([\"'])(.*)\1$", "$2").alias("value")))
        return F.struct(m["at"].alias("at"), attrs.alias("attrs"), body.alias("body"), pairs.alias("pairs"))

    def values(p: Column, *names: str) -> Column:
        return F.transform(F.filter(p["pairs"], lambda a: a["name"].isin(*names)), lambda a: a["value"])

    def fields(p: Column) -> Column:
        corner = [values(p, c) for c in CORNERS]
        return F.struct(
            p["at"].alias("at"), p["attrs"].alias("attrs"), p["body"].alias("body"),
            values(p, "player").alias("players"), coord_list(p["body"]).alias("body_coords"),
            F.transform(values(p, *COORD_ATTRS), coord_list).alias("attr_coords"),
            *[c.alias(n) for c, n in zip(corner, CORNERS)])

    def corners(p: Column) -> Column:
        sizes = [F.size(p[c]) for c in CORNERS]
        four = (sizes[0] == 1) & (sizes[1] == 1) & (sizes[2] == 1) & (sizes[3] == 1)
        only_x1 = (sizes[0] == 1) & (sizes[1] + sizes[2] + sizes[3] == 0)
        many = (sizes[0] > 1) | (sizes[1] > 1) | (sizes[2] > 1) | (sizes[3] > 1)
        some = sizes[0] + sizes[1] + sizes[2] + sizes[3] > 0
        joined = F.concat_ws(",", *[F.get(p[c], F.lit(0)) for c in CORNERS])
        coords = F.when(four, coord_list(joined)).when(only_x1, coord_list(F.get(p["x1"], F.lit(0))))
        return F.struct(p.alias("p"), coords.alias("coords"), four.alias("four"), (some & many).alias("many"),
                        some.alias("some"))

    def candidates(c: Column) -> Column:
        p = c["p"]
        cands = F.array_compact(F.concat(F.array(p["body_coords"]), p["attr_coords"], F.array(c["coords"])))
        return F.struct(c.alias("c"), cands.alias("cands"))

    def attempt(x: Column) -> Column:
        c, cands, p = x["c"], x["cands"], x["c"]["p"]
        commas = F.length(p["body"]) - F.length(F.replace(p["body"], F.lit(","), F.lit("")))
        broken_body = (p["body_coords"].isNull() & F.ltrim(p["body"], F.lit(WS)).startswith("[") & (commas >= 3))
        first = F.get(cands, F.lit(0))
        error = (
            F.when(F.rtrim(p["attrs"], F.lit(WS)).endswith("/"), F.lit("self_closing_bbox"))
            .when(~p["attrs"].rlike(ATTR_ALL), F.lit("malformed_attributes"))
            .when(F.size(p["players"]) > 1, F.lit("conflicting_player_ids"))
            .when(broken_body, F.lit("malformed_coords"))
            .when(F.exists(p["attr_coords"], lambda v: v.isNull()), F.lit("malformed_coords"))
            .when(c["many"], F.lit("conflicting_coords"))
            .when(c["four"] & c["coords"].isNull(), F.lit("malformed_coords"))
            .when(c["some"] & c["coords"].isNull(), F.lit("incomplete_coords"))
            .when(F.size(cands) == 0, F.lit("missing_coords"))
            .when((F.size(cands) > 1) & F.exists(cands, lambda v: ~_close(v, first)), F.lit("conflicting_coords")))

        def row(err: Column) -> Column:
            no_player = err.isin("self_closing_bbox", "malformed_attributes", "conflicting_player_ids")
            return F.struct(
                p["at"].alias("at"), F.when(err.isNull(), first).alias("coords"),
                F.when(~F.coalesce(no_player, F.lit(False)), F.get(p["players"], F.lit(0))).alias("player"),
                F.lit(False).alias("is_json"), err.alias("error"))

        return let(error, row)

    staged = located
    for stage in (parts, fields, corners, candidates, attempt):
        staged = F.transform(staged, stage)
    return staged


def _json_attempts(text: Column) -> Column:
    located = _positions(text, F.regexp_extract_all(text, F.lit(BOX_JSON), 0))

    def attempt(m: Column) -> Column:
        obj = F.regexp_extract(m["piece"], BOX_JSON, 1)
        quoted, bare = F.regexp_extract(obj, PLAYER_JSON, 1), F.regexp_extract(obj, PLAYER_JSON, 2)
        error = (F.when(F.regexp_count(obj, F.lit(r"(?i)\"player\"\s*:")) > 1, F.lit("conflicting_player_ids"))
                 .when(F.regexp_count(obj, F.lit(r"(?i)\"bbox_2d\"\s*:")) > 1, F.lit("conflicting_coords")))
        player = F.when(obj.rlike(PLAYER_JSON), F.when(bare != "", bare).otherwise(quoted))
        return F.struct(
            m["at"].alias("at"), coord_list(F.regexp_extract(obj, BOX_JSON_COORDS, 1)).alias("coords"),
            player.alias("player"), F.lit(True).alias("is_json"), error.alias("error"))

    return F.transform(located, attempt)


def evidence_attempts(text: Column) -> Column:
    """Every box attempt of a text in order: position, coords, player text, JSON flag, error."""
    t = F.coalesce(text, F.lit(""))

    def every(tags: Column) -> Column:
        dangling = F.greatest(F.regexp_count(t, F.lit(TAG_OPEN)) - F.size(tags), F.lit(0))
        loose = F.transform(F.array_repeat(F.lit(0), dangling), lambda _: F.struct(
            (F.length(t) + 1).alias("at"), F.lit(None).cast("array<double>").alias("coords"),
            F.lit(None).cast("string").alias("player"), F.lit(False).alias("is_json"),
            F.lit("unclosed_bbox").alias("error")))
        return F.concat(tags, _json_attempts(t), loose)

    return F.array_sort(let(_tag_attempts(t), every), lambda a, b: (a["at"] - b["at"]).cast("int"))


def scale_coords(coords: Column, is_json: Column, width: Column, height: Column, mode: str = "auto") -> Column:
    """Coordinates as fractions of the image, null when out of range."""
    if mode not in ("auto", "pixel", "normalized"):
        raise ValueError(f"unknown coordinate mode: {mode}")
    pixel = F.lit(mode == "pixel")
    if mode == "auto":
        pixel = is_json | (F.array_max(coords) > 1.0)
    sized = F.transform(coords, lambda v, i: v / F.when(i % 2 == 0, width).otherwise(height))
    out = F.when(pixel, F.when((width > 0) & (height > 0), sized)).otherwise(coords)
    return let(out, lambda o: F.when(F.forall(o, lambda v: v.between(0.0, 1.0)), o))


def scaled_attempts(attempts: Column, width: Column, height: Column, mode: str = "auto") -> Column:
    """Attempts with `box` (fractions, valid only), parsed player and final error."""
    def scaled(a: Column) -> Column:
        box = scale_coords(a["coords"], a["is_json"], width, height, mode)
        return F.struct(a["at"].alias("at"), box.alias("box"), a["player"].alias("raw_player"),
                        player_id(a["player"]).alias("player"), a["error"].alias("parse_error"))

    def checked(a: Column) -> Column:
        b = a["box"]
        ordered = (b[0] < b[2]) & (b[1] < b[3])
        error = (F.when(a["parse_error"].isNotNull(), a["parse_error"]).when(b.isNull(), F.lit("out_of_range"))
                 .when(~ordered, F.lit("bad_ordering")))
        return let(error, lambda e: F.struct(
            a["at"].alias("at"), F.when(e.isNull(), b).alias("box"), a["player"].alias("player"),
            a["raw_player"].alias("raw_player"), e.alias("error")))

    return F.transform(F.transform(attempts, scaled), checked)


def valid_boxes(scaled: Column) -> Column:
    return F.filter(scaled, lambda a: a["error"].isNull())


def first_player(attempts: Column) -> Column:
    return player_id(F.get(attempts, F.lit(0))["player"])


def box_iou(a: Column, b: Column) -> Column:
    """Continuous overlap ratio of two [x1, y1, x2, y2] arrays; empty union is 0."""
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    area = lambda x: F.greatest(F.lit(0.0), (x[2] - x[0]) * (x[3] - x[1]))
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(F.lit(0.0))


def box_iou_inclusive(a: Column, b: Column) -> Column:
    """Overlap ratio where coordinates are whole pixels and both edges count."""
    x1, y1 = F.greatest(a[0], b[0]), F.greatest(a[1], b[1])
    x2, y2 = F.least(a[2] - 1, b[2] - 1), F.least(a[3] - 1, b[3] - 1)
    inter = F.when((x1 < x2) & (y1 < y2), (x2 - x1 + 1) * (y2 - y1 + 1)).otherwise(F.lit(0.0))
    area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    return inter / (area(a) + area(b) - inter)


def xywh_to_xyxy(box: Column) -> Column:
    return F.when(F.size(box) == 4, F.array(box[0], box[1], box[0] + box[2], box[1] + box[3]))


def is_box(box: Column) -> Column:
    return box.isNotNull() & (F.size(box) == 4) & F.forall(box, lambda v: v.isNotNull())


def centre_box(x: Column, y: Column, radius: float = 48, width: float = 320, height: float = 240) -> Column:
    """Square around a centre, cut at the image border."""
    return F.array(F.greatest(F.lit(0.0), x - radius), F.greatest(F.lit(0.0), y - radius),
                   F.least(F.lit(float(width)), x + radius), F.least(F.lit(float(height)), y + radius))


def iou_pairs(gold: Column, pred: Column, iou=box_iou) -> Column:
    """All (gold, predicted) pairs of one row, best overlap first, ties by gold then predicted index."""
    pairs = F.flatten(F.transform(gold, lambda g, gi: F.transform(pred, lambda p, pi: F.struct(
        (-iou(g, p)).alias("neg"), gi.alias("g"), pi.alias("p")))))
    return F.array_sort(pairs)


def greedy_fold(pairs: Column, threshold: float, require_positive: bool = True) -> Column:
    """One-to-one matching of sorted pairs: total overlap, match count and the matched pairs."""
    zero = F.struct(
        F.array().cast("array<int>").alias("ug"), F.array().cast("array<int>").alias("up"),
        F.lit(0.0).alias("total"), F.array().cast("array<struct<g:int,p:int,iou:double>>").alias("hits"))

    def step(acc: Column, x: Column) -> Column:
        iou = -x["neg"]
        ok = (iou >= threshold) & ~F.array_contains(acc["ug"], x["g"]) & ~F.array_contains(acc["up"], x["p"])
        if require_positive:
            ok = ok & (iou > 0.0)
        return F.when(ok, F.struct(
            F.array_append(acc["ug"], x["g"]).alias("ug"), F.array_append(acc["up"], x["p"]).alias("up"),
            (acc["total"] + iou).alias("total"),
            F.array_append(acc["hits"], F.struct(x["g"].alias("g"), x["p"].alias("p"), iou.alias("iou")))
            .alias("hits"))).otherwise(acc)

    return F.aggregate(pairs, zero, step, lambda a: F.struct(a["total"].alias("total"), a["hits"].alias("hits")))


def match_scores(total: Column, n_gold: Column, n_pred: Column) -> tuple[Column, Column, Column]:
    """Recall, precision and their harmonic mean from the matched overlap."""
    recall = F.when(n_gold > 0, total / n_gold).otherwise(F.lit(0.0))
    precision = F.when(n_pred > 0, total / n_pred).otherwise(F.lit(0.0))
    both = recall + precision
    return recall, precision, F.when(both > 0, 2 * recall * precision / both).otherwise(F.lit(0.0))


def best_recall(gold: Column, pred: Column, threshold: float = 0.0) -> Column:
    """Mean over gold boxes of their best overlap; overlaps under the threshold count 0."""
    best = F.transform(gold, lambda g: F.array_max(F.transform(pred, lambda p: box_iou(g, p))))
    kept = F.transform(best, lambda v: F.when(v >= threshold, v).otherwise(F.lit(0.0)))
    return F.when((F.size(gold) == 0) | (F.size(pred) == 0), F.lit(0.0)).otherwise(
        F.aggregate(kept, F.lit(0.0), lambda s, v: s + v) / F.size(gold))


def near_duplicates(boxes: Column, threshold: float = 0.9) -> Column:
    """Whether any two boxes of a row nearly coincide."""
    return F.exists(F.transform(boxes, lambda b, i: F.struct(b.alias("b"), i.alias("i"))), lambda x: F.exists(
        F.slice(boxes, x["i"] + 2, F.size(boxes)), lambda o: box_iou(x["b"], o) >= threshold))
