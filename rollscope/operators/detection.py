"""Detection scoring: score-ordered matching, precision curves and average precision."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollscope.functions import boxes as B
from rollscope.functions.text import let
from rollscope.operators import skew

# Overlap thresholds, area ranges, detection caps and the recall grid.
THRESHOLDS = tuple(round(0.5 + 0.05 * i, 2) for i in range(10))
AREAS = {"all": (0.0, 1e10), "small": (0.0, 1024.0), "medium": (1024.0, 9216.0), "large": (9216.0, 1e10)}
MAX_DETS = (1, 10, 100)
RECALL_STEPS = 100


def top_detections(dets: DataFrame, keys: Sequence[str], n: int, score: str = "score", order: str = "det_id") -> DataFrame:
    """First n detections per key by score, ties by id; cut to n per task before the shuffle."""
    return skew.top_per_key(dets, keys, [F.col(score).desc(), F.col(order).asc()], n, rank="det_rank")


def _gold_area(gold: DataFrame) -> Column:
    """Area of an annotation: its own where given, else that of its box."""
    box = F.col("box")[2] * F.col("box")[3]
    return F.coalesce(F.col("area"), box) if "area" in gold.columns else box


def _in_area(area: Column, name: str) -> Column:
    lo, hi = AREAS[name]
    return (area >= lo) & (area <= hi)


def coco_match(dets: DataFrame, gold: DataFrame, keys: Sequence[str], thresholds: Sequence[float] = THRESHOLDS,
               areas: Sequence[str] = tuple(AREAS), max_dets: int = 100) -> DataFrame:
    """Detections by score each take their best free gold box, per area range and overlap threshold.

    dets: keys, det_id, score, box [x, y, w, h]; gold: keys, gold_id, box, iscrowd and, if known, the annotation's
    own area (of its mask), which decides its area range; overlaps always use the boxes.
    At most max_dets detections of a key are scored, so a detection can lose at most max_dets - 1
    boxes to others: its best max_dets boxes per (area membership, crowd) class decide the result
    exactly, however many gold boxes the key has.
    """
    keys = list(keys)
    top = top_detections(dets, keys, max_dets).withColumn("det_area", F.col("box")[2] * F.col("box")[3])
    member = F.concat(*[_in_area(F.col("gold_area"), a).cast("int").cast("string") for a in areas])
    g = gold.select(*keys, "gold_id", "iscrowd", F.col("box").alias("gbox"), _gold_area(gold).alias("gold_area")).withColumn(
        "klass", member)
    d, o = F.col("box"), F.col("gbox")
    w = F.greatest(F.lit(0.0), F.least(d[0] + d[2], o[0] + o[2]) - F.greatest(d[0], o[0]))
    h = F.greatest(F.lit(0.0), F.least(d[1] + d[3], o[1] + o[3]) - F.greatest(d[1], o[1]))
    inter = w * h
    union = F.when(F.col("iscrowd"), F.col("det_area")).otherwise(F.col("det_area") + o[2] * o[3] - inter)
    pairs = top.select(*keys, "det_id", "box", "det_area").join(g, keys).select(
        *keys, "det_id", "gold_id", "iscrowd", "klass", F.when(union > 0, inter / union).otherwise(F.lit(0.0)).alias("iou"))
    pairs = pairs.filter(F.col("iou") >= min(thresholds))
    best = skew.top_per_key(pairs, ["det_id", "klass", "iscrowd"], [F.col("iou").desc(), F.col("gold_id").desc()], max_dets)
    cands = best.groupBy("det_id").agg(F.collect_list(F.struct("iou", "gold_id", "iscrowd", "klass")).alias("cands"))
    rows = top.join(cands, "det_id", "left").select(
        *keys, "det_id", "score", "det_rank", "det_area", F.coalesce("cands", F.array().cast(
            "array<struct<iou:double,gold_id:bigint,iscrowd:boolean,klass:string>>")).alias("cands"))
    packed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(
        "det_rank", "det_id", "score", "det_area", "cands"))).alias("dets"))
    settings = F.array(*[F.struct(F.lit(a).alias("area"), F.lit(i + 1).alias("pos"), F.lit(AREAS[a][0]).alias("lo"),
                                  F.lit(AREAS[a][1]).alias("hi"), F.lit(t).alias("thr"))
                         for i, a in enumerate(areas) for t in thresholds])
    runs = packed.select(*keys, "dets", F.inline(settings))
    zero = F.struct(F.array().cast("array<bigint>").alias("used"),
                    F.array().cast("array<struct<det_id:bigint,score:double,det_rank:int,matched:boolean,ignored:boolean>>")
                    .alias("out"))

    def step(acc: Column, x: Column) -> Column:
        open_ = F.filter(x["cands"], lambda c: (c["iou"] >= F.least(F.col("thr"), F.lit(1 - 1e-10)))
                         & (c["iscrowd"] | ~F.array_contains(acc["used"], c["gold_id"])))
        ranked = F.transform(open_, lambda c: F.struct(
            (~c["iscrowd"] & (F.substring(c["klass"], F.col("pos"), F.lit(1)) == "1")).alias("counts"),
            c["iou"].alias("iou"), c["gold_id"].alias("gold_id")))

        def taken(pick: Column) -> Column:
            hit = pick.isNotNull()
            outside = (x["det_area"] < F.col("lo")) | (x["det_area"] > F.col("hi"))
            row = F.struct(x["det_id"].alias("det_id"), x["score"].alias("score"), x["det_rank"].alias("det_rank"),
                           hit.alias("matched"), F.when(hit, ~pick["counts"]).otherwise(outside).alias("ignored"))
            used = F.when(hit, F.array_append(acc["used"], pick["gold_id"])).otherwise(acc["used"])
            return F.struct(used.alias("used"), F.array_append(acc["out"], row).alias("out"))

        return let(F.array_max(ranked), taken)

    folded = F.aggregate("dets", zero, step, lambda acc: acc["out"])
    # Outer, so that no size test on the fold is added below the generator and the fold runs once.
    return runs.select(*keys, "area", "thr", F.inline_outer(folded)).filter("det_id is not null")


def gold_counts(gold: DataFrame, keys: Sequence[str], areas: Sequence[str] = tuple(AREAS)) -> DataFrame:
    """Countable gold boxes per key and area range."""
    area = _gold_area(gold)
    counts = gold.groupBy(*keys).agg(*[F.count_if(~F.col("iscrowd") & _in_area(area, a)).alias(a) for a in areas])
    return counts.select(*keys, F.inline(F.array(*[F.struct(F.lit(a).alias("area"), F.col(a).alias("positives"))
                                                   for a in areas])))


def pr_curve(scored: DataFrame, keys: Sequence[str], positives: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Cumulative hits and misses in order, recall, precision and its right-to-left envelope."""
    cum = skew.running(scored, keys, order, sums={"tp": F.col("hit").cast("bigint"), "fp": (~F.col("hit")).cast("bigint")})
    curve = cum.join(positives, list(keys)).withColumn("recall", F.col("tp") / F.col("positives")).withColumn(
        "precision", F.col("tp") / (F.col("tp") + F.col("fp")))
    return skew.running(curve, keys, order, suffix_max={"envelope": F.col("precision")})


def average_precision(matches: DataFrame, positives: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """AP on the 101-point recall grid and final recall per key; keys without countable gold are absent.

    The envelope at a recall point is the best precision at that recall or beyond, so each row only
    matters through its grid step: at most 101 maxima per key are kept.
    """
    keys = list(keys)
    counted = matches.filter(~F.col("ignored")).withColumn("hit", F.col("matched"))
    cum = skew.running(counted, keys, order, sums={"tp": F.col("hit").cast("bigint"), "fp": (~F.col("hit")).cast("bigint")})
    pos = positives.filter("positives > 0")
    rows = cum.join(pos, [c for c in keys if c in pos.columns]).select(
        *keys, (F.col("tp") / F.col("positives")).alias("rc"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("pr"))
    cells = rows.groupBy(*keys, F.floor(F.col("rc") * RECALL_STEPS + 1e-9).alias("g")).agg(
        F.max("pr").alias("pr"), F.max("rc").alias("rc"))
    per = cells.groupBy(*keys).agg(F.collect_list(F.struct("g", "pr")).alias("cells"), F.max("rc").alias("recall"))
    grid = F.transform(F.sequence(F.lit(0), F.lit(RECALL_STEPS)), lambda i: F.coalesce(F.array_max(F.transform(
        F.filter("cells", lambda c: c["g"] >= i), lambda c: c["pr"])), F.lit(0.0)))
    return per.select(*keys, (F.aggregate(grid, F.lit(0.0), lambda s, v: s + v) / (RECALL_STEPS + 1)).alias("ap"), "recall")


def coco_summary(matches: DataFrame, gold: DataFrame, category: str = "category") -> DataFrame:
    """The twelve summary numbers as rows (metric, value), -1 where nothing can be measured."""
    positives = gold_counts(gold, [category])
    # Caps of 1 and 10 detections only matter for the overall recall.
    tagged = matches.select("*", F.explode(F.array(*[F.lit(m) for m in MAX_DETS])).alias("max_dets")).filter(
        (F.col("det_rank") <= F.col("max_dets")) & ((F.col("max_dets") == MAX_DETS[-1]) | (F.col("area") == "all")))
    order = [F.col("score").desc(), F.col("image_id").asc(), F.col("det_rank").asc()]
    ap = average_precision(tagged, positives, [category, "area", "thr", "max_dets"], order)
    # Categories with gold but without detections count as zero, those without gold do not count.
    want = positives.filter("positives > 0").select(
        category, "area", F.explode(F.array(*[F.lit(t) for t in THRESHOLDS])).alias("thr"))
    want = want.select("*", F.explode(F.array(*[F.lit(m) for m in MAX_DETS])).alias("max_dets")).filter(
        (F.col("max_dets") == MAX_DETS[-1]) | (F.col("area") == "all"))
    full = want.join(ap, [category, "area", "thr", "max_dets"], "left").fillna(0.0, ["ap", "recall"])
    top = F.col("max_dets") == MAX_DETS[-1]
    metric = lambda name, value, cond: F.avg(F.when(cond, F.col(value))).alias(name)
    cells = [metric("AP", "ap", top & (F.col("area") == "all"))]
    cells += [metric(f"AP{int(t * 100)}", "ap", top & (F.col("area") == "all") & (F.col("thr") == t)) for t in (0.5, 0.75)]
    cells += [metric(f"AP_{a}", "ap", top & (F.col("area") == a)) for a in ("small", "medium", "large")]
    cells += [metric(f"AR{m}", "recall", (F.col("max_dets") == m) & (F.col("area") == "all")) for m in MAX_DETS]
    cells += [metric(f"AR_{a}", "recall", top & (F.col("area") == a)) for a in ("small", "medium", "large")]
    wide = full.agg(*cells)
    return wide.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.coalesce(F.col(c), F.lit(-1.0)).alias("value"))
                                          for c in wide.columns])))


def detect_match_label(gold: Column, pred: Column, threshold: float = 0.5) -> Column:
    """One-to-one matching of labelled boxes by inclusive overlap; a wrong label keeps the match at 0.

    Struct of position total, right labels and number of matches.
    """
    pairs = F.array_sort(F.flatten(F.transform(pred, lambda p, pi: F.transform(gold, lambda g, gi: F.struct(
        (-B.box_iou_inclusive(p["bbox_2d"], g["bbox_2d"])).alias("neg"), pi.alias("p"), gi.alias("g"))))))

    def summary(found: Column) -> Column:
        rows = F.transform(found, lambda m: F.struct(m["iou"].alias("iou"), (
            F.lower(F.coalesce(F.get(pred, m["p"])["label"], F.lit(""))) == F.lower(
                F.coalesce(F.get(gold, m["g"])["label"], F.lit("")))).alias("ok")))
        return F.struct(
            F.aggregate(F.filter(rows, lambda r: r["ok"]), F.lit(0.0), lambda s, r: s + r["iou"]).alias("position"),
            F.size(F.filter(rows, lambda r: r["ok"])).alias("right_labels"), F.size(rows).alias("matches"))

    ordered = F.transform(pairs, lambda x: F.struct(x["neg"].alias("neg"), x["g"].alias("g"), x["p"].alias("p")))
    return let(B.greedy_fold(ordered, threshold, require_positive=False)["hits"], summary)


# Weights of position, label and completeness.
COMPOSITE = (0.7, 0.0, 0.3)


def detection_composite(match: Column, n_gold: Column, n_pred: Column) -> Column:
    """Weighted position, label and completeness score of one record."""
    a, b, c = COMPOSITE
    missed, false = (n_gold - match["matches"]) / n_gold, (n_pred - match["matches"]) / n_pred
    score = (a * match["position"] / n_gold + b * match["right_labels"] / n_gold + c * (1.0 - (missed + false) / 2.0)) / (a + b + c)
    return (F.when(n_gold == 0, (n_pred == 0).cast("double")).when(n_pred == 0, F.lit(0.0)).otherwise(score))


def record_map(dets: DataFrame, gold: DataFrame, record: str, label: str, records: DataFrame | None = None) -> DataFrame:
    """mAP over thresholds, at 0.5, and mAP with the length penalty per record, all scores equal.

    A record with boxes on one side only is 0. `records` names further records; one without any box is 1.
    """
    keys = [record, label]
    known = dets.join(gold.select(*keys).distinct(), keys, "left_semi")
    matches = coco_match(known, gold, keys, areas=("all",))
    positives = gold_counts(gold, keys, areas=("all",))
    ap = average_precision(matches, positives, [*keys, "area", "thr"], [F.col("score").desc(), F.col("det_rank").asc()])
    cells = positives.filter("positives > 0").select(*keys, F.explode(F.array(*[F.lit(t) for t in THRESHOLDS])).alias("thr"))
    full = cells.join(ap.drop("area"), [*keys, "thr"], "left").fillna(0.0, ["ap"])
    scored = full.groupBy(record).agg(F.avg("ap").alias("map"), F.avg(F.when(F.col("thr") == 0.5, F.col("ap"))).alias("map50"))
    sides = gold.select(record, F.lit(1).alias("g"), F.lit(0).alias("p")).unionByName(
        dets.select(record, F.lit(0).alias("g"), F.lit(1).alias("p")))
    if records is not None:
        sides = sides.unionByName(records.select(record, F.lit(0).alias("g"), F.lit(0).alias("p")))
    sizes = sides.groupBy(record).agg(F.sum("g").alias("n_gold"), F.sum("p").alias("n_pred"))
    out = sizes.join(scored, record, "left")
    none = (F.col("n_gold") == 0) & (F.col("n_pred") == 0)
    whole = lambda c: F.when(none, F.lit(1.0)).otherwise(F.coalesce(F.col(c), F.lit(0.0)))
    return out.select(record, whole("map").alias("map"), whole("map50").alias("map50"),
                      (whole("map") * length_penalty(F.col("n_gold"), F.col("n_pred"))).alias("map_length"))


def length_penalty(n_gold: Column, n_pred: Column) -> Column:
    """Records with more predicted than gold boxes pay in proportion."""
    return F.when(n_gold >= n_pred, F.lit(1.0)).otherwise(n_gold / n_pred)


ANNOTATIONS = "array<struct<id:bigint,image_id:bigint,category_id:bigint,bbox:array<double>,area:double,iscrowd:int>>"
IMAGES = "array<struct<id:bigint,width:int,height:int,file_name:string>>"
CATEGORIES = "array<struct<id:bigint,name:string>>"
RESULTS = ("array<struct<image_id:bigint,category_id:bigint,score:double,caption:string,bbox:array<double>,"
           "segmentation:array<array<double>>,keypoints:array<double>,iscrowd:int>>")


def coco_tables(docs: DataFrame, doc: str = "doc", body: str = "body") -> dict[str, DataFrame]:
    """Annotations, images and categories of annotation documents (JSON text, one document per row), and images per category.

    An id that a document names twice keeps its last entry in `annotations`, `images` and `categories`, as a dictionary
    would; `category_images` has one row per annotation entry, repeats included, of documents that name categories. A part
    that a document lacks has no rows; a text that is no JSON object raises. Entries without an id have the id null.
    """
    parts = {"annotations": ANNOTATIONS, "images": IMAGES, "categories": CATEGORIES}
    schema = "struct<" + ",".join(f"{name}:{kind}" for name, kind in parts.items()) + ",_bad:string>"
    read = F.from_json(F.col(body), schema, {"columnNameOfCorruptRecord": "_bad"})
    parsed = docs.select(F.col(doc).alias("doc"), read.alias("__d"))
    sound = F.col("__d").isNotNull() & F.col("__d")["_bad"].isNull()
    parsed = parsed.withColumn("__d", F.when(sound, F.col("__d")).otherwise(
        F.raise_error(F.concat(F.lit("not an annotation document: "), F.coalesce(F.col("doc").cast("string"), F.lit("null")))).cast(schema)))
    entries = {n: parsed.select("doc", F.posexplode(F.col("__d")[n]).alias("__at", "__e")) for n in parts}
    out = {}
    for name, rows in entries.items():
        last = rows.groupBy("doc", F.col("__e")["id"].alias("__id")).agg(F.max_by("__e", "__at").alias("__e"))
        out[name] = last.select("doc", "__e.*")
    linked = parsed.filter(F.col("__d")["categories"].isNotNull()).select("doc", F.explode(F.col("__d")["annotations"]).alias("__e"))
    out["category_images"] = linked.select("doc", F.col("__e")["category_id"].alias("category_id"), F.col("__e")["image_id"].alias("image_id"))
    return out


def result_tables(docs: DataFrame, images: DataFrame, doc: str = "doc", body: str = "body") -> DataFrame:
    """Results of result documents (a JSON array each) as annotations: id by position, kind, box, area, crowd flag.

    The first entry decides the kind of its document. `caption`: neither box nor area. `box`: [x, y, width, height], area by
    its sides, and the outline as polygon where none is given. `polygon`: rings of x, y; area by the shoelace rule over the rings (run-length masks are not
    read), box around them unless one is given (an empty one is none). `points`: x, y, visibility; box and area around all points. Images that
    `images` (doc, id) does not name, and entries that lack what their kind needs, raise. Empty documents give no rows.
    """
    rows = docs.select(F.col(doc).alias("doc"), F.from_json(F.col(body), RESULTS).alias("__r")).select(
        "doc", F.get("__r", F.lit(0)).alias("__one"), F.posexplode("__r").alias("__at", "__e"))
    one, e = F.col("__one"), F.col("__e")
    kind = (F.when(one["caption"].isNotNull(), F.lit("caption")).when(F.size(one["bbox"]) > 0, F.lit("box"))
            .when(one["segmentation"].isNotNull(), F.lit("polygon")).when(one["keypoints"].isNotNull(), F.lit("points")))
    rows = rows.select("doc", (F.col("__at") + 1).cast("bigint").alias("id"), kind.alias("kind"), "__e")
    every = lambda a, step, at: F.transform(F.sequence(F.lit(0), F.floor(F.size(a) / step).cast("int") - 1), lambda i: F.get(a, i * step + at))
    around = lambda x, y: F.array(F.array_min(x), F.array_min(y), F.array_max(x) - F.array_min(x), F.array_max(y) - F.array_min(y))
    rings = e["segmentation"]
    flat = F.flatten(rings)

    def shoelace(ring: Column) -> Column:
        n = F.floor(F.size(ring) / 2).cast("int")
        turn = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(ring, 2 * i) * F.get(ring, 2 * ((i + 1) % n) + 1)
                           - F.get(ring, 2 * ((i + 1) % n)) * F.get(ring, 2 * i + 1))
        return F.abs(F.aggregate(turn, F.lit(0.0), lambda s, v: s + v)) / 2

    whole = (F.when(F.col("kind") == "caption", e["caption"].isNotNull()).when(F.col("kind") == "box", F.size(e["bbox"]) == 4)
             .when(F.col("kind") == "polygon", (F.size(rings) > 0) & F.forall(rings, lambda r: (F.size(r) >= 6) & (F.size(r) % 2 == 0)))
             .when(F.col("kind") == "points", (F.size(e["keypoints"]) >= 3) & (F.size(e["keypoints"]) % 3 == 0)))
    checked = F.when(F.coalesce(whole, F.lit(False)), F.col("id")).otherwise(F.raise_error(F.concat(
        F.lit("result lacks what its kind needs: "), F.col("doc").cast("string"), F.lit("/"), F.col("id").cast("string"))).cast("bigint"))
    box = (F.when(F.col("kind") == "box", e["bbox"])
           .when(F.col("kind") == "polygon", F.when(F.size(e["bbox"]) > 0, e["bbox"]).otherwise(around(every(flat, 2, 0), every(flat, 2, 1))))
           .when(F.col("kind") == "points", around(every(e["keypoints"], 3, 0), every(e["keypoints"], 3, 1))))
    area = (F.when(F.col("kind") == "polygon", F.aggregate(F.transform(rings, shoelace), F.lit(0.0), lambda s, v: s + v))
            .when(F.col("kind") != "caption", F.col("box")[2] * F.col("box")[3]))
    right, low = F.col("box")[0] + F.col("box")[2], F.col("box")[1] + F.col("box")[3]
    outline = F.array(F.array(F.col("box")[0], F.col("box")[1], F.col("box")[0], low, right, low, right, F.col("box")[1]))
    made = rows.select("doc", checked.alias("id"), "kind", "__e", box.alias("box")).select(
        "doc", "id", "kind", e["image_id"].alias("image_id"), e["category_id"].alias("category"), e["score"].alias("score"), "box",
        area.alias("area"), F.when(F.col("kind") == "box", F.coalesce(rings, outline)).when(F.col("kind") == "polygon", rings).alias("polygon"),
        F.when(F.col("kind").isin("box", "polygon"), F.lit(0)).otherwise(e["iscrowd"]).alias("iscrowd"))
    named = images.select(F.col("doc"), F.col("id").alias("image_id"), F.lit(True).alias("__known")).distinct()
    known = F.when(F.coalesce("__known", F.lit(False)), F.col("image_id")).otherwise(
        F.raise_error(F.lit("results name unknown images")).cast("bigint"))
    return made.join(named, ["doc", "image_id"], "left").withColumn("image_id", known).drop("__known")


def load_results(results: DataFrame, images: DataFrame, start_id: int = 1) -> DataFrame:
    """Detections with id, area and crowd flag; an image id outside the gold set raises."""
    strange = results.join(images.select("image_id").distinct(), "image_id", "left_anti")
    bad = strange.agg(F.count(F.lit(1))).scalar()
    numbered = skew.number_rows(results, [F.col("image_id"), F.col("score").desc(), F.col("box")], "__rn")
    checked = F.when(bad > 0, F.raise_error(F.lit("results name unknown images")).cast("bigint")).otherwise(
        F.col("__rn") + (start_id - 1))
    return numbered.select("*", checked.alias("det_id"), (F.col("box")[2] * F.col("box")[3]).alias("area"),
                           F.lit(False).alias("iscrowd")).drop("__rn")


def coco_filter(annotations: DataFrame, *, categories: Sequence[int] | None = None, images: Sequence[int] | None = None,
                area: tuple[float, float] | None = None, crowd: bool | None = None) -> DataFrame:
    """Annotations by category, image, open area range and crowd flag."""
    out = annotations
    if categories is not None:
        out = out.filter(F.col("category").isin(list(categories)))
    if images is not None:
        out = out.filter(F.col("image_id").isin(list(images)))
    if area is not None:
        size = F.col("box")[2] * F.col("box")[3]
        out = out.filter((size > area[0]) & (size < area[1]))
    if crowd is not None:
        out = out.filter(F.col("iscrowd") == crowd)
    return out


def images_with_all(annotations: DataFrame, categories: Sequence[int]) -> DataFrame:
    """Images that hold every given category."""
    pairs = annotations.filter(F.col("category").isin(list(categories))).select("image_id", "category").distinct()
    return pairs.groupBy("image_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(set(categories))).select("image_id")


def oks(gold_points: Column, pred_points: Column, visible: Column, sigmas: Sequence[float], area: Column,
        gold_box: Column) -> Column:
    """Keypoint similarity; without visible points, distance to the gold box grown to twice its size."""
    spread = F.array(*[F.lit((2 * s) ** 2) for s in sigmas])
    x0, x1 = gold_box[0] - gold_box[2], gold_box[0] + gold_box[2] * 2
    y0, y1 = gold_box[1] - gold_box[3], gold_box[1] + gold_box[3] * 2
    seen = F.exists(visible, lambda v: v > 0)
    out = lambda v, lo, hi: F.greatest(F.lit(0.0), lo - v) + F.greatest(F.lit(0.0), v - hi)
    dist = F.transform(F.arrays_zip(gold_points.alias("g"), pred_points.alias("p"), spread.alias("s"), visible.alias("v")), lambda r: F.struct(
        F.when(seen, F.pow(r["p"][0] - r["g"][0], 2) + F.pow(r["p"][1] - r["g"][1], 2)).otherwise(
            F.pow(out(r["p"][0], x0, x1), 2) + F.pow(out(r["p"][1], y0, y1), 2)).alias("d"),
        r["s"].alias("s"), (~seen | (r["v"] > 0)).alias("use")))
    used = F.filter(dist, lambda r: r["use"])
    return F.aggregate(used, F.lit(0.0), lambda a, r: a + F.exp(-r["d"] / r["s"] / (area + 2.220446049250313e-16) / 2)) / F.size(used)
