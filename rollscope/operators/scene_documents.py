"""Whole-document checks of edited scenes: tasks, scene documents and a file listing must agree."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollscope.functions import facts as FX
from rollscope.functions.text import let, strip
from rollscope.session import written

OBJECT = "struct<" + ",".join(f"{a}:string" for a in FX.ATTRIBUTES) + ",index:bigint>"
SCENE = (f"original_scene struct<objects:array<{OBJECT}>>, modified_scene struct<objects:array<{OBJECT}>>, "
         f"modification struct<replaced_objects:array<struct<index:bigint,original:{OBJECT},replacement:{OBJECT}>>>, "
         "original_image string, modified_image string, _corrupt_record string")
TASK = ("scene_path string, image_path array<string>, image array<string>, "
        "changes array<struct<attribute:string,before:string,after:string>>, "
        "metadata struct<spy_player:bigint,num_players:bigint,variant:struct<keep_indices:array<bigint>,"
        "num_attr_changes:bigint,num_changed_objects:bigint,spliced:boolean,spy_image_path:string,"
        "civilian_image_path:string>>, _corrupt_record string")


def parsed(document: Column, schema: str) -> Column:
    """A document as a struct; `_corrupt_record` is set where it is no JSON or a value has another type."""
    return F.from_json(document, schema, {"columnNameOfCorruptRecord": "_corrupt_record"})


def _clean(obj: Column) -> Column:
    return F.struct(*[F.lower(strip(obj[a])).alias(a) for a in FX.ATTRIBUTES])


def _known(clean: Column) -> Column:
    inside = [clean[a].isin(*FX.DOMAINS[a]) for a in FX.ATTRIBUTES]
    return F.coalesce(reduce(lambda x, y: x & y, inside), F.lit(False))


def _distinct_within(values: Column, limit: Column) -> Column:
    """Not empty, no value twice, all between 0 and below limit."""
    inside = F.forall(values, lambda i: F.coalesce((i >= 0) & (i < limit), F.lit(False)))
    return (F.size(values) > 0) & inside & (F.size(F.array_distinct(values)) == F.size(values))


def _apart(side: DataFrame) -> DataFrame:
    """One side of a join that never goes whole through the driver: sizes are estimated from compressed files and without the lengths of
    documents and lists, so a broadcast could be many times what it was planned for."""
    return side.hint("merge")


def resolve_paths(rows: DataFrame, key: str, scene_path: str, names: str, files: DataFrame) -> DataFrame:
    """(key, resolved): each different name of an array to the first existing path among those it may stand for.

    An absolute name stands for itself, another for a file beside the scene or in the sibling folder of replacement
    images. Existence is a join with the listing, never a call to a file system. Paths compare as text.
    """
    folder = F.regexp_replace(scene_path, r"/[^/]*$", "")
    above = F.regexp_replace(folder, r"/[^/]*$", "")
    once = rows.select(key, names, folder.alias("folder"), above.alias("above")).withColumn("name", F.explode(F.array_distinct(names)))
    tried = F.when(F.startswith("name", F.lit("/")), F.array("name")).otherwise(
        F.array(F.concat_ws("/", "folder", "name"), F.concat_ws("/", "above", F.lit("replacement_images"), "name")))
    candidates = once.filter("name <> ''").select(key, "name", F.posexplode(tried).alias("rank", "path"))
    met = candidates.join(_apart(files.select("path").distinct()), "path")
    # At most two entries per image that a single document names.
    found = F.array_sort(F.collect_set(F.struct("name", "rank", "path")))
    return met.groupBy(key).agg(F.map_from_entries(F.transform(let(found, lambda f: F.filter(
        f, lambda x, i: (i == 0) | (F.get(f, i - 1)["name"] != x["name"]))), lambda x: F.struct(x["name"], x["path"]))).alias("resolved"))


def _prepared(rows: DataFrame) -> DataFrame:
    """Parsed rows with cleaned objects and edits, kept positions and the facts these make."""
    cleaned = rows.withColumn("objects", F.transform("s.original_scene.objects", lambda o: F.struct(
        _clean(o).alias("is"), o["index"].alias("index")))).withColumn(
        "edits", F.transform("s.modification.replaced_objects", lambda e: F.struct(
            e["index"].alias("index"), _clean(e["original"]).alias("before"), _clean(e["replacement"]).alias("after"),
            F.array(e["original"]["index"], e["replacement"]["index"]).alias("stated"))))
    last = F.size("edits").cast("long") - 1
    kept = cleaned.withColumn("keep", F.when(
        F.col("t.metadata.variant").isNull(), F.sequence(F.least(last, F.lit(0).cast("long")), last))
        .otherwise(F.col("t.metadata.variant.keep_indices")))
    moved = lambda e: F.array_compact(F.array(*[F.when(
        e["before"][a] != e["after"][a], F.concat_ws(":", F.lit(a), e["before"][a], e["after"][a])) for a in FX.ATTRIBUTES]))
    chosen = F.transform("keep", lambda i: F.get("edits", i.cast("int")))
    return kept.withColumn("expected", F.array_sort(F.flatten(F.transform(chosen, moved))))


def _checks() -> list[tuple[str, Column]]:
    """Reasons and the conditions they stand for, in the order in which a refusal is reported; those on paths are absent."""
    objects, edits, keep, expected = (F.col(c) for c in ("objects", "edits", "keep", "expected"))
    meta, variant, players = F.col("t.metadata"), F.col("t.metadata.variant"), F.col("t.image_path")
    spy, whole, partial = meta["spy_player"], variant.isNull(), F.size(keep) < F.size(edits)
    target = lambda e: F.get(objects, e["index"].cast("int"))
    absent_or = lambda value, wanted: value.isNull() | (value == wanted)

    stated = F.array_sort(F.transform("t.changes", lambda c: F.concat_ws(":", c["attribute"], c["before"], c["after"])))
    rendered = F.transform(objects, lambda o, i: F.coalesce(
        F.get(F.filter(edits, lambda e: e["index"] == i), F.lit(0))["after"], o["is"]))
    return [
        ("document", F.col("t").isNotNull() & F.col("t._corrupt_record").isNull() & F.col("s").isNotNull()
         & F.col("s._corrupt_record").isNull() & meta.isNotNull()),
        ("objects", (F.size(objects) > 0) & (F.size(edits) > 0)),
        ("object attributes", F.forall(objects, lambda o: _known(o["is"]))),
        ("edit index", _distinct_within(F.transform(edits, lambda e: e["index"]), F.size(objects))),
        ("edit", F.forall(edits, lambda e: _known(e["before"]) & _known(e["after"]) & F.coalesce(
            (e["before"] == target(e)["is"]) & (e["before"] != e["after"]), F.lit(False)))),
        ("stated index", F.forall(edits, lambda e: F.forall(
            F.array_append(e["stated"], target(e)["index"]), lambda i: absent_or(i, e["index"])))),
        ("keep", whole | _distinct_within(keep, F.size(edits))),
        ("facts", F.coalesce(stated, F.array().cast("array<string>")) == expected),
        ("attribute count", absent_or(variant["num_attr_changes"], F.size(expected))),
        ("modified scene", F.col("s.modified_scene").isNull()
         | (F.transform("s.modified_scene.objects", _clean) == rendered)),
        ("images", None),
        ("partial image", None),
        ("spliced", absent_or(variant["spliced"], partial)),
        ("changed objects", absent_or(variant["num_changed_objects"], F.size(keep))),
        ("civilian image", None),
        ("players", (F.size(players) >= 2) & (spy >= 1) & (spy <= F.size(players))
         & absent_or(meta["num_players"], F.size(players))),
        ("player images", None),
        ("image alias", None),
    ]


def _path_checks() -> dict[str, Column]:
    """Conditions on the resolved paths, from a few columns of the task."""
    whole, partial, spy, count, names = (F.col(c) for c in ("whole", "partial", "spy", "players", "names"))
    image = lambda at: F.try_element_at("resolved", F.get(names, at.cast("int")))
    original, modified, civilian = image(F.lit(0)), image(F.lit(1)), image(F.lit(3))
    edited = F.when(whole, modified).otherwise(image(F.lit(2)))
    shown = F.forall(F.sequence(F.lit(0), count - 1), lambda i: F.coalesce(
        image(i + 4) == F.when(i + 1 == spy, edited).otherwise(original), F.lit(False)))
    aliased = F.forall(F.sequence(F.lit(0), count - 1), lambda i: image(i + 4).eqNullSafe(image(i + 4 + count)))
    return {
        "images": original.isNotNull() & edited.isNotNull() & (original != edited),
        "partial image": whole | ~partial | modified.isNull() | (edited != modified),
        "civilian image": whole | (civilian == original),
        "player images": shown,
        "image alias": F.col("aliases").isNull() | ((F.col("aliases") == count) & aliased),
    }


def verify_scene_documents(tasks: DataFrame, scenes: DataFrame, files: DataFrame, task_id: str = "task_id") -> DataFrame:
    """Per task: `verified`, and the first condition that failed as `reason` (null if none did).

    `tasks` has an id and a JSON `doc` (see TASK), `scenes` the `path` and JSON `doc` of each scene (see SCENE), `files`
    the `path` of every existing file. An edit names its object by list position, and its original must be that object;
    `keep_indices` are positions in the list of edits; facts are compared with repeats; a modified scene must be the full
    render; images must exist and the spy alone must see the edited one. A scene path listed twice is no document;
    null and unreadable documents are refused, repeated tasks get a row each.
    """
    one = scenes.groupBy(F.col("path").alias("__path")).agg(F.count(F.lit(1)).alias("__n"), F.min("doc").alias("__scene"))
    rows = tasks.select(task_id, "doc", parsed(F.col("doc"), TASK).alias("t")).withColumn("__path", F.col("t.scene_path"))
    rows = _prepared(rows.join(_apart(one.filter("__n = 1").select("__path", "__scene")), "__path", "left").select(
        task_id, "t", parsed(F.col("__scene"), SCENE).alias("s"), F.unhex(F.sha2(F.coalesce("doc", F.lit("")), 256)).alias("__key")))
    no_names = F.array().cast("array<string>")
    names = F.concat(F.array("s.original_image", "s.modified_image", "t.metadata.variant.spy_image_path",
                             "t.metadata.variant.civilian_image_path"),
                     F.coalesce("t.image_path", no_names), F.coalesce("t.image", no_names))
    size = lambda c: F.when(F.col(c).isNotNull(), F.size(c))
    # Only what the checks on paths need goes on: the documents are read once and not shuffled again.
    held = [F.lit(None).cast("boolean") if c is None else F.coalesce(c, F.lit(False)) for _, c in _checks()]
    rows = written(rows.select(
        task_id, "__key", F.array(*held).alias("held"), names.alias("names"), F.col("t.scene_path").alias("scene_path"),
        F.col("t.metadata.variant").isNull().alias("whole"), (F.size("keep") < F.size("edits")).alias("partial"),
        F.col("t.metadata.spy_player").alias("spy"), size("t.image_path").alias("players"), size("t.image").alias("aliases")))
    # Equal documents resolve to equal paths, so the document's digest is the key.
    paths = resolve_paths(rows, "__key", "scene_path", "names", files)
    on_paths = _path_checks()
    checks = [(name, on_paths[name] if name in on_paths else F.get("held", F.lit(i))) for i, (name, _) in enumerate(_checks())]
    refused = reduce(lambda rest, check: F.when(~F.coalesce(check[1], F.lit(False)), F.lit(check[0])).otherwise(rest),
                     reversed(checks), F.lit(None).cast("string"))
    out = rows.join(_apart(paths), "__key", "left").select(task_id, refused.alias("reason"))
    return out.withColumn("verified", F.col("reason").isNull())
