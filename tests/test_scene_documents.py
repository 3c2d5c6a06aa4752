"""Every refusal of the scene check is one changed document."""

import copy
import json

from rollscope.operators.scene_documents import verify_scene_documents

RED = {"color": "red", "shape": "cube", "size": "small", "material": "metal"}
BLUE = dict(RED, color="blue")
BALL = dict(RED, shape="sphere")
TALL = dict(BALL, size="large")
SCENE = {"original_scene": {"objects": [RED, dict(BALL, index=1), RED]},
         "modification": {"replaced_objects": [{"index": 2, "original": dict(RED, color=" Red "), "replacement": BLUE},
                                               {"index": 1, "original": BALL, "replacement": TALL}]},
         "modified_scene": {"objects": [RED, TALL, BLUE]}, "original_image": "a.png", "modified_image": "b.png"}
FACTS = [{"attribute": "color", "before": "red", "after": "blue"}, {"attribute": "size", "before": "small", "after": "large"}]
WHOLE = {"scene_path": "/d/s/x.json", "image_path": ["a.png", "b.png", "a.png"], "changes": FACTS[::-1],
         "metadata": {"spy_player": 2, "num_players": 3}}
PART = {"scene_path": "/d/s/x.json", "image_path": ["k.png", "/d/s/a.png"], "image": ["k.png", "a.png"], "changes": FACTS[1:],
        "metadata": {"spy_player": 1, "variant": {"keep_indices": [1], "num_attr_changes": 1, "num_changed_objects": 1,
                                                   "spliced": True, "spy_image_path": "k.png", "civilian_image_path": "a.png"}}}
FILES = ["/d/s/a.png", "/d/s/b.png", "/d/replacement_images/k.png"]


def changed(doc, path, value):
    doc = copy.deepcopy(doc)
    at = doc
    for step in path[:-1]:
        at = at[step]
    at[path[-1]] = value
    return doc


def edit(i, field):
    return ("modification", "replaced_objects", i, field)


def variant(field):
    return ("metadata", "variant", field)


CASES = [
    (None, WHOLE, SCENE), (None, PART, SCENE), (None, WHOLE, changed(SCENE, ("modified_scene",), None)),
    ("document", changed(WHOLE, ("metadata",), None), SCENE), ("document", changed(WHOLE, ("scene_path",), "/none"), SCENE),
    ("document", WHOLE, changed(SCENE, edit(0, "index"), "two")), ("document", WHOLE, changed(SCENE, edit(0, "index"), True)),
    ("document", WHOLE, changed(SCENE, edit(0, "index"), 2.5)), ("document", changed(WHOLE, ("metadata", "spy_player"), "2"), SCENE),
    ("objects", WHOLE, changed(SCENE, ("original_scene", "objects"), [])),
    ("objects", WHOLE, changed(SCENE, ("modification", "replaced_objects"), [])),
    ("objects", WHOLE, changed(SCENE, ("original_scene",), None)),
    ("object attributes", WHOLE, changed(SCENE, ("original_scene", "objects", 0, "color"), "mauve")),
    ("object attributes", WHOLE, changed(SCENE, ("original_scene", "objects", 0), {"color": "red"})),
    ("edit index", WHOLE, changed(SCENE, edit(0, "index"), 3)), ("edit index", WHOLE, changed(SCENE, edit(0, "index"), -1)),
    ("edit index", WHOLE, changed(SCENE, edit(0, "index"), 1)), ("edit index", WHOLE, changed(SCENE, edit(0, "index"), None)),
    ("edit", WHOLE, changed(SCENE, edit(0, "original"), BALL)), ("edit", WHOLE, changed(SCENE, edit(0, "replacement"), RED)),
    ("edit", WHOLE, changed(SCENE, edit(0, "replacement"), None)),
    ("stated index", WHOLE, changed(SCENE, edit(1, "replacement"), dict(TALL, index=2))),
    ("stated index", WHOLE, changed(SCENE, ("original_scene", "objects", 1, "index"), 0)),
    ("keep", changed(PART, variant("keep_indices"), []), SCENE), ("keep", changed(PART, variant("keep_indices"), [2]), SCENE),
    ("keep", changed(PART, variant("keep_indices"), [1, 1]), SCENE), ("keep", changed(PART, variant("keep_indices"), None), SCENE),
    ("facts", changed(PART, variant("keep_indices"), [0]), SCENE), ("facts", changed(WHOLE, ("changes",), FACTS + FACTS[:1]), SCENE),
    ("facts", changed(WHOLE, ("changes",), None), SCENE),
    ("attribute count", changed(PART, variant("num_attr_changes"), 2), SCENE),
    ("modified scene", WHOLE, changed(SCENE, ("modified_scene", "objects", 2), RED)),
    ("modified scene", WHOLE, changed(SCENE, ("modified_scene", "objects"), [RED, TALL])),
    ("modified scene", WHOLE, changed(SCENE, ("modified_scene",), {})),
    ("images", WHOLE, changed(SCENE, ("original_image",), "gone.png")), ("images", WHOLE, changed(SCENE, ("modified_image",), "a.png")),
    ("images", changed(PART, variant("spy_image_path"), None), SCENE),
    ("partial image", changed(PART, variant("spy_image_path"), "b.png"), SCENE),
    ("spliced", changed(PART, variant("spliced"), False), SCENE),
    ("changed objects", changed(PART, variant("num_changed_objects"), 2), SCENE),
    ("civilian image", changed(PART, variant("civilian_image_path"), "b.png"), SCENE),
    ("civilian image", changed(PART, variant("civilian_image_path"), None), SCENE),
    ("players", changed(WHOLE, ("image_path",), ["b.png"]), SCENE), ("players", changed(WHOLE, ("metadata", "spy_player"), 4), SCENE),
    ("players", changed(WHOLE, ("metadata", "num_players"), 2), SCENE), ("players", changed(WHOLE, ("image_path",), None), SCENE),
    ("player images", changed(WHOLE, ("metadata", "spy_player"), 1), SCENE),
    ("player images", changed(WHOLE, ("image_path", 2), "gone.png"), SCENE),
    ("image alias", changed(PART, ("image",), ["a.png", "a.png"]), SCENE), ("image alias", changed(PART, ("image",), ["k.png"]), SCENE),
]


def test_every_refusal(spark):
    tasks, scenes = [], []
    for i, (_, task, scene) in enumerate(CASES):
        folder = f"/d/s{i}/s"
        local = json.dumps(task).replace("/d/s/", folder + "/")
        tasks.append((i, local))
        scenes.append((folder + "/x.json", json.dumps(scene)))
    files = [(f.replace("/d/", f"/d/s{i}/"),) for i in range(len(CASES)) for f in FILES]
    tasks += [(1000, None), (1001, "{"), (0, tasks[0][1])]
    got = verify_scene_documents(spark.createDataFrame(tasks, "task_id int, doc string"),
                                 spark.createDataFrame(scenes, "path string, doc string"),
                                 spark.createDataFrame(files, "path string")).collect()
    want = [(i, reason, reason is None) for i, (reason, _, _) in enumerate(CASES)]
    want += [(1000, "document", False), (1001, "document", False), (0, None, True)]
    assert sorted((r.task_id, r.reason or "", r.verified) for r in got) == sorted((i, r or "", v) for i, r, v in want)


def test_empty_tables_and_a_scene_listed_twice(spark):
    task = spark.createDataFrame([(1, json.dumps(WHOLE))], "task_id int, doc string")
    scene = spark.createDataFrame([("/d/s/x.json", json.dumps(SCENE))], "path string, doc string")
    files = spark.createDataFrame([(f,) for f in FILES], "path string")
    check = lambda t, s, f: [(r.reason, r.verified) for r in verify_scene_documents(t, s, f).collect()]
    assert check(task, scene, files) == [(None, True)]
    assert check(task, scene, files.union(files)) == [(None, True)]
    assert check(task, scene.union(scene), files) == [("document", False)]
    assert check(task, scene.limit(0), files) == [("document", False)]
    assert check(task, scene, files.limit(0)) == [("images", False)]
    assert check(task.limit(0), scene, files) == []
