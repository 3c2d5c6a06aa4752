import json

import pytest

from rollscope.operators import detection

DOCS = "doc int, body string"


def frame(spark, *bodies):
    return spark.createDataFrame([(i, b if isinstance(b, str) or b is None else json.dumps(b)) for i, b in enumerate(bodies)], DOCS)


def test_tables_keep_the_last_entry_of_an_id(spark):
    ann = [{"id": 1, "image_id": 5, "category_id": 2, "bbox": [0, 0, 2, 3], "area": 6, "iscrowd": 0},
           {"id": 1, "image_id": 6, "category_id": 3, "bbox": [1, 1, 2, 2], "area": 4, "iscrowd": 1, "extra": "x"}]
    docs = frame(spark, {"annotations": ann, "images": [{"id": 5}, {"id": 6}], "categories": [{"id": 2, "name": "cup"}, {"id": 3, "name": "box"}]},
                 {"annotations": ann[:1]}, {})
    t = {k: v.collect() for k, v in detection.coco_tables(docs).items()}
    assert sorted((r.doc, r.id, r.image_id, r.area, r.iscrowd) for r in t["annotations"]) == [(0, 1, 6, 4.0, 1), (1, 1, 5, 6.0, 0)]
    assert sorted(r.name for r in t["categories"]) == ["box", "cup"] and len(t["images"]) == 2
    # Both entries of the repeated id count here; document 1 names no categories.
    assert sorted((r.doc, r.category_id, r.image_id) for r in t["category_images"]) == [(0, 2, 5), (0, 3, 6)]
    assert all(v.count() == 0 for v in detection.coco_tables(docs.limit(0)).values())


@pytest.mark.parametrize("text", ["[1, 2]", "{broken", None])
def test_other_texts_raise(spark, text):
    with pytest.raises(Exception, match="not an annotation document"):
        detection.coco_tables(frame(spark, text))["annotations"].collect()


def images(spark, n):
    return spark.createDataFrame([(d, i) for d in range(n) for i in (1, 2)], "doc int, id int")


def test_result_kinds(spark):
    one = lambda **k: {"image_id": 1, "category_id": 4, "score": 0.5, **k}
    docs = frame(spark, [one(bbox=[1, 2, 3, 4]), one(bbox=[0, 0, 2, 2], segmentation=[[0, 0, 1, 0, 1, 1]])],
                 [one(bbox=[], segmentation=[[0, 0, 4, 0, 4, 4, 0, 4], [10, 10, 12, 10, 10, 13]])],
                 [one(keypoints=[3, 9, 2, 7, 1, 0])], [one(caption="a cup")], [])
    got = {(r.doc, r.id): r for r in detection.result_tables(docs, images(spark, 5)).collect()}
    assert sorted(got) == [(0, 1), (0, 2), (1, 1), (2, 1), (3, 1)]
    assert (got[0, 1].kind, got[0, 1].area, got[0, 1].polygon, got[0, 1].iscrowd) == ("box", 12.0, [[1, 2, 1, 6, 4, 6, 4, 2]], 0)
    assert got[0, 2].polygon == [[0, 0, 1, 0, 1, 1]] and got[0, 2].area == 4.0
    assert (got[1, 1].kind, got[1, 1].area, got[1, 1].box) == ("polygon", 19.0, [0, 0, 12, 13])
    assert (got[2, 1].kind, got[2, 1].area, got[2, 1].box, got[2, 1].iscrowd) == ("points", 32.0, [3, 1, 4, 8], None)
    assert (got[3, 1].kind, got[3, 1].area, got[3, 1].box) == ("caption", None, None)


@pytest.mark.parametrize("bad, message", [
    ({"image_id": 9, "bbox": [1, 2, 3, 4]}, "unknown images"), ({"image_id": 1, "keypoints": [1, 2, 3]}, "lacks what its kind"),
    ({"image_id": 1, "bbox": [1, 2, 3]}, "lacks what its kind")])
def test_refusals(spark, bad, message):
    docs = frame(spark, [{"image_id": 1, "bbox": [1, 2, 3, 4]}, bad])
    with pytest.raises(Exception, match=message):
        detection.result_tables(docs, images(spark, 1)).collect()
