"""Newest eligible file per cell, judged by its own content."""

import json
import os

from pyspark.sql import functions as F

from rollscope.sources import files as S

SCHEMA = "model_name string, mode string"


def test_newest_eligible_file(spark, tmp_path):
    def leave(name, at, **doc):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text(json.dumps(doc) if doc else "{")
        os.utime(path, (at, at))

    leave("a/old.json", 1000, model_name="m")
    leave("a/new.json", 3000, model_name="m", mode="all")
    leave("b/x.json", 2000, model_name="m")
    leave("b/y.json", 2000, model_name="other")
    leave("c/stale.json", 500, model_name="m")
    leave("d/seen.json", 2500, model_name="m")
    leave("d/older.json", 2400, model_name="m", mode="infer")
    leave("e/broken.json", 2500)
    listing = S.list_files(spark, str(tmp_path), "*.json")
    cells = {"cell": F.regexp_extract("path", r"/([a-z])/[^/]*$", 1)}
    previous = listing.filter("path like '%seen.json'")
    latest = S.latest_artifacts(listing, cells, since=F.timestamp_seconds(F.lit(1000)), previous=previous)
    assert sorted((r.cell, r.path.rsplit("/", 1)[1]) for r in latest.collect()) == [
        ("a", "new.json"), ("b", "y.json"), ("d", "older.json"), ("e", "broken.json")]
    expected = spark.createDataFrame([(c, "m", "all") for c in "abcdef"], "cell string, model_name string, mode string")
    out = S.run_statuses(expected, latest, S.read_documents(spark, str(tmp_path), "*.json"), ["cell"], SCHEMA)
    assert {r.cell: r.problem for r in out.collect()} == {
        "a": None, "b": "another model", "c": "no status from this run", "d": "another mode", "e": "unreadable status",
        "f": "no status from this run"}
    known = spark.createDataFrame(listing.collect(), listing.schema)
    # A changed file is eligible again although its path was listed before.
    leave("d/seen.json", 2600, model_name="m")
    again = S.latest_artifacts(S.list_files(spark, str(tmp_path), "*.json"), cells, previous=known)
    assert {r.cell: r.path.rsplit("/", 1)[1] for r in again.collect()}["d"] == "seen.json"
