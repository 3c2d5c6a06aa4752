"""Fingerprints of files that are no row of `binaryFile`, which ends at 2 GB; here its limit is made small."""

import gzip
import hashlib
import random

from rollscope.sources import files


def test_files_too_long_for_a_row(spark, tmp_path, monkeypatch):
    rng = random.Random(2)
    noise = rng.randbytes(70_000)
    held = {"a.bin": noise, "b.bin": noise[:60_001].rstrip(b"\n") + b"\n", "c{1}.bin": b"\xef\xbb\xbf" + noise, "d.bin": b"\n" * 60_000,
            "e.bin": b"\xef\xbb\xbf" + b"ab\r\n\r" * 12_000 + b"\n", "f.bin": b"\n" + noise, "g.bin": noise[:40_000]}
    for name, data in held.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "other.txt").write_bytes(b"x")
    names = {"spark.sql.sources.binaryFile.maxLength": "50000", "spark.sql.files.maxPartitionBytes": "9000"}
    monkeypatch.setattr(files, "WHOLE_FILE", 50_000, raising=False)
    try:
        for name, value in names.items():
            spark.conf.set(name, value)
        got = {r.file_name: r.sha256 for r in files.file_fingerprints(spark, str(tmp_path), "*.bin").collect()}
    finally:
        for name in names:
            spark.conf.unset(name)
    assert got == {name: hashlib.sha256(data).hexdigest() for name, data in held.items()}


def test_a_compressed_file_is_hashed_as_it_is(spark, tmp_path, monkeypatch):
    data = gzip.compress(random.Random(1).randbytes(3000))
    (tmp_path / "a.gz").write_bytes(data)
    monkeypatch.setattr(files, "WHOLE_FILE", 1000, raising=False)
    got = [(r.file_name, r.sha256) for r in files.file_fingerprints(spark, str(tmp_path)).collect()]
    assert got == [("a.gz", hashlib.sha256(data).hexdigest())]
