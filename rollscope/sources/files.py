"""File sources and sinks: strict and tolerant JSON lines, scenes, scores, manifests, buffers, exports."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from rollscope.operators import ranking
from rollscope.operators.skew import null_safe_join
from rollscope.session import ensure_checkpoint_dir


def scratch(spark: SparkSession, name: str) -> str:
    """New folder on the shared storage that also holds checkpoints."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hpath, jvm.org.apache.hadoop.fs.Path


def scan_jsonl(spark: SparkSession, path: str | Sequence[str], schema: StructType | str) -> DataFrame:
    """Strict scan: declared schema, blank lines skipped, a bad line fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def scan_jsonl_tolerant(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Bad lines are dropped, a missing path is an empty table."""
    full = StructType(list(schema.fields)).add("_corrupt_record", StringType())
    try:
        df = spark.read.schema(full).option("mode", "PERMISSIVE").option(
            "columnNameOfCorruptRecord", "_corrupt_record").json(path)
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        return spark.createDataFrame([], schema)
    # Naming a data column next to the corrupt one keeps the reader from pruning the parse away.
    return df.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def scan_scene_docs(spark: SparkSession, folder: str, schema: StructType | str) -> DataFrame:
    """One JSON document per file, with the file name."""
    return (spark.read.schema(schema).option("multiLine", True).json(folder)
            .select("*", F.col("_metadata.file_name").alias("file_name")))


def list_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """Paths, sizes and times of the files of a folder; contents are never read."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True)
            .load(folder).select("path", "modificationTime", "length"))


def discover_pairs(files: DataFrame, need_scene: bool = True) -> DataFrame:
    """Base names that have an original, a modified image and, if needed, a scene file."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    kind = (F.when(name.endswith("_original.png"), F.lit("original")).when(name.endswith("_modified.png"), F.lit("modified"))
            .when(name.endswith("_comparison.json"), F.lit("scene")))
    stem = F.regexp_replace(name, r"_(original\.png|modified\.png|comparison\.json)$", "")
    per = files.select(stem.alias("base_name"), kind.alias("kind")).filter("kind is not null").groupBy("base_name").agg(
        F.bool_or(F.col("kind") == "original").alias("o"), F.bool_or(F.col("kind") == "modified").alias("m"),
        F.bool_or(F.col("kind") == "scene").alias("s"))
    return per.filter(F.col("o") & F.col("m") & (F.col("s") | F.lit(not need_scene))).select("base_name")


@dataclass(frozen=True)
class ManifestEntry:
    """One source: its rows, sampling rule, folder and default scoring method."""

    data: DataFrame
    sampling: str = "all"
    folder: str = ""
    method: str | None = None


def manifest_union_sample(entries: Sequence[ManifestEntry], pos: str, key: str, seed: int = 0) -> DataFrame:
    """Sample each source by its own rule and union them."""
    out = None
    for e in entries:
        part = ranking.take_by_mode(e.data, e.sampling, F.col(pos), key, seed)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("empty manifest")
    return out


def manifest_with_method(entries: Sequence[ManifestEntry], method: str, image: str) -> DataFrame:
    """Union of sources with their folder in front of images; a row's own method wins over the source's."""
    out = None
    for e in entries:
        part = e.data.withColumn(method, F.coalesce(F.col(method), F.lit(e.method)))
        if e.folder:
            part = part.withColumn(image, join_folder(e.folder, F.col(image)))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("empty manifest")
    return out


def join_folder(folder: str, images: Column) -> Column:
    return F.transform(images, lambda p: F.concat(F.lit(folder.rstrip("/") + "/"), p))


def conversation_reshape(rows: DataFrame, talk: str, image: str, folder: str) -> DataFrame:
    """First two conversation values as problem and solution; tags stripped; one or many images as paths."""
    c = F.col(talk)
    problem = F.trim(F.regexp_replace(F.get(c, F.lit(0)), r"<image>\n?", ""))
    solution = F.trim(F.regexp_replace(F.get(c, F.lit(1)), r"</?answer>", ""))
    return rows.withColumns({"problem": problem, "solution": solution, "image_path": join_folder(folder, F.col(image))})


def sink_jsonl_atomic(df: DataFrame, path: str) -> None:
    """Write to a sibling folder and swap it in; a failed write leaves the old output untouched."""
    spark = df.sparkSession
    staging = f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"
    df.write.mode("error").json(staging)
    fs, target, Path = _fs(spark, path)
    old = Path(f"{path.rstrip('/')}.old-{uuid.uuid4().hex}")
    had = fs.exists(target)
    if had and not fs.rename(target, old):
        raise OSError(f"cannot move the old output away: {path}")
    if not fs.rename(Path(staging), target):
        if had:
            fs.rename(old, target)
        raise OSError(f"cannot publish: {path}")
    if had:
        fs.delete(old, True)


def sink_buffers(scored: DataFrame, path: str, buffer: str = "buffer") -> None:
    """One output folder per buffer."""
    scored.write.mode("overwrite").partitionBy(buffer).json(path)


def sink_training_export(replays: Mapping[str, DataFrame], grpo: DataFrame, path: str) -> DataFrame:
    """Write the replay union and the nested records; return the counts per part, read back from the output."""
    from rollscope.operators.exports import union_replays

    spark = grpo.sparkSession
    union_replays(dict(replays)).write.mode("overwrite").json(f"{path}/sft_replay")
    grpo.write.mode("overwrite").json(f"{path}/grpo_tasks")
    sft = spark.read.schema("source_buffer string").json(f"{path}/sft_replay")
    tasks = spark.read.schema("task_id string").json(f"{path}/grpo_tasks")
    return sft.groupBy(F.col("source_buffer").alias("part")).agg(F.count(F.lit(1)).alias("cnt")).unionByName(
        tasks.agg(F.count(F.lit(1)).alias("cnt")).select(F.lit("grpo").alias("part"), "cnt"))


def scan_step_dumps(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """All step_N/rankR rows with step and rank taken from the path; folders may be partition folders."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(f"{path}/*step_*/*rank*")
    return with_step_and_rank(df)


def with_step_and_rank(df: DataFrame) -> DataFrame:
    file = F.col("_metadata.file_path")
    return df.select("*", F.regexp_extract(file, r"step_(\d+)", 1).cast("bigint").alias("global_step"),
                     F.regexp_extract(file, r"rank(\d+)", 1).cast("bigint").alias("rank"))


def scan_table(spark: SparkSession, path: str, kind: str, columns: Sequence[str]) -> DataFrame:
    """Score or prediction table as text columns: csv, tsv, JSON lines or split JSON (columns + data)."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    if kind in ("csv", "tsv"):
        return (spark.read.schema(schema).option("header", True).option("sep", "\t" if kind == "tsv" else ",")
                .option("multiLine", True).option("maxCharsPerColumn", -1).option("quote", '"').option("escape", '"')
                .option("mode", "FAILFAST").csv(path))
    if kind == "json":
        return scan_jsonl(spark, path, schema)
    if kind == "split_json":
        doc = spark.read.schema("columns array<string>, data array<array<string>>").option("multiLine", True).json(path)
        rows = doc.select(F.explode(F.transform("data", lambda r: F.map_from_arrays(F.col("columns"), r))).alias("r"))
        return rows.select(*[F.col("r")[c].alias(c) for c in columns])
    raise ValueError(f"unsupported table kind: {kind}")


# A longer file is hashed in parts: as one row it would be in one task, and beyond 2 GB no row.
WHOLE_FILE = 256 << 20
BYTE_ORDER_MARK = b"\xef\xbb\xbf"


class _Sha256:
    """A sha256 that another task can carry on: OpenSSL's context as bytes, which hashlib keeps to itself."""

    def __init__(self, state: bytes | None = None) -> None:
        import _hashlib

        crypto = ctypes.CDLL(_hashlib.__file__)
        crypto.SHA256_Update.argtypes = (ctypes.c_char_p, ctypes.c_char_p, ctypes.c_size_t)
        # Eight words, the length in bits, a block of 64 bytes, its used bytes and the digest's size.
        self.crypto, self.context = crypto, ctypes.create_string_buffer(state or b"", 112)
        if state is None:
            crypto.SHA256_Init(self.context)

    def update(self, data: bytes) -> None:
        self.crypto.SHA256_Update(self.context, data, len(data))

    def state(self) -> bytes:
        return self.context.raw

    def hexdigest(self) -> str:
        out = ctypes.create_string_buffer(32)
        self.crypto.SHA256_Final(out, self.context)
        return out.raw.hex()


def _hashed_lines(state: bytes, at: int, first: bool):
    """Function over Arrow batches of lines and the starts of their splits: one row (state, bytes hashed, last start).

    A line feed is hashed before each line but the file's first, so whether the file ends with one is left open.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha, n, last, head = _Sha256(state), 0, at, first
        for batch in batches:
            if not len(batch):
                continue
            starts = batch.column(1).to_numpy()
            if starts[0] < last or (starts[1:] < starts[:-1]).any():
                raise ValueError("splits of a file out of order")
            data = b"\n".join([*([] if head else [b""]), *batch.column(0).to_pylist()])
            sha.update(data)
            n, last, head = n + len(data), int(starts[-1]), False
        yield pa.RecordBatch.from_pydict({"state": [sha.state()], "n": [n], "at": [last]}, PART)

    return run


PART = pa.schema([("state", pa.binary()), ("n", pa.int64()), ("at", pa.int64())])


def _in_parts(spark: SparkSession, paths: dict[str, int], head: bytes = b"") -> dict[str, str]:
    """sha256 of the files (path to length) that are `head` and lines; others are absent.

    The splits of a file are hashed one after another, each in its own task, and hand over the state; files run in parallel.
    """
    lines, done = {}, {}
    for path in paths:
        name = re.sub(r"([\[\]{}*?\\])", r"\\\1", path)
        lines[path] = spark.read.option("lineSep", "\n").text(name).select(F.col("value").cast("binary"), F.col("_metadata.file_block_start"))
        sha = _Sha256()
        sha.update(head)
        done[path] = sha.state(), len(head), 0
    parts = {path: df.rdd.getNumPartitions() for path, df in lines.items()}
    for i in range(max(parts.values(), default=0)):
        now = [path for path in paths if i < parts[path]]
        each = [lines[path].mapInArrow(_hashed_lines(done[path][0], done[path][2], done[path][1] == len(head)),
                                       "state binary, n long, at long").rdd for path in now]
        offsets = accumulate([parts[path] for path in now], initial=0)
        rows = spark.sparkContext.runJob(spark.sparkContext.union(each), list, [o + i for o, _ in zip(offsets, now)])
        for path, r in zip(now, rows):
            done[path] = bytes(r["state"]), done[path][1] + r["n"], r["at"]
    out = {}
    for path, (state, n, _) in done.items():
        sha = _Sha256(state)
        if n == paths[path] - 1:
            sha.update(b"\n")
        if n in (paths[path], paths[path] - 1):
            out[path] = sha.hexdigest()
    return out


def file_fingerprints(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """sha256 per file. A file of at most WHOLE_FILE bytes is hashed as one row, a longer one when called, split by split.

    Splits are those of Spark's text reader, cut at line feeds: a stretch without any is held in memory. Where the lines do
    not make up the file, as with a compressed one, it is hashed as one row like the others.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    large = {r["path"]: r["length"] for r in files.filter(F.col("length") > WHOLE_FILE).select("path", "length").collect()}
    found = _in_parts(spark, large)
    # The text reader passes over a byte order mark.
    found |= _in_parts(spark, {p: n for p, n in large.items() if p not in found}, BYTE_ORDER_MARK)
    name = F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name")
    digest = F.sha2("content", 256).alias("sha256")
    out = files.filter(F.col("length") <= WHOLE_FILE).select(name, digest)
    whole = [p for p in large if p not in found]
    if whole:
        out = out.unionByName(files.filter((F.col("length") > WHOLE_FILE) & F.col("path").isin(whole)).select(name, digest))
    if found:
        out = out.unionByName(spark.createDataFrame(list(found.items()), "path string, sha256 string").select(name, "sha256"))
    return out


STAMP = ("path", "modificationTime", "length")


def latest_artifacts(files: DataFrame, cell: dict[str, Column], since: Column | None = None,
                     previous: DataFrame | None = None) -> DataFrame:
    """The newest eligible file of each cell of a listing; `cell` names columns over its path.

    Eligible is what was modified at or after `since` and does not stand unchanged (path, time and length) in the
    `previous` listing. Of files with one time the greatest path is taken. Contents are not read.
    """
    fresh = files if since is None else files.filter(F.col("modificationTime") >= since)
    if previous is not None:
        fresh = fresh.join(previous.select(*STAMP).distinct(), list(STAMP), "left_anti")
    newest = F.max(F.struct("modificationTime", "path", "length")).alias("f")
    return fresh.groupBy(*[c.alias(n) for n, c in cell.items()]).agg(newest).select(*cell, *[f"f.{c}" for c in STAMP])


def run_statuses(expected: DataFrame, latest: DataFrame, documents: DataFrame, cell: list[str], schema: str) -> DataFrame:
    """Each expected cell (with its `model_name` and `mode`) with its status document, parsed, and what is wrong with it.

    A cell is judged by its newest eligible file alone: a wrong one is not replaced by an older one. `documents` has
    `path` and `content`; `schema` must name model_name and mode. A document without a mode suits any mode.
    """
    parsed = F.from_json(F.col("content").cast("string"), schema + ", _corrupt_record string",
                         {"columnNameOfCorruptRecord": "_corrupt_record"})
    read = documents.join(latest.select("path"), "path", "left_semi").select("path", parsed.alias("status"))
    rows = null_safe_join(expected, latest.select(*cell, "path"), cell, "left").join(read, "path", "left")
    bad = F.col("status").isNull() | F.col("status._corrupt_record").isNotNull()
    problem = (F.when(F.col("path").isNull(), F.lit("no status from this run")).when(bad, F.lit("unreadable status"))
               .when(~F.col("status.model_name").eqNullSafe(F.col("model_name")), F.lit("another model"))
               .when(F.col("status.mode") != F.col("mode"), F.lit("another mode")))
    return rows.withColumn("problem", problem)


def read_documents(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """Paths and whole contents of small files, one row per file."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True)
            .load(folder).select("path", "content"))
