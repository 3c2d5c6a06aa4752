"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from rollscope.session import ensure_checkpoint_dir

# A word of the contracts: anything between ASCII white space. `bytes.split()` cuts at the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new folder below the checkpoint folder that all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write rows as a Parquet table in the shared folder and read them back: lineage is cut, lost executors lose nothing."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Remove tables made by `stored` that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


# Bits per wanted key, and the most bits, of the filter below: 16 MB at most are sent to the executors.
KEY_BITS, MOST_KEY_BITS = 16, 1 << 27


def with_bit(df: DataFrame, key: Column, wanted: DataFrame, name: str, seed: int = 3) -> DataFrame:
    """Rows plus a boolean: true where the key is in the one long column of `wanted`, and for a few other rows.

    A bitmap of hashed keys is applied where the rows are, so nothing is shuffled. Its size is bounded; with more keys than it
    has room for it is true for more rows, but never false for a match. Another seed errs on other rows.
    """
    column, names = wanted.columns[0], df.columns
    bits = 1 << 15
    n = wanted.count()
    while bits < min(MOST_KEY_BITS, KEY_BITS * n):
        bits *= 2

    def place(c: Column) -> Column:
        return F.pmod(F.xxhash64(c, F.lit(seed)), F.lit(bits))

    at = place(F.col(column)) + 1
    parts = wanted.select(at.alias("at")).groupBy((F.bitmap_bucket_number("at") - 1).alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect()
    # At most 4096 rows of 512 words.
    table = [(r["part"], np.frombuffer(r["bits"], "<i8").tolist()) for r in parts]
    words = df.sparkSession.createDataFrame(table, "__part long, __words array<long>")
    here = df.withColumn("__place", place(key)).join(F.broadcast(words), F.shiftright("__place", 15) == F.col("__part"), "left")
    bit = F.get("__words", F.shiftright(F.col("__place"), 6).bitwiseAND(511).cast("int"))
    hit = F.expr("shiftrightunsigned(__bit, cast(__place & 63 as int)) & 1") == 1
    return here.withColumn("__bit", bit).select(*[F.col(f"`{c}`") for c in names], F.coalesce(hit, F.lit(False)).alias(name))


def maybe_in(df: DataFrame, key: Column, wanted: DataFrame, other: bool = False) -> DataFrame:
    """Rows whose key is in the one long column of `wanted`, and a few more; with `other` the rest of the rows.

    Judged by `with_bit` where the rows are, so that a join that follows shuffles little else than its matches.
    """
    found = with_bit(df, key, wanted, "__hit")
    return found.filter(~F.col("__hit") if other else F.col("__hit")).drop("__hit")


def crc_mod(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % n


def text_values(col: pa.Array | pa.ChunkedArray) -> Iterator[bytes]:
    """UTF-8 bytes of each text, null as empty, without making Python strings."""
    if isinstance(col, pa.ChunkedArray):
        for chunk in col.chunks:
            yield from text_values(chunk)
        return
    col = col.cast(pa.large_binary()) if not pa.types.is_large_binary(col.type) else col
    if len(col) == 0:
        return
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, np.int64, len(col) + 1, col.offset * 8)
    view = memoryview(data) if data is not None else memoryview(b"")
    valid = col.is_valid().to_numpy(zero_copy_only=False)
    for i in range(len(col)):
        yield bytes(view[at[i]:at[i + 1]]) if valid[i] else b""


def add_columns(df: DataFrame, make: Callable[[], Callable[[list[bytes]], list]], fields: T.StructType,
                text: str = "text", slice_bytes: int = 2 << 20, keep_text: bool = False) -> DataFrame:
    """Rows plus columns computed from each text in Arrow batches.

    `make()` runs once per task and returns a function from a list of texts (UTF-8, null as empty) to one value list
    or array per field. Texts go to it in slices of about `slice_bytes`, a single longer text alone. An input column
    with the name of a result column is replaced by the result. The text itself returns only if `keep_text`. The session's
    Arrow batches are cut to BATCH_ROWS rows from here on.
    """
    kept = [f for f in df.schema.fields if f.name not in fields.names and (keep_text or f.name != text)]
    own = next((i for i, f in enumerate(kept) if f.name == text), len(kept))
    src = df.select(*[F.col(f"`{f.name}`") for f in kept], *([F.col(f"`{text}`")] if own == len(kept) else []))
    out = T.StructType([*kept, *fields.fields])
    types = [to_arrow_type(f.dataType) for f in fields.fields]
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = started(make)
        for batch in batches:
            rest = [batch.column(i) for i in range(len(kept))]
            for lo, part in slices(text_values(batch.column(own)), slice_bytes):
                cols = [pa.array(v, type=t) for v, t in zip(fn(part), types)]
                yield pa.RecordBatch.from_arrays([*[c.slice(lo, len(part)) for c in rest], *cols], names=out.names)

    return src.mapInArrow(run, out)


def slices(texts: Iterator[bytes], limit: int) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive runs of texts of about `limit` bytes with the index of their first text."""
    part: list[bytes] = []
    lo = size = 0
    for i, x in enumerate(texts):
        if part and size + len(x) > limit:
            yield lo, part
            part, lo, size = [], i, 0
        part.append(x)
        size += len(x)
    if part:
        yield lo, part


# Long texts make Arrow batches of the default 10,000 rows large, in the executor as in its Python workers.
BATCH_ROWS = 1000
_HELD: dict = {}


def held(key: tuple, make: Callable):
    """What a worker process keeps between tasks: the last such object alone, so two tokenizers never share its memory."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    _HELD["used"] = True
    return _HELD[key]


def started(make: Callable[[], Callable]) -> Callable:
    """What `make()` returns, after a worker has let go of what other operators left in it."""
    _HELD.pop("used", None)
    fn = make()
    if not _HELD.pop("used", False) and _HELD:
        _HELD.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()
    return fn


class WordIds(dict):
    """Numbers words in order of appearance: `map(ids.__getitem__, words)`. New words are listed in `new`."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class WordTable:
    """Per-word values computed once per distinct word while the word is in use.

    `encode(words)` returns one int32 array per word. Once more than `limit` words are held, the less used half of the limit
    stays behind and the uses of the others count half, so memory stays bounded and frequent words stay. A word that went is
    encoded again when it comes back; no word is left out.
    """

    def __init__(self, encode: Callable[[list[bytes]], list], limit: int = 300_000) -> None:
        self.encode, self.limit = encode, limit
        self.ids = WordIds()
        self.n = np.zeros(0, np.int32)
        self.start = np.zeros(1, np.int64)
        self.flat = np.zeros(0, np.int32)
        self.uses = np.zeros(0, np.int64)

    def sweep(self) -> None:
        """Keep the more used half of the limit."""
        keep = np.sort(np.argsort(-self.uses, kind="stable")[:max(1, self.limit // 2)])
        flags = np.zeros(len(self.n), bool)
        flags[keep] = True
        words = [w for w, f in zip(self.ids, flags.tolist()) if f]
        self.ids = WordIds()
        for w in words:
            self.ids[w]
        self.ids.new = []
        self.flat = self.flat[np.repeat(flags, self.n)]
        self.n, self.uses = self.n[keep], self.uses[keep] // 2
        self.start = np.concatenate([[0], np.cumsum(self.n, dtype=np.int64)])

    def lookup(self, words: list[bytes]) -> np.ndarray:
        """Row numbers of the words in `n`, `start` and `flat`; valid until the next call."""
        if len(self.ids) > self.limit:
            self.sweep()
        rows = np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))
        if self.ids.new:
            got = self.encode(self.ids.new)
            n = np.fromiter(map(len, got), np.int32, len(got))
            self.n = np.concatenate([self.n, n])
            self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(n, dtype=np.int64)])
            self.flat = np.concatenate([self.flat, *[np.asarray(x, np.int32) for x in got]]) if got else self.flat
            self.ids.new = []
        uses = np.bincount(rows, minlength=len(self.n))
        uses[:len(self.uses)] += self.uses
        self.uses = uses
        return rows

    def tokens(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of all words in a row, and the number of values of each word."""
        n = self.n[rows].astype(np.int64)
        ends = np.cumsum(n)
        at = np.repeat(self.start[rows] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)
        return self.flat[at], n
