"""Token ids in directly addressable files.

An id is cut into chunks of 8 bits. Level 0 holds the low byte of every id of a block; a continuation bitmap marks the
ids that have more, and level 1 holds the next byte of those only, and so on. A rank directory with the number of set
bits before each 512-bit stretch turns the position of an id in one level into its position in the next, so any token
is read without decoding a block. Blocks are rows of Parquet files: one shard per range of doc_id, blocks in order, with
the ids and lengths of their documents. Writers go through Spark, so the files may live in any store it reaches.

Defined results: null text is empty; every document ends with the end id, so it has at least one token; equal rows are
separate documents; rows of equal id stand in order of a hash of their text; very long texts are encoded whole and lie
in one block each; null ids come first; other columns, of any name, are not written; an empty table gives no blocks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rollscope.llm.common import WordTable, held, slices, text_values

CHUNK, STRETCH = 8, 512
END_ID = 1
BLOCK_TOKENS = 1 << 19

BLOCK = T.StructType([
    T.StructField("shard", T.IntegerType()), T.StructField("block", T.IntegerType()),
    T.StructField("first_token", T.LongType()), T.StructField("n_tokens", T.LongType()),
    T.StructField("doc_ids", T.ArrayType(T.LongType())), T.StructField("doc_tokens", T.ArrayType(T.IntegerType())),
    T.StructField("levels", T.ArrayType(T.BinaryType())), T.StructField("bitmaps", T.ArrayType(T.BinaryType())),
    T.StructField("ranks", T.ArrayType(T.BinaryType())),
])


# ---- the code ----

def encode_block(ids: np.ndarray) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """Levels, continuation bitmaps and rank directories of one block of ids."""
    levels, bitmaps, ranks = [], [], []
    rest = ids.astype(np.uint32)
    while True:
        levels.append((rest & 0xFF).astype(np.uint8).tobytes())
        more = rest >> CHUNK
        bits = more > 0
        bitmaps.append(np.packbits(bits, bitorder="little").tobytes())
        counts = np.add.reduceat(bits, np.arange(0, len(bits), STRETCH), dtype=np.uint32) if len(bits) else np.zeros(0, np.uint32)
        ranks.append((np.cumsum(counts, dtype=np.uint32) - counts).astype("<u4").tobytes())
        rest = more[bits]
        if not len(rest):
            return levels, bitmaps, ranks


def decode_block(levels: list[bytes], bitmaps: list[bytes]) -> np.ndarray:
    """All ids of a block."""
    out = np.frombuffer(levels[0], np.uint8).astype(np.uint32)
    at = np.arange(len(out))
    for k, level in enumerate(levels[1:]):
        bits = np.unpackbits(np.frombuffer(bitmaps[k], np.uint8), count=len(at), bitorder="little").astype(bool)
        at = at[bits]
        out[at] |= np.frombuffer(level, np.uint8).astype(np.uint32) << np.uint32(CHUNK * (k + 1))
    return out


def token_at(levels: list[bytes], bitmaps: list[bytes], ranks: list[bytes], i: int) -> int:
    """One id by its position: a byte and a rank per level, no decoding."""
    value = 0
    for k, level in enumerate(levels):
        value |= level[i] << (CHUNK * k)
        bits = bitmaps[k]
        if not bits[i >> 3] >> (i & 7) & 1:
            return value
        stretch = i // STRETCH
        before = int.from_bytes(bits[stretch * STRETCH // 8:i >> 3], "little").bit_count()
        before += (bits[i >> 3] & ((1 << (i & 7)) - 1)).bit_count()
        i = int.from_bytes(ranks[k][4 * stretch:4 * stretch + 4], "little") + before
    return value


def ranks_of(bitmap: np.ndarray, ranks: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Set bits before each position of a level: those before its stretch, from the directory, and those inside it."""
    stretch = at // STRETCH
    # A position at the end of the level may lie in a stretch that has no entry.
    inside = np.minimum(stretch, len(ranks) - 1)
    first = inside * (STRETCH // 8)
    index = first[:, None] + np.arange(STRETCH // 8 + 1)
    byte = bitmap[np.minimum(index, len(bitmap) - 1)]
    whole = (at >> 3)[:, None]
    last = (1 << (at & 7)) - 1
    byte = np.where((index < whole) & (index < len(bitmap)), byte, np.where(index == whole, byte & last[:, None].astype(np.uint8), 0))
    return ranks[inside].astype(np.int64) + np.bitwise_count(byte).sum(1, dtype=np.int64)


def spans_of(levels: list[bytes], bitmaps: list[bytes], ranks: list[bytes], ends: np.ndarray) -> Iterator[np.ndarray]:
    """Ids of consecutive spans that end at `ends`. Each is found by the ranks of its borders and read by itself."""
    bounds = [np.concatenate([[0], ends])]
    level = [np.frombuffer(x, np.uint8) for x in levels]
    bits = [np.frombuffer(x, np.uint8) for x in bitmaps]
    for k in range(len(levels) - 1):
        bounds.append(ranks_of(bits[k], np.frombuffer(ranks[k], "<u4"), bounds[k]))
    cuts = [b.tolist() for b in bounds]
    for d in range(len(ends)):
        out = level[0][cuts[0][d]:cuts[0][d + 1]].astype(np.uint32)
        at = None
        for k in range(1, len(levels)):
            a, b = cuts[k - 1][d], cuts[k - 1][d + 1]
            if cuts[k][d] == cuts[k][d + 1]:
                break
            more = np.flatnonzero(np.unpackbits(bits[k - 1][a >> 3:(b + 7) >> 3], bitorder="little")[a & 7:(a & 7) + b - a])
            at = more if at is None else at[more]
            out[at] |= level[k][cuts[k][d]:cuts[k][d + 1]].astype(np.uint32) << np.uint32(CHUNK * k)
        yield out


# ---- texts to ids ----

# Marks that end a word of letters; the apostrophe is left out because it takes part in contractions.
_MARKS = b"!\"#$%&()*,./:;<=>?@[]^_`{|}~"
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(0x61, 0x7B)]] = 1
_KIND[[*_MARKS]] = 2
_LOWER = bytes.maketrans(bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B)))


def word_pieces(text: bytes) -> list[bytes]:
    """Words whose encodings joined are the encoding of the text, for a vocabulary that lower-cases and drops white space.

    Lower case and a blank between an ASCII letter and a mark after it change no token and make words repeat far more
    often. They would change special tokens, so texts with "<|" are only cut at white space.
    """
    if b"<|" in text:
        return text.split()
    low = text.translate(_LOWER)
    kind = _KIND[np.frombuffer(low, np.uint8)]
    cut = np.flatnonzero((kind[:-1] == 1) & (kind[1:] == 2)) + 1 if len(kind) else ()
    if len(cut):
        low = np.insert(np.frombuffer(low, np.uint8), cut, 0x20).tobytes()
    return low.split()


def word_encoder(tokenizer_path: str, limit: int | None = None) -> WordTable:
    """Word table over a tokenizers file, kept by a worker between tasks: a frequent word is encoded once."""
    def make() -> WordTable:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(tokenizer_path)

        def encode(words: list[bytes]) -> list[list[int]]:
            return [e.ids for e in tok.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]

        return WordTable(encode) if limit is None else WordTable(encode, limit)

    return held(("words", tokenizer_path, limit), make)


def text_ids(table: WordTable, texts: list[bytes]) -> list[np.ndarray]:
    """Ids of each text, without the end id."""
    words = [word_pieces(x) for x in texts]
    rows = table.lookup([w for ws in words for w in ws])
    ids, n = table.tokens(rows)
    ends = np.concatenate([[0], np.cumsum(n)])[np.cumsum([0, *map(len, words)])]
    return [ids[a:b] for a, b in zip(ends[:-1], ends[1:])]


# ---- files ----

def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text",
                      block_tokens: int = BLOCK_TOKENS, end_id: int = END_ID) -> None:
    """Encode whole texts and write them as shards in ascending doc_id order.

    `tokenizer_path` must exist on every executor. A block holds whole documents and is closed at `block_tokens` ids.
    """
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
                       F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("text"))
    # Equal ids differ in the second key, so they need not share a task.
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = word_encoder(tokenizer_path)
        shard = TaskContext.get().partitionId()
        block, first, ids, lengths, docs_in, held = 0, 0, [], [], [], 0

        def close() -> pa.RecordBatch:
            levels, bitmaps, ranks = encode_block(np.concatenate(ids))
            row = dict(shard=shard, block=block, first_token=first, n_tokens=held, doc_ids=docs_in, doc_tokens=lengths,
                       levels=levels, bitmaps=bitmaps, ranks=ranks)
            return pa.RecordBatch.from_pylist([row], schema=to_arrow_schema(BLOCK))

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for lo, part in slices(text_values(batch.column(1)), 2 << 20):
                for key, x in zip(keys[lo:lo + len(part)], text_ids(table, part)):
                    ids.append(np.append(x, np.int32(end_id)))
                    lengths.append(len(x) + 1)
                    docs_in.append(key)
                    held += len(x) + 1
                    if held >= block_tokens:
                        yield close()
                        block, first, ids, lengths, docs_in, held = block + 1, first + held, [], [], [], 0
        if held:
            yield close()

    ordered.mapInArrow(run, BLOCK).write.option("compression", "none").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The blocks with the number of ids in all shards before theirs."""
    blocks = spark.read.schema(BLOCK).parquet(path)
    shards = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    # One row per shard: the window runs over the number of output partitions, not over the data.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))
    return blocks.join(F.broadcast(offsets), "shard")


DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()),
                    T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])


def document_digests(blocks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files alone, through their rank directories."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n = np.asarray(row["doc_tokens"], np.int64)
                ends = np.cumsum(n)
                starts = ends - n
                base = row["shard_start"] + row["first_token"]
                crc = [zlib.crc32(x.astype("<u4", copy=False)) for x in spans_of(row["levels"], row["bitmaps"], row["ranks"], ends)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(starts + base), pa.array(n),
                     pa.array(crc, pa.int64())], names=DOC.names)

    return blocks.select("shard_start", "first_token", "doc_ids", "doc_tokens", "levels", "bitmaps", "ranks").mapInArrow(run, DOC)


def read_tokens(blocks: DataFrame, positions: DataFrame) -> DataFrame:
    """position, id for a table of global token positions: each is looked up in its block by `token_at`."""
    spans = blocks.withColumn("lo", F.col("shard_start") + F.col("first_token"))
    # Positions meet blocks through fixed stretches of the global numbering, an equality join.
    step = BLOCK_TOKENS
    keyed = spans.withColumn("cell", F.explode(F.sequence(
        F.floor(F.col("lo") / step), F.floor((F.col("lo") + F.col("n_tokens") - 1) / step))))
    hits = positions.select("position", F.floor(F.col("position") / step).alias("cell")).join(keyed, "cell").filter(
        (F.col("position") >= F.col("lo")) & (F.col("position") < F.col("lo") + F.col("n_tokens")))
    per_block = hits.groupBy("shard", "block", "lo").agg(F.collect_list("position").alias("at")).alias("h").join(
        blocks.select("shard", "block", "levels", "bitmaps", "ranks").alias("b"), ["shard", "block"])
    out = T.StructType([T.StructField("position", T.LongType()), T.StructField("id", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = [token_at(row["levels"], row["bitmaps"], row["ranks"], p - row["lo"]) for p in row["at"]]
                yield pa.RecordBatch.from_arrays([pa.array(row["at"], pa.int64()), pa.array(ids, pa.int64())],
                                                 names=out.names)

    return per_block.select("lo", "at", "levels", "bitmaps", "ranks").mapInArrow(run, out)
