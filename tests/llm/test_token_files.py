import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rollscope.llm.common import shared_path
from rollscope.llm.token_files import (
    decode_block, document_digests, encode_block, read_token_files, read_tokens, spans_of, text_ids, token_at, word_encoder,
    write_token_files)

PATH = public_tokenizers.path("word_bpe_49k.json")
TOK, TABLE = Tokenizer.from_file(PATH), word_encoder(PATH)
TEXTS = [None, "", "   \n", "The cat's whiskers, isn't it?! <|endoftext|>, <|startoftext|>.", "X<|ENDOFTEXT|>,", "ÉÈ!! Ça… ( x ) a.b.c 1,234.5",
         "éa 'sun 'S DON'T rock'n'roll  wide　space\x1funit", "日本語。テスト", "The cat's whiskers, isn't it?!" * 400,
         "a" * 5000, "İstanbul ΣΊΣΥΦΟΣ", "x|y | z|>", "don't.' ''s \"'ll"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**31), min_size=1, max_size=2000))
def test_code_round_trip(ids):
    arr = np.array(ids, np.uint32)
    levels, bitmaps, ranks = encode_block(arr)
    assert decode_block(levels, bitmaps).tolist() == ids
    for i in range(0, len(ids), 7):
        assert token_at(levels, bitmaps, ranks, i) == ids[i]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**31), min_size=1, max_size=3000), st.lists(st.integers(0, 700), max_size=9))
def test_spans_by_ranks(ids, sizes):
    levels, bitmaps, ranks = encode_block(np.array(ids, np.uint32))
    ends = np.unique(np.minimum(np.cumsum([*sizes, len(ids)]), len(ids)))
    got = [x.tolist() for x in spans_of(levels, bitmaps, ranks, ends)]
    assert got == [ids[a:b] for a, b in zip([0, *ends[:-1]], ends)]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("abAB'sStdlmvreÉß.,!?|<>_-# \t\n ́€1²"), max_size=60))
def test_word_wise_encoding_is_the_whole_encoding(text):
    got = text_ids(TABLE, [text.encode()])[0]
    assert got.tolist() == TOK.encode(text, add_special_tokens=False).ids


def test_files(spark, docs_of):
    rows = [(i * 3 % 17, t) for i, t in enumerate(TEXTS)] + [(5, "again"), (5, "again"), (None, "no id")]
    path = shared_path(spark, "t")
    write_token_files(docs_of(rows), path, PATH, block_tokens=300)
    blocks = read_token_files(spark, path)
    got = sorted(map(tuple, document_digests(blocks).collect()), key=lambda r: r[1])
    ids = {}
    for k, t in rows:
        ids.setdefault(k, []).append(TOK.encode(t or "", add_special_tokens=False).ids + [1])
    assert [r[0] for r in got] == sorted((k for k, _ in rows), key=lambda k: (k is not None, k or 0))
    at, every = 0, []
    for k, start, n, crc in got:
        assert start == at
        match = [x for x in ids[k] if zlib.crc32(np.array(x, "<u4").tobytes()) == crc and len(x) == n]
        assert match
        ids[k].remove(match[0])
        every += match[0]
        at += n
    positions = spark.createDataFrame([(i,) for i in range(0, len(every), 11)], "position long")
    looked = dict(map(tuple, read_tokens(blocks, positions).collect()))
    assert looked == {i: every[i] for i in range(0, len(every), 11)}


def test_small_cache_changes_nothing():
    texts = [(t or "").encode() for t in TEXTS]
    small, large = word_encoder(PATH, 3), word_encoder(PATH)
    for _ in range(2):
        for x in texts:
            assert text_ids(small, [x])[0].tolist() == text_ids(large, [x])[0].tolist()


def test_empty_table(spark, docs_of):
    path = shared_path(spark, "t")
    write_token_files(docs_of([(1, "x")]).limit(0), path, PATH)
    assert document_digests(read_token_files(spark, path)).count() == 0
