"""Extra columns whose names the operators use themselves, and a very long text, change no result."""

import random

import pytest

from rollscope.llm import mixing, simhash, suffix_dedup, token_files
from rollscope.llm.common import shared_path
from rollscope.llm.queries import tokenizer

NAMES = ("at", "copies", "size", "target", "fp", "component_id", "start", "n_tokens", "block", "anchor", "seg", "h", "n", "id", "rn", "hash", "key",
         "n_bytes", "n_removed", "part", "u", "s", "w", "first")


def tokens(spark, docs):
    path = shared_path(spark, "clash")
    token_files.write_token_files(docs, path, tokenizer("word_bpe_49k.json"))
    return token_files.document_digests(token_files.read_token_files(spark, path))


RUNS = {"suffix_dedup": lambda spark, d: suffix_dedup.remove_repeats(d), "simhash": lambda spark, d: simhash.near_duplicates(d),
        "mixing": lambda spark, d: mixing.mix_plan(d), "token_files": tokens}


@pytest.mark.parametrize("name", RUNS)
def test_clashing_columns_and_a_long_text(spark, docs_of, name):
    rnd = random.Random(3)
    words = [f"word{i}" for i in range(4000)]
    long = " ".join(rnd.choice(words) for _ in range(60000))
    rows = [(1, long), (2, long[1000:5000]), (3, None), (4, ""), (5, "short text of its own"), (6, "short text of its own"), (7, long)]
    docs = docs_of(rows)
    extra = docs.selectExpr("*", *[f"concat('x', doc_id) as {n}" for n in NAMES])
    plain, clash = RUNS[name](spark, docs), RUNS[name](spark, extra)
    assert plain.columns == clash.columns
    assert sorted(map(str, plain.collect())) == sorted(map(str, clash.collect()))
    assert plain.count() == len(rows)
