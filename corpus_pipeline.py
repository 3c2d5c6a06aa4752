"""Documents to training tokens: quality rules, near-duplicates, benchmark decontamination, source mix, token files.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns the columns of
documents, but for the last, which returns what the token files hold.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rollscope.llm.common import shared_path, stored, table
from rollscope.llm.decontaminate import drop_contaminated
from rollscope.llm.mixing import mix_documents
from rollscope.llm.quality_rules import keep_good
from rollscope.llm.queries import tokenizer
from rollscope.llm.similar import keep_one_similar
from rollscope.llm.token_files import document_digests, read_token_files, write_token_files

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return keep_good(docs, tokenizer("piece_bpe_32k.model"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 or more on 5-word shingles."""
    return keep_one_similar(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight takes it."""
    return mix_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, and for each of its documents what they hold."""
    path = shared_path(spark, "corpus-tokens")
    write_token_files(docs, path, tokenizer("word_bpe_49k.json"))
    return document_digests(read_token_files(spark, path))


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality), ("simhash near-dedup", near_duplicates), ("decontamination", decontaminate),
    ("source mix", mix), ("token files", tokens),
]

# The tokenizers cannot be written in SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is stored before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
