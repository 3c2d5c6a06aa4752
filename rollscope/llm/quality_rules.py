"""Quality rules on tokeniser fertility.

A public vocabulary measures each whole text: characters per token, share of byte-fallback tokens and the entropy of
its token distribution. A text outside the band of its main script is rejected. Simple rules on words, lines and
repeated windows come first.

Defined results: null text has no words; texts with fewer than 20 words fail the base rules, so empty ones are not
kept; equal rows are judged alike; an empty table gives an empty result. Columns with the name of a result are replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollscope.llm.common import WordTable, add_columns, held

# script -> least and most characters per token, largest byte-fallback share. Documents at sf 0.1 that pass the base rules
# lie at 1.55 to 2.7 (latin), clear English prose at 4.7; base64 at 1.2, hex and percent codes at 1.0 to 1.45. Scripts
# that the tables lack have bands around sentences of that script. A byte share at its limit is a text, or a mixture,
# that the vocabulary can only spell.
BANDS = {
    "latin": (1.5, 6.0, 0.05), "greek": (0.7, 3.0, 0.2), "cyrillic": (1.3, 4.5, 0.1), "hebrew": (0.6, 3.0, 0.2),
    "arabic": (0.6, 3.0, 0.2), "indic": (0.35, 3.0, 0.9), "cjk": (0.35, 2.0, 0.75), "other": (0.25, 5.0, 0.9),
}
# Entropy must reach this share of the most that its tokens, counted up to ENTROPY_TOKENS, could have.
ENTROPY_SHARE, ENTROPY_TOKENS = 0.75, 64
LEAST_WORDS, MOST_REPEATED = 20, 30
REPEAT_WINDOW = 8

SCRIPTS = tuple(BANDS)
# Lead bytes of UTF-8 sequences by script.
_LEADS = np.zeros((256, len(SCRIPTS)), np.int64)
for _name, _from, _to in (("latin", 0x41, 0x5A), ("latin", 0x61, 0x7A), ("latin", 0xC3, 0xC9), ("greek", 0xCE, 0xCF),
                          ("cyrillic", 0xD0, 0xD3), ("hebrew", 0xD6, 0xD7), ("arabic", 0xD8, 0xDB), ("indic", 0xE0, 0xE0),
                          ("cjk", 0xE3, 0xED), ("other", 0xE1, 0xE2), ("other", 0xF0, 0xF4)):
    _LEADS[_from:_to + 1, SCRIPTS.index(_name)] = 1
_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
_SPACES = np.frombuffer(b"\t\n\x0b\x0c\r ", np.uint8)

FIELDS = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens")]
    + [T.StructField(n, T.DoubleType()) for n in ("chars_per_token", "byte_share", "entropy")]
    + [T.StructField("script", T.StringType()), T.StructField("base_failed", T.BooleanType()),
       T.StructField("kept", T.BooleanType())])


def piece_table(model_path: str) -> tuple[WordTable, np.ndarray]:
    """Pieces of each word and the flags of byte pieces, kept by a worker between tasks. Pieces never cross words."""
    def make() -> tuple[WordTable, np.ndarray]:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        table = WordTable(lambda words: sp.encode([w.decode() for w in words], num_threads=1))
        return table, np.array([sp.is_byte(i) for i in range(sp.get_piece_size())])

    return held(("pieces", model_path), make)


def repeated_words(ids: np.ndarray, window: int = REPEAT_WINDOW) -> int:
    """Words inside windows of `window` words (a power of two) that occur twice or more."""
    if len(ids) <= window:
        return 0
    rank, size = ids, 1
    while size < window:
        pair = (rank[:-size] << 32) | rank[size:]
        rank = np.unique(pair, return_inverse=True)[1]
        size *= 2
    twice = (np.bincount(rank) > 1)[rank]
    if not twice.any():
        return 0
    marks = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(marks, at, 1)
    np.add.at(marks, at + window, -1)
    return int((np.cumsum(marks)[:-1] > 0).sum())


def duplicate_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def judge(model_path: str):
    """Function from texts to the columns of FIELDS."""
    table, is_byte = piece_table(model_path)

    def run(texts: list[bytes]) -> list[list]:
        out: list[list] = [[] for _ in FIELDS]
        words = [x.split() for x in texts]
        rows = table.lookup([w for ws in words for w in ws])
        ends = np.cumsum([len(w) for w in words]).tolist()
        for text, ws, end in zip(texts, words, ends):
            own = rows[end - len(ws):end]
            seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
            chars = int(seen[:0x80].sum() + seen[0xC0:].sum() - seen[_SPACES].sum())
            repeated = repeated_words(own)
            base_failed = len(ws) < LEAST_WORDS or 100 * repeated > MOST_REPEATED * len(ws)
            pieces, _ = table.tokens(own)
            n = len(pieces)
            counts = np.unique(pieces, return_counts=True)[1]
            entropy = float(np.log2(n) - (counts * np.log2(counts)).sum() / n) if n else 0.0
            per_token, share = chars / max(1, n), float(is_byte[pieces].mean()) if n else 0.0
            letters = seen @ _LEADS
            script = SCRIPTS[int(letters.argmax())] if letters.any() else "other"
            low, high, most_bytes = BANDS[script]
            inside = low <= per_token <= high and share <= most_bytes and \
                entropy >= ENTROPY_SHARE * np.log2(max(1, min(n, ENTROPY_TOKENS)))
            for column, value in zip(out, (len(ws), chars, int(seen[_SYMBOLS].sum()), duplicate_lines(text), repeated, n,
                                           per_token, share, entropy, script, base_failed, bool(not base_failed and inside))):
                column.append(value)
        return out
    return run


def quality_rules(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """Document rows without their text, with the columns of FIELDS. `model_path` must exist on every executor."""
    return add_columns(docs, lambda: judge(model_path), FIELDS, text)


def keep_good(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """The documents that the rules keep, with their own columns."""
    def make():
        run, kept = judge(model_path), FIELDS.names.index("kept")
        return lambda texts: [run(texts)[kept]]

    flag = T.StructType([T.StructField("__kept", T.BooleanType())])
    return add_columns(docs, make, flag, text, keep_text=True).filter("__kept").select(*[F.col(f"`{c}`") for c in docs.columns])
