import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rollscope.llm.suffix_dedup import (
    Powers, _previous_smaller, common_prefix, longest_previous, remove_repeats, segments, sliding_least, suffix_ranks)


def brute(rows, length, keep_first=False):
    """Window by window over the whole table."""
    rows = [(k, (t or "").encode()) for k, t in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    where = defaultdict(list)
    for i in order:
        t = rows[i][1]
        for p in range(len(t) - length + 1):
            where[t[p:p + length]].append((i, p))
    out = []
    for i, (k, t) in enumerate(rows):
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - length + 1):
            all_ = where[t[p:p + length]]
            if len(all_) > 1 and not (keep_first and all_[0] == (i, p)):
                gone[p:p + length] = True
        edge = np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append((k, len(t), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=80), st.integers(1, 20))
def test_sliding_least(x, width):
    if width <= len(x):
        got = sliding_least(np.array(x, np.uint64), width)
        assert got.tolist() == [min(x[i:i + width]) for i in range(len(x) - width + 1)]


@settings(max_examples=80, deadline=None)
@given(st.permutations(range(30)))
def test_previous_smaller(x):
    got = _previous_smaller(np.array(x))
    assert got.tolist() == [max((j for j in range(i) if x[j] < x[i]), default=-1) for i in range(len(x))]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab", min_size=40, max_size=120), st.integers(16, 30))
def test_longest_previous_factor(text, length):
    raw = np.frombuffer(text.encode(), np.uint8)
    starts = np.arange(len(raw) - length + 1)
    ranks, levels = suffix_ranks(raw, starts, length)
    assert (np.argsort(ranks, kind="stable") == sorted(starts, key=lambda p: (text[p:p + length], p))).all()

    def lcp(a, b):
        n = 0
        while n < length and text[a + n] == text[b + n]:
            n += 1
        return n
    a, b = np.repeat(starts, len(starts)), np.tile(starts, len(starts))
    assert common_prefix(a, b, levels, raw, length).tolist() == [lcp(i, j) for i, j in zip(a, b)]
    got = longest_previous(np.argsort(ranks, kind="stable"), starts, starts, levels, raw, length)
    assert got.tolist() == [max((lcp(p, q) for q in range(p)), default=0) for p in starts]


def test_equal_windows_have_equal_anchors():
    rng = random.Random(2)
    shared = "".join(rng.choice("abcd ") for _ in range(300))
    texts = ["".join(rng.choice("abcd ") for _ in range(n)) + shared + "x" * n for n in (10, 77, 200)]
    seen = []
    for t in texts:
        anchors, _, first, n, at = segments(t.encode(), 100, 40, Powers())
        own = {p: (a, q - p) for a, f, k, q in zip(anchors.tolist(), first.tolist(), n.tolist(), at.tolist()) for p in range(f, f + k)}
        seen.append([own[t.index(shared) + i] for i in range(201)])
    assert seen[0] == seen[1] == seen[2]


def corpus():
    rng = random.Random(9)
    def word():
        return "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    base = [word() for _ in range(260)]
    rows = [(0, None), (1, ""), (2, "short"), (3, "x" * 900), (4, "ab" * 250), (5, "x" * 400)]
    for i in range(60):
        words = list(base) if i % 2 else [word() for _ in range(150)]
        for _ in range(i % 6):
            words[rng.randrange(len(words))] = word()
        rows.append((100 + i, " ".join(words)))
    passage = " ".join(word() for _ in range(90))
    rows += [(300 + i, " ".join(word() for _ in range(40)) + passage + " ".join(word() for _ in range(30)) + passage[:i * 90]) for i in range(6)]
    return rows


@pytest.mark.parametrize("crowded", [4096, 2])
@pytest.mark.parametrize("keep_first", [False, True])
def test_against_brute_force(spark, docs_of, crowded, keep_first):
    rows = corpus()
    for length, anchor in ((400, 200), (64, 24)):
        docs = docs_of(rows).selectExpr("*", "1 as row", "2 as anchor", "3 as n_bytes")
        got = remove_repeats(docs, length=length, anchor=anchor, keep_first=keep_first, crowded=crowded).collect()
        assert sorted((tuple(r)[:5] for r in got), key=str) == brute(rows, length, keep_first)
        for r in got:
            text = (dict(rows)[r.doc_id] or "").encode()
            left = b"".join(text[a:b] for a, b in zip([0, *[e for _, e in r.spans]], [*[s for s, _ in r.spans], len(text)]))
            assert left == r.kept


def test_repeated_rows_and_null_ids(spark, docs_of):
    text = " ".join(str(i * i) for i in range(150))
    rows = [(1, text), (1, text), (None, text[:450]), (2, "other " + text[:399])]
    got = remove_repeats(docs_of(rows), keep_first=False).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == brute(rows, 400)
    assert remove_repeats(docs_of(rows).limit(0)).count() == 0
