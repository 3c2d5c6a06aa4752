import base64
import math
import random
import re
from collections import Counter
from urllib.parse import quote

import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from rollscope.llm.quality_rules import keep_good, quality_rules, repeated_words

PATH = public_tokenizers.path("piece_bpe_32k.model")


def brute_repeated(words, k=8):
    windows = Counter(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    hit = {j for i in range(len(words) - k + 1) if windows[tuple(words[i:i + k])] > 1 for j in range(i, i + k)}
    return len(hit)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60))
def test_repeated_words(ids):
    import numpy as np

    assert repeated_words(np.array(ids, np.int64)) == brute_repeated(ids)


SENTENCE = ("The committee met on Tuesday to discuss the annual budget, several members raised questions about road repairs "
            "and the chair promised a written answer before the next session in the old town hall.")
TEXTS = [None, "", " \n\t", "few words only", SENTENCE, SENTENCE * 2, (SENTENCE + "\n") * 3, "buy now " * 40,
         "x1#|<> " * 30, SENTENCE.upper() + " é ß 日本 &&", "\x01\x02 " * 30, " ".join(f"{i*7919:x}" for i in range(40)),
         "a\n\n \na\nb\n" + SENTENCE, "word " * 20000 + SENTENCE, "   x\x1fy " * 30]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    repeated = brute_repeated(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), repeated,
            len(words) < 20 or 100 * repeated > 30 * len(words))


def test_rules(spark, docs_of):
    docs = docs_of([*enumerate(TEXTS), (4, SENTENCE), (None, SENTENCE)]).selectExpr("*", "'x' as kept", "1 as entropy")
    rows = quality_rules(docs, PATH).collect()
    assert len(rows) == len(TEXTS) + 2
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for r in rows:
        text = TEXTS[r.doc_id] if r.doc_id is not None else SENTENCE
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(text)
        assert not (r.kept and r.base_failed)
        pieces = [p for w in re.findall(r"[^\x20\x09-\x0d]+", text or "") for p in sp.encode(w)]
        n = len(pieces)
        assert r.n_tokens == n
        if n:
            entropy = -sum(c / n * math.log2(c / n) for c in Counter(pieces).values())
            assert math.isclose(r.entropy, entropy, abs_tol=1e-9)
            assert math.isclose(r.byte_share, sum(map(sp.is_byte, pieces)) / n)
    kept = {r.doc_id: r.kept for r in rows}
    assert kept[4] and not kept[7] and not kept[11] and not kept[10]


def test_filter(spark, docs_of):
    docs = docs_of([(1, SENTENCE), (2, "no"), (3, None), (1, SENTENCE)]).selectExpr("*", "'x' as kept")
    left = keep_good(docs, PATH)
    assert left.columns == docs.columns
    assert [r.doc_id for r in left.collect()] == [1, 1]
    assert keep_good(docs.limit(0), PATH).count() == 0


FRENCH = ("L'été dernier, la présidente a préféré répéter à des élèves très étonnés que le théâtre où elle était née avait été "
          "fermé, même après plusieurs années passées à côté d'un café célèbre.")
RUSSIAN = ("Комитет собрался во вторник, чтобы обсудить годовой бюджет, несколько членов задали вопросы о ремонте дорог, и "
           "председатель обещал письменный ответ до следующего заседания в старой ратуше.")
CHINESE = "委员会 在 星期二 开会 讨论 年度 预算 几位 成员 提出 关于 道路 维修 的 问题 主席 答应 在 下次 会议 之前 给出 书面 答复 并且 感谢 大家"
HINDI = ("समिति की बैठक मंगलवार को वार्षिक बजट पर चर्चा के लिए हुई और कई सदस्यों ने सड़क की मरम्मत के बारे में सवाल उठाए तथा अध्यक्ष ने "
         "लिखित उत्तर देने का वादा किया")
GERMAN = ("Größere Städte müssen für ihre Bürger täglich verfügbare Räume öffnen, während ältere Häuser schön geprüft würden und die "
          "Schlüssel später über die Straße zurück zu den Eigentümern gehören, damit künftig niemand grüßen müsste.")


def test_bands(spark, docs_of):
    rng = random.Random(1)
    good = [SENTENCE, FRENCH, RUSSIAN, CHINESE, HINDI, GERMAN]
    encoded = "\n".join(base64.b64encode(rng.randbytes(57)).decode() for _ in range(60))
    escaped = [" ".join(w.encode("unicode_escape").decode() for w in x.split()) for x in (RUSSIAN, CHINESE)]
    percent = [" ".join(quote(w) for w in x.split()) for x in (FRENCH, GERMAN, RUSSIAN)]
    mojibake = [x.encode().decode("latin-1") for x in (FRENCH, RUSSIAN, CHINESE, HINDI)]
    spelled = SENTENCE + " \U00013000"
    bad = [encoded, *escaped, *percent, *mojibake, spelled]
    rows = {r.doc_id: r for r in quality_rules(docs_of(list(enumerate(good + bad))), PATH).collect()}
    assert not any(r.base_failed for r in rows.values())
    assert [rows[i].kept for i in range(len(rows))] == [True] * len(good) + [False] * len(bad)
    # These pass by entropy: only the characters per token, or the byte share, tell them apart.
    by_entropy = [rows[len(good)], rows[len(rows) - 1]]
    assert all(r.entropy >= 0.75 * math.log2(min(r.n_tokens, 64)) for r in by_entropy)
    assert 0.05 < by_entropy[1].byte_share <= 0.15 and 1.5 < by_entropy[1].chars_per_token < 6
