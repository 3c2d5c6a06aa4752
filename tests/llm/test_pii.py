import hashlib
import re

from rollscope.llm.pii import KINDS, find_personal_data, joined_spans, redact
from pyspark.sql import functions as F

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        n = int(c) * (1 + i % 2)
        s += n - 9 * (n > 9)
    return s % 10 == 0


def brute(text):
    text = text or ""
    spans = []
    for k in KINDS:
        for m in re.finditer(PATTERNS[k], text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": k == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                  "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[k]
            if ok:
                spans.append((m.start(), KINDS.index(k), m.end(), k))
    spans.sort()
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)


TEXTS = [None, "", "é call +1 (555) 555-1234 or mail a.b@x-y.example.com, from 10.0.0.255!", "4539 1488 0343 6467 and 4539148803436468",
         "a@b.c.d@e.f", "a@b.c_d@e.f x@y x@.z @q.r", "1.2.3.4.5.6.7.8 999.1.1.1 01.002.0003.4", "+12 +1 2 +1()23 +123456789012345678",
         "+1 234 567 8901+1 234 567 8902", "日本 4539-1488-0343-6467 é@é.com user@host.co", "1" * 3000 + " 4111111111111111",
         "a." * 3000 + "@", ("x " * 50 + "u%d@mail.example.org 4111 1111 1111 1111 ") * 200, "no data here at all",
         "5.6.7.8\n1.1.1.1", "+1 (555) 555-1234\n+44 20 7946 0958", "12 34 56 78 90 12 34", "+..5 +5.. 5+5-5", "a@b-.c-d.-e"]


def rows_of(df):
    return df.select("doc_id", *[f"n_{k}" for k in KINDS], joined_spans(F.col("base")).alias("base"),
                     joined_spans(F.concat("base", "added")).alias("all")).collect()


def test_base_spans(spark, docs_of):
    docs = docs_of([*enumerate(TEXTS), (2, TEXTS[2]), (None, TEXTS[3])]).selectExpr("*", "1 as kind", "2 as n_ip")
    got = rows_of(find_personal_data(docs))
    assert len(got) == len(TEXTS) + 2
    for r in got:
        want = brute(TEXTS[r.doc_id if r.doc_id is not None else 3])
        assert r.base == want, r.doc_id
        assert [r[f"n_{k}"] for k in KINDS] == [want.count(k + ":") for k in KINDS]
        assert set(filter(None, want.split(","))) <= set(r["all"].split(","))
    assert rows_of(find_personal_data(docs.limit(0))) == []


def test_added_spans_and_redaction(spark, docs_of):
    rows = [(i, f"text {i} mail user{i}@mail{i % 7}.example.com and +1 (55{i % 10}) 555-{1000 + i} then 10.{i % 200}.3.4 "
                f"{4000000000000000 + i * 7919} end") for i in range(400)]
    card = next(str(n) for n in range(4111111111111110, 4111111111111120) if luhn(str(n)))
    dotted = ".".join(card[i:i + 4] for i in range(0, 16, 4))
    rows += [(1000, "write to jane.roe (at) mail (dot) example (dot) org today"), (1001, f"card {dotted} was used"),
             (1002, "we met at noon and a dot was there, 12 of 40 people in 1999-2004, 12 34 56 78 90 12 34"), (1003, "nothing")]
    found = {r.doc_id: r for r in rows_of(find_personal_data(docs_of(rows)))}
    for k, t in rows:
        assert found[k].base == brute(t)
    assert "email:" in found[1000]["all"] and "card:" in found[1001]["all"]
    assert found[1002]["all"] == found[1003]["all"] == ""
    texts = {r.doc_id: r.text for r in redact(docs_of(rows)).collect()}
    assert texts[1003] == "nothing" and "@" not in "".join(texts.values()) and "[card]" in texts[1001]
    assert texts[3].startswith("text 3 mail [email] and [phone] then [ip] ")


def test_digest(spark, docs_of):
    from rollscope.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    texts = dict(map(tuple, spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()))
    got = QUERIES["op5_personal_data"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.base_sha256 == hashlib.sha256(brute(texts[r.doc_id]).encode()).hexdigest()
