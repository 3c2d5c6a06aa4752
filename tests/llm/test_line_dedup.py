import re
from collections import Counter, defaultdict

from rollscope.llm.line_dedup import drop_boilerplate

HTML = "<html><head><title>T{i}</title><script>var a='</p>';</script></head><body><nav><ul><li>Home</li><li>About  us</li></ul></nav>" \
       "<!-- <p>never</p> --><p>Text {i} is &lt;own&gt;<br>second {j}</p><footer>&copy; Site &amp; co</footer></body></html>"


def rows():
    out = []
    for i in range(60):
        host = "http://Big.example.com" if i % 3 == 0 else f"https://h{i % 4}.example.org:8080" if i % 3 == 1 else "ftp://user@rare.net"
        out.append((i, f"{host}/p/{i}?x=http://other/", HTML.format(i=i, j=i % 3)))
    return out + [(100, None, HTML.format(i=1, j=1)), (101, "not a url", HTML.format(i=1, j=1)), (102, "http://big.example.com", None),
                  (103, "http://big.example.com/x", ""), (104, "http://single.example/", "<p>Home</p>"), (0, *out[0][1:]),
                  (105, "http://big.example.com/l", "<p>" + "long " * 50000 + "</p>" + "<li>Home</li>" * 500), (None, "http://big.example.com", "<p>Home")]


def brute(data, share, least):
    pages = []
    for k, url, html in data:
        t = re.sub(r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->", "", html or "")
        t = re.sub(r"(?i)</?(?:body|br|footer|head|html|li|nav|p|title|ul)\b[^>]*>", "\n", t)
        t = re.sub("<[^>]*>", "", t)
        for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&copy;", "©"), ("&amp;", "&")):
            t = t.replace(a, b)
        lines = [x for x in (" ".join(y.split()) for y in t.split("\n")) if x]
        host = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", url or "")
        pages.append((k, host[1].lower() if host else None, lines))
    total = Counter(h for _, h, _ in pages)
    on = defaultdict(int)
    for _, h, lines in pages:
        for x in set(lines):
            on[h, x] += 1
    out = []
    for k, h, lines in pages:
        kept = lines if h is None or total[h] < least else [x for x in lines if not on[h, x] > share * total[h]]
        out.append((k, h, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    df = spark.createDataFrame(rows(), "page_id long, url string, html string").selectExpr("*", "1 as host", "2 as lines").repartition(4)
    for share, least in ((0.25, 8), (0.5, 2), (0.25, 100)):
        got = sorted(map(tuple, drop_boilerplate(df, share=share, least_pages=least).collect()), key=str)
        assert got == brute(rows(), share, least)
    assert any(r[3] for r in brute(rows(), 0.25, 8))
    assert drop_boilerplate(df.limit(0)).count() == 0


def test_small_hosts(spark):
    pages = [(i, "http://seven.example/a", f"<p>Menu</p><p>own {i}</p>") for i in range(7)]
    pages += [(10 + i, "http://two.example/a", f"<p>{'Menu' if i < 2 else ''}</p><p>own {i}</p>") for i in range(2)]
    pages += [(20, "http://one.example/a", "<p>Menu</p><p>Menu</p>")]
    pages += [(30 + i, "http://eight.example/a", f"<p>{'Menu' if i < 2 else 'Foot' if i < 5 else ''}</p><p>own {i}</p>") for i in range(8)]
    got = {r.page_id: (r.n_dropped, r.text) for r in drop_boilerplate(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(got[i] == (1, f"own {i}") for i in range(7))
    assert got[10] == (1, "own 0") and got[11] == (1, "own 1") and got[20] == (0, "Menu\nMenu")
    # Two of eight pages are not above the share, three are.
    assert got[30] == (0, "Menu\nown 0") and got[32] == (1, "own 2")
