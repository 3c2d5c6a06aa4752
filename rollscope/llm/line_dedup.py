"""Line dedup by site-relative frequency.

Pages are grouped by host. The share of a line is the number of the host's pages that contain it, divided by the host's
page total; lines on at least two pages and above a boilerplate share are dropped from all pages of the host, however small
it is. Everything is DataFrame
operations: distinct lines of a page are counted by partial aggregates, and the few lines per host that are dropped
(at most lines per page / share of them) go back to its pages in one join on host and one of `SALTS` parts, so a host
with a third of all pages is no single key.

Defined results: a page without a host (null or unusable url) keeps all its lines; null html has no lines; lines are
compared after white space is collapsed, empty ones are left out; a line twice on a page counts once for its share;
equal rows count as pages each; a line on one page alone stays, so the only page of a host keeps all its lines; hosts with
fewer than `least_pages` pages, where a caller asks for that, keep theirs; an empty table gives an empty result. Extra
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollscope.llm.common import stored

SHARE = 0.25
# A line that is dropped stands on so many pages of its host.
LEAST_ON = 2
SALTS = 32
# Parts without text, tags that end a line, other tags, entities. The order is that of their use.
HIDDEN = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->"
BLOCKS = (r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|figcaption|figure|footer|form|h[1-6]|head|header|hr"
          r"|html|li|main|nav|ol|option|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul)\b[^>]*>")
TAGS = r"<[^>]*>"
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def html_lines(html: Column) -> Column:
    """Visible lines of a page, white space collapsed."""
    text = F.coalesce(html, F.lit(""))
    for pattern, by in ((HIDDEN, ""), (BLOCKS, "\n"), (TAGS, "")):
        text = F.regexp_replace(text, F.lit(pattern), F.lit(by))
    for name, by in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(by))
    lines = F.transform(F.split(text, r"[\n\r]"), lambda x: F.trim(F.regexp_replace(x, F.lit(r"[ \t\x0b\f]+"), F.lit(" "))))
    return F.filter(lines, lambda x: x != "")


def host_of(url: Column) -> Column:
    """Host in lower case, null without one."""
    return F.nullif(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def page_lines(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, host, lines of each page row."""
    return pages.select(F.col(f"`{page_id}`").alias("page_id"), host_of(F.col(f"`{url}`")).alias("host"),
                        html_lines(F.col(f"`{html}`")).alias("lines"))


def boilerplate(lines: DataFrame, share: float = SHARE, least_pages: int = 1) -> DataFrame:
    """host, hashes of its boilerplate lines, from (host, lines) rows."""
    hosted = lines.filter("host is not null")
    totals = hosted.groupBy("host").agg(F.count("*").alias("pages")).filter(F.col("pages") >= least_pages)
    counts = hosted.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: F.xxhash64(x)))).alias("line")).groupBy(
        "host", "line").agg(F.count("*").alias("n"))
    # A line above the share stands on more than this many pages of any host that is looked at.
    often = counts.filter((F.col("n") >= LEAST_ON) & (F.col("n") > share * least_pages)).withColumn("salt", F.pmod("line", F.lit(SALTS)).cast("int"))
    spread = totals.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    above = often.join(spread, ["host", "salt"]).filter(F.col("n") > share * F.col("pages"))
    return above.groupBy("host").agg(F.collect_list("line").alias("dropped"))


def drop_boilerplate(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", share: float = SHARE,
                     least_pages: int = 1) -> DataFrame:
    """page_id, host, n_lines, n_dropped, text (remaining lines) of each page row."""
    lines = stored(page_lines(pages, page_id, url, html), "page-lines")
    found = boilerplate(lines, share, least_pages).withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("host", "b_host")
    salted = lines.withColumn("part", F.pmod(F.xxhash64("page_id", F.get("lines", F.lit(0))), F.lit(SALTS)).cast("int"))
    joined = salted.join(found, (F.col("host") == F.col("b_host")) & (F.col("part") == F.col("salt")), "left")
    kept = F.when(F.col("dropped").isNull(), F.col("lines")).otherwise(
        F.filter("lines", lambda x: ~F.array_contains("dropped", F.xxhash64(x))))
    return joined.select("page_id", "host", F.size("lines").cast("long").alias("n_lines"),
                         (F.size("lines") - F.size(kept)).cast("long").alias("n_dropped"), F.array_join(kept, "\n").alias("text"))
