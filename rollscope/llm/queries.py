"""One query per operator, over whole tables with production parameters, and SQL checks where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollscope.llm.common import WORD, shared_path, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def wrap(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return wrap


def tokenizer(name: str) -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op4_token_files")
def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rollscope.llm.token_files import document_digests, read_token_files, write_token_files

    path = shared_path(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents"), path, tokenizer("word_bpe_49k.json"))
    return document_digests(read_token_files(spark, path))


OP8_SQL = rf"""
with docs as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) as size from documents),
src as (select source, sum(size)::bigint as source_size from docs group by source),
ranked as (select *, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as w
           from src),
level as (select *, sum(source_size) over () as total,
                 coalesce(sum(source_size) over (order by source_size / w, source nulls last
                          rows between unbounded preceding and 1 preceding), 0) as full_before,
                 sum(w) over (order by source_size / w, source nulls last
                          rows between current row and unbounded following) as w_after from ranked),
pick as (select max((1.5::double * total - 2.0::double * full_before) / w_after) as lam from level
         where (1.5::double * total - 2.0::double * full_before) / w_after
               <= 2.0::double * source_size / w),
targets as (select source, source_size, case when source_size = 0 then 0.0::double
                   else least(2.0::double * source_size, lam * w) end as target,
                   ('0x' || substr(md5(coalesce('=' || source, '')), 1, 8))::bigint / 4294967296.0::double as u
            from ranked, pick),
placed as (select d.doc_id, d.size, t.source_size, t.target, t.u,
                  case when t.source_size > 0 then t.target / t.source_size else 0.0::double end as rate,
                  row_number() over (partition by d.source order by d.size, d.doc_id) - 1 as k
           from docs d join targets t on d.source is not distinct from t.source)
select doc_id, size::bigint as size, source_size, target,
       ((floor((k + 1) * rate + u) - floor(k * rate + u)) * size)::bigint as taken from placed
"""


@query("op8_mix_sources", OP8_SQL)
def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rollscope.llm.mixing import mix_plan

    return mix_plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op7_simhash")
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rollscope.llm.simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


OP10_SQL = r"""
with cut as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
items as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
windows as (select distinct item_id, least(len(w), 13) as k,
                   array_to_string(w[i:i + least(len(w), 13) - 1], ' ') as win
            from (select *, unnest(range(1, len(w) - least(len(w), 13) + 2)) as i from items where len(w) > 0)),
sizes as (select distinct k from windows),
grams as (select doc_id, k, p, array_to_string(w[p:p + k - 1], ' ') as win
          from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as p from cut, sizes)),
hits as (select g.doc_id, g.p, g.k, n.item_id from grams g join windows n using (k, win)),
words as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(p, p + k)) as q from hits) group by 1),
names as (select doc_id, count(*) as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as ids
          from (select distinct doc_id, item_id from hits) group by 1)
select c.doc_id, len(c.w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(c.w) as contaminated
from cut c left join words using (doc_id) left join names using (doc_id)
"""


@query("op10_decontaminate", OP10_SQL)
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rollscope.llm.decontaminate import contamination

    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query("op3_quality_rules")
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rollscope.llm.quality_rules import quality_rules

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs, tokenizer("piece_bpe_32k.model"))


@query("op2_quality_model")
def op2_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rollscope.llm.quality_model import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op6_language_id")
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rollscope.llm.language_id import identify

    return identify(table(spark, sf_dir, "documents"))


@query("op1_suffix_dedup")
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rollscope.llm.suffix_dedup import remove_repeats

    found = remove_repeats(table(spark, sf_dir, "documents"), keep_first=False, with_text=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query("op5_personal_data")
def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rollscope.llm.pii import KINDS, joined_spans, find_personal_data

    found = find_personal_data(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(joined_spans(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        joined_spans(F.concat("base", "added")).alias("spans"))


def _op9_sql() -> str:
    from rollscope.llm.line_dedup import BLOCKS, ENTITIES, HIDDEN, HOST, LEAST_ON, SHARE, TAGS

    text = "coalesce(html, '')"
    for pattern, by in ((HIDDEN, "''"), (BLOCKS, "chr(10)"), (TAGS, "''")):
        text = f"regexp_replace({text}, '{pattern}', {by}, 'g')"
    for name, by in ENTITIES:
        text = f"replace({text}, '{name}', '{by}')"
    return rf"""
with cut as (select row_number() over () as r, page_id, nullif(lower(regexp_extract(url, '{HOST}', 1)), '') as host,
             list_filter(list_transform(regexp_split_to_array({text}, '[\n\r]'),
                 lambda x: trim(regexp_replace(x, '[ \t\x0b\f]+', ' ', 'g'))), lambda x: x <> '') as lines from pages),
totals as (select host, count(*) as pages from cut where host is not null group by 1),
counts as (select host, line, count(*) as n from (select host, unnest(list_distinct(lines)) as line from cut) group by 1, 2),
gone as (select host, list(line) as dropped from counts join totals using (host) where n >= {LEAST_ON} and n > {SHARE}::double * pages group by 1),
kept as (select c.*, case when g.dropped is null then lines
                     else list_filter(lines, lambda x: not list_contains(g.dropped, x)) end as left_lines
         from cut c left join gone g on c.host = g.host)
select page_id, host, len(lines)::bigint as n_lines, (len(lines) - len(left_lines))::bigint as n_dropped,
       coalesce(array_to_string(left_lines, chr(10)), '') as text from kept
"""


@query("op9_line_dedup", _op9_sql())
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rollscope.llm.line_dedup import drop_boilerplate

    return drop_boilerplate(table(spark, sf_dir, "pages"))


VECTOR = "list_transform(embedding, lambda x: floor(256 * x::double)::bigint)"
FINITE = "embedding is not null and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)"
DOT = "coalesce(list_sum(list_transform(list_zip({a}, {b}), lambda z: coalesce(z[1] * z[2], 0))), 0)::bigint"

OP11_SQL = f"""
with kept as (select row_number() over () as r, vec_id, case when vec_id % 7 = 0 then (label::bigint + 1) % 10 else label end as label,
                     {VECTOR} as v from embeddings where label is not null and {FINITE}),
scores as (select a.r as a, a.vec_id as anchor_id, b.r as b, b.vec_id, a.label = b.label as same, {DOT.format(a="a.v", b="b.v")} as score
           from kept a join kept b on a.vec_id % 50 = 0 and a.r <> b.r),
pos as (select *, row_number() over (partition by a order by score desc, vec_id nulls last, b) as k from scores where same),
neg as (select p.anchor_id, p.vec_id as positive_id, n.vec_id as negative_id, p.score as positive_score, n.score as negative_score,
               row_number() over (partition by p.a, p.b order by n.score desc, n.vec_id nulls last, n.b) as rank
        from pos p join scores n on p.a = n.a and p.k <= 5 and not n.same
             and 50 * p.score <= 100 * n.score and 100 * n.score <= 95 * p.score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from neg where rank <= 3
"""


@query("op11_hard_negatives", OP11_SQL)
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rollscope.llm.hard_negatives import hard_negatives

    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("bigint") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 50 == 0)


def _op13_sql() -> str:
    from rollscope.llm.centroids import DIMS, K, ROUNDS, SEED

    parts = [f"""
kept as materialized (select row_number() over () as r, vec_id, {VECTOR} as v from embeddings where len(embedding) = {DIMS} and {FINITE}),
c0 as materialized (select row_number() over (order by h, v) - 1 as cluster, v
    from (select sha256('{SEED}:' || vec_id) as h, v from kept where vec_id is not null order by h, v limit {K}) t)"""]
    for i in range(ROUNDS + 1):
        parts.append(f"""
a{i} as materialized (select k.r, min({{'d': list_sum(list_transform(list_zip(k.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint,
    'c': c.cluster}}) as near from kept k, c{i} c group by k.r)""")
        if i < ROUNDS:
            parts.append(f"""
m{i} as (select near.c as cluster, p, sum(x)::bigint as s, count(*)::bigint as n
    from (select near, unnest(v) as x, generate_subscripts(v, 1) as p from kept join a{i} using (r)) t group by 1, 2),
c{i + 1} as materialized (select c.cluster, coalesce(t.v, c.v) as v from c{i} c left join
    (select cluster, list((s - ((s % n) + n) % n) // n order by p) as v from m{i} group by 1) t using (cluster))""")
    return f"""with {",".join(parts)}
select vec_id, near.c::int as cluster, near.d as distance, (sum(near.d) over (partition by near.c))::bigint as cluster_inertia,
       (sum(near.d) over ())::bigint as inertia, sha256(array_to_string(c.v, ',')) as centroid_sha256
from a{ROUNDS} a join kept using (r) join c{ROUNDS} c on c.cluster = near.c
"""


@query("op13_centroid_clusters", _op13_sql())
def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rollscope.llm.centroids import cluster

    return cluster(table(spark, sf_dir, "embeddings"))


@query("op12_html_content")
def op12_html_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rollscope.llm.html_content import extract

    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
