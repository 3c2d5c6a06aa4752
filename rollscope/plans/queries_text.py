"""Queries that extract typed fields from completion and document text."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollscope.functions import text as T
from rollscope.plans.catalog import register
from rollscope.sources.views import view, with_sql

# SQL twins of the shared text rules.
SQ = "trim(regexp_replace(lower({0}), '\\s+', ' ', 'g'))"
BODY = ("trim(case when regexp_matches({0}, '(?s)<answer>.*?</answer>') then "
        "regexp_extract({0}, '(?s)<answer>(.*?)</answer>', 1) else {0} end, chr(32) || chr(9) || chr(10) || chr(13))")
SPY = "(?i)spy\\s*(?:player)?\\s*[:=]?\\s*(?:player\\s*)?(\\d+)"
CNT = "(?i)changed[\\s_-]*attributes?\\s*[:=]?\\s*(\\d+)"


def field_sql(text: str, pattern: str) -> str:
    body = BODY.format(text)
    inner = f"regexp_extract({body}, '{pattern}', 1)"
    digits = (f"case when {inner} = '' and not contains({text}, '<answer>') "
              f"then regexp_extract({text}, '{pattern}', 1) else {inner} end")
    return f"(case when length({digits}) between 1 and 10 then cast({digits} as bigint) end)"


FORMAT_SQL = ("(len(regexp_extract_all({0}, '<think>')) = 1 and len(regexp_extract_all({0}, '</think>')) = 1 and "
              "len(regexp_extract_all({0}, '<answer>')) = 1 and len(regexp_extract_all({0}, '</answer>')) = 1 and "
              "regexp_full_match({0}, '(?s)\\s*<think>.*?</think>\\s*(?:<bbox[^>]*>[^<]*</bbox>\\s*|"
              "<change>[^<]*</change>\\s*)*<answer>[^<]*</answer>\\s*(?:<bbox[^>]*>[^<]*</bbox>\\s*)*'))")
THINK_SQL = ("trim(regexp_extract({0}, '(?s)<think>(.*?)</think>', 1), chr(32) || chr(9) || chr(10) || chr(13))")


@register("answer_extract", with_sql("v_texts", f"""
select gen_index, {BODY.format('completion')} as answer, {SQ.format(BODY.format('completion'))} as answer_norm from v_texts"""))
def answer_extract(spark, sf):
    return view(spark, sf, "v_texts").select(
        "gen_index", T.answer_body(F.col("completion")).alias("answer"),
        T.answer_norm(F.col("completion")).alias("answer_norm"))


@register("answer_extract_last", with_sql("v_texts", """
select gen_index, lower(rtrim(trim(case when len(a) > 0 then a[-1] else completion end, chr(32) || chr(10)), '.')) as answer
from (select gen_index, replace(completion, chr(10), ' ') as completion,
 regexp_extract_all(replace(completion, chr(10), ' '), '(?s)<answer>(.*?)</answer>', 1) a from v_texts)"""))
def answer_extract_last(spark, sf):
    return view(spark, sf, "v_texts").select("gen_index", T.answer_last(F.col("completion")).alias("answer"))


@register("reasoning_extract", with_sql("v_texts", f"""
select gen_index, {THINK_SQL.format('completion')} as reasoning from v_texts"""))
def reasoning_extract(spark, sf):
    return view(spark, sf, "v_texts").select("gen_index", T.reasoning(F.col("completion")).alias("reasoning"))


@register("format_valid", with_sql("v_texts", f"""
select gen_index, {FORMAT_SQL.format('completion')} as format_valid from v_texts"""))
def format_valid(spark, sf):
    return view(spark, sf, "v_texts").select("gen_index", T.format_valid(F.col("completion")).alias("format_valid"))


@register("format_simple", with_sql("v_texts", """
select gen_index, regexp_full_match(completion, '(?s)<think>.*?</think>\\s*<answer>.*?</answer>') as format_simple,
 regexp_matches(completion, '(?s)<think>.*?</think>\\s*<answer>.*?\\{.*\\[\\d+,\\s*\\d+,\\s*\\d+,\\s*\\d+\\].*\\}.*?</answer>') as format_rec
from v_texts"""))
def format_simple(spark, sf):
    c = F.col("completion")
    return view(spark, sf, "v_texts").select(
        "gen_index", c.rlike(T.FORMAT_SIMPLE).alias("format_simple"), c.rlike(T.FORMAT_REC).alias("format_rec"))


@register("structured_answer", with_sql("v_texts", f"""
select gen_index, {field_sql('completion', SPY)} as spy, {field_sql('completion', CNT)} as changed from v_texts"""))
def structured_answer(spark, sf):
    return view(spark, sf, "v_texts").select(
        "gen_index", T.spy_field(F.col("completion")).alias("spy"), T.count_field(F.col("completion")).alias("changed"))


STEPS_SQL = """
with t as (select conv_id, turn, trim(text, chr(32) || chr(9) || chr(10) || chr(13)) as txt from conversations),
s as (select conv_id, turn, txt, list_filter(list_transform(string_split(regexp_replace(txt, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)),
 lambda x: trim(x, chr(32) || chr(9) || chr(10) || chr(13))), lambda x: length(x) > 3) as sents from t),
p as (select conv_id, turn, case when txt = '' then [] when len(sents) >= 2 then sents else [txt] end as steps from s)
select conv_id, turn, unnest(range(0, len(steps))) as step_no, unnest(steps) as step from p"""


@register("reasoning_steps", STEPS_SQL)
def reasoning_steps(spark, sf):
    conv = view(spark, sf, "conversations")
    return conv.select("conv_id", "turn", F.posexplode_outer(T.reasoning_steps(F.col("text"))).alias("step_no", "step")) \
        .filter("step_no is not null").withColumn("step_no", F.col("step_no").cast("bigint"))


@register("token_jaccard", """
with d as (select doc_id, list_distinct(regexp_extract_all(lower(d.text), '[a-z0-9_]+')) a,
 list_distinct(regexp_extract_all(lower(coalesce(b.text, '')), '[a-z0-9_]+')) b
 from documents d left join benchmark b on d.doc_id % (select max(item_id) + 2 from benchmark) = b.item_id)
select doc_id, round(case when len(a) = 0 or len(b) = 0 then 0 else
 len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) end, 9) as jaccard from d""")
def token_jaccard(spark, sf):
    # Every item meets documents; the last remainder meets none.
    items = view(spark, sf, "benchmark").agg(F.max("item_id") + 2).first()[0]
    d = view(spark, sf, "documents").select("doc_id", "text", (F.col("doc_id") % items).alias("item_id"))
    b = view(spark, sf, "benchmark").select("item_id", F.col("text").alias("ref"))
    toks = d.join(b, "item_id", "left").select(
        "doc_id", T.tokens(F.col("text")).alias("a"), T.tokens(F.col("ref")).alias("b"))
    return toks.select("doc_id", F.round(T.jaccard(F.col("a"), F.col("b")), 9).alias("jaccard"))


@register("ngram_repetition", f"""
with w as (select doc_id, string_split({SQ.format('text')}, ' ') as ws from documents),
g as (select doc_id, len(ws) as nw, case when len(ws) >= 6 then
 list_transform(range(1, len(ws) - 4), lambda i: array_to_string(ws[i:i + 5], ' ')) else [] end as grams from w)
select doc_id, round(case when nw < 6 then 0 else -(1 - len(list_distinct(grams)) / len(grams)) end, 9) as score from g""")
def ngram_repetition(spark, sf):
    return view(spark, sf, "documents").select(
        "doc_id", F.round(T.ngram_repetition(F.col("text")), 9).alias("score"))


@register("cosine_length", f"""
with w as (select doc_id, quality, case when {SQ.format('text')} = '' then 0 else len(string_split({SQ.format('text')}, ' ')) end as n
 from documents join labels using (doc_id))
select doc_id, round(case when quality = 1 then 0.5 + 0.5 * (1 + cos(n * pi() / 1024)) / 2
 else 0.0 - 0.5 * (1 + cos(n * pi() / 1024)) / 2 end, 9) as score from w""")
def cosine_length(spark, sf):
    d = view(spark, sf, "documents").join(view(spark, sf, "labels"), "doc_id")
    n = T.word_count(T.squeeze(F.col("text")))
    return d.select("doc_id", F.round(T.cosine_length(n, F.col("quality").cast("double")), 9).alias("score"))


def choice_sql(text: str) -> str:
    """Best letter of a text as a correlated subquery; punctuation is doubled so matches can touch."""
    words = ", ".join(f"'{w}'" for w in T.CHOICE_KEYWORDS)
    return f"""(select letter from (select letter, o, t,
 strpos(t, letter) - 1 as pos, substr(t, greatest(strpos(t, letter) - 21, 0) + 1, strpos(t, letter) + 19 - greatest(strpos(t, letter) - 21, 0)) as ctx
 from (select t, unnest(ls) as letter, unnest(range(0, len(ls))) as o from (select t,
  regexp_extract_all(regexp_replace(t, '([.,?!:;])', '\\1\\1', 'g'), '(?:^|[^A-Z])([A-Z])(?:[.,?!:;]|$)', 1) as ls
  from (select regexp_replace(upper({text}), '\\s+', ' ', 'g') as t))))
 order by len(list_filter([{words}], lambda k: contains(ctx, k))) + case when pos > length(t) * 0.7 then 2 else 0 end
  + case when substr(t, pos + 2, 1) <> '' and contains('{T.CHOICE_STOPS}', substr(t, pos + 2, 1)) then 1 else 0 end desc, o limit 1)"""


@register("choice_letter", with_sql("v_texts", f"""
with p as (select gen_index, chr(65 + cast(gen_index % 5 as integer)) a, chr(65 + cast(spy_gold % 5 as integer)) b, gen_index % 3 as k from v_texts),
t as (select gen_index, case k when 0 then 'The answer is ' || a || '.' when 1 then 'Not ' || b || ', but I think it should be ' || a || '.' else 'no idea' end as said from p)
select gen_index, {choice_sql('said')} as letter from t"""))
def choice_letter(spark, sf):
    t = view(spark, sf, "v_texts").selectExpr(
        "gen_index", "case gen_index % 3 when 0 then concat('The answer is ', char(65 + gen_index % 5), '.') "
        "when 1 then concat('Not ', char(65 + spy_gold % 5), ', but I think it should be ', char(65 + gen_index % 5), '.') "
        "else 'no idea' end as said")
    return t.select("gen_index", T.choice_letter(F.col("said")).alias("letter"))


@register("yes_no_extract", """
select conv_id, turn, regexp_extract(lower(text), '(yes|no)', 1) as said from conversations""")
def yes_no_extract(spark, sf):
    return view(spark, sf, "conversations").select("conv_id", "turn", T.yes_no(F.col("text")).alias("said"))


@register("yes_no_score", with_sql("v_texts", """
select gen_index, case when case when gen_index % 3 = 0 then 'yes' when gen_index % 3 = 1 then 'no' else '' end
 = case when spy_gold % 2 = 0 then 'yes' else 'no' end then 1.0 else 0.0 end as score from v_texts"""))
def yes_no_score(spark, sf):
    t = view(spark, sf, "v_texts").selectExpr(
        "gen_index", "case gen_index % 3 when 0 then '<answer>Yes, it is</answer>' when 1 then 'I say NO' else 'hm' end as said",
        "if(spy_gold % 2 = 0, '<answer>yes</answer>', 'no') as gold")
    return t.select("gen_index", T.yes_no_score(F.col("said"), F.col("gold")).alias("score"))


@register("mcq_score", with_sql("v_texts", """
select gen_index, case when gen_index % 3 < 2 and gen_index % 5 = spy_gold % 5 then 1.0 else 0.0 end as score from v_texts"""))
def mcq_score(spark, sf):
    t = view(spark, sf, "v_texts").selectExpr(
        "gen_index", "case gen_index % 3 when 0 then concat('The answer is ', char(65 + gen_index % 5), '.') "
        "when 1 then concat('<answer>', char(65 + gen_index % 5), '</answer>') else 'no idea' end as said",
        "concat('<answer>', char(65 + spy_gold % 5), '</answer>') as gold")
    return t.select("gen_index", T.mcq_score(F.col("said"), F.col("gold")).alias("score"))


@register("count_answer", with_sql("v_texts", """
select gen_index, case when gen_index % 4 = 0 then count_gold when gen_index % 4 = 1 then 0 end as pred,
 count_gold as gold from v_texts"""))
def count_answer(spark, sf):
    t = _count_rows(view(spark, sf, "v_texts"))
    return t.select("gen_index", T.strict_count(F.col("said")).alias("pred"), T.gold_count(F.col("sol")).alias("gold"))


def _count_rows(df):
    return df.selectExpr(
        "gen_index", "count_gold", "case gen_index % 4 when 0 then concat(' <answer> ', count_gold, ' </answer>') "
        "when 1 then '<answer>0</answer>' when 2 then '<answer>12345</answer>' else concat('maybe ', count_gold) end as said",
        "if(gen_index % 2 = 0, concat('<answer>', count_gold, '</answer>'), cast(count_gold as string)) as sol")


@register("count_qa_score", with_sql("v_texts", """
select gen_index, case when gen_index % 4 = 0 and gen_index % 6 <> 0 then 1.0 else 0.0 end as score,
 gen_index % 6 <> 0 as available from v_texts"""))
def count_qa_score(spark, sf):
    from rollscope.functions.rewards import count_qa_score as score

    t = _count_rows(view(spark, sf, "v_texts")).withColumn(
        "stated", F.when(F.col("gen_index") % 6 == 0, F.col("count_gold") + 1).otherwise(F.col("count_gold")))
    ok, val = score(F.col("said"), F.col("sol"), F.col("stated"))
    return t.select("gen_index", val.alias("score"), ok.alias("available"))


@register("bbox_json_payload", with_sql("v_detections", """
select det_id, case when det_id % 3 = 2 then 0 else 2 end as num_boxes,
 case when det_id % 3 = 2 then null else cast(category as varchar) end as first_label,
 case when det_id % 3 = 2 then null else cast(image_id as double) end as first_x from v_detections"""))
def bbox_json_payload(spark, sf):
    t = view(spark, sf, "v_detections").selectExpr(
        "det_id", "concat('text ```json [] ``` more ```json', if(det_id % 3 = 2, ' [{broken ', "
        "concat('[{\"bbox_2d\": [', image_id, ', 2, 30, 40], \"label\": \"', category, "
        "'\"}, {\"bbox_2d\": [1, 2, 3, 4], \"label\": \"z\"}]')), '```') as txt")
    b = t.select("det_id", T.fenced_boxes(F.col("txt")).alias("b"))
    return b.select("det_id", F.size("b").cast("bigint").alias("num_boxes"),
                    F.get("b", F.lit(0))["label"].alias("first_label"),
                    F.get(F.get("b", F.lit(0))["bbox_2d"], F.lit(0)).alias("first_x"))


@register("completion_text", with_sql("v_texts", """
select gen_index, completion as txt from v_texts"""))
def completion_text(spark, sf):
    t = view(spark, sf, "v_texts")
    msg = F.to_json(F.struct(F.lit("assistant").alias("role"), F.col("completion").alias("content")))
    raw = F.when(F.col("gen_index") % 3 == 0, F.col("completion")).when(
        F.col("gen_index") % 3 == 1, msg).otherwise(F.concat(F.lit("["), msg, F.lit("]")))
    return t.select("gen_index", T.completion_text(raw).alias("txt"))


@register("fuzzy_text", f"""
with t as (select d.doc_id, case d.doc_id % 3 when 0 then cast(d.n_chars as varchar) when 1 then trim(lower(b.text)) else trim(lower(b.text)) || ' end' end as said,
 case d.doc_id % 3 when 0 then cast(d.n_chars + d.doc_id % 2 as varchar) else trim(lower(b.text)) end as gold
 from documents d join benchmark b on d.doc_id % (select max(item_id) + 1 from benchmark) = b.item_id),
c as (select doc_id, said as raw_said, gold as raw_gold, rtrim(regexp_replace(said, '\\n', ' ', 'g'), '.') said, rtrim(regexp_replace(gold, '\\n', ' ', 'g'), '.') gold from t),
l as (select *, {choice_sql('raw_gold')} as lg, {choice_sql('raw_said')} as ls from c)
select doc_id, round(case when raw_said = raw_gold then 1.0 when doc_id % 3 = 0 then 0.0 when lg is not null then coalesce((lg = ls)::int, 0)
 else 1.0 - levenshtein(said, gold) / greatest(length(said), length(gold)) end, 6) as score from l""")
def fuzzy_text(spark, sf):
    items = view(spark, sf, "benchmark").agg(F.max("item_id") + 1).first()[0]
    d = view(spark, sf, "documents").select("doc_id", "n_chars", (F.col("doc_id") % items).alias("item_id"))
    t = d.join(view(spark, sf, "benchmark"), "item_id").selectExpr(
        "doc_id", "case doc_id % 3 when 0 then cast(n_chars as string) when 1 then trim(lower(text)) else concat(trim(lower(text)), ' end') end as said",
        "if(doc_id % 3 = 0, cast(n_chars + doc_id % 2 as string), trim(lower(text))) as gold")
    return t.select("doc_id", F.round(T.fuzzy_text(F.col("said"), F.col("gold")), 6).alias("score"))


@register("proposal_parse", with_sql("v_texts", """
select gen_index, case gen_index % 4 when 0 then '0,2' when 1 then '1' end as keep,
 case when gen_index % 3 = 0 then 4 else 5 end as players from v_texts"""))
def proposal_parse(spark, sf):
    t = view(spark, sf, "v_texts").selectExpr(
        "gen_index", "concat('<think>pick</think>', case gen_index % 4 when 0 then '<keep>[2, 0,2]</keep>' when 1 then '<keep> 1 </keep>' "
        "when 2 then '<keep>[0, 9]</keep>' else '<keep>[a]</keep>' end, if(gen_index % 3 = 0, '<players> 4 </players>', '<players>12</players>')) as txt")
    return t.select("gen_index", F.array_join(T.proposal_keep(F.col("txt"), F.lit(4)), ",").alias("keep"),
                    T.proposal_players(F.col("txt")).alias("players"))


@register("format_rec", with_sql("v_texts", """
select gen_index, regexp_matches(completion, '(?s)<think>.*?</think>\\s*<answer>.*?\\{.*\\[\\d+,\\s*\\d+,\\s*\\d+,\\s*\\d+\\].*\\}.*?</answer>') as format_rec
from (select gen_index, case when gen_index % 2 = 0 then '<think>a</think>' || chr(10) || '<answer>{"b": [' || gen_index || ', 2, 3, 4]}</answer>' else completion end as completion from v_texts)"""))
def format_rec(spark, sf):
    c = F.when(F.col("gen_index") % 2 == 0, F.concat(
        F.lit('<think>a</think>\n<answer>{"b": ['), F.col("gen_index").cast("string"), F.lit(", 2, 3, 4]}</answer>"))).otherwise(F.col("completion"))
    return view(spark, sf, "v_texts").select("gen_index", c.rlike(T.FORMAT_REC).alias("format_rec"))


@register("latex_normalize", with_sql("v_rollouts", """
select gen_index, canon, canon = '\\frac{' || gold_a || '}{' || gold_b || '}' as same from (select gen_index, spy_pred as gold_a, count_pred as gold_b, case gen_index % 8 when 0 then '\\frac{' || spy_pred || '}{' || count_pred || '}' when 1 then '\\frac{1}{2}' when 2 then '\\sqrt{' || spy_pred || '}' when 3 then cast(spy_pred as varchar)
 when 4 then case when spy_pred = 5 then '\\frac{1}{2}' else '0.' || spy_pred end when 5 then '\\frac{' || spy_pred || '}{' || count_pred || '}' when 6 then '\\frac{' || spy_pred || '}{' || count_pred || '}' else '90' end as canon from v_rollouts)"""))
def latex_normalize(spark, sf):
    q = view(spark, sf, "v_rollouts").selectExpr(
        "gen_index", "spy_pred", "count_pred", "case gen_index % 8 when 0 then concat('\\\\dfrac', spy_pred, count_pred) when 1 then '0.5' when 2 then concat('x = \\\\sqrt', spy_pred) "
        "when 3 then concat(spy_pred, '\\\\text{ cm}') when 4 then concat('.', spy_pred) when 5 then concat(spy_pred, '/', count_pred) "
        "when 6 then concat('so \\\\boxed{\\\\frac', spy_pred, '{', count_pred, '}}') else '90^\\\\circ' end as said")
    body = F.coalesce(T.last_boxed(F.col("said")), F.col("said"))
    gold = F.concat(F.col("spy_pred").cast("string"), F.lit("/"), F.col("count_pred").cast("string"))
    return q.select("gen_index", T.latex_normalize(body).alias("canon"), T.latex_equal(F.col("said"), gold).alias("same"))
