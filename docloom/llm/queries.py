"""The queries over the training-data tables, each over its whole tables; see TESTDATA.md for the columns of the pN_found ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import answer_defects, leaked_items, markup, near_duplicates, page_body, scan_noise, score_fusion, search_bait, shared_spans, token_ids
from docloom.session import read_table


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return near_duplicates.find_pairs(read_table(spark, root, "source_details"), read_table(spark, root, "document_info"))


def p1_text_pairs(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id_a, doc_id_b): the pairs of p1_found by text alone."""
    sources = read_table(spark, root, "source_details").select(F.col("doc_id").alias("id"), F.col("raw_text").alias("text"))
    return near_duplicates.record_pairs(*near_duplicates.text_pairs(sources))


def p1_classes(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, group_id): the near-duplicate group of every source text."""
    sources = read_table(spark, root, "source_details").select(F.col("doc_id").alias("id"), F.col("raw_text").alias("text"))
    return near_duplicates.text_groups(sources).withColumnRenamed("id", "doc_id")


def _fused(spark: SparkSession, root: str) -> DataFrame:
    return score_fusion.fuse(read_table(spark, root, "retrieval_results"), read_table(spark, root, "citations"))


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return score_fusion.heads(_fused(spark, root)).select(F.col("query").alias("query_id"), F.col("item").alias("chunk_id"))


def p2_ranking(spark: SparkSession, root: str) -> DataFrame:
    """(query_id, chunk_id, closeness, lists): the whole combined ranking."""
    return _fused(spark, root).select(F.col("query").alias("query_id"), F.col("item").alias("chunk_id"), "closeness", "lists")


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return scan_noise.find_noise(read_table(spark, root, "source_details"))


def p3_repaired(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, clean_text, noise) of every scanned page."""
    return scan_noise.repair(read_table(spark, root, "source_details"))


def _passages(spark: SparkSession, root: str) -> DataFrame:
    return shared_spans.passages_and_quotes(read_table(spark, root, "citations"), read_table(spark, root, "qa_items"))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return shared_spans.shared_spans(_passages(spark, root))


def p4_shares(spark: SparkSession, root: str) -> DataFrame:
    """(record_id, n_chars, shared_chars, shared_share) of every passage and quote."""
    return shared_spans.share_of_records(_passages(spark, root))


def _marked(spark: SparkSession, root: str) -> DataFrame:
    return markup.source_and_cited(read_table(spark, root, "source_details"), read_table(spark, root, "citations"))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return markup.find_markup(_marked(spark, root))


def p5_clean(spark: SparkSession, root: str) -> DataFrame:
    """(field_name, record_id, clean_text, markup) of every source text and cited passage."""
    return markup.clean_records(_marked(spark, root))


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    return page_body.find_boilerplate(read_table(spark, root, "source_details"))


def p6_bodies(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, text): the article of every web page."""
    return page_body.main_bodies(read_table(spark, root, "source_details"))


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    return answer_defects.find_defects(answer_defects.question_answer_pairs(read_table(spark, root, "chat_responses"), read_table(spark, root, "qa_items")))


def p8_ids(spark: SparkSession, root: str) -> DataFrame:
    return token_ids.encode_corpus(read_table(spark, root, "documents"))


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    return leaked_items.find_leaks(read_table(spark, root, "documents"), read_table(spark, root, "eval_items"))


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    return search_bait.find_bait(read_table(spark, root, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (p1_found, p1_text_pairs, p1_classes, p2_found, p2_ranking, p3_found, p3_repaired, p4_found, p4_shares, p5_found, p5_clean, p6_found, p6_bodies, p7_found, p8_ids, p9_found, p10_found)
    return {f.__name__: f for f in made}


#: Exact definitions in SQL, for small tables: all runs, all windows, all grams.
_SQL = {
    "p1_text_pairs": r"""with t as (select doc_id, min(raw_text) as text from source_details where doc_id is not null and regexp_matches(raw_text, '\S') group by 1),
w as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') as w from t), r as (select distinct doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as run from w where len(w) >= 3),
n as (select doc_id, count(*) as n from r group by 1), m as (select a.doc_id as a, b.doc_id as b, count(*) as common from r a join r b on a.run = b.run and a.doc_id < b.doc_id group by 1, 2)
select a as doc_id_a, b as doc_id_b from m join n x on x.doc_id = a join n y on y.doc_id = b where common >= 0.6 * (x.n + y.n - common)""",
    "p2_found": r"""with many as (select query_id from retrieval_results where query_id is not null and scorer is not null group by 1 having count(distinct scorer) >= 3),
l as (select query_id, scorer as lst, row_number() over () as id, chunks from retrieval_results where query_id is not null and scorer is not null),
e as (select query_id, lst, id, c.chunk_id as item, c.score as score from (select query_id, lst, id, unnest(chunks) as c from l) where c.chunk_id is not null and c.score is not null and not isnan(c.score) and not isinf(c.score)
 union all select query_id, chr(1) || 'citations', 0, chunk_id, max(score) from citations where query_id is not null and chunk_id is not null and score is not null and not isnan(score) and not isinf(score) group by query_id, chunk_id),
o as (select *, row_number() over (partition by query_id, lst, id order by score) as pos, count(*) over (partition by query_id, lst, id) as n from e),
q as (select query_id, lst, id, max(score) filter (where pos = greatest(1, ceil(n * 0.25))) as q1, max(score) filter (where pos = greatest(1, ceil(n * 0.5))) as q2, max(score) filter (where pos = greatest(1, ceil(n * 0.75))) as q3, min(score) as lo, max(score) as hi from o group by all),
b as (select *, greatest(q1 - 1.5 * (q3 - q1), lo) as low, least(q3 + 1.5 * (q3 - q1), hi) as high from q),
v as (select e.query_id, e.lst, e.id, item, least(greatest(score, low), high) - low as value, high - low as top, q2 - low as mid from e join b using (query_id, lst, id)),
z as (select query_id, lst, id, sqrt(sum(value * value)) as norm from v group by all),
s as (select query_id, lst, item, case when norm > 0 then value / norm else 0 end as value, case when norm > 0 then top / norm else 0 end as best, case when norm > 0 then mid / norm else 0 end as middle from v join z using (query_id, lst, id) where query_id in (select query_id from many)),
c as (select query_id, item, lst, max(value) as value, max(best) as best, max(middle) as middle from s group by all), p as (select query_id, lst, max(best) as best, max(middle) as middle from s group by all),
t as (select query_id, sum((best - middle) * (best - middle)) as up0, sum(middle * middle) as down0 from p group by 1),
i as (select query_id, item, sum((best - value) * (best - value) - (best - middle) * (best - middle)) as up, sum(value * value - middle * middle) as down, count(*) as lists from c group by all),
r as (select query_id, item, lists, sqrt(greatest(up + up0, 0)) as far, sqrt(greatest(down + down0, 0)) as good from i join t using (query_id))
select query_id, item as chunk_id from (select *, row_number() over (partition by query_id order by case when far + good > 0 then round(good / (far + good), 9) else 0.5 end desc, lists desc, item) as place from r) where place = 1""",
    "p4_found": r"""with r as (select record_id, min(text) as text from (select chunk_id as record_id, text from citations union all select id || ':' || pos, e.text from (select id, unnest(evidence) as e, generate_subscripts(evidence, 1) as pos from qa_items)) where record_id is not null and length(text) >= 100 group by 1),
w as (select record_id, start, text[start : start + 99] as piece from (select record_id, text, unnest(range(1, length(text) - 98)) as start from r)), shared as (select piece from w group by 1 having count(distinct record_id) > 1),
h as (select record_id, start from w join shared using (piece)), g as (select *, case when start <= lag(start) over (partition by record_id order by start) + 100 then 0 else 1 end as fresh from h),
i as (select *, sum(fresh) over (partition by record_id order by start) as island from g)
select record_id, min(start)::int as start_pos, (max(start) + 100 - min(start))::int as span_len from i group by record_id, island""",
    "p9_found": r"""with t as (select item_id, list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda x: lower(x)) as w from eval_items where text is not null), d as (select doc_id, list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda x: lower(x)) as w from documents where text is not null),
ig as (select item_id, len(w) as n, i, array_to_string(w[i : i + 7], ' ') as gram from (select *, unnest(range(1, len(w) - 6)) as i from t where len(w) >= 8)),
dg as (select distinct doc_id, array_to_string(w[i : i + 7], ' ') as gram from (select *, unnest(range(1, len(w) - 6)) as i from d where len(w) >= 8)),
c as (select distinct doc_id, item_id, n, unnest(range(i, i + 8)) as place from ig join dg using (gram))
select doc_id, item_id from c group by doc_id, item_id, n having count(*) >= 0.5 * n""",
}


_SQL["p1_classes"] = _SQL["p1_text_pairs"].replace("with t as", "with recursive t as", 1).rpartition("select a as doc_id_a")[0].rstrip() + """, e as (select a, b from m join n x on x.doc_id = a join n y on y.doc_id = b where common >= 0.6 * (x.n + y.n - common)),
sym as (select a, b from e union all select b, a from e), reach as (select doc_id as a, doc_id as b from n union select r.a, sym.b from reach r join sym on sym.a = r.b)
select a as doc_id, min(b) as group_id from reach group by 1"""
_SQL["p4_shares"] = _SQL["p4_found"].replace("select record_id, min(start)::int as start_pos, (max(start) + 100 - min(start))::int as span_len from i group by record_id, island", """spans as (select record_id, max(start) + 100 - min(start) as span_len from i group by record_id, island), total as (select record_id, sum(span_len)::bigint as shared_chars from spans group by 1),
every as (select record_id, coalesce(length(min(text)), 0)::int as n_chars from (select chunk_id as record_id, text from citations union all select id || ':' || pos, e.text from (select id, unnest(evidence) as e, generate_subscripts(evidence, 1) as pos from qa_items)) where record_id is not null group by 1)
select record_id, n_chars, coalesce(shared_chars, 0) as shared_chars, case when n_chars > 0 then round(coalesce(shared_chars, 0)::double / n_chars, 6) else 0.0 end::double as shared_share from every left join total using (record_id)""").replace("\nselect record_id, min(start)", ", select record_id, min(start)").replace("as island from g)\nspans as", "as island from g),\nspans as")


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
