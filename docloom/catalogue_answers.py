"""Queries over answers, memory, costs and evaluation; part of the catalogue."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom.catalogue import _PASSAGES, _QUESTIONS, _chat, _citations, _content, _documents, _items, _list, _not_found, _passages, _questions, _registry, _results, _sentences, _spans, _strip, _tok, _trigrams
from docloom.functions import text as T
from docloom.operators import answers, evaluation, library, ranking

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_ANSWERS = "answers as (select query_id, min(answer) as answer, min(question) as question from chat_responses where query_id is not null group by 1)"
_CITED = r"list_sort(list_distinct(list_transform(flatten(list_transform(regexp_extract_all(coalesce(answer,''), '\[(\d{1,3}(?:\s*[,;]\s*\d{1,3})*)\]', 1), lambda g: regexp_split_to_array(g, '\s*[,;]\s*'))), lambda n: n::int)))"


def _answers(spark, root):
    return _chat(spark, root).where("query_id is not null").groupBy("query_id").agg(F.min("answer").alias("answer"), F.min("question").alias("question"))


@query(f"""with {_PASSAGES} select query_id, md5(string_agg('[' || rank || '] (' || concat_ws(' | ', filename, case when lower(filename) like '%.pdf' and page is not null then case when page_end > page then 'pp. ' || page || '-' || page_end else 'p. ' || page end end, case when section <> 'General' then 'section: ' || section end) || ')' || chr(10) || text, chr(10) || chr(10) order by rank)) as prompt_md5 from cited where text is not null group by 1""")
def prompt_passages(spark, root):
    rows = _passages(spark, root).where("text is not null").withColumn("block", answers.passage_block(*(F.col(c) for c in ("rank", "filename", "page", "page_end", "section", "text"))))
    return rows.groupBy("query_id").agg(F.md5(answers.in_order("rank", "block", "\n\n")).alias("prompt_md5"))


@query(f"""with {_QUESTIONS}, {_PASSAGES}, s as (select query_id, question, style, rank, unnest({_sentences('text')}) as sentence, generate_subscripts({_sentences('text')}, 1) as pos from cited join questions using (query_id)),
c as (select *, round(case when len(list_distinct({_tok('question')})) > 0 then len(list_intersect(list_distinct({_tok('question')}), {_tok('sentence')}))::double / len(list_distinct({_tok('question')})) else 0 end + 0.15 / rank, 9) as score from s where length(sentence) >= 25 and sentence not like '#%'),
b as (select *, row_number() over (partition by query_id order by score desc, rank, pos) as place from c),
k as (select * from b where place <= case lower(style) when 'concise' then 2 when 'long' then 10 else 5 end),
j as (select query_id, case when min(lower(style)) = 'concise' then string_agg(sentence || ' [' || rank || ']', ' ' order by rank, pos) else '- ' || string_agg(sentence || ' [' || rank || ']', chr(10) || '- ' order by rank, pos) end as answer from k group by 1)
select query_id, coalesce(answer, '{T.NOT_FOUND.replace(chr(39), chr(39) * 2)}') as answer from (select distinct query_id from cited join questions using (query_id)) left join j using (query_id)""")
def extractive_answers(spark, root):
    rows = _passages(spark, root).drop("score").join(_questions(spark, root), "query_id").withColumn("style", F.coalesce("style", F.lit("medium")))
    return answers.extractive_answers(rows)


@query(f"with {_PASSAGES} select query_id, 'source-' || rank as id, rank::int as number, chunk_id, doc_id, filename, page::varchar as page, page_end::varchar as page_end, section, md5(text) as text, text[1:300] || case when length(text) > 300 then '...' else '' end as snippet, round(score, 4) as score from cited")
def built_citations(spark, root):
    rows = answers.citations(_passages(spark, root)).withColumn("text", F.md5("text"))
    return rows.withColumns({c: F.col(c).cast("string") for c in ("page", "page_end")})


@query(f"with {_ANSWERS} select query_id, array_to_string(list_transform({_CITED}, lambda n: n::varchar), ',') as cited from answers")
def cited_numbers(spark, root):
    return _answers(spark, root).select("query_id", F.array_join(F.transform(T.cited_numbers(F.col("answer")), lambda n: n.cast("string")), ",").alias("cited"))


_MARKER = r"[ \t]?\[\d{1,3}(?:\s*[,;]\s*\d{1,3})*\]"


@query(rf"""with {_ANSWERS}, p as (select query_id, coalesce(answer,'') || ' [1, 3][99] [2;1] 1234 [4567]' as answer from answers),
x as (select query_id, string_split(regexp_replace(answer, '{_MARKER}', chr(1), 'g'), chr(1)) as parts, list_transform(regexp_extract_all(answer, '{_MARKER}'), lambda m: case when len(list_filter(regexp_extract_all(m, '\d+'), lambda n: n::int between 1 and 3)) = 0 then '' else regexp_extract(m, '^[ \t]?') || array_to_string(list_transform(list_filter(regexp_extract_all(m, '\d+'), lambda n: n::int between 1 and 3), lambda n: '[' || n || ']'), '') end) as marks from p)
select query_id, md5(array_to_string(list_transform(range(1, len(parts) + 1), lambda i: parts[i] || coalesce(marks[i], '')), '')) as m from x""")
def normal_markers(spark, root):
    """Answers with one number a marker and no markers of sources beyond the third; every answer gets a few odd ones first."""
    text = F.concat(F.coalesce("answer", F.lit("")), F.lit(" [1, 3][99] [2;1] 1234 [4567]"))
    return _answers(spark, root).select("query_id", F.md5(T.normal_markers(text, F.lit(3))).alias("m"))


@query(f"with {_ANSWERS} select query_id, {_not_found('answer')} as not_found from answers")
def not_found_answers(spark, root):
    return _answers(spark, root).select("query_id", T.is_not_found(F.col("answer")).alias("not_found"))


@query(f"""with {_ANSWERS}, {_PASSAGES}, n as (select query_id, {_CITED} as named, {_not_found('answer')} as nothing from answers), h as (select query_id, rank, list_contains(named, rank) as hit, nothing from cited join n using (query_id)),
f as (select *, count(*) filter (where hit) over (partition by query_id) as hits from h where not nothing) select query_id, rank::int as number from f where hit or hits = 0""")
def selected_citations(spark, root):
    return answers.select_cited(answers.citations(_passages(spark, root)), _answers(spark, root)).select("query_id", "number")


@query(f"""with {_ANSWERS}, {_PASSAGES}, t as (select query_id, max(score) filter (where rank = 1) as top from cited group by 1), m as (select query_id, bool_or(low_relevance) as low, bool_or(scorer = 'summary') as summary, bool_or(scorer = 'cross-encoder') as ce from retrieval_results where query_id is not null group by 1)
select query_id, case when top is null or {_not_found('answer')} then 'Insufficient Evidence' when coalesce(summary, false) then 'High' when coalesce(low, false) then 'Low' when top >= case when coalesce(ce, false) then 0.5 else 0.55 end then 'High' when top >= case when coalesce(ce, false) then 0.1 else 0.35 end then 'Medium' else 'Low' end as confidence from answers left join t using (query_id) left join m using (query_id)""")
def confidence_labels(spark, root):
    tops = _passages(spark, root).groupBy("query_id").agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top"))
    facts = _results(spark, root).where("query_id is not null").groupBy("query_id").agg(F.bool_or("low_relevance").alias("low"), F.bool_or(F.col("scorer") == "summary").alias("summary"), F.bool_or(F.col("scorer") == "cross-encoder").alias("ce"))
    rows = _answers(spark, root).join(tops, "query_id", "left").join(facts, "query_id", "left")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    label = answers.confidence(F.col("answer"), F.col("top"), F.when(flag("ce"), "cross-encoder").otherwise("keyword"), flag("low"), F.when(flag("summary"), "summary").otherwise("hybrid"))
    return rows.select("query_id", label.alias("confidence"))


@query(f"""with {_PASSAGES}, t as (select query_id, min(rank) as rank, 'Tell me more about ' || topic as text from (select query_id, rank, list_last(string_split(coalesce(section,''), ' > ')) as topic from cited) where topic <> '' and topic <> 'General' and length(topic) < 60 group by query_id, topic),
f as (select query_id, 1000000 as rank, 'Summarize ' || arg_min(filename, (rank, filename)) as text from cited where filename is not null group by 1), u as (select * from t union all select * from f), n as (select *, row_number() over (partition by query_id order by rank, text) as n from u)
select query_id, string_agg(text, ' / ' order by n) as suggestions from n where n <= 3 group by 1""")
def follow_up_questions(spark, root):
    return answers.follow_ups(_passages(spark, root))


@query(f"""with {_ANSWERS}, s as (select query_id, answer || '<<<FOLLOWUPS>>> ["' || replace(replace(question, chr(92), ' '), '"', ' ') || '", " ", "Why?"]' as stream from answers where answer is not null and question is not null)
select query_id, md5(split_part(stream, '<<<FOLLOWUPS>>>', 1)) as visible_md5, {_strip("replace(replace(question, chr(92), ' '), '" + chr(34) + "', ' ')")} || ' / Why?' as follow_ups from s join answers using (query_id)""")
def split_streams(spark, root):
    rows = _answers(spark, root).where("answer is not null and question is not null")
    asked = F.replace(F.replace("question", F.lit("\\"), F.lit(" ")), F.lit('"'), F.lit(" "))
    rows = rows.withColumn("stream", F.concat("answer", F.lit('<<<FOLLOWUPS>>> ["'), asked, F.lit('", " ", "Why?"]')))
    shown, tail = answers.split_at_mark(F.col("stream"))
    return rows.select("query_id", F.md5(shown).alias("visible_md5"), F.array_join(answers.parsed_follow_ups(tail), " / ").alias("follow_ups"))


# ---------------------------------------------------------------- memory and cost


_TURNS = "turns as (select conversation_id, query_id as turn, min(question) as question, min(answer) as answer from chat_responses where conversation_id is not null and query_id is not null group by 1, 2)"
_STORED = r"(case when length(b) > 1200 then regexp_replace(b[1:1200], ' [^ ]*$', '') || ' ...' else b end)"
_REMEMBERED = f"{_TURNS}, b as (select conversation_id, turn, question, " + _strip(r"regexp_replace(coalesce(answer,''), '[ \t]*(?:\[\d{1,3}\])+', '', 'g')") + f" as b, row_number() over (partition by conversation_id order by turn desc) as back from turns), l as (select conversation_id from b group by 1 order by max(turn) desc, conversation_id limit 200), kept as (select conversation_id, turn, question, {_STORED} as answer from b where back <= 6 and conversation_id in (select conversation_id from l))"


def _remembered(spark, root):
    turns = _chat(spark, root).where("conversation_id is not null and query_id is not null").groupBy("conversation_id", F.col("query_id").alias("turn")).agg(F.min("question").alias("question"), F.min("answer").alias("answer"))
    return library.remembered(turns)


@query(f"with {_REMEMBERED} select conversation_id, turn, md5(coalesce(question,'') || '|' || answer) as m from kept")
def conversation_memory(spark, root):
    return _remembered(spark, root).select("conversation_id", "turn", F.md5(F.concat(F.coalesce("question", F.lit("")), F.lit("|"), F.col("answer"))).alias("m"))


@query(f"with {_REMEMBERED} select conversation_id, md5('Conversation so far:' || chr(10) || string_agg('User: ' || coalesce(question,'') || chr(10) || 'Assistant: ' || answer, chr(10) order by turn) || chr(10) || chr(10)) as prompt_md5 from kept group by 1")
def history_prompts(spark, root):
    return library.history_prompt(_remembered(spark, root)).select("conversation_id", F.md5("prompt").alias("prompt_md5"))


_CALLS = "calls as (select event_id, user_id, (event_id % 5000)::bigint as tin, (event_id % 700)::bigint as tout, ['gemini-2.0-flash','gemini-2.5-flash','models/gemini-2.5-pro','gemini-embedding-001','unknown-model'][1 + event_id % 5] as model, case when event_id % 11 = 0 then 'local' else 'api' end as provider from events), priced as (select *, case when provider = 'local' then 0 else round((tin * i + tout * o) / 1e6, 12) end as cost from calls left join (select * from (values " + ",".join(f"('{m}',{i},{o})" for m, (i, o) in library.PRICES.items()) + ") as p(name, i, o)) on name = replace(model, 'models/', ''))"


def _calls(spark, root):
    from docloom.session import read_table

    e = read_table(spark, root, "events")
    names = F.array(*(F.lit(x) for x in ("gemini-2.0-flash", "gemini-2.5-flash", "models/gemini-2.5-pro", "gemini-embedding-001", "unknown-model")))
    calls = e.select("event_id", "user_id", (F.col("event_id") % 5000).alias("tin"), (F.col("event_id") % 700).alias("tout"), F.element_at(names, (1 + F.col("event_id") % 5).cast("int")).alias("model"), F.when(F.col("event_id") % 11 == 0, "local").otherwise("api").alias("provider"))
    return calls.withColumn("cost", library.cost(F.col("model"), F.col("tin"), F.col("tout"), F.col("provider")))


@query(f"with {_CALLS} select event_id, cost::double as cost from priced")
def call_costs(spark, root):
    return _calls(spark, root).select("event_id", "cost")


@query(f"with {_CALLS} select user_id, sum(tin)::bigint as tokens_in, sum(tout)::bigint as tokens_out, round(sum(cost), 8)::double as known_cost, count(*) = count(cost) as complete, bool_or(event_id % 7 = 0) as estimated, count(*) as calls from priced group by 1")
def trace_summary(spark, root):
    return _calls(spark, root).groupBy("user_id").agg(F.sum("tin").alias("tokens_in"), F.sum("tout").alias("tokens_out"), F.round(F.sum("cost"), 8).alias("known_cost"), (F.count("*") == F.count("cost")).alias("complete"), F.bool_or(F.col("event_id") % 7 == 0).alias("estimated"), F.count("*").alias("calls"))


@query("select user_id, event_type as stage, round(sum(value), 2) as ms from events where value is not null group by 1, 2")
def trace_stages(spark, root):
    """Time by stage of every trace: the events of a user as one trace, their types as its stages."""
    from docloom.session import read_table

    return read_table(spark, root, "events").where("value is not null").groupBy("user_id", F.col("event_type").alias("stage")).agg(F.round(F.sum("value"), 2).alias("ms"))


@query("select doc_id, (case when length(coalesce(text,'')) = 0 then 0 else (length(text) + 3) // 4 end)::int as tokens from documents")
def estimated_tokens(spark, root):
    return _documents(spark, root).select("doc_id", T.estimated_tokens(F.col("text")).alias("tokens"))


_EST = lambda x: f"(case when length(coalesce({x},'')) = 0 then 0 else (length({x}) + 3) // 4 end)"


@query(f"""with {_QUESTIONS}, {_PASSAGES}, p as (select query_id, any_value(style) as style, any_value({_EST('question')}) as q, sum({_EST('text')})::bigint as prompt_tokens from cited join questions using (query_id) where rank <= case lower(style) when 'concise' then 4 when 'long' then 10 else 6 end group by 1),
o as (select *, case lower(style) when 'concise' then 100 when 'long' then 900 else 250 end as out from p)
select query_id, prompt_tokens, round(round((prompt_tokens * 0.1::double + out * 0.4::double) / 1e6, 12) + round(q * 0.15::double / 1e6, 12), 12)::double as answer_cost, round(round(((prompt_tokens + 250) * 0.1::double + (out + 100) * 0.4::double) / 1e6, 12) + round(3 * q * 0.15::double / 1e6, 12), 12)::double as whole_cost from o""")
def projected_costs(spark, root):
    """What each question would cost with a model: its answer alone, and with rewriting, follow-ups and all embeddings."""
    asked = _questions(spark, root)
    rows = _passages(spark, root).drop("score").join(asked, "query_id").where(F.col("rank") <= ranking.style_k(F.col("style")))
    sums = rows.groupBy("query_id").agg(F.first("style").alias("style"), F.first(T.estimated_tokens(F.col("question"))).alias("q"), F.sum(T.estimated_tokens(F.col("text"))).alias("prompt_tokens"))
    costs = {name: library.projected_cost(F.col("style"), F.col("prompt_tokens"), F.col("q"), whole) for name, whole in (("answer_cost", False), ("whole_cost", True))}
    return sums.withColumns(costs).select("query_id", "prompt_tokens", "answer_cost", "whole_cost")


_STATUS = "['QUOTA exceeded','timed out','connect refused','fine','UNAVAILABLE','PERMISSION_DENIED','model NOT_FOUND'][1 + event_id % 7]"


@query(f"""with e as (select event_id, [200,404,429,500,401,0][1 + event_id % 6] as s, upper({_STATUS}) as t from events) select event_id, case when s = 429 or regexp_matches(t,'RESOURCE_EXHAUSTED|QUOTA') then 'API quota or rate limit exceeded' when s in (401,403) or regexp_matches(t,'API_KEY_INVALID|API KEY NOT VALID|PERMISSION_DENIED') then 'API key was rejected (check that it is valid)'
 when s = 404 or t like '%NOT_FOUND%' then 'model not found (check the configured model name)' when s in (500,502,503,504) or t like '%UNAVAILABLE%' then 'the AI service is temporarily unavailable' when regexp_matches(t,'TIMEOUT|TIMED OUT') then 'the request to the AI service timed out' when regexp_matches(t,'CONNECT|NAME RESOLUTION|NETWORK') then 'could not connect to the AI service' else 'request failed' end as message from e""")
def error_messages(spark, root):
    from docloom.session import read_table

    e = read_table(spark, root, "events")
    texts = F.array(*(F.lit(x) for x in ("QUOTA exceeded", "timed out", "connect refused", "fine", "UNAVAILABLE", "PERMISSION_DENIED", "model NOT_FOUND")))
    codes = F.array(*(F.lit(x) for x in (200, 404, 429, 500, 401, 0)))
    return e.select("event_id", T.error_message(F.element_at(codes, (1 + F.col("event_id") % 6).cast("int")), F.element_at(texts, (1 + F.col("event_id") % 7).cast("int"))).alias("message"))


# ---------------------------------------------------------------- evaluation


_QA = "qa as (select id, min(question) as question, min(type) as type, min(reference_answer) as reference, any_value(evidence) as evidence, min(evidence_mode) as mode from qa_items where id is not null group by 1), ev as (select id as qid, unnest(evidence) as e, generate_subscripts(evidence, 1)::int as span_no, mode from qa), evidence as (select qid, span_no, e.doc as doc, e.text as span, mode from ev)"
_CHUNKS = "chunks as (select chunk_id, min(filename) as doc, min(text) as text from citations where chunk_id is not null and text is not null group by 1)"
_COVER = f"(case when contains(lower(regexp_replace(regexp_replace(c.text, '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')), lower(regexp_replace(regexp_replace(span, '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g'))) then 1.0 when len({_trigrams('span')}) > 0 then len(list_intersect({_trigrams('span')}, {_trigrams('c.text')}))::double / len({_trigrams('span')}) else 0 end)"


def _qa(spark, root):
    return _items(spark, root).where("id is not null").groupBy("id").agg(F.min("question").alias("question"), F.min("type").alias("type"), F.min("reference_answer").alias("reference"), F.any_value("evidence").alias("evidence"), F.min("evidence_mode").alias("mode"))


def _evidence(spark, root):
    rows = _qa(spark, root).select(F.col("id").alias("qid"), "mode", F.posexplode("evidence").alias("at", "e"))
    return rows.select("qid", (F.col("at") + 1).cast("int").alias("span_no"), F.col("e.doc").alias("doc"), F.col("e.text").alias("span"), "mode")


def _chunks(spark, root):
    return _citations(spark, root).where("chunk_id is not null and text is not null").groupBy("chunk_id").agg(F.min("filename").alias("doc"), F.min("text").alias("text"))


@query(f"with {_QA}, {_CHUNKS} select qid, span_no, count(*) as chunks, round(max({_COVER}), 9) as best from evidence join chunks c on c.doc = evidence.doc group by 1, 2")
def evidence_coverage(spark, root):
    rows = _evidence(spark, root).join(_chunks(spark, root), "doc").withColumn("c", T.span_coverage(F.col("span"), F.col("text")))
    return rows.groupBy("qid", "span_no").agg(F.count("*").alias("chunks"), F.round(F.max("c"), 9).alias("best"))


def _retrieved(spark, root):
    """Chunks of each item's documents in the order of coverage of its question: a ranking to be measured."""
    qa = _qa(spark, root).select(F.col("id").alias("qid"), "question")
    docs = _evidence(spark, root).select("qid", "doc").distinct()
    rows = docs.join(_chunks(spark, root), "doc").join(qa, "qid").withColumn("s", F.round(T.coverage(T.tokens(F.col("question")), T.tokens(F.col("text"))), 6))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("s"), "chunk_id")))


_RETRIEVED = f"docs as (select distinct qid, doc from evidence), rr as (select qid, chunk_id, doc, text, row_number() over (partition by qid order by s desc, chunk_id) as rank from (select d.qid, c.chunk_id, c.doc, c.text, round(case when len(list_distinct({_tok('q.question')})) > 0 then len(list_intersect(list_distinct({_tok('q.question')}), {_tok('c.text')}))::double / len(list_distinct({_tok('q.question')})) else 0 end, 6) as s from docs d join chunks c using (doc) join qa q on q.id = d.qid))"


@query(f"""with {_QA}, {_CHUNKS}, {_RETRIEVED}, g as (select c.qid, c.rank, span_no from rr c join evidence e on e.qid = c.qid and e.doc = c.doc where {_COVER} >= 0.5),
n as (select qid, count(*) as n_spans, min(mode) = 'any' as any_mode from evidence group by 1), rel as (select qid, count(distinct rank) as n_relevant from g group by 1),
m as (select n.qid, n_spans, any_mode, coalesce(n_relevant, 0) as n_relevant from n left join rel using (qid))
select qid, {', '.join(f"max(case when g.rank <= {k} then 1.0 else 0.0 end)::double as hit_{k}" for k in evaluation.CUTS).replace('max(case', 'coalesce(max(case').replace('end)::double', 'end), 0)::double')},
 {', '.join(f"round(case when any_mode then case when count(distinct case when g.rank <= {k} then span_no end) > 0 then 1.0 else 0.0 end else count(distinct case when g.rank <= {k} then span_no end)::double / n_spans end, 9) as recall_{k}" for k in evaluation.CUTS)},
 count(distinct case when g.rank <= 5 then g.rank end) / 5.0::double as precision_5, round(coalesce(1.0::double / min(g.rank), 0), 9) as mrr,
 round(case when n_relevant > 0 then coalesce((select sum(1 / log2(r + 1)) from (select distinct rank as r from g g2 where g2.qid = m.qid and rank <= 10)), 0) / (select sum(1 / log2(i + 1)) from range(1, 11) t(i) where i <= n_relevant) else 0 end, 9) as ndcg_10
 from m left join g using (qid) group by qid, n_spans, any_mode, n_relevant""")
def retrieval_metrics(spark, root):
    full = _metrics(spark, root)
    return full.select("qid", *(f"hit_{k}" for k in evaluation.CUTS), *(f"recall_{k}" for k in evaluation.CUTS), "precision_5", "mrr", "ndcg_10")


def _metrics(spark, root):
    evidence = _evidence(spark, root)
    marks = evaluation.graded(_retrieved(spark, root), evidence.select("qid", "span_no", "doc", "span"))
    spans = evidence.groupBy("qid").agg(F.count("*").alias("n_spans"), (F.min("mode") == "any").alias("any_mode"))
    relevant = marks.where("span_no is not null").groupBy("qid").agg(F.countDistinct("rank").alias("n_relevant"))
    spans = spans.join(relevant, "qid", "left").withColumn("n_relevant", F.coalesce("n_relevant", F.lit(0)).cast("int"))
    return evaluation.metrics(marks, spans)


_GRADED = f"""g as (select c.qid, c.rank, span_no from rr c join evidence e on e.qid = c.qid and e.doc = c.doc where {_COVER} >= 0.5), n as (select qid, count(*) as n_spans, min(mode) = 'any' as any_mode from evidence group by 1),
u as (select qid, rank, sum(case when length(text) = 0 then 0 else (length(text) + 3) // 4 end) over (partition by qid order by rank) as used from rr)"""


@query(f"""with {_QA}, {_CHUNKS}, {_RETRIEVED}, {_GRADED}, five as (select qid, max(used) filter (where rank <= 5)::int as tokens_5 from u group by 1), r as (select g.qid, g.span_no, used from g join u on u.qid = g.qid and u.rank = g.rank)
select n.qid, coalesce(any_value(tokens_5), 0) as tokens_5, {', '.join(f"round(case when any_mode then case when count(distinct case when used <= {b} then span_no end) > 0 then 1.0 else 0.0 end else count(distinct case when used <= {b} then span_no end)::double / n_spans end, 9)::double as recall_{b}t" for b in (500, 1000, 2000))}
from n left join r using (qid) left join five using (qid) group by n.qid, n_spans, any_mode""")
def budget_metrics(spark, root):
    """Evidence recall within token budgets and tokens of the first five passages."""
    return _metrics(spark, root).select("qid", "tokens_5", *(f"recall_{b}t" for b in evaluation.BUDGETS))


@query(f"""with {_QA}, {_CHUNKS}, h as (select e.qid, e.span_no, c.chunk_id from evidence e join chunks c on c.doc = e.doc where {_COVER} >= 0.5), n as (select qid, count(*) as n, min(mode) = 'any' as any_mode from evidence group by 1),
f as (select qid, count(distinct span_no) as spans, count(distinct chunk_id) as n_relevant from h group by 1)
select qid, round(case when any_mode then (coalesce(spans, 0) > 0)::int::double else coalesce(spans, 0)::double / n end, 9) as max_recall, coalesce(n_relevant, 0) as n_relevant from n left join f using (qid)""")
def reachable_recall(spark, root):
    """The recall any ranking of the stored chunks could reach for each question."""
    return evaluation.best_recall(_chunks(spark, root), _evidence(spark, root))


_HASHED_WEIGHT = "list_sum(list_transform([0.0, 0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183], lambda cut: case when ('0x' || md5(qid || ':' || round || ':7')[1:8])::bigint / 4294967296.0::double >= cut then 1 else 0 end))"
_RECALL_5 = f"""{_QA}, {_CHUNKS}, {_RETRIEVED}, {_GRADED}, m as (select n.qid, round(case when any_mode then case when count(distinct case when g.rank <= 5 then span_no end) > 0 then 1.0 else 0.0 end else count(distinct case when g.rank <= 5 then span_no end)::double / n_spans end, 9)::double as recall_5, round(coalesce(1.0::double / min(g.rank), 0), 9) as mrr from n left join g using (qid) group by n.qid, n_spans, any_mode)"""


@query(f"""with {_RECALL_5}, t as (select m.*, coalesce(qa.type, 'none') as type from m join qa on qa.id = m.qid),
w as (select qid, recall_5, round, {_HASHED_WEIGHT} as w from m, (select unnest(range(1, 201)) as round)), s as (select round, sum(w * recall_5) / sum(w) as mean from w group by 1 having sum(w) > 0)
select type, n, recall_5, mrr, case when type = 'all' then (select round(quantile_cont(mean, 0.025), 6) from s) end as low, case when type = 'all' then (select round(quantile_cont(mean, 0.975), 6) from s) end as high from
(select type, count(*) as n, round(avg(recall_5), 6) as recall_5, round(avg(mrr), 6) as mrr from t group by 1 union all select 'all', count(*), round(avg(recall_5), 6), round(avg(mrr), 6) from t)""")
def metric_summary(spark, root):
    """Means by question type and over all, with an interval of recall at 5 from hashed resamples."""
    rows = _metrics(spark, root).join(_qa(spark, root).select(F.col("id").alias("qid"), "type"), "qid")
    means = rows.groupBy(F.coalesce("type", F.lit("none")).alias("type")).agg(F.count("*").alias("n"), F.round(F.avg("recall_5"), 6).alias("recall_5"), F.round(F.avg("mrr"), 6).alias("mrr"))
    every = rows.agg(F.lit("all").alias("type"), F.count("*").alias("n"), F.round(F.avg("recall_5"), 6).alias("recall_5"), F.round(F.avg("mrr"), 6).alias("mrr"))
    spread = evaluation.bootstrap_means(rows.select(F.lit("all").alias("type"), "recall_5", F.col("qid").alias("row_key")), "type", "recall_5").select("type", "low", "high")
    return means.unionByName(every).join(spread, "type", "left")


#: Ways to rank that the grid compares, by name: coverage, coverage of the section's text as well, and the order of ids as baseline.
_WAYS = ("by id", "by coverage", "by length")
_WAY_ORDER = {"by id": [F.asc, "chunk_id"], "by coverage": [F.desc, "s"], "by length": [F.desc, "size"]}


def _grid_rows(spark, root):
    """(chunking, retrieval, qid, recall_5, mrr, hit_5, prompt_tokens): each way of ranking each half of the chunks, long and short ones, and all."""
    base = _retrieved(spark, root).drop("rank").withColumn("size", F.length("text")).persist()
    evidence = _evidence(spark, root)
    spans = evidence.groupBy("qid").agg(F.count("*").alias("n_spans"), (F.min("mode") == "any").alias("any_mode")).withColumn("n_relevant", F.lit(1))
    out = None
    for chunking, cut in (("all", F.lit(True)), ("long", F.col("size") >= 400)):
        for way in _WAYS:
            direction, column = _WAY_ORDER[way]
            ranked = base.where(cut).withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(direction(column), "chunk_id")))
            marks = evaluation.graded(ranked, evidence.select("qid", "span_no", "doc", "span"))
            rows = evaluation.metrics(marks, spans).select(F.lit(chunking).alias("chunking"), F.lit(way).alias("retrieval"), "qid", "recall_5", "mrr", "hit_5", F.col("tokens_5").alias("prompt_tokens"))
            out = rows if out is None else out.unionByName(rows)
    return out


def _grid_sql() -> str:
    parts = []
    for chunking, cut in (("all", "true"), ("long", "length(text) >= 400")):
        for way, order in (("by id", "chunk_id"), ("by coverage", "s desc, chunk_id"), ("by length", "length(text) desc, chunk_id")):
            parts.append(f"select '{chunking}' as chunking, '{way}' as retrieval, qid, chunk_id, doc, text, row_number() over (partition by qid order by {order}) as rank from rs where {cut}")
    rs = _RETRIEVED.partition("rr as (")
    inner = rs[2][rs[2].index("from (") + 6 :].rstrip()[:-2]
    return f"""{_QA}, {_CHUNKS}, {rs[0].rstrip().rstrip(',')}, rs as (select * from ({inner})), ways as ({' union all '.join(parts)}),
configs as (select distinct chunking, retrieval from (select * from (values ('all'), ('long')) a(chunking), (values ('by id'), ('by coverage'), ('by length')) b(retrieval))),
n as (select qid, count(*) as n_spans, min(mode) = 'any' as any_mode from evidence group by 1), hits as (select c.chunking, c.retrieval, c.qid, c.rank, span_no from ways c join evidence e on e.qid = c.qid and e.doc = c.doc where {_COVER} >= 0.5),
m as (select chunking, retrieval, n.qid, round(case when any_mode then case when count(distinct case when h.rank <= 5 then span_no end) > 0 then 1.0 else 0.0 end else count(distinct case when h.rank <= 5 then span_no end)::double / n_spans end, 9)::double as recall_5, round(coalesce(1.0::double / min(h.rank), 0), 9) as mrr, coalesce(max(case when h.rank <= 5 then 1.0 else 0.0 end), 0)::double as hit_5
 from configs cross join n left join hits h using (chunking, retrieval, qid) group by chunking, retrieval, n.qid, n_spans, any_mode),
tok as (select chunking, retrieval, qid, sum(case when length(text) = 0 then 0 else (length(text) + 3) // 4 end) filter (where rank <= 5) as t from ways group by all)"""


@query(f"with {_grid_sql()} select chunking, retrieval, count(*) as questions, round(avg(recall_5), 4) as recall_5, round(avg(mrr), 4) as mrr, round(avg(hit_5), 4) as hit_5, round(avg(coalesce(t, 0)), 1)::double as prompt_tokens, round(1000 * avg((coalesce(t, 0) * 0.1 + 250 * 0.4) / 1e6), 4)::double as usd_per_1k from m left join tok using (chunking, retrieval, qid) group by 1, 2")
def config_summaries(spark, root):
    """Every chunking and way of ranking measured: quality, tokens and cost."""
    rows = _grid_rows(spark, root).withColumns({"ms": F.lit(0.0), "scorer": F.lit("keyword"), "wanted": F.lit("keyword"), "cost": library.cost(F.lit("gemini-2.0-flash"), F.col("prompt_tokens"), F.lit(250), F.lit("api"))})
    return evaluation.config_summary(rows).drop("ms_p50", "ms_p95", "fallbacks")


@query(f'with {_grid_sql()} select chunking, {", ".join(f"round(avg(mrr) filter (where retrieval = {chr(39)}{w}{chr(39)}), 4) as {chr(34)}{w}{chr(34)}" for w in _WAYS)} from m group by 1')
def config_grid(spark, root):
    """Mean reciprocal rank by chunking and way of ranking."""
    rows = _grid_rows(spark, root).groupBy("chunking", "retrieval").agg(F.round(F.avg("mrr"), 4).alias("mrr"))
    return evaluation.grid(rows, "mrr", list(_WAYS))


@query()
def significance(spark, root):
    """Paired bootstrap of every way of ranking against the order of ids, on reciprocal ranks."""
    rows = _grid_rows(spark, root).where("chunking = 'all'").select("retrieval", "qid", "mrr")
    return evaluation.paired_bootstrap(rows, "retrieval", "qid", "mrr", "by id")


@query()
def recall_intervals(spark, root):
    """Means with bootstrap intervals of 2,000 multinomial resamples, by way of ranking."""
    return evaluation.exact_bootstrap(_grid_rows(spark, root).where("chunking = 'all'"), "retrieval", "recall_5")


_CLAIM_CUT = r"regexp_replace(coalesce(answer,''), '(?i)\*?\[(?:Doc|Source)[^\]]*\]\*?|\[\d{1,3}\]', '', 'g')"
_CLAIM_LINES = f"list_filter(list_transform(string_split({_CLAIM_CUT}, chr(10)), lambda x: {_strip('x')}), lambda x: x <> '' and not regexp_matches(x, '^(?:#|>|---)') and not contains(x, '⚠️'))"
_CLAIM_BARE = "list_filter(list_transform(" + _CLAIM_LINES + ", lambda x: " + _strip("regexp_replace(regexp_replace(x, '[*_`]+', '', 'g'), '^[-• ]+', '')") + r"), lambda x: not (x like '%:' and length(x) < 120) and not regexp_matches(x, '(?i)^\S+\.(?:txt|md|pdf|docx?|html?|json|csv|py) \(Page \d+'))"
_CLAIMS = f"list_filter(flatten(list_transform({_CLAIM_BARE}, lambda x: {_spans('x')})), lambda s: len({_content('s')}) >= 4)"


@query(f"with {_ANSWERS} select query_id, len({_CLAIMS})::int as n_claims, md5(array_to_string({_CLAIMS}, '|')) as m from answers")
def extracted_claims(spark, root):
    c = _answers(spark, root).select("query_id", evaluation.claims(F.col("answer")).alias("c"))
    return c.select("query_id", F.size("c").alias("n_claims"), F.md5(F.array_join("c", "|")).alias("m"))


def _judged(spark, root):
    context = _passages(spark, root).where("text is not null").groupBy("query_id").agg(answers.in_order("rank", "text", "\n\n").alias("context"))
    return evaluation.faithfulness(_answers(spark, root).join(context, "query_id"))


@query(f"""with {_ANSWERS}, {_PASSAGES}, x as (select query_id, string_agg(text, chr(10) || chr(10) order by rank) as context from cited where text is not null group by 1),
j as (select query_id, {_CLAIMS} as cl, list_transform({_spans('context')}, lambda s: {_content('s')}) as sets, regexp_extract_all(context, '\\d+(?:\\.\\d+)?') as nums from answers join x using (query_id)),
w as (select query_id, cl, nums, case when len(sets) >= 2 then list_transform(range(1, len(sets)), lambda i: list_distinct(list_concat(sets[i], sets[i+1]))) else sets end as win from j),
c as (select query_id, nums, win, unnest(cl) as claim from w),
s as (select query_id, case when len(list_filter(regexp_extract_all(claim, '\\d+(?:\\.\\d+)?'), lambda n: not list_contains(nums, n))) > 0 then 0.0 else coalesce(list_max(list_transform(win, lambda y: len(list_intersect({_content('claim')}, y))::double / len({_content('claim')}))), 0) end as sup from c)
select w.query_id, len(cl)::int as n_claims, coalesce(u, 0)::int as n_unsupported, case when len(cl) > 0 then round(1 - coalesce(u, 0)::double / len(cl), 9) end as faithfulness from w left join (select query_id, count(*) filter (where sup < 0.75) as u from s group by 1) using (query_id)""")
def answer_faithfulness(spark, root):
    return _judged(spark, root).select("query_id", "n_claims", "n_unsupported", "faithfulness")


_EXTRACTED = f"""es as (select qid, question, span_no as rank, unnest({_sentences('span')}) as sentence, generate_subscripts({_sentences('span')}, 1) as pos from evidence join qa on qa.id = evidence.qid where span is not null),
ec as (select *, round(case when len(list_distinct({_tok('question')})) > 0 then len(list_intersect(list_distinct({_tok('question')}), {_tok('sentence')}))::double / len(list_distinct({_tok('question')})) else 0 end + 0.15 / rank, 9) as score from es where length(sentence) >= 25 and sentence not like '#%'),
ek as (select * from (select *, row_number() over (partition by qid order by score desc, rank, pos) as place from ec) where place <= 5),
drawn as (select qid, '- ' || string_agg(sentence || ' [' || rank || ']', chr(10) || '- ' order by rank, pos) as answer from ek group by 1)"""
_ABSTAINED = r"(?i)insufficient evidence|do not contain sufficient|does not contain (?:enough|sufficient)|not (?:mentioned|covered|addressed) in the (?:provided )?documents"


def _drawn(spark, root):
    """(id, reference, answer): each item's extractive answer from its own evidence."""
    qa = _qa(spark, root)
    rows = _evidence(spark, root).where("span is not null").join(qa.select(F.col("id").alias("qid"), "question"), "qid")
    built = answers.extractive_answers(rows.select(F.col("qid").alias("query_id"), "question", F.lit("medium").alias("style"), F.col("span_no").alias("rank"), F.col("span").alias("text")))
    return qa.select("id", "reference").join(built.select(F.col("query_id").alias("id"), "answer"), "id")


@query(rf"""with {_QA}, {_EXTRACTED}, j as (select distinct qa.id, qa.reference, coalesce(drawn.answer, 'I couldn''t find this in the uploaded documents.') as answer from qa join evidence on evidence.qid = qa.id left join drawn on drawn.qid = qa.id where span is not null)
select id, case when len({_content('reference')}) > 0 then round(len(list_intersect({_content('reference')}, {_content('answer')}))::double / len({_content('reference')}), 9) end as recall, {_not_found('answer')} or regexp_matches(answer, '{_ABSTAINED}') as abstained from j""")
def judge_records(spark, root):
    """How much of the reference the answer has, and whether it abstains; the answers are extracts from the evidence."""
    own = T.content_words(F.col("reference"))
    recall = T.let(own, lambda w: F.when(F.size(w) > 0, F.round(F.size(F.array_intersect(w, T.content_words(F.col("answer")))) / F.size(w), 9)))
    return _drawn(spark, root).select("id", recall.alias("recall"), evaluation.is_abstention(F.col("answer")).alias("abstained"))


@query()
def judge_calibration(spark, root):
    """The judge on answers whose faithfulness is known: evidence as it is, with a sentence of another document put in, with its digits changed."""
    spans = _evidence(spark, root).where("span is not null and doc is not null")
    chunks = _chunks(spark, root)
    contexts = spans.join(chunks, "doc").groupBy("qid").agg(F.array_join(F.array_sort(F.collect_set("text")), "\n\n").alias("context"))
    own = spans.groupBy("qid").agg(answers.in_order("span_no", "span", "\n").alias("answer"), F.min("doc").alias("doc"))
    sentence = F.filter(T.sentence_spans(F.col("text")), lambda x: (F.size(T.content_words(x)) >= 8) & ~F.startswith(x, F.lit("#")))
    pool = chunks.select("doc", F.get(sentence, F.lit(0)).alias("foreign")).where("foreign is not null").groupBy("doc").agg(F.min("foreign").alias("foreign"))
    # every document lends its sentence to the items of the next one in the order of a hash: a fixed choice that needs no pairs
    order = Window.partitionBy("part").orderBy("h", "doc")
    ring = pool.withColumn("h", F.xxhash64("doc")).withColumn("part", F.pmod("h", F.lit(16)))
    ring = ring.withColumn("lent", F.coalesce(F.lead("foreign").over(order), F.first("foreign").over(order)))
    lent = ring.select("doc", "lent").where("lent <> foreign")
    return evaluation.calibration(own.join(contexts, "qid").join(lent, "doc", "left"))


@query(f"with {_ANSWERS} select query_id, md5(translate(coalesce(answer,''), '0123456789', '3456789012')) as swapped_md5 from answers")
def swapped_numbers(spark, root):
    """The judge's calibration: answers with every digit moved on by three."""
    return _answers(spark, root).select("query_id", F.md5(F.translate(F.coalesce("answer", F.lit("")), "0123456789", "3456789012")).alias("swapped_md5"))


_FAULTY = """faulty as (select id, question, type, evidence, evidence_mode from qa_items union all select id, question || '?', type, evidence, evidence_mode from qa_items where type = 'unanswerable'
 union all select id || '-mode', question, type, evidence, 'some' from qa_items union all select id || '-lost', question, type, list_transform(evidence, lambda e: {'doc': 'lost/' || e.doc, 'text': e.text}), evidence_mode from qa_items
 union all select id || '-text', question, type, list_transform(evidence, lambda e: {'doc': e.doc, 'text': 'Not so: ' || e.text}), evidence_mode from qa_items union all select id || '-none', question, 'factual', [], evidence_mode from qa_items)"""


def _squeezed_sql(x: str) -> str:
    return f"lower(regexp_replace(regexp_replace({x}, '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g'))"


@query(f"""with {_FAULTY}, {_CHUNKS}, d as (select id, count(*) as n from (select distinct id, question, type from faulty) where id is not null group by 1), q as (select id, any_value(type) as type, any_value(evidence) as evidence, min(evidence_mode) as mode from faulty where id is not null group by 1),
e as (select id, unnest(evidence) as e, generate_subscripts(evidence, 1) as at from q), f as (select distinct filename from document_info where filename is not null),
v as (select e.id, e.at, bool_or(contains({_squeezed_sql('c.text')}, {_squeezed_sql('e.e.text')})) as there from e join f on f.filename = e.e.doc join chunks c on c.doc = e.e.doc group by 1, 2)
select id, 'unknown document' as problem, count(*) as n from e where e.doc is not null and e.doc not in (select filename from f) group by 1 union all select id, 'no evidence', 1 from q where len(evidence) = 0 and type <> 'unanswerable' union all select id, 'bad mode', 1 from q where mode not in ('all', 'any')
 union all select id, 'two versions', n from d where n > 1 union all select id, 'not verbatim', count(*) from v where not there group by 1""")
def dataset_problems(spark, root):
    """What is wrong with a set of questions, over the items and copies of them with each kind of fault put in."""
    rows = _items(spark, root).select("id", "question", "type", "evidence", "evidence_mode")
    changed = lambda doc, text: F.transform("evidence", lambda e: F.struct(doc(e["doc"]).alias("doc"), text(e["text"]).alias("text")))
    same = lambda x: x
    named = lambda end: F.concat("id", F.lit(end)).alias("id")
    faulty = rows.unionByName(rows.where("type = 'unanswerable'").withColumn("question", F.concat("question", F.lit("?"))))
    faulty = faulty.unionByName(rows.withColumn("id", named("-mode")).withColumn("evidence_mode", F.lit("some")))
    faulty = faulty.unionByName(rows.withColumn("id", named("-lost")).withColumn("evidence", changed(lambda d: F.concat(F.lit("lost/"), d), same)))
    faulty = faulty.unionByName(rows.withColumn("id", named("-text")).withColumn("evidence", changed(same, lambda t: F.concat(F.lit("Not so: "), t))))
    faulty = faulty.unionByName(rows.withColumn("id", named("-none")).withColumn("type", F.lit("factual")).withColumn("evidence", F.slice("evidence", 1, 0)))
    names = _registry(spark, root).select(F.col("filename").alias("doc")).where("doc is not null").distinct()
    return evaluation.dataset_problems(faulty, names, _chunks(spark, root))


@query("select mode, " + ", ".join(f"count(*) filter (where scorer = '{s}') as \"{s}\"" for s in ("dense", "keyword", "mmr")) + " from retrieval_results where mode is not null group by 1")
def scorer_grid(spark, root):
    counts = [F.count(F.when(F.col("scorer") == name, 1)).alias(name) for name in ("dense", "keyword", "mmr")]
    return _results(spark, root).where("mode is not null").groupBy("mode").agg(*counts)


@query("select doc_id, count(distinct chunk_id) as chunks, md5(string_agg(text, chr(10) order by chunk_id)) as text_md5 from (select doc_id, chunk_id, min(text) as text from citations where doc_id is not null and chunk_id is not null group by 1, 2) where text is not null group by 1")
def document_details(spark, root):
    """A document with its stored chunks in order."""
    rows = _citations(spark, root).where("doc_id is not null and chunk_id is not null").groupBy("doc_id", "chunk_id").agg(F.min("text").alias("text")).where("text is not null")
    return rows.groupBy("doc_id").agg(F.countDistinct("chunk_id").alias("chunks"), F.md5(answers.in_order("chunk_id", "text", "\n")).alias("text_md5"))
