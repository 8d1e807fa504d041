"""All queries of the core, by name, with their SQL for DuckDB where SQL expresses them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import answers, chunking, evaluation, lexical, library, ranking, vectors
from docloom.plans import retrieval
from docloom.session import cut_lineage, read_table
from docloom.sources import files

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# ---------------------------------------------------------------- SQL pieces


def _list(words) -> str:
    return "[" + ",".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _tok(x: str) -> str:
    stem = "case when length(t) > 4 and t like '%ies' then t[:length(t)-3] || 'y' when length(t) > 3 and t like '%s' and not regexp_matches(t, '(?:ss|us|is)$') then t[:length(t)-1] else t end"
    return f"list_transform(list_filter(regexp_extract_all(lower(coalesce({x},'')), '[a-z0-9]+(?:[.''][a-z0-9]+)*'), lambda t: not list_contains({_list(T.STOP_WORDS)}, t) and (length(t) > 1 or regexp_full_match(t, '[0-9]'))), lambda t: {stem})"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _squeeze(x: str) -> str:
    return "lower(" + _strip(rf"regexp_replace({x}, '\s+', ' ', 'g')") + ")"


def _sentences(x: str) -> str:
    marked = rf"regexp_replace(regexp_replace(coalesce({x},''), '\s*\n\s*', chr(1), 'g'), '([.!?;:])[ \t]+([\"''(\[A-Z0-9])', '\1' || chr(1) || '\2', 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: {_strip('s')}), lambda s: s <> '')"


def _spans(x: str) -> str:
    marked = rf"regexp_replace(regexp_replace(coalesce({x},''), '\n\s*\n', chr(2), 'g'), '([.!?])\s+([A-Z0-9\"''(\[`*])', '\1' || chr(2) || '\2', 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(2)), lambda s: {_strip('s')}), lambda s: s <> '')"


def _content(x: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower(coalesce({x},'')), '[a-z0-9_]+'), lambda w: not list_contains({_list(T.JUDGE_STOP_WORDS)}, w) and (length(w) > 2 or regexp_full_match(w, '[0-9]+'))))"


def _not_found(x: str) -> str:
    head = "replace(lower(" + _strip(f"coalesce({x},'')") + ")[1:300], '’', '''')"
    return "(" + " or ".join(f"contains({head}, '{m.replace(chr(39), chr(39) * 2)}')" for m in T.NOT_FOUND_MARKS) + ")"


def _trigrams(x: str) -> str:
    words = rf"regexp_extract_all(lower(coalesce({x},'')), '[\p{{L}}\p{{N}}_]+')"
    return f"(case when len({words}) >= 3 then list_distinct(list_transform(range(1, len({words}) - 1), lambda i: {words}[i] || ' ' || {words}[i+1] || ' ' || {words}[i+2])) else [] end)"


_QUESTIONS = "questions as (select query_id, min(question) as question, min(style) as style from chat_responses where query_id is not null and question is not null group by 1)"
_LISTS = "lists as (select query_id, scorer, c.chunk_id as chunk_id, max(c.score) as score from (select query_id, scorer, unnest(chunks) as c from retrieval_results) where c.score is not null and c.chunk_id is not null group by all), ranked as (select *, row_number() over (partition by query_id, scorer order by score desc, chunk_id) as rank from lists)"
_PASSAGES = "passages as (select query_id, chunk_id, min(doc_id) as doc_id, min(filename) as filename, min(page) as page, min(page_end) as page_end, min(section) as section, min(text) as text, min(number) as number, max(score) as score from citations where query_id is not null and chunk_id is not null group by 1, 2), cited as (select *, row_number() over (partition by query_id order by number, chunk_id) as rank from passages)"
_POSTINGS = f"toks as (select doc_id, {_tok('text')} as t from documents), posts as (select doc_id, len(t) as dl, unnest(t) as term from toks), tfs as (select term, doc_id, dl, count(*) as tf from posts group by all), stats as (select count(*) as n, avg(len(t)) as avg_dl from toks)"


def _table(name: str):
    return lambda spark, root: read_table(spark, root, name)


_documents, _chat, _results, _citations, _items, _registry, _sources = (_table(n) for n in ("documents", "chat_responses", "retrieval_results", "citations", "qa_items", "document_info", "source_details"))


def _questions(spark, root):
    return _chat(spark, root).where("query_id is not null and question is not null").groupBy("query_id").agg(F.min("question").alias("question"), F.min("style").alias("style"))


def _passages(spark, root):
    rows = _citations(spark, root).where("query_id is not null and chunk_id is not null").groupBy("query_id", "chunk_id").agg(*(F.min(c).alias(c) for c in ("doc_id", "filename", "page", "page_end", "section", "text", "number")), F.max("score").alias("score"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("number", "chunk_id")))


def _texts(spark, root):
    return _sources(spark, root).where("raw_text is not null").groupBy("doc_id").agg(F.min("raw_text").alias("text"))


_TEXTS = "texts as (select doc_id, min(raw_text) as text from source_details where raw_text is not null group by 1)"


# ---------------------------------------------------------------- sources and the library


@query(f"""select distinct doc_id, coalesce(lower(regexp_extract(filename, '[^./\\\\]\\.([A-Za-z0-9]+)$', 1)), '') as ext,
  coalesce(map_extract(MAP {{{', '.join(f"'{k}': '{v}'" for k, v in T.PARSERS.items())}}}, lower(regexp_extract(filename, '[^./\\\\]\\.([A-Za-z0-9]+)$', 1)))[1], 'txt') as parser,
  lower(regexp_extract(filename, '[^./\\\\]\\.([A-Za-z0-9]+)$', 1)) in ({', '.join(f"'{k}'" for k in T.PARSERS)}) as supported from document_info where filename is not null""")
def file_dispatch(spark, root):
    return _registry(spark, root).where("filename is not null").select("doc_id", T.extension(F.col("filename")).alias("ext"), T.file_type(F.col("filename")).alias("parser"), T.is_supported(F.col("filename")).alias("supported")).distinct()


@query("select string_agg(e, ', ' order by e) as label from (select distinct upper(unnest([" + ",".join(f"'{k}'" for k in T.PARSERS) + "])) as e)")
def format_label(spark, root):
    return spark.range(1).select(F.array_join(F.array_sort(F.array(*(F.lit(k.upper()) for k in T.PARSERS))), ", ").alias("label"))


@query("select doc_id, substr(sha256(text), 1, 16) as content_id, length(text)::int as chars, strlen(text)::bigint as size_bytes from documents where text is not null")
def content_ids(spark, root):
    return _documents(spark, root).where("text is not null").select("doc_id", T.content_id(F.col("text")).alias("content_id"), F.length("text").alias("chars"), F.octet_length("text").cast("bigint").alias("size_bytes"))


@query("""with u as (select doc_id, text, source, sha256(coalesce(text,'')) as h from documents)
, d as (select u.*, d.filename, u.text is null or not regexp_matches(u.text, '\\S') as blank from u join documents d using (doc_id)), f as (select h, min(doc_id) as first from d where not blank group by 1),
n as (select filename, min(doc_id) as named from d join f using (h) where not blank and doc_id = first and filename is not null group by 1)
select doc_id, case when blank then 'error' when doc_id > first then 'duplicate' when doc_id > named then 'replaced' else 'indexed' end as status from d left join f on f.h = d.h and not blank left join n on n.filename = d.filename""")
def upload_statuses(spark, root):
    docs = _documents(spark, root).withColumn("h", F.sha2(F.coalesce("text", F.lit("")), 256))
    return library.upload_status(docs, "h", "filename", "doc_id", "text").select("doc_id", "status")


@query("select doc_id, arg_max(filename, ingested_at) as filename, arg_max(file_type, ingested_at) as file_type, max(ingested_at) as ingested_at from document_info where doc_id is not null group by 1")
def latest_registry(spark, root):
    rows = _registry(spark, root).where("doc_id is not null").select("doc_id", "filename", "file_type", "ingested_at")
    return library.latest_by(rows.withColumn("at", F.col("ingested_at")), ["doc_id"], [F.col("at")]).select("doc_id", "filename", "file_type", "ingested_at")


@query(f"""select doc_id, min(filename) as filename, coalesce(map_extract(MAP {{{', '.join(f"'{k}': '{v}'" for k, v in T.PARSERS.items())}}}, lower(regexp_extract(min(filename), '[^./\\\\]\\.([A-Za-z0-9]+)$', 1)))[1], 'txt') as file_type,
 count(distinct chunk_id) as chunk_count, max(coalesce(page_end, page, 1)) as page_count from citations group by 1""")
def registry_from_chunks(spark, root):
    return library.registry_from_chunks(_citations(spark, root))


@query("select doc_id, filename, ingested_at, row_number() over (order by ingested_at desc, doc_id)::int as place from (select doc_id, arg_max(filename, ingested_at) as filename, max(ingested_at) as ingested_at from document_info where doc_id is not null group by 1)")
def newest_documents(spark, root):
    """The library's documents, newest first; places are counted over ranges of time, so no task holds them all."""
    rows = _registry(spark, root).where("doc_id is not null").groupBy("doc_id").agg(F.max_by("filename", "ingested_at").alias("filename"), F.max("ingested_at").alias("ingested_at"))
    return library.placed(rows, [F.desc("ingested_at"), F.asc("doc_id")])


@query("select count(distinct doc_id) as documents, sum(chunk_count)::bigint as chunks, sum(size_bytes)::bigint as bytes from (select doc_id, max(chunk_count) as chunk_count, max(size_bytes) as size_bytes from document_info group by 1)")
def library_totals(spark, root):
    one = _registry(spark, root).groupBy("doc_id").agg(F.max("chunk_count").alias("chunk_count"), F.max("size_bytes").alias("size_bytes"))
    return one.agg(F.countDistinct("doc_id").alias("documents"), F.sum("chunk_count").alias("chunks"), F.sum("size_bytes").alias("bytes"))


@query("select distinct chunk_id, doc_id from citations where doc_id is not null and doc_id not in (select doc_id from source_details where doc_id is not null)")
def chunks_without_source(spark, root):
    """Chunks left once the documents of the source viewer are deleted (anti-join)."""
    gone = _sources(spark, root).select("doc_id").distinct()
    return _citations(spark, root).where("doc_id is not null").select("chunk_id", "doc_id").distinct().join(gone, "doc_id", "left_anti").select("chunk_id", "doc_id")


@query("""with l as (select distinct c.chunk_id as chunk_id from (select unnest(chunks) as c from retrieval_results)), t as (select distinct chunk_id from citations)
select (select count(*) from l where chunk_id is not null) as scored, (select count(*) from t where chunk_id is not null) as stored, (select count(*) from l where chunk_id is not null and chunk_id not in (select chunk_id from t where chunk_id is not null)) as missing""")
def index_sync(spark, root):
    """Whether scored chunks all have stored passages: the check made when an index is loaded."""
    scored = _results(spark, root).select(F.explode("chunks").alias("c")).select(F.col("c.chunk_id").alias("chunk_id")).where("chunk_id is not null").distinct()
    stored = _citations(spark, root).select("chunk_id").where("chunk_id is not null").distinct().withColumn("here", F.lit(1))
    both = scored.join(stored, "chunk_id", "full").select(F.when(F.col("here").isNull(), 1).otherwise(0).alias("missing"), "here", "chunk_id")
    counted = both.agg(F.sum("missing").cast("bigint").alias("missing"), F.count("here").alias("stored"))
    return scored.agg(F.count("*").alias("scored")).join(counted).select("scored", "stored", F.coalesce("missing", F.lit(0).cast("bigint")).alias("missing"))


@query("select event_id, concat_ws('; ', 'event_id: ' || event_id::varchar, 'user_id: ' || user_id::varchar, 'event_type: ' || event_type, 'props: ' || props) as row_text from events")
def rows_as_text(spark, root):
    return files.rows_as_text(read_table(spark, root, "events").select("event_id", "user_id", "event_type", "props")).select("event_id", "row_text")


# ---------------------------------------------------------------- text


_DIRTY = "'Page 3 of 9' || chr(13) || chr(10) || coalesce(text,'') || chr(10) || '- 4 -' || chr(10) || chr(10) || chr(10) || chr(10) || 'Contents ........ 7  x' || chr(160) || 'y' || chr(8203)"


def _clean_sql(x: str) -> str:
    out = rf"regexp_replace({x}, '\r\n?', chr(10), 'g')"
    out = f"replace(replace({out}, chr(160), ' '), chr(173), '')"
    out = f"regexp_replace({out}, '[\\x{{200B}}-\\x{{200D}}\\x{{2060}}\\x{{FEFF}}]', '', 'g')"
    out = rf"regexp_replace({out}, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{{9f}}]', '', 'g')"
    out = rf"regexp_replace({out}, '(?im)^\s*(?:[-=_]{{2,}}\s*)?(?:page\s+\d+(?:\s+of\s+\d+)?|\d+\s+of\s+\d+|-\s*\d+\s*-)(?:\s*[-=_]{{2,}})?\s*$', '', 'g')"
    out = rf"regexp_replace({out}, '(?:\.\s*){{5,}}', '... ', 'g')"
    out = rf"regexp_replace(regexp_replace({out}, '[ \t]{{2,}}', ' ', 'g'), '[ \t]+\n', chr(10), 'g')"
    return _strip(rf"regexp_replace({out}, '\n{{3,}}', chr(10) || chr(10), 'g')")


@query(f"select doc_id, md5({_clean_sql(_DIRTY)}) as clean_md5, length({_clean_sql(_DIRTY)})::int as chars from documents")
def cleaned_documents(spark, root):
    """Cleaning rules over every document, dirtied so that each rule fires."""
    dirty = F.concat(F.lit("Page 3 of 9\r\n"), F.coalesce("text", F.lit("")), F.lit("\n- 4 -\n\n\n\nContents ........ 7  x y​"))
    return _documents(spark, root).select("doc_id", T.clean(dirty).alias("c")).select("doc_id", F.md5("c").alias("clean_md5"), F.length("c").alias("chars"))


@query(rf"with {_TEXTS} select doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '([a-z])-\n([a-z])', '\1\2', 'g'), '([A-Za-z0-9,''\")])[ \t]*\n([a-z(])', '\1 \2', 'g'), 'zzzz', '', 'g')) as joined_md5 from texts")
def joined_lines(spark, root):
    return _texts(spark, root).select("doc_id", F.md5(T.join_wrapped_lines(F.col("text"))).alias("joined_md5"))


@query(f"select id, min({_squeeze('question')}) as squeezed from qa_items group by 1")
def squeezed_questions(spark, root):
    return _items(spark, root).groupBy("id").agg(F.min(T.squeeze(F.col("question"))).alias("squeezed"))


@query(f"select doc_id, len({_tok('text')})::int as n_tokens, len(list_distinct({_tok('text')}))::int as n_terms, md5(array_to_string({_tok('text')}, ' ')) as tokens_md5 from documents")
def search_tokens(spark, root):
    t = _documents(spark, root).select("doc_id", T.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_terms"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


@query(f"select doc_id, len({_sentences('text')})::int as n, md5(array_to_string({_sentences('text')}, '|')) as m from documents")
def split_sentences(spark, root):
    t = _documents(spark, root).select("doc_id", T.sentences(F.col("text")).alias("s"))
    return t.select("doc_id", F.size("s").alias("n"), F.md5(F.array_join("s", "|")).alias("m"))


@query(f"select doc_id, len({_spans('text')})::int as n, md5(array_to_string({_spans('text')}, '|')) as m from documents")
def sentence_spans(spark, root):
    t = _documents(spark, root).select("doc_id", T.sentence_spans(F.col("text")).alias("s"))
    return t.select("doc_id", F.size("s").alias("n"), F.md5(F.array_join("s", "|")).alias("m"))


_HEAD_SQL = rf"case when regexp_matches({_strip('line')}, '^#{{1,6}}\s+\S') then length(regexp_extract({_strip('line')}, '^(#{{1,6}})\s+\S', 1)) when length({_strip('line')}) between 3 and 80 and upper({_strip('line')}) = {_strip('line')} and lower({_strip('line')}) <> {_strip('line')} and len(regexp_split_to_array({_strip('line')}, '\s+')) <= 10 and regexp_matches({_strip('line')}, '[A-Z]{{3}}') and not regexp_matches({_strip('line')}, '[.,;]$') then 2 end"


@query(f"with l as (select doc_id, unnest(string_split(text, chr(10))) as line from documents where text is not null) select doc_id, count(lvl) as headings, coalesce(sum(lvl),0)::bigint as levels from (select doc_id, {_HEAD_SQL} as lvl from l) group by 1")
def detected_headings(spark, root):
    lines = _documents(spark, root).where("text is not null").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", T.heading_level(F.col("line")).alias("lvl"))
    return lines.groupBy("doc_id").agg(F.count("lvl").alias("headings"), F.coalesce(F.sum("lvl"), F.lit(0)).cast("bigint").alias("levels"))


@query(f"""with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents where text is not null),
h as (select doc_id, pos, {_HEAD_SQL} as lvl from l), s as (select doc_id, count(lvl) over (partition by doc_id order by pos) as section from h)
select doc_id, section::bigint as section, count(*) as lines from s group by 1, 2""")
def nearest_heading_lines(spark, root):
    """Lines under their nearest preceding heading: an as-of join as a running count."""
    lines = _documents(spark, root).where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    marked = lines.withColumn("lvl", T.heading_level(F.col("line"))).withColumn("section", F.count("lvl").over(Window.partitionBy("doc_id").orderBy("at")))
    return marked.groupBy("doc_id", "section").agg(F.count("*").alias("lines"))


@query(f"with {_PASSAGES} select chunk_id, md5(concat_ws(' | ', min(filename), case when min(section) <> 'General' then min(section) end) || chr(10) || min(text)) as m from cited where text is not null group by 1")
def chunk_search_texts(spark, root):
    rows = _passages(spark, root).where("text is not null").groupBy("chunk_id").agg(F.min("filename").alias("f"), F.min("section").alias("s"), F.min("text").alias("t"))
    return rows.select("chunk_id", F.md5(T.search_text(F.col("f"), F.col("s"), F.col("t"))).alias("m"))


def _chunked(strategy: str, size: int, overlap: int):
    def run(spark, root):
        return chunking.chunk(_documents(spark, root).select("doc_id", "text"), strategy, size, overlap)

    run.__name__ = f"chunks_{strategy}"
    return run


#: White space as Python has it, for classes in SQL.
_BLANKS = r"\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _bare(x: str) -> str:
    return f"regexp_replace({x}, '^[{_BLANKS}]+|[{_BLANKS}]+$', '', 'g')"


def _nearest_title(start: str) -> str:
    """The last marked heading that begins at or before a place (from 0)."""
    head = r"^(#{1,6})[ \t]+(\S[^\n]*)$"
    shown = f"list_filter(string_split(text[1 : {start} + 1] || case when position(chr(10) in text[{start} + 2 :]) > 0 then text[{start} + 2 : {start} + 1 + position(chr(10) in text[{start} + 2 :])] else text[{start} + 2 :] end, chr(10)), lambda l: regexp_matches(l, '{head}'))"
    return f"coalesce(regexp_replace(regexp_replace(list_last({shown}), '^#+[ \t]+', ''), '[ \t]*#*[ \t]*$', ''), 'General')"


_FIXED_SQL = f"""with recursive d as (select doc_id, text, length(text) as n from documents where text is not null and {_bare('text')} <> ''),
w as (select doc_id, text, n, 0::bigint as start, {{stop0}} as stop from d union all select doc_id, text, n, next as start, {{stop}} as stop from (select *, case when k < stop - f + 1 then least(f + k, stop) else stop end as next from (select *, length(regexp_extract(text[f : stop], '^[^{_BLANKS}]*')) as k from (select *, greatest(stop - 200, start + 1) as f from w where stop < n)))),
b as (select doc_id, start, {_bare('text[start + 1 : stop]')} as body, {_nearest_title('start')} as section from w)
select doc_id::varchar as doc_id, doc_id || '_c' || (row_number() over (partition by doc_id order by start) - 1) as chunk_id, (row_number() over (partition by doc_id order by start) - 1)::int as chunk_index, 1 as page, 1 as page_end, section, body as text, length(body)::int as char_count from b where body <> ''"""


def _stop(start: str) -> str:
    seg = f"text[{start} + 501 : least(n, {start} + 1200)]"
    k = f"length(regexp_extract(reverse({seg}), '^[^ \\n]*'))".replace("\\\\n", "\\n")
    return f"(case when {start} + 1200 < n and {k} < length({seg}) then {start} + 1199 - {k} else least(n, {start} + 1200) end)"


_FIXED_SQL = _FIXED_SQL.replace("{stop0}", _stop("0")).replace("{stop}", _stop("next"))
_PACKED_SQL = f"""with recursive d as (select doc_id, text, {_spans('text').replace(chr(92) + 's', '[' + _BLANKS + ']')} as s from documents where text is not null and {_bare('text')} <> ''),
l as (select doc_id, text, s, len(s) as n, list_transform(s, lambda x: length(x)) as sizes, list_transform(range(0, len(s) + 1), lambda i: coalesce(list_sum(list_transform(s[1 : i], lambda x: length(x) + 1)), 0)) as upto from d where len(s) > 0),
w as (select l.*, 0::bigint as first, 0::bigint as last, coalesce(list_filter(range(1, n), lambda i: upto[i + 1] + sizes[i + 1] > 1200)[1], n) as stop from l
 union all select doc_id, text, s, n, sizes, upto, next as first, stop as last, coalesce(list_filter(range(stop + 1, n), lambda i: upto[i + 1] - upto[next + 1] + sizes[i + 1] > 1200)[1], n) as stop from (select *, greatest(first, list_filter(range(0, n + 1), lambda j: upto[j + 1] >= upto[stop + 1] - 201)[1]) as next from w where stop < n))
select doc_id::varchar as doc_id, doc_id || '_c' || (row_number() over (partition by doc_id order by stop) - 1) as chunk_id, (row_number() over (partition by doc_id order by stop) - 1)::int as chunk_index, 1 as page, 1 as page_end, 'General' as section, array_to_string(s[first + 1 : stop], ' ') as text, length(array_to_string(s[first + 1 : stop], ' '))::int as char_count from w"""

for _strategy in chunking.STRATEGIES:
    query({"fixed": _FIXED_SQL, "sentence": _PACKED_SQL}.get(_strategy))(_chunked(_strategy, 1200, 200))


def _stored_chunks(spark, root):
    """The library's chunks: each cited passage once."""
    rows = _citations(spark, root).where("chunk_id is not null and text is not null")
    return rows.groupBy("chunk_id").agg(*(F.min(c).alias(c) for c in ("doc_id", "filename", "section", "page", "page_end", "text")))


_STORED = "stored as (select chunk_id, min(doc_id) as doc_id, min(filename) as filename, min(section) as section, min(page) as page, min(page_end) as page_end, min(text) as text from citations where chunk_id is not null and text is not null group by 1)"


@query(f"with {_STORED}, t as (select case when length(text) = 0 then 0 else (length(text) + 3) // 4 end as t from stored) select count(*) as n, round(avg(t), 6) as mean, quantile_cont(t, 0.95)::double as p95, max(t)::int as most, sum(t)::bigint as total, round(avg(case when t > 256 then 1.0 else 0 end), 6)::double as truncated from t")
def chunk_sizes(spark, root):
    """Size statistics of the stored chunks in estimated tokens, and the share an embedder of 256 tokens would cut off."""
    tokens = _stored_chunks(spark, root).select(T.estimated_tokens(F.col("text")).alias("t"))
    cut = F.round(F.avg(F.when(F.col("t") > 256, 1.0).otherwise(0.0)), 6).alias("truncated")
    return tokens.agg(F.count("*").alias("n"), F.round(F.avg("t"), 6).alias("mean"), F.percentile("t", 0.95).alias("p95"), F.max("t").alias("most"), F.sum("t").alias("total"), cut)


# ---------------------------------------------------------------- keyword and vector search


@query(f"with {_POSTINGS}, dfs as (select term, count(*) as df from tfs group by 1) select term, df, round(ln(1 + ((select count(*) from documents) - df + 0.5) / (df + 0.5)), 9) as idf from dfs")
def term_statistics(spark, root):
    return lexical.term_statistics(_documents(spark, root), "doc_id", "text").select("term", "df", F.round("idf", 9).alias("idf"))


@query(f"""with {_POSTINGS}, {_QUESTIONS}, asked as (select distinct query_id, unnest({_tok('question')}) as term from questions), dfs as (select term, count(*) as df from tfs group by 1),
parts as (select term, doc_id, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg_dl)) as part from tfs join dfs using (term), stats),
scored as (select query_id, doc_id, round(sum(part), 6) as score from asked join parts using (term) group by 1, 2)
select query_id, doc_id, score, rank::int as rank from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from scored where score > 0) where rank <= 10""")
def bm25_search(spark, root):
    return lexical.bm25(_documents(spark, root), "doc_id", "text", _questions(spark, root), "query_id", "question", 10)


@query(f"""with c as (select query_id, question, answer from chat_responses where query_id is not null), t as (select distinct query_id, list_distinct({_tok('question')}) as q, {_tok('answer')} as a from c)
select query_id, round(max(case when len(q) > 0 then len(list_intersect(q, a))::double / len(q) else 0 end), 9) as coverage from t group by 1""")
def term_coverage(spark, root):
    rows = _chat(spark, root).where("query_id is not null").select("query_id", T.coverage(T.tokens(F.col("question")), T.tokens(F.col("answer"))).alias("c"))
    return rows.groupBy("query_id").agg(F.round(F.max("c"), 9).alias("coverage"))


_UNIT = "list_transform(embedding::double[], lambda x: x / case when sqrt(list_dot_product(embedding::double[], embedding::double[])) > 0 then sqrt(list_dot_product(embedding::double[], embedding::double[])) else 1 end)"


@query(f"select vec_id, round(list_sum(list_transform({_UNIT}, lambda x: x * x)), 6) as size, round(({_UNIT})[1], 6) as first from embeddings")
def unit_vectors(spark, root):
    v = read_table(spark, root, "embeddings").select("vec_id", vectors.normalised(F.col("embedding")).alias("v"))
    return v.select("vec_id", F.round(vectors.dot(F.col("v"), F.col("v")), 6).alias("size"), F.round(F.element_at("v", 1), 6).alias("first"))


@query(f"""with v as (select vec_id, {_UNIT} as u from embeddings), s as (select q.vec_id as query_id, v.vec_id as vec_id, round(list_dot_product(q.u, v.u), 6) as score from v q, v where q.vec_id % 100 = 0)
select query_id, vec_id, score, rank::int as rank from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 10""")
def cosine_search(spark, root):
    """Exact nearest vectors of every vector whose id is divisible by 100, against all."""
    v = read_table(spark, root, "embeddings")
    asked = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v"))
    return vectors.top_k(v.withColumnRenamed("embedding", "v"), "vec_id", "v", asked, 10)


@query("""with w as (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as w from documents where text is not null)
select doc_id, (('0x' || right(md5(w), 2))::int % 64)::int as slot, count(*) as n from w group by 1, 2""")
def hashed_embeddings(spark, root):
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)))
    rows = _documents(spark, root).where("text is not null").select("doc_id", words.alias("w"))
    return rows.groupBy("doc_id", vectors.hash_slot(F.col("w")).alias("slot")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- fusion and reranking


@query(f"""with {_LISTS}, f as (select query_id, chunk_id, round(sum(1.0::double / (60 + rank)), 9) as rrf, min((scorer, rank)) as first from ranked group by 1, 2)
select query_id, chunk_id, rrf, rank::int as rank from (select *, row_number() over (partition by query_id order by rrf desc, first, chunk_id) as rank from f) where rank <= 25""")
def rank_fusion(spark, root):
    return ranking.reciprocal_rank_fusion(ranking.rank_lists(_results(spark, root)), "query_id", "chunk_id", "scorer", 25)


def _pairs(spark, root):
    """Cited passages with their questions; each question is tokenised once, not once a passage."""
    asked = _questions(spark, root).select("query_id", "question").withColumn("q_terms", F.array_distinct(T.tokens(F.col("question"))))
    return _passages(spark, root).drop("score").join(asked, "query_id")


_KEYWORD = f"kw as (select c.*, round(least(case when len(q) > 0 then len(list_intersect(q, t))::double / len(q) else 0 end + 0.02 / rank, 1.0) + 1e-9, 4) as kscore from (select cited.*, list_distinct({_tok('question')}) as q, {_tok('coalesce(text,' + chr(39) * 2 + ') || ' + chr(39) + ' ' + chr(39) + ' || coalesce(section,' + chr(39) * 2 + ')')} as t from cited join questions using (query_id)) c)"


@query(f"with {_QUESTIONS}, {_PASSAGES}, {_KEYWORD} select query_id, chunk_id, kscore as score, row_number() over (partition by query_id order by kscore desc, rank)::int as new_rank from kw")
def rerank_keyword(spark, root):
    rows = _pairs(spark, root)
    return ranking.keyword_scores(rows, "question", "text", "section").select("query_id", "chunk_id", "score", "new_rank")


@query(f"""with {_QUESTIONS}, {_PASSAGES} select query_id, chunk_id, round(case when len(q) > 0 then len(list_intersect(q, t))::double / len(q) else 0 end, 4) as score from (select query_id, chunk_id, list_distinct({_tok('question')}) as q, {_tok('text')} as t from cited join questions using (query_id))""")
def rerank_none(spark, root):
    return _pairs(spark, root).select("query_id", "chunk_id", F.round(T.coverage(F.col("q_terms"), T.tokens(F.col("text"))), 4).alias("score"))


@query()
def rerank_mmr(spark, root):
    """Diverse order of the ten nearest vectors of every hundredth vector."""
    v = read_table(spark, root, "embeddings").select("vec_id", vectors.normalised(F.col("embedding")).alias("v"))
    near = cosine_search(spark, root).select("query_id", F.col("vec_id").alias("item_id"), "rank")
    rows = near.join(v.select(F.col("vec_id").alias("item_id"), F.col("v").alias("vector")), "item_id").join(v.select(F.col("vec_id").alias("query_id"), F.col("v").alias("query_vector")), "query_id")
    return ranking.mmr(rows)


def _slots(x: str) -> str:
    return f"list_transform(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda w: (('0x' || right(md5(w), 2))::int % 64)::int)"


@query(f"""with {_QUESTIONS}, {_PASSAGES}, {_KEYWORD}, qs as (select query_id, slot, count(*) as n from (select query_id, unnest({_slots('question')}) as slot from questions) group by all), qn as (select query_id, sqrt(sum(n * n)) as size from qs group by 1),
sent as (select chunk_id, pos, s from (select chunk_id, unnest({_spans('text')}) as s, generate_subscripts({_spans('text')}, 1) as pos from (select chunk_id, min(text) as text from cited group by 1)) where length(s) >= 20),
ss as (select chunk_id, pos, slot, count(*) as n from (select chunk_id, pos, unnest({_slots('s')}) as slot from sent) group by all), sn as (select chunk_id, pos, sqrt(sum(n * n)) as size from ss group by all),
p as (select kw.query_id, kw.chunk_id, sent.pos from kw join sent using (chunk_id)),
sim as (select p.query_id, p.chunk_id, p.pos, coalesce(sum(qs.n * ss.n) / max(qn.size * sn.size), 0) as sim from p left join ss on ss.chunk_id = p.chunk_id and ss.pos = p.pos left join qs on qs.query_id = p.query_id and qs.slot = ss.slot left join qn on qn.query_id = p.query_id left join sn on sn.chunk_id = p.chunk_id and sn.pos = p.pos group by all),
best as (select query_id, chunk_id, max(sim) as sim from sim group by all), anyof as (select distinct query_id from best)
select kw.query_id, kw.chunk_id, case when anyof.query_id is not null then round(greatest(coalesce(best.sim, 0), 0), 6) else kscore end as score from kw left join best using (query_id, chunk_id) left join anyof on anyof.query_id = kw.query_id""")
def rerank_sentences(spark, root):
    """Cited passages by the best cosine of their sentences (20 characters or more) to the question, hashed vectors; keyword scores where a query has no sentence."""
    rows = _pairs(spark, root)
    return ranking.sentence_scores(rows, "question", "text", "section").select("query_id", "chunk_id", "score")


@query(f"""with {_LISTS}, ce as (select query_id, chunk_id, rank, case when min(score) over w >= 0 and max(score) over w <= 1 then score else 1 / (1 + exp(-score)) end as p from ranked where scorer = 'cross-encoder' window w as (partition by query_id)),
f as (select *, count(*) filter (where p >= 0.02) over (partition by query_id) as above from ce)
select query_id, chunk_id, round(p, 6) as score, above = 0 as low_relevance from f where p >= 0.02 or (above = 0 and rank <= 3)""")
def relevance_threshold(spark, root):
    rows = ranking.rank_lists(_results(spark, root)).where("scorer = 'cross-encoder'").withColumn("score", ranking.calibrated(F.col("score"), "query_id"))
    return ranking.relevant(rows, "query_id").select("query_id", "chunk_id", F.round("score", 6).alias("score"), "low_relevance")


@query(f"with {_QUESTIONS}, {_PASSAGES} select query_id, chunk_id, rank::int as rank from cited join questions using (query_id) where rank <= case lower(style) when 'concise' then 4 when 'long' then 10 else 6 end")
def style_cut(spark, root):
    return _passages(spark, root).join(_questions(spark, root).select("query_id", "style"), "query_id").where(F.col("rank") <= ranking.style_k(F.col("style"))).select("query_id", "chunk_id", "rank")


@query("select query_id, case when bool_or(scorer = 'summary') then 'summary' when bool_or(scorer in ('dense','mmr')) and bool_or(scorer = 'keyword') then 'hybrid' when bool_or(scorer in ('dense','mmr')) then 'dense' else 'keyword' end as mode from retrieval_results where query_id is not null group by 1")
def search_modes(spark, root):
    has = lambda *names: F.coalesce(F.bool_or(F.col("scorer").isin(*names)), F.lit(False))
    mode = F.when(has("summary"), "summary").when(has("dense", "mmr") & has("keyword"), "hybrid").when(has("dense", "mmr"), "dense").otherwise("keyword")
    return _results(spark, root).where("query_id is not null").groupBy("query_id").agg(mode.alias("mode"))


@query(f"""with q as (select query_id, question from chat_responses where query_id is not null union all select -query_id, 'Give me a short overview of the whole ' || coalesce(filename, 'report') from citations where query_id is not null union all select query_id + 1000000000, 'Summarise this report please' from chat_responses where query_id is not null)
select query_id, bool_or(coalesce(regexp_matches(question, '(?i)\\b(summari[sz]e|summary|overview|tl;?dr|gist|main (?:points?|ideas?|takeaways?)|key (?:points?|takeaways?)|what(?:''s| is) (?:this|the|it) (?:\\w+ )?about)\\b')
 and len(list_filter({_tok("regexp_replace(question, '(?i)" + chr(92) + "b(summari[sz]e|summary|overview|tl;?dr|gist|main (?:points?|ideas?|takeaways?)|key (?:points?|takeaways?)|what(?:''s| is) (?:this|the|it) (?:" + chr(92) + "w+ )?about)" + chr(92) + "b', ' ', 'g')")}, lambda t: t not in ('report','paper','pdf','book','text','article','entire','whole','all','main','key','point','uploaded','content','contents','brief','short','quick','about','doc'))) = 0, false)) as summary from q group by 1""")
def summary_requests(spark, root):
    chat = _chat(spark, root).where("query_id is not null")
    rows = chat.select("query_id", "question").unionByName(_citations(spark, root).where("query_id is not null").select((-F.col("query_id")).alias("query_id"), F.concat(F.lit("Give me a short overview of the whole "), F.coalesce("filename", F.lit("report"))).alias("question")))
    rows = rows.unionByName(chat.select((F.col("query_id") + 1000000000).alias("query_id"), F.lit("Summarise this report please").alias("question")))
    return rows.groupBy("query_id").agg(F.bool_or(T.is_summary_request(F.col("question"))).alias("summary"))


@query("""with c as (select doc_id, chunk_id, length(min(text)) as n_chars from citations where doc_id is not null and text is not null group by 1, 2), o as (select *, row_number() over (partition by doc_id order by chunk_id) - 1 as ordinal from c),
d as (select doc_id, count(*) as cnt, avg(n_chars) as mean from o group by 1), s as (select doc_id, cnt, greatest(1, least(cnt, floor(floor(24000 / (select count(*) from d)) / greatest(mean, 1.0))))::int as n from d),
p as (select distinct doc_id, floor(i * cnt / n)::int as ordinal from (select *, unnest(range(0, n)) as i from s))
select o.doc_id, o.chunk_id from o join p on o.doc_id = p.doc_id and o.ordinal = p.ordinal""")
def summary_passages(spark, root):
    rows = _citations(spark, root).where("doc_id is not null and text is not null").groupBy("doc_id", "chunk_id").agg(F.length(F.min("text")).alias("n_chars"))
    return retrieval.spread_passages(retrieval.with_ordinals(rows, "doc_id", ["chunk_id"])).select("doc_id", "chunk_id")


@query("""with q as (select query_id, min(question) as question, min(standalone_question) as s from chat_responses where query_id is not null and question is not null group by 1)
select query_id, case when s is not null and lower(trim(s)) <> lower(trim(question)) and trim(s) <> '' then trim(question) || ' / ' || trim(s) else trim(question) end as queries from q""")
def rewritten_queries(spark, root):
    rows = _chat(spark, root).where("query_id is not null and question is not null").groupBy("query_id").agg(F.min("question").alias("question"), F.min("standalone_question").alias("s"))
    every = retrieval.deduplicated_queries(F.col("question"), F.when(F.col("s").isNotNull(), F.array("s")))
    return rows.select("query_id", F.array_join(every, " / ").alias("queries"))


_BM25 = f"""toks as (select chunk_id, {_tok("concat_ws(' | ', filename, case when section <> 'General' then section end) || chr(10) || text")} as t from stored), tfs as (select chunk_id, dl, term, count(*) as tf from (select chunk_id, len(t) as dl, unnest(t) as term from toks) group by all), stats as (select count(*) as n, avg(len(t)) as avg_dl from toks),
asked as (select distinct query_id, unnest({_tok('question')}) as term from questions), dfs as (select term, count(*) as df from tfs group by 1),
bm as (select query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg_dl))), 6) as score from asked join tfs using (term) join dfs using (term), stats group by 1, 2),
bmr as (select query_id, chunk_id, 'keyword' as list, row_number() over (partition by query_id order by score desc, chunk_id) as rank from bm where score > 0)"""
_DENSE = f"""qs as (select query_id, slot, count(*) as n from (select query_id, unnest({_slots('question')}) as slot from questions) group by all), qn as (select query_id, sqrt(sum(n * n)) as size from qs group by 1),
cs as (select chunk_id, slot, count(*) as n from (select chunk_id, unnest({_slots('text')}) as slot from stored) group by all), cn as (select chunk_id, sqrt(sum(n * n)) as size from cs group by 1),
dots as (select query_id, chunk_id, sum(qs.n * cs.n) as dot from qs join cs using (slot) group by all),
dn as (select q.query_id, c.chunk_id, round(coalesce(dot / (qn.size * cn.size), 0), 6) as score from questions q cross join stored c left join dots on dots.query_id = q.query_id and dots.chunk_id = c.chunk_id left join qn on qn.query_id = q.query_id left join cn on cn.chunk_id = c.chunk_id),
dr as (select query_id, chunk_id, 'dense' as list, row_number() over (partition by query_id order by score desc, chunk_id) as rank from dn)"""
_FUSED = "fused as (select query_id, chunk_id, row_number() over (partition by query_id order by rrf desc, first, chunk_id) as rank from (select query_id, chunk_id, round(sum(1.0::double / (60 + rank)), 9) as rrf, min((list, rank)) as first from lists where rank <= 25 group by all))"
_FINAL = f"""cand as (select f.query_id, f.chunk_id, f.rank, q.question, q.style, s.text, s.section, list_distinct({_tok('q.question')}) as q, {_tok("s.text || ' ' || coalesce(s.section, '')")} as t from fused f join stored s using (chunk_id) join questions q using (query_id) where f.rank <= 25),
scored as (select *, round(least(case when len(q) > 0 then len(list_intersect(q, t))::double / len(q) else 0 end + 0.02 / rank, 1.0) + 1e-9, 4) as score from cand), final as (select *, row_number() over (partition by query_id order by score desc, rank) as place from scored)"""
_KEPT = "place <= case lower(style) when 'concise' then 4 when 'long' then 10 else 6 end"


def _library(spark, root):
    """The stored chunks as retrieval reads them: a table, not an aggregate made again for each of its readers."""
    return cut_lineage(_stored_chunks(spark, root))


def _library_search(config: retrieval.RetrievalConfig):
    def run(spark, root):
        found = retrieval.retrieve(_library(spark, root), _questions(spark, root), config)
        return found.select("query_id", "chunk_id", "score", "rank", "mode", "scorer", "low_relevance")

    return run


@query(f"with {_QUESTIONS}, {_STORED}, {_BM25}, lists as (select * from bmr), {_FUSED}, {_FINAL} select query_id, chunk_id, score, place::int as rank, 'keyword' as mode, 'keyword' as scorer, false as low_relevance from final where {_KEPT}")
def keyword_passages(spark, root):
    """Passages of every question by keyword search alone, reranked by coverage."""
    return _library_search(retrieval.RetrievalConfig(use_dense=False, summaries=False))(spark, root)


@query(f"with {_QUESTIONS}, {_STORED}, {_DENSE}, lists as (select * from dr), {_FUSED}, {_FINAL} select query_id, chunk_id, score, place::int as rank, 'dense' as mode, 'keyword' as scorer, false as low_relevance from final where {_KEPT}")
def dense_passages(spark, root):
    """Passages of every question by vector search alone."""
    return _library_search(retrieval.RetrievalConfig(use_bm25=False, summaries=False))(spark, root)


@query(f"with {_QUESTIONS}, {_STORED}, {_BM25}, {_DENSE}, lists as (select * from bmr union all select * from dr), {_FUSED}, {_FINAL} select query_id, chunk_id, score, place::int as rank, 'hybrid' as mode, 'keyword' as scorer, false as low_relevance from final where {_KEPT}")
def hybrid_passages(spark, root):
    """Passages of every question by both searches, fused."""
    return _library_search(retrieval.RetrievalConfig(summaries=False))(spark, root)


@query(f"with {_QUESTIONS}, {_STORED}, {_BM25}, {_DENSE}, lists as (select * from bmr union all select * from dr), {_FUSED}, {_FINAL} select query_id, chunk_id, round(case when len(q) > 0 then len(list_intersect(q, {_tok('text')}))::double / len(q) else 0 end, 4) as score, rank::int as rank, 'hybrid' as mode, 'none' as scorer, false as low_relevance from final where {_KEPT.replace('place', 'rank')}")
def hybrid_in_fused_order(spark, root):
    """The same without reranking."""
    return _library_search(retrieval.RetrievalConfig(rerank="none", summaries=False))(spark, root)


@query()
def hybrid_diverse(spark, root):
    """The same, reranked for diversity."""
    return _library_search(retrieval.RetrievalConfig(rerank="mmr", summaries=False))(spark, root)


@query(f"with {_QUESTIONS}, {_STORED}, {_BM25}, lists as (select * from bmr), {_FUSED}, {_FINAL} select query_id, chunk_id, score, place::int as rank, 'keyword' as mode, 'keyword' as scorer, false as low_relevance from final where {_KEPT}")
def fallback_passages(spark, root):
    """A configuration whose models aren't there: vector search leaves keyword search, the pair scorer the keyword reranker, visibly."""
    config = retrieval.RetrievalConfig(rerank="cross-encoder", summaries=False)
    found = retrieval.retrieve(_library(spark, root), _questions(spark, root), config, plugged=retrieval.Models())
    return found.select("query_id", "chunk_id", "score", "rank", "mode", "scorer", "low_relevance")


@query(f"with {_QUESTIONS}, big as (select doc_id from citations where chunk_id is not null and text is not null and doc_id is not null group by 1 order by count(*) desc, doc_id limit 3), {_STORED.replace('stored as (', 'kept as (')}, stored as (select * from kept where doc_id in (select doc_id from big)), {_BM25}, lists as (select * from bmr), {_FUSED}, {_FINAL} select query_id, chunk_id, score, place::int as rank, 'keyword' as mode, 'keyword' as scorer, false as low_relevance from final where {_KEPT}")
def scoped_passages(spark, root):
    """Keyword search within the three documents cited most (a document scope)."""
    big = _citations(spark, root).where("chunk_id is not null and text is not null and doc_id is not null").groupBy("doc_id").count().orderBy(F.desc("count"), "doc_id").limit(3).select("doc_id")
    found = retrieval.retrieve(_library(spark, root), _questions(spark, root), retrieval.RetrievalConfig(use_dense=False, summaries=False), scope=big)
    return found.select("query_id", "chunk_id", "score", "rank", "mode", "scorer", "low_relevance")


_NOTE = "> **Extractive answer** - the AI model is unavailable (no model is configured). Below are the most relevant sentences from your documents."


@query(f"""with {_QUESTIONS}, {_STORED}, {_BM25}, {_DENSE}, lists as (select * from bmr union all select * from dr), {_FUSED}, {_FINAL}, kept as (select *, list_distinct({_tok('question')}) as qt from final where {_KEPT}),
s as (select query_id, qt, style, place, unnest({_sentences('text')}) as sentence, generate_subscripts({_sentences('text')}, 1) as pos from kept),
c as (select *, round(case when len(qt) > 0 then len(list_intersect(qt, {_tok('sentence')}))::double / len(qt) else 0 end + 0.15 / place, 9) as sc from s where length(sentence) >= 25 and sentence not like '#%'),
k as (select * from (select *, row_number() over (partition by query_id order by sc desc, place, pos) as n from c) where n <= case lower(style) when 'concise' then 2 when 'long' then 10 else 5 end),
j as (select query_id, case when min(lower(style)) = 'concise' then string_agg(sentence || ' [' || place || ']', ' ' order by place, pos) else '- ' || string_agg(sentence || ' [' || place || ']', chr(10) || '- ' order by place, pos) end as drawn from k group by 1),
t as (select query_id, max(score) filter (where place = 1) as top, count(*) as n_sources from kept group by 1), a as (select q.query_id, coalesce(drawn, '{T.NOT_FOUND.replace(chr(39), chr(39) * 2)}') as bare, top, coalesce(n_sources, 0) as n_sources, t.query_id is not null as any from questions q left join j using (query_id) left join t on t.query_id = q.query_id)
select query_id, case when n_sources > 0 then '{_NOTE}' || chr(10) || chr(10) else '' end || bare as answer, case when top is null or {_not_found('bare')} then 'Insufficient Evidence' when top >= 0.55 then 'High' when top >= 0.35 then 'Medium' else 'Low' end as confidence, n_sources, case when "any" then 'hybrid' else 'keyword' end as mode, 'keyword' as scorer, false as llm_used, case when n_sources > 0 then '{_NOTE}' || chr(10) || chr(10) end as notice from a""")
def hybrid_answers(spark, root):
    """Every question through both searches to a cited answer, its confidence and how it came about."""
    return retrieval.answer(_library(spark, root), _questions(spark, root))


@query("select (select count(distinct doc_id) from document_info) as documents, (select count(distinct chunk_id) from citations where chunk_id is not null and text is not null) as chunks, false as llm_available, true as vectors_ready, 'keyword' as reranker, 'CSV, DOCX, HTM, HTML, JSON, LOG, MARKDOWN, MD, PDF, PY, RST, TXT' as supported_formats, 'No LLM configured: answers are extracted sentences, not AI-written. / Reranking by cross-encoder isn''t available: using keyword reranking instead.' as warnings")
def engine_status(spark, root):
    """What is active and what users should know of, as one row."""
    config = retrieval.RetrievalConfig(rerank="cross-encoder")
    row = retrieval.status(_stored_chunks(spark, root), _registry(spark, root), config, retrieval.default_models(config))
    return row.withColumn("warnings", F.array_join("warnings", " / "))


from docloom import catalogue_answers  # noqa: E402

_QUERIES.update(catalogue_answers.QUERIES)
_SQL.update(catalogue_answers.SQL)
